import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokens = pytest.importorskip("newsdesk.llm.tokens")


@pytest.mark.parametrize("pair", ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"])
def test_letters_that_compose_in_lower_case_only(pair):
    path = public_tokenizers.path("word_bpe_49k.json")
    chunks = tokens.encoder(path)
    for text in (f"Some {pair}ohn WORDS {pair} ends{pair}.", f"{pair.lower()}ohn CAF\u00c9 Ol\u00e1"):
        assert chunks.encode(text).tolist() == chunks.tokenizer.encode(text, add_special_tokens=False).ids
