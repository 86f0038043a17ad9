"""Repair of conversations against a search through all edits."""

import hashlib
import random
import re

import numpy as np
import pytest

from newsdesk.llm import conversation_repair as cr

GOOD = re.compile(r"(s?(ua)+)?")
CLASS = "suax"


def exhaustive(symbols):
    """Least (cost, audit) by keeping, after each row, the least of every role string of what is kept."""
    found = {"": (0, "")}

    def put_in(found):
        for _ in range(3):
            for roles, (cost, audit) in list(found.items()):
                for role in "ua":
                    new = (cost + 5, audit + "I")
                    if len(roles) < 14 and new < found.get(roles + role, (10**9,)):
                        found[roles + role] = new
        return found

    for symbol in symbols:
        new = {}
        for roles, (cost, audit) in put_in(found).items():
            ways = [(roles, cost + 2, "D")]
            if symbol != cr.GONE:
                late = 5 * (symbol >= 4)
                ways += [(roles + CLASS[symbol % 4], cost + late, "K")] + [(roles + r, cost + late + 1, "R") for r in "ua"]
            for after, c, edit in ways:
                new[after] = min(new.get(after, (10**9,)), (c, audit + edit))
        found = {roles: v for roles, v in new.items() if re.fullmatch(r"s?(ua)*u?", roles)}
    return min(v for roles, v in put_in(found).items() if GOOD.fullmatch(roles))


def test_repair_is_the_least_of_all_edits():
    rng = random.Random(1)
    for _ in range(400):
        symbols = [rng.choice((0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8)) for _ in range(rng.randrange(7))]
        assert cr.repair(np.array(symbols, np.int8)) == exhaustive(symbols), symbols


def test_runs_give_what_single_rows_give(monkeypatch):
    rng = random.Random(2)
    for _ in range(60):
        symbols = np.array([s for _ in range(rng.randrange(1, 5)) for s in [rng.randrange(9)] * rng.randrange(1, 40)], np.int8)
        monkeypatch.setattr(cr, "LONGEST_RUN", 4096)
        want = cr._repair(symbols)
        for longest in (1, 3, 8):
            monkeypatch.setattr(cr, "LONGEST_RUN", longest)
            assert cr._repair(symbols) == want
    cost, audit = cr.repair(np.full(100_001, 1, np.int8))
    assert cost == 50_002 and audit == "D" + "KR" * 50_000


def plain(rows):
    """What the operator returns for one conversation's (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, symbols, faults = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        words = text.strip(cr.BLANKS)
        fault = cr.BLANK if not words else cr.DUPLICATE if (role, text) in seen else cr.TRUNCATED if words[-1] not in ".!?" else 0
        seen.add((role, text))
        faults[fault] += 1
        kind = "sua".find(role[:1]) if role else -1
        symbols.append(cr.GONE if fault in (1, 2) else (kind if kind >= 0 else 3) + 4 * (fault == 3))
    odd = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = exhaustive(symbols)
    out, left = [], list(rows)
    for edit in audit:
        _, role, text = (None, None, "") if edit == "I" else left.pop(0)
        if edit != "D":
            out.append((role if edit == "K" else "assistant" if out and out[-1][0][:1] == "u" else "user", text))
    return gaps, *faults[1:], odd, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()


def test_conversations_with_everything(spark):
    rng = random.Random(3)
    turns = []
    for conv in [None, *range(-2, 25)]:
        for _ in range(rng.randrange(1, 7)):
            text = rng.choice((None, "", " \t\n", "Yes.", "no", "A b?\n", "è\u0085", "x" * 30_000 + "!", "Yes."))
            turns.append((conv, rng.choice((None, 0, 1, 1, 2, 9)), rng.choice((None, "", "user", "assistant", "system", "tool", "uncle")), text))
    turns += turns[:10]
    convs = {c for c, *_ in turns}
    rows = spark.createDataFrame([(*t, "extra", 1) for t in turns], "conv_id long, turn long, role string, text string, number string, audit int")
    got = {r[0]: tuple(r)[1:] for r in cr.repair_conversations(rows.repartition(5)).collect()}
    assert set(got) == convs
    for conv in convs:
        assert got[conv] == plain([t[1:] for t in turns if t[0] == conv]), conv


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_conversations(cr.damaged(none)).count() == 0


def test_a_conversation_that_loses_all_rows(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi.", False), (2, None, "user", "Hi.", True)], "conv_id long, turn long, role string, text string, there boolean")
    got = {r.conv_id: r for r in cr.repair_conversations(rows).collect()}
    empty = hashlib.sha256().hexdigest()
    assert (got[1].cost, got[1].audit, got[1].repaired_sha256, got[1].gaps) == (0, "", empty, 0)
    assert (got[2].cost, got[2].audit, got[2].repaired_sha256) == (2, "D", empty)


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "One."), (1, 1, "user", "Two."), (1, 2, "assistant", "Three.")], "conv_id long, turn long, role string, text string")
    flagged = cr.flagged(rows)
    out = cr.repaired_turns(flagged, cr.plans(flagged)).collect()
    assert [(r.number, r.role, r.text) for r in out] == [(1, "user", "Two."), (2, "assistant", "Three.")]


@pytest.mark.parametrize("rows", [3000])
def test_a_large_conversation_streams(spark, rows):
    turns = spark.createDataFrame([(7, k, "user" if k % 2 == 0 else "assistant", f"Line {k}.") for k in range(rows)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        (got,) = cr.repair_conversations(turns).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.cost == 0 and got.audit == "K" * rows and got.illegal == 0
    said = "\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:Line {k}." for k in range(rows))
    assert got.repaired_sha256 == hashlib.sha256(said.encode()).hexdigest()
