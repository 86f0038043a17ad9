"""Repair of conversations: the cheapest edits that leave roles in the order `(s?(ua)+)?`.

Each row keeps its place (0), takes another role (1), is deleted (2; blank rows and repetitions always are), and empty
user or assistant rows may be put in anywhere (5); a truncated row that stays costs 5 more. A row is a symbol of its
role and fault. A conversation's symbols are collapsed into runs; the cost from each state (nothing yet, after system,
user, assistant) to the end is carried over a run from its end to its start by binary powers of the symbol's min-plus
matrix, which are cached. Walking forward, of the edits that keep the least cost the one with the smallest initial is
taken, which gives the ASCII-least audit.

Rows are dealt by conversation; the order, the repetitions and the faults come from windows over sorted rows that
spill. Costs and audits are made from symbols alone (about two bytes a row of the conversation at hand); texts are then
streamed beside the audit. A conversation's digest is sequential, so a conversation of any length is one task's, in
bounded memory but for its symbols.

Defined cases: a null role or text counts as one space; a null conv_id is a conversation; rows go by turn (null first),
role and text; repeated rows are rows of their own, all but the first of them duplicates; the initial of an empty role
is empty, which fits nowhere; a conversation without rows gives zeros, an empty audit and the digest of an empty
string; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsdesk.llm.common import Scratch, table

BLANKS, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Symbols: a role's class (system, user, assistant, other), 4 more if truncated; GONE must be deleted.
GONE = 8
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: Where a user or assistant row leads from each state.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = ({START: SYSTEM}, {s: t for s, t in TURN.items() if t == USER}, {USER: ASSISTANT}, {})
KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 1, 2, 5, 5
LONGEST_RUN = 4096
PLANS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id long, number long, role string, text string"


def flagged(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with their order, fault, symbol, and whether the role can't follow the one before.

    Rows of a column `there` that is false only say that the conversation exists.
    """
    there = F.col("there") if "there" in turns.columns else F.lit(True)
    space = lambda c: F.coalesce(c, F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), there.alias("there"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).repartition("conv_id")
    same = Window.partitionBy("conv_id", "there", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("seen", F.row_number().over(same) > 1).drop("digest")
    order = Window.partitionBy("conv_id").orderBy(F.col("there").desc(), F.col("turn").asc_nulls_first(), "role", "text", "seen")
    initial, said = F.substring("role", 1, 1), F.rtrim("text", F.lit(BLANKS))
    fault = F.when(said == "", BLANK).when(F.col("seen"), DUPLICATE).when(~F.substring(said, -1, 1).isin(*ENDS), TRUNCATED).otherwise(0)
    kind = F.when(initial == "s", SYSTEM - 1).when(initial == "u", USER - 1).when(initial == "a", ASSISTANT - 1).otherwise(3)
    symbol = F.when(F.col("fault").isin(BLANK, DUPLICATE), GONE).otherwise(kind + F.when(F.col("fault") == TRUNCATED, 4).otherwise(0))
    before = F.lag(initial).over(order)
    illegal = before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au") & F.col("there")
    rows = rows.withColumns({"number": F.row_number().over(order).cast("long"), "illegal": illegal, "fault": fault})
    return rows.withColumn("symbol", symbol).select("conv_id", "number", "turn", "there", "role", "text", "fault", "symbol", "illegal")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of two matrices."""
    return np.minimum((a[:, :, None] + b[None]).min(1), NEVER)


def _carry(a: np.ndarray, vs: np.ndarray) -> np.ndarray:
    """The min-plus product of a matrix and each of the vectors that are the rows of `vs`."""
    return np.minimum((a[None] + vs[:, None, :]).min(2), NEVER)


def _inserts() -> np.ndarray:
    """Cost of leading from state to state by insertions; two are enough, as a third leads back."""
    one = np.full((4, 4), NEVER, np.int64)
    one[np.arange(4), np.arange(4)] = 0
    for s, t in TURN.items():
        one[s, t] = INSERT
    return _times(one, one)


def _edits(symbol: int) -> list[tuple[str, int, dict[int, int]]]:
    """Initial, cost and moves of the edits of a row, by initial."""
    found = [("D", DELETE, {s: s for s in range(4)})]
    if symbol != GONE:
        more = STAYS_TRUNCATED * (symbol >= 4)
        found += [("K", KEEP + more, KEPT[symbol % 4]), ("R", REROLE + more, TURN)]
    return found


@functools.cache
def power(symbol: int, k: int) -> np.ndarray:
    """The min-plus matrix of 2**k rows of one symbol, insertions before each included."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    row = np.full((4, 4), NEVER, np.int64)
    for _, cost, moves in _edits(symbol):
        for s, t in moves.items():
            row[s, t] = min(row[s, t], cost)
    return _times(_inserts(), row)


def _before(symbol: int, n: int, v: np.ndarray) -> np.ndarray:
    """Costs to the end from before a run of `n` symbols, given those behind it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = _carry(power(symbol, k), v[None])[0]
    return v


def _inside(symbol: int, n: int, v: np.ndarray) -> list[list[int]]:
    """Costs to the end from before the last n, n - 1, ... 0 symbols of a run, by doubling."""
    out = v[None]
    for k in range(n.bit_length()):
        out = np.concatenate([out, _carry(power(symbol, k), out[: n + 1 - len(out)])])
    return out[::-1].tolist()


def repair(symbols: np.ndarray) -> tuple[int, str]:
    """Least cost and audit of a conversation."""
    if len(symbols) <= 64:
        return _short(symbols.tobytes())
    return _repair(symbols)


@functools.lru_cache(1 << 16)
def _short(symbols: bytes) -> tuple[int, str]:
    return _repair(np.frombuffer(symbols, np.int8))


def _repair(symbols: np.ndarray) -> tuple[int, str]:
    starts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]]) if len(symbols) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(symbols))
    runs = [(int(symbols[a]), min(LONGEST_RUN, b - at)) for a, b in zip(starts.tolist(), ends.tolist(), strict=False) for at in range(a, b, LONGEST_RUN)]
    v = _inserts()[:, [START, ASSISTANT]].min(1)
    behind = []  # costs behind each run, last run first
    for symbol, n in reversed(runs):
        behind.append(v)
        v = _before(symbol, n, v)
    state, audit, cost = START, [], int(v[START])
    for symbol, n in runs:
        edits = [("D", *_edits(symbol)[0][1:]), ("I", INSERT, TURN), *_edits(symbol)[1:]]
        costs = _inside(symbol, n, behind.pop())
        for here, after in zip(costs, costs[1:], strict=False):
            name = "I"
            while name == "I":
                name, state = next((e, moves[state]) for e, c, moves in edits if state in moves and c + (here if e == "I" else after)[moves[state]] == here[state])
                audit.append(name)
    while state not in (START, ASSISTANT):
        audit.append("I")
        state = TURN[state]
    return cost, "".join(audit)


class _Open:
    """What is known so far of the conversation at hand."""

    def __init__(self, conv: int | None):
        self.conv, self.faults, self.illegal, self.symbols = conv, np.zeros(4, np.int64), 0, []
        self.first = self.last = None
        self.turns = 0

    def add(self, fault: np.ndarray, symbol: np.ndarray, illegal: np.ndarray, turns: np.ndarray) -> None:
        """Rows in order; turns: those that aren't null."""
        self.faults += np.bincount(fault, minlength=4)
        self.illegal += int(illegal.sum())
        self.symbols.append(symbol)
        if len(turns):
            new = int((turns[1:] != turns[:-1]).sum()) + (self.last is None or self.last != turns[0])
            self.first = int(turns[0]) if self.first is None else self.first
            self.turns, self.last = self.turns + int(new), int(turns[-1])

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit = repair(np.concatenate(self.symbols) if self.symbols else np.empty(0, np.int8))
        return (self.conv, gaps, *self.faults[1:].tolist(), self.illegal, cost, audit)


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    at: _Open | None = None
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 8
        done.clear()
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        null = batch.column("conv_id").is_null().to_numpy(zero_copy_only=False)
        conv = batch.column("conv_id").fill_null(0).to_numpy(zero_copy_only=False)
        there, fault, symbol, illegal = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("there", "fault", "symbol", "illegal"))
        no_turn = batch.column("turn").is_null().to_numpy(zero_copy_only=False)
        turn = batch.column("turn").fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(conv)], strict=True):
            own = None if null[a] else int(conv[a])
            if at is None or at.conv != own:
                if at:
                    done.append(at.row())
                at = _Open(own)
            rows = np.flatnonzero(there[a:b]) + a
            at.add(fault[rows], symbol[rows].astype(np.int8), illegal[rows], turn[rows][~no_turn[rows]])
        yield flush()
    if at:
        done.append(at.row())
    yield flush()


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, faults, illegal, cost, audit) from flagged() rows, one a conversation."""
    dealt = rows.select("conv_id", "number", "turn", "there", "fault", "symbol", "illegal").repartition("conv_id").sortWithinPartitions("conv_id", "number")
    return dealt.drop("number").mapInArrow(_plan, PLANS)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, behind each conversation's audit (number 0)."""
    names, rest = ("user", "assistant"), iter("")
    conv = after = None
    made = 0

    for batch in batches:
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal made, after
            made, after = made + 1, role[:1]
            out.append((conv, made, role, text))  # noqa: B023

        def insert_up_to() -> str:
            """The edit of the next row, once insertions before it are made."""
            for edit in rest:
                if edit != "I":
                    return edit
                put(names[after == "u"], "")
            return ""

        for own, number, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "number", "role", "text")), strict=True):
            if not number:
                insert_up_to()
                conv, after, made, rest = own, None, 0, iter(text)
                continue
            edit = insert_up_to()
            if edit != "D":
                put(role if edit == "K" else names[after == "u"], text)
        yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "number", "role", "text"), r, strict=True)) for r in out], _TURNS)
    out = []
    for _ in rest:
        made, after = made + 1, names[after == "u"][:1]
        out.append({"conv_id": conv, "number": made, "role": "user" if after == "u" else "assistant", "text": ""})
    yield pa.RecordBatch.from_pylist(out, _TURNS)


_TURNS = pa.schema([("conv_id", pa.int64()), ("number", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, number, role, text): the conversations after their edits, whole and in order within a partition."""
    none = F.lit(None).cast("string")
    audits = found.select("conv_id", F.lit(0).cast("long").alias("number"), none.alias("role"), F.col("audit").alias("text"))
    both = audits.unionByName(rows.where("there").select("conv_id", "number", "role", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "number").mapInArrow(_apply, TURNS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()]
    conv, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for own, number, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "number", "role", "text")), strict=True):
            if number == 1:
                if digest:
                    done.append((conv, digest.hexdigest()))
                conv, digest = own, hashlib.sha256()
            digest.update(f"{chr(10) * (number > 1)}{role}:{text}".encode())
        yield pa.record_batch([pa.array([d[k] for d in done], kinds[k]) for k in (0, 1)], names)
    yield pa.record_batch([pa.array([v] if digest else [], k) for v, k in zip((conv, digest and digest.hexdigest()), kinds, strict=True)], names)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: its gaps, faults, cost, audit and the digest of what the edits leave."""
    scratch = Scratch(turns.sparkSession, "conversation-repair")
    rows = scratch.write(flagged(turns), "flagged")
    found = scratch.write(plans(rows), "plans")
    digests = repaired_turns(rows, found).mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    digests = digests.withColumnRenamed("conv_id", "of")
    out = found.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of `turns` with faults that a CRC of conversation and turn picks."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") != 0).alias("there"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def _twin() -> str:
    """The same with whole texts carried for every state, in SQL."""
    entry = lambda s, cost, mark, said: f"{{'c': st[{s}].c + {cost}, 'a': st[{s}].a || '{mark}', 'r': st[{s}].r || {said}}}"
    say = lambda role: f"{role} || ':' || x.text || chr(10)"
    new = []
    for state in (1, 2, 3, 4):
        ways = [entry(state, 2, "D", "''")]
        for before in {1: [], 2: [1], 3: [1, 2, 4], 4: [3]}[state]:
            initial, name = {2: "su", 3: "ua", 4: "as"}[state][0], {3: "'user'", 4: "'assistant'"}.get(state)
            kept = f"CASE WHEN x.gone OR substr(x.role, 1, 1) <> '{initial}' THEN 1000000 ELSE x.late END"
            ways.append(entry(before, kept, "K", say("x.role")))
            if name:
                ways.append(entry(before, "CASE WHEN x.gone THEN 1000000 ELSE x.late + 1 END", "R", say(name)))
        new.append(f"list_min([{', '.join(ways)}])")
    step = f"[{', '.join(new)}]"
    user = "list_min([st[3], " + ", ".join(entry(s, 5, "I", "'user:' || chr(10)") for s in (1, 2, 4)) + "])"
    more = f"list_transform([{step}], lambda st: [st[1], st[2], {user}, st[4]])[1]"
    answer = "list_min([st[4], " + entry(3, 5, "I", "'assistant:' || chr(10)") + "])"
    step = f"list_transform([{more}], lambda st: [st[1], st[2], st[3], {answer}])[1]"
    first = "[{'c': 0, 'a': '', 'r': ''}, {'c': 1000000, 'a': '', 'r': ''}, {'c': 5, 'a': 'I', 'r': 'user:' || chr(10)}, {'c': 10, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}]"
    kind = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)[]"
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH crcs AS (
  SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(256) t(i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), picked AS (
  SELECT * EXCLUDE (key, crc), xor(list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS what FROM keyed, crcs
), rows AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy FROM picked WHERE what <> 0
), ordered AS (
  SELECT *, rtrim(text, {blanks}) AS said, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM rows
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS n FROM ordered
), flagged AS (
  SELECT *, said = '' AS is_blank, said <> '' AND seen AS is_copy, said <> '' AND NOT seen AND right(said, 1) NOT IN ('.', '!', '?') AS is_cut,
         coalesce(lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), false) AS odd FROM placed
), convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_copy) AS duplicate,
         count(*) FILTER (is_cut) AS truncated, count(*) FILTER (odd) AS illegal,
         list({{'role': role, 'text': text, 'gone': is_blank OR is_copy, 'late': CASE WHEN is_cut THEN 5 ELSE 0 END}} ORDER BY n) AS said FROM flagged GROUP BY conv_id
), ends AS (SELECT * EXCLUDE (said), list_reduce(said, lambda st, x: {step}, {first}::{kind}) AS st FROM convs
), best AS (SELECT * EXCLUDE (st), list_min([st[1], st[4]]) AS b FROM ends)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.r, 1, length(b.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""


ORACLE = _twin()
