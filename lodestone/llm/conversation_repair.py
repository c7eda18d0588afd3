"""Conversation structure repair by run-length dynamic programming.

Each row of a conversation is a symbol: the class of its role and what is wrong with it. Equal consecutive symbols are one run. What
a symbol costs from one state of the wanted order to another, inserted turns before it included, is a min-plus matrix; a run of n
applies it in as many steps as n has bits, from powers that are kept. Costs are found from the end to the start; then the edits are
unrolled from the start, the least letter first among those of least cost, which gives the least audit.

Rows are ordered by a range partitioning, so that a conversation of any length is cut into segments, which are collapsed
to runs where they lie; only the runs of a conversation meet. Texts are digested in a pass of their own, row after row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attach, staged

# Wanted order of role initials: (s?(ua)+)?, as states 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a).
_CLASSES = "sua"
_GO = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # state, class
_NEXT = (2, 2, 3, 2)
#: The role that a turn put into a state has.
ROLE = {2: "user", 3: "assistant"}
_ADJACENT = {(0, 1), (1, 2), (2, 1)}
#: Costs of the edits and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FINE, CUT, DROP = 0, 1, 2
#: Rows of a run that are unrolled at once.
STEP = 1024
_FAR = 1 << 60
Vector = tuple[int, int, int, int]
_END: Vector = (0, 2 * INSERT, INSERT, 0)
SPACE = " \t\n\x0b\x0c\r"


def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of the edits of a row, by letter."""
    kind, fault = divmod(symbol, 3)
    out = [("D", DELETE, state)]
    if fault != DROP:
        more = TRUNCATED if fault == CUT else 0
        if (state, kind) in _GO:
            out.append(("K", more, _GO[state, kind]))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


def times(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(a[p][k] + b[k][q] for k in range(4)) for q in range(4)) for p in range(4))


@cache
def power(symbol: int, bit: int) -> tuple[Vector, ...]:
    """The transition of 2^bit rows of a symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return times(half, half)
    rows = []
    for p in range(4):
        best, state, cost = [_FAR] * 4, p, 0
        for _ in range(3):  # more than two inserted turns lead nowhere new
            for _, c, q in options(symbol, state):
                best[q] = min(best[q], cost + c)
            state, cost = _NEXT[state], cost + INSERT
        rows.append(tuple(best))
    return tuple(rows)


def before(symbol: int, n: int, after: Vector) -> Vector:
    """Costs to the end from each state before n rows of a symbol, given those after them."""
    bit = 0
    while n >> bit:
        if n >> bit & 1:
            m = power(symbol, bit)
            after = tuple(min(m[p][q] + after[q] for q in range(4)) for p in range(4))
        bit += 1
    return after


def repair(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Least cost and the least audit of it for runs of (symbol, number of rows)."""
    after = [_END]
    for symbol, n in reversed(runs):
        after.append(before(symbol, n, after[-1]))
    after.reverse()
    state, letters = 0, []
    for (symbol, n), end in zip(runs, after[1:], strict=True):
        while n:
            here = min(n, STEP)
            n -= here
            costs = [before(symbol, n, end)]
            for _ in range(here):
                costs.append(before(symbol, 1, costs[-1]))
            while len(costs) > 1:
                now, then = costs[-1], costs[-2]
                found = [(letter, q) for letter, cost, q in options(symbol, state) if cost + then[q] == now[state]]
                if INSERT + now[_NEXT[state]] == now[state]:
                    found.append(("I", _NEXT[state]))
                letter, state = min(found)
                letters.append(letter)
                if letter != "I":
                    costs.pop()
    return after[0][0], "".join(letters) + "I" * (_END[state] // INSERT)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, n: what a row becomes, n times, by the CRC-32 of its conversation and turn; nulls count as one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).where("kind > 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return out.withColumn("digest", F.unhex(F.sha2("text", 256)))


ORDER = ("conv_id", "known", "turn", "role", "digest")


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, known, turn, role, digest, n, blank, cut, first: distinct rows, n times each; first says that role and text were not seen in an earlier turn."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    rows = turns.select("conv_id", "turn", "role", "digest", "n", (last == "").alias("blank"), (~last.isin(".", "!", "?", "")).alias("cut"))
    same = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    same = staged(same.withColumn("known", F.col("turn").isNotNull()), "turns")
    keys = ["conv_id", "role", "digest"]
    seen = same.groupBy(*keys).agg(F.min(F.struct("known", "turn")).alias("earliest"), F.count(F.lit(1)).alias("size"))
    rows = attach(same, staged(seen, "texts"), keys, "size")
    return rows.select(*ORDER, "n", "blank", "cut", F.col("earliest.turn").eqNullSafe(F.col("turn")).alias("first"))


PART = "known boolean, turn long, role string, digest binary, symbols array<int>, counts array<long>, blank long, duplicate long, truncated long, turns long, least long, most long"


def segments(rows: DataFrame, conv_id: str) -> DataFrame:
    """A row for each conversation of each range of rows, with its runs, counts and turns; it begins with the row that orders it."""
    fields = [f.split()[0] for f in PART.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        now: dict = {}
        last: tuple = ()
        kind, schema = None, None

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(done, schema)
            done.clear()
            return made

        for batch in batches:
            if schema is None:
                kind = batch.schema.field("conv_id").type
                types = [pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 6]
                schema = pa.schema([("conv_id", kind), *zip(fields, types, strict=True)])
            for conv, known, turn, role, digest, n, blank, cut, first in zip(*(batch[c].to_pylist() for c in (*ORDER, "n", "blank", "cut", "first")), strict=True):
                if (conv,) != last:
                    if now:
                        done.append(now)
                    last = (conv,)
                    now = {"conv_id": conv, "known": known, "turn": turn, "role": role, "digest": digest, "symbols": [], "counts": [], "blank": 0, "duplicate": 0, "truncated": 0, "turns": 0, "least": None, "most": None}
                if turn is not None and turn != now["most"]:
                    now["turns"] += 1
                    now["least"], now["most"] = turn if now["least"] is None else now["least"], turn
                base = 3 * (_CLASSES.find(role[0]) if role and role[0] in _CLASSES else 3)
                alone = 0 if blank or not first else 1
                now["blank" if blank else "duplicate"] += n - alone
                now["truncated"] += alone if cut else 0
                for symbol, count in ((base + (CUT if cut else FINE), alone), (base + DROP, n - alone)):
                    if count and now["symbols"] and now["symbols"][-1] == symbol:
                        now["counts"][-1] += count
                    elif count:
                        now["symbols"].append(symbol)
                        now["counts"].append(count)
            if len(done) >= 4096:
                yield out()
        if now:
            done.append(now)
            yield out()

    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(each, f"conv_id {conv_id}, {PART}")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def solved(parts: DataFrame, conv_id: str) -> DataFrame:
    """conv_id and RESULT: the segments of each conversation joined in order, at most as many as there are ranges."""
    fields = [f.split()[0] for f in PART.split(", ")]
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))

    def one(own: list[dict]) -> tuple:
        runs: list[tuple[int, int]] = []
        turns, least, most, illegal = 0, None, None, 0
        for x in own:
            for run in zip(x["symbols"], x["counts"], strict=True):
                if runs and (runs[-1][0] // 3, run[0] // 3) not in _ADJACENT:
                    illegal += 1
                illegal += run[1] - 1  # a class never follows itself
                runs[-1:] = [(run[0], runs[-1][1] + run[1])] if runs and runs[-1][0] == run[0] else [*runs[-1:], run]
            if x["least"] is not None:
                turns += x["turns"] - (x["least"] == most)
                least, most = x["least"] if least is None else least, x["most"]
        gaps = 0 if least is None else most - least + 1 - turns
        return ((gaps + (1 << 63)) % (1 << 64) - (1 << 63), *(sum(x[c] for x in own) for c in ("blank", "duplicate", "truncated")), illegal, *repair(runs))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        for batch in batches:
            made = [one(own) for own in batch["parts"].to_pylist()]
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], *[pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)]], ["conv_id", *names])

    return whole.mapInArrow(each, f"conv_id {conv_id}, {RESULT}")


def repaired_rows(role: str, text: bytes, n: int, audit: Iterator[str], state: int) -> Iterator[tuple[int, bytes | None]]:
    """State, and the repaired row or None, after each edit of n equal rows."""
    for _ in range(n):
        for letter in audit:
            if letter == "D":
                yield state, None
                break
            state = _GO[state, _CLASSES.index(role[0])] if letter == "K" else _NEXT[state]
            if letter == "I":
                yield state, f"{ROLE[state]}:".encode()
                continue
            yield state, (role if letter == "K" else ROLE[state]).encode() + b":" + text
            break


def repaired(rows: DataFrame) -> DataFrame:
    """Damages conversations, finds their faults and the cheapest repair: conv_id, RESULT and repaired_sha256, a row per original conv_id.

    Rows are taken by turn, nulls first, then by role and digest of the text, so the order of repeated turns is fixed. conv_id may be of
    any type that can be ordered, null is a conversation too; null roles and texts are one space. Repeated rows are rows. A
    conversation whose rows are all dropped has zeros, an empty audit and the digest of nothing; an empty table gives an empty one. A gap
    beyond 64 bits wraps. Other columns are not read.
    """
    conv_id = dict(rows.dtypes)["conv_id"]
    turns = damaged(rows)
    found = staged(solved(segments(faults(turns), conv_id), conv_id), "repairs")
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    names = [f.split()[0] for f in RESULT.split(", ")]
    empty = [F.coalesce(c, F.lit("" if c == "audit" else 0)).alias(c) for c in names]
    heads = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *empty, F.lit(0).alias("n"))
    texts = turns.select("conv_id", F.lit(1).alias("kind"), F.col("turn").isNotNull().alias("known"), "turn", "role", "digest", "n", "text")
    both = heads.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    # the head of a conversation comes before its rows; a task holds the audit of one and a batch of texts
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        head, audit, state, sha, count = None, iter(""), 0, hashlib.sha256(), 0

        def put(line: bytes | None) -> None:
            nonlocal count
            if line is not None:
                sha.update(b"\n" + line if count else line)
                count += 1

        def close() -> None:
            nonlocal state
            if head:
                for _ in audit:  # turns inserted at the end
                    state = _NEXT[state]
                    put(f"{ROLE[state]}:".encode())
                done.append((*head, sha.hexdigest()))

        def out(kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], ["conv_id", *names, "repaired_sha256"])
            done.clear()
            return made

        kind = None
        for batch in batches:
            kind = batch["conv_id"].type
            heads_ = zip(*(batch[c].to_pylist() for c in ("conv_id", *names)), strict=True)
            for of, own, role, text, n in zip(batch["kind"].to_pylist(), heads_, batch["role"].to_pylist(), batch["text"].cast(pa.binary()), batch["n"].to_pylist(), strict=True):
                if not of:
                    close()
                    head, audit, state, sha, count = own, iter(own[-1]), 0, hashlib.sha256(), 0
                else:
                    for state, line in repaired_rows(role, text.as_py(), n, audit, state):  # noqa: B020
                        put(line)
            if len(done) >= 4096:
                yield out(kind)
        if kind is not None:
            close()
            yield out(kind)

    return ordered.mapInArrow(each, f"conv_id {conv_id}, {RESULT}, repaired_sha256 string")


SQL = r"""WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) ORDER BY k) AS t FROM range(256) r(k)),
c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS key FROM conversations),
c1 AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(key, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS kind FROM c0, crc),
c2 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c1 WHERE kind > 0),
c3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM c2),
c4 AS (SELECT conv_id, turn, role, text, i, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM c3),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, fault, ini, prev FROM c4),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM f GROUP BY conv_id),
ins(p, q, cost, letters, turns) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])),
ed(p, ini, letter, cost, q, role) AS (VALUES (0, 's', 'K', 0, 1, NULL), (0, 'u', 'K', 0, 2, NULL), (1, 'u', 'K', 0, 2, NULL), (2, 'a', 'K', 0, 3, NULL), (3, 'u', 'K', 0, 2, NULL), (0, NULL, 'D', 4, 0, NULL), (1, NULL, 'D', 4, 1, NULL), (2, NULL, 'D', 4, 2, NULL), (3, NULL, 'D', 4, 3, NULL), (0, NULL, 'R', 3, 2, 'user'), (1, NULL, 'R', 3, 2, 'user'), (2, NULL, 'R', 3, 3, 'assistant'), (3, NULL, 'R', 3, 2, 'user')),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS turns FROM g UNION ALL
  SELECT conv_id, i, q, cost, audit, turns FROM (SELECT dp.conv_id, f.i, e.q, dp.cost + n.cost + e.cost + CASE WHEN f.fault = 't' AND e.letter <> 'D' THEN 3 ELSE 0 END AS cost, dp.audit || n.letters || e.letter AS audit,
    dp.turns || n.turns || CASE WHEN e.letter = 'D' THEN [] ELSE [coalesce(e.role, f.role) || ':' || f.text] END AS turns
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins n ON n.p = dp.q JOIN ed e ON e.p = n.q AND (e.ini IS NULL OR e.ini = f.ini) AND (e.letter = 'D' OR f.fault NOT IN ('b', 'd')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
z AS (SELECT g.*, dp.cost + n.cost AS cost, dp.audit || n.letters AS audit, dp.turns || n.turns AS turns FROM g JOIN dp ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND dp.i = g.size JOIN ins n ON n.p = dp.q AND (n.q = 3 OR n.q = 0)
  QUALIFY row_number() OVER (PARTITION BY g.conv_id ORDER BY dp.cost + n.cost, dp.audit || n.letters) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id"""
