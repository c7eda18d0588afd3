"""Phrase collocation mining: phrases counted in HAT-tries (Askitis and Sinha, 2007), scored by their weakest cut.

A task numbers the words that it meets and counts phrases in a trie over these numbers: a shallow trie leads to hash
containers, and a container that grows bursts into one per next word. When a trie is full, its largest subtrees leave
whole as runs, sorted by a mixed hash of the words; each range of that hash is a partition in which the runs of all tasks
are merged. A phrase and each of its prefixes is counted under its own hash, so no frequent first word makes a large partition.

Words come first, then pairs of frequent words, then longer phrases of which each pair is frequent. What is frequent reaches the
tasks as a bitmap of fixed size: words or pairs that share a bit are counted in vain and dropped at the merge, so counts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, staged

#: Least count, longest phrase, share of a phrase's count at which a longer one makes it redundant (percent), phrases of a language.
LEAST, LONGEST, COVERED, TOP = 30, 4, 80, 2000
#: Entries of a container before it bursts, of a trie before it spills, words that a task keeps numbered.
BURST, FULL, NUMBERED = 1 << 12, 1 << 20, 1 << 19
#: Words of text per merged partition; bits of a screen.
SHARE, BITS = 1 << 21, 1 << 26
#: Ranges of phrases that are ranked before those of a language meet.
RANGES = 16
# Lower-cases A-Z; what ends a piece becomes a line feed, a tab a space.
_CUT = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t" + UPPER.encode(), b"\n" * 10 + b" " + LOWER.encode())


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of each piece of a text in UTF-8; null counts as empty."""
    return map(bytes.split, (text or b"").translate(_CUT).split(b"\n"))


def word_hash(lang: str, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\x00" + word, seed)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of several per row."""
    x = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        x = (x ^ c) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Node(dict):
    """A burst container: a container or another node per next word."""


class HatTrie:
    """Counts keys of 4 bytes a word; containers are dicts from the rest of a key to its count."""

    def __init__(self, burst: int = BURST) -> None:
        self.root, self.burst, self.size = Node(), burst, 0

    def add(self, keys: list[bytes]) -> None:
        burst, new = self.burst, 0
        for key in keys:
            node, head, tail = self.root, key[:4], key[4:]
            box = node.get(head)
            while type(box) is Node:
                node, head, tail = box, tail[:4], tail[4:]
                box = node.get(head)
            if box is None:
                box = node[head] = {}
            n = box.get(tail)
            if n is not None:
                box[tail] = n + 1
                continue
            box[tail] = 1
            new += 1
            if len(box) > burst and len(tail) > 4:
                node[head] = self._parted(box)
        self.size += new

    @staticmethod
    def _parted(box: dict[bytes, int]) -> Node:
        node = Node()
        for tail, n in box.items():
            node.setdefault(tail[:4], {})[tail[4:]] = n
        return node

    def spill(self, keep: int) -> tuple[list[bytes], list[int]]:
        """Removes whole subtrees, the largest first, until `keep` entries are left: their keys and counts."""
        sizes = sorted(((_entries(box), head) for head, box in self.root.items()), reverse=True)
        keys: list[bytes] = []
        counts: list[int] = []
        for size, head in sizes:
            if self.size <= keep:
                break
            _gather(head, self.root.pop(head), keys, counts)
            self.size -= size
        return keys, counts


def _entries(box: dict) -> int:
    return sum(map(_entries, box.values())) if type(box) is Node else len(box)


def _gather(prefix: bytes, box: dict, keys: list[bytes], counts: list[int]) -> None:
    if type(box) is Node:
        for head, child in box.items():
            _gather(prefix + head, child, keys, counts)
    else:
        keys += [prefix + tail for tail in box]
        counts += box.values()


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct rows in the order of their mixed hash: hash, columns, sums of counts."""
    mix = mixed(columns)
    order = np.argsort(mix)
    for exact in (False, True):
        m, cs = mix[order], [c[order] for c in columns]
        same = m[1:] == m[:-1]
        other = np.logical_or.reduce([c[1:] != c[:-1] for c in cs])
        if exact or not (same & other).any():
            break
        order = np.lexsort((*columns, mix))  # rows of one mixed hash that differ
    starts = np.flatnonzero(np.concatenate([[True], other])) if len(m) else np.zeros(0, np.int64)
    return m[starts], [c[starts] for c in cs], np.add.reduceat(counts[order], starts) if len(m) else counts


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


RUN = "size int, bucket int, n int, n_words int, words binary, codes binary, counts binary"


def runs(columns: list[np.ndarray], counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of RUN: the summed phrases by range of their mixed hash, words as codes of those in the run."""
    mix, columns, counts = summed(columns, counts)
    bucket = ((mix >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    have, start = np.unique(bucket, return_index=True)
    rows = []
    for b, lo, hi in zip(have.tolist(), start.tolist(), [*start[1:].tolist(), len(mix)], strict=True):
        words, codes = np.unique(np.stack([c[lo:hi] for c in columns]), return_inverse=True)
        codes = codes.reshape(-1).astype("<u4")
        planes = codes.view(np.uint8).reshape(-1, 4).T
        rows.append((len(columns), b, hi - lo, len(words), _packed(words.astype("<u8")), _packed(planes), _packed(counts[lo:hi].astype("<i8"))))
    names = [c.split()[0] for c in RUN.split(", ")]
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def merge(table: pa.Table, least: int) -> pa.Table:
    """The phrases of a partition that all its runs together count `least` times or more: size, hashes, at (place in a screen), n."""
    size, parts, counts = table["size"][0].as_py(), [], []
    for n, n_words, words, codes, c in zip(*(table[x].to_pylist() for x in ("n", "n_words", "words", "codes", "counts")), strict=True):
        planes = _unpacked(codes, 4 * n * size, "u1").reshape(4, -1)
        parts.append(_unpacked(words, n_words, "<u8")[np.ascontiguousarray(planes.T).view("<u4").reshape(size, n)])
        counts.append(_unpacked(c, n, "<i8"))
    mix, columns, n = summed(list(np.concatenate(parts, axis=1)), np.concatenate(counts))
    good = n >= least
    hashes = np.stack([c[good] for c in columns], 1).view(np.int64)
    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1) * size, pa.int32()), pa.array(hashes.reshape(-1)))
    return pa.table({"size": pa.array([size] * len(hashes), pa.int32()), "hashes": listed, "at": pa.array((mix[good] % np.uint64(BITS)).astype(np.int64)), "n": pa.array(n[good])})


def screen(rows: DataFrame, at: Column) -> Broadcast:
    """A bitmap of BITS bits with those at `at` set."""
    p = at + 1
    found = rows.select(F.bitmap_bucket_number(p).alias("slice"), F.bitmap_bit_position(p).alias("bit")).groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("bits"))
    held = np.zeros(BITS // 8, np.uint8)
    for r in found.toLocalIterator():
        held[(r.slice - 1) * len(r.bits) :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(held)


def _hit(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(BITS)
    return (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """lang, word, h, n; two words of one h are two rows of it."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, c in counts.items() for _ in c]
        words = [w for c in counts.values() for w in c]
        hashes = np.array([word_hash(lang, w, seed) for lang, w in zip(langs, words, strict=True)], np.uint64).view(np.int64)
        n = [x for c in counts.values() for x in c.values()]
        return pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.binary()).cast(pa.string()), "h": pa.array(hashes), "n": pa.array(n, pa.int64())})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                own = counts.setdefault(lang, Counter())
                own.update(text.as_py().translate(_CUT).split())
                if len(own) > NUMBERED:
                    yield rows({lang: counts.pop(lang)})
        if counts:
            yield rows(counts)

    counted = texts.mapInArrow(each, "lang string, word string, h long, n long")
    word = F.struct("lang", "word")
    found = counted.groupBy("h").agg(F.sum("n").alias("n"), F.min(word).alias("w"), F.max(word).alias("other"))
    return found.select("h", "n", "w.lang", "w.word", (F.col("w") != F.col("other")).alias("clash"))


def phrase_counts(texts: DataFrame, seed: int, least: int, buckets: int, words: Broadcast, pairs: Broadcast | None = None) -> DataFrame:
    """size, hashes, at, n of phrases that occur `least` times or more: pairs of words, or with a screen of pairs, all longer phrases."""
    width = 2 if pairs is None else LONGEST

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequent = words.value, None if pairs is None else pairs.value
        numbers: dict[str, dict[bytes, int]] = {}
        hashes = [0]  # number 0 is a word that is not frequent, or a gap
        trie = HatTrie()

        class Numbers(dict):
            def __init__(self, lang: str) -> None:
                self.lang = lang

            def __missing__(self, word: bytes) -> int:
                h = word_hash(self.lang, word, seed)
                at = h % BITS
                n = 0
                if known[at >> 3] >> (at & 7) & 1:
                    n = len(hashes)
                    hashes.append(h)
                self[word] = n
                return n

        def spilled(keep: int) -> Iterator[pa.RecordBatch]:
            keys, counts = trie.spill(keep)
            if keys:
                ids = np.frombuffer(b"".join(keys), ">u4").reshape(-1, width)
                cols, n = list(np.array(hashes, np.uint64)[ids].T), np.array(counts, np.int64)
                for size in range(2, 3) if pairs is None else range(3, LONGEST + 1):
                    full = ids[:, size - 1] > 0
                    if full.any():
                        yield runs([c[full] for c in cols[:size]], n[full], buckets)

        def add(ids: list[int]) -> None:
            x = np.array([*ids, *[0] * width], np.int64)
            n = len(ids)
            if pairs is None:
                good = (x[:n] > 0) & (x[1 : n + 1] > 0)
                grams = np.stack([x[:n], x[1 : n + 1]], 1)[good]
            else:
                h = np.array(hashes, np.uint64)[x]
                pair = (x[:-1] > 0) & (x[1:] > 0)
                pair[pair] = _hit(frequent, mixed([h[:-1][pair], h[1:][pair]]))
                run = pair[: n + width - 2]
                good = np.flatnonzero(run[:n] & run[1 : n + 1])
                grams = [x[good], x[good + 1], x[good + 2]]
                alive = np.ones(len(good), bool)
                for k in range(3, width):
                    alive &= pair[good + k - 1]
                    grams.append(np.where(alive, x[good + k], 0))
                grams = np.stack(grams, 1)
            trie.add(np.ascontiguousarray(grams.astype(">u4")).view(f"V{4 * width}").reshape(-1).tolist())

        ids: list[int] = []
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                number = numbers.get(lang)
                if number is None:
                    number = numbers[lang] = Numbers(lang)
                get = number.__getitem__
                for piece in pieces(text.as_py()):
                    if len(piece) > 1:
                        ids.extend(map(get, piece))
                        ids.append(0)
                        if len(ids) > 1 << 16:
                            add(ids)
                            ids = []
                            if trie.size > FULL:
                                yield from spilled(FULL // 2)
                            if sum(map(len, numbers.values())) > NUMBERED:
                                yield from spilled(0)
                                numbers.clear()
                                del hashes[1:]
                                number = numbers[lang] = Numbers(lang)
                                get = number.__getitem__
        add(ids)
        yield from spilled(0)

    counted = texts.mapInArrow(each, RUN).repartition(buckets, "size", "bucket").groupBy("size", "bucket")
    return counted.applyInArrow(lambda table: merge(table, least), "size int, hashes array<long>, at long, n long")


def _phrases(counts: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase (words joined by a space), size, a of the counted hashes."""
    places = counts.select("hashes", "n", F.posexplode("hashes").alias("place", "h")).join(words.select("h", "lang", "word"), "h")
    made = places.groupBy("hashes", "n").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    return made.select("lang", F.array_join("w.word", " ").alias("phrase"), F.size("hashes").alias("size"), F.col("n").alias("a"))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first `top` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Words and pieces are cut as the module says; a phrase is 2 to LONGEST words of one piece with a = its occurrences, overlaps
    included, of at least `least`. Its score is the lowest floor(2000000 a / (l + r)) over all cuts into a first part (l) and a rest
    (r), ties to the shorter first part; n counts the words of the language. Phrases whose words lie inside a longer
    phrase with COVERED percent of their count go. Order: score and a descending, phrase ascending by bytes. Null text counts as
    empty, a null lang is `und`; repeated rows count as often as they occur; doc_id and other columns are not read. Languages
    without a phrase have no row, so an empty table gives an empty one. Memory of a task is bounded by FULL, NUMBERED and a batch of texts.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seed = 0
    while True:
        vocabulary = staged(word_counts(texts, seed), "words")
        if vocabulary.where("clash").isEmpty():
            break
        seed += 1  # two words of one hash: all hashes anew
    totals = staged(vocabulary.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = staged(vocabulary.where(F.col("n") >= least).select("h", "lang", "word", "n"), "frequent-words")
    buckets = max(1, -(-(totals.agg(F.sum("total")).first()[0] or 0) // SHARE))
    known = screen(words, F.pmod("h", F.lit(BITS)))
    pairs = staged(phrase_counts(texts, seed, least, buckets, known), "pairs")
    longer = phrase_counts(texts, seed, least, buckets, known, screen(pairs, F.col("at")))
    phrases = _phrases(pairs.unionByName(staged(longer, "phrases")), words)
    single = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("a"))
    return ranked(staged(single.unionByName(phrases), "counted"), totals, top)


def ranked(counted: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """Scores and ranks of counted phrases (lang, phrase, size, a; with all their parts), given lang and total."""
    found = counted.where("size > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = found.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    left = counted.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    # decimals: the product may pass 64 bits
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: part(i, n)))))
    inside = found.where("size > 2").select("lang", spans.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * COVERED))
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANGES))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS MATERIALIZED (SELECT lang, m, ws[i:i + m - 1] AS ph FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(ws) >= m)),
c AS MATERIALIZED (SELECT lang, m, ph, count(*) AS f FROM o GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
a AS MATERIALIZED (SELECT lang, m, ph, f FROM c WHERE m > 1 AND f >= 30),
x AS MATERIALIZED (SELECT lang, ph, f, k, ph[1:k] AS first, ph[k + 1:m] AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM a)),
s AS MATERIALIZED (SELECT x.lang, x.ph, x.f, x.k, l.f AS l, r.f AS r, (2000000::HUGEINT * x.f) // (l.f + r.f) AS score FROM x JOIN c l ON l.lang = x.lang AND l.ph = x.first JOIN c r ON r.lang = x.lang AND r.ph = x.rest),
b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
i AS MATERIALIZED (SELECT lang, sub, max(f) AS longer FROM (SELECT lang, f, ph[i:i + z - 1] AS sub FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM a))) GROUP BY ALL),
k AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, b.f AS a, b.l, b.r, b.score::BIGINT AS score FROM b LEFT JOIN i ON i.lang = b.lang AND i.sub = b.ph WHERE longer IS NULL OR 100 * longer < 80 * b.f)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) QUALIFY rank <= 2000"""
