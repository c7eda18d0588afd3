"""LM scoring by a hierarchical Pitman-Yor model (Teh, 2006): a restaurant per previous word, all with one parent.

A customer of restaurant u is an occurrence of a word after u; its tables are customers of the parent, whose own
base is uniform over the known words and one for all others. A pair that occurs once has one table. A Gibbs
sweep takes the tables of a dish away from its restaurant and from the parent and seats its customers anew, one
after the other, given the tables that all other dishes have from the sweep before; each table that opens counts
for the next customer. The root is swept likewise. The predictive probability of a token is averaged over the sweeps
after a burn-in. Restaurants are rows of tables: a sweep joins and sums them, so none has to fit into a task.

Texts are read and cut into words once: a chunk of texts keeps its tokens and asks for the numbers of its distinct words,
which are given by frequency. Pairs of numbers are then counted and looked up in bulk: a chunk sends each bucket of pairs
its distinct pairs once, packed, and gets the bucket's values back in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from lodestone.llm.common import attach, discard, shuffled, staged

#: Discount and strength of the restaurants and of their parent, sweeps that are dropped and sweeps that count.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.8, 1.0, 0.6, 1.0
BURN_IN, SAMPLES = 1, 2
#: Customers seated one at a time; beyond, steps of a fiftieth of those seated share one probability.
SINGLY = 256
#: Bytes of text of a chunk; there are as many buckets of words and of pairs as such chunks.
CHUNK = 8 << 20
#: Words of each bucket whose pairs are dealt to all buckets.
SPREAD = 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array of 8-byte values, equal places of all values together."""
    return pa.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind: type = np.int64) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data, size * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, size).T).reshape(-1).view(kind)


def slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """bucket, start and end of the runs of a sorted array."""
    have, start = np.unique(bucket, return_index=True)
    return list(zip(have.tolist(), start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True))


def by_bucket(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The stable order of buckets; small numbers are sorted in a pass."""
    return np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")


def by_pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An order by u, then w, as one key if that fits into 63 bits."""
    base = int(w.max(initial=0)) + 1
    return np.argsort(u * base + w) if int(u.max(initial=0)) < (1 << 63) // base - 1 else np.lexsort((w, u))


def encoded(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of a chunk of texts: one with its documents and tokens (bucket -1), and one for each bucket of words.

    Tokens are places in the chunk's list of distinct words, which is in the order of their buckets; words are their hashes
    (the end is 0), n says how often each is in the training texts.
    """
    doc_id = dict(docs.dtypes)["doc_id"]
    schema = f"chunk long, bucket int, size int, words binary, n binary, doc_ids array<{doc_id}>, held_out array<boolean>, sizes array<long>"

    def rows(chunk: int, doc_ids: pa.Array, held: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        # these lower A-Z and split at \x20 and \x09-\x0D, as bytes
        words = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.compute.fill_null(texts, "")))
        there = pa.compute.binary_length(words.flatten()).to_numpy() > 0
        sizes = np.diff(np.concatenate([[0], np.cumsum(there)])[words.offsets.to_numpy()]) + 1
        coded = words.flatten().filter(pa.array(there)).dictionary_encode()
        number = [b"", *coded.dictionary.cast(pa.binary()).to_pylist()]
        tokens = np.zeros(sizes.sum(), np.int64)
        end = np.zeros(len(tokens), bool)
        end[np.cumsum(sizes) - 1] = True
        tokens[~end] = coded.indices.to_numpy() + 1
        hashes = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in number], np.uint64)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = by_bucket(bucket, buckets)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n = np.bincount(tokens, np.repeat(~held.to_numpy(zero_copy_only=False), sizes), len(number)).astype(np.int64)[order]
        hashes = hashes[order]
        parts = slices(bucket[order])
        one = len(parts)
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([chunk] * (one + 1), pa.int64()), "bucket": pa.array([-1, *[b for b, _, _ in parts]], pa.int32()),
            "size": pa.array([len(tokens), *[end - start for _, start, end in parts]], pa.int32()),
            "words": pa.array([packed(place[tokens]), *[packed(hashes[start:end]) for _, start, end in parts]], pa.binary()),
            "n": pa.array([None, *[packed(n[start:end]) for _, start, end in parts]], pa.binary()),
            "doc_ids": pa.array([doc_ids.to_pylist(), *[None] * one], pa.list_(doc_ids.type)),
            "held_out": pa.array([held.to_pylist(), *[None] * one], pa.list_(pa.bool_())),
            "sizes": pa.array([sizes.tolist(), *[None] * one], pa.list_(pa.int64())),
        })

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, kept, length = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            start = 0
            for at, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_pylist()):
                length += n
                if length >= CHUNK:
                    yield rows(chunk, *_joined([*kept, batch.slice(start, at + 1 - start)]))
                    chunk, kept, length, start = chunk + 1, [], 0, at + 1
            if start < batch.num_rows:
                kept.append(batch.slice(start))
        if kept:
            yield rows(chunk, *_joined(kept))

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(each, schema)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([b.column(c) for b in batches]) for c in ("doc_id", "held_out", "text")]


def numbered(words: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket and the numbers of the asked words: by frequency within a bucket, the buckets taking turns; -1 for words that no training text has."""

    def each(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_pylist()
        word, which = np.unique(_all(table, "words", sizes), return_inverse=True)
        n = np.bincount(which, _all(table, "n", sizes), len(word))
        rank = np.empty(len(word), np.int64)
        rank[np.lexsort((word, -n))] = np.arange(len(word))
        number = np.where(n > 0, rank * buckets + table["bucket"][0].as_py(), -1)[which]
        numbers = [packed(x) for x in np.split(number, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "size": table["size"], "numbers": pa.array(numbers, pa.binary())})

    return words.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(each, "chunk long, bucket int, size int, numbers binary")


def _all(table: pa.Table, name: str, sizes: list[int], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[unpacked(d, n, kind) for d, n in zip(table[name].to_pylist(), sizes, strict=True)]])


def bucket_of(u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """A context's pairs share its bucket, but those of the SPREAD most frequent words of each bucket are dealt by both words."""
    mixed = u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
    return np.where(u // buckets < SPREAD, mixed, u % buckets)


class Pairs:
    """The distinct pairs of a chunk's tokens, which are places in the sorted numbers: their words, and those of known words by bucket, u and w."""

    def __init__(self, tokens: np.ndarray, numbers: np.ndarray, buckets: int) -> None:
        # the last token is an end, which is also what comes before the first
        # as few arrays of all tokens at once as can be: a worker keeps the most that it ever had
        keys = np.empty(len(tokens), np.int64)
        keys[:1], keys[1:] = tokens[-1:], tokens[:-1]
        keys *= len(numbers)
        keys += tokens
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        self.u, self.w = np.divmod(keys[new], len(numbers))
        del keys
        self.pair = np.empty(len(order), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        u, w = numbers[self.u], numbers[self.w]
        known = np.flatnonzero((u >= 0) & (w >= 0))
        bucket = bucket_of(u[known], w[known], buckets)
        order = by_bucket(bucket, buckets)
        self.known, self.bucket = known[order], bucket[order]


ASKED = "chunk long, kind int, bucket int, size int, n_words int, a binary, b binary, n binary"


def requests(texts: DataFrame, numbers: DataFrame, buckets: int) -> DataFrame:
    """Rows of a chunk: its tokens as places in its sorted numbers (kind 0: a tokens, b numbers), the numbers by bucket (kind 1, in a), and

    the distinct pairs by bucket (kind 2: a is u as differences, b is w, n says how often they are in training texts).
    """
    schema = ASKED + "".join(f", {f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name in ("doc_ids", "held_out", "sizes"))

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        number, place = np.unique(_all(right, "numbers", right["size"].to_pylist()), return_inverse=True)
        tokens = place[unpacked(left["words"][0].as_py(), left["size"][0].as_py())]
        p = Pairs(tokens, number, buckets)
        train = np.repeat(~np.array(left["held_out"][0].as_py(), bool), left["sizes"][0].as_py())
        n = np.bincount(p.pair, train, len(p.u)).astype(np.int64)[p.known]
        u, w = number[p.u[p.known]], number[p.w[p.known]]
        chunk = left["chunk"][0].as_py()
        found = [(chunk, 0, -1, len(tokens), len(number), packed(tokens), packed(number), None)]
        bucket = number[number >= 0] % buckets
        order = by_bucket(bucket, buckets)
        words = number[number >= 0][order]
        found += [(chunk, 1, b, end - start, None, packed(words[start:end]), None, None) for b, start, end in slices(bucket[order])]
        found += [(chunk, 2, b, end - start, None, packed(np.diff(u[start:end], prepend=0)), packed(w[start:end]), packed(n[start:end])) for b, start, end in slices(p.bucket)]
        names = ("chunk", "kind", "bucket", "size", "n_words", "a", "b", "n")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = {name: pa.array(values, kind) for name, kind, values in zip(names, kinds, zip(*found, strict=True), strict=True)}
        return pa.table(columns | {c: pa.array([left[c][0].as_py(), *[None] * (len(found) - 1)], left[c].type) for c in ("doc_ids", "held_out", "sizes")})

    return _by_chunk(texts, buckets).cogroup(_by_chunk(numbers, buckets)).applyInArrow(each, schema)


def _by_chunk(rows: DataFrame, buckets: int) -> GroupedData:
    """Rows of a chunk together; there are about as many chunks as buckets."""
    return rows.repartition(buckets, "chunk").groupBy("chunk")


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a bucket's requests in order, their counts, and which of them each requested pair is."""
    sizes = table["size"].to_pylist()
    u = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(unpacked(d, n)) for d, n in zip(table["a"].to_pylist(), sizes, strict=True)]])
    w = _all(table, "b", sizes)
    order = by_pair(u, w)
    u, w = u[order], w[order]
    new = np.concatenate([np.ones(min(len(u), 1), bool), (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
    which = np.empty(len(u), np.int64)
    which[order] = np.cumsum(new) - 1
    return u[new], w[new], np.bincount(which, _all(table, "n", sizes), int(new.sum())).astype(np.int64), which


COUNTED = "bucket int, kind int, u long, w long, c long, types long, rows long"


def counted(asked: DataFrame, buckets: int) -> DataFrame:
    """Sums of a bucket's training pairs: those of each context (kind 0, in u) and of each word (kind 1, in w), and the pairs that repeat (kind 2).

    c counts tokens, types distinct pairs, and rows those of them that repeat.
    """

    def each(table: pa.Table) -> pa.Table:
        u, w, c, _ = merged(table)
        u, w, c = u[c > 0], w[c > 0], c[c > 0]
        more = (c > 1).astype(np.int64)
        parts = []
        for kind, of in ((0, u), (1, w)):
            key, place = np.unique(of, return_inverse=True)
            sums = [np.bincount(place, v, len(key)).astype(np.int64) for v in (c, np.ones(len(c)), more)]
            none = np.zeros(len(key), np.int64)
            parts.append((np.full(len(key), kind), *((key, none) if kind == 0 else (none, key)), *sums))
        often = np.flatnonzero(more)
        one = np.ones(len(often), np.int64)
        parts.append((np.full(len(often), 2), u[often], w[often], c[often], one, one))
        kind, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = pa.array(np.full(len(kind), table["bucket"][0].as_py()), pa.int32())
        return pa.table({"bucket": bucket, "kind": pa.array(kind, pa.int32()), **dict(zip(("u", "w", "c", "types", "rows"), values, strict=True))})

    return asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(each, COUNTED)


def _answers(asked: pa.Table, kind: int, values: np.ndarray) -> pa.Table:
    """Packed values of each row of requests; values has a row per value and a column per requested word or pair."""
    sizes = asked["size"].to_pylist()
    parts = np.split(values, np.cumsum(sizes)[:-1], axis=1) if sizes else []
    found = pa.array([packed(x.reshape(-1)) for x in parts], pa.binary())
    return pa.table({"chunk": asked["chunk"], "kind": pa.array([kind] * len(sizes), pa.int32()), "bucket": asked["bucket"], "size": asked["size"], "a": found})


ANSWERS = "chunk long, kind int, bucket int, size int, a binary"


def answered(asked: DataFrame, often: DataFrame, buckets: int) -> DataFrame:
    """Customers less discounts of the requested pairs; often has that of pairs that occur more than once."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        *_, c, which = merged(left)
        x = np.where(c == 1, 1 - DISCOUNT, 0.0)
        order = by_pair(right["u"].to_numpy(), right["w"].to_numpy())
        x[c > 1] = right["x"].to_numpy()[order]
        return _answers(left, 2, x[which][None].astype(np.float32).astype(np.float64))

    both = (x.repartition(buckets, "bucket").groupBy("bucket") for x in (asked, often))
    return next(both).cogroup(next(both)).applyInArrow(each, ANSWERS)


def described(asked: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """The values of VALUES for the requested words, one after the other."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("w")
        at = np.searchsorted(right["w"].to_numpy(), _all(left, "a", left["size"].to_pylist()))
        values = np.array([right[c].cast(pa.float64()).to_numpy() for c in VALUES])
        return _answers(left, 1, values[:, at])

    both = (x.repartition(buckets, "bucket").groupBy("bucket") for x in (asked, words))
    return next(both).cogroup(next(both)).applyInArrow(each, ANSWERS)


#: Of a word: tokens, tokens after it, and for each sample the tables of its restaurant and its probability in the parent.
VALUES = ["cw", "cu", *[f"tu{i}" for i in range(SAMPLES)], *[f"p{i}" for i in range(SAMPLES)]]


def seat(customers: np.ndarray, room: np.ndarray, guests: np.ndarray, all_guests: np.ndarray, discount: float, rng: np.random.Generator, joins: int = 1) -> np.ndarray:
    """Tables after seating so many customers of one dish in a restaurant from which its own tables were taken away.

    With t tables open, a new one weighs (room + discount t) (guests + t) / (all_guests + t): the restaurant's strength and
    discounts times the parent's probability of the dish, whose guests the tables are (joins is 0 for a parent without guests).
    """
    order = np.argsort(-customers, kind="stable")
    left, room, guests, all_guests = (x[order] for x in (customers, room, guests, all_guests))
    table = np.ones(len(left))
    seated, n = 1, int(np.count_nonzero(left > 1))
    while n:
        step = 1 if seated < SINGLY else seated // 50 + 1
        t = table[:n]
        weight = (room[:n] + discount * t) * (guests[:n] + joins * t) / (all_guests[:n] + joins * t)
        new = weight / (weight + np.maximum(seated - discount * t, 1e-9))
        if step == 1:
            table[:n] += rng.random(n) < new
        else:
            table[:n] += rng.binomial(np.minimum(step, left[:n].astype(np.int64) - seated), new)
        seated += step
        n = int(np.searchsorted(-left[:n], -seated, side="left"))
    back = np.empty(len(left))
    back[order] = table
    return back


def reseat(rows: DataFrame, customers: str, room: Column, guests: Column, all_guests: Column, discount: float, sweep: int, joins: int = 1) -> DataFrame:
    """Rows with the tables t of each dish after a sweep; the draw is fixed by the row's key and the sweep."""
    schema = rows.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = [batch.column(c).to_numpy().view(np.uint64) for c in ("u", "w") if c in schema.names]
                rng = np.random.default_rng([sweep, int(np.bitwise_xor.reduce(np.concatenate(keys)))])
                args = [batch.column(c).to_numpy() for c in ("_room", "_guests", "_all")]
                t = seat(batch.column(customers).to_numpy().astype(np.float64), *args, discount, rng, joins)
                yield pa.RecordBatch.from_arrays([pa.array(t) if c == "t" else batch.column(c) for c in schema.names], schema.names)

    given = {"_room": room, "_guests": guests, "_all": all_guests}
    return rows.withColumns({k: v.cast("double") for k, v in given.items()}).mapInArrow(each, schema)


def model(sums: DataFrame) -> tuple[DataFrame, DataFrame, list[float], int, int]:
    """Of repeated pairs the mean of customers less discounts (bucket, u, w, x); of words what VALUES says (w, ...); the probability

    of an unknown word in each sample, the number of known words and that of tokens. sums is what counted() gives.
    """
    totals = [F.sum("c").alias("c"), F.sum("types").cast("double").alias("types"), F.sum("rows").alias("rows")]
    contexts = staged(sums.where("kind = 0").groupBy("u").agg(*totals).withColumnRenamed("c", "cu"), "contexts")
    parents = staged(sums.where("kind = 1").groupBy("w").agg(*totals).withColumnRenamed("c", "cw"), "parents")
    known, tokens = parents.agg(F.count(F.lit(1)), F.coalesce(F.sum("cw"), F.lit(0))).first()
    start = F.greatest(F.lit(1.0), F.floor(F.pow("c", F.lit(0.5)))).cast("double")
    seated = staged(sums.where("kind = 2").select("bucket", "u", "w", "c", start.alias("t"), F.lit(0.0).alias("ts")), "seated")
    discard(sums)
    root = staged(parents.select("w", "types", "rows", "types", F.lit(1.0).alias("t")).toDF("w", "types", "rows", "guests", "t"), "root")
    root_tables, tables, samples = float(known), None, []
    more = F.sum(F.col("t") - 1).alias("more")
    each = 1.0 / (known + 1)
    for sweep in range(BURN_IN + SAMPLES):
        guests = root.join(shuffled(seated.groupBy("w").agg(more)), "w", "left")
        guests = guests.select("w", "types", "rows", (F.col("types") + F.coalesce("more", F.lit(0.0))).alias("guests"), "t")
        total = guests.agg(F.sum("guests")).first()[0] or 0.0
        old, room = root, ROOT_STRENGTH + ROOT_DISCOUNT * (F.lit(root_tables) - F.col("t"))
        root = staged(reseat(guests, "guests", room, F.lit(each), F.lit(1.0), ROOT_DISCOUNT, sweep, joins=0), "root")
        discard(old)
        root_tables = root.agg(F.sum("t")).first()[0] or 0.0
        spread = (ROOT_STRENGTH + ROOT_DISCOUNT * root_tables) * each
        share = F.col("guests") - ROOT_DISCOUNT * F.col("t") + F.lit(spread)
        shares = root.where("rows > 0").select("w", F.col("rows").alias("size"), "guests", F.col("t").alias("root_t"))
        met = staged(attach(seated, shares, ["w"], "size").drop("size"), "met")
        discard(seated)
        tables = tables or staged(contexts.join(shuffled(met.groupBy("u").agg(more)), "u", "left").select("u", "cu", "types", "rows", (F.col("types") + F.coalesce("more", F.lit(0.0))).alias("tu")), "tables")
        guest = attach(met, tables.where("rows > 0").select("u", "tu", F.col("rows").alias("size")), ["u"], "size").drop("size")
        room = STRENGTH + DISCOUNT * (F.col("tu") - F.col("t"))
        others = F.col("guests") - F.col("t")
        left = others - ROOT_DISCOUNT * F.least("root_t", others) + F.lit(spread)
        new = reseat(guest, "c", room, left, ROOT_STRENGTH + total - F.col("t"), DISCOUNT, sweep)
        new = new.withColumn("ts", F.col("ts") + (F.col("t") if sweep >= BURN_IN else 0.0))
        seated = staged(new.select("bucket", "u", "w", "c", "t", "ts"), "seated")
        discard(met)
        old = tables
        tables = contexts.join(shuffled(seated.groupBy("u").agg(more)), "u", "left").select("u", "cu", "types", "rows", (F.col("types") + F.coalesce("more", F.lit(0.0))).alias("tu"))
        tables = staged(tables, "tables")
        discard(old)
        if sweep >= BURN_IN:
            i = len(samples)
            own = staged(root.select("w", (share / (ROOT_STRENGTH + total)).alias(f"p{i}")), "shares")
            samples.append((own, staged(tables.select(F.col("u").alias("w"), F.col("tu").alias(f"tu{i}")), "sampled"), spread / (ROOT_STRENGTH + total)))
    x = seated.select("bucket", "u", "w", (F.col("c") - DISCOUNT * F.col("ts") / SAMPLES).alias("x"))
    words = parents.select("w", "cw").join(shuffled(contexts.select(F.col("u").alias("w"), "cu")), "w", "left")
    for p, t, _ in samples:
        words = words.join(shuffled(p), "w").join(shuffled(t), "w", "left")
    return x, words.fillna(0), [s[2] for s in samples], known, tokens


def score(docs: DataFrame) -> DataFrame:
    """The model's and the base's log10 probability of every document.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (a token's). Learns from rows whose crc32(doc_id as
    text) mod 5 is not 1 (a null doc_id trains). A text's tokens are its words, A-Z lower-cased, and one end, so
    null and empty texts are an end. Repeated rows count as often as they come and are scored each. Without any
    training token, every token has the base's probability. Texts are whole; an empty table gives no rows.
    """
    buckets = (docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // CHUNK + 1
    chunks = staged(encoded(docs, buckets), "chunks")
    numbers = staged(numbered(chunks.where("bucket >= 0").select("chunk", "bucket", "size", "words", "n"), buckets), "numbers")
    asked = staged(requests(chunks.where("bucket < 0").drop("n"), numbers, buckets), "asked")
    discard(chunks)
    discard(numbers)
    of_pairs, of_words = (asked.where(F.col("kind") == kind).select("chunk", "bucket", "size", "a", "b", "n") for kind in (2, 1))
    x, words, unknown, known, total = model(staged(counted(of_pairs, buckets), "sums"))
    unknown = unknown if total else [1.0 / (known + 1)] * SAMPLES
    words = words.withColumn("bucket", F.pmod("w", F.lit(buckets)).cast("int"))
    answers = staged(answered(of_pairs, x, buckets).unionByName(described(of_words, words, buckets)), "answers")
    doc_id = dict(docs.dtypes)["doc_id"]

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        number = unpacked(left["b"][0].as_py(), left["n_words"][0].as_py())
        tokens = unpacked(left["a"][0].as_py(), left["size"][0].as_py()).astype(np.int32)
        p = Pairs(tokens, number, buckets)
        right = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        met = np.flatnonzero(number >= 0)
        met = met[by_bucket(number[met] % buckets, buckets)]
        k = len(VALUES)
        of_word = np.zeros((k, len(number)))
        of_word[2 + SAMPLES :] = np.array(unknown)[:, None]
        own = np.zeros(len(p.u))
        at = {1: 0, 2: 0}
        for kind, n, a in zip(right["kind"].to_pylist(), right["size"].to_pylist(), right["a"], strict=True):
            part, at[kind] = slice(at[kind], at[kind] + n), at[kind] + n
            if kind == 1:
                of_word[:, met[part]] = unpacked(a.as_py(), k * n, np.float64).reshape(k, n)
            else:
                own[p.known[part]] = unpacked(a.as_py(), n, np.float64)
        assert at == {1: len(met), 2: len(p.known)}
        cw, cu, tu, p1 = of_word[0], of_word[1], of_word[2 : 2 + SAMPLES], of_word[2 + SAMPLES :]
        parent = sum((STRENGTH + DISCOUNT * tu[i][p.u]) * p1[i][p.w] for i in range(SAMPLES)) / SAMPLES
        lp = np.log10((own + parent) / (STRENGTH + cu[p.u]))
        lb = np.log10((cw + 0.5) / (total + 0.5 * (known + 1)))
        sizes = np.array(left["sizes"][0].as_py(), np.int64)
        first = np.cumsum(sizes) - sizes
        values = {
            "n_tokens": sizes, "n_known": np.add.reduceat((cw > 0)[tokens].astype(np.int64), first), "train_tokens": np.full(len(first), total),
            "base_score": np.add.reduceat(lb[tokens], first), "score": np.add.reduceat(lp[p.pair], first),
        }
        values["perplexity"] = 10.0 ** (-values["score"] / sizes)
        return pa.table({"doc_id": left["doc_ids"].combine_chunks().flatten(), "held_out": left["held_out"].combine_chunks().flatten(), **values})

    schema = f"doc_id {doc_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    texts = asked.where("kind = 0").select("chunk", "size", "n_words", "a", "b", "doc_ids", "held_out", "sizes")
    return _by_chunk(texts, buckets).cogroup(_by_chunk(answers, buckets)).applyInArrow(each, schema)
