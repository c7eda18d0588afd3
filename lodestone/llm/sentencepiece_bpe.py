"""SentencePiece BPE encoding and decoding by vectorised merge rounds, exactly as the sentencepiece library does.

All words of a block are one flat array of symbols. Each round finds the pair of best rank in every word,
merges it (all its occurrences from the left, where that can't change what merging one at a time gives),
and compacts the array; words without a pair left leave it. A word of more than LONG symbols would need as many rounds over
as long an array: its rounds merge one pair each, found in a heap, and touch the neighbours of that pair only.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters of text encoded at once, words kept between blocks, and the longest word kept.
BLOCK, KEPT, LONGEST = 1 << 20, 100_000, 40
#: The longest word, in characters, whose rounds pass over all words together.
LONG = 512
NONE = np.int32(2**31 - 1)


class Codec:
    """A BPE model of the sentencepiece library with byte fallback, in numpy tables."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        self.end = sp.eos_id()
        usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.hidden = {i for i in range(size) if sp.is_control(i)}
        id_of = {self.pieces[i]: i for i in usable}
        # characters that occur in pieces only get symbols after the vocabulary
        for ch in sorted({c for p in id_of for c in p} - set(id_of)):
            id_of[ch] = size + len(id_of)
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in id_of.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.base, self.size = size + len(id_of) + 1, size
        self.decimal = [str(i) for i in range(size)]
        self.plain = {i: self.pieces[i].replace(SPACE, " ") for i in usable}
        score = {i: sp.get_score(i) for i in usable}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        whole = {p: i for p, i in id_of.items() if i < size}
        for p, i in whole.items():
            for cut in range(1, len(p)):
                a, b = id_of.get(p[:cut]), id_of.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = i
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.made = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        self.ranks = np.array([rank[score[i]] for i in self.made.tolist()], np.int32)
        # a merged piece that can at once be part of a pair of the same or a better rank
        rank_of = np.full(self.base, -1, np.int32)
        for i in usable:
            rank_of[i] = rank[score[i]]
        early = np.zeros(len(rank) + 1, bool)
        for part in (keys // self.base, keys % self.base):
            r = rank_of[part]
            early[r[(r >= 0) & (r >= self.ranks)]] = True
        self.early = early
        by_space = not any(SPACE in p[1:] and p.strip(SPACE) and SPACE in p.lstrip(SPACE) for p in whole)
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if by_space else ".+", re.S)

    def _pairs(self, sym: np.ndarray, wid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of the pair that starts at each symbol."""
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        ok = np.flatnonzero((wid[1:] == wid[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0))
        key = sym[ok].astype(np.int64) * self.base + sym[ok + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        rank[ok[hit]], made[ok[hit]] = self.ranks[at[hit]], self.made[at[hit]]
        return rank, made

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols left when no pair remains, the character each starts with, and the number of symbols of each word."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        sym, wid = self.symbol[points], np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(sym))
        rank, made = self._pairs(sym, wid)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], wid[1:] != wid[:-1]]))
            best = np.minimum.reduceat(rank, first)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sym))))
            active = (best < NONE)[of]
            if not active.all():
                done.append((wid[~active], sym[~active], at[~active]))
                sym, wid, at, rank, made, of = (x[active] for x in (sym, wid, at, rank, made, of))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best[of])
            one = self.early[best[of[hit]]]
            lead = np.concatenate([[True], of[hit][1:] != of[hit][:-1]])
            # in a run of overlapping pairs every second one, from the left
            start = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(hit) != 1]) | lead, np.arange(len(hit)), 0))
            hit = hit[np.where(one, lead, (np.arange(len(hit)) - start) % 2 == 0)]
            sym[hit] = made[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            now = np.cumsum(stay)[hit] - 1
            sym, wid, at, rank, made = (x[stay] for x in (sym, wid, at, rank, made))
            # only pairs with a merged symbol are new
            new = np.unique(np.concatenate([now, np.maximum(now - 1, 0)]))
            two = np.stack([new, np.minimum(new + 1, len(sym) - 1)], 1).ravel()
            fresh, piece = self._pairs(sym[two], wid[two])
            lone = new == len(sym) - 1
            rank[new], made[new] = np.where(lone, NONE, fresh[::2]), piece[::2]
        if not done:
            return sym, points, np.zeros(len(words), np.int64)
        wid, sym, at = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at, kind="stable")
        return sym[order], points[at[order]], np.bincount(wid, minlength=len(words))

    @cached_property
    def _pair(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist()), strict=True))

    def merge_long(self, word: str) -> list[int]:
        """The ids of one word, merged pair by pair: the best rank first, from the left."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, n, base, pair = self.symbol[points].tolist(), len(points), self.base, self._pair
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def look(i: int) -> tuple[int, int] | None:
            j = after[i]
            return pair.get(sym[i] * base + sym[j]) if j < n and sym[i] >= 0 and sym[j] >= 0 else None

        for i in range(n - 1):
            if found := look(i):
                heap.append(found[0] << 40 | i)
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 40)
            found = None if gone[i] else look(i)
            if found is None or found[0] != rank:
                continue  # what stood here has been merged since
            j = after[i]
            sym[i], gone[j], after[i] = found[1], 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (found := look(k)):
                    heapq.heappush(heap, found[0] << 40 | k)
        out, i = [], 0
        while i < n:
            out += [sym[i]] if 0 <= sym[i] < self.size else [self.byte_id[x] for x in chr(points[i]).encode("utf-8", "replace")]
            i = after[i]
        return out

    def ids(self, words: list[str]) -> list[list[int]]:
        """The ids of each word: characters that are no piece become their bytes."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            out = self._ids([w for w in words if len(w) <= LONG])
            for i in long:
                out.insert(i, self.merge_long(words[i]))
            return out
        return self._ids(words)

    def _ids(self, words: list[str]) -> list[list[int]]:
        sym, points, sizes = self.merge(words)
        ids, ends = sym.tolist(), np.cumsum(sizes).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        strange = np.flatnonzero((sym < 0) | (sym >= self.size))
        for w in np.unique(np.searchsorted(np.array(ends), strange, side="right")).tolist():
            a, b = ends[w] - len(out[w]), ends[w]
            chars = points[a:b].tolist()
            out[w] = [
                i for s, c in zip(out[w], chars)
                for i in ([s] if 0 <= s < self.size else [self.byte_id[x] for x in chr(c).encode("utf-8", "replace")])
            ]
        return out

    def words(self, text: str) -> list[str]:
        """The text's words after the library's normalisation: spaces become marks, one mark goes first."""
        return self.word.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for word in self.ids(self.words(text)) for i in word] + [self.end]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; at the start of a text one leading mark is dropped."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(held))
                held = bytearray()
            if i not in self.hidden:
                piece = self.pieces[i]
                if first and not out and piece.startswith(SPACE):
                    piece = piece[1:]
                first = False if not out else first
                out.append(piece.replace(SPACE, " "))
        if held:
            out.append(_utf8(held))
        return "".join(out)


def _utf8(data: bytes) -> str:
    return bytes(data).decode("utf-8", "replace")


class TextCodec:
    """Encodes texts through a bounded store of words already merged."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.store, self.older = codec, {}, {}

    def _learn(self, words: set[str]) -> None:
        """Makes sure that the store has all words; what was not used for long goes with an older store."""
        if len(self.store) > KEPT:
            self.store, self.older = {}, self.store
        store, older, codec = self.store, self.older, self.codec
        missing = words - store.keys()
        store.update((w, older[w]) for w in missing & older.keys())
        new = list(missing - older.keys())
        decimal, plain = codec.decimal, codec.plain
        for w, ids in zip(new, codec.ids(new)):
            try:
                text = "".join([plain[i] for i in ids])
            except KeyError:
                text = codec.decode(ids, first=False)
            store[w] = (len(ids), " ".join([decimal[i] for i in ids]), text)

    def run(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, ids in decimal with a space between, decoded text."""
        codec = self.codec
        split = [codec.words(t) for t in texts]
        words = set().union(*split)
        self._learn(words)
        store, end = self.store, str(codec.end)
        for each in split:
            got = [store[w] for w in each]
            ids = [g[1] for g in got]
            ids.append(end)
            decoded = "".join([g[2] for g in got])
            yield sum([g[0] for g in got]) + 1, " ".join(ids), decoded[1:] if got else decoded
        for w in words:
            if len(w) > LONGEST:
                store.pop(w, None)


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def tokenize(docs: DataFrame, model_path: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, the ids in decimal (one space between) with the end id last, and the decoded text.

    The model file is read on the driver and sent with the tasks (half a megabyte, whatever the input). Null
    text counts as empty: the end id alone. Long texts are whole: a block is cut between texts only. Repeated
    rows give a row each; an empty table gives none; other columns are not read. With keep=False the
    two texts come as their SHA-256 instead.
    """
    with open(model_path, "rb") as file:
        model = file.read()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TextCodec(Codec(model))
        last = (lambda s: s) if keep else (lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest())
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = [(n, last(i), last(d)) for block in _blocks(texts) for n, i, d in codec.run(block)]
            cols = list(zip(*rows)) or [[], [], []]
            arrays = [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids", "decoded"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, n_tokens long, ids string, decoded string")


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return tokenize(docs, model_path, keep=False).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
