"""Phrase mining, conversation repair and decontamination against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import collocations, conversation_repair, decontamination

A, Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(A, Z)


# -- phrases


def brute_phrases(rows, least, top):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(b[0] == lang and len(b[1]) > len(p) and 100 * n >= 80 * a and any(b[1][i : i + len(p)] == p for i in range(len(b[1]) - len(p) + 1)) for b, n in found.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


@pytest.fixture
def talk(spark):
    rng = random.Random(5)
    vocabulary = ["New", "york", "of", "the", "É", "é", "x-y", "世界", "\x00", "a", "b", "c d"]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ""]) for _ in range(rng.randrange(80)))
        rows.append((rng.choice(["en", "fr", None]), text + " new york of the a"))
    rows += [("en", None), ("en", ""), ("zz", "only once"), ("en", "a a a a a a a a"), ("en", "a a a a a a a a"), (None, "the of " * 3000)]
    return rows, spark.createDataFrame([(*r, 1, "w", 2) for r in rows], "lang string, text string, n long, word string, h long").repartition(3)


@pytest.mark.parametrize("burst, full, numbered", [(1 << 12, 1 << 20, 1 << 19), (2, 20, 3)])
def test_phrases_equal_brute_force(talk, monkeypatch, burst, full, numbered):
    rows, docs = talk
    for name, value in (("FULL", full), ("NUMBERED", numbered)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.HatTrie.__init__, "__defaults__", (burst,))
    got = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(docs, least=4, top=25).collect()]
    assert sorted(got) == brute_phrases(rows, 4, 25)


def test_phrases_of_nothing(talk):
    assert collocations.mine(talk[1].where("false")).count() == 0


def test_words_of_one_hash_get_another_seed(talk, monkeypatch):
    rows, docs = talk
    real = collocations.word_hash
    monkeypatch.setattr(collocations, "word_hash", lambda lang, word, seed: 7 if not seed and word in (b"new", b"york") else real(lang, word, seed))
    got = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(docs, least=4, top=25).collect()]
    assert sorted(got) == brute_phrases(rows, 4, 25)


def test_trie_spills_whole_subtrees():
    trie, rng, want = collocations.HatTrie(burst=3), random.Random(1), Counter()
    keys = [bytes([0, 0, 0, rng.randrange(4)] * 1 + [0, 0, 0, rng.randrange(3)] + [0, 0, 0, rng.randrange(6)]) for _ in range(400)]
    got = Counter()
    for at in range(0, 400, 50):
        trie.add(keys[at : at + 50])
        k, n = trie.spill(10)
        assert trie.size <= 10 and not {x[:4] for x in k} & set(trie.root)
        got.update(dict(zip(k, n, strict=True)))
    k, n = trie.spill(0)
    got.update(dict(zip(k, n, strict=True)))
    want.update(keys)
    assert got == want


def test_rows_of_one_mixed_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(collocations, "mixed", lambda c: c[0] // np.uint64(4))
    cols = [np.array(v, np.uint64) for v in ([1, 2, 1, 9, 2], [5, 5, 5, 5, 6])]
    _, found, n = collocations.summed(cols, np.array([1, 10, 100, 1000, 10000]))
    assert {(int(a), int(b)): int(c) for a, b, c in zip(*found, n, strict=True)} == {(1, 5): 101, (2, 5): 10, (9, 5): 1000, (2, 6): 10000}


def test_scores_pass_64_bits(spark):
    big = 9 * 10**18
    rows = [("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, size int, a long")
    row = collocations.ranked(counted, spark.createDataFrame([("en", big)], "lang string, total long")).first()
    assert row.score == 2000000 * (big - 2) // (2 * big - 1)


# -- conversations


def brute_repair(rows):
    """Dijkstra over (rows done, state) by cost and letters; rows are (initial, fault)."""
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    wanted = {"": "u", "s": "u", "a": "u", "u": "a"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in ("", "a"):
            return cost, audit, list(out)
        if (i, q) in done:
            continue
        done.add((i, q))
        full = {"u": "user", "a": "assistant"}
        heapq.heappush(heap, (cost + 3, audit + "I", i, wanted[q], (*out, f"{full[wanted[q]]}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (q, role[:1]) in go:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, go[q, role[:1]], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, wanted[q], (*out, f"{full[wanted[q]]}:{text}")))


def brute_conversation(conv, rows):
    rows, kept = list(rows), []
    for turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, marked = set(), []
    for _, role, text in kept:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, out = brute_repair(marked)
    turns = [t for t, _, _ in kept if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture
def conversations():
    rng, rows = random.Random(3), []
    for conv in [None, *range(70)]:
        for turn in range(rng.randrange(1, 14)):
            turn = None if rng.random() < 0.05 else turn + rng.randrange(2)
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn, role, rng.choice(["Yes.", "Why?", "so it goes", " \t", "", None, "é" * 9 + "! \n", f"{rng.random()}."])))
    rows += [(900, t, "user", "Go.") for t in range(300)] + [(901, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(400)] + [(902, 1, "user", "x" * 200_000 + ".")]
    rows += [(903, 5, "user", "again.")] * 4 + [(904, -(1 << 62), "system", "a."), (904, 1 << 62, "user", "b.")]
    return rows


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_repairs_equal_brute_force(spark, conversations, partitions):
    extra = "conv_id long, turn long, role string, text string, kind string, n string, digest string, symbols int"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # conversations are cut where ranges end
    try:
        got = conversation_repair.repaired(spark.createDataFrame([(*r, "k", "n", "d", 1) for r in conversations], extra)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {conv: brute_conversation(conv, [r[1:] for r in conversations if r[0] == conv]) for conv in {r[0] for r in conversations}}
    assert len(got) == len(want)
    for row in got:
        assert tuple(row) == want[row.conv_id]


def test_long_runs_of_turns():
    for symbols in ([(3, 5000)], [(3, 1500), (6, 3), (7, 2100), (9, 1300)], [(0, 1), (5, 1025)]):
        rows = [({0: "s", 1: "u", 2: "a", 3: "t"}[s // 3], "", {0: "", 1: "truncated", 2: "blank"}[s % 3]) for s, n in symbols for _ in range(n)]
        assert conversation_repair.repair(symbols) == brute_repair(rows)[:2]


def test_all_short_runs():
    for size in range(4):
        for symbols in itertools.product(range(12), repeat=size):
            rows = [({0: "s", 1: "u", 2: "a", 3: "t"}[s // 3], "", {0: "", 1: "truncated", 2: "blank"}[s % 3]) for s in symbols]
            runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
            assert conversation_repair.repair(runs) == brute_repair(rows)[:2]


def test_conversations_of_text_ids_and_none(spark):
    rows = spark.createDataFrame([("x", 1, "user", "Hi.")], "conv_id string, turn long, role string, text string")
    assert tuple(conversation_repair.repaired(rows).first()) == brute_conversation("x", [(1, "user", "Hi.")])
    assert conversation_repair.repaired(rows.where("false")).count() == 0


# -- test strings in documents


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_leaks(text, items):
    ws, hit, named = cut(text), set(), set()
    for item, other in items:
        b = cut(other)
        m = min(10, len(b))
        windows = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if b else set()
        for i in range(len(ws) - m + 1):
            if tuple(ws[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                named |= {str(item)} - {"None"}
    return len(ws), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("part", [1 << 22, 400])
def test_leaks_equal_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 7)
    rng = random.Random(8)
    make = lambda n: " ".join(rng.choice(["a", "B", "c", "dé", "世", "7"]) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([10, 10, 11, 40, 25, 3, 1, 9, 60])]
    items += [(2, items[2][1]), (77, items[3][1]), (None, make(12)), (5, None), (6, " !? "), (100, "zz top zz top"), (101, make(1).upper() + "x")]
    docs = [(i, make(rng.randrange(200))) for i in range(25)] + [(30, None), (31, ""), (32, "-- ?"), (None, items[3][1]), (33, items[9][1] + " " + items[9][1]), (33, items[9][1])]
    docs += [(40 + i, f"x{i}, {other}. Y {items[(i * 5) % 9][1]}") for i, (_, other) in enumerate(items)] + [(90, "zz top " * 9), (91, (items[8][1] + " ") * 300)]
    frame = spark.createDataFrame([(*d, 5, "i", 1) for d in docs], "doc_id long, text string, n_words int, items string, spans long").repartition(3)
    bench = spark.createDataFrame([(*b, "t") for b in items], "item_id long, text string, item string")
    got = decontamination.report(decontamination.occurrences(frame, bench, part)).collect()
    assert sorted(map(str, [(r.doc_id, *list(r)[1:]) for r in got])) == sorted(map(str, [(i, *brute_leaks(t, items)) for i, t in docs]))


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontamination.report(decontamination.occurrences(docs, bench)).collect()] == [("a", 2, 0, 0)]
    assert decontamination.occurrences(docs.where("false"), bench).count() == 0
