"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, html_extract, license_scan, mixing, pitman_yor, queries, sentencepiece_bpe, simhash, suffix_dedup, topk_search, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor " * 3000
ROWS = [
    (1, "Some words here, and more of them", "a"), (2, "some WORDS here, and more of them", "b"), (3, None, None), (4, "", "a"), (5, LONG, "a"),
    (5, LONG, "a"), (6, "É é ÉA", "c"), (7, "É é Éa", "c"), (None, "no id", "b"), (8, "   \n\t ", None), (9, "x" * 500, "b"), (10, "Licensed under CC BY-NC 4.0.\nx", "b"),
]


@pytest.fixture
def docs(spark):
    rows = [(*r, 0, "k", "r") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, digest string, row string").repartition(3)


@pytest.fixture
def empty(docs):
    return docs.where("false")


def fold(text):
    return (text or "").encode().lower()


def test_fuse_filter_has_no_false_negatives():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    blob = exact_dedup.build_filter(keys[::2])
    assert exact_dedup.may_contain(blob, keys[::2]).all()
    assert exact_dedup.may_contain(blob, keys[1::2]).mean() < 0.01


def test_exact_groups(docs, empty):
    got = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(fold(t), []).append(i)
    for row in exact_dedup.exact_groups(docs).collect():
        own = next(ids for t, ids in groups.items() if hashlib.sha256(t).hexdigest() == row.text_sha256 and row.doc_id in ids)
        assert row.group_size == len(own) and row.keep_id == max((i for i in own if i is not None), default=None)
        assert row.kept == (row.doc_id == row.keep_id)
    assert len(got) == len(ROWS) and exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.deduplicate(docs).count() == len(groups)


def test_tokens_equal_the_library(docs, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for row in sentencepiece_bpe.tokenize(docs, MODEL).collect():
        texts = [t or "" for i, t, _ in ROWS if i == row.doc_id]
        ids = sp.encode(texts[0]) + [sp.eos_id()]
        assert row.ids == " ".join(map(str, ids)) and row.n_tokens == len(ids) and row.decoded == sp.decode(ids)
    assert sentencepiece_bpe.tokenize(empty, MODEL).count() == 0


def test_odd_strings_equal_the_library():
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_bpe.Codec(open(MODEL, "rb").read())
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list("ab the  \n▁é世🙂1 e"), rng.integers(0, 50)))
        ids = sp.encode(text) + [sp.eos_id()]
        assert codec.encode(text) == ids and codec.decode(ids) == sp.decode(ids)


def test_words_without_a_space_equal_the_library(monkeypatch):
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_bpe.Codec(open(MODEL, "rb").read())
    rng = np.random.default_rng(6)
    texts = [" " * 20_000, "a" * 5001, "".join(rng.choice(list("abcdefghijklmnoprstuvwxyz"), 40_000)), "世界é🙂" * 2000, "the " * 900 + " " * 700 + "x" * 600 + " y", "ab" * 300 + "\n" * 700 + "\ud800"[:0]]
    for text in texts:
        assert codec.encode(text) == [*sp.encode(text), sp.eos_id()]
    monkeypatch.setattr(sentencepiece_bpe, "LONG", 3)
    for _ in range(300):
        text = "".join(rng.choice(list("ab the  \n▁é世🙂1 e"), rng.integers(0, 60)))
        assert codec.encode(text) == [*sp.encode(text), sp.eos_id()]


def test_mix_meets_targets(docs, empty):
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == len(ROWS) and (rows["taken"] <= 2 * rows["size"]).all()
    per = rows.groupby(rows["source"].fillna("~"), dropna=False).agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert ((per["taken"] - per["target"]).abs() <= 1).all()
    assert abs(per["target"].sum() - 1.5 * per["source_size"].sum()) < 1e-6
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def removed_by_brute_force(rows, size):
    """doc_id, bytes, removed bytes and digest of what is left, by a table of all windows."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + size] for t in data for i in range(len(t) - size + 1))
    want = []
    for (i, _), t in zip(rows, data):
        hit = np.zeros(len(t) + 1, int)
        for j in range(len(t) - size + 1):
            if seen[t[j : j + size]] > 1:
                hit[j] += 1
                hit[j + size] -= 1
        on = np.cumsum(hit)[: len(t)] > 0
        want.append((str(i), len(t), int(on.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~on].tobytes()).hexdigest()))
    return sorted(want)


def removed(docs, size, gram):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs, size, gram)).collect())


def test_removed_bytes_equal_brute_force(docs, empty):
    assert removed(docs, 40, 16) == removed_by_brute_force([(i, t) for i, t, _ in ROWS], 40)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_removed_bytes_of_crowded_anchors_and_many_shards(spark, monkeypatch):
    """Passages shared by many different texts, with groups, shards and pieces of text that are cut small."""
    for name, value in (("CROWD", 3), ("SHARD", 700), ("PIECE", 1 << 11)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passages = [word(n) for n in (30, 50, 64, 65, 90, 150)]
    rows = [(i, word(int(rng.integers(0, 120))) + passages[i % 6] + word(int(rng.integers(0, 120)))) for i in range(90)]
    rows += [(100 + i, passages[5] * 3 + word(5)) for i in range(3)] + [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1]), (201, "é" * 2000), (202, word(6000))]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 64, 16) == removed_by_brute_force(rows, 64)


def test_query_removes_passages_of_over_fifty_words_from_400_bytes_on(spark, tmp_path):
    """By the contract a passage of 51 words or more stays below 400 bytes, and n_bytes is the length of the whole text."""
    rng = np.random.default_rng(11)
    words = lambda size: " ".join("".join(rng.choice(list("abcdefgh"), int(k))) for k in rng.integers(3, 9, size))[:size]
    short, long, own = words(399), words(400), words(420)
    assert len(short.split()) > 50
    rows = [(i, f"{words(300)}{2 * i}{p}{2 * i + 1}{words(300)}") for i, p in enumerate((short, short, long, long, f"{own}-{own}", "é"))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op4_suffix_dedup(spark, str(tmp_path)).collect())
    assert [(r.n_removed, r.n_spans) for r in got] == [(0, 0), (0, 0), (400, 1), (400, 1), (840, 2), (0, 0)]
    assert [(str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got] == removed_by_brute_force(rows, 400)


def test_merged_transforms_give_common_prefixes_and_repeated_intervals():
    rng = np.random.default_rng(5)
    for size, letters, n in ((12, 2, 300), (9, 3, 100), (40, 1, 90), (25, 4, 2000)):
        shards = [rng.integers(97, 97 + letters, n).astype(np.uint8) for _ in range(3)]
        order, transform, common = suffix_dedup.merge_transforms(shards, size)
        text = np.concatenate(shards)
        assert sorted(order.tolist()) == list(range(3 * n)) and (transform == text[order - 1]).all()
        prefix = [text[i : min(i + size, (i // n + 1) * n)].tobytes() for i in order.tolist()]
        whole = [p for p in prefix if len(p) == size]
        count = Counter(whole)
        assert whole == sorted(whole)
        again = suffix_dedup.repeated_intervals(common, size)
        assert all(again[slot] == (count[p] > 1) for slot, p in enumerate(prefix) if len(p) == size)
        for slot in range(1, len(order)):
            a, b = prefix[slot - 1 : slot + 1]
            assert a[: common[slot]] == b[: common[slot]] or min(len(a), len(b)) < size


def test_language_model_counts_and_normalises(docs, empty):
    rows = pitman_yor.score(docs).collect()
    assert len(rows) == len(ROWS)
    train = [w for i, t, _ in ROWS if zlib.crc32(str(i).encode()) % 5 != 1 or i is None for w in [*fold(t).split(), b"\0"]]
    for r in rows:
        assert r.train_tokens == len(train) and r.score < 0 and r.n_known <= r.n_tokens
    count, total = Counter(train), len(train)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    want = []
    for i, t, _ in ROWS:
        own = [*fold(t).split(), b"\0"]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in own)
        want.append((str(i), len(own), sum(count[w] > 0 for w in own), round(base, 6)))
    assert got == sorted(want)
    # every training token is counted in one pair
    chunks = pitman_yor.encoded(docs, 3)
    numbers = pitman_yor.numbered(chunks.where("bucket >= 0"), 3)
    asked = pitman_yor.requests(chunks.where("bucket < 0"), numbers, 3).where("kind = 2")
    sums = pitman_yor.counted(asked, 3).collect()
    assert all(sum(r.c for r in sums if r.kind == kind) == total for kind in (0, 1))
    assert len({r.w for r in sums if r.kind == 1}) == len(count) and all(r.c > 1 for r in sums if r.kind == 2)
    assert pitman_yor.score(empty).count() == 0


def test_seating_follows_the_restaurant_process():
    """Tables of a dish against a sampler that seats one customer at a time in plain Python."""
    rng, c, room, guests, every, d = np.random.default_rng(1), 12, 1.5, 2.0, 40.0, 0.8
    want = []
    for _ in range(4000):
        t = 1
        for seated in range(1, c):
            new = (room + d * t) * (guests + t) / (every + t)
            t += rng.random() < new / (new + seated - d * t)
        want.append(t)
    full = [np.full(4000, x) for x in (float(c), room, guests, every)]
    got = pitman_yor.seat(*full, d, rng)
    assert abs(got.mean() - np.mean(want)) < 0.1 and got.min() >= 1 and got.max() <= c
    assert (pitman_yor.seat(*[x[:3] for x in (np.ones(3), *full[1:])], d, rng) == 1).all()


def held_ids(n, held):
    return [i for i in range(100_000) if (zlib.crc32(str(i).encode()) % 5 == 1) == held][:n]


def test_language_model_is_a_distribution(spark):
    """Probabilities of all texts of two known words and one unknown add up to 1 but for the long texts' share."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "b"], rng.integers(0, 3)))) for i in held_ids(500, False)]
    texts = [" ".join(t) for n in range(7) for t in itertools.product(("a", "b", "zz"), repeat=n)]
    rows += list(zip(held_ids(len(texts), True), texts, strict=True))
    got = [r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect() if r.held_out]
    assert len(got) == len(texts) and 0.98 < sum(10**r.score for r in got) < 1 + 1e-9
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_language_model_beats_the_base_on_held_out_texts(spark, data):
    got = [r for r in pitman_yor.score(spark.read.parquet(f"{data}/documents.parquet")).collect() if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.3 * sum(r.n_tokens for r in got)


def test_license_lines(docs, empty):
    found = license_scan.scan(docs).collect()
    assert [(r.doc_id, r.line_no, r.license) for r in found if r.dice == 1.0] == [(10, 1, "CC-BY-NC-4.0")]
    assert license_scan.scan(empty).count() == 0


def test_license_passages(spark, docs, empty):
    bodies = dict(enumerate(license_scan.TEMPLATES + license_scan.BODIES))
    mit = next(i for i, (k, t) in bodies.items() if k == "MIT" and "NONINFRINGEMENT" in t)
    rows = [
        (1, "Copyright 2020 X. Released under the MIT License."), (2, "so\n// Licensed under the Apache\n// License, Version 2.0.\nand more"), (3, "All rights reserved."),
        (4, "MIT License\n\nCopyright (c) 2020 X\n\n" + bodies[mit][1] + "\n" + "int x; " * 500), (5, "The license of the software is under discussion in all rights."), (6, None),
        (7, "Released under the MIT License. " * 3),
    ]
    rows += [(100 + i, f"before {t} after") for i, (_, t) in bodies.items()]
    found = license_scan.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = lambda i: {(r.word_no, r.license, r.dice) for r in found if r.doc_id == i}
    assert got(1) == {(4, "MIT", 1.0)} and got(2) == {(2, "Apache-2.0", 1.0)} and len(got(3)) == 1 and not got(5) and not got(6)
    assert (7, "MIT", 1.0) in got(4) and got(7) == {(1, "MIT", 1.0), (6, "MIT", 1.0), (11, "MIT", 1.0)}
    assert all(any(r.template == i and r.dice >= 0.95 for r in found if r.doc_id == 100 + i) for i in bodies)
    assert [(r.doc_id, r.passage) for r in license_scan.passages(docs).collect()] == [(10, "licensed under cc by nc 4 0")]
    assert license_scan.passages(empty).count() == 0


def test_simhash_components(spark, docs, empty):
    rows = simhash.near_groups(docs).collect()
    prints = [int(r.fingerprint, 16) for r in rows]
    ids = [r.doc_id for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    for a, row in enumerate(rows):
        assert row.component_id == min((ids[b] for b in range(len(rows)) if root[b] == root[a] and ids[b] is not None), default=None)
    assert simhash.near_groups(empty).count() == 0


def test_near_dedup_keeps_a_row_of_every_component(spark):
    texts = [" ".join(f"{w}{i}" for w in ("sun", "moon", "tree", "lake", "road")) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[4]), (3, texts[4]), (9, texts[5]), (9, texts[5])]
    rows = [(*r, "a", "b") for r in rows]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 3
    table = spark.createDataFrame(rows, "doc_id long, text string, fp string, root string").repartition(3)
    got = simhash.deduplicate(table)
    assert got.columns == table.columns
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[4]), (9, texts[5])]
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, want))
    assert simhash.deduplicate(table.where("false")).count() == 0


def test_hamming_links_connect_what_is_close(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    every = {int(x) for x in base}
    for x in base[:20].tolist():
        for _ in range(6):
            x ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            every.add(x)
    nodes = sorted(every)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in nodes]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    label = {np.int64(r.node).astype(np.uint64).item(): r.root for r in found}
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                assert label[a] == label[b]


def test_toxic_words_are_learnt_and_located(spark):
    rng = np.random.default_rng(4)
    words = ["sun", "moon", "tree", "lake", "road", "hill"]
    texts, toxic = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        bad = i % 5 == 0
        if bad:
            sentences[int(rng.integers(5))] += " vileword"
        texts.append(". ".join(sentences))
        toxic.append(int(bad))
    model = toxicity.fit(texts, toxic)
    p, spans = model.score("sun moon. tree vileword lake. road")
    assert p > 0.5 and spans[0][0] <= 10 < spans[0][1] and model.score("sun moon tree. lake")[0] < 0.2
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "vileword sun")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[1] == got[2] == 0.0 and len(got) == 3


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=7)], 0) for i in range(300)]
    rows += [(300, None, 0), (301, [float("nan")] * 7, 0), (302, [None] * 7, 0), (None, [1.0] * 7, 0), (100, rows[100][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    clean = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(int) for r in table.limit(300).collect()}
    got = topk_search.top_k(table, F.col("vec_id") % 50 == 0).collect()
    for q in range(0, 300, 50):
        want = sorted(((-int(clean[q] @ v), i) for i, v in [*clean.items(), (100, clean[100])] if i != q))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(-s, i) for s, i in want] == [(s, i) for _, i, s in mine]
    assert topk_search.top_k(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_drop_pairs_at_every_resolution():
    """Vectors in clusters: fewer pairs are left at each resolution, and switching the bounds off changes the work, not the result."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 64)) * 256
    vectors = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 64)) * 25)
    vectors[50:60] = vectors[40]  # ties
    ids, seen = np.arange(3000), []
    q, i, s = topk_search.best_of(vectors[::20], ids[::20], vectors, ids, 5, seen)
    assert seen[0] == 150 * 3000 and all(a > b for a, b in zip(seen, seen[1:])) and seen[-1] < 0.5 * seen[0]
    exact = vectors[::20] @ vectors.T
    for row in range(150):
        want = sorted((-int(exact[row, j]), j) for j in range(3000) if j != 20 * row)[:5]
        assert [(-int(x), int(j)) for j, x in zip(i[q == row], s[q == row])] == want


def test_main_text():
    page = (
        "<html><body><header>Site</header><nav><a href=/>Home</a></nav><div class='cookie-notice'><p>We use cookies, ok?</p></div><div id=main><h2>Head</h2>"
        "<p>First part, with <a href=x>a link</a>, is long enough.</p><p>Second&nbsp;&lt;part&gt; &amp; more,\n  with stops. Fine.</p><div class=comments><p>Great post, I like it, very much so.</p></div>"
        "</div><aside>Side</aside><script>var t='</p>';</script><footer>f</footer></body></html>"
    )
    assert html_extract.main_text(page) == "Head\n\nFirst part, with a link, is long enough.\n\nSecond <part> & more, with stops. Fine."
    assert html_extract.main_text("") == "" and html_extract.main_text("<script>x</script>") == ""


def test_main_text_inside_marked_wrappers():
    body = "<h1>Head</h1><p>First part, which is long enough, and more.</p><p>Second part, with stops. Fine, too.</p>"
    want = "Head\n\nFirst part, which is long enough, and more.\n\nSecond part, with stops. Fine, too."
    menu = "<nav><a href=/>Home</a></nav><div class=ad>Buy this, now.</div>"
    for wrap in ("form id=aspnetForm", "div class='content-sidebar-wrap'", "div class=has-sidebar", "div class=with-side-menu"):
        name = wrap.split()[0]
        for inner in (f"<article>{body}<div class=comments><p>{'Great post, I like it. ' * 20}</p></div></article>", f"<div>{body}</div>"):
            assert html_extract.main_text(f"<html><body><{wrap}>{menu}{inner}</{name}></body></html>") == want
    page = f"<body><div>{body}</div><div class=comments><p>{'Great post, I like it. ' * 20}</p></div></body>"
    assert html_extract.main_text(page) == want


PROSE = "A long part of the story, told in full, with stops. It goes on, as stories do."


def test_path_scores_decide_where_no_article_is_named(monkeypatch):
    """The selected paths give the text: with level scores the links and the sidebar come along."""
    links = "".join(f"<li><a href=/{i}>Item {i} of the list</a></li>" for i in range(30))
    parts = "".join(f"<section><h2>Part {i}</h2><p>{PROSE}</p></section>" for i in range(3))
    page = f"<body><div class=box><ul>{links}</ul></div><div class=story><h1>Head</h1>{parts}</div><div class=end><p>Short end</p></div></body>"
    want = "\n\n".join(["Head"] + [f"Part {i}\n\n{PROSE}" for i in range(3)])
    assert html_extract.main_text(page) == want
    monkeypatch.setattr(html_extract, "path_scores", lambda found: {b.path: 1.0 for b, _ in found})
    assert html_extract.main_text(page) != want


def test_marked_paths_weigh_nothing_but_are_not_thrown_away_alone():
    page = f"<body><article><h1>Head</h1><p>Short.</p></article><div class=ad>{PROSE * 3}</div></body>"
    assert html_extract.main_text(page) == "Head\n\nShort."
    assert html_extract.main_text(f"<body><p class=notice>{PROSE}</p></body>") == PROSE


def test_extract_on_hard_rows(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "<p>One, two.", 3), (3, "u", "<p>One, two.", 3), (None, "u", "<p>" + "word, and more. " * 60_000, 4), (5, "u", "<<p>< >&amp;<b", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    long = ("word, and more. " * 60_000).strip()
    want = [("1", "u", ""), ("2", "None", ""), ("3", "u", "One, two."), ("3", "u", "One, two."), ("None", "u", long), ("5", "u", "<\n\n< >&<b")]
    assert got == sorted((i, u, t, len(t)) for i, u, t in want)
    assert html_extract.extract(pages.where("false")).count() == 0


def test_fingerprints_equal_another_xxh64(spark):
    """Against Spark's own XXH64 (seed 42), with words by a pattern and bits counted one by one."""
    texts = ["", " \t", "One", "one Two", "A b c d a b c d", "É é x İ y z", "x " * 500, "\x0bq w\x0ce\x1fr t y", "世 界 🙂 ß"]
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = []
    for i, text in enumerate(texts):
        words = pattern.findall(text.translate(fold))
        rows += [(i, " ".join(words[j : j + 3])) for j in range(max(1, len(words) - 2)) if words]
    bits, size = [[0] * 64 for _ in texts], Counter(i for i, _ in rows)
    for i, h in spark.createDataFrame(rows, "i int, s string").select("i", F.xxhash64("s")).collect():
        for b in range(64):
            bits[i][b] += h >> b & 1
    want = [sum(1 << b for b in range(64) if 2 * bits[i][b] > size[i]) for i in range(len(texts))]
    assert [simhash.fingerprint(t.encode()) for t in texts] == want


def test_toxicity_on_held_out_labels(spark):
    """Learnt from the training rows of a given table: most held-out toxic documents are found, next to no clean ones flagged."""
    path = "/root/testdata/sf0.1"
    if not os.path.exists(path):
        pytest.skip("the larger tables are not here")
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op8_toxicity(spark, path).where("held_out").join(labels, "doc_id").select("toxic", "predicted", F.size("sentences").alias("n")).toPandas()
    toxic, clean = rows[rows["toxic"] == 1], rows[rows["toxic"] == 0]
    assert len(toxic) > 50 and toxic["predicted"].mean() >= 0.8 and clean["predicted"].mean() <= 0.02
    assert (toxic[toxic["predicted"] == 1]["n"] > 0).all()


def test_articles_keep_text_whose_class_only_sounds_like_a_mark():
    for kind in "story share-price side-effects form-section more-info search-results comment-analysis header-section notice-board rail-transport reply-brief social-history".split():
        page = f"<article><p>Long enough, and with stops. It goes on, and on.</p><div class='{kind}'><p>Of {kind}, this is said. It is so.</p></div></article>"
        assert html_extract.main_text(page).endswith("It is so."), kind
    for kind in "ad ad-banner comments comments-list cookie-notice site-footer share newsletter-signup widget-area".split():
        page = f"<article><p>Long enough, and with stops. It goes on, and on.</p><div class='{kind}'><p>Buy, now. Or never.</p></div></article>"
        assert html_extract.main_text(page).endswith("and on."), kind


PLAIN = (
    "<body><div class=top><span>Home</span> <span>News</span></div><div class=links><ul><li>One</li><li>Two</li><li>Three</li></ul></div><h2>Title</h2>"
    + "<p class=t>A sentence, with a comma. And another, which is long.</p>" * 3 + "<ul><li>a point</li></ul><p class=t>The end, as it were. Good bye, all.</p><div class=links><ul><li>Four</li></ul></div></body>"
)


def brute_paths(page):
    """Mean length and stops of each path's blocks, counted block by block."""
    found = html_extract.blocks(page)
    paths = list(dict.fromkeys(b.path for b, _ in found))
    rows = [[t for b, t in found if b.path == p] for p in paths]
    ratios = [(sum(map(len, ts)) / len(ts), sum(ch in html_extract.STOPS for t in ts for ch in t) / len(ts)) for ts in rows]
    if len(ratios) > 2:
        at = lambda i: ratios[min(max(i, 0), len(ratios) - 1)]
        ratios = [tuple(0.15 * at(i - 1)[k] + 0.7 * at(i)[k] + 0.15 * at(i + 1)[k] for k in (0, 1)) for i in range(len(ratios))]
    marked = {b.path for b, _ in found if b.marked}
    return {p: 0.0 if p in marked else math.sqrt(a * (b + 0.1)) for p, (a, b) in zip(paths, ratios)}


def test_path_ratios_select_content_on_pages_without_an_article(monkeypatch):
    got = html_extract.path_scores(html_extract.blocks(PLAIN))
    assert got == pytest.approx(brute_paths(PLAIN))
    text = html_extract.main_text(PLAIN)
    assert text.startswith("Title\n\nA sentence") and "a point" in text and text.endswith("Good bye, all.") and not any(w in text for w in ("Home", "One", "Four"))
    monkeypatch.setattr(html_extract, "path_scores", lambda found: {b.path: 1.0 for b, _ in found})
    assert html_extract.main_text(PLAIN) != text


def test_exact_groups_of_text_ids(spark):
    rows = [("b", "Same"), ("a", "same"), (None, "SAME"), ("c", "other"), ("c", "other"), ("é", None), ("z", "")]
    got = sorted(map(tuple, exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id string, text string")).drop("text_sha256").collect()), key=str)
    assert got == sorted([("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("c", "c", 2, True), ("c", "c", 2, True), ("é", "é", 2, True), ("z", "é", 2, False)], key=str)
