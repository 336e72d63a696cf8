"""Cases that earlier versions of the corpus operators got wrong or slow, and the pipeline as a whole."""

import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F

from flowloom.llm import bpe, html_text, jaccard_join, repeat_dedup, toxicity
from flowloom.llm.tokens import Encoder, read_ranks


@pytest.mark.parametrize("piece", ["<div>x", "<b>x", "<font>x ", "<span>y<a>z", '<a href="x>', "<li class='a b'>x", "<p><object>x", "<!--", "<svg><title>a"])
def test_pages_of_unclosed_elements_take_linear_time(piece):
    page = piece * (500_000 // len(piece))
    began = time.perf_counter()
    blocks = html_text.leaf_blocks(page)
    html_text.features(blocks[:2000])
    assert time.perf_counter() - began < 20


def texts(page):
    return [b.text for b in html_text.leaf_blocks(page)]


@pytest.mark.parametrize("size", [10, 1_900, 2_100, 100_000])
def test_an_attribute_may_be_of_any_length(size):
    value = "a > b <i>" + "z" * size
    assert texts(f'<p>One two.</p><div data-j="{value}">Three four.</div><div data-k=\'{value}\' >Five.</div>') == ["One two.", "Three four.", "Five."]


def test_short_comments_and_unclosed_quotes():
    assert texts("<p>One.<!--></p><p>Two.</p><!-- c --><p>Three.</p><!--->Four.<!-- > --!>Five.") == ["One.", "Two.", "Three.", "Four.Five."]
    assert texts('<p title="x>One.</p><p>Two "three".</p>') == ["One.", 'Two "three".']
    assert texts("a < b and c<d <p>e</p>") == ["a < b and c<d", "e"]


def test_names_and_leaves_follow_what_is_open():
    page = '<div class="Menu top"><ul><li>a<li>b</ul>c</div><main><p>d<div>e</div></main>f'
    assert [(b.text, sorted(b.path), b.leaf, sorted(b.names)) for b in html_text.leaf_blocks(page)] == [
        ("a", ["div", "li", "ul"], "li", ["menu", "top"]),
        ("b", ["div", "li", "ul"], "li", ["menu", "top"]),
        ("c", ["div"], "div", ["menu", "top"]),
        ("d", ["main", "p"], "p", []),
        ("e", ["div", "main"], "div", []),
        ("f", [], "-", []),
    ]


def test_long_words_without_spaces(spark):
    r = random.Random(1)
    ideographs = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(100_000))
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDÉéß") for _ in range(50_000))
    cases = [(1, ideographs), (2, letters), (3, "これは日本語の文章です。" * 50), (4, "a" * 3000 + "bcd" * 500)]
    ranks = read_ranks()
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    df = spark.createDataFrame(cases, "doc_id long, text string")
    began = time.perf_counter()
    got = {r.did: list(r.tokens) for r in bpe.encoded(df).collect()}
    assert time.perf_counter() - began < 90
    assert got == {k: plain(t) for k, t in cases}


def test_documents_that_share_a_labelled_id_do_not_all_go_to_the_driver(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: taken.append(len(rows)) or 0.5)
    docs = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    one = next(k for k in range(100) if __import__("zlib").crc32(str(k).encode()) % 4 != 2)
    docs = docs.withColumn("doc_id", F.lit(one).cast("long"))
    toxicity.fitted(docs, spark.createDataFrame([(one, 1, 1)], "doc_id long, quality int, toxic int"), 20)
    assert taken == [20]


def test_encoding_in_parts(spark):
    """A batch whose texts exceed what a task looks at at once, with rows that exceed it alone, equals the library."""
    assert list(bpe.parts(np.array([3, 3, 9, 0, 5, 1]), 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(bpe.parts(np.array([], int))) == [] and list(bpe.parts(np.zeros(3, int))) == [(0, 3)]
    texts = [f"row{i} one {i % 7}, deux señor\n" * (1 + 4500 * (i % 3)) for i in range(12)] + ["", None, "x " * 520_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(), special_tokens={}).encode_ordinary
    got = {r.did: list(r.tokens) for r in bpe.encoded(df).select("did", "tokens").collect()}
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}


def test_toxic_phrases_are_found_wherever_they_are(spark):
    """Ten words of a held-out toxic row, moved through a clean text, with the fitted network."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fitted(docs, labels)
    held = docs.join(labels, "doc_id").where(toxicity.held_out()).orderBy("doc_id").select("text", "toxic").collect()
    chances = lambda texts: toxicity.squash(toxicity.Scorer(net).highest(texts)[0])
    words = {k: [toxicity.words_of(r.text) for r in held if r.toxic == k] for k in (0, 1)}
    phrases = []
    for w in words[1]:
        runs = [w[i : i + 10] for i in range(len(w) - 9)]
        p = chances(runs) if runs else np.zeros(1)
        phrases += [runs[int(p.argmax())]] if p.max() >= toxicity.THRESHOLD else []
    clean = [w for w in words[0] if len(w) >= 200][:60]
    clean = [w for w, p in zip(clean, chances(clean)) if p < 0.1]
    assert len(phrases) > 50 and len(clean) > 30
    for at in range(96, 96 + 2 * toxicity.STRIDE):
        found = chances([c[:at] + phrases[k % len(phrases)] + c[at:] for k, c in enumerate(clean)]) >= toxicity.THRESHOLD
        assert found.mean() >= 0.9


def test_scores_hold_the_words_of_few_texts(monkeypatch):
    class Words(list):
        alive = most = 0

        def __init__(self, *args):
            super().__init__(*args)
            Words.alive += 1
            Words.most = max(Words.most, Words.alive)

        def __del__(self):
            Words.alive -= 1

    split = toxicity.words_of
    monkeypatch.setattr(toxicity, "words_of", lambda text: Words(split(text)))
    net = toxicity.Network([f"w{k}" for k in range(40)], 1)
    batch = pa.RecordBatch.from_pydict({"text": [None, ""] + [" ".join(f"w{(k * i) % 50}" for i in range(k)) for k in range(300)]})
    scorer = toxicity.Scorer(net)
    scores = toxicity.scored_batch(batch, scorer, 0.0)
    assert Words.most <= 4 and len(scores) == batch.num_rows and scores[0] == scores[1] == net.share
    # the texts by themselves
    assert np.allclose(scores, [toxicity.Scorer(net).scores([t])[0] for t in batch.column("text").to_pylist()], atol=1e-5)


def test_frequent_words_are_merged_once(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "naïve naïve\n\n  naïve  日本 日本 " + "x" * 60), (None, None), (10**6 + 1, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    monkeypatch.setattr(bpe, "COMMON", 300)
    common, flat, edges = bpe.common_words(docs)
    encode = Encoder().encode
    assert 0 < len(common) == len(set(common)) <= 300
    assert [flat[a:b].tolist() for a, b in zip(edges, edges[1:])] == [encode(w) for w in common]
    handed = [bytes(r.word) for r in bpe.numbered_words(docs, common=common).where("word is not null").collect()]
    assert handed and not {w.encode() for w in common} & set(handed)
    got = bpe.encoded(docs, words=500).select("did", "tokens").collect()
    want = [(r.doc_id, encode(r.text or "")) for r in docs.collect()]
    key = lambda x: (x[0], x[1])
    assert sorted(((r.did, list(r.tokens)) for r in got), key=key) == sorted(((2**63 - 1 if i is None else i, t) for i, t in want), key=key)


def test_crowded_cells_are_not_copied_where_pivots_do_not_part_them(spark, monkeypatch):
    """60 unlinked texts that share a passage: their rows do not grow from round to round, and nested regions are one."""
    r = np.random.default_rng(3)
    passages = [" ".join(f"p{k}_{n}" for n in range(40)) for k in range(12)]
    items = [(k, " ".join([passages[0], *(passages[j] for j in r.choice(range(1, 12), 3, replace=False)), *(f"o{k}_{n}" for n in range(20))])) for k in range(60)]
    items += [(100 + k, items[k][1] + " more") for k in range(0, 60, 7)]
    tables = []
    written = jaccard_join.written

    def seen(df, label):
        out = written(df, label)
        tables.append((label, out))
        return out

    monkeypatch.setattr(jaccard_join, "written", seen)
    got = jaccard_join.grouped(spark.createDataFrame(items, "doc_id long, text string"), crowd=8, rounds=3).select("did", "component").collect()
    sets = {i: set(jaccard_join.shingles(t.encode()).tolist()) for i, t in items}
    near = {(i, j) for i in sets for j in sets if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    least = {i: i for i in sets}
    for _ in sets:
        least = {i: min(least[j] for j in sets if (i, j) in near) for i in sets}
    assert {r.did: r.component for r in got} == least and len(set(least.values())) > 30
    counts = [(label, t.count(), t.select("cell").distinct().count()) for label, t in tables if label in ("regions", "outermost-regions", "cells")]
    (_, rows, _), (_, outer, cells), *rest = counts
    assert rest and outer < rows and all(n <= outer for _, n, _ in rest), counts


def in_this_process(monkeypatch, make):
    """The two sides of an exchange of repeat_dedup, as functions of batches."""
    sides = []
    monkeypatch.setattr(repeat_dedup, "mapped", lambda df, work, schema: sides.append(work))
    monkeypatch.setattr(repeat_dedup, "dealt", lambda df, buckets: df)
    make()
    return sides


def test_repeats_are_sent_in_one_blob_for_each_bucket(monkeypatch):
    monkeypatch.setattr(repeat_dedup, "CHUNK", 4096)
    draw = random.Random(6)
    texts = ["".join(draw.choices("abcdefgh ", k=2500)) for _ in range(60)]
    texts += [t[300:1900] for t in texts]
    batch = pa.RecordBatch.from_pydict({"did": pa.array(range(len(texts)), pa.int64()), "row_hash": pa.array(range(len(texts)), pa.int64()), "body": pa.array([t.encode() for t in texts])})
    blobs = lambda frames: [(b, k, d) for f in frames for b, k, d in zip(f["bucket"].tolist(), f["kind"].tolist(), f["data"].to_pylist())]
    sorted_by_bucket = lambda rows: pa.RecordBatch.from_pydict(dict(zip(("bucket", "kind", "data"), map(list, zip(*sorted(rows))))))
    send, receive = in_this_process(monkeypatch, lambda: repeat_dedup.shared_minimizers(None, 50, 40))
    rows = blobs(send([batch]))
    assert len(rows) == len({r[:2] for r in rows}) == 40
    parts = [(b, bits) for f in receive([sorted_by_bucket(rows)]) for b, bits in zip(f["bucket"].tolist(), f["bits"].to_pylist())]
    shared = SimpleNamespace(value=repeat_dedup.Sketch(parts, 40))
    send, receive = in_this_process(monkeypatch, lambda: repeat_dedup.repeated_ranges(None, 50, 40, shared))
    rows = blobs(send([batch]))
    assert len(rows) == len({r[:2] for r in rows})
    gone = {}
    for f in receive([sorted_by_bucket(rows)]):
        for did, first, stop in zip(*(np.asarray(f[c]).tolist() for c in ("did", "first", "stop"))):
            gone.setdefault(did, set()).update(range(first, stop))
    assert gone == {60 + k: set(range(1600 - 49)) for k in range(60)}


def test_a_full_sketch_misses_nothing():
    h = np.random.default_rng(3).integers(0, 2**64, 5000, np.uint64)
    buckets, finger = (h % np.uint64(7)).astype(int), (h >> np.uint64(32)).astype(np.int64)
    for most, share in ((10**6, 0.1), (64, 1)):
        sketch = repeat_dedup.Sketch([(b, repeat_dedup.Sketch.part(finger[buckets == b], most)) for b in range(7)], 7)
        assert sketch.may_hold(h).all() and sketch.may_hold(h + np.uint64(1 << 40)).mean() <= share
    assert not repeat_dedup.Sketch([], 7).may_hold(h).any()
