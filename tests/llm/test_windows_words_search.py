"""Word-window dedup, spelling variants and lexical search on hard small cases, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowloom.llm import lexical_search, spelling, window_dedup

BIG = 2**63 - 1
WORDS = [f"w{k}" for k in range(400)]
rng = random.Random(7)


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE, LINE = prose(70), prose(12)
CASES = [
    (5, PASSAGE + " " + prose(30)),
    (3, prose(20) + "\t" + PASSAGE.replace(" ", "\n")),
    (9, prose(8) + " " + PASSAGE + " x" * 200),
    (1, prose(49)),
    (2, None),
    (4, ""),
    (6, " \n\x0b\x1c\x85 "),
    (7, "same " * 400),
    (8, "same " * 120 + "end"),
    (10, ("b" * 5000 + " ") * 60),
    (11, ("b" * 5000 + " ") * 55 + "c"),
    (12, "\0a " * 60),
    (13, "\0a " * 50 + "\0b"),
    (None, PASSAGE),
    (None, PASSAGE + " more"),
    (15, PASSAGE),
    (15, PASSAGE),
    *[(100 + k, f"{prose(60)} {LINE} {PASSAGE} {LINE} {prose(40)}") for k in range(12)],
]


def frame(spark, cases):
    df = spark.createDataFrame(cases, "doc_id long, text string")
    clash = {"did": 1, "key": 2, "s": b"s", "at": 3, "n": 4, "word": "w", "list": 1, "rank": 5, "number": 6, "item_id": 7, "gone": True, "name": "x"}
    return df.select("doc_id", "text", *[F.lit(v).alias(k) for k, v in clash.items()])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def order(doc_id):
    return BIG if doc_id is None else doc_id


def brute_windows(cases, window):
    texts = [(d, (t or "").encode().split()) for d, t in cases]
    owner = {}
    for d, words in texts:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            owner[w] = min(order(d), owner.get(w, BIG))
    out = []
    for d, words in texts:
        gone = set()
        for k in range(len(words) - window + 1):
            if owner[tuple(words[k : k + window])] < order(d):
                gone |= set(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, often", [(50, 256), (50, 2), (5, 3), (10, 1)])
def test_windows_equal_brute_force(spark, window, often):
    from flowloom.llm.common import shown_id

    got = window_dedup.deduplicated(frame(spark, CASES), window, often)
    got = got.select(shown_id("did").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
    assert rows(got) == brute_windows(CASES, window)


def test_windows_of_nothing(spark):
    none = frame(spark, CASES).limit(0)
    assert window_dedup.window_digests(none).count() == 0
    assert rows(window_dedup.window_digests(frame(spark, [(1, None)]))) == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_a_large_bucket_is_sorted_in_parts():
    bucket = sorted({(window_dedup.packed(prose(9).encode().split()), k, k) for k in range(300)} | {(b"a a a a a a", k, k) for k in (3,)})
    whole = window_dedup.window_owners(bucket, 3)
    assert window_dedup.window_owners(bucket, 3, 50) == whole
    best = {}
    for s, low, _ in bucket:
        words = s.split(b" ")
        for k in range(len(words) - 2):
            w = tuple(words[k : k + 3])
            best[w] = min(low, best.get(w, BIG))
    assert whole == [[best[tuple(s.split(b" ")[k : k + 3])] for k in range(len(s.split(b" ")) - 2)] for s, _, _ in bucket]


def test_texts_without_repeated_windows(spark):
    got = {(r.doc_id, r.text) for r in window_dedup.without_repeated_windows(frame(spark, CASES)).collect()}
    assert (1, CASES[3][1]) in got and (2, None) in got and (15, "") in got and (3, CASES[1][1]) in got
    assert window_dedup.without_repeated_windows(frame(spark, CASES)).columns == frame(spark, CASES).columns


def brute_words(cases):
    counts = Counter()
    for d, text in cases:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(cases):
    words, form = brute_words(cases), {}
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and x != w and one_edit(x, w)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


STEMS = ["condition", "Çonditiön", "nation", "aaaaaaa", "translation", "translations", "foundation", "àéîõüÿ×", "abababab"]


def spellings():
    some = random.Random(3)
    text = []
    for stem in STEMS:
        for _ in range(120):
            word = stem
            for _ in range(some.choice([0, 0, 1, 1, 2, 3])):
                k = some.randrange(len(word))
                word = some.choice([word[:k] + word[k + 1 :], word[:k] + some.choice("aeiontÿ") + word[k:], word[:k] + some.choice("aeiontÀ") + word[k + 1 :]])
            text += [word] * some.choice([1, 2, 3, 40])
    some.shuffle(text)
    each = len(text) // 40
    cases = [(k, " 1".join(text[k * each : (k + 1) * each])) for k in range(40)]
    return cases + [(None, "condition, Condition; CONDITION"), (None, None), (3, ""), (3, "condition condition"), (77, "x" * 5000 + " " + "x" * 5000)]


@pytest.mark.parametrize("listed, levels, frequent", [(500, 4, 50), (3, 4, 2), (2, 2, 10**9), (20, 3, 5)])
def test_variants_equal_brute_force(spark, listed, levels, frequent):
    cases = spellings()
    assert rows(spelling.variants(frame(spark, cases), listed, levels, frequent)) == brute_variants(cases)


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, CASES).limit(0)).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "short words only here")])).count() == 0


def test_an_edit_changes_only_grams_over_its_place():
    some = random.Random(5)
    frequent = {"".join(g): some.randrange(9) for g in {tuple(some.choice("ab^$") for _ in range(q)) for q in (3, 3, 3, 4, 4) for _ in range(40)}}  # any grams may be frequent
    for _ in range(3000):
        a = "".join(some.choice("ab") for _ in range(some.randrange(6, 12)))
        k = some.randrange(len(a))
        b = some.choice([a[:k] + a[k + 1 :], a[:k] + "ab"[some.randrange(2)] + a[k:], a[:k] + "c" + a[k + 1 :]])
        (ga, na), (gb, nb) = spelling.grams_of(a, frequent), spelling.grams_of(b, frequent)
        assert len(set(ga) & set(gb)) >= max(len(ga) - na, len(gb) - nb)
        assert len(set(ga[: na + 2]) & set(gb[: nb + 2])) >= 2


ITEMS = [(1, "w1 w2 w3 W4, w5-w6 w6"), (2, None), (3, ""), (4, "nowhere"), (5, PASSAGE + " " + PASSAGE), (None, "naïve CAFÉ w9"), (5, "same"), (7, "w1")]


def brute_search(cases, items, wanted):
    split = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(d, Counter(split(t))) for d, t in cases]
    docs = [(d, c) for d, c in docs if c]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in docs:
            m = 75 + 25 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if score > 0:
                scored.append((-score, order(d)))
        out += [(item, k + 1, None if d == BIG else d, -s) for k, (s, d) in enumerate(sorted(scored)[:wanted])]
    return sorted(out, key=str)


@pytest.mark.parametrize("wanted, terms, block", [(20, 200_000, 8192), (3, 5, 4), (1, 1, 1)])
def test_search_equals_brute_force(spark, wanted, terms, block):
    cases = CASES + [(200 + k, f"{prose(3)} w{k % 5} naïve Café Naïve") for k in range(60)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("number", F.lit("x")).withColumn("did", F.lit(1))
    assert rows(lexical_search.search(frame(spark, cases), items, wanted, terms, block)) == brute_search(cases, ITEMS, wanted)


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(frame(spark, CASES).limit(0), items).count() == 0
    assert lexical_search.search(frame(spark, CASES), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_masks_are_evaluated_until_no_other_can_score_more():
    import numpy as np

    docs = np.arange(5000)
    rare = np.arange(0, 5000, 100)
    postings = {0: (docs, np.full(5000, 10), 10), 1: (rare, np.arange(50) + 1000, 1049)}
    best = lexical_search.Best(20)
    assert lexical_search.search_block(best, [(0, 1), (1, 1)], docs, postings) < 200
    assert best.dids.tolist() == rare[::-1][:20].tolist()
