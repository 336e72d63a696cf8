"""Word-window dedup by super-k-mer partitioning.

A window is a fixed number of consecutive words. Its minimiser is the least hash among its runs of a few words, so
equal windows have equal minimisers, and consecutive windows mostly share one. The words under such windows, a
super-k-mer, travel as one packed string to the bucket of their minimiser. There the windows are cut out and sorted;
equal windows lie side by side and belong to the smallest document among them.

1. Counts: how often each minimiser occurs, and in which smallest and largest document; combined in the task first.
2. A super-k-mer whose minimiser only one document holds stays where it is. What the others are is told to the tasks
   by a bitmap of a fixed size, which errs by letting more strings travel (at hundreds of millions of repeated
   minimisers, most). A minimiser that more than ``OFTEN`` windows' runs and more than a 2**20th of all have is
   frequent (at most 2**20 of them). A window with a frequent minimiser takes its least infrequent hash instead, if
   it has one, so that a passage that very many documents hold does not draw all their contexts into one bucket.
   What is left in the buckets of frequent minimisers are windows that consist of frequent passages, whose strings
   are equal and are combined in the task that reads them.
3. The buckets name each distinct string (128-bit hash) and the owner of each of its windows. Strings with a window
   that some document must give up are joined, by name, with the places where they stand; the words go by document.

Long words (over 64 bytes, or with a leading zero byte) travel as a zero byte and their SHA-256, all other words as
they are, so strings are compared by content. A run of windows is cut after ``RUN`` windows. A bucket is expanded a
part of its windows at a time.

Null and empty texts have no words. Documents with fewer words than a window lose none. A null doc_id counts as the
largest; such rows are one document for ownership, as are rows that repeat a doc_id, and each keeps its own words.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrow import OUT_ROWS, changed_texts, mapped, numbers
from flowloom.llm.common import rows, shown_id, written

WINDOW, MINIMISER = 50, 8
RUN, OFTEN, FREQUENT = 128, 256, 2**20
#: Bits of the sketch of repeated minimisers, in groups as the bitmap functions build them.
SKETCH, GROUP = 2**27, 32768
#: Bytes of text that are cut at a time, bytes of strings that a task combines, windows that a bucket sorts at a time.
CUT, COMBINED, SORTED = 4_000_000, 48_000_000, 200_000
LONG_WORD = 64
TOP = np.uint64(1 << 63)


class Hashes(dict):
    """Hashes of the words met; forgets all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    if len(x) < width:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


class Frequent:
    """Whether hashes are among the frequent minimisers; a table of their low bits answers nearly always."""

    def __init__(self, found: np.ndarray):
        self.found = np.sort(found)
        self.low = np.zeros(1 << 22, bool)
        self.low[self.found & np.uint64((1 << 22) - 1)] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        hit = self.low[x & np.uint64((1 << 22) - 1)]
        at = np.flatnonzero(hit)
        hit[at] = np.isin(x[at], self.found)
        return hit


def runs_of(texts: list[list[bytes]], table: Hashes, window: int, frequent: Frequent | None = None) -> dict[str, np.ndarray]:
    """The runs of windows with one minimiser: doc (index in texts), at (first word), n (windows), key, other.

    other marks runs whose windows took another hash than their least one.
    """
    sizes = np.array([len(t) for t in texts], "i8")
    total, span = int(sizes.sum()), min(MINIMISER, window)
    none = np.zeros(0, "i8")
    if total < window:
        return {"doc": none, "at": none, "n": none, "key": none, "other": none.astype(bool)}
    h = np.fromiter((table[w] for t in texts for w in t), np.uint64, total)
    x = np.zeros(total - span + 1, np.uint64)
    for k in range(span):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(x)]
        x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) >> np.uint64(1)
    key = least(x, window - span + 1)
    other = np.zeros(len(key), bool)
    if frequent is not None and (often := frequent(x)).any():
        again = least(np.where(often, x | TOP, x), window - span + 1)
        other = frequent(key)
        key = np.where(other, again, key)
    offset = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(key)]
    start = np.flatnonzero(np.arange(len(key)) + window <= (offset + sizes)[doc])
    if not len(start):
        return {"doc": none, "at": none, "n": none, "key": none, "other": none.astype(bool)}
    k, o = key[start], other[start]
    new = np.r_[True, (start[1:] != start[:-1] + 1) | (k[1:] != k[:-1]) | (o[1:] != o[:-1])]
    order = np.arange(len(start))
    new |= (order - np.maximum.accumulate(np.where(new, order, 0))) % RUN == 0
    first = np.flatnonzero(new)
    doc = doc[start[first]]
    return {"doc": doc, "at": start[first] - offset[doc], "n": np.diff(np.r_[first, len(start)]), "key": k[first].view("i8"), "other": o[first]}


def keyed(docs: DataFrame) -> DataFrame:
    return rows(docs).select("did", F.xxhash64("body").alias("row_hash"), F.col("body").cast("binary").alias("body"))


def pieces(batches, limit: int = CUT):
    """(ids, row hashes, words of each text) of some documents at a time."""
    for batch in batches:
        dids, hashes, bodies = numbers(batch, "did"), numbers(batch, "row_hash"), batch.column("body")
        first = size = 0
        for k in range(batch.num_rows):
            size += len(bodies[k].as_buffer())
            if size >= limit or k + 1 == batch.num_rows:
                yield dids[first : k + 1], hashes[first : k + 1], [b.split() for b in bodies.slice(first, k + 1 - first).to_pylist()]
                first, size = k + 1, 0


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, n of the minimisers that several documents hold."""

    def work(batches):
        table = Hashes()
        for dids, _, texts in pieces(batches):
            r = runs_of(texts, table, window)
            if not len(r["key"]):
                continue
            order = np.lexsort((dids[r["doc"]], r["key"]))
            key, did = r["key"][order], dids[r["doc"]][order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[first[1:], len(key)]
            yield {"key": key[first], "low": did[first], "high": did[ends - 1], "n": (ends - first).astype("i8")}

    told = mapped(keyed(docs), work, "key long, low long, high long, n long")
    return told.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low < high").select("key", "n")


def sketch_of(keys: DataFrame) -> np.ndarray:
    """A bit for each key, as bytes; built by groups in Spark, of one size for every input."""
    place = keys.select(F.pmod("key", F.lit(SKETCH)).alias("h")).select(F.floor(F.col("h") / GROUP).alias("part"), (F.col("h") % GROUP).alias("bit"))
    out = np.zeros(SKETCH // 8, np.uint8)
    for part, bits in place.groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():
        out[part * GROUP // 8 : (part + 1) * GROUP // 8] = np.frombuffer(bits, np.uint8)
    return out


def packed(words: list[bytes]) -> bytes:
    return b" ".join([w if len(w) <= LONG_WORD and w[0] else b"\0" + hashlib.sha256(w).hexdigest().encode() for w in words])


def travelling(told: DataFrame, often: int = OFTEN):
    """A function that gives the runs of some texts that travel: (doc, at, n, key, string)."""
    total = told.agg(F.sum("n")).first()[0] or 0
    limit = max(often, total // FREQUENT)
    hot = told.where(F.col("n") > limit).select("key").toArrow().column("key").to_numpy().astype("i8").view(np.uint64)
    context = told.sparkSession.sparkContext
    sketch, hot = context.broadcast(sketch_of(told)), context.broadcast(hot)

    def ready(window: int):
        table, frequent = Hashes(), Frequent(hot.value) if len(hot.value) else None

        def choose(texts):
            r = runs_of(texts, table, window, frequent)
            place = r["key"] % SKETCH
            far = r["other"] | ((sketch.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)
            for doc, at, n, key in zip(*(r[c][far].tolist() for c in ("doc", "at", "n", "key"))):
                yield doc, at, n, key, packed(texts[doc][at : at + n + window - 1])

        return choose

    return ready


def strings(docs: DataFrame, ready, window: int = WINDOW) -> DataFrame:
    """key, s, low, high: the strings of each task, with the smallest and largest document that holds them."""

    def work(batches):
        choose, seen, size = ready(window), {}, 0

        def out():
            keys, low, high = zip(*seen.values())
            return {"key": np.array(keys, "i8"), "s": pa.array(list(seen), pa.binary()), "low": np.array(low, "i8"), "high": np.array(high, "i8")}

        for dids, _, texts in pieces(batches):
            ids = dids.tolist()
            for doc, _, _, key, s in choose(texts):
                did, old = ids[doc], seen.get(s)
                if old is None:
                    seen[s] = (key, did, did)
                    size += len(s) + 200
                elif not old[1] <= did <= old[2]:
                    seen[s] = (key, min(did, old[1]), max(did, old[2]))
            if size >= COMBINED:
                yield out()
                seen, size = {}, 0
        if seen:
            yield out()

    return mapped(keyed(docs), work, "key long, s binary, low long, high long")


def places(docs: DataFrame, ready, window: int = WINDOW) -> DataFrame:
    """s1, s2 (name of the string), did, row_hash, at, n: where the strings stand."""

    def work(batches):
        choose = ready(window)
        for dids, hashes, texts in pieces(batches):
            found = [(doc, at, n, xxhash.xxh3_128_digest(s)) for doc, at, n, _, s in choose(texts)]
            if found:
                doc, at, n, names = zip(*found)
                pair, doc = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2), np.array(doc)
                yield {"s1": pair[:, 0].copy(), "s2": pair[:, 1].copy(), "did": dids[doc], "row_hash": hashes[doc], "at": np.array(at, "i8"), "n": np.array(n, "i8")}

    return mapped(keyed(docs), work, "s1 long, s2 long, did long, row_hash long, at long, n long")


def window_owners(bucket: list[tuple[bytes, int, int]], window: int, at_once: int = SORTED) -> list[list[int]]:
    """The smallest document of each window of each string (string, low, high) of a bucket."""
    edges = []
    for s, _, _ in bucket:
        ends = [k for k, b in enumerate(s) if b == 32] + [len(s)]
        edges.append(([0, *(e + 1 for e in ends[:-1])], ends))
    owners = [[0] * (len(ends) - window + 1) for _, ends in edges]
    parts = -(-sum(map(len, owners)) // at_once)
    for part in range(parts):
        cut = []
        for i, (s, low, _) in enumerate(bucket):
            starts, ends = edges[i]
            for j in range(len(owners[i])):
                w = s[starts[j] : ends[j + window - 1]]
                if parts == 1 or zlib.crc32(w) % parts == part:
                    cut.append((w, low, i, j))
        cut.sort()
        last = owner = None
        for w, low, i, j in cut:
            if w != last:
                last, owner = w, low
            owners[i][j] = owner
    return owners


def owned(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """s1, s2, owners (little-endian 64-bit ids; one if all windows have the same) of strings that some document gives up."""

    def work(batches):
        bucket, key, out = [], None, []

        def close():
            if not bucket:
                return
            many = len(bucket) > 1
            for (s, low, high), own in zip(bucket, window_owners(bucket, window) if many else [[bucket[0][1]]]):
                if min(own) < high:
                    own = own[:1] if len(set(own)) == 1 else own
                    out.append((xxhash.xxh3_128_digest(s), np.array(own, "<i8").tobytes()))

        def given():
            pair = np.frombuffer(b"".join(x[0] for x in out), "<i8").reshape(-1, 2)
            return {"s1": pair[:, 0].copy(), "s2": pair[:, 1].copy(), "owners": pa.array([x[1] for x in out], pa.binary())}

        for batch in batches:
            for k, s, low, high in zip(*(batch.column(c).to_pylist() for c in ("key", "s", "low", "high"))):
                if k != key:
                    close()
                    bucket, key = [], k
                if bucket and bucket[-1][0] == s:
                    bucket[-1] = (s, min(low, bucket[-1][1]), max(high, bucket[-1][2]))
                else:
                    bucket.append((s, low, high))
            if len(out) >= OUT_ROWS:
                yield given()
                out = []
        close()
        if out:
            yield given()

    return mapped(found.repartition("key").sortWithinPartitions("key", "s"), work, "s1 long, s2 long, owners binary")


def spans(docs: DataFrame, window: int = WINDOW, often: int = OFTEN) -> DataFrame:
    """did, row_hash, gone: the word ranges (first, end) that a document loses, in no order and with overlaps."""
    ready = travelling(written(repeated(docs, window), "minimisers"), often)
    owners = written(owned(strings(docs, ready, window), window), "window-owners")
    where = written(places(docs, ready, window), "window-places")

    def work(batches):
        for batch in batches:
            dids, hashes, first, end = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("did", "row_hash", "at", "n", "owners"))
            for did, row_hash, at, n, own in zip(*columns):
                lost = np.flatnonzero(np.broadcast_to(np.frombuffer(own, "<i8"), n) < did)
                if len(lost):
                    cut = np.flatnonzero(np.diff(lost) > 1)
                    a, b = lost[np.r_[0, cut + 1]], lost[np.r_[cut, len(lost) - 1]]
                    first += (at + a).tolist()
                    end += (at + b + window).tolist()
                    dids += [did] * len(a)
                    hashes += [row_hash] * len(a)
            yield {"did": np.array(dids, "i8"), "row_hash": np.array(hashes, "i8"), "a": np.array(first, "i8"), "b": np.array(end, "i8")}

    lost = mapped(where.join(owners, ["s1", "s2"]).drop("s1", "s2"), work, "did long, row_hash long, a long, b long")
    return lost.groupBy("did", "row_hash").agg(F.collect_set(F.array("a", "b")).alias("gone"))


def kept_words(words: list[bytes], gone: list[list[int]] | None) -> list[bytes]:
    if not gone:
        return words
    keep = np.zeros(len(words) + 1, "i8")
    for a, b in gone:
        keep[a] += 1
        keep[b] -= 1
    return [w for w, k in zip(words, np.cumsum(keep).tolist()) if not k]


def deduplicated(docs: DataFrame, window: int = WINDOW, often: int = OFTEN) -> DataFrame:
    """did, row_hash, text (the kept words, joined by one space), n_words, n_removed of every row."""

    def work(batches):
        for batch in batches:
            bodies, gone = batch.column("body"), batch.column("gone")
            for k in range(0, batch.num_rows, 500):
                texts = [b.split() for b in bodies.slice(k, 500).to_pylist()]
                kept = [kept_words(t, g) for t, g in zip(texts, gone.slice(k, 500).to_pylist())]
                yield {
                    "did": batch.column("did").slice(k, 500),
                    "row_hash": batch.column("row_hash").slice(k, 500),
                    "text": pa.array([b" ".join(t) for t in kept], pa.binary()).cast(pa.string()),
                    "n_words": np.array([len(t) for t in texts], "i8"),
                    "n_removed": np.array([len(t) - len(x) for t, x in zip(texts, kept)], "i8"),
                }

    joined = keyed(docs).join(spans(docs, window, often), ["did", "row_hash"], "left")
    return mapped(joined, work, "did long, row_hash long, text string, n_words long, n_removed long")


def without_repeated_windows(docs: DataFrame, window: int = WINDOW, often: int = OFTEN) -> DataFrame:
    """docs, all columns; the text of a row that loses words is its kept words, joined by one space."""
    return changed_texts(docs, spans(docs, window, often), lambda body, gone: b" ".join(kept_words(body.split(), gone)))


def window_digests(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select(shown_id("did").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def oracle() -> str:
    return r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words from documents),
 w as (select doc_id, unnest(words) word, generate_subscripts(words, 1) p, words from d),
 s as (select doc_id, p, word, case when p + 49 <= len(words) then array_to_string(words[p : p + 49], ' ') end body from w),
 o as (select *, body is not null and min(doc_id) over (partition by body) < doc_id lost from s),
 g as (select *, max(lost::int) over (partition by doc_id order by p rows 49 preceding) gone from o),
 r as (select doc_id, count(*) n_words, count(*) filter (gone = 1) n_removed, coalesce(string_agg(word, ' ' order by p) filter (gone = 0), '') body from g group by doc_id)
select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(body, '')) kept_sha256 from d left join r using (doc_id)
"""
