"""Exact Jaccard join of word-shingle sets, in the metric space of Jaccard distance.

1. Texts with equal word sequences are one node of the join.
2. In the order of a 64-bit hash, linked sets share several of their first shingles. Tasks emit those, and a
   document whose number of shared ones is too small for any partner ends here. A shingle that many documents
   of a task hold is counted there and sent once.
3. The others, whole, are ordered by the number of documents that hold a shingle. Linked sets share one of the
   first ``prefix`` shingles of this order, so each such shingle roots a region: the documents that have it there. A
   region whose documents all have the same region just before it lies in that one, and goes: no pair meets there first.
4. A region's first pivot is its node of smallest number; what lies within the radius of it is linked. Members that no link joins yet are compared directly in small regions. Crowded regions get
   further pivots, one of each of their smallest groups. A document's nearest pivot is its Voronoi cell; it is
   replicated into another pivot's cell if it lies no more than two radii farther from that pivot than from its own. By the
   triangle inequality every link then lies in a cell of one of its ends. Cells are regions, so the join recurs, where a
   round has left at most half of the pairs. A region is divided only if that leaves at most half of its comparisons; else
   it stays whole, with what its pivots linked.
5. What is compared directly lies in one cell, in different groups, in the same or the next band of set sizes, within one
   radius of distance to the pivot (triangle inequality again), and passes two exact bounds: the places of the region's
   shingle in both orders, and the Hamming distance of parity bitmaps, which never exceeds the symmetric difference of the sets.
6. Links are joined to components by alternating large-star and small-star steps, all in Spark.

Plain Voronoi regions of a few pivots do not separate texts: nearly all distances between texts are 1, so each
window would hold everything. The first regions are therefore rooted at shingles. Members of a crowded cell that are
still in different groups when its rounds end, ``rounds`` at most, are compared directly, in blocks that adaptive execution splits.
Shingles, and word sequences, are compared by 64-bit and 128-bit hashes.

Null, empty and blank texts have an empty set and link with nothing. A text of fewer words than a shingle is one
shingle. Rows that repeat a doc_id are one document, which links where any of its rows does. Each row without an id
is a document of its own: it is numbered beyond all ids, so ids come first in a group, and shown as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.arrow import mapped, numbers
from flowloom.llm.common import NO_ID, rows, written

WORDS, PERCENT, CROWD, ROUNDS, PIVOTS = 5, 75, 24, 3, 3
#: Keys that a task gathers before it hands them on; 64-bit words of a parity bitmap.
GATHERED, BITMAP = 2_000_000, 8
#: Bits of the sketch of chosen rows (8 MB, whatever the input), in groups as the bitmap functions build them.
SKETCH, GROUP = 2**26, 32768
#: Kinds of rows of the first exchange, beside counts: a key of one document, a key known to be shared.
KEY, SHARED = -1, -2
#: Stands for the frequency of a shingle at the edge of a partition, which is not counted.
MANY = 2**31 - 1
#: Rows without an id are numbered from here, or from beyond the largest id if that is larger.
BEYOND = 2**62


def shingles(body: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    return shingles_of(body.lower().split(), words)


def shingles_of(tokens: list[bytes], words: int = WORDS) -> np.ndarray:
    if not tokens:
        return np.zeros(0, np.uint64)
    n = max(1, len(tokens) - words + 1)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    out = np.full(n, len(tokens[:words]), np.uint64)
    for k in range(min(words, len(tokens))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """The fewest shingles that a set of n shares with any set linked to it; also the least size of such a set."""
    return -(-percent * n // 100)


def needed(n: int, percent: int = PERCENT) -> int:
    """How many of its emitted shingles a set of n shares with any set linked to it, at least."""
    m = least_overlap(n, percent)
    return min(m // 12 + 2, least_overlap(m, percent))


def keyed(docs: DataFrame) -> DataFrame:
    return rows(docs).select("did", F.xxhash64("body").alias("row_hash"), F.col("body").cast("binary").alias("body"))


def heads(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """did, row_hash, n (set size), least (see needed), seq1, seq2 (hash of the word sequence) of every row."""

    def work(batches):
        for batch in batches:
            hashes, sizes = bytearray(), []
            for body in batch.column("body").to_pylist():
                tokens = body.lower().split()
                hashes += xxhash.xxh3_128_digest(b" ".join(tokens))
                sizes.append(len(shingles_of(tokens, words)))
            pair = np.frombuffer(bytes(hashes), "<i8").reshape(-1, 2)
            yield {
                "did": batch.column("did"),
                "row_hash": batch.column("row_hash"),
                "n": np.array(sizes, "i4"),
                "least": np.array([needed(n, percent) for n in sizes], "i4"),
                "seq1": pair[:, 0].copy(),
                "seq2": pair[:, 1].copy(),
            }

    return mapped(keyed(docs), work, "did long, row_hash long, n int, least int, seq1 long, seq2 long")


def first_keys(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """k, seq1, c: the first shingles of each word sequence, in the order of their hashes.

    c is KEY for a key that one sequence of the task's block holds. A key that more of them hold is one row of the
    block, with c SHARED, and is counted in c of the row that each sequence of the block has besides (its k is seq1).
    """

    def work(batches):
        ks, seqs, seen, size = [], [], set(), 0

        def out():
            each = np.array([len(x) for x in ks], "i8")
            k, of = np.concatenate(ks).view("i8"), np.repeat(np.arange(len(ks)), each)
            order = np.argsort(k)
            k, of = k[order], of[order]
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            several = np.zeros(len(k), bool)
            several[1:] |= ~first[1:]
            several[:-1] |= ~first[1:]
            seq = np.array(seqs, "i8")
            count = np.bincount(of[several], minlength=len(ks))
            one, many = ~several, several & first
            return {
                "k": np.concatenate([k[one], k[many], seq]),
                "seq1": np.concatenate([seq[of[one]], np.zeros(many.sum(), "i8"), seq]),
                "c": np.concatenate([np.full(one.sum(), KEY), np.full(many.sum(), SHARED), count]).astype("i4"),
            }

        for batch in batches:
            for body in batch.column("body").to_pylist():
                tokens = body.lower().split()
                whole = xxhash.xxh3_128_digest(b" ".join(tokens))
                if not tokens or whole in seen:
                    continue
                seen.add(whole)
                s = shingles_of(tokens, words)
                m = least_overlap(len(s), percent)
                ks.append(s[: len(s) - m + min(m, len(s) // 12 + 2)])
                seqs.append(int.from_bytes(whole[:8], "little", signed=True))
                size += len(ks[-1])
                if size >= GATHERED:
                    yield out()
                    ks, seqs, seen, size = [], [], set(), 0
        if ks:
            yield out()

    return mapped(rows(docs).select(F.col("body").cast("binary").alias("body")), work, "k long, seq1 long, c int")


def alive(docs: DataFrame, first: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of first (by word sequence) whose document shares enough of its first shingles to be linked."""
    same = Window.partitionBy("k")
    told = first_keys(docs, words, percent).withColumn("shared", F.min("seq1").over(same) != F.max("seq1").over(same))
    # every block that holds a sequence counts all its shared keys, so the sum is that number for each block
    met = F.when(F.col("c") >= 0, F.col("c")).when((F.col("c") == KEY) & F.col("shared"), 1).otherwise(0)
    told = told.select("seq1", met.alias("met"), (F.col("c") >= 0).alias("block")).where("met > 0 or block")
    counts = told.groupBy("seq1").agg(F.sum("met").alias("met"), F.count_if("block").alias("blocks"))
    return first.join(counts, "seq1").where("met >= least * blocks").drop("met", "blocks")


def sketch_place() -> Column:
    return F.pmod(F.xxhash64("did", "row_hash"), F.lit(SKETCH))


def sketch_of(chosen: DataFrame) -> np.ndarray:
    """A bit for the hash of each row of chosen, as bytes; built by groups in Spark, of one size for every input."""
    place = chosen.select(sketch_place().alias("h")).select(F.floor(F.col("h") / GROUP).alias("part"), (F.col("h") % GROUP).alias("bit"))
    out = np.zeros(SKETCH // 8, np.uint8)
    for part, bits in place.groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():
        out[part * GROUP // 8 : (part + 1) * GROUP // 8] = np.frombuffer(bits, np.uint8)
    return out


def likely_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """did, row_hash, packed (compressed text) of the rows of docs that the sketch of chosen does not rule out.

    This only lessens what the next exchange carries: with tens of millions of chosen rows the sketch fills up, and
    more texts pass. Whether a row is chosen is decided by the join that follows.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(sketch_of(chosen))

    def work(batches):
        compress = zstandard.ZstdCompressor(level=5).compress
        for batch in batches:
            h = numbers(batch, "h")
            own = batch.filter(pa.array((sketch.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
            packed = pa.array([compress(b) for b in own.column("body").to_pylist()], pa.binary())
            yield {"did": own.column("did"), "row_hash": own.column("row_hash"), "packed": packed}

    return mapped(keyed(docs).withColumn("h", sketch_place()), work, "did long, row_hash long, packed binary")


def whole_sets(docs: DataFrame, chosen: DataFrame, words: int = WORDS) -> DataFrame:
    """node, members (distinct hashes), bits (parity bitmap) of the rows in chosen (did, row_hash, node)."""

    def work(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = batch.column("packed").to_pylist()
            for i in range(0, len(texts), 500):
                sets = [shingles(unpack(b), words) for b in texts[i : i + 500]]
                edges = np.cumsum([0, *map(len, sets)]).astype("i4")
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                bits = np.zeros((len(sets), 64 * BITMAP), np.uint8)
                for k, x in enumerate(sets):
                    bits[k] = np.bincount((x >> np.uint64(11)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
                packed = np.packbits(bits, axis=1).view("<i8")
                yield {
                    "node": batch.column("node").slice(i, 500),
                    "members": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat.view("i8"))),
                    "bits": pa.ListArray.from_arrays(pa.array(np.arange(0, packed.size + 1, BITMAP, "i4")), pa.array(packed.ravel())),
                }

    texts = likely_texts(docs, chosen).join(chosen, ["did", "row_hash"]).select("node", "packed")
    return mapped(texts, work, "node long, members array<bigint>, bits array<bigint>")


def with_frequency(keys: DataFrame) -> DataFrame:
    """k, node, n, f: the rows whose shingle others hold, and by how many rows it is held.

    Rows are range-partitioned by shingle and document, so a frequent shingle spreads. The first and last shingle of a
    partition may go on in its neighbours; they count as MANY, which is one order for all documents as well.
    """

    def work(batches):
        first = last = None  # the key at the partition's beginning; the rows of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: numbers(batch, c) for c in ("k", "node", "n")}
            first = cols["k"][0] if first is None else first
            if last is not None:
                cols = {c: np.concatenate([last[c], v]) for c, v in cols.items()}
            k = cols["k"]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            f = np.diff(np.r_[start, len(k)])
            f[k[start] == first] = MANY
            done = start[-1] if f[-1] != MANY else len(k)
            f = np.repeat(f, np.diff(np.r_[start, len(k)]))[:done]
            last = {c: v[done:] for c, v in cols.items()} if done < len(k) else None
            yield {c: v[:done][f > 1] for c, v in cols.items()} | {"f": f[f > 1].astype("i4")}
        if last is not None:
            yield last | {"f": np.full(len(last["k"]), MANY, "i4")}

    return mapped(keys.repartitionByRange("k", "node").sortWithinPartitions("k", "node"), work, "k long, node long, n int, f int")


def rooted(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """cell (the shingle), node, n, place: the prefixes in the order of frequency; place counts from 1."""
    counted = with_frequency(sets.select("node", F.size("members").alias("n"), F.explode("members").alias("k")))
    mine = Window.partitionBy("node")
    ranked = counted.withColumn("nth", F.dense_rank().over(mine.orderBy("f", "k")))
    # shingles without rows are held by no other document and come first
    placed = ranked.withColumn("place", F.expr("n + nth") - F.max("nth").over(mine))
    return placed.where(f"place <= n - ceil({percent} * n / 100) + 1").select(F.col("k").alias("cell"), "node", "n", "place").distinct()


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, both: the exact overlap of each pair's sets, with their sizes nx, ny; sets stream through the joins."""
    needed_ = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    sets = sets.select("node", "members").join(needed_, "node", "left_semi")
    joined = pairs.join(sets.select(F.col("node").alias("x"), F.col("members").alias("sx")), "x")
    joined = joined.join(sets.select(F.col("node").alias("y"), F.col("members").alias("sy")), "y")
    size = lambda c: F.size(c).cast("long")
    # rows that repeat an id and a text give a pair twice
    return joined.select("x", "y", size(F.array_intersect("sx", "sy")).alias("both"), size("sx").alias("nx"), size("sy").alias("ny")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of edges (u, v) reaches; by large-star and small-star steps."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(mark) or not mark[0]:
            break
        state = tuple(mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u != v").distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def alike(percent: int) -> str:
    """Whether a and b, with their sizes and bitmaps, may be linked."""
    differ = " + ".join(f"bit_count(a.bits[{i}] ^ b.bits[{i}])" for i in range(BITMAP))
    return f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) and {100 + percent} * ({differ}) <= {100 - percent} * (a.n + b.n)"


def open_cells(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """cells with root, the group of each node by roots (see components), without the cells that hold one group only."""
    rooted_ = cells.drop("root").join(roots.withColumnRenamed("node", "member"), F.expr("node = member"), "left")
    rooted_ = rooted_.drop("member").withColumn("root", F.coalesce("root", "node"))
    several = rooted_.groupBy("cell").agg(F.min("root").alias("lowest"), F.max("root").alias("highest")).where("lowest != highest")
    return rooted_.join(several.select("cell"), "cell")


def counted(cells: DataFrame) -> DataFrame:
    """cells, written, with g, the number of rows of a cell, and apart, the number of its ordered pairs of different groups."""
    cells = written(cells, "cells")
    sizes = cells.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("m"))
    return cells.join(sizes.groupBy("cell").agg(F.sum("m").alias("g"), F.expr("sum(m) * sum(m) - sum(m * m)").alias("apart")), "cell")


def outermost(cells: DataFrame) -> DataFrame:
    """cells without those whose nodes all have one and the same other cell at the place before.

    Such a cell lies in that other one, and the first shingle that two nodes share never roots it.
    """
    before = cells.withColumn("before", F.lag("cell").over(Window.partitionBy("node").orderBy("place")))
    ends = before.groupBy("cell").agg(F.min("before").alias("low"), F.max("before").alias("high"), F.count_if(F.isnull("before")).alias("starts"))
    return cells.join(ends.where("starts > 0 or low != high").select("cell"), "cell")


def band_edges(percent: int) -> list[int]:
    """The least set size of each band: sets that may be linked are in one band or in neighbouring ones."""
    edges = [1]
    while edges[-1] < 2**31:
        edges.append(max(edges[-1] * 100 // percent, edges[-1] * 5 // 4) + 1)
    return edges


def unlinked_pairs(cells: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """x < y: the pairs of each cell that may be linked, are not in one group, and have a document at home there."""
    columns = ["cell", "node", "n", "place", "bits", "root", "home", "far"]
    near = f"abs(a.far - b.far) <= {1 - percent / 100 + 1e-9}"
    places = f"{100 + percent} * (1 + least(a.n - a.place, b.n - b.place)) >= {percent} * (a.n + b.n)"
    once = "(a.home or b.home) and (a.band < b.band or a.node < b.node)"
    edges = ", ".join(f"{e}L" for e in band_edges(percent))
    cells = cells.join(bits.select("node", "bits"), "node").select(*columns, F.expr(f"aggregate(array({edges}), 0, (i, e) -> i + int(e <= n))").alias("band"))
    # a set meets those of its own band and the larger ones of the next
    larger = cells.withColumn("met", F.explode(F.array("band", F.col("band") - 1)))
    joined = cells.alias("a").join(larger.alias("b"), F.expr(f"a.cell = b.cell and a.band = b.met and a.root != b.root and {once} and {near} and {places} and {alike(percent)}"))
    return joined.selectExpr("least(a.node, b.node) as x", "greatest(a.node, b.node) as y")


def distances(cells: DataFrame, pivots: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y (a pivot of a cell that x is in), both, nx, ny, far."""
    ask = cells.join(pivots, "cell").where("node != pivot").select(F.col("node").alias("x"), F.col("pivot").alias("y")).distinct()
    got = overlaps(written(ask, "pivot-pairs"), sets)
    return written(got.withColumn("far", F.expr("1 - both / (nx + ny - both)")), "distances")


def linked(got: DataFrame, percent: int) -> DataFrame:
    return got.where(f"100 * both >= {percent} * (nx + ny - both)").select(F.col("x").alias("u"), F.col("y").alias("v"))


def links(docs: DataFrame, first: DataFrame, words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD, rounds: int = ROUNDS) -> DataFrame:
    """u, v: links between the nodes of first that join every group of linked ones; not all pairs of a group."""
    chosen = written(alive(docs, first, words, percent).select("did", "row_hash", "node"), "may-be-linked")
    sets = written(whole_sets(docs, chosen, words), "sets")
    bits = written(sets.select("node", F.size("members").alias("n"), "bits").distinct(), "bitmaps")
    cells = written(rooted(sets, percent), "prefixes")
    regions = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("g"), F.min("node").alias("pivot")).where("g > 1")
    cells = written(outermost(written(cells.join(regions, "cell"), "regions")), "outermost-regions")
    ask = cells.where("node != pivot").select("node", "pivot").distinct()
    ask = ask.join(bits.alias("a"), "node").join(bits.alias("b"), F.expr("pivot = b.node")).where(alike(percent)).select(F.col("a.node").alias("x"), F.col("pivot").alias("y"))
    roots = components(linked(overlaps(written(ask, "pivot-pairs"), sets), percent))
    cells = open_cells(cells.withColumn("old", F.expr("node = pivot")).drop("pivot", "g"), roots)
    cells = counted(cells.withColumn("home", F.lit(True)).withColumn("far", F.lit(0.0)).withColumn("was", F.lit(2**62)))
    candidates = []
    for _ in range(rounds):
        # another round only where the last one has left at most half of the pairs
        again = (F.col("g") >= crowd) & (F.col("apart") <= F.col("was") / 2)
        candidates.append(unlinked_pairs(cells.where(~again), bits, percent))
        cells = cells.where(again).drop("was").withColumnRenamed("apart", "was")
        if not cells.limit(1).count():
            break
        cells, new = divided(cells, sets, percent)
        roots = components(as_links(roots).unionByName(new))
        cells = counted(open_cells(cells, roots))
    else:
        candidates.append(unlinked_pairs(cells, bits, percent))
    exact = overlaps(written(union(candidates).distinct(), "candidates"), sets)
    return as_links(roots).unionByName(linked(exact, percent))


def as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def divided(cells: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The Voronoi cells of further pivots in each cell that they lighten, the other cells whole; and the links to those pivots.

    A cell whose nodes have all been pivots is done and goes.
    """
    groups = cells.groupBy("cell", "root").agg(F.min(F.when(~F.col("old"), F.col("node"))).alias("pivot"), F.count(F.lit(1)).alias("members"))
    smallest = Window.partitionBy("cell").orderBy("members", "pivot")
    pivots = groups.where("pivot is not null").withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= PIVOTS)
    pivots = written(pivots.select("cell", "pivot"), "pivots")
    got = distances(cells, pivots, sets)
    far = got.select(F.col("x").alias("node"), F.col("y").alias("pivot"), F.col("far").alias("away"))
    reach = cells.join(pivots, "cell").join(far, ["node", "pivot"], "left").withColumn("away", F.coalesce("away", F.lit(0.0)))
    each = Window.partitionBy("cell", "node")
    reach = reach.withColumn("nearest", F.min(F.struct("away", "pivot")).over(each)).withColumn("pivots", F.collect_set("pivot").over(each))
    reach = written(reach.where(F.col("away") <= F.col("nearest.away") + 2 * (1 - percent / 100) + 1e-9), "reach")
    sizes = reach.groupBy("cell", "pivot").agg(F.count(F.lit(1)).alias("size"), F.first("g").alias("g"))
    light = sizes.groupBy("cell").agg((2 * F.sum(F.col("size") * F.col("size")) <= F.first("g") * F.first("g")).alias("light"))
    reach = reach.join(light, "cell").withColumn("old", F.expr("old or array_contains(pivots, node)"))
    whole = reach.where(~F.col("light") & (F.col("pivot") == F.col("nearest.pivot")))
    # a document of another cell stays a guest wherever it goes
    parts = reach.where("light").withColumn("home", F.col("home") & (F.col("pivot") == F.col("nearest.pivot")))
    parts = parts.withColumn("cell", F.xxhash64("cell", "pivot")).withColumn("far", F.col("away"))
    return whole.unionByName(parts).drop("away", "nearest", "pivots", "pivot", "light", "g"), linked(got, percent)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The rows with an id, those without one and their number as ``node``, all columns; and the least number.

    Rows without an id are written once, so that their numbers stay; they follow the order of reading.
    """
    own = F.col("doc_id").cast("long")
    largest = docs.agg(F.max(own)).first()[0]
    base = BEYOND if largest is None else max(BEYOND, largest + 1)
    node = node_name(docs)
    lone = written(docs.where(own.isNull()).withColumn(node, F.monotonically_increasing_id()), "rows-without-id")
    top = lone.agg(F.max(node)).first()[0]
    if top is not None and base + top > NO_ID:
        raise ValueError(f"no room for rows without an id beyond doc_id {largest}")
    return docs.where(own.isNotNull()), lone.withColumn(node, F.col(node) + F.lit(base)), base


def node_name(docs: DataFrame) -> str:
    """A name that no column of docs has."""
    taken, name = {c.lower() for c in docs.columns}, "node"
    while name in taken:
        name += "_"
    return name


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD, rounds: int = ROUNDS) -> DataFrame:
    """did, row_hash, n_shingles, component of every row of docs, whose ids are not null."""
    head = written(heads(docs, words, percent), "heads")
    some = head.where("n > 0")
    first = some.groupBy("seq1", "seq2").agg(F.min(F.struct("did", "row_hash", "n", "least")).alias("rep"))
    first = written(first.select("seq1", "seq2", "rep.*").withColumn("node", F.monotonically_increasing_id()), "word-sequences")
    own = written(some.join(first.select("seq1", "seq2", "node"), ["seq1", "seq2"]).select("did", "node").distinct(), "own-sequences")
    # a document with several rows joins their word sequences
    least = own.groupBy("did").agg(F.min("node").alias("v"), F.max("node").alias("top"))
    joins = own.join(least.where("v != top"), "did").select(F.col("node").alias("u"), "v")
    roots = components(links(docs, first, words, percent, crowd, rounds).unionByName(joins))
    roots = written(first.select("did", "node").join(roots, "node", "left").select("did", "node", F.coalesce("root", "node").alias("root")), "roots")
    names = roots.groupBy("root").agg(F.min("did").alias("component"))
    named = least.select("did", F.col("v").alias("node")).join(roots.select("node", "root").join(names, "root"), "node").select("did", "component")
    return head.join(named, "did", "left").select("did", "row_hash", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "did").alias("component"))


def as_documents(named: DataFrame, lone: DataFrame) -> DataFrame:
    """doc_id, text of the rows that numbered() returns, with the numbers as ids."""
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(lone.select(F.col(lone.columns[-1]).alias("doc_id"), "text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    named, lone, base = numbered(docs.select("doc_id", "text"))
    shown = lambda c: F.when(F.col(c) < base, F.col(c))
    return grouped(as_documents(named, lone)).select(shown("did").alias("doc_id"), "n_shingles", shown("component").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose document is the smallest of its group."""
    named, lone, _ = numbered(docs)
    gone = written(grouped(as_documents(named, lone)).where("did != component").select("did").distinct(), "near-copies")
    node = lone.columns[-1]
    kept = named.join(gone, named["doc_id"].cast("long") == gone["did"], "left_anti")
    return kept.unionByName(lone.join(gone, lone[node] == gone["did"], "left_anti").drop(node))
