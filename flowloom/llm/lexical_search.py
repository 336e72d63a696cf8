"""Ranked lexical search by presence masks.

1. One pass over the texts turns each block of documents into postings of the items' terms (term, document,
   occurrences), a written table. The block also says how many documents and terms it has, and how many of its
   documents hold each term; their sums are N, L and df, over all documents.
2. In a block, every item's documents are grouped by their mask, a bitmap of the item's terms that they hold. The most
   that a document with a mask can score is the sum, over the mask's terms, of the weight times the block's highest
   value of the term. Masks are evaluated from the highest such sum down. When as many documents as wanted score more
   than the next mask can, the rest of the block is done with.
3. A task keeps its best documents for each item from block to block, so later blocks stop sooner. What the tasks keep
   is ranked in two steps, by item and a part of the tasks and then by item.

Items are a stated query set. They are taken in groups of a bounded number of terms, each with a pass of its own, so
what is broadcast (terms, weights) does not grow with the documents or with the number of items.

Nulls and texts without terms match nothing and are not counted in N. Rows that repeat a doc_id or an item_id are
documents or items of their own. A null doc_id is last among equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.arrow import mapped
from flowloom.llm.common import rows, shown_id, written

WANTED = 20
#: Terms of the items that one pass over the documents takes, and the documents and terms of a block.
GROUP_TERMS, BLOCK_DOCS, BLOCK_TERMS = 200_000, 8192, 2_000_000
#: Documents that are evaluated at a time (or one mask's); parts of the tasks' results that are ranked first.
AT_ONCE, PARTS = 64, 256
#: ASCII letters in lower case and digits stay, other ASCII characters part the terms, all other bytes stay.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def groups(items: DataFrame, limit: int) -> Iterator[list[tuple[int, Counter]]]:
    """Items (number, terms with their repeats) in groups of at most limit terms, or one item."""
    group, size = [], 0
    for row in items.select("number", F.col("text").cast("binary").alias("text")).toLocalIterator():
        terms = Counter(terms_of(bytes(row.text or b"")))
        if group and size + len(terms) > limit:
            yield group
            group, size = [], 0
        group.append((row.number, terms))
        size += len(terms)
    if group:
        yield group


def blocks_of(docs: DataFrame, terms: list[bytes], block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """A row for each block of documents; see the module's first step. Documents without any term are left out."""
    number = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def work(batches):
        get = number.value.get
        dids, sizes, found, held_terms = [], [], [], 0

        def block():
            ids = np.concatenate(found)
            doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
            keys, tf = np.unique(ids.astype("i8") * len(found) + doc, return_counts=True)
            term = keys // len(found)
            held, df = np.unique(term, return_counts=True)
            columns = {"dids": (dids, "i8"), "sizes": (sizes, "i8"), "term": (term, "i4"), "doc": (keys % len(found), "i4"), "tf": (tf, "i8"), "held": (held, "i4"), "df": (df, "i8")}
            return {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(np.array(v, kind))) for c, (v, kind) in columns.items()}

        for batch in batches:
            for did, body in zip(batch.column("did").to_pylist(), batch.column("body").to_pylist()):
                words = terms_of(body)
                if not words:
                    continue
                ids = np.fromiter((get(w, -1) for w in words), "i4", len(words))
                dids.append(did)
                sizes.append(len(words))
                found.append(ids[ids >= 0])
                held_terms += len(found[-1])
                if len(dids) >= block_docs or held_terms >= block_terms:
                    yield block()
                    dids, sizes, found, held_terms = [], [], [], 0
        if dids:
            yield block()

    return mapped(
        rows(docs).select("did", F.col("body").cast("binary").alias("body")),
        work,
        "dids array<bigint>, sizes array<bigint>, term array<int>, doc array<int>, tf array<bigint>, held array<int>, df array<bigint>",
    )


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The wanted best documents of an item so far: score down, id up."""

    def __init__(self, wanted: int):
        self.wanted, self.scores, self.dids = wanted, np.zeros(0, "i8"), np.zeros(0, "i8")

    def floor(self) -> int:
        """What a document must score at least to matter."""
        return int(self.scores[-1]) if len(self.scores) == self.wanted else 1

    def add(self, scores: np.ndarray, dids: np.ndarray) -> None:
        at = scores >= self.floor()
        scores, dids = np.concatenate([self.scores, scores[at]]), np.concatenate([self.dids, dids[at]])
        order = np.lexsort((dids, -scores))[: self.wanted]
        self.scores, self.dids = scores[order], dids[order]


def search_block(best: Best, item: list[tuple[int, int]], dids: np.ndarray, postings: dict) -> int:
    """Adds the block's documents to best; returns how many were evaluated.

    item: (term, weight times repeats); postings: term to (documents, values, highest value).
    """
    item = [(t, w) for t, w in item if w and t in postings]
    if not item:
        return 0
    masks = np.zeros((len(dids), -(-len(item) // 8)), np.uint8)
    for j, (t, _) in enumerate(item):
        masks[postings[t][0], j >> 3] |= 1 << (j & 7)
    some = np.flatnonzero(masks.any(axis=1))
    distinct, group = np.unique(masks[some].view(f"V{masks.shape[1]}").ravel(), return_inverse=True)
    bits = np.unpackbits(distinct.view(np.uint8).reshape(len(distinct), -1), axis=1, bitorder="little")[:, : len(item)]
    most = bits.astype("i8") @ np.array([w * postings[t][2] for t, w in item], "i8")
    down = np.argsort(-most, kind="stable")
    place = np.empty(len(down), "i8")
    place[down] = np.arange(len(down))
    some = some[np.argsort(place[group], kind="stable")]  # documents in the order of their masks
    ends = np.cumsum(np.bincount(place[group], minlength=len(down)))
    at = evaluated = 0
    while at < len(down) and most[down[at]] >= best.floor():
        upto = max(at + 1, int(np.searchsorted(ends, evaluated + AT_ONCE, "right")))
        chosen = np.sort(some[evaluated : ends[upto - 1]])
        scores = np.zeros(len(chosen), "i8")
        for t, w in item:
            docs, values, _ = postings[t]
            k = np.minimum(np.searchsorted(docs, chosen), len(docs) - 1)
            scores += np.where(docs[k] == chosen, w * values[k], 0)
        best.add(scores, dids[chosen])
        at, evaluated = upto, int(ends[upto - 1])
    return evaluated


def best_of_tasks(blocks: DataFrame, items: list[tuple[int, list[tuple[int, int]]]], documents: int, length: int, wanted: int) -> DataFrame:
    """number, did, score: the wanted best of each item in each task."""
    shared = blocks.sparkSession.sparkContext.broadcast(items)

    def work(batches):
        best = {number: Best(wanted) for number, _ in shared.value}
        for batch in batches:
            for k in range(batch.num_rows):
                dids, sizes, term, doc, tf = (batch.column(c)[k].values.to_numpy() for c in ("dids", "sizes", "term", "doc", "tf"))
                mass = 100 - 25 + 25 * sizes * documents // length
                values = 1_000_000_000 * tf // (1000 * tf + 12 * mass[doc])
                starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else []
                ends = [*starts[1:], len(term)]
                postings = {int(term[a]): (doc[a:b], values[a:b], int(values[a:b].max())) for a, b in zip(starts, ends)}
                for number, item in shared.value:
                    search_block(best[number], item, dids, postings)
        for number, b in best.items():
            yield {"number": np.full(len(b.dids), number, "i8"), "did": b.dids, "score": b.scores}

    return mapped(blocks.select("dids", "sizes", "term", "doc", "tf"), work, "number long, did long, score long")


def search(docs: DataFrame, items: DataFrame, wanted: int = WANTED, group_terms: int = GROUP_TERMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the wanted best documents of each item."""
    items = written(items.select("item_id", "text").withColumn("number", F.monotonically_increasing_id()), "items")
    found = None
    for group in groups(items, group_terms):
        terms = sorted({t for _, counts in group for t in counts})
        number = {t: k for k, t in enumerate(terms)}
        blocks = written(blocks_of(docs, terms, block_docs), "postings")
        documents, length = blocks.agg(F.sum(F.size("dids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
        if not documents:
            continue
        pairs = blocks.select(F.explode(F.arrays_zip("held", "df")).alias("p")).groupBy("p.held").agg(F.sum("p.df").alias("df"))
        weights = {t: weight(documents, df) for t, df in pairs.collect()}  # at most group_terms rows
        weighed = [(k, [(number[t], weights[number[t]] * q) for t, q in counts.items() if number[t] in weights]) for k, counts in group]
        best = best_of_tasks(blocks, weighed, documents, length, wanted)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "number long, did long, score long")
    order = [F.desc("score"), F.asc("did")]
    part = Window.partitionBy("number", "part").orderBy(*order)
    first = found.withColumn("part", F.spark_partition_id() % PARTS).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= wanted)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= wanted)
    return ranked.join(items.select("number", "item_id"), "number").select("item_id", "rank", shown_id("did").alias("doc_id"), "score")


def oracle() -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with d as (select doc_id, {terms} terms from documents), k as (select count(*) filter (where len(terms) > 0) n_docs, sum(len(terms))::bigint n_terms from d),
 t as (select doc_id, len(terms)::bigint n, unnest(terms) term from d), f as (select doc_id, n, term, count(*) tf from t group by all), g as (select term, count(*) df from f group by term),
 q as (select item_id, unnest({terms}) term from benchmark),
 s as (select item_id, doc_id, sum(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint score
  from q join f using (term) join g using (term) cross join k group by item_id, doc_id),
 r as (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from s where score > 0)
select item_id, rank::int rank, doc_id, score from r where rank <= {WANTED}
"""
