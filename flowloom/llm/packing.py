"""Best-fit packing: best-two-fit over the histogram of piece lengths.

1. Tasks tokenize whole texts and cut them into pieces: a document longer than a sequence gives full pieces,
   the first of them shorter. A piece is a small row; ids are not shuffled.
2. Only lengths matter to the packing, and a length is at most ``size``. So the driver gets a histogram of at
   most ``size`` counts, whatever the corpus, and runs best-two-fit on it: fill a bin greedily with the
   longest pieces that fit; then replace its shortest piece by the two unpacked pieces that fit the gap,
   widened by that piece, more tightly. A filled bin is a pattern of lengths, and the next bins repeat it
   exactly until one of its lengths runs out, so a pattern is applied as often as that at once. The
   number of patterns is bound by the number of lengths, not by the number of documents.
3. Pieces are range-partitioned and sorted by length. A piece's rank is the rank in its partition plus the
   sizes of the partitions before it (one count a partition). The rank finds the pattern, copy and offset by
   binary search. A length that a third of all pieces share spreads over many partitions.

A string that the tokenizer's file adds to its vocabulary, such as an end mark, is one id where it stands in a text.
Null and empty texts are the single id 0. Every row of docs is packed, also those that repeat a doc_id.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrow import mapped, numbers
from flowloom.llm.common import rows, shown_id, written
from flowloom.llm.tokens import RANKS, TOKENIZER, Encoder, added_tokens

SIZE = 2048
END = b"\0\0\0\0"


def pieces(docs: DataFrame, size: int = SIZE, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """did, piece, start, length, crc and, if asked for, the packed ids of each piece."""

    added = added_tokens(TOKENIZER)

    def work(batches):
        encoder = Encoder(ranks, added=added)
        for batch in batches:
            out = {c: [] for c in ("did", "piece", "start", "length", "crc", "ids")}
            for did, body in zip(batch.column("did").to_pylist(), batch.column("body").to_pylist()):
                ids = memoryview(encoder.packed(body) + END)
                n = len(ids) // 4
                edges = [0, *range(n % size or size, n + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = ids[4 * a : 4 * b]
                    for c, v in zip(out, (did, k, a, b - a, zlib.crc32(part), bytes(part) if with_ids else b"")):
                        out[c].append(v)
            yield {c: np.array(v, "i4" if c == "piece" else "i8") if c != "ids" else v for c, v in out.items()}

    schema = "did long, piece int, start long, length long, crc long"
    return mapped(rows(docs), work, schema + ", ids binary" * with_ids)


def best_two_fit(counts: np.ndarray, size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(copies, lengths) of each pattern; counts[n] pieces have length n."""
    left, plan = counts.astype(np.int64).copy(), []
    while (have := np.flatnonzero(left)).size:
        used: dict[int, int] = {}
        gap, items = size, []
        while True:
            fits = have[: np.searchsorted(have, gap, "right")]
            n = next((int(x) for x in fits[::-1] if left[x] > used.get(int(x), 0)), 0)
            if not n:
                break
            many = int(min(gap // n, left[n] - used.get(n, 0)))
            used[n] = used.get(n, 0) + many
            items += [n] * many
            gap -= n * many
        least = items[-1]
        room = gap + least
        if gap:
            free = np.array([x for x in have[: np.searchsorted(have, room)] if left[x] > used.get(int(x), 0)], dtype=np.int64)
            if free.size:
                k = np.searchsorted(free, room - free, "right") - 1
                spare = np.array([left[x] - used.get(int(x), 0) for x in free])
                k = np.where((k == np.arange(free.size)) & (spare < 2), k - 1, k)
                both = np.where(k >= 0, free + free[np.maximum(k, 0)], 0)
                best = int(np.argmax(both))
                if both[best] > least:
                    items[-1:] = sorted((int(free[best]), int(free[k[best]])), reverse=True)
        kinds, times = np.unique(items, return_counts=True)
        copies = int((left[kinds] // times).min())
        left[kinds] -= copies * times
        plan.append((copies, items))
    return plan


def slots(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For pieces ranked by length: where each run of slots begins, its first sequence, and its offset."""
    entries, base = [], 0
    for copies, items in plan:
        at = 0
        for n in items:
            entries.append((n, base, at, copies))
            at += n
        base += copies
    entries.sort()
    n, first, at, copies = (np.array(x, np.int64) for x in zip(*entries)) if entries else [np.zeros(0, np.int64)] * 4
    return {"start": np.cumsum(copies) - copies, "first": first, "at": at}


def packed(docs: DataFrame, size: int = SIZE, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """did, piece, start, length, crc, sequence_id, at (and ids): where each piece lies."""
    # written, since the range exchange reads its input twice
    cut = written(pieces(docs, size, ranks, with_ids), "pieces")
    order = ["length", "did", "piece", "start", "crc"]
    ordered = cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ordered = written(ordered, "pieces-by-length")
    part = F.shiftright("place", 33)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("part")).count().collect()}
    counts = np.zeros(size + 1, np.int64)
    for n, c in ordered.groupBy("length").count().collect():
        counts[n] = c
    before = np.zeros(max(sizes, default=0) + 2, np.int64)
    for p, c in sizes.items():
        before[p + 1] = c
    before = np.cumsum(before)
    to = slots(best_two_fit(counts, size))

    def work(batches):
        for batch in batches:
            place = numbers(batch, "place")
            rank = before[place >> 33] + (place & (2**33 - 1))
            k = np.searchsorted(to["start"], rank, "right") - 1
            yield {c: batch.column(c) for c in batch.schema.names} | {"sequence_id": to["first"][k] + rank - to["start"][k], "at": to["at"][k]}

    schema = "did long, piece int, start long, length long, crc long" + ", ids binary" * with_ids
    return mapped(ordered, work, schema + ", sequence_id long, at long")


def packed_digests(docs: DataFrame) -> DataFrame:
    return packed(docs).select(
        shown_id("did").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", F.col("at").alias("offset")
    )
