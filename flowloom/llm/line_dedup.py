"""Line dedup by range-partitioned line hashes, returning keep bitmaps.

1. Every line of at least ``min_chars`` code points (stripped, A-Z lower-cased) becomes a row (128-bit hash,
   document, position). Texts do not leave the map stage.
2. The rows are range-partitioned by (hash, document) and sorted within partitions by (hash, document,
   position). A hot line therefore spreads over as many partitions as its rows need.
3. Each partition streams its runs of equal hashes. The first document of a run owns the line; rows of other
   documents are drops. A run that starts before its partition has its owner elsewhere: its rows are
   handed on undecided, and each partition also tells its first and last run. These edges (two rows a
   partition, so a broadcast bounded by the number of partitions) decide the rest.
4. Drops are gathered by document into a zlib-compressed bitmap of the lines to keep, up to the last dropped
   line; lines beyond it stay. A document without drops has no row.

Null and empty texts are one empty line, which is too short to be dropped. Lines of one document never
displace each other. Rows that repeat a doc_id are one document for ownership; each keeps its own bitmap.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrow import OUT_ROWS, changed_texts, mapped, numbers
from flowloom.llm.common import rows, shown_id, written

MIN_CHARS = 10


def long_enough(key: bytes, chars: int) -> bool:
    """Whether the UTF-8 bytes hold at least so many code points."""
    return len(key) >= chars and (len(key) >= 4 * chars or sum((b & 0xC0) != 0x80 for b in key) >= chars)


def keyed(docs: DataFrame) -> DataFrame:
    """did, row_hash, body (binary)."""
    return rows(docs).select("did", F.xxhash64("body").alias("row_hash"), F.col("body").cast("binary").alias("body"))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    def work(batches):
        for batch in batches:
            hashes, ids, hs, at = bytearray(), [], [], []
            for did, row_hash, body in zip(*(batch.column(c).to_pylist() for c in ("did", "row_hash", "body"))):
                for k, line in enumerate(body.split(b"\n")):
                    key = line.strip().lower()
                    if long_enough(key, min_chars):
                        hashes += xxhash.xxh3_128_digest(key)
                        ids.append(did)
                        hs.append(row_hash)
                        at.append(k)
            pair = np.frombuffer(bytes(hashes), dtype="<i8").reshape(-1, 2)
            yield {"h1": pair[:, 0].copy(), "h2": pair[:, 1].copy(), "did": np.array(ids, "i8"), "row_hash": np.array(hs, "i8"), "at": np.array(at, "i4")}

    return mapped(keyed(docs), work, "h1 long, h2 long, did long, row_hash long, at int")


def first_occurrences(lines: DataFrame) -> DataFrame:
    """kind 0: a drop; 1: a row of the partition's first run; 2: an edge, the first row of the first or last run."""

    def work(batches):
        run = owner = first = None

        def out(kind, cols, where):
            return {"kind": np.full(int(where.sum()), kind, "i4")} | {c: v[where] for c, v in cols.items()}

        def edge(key, did):
            return {"kind": np.array([2], "i4"), "h1": np.array(key[:1], "i8"), "h2": np.array(key[1:], "i8"), "did": np.array([did], "i8"), "row_hash": np.zeros(1, "i8"), "at": np.zeros(1, "i4")}

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: numbers(batch, c) for c in ("h1", "h2", "did", "row_hash", "at")}
            h1, h2, did = cols["h1"], cols["h2"], cols["did"]
            start = np.ones(len(h1), bool)
            start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if run is None:
                first = (int(h1[0]), int(h2[0]))
                yield edge(first, int(did[0]))
            start[0] = run != (int(h1[0]), int(h2[0]))
            index = np.maximum.accumulate(np.where(start, np.arange(len(h1)), -1))
            own = np.where(index >= 0, did[np.maximum(index, 0)], 0 if owner is None else owner)
            opened = (h1 == first[0]) & (h2 == first[1])
            yield out(0, cols, ~opened & (did != own))
            yield out(1, cols, opened)
            run, owner = (int(h1[-1]), int(h2[-1])), int(own[-1])
        if run is not None:
            yield edge(run, owner)

    ordered = lines.repartitionByRange("h1", "h2", "did", "row_hash", "at").sortWithinPartitions("h1", "h2", "did", "row_hash", "at")
    return mapped(ordered, work, "kind int, h1 long, h2 long, did long, row_hash long, at int")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """did, row_hash, at of every line that goes."""
    found = written(first_occurrences(line_rows(docs, min_chars)), "line-runs")
    edges = found.where("kind = 2").groupBy("h1", "h2").agg(F.min("did").alias("owner"))
    late = found.where("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).where("did > owner")
    return found.where("kind = 0").select("did", "row_hash", "at").unionByName(late.select("did", "row_hash", "at"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """did, row_hash, keep: the compressed bitmap of a document's lines, 1 for a line that stays."""

    def work(batches):
        for batch in batches:
            packed = []
            for at in batch.column("drops").to_pylist():
                bits = np.ones(max(at) + 1, np.uint8)
                bits[at] = 0
                packed.append(zlib.compress(len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()))
            yield {"did": batch.column("did"), "row_hash": batch.column("row_hash"), "keep": pa.array(packed, pa.binary())}

    drops = dropped_lines(docs, min_chars).groupBy("did", "row_hash").agg(F.collect_set("at").alias("drops"))
    return mapped(drops, work, "did long, row_hash long, keep binary")


def kept_lines(body: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The lines that stay, the number of lines, the number dropped."""
    lines = body.split(b"\n")
    if keep is None:
        return body, len(lines), 0
    raw = zlib.decompress(keep)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little"))
    left = [line for line, bit in zip(lines, bits) if bit] + lines[len(bits):]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """did, row_hash, text, n_lines, n_dropped: every row with the lines it keeps."""

    def work(batches):
        for batch in batches:
            done = [kept_lines(b, k) for b, k in zip(batch.column("body").to_pylist(), batch.column("keep").to_pylist())]
            for i in range(0, len(done), OUT_ROWS):
                part = done[i : i + OUT_ROWS]
                yield {
                    "did": batch.column("did").slice(i, OUT_ROWS),
                    "row_hash": batch.column("row_hash").slice(i, OUT_ROWS),
                    "text": pa.array([x[0] for x in part], pa.binary()).cast(pa.string()),
                    "n_lines": np.array([x[1] for x in part], "i8"),
                    "n_dropped": np.array([x[2] for x in part], "i8"),
                }

    maps = keep_bitmaps(docs, min_chars)
    return mapped(keyed(docs).join(maps, ["did", "row_hash"], "left"), work, "did long, row_hash long, text string, n_lines long, n_dropped long")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, all columns, with only the lines that stay in text."""
    return changed_texts(docs, keep_bitmaps(docs, min_chars), lambda body, keep: kept_lines(body, keep)[0])


def line_digests(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select(shown_id("did").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def oracle() -> str:
    return r"""
with d as (select doc_id, coalesce(text, '') body from documents),
 l as (select doc_id, unnest(string_split(body, chr(10))) line, generate_subscripts(string_split(body, chr(10)), 1) p from d),
 k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
 o as (select *, min(doc_id) over (partition by key) owner from k),
 m as (select *, length(key) < 10 or doc_id = owner stays from o)
select doc_id, count(*) n_lines, count(*) filter (not stays) n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by p) filter (stays), '')) kept_sha256 from m group by doc_id
"""
