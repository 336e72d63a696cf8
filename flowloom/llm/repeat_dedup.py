"""Removal of long byte strings that an earlier document holds, exact at every byte.

A string of ``length`` bytes is routed by its minimizer: the smallest hash of the ``GRAM``-byte strings in it. Equal
strings have equal minimizers, so they meet in one bucket, wherever they lie.

1. Tasks cut texts into runs of neighbouring strings with one minimizer, and send each minimizer, as a short
   fingerprint with the smallest document that holds it, to its bucket. Buckets return those that two documents hold as
   bits of a sketch, ten for each and ``SKETCH`` bytes for all at most. This is a filter only; a false match costs work, not correctness.
2. Texts are read again where they lie, with the sketch broadcast. Strings with a shared minimizer that an earlier document of the
   same task holds are decided there. The others go to their buckets as byte runs, compressed.
3. A bucket sorts the hashes of all its strings; a class's smallest document keeps them, and the strings of other
   documents are hits. Hits return as ranges of positions.
4. Ranges are gathered by document and their bytes removed.

Both exchanges carry compressed blobs, one for each 8 MB of text and bucket, so that they stay large where buckets are
many; a string that a third of all documents hold is sent once for each 1.5 MB of text, not once for each document. Buckets grow
in number with the bytes of the input, so that one that a task holds does not grow. Strings are compared by two 64-bit hashes.

Null and empty texts, and texts shorter than ``length``, keep everything. Rows that repeat a doc_id are one
document: they never displace each other. A text is processed in segments, so its length is not bounded.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrow import OUT_ROWS, changed_texts, mapped
from flowloom.llm.common import rows, shown_id, written

LENGTH, GRAM = 50, 16
#: Bytes of text that a task works on at a time, those whose strings it sends together, and bytes of the input for each bucket.
CHUNK, SEND, BUCKET = 3 << 19, 8 << 20, 24 << 20
#: Bytes of the sketch of shared minimizers. Where it would be larger, more strings travel that no other document holds.
SKETCH = 64 << 20
#: Places that are hashed at a time.
PART = 1 << 18
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= B
    return x ^ (x >> np.uint64(29))


def loads(buf: bytes, at: int, n: int) -> np.ndarray:
    """The 8 bytes at each of n positions from at on, as integers."""
    return np.ndarray((n,), "<u8", buf, at, (1,))


def hashes(buf: bytes, n: int, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the size bytes at each of n positions, or at those given; buf has 8 bytes more."""
    h = spare = None
    factor = int(A)
    for offset in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        x = loads(buf, offset, n)
        x = x[at] if at is not None else np.array(x)
        spare = np.right_shift(x, np.uint64(31), out=spare)
        x ^= spare
        x *= np.uint64(factor)
        factor = (factor * 0xDA942042E4DD58B5 + 2) % 2**64 | 1
        h = x if h is None else np.add(h, x, out=h)
    return mix(h)


def second_hashes(buf: bytes, n: int, size: int, at: np.ndarray) -> np.ndarray:
    """Another, cheaper one, to check the first."""
    x, y, z = (loads(buf, offset, n)[at] for offset in (0, (size - 8) // 2, size - 8))
    return (x * A + y) * B + (z ^ (x >> np.uint64(7)))


class Segments:
    """Texts, or parts of long ones that overlap by length - 1 bytes, as one buffer."""

    def __init__(self, length: int):
        self.length, self.size, self.parts, self.owner, self.start = length, 0, [], [], []

    def take(self, owner: int, start: int, part: bytes) -> None:
        self.parts.append(part)
        self.owner.append(owner)
        self.start.append(start)
        self.size += len(part)

    def strings(self):
        """Of each string of the buffer: place in the buffer, segment, routing hash."""
        lens = np.array([len(p) for p in self.parts], np.int64)
        self.buf = b"".join(self.parts) + bytes(self.length + 8)
        n = int(lens.sum())
        ends = np.cumsum(lens)
        segment = np.repeat(np.arange(len(lens)), lens)
        place = np.flatnonzero(np.arange(n) + self.length <= ends[segment]) if n else np.zeros(0, np.int64)
        if not place.size:
            return place, place, place.astype(np.uint64)
        least, width, span = hashes(self.buf, n, GRAM), 1, self.length - GRAM + 1
        while 2 * width <= span:
            least[: n - width] = np.minimum(least[: n - width], least[width:])
            width *= 2
        rest = span - width
        if rest:
            least[: n - rest] = np.minimum(least[: n - rest], least[rest:])
        self.first = ends - lens
        return place, segment[place], mix(least[place])


def segmented(batches, length: int):
    """(Segments, the rows they belong to) for every CHUNK of text; a row is did, row_hash."""
    seg, owners = Segments(length), []
    for batch in batches:
        for did, row_hash, body in zip(batch.column("did").to_pylist(), batch.column("row_hash").to_pylist(), bodies_of(batch)):
            for at in range(0, max(1, len(body) - length + 1), CHUNK):
                part = body[at : at + CHUNK + length - 1]
                if len(part) < length:
                    continue
                seg.take(len(owners), at, part)
                owners.append((did, row_hash))
                if seg.size >= CHUNK:
                    yield seg, owners
                    seg, owners = Segments(length), []
    if owners:
        yield seg, owners


def planes(a: np.ndarray) -> bytes:
    """The first byte of every number, then the second ones: bytes that are alike lie side by side."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(a.size, a.itemsize).T).tobytes()


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each, with their types and lengths, compressed."""
    head = ";".join(f"{a.dtype.str}:{a.size}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=5).compress(b"".join([len(head).to_bytes(4, "little"), head, *map(planes, arrays)]))


def unblob(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, size in (x.split(":") for x in raw[4:at].decode().split(";")):
        width, size = np.dtype(kind).itemsize, int(size)
        part = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(size))
        at += part.size
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Numbers as differences, which compress where they are in order; np.cumsum gives them back."""
    return np.diff(a, prepend=a.dtype.type(0))


def starts_of(*changes: np.ndarray) -> np.ndarray:
    """Where a run begins: where any of the arrays differs from the place before."""
    new = np.ones(len(changes[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in changes])
    return np.flatnonzero(new)


def parts_of(buckets: np.ndarray):
    """Each bucket there is, and its places, in order."""
    if buckets.size:
        order = np.argsort(buckets, kind="stable")
        run = starts_of(buckets[order])
        yield from zip(buckets[order[run]].tolist(), np.split(order, run[1:]))


def by_bucket(batches):
    """(bucket, its blobs by kind) from rows sorted by bucket."""
    bucket, blobs = None, {}
    for batch in batches:
        for b, kind, data in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
            if b != bucket and bucket is not None:
                yield bucket, blobs
                blobs = {}
            bucket = b
            blobs.setdefault(kind, []).append(unblob(data))
    if bucket is not None:
        yield bucket, blobs


def joined(blobs: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*blobs)]


def sent(out: dict[str, list], bucket: int, kind: int, *arrays: np.ndarray) -> None:
    out["bucket"].append(bucket)
    out["kind"].append(kind)
    out["data"].append(blob(*arrays))


def frame(out: dict[str, list]) -> dict:
    return {"bucket": np.array(out["bucket"], "i4"), "kind": np.array(out["kind"], "i4"), "data": pa.array(out["data"], pa.binary())}


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")


BLOBS = "bucket int, kind int, data binary"


class Sketch:
    """The fingerprints of shared minimizers, as bits: a part for each bucket, as long as it needs."""

    def __init__(self, parts: Iterable[tuple[int, bytes]], buckets: int):
        self.buckets, self.size = buckets, np.zeros(buckets, np.int64)
        parts = sorted(parts)
        for bucket, bits in parts:
            self.size[bucket] = len(bits)
        self.first = np.cumsum(self.size) - self.size
        self.bits = np.frombuffer(b"".join(bits for _, bits in parts), np.uint8)

    @staticmethod
    def places(finger: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
        """Two bits for each fingerprint, of a part of size bytes."""
        return finger % (8 * size), ((finger.astype(np.uint64) * A) >> np.uint64(33)).astype(np.int64) % (8 * size)

    @classmethod
    def part(cls, finger: np.ndarray, most: int) -> bytes:
        bits = np.zeros(max(1, min(most, -(-10 * finger.size // 8))), np.uint8)
        for at in cls.places(finger, bits.size):
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return bits.tobytes()

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Whether each minimizer may be a shared one."""
        bucket, finger = (h % np.uint64(self.buckets)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64)
        found = self.size[bucket] > 0
        bucket, finger = bucket[found], finger[found]
        hit = np.ones(finger.size, bool)
        for at in self.places(finger, self.size[bucket]):
            hit &= (self.bits[self.first[bucket] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        found[found] = hit
        return found


def shared_minimizers(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, bits: the part of the Sketch of a bucket, of the minimizers in it that several documents hold."""

    def send(batches):
        held, size = [], 0
        for seg, owners in segmented(batches, length):
            place, segment, h = seg.strings()
            first = starts_of(segment, h) if place.size else place
            h, did = h[first], np.array([o[0] for o in owners], np.int64)[np.array(seg.owner, np.int64)[segment[first]]]
            held.append(((h % np.uint64(buckets)).astype(np.int64) << 32 | (h >> np.uint64(32)).astype(np.int64), did))
            size += seg.size
            if size >= SEND:
                yield frame(fingerprints(held))
                held, size = [], 0
        if held:
            yield frame(fingerprints(held))

    def fingerprints(held):
        out = {"bucket": [], "kind": [], "data": []}
        key, did = joined(held)
        order = np.argsort(key)
        key, did = key[order], did[order]
        if key.size:
            run = starts_of(key)
            least = np.minimum.reduceat(did, run)
            several = least != np.maximum.reduceat(did, run)
            key = key[run]
            for b, of in parts_of(key >> 32):
                # sorted fingerprints as differences, which compress
                sent(out, b, 0, steps(key[of] & 0xFFFFFFFF).astype("<u4"), least[of], several[of])
        return out

    def receive(batches):
        for bucket, blobs in by_bucket(batches):
            fingers, did, several = joined([[np.cumsum(f.astype(np.int64)), d, s] for f, d, s in blobs[0]])
            order = np.argsort(fingers, kind="stable")
            fingers, did, several = fingers[order], did[order], several[order]
            run = starts_of(fingers)
            many = (np.minimum.reduceat(did, run) != np.maximum.reduceat(did, run)) | np.logical_or.reduceat(several, run)
            if many.any():
                yield {"bucket": np.array([bucket], "i4"), "bits": pa.array([Sketch.part(fingers[run][many], SKETCH // buckets)], pa.binary())}

    return mapped(dealt(mapped(texts, send, BLOBS), buckets), receive, "bucket int, bits binary")


def earlier(buf: bytes, n: int, length: int, place: np.ndarray, did: np.ndarray) -> np.ndarray:
    """Whether the string at each place is also at the place of a smaller document."""
    # by parts, since a hash of all places at once holds several arrays of that length
    h1, h2 = (np.concatenate([h(buf, n, length, place[i : i + PART]) for i in range(0, place.size, PART)]) for h in (hashes, second_hashes))
    order = np.argsort(h1)
    run = starts_of(h1[order])
    other = h2[order]
    if (np.minimum.reduceat(other, run) != np.maximum.reduceat(other, run)).any():
        order = np.lexsort((h2, h1))
        run = starts_of(h1[order], h2[order])
    who = did[order]
    hit = np.zeros(place.size, bool)
    hit[order] = who > np.repeat(np.minimum.reduceat(who, run), np.diff(np.append(run, order.size)))
    return hit


def ranges(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, end) of the runs of neighbouring positions of one owner."""
    if not at.size:
        return owner, at, at
    run = starts_of(owner, at - np.arange(at.size))
    return owner[run], at[run], at[np.append(run[1:], at.size) - 1] + 1


def repeated_ranges(texts: DataFrame, length: int, buckets: int, shared: Broadcast) -> DataFrame:
    """did, row_hash, first, stop: positions first..stop-1 begin strings that a smaller document holds; shared has the Sketch."""

    def send(batches):
        held, size = [], 0
        for seg, owners in segmented(batches, length):
            held.append(chunk(seg, owners))
            size += sum(x.nbytes for x in held[-1])
            del seg, owners
            if size >= 3 * SEND:
                yield frame(runs(held))
                held, size = [], 0
        if held:
            yield frame(runs(held))

    def chunk(seg, owners):
        """did and row_hash of the rows; row, first, stop of what is decided here; bucket, place, count, row, start of the other runs; the buffer, if needed."""
        place, segment, h = seg.strings()
        did, row = np.array([o[0] for o in owners], np.int64), np.array([o[1] for o in owners], np.int64)
        if place.size:
            run = starts_of(segment, h)
            of = np.repeat(shared.value.may_hold(h[run]), np.diff(np.append(run, h.size)))
            place, segment, h = place[of], segment[of], h[of]
        none = np.zeros(0, "<i4")
        if not place.size:
            return did, row, none, place, place, none, none, none, none, place, np.zeros(0, np.uint8)
        owner = np.array(seg.owner, np.int64)[segment]
        shift = (np.array(seg.start, np.int64) - seg.first)[segment]  # from the buffer to the text
        hit = earlier(seg.buf, len(seg.buf) - length - 8, length, place, did[owner])
        o, first, stop = ranges(owner[hit], (place + shift)[hit])
        place, owner, h, shift = place[~hit], owner[~hit], h[~hit], shift[~hit]
        run = starts_of(owner, h, place - np.arange(place.size)) if place.size else none
        count = np.diff(np.append(run, place.size))
        small = [x.astype("<i4") for x in (h[run] % np.uint64(buckets), place[run], count if run.size else none, owner[run])]
        return did, row, o.astype("<i4"), first, stop, *small, place[run] + shift[run], np.frombuffer(seg.buf if run.size else b"", np.uint8)

    def runs(held):
        out = {"bucket": [], "kind": [], "data": []}
        rows_before = np.cumsum([0] + [x[0].size for x in held[:-1]])
        bytes_before = np.cumsum([0] + [x[10].size for x in held[:-1]])
        did, row, o, first, stop, bucket, place, count, owner, start, raw = joined(
            [(*x[:2], x[2] + r, *x[3:6], x[6] + b, x[7], x[8] + r, *x[9:]) for x, r, b in zip(held, rows_before, bytes_before)]
        )
        held.clear()
        for b, x in parts_of(did[o] % buckets):
            sent(out, b, 1, did[o[x]], row[o[x]], first[x], stop[x])
        for b, of in parts_of(bucket):
            c, o = count[of], owner[of]
            size = c.astype(np.int64) + length - 1
            take = np.repeat(place[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            each = starts_of(o)  # a document with several runs is named once
            sent(out, b, 0, raw[take], c, start[of], steps(did[o[each]]), row[o[each]], np.diff(np.append(each, o.size)).astype("<i4"))
        return out

    def receive(batches):
        for _, blobs in by_bucket(batches):
            for did, row, first, stop in blobs.get(1, []):
                yield {"did": did, "row_hash": row, "first": first, "stop": stop}
            if 0 not in blobs:
                continue
            raw, count, start, did, row = joined([[raw, c, s, np.repeat(np.cumsum(d), n), np.repeat(r, n)] for raw, c, s, d, r, n in blobs.pop(0)])
            size = count.astype(np.int64) + length - 1
            base = np.cumsum(size) - size
            at = np.repeat(base - (np.cumsum(count) - count), count)
            at += np.arange(at.size)
            buf, n = b"".join([raw.data, bytes(length + 8)]), raw.size
            del raw
            hit = earlier(buf, n, length, at, np.repeat(did, count))
            part = np.repeat(np.arange(count.size, dtype=np.int32), count)[hit]
            o, first, stop = ranges(part, at[hit] + (start - base)[part])
            yield {"did": did[o], "row_hash": row[o], "first": first, "stop": stop}

    return mapped(dealt(mapped(texts, send, BLOBS), buckets), receive, "did long, row_hash long, first long, stop long")


def keyed(docs: DataFrame) -> DataFrame:
    return rows(docs).select("did", F.xxhash64("body").alias("row_hash"), F.col("body").cast("binary").alias("body"))


def bucket_count(docs: DataFrame, size: int = BUCKET) -> int:
    """A bucket for each size bytes of text, and no fewer than two for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """did, row_hash, firsts, stops: the ranges of positions at which repeated strings begin; rows with some only."""
    buckets, texts = bucket_count(docs), keyed(docs)
    parts = [(r.bucket, bytes(r.bits)) for r in shared_minimizers(texts, length, buckets).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(Sketch(parts, buckets))
    without_ended_exchanges(docs)
    found = written(repeated_ranges(texts, length, buckets, shared), "repeats")
    shared.destroy()
    without_ended_exchanges(docs)
    return found.groupBy("did", "row_hash").agg(F.collect_list("first").alias("firsts"), F.collect_list("stop").alias("stops"))


def without_ended_exchanges(docs: DataFrame) -> None:
    """Lets Spark remove the files of exchanges whose jobs have ended; it does when the driver's collector meets them, which may be late."""
    docs.sparkSession._jvm.System.gc()


def packed_texts(docs: DataFrame) -> DataFrame:
    """did, row_hash, packed: texts compressed one by one, for the exchange that carries them."""

    def work(batches):
        compress = zstandard.ZstdCompressor(level=5).compress
        for batch in batches:
            packed = pa.array([compress(b) for b in batch.column("body").to_pylist()], pa.binary())
            yield {"did": batch.column("did"), "row_hash": batch.column("row_hash"), "packed": packed}

    return mapped(keyed(docs), work, "did long, row_hash long, packed binary")


def bodies_of(batch) -> Iterable[bytes]:
    if "body" in batch.schema.names:
        return (body.as_py() for body in batch.column("body"))
    return map(zstandard.ZstdDecompressor().decompress, batch.column("packed").to_pylist())


def without_repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, all columns, with the repeated bytes gone from text."""
    return changed_texts(docs, repeats(docs, length), lambda body, firsts, stops: cut(body, firsts, stops, length)[0])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """did, row_hash, kept (binary), n_bytes, n_removed, n_spans of every row."""

    def work(batches):
        for batch in batches:
            bodies, firsts, stops = bodies_of(batch), batch.column("firsts").to_pylist(), batch.column("stops").to_pylist()
            done = [cut(b, f, s, length) for b, f, s in zip(bodies, firsts, stops)]
            for i in range(0, len(done), OUT_ROWS):
                part = done[i : i + OUT_ROWS]
                numbers = {c: np.array([x[k] for x in part], "i8") for k, c in enumerate(("n_bytes", "n_removed", "n_spans"), 1)}
                yield {"did": batch.column("did").slice(i, OUT_ROWS), "row_hash": batch.column("row_hash").slice(i, OUT_ROWS), "kept": pa.array([x[0] for x in part], pa.binary())} | numbers

    schema = "did long, row_hash long, kept binary, n_bytes long, n_removed long, n_spans long"
    return mapped(packed_texts(docs).join(repeats(docs, length), ["did", "row_hash"], "left"), work, schema)


def cut(body: bytes, firsts: list | None, stops: list | None, length: int) -> tuple[bytes, int, int, int]:
    """What stays of body, its size, the bytes removed and the number of maximal removed runs."""
    if not firsts:
        return body, len(body), 0, 0
    kept, at, spans = [], 0, 0
    end = -1
    for first, stop in sorted(zip(firsts, stops)):
        if first > end:
            spans += 1
            kept.append(body[max(at, 0) : first])
        end = max(end, stop - 1 + length)
        at = end
    kept.append(body[at:])
    out = b"".join(kept)
    return out, len(body), len(body) - len(out), spans


def repeat_digests(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select(shown_id("did").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
