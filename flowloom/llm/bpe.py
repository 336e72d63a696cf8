"""Byte-level BPE by ranked merges in Spark's higher-order functions.

1. Tasks cut texts into words, the matches of the pre-token pattern, and hand on each distinct word of a block once, as
   its bytes, before the documents, which become lists of word numbers. A block is what a task reads until it
   has met ``WORDS`` distinct words.
2. Each of these words is merged by one expression: its bytes become ids, each with the rank of its pair with the next
   one above it, and ``aggregate`` folds over them. A step merges the pair of lowest rank: all its places, from the left, in one
   pass while the array is long, or the leftmost by slices when it is short; both orders give the same ids. So a step is
   linear in the word, and there is a step for each of its bytes but one; steps that find nothing leave it alone. Ranks are a literal map, laid out
   as one array: the id of a pair's first half has a displacement, which its second half is added to.
   Displacements are chosen so that no two pairs meet. A token has one pair: merging its own bytes by lower ranks leaves
   exactly two parts, and no other pair with its bytes can arise in a text.
   Words that are frequent in about ``SAMPLE`` documents, ``COMMON`` at most, are merged once by the same expression and sent
   to all tasks, which hand on the others only. That saves work and changes no ids; a text's words are all looked up or merged.
3. In the same stage, documents look their word numbers up. No text is shuffled: sending each word
   through an exchange to be merged once in the whole corpus would carry every (word, block) pair twice, and the texts.
4. Decoding looks up each id's bytes in a literal array and concatenates them, by built-in functions.

Null and empty texts have no ids. Repeated rows and ids are encoded row by row.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrow import mapped
from flowloom.llm.common import rows, shown_id, written
from flowloom.llm.tokens import RANKS, read_ranks

#: Distinct words of a block; chunks a task remembers, and the longest of them in characters.
WORDS, CHUNKS, CHUNK_CHARS = 500_000, 100_000, 48
#: Words that a task hands on, and word numbers or bytes of documents that it looks at, at once.
PART_WORDS, PART = 50_000, 1_000_000
#: Documents, about, whose words are counted, and words at most that are merged before all others.
SAMPLE, COMMON = 16_000, 250_000
#: Ranks are below 2 ** SHIFT. Arrays longer than LONG merge all places of a pair in a step, shorter ones the leftmost.
SHIFT, LONG = 20, 64
#: Words of more characters are merged in segments.
WHOLE = 24
NONE = 2**31 - 1
UNSAFE = re.compile(r"\s ").search
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def split_chunks(text: str) -> tuple[str, list[str]]:
    """The first chunk, and the others without the space that each begins with: no word reaches over a chunk's end."""
    if UNSAFE(text):
        first, *rest = BEFORE_SPACE.split(text)
        return first, [x[1:] for x in rest]
    first, *rest = text.split(" ")
    return first, rest


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two ids whose merge gives the token: merging its bytes by ranks below its own leaves these."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        low, at = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return ranks[parts[0]], ranks[parts[1]]


@functools.lru_cache(2)
def literals(path: str) -> dict[str, str]:
    """JSON arrays: of_byte (byte -> id), shift (id -> displacement), pairs (place -> first id and joined id), twice
    (the ids that join an id with itself), hexes (id -> its bytes in hexadecimal digits)."""
    ranks = read_ranks(path)
    own: dict[int, list[tuple[int, int]]] = defaultdict(list)
    twice = []
    for token, rank in ranks.items():
        if len(token) > 1:
            a, b = last_pair(token, ranks)
            own[a].append((b, rank))
            twice += [rank] if a == b else []
    size = max(ranks.values()) + 1
    pairs, taken = np.full(8 * size, 2**40, np.int64), np.zeros(8 * size, bool)
    shift, least = np.full(size, -(8 * size), np.int64), 0
    for a in sorted(own, key=lambda a: (-len(own[a]), a)):
        seconds, joined = (np.array(x, np.int64) for x in zip(*sorted(own[a])))
        while taken[least]:
            least += 1
        # the first place, of a few thousand looked at together, from which all pairs fall on free ones
        free, begin = np.zeros(0, np.int64), least
        while not free.size:
            places = np.arange(begin, begin + 2048)
            free = places[~taken[places[:, None] + (seconds - seconds[0])].any(axis=1)]
            begin += 2048
        free = int(free[0])
        taken[free - seconds[0] + seconds] = True
        pairs[free - seconds[0] + seconds] = (a << SHIFT) + joined
        shift[a] = free - seconds[0]
    hexes = [""] * size
    for token, rank in ranks.items():
        hexes[rank] = token.hex()
    of_byte = [ranks[bytes([b])] for b in range(256)]
    found = {"of_byte": of_byte, "shift": shift.tolist(), "pairs": pairs[: int(np.flatnonzero(taken)[-1]) + 1].tolist(), "twice": twice, "hexes": hexes}
    return {k: json.dumps(v, separators=(",", ":")) for k, v in found.items()}


def literal(name: str, path: str) -> Column:
    return F.from_json(F.lit(literals(path)[name]), "array<string>" if name == "hexes" else "array<bigint>")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, although body uses it often."""
    return F.transform(F.array(value), body)[0]


def merged(word: Column, path: str = RANKS) -> Column:
    """The ids (array<bigint>) of a word's bytes (array<bigint>), by the rank table."""

    low_bits, none = F.lit(2**SHIFT - 1).cast("bigint"), F.lit(2**40).cast("bigint")

    def fold(table: Column) -> Column:
        def ranked(x: Column, y: Column) -> Column:
            """The id x with the rank of its pair with y above it; x falls out of its own entries, all else is too large."""
            pair = F.get(table["pairs"], F.get(table["shift"], x) + y).bitwiseXOR(F.shiftleft(x, SHIFT))
            return F.shiftleft(F.coalesce(pair, none), SHIFT).bitwiseOR(x)

        def state(ids: Column) -> Column:
            return F.transform(ids, lambda x, i: ranked(x, F.get(ids, i + 1)))

        def everywhere(s: Column, least: Column) -> Column:
            """s with all places of the pair merged, from the left."""
            low = F.shiftright(least, SHIFT)

            def joined(starts) -> Column:
                of = lambda x, i: F.when(starts(i), low).when(starts(i - 1), F.lit(-1).cast("bigint")).otherwise(x.bitwiseAND(low_bits))
                return let(F.filter(F.transform(s, of), lambda x: x >= 0), state)

            # where equal ids follow each other, every second place starts
            marks = F.array_join(F.transform(s, lambda x: F.when(x == least, "1").otherwise("0")), "")
            runs = let(F.split(F.replace(marks, F.lit("11"), F.lit("10")), ""), lambda m: joined(lambda i: F.get(m, i) == "1"))
            return F.when(F.array_contains(table["twice"], low), runs).otherwise(joined(lambda i: F.get(s, i) == least))

        def leftmost(s: Column, p: Column, least: Column) -> Column:
            """s with the pair at place p (from 1) merged."""
            low = F.shiftright(least, SHIFT)
            new, before = ranked(low, F.get(s, p + 1).bitwiseAND(low_bits)), F.get(s, p - 2).bitwiseAND(low_bits)
            rest = F.slice(s, p + 2, F.size(s))
            return F.when(p > 1, F.concat(F.slice(s, F.lit(1), p - 2), F.array(ranked(before, low), new), rest)).otherwise(F.concat(F.array(new), rest))

        def step(s: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                one = let(F.array_position(s, least).cast("int"), lambda p: leftmost(s, p, least))
                return F.when(least < 2 ** (2 * SHIFT), F.when(F.size(s) > LONG, everywhere(s, least)).otherwise(one)).otherwise(s)

            return let(F.array_min(s), merge)

        ids = F.transform(word, lambda b: F.get(table["of_byte"], b.cast("int")))
        return F.aggregate(F.sequence(F.lit(2), F.size(word)), let(ids, state), step, lambda s: F.transform(s, lambda x: x.bitwiseAND(low_bits)))

    # the tables are bound once, so that the expression holds one copy of them
    tables = F.struct(*[literal(c, path).alias(c) for c in ("of_byte", "shift", "pairs", "twice")])
    return F.when(F.size(word) > 1, let(tables, fold)).otherwise(F.transform(word, lambda b: F.get(literal("of_byte", path), b.cast("int"))))


def parts(sizes: np.ndarray, most: int = PART) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows that have at most this size together, or one row."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield begin, end
        begin = end


class Numbers(dict):
    """The numbers of words, and of segments (bytes) of long ones, in the order in which they are met."""

    def __missing__(self, word: str | bytes) -> int:
        self[word] = n = len(self)
        return n


def neighbours(path: str = RANKS) -> np.ndarray:
    """Whether two bytes (256 * first + second) stand next to each other in any token."""
    found = np.zeros(1 << 16, bool)
    for token in read_ranks(path):
        b = np.frombuffer(token, np.uint8).astype(np.int64)
        found[256 * b[:-1] + b[1:]] = True
    return found


def segments(word: str, beside: np.ndarray) -> list[bytes]:
    """The word's bytes, cut between bytes that no token has side by side; no merge reaches over such a place."""
    raw = word.encode()
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    cuts = (np.flatnonzero(~beside[256 * b[:-1] + b[1:]]) + 1).tolist()
    return [raw[i:j] for i, j in zip([0, *cuts], [*cuts, len(raw)])]


class Chunked(dict):
    """The packed numbers of the words, or of the segments of long ones, of a space and the key."""

    def __init__(self, numbers: Numbers, beside: np.ndarray):
        self.numbers, self.beside, self.words = numbers, beside, regex.compile(public_tokenizers.PATTERN).findall

    def packed(self, text: str) -> bytes:
        found = []
        for w in self.words(text):
            if len(w) <= WHOLE:
                found.append(self.numbers[w].to_bytes(4, "little"))
            else:
                found += [self.numbers[x].to_bytes(4, "little") for x in segments(w, self.beside)]
        return b"".join(found)

    def __missing__(self, chunk: str) -> bytes:
        # most chunks are one word of letters, perhaps with a mark behind it
        if chunk.isascii() and chunk.isalpha():
            found = self.numbers[" " + chunk].to_bytes(4, "little")
        elif chunk[-1:] in (",", ".") and chunk.isascii() and chunk[:-1].isalpha():
            found = self.numbers[" " + chunk[:-1]].to_bytes(4, "little") + self.numbers[chunk[-1]].to_bytes(4, "little")
        else:
            found = self.packed(" " + chunk)
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= CHUNKS:
                self.clear()
            self[chunk] = found
        return found


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: the words of at most WHOLE characters and how often they occur."""

    def work(batches):
        split = regex.compile(public_tokenizers.PATTERN).findall
        for batch in batches:
            bodies = batch.column("body")
            for a, b in parts(pc.binary_length(bodies).to_numpy(zero_copy_only=False)):
                chunks, found = Counter(), Counter()
                for body in bodies.slice(a, b - a).to_pylist():
                    first, rest = split_chunks(body)
                    found.update(split(first))
                    chunks.update(rest)
                for chunk, n in chunks.items():
                    for word in split(" " + chunk):
                        found[word] += n
                kept = [w for w in found if len(w) <= WHOLE]
                yield {"word": pa.array(kept, pa.string()), "n": np.array([found[w] for w in kept], "i8")}

    return mapped(docs, work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(docs: DataFrame, path: str = RANKS, sample: int | None = None, most: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most this many words, the most frequent of a sample, and their ids, end to end, with where each word's begin and end.

    They are found among documents chosen by a hash, so the table is of one size for every input.
    """
    sample, most = SAMPLE if sample is None else sample, COMMON if most is None else most
    each = max(1, docs.count() // sample)
    chosen = rows(docs).where(F.pmod(F.xxhash64("did", F.length("body")), F.lit(each)) == 0)
    counts = written(counted_words(chosen).where("n > 1"), "word-counts")
    # the least count from which on the words are no more than that
    sizes = counts.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    totals = np.cumsum([r.words for r in sizes])
    kept = int(np.searchsorted(totals, most, "right"))
    if not kept:
        return [], np.zeros(0, "<i4"), np.zeros(1, "i8")
    own = counts.where(F.col("n") >= sizes[kept - 1].n)
    # dealt anew, as counts may lie in few files and merging is the work
    own = own.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    raw = F.transform(F.split(F.regexp_replace(F.hex(F.encode("word", "UTF-8")), "(..)(?!$)", "$1 "), " "), lambda x: F.conv(x, 16, 10).cast("bigint"))
    table = own.select("word", merged(raw, path).cast("array<int>").alias("ids")).toArrow()
    ids = table.column("ids").combine_chunks()
    ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
    lengths = ids.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
    return table.column("word").to_pylist(), ids.flatten().to_numpy(zero_copy_only=False).astype("<i4"), np.cumsum(np.r_[0, lengths])


def numbered_words(docs: DataFrame, words: int = WORDS, path: str = RANKS, common: list[str] | tuple = ()) -> DataFrame:
    """Rows of three kinds in order: word (its bytes), did and numbers of a document, or, with nulls, the end of a block.

    Words in common have their places there as numbers and are not handed on.
    """

    known_before = docs.sparkSession.sparkContext.broadcast(list(common))
    beside = docs.sparkSession.sparkContext.broadcast(neighbours(path))

    def as_words(new: list[str | bytes]) -> dict:
        raw = [w if isinstance(w, bytes) else w.encode() for w in new]
        flat = np.frombuffer(b"".join(raw), np.uint8).astype("i8")
        edges = np.cumsum([0, *map(len, raw)]).astype("i4")
        return {"word": pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)), "did": pa.nulls(len(raw), pa.int64()), "numbers": pa.nulls(len(raw), pa.binary())}

    def work(batches):
        before = {w: k for k, w in enumerate(known_before.value)}
        chunks = Chunked(Numbers(before), beside.value)
        for batch in batches:
            bodies, dids = batch.column("body"), batch.column("did")
            for a, b in parts(pc.binary_length(bodies).to_numpy(zero_copy_only=False)):
                known, packed = len(chunks.numbers), []
                for body in bodies.slice(a, b - a).to_pylist():
                    first, rest = split_chunks(body)
                    packed.append(chunks.packed(first) + b"".join(map(chunks.__getitem__, rest)))
                # new words, the latest in the dictionary, come before the documents that have them
                new = list(islice(reversed(chunks.numbers), len(chunks.numbers) - known))[::-1]
                for i in range(0, len(new), PART_WORDS):
                    yield as_words(new[i : i + PART_WORDS])
                yield {"word": pa.nulls(len(packed), pa.list_(pa.int64())), "did": dids.slice(a, b - a), "numbers": pa.array(packed, pa.binary())}
                if len(chunks.numbers) >= len(before) + words:
                    chunks = Chunked(Numbers(before), beside.value)
                    yield {"word": pa.nulls(1, pa.list_(pa.int64())), "did": pa.nulls(1, pa.int64()), "numbers": pa.nulls(1, pa.binary())}

    return mapped(rows(docs), work, "word array<bigint>, did long, numbers binary")


def encoded(docs: DataFrame, path: str = RANKS, words: int = WORDS) -> DataFrame:
    """did, ids (packed little-endian unsigned 32-bit integers), tokens (the same as an array) of every row."""

    def documents_of(dids, numbers, sizes, flat, edges) -> dict:
        of = np.frombuffer(b"".join(numbers.to_pylist()), "<i4")
        length = edges[of + 1] - edges[of]
        ends = np.cumsum(length)
        ids = flat[np.repeat(edges[of] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
        raw = ids.astype("<i4").tobytes()
        return {
            "did": dids,
            "ids": pa.array([raw[4 * x : 4 * y] for x, y in zip(at, at[1:])], pa.binary()),
            "tokens": pa.ListArray.from_arrays(pa.array(at.astype("i4")), pa.array(ids)),
        }

    common, *ids_of = common_words(docs, path)
    before = docs.sparkSession.sparkContext.broadcast(ids_of)

    def look_up(batches):
        # the ids of the common words and the block's, end to end, and where each word begins and ends
        flat, edges = before.value
        for batch in batches:
            words_, dids, numbers = batch.column("ids"), batch.column("did"), batch.column("numbers")
            kinds = 2 * numbers.is_valid().to_numpy(zero_copy_only=False) + words_.is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True])
            for a, b in zip(cuts, cuts[1:]):
                if kinds[a] == 1:
                    part = words_.slice(a, b - a)
                    flat = np.concatenate([flat, part.flatten().to_numpy(zero_copy_only=False).astype("<i4")])
                    edges = np.concatenate([edges, edges[-1] + np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))])
                elif kinds[a] == 0:
                    flat, edges = before.value
                else:
                    sizes = pc.binary_length(numbers.slice(a, b - a)).to_numpy(zero_copy_only=False) // 4
                    for i, j in parts(sizes):
                        yield documents_of(dids.slice(a + i, j - i), numbers.slice(a + i, j - i), sizes[i:j], flat, edges)

    with_ids = numbered_words(docs, words, path, common).select(merged(F.col("word"), path).alias("ids"), "did", "numbers")
    return mapped(with_ids, look_up, "did long, ids binary, tokens array<int>")


def decoded(tokens: Column, path: str = RANKS) -> Column:
    """The bytes (binary) of an array of ids: the pieces of the ids, concatenated."""
    piece = lambda table: F.transform(tokens, lambda t: F.get(table, t))
    return F.unhex(F.array_join(let(literal("hexes", path), piece), ""))


def bpe_digests(docs: DataFrame) -> DataFrame:
    return encoded(docs).select(
        shown_id("did").alias("doc_id"),
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("tokens")), 256).alias("decoded_sha256"),
    )
