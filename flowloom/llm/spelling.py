"""Spelling variants by an index of variable-length grams.

1. Words are counted in the tasks and then by word; from here on only the vocabulary is at work.
2. The gram dictionary has all grams of ``SHORT`` characters, and a longer one for each gram that occurs more often than
   a limit, up to ``LONGEST`` characters. The limit follows the number of grams, so that at most ``DICTIONARY`` of them
   are frequent; these alone are broadcast, with their counts.
3. A word, with marks before and after it, gives one gram at each place: the shortest that is not frequent, or the
   longest. Where it ends depends on its own characters alone, so one edit changes only grams that contain its place.
   The most grams of a word over one place is its bound: a word at one edit shares all others.
4. Grams are merged as lists, rarest first. Two near words share one of their (bound + 1) rarest grams, two of their
   (bound + 2) rarest, and so on. A list with more than a limit of words (at most ``DICTIONARY`` lists) is not merged;
   its words meet in the lists of that gram and one more, up to ``LEVELS`` grams. A pair is met once, at the first
   grams it shares.
   Grams travel as 64-bit tokens that begin with how frequent they are, so their order is one for all words.
5. The words of a list are verified by what is left of each without one character, so work follows their number.

Every word has at most as many near words as there are single edits of it. A form occurs ten times as often as its
word, so chains are as long as the digits of the largest count; their ends are found by doubling.

Null and empty texts have no words. A null doc_id is written as nothing before the colon of the deletion hash. Rows that
repeat a doc_id are counted each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrow import OUT_ROWS, mapped
from flowloom.llm.common import written

LETTERS, LEAST_CHARS, LEAST_N = "A-Za-zÀ-ÿ", 7, 2
DELETED, RATIO = 31, 10
SHORT, LONGEST, FREQUENT, DICTIONARY = 3, 5, 50, 2**18
LISTED, LEVELS = 2000, 4
#: Words that a task counts before it hands them on.
COUNTED = 300_000
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(UPPER)


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """word, n"""
    find = re.compile(f"[{LETTERS}]{{{least_chars},}}").findall

    def work(batches):
        seen = Counter()

        def out():
            return {"word": pa.array(list(seen), pa.string()), "n": np.array(list(seen.values()), "i8")}

        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                head = zlib.crc32(f"{name}:".encode())
                runs = Counter(find(text))
                lower = Counter()
                for run, n in runs.items():
                    lower[lowered(run)] += n
                for run, n in lower.items():
                    h = zlib.crc32(run.encode(), head)
                    if h % DELETED == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < least_chars:
                            continue
                    seen[run] += n
                if len(seen) >= COUNTED:
                    yield out()
                    seen = Counter()
        if seen:
            yield out()

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    return mapped(named, work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def marked(word: Column) -> Column:
    return F.concat(F.lit("^" * (SHORT - 1)), word, F.lit("$" * (SHORT - 1)))


def all_grams(s: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s) - size + 1), lambda k: F.substring(s, k, F.lit(size)))


def frequent_grams(words: DataFrame, frequent: int = FREQUENT) -> dict[str, int]:
    """gram: count, for at most DICTIONARY grams."""
    grams = F.concat(*[all_grams(marked(F.col("word")), q) for q in range(SHORT, LONGEST + 1)])
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    total = (total + 2 * SHORT * words.count()) * (LONGEST - SHORT + 1)
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return dict(map(tuple, counts.where(F.col("n") > max(frequent, total // DICTIONARY)).collect()))


def token(gram: str, repeat: int, frequent: dict[str, int]) -> int:
    """A number for the gram and its repeat; rarer grams have smaller ones."""
    n = frequent.get(gram)
    return ((1 + int(64 * math.log2(n)) if n else 0) << 48) | (xxhash.xxh3_64_intdigest(f"{gram} {repeat}") & (2**48 - 1))


def grams_of(word: str, frequent: dict[str, int]) -> tuple[list[int], int]:
    """The word's grams as tokens, rarest first, and the most that lie over one place."""
    s = "^" * (SHORT - 1) + word + "$" * (SHORT - 1)
    found, over, met = [], [0] * len(s), Counter()
    for p in range(len(s) - SHORT + 1):
        q = SHORT
        while q < LONGEST and p + q < len(s) and s[p : p + q] in frequent:
            q += 1
        gram = s[p : p + q]
        found.append(token(gram, met[gram], frequent))
        met[gram] += 1
        for k in range(p, p + q):
            over[k] += 1
    return sorted(found), max(over)


def decomposed(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """word, n, rare (its bound + LEVELS rarest grams), bound; a word of LEAST_CHARS has so many grams."""
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def work(batches):
        for batch in batches:
            found = [grams_of(w, shared.value) for w in batch.column("word").to_pylist()]
            yield {
                "word": batch.column("word"),
                "n": batch.column("n"),
                "rare": pa.array([g[: b + LEVELS] for g, b in found], pa.list_(pa.int64())),
                "bound": np.array([b for _, b in found], "i4"),
            }

    return mapped(words, work, "word string, n long, rare array<bigint>, bound int")


def single_edits(words: list[str]) -> set[tuple[int, int]]:
    """Pairs of places of words at one edit: a word is another without a character, or both are equal without the same one."""
    at, pairs, cuts = {w: i for i, w in enumerate(words)}, set(), defaultdict(list)
    for i, w in enumerate(words):
        for k in range(len(w)):
            cut = w[:k] + w[k + 1 :]
            cuts[k, cut].append(i)
            if cut in at:
                pairs.add((at[cut], i))
    for group in cuts.values():
        if len(group) > 1:
            pairs.update(combinations(group, 2))
    return pairs


def merged(lists: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of the near words of each list (list, picked, word, n, rare) whose first shared grams are the list's."""

    def work(batches):
        out, names = [], ("picked", "word", "n", "rare")

        def close(rows):
            if len(rows) < 2:
                return
            for i, j in single_edits([r[1] for r in rows]):
                (picked, a, a_n, a_rare), (other, b, b_n, b_rare) = rows[i], rows[j]
                theirs = set(b_rare)
                if picked == other == [g for g in a_rare if g in theirs][: len(picked)]:
                    out.append((a, a_n, b, b_n))

        def given():
            a, a_n, b, b_n = zip(*out)
            return {"a": pa.array(a, pa.string()), "a_n": np.array(a_n, "i8"), "b": pa.array(b, pa.string()), "b_n": np.array(b_n, "i8")}

        key, rows = None, []
        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("list", *names))):
                if k != key:
                    close(rows)
                    key, rows = k, []
                rows.append(row)
            if len(out) >= OUT_ROWS:
                yield given()
                out = []
        close(rows)
        if out:
            yield given()

    return mapped(lists.repartition("list").sortWithinPartitions("list"), work, "a string, a_n long, b string, b_n long")


def near_pairs(words: DataFrame, listed: int = LISTED, levels: int = LEVELS, frequent: int = FREQUENT) -> DataFrame:
    """a, a_n, b, b_n: every pair of words at one edit, once."""
    index = written(decomposed(words, frequent_grams(words, frequent)), "grams")
    rarest = F.posexplode(F.slice("rare", 1, F.col("bound") + 1))
    # at: the place of the list's last gram among the word's grams
    lists = index.select("word", "n", "rare", "bound", rarest.alias("at", "gram")).withColumn("picked", F.array("gram"))
    found = None
    for level in range(1, levels + 1):
        lists = lists.withColumn("list", F.xxhash64("picked"))
        short = lists
        if level < levels:
            counts = written(lists.groupBy("list").count().where(F.col("count") > 1), "list-lengths")
            limit = max(listed, (counts.agg(F.sum("count")).first()[0] or 0) // DICTIONARY)
            crowded = written(counts.where(F.col("count") > limit).select("list"), "long-lists")
            short = lists.join(F.broadcast(crowded), "list", "left_anti")  # at most DICTIONARY rows
        pairs = merged(short.select("list", "picked", "word", "n", F.slice("rare", 1, F.col("bound") + level).alias("rare")))
        found = pairs if found is None else found.unionByName(pairs)
        if level < levels:
            if not crowded.limit(1).count():
                break
            left = lists.join(F.broadcast(crowded), "list", "left_semi").withColumn("place", F.col("at"))
            later = F.posexplode(F.slice("rare", 1, F.col("bound") + level + 1))
            left = left.select("word", "n", "rare", "bound", "picked", "place", later.alias("at", "gram")).where("at > place")
            lists = written(left.withColumn("picked", F.concat("picked", F.array("gram"))).drop("place"), "gram-lists")
    return found


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (word, form) that begins at the word."""
    ends = written(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        there = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not ends.join(there, "root", "left_semi").limit(1).count():
            return ends
        ends = written(ends.join(there, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "chains")


def variants(docs: DataFrame, listed: int = LISTED, levels: int = LEVELS, frequent: int = FREQUENT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(word_counts(docs), "words")
    pairs = written(near_pairs(words, listed, levels, frequent), "near-words")
    back = pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    # the largest count, then the smallest word
    best = F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("form")))
    near = pairs.unionByName(back).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    seen = words.join(near, "word", "left")
    holds = -F.col("best.minus") >= RATIO * F.col("n")
    seen = seen.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("best.form")).alias("form"), F.when(holds, -F.col("best.minus")).alias("form_n"))
    seen = written(seen, "forms")
    ends = roots(seen.where("form is not null"))
    return seen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    return r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+') runs from documents),
 u as (select doc_id, translate(unnest(runs), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run from d),
 r as (select doc_id, run, count(*) n from u where length(run) >= 7 group by all),
 b as (select *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) bytes from r),
 h as (select *, xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], bytes), lambda acc, x: list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end))) h from b),
 e as (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, n from h),
 w as (select word, sum(n)::bigint n from e where length(word) >= 7 group by word having sum(n) >= 2),
 v as (select word, n, unnest(range(1, length(word) + 1)) k from w), x as (select word, n, k, left(word, k - 1) || substr(word, k + 1) cut from v),
 p as (select distinct x.word, w.word other, w.n other_n from x join w on w.word = x.cut union select distinct w.word, x.word, x.n from x join w on w.word = x.cut
  union select distinct x.word, y.word, y.n from x join x y on x.k = y.k and x.cut = y.cut and x.word <> y.word),
 g as (select word, count(*) n_near, max(other_n) top from p group by word),
 f as (select w.word, w.n, coalesce(n_near, 0) n_near, case when top >= 10 * w.n then top end form_n, (select min(other) from p where p.word = w.word and p.other_n = g.top) best from w left join g on g.word = w.word),
 m as (select word, n, n_near, form_n, case when form_n is not null then best end form from f),
 c as (select word, coalesce(form, word) root from m union select c.word, m.form from c join m on m.word = c.root where m.form is not null),
 z as (select c.word, c.root from c join m on m.word = c.root where m.form is null)
select m.word, m.form, z.root, m.n, m.n_near, m.form_n from m join z on z.word = m.word
"""
