"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to its character n-grams
with word ends, from the longest (``LONGEST`` characters) to single characters: the first length at which any
n-gram is known decides, by the mean log frequency of the known ones. A text is the sum over its words.

The model is fitted on at most ``FIT_ROWS`` training rows, those with the smallest hash of doc_id among rows
that have a text and a language, so it has a bounded size. Prediction covers every row and whole texts, in
one Arrow step without a shuffle; a task remembers the scores of the unseen words it has met, up to a bound.

A null text, or one without a letter, is ``und`` with score 0. So is every text if no row can be learned from.
A null doc_id is never learned from and not held out. Rows that repeat an id are predicted one by one. Ties go to the language that sorts first.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrow import mapped

FIT_ROWS, LONGEST, REMEMBERED = 4000, 5, 200_000
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row is kept from learning; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def bounded_rows(df: DataFrame, fit_rows: int, *columns: str, key: str = "doc_id") -> list:
    """The columns of at most fit_rows rows of df, those with the smallest hash of the key.

    The hash that cuts is found on ids alone, so that no task sends texts that are not chosen.
    """
    hashed = df.select(F.xxhash64(key).alias("fit_hash"), *columns)
    lowest = hashed.select("fit_hash").orderBy("fit_hash").limit(fit_rows).agg(F.max("fit_hash")).first()[0]
    if lowest is None:
        return []
    return hashed.where(F.col("fit_hash") <= lowest).orderBy("fit_hash", *columns).limit(fit_rows).drop("fit_hash").collect()


def words_of(text: str) -> Counter:
    """The words of a text, lower-cased, and how often they occur: letters only, numerals such as roman ones go."""
    count = Counter(WORD.findall(text.lower()))
    for word in [w for w in count if not w.isalpha()]:
        times = count.pop(word)
        if letters := "".join(filter(str.isalpha, word)):
            count[letters] += times
    return count


def grams(word: str, n: int) -> list[str]:
    word = f"<{word}>" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Backoff:
    """Log frequencies of words and of character n-grams for each language."""

    def __init__(self, labelled: list[tuple[str, str]], longest: int = LONGEST):
        words: dict[str, Counter] = {}
        for text, lang in labelled:
            words.setdefault(lang, Counter()).update(words_of(text))
        self.langs = sorted(words)
        self.longest = longest
        self.words = self.table([words[x] for x in self.langs])
        self.grams = {}
        for n in range(longest, 0, -1):
            counts = []
            for lang in self.langs:
                count: Counter = Counter()
                for word, c in words[lang].items():
                    for g in grams(word, n):
                        count[g] += c
                counts.append(count)
            self.grams[n] = self.table(counts)
        self.seen: dict[str, tuple] = {}

    @staticmethod
    def table(counts: list[Counter]) -> dict[str, tuple]:
        """For each key the log of its share in each language, with half a count where it was not seen."""
        totals = [math.log(sum(c.values()) + 0.5 * len(c) + 1) for c in counts]
        keys = set().union(*counts) if counts else ()
        return {k: tuple(math.log(c[k] + 0.5) - t for c, t in zip(counts, totals)) for k in keys}

    def unseen(self, word: str) -> tuple:
        for n in range(self.longest, 0, -1):
            known = [v for g in grams(word, n) if (v := self.grams[n].get(g)) is not None]
            if known:
                return tuple(sum(x) / len(known) for x in zip(*known))
        return (0.0,) * len(self.langs)

    def score(self, word: str) -> tuple:
        found = self.words.get(word) or self.seen.get(word)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.seen[word] = self.unseen(word)
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        count = words_of(text or "")
        if not count or not self.langs:
            return "und", 0.0
        score, times = self.score, np.fromiter(count.values(), float, len(count))
        total = times @ np.array([score(w) for w in count])
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    learn = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(Backoff([tuple(r) for r in bounded_rows(learn, fit_rows, "text", "lang")]))

    def work(batches):
        predict = model.value.predict
        for batch in batches:
            done = [predict(t) for t in batch.column("text").to_pylist()]
            yield {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "lang_pred": pa.array([x[0] for x in done], pa.string()),
                "score": np.array([x[1] for x in done], float),
            }

    return mapped(docs.select("doc_id", held_out().alias("held_out"), "text"), work, "doc_id long, held_out boolean, lang_pred string, score double")
