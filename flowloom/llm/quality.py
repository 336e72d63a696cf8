"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``measures`` are columns over one text; ``RULES`` is the table (name, left, comparison, right) over them;
``verdict`` joins the rows of the table by AND. Everything is integer arithmetic in one projection over
the scan: no shuffle, no user function, and each document is judged by itself.

Repeated three-word windows are found by hashing each window to 64 bits, sorting (hash, position) within
the document and comparing neighbours, so a document of n words costs n log n. Neighbours with equal
hashes count only if their words are equal too. Only documents that repeat a hash are sorted at all.

Null, empty and blank texts have no words: all counts are 0, ``base_failed`` is true and ``kept`` false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import without_blanks

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a al an and are as at au be by con das de dem den der des die du ein eine el en es est et for from für he "
    "ist il im in is it la las le les los mit ne nicht no not of on or para par pas por pour que qui se sich su sur "
    "that the this to un und una une von was which with y zu"
).split()
#: The threshold table. Each row must hold for a document to be kept; counts are compared as integers.
RULES = (
    ("shortest words", "word_chars", ">=", "2 * n_words"),
    ("longest words", "word_chars", "<=", "12 * n_words"),
    ("symbols", "100 * n_symbols", "<=", "5 * n_words"),
    ("stop words", "100 * n_stop_words", ">=", "8 * n_words"),
    ("repeated lines", "100 * n_dup_lines", "<=", "60 * n_lines"),
)
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, although body uses it often."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that the array holds at least twice."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, 3) == F.slice(words, b["i"] + 1, 3))

        def hits(order: Column) -> Column:
            twice = F.filter(
                order,
                lambda x, i: F.coalesce(same(x, F.get(order, i - 1)), F.lit(False))
                | F.coalesce(same(x, F.get(order, i + 1)), F.lit(False)),
            )
            at = F.transform(twice, lambda x: x["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, hits))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, covered))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use."""
    body = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body"))
    split = body.select(
        "doc_id",
        "body",
        F.regexp_extract_all("body", F.lit(f"({WORD})")).alias("words"),
        F.filter(F.split("body", "\n", -1), lambda x: F.length(without_blanks(x)) > 0).alias("lines"),
    )
    n_symbols = F.length("body") - F.length(F.translate("body", SYMBOLS, ""))
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(without_blanks(F.col("body"))).cast("long").alias("word_chars"),
        n_symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,"))).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def verdict(rules=RULES) -> str:
    return " and ".join(f"({left} {sign} {right})" for _, left, sign, right in rules)


def quality_rules(docs: DataFrame, rules=RULES, base: str = BASE) -> DataFrame:
    """The counts, base_failed and kept of each row of docs."""
    judged = measures(docs).withColumn("base_failed", F.expr(base))
    return judged.withColumn("kept", ~F.col("base_failed") & F.expr(verdict(rules)))


def oracle() -> str:
    """The same counts by unnesting words, in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
with d as (select doc_id, coalesce(text, '') body from documents),
 s as (select doc_id, body, regexp_extract_all(body, '{WORD}') words,
   list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{WORD}')) lines from d),
 w as (select doc_id, unnest(words) w0, generate_subscripts(words, 1) p from s),
 t as (select doc_id, p, w0, lead(w0) over o w1, lead(w0, 2) over o w2 from w window o as (partition by doc_id order by p)),
 r as (select doc_id, p, count(*) over (partition by doc_id, w0, w1, w2) c from t where w2 is not null),
 v as (select doc_id, unnest([p, p + 1, p + 2]) q from r where c > 1),
 n as (select doc_id, count(distinct q) n_repeat_words from v group by doc_id),
 m as (select s.doc_id, len(words) n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
   length(regexp_replace(body, '[^{SYMBOLS}]+', '', 'g')) n_symbols, len(lines) - len(list_distinct(lines)) n_dup_lines,
   coalesce(n_repeat_words, 0) n_repeat_words,
   len(list_filter(words, lambda x: lower(rtrim(x, '.,')) in ({stop}))) n_stop_words, len(lines) n_lines
   from s left join n on s.doc_id = n.doc_id),
 b as (select *, ({BASE}) base_failed from m)
select *, not base_failed and {verdict()} kept from b
"""
