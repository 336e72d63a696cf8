"""Exact dedup by deterministic block naming, in DataFrame functions only.

Each text without white space is cut into blocks of a fixed size. The distinct blocks are sorted (a range
exchange and a sort within its partitions) and numbered in that order: equal blocks, and only they, get
the same integer. Then adjacent names are paired, the distinct pairs are sorted and numbered in the same
way, and so on, until every document has one name. Two texts are equal exactly when they have the same
number of blocks and the same last name, so no identity rests on a digest.

* Texts cross two exchanges, both after map-side removal of copies: the one that finds distinct blocks and
  the one that sorts them. Names are joined back by a 64-bit block hash. Where two different blocks share
  a hash (looked up, not assumed), the join compares the block itself as well.
* A level halves the number of names of a document; a text of n blocks takes log2(n) small jobs, and only
  documents that still have two names take part.
* A hot text has one row for each map task in the exchanges, and joins back by an exchange whose large
  partitions adaptive execution splits. Groups are counted by partial aggregation.

Null and empty texts are equal to each other. A null doc_id counts as the largest. Rows that repeat a
doc_id count separately in group_size and share the decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowloom.llm.common import rows, shown_id, without_blanks, written

BLOCK_CHARS = 16384


def blocks_of(text: Column, size: int) -> Column:
    many = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(text) - 1) / F.lit(size)).cast("int")),
        lambda i: F.substring(text, i * size + 1, F.lit(size)),
    )
    return F.when(F.length(text) <= size, F.array(text)).otherwise(many)


def named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """distinct sorted by its columns, with a positive integer for each row that grows in that order."""
    ordered = distinct.repartitionByRange(*by).sortWithinPartitions(*distinct.columns)
    return ordered.withColumn("name", F.monotonically_increasing_id() + 1)


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, block_hash=F.xxhash64) -> DataFrame:
    """did, n, digest, n_blocks, name for each row; (n_blocks, name) is the identity of its normal form."""
    text = rows(docs).select(
        "did",
        F.length("body").alias("n"),
        F.xxhash64("body").alias("row_hash"),
        without_blanks(F.col("body")).alias("norm"),
    )
    cut = text.select(
        "did", "n", "row_hash", F.unhex(F.sha2("norm", 256)).alias("digest"), blocks_of(F.col("norm"), block_chars).alias("parts")
    )
    block = (
        cut.select("*", F.size("parts").alias("n_blocks"), F.posexplode("parts").alias("at", "block"))
        .drop("parts")
        .withColumn("h", block_hash("block"))
    )
    same_hash = Window.partitionBy("h").orderBy("block")
    names = named(block.select("h", "block").distinct(), ["h"])
    # the range exchange on h serves this window as well
    names = names.withColumn("other", F.lead("name").over(same_hash).isNotNull() | F.lag("name").over(same_hash).isNotNull())
    names = written(names.select("h", "name", F.when(F.col("other"), F.col("block")).alias("clash")), "block-names")
    if names.where("clash is not null").limit(1).count():
        given = block.alias("b").join(names.alias("n"), F.expr("b.h = n.h and (n.clash is null or n.clash = b.block)"))
    else:
        given = block.drop("block").alias("b").join(names.alias("n"), F.expr("b.h = n.h"))
    current = written(given.select("b.did", "b.row_hash", "b.n", "b.digest", "b.n_blocks", "b.at", "n.name"), "named-blocks")
    out = ["did", "n", "digest", "n_blocks", "name"]
    done = current.where("n_blocks = 1").select(out)
    # rows that repeat an id and a text are one from here on, counted
    current = current.where("n_blocks > 1").withColumn("copies", F.lit(1).cast("long"))
    left = current.agg(F.max("n_blocks")).first()[0] or 1
    while left > 1:
        pairs = current.groupBy("did", "row_hash", "n", "digest", "n_blocks", F.expr("at div 2").cast("int").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"),
            F.sum(F.when(F.col("at") % 2 == 0, F.col("copies"))).alias("copies"),
        )
        pairs = written(pairs, "pairs")
        names = written(named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        current = written(pairs.join(names, ["a", "b"]).drop("a", "b"), "paired")
        left = (left + 1) // 2
    each = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")
    return done.unionByName(current.select(*out, each).drop("one"))


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, block_hash=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    who = written(identities(docs, block_chars, block_hash), "identities")
    best = F.max(F.struct(F.col("n"), (-F.col("did")).alias("minus")))
    groups = who.groupBy("n_blocks", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.select("n_blocks", "name", (-F.col("best.minus")).alias("keep"), "group_size"), "groups")
    return who.join(groups, ["n_blocks", "name"]).select(
        shown_id("did").alias("doc_id"),
        shown_id("keep").alias("keep_id"),
        "group_size",
        (F.col("did") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def oracle() -> str:
    return r"""
with d as (select doc_id, coalesce(text, '') body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') norm from documents),
 g as (select *, first_value(doc_id) over (partition by norm order by length(body) desc, doc_id) keep_id, count(*) over (partition by norm) group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(norm) text_sha256 from g
"""
