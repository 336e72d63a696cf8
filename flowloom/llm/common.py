"""What the operators share: null handling, the shared folder, and writing a table to cut lineage.

Every operator reads ``doc_id`` and ``text`` only, so further columns, whatever their names, are never
touched. A null ``text`` counts as empty. A null ``doc_id`` counts as the largest id (``NO_ID``) wherever
ids are compared, and is null again in the result. Rows that repeat a ``doc_id`` stay separate rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id wherever ids are compared.
NO_ID = 2**63 - 1
#: The white space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_column(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def shown_id(name: str) -> Column:
    """The id as the result shows it: NO_ID is null again."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def rows(docs: DataFrame) -> DataFrame:
    """did, body: the id with nulls last, the text with null as empty."""
    return docs.select(id_column().alias("did"), F.coalesce(F.col("text"), F.lit("")).alias("body"))


def without_blanks(text: Column) -> Column:
    """Six byte searches; cheaper than one regular expression and exact on any text."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local session without one gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="flowloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation.

    The reread table has no known partitioning, so a join on it gets an exchange of its own, which
    adaptive execution can split where one key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
