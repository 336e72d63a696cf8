"""Small helpers for tasks that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import id_column

#: Rows gathered before a task hands a batch on.
OUT_ROWS = 20_000


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """df through work, which turns batches into dicts of columns (lists or arrays) in the schema's order."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def task(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([as_array(columns[n]) for n in names], names=names)

    return df.mapInArrow(task, schema)


def as_array(values) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def changed_texts(docs: DataFrame, found: DataFrame, change: Callable[..., bytes]) -> DataFrame:
    """docs, all columns, with text replaced by change(text as bytes, *found's further columns) where found has the row.

    found has did, row_hash and further columns. A code point that a change cuts apart goes as a whole, and
    n_chars, if there, follows the text.
    """
    extra = [c for c in found.columns if c not in ("did", "row_hash")]
    fresh = {c: next(n for k in range(len(docs.columns) + 1) if (n := f"found_{c}_{k}").lower() not in {x.lower() for x in docs.columns}) for c in found.columns}
    left = docs.withColumn(fresh["did"], id_column()).withColumn(fresh["row_hash"], F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    right = found.select([F.col(c).alias(n) for c, n in fresh.items()])
    names, schema = docs.columns, docs.schema

    def task(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            payload = zip(*(batch.column(fresh[c]).to_pylist() for c in extra))
            new = [t if p[0] is None else change((t or "").encode(), *p).decode("utf-8", "ignore") for t, p in zip(texts, payload)]
            own = {"text": pa.array(new, pa.string())}
            if "n_chars" in names:
                counts = [n if new_text is t else len(new_text) for n, t, new_text in zip(batch.column("n_chars").to_pylist(), texts, new)]
                own["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([own.get(c, batch.column(c)) for c in names], names=names)

    return left.join(right, [fresh["did"], fresh["row_hash"]], "left").mapInArrow(task, schema)
