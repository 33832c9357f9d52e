"""Labelled rows for the classifiers: who may learn from what, and a bounded sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    c = F.col(id) if isinstance(id, str) else id
    return F.crc32(c.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, text: str = "text", id: str = "doc_id", max_rows: int = 20_000) -> DataFrame:
    """text and label (0 or 1) of at most max_rows labelled rows outside the held-out fold.

    The sample is the rows of smallest hash of the id, so it does not depend
    on partitions. It has at most max_rows ids of 16 bytes, which bounds what
    is broadcast, and one row for each id, that of the text of least hash, so
    repeated ids don't make it longer. Labels other than 0 and 1 and null ids
    are left out; of repeated label rows of an id the largest label counts.
    """
    own = (
        labels.filter(F.col(target).isin(0, 1) & (fold_of(id, folds) != held_out))
        .groupBy(F.col(id).alias("__id"))
        .agg(F.max(target).cast("int").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(own), "__id")
    order = F.struct(F.xxhash64("text"), "text")
    return rows.groupBy("__id").agg(F.min_by(F.struct("text", "label"), order).alias("x")).select("x.text", "x.label")
