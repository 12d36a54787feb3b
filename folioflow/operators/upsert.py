"""Keyed writes as set operations: insert, merge, delete, caps, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Upsert: values of ``new`` where it has the key (null ones too), else of ``old``; columns in ``keep`` stay as first written."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, keys, "full_outer")
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in keep:
            cols.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*cols)


def newest(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The newest rows of each ``by``, up to ``most``; a negative number means all. Rows beyond a limit are dropped before the shuffle."""
    if most < 0:
        return rows
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count: violations of a unique index."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def ledger(events: DataFrame, longest: int = 8000) -> DataFrame:
    """(source_id, document_id, title, status, error, created_at, updated_at, ingested_at): the state of a ledger after all ``events`` in the order of their time.

    events: source_id, at, seq (ties), status (in_progress, success, failed), title,
    document_id, error. The first event of a source creates its row; each sets title,
    status and time. Success sets the document and clears the error, failure sets the
    error, cut to ``longest`` characters; what an event doesn't set stays.
    """
    order = F.struct("at", "seq")
    ok, bad = F.col("status") == "success", F.col("status") == "failed"
    return events.groupBy("source_id").agg(
        F.max_by("document_id", F.when(ok, order)).alias("document_id"),
        F.max_by("title", order).alias("title"),
        F.max_by("status", order).alias("status"),
        F.max_by(F.when(bad, F.left("error", F.lit(longest))), F.when(ok | bad, order)).alias("error"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
        F.max(F.when(ok, F.col("at"))).alias("ingested_at"),
    )
