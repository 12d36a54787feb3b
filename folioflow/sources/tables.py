"""Input tables and the views of them that the engine's operators work on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut points that the session names in ``spark.checkpoint.dir``.

    Where it names none, a session on one machine gets a temporary one; on a
    cluster that is an error, as no other executor could read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a written table, so that later jobs don't compute it again and lost executors don't matter.

    The table lies in the shared folder and is deleted when the session's driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: int = 3) -> DataFrame:
    """Hand the rows of a small scan to all cores before CPU-bound work.

    A compressed file of a few MB holds many MB of text, so Spark reads it in fewer
    tasks than there are cores. Beyond ``keys`` tasks a core nothing is moved.
    """
    wanted = keys * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of scanned pages, each (document_id, page, index_sort) once."""
    return read(spark, sf_dir, "ocr_words").dropDuplicates(["document_id", "page", "index_sort"])


WORDS_SQL = "(select distinct on (document_id, page, index_sort) * from ocr_words)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered searches."""
    return read(spark, sf_dir, "query_results").where("use_llm")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a language model: model by event type, token counts from the value."""
    e = read(spark, sf_dir, "events")
    size = F.floor(F.col("value") * 100).cast("long")
    return e.select(
        "event_id",
        "user_id",
        F.col("ts").alias("timestamp"),
        F.element_at(F.create_map(*(F.lit(x) for pair in MODEL_OF.items() for x in pair)), F.col("event_type")).alias("model"),
        size.alias("input_tokens"),
        F.floor(size / 4).cast("long").alias("cached_tokens"),
        (size % 997).alias("output_tokens"),
        (size % 89).alias("thinking_tokens"),
    )


#: Model that stands for each type of event; one of them has no price.
MODEL_OF = {"view": "flash", "click": "pro", "signup": "flash-lite", "purchase": "pro", "error": "unknown"}
CALLS_SQL = """(select event_id, user_id, ts as timestamp,
  case event_type when 'view' then 'flash' when 'click' then 'pro' when 'signup' then 'flash-lite' when 'purchase' then 'pro' when 'error' then 'unknown' end as model,
  floor(value * 100)::bigint as input_tokens, floor(floor(value * 100)::bigint / 4)::bigint as cached_tokens,
  floor(value * 100)::bigint % 997 as output_tokens, floor(value * 100)::bigint % 89 as thinking_tokens from events)"""
