"""Mixing of sources to target shares of all tokens (problem 7).

Iterative proportional fitting rakes the weights of cells (source, language,
topic) to the targets of the sources and to the languages' and topics' own shares
of the corpus; the target shares and repeat limits of the sources hold exactly.
Every document gets its cell's weight, the expected number of its uses, from which
whole uses are drawn systematically.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizes import small
from .tables import keep, read
from .tokens import count

#: Rounds of fitting.
ROUNDS = 30
#: Cells that are raked at most; more are an error, never pooled. A cell is a source, language and topic that occur together.
CELLS = 2_000_000


def fill(sizes: dict[str, int], targets: list[tuple[str, float, int]]) -> tuple[float, dict[str, float]]:
    """Total of tokens and tokens of each source.

    The total is that of the targeted sources' own tokens. A source gives its share
    of the total, or its tokens times its limit of repeats where that is less.
    """
    wanted = [(s, share, sizes.get(s, 0) * cap) for s, share, cap in targets if share and share > 0]
    total = float(sum(n for s, n in sizes.items() if s in {w[0] for w in wanted}))
    given = {s: min(share * total, float(most)) for s, share, most in wanted}
    return total, given


def cells(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, docs): sizes of the cells; null languages and topics are cells of their own."""
    return docs.groupBy("source", "cell_lang", "cell_topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def rake(sizes: np.ndarray, source: np.ndarray, margins: list[np.ndarray], given: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Weight of each cell: the source totals are met exactly where they can be, the other margins as near as limits allow."""
    weight = np.ones(len(sizes))
    shares = [np.bincount(m, sizes) / max(sizes.sum(), 1) for m in margins]
    for _ in range(ROUNDS):
        for m, share in zip(margins, shares):
            now = np.bincount(m, weight * sizes, len(share))
            weight *= np.divide(share * given.sum(), now, out=np.ones_like(now), where=now > 0)[m]
        weight = meet(weight, sizes, source, given, most)
    return weight


def meet(weight: np.ndarray, sizes: np.ndarray, source: np.ndarray, given: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Scale the weights within each source to its total; none above its limit, what that leaves goes to the source's other cells."""
    weight = np.minimum(weight, most[source])
    for _ in range(len(np.unique(source)) and 20):
        capped = weight >= most[source] - 1e-12
        fixed = np.bincount(source, weight * sizes * capped, len(given))
        free = np.bincount(source, weight * sizes * ~capped, len(given))
        factor = np.divide(given - fixed, free, out=np.ones_like(free), where=free > 0)
        new = np.where(capped, weight, np.maximum(weight * np.maximum(factor, 0)[source], 0))
        weight = np.minimum(new, most[source])
        if not (new > most[source] + 1e-12).any():
            break
    # Where the caps hold more than is wanted, the whole source shrinks.
    now = np.bincount(source, weight * sizes, len(given))
    return weight * np.divide(given, now, out=np.ones_like(now), where=now > given)[source]


def plan(docs: DataFrame, targets: DataFrame) -> tuple[list[tuple], float, dict[str, float]]:
    """Rows (source, cell_lang, cell_topic, weight), the total and the tokens of each source.

    The driver holds one row of five values a cell, ``CELLS`` at most: every
    language and every topic is a margin of its own.
    """
    wanted = [(r["source"], r["target_share"], r["max_repeat"] or 0) for r in targets.dropDuplicates(["source"]).where("source is not null").collect()]
    rows = cells(docs.where("n_tokens > 0").join(small(targets.select("source").distinct()), "source")).limit(CELLS + 1).collect()
    if len(rows) > CELLS:
        raise ValueError(f"more than {CELLS} cells of source, language and topic")
    sizes: dict[str, int] = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["tokens"]
    total, given = fill(sizes, wanted)
    if not rows:
        return [], total, given
    names = [w[0] for w in wanted]
    number = {s: i for i, s in enumerate(names)}
    source = np.array([number[r["source"]] for r in rows])
    margins = []
    for c in ("cell_lang", "cell_topic"):
        margins.append(np.unique([r[c] for r in rows], return_inverse=True)[1])
    weight = rake(
        np.array([r["tokens"] for r in rows], float), source, margins, np.array([given.get(s, 0.0) for s in names]), np.array([float(w[2]) for w in wanted])
    )
    return [(r["source"], r["cell_lang"], r["cell_topic"], float(w)) for r, w in zip(rows, weight)], total, given


def sized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, category and n_tokens of the documents with a source and a text."""
    rows = docs.where(F.col("source").isNotNull()).select("doc_id", "source", "lang", "category", "text")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return count(rows.repartition(3 * cores), path).select("doc_id", "source", "lang", "category", "n_tokens")


#: Groups into which the documents of one source and size are divided, so that none holds a third of all rows.
PARTS = 64


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, repeats: how often each used document is used.

    Documents without a source, or with one that has no target, stay out, as do
    texts without tokens. No document is used more than its source's max_repeat
    times. Whole uses are drawn systematically: along the documents of a source in
    the order of their sizes a running sum of the weights is kept, and a document is
    used each time it passes a whole number and a half. The uses are never more than
    half a use off the weights up to there, and sizes only grow, so a source's tokens
    come out within one document of what is wanted. Without targets or documents the
    result is empty.
    """
    return draw(keep(ready(docs, path)), targets, seed)


def ready(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Sizes and cells of the documents with a source; a null language or topic is "none"."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return keep(sized(docs, path)).withColumn("cell_lang", name("lang")).withColumn("cell_topic", name("category"))


def draw(rows: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Repeats of the documents in ``rows`` (see ``ready``).

    The running sum is made in two steps, within groups of one source, size and part
    and over the totals of the groups, so that no task sorts a source.
    """
    spark = rows.sparkSession
    planned, _, _ = plan(rows, targets)
    weights = small(spark.createDataFrame(planned, "source string, cell_lang string, cell_topic string, weight double"))
    caps = targets.dropDuplicates(["source"]).select("source", F.col("max_repeat").cast("long").alias("cap"))
    code = F.xxhash64("doc_id", F.lit(seed))
    group = ["source", "n_tokens", "part"]
    joined = rows.where("n_tokens > 0").join(weights, ["source", "cell_lang", "cell_topic"]).join(small(caps), "source").withColumn("part", F.pmod(code, F.lit(PARTS)))
    own = F.sum("weight").over(Window.partitionBy(*group).orderBy(code, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("source").orderBy("n_tokens", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    totals = joined.groupBy(*group).agg(F.sum("weight").alias("total")).withColumn("before", before).drop("total")
    numbered = joined.withColumn("own", own).join(totals, group).withColumn("upto", F.col("own") + F.col("before"))
    repeats = F.floor(F.col("upto") + 0.5 + 1e-9) - F.floor(F.col("upto") - F.col("weight") + 0.5 + 1e-9)
    return numbered.withColumn("repeats", F.least("cap", repeats)).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def report(mixed: DataFrame, docs_sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, reached_share, tokens, documents, uses, available_tokens, max_repeat: one row a target."""
    used = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.sum("repeats").alias("uses")
    )
    have = docs_sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    rows = targets.join(used, "source", "left").join(have, "source", "left").fillna(0, ["tokens", "documents", "uses", "available_tokens"])
    # One row a target: the only window without a partition.
    rows = rows.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    return rows.select(
        "source",
        "target_share",
        F.round(F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0), 6).alias("reached_share"),
        "tokens",
        "documents",
        "uses",
        "available_tokens",
        "max_repeat",
    )


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their number of uses."""
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that the sources reach next to their targets."""
    targets = read(spark, sf_dir, "mix_targets")
    rows = keep(ready(read(spark, sf_dir, "documents")))
    return report(draw(rows, targets), rows, targets)
