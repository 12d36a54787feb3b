"""Exact cosine search over vectors: blocks of queries meet chunks of points by join keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that a task compares with a chunk of points at once.
BLOCK = 2048
#: Blocks whose best points a task holds before it gives them out.
HELD = 64


def _usable(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))


def top_k(points: DataFrame, queries: DataFrame, k: int, same: str | None = None, exclude_self: bool = True) -> DataFrame:
    """(qid, vec_id, score, rank): the k nearest points of each query by cosine, ties to the smaller id.

    ``points`` has vec_id and embedding, ``queries`` qid and vector (and ``same``,
    whose value a point must share). Null and empty vectors, vectors with nulls in
    them and those of length 0 are left out, as are points of another number of
    dimensions than the query. Points are read once and packed where they lie;
    queries are hashed into blocks of about 2,048. Every chunk of points goes once to
    every block, by (dimensions, ``same``, block, salt) in one join; nothing but the
    number of queries reaches the driver, and a task gives out k points a query.
    """
    spark = points.sparkSession
    asked = _usable(queries, "vector").withColumn("_same", F.col(same) if same else F.lit(0)).where("_same is not null")
    blocks = max(1, -(-asked.count() // BLOCK))
    # Few blocks would leave tasks without work: each is sent out under several salts, of which a chunk takes one.
    salts = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks))
    packed = asked.groupBy(F.size("vector").alias("dim"), "_same", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("qid", "vector")).alias("q"))
    sent = packed.select("dim", "_same", "block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("q.qid").alias("qids"), F.col("q.vector").alias("vectors"))
    kind = sent.schema["_same"].dataType.simpleString()
    own = _usable(points, "embedding").select(F.size("embedding").alias("dim"), (F.col(same) if same else F.lit(0)).alias("_same"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    chunks = own.where("_same is not null").mapInArrow(_pack, f"dim int, _same {kind}, salt bigint, ids array<bigint>, points array<float>")
    chunks = chunks.select("dim", "_same", F.pmod("salt", F.lit(salts)).cast("int").alias("salt"), "ids", "points", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    met = chunks.join(sent, ["dim", "_same", "block", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim, key = batch["dim"][i].as_py(), tuple(batch[c][i].as_py() for c in ("dim", "_same", "block"))
                qids, ids = (np.asarray(batch[c][i].values, np.int64) for c in ("qids", "ids"))
                q = _unit(np.asarray(batch["vectors"][i].values.flatten(), np.float64).reshape(-1, dim))
                p = _unit(np.asarray(batch["points"][i].values, np.float64).reshape(-1, dim))
                score = np.round(q @ p.T, 6)
                score[~np.isfinite(score)] = -np.inf
                if exclude_self:
                    score[qids[:, None] == ids[None, :]] = -np.inf
                best = _best(qids, ids, score, k)
                if key in held:
                    best = _merge(tuple(np.concatenate(x) for x in zip(held[key], best)), k)
                held[key] = best
                if len(held) > HELD:
                    yield _out(held)
        yield _out(held)

    found = met.mapInArrow(run, "qid bigint, vec_id bigint, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of length 0 become nan, which no score survives."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the points of a batch that share dimensions and value: their ids and their numbers one after another."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for pair in table.group_by(["dim", "_same"]).aggregate([]).to_pylist():
            own = table.filter((pa.compute.field("dim") == pair["dim"]) & (pa.compute.field("_same") == pair["_same"])).combine_chunks()
            n = own.num_rows
            ids, numbers = own["vec_id"].combine_chunks(), own["embedding"].combine_chunks().flatten()
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([pair["dim"]], pa.int32()), pa.array([pair["_same"]], batch.schema.field("_same").type), pa.array([hash(ids[0].as_py()) + n], pa.int64()), one(ids), one(numbers)],
                ["dim", "_same", "salt", "ids", "points"],
            )


def _best(qids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """qid, id and score of the k best columns of each row, ties at the edge by id."""
    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
    row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))
    return _merge((qids[row], ids[col], score[row, col]), k)


def _merge(rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    qid, vec, score = rows
    order = np.lexsort((vec, -score, qid))
    qid, vec, score = qid[order], vec[order], score[order]
    first = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]]) if len(qid) else np.zeros(0, int)
    place = np.arange(len(qid)) - np.repeat(first, np.diff(np.r_[first, len(qid)]))
    return qid[place < k], vec[place < k], score[place < k]


def _out(held: dict[tuple, tuple]) -> pa.RecordBatch:
    """The held rows as one batch; holds none afterwards."""
    cols = [np.concatenate([x[i] for x in held.values()]) if held else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
    held.clear()
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["qid", "vec_id", "score"])


def point_id(document: F.Column, chunk: F.Column) -> F.Column:
    """Name-based id of a point in the form of a UUID."""
    h = F.md5(F.concat_ws("_", document.cast("string"), chunk.cast("string")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
