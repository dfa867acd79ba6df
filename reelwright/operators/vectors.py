"""Nearest vectors of a stated set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the vectors serves, and groups of vectors that each block of queries is sent to.
BLOCK, GROUPS = 512, 64


def _matrix(values: pa.Array) -> np.ndarray:
    x = np.array(values.to_pylist(), float)
    return x / np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-300)[:, None]


def best_matches(vectors: DataFrame, is_query: Column, digits: int = 6) -> DataFrame:
    """(ref, other, score): for each query the other vector with the highest cosine, the smaller id of equal ones.

    Queries are put into blocks; every batch of vectors meets each block once and gives on one candidate per query, so
    what is shuffled is small. Vectors are of one length; zero vectors have cosine 0 with all.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    queries = rows.filter(is_query).select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)).alias("h"))
    n_blocks = max(1, -(-queries.count() // BLOCK))
    blocks = queries.groupBy((F.col("h") % n_blocks).alias("block")).agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"))
    parts = rows.groupBy(F.spark_partition_id().alias("p"), F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("q")).agg(F.collect_list("vec_id").alias("o"), F.collect_list("v").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for ids, vs, o, w in zip(*batch.columns, strict=True):
                refs, others = np.array(ids.as_py()), np.array(o.as_py())
                order = np.argsort(others)
                others = others[order]
                score = np.round(_matrix(vs.values) @ _matrix(w.values)[order].T, digits)
                score[refs[:, None] == others[None, :]] = -2
                best = score.argmax(axis=1)
                for target, values in zip(out, (refs, others[best], score[np.arange(len(refs)), best]), strict=True):
                    target.extend(values.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["ref", "other", "score"])

    # every block meets every part, by the number of the part's group: no task has more than its groups
    grouped = parts.withColumn("g", F.pmod(F.xxhash64("p", "q"), F.lit(GROUPS)))
    sent = blocks.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long"))))
    met = grouped.join(sent, "g").select("ids", "vs", "o", "w").mapInArrow(run, "ref long, other long, score double").filter("score > -2")
    first = Window.partitionBy("ref").orderBy(F.desc("score"), "other")
    return met.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
