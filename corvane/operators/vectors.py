"""Nearest vectors of a query set among all rows, exactly and in blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, row_blocks: int, query_blocks: int) -> DataFrame:
    """(query_id, id, similarity, rank): for every query its k most alike rows by cosine, without itself.

    Rows and queries are parted into blocks; every pair of blocks is one product of matrices that gives each query its k
    best of the block, and these are ranked.  A task holds one block of either side.  Vectors that are null, empty, of
    another length than most or of zero norm have similarity 0 to all.  Equal similarities rank by id.
    """
    import pandas as pd

    unit = lambda df, name: df.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("v")).filter(f"{name} is not null").dropDuplicates([name])
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    left = unit(queries, "query_id").select("*", block("query_id", query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))
    right = unit(rows, "id").select("*", block("id", row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))

    def matrix(values: list, size: int) -> np.ndarray:
        out = np.zeros((len(values), size))
        for i, x in enumerate(values):
            if x is not None and len(x) == size:
                out[i] = np.nan_to_num(np.asarray(x, float))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        if not len(a) or not len(b):
            return empty
        size = max(len(x) for x in [*a["v"], *b["v"]] if x is not None) if any(x is not None for x in [*a["v"], *b["v"]]) else 1
        b = b.sort_values("id")
        sim = np.round(matrix(list(a["v"]), size) @ matrix(list(b["v"]), size).T, 9)
        ids, qids = b["id"].to_numpy(), a["query_id"].to_numpy()
        sim[qids[:, None] == ids[None, :]] = -np.inf
        top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(qids, top.shape[1]), "id": ids[top].ravel(), "similarity": np.take_along_axis(sim, top, 1).ravel()})
        return out[np.isfinite(out["similarity"])]

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(best, "query_id bigint, id bigint, similarity double")
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
