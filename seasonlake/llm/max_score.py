"""Exact top-k by inner product over integer weights: MaxScore on signed postings.

A dimension is two terms, one for the rows with a positive weight and one for those with a
negative one. Against a query the term of the query's own sign adds to a score and the
other one takes away, so the sum of the adding parts bounds a score from above. Terms are
ordered by their largest possible part; those whose bounds together stay below the k-th
best score so far are non-essential: a row found in no essential posting cannot enter.
Rows found there are completed term by term while they can still compete. Shards are
searched alone and merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlake.llm.common import valid_vectors
from seasonlake.llm.grid import merge_top, search_cells

FOUND = "query_id long, vec_id long, score long"


class Postings:
    """Rows of one shard by (dimension, sign), heaviest first."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for d in range(weights.shape[1]):
            column = weights[:, d]
            for sign in (1, -1):
                rows = np.flatnonzero(column * sign > 0)
                if len(rows):
                    rows = rows[np.argsort(-column[rows] * sign, kind="stable")]
                    self.lists[d, sign] = rows, column[rows] * sign

    def top(self, query: np.ndarray, allowed: np.ndarray, k: int, seed_rows: int = 16) -> np.ndarray:
        """Rows that can be among the best ``k`` allowed ones; their scores are exact."""
        terms = []
        for d in np.flatnonzero(query):
            sign = 1 if query[d] > 0 else -1
            if (d, sign) in self.lists:
                rows, weight = self.lists[d, sign]
                terms.append((int(weight[0]) * abs(int(query[d])), int(d), rows, weight))
        terms.sort(key=lambda t: -t[0])
        every = np.flatnonzero(allowed)
        if len(every) <= k or not terms:
            return every
        # a first bar from the heaviest rows of the heaviest terms, scored in full
        seen = np.unique(np.concatenate([t[2][:seed_rows] for t in terms[:4]]))
        seen = seen[allowed[seen]]
        if len(seen) < k:
            seen = every[:k]
        bar = np.partition(self.weights[seen] @ query, -k)[-k]
        bounds = np.array([t[0] for t in terms])
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # bound of the terms from i on
        essential = int(np.searchsorted(-rest, -bar, side="right"))  # first i with rest[i] < bar
        if bar <= 0 or essential > len(terms):
            return every
        sums = np.zeros(len(self.weights), dtype=np.int64)
        hit = np.zeros(len(self.weights), dtype=bool)
        for _, d, rows, weight in terms[:essential]:
            sums[rows] += weight * abs(int(query[d]))
            hit[rows] = True
        alive = np.flatnonzero(hit & allowed & (sums + rest[essential] >= bar))
        sums = sums[alive]
        for i in range(essential, len(terms)):
            d = terms[i][1]
            sums = sums + np.maximum(self.weights[alive, d] * query[d], 0)
            keep = sums + rest[i + 1] >= bar
            alive, sums = alive[keep], sums[keep]
        return alive


def top_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, rows_per_shard: int = 4096,
    queries_per_block: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score long): the ``k`` largest integer inner products.

    Both frames hold unique ids and ``v`` array<long>. A query is never its own result;
    with fewer than ``k`` other rows all are returned; ties go to the smaller id; a
    shorter vector is continued by zeros. Every row is searched and the result is exact,
    in 64-bit integers.
    """

    def rows_of(frame: pd.DataFrame, width: int) -> np.ndarray:
        out = np.zeros((len(frame), width), dtype=np.int64)
        for i, v in enumerate(frame["v"]):
            out[i, : len(v)] = v
        return out

    def cell(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(1, max(map(len, rows["v"])), max(map(len, asked["v"])))
        ids = rows["vec_id"].to_numpy()
        postings = Postings(rows_of(rows, width))
        out = []
        for query_id, query in zip(asked["vec_id"], rows_of(asked, width)):
            pick = postings.top(query, ids != query_id, k)
            score = postings.weights[pick] @ query
            best = np.lexsort((ids[pick], -score))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[pick][best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    return merge_top(search_cells(vectors, queries, cell, FOUND, rows_per_shard, queries_per_block), k)


def search_products(
    embeddings: DataFrame, every: int = 50, scale: int = 256, k: int = 5,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Weights are floor(scale * x); rows with an id divisible by ``every`` are queries."""
    weights = valid_vectors(embeddings, key, vector, nonzero=False).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * scale)).cast("array<long>").alias("v")
    )
    return top_products(weights, weights.where(F.col("vec_id") % every == 0), k)
