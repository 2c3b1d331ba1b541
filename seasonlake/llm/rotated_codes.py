"""Nearest neighbours by randomly rotated one-bit codes, reranked exactly.

A vector is scaled to length one, rotated by a fixed random orthogonal matrix and kept as
the signs of its coordinates. With x the code scaled to length one, <x, o> (``align``)
corrects the estimate <x, q> / <x, o> of the cosine, whose error stays under
sqrt((1 - align^2) / align^2) * eps / sqrt(dim - 1) but for a share that falls off like a
normal tail in ``eps``. A candidate is reranked on its original vector when its upper
bound reaches the k-th best lower bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlake.llm.common import valid_vectors
from seasonlake.llm.grid import merge_top, search_cells

INDEX = "vec_id long, v array<double>, code binary, align double"
FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows of one width; a shorter vector is continued by zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; the division by the largest part keeps squares in range."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def with_length(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors with their lengths; where squares leave the range, scaled first."""
    with np.errstate(over="ignore"):
        length = np.sqrt((m * m).sum(axis=1))
    far = ~np.isfinite(length) | (length < 1e-140)
    m[far] = unit(m[far])
    length[far] = np.sqrt((m[far] * m[far]).sum(axis=1))
    return m, length


def encode(vectors: DataFrame, dim: int, seed: int) -> DataFrame:
    """Index rows: packed sign bits of the rotated vector and its correction scalar."""

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dim, seed)
        for part in parts:
            if len(part):
                turned = unit(matrix(part["v"], dim)) @ turn
                yield part.assign(
                    code=[c.tobytes() for c in np.packbits(turned > 0, axis=1)],
                    align=np.abs(turned).sum(axis=1) / np.sqrt(dim),
                )

    return vectors.mapInPandas(index, INDEX)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, eps: float = 3.5, seed: int = 11,
    rows_per_shard: int = 4096, queries_per_block: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest cosines of each query.

    Both frames come from ``valid_vectors``: no null, zero or non-finite vector takes
    part and an id occurs once. A query is never its own neighbour; with fewer than
    ``k`` other rows all of them are returned; no vectors give no rows. Every row is
    indexed; nothing is sampled or capped.
    """
    dim = vectors.select(F.max(F.size("v"))).first()[0]
    if not dim:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = -(-dim // 8) * 8

    def cell(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        ids = rows["vec_id"].to_numpy()
        exact, length = with_length(matrix(rows["v"], width))
        codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), width // 8)
        align = rows["align"].to_numpy()
        error = np.sqrt(np.maximum(1 - align**2, 0)) / align * eps / np.sqrt(width - 1)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0
        wanted, long = with_length(matrix(asked["v"], width))
        turned = unit(wanted) @ rotation(width, seed) / np.sqrt(width)
        columns = np.ascontiguousarray(codes.T)
        out = []
        for query, own, size, spun in zip(asked["vec_id"], wanted, long, turned):
            sums = bits @ spun.reshape(-1, 8).T  # of every byte value, at every byte
            near = np.zeros(len(ids))
            for at, column in enumerate(columns):
                near += sums[column, at]
            near /= align
            other = ids != query
            low = np.where(other, near - error, -np.inf)
            least = np.partition(low, -k)[-k] if len(ids) > k else -np.inf
            pick = np.flatnonzero(other & (near + error >= least))
            # row by row, so that equal vectors get equal bits and ties go by id
            score = (exact[pick] * own).sum(axis=1) / (length[pick] * size)
            best = np.lexsort((ids[pick], -score))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[pick][best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    indexed = encode(vectors, width, seed)
    return merge_top(search_cells(indexed, queries, cell, FOUND, rows_per_shard, queries_per_block), k)


def search_embeddings(
    embeddings: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Search the rows whose id is divisible by ``every`` against all other rows."""
    vectors = valid_vectors(embeddings, key, vector, nonzero=True)
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k)
