"""Exact top-k search by inner product: tiles of queries and shards, partial selection, tree merge.

Queries and candidates are dealt by hash to a grid whose row and column counts follow their numbers, so that no
tile exceeds ``tile_queries`` by ``tile_vectors`` on average and there are enough tiles for all tasks. A tile is
one matrix product in blocks of queries; per query only its k best leave the tile. Lists then meet eight at a
time, level by level, until each query has one.

Defined cases. Vectors that are null or hold a null or non-finite component, and rows without an id, take no part.
Vectors of different length are not compared. Rows that carry a query's own id are no candidates of it; a query id
that repeats is asked once (its first vector in order). Equal scores: smaller id first. Empty table or no queries:
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.llm.common import named, parallelism
from pulsetrace.session import materialise


@dataclass(frozen=True)
class Search:
    k: int = 20
    tile_queries: int = 4096
    tile_vectors: int = 32768
    #: Query rows of one matrix product inside a tile.
    block: int = 256
    #: Lists that meet in one merge.
    fan_in: int = 8


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 64) -> DataFrame:
    """id and whole-number components floor(scale * x) of the usable rows."""
    wide = F.transform(named(column), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.select(named(id_column).cast("long").alias("id"), wide.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    return usable.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrix(column: pa.ChunkedArray, rows: np.ndarray, width: int) -> np.ndarray:
    return np.array([column[int(i)].as_py() for i in rows], np.int64).reshape(len(rows), width)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of one query and their ids; ``ids`` ascend, so the first of equal scores wins."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        chosen = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        chosen = np.arange(len(scores))
    order = chosen[np.lexsort((ids[chosen], -scores[chosen]))]
    return scores[order], ids[order]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number products: in doubles where every sum stays below 2**53."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach < 2**63:
        return a @ b.T
    top = 2**63 - 1  # beyond the range of a long a score saturates
    exact = a.astype(object) @ b.astype(object).T
    return np.array([[max(-top, min(top, x)) for x in row] for row in exact], np.int64)


def search(queries: DataFrame, vectors: DataFrame, settings: Search = Search()) -> DataFrame:
    """query_id, rank (from 1), id, score; both inputs have ``id`` and ``v`` (array of long)."""
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n_queries, n_vectors = queries.count(), vectors.count()
    tasks = max(2 * parallelism(vectors), 1)
    rows = max(1, math.ceil(n_queries / settings.tile_queries), round(math.sqrt(tasks * n_queries / max(1, n_vectors))))
    columns = max(1, math.ceil(n_vectors / settings.tile_vectors), math.ceil(tasks / rows))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(deal(rows, 1).alias("r"), every(columns).alias("c"), "id", "v")
    right = vectors.select(deal(columns, 2).alias("c"), "id", "v").select(every(rows).alias("r"), "c", "id", "v")
    k, block = settings.k, settings.block

    def tile(asked: pa.Table, shard: pa.Table) -> pa.Table:
        out_query, out_tile, out_id, out_score = [], [], [], []
        if asked.num_rows and shard.num_rows:
            column = asked.column("c")[0].as_py()
            q_ids, s_ids = asked.column("id").to_numpy(), shard.column("id").to_numpy()
            q_width, s_width = (np.array([len(x) for x in t.column("v")]) for t in (asked, shard))
            for width in np.intersect1d(q_width, s_width):
                q_rows, s_rows = np.flatnonzero(q_width == width), np.flatnonzero(s_width == width)
                s_rows = s_rows[np.argsort(s_ids[s_rows], kind="stable")]
                ids, table = s_ids[s_rows], matrix(shard.column("v"), s_rows, width)
                for lo in range(0, len(q_rows), block):
                    part = q_rows[lo: lo + block]
                    for row, scores in zip(part, product(matrix(asked.column("v"), part, width), table)):
                        others = ids != q_ids[row]
                        found, who = best(scores[others], ids[others], k)
                        out_query.append(np.full(len(who), q_ids[row]))
                        out_tile.append(np.full(len(who), column, np.int32))
                        out_id.append(who)
                        out_score.append(found)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"query_id": join(out_query, np.int64), "tile": join(out_tile, np.int32),
                         "id": join(out_id, np.int64), "score": join(out_score, np.int64)})

    lists = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(
        tile, "query_id long, tile int, id long, score long")
    entry = F.struct((-F.col("score")).alias("below"), "id", "score")
    merged = lists.groupBy("query_id", "tile").agg(F.array_sort(F.collect_list(entry)).alias("top"))
    left_over = columns
    while True:
        left_over = math.ceil(left_over / settings.fan_in)
        merged = merged.groupBy("query_id", F.floor(F.col("tile") / settings.fan_in).cast("int").alias("tile")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if left_over <= 1:
            break
    return merged.select("query_id", F.posexplode("top").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "hit.id", "hit.score")


def nearest(vectors: DataFrame, every: int = 20, settings: Search = Search()) -> DataFrame:
    """Searches with the rows whose id is divisible by ``every`` against all rows."""
    table = materialise(quantised(vectors))
    return search(table.where(F.col("id") % every == 0), table, settings)
