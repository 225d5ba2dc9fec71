"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Space: a vector x is scaled by the largest norm and gets one more coordinate, which completes its length to one; a
query is scaled to length one. The Euclidean distance of the two then falls exactly as the inner product grows.

Index: every row enters ``tables`` hash tables. A table's key is ``floor(a_i . x / w + b_i)`` for ``hashes`` Gaussian
directions; their number follows the logarithm of the row count, so that a bucket holds about ``bucket_rows`` rows.

Probing: a query's projection lies at some distance from both borders of its slot in every direction. A bucket that
is one slot off in some of them is estimated to hold a near vector the likelier, the smaller the sum of the squared
distances to the borders crossed. All perturbations are visited in that order, up to the limit ``reach`` that the fit
found; no number of probes or candidates is fixed.

Fit: ``sample`` rows (smallest hash of the id) give the scale of the projections; for the first ``fit_queries`` of
them the true neighbours among all rows are found by plain products, and ``reach`` is the sum within which the share
``recall`` of those neighbours falls into some visited bucket. The sample is all that the driver sees.

Work: buckets are dealt by hash to tiles of about ``tile_vectors`` rows; a query goes once to each tile in which it
visits buckets, with their list. Tiles with more rows or queries than their bounds are split both ways, so a bucket
that holds a third of all rows is many tiles. A tile ranks the rows of a query's visited buckets by their exact inner
product and lets only the k best leave; what the tables found for a query is merged by candidate and cut to k. Queries for which fewer than k
rows were visited are compared with every row of the table, in the same tiles.

Defined cases. Vectors that are null, zero or hold null or non-finite components, and rows without an id, take no
part. Vectors of different length are not compared. Rows that carry a query's own id are no candidates of it; a query
id that repeats is asked once (its first vector in order); a candidate id that repeats is listed once, at its best
score. Equal scores: smaller id first. Empty table or no queries: empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.llm.common import named, parallelism
from pulsetrace.session import materialise


@dataclass(frozen=True)
class Index:
    k: int = 20
    tables: int = 8
    bucket_rows: int = 128
    #: Width of a slot in standard deviations of the projections; widened until ``recall`` can be reached.
    slot: float = 2.0
    recall: float = 0.95
    sample: int = 1024
    fit_queries: int = 128
    tile_vectors: int = 16384
    tile_queries: int = 16384
    seed: int = 11


@dataclass(frozen=True)
class Fitted:
    """What the tasks need: one number per setting and one norm per vector length."""

    norms: dict[int, float]
    hashes: int
    width: float
    reach: float
    settings: Index

    def directions(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Directions (coordinates + 1, tables, hashes), shifts and the multipliers that make a key of the slots."""
        rng = np.random.default_rng([self.settings.seed, width])
        shape = (self.settings.tables, self.hashes)
        turns = rng.normal(size=(width + 1, *shape))
        return turns, rng.uniform(size=shape), rng.integers(1, 1 << 62, shape, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and v of the rows that take part; the components keep their type."""
    value = F.col("v")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(named(id_column).cast("long").alias("id"), named(column).alias("v")).where(
        F.col("id").isNotNull() & value.isNotNull() & fine & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Doubles of a list column whose rows have one length."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def by_length(batch: pa.RecordBatch | pa.Table, column: str = "v") -> Iterator[tuple[int, pa.Array]]:
    lengths = np.asarray(pa.compute.list_value_length(batch.column(column)))
    for n in np.unique(lengths):
        yield int(n), pa.array(np.flatnonzero(lengths == n))


def inner(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Inner products in doubles, each summed from the first component to the last."""
    return np.cumsum(rows * one, axis=1)[:, -1]


def ranked(ids: np.ndarray, rows: np.ndarray, one: np.ndarray, k: int, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and exact scores, each id once; a rounding margin keeps every row that may belong to them.

    ``single``: no id occurs twice.
    """
    near = rows @ one
    margin = 1e-9 * max(1.0, np.abs(one).max() * len(one))
    room = max(k, 1)
    while True:
        if len(near) > room:
            least = np.partition(near, len(near) - room)[len(near) - room]
            chosen = np.flatnonzero(near >= least - margin * (1 + abs(least)))
        else:
            chosen = np.arange(len(near))
        score = inner(rows[chosen], one)
        order = np.lexsort((ids[chosen], -score))
        who, score = ids[chosen][order], score[order]
        if single:
            return who[:k], score[:k]
        first = np.sort(np.unique(who, return_index=True)[1])
        if len(first) >= k or len(chosen) == len(near):
            return who[first][:k], score[first][:k]
        room *= 2


def lifted(rows: np.ndarray, norm: float) -> np.ndarray:
    """Rows scaled by the largest norm, with the coordinate that completes them to length one."""
    scaled = rows / norm
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
    return np.concatenate([scaled, rest[:, None]], axis=1)


def turned(rows: np.ndarray) -> np.ndarray:
    """Queries of length one, with a last coordinate of zero; the peak is taken out first, against overflow."""
    unit = rows / np.abs(rows).max(axis=1, keepdims=True)
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    return np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)


def places(points: np.ndarray, model: Fitted) -> tuple[np.ndarray, np.ndarray]:
    """Slots (rows, tables, hashes) and the distance to the lower border of each, in slot widths."""
    turns, shifts, _ = model.directions(points.shape[1] - 1)
    at = np.tensordot(points, turns, 1) / model.width + shifts
    slots = np.floor(at)
    return slots.astype(np.int64), at - slots


def perturbed(low: np.ndarray, weights: np.ndarray, reach: float) -> np.ndarray:
    """Changes of a bucket's key within ``reach``, likeliest bucket first.

    ``low``: distance to the lower border in every direction. Partial sums never fall, so what exceeds the limit is
    dropped on the way and no perturbation inside it is missed.
    """
    cost, change = np.zeros(1), np.zeros(1, np.uint64)
    order = np.argsort(np.minimum(low, 1 - low))[::-1]  # dear directions first: fewer sums live on
    for x, weight in zip(low[order], weights[order]):
        with np.errstate(over="ignore"):
            cost = np.concatenate([cost, cost + x * x, cost + (1 - x) ** 2])
            change = np.concatenate([change, change - weight, change + weight])
        inside = cost <= reach
        cost, change = cost[inside], change[inside]
    return change[np.argsort(cost, kind="stable")]


def keys(slots: np.ndarray, model: Fitted, width: int) -> np.ndarray:
    """One 64-bit key per row and table; linear in the slots, so a perturbed bucket's key is a sum."""
    return (slots.view(np.uint64) * model.directions(width)[2]).sum(axis=2, dtype=np.uint64)


# --- fit


def neighbours(table: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> dict[int, np.ndarray]:
    """True k nearest vectors of each of the few asked (id -> rows), found by products with every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for width, rows in by_length(batch):
                if width not in asked:
                    continue
                part = batch.take(rows)
                ids, table = part.column("id").to_numpy(), matrix(part.column("v"))
                for at, (own, scores) in enumerate(zip(asked[width][0], asked[width][1] @ table.T)):
                    scores = np.where(ids == own, -np.inf, scores)
                    score, vector = best.get((width, at), (np.empty(0), np.empty((0, width))))
                    score, vector = np.append(score, scores), np.concatenate([vector, table])
                    top = np.argsort(-score, kind="stable")[:k]
                    best[width, at] = score[top], vector[top]
        found = [(w, q, float(s), v.tobytes()) for (w, q), (scores, vs) in best.items() for s, v in zip(scores, vs) if s > -np.inf]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*found)) or [[]] * 4, kinds)],
                                         names=["width", "q", "score", "v"])

    lists = table.mapInArrow(run, "width int, q int, score double, v binary")
    entry = F.struct((-F.col("score")).alias("below"), "v")
    tops = lists.groupBy("width", "q").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))
    out: dict = {}
    for row in tops.collect():  # k vectors for each of the fit's queries
        out[row.width, row.q] = np.array([np.frombuffer(x.v) for x in row.top])
    return out


def fit(table: DataFrame, settings: Index = Index()) -> Fitted | None:
    """Scale, number of hashes and limit of the probing; None for an empty table."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = table.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.sqrt(F.max(norm)).alias("norm")).collect()
    if not sizes:
        return None
    norms = {r.width: r.norm if 0 < r.norm < math.inf else 1.0 for r in sizes}
    rows = table.orderBy(F.xxhash64("id", "v"), "id").limit(settings.sample).collect()
    groups: dict[int, list] = {}
    for r in rows:
        groups.setdefault(len(r.v), []).append(r)
    asked, points = {}, []
    share = settings.fit_queries / len(rows)
    for width, group in groups.items():
        values = np.array([r.v for r in group], np.float64)
        points.append((width, lifted(values, norms[width])))
        few = max(1, round(share * len(group)))
        asked[width] = np.array([r.id for r in group[:few]]), values[:few]
    hashes = max(2, round(math.log2(max(4.0, sum(r.n for r in sizes) / settings.bucket_rows))))
    truth = neighbours(table, asked, settings.k)
    plain = Fitted(norms, hashes, 1.0, 0.0, settings)
    spread = [np.tensordot(p - p.mean(axis=0), plain.directions(w)[0], 1).std() * len(p) for w, p in points]
    width = settings.slot * max(1e-6, sum(spread) / sum(len(p) for _, p in points))
    for _ in range(8):
        model = Fitted(norms, hashes, width, 0.0, settings)
        costs = []
        for (length, q), near in truth.items():
            slots, low = places(turned(asked[length][1][q: q + 1]), model)
            moves = places(lifted(near, norms[length]), model)[0] - slots
            cost = np.where(moves == 0, 0.0, np.where(moves == -1, low**2, np.where(moves == 1, (1 - low) ** 2, np.inf)))
            costs.append(cost.sum(axis=2).min(axis=1))
        reach = float(np.quantile(np.concatenate(costs), settings.recall, method="higher")) if costs else 0.0
        if reach < math.inf:
            break
        width *= 1.5
    return Fitted(norms, hashes, width, min(reach, float(hashes)), settings)


# --- search


def entries(table: DataFrame, model: Fitted, shards: int) -> DataFrame:
    """A row (t, shard, id, v, code) for every vector and hash table."""
    kind = table.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, rows in by_length(batch):
                part = batch.take(rows)
                slots, _ = places(lifted(matrix(part.column("v")), model.norms[width]), model)
                codes = keys(slots, model, width)
                for t in range(codes.shape[1]):
                    code = codes[:, t]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(code), t, np.int32)), pa.array((code % np.uint64(shards)).astype(np.int32)),
                         part.column("id"), part.column("v"), pa.array(code.view(np.int64))], names=["t", "shard", "id", "v", "code"])

    return table.mapInArrow(run, f"t int, shard int, id long, v {kind}, code long")


def probes(queries: DataFrame, model: Fitted, shards: int) -> DataFrame:
    """A row (t, shard, id, v, codes) for every query and tile it visits, the buckets in visiting order."""
    kind = queries.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, rows in by_length(batch):
                weights = model.directions(width)[2]
                for lo in range(0, len(rows), 64):
                    part = batch.take(rows.slice(lo, 64))
                    slots, low = places(turned(matrix(part.column("v"))), model)
                    codes = keys(slots, model, width)
                    row, table, shard, lists = [], [], [], []
                    for q in range(part.num_rows):
                        for t in range(codes.shape[1]):
                            visited = codes[q, t] + perturbed(low[q, t], weights[t], model.reach)
                            home = (visited % np.uint64(shards)).astype(np.int32)
                            for s in np.unique(home):
                                row.append(q)
                                table.append(t)
                                shard.append(s)
                                lists.append(visited[home == s].view(np.int64))
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(table, pa.int32()), pa.array(shard, pa.int32()), part.column("id").take(pa.array(row)),
                         part.column("v").take(pa.array(row)), pa.ListArray.from_arrays(ends, np.concatenate(lists))],
                        names=["t", "shard", "id", "v", "codes"])

    return queries.mapInArrow(run, f"t int, shard int, id long, v {kind}, codes array<long>")


def tile(asked: pa.Table, stored: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query among those of its visited buckets (all rows where ``codes`` is null)."""
    out_query, out_ids, out_scores = [], [], []
    if asked.num_rows and stored.num_rows:
        for width, rows in by_length(asked):
            mine = asked.take(rows)
            lengths = np.asarray(pa.compute.list_value_length(stored.column("v")))
            held = stored.filter(pa.array(lengths == width)).sort_by([("code", "ascending"), ("id", "ascending")])
            if not held.num_rows:
                continue
            codes, ids, table = held.column("code").to_numpy(), held.column("id").to_numpy(), matrix(held.column("v"))
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            buckets, starts, counts = codes[first], first, np.diff(np.append(first, len(codes)))
            single = len(np.unique(ids)) == len(ids)
            lists = mine.column("codes").combine_chunks()
            visited, cuts, whole = lists.values.to_numpy(), lists.offsets.to_numpy(), lists.is_null().to_numpy(zero_copy_only=False)
            for i, (own, one) in enumerate(zip(mine.column("id").to_numpy(), matrix(mine.column("v")))):
                if whole[i]:
                    rows_of = np.arange(len(ids))
                else:
                    want = visited[cuts[i]: cuts[i + 1]]
                    at = np.minimum(np.searchsorted(buckets, want), len(buckets) - 1)
                    at = at[buckets[at] == want]
                    n = counts[at]
                    rows_of = np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                rows_of = rows_of[ids[rows_of] != own]
                if len(rows_of):
                    who, score = ranked(ids[rows_of], table[rows_of], one, k, single)
                    out_query.append(own)
                    out_ids.append(who)
                    out_scores.append(score)
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out_ids])]), pa.int32())
    return pa.table({"query_id": pa.array(out_query, pa.int64()), "ids": pa.ListArray.from_arrays(ends, flat(out_ids, np.int64)),
                     "scores": pa.ListArray.from_arrays(ends, flat(out_scores, np.float64))})


def first_k(query: np.ndarray, who: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each query the k best entries in order, each id once, with their ranks."""
    order = np.lexsort((who, -score, query))
    query, who, score = query[order], who[order], score[order]
    twins = np.lexsort((np.arange(len(who)), who, query))
    again = (query[twins][1:] == query[twins][:-1]) & (who[twins][1:] == who[twins][:-1])
    once = np.ones(len(who), bool)
    once[twins[1:][again]] = False
    query, who, score = query[once], who[once], score[once]
    rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
    return tuple(x[rank <= k] for x in (query, rank, who, score))


def merged(lists: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score from the lists of all tiles; one query's lists are in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for batch in batches:
            n = np.asarray(pa.compute.list_value_length(batch.column("ids")))
            now = [np.repeat(batch.column("query_id").to_numpy(), n), *(batch.column(c).flatten().to_numpy() for c in ("ids", "scores"))]
            query, who, score = (np.concatenate(pair) for pair in zip(left, now))
            open_from = np.searchsorted(query, query[-1]) if len(query) else 0  # the last query may go on
            left = [x[open_from:] for x in (query, who, score)]
            yield ranked_batch(first_k(query[:open_from], who[:open_from], score[:open_from], k))
        yield ranked_batch(first_k(*left, k))

    by_query = lists.repartition(parallelism(lists), "query_id").sortWithinPartitions("query_id")
    return by_query.mapInArrow(run, "query_id long, rank int, id long, score double")


def ranked_batch(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["query_id", "rank", "id", "score"])


def met(left: DataFrame, right: DataFrame, settings: Index) -> DataFrame:
    """query_id, rank, id, score of queries ``left`` against rows ``right``, both dealt to (t, shard)."""
    held, wanted = (x.groupBy("t", "shard").agg(F.count("*").alias(n)) for x, n in ((right, "rows"), (left, "asked")))
    up = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    parts = materialise(held.join(wanted, ["t", "shard"]).select(
        "t", "shard", up("rows", settings.tile_vectors).alias("cuts"), up("asked", settings.tile_queries).alias("blocks")))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(parts, ["t", "shard"]).withColumn("block", deal("blocks")).withColumn("cut", each("cuts"))
    right = right.join(parts, ["t", "shard"]).withColumn("cut", deal("cuts")).withColumn("block", each("blocks"))
    k, where = settings.k, ["t", "shard", "cut", "block"]
    left, right = left.drop("cuts", "blocks"), right.drop("cuts", "blocks")
    lists = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(
        lambda a, b: tile(a, b, k), "query_id long, ids array<long>, scores array<double>")
    return merged(lists, k)


def search(queries: DataFrame, table: DataFrame, settings: Index = Index()) -> DataFrame:
    """query_id, rank (from 1), id, score; both inputs have ``id`` and ``v``, and ``table`` is stored."""
    model = fit(table, settings)
    if model is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    sizes = {r.width: r.n for r in table.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()}
    shards = math.ceil(sum(sizes.values()) / settings.tile_vectors)
    queries = materialise(queries.groupBy("id").agg(F.min("v").alias("v")).repartition(parallelism(table)))
    stored = entries(table, model, shards)
    found = materialise(met(probes(queries, model, shards), stored, settings))
    most = F.least(F.lit(settings.k), F.coalesce(*[F.when(F.size("v") == w, F.lit(n - 1)) for w, n in sizes.items()]))
    got = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("got"))
    short = materialise(queries.join(got, "id", "left").where(F.coalesce("got", F.lit(0)) < most).select("id", "v"))
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        whole = short.select(F.lit(0).alias("t"), every, "id", "v", F.lit(None).cast("array<long>").alias("codes"))
        again = met(whole, stored.where("t = 0"), settings)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(again)
    return found


def nearest(vectors: DataFrame, every: int = 20, settings: Index = Index(), id_column: str = "vec_id",
            column: str = "embedding") -> DataFrame:
    """Searches with the rows whose id is divisible by ``every`` against all rows."""
    table = materialise(usable(vectors, id_column, column))
    return search(table.where(F.col("id") % every == 0), table, settings)
