"""Sessions over a stream of flows, with state that stays bounded."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsetrace.config import DEFAULTS, SESSION_KEYS, Settings
from pulsetrace.operators.asof import carried
from pulsetrace.operators.joins import counted_lookup

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flow_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Flows arriving as files in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time() -> Column:
    return F.timestamp_micros("ts_us")


def windowed_sessions(flows: DataFrame, length: str = "6 hours", slide: str = "3 hours",
                      delay: str = "1 hour", keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Sums per session and sliding window; a window leaves the state once the watermark passes it.

    Works on streams and on batches alike. The aggregate is combined before the shuffle, so a busy
    session costs one row per task.
    """
    timed = flows.withColumn("_time", event_time())
    if flows.isStreaming:
        timed = timed.withWatermark("_time", delay)
    sums = timed.groupBy(*keys, F.window("_time", length, slide).alias("w")).agg(
        F.count("*").alias("n_flows"),
        F.sum(F.coalesce("orig_ip_bytes", F.lit(0))).alias("sent"),
        F.sum(F.coalesce("resp_ip_bytes", F.lit(0))).alias("received"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    pace = F.try_divide(F.col("last_us") - F.col("first_us"), F.col("n_flows") - 1) / F.lit(1e6)
    return sums.select(*keys, F.unix_micros(F.col("w.start")).alias("window_us"), "n_flows", "sent",
                       "received", "first_us", "last_us", pace.alias("mean_interval"))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; results go to a Parquet table."""
    query = (df.writeStream.outputMode(mode).format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


#: Sessions share so many groups of state; a constant of the method, not of the data.
BUCKETS = 1024
#: Key, flows settled, flows without a time, last settled time, interval moments, late flows, when to expire, open times.
STATE = pa.schema([("key", pa.string()), ("n", pa.int64()), ("untimed", pa.int64()), ("last", pa.int64()), ("mean", pa.float64()),
                   ("m2", pa.float64()), ("late", pa.int64()), ("until", pa.int64()), ("open", pa.list_(pa.int64()))])
UPDATE = "n_flows bigint, iat_mean double, iat_std double, late bigint, assessable boolean"
MINUTE_US = 60_000_000


#: In place of the last time of a session that has none.
NEVER = -(1 << 62)


@dataclass
class Totals:
    """Per session: flows, last time, and mean and summed square deviation of the intervals in seconds."""

    n: np.ndarray
    last: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    def fold(self, codes: np.ndarray, times: np.ndarray) -> Totals:
        """Extended by later flows, ordered by session and time."""
        size = len(self.n)
        first = np.ones(len(codes), bool)
        first[1:] = codes[1:] != codes[:-1]
        before = np.empty(len(codes), np.int64)
        before[1:] = times[:-1]
        before[first] = self.last[codes[first]]
        known = before != NEVER
        at, gaps = codes[known], (times[known] - before[known]) / 1e6
        old, new = np.maximum(self.n - 1, 0), np.bincount(at, minlength=size)
        both = np.maximum(old + new, 1)
        centre = np.where(new > 0, np.bincount(at, gaps, size) / np.maximum(new, 1), self.mean)
        shift = centre - self.mean
        last = self.last.copy()
        final = np.ones(len(codes), bool)
        final[:-1] = first[1:]
        last[codes[final]] = times[final]
        return Totals(self.n + np.bincount(codes, minlength=size), last, self.mean + shift * new / both,
                      self.m2 + np.bincount(at, (gaps - centre[at]) ** 2, size) + shift * shift * old * new / both)


def minutes_of(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flows gathered by session and minute within each Arrow batch: keys, ``minute``, ``untimed``, ``times``, ``_time``.

    Stateless and without a shuffle; a session that fills a batch leaves it as one row per minute. Flows without a time
    are only counted.
    """
    names = [*keys, "minute"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([("ts_us", "list")])
            yield from found.select([*names, "ts_us_list"]).combine_chunks().to_batches()

    kinds = dict(flows.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    timed = flows.select(*keys, "ts_us", F.expr(f"ts_us - pmod(ts_us, {MINUTE_US}L)").alias("minute"))
    return timed.mapInArrow(gather, f"{head}, minute bigint, times array<bigint>").selectExpr(
        *keys, "coalesce(minute, 0L) AS minute", "IF(minute IS NULL, size(times), 0) AS untimed",
        "IF(minute IS NULL, cast(array() AS array<bigint>), times) AS times",
        "timestamp_micros(IF(minute IS NULL, NULL, array_max(times))) AS _time")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STATE) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _keep(state: GroupState, table: pa.Table) -> None:
    """Store the sessions of a bucket and when the next of them expires."""
    if table.num_rows:
        state.update((_packed(table),))
        state.setTimeoutTimestamp(pc.min(table["until"]).as_py())
    else:
        state.remove()


def running_sessions(wait_ms: int, minimum: int):
    """The step of one bucket of sessions in one micro-batch; all of its sessions are moved on together.

    The state of a session is the totals of what the watermark has passed and the times after it.
    """
    def step(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trailing = max(state.getCurrentWatermarkMs(), 0)  # 0 before the first batch is done
        known = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else STATE.empty_table()
        if state.hasTimedOut:
            _keep(state, known.filter(pc.greater(known["until"], trailing)))
            return
        mark = (trailing + wait_ms) * 1000 if trailing else NEVER
        came = pd.concat(list(rows), ignore_index=True)
        codes, keys = pd.factorize(np.concatenate([known["key"].to_numpy(), came["key"].to_numpy()]))
        size, old = len(keys), known.num_rows  # the known sessions have the first numbers
        row_codes = codes[old:]

        def column(name: str, empty=0) -> np.ndarray:
            values = known[name].to_numpy()
            return np.concatenate([values, np.full(size - old, empty, values.dtype)])

        untimed, late, until = column("untimed"), column("late"), column("until")
        np.add.at(untimed, row_codes, came["untimed"].to_numpy())
        touched = np.zeros(size, bool)
        touched[row_codes] = True
        times = np.concatenate([np.asarray(t, np.int64) for t in came["times"]])
        at = np.repeat(row_codes, [len(t) for t in came["times"]])
        until[touched] = np.maximum(until[touched], trailing + 1)
        np.maximum.at(until, at, times // 1000 + 1)
        fresh = times >= mark
        late += np.bincount(at[~fresh], minlength=size)
        open_ = known["open"].combine_chunks()
        held = np.concatenate([open_.flatten().to_numpy(), times[fresh]])
        of = np.concatenate([np.repeat(np.arange(old), pc.list_value_length(open_).to_numpy()), at[fresh]])
        order = np.lexsort((held, of))
        held, of = held[order], of[order]
        passed = held < mark
        settled = Totals(column("n"), column("last", NEVER), column("mean"), column("m2")).fold(of[passed], held[passed])
        held, of = held[~passed], of[~passed]
        now = settled.fold(of, held)
        counts = np.bincount(of, minlength=size)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        table = pa.Table.from_arrays([
            pa.array(keys, pa.string()), pa.array(settled.n), pa.array(untimed), pa.array(settled.last), pa.array(settled.mean),
            pa.array(settled.m2), pa.array(late), pa.array(until), pa.ListArray.from_arrays(pa.array(ends), pa.array(held))], schema=STATE)
        _keep(state, table.filter(pa.array(touched | (until > trailing))))
        found = pd.DataFrame({"key": keys, "n_flows": now.n + untimed, "iat_mean": now.mean,
                              "iat_std": np.sqrt(np.maximum(now.m2, 0.0) / np.maximum(now.n - 1, 1)), "late": late,
                              "assessable": now.n + untimed >= minimum})
        yield found[touched]

    return step


def partial_sessions(flows: DataFrame, settings: Settings = DEFAULTS,
                     idle: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """Running interval statistics per session, updated with every micro-batch.

    Flows may arrive out of order within ``delay``. A flow the watermark has not passed stays in the
    state, as an earlier one may still come; what the watermark has passed is folded into a few numbers.
    Every update covers both. A flow older than the watermark cannot be placed any more and is counted
    as late. One without a time counts as a flow that has no interval and is never late. ``assessable``
    stays false until the session has the minimum number of flows.

    Flows are gathered by session and minute before they are shuffled. Sessions are dealt into ``BUCKETS`` groups of
    state by hash; a micro-batch moves all sessions of a bucket on at once, in arrays, and costs a session no call of its
    own. It reads and writes the state of the buckets it has flows for.

    Spark's own watermark trails this one by ``idle``: it then hands over late flows instead of dropping
    them unseen, and a timeout expires a session that got nothing for so long. Only flows late by more than
    ``idle``, whose session is gone, are dropped (``numRowsDroppedByWatermark`` in the query's progress).

    Spark's RocksDB store, which keeps state on disk, is chosen in the session's settings here.
    """
    keys = list(settings.session_keys)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    trail = f"{int((pd.Timedelta(idle) + pd.Timedelta(delay)).total_seconds())} seconds"
    flows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kinds = dict(flows.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    dealt = minutes_of(flows, keys).select(
        F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket"), F.to_json(F.struct(*keys)).alias("key"), "untimed", "times", "_time")
    updates = dealt.withWatermark("_time", trail).groupBy("bucket").applyInPandasWithState(
        running_sessions(wait, settings.min_session_flows), f"key string, {UPDATE}", "sessions binary", "update",
        GroupStateTimeout.EventTimeTimeout)
    rest = [c for c in updates.columns if c != "key"]
    return updates.select(F.from_json("key", head).alias("key"), *rest).select("key.*", *rest)


def keep_latest(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Append each micro-batch of updates with its number; the last number per session is current."""
    def store(batch: DataFrame, number: int) -> None:
        # A replayed batch overwrites its own folder only.
        batch.write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    query = (updates.writeStream.outputMode("update").foreachBatch(store)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def current_sessions(spark: SparkSession, path: str, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    updates = spark.read.parquet(path)
    rest = [c for c in updates.columns if c not in (*keys, "batch_no")]
    return (updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_no").alias("s"))
            .select(*keys, "s.*"))


def late_rows(flows: DataFrame, arrival: Column, delay_us: int) -> DataFrame:
    """Rows per arrival slice that come after the watermark left by the slices before it.

    A slice's highest event time is one row per slice; its running maximum is swept over ranges of slices. The
    rows of a slice that holds very many are dealt out before they meet its mark. A null slice comes before all others.
    """
    sliced = flows.withColumn("slice", arrival)
    tops = sliced.groupBy("slice").agg(F.max("ts_us").alias("top"))
    marks = carried(tops, [], ["slice"], "top", "before", "max").select(
        "slice", (F.col("before") - F.lit(delay_us)).alias("mark"))
    late = F.coalesce(F.col("ts_us") < F.col("mark"), F.lit(False))
    return counted_lookup(sliced.select("slice", "ts_us"), marks, ["slice"], ["ts_us"]).groupBy("slice").agg(
        F.count("*").alias("n_rows"), F.count_if(late).alias("n_late"))
