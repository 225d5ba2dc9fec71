"""Passages that several documents share, by a sparse suffix array over words.

Of a text's suffixes only those stay that start at a minimiser: among the 26 word 25-grams of every 50-word window,
the one with the smallest hash. Equal windows choose equal places, so no shared passage of 50 words is missed, and
one suffix in about thirteen stays. A suffix carries its 25-gram's hash and one check value for each window that
chose it; those windows are its extensions to the left and right.

The suffixes are sorted by 25-gram; neighbours with the same one are compared window by window, and what agrees in
two documents is a shared window. The windows of a suffix overlap in its 25-gram, so what they cover is one
interval; a document's intervals are merged.

Skew: suffixes are counted in hash buckets first. A bucket with much more than its share, as under a passage in a
third of all documents, is dealt over several tasks; what such a task cannot settle alone (each window's first
document) is one row per window and task, settled by one more aggregation. Nothing is capped.

Two windows count as equal when a 64-bit hash of 25 of their words and a 32-bit hash of all 50 agree.

Defined cases. Null text: no words. A text below ``min_words`` words has no passages. Rows with one doc_id are one
document; a null doc_id is told by its text. Passages repeated inside one document only are left alone. Empty
table: empty result. Extra columns pass through ``cut`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetrace.llm.common import OWN, named, parallelism, text_of
from pulsetrace.session import materialise


@dataclass(frozen=True)
class Passages:
    """``min_words``: least length of a passage; ``gram``: words of a suffix that are sorted by."""

    min_words: int = 50
    gram: int = 25
    #: Buckets per task in which suffixes are counted, and the multiple of a bucket's share at which it is split.
    buckets: int = 64
    heavy: int = 16


BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
#: Words whose hashes a process keeps; beyond, it starts anew.
CACHE = 500_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        one = np.ones(1, np.uint64)
        _powers[:] = [np.cumprod(np.concatenate([one, np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                      for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """The same hashes with their bits spread."""
    out = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def runs_of(hashes: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Mixed polynomial hashes of all runs of so many words."""
    up, down = powers(len(hashes))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up, dtype=np.uint64)])
    out = []
    for n in lengths:
        out.append(mixed((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1]))
    return out


def suffixes_of(words: list[bytes], settings: Passages) -> Iterator[tuple[int, int, int, bytes]]:
    """(25-gram hash, its place, first window that chose it, check values of those windows) of one text."""
    width, gram = settings.min_words, settings.gram
    if len(words) < width:
        return
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    grams, windows = runs_of(hashes, gram, width)
    chosen = sliding_window_view(grams, width - gram + 1).argmin(axis=1) + np.arange(len(windows))
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    checks = (windows >> np.uint64(32)).astype("<u4")
    ends = np.append(first[1:], len(windows))
    at = chosen[first]
    for g, a, s, e in zip(grams[at].view(np.int64).tolist(), at.tolist(), first.tolist(), ends.tolist()):
        yield g, a, s, checks[s:e].tobytes()


def identity() -> tuple[Column, Column]:
    """A document's id (negative, from its text, where it has none) and the hash of its text."""
    mark = F.xxhash64(text_of())
    return F.coalesce(named("doc_id").cast("long"), -F.shiftrightunsigned(mark, 1) - 1), mark


def suffixes(docs: DataFrame, settings: Passages) -> DataFrame:
    """Rows (doc, mark, gram, at, first, checks); one with ``at`` -1 and the word count in ``gram`` per text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for doc, mark, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    words = text.encode("utf-8", "surrogatepass").split()
                    rows.append((doc, mark, len(words), -1, -1, b""))
                    rows += [(doc, mark, *s) for s in suffixes_of(words, settings)]
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=["doc", "mark", "gram", "at", "first", "checks"])

    doc, mark = identity()
    return docs.select(doc.alias("doc"), mark.alias("mark"), text_of().alias("text")).mapInArrow(
        run, "doc long, mark long, gram long, at int, first int, checks binary")


OUT = pa.schema([("settled", pa.bool_()), ("doc", pa.int64()), ("mark", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()),
                 ("cut_lo", pa.int32()), ("cut_hi", pa.int32()), ("gram", pa.int64()), ("shift", pa.int32()),
                 ("check", pa.int64()), ("last_doc", pa.int64())])


def compare(batch: pa.RecordBatch, width: int) -> pa.RecordBatch | None:
    """Shared windows among suffixes sorted by gram; whole runs of equal grams.

    Settled rows give a suffix' shared interval [lo, hi) and the part of it that an earlier document has, too.
    Of a split run, the windows of the first document here come out unsettled, with the last document here.
    """
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    gram, split = get("gram").to_numpy(), get("parts").to_numpy() > 1
    fresh = np.concatenate([[True], gram[1:] != gram[:-1]])
    run = np.cumsum(fresh) - 1
    used = (np.bincount(run)[run] > 1) | split
    if not used.any():
        return None
    run, split, gram = run[used], split[used], gram[used]
    doc, mark, at, first = (get(c).to_numpy()[used] for c in ("doc", "mark", "at", "first"))
    checks = get("checks").filter(pa.array(used))
    sizes = np.array([len(c) // 4 for c in checks.to_pylist()])
    check = np.frombuffer(b"".join(checks.to_pylist()), "<u4").astype(np.uint64)
    item = np.repeat(np.arange(len(doc)), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(check)) - begin[item] + first[item]
    shift = at[item] - place
    key = ((run[item] * width + shift).astype(np.uint64) << np.uint64(32)) | check
    order = np.lexsort((doc[item], key))
    sorted_key, sorted_doc = key[order], doc[item][order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.cumsum(head) - 1
    starts = np.flatnonzero(head)
    low, high = sorted_doc[starts], sorted_doc[np.append(starts[1:], len(sorted_key)) - 1]
    shared, later, low_of, high_of = (np.empty(len(key), kind) for kind in (bool, bool, np.int64, np.int64))
    low_of[order], high_of[order] = low[group], high[group]
    shared[:] = low_of != high_of
    later[:] = doc[item] != low_of

    def interval(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = np.minimum.reduceat(np.where(hit, place, 1 << 30), begin)
        hi = np.maximum.reduceat(np.where(hit, place + width, -1), begin)
        return lo, hi

    (lo, hi), (cut_lo, cut_hi) = interval(shared), interval(later)
    known = hi > 0
    # Places of one window in one text share its fate: those that touch are one row.
    open_ = np.flatnonzero(split[item] & ~later)
    open_ = open_[np.lexsort((place[open_], mark[item[open_]], key[open_]))]
    apart = np.ones(len(open_), bool)
    apart[1:] = (key[open_[1:]] != key[open_[:-1]]) | (mark[item[open_[1:]]] != mark[item[open_[:-1]]]) | (
        place[open_[1:]] - place[open_[:-1]] > width)
    last = place[open_[np.append(np.flatnonzero(apart)[1:], len(open_)) - 1]] + width if len(open_) else place[:0]
    open_ = open_[apart]
    n, m = int(known.sum()), len(open_)
    both = lambda a, b: np.concatenate([a, b])
    none = np.zeros(n, np.int64)
    columns = [
        both(np.ones(n, bool), np.zeros(m, bool)), both(doc[known], doc[item[open_]]), both(mark[known], mark[item[open_]]),
        both(lo[known], place[open_]), both(hi[known], last), both(cut_lo[known], np.zeros(m, np.int64)),
        both(cut_hi[known], np.full(m, -1)), both(none, gram[item[open_]]), both(none, shift[open_]),
        both(none, check[open_].astype(np.int64)), both(none, high_of[open_])]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, OUT)], schema=OUT)


def shared(docs: DataFrame, settings: Passages = Passages()) -> tuple[DataFrame, DataFrame]:
    """Texts (doc, mark, n_words) and intervals (doc, mark, lo, hi, cut_lo, cut_hi); an empty interval ends at -1."""
    width = settings.min_words
    table = materialise(suffixes(docs, settings))
    texts = table.where("at < 0").select("doc", "mark", F.col("gram").alias("n_words")).distinct()
    real = table.where("at >= 0")
    tasks = parallelism(docs)
    bucket = F.pmod(F.col("gram"), F.lit(tasks * settings.buckets))
    counts = materialise(real.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")))
    share = (counts.agg(F.sum("n").alias("n")).first().n or 0) / (tasks * settings.buckets)
    piece = max(64, int(settings.heavy * share))
    # At most tasks * buckets / heavy rows, whatever the corpus.
    heavy = F.broadcast(counts.where(F.col("n") > piece).select("bucket", F.ceil(F.col("n") / piece).alias("parts")))
    dealt = real.withColumn("bucket", bucket).join(heavy, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    turn = F.pmod(F.xxhash64("doc"), F.col("parts"))
    sorted_ = dealt.drop("bucket").repartition(tasks, "gram", turn).sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            grams = whole.column("gram").to_numpy()
            ready = int(np.searchsorted(grams, grams[-1])) if len(grams) else 0  # the last run may go on
            rest = whole.slice(ready)
            for part in whole.slice(0, ready).combine_chunks().to_batches():
                if (out := compare(part, width)) is not None:
                    yield out
        if rest is not None:
            for part in rest.combine_chunks().to_batches():
                if (out := compare(part, width)) is not None:
                    yield out

    found = materialise(sorted_.mapInArrow(run, ", ".join(
        f"{f.name} {'boolean' if f.type == pa.bool_() else 'int' if f.type == pa.int32() else 'long'}" for f in OUT)))
    keys = ["gram", "shift", "check"]
    window = found.where("NOT settled")
    whole = window.groupBy(*keys).agg(F.min("doc").alias("low"), F.max("last_doc").alias("high")).where("low < high")
    later = F.col("doc") > F.col("low")
    settled = window.join(whole, keys).select(
        "doc", "mark", "lo", "hi", F.when(later, F.col("lo")).otherwise(0).alias("cut_lo"),
        F.when(later, F.col("hi")).otherwise(-1).alias("cut_hi"))
    return texts, found.where("settled").select("doc", "mark", "lo", "hi", "cut_lo", "cut_hi").union(settled)


def union_of(column: str, lo: str, hi: str) -> Column:
    """Merged intervals, in order, of an array of structs; those that end at -1 are empty."""
    entries = F.array_sort(F.transform(F.filter(column, lambda x: x[hi] > 0), lambda x: F.struct(x[lo].alias("lo"), x[hi].alias("hi"))))
    none = F.expr("CAST(array() AS array<struct<lo:int,hi:int>>)")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
            last.lo.alias("lo"), F.greatest(last.hi, x.hi).alias("hi"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1).hi >= x.lo), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(entries, none, add)


def passages(docs: DataFrame, settings: Passages = Passages()) -> DataFrame:
    """doc, mark, n_words, ``shared`` (word intervals that another document has) and ``later`` (those that one
    with a smaller id has) of every different (document, text)."""
    texts, intervals = shared(docs, settings)
    gathered = intervals.distinct().groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "hi", "cut_lo", "cut_hi")).alias("found"))
    none = F.expr("CAST(array() AS array<struct<lo:int,hi:int>>)")
    return texts.join(gathered, ["doc", "mark"], "left").select(
        "doc", "mark", "n_words", F.coalesce(union_of("found", "lo", "hi"), none).alias("shared"),
        F.coalesce(union_of("found", "cut_lo", "cut_hi"), none).alias("later"))


def cut(docs: DataFrame, settings: Passages = Passages()) -> DataFrame:
    """The documents without the passages that a document with a smaller id has; their other words are kept, and
    texts that lose nothing stay as they are."""
    spans = passages(docs, settings).where(F.size("later") > 0).select(
        F.col("doc").alias(OWN + "doc"), F.col("mark").alias(OWN + "mark"), F.col("later").alias(OWN + "later"))
    doc, mark = identity()
    joined = docs.withColumn(OWN + "d", doc).withColumn(OWN + "m", mark).join(spans, F.expr(
        f"{OWN}d = {OWN}doc AND {OWN}m = {OWN}mark"), "left")
    at = docs.columns.index("text")

    def trim(text: str | None, gone: list[dict] | None) -> str | None:
        if not text or not gone:
            return text
        data = text.encode("utf-8", "surrogatepass")
        blank = np.isin(np.frombuffer(data, np.uint8), list(b" \t\n\x0b\x0c\r"))
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        starts = np.append(starts, len(data))
        parts, last = [], 0
        for span in gone:
            parts.append(data[last: starts[span["lo"]]])
            last = starts[span["hi"]]
        return b"".join([*parts, data[last:]]).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            columns[at] = pa.array([trim(t, g) for t, g in zip(columns[at].to_pylist(), batch.columns[-1].to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    rows = joined.select(*[named(c).alias(OWN + str(i)) for i, c in enumerate(docs.columns)], OWN + "later")
    return rows.mapInArrow(run, rows.drop(OWN + "later").schema).toDF(*docs.columns)
