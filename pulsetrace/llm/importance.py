"""Resampling towards a target distribution by hashed word features (importance weights with Gumbel noise).

Words come from an untrained pre-tokeniser: a Regex ``Split`` over the text in which A-Z became small letters returns
each word with its offsets. Windows of 1 to ``longest`` neighbouring offset pairs are the features; a feature's UTF-8
bytes, words joined by one space, are hashed by CRC-32 into ``buckets`` histogram cells.

Each text is split once: its cells (two or four bytes a feature) are written as a table. Their histogram is summed
per task before one small aggregation; it and the gains are ``buckets`` numbers, whatever the corpus. A second pass
over the cells sums gains. The draw sorts the slim rows of all eligible documents by range partitions; a document's
rank is its place in its partition plus the sizes of those before.

Defined cases. Null or blank text: no words, weight 0. Null doc_id: hashed as the empty string, last among ties.
Repeated rows are drawn one by one; equal scores and ids take ranks in any order of equal rows. Empty table: empty
result; empty target: gains from the raw side alone. Texts of any length are taken whole, in slices that end outside
words, so memory follows the slice. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from pulsetrace.llm.common import named, parallelism, text_of
from pulsetrace.session import materialise


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10000
    #: Words of the longest feature.
    longest: int = 1
    min_words: int = 20
    #: Documents drawn, in percent of those with ``min_words`` words.
    percent: int = 10
    seed: str = "2024"


#: What stands between words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Code points handed to the splitter at once, up to the end of a word.
SLICE = 1 << 16
#: Words whose cells a process remembers; beyond, it starts anew.
CACHE = 500_000

_gap = re.compile(GAPS)


def slices(text: str) -> Iterator[str]:
    """The text in order, cut only at gaps."""
    at = 0
    while len(text) - at > SLICE:
        gap = _gap.search(text, at + SLICE)
        if not gap:
            break
        yield text[at: gap.start()]
        at = gap.end()
    yield text[at:] if at else text


class Cells(dict):
    """Histogram cell of a feature."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        cell = self[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % self.buckets
        return cell


class Splitter:
    """Words of lowered texts with their offsets."""

    def __init__(self) -> None:
        self.split = pre_tokenizers.Split(Regex(GAPS), "removed")

    def words(self, text: str) -> Iterator[tuple[str, tuple[int, int]]]:
        for part in slices(text.translate(LOWER)):
            yield from self.split.pre_tokenize_str(part)


def features(pairs: list[tuple[str, tuple[int, int]]], longest: int) -> Iterator[str]:
    """All runs of 1 to ``longest`` neighbouring pairs, words joined by one space."""
    for n in range(1, longest + 1):
        for i in range(len(pairs) - n + 1):
            yield " ".join(word for word, _ in pairs[i: i + n])


def cells_of(docs: DataFrame, settings: Resampling, id_column: str) -> DataFrame:
    """doc_id, number of words and features, and the features' cells as little-endian numbers."""
    kind = "<u2" if settings.buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, cell = Splitter(), Cells(settings.buckets)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                words, counts, packed = [], [], []
                for text in part.column(1).to_pylist():
                    if settings.longest == 1:
                        found = np.fromiter((cell[w] for w, _ in splitter.words(text)), kind)
                        words.append(len(found))
                    else:
                        pairs = list(splitter.words(text))
                        words.append(len(pairs))
                        found = np.fromiter((cell[f] for f in features(pairs, settings.longest)), kind)
                    counts.append(len(found))
                    packed.append(found.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_words", "n_features", "cells"])

    slim = docs.select(named(id_column).cast("long").alias("doc_id"), text_of().alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, cells binary")


def histogram(cells: DataFrame, settings: Resampling) -> np.ndarray:
    """Features per cell; each task sends one row per cell it has seen."""
    kind = "<u2" if settings.buckets <= 1 << 16 else "<u4"
    buckets = settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(one, kind), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["cell", "n"])

    rows = cells.select("cells").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in rows.collect():  # at most ``buckets`` rows
        out[row.cell] = row.n
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of the smoothed frequencies."""
    size = len(raw)
    up = (target + 1).astype(np.float64) * float(raw.sum() + size)
    down = (raw + 1).astype(np.float64) * float(target.sum() + size)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighed(cells: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and the floored mean gain of every document."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(one, kind)].sum()) for one in batch.column(3).to_pylist()]
            weights = [total // n if n else 0 for total, n in zip(sums, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return cells.select("doc_id", "n_words", "n_features", "cells").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Floored thousandths of Gumbel noise that depends on seed and id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``: 1 for the highest score, ties to the smaller doc_id."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    spread = [*order, F.xxhash64("n_features", "weight", F.col("pick"))]
    parts = max(parallelism(rows), 1)
    sorted_rows = rows.withColumn("pick", F.monotonically_increasing_id()).repartitionByRange(parts, *spread).sortWithinPartitions(*spread)
    stored = materialise(sorted_rows.select(
        "doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    before, upto = [], 0
    for row in sizes:
        before.append((row.part, upto))
        upto += row.n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, before long"))  # one row a partition
    return stored.withColumn("part", part).join(offsets, "part").select(
        "doc_id", "n_features", "weight", "score",
        (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, settings: Resampling = Resampling(), id_column: str = "doc_id",
             target_id: str = "item_id") -> DataFrame:
    """doc_id, n_features, weight, score of every document, and its rank where it is drawn."""
    cells = materialise(cells_of(docs, settings, id_column))
    gain = gains(histogram(cells_of(target, settings, target_id), settings), histogram(cells, settings))
    scored = materialise(weighed(cells, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), settings.seed)))
    eligible = scored.where(F.col("n_words") >= settings.min_words)
    drawn = settings.percent * eligible.count() // 100
    ranks = placed(eligible.select("doc_id", "n_features", "weight", "score"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranks.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).union(
        scored.where(F.col("n_words") < settings.min_words).select(*columns, F.lit(None).cast("long").alias("rank")))
