"""Near-duplicates by SimHash with a hierarchical index in Gray order.

Fingerprints: 64 majority votes over the hashes of a text's word shingles, computed in Arrow batches.

Index: the distinct fingerprints are sorted by Gray rank (range partitions, sorted inside), which puts codes with
few differing bits next to each other. Sixteen neighbours make a node, sixteen nodes the node above, up to one
root. A node holds the bits that all its codes have set and the bits that any of them has set: together the
masked pattern its codes share. Two nodes differ at least in the bits that one side has everywhere and the other
nowhere; a pair of nodes beyond the distance is dropped with everything below it. The search starts with the
root against itself and goes down one level per step as equi-joins of node pairs with their children, so no
task, executor or driver ever holds the index, and nodes are equally full whatever the fingerprints look like.

Exact copies share a fingerprint and enter the index once; links are between different fingerprints, and a code
has at most 2,080 others within two bits. Components come from ``common.connected``.

Defined cases. Null or blank text: fingerprint zero, linked like any other. Fewer words than a shingle: the whole
sequence is the one shingle. Null doc_id: takes part, never names a component unless it has no other id (then
component_id is null). Repeated rows: same fingerprint, same component. Empty table: empty result. Extra columns
pass through ``keep_one`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetrace.llm.common import OWN, connected, named, parallelism, text_of
from pulsetrace.session import materialise

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: log2 of the children of a node.
STRIDE = 4
#: Shingle hashes whose bits are counted at once; bounds the memory of a very long text.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo: lo + BLOCK], ends[lo: lo + BLOCK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, row key (hash of the text) and signed 64-bit fingerprint of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(t, width) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.view(np.int64))],
                                             names=["doc_id", "row_key", "code"])

    slim = docs.select(named("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("row_key"), text_of().alias("text"))
    return slim.mapInArrow(run, "doc_id long, row_key long, code long")


def gray_rank(code: Column) -> Column:
    """Place of a code in reflected Gray order, shifted so that signed order is unsigned order."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def apart(a: str, b: str) -> Column:
    """Least number of bits by which codes below two nodes differ."""
    return F.expr(f"bit_count(({a}_all & ~{b}_any) | ({b}_all & ~{a}_any))")


def levels(top: int, seq: int) -> list[int]:
    """Shifts of a code's place that name its node on each level, leaves first, one root last.

    A place is partition * 2**33 + number inside it.
    """
    shifts = [s for s in range(0, 33, STRIDE) if s == 0 or seq >> s > 0] + [33]
    while top >> (shifts[-1] - 33) > 0:
        shifts.append(shifts[-1] + STRIDE)
    return shifts


def index(codes: DataFrame) -> tuple[DataFrame, list[int]]:
    """Nodes of all levels (level, id, all, any) over rows of (at, code), and the levels' shifts."""
    ends = codes.agg(F.max(F.shiftright("at", 33)).alias("top"),
                     F.max(F.col("at").bitwiseAND((1 << 33) - 1)).alias("seq")).first()
    shifts = levels(ends.top or 0, ends.seq or 0)
    rows = codes.select(F.lit(0).alias("level"), F.col("at").alias("id"), F.col("code").alias("all"), F.col("code").alias("any"))
    for level, shift in enumerate(shifts[1:], 1):
        rows = rows.union(codes.groupBy(F.shiftright("at", shift).alias("id")).agg(
            F.bit_and("code").alias("all"), F.bit_or("code").alias("any")).select(F.lit(level).alias("level"), "id", "all", "any"))
    return materialise(rows.repartition(parallelism(codes))), shifts


def links(codes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs a < b of places whose codes differ in at most ``max_bits`` bits."""
    nodes, shifts = index(codes)
    pairs = nodes.where(F.col("level") == len(shifts) - 1).select(
        F.col("id").alias("a"), F.col("id").alias("b"), F.col("all").alias("b_all"), F.col("any").alias("b_any"))
    for level in reversed(range(len(shifts) - 1)):
        below = nodes.where(F.col("level") == level)
        parent = F.shiftright("id", shifts[level + 1] - shifts[level])
        left, right = (below.select(parent.alias(f"{x}_up"), F.col("id").alias(f"{x}_id"), F.col("all").alias(f"{x}_all"),
                                    F.col("any").alias(f"{x}_any")) for x in ("l", "r"))
        half = pairs.join(left, F.expr("a = l_up") & (apart("l", "b") <= max_bits)).select("l_id", "l_all", "l_any", "b")
        order = F.expr("l_id < r_id" if level == 0 else "l_id <= r_id")
        pairs = half.join(right, F.expr("b = r_up") & (apart("l", "r") <= max_bits) & order).select(
            F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.col("r_all").alias("b_all"), F.col("r_any").alias("b_any"))
        if level:  # a few upper pairs fan out: spread them before the next level
            pairs = pairs.repartition(parallelism(codes))
    return pairs.select("a", "b")


def components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """code -> component_id (smallest doc_id reachable) for rows of (doc_id, code)."""
    key = gray_rank(F.col("code"))
    distinct = prints.groupBy("code").agg(F.min("doc_id").alias("first_id"))
    codes = distinct.repartitionByRange(parallelism(prints), key).sortWithinPartitions(key)
    codes = materialise(codes.select(F.monotonically_increasing_id().alias("at"), "code", "first_id"))
    found = materialise(links(codes, max_bits))
    roots = connected(found)
    rooted = codes.join(roots, F.expr("at = node"), "left").select("code", "first_id", F.coalesce("root", "at").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("code", "component_id")


def hex16(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def classes(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = materialise(fingerprints(docs, width))
    return prints.join(components(prints, max_bits), "code").select(
        "doc_id", hex16(F.col("code")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with all its columns: the one whose id names it.

    A document is told by its id and the hash of its text. Where several rows carry both, one of them stays; a
    component without any id keeps the row with the smallest text hash.
    """
    prints = materialise(fingerprints(docs, width))
    grouped = prints.join(components(prints, max_bits), "code")
    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    # Without any id the smallest code stands for the component's id, as both are one per component.
    best = grouped.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("code")).alias("code")).agg(
        F.min(who).alias("who"))
    rows = grouped.groupBy("doc_id", "row_key").agg(F.count("*").alias("copies"))
    winners = materialise(best.select("who.doc_id", "who.row_key").join(rows.select(
        F.col("doc_id").alias("d"), F.col("row_key").alias("r"), "copies"), F.expr("doc_id <=> d AND row_key = r")).select(
            F.col("doc_id").alias(OWN + "d"), F.col("row_key").alias(OWN + "r"), "copies"))
    keyed = docs.withColumn(OWN + "key", F.xxhash64(text_of()))
    same = named("doc_id").cast("long").eqNullSafe(F.col(OWN + "d")) & (F.col(OWN + "key") == F.col(OWN + "r"))

    def stays(which: Column) -> DataFrame:
        return keyed.join(winners.where(which).select(OWN + "d", OWN + "r"), same)

    kept = stays(F.col("copies") == 1)
    several = F.col("copies") > 1
    if not winners.where(several).isEmpty():
        kept = kept.union(stays(several).dropDuplicates([OWN + "d", OWN + "r"]))
    return kept.select(*[named(c) for c in docs.columns])
