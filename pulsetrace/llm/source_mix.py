"""Mixing sources to target weights by capped water-filling and seeded repetition.

Targets: the budget is shared by weight; a source whose share exceeds its epochs is clamped, what it cannot take
is shared anew among the others, until nothing exceeds. Only the clamped total and the open weight pass through
the driver, one row per round.

Sampling: a source whose target is r times its size gives every document floor(r) times, and one time more where
the document's seeded hash lies below a cut. The cut is found by narrowing 256 hash ranges at a time with sums of
words per source and range, so a source of any size needs no sort and no task of its own. Where several documents
share the last range (repeated rows hash alike), they are taken one after the other, as they are stored, up to the cut.

Only DataFrame functions are used.

Defined cases. Null text: size 0. Null source: a source of its own, last in order. Documents of size 0 never
matter to a target; they are repeated like their source. Repeated rows hash alike; those that share the place of the
cut are taken in part, so that the target is met to half a document however many they are. Empty table or no words at all: targets 0, nothing taken. Extra columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsetrace.llm.common import OWN, named, parallelism, text_of, words_of
from pulsetrace.session import materialise


@dataclass(frozen=True)
class Mix:
    """Weights go round by the source's rank; ``budget`` is a share of all words, ``epochs`` the cap."""

    weights: tuple[int, ...] = (5, 2, 1)
    budget_percent: int = 150
    epochs: int = 2
    seed: int = 42
    #: Each round narrows a hash range to 1/256; four rounds tell 2**32 documents of one source apart.
    rounds: int = 4


DIGIT = 8
#: Bits of the hash that order a source's documents.
HASH_BITS = 60


def size_of() -> Column:
    return F.size(words_of(text_of())).cast("long")


def dealt(mix: Mix) -> Column:
    """Seeded place of a document in its source, from its id and text alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), named("doc_id"), text_of()), 64 - HASH_BITS)


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by code point, null last, without bringing all sources into one task.

    Sources are range-partitioned; a rank is the place in its partition plus the rows of earlier partitions.
    """
    order = [F.col("source").isNull(), F.col("source")]
    parts = sources.repartitionByRange(parallelism(sources), *order).sortWithinPartitions(*order)
    parts = materialise(parts.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("before"))
    return parts.withColumn("part", part).join(before, "part").select(
        "source", "source_size", (place + F.col("before")).alias("rank"))


def targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, target (double) from rows of (source, source_size)."""
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), (F.col("rank") % len(mix.weights) + 1).cast("int"))
    cap = mix.epochs * F.col("source_size")
    table = materialise(ranked(sources).select("source", "source_size", weight.alias("weight"), cap.alias("cap")))
    words = table.agg(F.sum("source_size").alias("words")).first().words or 0
    budget = mix.budget_percent * words / 100
    level, clamped = None, 0
    while True:
        open_ = F.lit(True) if level is None else F.col("weight") * F.lit(level) < F.col("cap")
        sums = table.agg(F.sum(F.when(~open_, F.col("cap"))).alias("held"), F.sum(F.when(open_, F.col("weight"))).alias(
            "weight"), F.count(F.when(~open_, 1)).alias("clamped")).first()
        if not sums.weight or (level is not None and sums.clamped == clamped):
            break
        level, clamped = max(0.0, budget - (sums.held or 0)) / sums.weight, sums.clamped
    share = F.col("weight") * F.lit(0.0 if level is None else level)
    return table.select("source", "source_size", F.when(share >= F.col("cap"), F.col("cap").cast("double")).otherwise(
        share).alias("target"))


def plan(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per source: source_size, target, whole repetitions and the hash ``cut`` below which one more is given.

    Where several documents share the range of the cut, it ends at ``crowd_end``, and ``crowd_words`` of it are given.

    ``sizes`` has source, size and place. Each round sums the words of the 256 sub-ranges of the range that holds
    the cut and moves on into the one where the wanted words are reached; the last one ends at its nearer border.
    """
    table = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    ratio = F.col("target") / F.col("source_size")
    table = table.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(F.lit(0)).cast("long"))
    table = table.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    table = table.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    order = Window.partitionBy("source").orderBy("digit")
    for turn in range(1, mix.rounds + 1):
        table = materialise(table)
        shift = HASH_BITS - DIGIT * turn
        inside = sizes.join(table.select(F.col("source").alias("s"), "prefix"), F.expr(
            f"source <=> s AND shiftright(place, {shift + DIGIT}) = prefix"))
        digits = inside.groupBy("source", F.shiftright("place", shift).bitwiseAND((1 << DIGIT) - 1).alias(
            "digit")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        sums = digits.select("source", "digit", "words", "rows", F.sum("words").over(order).alias("upto"))
        gone = table.select(F.col("source").alias("s"), "wanted", "below")
        past = sums.join(gone, F.expr("source <=> s")).withColumn("upto", F.col("upto") + F.col("below"))
        hit = past.where(F.col("upto") > F.col("wanted")).groupBy("source").agg(
            F.min(F.struct("digit", "upto", "words", "rows")).alias("hit"))
        step = hit.select(F.col("source").alias("s"), "hit.*")
        base = F.shiftleft("prefix", DIGIT)
        table = table.join(step, F.expr("source <=> s"), "left")
        if turn < mix.rounds:
            digit, low = F.coalesce("digit", F.lit((1 << DIGIT) - 1)), F.coalesce(F.col("upto") - F.col("words"), "below")
            # A source without a hit (nothing left above) has its cut past all its documents.
            table = table.select("source", "source_size", "target", "whole", "wanted", (base + digit).alias("prefix"),
                                 low.alias("below"))
        else:
            nearer = F.when(F.col("upto") - F.col("wanted") <= F.col("wanted") - (F.col("upto") - F.col("words")), 1).otherwise(0)
            crowded = (F.col("wanted") > 0) & (F.col("rows") > 1)
            cut = F.shiftleft(base + F.coalesce(F.when(crowded, F.col("digit")), F.col("digit") + nearer,
                                                F.lit(1 << DIGIT)), shift)
            table = table.select(
                "source", "source_size", "target", "whole",
                F.when(F.col("wanted") > 0, cut).otherwise(F.lit(0)).cast("long").alias("cut"),
                F.when(crowded, F.shiftleft(base + F.col("digit") + 1, shift)).cast("long").alias("crowd_end"),
                (F.col("wanted") - F.col("upto") + F.col("words")).alias("crowd_words"))
    return materialise(table)


def given(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of (source, place, size, ...) with their source's plan and ``n``, how often a document is given."""
    joined = rows.join(table.withColumnRenamed("source", "s"), F.expr("source <=> s"))
    plain = F.col("whole") + F.when(F.col("place") < F.col("cut"), 1).otherwise(0)
    if table.where("crowd_end IS NOT NULL").isEmpty():
        return joined.withColumn("n", plain)
    crowd = F.expr("coalesce(place >= cut AND place < crowd_end, false)")
    # Words before a row: those of earlier partitions, one number each, and of earlier rows of its own.
    stored = materialise(joined.where(crowd).withColumn("at", F.monotonically_increasing_id())).withColumn(
        "part", F.shiftright("at", 33))
    before = (Window.unboundedPreceding, -1)
    parts = stored.groupBy("s", "part").agg(F.sum("size").alias("words")).select(
        F.col("s").alias("of"), F.col("part").alias("of_part"),
        F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("part").rowsBetween(*before)), F.lit(0)).alias("earlier"))
    own = F.coalesce(F.sum("size").over(Window.partitionBy("s", "part").orderBy("at").rowsBetween(*before)), F.lit(0))
    numbered = stored.withColumn("own", own).join(parts, F.expr("s <=> of AND part = of_part"))
    reached = F.col("earlier") + F.col("own") + F.col("size") / 2 <= F.col("crowd_words")
    taken = numbered.withColumn("n", F.col("whole") + F.when(reached, 1).otherwise(0)).select(*joined.columns, "n")
    return joined.where(~crowd).withColumn("n", plain).unionByName(taken)


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    return materialise(docs.select(named("doc_id").alias("doc_id"), named("source").alias("source"),
                                   size_of().alias("size"), dealt(mix).alias("place")))


def counts(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of every document."""
    sizes = sized(docs, mix)
    return given(sizes, plan(sizes, mix)).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


def mix(docs: DataFrame, settings: Mix = Mix()) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with its own columns."""
    columns = [F.col(OWN + str(i)).alias(c) for i, c in enumerate(docs.columns)]
    rows = docs.select(*[named(c).alias(OWN + str(i)) for i, c in enumerate(docs.columns)],
                       named("source").alias("source"), dealt(settings).alias("place"), size_of().alias("size"))
    taken = given(rows, plan(sized(docs, settings), settings)).where("n > 0")
    return taken.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias(OWN + "n")).drop(OWN + "n")
