"""Quality rules whose limits come from the corpus: one quantile sketch per language and source.

A sketch is a histogram over log-spaced whole-number bins (relative width 1/32), so merging two of them is
adding counts: partial sums meet in a shuffle, a source's sketches add up to its language's, those to the
corpus'. The result is exact in its bins and the same on every run and partitioning. Limits are read from the
sketches, joined to the documents by language and source, and decide which stay.

Only DataFrame functions are used.

Defined cases. Null text: empty text, no words, rejected by the word minimum. Null language or source: a group
of its own. Repeated rows: each is judged, and counted, on its own. Empty table: empty result. Extra columns
pass through ``keep`` untouched; ``judge`` returns only its own columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsetrace.llm.common import OWN, BLANKS, named, text_of, words_of
from pulsetrace.session import materialise

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules.

    ``reach``: a limit lies this many spreads beyond the quartile; a spread is the distance of quartile and
    median, at least the metric's entry in ``least_spread``. ``min_docs``: a group with fewer documents takes
    the sketch of its language, a smaller language that of the corpus.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    reach: int = 3
    min_docs: int = 100
    #: In 1/10,000 for shares, in 1/100 characters for the word length.
    least_spread: tuple[tuple[str, int], ...] = (
        ("symbol_share", 200), ("dup_line_share", 1500), ("repeat_share", 700), ("capital_share", 500),
        ("word_length", 150))


TWO_SIDED = {"word_length"}


def measure(docs: DataFrame, keys: list[Column]) -> DataFrame:
    """``keys`` and COUNTS of every document."""
    full = F.col("full")
    lines = F.filter(F.split(full, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    bare = F.translate(full, BLANKS, "")
    step = docs.select(*keys, text_of().alias("full"))
    step = step.select(
        "*", F.transform(words_of(full), lambda w: F.xxhash64(w)).alias("hashes"), lines.alias("lines"),
        F.char_length(bare).cast("long").alias("word_chars"),
        *[(F.char_length(bare) - F.char_length(F.translate(bare, some, ""))).cast("long").alias(name)
          for name, some in (("n_symbols", SYMBOLS), ("n_capitals", CAPITALS))],
    ).drop("full")
    step = step.select("*", F.size("hashes").cast("long").alias("n_words"),
                       F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")
                       ).drop("lines")
    spans = F.transform(
        F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get("hashes", i + k) for k in range(1, WINDOW)]))
    step = step.select("*", spans.alias("spans")).drop("hashes")
    step = step.withColumn("spans", F.when(F.size("spans") > F.size(F.array_distinct("spans")), F.col("spans")))
    step = step.withColumn("spans", F.array_sort(F.transform(
        "spans", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    at = F.transform(F.filter("spans", lambda s, k: F.coalesce(s.h == F.get("spans", k - 1).h, F.lit(False))
                              | F.coalesce(s.h == F.get("spans", k + 1).h, F.lit(False))), lambda s: s.i)
    step = step.withColumn("spans", F.array_sort(at))
    new = F.transform("spans", lambda p, k: F.least(
        F.lit(WINDOW), p - F.coalesce(F.get("spans", k - 1), p - WINDOW)))
    covered = F.aggregate(new, F.lit(0), lambda a, x: a + x)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # The generated row keeps Spark from copying these expressions into every later condition on a count.
    kept = [c for c in step.columns if c not in COUNTS and c != "spans"]
    return step.select(*kept, F.inline(F.array(F.struct(*COUNTS))))


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """Whole-number values of one document by metric; null where nothing is to be divided by."""
    def share(part, whole, scale):
        return F.expr(f"CASE WHEN {whole} > 0 THEN ({scale}L * {part}) DIV {whole} END")

    return {
        "symbol_share": share("n_symbols", "word_chars", 10000),
        "dup_line_share": share("n_dup_lines", "n_lines", 10000),
        "repeat_share": share("n_repeat_words", "n_words", 10000),
        "capital_share": share("n_capitals", "word_chars", 10000),
        "word_length": share("word_chars", "n_words", 100)}


def bin_of(value: str) -> str:
    """Lower edge of the value's bin: the six leading binary digits stay, the rest become zero."""
    drop = f"greatest(length(bin({value})) - 6, 0)"
    return f"shiftleft(shiftright({value}, {drop}), {drop})"


def sketches(counts: DataFrame) -> DataFrame:
    """Counts by (level, lang, source, metric, bin); level 0 has sources, 1 languages, 2 the whole corpus."""
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in metrics().items()])
    cells = counts.select("lang", "source", F.explode(pairs).alias("m")).where("m.value IS NOT NULL").select(
        "lang", "source", "m.metric", F.expr(bin_of("m.value")).alias("bin"))
    cells = cells.groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))
    levels = F.explode(F.array(*[F.struct(
        F.lit(level).alias("level"), (F.col("lang") if level < 2 else F.lit(None).cast("string")).alias("lang"),
        (F.col("source") if level < 1 else F.lit(None).cast("string")).alias("source")) for level in range(3)]))
    return cells.select(levels.alias("at"), "metric", "bin", "n").groupBy(
        "at.level", "at.lang", "at.source", "metric", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame) -> DataFrame:
    """Document count and quartiles of each sketch; a window spans one sketch, a few hundred bins at most."""
    group = ["level", "lang", "source", "metric"]
    up = Window.partitionBy(*group).orderBy("bin")
    whole = Window.partitionBy(*group)
    ranked = sketch.select("*", F.sum("n").over(up).alias("upto"), F.sum("n").over(whole).alias("docs"))
    return ranked.groupBy(*group).agg(F.first("docs").alias("docs"), *[
        F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("bin"))).alias(f"q{k}") for k in (1, 2, 3)])


def limits(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, source) -> ``least`` and ``most`` of each metric, as one struct per metric."""
    spread = F.create_map(*[F.lit(x) for pair in rules.least_spread for x in pair])
    marks = quantiles(sketches(counts)).withColumn("floor", spread[F.col("metric")].cast("long"))
    marks = marks.withColumn("most", F.col("q3") + rules.reach * F.greatest(F.col("q3") - F.col("q2"), "floor"))
    marks = marks.withColumn("least", F.when(
        F.col("metric").isin(*TWO_SIDED),
        F.col("q1") - rules.reach * F.greatest(F.col("q2") - F.col("q1"), "floor")).otherwise(F.lit(0)))
    marks = materialise(marks.select("level", "lang", "source", "metric", "docs", "least", "most"))
    own, lang, corpus = (marks.where(F.col("level") == k).alias(f"l{k}") for k in range(3))
    joined = own.join(lang, F.expr("l0.metric = l1.metric AND l0.lang <=> l1.lang")).join(
        corpus, F.expr("l0.metric = l2.metric"))
    few = rules.min_docs
    pick = lambda c: F.expr(
        f"CASE WHEN l0.docs >= {few} THEN l0.{c} WHEN l1.docs >= {few} THEN l1.{c} ELSE l2.{c} END")
    picked = joined.select(F.col("l0.lang").alias("lang"), F.col("l0.source").alias("source"),
                           F.col("l0.metric").alias("metric"), pick("least").alias("least"), pick("most").alias("most"))
    return picked.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("metric") == name, F.struct("least", "most"))).alias(f"{name}_limits")
        for name, _ in rules.least_spread])


def within(rules: Rules) -> Column:
    """Whether every metric lies inside the limits joined to the row."""
    ok = F.lit(True)
    values = metrics()
    for name, _ in rules.least_spread:
        value, limit = values[name], F.col(f"{name}_limits")
        ok &= F.coalesce(value.between(limit["least"], limit["most"]), F.lit(True))
    return ok


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    keys = [named(c).alias(c) for c in ("doc_id", "lang", "source")]
    counts = materialise(measure(docs, keys))
    found = counts.alias("d").join(limits(counts, rules).alias("t"), F.expr(
        "d.lang <=> t.lang AND d.source <=> t.source"), "left").drop(F.col("t.lang"), F.col("t.source"))
    failed = base_failed(rules)
    return found.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines",
                        "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & within(rules)).alias("kept"))


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns.

    Each text is measured once: rows are written with their counts, the sketches read the counts alone, and the table
    of limits, one row per language and source, is joined to the written rows.
    """
    own = [named(c).alias(OWN + str(i)) for i, c in enumerate(docs.columns)]
    counts = materialise(measure(docs, [*own, named("lang").alias("lang"), named("source").alias("source")]))
    table = materialise(limits(counts, rules))
    found = counts.alias("d").join(table.alias("t"), F.expr(
        "d.lang <=> t.lang AND d.source <=> t.source"), "left")
    return found.where(~base_failed(rules) & within(rules)).select(
        *[F.col(OWN + str(i)).alias(c) for i, c in enumerate(docs.columns)])
