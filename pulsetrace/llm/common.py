"""What several operators share: word rules, safe column names, scratch tables, connected groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetrace.session import materialise

#: The six white-space characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
#: Prefix of helper columns, so that an extra column of the input never clashes with one.
OWN = "__llm_"


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under plain names, as batch functions do not take every name; ``toDF`` restores them."""
    return df.select(*[named(c).alias(OWN + str(i)) for i, c in enumerate(df.columns)])


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of characters other than BLANKS, in order."""
    spaced = F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def connected(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each node of an undirected graph: columns ``node``, ``root``.

    ``edges`` has long columns ``a`` and ``b``. Rounds of large-star and small-star steps: a node's
    neighbours are re-hung on the smallest of them, first the larger ones, then the smaller ones, until no
    edge changes; then every node hangs on its root. Minima are combined before each shuffle, no neighbour
    list is ever gathered, and each round is a table in the shared folder.
    """
    small, large = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = materialise(edges.where("a <> b").select(small, large).distinct())
    print_of = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")
    mark = now.agg(F.count("*").alias("n"), print_of).first()
    while mark.n:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        starred = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = starred.groupBy("b").agg(F.min("a").alias("m"))
        hung = starred.join(down, "b").select(F.col("m"), F.col("a"), F.col("b"))
        after = materialise(
            hung.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .union(hung.select(F.col("m").alias("a"), "b")).where("a <> b")
            .select(small, large).distinct())
        new = after.agg(F.count("*").alias("n"), print_of).first()
        now = after
        if new == mark:
            break
        mark = new
    roots = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
