"""Mix sources to target weights: hash-random order, prefix sums, an exact cut per source.

Every source gets its share of all words by weight, never more than `most` times its own;
what is over goes to the others by weight. A source takes whole epochs first; for what is
left its documents stand in the order of a hash of their id, and a distributed prefix sum
says where to cut. The document at the cut gives the first words that are still wanted.

The order is cut into ranges of the hash, as many per source as its rows need, so a source
with most of the rows is many groups. Only sums per range are added up across a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from revsync.llm.common import stage

SIZE_WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of a source that share a range of the hash, about; and the ranges a hash can tell apart.
RANGE_ROWS, FINEST = 2_000, 1 << 24


def n_words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sizes: DataFrame, weights: list[int], most: int) -> DataFrame:
    """`source`, `source_size` to targets: one row per source, a table of sources, not of rows.

    The cap binds a source if its share, once all sources that reach theirs sooner have been
    capped, is above it; sources reach theirs in the order of size by weight.
    """
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]),
        (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_reach = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = by_reach.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_reach.rowsBetween(0, Window.unboundedFollowing)
    everything = by_reach.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    level = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size").cast("double") * F.lit(float(most)))
        .withColumn("reach", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("weights", F.sum("weight").over(onward))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("weights"))
        .withColumn("free", F.col("reach") > F.col("level"))
        .withColumn("first_free", F.max(F.when(F.col("free"), F.col("level"))).over(everything))
    )
    share = F.when(F.col("free"), F.col("first_free") * F.col("weight")).otherwise(F.col("cap"))
    return level.select("source", "source_size", F.least("cap", share).alias("target"))


def mix(
    docs: DataFrame,
    weights: list[int],
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """Per row of `docs`: its id, size, source_size, target (its source's) and taken.

    Sources in the order of their code points, null last as a source of its own, have the
    weights in turn. `taken` sums to the target rounded to a whole word in every source that
    has words. A null or empty text has size 0 and gives 0. Rows with the same id stand next
    to each other by size, so repeated rows give the same result in any order; a null id is
    an id like others. An empty table gives no rows; other columns are left out.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string"))).alias("key"),
    )
    rows = stage(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows")
    )
    sizes = stage(sizes, "mix-sources")
    goal = targets(sizes.select("source", "source_size"), weights, most).join(
        sizes.select(F.col("source").alias("s"), "source_rows"), F.col("source").eqNullSafe(F.col("s"))
    )
    goal = stage(goal.drop("s"), "mix-targets")

    # The source's small row joins its documents; a source with most of the rows is split.
    parts = F.least(F.ceil(F.col("source_rows") / RANGE_ROWS), F.lit(FINEST))
    place = F.conv(F.substring("key", 1, 6), 16, 10).cast("long")
    ranged = (
        rows.withColumnRenamed("source", "s")
        .join(goal, F.col("s").eqNullSafe(F.col("source")))
        .withColumn("range", F.floor(place * parts / F.lit(FINEST)))
        .drop("s", "source_rows")
    )
    per_range = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        per_range.select(
            F.col("source").alias("s"), F.col("range").alias("r"),
            F.coalesce(F.sum("range_size").over(up_to), F.lit(0)).alias("start"),
        ),
        "mix-ranges",
    )
    within = (
        Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = ranged.withColumn(
        "inside", F.coalesce(F.sum("size").over(within), F.lit(0))
    ).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size")
    part = F.greatest(
        F.lit(0), F.least(F.col("size"), left - F.col("start") - F.col("inside"))
    )
    return placed.select(
        F.col("doc_id").alias(doc_id), "size", "source_size", "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
    )
