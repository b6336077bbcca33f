"""Mixing sources to target weights by capped water-filling, with built-in DataFrame operations only.

Targets: sources share all words by weight; a source stops at `max_epochs` times its own words and
what it leaves is shared again by weight until nobody is above. That is the water level L at which
sum(min(cap, weight * L)) equals the total: with the sources in order of cap / weight, the first k
that are full leave (total - their caps) to the weights of the others. One sort of a table with a
row per source finds it.

Taking: a source's target is `whole` repetitions of each document and a rest of words. Documents
with the smallest seeded hashes fill the rest. To find where it ends without sorting a source in
one task, words are added up per hash bucket first, 256 at a time; only the bucket in which the rest
ends is looked into, and at last ordered. The document across the end is left out and what is missing
filled the same way by the documents that still fit, then by the largest that fits, at last by the
smallest if that comes nearer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

WORD_GAP = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_GAP)), F.lit(0)).cast("long")


def water_levels(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes (source, source_size) -> with weight, target. Sources by code point, null last, take the weights in turn."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("weight", turn.cast("double")).withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    # By cap / weight; before[k]: caps and weights of the sources that fill earlier.
    rising = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (
        s.withColumn("_total", F.sum("source_size").over(every).cast("double"))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(rising), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    )
    level = (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_used"))
    # Levels fall from the first source that doesn't fill up, which sets the level.
    s = s.withColumn("_level", F.max(F.when(level * F.col("weight") <= F.col("_cap"), level)).over(every))
    filled = F.least(F.col("_cap"), F.col("weight") * F.coalesce("_level", F.lit(float("inf"))))
    return s.withColumn("target", filled).select("source", "source_size", "weight", "target")


def _fill(pool: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """Of each source the units with the smallest hashes whose words together stay within _left.

    Level by level, hashes are cut into 2**bits buckets: those that end within _left are in, and only the
    one across the end is looked into; what remains at last is ordered by hash itself.
    """
    cols, used, parts = ["_key", "_h", "size", "_unit"], 0, []
    for bits in levels:
        used += bits
        pool = pool.select(*cols, "_left", F.shiftrightunsigned("_h", 64 - used).alias("_bucket"))
        per = pool.groupBy("_key", "_bucket").agg(F.sum("_unit").alias("_words"), F.first("_left").alias("_left"))
        run = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        per = per.withColumn("_upto", F.sum("_words").over(run)).withColumn("_room", F.col("_left") - F.col("_upto") + F.col("_words"))
        per = per.where("_room > 0").select("_key", "_bucket", (F.col("_upto") <= F.col("_left")).alias("_whole"), "_room")
        u = pool.drop("_left").join(per, ["_key", "_bucket"])
        parts.append(u.where("_whole").select(*cols))
        pool = u.where("NOT _whole").select(*cols, F.col("_room").alias("_left"))
    within = Window.partitionBy("_key").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts.append(pool.withColumn("_sum", F.sum("_unit").over(within)).where("_sum <= _left").select(*cols))
    return reduce(DataFrame.unionByName, parts)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17, levels: tuple[int, ...] = (8, 8), fills: int = 2) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (words, repetitions
    counted), repetitions.

    Null source is a source of its own; null or wordless texts have size 0 and take 0. Ties of the
    seeded hash are broken by doc_id; repeated rows of one doc_id and size are taken alike, so that
    `taken` is a function of the row. An empty table gives an empty result. Other columns, whatever
    their names, are not read. No document is taken more than max_epochs times.
    """
    key = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))
    d = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            key.alias("_key"),
            n_words(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"),
        ),
        "mix-sizes",
    )
    # Rows with one hash and size (repeated rows) are one unit, taken together.
    units = d.groupBy("_key", "_h", "size").agg(F.first("source").alias("source"), F.count("*").alias("_n")).withColumn("_unit", F.col("size") * F.col("_n"))
    sizes = units.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_unit").cast("long").alias("source_size"))
    plan = water_levels(sizes, max_epochs, weights).withColumn("_key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    ratio = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(ratio + 1e-12), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))))
    plan = written(plan, "mix-plan")

    unit = ["_key", "_h", "size"]
    pool = units.select(*unit, "_unit").where("_unit > 0")
    left = plan.select("_key", F.col("rest").alias("_left"))
    parts = []
    for turn in range(fills + 3):
        if parts:
            pool = pool.join(parts[-1].select(*unit), unit, "left_anti")
        open_ = pool.join(left, "_key")
        if turn < fills:
            part = _fill(open_.where("_unit <= _left"), levels)
        else:  # the largest that fits, and at last the smallest if that comes nearer
            last = turn == fills + 2
            order = F.struct((-F.col("_unit") if last else F.col("_unit")).alias("rank"), "_h", "size", "_unit")
            best = open_.where("_unit < 2 * _left" if last else "_unit <= _left").groupBy("_key").agg(F.max(order).alias("b"))
            part = best.select("_key", "b._h", "b.size", "b._unit")
        parts.append(written(part, "mix-part"))
        got = parts[-1].groupBy("_key").agg(F.sum("_unit").alias("_got"))
        left = written(left.join(got, "_key", "left").select("_key", (F.col("_left") - F.coalesce("_got", F.lit(0))).alias("_left")), "mix-left")
    chosen = reduce(DataFrame.unionByName, parts).select(*unit, F.lit(1).alias("_extra"))

    taken = d.join(chosen, ["_key", "_h", "size"], "left")
    p = plan.select("_key", "source_size", "target", "whole")
    reps = F.least(F.col("whole") + F.coalesce("_extra", F.lit(0)), F.lit(max_epochs))
    return taken.join(p, "_key").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * reps).alias("taken"), reps.alias("repetitions"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of docs, all their columns, each as often as mix() takes it."""
    reps = mix(docs, id_col, text_col, source_col, **options).where("repetitions > 0").select(F.col("doc_id").alias("_i"), F.col("size").alias("_z"), F.col("source").alias("_s"), "repetitions").distinct()
    d = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), n_words(F.col(text_col)).alias("_size"), F.col(source_col).alias("_source"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_size") == F.col("_z")) & F.col("_source").eqNullSafe(F.col("_s"))
    return d.join(reps, same).select("_row", F.explode(F.sequence(F.lit(1), "repetitions"))).select("_row.*")


def op9_water_filling(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
