"""Mixing sources to target weights by systematic sampling (operator 8), in DataFrame functions alone.

Targets: sources share all words by their weights; a target stops at ``most`` times its source's words and the
excess goes to the others by weight. That is one level L with sum(min(most * s, L * w)) = all words: sources in
ascending order of most * s / w are capped up to the first that L, made of the rest, does not reach.

Copies: a source's documents stand in the order (words, hash of the id); each is expected r = target / words of
the source times, and the prefix sum of these expectations, shifted by the source's one random offset in [0, 1)
(drawn from the seed), gives a document a copy for every integer that it crosses. In this order neighbours are alike
in length, so that what the source gives stays within about its longest document of the target.

The order is one of ranges: tasks hold ranges of (source, words, hash), so a hot source is many tasks, and a
row's rank is its place in its task plus the counts of the tasks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Rows of the table of places that are sent to all tasks; a longer one is joined by an exchange.
SENT = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes``: (source, source_size), one row each. Adds weight and target.

    ``weights`` repeat over the sources in code-point order, null last. A source without words has target 0.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    cap = (most * F.col("source_size")).cast("double")
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", cap)
    total = W.partitionBy()
    rows = rows.withColumn("all", F.sum("source_size").over(total).cast("double"))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)))
    # the level if all before this source are capped and it and those after it are not; of the levels that
    # do not reach their own source's cap the first is right, and those after it are no higher
    rows = rows.withColumn("level", (F.col("all") - F.col("capped")) / F.col("rest"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(total)
    return rows.withColumn("found", level).select("source", "source_size", "weight", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("weight"))).alias("target"))


def drawn(seed: str, source: Column) -> Column:
    """The offset of a source: the first 32 bits of md5("<seed>:offset:<source>"), as a share of all."""
    bits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("offset"), F.coalesce(source, F.lit("null")))), 1, 8)
    return F.conv(bits, 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", text: str = "text", doc_id: str = "doc_id", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, and ``carry``) for every row of ``docs``.

    Null texts have size 0, null sources are one source, null ids count as text "null"; rows equal in all of
    these are interchangeable; an empty table gives no rows; ``carry`` must not repeat the other names. Reruns agree:
    order and offset depend on data and parameters alone. Rows go through one exchange; what joins them afterwards has a
    row for each source and each task that holds some of it, at most tasks + sources, and is sent to all tasks while
    that is ``SENT`` or less.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"), key.alias("key"), *(F.col(f"`{c}`") for c in carry or []))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), "size", "key"]
    # written once, so that every later pass sees the same places
    placed = saved(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "mix")
    task, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    held = placed.groupBy("source", task.alias("task")).agg(F.count("*").alias("n"), F.min(place).alias("low"), F.sum("size").alias("words"))
    held = saved(held, "mix")
    goal = targets(held.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = held.withColumn("before", before - F.col("low")).select(F.col("source").alias("_s"), F.col("task").alias("_t"), "before")
    places = saved(places.join(goal.withColumnRenamed("source", "_g"), F.col("_s").eqNullSafe(F.col("_g"))).drop("_g"), "mix")
    places = F.broadcast(places) if places.count() <= SENT else places
    found = placed.join(places, F.col("source").eqNullSafe(F.col("_s")) & (task == F.col("_t")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank, u = (F.col("before") + place).cast("double"), drawn(seed, F.col("source"))
    # one product for each boundary: what ends a document begins the next, so no copy is lost or made twice
    emitted = (F.floor(u + (rank + 1) * rate) - F.floor(u + rank * rate)).cast("long")
    return found.select("doc_id", "source", "size", "source_size", "target", emitted.alias("copies"), *(carry or []))


def mix(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs``, each as often as the sample takes it; columns unchanged, whatever their names. As ``copies`` for
    nulls, repeated rows and empty tables."""
    names, how = docs.columns, dict(how)
    kept = {c: f"_c{i}" for i, c in enumerate(names)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in kept.items()))
    at = {k: kept[how.pop(k, k)] for k in ("text", "doc_id", "source")}
    out = copies(renamed, carry=list(kept.values()), **at, **how).where("copies > 0")
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*(F.col(k).alias(c) for c, k in kept.items()))
