"""Operators of the catalogue as joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def match_with_fallback(left: DataFrame, right: DataFrame, group: str, stem: str, path: str) -> DataFrame:
    """left with `matched` and `chosen`: the least path of its group with its stem, else the least path of its group."""
    own = right.groupBy(group, stem).agg(F.min(path).alias("match"))
    any_ = right.groupBy(group).agg(F.min(path).alias("fallback"))
    found = left.join(own, [group, stem], "left").join(any_, group, "left")
    return found.withColumn("matched", F.col("match").isNotNull()).withColumn("chosen", F.coalesce("match", "fallback")).drop("match", "fallback")


def with_all_roles(files: DataFrame, key: str, role: str, path: str, roles: list[str]) -> DataFrame:
    """One row a key that has every role, with the least path of each."""
    wide = files.groupBy(key).agg(*(F.min(F.when(F.col(role) == r, F.col(path))).alias(r) for r in roles))
    return wide.where(" and ".join(f"`{r}` is not null" for r in roles))


def at_least(files: DataFrame, key: str, n: int) -> DataFrame:
    """Keys of n rows or more, with their number."""
    return files.groupBy(key).agg(F.count("*").alias("n_files")).where(F.col("n_files") >= n)


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def not_done_by_count(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Every key of inputs with its counts and whether it is skipped: as many outputs as inputs, and some."""
    a, b = inputs.groupBy(key).agg(F.count("*").alias("n_in")), outputs.groupBy(key).agg(F.count("*").alias("n_out"))
    joined = a.join(b, key, "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)))
    return joined.withColumn("skipped", (F.col("n_out") >= F.col("n_in")) & (F.col("n_in") > 0))


def companions(items: DataFrame, pictures: DataFrame, group: str, item: str, picture: str) -> DataFrame:
    """Every item with every other picture of its group. Groups are folders of a few files."""
    return items.select(group, item).join(pictures.select(group, picture), group).where(F.col(item) != F.col(picture))


def global_collections(rows: DataFrame, parent: str, name: str, order: str) -> DataFrame:
    """Each collection name once, below the parent it was first met under."""
    return rows.groupBy(name).agg(F.min_by(parent, F.struct(order, parent)).alias("parent"), F.count("*").alias("members"))


def ordinals(rows: DataFrame, group: str, order: str, keep: Column) -> DataFrame:
    """Dense numbers from 1 of the rows kept, in each group's order."""
    return rows.where(keep).withColumn("ordinal", F.row_number().over(W.partitionBy(group).orderBy(order)))


def running_offset(rows: DataFrame, group: str, order: str, height: str, spacing: float) -> DataFrame:
    """Place of each row's centre when all are stacked in the order of (group, order) with gaps. Null groups are one group, the first.

    Totals of groups are added up first, so no window over rows spans more than one group; a window over the totals has a row a group.
    """
    step = F.col(height) + F.lit(spacing)
    totals = rows.groupBy(group).agg(F.sum(step).alias("total"), F.count("*").alias("size"))
    before = W.orderBy(group).rowsBetween(W.unboundedPreceding, -1)
    start = totals.select(F.col(group).alias("_group"), F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("start"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    own = W.partitionBy(group).orderBy(order)
    inside = F.coalesce(F.sum(step).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = rows.withColumn("inside", inside).withColumn("nth", F.row_number().over(own)).join(start, F.col(group).eqNullSafe(F.col("_group")), "left")
    return placed.withColumn("offset", F.col("start") + F.col("inside") + F.col(height) / 2).withColumn("seq", F.col("before") + F.col("nth")).drop("_group", "start", "inside", "before", "nth")


def without_first(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """All rows but the first n in an order that tells all rows apart. Only those n go through one task; the others are filtered where they are."""
    bound = rows.orderBy(*order).limit(n).agg(F.max(F.struct(*order)).alias("last"), F.count("*").alias("n"))
    return rows.join(F.broadcast(bound), (F.col("n") == n) & (F.struct(*order) > F.col("last"))).select(*rows.columns) if n else rows


def preferred(candidates: DataFrame, keys: list[str], rank: Column, path: str) -> DataFrame:
    """Of each key's candidates those of the least rank that occurs, and of these the least path."""
    return candidates.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), F.col(path).alias(path)))[path].alias(path))


def largest(rows: DataFrame, group: str, size: str, index: str) -> DataFrame:
    """Each group's row of greatest size, of equal ones the first."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(size), -F.col(index)))
    return rows.groupBy(group).agg(best.alias("r")).select("r.*")


def seeded_sample(rows: DataFrame, group: str, key: str, n: int | None, seed: int) -> DataFrame:
    """n rows of each group, chosen by a digest of key and seed; all of them if n is None, negative or large enough."""
    if n is None or n < 0:
        return rows
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(draw, key))).where(F.col("_n") <= n).drop("_n")


def totals(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Counts at every level of a hierarchy, and over all."""
    return rows.rollup(*levels).agg(F.count("*").alias("n"))


def statuses(rows: DataFrame, problem: Column) -> DataFrame:
    """Rows with status 'ok' or 'error' and the reason, in place of dropping those that fail."""
    return rows.withColumn("reason", problem).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("error"))


def with_greatest(rows: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """Rows with the greatest value of their group. Totals are joined back, so that no group is gathered."""
    return rows.join(rows.groupBy(group).agg(F.max(value).alias(name)), group)


def with_empty(pictures: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Every picture with its area; those without runs have the status 'skipped' and a reason."""
    area = runs.groupBy(key).agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"))
    reason = F.when(F.col("area") == 0, "no foreground")
    out = pictures.join(area, key, "left").withColumn("area", F.coalesce("area", F.lit(0).cast("long")))
    return out.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "ok").otherwise("skipped"))


def with_resize(pictures: DataFrame, others: DataFrame, key: str, size: str, other_size: str) -> DataFrame:
    """Pictures beside another of the same key, if there is one, and whether that has another size and must be resampled."""
    joined = pictures.join(others, key, "left").withColumn("found", F.col(other_size).isNotNull())
    return joined.withColumn("resized", F.coalesce(F.col(other_size) != F.col(size), F.lit(False)))
