"""Paired experiments: pivots, fail-closed joins, donors, condition joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pivot_pairs(rows: DataFrame, pair: str, label: str, values: list[str], column: str) -> DataFrame:
    """One row per pair with a column for each label; ``complete`` if each label occurs exactly once."""
    aggs = [F.min(F.when(F.col(label) == v, F.col(column))).alias(v) for v in values]
    counts = [F.count_if(F.col(label) == v) == 1 for v in values]
    ok = counts[0]
    for c in counts[1:]:
        ok = ok & c
    return rows.groupBy(pair).agg(*aggs, (ok & (F.count(F.lit(1)) == len(values))).alias("complete"))


def join_issues(left: DataFrame, right: DataFrame, key: str, fields: list[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Rows (id, code, field): orphans of either side, repeated ids and fields that differ (nulls are equal)."""
    dup = [t.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).cast("string").alias("id"), F.lit(f"duplicate_{n}").alias("code"), F.lit(None).cast("string").alias("field")) for t, n in zip((left, right), names, strict=True)]
    l = left.select(F.col(key), F.lit(True).alias("_l"), *[F.col(f).alias(f"_l_{f}") for f in fields])
    r = right.select(F.col(key), F.lit(True).alias("_r"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    j = l.join(r, key, "full_outer")
    issue = lambda cond, code, field: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field")))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    found = F.array_compact(F.array(issue(F.col("_r").isNull(), f"{names[0]}_orphan", None), issue(F.col("_l").isNull(), f"{names[1]}_orphan", None), *[issue(both & ~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")), "field_conflict", f) for f in fields]))
    diff = j.select(F.col(key).cast("string").alias("id"), F.explode(found).alias("i")).select("id", "i.code", "i.field")
    return diff.unionByName(dup[0]).unionByName(dup[1])


def circular_donors(rows: DataFrame, item: str, owner: str, stratum: str) -> DataFrame:
    """For each item the next one in circular id order of its stratum whose owner differs.

    Items of a stratum form runs of one owner; every item of a run takes the first item of the next run, and
    the last run goes back to the first item, or to the first of another owner if that run shares its owner.
    Items of a stratum with one owner only take the next item of any stratum whose owner differs; null if there is none.
    """
    w = Window.partitionBy(stratum).orderBy(item)
    new = F.coalesce(F.lag(owner).over(w) != F.col(owner), F.lit(True))
    runs = rows.withColumn("_run", F.sum(new.cast("int")).over(w))
    heads = runs.groupBy(stratum, "_run").agg(F.min(item).alias("_head"), F.first(owner).alias("_owner"))
    by_run = Window.partitionBy(stratum).orderBy("_run")
    whole = by_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_head, first_owner = F.first("_head").over(whole), F.first("_owner").over(whole)
    second_head = F.nth_value("_head", 2).over(whole)
    back = F.when(first_owner != F.col("_owner"), first_head).when(F.count(F.lit(1)).over(whole) > 2, second_head)
    ahead = heads.withColumn("donor", F.coalesce(F.lead("_head").over(by_run), back))
    out = runs.join(ahead.select(stratum, "_run", "donor"), [stratum, "_run"]).select(item, owner, stratum, "donor")
    lone = rows.groupBy(stratum).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi")).filter("_lo = _hi").select(stratum)
    if lone.isEmpty():
        return out
    anywhere = next_other(rows, item, owner)
    return out.filter("donor IS NOT NULL").unionByName(rows.join(lone, stratum, "left_semi").join(anywhere, item).select(item, owner, stratum, "donor"))


#: Consecutive ids that one task looks through.
RUN_IDS = 100_000


def next_other(rows: DataFrame, item: str, owner: str) -> DataFrame:
    """(item, donor): the next item in circular id order whose owner differs.

    Runs of RUN_IDS ids are looked through apart; two items of each say what the runs before it go on to.
    """
    r = rows.select(item, owner, F.expr(f"`{item}` div {RUN_IDS}").alias("_run"))
    w = Window.partitionBy("_run").orderBy(item)
    marked = r.withColumn("_k", F.sum(F.coalesce(F.lag(owner).over(w) != F.col(owner), F.lit(True)).cast("int")).over(w))
    heads = marked.groupBy("_run", "_k").agg(F.min(item).alias("_head"), F.first(owner).alias("_own"))
    inside = heads.withColumn("donor", F.lead("_head").over(Window.partitionBy("_run").orderBy("_k")))
    at = lambda k, c: F.min(F.when(F.col("_k") == k, F.col(c)))
    runs = heads.groupBy("_run").agg(at(1, "_own").alias("_o1"), at(1, "_head").alias("_f1"), at(2, "_head").alias("_f2"), F.max(F.struct("_k", "_own"))["_own"].alias("_last"))
    twice = runs.withColumn("_lap", F.explode(F.array(F.lit(0), F.lit(1))))
    order = Window.orderBy("_lap", "_run")  # two rows for each RUN_IDS ids
    ahead = lambda c: F.lead(c).over(order)
    value = twice.withColumn("_v", F.when(ahead("_o1") != F.col("_last"), ahead("_f1")).when(ahead("_f2").isNotNull(), ahead("_f2")))
    onward = value.withColumn("_next", F.first("_v", True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))).filter("_lap = 0").select("_run", "_next")
    found = inside.join(onward, "_run").select("_run", "_k", F.coalesce("donor", "_next").alias("donor"))
    return marked.join(found, ["_run", "_k"]).select(item, "donor")


def condition_pairs(rows: DataFrame, item: str, condition: str, metric: str, baseline: str, treatment: str) -> DataFrame:
    """Items present under both conditions, with the metric of each."""
    side = lambda v, n: rows.filter(F.col(condition) == v).select(item, F.col(metric).alias(n))
    return side(baseline, "baseline").join(side(treatment, "treatment"), item)
