"""Records against manifests and copies: identities, names, multisets, counters, sums that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.release import codes


def identity_conflicts(records: DataFrame, manifest: DataFrame, key: str, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, found, expected) of each field of a record that differs from its manifest row; nulls equal each other only.

    A manifest holds a key once. Records without a manifest row have one issue of field ``""``; a null key has none.
    """
    m = manifest.select(key, F.lit(True).alias("_m"), *[F.col(f).alias(f"_m_{f}") for f in fields])
    issue = lambda test, field, a, b: F.when(test, F.struct(F.lit(field).alias("field"), a.cast("string").alias("found"), b.cast("string").alias("expected")))
    none = F.lit(None).cast("string")
    known = F.col("_m").isNotNull()
    found = [issue(known & ~F.col(f).eqNullSafe(F.col(f"_m_{f}")), f, F.col(f), F.col(f"_m_{f}")) for f in fields]
    j = records.join(m, key, "left").select(id_col, F.explode(F.array_compact(F.array(issue(~known, "", none, none), *found))).alias("_i"))
    return j.select(id_col, "_i.field", "_i.found", "_i.expected")


def name_lookup(requested: DataFrame, manifest: DataFrame, name: str, owner: str) -> DataFrame:
    """(name, n_owners, owner, status) of each requested name: found, ambiguous (several owners) or unknown.

    ``owner`` is given for names that are found. Owners are distinct pairs, so a repeated manifest row isn't ambiguous.
    """
    m = manifest.groupBy(name).agg(F.countDistinct(owner).alias("n_owners"), F.min(owner).alias("_o"))
    j = requested.select(name).distinct().join(m, name, "left").withColumn("n_owners", F.coalesce("n_owners", F.lit(0)))
    status = F.when(F.col("n_owners") == 0, "unknown").when(F.col("n_owners") > 1, "ambiguous").otherwise("found")
    return j.select(name, "n_owners", F.when(F.col("n_owners") == 1, F.col("_o")).alias(owner), status.alias("status"))


def multiset_difference(saved: DataFrame, prepared: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that two copies don't hold equally often: ``surplus`` is how many more the saved one has, below zero if fewer.

    One aggregation with partial sums, so a row that repeats without end is counted before it is shuffled; no rows: equal.
    """
    both = saved.select(*columns, F.lit(1).cast("long").alias("_n")).unionByName(prepared.select(*columns, F.lit(-1).cast("long").alias("_n")))
    return both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


def axis_counts(rows: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """(axis, value, n) of several groupings in one pass over the rows; a null is a value of its own."""
    each = F.array(*[F.struct(F.lit(a).alias("axis"), c.cast("string").alias("value")) for a, c in axes.items()])
    return rows.select(F.explode(each).alias("_a")).groupBy("_a").agg(F.count(F.lit(1)).alias("n")).select("_a.axis", "_a.value", "n")


def broken_identities(tests: dict[str, Column]) -> Column:
    """Names of the identities that don't hold in a row; one that can't be judged (null) counts as broken."""
    return codes(*[(n, ~t) for n, t in tests.items()])
