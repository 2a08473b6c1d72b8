"""Paired statistics as expressions: Wilson interval, exact McNemar test, entropy shares, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % quantile of the normal distribution.
Z = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """(low, high) of the 95 % interval of a share; null where n is 0."""
    n_ = F.when(n > 0, n.cast("double"))
    p, z2 = k / n_, Z * Z
    mid = (p + z2 / (2 * n_)) / (1 + z2 / n_)
    half = Z * F.sqrt(p * (1 - p) / n_ + z2 / (4 * n_ * n_)) / (1 + z2 / n_)
    # greatest and least skip nulls, so the empty case is named.
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts b and c: min(1, 2 P(X <= min(b, c))) for X ~ Bin(b + c, 1/2).

    Terms go up by the recurrence C(n, i + 1) = C(n, i) (n - i) / (i + 1), scaled by logs to stay finite.
    """
    n, least = (b + c).cast("double"), F.least(b, c)
    start = F.struct(F.lit(0.0).alias("sum"), (-n * F.log(F.lit(2.0))).alias("log"))
    step = lambda s, i: F.struct((s["sum"] + F.exp(s["log"])).alias("sum"), (s["log"] + F.log((n - i) / (i + 1))).alias("log"))
    # The last term's successor may be log(0), which is null; it is never used.
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), least.cast("long")), start, step, lambda s: s["sum"])
    return F.when(b + c == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))


def contingency(a: Column, b: Column) -> list[Column]:
    """Counts of both, only a, only b and neither."""
    count = lambda cond: F.count_if(cond).cast("long")
    return [count(a & b).alias("n_both"), count(a & ~b).alias("n_first"), count(~a & b).alias("n_second"), count(~a & ~b).alias("n_neither")]


def paired_comparison(pairs: DataFrame, base: str, treat: str, keys: list[str]) -> DataFrame:
    """Accuracies with intervals, difference, discordance test and share of right answers that turn wrong.

    Rows where either side is null are left out; groups without any get nulls.
    """
    both = pairs.filter(F.col(base).isNotNull() & F.col(treat).isNotNull())
    t = both.groupBy(*keys).agg(*contingency(F.col(base), F.col(treat)))
    n = F.col("n_both") + F.col("n_first") + F.col("n_second") + F.col("n_neither")
    right_b, right_t = F.col("n_both") + F.col("n_first"), F.col("n_both") + F.col("n_second")
    (b_lo, b_hi), (f_lo, f_hi) = wilson(right_b, n), wilson(F.col("n_first"), right_b)
    return t.select(
        *keys, "n_both", "n_first", "n_second", "n_neither", n.alias("n"), (right_b / n).alias("acc_base"), (right_t / n).alias("acc_treat"),
        ((right_t - right_b) / n).alias("difference"), b_lo.alias("base_low"), b_hi.alias("base_high"),
        F.when(right_b > 0, F.col("n_first") / right_b).alias("flip"), f_lo.alias("flip_low"), f_hi.alias("flip_high"), mcnemar(F.col("n_first"), F.col("n_second")).alias("p"),
    )


def entropy(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Shannon entropy in bits of the classes of each group; nulls are a class of their own."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys))
    per = counts.select(*keys, "_n", label, share.alias("_p"))
    return per.groupBy(*keys).agg(F.sum(-F.col("_p") * F.log2("_p")).alias("entropy"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_classes"), F.sum(F.when(F.col(label).isNotNull(), F.col("_n")).otherwise(0)).alias("n_valid"))


def size_estimate(rows: DataFrame, keys: list[str], value: str, population: Column, sample: int) -> DataFrame:
    """Total of ``value`` from a fixed-size sample (the ``sample`` first rows in hashed order): mean times N,
    1.96 standard errors with finite-population correction, nearest-rank median and 95 % rank."""
    m = F.count(F.lit(1))
    sorted_ = F.array_sort(F.collect_list(value))  # at most ``sample`` values
    agg = rows.groupBy(*keys).agg(F.first(population).alias("population"), m.alias("m"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), sorted_.alias("_s"))
    fpc = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("m") / F.col("population")))
    at = lambda k: F.element_at("_s", (k + 1).cast("int"))
    return agg.select(
        *keys, "population", "m", (F.col("mean") * F.col("population")).alias("estimate"),
        (1.96 * F.col("sd") / F.sqrt("m") * F.col("population") * fpc).alias("margin"),
        at(F.floor(F.col("m") / 2)).alias("p50"), at(F.least(F.col("m") - 1, F.floor(0.95 * F.col("m")))).alias("p95"),
    )
