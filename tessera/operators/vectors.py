"""Vector operators: normaliser, reconstruction metrics, top-k per feature, sparsemax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalizer(rows: DataFrame, vec: str) -> DataFrame:
    """(dim, mean, var_pop) per dimension; the scale is the root of the mean variance."""
    long = rows.select(F.posexplode(F.col(vec)).alias("dim", "v"))
    per = long.groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.var_pop(F.col("v").cast("double")).alias("variance"))
    # One row per dimension.
    return per.withColumn("scale", F.sqrt(F.avg("variance").over(Window.partitionBy(F.lit(1)))))


def keep_largest(vec: Column, k: int) -> Column:
    """The k coordinates of largest absolute value (earlier first on ties), others 0."""
    order = F.slice(F.array_sort(F.transform(vec, lambda v, i: F.struct((-F.abs(v)).alias("a"), i.alias("i")))), 1, k)
    return F.transform(F.transform(F.array(F.transform(order, lambda s: s["i"])), lambda idx: F.transform(vec, lambda v, i: F.when(F.array_contains(idx, i), v.cast("double")).otherwise(F.lit(0.0)))), lambda x: x)[0]


def reconstruction(rows: DataFrame, x: str, recon: str, keys: list[str] = ()) -> DataFrame:
    """MSE, unexplained variance, cosine, relative error and norm ratio over all rows, in two phases:
    sums per row by array functions, then aggregates that merge across tasks."""
    d = F.zip_with(F.col(x).cast("array<double>"), F.col(recon).cast("array<double>"), lambda a, b: a - b)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    per = rows.select(*keys, dot(d, d).alias("sse"), dot(F.col(x), F.col(x)).alias("xx"), dot(F.col(recon), F.col(recon)).alias("rr"), dot(F.col(x), F.col(recon)).alias("xr"), F.size(x).alias("dims"), F.col(x).alias("_x"))
    nx, nr = F.sqrt("xx"), F.sqrt("rr")
    cosine = F.when((F.col("xx") > 0) & (F.col("rr") > 0), F.col("xr") / F.greatest(nx * nr, F.lit(EPS))).otherwise(0.0)
    sums = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sse").alias("sse"), F.sum("dims").alias("values"), F.avg(cosine).alias("cosine"),
        F.avg(F.sqrt("sse") / F.greatest(nx, F.lit(EPS))).alias("relative_error"), F.avg(nr / F.greatest(nx, F.lit(EPS))).alias("norm_ratio"),
    )
    spread = per.select(*keys, F.posexplode("_x").alias("dim", "v")).groupBy(*keys, "dim").agg((F.var_pop(F.col("v").cast("double")) * F.count(F.lit(1))).alias("ss"))
    whole = spread.groupBy(*keys).agg(F.sum("ss").alias("_spread"))
    j = sums.join(whole, list(keys)) if keys else sums.crossJoin(F.broadcast(whole))  # one row each
    return j.select(*keys, "n", (F.col("sse") / F.col("values")).alias("mse"), (F.col("sse") / F.greatest(F.col("_spread"), F.lit(EPS))).alias("fvu"), "cosine", "relative_error", "norm_ratio")


def active_counts(rows: DataFrame, vec: str, threshold: float = 0.0) -> DataFrame:
    """Adds ``l0``: coordinates whose absolute value is over the threshold."""
    return rows.withColumn("l0", F.size(F.filter(vec, lambda v: F.abs(v) > threshold)))


def feature_frequency(rows: DataFrame, vec: str, threshold: float = 0.0) -> DataFrame:
    """Per feature: in how many rows it is active, its share, and whether it's dead or dense."""
    long = rows.select(F.posexplode(vec).alias("feature", "v"))
    per = long.groupBy("feature").agg(F.count_if(F.abs(F.col("v")) > threshold).cast("long").alias("n_active"), F.count(F.lit(1)).alias("n_rows"))
    share = F.col("n_active") / F.col("n_rows")
    return per.select("feature", "n_active", share.alias("frequency"), (F.col("n_active") == 0).alias("dead"), (share >= 0.1).alias("dense"))


def top_per_feature(rows: DataFrame, vec: str, row_id: str, k: int, threshold: float) -> DataFrame:
    """The k rows of largest activation strictly over the threshold for each feature, earlier rows first on ties."""
    long = rows.select(row_id, F.posexplode(vec).alias("feature", "v")).filter(F.col("v") > threshold)
    w = Window.partitionBy("feature").orderBy(F.desc("v"), row_id)
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sparsemax(vec: Column) -> Column:
    """Projection onto the simplex: sort, running sums, support, threshold."""
    s = F.reverse(F.array_sort(vec.cast("array<double>")))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(0.0).alias("tau"))

    def step(st: Column, v: Column) -> Column:
        total, i = st["sum"] + v, st["i"] + 1
        return F.struct(total.alias("sum"), i.alias("i"), F.when(1 + i * v > total, (total - 1) / i).otherwise(st["tau"]).alias("tau"))

    tau = F.aggregate(s, start, step, lambda st: st["tau"])
    return F.transform(F.array(tau), lambda t: F.transform(vec, lambda v: F.greatest(v.cast("double") - t, F.lit(0.0))))[0]
