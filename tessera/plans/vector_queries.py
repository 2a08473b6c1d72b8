"""Vector queries over the embeddings table; the reconstruction is a declared, deterministic stand-in."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import vectors as ve
from tessera.operators.corpus import seeded_order
from tessera.plans.registry import query
from tessera.session import table

K = 16
#: The oracle's rows: x as doubles, and z, the K coordinates of largest absolute value.
_Z = f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
l AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) <= {K} AS on_ FROM l),
z AS (SELECT vec_id, label, i, v AS x, CASE WHEN on_ THEN v ELSE 0.0 END AS z FROM k)"""


def _rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return e.withColumn("z", ve.keep_largest(F.col("x"), K))


@query(_Z + ", d AS (SELECT i, avg(x) AS mean, var_pop(x) AS variance FROM z GROUP BY i) SELECT CAST(i AS INTEGER) AS dim, round(mean, 9) AS mean, round(variance, 9) AS variance, round((SELECT sqrt(avg(variance)) FROM d), 9) AS scale FROM d")
def vec_normalizer(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    return ve.normalizer(e, "x").select("dim", *[F.round(c, 9).alias(c) for c in ("mean", "variance", "scale")])


_METRICS = """, p AS (SELECT {key}vec_id, sum((x - z) * (x - z)) AS sse, sum(x * x) AS xx, sum(z * z) AS rr, sum(x * z) AS xr, count(*) AS dims FROM z GROUP BY ALL),
s AS (SELECT {key}sum(ss) AS spread FROM (SELECT {key}i, var_pop(x) * count(*) AS ss FROM z GROUP BY ALL){group})
SELECT {key}CAST(count(*) AS BIGINT) AS n, round(sum(sse) / sum(dims), 9) AS mse, round(sum(sse) / any_value(spread), 9) AS fvu, round(avg(CASE WHEN xx > 0 AND rr > 0 THEN xr / sqrt(xx) / sqrt(rr) ELSE 0 END), 9) AS cosine,
round(avg(sqrt(sse) / sqrt(xx)), 9) AS relative_error, round(avg(sqrt(rr) / sqrt(xx)), 9) AS norm_ratio FROM p {join}{group}"""


def _rounded(df, keys=()):
    return df.select(*keys, "n", *[F.round(c, 9).alias(c) for c in ("mse", "fvu", "cosine", "relative_error", "norm_ratio")])


@query(_Z + _METRICS.format(key="", group="", join="CROSS JOIN s"))
def vec_reconstruction(spark, sf_dir):
    return _rounded(ve.reconstruction(_rows(spark, sf_dir), "x", "z"))


@query(_Z + _METRICS.format(key="label, ", group=" GROUP BY label", join="JOIN s USING (label)"))
def vec_reconstruction_by_label(spark, sf_dir):
    return _rounded(ve.reconstruction(_rows(spark, sf_dir), "x", "z", ["label"]), ["label"])


@query(_Z + ", w AS (SELECT unnest([8, 16, 32, 64]) AS width) SELECT width, round(sum((x - CASE WHEN i < width THEN z ELSE 0 END) * (x - CASE WHEN i < width THEN z ELSE 0 END)) / count(*), 9) AS mse FROM z, w GROUP BY width")
def vec_prefix_metrics(spark, sf_dir):
    r = _rows(spark, sf_dir).withColumn("width", F.explode(F.array(*[F.lit(w) for w in (8, 16, 32, 64)])))
    cut = F.transform("z", lambda v, i: F.when(i < F.col("width"), v).otherwise(F.lit(0.0)))
    d = F.zip_with("x", cut, lambda a, b: a - b)
    return r.select("width", ve.dot(d, d).alias("s"), F.size("x").alias("n")).groupBy("width").agg(F.round(F.sum("s") / F.sum("n"), 9).alias("mse"))


@query(_Z + ", c AS (SELECT vec_id, count(*) FILTER (abs(z) > 0.1) AS l0 FROM z GROUP BY vec_id) SELECT CAST(l0 AS INTEGER) AS l0, CAST(count(*) AS BIGINT) AS n_rows FROM c GROUP BY l0")
def vec_l0_hist(spark, sf_dir):
    return ve.active_counts(_rows(spark, sf_dir), "z", 0.1).groupBy("l0").agg(F.count(F.lit(1)).alias("n_rows"))


@query(_Z + ", c AS (SELECT vec_id, CAST(count(*) FILTER (abs(z) > 0.1) AS DOUBLE) AS l0 FROM z GROUP BY vec_id) SELECT round(avg(l0), 9) AS mean, round(stddev_pop(l0), 9) AS std, quantile_cont(l0, 0.05) AS p05, quantile_cont(l0, 0.5) AS p50, quantile_cont(l0, 0.95) AS p95, quantile_cont(l0, 0.99) AS p99 FROM c")
def vec_l0_quantiles(spark, sf_dir):
    r = ve.active_counts(_rows(spark, sf_dir), "z", 0.1).select(F.col("l0").cast("double").alias("l0"))
    q = lambda p: F.percentile("l0", p)
    return r.agg(F.round(F.avg("l0"), 9).alias("mean"), F.round(F.stddev_pop("l0"), 9).alias("std"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


@query(_Z + " SELECT CAST(i AS INTEGER) AS feature, CAST(count(*) FILTER (abs(z) > 0.25) AS BIGINT) AS n_active, count(*) FILTER (abs(z) > 0.25) / count(*) AS frequency, count(*) FILTER (abs(z) > 0.25) = 0 AS dead, count(*) FILTER (abs(z) > 0.25) / count(*) >= 0.1 AS dense FROM z GROUP BY i")
def vec_dead_dense(spark, sf_dir):
    return ve.feature_frequency(_rows(spark, sf_dir), "z", 0.25)


@query(_Z + ", t AS (SELECT vec_id, CAST(i AS INTEGER) AS feature, z AS v, CAST(row_number() OVER (PARTITION BY i ORDER BY z DESC, vec_id) AS BIGINT) AS rank FROM z WHERE z > 0.05) SELECT * FROM t WHERE rank <= 5")
def vec_topk_feature(spark, sf_dir):
    return ve.top_per_feature(_rows(spark, sf_dir), "z", "vec_id", 5, 0.05).select("vec_id", "feature", "v", F.col("rank").cast("long").alias("rank"))


@query(_Z + ", s AS (SELECT vec_id, i, x, sum(x) OVER w AS c, row_number() OVER w AS r FROM z WINDOW w AS (PARTITION BY vec_id ORDER BY x DESC, i ROWS UNBOUNDED PRECEDING)), t AS (SELECT vec_id, max_by((c - 1) / r, r) AS tau FROM s WHERE 1 + r * x > c GROUP BY vec_id) SELECT z.vec_id, round(sum(greatest(x - tau, 0)), 6) AS total, CAST(count(*) FILTER (x - tau > 1e-9) AS BIGINT) AS support, round(max(greatest(x - tau, 0)), 6) AS top FROM z JOIN t USING (vec_id) GROUP BY z.vec_id")
def vec_sparsemax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", ve.sparsemax(F.col("embedding").cast("array<double>")).alias("p"))
    return e.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.size(F.filter("p", lambda v: v > 1e-9)).cast("long").alias("support"), F.round(F.array_max("p"), 6).alias("top"))


@query("SELECT vec_id, CAST(row_number() OVER (ORDER BY sha256('stream:' || vec_id)) - 1 AS BIGINT) AS place FROM embeddings QUALIFY place < 256")
def vec_shuffled_prefix(spark, sf_dir):
    """A resumable prefix of a seeded shuffle: the order depends on seed and id alone."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("vec_id", seeded_order("stream", F.col("vec_id")).alias("o"))
    first = e.orderBy("o").limit(256)
    return first.select("vec_id", (F.row_number().over(Window.orderBy("o")) - 1).cast("long").alias("place"))


@query("SELECT CAST(s AS BIGINT) AS step, round(CASE WHEN s < 100 THEN 0.001 * (s + 1) / 100 ELSE 0.0001 + 0.5 * (0.001 - 0.0001) * (1 + cos(pi() * (s - 100) / 900)) END, 12) AS rate FROM range(1000) t(s)")
def learning_rate_schedule(spark, sf_dir):
    s = F.col("id")
    warm, cosine = 0.001 * (s + 1) / 100, 0.0001 + 0.5 * (0.001 - 0.0001) * (1 + F.cos(F.lit(math.pi) * (s - 100) / 900))
    return spark.range(1000).select(s.alias("step"), F.round(F.when(s < 100, warm).otherwise(cosine), 12).alias("rate"))


@query(_Z + ", p AS (SELECT vec_id, sum(abs(z)) AS l1, sum(z * z) AS l2, sum((x - z) * (x - z)) AS rec, sum(x * x) AS base FROM z GROUP BY vec_id) SELECT vec_id, round(l1 * l1 / l2, 8) AS participation, CASE WHEN abs(base) > 1e-12 THEN round((base - rec) / base, 8) END AS recovered FROM p")
def vec_participation_recovery(spark, sf_dir):
    r = _rows(spark, sf_dir)
    l1, l2 = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.abs(v)), ve.dot(F.col("z"), F.col("z"))
    d = F.zip_with("x", "z", lambda a, b: a - b)
    base = ve.dot(F.col("x"), F.col("x"))
    return r.select("vec_id", F.round(l1 * l1 / l2, 8).alias("participation"), F.when(F.abs(base) > 1e-12, F.round((base - ve.dot(d, d)) / base, 8)).alias("recovered"))


#: Vectors of a block that is searched at once.
_SEARCHED = 512


@query(_Z + ", b AS (SELECT vec_id, label, list(CASE WHEN z > 0 THEN i END) FILTER (z > 0) AS s FROM z GROUP BY ALL), q AS (SELECT * FROM b WHERE vec_id % 20 = 0), t AS (SELECT q.vec_id, b.vec_id AS other, len(list_intersect(q.s, b.s)) / CAST(len(list_distinct(list_concat(q.s, b.s))) AS DOUBLE) AS sim FROM q JOIN b ON b.label = q.label AND b.vec_id <> q.vec_id) SELECT vec_id, other, round(sim, 9) AS sim FROM t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(sim - 0.3), other) = 1")
def nearest_to_target(spark, sf_dir):
    """For each vector whose id is divisible by 20, the vector of its label whose Tanimoto similarity is nearest to 0.3.

    Vectors of a label are held in blocks of about _SEARCHED, to each of which the label's queries go, so that a label
    of any size is spread.
    """
    s = _rows(spark, sf_dir).select("vec_id", "label", F.expr("filter(transform(z, (v, i) -> if(v > 0, i, -1)), i -> i >= 0)").alias("s"))
    blocks = s.groupBy("label").agg((F.floor(F.count(F.lit(1)) / _SEARCHED) + 1).alias("_blocks"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block")
    q = s.filter("vec_id % 20 = 0").join(blocks, "label").select("vec_id", "label", each, F.col("s").alias("qs"))
    others = s.join(blocks, "label").select(F.col("vec_id").alias("other"), "label", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).alias("_block"), "s")
    j = others.hint("shuffle_hash").join(q, ["label", "_block"]).filter("other <> vec_id")
    sim = F.size(F.array_intersect("qs", "s")) / F.size(F.array_union("qs", "s")).cast("double")
    best = j.select("vec_id", F.struct(F.abs(sim - 0.3).alias("d"), F.col("other"), sim.alias("sim")).alias("b")).groupBy("vec_id").agg(F.min("b").alias("b"))
    return best.select("vec_id", F.col("b.other").alias("other"), F.round("b.sim", 9).alias("sim"))
