"""Pair, statistics, join and report queries over labels, events, orders, lineitem and conversations.

The tables have no model answers, so paired booleans and conditions are stand-ins, named in each query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import stats as st
from tessera.functions import text as tx
from tessera.operators import claims as cl
from tessera.operators import pairs as pa
from tessera.plans.registry import query
from tessera.session import table

_Z = st.Z
_WILSON = "({k} / {n} + {z2} / (2 * {n})) / (1 + {z2} / {n}) {sign} {z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z2} / (4 * {n} * {n})) / (1 + {z2} / {n})"


def _duck_wilson(k: str, n: str, lo: str, hi: str) -> str:
    form = lambda sign: _WILSON.format(k=k, n=f"nullif(CAST({n} AS DOUBLE), 0)", z=_Z, z2=_Z * _Z, sign=sign)
    return f"CASE WHEN {n} > 0 THEN round(greatest(0.0, {form('-')}), 9) END AS {lo}, CASE WHEN {n} > 0 THEN round(least(1.0, {form('+')}), 9) END AS {hi}"


def _labelled(spark, sf_dir):
    """Stand-in pairs: per document, good quality as the baseline's answer and not toxic as the treatment's."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "lang", (F.col("quality") == 1).alias("base"), (F.col("toxic") == 0).alias("treat"))


_LAB = "WITH p AS (SELECT d.doc_id, source, lang, quality = 1 AS base, toxic = 0 AS treat FROM documents d JOIN labels USING (doc_id))"
_CONT = _LAB + ", t AS (SELECT lang, count(*) FILTER (base AND treat) AS n_both, count(*) FILTER (base AND NOT treat) AS n_first, count(*) FILTER (NOT base AND treat) AS n_second, count(*) FILTER (NOT base AND NOT treat) AS n_neither FROM p GROUP BY lang)"


@query(_CONT + " SELECT * FROM t")
def pair_contingency(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("lang").agg(*st.contingency(F.col("base"), F.col("treat")))


@query(_CONT + f", u AS (SELECT *, n_both + n_first + n_second + n_neither AS n, n_both + n_first AS rb, n_both + n_second AS rt FROM t), f AS (SELECT lang, sum(c) AS s FROM (SELECT lang, unnest(list_transform(range(0, least(n_first, n_second) + 1), lambda i: exp(lgamma(n_first + n_second + 1) - lgamma(i + 1) - lgamma(n_first + n_second - i + 1) - (n_first + n_second) * ln(2)))) AS c FROM t) GROUP BY lang) SELECT u.lang, n_both, n_first, n_second, n_neither, n, rb / n AS acc_base, rt / n AS acc_treat, (rt - rb) / n AS difference, {_duck_wilson('rb', 'n', 'base_low', 'base_high')}, CASE WHEN rb > 0 THEN n_first / rb END AS flip, {_duck_wilson('n_first', 'rb', 'flip_low', 'flip_high')}, round(CASE WHEN n_first + n_second = 0 THEN 1.0 ELSE least(1.0, 2 * s) END, 9) AS p FROM u JOIN f USING (lang)")
def paired_comparison(spark, sf_dir):
    out = st.paired_comparison(_labelled(spark, sf_dir), "base", "treat", ["lang"])
    return out.withColumns({c: F.round(c, 9) for c in ("base_low", "base_high", "flip_low", "flip_high", "p")})


@query(f"WITH t AS (SELECT CAST(s.k AS BIGINT) AS k, CAST(r.n AS BIGINT) AS n FROM (SELECT unnest(range(0, 21)) AS n) r, LATERAL (SELECT unnest(range(0, r.n + 1)) AS k) s) SELECT k, n, {_duck_wilson('k', 'n', 'low', 'high')} FROM t WHERE n > 0")
def wilson_table(spark, sf_dir):
    t = spark.range(1, 21).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("k"))
    lo, hi = st.wilson(F.col("k"), F.col("n"))
    return t.select("k", "n", F.round(lo, 9).alias("low"), F.round(hi, 9).alias("high"))


@query("WITH t AS (SELECT CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c FROM (SELECT unnest(range(0, 13)) AS b), (SELECT unnest(range(0, 13)) AS c)), s AS (SELECT b, c, sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) AS s FROM (SELECT b, c, unnest(range(0, least(b, c) + 1)) AS i FROM t) GROUP BY ALL) SELECT b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * s) END + 1e-12, 9) AS p FROM s")
def mcnemar_table(spark, sf_dir):
    t = spark.range(13).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long"))).alias("c"))
    return t.select("b", "c", F.round(st.mcnemar(F.col("b"), F.col("c")) + 1e-12, 9).alias("p"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL), s AS (SELECT user_id, k, event_type, k / sum(k) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(sum(-p * log2(p)), 9) AS entropy, CAST(sum(k) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_classes, CAST(sum(CASE WHEN event_type IS NOT NULL THEN k ELSE 0 END) AS BIGINT) AS n_valid FROM s GROUP BY user_id")
def answer_entropy(spark, sf_dir):
    e = st.entropy(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id"], "event_type")
    return e.withColumn("entropy", F.round("entropy", 9))


@query("WITH c AS (SELECT l_returnflag, l_partkey % 50 AS item, l_linestatus, count(*) AS k FROM lineitem GROUP BY ALL), s AS (SELECT *, k / sum(k) OVER (PARTITION BY l_returnflag, item) AS p FROM c), e AS (SELECT l_returnflag, item, sum(-p * log2(p)) AS entropy FROM s GROUP BY ALL) SELECT l_returnflag AS flag, CAST(count(*) AS BIGINT) AS n_items, round(avg(entropy), 9) AS mean_entropy FROM e GROUP BY 1")
def entropy_report(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_partkey") % 50).alias("item"), "l_linestatus")
    return st.entropy(l, ["flag", "item"], "l_linestatus").groupBy("flag").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg("entropy"), 9).alias("mean_entropy"))


@query("SELECT l_returnflag AS grp, l_linestatus AS sub, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 9) AS discount, CAST(count(*) FILTER (l_tax > 0.04) AS BIGINT) AS n_taxed FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))")
def group_sets_summary(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_tessera_lineitem")
    return spark.sql("SELECT l_returnflag AS grp, l_linestatus AS sub, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 9) AS discount, count_if(l_tax > 0.04) AS n_taxed FROM _tessera_lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))")


@query("SELECT CASE WHEN p_size < 20 THEN 'small' ELSE 'large' END AS family, p_brand AS reporting, p_type AS subtask, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ROLLUP (family, reporting, subtask)")
def task_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") < 20, "small").otherwise("large").alias("family"), F.col("p_brand").alias("reporting"), F.col("p_type").alias("subtask"))
    return p.rollup("family", "reporting", "subtask").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS planned, CAST(count(quality) AS BIGINT) AS scored, round(sum(coalesce(quality, 0)) / count(*), 9) AS share, round(avg(quality), 9) AS among_scored FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def fixed_denominator_readout(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("planned"), F.count("quality").alias("scored"), F.round(F.sum(F.coalesce("quality", F.lit(0))) / F.count(F.lit(1)), 9).alias("share"), F.round(F.avg("quality"), 9).alias("among_scored"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS planned, CAST(count(*) FILTER (v BETWEEN 0 AND 1) AS BIGINT) AS covered, round(avg(v) FILTER (v BETWEEN 0 AND 1), 9) AS mean, round(quantile_cont(v, 0.5) FILTER (v BETWEEN 0 AND 1), 9) AS median, round(min(v) FILTER (v BETWEEN 0 AND 1), 9) AS low, round(max(v) FILTER (v BETWEEN 0 AND 1), 9) AS high FROM (SELECT event_type, value / 100.0 AS v FROM events) GROUP BY event_type")
def severity_summary(spark, sf_dir):
    from tessera.operators.corpus import exact_quantile

    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100.0).alias("v"))
    ok = F.when(F.col("v").between(0, 1), F.col("v"))
    r9 = lambda c: F.round(c, 9)
    per = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("planned"), F.count(ok).alias("covered"), r9(F.avg(ok)).alias("mean"), r9(F.min(ok)).alias("low"), r9(F.max(ok)).alias("high"))
    median = exact_quantile(e, "event_type", "v", 0.5, 0.0, 1.0).select("event_type", r9(F.col("quantile")).alias("median"))
    return per.join(median, "event_type", "left").select("event_type", "planned", "covered", "mean", "median", "low", "high")


@query("SELECT lang, CAST(count(*) FILTER (base = treat) AS BIGINT) AS agreed, CAST(count(*) FILTER (base <> treat) AS BIGINT) AS disputed, CAST(count(*) FILTER (base IS NULL OR treat IS NULL) AS BIGINT) AS other FROM (SELECT lang, quality = 1 AS base, toxic = 0 AS treat FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang")
def review_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    return d.groupBy("lang").agg(F.count_if(a == b).alias("agreed"), F.count_if(a != b).alias("disputed"), F.count_if(a.isNull() | b.isNull()).alias("other"))


@query("WITH r AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(t.v - b.v), 9) AS mean_delta, CAST(count(*) FILTER (t.v > b.v) AS BIGINT) AS n_up FROM r b JOIN r t ON b.user_id = t.user_id WHERE b.event_type = (SELECT min(event_type) FROM events) AND t.event_type = (SELECT max(event_type) FROM events)")
def condition_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("event_type"), F.max("event_type")).first()
    r = e.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    j = pa.condition_pairs(r, "user_id", "event_type", "v", lo, hi)
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("treatment") - F.col("baseline")), 9).alias("mean_delta"), F.count_if(F.col("treatment") > F.col("baseline")).alias("n_up"))


@query("WITH m AS (SELECT conv_id, min(CASE WHEN role = 'user' THEN sha256(text) END) AS u, min(CASE WHEN role = 'assistant' THEN sha256(text) END) AS a, count(*) FILTER (role = 'user') = 1 AND count(*) FILTER (role = 'assistant') = 1 AND count(*) = 2 AS complete FROM conversations GROUP BY conv_id) SELECT conv_id, u AS \"user\", a AS assistant, complete FROM m")
def pair_pivot(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", tx.digest(F.col("text")).alias("sha"))
    return pa.pivot_pairs(c, "conv_id", "role", ["user", "assistant"], "sha")


@query("""WITH l AS (SELECT doc_id AS id, source, n_chars FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE source END AS source, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 0),
j AS (SELECT coalesce(l.id, r.id) AS id, l.id AS li, r.id AS ri, l.source AS ls, r.source AS rs, l.n_chars AS ln, r.n_chars AS rn FROM l FULL JOIN r ON l.id = r.id)
SELECT CAST(id AS VARCHAR) AS id, 'raw_orphan' AS code, '' AS field FROM j WHERE ri IS NULL UNION ALL SELECT CAST(id AS VARCHAR), 'process_orphan', '' FROM j WHERE li IS NULL
UNION ALL SELECT CAST(id AS VARCHAR), 'field_conflict', 'source' FROM j WHERE li IS NOT NULL AND ri IS NOT NULL AND ls IS DISTINCT FROM rs UNION ALL SELECT CAST(id AS VARCHAR), 'field_conflict', 'n_chars' FROM j WHERE li IS NOT NULL AND ri IS NOT NULL AND ln IS DISTINCT FROM rn""")
def fail_closed_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    l = d.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), "source", "n_chars")
    r = d.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.expr("if(doc_id % 11 = 0, 'x', source)").alias("source"), F.expr("if(doc_id % 13 = 0, NULL, n_chars)").alias("n_chars"))
    return pa.join_issues(l, r, "id", ["source", "n_chars"], ("raw", "process")).na.fill("", ["field"])


@query("""WITH o AS (SELECT o_orderkey AS item, o_custkey % 37 AS owner, o_orderpriority AS stratum FROM orders),
own AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY item) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM o),
twice AS (SELECT item, owner, stratum, i, i AS k FROM own UNION ALL SELECT item, owner, stratum, i, i + n FROM own),
heads AS (SELECT *, owner IS DISTINCT FROM lag(owner) OVER (PARTITION BY stratum ORDER BY k) AS head FROM twice),
ahead AS (SELECT *, min(CASE WHEN head THEN k END) OVER (PARTITION BY stratum ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS at FROM heads)
SELECT a.item, a.owner, a.stratum, t.item AS donor FROM ahead a LEFT JOIN twice t ON t.stratum = a.stratum AND t.k = a.at WHERE a.k = a.i""")
def donor_circular(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 37).alias("owner"), F.col("o_orderpriority").alias("stratum"))
    return pa.circular_donors(o, "item", "owner", "stratum")


@query("SELECT 'order' || o_orderkey AS id, CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'urgent' WHEN contains(o_orderpriority, 'HIGH') THEN 'high' ELSE 'other' END AS code, CASE WHEN d > 0 THEN '+' ELSE '' END || d AS delta, regexp_replace('task_' || o_orderstatus || '_v' || (o_orderkey % 12), '_v[0-9]+$', '') AS subtask FROM (SELECT *, CAST(o_orderkey % 7 - 3 AS BIGINT) AS d FROM orders)")
def codes_and_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = (F.col("o_orderkey") % 7 - 3).cast("long")
    return o.select(
        F.concat(F.lit("order"), "o_orderkey").alias("id"), tx.first_code(F.col("o_orderpriority"), [("URGENT", "urgent"), ("HIGH", "high")]).alias("code"), tx.signed(d).alias("delta"),
        tx.without_version(F.concat(F.lit("task_"), "o_orderstatus", F.lit("_v"), F.col("o_orderkey") % 12)).alias("subtask"),
    )


@query("WITH w AS (SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'build' WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'MACHINERY' THEN 'machine' END AS task FROM customer) SELECT coalesce(task, 'unknown') AS task, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1")
def subtask_reconcile(spark, sf_dir):
    alias = spark.createDataFrame([("BUILDING", "build"), ("AUTOMOBILE", "auto"), ("MACHINERY", "machine")], "c_mktsegment string, task string")
    c = table(spark, sf_dir, "customer").select("c_mktsegment").join(F.broadcast(alias), "c_mktsegment", "left")
    return c.groupBy(F.coalesce("task", F.lit("unknown")).alias("task")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH expected AS (SELECT n_nationkey AS k, 60 AS n FROM nation), actual AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT n_name AS name, CAST(e.n AS BIGINT) AS expected, CAST(coalesce(a.n, 0) AS BIGINT) AS actual, e.n = coalesce(a.n, 0) AS equal FROM expected e JOIN nation ON n_nationkey = e.k LEFT JOIN actual a ON a.k = e.k")
def count_reconciliation(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    n = table(spark, sf_dir, "nation").join(a, "n_nationkey", "left")
    actual = F.coalesce("n", F.lit(0)).cast("long")
    return n.select(F.col("n_name").alias("name"), F.lit(60).cast("long").alias("expected"), actual.alias("actual"), (actual == 60).alias("equal"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_quantity > 10 AND l_discount < 0.08 AND l_tax < 0.07 AS all_pass, l_quantity > 40 OR l_discount > 0.08 AS outcome_any, l_quantity > 40 AND l_discount > 0.08 AS outcome_strict FROM lineitem")
def verifier_outcomes(spark, sf_dir):
    checks = F.create_map(F.lit("quantity"), F.col("l_quantity") > 10, F.lit("discount"), F.col("l_discount") < 0.08, F.lit("tax"), F.col("l_tax") < 0.07)
    goals = F.array(F.col("l_quantity") > 40, F.col("l_discount") > 0.08)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.forall(F.map_values(checks), lambda x: x).alias("all_pass"), F.exists(goals, lambda x: x).alias("outcome_any"), F.forall(goals, lambda x: x).alias("outcome_strict"))


_CLAIM = """WITH v AS (SELECT r_regionkey AS record, 'nations' AS node, CAST(count(n_nationkey) AS BIGINT) AS value FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1
UNION ALL SELECT r_regionkey, 'customers', count(c_custkey) FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
UNION ALL SELECT r_regionkey, 'claimed', 5 FROM region UNION ALL SELECT r_regionkey, 'shifted', 300 + r_regionkey FROM region),
e AS (SELECT r_regionkey AS record, u.* FROM region, (VALUES ('e1', 'must_equal', 'nations', 'claimed', 0), ('e2', 'at_least', 'nations', 'customers', 0), ('e3', 'delta_of', 'customers', 'shifted', 5), ('e4', 'at_most', 'customers', 'missing', 0), ('e5', 'guessed', 'nations', 'customers', 0)) u(edge, relation, source, target, delta)),
a AS (SELECT e.record, edge, CASE relation WHEN 'must_equal' THEN s.value = t.value WHEN 'delta_of' THEN t.value = s.value + delta WHEN 'at_most' THEN t.value <= s.value WHEN 'at_least' THEN t.value >= s.value END AS status FROM e LEFT JOIN v s ON s.record = e.record AND s.node = source LEFT JOIN v t ON t.record = e.record AND t.node = target)"""


def _claims(spark, sf_dir):
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    base = region.select(F.col("r_regionkey").alias("record"))
    n = base.join(nation.groupBy(F.col("n_regionkey").alias("record")).agg(F.count(F.lit(1)).alias("value")), "record", "left").select("record", F.lit("nations").alias("node"), F.coalesce("value", F.lit(0)).alias("value"))
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("record")).agg(F.count(F.lit(1)).alias("value"))
    c = base.join(c, "record", "left").select("record", F.lit("customers").alias("node"), F.coalesce("value", F.lit(0)).alias("value"))
    claimed = base.select("record", F.lit("claimed").alias("node"), F.lit(5).cast("long").alias("value"))
    shifted = base.select("record", F.lit("shifted").alias("node"), (F.col("record") + 300).cast("long").alias("value"))
    spec = spark.createDataFrame([("e1", "must_equal", "nations", "claimed", 0), ("e2", "at_least", "nations", "customers", 0), ("e3", "delta_of", "customers", "shifted", 5), ("e4", "at_most", "customers", "missing", 0), ("e5", "guessed", "nations", "customers", 0)], "edge string, relation string, source string, target string, delta long")
    edges = base.crossJoin(F.broadcast(spec))  # five edges for each record
    return edges, n.unionByName(c).unionByName(claimed).unionByName(shifted)


@query(_CLAIM + " SELECT edge, CAST(count(*) FILTER (status) AS BIGINT) AS n_satisfied, CAST(count(*) FILTER (NOT status) AS BIGINT) AS n_violated, CAST(count(*) FILTER (status IS NULL) AS BIGINT) AS n_unknown FROM a GROUP BY edge")
def dag_edge_audit(spark, sf_dir):
    edges, values = _claims(spark, sf_dir)
    return cl.edge_report(cl.audit_edges(edges, values), "edge")


@query(_CLAIM + " SELECT record, CASE WHEN bool_or(status = false) THEN 'fail' WHEN bool_or(status IS NULL) THEN 'unknown' ELSE 'pass' END AS verdict FROM a WHERE edge IN ('e2', 'e4') GROUP BY record")
def dag_verdict(spark, sf_dir):
    edges, values = _claims(spark, sf_dir)
    a = cl.audit_edges(edges, values).filter(F.col("edge").isin("e2", "e4"))
    return a.groupBy("record").agg(F.collect_list(F.struct("status")).alias("s")).select("record", cl.verdict(F.transform("s", lambda x: x["status"])).alias("verdict"))


@query("WITH a AS (SELECT l_orderkey AS record, l_linenumber AS node, CAST(l_quantity AS BIGINT) AS value FROM lineitem), b AS (SELECT record, node, CASE WHEN record % 9 = 0 THEN value + 1 WHEN record % 10 = 0 THEN NULL ELSE value END AS value FROM a WHERE node < 6) SELECT coalesce(a.record, b.record) AS record, coalesce(a.node, b.node) AS node, coalesce(a.value, -1) AS before, coalesce(b.value, -1) AS after FROM a FULL JOIN b ON a.record = b.record AND a.node = b.node WHERE a.value IS DISTINCT FROM b.value")
def semantic_differences(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("node"), F.col("l_quantity").cast("long").alias("value"))
    b = a.filter("node < 6").withColumn("value", F.expr("CASE WHEN record % 9 = 0 THEN value + 1 WHEN record % 10 = 0 THEN NULL ELSE value END"))
    d = cl.semantic_differences(a, b, ["record", "node"], "value")
    return d.na.fill(-1, ["before", "after"])


@query("WITH o AS (SELECT o_orderkey AS id, o_custkey AS s, o_custkey % 10 AS f, o_custkey % 3 AS r FROM orders), n AS (SELECT *, CASE WHEN id % 4 = 0 THEN f + 1 ELSE f END AS f2 FROM o), p AS (SELECT *, CASE WHEN f2 <> f THEN s + f2 - r ELSE s + f - r END AS p2, s + f - r AS p FROM n), q AS (SELECT *, CASE WHEN p2 <> p THEN p2 - s ELSE p - s END AS d2, p - s AS d FROM p) SELECT id, p2 AS product, d2 AS delta, list_filter([CASE WHEN p <> p2 THEN 'product' END, CASE WHEN d <> d2 THEN 'delta' END], lambda x: x IS NOT NULL) AS events FROM q")
def dag_propagation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("s"), (F.col("o_custkey") % 10).alias("f"), (F.col("o_custkey") % 3).alias("r"))
    o = o.withColumn("product", F.col("s") + F.col("f") - F.col("r")).withColumn("delta", F.col("product") - F.col("s"))
    o = o.withColumn("f_new", F.when(F.col("id") % 4 == 0, F.col("f") + 1).otherwise(F.col("f"))).withColumn("product_new", F.col("product")).withColumn("delta_new", F.col("delta"))
    out = cl.propagate(o, [("product", ["f"], F.col("s") + F.col("f_new") - F.col("r")), ("delta", ["product"], F.col("product_new") - F.col("s"))])
    return out.select("id", F.col("product_new").alias("product"), F.col("delta_new").alias("delta"), "events")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS record, 's' || (l_suppkey % 5) AS source, 't' || l_linenumber AS target FROM lineitem), n AS (SELECT record, source AS node FROM e UNION SELECT record, target FROM e)
SELECT record, node, CAST(row_number() OVER (PARTITION BY record ORDER BY node) - 1 AS BIGINT) AS place FROM n""")
def topological_order(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("source"), F.concat(F.lit("t"), F.col("l_linenumber")).alias("target"))
    return cl.topological_order(l.distinct())


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL OR lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) <= ts AS in_order FROM events")
def metadata_contiguity(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.lag("event_id").over(w).isNull() | (F.lag("ts").over(w) <= F.col("ts"))).alias("in_order"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_discount = 0")
def set_operations(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey").intersect(l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")))
    return a.subtract(l.filter("l_discount = 0").select(F.col("l_orderkey").alias("o_orderkey")))


@query("SELECT user_id, event_type, code FROM (SELECT coalesce(a.user_id, e.user_id) AS user_id, coalesce(a.event_type, e.event_type) AS event_type, CASE WHEN a.n > 1 THEN 'duplicate' WHEN a.n IS NULL THEN 'missing' WHEN e.user_id IS NULL THEN 'unexpected' END AS code FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY ALL) a FULL JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0) e ON a.user_id = e.user_id AND a.event_type = e.event_type) WHERE code IS NOT NULL")
def merge_coverage(spark, sf_dir):
    from tessera.sources.writers import coverage

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return coverage(e.filter("user_id % 3 <> 0"), e.filter("event_id % 2 = 0"), ["user_id", "event_type"])


@query("SELECT event_id, user_id, event_type FROM events WHERE (user_id, event_type) IN (SELECT user_id, event_type FROM events WHERE value > 95)")
def retry_failures(spark, sf_dir):
    from tessera.sources.writers import retry_only

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return retry_only(e, e.filter("value > 95"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT event_id) AS BIGINT) AS n_ids FROM events")
def stream_ingest(spark, sf_dir):
    """The events table taken in by a stream that drops repeats, twice: the second run finds nothing new."""
    from uuid import uuid4

    from tessera.session import ensure_checkpoint_dir
    from tessera.streaming.ingest import deduplicated, run_once

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid4().hex}"
    source = table(spark, sf_dir, "events")
    source.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    for _ in range(2):
        run_once(deduplicated(spark.readStream.schema(schema).parquet(f"{base}/in"), "event_id", "ts", "10 days"), f"{base}/out", f"{base}/state")
    return spark.read.schema(schema).parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("event_id").alias("n_ids"))


@query()
def manifest_hash(spark, sf_dir):
    from tessera.sources.readers import file_hashes

    return file_hashes(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("file"), "n_bytes", "sha256")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'duplicate_key' WHEN event_id % 9 = 1 THEN 'non_finite' WHEN event_id % 9 = 2 THEN 'syntax' WHEN event_id % 9 = 3 THEN 'empty' ELSE 'none' END AS issue FROM events")
def strict_json_issues(spark, sf_dir):
    from tessera.sources.readers import strict_json

    e = table(spark, sf_dir, "events").select("event_id", "props")
    i = F.col("event_id") % 9
    text = F.when(i == 0, '{"a": 1, "a": 2}').when(i == 1, '{"a": NaN}').when(i == 2, '{"a": ').when(i == 3, " ").otherwise(F.col("props"))
    return strict_json(e.withColumn("t", text), "t").select("event_id", F.coalesce("issue", F.lit("none")).alias("issue"))


def _molecules(spark, sf_dir):
    """Molecules whose counts follow from how they are written: a chain, a ring, an oxygen, maybe a salt."""
    p = table(spark, sf_dir, "part")
    chain, ring = (F.col("p_partkey") % 5 + 1).cast("int"), (F.col("p_partkey") % 4 + 2).cast("int")
    text = F.concat(F.repeat(F.lit("C"), chain), F.lit("O"), F.lit("C1"), F.repeat(F.lit("C"), ring), F.lit("1"), F.when(F.col("p_partkey") % 3 == 0, ".[Na+]").otherwise(""))
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 17 == 0, F.lit("C(")).otherwise(text).alias("smiles"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN 'syntax' ELSE 'ok' END AS code, CASE WHEN p_partkey % 17 = 0 THEN -1 ELSE CAST(p_partkey % 5 + 1 + 1 + 1 + p_partkey % 4 + 2 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) END AS heavy, CASE WHEN p_partkey % 17 = 0 THEN -1 ELSE 1 END AS rings, CASE WHEN p_partkey % 17 = 0 THEN -1 WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS components FROM part")
def molecule_inspect(spark, sf_dir):
    from tessera.functions.molecules import inspected

    m = _molecules(spark, sf_dir).select("id", inspected(F.col("smiles")).alias("d"))
    return m.select("id", F.coalesce("d.code", F.lit("ok")).alias("code"), *[F.coalesce(f"d.{c}", F.lit(-1)).alias(c) for c in ("heavy", "rings", "components")])


@query("SELECT CAST(count(DISTINCT (p_partkey % 5) * 4 + p_partkey % 4) AS BIGINT) AS n_keys, CAST(4 AS BIGINT) AS n_scaffolds FROM part WHERE p_partkey % 17 <> 0")
def fragment_pool(spark, sf_dir):
    """Distinct main fragments and scaffolds of the pool; invalid texts are left out."""
    from tessera.functions.molecules import inspected

    m = _molecules(spark, sf_dir).select(inspected(F.col("smiles")).alias("d")).filter("d.code IS NULL")
    return m.agg(F.countDistinct("d.main_key").alias("n_keys"), F.countDistinct("d.scaffold_key").alias("n_scaffolds"))


@query()
def molecule_mutations(spark, sf_dir):
    from tessera.functions.molecules import mutation_table

    return mutation_table(_molecules(spark, sf_dir), "id", "smiles").withColumn("similarity", F.round("similarity", 9))


@query()
def molecule_mutation_pick(spark, sf_dir):
    from tessera.functions.molecules import mutation_table, picked_mutation

    return picked_mutation(mutation_table(_molecules(spark, sf_dir), "id", "smiles"), "pick").withColumn("similarity", F.round("similarity", 9))


@query("SELECT f.format, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(count(DISTINCT props) AS BIGINT) AS n_props, CAST(max(length(event_type)) AS BIGINT) AS longest FROM events, (VALUES ('csv'), ('json'), ('jsonl'), ('tsv')) f(format) GROUP BY f.format")
def scan_formats(spark, sf_dir):
    """The events written as JSON lines, as lines of JSON arrays, as CSV and TSV to new folders, and scanned again."""
    from uuid import uuid4

    from tessera.session import ensure_checkpoint_dir
    from tessera.sources.readers import scan

    ensure_checkpoint_dir(spark)
    base, schema = f"{spark.sparkContext.getCheckpointDir()}/scan-{uuid4().hex}", "event_id long, event_type string, props string"
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    e.write.json(f"{base}/lines.jsonl")
    e.select(F.concat(F.lit("["), F.to_json(F.struct("event_id", "event_type", "props")), F.lit("]"))).write.text(f"{base}/lines.json")
    for name, sep in (("csv", ","), ("tsv", "\t")):
        e.write.option("header", True).option("sep", sep).option("escape", '"').csv(f"{base}/lines.{name}")
    out = None
    for name in ("jsonl", "csv", "tsv", "json"):
        read = spark.read.schema(schema).json(f"{base}/lines.json") if name == "json" else scan(spark, f"{base}/lines.{name}", schema)
        got = read.agg(F.lit(name).alias("format"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.countDistinct("props").alias("n_props"), F.max(F.length("event_type")).cast("long").alias("longest"))
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT r || '/' || t AS id, code FROM (SELECT CAST(n_regionkey AS VARCHAR) AS r, n_name AS t, 'count_not_canonical' AS code FROM nation WHERE n_nationkey % 4 IN (1, 2, 3) UNION ALL SELECT CAST(n_regionkey AS VARCHAR), n_name, 'identity_repeats' FROM nation WHERE n_nationkey % 6 = 0)")
def manifest_check(spark, sf_dir):
    """A manifest with counts written as 0, 07 and nothing, and with identities that repeat."""
    from tessera.sources.readers import manifest_issues

    k = F.col("n_nationkey") % 4
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("family"), F.col("n_name").alias("task"), F.when(k == 1, "0").when(k == 2, "07").when(k == 0, "12").alias("n"))
    again = n.filter("n_nationkey % 6 = 0").withColumn("n", F.lit("1"))
    return manifest_issues(n.unionByName(again).drop("n_nationkey"), ["family", "task"], "n")
