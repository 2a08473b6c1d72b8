"""Corpus build and audit queries over documents, conversations, benchmark and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.stats import size_estimate
from tessera.operators import corpus as co
from tessera.operators.graph import connected_components
from tessera.plans.registry import duck_norm, query
from tessera.session import cut, table

SEED, SHARE = 20_260_921, 0.02
_N = duck_norm("text")
#: The corpus build of the oracle: norm, digest, first of each digest, exact block list, hash split.
_BUILD = f"""
WITH n AS (SELECT doc_id, source, lang, coalesce({_N}, '') AS t FROM documents),
h AS (SELECT *, sha256(t) AS sha FROM n),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY sha) AS first_id FROM h),
b AS (SELECT DISTINCT {_N} AS t FROM benchmark),
r AS (SELECT f.*, first_id = doc_id AS is_first, t IN (SELECT t FROM b) AS blocked,
        CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_words,
        CASE WHEN CAST(('0x' || left(sha256('{SEED}:' || sha), 12)) AS BIGINT) / 281474976710656.0 < {SHARE} THEN 'validation' ELSE 'train' END AS split FROM f)
"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with digest, words, block reasons, first of their digest and split, without texts: they are read and hashed once."""
    t = F.coalesce(tx.norm(F.col("text")), F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.transform(F.array(t), lambda x: F.struct(tx.digest(x).alias("sha"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).cast("long").alias("n_words")))[0].alias("_t"))
    d = cut(d.select("doc_id", "source", "lang", "_t.sha", "_t.n_words"))
    blocked = table(spark, sf_dir, "benchmark").select(tx.digest(tx.norm(F.col("text"))).alias("sha"))
    d = co.blocked_reasons(d, [("benchmark", "sha", blocked)])
    d = co.first_wins(d, "sha", ["doc_id"], "doc_id")
    return d.withColumn("split", co.hash_split(F.col("sha"), SEED, SHARE))


@query(_BUILD + "SELECT source, split, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_words) AS BIGINT) AS n_words FROM r WHERE is_first AND NOT blocked GROUP BY ALL")
def corpus_build(spark, sf_dir):
    kept = _prepared(spark, sf_dir).filter("kept AND size(reasons) = 0")
    return kept.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))


@query(f"SELECT doc_id, sha256({_N}) AS sha, CAST(length({_N}) AS BIGINT) AS n_norm FROM documents")
def norm_digest(spark, sf_dir):
    t = tx.norm(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.digest(t).alias("sha"), F.length(t).cast("long").alias("n_norm"))


@query(_BUILD + "SELECT doc_id, is_first AS kept, CASE WHEN NOT is_first THEN first_id ELSE -1 END AS duplicate_of FROM r")
def exact_dedup_first_wins(spark, sf_dir):
    return _prepared(spark, sf_dir).select("doc_id", "kept", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


@query(f"SELECT doc_id, list_sort(list(DISTINCT reason)) AS reasons FROM (SELECT doc_id, 'benchmark' AS reason FROM documents WHERE {_N} IN (SELECT {_N} FROM benchmark) UNION ALL SELECT doc_id, 'toxic' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY doc_id")
def blocked_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.norm(F.col("text")).alias("t"))
    b = table(spark, sf_dir, "benchmark").select(tx.norm(F.col("text")).alias("t"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    out = co.blocked_reasons(d, [("benchmark", "t", b), ("toxic", "doc_id", toxic)])
    return out.filter(F.size("reasons") > 0).select("doc_id", "reasons")


_FLAGS = f"""SELECT doc_id, unnest(list_filter([
  CASE WHEN {_N} = '' THEN 'empty_message' END, CASE WHEN regexp_matches(text, '<\\|[a-z_]+\\|>|\\[/?INST\\]|</s>') THEN 'embedded_chat_control' END,
  CASE WHEN regexp_matches(text, '(?i)\\b(?:the\\s+)?(?:final\\s+|correct\\s+)?answer\\s*(?:is|:|=)|<answer>|\\bground[ _-]?truth\\b') THEN 'answer_cue' END,
  CASE WHEN contains(text, '<mol>') THEN 'unresolved_placeholder' END,
  CASE WHEN {_N} = '' OR len(string_split({_N}, ' ')) < 16 THEN 'fewer_than_min_words' END], lambda x: x IS NOT NULL)) AS flag FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""


@query(f"SELECT flag, CAST(count(*) AS BIGINT) AS n_docs FROM ({_FLAGS}) GROUP BY flag")
def quality_flags_hist(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(co.quality_flags(F.col("text"))).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n_docs"))


@query(_BUILD + "SELECT source, CAST(count(*) AS BIGINT) AS n_in, CAST(count(*) FILTER (is_first AND NOT blocked) AS BIGINT) AS n_kept, CAST(count(*) FILTER (NOT (is_first AND NOT blocked)) AS BIGINT) AS n_excluded, true AS balanced FROM r GROUP BY source")
def accept_exclude_accounting(spark, sf_dir):
    return co.conservation(_prepared(spark, sf_dir), "source", F.expr("kept AND size(reasons) = 0"))


@query(_BUILD + "SELECT reason, CAST(count(*) AS BIGINT) AS n_docs FROM (SELECT unnest(list_filter([CASE WHEN NOT is_first THEN 'duplicate' END, CASE WHEN blocked THEN 'benchmark' END, CASE WHEN n_words < 16 THEN 'fewer_than_16_words' END, CASE WHEN n_words > 4096 THEN 'over_context_limit' END], lambda x: x IS NOT NULL)) AS reason FROM r) GROUP BY reason")
def exclusion_reasons(spark, sf_dir):
    d = _prepared(spark, sf_dir)
    why = F.array_compact(F.array(F.when(~F.col("kept"), F.lit("duplicate")), F.when(F.size("reasons") > 0, F.lit("benchmark")), F.when(F.col("n_words") < 16, F.lit("fewer_than_16_words")), F.when(F.col("n_words") > 4096, F.lit("over_context_limit"))))
    return d.select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_docs"))


@query(_BUILD + "SELECT source, lang, split, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_words) AS BIGINT) AS n_words FROM r GROUP BY GROUPING SETS ((source), (source, split), (source, lang, split))")
def task_counts(spark, sf_dir):
    _prepared(spark, sf_dir).createOrReplaceTempView("_tessera_prepared")
    return spark.sql("SELECT source, lang, split, count(*) AS n_docs, sum(n_words) AS n_words FROM _tessera_prepared GROUP BY GROUPING SETS ((source), (source, split), (source, lang, split))")


_SEL = """WITH d AS (SELECT doc_id, source, CAST(n_chars AS BIGINT) AS n_chars, CASE WHEN lang = 'en' THEN 'main' ELSE 'pool' END AS pool, sha256('42:' || doc_id) AS o FROM documents),
tot AS (SELECT pool, round_even(sum(n_chars) * CASE WHEN pool = 'main' THEN 0.3 ELSE 0.7 END * 0.25, 0) AS target FROM d GROUP BY pool),
c AS (SELECT d.*, target, coalesce(sum(n_chars) OVER (PARTITION BY d.pool ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN tot USING (pool))"""


@query(_SEL + " SELECT doc_id, pool, n_chars FROM c WHERE before < target")
def token_budget_selection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.when(F.col("lang") == "en", F.lit("main")).otherwise(F.lit("pool")).alias("pool"))
    weight = F.when(F.col("pool") == "main", F.lit(0.3)).otherwise(F.lit(0.7))
    tot = d.groupBy("pool").agg(F.sum("n_chars").alias("_sum")).select("pool", F.bround(F.col("_sum") * weight * 0.25).alias("target"))
    return co.budget_selection(d.join(tot, "pool"), ["pool"], co.seeded_order("42", F.col("doc_id")), "n_chars", F.col("target")).select("doc_id", "pool", "n_chars")


@query(_SEL + ", s AS (SELECT * FROM c WHERE before < target) SELECT pool, CAST(sum(n_chars) AS BIGINT) AS taken, CAST(count(*) AS BIGINT) AS n_docs, CAST(greatest(0.0, any_value(target) - sum(n_chars)) AS DOUBLE) AS shortfall FROM s GROUP BY pool")
def budget_report(spark, sf_dir):
    chosen = token_budget_selection(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("n_chars", F.when(F.col("lang") == "en", F.lit("main")).otherwise(F.lit("pool")).alias("pool"))
    weight = F.when(F.col("pool") == "main", F.lit(0.3)).otherwise(F.lit(0.7))
    tot = d.groupBy("pool").agg(F.sum("n_chars").alias("_sum")).select("pool", F.bround(F.col("_sum") * weight * 0.25).alias("target"))
    agg = chosen.groupBy("pool").agg(F.sum("n_chars").alias("taken"), F.count(F.lit(1)).alias("n_docs"))
    return agg.join(tot, "pool").select("pool", "taken", "n_docs", F.greatest(F.lit(0.0), F.col("target") - F.col("taken")).alias("shortfall"))


@query("SELECT doc_id, source, lang, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY sha256('7:' || source || ':' || doc_id)) AS BIGINT) AS rank FROM documents QUALIFY rank <= 5")
def stratified_hash_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return co.first_per_group(d, ["source", "lang"], [co.seeded_order("7", F.col("source"), F.col("doc_id"))], 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY sha256('dev:' || doc_id)) <= 6 THEN 'development' ELSE 'heldout' END AS part FROM documents")
def make_split(spark, sf_dir):
    """The first six of each source go to development; the planner cuts sources down to six before it shuffles them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    six = co.first_per_group(d, ["source"], [co.seeded_order("dev", F.col("doc_id"))], 6).select("doc_id", F.lit(True).alias("_dev"))
    return d.join(six, "doc_id", "left").select("doc_id", "source", F.when(F.col("_dev"), "development").otherwise("heldout").alias("part"))


_RANKED = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('{0}:' || doc_id)) AS r FROM documents{1}"


@query(f"WITH one AS (SELECT * FROM ({_RANKED.format('a', '')}) WHERE r <= 7), two AS (SELECT * FROM ({_RANKED.format('b', ' WHERE doc_id NOT IN (SELECT doc_id FROM one)')}) WHERE r <= 7) SELECT doc_id, source, 1 AS round FROM one UNION ALL SELECT doc_id, source, 2 FROM two")
def audit_rounds(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    one = co.first_per_group(d, ["source"], [co.seeded_order("a", F.col("doc_id"))], 7)
    two = co.first_per_group(d.join(one.select("doc_id"), "doc_id", "left_anti"), ["source"], [co.seeded_order("b", F.col("doc_id"))], 7)
    return one.select("doc_id", "source", F.lit(1).alias("round")).unionByName(two.select("doc_id", "source", F.lit(2).alias("round")))


@query("WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, lang, CAST(turn AS BIGINT) AS turn, CAST(row_number() OVER (ORDER BY turn, lang NULLS LAST) AS BIGINT) AS place FROM t")
def round_robin_order(spark, sf_dir):
    """All documents in turns of their languages; a place is one more than the rows of earlier turns and of earlier
    languages of the same turn, which follow from the size of each language, so no task orders all rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    # One row; as long as there are languages.
    sizes = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("lang", "n")).alias("_sizes"))
    turn = F.col("turn").cast("long")
    first = lambda s: (s["lang"] < F.col("lang")) | (s["lang"].isNotNull() & F.col("lang").isNull())  # noqa: E731  null comes last
    before = lambda s: F.least(s["n"], turn - 1) + F.when((s["n"] >= turn) & F.coalesce(first(s), F.lit(False)), 1).otherwise(0)
    t = co.round_robin(d, ["lang"], [F.col("doc_id")]).crossJoin(F.broadcast(sizes))
    return t.select("doc_id", "lang", turn.alias("turn"), (F.aggregate("_sizes", F.lit(0).cast("long"), lambda n, s: n + before(s)) + 1).alias("place"))


@query(f"SELECT source, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT sha256(coalesce({_N}, ''))) AS BIGINT) AS n_distinct, CAST(count(*) FILTER (coalesce({_N}, '') = '') AS BIGINT) AS n_empty, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(count(DISTINCT lang) AS BIGINT) AS n_langs FROM documents GROUP BY source")
def census(spark, sf_dir):
    t = F.coalesce(tx.norm(F.col("text")), F.lit(""))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(tx.digest(t)).alias("n_distinct"), F.count_if(t == "").alias("n_empty"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("lang").alias("n_langs"))


@query("""WITH p AS (SELECT source, n_chars, count(*) OVER (PARTITION BY source) AS population, row_number() OVER (PARTITION BY source ORDER BY sha256('census:' || doc_id)) AS r FROM documents),
s AS (SELECT source, any_value(population) AS population, count(*) AS m, avg(n_chars) AS mean, coalesce(stddev_samp(n_chars), 0) AS sd, list_sort(list(n_chars)) AS v FROM p WHERE r <= 1024 GROUP BY source)
SELECT source, population, m, round(mean * population, 4) AS estimate, round(1.96 * sd / sqrt(m) * population * sqrt(greatest(0.0, 1 - m / population)), 4) AS margin, v[CAST(m // 2 + 1 AS BIGINT)] AS p50, v[CAST(least(m - 1, floor(0.95 * m)) + 1 AS BIGINT)] AS p95 FROM s""")
def census_estimate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    n = d.groupBy("source").agg(F.count(F.lit(1)).alias("population"))
    sample = co.first_per_group(d, ["source"], [co.seeded_order("census", F.col("doc_id"))], 1024).join(n, "source")
    e = size_estimate(sample, ["source"], "n_chars", F.col("population"), 1024)
    return e.withColumns({"estimate": F.round("estimate", 4), "margin": F.round("margin", 4)})


@query(f"WITH h AS (SELECT DISTINCT source, sha256({_N}) AS sha FROM documents) SELECT a.source AS source_a, b.source AS source_b, CAST(count(*) AS BIGINT) AS n_shared FROM h a JOIN h b ON a.sha = b.sha AND a.source < b.source GROUP BY ALL")
def source_overlap(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select("source", tx.digest(tx.norm(F.col("text"))).alias("sha")).distinct()
    # Sources of a digest: a bounded set, as there are few sources.
    s = h.groupBy("sha").agg(F.array_sort(F.collect_set("source")).alias("s")).filter(F.size("s") > 1)
    pair = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.struct(a.alias("source_a"), b.alias("source_b")))))
    return s.select(F.explode(pair).alias("p")).groupBy("p.source_a", "p.source_b").agg(F.count(F.lit(1)).alias("n_shared"))


@query("SELECT CAST(c.conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns, list(role ORDER BY turn) AS roles, bool_and(role <> coalesce(prev, '')) AS alternates, sha256(string_agg(role || chr(10) || text, chr(10) ORDER BY turn)) AS dialog_sha FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) c GROUP BY c.conv_id")
def conv_assemble(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    alternates = F.forall(F.sequence(F.lit(1), F.size("m")), lambda i: (i == 1) | (F.get("m", i - 1)["role"] != F.coalesce(F.get("m", i - 2)["role"], F.lit(""))))
    body = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\n"), x["text"])), "\n")
    return c.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.transform("m", lambda x: x["role"]).alias("roles"), alternates.alias("alternates"), tx.digest(body).alias("dialog_sha"))


@query("WITH d AS (SELECT conv_id, sha256(string_agg(role || chr(31) || text, chr(30) ORDER BY turn)) AS sha FROM conversations GROUP BY conv_id) SELECT conv_id, conv_id = min(conv_id) OVER (PARTITION BY sha) AS kept, CASE WHEN conv_id <> min(conv_id) OVER (PARTITION BY sha) THEN min(conv_id) OVER (PARTITION BY sha) ELSE -1 END AS duplicate_of FROM d")
def conv_dialog_hash_dedup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    c = c.select("conv_id", tx.digest(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\x1f"), x["text"])), "\x1e")).alias("sha"))
    return co.first_wins(c, "sha", ["conv_id"], "conv_id").select("conv_id", "kept", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


_KEYS = f"""k AS (SELECT doc_id, 'first:' || {duck_norm("string_split(text, chr(10))[1]")} AS key, length({duck_norm("string_split(text, chr(10))[1]")}) AS n FROM documents
UNION ALL SELECT doc_id, 'last:' || {duck_norm("string_split(text, chr(10))[-1]")}, length({duck_norm("string_split(text, chr(10))[-1]")}) FROM documents),
g AS (SELECT doc_id, key FROM k WHERE n >= 20),
e AS (SELECT DISTINCT a.doc_id AS a, m.doc_id AS b FROM g a JOIN (SELECT key, min(doc_id) AS doc_id FROM g GROUP BY key) m USING (key)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.a, r.root FROM r JOIN u ON u.b = r.node)"""


def _components(spark, sf_dir):
    """Documents grouped by long first or last lines that they share; each key is a star around its first document."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    keys = F.array(F.struct(F.lit("first:").alias("p"), tx.norm(F.element_at(lines, 1)).alias("v")), F.struct(F.lit("last:").alias("p"), tx.norm(F.element_at(lines, -1)).alias("v")))
    k = d.select("doc_id", F.explode(keys).alias("k")).filter(F.length("k.v") >= 20).select("doc_id", F.concat("k.p", "k.v").alias("key"))
    star = k.join(k.groupBy("key").agg(F.min("doc_id").alias("b")), "key").select(F.col("doc_id").alias("a"), "b")
    comps = connected_components(star)
    return d.select(F.col("doc_id").alias("node")).join(comps, "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("component", "node").alias("group_id"))


@query(f"WITH RECURSIVE {_KEYS} SELECT node AS doc_id, min(root) AS group_id FROM r GROUP BY node")
def group_components(spark, sf_dir):
    return _components(spark, sf_dir)


@query(f"WITH RECURSIVE {_KEYS}, c AS (SELECT node AS doc_id, min(root) AS group_id FROM r GROUP BY node) SELECT split, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT group_id) AS BIGINT) AS n_groups FROM (SELECT *, CASE WHEN CAST(('0x' || left(sha256('42:' || group_id), 12)) AS BIGINT) / 281474976710656.0 < 0.1 THEN 'validation' ELSE 'train' END AS split FROM c) GROUP BY split")
def group_split(spark, sf_dir):
    c = _components(spark, sf_dir).withColumn("split", co.hash_split(F.col("group_id"), 42, 0.1))
    return c.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("group_id").alias("n_groups"))


@query(f"WITH RECURSIVE {_KEYS}, c AS (SELECT node AS doc_id, min(root) AS group_id FROM r GROUP BY node), s AS (SELECT *, CASE WHEN CAST(('0x' || left(sha256('42:' || group_id), 12)) AS BIGINT) / 281474976710656.0 < 0.1 THEN 'validation' ELSE 'train' END AS split FROM c) SELECT 'groups_in_both_splits' AS check_name, CAST(count(*) AS BIGINT) AS n_bad FROM (SELECT group_id FROM s GROUP BY group_id HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT doc_id FROM s GROUP BY doc_id HAVING count(*) > 1) UNION ALL SELECT 'documents_without_group', count(*) FROM s WHERE group_id IS NULL")
def verify_corpus(spark, sf_dir):
    s = _components(spark, sf_dir).withColumn("split", co.hash_split(F.col("group_id"), 42, 0.1))
    n = lambda name, bad: bad.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad")
    both = s.groupBy("group_id").agg(F.countDistinct("split").alias("k")).filter("k > 1")
    twice = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    return n("groups_in_both_splits", both).unionByName(n("repeated_ids", twice)).unionByName(n("documents_without_group", s.filter("group_id IS NULL")))


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1) // 10 AS BIGINT) AS shard, CAST((row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1) % 10 AS BIGINT) AS line_index FROM documents")
def shard_addresses(spark, sf_dir):
    from tessera.sources.writers import addressed

    return addressed(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 10).select("doc_id", "shard", "line_index")


@query("SELECT doc_id, source, CAST(doc_id % 4 AS BIGINT) AS part FROM documents WHERE doc_id % 4 = 1")
def row_partition(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.pmod("doc_id", F.lit(4)) == 1).select("doc_id", "source", F.pmod("doc_id", F.lit(4)).alias("part"))


@query(f"SELECT doc_id, CASE WHEN length({_N}) > 400 THEN left({_N}, 400) || '...[cut]' ELSE {_N} END AS shown FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_N}, '(?i)(authorization\\s*:\\s*|bearer\\s+)[A-Za-z0-9._~+/=-]+', '\\1[REDACTED]', 'g'), '(?i)((?:api[_-]?key|token|secret|password)\\s*[=:]\\s*\"?)[A-Za-z0-9._-]+', '\\1[REDACTED]', 'g'), 'sk-[A-Za-z0-9_-]{{8,}}', '[REDACTED]', 'g') AS text FROM documents)")
def redacted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact(tx.norm(F.col("text"))).alias("shown"))
