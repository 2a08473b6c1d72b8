"""Queries of annotations and audits; cases are planted by rules on the keys, and each statement says what they must give."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import annotations as an
from tessera.operators import manifests as mf
from tessera.operators.spans import word_tokens
from tessera.plans.registry import duck_norm, query
from tessera.session import cut, table


@query("SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 1 THEN ['role', 'kind'] WHEN 2 THEN ['text'] WHEN 3 THEN ['unbound_changed', 'error_spans'] WHEN 4 THEN ['unbound'] WHEN 5 THEN ['error_spans'] WHEN 6 THEN ['kind'] ELSE [] END AS issues FROM orders")
def annotation_audit(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 9
    a, b = F.concat(F.lit("c"), "o_custkey"), F.col("o_orderstatus")
    text = F.concat(F.lit("for "), a, F.lit(" is "), b)
    at = (F.length(a) + 8).cast("long")
    end_a, end_b = (F.length(a) + 4).cast("long"), at + F.length(b)
    root = F.array(F.lit("r1"))
    node = lambda n, changed, role, roots: F.struct(F.lit(n).alias("node"), F.lit(changed).alias("changed"), role.alias("role"), roots.alias("root_ids"))
    nodes = F.array(node("owner", True, F.when(k == 1, "unchanged").otherwise("root"), root), node("state", False, F.lit("unchanged"), F.array().cast("array<string>")))
    bind = lambda n, s, e, t, error: F.struct(F.lit(n).alias("node"), s.alias("start"), e.alias("end"), t.alias("text"), F.lit(error).alias("error"))
    zero = F.lit(4).cast("long")
    owner, state = bind("owner", zero, end_a, F.when(k == 2, F.lit("?")).otherwise(a), True), bind("state", at, end_b, b, False)
    bindings = F.when(k == 3, F.array(state)).when(k == 4, F.array(owner)).otherwise(F.array(owner, state))
    span = F.struct(F.lit("owner").alias("node"), F.when(k == 5, zero + 1).otherwise(zero).alias("start"), end_a.alias("end"), F.when(k == 6, "propagated").otherwise("root").alias("kind"), root.alias("root_ids"))
    r = o.select(F.col("o_orderkey").alias("id"), text.alias("t"), nodes.alias("n"), bindings.alias("b"), F.array(span).alias("s"))
    return r.select("id", an.annotation_issues(F.col("t"), F.col("n"), F.col("b"), F.col("s")).alias("issues"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'root' ELSE 'unchanged' END AS quantity, CASE WHEN l_linenumber % 3 = 0 THEN 'propagated' ELSE 'unchanged' END AS total, CASE WHEN l_linenumber % 2 = 0 THEN 'propagated' ELSE 'unchanged' END AS note FROM lineitem")
def node_states(spark, sf_dir):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    more = F.when(n % 3 == 0, 1).otherwise(0)
    facts = lambda q_, note: F.concat(F.lit('{"line": {"quantity": '), q_, F.lit(', "sums": [0, '), q_ * 2, F.lit(']}, "note": '), note, F.lit("}"))
    s = an.node_states(facts(q, F.lit('"x"')), facts(q + more, F.when(n % 2 == 0, "null").otherwise('"x"')), {"quantity": "$.line.quantity", "total": "$.line.sums[1]", "note": "$.note"}, F.array(F.lit("quantity")))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s"))
    return l.select("l_orderkey", "l_linenumber", *[F.col("s")[i]["state"].alias(c) for i, c in enumerate(("quantity", "total", "note"))])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 3 THEN 4 ELSE 5 END AS a_start, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 7 WHEN 2 THEN 7 ELSE 5 END AS a_end, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 3 THEN 4 ELSE 5 END AS b_start, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 6 END AS b_end FROM orders")
def text_diff(spark, sf_dir):
    k, tail = F.col("o_orderkey") % 4, F.concat(F.lit("-"), "o_custkey")
    a = F.when(k == 3, F.concat(F.lit("abcde"), tail)).otherwise(F.concat(F.lit("abcdeFG"), tail))
    b = F.when(k == 0, a).when(k == 1, F.concat(F.lit("abcdeXYZ"), tail)).when(k == 2, F.concat(F.lit("abcdeQ"), tail)).otherwise(F.concat(F.lit("abcdeW"), tail))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), an.text_diff(a, b).alias("d"))
    return d.select("id", *[F.col(f"d.{c}").cast("int").alias(c) for c in ("a_start", "a_end", "b_start", "b_end")])


@query("WITH e AS (SELECT event_type, event_id, CAST(event_id % 6 + 1 AS BIGINT) AS n FROM events), t AS (SELECT event_type, event_id, unnest(range(1, n)) AS i FROM e WHERE n > 1) SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum((event_id + i - 1) % 10 / 10.0) / count(*), 9) AS loss FROM t WHERE (event_id + i) % 3 <> 0 GROUP BY event_type")
def masked_token_loss(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), (F.col("event_id") % 6 + 1).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    s = an.next_token_loss(F.transform(at, lambda i: -((F.col("event_id") + i) % 10) / 10.0), F.transform(at, lambda i: (F.col("event_id") + i) % 3 != 0))
    return e.select("event_type", s.alias("s")).groupBy("event_type").agg(F.sum("s.n").alias("n"), F.round(F.sum("s.loss") / F.sum("s.n"), 9).alias("loss"))


_SPLIT = "WITH d AS (SELECT doc_id, doc_id // 10 AS grp, CASE WHEN doc_id % 97 = 0 THEN 'test' WHEN doc_id // 10 % 5 = 0 AND NOT doc_id % 50 = 7 THEN 'validation' ELSE 'train' END AS split FROM documents UNION ALL SELECT doc_id, doc_id // 10, 'validation' FROM documents WHERE doc_id % 41 = 0)"


@query(_SPLIT + """ SELECT 'ids_in_several_splits' AS check, CAST(count(*) AS BIGINT) AS n_bad FROM (SELECT doc_id FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'groups_in_several_splits', count(*) FROM (SELECT grp FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT doc_id FROM d GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown_split', count(*) FROM d WHERE split = 'test' UNION ALL SELECT 'sizes', count(*) FROM (SELECT split, count(*) AS n FROM d GROUP BY 1) WHERE split IN ('train', 'validation') AND n <> 1""")
def split_purity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 10").alias("grp"))
    k = lambda m: F.col("doc_id") % m
    s = d.withColumn("split", F.when(k(97) == 0, "test").when((F.col("grp") % 5 == 0) & (k(50) != 7), "validation").otherwise("train"))
    return an.split_purity(s.unionByName(d.filter(k(41) == 0).withColumn("split", F.lit("validation"))), "doc_id", "grp", "split", {"train": 1, "validation": 1})


@query("WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT b.event_type, CAST(sum(b.n - coalesce(a.n, 0)) AS BIGINT) AS delta, CAST(count(*) FILTER (a.n IS NULL) AS BIGINT) AS n_new FROM b LEFT JOIN a USING (user_id, event_type) GROUP BY b.event_type")
def telemetry_delta(spark, sf_dir):
    """Counters after a run less those before it; a counter that wasn't there counts from zero."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    count = lambda d, n: d.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias(n))
    j = count(e, "after").join(count(e.filter("event_id % 3 <> 0"), "before"), ["user_id", "event_type"], "left")
    return j.groupBy("event_type").agg(F.sum(F.col("after") - F.coalesce("before", F.lit(0))).alias("delta"), F.count_if(F.col("before").isNull()).alias("n_new"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 9 END, CASE WHEN event_id % 6 = 2 THEN event_id END, CASE WHEN event_id % 6 = 3 THEN '\"v' || event_id || '\"' WHEN event_id % 6 = 4 THEN '[' || event_id || ']' END, event_id) AS INTEGER) AS place FROM events")
def value_order(spark, sf_dir):
    """A total order over values of mixed JSON types; what isn't JSON comes last."""
    e, k, i = table(spark, sf_dir, "events"), F.col("event_id") % 6, F.col("event_id")
    j = F.when(k == 0, F.lit("null")).when(k == 1, F.lit("true")).when(k == 2, i.cast("string")).when(k == 3, F.concat(F.lit('"v'), i, F.lit('"'))).when(k == 4, F.concat(F.lit("[ "), i, F.lit("]"))).otherwise(F.lit("{"))
    key = e.select("user_id", "event_id", an.value_key(j).alias("key"))
    return key.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("key.type", "key.number", "key.text", "event_id")).alias("place"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'miss' WHEN 1 THEN 'miss' WHEN 2 THEN 'unreadable' ELSE 'hit' END AS state, CASE WHEN o_orderkey % 5 IN (3, 4) THEN '{\"a\": ' || o_custkey || '}' END AS body FROM orders")
def response_cache(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    r = o.select(F.col("o_orderkey").alias("id"), F.lit("m1").alias("model"))
    c = o.filter(k != 0).select(F.col("o_orderkey").alias("id"), F.when(k == 1, "m0").otherwise("m1").alias("model"), F.when(k == 2, "{").otherwise(F.concat(F.lit('{"a": '), "o_custkey", F.lit("}"))).alias("reply"))
    return an.cached(r, c, "id", ["model"], "reply")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'no_supplied_trace' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN o_orderkey % 4 = 3 THEN 2 END AS n_error_tokens FROM orders")
def prompt_trace_status(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    trace = F.concat(F.lit("take <"), F.col("o_custkey"), F.lit("> now"))
    prompt = F.when(k == 2, F.lit("nothing")).when(k == 1, F.concat(trace, F.lit(" or "), trace)).otherwise(F.concat(F.lit("Do this: "), trace, F.lit("; end")))
    t = o.select(F.col("o_orderkey").alias("id"), prompt.alias("p"), F.when(k != 0, trace).alias("t"))
    errors = F.expr("array(named_struct('start', 5L, 'end', 7L))")  # the bracket and the first digit
    s = an.trace_status(F.col("p"), F.col("t"), errors, word_tokens(F.col("p")))
    return t.select("id", s.alias("s")).select("id", "s.status", F.col("s.n_error_tokens").cast("int").alias("n_error_tokens"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN ['ring'] WHEN l_orderkey % 3 = 1 AND l_linenumber <> 1 THEN ['oxygen'] ELSE [] END AS wrong FROM lineitem")
def phrase_evidence(spark, sf_dir):
    k, n, q = F.col("l_orderkey") % 3, F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    text = F.when(k == 0, F.concat(F.lit("It has "), n, F.lit(" oxygens and "), q + 1, F.lit(" rings."))).when(k == 1, F.concat(F.lit("It has an oxygen and "), q, F.lit(" rings."))).otherwise(F.lit("It has boxes of oxygene."))
    p = an.phrase_issues(text, {"oxygen": n, "ring": q})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.transform(p, lambda x: x["noun"]).alias("wrong"))


@query("SELECT l_orderkey AS request, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (l_returnflag <> 'R') AS BIGINT) AS n_terminal, count(*) = 4 AND count(*) FILTER (l_returnflag <> 'R') = 4 AS ok FROM lineitem GROUP BY l_orderkey")
def sample_counts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "stop").otherwise("length").alias("finish"))
    return an.sample_counts(l, "request", "finish", 4)


@query("SELECT l_orderkey AS record, l_returnflag AS grp, CAST(min(l_suppkey % 3) AS BIGINT) AS value FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey % 3) = 1 AND bool_and(l_linestatus <> 'F')")
def edit_targets(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("grp"), (F.col("l_suppkey") % 3).alias("value"), (F.col("l_linestatus") != "F").alias("mutable"))
    return an.edit_targets(l, "record", "grp")


@query("SELECT o_orderkey AS id, CAST(m AS INTEGER) AS maximum, CAST(least(2, m) AS INTEGER) AS fixed, CAST(least(1 + CAST(('0x' || left(sha256('edits:' || o_orderkey), 8)) AS BIGINT) % 4, m) AS INTEGER) AS drawn FROM (SELECT o_orderkey, o_custkey % 5 AS m FROM orders)")
def requested_edits(spark, sf_dir):
    m = (F.col("o_custkey") % 5).cast("int")
    ask = lambda mode, low=1, high=1: an.requested_edits(m, mode, "edits", F.col("o_orderkey"), low, high)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ask("maximum").alias("maximum"), ask("fixed", 2).alias("fixed"), ask("range", 1, 4).alias("drawn"))


@query("SELECT o_orderkey AS id, 'order ' || o_orderkey || ' (' || o_orderstatus || ' at last)' AS text, CAST(length('order ' || o_orderkey || ' (') AS INTEGER) AS start, true AS stands FROM orders")
def suffix_bindings(spark, sf_dir):
    base = F.concat(F.lit("order "), "o_orderkey")
    own = F.array(F.struct(F.lit(6).cast("long").alias("start"), F.length(base).cast("long").alias("end"), F.col("o_orderkey").cast("string").alias("text")))
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), an.with_suffix(base, own, F.lit(" ({} at last)"), F.col("o_orderstatus")).alias("s")).select("id", "s.*")
    stands = F.forall("bindings", lambda b: F.substring(F.col("text"), (b["start"] + 1).cast("int"), (b["end"] - b["start"]).cast("int")) == b["text"])
    return s.select("id", "text", F.col("bindings")[1]["start"].cast("int").alias("start"), stands.alias("stands"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 8 = 1 THEN ['row'] WHEN doc_id % 8 = 2 THEN ['sha'] WHEN doc_id % 8 = 3 THEN ['n', 'lang'] END AS fields FROM (SELECT doc_id, {duck_norm('text')} AS t FROM documents) WHERE doc_id % 8 IN (1, 2, 3)")
def reconstruction_check(spark, sf_dir):
    """Digests and counts computed again from texts and compared with saved ones, field by field."""
    t, k = tx.norm(F.col("text")), F.col("doc_id") % 8
    again = table(spark, sf_dir, "documents").select("doc_id", tx.digest(t).alias("sha"), F.length(t).alias("n"), "lang")
    saved = again.filter(k != 1).withColumns({"sha": F.when(k == 2, "0").otherwise(F.col("sha")), "n": F.when(k == 3, -1).otherwise(F.col("n")), "lang": F.when(k == 3, "xx").otherwise(F.col("lang"))})
    return an.changed_fields(saved, again, "doc_id", ["sha", "n", "lang"])


# ---- manifests and copies: what the tables themselves hold -------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, sha256(text) AS sha, lang, source FROM documents WHERE text IS NOT NULL), m AS (SELECT sha, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM d GROUP BY sha)
SELECT doc_id, 'lang' AS field, d.lang AS found, m.lang AS expected FROM d JOIN m USING (sha) WHERE d.lang IS DISTINCT FROM m.lang UNION ALL SELECT doc_id, 'source', d.source, m.source FROM d JOIN m USING (sha) WHERE d.source IS DISTINCT FROM m.source""")
def copy_identity_conflicts(spark, sf_dir):
    """Exact copies that name another language or source than the first document with their text; texts are read once and not shuffled."""
    d = cut(table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", tx.digest(F.col("text")).alias("sha"), "lang", "source"))
    first = d.groupBy("sha").agg(F.min(F.struct("doc_id", "lang", "source")).alias("f")).select("sha", "f.lang", "f.source")
    return mf.identity_conflicts(d, first, "sha", "doc_id", ["lang", "source"])


@query("""WITH m AS (SELECT DISTINCT source AS name, lang FROM documents), r AS (SELECT source AS name FROM documents UNION SELECT role FROM conversations)
SELECT r.name, CAST(count(m.lang) AS BIGINT) AS n_owners, CASE WHEN count(m.lang) = 1 THEN min(m.lang) END AS lang, CASE count(m.lang) WHEN 0 THEN 'unknown' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM r LEFT JOIN m ON r.name = m.name GROUP BY r.name""")
def source_name_lookup(spark, sf_dir):
    """Names of sources, and roles, looked up among the languages that own them."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), "lang")
    return mf.name_lookup(d.select("name").unionByName(table(spark, sf_dir, "conversations").select(F.col("role").alias("name"))), d, "name", "lang")


@query("SELECT key, sum(n)::BIGINT AS surplus FROM (SELECT o_orderkey AS key, 1 AS n FROM orders UNION ALL SELECT l_orderkey, -1 FROM lineitem) GROUP BY key HAVING sum(n) <> 0")
def frozen_difference(spark, sf_dir):
    """Keys that orders and their lines don't hold equally often."""
    return mf.multiset_difference(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])


@query("""SELECT 'lang' AS axis, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'digits', CAST(len(CAST(n_chars AS VARCHAR)) AS VARCHAR), count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'labelled', CAST(doc_id IN (SELECT doc_id FROM labels) AS VARCHAR), count(*) FROM documents GROUP BY ALL""")
def merge_counters(spark, sf_dir):
    """Documents by language, source, digits of their length and whether they are labelled."""
    have = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_l", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(have, "doc_id", "left")
    return mf.axis_counts(d, {"lang": F.col("lang"), "source": F.col("source"), "digits": F.length(F.col("n_chars").cast("string")), "labelled": F.col("_l").isNotNull()})


@query("""SELECT doc_id, list_filter([CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'declared_length' END, CASE WHEN NOT coalesce(strlen(text) = length(text), false) THEN 'ascii' END,
CASE WHEN NOT coalesce(len(string_split(text, chr(10))) = 1 + length(text) - length(replace(text, chr(10), '')), false) THEN 'lines' END], lambda x: x IS NOT NULL) AS broken FROM documents""")
def accounting_identities(spark, sf_dir):
    """Lengths that must agree: declared and counted characters, characters and bytes, lines and line ends."""
    t = F.col("text")
    lines = F.size(F.split(t, "\n", -1)) == 1 + F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    tests = {"declared_length": F.col("n_chars") == F.length(t), "ascii": F.octet_length(t) == F.length(t), "lines": lines & t.isNotNull()}
    return table(spark, sf_dir, "documents").select("doc_id", mf.broken_identities(tests).alias("broken"))
