"""Queries over records, pairs, predictions and structured texts.

The tables hold no molecules or model answers; cases are planted by rules on the keys, and each statement says from the
rule alone what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import corpus as co
from tessera.operators import drafts as dr
from tessera.operators import evaluation as ev
from tessera.operators import release as re_
from tessera.plans.registry import duck_norm, query
from tessera.session import cut, table

_TOK = "[A-Za-z\\x{C0}-\\x{24F}]+|[0-9]+|[^\\sA-Za-z\\x{C0}-\\x{24F}0-9]"
_CTRL = "<\\|[a-z_]+\\|>"


def _long(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# ---- records of several source shapes --------------------------------------------------------------------------------


def _messages(spark, sf_dir):
    """One schema for three source shapes: dialogues, plain documents, pages."""
    said = lambda role, content: F.struct(F.coalesce(content, F.lit("")).alias("content"), F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    c = c.select(F.lit("conversations").alias("source"), F.col("conv_id").alias("raw_id"), F.transform("m", lambda m: said(m["role"], m["text"])).alias("messages"), F.concat(F.lit("conv:"), "conv_id").alias("key"))
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("raw_id"), F.array(said("user", F.col("text"))).alias("messages"), F.concat(F.lit("lang:"), "lang").alias("key"))
    p = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("raw_id"), F.array(said("user", F.col("url")), said("assistant", F.col("html"))).alias("messages"), F.concat(F.lit("url:"), "url").alias("key"))
    return c.unionByName(d).unionByName(p)


_MESSAGES = f"""WITH m AS (SELECT 'conversations' AS source, conv_id AS raw_id, list({{'content': coalesce(text, ''), 'role': role}} ORDER BY turn, role, text) AS messages, 'conv:' || conv_id AS key FROM conversations GROUP BY conv_id
UNION ALL SELECT 'documents', doc_id, [{{'content': coalesce(text, ''), 'role': 'user'}}], 'lang:' || lang FROM documents
UNION ALL SELECT 'pages', page_id, [{{'content': coalesce(url, ''), 'role': 'user'}}, {{'content': coalesce(html, ''), 'role': 'assistant'}}], 'url:' || url FROM pages),
h AS (SELECT *, sha256(array_to_string(list_transform(messages, lambda x: x.role || chr(31) || x.content), chr(30))) AS sha, messages[1].content AS first FROM m)"""


@query(_MESSAGES + f""" SELECT source, raw_id, sha AS content_sha256, left(sha, 24) AS id, CAST(len(messages) AS BIGINT) AS n_messages, list_sort(list_filter([key, 'first:' || left(sha256({duck_norm('first')}), 16)], lambda x: x IS NOT NULL)) AS group_keys,
list_filter([CASE WHEN {duck_norm('first')} = '' THEN 'empty_message' END, CASE WHEN regexp_matches(first, '<\\|[a-z_]+\\|>|\\[/?INST\\]|</s>') THEN 'embedded_chat_control' END], lambda x: x IS NOT NULL) AS flags FROM h""")
def normalized_records(spark, sf_dir):
    m = _messages(spark, sf_dir)
    sha = tx.digest(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("\x1f"), x["content"])), "\x1e"))
    first = F.col("messages")[0]["content"]
    flags = F.array_intersect(co.quality_flags(first), F.array(F.lit("empty_message"), F.lit("embedded_chat_control")))
    keys = F.array_sort(F.array_distinct(F.array_compact(F.array("key", F.concat(F.lit("first:"), F.left(tx.digest(tx.norm(first)), F.lit(16)))))))
    return m.select("source", "raw_id", sha.alias("content_sha256"), F.left(sha, F.lit(24)).alias("id"), F.size("messages").cast("long").alias("n_messages"), keys.alias("group_keys"), flags.alias("flags"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE CAST(user_id AS VARCHAR) END AS first, CASE WHEN event_type IN ('click', 'view') THEN props ELSE event_type END AS second FROM events")
def text_views(spark, sf_dir):
    """The first and second text of a record, by its kind."""
    kind = F.col("event_type").isin("click", "view")
    return table(spark, sf_dir, "events").select("event_id", F.when(kind, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("first"), F.when(kind, F.col("props")).otherwise(F.col("event_type")).alias("second"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'event: id: ' || event_id || chr(10) || 'kind: ' || event_type || chr(10) || 'tags: a' || chr(10) || user_id || chr(10) || 'props: k: ' || regexp_extract(props, '-?[0-9]+') END AS lines FROM events")
def flattened_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    j = F.concat(F.lit('{"event": {"id": '), "event_id", F.lit(', "kind": "'), "event_type", F.lit('"}, "tags": ["a", "'), "user_id", F.lit('"], "props": '), "props", F.lit("}"))
    return e.select("event_id", dr.flattened(F.when(F.col("event_id") % 7 == 0, F.lit('{"a": ')).otherwise(j)).alias("lines"))


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ['C' || p_size, 'O', 'N'] WHEN 1 THEN ['C' || p_size] WHEN 3 THEN ['gt'] ELSE [] END AS found FROM part")
def metadata_molecules(spark, sf_dir):
    k = F.col("p_partkey") % 5
    c = F.concat(F.lit("C"), "p_size")
    meta = (
        F.when(k == 0, F.concat(F.lit('{"reactants": ["O", "N"], "other": "x", "molecule": "'), c, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"reagents": "'), c, F.lit('"}')))
        .when(k == 2, F.lit('{"molecule": ')).when(k == 3, F.lit('{"molecule": 5, "reactants": null, "gt": "gt"}'))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.coalesce(dr.listed(meta, ["molecule", "reference", "reactants", "reagents", "rxn_smiles", "gt"]), F.array().cast("array<string>")).alias("found"))


@query(f"""WITH c AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS t, CAST(sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(regexp_replace(text, '{_CTRL}', ' ', 'g'), '{_TOK}')) ELSE 0 END) AS BIGINT) AS n_eligible FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(t) AS sha, CAST(len(regexp_extract_all(t, '{_TOK}')) AS BIGINT) AS n_tokens, n_eligible, true AS rising FROM c""")
def chat_token_counts(spark, sf_dir):
    """Rendered chats, and the tokens that training would score; counted again from their positions."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    r = c.select("conv_id", dr.rendered_chat(F.transform("m", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["text"], F.lit("")).alias("content")))).alias("r"))
    t = r.select("conv_id", F.col("r.text").alias("text"), dr.eligible_tokens(F.col("r.text"), F.col("r.spans")).alias("e"))
    p = F.col("e.positions")
    rising = F.forall(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: b.isNull() | (a < b)), lambda x: x)
    return t.select("conv_id", tx.digest(F.col("text")).alias("sha"), F.col("e.n_tokens").alias("n_tokens"), F.size(p).cast("long").alias("n_eligible"), rising.alias("rising"))


# ---- stores and runs -------------------------------------------------------------------------------------------------

_STORE = """WITH RECURSIVE d AS (SELECT doc_id, source, doc_id // 100000 AS block, n_chars, row_number() OVER (PARTITION BY source, doc_id // 100000 ORDER BY doc_id) AS i FROM documents),
s AS (SELECT source, block, i, doc_id, n_chars, n_chars AS fill, CAST(0 AS BIGINT) AS shard FROM d WHERE i = 1
UNION ALL SELECT d.source, d.block, d.i, d.doc_id, d.n_chars, CASE WHEN s.fill + d.n_chars > 20000 THEN d.n_chars ELSE s.fill + d.n_chars END, s.shard + CASE WHEN s.fill + d.n_chars > 20000 THEN 1 ELSE 0 END FROM s JOIN d ON d.source IS NOT DISTINCT FROM s.source AND d.block = s.block AND d.i = s.i + 1)"""


def _packed(spark, sf_dir):
    from tessera.sources.writers import document_shards

    return document_shards(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], "doc_id", "n_chars", 20_000)


@query(_STORE + " SELECT doc_id, block, shard FROM s")
def document_shards(spark, sf_dir):
    return _packed(spark, sf_dir).select("doc_id", "block", "shard")


@query(_STORE + ", m AS (SELECT source, block, shard, count(*) AS n_rows, sha256(string_agg(doc_id, ',' ORDER BY doc_id)) AS sha FROM s GROUP BY ALL) SELECT source, block, shard, CASE shard % 7 WHEN 3 THEN 'n_rows' WHEN 5 THEN 'sha' ELSE '' END AS field, CASE shard % 7 WHEN 3 THEN 'changed' WHEN 5 THEN 'changed' ELSE 'unexpected' END AS code FROM m WHERE shard % 7 IN (3, 5, 6)")
def store_check(spark, sf_dir):
    """A store's shards against a frozen manifest in which counts and digests were changed and shards left out."""
    m = cut(re_.store_manifest(_packed(spark, sf_dir), ["source", "block", "shard"], "doc_id", "n_chars"))
    k = F.col("shard") % 7
    frozen = m.filter(k != 6).withColumns({"n_rows": F.when(k == 3, F.col("n_rows") + 1).otherwise(F.col("n_rows")), "sha": F.when(k == 5, F.lit("0")).otherwise(F.col("sha"))})
    return re_.gate(m, frozen, ["source", "block", "shard"], ["n_rows", "n_units", "sha"])


@query("SELECT conv_id, CASE WHEN conv_id % 13 = 1 THEN 'unknown' WHEN conv_id % 13 = 2 THEN 'open' WHEN conv_id % 13 = 3 THEN 'repeated' WHEN conv_id % 13 = 4 THEN 'changed' WHEN conv_id % 13 = 5 THEN 'not_terminal' ELSE 'done' END AS state FROM (SELECT DISTINCT conv_id FROM conversations)")
def resume_state(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("request"))
    k = F.col("conv_id") % 13
    requests = c.filter(k != 1).select("conv_id", "request")
    done = c.filter(k != 2).select("conv_id", F.when(k == 4, F.concat("request", F.lit("!"))).otherwise(F.col("request")).alias("request"), F.when(k == 5, "error").otherwise("stop").alias("finish"))
    return re_.resume_state(requests, done.unionByName(done.filter(k == 3)), "conv_id", "request", "finish")


@query("WITH s AS (SELECT doc_id, lang, CASE WHEN length(coalesce(text, '')) < 200 THEN 'too_short' WHEN doc_id % 9 = 0 THEN 'rejected' ELSE 'ok' END AS status FROM documents) SELECT lang, status, CAST(count(*) AS BIGINT) AS n, CAST(min(doc_id) AS BIGINT) AS first_id FROM s GROUP BY ALL")
def pair_sink_report(spark, sf_dir):
    """Finished rows and failures go to a table each, and the report is read from what was written."""
    n = F.length(F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(n < 200, "too_short").when(F.col("doc_id") % 9 == 0, "rejected").otherwise("ok").alias("status"))
    written = cut(d.filter("status = 'ok'")).unionByName(cut(d.filter("status <> 'ok'")))
    return written.groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


# ---- pairs and records -----------------------------------------------------------------------------------------------

@query("SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 1 THEN ['identity'] WHEN 2 THEN ['polarity'] WHEN 3 THEN ['text_hash'] WHEN 4 THEN ['offsets', 'substitution'] WHEN 5 THEN ['overlap', 'controls', 'edit_count', 'substitution'] WHEN 6 THEN ['controls', 'substitution'] WHEN 7 THEN ['edit_count'] WHEN 8 THEN ['length_flag'] ELSE [] END AS issues FROM orders")
def pair_validation(spark, sf_dir):
    """Pairs of an order's text with its true and with another status, faults planted by key."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 12
    head = F.concat(F.lit("order "), "o_orderkey", F.lit(" is "))
    at = F.length(head).cast("long")
    text = lambda s: F.concat(head, s, F.lit(" now"))
    span = lambda a, t, i: F.struct(a.alias("start"), (a + F.length(t)).alias("end"), t.alias("text"), F.lit(i).alias("id"))
    wrong, right = F.lit("lost!"), F.concat(F.lit("st_"), "o_orderstatus")
    spans_h = F.when(k == 4, F.array(span(at + 1, wrong, "c1"))).when(k == 5, F.array(span(at, wrong, "c1"), span(at + 2, F.lit("st!"), "c1"))).when(k == 6, F.array(span(at, wrong, "c2"))).otherwise(F.array(span(at, wrong, "c1")))
    side = lambda label, t, spans, sha, same: F.struct(F.col("o_custkey").alias("origin"), F.lit("status").alias("subtask"), label.alias("label"), t.alias("text"), sha.alias("sha"), F.when((k == 7), 2).otherwise(1).alias("edits"), spans.alias("spans"), same.alias("same_length"))
    h = side(F.when(k == 2, "N").otherwise("H"), text(wrong), spans_h, F.when(k == 3, "x").otherwise(F.sha2(text(wrong), 256)), k == 8)
    n = side(F.lit("N"), text(right), F.array(span(at, right, "c1")), F.sha2(text(right), 256), F.lit(False))
    n = n.withField("origin", F.when(k == 1, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    p = o.select(F.col("o_orderkey").alias("id"), h.alias("h"), n.alias("n"))
    return p.select("id", re_.pair_issues(p).alias("issues"))


@query("""WITH o AS (SELECT o_orderkey AS origin, v.variant, o_custkey FROM orders, (VALUES ('H'), ('N')) v(variant))
SELECT origin, variant, 'missing' AS code, '' AS field FROM o WHERE origin % 19 = 0 AND variant = 'H' UNION ALL SELECT origin, variant, 'repeated', '' FROM o WHERE origin % 23 = 0 AND NOT (origin % 19 = 0 AND variant = 'H')
UNION ALL SELECT origin, variant, 'changed', 'customer' FROM o WHERE origin % 29 = 0 AND NOT (origin % 19 = 0 AND variant = 'H') UNION ALL SELECT -origin, 'H', 'unexpected', '' FROM o WHERE origin % 31 = 0 AND variant = 'H' AND origin > 0""")
def release_gate(spark, sf_dir):
    """Every origin in both variants, once, with its customer as it was."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("origin"), F.explode(F.array(F.lit("H"), F.lit("N"))).alias("variant"), F.col("o_custkey").alias("customer"))
    k = lambda m: F.col("origin") % m == 0
    r = o.filter(~(k(19) & (F.col("variant") == "H"))).withColumn("customer", F.when(k(29), F.col("customer") + 1).otherwise(F.col("customer")))
    extra = o.filter(k(31) & (F.col("variant") == "H") & (F.col("origin") > 0)).withColumn("origin", -F.col("origin"))
    return re_.gate(r.unionByName(r.filter(k(23))).unionByName(extra), o, ["origin", "variant"], ["customer"])


@query("SELECT event_id, CASE event_id % 8 WHEN 1 THEN ['id:missing'] WHEN 2 THEN ['id:type:STRING'] WHEN 3 THEN ['kind:blank:STRING'] WHEN 4 THEN [':syntax'] WHEN 5 THEN ['kind:type:BIGINT', 'value:missing'] ELSE [] END AS issues FROM events")
def typed_records(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 8
    good = F.concat(F.lit('{"id": '), "event_id", F.lit(', "kind": "'), "event_type", F.lit('", "value": 1.5}'))
    j = (
        F.when(k == 1, F.lit('{"kind": "a", "value": 0.5}')).when(k == 2, F.lit('{"id": "7", "kind": "a", "value": 0.5}')).when(k == 3, F.lit('{"id": 7, "kind": "  ", "value": 0.5}'))
        .when(k == 4, F.lit('{"id": 7,')).when(k == 5, F.lit('{"id": 7, "kind": 8, "value": null}')).otherwise(good)
    )
    found = re_.record_issues(j, [("id", "BIGINT"), ("kind", "STRING"), ("value", "DOUBLE")])
    return e.select("event_id", F.transform(found, lambda x: F.concat_ws(":", x["field"], x["code"], x["found"])).alias("issues"))


@query("""WITH t AS (SELECT DISTINCT event_type AS task FROM events), x AS (SELECT event_type AS task, count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS m FROM events GROUP BY 1)
SELECT task, 'k' AS field, CAST(n AS BIGINT) AS n, 'held' AS status FROM x UNION ALL SELECT task, 'extra', CAST(m AS BIGINT), 'unexpected' FROM x WHERE m > 0 UNION ALL SELECT task, 'absent', CAST(0 AS BIGINT), 'missing' FROM t""")
def field_inventory(spark, sf_dir):
    """The fields that each task's records hold, against the fields that its template names."""
    e = table(spark, sf_dir, "events").withColumn("r", F.when(F.col("event_id") % 10 == 0, F.regexp_replace("props", "\\}$", ', "extra": 1}')).otherwise(F.col("props")))
    template = e.select("event_type").distinct().select("event_type", F.array(F.lit("k"), F.lit("absent")).alias("fields"))
    return re_.inventory(e, "event_type", F.col("r"), template)


@query("SELECT o_orderkey AS id, '{\"customer\":' || o_custkey || ',\"priority\":\"' || o_orderpriority || '\"}' AS prompt, false AS leaks FROM orders")
def label_free_prompt(spark, sf_dir):
    """What a detector may see of a record: no label, and no text of one."""
    record = F.struct(F.col("o_custkey").alias("customer"), F.concat(F.lit("label_"), "o_orderstatus").alias("label"), F.col("o_orderpriority").alias("priority"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), record.alias("r"))
    p = o.select("id", F.to_json(F.col("r").dropFields("label")).alias("prompt"), F.col("r.label").alias("label"))
    return p.select("id", "prompt", F.contains("prompt", F.col("label")).alias("leaks"))


@query("SELECT event_type, CAST(count(*) FILTER (value < 10) AS BIGINT) AS low_value, CAST(count(*) FILTER (user_id % 5 = 0) AS BIGINT) AS few_users, CAST(count(*) FILTER (value >= 10 AND user_id % 5 <> 0) AS BIGINT) AS none, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def density_report(spark, sf_dir):
    """Minima that rows miss, named for each row; all rows stay."""
    e = table(spark, sf_dir, "events").withColumn("missed", F.array_compact(F.array(F.when(F.col("value") < 10, F.lit("low_value")), F.when(F.col("user_id") % 5 == 0, F.lit("few_users")))))
    has = lambda n: F.count_if(F.array_contains("missed", n)).alias(n)
    return e.groupBy("event_type").agg(has("low_value"), has("few_users"), F.count_if(F.size("missed") == 0).alias("none"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'accepted' WHEN o_orderkey % 4 = 0 THEN 'rejected' WHEN o_orderkey % 5 = 0 THEN 'prepared' ELSE 'planned' END AS state FROM orders")
def origin_states(spark, sf_dir):
    """The first table that holds an origin says its state; planned ones without any keep theirs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    named = lambda m, s: o.filter(F.col("id") % m == 0).select("id", F.lit(s).alias(s))
    j = o.join(named(3, "accepted"), "id", "left").join(named(4, "rejected"), "id", "left").join(named(5, "prepared"), "id", "left")
    return j.select("id", F.coalesce("accepted", "rejected", "prepared", F.lit("planned")).alias("state"))


# ---- evaluation ------------------------------------------------------------------------------------------------------


def _predicted(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = lambda m, name: [F.concat(F.lit("m"), (F.col("o_custkey") + m) % 3, F.lit("."), k % 2).alias(f"full_{name}"), F.concat(F.lit("m"), (F.col("o_custkey") + m) % 3).alias(f"primary_{name}")]
    bad = k % 11 == 0
    p = [F.when(~bad, F.concat(F.lit("m"), k % 3, F.lit("."), F.col("o_custkey") % 2)).alias("full_prediction"), F.when(~bad, F.concat(F.lit("m"), k % 3)).alias("primary_prediction")]
    rows = o.select(k.alias("id"), F.col("o_orderpriority").alias("grp"), *p, *key(0, "ground_truth"), *key(1, "clean_plan"), *key(0, "executed"))
    moved = F.col("id") % 2 == 0  # for half of the rows the executed plan gives another product
    return ev.compare_predictions(rows.withColumns({c: F.when(moved, F.concat(F.col(c), F.lit("x"))).otherwise(F.col(c)) for c in ("full_executed", "primary_executed")}))


_PREDICTED = """WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS grp, o_orderkey % 11 = 0 AS bad, o_orderkey % 3 = o_custkey % 3 AS same, o_orderkey % 3 = (o_custkey + 1) % 3 AS clean, o_custkey % 2 = o_orderkey % 2 AS tail, o_orderkey % 2 = 0 AS moved FROM orders),
c AS (SELECT *, CASE WHEN bad THEN 'invalid_output' WHEN NOT (same AND tail) THEN 'neither' WHEN moved THEN 'ground_truth_only' ELSE 'ground_truth_and_executed' END AS full_class, CASE WHEN bad THEN 'invalid_output' WHEN NOT same THEN 'neither' WHEN moved THEN 'ground_truth_only' ELSE 'ground_truth_and_executed' END AS primary_class FROM o)"""


@query(_PREDICTED + " SELECT id, full_class, primary_class, NOT bad AND clean AS primary_is_clean_plan FROM c")
def plan_following(spark, sf_dir):
    return _predicted(spark, sf_dir).select("id", "full_class", "primary_class", "primary_is_clean_plan")


@query(_PREDICTED + """, s AS (SELECT grp, count(*) FILTER (grp <> '1-URGENT' AND (grp <> '2-HIGH' OR id % 2 = 1)) AS n, count(*) AS n_expected, count(*) FILTER (NOT bad AND grp <> '1-URGENT' AND (grp <> '2-HIGH' OR id % 2 = 1)) AS n_valid, count(*) FILTER (NOT bad AND same AND tail AND grp <> '1-URGENT' AND (grp <> '2-HIGH' OR id % 2 = 1)) AS hits FROM c GROUP BY grp)
SELECT grp, CAST(n_expected AS BIGINT) AS n_expected, CAST(n AS BIGINT) AS n, CAST(n_valid AS BIGINT) AS n_valid, CAST(hits AS BIGINT) AS full_ground_truth, round(hits / nullif(n, 0), 9) AS full_rate, CASE WHEN n = 0 THEN 'pending' WHEN n < n_expected THEN 'partial' ELSE 'complete' END AS status FROM s""")
def plan_following_summary(spark, sf_dir):
    """Groups of which one has no predictions yet and one has half."""
    p = _predicted(spark, sf_dir)
    expected = p.groupBy("grp").agg(F.count(F.lit(1)).alias("n_expected"))
    some = p.filter((F.col("grp") != "1-URGENT") & ((F.col("grp") != "2-HIGH") | (F.col("id") % 2 == 1)))
    s = ev.following_summary(some, expected, "grp")
    return s.select("grp", "n_expected", "n", "n_valid", "full_ground_truth", F.round("full_ground_truth_rate", 9).alias("full_rate"), "status")


_SCORES = """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey % 3 + 2 AS BIGINT) AS n, CAST(o_orderkey % 4 AS BIGINT) AS s, o_custkey AS c FROM orders),
a AS (SELECT *, list_transform(range(s, s + n), lambda i: -((i * 7 + c) % 13) / 10.0) AS v FROM o), r AS (SELECT id, n, CASE WHEN id % 17 = 0 THEN 'score_missing' WHEN id % 17 = 1 THEN 'tokens_differ' WHEN id % 17 = 2 THEN 'misaligned' END AS issue, list_sum(v) AS total FROM a)"""


def _scored(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    n, s = (k % 3 + 2).cast("int"), (k % 4).cast("int")
    every = F.sequence(F.lit(0), n + s + 1)
    value = lambda i: -((i * 7 + F.col("o_custkey")) % 13) / 10.0
    scores = F.transform(every, lambda i: F.when((k % 17 == 0) & (i == s), F.lit(None)).otherwise(value(i)))
    tokens = F.transform(F.when(k % 17 == 2, F.sequence(F.lit(0), n + s)).otherwise(every), lambda i: i + 100)
    answer = F.transform(F.sequence(s, s + n - 1), lambda i: i + F.when(k % 17 == 1, 101).otherwise(100))
    a = ev.answer_logprob(scores, tokens, s, answer)
    return o.select(k.alias("id"), answer.alias("answer"), a.alias("a")).select("id", "answer", "a.*")


@query(_SCORES + " SELECT id, CAST(n AS INTEGER) AS n, issue, CASE WHEN issue IS NULL THEN round(total, 9) END AS total, CASE WHEN issue IS NULL THEN round(total / n, 9) END AS mean FROM r")
def answer_logprobs(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "n", "issue", F.round("sum", 9).alias("total"), F.round("mean", 9).alias("mean"))


@query(_SCORES + """, g AS (SELECT id, id // 24 AS pair, id % 24 // 12 AS grp, id % 12 AS slot, total, total / n AS mean FROM r WHERE issue IS NULL)
SELECT 'late_minus_early' AS contrast, CAST(count(*) AS BIGINT) AS n, round(avg(t.total - b.total), 9) AS delta_sum, round(avg(t.mean - b.mean), 9) AS delta_mean, CAST(0 AS BIGINT) AS n_answers_differ FROM g b JOIN g t ON t.pair = b.pair AND t.slot = b.slot AND b.grp = 0 AND t.grp = 1""")
def logprob_contrasts(spark, sf_dir):
    """Orders twelve apart have the same answer tokens: the later as treatment, the earlier as baseline."""
    g = _scored(spark, sf_dir).filter("issue IS NULL").select(F.concat_ws("/", F.expr("id div 24"), F.expr("id % 12")).alias("pair"), F.expr("id % 24 div 12").alias("grp"), "sum", "mean", "answer")
    c = ev.contrasts(g, "pair", "grp", [("late_minus_early", 0, 1)])
    return c.select("contrast", "n", F.round("delta_sum", 9).alias("delta_sum"), F.round("delta_mean", 9).alias("delta_mean"), "n_answers_differ")


_CAND = "WITH c AS (SELECT l_partkey AS record, CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS candidate, l_returnflag || l_linestatus AS bucket, CAST(l_quantity AS BIGINT) % 10 AS sim, CASE l_linenumber % 4 WHEN 0 THEN 'fragment' WHEN 1 THEN 'anchor' WHEN 2 THEN 'combined' ELSE 'delete' END AS family FROM lineitem)"


def _candidates(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("record"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long").alias("candidate"), F.concat("l_returnflag", "l_linestatus").alias("bucket"),
        (F.col("l_quantity").cast("long") % 10).alias("sim"), F.when(n == 0, "fragment").when(n == 1, "anchor").when(n == 2, "combined").otherwise("delete").alias("family"),
    )


@query(_CAND + ", t AS (SELECT *, row_number() OVER (PARTITION BY record, bucket ORDER BY candidate) AS turn FROM c), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY record ORDER BY turn, bucket) AS INTEGER) AS place FROM t) SELECT record, candidate, bucket, place FROM p WHERE place <= 6")
def balanced_candidates(spark, sf_dir):
    return ev.balanced(_candidates(spark, sf_dir), "record", "bucket", [F.col("candidate")], [F.col("bucket")], 6).select("record", "candidate", "bucket", "place")


@query(_CAND + " SELECT record, min_by(candidate, (sim, candidate)) AS severe, min_by(candidate, (sha256('pick:' || record || ':' || candidate), candidate)) AS standard FROM c GROUP BY record")
def candidate_choice(spark, sf_dir):
    return ev.chosen(_candidates(spark, sf_dir), "record", "candidate", "sim", "pick")


@query("WITH RECURSIVE " + _CAND[5:] + """, t AS (SELECT record, count(*) FILTER (family = 'fragment') AS nf, count(*) FILTER (family = 'anchor') AS na, count(*) FILTER (family = 'combined') AS nc, count(*) FILTER (family = 'delete') AS nd FROM c GROUP BY record),
s AS (SELECT record, nf, na, nc, nd, 0 AS place, CAST('' AS VARCHAR) AS family FROM t
UNION ALL SELECT record, nf - CASE WHEN f = 'fragment' THEN 1 ELSE 0 END, na - CASE WHEN f = 'anchor' THEN 1 ELSE 0 END, nc - CASE WHEN f = 'combined' THEN 1 ELSE 0 END, nd - CASE WHEN f = 'delete' THEN 1 ELSE 0 END, place + 1, f
FROM (SELECT *, CASE WHEN place % 4 < 2 AND nf > 0 THEN 'fragment' WHEN place % 4 = 2 AND na > 0 THEN 'anchor' WHEN nc > 0 THEN 'combined' WHEN nf > 0 THEN 'fragment' WHEN na > 0 THEN 'anchor' WHEN nd > 0 THEN 'delete' END AS f FROM s WHERE place < 24) x WHERE f IS NOT NULL),
q AS (SELECT record, place, family, row_number() OVER (PARTITION BY record, family ORDER BY place) AS r FROM s WHERE place > 0), k AS (SELECT record, family, candidate, row_number() OVER (PARTITION BY record, family ORDER BY candidate) AS r FROM c)
SELECT record, place, family, candidate FROM q JOIN k USING (record, family, r)""")
def family_quota(spark, sf_dir):
    return ev.family_quota(_candidates(spark, sf_dir), "record", "family", "candidate", 24)


@query("""WITH f AS (SELECT l_orderkey AS record, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, (1 << CAST(l_suppkey % 9 AS INTEGER)) | (1 << CAST(l_partkey % 9 AS INTEGER)) AS m FROM lineitem),
n AS (SELECT record, count(*) AS n FROM f GROUP BY record), s AS (SELECT record, n, unnest(range(1, CAST(1 << n AS BIGINT))) AS s FROM n),
g AS (SELECT s.record, s.s, count(*) AS k FROM s JOIN f ON f.record = s.record AND (s.s >> (f.i - 1)) & 1 = 1 GROUP BY ALL HAVING sum(bit_count(m)) = bit_count(bit_or(m))) SELECT n.record, CAST(n.n AS INTEGER) AS n_sets, CAST(max(k) AS INTEGER) AS most FROM n JOIN g ON g.record = n.record GROUP BY ALL""")
def footprint_packing(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.array(F.col("l_suppkey") % 9, F.col("l_partkey") % 9).alias("elements"))
    return ev.footprint_packing(l, "record", "elements")


# ---- texts -----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 6 <> 1 THEN CAST(l_quantity AS BIGINT) END AS quantity, CASE WHEN l_orderkey % 6 <> 1 THEN CAST(l_linenumber AS BIGINT) - 4 END AS delta, CASE WHEN l_orderkey % 6 <> 1 THEN l_returnflag || l_linestatus END AS flag FROM lineitem")
def template_contract(spark, sf_dir):
    """A template with an int, a signed and a text field: rendered, parsed back; a text with a number written otherwise isn't it."""
    template = 'take(quantity={quantity:int}, delta={delta:signed}, flag="{flag:text}")'
    l = table(spark, sf_dir, "lineitem")
    text = dr.rendered(template, {"quantity": _long("l_quantity"), "delta": _long("l_linenumber") - 4, "flag": F.concat("l_returnflag", "l_linestatus")})
    text = F.when(F.col("l_orderkey") % 6 == 1, F.regexp_replace(text, "quantity=", "quantity=0")).otherwise(text)
    p = l.select("l_orderkey", "l_linenumber", dr.parsed(text, template).alias("p"))
    return p.select("l_orderkey", "l_linenumber", "p.quantity", "p.delta", "p.flag")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'absent' WHEN o_orderkey % 4 = 1 THEN 'ambiguous' WHEN o_orderkey % 4 = 2 THEN 'no_op' ELSE 'ok' END AS issue, CASE WHEN o_orderkey % 4 = 3 THEN CAST(length('key ' || o_orderkey || ' for ') AS BIGINT) ELSE -1 END AS start FROM orders")
def anchored_patches(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    text = F.concat(F.lit("key "), "o_orderkey", F.lit(" for <"), "o_orderpriority", F.lit("> aaa"))
    old = F.when(k == 0, F.lit("nowhere")).when(k == 1, F.lit("aa")).otherwise(F.concat(F.lit("<"), "o_orderpriority", F.lit(">")))
    p = o.select(F.col("o_orderkey").alias("id"), dr.anchored(text, F.array(F.struct(old.alias("old"), F.when(k == 2, old).otherwise(F.lit("X")).alias("new"))))[0].alias("p"))
    return p.select("id", F.coalesce("p.issue", F.lit("ok")).alias("issue"), F.coalesce("p.start", F.lit(-1)).alias("start"))


@query("SELECT o_orderkey AS id, 'Step 1: ship ' || o_orderstatus || chr(10) || chr(10) || 'Step 2: take ' || o_custkey || chr(10) || chr(10) || 'Step 3: sort ' || o_orderpriority AS moved, true AS undone FROM orders")
def section_permutation(spark, sf_dir):
    steps = [F.concat(F.lit("take "), "o_custkey"), F.concat(F.lit("sort "), "o_orderpriority"), F.concat(F.lit("ship "), "o_orderstatus")]
    text = F.concat_ws("\n\n", *[F.concat(F.lit(f"Step {i + 1}: "), s) for i, s in enumerate(steps)])
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("t"), F.array(F.lit(3), F.lit(1), F.lit(2)).alias("order"))
    o = o.withColumn("moved", dr.permuted_sections(F.col("t"), F.col("order")))
    return o.select("id", "moved", (dr.permuted_sections(F.col("moved"), dr.inverse_order(F.col("order"))) == F.col("t")).alias("undone"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN a <= 4 THEN a WHEN a >= 9 AND a + 2 <= 12 THEN a - 3 WHEN a >= 12 THEN a - 1 END AS back FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 30 AS a FROM lineitem)")
def interval_mapped_back(spark, sf_dir):
    """Ranges of two characters of a patched text in the text before: [6, 6) had 3 put in, [9, 11) was taken out."""
    a = F.col("l_quantity").cast("long") % 30
    patches = F.expr("array(named_struct('start', 6L, 'end', 6L, 'text', 'abc'), named_struct('start', 9L, 'end', 11L, 'text', ''))")
    back = dr.mapped_back(a, a + 2, patches)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", back["start"].alias("back"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(t, '[0-9]+')) AS BIGINT) AS n, CAST(length(regexp_replace(t, '[^0-9]', '', 'g')) AS BIGINT) AS covered, CASE WHEN regexp_matches(t, '[0-9]') THEN CAST(length(regexp_extract(t, '(?s)^([^0-9]*)', 1)) AS BIGINT) ELSE -1 END AS first_start FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def number_spans(spark, sf_dir):
    """Where numbers stand in whole texts, in code points."""
    d = table(spark, sf_dir, "documents").select("doc_id", dr.match_spans(F.coalesce("text", F.lit("")), "[0-9]+").alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("covered"), F.coalesce(F.get("s", F.lit(0))["start"], F.lit(-1)).alias("first_start"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 'fail' WHEN l_orderkey % 5 = 1 THEN 'missing' ELSE 'pass' END AS heavy, CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN l_orderkey % 5 = 1 THEN 'missing' ELSE 'pass' END AS rings FROM lineitem")
def formal_claims(spark, sf_dir):
    q, n, k = _long("l_quantity"), _long("l_linenumber"), F.col("l_orderkey") % 5
    claim = F.concat(F.lit("heavy atoms: "), q + F.when(k == 0, 1).otherwise(0), F.lit("; rings = "), n, F.lit("."))
    text = F.when((k == 1) & (n == 1), F.lit("rings = 5")).when(k == 1, F.lit("nothing to say")).otherwise(claim)
    r = dr.claim_results(text, {"heavy": "heavy atoms: ([0-9]+)", "rings": "rings = ([0-9]+)"}, {"heavy": q, "rings": F.when(n > 1, n)})
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"))
    status = lambda name: F.filter("r", lambda x: x["name"] == name)[0]["status"].alias(name)
    return l.select("l_orderkey", "l_linenumber", status("heavy"), status("rings"))


@query("SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN ['cue', 'answer_token'] WHEN 1 THEN ['answer_token'] WHEN 2 THEN ['product_clause'] WHEN 3 THEN ['answer_token'] ELSE [] END AS why, CASE WHEN p_partkey % 6 IN (0, 1, 2, 3) THEN 'a line' || chr(10) || 'another' ELSE 'a line' || chr(10) || 'take C' || p_size || 'O and go' || chr(10) || 'another' END AS kept FROM part")
def answer_leaks(spark, sf_dir):
    k, smiles = F.col("p_partkey") % 6, F.concat(F.lit("C"), "p_size", F.lit("N"))
    line = (
        F.when(k == 0, F.concat(F.lit("the answer is "), smiles, F.lit("."))).when(k == 1, F.concat(F.lit("it gives (`"), smiles, F.lit("`), then")))
        .when(k == 2, F.lit("final product: CCO")).when(k == 3, F.concat(F.lit('see "<('), smiles, F.lit(')>";'))).otherwise(F.concat(F.lit("take C"), "p_size", F.lit("O and go")))
    )
    text = F.concat(F.lit("a line\n"), line, F.lit("\nanother"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), dr.answer_leaks(text, F.array(smiles)).alias("why"), dr.without_leaks(text, F.array(smiles)).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 5 IN (0, 2) THEN 1 ELSE 0 END AS INTEGER) AS n_false FROM lineitem")
def enumeration_audit(spark, sf_dir):
    """Enumerations of a line's numbers: right ones, false ones, ones with words, and one that can't be counted."""
    q, n, k = _long("l_quantity"), _long("l_linenumber"), F.col("l_orderkey") % 5
    word = F.element_at(F.array(*[F.lit(w) for w in dr.NUMBER_WORDS]), (n % 19 + 2).cast("int"))
    text = (
        F.when(k == 0, F.concat(F.lit("It has "), q, F.lit(" carbons, "), n, F.lit(" oxygens, totaling "), q + n + 1, F.lit(" heavy atoms.")))
        .when(k == 1, F.concat(F.lit("It has "), q, F.lit(" carbons and "), n, F.lit(" oxygens = "), q + n, F.lit(" heavy atoms.")))
        .when(k == 2, F.concat(q + n % 19, F.lit(" heavy atoms ("), q, F.lit(" carbons, "), word, F.lit(" nitrogens, one oxygen)")))
        .when(k == 3, F.concat(F.lit("Heavy atoms: "), q + n % 19 + 2, F.lit(" ("), q, F.lit(" carbons, "), word, F.lit(" nitrogens, methyl oxygen)")))
        .otherwise(F.concat(F.lit("Heavy atoms: "), q, F.lit(" (some carbons, fused rings)")))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.size(dr.enumeration_violations(text)).alias("n_false"))


_RANGES = "WITH r AS (SELECT doc_id, doc_id // 500 AS block, coalesce(text, '') AS t, coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY doc_id // 500 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM documents), p AS (SELECT event_id, event_id % (SELECT count(DISTINCT doc_id // 500) FROM documents) AS block, CAST((event_id * 7919) % 400000 AS BIGINT) AS spot FROM events)"


@query(_RANGES + ", j AS (SELECT event_id, doc_id, t, spot - a AS i FROM p JOIN r ON p.block = r.block AND spot >= a AND spot < a + length(t) + 1) SELECT event_id, doc_id, CAST(greatest(i - 160, 0) AS BIGINT) AS start, CAST(least(i + 160, length(t)) AS BIGINT) AS \"end\", sha256(substr(t, CAST(greatest(i - 160, 0) + 1 AS INTEGER), CAST(least(i + 160, length(t)) - greatest(i - 160, 0) AS INTEGER))) AS sha FROM j")
def context_windows(spark, sf_dir):
    """Rows of blocks of documents looked up in the documents' ranges, with the text around them; only documents that are hit are joined."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 500").alias("block"), F.coalesce("text", F.lit("")).alias("t"))
    w = Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)  # a block has 500 documents
    n = d.select("doc_id", "block", (F.length("t") + 1).alias("n"))
    r = n.withColumn("a", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long")).withColumn("b", F.col("a") + F.col("n"))
    blocks = d.select("block").distinct().count()
    p = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % blocks).alias("block"), ((F.col("event_id") * 7919) % 400_000).alias("at"))
    hit = dr.range_lookup(p, r, "block", "at", "a", "b", 4096).select("event_id", "doc_id", (F.col("at") - F.col("a")).alias("i"))
    c = hit.join(d.select("doc_id", "t"), "doc_id").select("event_id", "doc_id", dr.context(F.col("t"), F.col("i"), 160).alias("c"))
    return c.select("event_id", "doc_id", "c.start", "c.end", F.sha2("c.text", 256).alias("sha"))
