"""Every query against its DuckDB statement on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return [plain(x) for x in v]
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return round(v, 8)
    return v.item() if hasattr(v, "item") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_word_tokens_reads_whole_texts(spark, duck):
    got = {r.doc_id: (r.n_tokens, r.n_covered) for r in catalog.queries()["word_tokens"](spark, SF).collect()}
    sql = catalog.oracle_sql()["word_tokens"]
    assert got == {r[0]: r[1:] for r in duck.execute(sql).fetchall()}


def test_round_robin_orders_all_documents(spark, tmp_path):
    langs = ["en"] * 40 + ["de"] * 3 + [None] * 2 + ["fr"] * 30
    spark.createDataFrame([(i, x) for i, x in enumerate(langs)], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(sum(x == y for y in langs[: i + 1]), x is None, x or "", i) for i, x in enumerate(langs)]
    want = [(i, turn, place) for place, (turn, _, _, i) in enumerate(sorted(turns), 1)]
    got = [(r.doc_id, r.turn, r.place) for r in catalog.queries()["round_robin_order"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def brute_cover(rows):
    """Per order: characters covered by its spans, and the labels of its tokens of four characters."""
    spans, cover, labels = {}, {}, {}
    for order, line, quantity in rows:
        spans.setdefault(order, []).append((f"r{line}", range(quantity, quantity + 1 + line * 3)))
    for order, own in spans.items():
        cover[order] = len({c for _, r in own for c in r})
        for i in range(16):
            token = set(range(4 * i, 4 * i + 4))
            hit = sorted(name for name, r in own if token & set(r))
            labels[order, i] = hit + ["unchanged"] * (not token <= {c for _, r in own for c in r})
    return cover, {k: sorted(v) for k, v in labels.items()}


def test_spans_of_all_orders(spark, tmp_path):
    rows = [(o, n, (o * 7 + n * 11) % 50 + 1) for o in (1, 3000, 3001, 149999) for n in range(1, 5)]
    spark.createDataFrame([(o, n, float(q)) for o, n, q in rows], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    cover, labels = brute_cover(rows)
    assert {r.doc: r.covered for r in catalog.queries()["span_union_coverage"](spark, str(tmp_path)).collect()} == cover
    assert {(r["doc"], r["index"]): r["labels"] for r in catalog.queries()["token_label_join"](spark, str(tmp_path)).collect()} == labels


def test_donors_of_all_orders(spark, tmp_path):
    rows = [(k, (k * 13) % 5 if k % 3 else 4, "ab"[k % 2]) for k in [*range(12), 2000, *range(2001, 2030), 149999]]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for k, owner, stratum in rows:
        own = sorted(x for x in rows if x[2] == stratum)
        at = own.index((k, owner, stratum))
        want[k] = next(x[0] for x in own[at + 1 :] + own[:at] if x[1] != owner)
    assert {r["item"]: r["donor"] for r in catalog.queries()["donor_circular"](spark, str(tmp_path)).collect()} == want


def test_topological_order_of_all_orders(spark, tmp_path):
    rows = [(k, 10 * k + n, n) for k in (1, 2000, 2001, 149999) for n in (1, 2, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["record"], r["place"]): r["node"] for r in catalog.queries()["topological_order"](spark, str(tmp_path)).collect()}
    assert got == {(k, i): n for k in (1, 2000, 2001, 149999) for i, n in enumerate(["s1", "s2", "s3", "t1", "t2", "t3"])}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("searched", [7, 512])
def test_nearest_searches_every_twentieth_vector(spark, duck, monkeypatch, searched):
    from tessera.plans import vector_queries

    monkeypatch.setattr(vector_queries, "_SEARCHED", searched)
    got = {r.vec_id: (r.other, r.sim) for r in catalog.queries()["nearest_to_target"](spark, SF).collect()}
    sql = catalog.oracle_sql()["nearest_to_target"]
    want = {r[0]: r[1:] for r in duck.execute(sql).fetchall()}
    assert got == want and len(got) == 25
