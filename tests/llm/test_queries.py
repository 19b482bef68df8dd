"""The registered corpus queries and the pipeline on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from fintally.llm import common, piece_model
from fintally.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": ["page_id", "url", "text", "n_chars"],
    "op2_": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op3_": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op4_": ["doc_id", "held_out", "score", "predicted"],
    "op7_": ["doc_id", "fingerprint", "component_id"],
    "op8_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op11_": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op12_": ["item_id", "rank", "doc_id", "score"],
    "op13_": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
}


def count(table):
    return duckdb.sql(f"SELECT count(*) FROM '{SF}/{table}.parquet'").fetchall()[0][0]


def test_all_operators_and_the_pipeline_are_registered():
    names = E.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_a_row_for_each_input_row(spark, name):
    out = QUERIES[name](spark, SF)
    for prefix, columns in COLUMNS.items():
        if name.startswith(prefix):
            assert out.columns[:len(columns)] == columns
    table, each = {"op1_": ("pages", 1), "op11_": ("embeddings", 1), "op12_": ("benchmark", 10)}.get(name[:name.index("_") + 1], ("documents", 1))
    assert len(out.collect()) == each * count(table)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline_stages_match_plain_python(spark):
    """Each stage against what plain Python makes of its own input."""
    from test_simhash import brute_components
    from fintally.llm import decontaminate, quality_mil

    raw = common.table(spark, SF, "documents")
    docs, columns = raw, raw.columns
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        outs.append(common.written(stage(spark, docs, SF), "t"))
        if len(outs) < len(corpus_pipeline.STAGES):
            assert outs[-1].columns == columns, name
            docs = outs[-1]
    q, e, n, b, t = [o.collect() for o in outs]
    scores = {r["doc_id"]: r["predicted"] for r in quality_mil.quality_scores(raw, common.table(spark, SF, "labels")).collect()}
    assert {r["doc_id"] for r in q} == {i for i, p in scores.items() if p} and len(q) > 100
    latest = {}
    for r in q:
        latest[r["text"] or ""] = max(r["doc_id"], latest.get(r["text"] or "", r["doc_id"]))
    assert {r["doc_id"] for r in e} == set(latest.values()) and len(e) == len(latest)
    assert {r["doc_id"] for r in n} == {k[2] for k in brute_components([(r["doc_id"], r["text"]) for r in e])}
    items = [f" {p} " for r in common.table(spark, SF, "benchmark").collect() if (p := decontaminate.plain(r["text"]))]
    held = {r["doc_id"] for r in n for plain in [f" {decontaminate.plain(r['text'] or '')} "] if any(item in plain for item in items)}
    assert {r["doc_id"] for r in b} <= {r["doc_id"] for r in n} - held and len(b) >= len(n) - len(held) - 3
    sp = piece_model.processor(piece_model.model_bytes())
    assert {r["doc_id"]: r["n_tokens"] for r in t} == {r["doc_id"]: len(sp.encode(r["text"] or "")) for r in b} and all(r["decoded"] for r in t)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, t))
