"""Registered queries and the pipeline over small tables; contracts, SQL twins, and stages against brute force."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cartlens.llm import bpe, queries
from samples import DOC, save  # noqa: F401  fixture
from test_dedup import brute_groups, brute_windows

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op3_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op6_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_decontaminate": ["doc_id", "item_id", "score"],
    "op10_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_gives_a_row_for_every_row(spark, name, texts):
    rows = entry.queries()[name](spark, FOLDER).collect()
    assert set(COLUMNS[name]) <= set(rows[0].asDict())
    if name not in ("op5_url_filter", "op9_decontaminate", "op11_prefix_trie"):
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_id = {r[0]: r for r in rows}
    if name == "op2_jaccard_join":
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id.items()} == brute_groups(list(texts.items()))
    elif name == "op3_substring_dedup":
        want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in brute_windows(list(texts.items()), 20).items()}
        assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in by_id.items()} == want
    elif name == "op7_byte_bpe":
        encoding = bpe.encoder(queries.rank_file(), queries.split_pattern())
        for i, t in texts.items():
            ids = encoding.encode_ordinary(t or "")
            want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
            assert (by_id[i]["n_tokens"], by_id[i]["ids_sha256"], by_id[i]["decoded_sha256"]) == want
    elif name in ("op1_toxicity", "op8_language"):
        modulus, remainder = (4, 2) if name == "op1_toxicity" else (3, 1)
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == remainder) and 0 <= r["score"] <= 1 for i, r in by_id.items())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall())
    rows = [r for r in entry.queries()["op8_language"](spark, folder).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) / len(rows) > 0.99
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    rows = [r for r in entry.queries()["op1_toxicity"](spark, folder).collect() if r["held_out"] and r["doc_id"] in toxic]
    hits = sum(r["predicted"] and toxic[r["doc_id"]] for r in rows)
    assert hits / sum(toxic[r["doc_id"]] for r in rows) > 0.85 and hits / sum(r["predicted"] for r in rows) > 0.75


@pytest.mark.parametrize("name,table", [("op5_url_filter", "pages"), ("op3_substring_dedup", "documents")])
def test_query_equals_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, FOLDER).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pipeline_stages(spark, save):
    """Each stage on its own input, then all of them, over a table with a case for every decision."""
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{FOLDER}/documents.parquet'").fetchall())
    rows = [(i, text[i], lang[i], "s", len(text[i])) for i in sorted(text)[:120]]
    item = duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    long = max((r for r in rows if r[2] == "en"), key=lambda r: len(r[1]))
    rows += [(9000, long[1], "en", "copy", 1), (9001, None, None, None, None), (9002, "", "en", None, 0), (9003, "12 34 !!", "en", None, 8),
             (9004, long[1][:300] + " " + item + " " + long[1][300:600], "en", None, 1), (9005, long[1][600:1200] + " mail q.1@w.com or r [at] t dot org", "en", None, 1),
             (None, long[1][1200:1500], "en", None, 1), (9005, long[1][600:1200] + " mail q.1@w.com or r [at] t dot org", "en", None, 1)]
    folder = save(documents=spark.createDataFrame(rows, DOC), benchmark=spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        if name != "tokens":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        after = [(r["doc_id"], r["text"] if name != "tokens" else r["decoded_sha256"]) for r in out.collect()]
        seen[name] = before, after
        docs = spark.createDataFrame(out.collect(), out.schema)
    before, after = seen["language"]
    assert {i for i, _ in before} - {i for i, _ in after} == {9001, 9002, 9003}
    before, after = seen["near_duplicates"]
    groups = brute_groups(sorted({(i, t) for i, t in before if i is not None}))
    assert sorted(i for i, _ in after if i is not None) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert None in [i for i, _ in after] and 9000 not in dict(after)
    before, after = seen["contamination"]
    gone = {i for i, _ in before} - {i for i, _ in after}
    assert 9004 in gone and len(gone) < 10
    before, after = seen["personal_data"]
    assert dict(after)[9005].endswith(" mail [EMAIL] or [EMAIL]") and len(before) == len(after)
    before, after = seen["tokens"]
    assert sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in before) == sorted((str(i), h) for i, h in after)
    final = corpus_pipeline.run(spark, folder)
    assert sorted(str(r["doc_id"]) for r in final.collect()) == sorted(str(i) for i, _ in after)


def test_pipeline_of_nothing(spark, save):
    folder = save(documents=spark.createDataFrame([], DOC), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0
