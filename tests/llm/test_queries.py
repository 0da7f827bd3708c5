"""The registered queries: SQL where it exists, names of the contract."""

import duckdb

from riskpanel.llm import queries


def test_sql(spark, sf_dir):
    duck = duckdb.connect()
    for name in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in queries.ORACLE.items():
        want = duck.execute(sql).fetchdf()
        got = queries.QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
        key = list(want.columns)
        assert got.sort_values(key).reset_index(drop=True).astype(str).equals(want.sort_values(key).reset_index(drop=True).astype(str)), name


def test_contract_columns(spark, sf_dir):
    columns = {
        "op1_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op2_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
        "op3_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
        "op4_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
        "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
        "op6_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
        "op8_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op9_decontaminate": {"doc_id", "item_id"},
        "op11_html_extraction": {"page_id", "url", "text", "n_chars"},
        "op12_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
        "op13_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    }
    for name, wanted in columns.items():
        assert wanted <= set(queries.QUERIES[name](spark, sf_dir).columns), name
