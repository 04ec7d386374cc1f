import duckdb
import pytest

import corpus_pipeline
from tests.llm import tables
from tests.llm.test_decontamination_toxicity import LONG, corpus, label_table
from tests.llm.test_mixing_sharding import check_shards
from tickerloom.llm import catalog


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows, labels = corpus(spark, 240)
    clean = [(i, t, f"s{i % 3}") for i, t, _ in rows]
    copies = [(1000 + i, clean[1][1].upper(), "s0") for i in range(30)]
    leaks = [(2000 + i, clean[2][1] + f" v{i} u{i}. " + LONG, "s1") for i in range(5)]
    df = tables.documents(spark, clean + copies + leaks + [(3000, None, None), (3001, "", "s9"), (3002, "", "s9"), (None, "alone here", None)], clash=False)
    df.write.parquet(f"{at}/documents.parquet")
    label_table(spark, labels).select("doc_id", "quality", "toxic").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, LONG)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "sharding":
            assert tables.schema_of(out) == tables.schema_of(docs)
        held.append(out.collect())
        docs = spark.createDataFrame(held[-1], out.schema)
    start, clean, distinct, left, mixed, shards = held
    toxic = {i for i in range(240) if i % 4 == 0}
    gone = {x.doc_id for x in start} - {x.doc_id for x in clean}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 2
    ids = [x.doc_id for x in distinct]
    assert len(ids) == len(set(ids)) and not set(range(1000, 1030)) & set(ids) and 1 in ids and None in ids
    assert {x.text for x in distinct if not (x.text or "").strip()} == {None} and sum(not x.text for x in distinct) == 1
    assert {x.doc_id for x in distinct} - {x.doc_id for x in left} == {i for i in range(2000, 2005)} & set(ids) != set()
    assert set(mixed) <= set(left) and len(mixed) > len(left)
    assert sorted(map(str, (tuple(x) for x in mixed))) == sorted(str(tuple(x)[:5]) for x in shards)
    check_shards(shards, 8)


def test_run_equals_its_stages(spark, small):
    whole = corpus_pipeline.run(spark, small)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(whole.columns) and whole.count() > 200


def test_registered_queries_return_their_columns(spark, folder):
    want = {"op1_mixing": "doc_id size source_size target taken", "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op3_url_rules": "page_id host path rule verdict",
            "op4_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op5_benchmark_decontamination": "doc_id item_id matched_tokens item_tokens changed_slots",
            "op6_token_counts": "doc_id n_tokens", "op7_substring_dedup": "doc_id word words class_id kept", "op8_toxicity": "doc_id held_out score predicted",
            "op9_exact_top_k": "query_id rank vec_id score", "op10_simhash_near_duplicates": "doc_id fingerprint component_id"}
    assert set(catalog.QUERIES) == set(want)
    rows = duckdb.sql(f"SELECT count(*) FROM '{folder}/documents.parquet'").fetchall()[0][0]
    for name in ("op2_sharding", "op6_token_counts", "op8_toxicity", "op10_simhash_near_duplicates"):
        got = catalog.QUERIES[name](spark, folder)
        assert got.columns == want[name].split() and got.count() == rows
    for name in ("op5_benchmark_decontamination", "op7_substring_dedup"):
        assert catalog.QUERIES[name](spark, folder).columns == want[name].split()
