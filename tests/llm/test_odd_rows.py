"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every registered query."""
import pytest

import corpus_pipeline
from tests.llm.conftest import COPY, LONG, rows_of
from tidecast.llm.catalog import QUERIES

PER_DOCUMENT = [q for q in QUERIES if q.split("_")[0] in ("op1", "op2", "op4", "op6", "op8", "op9", "op10", "op11")]


def found(df, doc_id):
    return [r for r in df if r["doc_id"] == doc_id]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, odd, name):
    got = QUERIES[name](spark, odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in rows_of(spark, odd, "documents"))
    assert len({tuple(r) for r in found(got, 5)}) == 1, "repeated rows get one result"
    defined = [c for c in got[0].asDict() if c in ("n_bytes", "n_tokens", "over_limit", "kept", "base_failed", "lang_pred", "score", "predicted", "held_out",
                                                    "n_shingles", "base_score", "taken", "size", "n_words", "n_base", "labels")]
    assert all(r[c] is not None for r in got for c in defined)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    run = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    assert run(spark, empty).count() == (1 if name.startswith("op3") else 0)  # the planted conversation


def test_defined_values(spark, odd):
    counts = QUERIES["op1_token_counts"](spark, odd).collect()
    assert [found(counts, k)[0]["n_tokens"] for k in (1, 2)] == [0, 0] and found(counts, 4)[0]["n_bytes"] == len(LONG)
    langs = QUERIES["op4_language_crf"](spark, odd).collect()
    assert {found(langs, k)[0]["lang_pred"] for k in (1, 2, 3, 8)} == {"und"} and all(0 <= r["score"] <= 1 for r in langs)
    sets = QUERIES["op8_jaccard_join"](spark, odd).collect()
    assert {found(sets, k)[0]["component_id"] for k in (5, 6, 7)} == {5} and found(sets, 10)[0]["component_id"] == 9
    assert all(found(sets, k)[0]["component_id"] == k for k in (1, 2, 3))


def test_items_in_odd_documents(spark, odd):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontaminate"](spark, odd).collect()}
    assert {(d, i) for d in (5, 6, 7) for i in (0, 1)} <= got and not {i for _, i in got} & {2, 3, 4}
    assert {d for d, _ in got} == {5, 6, 7}


def test_pages_without_ids(spark, odd):
    got = QUERIES["op5_warc_normaliser"](spark, odd).collect()
    assert len(got) == len(rows_of(spark, odd, "pages"))
    same = [(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 4]
    assert sorted(same) == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]


def test_pipeline_keeps_distinct_clean_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{odd}/documents.parquet")
        out = stage(spark, docs, odd)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        kept = [r["text"] for r in out.collect()]
        assert (kept.count(COPY) == 1) if name == "near-duplicates" else LONG in kept, name
