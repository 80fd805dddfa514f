"""The stages against brute force over their own input."""
from collections import Counter

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.conftest import brute_components
from tidecast.llm.catalog import QUERIES


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SMALL)
        after = Counter(r["doc_id"] for r in out.collect())
        if name == "near-duplicates":
            parts = brute_components({r.doc_id: r.text for r in before})
            assert after == Counter(i for i in parts if parts[i][1] == i)
        elif name == "toxicity":
            scored = QUERIES["op6_toxicity"](spark, SMALL).collect()
            assert after == Counter(r.doc_id for r in scored if not r.predicted)
        elif name == "mixing":
            assert after == Counter(r.doc_id for r in before)
        else:
            assert set(after) <= {r.doc_id for r in before} and len(after) > 0.8 * len(before)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()
