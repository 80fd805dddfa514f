"""What bounds memory and work must not change results, and work must not grow with the square of a group."""
import random
from pathlib import Path

import pytest

from tests.conftest import SMALL
from tests.llm.conftest import brute_components, by_id
from tidecast.llm import bloom_lm, common, prefix_join


@pytest.mark.parametrize("capacity", [60_000, 0])
def test_ngrams_that_the_filter_does_not_hold(spark, monkeypatch, capacity):
    want = by_id(bloom_lm.op9_bloom_lm(spark, SMALL))
    monkeypatch.setattr(bloom_lm, "CAPACITY", capacity)
    got = by_id(bloom_lm.op9_bloom_lm(spark, SMALL))
    assert want.keys() == got.keys()
    for k, r in want.items():
        assert got[k].score == pytest.approx(r.score, rel=1e-6) and got[k].base_score == pytest.approx(r.base_score, rel=1e-9)


@pytest.mark.parametrize("bucket_bytes", [1 << 12, 1 << 27])
def test_joined_counts_travel_packed(spark, monkeypatch, bucket_bytes):
    paths, keep = [], bloom_lm.stored

    def kept(df, name):
        out = keep(df, name)
        paths.extend({Path(f.removeprefix("file:")).parent for f in out.inputFiles()} if name == "lm-scores" else ())
        return out

    want = by_id(bloom_lm.op9_bloom_lm(spark, SMALL))
    monkeypatch.setattr(bloom_lm, "CAPACITY", 0)
    monkeypatch.setattr(bloom_lm, "BUCKET_BYTES", bucket_bytes, raising=False)
    monkeypatch.setattr(bloom_lm, "stored", kept)
    df = bloom_lm.op9_bloom_lm(spark, SMALL)
    got = by_id(df)
    assert want.keys() == got.keys()
    for k, r in want.items():
        assert got[k].n_known == r.n_known and got[k].score == pytest.approx(r.score, rel=1e-6) and got[k].base_score == pytest.approx(r.base_score, rel=1e-9)
    size = sum(file.stat().st_size for folder in paths for file in folder.glob("*.parquet"))
    assert size < 8 * sum(r.n_tokens for r in got.values())  # all tokens are joined: 5.2 to 5.7 bytes a token; 12.7 with a struct for each token


def near_copies(members, words=150, most_edits=14, seed=5):
    """Copies of one text with words replaced by words of their own: some link with others, many do not."""
    draw = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    out = {}
    for i in range(members):
        text = list(base)
        for k in draw.sample(range(words), draw.randint(1, most_edits)):
            text[k] = f"x{i}y{k}"
        out[i] = " ".join(text)
    return out


def test_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    texts, tested = near_copies(800), []
    keep = prefix_join.verified
    monkeypatch.setattr(prefix_join, "verified", lambda pairs, docs: tested.append(pairs.count()) or keep(pairs, docs))
    got = by_id(prefix_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_components(texts)
    assert sum(tested) < 16 * len(texts)  # 7195; 224102 with late shingles counted in prefixes


def test_a_worker_keeps_one_object():
    first = common.worker_cache("test_first", object)
    assert common.worker_cache("test_first", object) is first
    common.worker_cache("test_second", object)
    assert common.worker_cache("test_first", object) is not first
    common.drop_worker_cache()
