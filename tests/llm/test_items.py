"""Benchmark items against all windows, at every length; letters of language identification."""
import numpy as np
import pytest

from tidecast.llm import crf, decontaminate as dc


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at, kind = int(rng.integers(len(out))), int(rng.integers(3))
        out[at:at + (kind != 1)] = [] if kind == 0 else [f"x{rng.integers(10 ** 6)}"]
    return out


def noise(rng, n):
    return [f"z{rng.integers(10 ** 5)}" for _ in range(n)]


@pytest.mark.parametrize("n, copies", [(6, 120), (9, 120), (14, 100), (25, 80), (40, 60), (64, 50), (110, 30), (200, 20), (500, 10), (1000, 8), (2000, 4)])
def test_recall_by_length(n, copies):
    """Items with as many edits as allowed, in the middle of other words."""
    rng = np.random.default_rng(n)
    items = [(k, " ".join(f"w{rng.integers(3000)}" for _ in range(n))) for k in range(copies)]
    block = dc.Items(items)
    texts = [" ".join(noise(rng, 150) + edited(rng, t.split(), dc.allowed(n)) + noise(rng, 80)) for _, t in items]
    got = {(r, j): (edits, b, e) for r, j, edits, b, e in block.search(texts)}
    assert sum((k, k) in got for k in range(copies)) >= 0.99 * copies - 1e-9
    for (r, j), (edits, begin, end) in got.items():
        words = [block.number.get(w, 0) for w in texts[r].split()]
        assert edits <= dc.allowed(n) and dc.best_run(block.items[j], np.array(words[begin:end]))[0] == edits


def test_equal_to_all_windows():
    """Few words, so that chance matches and near misses abound."""
    rng = np.random.default_rng(3)
    items = [(k, " ".join(f"w{rng.integers(30)}" for _ in range(int(rng.integers(6, 16))))) for k in range(12)] + [(12, None), (13, "one two")]
    block = dc.Items(items)
    texts = []
    for k in range(60):
        own = items[int(rng.integers(12))][1].split()
        texts.append(" ".join([f"w{rng.integers(30)}" for _ in range(int(rng.integers(0, 20)))] + edited(rng, own, int(rng.integers(0, 5))) + noise(rng, 4)))
    texts += [None, "", "w1", items[0][1] + " " + items[0][1]]
    want = set()
    for r, text in enumerate(texts):
        words = np.array([block.number.get(w, 0) for w in (text or "").split()], np.int64)
        for j, item in enumerate(block.items):
            edits, _ = dc.best_run(item, words)
            if edits <= dc.allowed(len(item)):
                want.add((r, j, edits))
    got = {(r, j, edits) for r, j, edits, _, _ in block.search(texts)}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 30
    assert (len(texts) - 1, 0, 0) in got


def test_windows_do_not_reach_into_the_next_text():
    item = " ".join(f"w{k}" for k in range(20))
    words = item.split()
    block = dc.Items([(0, item)])
    assert block.search([" ".join(words[:11]), " ".join(words[11:])]) == []
    assert [r[:3] for r in block.search(["q " + " ".join(words[:16]), " ".join(words[2:])])] == [(0, 0, 4), (1, 0, 2)]


def test_very_long_item():
    item = " ".join(f"w{k}" for k in range(100_000))
    got = dc.Items([(7, item), (8, " ".join(f"v{k}" for k in range(12)))]).search(["a b " + item + " c", item[:40]])
    assert got == [(0, 0, 0, 2, 100_002)]


def test_words_are_letters_with_their_marks():
    assert crf.words_of("½ ² ① Ⅷ 12 _") == [] and crf.words_of(None) == []
    assert crf.words_of("नमस्ते x²y été") == ["नमस्ते", "x", "y", "été"]


def test_languages_with_long_documents_only_are_learned(spark):
    alpha, beta = "der und nicht das ist ein zu den mit von ", "que los una por con para las del como mas "
    rows = [(k, (alpha if k % 2 else beta) * (3000 if k % 2 else 20), "de" if k % 2 else "es") for k in range(60)]
    df = spark.createDataFrame([*rows, (100, alpha * 3, None), (101, "½ ² ①", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in crf.label(df, crf.train(df), "doc_id").collect()}
    assert got[100] == "de" and got[101] == "und" and got[0] == "es"
