"""Every operator against plain Python over the small tables."""
import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm.conftest import WORD, brute_components, by_id, rows_of, tokens
from tidecast.llm import chat, token_counts
from tidecast.llm.catalog import QUERIES
from tidecast.llm.decontaminate import contaminated

HALF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def library():
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.no_truncation()
    t.no_padding()
    return t


def test_token_counts_equal_the_library(spark, small_docs):
    got, t = by_id(QUERIES["op1_token_counts"](spark, SMALL)), library()
    for r in small_docs:
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 512)


ODD_PREFIXES = [
    "can't stop,  won't\n\n stop 123abc", "na\u00efve \u4e2d\u6587 x\u0301 \u00a0y", "   lead and trail   ", "<|endoftext|> a", "a <|endoftext|><|endoftext|>b<|endof", "x\n\n\nyes", "\n\n 12",
    "\t\t!!", "''s 's ''", "\n's we'll \n\n'll they'r", "'!!!!'!! '''", " '", "\r\n\r\n  'tis", "a  \n  b", "1\u00b2\u00bd \u2460x", "\u2028\u2028z", "  \u3000q", "!!!<|endoftext|>", " <|endoftext|", "\x1c\x1dm",
    "don\u2019t", "'sx 'rex", "I'm'm", "x  ", "\n", " ", "\n \n \n a", "e\u0301e\u0301 \U0001f600\U0001f600 !", "\u00a0\u00a0word", "AB12cd!? '", "''''a", "'d'd 'vee", "...\n\n...", "a\u200bb", "\ufb01 \u0130x",
    "tab\tand\vfeed\f", "-- --  --", "a'b'c's", "\n\n\n", "9" * 40 + "x"]


def test_every_prefix_has_its_own_count(spark):
    df = spark.createDataFrame(list(enumerate(ODD_PREFIXES)), "doc_id bigint, text string")
    t = library()
    for r in token_counts.prefix_tables(df, public_tokenizers.path("byte_bpe_50k.json")).collect():
        counts, text = token_counts.counts_of(bytes(r.prefix_deltas)), ODD_PREFIXES[r.doc_id]
        assert counts.tolist() == [len(t.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], text


@pytest.mark.parametrize("text", ["\n\n" + "ab" * 50_000, "'" + "!?" * 50_000, "\n" + "-" * 100_000, " \t" * 50_000 + "x", "<|endoftext|>" * 5_000], ids=["letters", "signs", "dashes", "white", "added"])
def test_long_runs_take_linear_time(text):
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        counter = token_counts.PrefixCounter(f.read())
    begin = time.perf_counter()
    table = counter.table(text)
    assert time.perf_counter() - begin < 6
    assert token_counts.counts_of(table)[-1] == len(library().encode(text, add_special_tokens=False).ids)


def test_base_rules(spark, small_docs):
    got = by_id(QUERIES["op2_divergence"](spark, SMALL))
    for r in small_docs:
        text = r.text or ""
        w = WORD.findall(text)
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k:k + 5])].append(k)
        repeated = {p + j for ps in at.values() if len(ps) > 1 for p in ps for j in range(5)}
        lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated))
        o = got[r.doc_id]
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == base
        assert o.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (o.base_failed and o.kept)


def test_chat_digests(spark):
    turns = defaultdict(list)
    for r in sorted(rows_of(spark, SMALL, "conversations"), key=lambda r: (r.conv_id, r.turn)):
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [(x, "</s>[INST] ok [/INST]") for x in ("user", "assistant")]
    got = by_id(QUERIES["op3_chat_format"](spark, SMALL), "conv_id")
    assert set(got) == set(turns)
    for conv, ts in turns.items():
        loss = "".join(x for role, x in ts if role == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(ts), len(loss))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].formatted_chars == sum(len(chat.format_turn(r, x)[0]) for r, x in ts)


@pytest.mark.parametrize("text", ["", " ", "\\", "\\\\[", "</s>", " [/INST]", "[/INST", "<s>[OUT] x </s>", "a\\</s>\\", " </s", "\\[/OUT] [ROLE x] "])
def test_a_turn_reads_back(text):
    for role in ("user", "system", "assistant", "tool] [", "", None):
        out = chat.format_turn(role, text)[0]
        assert [t[:2] for t in chat.parse(out + out)] == [(role, chat.parse(out)[0][1])] * 2
        begin, end = chat.format_turn(role, text)[1:3]
        assert chat.parse(out)[0][0] == role and text in (out[begin:end], chat.unescape(out[begin:end]))


def test_warc_records(spark):
    pages = rows_of(spark, SMALL, "pages")
    first = {}
    for r in pages:
        first[r.html or ""] = max(first.get(r.html or "", r.page_id), r.page_id)
    got = by_id(QUERIES["op5_warc_normaliser"](spark, SMALL), "page_id")
    for r in pages:
        body, keeper = (r.html or "").encode(), first[r.html or ""]
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *(("response", None) if keeper == r.page_id else ("revisit", keeper)))
        o = got[r.page_id]
        assert (o.payload_bytes, o.payload_digest, o.record_type, o.refers_to) == want


def test_language_on_held_out_rows(spark):
    got, docs = by_id(QUERIES["op4_language_crf"](spark, HALF)), rows_of(spark, HALF, "documents")
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs if crc(r.doc_id) % 4 == 2 and r.lang and r.text]
    assert all(got[r.doc_id].held_out == (crc(r.doc_id) % 4 == 2) for r in docs)
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_toxicity_on_held_out_rows(spark):
    # sf0.1, as sf0.01 holds out only 14 toxic rows
    got, labels = by_id(QUERIES["op6_toxicity"](spark, LARGE)), {r.doc_id: r.toxic for r in rows_of(spark, LARGE, "labels")}
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    held = [(got[d].score, y) for d, y in labels.items() if d in got and y is not None and crc(d) % 4 == 2]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    area = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert area > 0.9, (area, len(bad), len(good))


def test_items_with_edits_are_found(spark, small_docs):
    items = [(r.item_id, r.text) for r in rows_of(spark, SMALL, "benchmark") if len(r.text.split()) >= 20]
    clean = small_docs[0].text
    planted = []
    for k, (i, text) in enumerate(items):
        w = text.split()
        w[len(w) // 2] = "zzz"
        planted += [(2 * k, i, f"{clean} {text} {clean}"), (2 * k + 1, i, f"{clean} {' '.join(w).upper()} {clean}")]
    docs = spark.createDataFrame([(d, t) for d, _, t in planted] + [(-1, " ".join(reversed(clean.split())))], "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {(d, i) for d, i, _ in planted} <= found and -1 not in {d for d, _ in found}


def test_verbatim_items_in_the_tables(spark, small_docs):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontaminate"](spark, SMALL).collect()}
    items = [(r.item_id, " ".join(r.text.split())) for r in rows_of(spark, SMALL, "benchmark") if len(r.text.split()) >= 8]
    assert {(d.doc_id, i) for d in small_docs for i, t in items if t in " ".join((d.text or "").split())} <= got


def test_components(spark, small_docs):
    got = by_id(QUERIES["op8_jaccard_join"](spark, SMALL))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_components({r.doc_id: r.text for r in small_docs})


def test_base_scores(spark, small_docs):
    got, seen = by_id(QUERIES["op9_bloom_lm"](spark, SMALL)), Counter()
    for r in small_docs:
        if crc(r.doc_id) % 7 != 2:
            seen.update([*tokens(r.text), None])
    n, v = sum(seen.values()), len(seen)
    gain = 0.0
    for r in small_docs:
        o, w = got[r.doc_id], [*tokens(r.text), None]
        assert (o.held_out, o.n_tokens, o.n_known, o.train_tokens) == (crc(r.doc_id) % 7 == 2, len(w), sum(seen[x] > 0 for x in w), n)
        assert math.isclose(o.base_score, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        gain += (o.score - o.base_score) * o.held_out
    assert gain > 0, "pairs should help on held-out texts"


def test_mix(spark, small_docs):
    got = by_id(QUERIES["op10_mixing"](spark, SMALL))
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in small_docs}
    per = Counter()
    for r in small_docs:
        per[r.source] += size[r.doc_id]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight, target, left = dict(zip(names, (3, 1, 2) * len(names))), {}, 1.5 * sum(per.values())
    while True:
        rest = [s for s in names if s not in target]
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 2 * per[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
            break
        target |= {s: 2.0 * per[s] for s in over}
        left -= sum(2.0 * per[s] for s in over)
    taken = Counter()
    for r in small_docs:
        o = got[r.doc_id]
        assert (o.size, o.source_size) == (size[r.doc_id], per[r.source]) and 0 <= o.taken <= 2 * o.size
        assert math.isclose(o.target, target[r.source], rel_tol=1e-9)
        taken[r.source] += o.taken
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 200) for s in names), (taken, target)
    assert {k: r.taken for k, r in by_id(QUERIES["op10_mixing"](spark, SMALL)).items()} == {k: r.taken for k, r in got.items()}
