"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations


import json
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import edit_distance, survivor, table

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from chronofold.llm import chat, language, line_dedup, near_dup, pii, queries, simhash, toxicity


def test_lines_short_copies(spark, tmp_path):
    table(spark, ["Of.\nlong enough a line", " Of. \n\n \r\n\r\nOg.", "Of.\n\t\n\t"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"], r["distance"]) for r in queries.op2_lines(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (0, 0, 0), (2, 0): (0, 0, 0)}


@pytest.mark.parametrize(("bound", "few"), [(2, 64), (3, 16), (3, 0)])
def test_lines_edit_bounds_brute_force(spark, monkeypatch, bound, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(12)
    pool = ["".join(rng.choice("abc é") for _ in range(rng.choice([8, 12, 25, 32, 40, 61, 66, 130]))).strip() for _ in range(25)]

    def line():
        x = list(rng.choice(pool))
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            i = rng.randrange(len(x))
            rng.choice([lambda: x.pop(i), lambda: x.insert(i, "z"), lambda: x.__setitem__(i, "q")])()
        return "".join(x)

    texts = ["\n".join(line() for _ in range(rng.randrange(1, 9))) for _ in range(50)]
    lines = [(i, j, x.strip(" ")) for i, t in enumerate(texts) for j, x in enumerate(t.split("\n")) if x.strip(" ")]
    expected = {}
    for n, (i, j, x) in enumerate(lines):
        for a, b, y in lines[:n]:
            short = min(len(x), len(y))
            d = edit_distance(x, y)
            if d == 0 or (short >= 10 and d <= min(bound, max(1, short // 10))):
                expected[i, j] = (a, b, d)
                break
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"], r["distance"]) for r in line_dedup.duplicate_lines(table(spark, texts), bound=bound, min_equal=1).collect()}
    assert got == {k: (*survivor(expected, v[:2]), v[2]) for k, v in expected.items()}
    assert {d for _, _, d in expected.values()} == set(range(bound + 1))


def test_lines_kept_lines_stay(spark):
    text = "one line of which {} is changed again and again"
    texts = [text.format("a" * i + "b" * (8 - i)) for i in range(9)]
    got = line_dedup.duplicate_lines(table(spark, texts), bound=1).collect()
    assert {(r["doc_id"], r["kept_doc_id"], r["distance"]) for r in got} == {(i, 0, 1) for i in range(1, 9)}


def test_lines_of_a_repeated_id(spark):
    texts = ["first line of all", "first line of all\nsecond line of two", "third line of three\nfourth line, quite apart", None]
    left = line_dedup.drop_lines(table(spark, texts, [None, 4, 4, 4]), bound=3, min_equal=1).collect()
    assert sorted((r["text"] or "", r["n_chars"] or 0) for r in left) == sorted([(texts[0], 17), ("second line of two", 18), (texts[2], len(texts[2])), ("", 0)])
    clash = table(spark, ["some line of text\nsome line of text"]).selectExpr("*", "a as row", "a as gone", "a as mark", "a as hash", "a as id")
    assert line_dedup.drop_lines(clash, bound=3, min_equal=1).select("text", "n_chars", "row", "gone", "mark", "hash", "id").first() == ("some line of text", 17, 7, 7, 7, 7, 7)


def test_lines_bound_must_be_implemented(spark):
    for bound in (-1, 4):
        with pytest.raises(ValueError):
            line_dedup.duplicate_lines(table(spark, ["a"]), bound=bound)


def test_toxicity_folds_every_code_point(spark):
    words = [f"{c}idiot" for c in "\u2018\u201c\u2013\u2014\u2026\u2022\u3001\u300c\U0001f600"] + ["\U0001d408\U0001d41d\U0001d422\U0001d428\U0001d42d", "id\u0269\u0585t", "\u13a5\u13e7iot", "id\ufe0fiot"]
    assert all(f" {toxicity.fold(w).strip()} " == " idiot " for w in words)
    got = toxicity.score(table(spark, [f"you {w}" for w in words] + ["you idiot"]), toxicity.default_model()).collect()
    assert len({r["score"] for r in got}) == 1 and got[0]["score"] > 0.5


def test_pipeline_rows_of_null_and_repeated_ids(spark, tmp_path):
    text = lambda name: " ".join(f"{name}{j}" for j in range(30))
    leak = text("question")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, [text("a"), text("a"), text("b"), text("b"), text("c"), text("c"), text("d"), text("a")], [None, 5, 6, 6, None, None, 5, 9])
    left = [(r["doc_id"], r["text"][0]) for r in pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == [(5, "a"), (5, "d"), (6, "b"), (None, "c")]
    docs = table(spark, [leak, leak, text("e"), text("f")], [None, 7, 7, None])
    assert {(r["doc_id"], r["text"][0]) for r in pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()} == {(7, "e"), (None, "f")}


def test_near_duplicates_all_texts_of_an_id_link(spark):
    text = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    docs = table(spark, [text("a", 50), text("b", 30), text("b", 30) + " more", text("a", 50) + " more", text("c", 9), "", None, text("b", 30)], [7, 7, 9, 3, 11, 7, 12, None])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, words=3, percent=85).collect()), key=str)
    assert got == sorted([(7, 48, 3, False), (7, 28, 3, False), (7, 0, 3, False), (9, 29, 3, False), (3, 49, 3, True), (11, 7, 11, True), (12, 0, 12, True), (None, 28, None, True)], key=str)


def test_chat_fields_of_other_layouts(spark):
    turns = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    records = [
        ({"prompt": "q", "prompt_id": "x", "messages": turns}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"system": "s", "messages": turns}, "messages", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"system": "s", "turns": [{"role": "user", "text": "q"}]}, "turns", [("system", "s"), ("user", "q")]),
        ({"instruction": "q", "input": "i", "output": "a", "context": "c"}, "instruction", [("user", "q\n\ni"), ("assistant", "a")]),
        ({"prompt": "q", "completion": "a", "messages": []}, "prompt-completion", [("user", "q"), ("assistant", "a")]),
    ]
    bad = [None, "", "{", "[1]", '{"prompt": "q"}', '{"messages": [{"role": "user"}]}']
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(90 + i, x) for i, x in enumerate(bad)], "conv_id long, record string")
    got = {r["conv_id"]: (r["layout"], chat.read_back(r["formatted"])) for r in chat.format_chats(rows).collect()}
    assert [got[i] for i in range(len(records))] == [(name, said) for _, name, said in records]
    out, counts = chat.rejects(rows)
    assert {r["conv_id"] for r in out.collect()} == {i for i, (name, _) in got.items() if not name} == set(range(90, 96))
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"null": 1, "broken JSON": 2, "no object": 1, "unknown layout": 2}


def test_pii_long_chains(spark):
    edges, least = [], 6
    for step in range(least):
        edges += [(f"p{step}", f"+{step}55512340{i}", 3 if step == 0 else None) for i in range(4)]
        edges += [(f"p{step + 1}", f"+{step}55512340{i}", None) for i in range(4)]
    good = {(r["pattern"], r["learned"]) for r in pii.bootstrap(spark.createDataFrame(edges, "pattern string, instance string, kind int"), confidence=0.5).collect()}
    assert good == {(f"p{i}", 3) for i in range(least + 1)}


def test_pii_pattern_of_a_candidate_after_digits(spark):
    texts = [f"on line2 call +1 555 123 {1000 + i} now" for i in range(8)] + ["on line2 call 555 123-2000, thanks", "on line2 call (555 123-2001) thanks"]
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(table(spark, texts))).collect()}
    assert found[8] == "phone:14:26" and found[9] == "phone:15:27"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pii_bootstrap_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(f"p{rng.randrange(9)}", "5" * rng.choice([8, 13, 16]) + str(i := rng.randrange(40)), rng.choice([2, 3]) if i < 24 else None) for _ in range(150)]
    suits = {2: range(12, 20), 3: range(7, 16)}
    pairs = {}
    for p, x, k in edges:
        pairs[p, x] = max((v for v in (k, pairs.get((p, x))) if v is not None), default=None)
    known = {}
    for (_, x), k in pairs.items():
        if k is not None:
            known[x] = min(k, known.get(x, 9))
    while True:
        good = set()
        for p in {p for p, _ in pairs}:
            kinds = [known.get(x) for q, x in pairs if q == p]
            good |= {(p, k) for k in (2, 3) if kinds.count(k) >= 3 and kinds.count(k) >= 0.3 * len(kinds)}
        more = dict(known)
        for p, x in pairs:
            for q, k in good:
                if p == q and len(x) in suits[k]:
                    more[x] = min(k, more.get(x, 9))
        if more == known:
            break
        known = more
    got = pii.bootstrap(spark.createDataFrame(edges, "pattern string, instance string, kind int"), support=3, confidence=0.3)
    assert {tuple(r) for r in got.collect()} == good and good


def test_pii_secrets_by_context(spark):
    token = lambda i: f"{i:040x}".replace("0", "a", 20)
    texts = [f'set token = "{token(i)}" here' for i in range(1000, 1006)] + ["TOKEN = 'Zx81kq0PmmR42vLw77Ty01', then", "token = none", f"commit {token(5000)} is fine", None, ""]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(table(spark, texts))).collect()}
    assert [found[i]["spans"] for i in range(6)] == ["secret:13:53"] * 6
    assert found[6]["spans"] == "secret:9:31" and found[6]["n_spans"] == 1
    assert [found[i]["spans"] for i in range(7, 11)] == [""] * 4
    assert found[0]["base_sha256"] == found[10]["base_sha256"]


def test_pii_dense_texts_and_null_ids(spark):
    dense = " ".join(f"a{i % 10}b" for i in range(60000)) + " me@mail.example.com" + " 10.0.0.1" * 20000
    texts = [dense, dense, "write to me@mail.example.com, 10.0.0.1."]
    began = time.time()
    found = pii.digest(pii.find(table(spark, texts, [None, 4, None]))).collect()
    assert time.time() - began < 100
    at = dense.index("me@")
    want = ",".join([f"email:{at}:{at + 19}", *(f"ip:{x}:{x + 8}" for x in range(at + 20, len(dense), 9))])
    assert sorted((r["n_email"], r["n_ip"], r["spans"] == want) for r in found) == [(1, 1, False), (1, 20000, True), (1, 20000, True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("idiot id10t idiotic trash can trash bag proof stupid question a of Idiot, loser sore scum pond".split()), min_size=1, max_size=14))
def test_toxicity_evidence_brute_force(words):
    model = toxicity.default_model()
    text = toxicity.fold(" ".join(words))
    at = lambda e: {i for i in range(len(text)) if text.startswith(f" {e}", i)}
    shields = [(i, i + len(e) + 1) for e in map(str.strip, map(toxicity.fold, model.exceptions)) for i in at(e)]
    hits = [w for e, w in model.weights.items() for i in at(e) if not any(x <= i and i + len(e) + 1 <= y for x, y in shields)]
    assert toxicity.evidence(model.automaton(), text) == (sum(hits), max(hits, default=0.0), len(text.split()))


def test_toxicity_long_texts_of_many_matches():
    began = time.time()
    text = toxicity.fold("idiot proof idiot trash can scum " * 60000)
    assert toxicity.evidence(toxicity.default_model().automaton(), text)[0] == 3.0 * 2 * 60000
    assert time.time() - began < 20


def test_language_ftrl_brute_force():
    rng = np.random.default_rng(4)
    bins, classes, a, b, l1, l2 = 12, 3, 0.5, 1.0, 0.05, 0.02
    model = language.FTRL(bins, classes, a, b, l1, l2)
    z, n = [[0.0] * classes for _ in range(bins)], [[0.0] * classes for _ in range(bins)]

    def weight(i, c):
        return 0.0 if abs(z[i][c]) <= l1 else -(z[i][c] - math.copysign(l1, z[i][c])) / ((b + math.sqrt(n[i][c])) / a + l2)

    for _ in range(60):
        at = np.sort(rng.choice(bins, 4, replace=False))
        x, label = rng.random(4), int(rng.integers(classes))
        logits = [sum(weight(i, c) * v for i, v in zip(at, x, strict=True)) for c in range(classes)]
        whole = sum(math.exp(v) for v in logits)
        for i, v in zip(at, x, strict=True):
            for c in range(classes):
                w, g = weight(i, c), v * (math.exp(logits[c]) / whole - (c == label))
                z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / a * w
                n[i][c] += g * g
        model.learn(at, x, label)
    want = np.array([[weight(i, c) for c in range(classes)] for i in range(bins)])
    assert np.allclose(model.weights(), want) and (want != 0).any()


def test_held_out_recall(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet".replace("0.001", "0.01")) for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).where("held_out").join(labels.where("toxic = 1"), "doc_id").collect()
    assert len(rows) >= 10 and sum(r["predicted"] for r in rows) >= 0.8 * len(rows)
    rows = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) >= 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)


def test_simhash_votes_brute_force(spark):
    texts = ["one two two three", "Longwordshere AGAIN longwordshere again x", "a", "w " * 500 + "end of it"]
    hashed = lambda *values: spark.createDataFrame([values]).select(F.xxhash64("*")).first()[0]
    got = {r["k"]: r["bits"] for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).collect()}
    for k, t in enumerate(texts):
        words = t.lower().split()
        votes = [0] * 64
        for pair, count in Counter(zip(["", *words], words, strict=False)).items():
            weight = max(1, min(simhash.HEAVIEST, (len(pair[0]) + len(pair[1])) // 2))
            h = hashed((hashed(*pair) & -simhash.HEAVIEST) | (weight - 1))
            for b in range(64):
                votes[b] += count * weight * (1 if h >> b & 1 else -1)
        assert got[k] & (2**64 - 1) == sum(1 << b for b in range(64) if votes[b] > 0)
