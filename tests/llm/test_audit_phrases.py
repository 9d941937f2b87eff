"""Filter audit and phrase mining against brute force on small tables."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from llm_tables import table

from chronofold.llm import filter_audit, phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {f for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text), i is not None and i > least[text]), strict=True) if bad}
        docs.append((lang or "", fails, i in good, i in toxic))
    out, removed = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                here = [d for d in docs if d[0] == part and f in d[1] and not d[1] & set(order[: step - 1])]
                removed[part, f] += len(here)
                out[part, "".join(order), step] = [
                    sum(d[0] == part and not d[1] & set(order[:step]) for d in docs), len(here), sum(d[0] == part and f in d[1] and bool(d[1] & set(order[: step - 1])) for d in docs),
                    sum(d[0] == part and d[1] == {f} for d in docs), sum(d[2] for d in here), sum(d[3] for d in here),
                ]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, la, 7, "x") for i, t, la in rows], "doc_id long, text string, lang string, size int, mask string")
    held = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(docs, held)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}


def test_audit_brute_force(spark):
    rng = random.Random(12)
    long = " ".join(f"w{i}" for i in range(210))
    texts = [None, "", " ", "A b", long, long, long + " x", "A" * 40 + " " + long, long + " #", "w " * 300, long.replace("w9 ", "w8 "), "é" * 64 + long, "é" * 64 + long, "x" * 9000, "x" * 8999 + "y", "x" * 9000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None])) for _ in range(150)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)
    assert audited(spark, [], labels) == {} and audited(spark, [], []) == {}
    assert audited(spark, rows[:3], []) == brute_audit(rows[:3], [])


def test_refinement_compares_full_texts(spark, monkeypatch):
    """With hashes that are all alike, only the texts tell."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit, "_keys", lambda text: {k: F.lit(1).cast("long") for k in filter_audit.KEYS})
    rows = [(i, f"t{i % 5}", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keyed = docs.withColumns(filter_audit._keys(F.col("text")))
    keys = filter_audit.classes(keyed)
    assert keys.count() == 1
    assert sorted(r["doc_id"] for r in filter_audit.repeated(docs, keys).collect()) == list(range(5, 20))


def brute_phrases(rows, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    cand = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    inside = set()
    for (lang, w), c in cand.items():
        for a in range(len(w)):
            for b in range(a + 2, len(w) + 1):
                if (a, b) != (0, len(w)) and 100 * c >= 100 * cand[lang, w[a:b]]:
                    inside.add((lang, w[a:b]))
    out = []
    for lang in n:
        own = []
        for (la, w), a in cand.items():
            if la == lang and (la, w) not in inside:
                score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                own.append((-score, -a, " ".join(w).encode(), " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
        out += [(lang, i, *x[3:]) for i, x in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"dictionary": 3, "per_task": 40}, {"per_task": 7, "sample": 5}])
def test_phrases_brute_force(spark, monkeypatch, options):
    if options:
        monkeypatch.setattr(phrases, "CHUNK", 300)
    rng = random.Random(13)
    line = lambda: " ".join(rng.choice(["of", "the", "The", "bank", "über", "x", "日本", "the\tbank", "of the bank of", "a.b", "c,"]) for _ in range(rng.randrange(0, 12)))
    rows = [(rng.choice([line(), line(), line() + "\n" + line(), "the the the the the the the", "same long passage of seven words here!", None, ""]), rng.choice(["en", "en", "de", None])) for _ in range(160)]
    docs = spark.createDataFrame([(i, t, la, 1, 2) for i, (t, la) in enumerate(rows)], "doc_id long, text string, lang string, f int, ids int").repartition(3)
    for top in (2000, 4):
        got = sorted(map(tuple, phrases.collocations(docs, least=4, top=top, **options).collect()))
        assert got == brute_phrases(rows, 4, top) and got


def test_heavy_prefixes_are_dealt_by_longer_ones(spark):
    rows = np.array([[1, 2, 3, 0, 0], [1, 2, 4, 5, 0], [1, 3, 1, 2, 2], [2, 1, 0, 0, 0]] * 50)
    heavy = np.sort(np.concatenate([phrases._prefix_hash(rows[:1], k) for k in (1, 2)]))
    part = phrases._parts(rows, heavy, 1 << 40)
    assert len(set(part.tolist())) == 4  # (1, 2, 3), (1, 2, 4), (1, 3), (2)
    found = Counter()
    for p in set(part.tolist()):
        r, w = phrases._merged(rows[part == p], np.ones((part == p).sum(), dtype=np.int64))
        for ids, f in phrases.grow(r, w, 10, heavy):
            found[tuple(ids)] += f
    assert found[1, 2] == 100 and found[1, 2, 3] == 50 and found[1, 3, 1] == 50 and found[2, 1] == 50


def test_one_hot_pair_and_empty_tables(spark):
    texts = ["a b " * 400] * 3 + [f"a b z{i} q{i}" for i in range(300)]
    docs = table(spark, texts)
    got = {r["phrase"]: (r["a"], r["n"]) for r in phrases.collocations(docs, least=100, per_task=64, sample=8).collect()}
    assert got["a b"] == (1500, 3600) and brute_phrases([(t, "en") for t in texts], 100, 2000)
    assert sorted(map(tuple, phrases.collocations(docs, least=100, per_task=64).collect())) == brute_phrases([(t, "en") for t in texts], 100, 2000)
    assert phrases.collocations(table(spark, [])).count() == 0 and phrases.collocations(table(spark, [None, "a b"])).count() == 0


def test_exact_arithmetic(spark, monkeypatch):
    """Products beyond 64 bits, from counts that no test table has."""
    big = 10**12
    named = spark.createDataFrame([("en", "a", 3 * big + 1, 1), ("en", "b", 2 * big + 7, 2)], "lang string, word string, f long, id long")
    found = spark.createDataFrame([([1, 2], 2 * big - 1)], "ids array<long>, f long")
    totals = spark.createDataFrame([("en", 9 * big + 5)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent", lambda docs, least: (named, found, totals))
    r = phrases.collocations(table(spark, [])).first()
    assert r["score"] == 1000 * (2 * big - 1) * (9 * big + 5) // ((3 * big + 1) * (2 * big + 7))
