"""The draw of the mixing operator against a plain version of it."""

import math
import random
from collections import Counter, defaultdict

import pytest
from llm_tables import DOCS
from pyspark.sql import functions as F

from chronofold.llm import mixing


def chances(docs, rest):
    """Chance of one more copy of each (size, weight): proportional to the weight, at most 1, expected words ``rest``."""
    sure = set()
    while True:
        left = rest - sum(docs[i][0] for i in sure)
        mass = sum(s * w for i, (s, w) in enumerate(docs) if i not in sure)
        more = {i for i, (s, w) in enumerate(docs) if i not in sure and mass > 0 and left * w >= mass}
        if not more:
            return [1.0 if i in sure else (left / mass * w if mass > 0 else 0.0) for i, (s, w) in enumerate(docs)]
        sure |= more


def rounded(w):
    return 2.0 ** (math.floor(math.log(w) / math.log(2) * mixing.STEPS) / mixing.STEPS) if w is not None and w > 0 and not math.isnan(w) else 1.0


def plain(rows, target, weight):
    """Sorted (size, h, copies) of one source; rows are (size, h, weight)."""
    total = sum(s for s, _, _ in rows)
    ratio = target / total if total else 0.0
    whole = int(ratio + 1e-12)
    rest = target - whole * total
    p = chances([(s, weight(s, w)) for s, _, w in rows], rest) if rest > 1e-9 else [0.0] * len(rows)
    left = rest - sum(s for (s, _, _), x in zip(rows, p, strict=True) if x == 1)
    order = []
    for i, (_, h, _) in enumerate(rows):
        if 0 < p[i] < 1:
            u = (((h % 2**64) >> 11) + 0.5) / 2.0**53
            q = u / (1 - u) / (p[i] / (1 - p[i]))
            order.append((q / (1 + q), h, i))
    order.sort()
    drawn = set()
    for _ in range(mixing.ROUNDS):
        able = [i for _, _, i in order if i not in drawn and rows[i][0] <= left]
        for i in able:
            if rows[i][0] > left:
                break
            drawn.add(i)
            left -= rows[i][0]
    close = [(abs(rows[i][0] - left), z, h, i) for z, h, i in order if i not in drawn and rows[i][0] > 0 and abs(rows[i][0] - left) < left]
    if close:
        drawn.add(min(close)[3])
    return Counter((s, h, whole + (p[i] == 1) + (i in drawn)) for i, (s, h, _) in enumerate(rows))


@pytest.mark.parametrize("odds_col", [None, "score"])
def test_draw_equals_a_plain_version(spark, odds_col):
    rng = random.Random(8)
    rows = []
    for i in range(1200):
        size = rng.choice([0, 1, 7, 30, 90, 150, rng.randrange(400)]) if rng.random() < 0.99 else rng.randrange(3000, 30000)
        odds = rng.choice([None, 0.0, -2.0, float("nan"), 0.5, 3.0, 40.0, 1e12 if i == 5 else 9.0])
        rows.append((i, " ".join([f"w{i}"] * size), "en", rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"]), 0, None, odds, 7))
    docs = spark.createDataFrame(rows, DOCS)
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()}
    odds = {r[0]: r[6] for r in rows}
    weight = (lambda s, w: rounded(min(w, 2.0**30) if w is not None and w > 0 else w)) if odds_col else (lambda s, w: rounded(s))
    got, target = defaultdict(list), {}
    for r in mixing.mix(docs, odds_col=odds_col).collect():
        got[r["source"]].append((r["size"], h[r["doc_id"]], r["copies"], odds[r["doc_id"]]))
        target[r["source"]] = r["target"]
    for source, found in got.items():
        want = plain([(s, x, w) for s, x, _, w in found], target[source], weight)
        assert Counter((s, x, c) for s, x, c, _ in found) == want, source


def test_chances_follow_the_words(spark):
    """Documents are drawn about as often as their chance says; the gap that small ones fill is less than the largest document."""
    sizes = [10, 20, 40, 80, 160, 320] * 400
    docs = spark.createDataFrame([(i, " ".join(["w"] * s), "en", "ab"[i % 2], 0, None, None, 7) for i, s in enumerate(sizes)], DOCS)
    drawn, whole, runs = Counter(), {}, 2
    for seed in range(runs):
        for r in mixing.mix(docs, weights=(3, 2), seed=seed).where("source = 'b'").collect():
            drawn[r["size"]] += r["copies"]
            whole[r["size"]] = r["target"]
    some = [s for i, s in enumerate(sizes) if i % 2]
    p = dict(zip(some, chances([(s, rounded(s)) for s in some], whole[some[0]]), strict=True))
    for s in set(some):
        n = some.count(s) * runs
        assert abs(drawn[s] / n - p[s]) < 0.02 + 3 * math.sqrt(p[s] * (1 - p[s]) / n), s


def test_hot_source_and_equal_documents(spark):
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", "repeat('w ', 50) as text", "'en' as lang", "if(id % 3 = 0, 'a', 'b') as source", "0L as n_chars", "false as kept", "1D as score", "7L as a", "id as rid", "'x' as h", "1 as level")
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min("copies").alias("least"), F.max("copies").alias("most")).collect()
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 50 and r["most"] - r["least"] <= 1
