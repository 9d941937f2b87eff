"""Lines are compared by keys made beside their texts; texts move only where a key is shared."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from llm_tables import table

from chronofold.llm import kernels, line_dedup


def ends(s, bound):
    """(what a key stands for, whether a shorter line has it so) of a line, by slices."""
    rounded = lambda m: m - m % (1 if m < 20 else 4 if m < 64 else 16 if m < 128 else 32)
    allowed = lambda m: min(bound, max(1, m // 10))
    n, out = len(s), []
    for u in range(allowed(n) + 1):
        r = rounded(n - u)
        if n < u or u > allowed(n - u) or (u and r == rounded(n - u + 1)):
            continue
        q = r // (2 if r < 20 else 4)
        for left in (True, False):
            for inner, shift in ((0, 0),) if r < 20 else ((0, 0), (1, -1), (1, 0), (1, 1)):
                at = inner * q + shift if left else n - q - inner * q + shift
                out.append(((r, inner, left, s[at : at + q]), int(u == 0 and shift == 0)))
    return out


@pytest.mark.parametrize(("bound", "limit"), [(2, 1 << 20), (3, 1 << 20), (3, 500)])
def test_end_keys_stand_for_ends(bound, limit):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é€\U0001f600") for _ in range(rng.choice([0, 3, 9, 10, 19, 20, 22, 24, 64, 66, 130, 160, 300]))) for _ in range(1000)]
    batch = pa.record_batch([pa.array(texts)], ["line"])
    keys = [k for _, raw, offsets in kernels.chunks(batch, "line", limit) for k in line_dedup._ends(raw, offsets, bound, 10).to_pylist()]
    expected, got = defaultdict(list), defaultdict(list)
    for i, (text, found) in enumerate(zip(texts, keys, strict=True)):
        for what, own in ends(text, bound) if len(text) >= 10 else []:
            expected[what].append((i, own))
        for k in found:
            got[k >> 1].append((i, k & 1))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("bound", [2, 3])
def test_only_texts_that_share_a_key_are_written(spark, monkeypatch, bound):
    written, real = [], line_dedup.cut

    def cut(df, name):
        out = real(df, name)
        if "line" in df.columns:
            written.append(out.select("line").distinct().count())
        return out

    monkeypatch.setattr(line_dedup, "cut", cut)
    rng = random.Random(6)
    texts = ["\n".join("".join(rng.choice("abcdefghij ") for _ in range(60)).strip() for _ in range(10)) for _ in range(20)]
    texts += ["a line of some words that is said twice, nearly", "a line of some words that is said twice, nearlx"]
    got = line_dedup.duplicate_lines(table(spark, texts), bound=bound, min_equal=1).collect()
    assert [(r["doc_id"], r["kept_doc_id"], r["distance"]) for r in got] == [(21, 20, 1)]
    assert written and max(written) < 10
