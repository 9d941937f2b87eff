"""Personal data in nested JSON against a plain walk; the outbox with failures, crashes and replays."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from chronofold.functions import nested, personal
from chronofold.streaming.outbox import Outbox

T = dt.datetime(2024, 1, 1)
TEXTS = ["alice@a.com or bob@b.com", "Ali Öz met Ayşe Kaya, and Ayşe K. Demir", "nothing", "", "x@y.zz", "İpek Çelik <ipek@c.com>", "7"]


def random_json(rng, depth=0):
    kind = rng.randrange(6 if depth < 4 else 3)
    if kind == 0:
        return rng.choice([1, 2.5, True, None])
    if kind < 3:
        return rng.choice(TEXTS)
    if kind == 3:
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "42", "0", "subjects", "x.y", "ş"]): random_json(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.fixture(scope="module")
def tree(spark):
    rng = random.Random(5)
    values = [random_json(rng) for _ in range(120)] + [{"subjects": ["a@b.co"], "note": TEXTS[0]}, "a@b.co", [[["c@d.ee"]]]]
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(900, None), (901, "{broken"), (902, "")]
    return values, spark.createDataFrame(rows, "id long, j string")


def test_findings_of_a_plain_walk(tree):
    values, df = tree
    got = sorted((r["id"], r["p"], r["pattern"], r["start"], r["end"], r["found"]) for r in nested.findings(df, "j").withColumn("p", nested.json_path(F.col("path"))).collect())
    want = sorted((i, personal.json_path(p), k, a, b, t[a:b]) for i, v in enumerate(values) for p, t in personal.walk(v) for k, a, b in personal.matches(t))
    assert got == want and len(got) > 50


def test_findings_of_subjects(tree):
    values, df = tree
    names = ["BOB@b.com", "ayşe kaya", "ipek"]
    got = sorted((r["id"], r["start"], r["found"]) for r in nested.findings(df, "j", subjects=names).collect())
    want = sorted((i, a, t[a:b]) for i, v in enumerate(values) for _, t in personal.walk(v) for _, a, b in personal.matches(t) if personal.concerns(t[a:b], names))
    assert got == want and got
    assert nested.findings(df, "j", subjects=[]).count() == 0


def test_numeric_keys(tree):
    values, df = tree

    def walk(value, path=()):
        if isinstance(value, dict):
            for k, v in value.items():
                if k.isdigit():
                    yield (*path, k)
                yield from walk(v, (*path, k))
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, (*path, i))

    got = sorted((r["id"], tuple(str(s["key"]) if s["key"] is not None else s["index"] for s in r["path"])) for r in nested.numeric_keys(df, "j").collect())
    assert [repr(x) for x in got] == [repr(x) for x in sorted(((i, p) for i, v in enumerate(values) for p in walk(v)), key=lambda x: got.index(x))]


def test_scrubbing_by_path(tree):
    values, df = tree
    left = {r["id"]: r["j"] for r in nested.scrubbed(df, nested.findings(df, "j"), "id", "j").collect()}

    def plain(value, path=()):
        if isinstance(value, str):
            return personal.scrub(value, personal.matches(value))
        if isinstance(value, dict):
            return {k: v if not path and k == "subjects" else plain(v, (*path, k)) for k, v in value.items()}
        return [plain(v, (*path, i)) for i, v in enumerate(value)] if isinstance(value, list) else value

    assert {i: json.loads(left[i]) for i in range(len(values))} == {i: plain(v) for i, v in enumerate(values)}
    assert (left[900], left[901], left[902]) == (None, "{broken", "")


def test_depth_is_never_cut(spark):
    deep = lambda n: "[" * n + '"a@b.cc"' + "]" * n
    assert nested.findings(spark.createDataFrame([(deep(nested.DEPTH),)], "j string"), "j").count() == 1
    with pytest.raises(Exception, match="levels"):
        nested.findings(spark.createDataFrame([(deep(nested.DEPTH + 1),)], "j string"), "j").count()


def rows(spark, ids):
    return spark.createDataFrame([(i, f"s{i % 2}", f"e{i}", 1, "{}", T + dt.timedelta(hours=-i)) for i in ids], Outbox.ROW)


def sender(failing, accepted=()):
    """Fails for the ids given; of those in ``accepted`` the stream has a copy all the same."""
    calls = []

    def send(pending):
        calls.append([r["outbox_id"] for r in pending.collect()])
        n = len(calls)
        bad = F.col("outbox_id").isin(list(failing(n)))
        kept = F.col("outbox_id").isin(list(accepted))
        return pending.select("outbox_id", F.when(~bad | kept, F.concat(F.lit(f"{n}-"), "outbox_id")).alias("message_id"), F.when(bad, F.lit(f"down {n}")).alias("error"))

    return send, calls


def test_drain_with_retries(spark, tmp_path):
    box = Outbox(spark, f"file://{tmp_path}/o", buckets=2)
    assert box.add("a", rows(spark, range(5))) and not box.add("a", rows(spark, range(5)))
    box.add("b", rows(spark, [4, 5]))
    send, calls = sender(lambda n: {1, 3} if n < 7 else {3}, accepted={3})
    for n in range(1, 8):
        r = box.drain(f"r{n}", send, now=T + dt.timedelta(days=n))
    assert calls[0] == [5, 4, 3, 2, 1, 0] and calls[1:] == [[3, 1]] * 6  # oldest first
    assert (r["drained"], r["failed"]) == (1, 1) and r["oldest_s"] >= r["newest_s"] > 0
    state = {r["outbox_id"]: (r["failures"], r["message_id"], r["last_error"]) for r in box.state().collect()}
    assert state[0] == (0, "1-0", None) and state[1] == (6, "7-1", "down 6") and state[3] == (7, None, "down 7")
    assert [(r["message_id"], r["failures"], r["stream"]) for r in box.letters().collect()] == [("3", 7, "s1")] and box.letters(limit=7).count() == 0
    assert {(r["event_id"], r["message_id"]) for r in box.copies().collect()} == {("e0", "1-0"), ("e2", "1-2"), ("e4", "1-4"), ("e5", "1-5"), ("e1", "7-1")} | {("e3", f"{n}-3") for n in range(1, 8)}
    again = box.drain("r7", send)
    assert len(calls) == 7 and (again["drained"], again["failed"]) == (1, 1)
    assert box.drain("r8", sender(lambda n: ())[0], limit=1)["drained"] == 1 and box.pending().count() == 0
    assert box.drain("r9", send)["oldest_s"] == 0


def test_follow_a_folder(spark, tmp_path):
    box = Outbox(spark, f"file://{tmp_path}/o", buckets=2)
    send, calls = sender(lambda n: {2} if n == 1 else ())
    source = f"file://{tmp_path}/in"
    rows(spark, range(3)).coalesce(1).write.parquet(source)
    box.follow(source, f"file://{tmp_path}/c", send)
    assert box.pending().count() == 1
    rows(spark, [7]).coalesce(1).write.mode("append").parquet(source)
    box.follow(source, f"file://{tmp_path}/c", send)
    box.follow(source, f"file://{tmp_path}/c", send)
    assert calls == [[2, 1, 0], [7, 2]] and box.pending().count() == 0 and box.read("row").count() == 4
