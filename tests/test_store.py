"""Batches with a commit log: crashes, repeats, merges, releases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import documents, store
from chronofold.operators.entities import Conflict

T = dt.datetime(2024, 1, 1)
OBS = "series_id long, ts timestamp_ntz, as_of timestamp_ntz, value double, value_text string, quality_flag smallint, payload_hash string"


def obs(spark, *rows):
    return spark.createDataFrame([(s, T + dt.timedelta(days=d), T, float(v), None, 0, f"h{v}") for s, d, v in rows], OBS)


class Crash(Exception):
    pass


def test_batch_is_written_once(spark, tmp_path):
    s = store.Observations(spark, f"file://{tmp_path}/o", buckets=4)
    out = s.write("b1", obs(spark, (1, 0, 5), (1, 1, 6), (2, 0, 7), (2, 0, 7)))
    assert (out.attempted, out.inserted, out.unchanged, out.duplicates) == (4, 3, 0, 1)
    assert s.write("b1", obs(spark, (2, 0, 7), (1, 0, 5), (2, 0, 7), (1, 1, 6))) == out
    with pytest.raises(Conflict):
        s.write("b1", obs(spark, (1, 0, 5)))
    out = s.write("b2", obs(spark, (1, 1, 6), (3, 0, 1)))
    assert (out.inserted, out.unchanged) == (1, 1)
    with pytest.raises(Conflict):
        s.write("b3", obs(spark, (1, 1, 99), (4, 0, 1)))
    with pytest.raises(ValueError, match="one_value"):
        s.write("b4", obs(spark, (5, 0, 1)).withColumn("value_text", F.lit("x")))
    assert sorted((r["series_id"], r["value"]) for r in s.read("observation").collect()) == [(1, 5), (1, 6), (2, 7), (3, 1)]
    sizes = {r["batch_id"]: r["batch_size"] for r in s.read("batch").collect()}
    keys = {r["batch_id"]: r["n"] for r in s.read("batch_key").groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert sizes == keys == {"b1": 3, "b2": 2}


@pytest.mark.parametrize("stage", ["files", "record"])
def test_crash_leaves_nothing_half_done(spark, tmp_path, monkeypatch, stage):
    s = store.Observations(spark, f"file://{tmp_path}/o", buckets=2)
    s.write("b1", obs(spark, (1, 0, 5)))
    written, seen = s._written, []

    def fail_second(table, rows):
        seen.append(table)
        if stage == "files" and len(seen) == 2:
            raise Crash
        return written(table, rows)

    monkeypatch.setattr(s, "_written", fail_second)
    if stage == "record":
        monkeypatch.setattr(s, "_record", lambda entry: (_ for _ in ()).throw(Crash()))
    with pytest.raises(Crash):
        s.write("b2", obs(spark, (2, 0, 1)))
    again = store.Observations(spark, f"file://{tmp_path}/o", buckets=2)
    assert again.read("observation").count() == 1 and again.read("batch").count() == 1
    again.write("b2", obs(spark, (2, 0, 1)))
    again.write("b2", obs(spark, (2, 0, 1)))
    assert again.read("observation").count() == again.read("batch_key").count() == 2
    assert again.vacuum() > 0 and again.read("observation").count() == 2 and again.vacuum() == 0


def test_batch_reads_its_buckets_only(spark, tmp_path):
    s = store.Observations(spark, f"file://{tmp_path}/o", buckets=16)
    s.write("b1", obs(spark, *[(i, 0, i) for i in range(200)]))
    few = s.touched(obs(spark, (7, 0, 1)), "series_id")
    assert len(few) == 1 and len(s.files("observation", few)) == 1 < len(s.files("observation"))
    assert s.read("observation", few).where("series_id = 7").count() == 1


def offers(spark, rows):
    return spark.createDataFrame(rows, "offer_id long, source_id string, source_ref string, sha256 string")


@pytest.mark.parametrize("seed", range(2))
def test_filings_in_batches_as_at_once(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), f"r{rng.randrange(6)}", f"c{rng.randrange(25)}") for i in range(60)]
    s = store.Filings(spark, f"file://{tmp_path}/f", buckets=3)
    ends = [0, *sorted(rng.sample(range(1, 60), 2)), 60]
    for n, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        assert s.put(f"p{n}", offers(spark, rows[a:b]))
        assert not s.put(f"p{n}", offers(spark, rows[a:b]))
    columns = ["offer_id", "source_id", "source_ref", "sha256", "revision_no", "previous_id", "is_amendment", "aliases"]
    want = documents.put_filings(offers(spark, rows)).select(*columns)
    assert sorted(map(tuple, s.stored().select(*columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_release(spark, tmp_path):
    s = store.Filings(spark, f"file://{tmp_path}/f", buckets=2)
    blobs = spark.createDataFrame([(1, "k1"), (2, "k2a"), (2, "k2b"), (3, "k3")], "offer_id long, object_key string")
    s.put("p", offers(spark, [(1, "a", "r1", "x"), (2, "a", "r1", "y"), (3, "a", "r2", "z"), (4, "a", "r3", "z")]), blobs)
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "offer_id long")
    there = {"k1", "k2a", "k2b", "k3"}
    order = []

    def remove(key):
        order.append((key, s.read("audit").count()))
        if key == "k2b" and len(order) < 4:
            return False
        there.discard(key)
        return True

    # 1 is pointed at by 2; of 2 one blob stays, so its rows stay; the audit rows come before the first blob goes
    assert s.release("d1", ids(1, 2, 3), remove) == {"released": 2, "blocked": 1, "orphans": 1, "kept": 1}
    assert all(n == 2 for _, n in order) and there == {"k1", "k2b"}
    assert sorted(r["offer_id"] for r in s.read("filing").collect()) == [1, 2]
    assert s.read("alias").count() == 0 and sorted(r["source_ref"] for r in s.read("head").collect()) == ["r1", "r1"]
    assert s.release("d1", ids(1, 2, 3), remove)["kept"] == 0
    assert [r["offer_id"] for r in s.read("filing").collect()] == [1] and s.read("audit").count() == 2
    # the reference goes on from the revision that is left
    s.put("p2", offers(spark, [(5, "a", "r1", "w")]))
    assert [(r["revision_no"], r["previous_id"]) for r in s.read("filing").where("offer_id = 5").collect()] == [(2, 1)]
    assert s.release("d2", ids(5), lambda key: True, keep_row=True) == {"released": 1, "blocked": 0, "orphans": 0, "kept": 0}
    assert s.read("filing").count() == 2


def test_empty_batches(spark, tmp_path):
    s = store.Filings(spark, f"file://{tmp_path}/f")
    assert s.put("p", offers(spark, [])) and s.stored().count() == 0
    assert s.release("d", spark.createDataFrame([], "offer_id long"), lambda key: True)["released"] == 0
    o = store.Observations(spark, f"file://{tmp_path}/o")
    assert o.write("b", spark.createDataFrame([], OBS)).attempted == 0


def test_monthly_refresh(spark, tmp_path):
    from chronofold.operators import rollup
    from chronofold.operators.analytics import monthly_rollup

    rng = random.Random(1)
    rows = [(s, dt.datetime(2023, rng.randrange(1, 13), rng.randrange(1, 28)), T, rng.choice([None, float(rng.randrange(100))]), i) for i in range(300) for s in (1, 2)]
    every = spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, as_of timestamp_ntz, value double, event_id long")
    late = (F.col("event_id") % 4 == 0) & (F.month("ts") < 4)
    kept = rollup.Monthly(spark, f"file://{tmp_path}/m", buckets=5)
    kept.refresh(every.where(~late), kept.changed(every.where(~late)))
    before = {(r["series_id"], r["month"]): tuple(r) for r in kept.rows().collect()}
    months = kept.changed(every.where(late))
    assert months == [dt.datetime(2023, m, 1) for m in (1, 2, 3)]
    kept.refresh(every, months)
    kept.refresh(every, months)
    got, want = ({(r["series_id"], r["month"]): tuple(r) for r in x.collect()} for x in (kept.rows(), monthly_rollup(every)))
    assert got == want and all((got[k] == v) == (k[1].month > 3) or k[1].month < 4 for k, v in before.items())
    assert kept.refresh(every, []) == 0
    assert rollup.window_months(dt.datetime(2024, 3, 15, 7)) == [dt.datetime(2023, m, 1) for m in range(4, 13)] + [dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)]
    assert kept.changed(every, rollup.window_months(dt.datetime(2023, 6, 15))) == [dt.datetime(2023, m, 1) for m in range(1, 6)]
