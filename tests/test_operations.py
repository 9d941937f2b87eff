"""Counters of streams, operator reads, pages, seeds."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import dashboard, store
from chronofold.sources import files
from chronofold.streaming import events

T = dt.datetime(2024, 1, 1)
ID = "00000000-0000-4000-8000-{:012d}"


def message(i, kind="entity.created", version=1, event=None):
    fields = {"entity_id": "e", "entity_type": "company", "legal_name": f"N{i}", "primary_identifier_namespace": "isin", "primary_identifier_value": "x"}
    body = {"schema_version": version, "event_id": ID.format(i if event is None else event), "produced_at": f"2024-01-{1 + i % 20:02d}T00:00:00Z", "producer_run_id": 1, "source_id": "s", "kind": kind, **fields}
    return (f"{i}-0", json.dumps(body))


def test_counters_of_a_drain(spark, tmp_path):
    rows = [message(i) for i in range(12)] + [message(20 + i, event=i) for i in range(3)] + [message(40, version=9), message(41, kind="odd"), ("42-0", "{")]
    spark.createDataFrame(rows[:9], "message_id string, payload string").write.parquet(f"{tmp_path}/in")
    held = json.loads(rows[2][1]) | {"legal_name": "gone"}
    text = json.dumps(held)
    registry = spark.createDataFrame([(ID.format(2), text)], "event_id string, replacement string").withColumn("sha256", F.sha2("replacement", 256))
    args = (spark, f"{tmp_path}/in", "message_id string, payload string", f"{tmp_path}/sink", f"{tmp_path}/dead", f"{tmp_path}/ck", registry)
    first = events.drain(*args, counts=f"{tmp_path}/counts")
    assert first == {"messages": 9, "refused": 0, "events": 9, "duplicates": 0, "redacted": 1}
    spark.createDataFrame(rows[9:], "message_id string, payload string").write.mode("append").parquet(f"{tmp_path}/in")
    second = events.drain(*args, counts=f"{tmp_path}/counts")
    assert second == {"messages": 9, "refused": 3, "events": 6, "duplicates": 3, "redacted": 0}
    sums = {r["name"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/counts").groupBy("name").agg(F.sum("n").alias("n")).collect()}
    batch = events.parse(spark.createDataFrame(rows, "message_id string, payload string"))
    good, bad = events.split(batch)
    assert (sums["messages"], sums["refused"], sums["events"], sums["duplicates"]) == (batch.count(), bad.count(), good.count(), good.count() - good.select("event_id").distinct().count())
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 3 and spark.read.parquet(f"{tmp_path}/sink").count() == 12


def test_replacement_of_another_event(spark):
    e = spark.createDataFrame([("a", "p"), ("b", "p")], "event_id string, payload string")
    put = lambda text: spark.createDataFrame([("a", text)], "event_id string, replacement string").withColumn("sha256", F.sha2("replacement", 256))
    assert {r["event_id"]: r["payload"] for r in events.redacted(e, put('{"event_id":"a"}')).collect()} == {"a": '{"event_id":"a"}', "b": "p"}
    for text, strict in (('{"event_id":"b"}', False), ('{"event_id":"b"}', True), ("{}", True), ("no json", True)):
        with pytest.raises(Exception, match="another event"):
            events.redacted(e, put(text), strict).collect()
    assert events.redacted(e, put("{}")).where("payload = '{}'").count() == 1


def test_group_lag_brute_force(spark):
    rng = random.Random(2)
    messages = [(s, f"{rng.randrange(50)}-{i}") for s in "xyz" for i in range(25)]
    deliveries = [(s, g, rng.choice("cd"), m, rng.random() < 0.5) for s, m in messages for g in ("g1", "g2") if s != "z" and rng.random() < (0.4 if g == "g1" else 0.1)]
    got = events.group_lag(spark.createDataFrame(messages, "stream string, message_id string"), spark.createDataFrame(deliveries, "stream string, consumer_group string, consumer string, message_id string, acked boolean"))
    place = lambda m: tuple(map(int, m.split("-")))
    want = []
    for s, g in sorted({d[:2] for d in deliveries}):
        own = [d for d in deliveries if d[:2] == (s, g)]
        last = max((d[3] for d in own), key=place)
        open_ = sorted((d[3] for d in own if not d[4]), key=place)
        want.append((s, g, sum(place(m) > place(last) for t, m in messages if t == s), len(open_), open_[0] if open_ else None, open_[-1] if open_ else None, len({d[2] for d in own}), last))
    assert sorted(map(tuple, got.collect())) == want


def test_tail_and_letters(spark):
    x = spark.createDataFrame([("10-0",), ("9-5",), ("9-10",), ("100-0",)], "message_id string")
    assert [r[0] for r in events.tail(x, "9-6", 2).collect()] == ["9-10", "10-0"] and [r[0] for r in events.tail(x).collect()] == ["9-5", "9-10", "10-0", "100-0"]
    log = spark.createDataFrame([("f1", "a", T, "p"), ("f2", "a", None, "p"), ("f0", "b", T, "p")], "failure_id string, stream string, failed_at timestamp_ntz, payload string")
    assert [r["failure_id"] for r in events.letters_list(log).collect()] == ["f0", "f1", "f2"] and "payload" not in events.letters_list(log).columns
    assert [r["failure_id"] for r in events.letters_list(log, 1, "a").collect()] == ["f1"]


def test_pages(spark):
    state = spark.createDataFrame([(i, "s", f"e{i}", 1, T + dt.timedelta(days=i), T if i % 3 else None, 0, "secret") for i in range(9)], "outbox_id long, stream_name string, event_id string, schema_version int, created_at timestamp_ntz, published_at timestamp_ntz, failures long, last_error string")
    rows, pending = dashboard.outbox_page(state, limit=2, offset=1)
    assert [r["outbox_id"] for r in rows.collect()] == [7, 6] and "last_error" not in rows.columns and pending.first()["pending"] == 3
    registry = spark.createDataFrame([(f"e{i}", "art17", "s", T + dt.timedelta(days=i), "h", "o", "body") for i in range(3)], "event_id string, redaction_reason string, original_stream string, redacted_at timestamp_ntz, redacted_payload_hash string, original_payload_hash string, redacted_payload string")
    copies = spark.createDataFrame([("e2", "1-0", T), ("e2", "2-0", None), ("e0", "3-0", T), ("zz", "4-0", T)], "event_id string, message_id string, redacted_at timestamp_ntz")
    got = {r["event_id"]: (r["copies"], r["deleted"]) for r in dashboard.redactions_page(registry, copies, limit=2).collect()}
    assert got == {"e2": (2, 1), "e1": (0, 0)}
    filings = spark.createDataFrame([(1, "s", T), (2, "s", T), (3, "s", T - dt.timedelta(1))], "offer_id long, source_id string, published_at timestamp_ntz")
    attached = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "filing_id long, sha256 string")
    assert {r["offer_id"]: r["attachments"] for r in dashboard.documents_page(filings, attached, limit=2).collect()} == {1: 2, 2: 0}


def test_seeds(spark, tmp_path):
    d = store.Dimensions(spark, f"file://{tmp_path}/d")
    money = lambda *rows: spark.createDataFrame(rows, "currency_code string, name string, minor_unit int").coalesce(1)
    assert d.upsert("currency", money(("TRY", "Lira", 2), ("USD", "Dollar", 2), ("TRY", "Turkish lira", 2))) == {"created": 2, "changed": 0, "unchanged": 0}
    assert d.upsert("currency", money(("TRY", "Turkish lira", 2), ("USD", "US dollar", 2), ("JPY", "Yen", 0))) == {"created": 1, "changed": 1, "unchanged": 1}
    before = len(d.commits())
    assert d.upsert("currency", money(("JPY", "Yen", 0))) == {"created": 0, "changed": 0, "unchanged": 1} and len(d.commits()) == before
    assert sorted(map(tuple, d.read("currency").collect())) == [("JPY", "Yen", 0), ("TRY", "Turkish lira", 2), ("USD", "US dollar", 2)]
    snapshot = spark.createDataFrame([(1, "A", "T1", T, 2), (2, "B", None, None, 0)], d.tables["entity_snapshot"][0])
    assert d.replace("entity_snapshot", snapshot) == 2 and d.replace("entity_snapshot", snapshot.where("entity_id = 2")) == 1
    assert [r["entity_id"] for r in d.read("entity_snapshot").collect()] == [2]


def test_source_manifest(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("# sources\nsources:\n  - id: kap\n    name: 'Disclosure: platform'\n    kind: regulator\n    base_url: https://x.example/a\n    license_status: open\n  - id: evds\n    name: Data\n    kind: statistics\n    license_status: open\n")
    got = files.read_sources(spark, str(tmp_path / "s.yaml")).collect()
    assert [tuple(r) for r in got] == [("kap", "Disclosure: platform", "regulator", "https://x.example/a", "open"), ("evds", "Data", "statistics", None, "open")]
    assert store.Dimensions(spark, f"file://{tmp_path}/d").upsert("source", spark.createDataFrame(got)) == {"created": 2, "changed": 0, "unchanged": 0}
    (tmp_path / "t.yaml").write_text("sources:\n- id: kap\n  name: x\n")
    with pytest.raises(ValueError, match="license_status"):
        files.read_sources(spark, str(tmp_path / "t.yaml"))
    assert files.parse_yaml("a:\n  - x: 1\n    y:\n      z: 2\n  - x: 3\nb: 4\n") == {"a": [{"x": "1", "y": {"z": "2"}}, {"x": "3"}], "b": "4"} or files.parse_yaml("a: 1") == {"a": 1}


def test_processed_events(spark, tmp_path):
    p = store.Processed(spark, f"file://{tmp_path}/p", buckets=2)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "event_id string")
    assert p.done("b1", ids("a", "b", "a"), "s", "g") and not p.done("b1", ids("a"), "s", "g")
    p.done("b2", ids("b", "c"), "s", "g")
    left = lambda group: sorted(r["event_id"] for r in p.unseen(ids("a", "b", "c", "d"), "s", group).collect())
    assert left("g") == ["d"] and left("other") == ["a", "b", "c", "d"]
    assert p.clear("s", "g", "b", "ops") == 1 and p.clear("s", "g", "zz", "ops") == 0 and left("g") == ["b", "d"]
    assert sorted((r["event_id"], r["actor_id"]) for r in p.read("audit").collect()) == [("b", "ops"), ("zz", "ops")]
    assert p.read("processed").count() == 2


def test_links_and_sectors(spark, tmp_path):
    d = store.Dimensions(spark, f"file://{tmp_path}/d")
    link = lambda own: spark.createDataFrame([(1, 2, "subsidiary", T.date(), None, own)], d.tables["relationship"][0])
    assert [d.upsert("relationship", link(x)) for x in (0.5, 0.5, 0.6)] == [{"created": 1, "changed": 0, "unchanged": 0}, {"created": 0, "changed": 0, "unchanged": 1}, {"created": 0, "changed": 1, "unchanged": 0}]
    assert d.read("relationship").first()["ownership"] == 0.6
    assert d.upsert("entity_sector", spark.createDataFrame([(1, "x", T.date(), True)], d.tables["entity_sector"][0]))["created"] == 1


def test_json_documents(spark):
    from chronofold.functions import documents as D

    rows = ['{"a":1,"b":[1,{"c":"x","d":null}],"e":{"f":true}}', '["a","b",[1]]', '"a"', "{}", "[]", "no json", None, '{"a":"1","b":[]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")

    def plain(value, part):
        if isinstance(part, dict):
            return isinstance(value, dict) and all(k in value and plain(value[k], v) for k, v in part.items())
        if isinstance(part, list):
            return isinstance(value, list) and all(any(plain(v, x) for v in value) for x in part)
        return type(value) is type(part) and value == part

    def held(text, part):
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError:
            return False
        return plain(value, part) or (not isinstance(part, (dict, list)) and isinstance(value, list) and any(plain(v, part) for v in value))

    for part in ({"a": 1}, {"a": "1"}, {"b": [{"c": "x"}]}, {"b": [1]}, {"b": []}, {"e": {}}, {"e": {"f": True}}, {"b": [{"d": None}]}, ["a"], ["b", "a"], [[1]], [], {}, "a", 1, {"zz": None}):
        got = {r["i"]: r["x"] for r in df.select("i", D.contains(F.col("j"), part).alias("x")).collect()}
        assert got == {i: held(r, part) for i, r in enumerate(rows)}, part
    got = [r["x"] for r in df.orderBy("i").select(D.has_key(F.col("j"), "a").alias("x")).collect()]
    assert got == [True, True, False, False, False, False, None, True]
    one = df.where("i = 7").select(D.merged(F.col("j"), F.lit('{"b":{"k":2},"ş\\"":[1]}')).alias("m"), D.with_key(F.col("j"), "n", F.lit("[1,2]")).alias("n"), D.with_key(F.col("j"), "a", F.lit("null")).alias("o"), D.appended(F.col("j"), "b", "r2").alias("p")).first()
    assert json.loads(one["m"]) == {"a": "1", "b": {"k": 2}, 'ş"': [1]} and json.loads(one["n"]) == {"a": "1", "b": [], "n": [1, 2]} and json.loads(one["o"]) == {"a": None, "b": []} and json.loads(one["p"]) == {"a": "1", "b": ["r2"]}
    again = spark.createDataFrame([('{"republished_as":["r1"]}',), ("{}",)], "j string").select(D.appended(F.col("j"), "republished_as", "r1").alias("x")).collect()
    assert [json.loads(r["x"]) for r in again] == [{"republished_as": ["r1"]}] * 2
    assert df.where("i in (1, 5)").select(D.merged(F.col("j"), F.lit("{}")).alias("m")).where("m is not null").count() == 0


def test_cacheability():
    assert files.cacheability(T, T + dt.timedelta(minutes=5)).endswith("immutable") and files.cacheability(T, T + dt.timedelta(minutes=4)) == "no-cache, must-revalidate"


def test_manifest_and_derived_checks(spark, tmp_path):
    from chronofold.operators import mapping

    text = "lines:\n  is.revenue:\n    statement_type: is\n    aggregation_mode: pick_first\n    sources:\n      - x_Revenue\n      - x:Sales\n    formula: null\n    mutual_exclusion: []\n    derived_check: null\n  is.costs:\n    statement_type: is\n    aggregation_mode: sum_components\n    sources:\n      - x_C1\n      - x_C2\n    derived_check: null\n  is.gross:\n    statement_type: is\n    aggregation_mode: pick_first\n    sources:\n      - x_Gross\n    derived_check: \"is.revenue - is.costs\"\n  is.net:\n    statement_type: is\n    aggregation_mode: null\n    sources: []\n    formula: \"is.gross - is.costs\"\n    derived_check: \"is.gross\"\n"
    lines = mapping.from_manifest(files.parse_yaml(text))
    assert lines[0] == mapping.Line("is.revenue", "is", "pick_first", ("x_Revenue", "x:Sales")) and lines[2].check == "is.revenue - is.costs" and lines[3].sources == ()
    rows = [(1, "x_Revenue", 100.0), (1, "x_C1", 30.0), (1, "x_C2", 10.0), (1, "x_Gross", 60.5), (2, "x_Revenue", 100.0), (2, "x_Gross", 50.0), (3, "x_Gross", 0.0), (3, "x_C1", 0.0), (3, "x_Revenue", 0.0), (4, "other", 1.0)]
    values = mapping.canonical_values(spark.createDataFrame(rows, "entity_id int, line_code string, value double"), lines, ["entity_id"])
    got = {(r["entity_id"], r["canonical_code"]): (r["state"], r["delta_pct"]) for r in mapping.derived_checks(values, lines, ["entity_id"]).collect()}
    assert got[1, "is.gross"] == ("pass", pytest.approx(100 / 120)) and got[1, "is.net"][0] == "fail" and got[2, "is.gross"] == ("unknown", None) and got[3, "is.gross"] == ("pass", None) and (4, "is.gross") not in got
    assert mapping.derived_checks(values, lines[:2], ["entity_id"]).count() == 0
