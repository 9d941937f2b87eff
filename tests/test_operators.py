"""Traps of the domain's semantics, each on a few rows."""

import datetime as dt
import math
import struct

import hashlib

import pytest
from pyspark.sql import functions as F

from chronofold.functions import hashing, personal, text
from chronofold.operators import analytics, documents, entities, ingest, quality, temporal
from chronofold.schemas import REGISTRY, Fact
from chronofold.sources import files

OBS = "series_id long, ts timestamp_ntz, as_of timestamp_ntz, value double, event_id long"


def t(text):
    return dt.datetime.fromisoformat(text)


def observations(spark, rows):
    return spark.createDataFrame([(1, t(ts), t(as_of), v, i) for i, (ts, as_of, v) in enumerate(rows)], OBS)


def test_pit_takes_the_version_known_then(spark):
    df = observations(spark, [("2024-08-01", "2024-08-01T13:10:00", 100.0), ("2024-08-01", "2024-08-02T09:00:00", 200.0), ("2024-08-01", "2024-08-05T11:00:00", 300.0)])
    at = lambda p: [r["value"] for r in temporal.pit(df, "observation", p).collect()]
    assert at("2024-08-03 00:00:00") == [200.0] and at("2024-07-01 00:00:00") == [] and at("2024-08-05 11:00:00") == [300.0] and at(None) == [300.0]


def test_pit_takes_times_with_a_zone(spark):
    rows = [(1, "A", 1, t("2024-01-01T10:00:00"), t("2024-01-01T12:30:00"), 1)]
    df = spark.createDataFrame(rows, "filing_id long, event_type string, event_seq int, as_of timestamp_ntz, superseded_at timestamp_ntz, row_no long")
    at = dt.datetime(2024, 1, 1, 15, tzinfo=dt.timezone(dt.timedelta(hours=3)))
    assert temporal.pit(df, "filing_event", at).count() == 1
    assert temporal.pit(df, "filing_event", at + dt.timedelta(hours=1)).count() == 0
    with pytest.raises(ValueError):
        temporal.pit(df, "filing_event", "' OR 1=1")


def test_pit_splits_at_the_microsecond(spark):
    df = observations(spark, [("2024-08-01", "2024-08-01T00:00:00.654320", 1.0), ("2024-08-01", "2024-08-01T00:00:00.654321", 2.0)])
    assert temporal.pit(df, "observation", "2024-08-01 00:00:00.654320").first()["value"] == 1.0
    assert temporal.pit(df, "observation", "2024-08-01 00:00:00.654321").first()["value"] == 2.0


def test_pit_filter_stays_below_the_window(spark, sf):
    from chronofold.sources import projections

    plan = temporal.pit(projections.observation(spark, sf), "observation", "2024-01-15 00:00:00").where("series_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(user_id), LessThanOrEqual(ts," in plan or "EqualTo(user_id,3)" in plan


def test_latest_prefers_the_newer_ts(spark):
    df = observations(spark, [("2024-08-02", "2024-08-02T10:00:00", 2.0), ("2024-08-01", "2024-08-09T10:00:00", 1.0)])
    assert temporal.latest(df).first()["value"] == 2.0


def test_range_is_half_open_and_counts_collapsed_rows(spark):
    df = observations(spark, [("2024-08-01", "2024-08-01T10:00:00", 1.0), ("2024-08-01", "2024-08-02T10:00:00", 1.5), ("2024-08-02", "2024-08-02T10:00:00", 2.0), ("2024-08-03", "2024-08-03T10:00:00", 3.0)])
    got = temporal.series_range(df, "2024-08-01 00:00:00", "2024-08-03 00:00:00", limit=2).collect()
    assert [r["value"] for r in got] == [1.5, 2.0]


def test_deleted_rows_go_before_the_collapse(spark):
    rows = [(1, "updated", t("2024-01-01"), 1), (1, "deleted", t("2024-01-02"), 2)]
    df = spark.createDataFrame(rows, "entity_id long, event_kind string, as_of timestamp_ntz, row_no long")
    assert temporal.pit(df, "entity_version", "2024-02-01 00:00:00").first()["event_kind"] == "updated"
    assert temporal.pit(df, "entity_version", "2024-02-01 00:00:00", hide_deleted=True).count() == 0


def test_superseded_lets_an_older_one_surface(spark):
    rows = [(1, "A", 1, t("2024-01-01"), None, 1), (1, "A", 1, t("2024-01-02"), t("2024-01-03"), 2)]
    df = spark.createDataFrame(rows, "filing_id long, event_type string, event_seq int, as_of timestamp_ntz, superseded_at timestamp_ntz, row_no long")
    assert temporal.pit(df, "filing_event", "2024-01-02 12:00:00").first()["row_no"] == 2
    assert temporal.pit(df, "filing_event", "2024-02-01 00:00:00").first()["row_no"] == 1
    assert temporal.current(df, "filing_event").first()["row_no"] == 1


def test_interval_keeps_all_versions(spark):
    df = observations(spark, [("2024-08-01", "2024-08-01T00:00:00", 1.0), ("2024-08-01", "2024-08-02T00:00:00", 2.0), ("2024-08-01", "2024-08-03T00:00:00", 3.0)])
    got = temporal.interval(df, "observation", "2024-08-01 00:00:00", "2024-08-03 00:00:00").orderBy(*temporal.chain_order("observation"))
    assert [r["value"] for r in got.collect()] == [1.0, 2.0]


def test_parsing_of_times():
    now = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    assert temporal.parse_as_of(None, now) == now
    assert temporal.parse_as_of("2023-12-31T00:00:00Z", now).year == 2023
    for bad in ("2023-12-31T00:00:00", "2024-01-01T00:02:00Z", "yesterday"):
        with pytest.raises(ValueError):
            temporal.parse_as_of(bad, now)
    assert temporal.parse_range("[2023-01-01T00:00:00Z,2023-01-02T00:00:00Z)")
    for bad in ("[2023-01-02T00:00:00Z,2023-01-01T00:00:00Z)", "(2023-01-01T00:00:00Z,2023-01-02T00:00:00Z)", "[2010-01-01T00:00:00Z,2023-01-02T00:00:00Z)", "[2023-01-01T00:00:00,2023-01-02T00:00:00)"):
        with pytest.raises(ValueError):
            temporal.parse_range(bad)
    with pytest.raises(ValueError):
        temporal.parse_range("[2023-01-01T00:00:00Z,2023-01-02T00:00:00Z)", as_of="x")


def test_capture_of_disclosures(spark):
    schema = "disclosure_id string, has_body boolean, parent_id string, title string"
    old = spark.createDataFrame([("a", False, None, "x"), ("b", True, None, "x"), ("c", True, None, "x"), ("d", True, None, "x"), ("e", True, None, "x")], schema)
    new = spark.createDataFrame([("a", True, "p", "x"), ("b", True, "p", "x"), ("c", True, None, "y"), ("d", True, None, "x"), ("f", False, None, "x")], schema)
    got = {r["disclosure_id"]: r["event_kind"] for r in temporal.capture(old, new, "disclosure_id", temporal.disclosure_kind(), "2024-01-01 00:00:00").collect()}
    assert got == {"a": "body_fetched", "b": "republished", "c": "updated", "e": "deleted", "f": "created"}


def test_ohlcv_first_of_the_day_and_null_is_zero(spark):
    rows = [(1, "price_open", t("2024-01-01T09:00:00"), 5.0, 1), (1, "price_open", t("2024-01-01T10:00:00"), 6.0, 2), (1, "volume", t("2024-01-01T09:00:00"), None, 3)]
    r = analytics.ohlcv(spark.createDataFrame(rows, "entity_id long, metric string, ts timestamp_ntz, value double, event_id long"), "2024-01-01", "2024-01-01").first()
    assert (r["price_open"], r["volume"], r["price_close"]) == (5.0, 0.0, None)


def test_compare_guards(spark):
    for bad in ([], [1, 1], list(range(11))):
        with pytest.raises(ValueError):
            analytics.compare_metric(None, bad, "x")


def test_masking(spark):
    df = spark.createDataFrame([('{"a":"x","b":"y"}',)], "p string")
    assert df.select(analytics.masked(F.col("p"), ["b"])).first()[0] == '{"a":"x","b":"<REDACTED:b>"}'
    assert df.select(analytics.masked(F.col("p"), ["b"], True)).first()[0] == '{"a":"x","b":"y"}'


def test_identifier_ranges(spark):
    schema = "identifier_id long, entity_id long, namespace string, value string, valid_from date, valid_to date, is_primary boolean"
    d = dt.date
    rows = [(1, 1, "t", "X", d(2020, 1, 1), d(2021, 1, 1), True), (2, 2, "t", "X", d(2021, 1, 1), d(9999, 12, 31), True), (3, 3, "t", "X", d(2020, 5, 1), d(2020, 5, 1), True)]
    ids = spark.createDataFrame(rows, schema)
    assert entities.overlaps(ids).count() == 0 and entities.overlapping_values(ids).count() == 0
    assert entities.resolve_one(ids, "t", "X", "2020-12-31") == 1 and entities.resolve_one(ids, "t", "X", "2021-01-01") == 2
    with pytest.raises(entities.Missing):
        entities.resolve_one(ids, "t", "Y", "2021-01-01")
    new = spark.createDataFrame([(4, 9, "t", "X", d(2022, 1, 1), d(2023, 1, 1), False)], schema)
    with pytest.raises(entities.Conflict):
        entities.add_identifier(ids, new)
    ended = entities.expire_identifier(ids, "t", "X", "2021-06-01")
    assert entities.add_identifier(ended, new).count() == 4


def test_trigram_similarity(spark):
    df = spark.createDataFrame([("word", "two words", 4 / 11), ("a", "a", 1.0), ("", "", 0.0), ("abc", "xyz", 0.0)], "a string, b string, s double")
    for r in df.withColumn("got", text.similarity(F.col("a"), F.col("b"))).collect():
        assert r["got"] == pytest.approx(r["s"])


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(text.truncated_ip(lit("10.1.2.3"))) == "10.1.2.0/24"
    assert one(text.truncated_ip(lit("2001:db8:1:2::5"))) == "2001:db8:1::/48"
    assert one(text.truncated_ip(lit("2001:db8::5"))) == "2001:db8::/48"
    assert [one(text.truncated_ip(lit(x))) for x in ("::1", "2001::5", "2001:0:1::", "2001:DB8:0:0:1::")] == ["::/48", "2001::/48", "2001:0:1::/48", "2001:db8::/48"]
    assert one(text.truncated_ip(lit(None).cast("string"))) == "<no client_ip>"
    assert [one(text.age(lit(x))) for x in (-5.0, 0.4, 59.9, 60.0, 192.0, 3599.0, 8000.0, 86399.0, 86400.0, 615600.0)] == ["0s", "0s", "59s", "1m 0s", "3m 12s", "59m 59s", "2h 13m", "23h 59m", "1d 0h", "7d 3h"]
    assert [one(text.size(lit(x))) for x in (0, 1023, 1280, 1500, 1024**2 - 1, 1024**2, 4_300_000, 3_700_000_000)] == ["0 B", "1023 B", "1.2 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "4.1 MB", "3.4 GB"]
    assert one(text.id_prefix(lit("123456789"))) == "12345678…"
    assert one(text.next_message_id(lit("5-18446744073709551615"))) == "6-0" and one(text.next_message_id(lit("5-9"))) == "5-10"
    assert one(text.as_json(lit(""))) == "null"
    assert one(text.as_json(lit('{"a":1}'))) == '{"a":1}' and one(text.as_json(lit('no "json'))) == '"no \\"json"'
    assert one(text.tax_number(lit("123-456-7890"))) == "1234567890" and one(text.tax_number(lit("123"))) is None


def test_payload_hash_keeps_bits(spark):
    values = [0.0, -0.0, math.nan, 5e-324, math.inf, -math.inf, None, 1.5]
    df = spark.createDataFrame([(v, None if v is not None else "x", 0, '{"b":1,"a":"é"}') for v in values], "value double, text string, flag int, meta string")
    got = df.select(hashing.payload_hash(*[F.col(c) for c in df.columns]).alias("h"), hashing.value_bits(F.col("value")).alias("b")).collect()
    assert len({r["h"] for r in got}) == len(values)
    assert [r["b"] and bytes(r["b"]) for r in got] == [None if v is None else struct.pack(">d", v) for v in values]
    assert hashing.payload_digest(1.5, None, 0, '{"a":"é","b":1}') == hashing.payload_digest(1.5, None, 0, '{"b":1,"a":"e\u0301"}')
    rows = [("1", "2", "3"), ("0", "2", "3")]
    assert hashing.batch_hash(42, rows) == hashing.batch_hash(42, rows[::-1]) != hashing.batch_hash(43, rows)
    assert hashing.batch_hash(42, rows) != hashing.batch_hash(42, [("1", "2", "4"), ("0", "2", "3")])
    raw = (42).to_bytes(8, "big") + b"".join(len(x).to_bytes(4, "big") + x.encode() for r in sorted(rows) for x in r)
    assert hashing.batch_hash(42, rows) == hashlib.sha256(raw).hexdigest()


def test_ingest_conflicts(spark):
    schema = "series_id long, ts long, as_of long, payload_hash string"
    stored = spark.createDataFrame([(1, 1, 1, "a")], schema)
    fresh, outcome = ingest.write(spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b"), (1, 2, 1, "b")], schema), stored)
    assert (outcome.attempted, outcome.inserted, outcome.unchanged, outcome.duplicates, outcome.updated) == (3, 1, 1, 1, 0) and fresh.count() == 1
    for bad in ([(1, 1, 1, "z")], [(1, 3, 1, "x"), (1, 3, 1, "y")]):
        with pytest.raises(entities.Conflict):
            ingest.write(spark.createDataFrame(bad, schema), stored)


def test_filings(spark):
    rows = [(1, "s", "r1", "A"), (2, "s", "r2", "A"), (3, "s", "r1", "B"), (4, "s", "r1", "A"), (5, "z", "r1", "A")]
    stored = documents.put_filings(spark.createDataFrame(rows, "offer_id long, source_id string, source_ref string, sha256 string"))
    got = {r["offer_id"]: (r["revision_no"], r["previous_id"], r["is_amendment"], r["aliases"]) for r in stored.collect()}
    assert got == {1: (1, None, False, ["r2"]), 3: (2, 1, True, []), 5: (1, None, False, [])}
    assert {(r["source_id"], r["ref"]): r["offer_id"] for r in documents.find_by_ref(stored).collect()} == {("s", "r1"): 3, ("s", "r2"): 1, ("z", "r1"): 5}
    assert [r["offer_id"] for r in documents.amendment_chain(stored, 1).collect()] == [1, 3]
    assert {r["offer_id"] for r in documents.releasable(stored).collect()} == {3, 5}


def test_restatement_rules(spark):
    d = dt.date(2024, 3, 31)
    old = dt.date(2020, 3, 31)
    rows = [(1, 1, "is.1", d), (2, 2, "mon", old), (2, 2, "is.1", old), (3, 3, "inf.x", old), (4, 4, "is.1", d), (5, 5, "is.1", old)]
    lines = spark.createDataFrame(rows, "entity_id long, filing_id long, line_code string, period_end date")
    got = {(r["filing_id"], r["line_code"]): r["derivation_reason"][:2] for r in quality.derive_basis(lines, spark.createDataFrame([(1,)], "entity_id long"), "mon", "inf%").collect()}
    assert got == {(1, "is.1"): "P0", (2, "mon"): "P1", (2, "is.1"): "P1", (3, "inf.x"): "P2", (4, "is.1"): "P3", (5, "is.1"): "P4"}


def test_invariants_fail_and_pass(spark):
    fact = Fact("x", ("k",))
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "k long, as_of long")
    got = {r["name"]: (r["violations"], r["status"]) for r in quality.report({"dup": quality.duplicates(df, fact), "none": df.limit(0)}).collect()}
    assert got == {"dup": (1, "FAIL"), "none": (0, "ok")}
    assert len(REGISTRY) == 8


def test_personal_data(spark):
    value = {"subjects": ["x@y.com"], "a": [{"b": "İrem Yıldız wrote to x@y.com"}], "7": 1}
    leaves = list(personal.walk(value))
    assert leaves == [(("a", 0, "b"), "İrem Yıldız wrote to x@y.com")] and personal.json_path(leaves[0][0]) == "$.a[0].b"
    found = personal.matches(leaves[0][1])
    assert personal.scrub(leaves[0][1], found) == "[REDACTED:Art.17:name] wrote to [REDACTED:Art.17:email]"
    assert personal.numeric_keys(value) and not personal.numeric_keys({"a": [1]})
    assert personal.redact({"a": [{"b": 1, "c": 2}]}, "a.0.b") == {"a": [{"b": "<redacted>", "c": 2}]}
    assert personal.concerns("İrem", ["i\u0307rem yıldız"]) and not personal.concerns("Ali", ["Veli"])
    spark.udtf.register("scan_json", personal.ScanJson)
    got = spark.sql("""SELECT * FROM scan_json('{"a": ["to x@y.com"]}')""").collect()
    assert [tuple(r) for r in got] == [("$.a[0]", "email", 3, 10, "x@y.com")]


def test_csv_and_manifest(spark, tmp_path):
    (tmp_path / "o.csv").write_text("ts,as_of,value,value_text,quality_flag,metadata\n2024-01-01T00:00:00Z,2024-01-01T00:00:00Z,1.5,,,\n2024-01-01T00:00:00,2024-01-01T00:00:00Z,1.5,,,\n2024-01-01T00:00:00Z,2024-01-01T00:00:00Z,1.5,x,,\n2024-01-01T00:00:00Z,2024-01-01T00:00:00Z,abc,,,\n")
    got = files.read_observations(spark, f"{tmp_path}/o.csv").collect()
    assert sorted(str(r["error"]) for r in got) == ["None", "ts", "value", "value or value_text"]
    (tmp_path / "m.yaml").write_text("lines:\n  is.Revenue:\n    label: Revenue\n    statement_type: is\n  bs.Cash:\n    label: Cash\n    statement_type: bs\n")
    assert [r["code"] for r in files.read_manifest(spark, f"{tmp_path}/m.yaml").orderBy("position").collect()] == ["is.Revenue", "bs.Cash"]
    (tmp_path / "b.yaml").write_text("lines:\n  x:\n    label: X\n")
    with pytest.raises(ValueError):
        files.read_manifest(spark, f"{tmp_path}/b.yaml")


def test_blobs_cursor_envelope(spark, tmp_path):
    b = files.Blobs(spark, f"file://{tmp_path}/blobs")
    key = files.object_key("src", None, dt.date(2024, 1, 2), "f1", "body", "../x.pdf")
    assert key == "src/_unresolved/2024/01/02/f1/body/x.pdf"
    b.put(key, b"abc")
    assert b.head(key) == 3 and b.scan().count() == 1 and b.release([key, "no/such"]) == 0 and b.head(key) is None
    cursor = files.encode_cursor([5], "now", {"a": 1})
    assert files.decode_cursor(cursor, {"a": 1}) == [5]
    with pytest.raises(ValueError):
        files.decode_cursor(cursor, {"a": 2})
    assert [r["id"] for r in files.after(spark.range(8), ["id"], [5]).collect()] == [6, 7]
    mixed = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "a"), (None, "c")], "n int, s string")
    assert [tuple(r) for r in files.after(mixed, ["-n", "s"], [2, "a"]).collect()] == [(1, "a"), (2, "b"), (None, "c")]
    page = files.envelope(spark.range(2), {"as_of": "x"})
    assert page["data"] == [{"id": 0}, {"id": 1}] and len(page["etag"]) == 32


def test_personal_patterns():
    from chronofold.functions import personal

    found = lambda t: [(k, t[a:b]) for k, a, b in personal.matches(t)]
    assert found("mail a@b.c now") == [("email", "a@b.c")]
    assert found("by John  A. Doe and İrem Yıldız") == [("name", "John  A. Doe"), ("name", "İrem Yıldız")]
    assert found("exec.compensation.opaque") == [] and found("John") == []


def test_research_filters(spark, sf):
    from chronofold.plans import research
    from chronofold.sources import projections as P

    whole = research.observations(P.observation(spark, sf), P.series_catalog(spark, sf), research.Read(as_of="2024-01-20 00:00:00"))
    code = whole.first()["series_code"]
    kept = {(r["series_id"], r["ts"]) for r in whole.where((F.col("series_code") == code) & F.col("ts").between("2024-01-03", "2024-01-10")).collect()}
    q = research.Read(as_of="2024-01-20 00:00:00", closed={"ts": ("2024-01-03", "2024-01-10")})
    assert {(r["series_id"], r["ts"]) for r in research.observations(P.observation(spark, sf), P.series_catalog(spark, sf), q, code).collect()} == kept
    events = research.events(P.filing_event(spark, sf), research.Read(as_of="2024-01-15 12:00:00"))
    one = research.events(P.filing_event(spark, sf), research.Read(as_of="2024-01-15 12:00:00", equal={"event_type": "A", "entity_id": 7}))
    assert one.count() == events.where("event_type = 'A' and entity_id = 7").count()
