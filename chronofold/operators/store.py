"""Tables that change by whole batches: append, merge and delete with a commit log.

Parquet has no transactions. Here a batch first writes its files, of one table or several, and then one small record
that names them; readers take the files that the records name. So the rows of a batch and their audit appear together or not at all, and a
batch that is repeated after a crash, wherever it stopped, adds nothing twice. A delete writes the touched files anew without the rows and
commits the exchange. One writer per store is assumed.

Tables are kept in buckets of a key's hash. A batch reads the buckets that its own keys fall into and no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronofold.operators import entities, ingest
from chronofold.operators.entities import Conflict
from chronofold.operators.temporal import first_per_key

BUCKET = "_bucket"


def digest(df: DataFrame) -> str:
    """A mark of the rows of a batch, whatever their order: number, sum and xor of their hashes."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return f"{r['n']}:{r['s'] or 0}:{r['x'] or 0}"


class Store:
    """Tables under ``root``. ``tables`` has the columns of each and the key that deals its rows into buckets."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, tuple[str, ...]]], buckets: int = 64):
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets
        self._records: dict[str, dict] = {}
        self._path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # The log
    def commits(self) -> list[dict]:
        """Records in order: id, digest, added files by table as (path, bucket), removed paths, note. They never change, so each is read once."""
        folder = self._path(f"{self.root}/_log")
        if not self._fs.exists(folder):
            return []
        names = sorted(p for s in self._fs.listStatus(folder) if (p := s.getPath().toString()).endswith(".json"))
        for name in names:
            if name not in self._records:
                stream = self._fs.open(self._path(name))
                self._records[name] = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
        return [self._records[n] for n in names]

    def committed(self, batch_id: str) -> dict | None:
        return next((c for c in self.commits() if c["id"] == batch_id), None)

    def _record(self, entry: dict) -> None:
        number = len(self.commits()) + 1
        name = self._path(f"{self.root}/_log/{number:012d}.json")
        draft = self._path(f"{self.root}/_log/_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            raise Conflict("another writer has committed meanwhile")

    def files(self, table: str, buckets: Sequence[int] | None = None) -> list[str]:
        held: dict[str, int] = {}
        for c in self.commits():
            held |= dict(c["add"].get(table, []))
            for path in c["remove"]:
                held.pop(path, None)
        return [p for p, b in held.items() if buckets is None or b in buckets]

    # Rows
    def bucket(self, *key: str | Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        files = self.files(table, buckets)
        schema = self.tables[table][0]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def touched(self, rows: DataFrame, *key: str) -> list[int]:
        """The buckets that keys fall into; at most ``buckets`` numbers."""
        return [r[0] for r in rows.select(self.bucket(*key)).distinct().collect()]

    def _written(self, table: str, rows: DataFrame) -> list[list]:
        schema, key = self.tables[table]
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema).fields]
        rows.select(*columns, self.bucket(*key).alias(BUCKET)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        found, it = [], self._fs.listFiles(self._path(path), True)
        while it.hasNext():
            if (p := it.next().getPath().toString()).endswith(".parquet"):
                found.append([p, int(p.rsplit(f"{BUCKET}=", 1)[1].split("/")[0])])
        return found

    def commit(self, batch_id: str, add: dict[str, DataFrame], *, remove: Sequence[str] = (), mark: str = "", note: dict | None = None) -> bool:
        """Write and record a batch; False if its id is recorded already. Another content under that id is an error."""
        held = self.committed(batch_id)
        if held:
            if held["digest"] != mark:
                raise Conflict(f"batch {batch_id} is there with other rows")
            return False
        self._record({"id": batch_id, "digest": mark, "add": {t: self._written(t, df) for t, df in add.items()}, "remove": list(remove), "note": note or {}})
        return True

    def delete(self, batch_id: str, gone: dict[str, DataFrame]) -> bool:
        """Delete rows by key, copy on write: ``gone`` has for each table rows of its bucket key and more columns to match all of. Only touched buckets are rewritten."""
        add, remove = {}, []
        for table, keys in gone.items():
            buckets = self.touched(keys, *self.tables[table][1])
            remove += self.files(table, buckets)
            add[table] = self.read(table, buckets).join(keys.distinct(), keys.columns, "left_anti")
        return self.commit(batch_id, add, remove=remove)

    def vacuum(self) -> int:
        """Delete files that no record holds: drafts of crashed batches and rewritten ones. Readers from before must have ended."""
        n = 0
        for table in self.tables:
            live, folder = set(self.files(table)), self._path(f"{self.root}/{table}")
            it = self._fs.listFiles(folder, True) if self._fs.exists(folder) else None
            while it is not None and it.hasNext():
                p = it.next().getPath()
                if p.toString().endswith(".parquet") and p.toString() not in live:
                    n += self._fs.delete(p, False)
        return n


def upsert(held: Store, table: str, rows: DataFrame) -> dict[str, int]:
    """Put rows, one for each key, in or over; how many were created, changed and unchanged. Only touched buckets are written anew, and none if nothing changes."""
    key = list(held.tables[table][1])
    rows = rows.persist()
    try:
        buckets = held.touched(rows, *key)
        current = held.read(table, buckets)
        found = {r["outcome"]: r["n"] for r in entities.changes(current, rows, key).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        counts = {k: found.get(k, 0) for k in ("created", "changed", "unchanged")}
        if counts["created"] or counts["changed"]:
            held.commit(uuid.uuid4().hex, {table: entities.upsert(current, rows, key)}, remove=held.files(table, buckets))
        return counts
    finally:
        rows.unpersist()


class Dimensions(Store):
    """Small reference tables that are seeded and seeded again: sources, currencies, sectors, who belongs to whom and to which sector, and a snapshot that is replaced whole."""

    #: Columns and key of each; fixed values where a surface names them.
    TABLES = {
        "source": ("source_id string, name string, kind string, base_url string, license_status string", ("source_id",)),
        "currency": ("currency_code string, name string, minor_unit int", ("currency_code",)),
        "sector": ("sector_id string, taxonomy string, code string, name_tr string, name_en string", ("sector_id",)),
        "relationship": ("parent_entity_id bigint, child_entity_id bigint, kind string, valid_from date, valid_to date, ownership double", ("parent_entity_id", "child_entity_id", "kind", "valid_from")),
        "entity_sector": ("entity_id bigint, sector_id string, valid_from date, is_primary boolean", ("entity_id", "sector_id", "valid_from")),
        "entity_snapshot": ("entity_id bigint, legal_name string, ticker string, last_filing timestamp_ntz, filings_30d bigint", ("entity_id",)),
    }

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4):
        super().__init__(spark, root, self.TABLES, buckets)

    def upsert(self, table: str, rows: DataFrame) -> dict[str, int]:
        """``upsert`` with the last of rows that have one key."""
        columns = StructType.fromDDL(self.tables[table][0]).fieldNames()
        numbered = rows.select(*columns, F.monotonically_increasing_id().alias("_n"))
        return upsert(self, table, first_per_key(numbered, self.tables[table][1], F.col("_n").desc()).drop("_n"))

    def replace(self, table: str, rows: DataFrame) -> int:
        """The whole table anew, in one commit; readers see the old one or the new one. Returns its rows."""
        self.commit(uuid.uuid4().hex, {table: rows}, remove=self.files(table))
        return self.read(table).count()


OBSERVATION_KEY = ("series_id", "ts", "as_of")
_OBSERVATION = "series_id bigint, ts timestamp_ntz, as_of timestamp_ntz, value double, value_text string, quality_flag smallint, payload_hash string"


class Observations(Store):
    """Observations with the audit of each batch: one row on the batch, and one for each of its keys."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        audit = "batch_id string, batch_size bigint, inserted bigint, unchanged bigint, min_ts timestamp_ntz, max_ts timestamp_ntz, min_as_of timestamp_ntz, max_as_of timestamp_ntz, attempted bigint, duplicates bigint"
        keys = "batch_id string, series_id bigint, ts timestamp_ntz, as_of timestamp_ntz, payload_hash string, action string"
        super().__init__(spark, root, {"observation": (_OBSERVATION, ("series_id",)), "batch": (audit, ("batch_id",)), "batch_key": (keys, ("series_id",))}, buckets)

    def write(self, batch_id: str, rows: DataFrame) -> ingest.Outcome:
        """Validate, compare with what is stored under the same keys, append and audit, in one commit.

        A broken rule, or a key with other content in the batch or the store, stops the batch before anything is
        written. A batch that was committed answers as it did then.
        """
        rows = rows.persist()
        try:
            mark = digest(rows)
            held = self.committed(batch_id)
            if held and held["digest"] == mark:
                return ingest.Outcome(**held["note"])
            broken = ingest.violations(rows).select("rule").first()
            if broken:
                raise ValueError(f"a row breaks the rule {broken['rule']}")
            stored = self.read("observation", self.touched(rows, "series_id"))
            fresh, outcome = ingest.write(rows, stored, OBSERVATION_KEY)
            done = ingest.compare(rows, stored, OBSERVATION_KEY)
            audit = ingest.batch_stats(rows, done, OBSERVATION_KEY).withColumn("batch_id", F.lit(batch_id))
            self.commit(batch_id, {"observation": fresh, "batch": audit, "batch_key": ingest.batch_keys(done, batch_id, OBSERVATION_KEY)}, mark=mark, note=asdict(outcome))
            return outcome
        finally:
            rows.unpersist()


class Filings(Store):
    """Filings by content, their aliases, and the newest revision under each reference; kept so that a batch of offers reads what it touches only."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        content = ("source_id", "sha256")
        super().__init__(spark, root, {
            "filing": ("offer_id bigint, source_id string, source_ref string, sha256 string, revision_no bigint, previous_id bigint", content),
            "alias": ("source_id string, sha256 string, ref string", content),
            "head": ("source_id string, source_ref string, revision_no bigint, offer_id bigint", ("source_id", "source_ref")),
            "blob": ("offer_id bigint, object_key string", ("offer_id",)),
            "audit": ("batch_id string, operation string, offer_id bigint, blobs bigint", ("offer_id",)),
        }, buckets)

    def put(self, batch_id: str, offers: DataFrame, blobs: DataFrame | None = None) -> bool:
        """Merge offers (offer_id, source_id, source_ref, sha256), numbered after all that are stored; False for a batch that was merged before.

        Known content under its own reference changes nothing, under another it adds an alias; new content is a first filing or the next revision
        of its reference. ``blobs`` (offer_id, object_key) are recorded for what is stored new.
        """
        offers = offers.select("offer_id", "source_id", "source_ref", "sha256").persist()
        try:
            contents = self.touched(offers, "source_id", "sha256")
            held = self.read("filing", contents).select("source_id", "sha256", F.col("source_ref").alias("canonical"))
            first = first_per_key(offers, ["source_id", "sha256"], F.col("offer_id"))
            new = first.join(held, ["source_id", "sha256"], "left_anti")
            heads = self.read("head", self.touched(offers, "source_id", "source_ref")).groupBy("source_id", "source_ref")
            heads = heads.agg(F.max("revision_no").alias("_last"), F.max_by("offer_id", "revision_no").alias("_last_id"))
            chain = Window.partitionBy("source_id", "source_ref").orderBy("offer_id")
            new = new.join(heads, ["source_id", "source_ref"], "left")
            new = new.withColumn("revision_no", F.coalesce("_last", F.lit(0)) + F.row_number().over(chain)).withColumn("previous_id", F.coalesce(F.lag("offer_id").over(chain), "_last_id")).drop("_last", "_last_id")
            canonical = held.unionByName(new.select("source_id", "sha256", F.col("source_ref").alias("canonical")))
            other = offers.join(canonical, ["source_id", "sha256"]).where("source_ref <> canonical").select("source_id", "sha256", F.col("source_ref").alias("ref")).distinct()
            alias = other.join(self.read("alias", contents), ["source_id", "sha256", "ref"], "left_anti")
            kept = new.select("offer_id")
            stored = {"filing": new, "alias": alias, "head": new.select("source_id", "source_ref", "revision_no", "offer_id")}
            if blobs is not None:
                stored["blob"] = blobs.join(kept, "offer_id", "left_semi")
            return self.commit(batch_id, stored, mark=digest(offers))
        finally:
            offers.unpersist()

    def stored(self) -> DataFrame:
        """All filings with their aliases, as ``documents.put_filings`` gives them for all offers at once."""
        aliases = self.read("alias").groupBy("source_id", "sha256").agg(F.array_sort(F.collect_set("ref")).alias("aliases"))
        out = self.read("filing").join(aliases, ["source_id", "sha256"], "left")
        return out.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("is_amendment", F.col("revision_no") > 1)

    def release(self, batch_id: str, ids: DataFrame, remove_blob, keep_row: bool = False) -> dict[str, int]:
        """Release filings (offer_id): an audit row of each first, then their blobs, then rows whose blobs all went, with aliases and heads.

        A filing that a later revision points at is not released. ``remove_blob(key)`` says whether the blob is gone; blobs go one by one
        from the driver, and a filing of which one stays keeps its rows. Returns released, blocked, kept and orphans (blobs that stayed).
        A repeated call goes on where the last one ended.
        """
        asked = ids.select("offer_id").distinct()
        filings = self.read("filing")
        later = filings.where("previous_id IS NOT NULL").select(F.col("previous_id").alias("offer_id"))
        wanted = filings.join(asked, "offer_id", "left_semi")
        free = wanted.join(later, "offer_id", "left_anti").persist()
        blobs = self.read("blob").join(free.select("offer_id"), "offer_id", "left_semi").persist()
        try:
            counts = {"released": free.count(), "blocked": wanted.count()}
            counts["blocked"] -= counts["released"]
            numbers = blobs.groupBy("offer_id").agg(F.count("*").alias("blobs"))
            audit = free.select("offer_id").join(numbers, "offer_id", "left").select(F.lit(batch_id).alias("batch_id"), F.lit("filing.release").alias("operation"), "offer_id", F.coalesce("blobs", F.lit(0)).alias("blobs"))
            if not self.committed(f"{batch_id}/audit"):
                self.commit(f"{batch_id}/audit", {"audit": audit})
            stayed = [(r["offer_id"], r["object_key"]) for r in blobs.toLocalIterator() if not remove_blob(r["object_key"])]
            stuck = self.spark.createDataFrame(stayed, "offer_id bigint, object_key string")
            counts["orphans"], counts["kept"] = len(stayed), len({i for i, _ in stayed})
            if keep_row or not counts["released"]:
                return counts
            gone = free.join(stuck.select("offer_id"), "offer_id", "left_anti").persist()
            contents = gone.select("source_id", "sha256")
            self.delete(f"{batch_id}/rows/{uuid.uuid4().hex}", {"filing": contents, "alias": contents, "head": gone.select("source_id", "source_ref", "revision_no"), "blob": gone.select("offer_id")})
            return counts
        finally:
            free.unpersist()
            blobs.unpersist()


class Processed(Store):
    """Which events each consumer group is done with, so that a repeated delivery is known; an operator may clear one for another delivery."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        super().__init__(spark, root, {
            "processed": ("stream string, consumer_group string, event_id string", ("event_id",)),
            "audit": ("stream string, consumer_group string, event_id string, actor_id string, cause string", ("event_id",)),
        }, buckets)

    def unseen(self, events: DataFrame, stream: str, group: str) -> DataFrame:
        """The events that the group isn't done with, one for each event_id."""
        mine = self.read("processed", self.touched(events, "event_id")).where((F.col("stream") == stream) & (F.col("consumer_group") == group))
        return events.dropDuplicates(["event_id"]).join(mine.select("event_id"), "event_id", "left_anti")

    def done(self, batch_id: str, events: DataFrame, stream: str, group: str) -> bool:
        """Events that the group is done with; a repeated batch adds nothing."""
        if self.committed(batch_id):
            return False
        new = self.unseen(events, stream, group).select(F.lit(stream).alias("stream"), F.lit(group).alias("consumer_group"), "event_id")
        return self.commit(batch_id, {"processed": new})

    def clear(self, stream: str, group: str, event_id: str, actor_id: str) -> int:
        """Forget one event, so that it may be delivered again: its audit row is committed first. Returns how many marks went."""
        one = self.spark.createDataFrame([(stream, group, event_id)], "stream string, consumer_group string, event_id string")
        self.commit(uuid.uuid4().hex, {"audit": one.select("*", F.lit(actor_id).alias("actor_id"), F.lit("processed_clear").alias("cause"))})
        held = self.read("processed", self.touched(one, "event_id")).join(one, one.columns, "left_semi").count()
        if held:
            self.delete(uuid.uuid4().hex, {"processed": one.select("event_id", "stream", "consumer_group")})
        return held
