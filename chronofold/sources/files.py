"""Sources and sinks on files: observation CSV, line manifests, seeds, blobs, envelopes."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions.hashing import filters_hash

OBSERVATION_CSV = "ts string, as_of string, value string, value_text string, quality_flag string, metadata string"
ZONE = r"(Z|[+-]\d{2}:\d{2})$"


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a CSV with a header, and ``error`` with the first rule a row breaks (null: none).

    Both times need a zone; exactly one of value and value_text; the flag defaults to 0; metadata is a JSON object.
    """
    header = spark.read.text(path).first()
    names = header[0].split(",") if header else []
    known = {f.split()[0] for f in OBSERVATION_CSV.split(", ")}
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).csv(path)
    for n in known - set(names):
        raw = raw.withColumn(n, F.lit(None).cast("string"))
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    value, meta = blank("value").try_cast("double"), F.coalesce(blank("metadata"), F.lit("{}"))
    flag = F.coalesce(blank("quality_flag"), F.lit("0")).try_cast("short")
    time = lambda c: F.when(F.col(c).rlike(ZONE), F.col(c).try_cast("timestamp"))
    error = (
        F.when(time("ts").isNull(), "ts").when(time("as_of").isNull(), "as_of").when(blank("value").isNotNull() & value.isNull(), "value")
        .when(value.isNull() == blank("value_text").isNull(), "value or value_text").when(flag.isNull(), "quality_flag").when(~F.coalesce(F.get_json_object(meta, "$").startswith("{"), F.lit(False)), "metadata")
    )
    return raw.select(time("ts").alias("ts"), time("as_of").alias("as_of"), value.alias("value"), blank("value_text").alias("value_text"), flag.alias("quality_flag"), meta.alias("metadata"), error.alias("error"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Canonical lines of a YAML manifest, in its order; a line without a required key is an error."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    lines = parse_yaml(text).get("lines") or {}
    rows = []
    for i, (code, line) in enumerate(lines.items()):
        missing = {"label", "statement_type"} - set(line)
        if missing:
            raise ValueError(f"{code} lacks {', '.join(sorted(missing))}")
        rows.append((i, code, line["label"], line["statement_type"], line.get("mapping")))
    return spark.createDataFrame(rows, "position int, code string, label string, statement_type string, mapping string")


def parse_yaml(text: str) -> dict:
    """Nested mappings of scalars and lists of mappings, which is all that manifests and seeds use; by PyYAML where it is there."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml:
        return yaml.safe_load(text) or {}
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent = len(body) - len(body.lstrip())
        item = body.lstrip().startswith("- ")
        while stack[-1][0] >= indent:
            stack.pop()
        if item:  # of a list, which hangs on the key above: a mapping or a scalar
            body = body.replace("- ", "  ", 1)
            parent = stack[-1][1]
            if not isinstance(parent.get(_ITEMS), list):
                parent[_ITEMS] = []
            if not re.search(r":(\s|$)", body):
                parent[_ITEMS].append(_scalar(body.strip()))
                continue
            parent[_ITEMS].append({})
            stack.append((indent, parent[_ITEMS][-1]))
        key, _, value = body.strip().partition(":")
        child = _scalar(value.strip()) if value.strip() else {}
        stack[-1][1][key.strip("'\"")] = child
        if isinstance(child, dict):
            stack.append((indent + 2 * item, child))
    return _lists(root)


_ITEMS = "- "
_WORDS = {"null": None, "~": None, "[]": [], "true": True, "false": False}


def _scalar(text: str):
    return _WORDS[text] if text in _WORDS else text.strip("'\"")


def _lists(value):
    if isinstance(value, dict):
        return [_lists(v) for v in value[_ITEMS]] if _ITEMS in value else {k: _lists(v) for k, v in value.items()}
    return value


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a YAML manifest: id, name, kind, licence and perhaps a base_url each; one without a required key is an error."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows = []
    for r in parse_yaml(text).get("sources") or []:
        missing = {"id", "name", "kind", "license_status"} - set(r)
        if missing:
            raise ValueError(f"a source lacks {', '.join(sorted(missing))}")
        rows.append((r["id"], r["name"], r["kind"], r.get("base_url"), r["license_status"]))
    return spark.createDataFrame(rows, "source_id string, name string, kind string, base_url string, license_status string")


def object_key(source: str, entity: str | None, day, filing: str, role: str, filename: str) -> str:
    """source/entity/YYYY/MM/DD/filing/role/filename; no entity is _unresolved."""
    return str(PurePosixPath(source, entity or "_unresolved", f"{day:%Y/%m/%d}", filing, role, PurePosixPath(filename).name))


class Blobs:
    """Bytes by key under a folder of any file system that Hadoop reaches. Deleting what isn't there is fine."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = lambda key: jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{key}".rstrip("/"))
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._spark, self._root = spark, root

    def put(self, key: str, data: bytes) -> str:
        out = self._fs.create(self._path(key), True)
        out.write(bytearray(data))
        out.close()
        return hashlib.sha256(data).hexdigest()

    def head(self, key: str) -> int | None:
        return self._fs.getFileStatus(self._path(key)).getLen() if self._fs.exists(self._path(key)) else None

    def delete(self, key: str) -> bool:
        return self._fs.delete(self._path(key), False)

    def scan(self) -> DataFrame:
        """All blobs. Paths are listed first, since readers skip folders that begin with an underscore."""
        found, it = [], self._fs.listFiles(self._path(""), True)
        while it.hasNext():
            found.append(it.next().getPath().toString())
        return self._spark.read.format("binaryFile").load(found)

    def release(self, keys: list[str]) -> int:
        """Delete all keys of a manifest; the number that stayed."""
        return sum(self.head(k) is not None for k in keys if not self.delete(k))


def envelope(df: DataFrame, metadata: dict) -> dict:
    """A page of rows with metadata and an entity tag; for results that a limit bounds."""
    data = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]
    body = json.dumps({"data": data, "metadata": metadata}, sort_keys=True, default=str)
    return {"data": data, "metadata": metadata, "etag": hashlib.sha256(body.encode()).hexdigest()[:32]}


SETTLED = dt.timedelta(minutes=5)


def cacheability(as_of: dt.datetime, now: dt.datetime) -> str:
    """Whether an answer for a point in time may be kept: for good once the point is five minutes old, since late rows have come by then; else only after asking again."""
    return "public, max-age=31536000, immutable" if now - as_of >= SETTLED else "no-cache, must-revalidate"


def encode_cursor(values: list, as_of: str, filters: dict) -> str:
    body = {"v": 1, "as_of": as_of, "anchor": values, "filters_hash": filters_hash(filters)}
    return base64.urlsafe_b64encode(json.dumps(body).encode()).decode()


def decode_cursor(cursor: str, filters: dict) -> list:
    body = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    if body.get("v") != 1 or body["filters_hash"] != filters_hash(filters):
        raise ValueError("the cursor belongs to other filters")
    return body["anchor"]


def beyond(df: DataFrame, columns: list[str], anchor: list) -> Column:
    """Whether a row comes after the anchor in the order of the columns; a leading - means descending. Nulls are last either way."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [c.lstrip("-") for c in columns]
    held = [F.lit(v).cast(types[c] if not isinstance(types[c], T.NullType) else "string") for c, v in zip(names, anchor, strict=True)]
    later, same = F.lit(False), F.lit(True)
    for spec, c, v in zip(columns, names, held, strict=True):
        further = F.col(c) < v if spec[0] == "-" else F.col(c) > v
        later = later | (same & v.isNotNull() & F.coalesce(further, F.lit(True)))
        same = same & F.col(c).eqNullSafe(v)
    return later


def after(df: DataFrame, columns: list[str], anchor: list) -> DataFrame:
    """The rows beyond the anchor."""
    return df.where(beyond(df, columns, anchor))
