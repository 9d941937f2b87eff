"""What the operators share: durable cuts of a plan, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors reach.

    Where the setting is absent, a local session gets a temporary folder of its own
    and a cluster the warehouse, which is shared; never a machine-local folder there.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir") + "/_cuts"
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="chronofold-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Lineage ends here: a lost executor costs no recomputation of what is above, and
    later plans see the written rows only, whatever order the first run met them in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more: whatever was made from them is written itself."""
    for df in cuts:
        context = df.sparkSession.sparkContext
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def one_of(held: Column | str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of a value as text leaves the remainder; null for null."""
    held = F.col(held) if isinstance(held, str) else held
    return F.pmod(F.crc32(held.cast("string")), F.lit(modulus)) == remainder


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of ``edges`` the least node that it reaches.

    Each round hooks every node to its least neighbour and follows the pointers twice;
    both ends of the edges are then replaced and loops and repeats go, so the edges
    shrink geometrically. Every round ends in a written table.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = cut(e.union(e.select("b", "a")).distinct(), "cc-edges")
    labels = None
    while not e.isEmpty():
        hook = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).select(F.col("a").alias("x"), "p")
        first = hook = cut(hook, "cc-hook")
        for _ in range(2):
            up = hook.select(F.col("x").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p"))
        hook = cut(hook, "cc-jump")
        done = [first, hook, e, *([labels] if labels is not None else [])]
        labels = hook.select(F.col("x").alias("node"), F.col("p").alias("component")) if labels is None else labels.join(hook, labels.component == hook.x, "left").select("node", F.coalesce("p", "component").alias("component"))
        labels = cut(labels, "cc-labels")
        left = hook.select(F.col("x").alias("a"), F.col("p").alias("pa"))
        right = hook.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        e = e.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        e = cut(e, "cc-edges")
        drop_cut(*done)
    if labels is None:
        return edges.select(F.col(a).alias("node"), F.col(b).alias("component")).limit(0)
    return labels
