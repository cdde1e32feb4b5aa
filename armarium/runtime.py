"""Session settings, shared storage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side that is only known at run time may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Rows of one key from which a join splits it, and rows of a part.
HOT_ROWS = 5_000


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the workers this package, wherever the driver found it; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_armarium_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir() and not str(root).endswith(".zip"):
        where = Path(tempfile.mkdtemp(prefix="armarium-")) / "armarium.zip"
        with zipfile.ZipFile(where, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(where))
    sc._armarium_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="armarium-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts its lineage.

    The table survives the loss of executors; it is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/armarium-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(value, F.lit(0).cast("bigint"), lambda a, x: a + _width(x, kind.elementType))
        return F.coalesce(each, F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialized df for broadcast if it has at most `rows` rows and `most` bytes; beyond that Spark shuffles it."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0)).cast("bigint")
    found = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if found[0] <= rows and found[1] <= most else df


def salted_join(left: DataFrame, right: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right on `key`, however often it stands in either: a key with over `rows` rows on a side is cut into parts.

    Rows of each side get a part of their key by hash; rows of the other side are repeated for each of these
    parts, so that every task meets at most about rows x rows pairs of a key. Sides are counted by
    partial sums; columns other than the key mustn't have names in common.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("__l")).join(right.groupBy(key).agg(F.count("*").alias("__r")), key)
    hot = materialize(counts.where((F.col("__l") > rows) | (F.col("__r") > rows)).select(key, F.ceil(F.col("__l") / rows).cast("int").alias("__nl"), F.ceil(F.col("__r") / rows).cast("int").alias("__nr")))
    if hot.isEmpty():
        return left.join(right, key)
    hot = small(hot)
    one = F.lit(1)

    def cut(df, own, other, a, b):
        row = F.xxhash64(*df.columns)
        d = df.join(hot, key, "left").withColumn(a, F.pmod(row, F.coalesce(own, one)).cast("int"))
        return d.withColumn(b, F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).drop("__nl", "__nr")

    return cut(left, F.col("__nl"), F.col("__nr"), "__a", "__b").join(cut(right, F.col("__nr"), F.col("__nl"), "__b", "__a"), [key, "__a", "__b"]).drop("__a", "__b")


def arrow_map(df: DataFrame, schema: str, per_batch: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """mapInArrow with a function from a batch to a dict of columns; dicts are put into the schema's order and types."""
    ship(df.sparkSession)
    wanted = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = per_batch(batch)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
