"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_scratch: dict[str, str] = {}
_shared: dict[tuple[str, str], tuple[str, object]] = {}


def session(app: str = "variscope", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster the caller brings its own session; nothing here is required.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        chosen = sc._jsc.sc().getCheckpointDir()
        named = chosen.get() if chosen.isDefined() else None
    if named:
        return f"{named.rstrip('/')}/variscope/{sc.applicationId}"
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_scratch:
        _local_scratch[sc.applicationId] = tempfile.mkdtemp(prefix="variscope-", dir="/tmp")
    return _local_scratch[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches or a loop: the plan stays short,
    the work is done once, a lost executor costs only the tasks it held, and the
    optimizer sees the true size of the table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def version(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of what a folder holds, as one short text.

    Tables kept for a folder are kept under its version, so changed inputs are read again.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    facts = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)
    return hashlib.sha256(repr(facts).encode()).hexdigest()[:16]


def shared_table(spark: SparkSession, key: str, build) -> tuple[str, StructType]:
    """Path and schema of ``build()``, written once per application and key."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _shared:
        df = build()
        path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        _shared[slot] = (path, df.schema)
    return _shared[slot]


def shared(spark: SparkSession, key: str, build) -> DataFrame:
    """Materialise ``build()`` once per application and reuse the written table."""
    path, schema = shared_table(spark, key, build)
    return spark.read.schema(schema).parquet(path)
