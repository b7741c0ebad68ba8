"""Spark session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_app_dirs: set[str] = set()


def build_session(master: str = "local[*]", app: str = "sparkloom", **conf: str) -> SparkSession:
    """Session for local work; on a cluster pass the cluster's own session instead."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """Fresh path in the application's own folder, which goes when the application ends."""
    app = f"{work_dir(spark)}/sparkloom-{spark.sparkContext.applicationId}"
    if app not in _app_dirs:
        folder = spark._jvm.org.apache.hadoop.fs.Path(app)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _app_dirs.add(app)
    return f"{app}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table", **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage of iterative jobs, survives the loss of executors, and
    gives the planner the real size of the table, so that later joins broadcast
    it only when it is small. ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, without running anything."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def materialise_bucketed(df: DataFrame, keys: list[str], buckets: int, dealt: bool = False) -> DataFrame:
    """Like :func:`materialise`, hashed into buckets: joins on ``keys`` need no shuffle of it.

    Rows that are ``dealt`` by the keys already are written where they are.
    """
    spark = df.sparkSession
    name = f"sparkloom_{uuid.uuid4().hex}"
    (
        (df if dealt else df.repartition(buckets, *keys))  # one file per bucket
        .write.bucketBy(buckets, *keys).sortBy(*keys)
        .option("path", new_path(spark, "buckets"))
        .saveAsTable(name)
    )
    return spark.table(name)
