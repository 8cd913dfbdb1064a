"""Session settings the operators rely on, and where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options on a running session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", name: str = "crewframe", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        # call sites per column cost more than small queries themselves
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="crewframe-checkpoint-")
    context.setCheckpointDir(fallback)
    return fallback


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/crewframe/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Store the rows as a table in the shared folder, in folders ``by`` column, and go on from there.

    A lost executor then does not replay the rounds before, the rows are computed once, and the
    planner knows their size.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.partitionBy(*by).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(spark: SparkSession, *stored: DataFrame | str) -> None:
    """Delete tables of :func:`cut`, or folders of :func:`scratch`, that nothing reads any more."""
    for item in stored:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(item if isinstance(item, str) else item.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_crewframe_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    bundle = os.path.join(tempfile.mkdtemp(prefix="crewframe-package-"), "crewframe.zip")
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(bundle)
    context._crewframe_shipped = True
