"""Session helpers: scratch tables in the shared folder, and imports on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def make_importable() -> None:
    """Send this package's functions by value when executors have no way to import it.

    With the repository on PYTHONPATH, or as the working directory, they import it by name.
    """
    import skipweave

    root = os.path.dirname(os.path.dirname(os.path.abspath(skipweave.__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known and os.path.abspath(os.getcwd()) != root:
        cloudpickle.register_pickle_by_value(skipweave)


def build_session(app: str = "skipweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; conf overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where the master is local and that is unset, one of this machine.

    On a cluster a machine's own folder would be another one for each executor, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_skipweave_dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="skipweave-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = "file://" + folder
            spark._skipweave_dir = base
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/skipweave-scratch/{tag}-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is planned and run within it leaves no shuffle files: Spark removes them when a query ends, and not only when its plan is collected as garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables; results that still read them must have been written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/skipweave-scratch")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
