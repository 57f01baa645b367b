"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "gridwave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library relies on; ``conf`` adds to them."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary folder; on a cluster its absence
    is an error, because a machine-local folder dies with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith(("local[", "local ")) and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="gridwave-checkpoints-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without its history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as it ends; for what is not read again."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def keep_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Like ``cut_lineage``, as compressed columns: for tables of which later steps read a few columns each.

    The table stays in the shared folder, under ``path`` or a new one, until that is emptied or removed.
    """
    spark = df.sparkSession
    path = path or new_table_path(spark)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


def new_table_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete what was written under ``path`` once nothing reads it any more."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names: all executors reach it."""
    return ensure_checkpoint_dir(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python may not have it on its path; once for each application."""
    context = spark.sparkContext
    if _shipped.get("application") == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gridwave-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    # The driver serves the file; executors do not read the driver's folder.
    context.addPyFile(str(target))
    _shipped["application"] = context.applicationId


_shipped: dict[str, str] = {}
