"""Tables that cut lineage, written where every executor can read them.

The folder is the one that the cluster names in ``spark.checkpoint.dir``.
Only where that is unset *and* the master is local, as in tests, a folder
of our own is used and noted in the session.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_live: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{KEY} must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="fragmatch-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(KEY, f"file://{own}")
    return f"file://{own}"


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    What is read again has no lineage to recompute and known sizes, so that
    Spark can tell from them which joins may broadcast.
    """
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # type: ignore[attr-defined]
    return out


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one for what a query writes in a form of its own; deleted at exit like saved tables, or by ``forget``."""
    path = f"{shared_dir(spark)}/fragmatch/{uuid.uuid4().hex}"
    if not _live:
        atexit.register(_forget_all)
    _live.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _forget_all() -> None:
    """At exit: delete what is left of this process's tables, as far as a session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        forget(spark, live(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*saved: DataFrame) -> None:
    """Delete tables made by ``save`` that nothing will read again."""
    for df in saved:
        path = getattr(df, "_scratch_path", None)
        spark = df.sparkSession
        live = _live.get(spark.sparkContext.applicationId, [])
        if path in live:
            live.remove(path)
            _delete(spark, path)


def live(spark: SparkSession) -> set[str]:
    """Paths of the tables that ``save`` made in this application and that still exist."""
    return set(_live.get(spark.sparkContext.applicationId, []))


def forget(spark: SparkSession, paths: set[str]) -> None:
    """Delete the tables at ``paths``, as far as ``save`` made them."""
    mine = _live.get(spark.sparkContext.applicationId, [])
    for path in paths & set(mine):
        mine.remove(path)
        _delete(spark, path)
