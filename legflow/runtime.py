"""Session-level helpers: shared scratch folder, lineage cuts, size-checked broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "legflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were planned for; every one can be overridden."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` where the cluster names one.

    Only where it is unset (local tests) a temporary folder of this machine is used.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="legflow-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def _to_go(spark: SparkSession, path: str) -> None:
    """The JVM removes the path when it ends, also after the session was stopped."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed with the tables of cut()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    _to_go(spark, path)
    _written.append((spark, path))
    return path


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends there, a lost executor costs nothing.

    Against checkpoint() the plan runs once rather than twice, and later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    _to_go(spark, path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@atexit.register
def drop_cuts() -> None:
    """Remove the tables cut() wrote in this process (also at exit)."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            pass


def broadcast_checked(df: DataFrame, max_rows: int) -> DataFrame | None:
    """`df` with a broadcast hint if it has at most `max_rows` rows, else None: the caller then joins another way.

    The count stops one row past the limit, so the check costs no more than the limit.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else None


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of the result are the left's."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(r[f"_r_{k}"])
        on = same if on is None else on & same
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])
