"""Reading tables and cutting lineage, the same way on a laptop and on a cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; their Python needs no copy of its own."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)


_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data directory, one file or a folder of parts."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that all executors share; a temporary one only in local mode."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _LOCAL, ignore_errors=True)
    return f"file://{_LOCAL}"


_LOCAL: str | None = None


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read on from there.

    The lineage ends there, so a lost executor costs no more than the step at hand; sizes are known
    to the planner afterwards. The tables of one application lie in one folder, see ``drop_cuts``.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/ledgerloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a result of ``cut`` that nothing reads any more, such as the last round's once this round's is written."""
    if path := getattr(df, "_cut_at", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` wrote in this application; results that read them end with it."""
    _delete(spark, f"{shared_dir(spark)}/ledgerloom-{spark.sparkContext.applicationId}")


#: A table of at most so many rows may be broadcast; of narrow rows these are some MB.
BROADCAST_ROWS = 50_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, written and counted: marked for broadcast if it has at most ``BROADCAST_ROWS`` rows, else joined by shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
