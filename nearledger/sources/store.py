"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process made, for clear().
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, in local mode only, a temporary one, which is then set for the context."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        own = sc._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='nearledger-')}"
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def work_dir(spark: SparkSession, name: str = "work") -> str:
    """A fresh folder's name in the shared one."""
    MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: what is read several times is computed once, and survives lost executors."""
    at = work_dir(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing will read again."""
    for t in tables:
        at = t._stored_at
        _delete(t.sparkSession, at)
        if at in MADE:
            MADE.remove(at)


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are deleted at the end, whose results must have been written elsewhere by then."""
    before = set(MADE)
    try:
        yield
    finally:
        for at in [x for x in MADE if x not in before]:
            _delete(spark, at)
            MADE.remove(at)


def clear(spark: SparkSession) -> None:
    """Delete what this process has put into the shared folder. Results that still read from it must have been written elsewhere before."""
    while MADE:
        _delete(spark, MADE.pop())
