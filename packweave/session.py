"""Session helpers: shared staging folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import atexit
import logging
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: A side is broadcast only if its optimiser estimate or its counted size is at most this.
BROADCAST_BYTES = 8 << 20

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share. Where it is unset, a session in local mode gets
    a temporary one; on a cluster that is an error, as executors couldn't read each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="packweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that ``release`` removes like a staged table."""
    path = f"{shared_dir(spark).rstrip('/')}/packweave/{label}-{uuid.uuid4().hex}"
    if not _own_dirs:
        atexit.register(release)
    _own_dirs[path] = label
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a compressed, columnar lineage cut.

    The written table outlives any executor. It is removed by ``release``, at the end of ``staging`` or when the Python
    driver ends; a failed write, at once.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    try:
        df.write.parquet(path)
    except BaseException:
        release([path])
        raise
    return spark.read.schema(df.schema).parquet(path)


def release(paths: list[str] | None = None) -> None:
    """Remove staged tables (all by default). What reads them can't be run any more. One that can't be removed is named
    in a warning and tried again at the end."""
    spark = SparkSession.getActiveSession()
    for path in list(_own_dirs if paths is None else paths):
        try:
            if spark is None and re.match("(file:)?/", path):  # the session has ended
                shutil.rmtree(re.sub("^file:(//)?", "", path), ignore_errors=True)
            else:
                jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
                jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
            _own_dirs.pop(path, None)
        except Exception as e:
            log.warning("staged table %s stays behind: %s", path, e)


@contextmanager
def staging() -> Iterator[None]:
    """Within it, results are made and written; the tables staged meanwhile are removed at its end."""
    held = set(_own_dirs)
    try:
        yield
    finally:
        release([p for p in _own_dirs if p not in held])


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of ``df``; far too large when unknown, which errs to the shuffled plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is within ``limit``, else unchanged (shuffled join)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


#: Most bytes of text of a model or configuration (a vocabulary, a gazetteer) that is sent to the executors.
MODEL_BYTES = 12 << 20


def model_rows(df: DataFrame, what: str, limit: int = MODEL_BYTES) -> list:
    """The rows of a small table of numbers and strings that is a model, not data; refused beyond ``limit`` bytes."""
    width = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    size = df.agg(F.sum(sum(width, F.lit(16 * len(width))))).first()[0] or 0
    if size > limit:
        raise ValueError(f"{what} has {size} bytes, more than {limit}")
    return df.collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
