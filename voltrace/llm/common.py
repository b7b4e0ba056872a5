"""Shared helpers: word rules, the shared scratch folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: The white space that all operators of this subpackage know (fixed values: space and U+0009 to U+000D).
SPACES = " \t\n\x0b\x0c\r"
#: A word in Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_SCRATCH: list[tuple[object, str]] = []
_collected = 0.0


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let texts go to Python workers at most `rows` at a time, which bounds the memory of both sides; a lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset (tests), a folder of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="voltrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/voltrace/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, codec: str | None = None, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. by: a column whose values become folders."""
    global _collected
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", codec) if codec else df.write
    (writer.partitionBy(by) if by else writer).parquet(path)
    if time.monotonic() - _collected > 2:
        spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of what has been written
        _collected = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_table = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_mark() -> int:
    """A mark to name what is written to the scratch folder from now on."""
    return len(_SCRATCH)


@atexit.register
def release_scratch(begin: int = 0, end: int | None = None, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that were written between two marks, but for those of keep; called at exit for all."""
    kept = {df.scratch_table for df in keep}
    for k in range(begin, len(_SCRATCH) if end is None else end):
        spark, path = _SCRATCH[k]
        if not path or path in kept:
            continue
        _SCRATCH[k] = (spark, "")
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended, or the folder is gone already
            pass


def with_scratch(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Give the result of build a method release(): it deletes the scratch tables that the result is read from, and is for the caller to call once the result is stored. Else they go at exit."""

    @wraps(build)
    def run(*args, **options) -> DataFrame:
        begin = scratch_mark()
        result = build(*args, **options)
        end = scratch_mark()
        result.release = lambda: release_scratch(begin, end)
        return result

    return run


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """Refuse ids that are not whole numbers, before any work is done."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{id_col} is {kind.simpleString()}; this operator orders and compares documents by whole-number ids")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Number of words in a text column; null counts as no words."""
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, n_rows: int, share: int = 1000) -> DataFrame:
    """Inner-join rows with one row per key where a few keys may hold most rows.

    Groups of more than n_rows/share rows number fewer than `share`, because their
    sizes add up to n_rows at most; these are broadcast, so hot keys are never
    shuffled. All other groups are joined by a shuffle in which no key is large.
    """
    limit = max(n_rows // share, 200)
    hot = F.broadcast(groups.filter(F.col(size_col) > limit))
    cold = groups.filter(F.col(size_col) <= limit)
    # rows of hot groups leave before the shuffle
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
