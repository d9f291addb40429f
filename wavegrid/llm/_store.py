"""Where intermediate tables live, and how Python code reaches the executors."""

from __future__ import annotations

import pickle
import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    import pyarrow as pa

_LOCAL: list[str] = []
#: id of a table's DataFrame -> (the DataFrame, path)
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def ship(name: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="wavegrid-"))
    return _LOCAL[0]


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value of bounded size; the returned function reads it on an executor, which needs no copy of this package."""
    box = spark.sparkContext.broadcast(zlib.compress(cloudpickle.dumps(value), 1))
    return lambda: pickle.loads(zlib.decompress(box.value))


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(id(t))[1])
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def drop_all() -> None:
    """Delete every table that ``materialise`` has written; for when the results built on them have been consumed."""
    drop(*[t for t, _ in _WRITTEN.values()])


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(table)] = table, path
    return table


def give_back(collect: bool = True) -> None:
    """Return a worker's freed memory to the system, as workers live on and later stages share their executor."""
    import ctypes
    import gc

    import pyarrow as pa

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bytes of a batch on its way from a worker to the JVM, about.
PART_BYTES = 1 << 20


def in_parts(t: pa.Table) -> pa.Table:
    """t in chunks of about PART_BYTES. Each travels as a batch of its own, which the JVM holds outside its heap; whole tables there leave gaps that it never returns."""
    import pyarrow as pa

    rows = max(1, t.num_rows * PART_BYTES // max(1, t.nbytes))
    return pa.concat_tables([t.slice(at, rows) for at in range(0, t.num_rows, rows)]) if t.num_rows > rows else t


def lean(f: Callable[[object, object], pa.Table]) -> Callable[[object, object], pa.Table]:
    """f, an Arrow function of groups, with its result in parts; a group of over a quarter of PART_BYTES gives its memory back."""

    def run(a, b):
        held = getattr(a, "nbytes", 0) + b.nbytes
        out = in_parts(f(a, b))
        if held > PART_BYTES // 4:
            give_back()
        return out

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ship(__name__)
