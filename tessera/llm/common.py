"""Helpers that the training-data operators share: the cluster's shared folder, written tables, sized joins."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters between words, for regular expressions; the same set as Python's ``bytes.split()``.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: Bytes, as counted, up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


#: Texts are long: what a Python worker and its task hold at a time stays small.
SMALL_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
_LOCK = threading.Lock()
_USERS: dict[str, int] = {}
_BEFORE: dict[str, str | None] = {}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few rows while the body runs; the first of several threads sets them and the last restores."""
    key, value = SMALL_BATCHES
    app = spark.sparkContext.applicationId
    with _LOCK:
        if not _USERS.get(app):
            _BEFORE[app] = spark.conf.get(key, None)
            spark.conf.set(key, value)
        _USERS[app] = _USERS.get(app, 0) + 1
    try:
        yield
    finally:
        with _LOCK:
            _USERS[app] -= 1
            if not _USERS[app]:
                old = _BEFORE.pop(app)
                spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a
    folder of its own; on a cluster that is an error, as executors would each write to their own disk."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-shared-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this application, all of which :func:`clean` deletes."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all tables this application has written, when no result that reads them is wanted any more."""
    remove_path(spark, f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs only a read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for t in tables:
        remove_path(t.sparkSession, t._tessera_path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """What Catalyst expects ``df`` to read, for choices that decide cost alone."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 50)


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df``, a table of flat columns, for broadcast only if its values are counted to take at most ``max_bytes``;
    else leave the join to Catalyst. It is counted by one aggregate, so it should be a written table."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    r = df.agg(F.count("*").alias("n"), *(F.sum(F.octet_length(c)).alias(f"b{i}") for i, c in enumerate(wide))).first()
    out = F.broadcast(df) if r[0] * 16 * (1 + len(df.columns)) + sum(x or 0 for x in r[1:]) <= max_bytes else df
    if hasattr(df, "_tessera_path"):
        out._tessera_path = df._tessera_path
    return out


def rows_of(src: DataFrame, kept: DataFrame) -> DataFrame:
    """The structs ``row`` of ``src(row, id, hash)``, spread into columns, whose (id, hash) is in ``kept(doc_id, hash,
    again)``, a written table; where ``again`` is set, several rows have both and one of them is returned."""
    same = lambda k: src["id"].eqNullSafe(k["doc_id"]) & (src["hash"] == k["hash"])
    one = bounded_broadcast(kept.where("not again"))
    out = src.join(one, same(one), "left_semi").select("row.*")
    more = kept.where("again")
    if more.isEmpty():
        return out
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(1)))
    return out.unionByName(src.join(more, same(more), "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))
