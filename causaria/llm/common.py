"""Shared pieces of the training-data operators: staging, words, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Edges at or below which one task may finish a component search: two longs each, 2 MB in all.
SMALL_EDGES = 50_000

#: Rows of two to five longs that may be broadcast: some 70 MB at most, checked by a count before the hint.
BROADCAST_ROWS = 1_000_000


_memos: list[dict] = []


def memo(d: dict) -> dict:
    """Registers a worker's table of words seen."""
    _memos.append(d)
    return d


def claim(*own: dict) -> None:
    """Empties all other operators' tables: a worker that serves several stages holds one stage's words at a time."""
    for d in _memos:
        if not any(d is o for o in own):
            d.clear()
    release()


def release() -> None:
    """Gives memory that Arrow and the C library hold free back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        where = f"file://{tempfile.mkdtemp(prefix='causaria-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, by exact name and first place, whatever else df has (Text beside text, or a name twice)."""
    found = [c.lower() for c in df.columns]
    if all(found.count(n.lower()) == 1 for n in names):
        return df.select(*names)
    at = [df.columns.index(n) for n in names]
    return numbered(df).select(*[F.col(f"__c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by place, so that no name clashes."""
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))])


def rows_by(df: DataFrame, run) -> DataFrame:
    """df after a function of its Arrow batches that leaves columns as they are."""
    d = numbered(df)
    return d.mapInArrow(run, d.schema).toDF(*df.columns)


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that this driver has staged and not yet dropped, in order.
_staged: list[str] = []


def mark() -> int:
    """Where the list of staged tables stands now, for dropped()."""
    return len(_staged)


def dropped(spark: SparkSession, since: int, until: int) -> None:
    """Deletes the tables staged from one mark up to another: nothing may read them any more."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _staged[since:until]:
        p = fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _staged[since:until]


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python sees, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it; beyond that the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def first_by_hash(df: DataFrame, key: str, rows: int, n: int) -> DataFrame:
    """The rows of df, of which there are n, with the smallest hashes of key, at most so many: a sample that reruns repeat.

    Where most rows can't be among them, those are left out before the top-k, so that what tasks send is bounded.
    """
    if n > 3 * rows:
        df = df.where(F.xxhash64(key) <= int(-(2**63) + 2**64 * 1.5 * rows / n))
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def union_find(pairs):
    """Smallest id reachable, for each id in pairs."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _finish(batches):
    import pyarrow as pa

    found = union_find((a, b) for x in batches for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (id, component): the smallest id reachable, for every id that an edge names.

    Rounds of contraction: each node moves to its neighbour of smallest hashed
    id, and edges are renamed and made distinct, so that the graph shrinks by a
    constant factor whatever its shape. No round gathers a group: the smallest
    neighbour is a partial aggregate, and hot nodes on the renaming join are
    split by AQE. The last SMALL_EDGES edges are finished in one bounded task.
    Self loops keep their node; null ids are dropped; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    nodes = None
    while True:
        edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if edges.count() <= SMALL_EDGES:
            break
        both = edges.union(edges.select(F.col("b"), F.col("a"))).where("a <> b")
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        to = both.groupBy(F.col("a").alias("id")).agg(F.min(key("b")).alias("m")).select("id", F.when(F.col("m") < key("id"), F.col("m.id")).otherwise(F.col("id")).alias("to"))
        to = staged(to)
        # Self loops that contraction leaves carry nothing; nodes are kept in the map.
        one = edges.where("a <> b").join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        lone = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("to"))
        step = to.union(lone.join(to, "id", "left_anti"))
        if nodes is None:
            nodes = staged(step)
        else:
            nodes = staged(nodes.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        edges = one.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    last = edges.coalesce(1).mapInArrow(_finish, "id long, component long")
    if nodes is None:
        return staged(last)
    full = nodes.join(last.select(F.col("id").alias("to"), "component"), "to", "left").select("id", F.coalesce("component", "to").alias("root"))
    full = staged(full)
    least = full.groupBy("root").agg(F.min("id").alias("component"))
    return staged(full.join(least, "root").select("id", "component"))
