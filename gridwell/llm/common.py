"""What the operators of this subpackage share: staged tables, ASCII lower-casing and connected components."""

from __future__ import annotations

import string
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a temporary one serves a local master; a
    cluster's executors could not read it, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='gridwell-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch while a table is written: a Python worker and its executor then hold few whole texts at a time.
BATCH_ROWS = 500
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: With this, Spark deletes the shuffle files of a write as it ends, and not when the driver happens to collect its garbage. They are of no more use then: the
#: table is read from its files.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes: dict = {"lock": threading.Lock(), "users": 0, "before": {}}


@contextmanager
def write_settings(spark: SparkSession):
    """Batches of BATCH_ROWS at most, and shuffle files that go with their write, within the block; the session's settings come back when the last such block
    ends."""
    with _writes["lock"]:
        if not _writes["users"]:
            _writes["before"] = {key: spark.conf.get(key, None) for key in (BATCH_KEY, CLEANUP_KEY)}
            if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
                spark.conf.set(BATCH_KEY, BATCH_ROWS)
            spark.conf.set(CLEANUP_KEY, "true")
        _writes["users"] += 1
    try:
        yield
    finally:
        with _writes["lock"]:
            _writes["users"] -= 1
            if not _writes["users"]:
                for key, value in _writes["before"].items():
                    if value is None:
                        spark.conf.unset(key)
                    else:
                        spark.conf.set(key, value)


class Scratch:
    """The tables that one run of an operator stages: Parquet in the shared folder, read again. That cuts the lineage, survives lost executors, and
    later plans know the size. The shuffle files of a write go as it ends; tables that nothing reads any more are deleted by release(), the others when the
    application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def stage(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/gridwell/{name}-{uuid.uuid4().hex}"
        with write_settings(self.spark):
            df.write.options(**options).parquet(path)
        folder, system = self._folder(path)
        system.deleteOnExit(folder)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of jobs that nothing refers to any more: it does so when the driver collects its garbage."""
        self.spark._jvm.System.gc()

    def release(self, *keep: DataFrame) -> None:
        """Deletes its tables but those to keep: what came of the others has been written itself."""
        left = []
        for table, path in self.tables:
            if any(table is k for k in keep):
                left.append((table, path))
            else:
                folder, system = self._folder(path)
                system.delete(folder, True)
        self.tables = left


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table of a scratch of its own, kept until the application ends."""
    return Scratch(df.sparkSession).stage(df, name, **options)


def file_bytes(df: DataFrame) -> int:
    """Size that the optimizer knows of a staged table: its files, which are compressed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def memory_bytes(df: DataFrame) -> int:
    """Bytes of the rows of a table of small files in memory, about: 8 a value, the bytes of strings, 32 an element of an array."""
    width: Column = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            width = width + F.coalesce(F.size(f.name), F.lit(0)) * 32
    return df.agg(F.sum(width)).first()[0] or 0


def maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint on a staged table that takes at most limit bytes in memory; else the table as it is, for a shuffled join."""
    return F.broadcast(df) if file_bytes(df) <= limit and memory_bytes(df) <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII strings, where lower() does just that, take its fast byte path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def py_ascii_lower(text: str, _table=str.maketrans(UPPER, LOWER)) -> str:
    return text.lower() if text.isascii() else text.translate(_table)


#: Edges that a task of connected_components contracts at a time.
EDGES = 1 << 20


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least): each node of the undirected edges that reaches a smaller one, and the smallest that it reaches. In a round every root next to a smaller
    one joins it, so at least half of a component's roots go."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    root = np.arange(len(nodes))
    while True:
        apart = root[a] != root[b]
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(further := root[root], root):
            root = further
    joined = root != np.arange(len(nodes))
    return nodes[joined], nodes[root[joined]]


def connected_components(edges: DataFrame, scratch: Scratch | None = None, *, src: str = "src", dst: str = "dst", rounds: int = 60, most: int = EDGES) -> DataFrame:
    """(node, component): for each node of the undirected edges the smallest node that it reaches.

    Tasks contract up to most edges at a time to stars, without a shuffle. If one task had all of them, that is the result. Else the two star operations of
    Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014), whose edge count never grows, connect what tasks have found: every node links
    its larger neighbours (large star), then its smaller ones (small star), to its smallest neighbour; then tasks contract again. A node's list is never
    gathered; only its minimum is, which Spark combines before the shuffle, and a hot node's rows join as an ordinary skewed join.
    Each round is written to the shared folder, the last one as a table of scratch. Edges whose ends are equal or null are left out.
    """
    spark = edges.sparkSession
    own = scratch or Scratch(spark)
    inner = Scratch(spark)
    pairs = inner.stage(edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v"), "cc")

    def contract(batches):
        held, waiting = 0, []

        def done():
            u, v = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(u, v)], names=["u", "v"])

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                if waiting and held + part.num_rows > most:
                    yield done()
                    held, waiting = 0, []
                waiting.append([part.column(k).to_numpy() for k in (0, 1)])
                held += part.num_rows
        if waiting:
            yield done()

    def star(e: DataFrame, large: bool) -> DataFrame:
        """e has (u, v) with u > v. Large: each node's larger neighbours go to its minimum; small: its smaller ones and itself."""
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    for _ in range(rounds):
        tasks = -(-pairs.count() // most)
        if not tasks:
            inner.release()
            return spark.createDataFrame([], "node long, component long")
        pairs = inner.stage(pairs.coalesce(tasks).mapInArrow(contract, "u long, v long"), "cc")
        inner.release(pairs)
        if tasks == 1:
            break
        # a star forest, which is the end: no leaf has two centres, and no node is both a leaf and a centre
        ends = pairs.select("u", F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionAll(pairs.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where(F.col("leaf") + F.col("centre") > 1).isEmpty():
            break
        pairs = inner.stage(star(star(pairs, True), False), "cc")
        inner.release(pairs)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    found = own.stage(out, "components")
    inner.release()
    return found


def slices(sizes: list[int], most: int):
    """(start, stop) of consecutive runs of rows whose sizes sum to at most most, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Memory(dict):
    """Words and their ids in two generations of at most size entries: when the young one is full it becomes the old one, so that
    what is still in use is carried over (recall) and the rest is forgotten."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def recall(self, wanted: set) -> list:
        """Of wanted, which are not in the young generation, takes over those in the old one and returns the others."""
        found = wanted & self.old.keys()
        self.update((w, self.old[w]) for w in found)
        return list(wanted - found)

    def full(self, more: int) -> bool:
        """Whether the young generation had to be emptied for more entries; what is wanted must then be gathered anew."""
        if len(self) + more <= self.size:
            return False
        self.old = dict(self)
        self.clear()
        return True


#: 64-bit words of a bit filter, whatever the input: 2 MB. More keys only make it less selective.
FILTER_WORDS = 1 << 18


def _slot(h: Column) -> tuple[Column, Column]:
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)).cast("int").alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))


def bit_filter(keys: DataFrame, h: str, scratch: Scratch) -> DataFrame:
    """(_word, _bits): a filter of fixed size over a column of 64-bit hashes."""
    word, bit = _slot(F.col(h))
    return scratch.stage(keys.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "bit-filter")


def split_by_filter(df: DataFrame, h: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be among the filter's keys, rows whose hash is not). The filter is broadcast; its size is fixed."""
    word, bit = _slot(F.col(h))
    probed = df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")
    return probed.where("_maybe").drop("_maybe"), probed.where("not _maybe").drop("_maybe")
