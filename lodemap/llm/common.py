"""What the text operators share: blocks of rows inside Arrow batches, the shared folder, intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that one step inside a Python worker holds at once; a longer text makes a step of its own.
BLOCK_CHARS = 2_000_000
#: Bytes of an Arrow batch on its way to a Python worker, at most (one row at least). By default only rows are bounded, and
#: thousands of long texts at once cost each task hundreds of MB on both sides.
BATCH_BYTES = 4_000_000
#: Bytes of a table, at most, that is broadcast.
BROADCAST_BYTES = 32_000_000
#: Rows of a sample from which costs are estimated or a dictionary is trained, and the UTF-8 bytes of text it may hold.
SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets a
    temporary one; on a cluster that is an error, as no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir isn't set: the operators need a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodemap-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name under the shared one; the file system removes it when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lodemap-{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and lost executors take nothing with them."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._lodemap_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` has made and that nothing reads any more, and lets Spark drop the shuffle files behind
    them, which it keeps until the driver collects its garbage."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_lodemap_path", None)
        if path:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        trim(tables[0].sparkSession)


def trim(spark: SparkSession) -> None:
    """Hands memory that the driver has used and no longer needs back to the system, of Python and of the JVM. Their allocators
    keep it otherwise, outside the heap too, where each of many threads holds what its plans and buffers once took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(AttributeError, OSError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)
    with contextlib.suppress(Py4JError):  # a JVM without this command
        _command(spark, "systemTrimNativeHeap")


def _command(spark: SparkSession, name: str) -> str:
    """What a diagnostic command of the driver's JVM says."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    find = jvm.java.lang.Class.forName
    kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = find(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), name
    # by reflection on the interface: the server's own class isn't open
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    return find("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of ``BATCH_BYTES`` at most. The bound is a setting of the session; one that it has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def rest(spark: SparkSession) -> None:
    """Lets every executor collect its garbage and hand back the memory by which a shuffle-heavy step has grown its heap: the
    Python workers of the next step live in the same container, beside the heap."""
    slots = 4 * max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, slots, 1, slots).selectExpr("java_method('java.lang.System', 'gc') as done").collect()


def hinted(table: DataFrame, row_bytes: str) -> DataFrame:
    """The table with a broadcast hint if its rows, as ``row_bytes`` (SQL) estimates each, hold ``BROADCAST_BYTES`` at most;
    else as it is, for a join by a shuffle."""
    held = table.agg(F.expr(f"sum(cast({row_bytes} as long))")).first()[0] or 0
    return F.broadcast(table) if held <= BROADCAST_BYTES else table


def spread(df: DataFrame) -> int:
    """Partitions for an explicit ``repartition``: what the session uses for shuffles."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of at most ``most`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = [0 if n is None else n for n in pc.binary_length(column).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start, len(sizes) - start)


def utf8(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def strings(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def code_points(text: bytes, places: Iterable[int]) -> list[int]:
    """The numbers of the code points that begin at some places, ascending, of a UTF-8 text; the text is read once."""
    out, at, points = [], 0, 0
    for place in places:
        points += len(text[at:place].decode())
        at = place
        out.append(points)
    return out


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sampled(docs: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[bytes]:
    """A bounded sample: of the rows of least hash of key and text, those that ``most`` bytes hold; one that doesn't fit is
    passed over. Repeated keys are told apart by their texts, and copies of a row count once."""
    body = F.coalesce(F.col(text), F.lit("")).alias("__text")
    few = docs.select(F.xxhash64(key, text).alias("__at"), F.octet_length(body).alias("__n"))
    chosen, held = [], 0
    for row in few.orderBy("__at").limit(rows).collect():
        if held + row["__n"] <= most and row["__at"] not in chosen:
            held += row["__n"]
            chosen.append(row["__at"])
    found = docs.select(F.xxhash64(key, text).alias("__at"), body).where(F.col("__at").isin(chosen)).dropDuplicates(["__at"])
    return [r[0].encode() for r in found.orderBy("__at").select("__text").collect()]
