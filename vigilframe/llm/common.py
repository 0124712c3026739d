"""Helpers that the pipeline operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on bytes; UTF-8 bytes above 127 stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
_LOCAL: dict[str, str] = {}  # temporary folder of each local session without a shared one


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def without_spaces(col: Column) -> Column:
    """Deletes every character of [\\x20\\x09-\\x0D]; byte searches, no regular expression."""
    for c in SPACES:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, mod k; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def packed(docs: DataFrame, names: list[str] | tuple[str, ...] | None = None) -> Column:
    """The caller's columns as one struct `__row`: helper columns beside it cannot clash with any of their names."""
    return F.struct(*[F.col(f"`{c}`") for c in (docs.columns if names is None else names)]).alias("__row")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a temporary folder if the master is local, else an error:
    driver and executors of a cluster share no temporary folder. The session's settings stay as they are."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="vigilframe-")
        _LOCAL[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends at replicated files.

    A lost executor then costs a reread, not a recomputation, and the plan stays short in loops.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def materialize_seen(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """materialize(df), and what the aggregates `measures` give over its rows: they are counted as the rows are written, without a job of their own."""
    seen = Observation()
    out = materialize(df.observe(seen, *[m.alias(name) for name, m in measures.items()]))
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def relieve(spark: SparkSession, above: float = 0.0) -> None:
    """Lets driver and its JVM drop the plans, generated classes and buffers of finished jobs, before an operator of many short jobs adds its own.

    Only where the JVM's heap has grown beyond `above` of its limit; a collection then also gives memory back to the machine,
    and so do the C heaps of both processes, which keep what training and the compiler have freed.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() >= above * runtime.maxMemory():
        gc.collect()
        spark._jvm.System.gc()
        trim(spark)


def trim(spark: SparkSession) -> None:
    """Gives free pages of the C heaps of this process and of the JVM back to the machine, where C library and JVM can do that."""
    if freed := getattr(ctypes.CDLL(None), "malloc_trim", None):
        freed(0)
    jvm, command = spark._jvm, "systemTrimNativeHeap"  # what `jcmd PID System.trim_native_heap` calls
    beans, name = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    calls = {(m.getName(), m.getParameterCount()): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()}

    def call(method: str, *args):
        """By the interface, for the server's own class is not open to calls from here."""
        values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(args))
        for i, x in enumerate(args):
            values[i] = x
        return calls[method, len(args)].invoke(beans, values)

    if call("isRegistered", name) and any(op.getName() == command for op in call("getMBeanInfo", name).getOperations()):
        call("invoke", name, command, None, None)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with at most `most` bytes of `column` each, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows per Arrow batch than Spark's default of 10,000, unless the session has set a number of its own.

    Texts are long: batches of the default size take tens of megabytes in the executor and again in its Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by `keys`, the rows that agree in all of them, run by run; one run is in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        start = 0
        for i, v in enumerate(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)):
            if v != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, v
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
