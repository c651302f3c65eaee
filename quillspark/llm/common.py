"""What the corpus operators share: word rules, the shared folder, row ids."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Least seconds between two returns of the driver's freed memory, which take a tenth of a second each.
GIVE_BACK_S = 3
_gave_back = 0.0
#: Most rows of an Arrow batch: whole texts travel, and both sides hold some batches at once.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run for mapInArrow; at its end the worker, which is used again, gives memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local
    master, where all run on one machine, may go without it and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def give_back(spark: SparkSession) -> None:
    """Returns memory that the driver's JVM has freed to the system, every GIVE_BACK_S seconds at most. The JVM
    compiles a plan's code in memory of glibc, which keeps what is freed: hundreds of plans leave
    hundreds of MB beside the heap. A JVM without that command goes on as it is."""
    global _gave_back
    if _gave_back and time.monotonic() - _gave_back < GIVE_BACK_S:
        return
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        args = gateway.new_array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass
    _gave_back = time.monotonic()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and what was
    computed survives the loss of executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold_case(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def native_words(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def in_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
