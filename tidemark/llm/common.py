"""What the operators of this package share: scratch tables, words, and global prefix sums."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every word contract: space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch on its way to Python: texts may be long, and each task holds a batch or two on either side.
BATCH_BYTES = 8 << 20


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends batches of about ``BATCH_BYTES`` to Python, unless it has a setting of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) in ("67108864", "64MB"):  # Spark's default
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def named(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until ``df`` has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def _unhashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _unhashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unhashable(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes that stand for a row: all of its columns, and which of them are null."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = named(f.name)
        parts += [F.to_json(F.struct(c)) if _unhashable(f.dataType) else c, c.isNull()]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (0, 1)]


#: Rows and bytes that Python works on at a time.
STEP_ROWS, STEP_BYTES = 512, 1 << 20


def slices(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Start and values (null: empty) of short runs of a binary column, bounded in rows and bytes."""
    rows: list[bytes] = []
    start = held = 0
    for i, v in enumerate(column):
        raw = v.as_py() or b""
        rows.append(raw)
        held += len(raw)
        if len(rows) >= STEP_ROWS or held >= most:
            yield start, rows
            rows, held, start = [], 0, i + 1
    if rows:
        yield start, rows


#: What gives back the memory that a worker process keeps from task to task, by the work that it is kept for.
_kept: dict[str, Callable[[], None]] = {}


def keeps(work: str, forget: Callable[[], None]) -> None:
    """For a task of a worker process: from now on it keeps what ``forget`` gives back, and no longer what it kept for other work. Workers outlive stages, and idle ones count in an executor's memory."""
    for other in [w for w in _kept if w != work]:
        _kept.pop(other)()
    _kept[work] = forget


def give_back() -> None:
    """Returns memory that isn't in use any more to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def computed(df: DataFrame, source: Column, added: list[T.StructField], begin: Callable[[], Callable], drop: tuple[str, ...] = (), most: int = STEP_BYTES) -> DataFrame:
    """``df`` without ``drop`` and columns named like ``added``, then ``added``, made in Python from the binary column ``source``.

    ``begin()`` is called once for each task and gives the function that makes a list of
    Arrow arrays, one for each of ``added``, from a list of values (null: empty) and a list
    that tells which of them are not null. Columns go to Python and back by position, so
    their names don't matter.
    """
    new = [f.name for f in added]
    names = [c for c in df.columns if c not in (*new, *drop)]
    kept = [named(c).alias(f"c{i}") for i, c in enumerate(names)]
    width = len(names)
    labels = [*(f"c{i}" for i in range(width)), *(f"a{i}" for i in range(len(new)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for batch in batches:
            known = batch.column(width).is_valid().to_pylist()
            for start, rows in slices(batch.column(width), most):
                made = work(rows, known[start : start + len(rows)])
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(rows)).columns[:width], *made], names=labels)
        batch = rows = made = None
        give_back()

    schema = T.StructType([*df.select(*kept).schema.fields, *(T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added))])
    return small_batches(df.select(*kept, source.cast("binary").alias("source"))).mapInArrow(run, schema).toDF(*names, *new)


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    That folder is shared by driver and executors. Only a local session may go
    without the setting; it gets a temporary folder, which is set as the
    checkpoint folder too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "tidemark-scratch")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


_roots: set[str] = set()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder for one written table; the application's tables go when its JVM ends, whether or not the session was stopped before."""
    root = scratch_root(spark)
    if root not in _roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _roots.add(root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


#: Bytes of a Parquet row group in scratch tables: a task that writes texts holds one in memory.
ROW_GROUP = 16 << 20


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: its lineage ends there.

    A lost executor costs a re-read, not a recomputation, and everything that
    depends on the order or the sampling inside ``df`` is settled once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys that may be broadcast: at 16 bytes each a few MB, whatever the input.
BROADCAST_KEYS = 200_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if ``rows``, its counted size, is within ``BROADCAST_KEYS``; else joins shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def trimmed(text: Column) -> Column:
    """The text without white space at its ends; empty for null."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    inner = trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def global_prefix(df: DataFrame, order: list[str], values: tuple[str, ...] = (), group: str | None = None) -> DataFrame:
    """Adds ``g_index`` (rank from 0) and, for each of ``values``, ``before_<value>`` (its sum in the rows before).

    Rows are ranked by ``order`` (ascending, nulls first) with ties broken arbitrarily,
    so rows that tie must be interchangeable for a reproducible result. With ``group``,
    the first column of ``order``, ranks and sums start anew in each group.

    The order is dealt out by range, with the row's position as the last tie-break, so
    that even equal rows go to several ranges. Each range reports its totals, these are
    summed up over the ranges, and the running sums inside a range are shifted by what
    came before it. The totals have a row for each range and group in it; their own
    prefix sums run over one group, or over as many rows as there are ranges.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = [group] if group else []
    ranged = cut(
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *order, "__tie")
        .withColumn("__part", F.spark_partition_id()),
        "ranged",
    )
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part", *key).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(f"__sum_{v}") for v in values])
    offsets = totals.select(
        F.col("__part").alias("__p"),
        *[F.col(k).alias("__g") for k in key],
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__off_{v}") for v, c in [("n", "__n"), *[(v, f"__sum_{v}") for v in values]]],
    )
    inner = Window.partitionBy("__part", *key).orderBy(*[c for c in order if c != group], "__tie")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.select("*", F.row_number().over(inner).alias("__rn"), *[F.sum(v).over(upto).alias(f"__run_{v}") for v in values])
    same = F.col("__part") == F.col("__p")
    if group:
        same &= F.col(group).eqNullSafe(F.col("__g"))
    return running.join(offsets, same).select(
        *df.columns,
        (F.col("__off_n") + F.col("__rn") - 1).alias("g_index"),
        *[(F.col(f"__off_{v}") + F.col(f"__run_{v}") - F.col(v)).cast(df.schema[v].dataType).alias(f"before_{v}") for v in values],
    )
