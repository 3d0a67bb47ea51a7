"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A hot key is split into so many parts where tables meet on it.
PARTS = 32

#: Bits of the filter that ``sifted`` sends to every task, in words of 64.
SLOTS = 2**23

#: Where each stored table that is still in use lies.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: The tables that the innermost run under way has stored.
_own: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("own", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder of this machine is made and set
    for the session, if the session is local; on a cluster that is an error, since
    each executor would write to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, place: str) -> None:
    files, path = _file_system(spark, place)
    files.delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as Parquet in the shared folder, and read again.

    Cuts the lineage: an executor that is lost later takes nothing with it, and
    values that a task made up (such as its own number) stay as first written.
    The table goes with ``drop``, at the end of the ``run`` that it belongs to, or
    when the driver ends.
    """
    spark = frame.sparkSession
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _own.get()) is not None:
        own.append((spark, place))
    files, path = _file_system(spark, place)
    files.mkdirs(path)
    files.deleteOnExit(path)
    frame.write.mode("overwrite").option("compression", "zstd").parquet(place)
    again = spark.read.schema(frame.schema).parquet(place)
    _places[again] = place
    return again


def drop(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these tables, which nothing may read again."""
    for table in tables:
        _delete(table.sparkSession, _places.pop(table))
    if tables:
        release(tables[0].sparkSession)


def run(name: str):
    """For a function that returns a frame: a run that cleans up after itself.

    Its result is stored under ``name``. All else that it stored on the way is deleted
    when the result is there, and all of it when the function fails. Runs nest: the
    result belongs to the run around it.
    """

    def of(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(function)
        def whole(*args, **kwargs) -> DataFrame:
            own: list[tuple[SparkSession, str]] = []
            token, result = _own.set(own), None
            try:
                result = stored(function(*args, **kwargs), name)
                return result
            finally:
                _own.reset(token)
                kept = result is not None and _places[result]
                for spark, place in own:
                    if place != kept:
                        _delete(spark, place)
                    elif (outer := _own.get()) is not None:
                        outer.append((spark, place))
                if own:
                    release(own[0][0])

        return whole

    return of


def fields(documents: DataFrame) -> list[Column]:
    """The columns of ``documents`` out of a column ``row`` that holds them all."""
    return [F.col("row").getField(c).alias(c) for c in documents.columns]


def left_out(documents: DataFrame, gone: DataFrame, key: Callable[[Column], list[Column]]) -> DataFrame:
    """The rows of ``documents`` whose ``key`` is not a row of ``gone``; null equals null.

    The columns go along in one struct, so that none of their names can clash.
    """
    rows = documents.select(F.struct("*").alias("row"))
    gone = gone.toDF(*[f"gone{i}" for i in range(len(gone.columns))])
    on = [k.eqNullSafe(F.col(c)) for k, c in zip(key(F.col("row")), gone.columns, strict=True)]
    return rows.join(gone, on, "left_anti").select(fields(documents))


def salted(many: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, which has each key once, without a hot key.

    The rows of a key go to different parts by the column ``by``; each part has its own
    copy of the row of ``few``. A null key matches nothing.
    """
    part = F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")
    copies = few.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])))
    return many.withColumn("part", part).join(copies, [*keys, "part"], how).drop("part")


def sifted(many: DataFrame, few: DataFrame, key: Column, of: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of ``many`` whose ``key`` may be among the keys ``of`` ``few``, and the other rows.

    Keys, of the same type, are hashed to SLOTS bits, which go to every task whatever the
    number of keys. No row with a key of ``few`` is among the others, so only the first
    need be dealt out for a join. Null is a key like any other.
    """
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(SLOTS))
    words = stored(
        few.select(slot(of).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("sift_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("sift_bits")),
        "sift",
    )
    told = many.join(F.broadcast(words), F.shiftright(slot(key), 6) == F.col("sift_word"), "left")
    bit = F.lit(1).cast("bigint").bitwiseAND(
        F.call_function("shiftrightunsigned", F.col("sift_bits"), slot(key).bitwiseAND(F.lit(63)).cast("int"))
    )
    may = F.coalesce(bit == 1, F.lit(False))
    return tuple(told.filter(x).drop("sift_word", "sift_bits") for x in (may, ~may))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    Inside a lambda of a higher-order function an expression would be worked out
    again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str = "text") -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def remainder(key: str, n: int) -> Column:
    """crc32 of a column as text, modulo ``n``; null for null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def arrow_map(
    frame: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (made := rows(batch)) is not None:
                yield made

    return frame.mapInArrow(run, schema)
