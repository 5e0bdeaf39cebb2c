"""What the operators share: tables, the shared folder, shipping of the package to the executors."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str, DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where the setting is absent (tests, local runs) one of our own is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(where)
        return where
    if not (where := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        where = f"file://{tempfile.mkdtemp(prefix='driftline-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run here go when it has ended: its result is written, and nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: lineage ends here and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    with _without_leftovers(df.sparkSession):
        return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again, so that later readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _without_leftovers(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.append((spark, path, out))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more."""
    for spark, path, out in [w for w in _written if any(w[2] is t for t in tables)]:
        _delete(spark, path)
        _written[:] = [w for w in _written if w[1] != path]


@atexit.register
def _forget_all() -> None:
    for spark, path, _ in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with it
            return


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that Python functions import it wherever the driver runs."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    to = os.path.join(tempfile.mkdtemp(prefix="driftline-"), "driftline_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "driftline").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def _released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, after which the worker gives freed memory back; idle workers of a stage stay beside those of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` of functions of this package, for columns of any name."""
    ship(df.sparkSession)
    names, f = df.columns, _released(f)
    if not any("." in n or "`" in n for n in names):
        return df.mapInArrow(f, schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(b.rename_columns(names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, schema)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def join_unequal(rows: DataFrame, table: DataFrame, name: str, how: str = "inner", floor: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each value of ``name`` once, however unequal the rows' are.

    Values of more than ``floor`` rows and more than a hundred-thousandth of all (so 100,000 values at most) are
    joined by broadcast, and the others as usual.
    """
    often = rows.where(column(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    often = checkpointed(often.where(F.col("n") > max(floor, rows.count() // 100_000)).select(name))
    if often.isEmpty():
        return rows.join(table, name, how)
    side = F.broadcast(often)
    some = rows.join(side, name, "left_semi").join(F.broadcast(table.join(side, name, "left_semi")), name, how)
    return some.unionByName(rows.join(side, name, "left_anti").join(table.join(side, name, "left_anti"), name, how))


def fields_of(df: DataFrame) -> list[str]:
    """The columns of a schema in words, with names quoted."""
    return [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema]


def kept_as(keep: tuple[str, ...], own: list[str]) -> tuple[str, ...]:
    """Names of kept columns beside the operator's ``own``: one that clashes gets underscores before it."""
    out: list[str] = []
    for k in keep:
        out.append(free_name([*own, *out], k))
    return tuple(out)


def chosen(keep: tuple[str, ...], names: tuple[str, ...]) -> list[Column]:
    return [column(k).alias(n) for k, n in zip(keep, names, strict=True)]


def integer_key(df: DataFrame, key: str) -> Column:
    """The key as a long; keys of other types have no order or number that the operator could use."""
    kind = df.select(column(key)).schema[0].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{key} is {kind.simpleString()}; an integer key is needed")
    return column(key).cast("long")


def identity(*columns: Column) -> Column:
    """128 bits that stand for the values of some columns: two hashes of different beginnings."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def row_identity(df: DataFrame) -> Column:
    """Stands for a whole row; repeated rows have one identity. Columns that cannot be hashed are left out."""
    names = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return identity(*map(column, names))


def only(rows: DataFrame, marks: DataFrame, name: str, salts: int = 16, small: int = 1_000_000) -> DataFrame:
    """The rows whose value of ``name`` is among the distinct ones of ``marks``, however frequent it is.

    Up to ``small`` marks (counted) go to every task; more are sent ``salts`` times, and rows dealt by salt as well.
    """
    if marks.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(marks), name, "left_semi")
    salt = free_name(rows.columns, "salt_")
    spread = marks.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*map(column, rows.columns)), F.lit(salts)).cast("int"))
    return dealt.join(spread, [name, salt], "left_semi").drop(salt)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column of the input has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def words_of(text):
    """Number of words of a text column (null and empty: 0); runs of anything but ``SPACE`` are words."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(kept == "", F.lit(0)).otherwise(F.size(F.split(kept, f"{SPACE}+"))).cast("long")
