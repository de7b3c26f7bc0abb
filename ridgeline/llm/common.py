"""What the corpus operators share: shared-folder tables, column naming and the word rule."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


CLEANUP, ARROW_ROWS, ARROW_BYTES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes of an Arrow batch while a working table is written.
MOST_ROWS, MOST_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back. Lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ridgeline-{name}-{uuid.uuid4().hex}"
    with small_batches(spark, **{CLEANUP: "true"}):  # once the table is there, nothing reads the shuffle files that made it
        df.write.parquet(path)
    atexit.register(_remove, spark, path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, **more: str):
    """Rows may be long texts: what runs inside moves them to Python MOST_ROWS and MOST_BYTES at a time."""
    rows = int(spark.conf.get(ARROW_ROWS))
    own = more | {ARROW_ROWS: str(min(rows, MOST_ROWS) if rows > 0 else MOST_ROWS), ARROW_BYTES: str(MOST_BYTES)}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_open: list[list[str]] = []


@contextlib.contextmanager
def working_tables(spark: SparkSession):
    """Frees what written() wrote inside, but for the tables that the function it gives is called with."""
    mine: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_folders(df))
        return df

    _open.append(mine)
    try:
        yield keep
    finally:
        _open.pop()
        for path in mine:
            if path.rsplit("/", 1)[-1] not in kept:
                _remove(spark, path)
            elif _open:
                _open[-1].append(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles()}


def remove(df: DataFrame) -> None:
    """Frees a table of written() that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that clash with none of df's, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def blank(c: Column | str) -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def text_bytes(c: Column | str) -> Column:
    return blank(c).cast("binary")


def n_words(c: Column | str) -> Column:
    return F.regexp_count(blank(c), F.lit(WORD)).cast("long")


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, rows: int = 512, carry: Sequence[str] = ()) -> DataFrame:
    """mapInArrow by column lists. make() runs once a task and returns the function over one slice of at most `rows` rows,
    so that a worker's memory follows the slice and not the Arrow batch. Columns in carry come as Arrow arrays, to be passed on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        f, names = make(), arrow.names
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = f({n: part.column(i) if n in carry else part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([_as(out[n], arrow.field(n).type) for n in names], schema=arrow)
        release()

    arrow = arrow_schema(schema)
    return df.mapInArrow(run, schema)


def _as(values: list | pa.Array, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        if values.type == kind:
            return values
        values = values.to_pylist()
    return pa.array(values, type=kind)


def release() -> None:
    """Gives free memory back to the system: Spark keeps idle Python workers, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
