"""Small helpers that the text operators share."""

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks that the contracts strip and split at: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch where whole documents pass through Python. Spark's own 10,000 of them are
#: held as Arrow, as strings and as numbers at once, in the JVM's direct memory and in every worker.
BATCH_ROWS = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-returnwise-"), "returnwise.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)


def short_batches(spark: SparkSession) -> None:
    """Have this session deal at most ``BATCH_ROWS`` rows to Python at a time; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_ROWS_SETTING)) <= BATCH_ROWS:  # 0 or less: no limit
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the column as text, modulo ``divisor``; NULL for NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def held_out(column: str, divisor: int, rest: int) -> Column:
    """Rows kept out of learning. A row without an id is held out: nothing is learned from it."""
    return F.coalesce(remainder(column, divisor) == F.lit(rest), F.lit(True))


def by_batch(
    start: Callable[[], Callable], kind: pa.DataType, ddl: str, arguments: int = 1, rows: int | None = None
):
    """A column function from lists of values to a list of values.

    ``start`` runs once in each task and returns the function that is applied to every batch: with
    one list for each argument, it returns one value for each row. With ``rows``, for one argument,
    a batch is worked on so many rows at a time, which bounds the Python objects alive at once.
    """
    if rows is not None:

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            work = start()
            for batch in batches:
                parts = [
                    pa.array(work(batch.slice(at, rows).to_pylist()), type=kind)
                    for at in range(0, len(batch), rows)
                ]
                yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    elif arguments == 1:

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            work = start()
            for batch in batches:
                yield pa.array(work(batch.to_pylist()), type=kind)

    else:

        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            work = start()
            for batch in batches:
                yield pa.array(work(*(x.to_pylist() for x in batch)), type=kind)

    return F.arrow_udf(run, ddl)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
