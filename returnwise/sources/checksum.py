"""Content pins: a source file is accepted only when its SHA-256 is the expected one."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnwise.session import materialise

#: Bytes above which a file is hashed as it is read, rather than held whole.
STREAMED = 64 << 20
#: Names that Spark's line reader would unpack; such files are held whole, 2 GB at most.
PACKED = r"(?i)\.(gz|deflate|bz2|lz4|snappy|zst|passthrough)$"
#: Lines of an Arrow batch of a file that is hashed as it is read.
LINES = 1000


class ChecksumMismatch(ValueError):
    """A source file's content is not the pinned content."""


def file_checksums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SHA-256 and size of each file, hashed where it is read, in one task a file.

    Files over ``STREAMED`` bytes go through that task line by line, so no file need fit in memory; a
    single line must, and be under 2 GB. Spark's readers list no file of zero bytes, so neither does this.
    """
    found = spark.read.format("binaryFile").load(path)
    checksums = found.where(_held_whole()).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
    if found.where(~_held_whole()).select("length").isEmpty():
        return checksums
    return checksums.unionByName(materialise(_streamed(spark, path), into=spark))


def _held_whole() -> Column:
    """By what is known of a file before it is read, so that the others are not opened at all."""
    return (F.col("_metadata.file_size") <= STREAMED) | F.col("_metadata.file_name").rlike(PACKED)


def _streamed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same of the large files, in a session of its own that deals every file to one task."""
    apart = spark.newSession()
    for name, value in (
        # Opening is made out to cost as much as a partition may hold: nothing is split or put together.
        ("spark.sql.files.maxPartitionBytes", 1 << 46),
        ("spark.sql.files.openCostInBytes", 1 << 46),
        ("spark.sql.files.minPartitionNum", 1),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", LINES),
    ):
        apart.conf.set(name, str(value))
    lines = (
        apart.read.option("lineSep", "\n").text(path).where(~_held_whole())
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n"))).alias("line"),
        )
    )
    return lines.mapInArrow(_line_digests(), "file_name string, size_bytes long, sha256 string")


def _line_digests():
    """For each file, whose lines come together and in order, its name, size and SHA-256.

    Every line comes with a line feed, the last one too, and a byte order mark at the start is left
    out by the reader. How many bytes are missing or too many at the end tells which it was.
    """

    def content(column: pa.Array) -> memoryview:
        large = pa.types.is_large_binary(column.type)
        offsets = memoryview(column.buffers()[1]).cast("q" if large else "i")
        first, last = offsets[column.offset], offsets[column.offset + len(column)]
        return memoryview(column.buffers()[2])[first:last]

    def finished(path, size, read, plain, marked) -> pa.RecordBatch:
        missing = size - (read - 1)
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{path}: read {read} bytes of {size} in one task")
        digest = marked if missing >= 3 else plain
        if missing in (1, 4):
            digest.update(b"\n")
        name = unquote(path.rsplit("/", 1)[1])  # metadata hold names as parts of an URL
        return pa.RecordBatch.from_pydict(
            {"file_name": [name], "size_bytes": pa.array([size], pa.int64()), "sha256": [digest.hexdigest()]}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, at = batch.column("path"), 0
            while at < batch.num_rows:
                end = batch.num_rows
                if paths[at].as_py() != paths[end - 1].as_py():
                    end = at + paths[at:].to_pylist().count(paths[at].as_py())
                path = paths[at].as_py()
                if held is not None and held[0] != path:
                    yield finished(*held)
                    held = None
                if held is None:
                    size = batch.column("size")[at].as_py()
                    held = [path, size, 0, hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")]
                else:
                    for digest in held[3:]:
                        digest.update(b"\n")
                data = content(batch.column("line").slice(at, end - at))
                held[2] += len(data)
                for digest in held[3:]:
                    digest.update(data[:-1])
                at = end
        if held is not None:
            yield finished(*held)

    return run


def checksum_mismatches(found: DataFrame, manifest: Mapping[str, str]) -> DataFrame:
    """Files that differ from the manifest, are missing from it, or are pinned but absent."""
    spark = found.sparkSession
    pinned = spark.createDataFrame(
        list(manifest.items()) or [("", "")], "file_name string, expected_sha256 string"
    ).where(F.col("file_name") != "")
    return (
        found.join(pinned, "file_name", "full_outer")
        .where(~F.col("sha256").eqNullSafe(F.col("expected_sha256")))
        .select("file_name", "sha256", "expected_sha256")
    )


def require_pinned(spark: SparkSession, path: str | list[str], manifest: Mapping[str, str]) -> None:
    """Refuse the load when any file is not the pinned one."""
    bad = checksum_mismatches(file_checksums(spark, path), manifest).limit(5).collect()
    if bad:
        listed = "; ".join(
            f"{r['file_name']}: found {r['sha256']}, pinned {r['expected_sha256']}" for r in bad
        )
        raise ChecksumMismatch(listed)
