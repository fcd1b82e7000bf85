"""Strict reader of fixed-width transaction lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.session import materialise, small


class FixedWidthFormatError(ValueError):
    """The file does not match its declared layout."""


@dataclass(frozen=True)
class Field:
    """One field: half-open, zero-based character bounds."""

    name: str
    start: int
    stop: int
    kind: str  # "int", "decimal" or "date"


@dataclass(frozen=True)
class Layout:
    """Fields and blank separators; together they must cover every character exactly once."""

    width: int
    separators: tuple[int, ...]
    fields: tuple[Field, ...]

    def __post_init__(self) -> None:
        covered = list(self.separators)
        for field in self.fields:
            covered.extend(range(field.start, field.stop))
        if sorted(covered) != list(range(self.width)):
            raise ValueError("fields and separators must tile the line without gap or overlap")
        unknown = {field.kind for field in self.fields} - {"int", "decimal", "date"}
        if unknown:
            raise ValueError(f"unknown field kinds: {sorted(unknown)}")


# The published transaction file's columns.
TRANSACTION_LAYOUT = Layout(
    width=26,
    separators=(0, 6, 15, 18),
    fields=(
        Field("customer_id", 1, 6, "int"),
        Field("order_date", 7, 15, "date"),
        Field("quantity", 16, 18, "int"),
        Field("gross_amount", 19, 26, "decimal"),
    ),
)


def read_numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with their file and one-based number inside it.

    A split of a file is read by one task in file order, so rows are numbered per partition and
    shifted by the rows of earlier splits of the same file. The split order is the block start
    Spark reports in the file metadata; a file's split count is its size over the split size. The
    shifts, one row for each split, travel by broadcast: the lines stay where they were read.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("_source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_slot"),
    )
    fixed = materialise(lines)
    blocks = fixed.groupBy("_path", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_slot").alias("_first")
    )
    earlier = (
        Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.select(
        "_path", "_block", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    return fixed.join(small(offsets), ["_path", "_block"]).select(
        "value",
        "_source_file",
        (F.col("_before") + F.col("_slot") - F.col("_first") + 1).alias("_line_number"),
    )


def _text(field: Field) -> Column:
    return F.substring("value", field.start + 1, field.stop - field.start)


def _parsed(field: Field) -> Column:
    text = F.trim(_text(field))
    if field.kind == "int":
        whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text)
        return whole.try_cast("long")
    if field.kind == "decimal":
        plain = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), text)
        return F.round(plain.try_cast("decimal(18,6)"), 2).cast(schemas.LINE_MONEY)
    digits = F.when(_text(field).rlike(r"^[0-9]{8}$"), _text(field))
    return F.try_to_date(digits, "yyyyMMdd")


def parse_lines(lines: DataFrame, layout: Layout = TRANSACTION_LAYOUT) -> DataFrame:
    """Parse ``value`` by layout; ``error`` names the first deviation of a line, NULL if none."""
    error = F.when(
        F.col("value").rlike(r"[^\x00-\x7F]"), F.lit("line has non-ASCII characters")
    ).when(
        F.length("value") != layout.width,
        F.concat(F.lit("width "), F.length("value"), F.lit(f" instead of {layout.width}")),
    )
    for column in layout.separators:
        error = error.when(
            F.substring("value", column + 1, 1) != " ",
            F.lit(f"column {column} should be blank"),
        )
    for field in layout.fields:
        error = error.when(
            F.col(f"_{field.name}").isNull(), F.lit(f"could not read {field.name} as {field.kind}")
        )
    wide = lines.select("*", *[_parsed(f).alias(f"_{f.name}") for f in layout.fields])
    return wide.select(
        *[F.col(f"_{f.name}").alias(f.name) for f in layout.fields],
        "_source_file",
        "_line_number",
        "value",
        error.alias("error"),
    )


def read_transactions(
    spark: SparkSession, path: str, layout: Layout = TRANSACTION_LAYOUT, show: int = 5
) -> DataFrame:
    """Strict read: any deviating line fails the load, naming the first few; so does emptiness."""
    parsed = parse_lines(read_numbered_lines(spark, path), layout)
    totals = parsed.agg(
        F.count(F.lit(1)).alias("rows"), F.count("error").alias("bad")
    ).first()
    if totals["rows"] == 0:
        raise FixedWidthFormatError(f"no lines in {path}: empty input")
    if totals["bad"]:
        first = (
            parsed.where(F.col("error").isNotNull())
            .orderBy("_source_file", "_line_number")
            .limit(show)
            .collect()
        )
        listed = "; ".join(
            f"{r['_source_file']} line {r['_line_number']}: {r['error']} in {r['value']!r}"
            for r in first
        )
        raise FixedWidthFormatError(f"{totals['bad']} malformed lines: {listed}")
    return parsed.drop("value", "error")


def read_transactions_permissive(
    spark: SparkSession, path: str, layout: Layout = TRANSACTION_LAYOUT
) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the rejected lines with their reasons."""
    parsed = parse_lines(read_numbered_lines(spark, path), layout)
    return (
        parsed.where(F.col("error").isNull()).drop("value", "error"),
        parsed.where(F.col("error").isNotNull()).select(
            "_source_file", "_line_number", "value", "error"
        ),
    )


def raw_transactions(parsed: DataFrame) -> DataFrame:
    """The typed raw relation with its audit columns; duplicates and zero amounts stay."""
    return parsed.select(
        F.col("customer_id").cast("long").alias("customer_id"),
        F.col("order_date").cast("date").alias("order_date"),
        F.col("quantity").cast("int").alias("quantity"),
        F.col("gross_amount").cast(schemas.LINE_MONEY).alias("gross_amount"),
        F.col("_source_file"),
        F.col("_line_number").cast("long").alias("_line_number"),
        F.current_timestamp().alias("_ingested_at"),
    )


def render_lines(transactions: DataFrame, layout: Layout = TRANSACTION_LAYOUT) -> DataFrame:
    """The inverse of :func:`parse_lines`: one fixed-width ``value`` per row.

    A value too wide for its field keeps all its characters, so the line fails the width check
    when it is read instead of being cut.
    """
    pieces: dict[int, Column] = {c: F.lit(" ") for c in layout.separators}
    for field in layout.fields:
        size = field.stop - field.start
        if field.kind == "date":
            text = F.date_format(field.name, "yyyyMMdd")
        elif field.kind == "decimal":
            text = F.col(field.name).cast(schemas.LINE_MONEY).cast("string")
        else:
            text = F.col(field.name).cast("string")
        pad = "0" if field.name.endswith("_id") else " "
        pieces[field.start] = F.when(
            F.length(text) < size, F.lpad(text, size, pad)
        ).otherwise(text)
    return transactions.select(F.concat(*[pieces[k] for k in sorted(pieces)]).alias("value"))
