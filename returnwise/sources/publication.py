"""Several relations that become visible together, or not at all.

Every publication writes under a version of its own, beside what readers see, and ends by appending one
file of one manifest: a row for each part that it replaces. That single file is the switch. Whatever
fails before it leaves the earlier rows of all relations in place, and a reader never meets predictions
of one fit beside parameters of another.
"""

from __future__ import annotations

import time
import uuid
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from returnwise.sources.store import Store

#: Columns that may tell the parts of a relation apart; a part is replaced as a whole.
PART = ("source", "fit_method", "family")

#: The version of a part that was taken away: no folder has this name.
_GONE = ""

_MANIFEST = T.StructType(
    [T.StructField("relation", T.StringType()), T.StructField("keys", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in PART]
    + [T.StructField("version", T.StringType()), T.StructField("turn", T.LongType())]
)


def _root(store: Store) -> str:
    return f"{store.root.rstrip('/')}/published"


def folder(store: Store, relation: str) -> str:
    return f"{_root(store)}/{relation}"


def manifest(store: Store) -> DataFrame:
    """Every part ever published: ``relation, keys, source, fit_method, family, version, turn``."""
    path = f"{_root(store)}/manifest"
    try:
        store.spark.read.parquet(path)
    except AnalysisException:
        return store.spark.createDataFrame([], _MANIFEST)
    return store.spark.read.schema(_MANIFEST).parquet(path)


def live(store: Store, relation: str | None = None) -> list:
    """The version that holds each part: the one of the last turn, ties to the larger name.

    Two publications that overlap may take the same turn; the tie falls alike for all their parts.
    Bounded by the number of sources, fit methods and families.
    """
    rows = manifest(store)
    if relation is not None:
        rows = rows.where(F.col("relation") == relation)
    latest = F.max_by("version", F.struct("turn", "version")).alias("version")
    return rows.groupBy("relation", "keys", *PART).agg(latest).collect()


def _name(values: list[str | None]) -> str:
    """A part and its version as one text."""
    return "\x00".join("-" if v is None else f"+{v}" for v in values)


def _name_of(columns: list[str]) -> Column:
    """The same text, as a column."""
    return F.array_join(
        F.array(*[F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-")) for c in columns]), "\x00"
    )


def _versions(store: Store, relation: str, keys: list[str]) -> DataFrame:
    """All versions of a relation, with folder names read as text: ``007`` is not ``7``."""
    path = folder(store, relation)
    text = {*keys, "version"}
    found = store.spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in text else f for f in found]
    return store.spark.read.schema(T.StructType(fields)).parquet(path)


def read(store: Store, relation: str) -> DataFrame | None:
    """The published rows of a relation, or None where none ever was.

    The condition speaks about folders alone, so other versions are never opened.
    """
    parts = live(store, relation)
    if not parts:
        return None
    keys = parts[0]["keys"].split(",")
    wanted = [_name([*(p[k] for k in keys), p["version"]]) for p in parts]
    rows = _versions(store, relation, keys).where(_name_of([*keys, "version"]).isin(wanted))
    return rows.drop("version")


def shape(schema: T.StructType) -> set[tuple[str, str]]:
    return {(f.name, f.dataType.simpleString()) for f in schema}


class Publication:
    """One set of relations to be published; as a context it commits unless its body fails."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.version = f"v{uuid.uuid4().hex}"
        self._keys: dict[str, list[str]] = {}
        self._whole: set[str] = set()

    def __enter__(self) -> Publication:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def stage(self, relation: str, df: DataFrame, keys: tuple[str, ...] = ("source",)) -> int:
        """Write rows that replace the parts they belong to; returns how many there are.

        A frame whose columns differ from what is published is refused before anything is written,
        as is a second frame for one relation.
        """
        if relation in self._keys:
            raise ValueError(f"{relation} is already part of this publication")
        held = read(self.store, relation)
        if held is not None and shape(held.schema) != shape(df.schema):
            raise ValueError(
                f"{relation} is stored as {held.schema.simpleString()}, "
                f"the frame is {df.schema.simpleString()}"
            )
        # Counted while written: a second pass could mean fitting or scoring twice.
        written = Observation()
        (
            df.observe(written, F.count(F.lit(1)).alias("rows"))
            .withColumn("version", F.lit(self.version))
            .write.mode("append")
            .partitionBy("version", *keys)
            .parquet(folder(self.store, relation))
        )
        self._keys[relation] = list(keys)
        return written.get["rows"]

    def stage_whole(self, relation: str, df: DataFrame, keys: tuple[str, ...] = ("source",)) -> int:
        """Write rows that replace the relation: parts that they lack disappear."""
        rows = self.stage(relation, df, keys)
        self._whole.add(relation)
        return rows

    def holds(self, relation: str) -> bool:
        return relation in self._keys

    def read(self, relation: str, source: str | None = None) -> DataFrame:
        """The staged rows of a relation, or the published ones where none are staged."""
        if relation not in self._keys:
            return self.store.read(relation, source)
        rows = _versions(self.store, relation, self._keys[relation])
        rows = rows.where(F.col("version") == self.version).drop("version")
        return rows if source is None else rows.where(F.col("source") == source)

    def commit(self) -> None:
        """Make all staged rows visible at once."""
        parts: list[DataFrame] = []
        for relation, keys in self._keys.items():
            rows = self.read(relation).select(*keys).distinct()
            parts.append(rows.select(
                F.lit(relation).alias("relation"), F.lit(",".join(keys)).alias("keys"),
                *[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(k) for k in PART],
            ))
        # One row for each part: as few as there are sources, methods and families.
        named = [(*row, self.version) for part in parts for row in part.collect()]
        carried = {row[:-1] for row in named}
        for relation in self._whole:
            held = [(p["relation"], p["keys"], *(p[k] for k in PART)) for p in live(self.store, relation)]
            named.extend((*part, _GONE) for part in held if part not in carried)
        if not named:
            return
        turn = (manifest(self.store).agg(F.max("turn").alias("turn")).first()["turn"] or 0) + 1
        rows = self.store.spark.createDataFrame([(*n, turn) for n in named], _MANIFEST)
        # One task, one file: the file's appearance is the switch.
        rows.coalesce(1).write.mode("append").parquet(f"{_root(self.store)}/manifest")
        self._keys, self._whole = {}, set()


def retire(store: Store, hours: float = 24.0) -> int:
    """Delete the versions that no part needs and that are older than ``hours``; returns how many.

    The age spares publications under way and readers that began before the last switch.
    """
    spark: SparkSession = store.spark
    needed = {(p["relation"], p["version"]) for p in live(store)}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    before = (time.time() - hours * 3600) * 1000
    gone = 0
    for relation in sorted({r for r, _ in needed}):
        target = hadoop.Path(folder(store, relation))
        files = target.getFileSystem(settings)
        for status in files.listStatus(target):
            name = status.getPath().getName()
            version = name.removeprefix("version=")
            if name == version or (relation, version) in needed or status.getModificationTime() > before:
                continue
            gone += files.delete(status.getPath(), True)
    return gone
