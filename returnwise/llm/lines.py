"""Line dedup that can be taken back: exact reference counts behind sharded cuckoo filters.

The truth is a table of references ``(key, doc_id, lines)``: which document holds which line key,
and how often. Counting it gives the crowded keys, those in at least ``min_docs`` documents, with
the largest document holding each. Crowded keys also sit in cuckoo filters, one for each shard of
keys. A filter answers "certainly not crowded" without a lookup, so only documents with a possible
hit are joined with the exact table; a filter's false alarms are settled there and change nothing.
Inserting documents adds references, deleting documents removes them, and only the shards whose
crowded keys changed get their filters changed, by insertions and deletions in place.
"""

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise.llm.common import BLANKS, by_batch, free_name, ship, short_batches
from returnwise.session import materialise

MIN_CHARS = 20
MIN_DOCS = 3
#: Crowded keys a shard should hold; the number of shards follows from it and grows with the keys.
SHARD_KEYS = 50_000
#: Filters are broadcast up to this many bytes together; above, every document goes to the exact table.
BROADCAST_BYTES = 64 << 20

_SLOTS = 4
_EVICTIONS = 500


def line_key(line: str) -> bytes | None:
    """The key of a line, or None where it is shorter than ``MIN_CHARS`` code points."""
    bare = line.strip(BLANKS)
    if len(bare) < MIN_CHARS:
        return None
    return hashlib.blake2b(bare.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


class CuckooFilter:
    """A cuckoo filter of 16-bit marks, four to a bucket, over 16-byte keys.

    ``insert`` never loses a key: a mark whose evictions don't end goes to an overflow list, which
    is kept beside the buckets and searched too.
    """

    def __init__(self, keys: int = 0, blob: bytes | None = None):
        if blob is not None:
            size, extra = struct.unpack_from("<qq", blob)
            self.rows = np.frombuffer(blob, "<u2", size * _SLOTS, 16).reshape(size, _SLOTS).copy()
            pairs = np.frombuffer(blob, "<q", 2 * extra, 16 + 2 * size * _SLOTS).reshape(-1, 2)
            self.overflow = [tuple(map(int, p)) for p in pairs]
            return
        size = 1
        while size * _SLOTS * 0.85 < max(keys, 1):
            size *= 2
        self.rows = np.zeros((size, _SLOTS), dtype="<u2")
        self.overflow: list[tuple[int, int]] = []

    def blob(self) -> bytes:
        pairs = np.array(self.overflow, dtype="<q").reshape(-1, 2)
        head = struct.pack("<qq", len(self.rows), len(pairs))
        return head + self.rows.tobytes() + pairs.tobytes()

    @staticmethod
    def parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home buckets before reduction, and marks (never zero), of keys as rows of two uint64."""
        return (keys[:, 1] >> np.uint64(8)).astype(np.int64), (
            (keys[:, 0] >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)
        ).astype(np.int64)

    def _other(self, bucket, mark):
        return bucket ^ ((mark * 0x5BD1E995) & (len(self.rows) - 1))

    def insert(self, keys: np.ndarray) -> None:
        homes, marks = self.parts(keys)
        homes &= len(self.rows) - 1
        rows = self.rows
        step = 0
        for bucket, mark in zip(homes.tolist(), marks.tolist()):
            for place in (bucket, self._other(bucket, mark)):
                row = rows[place].tolist()
                if 0 in row:
                    rows[place, row.index(0)] = mark
                    break
            else:
                for _ in range(_EVICTIONS):
                    step += 1
                    slot = step % _SLOTS
                    mark, rows[place, slot] = int(rows[place, slot]), mark
                    place = self._other(place, mark)
                    row = rows[place].tolist()
                    if 0 in row:
                        rows[place, row.index(0)] = mark
                        break
                else:
                    self.overflow.append((place, mark))

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted; others must not be given."""
        homes, marks = self.parts(keys)
        homes &= len(self.rows) - 1
        for bucket, mark in zip(homes.tolist(), marks.tolist()):
            both = (bucket, self._other(bucket, mark))
            for place in both:
                row = self.rows[place].tolist()
                if mark in row:
                    self.rows[place, row.index(mark)] = 0
                    break
            else:
                self.overflow = [
                    x for i, x in enumerate(self.overflow)
                    if i != next((j for j, y in enumerate(self.overflow) if y[0] in both and y[1] == mark), -1)
                ]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the filter; False is certain."""
        homes, marks = self.parts(keys)
        homes &= len(self.rows) - 1
        other = self._other(homes, marks)
        found = (self.rows[homes] == marks[:, None]).any(axis=1)
        found |= (self.rows[other] == marks[:, None]).any(axis=1)
        for place, mark in self.overflow:
            found |= ((homes == place) | (other == place)) & (marks == mark)
        return found


def _matrix(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


@dataclass
class State:
    """The exact tables and the filters over them."""

    references: DataFrame  # key, doc_id, lines
    crowded: DataFrame  # key, largest, shard
    filters: DataFrame  # shard, filter
    shards: int


def references(docs: DataFrame) -> DataFrame:
    """``key, doc_id, lines`` of every line key of every document with an id."""
    ship(docs.sparkSession)

    def start():
        def work(texts):
            found = []
            for text in texts:
                counts: dict[bytes, int] = {}
                for line in (text or "").split("\n"):
                    key = line_key(line)
                    if key is not None:
                        counts[key] = counts.get(key, 0) + 1
                found.append([{"key": k, "lines": n} for k, n in counts.items()])
            return found

        return work

    kind = pa.list_(pa.struct([("key", pa.binary()), ("lines", pa.int64())]))
    keys = by_batch(start, kind, "array<struct<key:binary,lines:bigint>>")
    return (
        docs.where("doc_id is not null")
        .select("doc_id", F.inline(keys("text")))
        .groupBy("key", "doc_id")
        .agg(F.sum("lines").alias("lines"))
    )


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def shard_of(key: bytes, shards: int) -> int:
    """The shard that ``_shard`` gives the key."""
    value = xxhash.xxh64_intdigest(key, 42)
    return (value - (1 << 64) if value >> 63 else value) % shards


def _crowded(held: DataFrame, min_docs: int) -> DataFrame:
    return (
        held.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest"))
        .where(F.col("docs") >= min_docs)
        .select("key", "largest")
    )


def _filters(crowded: DataFrame) -> DataFrame:
    def fill(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_pylist()
        made = CuckooFilter(len(keys))
        made.insert(_matrix(keys))
        return pa.table({"shard": group.column("shard")[:1], "filter": pa.array([made.blob()], pa.binary())})

    return crowded.groupBy("shard").applyInArrow(fill, "shard int, filter binary")


def build(docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> State:
    """The state after inserting ``docs`` into nothing."""
    held = materialise(references(docs))
    crowded = materialise(_crowded(held, min_docs))
    shards = max(1, -(-crowded.count() // shard_keys))
    crowded = crowded.withColumn("shard", _shard(shards))
    return State(held, crowded, materialise(_filters(crowded)), shards)


def insert(
    state: State, docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS
) -> State:
    """The state with further documents; a document that is there already gains their lines."""
    return _changed(state, references(docs), 1, min_docs, shard_keys)


def delete(
    state: State, doc_ids: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS
) -> State:
    """The state as if the documents ``(doc_id)`` had never been inserted."""
    gone = state.references.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return _changed(state, gone.select("key", "doc_id", "lines"), -1, min_docs, shard_keys)


def _changed(
    state: State, rows: DataFrame, sign: int, min_docs: int, shard_keys: int
) -> State:
    rows = materialise(rows)
    held = materialise(
        state.references.select("key", "doc_id", "lines")
        .union(rows.select("key", "doc_id", F.col("lines") * sign))
        .groupBy("key", "doc_id").agg(F.sum("lines").alias("lines")).where("lines > 0")
    )
    # Only keys of the changed documents can have become or ceased to be crowded.
    touched = rows.select("key").distinct()
    again = _crowded(held.join(touched, "key", "left_semi"), min_docs)
    crowded = materialise(
        state.crowded.select("key", "largest").join(touched, "key", "left_anti").union(again)
    )
    needed = max(1, -(-crowded.count() // shard_keys))
    if needed > 2 * state.shards:
        # Filters don't grow: when the keys have doubled, they are dealt over more shards.
        crowded = crowded.withColumn("shard", _shard(needed))
        return State(held, crowded, materialise(_filters(crowded)), needed)
    crowded = crowded.withColumn("shard", _shard(state.shards))
    new = crowded.join(state.crowded, "key", "left_anti").select("shard", "key", F.lit(True).alias("added"))
    old = state.crowded.join(crowded, "key", "left_anti").select("shard", "key", F.lit(False).alias("added"))

    def update(before: pa.Table, changes: pa.Table) -> pa.Table:
        shard = (before if before.num_rows else changes).column("shard")[:1]
        added = changes.column("added").to_pylist()
        keys = changes.column("key").to_pylist()
        plus = [k for k, a in zip(keys, added) if a]
        minus = [k for k, a in zip(keys, added) if not a]
        mine = (
            CuckooFilter(blob=before.column("filter")[0].as_py())
            if before.num_rows else CuckooFilter(len(plus))
        )
        if minus:
            mine.delete(_matrix(minus))
        if plus:
            mine.insert(_matrix(plus))
        return pa.table({"shard": shard, "filter": pa.array([mine.blob()], pa.binary())})

    filters = state.filters.groupBy("shard").cogroup(new.union(old).groupBy("shard")).applyInArrow(
        update, "shard int, filter binary"
    )
    return State(held, crowded, materialise(filters), state.shards)


def apply(
    state: State, docs: DataFrame, into: str = "lines", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``docs`` with a column ``into`` beside its own: a struct of kept, n_lines and n_dropped.

    A text is split at newlines; NULL or empty is one empty line. Lines whose key is crowded go,
    except in the largest document that holds the key. Rows without an id keep all their lines;
    rows that share an id are treated alike. ``kept`` is never NULL.
    """
    spark = docs.sparkSession
    ship(spark)
    may = free_name(docs, "__may")
    drops = free_name(docs, "__drops")
    weight = state.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    if weight <= broadcast_bytes:
        blobs = spark.sparkContext.broadcast(
            {r.shard: bytes(r["filter"]) for r in state.filters.collect()}
        )
        shards = state.shards

        def start():
            filters = {s: CuckooFilter(blob=b) for s, b in blobs.value.items()}

            def work(texts):
                owners, keys = [], []
                for i, text in enumerate(texts):
                    for line in (text or "").split("\n"):
                        key = line_key(line)
                        if key is not None:
                            owners.append(i)
                            keys.append(key)
                hit = np.zeros(len(texts), dtype=bool)
                if keys and filters:
                    matrix = _matrix(keys)
                    found = np.zeros(len(keys), dtype=bool)
                    homes = np.array([shard_of(k, shards) for k in keys])
                    for shard, each in filters.items():
                        mine = np.flatnonzero(homes == shard)
                        found[mine] = each.holds(matrix[mine])
                    hit[np.array(owners)[found]] = True
                return hit.tolist()

            return work

        possible = by_batch(start, pa.bool_(), "boolean")("text")
    else:
        possible = F.lit(True)
    possible = F.col("doc_id").isNotNull() & possible
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    whole = docs.where(~possible).withColumn(
        into,
        F.struct(
            F.coalesce("text", F.lit("")).alias("kept"),
            (F.coalesce(newlines, F.lit(0)) + 1).cast("long").alias("n_lines"),
            F.lit(0).cast("long").alias("n_dropped"),
        ),
    )
    gone = (
        state.references.join(state.crowded.select("key", "largest"), "key")
        .where("doc_id < largest")
        .groupBy("doc_id").agg(F.collect_list("key").alias(drops))
        .withColumnRenamed("doc_id", may)
    )

    def cut():
        def work(texts, dropped):
            out = []
            for text, keys in zip(texts, dropped):
                lines = (text or "").split("\n")
                if keys:
                    away = set(keys)
                    stay = [x for x in lines if line_key(x) not in away]
                else:
                    stay = lines
                out.append({"kept": "\n".join(stay), "n_lines": len(lines), "n_dropped": len(lines) - len(stay)})
            return out

        return work

    kind = pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    remove = by_batch(cut, kind, "struct<kept:string,n_lines:bigint,n_dropped:bigint>", 2)
    part = docs.where(possible).join(gone, F.col("doc_id") == F.col(may), "left").withColumn(
        into, remove("text", drops)
    )
    return part.drop(may, drops).union(whole)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without its crowded lines: ``text`` and ``n_chars`` follow, all rows stay.

    A NULL text stays NULL where nothing was dropped.
    """
    short_batches(docs.sparkSession)
    into = free_name(docs, "__lines")
    done = apply(build(docs.select("doc_id", "text")), docs, into)
    changed = {"text": F.when(F.col("text").isNotNull(), F.col(f"{into}.kept"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(
            F.col(f"{into}.n_dropped") > 0, F.length(f"{into}.kept").cast("long")
        ).otherwise(F.col("n_chars"))
    return done.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    mine = docs.select("doc_id", "text")
    return apply(build(mine), mine).select(
        "doc_id",
        "lines.n_lines",
        "lines.n_dropped",
        F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"),
    )
