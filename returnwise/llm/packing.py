"""Best-fit packing of tokenised documents into sequences of fixed length.

Hierarchical residual packing: every task packs the pieces of its own documents best-fit
decreasing and closes the bins that are nearly full. Bins with room left are items of the next
round: they are dealt to nodes by a hash, packed best-fit again, and so on up the tree until one
node is left or a round no longer saves bins. Tokens never move; a round moves open bins only, and
a node holds a bounded number of them.
"""

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise.llm.common import ship
from returnwise.session import materialise

CAPACITY = 2048
END_ID = 0
#: A bin is closed once this few tokens are free.
NEARLY_FULL = 8
#: Pieces a task packs at a time, and open bins dealt to a node.
LOCAL_PIECES = 200_000
NODE_BINS = 20_000
#: Rounds go on while at least this share of the open bins is saved or closed.
LEAST_GAIN = 0.01
#: Chunks of text whose ids a worker remembers.
REMEMBERED = 400_000

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A space beside another blank. Each starts with the space, which is quick to look for.
_BLANK_AFTER, _BLANK_BEFORE = re.compile(r" \s"), re.compile(r" (?<=\s )")
_SPECIAL = "<|endoftext|>"


def default_files() -> tuple[str, str]:
    """The byte-level BPE vocabulary for ``tokenizers``, and the same one as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def special_id(path: str) -> int:
    """One vocabulary in two files: the id of the special token is that of the first."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).token_to_id(_SPECIAL)


class Ids:
    """Token ids of texts as little-endian 32-bit bytes, as ``tokenizers`` gives them.

    The vocabulary file's ranks are applied by ``tiktoken``, which gives the same ids faster. A
    single space between two visible characters always starts a new token, so a text is looked up
    chunk by chunk; chunks seen before come from memory. The end-of-text string inside a text is
    that special token, as ``tokenizers`` reads it.
    """

    def __init__(
        self, files: tuple[str, str] | None = None, special: int | None = None, remembered: int | None = None
    ):
        import base64

        import public_tokenizers
        import tiktoken

        path, ranks = files or default_files()
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        ).encode_to_numpy
        special = special_id(path) if special is None else special
        self._special = np.array([special], dtype="<u4").tobytes()
        most = REMEMBERED if remembered is None else remembered

        class Memory(dict):
            """Ids of chunks after their space."""

            def __missing__(self, chunk: str) -> bytes:
                ids = encode(" " + chunk).astype("<u4").tobytes()
                if len(self) < most and len(chunk) < 64:
                    self[chunk] = ids
                return ids

        self._first = lambda chunk: encode(chunk).astype("<u4").tobytes()
        self._look = Memory().__getitem__

    def _plain(self, text: str) -> bytes:
        first, *rest = chunks(text)
        return self._first(first) + b"".join(map(self._look, rest))

    def __call__(self, text: str) -> bytes:
        if _SPECIAL not in text:
            return self._plain(text) if text else b""
        return self._special.join(self._plain(x) if x else b"" for x in text.split(_SPECIAL))


class Vocabulary:
    """The ids of a Python worker, to be broadcast: loaded once, with the chunks seen so far.

    A worker lets go of a broadcast when it turns to a task without it, so what is remembered does
    not weigh on the jobs that follow.
    """

    def __init__(self, files: tuple[str, str] | None = None):
        self._files, self._special, self._ids = files, special_id((files or default_files())[0]), None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_ids": None}

    def ids(self, remembered: int | None = None) -> Ids:
        if remembered is not None:
            return Ids(self._files, self._special, remembered)
        if self._ids is None:
            self._ids = Ids(self._files, self._special)
        return self._ids


def chunks(text: str) -> list[str]:
    """``text`` cut at every single space between two visible characters."""
    if text[:1] == " " or text[-1:] == " " or _BLANK_AFTER.search(text) or _BLANK_BEFORE.search(text):
        return _SAFE_SPACE.split(text)
    return text.split(" ")  # the same cuts, several times faster


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole, or full ones after a shorter first."""
    first = length % capacity if length > capacity else length
    pieces = [(0, first)] if first else []
    return pieces + [(at, capacity) for at in range(first, length, capacity)]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of the items in each bin: largest first, into the fullest bin with room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit i: a bin with i free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[chosen].append(i)
        else:
            room, chosen = capacity, len(bins)
            bins.append([i])
        if room > size:
            with_room[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins


_MEMBER = pa.struct([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
])
_BIN = pa.schema([("fill", pa.int64()), ("members", pa.list_(_MEMBER))])
_DDL = (
    "fill bigint, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,"
    "ids_crc32:bigint>>"
)


def _bins(fills: list[int], members: pa.StructArray, groups: list[list[int]], firsts: np.ndarray, counts: np.ndarray):
    """Bins made of items; item i holds the members from ``firsts[i]``, ``counts[i]`` of them."""
    order = np.fromiter(
        (m for g in groups for i in g for m in range(firsts[i], firsts[i] + counts[i])), dtype=np.int64
    )
    ends = np.cumsum([0, *(sum(int(counts[i]) for i in g) for g in groups)])
    nested = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members.take(pa.array(order)))
    return pa.RecordBatch.from_arrays([pa.array(fills, pa.int64()), nested.cast(pa.list_(_MEMBER))], schema=_BIN)


def _packed(sizes: np.ndarray, members: pa.StructArray, firsts, counts, capacity: int) -> pa.RecordBatch:
    groups = best_fit(sizes, capacity)
    return _bins([int(sizes[g].sum()) for g in groups], members, groups, firsts, counts)


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    nearly_full: int = NEARLY_FULL,
    node_bins: int = NODE_BINS,
    files: tuple[str, str] | None = None,
    remembered: int | None = None,
) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)`` with their place in a sequence.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. A document is its
    token ids and then id 0; a NULL or empty text is id 0 alone. Documents longer than a sequence
    are cut into full pieces after a first piece that may be shorter; others stay whole. Repeated
    rows and rows without an id are packed like any other. Other columns are ignored.

    A worker keeps the vocabulary and the chunks seen for its next task. With ``remembered`` it
    remembers so many chunks at most and lets all go at the task's end, for less memory and more time.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(files))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.ids(remembered)
        end = np.array([END_ID], dtype="<u4").tobytes()
        found: list[tuple] = []

        def emit():
            sizes = np.array([x[3] for x in found], dtype=np.int64)
            columns = [pa.array([x[i] for x in found], _MEMBER.field(i).type) for i in range(5)]
            members = pa.StructArray.from_arrays(columns, fields=list(_MEMBER))
            one = np.ones(len(found), dtype=np.int64)
            made = _packed(sizes, members, np.arange(len(found)), one, capacity)
            found.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = memoryview(ids(text or "") + end)
                for k, (start, length) in enumerate(cut(len(coded) // 4, capacity)):
                    crc = zlib.crc32(coded[4 * start : 4 * (start + length)])
                    found.append((doc_id, k, start, length, crc))
                if len(found) >= LOCAL_PIECES:
                    yield emit()
        if found:
            yield emit()

    def merge(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nested = group.column("members").combine_chunks()
        counts = np.diff(nested.offsets.to_numpy())
        firsts = nested.offsets.to_numpy()[:-1] - nested.offsets[0].as_py()
        sizes = group.column("fill").to_numpy()
        return pa.Table.from_batches([_packed(sizes, nested.flatten(), firsts, counts, capacity)])

    bins = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(local, _DDL))
    closed, left, turn = [], None, 0
    while True:
        is_open = F.col("fill") < capacity - nearly_full
        closed.append(bins.where(~is_open))
        open_bins = bins.where(is_open)
        before, left = left, open_bins.count()
        if left < 2 or (before is not None and (nodes == 1 or left > before * (1 - LEAST_GAIN))):
            closed.append(open_bins)
            break
        nodes = -(-left // node_bins)
        turn += 1
        node = F.pmod(
            F.xxhash64(F.lit(turn), F.col("members")[0]["doc_id"], F.col("members")[0]["piece"],
                       F.col("members")[0]["ids_crc32"]), F.lit(nodes)
        )
        bins = materialise(
            open_bins.withColumn("node", node).groupBy("node").applyInArrow(
                lambda group: merge(group.select(["fill", "members"])), _DDL
            )
        )
    numbered = reduce(DataFrame.union, closed).withColumn("sequence_id", F.monotonically_increasing_id())
    placed = numbered.select(
        "sequence_id",
        F.inline(F.transform("members", lambda m, i: F.struct(
            m.alias("m"),
            F.aggregate(F.slice("members", 1, i), F.lit(0).cast("long"), lambda a, b: a + b["length"]).alias("offset"),
        ))),
    )
    return placed.select("m.*", "sequence_id", "offset")
