"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are the queries and every window of every document is searched. A distributed
randomised SVD of all TF-IDF windows over the benchmark's terms gives a latent space, in which windows
close to a passage by cosine are candidates. A candidate counts if enough of the passage, and enough of
its answer, is a common subsequence of the two, so paraphrases with words added, dropped or exchanged
are found and mere topics are not.

A term has a weight however common it is. Whether the space tells a passage from what may surround it
is tried when it is fitted, with paraphrases between words of the corpus and of other passages; passages
that would not be near enough are searched by their words in common instead, which misses none. Texts of
fewer words than ``LEAST_WORDS`` are found word for word.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise.llm.common import by_batch, ship
from returnwise.session import materialise

#: Longest passage, in words; longer benchmark texts are cut into passages of this length.
PASSAGE_WORDS = 64
#: Benchmark texts with fewer words are found word for word only.
LEAST_WORDS = 8
#: Window classes by the longest passage they serve. A window is a quarter longer, and windows
#: start every quarter of that length, so each occurrence of a passage lies whole in some window.
CLASSES = (16, 32, 64)
RANK, OVERSAMPLE = 64, 8
#: A window this near to a passage is a candidate.
COSINE = 0.4
#: Paraphrases tried of each passage, and how much nearer than ``COSINE`` all of them must be.
TRIALS, MARGIN = 32, 0.05
#: Passages whose marks are compared at a time.
COUNTED = 256
COMMON_WORDS = 0.65
ANSWER_WORDS = 0.6
#: Benchmark texts held by a task at a time; more are searched block by block.
BLOCK_ITEMS = 20_000
#: Words of documents worked on at a time, in whole windows; their places in the space are held at once.
BATCH_WORDS = 1600 * PASSAGE_WORDS
#: Bytes of places and of marks compared at a time, and pairs whose subsequences are sought at a time.
COUNT_BYTES, PAIR_BYTES, PAIRS = 1 << 24, 1 << 20, 20_000
#: Blocks of a text whose places in the space are summed at a time.
BLOCKS = 4096
#: Commonest terms whose counts by window are a dense table, and windows of such a table.
DENSE, WINDOWS = 512, 2048
#: Numbers of 64 bits that mark which terms a window holds.
MARKS = 4

_TO_BLANK = bytes(
    32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256)
)
_SENTENCE = re.compile(r"[.?!:\n]+")


def words(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of anything that isn't ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_BLANK).split()


def answer_length(text: str) -> int:
    """Words of the answer: the last sentence if it has three or more, else the last third."""
    counts = [n for n in (len(words(s)) for s in _SENTENCE.split(text)) if n]
    total = sum(counts)
    return counts[-1] if len(counts) > 1 and counts[-1] >= 3 else max(1, total // 3)


@dataclass
class Passage:
    item_id: int | None
    terms: list[int]
    masks: dict[int, int]
    answer: int  # how many words at the end are the answer; 0 where the passage has none of it


@dataclass
class Space:
    vocabulary: dict[bytes, int]
    passages: list[Passage]
    short: list[tuple[int | None, list[int]]] = field(default_factory=list)
    latent: np.ndarray | None = None  # term by dimension, weighted
    queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    # Class: passages, their unit rows, and whether the space holds them.


def _passages(items: list[tuple[int | None, str]]) -> Space:
    space = Space({}, [])
    for item_id, text in items:
        own = words(text)
        ids = [space.vocabulary.setdefault(w, len(space.vocabulary)) for w in own]
        if len(own) < LEAST_WORDS:
            if own:
                space.short.append((item_id, ids))
            continue
        answer = answer_length(text)
        parts = max(1, -(-len(ids) // PASSAGE_WORDS))
        edges = [len(ids) * i // parts for i in range(parts + 1)]
        for a, b in zip(edges, edges[1:]):
            masks: dict[int, int] = {}
            for i, t in enumerate(ids[a:b]):
                masks[t] = masks.get(t, 0) | 1 << i
            overlap = max(0, b - max(a, len(ids) - answer))
            space.passages.append(Passage(item_id, ids[a:b], masks, overlap))
    return space


def common_subsequences(space: Space, which: np.ndarray, windows: np.ndarray, share: float = 0.0) -> np.ndarray:
    """By pair, bits of the passage's words in a longest common subsequence with the window.

    ``which`` are the pairs' passages; ``windows`` has a row of terms for each pair, filled up with
    the size of the vocabulary. Passages have at most 64 words, so a state is one number. Pairs with fewer
    than ``share`` of the passage's words in common have no bits: their subsequence is no longer.
    """
    masks = np.empty(windows.shape, dtype=np.uint64)
    table = np.zeros(len(space.vocabulary) + 1, dtype=np.uint64)
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.diff(which[order])) + 1
    for rows in np.split(order, cuts):
        own = space.passages[which[rows[0]]].masks
        terms = np.fromiter(own, np.int64, len(own))
        table[terms] = np.fromiter(own.values(), np.uint64, len(own))
        masks[rows] = table[windows[rows]]
        table[terms] = 0
    size = np.array([len(p.terms) for p in space.passages])
    every = np.array([(1 << n) - 1 for n in size.tolist()], dtype=np.uint64)
    bits = np.zeros(len(which), dtype=np.uint64)
    enough = np.flatnonzero(np.count_nonzero(masks, axis=1) >= share * size[which] - 1e-9)
    masks, full = masks[enough], every[which[enough]]
    state = full.copy()
    for mask in np.ascontiguousarray(masks.T):
        both = state & mask
        state = ((state + both) | (state - both)) & full
    bits[enough] = full & ~state
    return bits


def _terms(texts: Iterator[str | None], vocabulary: dict[bytes, int], overlap: int):
    """``(owners, lengths, ids)`` of batches of texts; a long text continues in the next segment."""
    look = vocabulary.get
    owners, lengths, ids, held = [], [], [], 0
    for i, text in enumerate(texts):
        own = words(text)
        step = BATCH_WORDS
        for a in range(0, max(1, len(own)), step):
            part = own[a : a + step + overlap]
            owners.append(i)
            lengths.append(len(part))
            ids.append(np.fromiter(map(look, part, repeat(-1)), np.int32, len(part)))
            held += len(part)
            if held >= BATCH_WORDS:
                yield np.array(owners), np.array(lengths), np.concatenate(ids)
                owners, lengths, ids, held = [], [], [], 0
            if a + step + overlap >= len(own):
                break
    if owners:
        yield np.array(owners), np.array(lengths), np.concatenate(ids)


def _windows(lengths: np.ndarray, size: int, step: int):
    """Segment, start and end of all windows in the joined words."""
    counts = np.maximum(1, -(-(lengths - size) // step) + 1)
    segment = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = first[segment] + within * step
    return segment, start, np.minimum(start + size, (first + lengths)[segment])


def _kind(vocabulary: dict[bytes, int]) -> np.dtype:
    """The smallest whole numbers that hold the terms of ``vocabulary`` and -1."""
    return np.dtype(np.int16 if len(vocabulary) < 1 << 15 else np.int32)


def _disjoint(rows: list[bytes], kind: np.dtype):
    """Term hits of disjoint windows: counts of windows and words, and each hit's window and term.

    ``rows`` are segments of texts as terms of ``kind``; about ``BATCH_WORDS`` words are taken at a time.
    """
    low = held = 0
    for high, row in enumerate(rows, 1):
        held += len(row) // kind.itemsize
        if held < BATCH_WORDS and high < len(rows):
            continue
        lengths = np.array([len(x) for x in rows[low:high]]) // kind.itemsize
        ids = np.frombuffer(b"".join(rows[low:high]), kind)
        low, held = high, 0
        _, start, _ = _windows(lengths, PASSAGE_WORDS, PASSAGE_WORDS)
        at = np.flatnonzero(ids >= 0)
        yield len(start), len(ids), np.searchsorted(start, at, "right") - 1, ids[at].astype(np.int64)


def fit(docs: DataFrame, items: list[tuple[int | None, str]]) -> Space | None:
    """The latent space of ``items`` within ``docs(text)``; None where no item has a word."""
    spark = docs.sparkSession
    ship(spark)
    space = _passages(items)
    if not space.passages:
        return space if space.short else None
    terms, r = len(space.vocabulary), min(RANK + OVERSAMPLE, len(space.vocabulary))
    shared, kind = spark.sparkContext.broadcast(space.vocabulary), _kind(space.vocabulary)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lengths, ids in _terms(batch.column(0).to_pylist(), shared.value, 0):
                whole, ends = ids.astype(kind).tobytes(), np.cumsum(lengths) * kind.itemsize
                starts = np.concatenate(([0], ends[:-1]))
                rows = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"terms": pa.array(rows, pa.binary())})

    # Words are looked up once; the passes below read their terms.
    coded = materialise(docs.select("text").where("text is not null").mapInArrow(code, "terms binary"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, times, total, words_read = np.zeros(terms + 1, dtype=np.int64), np.zeros(terms + 1, dtype=np.int64), 0, 0
        for batch in batches:
            for n, size, window, term in _disjoint(batch.column(0).to_pylist(), kind):
                pairs = np.unique(window * terms + term)
                counts[:terms] += np.bincount(pairs % terms, minlength=terms)
                times[:terms] += np.bincount(term, minlength=terms)
                total += n
                words_read += size
        counts[terms], times[terms] = total, words_read
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "term": pa.array(used), "n": pa.array(counts[used]), "times": pa.array(times[used]),
        })

    counted = (
        coded.mapInArrow(frequencies, "term bigint, n bigint, times bigint")
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    )
    frequency, usual = np.zeros(terms + 1), np.zeros(terms + 1)
    for row in counted.collect():
        frequency[row.term], usual[row.term] = row.n, row.times
    total, frequency = frequency[terms], frequency[:terms]
    usual = usual[:terms] / max(usual[terms], 1)
    weight = np.log((total + 1) / (frequency + 1)) + 1
    dense = np.sort(np.argsort(-frequency, kind="stable")[:DENSE])

    passage_of = np.repeat(np.arange(len(space.passages)), [len(p.terms) for p in space.passages])
    passage_terms = np.concatenate([p.terms for p in space.passages])
    # The passages weigh as much as all windows together, so the space is spanned by both alike.
    windows_weight = float(((weight**2) * frequency).sum())
    share = max(1.0, windows_weight / max(float((weight[passage_terms] ** 2).sum()), 1e-9))

    def product(basis: np.ndarray) -> np.ndarray:
        """Transpose(A) A basis, A the weighted windows and the passages."""
        wide = spark.sparkContext.broadcast((weight[:, None] * basis).astype(np.float32))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((terms, basis.shape[1]))
            for batch in batches:
                for _, _, window, term in _disjoint(batch.column(0).to_pylist(), kind):
                    if len(term):
                        out += _outer(wide.value, window, term, dense)
            rows = np.flatnonzero(np.abs(out).sum(axis=1))
            columns = {"term": pa.array(rows)} | {f"y{i}": pa.array(out[rows, i]) for i in range(out.shape[1])}
            yield pa.RecordBatch.from_pydict(columns)

        names = [f"y{i}" for i in range(basis.shape[1])]
        ddl = "term bigint, " + ", ".join(f"{x} double" for x in names)
        parts = coded.mapInArrow(partial, ddl).groupBy("term").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
        out = np.zeros((terms, basis.shape[1]))
        out[parts["term"].to_numpy(dtype=np.int64)] = parts[names].to_numpy()
        out += share * _outer(wide.value, passage_of, passage_terms, dense)
        wide.destroy()
        return weight[:, None] * out

    basis = np.random.default_rng(7).standard_normal((terms, r))
    basis, _ = np.linalg.qr(product(basis))
    again = product(basis)
    values, vectors = np.linalg.eigh(basis.T @ again)
    rank = min(RANK, int((values > values[-1] * 1e-9).sum()))
    space.latent = (weight[:, None] * (basis @ vectors[:, ::-1][:, :rank])).astype(np.float32)
    size = np.array([len(p.terms) for p in space.passages])
    rng, low = np.random.default_rng(11), 0
    for top in CLASSES:
        own = np.flatnonzero((size > low) & (size <= top))
        low = top
        if len(own):
            rows = np.array([space.latent[space.passages[i].terms].sum(axis=0) for i in own])
            unit = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)
            near = [_nearness(space.latent, space.passages[i].terms, u, usual, passage_terms, top, rng) for i, u in zip(own, unit)]
            space.queries[top] = own, unit, np.array(near) >= COSINE + MARGIN
    return space


def _nearness(latent, own: list[int], unit, usual, others, top: int, rng) -> float:
    """The least cosine with a passage of trial windows that hold just enough of its words.

    The rest of a window is drawn from all documents' words, or runs on in the benchmark's passages.
    """
    words, least = np.array(own), int(np.ceil(COMMON_WORDS * len(own) - 1e-9))
    kept = np.argsort(rng.random((TRIALS, len(own))), axis=1)[:, :least]
    rest = top + top // 4 - least
    ends = np.cumsum(usual)
    drawn = np.searchsorted(ends, rng.random((TRIALS // 2, rest)), "right")
    blank = np.concatenate((latent, np.zeros((1, latent.shape[1]), latent.dtype)))
    runs = (rng.integers(0, len(others), (TRIALS - TRIALS // 2, 1)) + np.arange(rest)) % len(others)
    around = np.concatenate((np.minimum(drawn, len(latent)), others[runs]))
    rows = latent[words[kept]].sum(axis=1) + blank[around].sum(axis=1)
    return float((rows @ unit / np.maximum(np.linalg.norm(rows, axis=1), 1e-9)).min())


def _outer(wide: np.ndarray, window: np.ndarray, term: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Sum by term of the window rows that hold it; ``window`` is sorted.

    The counts of the ``dense`` terms, the commonest, are taken as tables; the others are sorted.
    """
    out = np.zeros(wide.shape)
    column = np.full(len(wide), -1)
    column[dense] = np.arange(len(dense))
    common = wide[dense]
    for first in range(int(window[0]), int(window[-1]) + 1, WINDOWS):
        a, b = np.searchsorted(window, (first, first + WINDOWS))
        which, own = window[a:b] - first, column[term[a:b]]
        held = own >= 0
        table = np.bincount(which[held] * len(dense) + own[held], minlength=WINDOWS * len(dense))
        table = table.reshape(WINDOWS, len(dense)).astype(np.float32)
        rows = table @ common
        rare, which = term[a:b][~held], which[~held]
        if len(rare):
            heads = np.flatnonzero(np.diff(which, prepend=-1))
            rows[which[heads]] += np.add.reduceat(wide[rare], heads, axis=0)
            order = np.argsort(rare, kind="stable")
            ordered = rare[order]
            heads = np.flatnonzero(np.diff(ordered, prepend=-1))
            out[ordered[heads]] += np.add.reduceat(rows[which[order]], heads, axis=0)
        out[dense] += table.T @ rows
    return out


def _sums(rows: np.ndarray, index: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sums of ``rows[index[first:stop]]`` for short runs of ``index``; the last of ``rows`` is zero."""
    out = np.zeros((len(first), rows.shape[1]), rows.dtype)
    for low in range(0, len(first), BLOCKS):
        a, b, part = first[low : low + BLOCKS], stop[low : low + BLOCKS], out[low : low + BLOCKS]
        for at in range(int((b - a).max())):
            place = index.take(np.minimum(a + at, len(index) - 1))
            part += rows.take(np.where(a + at < b, place, len(rows) - 1), axis=0)
    return out


def _marks(terms: int) -> list[np.ndarray]:
    """For each term its bit of ``MARKS`` numbers; several terms share one."""
    bit = np.arange(terms) % (64 * MARKS)
    return [np.where(bit // 64 == i, np.uint64(1) << (bit % 64).astype(np.uint64), np.uint64(0)) for i in range(MARKS)]


def _marked(marks: list[np.ndarray], hits: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """The marks of all terms of each block, and of none at the end."""
    full = np.flatnonzero(np.diff(edges))
    out = []
    for own in marks:
        row = np.zeros(len(edges), np.uint64)
        if len(full):
            row[full] = np.bitwise_or.reduceat(own[hits], edges[full])
        out.append(row)
    return out


def _near(own: np.ndarray, unit: np.ndarray, least: np.ndarray, places, edges, first, stop):
    """Windows and columns of the passages they are near to.

    Block ``i`` has the hits from ``edges[i]`` to ``edges[i + 1]`` and its place is ``places[i]``, the last
    one of which is zero; window ``j`` is the blocks from ``first[j]`` to before ``stop[j]``.
    """
    count = edges[stop] - edges[first]
    filled = np.flatnonzero(count >= least.min())
    at_once = max(1, COUNT_BYTES // (4 * len(own)))
    index = np.arange(len(places))
    for low in range(0, len(filled), at_once):
        window = filled[low : low + at_once]
        rows = _sums(places, index, first[window], stop[window])
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)
        w, column = np.nonzero(rows @ unit.T >= COSINE * norm[:, None])
        enough = count[window[w]] >= least[column]
        yield window[w[enough]], column[enough]


def _common(own: np.ndarray, spare: np.ndarray, own_marks: list[np.ndarray], window_marks: list[np.ndarray]):
    """Windows and passages of which they lack at most ``spare`` marks, so no more words than may be missed.

    Passages are taken ``COUNTED`` at a time, so the table stays small whatever the benchmark.
    """
    for first in range(0, len(own), COUNTED):
        part = own[first : first + COUNTED]
        at_once = max(1, PAIR_BYTES // (8 * len(part)))
        for low in range(0, len(window_marks[0]), at_once):
            missed = sum(
                np.bitwise_count(p[part] & ~w[low : low + at_once, None]) for p, w in zip(own_marks, window_marks)
            )
            window, column = np.nonzero(missed <= spare[part])
            if len(window):
                yield window + low, part[column]


def _verbatim(space: Space, lengths: np.ndarray, ids: np.ndarray):
    """Segments and numbers of the short texts that stand in them word for word."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    segment = np.repeat(np.arange(len(lengths)), lengths)
    by_first: dict[int, list[int]] = {}
    for i, (_, terms) in enumerate(space.short):
        by_first.setdefault(terms[0], []).append(i)
    at = np.flatnonzero(np.isin(ids, list(by_first)))
    order = at[np.argsort(ids[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(ids[order])) + 1
    for starts in np.split(order, cuts):
        for i in by_first[int(ids[starts[0]])] if len(starts) else ():
            terms = space.short[i][1]
            there = starts[starts + len(terms) <= ends[starts]]
            for j in range(1, len(terms)):
                there = there[ids[there + j] == terms[j]]
            for k in np.unique(segment[there]).tolist():
                yield k, i


def _search(space: Space, texts: list) -> list[list[dict]]:
    found: list[dict] = [{} for _ in texts]
    size = np.array([len(p.terms) for p in space.passages])
    answers = np.array([p.answer for p in space.passages])
    least = np.ceil(COMMON_WORDS * size - 1e-9).astype(np.uint8)
    spare = size - least
    marks = _marks(len(space.vocabulary))
    own_marks = [np.array([np.bitwise_or.reduce(x[p.terms]) for p in space.passages], np.uint64) for x in marks]
    if space.latent is not None:
        latent = np.concatenate((space.latent, np.zeros((1, space.latent.shape[1]), np.float32)))
    for owners, lengths, ids in _terms(iter(texts), space.vocabulary, PASSAGE_WORDS * 2):
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            continue
        hits = ids[at]
        if space.short:
            for k, i in _verbatim(space, lengths, ids):
                found[owners[k]][-1 - i] = {"item_id": space.short[i][0], "cosine": 1.0, "common": 1.0, "answer": 1.0}
        # The smallest blocks' sums serve every class: larger blocks are runs of them.
        fine = min((top for top, (_, _, held) in space.queries.items() if held.any()), default=0) // 4
        if fine:
            _, fine_start, fine_end = _windows(lengths, fine, fine)
            places = _sums(latent, np.where(ids < 0, len(latent) - 1, ids), fine_start, fine_end)
            places = np.concatenate((places, np.zeros((1, places.shape[1]), np.float32)))
        for top, (passages, units, held) in space.queries.items():
            step = top // 4
            segment, start, end = _windows(lengths, top + step, step)
            a, b = np.searchsorted(at, start), np.searchsorted(at, end)
            unit_of = {int(i): u for i, u in zip(passages, units)}
            # Blocks of a step lie from each window's start to the next; the last ones start none.
            owner, block_start, _ = _windows(lengths, step, step)
            edges = np.append(np.searchsorted(at, block_start), len(at))
            first = np.searchsorted(block_start, start, "right") - 1
            stop = np.minimum(first + 5, np.searchsorted(owner, segment, "right"))
            block_marks = _marked(marks, hits, edges)
            window_marks = []
            for row in block_marks:
                mark = row[first]
                for i in range(1, 5):
                    mark |= row[np.where(first + i < stop, first + i, len(block_start))]
                window_marks.append(mark)

            def candidates():
                if held.any():
                    own = passages[held]
                    starts = np.append(np.searchsorted(fine_start, block_start), len(fine_start))
                    inside = places if step == fine else _sums(places, np.arange(len(places)), starts, np.append(starts[1:], starts[-1]))
                    for window, column in _near(own, units[held], least[own], inside, edges, first, stop):
                        yield window, own[column]
                if not held.all():
                    yield from _common(passages[~held], spare, own_marks, window_marks)

            for windows, columns in candidates():
                # A passage's mark that the window lacks is a word missed; more than it may miss are too many.
                missed = sum(np.bitwise_count(p[columns] & ~w[windows]) for p, w in zip(own_marks, window_marks))
                windows, columns = windows[missed <= spare[columns]], columns[missed <= spare[columns]]
                for low in range(0, len(windows), PAIRS):
                    w, which = windows[low : low + PAIRS], columns[low : low + PAIRS]
                    inside = a[w, None] + np.arange(top + step)
                    rows = np.where(inside < b[w, None], hits[np.minimum(inside, len(hits) - 1)], len(space.vocabulary))
                    bits = common_subsequences(space, which, rows, COMMON_WORDS)
                    share = np.bitwise_count(bits) / size[which]
                    last = (size - answers)[which]
                    inner = np.bitwise_count(bits >> np.minimum(last, 63).astype(np.uint64))
                    answer = np.where(answers[which] > 0, inner / np.maximum(answers[which], 1), 1.0)
                    good = np.flatnonzero((share >= COMMON_WORDS) & (answer >= ANSWER_WORDS))
                    for i in good.tolist():
                        row = space.latent[hits[a[w[i]] : b[w[i]]]].sum(axis=0)
                        cosine = row @ unit_of[int(which[i])] / max(float(np.linalg.norm(row)), 1e-9)
                        hit = {
                            "item_id": space.passages[which[i]].item_id, "cosine": float(cosine),
                            "common": float(share[i]), "answer": float(answer[i]),
                        }
                        kept = found[owners[segment[w[i]]]]
                        best = kept.setdefault(int(which[i]), hit)
                        if (hit["common"], hit["cosine"]) > (best["common"], best["cosine"]):
                            kept[int(which[i])] = hit
    return [list(x.values()) for x in found]


_HITS = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64()),
]))
_HITS_DDL = "array<struct<item_id:bigint,cosine:double,common:double,answer:double>>"


def hits_column(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> Column:
    """A column over ``docs.text``: an array with one hit for each benchmark passage found.

    ``benchmark(item_id, text)`` is searched in blocks of about ``block_items`` texts, each with
    its own latent space. NULL benchmark texts and those without words find nothing; repeated ones are
    each found. A NULL or empty document has no hits; a long one is searched to its end.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-items.count() // block_items))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    columns = []
    for i in range(blocks):
        own = [(x.item_id, x.text) for x in items.where(block == i).orderBy("item_id", "text").collect()]
        space = fit(docs, own)
        if space is None:
            continue
        shared = spark.sparkContext.broadcast(space)

        def start(shared=shared):
            return lambda texts: _search(shared.value, texts)

        columns.append(by_batch(start, _HITS, _HITS_DDL)("text"))
    if not columns:
        return F.array().cast(_HITS_DDL)
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, hits`` for every row of ``docs``; see :func:`hits_column`."""
    return docs.select("doc_id", hits_column(docs, benchmark).alias("hits"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, unchanged, repeated ones and NULLs too."""
    return docs.where(F.size(hits_column(docs, benchmark)) == 0)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_passages, item_ids, best_common, best_cosine`` of every document.

    A row for each row of ``docs``, repeated ones too. Without a hit, as for NULL and empty texts, item
    ids are empty and both measures NULL. A hit of a NULL item_id counts but names no item.
    """
    ids = F.array_sort(F.array_distinct(F.col("hits.item_id")))
    return search(docs, benchmark).select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").alias("n_passages"),
        F.concat_ws(",", F.transform(ids, lambda x: x.cast("string"))).alias("item_ids"),
        F.array_max("hits.common").alias("best_common"),
        F.array_max("hits.cosine").alias("best_cosine"),
    )
