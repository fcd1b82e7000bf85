"""Language identification with Kneser-Ney character models.

Each language has an interpolated Kneser-Ney model of character n-grams. All models sit in one set
of sorted hash arrays, a key array for each order with one row of log-probabilities by language
beside it, so a text is looked up once for all languages. The language with the lowest cross-entropy
per character wins; a calibration fold that took no part in the counts tells how far above its mean
a genuine text's cross-entropy lies at a given length, and texts beyond that are rejected.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise.llm.common import by_batch, held_out, ship, short_batches
from returnwise.session import materialise

UNKNOWN = "und"
ORDER = 4
#: Labelled documents to learn from and to calibrate on, for each language. They are chosen by a
#: hash of their id; which ones and how many is the same for any layout of the table.
LEARN_DOCS = 1500
CALIBRATE_DOCS = 500
#: Calibration texts from which a language's own spread is taken alone.
OWN_SPREAD = 20
#: A text is rejected beyond this many times the deviation that all but one in a thousand
#: calibration texts stay within.
REJECT_QUANTILE = 0.999
REJECT_MARGIN = 2.0
#: Characters taken at a time; longer texts go slice by slice.
SLICE = 500_000
BATCH = 1 << 17

_SPACE = 32


def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)], dtype=bool)


class Reader:
    """Texts as arrays of lower-case letters with single spaces between words."""

    def __init__(self):
        self.letter = _is_letter()

    def codes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = self.letter[np.minimum(raw, 0xFFFF)]
        far = raw > 0xFFFF
        if far.any():
            letter[far] = [chr(c).isalpha() for c in raw[far].tolist()]
        out = np.where(letter, np.where(far, 0x8000 | (raw & 0x7FFF), raw), _SPACE).astype(np.uint16)
        keep = np.empty(len(out) + 1, dtype=bool)
        padded = np.concatenate(([_SPACE], out, [_SPACE])).astype(np.uint16)
        keep = (padded[1:] != _SPACE) | (padded[:-1] != _SPACE)
        return np.concatenate((padded[:1], padded[1:][keep]))

    def slices(self, text: str | None) -> Iterator[np.ndarray]:
        for at in range(0, len(text or ""), SLICE):
            yield self.codes(text[at : at + SLICE])


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Keys of all n-grams, 16 bits a character, first character highest."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    key = codes[:n].astype(np.uint64)
    for i in range(1, order):
        key = (key << np.uint64(16)) | codes[i : n + i]
    return key


@dataclass
class Model:
    """Sorted key arrays by order, with log10 rows by language, and the calibration."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    reject: float = math.inf
    sharpness: float = 1.0

    def entropy(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log10 losses by language, and characters predicted, of each array of codes."""
        lengths = np.array([max(0, len(p) - 1) for p in pieces])
        total = np.zeros((len(pieces), len(self.languages)))
        if not lengths.sum():
            return total, lengths
        rows = []
        for i, p in enumerate(pieces):
            if len(p) > 1:
                rows.append(np.concatenate((np.full(ORDER - 2, _SPACE, np.uint16), p)))
        owner = np.flatnonzero(lengths)
        joined = np.concatenate(rows)
        starts = np.cumsum([0, *(len(r) for r in rows)])
        keys = grams(joined, ORDER)
        wanted = np.ones(len(joined), dtype=bool)
        for s in starts[1:]:
            wanted[s - (ORDER - 1) : s] = False
        keys = keys[wanted[: len(keys)]]
        ends = np.cumsum(lengths[owner])
        values = self._logs(keys, ORDER)
        total[owner] = -np.add.reduceat(values, np.concatenate(([0], ends[:-1])), axis=0, dtype=np.float64)
        return total, lengths

    def _logs(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.floor, dtype=np.float32)
        table = self.keys[order - 1]
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        out = self.logs[order - 1][at]
        missing = np.flatnonzero(table[at] != keys)
        if len(missing):
            rest = keys[missing]
            lower = self._logs(rest & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
            known = self.contexts[order - 1]
            context = rest >> np.uint64(16)
            spot = np.minimum(np.searchsorted(known, context), len(known) - 1)
            held = known[spot] == context
            out[missing] = lower + np.where(held[:, None], self.backoff[order - 1][spot], 0)
        return out


def _kneser_ney(counts: list[tuple[np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """The joint tables from ``(keys, counts)`` of the highest order for each language."""
    letters = len({int(k) & 0xFFFF for keys, _ in counts for k in np.unique(keys & np.uint64(0xFFFF))})
    floor = -math.log10(letters + 1)
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [list(counts)]
    for order in range(ORDER - 1, 0, -1):
        mask = np.uint64((1 << (16 * order)) - 1)
        # Below the highest order a gram counts the different characters seen before it.
        levels.insert(0, [np.unique(keys & mask, return_counts=True) for keys, _ in levels[0]])
    model = Model(languages, [], [], [], [], floor)
    for order, level in enumerate(levels, 1):
        union = np.unique(np.concatenate([k for k, _ in level]))
        contexts = np.unique(union >> np.uint64(16))
        lower = 10.0 ** model._logs(union & np.uint64((1 << (16 * (order - 1))) - 1), order - 1).astype(float)
        values = np.empty((len(union), len(languages)), dtype=np.float32)
        weights = np.zeros((len(contexts), len(languages)), dtype=np.float32)
        for j, (keys, n) in enumerate(level):
            once, twice = int((n == 1).sum()), int((n == 2).sum())
            discount = once / (once + 2 * twice) if once else 0.5
            place = np.searchsorted(contexts, keys >> np.uint64(16))
            total = np.bincount(place, n, len(contexts))
            kinds = np.bincount(place, minlength=len(contexts))
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.zeros(len(union))
            own[np.searchsorted(union, keys)] = np.maximum(n - discount, 0)
            home = np.searchsorted(contexts, union >> np.uint64(16))
            values[:, j] = np.log10(own / np.maximum(total[home], 1) + gamma[home] * lower[:, j])
            weights[:, j] = np.log10(gamma)
        model.keys.append(union)
        model.logs.append(values)
        model.contexts.append(contexts)
        model.backoff.append(weights)
    return model


def learn(docs: DataFrame, usable, learn_docs: int = LEARN_DOCS, calibrate_docs: int = CALIBRATE_DOCS) -> Model | None:
    """The models of all languages in ``docs(doc_id, text, lang)`` where ``usable`` holds.

    Learned from a bounded sample for each language, chosen by a hash of the id; None where no row
    is usable. Counting runs on the executors; the driver gets the distinct n-grams of the sample.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    most = 1 << 30
    share = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(most))
    table = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(n))])
    edge = lambda n: F.least(F.lit(float(most)), F.lit(float(most) * n) / table[F.col("lang")])
    chosen = materialise(
        rows.where(share < edge(learn_docs + calibrate_docs)).select(
            "lang", "text",
            (share % 4 == 3 if calibrate_docs else F.lit(False)).alias("calibrates"),
        )
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            found: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for codes in reader.slices(text):
                    if len(codes) > 1:
                        codes = np.concatenate((np.full(ORDER - 2, _SPACE, np.uint16), codes))
                        found.setdefault(lang, []).append(grams(codes, ORDER))
            for lang, keys in found.items():
                own, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(own), pa.string()),
                    "gram": pa.array(own.view(np.int64)), "n": pa.array(n.astype(np.int64)),
                })

    counted = (
        chosen.where("not calibrates").select("lang", "text")
        .mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    by_lang = {}
    for lang, part in counted.groupby("lang"):
        keys = part["gram"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        by_lang[lang] = (keys[order], part["n"].to_numpy()[order])
    languages = [x for x in languages if x in by_lang]
    if not languages:
        return None
    model = _kneser_ney([by_lang[x] for x in languages], languages)
    _calibrate(model, chosen.where("calibrates"))
    return model


def _spread(n: np.ndarray, square: np.ndarray) -> tuple[float, float]:
    """Variance between texts, and the part that falls with length."""
    return max(np.median(square[n >= np.median(n)]), 1e-6), max(np.median(square * n), 1e-6)


def _calibrate(model: Model, rows: DataFrame) -> None:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("n", pa.int64()), ("loss", pa.list_(pa.float64()))])

    def start():
        scorer = _scorer(shared.value)

        def work(texts):
            loss, n = scorer(texts)
            return [{"n": int(a), "loss": b.tolist()} for a, b in zip(n, loss)]

        return work

    seen = rows.select("lang", by_batch(start, kind, "struct<n:bigint,loss:array<double>>")("text").alias("s"))
    seen = seen.where("s.n > 1").select("lang", "s.n", "s.loss").collect()
    count = len(model.languages)
    model.mean, model.spread = np.full(count, math.nan), np.full((count, 2), math.nan)
    deviations, known = [], []
    texts = [np.array([(r.n, r.loss[j] / r.n) for r in seen if r.lang == lang]).reshape(-1, 2) for j, lang in enumerate(model.languages)]
    for j, own in enumerate(texts):
        if len(own):
            model.mean[j] = np.median(own[:, 1])
        if len(own) >= OWN_SPREAD:
            model.spread[j] = _spread(own[:, 0], (own[:, 1] - model.mean[j]) ** 2)
    # The others take the spread of all languages, or their own if it is larger, and what so few
    # texts leave open about the mean; without any text the largest mean of a language stands in.
    if any(map(len, texts)):
        most, differ = np.nanmax(model.mean), np.nanvar(model.mean)
        several = [(own, len(own) / (len(own) - 1), m) for own, m in zip(texts, model.mean) if len(own) > 1]
        several = several or [(np.concatenate(texts), 1.0, np.nanmedian(model.mean))]
        pooled = _spread(
            np.concatenate([own[:, 0] for own, _, _ in several]),
            np.concatenate([(own[:, 1] - m) ** 2 * f for own, f, m in several]),
        )
        for j, own in enumerate(texts):
            if len(own) >= OWN_SPREAD:
                continue
            model.spread[j] = pooled
            if len(own) > 1:
                model.spread[j] = np.maximum(pooled, _spread(own[:, 0], (own[:, 1] - model.mean[j]) ** 2))
            if len(own):
                model.spread[j, 0] *= 1 + 1 / len(own)
            else:
                model.mean[j] = most
                model.spread[j, 0] += differ
    for j, own in enumerate(texts):
        if len(own) > 1:
            n, h = own.T
            deviations.extend((h - model.mean[j]) / np.sqrt(model.spread[j, 0] + model.spread[j, 1] / n))
    if deviations:
        model.reject = REJECT_MARGIN * max(1.0, float(np.quantile(deviations, REJECT_QUANTILE)))
    for r in seen:
        if r.lang in model.languages:
            known.append((r.n, np.array(r.loss), model.languages.index(r.lang)))
    best = math.inf
    for power in np.arange(-4, 8.01, 0.5):
        sharp = 2.0**power
        wrong = sum(
            -math.log(max(1e-12, _share(loss, n, sharp)[right])) for n, loss, right in known
        )
        if wrong < best:
            best, model.sharpness = wrong, sharp


def _share(loss: np.ndarray, n: int, sharpness: float) -> np.ndarray:
    x = -sharpness * loss / math.sqrt(max(n, 1))
    e = np.exp(x - x.max())
    return e / e.sum()


def _scorer(model: Model):
    """Texts to ``(losses, characters)``; characters count only where the text has a letter."""
    reader = Reader()

    def work(texts: list) -> tuple[np.ndarray, np.ndarray]:
        loss = np.zeros((len(texts), len(model.languages)))
        n = np.zeros(len(texts), dtype=np.int64)
        pieces, owners, held = [], [], 0

        def flush():
            nonlocal held
            a, b = model.entropy(pieces)
            np.add.at(loss, owners, a)
            np.add.at(n, owners, b)
            pieces.clear()
            owners.clear()
            held = 0

        for i, text in enumerate(texts):
            for codes in reader.slices(text):
                if len(codes) > 1:
                    pieces.append(codes)
                    owners.append(i)
                    held += len(codes)
                    if held >= BATCH:
                        flush()
        if pieces:
            flush()
        return loss, n

    return work


_RESULT = pa.struct([
    ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()),
    ("rejected", pa.bool_()),
])
_RESULT_DDL = "struct<lang_pred:string,score:double,cross_entropy:double,rejected:boolean>"


def prediction(spark, model: Model | None):
    """A column function from text to lang_pred, score, cross_entropy (log10) and rejected.

    A text that is NULL or has no letter is ``und`` with score 0 and rejected. Otherwise lang_pred
    is the nearest language even if rejected. Without a model everything is ``und``.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def start():
        model = shared.value
        none = {"lang_pred": UNKNOWN, "score": 0.0, "cross_entropy": None, "rejected": True}
        if model is None:
            return lambda texts: [none] * len(texts)
        scorer = _scorer(model)

        def work(texts):
            out = []
            for loss, n in zip(*scorer(texts)):
                if not n:
                    out.append(none)
                    continue
                j = int(loss.argmin())
                h = float(loss[j] / n)
                off = (h - model.mean[j]) / math.sqrt(model.spread[j, 0] + model.spread[j, 1] / n)
                out.append({
                    "lang_pred": model.languages[j], "score": float(_share(loss, n, model.sharpness)[j]),
                    "cross_entropy": h, "rejected": bool(off > model.reject),
                })
            return out

        return work

    return by_batch(start, _RESULT, _RESULT_DDL)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, rejected`` for every row of ``docs``.

    Learned from the text and lang of rows that are not held out and have both. Repeated rows are
    each returned; other columns are ignored.
    """
    kept = held_out("doc_id", 4, 2)
    model = learn(docs, ~kept)
    return docs.select(
        "doc_id", kept.alias("held_out"), prediction(docs.sparkSession, model)("text").alias("p")
    ).select("doc_id", "held_out", "p.*")


def accept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is accepted as one of its languages, unchanged.

    NULL, empty and letterless texts are rejected; repeated rows are each judged. Where no row has
    both a text and a lang to learn from, nothing can be called foreign: every row with a letter stays.
    """
    short_batches(docs.sparkSession)
    model = learn(docs, ~held_out("doc_id", 4, 2))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(~prediction(docs.sparkSession, model)("text")["rejected"])
