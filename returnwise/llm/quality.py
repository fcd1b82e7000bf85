"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; the other side is unlabelled text from the whole
table, which holds good and bad documents alike. With the share of good documents estimated from
the labels, the non-negative unbiased risk stands in for the risk on labelled negatives: the part of
the unlabelled loss that good documents explain is taken out, and never counts below zero. A small
network over properties of the text minimises it, and its output is calibrated to the labels.
"""

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise.llm.common import by_batch, held_out, ship

#: Rows learned from on each side, chosen by a hash of the id.
POSITIVES = 8000
UNLABELLED = 8000
HIDDEN = 16
STEPS = 1500
BATCH = 512
RATE = 0.01
DECAY = 1e-4
#: How far below zero the negative risk may fall before its gradient is turned round.
SLACK = 0.0
THRESHOLD = 0.7
SEED = 11

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]


def features(text: str | None) -> list[float]:
    """Properties of a whole text; a NULL text is an empty one."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    n = max(1, len(data))
    letters = max(1.0, count[_UPPER].sum() + count[_LOWER].sum() + count[128:].sum())
    words = data.split()
    m = max(1, len(words))
    often = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    triples = set(zip(words, words[1:], words[2:]))
    shown = count[_PUNCTUATION].sum()
    return [
        math.log1p(len(data)), count[_UPPER].sum() / letters, count[_DIGIT].sum() / n, shown / n,
        count[33] / n, count[124] / n, (count[46] + count[44]) / n, count[10] / n, count[128:].sum() / n,
        (count[60] + count[62] + count[123] + count[125]) / n,
        sum(map(len, words)) / m / 10, len(often) / m, math.log1p(len(often)) / math.log1p(m + 1),
        max(often.values(), default=0) / m, sum(map(eq, words, words[1:])) / m,
        len(triples) / max(1, m - 2) if m > 2 else 1.0,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(m / max(1, len(lines))),
        sum(1 for w in often if w.isupper()) / max(1, len(often)),
    ]


WIDTH = len(features(""))


class Network:
    """One hidden layer over standardised features, and a calibrated logistic output."""

    def __init__(self, rows: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.centre, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
        self.weights = [
            rng.standard_normal((WIDTH, HIDDEN)) / math.sqrt(WIDTH), np.zeros(HIDDEN),
            rng.standard_normal(HIDDEN) / math.sqrt(HIDDEN), np.zeros(1),
        ]
        self.slope, self.shift = 1.0, 0.0

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(x @ a + b) @ c + d

    def gradient(self, x: np.ndarray, out: np.ndarray) -> list[np.ndarray]:
        """Gradients of ``(margins * out).sum()``."""
        a, b, c, _ = self.weights
        h = np.tanh(x @ a + b)
        inner = out[:, None] * c * (1 - h * h)
        return [x.T @ inner, inner.sum(axis=0), h.T @ out, np.array([out.sum()])]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        z = self.slope * self.margin(self.standard(rows)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
    """Minimise the non-negative risk with the sigmoid loss by Adam."""
    net = Network(np.concatenate([positive, unlabelled]))
    p, u = net.standard(positive), net.standard(unlabelled)
    rng = np.random.default_rng(SEED)
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    for step in range(1, STEPS + 1):
        xp = p[rng.integers(0, len(p), min(BATCH, len(p)))]
        xu = u[rng.integers(0, len(u), min(BATCH, len(u)))]
        sp, su = _sigmoid(net.margin(xp)), _sigmoid(net.margin(xu))
        # Losses: 1 - s for calling a row negative that is positive, s the other way round.
        negative = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / len(xp), su * (1 - su) / len(xu)
        if negative >= -SLACK:
            grads = [a + b for a, b in zip(net.gradient(xp, -2 * prior * dp), net.gradient(xu, du))]
        else:
            grads = [a + b for a, b in zip(net.gradient(xp, prior * dp), net.gradient(xu, -du))]
        for i, g in enumerate(grads):
            g = g + DECAY * net.weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            net.weights[i] = net.weights[i] - RATE * (first[i] / (1 - 0.9**step)) / (
                np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
            )
    return net


def _calibrate(net: Network, rows: np.ndarray, labels: np.ndarray) -> None:
    """Slope and shift of the output by Newton steps of a logistic fit to the labels."""
    z = net.margin(net.standard(rows))
    x = np.stack([z, np.ones_like(z)], axis=1)
    # Platt's targets keep the fit finite where the classes part completely.
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        s = _sigmoid(x @ w)
        hessian = (x * (s * (1 - s))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (s - target) + 1e-6 * w)
        w = w - move / max(1.0, np.abs(move).max() / 2)
        if np.abs(move).max() < 1e-8:
            break
    net.slope, net.shift = max(float(w[0]), 1e-6), float(w[1])


def learn(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED
) -> Network | float:
    """A network, or a constant score where the labels hold no good document to learn from.

    ``labels(doc_id, quality)`` counts once for each document, by the mean of its rows; rows with
    NULL in either are no labels. Held-out documents take no part, as labelled or as unlabelled.
    """
    ship(docs.sparkSession)
    known = (
        labels.where(~held_out("doc_id", 4, 2) & F.col("quality").isNotNull())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    )
    total = known.agg(F.count("*").alias("n"), F.sum("good").alias("good")).first()
    if not total.n or not total.good:
        return 0.5 if not total.n else 0.0
    prior = total.good / total.n
    share = lambda salt, n, of: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < min(
        1 << 30, int((1 << 30) * n / max(of, 1))
    )

    def work(texts):
        return [features(t) for t in texts]

    row = by_batch(lambda: work, pa.list_(pa.float64()), "array<double>")("text")
    # At most about ``positives`` labelled rows on either side of the join, whatever the tables' size.
    chosen = known.where(share("labelled", positives, total.n)).withColumnRenamed("doc_id", "__id")
    seen = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    seen = seen.select("good", row.alias("x")).collect()
    usable = docs.select("doc_id", "text").where(~held_out("doc_id", 4, 2))
    rest = usable.where(share("unlabelled", unlabelled, usable.count())).select(row.alias("x")).collect()
    good = np.array([r.x for r in seen if r.good])
    if not len(good) or not rest:
        return prior
    net = train(good, np.array([r.x for r in rest]), min(prior, 0.99))
    _calibrate(net, np.array([r.x for r in seen]), np.array([r.good for r in seen], dtype=float))
    return net


def score_column(spark, net: Network | float):
    """A column function from text to its score, 0 to 1."""
    ship(spark)
    shared = spark.sparkContext.broadcast(net)

    def start():
        net = shared.value
        if isinstance(net, float):
            return lambda texts: [net] * len(texts)
        return lambda texts: net.probability(np.array([features(t) for t in texts])).tolist() if texts else []

    return by_batch(start, pa.float64(), "double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; other columns are ignored."""
    net = learn(docs, labels)
    return docs.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"),
        score_column(docs.sparkSession, net)("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
