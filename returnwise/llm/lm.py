"""Document scores of a gated recurrent language model.

Words are predicted in two steps, the class and then the word within it. The commonest words have
classes of their own inside the network; every other word falls into a class by its ending, within
which its smoothed corpus count decides, so each text has a proper probability whatever its words.
Counts cover all training documents and stay distributed: the commonest words travel to every task
as a table of bounded size, the rest meet their counts in a join. The network learns by truncated
backpropagation on all training documents. They are dealt by hash into shards of a set size and order,
and the shards' parameters are averaged after each round, so a model doesn't depend on how many files
or tasks hold the table. Scoring carries the state from window to window through the whole document.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise.llm.common import by_batch, held_out, ship
from returnwise.session import materialise

#: Words whose counts every task holds; others are joined.
HEAD = 200_000
#: Words that the network tells apart, in classes of this many; and classes by ending for the rest.
WORDS, CLASS_WORDS, ENDINGS = 1024, 32, 32
EMBEDDING, HIDDEN = 16, 24
#: Passes over all training documents.
ROUNDS = 4
RATE = 0.01
#: Streams of text learned from side by side, steps of a window of backpropagation, and moves of a pass: a
#: shard that would take more has more streams, up to the second number.
STREAMS, MOST_STREAMS, STEPS, MOVES = 128, 512, 16, 245
#: Tokens of a shard, about; tokens held at a time; and shards averaged at a time.
SHARD, HELD, AVERAGED = 2_000_000, 3_000_000, 64
#: Documents scored side by side, and steps between evaluations of the output layer.
SCORED, WINDOW = 2048, 32
#: States whose classes are weighed at a time.
BLOCK = 512
#: Different words that a counting task holds before it passes its counts on.
COUNTED = 300_000

END = b""  # the token that ends every text; no word is empty


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


class Network:
    """A gated recurrent unit with a class-factored output, in numpy."""

    NAMES = ("E", "W", "U", "b", "C", "c", "O", "o")

    def __init__(self, class_mass: np.ndarray, word_mass: np.ndarray, hidden: int = HIDDEN, embedding: int = EMBEDDING):
        """Starts as the counts' own distribution: ``word_mass`` is by word, in whole classes."""
        rng = np.random.default_rng(5)
        self.words = len(word_mass)
        self.own = -(-self.words // CLASS_WORDS)
        pad = self.own * CLASS_WORDS
        mass = np.zeros(pad)
        mass[: self.words] = word_mass
        with np.errstate(divide="ignore"):
            self.o = np.where(mass > 0, np.log(np.maximum(mass, 1e-9)), -30).astype(np.float32)
        self.c = np.log(np.maximum(class_mass, 1e-9)).astype(np.float32)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.E = normal(pad + ENDINGS, embedding) * 3
        self.W, self.U = normal(embedding, 3 * hidden) * 3, normal(hidden, 3 * hidden) * 2
        self.b = np.zeros(3 * hidden, np.float32)
        self.C, self.O = np.zeros((hidden, len(class_mass)), np.float32), np.zeros((pad, hidden), np.float32)
        self.hidden = hidden

    def classes(self, ids: np.ndarray) -> np.ndarray:
        """Words come first, then one id for each ending."""
        pad = self.own * CLASS_WORDS
        return np.where(ids < pad, ids // CLASS_WORDS, self.own + ids - pad)

    def step(self, x: np.ndarray, h: np.ndarray):
        """The next state from the input's part ``x`` of the gates, and what its gradient needs.

        States and gates have a column for each text, so every gate is one run of memory.
        """
        n = self.hidden
        g = self.U.T @ h
        zr = x[: 2 * n] + g[: 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, g = zr[:n], zr[n:], g[2 * n :]
        new = r * g
        new += x[2 * n :]
        np.tanh(new, out=new)
        after = h - new
        after *= z
        after += new
        return after, (z, r, new, g)

    def losses(self, h: np.ndarray, ids: np.ndarray, gradient: bool = False):
        """Natural log-probabilities of ``ids`` after states ``h``; with the gradient of their sum.

        ``h`` has a column for each id, and below the state a row of ones that carries the biases.
        """
        n, kind = self.hidden, self.classes(ids)
        above, within = np.vstack((self.C, self.c)), np.column_stack((self.O, self.o))
        out = np.empty(len(ids), h.dtype)
        if gradient:
            d_above, d_within, dh = np.zeros_like(above), np.zeros_like(within), np.empty((n, len(ids)), h.dtype)
        for a in range(0, len(ids), BLOCK):
            part = slice(a, a + BLOCK)
            own, mine = h[:, part], (kind[part], np.arange(len(kind[part])))
            e = above.T @ own
            e -= e.max(axis=0)
            picked = e[mine]
            np.exp(e, out=e)
            total = e.sum(axis=0)
            out[part] = picked - np.log(total)
            if gradient:
                e *= -1 / total
                e[mine] += 1
                d_above += own @ e.T
                np.matmul(self.C, e, out=dh[:, part])
        order = np.argsort(kind.astype(np.int16), kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(self.own + 1))
        order = order[: cuts[-1]]
        states, place, inside = h.take(order, axis=1), ids[order] % CLASS_WORDS, np.empty(len(order), h.dtype)
        if gradient:
            d_states = np.empty((n, len(order)), h.dtype)
        for k in range(self.own):
            part, words = slice(cuts[k], cuts[k + 1]), slice(k * CLASS_WORDS, (k + 1) * CLASS_WORDS)
            if cuts[k] == cuts[k + 1]:
                continue
            own, mine = states[:, part], (place[part], np.arange(cuts[k + 1] - cuts[k]))
            e = within[words] @ own
            e -= e.max(axis=0)
            picked = e[mine]
            np.exp(e, out=e)
            total = e.sum(axis=0)
            inside[part] = picked - np.log(total)
            if gradient:
                e *= -1 / total
                e[mine] += 1
                d_within[words] = e @ own.T
                np.matmul(self.O[words].T, e, out=d_states[:, part])
        out[order] += inside
        if not gradient:
            return out
        dh[:, order] += d_states
        return out, {"C": d_above[:n], "c": d_above[n], "O": d_within[:, :n], "o": d_within[:, n]}, dh

    def window(self, ids: np.ndarray, mask: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None):
        """Sum of log-probabilities over ``ids[step, stream]``, its gradients, and the last states.

        Gradients stop at the window's start; states go on where ``mask`` holds and are zero where a
        text begins, which ``fresh`` marks.
        """
        steps, streams = ids.shape
        n, kind = self.hidden, self.U.dtype
        flat, whole = ids.ravel(), bool(mask.all())
        begins = [np.flatnonzero(row) for row in fresh] if fresh is not None else [()] * steps
        table = np.ascontiguousarray((self.E @ self.W + self.b).T)
        # A column for each step and stream; the row of ones carries the biases.
        before, kept = np.ones((n + 1, steps, streams), kind), []
        h = h.T.astype(kind)
        for t in range(steps):
            if len(begins[t]):
                h[:, begins[t]] = 0
            before[:n, t] = h
            after, parts = self.step(table.take(ids[t], axis=1), h)
            kept.append(parts)
            h = after if whole else np.where(mask[t], after, h)
        states = before.reshape(n + 1, -1)
        if whole:
            out, grads, direct = self.losses(states, flat, gradient=True)
        else:
            at = np.flatnonzero(mask.ravel())
            out, grads, some = self.losses(states.take(at, axis=1), flat[at], gradient=True)
            direct = np.zeros((n, len(flat)), kind)
            direct[:, at] = some
        direct = direct.reshape(n, steps, streams)
        dx, dg = np.empty((3 * n, steps, streams), kind), np.empty((3 * n, steps, streams), kind)
        dh = np.zeros((n, streams), kind)
        for t in range(steps - 1, -1, -1):
            z, r, new, g = kept[t]
            live = dh if whole else np.where(mask[t], dh, 0)
            carried = live * z
            dnew = new * new
            np.subtract(1, dnew, out=dnew)
            dnew *= live - carried
            dz = before[:n, t] - new
            dz *= carried
            dz *= 1 - z
            dr = dnew * r
            dg[2 * n :, t] = dr
            dr *= g
            dr *= 1 - r
            dx[:n, t], dx[n : 2 * n, t], dx[2 * n :, t] = dz, dr, dnew
            dg[:n, t], dg[n : 2 * n, t] = dz, dr
            if not whole:
                carried = np.where(mask[t], carried, dh)
            dh = self.U @ dg[:, t]
            dh += carried
            dh += direct[:, t]
            if len(begins[t]):
                dh[:, begins[t]] = 0
        dx, dg = dx.reshape(3 * n, -1), dg.reshape(3 * n, -1)
        grads["U"] = states[:n] @ dg.T
        # Gates' gradients are summed by word read; its embedding and ``W`` have theirs from the sums.
        order = np.argsort(flat.astype(np.int16), kind="stable")
        read, first = np.unique(flat[order], return_index=True)
        sums = np.add.reduceat(dx.take(order, axis=1), first, axis=1)
        grads["W"] = (sums @ self.E[read]).T
        grads["b"] = sums.sum(axis=1)
        grads["E"] = np.zeros_like(self.E)
        grads["E"][read] = (self.W @ sums).T
        return float(out.sum()), grads, h.T

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10-probability of each document of ids, the state carried through all of it."""
        result = np.zeros(len(texts))
        table = np.ascontiguousarray((self.E @ self.W + self.b).T)
        order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])), dtype=np.int64)
        for a in range(0, len(order), SCORED):
            own = order[a : a + SCORED]
            lengths = np.array([len(texts[i]) for i in own])
            joined = np.concatenate([texts[i] for i in own])
            starts = np.cumsum(lengths) - lengths
            # Documents longer than t, for every step t.
            longer = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left").tolist()
            h = np.zeros((self.hidden, len(own)), table.dtype)
            for at in range(0, int(lengths[0]), WINDOW):
                lives = longer[at : at + WINDOW]
                ends = np.cumsum(lives).tolist()
                states = np.ones((self.hidden + 1, ends[-1]), table.dtype)
                targets = np.empty(ends[-1], joined.dtype)
                for t, (live, end) in enumerate(zip(lives, ends), at):
                    ids = joined[starts[:live] + t]
                    targets[end - live : end] = ids
                    states[: self.hidden, end - live : end] = h[:, :live]
                    h, _ = self.step(table.take(ids, axis=1), h[:, :live])
                loss = self.losses(states, targets)
                owners = np.concatenate([np.arange(live) for live in lives])
                result[own] += np.bincount(owners, loss, len(own))
        return result / math.log(10)

    def blocks(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, values[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size


class Learner:
    """Adam over a network; its moments go on from one lot of documents to the next."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.turn, self.seen = network, rate, 0, 0
        self.first = {k: np.zeros_like(getattr(network, k)) for k in network.NAMES}
        self.second = {k: np.zeros_like(getattr(network, k)) for k in network.NAMES}

    def learn(self, texts: list[np.ndarray]) -> None:
        """One pass over all tokens of documents of ids, in their order.

        The documents are joined and cut into streams of one length, whatever their own; the state is
        zero where a document or a stream begins.
        """
        ids = np.concatenate(texts).astype(np.int64)
        begins = np.zeros(len(ids), bool)
        begins[np.cumsum([0, *map(len, texts[:-1])])] = True
        most = int(np.clip(len(ids) // (MOVES * STEPS), STREAMS, MOST_STREAMS))
        streams = int(np.clip(len(ids) // (8 * STEPS), 1, most))
        length = -(-len(ids) // streams)
        spare = streams * length - len(ids)
        lay = lambda x: np.pad(x, (0, spare)).reshape(streams, length).T
        whole, fresh, live = lay(ids), lay(begins), lay(np.ones(len(ids), bool))
        h = np.zeros((streams, self.network.hidden), np.float32)
        for at in range(0, length, STEPS):
            part = slice(at, at + STEPS)
            count = int(live[part].sum())
            if count:
                _, grads, h = self.network.window(whole[part], live[part], h, fresh[part])
                self._move(grads, count, min(1.0, count / (streams * STEPS)))
        self.seen += len(ids)

    def _move(self, grads: dict, count: int, share: float) -> None:
        self.turn += 1
        for k in self.network.NAMES:
            g = np.clip(grads[k] / count, -1, 1)
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g * g
            step = (self.first[k] / (1 - 0.9**self.turn)) / (np.sqrt(self.second[k] / (1 - 0.99**self.turn)) + 1e-6)
            setattr(self.network, k, (getattr(self.network, k) + self.rate * share * step).astype(np.float32))


@dataclass
class Model:
    """Counts and network; ``counts`` is the whole table ``word, n``."""

    counts: DataFrame
    total: int
    different: int
    head: dict[bytes, int]
    ids: dict[bytes, int]
    network: Network
    class_total: np.ndarray  # by ending: smoothed total of the words that the network doesn't tell apart


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all of ``docs(text)``; ends included as the empty word."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def emit():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
            )
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
                if len(found) >= COUNTED:
                    yield emit()
        if found:
            yield emit()

    return docs.select("text").mapInArrow(work, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _to_ids(words: list[bytes], ids: dict[bytes, int], pad: int) -> np.ndarray:
    found = np.fromiter((ids.get(w, -1) for w in words), np.int64, len(words))
    rare = np.flatnonzero(found < 0)
    if len(rare):
        found[rare] = [pad + zlib.crc32(words[i][-3:]) % ENDINGS for i in rare.tolist()]
    return found


def learn(docs: DataFrame, train) -> Model | None:
    """The model of the rows of ``docs(doc_id, text)`` where ``train`` holds; None without any."""
    spark = docs.sparkSession
    ship(spark)
    chosen = docs.where(train)
    counts = materialise(count_words(chosen))
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    if not whole.v:
        return None
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    head = {bytes(r.word): r.n for r in top}
    ids = {w: i for i, w in enumerate(list(head)[:WORDS])}
    by_ending = by_batch(lambda: lambda words: [ending(w) for w in words], pa.int32(), "int")("word")
    sums = {
        r.ending: (r.n, r.v)
        for r in counts.groupBy(by_ending.alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    }
    rest, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for k, (n, v) in sums.items():
        rest[k], kinds[k] = n, v
    for w in ids:
        rest[ending(w)] -= head[w]
        kinds[ending(w)] -= 1
    mass = np.array([head[w] for w in ids], dtype=float)
    own = [mass[i : i + CLASS_WORDS].sum() for i in range(0, len(mass), CLASS_WORDS)]
    class_mass = np.concatenate((own, rest + 0.5 * (kinds + 1)))
    network = Network(class_mass / class_mass.sum(), mass)
    pad = network.own * CLASS_WORDS

    shared = spark.sparkContext.broadcast(ids)

    def coded(texts):
        return [_to_ids(tokens(t), shared.value, pad).tolist() for t in texts]

    shards = max(1, -(-whole.n // SHARD))
    coded_column = by_batch(lambda: coded, pa.list_(pa.int16()), "array<smallint>")("text")
    # Equal rows travel once with their number, so a repeated row cannot crowd one shard.
    known = materialise(
        chosen.select("doc_id", coded_column.alias("ids")).groupBy("doc_id", "ids").count()
        .select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
        .select("ids", F.xxhash64("doc_id", "ids", "copy").alias("place"))
        .withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    )
    for i in range(ROUNDS):
        network = _round(known, network, shards, RATE * (1 - i / ROUNDS))
    return Model(counts, whole.n, whole.v, head, ids, network, rest + 0.5 * (kinds + 1))


def _round(known: DataFrame, network: Network, shards: int, rate: float, block: int = 4096) -> Network:
    """The average of the shards' networks after each has learned from its ``known(ids, place, shard)``."""
    shared = known.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        shard, mine, texts, held = None, None, [], 0

        def flush():
            nonlocal texts, held
            if texts:
                mine.learn(texts)
            texts, held = [], 0

        def result():
            flush()
            values = mine.network.blocks().astype(float)
            parts = [values[i : i + block] for i in range(0, len(values), block)]
            return pa.RecordBatch.from_pydict({
                "part": pa.array(range(len(parts)), pa.int32()), "shard": pa.array([shard] * len(parts), pa.int32()),
                "seen": pa.array([mine.seen] * len(parts), pa.int64()),
                "weights": pa.array([p.tolist() for p in parts], pa.list_(pa.float64())),
            })

        for batch in batches:
            column = batch.column(0)
            own = np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])
            for text, k in zip(own, batch.column(1).to_pylist()):
                if k != shard:
                    if mine is not None:
                        yield result()
                    shard, mine = k, Learner(copy.deepcopy(shared.value), rate)
                texts.append(text)
                held += len(text)
                if held >= HELD:
                    flush()
        if mine is not None:
            yield result()

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        weight = group.column("seen").to_numpy().astype(float)
        flat = group.column("weights").combine_chunks()
        rows = flat.flatten().to_numpy().reshape(len(flat), -1)
        average = (weight @ rows) / weight.sum()
        return pa.table({
            "part": group.column("part")[:1], "shard": pa.array([group.column("shard")[0].as_py() // AVERAGED], pa.int32()),
            "seen": pa.array([int(weight.sum())], pa.int64()),
            "weights": pa.array([average.tolist()], pa.list_(pa.float64())),
        })

    ddl = "part int, shard int, seen bigint, weights array<double>"
    parts = (
        known.repartition(shards, "shard").sortWithinPartitions("shard", "place")
        .select("ids", "shard").mapInArrow(work, ddl)
    )
    left = shards
    while True:
        parts = parts.groupBy("part", (F.col("shard") / AVERAGED).cast("int")).applyInArrow(mean, ddl)
        left = -(-left // AVERAGED)
        if left == 1:
            break
    rows = parts.orderBy("part").collect()
    if rows:
        network.load(np.concatenate([np.array(p.weights, np.float32) for p in rows]))
    shared.destroy()
    return network


_SCORED = pa.struct([
    ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()),
    ("rare", pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32()), ("ending", pa.int32())]))),
])
_SCORED_DDL = (
    "struct<n_tokens:bigint,known:bigint,base:double,model:double,"
    "rare:array<struct<word:binary,times:int,ending:int>>>"
)


def score(docs: DataFrame, train, held) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)`` by the model of the rows where ``train`` holds.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. A NULL text is
    empty and has the end alone. Without any row to learn from every token counts nothing and both
    scores are zero. Repeated rows are each scored; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    model = learn(docs, train)
    if model is None:
        count = by_batch(lambda: lambda texts: [len(tokens(t)) for t in texts], pa.int64(), "bigint")("text")
        zero = F.lit(0).cast("long")
        return docs.select(
            "doc_id", held.alias("held_out"), count.alias("n_tokens"), zero.alias("n_known"),
            zero.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"),
        )
    below = model.total + 0.5 * (model.different + 1)
    shared = spark.sparkContext.broadcast((model.head, model.ids, model.network, model.class_total))

    def start():
        head, ids, network, class_total = shared.value
        pad = network.own * CLASS_WORDS
        # For each held word: its base log, and its log within its ending's class (0 inside the network).
        base = {w: math.log10((n + 0.5) / below) for w, n in head.items()}
        inner = {
            w: 0.0 if w in ids else math.log10((n + 0.5) / class_total[ending(w)]) for w, n in head.items()
        }

        def work(texts):
            coded, out = [], []
            for text in texts:
                words = tokens(text)
                coded.append(_to_ids(words, ids, pad))
                rare: Counter = Counter(w for w in words if w not in base)
                unheld = sum(rare.values())
                out.append({
                    "n_tokens": len(words), "known": len(words) - unheld,
                    "base": math.fsum(base[w] for w in words if w in base),
                    "model": math.fsum(inner[w] for w in words if w in inner),
                    "rare": [{"word": w, "times": n, "ending": ending(w)} for w, n in rare.items()],
                })
            if texts:
                for row, value in zip(out, network.score(coded)):
                    row["model"] += float(value)
            return out

        return work

    rows = materialise(
        docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).select(
            "row", "doc_id", held.alias("held_out"), by_batch(start, _SCORED, _SCORED_DDL)("text").alias("s")
        )
    )
    within = F.get(F.array(*[F.lit(float(x)) for x in model.class_total]), F.col("ending"))
    n = F.coalesce(F.col("n"), F.lit(0))
    rest = (
        rows.select("row", F.inline("s.rare")).join(model.counts, "word", "left")
        .groupBy("row").agg(
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10((n + 0.5) / below)).alias("rare_base"),
            F.sum(F.col("times") * F.log10((n + 0.5) / within)).alias("rare_model"),
        )
    )
    part = lambda name: F.coalesce(F.col(name), F.lit(0))
    return rows.join(rest, "row", "left").select(
        "doc_id", "held_out", "s.n_tokens", (F.col("s.known") + part("rare_known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("s.base") + part("rare_base")).alias("base_score"),
        (F.col("s.model") + part("rare_model")).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    held = held_out("doc_id", 5, 1)
    return score(docs, ~held, held)
