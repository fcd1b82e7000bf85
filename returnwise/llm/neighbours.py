"""Approximate nearest neighbours by NN-descent and greedy graph search.

Distinct vectors are the nodes. Their first lists come from blocks of a few random-projection trees.
NN-descent then improves them in rounds of joins: a node's neighbours, forward and reverse, meet at
the node, and each learns of the others, since a neighbour of a neighbour is likely a neighbour. A
query starts at its own node and follows the graph greedily. A round brings it the vectors and the
lists of the nodes it asked for; it then opens the best nodes of its beam that are not open yet and
asks for those of their neighbours that it has never seen, until every node of its beam is open.

Graph and search compare unit vectors in single precision; the nearest nodes that the search found are
scored again in double precision from the original vectors. Copies of one vector are one node and come
back at the end.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from returnwise.llm.common import by_batch, ship
from returnwise.session import materialise

NEIGHBOURS = 5
#: Length of a node's list, and how many reverse neighbours meet at a node beside it.
DEGREE, REVERSE = 24, 16
LEAF = 512
#: NN-descent stops when fewer than this share of all list entries changed in a round.
SETTLED = 0.02
#: A graph that has not settled after so many rounds is an error.
MOST_ROUNDS = 100
#: Candidates that one meeting passes on to each of its members.
TOLD = 6
#: How many nodes of its beam a query opens in a round.
OPENED = 32
#: Nodes that are scored in double precision for each wanted neighbour.
RESCORED = 4
#: Nodes, or queries, that one task's group works on.
GROUP, QUERIES = 1500, 100
#: A vector with copies is dealt into so many parts where rows look up their node.
SALTS = 64

_EDGE = "node bigint, other bigint, cosine float, fresh boolean"


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of vectors that have a direction, all of the commonest length."""
    held = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    common = held.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return held.where(F.size("embedding") == (common.n if common else 0))


def _doublings(count: int) -> int:
    return max(1, math.ceil(math.log2(max(2, count))))


def trees(count: int) -> int:
    """How many projection trees start the graph of ``count`` nodes: one for every two doublings."""
    return max(4, -(-_doublings(count) // 2))


def beam(count: int) -> int:
    """How many nodes a query of a graph of ``count`` nodes keeps: 16 for every doubling."""
    return 16 * _doublings(count)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _to_unit():
    """A column function from a vector to its unit vector, in single precision."""
    return by_batch(
        lambda: lambda rows: _unit(np.array(rows, dtype=float)).tolist() if rows else [],
        pa.list_(pa.float32()), "array<float>",
    )


def _cosine():
    """A column function: the cosine of two vectors in double precision.

    Both are scaled by a power of two first, which changes no digit and keeps squares in range.
    """

    def scaled(rows) -> np.ndarray:
        x = np.array(rows, dtype=float)
        return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])

    def work(left, right):
        if not left:
            return []
        a, b = scaled(left), scaled(right)
        return ((a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))).tolist()

    return by_batch(lambda: work, pa.float64(), "double", arguments=2)


def _best(node, other, cosine, fresh, degree: int) -> pa.Table:
    """The ``degree`` nearest different neighbours of each node; an old entry wins over a fresh one."""
    order = np.lexsort((fresh, other, node))
    node, other, cosine, fresh = node[order], other[order], cosine[order], fresh[order]
    first = np.ones(len(node), dtype=bool)
    first[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
    first &= node != other
    node, other, cosine, fresh = node[first], other[first], cosine[first], fresh[first]
    order = np.lexsort((other, -cosine, node))
    node, other, cosine, fresh = node[order], other[order], cosine[order], fresh[order]
    if len(node):
        head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        rank = np.arange(len(node)) - np.repeat(head, np.diff(np.append(head, len(node))))
        keep = rank < degree
        node, other, cosine, fresh = node[keep], other[keep], cosine[keep], fresh[keep]
    return pa.table({"node": node, "other": other, "cosine": cosine.astype(np.float32), "fresh": fresh})


def _columns(group: pa.Table, *names: str) -> list[np.ndarray]:
    return [group.column(n).to_numpy() for n in names]


def _grouped(df: DataFrame, key: str, groups: int):
    return df.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(groups))).groupBy("__group")


def _leaves(nodes: DataFrame, count: int, degree: int) -> DataFrame:
    """First lists: the nearest within each node's leaf of each tree."""
    depth = max(0, math.ceil(math.log2(max(1, count / LEAF))))
    wanted = trees(count)

    def start():
        made: dict[int, np.ndarray] = {}

        def work(rows):
            if not rows:
                return []
            x = np.array(rows, dtype=np.float32)
            wide = x.shape[1]
            if wide not in made:
                made[wide] = np.random.default_rng(3).standard_normal((wide, wanted * max(depth, 1)))
            side = (x @ made[wide] > 0).reshape(len(x), wanted, -1)[:, :, :depth]
            return (side @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros((len(x), wanted), np.int64)).tolist()

        return work

    code = by_batch(start, pa.list_(pa.int64()), "array<bigint>")("unit")
    placed = materialise(
        nodes.withColumn("codes", code).select("node", "unit", F.posexplode("codes").alias("tree", "code"))
    )
    # A leaf with more nodes than twice the wanted number is dealt into several at random.
    sizes = placed.groupBy("tree", "code").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
    dealt = placed.join(sizes, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), "parts"))

    def nearest(group: pa.Table) -> pa.Table:
        ids = group.column("node").to_numpy()
        x = _rows(group.column("unit"))
        close = x @ x.T
        np.fill_diagonal(close, -2)
        k = min(degree, len(ids) - 1)
        if k < 1:
            return pa.table({"node": ids[:0], "other": ids[:0], "cosine": np.zeros(0, np.float32), "fresh": np.zeros(0, bool)})
        top = np.argpartition(-close, k - 1, axis=1)[:, :k]
        return pa.table({
            "node": np.repeat(ids, k), "other": ids[top].ravel(),
            "cosine": np.take_along_axis(close, top, axis=1).ravel(), "fresh": np.ones(k * len(ids), dtype=bool),
        })

    return dealt.groupBy("tree", "code", "part").applyInArrow(nearest, _EDGE)


def graph(nodes: DataFrame, count: int, degree: int = DEGREE) -> DataFrame:
    """The neighbour graph ``node, other, cosine`` of ``nodes(node, unit)``."""
    groups = max(1, -(-count // GROUP))

    def keep(group: pa.Table) -> pa.Table:
        return _best(*_columns(group, "node", "other", "cosine", "fresh"), degree)

    def select(edges: DataFrame) -> tuple[DataFrame, int]:
        """The best entries of each list, and how many of them are fresh: counted as they are written."""
        counted = Observation()
        lists = _grouped(edges, "node", groups).applyInArrow(lambda g: keep(g), _EDGE)
        lists = materialise(lists.observe(counted, F.count_if("fresh").alias("fresh")))
        return lists, counted.get["fresh"]

    def meet(group: pa.Table) -> pa.Table:
        """Members of each meeting hear of the nearest others; a pair of old members has met before."""
        at, ids, fresh, worst = _columns(group, "at", "member", "fresh", "worst")
        x = _rows(group.column("unit"))
        order = np.argsort(at, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) != 0)))
        out: list[tuple] = []
        for own in np.split(order, heads[1:]):
            if not fresh[own].any() or len(own) < 2:
                continue
            close = x[own] @ x[own].T
            allowed = fresh[own][:, None] | fresh[own][None, :]
            allowed &= ids[own][:, None] != ids[own][None, :]
            close = np.where(allowed & (close > worst[own][:, None]), close, -2)
            k = min(TOLD, len(own) - 1)
            top = np.argpartition(-close, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(close, top, axis=1)
            i, j = np.nonzero(value > -2)
            if len(i):
                out.append((ids[own][i], ids[own][top[i, j]], value[i, j]))
        node, other, cosine = (
            (np.concatenate(c) for c in zip(*out)) if out else (ids[:0], ids[:0], np.zeros(0, np.float32))
        )
        return _best(node, other, cosine, np.ones(len(node), dtype=bool), 1 << 30)

    edges, fresh = select(_leaves(nodes, count, degree))
    for turn in range(MOST_ROUNDS + 1):
        if fresh <= SETTLED * count * degree:
            break
        if turn == MOST_ROUNDS:
            raise RuntimeError(f"the neighbour graph has not settled in {MOST_ROUNDS} rounds: {fresh} new entries")
        back = edges.select(F.col("other").alias("at"), F.col("node").alias("member"), "fresh")
        chosen = back.withColumn(
            "rank", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("fresh"), F.xxhash64("at", "member")))
        ).where(F.col("rank") <= REVERSE).drop("rank")
        members = edges.select(F.col("node").alias("at"), F.col("other").alias("member"), "fresh").union(chosen)
        # How near a newcomer must be to enter a member's list.
        worst = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).select(
            F.col("node").alias("member"),
            F.when(F.col("n") < degree, F.lit(-1.5)).otherwise(F.col("least")).cast("float").alias("worst"),
        )
        known = worst.join(nodes.withColumnRenamed("node", "member"), "member")
        told = _grouped(members.join(known, "member").select("at", "member", "fresh", "worst", "unit"), "at", groups)
        news = told.applyInArrow(lambda g: meet(g.drop(["__group"]) if "__group" in g.column_names else g), _EDGE)
        old = edges.select("node", "other", "cosine", F.lit(False).alias("fresh"))
        edges, fresh = select(old.union(news))
    return edges.select("node", "other", "cosine")


_STATE = (
    "query bigint, unit array<float>, ids array<bigint>, cosines array<float>, shut array<bigint>, "
    "links array<array<bigint>>, seen array<bigint>, next array<bigint>"
)


def _advance(before: dict, met: tuple[np.ndarray, np.ndarray, list], width: int) -> dict:
    """One query's state after it met the nodes it asked for: ``(ids, unit vectors, lists)``.

    ``shut`` names the nodes of the beam that are not open, and ``links`` holds their lists.
    """
    ids, vectors, lists = met
    held = dict(zip(before["shut"], before["links"]))
    held.update(zip(ids.tolist(), lists))
    all_ids = np.concatenate((np.array(before["ids"], dtype=np.int64), ids))
    near = np.concatenate((np.array(before["cosines"], dtype=np.float32), vectors @ np.array(before["unit"], dtype=np.float32)))
    best = np.lexsort((all_ids, -near))[:width]
    beam_ids = all_ids[best].tolist()
    shut = [i for i in beam_ids if i in held]
    seen = set(before["seen"])
    asked: list[int] = []
    # Nodes whose neighbours were all seen bring nothing new: go on to the next ones.
    while shut and not asked:
        now, shut = shut[:OPENED], shut[OPENED:]
        fresh = sorted({other for node in now for other in held[node]} - seen)
        asked.extend(fresh)
    seen.update(asked)
    done = not asked
    return {
        "query": before["query"], "unit": before["unit"], "ids": beam_ids, "cosines": near[best].tolist(),
        "shut": shut, "links": [held[i] for i in shut], "seen": [] if done else sorted(seen), "next": asked,
    }


def search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """``query, ids, cosines``: the beam of each of ``queries(query)``, nearest first.

    A query is a node. Its beam holds the nearest nodes met so far, itself included. What it has seen
    is bounded by the lists of all nodes that were ever in its beam.
    """
    lists = edges.groupBy("node").agg(F.collect_list("other").alias("others"))
    places = materialise(nodes.join(lists, "node", "left").select(
        "node", "unit", F.coalesce("others", F.array().cast("array<bigint>")).alias("others")
    ))
    groups = max(1, -(-max(1, count // 50) // QUERIES))
    none = F.array().cast("array<bigint>")
    state = queries.join(nodes, queries["query"] == nodes["node"]).select(
        "query", "unit", none.alias("ids"), F.array().cast("array<float>").alias("cosines"), none.alias("shut"),
        F.array().cast("array<array<bigint>>").alias("links"), F.array("query").alias("seen"), F.array("query").alias("next"),
    )
    state, width = materialise(state), beam(count)
    kinds = pa.schema([
        ("query", pa.int64()), ("unit", pa.list_(pa.float32())), ("ids", pa.list_(pa.int64())),
        ("cosines", pa.list_(pa.float32())), ("shut", pa.list_(pa.int64())),
        ("links", pa.list_(pa.list_(pa.int64()))), ("seen", pa.list_(pa.int64())), ("next", pa.list_(pa.int64())),
    ])

    def step(before: pa.Table, met: pa.Table) -> pa.Table:
        owner = met.column("owner").to_numpy()
        order = np.argsort(owner, kind="stable")
        sorted_owner = owner[order]
        node, others = met.column("node").to_numpy(), met.column("others").combine_chunks()
        vectors = _rows(met.column("unit")) if met.num_rows else None
        made = []
        for i in range(before.num_rows):
            row = before.slice(i, 1).to_pylist()[0]
            a, b = np.searchsorted(sorted_owner, [row["query"], row["query"] + 1])
            own = order[a:b]
            found = vectors[own] if a < b else np.zeros((0, len(row["unit"])), np.float32)
            made.append(_advance(row, (node[own], found, others.take(pa.array(own)).to_pylist()), width))
        return pa.Table.from_pylist(made, schema=kinds)

    finished, waiting = [], True
    while waiting:
        frontier = state.select(F.col("query").alias("owner"), F.explode("next").alias("node"))
        met = frontier.join(places, "node").select("owner", "node", "unit", "others")
        left = Observation()
        after = _grouped(state, "query", groups).cogroup(_grouped(met, "owner", groups)).applyInArrow(
            lambda a, b: step(a, b), _STATE
        )
        written = materialise(after.observe(left, F.count_if(F.size("next") > 0).alias("waiting")))
        waiting = left.get["waiting"] > 0
        # Queries that have nothing to ask leave the rounds.
        finished.append(written.where(F.size("next") == 0).select("query", "ids", "cosines"))
        state = written.where(F.size("next") > 0)
    result = finished[0]
    for part in finished[1:]:
        result = result.union(part)
    return result


def _placed(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, node``: the smallest id of its copies is the node of a vector.

    Only vectors with copies are looked up, and each in many parts: one vector may be a third of all.
    """
    held = materialise(_usable(vectors).dropDuplicates(["vec_id"]))
    copied = held.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).where("n > 1")
    copied = copied.select("embedding", "node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    return materialise(
        salted.join(copied, ["embedding", "salt"], "left")
        .select("vec_id", "embedding", F.coalesce("node", "vec_id").alias("node"))
    )


def nearest(vectors: DataFrame, stride: int = 50, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``vectors(vec_id, embedding)``.

    Queries are the vectors whose id is divisible by ``stride``; each gets its ``k`` nearest found
    other rows, or all if there are fewer, nearest first, ties to the smaller id. The score is the
    cosine in double precision. Vectors that are NULL, zero, or hold a NULL or non-finite component
    take no part, nor do rows without an id or vectors of another than the commonest length. Copies
    of a vector are rows of their own; rows that repeat an id are one. Other columns are ignored.
    """
    ship(vectors.sparkSession)
    placed = _placed(vectors)
    counted = Observation()
    originals = placed.where("vec_id = node").select("node", "embedding")
    nodes = materialise(
        originals.select("node", _to_unit()("embedding").alias("unit")).observe(counted, F.count("*").alias("n"))
    )
    count = counted.get["n"]
    # The first k + 1 copies of each node are all that any result can hold; parts are cut down first.
    part = Window.partitionBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    whole = Window.partitionBy("node").orderBy("vec_id")
    copies = placed.select("node", "vec_id").withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1)
    copies = materialise(copies.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1).drop("n"))
    asked = placed.where(F.col("vec_id") % stride == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    asked = materialise(asked)
    beams = search(nodes, graph(nodes, count), asked.select("query").distinct(), count)
    near = beams.select("query", F.explode(F.slice("ids", 1, RESCORED * (k + 1))).alias("node"))
    near = near.join(originals.withColumnRenamed("embedding", "other"), "node")
    near = near.join(originals.select(F.col("node").alias("query"), "embedding"), "query")
    scored = materialise(near.select("query", "node", _cosine()("embedding", "other").alias("score")))
    close = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    scored = scored.withColumn("n", F.row_number().over(close)).where(F.col("n") <= k + 1).drop("n")
    rows = asked.join(scored, "query").join(copies, "node").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
