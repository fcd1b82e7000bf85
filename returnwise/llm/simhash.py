"""SimHash near-duplicates: fingerprints of word shingles, multi-index hashing, components.

Fingerprints are 64 bits in two segments of 32. Two fingerprints differ in at most two bits exactly
when a Hamming ball of radius one around each has a value in common, and that value keeps one of
the segments of either side as it is. So every fingerprint enumerates the small ball inside each
segment (32 flips) with the other segment untouched, and the index table is keyed by the outcome.
Whatever a probe fetches is a true neighbour of the probe, at most 65 fingerprints can ever share
one, and a family of near copies costs rows in proportion to its size, never all pairs.

That is the narrow form, :func:`components`. Near copies in the wider sense (five-word shingles,
a similarity of 0.8 or more) differ in ten of 64 bits, which no small ball around half a fingerprint
spans. :func:`deduplicate` therefore takes 1024 bits of the distinct shingles, in three
orders of 32 segments each, and enumerates in each segment balls that leave eight of its 32 bits
open: a pair is fetched when all its differing bits in one segment lie in one ball's open bits. In
simulation that finds 94 % of single pairs at 0.8 exactly and 99 % at 0.85. The complete distance
decides, or the shingles where it leaves doubt.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnwise.llm.common import by_batch, free_name, ship, short_batches
from returnwise.llm.graph import connected_components
from returnwise.session import materialise

SHINGLE_WORDS = 3
SEED = 42
SEGMENT_BITS = 32
MOST_BITS_APART = 2
#: Near copies in the wider sense: words of a shingle, least similarity, bits of a print.
NEAR_WORDS = 5
NEAR_LEAST = 0.8
WIDE_BITS = 1024
#: Orders of a wide print's bits, balls in each 32-bit segment of each, and the bits that a ball
#: leaves open. Every bit kept halves what unrelated texts share by chance.
ORDERS = 3
BALLS = 2
OPEN_BITS = 8
#: Similarities by complete distance between which the shingles are compared, and the shingles a
#: set must have for the upper one to decide.
DOUBT = (0.65, 0.9)
SURE_SIZE = 64
#: Of so many balls, one is used to join families of close copies before all balls are compared.
FIRST_EVERY = 4
#: Members of a ball whose pairs are all listed, so that each is compared once however many balls it shares.
FEW_MEMBERS = 8
#: Partners that a node gives in one round, while rounds take the most alike.
PARTNERS = 4
#: Members of a ball that are compared with each other at a time, about.
SLOT_MEMBERS = 256
#: Rows whose sketches, ball keys or shingle sets a task holds as Python objects at a time.
ROWS = 256
#: Bytes of a text that are shingled at a time; longer texts go block by block.
BLOCK = 1 << 20

#: One odd multiple of the golden ratio's bits for each 64-bit word of a wide print.
_MIX = np.arange(1, 2 * (WIDE_BITS // 64), 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _kept_masks() -> np.ndarray:
    """For every segment and ball, ones at the bits that the ball keeps."""
    rng = np.random.default_rng(SEED)
    masks = np.zeros((ORDERS * WIDE_BITS // SEGMENT_BITS, BALLS), dtype=np.int64)
    for at in np.ndindex(*masks.shape):
        for bit in rng.permutation(SEGMENT_BITS)[OPEN_BITS:]:
            masks[at] |= 1 << int(bit)
    return masks


_ORDER = np.concatenate([np.random.default_rng(i).permutation(WIDE_BITS) for i in range(ORDERS)])
_KEPT = _kept_masks()
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(data: bytes):
    """Lists of words, a block of bytes at a time, cut at blanks only."""
    start = 0
    while len(data) - start > BLOCK:
        cut = _BLANK.search(data, start + BLOCK)
        if cut is None:
            break
        yield data[start : cut.start()].split()
        start = cut.end()
    yield data[start:].split()


def fingerprint(text: str | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number; see :func:`with_fingerprints`."""
    ones, total, carried = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def count(hashes) -> None:
        nonlocal total
        values = np.array(hashes, dtype="<u8")
        total += len(values)
        for at in range(0, len(values), 1 << 15):
            bits = np.unpackbits(
                values[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
            )
            ones[:] += bits.sum(axis=0, dtype=np.int64)

    for words in _blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carried + words
        if len(words) >= size:
            count([digest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(size)))])
        carried = words[-(size - 1) :] if size > 1 else []
    if not total and carried:
        count([digest(b" ".join(carried), seed)])
    value = int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0
    return value - (1 << 64) if value >> 63 else value


def fingerprint_column(text: Column | str, size: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    def start():
        return lambda texts: [fingerprint(t, size, seed) for t in texts]

    return by_batch(start, pa.int64(), "long")(text)


def links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``(fingerprint)`` that keep every component.

    A probe that fetches two fingerprints links them; one that fetches more links each to the
    smallest. All members of one fetch are neighbours of one value, so they are within two bits of
    each other, which the complete distance confirms.
    """
    low = [1 << i for i in range(SEGMENT_BITS)]
    high = [1 << i for i in range(SEGMENT_BITS, 64)]
    masks = F.array(F.lit(0).cast("long"), *[_long(m) for m in (*low, *high)])
    probes = prints.select(
        F.col("fingerprint").alias("member"), F.explode(masks).alias("mask")
    ).select("member", F.col("member").bitwiseXOR(F.col("mask")).alias("probe"))
    fetched = materialise(
        probes.groupBy("probe")
        .agg(F.min("member").alias("a"), F.max("member").alias("b"), F.count("*").alias("members"))
        .where("members > 1")
    )
    crowded = (
        fetched.where("members > 2")
        .select("a", F.explode(F.transform(masks, lambda m: F.col("probe").bitwiseXOR(m))).alias("b"))
        .join(prints.select(F.col("fingerprint").alias("b")), "b")
        .select("a", "b")
    )
    return (
        fetched.select("a", "b").union(crowded).where("a <> b").distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS_APART)
    )


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Words are runs without ASCII blanks, A-Z lower-cased; shingles are three words joined by a
    space, repeats included; a shorter text is one shingle, a text without words (NULL too) has
    fingerprint zero and is linked like any other. A bit is one if set in over half the hashes.
    Rows link at two or fewer differing bits, and a component's id is its smallest doc_id. Rows
    without an id take part and get their component's id, NULL if it has none. Repeated rows are
    each returned. Other columns are ignored.
    """
    ship(docs.sparkSession)
    marked = materialise(
        docs.select(F.col("doc_id"), fingerprint_column("text").alias("fingerprint"))
    )
    groups = materialise(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    found = connected_components(links(groups.select("fingerprint")))
    linked = groups.join(found, groups.fingerprint == found.node, "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    names = materialise(linked)
    smallest = names.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = names.join(smallest, "component").select("fingerprint", "component_id")
    return marked.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of five words.

    Words are those of :func:`fingerprint`; a shorter text is one shingle, a text without words has
    none.
    """
    hashes, carried, size = [], [], NEAR_WORDS
    digest = xxhash.xxh64_intdigest
    for words in _blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carried + words
        if len(words) >= size:
            made = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(size)))]
            hashes.append(np.unique(np.array(made, dtype="<u8")))
        carried = words[-(size - 1) :]
    if not hashes and carried:
        hashes.append(np.array([digest(b" ".join(carried), SEED)], dtype="<u8"))
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, dtype="<u8")


def sketch(text: str | None) -> tuple[bytes, bytes, int]:
    """``(class, print, size)`` of a text's shingle set.

    Equal classes mean equal sets. The print is a SimHash of ``WIDE_BITS`` bits.
    """
    distinct = shingle_set(text)
    ones = np.zeros(WIDE_BITS, dtype=np.int64)
    for at in range(0, len(distinct), 255):  # sums of 255 bits fit a byte
        mixed = distinct[at : at + 255, None] ^ _MIX
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (
        xxhash.xxh3_128_digest(distinct.tobytes()),
        np.packbits(2 * ones > len(distinct)).tobytes(),
        len(distinct),
    )


_SKETCH = pa.struct([("class", pa.binary()), ("print", pa.binary()), ("size", pa.int64())])


def _sketches(texts: list[str | None]) -> list[dict[str, bytes]]:
    return [dict(zip(("class", "print", "size"), sketch(t))) for t in texts]


def _bits(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), WIDE_BITS // 8)


def _ball_keys(prints: list[bytes]) -> list[np.ndarray]:
    """For every print one number for each ball: the ball's place and the bits it keeps."""
    if not prints:
        return []
    ordered = np.ascontiguousarray(np.packbits(np.unpackbits(_bits(prints), axis=1)[:, _ORDER], axis=1))
    segments = ordered.view("<u4").astype(np.int64)
    keys = (segments[:, :, None] & _KEPT[None]).reshape(len(prints), -1)
    return list(keys | (np.arange(keys.shape[1], dtype=np.int64) << SEGMENT_BITS))


def similarity(bits_apart: np.ndarray) -> np.ndarray:
    """The Jaccard similarity at which sets differ in so many of the wide print's bits."""
    cosine = np.cos(np.pi * np.asarray(bits_apart) / WIDE_BITS)
    return cosine / (2 - cosine)


def _words(prints: list[bytes]) -> list[np.ndarray]:
    return list(_bits(prints).view("<i8")) if prints else []


def _likeness(a: Column, b: Column) -> Column:
    """:func:`similarity` of two columns of prints as arrays of 64-bit words."""
    apart = sum(
        (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WIDE_BITS // 64)), F.lit(0)
    )
    cosine = F.cos(apart * (np.pi / WIDE_BITS))
    return cosine / (2 - cosine)


def _jaccard(a: str, b: str) -> Column:
    """The Jaccard similarity of two columns of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    return common / F.greatest(F.lit(1), F.size(a) + F.size(b) - common)


def near_balls(nodes: DataFrame) -> DataFrame:
    """``(key, node, members, before)`` of every ball that holds two or more of ``nodes(node, print)``.

    The members of one ball stand in an order of their own; ``before`` is the one before, if any.
    """
    keys = by_batch(lambda: _ball_keys, pa.list_(pa.int64()), "array<long>", rows=ROWS)
    held = nodes.select("node", F.explode(keys("print")).alias("key"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("node", "key"))
    return held.select(
        "key",
        "node",
        F.count("*").over(Window.partitionBy("key")).alias("members"),
        F.lag("node").over(order).alias("before"),
    ).where("members > 1")


def _pairs_met(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b, alike, larger)`` of those ``pairs(a, b)`` whose prints are near.

    ``nodes(node, words, size)`` hold the prints as words.
    """
    sides = [
        nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("words", "size")])
        for x in "ab"
    ]
    larger = (F.col("a_size") >= SURE_SIZE) & (F.col("b_size") >= SURE_SIZE)
    return (
        pairs.join(sides[0], "a").join(sides[1], "b")
        .select("a", "b", _likeness(F.col("a_words"), F.col("b_words")).alias("alike"), larger.alias("larger"))
        .where(F.col("alike") >= DOUBT[0])
    )


def _first_pairs(balls: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b, alike, larger)`` of each member and the one before it, if their prints are near.

    Every ``FIRST_EVERY``-th ball is enough to join a family of close copies, at rows in proportion
    to its members; what stays apart is left to the whole comparison.
    """
    first = F.pmod(F.shiftright("key", SEGMENT_BITS), F.lit(FIRST_EVERY)) == 0
    pairs = (
        balls.where(first & F.col("before").isNotNull())
        .select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b"))
        .distinct()
    )
    return _pairs_met(pairs, nodes)


def _few_pairs(balls: DataFrame, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b, alike, larger)`` of pairs in balls of few members, in different components so far.

    Each pair is there once, if its prints are near. Unrelated texts that share a ball by chance are
    nearly always two or three, so they are seen here and not again, and their rows carry no more than
    two numbers until the prints are fetched.
    """
    together = (
        balls.where(F.col("members") <= FEW_MEMBERS).join(names, "node", "left")
        .groupBy("key")
        .agg(F.collect_list(F.struct("node", F.coalesce("component", "node").alias("label"))).alias("all"))
    )

    def later(x: Column, at: Column) -> Column:
        others = F.filter(F.slice("all", at + 2, FEW_MEMBERS), lambda y: y.label != x.label)
        return F.transform(
            others, lambda y: F.struct(F.least(x.node, y.node).alias("a"), F.greatest(x.node, y.node).alias("b"))
        )

    pairs = together.select(F.inline(F.flatten(F.transform("all", later)))).distinct()
    return _pairs_met(pairs, nodes)


def _still_open(met: DataFrame, names: DataFrame) -> DataFrame:
    """Those of ``met(a, b, alike, larger)`` that lie in different components by now."""
    a = names.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    b = names.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    return (
        met.join(a, "a", "left").join(b, "b", "left")
        .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "alike", "larger")
    )


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of ``pairs(a, b, alike, larger)`` those with one of the ``PARTNERS`` most alike partners of a node."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("alike", "a", "b", "larger").alias("pair"))
    chosen = F.slice(F.sort_array(F.collect_set("pair"), asc=False), 1, PARTNERS)
    return both.groupBy("node").agg(chosen.alias("pairs")).select(F.inline("pairs"))


def _met_in_block(rows: pa.Table, best: bool) -> tuple[np.ndarray, ...]:
    """Places of the pairs to compare in one block, and how alike their prints are."""
    slots, labels = rows["slot"].to_numpy(), rows["label"].to_numpy()
    words = _bits(rows["print"].to_pylist()).view("<u8")
    apart = np.zeros((len(words), len(words)), dtype=np.int64)
    for at in range(words.shape[1]):
        apart += np.bitwise_count(words[:, None, at] ^ words[None, :, at])
    open_pairs = labels[:, None] != labels[None, :]
    if rows["low"][0].as_py() != rows["high"][0].as_py():
        open_pairs &= slots[:, None] != slots[None, :]
    alike = np.where(open_pairs, similarity(apart), -1.0)
    if best:
        i, j = np.arange(len(words)), alike.argmax(axis=1)
        near = alike[i, j] >= DOUBT[0]
        i, j = i[near], j[near]
    else:
        i, j = np.nonzero(np.triu(alike >= DOUBT[0], 1))
    return i, j, alike[i, j]


def _compare_blocks(best: bool):
    def made(rows: pa.Table) -> pa.RecordBatch:
        i, j, alike = _met_in_block(rows, best)
        nodes, sizes = rows["node"].to_numpy(), rows["size"].to_numpy()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.minimum(nodes[i], nodes[j])),
                pa.array(np.maximum(nodes[i], nodes[j])),
                pa.array(alike),
                pa.array(np.minimum(sizes[i], sizes[j]) >= SURE_SIZE),
            ],
            names=["a", "b", "alike", "larger"],
        )

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            place = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("key", "low", "high")])
            starts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *starts[:-1]], starts):
                yield made(rows.slice(a, b - a))
            held = rows.slice(starts[-1] if len(starts) else 0)
        if held is not None:
            yield made(held)

    return run


def _rest_pairs(balls: DataFrame, names: DataFrame, nodes: DataFrame, best: bool) -> DataFrame:
    """``(a, b, alike, larger)`` of members of one ball that lie in different components so far.

    A ball's largest component need not be compared within itself. Its members and the others are
    dealt out over slots of about ``SLOT_MEMBERS``; the others' slots meet every slot, so a ball of
    any size is compared wholly, a pair of slots at a time. With ``best``, each member of such a
    pair of slots gives its most alike partner alone, otherwise all that are near enough.
    """
    labelled = balls.join(names, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("label")
    )
    sizes = (
        labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"))
        .where("all > main.n")
        .select(
            "key",
            F.col("main.label").alias("main"),
            F.ceil(F.col("main.n") / SLOT_MEMBERS).cast("int").alias("mains"),
            F.ceil((F.col("all") - F.col("main.n")) / SLOT_MEMBERS).cast("int").alias("others"),
        )
    )
    inside, mixed = F.col("label") == F.col("main"), F.xxhash64("node", "key")
    slot = F.when(inside, F.pmod(mixed, "mains")).otherwise(F.col("mains") + F.pmod(mixed, "others"))
    meets = F.sequence(F.when(inside, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    dealt = (
        labelled.join(sizes, "key")
        .withColumn("slot", slot.cast("int"))
        .select("key", "node", "label", "slot", F.explode(meets).alias("meets"))
        .select(
            "key", "node", "label", "slot",
            F.least("slot", "meets").alias("low"), F.greatest("slot", "meets").alias("high"),
        )
        .join(nodes.select("node", "print", "size"), "node")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
    )
    made = dealt.mapInArrow(_compare_blocks(best), "a long, b long, alike double, larger boolean")
    return made.groupBy("a", "b").agg(F.first("alike").alias("alike"), F.first("larger").alias("larger"))


def _confirmed(pairs: DataFrame, names: DataFrame | None, texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` among ``pairs`` that join components of ``names``.

    Where the complete distance of two larger sets leaves no doubt, a pair links as it is. The
    others are compared shingle by shingle, but for those in one component already, so a large
    family costs no sets for its inner pairs.
    """
    is_sure = F.col("larger") & (F.col("alike") >= DOUBT[1])
    sure = pairs.where(is_sure).select("a", "b")
    if names is None:
        names = connected_components(sure)
    a = names.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    b = names.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    open_pairs = materialise(
        pairs.where(~is_sure).join(a, "a", "left").join(b, "b", "left")
        .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    )
    asked = open_pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    hashes = by_batch(
        lambda: lambda texts: [shingle_set(t).view(np.int64) for t in texts],
        pa.list_(pa.int64()), "array<long>", rows=ROWS,
    )
    sets = materialise(
        texts.join(asked, "node", "left_semi").select("node", hashes("text").alias("shingles"))
    )
    exact = (
        open_pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set")), "b")
        .where(_jaccard("a_set", "b_set") >= NEAR_LEAST)
        .select("a", "b")
    )
    return materialise(sure.union(exact))


def near_components(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, component)`` of the linked ones of ``nodes(node, print, size)``.

    ``texts(node, text)`` are theirs. First members of some balls are compared with one other,
    which joins families of close copies. Then all pairs in balls of few members are compared, once.
    Larger balls that still hold several components are compared wholly: each member's most alike
    partner first, for as long as that adds links, and what these leave apart after that; no pair is
    compared shingle by shingle twice. So every two texts that share a ball are compared unless links
    join them already.
    """
    balls = materialise(near_balls(nodes))
    words = by_batch(lambda: _words, pa.list_(pa.int64()), "array<long>", rows=ROWS)
    held = materialise(nodes.select("node", words("print").alias("words"), "size"))
    pairs = materialise(_first_pairs(balls, held))
    links, asked = _confirmed(pairs, None, texts), pairs.select("a", "b")
    names = connected_components(links)
    met = materialise(_few_pairs(balls, names, held).join(asked, ["a", "b"], "left_anti"))
    crowded = balls.where(F.col("members") > FEW_MEMBERS)
    best = True
    while True:
        found = _still_open(met, names).unionByName(_rest_pairs(crowded, names, nodes, best))
        found = found.join(asked, ["a", "b"], "left_anti")
        pairs = materialise((_nearest(found) if best else found).dropDuplicates(["a", "b"]))
        added, asked = _confirmed(pairs, names, texts), asked.union(pairs.select("a", "b"))
        if not added.isEmpty():
            links = links.union(added)
            names = connected_components(links)
        elif best:
            best = False
            continue
        if not best:
            return names


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest doc_id.

    Near copies are texts whose sets of five-word shingles are alike by ``NEAR_LEAST`` or more; a
    group is a component of such links. The complete distance of 1024-bit prints is within about
    0.026 (one standard deviation) of the similarity; where that leaves doubt the shingles decide.
    Texts without words (NULL too) are copies of each other, texts under five words only of equal
    ones. All columns are kept. Of repeated rows with one doc_id in a group, one row stays; a group in which
    no row has an id keeps one row.
    """
    ship(docs.sparkSession)
    short_batches(docs.sparkSession)
    key, mark = free_name(docs, "__row"), free_name(docs, "__sketch")
    sketches = by_batch(lambda: _sketches, _SKETCH, "class binary, print binary, size long", rows=ROWS)
    rows = materialise(
        docs.withColumn(key, F.monotonically_increasing_id()).withColumn(mark, sketches("text"))
    )
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col(key).alias("row"))
    groups = materialise(
        rows.groupBy(F.col(f"{mark}.class").alias("class"))
        .agg(
            F.min(order).alias("best"),
            F.first(f"{mark}.print").alias("print"),
            F.first(f"{mark}.size").alias("size"),
        )
        .select("best", F.col("best.row").alias("node"), "print", "size")
    )
    texts = rows.select(F.col(key).alias("node"), "text")
    found = near_components(groups.select("node", "print", "size"), texts)
    kept = (
        groups.select("best", "node")
        .join(found, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.row").alias(key))
    )
    return rows.join(kept, key, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
