"""Phrase collocations from a weighted de Bruijn graph.

The longest grams (four words) are counted once, as weighted edges between nodes of three words
that overlap. Where a piece ends before a gram is full, the shorter rest is counted as a
correction. Every occurrence of a word starts exactly one edge or correction, so the count of any
shorter phrase is a flow: what leaves its nodes plus what ends there. Chains of nodes with one way
in and one way out are compacted to paths, which hold their words once.

Only phrases found often enough matter, and every pair of words inside one is found as often. So
pairs are counted first, by 64-bit hashes, and a gram stops before a pair that is surely rare, as
if the piece ended there: no count of a frequent phrase changes, and few grams are left to shuffle.
Frequent hashes set bits of a table of fixed size; two that share a bit only keep some grams longer.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnwise.llm.common import ship
from returnwise.session import materialise

LONGEST = 4
LEAST = 30
FIRST = 2000
#: Percent of a phrase's count that a longer one needs to take its place.
COVERED = 80
#: Bits of the table of frequent pairs (8 MB), kept as longs.
TABLE_BITS = 1 << 26
#: Edges of a path that are kept in one row.
PATH_ROW = 4096
#: Entries that a task counts before it hands them on.
COUNTED = 200_000
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 20
#: Copies of the counts among which lookups of one key are spread, and parts of a language's ranking.
SALTS = 8

_TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
_ENDS = frozenset(b".,;:!?\n\x0b\x0c\r")
_DECIMAL = "decimal(20,0)"


class _Words:
    """Numbers for words, and their hashes; the separator is word 0."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]
        self.hashes = np.zeros(1 << 12, dtype=np.uint64)

    def number(self, tokens: list[bytes]) -> np.ndarray:
        """Ids of a text's tokens. A token of one byte that ends a piece is 0."""
        ids, words = self.ids, self.words
        for token in set(tokens).difference(ids):
            if len(token) == 1 and token[0] in _ENDS:
                ids[token] = 0
                continue
            at = ids[token] = len(words)
            words.append(token)
            if at >= len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[at] = xxhash.xxh64_intdigest(token)
        return np.fromiter(map(ids.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def _tokens(text: bytes | None) -> list[bytes]:
    return _TOKEN.findall(text.lower()) if text else []


def _pairs(words: _Words, ids: np.ndarray, lang: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of neighbouring tokens, and whether both belong to one piece."""
    h = words.hashes[ids]
    left, right = h[:-1], h[1:]
    mixed = (left ^ np.uint64(xxhash.xxh64_intdigest(lang, 7))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) + right
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32)), (ids[:-1] > 0) & (ids[1:] > 0)


def _texts(batch: pa.RecordBatch):
    """``(lang, text)`` of each row as bytes, one at a time."""
    langs, texts = (batch.column(i).cast(pa.large_binary()) for i in range(2))
    for lang, text in zip(langs, texts):
        yield lang.as_py(), text.as_py()


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )


def _pair_counts(batches):
    words, waiting, held = _Words(), [], 0

    def handed():
        hashes, counts = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], ["pair", "n"]
        )

    for batch in batches:
        for lang, text in _texts(batch):
            ids = words.number(_tokens(text))
            hashes, within = _pairs(words, ids, lang)
            waiting.append(hashes[within])
            held += len(waiting[-1])
            if held >= 10 * COUNTED:
                yield handed()
                waiting, held = [], 0
            if len(words.words) > REMEMBERED:
                words.clear()
    if held:
        yield handed()


def frequent_pairs(docs: DataFrame, least: int = LEAST) -> np.ndarray:
    """The table of frequent pairs, packed bits. Its size is fixed: at most a million longs are read."""
    counts = docs.mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = (
        counts.where(F.col("n") >= least)
        .withColumn("bit", F.pmod("pair", F.lit(TABLE_BITS)))
        .groupBy(F.shiftright("bit", 6).alias("slot"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
        .toArrow()
    )
    table = np.zeros(TABLE_BITS // 64, dtype=np.int64)
    table[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return table.view(np.uint8)


def _gram_counts(frequent):
    """Counts edges and corrections of each task's texts, from the broadcast table of pairs."""

    def run(batches):
        table, words, counted = frequent.value, _Words(), {}
        singles: dict[bytes, Counter] = {}

        def handed():
            rows = [(lang, gram, n) for lang, grams in counted.items() for gram, n in grams.items()]
            rows += [(lang, word, n) for lang, each in singles.items() for word, n in each.items()]
            counted.clear()
            singles.clear()
            lang, gram, n = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.binary()), pa.array(gram, pa.binary()), pa.array(n, pa.int64())],
                ["lang", "gram", "n"],
            )

        held = 0
        for batch in batches:
            for lang, text in _texts(batch):
                tokens = _tokens(text)
                if not tokens:
                    continue
                ids = words.number(tokens)
                hashes, within = _pairs(words, ids, lang)
                at = (hashes % np.uint64(TABLE_BITS)).astype(np.int64)
                follows = within & ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                # Words from each place on until a rare pair or the end of a piece.
                reach, run_on = np.ones(len(ids), dtype=np.int64), np.ones(len(ids), dtype=bool)
                for step in range(1, LONGEST):
                    ahead = np.zeros(len(ids), dtype=bool)
                    if len(ids) > step:
                        ahead[: len(ids) - step] = follows[step - 1 :]
                    run_on &= ahead
                    reach += run_on
                alone, some = np.unique(ids[(reach == 1) & (ids > 0)], return_counts=True)
                each = singles.setdefault(lang, Counter())
                for i, n in zip(alone.tolist(), some.tolist()):
                    each[words.words[i]] += n
                long = np.flatnonzero(reach > 1)
                grams = counted.setdefault(lang, Counter())
                for i, size in zip(long.tolist(), reach[long].tolist()):
                    grams[b" ".join(tokens[i : i + size])] += 1
                held += len(alone) + len(long)
                if held >= COUNTED:
                    held = 0
                    if sum(map(len, counted.values())) + sum(map(len, singles.values())) >= COUNTED:
                        yield handed()
                if len(words.words) > REMEMBERED:
                    words.clear()
        if counted or singles:
            yield handed()

    return run


def grams(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, gram, size, n)``: edges (``size`` four) and corrections, with their exact counts."""
    spark = docs.sparkSession
    ship(spark)
    source = _source(docs)
    frequent = spark.sparkContext.broadcast(frequent_pairs(source, least))
    counted = source.mapInArrow(_gram_counts(frequent), "lang binary, gram binary, n long")
    summed = materialise(
        counted.groupBy(F.col("lang").cast("string").alias("lang"), F.col("gram").cast("string").alias("gram"))
        .agg(F.sum("n").alias("n"))
        .withColumn("size", F.size(F.split("gram", " ")))
    )
    frequent.unpersist()
    return summed


def _head(gram: Column | str, words: int) -> Column:
    return F.substring_index(gram, " ", words)


def _tail(gram: Column | str, words: int) -> Column:
    return F.substring_index(gram, " ", -words)


def paths(edges: DataFrame) -> DataFrame:
    """Unary paths of ``edges(lang, gram, n)``: ``(lang, path, part, grams, weights)``.

    A node with one edge in and one edge out continues the path of the edge before it. The edges of
    a path find its first edge by pointer doubling, so rounds grow with the logarithm of the
    longest path; every round is written. A path that is a ring starts at its smallest edge. Rows
    hold at most ``PATH_ROW`` edges; longer paths have several parts.
    """
    named = materialise(
        edges.select(
            F.monotonically_increasing_id().alias("edge"), "lang", "gram", "n",
            _head("gram", LONGEST - 1).alias("start"), _tail("gram", LONGEST - 1).alias("end"),
        )
    )
    into = named.groupBy("lang", F.col("end").alias("node")).agg(
        F.count(F.lit(1)).alias("ins"), F.min("edge").alias("before")
    )
    out = named.groupBy("lang", F.col("start").alias("node")).agg(
        F.count(F.lit(1)).alias("outs"), F.min("edge").alias("edge")
    )
    unary = into.join(out, ["lang", "node"]).where("ins = 1 and outs = 1").select("edge", "before")
    linked = (
        named.select("edge").join(unary, "edge", "left")
        .select("edge", F.coalesce("before", "edge").alias("to"))
    )

    def led(links: DataFrame, edges_in_all: int) -> DataFrame:
        """``(edge, to, far, low)``: the first edge, how far back it is, the smallest edge before."""
        state = materialise(links.select(
            "edge", "to", (F.col("to") != F.col("edge")).cast("long").alias("far"),
            F.least("edge", "to").alias("low"),
        ))
        for _ in range(max(edges_in_all, 1).bit_length() + 1):
            ahead = state.select(
                F.col("edge").alias("to"), F.col("to").alias("next"),
                F.col("far").alias("more"), F.col("low").alias("lower"),
            )
            stepped = materialise(state.join(ahead, "to").select(
                "edge", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"),
                F.least("low", "lower").alias("low"), (F.col("next") != F.col("to")).alias("moved"),
            ))
            state = stepped.drop("moved")
            if stepped.where("moved").isEmpty():
                break
        return state

    total = named.count()
    links = materialise(linked)
    first = led(links, total)
    heads = links.where("edge = to").select(F.col("edge").alias("to"))
    rings = materialise(first.join(heads, "to", "left_anti"))
    if not rings.isEmpty():
        # Cut every ring before its smallest edge, and measure again.
        cut = rings.where("edge = low").select("edge", F.lit(True).alias("cut"))
        links = materialise(links.join(cut, "edge", "left").select(
            "edge", F.when(F.col("cut"), F.col("edge")).otherwise(F.col("to")).alias("to")
        ))
        first = led(links, total)
    run = F.array_sort(F.collect_list(F.struct("far", "gram", "n")))
    return (
        named.join(first, "edge")
        .groupBy("lang", F.col("to").alias("path"), F.expr(f"far div {PATH_ROW}").alias("part"))
        .agg(run.alias("run"))
        .select("lang", "path", "part", F.col("run.gram").alias("grams"), F.col("run.n").alias("weights"))
    )


def counts(counted: DataFrame, compacted: DataFrame, least: int) -> dict[int, DataFrame]:
    """Exact counts ``(lang, phrase, f)`` by number of words, from paths, light edges and corrections.

    The flow of a node of three words is what its edges carry and what ends there; two words and
    one follow from three in the same way. Sums are combined before every shuffle. Counts of two
    words and more are exact where every pair inside is frequent; single words always are.
    """
    heavy = compacted.select(
        "lang", F.explode(F.arrays_zip("grams", "weights")).alias("e")
    ).select("lang", F.col("e.grams").alias("phrase"), F.col("e.weights").alias("f"))
    light = counted.where((F.col("size") == LONGEST) & (F.col("n") < least)).select(
        "lang", F.col("gram").alias("phrase"), F.col("n").alias("f")
    )
    found = {LONGEST: heavy}
    flow = heavy.unionByName(light)
    for size in range(LONGEST - 1, 0, -1):
        ends = counted.where(F.col("size") == size).select(
            "lang", F.col("gram").alias("phrase"), F.col("n").alias("f")
        )
        flow = materialise(
            flow.select("lang", _head("phrase", size).alias("phrase"), "f").unionByName(ends)
            .groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        )
        found[size] = flow
    return found


def _lookup(rows: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    """Join ``table(lang, phrase, f)`` on ``key``. A key that many rows share is spread over salts."""
    copies = table.select(
        "lang", F.col("phrase").alias(key), F.col("f").alias(name),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["lang", key, "salt"]).drop("salt")


def candidates(found: dict[int, DataFrame], least: int = LEAST) -> DataFrame:
    """Phrases of two words and more with their lowest-scoring cut: ``(lang, phrase, a, l, r, score)``.

    A phrase is left out where a longer one, by one word on either side, has most of its count; a
    phrase longer by two words has no more than one of those.
    """
    frequent = {size: df.where(F.col("f") >= least) for size, df in found.items()}
    every = frequent[1]
    for size in range(2, LONGEST):
        every = every.unionByName(frequent[size])
    every = materialise(every)
    kept, cuts = None, None
    for size in range(2, LONGEST + 1):
        phrases = frequent[size].select("lang", "phrase", F.col("f").alias("a"))
        if size < LONGEST:
            longer = frequent[size + 1]
            around = longer.select("lang", _head("phrase", size).alias("phrase"), "f").unionByName(
                longer.select("lang", _tail("phrase", size).alias("phrase"), "f")
            ).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
            share = F.expr(f"100 * cast(longer as {_DECIMAL}) >= {COVERED} * cast(a as {_DECIMAL})")
            phrases = phrases.join(around, ["lang", "phrase"], "left").where(
                ~F.coalesce(share, F.lit(False))
            ).drop("longer")
        kept = phrases if kept is None else kept.unionByName(phrases)
        for k in range(1, size):
            cut = phrases.select(
                "lang", "phrase", "a", F.lit(k).alias("k"),
                _head("phrase", k).alias("left"), _tail("phrase", size - k).alias("right"),
            )
            cuts = cut if cuts is None else cuts.unionByName(cut)
    scored = _lookup(_lookup(cuts, every, "left", "l"), every, "right", "r").withColumn(
        "score",
        F.expr(f"(2000000 * cast(a as {_DECIMAL})) div (cast(l as {_DECIMAL}) + cast(r as {_DECIMAL}))"),
    )
    return scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _best(df: DataFrame, keys: list) -> DataFrame:
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= FIRST)


def query(docs: DataFrame) -> DataFrame:
    """The first phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    NULL and empty texts have no words; a NULL language is ``und``. Repeated rows count as often as
    they occur. Ties in score go by count, then phrase. Texts are read whole, a text at a time. A
    language's best are taken from parts of its phrases first, so none is ranked by one task alone.
    An empty table gives an empty result.
    """
    counted = grams(docs)
    edges = counted.where((F.col("size") == LONGEST) & (F.col("n") >= LEAST))
    compacted = materialise(paths(edges.select("lang", "gram", "n")))
    found = counts(counted, compacted, LEAST)
    totals = found[1].groupBy("lang").agg(F.sum("f").alias("n"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = _best(_best(candidates(found).withColumn("part", part), ["lang", "part"]), ["lang"])
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase",
        *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")),
    )


SQL = """
    with pieces as (
        select row_number() over () as rid, lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') as words
        from (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
            from documents)),
    occurrences as (
        select lang, size, unnest(list_transform(range(1, len(words) - size + 2),
            lambda i: array_to_string(words[i:i + size - 1], ' '))) as phrase
        from pieces, (select unnest([1, 2, 3, 4]) as size) where len(words) >= size),
    f as (select lang, size, phrase, count(*) as f from occurrences group by all),
    totals as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
    frequent as (select * from f where size >= 2 and f >= 30),
    kept as (
        select c.* from frequent c where not exists (
            select 1 from frequent x where x.lang = c.lang and x.size > c.size and 100 * x.f >= 80 * c.f
                and contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
    cuts as (
        select lang, size, phrase, f, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as head,
            array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as rest
        from kept, (select unnest([1, 2, 3]) as k) where k < size),
    scored as (
        select c.lang, c.phrase, c.f as a, c.k, x.f as l, y.f as r,
            (2000000 * c.f::hugeint // (x.f + y.f))::bigint as score
        from cuts c join f x on x.lang = c.lang and x.phrase = c.head
            join f y on y.lang = c.lang and y.phrase = c.rest),
    lowest as (
        select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    ranked as (
        select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
    select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
    from ranked r join totals t using (lang) where r.rank <= 2000
"""
