"""Merkle manifest of a dataset: a content-addressed DAG, descended once for all leaf requests.

Every document is a leaf; eight consecutive digests make a node, level by level, in one tree for
each language and in one tree over the languages' roots. A node is stored as a record from its
digest to its children. A request for a leaf's proof is a rank: its digits in base eight say which
child to take at every record on the way down from the root, and the children not taken are the
siblings of the proof. Requests that share a way go down it together, so a record is read once
whatever the number of leaves below it, and a level costs one join of its own size. The segments
of a way are collected from the root down and reversed into a proof, which runs from the leaf up.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnwise.session import materialise

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of so many documents, by crc32 of the id, one is offered with an altered text.
TAMPERED_EVERY = 3

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEGMENT = "array<struct<before:string,after:string>>"
_PARTITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf(text: Column | None = None) -> Column:
    """The digest of a document row, with ``text`` in place of its own where given."""
    return digest(*(field(text if c == "text" and text is not None else F.col(c)) for c in FIELDS))


def lower_text() -> Column:
    """The tampering: A-Z of the text in lower case; NULL stays NULL."""
    return F.translate("text", _UPPER, _UPPER.lower())


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves(tree, ...)`` with ``rank``, the position in the tree by ``(item, digest)``.

    Rows are range-partitioned on the whole order, so a tree that holds most rows is spread over
    all tasks; each partition numbers its own rows and a table with a row for each partition and
    tree gives the offsets. The numbered rows are written before the offsets are taken from them.
    """
    order = ["tree", F.col("item").asc_nulls_first(), "digest"]
    numbered = materialise(
        leaves.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("slot", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("slot", _PARTITION_BITS))
    parts = numbered.groupBy("tree", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("slot").alias("first")
    )
    each = Window.partitionBy("tree")
    before = each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "tree", "part", "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        F.sum("rows").over(each).alias("remaining"),
    )
    placed = numbered.join(offsets, ["tree", "part"])
    return placed.withColumn("rank", F.col("slot") - F.col("first") + F.col("offset")).drop(
        "part", "slot", "first", "offset"
    )


@dataclass(frozen=True)
class Forest:
    """Trees as records by level, the lowest first, and their roots."""

    levels: list[DataFrame]
    roots: DataFrame

    def store(self) -> DataFrame:
        """``(digest, children)``: the content-addressed records, equal ones stored once."""
        records = [level.select("digest", "children") for level in self.levels]
        if not records:
            return self.roots.select("digest", F.array("digest").alias("children")).limit(0)
        store = records[0]
        for level in records[1:]:
            store = store.unionByName(level)
        return store.dropDuplicates(["digest"])


def build(leaves: DataFrame) -> Forest:
    """Trees over ``leaves(tree, rank, remaining, digest)``; ``remaining`` is the tree's leaf count.

    A record's children are at most eight consecutive nodes, so no group is larger than that and
    no tree is hot. Each level is written; a tree leaves the loop when one node remains of it.
    """
    nodes = leaves.select("tree", F.col("rank").alias("position"), "remaining", "digest")
    most = nodes.agg(F.max("remaining")).first()[0] or 0
    levels, roots = [], [nodes.where("remaining = 1").withColumn("height", F.lit(0))]
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("position", "digest")))
        level = materialise(
            nodes.where("remaining > 1")
            .groupBy(
                "tree",
                F.expr(f"(remaining + {FANOUT - 1}) div {FANOUT}").alias("remaining"),
                F.expr(f"position div {FANOUT}").alias("above"),
            )
            .agg(run["digest"].alias("children"))
            .select(
                "tree", F.col("above").alias("position"), "remaining", "children",
                digest(F.concat_ws("", "children")).alias("digest"),
            )
        )
        levels.append(level)
        nodes = level.drop("children")
        roots.append(nodes.where("remaining = 1").withColumn("height", F.lit(len(levels))))
        most = -(-most // FANOUT)
    table = roots[0]
    for more in roots[1:]:
        table = table.unionByName(more)
    return Forest(levels, materialise(table.select("tree", "digest", "height")))


def _below(frontier: DataFrame, level: DataFrame) -> DataFrame:
    """The records that ``frontier``'s digests name, with the way that led to each.

    Looked up by digest; the place goes into the key as well, so that equal subtrees, which share
    a digest, are spread over tasks.
    """
    return frontier.join(level.select("tree", "position", "digest", "children"),
                         ["tree", "position", "digest"])


def _segment(children: Column, digit: Column) -> Column:
    """The children beside the one taken, as the digests before it and those after it."""
    return F.struct(
        F.concat_ws("", F.slice(children, F.lit(1), digit)).alias("before"),
        F.concat_ws("", F.slice(children, digit + 2, F.lit(FANOUT))).alias("after"),
    )


def descend(forest: Forest, starts: DataFrame, last: int) -> DataFrame:
    """Go from ``starts(tree, path, ...)`` at the trees' roots down to level ``last``.

    Returns ``(tree, position, digest, path, ...)`` with a row for each node there; ``path`` holds
    a segment for every record passed, the root's first. Trees lower than ``last`` stay at their
    root. At most one written table for each level; a level is an eighth of the one below.
    """
    entering = starts.join(forest.roots, "tree").withColumn("position", F.lit(0).cast("long"))
    kept = [c for c in starts.columns if c not in ("tree", "path")]
    columns = ["tree", "position", "digest", "path", *kept]
    frontier = None
    for height in range(len(forest.levels), last, -1):
        fresh = entering.where(F.col("height") == height).select(columns)
        frontier = fresh if frontier is None else frontier.unionByName(fresh)
        taken = _below(frontier, forest.levels[height - 1]).select(
            "*", F.posexplode("children").alias("digit", "child")
        )
        frontier = materialise(
            taken.select(
                "tree",
                (F.col("position") * FANOUT + F.col("digit")).alias("position"),
                F.col("child").alias("digest"),
                F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"),
                *kept,
            )
        )
    rest = entering.where(F.col("height") <= last).select(columns)
    return rest if frontier is None else frontier.unionByName(rest)


def manifest(docs: DataFrame, altered: Column | None = None, text: Column | None = None) -> DataFrame:
    """A proof for every document: ``(doc_id, leaf, subroot, root, path, offered)``.

    ``path`` runs from the leaf to the root, with the siblings before and after the node at each
    level. ``offered`` is the leaf, or where ``altered`` holds that of the row with ``text`` in
    place of its own. Documents of one language are ordered by id, NULL first, rows that share an id by leaf; a NULL
    language is a tree of its own, before all others. Repeated rows are leaves of their own. NULL
    and empty fields differ (``-`` and ``0:``). An empty table gives an empty result. Texts are
    read once and never shuffled.
    """
    offered = leaf()
    if altered is not None:
        offered = F.when(F.coalesce(altered, F.lit(False)), leaf(text)).otherwise(leaf())
    leaves = materialise(
        docs.select(
            F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), "lang")).alias("tree"),
            F.col("doc_id").alias("item"), leaf().alias("digest"), offered.alias("offered"),
        )
    )
    requests = materialise(ranked(leaves))
    forest = build(requests)
    tops = ranked(
        forest.roots.select(
            F.lit("").alias("tree"), F.col("tree").alias("item"), "digest"
        )
    )
    tops = materialise(tops)
    top = build(tops)
    start = top.roots.select(
        "tree", F.array().cast(_SEGMENT).alias("path"), F.col("digest").alias("root")
    )
    languages = descend(top, start, 0).join(
        tops.select("tree", F.col("rank").alias("position"), F.col("item").alias("language")),
        ["tree", "position"],
    )
    starts = languages.select(
        F.col("language").alias("tree"), "path", "root", F.col("digest").alias("subroot")
    )
    # The last records are met by the requests themselves: each takes one child of its run.
    near = descend(forest, starts, 1)
    if forest.levels:
        lowest = forest.levels[0].select("tree", "position", "digest", "children")
        near = near.join(lowest, ["tree", "position", "digest"], "left")
    else:
        near = near.withColumn("children", F.lit(None).cast("array<string>"))
    joined = requests.withColumn("position", F.expr(f"rank div {FANOUT}")).join(
        near.drop("digest"), ["tree", "position"]
    )
    own = F.when(
        F.col("children").isNotNull(),
        F.array(_segment(F.col("children"), (F.col("rank") % FANOUT).cast("int"))),
    ).otherwise(F.array().cast(_SEGMENT))
    return joined.select(
        F.col("item").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        F.reverse(F.concat("path", own)).alias("path"), "offered",
    )


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""
    return F.aggregate(path, start, lambda at, s: digest(s["before"], at, s["after"]))


def query(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, folded from an altered text for a third of the ids.

    A NULL id is never altered. Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified``; see :func:`manifest` for NULLs, ties, repeated rows and empty tables.
    """
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    proofs = manifest(docs, altered, lower_text())
    siblings = F.transform("path", lambda s: F.concat(s["before"], s["after"]))
    folded = proofs.withColumn("folded_root", fold(F.col("offered"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root",
        digest(F.concat_ws("", siblings)).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: DuckDB has no crc32; the polynomial is applied bit by bit to the digits of the id.
SQL = """
    with recursive docs as (
        select row_number() over () as rid, doc_id, lang,
            'h' as h, coalesce(cast(octet_length(encode(cast(doc_id as varchar))) as varchar) || ':' || doc_id, '-')
                || coalesce(cast(octet_length(encode(source)) as varchar) || ':' || source, '-')
                || coalesce(cast(octet_length(encode(lang)) as varchar) || ':' || lang, '-')
                || coalesce(cast(octet_length(encode(cast(n_chars as varchar))) as varchar) || ':' || n_chars, '-') as head,
            text from documents),
    hashed as (
        select rid, doc_id, lang,
            sha256(head || coalesce(cast(octet_length(encode(text)) as varchar) || ':' || text, '-')) as leaf,
            sha256(head || coalesce(cast(octet_length(encode(text)) as varchar) || ':' || translate(text,
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) as lowered
        from docs),
    crc as (
        select rid, 0 as i, 4294967295::bigint as c, cast(doc_id as varchar) as digits from docs
        union all
        select rid, i + 1,
            list_reduce(list_prepend(xor(c, ascii(substr(digits, i + 1, 1))), range(1, 9)),
                lambda x, j: xor(x >> 1, (x & 1) * 3988292384)), digits
        from crc where i < length(digits)),
    altered as (
        select rid, xor(c, 4294967295) % 3 = 0 as is_altered from crc where i = length(digits)),
    leaves as (
        select h.*, coalesce(lang, '') as tree, case when coalesce(is_altered, false) then lowered else leaf end as offered,
            row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as rank,
            count(*) over (partition by lang) as n
        from hashed h left join altered using (rid)),
    nodes as (
        select lang, rank as pos, n, leaf as digest, 0 as lvl from leaves
        union all
        select lang, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)), lvl + 1
        from nodes where n > 1 group by lang, pos // 8, (n + 7) // 8, lvl),
    subroots as (
        select lang, digest, lvl as height, row_number() over (order by lang nulls first) - 1 as rank,
            count(*) over () as n
        from nodes where n = 1),
    tops as (
        select rank as pos, n, digest, 0 as lvl from subroots
        union all
        select pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)), lvl + 1
        from tops where n > 1 group by pos // 8, (n + 7) // 8, lvl),
    root as (select digest, lvl as height from tops where n = 1),
    steps as (
        select l.rid, k.lvl as step,
            coalesce(string_agg(k.digest, '' order by k.pos) filter (where k.pos < l.rank // (8::bigint ** k.lvl)::bigint), '') as before,
            coalesce(string_agg(k.digest, '' order by k.pos) filter (where k.pos > l.rank // (8::bigint ** k.lvl)::bigint), '') as after
        from leaves l join nodes k on l.lang is not distinct from k.lang and k.n > 1
            and k.pos // 8 = l.rank // (8::bigint ** (k.lvl + 1))::bigint
        group by l.rid, k.lvl
        union all
        select l.rid, s.height + k.lvl,
            coalesce(string_agg(k.digest, '' order by k.pos) filter (where k.pos < s.rank // (8::bigint ** k.lvl)::bigint), ''),
            coalesce(string_agg(k.digest, '' order by k.pos) filter (where k.pos > s.rank // (8::bigint ** k.lvl)::bigint), '')
        from leaves l join subroots s on l.lang is not distinct from s.lang
            join tops k on k.n > 1 and k.pos // 8 = s.rank // (8::bigint ** (k.lvl + 1))::bigint
        group by l.rid, s.height, k.lvl),
    folded as (
        select rid, 0 as step, offered as digest from leaves
        union all
        select f.rid, f.step + 1, sha256(s.before || f.digest || s.after)
        from folded f join steps s on s.rid = f.rid and s.step = f.step),
    ends as (select rid, arg_max(digest, step) as digest from folded group by rid),
    proofs as (select rid, string_agg(before || after, '' order by step) as siblings from steps group by rid)
    select l.doc_id, l.leaf, s.digest as subroot, r.digest as root,
        sha256(coalesce(p.siblings, '')) as proof_sha256, e.digest as folded_root,
        e.digest = r.digest as verified
    from leaves l join subroots s on l.lang is not distinct from s.lang cross join root r
        join ends e on e.rid = l.rid left join proofs p on p.rid = l.rid
"""
