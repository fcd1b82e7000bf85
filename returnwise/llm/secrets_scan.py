"""Secret scans in DataFrame functions alone.

Known shapes come from three patterns. Further tokens are tried by a battery of randomness tests
against the encoding their characters imply: chi-squared uniformity over the alphabet, a runs test
about its middle, and serial correlation of neighbouring symbols. The smallest p-value, corrected
for three tests, says how unlike random output a token is. Within each length class the
Benjamini-Hochberg rule over all tokens of the table separates the tokens shown not to be random;
the others are reported, so the share of truly random tokens among the dismissed stays controlled at
every length, although short tokens carry less evidence.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise.session import materialise

# The base patterns, the group that must be long enough, and the least length.
ASSIGN = (
    r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
KINDS = ("assign", "access", "hex", "random")

#: What the randomness tests are tried on: at least so many characters, with letters and digits.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Share of random tokens allowed among those dismissed as not random.
DISCOVERY_RATE = 0.01
#: Lengths at which a new class begins.
LENGTH_CLASSES = (20, 28, 40, 64, 128)
#: p-values are counted in steps of a twentieth of a decade, the last step holding all below it.
STEPS_A_DECADE, LAST_STEP = 20, 400

# Alphabets in the order of their symbols' values.
_ALPHABETS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_STEP = 256


def _before(lengths: Column) -> Column:
    """For each position the sum of the elements before it, by way of block sums."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(lengths) / _STEP).cast("int")),
        lambda b: total(F.slice(lengths, b * _STEP + 1, _STEP)),
    )
    heads = F.transform(blocks, lambda _, i: total(F.slice(blocks, F.lit(1), i)))
    return F.transform(
        lengths,
        lambda _, i: F.get(heads, F.floor(i / _STEP).cast("int"))
        + total(F.slice(lengths, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP)),
    )


def _spans(df: DataFrame, text: str, name: str, pattern: str, group: int, least: int) -> DataFrame:
    """Column ``name``: an array of (start, end, token) of the pattern's matches, in code points.

    What splitting leaves over and what extracting finds alternate, which gives the positions.
    """
    gap, hit, before = f"{name}_gap", f"{name}_hit", f"{name}_before"
    df = df.withColumns({
        gap: F.transform(F.split(F.col(text), pattern, -1), F.length),
        hit: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)),
        f"{name}_part": F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)),
    })
    df = df.withColumn(before, _before(F.transform(hit, lambda m, i: F.length(m) + F.get(F.col(gap), i))))
    start = lambda i: F.get(F.col(before), i) + F.get(F.col(gap), i)
    found = F.transform(
        F.col(hit),
        lambda m, i: F.struct(
            start(i).alias("start"), (start(i) + F.length(m)).alias("end"),
            F.get(F.col(f"{name}_part"), i).alias("token"),
        ),
    )
    return df.withColumn(name, F.filter(found, lambda s: F.length(s["token"]) >= least)).drop(
        gap, hit, before, f"{name}_part"
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal by Zelen and Severo's rational approximation."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def p_value(token: Column) -> Column:
    """The battery's corrected p-value that ``token`` is random output of its encoding."""
    alphabet = F.lit(_BASE64)
    for pattern, symbols in reversed(_ALPHABETS):
        alphabet = F.when(token.rlike(pattern), F.lit(symbols)).otherwise(alphabet)
    return F.transform(F.array(F.struct(token.alias("t"), alphabet.alias("a"))), _battery)[0]


def _battery(x: Column) -> Column:
    symbols = F.split(x["t"], "")
    values = F.transform(F.filter(symbols, lambda c: c != ""), lambda c: F.instr(x["a"], c) - 1)
    counts = F.transform(
        F.array_distinct(F.filter(symbols, lambda c: c != "")),
        lambda c: (F.length(x["t"]) - F.length(F.replace(x["t"], c, F.lit("")))).cast("double"),
    )
    inner = F.array(F.struct(
        F.length(x["t"]).cast("double").alias("n"), F.length(x["a"]).cast("double").alias("k"),
        values.alias("v"), F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
    ))
    return F.transform(inner, _tests)[0]


def _tests(x: Column) -> Column:
    n, k, v = x["n"], x["k"], x["v"]
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, b: a + b)
    pairs = F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("x"), F.slice(v, F.lit(2), F.size(v)).alias("y"))
    # Chi-squared over the alphabet, by the cube root's normal approximation.
    chi = F.greatest(k / n * x["squares"] - n, F.lit(0.0)) / (k - 1)
    uniform = _upper_tail((F.pow(chi, F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1))))
    # Runs above and below the middle of the alphabet.
    high = total(F.transform(v, lambda s: (s >= k / 2).cast("double")))
    runs = 1 + total(F.transform(pairs, lambda p: ((p["x"] >= k / 2) != (p["y"] >= k / 2)).cast("double")))
    expected = 2 * high * (n - high) / n + 1
    deviation = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    turns = F.when((high == 0) | (high == n), F.pow(F.lit(2.0), 1 - n)).otherwise(
        2 * _upper_tail(F.abs(runs - expected) / deviation)
    )
    # Serial correlation of neighbours.
    mean = total(F.transform(v, lambda s: s.cast("double"))) / n
    moment = total(F.transform(v, lambda s: (s - mean) * (s - mean)))
    lagged = total(F.transform(pairs, lambda p: (p["x"] - mean) * (p["y"] - mean)))
    serial = F.when(moment == 0, F.lit(0.0)).otherwise(
        2 * _upper_tail(F.abs(lagged / moment + 1 / n) * F.sqrt(n))
    )
    return F.least(F.lit(1.0), 3 * F.least(uniform, turns, serial))


def _class(length: Column) -> Column:
    out = F.lit(0)
    for i, edge in enumerate(LENGTH_CLASSES):
        out = F.when(length >= edge, F.lit(i)).otherwise(out)
    return out


def _cutoffs(counts: list) -> dict[int, int]:
    """By class the first step whose tokens are dismissed as not random."""
    found = {}
    for own in sorted({c for c, _, _ in counts}):
        steps = {s: n for c, s, n in counts if c == own}
        total, below = sum(steps.values()), 0
        for step in range(LAST_STEP, -1, -1):
            below += steps.get(step, 0)
            if 10 ** (-step / STEPS_A_DECADE) <= DISCOVERY_RATE * below / total:
                found[own] = step
    return found


def _ranked(kind: str, rank: int) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")
    ))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs(doc_id, text)``.

    ``spans`` is an array of (start, end, rank, kind) by start and then kind as listed in ``KINDS``;
    code points, end exclusive. A NULL or empty text has none. Repeated rows are each scanned; other
    columns are ignored. A token already covered in part by a base span is not reported again.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for name, pattern, group, least in (*BASE, ("random", TOKEN, 0, 20)):
        # A run of hexadecimal digits that is long enough is a whole run, so shorter ones need not
        # be found first; for the others every match counts in finding the next one.
        longest = pattern.replace("+", "{%d,}" % least) if name == "hex" else pattern
        df = _spans(df, "text", name, longest, group, least)
    base = F.concat(*[_ranked(name, i) for i, (name, *_) in enumerate(BASE)])
    tokens = F.filter(
        "random",
        lambda s: s["token"].rlike("[0-9]") & s["token"].rlike("[A-Za-z]")
        & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    step = lambda p: F.least(
        F.lit(LAST_STEP), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS_A_DECADE)
    ).cast("int")
    df = materialise(
        df.withColumn("base", base).withColumn("tokens", tokens).select(
            "doc_id", "base",
            F.transform("tokens", lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"),
                _class(F.length(s["token"])).alias("size"), step(p_value(s["token"])).alias("step"),
            )).alias("tokens"),
        )
    )
    # At most a row for each class and step reaches the driver.
    counts = df.select(F.inline("tokens")).groupBy("size", "step").count().collect()
    cutoffs = _cutoffs([(r["size"], r["step"], r["count"]) for r in counts])
    dismissed = lambda s: reduce(
        lambda a, b: a | b, [(s["size"] == c) & (s["step"] >= cut) for c, cut in cutoffs.items()], F.lit(False)
    )
    added = F.transform(
        F.filter("tokens", lambda s: ~dismissed(s)),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                           F.lit(len(BASE)).alias("rank"), F.lit("random").alias("kind")),
    )
    ordered = F.transform(
        F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind")),
    )
    return df.select("doc_id", ordered.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def query(docs: DataFrame) -> DataFrame:
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return scan(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
