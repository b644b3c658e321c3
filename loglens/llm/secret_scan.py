"""Secret scans: fixed patterns, and a battery of randomness tests on every long token.

A token is a run of twenty or more characters that encodings use. Its encoding is inferred from the
characters it has (hexadecimal, base 32, base 62 or base 64; letters alone or digits alone encode
nothing). Under the null hypothesis a token of that encoding is drawn uniformly and independently:
a secret. Three tests look for a departure: chi-squared over the alphabet, the number of runs above
and below the middle of the alphabet, and the correlation of neighbours. The least of the three
p-values, times three, is the token's.

Which tokens are declared not random is decided over all documents by the Benjamini-Hochberg rule,
for each encoding and length class by itself, because long tokens depart more easily: at most a
share ``RATE`` of the tokens that are dismissed is expected to be random. Of the others those are
reported that are no identifiers either. Names are made of words, so their neighbouring letters mostly
stay in one case and their digits together; under this second null hypothesis the classes of neighbours
follow the fixed chances below, and a token's log likelihood ratio against random letters, which
grows with its length, gives its p-value. The same rule decides: at most a share ``RATE`` of the reported
tokens is expected to be such names. Hexadecimal tokens have no words and skip that.
P-values are rounded up to a thousandth of a decade, so the rule needs one count for each value.

Everything is built-in expressions. Defined cases: a null text is an empty one, without spans; a null
id stays null; repeated rows are scanned once each; other columns are ignored by ``scanned`` and
kept by ``redacted``; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.session import stage

# The base kinds, in the order in which spans of equal start are listed.
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
LEAST_VALUE = 8
#: Tokens that are tested: maximal runs, so the look-behind only spares the engine false starts.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Share of dismissed tokens that may be random, and the least length of each length class.
RATE = 0.05
LENGTHS = [20, 32, 48, 80]
_DECADES, _STEPS = 15, 1000
MASK = "[SECRET]"

# The alphabets, in the order of their digits.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "base32": _UPPER + "234567",
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}


# Chances of the class that follows in a name (lower case, upper case, digit; a name of one case: letter,
# digit), and the classes' shares of an alphabet.
_NAMES = {"mixed": [[0.80, 0.15, 0.05], [0.80, 0.15, 0.05], [0.25, 0.25, 0.50]], "single": [[0.93, 0.07], [0.40, 0.60]]}
_SHARES = {"mixed": [26 / 62, 26 / 62, 10 / 62], "single": [52 / 62, 10 / 62], "base32": [26 / 32, 6 / 32]}
#: Neighbouring pairs aren't independent: their variance counts for more.
_SPREAD = 1.5


def _ratios(kind: str, shares: str) -> tuple[list[list[float]], float, float]:
    """Log ratios of a name's chances to random ones, and their mean and variance in names."""
    chances, parts = _NAMES[kind], _SHARES[shares]
    ratio = [[math.log(p / q) for p, q in zip(row, parts)] for row in chances]
    at = [1 / len(parts)] * len(parts)
    for _ in range(100):  # how often each class occurs in names
        at = [sum(a * row[j] for a, row in zip(at, chances)) for j in range(len(parts))]
    mean = sum(a * p * r for a, row, found in zip(at, chances, ratio) for p, r in zip(row, found))
    square = sum(a * p * r * r for a, row, found in zip(at, chances, ratio) for p, r in zip(row, found))
    return ratio, mean, square - mean * mean


def _pieces(text: Column, pattern: str, kind: str, value: int = 0) -> Column:
    """Matches of a pattern in order, each with the length of the text before it since the last."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    return F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(between, i)).cast("bigint").alias("gap"),
        F.length(m).cast("bigint").alias("width"), F.get(values, i).alias("value")))


def encoding(token: Column) -> Column:
    """The inferred encoding of a token without padding; null where it encodes nothing."""
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return (
        F.when(~mixed, F.lit(None).cast("string"))
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^[A-Za-z0-9]+$"), "base62")
        .when(~(token.rlike("[a-z]") & token.rlike("[A-Z]")), F.lit(None).cast("string"))
        .when(token.rlike("^[A-Za-z0-9+/]+$"), "base64")
        .when(token.rlike("^[A-Za-z0-9_-]+$"), "base64url")
    )


def upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z; error below 1e-7 (a fixed rational approximation)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """Add ``p`` to rows with a ``token`` and its ``encoding``."""
    alphabet = F.lit(None).cast("string")
    for name, letters in ALPHABETS.items():
        alphabet = F.when(F.col("encoding") == name, F.lit(letters)).otherwise(alphabet)
    plain = F.when(F.col("encoding") == "hex", F.lower("token")).otherwise(F.col("token"))
    spelt = tokens.withColumn("_letters", F.split(plain, "")).withColumn("_alphabet", alphabet)
    digits = F.transform("_letters", lambda c: F.instr(F.col("_alphabet"), c).cast("double") - 1)
    read = spelt.withColumn("_x", F.filter(digits, lambda x: x >= 0)).withColumn(
        "_n", F.size("_x").cast("double")).withColumn("_k", F.length("_alphabet").cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    # Sum of squared counts: runs of equal values in the sorted digits, k-th of a run adding 2k - 1.
    ordered = read.withColumn("_s", F.sort_array("_x"))
    squares = F.aggregate(
        "_s", F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, x: F.struct(
            x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            (a["sum"] + F.when(x == a["last"], 2 * a["run"] + 1).otherwise(F.lit(1.0))).alias("sum")),
        lambda a: a["sum"])
    n, k = F.col("_n"), F.col("_k")
    chi, free = squares * k / n - n, k - 1
    # Cube root of a chi-squared variable over its mean: nearly normal (Wilson and Hilferty).
    cube = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    middle = (k - 1) / 2
    steps = F.transform(F.slice("_x", 2, F.greatest(F.size("_x"), F.lit(1))), lambda x, i: F.struct(
        F.when((x > middle) != (F.get("_x", i) > middle), 1.0).otherwise(0.0).alias("turn"),
        ((x - middle) * (F.get("_x", i) - middle)).alias("product")))
    moved = ordered.withColumn("_chi", upper_tail(cube)).withColumn("_steps", steps)
    turns = (total(F.transform("_steps", lambda s: s["turn"])) - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    serial = total(F.transform("_steps", lambda s: s["product"])) / ((k * k - 1) / 12) / F.sqrt(n - 1)
    two_sided = lambda z: F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))
    p = F.least(F.lit(1.0), 3 * F.least("_chi", two_sided(turns), two_sided(serial)))
    return moved.withColumn("p", p).drop("_letters", "_alphabet", "_x", "_n", "_k", "_s", "_chi", "_steps")


def as_names(tokens: DataFrame) -> DataFrame:
    """Add ``p_name``, how well rows with a ``token`` and its ``encoding`` pass for names; null for hexadecimal ones."""
    token = F.col("token")
    letters = F.split(token, "")
    both = token.rlike("[a-z]") & token.rlike("[A-Z]")

    def scored(kind: str, shares: str) -> Column:
        ratio, mean, variance = _ratios(kind, shares)
        width = len(ratio)
        classes = F.transform(letters, lambda c: (
            F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2) if kind == "mixed"
            else F.when(c.rlike("[A-Za-z]"), 0).when(c.rlike("[0-9]"), 1)).otherwise(-1))
        table = F.array(*[F.lit(r) for row in ratio for r in row])
        pairs = F.transform(F.slice(classes, 2, F.greatest(F.size(classes), F.lit(1))), lambda x, i: F.when(
            (x >= 0) & (F.get(classes, i) >= 0), F.get(table, F.get(classes, i) * width + x)))
        known = F.filter(pairs, lambda r: r.isNotNull())
        n = F.greatest(F.size(known), F.lit(1)).cast("double")
        total = F.aggregate(known, F.lit(0.0), lambda a, r: a + r)
        return upper_tail((n * mean - total) / F.sqrt(n * variance * _SPREAD))

    p = F.when(F.col("encoding") == "hex", F.lit(None).cast("double")).when(F.col("encoding") == "base32", scored("single", "base32")).when(
        both, scored("mixed", "mixed")).otherwise(scored("single", "single"))
    return tokens.withColumn("p_name", F.when(F.col("encoding").isNotNull(), p))


def _level(p: str) -> Column:
    return F.floor(F.least(-F.log10(F.greatest(p, F.lit(10.0**-_DECADES))), F.lit(float(_DECADES))) * _STEPS)


def _class(width: Column) -> Column:
    out = F.lit(LENGTHS[0])
    for least in LENGTHS[1:]:
        out = F.when(width >= least, F.lit(least)).otherwise(out)
    return out


def thresholds(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """(encoding, length_class, dismissed): tokens with ``level`` of at least ``dismissed`` are
    declared not random; null where none is. One row for each class: at most 20.

    ``level`` is the rounded -log10 p; its counts are at most 15,001 rows for each class, however
    many tokens there are.
    """
    counts = tested.groupBy("encoding", "length_class", "level").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("encoding", "length_class")
    up_to = whole.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("rank", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(whole))
    p = F.pow(F.lit(10.0), -F.col("level") / _STEPS)
    return ranked.groupBy("encoding", "length_class").agg(
        F.min(F.when(p <= rate * F.col("rank") / F.col("all"), F.col("level"))).alias("dismissed"))


def has_match(text: Column) -> Column:
    return text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(TOKEN)


def found_spans(docs: DataFrame, keep: list[str], rate: float = RATE) -> DataFrame:
    """(row, the columns to keep, spans) for each row of ``docs`` with a ``text``; ``spans`` is an
    array of (start, rank of the kind, end), in that order.

    The texts are read once. Only places and p-values leave that pass, and are written; the
    thresholds are counted from them.
    """
    text = F.col("text")
    every = F.concat(
        _pieces(text, ASSIGN, KINDS[0], 2), _pieces(text, ACCESS, KINDS[1]), _pieces(text, HEX, KINDS[2]),
        _pieces(text, TOKEN, KINDS[3]))
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    dealt = rows.select("row", *keep, F.explode_outer(F.when(has_match(text), every)).alias("m"))
    flat = dealt.select("row", *keep, "m.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = flat.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(before)).withColumn(
        "start", F.col("end") - F.col("width")).withColumn("token", F.rtrim(F.col("value"), F.lit("=")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    listed = placed.withColumn("rank", rank).withColumn(
        "encoding", F.when((rank == 3) & ~F.col("token").rlike(rf"^({HEX}|{ACCESS})$"), encoding(F.col("token"))))
    tested = as_names(battery(listed)).withColumn("length_class", _class(F.length("token"))).withColumn(
        "level", _level("p")).withColumn("name_level", _level("p_name"))
    good = (F.col("rank") == 0) & (F.length("value") >= LEAST_VALUE) | F.col("rank").isin(1, 2) | F.col("encoding").isNotNull()
    written = stage(
        tested.select("row", *keep, F.when(good, F.col("rank")).alias("rank"), "start", "end", "encoding",
                      "length_class", "level", "name_level"), "secret_tokens")
    # At most 20 rows each: encodings times length classes.
    limits = thresholds(written.where("encoding IS NOT NULL"), rate)
    names = thresholds(written.where("name_level IS NOT NULL").select("encoding", "length_class", F.col("name_level").alias("level")), rate)
    judged = written.join(F.broadcast(limits), ["encoding", "length_class"], "left").join(
        F.broadcast(names.withColumnRenamed("dismissed", "no_name")), ["encoding", "length_class"], "left")
    random = (F.col("dismissed").isNull() | (F.col("level") < F.col("dismissed"))) & (
        F.col("name_level").isNull() | F.coalesce(F.col("name_level") >= F.col("no_name"), F.lit(False)))
    stays = F.col("rank").isNotNull() & (F.col("encoding").isNull() | random)
    span = F.when(stays, F.struct("start", "rank", "end"))
    return judged.groupBy("row", *keep).agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(rank: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rank"] == rank))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every document."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    found = found_spans(named, ["doc_id"], rate)
    count = [_count(k).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(3)]
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``MASK``; overlapping spans become one.

    Only texts with a match are joined with their spans, by a hash of the text; all others pass as
    they are. Equal texts have equal spans, so each is joined once however often it occurs.
    """
    hit = F.coalesce(has_match(F.col(text)), F.lit(False))
    keyed = docs.where(hit).withColumn("_key", F.sha2(F.col(text), 256))
    spans = found_spans(keyed.select("_key", F.col(text).alias("text")), ["_key"], rate)
    by_text = spans.groupBy("_key").agg(F.first("spans").alias("_spans"))
    both = keyed.join(by_text, "_key")
    # The cuts: each span from where the spans before it end. ``reach`` is where they end.
    merged = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("bigint").alias("reach"), F.lit("").alias("out")),
        lambda a, s: F.when(s["end"] <= a["reach"], a).otherwise(F.struct(
            s["end"].alias("reach"),
            F.concat(a["out"], F.when(s["start"] >= a["reach"], F.concat(
                F.substring(F.col(text), (a["reach"] + 1).cast("int"), (s["start"] - a["reach"]).cast("int")),
                F.lit(MASK))).otherwise(F.lit(""))).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(F.col(text), (a["reach"] + 1).cast("int"), F.lit(2**31 - 1))))
    masked = both.withColumn(text, merged).select(*docs.columns)
    return docs.where(~hit).unionByName(masked)
