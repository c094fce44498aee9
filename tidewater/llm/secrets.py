"""Secret scans: fixed patterns, and long tokens that pass a battery of randomness tests.

All work is DataFrame functions. A token's encoding is inferred from its characters, and three tests
ask whether it could be random over that encoding's alphabet: chi-squared uniformity of the symbols,
the number of runs above and below the alphabet's middle, and serial correlation of neighbours. Each
test is turned both ways. Against a random token, the three p-values combined by Fisher's method say
that a token is none. Against an ordinary one, they say how unlikely a word, a path or a number is to
come so close to random: by its symbols, if they are as uneven as in ordinary text of its length, and
by its runs and neighbours. These, combined by Fisher's method too and kept as logarithms, go through
Benjamini-Hochberg within bands of length over the whole corpus; tokens that are not random count there
as tested. Work is linear in a text's length, in the number of its matches and in a token's length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plainly, stash

#: The patterns, their kinds in order, and what a match must have.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Alphabets by encoding, from the narrowest, with the pattern that tells them.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[a-z]+$", LOWER),
    ("^[a-z0-9]+$", LOWER + DIGITS),
    ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("", UPPER + LOWER + DIGITS + "+/"),
)
#: Sums of squares and cubes of symbol shares in ordinary text, for words and for plain numbers.
WORD_SHARES, NUMBER_SHARES = (0.0655, 0.0054), (0.1, 0.01)
#: The polynomial of the normal tail, Abramowitz and Stegun 26.2.17.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Lower ends of the length bands.
BANDS = (20, 28, 40, 64, 128)
#: Bins of the logarithm of a p-value for each doubling.
BINS = 512

_SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"
_FOUND = "array<struct<start: bigint, kind: int, end: bigint, found: string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, op, zero: Column, block: int = 128) -> Column:
    """Running sums (or maxima, by ``op``) of an array, each with its own value.

    Arrays grow by copies, so the sums are taken in blocks first and the blocks' own sums after.
    """
    last = lambda x: F.element_at(x, -1)
    scan = lambda xs, of: F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(last(acc), of(x)))))

    def run(xs):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda i: scan(F.slice(xs, i * block + 1, block), lambda x: x))
        return _let(blocks, lambda inner: F.flatten(F.zip_with(inner, F.slice(scan(inner, last), 1, F.size(inner)), lambda xs, before: F.transform(F.slice(xs, 2, block), lambda x: op(before, x)))))

    return _let(values, lambda xs: F.when(F.size(xs) == 0, xs).otherwise(run(xs)))


def _places(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Array of (start, kind, end, found group) of the matches: code points, end exclusive.

    The pieces between matches and the matches alternate, so running lengths give their places.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast(_FOUND)

    def place(rows):
        ends = _running(F.transform(rows, lambda x: (F.length(x["piece"]) + F.length(x["match"])).cast("long")), lambda a, b: a + b, F.lit(0).cast("long"))
        return F.zip_with(rows, ends, lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("found")))

    rows = F.filter(F.arrays_zip(pieces.alias("piece"), matches.alias("match"), found.alias("found")), lambda x: x["match"].isNotNull())
    return F.when(text.rlike(pattern), _let(rows, place)).otherwise(none)


def _outside(base: Column, tokens: Column) -> Column:
    """The tokens that lie in no base span."""
    none = F.transform(base, lambda b: F.struct(b["start"], b["kind"], b["end"], F.lit("").alias("found")))

    def clear(both):
        reach = _running(F.transform(both, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.greatest, F.lit(0).cast("long"))
        return F.transform(F.filter(F.arrays_zip(both.alias("x"), reach.alias("reach")), lambda z: (z["x"]["kind"] == 3) & (z["reach"] < z["x"]["end"])), lambda z: z["x"])

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(_let(F.array_sort(F.concat(none.cast(_FOUND), tokens)), clear))


def _log_tail(z: Column) -> Column:
    """log P(normal > z), from the tail's ratio to the density: a polynomial near the middle, Boyd's approximation beyond."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * F.least(a, F.lit(4.0)))
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    ratio = F.when(a < 4, poly).otherwise(math.pi / ((math.pi - 1) * a + F.sqrt(a * a + 2 * math.pi)))
    upper = -a * a / 2 - 0.5 * math.log(2 * math.pi) + F.log(ratio)
    return F.when(z >= 0, upper).otherwise(F.log1p(-F.exp(upper)))


def _fisher(*logs: Column) -> Column:
    """Logarithm of the p-value of three p-values' product, from their logarithms."""
    x = -sum(logs[1:], logs[0])
    return F.log(1 + x + x * x / 2) - x


def _battery(tokens: Column, level: float) -> Column:
    """(start, kind, end, band, x) of the tokens; x: the bin of the p-value against ordinary text, 0 for what is not random."""
    encoding = lambda s: F.coalesce(*(F.when(s.rlike(p), F.lit(a)) if p else F.lit(a) for p, a in ENCODINGS))
    step = F.transform(tokens, lambda c: F.struct(c["start"], c["kind"], c["end"], F.translate(c["found"], "-_", "+/").alias("s"), encoding(c["found"]).alias("abc")))
    symbol = lambda c, i: F.length(c["s"]) - F.length(F.replace(c["s"], F.substring(c["abc"], i, 1)))
    step = F.transform(step, lambda c: F.struct(
        c["start"], c["kind"], c["end"], F.length(c["s"]).cast("double").alias("n"), F.length(c["abc"]).cast("double").alias("k"), c["s"].rlike("^[0-9]+$").alias("number"),
        F.aggregate(F.transform(F.sequence(F.lit(1), F.length(c["abc"])), lambda i: symbol(c, i).cast("double")), F.lit(0.0), lambda a, x: a + x * (x - 1)).alias("collisions"),
        F.transform(F.split(c["s"], ""), lambda x: F.call_function("locate", x, c["abc"]) - (F.length(c["abc"]) + 1) / 2).alias("x"),
    ))
    pairs = lambda c, f, zero: F.aggregate(F.zip_with(F.slice(c["x"], 2, F.size(c["x"])), F.slice(c["x"], 1, F.size(c["x"]) - 1), f), F.lit(zero), lambda a, x: a + x)
    step = F.transform(step, lambda c: F.struct(
        c["start"], c["kind"], c["end"], c["n"], c["k"], c["number"], c["collisions"],
        pairs(c, lambda x, y: F.when((x > 0) != (y > 0), 1.0).otherwise(0.0), 1.0).alias("runs"), pairs(c, lambda x, y: x * y, 0.0).alias("serial"),
    ))
    # Deviations from what a random token has: chi-squared, runs, serial correlation; half a step of the last two.
    chi = lambda c: (c["k"] * c["collisions"] / c["n"] - c["n"] + 1) / F.sqrt(2 * (c["k"] - 1) * (c["n"] - 1) / c["n"])
    runs = lambda c: F.abs((c["runs"] - 1 - (c["n"] - 1) / 2) / F.sqrt((c["n"] - 1) / 4))
    serial = lambda c: F.abs(c["serial"] * 12 / (c["k"] * c["k"] - 1) / F.sqrt(c["n"] - 1))
    half = lambda c: (0.5 / F.sqrt((c["n"] - 1) / 4), 0.25 * 12 / (c["k"] * c["k"] - 1) / F.sqrt(c["n"] - 1))

    def unlike_text(c):
        """Deviations of the collisions below those of ordinary text."""
        q2, q3 = (F.when(c["k"] == 16, b).otherwise(a) for a, b in zip(WORD_SHARES, NUMBER_SHARES, strict=True))
        n = c["n"]
        spread = F.sqrt(2 * n * (n - 1) * (q2 - q2 * q2) + 4 * n * (n - 1) * (n - 2) * (q3 - q2 * q2))
        return (n * (n - 1) * q2 - c["collisions"]) / spread

    random = lambda c: _fisher(_log_tail(chi(c)), F.log(F.lit(2.0)) + _log_tail(runs(c)), F.log(F.lit(2.0)) + _log_tail(serial(c)))
    within = lambda z, step: F.log1p(-2 * F.exp(_log_tail(z + step)))
    ordinary = lambda c: _fisher(_log_tail(unlike_text(c)), within(runs(c), half(c)[0]), within(serial(c), half(c)[1]))
    band = lambda c: sum((F.when(c["n"] >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    x = lambda c: F.when(~c["number"] & (random(c) >= math.log(level)), F.floor(BINS * F.log2(1 - ordinary(c))).cast("int")).otherwise(0)
    return F.transform(step, lambda c: F.struct(c["start"], c["kind"], c["end"], band(c).alias("band"), x(c).alias("x")))


def thresholds(scanned: DataFrame, rate: float) -> dict[int, int]:
    """Least x of each band that Benjamini-Hochberg accepts; counts bands times bins, and brings a row a band to the driver."""
    counts = scanned.select(F.explode("random").alias("c")).groupBy("c.band", "c.x").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("x"))
    ranked = counts.withColumns({"rank": F.sum("n").over(down), "of": F.sum("n").over(Window.partitionBy("band"))})
    log_p = 1 - F.pow(F.lit(2.0), F.col("x") / BINS)  # the bin's largest
    accepted = ranked.where(F.log("of") + log_p <= math.log(rate) + F.log("rank")).groupBy("band").agg(F.min("x").alias("x"))
    return {r.band: r.x for r in accepted.collect()}


def find_secrets(docs: DataFrame, rate: float = 0.05, level: float = 1e-4, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with an array column ``_spans`` of (start, kind, end), by start, then kind (see KINDS).

    ``rate``: share of the random tokens found that may be ordinary text; ``level``: how unlikely a random
    token must be to fail the three tests as a token does, for it to count as not random. A null or
    empty text has no spans. Rows are independent but for the thresholds, which are the whole table's:
    repeated rows have the same spans and count as often as they stand there. Null ids and other columns
    stay as they are, whatever their names; an empty table stays empty. Tokens inside a fixed pattern's
    match are left to it. ``keep_text=False`` drops the text column.
    """
    names = [c for c in docs.columns if keep_text or c != text_col]
    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    kept = [f"_c{docs.columns.index(c)}" for c in names]
    text = F.coalesce(F.col(f"_c{docs.columns.index(text_col)}"), F.lit(""))
    base = F.concat(F.filter(_places(text, ASSIGN, 0, 2), lambda x: F.length(x["found"]) >= 6), _places(text, ACCESS, 1), _places(text, HEX, 2))
    bare = F.transform(base, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    scanned = plain.select(*kept, bare.cast(_SPAN).alias("base"), _places(text, TOKEN, 3).alias("tokens"))
    scanned = scanned.select(*kept, "base", _outside(F.col("base"), F.col("tokens")).alias("tokens"))
    scanned = stash(scanned.select(*kept, "base", _battery(F.col("tokens"), level).alias("random")), "secrets")
    least = thresholds(scanned, rate)
    enough = lambda c: sum((F.when((c["band"] == b) & (c["x"] >= x), 1).otherwise(0) for b, x in least.items()), F.lit(0)) > 0
    found = F.transform(F.filter("random", enough), lambda c: F.struct(c["start"], c["kind"], c["end"]))
    spans = F.array_sort(F.concat("base", found.cast(_SPAN)))
    return scanned.select(*kept, spans.alias("_spans")).toDF(*names, "_spans")


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span of :func:`find_secrets` in the text put as ``mark``; other texts stay as they are.

    Spans that overlap have one mark. ``length_col``: a column of ``docs`` that holds the text's
    characters and is to follow it. Null texts stay null, repeated rows are treated alike, and an empty table stays empty.
    """
    plain, (own_text, *own_length) = plainly(docs, text_col, *([length_col] if length_col else []))
    text, zero = F.col(own_text), F.lit(0).cast("long")

    def put(chars):
        ends = _running(F.transform("_spans", lambda s: s["end"]), F.greatest, zero)
        cut = lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), F.greatest(b - a, zero).cast("int")), "")
        pieces = F.zip_with("_spans", F.concat(F.array(zero), ends), lambda s, before: F.when(s["start"].isNull(), cut(before, F.size(chars))).when(s["start"] >= before, F.concat(cut(before, s["start"]), F.lit(mark))).otherwise(""))
        return F.array_join(pieces, "")

    found = find_secrets(plain, text_col=own_text)
    found = found.withColumn(own_text, F.when(F.size("_spans") > 0, _let(F.split(text, ""), put)).otherwise(text))
    for c in own_length:
        found = found.withColumn(c, F.when(F.size("_spans") > 0, F.length(text)).otherwise(F.col(c)).cast(plain.schema[c].dataType))
    return found.drop("_spans").toDF(*docs.columns)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The scan's digest of every document; nulls and empty texts have no spans, repeated rows a row each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, keep_text=False)
    of = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("_spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"),
        _told(F.col("_spans")).alias("spans"), of(3).alias("n_random"),
    )
