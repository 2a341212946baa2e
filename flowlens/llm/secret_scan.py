"""Secrets in texts, found with DataFrame expressions only.

Three kinds follow fixed patterns: ``assign``, ``access`` and ``hex``. A fourth,
``random``, comes from a battery of randomness tests on long tokens: per encoding
inferred from the characters (digits, letters, hex, base 32, 36, 62, 64) a
chi-squared statistic of uniformity over its alphabet, a runs test on kinds of
characters (where the alphabet has several) and the serial correlation of neighbours. The statistics are compared with
what ordinary words and identifiers of that length show, so each token has a chance
of looking this random without being so; tokens are accepted by the rule of
Benjamini and Hochberg within classes of length, over the tokens of all documents.
The chances of a class are counted in bins, so the driver sees a few hundred counts.

Positions are code points, ends are exclusive. Defined cases: a null text counts as
empty; a token that overlaps a span of the fixed kinds is not reported again; repeated
rows give repeated results but count in the control like any others; very long tokens are
tested whole; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, and their patterns. For ``hex`` and ``access`` the least length is part of the pattern:
#: a run that is too short as a whole has no longer part.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
LEAST_VALUE = 12

#: Chance that two letters of ordinary text are equal, about the same in languages of Latin script.
COINCIDENCE = 0.066
#: How often neighbours in ordinary identifiers differ in kind (small letter, capital, digit). Alphabets in which random
#: characters change less often (0.47, 0.30 and 0.40 instead of 0.5 to 0.62) have rates of their own.
KIND_CHANGES, KIND_CHANGES_OF = 0.3, {16: 0.22, 32: 0.15, 36: 0.2}
#: Alphabets of one kind, whose tokens are one run: the runs test is left out.
ONE_KIND = (10, 26)
#: Beyond this many standard deviations of serial correlation a token is a sequence, not random.
SERIAL_LIMIT = 3.5
#: Share of false discoveries allowed, lengths from which classes begin, and bins a unit of -ln p.
FALSE_SHARE, LENGTHS, BINS, MOST = 0.01, (20, 28, 40, 64), 8, 400


def _hits(text: Column, pattern: str, group: int | None = None) -> Column:
    """Matches as (start, end, hit, value) in order; what lies between them gives their places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    kind = "array<struct<start:bigint,end:bigint,hit:string,value:string>>"

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit"), p["value"].alias("value"))
        return F.when(p["hit"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).alias("found")))

    none = F.array().cast(kind)
    walked = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")), step)["found"]
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _spans(hits: Column, kind: str) -> Column:
    order = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), order, h["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the fixed kinds, as arrays of (start, kind, end)."""
    assign = F.filter(_hits(text, ASSIGN, 1), lambda h: F.length(h["value"]) >= LEAST_VALUE)
    return {"assign": _spans(assign, "assign"), "access": _spans(_hits(text, ACCESS), "access"), "hex": _spans(_hits(text, HEX), "hex")}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _alphabet(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9]+$"), 10).when(token.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 16)
        .when(token.rlike("^[a-z]+$|^[A-Z]+$"), 26).when(token.rlike("^[A-Z2-7]+$"), 32)
        .when(token.rlike("^[a-z0-9]+$|^[A-Z0-9]+$"), 36).when(token.rlike("^[A-Za-z]+$"), 52)
        .when(token.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def chi_squared(token: Column, n: Column, k: Column) -> Column:
    """Uniformity over an alphabet of k characters."""
    counts = F.transform(F.array_distinct(F.split(token, "")), lambda c: F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    return k / n * _total(counts) - n


def runs(token: Column) -> Column:
    """Stretches of small letters, of capitals and of digits; other characters do not part them."""
    kinds = F.regexp_replace(F.regexp_replace(token, "[^A-Za-z0-9]", ""), "[a-z]+|[A-Z]+|[0-9]+", "x")
    return F.length(kinds)


def serial_correlation(token: Column, n: Column) -> Column:
    """Correlation of neighbouring character codes; 1 for a single character repeated."""

    def of(codes: Column) -> Column:
        return _let(_total(codes) / n, lambda mean: _let(F.transform(codes, lambda c: c - mean), _lagged))

    def _lagged(x: Column) -> Column:
        size = F.size(x)
        product = F.zip_with(F.slice(x, F.lit(1), size - 1), F.slice(x, F.lit(2), size - 1), lambda a, b: a * b)
        square = _total(F.transform(x, lambda a: a * a))
        return F.when(square > 0, _total(product) / square).otherwise(1.0)

    return _let(F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("double")), of)


def upper_tail(z: Column) -> Column:
    """-ln of the chance that a standard normal value exceeds z; exact enough for bins."""
    x = F.greatest(z, F.lit(0.0))
    # between the bounds of the Mills ratio; 1/2 at 0
    tail = x * x / 2 + F.log(x * 0.661 + 0.339 * F.sqrt(x * x + 5.51)) + 0.9189385
    return F.when(z > 0, tail).otherwise(0.0)


def looks_random(token: Column) -> Column:
    """-ln p of a token: p is the chance that an ordinary word or identifier of this length looks as random."""
    n, k = F.length(token).cast("double"), _alphabet(token).cast("double")
    # few characters are equal by chance more often; ordinary tokens are so in the same proportion as letters
    more = k * F.greatest(F.lit(COINCIDENCE), 26 * COINCIDENCE / k) - 1
    expected, spread = k - 1 + (n - 1) * more, F.sqrt(2 * (k - 1) + 4 * (n - 1) * more)
    uniform = (expected - chi_squared(token, n, k)) / spread
    rate = F.lit(KIND_CHANGES)
    for size, other in KIND_CHANGES_OF.items():
        rate = F.when(k == size, other).otherwise(rate)
    changes = (runs(token) - 1 - rate * (n - 1)) / F.sqrt(rate * (1 - rate) * (n - 1))
    both = F.when(k.isin(*ONE_KIND), uniform).otherwise((uniform + changes) / F.sqrt(F.lit(2.0)))
    sequence = F.abs(serial_correlation(token, n)) * F.sqrt(n) > SERIAL_LIMIT
    return F.when(sequence, 0.0).otherwise(upper_tail(both))


def tested_tokens(text: Column) -> Column:
    """Long tokens with the class of their length and the bin of their chance."""

    def of(h: Column) -> Column:
        token = F.rtrim(h["hit"], F.lit("="))
        size = F.length(token)
        length = sum((size >= x).cast("int") for x in LENGTHS[1:])
        return F.struct(
            h["start"].alias("start"), h["end"].alias("end"), length.alias("length"),
            F.least(F.floor(looks_random(token) * BINS), F.lit(MOST)).cast("int").alias("bin"),
        )

    return F.transform(_hits(text, TOKEN), of)


def accepted_bins(docs: DataFrame, text: Column, false_share: float = FALSE_SHARE) -> list[int]:
    """For each class of length the bin from which tokens are accepted; tokens of all documents count."""
    counts = docs.select(F.explode(tested_tokens(text)).alias("t")).groupBy("t.length", "t.bin").count().collect()
    out = []
    for length in range(len(LENGTHS)):
        mine = {r.bin: r["count"] for r in counts if r.length == length}
        total, so_far, least = sum(mine.values()), 0, MOST + 1
        for b in sorted(mine, reverse=True):
            so_far += mine[b]
            if total * 2.718281828459045 ** (-b / BINS) <= false_share * so_far:
                least = b
        out.append(least)
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``; spans are ``kind:start:end`` by start, then kind."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    accepted = F.array(*map(F.lit, accepted_bins(docs, text)))
    found = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        *[s.alias(k) for k, s in base_spans(text).items()],
        F.filter(tested_tokens(text), lambda t: t["bin"] >= F.element_at(accepted, t["length"] + 1)).alias("tokens"),
    )
    base = F.concat("assign", "access", "hex")
    fresh = F.filter("tokens", lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    found = found.withColumns({"base": base, "random": _spans(fresh, "random")})
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "random")).alias("spans"),
    )
