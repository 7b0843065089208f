"""Secret scans by patterns and by a battery of randomness tests, in SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import fresh
from orrery.storage import stash

# The patterns of the base scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 8

#: Runs that the battery looks at, padding only at their end, and the fewest characters that give its tests any power.
RUN = r"[A-Za-z0-9+/_-]{14,}(?:=+(?![A-Za-z0-9+/_=-]))?"
RUN_LEAST = 20
#: Parts of a run that has characters of both base64 alphabets.
PARTS = (r"[A-Za-z0-9+/]{14,}=*", r"[A-Za-z0-9_-]{14,}=*")
#: What any text with such a run or part holds: texts without it are passed over.
LONG = r"[A-Za-z0-9+/_=-]{20}"
#: Rate at which runs taken for secrets may in truth be text, in each class of encoding and length.
FDR = 0.05
#: The battery's p-value below which a run is not random, whatever text would look like.
FIT = 1e-3
#: Bins a decade of the p-values' histogram, and decades kept apart.
BINS, DECADES = 10, 12

# Alphabets in the order of their encodings.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    "base32": (r"^[A-Z2-7]+=*$", UPPER + "234567"),
    "base36": (r"^([A-Z0-9]+|[a-z0-9]+)$", DIGITS + LOWER),
    "base62": (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    "base64": (r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": (r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
}

# Letters of English text in per mille, a to z.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 1, 20, 1)
#: Shares of digits, of upper case among letters, and of other marks in runs that are text: names, paths, slugs.
TEXT_DIGITS, TEXT_UPPER, TEXT_MARKS = 0.1, 0.15, 0.06
#: Digits in hex runs that are no secrets, which often are numbers.
HEX_DIGITS = 0.5


def text_shares(encoding: str) -> list[float]:
    """How often each character of an encoding's alphabet comes in runs that are no secrets."""
    alphabet = ENCODINGS[encoding][1]
    both = any(c in LOWER for c in alphabet) and any(c in UPPER for c in alphabet)

    def share(c: str) -> float:
        if c.isdigit():
            return (HEX_DIGITS if encoding == "hex" else TEXT_DIGITS) / sum(x.isdigit() for x in alphabet)
        if not c.isalpha():
            return TEXT_MARKS / 2
        return LETTERS[ord(c.lower()) - 97] * (1.0 if not both else TEXT_UPPER if c in UPPER else 1 - TEXT_UPPER) / 1000

    shares = [share(c) for c in alphabet]
    letters = sum(x for x, c in zip(shares, alphabet, strict=True) if c.isalpha())
    left = 1 - sum(x for x, c in zip(shares, alphabet, strict=True) if not c.isalpha())
    return [x * left / letters if c.isalpha() else x for x, c in zip(shares, alphabet, strict=True)]


def _scan(values: Column, fold) -> Column:
    """Running folds of an array: each value with all before it.

    Each round folds in what stands 1, 2, 4, ... places before, so the work is n
    log n, where an accumulator that grows by an element a step is copied n
    times.
    """

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, fold(F.get(acc, i - back), x)).otherwise(x))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)
    return F.aggregate(rounds, values, step)


_SPAN = "start:int,end:int,first:int,last:int,value:string"


def _places(text: Column, pattern: str) -> Column:
    """``start, end, first, last, value`` of each match: its place in code points and in bytes, ends exclusive, and its text.

    What a split leaves between matches gives their places.
    """

    def placed(s: Column) -> Column:
        found, gaps = s["found"], F.slice(s["gaps"], 1, F.size(s["found"]))
        both = F.zip_with(gaps, found, lambda gap, x: F.struct((F.length(gap) + F.length(x)).alias("chars"), (F.octet_length(gap) + F.octet_length(x)).alias("bytes")))
        ends = _scan(both, lambda x, y: F.struct((x["chars"] + y["chars"]).alias("chars"), (x["bytes"] + y["bytes"]).alias("bytes")))
        return F.zip_with(ends, found, lambda e, x: F.struct((e["chars"] - F.length(x)).alias("start"), e["chars"].alias("end"), (e["bytes"] - F.octet_length(x)).alias("first"), e["bytes"].alias("last"), x.alias("value")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), _then(both, placed)).otherwise(F.array().cast(f"array<struct<{_SPAN}>>"))


def _covered(text: Column, spans: Column, cover) -> Column:
    """``text`` with what ``spans`` (by start) cover replaced: ``cover(span, fresh)`` stands for each span.

    ``fresh`` tells whether a span begins behind the end of all before it; what
    lies between is copied by its bytes, which needs no walk from the text's
    start.
    """

    def built(s: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(s["ends"], i - 1))
            between = F.substring(s["raw"], F.coalesce(before["last"], F.lit(0)) + 1, F.greatest(x["first"] - F.coalesce(before["last"], F.lit(0)), F.lit(0)))
            return F.concat(between.cast("string"), cover(x, before))

        rest = F.substring(s["raw"], F.element_at(s["ends"], -1)["last"] + 1, F.octet_length(s["raw"])).cast("string")
        return F.array_join(F.concat(F.transform(spans, piece), F.array(rest)), "")

    ends = _scan(F.transform(spans, lambda x: F.struct(x["last"].alias("last"), x["end"].alias("end"))), F.greatest)
    return F.when(F.size(spans) > 0, _then(F.struct(text.cast("binary").alias("raw"), ends.alias("ends")), built)).otherwise(text)


def _then(value: Column, step) -> Column:
    """Binds a value once: SQL expressions have no names, and nested ones are worked out again at each use."""
    return F.element_at(F.transform(F.array(value), step), 1)


def _base_spans(text: Column) -> Column:
    """Spans of the fixed kinds: ``start, rank, end, first, last, kind, value`` (the whole match), by start, then kind as listed."""
    assign = F.filter(_places(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(*(F.transform(x, _span(i)) for i, x in enumerate((assign, _places(text, ACCESS), _places(text, HEX))))))


def _span(order: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("rank"), x["end"].alias("end"), x["first"].alias("first"), x["last"].alias("last"), F.lit(KINDS[order]).alias("kind"), x["value"].alias("value"))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the classic five-term polynomial; good to 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-x * x / 2) / F.lit(2.5066282746310002)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _gains(name: Column) -> Column:
    """Of each character of an encoding's alphabet, the log of its share in random tokens over that in text."""
    out = F.lit(None).cast("array<double>")
    for encoding, (_, alphabet) in ENCODINGS.items():
        logs = [-math.log(len(alphabet) * x) for x in text_shares(encoding)]
        out = F.when(name == encoding, F.array(*map(F.lit, logs))).otherwise(out)
    return out


def _battery(token: Column) -> Column:
    """``class`` (encoding and length), ``fit`` and ``p`` of a token.

    ``fit`` is the chance that a token drawn uniformly from its inferred
    alphabet looks less random: chi-squared uniformity over the alphabet
    (Wilson-Hilferty normal form), runs above and below the middle of the
    alphabet, and lag-1 serial correlation; the smallest of the three p-values
    times three. ``p`` bounds the chance that a text's characters favour
    randomness as much: it is the inverse of the likelihood ratio of random
    characters to those of text, whose mean over text is 1 at any length. It is
    1 where ``fit`` says that the token is not random.
    """
    body = F.regexp_replace(token, "=+$", "")
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]") & ~token.rlike(r"^[a-z]*[0-9]*$")
    name, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for encoding, (pattern, alphabet) in reversed(ENCODINGS.items()):
        name = F.when(token.rlike(pattern), F.lit(encoding)).otherwise(name)
        letters = F.when(token.rlike(pattern), F.lit(alphabet)).otherwise(letters)
    folded = F.when(name.isin("hex", "base36"), F.lower(body)).otherwise(body)
    base = F.struct(folded.alias("t"), name.alias("name"), letters.alias("abc"))

    def counted(s: Column) -> Column:
        n, size = F.length(s["t"]).cast("double"), F.length(s["abc"]).cast("double")
        squares = F.aggregate(F.split(s["abc"], ""), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(s["t"], c, F.lit(""))), F.lit(2.0)))
        place = F.transform(F.split(s["t"], ""), lambda c: F.call_function("instr", s["abc"], c).cast("double"))
        return F.struct(s["name"].alias("name"), n.alias("n"), size.alias("size"), squares.alias("squares"), place.alias("place"), _gains(s["name"]).alias("gains"))

    def moments(s: Column) -> Column:
        n, size, place = s["n"], s["size"], s["place"]
        mean = F.aggregate(place, F.lit(0.0), lambda acc, x: acc + x) / n
        high = F.aggregate(place, F.lit(0.0), lambda acc, x: acc + F.when(x > size / 2, 1.0).otherwise(0.0))
        pairs = F.arrays_zip(F.slice(place, F.lit(1), (n - 1).cast("int")).alias("a"), F.slice(place, F.lit(2), (n - 1).cast("int")).alias("b"))
        runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.when((x["a"] > size / 2) != (x["b"] > size / 2), 1.0).otherwise(0.0))
        cross = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + (x["a"] - mean) * (x["b"] - mean))
        gain = F.aggregate(place, F.lit(0.0), lambda acc, x: acc + F.element_at(s["gains"], x.cast("int")))
        spread = F.aggregate(place, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        return F.struct(s["name"].alias("name"), n.alias("n"), size.alias("size"), s["squares"].alias("squares"), high.alias("high"), runs.alias("runs"), (cross / F.greatest(spread, F.lit(1e-9))).alias("serial"), gain.alias("gain"))

    def judged(s: Column) -> Column:
        n, df = s["n"], s["size"] - 1
        chi = F.greatest(s["size"] / n * s["squares"] - n, F.lit(0.0))
        uniform = _normal_tail((F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        both = 2 * s["high"] * (n - s["high"])
        sd = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        runs = F.when(both > 0, 2 * _normal_tail(F.abs((s["runs"] - both / n - 1) / sd))).otherwise(F.lit(0.0))
        serial = 2 * _normal_tail(F.abs(s["serial"] * F.sqrt(n) + 1 / F.sqrt(n)))
        fit = F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))
        name = F.concat_ws(":", s["name"], F.least(F.floor(F.log2(n)), F.lit(12)).cast("string"))
        return F.struct(name.alias("class"), fit.alias("fit"), F.when(fit >= FIT, F.least(F.lit(1.0), F.exp(-s["gain"]))).otherwise(1.0).alias("p"))

    return F.when(mixed & name.isNotNull(), _then(_then(_then(base, counted), moments), judged))


def _candidates(text: Column, base: Column) -> Column:
    """Runs outside the base spans, which cut them, with their class and p-value.

    A run with characters of both base64 alphabets is in no single encoding; it
    is cut at the ones and at the others, and parts of both kinds are tested.
    """

    def blank(x: Column, before: Column) -> Column:
        return F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], F.coalesce(before["end"], F.lit(0))), F.lit(0)))

    def parts(x: Column) -> Column:
        cut = F.array_distinct(F.concat(*(_places(x["value"], p) for p in PARTS)))
        moved = F.transform(cut, lambda y: F.struct(*((x[a] + y[b]).cast("int").alias(b) for a, b in (("start", "start"), ("start", "end"), ("first", "first"), ("first", "last"))), y["value"].alias("value")))
        return F.when(x["value"].rlike("[+/]") & x["value"].rlike("[_-]"), moved).otherwise(F.array(x))

    runs = F.flatten(F.transform(_then(_covered(text, base, blank), lambda t: _places(t, RUN)), parts))
    long = F.filter(runs, lambda x: F.length(x["value"]) >= RUN_LEAST)
    tested = F.transform(long, lambda x: x.withField("test", _battery(x["value"])))
    none = F.array().cast(f"array<struct<{_SPAN},test:struct<class:string,fit:double,p:double>>>")
    return F.when(text.rlike(LONG), F.filter(tested, lambda x: x["test"].isNotNull())).otherwise(none)


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS), F.lit(BINS * DECADES)).cast("int")


def _limits(tested: DataFrame) -> Column:
    """For each class, the bin of -log10 p at and over which a token counts as a secret.

    Step-up control of the false-discovery rate in each class, on a histogram of
    the p-values: a class's table has as many rows as there are bins, so what
    reaches the driver is bounded by classes times bins.
    """
    bins = tested.select(F.explode("tested.test").alias("t")).select(F.col("t.class").alias("class"), _bin(F.col("t.p")).alias("bin"))
    table: dict[str, dict[int, int]] = {}
    for name, at, n in bins.groupBy("class", "bin").count().collect():
        table.setdefault(name, {})[at] = n
    limits = {}
    for name, counts in table.items():
        total, seen, limit = sum(counts.values()), 0, BINS * DECADES + 1
        for at in sorted(counts, reverse=True):
            seen += counts[at]
            if 10 ** (-at / BINS) <= FDR * seen / total:
                limit = at
        limits[name] = limit
    if not limits:
        return F.lit(None).cast("map<string,int>")
    return F.create_map(*(F.lit(x) for pair in sorted(limits.items()) for x in pair))


def _all_spans(base: Column, tested: Column, limits: Column) -> Column:
    stays = F.filter(tested, lambda x: _bin(x["test"]["p"]) >= F.try_element_at(limits, x["test"]["class"]))
    return F.array_sort(F.concat(base, F.transform(stays, _span(3))))


def secret_spans(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text of ``docs(doc_id, text)``.

    The base kinds are fixed patterns: an assignment to a telling name, an
    access key, a long hex string. Other long runs of an encoding's characters
    that mix digits and letters go through a battery of randomness tests for
    the encoding they look like. What passes them gets the p-value of the null
    hypothesis that it is text; these p-values of all documents meet in a
    histogram for each class of encoding and length, and a run is added as
    ``random`` where the step-up procedure of its class rejects that, so of the
    runs added in a class about FDR at most are text. Everything happens in a
    row but that histogram.

    Null text: no spans. Null or repeated doc_id: rows stay as they are. Other
    columns are not looked at; an empty table gives an empty result.

    Work grows with n log n of a text's length and matches.

    Returns ``doc_id, base, spans``: arrays of (start, rank, end, first, last,
    kind, value), start and end in code points, first and last in bytes, ends
    exclusive, by start, then kind as listed.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", "text", _base_spans(F.col("text")).alias("base"))
    found = stash(found.select("doc_id", "base", _candidates(F.col("text"), F.col("base")).alias("tested")), "secret-found")
    return found.select("doc_id", "base", _all_spans(F.col("base"), F.col("tested"), _limits(found)).alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret of a text replaced by ``mask`` and ``n_chars``, where there is one, brought up to date.

    Spans that overlap or touch are masked as one. The rows are written once with
    what was found in them, so that limits and mask come of one scan. Texts without secrets, null
    ones and all other columns stay as they are.
    """
    text = F.coalesce("text", F.lit(""))
    base, tested = fresh(docs, "_base", "_tested")
    found = docs.withColumn(base, _base_spans(text))
    found = stash(found.withColumn(tested, _candidates(text, F.col(base))), "secret-rows")
    every = _all_spans(F.col(base), F.col(tested), _limits(found.select(F.col(tested).alias("tested"))))

    def hide(x: Column, before: Column) -> Column:
        return F.when(before["last"].isNull() | (x["first"] > before["last"]), F.lit(mask)).otherwise(F.lit(""))

    masked = _then(every, lambda spans: _covered(F.col("text"), spans, hide))
    row = found.withColumn("text", F.when((F.size(base) > 0) | (F.size(tested) > 0), masked).otherwise(F.col("text"))).drop(base, tested)
    return row.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else row


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
