"""Fuzzy comparison of names, labels and passages; glossaries; denials."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators.retrieval import top_k
from orrery.session import ship
from orrery.storage import stash

# Phrases by which an answer says that it found nothing.
DENIALS = [
    r"\bno\s+(?:relevant\s+)?(?:documents?|files?|sources?)\b",
    r"\bno\s+documents?\s+(?:are\s+)?related\b",
    r"\bnot\s+found\b",
    r"\bwas\s+not\s+found\b",
    r"\bwere\s+not\s+found\b",
    r"\bnot\s+available\b",
    r"\bnot\s+mentioned\b",
    r"\bdoes\s+not\s+appear\b",
    r"\bcould\s+not\s+find\b",
    r"\bcouldn'?t\s+find\b",
    r"\bprovided\s+(?:context|information)\s+does\s+not\s+contain\b",
    r"\bno\s+information\s+(?:related\s+to|about|regarding)\b",
    r"\bcannot\s+provide\s+information\b",
    r"\bcan'?t\s+provide\s+information\b",
    r"\b(?:documents?|excerpts?|records?|files?|context|data)\s+(?:provided\s+)?do(?:es)?\s+not\s+contain\b",
    r"\bdo(?:es)?\s+not\s+contain\s+(?:any\s+)?(?:information|details|data)\b",
    r"\bdo(?:es)?\s+not\s+contain\s+(?:any\s+)?(?:explicit\s+)?(?:mention|reference)\b",
    r"\bnot\s+explicitly\s+(?:labell?ed|mentioned|stated|named|identified)\b",
    r"\bno\s+(?:explicit\s+)?(?:mention|reference)\s+(?:of|to)\b",
    r"\bplease\s+provide\s+a\s+(?:more\s+)?specific\s+question\b",
]


def denies(answer: Column) -> Column:
    """Whether an answer says that the documents have nothing; an empty one does not say so."""
    return F.coalesce(F.lower(answer).rlike("|".join(f"(?:{p})" for p in DENIALS)), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """100 less the share of letters to change, as a percentage of the longer text."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 100.0).otherwise(F.round(100 * (1 - F.levenshtein(a, b) / longer), 4))


def token_set(a: Column, b: Column) -> Column:
    """The similarity of two names by their sets of words: what they share against each with its own rest, the best of three."""
    wa, wb = _words(a), _words(b)
    both = F.array_join(F.array_intersect(wa, wb), " ")
    with_a = F.trim(F.concat_ws(" ", both, F.array_join(F.array_except(wa, wb), " ")))
    with_b = F.trim(F.concat_ws(" ", both, F.array_join(F.array_except(wb, wa), " ")))
    shared = F.when(both == "", F.lit(0.0)).otherwise(F.greatest(similarity(both, with_a), similarity(both, with_b)))
    return F.greatest(shared, similarity(with_a, with_b))


def _words(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")))


#: Grams that two short texts must share among their rarest ones, and edits up to which a text counts as short.
SHARED, SHORT_EDITS = 4, 3
#: Lengths of the parts by which a contained text is looked for.
PARTS = (16, 8, 4, 2, 1)
#: Similarity by which most queries have as many names as they ask for.
FIRST_LEAST = 88.0


def _keys(side: DataFrame, share: float) -> DataFrame:
    """``t, kind, key, size, need`` of distinct lower-case texts ``t``: what two texts that are alike must have in common.

    ``g``: pairs of letters within words and at their ends, numbered where they
    repeat; they stay the same in whatever order the words come, and an edit
    changes two of them, so ``need`` of them may be missing. ``w``: words with
    their lengths; those that are not shared may hold ``need`` letters.
    """
    # rows of one bag, so that it is not made again for each of its letters
    bags = side.select("t", F.explode(F.array(F.array_join(_words(F.col("t")), " "))).alias("bag")).filter("bag <> ''")
    pad = bags.select("t", "bag", F.concat(F.lit(" "), "bag", F.lit(" ")).alias("pad"))
    grams = F.transform(F.sequence(F.lit(1), F.length("pad") - 1), lambda i: F.substring(F.col("pad"), i, F.lit(2)))
    edits = F.floor(share / (1 - share) * F.length("bag") + 1e-6)
    often = pad.select("t", F.explode(grams).alias("gram"), edits.alias("edits")).groupBy("t", "gram", "edits").agg(F.count("*").cast("int").alias("n"))
    numbered = often.select("t", "edits", "gram", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    g = numbered.select("t", F.lit("g").alias("kind"), F.concat("gram", F.col("i").cast("string")).alias("key"), F.lit(1).alias("size"), (2 * F.col("edits")).cast("double").alias("need"))
    w = bags.select("t", F.lit("w").alias("kind"), F.explode(F.split("bag", " ")).alias("key"), (share * F.length("bag") + 1e-6).alias("need")).select("t", "kind", "key", F.length("key").alias("size"), "need")
    return g.unionByName(w)


def _sets(keys: DataFrame) -> DataFrame:
    """``t, key``: all sets of SHARED of the rarest grams of texts of few edits, hashed.

    Two texts share all but what edits change, so of ``need + SHARED`` rarest
    grams of either at least SHARED are the same, unless both have fewer than
    that to share.
    """
    most = 2 * SHORT_EDITS + SHARED
    short = keys.filter(f"kind = 'g' and need <= {2 * SHORT_EDITS}").groupBy("t").agg(F.max("need").cast("int").alias("need"), F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    first = short.select("t", F.transform(F.slice("keys", F.lit(1), F.col("need") + SHARED), lambda k: k["key"]).alias("k"))
    # sets in order of their last place, so the first ones are those of a shorter list
    places = sorted(combinations(range(most), SHARED), key=lambda s: s[-1])
    listed = F.array(*(F.array(*map(F.lit, s)) for s in places))
    sizes = F.array(*(F.lit(comb(m, SHARED)) for m in range(most + 1)))
    sets = first.select("t", "k", F.explode(F.slice(listed, F.lit(1), F.get(sizes, F.size("k")))).alias("s"))
    return sets.select("t", F.xxhash64(*(F.get("k", F.col("s")[i]) for i in range(SHARED))).alias("key"))


def _parts(side: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """``t, key``: all parts of texts of these lengths, hashed, each once."""
    text = F.col("t")
    of = lambda n: F.when(F.length("t") >= n, F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.xxhash64(F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))
    return side.select("t", F.explode(F.array_distinct(F.concat(*map(of, lengths)))).alias("key"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``i, o``: all pairs of texts of ``inner(t)`` and ``outer(t)`` of which the second contains the first; empty ones are in nothing.

    A text is looked for by the rarest of its parts of the largest length of
    PARTS that it has.
    """
    length = F.coalesce(*(F.when(F.length("t") >= n, n) for n in PARTS))
    inner = inner.filter("t <> ''").withColumn("_n", length)
    lengths = [r["_n"] for r in inner.select("_n").distinct().collect()]  # at most those of PARTS
    if not lengths:
        return inner.select(F.col("t").alias("i"), F.col("t").alias("o"))
    asked = None
    for n in lengths:
        part = _parts(inner.filter(F.col("_n") == n), [n])
        asked = part if asked is None else asked.unionByName(part)
    held = _parts(outer, lengths).join(asked.select("key").distinct(), "key", "left_semi")
    often = held.groupBy("key").agg(F.count("*").alias("n"))
    rare = asked.join(often, "key", "left").groupBy("t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("r")).filter("r.n > 0")
    met = rare.select(F.col("t").alias("i"), F.col("r.key").alias("key")).join(held.withColumnRenamed("t", "o"), "key")
    return met.filter(F.col("o").contains(F.col("i"))).select("i", "o")


def alike(left: DataFrame, right: DataFrame, least: float = 80.0) -> DataFrame:
    """``a, b``: all pairs of texts of ``left(t)`` and ``right(t)``, lower case and distinct, whose token-set similarity may reach
    ``least`` or of which one contains the other; some other pairs too.

    Each text has its rarest keys first, and two texts that are alike share
    some of the first ones, so keys that many texts have join little: short
    texts share a set of four, longer ones at least one. No pair is missed, and
    none is built but by a shared key. Texts without words are alike to
    nothing, empty ones are contained in nothing; ``least`` is 75 or more.
    """
    if least < 75:
        raise ValueError("names under 75 percent alike need not share anything")
    share = 1 - least / 100
    both = [stash(_keys(side, share), "name-keys") for side in (left, right)]
    often = both[0].unionByName(both[1]).groupBy("kind", "key").agg(F.count("*").alias("n"))
    order, all_of = Window.partitionBy("t", "kind").orderBy("n", "key"), Window.partitionBy("t", "kind")
    keys, sets = [], []
    for side in both:
        counted = side.join(often, ["kind", "key"])
        sets.append(_sets(counted))
        # single grams are for texts of many edits, and for those so short that they need not share a set
        ranked = counted.withColumn("_before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ranked = ranked.withColumns({"long": F.col("need") > 2 * SHORT_EDITS, "few": F.count("*").over(all_of) - F.col("need") < SHARED})
        ranked = ranked.select("t", "kind", "key", (F.col("_before") <= F.col("need")).alias("first"), "long", "few")
        keys.append(stash(ranked, "name-keys"))
    found = []
    named = lambda a, b: a.join(b, ["kind", "key"]).select("a", "b")
    pick = lambda side, c, where: keys[side].filter(where).select(F.col("t").alias(c), "kind", "key")
    found.append(named(pick(0, "a", "kind = 'w' and first"), pick(1, "b", "kind = 'w'")))
    found.append(named(pick(0, "a", "kind = 'w' and not first"), pick(1, "b", "kind = 'w' and first")))
    found.append(named(pick(0, "a", "kind = 'g' and first and long"), pick(1, "b", "kind = 'g'")))
    found.append(named(pick(0, "a", "kind = 'g' and first and not long"), pick(1, "b", "kind = 'g' and long")))
    found.append(named(pick(0, "a", "kind = 'g' and first and few and not long"), pick(1, "b", "kind = 'g' and few and not long")))
    found.append(sets[0].withColumnRenamed("t", "a").join(sets[1].withColumnRenamed("t", "b"), "key").select("a", "b"))
    found.append(contained(left, right).select(F.col("i").alias("a"), F.col("o").alias("b")))
    found.append(contained(right, left).select(F.col("o").alias("a"), F.col("i").alias("b")))
    return reduce(DataFrame.unionByName, found).distinct()


def best_names(queries: DataFrame, names: DataFrame, least: float = 80.0, k: int = 5) -> DataFrame:
    """For each of ``queries(query_id, q)`` the best ``names(name)``: 100 for a contained name plus the token-set similarity.

    Pairs come of :func:`alike`, first by a large similarity; only queries that
    have fewer than ``k`` names by then are asked again. Equal queries and equal
    names are compared once. Nulls match nothing.
    """
    asked = queries.withColumn("_a", F.lower("q")).filter("_a is not null")
    known = stash(names.filter("name is not null").groupBy("name").agg(F.count("*").alias("_n")).withColumn("b", F.lower("name")), "names")
    texts, right = stash(asked.select(F.col("_a").alias("t")).distinct(), "asked"), known.select(F.col("b").alias("t")).distinct()
    both = F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))
    best = Window.partitionBy("a").orderBy(F.desc("score"), "name")
    found, levels = None, [FIRST_LEAST, least] if least < FIRST_LEAST else [least]
    for level in levels:
        scored = alike(texts, right, level).select("a", "b", (token_set(F.col("a"), F.col("b")) + both.cast("double") * 100).alias("score")).filter(F.col("score") >= level)
        before = F.coalesce(F.sum("_n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = scored.join(known, "b").withColumn("_before", before).filter(F.col("_before") < k)
        kept = stash(kept.select("a", "name", "score", F.least(F.col("_n"), F.lit(k)).alias("_n")), "best-names")
        if level > least:
            texts = stash(texts.join(kept.groupBy("a").agg(F.sum("_n").alias("n")).filter(F.col("n") >= k), F.col("t") == F.col("a"), "left_anti").select("t"), "asked-again")
            kept = kept.join(texts, F.col("a") == F.col("t"), "left_anti")
        found = kept if found is None else found.unionByName(kept)
        if level > least and texts.isEmpty():
            break
    met = asked.join(found.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))), F.col("_a") == F.col("a"))
    return top_k(met, "query_id", "score", ["name"], k).select("query_id", (F.col("rank") - 1).alias("place"), "name", "score")


def canonical(label: Column, labels: Iterable[str], least: float = 80.0) -> Column:
    """The canonical label most like a text, or the text itself under ``least``."""
    options = [F.struct(similarity(F.lower(label), F.lit(c.lower())).alias("s"), F.lit(c).alias("c")) for c in labels]
    best = F.array_max(F.array(*options))
    return F.when(best["s"] >= least, best["c"]).otherwise(label)


class Glossary:
    """Abbreviations and terms with their meanings; several meanings of one are told apart by tags."""

    def __init__(self, terms: dict[str, str], groups: dict[str, list[str]] | None = None):
        self.terms = {k.lower(): v for k, v in terms.items()}
        self.groups = {k.lower(): v for k, v in (groups or {}).items()}
        names = sorted(self.terms, key=lambda t: (-len(t.split()), -len(t), t))
        self.pattern = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, names)) + r")(?!\w)", re.IGNORECASE) if names else None

    def sense(self, term: str, tags: Iterable[str] = ()) -> str:
        """One meaning of several split by ``|``: the first that names a tag, else one that names none, else the first."""
        options = [o.strip() for o in self.terms[term.lower()].split("|")]
        by_tag = [o for o in options if any(f"[{t}]" in o for t in tags)]
        plain = [o for o in options if "[" not in o]
        return re.sub(r"\s*\[[^\]]*\]", "", (by_tag or plain or options)[0])

    def matches(self, text: str) -> list[str]:
        """Terms in a text, the longest at each place, each once."""
        return list(dict.fromkeys(m.lower() for m in self.pattern.findall(text or ""))) if self.pattern else []

    def expanded(self, text: str, tags: Iterable[str] = ()) -> str:
        """Each term followed by its meaning in brackets, at its first place."""
        seen: set[str] = set()

        def put(m: re.Match) -> str:
            low = m[0].lower()
            if low in seen:
                return m[0]
            seen.add(low)
            return f"{m[0]} ({self.sense(low, tags)})"

        return self.pattern.sub(put, text) if self.pattern else text

    def compressed(self, text: str) -> str:
        """Each meaning replaced by its term."""
        for term in sorted(self.terms, key=lambda t: -len(self.terms[t])):
            text = re.sub(rf"(?<!\w){re.escape(self.sense(term))}(?!\w)", term.upper(), text, flags=re.IGNORECASE)
        return text

    def synonyms(self, text: str) -> list[str]:
        """Members of the groups whose name the text contains."""
        low = text.lower()
        return list(dict.fromkeys(m for k, members in self.groups.items() if k in low for m in members))

    def column(self, text: Column) -> Column:
        """The terms in a column's texts; the glossary goes along as the function's own data."""
        ship(SparkSession.active())
        known = self

        @F.pandas_udf("array<string>")
        def find(texts: pd.Series) -> pd.Series:
            return texts.map(known.matches)

        return find(text)


def passage_place(text: str | None, passage: str | None, least: float = 0.75) -> tuple[int, float] | None:
    """Where a passage stands in a text and how alike it is: as it is, then by its first 50 characters, then by the window of words most like it."""
    if not text or not passage:
        return None
    low, want = text.lower(), passage.lower().strip()
    if (at := low.find(want)) >= 0:
        return at, 1.0
    if len(want) > 50 and (at := low.find(want[:50])) >= 0:
        return at, 0.9
    words = [(m.start(), m[0]) for m in re.finditer(r"\S+", low)]
    size = len(want.split())
    best, place = 0.0, None
    goal = Counter(want.split())
    for i in range(max(1, len(words) - size + 1)):
        part = [w for _, w in words[i : i + size]]
        if sum((Counter(part) & goal).values()) < least * size / 2:
            continue  # too few common words to be alike
        ratio = SequenceMatcher(None, want, " ".join(part), autojunk=False).ratio()
        if ratio > best:
            best, place = ratio, words[i][0]
    return (place, round(best, 4)) if place is not None and best > least else None
