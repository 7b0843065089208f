"""The letters' graph: edges by shared facts, closure, traversal, components.

Every kind of edge is an equi-join on the shared fact, never a join of all
pairs. Letters with the same set of facts are one class, named by its smallest
id: edges run between classes, and :func:`members` tells who is in which, so
many letters of one kind do not pair with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.correspondence import party_key
from orrery.storage import stash


def _sets(notices: DataFrame, values: Column) -> DataFrame:
    """``id, facts``: each letter's distinct facts in order."""
    facts = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))
    return notices.select(F.col("doc_id").alias("id"), facts.alias("facts")).filter(F.size("facts") > 0)


def members(sets: DataFrame) -> DataFrame:
    """``id, rep``: each letter with the smallest id of its class."""
    return sets.join(sets.groupBy("facts").agg(F.min("id").alias("rep")), "facts").select("id", "rep")


def class_edges(sets: DataFrame, weight, kind: str) -> DataFrame:
    """Edges ``a < b`` between the classes of different sets that share a fact; ``weight`` takes shared, size of a, size of b."""
    facts = sets.groupBy("facts").agg(F.min("id").alias("id")).select("id", F.size("facts").alias("n"), F.explode("facts").alias("fact"))
    a = facts.select("fact", F.col("id").alias("a"), F.col("n").alias("n_a"))
    b = facts.select("fact", F.col("id").alias("b"), F.col("n").alias("n_b"))
    shared = a.join(b, "fact").filter("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    return shared.select("a", "b", F.lit(kind).alias("edge_type"), F.round(weight(F.col("shared"), F.col("n_a"), F.col("n_b")), 6).alias("weight"))


#: Classes of a fact that meet each other in one piece of work, about.
BLOCK = 512
#: Facts of a class that go along with each of its rows; pairs of larger classes are counted.
ALONG = 64


def all_edges(sets: DataFrame, weight, kind: str) -> DataFrame:
    """The edges of :func:`class_edges`, for facts of very many classes.

    A pair is written where its first common fact is and needs no exchange of
    pairs: each row of a fact takes the class's facts before and after it along,
    a pair with a common fact before is left to that one, those after are
    counted. Two masks of bits tell most pairs without a further common fact
    at once. A fact of over ``BLOCK`` classes deals them into blocks, and each two
    of its blocks meet apart from the others. Pairs with a class of over
    ``ALONG`` facts are grouped and counted instead.
    """
    classes = stash(sets.groupBy("facts").agg(F.min("id").alias("id")), "graph-classes")
    often = classes.select(F.explode("facts").alias("fact")).groupBy("fact").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK)
    hubs = stash(often.select("fact", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "graph-hubs")
    n, few = F.size("facts"), F.size("facts") <= ALONG
    rows = classes.select("id", n.alias("n"), "facts", F.posexplode("facts").alias("pos", "fact")).select(
        "id", "n", "fact", F.when(few, F.slice("facts", F.lit(1), F.col("pos"))).alias("before"), F.when(few, F.slice("facts", F.col("pos") + 2, F.col("n"))).alias("after")
    )
    bits = "aggregate(concat(before, after), 0L, (m, f) -> m | shiftleft(1L, cast(pmod(shiftright(xxhash64(f), {}), 64) AS int)))"
    rows = rows.withColumns({"bits": F.expr(bits.format(0)), "more": F.expr(bits.format(6))})
    blocks = F.coalesce("blocks", F.lit(1))
    met = rows.join(hubs, "fact", "left").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    kept = ["own", "n", "before", "after", "bits", "more"]
    met = met.select("fact", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", *kept).repartition("fact", "low", "high")

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.select("fact", "low", "high", F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in kept])

    place = ["fact", "low", "high"]
    met_once = (F.col("low") == F.col("high")) | (F.col("own_a") != F.col("own_b"))
    apart = (F.col("bits_a").bitwiseAND(F.col("bits_b")) == 0) | (F.col("more_a").bitwiseAND(F.col("more_b")) == 0)
    pairs = side(met, "a").join(side(met, "b").hint("merge"), place).filter((F.col("a") < F.col("b")) & met_once & (apart | ~F.arrays_overlap("before_a", "before_b")))
    shared = pairs.select("a", "b", "n_a", "n_b", F.when(apart, 1).otherwise(F.size(F.array_intersect("after_a", "after_b")) + 1).cast("long").alias("shared"))
    if not classes.filter(~few).isEmpty():
        many = met.filter("before is null")
        large = side(many, "a").join(side(met, "b").hint("merge"), place).unionByName(side(met.filter("before is not null"), "a").join(side(many, "b").hint("merge"), place))
        shared = shared.unionByName(large.filter((F.col("a") < F.col("b")) & met_once).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared")))
    return shared.select("a", "b", F.lit(kind).alias("edge_type"), F.round(weight(F.col("shared"), F.col("n_a"), F.col("n_b")), 6).alias("weight"))


def class_facts(sets: DataFrame, kind: str) -> DataFrame:
    """``fact, id, n, letters, links, edge_type``: each fact of each class of letters with equal sets.

    ``n`` facts and ``letters`` of the class named ``id``; ``links`` other classes
    have this fact too. Two classes are linked where a fact has rows of both,
    with the facts they share over the larger ``n`` as the weight
    (:func:`weighted` gives these edges of stated classes), so a fact of many
    classes has a row for each and not for each pair. A letter without facts has
    no rows, one whose facts nobody shares has ``links`` 0.
    """
    classes = sets.groupBy("facts").agg(F.min("id").alias("id"), F.count("*").alias("letters"))
    rows = classes.select("id", F.size("facts").alias("n"), "letters", F.explode("facts").alias("fact"))
    often = rows.groupBy("fact").agg((F.count("*") - 1).alias("links"))
    met = rows.repartition("fact").join(often.repartition("fact"), "fact")
    return met.select("fact", "id", "n", "letters", "links", F.lit(kind).alias("edge_type"))


def weighted(facts: DataFrame, focus: DataFrame) -> DataFrame:
    """``a, b, edge_type, weight`` from the stated classes ``focus(id)`` to all that share a fact with them; ``facts`` is of :func:`class_facts`."""
    own = facts.join(focus.select("id").distinct(), "id", "left_semi").select("fact", "edge_type", F.col("id").alias("a"), F.col("n").alias("n_a"))
    other = facts.select("fact", "edge_type", F.col("id").alias("b"), F.col("n").alias("n_b"))
    met = own.repartition("fact").join(other.repartition("fact"), ["fact", "edge_type"]).filter("a <> b")
    shared = met.groupBy("a", "b", "edge_type", "n_a", "n_b").agg(F.count("*").alias("shared"))
    return shared.select("a", "b", "edge_type", F.round(F.col("shared") / F.greatest("n_a", "n_b"), 6).alias("weight"))


def reference_sets(notices: DataFrame) -> DataFrame:
    return _sets(notices, F.transform("refs", lambda r: r.cast("string")))


def party_sets(notices: DataFrame) -> DataFrame:
    return _sets(notices, F.array(party_key(F.col("sender")), party_key(F.col("recipient"))))


def topic_sets(notices: DataFrame) -> DataFrame:
    return _sets(notices, F.transform("topics", lambda t: F.lower(t)))


def reference_edges(notices: DataFrame) -> DataFrame:
    """Classes of letters that share references; weight: shared over the larger set."""
    return all_edges(reference_sets(notices), lambda s, a, b: s / F.greatest(a, b), "references")


def party_edges(notices: DataFrame) -> DataFrame:
    """Classes of letters that share a party; weight: shared over the larger set."""
    return all_edges(party_sets(notices), lambda s, a, b: s / F.greatest(a, b), "same_party")


def reference_classes(notices: DataFrame) -> DataFrame:
    """Classes of letters by the references that they share."""
    return class_facts(reference_sets(notices), "references")


def party_classes(notices: DataFrame) -> DataFrame:
    """Classes of letters by the parties that they share."""
    return class_facts(party_sets(notices), "same_party")


def topic_edges(notices: DataFrame, least: float = 0.3) -> DataFrame:
    """Classes of letters whose topics have a Jaccard similarity of ``least`` or more, which is the weight."""
    return class_edges(topic_sets(notices), lambda s, a, b: s / (a + b - s), "same_topic").filter(F.col("weight") >= least)


def contract_edges(notices: DataFrame) -> DataFrame:
    """Letters under one contract: an edge from the smallest id to each other; weight 0.9."""
    sets = _sets(notices, F.array(F.lower("contract_ref")))
    return members(sets).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit("same_contract").alias("edge_type"), F.lit(0.9).alias("weight"))


def mail_days(notices: DataFrame) -> DataFrame:
    """``doc_id, date, s, r``: letters between two parties, by their keys."""
    return notices.select("doc_id", "date", party_key(F.col("sender")).alias("s"), party_key(F.col("recipient")).alias("r")).filter("s <> '' and r <> ''")


def reply_edges(notices: DataFrame) -> DataFrame:
    """From letters to all later ones with the parties swapped; weight 0.85, directed.

    Letters of one day between the same parties in one direction are one class,
    named by its smallest id, so that two parties who write to each other
    without end have edges between days and not between all their letters;
    :func:`reply_members` tells who is in a class.
    """
    days = mail_days(notices).groupBy("s", "r", "date").agg(F.min("doc_id").alias("doc_id"))
    later = days.select(F.col("doc_id").alias("b"), F.col("date").alias("later"), F.col("s").alias("r"), F.col("r").alias("s"))
    return days.join(later, ["s", "r"]).filter("later > date").select(F.col("doc_id").alias("a"), "b", F.lit("reply_to").alias("edge_type"), F.lit(0.85).alias("weight"))


def reply_members(notices: DataFrame) -> DataFrame:
    """``id, rep, size``: each letter between two parties, the smallest id of its class and the number of letters there."""
    own = mail_days(notices)
    return own.join(own.groupBy("s", "r", "date").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), ["s", "r", "date"]).select(F.col("doc_id").alias("id"), "rep", "size")


def chronological_edges(notices: DataFrame) -> DataFrame:
    """From each letter of a party to its next one; weight 0.5, directed, once a pair."""
    parties = notices.filter("date is not null").select("doc_id", "date", F.explode(F.array_distinct(F.array(party_key(F.col("sender")), party_key(F.col("recipient"))))).alias("party")).filter("party <> ''")
    after = F.lead("doc_id").over(Window.partitionBy("party").orderBy("date", "doc_id"))
    return parties.select(F.col("doc_id").alias("a"), after.alias("b")).filter("b is not null").distinct().select("a", "b", F.lit("chronological_next").alias("edge_type"), F.lit(0.5).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its inverse, once."""
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def trace(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of each start ``start``, with the least number of steps.

    One join and one anti-join a level; only the frontier is joined.
    """
    ways = stash(both_ways(edges), "graph-ways")
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(ways, front["node"] == ways["a"]).select("start", F.col("b").alias("node")).distinct()
        front = stash(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(level)), "graph-front")
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, pairs: DataFrame, depth: int = 3) -> DataFrame:
    """A shortest way between the ends of each of ``pairs(start, goal)``, whatever the edges' direction, of at most ``depth + 1`` steps.

    The frontier of every pair grows a level at a time with the first of the
    equally short ways to each node, in order of the nodes; pairs that are
    settled take no further part. Without a way there is no row.

    Returns ``start, goal, path`` with both ends in the path.
    """
    ways = stash(both_ways(edges), "graph-ways")
    front = pairs.select("start", "goal").distinct().select("start", "goal", F.col("start").alias("node"), F.array("start").alias("path"))
    done = front.filter("start = goal").select("start", "goal", "path")
    front = stash(front.filter("start <> goal"), "graph-front")
    seen = front.select("start", "goal", "node")
    for _ in range(depth + 1):
        step = front.join(ways, front["node"] == ways["a"]).select("start", "goal", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        step = step.groupBy("start", "goal", "node").agg(F.min("path").alias("path"))
        step = stash(step.join(seen, ["start", "goal", "node"], "left_anti"), "graph-front")
        found = step.filter("node = goal").select("start", "goal", "path")
        done = done.unionByName(found)
        front = stash(step.join(found.select("start", "goal"), ["start", "goal"], "left_anti"), "graph-front")
        seen = seen.unionByName(front.select("start", "goal", "node"))
    return done


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("in_degree"))


def neighbours(edges: DataFrame, node: int, least: float = 0.0, k: int = 10) -> DataFrame:
    """The heaviest edges at a node."""
    both = edges.select("a", "b", "weight", "edge_type").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "edge_type"))
    return both.filter((F.col("a") == node) & (F.col("weight") >= least)).groupBy("b").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "b").limit(k)


def clusters(notices: DataFrame) -> DataFrame:
    """A cluster name for each letter: its pair of parties if that has two letters, else its project, contract, first topic or the rest, each of at least two."""
    keyed = notices.select(
        "doc_id",
        F.concat_ws(" / ", F.array_sort(F.array(party_key(F.col("sender")), party_key(F.col("recipient"))))).alias("pair"),
        F.lower("project").alias("project"),
        F.lower("contract_ref").alias("contract"),
        F.try_element_at(F.array_sort("topics"), F.lit(1)).alias("topic"),
    )
    left, parts = keyed, []
    for kind in ("pair", "project", "contract", "topic"):
        many = left.groupBy(kind).agg(F.count("*").alias("n")).filter("n > 1").select(kind)
        parts.append(left.join(many, kind, "left_semi").select("doc_id", F.lit(kind).alias("kind"), F.col(kind).alias("name")))
        left = left.join(many, kind, "left_anti")
    out = left.select("doc_id", F.lit("rest").alias("kind"), F.lit("rest").alias("name"))
    for p in parts:
        out = out.unionByName(p)
    return out
