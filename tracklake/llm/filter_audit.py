"""Filter interaction audit: what each filter removes at each place of each order of the filters.

A document is reduced to the set of filters that it fails, so that a part of the corpus is at most 2^k counts. The sets of
filters already applied form a lattice; applying one more filter is an edge. A pass up the lattice counts the orders that
reach each state, a pass down those that go on from it. An edge removes the same documents in every order that takes it:
weighted by the orders through it, its removals add up to the filter's Shapley value, and each order's steps are read from
the edges on its way.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import let, words

FILTERS = "ABCDE"
#: k! orders of k filters are listed one by one.
MOST_FILTERS = 8
EDGE = "array<struct<state:int,filter:int,through:bigint>>"
STEP = "array<struct<filter_order:string,step:int,state:int,filter:int>>"


def lattice(k: int) -> tuple[list[int], list[int]]:
    """Orders that reach each set of k filters (a bit each), and orders of the rest that lead from it to the whole set."""
    states = range(1 << k)
    forward, backward = [0] * len(states), [0] * len(states)
    forward[0] = backward[-1] = 1
    for s in states:
        for f in (f for f in range(k) if not s >> f & 1):
            forward[s | 1 << f] += forward[s]
    for s in reversed(states):
        for f in (f for f in range(k) if not s >> f & 1):
            backward[s] += backward[s | 1 << f]
    return forward, backward


def all_edges(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders through the edge) of the lattice."""
    forward, backward = lattice(k)
    return [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def all_steps(names: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """(filter_order, step from 1, state before it, filter) of every order."""
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return out


def constant(rows: list[tuple], kind: str, *names: str) -> Column:
    """Rows as an array of structs: a table whose size the number of filters fixes."""
    return F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), kind)


def set_counts(df: DataFrame, fails: dict[str, Column], part: Column, marks: dict[str, Column]) -> DataFrame:
    """(part, mask, n, one count for each mark): documents by the set of filters that they fail. Tasks count before the shuffle."""
    mask = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails.values())), F.lit(0))
    return df.groupBy(part.alias("part"), mask.cast("int").alias("mask")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(m) for m, c in marks.items()])


def audit(counts: DataFrame, names: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """A row for each part, order of the filters and step, from set_counts (further rows of a part and mask add up).

    kept, removed, redundant (fails the filter, gone before), unique_fails (fails this filter alone), lost_<mark> for each
    mark (removed here and marked) and shapley (removals of the filter summed over all orders). Every part has all rows.
    """
    if len(names) > MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"{MOST_FILTERS} filters of different names at most, got {names}")
    bit = F.expr("shiftleft(1, filter)")
    edge = counts.withColumn("e", F.explode(constant(all_edges(len(names)), EDGE, "state", "filter", "through"))).select("*", "e.*").drop("e")
    fails = F.col("mask").bitwiseAND(bit) != 0
    alive = F.col("mask").bitwiseAND(F.col("state")) == 0
    total = lambda on, of="n": F.coalesce(F.sum(F.when(on, F.col(of))), F.lit(0)).cast("long")
    edges = edge.groupBy("part", "state", "filter", "through").agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(fails & ~alive).alias("redundant"), total(F.col("mask") == bit).alias("unique_fails"),
        *[total(alive & fails, m).alias(f"lost_{m}") for m in marks],
    )
    value = edges.groupBy("part", "filter").agg(F.sum(F.col("through") * F.col("removed")).alias("shapley"))
    steps = counts.select("part").distinct().withColumn("s", F.explode(constant(all_steps(names), STEP, "filter_order", "step", "state", "filter"))).select("part", "s.*")
    out = steps.join(edges.drop("through"), ["part", "state", "filter"]).join(value, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"lost_{m}" for m in marks], "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails each of the four filters that look at the text alone: short, repetitive, shouting, marked up."""
    t = F.coalesce(text, F.lit(""))
    ws = words(text)
    return {
        "A": F.size(ws) < 100, "B": let(ws, lambda w: 100 * F.size(F.array_distinct(w)) < 80 * F.size(w)),
        "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 10 * F.length(t), "D": t.rlike(r"[#$%&*|]"),
    }


def first_copies(df: DataFrame, doc_id: str, key: str, keep: list[str]) -> DataFrame:
    """Rows of df summed by (key, *keep) with n, and n_first: how many of them have no smaller id of the same key.

    Groups of copies are counted before they meet: by id, then by what is kept; only those counts see the key's smallest id.
    A null id is smaller than no id and no id is smaller than it.
    """
    by_id = df.groupBy(key, *keep, doc_id).agg(F.count("*").alias("n"))
    known = F.col(doc_id).isNotNull()
    summed = by_id.groupBy(key, *keep).agg(
        F.sum("n").alias("n"), F.min(doc_id).alias("least"), F.coalesce(F.min_by("n", F.when(known, F.col(doc_id))), F.lit(0)).alias("n_least"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_unknown"),
    )
    least = summed.groupBy(key).agg(F.min("least").alias("least_of_key"))
    firsts = F.col("n_unknown") + F.when(F.col("least") == F.col("least_of_key"), F.col("n_least")).otherwise(F.lit(0))
    return summed.join(least, key).withColumn("n_first", firsts).select(key, *keep, "n", "n_first")


def filter_audit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for the filters A to E.

    A: under 100 words; B: under 80 % distinct words; C: over 10 % of A-Z; D: holds one of #$%&*|; E: identical to the text
    of a smaller id anywhere in the table. part is the language, null as the empty string. A null text is empty: it fails A
    and is a copy of every other null or empty text. Rows of one id and text are no copies of each other; a null id is
    neither copy nor original. An id counts as good or toxic if any of its labels says so; a null id has no label. An empty
    table has no parts. Other columns of df are not read.
    """
    t = F.col(text)
    each = text_filters(t)
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(each.values())), F.lit(0)).cast("int")
    digest = F.unhex(F.sha2(F.coalesce(t, F.lit("")), 256))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows without an id are dealt by their text, so that they do not meet in one task.
    at = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.hex("digest")))
    marked = docs.withColumn("_at", at).join(marks.select(F.col("doc_id").cast("string").alias("_at"), "good", "toxic"), "_at", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    copies = first_copies(marked.select("doc_id", "part", "mask", "digest", *flags), "doc_id", "digest", ["part", "mask", "good", "toxic"])
    both = copies.select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("n_first").alias("n")), F.struct(F.col("mask").bitwiseOR(1 << len(each)).alias("mask"), (F.col("n") - F.col("n_first")).alias("n")),
    )).alias("x")).select("part", "good", "toxic", "x.*")
    counts = both.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col(m), F.col("n"))), F.lit(0)).alias(m) for m in ("good", "toxic")])
    out = audit(counts, FILTERS, ("good", "toxic"))
    return out.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"}).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
