"""URL filters: rules of host and path first, gradient-boosted trees on lexical features for what no rule decides.

All of it is built-in functions. Each url becomes a vector of small bins: lengths, depth, digit ratio, entropy, parameters
and how often its host's suffixes are seen and blocked. Trees are grown from sums of gradients by (leaf, feature, bin), one
aggregate for each level, which come to the driver as a few thousand numbers whatever the table's size. A tree splits all
leaves of a level alike, so that a leaf's number is the bits of its comparisons.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import cut, let

BINS = 32
#: Suffixes are counted in so many hashed buckets: a table of a fixed size, whatever hosts there are.
BUCKETS = 1 << 16
FEATURES = ("length", "host_length", "path_length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "longest_label", "suffix_pages", "suffix_blocked", "last_label_blocked")
TREES, DEPTH, RATE, SMOOTHING = 20, 3, 0.3, 1.0
#: Labelled urls that the trees are fitted on; of more, those with the smallest hashes.
MOST_ROWS = 1_000_000
UNIT = 1_000_000  # gradients are summed as whole numbers, so that the order of rows changes nothing


class Rule(NamedTuple):
    action: str  # block or allow
    host: str
    path: str


class Tree(NamedTuple):
    features: list[int]
    cuts: list[int]  # a bit is set where the bin is above the cut
    leaves: list[float]


class Model(NamedTuple):
    base: float  # log odds of block
    trees: list[Tree]


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query): after the first ://, host A-Z lower-cased; all empty if the url is null or has no ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits a host or a domain above it, and the start of the path; null: none."""
    rule = action = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):  # the last one to fit wins
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule, action = F.when(fits, F.lit(r.host + r.path)).otherwise(rule), F.when(fits, F.lit(r.action)).otherwise(action)
    return rule, action


def entropy(text: Column) -> Column:
    """Bits a character: equal characters lie one after the other once sorted, so one fold counts them all."""
    spread = lambda run: run * F.log2(F.greatest(run, F.lit(1.0)))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        return F.when(a["c"] == c, F.struct(a["c"].alias("c"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("run"), (a["sum"] + spread(a["run"])).alias("sum")))

    n = F.length(text)
    total = F.aggregate(F.sort_array(F.split(text, "")), start, step, lambda a: a["sum"] + spread(a["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))


def bin_of(value: Column) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(BINS - 1)).cast("int")


def lexical(df: DataFrame, url: str, keep: list[str]) -> DataFrame:
    """keep, host, path, the two suffix buckets and the bins of all features but those of suffixes."""
    host, path, query = split_url(F.col(url))
    count = lambda text, chars: F.length(text) - F.length(F.regexp_replace(text, chars, ""))
    rows = df.select(*keep, host.alias("host"), path.alias("path"), query.alias("_query")).withColumn("_all", F.concat_ws("", "host", "path", "_query"))
    labels = F.split("host", r"\.")
    bucket = lambda n: F.pmod(F.xxhash64(F.lit(n), F.array_join(F.slice(F.reverse(labels), 1, n), ".")), F.lit(BUCKETS)).cast("int")
    bins = [
        F.length("_all") / 8, F.length("host") / 2, F.length("path") / 4, F.size(F.array_remove(F.split("path", "/"), "")), (BINS - 1) * count(F.col("_all"), "[0-9]+") / F.greatest(F.length("_all"), F.lit(1)),
        5 * entropy(F.col("_all")), F.size(F.array_remove(F.split("_query", "&"), "")), count(F.col("host"), "-+"), F.size(labels), F.array_max(F.transform(labels, lambda x: F.length(x))),
    ]
    return rows.select(*keep, "host", "path", bucket(2).alias("_two"), bucket(1).alias("_one"), F.array(*map(bin_of, bins)).alias("_bins"))


def suffix_counts(rows: DataFrame, label: str) -> DataFrame:
    """(bucket, n, labelled, blocked) of the buckets of hosts' last label and last two; the latter two by fold.

    BUCKETS rows at most. A host is in one fold with all its urls.
    """
    fold = lambda k: F.col(label).isNotNull() & (F.pmod(F.xxhash64("host"), F.lit(2)) == k)
    each = rows.select(F.explode(F.array("_two", "_one")).alias("bucket"), label, "host")
    per_fold = lambda f: F.array(f(0), f(1))
    return each.groupBy("bucket").agg(
        F.count("*").alias("n"), per_fold(lambda k: F.count_if(fold(k))).alias("labelled"), per_fold(lambda k: F.count_if(fold(k) & (F.col(label) == 1))).alias("blocked"),
    )


def vectors(rows: DataFrame, suffixes: DataFrame, label: str | None) -> DataFrame:
    """rows with x, the bins of all FEATURES. With a label, a url's suffix rates are those of the other fold's hosts."""
    own = F.pmod(F.xxhash64("host"), F.lit(2)).cast("int")
    counted = (lambda c: F.get(c, 1 - own)) if label else (lambda c: F.get(c, F.lit(0)) + F.get(c, F.lit(1)))
    rate = (BINS - 1) * (counted(F.col("blocked")) + 1) / (counted(F.col("labelled")) + 2)
    seen = suffixes.select("bucket", bin_of(2 * F.log2(F.col("n"))).alias("_pages"), "labelled", "blocked")
    for place in ("_two", "_one"):
        by = F.broadcast(seen.select(F.col("bucket").alias(place), F.col("_pages").alias(f"{place}_pages"), "labelled", "blocked"))
        rows = rows.join(by, place, "left").withColumn(f"{place}_rate", bin_of(F.coalesce(rate, F.lit((BINS - 1) / 2)))).drop("labelled", "blocked")
    found = F.array(F.coalesce("_two_pages", F.lit(0)), "_two_rate", "_one_rate")
    return rows.withColumn("x", F.concat("_bins", found)).drop("_bins", "_two", "_one", "_two_pages", "_one_pages", "_two_rate", "_one_rate")


def margin(x: Column, model: Model) -> Column:
    """Log odds of block: base and the leaves that x falls into."""
    if not model.trees:
        return F.lit(model.base)
    trees = F.from_json(F.lit(json.dumps([t._asdict() for t in model.trees])), "array<struct<features:array<int>,cuts:array<int>,leaves:array<double>>>")
    return F.aggregate(trees, F.lit(model.base), lambda a, t: a + F.get(t["leaves"], leaf(x, t["features"], t["cuts"])))


def leaf(x: Column, features: Column, cuts: Column) -> Column:
    above = F.zip_with(features, cuts, lambda f, c: (F.get(x, f) > c).cast("int"))
    return F.aggregate(above, F.lit(0), lambda a, b: 2 * a + b)


def best_split(sums: dict[tuple[int, int], list[tuple[float, float]]], leaves: int, features: int) -> tuple[int, int, float]:
    """(feature, cut, gain) of the split of all leaves at once with the largest gain; ties go to the first. sums: (g, h) of each bin by (leaf, feature)."""
    score = lambda g, h: g * g / (h + SMOOTHING)
    best = (0, BINS - 1, 0.0)
    for f in range(features):
        by_leaf = [sums.get((i, f), [(0.0, 0.0)] * BINS) for i in range(leaves)]
        whole = [(sum(g for g, _ in bins), sum(h for _, h in bins)) for bins in by_leaf]
        low = [(0.0, 0.0)] * leaves
        for c in range(BINS - 1):
            low = [(g + bins[c][0], h + bins[c][1]) for (g, h), bins in zip(low, by_leaf, strict=True)]
            gain = sum(score(*a) + score(t[0] - a[0], t[1] - a[1]) - score(*t) for a, t in zip(low, whole, strict=True))
            if gain > best[2] + 1e-9:
                best = (f, c, gain)
    return best


def boost(examples: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Trees for examples (x, n, blocked): equal vectors counted together. A job for each level of each tree."""
    total = examples.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")).first()
    model = Model(math.log((total["blocked"] + 1) / (total["n"] - total["blocked"] + 1)), [])
    if total["blocked"] in (0, total["n"]):  # one kind of labels only: nothing to tell apart
        return model
    for _ in range(trees):
        features: list[int] = []
        cuts: list[int] = []
        p = 1 / (1 + F.exp(-margin(F.col("x"), model)))
        whole = lambda v: F.round(v * UNIT).cast("long")
        rows = examples.withColumn("p", p).select("x", whole(F.col("blocked") - F.col("n") * F.col("p")).alias("g"), whole(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"))
        for level in range(depth):
            at = leaf(F.col("x"), F.array(*map(F.lit, features)), F.array(*map(F.lit, cuts))) if features else F.lit(0)
            each = rows.select(at.alias("leaf"), "g", "h", F.posexplode("x").alias("f", "bin"))
            sums: dict[tuple[int, int], list[tuple[float, float]]] = {}
            for r in each.groupBy("leaf", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault((r["leaf"], r["f"]), [(0.0, 0.0)] * BINS)[r["bin"]] = (r["g"] / UNIT, r["h"] / UNIT)
            f, c, gain = best_split(sums, 1 << level, len(FEATURES))
            if gain <= 0:
                break
            features.append(f)
            cuts.append(c)
            tops = [sums.get((i, f), [(0.0, 0.0)] * BINS) for i in range(1 << level)]
        if not features:
            return model
        halves = [part for bins in tops[: 1 << (len(features) - 1)] for part in (bins[: cuts[-1] + 1], bins[cuts[-1] + 1 :])]
        model.trees.append(Tree(features, cuts, [RATE * sum(g for g, _ in b) / (sum(h for _, h in b) + SMOOTHING) for b in halves]))
    return model


def fit(rows: DataFrame, suffixes: DataFrame, label: str, most_rows: int = MOST_ROWS) -> Model:
    """Trees for lexical rows with a label (1 block, 0 allow, null unknown): on all that have one, or most_rows of them by hash of their host and path."""
    labelled = rows.where(F.col(label).isNotNull())
    n = labelled.count()
    part = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30)) < max(1, int(most_rows / max(n, 1) * (1 << 30)))
    chosen = vectors(labelled.where(part) if n > most_rows else labelled, suffixes, label)
    return boost(cut(chosen.groupBy("x").agg(F.count("*").alias("n"), F.sum(label).alias("blocked"))))


def url_filter(df: DataFrame, rules: list[Rule], url: str = "url", most_rows: int = MOST_ROWS) -> DataFrame:
    """df's columns but its url, and host, path, rule, verdict and score (of block, 0 to 1).

    The longest rule that fits decides; its urls are the labelled ones that the trees learn from. The trees decide the others:
    block if score is over a half. A null url, or one without ://, has an empty host and path and is judged by the trees as
    such. Repeated rows are judged alike. Without labels, or with labels of one kind, the score is the share of block among
    them. Columns host, path, rule, verdict and score of df are replaced. An empty table gives an empty result.
    """
    made = ("host", "path", "rule", "verdict", "score")
    keep = [c for c in df.columns if c != url and c not in made]
    named = df.select(F.struct(*keep).alias("_row") if keep else F.lit(None).alias("_row"), F.col(url).alias("_url"))
    rows = lexical(named, "_url", ["_row"])
    rule, action = matched(F.col("host"), F.col("path"), rules)
    rows = cut(rows.withColumns({"_rule": rule, "_action": action}).withColumn("_label", F.when(F.col("_action") == "block", 1).when(F.col("_action") == "allow", 0)))
    suffixes = cut(suffix_counts(rows, "_label"))
    model = fit(rows, suffixes, "_label", most_rows)
    scored = vectors(rows, suffixes, None).withColumn("score", let(margin(F.col("x"), model), lambda m: 1 / (1 + F.exp(-m))))
    verdict = F.coalesce("_action", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select(*([F.col("_row")[c].alias(c) for c in keep]), "host", "path", F.col("_rule").alias("rule"), verdict.alias("verdict"), "score")
