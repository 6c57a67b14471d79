"""Speaker clusters from embeddings of short spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators.intervals import pivot_split, trim_to_previous
from tracklake.operators.tracks import labels_by_first_appearance


def unit(c: str) -> object:
    """L2-normalised copy of an array column, in doubles."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / norm)


def cosine_pairs(spans: DataFrame, cluster: str = "seed_label", embedding: str = "embedding") -> DataFrame:
    """(media_id, cluster_a, cluster_b, mean_cosine) of all pairs a < b of a medium's clusters.

    The mean over member pairs is the product of the clusters' summed unit vectors over their sizes, so only cluster sums
    are joined, not members.
    """
    parts = spans.select("media_id", F.col(cluster).alias("c"), F.posexplode(unit(embedding)).alias("i", "x"))
    sums = parts.groupBy("media_id", "c", "i").agg(F.sum("x").alias("x"))
    sizes = spans.groupBy("media_id", F.col(cluster).alias("c")).agg(F.count("*").alias("n"))
    a, b = (sums.select("media_id", "i", F.col("c").alias(f"cluster_{s}"), F.col("x").alias(s)) for s in "ab")
    dots = a.join(b, ["media_id", "i"]).where("cluster_a < cluster_b").groupBy("media_id", "cluster_a", "cluster_b").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    na, nb = (sizes.select("media_id", F.col("c").alias(f"cluster_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    out = dots.join(na, ["media_id", "cluster_a"]).join(nb, ["media_id", "cluster_b"])
    return out.select("media_id", "cluster_a", "cluster_b", F.round(F.col("dot") / (F.col("n_a") * F.col("n_b")), 6).alias("mean_cosine"))


def merged(sums: np.ndarray, size: np.ndarray, seeded: np.ndarray, merge_at: float) -> np.ndarray:
    """For each cluster the one it ends in, when pairs of greatest mean cosine merge while that reaches merge_at.

    Chains of nearest neighbours: a pair that are each other's nearest may merge at once, in whatever order, since a merged
    cluster's mean cosine to a third is never above the greater of its parts'. Memory is that of the sums; a step compares
    one cluster with all. Clusters that hold a seed do not merge with one another.
    """
    sums, size, seeded = sums.astype(float).copy(), size.astype(float).copy(), seeded.copy()
    home, alive, chain = np.arange(len(size)), np.ones(len(size), bool), []
    while chain or alive.any():
        at = chain[-1] if chain else int(np.flatnonzero(alive)[0])
        chain = chain or [at]
        mean = (sums @ sums[at]) / (size * size[at])
        mean[~alive | (seeded & seeded[at])] = -np.inf
        mean[at] = -np.inf
        best = int(np.argmax(mean))
        if len(chain) > 1 and mean[chain[-2]] >= mean[best]:
            best = chain[-2]
        if mean[best] < merge_at:  # nothing will come nearer
            alive[at] = False
            chain.pop()
        elif len(chain) > 1 and best == chain[-2]:
            keep, gone = min(at, best), max(at, best)
            sums[keep] += sums[gone]
            size[keep] += size[gone]
            seeded[keep] |= seeded[gone]
            alive[gone], home[gone] = False, keep
            del chain[-2:]
        else:
            chain.append(best)
    while (home[home] != home).any():
        home = home[home]
    return home


def agglomerate(labels: np.ndarray, vectors: np.ndarray, merge_at: float = 0.3, least: int = 3, absorb_at: float = 0.0) -> np.ndarray:
    """Clusters of one medium's spans, numbered by first appearance.

    Spans labelled -1 start alone, others in their seeded cluster. The pair of greatest mean cosine merges while it reaches
    merge_at; two seeded clusters, and what holds them, never merge. Then clusters under `least` spans join the nearest
    large one at absorb_at or more. Memory grows with the spans, not with their pairs.
    """
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    alone = labels < 0
    start = np.where(alone, labels.max(initial=-1) + 1 + np.cumsum(alone), labels)
    names, first = np.unique(start, return_inverse=True)  # seeded clusters come first
    sums = np.zeros((len(names), v.shape[1]))
    np.add.at(sums, first, v)
    home = merged(sums, np.bincount(first), names <= labels.max(initial=-1), merge_at)
    ends, final = np.unique(home[first], return_inverse=True)
    size, total = np.bincount(final), np.zeros((len(ends), v.shape[1]))
    np.add.at(total, final, v)
    seeded = np.zeros(len(ends), bool)
    np.logical_or.at(seeded, final, ~alone)
    large, into = np.flatnonzero(size >= least), np.arange(len(ends))
    for c in np.flatnonzero(size < least) if len(large) else ():
        mean = total[large] @ total[c] / (size[large] * size[c])
        mean[seeded[large] & seeded[c]] = -np.inf
        if mean.max() >= absorb_at:
            into[c] = large[mean.argmax()]
    order: dict[int, int] = {}
    return np.array([order.setdefault(int(x), len(order)) for x in into[final]], int)


def agglomerate_clusters(spans: DataFrame, merge_at: float = 0.3, least: int = 3, absorb_at: float = 0.0) -> DataFrame:
    """spans (media_id, seq, start_ms, end_ms, seed_label, embedding) with `cluster`; a medium's spans, as long as it is, are a group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        clusters = agglomerate(pdf["seed_label"].to_numpy(), np.array(pdf["embedding"].tolist(), float), merge_at, least, absorb_at)
        return pd.DataFrame({"media_id": pdf["media_id"], "seq": pdf["seq"], "start_ms": pdf["start_ms"], "end_ms": pdf["end_ms"], "cluster": clusters})

    return spans.select("media_id", "seq", "start_ms", "end_ms", "seed_label", "embedding").groupBy("media_id").applyInPandas(run, "media_id long, seq long, start_ms long, end_ms long, cluster long")


def seed_labels(spans: DataFrame, dense_at: float = 0.6, least: int = 3) -> DataFrame:
    """spans with seed_label, made in each medium on its own: its dense groups, in which spans are dense_at alike on average.

    Groups of under `least` spans are noise, -1. Media of one or two spans are one cluster. There is no limit of groups.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        found = agglomerate(np.full(len(pdf), -1), np.array(pdf["embedding"].tolist(), float), dense_at, 1)
        few = np.bincount(found)[found] < least
        return pd.DataFrame({"media_id": pdf["media_id"], "seq": pdf["seq"], "_k": 0 if len(pdf) <= 2 else np.where(few, -1, found)})

    made = spans.select("media_id", "seq", "embedding").groupBy("media_id").applyInPandas(run, "media_id long, seq long, _k int")
    return spans.join(made, ["media_id", "seq"]).withColumnRenamed("_k", "seed_label")


def diarize(spans: DataFrame, min_ms: int = 200) -> DataFrame:
    """Turns (media_id, speaker_label, start_ms, end_ms) from seeded spans: clusters, label runs, disjoint, not too short."""
    runs = pivot_split(agglomerate_clusters(spans), "cluster")
    rounded = runs.select("media_id", "cluster", F.bround("start_ms").cast("long").alias("start_ms"), F.bround("end_ms").cast("long").alias("end_ms"))
    turns = labels_by_first_appearance(trim_to_previous(rounded), "cluster", ["start_ms", "end_ms"])
    return turns.where(F.col("end_ms") - F.col("start_ms") >= min_ms).select("media_id", "speaker_label", "start_ms", "end_ms")
