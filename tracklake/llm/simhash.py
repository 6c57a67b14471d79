"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most two bits agree, in one of two 32-bit segments, in all bits but one at most. Each
distinct fingerprint is indexed under its 64 segment variants with one bit struck out; equal variants join, and the
whole fingerprints are compared. Only distinct fingerprints are indexed, so exact copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import cut, small_batches

#: A variant shared by more fingerprints than this is split once more before its members are compared.
WIDE = 500


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, as a signed integer; a text without words has 0."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z change, only ASCII space splits
    if not ws:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    grams = zip(*(ws[k:] for k in range(shingle)), strict=False) if len(ws) >= shingle else [ws]
    hashes = np.fromiter(map(digest, map(b" ".join, grams)), np.uint64)
    set_in, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        set_in += np.unpackbits(hashes[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """df with its text column replaced by the fingerprint (long)."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fps], [*keep, out])

    return df.mapInArrow(run, df.select(*keep).withColumn(out, F.lit(0).cast("long")).schema)


def links(fps: DataFrame, wide: int = WIDE) -> DataFrame:
    """All pairs u < v of distinct fingerprints (column fp) at one or two differing bits."""
    keys = F.expr(
        "flatten(transform(sequence(0, 1), s -> transform(sequence(0, 31), j -> "
        "shiftleft(cast(s * 32 + j as bigint), 32) | (shiftrightunsigned(fp, 32 * s) & 4294967295 & ~shiftleft(1L, j)))))"
    )
    index = fps.select("fp").distinct().select("fp", F.explode(keys).alias("key"))
    sized = index.repartition("key").withColumn("n", F.count("*").over(Window.partitionBy("key")))
    # The bit struck out is the one that differs, or, if the segment is equal, bit 0: each pair meets once a segment.
    meets = F.expr(
        "u < v and bit_count(u ^ v) <= 2 and (shiftrightunsigned(u ^ v, cast(32 * (key >> 37) as int)) & 4294967295) in "
        "(shiftleft(1L, cast((key >> 32) & 31 as int)), case when ((key >> 32) & 31) = 0 then 0L end)"
    )

    def pairs(rows: DataFrame, *on: str) -> DataFrame:
        a, b = rows.select(F.col("fp").alias("u"), *on), rows.select(F.col("fp").alias("v"), *on)
        return a.join(b, list(on)).where(meets).select("u", "v")

    # Wide variants: one of three parts of the other segment must be equal as well.
    other = F.expr("shiftrightunsigned(fp, cast(32 * (1 - (key >> 37)) as int)) & 4294967295")
    parts = F.array(*[F.struct(F.lit(p).alias("p"), F.expr(f"shiftrightunsigned(o, {11 * p}) & 2047").alias("x")) for p in range(3)])
    split = sized.where(F.col("n") > wide).withColumn("o", other).select("fp", "key", F.explode(parts).alias("s")).select("fp", "key", "s.p", "s.x")
    return pairs(sized.where(F.col("n").between(2, wide)), "key").unionByName(pairs(split, "key", "p", "x")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node u but the roots: alternating large-star and small-star until nothing changes."""
    edges = cut(edges.select("u", "v"))
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state["n"] == 0 or state == seen:
            return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("root"))
        seen = state
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())


def grouped(df: DataFrame, doc_id: str, text: str, shingle: int, wide: int, **more: Column) -> DataFrame:
    """doc_id, fp, root (the group's smallest fingerprint), component_id and the columns of `more` for each row of df."""
    docs = cut(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[c.alias(name) for name, c in more.items()]), shingle=shingle))
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = nodes.join(components(links(nodes, wide)).withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = cut(roots)
    named = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return docs.join(cut(roots.join(named, "root").select("fp", "root", "component_id")), "fp").select("doc_id", "fp", "root", "component_id", *more)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, wide: int = WIDE) -> DataFrame:
    """One row per row of df: doc_id, fp (long) and component_id, the smallest doc_id reachable over links.

    Documents link when their fingerprints differ in two bits at most, equal fingerprints included; texts without words
    share fingerprint 0. Null ids are fingerprinted and grouped but never name a component (null if no other id is
    there). Repeated rows each get their row. An empty table gives an empty result. Other columns are not read.
    """
    return grouped(df, doc_id, text, shingle, wide).select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one document of each near-duplicate group: the one with the smallest id; columns as in df.

    A document is an id and a text: rows of one id with different texts are judged apart, and if they are near each other one
    of them stays; rows that repeat both count as one. A group of null ids alone keeps a row for each distinct text.
    """
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # A row of the group's smallest id stays; of several such texts the one of the smallest hash. Counted before groups meet.
    rows = cut(grouped(df, doc_id, text, 3, WIDE, th=hashed).groupBy("root", "component_id", "doc_id", "th").agg(F.count("*").alias("n")))
    first = rows.where(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(F.min("th").alias("first"))
    stays = F.col("component_id").isNull() | (F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)) & (F.col("th") == F.col("first")))
    gone = rows.join(first, "root", "left").where(~stays).select(F.col("doc_id").alias("_tl_id"), F.col("th").alias("_tl_th"))
    kept = df.withColumn("_tl_of", hashed).join(gone, F.col(doc_id).eqNullSafe(F.col("_tl_id")) & (F.col("_tl_of") == F.col("_tl_th")), "left_anti")
    w = Window.partitionBy(doc_id, "_tl_of").orderBy(F.col(text).asc_nulls_last())
    return kept.withColumn("_tl_nth", F.row_number().over(w)).where("_tl_nth = 1").drop("_tl_nth", "_tl_of")
