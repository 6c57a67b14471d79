"""Substring dedup with a count-min prefilter.

Windows of `span` words that repeat are found in three passes over the texts:
1. Every window has an anchor, the leftmost smallest of its k-word hashes, which depends on the window's words alone; two
   places of a window have two anchors' places. Anchors are counted in count-min sketches, one for each range (shard) of
   their hashes: each partition gives its own sparse sketch of each shard, the anchors it holds and whether once or more;
   a shard's sketches are merged, row by row of CELLS cells, and an anchor's estimate, the least of its cells' counts, is
   never below its count. There is a shard for every LOAD anchors or so, so the share of anchors that are there once and
   are estimated as repeated stays under 1 % whatever the corpus holds.
2. The anchors estimated as repeated come to the texts again: as a broadcast bitmap if MOST_BITS hold them, else by a join.
   Their windows, each once a document, are grouped exactly, by a 128-bit key, for their smallest doc_id.
3. Each document learns for which windows it is that smallest one; a candidate window is a repeat if the document is not,
   or if the window stands earlier in it. Words under repeats are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import cut, small_batches

SPAN = 20
K = 10
ANCHOR_BYTES = 36  # of text to an anchor: words of about 6 bytes, an anchor in 6
LOAD = 1 << 18  # anchors of a shard, about
CELLS = 1 << 22  # of each of the two rows of a shard's sketch
FEWEST_SHARDS = 8  # as a power of 2
HELD = 2_000_000  # anchors that a task gathers before it gives its sketch of them
MOST_BITS = 1 << 30  # of the broadcast bitmap of repeated anchors (128 MB)
BITS_EACH = 12  # of it for each anchor, at least
LAST_ID = (1 << 63) - 1  # what a null doc_id counts as

_FACTORS = [np.array([pow(b, 2 * i + 1, 1 << 64) | 1 for i in range(64)], np.uint64) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: white space is space and 09 to 0D


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of each n consecutive words."""
    m = len(hashes) - n + 1
    out = np.zeros(max(0, m), np.uint64)
    for i in range(n if m > 0 else 0):
        out += hashes[i : i + m] * _FACTORS[seed][i]
    return mixed(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_anchors(hashes: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and each window's anchor as an index of them."""
    grams = rolling(hashes, k, 0)
    w = span - k + 1
    m = len(grams) - w + 1
    least = grams[:m].copy()
    for i in range(1, w):
        np.minimum(least, grams[i : i + m], out=least)
    at = np.zeros(m, np.int64)
    for i in range(w - 1, -1, -1):
        at[grams[i : i + m] == least] = i
    return grams, at + np.arange(m)


def shard_bits(text_bytes: int) -> int:
    """As a power of 2, the shards for a corpus of so many bytes: LOAD anchors in each, or fewer."""
    return max(FEWEST_SHARDS, int(np.ceil(np.log2(1 + text_bytes / ANCHOR_BYTES / LOAD))))


def cells_of(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's cell in each row of its shard's sketch."""
    return (anchors & np.uint64(CELLS - 1)).astype(np.int64), (mixed(anchors * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(CELLS - 1)).astype(np.int64)


def estimated_repeated(once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Distinct anchors of estimate 2 or more in the merged sketch of one shard.

    once, twice: the anchors of each partition's sketch, laid end to end; those under twice count 2.
    """
    anchors = np.concatenate([once, twice])
    weights = np.concatenate([np.ones(len(once)), np.full(len(twice), 2.0)])
    estimate = np.full(len(anchors), np.inf)
    for cell in cells_of(anchors):
        np.minimum(estimate, np.bincount(cell, weights, CELLS)[cell], out=estimate)
    return np.unique(anchors[estimate >= 2])


def repeated_anchors(texts: DataFrame, bits: int, span: int = SPAN, k: int = K) -> DataFrame:
    """(anchor long): all anchors that stand in two places or more, and the few that the sketches overestimate.

    bits: shards as a power of 2. Of an anchor's 8 bytes those that are alike in its shard are not sent.
    """
    sent = 8 - bits // 8

    def packed(h: np.ndarray) -> bytes:
        return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :sent].tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def flush() -> pa.RecordBatch:
            anchor, n = np.unique(np.concatenate(found), return_counts=True)  # sorted, so shards lie one after the other
            shard = anchor >> np.uint64(64 - bits)
            edges = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1, append=-1))
            rows = [(int(shard[i]), packed(anchor[i:j][n[i:j] == 1]), packed(anchor[i:j][n[i:j] > 1])) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["shard", "once", "twice"])

        for b in batches:
            for t in b.column(0):
                words = split_words(t.as_py())
                if len(words) >= span:
                    grams, at = window_anchors(word_hashes(words), span, k)
                    found.append(grams[np.unique(at)])
                    held += len(found[-1])
            if held > HELD:
                yield flush()
                found, held = [], 0
        if held:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        top = np.uint64(int(pdf["shard"].iloc[0]) << (64 - bits))
        mask = np.uint64((1 << (64 - bits)) - 1)

        def unpacked(parts: pd.Series) -> np.ndarray:
            raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, sent)
            whole = np.zeros((len(raw), 8), np.uint8)
            whole[:, :sent] = raw
            return (whole.reshape(-1).view("<u8") & mask) | top

        return pd.DataFrame({"anchor": estimated_repeated(unpacked(pdf["once"]), unpacked(pdf["twice"])).view(np.int64)})

    return texts.mapInArrow(count, "shard long, once binary, twice binary").groupBy("shard").applyInPandas(merge, "anchor long")


def anchor_bitmap(anchors: DataFrame, n: int) -> bytes:
    """A Bloom filter of two bits an anchor, put together by Spark from pieces of 4 KB: n times 12 to 24 bits, rounded up."""
    size = 1 << max(20, int(np.ceil(np.log2(max(1, n) * BITS_EACH))))
    places = F.array(*[F.shiftrightunsigned("anchor", s).bitwiseAND(F.lit(size - 1)) + 1 for s in (0, 32)])
    marks = anchors.select(F.explode(places).alias("m"))
    pieces = marks.groupBy(F.bitmap_bucket_number("m").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("m")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in pieces.toLocalIterator():  # positions count from 1, so do pieces
        out[(r["piece"] - 1) * 4096 : r["piece"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def in_bitmap(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    hit = np.ones(len(anchors), bool)
    for s in (0, 32):
        at = ((anchors >> np.uint64(s)) & np.uint64(bits.size * 8 - 1)).astype(np.int64)
        hit &= (bits[at >> 3] >> (at & 7)) & 1 == 1
    return hit


def candidates(words: list[bytes], known: Callable[[np.ndarray], np.ndarray], span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and two 64-bit keys of the windows whose anchors are known as repeated."""
    none = np.zeros(0, np.uint64)
    if len(words) < span:
        return none.astype(np.int64), none, none
    hashes = word_hashes(words)
    grams, at = window_anchors(hashes, span, k)
    own, back = np.unique(at, return_inverse=True)
    starts = np.flatnonzero(known(grams[own])[back])
    if not len(starts):
        return starts, none, none
    return starts, rolling(hashes, span, 0)[starts], rolling(hashes, span, 1)[starts]


def with_anchors(docs: DataFrame, anchors: DataFrame, span: int, k: int) -> DataFrame:
    """docs with `known`, those of a row's anchors that are repeated ones: the way for more of them than a bitmap holds."""
    docs = cut(docs.withColumn("row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, t in zip(b.column("row").to_numpy(), b.column("text"), strict=True):
                words = split_words(t.as_py())
                if len(words) >= span:
                    grams, at = window_anchors(word_hashes(words), span, k)
                    found.append(np.unique(grams[np.unique(at)]))
                    rows.append(np.full(len(found[-1]), i))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(found).view(np.int64))], ["row", "anchor"])

    each = docs.select("row", "text").mapInArrow(run, "row long, anchor long").join(anchors, "anchor", "left_semi")
    return cut(docs.join(each.groupBy("row").agg(F.collect_list("anchor").alias("known")), "row", "left").drop("row"))


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, k: int = K, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, kept (the words left, joined by a space).

    A word goes if a window of span words over it also starts earlier: in a smaller doc_id, or before in the same text.
    Null and empty texts have no words. Null ids come after all others, in the order of a hash of their texts; those of
    equal texts, and rows that repeat an id, count as one document: each is held against smaller ids and itself. An empty
    table stays empty. doc_id is an integer; other columns are not read. More repeated anchors than most_bits hold are
    joined instead of broadcast, with the same result.
    """
    if not 1 <= k <= span <= 64:
        raise ValueError("1 <= k <= span <= 64 is needed")
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = cut(repeated_anchors(docs.select("text"), shard_bits(size), span, k))
    n = anchors.count()
    joined = n * BITS_EACH > most_bits
    bits = spark.sparkContext.broadcast(b"" if joined else anchor_bitmap(anchors, n))
    # `known`: a row's own repeated anchors, or null where the bitmap tells
    docs = with_anchors(docs, anchors, span, k) if joined else docs.withColumn("known", F.lit(None).cast("array<bigint>"))
    unnamed = F.when(F.col("doc_id").isNull(), F.xxhash64("text").bitwiseAND(F.lit(LAST_ID)).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))  # tells apart documents without an id
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("key"), unnamed.alias("key2"), "text", "known")

    def knows(own: pa.Scalar) -> Callable[[np.ndarray], np.ndarray]:
        if joined:
            listed = own.values.to_numpy().view(np.uint64) if own.is_valid else np.zeros(0, np.uint64)
            return lambda anchors: np.isin(anchors, listed)
        seen = np.frombuffer(bits.value, np.uint8)
        return lambda anchors: in_bitmap(seen, anchors)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, key2, t, own in zip(b.column("key").to_pylist(), b.column("key2").to_pylist(), b.column("text"), b.column("known"), strict=True):
                _, k1, k2 = candidates(split_words(t.as_py()), knows(own), span, k)
                k1, first = np.unique(k1, return_index=True)
                out.append((np.full(len(k1), key, np.int64), np.full(len(k1), key2, np.int64), k1.view(np.int64), k2[first].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "key2", "k1", "k2"])

    first = docs.mapInArrow(keys, "key long, key2 long, k1 long, k2 long").groupBy("k1", "k2").agg(F.min("key").alias("key"), F.min("key2").alias("key2"))
    owned = first.groupBy("key", "key2").agg(F.collect_list("k1").alias("owned"))  # key2 is 0 unless all of them have no id
    met = docs.join(owned, ["key", "key2"], "left").select("doc_id", "text", "known", "owned")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for t, known, own in zip(b.column("text"), b.column("known"), b.column("owned"), strict=True):
                words = split_words(t.as_py())
                starts, k1, _ = candidates(words, knows(known), span, k)
                gone = np.zeros(len(words) + 1, np.int64)
                if len(starts):
                    earliest = np.zeros(len(starts), bool)
                    earliest[np.unique(k1, return_index=True)[1]] = True
                    mine = own.values.to_numpy().view(np.uint64) if own.is_valid else np.zeros(0, np.uint64)
                    repeats = starts[~(earliest & np.isin(k1, mine))]
                    gone[repeats] += 1
                    np.subtract.at(gone, repeats + span, 1)
                gone = np.cumsum(gone)[:-1] > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass") if gone.any() else b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return met.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")
