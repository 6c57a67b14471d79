"""Benchmark decontamination by winnowing.

Every sliding window of `w` consecutive k-word hashes keeps its smallest; spans of at least k + w - 1 words shared by a
document and an item therefore share a kept fingerprint. Items' fingerprints go into a bitmap of fixed size, the only
thing that is broadcast; where a document's kept fingerprint is in it, the full windows around it are joined, by
128-bit digest, with the items' windows. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import cut, small_batches

SPAN = 10  # words of a full window
K = 5  # words of a hashed gram; K + (SPAN - K + 1) - 1 = SPAN, so no shared window is missed
BITS = 1 << 26  # of the bitmap: 8 MB whatever the benchmark's size

_NOT_WORD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(SPAN)], np.uint64)


def item_words(text: str | None) -> list[bytes]:
    """Words as in the module's definition, A-Z lower-cased; other bytes of 0 to 7F part them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_NOT_WORD).split()


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out += word_hashes[i : i + m] * _FACTORS[i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnowed(h: np.ndarray, w: int) -> np.ndarray:
    """True where a hash is the least of one of the w-windows that it lies in (ties: all of them)."""
    if len(h) <= w:
        return h == h.min() if len(h) else np.zeros(0, bool)
    m = len(h) - w + 1
    least = h[:m].copy()
    for i in range(1, w):
        np.minimum(least, h[i : i + m], out=least)
    chosen = np.zeros(len(h), bool)
    for i in range(w):
        chosen[i : i + m] |= h[i : i + m] == least
    return chosen


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


def window_key(ws: list[bytes], at: int, n: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(ws[at : at + n]))


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """(item_id string, n, key, bit positions) of each window of each item; an item under span words is one window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = item_words(t)
                n = min(span, len(ws))
                hs = word_hashes(ws)
                if n == span:
                    grams = gram_hashes(hs, k)
                    marks = grams[winnowed(grams, span - k + 1)]
                else:
                    marks = gram_hashes(hs, n) if n else []
                for at in range(len(ws) - n + 1 if n else 0):
                    rows.append((i, n, window_key(ws, at, n), [int(x) % BITS + 1 for x in marks] if at == 0 else []))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], [], []), (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["item_id", "n", "key", "marks"])

    return items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).mapInArrow(run, "item_id string, n int, key binary, marks array<bigint>")


def bitmap(windows: DataFrame) -> bytes:
    """The items' fingerprints as BITS bits, put together by Spark from pieces of 4 KB; at most BITS / 8 bytes come back."""
    marks = windows.select(F.explode("marks").alias("m"))
    pieces = marks.groupBy(F.bitmap_bucket_number("m").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("m")).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in pieces:  # positions count from 1, so do pieces
        out[(r["piece"] - 1) * 4096 : r["piece"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), spans of hit words.

    A word is hit if it lies in any occurrence of an item's window of `span` words (or of a shorter item as a whole).
    Null and empty texts have no words; null item ids are left out of item_ids but their windows hit. Rows that repeat an
    id are each matched on their own. Empty tables give no hits. Other columns are not read.
    """
    if not 1 <= k <= span <= SPAN:
        raise ValueError("1 <= k <= span <= 10 is needed")
    spark = docs.sparkSession
    small_batches(spark)
    windows = cut(benchmark_windows(items, item_id, item_text, span, k))
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `span` of them
    bits = spark.sparkContext.broadcast(bitmap(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(bits.value, np.uint8)

        def known(h: np.ndarray) -> np.ndarray:
            at = (h % np.uint64(BITS)).astype(np.int64)
            return (seen[at >> 3] >> (at & 7)) & 1 == 1

        for b in batches:
            counts, ats, ns, keys = [], [], [], []
            for t in b.column("text"):
                ws = item_words(t.as_py())
                hs = word_hashes(ws)
                found: list[tuple[int, int]] = []
                for n in lengths:
                    if n < span:
                        found += [(int(p), n) for p in np.flatnonzero(known(gram_hashes(hs, n)))]
                    elif len(ws) >= span:
                        grams = gram_hashes(hs, k)
                        chosen = np.flatnonzero(winnowed(grams, span - k + 1))
                        at = chosen[known(grams[chosen])]
                        starts = np.unique(at[:, None] - np.arange(span - k + 1)[None, :])
                        found += [(int(p), n) for p in starts[(starts >= 0) & (starts <= len(ws) - span)]]
                counts.append(len(ws))
                ats.append([p for p, _ in found])
                ns.append([n for _, n in found])
                keys.append([window_key(ws, p, n) for p, n in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_tl_row"), pa.array(counts, pa.int64()), pa.array(ats, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.binary()))],
                ["doc_id", "_tl_row", "n_words", "ats", "ns", "keys"],
            )

    source = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("_tl_row"), F.col(text).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    rows = cut(source.mapInArrow(run, f"doc_id {id_type}, _tl_row long, n_words long, ats array<int>, ns array<int>, keys array<binary>"))
    maybe = rows.where(F.size("keys") > 0).select("_tl_row", F.explode(F.arrays_zip("ats", "ns", "keys")).alias("x")).select("_tl_row", F.col("x.ats").alias("at"), F.col("x.ns").alias("n"), F.col("x.keys").alias("key"))
    hits = cut(maybe.join(windows.select("n", "key").distinct(), ["n", "key"], "left_semi"))
    before = F.max(F.col("at") + F.col("n")).over(Window.partitionBy("_tl_row").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1))
    new_words = F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest(F.col("at"), F.coalesce(before, F.lit(0))))
    covered = hits.withColumn("new", new_words).groupBy("_tl_row").agg(F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("at", "n"))).alias("spans"))
    ids = hits.select("_tl_row", "n", "key").distinct().join(windows.select("item_id", "n", "key").distinct(), ["n", "key"]).groupBy("_tl_row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    none = F.array().cast("array<string>")
    return (
        rows.select("doc_id", "_tl_row", "n_words").join(covered, "_tl_row", "left").join(ids, "_tl_row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), "spans", F.col("_tl_row"))
    )


def drop_contaminated(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the documents in which a word is hit; columns as in df. The text alone decides, so ids may be null or repeat."""
    digest = F.md5(F.col(text).cast("binary"))
    marked = decontaminate(df.select(digest.alias("digest"), F.col(text).alias("text")), items, "digest", "text")
    gone = marked.where("n_hit > 0").select(F.col("doc_id").alias("_tl_digest")).distinct()
    return df.join(gone, digest == F.col("_tl_digest"), "left_anti")
