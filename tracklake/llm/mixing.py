"""Mixing sources to target weights by Pfair scheduling, in built-in functions only.

A source of weight w gets its j-th block (from 0) released at slot floor(j / w), due at slot ceil((j + 1) / w). In every
slot the released block with the earliest deadline goes out, so that at any slot t each source has had floor(t w) or
ceil(t w) blocks: less than one block from its share. Weights are whole shares of their sum, so all of this is exact. The
schedule repeats after as many slots as the shares sum to; what is needed of that is made by a fold over one row's array,
a number a slot and no data, and every block finds its slot by its number.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 64
MOST_SLOTS = 1 << 20  # about, that a table's own schedule has: past MOST_SLOTS * BLOCK_ROWS rows blocks are longer
MOST_SHARES = 1 << 40  # that weights are written in: their last digits count for less than a millionth of a block
REST = "\u0000rest"  # rows of sources without a weight
NO_SOURCE = "\u0000none"
NEW = {"_tl_stream": "string", "_tl_rank": "long", "_tl_block": "long", "_tl_slot": "long", "_tl_release": "long", "_tl_deadline": "long", "_tl_mixed": "boolean"}


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def released_at(j: Column, share: Column, total: int) -> Column:
    return div(j * F.lit(total).cast("long"), share)


def due_at(j: Column, share: Column, total: int) -> Column:
    return div((j + 1) * F.lit(total).cast("long") + share - 1, share)


def whole_shares(weights: list[int | float | Fraction]) -> list[int]:
    """Integers in the proportion of the weights, without a common divisor, each 1 or more.

    A float stands for the simplest fraction that is read as it. Weights that need more than MOST_SHARES are rounded to that.
    """
    def exact(w: int | float | Fraction) -> Fraction:
        tries = (Fraction(w).limit_denominator(10**d) for d in range(1, 13))
        return next((f for f in tries if isinstance(w, float) and float(f) == w), Fraction(w))

    parts = [exact(w) for w in weights]
    base = lcm(*(f.denominator for f in parts))
    shares = [int(f * base) for f in parts]
    if sum(shares) > MOST_SHARES:
        shares = [max(1, round(Fraction(s * MOST_SHARES, sum(shares)))) for s in shares]
    return [s // gcd(*shares) for s in shares]


def schedule(spark: SparkSession, shares: list[int], slots: int, chunk: int = 1024) -> DataFrame:
    """The first slots of the schedule: (stream index, nth block of the stream, slot)."""
    total = sum(shares)
    had, none = F.array(*[F.lit(0).cast("long")] * len(shares)), F.array().cast("array<int>")

    def slot(a: Column, t: Column) -> Column:
        def next_block(n: Column, k: Column) -> Column:
            share = F.get(F.col("q"), k)
            return F.when(released_at(n, share, total) <= t, F.struct(due_at(n, share, total).alias("deadline"), k.alias("k")))

        def go(pick: Column) -> Column:
            return F.struct(F.transform(a["had"], lambda n, k: n + F.when(k == pick, 1).otherwise(0)).alias("had"), F.concat(a["order"], F.array(pick)).alias("order"))

        return F.element_at(F.transform(F.array(F.array_min(F.transform(a["had"], next_block))["k"]), go), 1)

    def slots_of(a: Column, c: Column) -> Column:
        """Slots of one chunk, so that the lists that grow stay short."""
        each = F.sequence(c * chunk, F.least((c + 1) * chunk, F.lit(slots).cast("long")) - 1)
        end = F.aggregate(each, F.struct(a["had"].alias("had"), none.alias("order")), slot)
        return F.element_at(F.transform(F.array(end), lambda e: F.struct(e["had"].alias("had"), F.concat(a["orders"], F.array(e["order"])).alias("orders"))), 1)

    start = F.struct(had.alias("had"), F.array().cast("array<array<int>>").alias("orders"))
    chunks = F.sequence(F.lit(0).cast("long"), F.lit((slots - 1) // chunk).cast("long"))
    order = F.flatten(F.aggregate(chunks, start, slots_of, lambda a: a["orders"]))
    made = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in shares]).alias("q")).select(F.posexplode(order).alias("slot", "stream"))
    nth = F.row_number().over(Window.partitionBy("stream").orderBy("slot")) - 1
    return made.select("stream", nth.cast("long").alias("nth"), F.col("slot").cast("long"))


def mix(
    df: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str | None, int | float | Fraction] | None = None, block_rows: int | None = None,
) -> DataFrame:
    """df with _tl_stream, _tl_rank, _tl_block, _tl_slot, _tl_release, _tl_deadline, _tl_mixed.

    Rows of a source are ordered by md5 of the id (then id), cut into blocks of block_rows, and each block gets a slot.
    Without weights each source's target is its own share of the blocks: every row is mixed. With weights (by source, of
    any sum; those of 0 or less and sources not listed get no slot) rows are mixed up to the slot for which the first of
    the listed sources has no block left; rows past it keep their place in the result with a null slot and _tl_mixed
    false. Every mixed row has a slot. A listed source that has no rows leaves nothing mixed. A null source is a source
    of its own. Ties (equal ids) take neighbouring ranks in any order; rows of null ids are ordered by their other
    columns. An empty table stays empty. Columns of these names in df are replaced.

    block_rows is 64 unless given, more in tables of over 64 * MOST_SLOTS rows: the schedule, made in one row of one task,
    has some MOST_SLOTS slots at most, each a step over the sources, whatever the table's size. To the driver comes one
    row for each source. Ranks need no source in one task: rows are numbered in 4096 buckets of each source, to which
    counts add an offset.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in NEW]
    df = df.select(*kept)
    src = F.coalesce(F.col(source), F.lit(NO_SOURCE))
    counts = {r["s"]: r["n"] for r in df.groupBy(src.alias("s")).agg(F.count("*").alias("n")).collect()}
    if weights is None:
        listed = dict.fromkeys(counts)
    else:
        listed = {(NO_SOURCE if k is None else k): w for k, w in weights.items() if w > 0}
    names = sorted(listed)
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // MOST_SLOTS))
    blocks = [-(-counts.get(k, 0) // block_rows) for k in names]
    shares = whole_shares(blocks if weights is None else [listed[k] for k in names]) if names else []
    if not names or not all(blocks):
        return df.withColumns({k: F.lit(False) if k == "_tl_mixed" else F.lit(None).cast(t) for k, t in NEW.items()})
    total = sum(shares)
    # the first source to run out does so before its block past the last is due
    slots = total if weights is None else min((n + 1) * total // a + 1 for n, a in zip(blocks, shares, strict=True))
    made = schedule(spark, shares, min(slots, total))
    end = None
    if weights is not None:
        runs_out = [(k, n // a, n % a) for k, (n, a) in enumerate(zip(blocks, shares, strict=True))]
        firsts = [(F.col("stream") == k) & (F.col("nth") == j) for k, _, j in runs_out]
        slot = F.coalesce(*[F.when(c, F.col("slot") + F.lit(cycle * total).cast("long")) for c, (_, cycle, _) in zip(firsts, runs_out, strict=True)])
        end = made.agg(F.min(slot)).first()[0]

    # nth row of its stream
    others = [c for c in kept if "map<" not in df.schema[c].dataType.simpleString()]
    name = F.coalesce(F.col(doc_id).cast("string"), F.xxhash64(*others).cast("string"))
    bucket = F.substring(F.md5(name.cast("binary")), 1, 3)
    stream = F.when(src.isin(names), src).otherwise(F.lit(REST)) if weights is not None else src
    rows = df.withColumns({"_tl_stream": stream, "_tl_bucket": bucket})
    by_name = lambda values: F.create_map(*[x for k, v in zip(names, values, strict=True) for x in (F.lit(k), F.lit(v).cast("long"))])
    before = F.coalesce(F.sum("_tl_n").over(Window.partitionBy("_tl_stream").orderBy("_tl_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = df.select(stream.alias("_tl_stream"), bucket.alias("_tl_bucket")).groupBy("_tl_stream", "_tl_bucket").agg(F.count("*").alias("_tl_n"))
    offsets = sizes.select(
        "_tl_stream", "_tl_bucket", before.alias("_tl_before"),
        F.try_element_at(by_name(range(len(names))), F.col("_tl_stream")).alias("_tl_k"), F.try_element_at(by_name(shares), F.col("_tl_stream")).alias("_tl_share"),
    )
    nth = F.row_number().over(Window.partitionBy("_tl_stream", "_tl_bucket").orderBy(doc_id)) - 1
    rows = rows.withColumn("_tl_nth", nth).join(offsets, ["_tl_stream", "_tl_bucket"])
    rank = F.col("_tl_nth") + F.col("_tl_before")

    # nth block of its stream, and its slot
    rows = rows.withColumn("_tl_rank", rank.cast("long")).withColumn("_tl_block", div(F.col("_tl_rank"), F.lit(block_rows)))
    rows = rows.withColumns({"_tl_cycle": div(F.col("_tl_block"), F.col("_tl_share")), "_tl_j": F.col("_tl_block") % F.col("_tl_share")})
    made = made.select(F.col("stream").cast("long").alias("_tl_k"), F.col("nth").alias("_tl_j"), F.col("slot").alias("_tl_in"))
    rows = rows.join(F.broadcast(made) if min(slots, total) <= 2 * MOST_SLOTS else made, ["_tl_k", "_tl_j"], "left")
    slot = F.col("_tl_in") + F.col("_tl_cycle") * F.lit(total).cast("long")
    mixed = F.coalesce(slot < end, F.lit(False)) if end is not None else slot.isNotNull()
    return rows.select(
        *[F.col(c) for c in kept], F.when(F.col("_tl_k").isNotNull(), F.col("_tl_stream")).alias("_tl_stream"), "_tl_rank", "_tl_block", F.when(mixed, slot).alias("_tl_slot"),
        released_at(F.col("_tl_block"), F.col("_tl_share"), total).alias("_tl_release"), due_at(F.col("_tl_block"), F.col("_tl_share"), total).alias("_tl_deadline"), mixed.alias("_tl_mixed"),
    )


def keep_mixed(df: DataFrame, **how: object) -> DataFrame:
    """The rows of df that are mixed, in the order of the mix over partitions and in each; columns as in df."""
    rows = mix(df, **how).where("_tl_mixed").repartitionByRange("_tl_slot", "_tl_rank").sortWithinPartitions("_tl_slot", "_tl_rank")
    return rows.select(*df.columns)
