"""Conversation structure repair: the cheapest edits that make a conversation alternate, by an auction for shortest paths.

A conversation is a lattice: how many of its messages are done, times what its roles so far allow next. Edits are arcs with
whole costs. Nodes hold prices; the path at hand grows over the arc that its end's price pays for, or else the price rises
and the path shrinks, until it reaches the goal. The prices are then a dual solution: every arc of every cheapest path is
tight, so the least of all cheapest edit strings is read along tight arcs, letter by letter.

A long conversation is cut into blocks, the auction gives each block's cost from each state to each other, and the blocks
are arcs of a lattice above. Texts never come together but for the one stream that writes a conversation in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import cut, small_batches

#: What is allowed next: 0 anything that opens, 1 user (after system), 2 assistant, 3 user or the end.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = (2, 2, 3, 2)  # the state after the role that a state asks for, when it is given or changed to
ROLES = ("user", "user", "assistant", "user")
ENDS = (0, 3)
DELETE, CHANGE, TRUNCATED = 3, 2, 1
#: Messages of one lattice; of longer conversations this many blocks make one above.
BLOCK = 64
#: Rows of one piece of a conversation while it is in order.
PIECE = 512
SPACES = " \t\n\x0b\f\r"
#: Solved code strings that a task keeps: most conversations are alike.
MEMORY = 100_000

Arcs = list[tuple[str, int, int]]  # (letters, head, cost)
Stage = tuple[tuple[tuple[str, int, int], ...], ...]  # by state: (letters, state after it, cost)


def row_stage(code: str) -> Stage:
    """Arcs over one message: its role's initial, a capital if it is truncated."""
    c, cut_off = code.lower(), TRUNCATED if code.isupper() else 0
    return tuple(
        (("D", q, DELETE), *([("K", MOVES[q, c], cut_off)] if (q, c) in MOVES else ()), ("R", WANTED[q], CHANGE + cut_off)) for q in range(4)
    )


def leading(arcs: list[Arcs], goal: int) -> tuple[list[Arcs], set[int]]:
    """The arcs and nodes from which the goal can be reached: on a way round without it prices would rise for ever."""
    into: list[list[int]] = [[] for _ in arcs]
    for i, out in enumerate(arcs):
        for _, j, _ in out:
            into[j].append(i)
    reach, todo = {goal}, [goal]
    while todo:
        for i in into[todo.pop()]:
            if i not in reach:
                reach.add(i)
                todo.append(i)
    return [[a for a in out if a[1] in reach] for out in arcs], reach


def auction(arcs: list[Arcs], prices: list[int], start: int, goal: int) -> None:
    """Raise prices until they pay for a cheapest path from start to goal, which must be there. To begin with they must pay
    for no more than any arc costs."""
    path = [start]
    while path[-1] != goal:
        i = path[-1]
        least, head = min((cost + prices[j], j) for _, j, cost in arcs[i])
        if prices[i] < least:
            prices[i] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(head)


def tight(arcs: list[Arcs], prices: list[int], start: int, goal: int) -> str:
    """The least letters along tight arcs from start to goal. No two arcs of a node have letters that begin alike."""
    into: dict[int, list[int]] = {}
    seen, todo = {start}, [start]
    while todo:
        i = todo.pop()
        for _, j, cost in arcs[i]:
            if prices[i] == cost + prices[j]:
                into.setdefault(j, []).append(i)
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
    ahead, todo = {goal}, [goal]
    while todo:
        for i in into.get(todo.pop(), ()):
            if i not in ahead:
                ahead.add(i)
                todo.append(i)
    out, i = [], start
    while i != goal:
        letters, i = min((x, j) for x, j, cost in arcs[i] if j in ahead and prices[i] == cost + prices[j])
        out.append(letters)
    return "".join(out)


def through(stages: list[Stage], last: bool, inserts: bool, starts: Iterable[int] = range(4)) -> Stage:
    """The stages as one: the cheapest way from each state to each other, or if they are the last ones to the end (state 0).

    With inserts, messages may be put before each stage, and after the last of all; without, the stages hold them already.
    """
    n = len(stages)
    end = 4 * n + 4
    arcs: list[Arcs] = [[] for _ in range(end + 1)]
    put = lambda k, q: [("I", 4 * k + WANTED[q], CHANGE)] if inserts else []
    for k, stage in enumerate(stages):
        for q in range(4):
            arcs[4 * k + q] = [(x, 4 * (k + 1) + r, cost) for x, r, cost in stage[q]] + put(k, q)
    if last:
        for q in range(4):
            arcs[4 * n + q] = put(n, q) + ([("", end, 0)] if q in (ENDS if inserts else ENDS[:1]) else [])
    floor = [0] * (n + 1)  # no way from here on is cheaper: prices to begin with
    for k in range(n - 1, -1, -1):
        floor[k] = floor[k + 1] + min(cost for by in stages[k] for _, _, cost in by)
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(4)]
    for state, goal in [(0, end)] if last else [(q, 4 * n + q) for q in range(4)]:
        prices = [floor[min(i // 4, n)] for i in range(end + 1)]
        ways, reach = leading(arcs, goal)
        for q in reach.intersection(starts):
            auction(ways, prices, q, goal)
            out[q].append((tight(ways, prices, q, goal), state, prices[q] - prices[goal]))
    return tuple(map(tuple, out))


def edits(codes: str, memory: dict[tuple[str, bool], Stage]) -> tuple[str, int]:
    """(letters, cost) of the cheapest edits of messages with these codes, the least letters of those.

    D, K and R delete, keep or change the role of the next message; I puts one before it, or at the end.
    """
    def block(part: str, last: bool, starts: Iterable[int]) -> Stage:
        if len(memory) > MEMORY:
            memory.clear()
        if (part, last) not in memory:
            memory[part, last] = through([row_stage(c) for c in part], last, True, starts)
        return memory[part, last]

    if len(codes) <= BLOCK:
        stages = [block(codes, True, (0,))]
    else:  # the last block can be entered in any state
        parts = [codes[i : i + BLOCK] for i in range(0, len(codes), BLOCK)]
        stages = [block(p, False, range(4)) for p in parts[:-1]] + [through([row_stage(c) for c in parts[-1]], True, True)]
    while len(stages) > 1:
        groups = [stages[i : i + BLOCK] for i in range(0, len(stages), BLOCK)]
        stages = [through(g, i == len(groups) - 1, False) for i, g in enumerate(groups)]
    letters, _, cost = stages[0][0][0]
    return letters, cost


def solved(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """For the codes of each conversation's pieces: the edits of each piece, what is put at the end counted to the last, and the cost."""
    memory: dict[tuple[str, bool], Stage] = {}
    for batch in batches:
        letters, costs = [], []
        for pieces in batch:
            found, cost = edits("".join(pieces), memory)
            split, at = [], 0
            for codes in pieces:
                begin, left = at, len(codes)
                while left:
                    left -= found[at] != "I"
                    at += 1
                split.append(found[begin:at])
            split[-1] += found[at:]
            letters.append(split)
            costs.append(cost)
        yield pd.DataFrame({"letters": letters, "cost": costs})


def described(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages (conv_id, turn, role, text; nulls of the last two as one space), their code and said, which names conversation, role and text."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), some(role).alias("role"), some(text).alias("text"))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    said = F.concat_ws(":", F.length("role"), "role", F.length(conv), conv, "text")
    first, ending = F.substring("role", 1, 1), F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    code = F.when(F.col("first").isin("s", "u", "a"), F.col("first")).otherwise(F.lit("x"))
    rows = rows.withColumns({"said": F.unhex(F.substring(F.sha2(said, 256), 1, 32)), "first": first, "_end": ending})
    return rows.withColumns({"blank": F.col("_end") == "", "code": F.when(F.col("_end").isin(".", "!", "?"), code).otherwise(F.upper(code))}).drop("_end")


def in_order(df: DataFrame) -> DataFrame:
    """Different messages of df (described) in order, in pieces: conv_id, piece and items, PIECE at most.

    items: at, turn, role, said, first, code, n (copies in one place), kind: blank, duplicate (said before), truncated or ok.
    Rows are dealt by ranges of their order, so a conversation of any length lies over as many tasks as it needs.
    """
    places = cut(df.groupBy("conv_id", "turn", "role", "said", "first", "blank", "code").agg(F.count("*").alias("n")))
    here = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    earliest = places.groupBy("said").agg(F.min(here).alias("earliest"))
    kind = F.when(F.col("blank"), "blank").when(here > F.col("earliest"), "duplicate").when(F.col("code") == F.upper("code"), "truncated").otherwise("ok")
    rows = cut(places.join(earliest, "said").select("conv_id", "turn", "role", "said", "first", "code", "n", kind.alias("kind")))
    order = ("conv_id", "turn", "role", "said")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    item = F.struct("at", "turn", "role", "said", "first", "code", "n", "kind")
    return placed.groupBy("conv_id", F.floor(F.col("at") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def kept(item: Column) -> Column:
    return item["kind"].isin("ok", "truncated")


def planned(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, pieces) of described messages.

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. pieces: conv_id, items, tokens (the edits
    of each item that may stay, with what is put before it) and ending (what is put at the end).
    """
    pieces = cut(in_order(messages).withColumn("codes", F.array_join(F.transform(F.filter("items", kept), lambda x: x["code"]), "")))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    of_kind = lambda kind: total(F.transform(F.filter("items", lambda x: x["kind"] == kind), lambda x: x["n"]))
    beside = lambda rows, a, b, size: total(F.zip_with(rows, F.slice(rows, F.lit(2), size), lambda x, y: F.when(y.isNull() | F.concat(x[a], y[b]).isin("su", "ua", "au"), 0).otherwise(1)))
    copies = total(F.transform("items", lambda x: x["n"] - 1))
    said_again = of_kind("duplicate") + total(F.transform(F.filter("items", kept), lambda x: x["n"] - 1))
    cut_off = F.size(F.filter("items", lambda x: x["kind"] == "truncated")).cast("long")
    counts = pieces.select(
        "conv_id", "piece", "codes", of_kind("blank").alias("blank"), said_again.alias("duplicate"), cut_off.alias("truncated"), (beside("items", "first", "first", F.lit(PIECE)) + copies).alias("illegal"),
        F.get("items", F.lit(0))["first"].alias("head"), F.element_at("items", -1)["first"].alias("tail"),
    )
    convs = counts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.array_sort(F.collect_list(F.struct("piece", "codes", "head", "tail"))).alias("p"))
    between = beside("p", "tail", "head", F.size("p"))
    solve = F.pandas_udf(solved, "letters array<string>, cost long")
    convs = convs.withColumn("illegal", F.col("illegal") + between).withColumn("s", solve(F.col("p.codes")))
    cost = F.col("s.cost") + DELETE * (F.col("blank") + F.col("duplicate"))
    convs = cut(convs.select("conv_id", "blank", "duplicate", "truncated", "illegal", cost.alias("cost"), F.col("p.piece").alias("piece"), F.col("s.letters").alias("letters")))
    letters = convs.select(F.col("conv_id").alias("_conv"), F.explode(F.arrays_zip("piece", "letters")).alias("z")).select("_conv", F.col("z.piece").alias("_piece"), F.col("z.letters").alias("letters"))
    on = (F.col("piece") == F.col("_piece")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    pieces = cut(pieces.join(letters, on).select("conv_id", "piece", "items", F.regexp_extract_all("letters", F.lit("I*[DKR]"), F.lit(0)).alias("tokens"), F.regexp_extract("letters", "I*$", 0).alias("ending")))
    step = lambda a, x: F.when(kept(x), F.struct(F.concat(a["audit"], F.get("tokens", a["k"]), F.repeat(F.lit("D"), (x["n"] - 1).cast("int"))).alias("audit"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["audit"], F.repeat(F.lit("D"), x["n"].cast("int"))).alias("audit"), a["k"].alias("k")))
    told = F.concat(F.aggregate("items", F.struct(F.lit("").alias("audit"), F.lit(0).alias("k")), step, lambda a: a["audit"]), "ending")
    audits = pieces.groupBy(F.col("conv_id").alias("_conv")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", told.alias("audit")))), lambda p: p["audit"]), "").alias("audit"))
    turns = messages.where(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("_of")).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    out = convs.join(audits, F.col("conv_id").eqNullSafe(F.col("_conv"))).join(turns, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"), pieces


def told_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str, str]]:
    """(conv_id, edit, role, text) of the messages that repaired conversations have, one after the other."""
    current, state, waits, begun = None, 0, "", False
    for batch in batches:
        for conv, token, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "token", "role", "text")), strict=True):
            if not begun or conv != current:
                current, state, waits, begun = conv, 0, "", True
            if token is not None:  # the edits of the message whose rows follow, or of the end
                waits = ""
                for letter in token:
                    if letter == "I":
                        yield conv, "I", ROLES[state], ""
                        state = WANTED[state]
                    elif letter != "D":
                        waits = letter
            elif waits:  # its copies, if there are any, are not waited for
                after = MOVES[state, role[0]] if waits == "K" else WANTED[state]
                yield conv, waits, role if waits == "K" else ROLES[state], text
                state, waits = after, ""


def ordered(messages: DataFrame, pieces: DataFrame) -> DataFrame:
    """Edits and texts of each conversation, in order in one partition: conv_id, token (null: a message), role, text."""
    none = lambda kind: F.lit(None).cast(kind)
    key = {c: messages.schema[c].dataType for c in ("turn", "role", "said")}
    items = pieces.select("conv_id", F.explode(F.transform(F.filter("items", kept), lambda x, i: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["said"].alias("said"), F.get("tokens", i).alias("token")))).alias("x"))
    edited = items.select("conv_id", F.lit(False).alias("ends"), "x.turn", "x.role", "x.said", "x.token", none("string").alias("text"))
    endings = pieces.where("ending <> ''").select("conv_id", F.lit(True).alias("ends"), *[none(t).alias(c) for c, t in key.items()], F.col("ending").alias("token"), none("string").alias("text"))
    texts = messages.where(~F.col("blank")).select("conv_id", F.lit(False).alias("ends"), "turn", "role", "said", none("string").alias("token"), "text")
    rows = edited.unionByName(endings).unionByName(texts).withColumn("row", F.col("token").isNull())
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "ends", "turn", "role", "said", "row").select("conv_id", "token", "role", "text")


def repaired(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The messages of repaired conversations: conv_id, place (from 0), edit (K kept, R role changed, I put in), role, text."""
    messages = described(df, conv_id, turn, role, text)
    small_batches(df.sparkSession)
    schema = messages.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, out = None, 0, []
        for conv, edit, who, what in told_in_order(batches):
            place = place + 1 if current == (conv,) else 0
            current = (conv,)
            out.append((conv, place, edit, who, what))
            if len(out) == 1000:
                yield as_batch(out, schema)
                out = []
        if out:
            yield as_batch(out, schema)

    return ordered(messages, planned(messages)[1]).mapInArrow(run, schema)


def as_batch(rows: list[tuple], schema: object) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conv_id of df: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Messages are taken by turn, nulls first; those of one turn by role, then by a hash of the text. A null role or text is one
    space. The first fault of a message counts: blank, duplicate (role and text said before in the conversation) or
    truncated. Edits: K costs 0, R (user or assistant) 2, D 3 and must be taken for a blank or duplicate message, I 2; a
    truncated message that stays adds 1. audit has the cheapest edits whose role initials are (s?(ua)+)?, the least such
    string. gaps are whole turns missing between the first and last. A null conv_id is one conversation. Repeated rows are
    copies: one may stay. Other columns are not read; an empty table gives no rows.

    repaired_sha256 is over role:text of the repaired messages, newline-joined: a hash of one stream, so one task reads each
    conversation's texts in order and holds a batch of them at a time.
    """
    messages = described(df, conv_id, turn, role, text)
    small_batches(df.sparkSession)
    convs, pieces = planned(messages)
    convs = cut(convs)
    schema = messages.select(F.col("conv_id").alias("_conv"), F.lit("").alias("repaired_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, out = None, None, []
        for conv, _, who, what in told_in_order(batches):
            line = f"{who}:{what}".encode("utf-8", "surrogatepass")
            if current == (conv,):
                digest.update(b"\n" + line)
                continue
            if current:
                out.append((*current, digest.hexdigest()))
            current, digest = (conv,), hashlib.sha256(line)
            if len(out) == 1000:
                yield as_batch(out, schema)
                out = []
        if current:
            out.append((*current, digest.hexdigest()))
            yield as_batch(out, schema)

    digests = ordered(messages, pieces).mapInArrow(run, schema)
    empty = hashlib.sha256(b"").hexdigest()
    return convs.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(*convs.columns, F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def damaged(df: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text; the last two without nulls) with faults put in by crc32 of conv_id:turn modulo 20.

    0 drops a message, 1 empties its text, 2 takes its sentence ends away, 3 says it twice, 4 makes it the user's.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = df.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name.cast("binary")) % 20).alias("_m"))
    text = F.when(F.col("_m") == 1, "").when(F.col("_m") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("_m <> 0").select("conv_id", "turn", F.when(F.col("_m") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_m")
    twice = F.when(F.col("_m") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(twice)).select("conv_id", "turn", "role", "text")
