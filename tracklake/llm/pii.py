"""Personal data: patterns, and terms that disclose them by co-occurrence. Built-in functions only.

Patterns give the base spans. A base span's value is a protected entity, and so is the group it belongs to (a mailbox's
domain, a network of addresses, a card's issuer, a number's area), since most values stand in one text only; the words of
its document are terms, whatever their length or place. Over the corpus,
    PMI(t, e) = log2(n(t, e) N / (n(t) n(e)))     IC(e) = log2(N / n(e))
with n and N counting different texts (exact copies count once): n(t, e) with both, n(e) with e, n(t) with t.
A term discloses an entity if PMI reaches THRESHOLD of the entity's whole information IC in SUPPORT texts or more
(GROUP_SUPPORT for a group: words that are rare by chance meet in its many texts). The entity must have LEAST_BITS of
information (a mail provider that most texts name has next to none, and a share of nothing is soon reached), and the texts
with both must be more than chance puts together, n(t) n(e) / N, by SIGMAS of its deviations; wherever it stands in the corpus,
beside the entity or without it, it is a span of kind `term`, generalised to a mark in the sanitised text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import cut, let

KINDS = ("email", "ip", "card", "phone", "term")
THRESHOLD = 0.9
SUPPORT = 2
GROUP_SUPPORT = 5
BROADCAST_ROWS = 50_000  # (text, its flagged terms), at most, that are broadcast; more are joined by a shuffle
LEAST_BITS = 3.0
SIGMAS = 3.0
MOST_PLACES = 1 << 20  # numbers in a hashed set (entities, terms) that is broadcast, at most; larger sets are joined by a shuffle

# Each pattern finds what the plain one finds, from left to right; look-behinds and possessive counts only keep long
# runs of letters or digits from being tried again at every offset.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
_SPAN = "array<struct<start:int,k:int,end:int,value:string>>"
WORD = r"\p{L}++"


def running_sum(lengths: Column, block: int = 256) -> Column:
    """Sums up to and with each item, in blocks so that long arrays are not copied again and again."""
    add = lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["a"], F.array(a["s"] + x)).alias("a"))
    fold = lambda xs, start: F.aggregate(xs, F.struct(start.alias("s"), F.array().cast("array<int>").alias("a")), add, lambda a: a["a"])
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, block))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def sums(bs: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), fold(F.transform(bs, total), F.lit(0)))
        return let(before, lambda o: F.flatten(F.transform(bs, lambda b, i: fold(b, F.get(o, i)))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(blocks(lengths), sums))


def matches(text: Column, pattern: str, prefilter: Column) -> Column:
    """array of (start, end, value) of a pattern's matches: what splitting leaves between them gives their places."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(hits: Column) -> Column:
        def at(pieces: Column) -> Column:
            lengths = F.transform(hits, lambda h, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))
            return let(running_sum_of(lengths), lambda s: F.transform(hits, lambda h, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(h)).alias("end"), h.alias("value"))))

        return F.when(F.size(hits) == 0, none).otherwise(let(F.split(text, pattern, -1), at))

    running_sum_of = lambda lengths: let(lengths, lambda x: running_sum(x))
    return F.when(prefilter, let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)).otherwise(none)


def luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        return F.when((F.length(d) - i) % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return let(digits, lambda d: F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: value(d, i)), F.lit(0), lambda a, x: a + x) % 10 == 0)


def base_spans(text: Column) -> Column:
    """Base spans of a text as (start, k, end, value), sorted; k is the kind's place in KINDS."""
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    found = [
        (matches(text, EMAIL, F.contains(text, F.lit("@"))), lambda m: F.lit(True)),
        (matches(text, IP, text.rlike(r"[0-9]\.[0-9]+\.[0-9]")), lambda m: m["value"].rlike(_IP_PARTS)),
        (matches(text, CARD, text.rlike("[0-9][\\x20-]?[0-9]")), lambda m: luhn(F.regexp_replace(m["value"], "[^0-9]", ""))),
        (matches(text, PHONE, F.contains(text, F.lit("+"))), lambda m: digits(m["value"]).between(9, 15)),
    ]
    as_kind = lambda k: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), m["value"].alias("value"))
    each = [F.transform(F.filter(a, ok), as_kind(k)) for k, (a, ok) in enumerate(found)]
    return F.sort_array(F.concat(*each))


def entities_of(spans: Column) -> Column:
    """Entities of base spans: =kind:value for a value, ~kind:group for its group. Case does not matter."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1)
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    group = lambda k, v: (
        F.when(k == 0, F.substring_index(v, "@", -1)).when(k == 1, F.substring_index(v, ".", 3))
        .when(k == 2, F.substring(digits(v), 1, 6)).otherwise(F.substring(digits(v), F.lit(1), F.length(digits(v)) - 7))
    )
    named = lambda mark, s, v: F.concat(F.lit(mark), kind(s), F.lit(":"), v)
    both = lambda s: let(F.lower(s["value"]), lambda v: F.array(named("=", s, v), named("~", s, group(s["k"], v))))
    return F.array_distinct(F.flatten(F.transform(spans, both)))


def masked(text: Column, spans: Column, kinds: int = len(KINDS) - 1) -> Column:
    """The text with base spans blanked, of the same length; spans of one kind lie one after the other."""
    def blanked(t: Column, own: Column) -> Column:
        def pieces(a: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(a, i - 1)["end"]).otherwise(0)
            return F.transform(a, lambda s, i: F.concat(F.substring(t, before(i) + 1, s["start"] - before(i)), F.repeat(F.lit(" "), s["end"] - s["start"])))

        whole = lambda a: F.concat(F.array_join(pieces(a), ""), F.substring(t, F.element_at(a, -1)["end"] + 1, F.length(t)))
        return let(own, lambda a: F.when(F.size(a) == 0, t).otherwise(whole(a)))

    def step(t: Column, k: int) -> Column:
        return t if k == kinds else let(blanked(t, F.filter(spans, lambda s: s["k"] == k)), lambda r: step(r, k + 1))

    return F.when(F.size(spans) == 0, text).otherwise(let(text, lambda t: step(t, 0)))


def words_of(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.transform(F.split(text, r"[^\p{L}]+", -1), lambda w: F.lower(w)))


def among(df: DataFrame, values: DataFrame, c: str) -> DataFrame:
    """Rows of df whose c is in values, and up to a sixteenth of the others: values (different ones) meet df as a broadcast
    set of hashes, with sixteen places for each. More than MOST_PLACES of them are joined themselves."""
    n = values.count()
    if n > MOST_PLACES:
        return df.join(values.select(c), c, "left_semi")
    place = F.pmod(F.xxhash64(c), F.lit(1 << (16 * n).bit_length()))
    return df.withColumn("place", place).join(F.broadcast(values.select(place.alias("place")).distinct()), "place", "left_semi").drop("place")


def one_each(df: DataFrame, *columns: str) -> DataFrame:
    """The columns once for each _tl_copy; copies fall away within tasks first."""
    return df.groupBy("_tl_copy").agg(*[F.first(c).alias(c) for c in columns])


def candidate_pairs(rows: DataFrame, n: int, support: int, group_support: int, threshold: float) -> tuple[DataFrame, Column]:
    """(entity, term, n_te, n_e) that the texts with entities alone do not show to be too loose, and whether a pair reveals.

    n: different texts. Entities of fewer than support texts can have no pair, so most are gone before pairs are made; n(t)
    is the number of those texts that hold the term at least. The second is a column over n_te, n_e and n_t.
    """
    enough = lambda c: F.col(c) >= F.when(F.col("entity").startswith("="), support).otherwise(group_support)
    near = cut(one_each(rows.where(F.size("entities") > 0), "entities", "terms"))
    n_e = near.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where(enough("n_e"))
    n_e = cut(n_e)
    wanted = among(near.select(F.explode("entities").alias("entity"), "terms"), n_e, "entity")
    pairs = wanted.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(enough("n_te"))
    ic = F.log2(F.lit(float(max(n, 1))) / F.col("n_e"))
    chance = F.col("n_t") * F.col("n_e") / max(n, 1)
    reveals = (ic >= LEAST_BITS) & (ic + F.log2(F.col("n_te") / F.col("n_t")) >= threshold * ic) & (F.col("n_te") - chance >= SIGMAS * F.sqrt(chance))
    least = near.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    return cut(pairs.join(n_e, "entity").join(least, "term").where(reveals).drop("n_t")), reveals


def disclosing(docs: DataFrame, rows: DataFrame, threshold: float, support: int, group_support: int) -> DataFrame:
    """(_tl_copy, flagged): the disclosing terms that a text holds, for texts that hold any.

    docs: _tl_copy (the text's hash), text, _tl_base (its base spans); rows: _tl_copy, and entities and terms of the text. Words that may disclose are
    taken from all texts, once for each different text; a term's texts are counted, and texts found again, from that small
    table alone, so no text is shuffled, whatever share of the corpus is copies.
    """
    pairs, reveals = candidate_pairs(rows, rows.select("_tl_copy").distinct().count(), support, group_support, threshold)
    words = docs.select("_tl_copy", F.explode(words_of(masked(F.col("text"), F.col("_tl_base")))).alias("term"))
    words = cut(among(words, pairs.select("term").distinct(), "term").distinct())
    n_t = words.groupBy("term").agg(F.count("*").alias("n_t"))
    flagged = pairs.join(n_t, "term").where(reveals).select("term").distinct()
    return cut(words.join(flagged, "term", "left_semi").groupBy("_tl_copy").agg(F.collect_list("term").alias("flagged")))


def pii_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT, group_support: int = GROUP_SUPPORT, keep_text: bool = False) -> DataFrame:
    """One row per row of df: doc_id, base and spans (arrays of kind, start, end; spans: base and disclosing terms).

    Sorted by start, then kind as in KINDS; offsets are code points, ends exclusive. Null and empty texts have none. Rows
    that repeat an id, or a text, each get their own; copies of a text count once in the corpus statistics. An empty
    table stays empty. Other columns are not read.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_tl_copy", F.xxhash64("text"))
    placed = lambda d: d.withColumn("_tl_base", base_spans(F.col("text")))  # found anew in each pass, so that no text is written
    base = F.transform("_tl_base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    terms = F.when(F.size("_tl_base") == 0, F.array().cast("array<string>")).otherwise(F.array_remove(words_of(masked(F.col("text"), F.col("_tl_base"))), ""))
    own = ["doc_id", "_tl_copy", *(["text"] if keep_text else [])]
    rows = cut(placed(docs).select(*own, base.alias("found"), entities_of(F.col("_tl_base")).alias("entities"), terms.alias("terms")))
    held = disclosing(placed(docs), rows, threshold, support, group_support)  # only these texts' words are given places
    wanted = docs.join(F.broadcast(held) if held.count() <= BROADCAST_ROWS else held, "_tl_copy")
    hits = placed(wanted).select("doc_id", "_tl_copy", "flagged", F.explode(matches(masked(F.col("text"), F.col("_tl_base")), WORD, F.lit(True))).alias("m")).where(F.array_contains("flagged", F.lower("m.value")))
    term = F.struct("m.start", F.lit(KINDS.index("term")).alias("k"), "m.end")
    added = hits.groupBy(F.col("doc_id").alias("_tl_id"), F.col("_tl_copy").alias("_tl_of")).agg(F.collect_set(term).alias("added"))  # rows of one id and text alike
    names = lambda a: F.transform(a, lambda p: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), p["k"] + 1).alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    spans = F.when(F.col("added").isNull(), F.col("found")).otherwise(F.sort_array(F.concat("found", "added")))
    out = rows.join(added, F.col("doc_id").eqNullSafe(F.col("_tl_id")) & (F.col("_tl_copy") == F.col("_tl_of")), "left")
    return out.select("doc_id", names(F.col("found")).alias("base"), names(spans).alias("spans"), *(["text"] if keep_text else []))


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: object) -> DataFrame:
    """doc_id and sanitised: the text with every span generalised to its kind in angle brackets; null texts are empty.

    Of spans that overlap, the first is taken.
    """
    out = pii_spans(df, doc_id, text, keep_text=True, **how)
    t = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<kind:string,start:int,end:int,prev:int>>").alias("a"))

    def take(a: Column, s: Column) -> Column:
        item = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), a["end"].alias("prev"))
        return F.when(s["start"] >= a["end"], F.struct(s["end"].alias("end"), F.concat(a["a"], F.array(item)).alias("a"))).otherwise(a)

    pieces = lambda r: F.transform(r["a"], lambda s: F.concat(F.substring(t, s["prev"] + 1, s["start"] - s["prev"]), F.lit("<"), s["kind"], F.lit(">")))
    whole = let(F.aggregate("spans", start, take), lambda r: F.concat(F.array_join(pieces(r), ""), F.substring(t, r["end"] + 1, F.length(t))))
    return out.select("doc_id", whole.alias("sanitised"))
