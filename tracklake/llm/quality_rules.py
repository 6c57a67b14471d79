"""Quality rules: plain counts and the divergence of a text's histograms from its closest language.

All of it is built-in functions. The words that most documents of a language hold are its common words; one pass over the
texts then makes the counts and two histograms of each, of character classes and of common words, small beside the text
itself. They are written out, summed into reference histograms over the documents that speak their language, that is hold
enough of its common words, so that junk under a language's name does not move its reference, and compared by
Jensen-Shannon distance.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import cut, let, words

CLASSES = ("lower", "upper", "space", "digit", "punct", "letter", "other")
#: Where the language is not known: what is plain text in any script, capitals, digits, the rest.
ANY_SCRIPT = (("lower", "space", "punct", "letter"), ("upper",), ("digit",), ("other",))
SYMBOLS = "#*$%&|<>"

#: Columns that the rules add; those that df has by these names are replaced.
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")

TOP_WORDS = 12  # common words of a language
MIN_REFERENCE = 1000  # words of the documents that speak a language, for a reference of it
SPOKEN_WORDS = 4  # different common words of its language that a document must hold to speak it,
SPOKEN_SHARE = 5  # and the percentage of its words that they must be
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.28
MIN_CHARS = 200
MIN_WORDS = 100


def repeat_words(ws: Column, n: int = 3) -> Column:
    """Words that lie in an n-word window found twice or more. Windows are compared by 64-bit hash inside a text.

    Sorting (hash, position) pairs brings equal windows together; texts without any equal pair stop before that.
    """
    def covered(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            return F.aggregate(F.sort_array(let(s["h"], lambda h: repeated(h, s["i"]))), zero, lambda a, p: F.struct((a["c"] + p + n - F.greatest(p, a["end"])).alias("c"), (p + n).alias("end")), lambda a: a["c"])

        zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("end"))
        repeated = lambda h, at: let(at, lambda at: F.filter(at, lambda i, k: (F.get(h, k) == F.get(h, k + 1)) | (F.get(h, k) == F.get(h, k - 1))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ranked, count))

    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return let(ws, lambda w: F.when(F.size(w) < n, F.lit(0)).otherwise(let(grams(w), covered))).cast("long")


def class_counts(text: Column, word_chars: Column) -> Column:
    """Characters by class, as CLASSES; word_chars: those that are no white space.

    Most characters are lower-case letters: the other classes are looked for in what is left without them, and capitals.
    """
    def dropped(t: Column, pattern: str) -> Column:
        return F.regexp_replace(t, pattern, "")

    def counts(few: Column, rest: Column) -> Column:
        lost = lambda t: F.length(rest) - F.length(t)
        return F.array(
            F.length(text) - F.length(few), F.length(few) - F.length(rest), F.length(text) - word_chars.cast("int"), lost(F.translate(rest, "0123456789", "")), lost(F.translate(rest, ".,;:!?'\"()-", "")),
            lost(dropped(rest, r"[\p{Lo}\p{Lm}\p{Lt}\p{M}]+")),
        )

    known = let(dropped(text, r"\p{Ll}+"), lambda few: let(dropped(few, r"\p{Lu}+"), lambda rest: counts(few, rest)))
    return let(known, lambda k: F.concat(k, F.array(F.length(text) - F.aggregate(k, F.lit(0), lambda a, x: a + x))))


def word_counts(ws: Column, vocabulary: list[str]) -> Column:
    """(v, c) of each word of the vocabulary that occurs: its place in the vocabulary, how often."""
    if not vocabulary:
        return F.array().cast("array<struct<v:int,c:int>>")
    place = lambda x: (F.array_position(F.array(*map(F.lit, vocabulary)), x) - 1).cast("int")

    def counted(c: Column, distinct: Column, first: Column) -> Column:  # equal words lie one after the other
        n = lambda i: F.coalesce(F.get(first, i + 1), F.size(c) + 1) - F.get(first, i)
        return F.transform(distinct, lambda x, i: F.struct(place(x).alias("v"), n(i).cast("int").alias("c")))

    first = lambda c, d: F.transform(d, lambda x: F.array_position(c, x))
    common = F.sort_array(F.filter(ws, lambda x: x.isin(vocabulary)))
    return let(common, lambda c: let(F.array_distinct(c), lambda d: let(first(c, d), lambda f: counted(c, d, f))))


def base_counts(df: DataFrame, text: str = "text", vocabulary: list[str] | None = None) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the two histograms."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("_tl_words")
    kept = [c for c in df.columns if c != text and c not in OUTPUTS]
    chars = F.length(F.array_join(w, "")).cast("long")
    out = df.withColumn("_tl_words", words(F.col(text))).select(
        *kept,
        F.size(w).cast("long").alias("n_words"),
        chars.alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        let(t, lambda t: class_counts(t, chars)).alias("_tl_classes"),
        word_counts(w, vocabulary or []).alias("_tl_common"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def common_words(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP_WORDS) -> dict[str, list[str]]:
    """By language the words that most of its documents hold, `top` at most; ties go to the word that sorts first.

    Words of letters alone, over all documents that have a language. They are counted within tasks first; to the driver come
    `top` a language.
    """
    each = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    counted = each.where(F.col("word").rlike(r"^\p{L}+$")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # tasks keep `top` words each before it
    out: dict[str, list[str]] = {}
    for r in counted.withColumn("r", rank).where(F.col("r") <= top).select("lang", "word").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def speaks(own: dict[str, list[int]], lang: str, common: str = "_tl_common", n: str = "n_words") -> Column:
    """Whether a document holds SPOKEN_WORDS different common words of its language, and SPOKEN_SHARE percent of them.

    own: by language the places of its common words in the vocabulary.
    """
    places = F.from_json(F.lit(json.dumps(own)), "map<string,array<int>>")[F.col(lang).cast("string")]
    found = F.filter(common, lambda x: F.array_contains(places, x["v"]))
    enough = let(found, lambda f: (F.size(f) >= SPOKEN_WORDS) & (100 * F.aggregate(f, F.lit(0).cast("long"), lambda a, x: a + x["c"]) >= SPOKEN_SHARE * F.col(n)))
    return F.coalesce(enough, F.lit(False))


def references(counts: DataFrame, own: dict[str, list[int]], lang: str = "lang", size: int = 0, least: int = MIN_REFERENCE) -> list[dict[str, object]]:
    """Reference histograms of each language: sums over all its documents that pass the base rules and speak it.

    lang, classes (shares), words (shares of each of `size` common words, then of all others). A language with under
    `least` words has none. To the driver comes a row for each language, and one for each of its common words.
    """
    good = counts.where(F.col(lang).isNotNull() & ~F.col("base_failed") & speaks(own, lang))
    sums = [F.sum(F.get("_tl_classes", F.lit(i)).cast("long")).alias(c) for i, c in enumerate(CLASSES)]
    whole = good.groupBy(F.col(lang).alias("lang")).agg(F.sum("n_words").alias("n"), *sums).where(F.col("n") >= least).collect()
    seen = good.select(F.col(lang).alias("lang"), F.inline("_tl_common")).groupBy("lang", "v").agg(F.sum("c").alias("n")).collect()
    by_word = {(r["lang"], r["v"]): r["n"] for r in seen}
    out = []
    for r in sorted(whole, key=lambda r: r["lang"]):
        common = [by_word.get((r["lang"], v), 0) for v in range(size)]
        chars = sum(r[c] for c in CLASSES)
        merged = [sum(r[c] for c in group) / chars for group in ANY_SCRIPT]
        out.append({"lang": r["lang"], "classes": [r[c] / chars for c in CLASSES], "any_script": merged, "words": [x / r["n"] for x in [*common, r["n"] - sum(common)]]})
    return out


def divergence_term(p: Column, q: Column) -> Column:
    """What one bin adds to twice the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return part(p) + part(q)


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of counts from a reference of shares; 1 if all are 0."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(n: Column) -> Column:
        twice = F.aggregate(F.zip_with(counts, reference, lambda c, q: divergence_term(c / n, q)), F.lit(0.0), lambda a, x: a + x)
        return F.when(n > 0, F.sqrt(F.greatest(twice / 2, F.lit(0.0)))).otherwise(F.lit(1.0))

    return let(total, of)


def sparse_jensen_shannon(common: Column, n: Column, reference: Column) -> Column:
    """The same for words: common holds (v, c) of the bins that are not 0; the last bin has the rest of the n words.

    A bin that is 0 in the document adds its share in the reference.
    """
    def of(r: Column) -> Column:
        last = F.element_at(r, -1)
        step = lambda a, x: F.struct((a["d"] + divergence_term(x["c"] / n, F.get(r, x["v"])) - F.get(r, x["v"])).alias("d"), (a["p"] + x["c"] / n).alias("p"))
        found = F.aggregate(common, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p")), step)
        return let(found, lambda f: f["d"] + divergence_term(F.greatest(1 - f["p"], F.lit(0.0)), last) + 1 - last)

    return F.when(n > 0, F.sqrt(F.greatest(let(reference, of) / 2, F.lit(0.0)))).otherwise(F.lit(1.0))


def quality_rules(
    df: DataFrame, text: str = "text", lang: str = "lang", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, top_words: int = TOP_WORDS, min_reference: int = MIN_REFERENCE,
) -> DataFrame:
    """df without its text, with the base counts, class_distance, word_distance, base_failed and kept.

    A document is rejected by the base rule (under 50 words, or over half of its words in repeated windows) or, if it is
    long enough (min_chars, min_words), when either histogram lies further than the limit from every reference language.
    References are made for every value of lang whose documents that speak it have min_reference words. A document whose lang
    has none is judged by the base rule alone. One without a lang counts for no reference; its words may be of a language
    that has none, so only its classes are judged, and letters of all scripts count alike (its class_distance is of those).
    Null or empty texts have no words and fail; with no reference at all (empty table) distances are null. Repeated rows are
    judged alike, each on its own. Needs columns text and lang; all others pass through.
    """
    by_lang = common_words(df, text, lang, top_words)
    vocabulary = sorted({w for ws in by_lang.values() for w in ws})
    own = {g: [vocabulary.index(w) for w in ws] for g, ws in by_lang.items()}
    counts = cut(base_counts(df, text, vocabulary))
    refs = references(counts, own, lang, len(vocabulary), min_reference)
    table = F.from_json(F.lit(json.dumps(refs)), "array<struct<lang:string,classes:array<double>,any_script:array<double>,words:array<double>>>")
    nearest = lambda distance: F.array_min(F.transform(table, distance))
    chars = F.aggregate("_tl_classes", F.lit(0), lambda a, x: a + x)
    of_classes = lambda group: sum((F.get("_tl_classes", F.lit(CLASSES.index(c))) for c in group), F.lit(0))
    any_script = F.array(*[of_classes(group) for group in ANY_SCRIPT])
    known = nearest(lambda r: jensen_shannon(F.col("_tl_classes"), r["classes"]))
    out = counts.withColumns({
        "class_distance": F.when(F.col(lang).isNull(), nearest(lambda r: jensen_shannon(any_script, r["any_script"]))).otherwise(known),
        "word_distance": nearest(lambda r: sparse_jensen_shannon(F.col("_tl_common"), F.col("n_words"), r["words"])),
    })
    judged = F.col(lang).isNull() | F.col(lang).isin([r["lang"] for r in refs])
    far = ((chars >= min_chars) & (F.col("class_distance") > max_class)) | (F.col(lang).isNotNull() & (F.col("n_words") >= min_words) & (F.col("word_distance") > max_word))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(judged & far, F.lit(False))).drop("_tl_classes", "_tl_common")


def keep_good(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df whose documents are kept; columns as in df. Rows that repeat an id and text share a verdict.

    Rejected ids are few beside the texts, so rows are taken out by an anti join on id and text hash.
    """
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    judged = quality_rules(df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), key.alias("_tl_key")))
    return df.join(judged.where(~F.col("kept")).select("_tl_key").distinct(), key == F.col("_tl_key"), "left_anti")
