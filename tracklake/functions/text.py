"""Text and number functions on columns. All are built-in expressions; none crosses into Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CPS, MAX_RATIO = 18.0, 1.35

# Filler phrases that may open a line, by language.
FILLERS = {
    "es": ("bueno, ", "pues, ", "o sea, ", "digamos, ", "en plan, "),
    "en": ("well, ", "you know, ", "i mean, ", "actually, ", "like, "),
    "fr": ("eh bien, ", "ben, ", "en fait, ", "tu vois, "),
    "de": ("also, ", "na ja, ", "weißt du, ", "eigentlich, "),
    "it": ("beh, ", "insomma, ", "cioè, ", "praticamente, "),
    "pt": ("bem, ", "então, ", "tipo, ", "sabe, "),
}
# Words whose doubling is collapsed.
INTENSIFIERS = ("muy", "really", "très", "sehr", "molto", "muito")

# Language names by code.
LANGUAGES = {
    "en": "English",
    "zh": "Chinese",
    "de": "German",
    "es": "Spanish",
    "ru": "Russian",
    "ko": "Korean",
    "fr": "French",
    "ja": "Japanese",
    "pt": "Portuguese",
    "tr": "Turkish",
    "pl": "Polish",
    "ca": "Catalan",
    "nl": "Dutch",
    "ar": "Arabic",
    "sv": "Swedish",
    "it": "Italian",
    "id": "Indonesian",
    "hi": "Hindi",
    "fi": "Finnish",
    "vi": "Vietnamese",
    "he": "Hebrew",
    "uk": "Ukrainian",
    "el": "Greek",
    "ms": "Malay",
    "cs": "Czech",
    "ro": "Romanian",
    "da": "Danish",
    "hu": "Hungarian",
    "ta": "Tamil",
    "no": "Norwegian",
    "th": "Thai",
    "ur": "Urdu",
    "hr": "Croatian",
    "bg": "Bulgarian",
    "la": "Latin",
    "mi": "Maori",
    "ml": "Malayalam",
    "cy": "Welsh",
    "sk": "Slovak",
    "te": "Telugu",
    "fa": "Persian",
    "lv": "Latvian",
    "bn": "Bengali",
    "sr": "Serbian",
    "az": "Azerbaijani",
    "sl": "Slovenian",
    "kn": "Kannada",
    "et": "Estonian",
    "mk": "Macedonian",
    "br": "Breton",
    "eu": "Basque",
    "is": "Icelandic",
    "hy": "Armenian",
    "ne": "Nepali",
    "mn": "Mongolian",
    "bs": "Bosnian",
    "kk": "Kazakh",
    "sq": "Albanian",
    "sw": "Swahili",
    "gl": "Galician",
    "mr": "Marathi",
    "pa": "Punjabi",
    "si": "Sinhala",
    "km": "Khmer",
    "sn": "Shona",
    "yo": "Yoruba",
    "so": "Somali",
    "af": "Afrikaans",
    "oc": "Occitan",
    "ka": "Georgian",
    "be": "Belarusian",
    "tg": "Tajik",
    "sd": "Sindhi",
    "gu": "Gujarati",
    "am": "Amharic",
    "yi": "Yiddish",
    "lo": "Lao",
    "uz": "Uzbek",
    "fo": "Faroese",
    "ht": "Haitian",
    "ps": "Pashto",
    "tk": "Turkmen",
    "nn": "Norwegian Nynorsk",
    "mt": "Maltese",
    "sa": "Sanskrit",
    "lb": "Luxembourgish",
    "my": "Burmese",
    "bo": "Tibetan",
    "tl": "Tagalog",
    "mg": "Malagasy",
    "as": "Assamese",
    "tt": "Tatar",
    "haw": "Hawaiian",
    "ln": "Lingala",
    "ha": "Hausa",
    "ba": "Bashkir",
    "jw": "Javanese",
    "su": "Sundanese",
    "und": "Undetermined",
}

# Media types by extension.
MIME = {
    "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "mkv": "video/x-matroska", "webm": "video/webm", "avi": "video/x-msvideo",
    "wav": "audio/wav", "mp3": "audio/mpeg", "m4a": "audio/mp4", "flac": "audio/flac", "ogg": "audio/ogg",
}

# Parts of a key that make its value a secret, compared without case, `_` and `-`.
SECRET_HINTS = ("token", "password", "passwd", "pwd", "secret", "credential", "apikey", "privatekey")
REDACTED = "***REDACTED***"

# Stage, status, percent; then the steps that stand for a stage.
STAGES = (
    ("QUEUED", "QUEUED", 0), ("MEDIA_PREP", "PROCESSING", 8), ("VAD", "PROCESSING", 16), ("LID", "PROCESSING", 22),
    ("ASR", "TRANSCRIBING", 32), ("TIMESTAMPS", "TRANSCRIBING", 52), ("DIARIZATION", "TRANSCRIBING", 58), ("ALIGNMENT", "PROCESSING", 66),
    ("QUALITY", "PROCESSING", 72), ("VALIDATION", "PROCESSING", 76), ("METRICS", "PROCESSING", 79), ("OUTPUT", "PROCESSING", 82),
    ("TRANSLATING", "TRANSLATING", 88), ("GENERATING_SUBTITLES", "GENERATING_SUBTITLES", 95), ("COMPLETED", "COMPLETED", 100),
    ("PREPARING", "PROCESSING", 1), ("EXTRACTING_AUDIO", "PROCESSING", 5), ("ANALYZING_AUDIO", "PROCESSING", 14), ("PROCESSING_WINDOW", "TRANSCRIBING", 16),
    ("CUES_READY", "TRANSCRIBING", 20), ("FINALIZING", "GENERATING_SUBTITLES", 97),
)
STEPS = {
    "T01_T02_T03": "MEDIA_PREP", "T04_VAD": "VAD", "T05_LID": "LID", "T06_ASR": "ASR", "T07_TIMESTAMPS": "TIMESTAMPS", "T08_DIARIZATION": "DIARIZATION",
    "T09_ALIGNMENT": "ALIGNMENT", "T10_QUALITY": "QUALITY", "T11_VALIDATION": "VALIDATION", "T12_METRICS": "METRICS", "T13_OUTPUT": "OUTPUT", "T14_CLEANUP": "COMPLETED",
}
STEP_PREFIXES = (("T01", "MEDIA_PREP"), ("T02", "MEDIA_PREP"), ("T03", "MEDIA_PREP"), ("T15", "TRANSLATING"), ("T14", "COMPLETED"))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lookup(table: dict[str, object], key: Column, default: Column) -> Column:
    """Value of a small fixed table, else the default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def normalise_space(c: Column) -> Column:
    """Runs of Unicode white space to one space, none at the ends; null: empty."""
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


def folded(c: Column) -> Column:
    """normalise_space without case, for comparisons (sharp s counts as ss)."""
    return F.replace(F.lower(normalise_space(c)), F.lit("ß"), F.lit("ss"))


def word_count(c: Column) -> Column:
    t = normalise_space(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def timecode(ms: Column, separator: str = ",", centis: bool = False) -> Column:
    """HH:MM:SS,mmm, or H:MM:SS.cc with centis; negatives are 0."""
    t = F.greatest(F.lit(0).cast("long"), ms.cast("long"))
    part = lambda unit, of: (F.floor(t / unit) % of).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours = F.floor(t / 3_600_000).cast("long").cast("string")
    rest = F.concat(F.lit(":"), two(part(60_000, 60)), F.lit(":"), two(part(1000, 60)))
    if centis:
        return F.concat(hours, rest, F.lit("."), two(part(10, 100)))
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), rest, F.lit(separator), F.lpad(part(1, 1000).cast("string"), 3, "0"))


def clean_cue_text(c: Column) -> Column:
    """Line ends to \\n, blank lines out, white space off the ends."""
    lines = F.regexp_replace(text_of(c), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n\s*\n+", "\n"), r"^\s+|\s+$", "")


def escape_vtt(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("--&gt;", "→")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_ass(c: Column) -> Column:
    for a, b in (("{", "("), ("}", ")"), ("\n", "\\N")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def typography_normalise(c: Column) -> Column:
    """Curly quotes and dashes to ASCII, several spaces to one, none before punctuation or at the ends."""
    plain = F.translate(text_of(c), "‘’‚‛′‵“”„‟″‶–—", "''''''\"\"\"\"\"\"--")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, " {2,}", " "), r"\s+([,.;:!?])", "$1"))


def strip_fillers(c: Column, lang: Column) -> Column:
    """Leading filler phrases of the language off, as long as something is left; for text without space at its ends.

    One anchored pattern takes them all; if nothing were left, the last phrase stays (its comma has no text after it).
    """
    out = c
    for g, phrases in FILLERS.items():
        any_of = "|".join(p.strip() for p in phrases)
        out = F.when(lang == g, F.regexp_replace(c, rf"(?i)^(?:(?:{any_of})\s+)+(?=\S)", "")).otherwise(out)
    return out


def collapse_intensifiers(c: Column) -> Column:
    out = F.regexp_replace(c, rf"\b({'|'.join(INTENSIFIERS)})\s+\1\b", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"\band also\b", "and"), r"\by también\b", "y")


def adapt(c: Column, lang: Column) -> Column:
    """Typography, fillers, intensifiers, in that order."""
    return collapse_intensifiers(strip_fillers(typography_normalise(c), lang))


def adaptation_fit(adapted: Column, source: Column, duration_ms: Column, max_cps: float = MAX_CPS, max_ratio: float = MAX_RATIO) -> Column:
    """struct(cps, ratio, max_chars, fits, warnings) of an adapted text against its source and time."""
    seconds = F.greatest(F.lit(1e-6), duration_ms / 1000.0)
    chars, n = F.length(adapted), F.length(F.trim(text_of(source)))
    most, ratio = (F.lit(max_cps) * seconds).cast("long"), F.when(n > 0, chars / n).otherwise(F.lit(0.0))
    warnings = F.array_compact(F.array(F.when(chars > most, F.lit("too_long_for_duration")), F.when(ratio > max_ratio, F.lit("expansion_ratio"))))
    return F.struct(F.round(chars / seconds, 3).alias("cps"), F.round(ratio, 3).alias("ratio"), most.alias("max_chars"), (chars <= most).alias("fits"), warnings.alias("warnings"))


def degenerate(c: Column) -> Column:
    """Empty, a character four times or more in a row, or over 3 characters without a Latin letter."""
    t = F.trim(text_of(c))
    return (t == "") | t.rlike(r"(.)\1{3,}") | ((F.length(t) > 3) & ~t.rlike("[A-Za-zÀ-ſ]"))


def language_route(source: Column, target: Column, supported: tuple[str, ...] = ("es", "en", "fr", "it", "pt")) -> Column:
    """passthrough, translate, or the error: undetermined or unsupported language."""
    s, t = F.lower(F.trim(source)), F.lower(F.trim(target))
    return (
        F.when(F.coalesce(s, F.lit("und")) == "und", "error_undetermined").when(s == t, "passthrough")
        .when(~s.isin(*supported) | ~F.coalesce(t.isin(*supported), F.lit(False)), "error_unsupported").otherwise("translate")
    )


def logprob_confidence(c: Column) -> Column:
    """clip((x + 6) / 6, 0, 1); null if not finite."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(c.isNotNull() & ~bad, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c + 6) / 6)))


def seconds_to_ms(c: Column, offset_ms: Column | None = None) -> Column:
    """Half-even milliseconds, plus an offset, not below 0."""
    ms = F.bround(c * 1000).cast("long")
    return F.greatest(F.lit(0).cast("long"), ms if offset_ms is None else ms + offset_ms)


def segment_key(language: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.concat_ws(":", language, start_ms, end_ms)


def safe_filename(c: Column, fallback: str = "file") -> Column:
    """Illegal characters and spaces to `_`, no stop or space at the end, reserved names prefixed, 200 characters at most (extension kept)."""
    name = F.regexp_replace(F.trim(text_of(c)), r'[<>:"/\\|?*\x00-\x1f ]', "_")
    name = F.regexp_replace(name, r"\.+$", "")
    reserved = F.upper(F.regexp_extract(name, r"^([^.]*)", 1)).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    name = F.when(reserved, F.concat(F.lit("_"), name)).when(name == "", F.lit(fallback)).otherwise(name)
    ext = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    return F.when(F.length(name) > 200, F.concat(F.substring(name, F.lit(1), F.lit(200) - F.length(ext)), ext)).otherwise(name)


def mime_by_extension(c: Column) -> Column:
    return lookup(MIME, F.lower(F.regexp_extract(text_of(c), r"\.([^.]*)$", 1)), F.lit("application/octet-stream"))


def stage_of(step: Column) -> Column:
    """Stage of a step: by name, as a stage itself, by prefix, else PROCESSING."""
    s = F.trim(text_of(step))
    prefixed = F.lit("PROCESSING")
    for p, stage in reversed(STEP_PREFIXES):
        prefixed = F.when(s.startswith(p), F.lit(stage)).otherwise(prefixed)
    return lookup(STEPS | {k: k for k, _, _ in STAGES}, s, prefixed)


def stage_percent(stage: Column) -> Column:
    return lookup({k: p for k, _, p in STAGES}, stage, F.lit(50))


def stage_status(stage: Column) -> Column:
    return lookup({k: s for k, s, _ in STAGES}, stage, F.lit("PROCESSING"))


def is_secret_key(key: Column) -> Column:
    k, out = F.regexp_replace(F.lower(key), "[_-]", ""), F.lit(False)
    for hint in SECRET_HINTS:
        out = out | F.contains(k, F.lit(hint))
    return out


def redact_map(m: Column) -> Column:
    """A map with the values of secret keys replaced."""
    return F.transform_values(m, lambda k, v: F.when(is_secret_key(k), F.lit(REDACTED)).otherwise(v))


def language_name(code: Column) -> Column:
    c = F.lower(F.trim(code))
    return lookup(LANGUAGES, c, F.initcap(c))


def target_languages(raw: Column, source: Column, supported: tuple[str, ...] = ("es", "en", "fr", "it", "pt")) -> Column:
    """Comma-separated targets: trimmed, lower-cased, distinct in order, supported, without the source."""
    each = F.transform(F.split(text_of(raw), ","), lambda x: F.lower(F.trim(x)))
    known = F.filter(F.array_distinct(each), lambda x: x.isin(*supported))
    return F.filter(known, lambda x: ~x.eqNullSafe(F.lower(F.trim(source))))


def protect_glossary(text: Column, terms: Column) -> Column:
    """struct(text, tokens): each term of array<struct<term, replacement>>, longest first, replaced by a token where it occurs."""
    ordered = F.array_sort(F.filter(terms, lambda t: t["term"] != ""), lambda a, b: F.when(F.length(a["term"]) != F.length(b["term"]), F.length(b["term"]) - F.length(a["term"])).when(a["term"] < b["term"], -1).when(a["term"] > b["term"], 1).otherwise(0))
    numbered = F.transform(ordered, lambda t, i: F.struct(F.concat(F.lit("__G"), i.cast("string"), F.lit("__")).alias("token"), t["term"].alias("term"), t["replacement"].alias("replacement")))
    start = F.struct(text_of(text).alias("text"), F.array().cast("array<struct<token:string,replacement:string>>").alias("tokens"))

    def step(a: Column, t: Column) -> Column:
        used = F.struct(F.replace(a["text"], t["term"], t["token"]).alias("text"), F.concat(a["tokens"], F.array(F.struct(t["token"], t["replacement"]))).alias("tokens"))
        return F.when(F.contains(a["text"], t["term"]), used).otherwise(a)

    return F.aggregate(numbered, start, step)


def restore_glossary(text: Column, tokens: Column) -> Column:
    return F.aggregate(tokens, text, lambda a, t: F.replace(a, t["token"], t["replacement"]))
