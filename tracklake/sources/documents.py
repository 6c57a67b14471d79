"""Stored documents and tables: transcripts, cue tracks, glossaries, caches, application tables; and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators.cues import export_all
from tracklake.operators.tracks import latest_wins

CUES = "array<struct<id:string,index:bigint,start_ms:bigint,end_ms:bigint,text:string,speaker:string,state:string>>"
TRANSCRIPT = "media_id bigint, language string, segments array<struct<segment_index:bigint,start_ms:bigint,end_ms:bigint,speaker_label:string,text:string>>"
TABLES = {
    "projects": "project_id bigint, user_id bigint, title string, created_at timestamp",
    "jobs": "job_id bigint, project_id bigint, user_id bigint, status string, created_at timestamp, claimed_by string, heartbeat_age_s bigint",
    "subtitles": "project_id bigint, language string, cues string, updated_at timestamp",
    "renders": "project_id bigint, language string, state string, progress int, heartbeat_age_s bigint, stamp string, storage_key string",
    "leases": "resource string, owner string, heartbeat_at double",
    "rate_hits": "bucket string, at double",
}


def read_transcripts(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """Segments of transcript documents (one JSON object a file); source_lang is the given language, else the document's;
    error_code marks documents without either."""
    return transcript_segments(spark.read.schema(TRANSCRIPT).option("multiLine", "true").json(path), language)


def transcript_segments(documents: DataFrame, language: str | None = None) -> DataFrame:
    lang = F.coalesce(F.lit(language).cast("string"), F.nullif("language", F.lit("")))
    rows = documents.select("media_id", lang.alias("source_lang"), F.explode("segments").alias("s"))
    return rows.select("media_id", "source_lang", "s.*", F.when(F.col("source_lang").isNull(), F.lit("no_source_language")).alias("error_code"))


def read_tracks(tracks: DataFrame, column: str = "cues") -> DataFrame:
    """Cues of tracks (project_id, language, cues JSON): defaults for id, index, state and text; bad JSON is an empty track."""
    rows = tracks.select("project_id", "language", F.posexplode(F.from_json(column, CUES)).alias("i", "c"))
    text = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default)
    at = (F.col("i") + 1).cast("long")
    return rows.where(F.col("c").isNotNull()).select(
        "project_id", "language", text("c.id", F.concat_ws(":", "language", F.coalesce("c.start_ms", F.lit(0)), F.coalesce("c.end_ms", F.lit(0)))).alias("cue_id"),
        F.coalesce("c.index", at).alias("cue_index"), F.coalesce("c.start_ms", F.lit(0)).cast("long").alias("start_ms"), F.coalesce("c.end_ms", F.lit(0)).cast("long").alias("end_ms"),
        F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.speaker", F.lit("")).alias("speaker"), text("c.state", "final").alias("state"))


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """An application table from Parquet, under its fixed schema."""
    return spark.read.schema(TABLES[name]).parquet(path)


def read_table_jdbc(spark: SparkSession, name: str, url: str, column: str | None = None, rows_a_part: int = 1_000_000, most_parts: int = 256, **options: str) -> DataFrame:
    """An application table over JDBC, under its schema; filters go to the database.

    With a numeric or time column it is read in ranges of it, of rows_a_part rows on average and most_parts at most, whose
    bounds and number come from the table's own least and greatest value and count (one small query when this is called).
    Rows where the column is null come with the first range; so few distinct values make few rows a range uneven.
    """
    def load(**more: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, **options, **more).load()

    kind = {c.split(" ")[0]: c.split(" ")[1] for c in TABLES[name].split(", ")}
    more = {"dbtable": name}
    if column:
        named = next(c for c in load(**more).columns if c.lower() == column.lower())
        quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(named)
        lo, hi, n = load(query=f"select min({quoted}) as lo, max({quoted}) as hi, count(*) as n from {name}").first()
        parts = min(most_parts, -(-n // rows_a_part))
        if parts > 1 and lo != hi:
            above = hi + 1 if isinstance(hi, int) else hi
            more |= {"partitionColumn": column, "lowerBound": str(lo), "upperBound": str(above), "numPartitions": str(parts)}
    return load(**more).select(*[F.col(c).cast(t).alias(c) for c, t in kind.items()])


def read_glossary(documents: DataFrame, column: str = "glossary") -> DataFrame:
    """(lang, term, replacement, error_code) of JSON objects {lang: {term: replacement}}; what is no such object is one error row."""
    parsed = documents.select(F.col(column).alias("_j"), F.from_json(column, "map<string,map<string,string>>").alias("m"))
    ok = F.col("m").isNotNull() & F.trim("_j").startswith("{")
    good = parsed.where(ok).select(F.explode("m").alias("lang", "terms")).where(F.col("terms").isNotNull()).select("lang", F.explode("terms").alias("term", "replacement"), F.lit(None).cast("string").alias("error_code"))
    none = F.lit(None).cast("string")
    return good.unionByName(parsed.where(~F.coalesce(ok, F.lit(False))).select(none.alias("lang"), none.alias("term"), none.alias("replacement"), F.lit("not_an_object").alias("error_code")))


def latest_cache(cache: DataFrame) -> DataFrame:
    """Latest string value of each cache_key; rows: cache_key, value, written_at."""
    return latest_wins(cache.where(F.col("value").isNotNull()), ["cache_key"], "written_at").select("cache_key", "value")


def json_list(order: str, item: Column) -> Column:
    """JSON array of a group's items in order."""
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))), lambda s: s["x"]))


def track_documents(dialogue: DataFrame, quality: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, doc, content, sha256): analysis, transcript, speakers, segments and metadata of each medium."""
    seg = F.struct("segment_index", "speaker_label", "start_ms", "end_ms", "text")
    w = dialogue.groupBy("media_id").agg(json_list("segment_index", seg).alias("segments"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "text"))), lambda s: s["text"]), " ").alias("transcript"))
    talk = dialogue.groupBy("media_id", "speaker_label").agg(F.count("*").alias("n_segments"), F.sum(F.col("end_ms") - F.col("start_ms")).cast("long").alias("talk_ms"))
    speakers = talk.groupBy("media_id").agg(json_list("speaker_label", F.struct("speaker_label", "n_segments", "talk_ms")).alias("speakers"))
    rows = media.join(w, "media_id", "left").join(speakers, "media_id", "left").join(quality.select("media_id", "score", "level"), "media_id", "left")
    empty = lambda c: F.coalesce(c, F.lit("[]"))
    docs = {
        "analysis": F.to_json(F.struct("media_id", "score", "level")), "transcript": F.to_json(F.struct("media_id", F.coalesce("transcript", F.lit("")).alias("text"))),
        "speakers": empty("speakers"), "segments": empty("segments"), "metadata": F.to_json(F.struct("media_id", "duration_ms")),
    }
    out = rows.select("media_id", F.explode(F.array(*[F.struct(F.lit(d).alias("doc"), c.alias("content")) for d, c in docs.items()])).alias("d"))
    return out.select("media_id", "d.doc", "d.content", F.sha2("d.content", 256).alias("sha256"))


def write_documents(documents: DataFrame, path: str) -> DataFrame:
    """Write documents as text, one folder a kind, and give the manifest (media_id, doc, sha256)."""
    documents.select("doc", "content").repartition("doc").write.mode("overwrite").partitionBy("doc").text(path)
    return documents.select("media_id", "doc", "sha256")


def translation_documents(translations: DataFrame) -> DataFrame:
    """(media_id, target_lang, content, sha256): segments with their checks, and a summary, of checked translations."""
    seg = F.struct("segment_index", "start_ms", "end_ms", "text", "adapted_text", "ok", "errors", "warnings")
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col("segment_index").alias("o"), seg.alias("x")))), lambda s: s["x"])
    docs = translations.groupBy("media_id", "source_lang", "target_lang").agg(items.alias("segments"), F.count("*").alias("n_segments"), F.count_if("ok").alias("n_ok"))
    content = F.to_json(F.struct("media_id", "source_lang", "target_lang", "n_segments", "n_ok", "segments"))
    return docs.select("media_id", "target_lang", content.alias("content"), F.sha2(content, 256).alias("sha256"))


def write_exports(cues: DataFrame, path: str) -> DataFrame:
    """Write every track in every format, partitioned by format and language, and give the manifest of names and hashes."""
    out = export_all(cues)
    out.select("format", "language", "content").write.mode("overwrite").option("lineSep", "\n").partitionBy("format", "language").text(path)
    return out.select("media_id", "language", "format", "file_name", F.sha2("content", 256).alias("sha256"))


def manifest_check(written: DataFrame, expected: DataFrame) -> DataFrame:
    """(media_id, n_files, n_names, n_hashes, missing, ok): written files against the expected (media_id, doc)."""
    got = written.groupBy("media_id").agg(F.count("*").alias("n_files"), F.count_distinct("doc").alias("n_names"), F.count("sha256").alias("n_hashes"))
    lost = expected.join(written.select("media_id", "doc"), ["media_id", "doc"], "left_anti").groupBy("media_id").agg(F.count("*").alias("missing"))
    out = expected.select("media_id").distinct().join(got, "media_id", "left").join(lost, "media_id", "left").na.fill(0)
    return out.withColumn("ok", (F.col("n_files") > 0) & (F.col("n_files") == F.col("n_names")) & (F.col("n_files") == F.col("n_hashes")) & (F.col("missing") == 0))
