"""Timeline views over the given tables: inputs of the queries and of the bench.

Each is plain SQL that Spark and DuckDB run alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "fx_segments": """
select media_id, segment_index, speaker_label, text, start_ms, start_ms + dur_ms as end_ms, conf_pct
from (
  select *, cast(1000 + coalesce(sum(dur_ms + gap_ms) over (partition by media_id order by segment_index
           rows between unbounded preceding and 1 preceding), 0) as bigint) as start_ms
  from (
    select conv_id as media_id, turn as segment_index,
           case role when 'system' then 'SPEAKER_00' when 'user' then 'SPEAKER_01' else 'SPEAKER_02' end as speaker_label,
           text,
           cast(400 + length(text) * 4 as bigint) as dur_ms,
           cast(case when conv_id % 3 = 0 then ((conv_id * 31 + turn * 17) % 7 - 2) * 150
                     else ((conv_id * 31 + turn * 17) % 5 + 1) * 150 end as bigint) as gap_ms,
           cast((conv_id * 13 + turn * 29) % 100 as bigint) as conf_pct
    from conversations) a) b""",
    "fx_turns": """
select media_id, cast(row_number() over (partition by media_id order by start_ms, end_ms, speaker_label) - 1 as bigint) as turn_index,
       speaker_label, start_ms, end_ms, conf_pct
from (
  select media_id, speaker_label, greatest(cast(0 as bigint), start_ms - 180) as start_ms,
         cast(end_ms - ((segment_index * 37) % 5) * 120 as bigint) as end_ms,
         cast(50 + (media_id * 7 + segment_index * 13) % 50 as bigint) as conf_pct
  from fx_segments where (media_id + segment_index) % 9 <> 0) t
where end_ms > start_ms""",
    "fx_media": """
select media_id, cast(max(end_ms) + 500 as bigint) as duration_ms from fx_segments group by media_id""",
    "fx_frames": """
select user_id as media_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_index,
       least(value / 100.0e0, 1.0e0) as prob
from events""",
    "fx_intervals": """
select media_id, cast(row_number() over (partition by media_id order by start_ms, end_ms, a, b, c) - 1 as bigint) as idx,
       label, start_ms, end_ms, conf_pct
from (
  select l_orderkey as media_id, l_partkey as a, l_suppkey as b, l_extendedprice as c,
         concat('SPEAKER_0', cast(l_suppkey % 4 as varchar(1))) as label,
         cast(l_linenumber * 700 + (l_partkey % 13) * 90 as bigint) as start_ms,
         cast(l_linenumber * 700 + (l_partkey % 13) * 90 + l_quantity * 40 as bigint) as end_ms,
         cast(round(l_discount * 1000) as bigint) as conf_pct
  from lineitem) t""",
    "fx_logits": """
select doc_id, lang, cast(n_chars % 11 as double) as l0, cast(n_chars % 7 as double) as l1, cast(n_chars % 5 as double) as l2 from documents""",
    "fx_subsegments": """
select cast(floor(vec_id / 100) as bigint) as media_id, vec_id % 100 as seq, cast(vec_id % 100 * 750 as bigint) as start_ms, cast(vec_id % 100 * 750 + 1500 as bigint) as end_ms,
       case when label >= 7 then -1 else label end as seed_label, embedding
from embeddings""",
    "fx_chunks": """
select user_id as session_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as seq,
       case when event_type = 'signup' and event_id % 10 = 0 then 'seek' else 'audio' end as kind,
       cast(floor(extract(day from ts) / 10) as bigint) as epoch,
       cast(200 * (row_number() over (partition by user_id order by ts, event_id) - 1) as bigint) as time_ms,
       case when event_type in ('view', 'error') then 0.0e0 else value / 500.0e0 end as rms,
       cast(3200 as bigint) as n_samples
from events""",
    "fx_jobs": """
select o_orderkey as job_id, o_custkey as project_id, o_custkey % 10 as user_id,
       case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'QUEUED' else 'TRANSCRIBING' end as status,
       o_orderdate as created_at,
       case when o_orderkey % 4 = 0 then '' else concat('owner-', cast(o_custkey % 3 as varchar(1))) end as claimed_by,
       cast(o_orderkey % 120 as bigint) as heartbeat_age_s
from orders""",
    "fx_coverage": """
select media_id, case when label in ('SPEAKER_00', 'SPEAKER_01') then 'en' else 'es' end as language, start_ms, end_ms from fx_intervals""",
}


def needed(sql: str) -> list[str]:
    """Views that a statement names, those they stand on first."""
    out: list[str] = []
    for name in re.findall(r"\bfx_\w+", sql):
        if name in VIEWS and name not in out:
            out += [x for x in [*needed(VIEWS[name]), name] if x not in out]
    return out


def with_views(sql: str) -> str:
    """A statement with the views it names as common table expressions."""
    views = ", ".join(f"{v} as ({VIEWS[v]})" for v in needed(sql))
    if not views:
        return sql
    sql = sql.strip()
    return f"with recursive {views}, {sql[len('with recursive '):]}" if sql.startswith("with recursive ") else f"with {views}, {sql[5:]}" if sql.startswith("with ") else f"with {views} {sql}"


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the given tables and the views."""
    text = with_views(sql)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f"select * from {name}")
