"""DuckDB SQL for the queries that SQL can express. Hashing, tokenizing, fitted models and spans with offsets are not among them."""

from __future__ import annotations

from tracklake.llm import mixing, quality_rules

WORDS = r"words as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents) t)"

SUBSTRING_DEDUP = f"""
with {WORDS}, win as (select doc_id, i, w, string_agg(w, ' ') over f as g, count(*) over f as n from words window f as (partition by doc_id order by i rows between current row and 19 following)),
 later as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as r from win where n = 20) x where r > 1),
 gone as (select distinct doc_id, i + k as i from later, range(0, 20) t(k)),
 kept as (select words.doc_id, count(*) as n_words, count(gone.i) as n_removed, string_agg(w, ' ' order by words.i) filter (where gone.i is null) as kept from words left join gone using (doc_id, i) group by 1)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join kept using (doc_id)"""


def spans(table: str, key: str, name: str) -> str:
    """Words of a table as (key, w, i), A-Z lower-cased."""
    find = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"{name} as (select {key}, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from (select {key}, {find} as ws from {table}) t)"


def grams(name: str, key: str) -> str:
    """(key, i, n, g): the n words from place i, for n from 1 to 10."""
    parts = [f"select {key}, i, {n} as n, string_agg(w, ' ') over f as g, count(*) over f as c from {name} window f as (partition by {key} order by i rows between current row and {n - 1} following)" for n in range(1, 11)]
    return f"(select * from ({' union all '.join(parts)}) u where c = n)"


DECONTAMINATION = f"""
with {spans("benchmark", "item_id", "iw")}, {spans("documents", "doc_id", "dw")}, size as (select item_id, count(*) as n_words from iw group by 1),
 windows as (select distinct item_id, n, g from {grams("iw", "item_id")} x join size using (item_id) where n = least(10, n_words)),
 hits as (select doc_id, i, n, g from {grams("dw", "doc_id")} x where g in (select g from windows) and (n, g) in (select (n, g) from windows)),
 hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) x group by 1),
 ids as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits join windows using (n, g)) x group by 1),
 total as (select doc_id, count(*) as n_words from dw group by 1)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from documents left join total using (doc_id) left join hit using (doc_id) left join ids using (doc_id)"""


def quality() -> str:
    """Base counts, common words, then both histograms as rows, references by language, and distances to the nearest.

    Classes of documents without a lang are compared as they are: the given tables have none.
    """
    removed = [r"\p{Ll}+", r"\p{Lu}+", r"[\x20\x09-\x0D]+", "[0-9]+", """[.,;:!?''"()-]+""", r"[\p{Lo}\p{Lm}\p{Lt}\p{M}]+"]
    left = ["coalesce(text, '')"]
    for p in removed:
        left.append(f"regexp_replace({left[-1]}, '{p}', '', 'g')")
    classes = ", ".join([*(f"length({a}) - length({b})" for a, b in zip(left, left[1:], strict=False)), f"length({left[-1]})"])
    return rf"""
with {WORDS}, grams as (select doc_id, i, string_agg(w, ' ') over f as g, count(*) over f as n from words window f as (partition by doc_id order by i rows between current row and 2 following)),
 twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams where n = 3) x where c > 1),
 covered as (select doc_id, count(distinct i + k) as n_repeat_words from twice, range(0, 3) t(k) group by 1),
 counts as (select doc_id, count(*) as n_words, cast(sum(length(w)) as bigint) as word_chars from words group by 1),
 lines as (select doc_id, count(*) - count(distinct l) as n_dup_lines from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l from documents) x where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1),
 base as (select doc_id, lang, text, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from documents left join counts using (doc_id) left join lines using (doc_id) left join covered using (doc_id)),
 failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base),
 held as (select lang, w, count(distinct doc_id) as n from words join documents using (doc_id) where lang is not null and regexp_matches(w, '^\p{{L}}+$') group by 1, 2),
 own as (select lang, w from (select lang, w, row_number() over (partition by lang order by n desc, w) as r from held) x where r <= {quality_rules.TOP_WORDS}), vocabulary as (select distinct w from own),
 speaks as (select doc_id from words join documents using (doc_id) join own using (lang, w) join counts using (doc_id) group by doc_id having count(distinct w) >= {quality_rules.SPOKEN_WORDS} and 100 * count(*) >= {quality_rules.SPOKEN_SHARE} * any_value(n_words)),
 cls as (select doc_id, 0 as h, cast(unnest(range(0, 7)) as varchar) as i, unnest([{classes}]) as c from documents),
 seen as (select doc_id, w, count(*) as c from words where w in (select w from vocabulary) group by 1, 2),
 rest as (select doc_id, count(*) as n from words where w not in (select w from vocabulary) group by 1),
 com as (select doc_id, 1 as h, v.w as i, coalesce(c, 0) as c from (select doc_id, w from documents, vocabulary) v left join seen using (doc_id, w) union all select doc_id, 1, '', coalesce(n, 0) from documents left join rest using (doc_id)),
 hist as (select * from cls union all select * from com), part as (select *, sum(c) over (partition by doc_id, h) as t from hist),
 spoken as (select * from failed where lang is not null and not base_failed and doc_id in (select doc_id from speaks)),
 known as (select lang from spoken group by 1 having sum(n_words) >= {quality_rules.MIN_REFERENCE}),
 ref0 as (select lang, h, i, sum(c) as c from hist join spoken using (doc_id) where lang in (select lang from known) group by 1, 2, 3), ref as (select lang, h, i, c / cast(sum(c) over (partition by lang, h) as double) as q from ref0),
 each as (select doc_id, lang, h, max(t) as t, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2 as d
  from (select doc_id, r.lang, h, t, case when t > 0 then c / cast(t as double) else 0 end as p, q from part join ref r using (h, i)) x group by 1, 2, 3),
 near as (select doc_id, min(case when h = 0 then dist end) as dc, min(case when h = 1 then dist end) as dw from (select *, case when t > 0 then sqrt(greatest(d, 0)) else 1 end as dist from each) e group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and not (lang in (select lang from known) and (coalesce(length(text) >= {quality_rules.MIN_CHARS} and dc > {quality_rules.MAX_CLASS_DISTANCE}, false) or coalesce(n_words >= {quality_rules.MIN_WORDS} and dw > {quality_rules.MAX_WORD_DISTANCE}, false))) as kept
from failed left join near using (doc_id)"""


#: Every source at its own share of the blocks. `had` is the blocks that each source has had before slot t.
MIXING = f"""
with recursive src as (select doc_id, source, coalesce(source, ' none') as s from documents),
 size as (select greatest({mixing.BLOCK_ROWS}, cast(ceil(count(*) / {mixing.MOST_SLOTS}e0) as bigint)) as b from documents),
 n as (select s, row_number() over (order by s) - 1 as k, (count(*) + any_value(b) - 1) // any_value(b) as blocks from src, size group by s),
 shares as (select list(blocks // g order by k) as w, cast(sum(blocks // g) as bigint) as q from n, (select list_reduce(list(blocks), lambda x, y: gcd(x, y)) as g from n) d),
 slot as (select cast(0 as bigint) as t, list_transform(w, lambda x: cast(0 as bigint)) as had, cast(-1 as bigint) as pick from shares
  union all select t + 1, list_transform(had, lambda h, i: h + case when i - 1 = p then 1 else 0 end), p from (
   select t, had, list_min(list_filter(list_transform(w, lambda x, i: case when had[i] * q // x <= t then {{'d': ((had[i] + 1) * q + x - 1) // x, 'k': i - 1}} end), lambda c: c is not null)).k as p from slot, shares where t < q) x),
 period as (select pick as k, row_number() over (partition by pick order by t) - 1 as j, t - 1 as slot from slot where t > 0),
 ranked as (select doc_id, source, s, row_number() over (partition by s order by substr(md5(cast(doc_id as varchar)), 1, 3), doc_id) - 1 as rank from src),
 b as (select doc_id, source, rank, rank // b as block, q, k, w[k + 1] as w from ranked join n using (s), size, shares)
select doc_id, source, rank, block, block // w * q + slot as slot, block * q // w as release, ((block + 1) * q + w - 1) // w as deadline, true as mixed from b join period on b.k = period.k and block % w = j"""

FILTER_AUDIT = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
 marks as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
 fails as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, case when len(ws) < 100 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 'B' else '' end
  || case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as failed from t left join marks using (doc_id)),
 sets as (select part, failed, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from fails group by 1, 2),
 l as (select unnest(['A', 'B', 'C', 'D', 'E']) as l), orders as (select string_agg(x.l, '' order by i) as filter_order from (select row_number() over () as o, [a.l, b.l, c.l, d.l, e.l] as x from l a, l b, l c, l d, l e) y, unnest(x) with ordinality as x(l, i) group by o having count(distinct x.l) = 5),
 steps as (select part, filter_order, step, filter_order[step] as f, filter_order[1:step - 1] as before from (select distinct part from sets) p, orders, range(1, 6) r(step)),
 each as (select part, filter_order, step, f, failed, n, good, toxic, contains(failed, f) as fails, translate(failed, before, '') = failed as alive from steps join sets using (part)),
 rows as (select part, filter_order, step, f, cast(coalesce(sum(n) filter (where alive and not fails), 0) as bigint) as kept, cast(coalesce(sum(n) filter (where alive and fails), 0) as bigint) as removed, cast(coalesce(sum(n) filter (where fails and not alive), 0) as bigint) as redundant,
  cast(coalesce(sum(n) filter (where failed = f), 0) as bigint) as unique_fails, cast(coalesce(sum(good) filter (where alive and fails), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (where alive and fails), 0) as bigint) as toxic_lost from each group by 1, 2, 3, 4)
select part, filter_order, cast(step as integer) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from rows"""

ORACLES: dict[str, str] = {
    "op3_source_mixing": MIXING,
    "op4_substring_dedup": SUBSTRING_DEDUP,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op9_quality_rules": quality(),
    "op11_filter_audit": FILTER_AUDIT,
}
