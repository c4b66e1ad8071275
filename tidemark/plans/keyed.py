"""Queries on detector logs, documents of other programs, keyed records and review rounds, with their SQL.

Log lines and JSON documents are made from ``events`` and ``orders``; SQL makes the same lines and reads them in its own way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cues as C
from tidemark.functions import names
from tidemark.functions import text as T
from tidemark.operators import cleaning, likeness, records, rounds, rules
from tidemark.plans.catalog import CUES, DEC, REL, SUG, query
from tidemark.sources import logs, writers
from tidemark.storage import shared_dir

#: Seconds with two decimals of a whole number of hundredths, in Spark's and in DuckDB's words.
_AT = "concat(cast(({0}) div 100 as string), '.', lpad(cast(({0}) % 100 as string), 2, '0'))"
_SQL_AT = "(({0}) // 100) || '.' || lpad((({0}) % 100)::varchar, 2, '0')"
_NUMBERED = f"{REL}, n as (select grp, seg_id, s // 10000 as a, e // 10000 as b, cents, text, row_number() over (partition by grp order by s, seg_id) as i from rel)"


def lines(t, text: str) -> DataFrame:
    """A line of log for each cue: grp, i and value, from start a and end b in hundredths, cents and text."""
    rows = t.relative().selectExpr("grp", "seg_id", "s div 10000 as a", "e div 10000 as b", "cents", "text", "row_number() over (partition by grp order by s, seg_id) as i")
    return rows.withColumn("value", F.expr(text))


def at(x: str) -> str:
    return _AT.format(x)


def sql_at(x: str) -> str:
    return _SQL_AT.format(x)


@query(f"with {_NUMBERED} select grp, a * 10000 as t from n where i % 3 <> 0")
def log_scenes(t):
    return logs.scene_cuts(lines(t, f"case when i % 3 = 0 then 'frame only' else concat('n:1 pts_time:', {at('a')}, ' pos:9') end"), ["grp"])


@query(f"with {_NUMBERED} select grp, a * 10000 as s, b * 10000 as e, (b - a) * 10000 as dur from n where i % 4 <> 0")
def log_black(t):
    return logs.black_segments(lines(t, f"concat('[blackdetect] black_start:', {at('a')}, case when i % 4 = 0 then '' else concat(' black_end:', {at('b')}) end, ' black_duration:', {at('b - a')})"), ["grp"])


@query(f"with {_NUMBERED} select grp, a * 10000 as s, b * 10000 as e from n where b > a and i % 5 <> 0")
def log_voice(t):
    return logs.voice_segments(lines(t, f"concat(case when i % 5 = 0 then 'VAD part ' else 'VAD segment ' end, i, ': start = ', {at('a')}, ', end = ', {at('b')})"), ["grp"])


_PAIRED = f"""with {_NUMBERED}, k as (select *, case when i % 3 = 1 then 'start' when i % 3 = 2 then 'end' else case when cents % 2 = 0 then 'end' else 'none' end end as kind from n), m as (select * from k where kind <> 'none'),
    g as (select *, coalesce(sum((kind = 'end')::int) over (partition by grp order by i rows between unbounded preceding and 1 preceding), 0) as grpno from m),
    h as (select *, last_value(case when kind = 'start' then a end ignore nulls) over (partition by grp, grpno order by i rows unbounded preceding) as opened from g)"""


def _paired(name: str) -> str:
    end = f"concat('{name}_end: ', {at('b')}, ' | {name}_duration: ', {at('cents')})"
    return f"case when i % 3 = 1 then concat('[x] {name}_start: ', {at('a')}) when i % 3 = 2 or cents % 2 = 0 then {end} else 'noise' end"


@query(f"{_PAIRED} select grp, greatest(coalesce(opened, b - cents), 0) * 10000 as s, b * 10000 as e from h where kind = 'end'")
def log_silence(t):
    return logs.silence_segments(lines(t, _paired("silence")), ["grp"], "i")


@query(f"{_PAIRED} select grp, greatest(coalesce(opened, b - cents), 0) * 10000 as s, b * 10000 as e, cents * 10000 as dur from h where kind = 'end'")
def log_freeze(t):
    return logs.freeze_segments(lines(t, _paired("freeze")), ["grp"], "i")


_VOLUME = f"""with {_NUMBERED}, k as (select *, case when i % 2 = 1 or cents % 7 = 0 then a end as x, case when i % 2 = 0 and cents % 7 <> 0 then case when cents % 5 = 0 then '-inf'::double else -(cents % 6000) / 100.0 end end as y from n),
    g as (select *, coalesce(sum((x is null)::int) over (partition by grp order by i rows between unbounded preceding and 1 preceding), 0) as part from k),
    h as (select *, last_value(x ignore nulls) over (partition by grp, part order by i rows unbounded preceding) as last_x from g), v as (select grp, last_x * 10000 as t, y as level from h where x is null and last_x is not null)"""


def _levels(t) -> DataFrame:
    value = f"case when i % 2 = 1 or cents % 7 = 0 then concat('frame:3 pts_time:', {at('a')}) when cents % 5 = 0 then 'lavfi.astats.Overall.RMS_level=-inf' else concat('lavfi.astats.Overall.RMS_level=-', {at('cents % 6000')}) end"
    return logs.volume_samples(lines(t, value), ["grp"], "i")


@query(f"{_VOLUME} select grp, t, case when isinf(level) then -9999 else round(level * 100)::bigint end as level from v")
def log_volume(t):
    level = F.when(F.col("level") == float("-inf"), -9999).otherwise(F.round(F.col("level") * 100)).cast("long")
    return _levels(t).select("grp", "t", level.alias("level"))


@query(
    f"""{_VOLUME}, l as (select grp, (max(t) - 1) // 86400000000 as last_w from v group by grp having max(t) > 0), w as (select grp, unnest(range(0, last_w + 1)) as w from l),
    a as (select grp, t // 86400000000 as w, avg(level) filter (where not isinf(level)) as m, max(level) filter (where not isinf(level)) as p from v group by all)
    select grp, w * 86400000000 as s, (w + 1) * 86400000000 as e, coalesce(round(m * 100)::bigint, -9999) as mean_db, coalesce(round(p * 100)::bigint, -9999) as peak_db from w left join a using (grp, w)"""
)
def log_volume_windows(t):
    cents = lambda c: F.when(F.col(c) == float("-inf"), -9999).otherwise(F.round(F.col(c) * 100)).cast("long").alias(c)
    return logs.volume_windows(_levels(t), ["grp"], 86_400_000_000).select("grp", "s", "e", cents("mean_db"), cents("peak_db"))


@query(
    f"""with {_NUMBERED}, k as (select *, case when i % 4 <> 1 then (a * case when i % 4 = 3 then 10000 else 10000 end) end as done, case when i % 4 = 1 then (cents % 90) || 'x' end as sp from n),
    f as (select *, last_value(sp ignore nulls) over (partition by grp order by i rows unbounded preceding) as speed from k)
    select grp, i, round(greatest(0, least(100, done * 100.0 / 2000000000000)) * 1000)::bigint as per_mille, speed from f where done is not null"""
)
def log_progress(t):
    value = f"case when i % 4 = 1 then concat('speed=', cents % 90, 'x') when i % 4 = 2 then concat('out_time_us=', a * 10000) when i % 4 = 3 then concat('out_time_ms=', a * 10) else concat('out_time=', a div 360000, ':', a div 6000 % 60, ':', {at('a % 6000')}) end"
    rows = logs.progress(lines(t, value), ["grp"], "i", F.lit(2_000_000_000_000))
    return rows.select("grp", "i", F.round(F.col("percent") * 1000).cast("long").alias("per_mille"), "speed")


@query(f"with {_NUMBERED} select grp, i - 1 as pos, 'seg_' || lpad(i::varchar, 3, '0') as seg_id, a * 10000 as s, b * 10000 as e, text from n")
def recogniser_documents(t):
    rows = t.relative().selectExpr("grp", "struct(s, seg_id, struct(struct(s div 10000 * 10 as from, e div 10000 * 10 as to) as offsets, concat(' ', text, ' ') as text) as x) as r")
    docs = rows.groupBy("grp").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["x"]).alias("transcription"))).alias("value"))
    return logs.whisper_segments(docs, ["grp"]).select("grp", F.col("pos").cast("long").alias("pos"), "seg_id", "s", "e", "text")


@query("select p_partkey, p_size::bigint * 1000 as size, round(p_retailprice * 1000000)::bigint as duration, 1 as tracks, case when p_size % 3 = 0 then '' else p_brand end as codec, case when p_size % 2 = 0 then p_size else 0 end as channels, p_size % 5 = 0 as is_default, p_name as subtitle_title from part")
def probe_documents(t):
    value = """to_json(struct(struct(cast(p_size * 1000 as string) as size, cast(p_retailprice as string) as duration) as format, array(
        struct(0 as index, 'AUDIO' as codec_type, case when p_size % 3 <> 0 then p_brand end as codec_name, case when p_size % 2 = 0 then p_size end as channels, struct(cast(null as string) as title) as tags, struct(case when p_size % 5 = 0 then 1 else 0 end as default) as disposition),
        struct(1 as index, 'subtitle' as codec_type, 'ass' as codec_name, cast(null as int) as channels, struct(p_name as title) as tags, struct(0 as default) as disposition)) as streams))"""
    rows = logs.probes(t.part.select("p_partkey", F.expr(value).alias("value")))
    a = F.get("audio", F.lit(0))
    return rows.select("p_partkey", "size", "duration", F.size("audio").alias("tracks"), a["codec"].alias("codec"), a["channels"].alias("channels"), a["is_default"].alias("is_default"), F.get("subtitles", F.lit(0))["title"].alias("subtitle_title"))


@query("select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, case when o_orderkey % 3 > 0 then o_orderkey else o_orderkey + 7 end as season_id, o_orderpriority as title, o_orderkey % 40 as episodes from orders where o_custkey % 9 <> 0")
def search_documents(t):
    hit = "struct(o_orderkey, struct(case when o_orderkey % 3 > 0 then o_orderkey else 0 end as season_id, o_orderkey + 7 as media_id, concat('<em>', o_orderpriority, '</em> ') as title, cast(o_orderkey % 40 as int) as ep_size) as x) as r"
    rows = t.orders.selectExpr("o_custkey", hit).groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["x"]).alias("result"))
    docs = rows.select("o_custkey", F.to_json(F.struct(F.when(F.col("o_custkey") % 9 == 0, -1).otherwise(0).alias("code"), F.struct("result").alias("data"))).alias("value"))
    return logs.search_results(docs, ["o_custkey"]).select("o_custkey", F.col("pos").cast("long").alias("pos"), "season_id", "title", F.col("episodes").cast("long").alias("episodes"))


@query(
    """with q as (select o_custkey as c, count(*) as n from orders group by 1), p as (select o_custkey as c, o_orderkey as k from orders),
    r as (select case when c % 5 = 0 and n = 1 or c % 5 = 4 and n = 1 then 'ok' when c % 5 in (0, 4) then 'request-meta-not-found' when c % 5 = 2 then 'unparseable-response-json' end as state from q where c % 5 in (0, 2, 4)),
    x as (select state from r union all select 'ok' from p where c % 5 = 1 and k % 3 <> 0 union all select 'group-row-missing' from p where c % 5 = 1 and k % 3 = 0 union all select 'group-row-id-not-found' from q where c % 5 = 1
        union all select 'custom-id-not-found' from q where c % 10 = 0 union all select 'missing-response' from p join q using (c) where not ((c % 5 = 1 and k % 3 <> 0) or (c % 5 in (0, 4) and n = 1)))
    select state, count(*) as n from x group by 1"""
)
def reply_states(t):
    requests = t.orders.select(F.col("o_custkey").cast("string").alias("custom_id"), F.col("o_orderkey").cast("string").alias("row_id"))
    rows = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")))).alias("ids"))
    plain, grouped = F.lit('{"decision": "unsure"}'), F.to_json(F.struct(F.transform(F.concat("ids", F.array(F.lit("zz"))), lambda x: F.struct(x.alias("id"), F.lit("unsure").alias("decision"))).alias("rows")))
    content = F.when(F.col("o_custkey") % 5 == 1, grouped).when(F.col("o_custkey") % 5 == 2, "no object").otherwise(plain)
    told = rows.where("o_custkey % 5 <> 3").select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("custom_id"), content.alias("content"))).alias("value"))
    strange = rows.where("o_custkey % 10 = 0").select(F.to_json(F.struct(F.concat(F.lit("x"), "o_custkey").alias("custom_id"), plain.alias("content"))).alias("value"))
    return records.ingest(requests, logs.replies(told.unionByName(strange))).groupBy(F.substring_index("state", ":", 1).alias("state")).agg(F.count(F.lit(1)).alias("n"))


_ACT = "case when d = 'suggest_new_match' and coalesce(g, '') <> '' then case when c <> '' then 'model-text-replace' else 'model-text-fill' end when d in ('reject_current_match', 'no_match') and c <> '' then 'unmatched' end"


@query(
    f"""with o as (select o_orderkey as k, {DEC} as d, {SUG} as g, case when o_orderkey % 4 = 0 then '' else o_orderstatus end as c, case when o_orderkey % 4 = 0 then 'unmatched' else 'matched' end as st, o_orderkey % 100 as conf, o_orderkey % 6 <> 5 as told from orders),
    one as (select *, case when told then {_ACT} end as act from o),
    p as (select *, coalesce(act, st) as st1, case when act = 'unmatched' then '' when act is not null then g else c end as c1,
        not told or d = 'bogus' or d = 'unsure' or (d = 'suggest_new_match' and coalesce(g, '') = '') or (conf <= 1 and conf * 100 < 60 or conf > 1 and conf < 60) as again from one)
    select k::varchar as segment_id, case when again and k % 2 = 0 then case when c1 <> '' then 'model-text-replace' else 'model-text-fill' end else st1 end as status, case when again and k % 2 = 0 then 'second ' || k else c1 end as text from p"""
)
def review_iterations(t):
    """Two rounds of replies: the second answers half of what the first leaves open."""
    key = F.col("o_orderkey").cast("string")
    base = t.orders.select(key.alias("segment_id"), F.col("o_orderpriority").alias("part"), F.expr("case when o_orderkey % 4 = 0 then 'unmatched' else 'matched' end").alias("status"), F.expr("case when o_orderkey % 4 = 0 then '' else o_orderstatus end").alias("text"))
    asked = t.orders.select(F.concat(F.lit("r"), key).alias("custom_id"), key.alias("row_id"))
    reply = lambda name, d, g, c: F.to_json(F.struct(name.alias("custom_id"), F.to_json(F.struct(d.alias("decision"), g.alias("suggested_chinese_text"), c.alias("confidence"))).alias("content"))).alias("value")
    first = t.orders.where("o_orderkey % 6 <> 5").select(reply(F.concat(F.lit("r"), key), F.expr(DEC), F.expr(SUG), (F.col("o_orderkey") % 100).cast("string")))
    second = t.orders.where("o_orderkey % 2 = 0").select(reply(F.concat(key, F.lit("#2")), F.lit("suggest_new_match"), F.concat(F.lit("second "), key), F.lit("0.9")))
    store = rounds.Store(t.spark, f"{shared_dir(t.spark)}/rounds-{uuid.uuid4().hex}")
    for told in (first, second):
        rounds.advance(store, base, asked, told)
    return rounds.current(store, base).select("segment_id", "status", "text")


@query(
    """with e as (select p_brand as entry, min(p_partkey) as pos, list(distinct split_part(p_name, ' ', 1)) || ['x' || p_brand] as titles, max(p_name) as keyword from part group by p_brand), u as (select entry, pos, unnest(titles) as title, keyword from e),
    s as (select q.p_partkey, entry, pos, max(case when title = q.p_name then 300 when contains(q.p_name, title) or contains(title, q.p_name) then 180 else 0 end) as a, max(case when keyword = q.p_name then 220 else 0 end) as b from part q, u group by all)
    select p_partkey, arg_max(entry, greatest(a, b) * 1000000 - pos) filter (where greatest(a, b) > 0) as entry from s group by p_partkey"""
)
def local_titles(t):
    entries = t.part.groupBy(F.col("p_brand").alias("entry")).agg(F.min("p_partkey").alias("pos"), F.collect_set(F.substring_index("p_name", " ", 1)).alias("titles"), F.max("p_name").alias("keyword"))
    entries = entries.withColumn("titles", F.array_append("titles", F.concat(F.lit("x"), "entry")))
    return names.local_mapping(t.part.select("p_partkey", F.col("p_name").alias("title_form")), entries, "p_partkey").select("p_partkey", "entry")


@query("select c_custkey, greatest(c_custkey * 1000000, 536870912) * case when c_custkey % 2 = 0 then 2 else 1 end + greatest(268435456, c_nationkey * 20000000) <= c_acctbal * 200000 as fits from customer")
def storage_fits(t):
    return t.customer.select("c_custkey", rules.storage_ok(F.col("c_custkey") * 1_000_000, F.col("c_acctbal") * 200_000, F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("long") * 20_000_000).alias("fits"))


@query("select o_orderkey, o_orderkey % 11 <> 0 and abs(round(o_totalprice * 100)::bigint * 40 - 500000000) <= 300000000 and o_orderkey % 3 <> 1 as good from orders")
def output_check(t):
    return t.orders.select("o_orderkey", rules.output_ok(F.col("o_orderkey") % 11 != 0, F.round(F.col("o_totalprice") * 100).cast("long") * 40, F.lit(500_000_000), F.col("o_orderkey") % 3 != 1, 300_000_000).alias("good"))


@query("select o_orderkey, case when o_totalprice > 300000 then 'dear' when o_orderstatus = 'F' then 'done' else 'odd' end as bucket, (case when o_totalprice > 300000 then 1 else 0 end + case when o_orderstatus = 'F' then 1 else 0 end + case when o_orderkey % 5 = 0 then 1 else 0 end)::int as buckets from orders where o_totalprice > 300000 or o_orderstatus = 'F' or o_orderkey % 5 = 0")
def bucket_union(t):
    rows = records.bucket_union(t.orders, [("dear", F.col("o_totalprice") > 300000), ("done", F.col("o_orderstatus") == "F"), ("odd", F.col("o_orderkey") % 5 == 0)], ["o_orderkey"])
    return rows.select("o_orderkey", "bucket", F.size("buckets").alias("buckets"))


@query("select p_partkey, case when lower(p_name) like '%red%' or lower(p_name) like '%bolt%' then true else p_size % 2 = 0 end as hidden from part")
def keyword_toggle(t):
    return records.keyword_toggle(t.part.withColumn("hidden", F.col("p_size") % 2 == 0), "p_name", ["RED", "Bolt"], "hidden", True).select("p_partkey", "hidden")


@query("select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then o_orderstatus end, case when o_orderkey % 2 = 0 then o_orderpriority end, 'none') as chosen from orders")
def option_precedence(t):
    blank = lambda n, c: F.when(F.col("o_orderkey") % n == 0, F.col(c)).otherwise(" ")
    return t.orders.select("o_orderkey", records.precedence(blank(3, "o_orderstatus"), blank(2, "o_orderpriority"), F.lit("none")).alias("chosen"))


@query("select o_orderkey from orders where o_orderstatus = 'F' and contains(lower(o_orderpriority), 'low') and o_orderdate::date = (select max(o_orderdate::date) from orders where o_orderstatus = 'F' and contains(lower(o_orderpriority), 'low'))")
def history_day(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("input"), F.col("o_orderdate").alias("started_at"))
    kept = records.history_filter(rows, "F", " LOW ")
    last = kept.agg(F.max("started_at").alias("day"))
    return records.history_filter(kept.join(last, kept.started_at >= F.to_date("day")), day=F.col("day")).select("o_orderkey")


@query("select o_custkey, o_orderstatus as part, min(o_orderkey) as first, max(o_orderkey + 5) as last, max(round(o_totalprice)::bigint) as best, count(*) as n from orders where o_totalprice >= 100000 group by 1, 2")
def candidate_scan(t):
    rows = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("part"), F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + 5).alias("e"), F.col("o_totalprice").alias("score"))).alias("c"))
    return records.candidate_scan(rows, ["o_custkey"], "c", 100000).withColumn("best", F.round("best").cast("long"))


@query("select p_partkey, 'pending' as decision, p_name as current_name, p_size as current_size, '' as notes from part")
def patch_templates(t):
    rows = records.patch_template(t.part, "p_partkey", ["p_name", "p_size"])
    return rows.select("p_partkey", "decision", F.col("current.p_name").alias("current_name"), F.col("current.p_size").alias("current_size"), "notes")


@query("select lang, count(*) as rows, round(avg(length(coalesce(text, ''))) * 1000)::bigint as mean_length, max(length(coalesce(text, '')))::int as longest from documents group by 1")
def length_stats(t):
    return records.length_stats(t.documents, ["lang"], "text").withColumn("mean_length", F.round(F.col("mean_length") * 1000).cast("long"))


@query("select source, doc_id from (select *, row_number() over (partition by source order by n_chars desc, doc_id::varchar) as r from documents) where r = 1")
def best_files(t):
    return logs.best_files(t.documents.withColumn("path", F.col("doc_id").cast("string")), ["source"], [F.col("n_chars").desc()]).select("source", "doc_id")


@query(f"with {REL}, g as (select distinct c_custkey as grp from customer) select grp, count(seg_id) as cues, coalesce(min(s), -1) as first, coalesce(max(e), -1) as last, count(case when seg_id % 3 = 0 then 1 end) as matched, count(case when seg_id % 3 <> 0 then 1 end) as unmatched from g left join rel using (grp) group by grp")
def part_metadata(t):
    parts = t.customer.select(F.col("c_custkey").alias("grp"))
    return logs.metadata_probe(t.relative(), parts, ["grp"], t.cues().where("seg_id % 3 = 0")).fillna(-1, ["first", "last"])


@query(f"with {REL} select grp, string_agg('file ''clip''\\''''' || seg_id || '''' || chr(10) || 'inpoint ' || printf('%d.%06d', s // 1000000, s % 1000000) || chr(10) || 'outpoint ' || printf('%d.%06d', e // 1000000, e % 1000000), chr(10) order by s, seg_id) as listing from rel group by grp")
def concat_listing(t):
    return writers.concat_list(t.relative().withColumn("path", F.concat(F.lit("clip'"), F.col("seg_id").cast("string"))), ["grp"], "path")


@query(
    """with x as (select p_partkey, p_brand, regexp_replace(p_name, '\\s+', '', 'g') as a, regexp_replace(p_type || ' ' || p_name, '\\s+', '', 'g') as b, p_size from part), y as (select *, greatest(0, 1 - levenshtein(a, b)::double / greatest(length(a), length(b))) as acc from x where p_size % 4 <> 0)
    select p_brand, p_partkey, rank, round(acc * 1000000)::bigint as accuracy from (select *, row_number() over (partition by p_brand order by acc, p_partkey) as rank from y) where rank <= 3"""
)
def worst_items(t):
    items = t.part.select("p_partkey", "p_brand", F.col("p_name").alias("text"), F.expr("case when p_size % 4 = 0 then ' ' else concat(p_type, ' ', p_name) end").alias("reference_text"))
    return cleaning.worst_items(items, ["p_brand"], "p_partkey", 3).select("p_brand", "p_partkey", "rank", F.round(F.col("char_accuracy") * 1_000_000).cast("long").alias("accuracy"))


@query("select doc_id, replace(replace(text, 'a', 'e'), 'ee', 'i') as folded, len(regexp_extract_all(trim(regexp_replace(replace(replace(text, '|', '丨'), '…', '...'), '[\\s\\x0b\\x{85}\\x{a0}]+', ' ', 'g')), '[：:]')) >= 2 or len(regexp_extract_all(text, '[。！?？]')) >= 2 as multi from documents")
def folded_texts(t):
    return t.documents.select("doc_id", T.fold_replace(F.col("text"), [("a", "e"), ("ee", "i")]).alias("folded"), C.multi_part(F.col("text")).alias("multi"))


@query("select l_orderkey, l_linenumber, round(least(greatest(l_quantity, 2.5), greatest(l_tax * 100, 2.5)) / greatest(greatest(l_quantity, 2.5), greatest(l_tax * 100, 2.5)) * 1000000)::bigint as ratio, round(greatest(0, 1 - abs(l_discount - l_tax) / 0.05) * 1000000)::bigint as near from lineitem")
def duration_and_progress(t):
    ratio, near = C.duration_ratio(F.col("l_quantity"), F.col("l_tax") * 100, 2.5), C.progress_score(F.col("l_discount"), F.col("l_tax"), 0.05)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(ratio * 1_000_000).cast("long").alias("ratio"), F.round(near * 1_000_000).cast("long").alias("near"))


@query("select l_orderkey, l_linenumber, round(l_quantity * 1000)::bigint as speed, case when l_quantity > 1 then greatest(ceil(log2(l_quantity) - 1e-12)::int - 1, 0) else 0 end + 1 as factors from lineitem")
def tempo_factors(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", records.atempo_factors(F.col("l_quantity")).alias("f"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.aggregate("f", F.lit(1.0), lambda a, x: a * x) * 1000).cast("long").alias("speed"), F.size("f").alias("factors"))


@query("select c_custkey, case when c_nationkey between 1 and 20 then c_nationkey else 7 end as nation, case when length(c_name) > 3 then c_name else 'none' end as name, 'fresh' as added from customer")
def settings_defaults(t):
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    return records.with_defaults(rows, {"nation": (7, lambda c: c.between(1, 20)), "name": ("none", lambda c: F.length(c) > 3), "added": ("fresh", lambda c: c.isNotNull())})


@query("select o_custkey, case when o_orderkey = 0 then -1 else o_orderkey end as episode_id, case when o_orderkey % 3 = 0 then 0 else o_orderkey % 3 end::int as section, case when o_orderkey % 5 = 0 then -1 else o_linenumber end::int as number, o_orderkey + 1 as cid from (select *, row_number() over (partition by o_custkey order by o_orderkey) as o_linenumber from orders) where o_custkey % 8 <> 0")
def season_documents(t):
    e = "struct(o_orderkey as id, o_orderkey + 1 as cid, concat(case when o_orderkey % 5 = 0 then 'SP' else '' end, row_number() over (partition by o_custkey order by o_orderkey), ' ') as title) as e"
    rows = t.orders.selectExpr("o_custkey", "o_orderkey % 3 as k", e)
    some = lambda k: F.sort_array(F.collect_list(F.when(F.col("k") == k, F.col("e"))))
    season = F.struct(F.first("o_custkey").alias("season_id"), some(0).alias("episodes"), F.array(F.struct(some(1).alias("episodes")), F.struct(some(2).alias("episodes"))).alias("section"))
    docs = rows.groupBy("o_custkey").agg(season.alias("result")).select("o_custkey", F.to_json(F.struct(F.when(F.col("o_custkey") % 8 == 0, -404).otherwise(0).alias("code"), "result")).alias("value"))
    return logs.season_episodes(docs, ["o_custkey"]).select("o_custkey", "episode_id", "section", "number", "cid").fillna(-1, ["episode_id", "number"])


@query()
def like_parts(t):
    """Parts of like descriptions: pairs of different texts."""
    rows = t.part.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return likeness.similar_texts(rows, rows, 0.95).where("text_a < text_b")


_STATES = "case o_orderkey % 9 when 0 then 'Failed' when 1 then 'Skipped' else 'Success' end"


@query(f"with s as (select {_STATES} as state from orders) select count(case when state = 'Success' then 1 end) as success, count(case when state = 'Skipped' then 1 end) as skipped, count(case when state = 'Failed' then 1 end) as failed, 0::bigint as cancelled, 0::bigint as pending, 1 as code from s")
def exit_code(t):
    return records.exit_code(t.orders.select(F.expr(_STATES).alias("state")), "state")


@query(f"with {CUES}, n as (select *, row_number() over (partition by grp order by s, seg_id) as pos from cues), k as (select grp, seg_id as card, pos as first, pos + 1 as last from n where text = 'error') select grp, card, n.pos, case when n.pos < first then 'before' when n.pos > last then 'after' else 'focus' end as role, n.text from k join n using (grp) where n.pos between first - 2 and last + 2")
def context_cards(t):
    rows = t.cues().selectExpr("grp", "seg_id", "text", "row_number() over (partition by grp order by s, seg_id) as pos")
    spans = rows.where("text = 'error'").select("grp", F.col("seg_id").alias("card"), F.col("pos").alias("first"), (F.col("pos") + 1).alias("last"))
    return records.context_cards(spans, rows, ["grp"], 2).select("grp", "card", F.col("pos").cast("long").alias("pos"), "role", "text")


@query("with c as (select o_custkey, max(o_orderkey) as v from orders where o_orderdate > (select max(o_orderdate) from orders) - interval 400 days group by 1) select c_custkey, arg_max(o_orderkey, o_orderdate) as value from customer join orders on o_custkey = c_custkey where o_orderdate + interval 400 days > (select max(o_orderdate) from orders) group by 1 having count(*) = count(distinct o_orderdate)")
def cache_hits(t):
    newest = t.orders.agg(F.max("o_orderdate").alias("now"))
    cache = t.orders.join(newest, F.col("o_orderdate") <= F.col("now"))
    once = cache.where("o_orderdate + interval 400 days > now").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderdate").alias("d")).where("n = d").select("o_custkey")
    stored_ = cache.join(once, "o_custkey").select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderdate").alias("stored_at"), "now")
    hits, _ = logs.cached(t.customer.select("c_custkey"), stored_, F.col("c_custkey"), F.col("now"), 400)
    return hits.select("c_custkey", "value")


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as number, o_orderkey + 9 as duration from orders where o_orderkey % 4 <> 0")
def delivery_matched(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.lit(0).cast("long").alias("s"), (F.col("o_orderkey") + 9).alias("e"), F.expr("case when o_orderkey % 4 = 0 then 'unmatched' else 'matched' end").alias("status"))
    return records.delivery(rows, ["o_custkey"], ["o_orderkey"])[0].select("o_custkey", "o_orderkey", "number", "duration")


@query(f"with {REL} select grp, seg_id, greatest(coalesce(t0, 0), 0) as t0 from (select grp, seg_id, s - 5000000 as t0 from rel)")
def clamped_starts(t):
    return t.relative().select("grp", "seg_id", C.clamp(F.col("s") - 5_000_000, 0, 1 << 62).cast("long").alias("t0"))


@query(
    """with x as (select role, coalesce(text, '') as t, 0.5 + (turn % 5) / 10.0 as conf from conversations), y as (select role, t, conf, trim(t, ' ') <> '' as found, length(replace(t, chr(10), '')) as len,
    length(regexp_replace(t, '[\\s]', '', 'g')) as bare, length(regexp_replace(t, '[^A-Za-z.,!?;:''"()-]', '', 'g')) as latin from x)
    select role, count(*) as samples, count(case when found then 1 end) as detected, round((count(case when found then 1 end) / count(*) * 0.4 + avg(conf) filter (where found) * 0.3 + avg(latin / bare) filter (where found) * 0.2 + least(1, avg(len) filter (where found) / 14.0) * 0.1) * 100000)::bigint as score from y group by role"""
)
def profile_scores(t):
    rows = t.conversations.select("role", "text", (0.5 + (F.col("turn") % 5) / 10).alias("conf"))
    return cleaning.profile_score(rows, ["role"], "en").select("role", "samples", "detected", F.round(F.col("score") * 100_000).cast("long").alias("score"))


@query("with x as (select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from conversations where turn % 3 <> 0), y as (select *, replace(t, ' ', '') as bare from x) select conv_id, turn from y where length(bare) >= 3 and regexp_matches(t, '[A-Za-z]') and length(regexp_replace(bare, '[^A-Za-z.,!?;:''\"()-]', '', 'g')) / length(bare) >= 0.45")
def subtitle_lines(t):
    rows = t.conversations.withColumn("conf", F.when(F.col("turn") % 3 == 0, 0.2).otherwise(0.9))
    return cleaning.subtitle_lines(rows, 0.5, "en").select("conv_id", "turn")


