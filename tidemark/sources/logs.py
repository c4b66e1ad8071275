"""Detector logs, probe and recogniser output, replies and caches as tables: Spark's readers and column expressions.

``lines`` has the file's keys (by), an order and the line in ``value``. Times become microseconds; a level that can't be
read is minus infinity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.operators.intervals import pair_start_end
from tidemark.sources.readers import _us

By = list[str]
NUMBER = r"(-?\d+(?:\.\d+)?)"


def _number(line: str | Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit("")).try_cast("double")


def scene_cuts(lines: DataFrame, by: By) -> DataFrame:
    """Times of scene changes, from 0."""
    rows = lines.select(*by, _number("value", "pts_time:" + NUMBER).alias("x")).where("x is not null")
    return rows.select(*by, F.greatest(_us(F.col("x")), F.lit(0).cast("long")).alias("t"))


def black_segments(lines: DataFrame, by: By) -> DataFrame:
    """Black stretches from lines that hold start, end and duration."""
    at = {c: _number("value", f"black_{c}:{NUMBER}") for c in ("start", "end", "duration")}
    rows = lines.select(*by, *(x.alias(c) for c, x in at.items())).where("start is not null and end is not null and duration is not null")
    return rows.select(*by, *(F.greatest(_us(F.col(c)), F.lit(0).cast("long")).alias(n) for c, n in (("start", "s"), ("end", "e"), ("duration", "dur"))))


def _pairs(lines: DataFrame, by: By, order: str, name: str) -> DataFrame:
    a, b, d = (_number("value", rf"{name}_{x}:\s*{NUMBER}") for x in ("start", "end", "duration"))
    rows = lines.select(*by, order, a.alias("a"), b.alias("b"), d.alias("d")).where("a is not null or (b is not null and d is not null)")
    kind = F.when(F.col("a").isNotNull(), "start").otherwise("end")
    return rows.select(*by, order, kind.alias("kind"), _us(F.coalesce("a", "b")).alias("t"), _us(F.coalesce("d", F.lit(0.0))).alias("dur"))


def freeze_segments(lines: DataFrame, by: By, order: str) -> DataFrame:
    """Frozen stretches: an end closes the last start since the end before it, or reaches back by its duration."""
    out = pair_start_end(_pairs(lines, by, order, "freeze"), by, order)
    return out.select(*by, "s", "e", F.greatest("dur", F.lit(0)).alias("dur"))


def volume_samples(lines: DataFrame, by: By, order: str) -> DataFrame:
    """(t, level) of level lines: each takes the last time since the level before it; without one it is dropped."""
    level = F.regexp_extract("value", r"RMS_level=(-?\d+(?:\.\d+)?|-inf)", 1)
    rows = lines.select(*by, order, _number("value", "pts_time:" + NUMBER).alias("x"), level.alias("y")).where("x is not null or y <> ''")
    w = Window.partitionBy(*by).orderBy(order)
    used = F.coalesce(F.sum(F.when(F.col("x").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_k", used)
    own = Window.partitionBy(*by, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_t", F.last("x", ignorenulls=True).over(own)).where("x is null and _t is not null")
    return rows.select(*by, _us(F.col("_t")).alias("t"), F.coalesce(F.col("y").try_cast("double"), F.lit(float("-inf"))).alias("level"))


def volume_windows(samples: DataFrame, by: By, width: int) -> DataFrame:
    """Mean and peak level in windows of ``width`` that begin before the last sample; minus infinity where nothing is heard."""
    heard = F.when(F.col("level") > float("-inf"), F.col("level"))
    last = samples.groupBy(*by).agg(F.max("t").alias("_last")).where("_last > 0")
    spine = last.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_last - 1) div {width}")))).drop("_last")
    sums = samples.groupBy(*by, F.expr(f"t div {width}").alias("w")).agg(F.avg(heard).alias("mean_db"), F.max(heard).alias("peak_db"))
    silent = F.lit(float("-inf"))
    return spine.join(sums, [*by, "w"], "left").select(*by, (F.col("w") * width).alias("s"), ((F.col("w") + 1) * width).alias("e"), F.coalesce("mean_db", silent).alias("mean_db"), F.coalesce("peak_db", silent).alias("peak_db"))


def voice_segments(lines: DataFrame, by: By) -> DataFrame:
    """Voice activity that lasts."""
    at = lambda i: _number("value", r"VAD segment \d+: start = (\d+(?:\.\d+)?), end = (\d+(?:\.\d+)?)", i)
    return lines.select(*by, _us(at(1)).alias("s"), _us(at(2)).alias("e")).where("e > s")


def progress(lines: DataFrame, by: By, order: str, total: Column) -> DataFrame:
    """Percent done of progress lines, 0 to 100, with the last speed told before; ``total`` in microseconds, 0: unknown."""
    clock = r"^out_time=(\d+):(\d+):(\d+(?:\.\d+)?)"
    hms = (_number("value", clock) * 3600 + _number("value", clock, 2) * 60 + _number("value", clock, 3)) * 1e6
    done = F.coalesce(_number("value", r"^out_time_us=(-?[0-9.]+)$"), _number("value", r"^out_time_ms=(-?[0-9.]+)$") * 1000, hms)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_done", done).withColumn("speed", F.last(F.nullif(F.regexp_extract("value", "^speed=(.*)$", 1), F.lit("")), ignorenulls=True).over(w))
    percent = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_done") * 100 / total))).otherwise(F.lit(0.0))
    return rows.where("_done is not null").select(*by, order, percent.alias("percent"), "speed")


def silence_segments(lines: DataFrame, by: By, order: str) -> DataFrame:
    return pair_start_end(_pairs(lines, by, order, "silence"), by, order).select(*by, "s", "e")


_PROBE = """format struct<size: string, duration: string>, streams array<struct<index: int, codec_type: string, codec_name: string, channels: int, channel_layout: string,
    sample_rate: string, bit_rate: string, tags: struct<title: string, language: string>, disposition: struct<`default`: int>>>"""


def probes(texts: DataFrame, column: str = "value") -> DataFrame:
    """Size, duration, audio and subtitle tracks of probe documents; numbers that can't be read are 0, texts '';
    without streams both lists are null."""
    rows = texts.withColumn("_p", F.from_json(column, _PROBE))
    text = lambda c: F.coalesce(c, F.lit(""))
    whole = lambda c, kind: F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))
    of = lambda kind: F.filter("_p.streams", lambda x: F.lower(x["codec_type"]) == kind)
    common = lambda x: (x["codec_name"], x["tags"]["language"], x["tags"]["title"], x["disposition"]["default"])

    def audio(x: Column, i: Column) -> Column:
        codec, language, title, first = common(x)
        return F.struct(
            i.alias("index"), F.coalesce(x["index"], F.lit(-1)).alias("stream_index"), text(codec).alias("codec"), text(language).alias("language"), text(title).alias("title"), F.coalesce(x["channels"], F.lit(0)).alias("channels"),
            text(x["channel_layout"]).alias("layout"), whole(x["sample_rate"], "int").alias("sample_rate"), whole(x["bit_rate"], "long").alias("bit_rate"), (F.coalesce(first, F.lit(0)) == 1).alias("is_default"),
        )

    def subtitle(x: Column) -> Column:
        codec, language, title, first = common(x)
        return F.struct(F.coalesce(x["index"], F.lit(-1)).alias("index"), text(title).alias("title"), text(language).alias("language"), text(codec).alias("codec"), (F.coalesce(first, F.lit(0)) == 1).alias("is_default"))

    rows = rows.withColumn("size", whole(F.col("_p.format.size"), "long")).withColumn("duration", _us(whole(F.col("_p.format.duration"), "double")))
    return rows.withColumn("audio", F.transform(of("audio"), audio)).withColumn("subtitles", F.transform(of("subtitle"), subtitle)).drop("_p")


_WHISPER = "transcription array<struct<offsets: struct<`from`: long, `to`: long>, text: string>>"


def whisper_segments(texts: DataFrame, by: By, column: str = "value", source: str = "whisper.cpp") -> DataFrame:
    """Segments of recogniser documents: milliseconds to microseconds, texts trimmed, numbered per document."""
    rows = texts.select(*by, F.posexplode(F.from_json(column, _WHISPER)["transcription"]).alias("pos", "x"))
    at = lambda c: F.coalesce(F.col(f"x.offsets.{c}"), F.lit(0)) * 1000
    return rows.select(*by, "pos", F.format_string("seg_%03d", F.col("pos") + 1).alias("seg_id"), at("from").alias("s"), at("to").alias("e"), F.trim(F.coalesce("x.text", F.lit(""))).alias("text"), F.lit(source).alias("source"))


def shifted_chunks(segments: DataFrame, by: By, offset: str, slack: int = 50_000) -> DataFrame:
    """Chunk segments in absolute time: a chunk that begins before its ``offset`` less ``slack`` has relative times and is shifted."""
    relative = F.min("s").over(Window.partitionBy(*by)) < F.col(offset) - slack
    shift = F.when(relative, F.col(offset)).otherwise(F.lit(0))
    return segments.withColumn("_shift", shift).withColumn("s", F.col("s") + F.col("_shift")).withColumn("e", F.col("e") + F.col("_shift")).drop("_shift")


def search_results(texts: DataFrame, by: By, column: str = "value") -> DataFrame:
    """Hits of search answers whose code is 0: id (the first of two names), titles without mark-up, number of episodes."""
    hit = "array<struct<season_id: long, media_id: long, title: string, org_title: string, ep_size: int>>"
    rows = texts.select(*by, F.from_json(column, f"code int, data struct<result: {hit}>").alias("a")).where("a.code = 0")
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", ""))
    rows = rows.select(*by, F.posexplode("a.data.result").alias("pos", "x"))
    return rows.select(*by, "pos", F.when(F.col("x.season_id") > 0, F.col("x.season_id")).otherwise(F.col("x.media_id")).alias("season_id"), plain(F.col("x.title")).alias("title"), plain(F.col("x.org_title")).alias("original_title"), F.coalesce("x.ep_size", F.lit(0)).alias("episodes"))


_EPISODE = "struct<id: long, ep_id: long, cid: long, title: string, long_title: string, show_title: string, share_copy: string>"


def season_episodes(texts: DataFrame, by: By, column: str = "value") -> DataFrame:
    """Episodes of season documents whose code is 0: section 0 the main ones, then those of each further section, in order.

    Columns: by, season_id, season_title, section, pos (in the document), episode_id (the first of two names), number
    (the whole number that a title begins with, else null), cid, and the titles. Documents without episodes give nothing.
    """
    season = f"season_id: long, title: string, season_title: string, episodes: array<{_EPISODE}>, section: array<struct<episodes: array<{_EPISODE}>>>"
    rows = texts.select(*by, F.from_json(column, f"code int, result struct<{season}>").alias("a")).where("a.code = 0")
    none = F.array().cast(f"array<{_EPISODE}>")
    parts = F.concat(F.array(F.coalesce("a.result.episodes", none)), F.coalesce(F.transform("a.result.section", lambda s: F.coalesce(s["episodes"], none)), F.array().cast(f"array<array<{_EPISODE}>>")))
    listed = F.flatten(F.transform(parts, lambda xs, i: F.transform(xs, lambda x: F.struct(i.alias("section"), x.alias("x")))))
    rows = rows.select(*by, F.col("a.result.season_id").alias("season_id"), F.coalesce("a.result.season_title", "a.result.title", F.lit("")).alias("season_title"), F.posexplode(listed).alias("pos", "e"))
    text = lambda c: F.coalesce(F.col(f"e.x.{c}"), F.lit("")).alias(c)
    number = F.regexp_extract(F.trim(F.coalesce("e.x.title", F.lit(""))), "^([0-9]+)", 1).try_cast("int")
    return rows.select(*by, "season_id", "season_title", F.col("e.section").alias("section"), "pos", F.coalesce(F.when(F.col("e.x.id") > 0, F.col("e.x.id")), "e.x.ep_id").alias("episode_id"), number.alias("number"), F.col("e.x.cid").alias("cid"), text("title"), text("long_title"), text("show_title"), text("share_copy"))


def reply_text(column: str = "value") -> Column:
    """The text of a model's reply, whichever envelope it came in: itself, a content, an output list or a choice."""
    got = lambda path: F.get_json_object(column, path)
    parts = F.from_json(got("$.response.output"), "array<struct<content: array<struct<text: string>>>>")
    listed = F.array_join(F.filter(F.flatten(F.transform(parts, lambda o: F.coalesce(o["content"]["text"], F.array().cast("array<string>")))), lambda x: x.isNotNull()), "\n")
    choice = F.from_json(got("$.response.choices[0].message.content"), "array<struct<text: string>>")
    chosen = F.array_join(F.filter(choice["text"], lambda x: x.isNotNull()), "\n")
    plain = got("$.response.choices[0].message.content")
    return F.coalesce(got("$.output_text"), got("$.content"), got("$.response.output_text"), F.nullif(listed, F.lit("")), F.nullif(chosen, F.lit("")), plain, F.lit(""))


REPLY = "decision string, confidence string, suggested_chinese_text string, reason string, rows array<struct<id: string, decision: string, confidence: string, suggested_chinese_text: string, reason: string>>"


def replies(lines: DataFrame, column: str = "value") -> DataFrame:
    """custom_id, raw_text and the parsed reply (null if it isn't JSON, whole or from its first to its last brace)."""
    is_object = lambda x: F.try_parse_json(x).isNotNull() & F.startswith(F.ltrim(x), F.lit("{"))
    braced = lambda raw: let(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), lambda inner: F.when(is_object(inner), inner))
    told = let(F.trim(reply_text(column)), lambda x: F.struct(x.alias("raw_text"), F.when(is_object(x), x).otherwise(braced(x)).alias("body")))
    rows = lines.withColumn("custom_id", F.coalesce(F.get_json_object(column, "$.custom_id"), F.lit(""))).withColumn("_told", told)
    return rows.withColumn("raw_text", F.col("_told.raw_text")).withColumn("parsed", F.from_json("_told.body", REPLY)).drop("_told")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, broken ones kept in ``_corrupt_record``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("x")).select("x.*")


def tag_count(spark: SparkSession, path: str, tag: str = "d") -> DataFrame:
    """How many elements of a name each XML file has, whatever they hold."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.regexp_count("value", F.lit(rf"<{tag}(?=[\s/>])")).cast("long").alias("n"))


def best_files(files: DataFrame, by: By, order: list[Column]) -> DataFrame:
    """The best file (path, ...) of each group: by ``order``, best first, then by path."""
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "path"))).where("_r = 1").drop("_r")


def metadata_probe(cues: DataFrame, parts: DataFrame, by: By, matched: DataFrame) -> DataFrame:
    """Per part: cues, first start, last end, and how many of its cues have a match and how many don't; parts may have none."""
    marked = cues.join(matched.select("seg_id").distinct().withColumn("_m", F.lit(1)), "seg_id", "left")
    sums = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("cues"), F.min("s").alias("first"), F.max("e").alias("last"), F.count("_m").alias("matched"))
    out = parts.join(sums, by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*by, zero("cues").alias("cues"), "first", "last", zero("matched").alias("matched"), (zero("cues") - zero("matched")).alias("unmatched"))


def cached(requests: DataFrame, cache: DataFrame, key: Column, now: Column, days: int = 14) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests in a cache (key, value, stored_at) by the SHA-256 of their key; older entries don't count."""
    keyed = requests.withColumn("key", F.sha2(key.cast("string"), 256))
    fresh = cache.where(F.col("stored_at") + F.expr(f"interval {days} days") > now)
    newest = fresh.groupBy("key").agg(F.max_by("value", "stored_at").alias("value"))
    return keyed.join(newest, "key"), keyed.join(newest.select("key"), "key", "left_anti")


def embedded(texts: DataFrame, store: DataFrame, encode) -> DataFrame:
    """Vectors of texts (pos, text): from the store (text, vector) where it has them; each other text is encoded once.

    ``encode``: DataFrame (text) to DataFrame (text, vector), the model's part.
    """
    known = store.groupBy("text").agg(F.first("vector").alias("vector"))
    wanted = texts.select("text").where("text is not null").distinct()
    new = encode(wanted.join(known.select("text"), "text", "left_anti"))
    return texts.join(known.unionByName(new.select("text", "vector")), "text", "left")
