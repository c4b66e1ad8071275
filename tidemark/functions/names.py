"""Titles, seasons and episodes in file names, and how well they fit a catalogue's entries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import let, nfkc

# How file names write episodes and seasons, in order of trust, and words that aren't part of a title.
EPISODES = (
    (r"(?i)\bS(\d{1,2})E(\d{1,3})\b", 2),
    (r"第\s*(\d{1,3})\s*[话話集]", 1),
    (r"(?i)\bEP?\s*(\d{1,3})\b", 1),
    (r"(?i)(?:\s-\s|\s)(\d{1,3})(?:v\d+)?(?=\s|$|[\[(])", 1),
    (r"(?i)[\[(](\d{1,3})(?:v\d+)?[\])]", 1),
)
SEASONS = (r"(?i)\bS(\d{1,2})(?=\b|E\d)", r"(?i)\bSeason\s*(\d{1,2})\b", r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\s+Season\b", r"第\s*(\d{1,2})\s*季")
RELEASE_WORDS = "1080p|2160p|720p|x264|x265|hevc|aac|flac|webrip|web-dl|baha|bilibili|nf|amzn|cr|at-x|10bit|8bit"
#: What dubbed editions are called.
DUBBED = ("中配", "国语")
# Marks of subtitle tracks (fixed values).
CHINESE = ("zh", "chi", "zho", "中文", "中日", "cn")
SIMPLIFIED, TRADITIONAL = ("chs", "简体", "简中", "sc", "gb"), ("cht", "繁體", "繁体", "tc", "big5")
ASIDE = ("sign", "song", "karaoke")


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def _stripped(text: Column, patterns: tuple[str, ...]) -> Column:
    for gone in patterns:
        text = F.regexp_replace(text, gone, " ")
    return text


def _unpacked(text: Column) -> Column:
    """A title without brackets, formats and versions, not trimmed."""
    return _stripped(F.trim(F.translate(text, "_.", "  ")), (r"[\[(【].*?[\])】]", rf"(?i)\b(?:{RELEASE_WORDS})\b", r"(?i)\bv\d+\b"))


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.btrim(text, F.lit(" -_")), r"\s+", " "))


def cleaned_title(text: Column, keep_season: bool = False) -> Column:
    """A title without what releases put around it: brackets, formats, versions and (unless kept) the season."""
    return _tidy(_stripped(_unpacked(text), () if keep_season else SEASONS))


def match_form(text: Column) -> Column:
    """Compatibility forms composed, lower case, letters and digits of any script with single blanks between."""
    ascii_ = text.rlike(r"^[\x00-\x7F]*$")
    plain = F.when(ascii_, text).otherwise(nfkc(F.when(~ascii_, text)))  # what is ASCII isn't sent to Python
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " "))


def named_parts(path: Column) -> Column:
    """``file_name_parts`` without normalized_title. Each step is computed once for a row, as the next ones use it often."""
    name = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*$", "")
    name = F.regexp_replace(F.trim(name), r"^(?:\s*[\[【][^\]】]+[\]】]\s*)+", "")

    def numbers(name: Column, places: Column) -> Column:
        at = F.get(F.filter(places, lambda x: x > 0), F.lit(0))
        episode = F.coalesce(*(F.when(F.get(places, F.lit(i)) > 0, _number(name, p, g)) for i, (p, g) in enumerate(EPISODES)))
        season = F.coalesce(F.when(F.get(places, F.lit(0)) > 0, _number(name, EPISODES[0][0])), *(_number(name, p) for p in SEASONS))
        return F.struct(F.substring(name, F.lit(1), at - 1).alias("head"), episode.alias("episode"), season.alias("season"))

    def titles(x: Column) -> Column:
        both = let(_unpacked(x["head"]), lambda t: F.struct(_tidy(_stripped(t, SEASONS)).alias("title"), _tidy(t).alias("keyword")))
        return let(both, lambda t: made(t["title"], t["keyword"], x["season"], x["episode"]))

    def made(title: Column, keyword: Column, season: Column, episode: Column) -> Column:
        low, s = F.lower(keyword), season.cast("string")
        told = F.contains(low, F.concat(F.lit("season "), s)) | F.contains(low, F.concat(F.lit("s"), s)) | F.contains(low, F.concat(F.lit("第"), s, F.lit("季")))
        keyword = F.when(season.isNotNull() & ~told, F.concat_ws(" ", keyword, F.concat(F.lit("Season "), s))).otherwise(keyword)
        return F.when((episode > 0) & (title != ""), F.struct(title.alias("raw_title"), keyword.alias("search_keyword"), season.alias("season"), episode.alias("episode")))

    places = lambda n: F.array(*(F.regexp_instr(n, F.lit(p)) for p, _ in EPISODES))
    return let(name, lambda n: let(let(places(n), lambda at: numbers(n, at)), titles))


def file_name_parts(path: Column) -> Column:
    """Struct of raw_title, normalized_title, search_keyword, season and episode; null if no episode or title is found.

    Groups in brackets at the start go first. The episode is the first pattern's that occurs; the title stands before it.
    One expression, which computes its steps often; for many rows take ``named_parts``, then ``match_form`` of its raw_title in a
    select of its own (a Python function can't stand over lambda variables).
    """
    name = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*$", "")
    name = F.regexp_replace(F.trim(name), r"^(?:\s*[\[【][^\]】]+[\]】]\s*)+", "")
    at = F.coalesce(*(F.when(name.rlike(p), F.regexp_instr(name, F.lit(p))) for p, _ in EPISODES))
    episode = F.coalesce(*(F.when(name.rlike(p), _number(name, p, g)) for p, g in EPISODES))
    season = F.coalesce(F.when(name.rlike(EPISODES[0][0]), _number(name, EPISODES[0][0])), *(_number(name, p) for p in SEASONS))
    head = F.substring(name, F.lit(1), at - 1)
    title, keyword = cleaned_title(head), cleaned_title(head, keep_season=True)
    low, s = F.lower(keyword), season.cast("string")
    told = F.contains(low, F.concat(F.lit("season "), s)) | F.contains(low, F.concat(F.lit("s"), s)) | F.contains(low, F.concat(F.lit("第"), s, F.lit("季")))
    keyword = F.when(season.isNotNull() & ~told, F.concat_ws(" ", keyword, F.concat(F.lit("Season "), s))).otherwise(keyword)
    made = F.struct(title.alias("raw_title"), match_form(title).alias("normalized_title"), keyword.alias("search_keyword"), season.alias("season"), episode.alias("episode"))
    return F.when((episode > 0) & (title != ""), made)


def title_points(query: Column, candidate: Column) -> Column:
    """320 for equal titles, 220 if one holds the other, else 28 for each word that both have."""
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda x: x != ""))
    shared = F.size(F.array_intersect(words(query), words(candidate))) * 28
    blank = (F.coalesce(query, F.lit("")) == "") | (F.coalesce(candidate, F.lit("")) == "")
    return F.when(blank, 0).when(query == candidate, 320).when(F.contains(candidate, query) | F.contains(query, candidate), 220).otherwise(shared)


def best_titles(queries: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The best candidate of each query, with its score: titles and keywords compared, dubbed editions less, long runs more.

    queries: key, title_form, keyword_form; candidates: key, season_id, title, title_form, original_form, episodes.
    """
    by_keyword = F.when(F.col("keyword_form") != "", F.greatest(*(title_points(F.col("keyword_form"), F.col(c)) for c in ("title_form", "original_form"))) - 10).otherwise(0)
    score = F.greatest(*(title_points(F.col("title_form_q"), F.col(c)) for c in ("title_form", "original_form")), by_keyword)
    pairs = queries.withColumnRenamed("title_form", "title_form_q").join(candidates, key)
    dubbed = F.lit(False)
    for word in DUBBED:
        dubbed = dubbed | F.contains("title", F.lit(word))
    total = score - F.when(dubbed, 35).otherwise(0) + F.when(F.col("episodes") > 0, F.floor(F.least(F.col("episodes"), F.lit(60)) / 3)).otherwise(0)
    pairs = pairs.withColumn("score", total.cast("int"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "season_id"))
    return pairs.withColumn("_r", first).where("_r = 1").select(key, "season_id", "title", "score")


def _grams(text: Column, size: int) -> Column:
    """The runs of ``size`` characters of a text, each once."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))))


def local_mapping(queries: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """queries with ``entry``: the local entry with the most points, the first by pos on ties, null without any.

    300 for a title that equals the query's, 220 for an equal keyword, 180 if one title holds the other, inside words
    too. Blank titles and keywords give nothing. queries: key, title_form; entries: entry, pos, titles (array, the entry's
    name among them), keyword, all in comparable form. A text that holds another has its first three characters (or all of a
    shorter one) among its own runs of characters, so titles meet by such runs, in both directions; there is no join of
    all with all, and a run that many entries have only costs comparisons.
    """
    titles = entries.select("entry", "pos", F.explode("titles").alias("title")).where("trim(title) <> ''")
    asked = queries.select(F.col("title_form").alias("form")).where("form is not null").distinct()
    hits = []
    for size in (1, 2, 3):
        whole = (lambda t: F.length(t) >= 3) if size == 3 else (lambda t, size=size: F.length(t) == size)
        for inner, outer, a, b in ((titles, asked, "title", "form"), (asked, titles, "form", "title")):
            heads = inner.where(whole(F.col(a))).withColumn("gram", F.substring(a, 1, size))
            pairs = heads.join(outer.withColumn("gram", F.explode(_grams(F.col(b), size))), "gram").where(F.contains(b, F.col(a)))
            hits.append(pairs.select("form", "entry", "pos", F.when(F.col("title") == F.col("form"), 300).otherwise(180).alias("points")))
    hits.append(asked.join(entries.where("trim(keyword) <> ''").select(F.col("keyword").alias("form"), "entry", "pos"), "form").withColumn("points", F.lit(220)))
    first = titles.agg(F.min(F.struct("pos", "entry")).alias("x")).where("x is not null").select(F.lit("").alias("form"), "x.entry", "x.pos", F.lit(180).alias("points"))  # every title holds an empty one
    every = first
    for one in hits:
        every = every.unionByName(one)
    best = every.groupBy("form").agg(F.max(F.struct("points", (-F.col("pos")).alias("rank"), "entry")).alias("b")).select(F.col("form").alias("title_form"), F.col("b.entry").alias("entry"))
    return queries.join(best, "title_form", "left").select(*queries.columns, "entry")


def episode_of(queries: DataFrame, episodes: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """The episode that each query (key, season_id, episode) means, and by which rule; null and not-found if there is none.

    An override (key, episode, cid, episode_id, title_contains) with a cid decides; then its episode id, the number, its
    words in a title, and 第n in a title. Main episodes (section 0) only, unless a season has none. Of several the first by pos.
    """
    season = Window.partitionBy("season_id")
    pool = episodes.withColumn("_main", F.max((F.col("section") == 0).cast("int")).over(season)).where((F.col("section") == 0) | (F.col("_main") == 0)).drop("_main").withColumnRenamed("cid", "_cid")
    rows = queries.join(overrides.select(key, "episode", F.col("cid").alias("own_cid"), F.col("episode_id").alias("own_id"), "title_contains"), [key, "episode"], "left").join(pool, "season_id", "left")
    has = lambda c, x: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(x))
    words = F.coalesce("title_contains", F.lit(""))
    numbered = F.concat(F.lit("第"), F.col("episode").cast("string"))
    rule = (
        F.when(F.col("own_cid") > 0, F.lit(0)).when((F.col("own_id") > 0) & (F.col("episode_id") == F.col("own_id")), F.lit(1)).when(F.col("number") == F.col("episode"), F.lit(2))
        .when((words != "") & (has("show_title", words) | has("long_title", words)), F.lit(3)).when(has("show_title", numbered) | has("share_copy", numbered), F.lit(4))
    )
    found = rows.groupBy(key).agg(F.min(F.when(rule.isNotNull(), F.struct(rule.alias("rule"), F.coalesce("pos", F.lit(0)).alias("pos"), F.when(rule == 0, F.col("own_cid")).otherwise(F.col("_cid")).alias("cid")))).alias("b"))
    names = F.array(*(F.lit(x) for x in ("override-cid", "override-id", "number", "override-title", "title")))
    return queries.join(found, key, "left").select(*queries.columns, F.col("b.cid").alias("cid"), F.coalesce(F.get(names, F.col("b.rule")), F.lit("not-found")).alias("rule"))


def track_points(track: Column, preference: str = "") -> Column:
    """Points of a subtitle track (struct of language, title, codec, sample, is_default, is_text): the default 40, text 30
    and pictures 15, Chinese 35, a sample of text 20, what is preferred ('chs', 'cht' 60 by its marks, 'default' 50),
    signs, songs and karaoke 30 less. Marks are looked for in title, language, codec and sample, in any case."""
    known = lambda c: F.coalesce(track[c], F.lit(""))
    text = F.lower(F.concat_ws(" ", known("title"), known("language"), known("codec"), known("sample")))
    has = lambda marks: text.rlike("|".join(marks))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    default = F.coalesce(track["is_default"], F.lit(False))
    wanted = {"chs": (has(SIMPLIFIED), 60), "cht": (has(TRADITIONAL), 60), "default": (default, 50)}.get(preference, (F.lit(False), 0))
    total = points(default, 40) + F.when(F.coalesce(track["is_text"], F.lit(False)), 30).otherwise(15) + points(has(CHINESE), 35) + points(F.trim(known("sample")) != "", 20)
    return total + points(*wanted) - points(has(ASIDE), 30)
