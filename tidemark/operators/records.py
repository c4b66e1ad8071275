"""Keyed tables of reviews and replies: ingest, lookups, overrides, policies, summaries and small reports, as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import stored

By = list[str]


def ingest(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """One row for each answer and each request without one: custom_id, row_id, state, decision, confidence, suggestion,
    reason, raw_text.

    requests: custom_id, row_id ('' if the request is one row); replies: custom_id, raw_text, parsed (``logs.replies``).
    state: ok, missing-custom-id, custom-id-not-found, unparseable-response-json, request-meta-not-found (a plain reply to
    a request of several rows), group-row-id-not-found:<id>, group-row-missing:<id> (a row that a grouped reply leaves
    out) or missing-response.
    """
    asked = requests.select("custom_id", F.coalesce("row_id", F.lit("")).alias("row_id"))
    known = asked.groupBy("custom_id").agg(F.max("row_id").alias("_one"), F.count(F.lit(1)).alias("_rows"))
    rows = replies.join(known, "custom_id", "left")
    simple = F.when(F.col("custom_id") == "", "missing-custom-id").when(F.col("_one").isNull(), "custom-id-not-found").when(F.col("parsed").isNull(), "unparseable-response-json").when(F.col("parsed.rows").isNull(), F.when(F.col("_rows") == 1, "ok").otherwise("request-meta-not-found"))
    rows = stored(rows.withColumn("state", simple).select("custom_id", "raw_text", "parsed", "_one", "state"))  # read five times, parsed once
    fields = lambda x: [F.coalesce(F.col(f"{x}.{c}"), F.lit("")).alias(n) for c, n in (("decision", "decision"), ("confidence", "confidence"), ("suggested_chinese_text", "suggestion"), ("reason", "reason"))]
    whole = rows.where("state is not null").select("custom_id", F.when(F.col("state") == "ok", F.col("_one")).otherwise(F.lit("")).alias("row_id"), "state", *fields("parsed"), "raw_text")
    grouped = rows.where("state is null").select("custom_id", "raw_text", F.explode("parsed.rows").alias("x"))
    grouped = grouped.select("custom_id", F.coalesce("x.id", F.lit("")).alias("row_id"), *fields("x"), "raw_text").join(asked.distinct().withColumn("_there", F.lit(True)), ["custom_id", "row_id"], "left")
    named = F.when(F.col("_there"), "ok").otherwise(F.concat(F.lit("group-row-id-not-found:"), "row_id"))
    grouped = grouped.select("custom_id", "row_id", named.alias("state"), "decision", "confidence", "suggestion", "reason", "raw_text")
    empty = [F.lit("").alias(c) for c in ("decision", "confidence", "suggestion", "reason")]
    groups = rows.where("state is null").select("custom_id", "raw_text").distinct()
    left_out = asked.where("row_id <> ''").join(groups, "custom_id").join(grouped.where("state = 'ok'").select("custom_id", "row_id").distinct(), ["custom_id", "row_id"], "left_anti")
    left_out = left_out.select("custom_id", "row_id", F.concat(F.lit("group-row-missing:"), "row_id").alias("state"), *empty, "raw_text")
    answered = whole.unionByName(grouped).where("state = 'ok'").select("custom_id", "row_id").distinct()
    silent = asked.join(answered, ["custom_id", "row_id"], "left_anti").select("custom_id", "row_id", F.lit("missing-response").alias("state"), *empty, F.lit("").alias("raw_text"))
    return whole.unionByName(grouped).unionByName(left_out).unionByName(silent)


def lookup_chain(rows: DataFrame, tables: list[tuple[DataFrame, By]], value: str) -> DataFrame:
    """Adds ``value`` from the first table that has it: each is looked up by its own key, which is unique there."""
    for i, (table, key) in enumerate(tables):
        rows = rows.join(table.select(*key, F.col(value).alias(f"_v{i}")), key, "left")
    return rows.withColumn(value, F.coalesce(*(F.col(f"_v{i}") for i in range(len(tables))))).drop(*(f"_v{i}" for i in range(len(tables))))


def prefix_lookup(rows: DataFrame, key: str, table: DataFrame, name: str, value: str) -> DataFrame:
    """Adds ``value`` by the whole ``key``, or else by the longest name that it begins with.

    Rows meet names by equal prefixes of the lengths that names have, so there is no join of all with all.
    """
    lengths = sorted(r[0] for r in table.select(F.length(name)).distinct().collect())  # as many as names have lengths
    if not lengths:
        return rows.withColumn(value, F.lit(None).cast(dict(table.dtypes)[value]))
    prefixes = F.filter(F.array(*(F.when(F.length(key) >= n, F.substring(key, 1, n)) for n in lengths)), lambda x: x.isNotNull())
    spread = rows.select(key).distinct().withColumn("_p", F.explode(prefixes))
    found = spread.join(table.select(F.col(name).alias("_p"), value), "_p").groupBy(key).agg(F.max_by(value, F.length("_p")).alias(value))
    return rows.join(found, key, "left")


def row_overrides(base: DataFrame, by_key: DataFrame, by_text: DataFrame, key: By, text: str) -> DataFrame:
    """``text`` from the override of a row's key, else from that of its text; ``overridden`` says which, if any."""
    rows = base.join(by_key.select(*key, F.col("new_text").alias("_a")), key, "left").join(by_text.select(F.col("old_text").alias(text), F.col("new_text").alias("_b")), text, "left")
    which = F.when(F.col("_a").isNotNull(), "key").when(F.col("_b").isNotNull(), "text")
    return rows.withColumn("overridden", which).withColumn(text, F.coalesce("_a", "_b", text)).drop("_a", "_b")


def replace_many(base: DataFrame, replacements: DataFrame, key: str, items: str) -> DataFrame:
    """Rows with a replacement give way to its items (structs of columns), numbered in ``piece`` from 1; an empty list drops the row."""
    kept = base.join(replacements.select(key), key, "left_anti").withColumn("piece", F.lit(0))
    rows = base.join(replacements.select(key, F.posexplode(items).alias("_i", "_x")), key)
    names = [f.name for f in replacements.schema[items].dataType.elementType]
    new = rows.select(*(F.col(f"_x.{c}").alias(c) if c in names else F.col(c) for c in base.columns), (F.col("_i") + 1).alias("piece"))
    return kept.unionByName(new)


def filter_force(rows: DataFrame, condition: Column, forced: DataFrame, key: By) -> DataFrame:
    """Rows that pass and, besides, those that are forced in; ``why`` tells which."""
    mark = forced.select(*key).distinct().withColumn("_f", F.lit(True))
    out = rows.join(mark, key, "left").withColumn("why", F.when(condition, "passed").when(F.col("_f"), "forced"))
    return out.where("why is not null").drop("_f")


def policy_select(rows: DataFrame, policy: DataFrame, by: str, key: str) -> DataFrame:
    """Rows of each part's chosen version with at least its least score, without the keys that it excludes.

    policy: one row a part with want_version, least_score, excluded (array of keys).
    """
    out = rows.join(policy, by).where((F.col("version") == F.col("want_version")) & (F.col("score") >= F.col("least_score")) & ~F.array_contains(F.coalesce("excluded", F.array().cast(f"array<{dict(rows.dtypes)[key]}>")), F.col(key)))
    return out.drop("want_version", "least_score", "excluded")


def reclaim_low(rows: DataFrame, clip: Column, most: float, text: By) -> DataFrame:
    """Forced matches of a clip with a score of at most ``most`` become unmatched again; ``reclaimed`` marks them."""
    low = F.coalesce(clip & F.startswith("match_origin", F.lit("forced-")) & (F.coalesce("match_score", F.lit(0.0)) <= most), F.lit(False))
    rows = rows.withColumn("reclaimed", low)
    for c, new in (("status", F.lit("unmatched")), ("match_origin", F.lit("none")), ("match_score", F.lit(None).cast("double")), *((c, F.lit("")) for c in text)):
        rows = rows.withColumn(c, F.when(F.col("reclaimed"), new).otherwise(F.col(c)))
    return rows


def review_patches(base: DataFrame, patches: DataFrame, key: str, allowed: By) -> DataFrame:
    """The base after review patches (pos, decision, revised map, splits array of structs, notes); pending ones are skipped.

    Patches of a key apply in order: later revisions of a field win, the last decision gives review_status. Only
    ``allowed`` fields are revised; with s and e changed the duration is theirs. Excluded rows stay with that status. A split
    row is superseded, and its parts follow as rows of their own (key__s01 ...). An unknown key is an error.
    """
    live = patches.where("decision <> 'pending'")
    known = base.select(key).withColumn("_known", F.lit(True))
    unknown = F.raise_error(F.concat(F.lit("review patch references missing segment: "), F.col(key)))
    live = live.join(known, key, "left").withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(unknown)).drop("_known")
    status = {"confirmed": "confirmed", "revised": "revised", "excluded": "excluded", "split": "superseded-by-split"}
    named = F.coalesce(*(F.when(F.col("decision") == d, F.lit(s)) for d, s in status.items()))
    of = lambda c: F.max_by(F.when(F.col("decision") == "revised", F.element_at("revised", c)), F.when((F.col("decision") == "revised") & F.map_contains_key("revised", c), F.col("pos"))).alias(f"_{c}")
    last = live.groupBy(key).agg(F.max_by(named, "pos").alias("review_status"), F.max_by("notes", "pos").alias("review_notes"), F.count(F.lit(1)).alias("patches"), *map(of, allowed))
    kinds = dict(base.dtypes)
    rows = base.join(last, key, "left")
    rows = rows.withColumns({c: F.coalesce(F.col(f"_{c}").cast(kinds[c]), F.col(c)) for c in allowed}).drop(*(f"_{c}" for c in allowed))
    rows = rows.withColumn("review_status", F.coalesce("review_status", F.lit("baseline"))).withColumn("patches", F.coalesce("patches", F.lit(0))).withColumn("parent", F.lit(None).cast("string"))
    parts = live.where("decision = 'split'").select(F.col(key).alias("_parent"), "notes", F.posexplode("splits").alias("_i", "_x"))
    names = [f.name for f in patches.schema["splits"].dataType.elementType]
    made = parts.join(rows.withColumnRenamed(key, "_parent").drop("review_status", "review_notes", "patches", "parent"), "_parent")
    made = made.select(*(F.coalesce(F.col(f"_x.{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in base.columns if c != key), F.concat(F.col("_parent"), F.format_string("__s%02d", F.col("_i") + 1)).alias(key), F.lit("split-derived").alias("review_status"), F.col("notes").alias("review_notes"), F.lit(0).cast("long").alias("patches"), F.col("_parent").alias("parent"))
    out = rows.unionByName(made)
    return out.withColumn("duration", F.col("e") - F.col("s")) if {"s", "e"} <= set(base.columns) else out


def overlay_rules(base: DataFrame, overlays: DataFrame, key: By, rules: DataFrame) -> DataFrame:
    """Every overlay row with what becomes of it: applied, or why it is skipped.

    rules: rule (the order), origins (array), least. In order of rule and pos the first that fits an unmatched base row is
    applied; skipped: not-in-base, base-matched, origin-not-listed, score-too-low, later-overlay.
    """
    rows = overlays.join(rules, "rule").join(base.select(*key, F.col("status").alias("_status")), key, "left")
    why = F.when(F.col("_status").isNull(), "not-in-base").when(F.col("_status") != "unmatched", "base-matched").when(~F.array_contains("origins", F.col("match_origin")), "origin-not-listed").when(F.col("score") < F.col("least"), "score-too-low")
    rows = rows.withColumn("outcome", why)
    first = F.row_number().over(Window.partitionBy(*key, F.col("outcome").isNull()).orderBy("rule", "pos"))
    return rows.withColumn("_r", first).withColumn("outcome", F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(F.col("_r") == 1, "applied").otherwise("later-overlay")).drop("_r", "_status", "origins", "least")


def next_round(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the name of the round after the highest there is, from 1."""
    n = F.coalesce(F.max(F.regexp_extract(column, rf"^{prefix}(\d+)$", 1).try_cast("int")), F.lit(0)) + 1
    return names.agg(n.alias("round")).select("round", F.concat(F.lit(prefix), F.col("round").cast("string")).alias("name"))


def bucket_union(rows: DataFrame, buckets: list[tuple[str, Column]], key: By) -> DataFrame:
    """Rows of any bucket, each under the first whose condition holds; ``buckets`` lists all that do."""
    held = F.array_compact(F.array(*(F.when(c, name) for name, c in buckets)))
    return rows.withColumn("buckets", held).where(F.size("buckets") > 0).withColumn("bucket", F.get("buckets", F.lit(0)))


def delivery(rows: DataFrame, by: By, order: list) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) rows for delivery, numbered anew per group; durations are theirs."""
    rows = rows.withColumn("duration", F.col("e") - F.col("s"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return tuple(rows.where(c).withColumn("number", number) for c in (F.col("status") != "unmatched", F.col("status") == "unmatched"))


def tag_counts(rows: DataFrame, by: By, tags: str) -> DataFrame:
    """How often each tag of an array column occurs per group."""
    return rows.select(*by, F.explode(tags).alias("tag")).groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("n"))


def used_keys(rows: DataFrame, condition: Column, ids: str) -> DataFrame:
    """The distinct whole numbers in comma-separated lists of rows that pass; what isn't a number is passed over."""
    return rows.where(condition).select(F.explode(F.split(F.coalesce(ids, F.lit("")), ",")).alias("x")).select(F.trim("x").try_cast("long").alias("key")).where("key is not null").distinct()


def finite_stats(rows: DataFrame, by: By, value: str) -> DataFrame:
    """Mean, least, largest and sum of the finite values of each group, and how many there are of all."""
    x = F.when(F.col(value) > float("-inf"), F.col(value))
    return rows.groupBy(*by).agg(F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("largest"), F.sum(x).alias("total"), F.count(x).alias("finite"), F.count(F.lit(1)).alias("n"))


def keyword_toggle(rows: DataFrame, text: str, words: list[str], flag: str, value: bool) -> DataFrame:
    """Sets ``flag`` of the rows whose text has any of the words, whatever the case; the others keep theirs."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(text), F.lit(w.lower()))
    return rows.withColumn(flag, F.when(hit, F.lit(value)).otherwise(F.col(flag)))


def first_failure(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``stage``: the first stage of a chain whose condition doesn't hold (null counts so), or 'done'."""
    out = F.lit("done")
    for name, ok in reversed(stages):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.lit(name))
    return rows.withColumn("stage", out)


def with_defaults(rows: DataFrame, fields: dict[str, tuple[object, Callable[[Column], Column]]]) -> DataFrame:
    """Each field, or its default where it is missing or not valid."""
    kinds = dict(rows.dtypes)
    made = lambda c, d, ok: F.when(F.coalesce(ok(F.col(c)), F.lit(False)), F.col(c)).otherwise(F.lit(d).cast(kinds[c])) if c in kinds else F.lit(d)
    return rows.withColumns({c: made(c, d, ok) for c, (d, ok) in fields.items()})


def precedence(*options: Column) -> Column:
    """The first option that isn't blank: command line, then configuration, then environment."""
    return F.coalesce(*(F.when(F.trim(o.cast("string")) != "", o) for o in options))


def exit_code(rows: DataFrame, state: str) -> DataFrame:
    """One row: 0 if no job failed or was cancelled, 2 if any was cancelled, else 1, with the counts."""
    n = {s: F.count_if(F.col(state) == s).alias(s.lower()) for s in ("Success", "Skipped", "Failed", "Cancelled", "Pending")}
    return rows.agg(*n.values()).withColumn("code", F.when(F.col("cancelled") > 0, 2).when(F.col("failed") > 0, 1).otherwise(0))


def history_filter(rows: DataFrame, status: str | None = None, words: str = "", day: Column | None = None) -> DataFrame:
    """Entries of a status, with the words in their file names, of one calendar day; each test only if it is given."""
    if status:
        rows = rows.where(F.col("status") == status)
    if words.strip():
        rows = rows.where(F.contains(F.lower("input"), F.lit(words.strip().lower())))
    return rows if day is None else rows.where(F.to_date("started_at") == F.to_date(day))


def context_cards(spans: DataFrame, rows: DataFrame, by: By, radius: int) -> DataFrame:
    """For each span (card, first, last) the rows (pos, text) up to ``radius`` before and after it, with their role.

    Positions are dense, so spans meet rows by equal positions.
    """
    spread = spans.withColumn("pos", F.explode(F.sequence(F.col("first") - radius, F.col("last") + radius)))
    role = F.when(F.col("pos") < F.col("first"), "before").when(F.col("pos") > F.col("last"), "after").otherwise("focus")
    return spread.join(rows.select(*by, "pos", "text"), [*by, "pos"]).select(*by, "card", "pos", role.alias("role"), "text")


def candidate_scan(rows: DataFrame, by: By, candidates: str, least: float) -> DataFrame:
    """First and last time, best score and number of each part's candidates (part, s, e, score) of at least ``least``."""
    each = rows.select(*by, F.explode(candidates).alias("c")).where(F.col("c.score") >= least)
    return each.groupBy(*by, F.col("c.part").alias("part")).agg(F.min("c.s").alias("first"), F.max("c.e").alias("last"), F.max("c.score").alias("best"), F.count(F.lit(1)).alias("n"))


def patch_template(rows: DataFrame, key: str, fields: By) -> DataFrame:
    """Rows as pending decisions to be edited: the current values in a struct, revised ones empty."""
    return rows.select(key, F.lit("pending").alias("decision"), F.struct(*fields).alias("current"), F.lit(None).cast("map<string,string>").alias("revised"), F.lit("").alias("notes"))


def one_row_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of all parts' columns, prefixed with their names; each part has one row."""
    out = None
    for name, df in parts.items():
        df = df.select(*(F.col(c).alias(f"{name}_{c}") for c in df.columns))
        out = df if out is None else out.crossJoin(df)  # one row by one row
    return out


def length_stats(rows: DataFrame, by: By, text: str) -> DataFrame:
    """Rows, mean and largest length of texts per queue."""
    n = F.length(F.coalesce(text, F.lit("")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(n).alias("mean_length"), F.max(n).alias("longest"))


def coverage_counts(rows: DataFrame, part: str) -> DataFrame:
    """Per part and in total: rows, matched, coverage to 4 digits, and the counts of each status as a sorted map."""
    each = rows.groupBy(part, "status").agg(F.count(F.lit(1)).alias("n"))
    summed = each.rollup(part).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("status") != "unmatched", F.col("n")).otherwise(0)).alias("matched"), F.grouping(part).alias("_all"))
    per_part = each.groupBy(part).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses")).withColumn("_all", F.lit(0))
    total = each.groupBy("status").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses")).select(F.lit(None).cast("string").alias(part), "statuses", F.lit(1).alias("_all"))
    maps = per_part.unionByName(total).withColumnRenamed(part, "_p").withColumnRenamed("_all", "_a")
    out = summed.join(maps, F.col(part).eqNullSafe(F.col("_p")) & (F.col("_all") == F.col("_a")), "left")
    return out.select(part, (F.col("_all") == 1).alias("is_total"), "rows", "matched", F.round(F.col("matched") / F.greatest(F.col("rows"), F.lit(1)), 4).alias("coverage"), "statuses")


def atempo_factors(speed: Column) -> Column:
    """Factors from 0.5 to 2 whose product is the speed: as many twos or halves as needed, then the rest."""
    n = F.greatest(F.ceil(F.abs(F.log2(speed)) - 1e-12) - 1, F.lit(0)).cast("int")
    step = F.when(speed > 1, F.lit(2.0)).otherwise(F.lit(0.5))
    return F.concat(F.array_repeat(step, n), F.array(speed / F.pow(step, n)))
