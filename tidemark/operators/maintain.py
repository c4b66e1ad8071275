"""Keyed maintenance: patches, plans, overlays, differences, snapshots and the job queue, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(patches: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return patches.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def patch_merge(base: DataFrame, patches: DataFrame, key: str, value: str, order: str = "pos") -> DataFrame:
    """Pending patches are skipped; the last other one of a key confirms, revises or excludes the row."""
    p = latest(patches.where("decision <> 'pending'"), key, order).select(key, "decision", F.col("new_value").alias("_new"))
    rows = base.join(p, key, "left").where("decision is null or decision <> 'excluded'")
    return rows.withColumn(value, F.when(F.col("decision") == "revised", F.col("_new")).otherwise(F.col(value))).withColumn("status", F.coalesce("decision", F.lit("baseline"))).drop("_new", "decision")


#: Decisions of a review or a model (fixed values).
DECISIONS = ("keep_current_match", "reject_current_match", "suggest_new_match", "no_match", "unsure")


def plan_action(decision: Column, current: Column, suggestion: Column) -> Column:
    """What a decision means for a row: doubt, or a suggestion without a text, goes to a person; unknown ones are named so."""
    d = F.lower(F.trim(F.coalesce(decision, F.lit(""))))
    has, offered = F.trim(F.coalesce(current, F.lit(""))) != "", F.trim(F.coalesce(suggestion, F.lit(""))) != ""
    return (
        F.when(d == "keep_current_match", "keep-existing").when(d.isin("reject_current_match", "no_match") & has, "clear-existing").when(d.isin("reject_current_match", "no_match"), "leave-unmatched")
        .when((d == "suggest_new_match") & offered & has, "replace-with-suggested-text").when((d == "suggest_new_match") & offered, "fill-with-suggested-text")
        .when(d.isin("suggest_new_match", "unsure"), "manual-review").otherwise("unrecognized-decision")
    )


def apply_plan(base: DataFrame, plan: DataFrame, key: str, value: str) -> DataFrame:
    """The base with each key's plan action applied to ``value``; plan: key, action, suggestion."""
    rows = base.join(plan.select(key, "action", "suggestion"), key, "left")
    new = F.when(F.col("action") == "clear-existing", F.lit(None)).when(F.col("action").isin("replace-with-suggested-text", "fill-with-suggested-text"), F.trim("suggestion")).otherwise(F.col(value))
    return rows.withColumn(value, new).withColumn("action", F.coalesce("action", F.lit("none"))).drop("suggestion")


def overlay_merge(base: DataFrame, overlays: DataFrame, key: str, least: float) -> DataFrame:
    """Base rows that are unmatched take the first overlay (by rule, then position) whose score is enough."""
    w = Window.partitionBy(key).orderBy("rule", "pos")
    first = overlays.where(F.col("score") >= least).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.col("match").alias("_match"), "rule")
    rows = base.join(first, key, "left")
    take = F.col("match").isNull() & F.col("_match").isNotNull()
    return rows.withColumn("origin", F.when(take, F.concat(F.lit("overlay-"), F.col("rule").cast("string"))).when(F.col("match").isNotNull(), "base").otherwise("none")).withColumn("match", F.coalesce("match", "_match")).drop("_match", "rule")


def delta_report(base: DataFrame, applied: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Change of each key between two tables with status, text and further ``fields``, null like ''.

    missing-in-base, missing-in-applied, unchanged, or by the first rule that holds: cleared-to-unmatched,
    filled-from-unmatched, replaced-text, status-only-change, metadata-change. ``changed`` lists the fields that differ.
    """
    names = list(dict.fromkeys(["status", "text", *fields]))
    a = base.select(*keys, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"base_{c}") for c in names), F.lit(True).alias("_a"))
    b = applied.select(*keys, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"new_{c}") for c in names), F.lit(True).alias("_b"))
    rows = a.join(b, keys, "full_outer").fillna("", [f"{side}_{c}" for side in ("base", "new") for c in names])
    differs = {c: F.col(f"base_{c}") != F.col(f"new_{c}") for c in names}
    rows = rows.withColumn("changed", F.when(F.col("_a") & F.col("_b"), F.array_compact(F.array(*(F.when(d, c) for c, d in differs.items())))).otherwise(F.array().cast("array<string>")))
    was, now, old, new = F.col("base_status"), F.col("new_status"), F.col("base_text"), F.col("new_text")
    kind = (
        F.when(F.col("_a").isNull(), "missing-in-base").when(F.col("_b").isNull(), "missing-in-applied").when(F.size("changed") == 0, "unchanged")
        .when((was != "unmatched") & (now == "unmatched"), "cleared-to-unmatched").when((was == "unmatched") & (now != "unmatched") & (new != ""), "filled-from-unmatched")
        .when((old != new) & (old != "") & (new != ""), "replaced-text").when(was != now, "status-only-change").otherwise("metadata-change")
    )
    return rows.withColumn("change", kind).drop("_a", "_b")


def verify_snapshot(expected: DataFrame, actual: DataFrame, key: str, digest: str, size: str | None = None) -> DataFrame:
    """Each key's state: ok, missing (no such artifact now), unexpected, or mismatch in its digest or, if it is given, its size."""
    fields = [digest, *([size] if size else [])]
    e, a = (df.select(key, F.struct(*fields).alias(name)) for df, name in ((expected, "_e"), (actual, "_a")))
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(same, "ok").otherwise("mismatch")
    return e.join(a, key, "full_outer").withColumn("state", state).drop("_e", "_a")


def max_score_upsert(base: DataFrame, new: DataFrame, key: str, score: str, pos: str) -> DataFrame:
    """New rows replace those of the same key if their score is higher; the first wins on ties."""
    rows = base.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), "_g", pos)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("is_new", F.col("_g") == 1).drop("_r", "_g")


def ingest_status(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Each key's state: ok, invalid (unknown decision), missing (no response) or unrequested."""
    r = responses.select(key, "decision", F.lit(True).alias("_b"))
    rows = requests.select(key, F.lit(True).alias("_a")).join(r, key, "full_outer")
    state = F.when(F.col("_a").isNull(), "unrequested").when(F.col("_b").isNull(), "missing").when(F.coalesce("decision", F.lit("")).isin(*DECISIONS), "ok").otherwise("invalid")
    return rows.withColumn("state", state).drop("_a", "_b")


def retry_reason(decision: Column, suggestion: Column, confidence: Column, threshold: float) -> Column:
    known = F.coalesce(decision, F.lit("")).isin(*DECISIONS)
    bare = (decision == "suggest_new_match") & (F.trim(F.coalesce(suggestion, F.lit(""))) == "")
    return F.when(~known, "invalid").when(decision == "unsure", "unsure").when(bare, "missing-suggestion").when(confidence < threshold, "low-confidence").otherwise("none")


def queue_states(tasks: DataFrame, by: str, order: str) -> DataFrame:
    """States of queued jobs from the results of their checks; a cancelled job stops those after it in its queue."""
    w = Window.partitionBy(by).orderBy(order)
    stopped = F.coalesce(F.max(F.col("cancelled").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    state = (
        F.when(stopped, "Pending").when(~F.col("input_exists"), "Failed").when(F.col("output_valid"), "Skipped").when(~F.col("space_ok"), "Failed")
        .when(~F.col("probe_ok"), "Failed").when(F.col("cancelled"), "Cancelled").when(~F.col("run_ok"), "Failed").otherwise("Success")
    )
    return tasks.withColumn("state", state)
