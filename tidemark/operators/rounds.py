"""Review rounds as versioned tables: each round's replies are taken in, planned, applied, compared and asked again.

A store is a folder of tables partitioned by ``round``. A round overwrites its own partitions only, and counts once its
manifest is there, which is written last and put in place by a rename; so a run that was lost half-way leaves nothing that anyone reads,
and the next run makes the same partitions anew. Rounds keep changes, not whole tables: the state after a round is the base
with each row's last change, and a round reads the rows that it was asked about and the parts that it changed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import maintain, records
from tidemark.sources import logs
from tidemark.storage import spent, stored

#: The tables of a round, in the order in which they are written.
TABLES = ("ingest", "plan", "changes", "delta", "burnin", "requests", "handoff")


class Store:
    """Tables by round under ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> int:
        """The last round whose manifest is there, as are those of all before it; 0 at first."""
        n = 0
        while True:
            path, files = self._file(f"manifests/{n + 1}.json")
            if not files.exists(path):
                return n
            n += 1

    def manifest(self, n: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{n}.json", wholetext=True).first()[0])

    def commit(self, n: int, facts: dict) -> None:
        new, files = self._file(f"manifests/.{n}.new")
        out = files.create(new, True)
        out.write(bytearray(json.dumps({"round": n, **facts}, sort_keys=True).encode()))
        out.close()
        done, _ = self._file(f"manifests/{n}.json")
        if not files.rename(new, done):
            raise RuntimeError(f"round {n} is there already")

    def write(self, name: str, df: DataFrame, n: int) -> DataFrame:
        """``df`` as round ``n`` of a table, in place of what a lost run left of it; read back."""
        df = df.withColumn("round", F.lit(n))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(f"{self.folder}/{name}")
        path, files = self._file(f"{name}/round={n}")
        if not files.exists(path):  # no rows, no partition: a lost run's would stand, so an empty one takes its place
            df.drop("round").limit(0).write.mode("overwrite").parquet(f"{self.folder}/{name}/round={n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}").where(F.col("round") == n)

    def read(self, name: str, like: str, last: int) -> DataFrame:
        """All rounds of a table up to ``last``; ``like``: its schema without round."""
        path, files = self._file(name)
        schema = like + ", round int"
        return self.spark.read.schema(schema).parquet(str(path)).where(F.col("round") <= last) if files.exists(path) else self.spark.createDataFrame([], schema)


CHANGES = "segment_id string, part string, status string, text string, action string"
REQUESTS = "custom_id string, row_id string, reason string"


def current(store: Store, base: DataFrame, last: int | None = None) -> DataFrame:
    """The base (segment_id, part, status, text) with each row's last change up to round ``last``, else the last committed."""
    last = store.committed() if last is None else last
    changes = store.read("changes", CHANGES, last).groupBy("segment_id").agg(F.max_by(F.struct("status", "text"), "round").alias("_new"))
    rows = base.select("segment_id", "part", "status", "text").join(changes, "segment_id", "left")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("segment_id", "part", pick("status"), pick("text"))


def asked(store: Store, first: DataFrame, n: int) -> DataFrame:
    """What round ``n`` asks: the first requests (custom_id, row_id), or those that the round before wrote."""
    return first.select("custom_id", "row_id") if n == 1 else store.read("requests", REQUESTS, n).where(F.col("round") == n).select("custom_id", "row_id")


def advance(store: Store, base: DataFrame, first: DataFrame, replies: DataFrame, threshold: float = 60.0, skip_missing: bool = False) -> int:
    """The next round, from the replies (lines in ``value``) to its requests; its number.

    base: segment_id (string, unique), part, status, text; first: custom_id, row_id (a segment's id). The round writes
    ingest (every outcome), plan (action of each answered row), changes (rows that became different), delta (their
    numbers by part and kind), burnin (the matched rows of the parts that changed), requests of the next round (rows
    to be asked again, each on its own, and why) and handoff (the round's numbers). Of several answers to a row the first
    by raw text counts. Nothing is written again once the round is committed.
    """
    n = store.committed() + 1
    questions = asked(store, first, n)
    ingest = store.write("ingest", records.ingest(questions, logs.replies(replies)), n)
    answers = ingest.where("state = 'ok'").groupBy(F.col("row_id").alias("segment_id")).agg(F.min_by(F.struct("decision", "suggestion", "confidence"), "raw_text").alias("x")).select("segment_id", "x.*")
    before = current(store, base, n - 1)
    answered = stored(before.join(answers, "segment_id"))
    mine = answered.select("segment_id", "part", "status", "text")
    plan = answered.select("segment_id", "part", maintain.plan_action(F.col("decision"), F.col("text"), F.col("suggestion")).alias("action"), "suggestion", "decision", "confidence")
    plan = store.write("plan", plan, n)
    applied = maintain.apply_plan(mine, plan, "segment_id", "text")
    kinds = {"clear-existing": "unmatched", "replace-with-suggested-text": "model-text-replace", "fill-with-suggested-text": "model-text-fill"}
    status = F.coalesce(*(F.when(F.col("action") == action, name) for action, name in kinds.items()), F.col("status"))
    applied = applied.withColumn("status", status).withColumn("text", F.coalesce("text", F.lit("")))
    delta = stored(maintain.delta_report(mine, applied, ["segment_id", "part"], []).where("change <> 'unchanged'"))
    changes = store.write("changes", applied.join(delta.select("segment_id"), "segment_id", "left_semi").select("segment_id", "part", "status", "text", "action"), n)
    store.write("delta", delta.groupBy("part", "change").agg(F.count(F.lit(1)).alias("rows")), n)
    now = current(store, base, n).join(changes.select("part").distinct(), "part", "left_semi")
    store.write("burnin", now.where("status <> 'unmatched'").select("part", "segment_id", "status", "text"), n)
    sure = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    again = plan.withColumn("reason", maintain.retry_reason(F.col("decision"), F.col("suggestion"), F.when(sure <= 1, sure * 100).otherwise(sure), threshold)).where("reason <> 'none'").select("segment_id", "reason")
    if not skip_missing:
        silent = questions.select(F.col("row_id").alias("segment_id")).distinct().join(answers.select("segment_id"), "segment_id", "left_anti")
        again = again.unionByName(silent.withColumn("reason", F.lit("missing")))
    again = again.select(F.concat("segment_id", F.lit(f"#{n + 1}")).alias("custom_id"), F.col("segment_id").alias("row_id"), "reason")
    requests = store.write("requests", again, n + 1)
    counts = {
        "asked": questions, "answered": answers, "changed": changes, "asked_again": requests, "unresolved": ingest.where("state not in ('ok', 'missing-response')"),
    }
    facts = records.one_row_report({k: df.groupBy().count() for k, df in counts.items()}).select(*(F.col(f"{k}_count").alias(k) for k in counts))
    handoff = store.write("handoff", facts, n)
    spent(answered, delta)
    store.commit(n, {k: v for k, v in handoff.first().asDict().items() if k != "round"})
    return n
