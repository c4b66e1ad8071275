"""Review rounds that are lost and run again, and what they change."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rounds


def replies(spark, rows):
    body = lambda d, s, c: json.dumps({"decision": d, "suggested_chinese_text": s, "confidence": c})
    return spark.createDataFrame([(json.dumps({"custom_id": k, "content": body(*x) if isinstance(x, tuple) else x}),) for k, x in rows], "value string")


@pytest.fixture(scope="module")
def tables(spark):
    base = spark.createDataFrame([(str(i), f"p{i % 3}", "matched" if i % 4 else "unmatched", f"t{i}" if i % 4 else "") for i in range(9)], "segment_id string, part string, status string, text string")
    first = spark.createDataFrame([(f"c{i}", str(i)) for i in range(8)], "custom_id string, row_id string")
    one = replies(spark, [("c0", ("suggest_new_match", " new 0 ", 0.9)), ("c1", ("keep_current_match", "", 95)), ("c2", ("reject_current_match", "", 0.8)), ("c3", ("unsure", "", 0.9)), ("c4", ("suggest_new_match", "", 0.9)), ("c5", "broken"), ("c6", ("suggest_new_match", "new 6", 0.2)), ("zz", ("unsure", "", 1))])
    two = replies(spark, [("3#2", ("no_match", "", 0.9)), ("4#2", ("suggest_new_match", "new 4", 0.9)), ("5#2", ("keep_current_match", "", 0.7)), ("6#2", ("suggest_new_match", "better 6", 0.99))])
    return base, first, one, two


def state(store):
    out = {}
    for name in rounds.TABLES:
        df = store.spark.read.parquet(f"{store.folder}/{name}")
        out[name] = sorted(str(sorted(r.asDict().items())) for r in df.collect())
    return out


def test_rounds_change_and_ask_again(spark, tmp_path, tables):
    base, first, one, two = tables
    store = rounds.Store(spark, str(tmp_path))
    assert store.committed() == 0 and rounds.current(store, base).count() == 9
    assert rounds.advance(store, base, first, one) == 1 and store.committed() == 1
    assert store.manifest(1) == {"round": 1, "asked": 8, "answered": 6, "changed": 3, "asked_again": 5, "unresolved": 2}
    again = {r.row_id: r.reason for r in rounds.asked(store, first, 2).join(spark.read.parquet(f"{tmp_path}/requests"), ["custom_id", "row_id"]).collect()}
    assert again == {"3": "unsure", "4": "missing-suggestion", "5": "missing", "6": "low-confidence", "7": "missing"}
    assert {(r.part, r.change, r.rows) for r in spark.read.parquet(f"{tmp_path}/delta").collect()} == {("p0", "filled-from-unmatched", 1), ("p2", "cleared-to-unmatched", 1), ("p0", "replaced-text", 1)}
    assert rounds.advance(store, base, first, two) == 2
    got = {r.segment_id: (r.status, r.text) for r in rounds.current(store, base).collect()}
    want = {str(i): ("matched" if i % 4 else "unmatched", f"t{i}" if i % 4 else "") for i in range(9)}
    want |= {"0": ("model-text-fill", "new 0"), "2": ("unmatched", ""), "3": ("unmatched", ""), "4": ("model-text-fill", "new 4"), "6": ("model-text-replace", "better 6")}
    assert got == want
    assert {r.text for r in rounds.current(store, base, 1).collect()} >= {"new 6", "t3"}  # earlier rounds can still be read
    assert {r.part for r in spark.read.parquet(f"{tmp_path}/burnin").where("round = 2").collect()} == {"p0", "p1"}  # only parts with changes


@pytest.mark.parametrize("lost", ["changes", "requests", "handoff"])
def test_a_lost_run_is_repeated(spark, tmp_path, tables, lost, monkeypatch):
    """A run that dies after it wrote half-made rows of a table: nothing counts, and the next run leaves the same tables."""
    base, first, one, two = tables
    whole, broken = rounds.Store(spark, str(tmp_path / "whole")), rounds.Store(spark, str(tmp_path / "broken"))
    rounds.advance(whole, base, first, one)
    write = rounds.Store.write

    def dying(self, name, df, n):
        made = write(self, name, df if name != lost else df.unionByName(df), n)
        if name == lost:
            raise KeyboardInterrupt(name)
        return made

    monkeypatch.setattr(rounds.Store, "write", dying)
    with pytest.raises(KeyboardInterrupt):
        rounds.advance(broken, base, first, one)
    monkeypatch.setattr(rounds.Store, "write", write)
    assert broken.committed() == 0 and rounds.current(broken, base).where("status like 'model-text%'").count() == 0
    assert rounds.advance(broken, base, first, one) == 1
    assert state(broken) == state(whole) and broken.manifest(1) == whole.manifest(1)


def test_a_round_without_answers(spark, tmp_path, tables):
    base, first, one, _ = tables
    store = rounds.Store(spark, str(tmp_path))
    assert rounds.advance(store, base, first, one.limit(0), skip_missing=True) == 1
    assert store.manifest(1) == {"round": 1, "asked": 8, "answered": 0, "changed": 0, "asked_again": 0, "unresolved": 0}
    assert rounds.advance(store, base, first, one) == 2 and store.manifest(2)["asked"] == 0
    with pytest.raises(RuntimeError):
        store.commit(2, {})
    assert rounds.current(store, base).exceptAll(base.select("segment_id", "part", "status", F.col("text"))).count() == 0


def test_replies_are_parsed_once_a_round(spark, tmp_path):
    """Each reply's text is found and parsed in one pass of one job, however many outcomes the ingest tells apart."""
    from tidemark.operators import records
    from tidemark.sources import logs

    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: read.add(1) or x, "string").asNondeterministic()
    lines = spark.createDataFrame([(f'{{"custom_id": "c{i}", "content": "{{\\"decision\\": \\"d{i}\\"}}"}}',) for i in range(8)], "value string").withColumn("value", seen("value"))
    asked = spark.createDataFrame([(f"c{i}", f"r{i}") for i in range(9)], "custom_id string, row_id string")
    got = sorted((r.row_id, r.state, r.decision) for r in records.ingest(asked, logs.replies(lines)).collect())
    assert got == [(f"r{i}", "ok", f"d{i}") for i in range(8)] + [("r8", "missing-response", "")]
    assert read.value == 8
