"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, clusters, fim, fingerprint, language, minhash, mixing, oracle, pieces, pii, quality, suffix, toxicity, warc
from tidemark.llm.common import documents

TOKENIZER = {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Target weights of the mixing query: domains by the source's number, then languages; sources alike.
DOMAINS, LANGS = {"d0": 0.5, "d1": 0.3, "d2": 0.2}, {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
#: The weight of each domain or language that the target weights don't list, the empty one included.
OTHER = 0.1
BUDGET = 0.6


def domain():
    return F.concat(F.lit("d"), F.pmod(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(3)).cast("string"))


def weighted(leaves: list[tuple]) -> mixing.Node:
    """The tree of the leaves that a table has, by the target weights."""
    return mixing.default_tree(leaves, DOMAINS, LANGS, OTHER)


def mixing_tree(docs: DataFrame) -> mixing.Node:
    leaves = docs.select(F.coalesce(domain(), F.lit("")).alias("d"), F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s")).distinct().collect()
    return weighted([tuple(x) for x in leaves])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(documents(spark, sf_dir), keep=False)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), TOKENIZER)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).drop("rejected_by")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), toxicity.held_out().alias("held_out"), toxicity.score(model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    text = F.col("record_type") == "conversion"
    links = F.get_json_object("meta", "$.links")
    made = made.withColumn("meta", F.when(~text, F.col("block")))
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "title",
        F.when(text, F.substring("block_digest", 8, 64)).otherwise("").alias("text_sha256"), F.when(text, F.col("content_length")).otherwise(-1).alias("text_bytes"),
        F.when(~text, links.cast("long")).otherwise(-1).alias("n_links"),
    )


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = language.learn(docs.where(~held))
    rows = docs.select("doc_id", "text")
    return language.identify(rows, profiles).withColumn("held_out", held)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = mixing.mixed(docs.select("doc_id", "text", "lang", "source"), weighted, BUDGET, domain())
    return rows.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", clusters.digest("centroid").alias("centroid_sha256"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transformed(documents(spark, sf_dir))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    rows = pieces.encoded(documents(spark, sf_dir), PIECES)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_bpe, op3_pii, op4_quality, op5_minhash, op6_toxicity, op7_warc, op8_fingerprint, op9_language, op10_mixing, op11_clusters, op12_fim, op13_pieces, pipeline)
}

_QUALITY = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
f as (select doc_id, t, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls)::bigint as n_lines,
             length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as upper_chars,
             length(regexp_replace(t, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g'))::bigint as letters, ws from w),
g as (select doc_id, unnest(range(1, len(ws) - 3)) as i, ws from f where len(ws) >= 5),
h as (select doc_id, i, list_slice(ws, i, i + 4) as win from g),
k as (select doc_id, i from (select *, count(*) over (partition by doc_id, win) as c from h) where c > 1),
r as (select doc_id, count(distinct i + j)::bigint as n_repeat_words from k, (select unnest(range(0, 5)) as j) group by doc_id),
b as (select f.*, coalesce(r.n_repeat_words, 0) as n_repeat_words from f left join r using (doc_id)),
c as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (100 * n_symbols > 40 * n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
           or 100 * n_dup_lines > 50 * n_lines or 100 * upper_chars > 60 * letters or 100 * letters < 50 * word_chars) as kept
from c"""

ORACLE_SQL: dict[str, str] = {
    "op4_quality": _QUALITY,
    "op11_clusters": oracle.clusters(),
    "op12_fim": oracle.FIM,
    "op7_warc": oracle.WARC,
}
