"""The training-data operators over the driver's tables: thin queries with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_extract, metric_join, minhash, mixing, quality, runs, sql, substrings, toxicity, url_filter, warc, whitening
from .common import tuned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file's place; a parameter of the operator, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in the training order of its first copy; those without one at the end."""
    order = mixing.ordered(mixing.plan(table(tuned(spark), sf_dir, "documents"))).where("coalesce(copy, 0) = 0")
    return order.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 6).alias("first_position"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(tuned(spark), sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(tuned(spark), sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(tuned(spark), sf_dir, "pages"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(tuned(spark), sf_dir, "documents"))


def op6_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.links(table(tuned(spark), sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived record, with a digest of its bytes in place of them."""
    return warc.derivatives(warc.responses(table(tuned(spark), sf_dir, "pages"))).select("page_id", "target_uri", "record_type", "record_id", "refers_to", "linked_to", "content_type", "source_payload_digest", "block_digest", "content_length", F.sha2("warc", 256).alias("record_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(tuned(spark), sf_dir, "documents"), vocabulary())


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.lines(chat.as_calls(table(spark, sf_dir, "conversations")), chat.REPLY)
    return found.select("conv_id", "order_turn", "order_index", "order_phase", "kind", "call_id", "status", "level", F.array_join("errors", ",").alias("errors"), "json")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(tuned(spark), sf_dir, "embeddings"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.runs(runs.planted(table(tuned(spark), sf_dir, "documents"))))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.removed(table(tuned(spark), sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_url_filter, op3_quality, op4_html, op5_minhash, op6_metric_join, op7_warc, op8_toxicity, op9_bpe, op10_chat, op11_whitening, op12_runs, op13_substrings)
}
SQL = dict(sql.SQL)
