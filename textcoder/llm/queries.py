"""The registered queries of this subpackage: one thin ``opN_<name>`` per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcoder.llm import (bpe, divergence, exact_dedup, filter_audit, fingerprints, language_id, licenses, line_dedup, lm_scoring, mixing,
                           pii, sharding, simhash_dedup)
from textcoder.llm.util import cut, documents

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.filter("not held_out"))
    found = language_id.identify(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"),
                        F.col("language.score").alias("score"), F.col("language.proportions").alias("proportions"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text")
    both = bpe.decode(ids, path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = line_dedup.cleaned(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"),
                        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = fingerprints.with_next(docs.withColumn("fp", fingerprints.simhash(F.col("text"))), "doc_id", ["text", "fp"])
    n = F.length("text")
    changed = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - changed), F.substr("next_text", F.lit(1), changed))
    at = (at.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
          .withColumn("edited_fp", fingerprints.simhash(F.col("edited"))))
    at = cut(at.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited"))
    # The block tables find what lies within the radius of every fiftieth document.
    asked = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    near = (fingerprints.within_radius(at.filter(asked), at).groupBy("query").agg(F.sum("copies").alias("n_within")))
    at = at.join(near, asked & (F.col("fp") == F.col("query")), "left")
    return at.select("doc_id", "n_chars", "edited_sha256",
                     fingerprints.hex_digits(F.col("fp")).alias("fingerprint"),
                     fingerprints.hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
                     fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                     fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 40)


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    hits = F.col("licences")
    return found.select("doc_id", F.size(hits).cast("long").alias("n_licenses"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["licence"]))), ",").alias("licenses"),
                        F.coalesce(F.array_max(F.transform(hits, lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(documents(spark, sf_dir))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"),
                        listed("all_spans").alias("spans"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", lm_scoring.held_out())
    return lm_scoring.score(docs, lm_scoring.fit(docs.filter("not held_out")))
