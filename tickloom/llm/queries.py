"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    fingerprints, language, mixing, neighbours, oracles, perspectives, phrases, pieces, quality, sharding, spelling,
    token_automata, trie_join, url_rules, vptree)
from tickloom.llm.common import held_out, table, word_count
from tickloom.plans.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 40
TOKENIZER = "piece_bpe_32k.model"
COUNT_TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 3, "fr": 3, "es": 3}}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict",
                                              F.array_join("mined", " ").alias("mined"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = quality.train_quality(docs, labels)
    return (quality.score_quality(docs.withColumn("held_out", held_out()), model)
            .select("doc_id", "held_out", "score", "predicted"))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # file and place in it stand for a row, as ids may be null or repeated
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("uid"))
    # rows in id order, those of one id by text
    place = F.struct("doc_id", F.xxhash64("text").alias("mark"), "uid").alias("place")
    order = neighbours.next_ids(docs.select(place, F.char_length("text").cast("bigint").alias("n_chars")), "place")
    order = stage(order.select("place.doc_id", "place.uid", F.col("next_place.uid").alias("next_uid"), "n_chars"))
    # each text goes to its own row, and its beginning to the row before
    texts = docs.select("uid", "text")
    own = texts.join(order, "uid")
    heads = texts.join(order.select(F.col("uid").alias("for_uid"), F.col("next_uid").alias("uid"), "n_chars"), "uid")
    heads = heads.select(F.col("for_uid").alias("uid"), F.expr("left(text, cast(n_chars div 2 as int))").alias("head"))
    pairs = own.join(heads, "uid").select(
        "uid", "next_uid", "doc_id", "n_chars", "text",
        F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), head)").alias("edited"))
    marked = fingerprints.fingerprint(pairs.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "text", "fp")
    marked = stage(fingerprints.fingerprint(marked, "edited", "edited_fp").drop("text", "edited"))
    after = marked.select(F.col("uid").alias("next_uid"), F.col("fp").alias("next_fp"))
    return marked.join(after, "next_uid").select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text("fp").alias("fingerprint"),
        fingerprints.as_text("edited_fp").alias("edited_fingerprint"),
        fingerprints.likeness("fp", "edited_fp").alias("near_edited"),
        fingerprints.likeness("fp", "next_fp").alias("near_next"))


@query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.col("encoded.ids")
    return (pieces.encode(docs, public_tokenizers.path(TOKENIZER))
            .select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"),
                    F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                    F.sha2(F.col("encoded.decoded").cast("binary"), 256).alias("decoded_sha256"),
                    F.coalesce(F.try_element_at("encoded.ends", F.lit(-1)), F.lit(0)).alias("covered_bytes")))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = language.train_language(docs.where("not held_out"))
    return language.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate_perspectives(table(spark, sf_dir, "conversations"))


@query
def op8_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.similar_classes(table(spark, sf_dir, "documents"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return (sharding.uniform_shards(rows, SHARDS)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def with_domain(docs: DataFrame) -> DataFrame:
    """Sources in four domains by their number; sources without a number are in d0."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    return docs.withColumn("domain", F.concat(F.lit("d"), F.pmod(
        F.when(number == "", F.lit(0)).otherwise(number.cast("int")), F.lit(4)).cast("string")))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", word_count().alias("n_tokens"))
    return (mixing.mix(with_domain(docs), MIX_WEIGHTS)
            .select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_tokens", "leaf_budget", "copies"))


@query
def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.col("n_tokens")
    return (token_automata.count_tokens(docs, public_tokenizers.path(COUNT_TOKENIZER))
            .select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), n,
                    (n > TOKEN_LIMIT).alias("over_limit")))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_collocations(table(spark, sf_dir, "documents"))


ORACLES["op5_perspectives"] = oracles.PERSPECTIVES
ORACLES["op8_trie_join"] = oracles.TRIE_JOIN
ORACLES["op11_variants"] = oracles.VARIANTS
ORACLES["op13_collocations"] = oracles.COLLOCATIONS
ORACLES["op10_mixing"] = oracles.mixing(MIX_WEIGHTS, (3, 5), 2, 11)
