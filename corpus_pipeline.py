"""Corpus pipeline: quality, language, near duplicates, mixing, token pieces.

Every stage takes (spark, docs, sf_dir), works on all documents the stage before kept, and returns a
DataFrame; all but the last return the columns of ``documents``. Null texts count as empty. Columns beyond
doc_id, text, lang and source ride along under names of their own, so none clashes with a result of an operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import language, mixing, pieces, quality, trie_join
from tickloom.llm.common import held_out, table, word_count
from tickloom.llm.queries import MIX_WEIGHTS, TOKENIZER, with_domain
from tickloom.plans.staging import stage

#: Least lead of a predicted language over the next one; below it no language stands out.
LANGUAGE_LEAD = 0.02
#: The mix takes this share of the tokens it is given.
MIX_SHARE = (4, 5)


#: Columns that the stages read by name.
READ = ("doc_id", "text", "lang", "source")


def _own_names(docs: DataFrame) -> DataFrame:
    """``docs`` with every column that no stage reads under a name no operator uses."""
    return docs.toDF(*[c if c in READ else f"__given{i}" for i, c in enumerate(docs.columns)])


def _given_names(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` alone, under their names again."""
    return rows.select(*_own_names(docs).columns).toDF(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7, the threshold of the classifier.

    Null and empty texts are scored as empty ones; every row is judged by itself, repeated ones alike.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = quality.train_quality(docs.select("doc_id", "text"), labels)
    return _given_names(quality.score_quality(_own_names(docs), model).where("predicted = 1"), docs)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language that leads by LANGUAGE_LEAD; null texts and texts without a letter go.

    Every row is judged by itself, repeated ones alike.
    """
    model = language.train_language(docs.where(~held_out()))
    said = language.identify(_own_names(docs), model)
    return _given_names(said.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("lead") >= LANGUAGE_LEAD)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id, then the smallest hash of its text.

    Rows are told apart by id and text: different texts under one id are documents of their own, rows equal
    in both are one, and of them the smallest by the other plain columns stays. Documents without id stay.
    """
    mark = F.xxhash64("doc_id", "text")
    named = _own_names(docs)
    known = named.where("doc_id is not null").withColumn("__mark", mark)
    classes = stage(trie_join.similar_classes(known.select("__mark", "text"), key="__mark")
                    .select(F.col("doc_id").alias("__mark"), "component_id").distinct())
    ids = known.select("__mark", "doc_id").distinct()
    stays = stage(classes.join(ids, "__mark").groupBy("component_id").agg(F.min(F.struct("doc_id", "__mark")).alias("__s"))
                  .select("__s.__mark"))
    plain = [f.name for f in named.schema if isinstance(f.dataType, T.AtomicType)]
    first = Window.partitionBy("__mark").orderBy(*plain)
    kept = known.join(stays, "__mark", "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return _given_names(kept, docs).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in target weights by domain, language and source; a second epoch repeats a document's row.

    Null texts have no tokens. Rows equal in id and text are taken or left together.
    """
    mark = F.xxhash64("text")
    named = _own_names(docs)
    narrow = named.select("doc_id", mark.alias("mark"), "lang", "source", word_count().alias("n_tokens"))
    # of rows equal in id and text the smallest language and source speak for all
    narrow = narrow.groupBy("doc_id", "mark").agg(F.min(F.struct("lang", "source", "n_tokens")).alias("s")).select("doc_id", "mark", "s.*")
    narrow = stage(with_domain(narrow))
    taken = mixing.mix(narrow, MIX_WEIGHTS, MIX_SHARE).where("copies > 0").select(
        F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("copies").alias("__copies"))
    joined = named.join(taken, named["doc_id"].eqNullSafe(F.col("__id")) & (mark == F.col("__mark")))
    return _given_names(joined.withColumn("__epoch", F.explode(F.sequence(F.lit(1), "__copies"))), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, starts, ends: the pieces of every document and their bytes.

    Null and empty texts have no pieces; every row is encoded by itself; other columns are left out.
    """
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "lang", "source", F.size("encoded.ids").cast("bigint").alias("n_tokens"),
                        "encoded.ids", "encoded.starts", "encoded.ends")


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The fitted models and the tokenizer have no SQL form; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
