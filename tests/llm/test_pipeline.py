"""The pipeline's stages against plain Python on the stage before."""

import pytest
import sentencepiece
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import language, trie_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "src1", 0), (10**6 + 1, "1 2 3", None, None, 5)], docs.schema)
    docs, out = docs.unionByName(odd), {}
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t")
        step(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_stages_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.dtypes == before.dtypes, name
        assert 0 < after.count() <= 2 * before.count()


def test_quality_and_language_keep_most_and_drop_junk(stages, spark):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = after.join(labels, "doc_id").select("quality").collect()
    assert sum(r.quality for r in kept) / len(kept) > 0.9
    before, after = stages["language"]
    assert after.count() > 0.95 * before.where(F.col("text").rlike("[a-z]")).count()
    assert after.where("text is null or text = ''").count() == 0


def test_one_of_each_near_copy_stays(stages):
    before, after = stages["near copies"]
    classes = {r.doc_id: r.component_id for r in trie_join.similar_classes(before).collect()}
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(set(classes.values()))


def test_repeated_and_nameless_rows_in_near_copies(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, "a b c d e f", "en"), (None, "a b c d e f", "en")],
                                 "doc_id bigint, text string, lang string")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (True, 0)]


def test_different_texts_under_one_id_both_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en"), (1, "q r s t u v w", "en"), (0, "q r s t u v w", "fr"), (3, "", "en"), (3, None, "en")],
                                 "doc_id bigint, text string, lang string")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text or "", r.text is None) for r in got) == [
        (0, "q r s t u v w", False), (1, "a b c d e f", False), (3, "", False), (3, "", True)]


def test_clashing_columns_ride_along(spark):
    clash = ["score", "predicted", "lang_pred", "lead", "copies", "mark", "n_tokens", "component_id", "rep", "n", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in clash]).persist()
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in clash), name
    assert step(spark, docs.limit(0), SF).columns == docs.columns


def test_mixing_repeats_rows_within_the_budget(stages):
    before, after = stages["mixing"]
    words = lambda df: df.select(F.sum(F.size(F.split("text", " +")))).first()[0]
    assert after.join(before, "doc_id", "left_anti").count() == 0
    assert words(after) < words(before)
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2


def test_pieces_equal_the_library(stages):
    before, after = stages["pieces"]
    texts = {r.doc_id: r.text for r in before.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = after.collect()
    assert len(rows) == before.count() and all(r.ids == library.encode(texts[r.doc_id]) for r in rows)


def test_language_stage_rejects_only_what_it_says(stages, spark):
    before, after = stages["language"]
    model = language.train_language(before.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    said = language.identify(before, model)
    want = said.where(f"lang_pred <> 'und' and lead >= {corpus_pipeline.LANGUAGE_LEAD}").count()
    assert after.count() == want


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).columns == stages["pieces"][1].columns
