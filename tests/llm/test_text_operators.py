"""Quality, language, pieces, fingerprints: small fixtures, library and brute-force comparisons."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tickloom.llm import fingerprints, language, neighbours, pieces, quality, queries
from tickloom.llm.common import held_out, table

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a ", "a  b", "\n", "\na\n\nb", "▁a", "日本 語\n𝒳", "\t a\r\n", "é ü", "<s> a </s>", "<0x0A>", "x" * 40_000]


def test_held_out_is_a_crc_rule(spark):
    import zlib

    got = spark.range(40).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got) and any(r.h for r in got)
    assert spark.sql("select cast(null as bigint) as id").select(held_out("id").alias("h")).first().h is False


def test_pieces_equal_the_library_and_spans_cover(spark):
    texts = [*ODD, None]
    frame = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id int, text string, encoded string")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r.encoded for r in pieces.encode(frame, MODEL).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        got = rows[i]
        assert got.ids == ids and got.decoded == library.decode(ids)
        if ids:
            assert got.starts[0] == 0 and got.ends[-1] == len((t or "").encode())
            assert all(a <= b for a, b in zip(got.starts, got.ends)) and got.starts[1:] == got.ends[:-1]
    assert pieces.encode(frame.limit(0), MODEL).count() == 0


def test_normalisation_follows_the_compiled_map():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    spec = proto.normalizer_spec
    mine = pieces.Normalizer(pieces.CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix,
                             spec.remove_extra_whitespaces, spec.escape_whitespaces, False)
    rng = random.Random(2)
    for text in ["ＡＢＣ ﬁ　ｱﾞ  x", "  a  b ", "①②", "ﷺ", "   ", *("".join(rng.choice("aＡﬁ　 ｱﾞé①\t") for _ in range(9)) for _ in range(400))]:
        normal, source = mine(text)
        assert normal.decode() == library.normalize(text)
        assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())
    normal, source = mine("x ﬁ")  # one ligature of three bytes gives two letters
    assert source[normal.decode().encode().index(b"f")] == source[normal.index(b"i")] == 2


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_fingerprints_estimate_similarity(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    pairs = []
    for i in range(120):
        a = [rng.choice(words) for _ in range(rng.choice([3, 20, 200, 900]))]
        cut = rng.randrange(len(a) + 1)
        b = a[:cut] + [rng.choice(words) for _ in range(len(a) - cut)]
        pairs.append((i, " ".join(a), "  ".join(b)))
    pairs += [(200, "", ""), (201, None, ""), (202, "", "a b c"), (203, "a\tb", "A b"), (204, "x " * 20_000, "x " * 20_000)]
    frame = spark.createDataFrame(pairs, "i int, a string, b string").withColumn("fa", F.lit("clash"))
    got = fingerprints.fingerprint(fingerprints.fingerprint(frame, "a", "fa"), "b", "fb")
    rows = got.select("i", "a", "b", fingerprints.likeness("fa", "fb").alias("l"), fingerprints.as_text("fa").alias("t"),
                      fingerprints.as_text("fb").alias("u")).collect()
    errors = []
    for r in rows:
        x, y = _shingles(r.a or ""), _shingles(r.b or "")
        true = len(x & y) / len(x | y) if x | y else 1.0
        errors.append(abs(true - r.l))
        if x == y:
            assert r.t == r.u and r.l == 1.0
        assert len(r.t) == (512 if x else 0)
    assert np.mean(errors) < 0.04 and max(errors) < 0.2
    assert next(r for r in rows if r.i == 202).l == 0.0


def test_likeness_of_unequal_short_texts_is_not_biased(spark):
    # (shingles of the shorter, shingles of the longer text, which adds words at its end)
    sizes = [(2, 3), (3, 4), (4, 5), (5, 6), (2, 5)]
    pairs = [(f"{m}/{n}", " ".join(f"k{i}m{m}n{n}w{j}" for j in range(m + 4)), " ".join(f"k{i}m{m}n{n}w{j}" for j in range(n + 4)))
             for m, n in sizes for i in range(200)]
    frame = spark.createDataFrame(pairs, "kind string, a string, b string").repartition(8)
    got = fingerprints.fingerprint(fingerprints.fingerprint(frame, "a", "fa"), "b", "fb")
    means = {r.kind: r.l for r in got.groupBy("kind").agg(F.avg(fingerprints.likeness("fa", "fb")).alias("l")).collect()}
    assert all(abs(means[f"{m}/{n}"] - m / n) < 0.02 for m, n in sizes), means


def test_null_and_repeated_ids_are_one_row_each(spark, tmp_path):
    rows = [(1, "one a b c d e"), (2, "two x y"), (2, "two z"), (2, "two z"), (None, "none one"), (None, None), (3, "three")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    twins = [r for r in got if r.n_chars == 5 and r.doc_id == 2]
    assert len({r.fingerprint for r in twins}) == 1 and 1.0 in [r.near_next for r in twins]
    whole = spark.createDataFrame(rows, "doc_id bigint, text string")
    alone = {r.f for r in fingerprints.fingerprint(whole, "text", "fp").select(fingerprints.as_text("fp").alias("f")).collect()}
    assert {r.fingerprint for r in got} == alone


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_likeness_counts_lanes(spark, bits):
    rng = np.random.default_rng(bits)
    words = fingerprints.BINS * bits // 64
    a, b = rng.integers(-2**63, 2**63, words), rng.integers(-2**63, 2**63, words)
    lanes = lambda w: [(int(x) >> s) & ((1 << bits) - 1) for x in w.view(np.uint64) for s in range(0, 64, bits)]
    share = np.mean([x == y for x, y in zip(lanes(a), lanes(b))])
    frame = spark.createDataFrame([([int(x) for x in a], [int(x) for x in b])], "a array<bigint>, b array<bigint>")
    got = frame.select(fingerprints.likeness("a", "b", bits).alias("l")).first().l
    assert got == pytest.approx(max(0.0, (share - 2.0 ** -bits) / (1 - 2.0 ** -bits)))


def test_next_ids_over_many_ranges(spark):
    ids = [3 * i for i in range(57)] + [None]
    got = {r.doc_id: r.next_doc_id for r in neighbours.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id bigint"), range_rows=7).collect()}
    order = [None, *sorted(i for i in ids if i is not None)]
    assert got == {x: order[(k + 1) % len(order)] for k, x in enumerate(order)}
    assert neighbours.next_ids(spark.createDataFrame([(5,)], "doc_id bigint")).first().next_doc_id == 5
    assert neighbours.next_ids(spark.createDataFrame([], "doc_id bigint")).count() == 0


def test_quality_learns_from_the_learnable_rows(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    labels = table(spark, SF, "labels")
    model = quality.train_quality(docs, labels.where(~held_out()))
    assert model.rules and all(w != 0 for w in model.weights)
    got = quality.score_quality(docs, model).join(labels.where(held_out()), "doc_id").select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "x " * 60_000, 9.0)], "doc_id int, text string, score double")
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == 3 and rows[0].score == rows[1].score and 0 <= rows[2].score <= 1
    # compiled column equals the rules evaluated by hand
    text = "Some || text!! with 12 WORDS\nSome || text!! with 12 WORDS"
    stats = quality.text_statistics(text)
    total = model.intercept + sum(w for r, w in zip(model.rules, model.weights)
                                  if all((stats[i] <= t) if m else (stats[i] > t) for i, m, t in r))
    one = quality.score_quality(spark.createDataFrame([(text,)], "text string"), model).first().score
    assert one == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_without_two_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = quality.train_quality(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int"))
    assert quality.score_quality(docs, none).first().score == 0.5
    one = quality.train_quality(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert quality.score_quality(docs, one).first().predicted == 1


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = language.train_language(docs.where(~held_out()))
    got = language.identify(docs.where(held_out()), model).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    odd = spark.createDataFrame([(None,), ("",), ("12 #!",), ("the " * 50_000,)], "text string").withColumn("lang_pred", F.lit(1))
    rows = language.identify(odd, model).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and [r.score for r in rows[:3]] == [0.0] * 3
    assert rows[3].lang_pred in model.languages and 0 < rows[3].score <= 1
    assert language.identify(odd.limit(1), language.train_language(docs.limit(0))).first().lang_pred == "und"


def test_folded_weights_equal_the_kernel_form():
    texts = ["the cat and the dog", "le chat et le chien", "the house and the tree", "la maison et la mer"]
    bits = np.array([language.presence(t) for t in texts])
    model = language.fit_language(np.packbits(bits, axis=1), ["en", "fr", "en", "fr"], ridge=0.1)
    rows = bits / np.sqrt(bits.sum(axis=1, keepdims=True))
    kernel = rows @ rows.T
    # all texts are landmarks, so the Nystroem form is plain kernel ridge regression
    target = np.array([[1, -1], [-1, 1], [1, -1], [-1, 1]])
    alpha = np.linalg.solve(kernel + 0.1 * 4 * np.eye(4), target)
    assert np.allclose(rows @ model.weights, kernel @ alpha, atol=1e-4)


def test_shingle_hash_is_stable():
    from tickloom.llm.shingles import shingle_set

    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("A b")) == 1
    assert shingle_set("A b").tolist() == shingle_set("a\tb").tolist() != shingle_set("b a").tolist()
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0
