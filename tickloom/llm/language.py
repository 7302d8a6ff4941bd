"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of letter n-grams (n = 2, 3, 4) present in both, normalised
by the texts' own counts. Landmark texts give a Nystroem map, on which one ridge regression per
language against the rest is fitted. As the presence kernel is linear in presence bits, map and
ridge weights fold into one matrix (bits x languages), and scoring is a product of blocks of
presence rows with it. N-grams are hashed into a table per order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import bounded_batches
from tickloom.plans.staging import stage

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
WIDTH = BUCKETS * len(ORDERS)
#: Training texts and landmarks per language; these bound the fit.
TEXTS_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 48
BLOCK = 32
#: Values of the hash by which training texts are chosen.
HASHES = 1 << 40
UNDETERMINED = "und"
PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("lead", T.DoubleType())])
_LETTER = regex.compile(r"\p{L}")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
_SPACED: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    """Code points with everything but letters made a blank; beyond the basic plane all count as letters."""
    if not _SPACED:
        _SPACED.append(np.array([c if chr(c).isalpha() else 32 for c in range(65536)], dtype=np.uint64))
    low = np.minimum(codes, 65535)
    return np.where(codes < 65536, _SPACED[0][low], codes.astype(np.uint64))


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams of all orders occur in the whole text."""
    out = np.zeros(WIDTH, dtype=bool)
    codes = _letters(np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    for k, order in enumerate(ORDERS):
        n = len(codes) - order + 1
        if n <= 0:
            continue
        mixed = codes[:n] * _MIX[0]
        for j in range(1, order):
            mixed += codes[j: j + n] * _MIX[j]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[1]
        out[k * BUCKETS + (mixed >> np.uint64(49)).astype(np.int64)] = True
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


@F.arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    return pa.array([np.packbits(presence(x)).tobytes() for x in texts.to_pylist()], pa.binary())


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # WIDTH x languages


def _unit_rows(packed: np.ndarray) -> np.ndarray:
    rows = np.unpackbits(packed, axis=1).astype(np.float32)
    rows /= np.maximum(np.sqrt(rows.sum(axis=1, keepdims=True)), 1.0)
    return rows


def fit_language(packed: np.ndarray, names: list[str], ridge: float = 0.01) -> LanguageModel:
    """Nystroem landmarks and one-versus-rest ridge regression from packed presence rows (bytes).

    Only the landmarks and one block of rows are unpacked at a time.
    """
    languages = tuple(sorted(set(names)))
    if not languages:
        return LanguageModel((), np.zeros((WIDTH, 0), dtype=np.float32))
    label = np.array(names)
    chosen = np.concatenate([np.flatnonzero(label == x)[:LANDMARKS_PER_LANGUAGE] for x in languages])
    marks = _unit_rows(packed[chosen])
    near = np.vstack([_unit_rows(packed[i: i + BLOCK]) @ marks.T for i in range(0, len(packed), BLOCK)]).astype(np.float64)
    values, vectors = np.linalg.eigh(near[chosen])
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    mapped = near @ whiten
    weight = np.array([len(label) / (len(languages) * (label == x).sum()) for x in label])
    target = np.where(label[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    gram = (mapped * weight[:, None]).T @ mapped + ridge * len(label) * np.eye(mapped.shape[1])
    alpha = np.linalg.solve(gram, (mapped * weight[:, None]).T @ target)
    return LanguageModel(languages, marks.T @ (whiten @ alpha).astype(np.float32))


def train_language(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                   texts_per_language: int = TEXTS_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``texts_per_language`` texts a language, those with the smallest hash of key and text.

    Rows without language or letters do not count, and repeated rows count once. Texts are chosen by (language, hash)
    alone: hashes above what a language's count makes likely to be needed stay where they are, the others are
    numbered, and the texts of the chosen ones are looked up last. Only their presence bits reach the driver,
    which bounds it by languages x texts_per_language x WIDTH bits.
    """
    bounded_batches(docs.sparkSession)
    known = (docs.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(text)).alias("mark"), F.col(text).alias("text"))
             .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
    narrow = stage(known.select("lang", "mark"))
    share = stage(narrow.groupBy("lang").agg((F.lit(2.0 * texts_per_language + 64) / F.count("*")).alias("share")))
    place = F.pmod("mark", F.lit(HASHES))
    first = Window.partitionBy("lang").orderBy(place, "mark")
    picked = stage(narrow.join(share, "lang").where(place < F.col("share") * HASHES).select("lang", "mark").distinct()
                   .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= texts_per_language).select("lang", "mark"))
    rows = (known.join(picked, ["lang", "mark"]).dropDuplicates(["lang", "mark"])
            .select("lang", "mark", _packed("text").alias("bits")).orderBy("lang", "mark").collect())
    packed = np.frombuffer(b"".join(r.bits for r in rows), dtype=np.uint8).reshape(-1, WIDTH // 8)
    return fit_language(packed, [r.lang for r in rows])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score (0 to 1) and lead.

    Null text, text without a letter, or a model without languages: 'und' with score 0. Ties go to
    the first language by name. The score is the softmax of the scaled margins, the lead how far the score is
    above that of the next language (the score itself if there is none). Whole texts are read,
    every row by itself; input columns named like a result are replaced.
    """
    bounded_batches(docs.sparkSession)
    languages, weights = model.languages, model.weights

    @F.arrow_udf(PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        names, scores, leads = [], [], []
        values = texts.to_pylist()
        for at in range(0, len(values), BLOCK):
            block = values[at: at + BLOCK]
            known = [has_letter(x) and bool(languages) for x in block]
            rows = np.zeros((len(block), WIDTH), dtype=np.float32)
            for i, x in enumerate(block):
                if known[i]:
                    rows[i] = presence(x)
            norms = np.maximum(np.sqrt(rows.sum(axis=1, keepdims=True)), 1.0)
            margins = (rows @ weights / norms).astype(np.float64)
            for i in range(len(block)):
                if not known[i]:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    leads.append(0.0)
                    continue
                best = int(np.argmax(margins[i]))
                names.append(languages[best])
                odds = np.exp(4.0 * (margins[i] - margins[i][best]))
                scores.append(float(1.0 / odds.sum()))
                leads.append(scores[-1] * (1.0 - float(np.delete(odds, best).max(initial=0.0))))
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(leads, pa.float64())], PREDICTION.names)

    return (docs.withColumn("__said", predict(text)).withColumn("lang_pred", F.col("__said.lang_pred"))
            .withColumn("score", F.col("__said.score")).withColumn("lead", F.col("__said.lead")).drop("__said"))
