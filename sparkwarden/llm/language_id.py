"""Language identification with error-correcting output codes.

Every language has a codeword; for each bit a binary linear classifier over
hashed letter n-grams is trained (weighted ridge regression on +-1, on the
driver, on a sample bounded in rows and bytes).  Decoding takes the codeword with the least loss, each bit's
loss weighted by how well the bit's classifier did on the sample.  If the two
nearest codewords are about equally near the row is flagged as ambiguous.

Defined results: null text, empty text and text without a letter give ``und``
with score 0; no usable label at all makes every text ``und``; one label only
makes it the answer wherever there is a letter, with score 1.  Repeated rows
get equal answers.  Extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UND = "und"
_LETTER = regex.compile(r"\p{L}")
_BITS = 14
#: Gram columns that training holds as a dense block at a time.
_BLOCK = 1024
#: Bytes of grams that training takes to the driver at most (6 a distinct gram of a text).
MAX_BYTES = 64 << 20
#: Up to so many labels (with their counts) are broadcast to the scan of the texts.
BROADCAST_LABELS = 10_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x41] = 0x20
_FOLD[0x5B:0x61] = 0x20
_FOLD[0x7B:0x80] = 0x20


@dataclass
class Model:
    """``code`` (languages x bits, +-1), ``weights`` (features x bits), bit weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray
    scale: float
    ambiguity: float


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """+-1 codewords for k classes: exhaustive to 7 classes, else random of 15 log2 k bits."""
    if k <= 7:
        rest = itertools.product((1, -1), repeat=max(k - 1, 0))
        columns = [(1, *r) for r in rest if -1 in r]
        return np.array(columns, dtype=np.float32).T.reshape(k, -1)
    bits = math.ceil(15 * math.log2(k))
    best, gap = None, -1
    rng = np.random.default_rng(seed)
    for _ in range(50):
        code = rng.choice(np.array([1, -1], dtype=np.float32), size=(k, bits))
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if apart > gap and np.all(np.abs(code.sum(axis=0)) < k):
            best, gap = code, apart
    return best


def features(text: str) -> np.ndarray:
    """Hashed 1- to 4-byte grams of the lower-cased letters of a whole text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    b = _FOLD[raw]
    b = b[np.append(True, (b[1:] != 0x20) | (b[:-1] != 0x20))].astype(np.uint32)
    grams, out = b, [b]
    for n in range(2, 5):
        if len(grams) < 2:
            break
        grams = grams[:-1] * np.uint32(0x9E3779B1) + b[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
        out.append((grams ^ (grams >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - _BITS))
    return np.concatenate(out)


def _margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of a text's grams for each bit; long texts go by counts."""
    if len(x) > 1 << (_BITS - 1):
        counts = np.bincount(x, minlength=1 << _BITS).astype(np.float32)
        return counts @ weights / len(x)
    return weights[x].sum(axis=0) / len(x)


@dataclass
class Grams:
    """Share of each hashed gram in one text: gram numbers and float32 shares, as bytes."""

    number: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, text: str) -> Grams:
        grams = features(text)
        number, count = np.unique(grams, return_counts=True)
        return cls(number.astype(np.uint16), (count / len(grams)).astype(np.float32))


def fit(texts: list[str], labels: list[str], ambiguity: float = 0.1, ridge: float = 0.02) -> Model | None:
    """Train on the given rows; rows without a letter are passed over."""
    rows = [(Grams.of(t), y) for t, y in zip(texts, labels) if t is not None and y is not None and _LETTER.search(t)]
    return fit_grams([g for g, _ in rows], [y for _, y in rows], ambiguity, ridge)


def fit_grams(rows: list[Grams], labels: list[str], ambiguity: float = 0.1, ridge: float = 0.02) -> Model | None:
    """Train on the grams of each row.

    Memory: the rows as given, two rows x rows matrices, and a block of ``_BLOCK``
    gram columns at a time.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    code = codewords(len(languages))
    d, scale, n = 1 << _BITS, 8.0, len(rows)
    at = {y: i for i, y in enumerate(languages)}
    y = np.array([at[label] for label in labels])
    importance = (1.0 / np.bincount(y, minlength=len(languages)))[y]
    importance /= importance.mean()
    # Rare grams weigh more; then every bit is a weighted ridge regression on +-1, solved in the dual.
    mean = np.zeros(d)
    for g in rows:
        mean[g.number] += g.share
    rare = (1 / np.sqrt(mean / n + 1e-5)).astype(np.float32)
    target = code[y]
    bias = (importance[:, None] * target).mean(axis=0)

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        for start in range(0, d, _BLOCK):
            block = np.zeros((n, _BLOCK), dtype=np.float32)
            for i, g in enumerate(rows):
                a, b = np.searchsorted(g.number, [start, start + _BLOCK])
                block[i, g.number[a:b] - start] = g.share[a:b]
            block *= rare[start : start + _BLOCK]
            yield start, block

    kernel = np.zeros((n, n))
    for _, block in blocks():
        kernel += block @ block.T
    penalty = ridge * np.trace(kernel) / n
    kernel[np.diag_indices(n)] += penalty / importance
    factor = np.linalg.cholesky(kernel)
    del kernel
    half = _lower_inverse(factor)
    del factor
    dual = half.T @ (half @ (target - bias))
    weights = np.zeros((d, code.shape[1]), dtype=np.float32)
    for start, block in blocks():
        weights[start : start + _BLOCK] = block.T @ dual.astype(np.float32)
    weights *= rare[:, None]
    # Left-one-out margins of a ridge regression tell how far to trust each bit.
    left_out = target - dual / np.einsum("ij,ij->j", half, half)[:, None]
    accuracy = ((left_out * target > 0) * importance[:, None]).mean(axis=0)
    bit_weight = np.maximum(0.05, 2 * accuracy - 1).astype(np.float32)
    return Model(languages, code, weights, bias, bit_weight, scale, ambiguity)


def _lower_inverse(factor: np.ndarray, step: int = 256) -> np.ndarray:
    """Inverse of a lower triangular matrix, by blocks of rows."""
    n = len(factor)
    out = np.zeros((n, n))
    for a in range(0, n, step):
        b = min(a + step, n)
        own = np.linalg.inv(factor[a:b, a:b])
        out[a:b, a:b] = own
        out[a:b, :a] = -own @ (factor[a:b, :a] @ out[:a, :a])
    return out


def decode(model: Model, margins: np.ndarray) -> tuple[str, str | None, float, bool]:
    """Nearest and second codeword by weighted logistic loss, score, ambiguity."""
    if len(model.languages) == 1:
        return model.languages[0], None, 1.0, False
    loss = np.logaddexp(0, -model.code * margins * 2) @ model.bit_weight / model.bit_weight.sum()
    p = np.exp(-model.scale * (loss - loss.min()))
    p /= p.sum()
    order = np.argsort(loss, kind="stable")
    first, second = order[0], order[1]
    return model.languages[first], model.languages[second], float(p[first]), bool(p[first] - p[second] < model.ambiguity)


def predict(model: Model | None, text: str | None) -> tuple[str, str | None, float, bool]:
    if model is None or text is None or not _LETTER.search(text):
        return UND, None, 0.0, True
    return decode(model, _margins(features(text), model.weights) + model.bias)


def learn(docs: DataFrame, per_language: int, max_rows: int, id_col: str, text_col: str, lang_col: str, max_bytes: int = MAX_BYTES) -> Model | None:
    """A model fitted on a bounded sample, by hash of the id, of about ``per_language`` rows a language.

    Counting the labels covers all rows and all labels.  Executors turn the
    sampled texts into grams; at most ``max_rows`` rows and ``max_bytes`` of grams
    (in the order of the hash, so that all languages thin out alike) come to the
    driver, whatever the length of the texts.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h")).where("lang is not null")
    span = 1 << 20
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.least(F.lit(span), F.ceil(F.lit(span * per_language) / F.col("n"))).alias("share"))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LABELS else counts
    drawn = rows.where("text is not null").join(counts, "lang").where(F.pmod("h", F.lit(span)) < F.col("share"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, lang, h in zip(batch["text"], batch["lang"], batch["h"]):
                if _LETTER.search(text):
                    g = Grams.of(text)
                    yield pd.DataFrame({"h": [h], "lang": [lang], "number": [g.number.tobytes()], "share": [g.share.tobytes()]})

    found = drawn.mapInPandas(run, "h long, lang string, number binary, share binary").orderBy("h", "lang", "number", "share").limit(max_rows)
    upto = Window.orderBy("h", "lang", "number", "share").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("bytes", F.sum(F.length("number") + F.length("share")).over(upto)).where(F.col("bytes") <= max_bytes)
    rows = found.select("lang", "number", "share").collect()
    grams = [Grams(np.frombuffer(r["number"], dtype=np.uint16), np.frombuffer(r["share"], dtype=np.float32)) for r in rows]
    return fit_grams(grams, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, lang_second, score, ambiguous."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [predict(shared.value, t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "lang_pred": [o[0] for o in out], "lang_second": [o[1] for o in out], "score": [o[2] for o in out], "ambiguous": [o[3] for o in out]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(run, f"id {kind}, lang_pred string, lang_second string, score double, ambiguous boolean")
    return found.withColumnRenamed("id", id_col)


def filter_known(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = 0.0, keep_ambiguous: bool = True) -> DataFrame:
    """Rows of ``docs`` with all their columns whose language could be told.

    Rejected: ``und``, rows whose score is below ``min_score``, and without
    ``keep_ambiguous`` those whose two nearest languages are about equally near.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        out = (predict(shared.value, t) for t in texts)
        return pd.Series([lang != UND and score >= min_score and (keep_ambiguous or not ambiguous) for lang, _, score, ambiguous in out], dtype=bool)

    return docs.where(known(F.col(text_col)))
