"""Language identification by multilingual mixture inference.

A document is seen as words drawn from a mixture of languages. Each language
has a model of letter trigrams (a word is padded by a blank on both sides),
and a word's likelihood under a language is the product over its trigrams.
Expectation-maximisation estimates the document's language proportions; the
language set is the one with the best penalised likelihood (BIC) among the
single best language and the nested sets of the most frequent languages.

Edge cases: a null text, an empty text and a text without a letter get
``und``, score 0 and no languages. Without training rows every row is ``und``.
Ties go to the language that comes first in code-point order. Repeated rows
each get a row. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import chunks, tidy

UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


@dataclass(frozen=True)
class Trigrams:
    """Trigram buckets of the letters of a list of texts, with word and text bounds."""

    bucket: np.ndarray  # one for each letter, the middle of its trigram
    word_start: np.ndarray  # index into bucket
    word_text: np.ndarray  # index of the text of each word


def trigrams(texts: list[str], bits: int) -> Trigrams:
    low = [t.lower() for t in texts]
    joined = "\n".join(["", *low, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    mixed = codes[at - 1] * np.uint32(0x9E3779B1) ^ codes[at] * np.uint32(0x85EBCA6B) ^ (codes[at + 1] + np.uint32(1)) * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    bucket = (mixed >> np.uint32(32 - bits)).astype(np.int32)
    first = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in low])  # the break after text i is at ends[i]
    return Trigrams(bucket, first, np.searchsorted(ends, at[first]))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages
    bits: int


def train(rows: DataFrame, bits: int = 15, smoothing: float = 0.5) -> Model:
    """Count trigram buckets of every row of (text, lang) with a language.

    The counts are bounded by languages x 2**bits whatever the input holds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for piece in chunks(pdf):
                for lang, group in piece.groupby("lang"):
                    got = np.bincount(trigrams(group["text"].tolist(), bits).bucket, minlength=1 << bits)
                    totals[lang] = totals[lang] + got if lang in totals else got
        for lang, n in totals.items():
            full = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": full.astype(np.int32), "n": n[full]})

    counted = (
        rows.where(F.col("lang").isNotNull()).select("lang", "text")
        .mapInPandas(tidy(count), "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(counted["lang"].unique())
    n = np.zeros((1 << bits, len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    n[counted["bucket"].to_numpy(np.int64), counted["lang"].map(column).to_numpy(np.int64)] = counted["n"]
    log_p = np.log(n + smoothing) - np.log((n + smoothing).sum(axis=0, keepdims=True))
    return Model(languages, log_p.astype(np.float32), bits)


def _em(p: np.ndarray, start: np.ndarray, text: np.ndarray, n: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``steps`` rounds, and the log likelihood under them (less each word's shift)."""
    for _ in range(steps):
        joint = pi[text] * p
        joint /= joint.sum(axis=1, keepdims=True)
        pi = np.add.reduceat(joint, start, axis=0) / n[:, None]
    return pi, np.add.reduceat(np.log((pi[text] * p).sum(axis=1)), start)


def mixtures(texts: list[str], model: Model, steps: int = 8, penalty: float = 1.0) -> np.ndarray:
    """Proportions of the chosen language set for each text; a row of zeros where there is no letter."""
    k = len(model.languages)
    out = np.zeros((len(texts), k))
    grams = trigrams(texts, model.bits)
    if not k or not len(grams.word_start):
        return out
    words = np.add.reduceat(model.log_p[grams.bucket], grams.word_start, axis=0).astype(np.float64)
    start = np.flatnonzero(np.diff(grams.word_text, prepend=-1))
    which = grams.word_text[start]
    n = np.diff(start, append=len(words)).astype(np.float64)
    text = np.repeat(np.arange(len(start)), n.astype(np.int64))
    shift = words.max(axis=1, keepdims=True)
    words -= shift
    alone = np.add.reduceat(words, start, axis=0)
    best = alone.argmax(axis=1)
    chosen = np.zeros((len(start), k))
    chosen[np.arange(len(start)), best] = 1.0
    if k > 1:
        p = np.maximum(np.exp(words), 1e-30)
        pi, loglik = _em(p, start, text, n, np.full((len(start), k), 1.0 / k), steps)
        one = alone.max(axis=1)
        price = penalty * np.log(n + 1)
        # no set can beat the likelihood of all languages: the others are settled
        open_ = np.flatnonzero(2 * (loglik - one) > price)
        if len(open_):
            mine = np.flatnonzero(np.isin(text, open_))
            p, m = p[mine], n[open_]
            text = np.repeat(np.arange(len(open_)), m.astype(np.int64))
            start = np.concatenate([[0], np.cumsum(m.astype(np.int64))[:-1]])
            rank = (-pi[open_]).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            lowest = -2 * one[open_]
            for size in range(2, k + 1):
                masked = np.where(rank < size, np.maximum(pi[open_], 1e-9), 0.0)
                masked /= masked.sum(axis=1, keepdims=True)
                got, loglik = _em(p, start, text, m, masked, steps)
                cost = -2 * loglik + (size - 1) * price[open_]
                better = cost < lowest
                chosen[open_[better]] = got[better]
                lowest = np.minimum(lowest, cost)
    out[which] = chosen
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, lang_pred, score (proportion of lang_pred) and languages (map of the chosen set)
    for each row of ``docs`` (doc_id, text); further columns of ``docs`` named in KEEP pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            for piece in chunks(pdf):
                pi = mixtures(piece["text"].tolist(), m)
                found = pi.sum(axis=1) > 0
                top = pi.argmax(axis=1) if m.languages else np.zeros(len(piece), np.int64)
                yield pd.DataFrame({
                    "doc_id": piece["doc_id"],
                    "lang_pred": [m.languages[i] if f else UNDETERMINED for i, f in zip(top, found, strict=True)],
                    "score": np.where(found, pi.max(axis=1, initial=0.0), 0.0).clip(0.0, 1.0),
                    "languages": [[(m.languages[j], float(row[j])) for j in np.flatnonzero(row > 0)] for row in pi],
                })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(tidy(predict), f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pd.DataFrame({"text": batch.column(batch.schema.get_field_index("text")).to_pandas()})
            told = [mixtures(piece["text"].tolist(), shared.value).sum(axis=1) > 0 for piece in chunks(texts)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *told])))

    return docs.mapInArrow(tidy(keep), docs.schema)
