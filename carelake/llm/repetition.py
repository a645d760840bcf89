"""Quality rules by repetition coverage.

For several n, every window of n words gets a rolling 64-bit hash (numpy, a
whole batch of texts at once); windows seen twice or more in their text are
marked, and the characters of the words under marked windows are measured,
each once. Repeated lines are measured the same way.

Edge cases: a null or empty text has no words, all counts 0, ``base_failed``
true and ``kept`` false. A text shorter than n words has no window of n.
Repeated rows each get a row. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from carelake.llm.common import WORD, chunks, tidy

_word = re.compile(WORD)
_symbol = re.compile(r"[#*$%&|<>]").findall

#: Most of the word characters that may lie under repeated windows of n words, and in repeated lines: the limits
#: published for MassiveText (Rae et al. 2021, table A1). Longer windows repeat less by chance, so limits fall with n.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
BASE_WINDOW = 8

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, line_coverage double, " + ", ".join(f"coverage_{n} double" for n in LIMITS)
)


def covered_words(ids: np.ndarray, text: np.ndarray, n: int, rolled: np.ndarray) -> np.ndarray:
    """Which words lie in a window of n words that its text holds twice or more.

    ``rolled``: hash of the n words from each place on; windows over a text's end don't count."""
    marked = np.zeros(len(ids) + 1, np.int64)
    whole = np.flatnonzero(text[: len(ids) - n + 1] == text[n - 1 :]) if len(ids) >= n else np.zeros(0, np.int64)
    if len(whole):
        key = rolled[whole] ^ (text[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = key.argsort(kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(marked, whole[twice], 1)
        np.add.at(marked, whole[twice] + n, -1)
    return np.cumsum(marked)[:-1] > 0


def measure(texts: list[str]) -> pd.DataFrame:
    found = [_word.findall(t) for t in texts]
    count = np.array([len(w) for w in found], np.int64)
    words = [w for ws in found for w in ws]
    text = np.repeat(np.arange(len(texts)), count)
    chars = np.fromiter(map(len, words), np.int64, len(words))

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=values, minlength=len(texts)).astype(np.int64)

    out = {"n_words": count, "word_chars": per_text(chars)}
    out["n_symbols"] = [len(_symbol(t)) for t in texts]
    dup, dup_chars = [], []
    for t in texts:
        seen: set[str] = set()
        n = c = 0
        if "\n" in t:
            for line in t.split("\n"):
                if line in seen:
                    n += 1
                    c += sum(map(len, _word.findall(line)))
                elif _word.search(line):
                    seen.add(line)
        dup.append(n)
        dup_chars.append(c)
    out["n_dup_lines"] = dup
    base = np.maximum(out["word_chars"], 1)
    coverage = {"line_coverage": np.array(dup_chars) / base}
    kept = coverage["line_coverage"] <= LINE_LIMIT
    # distinct words get random-looking 64-bit values; polynomial hashes over them roll on by one word a step
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.uint64) if words else np.zeros(0, np.uint64)
    value = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    value ^= value >> np.uint64(31)
    rolled, repeat = value.copy(), np.zeros(len(texts), np.int64)
    for n in range(2, max(*LIMITS, BASE_WINDOW) + 1):
        rolled = rolled[:-1] * np.uint64(0xD1342543DE82EF95) + value[n - 1 :] if len(value) >= n else rolled[:0]
        if n in LIMITS or n == BASE_WINDOW:
            inside = covered_words(ids, text, n, rolled)
            if n == BASE_WINDOW:
                repeat = per_text(inside)
            if n in LIMITS:
                coverage[f"coverage_{n}"] = per_text(chars * inside) / base
                kept &= coverage[f"coverage_{n}"] <= LIMITS[n]
    failed = (count < 20) | (100 * repeat > 30 * count)
    return pd.DataFrame(out | {"n_repeat_words": repeat, "base_failed": failed, "kept": kept & ~failed} | coverage)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for piece in chunks(pdf):
                got = measure(piece["text"].tolist())
                got.insert(0, "doc_id", piece["doc_id"])
                yield got

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(tidy(run), f"doc_id {kind}, {SCHEMA}")
