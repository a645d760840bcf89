"""Language-model scoring by cross-entropy difference.

Two models of the same kind, a target's and the background's, share one
vocabulary of real words. Both are bigram models, interpolated with a smoothed
unigram model:

    p(w | v) = L * c(v, w) / c(v) + (1 - L) * (c(w) + A) / (N + A * V)

V is the number of distinct words. A document's score is the mean over its
words of log p_target - log p_background: how much better the target's model
foretells it. The first word follows a start mark. A document that is itself
counted is scored by what the others hold: its own counts are taken out of
each model that has them, so that no document wins by being remembered.

Every word, history and pair is counted under a 62-bit hash of its own, so the
counts grow with the corpus. Documents are kept in chunks of word codes in the
shared folder. A chunk sends each of its distinct keys once, with its counts,
to the key's part, a range of hashes; the part sums them over all chunks and
sends the sums back to the chunks that asked, which then score their documents.
However frequent a key, a part gets it once from a chunk. The number of parts
grows with that of the chunks; the driver collects three totals.

Edge cases: a text without a word (null, empty, blank) has 0 words, null
losses and score 0. Without target rows the target's model is uniform.
Repeated rows count and score once each. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import find_words, stored, tidy

INTERPOLATION = 0.5
SMOOTHING = 0.1

#: Characters of a chunk; a longer text is a chunk of its own.
CHUNK = 4_000_000
#: Parts, as a power of two, and the chunks from which on there are more.
PART_BITS, PART_CHUNKS = 9, 2048

_START = np.uint64(0x5851F42D4C957F2D)
_MIX = np.uint64(0xD1342543DE82EF95)
_KIND = np.uint64(3)  # the lowest two bits of a key: 0 word, 1 history, 2 pair


def _kept(df: DataFrame, label: str) -> DataFrame:
    """``stored``, and the shuffle files go that only its writing needed."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return stored(df, label)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def digest(docs: DataFrame) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text, is_target), stored: distinct words' hashes, and codes of all words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            size = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(size.cumsum() // CHUNK)) + 1).tolist(), len(batch)]):
                piece = batch.slice(a, b - a)
                found = [find_words((t or "").lower()) for t in piece["text"].to_pylist()]
                length = np.array([len(w) for w in found], np.int32)
                target = np.array([bool(t) for t in piece["is_target"].to_pylist()])
                codes, words = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
                hashes = pd.util.hash_array(words.astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_pydict({
                    "chunk": [uuid.uuid4().hex], "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), piece["doc_id"]),
                    "lengths": [length.tobytes()], "targets": [target.tobytes()], "words": [hashes.tobytes()],
                    "codes": [_pack(codes)], "n_target": [int(length[target].sum())], "n_words": [int(length.sum())],
                })

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk string, doc_ids array<{kind}>, lengths binary, targets binary, words binary, codes binary, n_target long, n_words long"
    return _kept(docs.select("doc_id", "text", "is_target").mapInArrow(tidy(run), schema), "lm-chunks")


@dataclass
class Grams:
    """A chunk's distinct keys (words, then histories, then pairs) and, for each word of its texts, where its three keys are."""

    keys: np.ndarray
    order: np.ndarray  # sorts the keys
    text: np.ndarray
    word: np.ndarray
    history: np.ndarray
    pair: np.ndarray
    target: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Grams:
        hashes = np.concatenate([np.frombuffer(row["words"], np.uint64), [_START]])
        n = len(hashes) - 1
        lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        word = _unpack(row["codes"]).astype(np.int64)
        before = np.concatenate([[n], word[:-1]])[: len(word)]
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = n
        both, pair = np.unique(before * (n + 1) + word, return_inverse=True)
        first, second = hashes[both // (n + 1)], hashes[both % (n + 1)]
        kinds = hashes[:n], hashes * _MIX, first * _MIX + second
        keys = np.concatenate([k & ~_KIND | np.uint64(i) for i, k in enumerate(kinds)])
        text = np.repeat(np.arange(len(lengths)), lengths)
        return cls(keys, np.argsort(keys, kind="stable"), text, word, n + before, 2 * n + 1 + pair, np.frombuffer(row["targets"], bool)[text], lengths)

    def counts(self, weights: np.ndarray | None = None) -> np.ndarray:
        return sum(np.bincount(x, weights=weights, minlength=len(self.keys)) for x in (self.word, self.history, self.pair)).astype(np.uint64)


def _pack(numbers: np.ndarray) -> bytes:
    """First all numbers' first bytes, then all second ones: small numbers compress well so."""
    return zlib.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def entries(chunks: DataFrame, part_bits: int, counted: bool, asked: bool) -> DataFrame:
    """A row for each chunk and part: the chunk's keys there (as steps from one to the next), with the chunk's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = Grams.of(row)
                keys = grams.keys[grams.order]
                target, every = (grams.counts(w)[grams.order] if counted else np.zeros(len(keys), np.uint64) for w in (grams.target.astype(float), None))
                part = (keys >> np.uint64(64 - part_bits)).astype(np.int64)
                starts = np.flatnonzero(np.diff(part, prepend=-1))
                steps = np.diff(keys, prepend=np.uint64(0))
                steps[starts] = keys[starts]
                spans = list(pairwise([*starts.tolist(), len(keys)]))
                yield pa.RecordBatch.from_pydict({
                    "chunk": [row["chunk"]] * len(spans), "part": pa.array(part[starts], pa.int32()), "asked": [asked] * len(spans),
                    **{c: pa.array([_pack(x[a:b]) for a, b in spans], pa.binary()) for c, x in (("keys", steps), ("target", target), ("background", every))},
                })

    columns = ["chunk", "lengths", "targets", "words", "codes"]
    return chunks.select(columns).mapInArrow(tidy(run), "chunk string, part int, asked boolean, keys binary, target binary, background binary")


def summed(rows: DataFrame) -> DataFrame:
    """For each chunk that asked and each part: the counts of its keys in the whole corpus. Stored.

    A part's row without a chunk holds its number of distinct counted words."""

    def run(group: pa.Table) -> pa.Table:
        own = [np.cumsum(_unpack(k), dtype=np.uint64) for k in group["keys"].to_pylist()]
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([_unpack(x) for x in group[c].to_pylist()])) for c in ("target", "background")]
        chunk, asked = group["chunk"].to_pylist(), group["asked"].to_pylist()
        spans = [s for s, wanted in zip(pairwise(np.cumsum([0, *map(len, own)]).tolist()), asked, strict=True) if wanted]
        given = [[_pack(x[at[a:b]]) for a, b in spans] for x in sums]
        words = int(((keys & _KIND == 0) & (sums[1] > 0)).sum())
        return pa.table({
            "chunk": pa.array([*(c for c, wanted in zip(chunk, asked, strict=True) if wanted), None], pa.string()),
            "part": pa.array([group["part"][0].as_py()] * (len(spans) + 1), pa.int32()),
            "target": pa.array([*given[0], None], pa.binary()), "background": pa.array([*given[1], None], pa.binary()),
            "distinct": pa.array([0] * len(spans) + [words], pa.int64()),
        })

    return _kept(rows.groupBy("part").applyInArrow(run, "chunk string, part int, target binary, background binary, distinct long"), "lm-sums")


def own_counts(text: np.ndarray, key: np.ndarray, n_keys: int) -> np.ndarray:
    """For each word, how often its text has its key."""
    both = text * n_keys + key
    order = both.argsort(kind="stable")
    sorted_ = both[order]
    starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
    times = np.diff(starts, append=len(both))
    out = np.empty(len(both), np.int64)
    out[order] = np.repeat(times, times)
    return out


def log_p(grams: Grams, counts: np.ndarray, total: int, vocabulary: int, own: tuple[np.ndarray, ...] | None = None, counted: np.ndarray | bool = True) -> np.ndarray:
    """Log probability of each word. ``own``: counts of the word's text for its word, history and pair, and its
    words; they are taken out where the text is ``counted`` in this model."""
    word, seen, pair, total = counts[grams.word], counts[grams.history], counts[grams.pair], np.float64(total)
    if own is not None:
        word, seen, pair, total = (x - np.where(counted, o, 0) for x, o in zip((word, seen, pair, total), own, strict=True))
    unigram = (word + SMOOTHING) / (total + SMOOTHING * vocabulary)
    bigram = np.divide(pair, seen, out=np.zeros(len(seen)), where=seen > 0)
    # a history that was never seen leaves the whole weight to the unigram model
    share = np.where(seen > 0, INTERPOLATION, 0.0)
    return np.log(share * bigram + (1 - share) * unigram)


def _scored(asked: DataFrame, counted: DataFrame) -> DataFrame:
    """Scores of the documents of ``asked`` under the counts of ``counted``, both chunks."""
    sizes = [x.agg(F.count(F.lit(1)), F.sum("n_target"), F.sum("n_words")).first() for x in ([counted] if asked is counted else [counted, asked])]
    part_bits = PART_BITS + max(0, math.ceil(math.log2(max(1, sum(s[0] for s in sizes)) / PART_CHUNKS)))
    totals = [n or 0 for n in sizes[0][1:]]
    if asked is counted:
        rows = entries(counted, part_bits, True, True)
    else:
        rows = entries(counted, part_bits, True, False).unionAll(entries(asked, part_bits, False, True))
    sums = summed(rows)
    vocabulary = max(1, sums.agg(F.sum("distinct")).first()[0] or 0)
    left_out = asked is counted
    kind = asked.schema["doc_ids"].dataType.elementType.simpleString()

    def run(chunk: pa.Table, given: pa.Table) -> pa.Table:
        row = chunk.drop_columns(["doc_ids"]).to_pylist()[0]
        grams, given = Grams.of(row), given.sort_by("part")
        n, loss = grams.lengths, []
        own = tuple(own_counts(grams.text, k, len(grams.keys)) for k in (grams.word, grams.history, grams.pair)) + (n[grams.text],) if left_out else None
        for c, total, counted in zip(("target", "background"), totals, (grams.target, True), strict=True):
            counts = np.zeros(len(grams.keys))
            counts[grams.order] = np.concatenate([np.zeros(0, np.uint64), *map(_unpack, given[c].to_pylist())])
            loss.append(-np.bincount(grams.text, weights=log_p(grams, counts, total, vocabulary, own, counted), minlength=len(n)) / np.maximum(n, 1))
        none = n == 0
        return pa.table({
            "doc_id": chunk["doc_ids"].combine_chunks().flatten(), "n_words": n, "target_loss": pa.array(loss[0], mask=none),
            "background_loss": pa.array(loss[1], mask=none), "score": loss[1] - loss[0],
        })

    pairs = asked.groupBy("chunk").cogroup(sums.where("chunk IS NOT NULL").select("chunk", "part", "target", "background").groupBy("chunk"))
    return pairs.applyInArrow(run, f"doc_id {kind}, n_words long, target_loss double, background_loss double, score double")


def count(docs: DataFrame) -> DataFrame:
    """What ``score`` needs of the documents that are counted, ``docs`` (text, is_target); the background is every one."""
    return digest(docs.select(F.lit(None).cast("long").alias("doc_id"), "text", "is_target"))


def score(docs: DataFrame, models: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (nats a word) and score, for each row of ``docs`` (doc_id, text)."""
    return _scored(digest(docs.select("doc_id", "text", F.lit(False).alias("is_target"))), models)


def score_counted(docs: DataFrame) -> DataFrame:
    """As ``score``, for documents (doc_id, text, is_target) that are themselves the ones counted: read once, each left out of its own models."""
    chunks = digest(docs)
    return _scored(chunks, chunks)
