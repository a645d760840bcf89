"""Packing by concatenate and cut.

Documents are tokenised where they are read and written to the shared folder
with their partition and their place in it. A first pass sums the ids of each
partition; running sums over those totals (one row for each partition) give
every document its offset in the one long run of ids. Fixed windows of that
run are the sequences: a second pass cuts each document at the window
boundaries and writes a boundary record for each piece. All sequences are full
but the last.

The ids are those of the tokenizer file. They come from the vocabulary's rank
file, which is several times faster, with the tokenizer file's added tokens:
where a text holds the string of one, its id stands for it, as the tokenizer
file has it. Tests hold the two against each other.

Edge cases: a null or empty text is the end id alone. Repeated rows are packed
once each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import chunks, stored, tidy

WINDOW = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k"

_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The encoder of a public vocabulary file; one for each worker process."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        _encoders[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _encoders[vocabulary]


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids with the end id, as little-endian 32-bit integers, its partition, and the ids before it there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = functools.partial(encoder(vocabulary).encode, allowed_special="all")
        part, before = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for piece in chunks(pdf):
                ids = [np.array([*encode(t), end_id], "<u4") for t in piece["text"]]
                n = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pd.DataFrame({"doc_id": piece["doc_id"], "part": part, "part_start": starts, "n": n, "ids": [x.tobytes() for x in ids]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(tidy(run), f"doc_id {kind}, part int, part_start long, n long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Boundary records: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    tokens = stored(tokenize(docs, vocabulary, end_id), "packing-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("part_offset"))
    # one row of two numbers for each input partition: far below any broadcast bound
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("place", F.col("part_offset") + F.col("part_start"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                yield pieces(pdf.iloc[at : at + 1000])

    def pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        place, n = pdf["place"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        first = place // window
        count = (place + n - 1) // window - first + 1
        row = np.repeat(np.arange(len(pdf)), count)
        sequence = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
        begin = np.maximum(sequence * window, place[row])
        end = np.minimum((sequence + 1) * window, (place + n)[row])
        ids = pdf["ids"].tolist()
        lo, hi = begin - place[row], end - place[row]
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy()[row], "start": lo, "length": hi - lo,
            "ids": [ids[r][4 * a : 4 * b] for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True)],
            "doc_tokens": n[row], "sequence_id": sequence, "offset": begin - sequence * window,
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.select("doc_id", "place", "n", "ids").mapInPandas(
        tidy(cut), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def digest(pieces: DataFrame) -> DataFrame:
    """Boundary records with the crc32 of the ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
