"""Line deduplication with overlapping three-line windows.

Line breaks make lines. A long line is cut further where its words say so:
after a word at which a hash of it and the next word is the least among two
neighbours on either side. Such cuts fall alike wherever a passage stands; a
line's first and last words are never cut off, so that a part has at least
three words, and five on average. Every three consecutive lines make a window
(a text with fewer lines is one window). Windows are hashed and counted over
all documents. A window's first occurrence, by doc_id and place, stays; the
lines under any later occurrence are covered, overlapping and adjacent windows
merging into spans, and a span of at least ``LEAST_WORDS`` words is removed.
Shorter ones stay: phrases recur by chance. A passage of 51 words in running
text holds at least three whole lines and, nearly always, 25 words under them.

Skew: windows are counted with map-side partial sums, so a window shared by
millions of documents is a few rows for each task. Windows then meet only the
repeated ones in a plain equi-join of two tables, which adaptive execution
splits where a window is hot.

Edge cases: null and empty texts have no window and stay as they are. White
space between words doesn't count. Documents of equal doc_id, or without one
(they come last), are in the order of a hash of their texts; rows that are
equal in both are one document, and all keep or lose the same lines. doc_id is
an integer. Other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import row_key, stored, tidy

LINES = 3
#: Words on either side among which a cut is the least.
NEAR = 2
#: Least words of a removed span.
LEAST_WORDS = 20
LAST_ID = 2**63 - 1
#: Bytes of texts handled together, plus one text at most: numpy's arrays take some 40 times as many.
CHUNK = 1_000_000

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
#: An odd number of 60 bits.
SPREAD = 0x9E3779B97F4A7C1
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weight(place: np.ndarray) -> np.ndarray:
    """Weight of the byte at each place of a word."""
    n = place % 65_521 + 1
    return (n * n * 40_503 + n * 2_654_435_761) % 2_147_483_647


def word_numbers(words: pa.BinaryArray) -> np.ndarray:
    """60 bits for each word, by which lines are cut: the weighted sum of its bytes, spread by a multiplication."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    content = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.int64)
    starts = ends[:-1] - ends[0]
    size = np.diff(ends)
    place = np.arange(len(content)) - np.repeat(starts, size)
    return (np.add.reduceat(content * weight(np.arange(size.max()))[place], starts).view(np.uint64) * np.uint64(SPREAD)) & np.uint64(2**60 - 1)


class Lines:
    """The lines of some texts (UTF-8): for each line its text's number, first byte in it, words and hash."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = np.frombuffer(b"\n".join(texts), np.uint8)
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        part = np.zeros(len(joined) + 2, np.int8)
        part[1:-1] = _WORD[joined]
        edge = np.flatnonzero(np.diff(part))
        starts, ends = edge[::2], edge[1::2]
        broken = np.searchsorted(np.flatnonzero(joined == 10), starts)  # line breaks before each word
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined[part[1:-1] > 0])]).dictionary_encode()
        ids = words.indices.to_numpy()
        opens = np.ones(len(starts), bool)
        if len(ids):
            opens[1:] = broken[1:] != broken[:-1]
            opens[1:] |= self._cuts(word_numbers(words.dictionary)[ids], broken)[:-1]
        at = np.flatnonzero(opens)
        self.words = np.diff(at, append=len(starts))
        self.text = np.searchsorted(first, starts[at], side="right") - 1
        self.start = starts[at] - first[self.text]
        place = np.arange(len(starts)) - np.repeat(at, self.words)
        power = np.cumprod(np.full(int(self.words.max(initial=0)) + 1, _ODD[0], np.uint64))
        known = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False)
        self.hash = _mix(np.add.reduceat(known[ids] * power[place], at)) if len(at) else np.zeros(0, np.uint64)
        self.count = np.bincount(self.text, minlength=len(texts))

    @staticmethod
    def _cuts(number: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Whether a line ends after each word though no line break follows."""
        cut, last = np.zeros(len(number), bool), len(number) - NEAR - 1
        if last > NEAR:
            pair = number.copy()
            pair[:-1] ^= number[1:] << np.uint64(1)
            own = pair[NEAR:last]
            least = line[: last - NEAR] == line[2 * NEAR + 1 :]
            for k in range(1, NEAR + 1):
                least &= (own < pair[NEAR - k : last - k]) & (own <= pair[NEAR + k : last + k])
            cut[NEAR:last] = least
        return cut

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows of all texts in order, windows of each text)."""
        n = self.count
        parts = [self.hash * np.uint64(odd) for odd in _ODD]
        total = parts[0].copy()
        for k in range(1, LINES):  # a short text's last lines are followed by nothing
            follows = np.flatnonzero(self.text[k:] == self.text[:-k])
            total[follows] += parts[k][follows + k]
        short = n[self.text] < LINES
        place = np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)
        kept = place <= np.maximum(n[self.text] - LINES, 0)
        return _mix(total + short.astype(np.uint64))[kept].view(np.int64), np.where(n > 0, np.maximum(n - LINES + 1, 1), 0)


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with about ``CHUNK`` bytes of ``column`` each, and its texts; null is empty."""
    for batch in batches:
        begin = size = 0
        sizes = pc.binary_length(batch[column]).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            size += n
            if size >= CHUNK or i == len(sizes) - 1:
                piece = batch.slice(begin, i + 1 - begin)
                yield piece, [t or b"" for t in piece[column].cast(pa.binary()).to_pylist()]
                begin, size = i + 1, 0


def windows(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text) that has a word: place_id, key, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _pieces(batches, "text"):
            found, n = Lines(texts).windows()
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch["place_id"], batch["key"], listed], names=["place_id", "key", "windows"]).filter(pa.array(n > 0))

    keyed = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("place_id"), row_key("doc_id", "text").alias("key"), "text")
    return keyed.mapInArrow(tidy(run), "place_id long, key long, windows array<long>")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(key, hits) for documents with a repeated window; a hit holds the window's position and, where the
    document is the window's first place, its hash: within a document the first position stays."""
    # a running number stands for the document while its windows travel: it packs better than the key
    lined = stored(windows(docs).withColumn("doc", F.monotonically_increasing_id()), "lines-windows")
    each = lined.select("place_id", F.explode("windows").alias("window"))
    firsts = each.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("place_id").alias("first_id")).where("n > 1").drop("n")
    placed = lined.select("doc", F.posexplode("windows").alias("position", "window"))
    met = placed.join(stored(firsts, "lines-repeated").hint("merge"), "window").join(lined.select("doc", "key", "place_id").hint("merge"), "doc")
    met = stored(met.select("key", "position", "window", (F.col("place_id") == F.col("first_id")).alias("mine")), "lines-met")
    # of several documents with the first id, the one with the least key
    owners = met.where("mine").groupBy("window").agg(F.min("key").alias("owner"))
    own = F.when(F.col("mine") & (F.col("key") == F.col("owner")), F.col("window"))
    return met.join(owners.hint("merge"), "window").groupBy("key").agg(F.collect_set(F.struct("position", own.alias("own"))).alias("hits"))


def covered_lines(count: np.ndarray, words: np.ndarray, text: np.ndarray, position: np.ndarray, own: np.ndarray, owned: np.ndarray) -> np.ndarray:
    """Which lines lie under later occurrences of windows, in spans of ``LEAST_WORDS`` words and more.

    ``count``: lines of each text; ``words``: words of each line. A hit is a window's ``position`` in a ``text``,
    and whether the text is the window's first place (``owned``, the window's hash in ``own``)."""
    first = np.cumsum(count) - count
    order = np.lexsort((position, own, text, ~owned))
    mine = order[: int(owned.sum())]
    keeps = np.zeros(len(text), bool)
    fresh = np.ones(len(mine), bool)
    fresh[1:] = (text[mine][1:] != text[mine][:-1]) | (own[mine][1:] != own[mine][:-1])
    keeps[mine[fresh]] = True
    text, position = text[~keeps], position[~keeps]
    edges = np.zeros(int(count.sum()) + 1, np.int64)
    np.add.at(edges, first[text] + position, 1)
    np.add.at(edges, first[text] + np.minimum(position + LINES, count[text]), -1)
    under = np.cumsum(edges[:-1]) > 0
    # a span ends with its text
    opens = under.copy()
    opens[1:] &= ~under[:-1]
    starts = first[count > 0]
    opens[starts] = under[starts]
    span = np.cumsum(opens)
    return under & (np.bincount(span[under], weights=words[under], minlength=int(opens.sum()) + 1)[span] >= LEAST_WORDS)


def without_lines(text: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The text less the lines ``gone``. ``starts``: the first byte of each line; the white space after a line is its own."""
    ends = np.append(starts[1:], len(text))
    kept = [text[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)]
    return b"".join([text[: starts[0]], *kept])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the text less its repeated lines, and lines_removed (int), which takes the
    place of a column of that name."""
    columns = [c for c in docs.columns if c != "lines_removed"]
    hits = repeated_lines(docs.select("doc_id", "text"))
    # by number, so that the documents' names meet none of ours
    named = [f"c{i}" for i in range(len(columns))]
    own = docs.select(row_key("doc_id", "text").alias("key"), *[F.col(c).alias(n) for c, n in zip(columns, named, strict=True)])
    both = own.join(hits, "key", "left").select(*named, "hits")
    at = columns.index("text")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            touched = batch["hits"].is_valid()
            texts, removed = [], []
            for part, given in _pieces([batch.filter(touched)], named[at]):
                lines, hits = Lines(given), part["hits"]
                position, own = hits.flatten().flatten()
                owner = np.repeat(np.arange(len(given)), hits.value_lengths().to_numpy())
                gone = covered_lines(lines.count, lines.words, owner, position.to_numpy(), own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False))
                ends = np.cumsum(lines.count)
                for text, a, b in zip(given, (ends - lines.count).tolist(), ends.tolist(), strict=True):
                    n = int(gone[a:b].sum())
                    texts.append((without_lines(text, lines.start[a:b], gone[a:b]) if n else text).decode())
                    removed.append(n)
            cells = list(batch.columns[:-1])
            cells[at] = pc.replace_with_mask(cells[at], touched, pa.array(texts, cells[at].type))
            counts = pc.replace_with_mask(pa.array(np.zeros(len(batch), np.int32)), touched, pa.array(removed, pa.int32()))
            yield pa.RecordBatch.from_arrays([*cells, counts], [*named, "lines_removed"])

    schema = T.StructType([*both.drop("hits").schema.fields, T.StructField("lines_removed", T.IntegerType())])
    return both.mapInArrow(tidy(rebuild), schema).toDF(*columns, "lines_removed")
