"""N-gram Jaccard join with MinHash banding.

Every document becomes its set of word five-grams (64-bit hashes of whole
n-grams). Documents of equal sets are one class from then on, however many
copies there are. A class gets MinHash values in bands; the number of bands
and rows follow from the wanted recall at the threshold. Classes meet by a
shuffle on band hashes, and each pair that shares a band is verified on the
full n-gram sets, once: in the first band that it shares.

A bucket is verified inside one task, as products of small incidence matrices;
pairs never leave the task. What comes out is each class's number of links and
a spanning forest of the verified pairs, from which components follow. A
bucket beyond ``BLOCK`` members is dealt into blocks, and each pair of blocks
is a task's cell of its own, so that no member and no pair is left out. Buckets
with the same members as an earlier band's are dropped before anything is
read for them.

Edge cases: a text of one to four words is one n-gram of all its words; a
null, empty or blank text takes no part: its class is its own doc_id, with no
links. Repeated rows are copies. class_id is the smallest doc_id of the
component (null where all ids are null). Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import chunks, find_words, row_key, stored, tidy
from carelake.llm.components import components

NGRAM = 5
THRESHOLD = (4, 5)  # Jaccard similarity of 4/5 or more, in whole numbers
RECALL = 0.9995
MAX_HASHES = 160
BLOCK = 256

_PRIME = np.uint64(0xD1342543DE82EF95)


def banding(similarity: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows, so the fewest chance candidates, that reach the recall within max_hashes."""
    for rows in range(max_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("max_hashes is too small for this recall")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_sets(texts: list[str], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text): the distinct n-grams of each text, sorted by text and hash."""
    found = [find_words(t) for t in texts]
    count = np.array([len(w) for w in found], np.int64)
    codes, distinct = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    value = pd.util.hash_array(distinct.astype(object), categorize=False)[codes] if len(codes) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(texts)), count)
    if len(value) >= n:
        rolled = value.copy()
        for k in range(1, n):
            rolled = rolled[:-1] * _PRIME + value[k:]
        whole = text[: len(rolled)] == text[n - 1 :]
        hashes, owner = _mixed(rolled[whole]), text[: len(rolled)][whole]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        ends = np.cumsum(count)
        lone = []
        for i in short:
            h = np.uint64(count[i])
            for v in value[ends[i] - count[i] : ends[i]]:
                h = np.uint64((int(h) * int(_PRIME) + int(v)) & 0xFFFFFFFFFFFFFFFF)
            lone.append(h)
        hashes = np.concatenate([hashes, _mixed(np.array(lone, np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], owner[fresh]


def band_hashes(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each set; ``starts`` are the sets' first places in ``hashes``."""
    draw = np.random.default_rng(10).integers(0, 2**32, (2, bands * rows), dtype=np.uint64).astype(np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            permuted = (low ^ draw[0, r]) * (draw[1, r] | np.uint32(1))
            permuted ^= permuted >> np.uint32(16)
            permuted *= np.uint32(0x7FEB352D)
            key = key * _PRIME + np.minimum.reduceat(permuted, starts)
        out[:, b] = _mixed(key)
    return out


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, set_key, bands) for each row of ``docs``; set_key is null where there is no word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for piece in chunks(pdf):
                hashes, owner = ngram_sets(piece["text"].tolist())
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                keys: list[int | None] = [None] * len(piece)
                signs: list[np.ndarray | None] = [None] * len(piece)
                if len(starts):
                    made = band_hashes(hashes, starts, bands, rows).astype(np.int64)
                    ends = np.append(starts[1:], len(hashes))
                    for i, a, b, sign in zip(owner[starts].tolist(), starts, ends, made, strict=True):
                        keys[i] = int.from_bytes(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
                        signs[i] = sign
                yield pd.DataFrame({"doc_id": piece["doc_id"], "row": piece["row"], "set_key": pd.array(keys, "Int64"), "bands": signs})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows_ = docs.select("doc_id", "text", row_key("doc_id", "text").alias("row"))
    return rows_.mapInPandas(tidy(run), f"doc_id {kind}, row long, set_key long, bands array<long>")


def candidate_buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, buckets): every class's bands, and the buckets of two or more members, one for each member list."""
    entries = classes.select("set_key", F.posexplode("bands").alias("band", "bucket"))
    sized = entries.groupBy("bucket", "band").agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("set_key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_key")).alias("y")
    ).where("members > 1")
    first = sized.groupBy("members", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("first"))
    return entries, stored(first.select("first.bucket", "members"), "jaccard-buckets")


def _cell(sets: list[np.ndarray], signs: np.ndarray, block: np.ndarray, band: int, across: bool, threshold: tuple[int, int]) -> np.ndarray:
    """Matrix of the verified pairs of a cell that are this band's to verify."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = joined.argsort(kind="stable")
    joined, owner = joined[order], owner[order]
    same = joined[1:] == joined[:-1]
    shared = np.zeros(len(joined), bool)
    shared[1:] |= same
    shared[:-1] |= same
    joined, owner = joined[shared], owner[shared]
    common = np.zeros((m, m), np.float32)
    if len(joined):
        column = np.cumsum(np.concatenate([[False], joined[1:] != joined[:-1]]))
        width = max(1, 4_000_000 // m)
        for at in range(0, int(column[-1]) + 1, width):
            lo, hi = np.searchsorted(column, [at, at + width])
            held = np.zeros((m, width), np.float32)
            held[owner[lo:hi], column[lo:hi] - at] = 1
            common += held @ held.T
    both = common.astype(np.int64)
    union = size[:, None] + size[None, :] - both
    near = threshold[1] * both >= threshold[0] * union
    if across:
        near &= block[:, None] != block[None, :]
    np.fill_diagonal(near, False)
    if band and near.any():
        for k in range(band):
            near &= signs[:, k][:, None] != signs[:, k][None, :]
    return near


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each member to the first member of its component in the cell."""
    root = np.full(len(near), -1)
    out = []
    for i in range(len(near)):
        if root[i] < 0:
            root[i], front = i, [i]
            while front:
                for j in np.flatnonzero(near[front.pop()] & (root < 0)).tolist():
                    root[j] = i
                    front.append(j)
                    out.append((i, j))
    return out


def verify(cells: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(a, b, links): for links, class a and the documents linked to it in a cell; for edges, classes a and b."""

    def cell(pdf: pd.DataFrame) -> tuple[list[int], list[int | None], list[int]]:
        pdf = pdf.drop_duplicates("set_key")
        if len(pdf) < 2:
            return [], [], []
        sets = [np.frombuffer(x, np.uint64) for x in pdf["ngrams"]]
        one = pdf.iloc[0]
        near = _cell(sets, np.stack(pdf["bands"].tolist()), pdf["block"].to_numpy(), int(one["band"]), one["i"] != one["j"], threshold)
        if not near.any():
            return [], [], []
        keys, copies = pdf["set_key"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        links = near @ copies
        linked = np.flatnonzero(links)
        edges = _forest(near)
        return (
            keys[linked].tolist() + [int(keys[i]) for i, _ in edges],
            [None] * len(linked) + [int(keys[j]) for _, j in edges],
            links[linked].tolist() + [0] * len(edges),
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by cell; the last cell of a batch may go on in the next
        held: pd.DataFrame | None = None
        out: tuple[list, list, list] = ([], [], [])
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            key = pdf[["bucket", "i", "j"]].to_numpy(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                for side, got in zip(out, cell(pdf.iloc[a:b]), strict=True):
                    side.extend(got)
            held = pdf.iloc[starts[-1] :]
            if len(out[0]) > 10_000:
                yield pd.DataFrame({"a": out[0], "b": pd.array(out[1], "Int64"), "links": out[2]})
                out = ([], [], [])
        if held is not None:
            for side, got in zip(out, cell(held), strict=True):
                side.extend(got)
        yield pd.DataFrame({"a": pd.array(out[0], "Int64"), "b": pd.array(out[1], "Int64"), "links": pd.array(out[2], "Int64")})

    placed = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return placed.mapInPandas(tidy(run), "a long, b long, links long")


def jaccard_classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, row (key of doc_id and text), class_id, component (null where there is no word) and n_links for each row."""
    docs = docs.select("doc_id", "text")
    bands, rows = banding(threshold[0] / threshold[1], recall)
    signed = stored(signatures(docs, bands, rows), "jaccard-signatures")
    classes = stored(
        signed.where("set_key is not null").groupBy("set_key").agg(
            F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.first("bands").alias("bands")
        ),
        "jaccard-classes",
    )
    entries, buckets = candidate_buckets(classes)
    blocks = F.ceil(F.col("members") / block).cast("int")
    members = entries.join(buckets, "bucket").select("set_key", "bucket", "band", blocks.alias("blocks"), F.pmod(F.xxhash64("bucket", "set_key"), blocks).cast("int").alias("block"))
    members = stored(members, "jaccard-members")
    # full sets only for classes that share a bucket
    wanted = classes.join(members.select("set_key").distinct(), "set_key", "left_semi").select("set_key", "row", "copies", "bands")
    texts = docs.withColumn("row", row_key("doc_id", "text")).join(wanted, "row").dropDuplicates(["row"])

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for piece in chunks(pdf):
                hashes, owner = ngram_sets(piece["text"].tolist())
                ends = np.searchsorted(owner, np.arange(len(piece) + 1))
                sets = [hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield piece[["set_key", "copies", "bands"]].assign(ngrams=sets)

    sets = stored(texts.select("set_key", "copies", "bands", "text").mapInPandas(tidy(full), "set_key long, copies long, bands array<long>, ngrams binary"), "jaccard-sets")
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "set_key", "bucket", "band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    found = stored(verify(dealt.join(sets, "set_key"), threshold), "jaccard-links")
    labels = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("set_key")).agg(F.sum("links").alias("links"))
    named = classes.select("set_key", "copies", "first_id").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn(
        "label", F.coalesce("label", "set_key")
    )
    smallest = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    result = stored(
        named.join(smallest, "label").join(links, "set_key", "left").select(
            "set_key", "class_id", F.col("label").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "jaccard-result",
    )
    worded = signed.where("set_key is not null").select("doc_id", "row", "set_key").join(result, "set_key").select("doc_id", "row", "class_id", "component", "n_links")
    blank = signed.where("set_key is null").select("doc_id", "row", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(blank)


def representatives(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each class stays: that of the smallest
    doc_id. Equal rows are one document; documents without a word all stay."""
    found = jaccard_classes(docs, threshold, recall, block)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "row")).alias("first")
    chosen = found.where("component is not null").groupBy("component").agg(first).select("first.row")
    kept = stored(chosen.unionByName(found.where("component is null").select("row").distinct()), "jaccard-kept")
    rows = docs.select(row_key("doc_id", "text").alias("row"), F.struct(*docs.columns).alias("all"))
    return rows.join(kept, "row").dropDuplicates(["row"]).select("all.*")
