"""Exact top-k search by a bit-sliced index.

Components are quantised to integers. For every block of rows and every
component the index holds slices: the bitmap of slice b has a row's bit b of
its component above the block's smallest. A query's scores are sums of slices
at powers of two: a set bit c of the query's component adds the component's
slice b at weight b + c; a negative component adds the complements. Full
adders on whole bitmaps (three of a weight become one of it and one of the
next) leave one bitmap for each bit of the score. From the most significant
slice downward, rows with the bit set are taken as long as they are no more
than wanted; the rows left at the end are equal at the boundary, and the
smallest ids of them fill the rest.

Numbers are as wide as the data need: slices of any number add up exactly.
Blocks give their k best for each query, which a window merges.

Edge cases: rows without an id, and vectors null or holding null or non-finite
components, take no part; zero and empty vectors do. Vectors meet those of
their own size only. Equal rows count once; an id with several vectors is
asked once for each. A query never finds its own id. Ties go to the smaller
id. With fewer candidates than k, all are returned. A score beyond a long's
range is ordered by its true value within a block and reported at the range's
end. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.blocks import LONG, cells, dealt, pieces, quantised
from carelake.llm.common import release, stored

SCALE = 64
EVERY = 20
K = 20
#: Rows of a block, a multiple of 64, and queries of a group.
BLOCK = 32_768
GROUP = 512

INDEX = "size int, block int, dim int, low long, slices array<binary>"
FOUND = "query_id long, query_key long, vec_id long, score long"


def _bitmaps(flags: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 to rows of 64-bit words, the first row in the lowest bit."""
    padded = np.zeros((flags.shape[0], -(-flags.shape[1] // 64) * 64), np.uint8)
    padded[:, : flags.shape[1]] = flags
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """A column of arrays of ``size`` longs as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), size).astype(np.int64, copy=False)


def build_index(rows: DataFrame, n_blocks: int, block: str = "block") -> DataFrame:
    """The slices of ``rows`` (vec_id, size, q): one row for each block and component, and one (dim -1) of the block's ids in order."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        size, number = key[0].as_py(), key[1].as_py()
        ids = table["vec_id"].to_numpy()
        order = ids.argsort(kind="stable")
        q = matrix(table["q"], size)[order]
        out = [(size, number, -1, 0, [ids[order].astype("<i8").tobytes()])]
        for d in range(size):
            low = int(q[:, d].min())
            above = q[:, d].view(np.uint64) - np.uint64(low % 2**64)  # modulo 2^64 this is the true difference
            width = int(above.max()).bit_length()
            bits = np.stack([(above >> np.uint64(b)) & np.uint64(1) for b in range(width)]) if width else np.zeros((0, len(ids)), np.uint64)
            out.append((size, number, d, low, [b.tobytes() for b in _bitmaps(bits)]))
        release()
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["size", "block", "dim", "low", "slices"])

    return rows.withColumn("block", dealt(block, n_blocks, "vec_id", "q")).groupBy("size", "block").applyInArrow(build, INDEX)


def add(planes: np.ndarray, levels: list[list[int]]) -> list[np.ndarray]:
    """The sum of bitmaps, as bitmaps from the lowest weight. ``levels[w]``: numbers of the planes to add at weight 2^w."""
    words = planes.shape[1]
    total: list[np.ndarray] = []
    carried = np.zeros((0, words), np.uint64)
    while len(total) < len(levels) or len(carried):
        own = levels[len(total)] if len(total) < len(levels) else []
        level = np.concatenate([planes[own], carried])
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * n :]])
        if len(level) == 2:
            carries.append(level[:1] & level[1:])
            level = level[:1] ^ level[1:]
        total.append(level[0] if len(level) else np.zeros(words, np.uint64))
        carried = np.concatenate(carries) if carries else np.zeros((0, words), np.uint64)
    return total


def select(total: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest sums of the rows ``among`` (all, if fewer); of rows equal at the boundary, the first."""
    sure, tied = np.zeros_like(among), among
    for bitmap in reversed(total):
        high = tied & bitmap
        n = _count(sure) + _count(high)
        if n > k:
            tied = high
        else:
            sure, tied = sure | high, tied & ~bitmap
            if n == k:
                return _places(sure)
    fixed = _places(sure)
    return np.concatenate([fixed, _places(tied)[: k - len(fixed)]])


def values(total: list[np.ndarray], places: np.ndarray) -> list[int]:
    """The sums of the rows at ``places``, read back from the bitmaps."""
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    kind = np.int64 if len(total) < 63 else object
    out = np.zeros(len(places), kind)
    for w, bitmap in enumerate(total):
        out += ((bitmap[word] >> bit) & np.uint64(1)).astype(kind) * (1 << w)
    return out.tolist()


class Block:
    """A block's slices and their complements, ready to be added."""

    def __init__(self, index: pa.Table, size: int) -> None:
        rows = sorted(index.select(["dim", "low", "slices"]).to_pylist(), key=lambda r: r["dim"])
        self.ids = np.frombuffer(rows[0]["slices"][0], "<i8")
        words = -(-len(self.ids) // 64)
        self.low = [r["low"] for r in rows[1:]]
        self.width = [len(r["slices"]) for r in rows[1:]]
        self.first = np.concatenate([[0], np.cumsum(self.width)]).tolist()
        straight = np.frombuffer(b"".join(s for r in rows[1:] for s in r["slices"]), np.uint64).reshape(-1, words)
        self.planes = np.concatenate([straight, ~straight])
        self.all = _bitmaps(np.ones((1, len(self.ids)), np.uint8))[0]

    def top(self, query: list[int], own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best for ``query``, rows of the id ``own`` left out."""
        levels: list[list[int]] = []
        base = 0
        for a, low, width, first in zip(query, self.low, self.width, self.first, strict=False):
            base += a * low
            if a < 0:  # a * u = -a * (m - u) + a * m, where m has all bits set
                base += a * ((1 << width) - 1)
                first += self.first[-1]
                a = -a
            while a and width:
                c = (a & -a).bit_length() - 1
                a &= a - 1
                levels.extend([] for _ in range(c + width - len(levels)))
                for b in range(width):
                    levels[b + c].append(first + b)
        total = add(self.planes, levels)
        among = self.all
        lo, hi = np.searchsorted(self.ids, [own, own], side="left")[0], np.searchsorted(self.ids, own, side="right")
        if hi > lo:
            flags = np.zeros((1, len(self.ids)), np.uint8)
            flags[0, lo:hi] = 1
            among = among & ~_bitmaps(flags)[0]
        places = select(total, among, k)
        return self.ids[places], [base + v for v in values(total, places)]


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products for each of ``queries`` among ``rows`` (both vec_id, size, q)."""
    n_blocks, n_groups = pieces(rows.count(), block), pieces(queries.count(), group)
    index = stored(build_index(rows, n_blocks), "slices-index")
    asked = queries.select("vec_id", "size", "q", F.xxhash64("q").alias("query_key")).withColumn("grp", dealt("grp", n_groups, "vec_id", "q"))

    def search(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if index.num_rows and asked.num_rows:
            size = key[0].as_py()
            held = Block(index, size)
            q = matrix(asked["q"], size).tolist()
            for query_id, query_key, vector in zip(asked["vec_id"].to_pylist(), asked["query_key"].to_pylist(), q, strict=True):
                ids, scores = held.top(vector, query_id, k)
                columns[0] += [query_id] * len(ids)
                columns[1] += [query_key] * len(ids)
                columns[2] += ids.tolist()
                columns[3] += [min(max(s, LONG[0]), LONG[1]) for s in scores]
            release()
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_key", "vec_id", "score"])

    found = cells(index, asked, n_blocks, n_groups, search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_search(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """``top_k`` for the rows of ``vectors`` (vec_id, embedding) whose vec_id is divisible by ``every``, among all rows."""
    rows = stored(quantised(vectors, scale), "slices-rows")
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)


ORACLE = f"""
WITH r AS (SELECT DISTINCT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.q AS query, b.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
  FROM r a JOIN r b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= {K}
"""
