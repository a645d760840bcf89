"""Hard negatives by Kronecker-packed products.

Components are quantised to integers. For every block of rows and every
component, the rows' values, biased by the block's smallest so that none is
negative, are written side by side into equal fields of one wide integer. An
anchor, biased alike, multiplies each component's wide integer once; the sum
of the products holds all rows' biased inner products in its fields, from
which the exact scores follow. A field has room for the block's widest value
times the largest sum that any anchor's biased components reach, so that no
field runs into the next.

Two passes over the cells of blocks and groups of anchors: the first gives an
anchor's best rows of its own label (a block is in the order of its labels, so
only that label's fields are multiplied), merged to its positives; the second
gives, for each positive, a block's best rows of other labels with scores in
the positive's range, merged to its negatives.

Edge cases: rows without an id or label, and vectors null or holding null or
non-finite components, take no part. Vectors meet those of their own size
only. Equal rows count once; an id with several vectors or labels is an anchor
once for each, and never meets rows of its own id. Ties go to the smaller id.
An anchor without another row of its label, and a positive without a row in
its range (any negative score), give no rows. Scores beyond a long's range are
held at its ends. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.bit_slices import matrix
from carelake.llm.blocks import LONG, cells, dealt, pieces, quantised
from carelake.llm.common import release, stored

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this share (numerator, denominator) of the positive's, and at most the positive's.
LEAST = (80, 100)
BLOCK = 16_384
GROUP = 256

PACKED = "size int, block int, dim int, low long, width int, content binary"


def relabelled(vec_id: Column, label: Column) -> Column:
    """The label that counts: rows whose id is divisible by 7 are given the next of ten labels."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def pack(values: np.ndarray, width: int) -> bytes:
    """Non-negative integers as little-endian fields of ``width`` bytes: the bytes of one wide integer."""
    fields = np.zeros((len(values), width), np.uint8)
    used = min(width, 8)
    fields[:, :used] = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :used]
    return fields.tobytes()


def unpack(wide: int, n: int, width: int) -> np.ndarray:
    """The ``n`` fields of a wide integer: as longs where they fit, else as Python's integers."""
    content = wide.to_bytes(n * width, "little")
    if width <= 7:
        fields = np.zeros((n, 8), np.uint8)
        fields[:, :width] = np.frombuffer(content, np.uint8).reshape(n, width)
        return fields.view("<i8").ravel()
    return np.array([int.from_bytes(content[at : at + width], "little") for at in range(0, n * width, width)], object)


def pack_blocks(rows: DataFrame, n_blocks: int, reach: int) -> DataFrame:
    """``rows`` (vec_id, label, size, q) as wide integers: a row for each block and component, and three for its
    ids (dim -3), labels (-2) and sums of components (-1), all in the order of label and id.

    ``reach``: the largest sum of an anchor's biased components."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        size, number = key[0].as_py(), key[1].as_py()
        ids, labels, q = table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(table["q"], size)
        order = np.lexsort((ids, labels))
        ids, labels, q = ids[order], labels[order], q[order]
        low = int(q.min(initial=0))
        above = q.view(np.uint64) - np.uint64(low % 2**64)  # modulo 2^64 this is the true difference
        widest = int(above.max(initial=0))
        width = max(1, -(-(widest * reach).bit_length() // 8))
        largest = max(abs(int(q.min(initial=0))), abs(int(q.max(initial=0))))
        sums = q.sum(axis=1) if largest * size < 2**62 else q.astype(object).sum(axis=1)
        heads = [ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), ",".join(map(str, sums)).encode()]
        content = heads + [pack(above[:, d], width) for d in range(size)]
        n = len(content)
        return pa.table({
            "size": pa.array([size] * n, pa.int32()), "block": pa.array([number] * n, pa.int32()), "dim": pa.array(range(-3, size), pa.int32()),
            "low": pa.array([low] * n, pa.int64()), "width": pa.array([width] * n, pa.int32()), "content": pa.array(content, pa.binary()),
        })

    return rows.withColumn("block", dealt("block", n_blocks, "vec_id", "label", "q")).groupBy("size", "block").applyInArrow(build, PACKED)


class Packed:
    """A block's wide integers, whole and by label."""

    def __init__(self, table: pa.Table) -> None:
        rows = sorted(table.select(["dim", "low", "width", "content"]).to_pylist(), key=lambda r: r["dim"])
        self.low, self.width = rows[0]["low"], rows[0]["width"]
        self.ids, self.labels = (np.frombuffer(r["content"], "<i8") for r in rows[:2])
        sums = [int(x) for x in rows[2]["content"].split(b",")]
        self.sums = np.array(sums, np.int64 if max(map(abs, sums)) < 2**62 else object)
        self.content = [r["content"] for r in rows[3:]]
        self._wide: dict[tuple[int, int], list[int]] = {}

    def wide(self, a: int, b: int) -> list[int]:
        """For each component the wide integer of the rows from ``a`` to ``b``."""
        if (a, b) not in self._wide:
            self._wide[a, b] = [int.from_bytes(c[a * self.width : b * self.width], "little") for c in self.content]
        return self._wide[a, b]

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist()) if label < LONG[1] else (int(np.searchsorted(self.labels, label)), len(self.labels))

    def scores(self, anchor: list[int], a: int, b: int) -> np.ndarray:
        """Inner products of the anchor with the rows from ``a`` to ``b``: longs, held at a long's ends."""
        base = min(anchor, default=0)
        total = 0
        for x, wide in zip(anchor, self.wide(a, b), strict=True):
            if x != base:
                total += wide * (x - base)
        fields, sums = unpack(total, b - a, self.width), self.sums[a:b]
        biased = sum(anchor) - len(anchor) * base
        # sum (x - base)(y - low) + low * sum (x - base) + base * sum y
        most = max(map(abs, (biased * self.low, base))) * max(1, int(max(abs(sums.min()), abs(sums.max())))) if b > a else 0
        if most < 2**60 and fields.dtype != object and sums.dtype != object:
            return fields + biased * self.low + base * sums
        return np.array([min(max(int(f) + biased * self.low + base * int(s), LONG[0]), LONG[1]) for f, s in zip(fields, sums, strict=True)], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (all, if fewer), best first, ties to the smaller id."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], ~scores[places]))][:k]


def _cell(run, names: list[str]):
    """``run(packed block, row of an anchor)`` yields rows of longs; here over a cell."""

    def cell(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if index.num_rows and asked.num_rows:
            held = Packed(index)
            for anchor in asked.to_pylist():
                rows += run(held, anchor)
            release()
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

    return cell


def _own_label(held: Packed, anchor: dict) -> list[tuple]:
    a, b = held.of_label(anchor["label"])
    if a == b:
        return []
    scores, ids = held.scores(anchor["q"], a, b), held.ids[a:b]
    others = ids != anchor["vec_id"]
    scores, ids = scores[others], ids[others]
    return [(anchor["vec_id"], anchor["anchor_key"], int(ids[i]), int(scores[i])) for i in best(scores, ids, POSITIVES)]


def _other_labels(held: Packed, anchor: dict) -> list[tuple]:
    scores = held.scores(anchor["q"], 0, len(held.ids))
    positives = [(p["positive_id"], p["score"], -(-LEAST[0] * p["score"] // LEAST[1])) for p in anchor["positives"]]
    lowest, highest = min(p[2] for p in positives), max(p[1] for p in positives)
    near = np.flatnonzero((scores >= lowest) & (scores <= highest) & (held.labels != anchor["label"]) & (held.ids != anchor["vec_id"]))
    out = []
    for positive_id, score, least in positives:
        fit = near[(scores[near] >= least) & (scores[near] <= score)]
        out += [(anchor["vec_id"], anchor["anchor_key"], positive_id, score, int(held.ids[fit[i]]), int(scores[fit[i]])) for i in best(scores[fit], held.ids[fit], NEGATIVES)]
    return out


def hard_negatives(vectors: DataFrame, every: int = EVERY, scale: int = SCALE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows of ``vectors``
    (vec_id, label, embedding) whose vec_id is divisible by ``every``."""
    labelled = quantised(vectors.where("label is not null").select("vec_id", F.col("label").cast("long").alias("label"), "embedding"), scale, "label")
    rows = stored(labelled.withColumn("label", relabelled(F.col("vec_id"), F.col("label"))).distinct(), "negatives-rows")
    anchors = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "size", "q", F.xxhash64("label", "q").alias("anchor_key"))
    # the sum of an anchor's biased components, in doubles: rounded up below
    spread = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double")) - F.col("size") * F.array_min("q").cast("double")
    n_anchors, reach = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(spread), F.lit(0.0))).first()
    n_blocks, n_groups = pieces(rows.count(), block), pieces(n_anchors, group)
    index = stored(pack_blocks(rows, n_blocks, int(reach * (1 + 1e-9)) + 1), "negatives-packed")
    asked = anchors.withColumn("grp", dealt("grp", n_groups, "vec_id", "anchor_key"))
    own = ["vec_id", "anchor_key"]

    names = [*own, "positive_id", "score"]
    near = cells(index, asked, n_blocks, n_groups, _cell(_own_label, names), ", ".join(f"{n} long" for n in names))
    turn = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("score"), "positive_id"))
    positives = near.withColumn("turn", turn).where(F.col("turn") <= POSITIVES).groupBy(*own).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    # anchors are a hundredth of the rows and grow with them: a shuffle join
    paired = stored(asked.join(positives.hint("merge"), own), "negatives-positives")

    names = [*own, "positive_id", "positive_score", "negative_id", "negative_score"]
    found = cells(index, paired, n_blocks, n_groups, _cell(_other_labels, names), ", ".join(f"{n} long" for n in names))
    rank = F.row_number().over(Window.partitionBy(*own, "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


ORACLE = f"""
WITH l AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT DISTINCT * FROM l),
s AS (SELECT a.vec_id AS anchor_id, a.label, a.q, b.vec_id, b.label AS other,
    CAST(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
  FROM r a JOIN r b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, label, q ORDER BY score DESC, vec_id) AS turn FROM s WHERE other = label),
n AS (SELECT p.anchor_id, p.label, p.q, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label = p.label AND s.q = p.q
  WHERE turn <= {POSITIVES} AND s.other <> p.label AND {LEAST[0]} * p.score <= {LEAST[1]} * s.score AND s.score <= p.score),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id, label, q, positive_id, positive_score ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank FROM n)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM t WHERE rank <= {NEGATIVES}
"""
