"""Divergence of sources within a language, over the terms that enough documents hold.

Kept terms come from iceberg prefix refinement. Terms are extended level by
level: at a level, all terms of a language with the same first bytes are one
prefix; a prefix found in fewer documents than the threshold is dropped with
every term below it, and the others are extended to the next level, until only
complete terms are left. So a rare term leaves as soon as its prefix is rare.

Distinct documents of a prefix add up, without a list of documents: with a
document's terms in byte order, exactly one of those below a prefix is the
first there. ``docs[k]`` of a term counts the documents in which the term is
the first below its prefix of level k; the documents of a prefix are the sum
over its terms. Chunks of documents are counted in tasks and give one row for
each of their terms.

Every (lang, source) group gives each kept term a smoothed integer probability
p, and the divergence of p from q sums or ranks floor((p - q)^2 / q). A term
that a group lacks has the group's least p, so that only the terms a group
holds are stored. Terms are dealt to blocks by hash; a task turns a block's
counts into columns for a few sources at a time, gives partial sums for pairs
of sources and its best terms of each group.

Edge cases: null text, lang and source are empty texts; a document without a
term still makes its group occur. Rows are documents, whatever their ids.
Only A-Z is lower-cased; all characters beyond ASCII are parts of terms. A
lang without kept terms has pairs of value 0 and no terms. Ties go to the item
that is smaller in UTF-8. An empty table gives no rows. Other columns aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.blocks import dealt, pieces
from carelake.llm.common import stored, tidy

#: Documents of a language that must hold a term.
LEAST_DOCS = 3
SCALE = 10**9
TERM_RANKS = 200
#: Bytes of texts that are counted together, plus one text at most.
CHUNK = 16_000_000
#: Terms of a block, and sources whose columns a task holds at once.
BLOCK = 32_768
SOURCES = 16

#: Bytes of terms; the others are separators. UTF-8 bytes beyond ASCII are all parts of terms.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))

COUNTED = "lang string, term binary, docs array<int>, uses array<struct<source:string,n:long>>"


def length(level: int) -> int:
    """Bytes of the prefixes of a level: 8, 12, then doubling from 16. A term shorter than that is complete."""
    return (8, 12)[level] if level < 2 else 16 << (level - 2)


def levels_of(size: int) -> int:
    """Levels up to the one at which a term of ``size`` bytes is complete."""
    level = 0
    while length(level) <= size:
        level += 1
    return level + 1


def _lists(flat: pa.Array, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)


def words_of(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All terms of the texts in order, and the number of each one's text."""
    joined = b" ".join(texts).translate(_BYTES)
    held = np.frombuffer(joined, np.uint8)
    part = np.zeros(len(held) + 2, np.int8)
    part[1:-1] = held != 32
    edge = np.flatnonzero(np.diff(part))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held[part[1:-1] > 0])])
    first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return words, np.searchsorted(first, starts, side="right") - 1


def count_terms(lang: str, texts: list[bytes], sources: list[str]) -> pa.RecordBatch:
    """One row for each term of the texts (UTF-8) of a language: docs by level, and uses by source."""
    words, doc = words_of(texts)
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    ids = number[coded.indices.to_numpy()]
    column = coded.dictionary.take(pa.array(order))
    terms = column.to_numpy(zero_copy_only=False).tolist()
    names, source = np.unique(np.array(sources, dtype=object), return_inverse=True)
    used, n = np.unique(ids * len(names) + source[doc], return_counts=True)
    # (document, term) in order, each once
    held = np.sort(doc * max(1, len(terms)) + ids)
    doc, ids = np.divmod(held[np.diff(held, prepend=-1) > 0], max(1, len(terms)))
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    cuts = [length(k) for k in range(levels_of(int(size.max(initial=0))))]
    needed = np.searchsorted(cuts, size, side="right") + 1
    start = np.cumsum(needed) - needed
    docs = np.zeros(int(needed.sum()), np.int32)
    for level, cut in enumerate(cuts if terms else []):
        heads = [t[:cut] for t in terms]
        prefix = np.concatenate([[0], np.cumsum(np.fromiter(map(ne, heads[1:], heads), bool, len(heads) - 1))])[ids]
        first = np.ones(len(ids), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (prefix[1:] != prefix[:-1])
        found = np.bincount(ids[first], minlength=len(terms))
        at = needed > level
        docs[start[at] + level] = found[at]
    term, source = np.divmod(used, max(1, len(names)))
    uses = pa.StructArray.from_arrays([pa.array(names.tolist(), pa.string()).take(pa.array(source)), pa.array(n.astype(np.int64))], names=["source", "n"])
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(terms), pa.string()), column, _lists(pa.array(docs), needed), _lists(uses, np.bincount(term, minlength=len(terms)))],
        names=["lang", "term", "docs", "uses"],
    )


def counted_terms(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (text, lang, source; no nulls) counted in chunks: a row for each chunk, lang and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        n = 0
        for batch in batches:
            for text, lang, source in zip(batch["text"].cast(pa.binary()).to_numpy(zero_copy_only=False), batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True):
                texts, sources = held.setdefault(lang, ([], []))
                texts.append(text)
                sources.append(source)
                n += len(text)
                if n >= CHUNK:
                    for name, (texts, sources) in held.items():
                        yield count_terms(name, texts, sources)
                    held, n = {}, 0
        for name, (texts, sources) in held.items():
            yield count_terms(name, texts, sources)

    return docs.select("text", "lang", "source").mapInArrow(tidy(run), COUNTED)


def kept_terms(counted: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n_docs): the terms that at least ``least`` documents of their lang hold, by prefix refinement."""
    below = counted.select("lang", "term", "docs")
    kept, level = None, 0
    while True:
        cut = length(level)
        prefixes = below.groupBy("lang", F.substring("term", 1, cut).alias("prefix")).agg(F.sum(F.get("docs", F.lit(level))).alias("n_docs"))
        prefixes = stored(prefixes.where(F.col("n_docs") >= least), "divergence-prefixes")
        # a prefix shorter than the level's is a whole term
        whole = prefixes.where(F.length("prefix") < cut).select("lang", F.col("prefix").alias("term"), "n_docs")
        kept = whole if kept is None else kept.unionByName(whole)
        open_ = prefixes.where(F.length("prefix") == cut).select("lang", "prefix")
        if open_.isEmpty():
            return kept
        longer = below.where(F.length("term") >= cut).withColumn("prefix", F.substring("term", 1, cut))
        below = stored(longer.join(open_, ["lang", "prefix"], "leftsemi").select("lang", "term", "docs"), "divergence-terms")
        level += 1


def probability(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    more = count.astype(object) if count.size and int(count.max()) > 2**62 // SCALE else count
    return (1 + SCALE * (more + 1) // total).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    # p and q are at most 1 + SCALE: squares fit a long
    return (p - q) * (p - q) // q


def _block(key: tuple, uses: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial pair sums and the best terms of each group over one block of a lang's terms.

    ``uses``: source, term, n. ``groups``: source, total (N + V), lang_total."""
    sources = groups["source"].to_pylist()
    totals = groups["total"].to_pylist()
    place = {s: i for i, s in enumerate(sources)}
    coded = uses["term"].combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order)).to_numpy(zero_copy_only=False).tolist()
    term = np.argsort(order)[coded.indices.to_numpy()]
    source = np.fromiter(map(place.__getitem__, uses["source"].to_numpy()), np.int64, uses.num_rows)
    n = uses["n"].to_numpy().astype(np.int64)
    order = np.argsort(source, kind="stable")
    term, n = term[order], n[order]
    starts = np.searchsorted(source[order], np.arange(len(sources) + 1)).tolist()

    def column(i: int) -> np.ndarray:
        """p of source i for every term of the block."""
        a, b = starts[i], starts[i + 1]
        out = np.full(len(names), probability(np.zeros(1, np.int64), totals[i])[0])
        out[term[a:b]] = probability(n[a:b], totals[i])
        return out

    rows: dict[str, list] = {"part": [], "source": [], "item": [], "value": []}

    def give(part: str, name: str, items: list[str], found: list[int]) -> None:
        rows["part"] += [part] * len(items)
        rows["source"] += [name] * len(items)
        rows["item"] += items
        rows["value"] += found

    empty = not names
    if not empty:
        whole = np.zeros(len(names), np.int64)
        np.add.at(whole, term, n)
        q_lang = probability(whole, groups["lang_total"][0].as_py())
        for i, name in enumerate(sources):
            t = term[starts[i] : starts[i + 1]]
            p, q = column(i)[t], q_lang[t]
            t, value = t[p > q], divergence(p, q)[p > q]
            best = np.lexsort((t, -value))[:TERM_RANKS]  # terms are numbered in byte order
            give("term", name, [names[x].decode() for x in t[best]], value[best].tolist())
    for at in range(0, len(sources), SOURCES):
        right = range(at, min(at + SOURCES, len(sources)))
        q = None if empty else np.stack([column(j) for j in right])
        for i, name in enumerate(sources):
            value = [0] * len(right) if empty else divergence(column(i)[None, :], q).sum(axis=1).tolist()
            others = [(sources[j], v) for j, v in zip(right, value, strict=True) if j != i]
            give("pair", name, [s for s, _ in others], [v for _, v in others])
    lang = key[0].as_py()
    return pa.table({
        "lang": pa.array([lang] * len(rows["part"]), pa.string()), "source": pa.array(rows["source"], pa.string()), "part": pa.array(rows["part"], pa.string()),
        "item": pa.array(rows["item"], pa.string()), "value": pa.array(rows["value"], pa.int64()),
    })


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value and rank: how sources of ``docs`` (text, lang, source) differ within their lang."""
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = stored(counted_terms(plain), "divergence-counted")
    kept = stored(kept_terms(counted, least), "divergence-kept")
    uses = counted.select("lang", "term", "uses").join(kept.select("lang", "term").hint("merge"), ["lang", "term"])
    uses = uses.select("lang", "term", F.explode("uses").alias("use")).groupBy("lang", "term", F.col("use.source").alias("source")).agg(F.sum("use.n").alias("n"))
    uses = stored(uses, "divergence-uses")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    held = uses.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    # one row for each group: with and without terms
    groups = plain.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")
    )
    groups = stored(
        groups.select("lang", "source", (F.col("n") + F.col("v")).alias("total"), (F.sum("n").over(Window.partitionBy("lang")) + F.col("v")).alias("lang_total")), "divergence-groups"
    )
    blocks = pieces(sizes.agg(F.coalesce(F.max("v"), F.lit(0))).first()[0], block)
    left = uses.withColumn("block", dealt("block", blocks, "term"))
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "lang string, source string, part string, item string, value long"
    found = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(_block, schema)
    # a term is in one block; a pair has a partial sum from each
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TERM_RANKS))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(v.v, 0) AS v, coalesce(n.n, 0) AS n, sum(coalesce(n.n, 0)) OVER (PARTITION BY x.lang) AS lang_n FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) n USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p FROM g JOIN kept k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT c.lang, c.term, 1 + (CAST({SCALE} AS HUGEINT) * (sum(c.n) + 1)) // any_value(g.lang_n + g.v) AS q FROM c JOIN (SELECT DISTINCT lang, lang_n, v FROM g) g USING (lang) GROUP BY c.lang, c.term),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(CAST(f.value AS BIGINT), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""
