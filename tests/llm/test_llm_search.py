"""Exact search by bit slices, hard negatives by packed products, and the divergence of sources."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from carelake.llm import bit_slices, blocks, divergence, hard_negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int, size string, block int, q int, grp string"


def floors(vector, scale):
    return None if vector is None or any(x is None or not np.isfinite(x) for x in vector) else [int(np.floor(scale * float(x))) for x in vector]


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, "g") for r in rows], VECTORS)


def vectors(n=400, size=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, size)], int(rng.integers(0, 4))) for i in range(n)]
    # a large group of copies, ties, zero vectors, negative ids, repeated rows and ids
    rows += [(1000 + i, rows[3][1], i % 5) for i in range(150)]
    rows += [(2000, [0.0] * size, 1), (2020, [0.0] * size, 2), (-20, rows[5][1], 0), (-100, rows[7][1], 3), rows[0], rows[20], (40, rows[9][1], 1), (100, rows[9][1], 2)]
    # other sizes meet among themselves; an empty vector; what takes no part
    rows += [(3000, [1.0, 2.0], 1), (3001, [2.0, -1.0], 1), (3002, [2.0, -1.5], 0), (3020, [-1.0, 0.5], 2), (3003, [0.5, 1.25], 2), (4000, [], 1), (4001, [], 1), (4002, [], 2)]
    rows += [(None, rows[0][1], 1), (5000, None, 1), (5020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (5100, [float("nan")] * size, 1), (5200, [float("inf")] + [0.0] * (size - 1), 0)]
    return rows


def plain_search(rows, k=20, every=20, scale=64):
    held = {(i, tuple(q)) for i, v, _ in rows if i is not None and (q := floors(v, scale)) is not None}
    out = []
    for i, q in held:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, p)), j) for j, p in held if j != i and len(p) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near[:k], 1)]
    return sorted(out)


def test_exact_search_against_all_pairs(spark):
    rows = vectors()
    got = bit_slices.exact_search(table(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes)["score"] == "bigint"
    assert sorted(map(tuple, got.collect())) == plain_search(rows)


def test_exact_search_in_many_blocks(spark):
    rows = vectors(seed=4)
    held = blocks.quantised(table(spark, rows), 64)
    got = bit_slices.top_k(held, held.where("vec_id % 20 = 0"), 7, block=64, group=5)
    assert sorted(map(tuple, got.collect())) == plain_search(rows, 7)


def test_exact_search_of_wide_components(spark):
    """Components of up to 2^57 after scaling: slices are as many as needed; scores are held at a long's ends."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 3) * 10.0 ** rng.integers(-2, 8)], 1) for i in range(90)]
    assert sorted(map(tuple, bit_slices.exact_search(table(spark, rows)).collect())) == plain_search(rows)
    huge = [(0, [1e30, 0.0], 1), (1, [1e30, 1.0], 1), (2, [-1e30, 1.0], 1), (3, [0.0, 1.0], 1)]
    got = bit_slices.exact_search(table(spark, huge)).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1), (3, 0), (2, -(2**63))]


def test_few_rows_and_none(spark):
    assert bit_slices.exact_search(table(spark, [])).collect() == []
    assert bit_slices.exact_search(table(spark, [(20, [1.0], 1)])).collect() == []
    assert [tuple(r) for r in bit_slices.exact_search(table(spark, [(20, [1.0], 1), (21, [-0.001], 1)])).collect()] == [(20, 1, 21, -64)]
    assert hard_negatives.hard_negatives(table(spark, [])).collect() == []
    assert hard_negatives.hard_negatives(table(spark, [(1, [1.0], 1)])).collect() == []


def test_adders_and_selection():
    rng = np.random.default_rng(3)
    flags = rng.integers(0, 2, (40, 200)).astype(np.uint8)
    planes = bit_slices._bitmaps(flags)
    levels = [list(rng.integers(0, 40, n)) for n in (7, 0, 13, 1, 22)]
    total = bit_slices.add(planes, levels)
    want = sum(flags[p].astype(int) << w for w, level in enumerate(levels) for p in level)
    assert bit_slices.values(total, np.arange(200)) == want.tolist()
    everyone = bit_slices._bitmaps(np.ones((1, 200), np.uint8))[0]
    for k in (1, 5, 60, 200, 300):
        best = sorted(range(200), key=lambda i: (-want[i], i))[:k]
        assert sorted(bit_slices.select(total, everyone, k).tolist()) == sorted(best)


def plain_negatives(rows, every=100):
    held = set()
    for i, v, label in rows:
        q = floors(v, 256)
        if i is not None and label is not None and q is not None:
            held.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(q)))
    out = []
    for i, label, q in held:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), j, other) for j, other, p in held if j != i and len(p) == len(q))
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(t, n) for t, n, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"block": 32, "group": 2}])
def test_hard_negatives_against_all_pairs(spark, sizes):
    rows = [(i * 5 if i is not None and 0 <= i < 400 else i, v, label) for i, v, label in vectors(seed=6)] + [(600, [0.1] * 6, None), (7, [3.0] * 6, 9), (200, [3.0] * 6, 0)]
    want = plain_negatives(rows)
    got = hard_negatives.hard_negatives(table(spark, rows), **sizes)
    assert len(want) > 60 and {s for *_, s, _ in want} and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_wide_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i * 10, [float(np.float32(x)) for x in rng.normal(0.5, 1, 4) * 10.0 ** rng.integers(0, 6)], int(rng.integers(0, 2))) for i in range(120)]
    want = plain_negatives(rows)
    assert want and sorted(map(tuple, hard_negatives.hard_negatives(table(spark, rows)).collect())) == want


def test_packed_products():
    rng = np.random.default_rng(5)
    for width in (1, 3, 7, 8, 12):
        values = [int(v) for v in rng.integers(0, min(256**width, 2**62), 50)]
        wide = int.from_bytes(hard_negatives.pack(np.array(values), width), "little")
        assert wide == sum(v << (8 * width * i) for i, v in enumerate(values))
        assert [int(x) for x in hard_negatives.unpack(wide, 50, width)] == values


def plain_divergence(rows, ranks=200, least=3):
    langs, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        langs[lang].update(set(words))
        groups[lang, source].update(words)
    out = []
    for (lang, source), uses in groups.items():
        kept = [t for t, n in langs[lang].items() if n >= least]
        of = {s: c for (x, s), c in groups.items() if x == lang}

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        own, whole = p(uses), p(sum(of.values(), Counter()))
        pairs = [(sum((own[t] - q) ** 2 // q for t, q in p(c).items()), s) for s, c in of.items() if s != source]
        terms = [((own[t] - whole[t]) ** 2 // whole[t], t) for t in kept if uses[t] and own[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, r) for r, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def texts(seed=1, n=260):
    rng = np.random.default_rng(seed)
    heads = ["ab", "Ünïcödé", "prefixprefix", "long" * 9, "日本語のテキスト", "x" * 7, "y" * 8, "z" * 12, "Z" * 16]
    words = [heads[rng.integers(0, len(heads))] + "".join(rng.choice(list("abéЖ"), rng.integers(0, 4))) for _ in range(300)] + heads
    rows = []
    for _ in range(n):
        lang, source = [("en", "s1"), ("en", "s2"), ("en", "S3"), ("en", "é"), ("de", "s1"), (None, "s1"), ("", None), ("xx", "only")][rng.integers(0, 8)]
        picked = words[: 120 if source == "s1" else None]
        rows.append((" .\t5-".join(picked[min(int(rng.exponential(40)), len(picked) - 1)] for _ in range(rng.integers(0, 25))), lang, source))
    rows += [(None, "en", "no terms"), ("", "zz", "a"), ("123 _ [", "zz", "b"), ("rare words", "zz", "c"), ("w" * 100_000, "en", "s1"), ("w" * 100_000, "en", "s2"), ("w" * 100_000 + " ok", "en", "s2")]
    return rows + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_against_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "CHUNK", 2_000)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    rows = texts(seed)
    frame = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS docs", "'x' AS block", "3 AS uses")
    got = divergence.source_divergence(frame, block=50)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows)


def test_divergence_keeps_the_best_terms_only(spark):
    rows = [(" ".join(f"{a}{b}{c}" for a in "abcd" for b in "efgh" for c in "ijklmnopqrstuvwxyz") + " common" * i, "en", "one" if i % 2 else "two") for i in range(4)]
    rows += [("common " * 400 + "".join(f" {a}{b}{c}" for a in "abcd" for b in "efgh" for c in "ijkl"), "en", "three")]
    got = sorted(map(tuple, divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string")).collect()))
    assert got == plain_divergence(rows) and max(r[5] for r in got) == 200


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_refinement_counts_documents_of_prefixes(spark):
    rows = texts(3)
    plain = spark.createDataFrame([(t or "", l or "", s or "") for t, l, s in rows], "text string, lang string, source string")
    got = {(r["lang"], bytes(r["term"]).decode()): r["n_docs"] for r in divergence.kept_terms(divergence.counted_terms(plain)).collect()}
    want = Counter()
    for text, lang, _ in rows:
        low = "".join(c.lower() if c < "\x80" else c for c in text or "")
        want.update({(lang or "", w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)})
    assert got == {k: n for k, n in want.items() if n >= 3}
    assert [divergence.length(k) for k in range(5)] == [8, 12, 16, 32, 64] and [divergence.levels_of(n) for n in (7, 8, 11, 12, 31, 32)] == [1, 2, 2, 3, 4, 5]


def test_registered(spark, small_dir):
    for name in ("op11_hard_negatives", "op12_source_divergence", "op13_exact_search"):
        assert queries.QUERIES[name](spark, small_dir).count() > 0
