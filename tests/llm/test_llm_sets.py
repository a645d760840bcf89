"""Operators over whole tables: mixing, packing, line dedup, Jaccard join, neighbours, and the pipeline."""

import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from carelake.llm import components, jaccard_join, language_id, line_dedup, mixing, neighbours, packing, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# -- mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Round by round: clamp, and share the excess again. sizes: by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        above = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not above:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def mixed(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "'a' AS o", "2 AS slice")
    return mixing.mix(frame).collect()


def test_mixing_against_water_filling(spark):
    rng = np.random.default_rng(2)
    rows = [(i, str(rng.choice(["a", "b", "Z", "é", "zz"])), "w " * int(rng.integers(0, 60))) for i in range(300)]
    rows += [(1000 + i, None, "x y z") for i in range(7)] + [(2000, "tiny", "one"), (2001, "none", None), (2002, "none", ""), (None, "a", "p q"), (3, "a", "same id")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 2
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixed(spark, rows[::-1])), key=str)


def test_mixing_edges(spark):
    assert mixed(spark, [(1, "a", "x")])[0]["taken"] in (1, 2)
    assert [r["taken"] for r in mixed(spark, [(1, "a", None), (2, None, "")])] == [0, 0]
    frame = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(frame).count() == 0
    # repeated rows share the cut
    same = mixed(spark, [(7, "a", "one two three four five six seven eight")] * 10)
    assert len({r["taken"] for r in same}) == 1 and 8 <= same[0]["taken"] <= 16


def test_mixed_documents_are_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    # rows without an id, a third of all, rows of one id, and equal rows each have a place of their own or share one
    extra = docs.limit(60).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat(text, ' again') AS text", "lang", "source", "n_chars + 6 AS n_chars")
    extra = extra.unionByName(docs.limit(20).selectExpr("5L AS doc_id", "concat('first ', text) AS text", "lang", "source", "n_chars + 6 AS n_chars"))
    docs = docs.unionByName(extra).selectExpr("*", "'x' AS slice", "5 AS whole", "1 AS size", "2 AS `row`", "3 AS copy")
    rows = docs.collect()
    words, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        target[r["source"]] = r["target"]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    held = {tuple(r) for r in rows}
    for r in got:
        assert tuple(r) in held
        words[r["source"]] += len(WORDS.findall(r["text"]))
    most = Counter()
    for r in rows:
        most[r["source"]] = max(most[r["source"]], len(WORDS.findall(r["text"])))
    for s, t in target.items():
        assert abs(words[s] - t) <= most[s] / 2 + 1, (s, words[s], t)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed_documents(docs.repartition(7)).collect()), key=str)


def test_mixing_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, taken FROM ({mixing.ORACLE})").fetchall())
    got = sorted((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in queries.op5_mixing(spark, sf).collect())
    assert got == want


# -- packing


def check_packing(pieces, texts, window=1024):
    """Every id of every document in exactly one piece, sequences gapless and full but the last."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] > 0 and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == packing.crc(np.array(part)) == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[i])
    assert set(by_doc) == set(ids)
    for s, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing_round_trip(spark):
    texts = {0: None, 1: "", 2: "hello world", 3: "naïve  日本 <|endoftext|>\n\n", 4: "word " * 5000, 5: "x" * 3000, 6: "hello world",
             7: "a <|endoftext|> b", 8: "<|endoftext|><|endoftext|>", 9: " <|endoftext|> \n<|endoftext", 10: "<|endoftext|>" * 700}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).selectExpr("*", "1 AS part", "'z' AS ids")
    check_packing(packing.digest(packing.pack(frame)).collect(), texts)
    assert packing.pack(frame.where("false")).count() == 0
    small = spark.createDataFrame([(1, "a b c d e f g")] * 3, "doc_id long, text string")
    pieces = packing.pack(small, window=4).collect()
    assert sum(p["length"] for p in pieces) == 24 and {p["sequence_id"] for p in pieces} == set(range(6))


def test_packing_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_packing(queries.op6_packing(spark, sf).collect(), texts)


# -- line dedup

def plain_lines(text):
    """Lines with the white space after them: at line breaks, and where a word pair's number is the least among two on either side."""
    out = []
    for real in re.findall(r"[^\n]*\n|[^\n]+$", text):
        words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", real)
        m = [sum(byte * (((k + 1) ** 2 * 40_503 + (k + 1) * 2_654_435_761) % (2**31 - 1)) for k, byte in enumerate(WORDS.match(w)[0].encode())) * line_dedup.SPREAD % 2**60 for w in words]
        pair = [x ^ (2 * y) for x, y in zip(m, m[1:])]
        at = [0, *(i + 1 for i in range(2, len(words) - 3) if pair[i] < min(pair[i - 2 : i]) and pair[i] <= min(pair[i + 1 : i + 3])), len(words)]
        if words:
            out += ["".join(words[x:y]) for x, y in zip(at, at[1:])]
        elif out:
            out[-1] += real
    return out


def spread(text):
    """``plain_lines`` with all white space before a line's first word given to the line before; and what stands before the first word."""
    head = re.match(r"[\x20\x09-\x0D]*", text)[0]
    body, at = [], len(head)
    bare = [" ".join(WORDS.findall(x)) for x in plain_lines(text)]
    for line in bare:
        end = at
        for word in line.split(" "):
            end = text.index(word, end) + len(word)
        more = re.compile(r"[\x20\x09-\x0D]*").match(text, end)[0]
        body.append(text[at : end + len(more)])
        at = end + len(more)
    return head, body, bare


def key_order(spark, rows):
    """Distinct (id, text) in the order of documents: by id, then by the hash of both."""
    frame = spark.createDataFrame(rows, "doc_id long, text string").distinct()
    held = frame.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS h").collect()
    return sorted(((line_dedup.LAST_ID if r["doc_id"] is None else r["doc_id"], r["h"], r["text"]) for r in held if r["text"]), key=lambda x: x[:2])


def plain_line_dedup(order, least=line_dedup.LEAST_WORDS):
    """order: (doc_id, hash, text). Texts less the covered spans of enough words; and the words of each removed span."""
    first, places, spans = {}, [], []
    for i, h, t in order:
        head, body, bare = spread(t)
        n = max(len(bare) - 2, min(len(bare), 1))
        at = [(k, (len(bare) < 3, *bare[k : k + 3])) for k in range(n)]
        for k, w in at:
            first.setdefault(w, (i, h, k))
        places.append((i, h, t, head, body, bare, at))
    out = {}
    for i, h, t, head, body, bare, at in places:
        gone = sorted({k + j for k, w in at if first[w] != (i, h, k) for j in range(3) if k + j < len(bare)})
        removed, run = set(), []
        for k in [*gone, None]:
            if run and (k is None or k != run[-1] + 1):
                words = sum(len(bare[x].split(" ")) for x in run)
                if words >= least:
                    removed |= set(run)
                    spans.append(words)
                run = []
            run.append(k)
        out[i, t] = head + "".join(x for k, x in enumerate(body) if k not in removed) if removed else t
    return out, spans


def check_line_dedup(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS `key`", "1 AS hits", "text AS cut", "0 AS lines_removed", "3 AS position", "4 AS windows")
    want, spans = plain_line_dedup(key_order(spark, rows))
    got = line_dedup.dedup_lines(frame)
    assert len(got.columns) == len(set(got.columns)) == 8
    out = got.withColumnRenamed("cut", "before").collect()
    assert len(out) == len(rows)
    for r in out:
        place = line_dedup.LAST_ID if r["doc_id"] is None else r["doc_id"]
        assert r["text"] == want.get((place, r["before"]), r["before"]), (r["doc_id"], r["before"])
        assert (r["lines_removed"] > 0) == (r["text"] != r["before"])
    assert all(n >= line_dedup.LEAST_WORDS for n in spans)
    return {r["doc_id"]: r["text"] for r in out}


def sentence(name, n=9):
    return " ".join(f"{name}{i}" for i in range(n)) + "\n"


def test_line_dedup_cases(spark):
    a, b, c, d = (sentence(x) for x in "abcd")
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, a + b + c), (2, "own start.\n" + a + b + c + "own end."), (3, a + b + "else."), (4, None), (5, ""), (6, "  \n "), (7, "short."), (8, "short."),
        (9, a + b + c + d + "x.\n" + b + c + d + "y."), (None, a + b + c), (10, f"before it {passage}"), (11, f"intro.\n{passage}\nrest of eleven."),
        (12, f"other.\n{passage}\nend of twelve."), (13, "same."), (13, "same."), (14, "ü " * 3000), (15, "yes.\nno.\nmaybe."), (16, "\n  yes.\nno.\r\n\n maybe.\n"),
    ]
    got = check_line_dedup(spark, rows)
    assert got[2] == "own start.\nown end." and got[1] == a + b + c and got[3] == a + b + "else." and got[None] == "" and got[8] == "short."
    assert got[9] == d + "x.\n" + b + c + d + "y." or got[9].count("\n") < 8
    assert got[12] == "other.\nend of twelve." and got[13] == "same." and got[16].split() == ["yes.", "no.", "maybe."]


def test_line_dedup_of_equal_and_missing_ids(spark):
    a, b, c = (sentence(x) for x in "abc")
    rows = [(None, "one.\n" + a + b + c), (None, a + b + c + "two."), (5, "p.\n" + b + c + a), (5, b + c + a + "q."), (5, b + c + a + "q.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check = check_line_dedup(spark, rows)
    assert set(check) == {None, 5}
    left = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(frame).collect()]
    # one of the two texts of each id keeps the shared lines; equal rows fare alike
    assert sum(i is None and "a0" in t for i, t in left) == 1
    kept = {t for i, t in left if i == 5 and "a0" in t}
    assert len(kept) == 1 and len({t for i, t in left if i == 5}) == 2


def test_line_dedup_random(spark):
    rng = np.random.default_rng(4)
    lines = [" ".join(f"l{i}w{k}" for k in range(7)) for i in range(6)]
    rows = [(int(i), "\n".join(rng.choice(lines, rng.integers(0, 9)))) for i in rng.permutation(80)] + [(3, "\n".join(lines[1:4]))] * 2
    rows += [(200 + i, " ".join(rng.choice(["ab", "c", "d", "ef"], rng.integers(0, 400)))) for i in range(40)]
    check_line_dedup(spark, rows)
    assert line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").where("false")).count() == 0


def test_line_dedup_passages_at_all_offsets(spark):
    rng = np.random.default_rng(8)
    syllables = ["th", "on", "er", "ing", "ed", "ly", "at", "re", "nd", "es", "wh", "ou", "ti"]

    def words(n):
        return ["".join(rng.choice(syllables, rng.integers(2, 5))) for _ in range(n)]

    rows, of = [], {}
    for number in range(12):
        passage, first = words(51), 100 * number
        rows.append((first, "Intro.\n" + " ".join(passage) + "\nend."))
        for offset in range(40):
            before, after = words(offset), words(20)
            rows.append((first + 1 + offset, " ".join(before + passage + after)))
            of[first + 1 + offset] = (passage, before, after)
    got = check_line_dedup(spark, rows)
    for i, (passage, before, after) in of.items():
        left = got[i].split()
        # most of the passage goes, and nothing else but a word beside it that two documents happen to share
        assert len(before) + len(after) - 2 <= len(left) <= len(before) + len(after) + 51 - line_dedup.LEAST_WORDS, i
        assert left[: max(len(before) - 2, 0)] == before[:-2] and left[-18:] == after[2:]


def test_line_dedup_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want, spans = plain_line_dedup(key_order(spark, rows))
    got = {r["doc_id"]: r["kept_text"] for r in queries.op8_line_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: want.get((i, t), t) for i, t in rows}
    assert spans and min(spans) >= line_dedup.LEAST_WORDS


# -- n-gram Jaccard join


def plain_classes(rows):
    """rows: (doc_id, text) to (class_id, links) of each row."""
    sets = []
    for _, t in rows:
        w = WORDS.findall(t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in at[g] if j < i).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc), doc)
    return [(smallest.get(root(i)), n) for i, n in enumerate(links)]


def variants(rng, n, words, edits):
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, words, edits):
            w[at] = f"v{rng.integers(0, 10_000)}"
        out.append(" ".join(w))
    return out


def check_classes(spark, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `row`", "'x' AS bands", "2 AS set_key")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(frame, **how).collect()), key=str)
    want = sorted(((d, c if t and t.strip() else d, n) for (d, t), (c, n) in zip(rows, plain_classes(rows), strict=True)), key=str)
    assert got == want


def test_jaccard_cases(spark):
    rng = np.random.default_rng(6)
    rows = [(i, t) for i, t in enumerate(variants(rng, 60, 120, 2))] + [(100 + i, t) for i, t in enumerate(variants(rng, 5, 60, 1) * 3)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "one two"), (205, "one two three"), (None, "one two"), (206, "a b c d e"), (206, "a b c d e")]
    rows += [(300 + i, " ".join(f"u{i}_{k}" for k in range(40))) for i in range(20)]
    check_classes(spark, rows)
    check_classes(spark, rows, block=16)  # hot buckets in blocks
    assert jaccard_join.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_chain_of_links(spark):
    """A class that hangs together by a chain only."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 200])) for i in range(20)]
    check_classes(spark, rows)


def test_jaccard_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op10_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == {d: x for (d, _), x in zip(rows, plain_classes(rows), strict=True)}


def test_banding_reaches_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = jaccard_join.banding(similarity)
        assert bands * rows <= jaccard_join.MAX_HASHES and 1 - (1 - similarity**rows) ** bands >= jaccard_join.RECALL


def test_representatives_keep_columns(spark):
    rows = [(5, "a b c d e f", 1), (3, "a b c d e f", 2), (4, "x y", 3), (4, "x y", 3), (9, None, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `row` int")
    assert sorted(map(tuple, jaccard_join.representatives(frame).collect()), key=str) == [(3, "a b c d e f", 2), (4, "x y", 3), (9, None, 4)]


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(-50, 50, (60, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(100)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- nearest neighbours


def plain_nearest(rows, every=20, k=20):
    rows = list({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    usual = Counter(len(v) for _, v in rows).most_common(1)[0][0] if rows else 0
    rows = [(i, np.array(v, np.float64)) for i, v in rows if len(v) == usual]
    out = {}
    for q, x in rows:
        if q % every == 0:
            near = sorted(((-float(x @ v), i) for i, v in rows if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(spark, rows, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "2 AS vec")
    out = defaultdict(list)
    for r in sorted(neighbours.nearest(frame, **how).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_neighbours_small_tables_are_exact(spark):
    rng = np.random.default_rng(9)
    v = rng.integers(-3, 4, (70, 4)).astype(float).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(100, None), (120, [0.0] * 4), (140, [float("nan"), 1.0, 1.0, 1.0]), (160, [1.0, None, 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0, 1.0]), (200, [1.0, 2.0]), (None, v[0]), (220, [])]
    rows += [(300 + i, v[3]) for i in range(30)] + [(7, v[7])]
    got, want = found(spark, rows), plain_nearest(rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    few = found(spark, rows[:5])
    assert [i for i, _ in few[0]] == [i for i, _ in plain_nearest(rows[:5])[0]] and len(few[0]) <= 4
    assert not found(spark, [(20, [1.0, 0.0])]) and not found(spark, [])


def test_neighbours_recall(spark, monkeypatch):
    """The graph's rounds and the search at work: blocks far smaller than the table."""
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.7).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(spark, rows)
    s = x.astype(np.float64) @ x.astype(np.float64).T
    hit = 0
    for q in range(0, 3000, 20):
        s[q, q] = -np.inf
        hit += len(set(np.argsort(-s[q])[:20].tolist()) & {i for i, _ in got[q]})
    assert hit >= 0.9 * 20 * 150


def test_neighbours_rounds_work_on_small_tables(spark, monkeypatch):
    """With the sizes used in production: some hundred rows go through blocks and rounds, too."""
    turns, proposals = [], neighbours._proposals
    monkeypatch.setattr(neighbours, "_proposals", lambda *a: turns.append(a) or proposals(*a))
    x = np.random.default_rng(11).normal(size=(600, 24)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows), plain_nearest(rows)
    assert turns and set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.97 * 20 * len(want)


# -- the pipeline


def test_pipeline_stages_against_plain(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    extra = [(90_001, None, "en", "src0", 0), (90_002, "", "en", "src1", 0), (90_003, "123 456", None, None, 7), (None, "no id here, only words of english like the others", None, "src0", 49)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(extra, DOCS))
    docs.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    docs = spark.read.parquet(os.path.join(tmp_path, "documents.parquet"))
    (_, language), (_, lines), (_, near), (_, mixture), (_, packed) = corpus_pipeline.STAGES
    told = language(spark, docs, sf)
    assert told.columns == docs.columns
    before = docs.collect()
    letters = sorted((r for r in before if r["text"] and any(c.isalpha() for c in r["text"])), key=str)
    assert sorted(told.collect(), key=str) == letters
    cut = lines(spark, told, sf)
    want, _ = plain_line_dedup(key_order(spark, [(r["doc_id"], r["text"]) for r in letters]))
    wanted = []
    for r in letters:
        t = want.get((line_dedup.LAST_ID if r["doc_id"] is None else r["doc_id"], r["text"]), r["text"])
        if WORDS.search(t):
            wanted.append((r["doc_id"], t, r["lang"], r["source"], r["n_chars"] if t == r["text"] else len(t)))
    left = [tuple(r) for r in cut.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(left, key=str) == sorted(wanted, key=str)
    kept = near(spark, cut, sf)
    classes = plain_classes([(r[0], r[1]) for r in left])
    firsts = {c for c, _ in classes if c is not None}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([r[0] for r, (c, _) in zip(left, classes, strict=True) if r[0] == c and (c in firsts or c is None)], key=str)
    mixed_ = mixture(spark, kept, sf)
    got, sizes = Counter(), {}
    for r in mixed_.collect():
        got[tuple(r)] += 1
    assert set(got) <= {tuple(r) for r in kept.collect()} and max(got.values()) <= 2 and mixed_.columns == docs.columns
    for r in mixing.mix(kept).collect():
        of = sizes.setdefault(r["source"], [r["target"], 0, 0])
        of[2] = max(of[2], r["size"])
    for row, n in got.items():
        sizes[row[3]][1] += n * len(WORDS.findall(row[1]))
    assert all(abs(words - target) <= most / 2 + 1 for target, words, most in sizes.values())
    pieces = packed(spark, mixed_, sf).collect()
    assert sum(p["length"] for p in pieces) == sum(len(packing.encoder().encode(r["text"], allowed_special="all")) + 1 for r in mixed_.collect())
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "packing"]
    assert language_id.UNDETERMINED == "und"


def test_line_dedup_works_on_small_pieces():
    texts = ["a b c " * 10_000] * 100 + [None, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "n": pa.array(range(len(texts)))})
    pieces = list(line_dedup._pieces([batch], "text"))
    assert [n for part, _ in pieces for n in part["n"].to_pylist()] == list(range(len(texts)))
    assert [t for _, given in pieces for t in given] == [(t or "").encode() for t in texts]
    # a piece is a million bytes and one text more at most
    assert max(sum(map(len, given)) for _, given in pieces) < 1_000_000 + 60_000
