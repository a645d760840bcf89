"""DuckDB forms of the operators that SQL can express, over whole tables and texts."""

from __future__ import annotations

from carelake.llm import bit_slices, divergence, hard_negatives, jaccard_join, line_dedup, mixing, repetition

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def repetition_sql() -> str:
    ctes = [
        f"docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents)",
        "words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs)",
        "chars AS (SELECT r, sum(length(word)) AS word_chars FROM words GROUP BY r)",
        "lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs)",
        r"""dup AS (SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS dup_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY pos) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY r)""",
    ]
    sizes = sorted({*repetition.LIMITS, repetition.BASE_WINDOW})
    for n in sizes:
        ctes.append(f"""cover{n} AS (
  SELECT r, count(*) AS words, sum(length(word)) AS chars FROM words JOIN (
    SELECT DISTINCT r, pos + unnest(range({n})) AS pos FROM (
      SELECT r, pos, count(*) OVER (PARTITION BY r, k) AS n FROM (
        SELECT r, pos, list_slice(w, pos, pos + {n - 1}) AS k FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS pos FROM docs))) WHERE n > 1) USING (r, pos)
  GROUP BY r)""")
    covers = ", ".join(f"coalesce(c{n}.chars, 0) / CAST(greatest(coalesce(word_chars, 0), 1) AS DOUBLE) AS coverage_{n}" for n in repetition.LIMITS)
    ctes.append(f"""measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(c{repetition.BASE_WINDOW}.words, 0) AS n_repeat_words,
    len(w) < 20 OR 100 * coalesce(c{repetition.BASE_WINDOW}.words, 0) > 30 * len(w) AS base_failed,
    coalesce(dup_chars, 0) / CAST(greatest(coalesce(word_chars, 0), 1) AS DOUBLE) AS line_coverage, {covers}
  FROM docs LEFT JOIN chars USING (r) LEFT JOIN dup USING (r) {' '.join(f'LEFT JOIN cover{n} c{n} USING (r)' for n in sizes)})""")
    kept = " AND ".join([f"line_coverage <= {repetition.LINE_LIMIT}", *[f"coverage_{n} <= {limit}" for n, limit in repetition.LIMITS.items()]])
    return "WITH " + ",\n".join(ctes) + f"\nSELECT *, NOT base_failed AND {kept} AS kept FROM measured"


_SPACE = r"\x20\x09-\x0D"
LINE_DEDUP = rf"""
WITH keyed AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT coalesce(doc_id, {line_dedup.LAST_ID}) AS id, text FROM documents WHERE regexp_matches(text, '[^{_SPACE}]'))),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '[^{_SPACE}]+[{_SPACE}]*') AS w FROM keyed)),
bare AS (SELECT *, regexp_extract(word, '^[^{_SPACE}]+') AS b, coalesce(sum(CAST(contains(word, chr(10)) AS INTEGER)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM words),
known AS (SELECT b, CAST((list_sum([((k % 65521 + 1) * (k % 65521 + 1) * 40503 + (k % 65521 + 1) * 2654435761) % 2147483647
    * CAST('0x' || substr(hex(encode(b)), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT) FOR k IN range(strlen(b))])::HUGEINT * {line_dedup.SPREAD}) % 1152921504606846976 AS BIGINT) AS m FROM (SELECT DISTINCT b FROM bare)),
numbered AS (SELECT * FROM bare JOIN known USING (b)),
paired AS (SELECT *, xor(m, 2 * lead(m) OVER (PARTITION BY r ORDER BY i)) AS h FROM numbered),
cuts AS (SELECT *, coalesce(lag(line, {line_dedup.NEAR}) OVER d = lead(line, {line_dedup.NEAR + 1}) OVER d
    AND h < min(h) OVER (d ROWS BETWEEN {line_dedup.NEAR} PRECEDING AND 1 PRECEDING) AND h <= min(h) OVER (d ROWS BETWEEN 1 FOLLOWING AND {line_dedup.NEAR} FOLLOWING), FALSE) AS ends
  FROM paired WINDOW d AS (PARTITION BY r ORDER BY i)),
opened AS (SELECT *, i = 1 OR lag(ends) OVER d OR lag(line) OVER d <> line AS opens FROM cuts WINDOW d AS (PARTITION BY r ORDER BY i)),
parts AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS pos FROM opened),
lines AS (SELECT r, pos, string_agg(word, '' ORDER BY i) AS line, string_agg(b, ' ' ORDER BY i) AS t, count(*) AS n FROM parts GROUP BY r, pos),
framed AS (SELECT r, pos, count(*) OVER (PARTITION BY r) AS all_lines, t, lead(t) OVER d AS t2, lead(t, 2) OVER d AS t3 FROM lines WINDOW d AS (PARTITION BY r ORDER BY pos)),
windows AS (SELECT r, pos, id, text, (all_lines < 3, t, t2, t3) AS w FROM framed JOIN keyed USING (r) WHERE pos <= greatest(all_lines - 2, 1)),
firsts AS (SELECT w, min((id, text, pos)) AS f FROM windows GROUP BY w),
gone AS (SELECT DISTINCT r, pos + unnest(range(3)) AS pos FROM windows JOIN firsts USING (w) WHERE (id, text, pos) <> f),
islands AS (SELECT r, pos, n, pos - row_number() OVER (PARTITION BY r ORDER BY pos) AS island FROM gone JOIN lines USING (r, pos)),
cut AS (SELECT r, pos FROM (SELECT r, pos, sum(n) OVER (PARTITION BY r, island) AS words FROM islands) WHERE words >= {line_dedup.LEAST_WORDS}),
rest AS (SELECT r, count(here) AS lines_removed, coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE here IS NULL), '') AS rest FROM lines LEFT JOIN (SELECT *, TRUE AS here FROM cut) USING (r, pos) GROUP BY r),
out AS (SELECT d.doc_id, CAST(coalesce(lines_removed, 0) AS INTEGER) AS lines_removed,
    CASE WHEN coalesce(lines_removed, 0) > 0 THEN regexp_extract(d.text, '^[{_SPACE}]*') || rest ELSE d.text END AS kept_text
  FROM documents d LEFT JOIN (SELECT id, text, lines_removed, rest FROM keyed JOIN rest USING (r)) c ON coalesce(d.doc_id, {line_dedup.LAST_ID}) = c.id AND d.text = c.text)
SELECT doc_id, lines_removed, CAST(coalesce(length(kept_text), 0) AS BIGINT) AS n_chars_kept, md5(kept_text) AS kept_md5, kept_text FROM out
"""

_NEAR = f"{jaccard_join.THRESHOLD[1]} * n >= {jaccard_join.THRESHOLD[0]} * (a.size + b.size - n)"
JACCARD = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
grams AS (SELECT DISTINCT r, list_slice(w, pos, pos + {jaccard_join.NGRAM - 1}) AS g FROM (
  SELECT r, w, unnest(range(1, greatest(len(w) - {jaccard_join.NGRAM - 1}, 1) + 1)) AS pos FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS size FROM grams GROUP BY r),
pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN sizes a ON a.r = p.a JOIN sizes b ON b.r = p.b WHERE {_NEAR}),
reach(a, b) AS (SELECT r, r FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, (SELECT min(o.doc_id) FROM reach JOIN docs o ON o.r = reach.b WHERE reach.a = d.r) AS class_id,
       (SELECT count(*) FROM links WHERE links.a = d.r) AS n_links
FROM docs d
"""

ORACLES = {
    "op5_mixing": mixing.ORACLE,
    "op7_repetition": repetition_sql(),
    "op8_line_dedup": LINE_DEDUP,
    "op10_jaccard_join": JACCARD,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_exact_search": bit_slices.ORACLE,
}
