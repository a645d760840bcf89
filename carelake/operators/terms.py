"""Mentions of many terms in texts (P8), by one automaton of all terms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.session import ship

#: Most terms of a table: each worker holds them all. A longer table is an error, not cut.
MOST_TERMS = 1_000_000

_automata: dict[int, object] = {}


def _automaton(terms: tuple[str, ...]):
    """The automaton of these terms, made once for each worker process."""
    import ahocorasick

    key = hash(terms)
    if key not in _automata:
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            made.add_word(term, i)
        made.make_automaton()
        _automata.clear()
        _automata[key] = made
    return _automata[key]


def mentions(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame, term_col: str = "term", most: int = MOST_TERMS) -> DataFrame:
    """(id, term) for every text that holds a term of the table ``terms`` as a substring, both lower-cased.

    A text is read once, however many terms there are. Null and empty terms and texts have no mentions; repeated
    terms count once, repeated rows each give their own mentions."""
    ship(texts.sparkSession)
    listed = terms.select(F.lower(term_col).alias("t")).where("t is not null and t <> ''").distinct().orderBy("t").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} terms: deal them to several calls")
    held = tuple(r["t"] for r in listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(held) if held else None
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch[1].to_pylist() if held else []):
                hits = {n for _, n in automaton.iter(text)} if text else ()
                rows.extend([i] * len(hits))
                found.extend(held[n] for n in sorted(hits))
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=[id_col, "term"])

    schema = T.StructType([texts.schema[id_col], T.StructField("term", T.StringType())])
    return texts.select(id_col, F.lower(text_col).alias("text")).mapInArrow(run, schema)
