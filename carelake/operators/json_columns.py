"""JSON documents read column by column: the string leaves that meet a pattern, with their paths.

A task hands its documents to Arrow's JSON reader in pieces, which gives one column for each path, and asks the pattern
of each text column as a whole. A piece that the reader doesn't take as ``try_parse_json`` does (no JSON, fields of
several types, NaN, too deep or too wide for columns) is halved down to ``LEAST`` documents; what is left is ``odd`` and
goes back as it came, for the caller to parse. Nothing is left out, and nothing is learned from other documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj

#: A piece's documents and bytes; below so many documents a piece that can't be read is not halved again.
DOCUMENTS, BYTES, LEAST = 1024, 512 << 10, 16
#: More columns than this are no shape that documents share. Longer documents, names and numbers meet limits of the other parser.
COLUMNS, LONGEST, LONGEST_NAME, LONG_NUMBER = 2000, 1 << 20, 50_000, "[0-9.]{1000}"
#: More types than this among the documents of a batch are not read apart.
TYPES = 16

FOUND = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))


class Odd(Exception):
    """Documents that the reader does not take, or not as the parser does."""


class Wide(Odd):
    """Documents whose names are data: columns don't fit them."""


def _table(texts: pa.Array) -> pa.Array:
    """The documents as one column, each in an object of its own: a text that is no document breaks its line."""
    lines = pc.binary_join_element_wise(pa.scalar('{"d":', pa.large_string()), texts.cast(pa.large_string()), pa.scalar("}\n", pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, data = lines.buffers()
    size = int.from_bytes(offsets[8 * len(lines):8 * len(lines) + 8].to_pybytes(), "little")
    try:
        read = pj.read_json(pa.BufferReader(data.slice(0, size)), read_options=pj.ReadOptions(use_threads=False, block_size=size + 1))
    except pa.ArrowException as error:
        raise Odd(str(error)) from None
    if read.column_names != ["d"] or read.num_rows != len(texts):
        raise Odd("not one document in each text")
    return pa.concat_arrays(read.column(0).chunks)


def _leaves(column: pa.Array, path: str, depth: int, levels: int, seen: list[int]) -> Iterator[tuple[str, pa.Array]]:
    """(path, values) of the text columns below a column."""
    seen[0] += 1
    if seen[0] > COLUMNS:
        raise Wide("too many columns")
    kind = column.type
    if (pa.types.is_struct(kind) or pa.types.is_list(kind)) and depth >= levels:
        raise Odd("nested deeper than the levels")
    if pa.types.is_struct(kind):
        dot = "." if path else ""
        for field, inner in zip(kind, column.flatten(), strict=True):
            if len(field.name) > LONGEST_NAME:
                raise Odd("a long name")
            yield from _leaves(inner, f"{path}{dot}{field.name}", depth + 1, levels, seen)
    elif pa.types.is_list(kind):
        yield from _leaves(column.flatten(), f"{path}[]", depth + 1, levels, seen)
    elif pa.types.is_floating(kind):
        if pc.any(pc.invert(pc.is_finite(column))).as_py():
            raise Odd("a number that JSON doesn't have")
    elif pa.types.is_string(kind):
        yield path, column
    elif not (pa.types.is_null(kind) or pa.types.is_boolean(kind) or pa.types.is_integer(kind) or pa.types.is_timestamp(kind)):
        raise Odd(f"a column of {kind}")


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    for start in range(0, len(texts), DOCUMENTS):
        some = texts.slice(start, DOCUMENTS)
        step = max(1, len(some) // -(-pc.sum(pc.binary_length(some)).as_py() // BYTES or 1))
        for at in range(0, len(some), step):
            yield some.slice(at, step)


class Reader:
    """What a task finds by columns; once documents prove too wide for columns, all others are odd."""

    def __init__(self, pattern: str, levels: int):
        self.pattern, self.levels, self.wide = pattern, levels, False

    def read(self, texts: pa.Array) -> tuple[list[tuple[str, pa.Array]], list[pa.Array]]:
        """((path, matching values), odd documents) of documents that are not null."""
        found, odd = [], []
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            return found, [texts]
        size = pc.binary_length(texts)
        if (pc.max(size).as_py() or 0) > 1000:
            strange = pc.or_(pc.greater(size, LONGEST), pc.match_substring_regex(texts, LONG_NUMBER))
            odd.append(texts.filter(strange))
            texts = texts.filter(pc.invert(strange))
        for piece in _pieces(texts):
            self._halved(piece, found, odd)
        return found, [part for part in odd if len(part)]

    def _halved(self, texts: pa.Array, found: list, odd: list) -> None:
        if self.wide:
            odd.append(texts)
            return
        try:
            found.extend(self._matching(texts))
        except Wide:
            self.wide = True
            odd.append(texts)
        except Odd:
            if len(texts) <= LEAST:
                odd.append(texts)
                return
            half = len(texts) // 2
            self._halved(texts.slice(0, half), found, odd)
            self._halved(texts.slice(half), found, odd)

    def _matching(self, texts: pa.Array) -> list[tuple[str, pa.Array]]:
        found = []
        for path, values in _leaves(_table(texts), "", 0, self.levels, [0]):
            held = values.filter(pc.match_substring_regex(values, self.pattern))
            if len(held):
                found.append((path, held))
        return found


def _row(kind: str | None, found: list[tuple[str | None, pa.Array]]) -> pa.RecordBatch:
    """One row with all pairs as a list."""
    pairs = [pa.StructArray.from_arrays([pa.repeat(pa.scalar(path, pa.string()), len(values)), values], names=["path", "value"]) for path, values in found]
    inner = pa.concat_arrays(pairs)
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.string()), pa.nulls(1, pa.string()), pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)], names=NAMES)


NAMES = ["kind", "odd", "found"]


def matching(pattern: str, levels: int):
    """A function over Arrow batches of (type, document) or (type, document, id) that gives rows of (type, odd, found):
    the matching text leaves of many documents as one list, or an odd document as it came. Ids stand in such a list
    without a path.

    The pattern (RE2) must not match a text that begins with a digit: a column whose texts all read as times is
    passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(pattern, levels)
        for batch in batches:
            kinds = pc.unique(batch.column(0))
            apart = len(kinds) <= TYPES
            for kind in kinds:
                rows = batch if len(kinds) == 1 else batch.filter(pc.equal(batch.column(0), kind) if kind.is_valid else pc.is_null(batch.column(0)))
                texts = rows.column(1).drop_null()
                found, odd = reader.read(texts) if apart else ([], [texts])
                ids = rows.column(2).drop_null() if rows.num_columns > 2 else []
                if len(ids):
                    found.append((None, ids))
                if found:
                    yield _row(kind.as_py(), found)
                for part in odd:
                    yield pa.RecordBatch.from_arrays([pa.repeat(kind, len(part)), part, pa.nulls(len(part), FOUND)], names=NAMES)

    return run
