"""Fill-in-middle by secondary sort.

A text is cut into units, runs of letters A-Z or single other characters.  Two hashes of
the id end its prefix and its middle, two more choose the form: ``plain`` (the text),
``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or ``spm`` (``<S>`` suffix ``<P>``
prefix ``<M>`` middle).  Texts that hold a mark, and empty ones, stay plain.

Pieces of whole units travel by themselves, keyed by document and by their position in the
output.  One shuffle deals documents to partitions, where pieces are sorted by position and
streamed into digests or texts; nothing but one piece is held at a time.  To restore, the
same stream is read for its marks, its parts get the positions they have in the text, the
partition is sorted again, without another shuffle, and streamed again.

A null text counts as empty, a null id as an empty one.  Rows are told apart by id and text;
of equal rows each gets a result.  Other columns take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MARK = re.compile(rb"<[PSM]>")
SPLIT_MARK = (b"<", b"<P", b"<S", b"<M")
# The parts in the order of the text, and in the order of the forms.
ORDER = {b"P": 0, b"M": 1, b"S": 2}
FORMS = {"psm": b"PSM", "spm": b"SPM"}
# Texts are transformed in this share of documents, and this share of these is spm, in per cent.
TRANSFORMED, SUFFIX_FIRST = 90, 20
PIECE_BYTES = 1 << 16
BATCH_BYTES = 1 << 22
HEADER = -1

KEY = [T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.BinaryType())]
FACTS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
]
# A document's header (position -1) has its facts and no piece, other rows the reverse.
PIECES = T.StructType(
    [
        *KEY,
        T.StructField("position", T.LongType()),
        T.StructField("piece", T.BinaryType()),
        *FACTS,
    ]
)
SORTED_BY = ["doc_id", "text_key", "position"]


def unit_starts(data: bytes) -> np.ndarray:
    """Where the units of a text in UTF-8 begin."""
    byte = np.frombuffer(data, np.uint8)
    letter = ((byte | 32) - 97).astype(np.uint8) < 26
    starts = (byte & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def _characters(data: bytes) -> int:
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def _pieces(data: bytes, starts: np.ndarray, begin: int, end: int) -> Iterator[bytes]:
    """Consecutive pieces of whole units, the next one begun after PIECE_BYTES."""
    while end - begin > PIECE_BYTES:
        at = int(np.searchsorted(starts, begin + PIECE_BYTES))
        stop = int(starts[at]) if at < len(starts) else end
        if stop >= end:
            break
        yield data[begin:stop]
        begin = stop
    yield data[begin:end]


def cut(doc_id: int | None, text: str | None, seed: int) -> tuple[tuple, Iterator[bytes]]:
    """The facts of a document (n, form, prefix_chars, middle_chars), and its output."""
    data = (text or "").encode()
    starts = unit_starts(data)
    n = len(starts)
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not data or h3 % 100 >= TRANSFORMED or MARK.search(data):
        return (n, "plain", None, None), _pieces(data, starts, 0, len(data))
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    bounds = np.append(starts, len(data))
    p, m = (int(bounds[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    part = {b"P": (0, p), b"M": (p, m), b"S": (m, len(data))}

    def output() -> Iterator[bytes]:
        for mark in (bytes([c]) for c in FORMS[form]):
            yield b"<" + mark + b">"
            yield from _pieces(data, starts, *part[mark])

    return (n, form, _characters(data[:p]), _characters(data[p:m])), output()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]):
    """Record batches of about BATCH_BYTES."""
    held, total = [], 0
    for row in chain(rows, [None]):
        if row is not None:
            held.append(row)
            total += size(row) + 64
        if held and (row is None or total > BATCH_BYTES):
            columns = zip(*held, strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            held, total = [], 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches, converted a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _piece_size(row: tuple) -> int:
    return len(row[3] or b"")


def cut_pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1
) -> DataFrame:
    """The pieces of all documents (``PIECES``)."""
    docs = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    arrow = to_arrow_schema(PIECES)

    def rows(batches) -> Iterator[tuple]:
        for doc_id, text in _rows(batches):
            key = hashlib.sha256((text or "").encode()).digest()[:16]
            facts, output = cut(doc_id, text, seed)
            yield (doc_id, key, HEADER, None, *facts)
            # Marks and short parts share a piece.
            position, held = 0, b""
            for piece in output:
                if held and len(held) + len(piece) > PIECE_BYTES:
                    yield (doc_id, key, position, held, None, None, None, None)
                    position, held = position + 1, b""
                held += piece
            if held:
                yield (doc_id, key, position, held, None, None, None, None)

    return docs.mapInArrow(lambda b: _batches(rows(b), arrow, _piece_size), PIECES)


def arranged(pieces: DataFrame) -> DataFrame:
    """Each document's pieces in one partition, in the order of their positions."""
    return pieces.repartition("doc_id", "text_key").sortWithinPartitions(*SORTED_BY)


class Parts:
    """Reads an output piece by piece: what comes, with its part's place in the text."""

    def __init__(self, form: str):
        self.plain = form == "plain"
        self.part, self.rest = 0, b""

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        if self.plain:
            yield 0, piece
            return
        data, at = self.rest + piece, 0
        for mark in MARK.finditer(data):
            if mark.start() > at:
                yield self.part, data[at : mark.start()]
            self.part, at = ORDER[mark.group()[1:2]], mark.end()
        # A mark may go on in the next piece.
        cut = (len(m) for m in SPLIT_MARK if data.endswith(m))
        held = min(next(cut, 0), len(data) - at)
        stop = len(data) - held
        if stop > at:
            yield self.part, data[at:stop]
        self.rest = data[stop:]

    def end(self) -> Iterator[tuple[int, bytes]]:
        if self.rest:
            yield self.part, self.rest


def _documents(batches) -> Iterator[tuple[tuple, int, Iterator[bytes]]]:
    """(header row, number of equal rows, pieces) of each document in sorted rows.

    Equal rows have equal pieces at equal positions; one of each is taken.  The pieces must
    be used up before the next document is asked for.
    """
    rows = _rows(batches)
    row = next(rows, None)
    while row is not None:
        head, count = row, 0
        while row is not None and row[:3] == head[:3]:
            count, row = count + 1, next(rows, None)

        def pieces() -> Iterator[bytes]:
            nonlocal row
            at = HEADER
            while row is not None and row[:2] == head[:2]:
                if row[2] != at:
                    at = row[2]
                    yield row[3]
                row = next(rows, None)

        yield head, count, pieces()


MIDWAY = T.StructType(
    [
        *PIECES.fields,
        T.StructField("output_sha256", T.StringType()),
        T.StructField("copies", T.LongType()),
    ]
)


def _reversed(batches) -> Iterator[tuple]:
    """For every document its pieces with their places in the text, then its header with the
    digest of the output."""
    for head, count, pieces in _documents(batches):
        digest, parts, number = hashlib.sha256(), Parts(head[5]), 0

        def each(pieces=pieces, digest=digest, parts=parts) -> Iterator[tuple[int, bytes]]:
            for piece in pieces:
                digest.update(piece)
                yield from parts.feed(piece)
            yield from parts.end()

        for part, piece in each():
            yield (*head[:2], part << 40 | number, piece, *[None] * 6)
            number += 1
        yield (*head, digest.hexdigest(), count)


DIGESTS = T.StructType(
    [
        KEY[0],
        *FACTS,
        T.StructField("output_sha256", T.StringType()),
        T.StructField("restored_sha256", T.StringType()),
    ]
)


def _restored(batches) -> Iterator[tuple]:
    for head, _, pieces in _documents(batches):
        digest = hashlib.sha256()
        for piece in pieces:
            digest.update(piece)
        for _ in range(head[9]):
            yield (head[0], *head[4:9], digest.hexdigest())


def digests(pieces: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the
    text restored from it, of every document in ``pieces``."""
    midway, final = to_arrow_schema(MIDWAY), to_arrow_schema(DIGESTS)
    back = arranged(pieces).mapInArrow(
        lambda b: _batches(_reversed(b), midway, _piece_size), MIDWAY
    )
    return back.sortWithinPartitions(*SORTED_BY).mapInArrow(
        lambda b: _batches(_restored(b), final, lambda row: 256), DIGESTS
    )


OUTPUTS = T.StructType([KEY[0], *FACTS, T.StructField("output", T.StringType())])


def outputs(pieces: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the ``output`` text of every document."""
    arrow = to_arrow_schema(OUTPUTS)

    def rows(batches) -> Iterator[tuple]:
        for head, count, found in _documents(batches):
            text = b"".join(found).decode()
            for _ in range(count):
                yield (head[0], *head[4:8], text)

    return arranged(pieces).mapInArrow(
        lambda b: _batches(rows(b), arrow, lambda row: len(row[5])), OUTPUTS
    )


def restored_text(output: Column, form: Column) -> Column:
    """The text of an output that fits a row."""

    def part(mark: str) -> Column:
        after = F.substring_index(output, f"<{mark}>", -1)
        return F.regexp_extract(after, r"(?s)^(.*?)(?:<[PSM]>|\z)", 1)

    return F.when(form == "plain", output).otherwise(F.concat(part("P"), part("M"), part("S")))
