"""The first page of a long document that contains a sought text.

Sought texts and pages of a document meet once, in parts of at most so many pages.
A text at a position is known by a polynomial hash, which a running sum gives for any
length; what hashes alike is compared as text.  Nothing is kept for a position beyond the
slice of pages at hand, and no chunk is held against a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.chunking import PAGE_TIERS
from lexweave.functions.text import match_form
from lexweave.operators.rows import by_key, small_side

# Characters of pages searched at once.
SLICE_CHARS = 1 << 20
# Candidates looked at together; each has as many lengths as texts that begin like it.
CANDIDATES = 1 << 14
# Positions are looked up by beginnings of these lengths.
BEGINNINGS = (1, 4, 16, PAGE_TIERS[-1])
# Stands between pages; the match form has no line breaks.
PAGE_END = "\n"

_BASE = 0x9E3779B97F4A7C15
_GROUP, _LENGTH, _MIX = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_FILTER_BITS = 20

_powers: dict[str, np.ndarray] = {}


def found_pages(marks: DataFrame, pages: DataFrame, pages_together: int) -> DataFrame:
    """(document_id, key, page_number) of ``marks`` (document_id, key, mark) found on a page:
    the first with the longest of the prefixes of ``PAGE_TIERS``, pages counted from 1."""
    part = F.floor((F.col("page_number") - 1) / pages_together).cast("int")
    texts = pages.select(
        "document_id", part.alias("part"), "page_number", match_form(F.col("page_text")).alias("text")
    ).where(F.col("text") != "")
    several = small_side(
        pages.groupBy("document_id").agg(F.max(part).alias("last_part")).where("last_part > 0"),
        "documents-in-parts",
    )
    sought = (
        marks.where(F.col("mark") != "")
        .join(several, "document_id", "left")
        .select(
            "document_id",
            F.explode(F.sequence(F.lit(0), F.coalesce("last_part", F.lit(0)))).alias("part"),
            F.col("key"),
            F.substring("mark", 1, PAGE_TIERS[0]).alias("text"),
        )
    )
    key_type = marks.schema["key"].dataType
    met = sought.withColumn("page_number", F.lit(None).cast("int")).unionByName(
        texts.withColumn("page_number", F.col("page_number").cast("int")).withColumn(
            "key", F.lit(None).cast(key_type)
        )
    )
    schema = T.StructType(
        [
            T.StructField("document_id", T.StringType()),
            T.StructField("key", key_type),
            T.StructField("tier", T.IntegerType()),
            T.StructField("page_number", T.IntegerType()),
        ]
    )
    found = (
        by_key(met, "document_id", "part")
        .sortWithinPartitions("document_id", "part", F.asc_nulls_first("page_number"))
        .mapInArrow(search, schema)
    )
    return found.groupBy("document_id", "key").agg(
        F.min(F.struct("tier", "page_number"))["page_number"].alias("page_number")
    )


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document_id, key, tier, page_number) for each better prefix of a mark, in the order of
    pages.  The rows of a document's part come together, marks first."""
    held = _Held()
    current = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in ("document_id", "part", "page_number", "text")]
        keys = batch.column(batch.schema.get_field_index("key"))
        for at, row in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if current != row[:2]:
                if held.chars >= SLICE_CHARS:
                    yield from held.found()
                    held = _Held()
                current = row[:2]
                held.open_group()
            if row[2] is None:
                held.add_mark(row[0], row[3], keys, at)
            else:
                held.add_page(row[2], row[3])
                if held.chars >= SLICE_CHARS:
                    yield from held.found()
                    held = held.rest()
    yield from held.found()


class _Held:
    """Marks and pages of some parts of documents."""

    def __init__(self) -> None:
        self.group = -1
        self.marks: list[tuple] = []  # group, document, text, column of keys, row in it, tier so far
        self.pages: list[tuple] = []  # group, number, text
        self.chars = 0

    def open_group(self) -> None:
        self.group += 1

    def add_mark(self, document: str, text: str, keys: pa.Array, at: int) -> None:
        self.marks.append((self.group, document, text, keys, at, len(PAGE_TIERS)))

    def add_page(self, number: int, text: str) -> None:
        self.pages.append((self.group, number, text))
        self.chars += len(text) + 1

    def rest(self) -> _Held:
        """What the pages to come of the open group are searched for."""
        left = _Held()
        left.group = 0
        left.marks = [(0, *m[1:]) for m in self.marks if m[0] == self.group and m[5] > 0]
        return left

    def found(self) -> Iterator[pa.RecordBatch]:
        if not self.marks or not self.pages:
            return
        ids: dict[tuple[int, str], int] = {}
        tiers = [
            [ids.setdefault((m[0], m[2][:n]), len(ids)) for n in PAGE_TIERS[: m[5]]] for m in self.marks
        ]
        at = first_positions([g for g, _ in ids], [p for _, p in ids], self.pages)
        ends = np.cumsum([len(p[2]) + 1 for p in self.pages])
        page = np.searchsorted(ends, at, "right")
        rows = []
        for i, own in enumerate(tiers):
            tier = next((k for k, p in enumerate(own) if at[p] < ends[-1]), None)
            if tier is not None:
                mark = self.marks[i]
                rows.append((mark[1], mark[3], mark[4], tier, self.pages[page[own[tier]]][1]))
                self.marks[i] = (*mark[:5], tier)
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    taken, begin = [], 0
    for end in range(1, len(rows) + 1):
        if end == len(rows) or rows[end][1] is not rows[begin][1]:
            taken.append(rows[begin][1].take(pa.array([r[2] for r in rows[begin:end]])))
            begin = end
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()),
            pa.concat_arrays(taken),
            pa.array([r[3] for r in rows], pa.int32()),
            pa.array([r[4] for r in rows], pa.int32()),
        ],
        names=["document_id", "key", "tier", "page_number"],
    )


def first_positions(groups: list[int], texts: list[str], pages: list[tuple]) -> np.ndarray:
    """Where each text first occurs among the joined pages of its group; the length of all
    joined pages if it does not.  ``pages`` are (group, number, text), by group."""
    joined = PAGE_END.join(p[2] for p in pages) + PAGE_END
    sizes = np.array([len(p[2]) + 1 for p in pages])
    group_of = np.repeat(np.array([p[0] for p in pages], np.uint64), sizes)
    total = len(joined)
    hashes = _Hashes(joined)
    sought = _Hashes("".join(texts))
    length = np.array([len(t) for t in texts])
    offset = np.cumsum(length) - length
    group = np.array(groups, np.uint64)
    whole = sought.at(offset, length, group)
    first = np.full(len(texts), total)
    for k, above in zip(BEGINNINGS, (*BEGINNINGS[1:], None), strict=True):
        own = np.flatnonzero((length >= k) & (length < above if above else True))
        if not len(own) or total < k:
            continue
        begins = sought.at(offset[own], k, group[own])
        starts, start_of = np.unique(begins, return_inverse=True)
        pairs = np.unique(np.stack([start_of, length[own]]), axis=1)
        many = np.bincount(pairs[0], minlength=len(starts))
        first_pair = np.cumsum(many) - many
        order = own[np.argsort(whole[own], kind="stable")]
        ranked = whole[order]
        every = hashes.at(np.arange(total - k + 1), k, group_of[: total - k + 1])
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[starts >> np.uint64(64 - _FILTER_BITS)] = True
        where = np.flatnonzero(seen[every >> np.uint64(64 - _FILTER_BITS)])
        for i in range(0, len(where), CANDIDATES):
            at = where[i : i + CANDIDATES]
            start = np.minimum(np.searchsorted(starts, every[at]), len(starts) - 1)
            same = starts[start] == every[at]
            at, start = at[same], start[same]
            # Each candidate with each length of a text that begins like it.
            n_pairs = many[start]
            pair = np.repeat(first_pair[start] - np.cumsum(n_pairs) + n_pairs, n_pairs) + np.arange(n_pairs.sum())
            at, size = np.repeat(at, n_pairs), pairs[1][pair]
            inside = at + size <= total
            at, size = at[inside], size[inside]
            full = hashes.at(at, size, group_of[at])
            rank = np.minimum(np.searchsorted(ranked, full), len(ranked) - 1)
            same = ranked[rank] == full
            np.minimum.at(first, order[rank[same]], at[same])
    # What only hashes alike, there or among the sought, is searched for as text.
    _, like, many = np.unique(whole, return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    of = np.array([p[0] for p in pages])
    for i, at in enumerate(first.tolist()):
        text = texts[i]
        if many[like[i]] > 1 or at < total and (joined[at : at + len(text)] != text or group_of[at] != groups[i]):
            own = np.flatnonzero(of == groups[i])
            at = joined.find(text, int(ends[own[0]] - sizes[own[0]]), int(ends[own[-1]])) if len(own) else -1
            first[i] = total if at < 0 else at
    return first


class _Hashes:
    """Hashes of the parts of a text, that do not depend on where a part lies."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        # Codes from 1, as characters of code 0 would not count.
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power("up", len(codes)), out=self.sums[1:])
        self.back = _power("down", len(codes) + 1)

    def at(self, begin: np.ndarray, length: np.ndarray | int, group: np.ndarray) -> np.ndarray:
        out = (self.sums[begin + length] - self.sums[begin]) * self.back[begin]
        out += group * _GROUP + np.asarray(length).astype(np.uint64) * _LENGTH
        out *= _MIX
        return (out ^ (out >> np.uint64(32))) * _MIX


def _power(kind: str, count: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < count:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(count, SLICE_CHARS + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:count]
