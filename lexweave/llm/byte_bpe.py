"""Byte-level BPE by prefix dynamic programming.

Text is cut by a pattern; each match is encoded by itself.  Of every prefix of a match's
bytes the encoding ends in one certain token, and two tokens may stand next to each other
in an encoding exactly if their own bytes are encoded as those two.  So the last token of a
prefix is the one token ending there that may follow the last token of the prefix before
it.  The table of last tokens serves all prefixes: appending bytes adds entries and changes
none, and after an edit entries are recomputed only until they agree with the old ones over
the length of the longest token.

A null text counts as empty and has no ids; ids decode to bytes, which are valid UTF-8 for
whole encodings.  Repeated rows and ids stay as they are; other columns pass through, but
those named as a result column give way.  No limit on the length of a text or a match.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexweave.llm.tables import passing, record
from lexweave.llm.vocabulary import GROUP_CHARS, Spellings, found_in, kept_in_worker

NEVER = 1 << 40
SPACE = regex.compile(r"\s")


def split_of(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge makes ``token``: its bytes merged by lower ranks only."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        merged = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
        best = min(merged)
        if best >= rank:
            return None
        at = merged.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None


class Ranks:
    """Tokens with their ids, which are also the order of merges, and their splits."""

    def __init__(self, ranks: dict[bytes, int], splits: dict[int, tuple[int, int]] | None = None):
        if not {bytes([b]) for b in range(256)} <= ranks.keys():
            raise ValueError("not every byte is a token")
        self.ids = ranks
        self.longest = max(map(len, ranks))
        self.split = splits or {
            rank: split_of(token, rank, ranks) for token, rank in ranks.items() if len(token) > 1
        }
        if None in self.split.values():
            raise ValueError("a token is no merge of two tokens of lower rank")
        self.merge = {parts: rank for rank, parts in self.split.items()}

    @classmethod
    def load(cls, path: str) -> Ranks:
        """From a file of lines ``base64(token) rank``."""
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def plain(self) -> tuple[dict, dict]:
        """What makes an equal one, as values that workers read without this module."""
        return self.ids, self.split

    def spelled(self) -> pa.Array:
        """Token bytes by id; ids without a token are null."""
        out: list[bytes | None] = [None] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            out[rank] = token
        return pa.array(out, pa.binary())


class Encoder:
    """Encodes matches; keeps which tokens may follow which."""

    def __init__(self, ranks: Ranks):
        self.ids, self.longest = ranks.ids, ranks.longest
        self.split, self.merge = ranks.split, ranks.merge
        self.length = [0] * (max(ranks.ids.values()) + 1)
        for token, rank in ranks.ids.items():
            self.length[rank] = len(token)
        self.known: dict[tuple[int, int], bool] = {}
        # Over characters 0 to 255, one for each byte.
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.ids.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token at one of its ends from the byte up, each with the rank of
        the merge that takes it in."""
        out, taken_at = [], NEVER
        while True:
            out.append((token, taken_at))
            if token not in self.split:
                return out[::-1]
            token, taken_at = self.split[token][side], token

    def _follows(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together are encoded as these two: at no
        time does a merge across the border come before the merges within them."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = left[i], right[j]
            across = self.merge.get((x, y), NEVER)
            # Of equal merges the leftmost is first: that within ``a``, but not that within ``b``.
            if across < NEVER and across < x_taken and across <= y_taken:
                return False
            if x_taken == y_taken == NEVER:
                return True
            if x_taken < y_taken:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes | bytearray, last: list[int], end: int) -> None:
        """Add to ``last`` the last token of every prefix up to ``end``."""
        length, known = self.length, self.known
        first = max(0, len(last) - self.longest + 1)
        for at, token in self.automaton.iter(data[first:end].decode("latin-1")):
            at += first
            if at < len(last):
                continue
            before = at - length[token]
            if before >= 0:
                pair = last[before], token
                answer = known.get(pair)
                if answer is None:
                    answer = known[pair] = self._follows(*pair)
                if not answer:
                    continue
            last.append(token)

    def encode(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        return [whole] if whole is not None else Prefixes(self, data).tokens()


class Prefixes:
    """The last token of every prefix of some bytes."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder = encoder
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; no earlier entry changes."""
        self.data += more
        self.encoder.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in the place of ``data[start:stop]``; the number of entries computed.

        An entry depends on as many bytes and entries before it as the longest token has,
        so once that many agree beyond the edit, all later ones do.
        """
        old, window = self.last[stop:], self.encoder.longest
        self.data[start:stop] = new
        del self.last[start:]
        edited = start + len(new)
        while len(self.last) < len(self.data):
            end = min(len(self.data), max(edited, len(self.last)) + window)
            self.encoder.extend(self.data, self.last, end)
            if end - edited >= window and self.last[-window:] == old[: end - edited][-window:]:
                self.last += old[end - edited :]
                return end - start
        return len(self.data) - start

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of ``data[:end]``, found backwards from its last token."""
        end = len(self.data) if end is None else end
        out = []
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= self.encoder.length[token]
        return out[::-1]


class TextEncoder:
    """Ids of texts; each distinct match is encoded once."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.encoder = Encoder(ranks)
        self.pattern = regex.compile(pattern)
        self.table = Spellings(self._spell)

    def _spell(self, matches: list[str]) -> list[np.ndarray]:
        encode = self.encoder.encode
        return [np.array(encode(m.encode()), np.int32) for m in matches]

    def of_each(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.table.of_each([found_in(self.pattern, t) if t else [] for t in texts])

    def again(self, before: str, ids: np.ndarray, after: str) -> tuple[np.ndarray, int]:
        """Ids of ``after`` from those of ``before``, and how many of them are taken over.

        A match ends wherever white space follows something else, whatever the rest of the
        text is.  So only the part between the nearest such places around the edit is
        encoded again.
        """
        head = _common(before, after)
        tail = _common(before[head:][::-1], after[head:][::-1])
        start = _border(before, range(head - 1, 0, -1))
        stop = len(before) - tail
        end = _border(before, range(stop + 1, len(before)))
        end = len(before) if end is None else end
        start = start or 0
        length = self.encoder.length
        ends = np.cumsum([length[i] for i in ids.tolist()])
        first = int(np.searchsorted(ends, len(before[:start].encode()), side="right"))
        last = int(np.searchsorted(ends, len(before[:end].encode()), side="right"))
        middle = self.of_each([after[start : end + len(after) - len(before)]])[0]
        return np.concatenate([ids[:first], middle, ids[last:]]).astype(np.int32), (
            first + len(ids) - last
        )


def _common(a: str, b: str) -> int:
    """Length of the longest common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _border(text: str, places: range) -> int | None:
    """The first of the places with white space after it and something else before it."""
    for i in places:
        if SPACE.match(text, i) and not SPACE.match(text, i - 1):
            return i
    return None


IDS = T.ArrayType(T.IntegerType())


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *ids])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _text_groups(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of rows of a limited number of bytes together."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // GROUP_CHARS
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield a, column.slice(a, b - a).to_pylist()


def _encoded(batches, encoder: TextEncoder, text_col: str) -> Iterator[pa.RecordBatch]:
    """Batches with ``ids`` behind their columns."""
    for batch in batches:
        for start, texts in _text_groups(batch.column(text_col)):
            ids = _lists(encoder.of_each(texts))
            part = batch.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])


def _decoded(lists: pa.Array, tokens: pa.Array) -> pa.Array:
    """The bytes of lists of ids."""
    values = tokens.take(lists.flatten())
    if values.null_count:
        raise ValueError("an id without a token")
    size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = at[np.concatenate(([0], np.cumsum(count)))]
    data = values.buffers()[2] or pa.py_buffer(b"")
    out = pa.Array.from_buffers(
        pa.large_binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), data]
    )
    return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.large_binary()))


def encode_rows(
    df: DataFrame,
    path: str,
    pattern: str,
    text_col: str = "text",
    keep: list[str] | None = None,
    decoded: bool = False,
) -> DataFrame:
    """The rows with their ``ids``, by the rank file ``path``; ``keep`` names the columns
    to return.  With ``decoded`` also the bytes that the ids decode to, as ``decode_rows``
    gives them, without a second way through Python."""
    context, run = df.sparkSession.sparkContext, uuid.uuid4().hex
    shared = context.broadcast(Ranks.load(path).plain())
    added = [T.StructField("ids", IDS)]
    if decoded:
        added.append(T.StructField("decoded", T.BinaryType()))
    chosen, names, schema = passing(df, keep, added, [text_col])
    arrow = to_arrow_schema(schema)

    def encode(batches):
        encoder = kept_in_worker(run, lambda: TextEncoder(Ranks(*shared.value), pattern))
        tokens = Ranks(*shared.value).spelled() if decoded else None
        for batch in _encoded(batches, encoder, text_col):
            new = [batch.column(batch.num_columns - 1)]
            if decoded:
                new.append(_decoded(new[0], tokens))
            yield record(batch, names, new, arrow)

    return chosen.mapInArrow(encode, schema)


def decode_rows(
    df: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None
) -> DataFrame:
    """The rows with the bytes of their ids as ``decoded``; null ids give null, an unknown
    or null id ends the job."""
    shared = df.sparkSession.sparkContext.broadcast(Ranks.load(path).spelled())
    added = [T.StructField("decoded", T.BinaryType())]
    chosen, names, schema = passing(df, keep, added, [ids_col])
    arrow = to_arrow_schema(schema)

    def decode(batches):
        for batch in batches:
            yield record(batch, names, [_decoded(batch.column(ids_col), shared.value)], arrow)

    return chosen.mapInArrow(decode, schema)


def reencode_rows(
    df: DataFrame,
    path: str,
    pattern: str,
    before: str = "text",
    ids_col: str = "ids",
    after: str = "edited",
) -> DataFrame:
    """The rows with ``edited_ids``, those of the edited text, and ``reused``, the number
    of them taken over from the ids of the text before.

    ``pattern`` must end a match where white space follows something else.  Null texts
    count as empty, and rows without ids are encoded anew.
    """
    context, run = df.sparkSession.sparkContext, uuid.uuid4().hex
    shared = context.broadcast(Ranks.load(path).plain())
    added = [T.StructField("edited_ids", IDS), T.StructField("reused", T.LongType())]
    chosen, names, schema = passing(df, None, added, [before, ids_col, after])
    arrow = to_arrow_schema(schema)

    def encoded(batches):
        encoder = kept_in_worker(run, lambda: TextEncoder(Ranks(*shared.value), pattern))
        for batch in batches:
            ids, reused = [], []
            for old, old_ids, new in zip(
                batch.column(before).to_pylist(),
                batch.column(ids_col),
                batch.column(after).to_pylist(),
                strict=True,
            ):
                if old_ids.is_valid:
                    known = old_ids.values.to_numpy(zero_copy_only=False)
                    found, taken = encoder.again(old or "", known, new or "")
                else:
                    found, taken = encoder.of_each([new])[0], 0
                ids.append(found)
                reused.append(taken)
            yield record(batch, names, [_lists(ids), pa.array(reused, pa.int64())], arrow)

    return chosen.mapInArrow(encoded, schema)
