"""SentencePiece encoding by Unigram Viterbi over a double-array trie, and decoding.

A text becomes a marked string: U+2581 in front and for every blank (U+0020).  Of all ways
to cut it into pieces the one with the largest sum of scores is taken; of equal ones that
whose last piece is longest.  A character that is no piece of its own may stand alone at
``UNKNOWN_PENALTY`` below the lowest score and is spelled in byte pieces.

No piece has a marker behind another character, and a character that no piece contains is
always alone.  Cutting there loses nothing, so each distinct unit between such places is
encoded once; within a batch of units all positions are matched and scored together.

Null and empty texts have no pieces.  Decoding gives the text back, byte for byte; only a
U+2581 in a text comes back as a blank, as it means one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexweave.llm.vocabulary import Spellings, found_in, groups

MARK = "▁"
UNKNOWN_PENALTY = 10.0
UNKNOWN = -1
UNITS_AT_ONCE = 20_000


class DoubleArrayTrie:
    """A byte trie in two arrays: the child of node n by byte b is slot ``base[n] + b + 1``,
    if ``check`` of that slot is n.  ``value`` is the key's number, or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1 << 16
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        todo, free = [(0, 0, len(keys), 0)], 1
        while todo:
            node, low, high, depth = todo.pop()
            if low < high and len(keys[low]) == depth:
                self.value[node] = values[low]
                low += 1
            children = []
            while low < high:
                byte, end = keys[low][depth], low
                while end < high and keys[end][depth] == byte:
                    end += 1
                children.append((byte + 1, low, end))
                low = end
            if not children:
                continue
            free = used.find(0, free)
            slot = free
            while True:
                base = slot - children[0][0]
                if base + 258 >= len(used):
                    more = len(used)
                    used.extend(bytes(more))
                    self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
                    self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
                    self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])
                if base >= 0 and not any(used[base + c] for c, _, _ in children):
                    break
                slot = used.find(0, slot + 1)
                if slot < 0:
                    slot = len(used)
            self.base[node] = base
            for c, start, end in children:
                used[base + c] = 1
                self.check[base + c] = node
                todo.append((base + c, start, end, depth + 1))

    def matches(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray):
        """(start, end, value) of every key found at ``starts``, none beyond its limit."""
        found = []
        at, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)
        depth = 0
        while True:
            inside = starts[at] + depth < limits[at]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            slot = self.base[node].astype(np.int64) + data[starts[at] + depth] + 1
            go = self.check[slot] == node
            at, node = at[go], slot[go]
            depth += 1
            ends = self.value[node] >= 0
            found.append((starts[at[ends]], starts[at[ends]] + depth, self.value[node[ends]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(3))


@dataclass
class Vocabulary:
    """Pieces with scores, and what is derived from them."""

    pieces: list[str]
    scores: np.ndarray
    plain: np.ndarray
    byte_ids: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The pieces of a model file; its byte pieces spell out unknown characters."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        byte_ids = np.full(256, -1, np.int32)
        plain = np.ones(n, bool)
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            plain[i] = not (
                model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            )
        if (byte_ids < 0).any():
            raise ValueError(f"{path} has no piece for some byte")
        return cls(pieces, np.array([model.get_score(i) for i in range(n)]), plain, byte_ids)

    def __post_init__(self):
        known = [i for i in range(len(self.pieces)) if self.plain[i]]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in known):
            raise ValueError("a piece has a marker behind another character")
        self.trie = DoubleArrayTrie([self.pieces[i].encode() for i in known], known)
        self.unknown_score = float(self.scores[self.plain].min()) - UNKNOWN_PENALTY
        inside = "".join(re.escape(c) for c in sorted({c for i in known for c in self.pieces[i]} - {MARK}))
        self.unit = re.compile(f"{MARK}*[{inside}]+|{MARK}+|.", re.DOTALL)
        spelled = [p.encode() if self.plain[i] else b"" for i, p in enumerate(self.pieces)]
        for byte, i in enumerate(self.byte_ids):
            spelled[i] = bytes([byte])
        self.spelled = spelled

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(units), UNITS_AT_ONCE):
            out += self._encode(units[i : i + UNITS_AT_ONCE])
        return out

    def _encode(self, units: list[str]) -> list[np.ndarray]:
        raw = [u.encode() for u in units]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(units)), size)
        # Character starts, and where each character ends.
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.append(starts[1:], len(data))
        begin, end, piece = self.trie.matches(data, starts, (first + size)[owner[starts]])
        char_end = np.zeros(len(data), np.int64)
        char_end[starts] = ends
        alone = np.zeros(len(data), bool)
        alone[begin[char_end[begin] == end]] = True
        rest = starts[~alone[starts]]
        begin, end = np.concatenate([begin, rest]), np.concatenate([end, char_end[rest]])
        score = np.concatenate([self.scores[piece], np.full(len(rest), self.unknown_score)])
        piece = np.concatenate([piece, np.full(len(rest), UNKNOWN)])
        # One node before each byte and one at the end of each unit.
        unit = owner[begin]
        source, target = begin + unit, end + unit
        order = np.lexsort((source, target, end - first[unit]))
        source, target, piece, score = source[order], target[order], piece[order], score[order]
        depth = (end - first[unit])[order]
        best = np.full(len(data) + len(units), -np.inf)
        best[first + np.arange(len(units))] = 0.0
        via = np.zeros(len(best), np.int64)
        cuts = np.append(np.flatnonzero(np.diff(depth, prepend=-1)), len(depth))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            value = best[source[a:b]] + score[a:b]
            heads = np.flatnonzero(np.diff(target[a:b], prepend=-1))
            top = np.maximum.reduceat(value, heads)
            best[target[a:b][heads]] = top
            equal = np.flatnonzero(value == np.repeat(top, np.diff(np.append(heads, b - a))))
            nodes, where = np.unique(target[a:b][equal], return_index=True)
            via[nodes] = a + equal[where]
        return self._path(units, data, first, size, source, target, piece, via)

    def _path(self, units, data, first, size, source, target, piece, via) -> list[np.ndarray]:
        here = first + size + np.arange(len(units))
        begin = first + np.arange(len(units))
        walked, who = [], np.arange(len(units))
        while True:
            open_ = here[who] > begin[who]
            who = who[open_]
            if not len(who):
                break
            edge = via[here[who]]
            walked.append((who, edge))
            here[who] = source[edge]
        if not walked:
            return [np.zeros(0, np.int32)] * len(units)
        unit = np.concatenate([w for w, _ in walked])
        edge = np.concatenate([e for _, e in walked])
        step = np.repeat(np.arange(len(walked)), [len(w) for w, _ in walked])
        order = np.lexsort((-step, unit))
        unit, edge = unit[order], edge[order]
        unknown = piece[edge] == UNKNOWN
        count = np.where(unknown, target[edge] - source[edge], 1)
        ids = np.repeat(piece[edge], count)
        spell = np.flatnonzero(np.repeat(unknown, count))
        within = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
        byte = np.repeat(source[edge] - unit, count) + within
        ids[spell] = self.byte_ids[data[byte[spell]]]
        total = np.bincount(unit, weights=count, minlength=len(units)).astype(np.int64)
        return np.split(ids.astype(np.int32), np.cumsum(total)[:-1])

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.spelled.__getitem__, ids))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encoder(vocabulary: Vocabulary):
    """A function from a list of texts to their arrays of piece ids."""
    table = Spellings(vocabulary.encode_units)

    def encode(texts: list[str | None]) -> list[np.ndarray]:
        return table.of_each(
            [found_in(vocabulary.unit, MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        )

    return encode


ADDED = T.StructType(
    [
        T.StructField("n_pieces", T.LongType()),
        T.StructField("pieces", T.ArrayType(T.IntegerType())),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def _encoded(batches, vocabulary: Vocabulary, kept: list[str], text: str, schema: pa.Schema):
    encode = encoder(vocabulary)
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for a, b in groups(texts):
            ids = encode(texts[a:b])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            same = [
                vocabulary.decode(x.tolist()) == (t or "")
                for x, t in zip(ids, texts[a:b], strict=True)
            ]
            columns = [batch.column(c).slice(a, b - a) for c in kept]
            added = [
                pa.array(np.diff(offsets), pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                pa.array(same, pa.bool_()),
            ]
            arrays = [x.cast(f.type) for x, f in zip(columns + added, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def encode_rows(
    df: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The rows with n_pieces, pieces and round_trip (decoding gives the text back).

    A column of ``df`` that has one of these names gives way.  ``keep`` names the columns
    to return.
    """
    vocabulary = Vocabulary.load(model_path)
    kept = [c for c in (keep or df.columns) if c not in ADDED.names]
    fields = [f for f in df.schema.fields if f.name in kept]
    schema = T.StructType(fields + ADDED.fields)
    arrow, encoded = to_arrow_schema(schema), _encoded
    names = [f.name for f in fields]
    chosen = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text_col])])
    return chosen.mapInArrow(
        lambda b: encoded(b, vocabulary, names, text_col, arrow), schema
    )


def decode_rows(df: DataFrame, model_path: str, pieces_col: str = "pieces") -> DataFrame:
    """The rows with the decoded text as ``decoded``; null pieces stay null."""
    vocabulary = Vocabulary.load(model_path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield ids.map(lambda x: None if x is None else vocabulary.decode(list(x)))

    return df.withColumn("decoded", decoded(F.col(f"`{pieces_col}`")))
