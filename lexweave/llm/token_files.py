"""Token ids in Arrow files of equal-length sequences with masks.

Documents are dealt to shards by ranges of their id, encoded in order and written as one
stream of ids, cut into sequences of ``length``.  A shard is an Arrow IPC file whose record
batches hold two fixed-size lists, ids and mask (0 for the padding after the last id), so
any sequence is found by its number and read without a copy.  Ids take two bytes where the
vocabulary fits into them.  A second file holds id,
start and number of ids of the shard's documents.  A task writes under a name of its own
and renames at the end: a repeated task replaces a file by an equal one.

White space ends every pre-token of the vocabulary and case does not count, so texts are
encoded by their distinct lower-case runs between blanks; a Python worker keeps them, in
bounded number, for all its tasks of one run.  A text that holds an added token of the
vocabulary is encoded as a whole, as the library does it.  Null texts are empty and hold the
end id only.  Rows without an id come last; rows that share an id are ordered by a hash of their
text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexweave.llm.tables import partitions
from lexweave.llm.vocabulary import Spellings, groups, kept_in_worker
from lexweave.storage import materialize, new_dir

LENGTH = 1024
BATCH_SEQUENCES = 256
END_ID = 1
# A comma or full stop behind a letter and before a blank is always a pre-token of its own.
STOP, CUT_STOP = r"([a-z])([.,])([ \n])", r"\1 \2\3"
# Lowering a capital before a character beyond ASCII could change what NFC composes: J and
# a caron stay two characters, j and a caron become one.
CAPITALS_BEFORE_OTHERS = r"[A-Z][^\x00-\x7F]"
CAPITALS = re.compile(r"[A-Z]+(?![^\x00-\x7f])")
# Texts encoded together have about so many characters.
TOGETHER_CHARS = 1 << 22
# A word that marks where a run ends when many are encoded as one text.
SEPARATOR = "\x01"
RUNS_TOGETHER = 2048


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def encoder(tokenizer_path: str):
    """A function from a list of texts to their arrays of ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(tokenizer_path)
    added = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]

    def ids(text: str) -> np.ndarray:
        (found,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, np.int32)

    comma = ids(SEPARATOR)
    if len(comma) != 1:
        raise ValueError(f"{tokenizer_path} does not spell the separator by one id")

    def spell(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many runs are one text, with a word of its own between them."""
        flat, lengths = [], []
        for k in range(0, len(runs), RUNS_TOGETHER):
            part = runs[k : k + RUNS_TOGETHER]
            stream = ids(f" {SEPARATOR} ".join(part))
            cuts = np.flatnonzero(stream == comma[0])
            if len(cuts) == len(part) - 1:
                flat.append(np.delete(stream, cuts))
                lengths.append(np.diff(cuts, prepend=-1, append=len(stream)) - 1)
                continue
            # A run holds the separator itself.
            for run in part:
                flat.append(ids(run))
                lengths.append([len(flat[-1])])
        return np.concatenate(flat), np.concatenate(lengths).astype(np.int64)

    table = Spellings(spell)

    def encode(texts: list[str | None]) -> list[np.ndarray]:
        # The vocabulary composes, then ignores case; a capital that nothing can compose with
        # is lowered at once, the tokenizer lowers the others.
        column = pa.array([t or "" for t in texts], pa.string())
        lowered = pc.ascii_lower(column)
        careful = pc.match_substring_regex(column, CAPITALS_BEFORE_OTHERS)
        if pc.any(careful).as_py():
            some = column.filter(careful).to_pylist()
            by_hand = [CAPITALS.sub(lambda m: m.group().lower(), t) for t in some]
            lowered = pc.replace_with_mask(lowered, careful, pa.array(by_hand, pa.string()))
        cut = pc.replace_substring_regex(lowered, STOP, CUT_STOP)
        out = table.of_lists(pc.ascii_split_whitespace(cut))
        # An added token is found in the text as it stands, before anything else.
        for token in added:
            for i in np.flatnonzero(pc.match_substring(lowered, token)):
                out[i] = ids(texts[i])
        return out

    return encode


def _types(length: int, narrow: bool) -> tuple[pa.Schema, pa.Schema]:
    ids = pa.uint16() if narrow else pa.uint32()
    return (
        pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))]),
        pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]),
    )


class ShardWriter:
    """Writes the two files of a shard; ``close`` puts them in place."""

    def __init__(self, folder: str, number: int, attempt: int, length: int, narrow: bool):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.length, self.schemas = length, _types(length, narrow)
        self.kind = np.uint16 if narrow else np.uint32
        self.names = [f"{root}/{kind}-{number:06d}.arrow" for kind in ("ids", "docs")]
        self.drafts = [f"{n}.{attempt}.draft" for n in self.names]
        self.files = [self.fs.open_output_stream(d) for d in self.drafts]
        self.writers = [
            pa.ipc.new_file(f, s) for f, s in zip(self.files, self.schemas, strict=True)
        ]
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.total = self.docs = 0

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> None:
        lengths = np.array([len(x) for x in ids], np.int64)
        starts = self.total + np.cumsum(lengths) - lengths
        arrays = [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths)]
        self.writers[1].write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schemas[1]))
        self.waiting += ids
        self.n_waiting += int(lengths.sum())
        self.total += int(lengths.sum())
        self.docs += len(ids)
        if self.n_waiting >= self.length * BATCH_SEQUENCES:
            self._write(False)

    def _write(self, last: bool) -> None:
        stream = np.concatenate([*self.waiting, np.zeros(0, np.int32)]).astype(self.kind)
        size = self.length * BATCH_SEQUENCES
        for start in range(0, len(stream), size):
            part = stream[start : start + size]
            if len(part) < size and not last:
                break
            mask = np.ones(len(part), bool)
            short = -len(part) % self.length
            part, mask = np.pad(part, (0, short)), np.pad(mask, (0, short))
            lists = [
                pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)
            ]
            self.writers[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schemas[0]))
        rest = stream[len(stream) - len(stream) % size :].astype(np.int32)
        self.waiting, self.n_waiting = [rest], len(rest)

    def close(self) -> tuple[int, int]:
        self._write(True)
        for writer, file in zip(self.writers, self.files, strict=True):
            writer.close()
            file.close()
        for draft, name in zip(self.drafts, self.names, strict=True):
            self.fs.move(draft, name)
        return self.docs, self.total


class Shard:
    """Reads a shard; sequences and documents are views of the mapped file where it is local."""

    def __init__(self, folder: str, number: int):
        fs, root = file_system(folder)
        local = isinstance(fs, arrow_fs.LocalFileSystem)

        def opened(kind):
            name = f"{root}/{kind}-{number:06d}.arrow"
            return pa.ipc.open_file(pa.memory_map(name) if local else fs.open_input_file(name))

        self.ids, self.index = opened("ids"), opened("docs")
        self.length = self.ids.schema.field("ids").type.list_size

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one sequence."""
        batch = self.ids.get_batch(number // BATCH_SEQUENCES)
        at = (number % BATCH_SEQUENCES) * self.length
        lists = [batch.column(c).flatten()[at : at + self.length] for c in ("ids", "mask")]
        return lists[0].to_numpy(), lists[1].to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, start, pieces of its ids) in order."""
        size, number, stream = self.length * BATCH_SEQUENCES, -1, None
        for k in range(self.index.num_record_batches):
            batch = self.index.get_batch(k)
            for doc_id, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces, at = [], start
                while at < start + n:
                    if at // size != number:
                        number = at // size
                        stream = self.ids.get_batch(number).column("ids").flatten().to_numpy()
                    end = min(start + n, (number + 1) * size)
                    pieces.append(stream[at - number * size : end - number * size])
                    at = end
                yield doc_id, start, pieces


def _write_shard(
    batches, folder, length, make_encoder, end_id, narrow
) -> Iterator[pa.RecordBatch]:
    encode, task = kept_in_worker(folder, make_encoder), TaskContext.get()
    number = task.partitionId()
    writer = ShardWriter(folder, number, task.taskAttemptId(), length, narrow)
    end = np.array([end_id], np.int32)
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in groups(texts, TOGETHER_CHARS):
            writer.add(ids[a:b], [np.concatenate([x, end]) for x in encode(texts[a:b])])
    docs, total = writer.close()
    yield pa.RecordBatch.from_arrays(
        [pa.array([x], pa.int64()) for x in (number, docs, total)],
        names=["shard", "docs", "tokens"],
    )


def write_token_files(
    df: DataFrame,
    folder: str,
    tokenizer_path: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents; returns the shards (shard, docs, tokens, base), written.

    ``base`` is the number of ids in the shards before.
    """
    spark = df.sparkSession
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    write, make = _write_shard, encoder
    narrow = max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size()) <= 1 << 16
    shards = materialize(
        docs.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order, "text")
        .mapInArrow(
            lambda b: write(b, folder, length, lambda: make(tokenizer_path), end_id, narrow),
            "shard long, docs long, tokens long",
        ),
        "shards",
    )
    # One row per shard, so one task can number them.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read_shards(batches, folder) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = []
            for doc_id, start, pieces in Shard(folder, number).documents():
                crc = 0
                for piece in pieces:
                    crc = zlib.crc32(piece.astype("<u4", copy=False).data, crc)
                rows.append((doc_id, base + start, sum(map(len, pieces)), crc))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    read = _read_shards
    return (
        shards.where("docs > 0")
        .select("shard", "base")
        .repartitionByRange(partitions(shards.sparkSession), "shard")
        .mapInArrow(
            lambda b: read(b, folder),
            "doc_id long, start long, n_tokens long, ids_crc32 long",
        )
    )


def token_digests(df: DataFrame, tokenizer_path: str, **settings) -> DataFrame:
    """Write the files to a new folder that all executors share, and read them back."""
    folder = new_dir(df.sparkSession, "token-files")
    return read_token_files(folder, write_token_files(df, folder, tokenizer_path, **settings))
