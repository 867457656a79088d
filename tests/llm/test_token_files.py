from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexweave.llm import token_files as tf
from lexweave.llm.tables import table
from lexweave.llm.vocabulary import kept_in_worker
from lexweave.storage import new_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_text_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_runs_encode_as_whole_texts_do():
    rng = random.Random(2)
    odd = ["a", "É", "é", " ", "\n", "\t", " ", " ", "\x0b", "\x0c", "\x01", "\x1c", "\x85", "'s", "'", "12", "٣", "ß", "Σ", "İ", "<|endoftext|>", "日本", "👍🏽", "‍", "ﬁ", ".", "!?"]
    texts = ["".join(rng.choices(odd, k=rng.randrange(30))) for _ in range(600)]
    got = tf.encoder(PATH)(texts)
    assert [x.tolist() for x in got] == whole_text_ids(texts)


def test_capitals_that_compose_only_as_small_letters():
    marks = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    texts = [f"{x}ala X" for x in marks] + [f"AB{x[0]}\u0323{x[1]} CD" for x in marks] + [f"É L’Été {x}, Ab." for x in marks]
    assert [x.tolist() for x in tf.encoder(PATH)(texts)] == whole_text_ids(texts)


def test_added_tokens_are_found_as_the_library_finds_them():
    texts = ["hello <|endoftext|> world", "<|startoftext|>A b.", "a<|endoftext|>b, c", "<|ENDOFTEXT|> x", "J\u030c <|endoftext|> <|endoftext|>", "<|endoftext|", "<| endoftext |>"]
    got = [x.tolist() for x in tf.encoder(PATH)(texts)]
    assert got == whole_text_ids(texts) and got[0] == [3306, 49407, 1002]


def expected(rows):
    ids = [[*x, 1] for x in whole_text_ids([t for _, t in rows])]
    out, start = [], 0
    for (doc_id, _), x in zip(rows, ids, strict=True):
        out.append((doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def test_documents_from_the_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = tf.token_digests(docs, PATH, length=32).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_odd_rows(spark):
    rows = [(3, "b"), (1, None), (2, ""), (2, "a"), (7, "long " * 70_000), (4, " ")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(None, "last", 0)], "doc_id long, text string, start int")
    got = tf.token_digests(df, PATH).orderBy("start").collect()
    rest = [(3, "b"), (4, " "), (7, "long " * 70_000), (None, "last")]
    either = [expected([(1, None), *two, *rest]) for two in ([(2, ""), (2, "a")], [(2, "a"), (2, "")])]
    assert list(map(tuple, got)) in either
    assert tf.token_digests(df.limit(0), PATH).count() == 0


def test_sequences_and_masks(spark):
    folder = new_dir(spark, "files")
    df = spark.createDataFrame([(i, "one two three " * (i % 40)) for i in range(200)], "doc_id long, text string")
    shards = tf.write_token_files(df, folder, PATH, length=16).collect()
    stream = [x for t in whole_text_ids([r.text for r in df.orderBy("doc_id").collect()]) for x in [*t, 1]]
    assert sum(s.tokens for s in shards) == len(stream)
    for s in shards:
        shard, n = tf.Shard(folder, s.shard), -(-s.tokens // 16)
        if not s.tokens:
            continue
        ids, masks = zip(*(shard.sequence(i) for i in range(n)), strict=True)
        ids, masks = np.concatenate(ids), np.concatenate(masks)
        assert ids[: s.tokens].tolist() == stream[s.base : s.base + s.tokens]
        assert masks.sum() == s.tokens and masks[: s.tokens].all()


def test_a_worker_keeps_what_one_run_made():
    made = []

    def make():
        made.append(len(made))
        return made[-1]

    assert [kept_in_worker(run, make) for run in ("a", "a", "b", "a")] == [0, 0, 1, 2]
