from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lexweave.llm import pieces as ps
from lexweave.llm.tables import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return ps.Vocabulary.load(PATH)


def brute(vocabulary, text):
    """Viterbi over the whole marked text, one character at a time."""
    if not text:
        return []
    known = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.plain[i]}
    longest = max(map(len, known))
    marked = ps.MARK + text.replace(" ", ps.MARK)
    best = [(0.0, 0, None)] + [None] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - longest), end):
            piece = marked[start:end]
            if piece in known:
                score, i = vocabulary.scores[known[piece]], known[piece]
            elif end - start == 1:
                score, i = vocabulary.unknown_score, None
            else:
                continue
            total = best[start][0] + score
            if best[end] is None or total > best[end][0]:
                best[end] = (total, start, i)
    out, at = [], len(marked)
    while at:
        _, start, i = best[at]
        out.append([i] if i is not None else vocabulary.byte_ids[list(marked[start:at].encode())].tolist())
        at = start
    return [i for part in reversed(out) for i in part]


def odd_texts(n=300):
    rng = random.Random(4)
    parts = ["the", "a", " ", "  ", "\n", "\t", "é", "日本語", "👍", "\u0000", "tion", "XYZ", "1234", "▁"[:0], "ѐ", "ß", ".", "    ", "ing ", " "]
    return ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(n)]


def test_matches_brute_force(vocabulary, spark, sf_dir):
    texts = odd_texts() + [r.text[:400] for r in table(spark, sf_dir, "documents").limit(40).collect()]
    for text, ids in zip(texts, ps.encoder(vocabulary)(texts), strict=True):
        assert ids.tolist() == brute(vocabulary, text), text
        assert vocabulary.decode(ids.tolist()) == text


def unigram_copy():
    """The model file as bytes, with its type set to Unigram (fixed field numbers)."""
    raw = bytearray(open(PATH, "rb").read())  # noqa: SIM115

    def number(at):
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        size, at = number(at)
        if tag >> 3 == 2:
            inner = at
            while inner < at + size:
                tag, inner = number(inner)
                if tag & 7 == 2:
                    length, inner = number(inner)
                    inner += length
                elif tag & 7 == 5:
                    inner += 4
                else:
                    if tag >> 3 == 3:
                        raw[inner] = 1
                    _, inner = number(inner)
        at += size
    return bytes(raw)


def test_matches_the_library(vocabulary, spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_proto=unigram_copy())
    # Short pieces of text without unknown characters: the library adds up in single
    # precision.  Its exact search is the one for the best few.
    parts = {x[:120] for r in table(spark, sf_dir, "documents").collect() for x in r.text.split("\n")}
    known = {c for i, p in enumerate(vocabulary.pieces) if vocabulary.plain[i] for c in p}
    texts = sorted(x for x in parts if x and "  " not in x and set(x) <= known | {" "})[:400]
    checked = 0
    for text, ids in zip(texts, ps.encoder(vocabulary)(texts), strict=True):
        best = model.nbest_encode_as_ids(text, 2)[0]
        if min(vocabulary.scores[i] for i in best) < -1e6:
            continue
        checked += 1
        assert sum(vocabulary.scores[i] for i in ids) == sum(vocabulary.scores[i] for i in best)
        assert model.decode(ids.tolist()) == text
    assert checked > 200


def test_trie_finds_all_prefixes():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zz"]
    trie = ps.DoubleArrayTrie(keys, list(range(len(keys))))
    data = np.frombuffer(b"abcab\xff\x00z", np.uint8)
    got = trie.matches(data, np.arange(len(data)), np.full(len(data), len(data)))
    want = {(i, i + len(k), n) for n, k in enumerate(keys) for i in range(len(data)) if data[i:].tobytes().startswith(k)}
    assert set(zip(*(x.tolist() for x in got), strict=True)) == want


def test_rows(spark, vocabulary):
    rows = [(1, None, 5), (2, "", 5), (3, " two  blanks ", 5), (3, "x" * 3000, 5), (None, "word " * 300_000, 5), (4, "a▁b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces int")
    encoded = ps.encode_rows(df, PATH)
    assert encoded.columns == ["doc_id", "text", "n_pieces", "pieces", "round_trip"]
    back = ps.decode_rows(encoded, PATH).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.n_pieces == len(r.pieces) and r.decoded == (r.text or "").replace("▁", " ")
        assert r.round_trip == ("▁" not in (r.text or ""))
    assert ps.encode_rows(df.limit(0), PATH).count() == 0
