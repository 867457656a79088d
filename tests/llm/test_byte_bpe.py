from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lexweave.llm import byte_bpe as bb
from lexweave.llm import queries
from lexweave.llm.tables import table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PARTS = ["the", "in", "ing", "a", " ", "  ", "\n", "\t", "é", "日本語", "👍", "\x00", "'s", "'re", "XYZ", "1234", "²", "٣", "aaaa", " ", "\x1c", "\xa0", ".", "--", "Привет", "́"]


@pytest.fixture(scope="module")
def ranks():
    return bb.Ranks.load(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def odd_texts(n, seed=3, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(longest))) for _ in range(n)]


def test_texts_match_the_library(ranks, library, spark, sf_dir):
    texts = odd_texts(2000) + [r.text for r in table(spark, sf_dir, "documents").collect()]
    encoder = bb.TextEncoder(ranks, PATTERN)
    for text, ids in zip(texts, encoder.of_each(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text


def test_every_character_matches_the_library(ranks, library):
    encoder = bb.TextEncoder(ranks, PATTERN)
    characters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b 1{c}2 {c}{c}" for c in characters[i : i + 256]) for i in range(0, len(characters), 256)]
    assert [x.tolist() for x in encoder.of_each(texts)] == [library.encode_ordinary(t) for t in texts]


def merged(data, ids):
    """The definition: merge the leftmost pair of the lowest rank until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        pairs = [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]  # noqa: B905
        if not pairs:
            return [ids[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_one_table_serves_every_prefix(ranks):
    encoder = bb.Encoder(ranks)
    for data in (b"aaaaaaaaaaaaaaab", "нетребовательность".encode(), bytes(random.Random(1).choices(range(256), k=80))):
        prefixes = bb.Prefixes(encoder)
        for i in range(len(data)):
            prefixes.append(data[i : i + 1])
        for end in range(len(data) + 1):
            assert prefixes.tokens(end) == merged(data[:end], ranks.ids)


def test_edits_of_a_long_match_stay_near(ranks):
    encoder, rng = bb.Encoder(ranks), random.Random(2)
    data = "".join(rng.choices("abcdeiounst", k=4000)).encode()
    prefixes = bb.Prefixes(encoder, data)
    for _ in range(30):
        start = rng.randrange(len(data))
        stop = min(len(data), start + rng.randrange(5))
        new = "".join(rng.choices("abceinst", k=rng.randrange(5))).encode()
        data = data[:start] + new + data[stop:]
        assert prefixes.replace(start, stop, new) < 600
        assert bytes(prefixes.data) == data and len(prefixes.last) == len(data)
        assert prefixes.tokens() == bb.Prefixes(encoder, data).tokens()


def test_edited_rows_take_over_what_is_far_from_the_edit(spark, ranks, library):
    rng = random.Random(5)
    rows = []
    for i, text in enumerate(odd_texts(400, seed=7, longest=120)):
        a = rng.randrange(len(text) + 1)
        b = min(len(text), a + rng.randrange(6))
        rows.append((i, text, text[:a] + "".join(rng.choices(PARTS, k=rng.randrange(3))) + text[b:]))
    long = "some words here " * 5000
    rows += [(900, long, long[:40_000] + "X" + long[40_000:]), (901, long, long), (902, None, "new"), (903, "old", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edited string")
    encoded = bb.encode_rows(df, PATH, PATTERN)
    got = {r.doc_id: r for r in bb.reencode_rows(encoded, PATH, PATTERN).collect()}
    for i, _, edited in rows:
        assert got[i].edited_ids == library.encode_ordinary(edited or ""), rows[i : i + 1]
    assert all(got[i].reused > len(got[i].ids) - 5 for i in (900, 901))


def test_rows(spark, library):
    rows = [(1, None, 7), (2, "", 7), (3, " two  blanks ", 7), (3, " two  blanks ", 7), (None, "word " * 300_000, 7), (4, "x" * 100_000 + " " * 50_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = bb.encode_rows(df, PATH, PATTERN)
    assert encoded.columns == ["doc_id", "text", "ids"]
    back = bb.decode_rows(encoded, PATH).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    both = bb.encode_rows(df, PATH, PATTERN, keep=["doc_id"], decoded=True)
    key = lambda r: (r.doc_id or 0, len(r.ids))
    assert [(r.ids, r.decoded) for r in sorted(both.collect(), key=key)] == [(r.ids, r.decoded) for r in sorted(back, key=key)]
    odd = spark.createDataFrame([([104, 105],), ([],), (None,)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in bb.decode_rows(odd, PATH).collect()] == [library.decode_bytes([104, 105]), b"", None]
    empty = bb.encode_rows(df.limit(0), PATH, PATTERN)
    assert bb.decode_rows(empty, PATH).count() == 0
    with pytest.raises(Exception, match="out of bounds"):
        bb.decode_rows(spark.createDataFrame([([60_000],)], "ids array<int>"), PATH).collect()


def test_query_matches_the_library(spark, sf_dir, library):
    got = queries.QUERIES["op11_byte_bpe"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for r in table(spark, sf_dir, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (r.text or "").encode())]
        want.append((r.doc_id, len(ids), *digests))
    assert sorted(map(tuple, got.collect())) == sorted(want)
