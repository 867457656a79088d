from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexweave.llm import fill_middle as fm
from lexweave.llm.tables import table

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, digests=True):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, output = "psm", f"<P>{p}<S>{s}<M>{m}"
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, output = "plain", text
    elif h[3] % 100 < 20:
        form, output = "spm", f"<S>{s}<P>{p}<M>{m}"
    facts = (len(units), form, *((None, None) if form == "plain" else (len(p), len(m))))
    return (doc_id, *facts, *((sha(output), sha(text)) if digests else (output,)))


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    parts = ["word", "A", "z", " ", "\n", "é", "日本", "👍", "<", ">", "<P", "S>", "M", "\x00", "á", "123", "{", "@", "[", "`"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(30)))) for i in range(500)]
    rows += [(i, t) for i in range(600, 606) for t in ("a <P> b", "<S>", "x<M>", "<<P", "M>", "", None)]
    rows += [(700, "same text"), (700, "same text"), (700, "same text"), (700, "other text")]
    rows += [(None, "no id"), (None, "no id"), (None, None), (None, ""), (None, "")]
    rows += [(i, text) for i in range(800, 810) for text in ("long " * 60_000, "x" * 300_000, "é" * 100_000 + "y")]
    return rows, spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, position int, piece string").repartition(5)


def test_digests_match_brute_force(odd):
    rows, df = odd
    assert ordered(fm.digests(fm.cut_pieces(df)).collect()) == ordered(brute(*r) for r in rows)


def test_small_pieces_cut_marks(odd, monkeypatch):
    monkeypatch.setattr(fm, "PIECE_BYTES", 2)
    rows, df = odd
    few = df.where(F.length("text") < 1000)
    wanted = [r for r in rows if r[1] is not None and len(r[1]) < 1000]
    assert ordered(fm.digests(fm.cut_pieces(few)).collect()) == ordered(brute(*r) for r in wanted)


def test_parts_of_pieces_cut_anywhere():
    parts = {"P": "pre <fix", "S": "<su<ffix<", "M": "mid<dle>"}
    for form in ("psm", "spm"):
        output = "".join(f"<{m}>{parts[m]}" for m in form.upper()).encode()
        for size in range(1, 12):
            reader, found = fm.Parts(form), ["", "", ""]
            steps = [list(reader.feed(output[i : i + size])) for i in range(0, len(output), size)]
            for part, piece in [x for step in [*steps, list(reader.end())] for x in step]:
                found[part] += piece.decode()
            assert found == [parts["P"], parts["M"], parts["S"]]


def test_outputs_and_restored_text(odd):
    rows, df = odd
    out = fm.outputs(fm.cut_pieces(df))
    assert ordered(out.collect()) == ordered(brute(*r, digests=False) for r in rows)
    back = out.select("doc_id", fm.restored_text(F.col("output"), F.col("form")).alias("t"))
    assert ordered(back.collect()) == ordered((i, t or "") for i, t in rows)


def test_pieces_are_small_and_shuffled_once(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pieces = fm.cut_pieces(docs)
    assert pieces.agg(F.max(F.length("piece"))).collect()[0][0] <= 2 * fm.PIECE_BYTES
    plan = fm.digests(pieces)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert ordered(fm.digests(pieces).collect()) == ordered(brute(r.doc_id, r.text) for r in docs.collect())
    assert fm.digests(fm.cut_pieces(docs.limit(0))).count() == 0
