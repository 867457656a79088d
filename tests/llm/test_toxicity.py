from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from lexweave.llm import string_kernel as sk
from lexweave.llm import toxicity
from lexweave.llm.queries import op8_toxicity
from lexweave.llm.tables import table


def weights(s):
    out = {}
    for at in combinations(range(len(s)), sk.LENGTH):
        u = tuple(s[i] for i in at)
        out[u] = out.get(u, 0) + sk.DECAY ** (at[-1] - at[0] + 1)
    return out


def test_kernel_is_the_sum_over_common_subsequences():
    pairs = [("moron", "morxon"), ("abcabc", "cbacba"), ("aaaa", "aaaaaa"), ("abc", "xyz")]
    for a, b in pairs:
        wa, wb = weights(sk.encode([a])[0].tolist()), weights(sk.encode([b])[0].tolist())
        want = sum(wa[u] * wb.get(u, 0) for u in wa)
        assert sk.kernel(sk.encode([a]), sk.encode([b]))[0] == pytest.approx(want, rel=1e-5)


def test_projection_is_the_normalised_kernel():
    words, marks = ["moron", "mor.on", "clown", "ab", ""], ["moron", "clo-wn"]
    got = sk.gram(sk.Prepared(words), sk.Prepared(marks))
    for i, a in enumerate(words):
        for j, b in enumerate(marks):
            k = lambda x, y: float(sk.kernel(sk.encode([x]), sk.encode([y]))[0]) if len(x) > 2 and len(y) > 2 else 0.0
            want = k(a, b) / np.sqrt(k(a, a) * k(b, b)) if k(a, b) else 0.0
            assert got[i, j] == pytest.approx(want, abs=1e-5)


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 3)) + 2, rng.normal(size=(200, 3)) - 2])
    y = np.repeat([1.0, -1.0], 200)
    w = sk.svm(np.c_[x, np.ones(400)], y, np.full(400, 10.0))
    assert ((np.c_[x, np.ones(400)] @ w > 0) == (y > 0)).mean() > 0.98


INSULTS = ["moron", "scumbag", "worthless", "clownish"]


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abdeghinorstu"), rng.integers(2, 9))) for _ in range(700)]
    rows, labels = [], []
    for i in range(600):
        text, toxic = list(rng.choice(words, 25)), int(i % 6 == 0)
        if toxic:
            text[int(rng.integers(0, 24))] = str(rng.choice(INSULTS))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def scores(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = df.select("i", toxicity.toxicity_score(model)("text").alias("s")).collect()
    return [r.s for r in sorted(got)]


def test_plain_gapped_and_spelled_out_insults(spark, model):
    bad = ["so MORON!", "you mo.ron", "m-o-r-o-n", "s c u m b a g you", "worth*less", "a moxron"]
    good = [None, "", "  ", "an other sound hour", "... 12 ---", "the " * 400_000]
    assert min(scores(spark, model, bad)) >= 0.3
    assert max(scores(spark, model, good)) < 0.3


def labelled(n, bad, clean, seed=7):
    """Documents of ordinary words; every sixth is toxic by one of ``bad``, others have one of ``clean``."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abdeghinorstu"), rng.integers(2, 9))) for _ in range(700)]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, 25))
        text[int(rng.integers(0, 24))] = str(rng.choice(bad if i % 6 == 0 else clean))
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    return rows


def trained(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))


def test_long_insults_are_learned(spark):
    bad = ["kameradenschweinehund", "pappnasen-vollpfosten"]
    model = trained(spark, labelled(600, bad, ["gartenhaustuerschloss", "strassenbahnhaltestelle"]))
    assert min(scores(spark, model, [f"sound hour {w} other" for w in bad])) >= 0.3
    assert max(scores(spark, model, ["sound hour", "the gartenhaustuerschloss", "an strassenbahnhaltestelle"])) < 0.3


def test_clean_compounds_with_a_bad_looking_tail():
    bad = ["scumbag", "worthless", "clownish", "nincompoop"]
    clean = ["gartensscumbags", "sonnigescumbags", "blumenaworthless", "reisendclownishe"]
    model = toxicity._fit(bad, [t for _, t, _ in labelled(9, clean, clean) for t in t.split()] + clean)
    assert model.margins(clean).max() < 0 < 0.5 < model.margins(bad).min()


def test_copies_of_a_long_document_hide_no_insult(spark):
    rows = labelled(600, ["scumbag", "worthless"], ["sound"])
    long = " ".join(f"b{i}q{i * 7 % 1000}" for i in range(3200))
    rows += [(1000 + i, long + " so clownish", 1) for i in range(120)]
    model = trained(spark, rows)
    assert min(scores(spark, model, ["hour scumbag other", "a worthless sound"])) >= 0.3
    assert max(scores(spark, model, ["sound hour other", "an other"])) < 0.3


def test_cover_takes_what_greedy_search_takes():
    rng = np.random.default_rng(3)
    for _ in range(30):
        pairs = [(int(d), f"w{w}", int(c)) for d, w, c in rng.integers(0, (40, 30, 5), (120, 3))]
        pairs = [(d, w, c) for (d, w), c in {(d, w): c for d, w, c in pairs}.items()]
        contexts = {w: len({c for _, v, c in pairs if v == w}) for _, w, _ in pairs}
        left, want = {d for d, _, _ in pairs}, []
        while left:
            gains = [(len({c for d, v, c in pairs if v == w and d in left}), len({d for d, v, _ in pairs if v == w and d in left}), contexts[w], w) for w in contexts if w not in want]
            best = max(gains)
            if not best[1] or (best[1] < 2 and len(want) >= 8):
                break
            want.append(best[3])
            left -= {d for d, v, _ in pairs if v == best[3]}
        assert toxicity._cover(pairs, contexts, 0) == want


def test_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rows = (
        docs.join(labels.where("doc_id % 2 = 1 and toxic is not null"), "doc_id")
        .select("toxic", toxicity.toxicity_score(model)("text").alias("score"))
        .collect()
    )
    right = sum((r.score >= 0.3) == (r.toxic == 1) for r in rows)
    assert len(rows) > 800 and right / len(rows) > 0.97


def test_query_columns(spark, sf_dir):
    got = op8_toxicity(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == 200 and all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, None), (None, 1)], [(9, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert max(scores(spark, model, ["a b", None])) < 0.3


def test_projection_holds_one_part_of_the_subsequences_at_a_time():
    import tracemalloc

    strings = [f"{sk.START}{i:014d}{sk.END}" for i in range(1 << 14)]
    direction = np.random.default_rng(1).random(sk.LETTERS**sk.LENGTH, np.float32)
    tracemalloc.start()
    got = sk.project(strings, direction)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    assert np.allclose(got, sk.Prepared(strings).project(direction), rtol=1e-5)
