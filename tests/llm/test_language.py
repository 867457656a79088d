from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexweave.llm import language
from lexweave.llm.queries import op7_language_id
from lexweave.llm.tables import table


def test_probabilities_of_a_context_sum_to_less_than_one():
    grams = {}
    for word in ["abab", "abc", "bcd", "aab", "cab"] * 3 + ["dad"]:
        padded = language.START * 3 + word + language.END
        for i in range(len(padded) - 3):
            grams[padded[i : i + 4]] = grams.get(padded[i : i + 4], 0) + 1
    model = language.CharacterModel.fit(grams)
    alphabet = "abcd" + language.END
    for context in (language.START * 3, "aba", "zzz", language.START * 2 + "a"):
        total = 0.0
        for c in alphabet:
            points = np.array([ord(x) for x in context + c], np.uint32)
            codes = {n: language.hashes(points, n) for n in range(1, 5)}
            total += float(np.exp(model.log_probabilities(codes)[0]))
        assert 0.8 < total <= 1 + 1e-9


def test_scores_match_a_plain_recursion():
    grams = {language.START * 3 + "a": 2, language.START * 2 + "ab": 2, "\x02aba": 1, "\x02abb": 1, "aba\x03": 1, "abb\x03": 1}
    model = language.CharacterModel.fit(grams)

    def plain(context, c):
        for n in range(len(context) + 1, 0, -1):
            h = context[len(context) - n + 1 :]
            found, value = model.seen[n].find(np.array([language.gram_hash(h + c)], np.uint64))
            if found[0]:
                return value[0]
            if n > 1:
                known, weight = model.backoff[n - 1].find(np.array([language.gram_hash(h)], np.uint64))
                if known[0]:
                    return weight[0] + plain(h[1:], c)
        return model.unseen

    text = language.START * 3 + "abxa" + language.END
    points = np.array([ord(x) for x in text], np.uint32)
    got = model.log_probabilities({n: language.hashes(points, n) for n in range(1, 5)})
    assert np.allclose(got, [plain(text[i - 3 : i], text[i]) for i in range(3, len(text))])


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = op7_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang is not null").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    identifier = language.train(docs)
    rows = [(1, None), (2, ""), (3, " 12 … ½ "), (4, "the of and to in that"), (5, "zzqx jjkw " * 50), (6, "la " * 600_000), (None, "der die und")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, identifier).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert got[4].lang_pred == "en" and got[4].score > 0.5
    assert not got[5].accepted and got[5].score < 0.5 and got[5].lang_pred in identifier.languages
    assert got[6].lang_pred in identifier.languages and got[None].lang_pred == "de"


def test_rare_languages_are_learned_whatever_rows_are_held_back(spark):
    rows = [(i, f"the words of an english text {i}", "en") for i in range(40)]
    rows += [(1000 + i, " ".join(["zq" + chr(97 + i) + "xo"] * 4), f"r{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    identifier = language.train(df)
    assert identifier.languages == sorted({r[2] for r in rows})
    got = {r.doc_id: r.lang_pred for r in language.identify(df, identifier).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    identifier = language.train(empty)
    assert identifier.languages == []
    assert language.identify(empty, identifier).count() == 0
    some = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    got = language.identify(some, language.train(some)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    one = spark.createDataFrame([(1, "some words", "xx")], "doc_id long, text string, lang string")
    got = language.identify(one, language.train(one.withColumn("lang", F.lit("xx")))).collect()
    assert got[0].lang_pred == "xx"
