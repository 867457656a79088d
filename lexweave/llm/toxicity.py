"""Toxicity scores by a subsequence string-kernel SVM with Nyström landmarks.

Labels belong to documents, insults to single words, so training is multiple-instance:
sentences of clean documents hold only clean words, those of toxic documents hold at
least one witness.  Witnesses are words that clean documents hardly have and toxic ones
have in more different contexts (following words, so that copies count once) than chance
explains; the documents they leave open are covered greedily by further words, those of
most contexts first.  Neither the words looked at nor the witnesses are limited in number.  The SVM
learns witnesses, also with a character inserted, against clean words; clean words that
score highest are added and it learns again.  A long word is a bag of windows: all of them
are clean in a clean word, and the one of largest margin is bad in a witness.  A document's margin is that of its worst
word, a logistic curve fitted on the training documents turns it into a score.

A word is a run of other than white space, without punctuation around it; it is also read
with its letters only, and three or more single characters in a row are read as one word.
Null and empty texts have no word and get the score of no evidence.  Training uses at
most about ``MAX_TRAINING_ROWS`` labelled rows, chosen by a hash of the id; if none of
them is toxic, every score is the share of toxic rows, 0.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm import string_kernel as sk
from lexweave.llm.tables import bounded_batches
from lexweave.operators.rows import small_side
from lexweave.storage import materialize

MAX_TRAINING_ROWS = 20_000
LANDMARKS = 320
BAD_LANDMARKS = 1_000
CLEAN_WORDS = 1_500
HARD_ROUNDS = 3
HARD_WORDS = 400
BAG_ROUNDS = 6
# Share of clean documents, against that of toxic ones, that may have a witness.
CLEAN_RATIO = 0.05
CACHED_WORDS = 150_000

SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
OTHER = re.compile(r"[\W_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct lower-case words of a text as they stand, spelled-out ones joined."""
    if not text:
        return set()
    text = text.lower()
    found = set(text.split())
    for match in SPELLED.finditer(text):
        found.add("".join(match.group().split()))
    return found


def readings(word: str) -> list[str]:
    """The windows in which a word is read."""
    plain = EDGES.sub("", word)
    letters = OTHER.sub("", plain)
    found = sk.windows(plain) if plain else []
    return found + (sk.windows(letters) if letters and letters != plain else [])


@dataclass
class Model:
    direction: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        """Of each word, the largest margin of its readings."""
        strings, owner = [], []
        for i, word in enumerate(words):
            for reading in readings(word):
                strings.append(reading)
                owner.append(i)
        out = np.zeros(len(words), np.float32)
        if strings:
            np.maximum.at(out, owner, sk.project(strings, self.direction))
        return out + np.float32(self.bias)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * margins.astype(np.float64) + self.offset, -60, 60)
        return 1 / (1 + np.exp(-z))


def document_margins(model: Model, cache: dict[str, float], texts: list[str | None]):
    """The margin of each text's worst word.  ``cache`` keeps words over batches."""
    if len(cache) > CACHED_WORDS:
        cache.clear()
    none = float(np.float32(model.bias))
    out = []
    for start in range(0, len(texts), 256):
        bags = [words_of(t) for t in texts[start : start + 256]]
        new = list(set().union(*bags).difference(cache))
        cache.update(zip(new, model.margins(new).tolist(), strict=True))
        out += [max(map(cache.__getitem__, bag), default=none) for bag in bags]
    return np.array(out)


def _word_rows(batches) -> Iterator[pa.RecordBatch]:
    """Every word of a document once, with a hash of what follows its first occurrence."""
    for batch in batches:
        doc, toxic, word, near = [], [], [], []
        for d, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = (text or "").lower().split()
            follows = dict(zip(reversed(tokens), ["", *reversed(tokens[1:])]))  # noqa: B905
            plain = {EDGES.sub("", t): zlib.crc32(n.encode()) for t, n in follows.items()}
            plain.update((EDGES.sub("", w), 0) for w in words_of(text) if w not in follows)
            plain.pop("", None)
            doc += [d] * len(plain)
            toxic += [y] * len(plain)
            word += plain
            near += plain.values()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc, pa.int64()),
                pa.array(toxic, pa.int32()),
                pa.array(word, pa.string()),
                pa.array(near, pa.int64()),
            ],
            names=["doc", "toxic", "word", "near"],
        )


def _cover(pairs: list[tuple[int, str, int]], contexts: dict[str, int], known: int) -> list[str]:
    """Words that cover most contexts, then documents, of (document, word, context) left open.

    ``known`` words are chosen before.  What a word gains only falls, so that a heap of
    earlier gains finds the largest.
    """
    docs_of: dict[str, dict[int, int]] = defaultdict(dict)
    for doc, word, near in pairs:
        docs_of[word][doc] = near
    left = {doc for doc, _, _ in pairs}
    order = sorted(docs_of, key=lambda w: (contexts[w], w), reverse=True)

    def gain(rank: int) -> tuple[int, int, int]:
        gained = docs_of[order[rank]]
        return -len(set(gained.values())), -len(gained), rank

    chosen: list[str] = []
    heap = sorted(map(gain, range(len(order))))
    while left and heap:
        rank = heapq.heappop(heap)[-1]
        word = order[rank]
        docs_of[word] = {d: near for d, near in docs_of[word].items() if d in left}
        if heap and gain(rank) > heap[0]:
            heapq.heappush(heap, gain(rank))
            continue
        gained = docs_of.pop(word)
        # A word that explains a single further document may do so by chance.
        if not gained or (len(gained) < 2 and known + len(chosen) >= 8):
            break
        chosen.append(word)
        left.difference_update(gained)
    return chosen


def _with_inserted(words: list[str]) -> list[str]:
    out = []
    for word in words:
        for i in range(1, len(word), 2):
            out.append(word[:i] + "x" + word[i:])
    return out


def _fit(witnesses: list[str], clean: list[str]) -> Model:
    """Every window of a clean word is clean; of a witness the window of largest margin is bad."""
    words = witnesses + _with_inserted(witnesses)
    bags = [sk.windows(w) for w in words]
    bad = [x for bag in bags[: len(witnesses)] for x in bag]
    strings = [x for bag in bags for x in bag]
    owner = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    good = list(dict.fromkeys(x for w in clean for x in readings(w)))
    marks = bad[:: -(-len(bad) // BAD_LANDMARKS) or 1]
    usual = good[-max(LANDMARKS - len(marks), LANDMARKS // 3) :]
    marks = sk.Prepared(list(dict.fromkeys(marks + usual)))
    whiten = sk.nystrom(marks)
    x = sk.gram(sk.Prepared(strings + good), marks) @ whiten
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    y = np.concatenate([np.ones(len(strings)), -np.ones(len(good))])
    cost = np.full(len(y), 10.0)
    cost[: len(strings)] = 6.0
    cost[: len(bad)] = 10.0 * max(1.0, len(good) / max(1, 4 * len(witnesses)))
    used = np.ones(len(y), bool)
    for _ in range(BAG_ROUNDS):
        w = sk.svm(x[used], y[used], cost[used])
        # Of each bag, the first window of largest margin.
        order = np.lexsort((-(x[: len(strings)] @ w), owner))
        _, first = np.unique(owner[order], return_index=True)
        now = np.ones(len(y), bool)
        now[: len(strings)] = False
        now[order[first]] = True
        if (now == used).all():
            break
        used = now
    return Model(marks.sum(whiten @ w[:-1]), float(w[-1]), 1.0, 0.0)


def _logistic(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve, by Newton steps on smoothed targets."""
    ones, zeros = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    target = np.where(toxic > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * theta)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Labels that are null or have no id, and those of unknown documents, are left out.
    """
    bounded_batches(docs.sparkSession)
    rows = labels.where("toxic is not null and doc_id is not null").select(
        F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")
    )
    share = max(1.0, rows.count() / MAX_TRAINING_ROWS)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) / share)
    sample = small_side(rows.where(part), "training-labels", 2 * MAX_TRAINING_ROWS)
    chosen = materialize(
        docs.select(F.col("doc_id").cast("long"), "text")
        .join(sample, "doc_id")
        .select("doc_id", "toxic", "text"),
        "training-rows",
    )
    read = _word_rows
    words = materialize(
        chosen.mapInArrow(read, "doc long, toxic int, word string, near long"),
        "training-words",
    )
    sides = {
        r["toxic"]: r["n"]
        for r in chosen.groupBy((F.col("toxic") > 0).cast("int").alias("toxic"))
        .agg(F.count("*").alias("n"))
        .collect()
    }
    toxic, clean = sides.get(1, 0), sides.get(0, 0)
    if not toxic:
        return Model(np.zeros(sk.LETTERS**sk.LENGTH, np.float32), -60.0, 1.0, 0.0)
    counted = materialize(
        words.groupBy("word").agg(
            F.sum((F.col("toxic") > 0).cast("long")).alias("bad"),
            F.sum((F.col("toxic") <= 0).cast("long")).alias("good"),
            F.countDistinct(F.when(F.col("toxic") > 0, F.col("near"))).alias("contexts"),
        ),
        "training-counts",
    )
    # As many contexts as hardly any word has by chance, among so many words.
    enough = np.log(100 * max(1, counted.count())) / np.log((toxic + clean) / toxic + 1e-9)
    likely = materialize(
        counted.where(F.col("good") * toxic <= CLEAN_RATIO * clean * F.col("bad"))
        .where((F.col("bad") >= (2 if toxic > 10 else 1)) & (F.length("word") >= 3))
        .select("word", "contexts", (F.col("contexts") >= float(enough)).alias("sure")),
        "training-candidates",
    )
    sure = likely.where("sure").orderBy(F.desc("contexts"), "word").collect()
    witnesses = [r["word"] for r in sure]
    bad_words = words.where("toxic > 0").select("doc", "word", "near")
    explained = bad_words.join(likely.where("sure").select("word"), "word").select("doc").distinct()
    found = (
        bad_words.join(likely.where("not sure").select("word", "contexts"), "word")
        .join(explained, "doc", "left_anti")
        .collect()
    )
    contexts = {r["word"]: r["contexts"] for r in found}
    witnesses += _cover([(r["doc"], r["word"], r["near"]) for r in found], contexts, len(sure))
    innocent = counted.where((F.col("good") > 0) & ~F.col("word").isin(witnesses))
    usual = [
        r["word"]
        for r in innocent.orderBy(F.desc("good"), "word").limit(CLEAN_WORDS).collect()
    ]
    model = _fit(witnesses, usual)
    for _ in range(HARD_ROUNDS):
        hardest = (
            innocent.withColumn("margin", word_margin(model)(F.col("word")))
            .orderBy(F.desc("margin"), "word")
            .limit(HARD_WORDS)
            .collect()
        )
        known = set(usual)
        added = [r["word"] for r in hardest if r["margin"] > -1 and r["word"] not in known]
        if not added:
            break
        usual += added
        model = _fit(witnesses, usual)
    found = chosen.select("toxic", document_margin(model)(F.col("text")).alias("m")).toPandas()
    slope, offset = _logistic(
        found["m"].to_numpy(np.float64), (found["toxic"] > 0).to_numpy(np.float64)
    )
    return Model(model.direction, model.bias, slope, offset)


def word_margin(model: Model) -> Callable[[Column], Column]:
    @F.pandas_udf("float")
    def margin(words: pd.Series) -> pd.Series:
        return pd.Series(model.margins(words.tolist()))

    return margin


def document_margin(model: Model) -> Callable[[Column], Column]:
    margins = document_margins

    @F.pandas_udf("double")
    def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for texts in batches:
            yield pd.Series(margins(model, cache, texts.tolist()))

    return margin


def toxicity_score(model: Model) -> Callable[[Column], Column]:
    """A column function from text to a score of 0 to 1."""
    margins = document_margins

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for texts in batches:
            yield pd.Series(model.scores(margins(model, cache, texts.tolist())))

    return score
