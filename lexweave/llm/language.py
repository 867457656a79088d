"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ``ORDER`` characters over its words, in sorted arrays of
n-gram hashes with their interpolated log probabilities and sorted arrays of context hashes
with their back-off weights.  A text goes to the language with the lowest cross-entropy
per character.  Its score is that language's share after a soft-max whose sharpness is
fitted on labelled rows the models have not seen, times the acceptance of the text: a curve
through the entropies of those rows, by which texts of no known language are rejected.
After that the models learn from these rows too.

Null texts and texts without a letter are ``und`` with score 0, as is every text if no
language was learned.  Training uses at most about ``MAX_ROWS_PER_LANGUAGE`` labelled rows
of each language, chosen by a hash of the id.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.vocabulary import KEPT_STRINGS, blocks, groups, tokens_of
from lexweave.operators.rows import small_side
from lexweave.storage import materialize

ORDER = 4
MAX_ROWS_PER_LANGUAGE = 3_000
CALIBRATION_SHARE = 0.25
# Entropies above this share of the unseen rows' begin to be rejected.
ACCEPTED = 0.995
UNKNOWN = "und"
START, END = "\x02", "\x03"
# A model knows this many characters at least; the rest of the mass is for others.
CHARACTERS = 256

LETTERS = regex.compile(r"\p{L}+")


def letter_runs(token: str) -> list[str]:
    return LETTERS.findall(token.lower())


def hashes(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position, in an array padded with ``order``."""
    out = np.zeros(len(points) - order + 1, np.uint64)
    for i in range(order):
        part = points[i : len(points) - order + 1 + i].astype(np.uint64)
        out = (out + part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def gram_hash(gram: str) -> int:
    return int(hashes(np.array([ord(c) for c in gram], np.uint32), len(gram))[0])


@dataclass
class SortedTable:
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, items: dict[str, float]) -> SortedTable:
        keys = np.array([gram_hash(g) for g in items], np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], np.array(list(items.values()), np.float64)[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]


@dataclass
class CharacterModel:
    """``seen[n]``: log probabilities of n-grams; ``backoff[n]``: of contexts of n characters."""

    seen: dict[int, SortedTable] = field(default_factory=dict)
    backoff: dict[int, SortedTable] = field(default_factory=dict)
    unseen: float = -8.0

    @classmethod
    def fit(cls, grams: dict[str, int]) -> CharacterModel:
        """From the counts of n-grams of the highest order."""
        counts = {ORDER: grams}
        for n in range(ORDER - 1, 0, -1):
            # How many different characters stand before the shorter n-gram.
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        model, lower = cls(), {}
        for n in range(1, ORDER + 1):
            frequency = Counter(counts[n].values())
            once, twice = frequency.get(1, 0), frequency.get(2, 0)
            discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
            total, kinds = defaultdict(float), Counter()
            for g, c in counts[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            weight = {h: discount * kinds[h] / total[h] for h in total}
            now = {}
            for g, c in counts[n].items():
                below = lower[g[1:]] if n > 1 else 1 / CHARACTERS
                now[g] = (c - discount) / total[g[:-1]] + weight[g[:-1]] * below
            lower = now
            model.seen[n] = SortedTable.of({g: float(np.log(p)) for g, p in now.items()})
            if n > 1:
                model.backoff[n - 1] = SortedTable.of(
                    {h: float(np.log(w)) for h, w in weight.items()}
                )
            else:
                model.unseen = float(np.log(weight[""] / CHARACTERS))
        return model

    def log_probabilities(self, codes: dict[int, np.ndarray]) -> np.ndarray:
        """Of every character from position ORDER - 1 on, given those before it.

        ``codes[n]`` holds the hash of the n-gram that starts at each position.
        """
        n_out = len(codes[ORDER])
        out, left = np.zeros(n_out), np.arange(n_out)
        for n in range(ORDER, 0, -1):
            ends = left + ORDER - 1
            keys = codes[n][ends - n + 1]
            found, value = self.seen[n].find(keys)
            out[left[found]] += value[found]
            left = left[~found]
            if not len(left):
                return out
            if n > 1:
                context = codes[n - 1][left + ORDER - n]
                known, weight = self.backoff[n - 1].find(context)
                out[left] += np.where(known, weight, 0.0)
        out[left] += self.unseen
        return out


@dataclass
class Identifier:
    languages: list[str]
    models: list[CharacterModel]
    sharpness: float = 20.0
    limit: float = 10.0
    width: float = 0.1

    def tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability by language, characters) of each token's letters."""
        words = [letter_runs(t) for t in tokens]
        text = "".join(START * (ORDER - 1) + w + END for ws in words for w in ws)
        size = np.array([sum(len(w) + 1 for w in ws) for ws in words], np.int64)
        out = np.zeros((len(tokens), len(self.models)))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return out, size
        wanted = points[ORDER - 1 :] != ord(START)
        owner = np.repeat(np.arange(len(tokens)), size)
        codes = {n: hashes(points, n) for n in range(1, ORDER + 1)}
        for k, model in enumerate(self.models):
            logs = model.log_probabilities(codes)[wanted]
            out[:, k] = np.bincount(owner, weights=logs, minlength=len(tokens))
        return out, size

    def judge(self, sums: np.ndarray, size: np.ndarray):
        """(language number or -1, score, accepted, entropy) from each text's sums."""
        known = (size > 0) & (len(self.languages) > 0)
        if not len(self.languages):
            n = len(size)
            return np.full(n, -1), np.zeros(n), np.zeros(n, bool), np.zeros(n)
        entropy = -sums / np.maximum(size, 1)[:, None]
        best = entropy.min(axis=1)
        share = 1 / np.exp(-self.sharpness * (entropy - best[:, None])).sum(axis=1)
        z = np.clip((best - self.limit) / self.width, -50, 50)
        score = np.where(known, share / (1 + np.exp(z)), 0.0)
        return np.where(known, entropy.argmin(axis=1), -1), score, known & (z <= 0), best


class TextSums:
    """Sums over the tokens of texts; every distinct token is looked up once."""

    def __init__(self, identifier: Identifier):
        self.identifier = identifier
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.logs = np.zeros((1 << 12, len(self.identifier.models) + 1))

    def _rows(self, block: list[str]) -> np.ndarray:
        if len(self.number) > KEPT_STRINGS:
            self.clear()
        new = list(set(block).difference(self.number))
        n = len(self.number)
        while len(self.logs) < n + len(new):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        if new:
            self.logs[n : n + len(new), :-1], self.logs[n : n + len(new), -1] = (
                self.identifier.tokens(new)
            )
            self.number.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.number.__getitem__, block), np.int64, len(block))

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(texts), self.logs.shape[1]))
        for a, b in groups(texts):
            lists = [tokens_of(t or "") for t in texts[a:b]]
            short = [k for k, x in enumerate(lists) if isinstance(x, list) and x]
            if short:
                rows = self._rows(list(chain.from_iterable(lists[k] for k in short)))
                size = np.array([len(lists[k]) for k in short])
                out[a + np.array(short)] = np.add.reduceat(
                    self.logs[rows], np.cumsum(size) - size, axis=0
                )
            for k, x in enumerate(lists):
                if not isinstance(x, list):
                    for block in blocks(x):
                        out[a + k] += self.logs[self._rows(block)].sum(axis=0)
        return out[:, :-1], out[:, -1].astype(np.int64)


def _word_counts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for a, b in groups(texts):
            for lang, text in zip(langs[a:b], texts[a:b], strict=True):
                counts.update((lang, t) for t in tokens_of(text or ""))
        words: Counter = Counter()
        for (lang, token), n in counts.items():
            for word in letter_runs(token):
                words[lang, word] += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in words], pa.string()),
                pa.array([k[1] for k in words], pa.string()),
                pa.array(list(words.values()), pa.int64()),
            ],
            names=["lang", "word", "n"],
        )


def train(labelled: DataFrame) -> Identifier:
    """Learn from (doc_id, text, lang); rows without one of them are left out."""
    rows = labelled.where("doc_id is not null and lang is not null and text is not null")
    shares = (
        rows.groupBy("lang")
        .agg(F.count("*").alias("n"))
        .select("lang", F.least(F.lit(1.0), F.lit(MAX_ROWS_PER_LANGUAGE) / F.col("n")).alias("share"))
    )
    unit = float(1 << 30)
    chosen = materialize(
        rows.join(small_side(shares, "languages", 10_000), "lang")
        .where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * unit)
        .select(
            "lang",
            "text",
            (F.pmod(F.xxhash64("doc_id", F.lit("unseen")), F.lit(1 << 30)) < CALIBRATION_SHARE * unit).alias(
                "unseen"
            ),
        ),
        "language-rows",
    )
    identifier = _fitted(chosen)
    seen = _fitted(chosen.where("not unseen"))
    check = chosen.where("unseen")
    if not seen.languages or check.isEmpty():
        seen, check = identifier, chosen
    if seen.languages:
        seen = _calibrated(seen, check.select("lang", "text"))
    # Texts are named by models that learned from the rows held back as well.
    identifier.limit, identifier.width = seen.limit, seen.width
    identifier.sharpness = seen.sharpness
    return identifier


def _fitted(rows: DataFrame) -> Identifier:
    """Models of the languages of ``rows`` (lang, text)."""
    count = _word_counts
    grams = (
        rows.select("lang", "text")
        .mapInArrow(count, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .withColumn("word", F.concat(F.lit(START * (ORDER - 1)), "word", F.lit(END)))
        .select(
            "lang",
            "n",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.length("word") - (ORDER - 1)),
                    lambda i: F.substring(F.col("word"), i, F.lit(ORDER)),
                )
            ).alias("gram"),
        )
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    by_language = {
        lang: dict(zip(part["gram"], part["n"].tolist(), strict=True))
        for lang, part in grams.groupby("lang")
    }
    languages = sorted(by_language)
    return Identifier(languages, [CharacterModel.fit(by_language[x]) for x in languages])


def _calibrated(identifier: Identifier, rows: DataFrame) -> Identifier:
    n = len(identifier.languages)

    def sums(batches):
        table = TextSums(identifier)
        for batch in batches:
            logs, size = table.of(batch.column("text").to_pylist())
            entropy = -logs / np.maximum(size, 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    pa.array(size),
                    pa.array(list(entropy), pa.list_(pa.float64())),
                ],
                names=["lang", "size", "entropy"],
            )

    found = rows.mapInArrow(sums, "lang string, size long, entropy array<double>").where("size > 0")
    found = found.toPandas()
    if not len(found):
        return identifier
    entropy = np.array(found["entropy"].tolist()).reshape(-1, n)
    truth = np.array([identifier.languages.index(x) if x in identifier.languages else -1 for x in found["lang"]])
    entropy, truth = entropy[truth >= 0], truth[truth >= 0]
    best = entropy.min(axis=1)
    identifier.limit = float(np.quantile(best, ACCEPTED) + best.std())
    identifier.width = float(max(0.02, best.std() / 2))

    def likelihood(sharpness: float) -> float:
        z = -sharpness * (entropy - best[:, None])
        return float((z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean())

    identifier.sharpness = max((1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0), key=likelihood)
    return identifier


def identify(df: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text"):
    """doc_id, lang_pred, score, accepted and entropy of every row."""
    languages = np.array([*identifier.languages, UNKNOWN], object)

    def judge(batches):
        table = TextSums(identifier)
        for batch in batches:
            who, score, accepted, entropy = identifier.judge(
                *table.of(batch.column("text").to_pylist())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(pd.Series(languages[who]), pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(accepted, pa.bool_()),
                    pa.array(entropy, pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score", "accepted", "entropy"],
            )

    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(
        judge, "doc_id long, lang_pred string, score double, accepted boolean, entropy double"
    )
