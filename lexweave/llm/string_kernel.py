"""The subsequence string kernel over short strings, and a linear SVM on Nyström features.

Two strings are compared by the subsequences of three characters they share, gaps
allowed; each occurrence counts ``DECAY`` to the power of the span it stretches over.
Strings carry a mark at either end and are normalised to unit length in feature space.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH = 3
DECAY = 0.7
LETTERS = 64
# Longer strings are read in windows of this length that overlap by half.
WINDOW = 16
START, END = "\x02", "\x03"


def letter_codes(points: np.ndarray) -> np.ndarray:
    """0 to LETTERS - 1: marks, a-z and digits have codes of their own, others share 24."""
    codes = points % 24 + 40
    for first, last, code in ((START, START, 0), (END, END, 1), ("a", "z", 2), ("0", "9", 28)):
        inside = (points >= ord(first)) & (points <= ord(last))
        codes[inside] = points[inside] - ord(first) + code
    return codes.astype(np.uint8)


def windows(word: str) -> list[str]:
    marked = START + word + END
    if len(marked) <= WINDOW:
        return [marked]
    half = WINDOW // 2
    return [marked[i : i + WINDOW] for i in range(0, len(marked) - half, half)]


def encode(strings: list[str]) -> np.ndarray:
    """Letter codes of strings of one length."""
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return letter_codes(points).reshape(len(strings), -1)


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _TRIPLES:
        at = np.array(list(combinations(range(n), LENGTH)), np.int64).reshape(-1, LENGTH)
        span = at[:, -1] - at[:, 0] + 1
        _TRIPLES[n] = at, (DECAY**span).astype(np.float32)
    return _TRIPLES[n]


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature number of every subsequence, its weight by position) of equal-length strings."""
    at, weight = _triples(codes.shape[1])
    x = codes.astype(np.int32)
    return (x[:, at[:, 0]] * LETTERS + x[:, at[:, 1]]) * LETTERS + x[:, at[:, 2]], weight


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernel of s[i] with t[i], by the recursion over prefixes, for all i at once."""
    m, n, k = len(s), s.shape[1], t.shape[1]
    before = np.ones((n + 1, k + 1, m), np.float32)
    same = [[s[:, i] == t[:, j] for j in range(k)] for i in range(n)]
    for _ in range(1, LENGTH):
        now = np.zeros((n + 1, k + 1, m), np.float32)
        for i in range(1, n + 1):
            run = np.zeros(m, np.float32)
            for j in range(1, k + 1):
                run = DECAY * (run + DECAY * before[i - 1, j - 1] * same[i - 1][j - 1])
                now[i, j] = DECAY * now[i - 1, j] + run
        before = now
    total = np.zeros(m, np.float32)
    for i in range(n):
        for j in range(k):
            total += DECAY * DECAY * before[i, j] * same[i][j]
    return total


def by_length(strings: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        found.setdefault(len(s), []).append(i)
    return found


def _parts(strings: list[str], batch: int = 2048):
    """(rows, feature numbers, weights by position, norms) of strings of one length, a batch each."""
    for length, rows in by_length(strings).items():
        if length < LENGTH:
            continue
        for i in range(0, len(rows), batch):
            part = rows[i : i + batch]
            codes = encode([strings[r] for r in part])
            numbers, spans = features(codes)
            norm = np.sqrt(kernel(codes, codes))
            yield part, numbers, spans, np.maximum(norm, 1e-12)


def _project(n: int, parts, direction: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.float32)
    for rows, numbers, spans, norm in parts:
        out[rows] = direction[numbers] @ spans / norm
    return out


class Prepared:
    """Strings with their subsequences and norms, to be projected again and again."""

    def __init__(self, strings: list[str]):
        self.n, self.parts = len(strings), list(_parts(strings))

    def project(self, direction: np.ndarray) -> np.ndarray:
        """Inner product of each (unit length) string with a vector of feature space."""
        return _project(self.n, self.parts, direction)

    def sum(self, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the strings in feature space."""
        total = np.zeros(LETTERS**LENGTH, np.float64)
        for rows, numbers, spans, norm in self.parts:
            np.add.at(total, numbers, (weights[rows] / norm)[:, None] * spans)
        return total.astype(np.float32)


def project(strings: list[str], direction: np.ndarray, batch: int = 1 << 14) -> np.ndarray:
    """As ``Prepared.project``, of any number of strings; subsequences are held a part at a time."""
    parts = [strings[i : i + batch] for i in range(0, len(strings), batch)]
    return np.concatenate(
        [np.zeros(0, np.float32), *(_project(len(p), _parts(p, 512), direction) for p in parts)]
    )


def gram(strings: Prepared, landmarks: Prepared) -> np.ndarray:
    """Normalised kernel of all strings with all landmarks."""
    units = np.eye(landmarks.n)
    return np.stack([strings.project(landmarks.sum(unit)) for unit in units], axis=1)


def nystrom(landmarks: Prepared, floor: float = 1e-3) -> np.ndarray:
    """The map from kernel values with the landmarks to features (inverse square root)."""
    values, vectors = np.linalg.eigh(gram(landmarks, landmarks).astype(np.float64))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, floor))) @ vectors.T


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps on its support vectors."""
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        weighted = x[active] * cost[active][:, None]
        hessian = weighted.T @ x[active] + np.eye(x.shape[1])
        w = np.linalg.solve(hessian, weighted.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w
