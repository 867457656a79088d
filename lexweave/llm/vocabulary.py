"""Work that is done once for each distinct string, within a Python worker."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa

# Texts are taken in groups of about so many characters.
GROUP_CHARS = 1 << 20
KEPT_STRINGS = 600_000
TOKEN = re.compile(r"\S+")
WORKER_STATE = "lexweave_worker_state"


def kept_in_worker(run: str, make: Callable):
    """What ``make`` gives, made once for all tasks of a run in a Python worker.

    Functions travel whole, so modules of this package keep nothing between tasks; a module
    that exists in the worker alone does.  It holds what the last run made and no more, so
    a run never starts with what another one has found.
    """
    state = sys.modules.setdefault(WORKER_STATE, ModuleType(WORKER_STATE))
    if getattr(state, "run", None) != run:
        state.made = None
        state.made, state.run = make(), run
    return state.made


def groups(texts: list[str | None], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive texts of about ``limit`` characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        if size > limit:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def found_in(pattern: re.Pattern, text: str) -> Iterable[str]:
    """All matches; of a very long text one by one, so that they are never held together."""
    if len(text) <= GROUP_CHARS:
        return pattern.findall(text)
    return (m.group() for m in pattern.finditer(text))


def tokens_of(text: str) -> Iterable[str]:
    """Runs of other than white space."""
    return text.split() if len(text) <= GROUP_CHARS else found_in(TOKEN, text)


class Spellings:
    """Integer sequences of strings, each found once; bounded in number.

    ``spell`` gives the sequence of each string, or all of them one after the other and
    their lengths.
    """

    def __init__(self, spell: Callable[[list[str]], list[np.ndarray] | tuple]):
        self.spell = spell
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _add(self, strings: list[str]) -> None:
        spelled = self.spell(strings)
        if isinstance(spelled, tuple):
            flat, lengths = spelled
        else:
            flat = np.concatenate(spelled)
            lengths = np.array([len(s) for s in spelled], np.int64)
        n, more = len(self.number), int(lengths.sum())
        while len(self.flat) < self.used + more:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < n + len(strings):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + more] = flat
        self.length[n : n + len(strings)] = lengths
        self.start[n : n + len(strings)] = self.used + np.cumsum(lengths) - lengths
        self.used += more
        self.number.update(zip(strings, range(n, n + len(strings)), strict=True))

    def _rows(self, block: list[str]) -> np.ndarray:
        if len(self.number) > KEPT_STRINGS:
            self.clear()
        self._add_new(set(block).difference(self.number))
        return self._numbers(block)

    def _add_new(self, new: Iterable[str]) -> None:
        strings = list(new)
        if strings:
            self._add(strings)

    def _numbers(self, block: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, block), np.int64, len(block))

    def of(self, strings: Iterable[str]) -> np.ndarray:
        """The sequences of all strings, one after the other."""
        out = [np.zeros(0, np.int32)]
        for block in blocks(strings):
            rows = self._rows(block)
            out.append(gathered(self.flat, self.start[rows], self.length[rows]))
        return np.concatenate(out)

    def of_each(self, lists: list[Iterable[str]]) -> list[np.ndarray]:
        """As ``of`` for each of several; new strings of all lists are spelled together."""
        short = [x for x in lists if isinstance(x, list)]
        rows = self._rows(list(chain.from_iterable(short)))
        length = self.length[rows]
        ids = gathered(self.flat, self.start[rows], length)
        ends = np.concatenate(([0], np.cumsum(length)))[np.cumsum([0, *map(len, short)])]
        parts = iter(np.split(ids, ends[1:-1]))
        return [next(parts) if isinstance(x, list) else self.of(x) for x in lists]


    def of_lists(self, lists: pa.ListArray) -> list[np.ndarray]:
        """As ``of_each``, for strings in Arrow, which finds the distinct ones."""
        strings = lists.flatten().dictionary_encode()
        distinct = strings.dictionary.to_pylist()
        if len(self.number) > KEPT_STRINGS:
            self.clear()
        self._add_new(s for s in distinct if s not in self.number)
        rows = self._numbers(distinct)[strings.indices.to_numpy()]
        length = self.length[rows]
        ids = gathered(self.flat, self.start[rows], length)
        ends = np.concatenate(([0], np.cumsum(length)))[lists.offsets.to_numpy()]
        return np.split(ids, ends[1:-1])


def blocks(strings: Iterable[str], size: int = 1 << 18) -> Iterator[list[str]]:
    if isinstance(strings, list):
        for i in range(0, len(strings), size):
            yield strings[i : i + size]
        return
    block: list[str] = []
    for s in strings:
        block.append(s)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``flat[start : start + length]``, one after the other."""
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(int(length.sum()))]
