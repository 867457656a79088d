"""Random regulation-shaped texts with everything the chunker looks at."""

from __future__ import annotations

import random

LINES = (
    "", "", " ", "\t", "Article 1", "  Article  12a ", "article 3", "Article 4 is not a heading",
    "Article", "5", "ANNEX", "ANNEX I", "ANNEXES", " ANNEX IV ", "ANNEXED text", "IV", "EN",
    " EN ", "L 119/1", "4.5.2016", "Official Journal of the European Union", "(a) first point",
    "(12) another point", "1. numbered", "27. numbered", "Scope", "Subject matter",
    "So\u00adft hy\u00adphen", "double  space\tand tab", "accents \u00e9\u00e8\u00fc and \U0001d4b3",
)


def text(rng: random.Random, annexes: bool = True) -> str:
    pool = [x for x in LINES if annexes or not x.strip().startswith("ANNEX")]
    lines = []
    for _ in range(rng.randint(0, 60)):
        kind = rng.random()
        if kind < 0.6:
            lines.append(rng.choice(pool))
        else:
            start = rng.choice(("", "(b) ", "3. ", "plain "))
            words = rng.randint(1, rng.choice((5, 40, 260)))
            lines.append(start + " ".join(rng.choice(("law", "person", "data", "\u00f1u")) for _ in range(words)))
    return "\n".join(lines)


def texts(count: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [text(rng, annexes=rng.random() < 0.6) for _ in range(count)]


def pages_of(document: str, rng: random.Random) -> list[str]:
    """The document cut at random newlines, which go missing as page breaks do."""
    pages, current = [], []
    for line in document.split("\n"):
        if current and rng.random() < 0.3:
            pages.append("\n".join(current))
            current = []
        current.append(line)
    return [*pages, "\n".join(current)]
