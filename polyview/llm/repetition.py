"""Quality rules by repetition coverage.

For each length in LENGTHS, the n-grams of a text's words get rolling 64-bit hashes (the hash of n words
from that of n-1 and the next word, for all positions at once in numpy). A word position is covered if it
lies in an n-gram whose hash occurred earlier in the text; the measure is the share of the words'
characters (code points) that are covered. Lines count likewise: the share of the text's characters in lines equal to an
earlier line. A text is kept if it passes the base rules and no share exceeds its limit.

Base counts: words, their code points, symbols, repeated lines, and words in 3-word windows that occur
twice or more (the first included). Null and empty texts have no words, so all counts are 0 and the base
rules fail. Each row is measured by itself: repeated rows get equal results. Columns other than the text are kept, but
those that have the name of a measure are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import mixed

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Largest share of characters inside repeated n-grams, by n, and inside repeated lines (published web-corpus rules).
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
MIN_WORDS, MAX_REPEAT = 50, 50
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, line_share double, " + ", ".join(f"share_{n} double" for n in LIMITS) + ", kept boolean"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolled(ids: np.ndarray, lengths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of all n-grams) for the wanted n, each rolled on from the one before."""
    one = mixed(ids.astype(np.uint64) + np.uint64(1))
    h = one
    for n in range(1, max(lengths) + 1):
        if n > 1:
            h = h[:-1] * _BASE + one[n - 1 :]
        if len(h) == 0:
            return
        if n in lengths:
            yield n, h


def repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the positions whose value occurs elsewhere too, and of those where it occurred earlier."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    later, any_ = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def spread(starts: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words in the n-grams that start where ``starts`` holds."""
    step = np.zeros(len(starts) + n, np.int64)
    step[: len(starts)] += starts
    step[n:] -= starts
    return np.cumsum(step)[:-1] > 0


def measure(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    n_symbols = len(SYMBOLS.findall(text))
    seen: set[bytes] = set()
    plain = len(raw) == len(text)  # a byte a character
    size = len if plain else lambda b: len(b.decode("utf-8", "surrogatepass"))
    n_dup, dup_chars = 0, 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            if line in seen:
                n_dup += 1
                dup_chars += size(line)
            seen.add(line)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n_words)
    lens = None
    n_repeat, shares = 0, dict.fromkeys(LIMITS, 0.0)
    if n_words:
        for n, h in rolled(ids, {3, *LIMITS}):
            any_, later = repeats(h)
            if n == 3:
                if not later.any():
                    break  # a repeated longer n-gram would hold a repeated 3-gram
                n_repeat = int(spread(any_, n).sum())
            elif later.any():
                lens = np.fromiter(map(size, words), np.int64, n_words) if lens is None else lens
                shares[n] = float(lens[spread(later, n)].sum()) / word_chars
            else:
                break
    line_share = dup_chars / max(1, len(text))
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT * n_words
    kept = not failed and line_share <= LINE_LIMIT and all(shares[n] <= most for n, most in LIMITS.items())
    return (n_words, word_chars, n_symbols, n_dup, n_repeat, failed, line_share, *shares.values(), kept)


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COLUMNS."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    @F.pandas_udf(COLUMNS)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([measure(t) for t in b], columns=names)

    kept = [c for c in docs.columns if c == text or c not in names]
    return docs.withColumn("_m", measured(F.col(text))).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_m.{c}").alias(c) for c in names if c != text])
