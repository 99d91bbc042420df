"""Quality rules with repetition measured on suffix arrays.

The words of many texts are numbered and sorted as one suffix array per batch (prefix doubling; a
text's number leads every key, so that no comparison leaves its text). Neighbours in that order give
the longest common prefixes; where these are at least m, the suffixes form an interval of a repeated
substring, and a suffix's longest repeat is the larger of the prefixes on its two sides. The spans
[i, i + longest repeat at i) cover what maximal repeats cover; their union and the longest of them
decide. Texts are independent: nothing is shuffled.

Null or empty texts have no words (all measures 0) and fail the length rule. Repeated rows and ties
give equal results; other columns pass unchanged, those named like a measure are replaced. Empty tables give empty
ones. A text is one task's and is never cut: one of b bytes takes about 60 b of that task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import lean, slices, utf8

#: The separators of words and the symbols that are counted.
SEPARATORS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


@dataclass(frozen=True)
class Rules:
    """A text is rejected below `min_words` words, over `max_window_percent` percent of words in
    repeated 3-word windows, over `max_covered_percent` percent of words in repeats of `min_repeat`
    words or more, or with a repeat over `max_longest_percent` percent of the text and `long_repeat` words."""

    min_words: int = 50
    window: int = 3
    max_window_percent: int = 50
    min_repeat: int = 8
    max_covered_percent: int = 20
    max_longest_percent: int = 15
    long_repeat: int = 12


def suffix_array(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts in order, and the common prefix of each with the one before (0 for a text's first).

    words: word numbers; text: the number of each word's text, ascending.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.searchsorted(text, text, "right")
    key = text.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    ranks, step = [], 1

    def ranked(sorted_key: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        return rank

    rank = ranked(key[order], order)
    while True:
        ranks.append(rank.astype(np.int32))
        by_rank = rank[order]
        tied = np.r_[False, by_rank[1:] == by_rank[:-1]]
        tied[:-1] |= tied[1:]
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        own = order[at]
        nxt = own + step
        second = np.where(nxt < end[own], rank[np.minimum(nxt, n - 1)] + 1, 0)
        again = np.lexsort((second, by_rank[at]))
        order[at] = own[again]
        pair = np.stack([by_rank[at][again], second[again]])
        fresh = np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(0)]
        # a rank is the place of its group's first member
        groups = np.maximum.accumulate(np.where(fresh, at, 0))
        if step == 1:
            place = np.maximum.accumulate(np.where(np.r_[True, by_rank[1:] != by_rank[:-1]], np.arange(n), 0))
            rank = np.empty(n, np.int64)
            rank[order] = place
        else:
            rank = rank.copy()
        rank[order[at]] = groups
        step *= 2
    # common prefixes of neighbours, by halving steps over the ranks kept
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    open_ = np.flatnonzero(ranks[0][a] == ranks[0][b])
    a, b = a[open_], b[open_]
    for k in range(len(ranks) - 1, -1, -1):
        ok = (a < end[a - (a >= n)]) & (a < n) & (b < n)
        ia, ib = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = ok & (ranks[k][ia] == ranks[k][ib]) & (text[ia] == text[ib])
        same &= (a + (1 << k) <= end[order[open_]]) & (b + (1 << k) <= end[order[open_ + 1]])
        lcp[open_[same] + 1] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, lcp


def repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeat that starts there."""
    order, lcp = suffix_array(words, text)
    out = np.zeros(len(words), np.int64)
    if len(words):
        out[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Words in the union of the repeats of at least `least` words."""
    n = len(longest)
    reach = np.maximum.accumulate(np.where(longest >= least, np.arange(n) + longest, 0)) if n else longest
    return np.arange(n) < reach


def covered_window(longest: np.ndarray, window: int) -> np.ndarray:
    return covered(np.where(longest >= window, window, 0), window)


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][off])


def measure_slice(data: np.ndarray, off: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """All measures of the texts whose bytes are data[off[k]:off[k+1]]."""
    n = len(off) - 1
    space = np.isin(data, np.frombuffer(SEPARATORS, np.uint8))
    out = {"word_chars": _sums(~space & ((data & 0xC0) != 0x80), off), "n_symbols": _sums(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), off)}
    per_text, dup, found = [], np.zeros(n, np.int64), []
    for k in range(n):
        raw = data[off[k] : off[k + 1]].tobytes()
        own = raw.split()
        per_text.append(len(own))
        found += own
        lines = [x for x in raw.split(b"\n") if x.strip(SEPARATORS)]
        dup[k] = len(lines) - len(set(lines))
    counts = np.array(per_text, np.int64)
    numbers = pc.dictionary_encode(pa.array(found, pa.binary())).indices.to_numpy().astype(np.int64) if found else np.zeros(0, np.int64)
    longest = repeats(numbers, np.repeat(np.arange(n), counts))
    ends = np.r_[0, np.cumsum(counts)]
    out |= {"n_words": counts, "n_dup_lines": dup, "n_repeat_words": _sums(covered_window(longest, rules.window), ends), "covered_words": _sums(covered(longest, rules.min_repeat), ends)}
    most = np.zeros(n, np.int64)
    np.maximum.at(most, np.repeat(np.arange(n), counts), longest)
    return out | {"longest_repeat": most}


def measure(df: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """Adds the measures of each text to its row."""

    def run(batches):
        for b in batches:
            data, off = utf8(b[text])
            parts = [measure_slice(data[off[i] : off[j]], off[i : j + 1] - off[i], rules) for i, j in slices(off)]
            cols = [pa.array(np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *MEASURES])

    df = df.drop(*MEASURES)
    return df.mapInArrow(lean(run), df.select("*", *(F.lit(0).cast("long").alias(m) for m in MEASURES)).schema)


def verdict(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds base_failed and kept to measured texts."""
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_window_percent * F.col("n_words"))
    repeated = (100 * F.col("covered_words") > rules.max_covered_percent * F.col("n_words")) | (
        (F.col("longest_repeat") > rules.long_repeat) & (100 * F.col("longest_repeat") > rules.max_longest_percent * F.col("n_words"))
    )
    return df.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~repeated)
