"""Quality rules on repetition, by suffix arrays over words.

The words of a batch of texts are one sequence, in which words of different texts never count as equal. Prefix doubling
sorts its suffixes, keeping only those that aren't alone yet; from the ranks of each round come the longest common prefixes of
neighbours. Intervals of these are the maximal repeated substrings; the union of their spans gives the repeated part of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words of a window of the base rule, its limits, and the symbols that are counted.
WINDOW, FEWEST, PERCENT, SYMBOLS = 8, 20, 30, "#*$%&|<>"
#: The method: words of a repeat that counts, the share of a text's word characters that such repeats may cover, and the words of the longest repeat allowed.
REPEAT, COVERED, LONGEST = 5, 0.5, 60
#: Words in one suffix array, unless one text has more.
BATCH = 200_000


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix order of a sequence, and the ranks by the first 1, 2, 4 ... symbols up to where all suffixes differ."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) if n else np.zeros(0, np.int64)
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0]) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))  # the first place of its group: stays right as groups are split
    ranks, step = [rank.astype(np.int32)], 1
    while n:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank[order]] > 1)  # places whose suffixes aren't alone
        if not len(open_):
            break
        at = order[open_]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        by = np.lexsort((after, rank[at]))
        at, after, group = at[by], after[by], rank[at[by]]
        order[open_] = at
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        rank = rank.copy()
        rank[at] = np.repeat(open_[new], np.diff(np.r_[np.flatnonzero(new), len(at)]))
        ranks.append(rank.astype(np.int32))
        step *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """For each place of the order but the first, the length of the longest common prefix with the suffix before."""
    n = len(order)
    a, b, length = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        step = np.where(same, 1 << k, 0)
        a, b, length = a + step, b + step, length + step
    return length


def maximal_repeats(symbols: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first position, occurrences) of the maximal repeated substrings of ``least`` symbols or more.

    They are the intervals of the common prefixes whose occurrences don't all continue alike to the left. Each interval is opened and closed
    once, with the least position that it holds.
    """
    previous = np.where(order > 0, symbols[np.maximum(order - 1, 0)], -1)
    changes = np.r_[0, np.cumsum(previous[1:] != previous[:-1])]
    found, stack = [], []  # open intervals: length, first place in the order, least position

    def close(down_to: int, last: int) -> tuple[int, int] | None:
        """Closes the intervals longer than that; first place and least position of the outermost."""
        inner = None
        while stack and stack[-1][0] > down_to:
            length, begin, position = stack.pop()
            inner = (begin, position if inner is None else min(position, inner[1]))
            if changes[last] > changes[begin]:
                found.append((length, inner[1], last - begin + 1))
        if stack and inner:
            stack[-1][2] = min(stack[-1][2], inner[1])
        return inner

    long_ = np.flatnonzero(lcp >= least)
    for k, place in enumerate(long_):
        here = int(lcp[place])
        if k and long_[k - 1] != place - 1:
            close(0, int(long_[k - 1]) + 1)
        inner = close(here, int(place))
        if not stack or stack[-1][0] < here:
            stack.append([here, *(inner or (int(place), int(order[place])))])
        stack[-1][2] = min(stack[-1][2], int(order[place + 1]))
    if len(long_):
        close(0, int(long_[-1]) + 1)
    return found


def longest_at(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest repeated substring that begins there: that of the innermost interval that holds its suffix."""
    at = np.zeros(len(order), np.int64)
    if len(order):
        at[order] = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    return at


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in the union of the spans of repeats of ``least`` symbols or more."""
    n = len(longest)
    begin = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + longest[begin], -1)
    return np.cumsum(edge[:-1]) > 0


def measured(texts: list[str | None], repeats: bool = False) -> pd.DataFrame:
    """The measures of each text, from one suffix array over all of them."""
    split = [(t or "").encode().split() for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    text_of = np.repeat(np.arange(len(split)), count)
    known: dict = {}
    word = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(count.sum()))
    size = np.fromiter((len(w.decode()) for w in known), np.int64, len(known))[word] if len(known) else np.zeros(0, np.int64)
    symbols = text_of * max(len(known), 1) + word
    order, ranks = suffixes(symbols)
    lcp = common_prefixes(order, ranks)
    longest = longest_at(order, lcp)
    per_text = lambda x: np.bincount(text_of, weights=x, minlength=len(split)).astype(np.int64)
    over = covered(longest, REPEAT)
    top = np.zeros(len(split), np.int64)
    np.maximum.at(top, text_of, longest)
    out = pd.DataFrame({
        "n_words": count, "word_chars": per_text(size), "n_symbols": [sum(map(t.count, SYMBOLS)) if t else 0 for t in texts],
        "n_dup_lines": [_equal_lines(t) for t in texts], "n_repeat_words": per_text(covered(longest, WINDOW)),
        "covered_words": per_text(over), "covered_chars": per_text(np.where(over, size, 0)), "longest_repeat": top,
    })
    first = np.cumsum(count) - count
    if repeats:
        listed: list[list] = [[] for _ in split]
        for length, at, times in maximal_repeats(symbols, order, lcp, REPEAT):
            listed[text_of[at]].append({"start": at - int(first[text_of[at]]), "words": length, "times": times})
        out["repeats"] = [sorted(x, key=lambda r: (-r["words"], r["start"])) for x in listed]
        turns = np.diff(np.r_[False, over, False].astype(np.int8))
        edges = [(int(a), int(b)) for a, b in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1))]
        spans: list[list] = [[] for _ in split]
        for a, b in edges:
            while a < b:  # a run may reach over the end of a text
                stop = min(b, int(first[text_of[a]] + count[text_of[a]]))
                spans[text_of[a]].append({"start": a - int(first[text_of[a]]), "end": stop - int(first[text_of[a]])})
                a = stop
        out["spans"] = spans
    return out


def _equal_lines(text: str | None) -> int:
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return len(lines) - len(set(lines))


def judge_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = False) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, covered_chars, longest_repeat,
    base_failed, kept) for every row of ``docs``.

    Words are runs of anything but ASCII white space. The base rule fails texts of under ``FEWEST`` words or with more than
    ``PERCENT`` % of their words in ``WINDOW``-word windows that occur twice. The method drops texts of whose word characters a share over
    ``COVERED`` lies in repeats of ``REPEAT`` words or more, or whose longest repeat has over ``LONGEST`` words. Null and empty texts have
    no words, and fail. Null, equal and repeated ids are judged row by row; an empty table gives none; other columns don't matter.

    ``repeats`` adds the maximal repeats (start and words of the first occurrence, how often) and the covered spans, in words. A text is
    always in one array with its whole length: some 100 bytes a word, and as many doublings as its longest repeat needs.
    """
    small_batches(docs)
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "covered_chars", "longest_repeat")
    more = ", repeats array<struct<start: long, words: long, times: long>>, spans array<struct<start: long, end: long>>" if repeats else ""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = frame["text"].str.len().fillna(0).to_numpy() // 5
            part = (np.cumsum(size) // BATCH).astype(np.int64)
            for k in np.unique(part):
                rows = frame[part == k].reset_index(drop=True)
                yield pd.concat([rows[["id"]], measured(rows["text"].to_list(), repeats)], axis=1)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {id_type}, {', '.join(f'{m} long' for m in measures)}{more}")
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > PERCENT * F.col("n_words"))
    fine = (F.col("covered_chars") <= COVERED * F.col("word_chars")) & (F.col("longest_repeat") <= LONGEST)
    return found.select(F.col("id").alias(id_col), *found.columns[1:], failed.alias("base_failed"), (~failed & fine).alias("kept"))
