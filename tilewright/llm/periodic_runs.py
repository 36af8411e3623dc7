"""Maximal repetitions of words within a text, after Kolpakov and Kucherov, and texts without what they repeat.

A stretch of words is cut into Lempel-Ziv factors by walking its suffix automaton. Runs that end in a factor and begin
at its start or before are found by Main's longest extensions around the border of the two factors; runs inside a
factor are copied from the factor's earlier occurrence. Before that, whole batches are screened with numpy: a run
repeats so many consecutive words that all of it is covered by n-grams that the text holds twice, so only stretches so
covered are taken on. The screen leaves nothing out that a run could touch.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.scratch import small_batches
from tilewright.llm.words import gathered, words_of

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_automaton(codes: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of each state, and where the first occurrence of its words ends. Memory is about 0.5 kB a code."""
    go: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for k, c in enumerate(codes):
        new, p = len(go), last
        go.append({})
        size.append(k + 1)
        first.append(k)
        link.append(0)
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(go[q].copy())
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
        last = new
    return go, first


def factors(codes: list[int]) -> Iterator[tuple[int, int, int]]:
    """Lempel-Ziv factors (begin, length, source): each the longest that also begins earlier, at source, where the two may
    overlap; or one new code, whose source is -1."""
    go, first = suffix_automaton(codes)
    begin = 0
    while begin < len(codes):
        state, end = 0, begin
        while end < len(codes) and first[to := go[state][codes[end]]] < end:
            state, end = to, end + 1
        if end == begin:
            yield begin, 1, -1
            begin += 1
        else:
            yield begin, end - begin, first[state] - (end - begin) + 1
            begin = end


def extensions(codes: list[int]) -> list[int]:
    """How far codes[k:] agrees with codes, for each k."""
    n = len(codes)
    far = [0] * n
    left = right = 0
    for k in range(1, n):
        z = min(right - k, far[k - left]) if k < right else 0
        while k + z < n and codes[z] == codes[k + z]:
            z += 1
        far[k] = z
        if k + z > right:
            left, right = k, k + z
    if n:
        far[0] = n
    return far


def at_border(codes: list[int], before: int, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, period; a multiple of the smallest one too) that end in the factor codes[begin:end] and begin at
    its start or earlier; `before` is the length of the factor before it. Such a run's period is less than both lengths
    together, and it begins less than that and `before` ahead of the border: else the factor before were longer."""
    n, f = len(codes), end - begin
    low = max(0, begin - 2 * before - f)
    left, right = codes[low:begin], codes[begin:end]
    back, k = left[::-1], begin - low
    suffix = extensions([*back, -1, *right[::-1], *back])  # common suffixes with codes[:begin]
    prefix = extensions([*right, -1, *left, *right])  # common prefixes with codes[begin:end]
    for q in range(1, f + 1):  # a whole period stands right of the border
        ls, lp = suffix[k + 1 + f - q], prefix[q] if q < f else 0
        if ls + lp >= q:
            yield from _whole(codes, n, begin - min(ls, k), begin + q + lp, q)
    for q in range(1, min(k, before + f - 1) + 1):  # or left of it
        ls, lp = suffix[q] if q < k else 0, min(prefix[f + 1 + k - q], f)
        if lp and ls + lp >= q:
            yield from _whole(codes, n, begin - q - ls, begin + lp, q)


def _whole(codes: list[int], n: int, start: int, end: int, q: int) -> Iterator[tuple[int, int, int]]:
    if (start == 0 or codes[start - 1] != codes[start - 1 + q]) and (end == n or codes[end] != codes[end - q]):
        yield start, end, q


def runs_of(codes: list[int], min_length: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least min_length codes and two periods, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    by_start: list[tuple[int, int]] = []

    def add(start: int, end: int, q: int) -> None:
        if end - start >= max(min_length, 2 * q):
            if (start, end) not in found:
                insort(by_start, (start, end))
            found[start, end] = min(q, found.get((start, end), q))

    before = 0
    for begin, length, source in factors(codes):
        end, shift = begin + length, begin - source
        if before and 2 * (before + length) - 2 >= min_length:
            for run in at_border(codes, before, begin, end):
                add(*run)
        if length > min_length and source >= 0:
            k = bisect_right(by_start, (source + 1, -1))
            while k < len(by_start) and by_start[k][0] < source + length:
                start, stop = by_start[k]
                q = found[start, stop]
                if stop < source + length:
                    add(start + shift, stop + shift, q)
                elif end == len(codes) or codes[end] != codes[end - q]:  # cut where the factor ends
                    add(start + shift, end, q)
                k += 1
        before = length
    return sorted((s, e - s, q) for (s, e), q in found.items())


def covered(codes: np.ndarray, texts: np.ndarray, seed: int) -> list[tuple[int, int]]:
    """Stretches (begin, end) of codes that n-grams of `seed` codes cover which stand twice in their text, by hashes: a
    collision makes a stretch longer, never shorter."""
    n = len(codes) - seed + 1
    if n < 1:
        return []
    own = codes.astype(np.uint64)
    grams = texts[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(seed):
        grams = (grams ^ own[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    inside = texts[:n] == texts[seed - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(grams[at])]
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(codes) + 1, np.int32)
    edges[np.flatnonzero(twice)] += 1
    edges[np.flatnonzero(twice) + seed] -= 1
    held = np.cumsum(edges[:-1]) > 0
    new = held & ~np.r_[False, held[:-1] & (texts[1:] == texts[:-1])]
    begins = np.flatnonzero(new)
    ends = np.flatnonzero(held & ~np.r_[held[1:] & ~new[1:], False]) + 1
    return [*zip(begins.tolist(), ends.tolist(), strict=True)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12) -> DataFrame:
    """One row per row of docs: id_col, n_words, runs (array of start, length, period; by start, then period), collapsed.

    Words stand between ASCII white space and are numbered from 0. A run is a stretch with smallest period q and at
    least max(min_length, 2 * q) words that no neighbouring word extends keeping the period. collapsed: the words joined
    by one space, without those that a run holds after its first period. A null or empty text has no words, no runs and
    an empty collapsed text. Rows that repeat an identifier are each told by themselves; a null identifier is kept. Other
    columns play no part. One text is one task's: its words and the automaton of its longest repeated stretch must fit
    in memory.
    """
    if min_length < 1:
        raise ValueError("min_length must be 1 or more")
    small_batches(docs.sparkSession)
    seed = -(-min_length // 2)  # a run of period q repeats max(q, min_length - q) words at least

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text"):
            words = words_of(batch["text"], lower=False)
            starts, index = words.starts, words.index
            texts = np.repeat(np.arange(len(starts)), words.counts)
            kept = np.ones(len(index), bool)
            runs, n_runs = [], np.zeros(len(starts), np.int64)
            for begin, end in covered(index, texts, seed):
                if end - begin < min_length:
                    continue
                of_text = texts[begin]
                for start, length, q in runs_of(index[begin:end].tolist(), min_length):
                    kept[begin + start + q : begin + start + length] = False
                    runs.append((begin + start - starts[of_text], length, q))
                    n_runs[of_text] += 1
            left = np.bincount(texts[kept], minlength=len(starts))
            kept_words = words.distinct.take(pa.array(index[kept]))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)], pa.int32()), kept_words), " ")
            columns = np.array(runs, np.int64).reshape(-1, 3).T
            flat = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=[*RUN])
            of_texts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_runs)], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(words.counts), of_texts, collapsed], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(find, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)
