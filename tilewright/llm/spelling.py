"""Spelling variants: words at one edit from each other, found by a positional q-gram index with a count filter.

Two words at one edit share the first half of the shorter one or its last half, so words are dealt over tasks by their
halves. What is left of the words of such a group goes into an inverted index of bigrams by position and length. A word
looks its bigrams up at the positions that one edit leaves them; a heap merges the postings and keeps the words that
share as many bigrams as one edit must leave, and these are verified letter by letter. Groups of very many words are
dealt again by the halves of what they don't share.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.scratch import stored

#: Words of a group that one task indexes; larger groups are dealt again.
GROUP_WORDS = 20_000
#: Rows of groups that one task reads.
TASK_ROWS = 50_000
PAIRS = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])


def runs_of(text: Column, letters: str = "A-Za-zÀ-ÿ") -> Column:
    """The maximal runs of letters of a text, A-Z in lower case; none of a null text."""
    lower = lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{letters}]+"), F.lit(0)), lower)


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """The values that stand in at least so many of the sorted lists, by a heap of their heads. Where the smallest head
    can't reach that number, lists skip ahead to the first value that may."""
    k = len(lists)
    if k < least:
        return
    at = [0] * k
    heap = [x[0] * k + i for i, x in enumerate(lists)]
    heapify(heap)
    while len(heap) >= least:
        value = heap[0] // k
        heads = []
        while heap and heap[0] // k == value:
            heads.append(heappop(heap) % k)
        if len(heads) >= least:
            yield value
            value += 1
        else:
            while heap and len(heads) < least - 1:
                heads.append(heappop(heap) % k)
            if not heap:
                return
            value = heap[0] // k
        for i in heads:
            own = lists[i]
            at[i] = bisect_left(own, value, at[i])
            if at[i] < len(own):
                heappush(heap, own[at[i]] * k + i)


def one_edit(short: str, long: str) -> bool:
    """Whether one letter inserted into `short`, or replaced in it, gives `long` (as long, or longer by one)."""
    k = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short != long and short[k + (len(short) == len(long)) :] == long[k + 1 :]


def _shared(base: int, path: str) -> tuple[int, int, list[int]]:
    """How many first and last letters the words of a group share, and the numbers of first letters two of them must
    not share: such pairs are found in another group."""
    first, last, other = 0, 0, []
    for side in path:
        half = (base - first - last) // 2
        if side == "p":
            first += half
        else:
            other.append(first + half)
            last += half
    return first, last, other


def near_in_group(base: int, path: str, words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places in words, those of `base` letters before those with one more: one edit apart, of which the first
    has `base` letters."""
    first, last, other = _shared(base, path)
    n = sum(len(w) == base for w in words)
    left = base - first - last
    marked = [f"\0{w[first : len(w) - last]}\0" for w in words]
    same: list[dict[str, list[int]]] = [{} for _ in range(left + 1)]
    longer: list[dict[str, list[int]]] = [{} for _ in range(left + 3)]
    for i in range(n, len(words)):
        for p in range(left + 2):
            longer[p].setdefault(marked[i][p : p + 2], []).append(i)
    for i in range(n):
        grams = [marked[i][p : p + 2] for p in range(left + 1)]
        # a replaced letter leaves the other bigrams (all but two) where they were
        near = range(i) if left < 2 else merged([x for p, g in enumerate(grams) if (x := same[p].get(g))], left - 1)
        found = [*near]
        if n < len(words):  # an inserted one leaves all but one, where they were or one further
            found += merged([x for p, g in enumerate(grams) for x in (longer[p].get(g), longer[p + 1].get(g)) if x], left)
        for j in found:
            if one_edit(words[i], words[j]) and not any(words[i][:k] == words[j][:k] for k in other):
                yield i, j
        for p, g in enumerate(grams):
            same[p].setdefault(g, []).append(i)


def _dealt(members: DataFrame) -> DataFrame:
    """Members (word, n, base, path, first, last) with twice as many rows: by the first and by the last half of what
    their groups don't share."""
    half = F.floor((F.col("base") - F.col("first") - F.col("last")) / 2).cast("int")
    sides = [(F.lit("p"), F.col("first") + half, F.col("last")), (F.lit("s"), F.col("first"), F.col("last") + half)]
    both = F.array(*[F.struct(F.concat("path", s).alias("path"), a.alias("first"), b.alias("last")) for s, a, b in sides])
    dealt = members.select("word", "n", "base", F.explode(both).alias("to")).select("word", "n", "base", "to.*")
    return dealt.withColumn("key", F.concat_ws(" ", "base", "path", F.left("word", F.col("first")), F.right("word", F.col("last"))))


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """Words (word, n), each once -> (a, n_a, b, n_b): each pair of words that differ by exactly one inserted, deleted or
    replaced letter once, a not longer than b."""
    size = F.char_length("word")
    start = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("base"), F.lit("").alias("path"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    members = stored(_dealt(start.where("base > 0")), "halves")
    while True:
        sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("base") - F.col("first") - F.col("last")).alias("left")), "sizes")
        large = sizes.where((F.col("size") > group_words) & (F.col("left") > 1)).select("key")
        if large.isEmpty():
            break
        again = _dealt(members.join(large, "key", "left_semi"))
        members = stored(members.join(large, "key", "left_anti").select(*again.columns).union(again), "halves")
    rows = sizes.agg(F.sum("size")).first()[0] or 0

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [])
        each = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("key", "base", "path", "word", "n")), strict=True))
        for (_, base, path), group in groupby(each, lambda row: row[:3]):
            held = sorted((row[3:] for row in group), key=lambda x: (len(x[0]), x[0]))
            if len(held) > 1 and len(held[0][0]) == base:
                for i, j in near_in_group(base, path, [w for w, _ in held]):
                    for column, value in zip(out, (*held[i], *held[j]), strict=True):
                        column.append(value)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PAIRS, strict=True)], schema=PAIRS)
                out = ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PAIRS, strict=True)], schema=PAIRS)

    parts = members.repartition(max(1, -(-rows // TASK_ROWS)), "key").sortWithinPartitions("key")
    return parts.select("key", "base", "path", "word", "n").mapInArrow(find, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, in rounds that each double the steps. most: no chain
    has more steps than that."""
    led = stored(forms.select("word", F.col("form").alias("root")), "led")
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        further = led.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        led = stored(led.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root")), "led")
    return led


def spelling_variants(counts: DataFrame, word_col: str = "word", n_col: str = "n", ratio: int = 2, group_words: int = GROUP_WORDS) -> DataFrame:
    """Counted words -> word, form, root, n, n_near, form_n, a row for each distinct word.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. form: the near word of
    largest n (of equal ones the first in code-point order) if its n is at least `ratio` (2 or more) times the word's;
    null otherwise. form_n is its n, root what the forms lead to at last (the word itself where it has none). Rows that
    repeat a word are summed; null counts count as none; null and empty words have no row. Other columns play no part.
    """
    words = counts.select(F.col(word_col).alias("word"), F.coalesce(F.col(n_col), F.lit(0)).cast("long").alias("n")).where("word <> ''")
    words = stored(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = stored(near_words(words, group_words), "near")
    both = pairs.union(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    told = words.join(best, "word", "left")
    enough = (F.col("n") > 0) & (-F.col("best.less") >= ratio * F.col("n"))
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(enough, x).alias(c) for x, c in ((F.col("best.form"), "form"), (-F.col("best.less"), "form_n"))]), "forms")
    largest = told.agg(F.max("form_n")).first()[0] or 0
    led = roots(told.where("form IS NOT NULL").select("word", "form"), int(math.log(max(largest, 1), ratio)) + 1)
    return told.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
