"""Language-model scoring with a hashed maximum-entropy model.

The probability of a word is that of its class given the words before it, times that of its group within the class given
the same words, times its share of the group. Both factors are softmaxes over hashed features: a bias, the word before
(bigram), the classes of the two words before (trigram) and the word two before (skip); in the second factor each of
them is joined with the class. Classes put together word endings that stand next to the same endings in training text.
The words of a class are dealt to its groups from the most frequent one on, each group with a like share of the class's
tokens: the groups of frequent words hold one or a few words. The share is smoothed by one count for each word, and one
is left for unknown words, which are in the last group.

Counts and neighbours come from all training documents in one pass. Weights come from rounds of gradient updates: in
each, tasks step through their documents from the common weights, and what they moved is averaged row by row. Every
training document takes part in every round, with other stretches of its tokens. Rows of weights are in proportion to
the words that training text holds often enough to be a context of their own, within LEAST_ROWS and MOST_ROWS.

Words are known by 55 bits of their hash and 9 bits of their ending's hash: two of 10 million distinct words fall
together with probability 0.001.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.scratch import stored
from tilewright.llm.words import each_bytes, gathered, spans, words_of

CLASSES, GROUPS, ENDINGS = 32, 32, 512
FEATURES = 4
#: Bytes of text that a task holds as arrays of tokens at once.
HELD_BYTES = 1 << 22
ROUNDS, STEP, BATCH = 2, 0.5, 8192
#: Tokens of a document that go to one round together.
STRETCH = 64
#: Runs of equal features in a batch that are added up row by row.
SHORT = 6
#: A word met so often is a context of its own; others count as one with the words of their ending.
CONTEXT = 24
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 16  # numbers of 16 bits sort fastest
SEGMENT = 1 << 11  # rows of the weights that move as one
#: Words whose counts every task holds: at most so many, the most frequent ones. All others are joined.
FREQUENT = 1 << 18
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n") | ENDINGS - 1)  # no word holds white space


@dataclass
class Tokens:
    """The tokens of a batch of texts: words, and an end after each text."""

    codes: np.ndarray  # of the distinct tokens; the end is the last
    index: np.ndarray  # of each token in `codes`
    counts: np.ndarray  # tokens of each text

    @property
    def places(self) -> np.ndarray:
        """The place of each token in its text."""
        return np.arange(len(self.index)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)


def endings(words: pa.StringArray) -> np.ndarray:
    """The hash of each word's last two letters; the end alone has the last number."""
    last = pc.utf8_slice_codeunits(pc.utf8_rtrim(words, ".,;:!?|\"')"), -2).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(x) % (ENDINGS - 1) for x in each_bytes(last.dictionary)], np.uint64)
    return hashes[last.indices.to_numpy()]


def tokens_of(texts: pa.Array) -> Tokens:
    words = words_of(texts)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, each_bytes(words.distinct)), np.uint64, len(words.distinct))
    codes = hashes & ~np.uint64(ENDINGS - 1) | endings(words.distinct) if len(hashes) else hashes
    index = np.insert(words.index.astype(np.int64), np.cumsum(words.counts), len(codes))
    return Tokens(np.append(codes, END), index, words.counts + 1)


def history(values: np.ndarray, begins: np.ndarray, back: int) -> np.ndarray:
    """values `back` places before, 0 where that is before the document's start."""
    out = np.zeros_like(values)
    out[back:] = values[:-back] if len(values) > back else values[:0]
    begins = begins[:, None] + np.arange(back)
    out[begins[begins < len(values)]] = 0
    return out


@dataclass
class Words:
    """What is known of the frequent words, sorted by code, and of the classes."""

    classes: np.ndarray  # of each ending
    codes: np.ndarray
    counts: np.ndarray
    groups: np.ndarray
    contexts: np.ndarray  # a number of its own, or -1
    room: np.ndarray  # by class and group: training tokens, distinct ones and in the last group one for what is unknown
    rows: int  # of the weights

    def of(self, tokens: Tokens) -> tuple[np.ndarray, ...]:
        """Class, group, context and count of each distinct token; -1 is the count of those that aren't frequent."""
        ending = (tokens.codes & np.uint64(ENDINGS - 1)).astype(np.int64)
        group, context, count = np.full(len(ending), GROUPS - 1), np.full(len(ending), -1), np.full(len(ending), -1)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, tokens.codes), len(self.codes) - 1)
            known = self.codes[at] == tokens.codes
            at = at[known]
            group[known], context[known], count[known] = self.groups[at], self.contexts[at], self.counts[at]
        return self.classes[ending], group, np.where(context < 0, ending, context + ENDINGS), count


def features(words: Words, tokens: Tokens, mine: np.ndarray | slice = slice(None)) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the class and for the group: the rows of the features of the tokens `mine` and which of the logits is each
    token's."""
    of_class, of_group, of_context, _ = words.of(tokens)
    own, begins = of_class.astype(np.uint32)[tokens.index], np.cumsum(tokens.counts) - tokens.counts
    context, before = (of_context + 1).astype(np.uint32)[tokens.index], own + np.uint32(1)
    w = [history(context, begins, k)[mine] for k in (1, 2)]
    c = [history(before, begins, k)[mine] for k in (1, 2)]
    own, group = own[mine], of_group[tokens.index[mine]]
    keys = [np.zeros_like(own), w[0], c[0] * np.uint32(64) + c[1], w[1]]
    out, top = [], np.uint32(33 - words.rows.bit_length())
    for level, label in enumerate((own.astype(np.int64), group)):
        rows = np.empty((len(own), FEATURES), np.uint16)
        for k, key in enumerate(keys):
            x = key * np.uint32(0x9E3779B1)
            if level:
                x += (own + np.uint32(1)) * np.uint32(0x85EBCA77)
            x += np.uint32(0x27D4EB2F * (k + 8 * level + 1) & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            rows[:, k] = x >> top
        out.append((rows, label))
    return out


def log10_of(weights: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log10 of the softmax at each token's own logit, in batches."""
    out = np.empty(len(own))
    for k in range(0, len(own), BATCH):
        z = _logits(weights, rows[k : k + BATCH])
        z -= z.max(axis=1, keepdims=True)
        mine = z[np.arange(len(z)), own[k : k + BATCH]].astype(float)
        out[k : k + BATCH] = (mine - np.log(np.exp(z, out=z).sum(axis=1))) / np.log(10)  # the same in any batch
    return out


#: Adds up a row in one product, whose last digits depend on the rows beside it: for learning alone.
ONES = np.ones(CLASSES, np.float32)


def _shared(rows: np.ndarray) -> bool:
    """Whether the first feature is the same for all: the bias of the first factor."""
    return bool((rows[:, 0] == rows[0, 0]).all())


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[:, 1]]
    for k in range(2, rows.shape[1]):
        z += weights[rows[:, k]]
    z += weights[rows[0, 0]] if _shared(rows) else weights[rows[:, 0]]
    return z


def summed(z: np.ndarray, of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows z[of], from each of `first` to before the next. Most runs are short: these are added up for all
    runs at once, first rows, second rows and so on."""
    length = np.diff(np.r_[first, len(of)])
    out = z[of[first]]
    for k in range(1, SHORT):
        at = np.flatnonzero((length > k) & (length <= SHORT))
        out[at] += z[of[first[at] + k]]
    long = np.flatnonzero(length > SHORT)
    if len(long):  # eights of rows at once, then what is left of each run
        eights = -(-length[long] // 8)
        ends = np.cumsum(eights)
        padded = np.full(8 * ends[-1], len(z), np.int64)  # no row
        padded[spans(8 * (ends - eights), length[long])] = of[spans(first[long], length[long])]
        rows = np.concatenate([z, np.zeros((1, z.shape[1]), z.dtype)])
        part = rows[padded[0::8]]
        for k in range(1, 8):
            part += rows[padded[k::8]]
        out[long] = np.add.reduceat(part, ends - eights, axis=0)
    return out


class Learner:
    """Gradient steps from the common weights; rows slow down as they gather gradients."""

    def __init__(self, weights: np.ndarray, step: float) -> None:
        self.weights, self.step = weights, step
        self.seen, self.square = np.zeros(len(weights), np.float32), np.full(len(weights), 1.0, np.float32)

    def learn(self, rows: np.ndarray, own: np.ndarray) -> None:
        for k in range(0, len(own), BATCH):
            r, y = rows[k : k + BATCH], own[k : k + BATCH]
            z = _logits(self.weights, r)
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= (z @ ONES)[:, None]
            z[np.arange(len(y)), y] -= 1
            if _shared(r):
                self._move(r[:1, 0], z.sum(axis=0, keepdims=True), len(r))
                r = r[:, 1:]
            flat = r.ravel()
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            self._move(flat[first], summed(z, order // r.shape[1], first), np.diff(np.r_[first, len(flat)]))

    def _move(self, at: np.ndarray, gradient: np.ndarray, times: np.ndarray | int) -> None:
        self.square[at] += np.einsum("ij,ij->i", gradient, gradient) * (4 / gradient.shape[1])
        gradient *= (self.step / np.sqrt(self.square[at]))[:, None]
        self.weights[at] -= gradient
        self.seen[at] += times


def cluster_endings(near: np.ndarray) -> np.ndarray:
    """A class for each ending: 0 for the end alone, the others by k-means of their neighbours."""
    near = near + near.T + 1e-3
    near[-1] = near[:, -1] = 1e-3
    total = near.sum(axis=1)
    pmi = np.log(near * near.sum() / total[:, None] / total)
    pmi = np.maximum(pmi, 0)[:-1]
    mass = total[:-1] / total[:-1].sum()
    u, s, _ = np.linalg.svd(pmi * np.sqrt(mass)[:, None], full_matrices=False)
    points = u[:, :16] * s[:16] / np.sqrt(mass)[:, None]
    random = np.random.default_rng(5)
    k = CLASSES - 1
    centres = points[random.choice(len(points), k, replace=False, p=mass)]
    for _ in range(30):
        near_to = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(k):
            if (own := near_to == c).any():
                centres[c] = np.average(points[own], axis=0, weights=mass[own])
    return np.r_[near_to + 1, 0].astype(np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """(kind, code, n): of kind 0 the tokens of the texts, of kind 1 neighbouring endings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros(ENDINGS * ENDINGS, np.int64)
        for batch in gathered(batches, "text", HELD_BYTES):
            tokens = tokens_of(batch["text"])
            ending = (tokens.codes & np.uint64(ENDINGS - 1)).astype(np.int64)[tokens.index]
            inside = tokens.index[:-1] < len(tokens.codes) - 1  # what follows an end is of the next text
            near += np.bincount((ending[:-1] * ENDINGS + ending[1:])[inside], minlength=len(near))
            yield told(0, tokens.codes.view(np.int64), np.bincount(tokens.index, minlength=len(tokens.codes)))
        at = np.flatnonzero(near)
        yield told(1, at, near[at])

    def told(kind: int, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int8)), pa.array(code), pa.array(n)], ["kind", "code", "n"])

    return texts.mapInArrow(count, "kind byte, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def gradient_round(texts: DataFrame, words: Words, weights: np.ndarray, turn: int) -> np.ndarray:
    """One round: tasks learn from their texts; each row of the weights moves by the mean of the tasks' moves, weighed
    by how often each met the row."""
    held = texts.sparkSession.sparkContext.broadcast((words, weights.astype(np.float16)))  # of bounded size
    step = STEP / (turn + 1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, common = held.value
        learner = Learner(common.astype(np.float32), step)
        for batch in gathered(batches, "text", HELD_BYTES):
            tokens = tokens_of(batch["text"])
            mine = np.flatnonzero(tokens.places // STRETCH % ROUNDS == turn)
            for rows, own in features(words, tokens, mine):
                learner.learn(rows, own)
        for k in range(0, words.rows, SEGMENT):
            at = np.flatnonzero(learner.seen[k : k + SEGMENT])
            if len(at):
                moved = learner.weights[k + at] - common[k + at]
                parts = at.astype(np.uint16), learner.seen[k + at], moved.astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([k // SEGMENT]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["segment", "at", "seen", "moved"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for segment, at, seen, moved in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                times, total = sums.setdefault(segment, [np.zeros(SEGMENT), np.zeros((SEGMENT, CLASSES))])
                at, seen = np.frombuffer(at, np.uint16), np.frombuffer(seen, np.float32)
                times[at] += seen
                total[at] += np.frombuffer(moved, np.float16).reshape(-1, CLASSES).astype(float) * seen[:, None]
        moved = [(total / np.maximum(times, 1)[:, None]).astype(np.float16).tobytes() for times, total in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int64()), pa.array(moved, pa.binary())], ["segment", "moved"])

    parts = texts.mapInArrow(learn, "segment long, at binary, seen binary, moved binary").repartition(words.rows // SEGMENT, F.col("segment"))
    weights = weights.copy()
    for segment, moved in parts.mapInArrow(merge, "segment long, moved binary").collect():  # as large as the weights
        weights[segment * SEGMENT : (segment + 1) * SEGMENT] += np.frombuffer(bytes(moved), np.float16).reshape(SEGMENT, CLASSES).astype(np.float32)
    held.destroy()
    return weights


def deal_groups(of_class: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The group of each frequent word: by how much of its class's tokens more frequent words hold."""
    order = np.lexsort((-counts, of_class))
    ends = np.cumsum(counts[order])
    first = np.searchsorted(of_class[order], np.arange(CLASSES))
    before = np.append(0, ends)[first]
    share = (ends - counts[order] - before[of_class[order]]) / np.maximum(totals[of_class[order]], 1)
    groups = np.empty(len(counts), np.int64)
    groups[order] = np.minimum((share * GROUPS).astype(np.int64), GROUPS - 1)
    return groups


def train(texts: DataFrame) -> tuple[Words, np.ndarray, DataFrame, int, int]:
    """From texts(text): what is known of words, the weights, the table (code, n) of words that aren't frequent, and how
    many tokens and distinct tokens there are."""
    counts = stored(count_words(texts), "counts")
    near = np.zeros((ENDINGS, ENDINGS))
    for code, n in counts.where("kind = 1").select("code", "n").collect():  # at most ENDINGS ** 2 rows
        near[divmod(code, ENDINGS)] = n
    classes = cluster_endings(near)
    words = counts.where("kind = 0").select("code", "n")
    of_endings = np.zeros((ENDINGS, 2), np.int64)
    for ending, n, v in words.groupBy((F.col("code").bitwiseAND(ENDINGS - 1)).alias("ending")).agg(F.sum("n"), F.count(F.lit(1))).collect():  # at most ENDINGS rows
        of_endings[ending] = n, v
    powers = range(41)
    above = words.agg(*[F.count_if(F.col("n") >= 1 << k) for k in powers]).first()
    least = next(1 << k for k in powers if above[k] <= FREQUENT or k == 40)
    found = words.where(F.col("n") >= least).toPandas()  # at most FREQUENT rows
    codes = found["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    codes, n = codes[order], found["n"].to_numpy(np.int64)[order]
    of_class = classes[(codes & np.uint64(ENDINGS - 1)).astype(np.int64)]
    totals = np.bincount(classes, of_endings[:, 0], CLASSES)
    groups = deal_groups(of_class, n, totals)
    room = np.bincount(of_class * GROUPS + groups, n + 1, CLASSES * GROUPS).reshape(CLASSES, GROUPS).astype(float)
    room[:, -1] += np.bincount(classes, of_endings.sum(axis=1), CLASSES) - room.sum(axis=1) + 1  # words that aren't frequent, and what is unknown
    contexts = np.where(n >= CONTEXT, np.cumsum(n >= CONTEXT) - 1, -1)
    rows = int(np.clip(1 << int(np.ceil(np.log2(1 + 8 * (contexts.max(initial=0) + 1)))), LEAST_ROWS, MOST_ROWS))
    known = Words(classes, codes, n, groups, contexts, np.maximum(room, 1), rows)
    weights = np.zeros((rows, CLASSES), np.float32)
    for turn in range(ROUNDS):
        weights = gradient_round(texts, known, weights, turn)
    tokens, distinct = of_endings.sum(axis=0).tolist()
    return known, weights, words.where(F.col("n") < least), tokens, distinct


def held_out_column(id_column: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words between ASCII white space, A-Z lower-cased, then one end; a null or empty text is the end
    alone. Scores are log10 probabilities of whole texts: base_score under counts of single tokens with one added,
    score under the model. Documents whose CRC-32 of the identifier, modulo 7, is 2 are held out; a null identifier is
    not. With nothing to learn from, every class is as likely and every word is unknown. Rows that repeat are scored
    each by itself. Other columns play no part. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held_out = held_out_column(F.col(id_col))
    words, weights, rare_words, n_tokens, n_distinct = train(docs.where(~held_out).select(F.col(text_col).alias("text")))
    held = spark.sparkContext.broadcast((words, weights.astype(np.float16)))  # at most FREQUENT words and the weights
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = held.value
        weights, room = weights.astype(np.float32), np.log10(words.room)
        for batch in gathered(batches, "text", HELD_BYTES):
            tokens = tokens_of(batch["text"])
            of_class, of_group, _, count = words.of(tokens)
            level = sum(log10_of(weights, rows, own) for rows, own in features(words, tokens)) - room[of_class, of_group][tokens.index]
            known = count[tokens.index] >= 0
            doc = np.repeat(np.arange(len(batch)), tokens.counts)
            logs = np.where(count < 0, 0.0, np.log10(np.maximum(count, 0) + 1))
            sums = [np.bincount(doc, x, len(batch)) for x in (known, logs[tokens.index], level)]
            pairs, times = np.unique(doc[~known] * len(tokens.codes) + tokens.index[~known], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(batch) + 1) * len(tokens.codes))
            rare = pa.StructArray.from_arrays([pa.array(tokens.codes[pairs % len(tokens.codes)].view(np.int64)), pa.array(times)], ["code", "times"])
            columns = [batch["id"], batch["held_out"], pa.array(tokens.counts), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)], ["id", "held_out", "n_tokens", "n_known", "counts", "level", "rare"])

    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, counts double, level double, rare array<struct<code:long,times:long>>")
    made = stored(made.withColumn("row", F.monotonically_increasing_id()), "scored")
    more = (
        made.select("row", F.inline("rare"))
        .join(rare_words, "code")
        .groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_counts"))
    )
    counts = F.col("counts") + F.coalesce("more_counts", F.lit(0.0))
    return made.drop("rare").join(more, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (counts - F.col("n_tokens") * F.lit(float(np.log10(n_tokens + n_distinct + 1)))).alias("base_score"),
        (counts + F.col("level")).alias("score"),
    )
