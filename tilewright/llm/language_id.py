"""Language identification with blended-spectrum string kernels.

A text is the set of byte n-grams (1 to 3) of its letters; the kernel of two texts is the number of n-grams that both
hold over the geometric mean of their sizes. Nyström landmarks, whole training texts of every language, span the
feature space; one-versus-rest kernel ridge regression gives a weight to each landmark and language. A batch of texts
is scored by two matrix products: presence by landmarks, then kernel values by weights.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.scratch import small_batches, stored
from tilewright.llm.workers import lean

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes of a text after lower-casing: ASCII letters and bytes of longer UTF-8 sequences stay, all else is a space.
_KEPT = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_ALPHABET = sorted({*_KEPT.lower()})
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[_ALPHABET] = np.arange(len(_ALPHABET))
ORDERS = 3
#: Landmarks of all languages together; with many languages each has fewer, and one at least.
MOST_LANDMARKS = 4096
#: Documents of one product of presence by landmarks.
ROWS = 128
#: A text is of none of the languages if the share of its n-grams that any landmark holds is under LEAST_SHARE of what
#: all but this quantile of its best language's labelled sample reach.
LEAST_SHARE, LOWEST = 0.75, 0.01


def ngram_codes(text: str) -> np.ndarray:
    """The distinct byte n-grams of a whole text: numbers in the alphabet's base, shorter n-grams first."""
    raw = _SYMBOL[np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_KEPT) + b" ", np.uint8)]
    size, first, code, codes = len(_ALPHABET), 0, raw, [raw]
    for n in range(2, ORDERS + 1):
        first += size ** (n - 1)
        code = code[:-1] * size + raw[n - 1 :]
        codes.append(code + first)
    return np.unique(np.concatenate(codes))


def _n_codes() -> int:
    return sum(len(_ALPHABET) ** n for n in range(1, ORDERS + 1))


@dataclass
class KernelModel:
    languages: list[str]
    codes: np.ndarray  # sorted, of the n-grams that any landmark holds: the columns of `landmarks`
    landmarks: np.ndarray  # landmark by n-gram presence
    norms: np.ndarray  # square roots of the landmarks' sizes
    weights: np.ndarray  # landmark by language
    least: np.ndarray  # by language: the least share of known n-grams of a text of it

    def __getstate__(self) -> dict:
        """Travels without the table of places and with a bit for each presence."""
        return {k: v for k, v in self.__dict__.items() if k != "place"} | {"landmarks": np.packbits(self.landmarks > 0, axis=1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"landmarks": np.unpackbits(state["landmarks"], axis=1, count=len(state["codes"])).astype(np.float32)}

    @functools.cached_property
    def place(self) -> np.ndarray:
        """code -> column of `landmarks`, -1 for n-grams of no landmark; made once in each process."""
        place = np.full(_n_codes(), -1, np.int32)
        place[self.codes] = np.arange(len(self.codes))
        return place

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (as their codes) by landmarks: one product."""
        presence = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        for row, codes in zip(presence, texts, strict=True):
            at = self.place[codes]
            row[at[at >= 0]] = 1
        sizes = np.sqrt([max(1, len(x)) for x in texts])
        return presence @ self.landmarks.T / sizes[:, None] / self.norms

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel([ngram_codes(x) for x in texts]) @ self.weights

    def share(self, codes: np.ndarray) -> float:
        """Share of a text's n-grams that any landmark holds."""
        return (self.place[codes] >= 0).mean()

    def known(self, texts: list[str | None]) -> list[bool]:
        """Whether each text is of any of the languages: it holds a letter, and enough of its n-grams are known for the
        language that it resembles most. The regression can't tell: it has no intercept, so a text unlike all landmarks
        gets outputs near 0, as one in a mixture of the languages does."""
        found = [False] * len(texts)
        told = [k for k, x in enumerate(texts) if x and _LETTER.search(x)] if self.languages else []
        for k in range(0, len(told), ROWS):
            own = told[k : k + ROWS]
            codes = [ngram_codes(texts[i]) for i in own]
            best = (self.kernel(codes) @ self.weights).argmax(axis=1)
            for i, c, b in zip(own, codes, best, strict=True):
                found[i] = bool(self.share(c) >= self.least[b])
        return found

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """Language and score from 0 to 1 (the regression's output for it, -1 to 1, moved there). Texts that are null or
        hold no letter are undetermined, with score 0."""
        language, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        told = [k for k, x in enumerate(texts) if x and _LETTER.search(x)] if self.languages else []
        for k in range(0, len(told), ROWS):
            own = told[k : k + ROWS]
            found = self.scores([texts[i] for i in own])
            best = found.argmax(axis=1)
            for i, b, s in zip(own, best, found.max(axis=1), strict=True):
                language[i], score[i] = self.languages[b], np.clip((s + 1) / 2, 0, 1)
        return pd.DataFrame({"lang_pred": language, "score": score})


def held_out_column(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 192, landmarks: int = 48, ridge: float = 0.05) -> KernelModel:
    """Fits on a bounded sample of labelled rows: of each language the per_language documents whose hashed identifiers
    are smallest; the first `landmarks` of them are landmarks (fewer where there are so many languages that they would be
    over MOST_LANDMARKS). Texts are used whole. Only the samples' distinct n-gram codes reach the driver."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(7)).alias("order"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # the hash below which a language has about twice its sample: no task ranks a whole language
    counts = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    if (n_languages := counts.count()) > MOST_LANDMARKS:
        raise ValueError(f"{lang_col} has more than {MOST_LANDMARKS} values")
    landmarks = min(landmarks, MOST_LANDMARKS // max(1, n_languages))
    below = F.when(F.col("n") <= 4 * per_language, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(2.0**64) * 2 * per_language / F.col("n")).cast("long"))
    near = rows.join(F.broadcast(counts.select("lang", below.alias("below"))), "lang").where(F.col("order") <= F.col("below")).drop("below")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "id"))).where(F.col("rank") <= per_language)

    @F.pandas_udf("array<int>")
    def codes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lean(texts):
            yield batch.map(ngram_codes)

    sample = stored(ranked.select("lang", "rank", codes("text").alias("codes")), "languages").orderBy("lang", "rank").toPandas()
    return fit(sample, landmarks, ridge)


def fit(sample: pd.DataFrame, landmarks: int, ridge: float) -> KernelModel:
    """sample: lang, rank (from 1 within the language) and codes of each text."""
    languages = sorted(sample["lang"].unique())
    marks = [np.asarray(x) for x in sample.loc[sample["rank"] <= landmarks, "codes"]]
    known = np.unique(np.concatenate([np.zeros(0, np.int32), *marks]))
    presence = np.zeros((len(marks), len(known)), np.float32)
    for row, codes in zip(presence, marks, strict=True):
        row[np.searchsorted(known, codes)] = 1
    model = KernelModel(languages, known, presence, np.sqrt([max(1, len(x)) for x in marks]), np.zeros((len(marks), len(languages))), np.zeros(len(languages)))
    if not marks:
        return model
    among, vectors = np.linalg.eigh(model.kernel(marks).astype(float))
    good = among > 1e-6 * among.max()
    root = vectors[:, good] / np.sqrt(among[good])  # kernel values times this: coordinates in the landmarks' space
    features = model.kernel([np.asarray(x) for x in sample["codes"]]).astype(float) @ root
    targets = np.where(sample["lang"].to_numpy()[:, None] == np.array(languages), 1.0, -1.0)
    share = 1 / sample.groupby("lang")["lang"].transform("size").to_numpy()  # every language weighs the same
    gram = features.T @ (features * share[:, None])
    model.least = least_shares(sample, model, landmarks)
    model.weights = root @ np.linalg.solve(gram + ridge * np.eye(gram.shape[0]) * np.trace(gram) / len(gram), features.T @ (targets * share[:, None]))
    return model


def least_shares(sample: pd.DataFrame, model: KernelModel, landmarks: int) -> np.ndarray:
    """The cut of each language from its sample; a landmark's own n-grams count only if another landmark holds them."""
    holders = model.landmarks.sum(axis=0)
    shares = [
        (holders[at[at >= 0]] > (rank <= landmarks)).sum() / max(1, len(at)) for rank, at in zip(sample["rank"], map(model.place.__getitem__, sample["codes"]), strict=True)
    ]
    by_language = pd.Series(shares, sample.index).groupby(sample["lang"])
    return LEAST_SHARE * by_language.quantile(LOWEST).reindex(model.languages).to_numpy()


def identify(docs: DataFrame, model: KernelModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced). Any text that is null or holds no letter is
    `und` with score 0; texts are read whole. With no labelled row to learn from, every text is `und`."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # grows with the number of languages alone

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in lean(texts):
            yield held.value.predict([*batch])

    made = docs.drop("lang_pred", "score").withColumn("__told", told(F.col(text_col)))
    return made.select("*", "__told.lang_pred", "__told.score").drop("__told")


def of_known_language(docs: DataFrame, model: KernelModel, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is of any of the model's languages."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lean(texts):
            yield pd.Series(held.value.known([*batch]), dtype=bool)

    return docs.where(known(F.col(text_col)))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: float) -> DataFrame:
    """docs with held_out, lang_pred and score: learns from the labelled documents that are not held out (by the CRC-32
    of the identifier) and predicts for all. A null identifier is never held out."""
    model = train(docs.where(~held_out_column(F.col(id_col))), id_col, text_col, lang_col, **bounds)
    return identify(docs, model, text_col).withColumn("held_out", held_out_column(F.col(id_col)))
