import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe, language_id, maxent_lm, registry, words

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return byte_bpe.encoder(*BPE)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=byte_bpe.read_ranks(BPE[0]), special_tokens={})


ODD = st.text(st.one_of(st.sampled_from(" '  \n\t sStTrReEvVlLdD ab1é٣ß日!?"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(text=ODD)
def test_encoding_is_the_librarys(own, library, text):
    packed = own.packed(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decoded(packed) == text.encode()


@settings(max_examples=200, deadline=None)
@given(text=ODD, new=ODD, at=st.tuples(st.integers(0, 40), st.integers(0, 40)), more=st.sampled_from(["", "l", "'", " x", "ll", "\n"]))
def test_edits_and_appends_are_exact(own, library, text, new, at, more):
    start, end = sorted(min(x, len(text)) for x in at)
    edited = byte_bpe.EditableEncoding(own, text)
    edited.edit(start, end, new)
    edited.append(more)
    assert edited.tokens() == library.encode_ordinary(text[:start] + new + text[end:] + more)


def test_prefix_table(own, library):
    table = byte_bpe.PrefixTable(own.vocabulary, b" tokenization")
    assert all(table.tokens(k) == library._core_bpe.encode_single_piece(table.piece[:k]) for k in range(1, len(table.piece) + 1))
    table.append(b"al")
    table.edit(3, 5, b"KEN")
    assert table.tokens() == library._core_bpe.encode_single_piece(b" toKENnizational")


def test_bpe_over_documents(spark, docs, texts, library, empty):
    ids = docs.select("doc_id", byte_bpe.bpe_encode(F.col("text"), *BPE).alias("p"))
    got = {r[0]: (r[1], r[2], r[3]) for r in ids.select("doc_id", "p", byte_bpe.bpe_decode(F.col("p"), *BPE), byte_bpe.token_count(F.col("p"))).collect()}
    for k, x in texts:
        want = library.encode_ordinary(x or "")
        assert np.frombuffer(got[k][0], "<u4").tolist() == want
        assert (bytes(got[k][1]), got[k][2]) == ((x or "").encode(), len(want))
    assert empty.select(byte_bpe.bpe_encode(F.col("text"), *BPE)).count() == 0


def test_op2_digests(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in registry.op2_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for k, x in rows:
        ids = library.encode_ordinary(x or "")
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()


def test_kernel_is_the_brute_force_one():
    a, b = "Ça va, the cat", "the CAT sat"

    def grams(x):
        raw = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in (" " + x.lower() + " ").encode())
        return {raw[k : k + n] for n in (1, 2, 3) for k in range(len(raw) - n + 1)}

    import pandas as pd

    sample = pd.DataFrame({"lang": ["fr", "en"], "rank": [1, 1], "codes": [language_id.ngram_codes(a), language_id.ngram_codes(b)]})
    model = language_id.fit(sample, 4, 0.1)
    got = model.kernel([language_id.ngram_codes(x) for x in (a, b)])
    assert sorted(map(len, (grams(a), grams(b)))) == sorted(map(len, sample["codes"]))
    want = [[len(grams(x) & grams(y)) / math.sqrt(len(grams(x)) * len(grams(y))) for y in (a, b)] for x in (a, b)]
    assert np.allclose(got, want, atol=1e-6)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = registry.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(told) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in told)
    held = [r for r in told if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_language_of_odd_documents(docs, texts, empty):
    got = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert {k for k, r in got.items() if r["lang_pred"] == "und"} == {3, 4, 7}
    assert all(got[k]["score"] == 0 for k in (3, 4, 7))
    assert language_id.language_id(empty).count() == 0
    unlabelled = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


@pytest.mark.parametrize("frequent", [maxent_lm.FREQUENT, 50])
def test_lm_counts_are_exact_and_held_out_texts_gain(spark, monkeypatch, frequent):
    monkeypatch.setattr(maxent_lm, "FREQUENT", frequent)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in maxent_lm.lm_scores(docs).collect()}
    texts = {k: (x or "").encode().lower().split() + [b"\n"] for k, x in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = Counter(w for k, own in texts.items() if not held[k] for w in own)
    n, v = sum(counts.values()), len(counts)
    for k, own in texts.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
    gain = [(got[k]["score"] - got[k]["base_score"]) / len(own) for k, own in texts.items() if held[k]]
    assert np.mean(gain) > 0.1


def test_lm_of_odd_documents(docs, texts, empty):
    got = {r["doc_id"]: r for r in maxent_lm.lm_scores(docs).collect()}
    assert len(got) == len(texts)
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == 1
    assert all(r["score"] < 0 for r in got.values())
    assert maxent_lm.lm_scores(empty).count() == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    weights = rng.standard_normal((1 << 10, maxent_lm.CLASSES)).astype(np.float32)
    rows = rng.integers(0, 1 << 10, (5, maxent_lm.FEATURES)).astype(np.int32)
    total = sum(10 ** maxent_lm.log10_of(weights, rows, np.full(5, c)) for c in range(maxent_lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-5)


def test_groups_of_a_class_hold_like_shares():
    counts = np.array([50, 1, 25, 2, 9, 7, 5, 1])
    of_class = np.array([0, 0, 0, 0, 1, 1, 1, 1])
    groups = maxent_lm.deal_groups(of_class, counts, np.array([78, 22] + [0] * (maxent_lm.CLASSES - 2)))
    share = [0, 77 / 78, 50 / 78, 75 / 78, 0, 9 / 22, 16 / 22, 21 / 22]
    assert groups.tolist() == [int(x * maxent_lm.GROUPS) for x in share]


def test_tokens_are_those_of_plain_python(texts):
    rows = [x for _, x in texts] + [" a  B\tc\x0b\x1cd ", "\n", "É é\x85x\u3000y"]
    for most in (1 << 23, 10):
        got = []
        for part in words.parts_of(pa.array(rows), most):
            own = words.words_of(part)
            distinct = [bytes(x) for x in words.each_bytes(own.distinct)]
            told = [distinct[k] for k in own.index]
            got += [told[a : a + n] for a, n in zip(own.starts, own.counts)]
        assert got == [(x or "").encode().lower().split() for x in rows]


def test_models_of_repeated_rows_without_identifiers(spark):
    rows = [(None, "one two", "en"), (None, "one two", "en"), (2, "three", "fr"), (2, "three", "fr"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    scored = maxent_lm.lm_scores(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in scored) == [(0, 3), (0, 3), (2, 1), (2, 2), (2, 2)]
    assert len({(r["doc_id"], r["n_tokens"], r["score"]) for r in scored}) == 3
    told = language_id.language_id(docs).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in told) == [(0, "en"), (0, "en"), (2, "fr"), (2, "fr"), (2, "und")]
    ids = docs.select("doc_id", byte_bpe.bpe_encode(F.col("text"), *BPE).alias("p")).collect()
    assert len({bytes(r["p"]) for r in ids if r["doc_id"] is None}) == 1 and len(ids) == 5
