"""Spelling variants, periodic runs and token files, each against brute force, a library or an exact round trip."""

import hashlib
import io
import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import periodic_runs, registry, spelling, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def near(a, b):
    """Exactly one edit, by the full table of edit distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1] == 1


def brute_variants(counts, ratio=2):
    of = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(of[w], key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best and n and counts[best] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(of[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def variants(df, **kw):
    rows = spelling.spelling_variants(df, **kw).collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {r["word"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("group_words", [20_000, 6])
def test_variants_are_those_of_brute_force(spark, group_words):
    rng = random.Random(5)
    letters = "abé"
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 8))): rng.randint(1, 40) for _ in range(260)}
    counts |= {"z" * 7 + x: 3 for x in "abcdefghij"} | {"long" * 9: 50, "long" * 9 + "x": 9, "lang" + "long" * 8: 4, "😀ab": 2, "😀b": 9}
    df = spark.createDataFrame([*counts.items()], "word string, n long").repartition(4)
    assert variants(df, group_words=group_words) == brute_variants(counts)


def test_variants_of_odd_rows(spark):
    df = spark.createDataFrame(
        [("house", 2, "x"), ("house", 3, "y"), ("mouse", None, "x"), ("mouse", 1, "x"), (None, 7, "x"), ("", 9, "x"), ("houses", 10, None)], "word string, n int, form string"
    )
    assert variants(df) == {"house": ("houses", "houses", 5, 2, 10), "mouse": ("house", "houses", 1, 1, 5), "houses": (None, "houses", 10, 1, None)}
    assert variants(df.where("false")) == {}
    tied = spark.createDataFrame([("caat", 1), ("cat", 4), ("cart", 4), ("zzzz", 0), ("zzz", 0)], "w string, k long")
    assert variants(tied, word_col="w", n_col="k")["caat"] == ("cart", "cart", 1, 2, 4)
    assert variants(tied, word_col="w", n_col="k")["zzzz"] == (None, "zzzz", 0, 1, None)


def test_roots_of_long_chains(spark):
    n = {"a" * (5 + k): 2**k for k in range(20)}
    got = variants(spark.createDataFrame([*n.items()], "word string, n long"))
    assert {v[1] for v in got.values()} == {"a" * 24}


def test_op11_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for key, text in docs:
        runs, own = [], ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                own += c
            elif own:
                runs.append(own.translate(low))
                own = ""
        for w in runs:
            h = zlib.crc32(f"{key}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 5:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    got = {r["word"]: tuple(r)[1:] for r in registry.op11_spelling_variants(spark, SF).collect()}
    assert {w: v[2] for w, v in got.items()} == counts
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    for w in random.Random(1).sample(sorted(counts), 60):  # of each a full comparison with all others
        of = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        best = min(of, key=lambda v: (-counts[v], v.encode()), default=None)
        form = best if best and counts[best] >= 2 * counts[w] else None
        assert got[w] == (form, got[form][1] if form else w, counts[w], len(of), counts[form] if form else None)


def brute_runs(w, least):
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                seen.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in seen.items() if e - s >= max(least, 2 * q))


def odd_words(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 50))]
    if rng.random() < 0.5:
        w += w[: rng.randint(0, len(w))] + [rng.randrange(3)] + w
    return w


def test_runs_are_those_of_brute_force():
    rng = random.Random(11)
    for _ in range(3000):
        w, least = odd_words(rng), rng.choice([1, 2, 5, 12])
        assert periodic_runs.runs_of(w, least) == brute_runs(w, least)


@pytest.mark.parametrize("least", [12, 4])
def test_periodic_runs_of_texts(spark, docs, empty, least):
    rng = random.Random(2)
    rows = [(k, " ".join("abc"[x % 3] + "A" * (x // 3) for x in odd_words(rng))) for k in range(300)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "a " * 5000), (None, "b " * 40), (5, "a\vb\f" * 20), (5, "x y " * 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).repartition(4)
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic_runs.periodic_runs(df, min_length=least).collect())
    want = Counter()
    for key, text in rows:
        w = [x.decode() for x in (text or "").encode().split()]  # bytes part at ASCII white space alone
        runs = brute_runs(w, least)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want[key, len(w), tuple(sorted(runs, key=lambda r: (r[0], r[2]))), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert got == want
    assert periodic_runs.periodic_runs(docs).count() == docs.count()
    assert periodic_runs.periodic_runs(empty).collect() == []


def test_op12_query(spark):
    got = {r["doc_id"]: r for r in registry.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for key, text in docs:
        w = [x.decode() for x in (text or "").encode().split()]
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if len(w) > 1200:
            continue
        runs = sorted(brute_runs(w, 12), key=lambda r: (r[0], r[2]))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (told, kept)]
        assert tuple(got[key])[1:] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests)
    assert planted


def test_blocks_go_there_and_back():
    rng = np.random.default_rng(5)
    for k in range(120):
        ids = rng.integers(0, rng.choice([1, 2, 10, 200, 70_000]), rng.integers(1, 2500)).astype("<u4")
        ids = np.tile(ids, rng.integers(1, 12)) if k % 3 == 0 else ids
        cut = int(rng.integers(0, len(ids) + 1))
        pieces = [(7, 0, ids[:cut]), (None, 0, ids[cut:])]
        raw = token_files.made_block(pieces).to_bytes()
        stream = io.BytesIO(raw + raw)
        for _ in range(2):
            block = token_files.Block.read(stream)
            assert (block.decoded() == ids).all() and block.sizes.tolist() == [cut, len(ids) - cut] and block.known.tolist() == [True, False]
        assert token_files.Block.read(stream) is None
        for _ in range(4):
            a, b = sorted(rng.integers(0, len(ids) + 3, 2).tolist())
            assert (block.ids_at(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        token_files.Block.read(io.BytesIO(raw[:-1]))


def test_frequent_pairs_are_replaced():
    ids = np.array([3, 4, 5, 6] * 200 + [9, 9] * 40, "<u4")
    symbols, rules, first = token_files.replace_pairs(ids)
    assert first == 10 and len(symbols) < len(ids) // 20
    assert all(a < first + k and b < first + k for k, (a, b) in enumerate(rules.tolist()))
    assert len(token_files.replace_pairs(np.arange(100, dtype="<u4"))[1]) == 0


def expected(rows):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return [(key, [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]) for key, text in rows]


@pytest.mark.parametrize(("block_ids", "file_bytes"), [(token_files.BLOCK_IDS, token_files.FILE_BYTES), (1000, 3000)])
def test_token_files_hold_all_documents(spark, docs, texts, block_ids, file_bytes):
    rows = [*texts, (None, "no identifier"), (5, "again"), (-3, "negative")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(texts) :], "doc_id long, text string")).withColumn("start", F.lit("clash"))
    files = token_files.write_token_files(more, WORDS, block_ids=block_ids, file_bytes=file_bytes)
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r["start"])
    assert Counter((r["id"], array("I", r["ids"]).tobytes()) for r in got) == Counter((k, array("I", ids).tobytes()) for k, ids in expected(rows))
    assert [r["id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in got:
        assert (r["start"], 4 * r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    assert files.count() > 1 or file_bytes > 10_000


def test_token_files_of_nothing(spark, empty):
    files = token_files.write_token_files(empty, WORDS)
    assert files.collect() == [] and token_files.read_token_files(files).collect() == []


def test_equal_rows_go_to_several_files(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 3000, "one text many times").otherwise(F.col("id").cast("string")).alias("text"))
    files = token_files.write_token_files(rows.repartition(4), WORDS, file_bytes=8_000).collect()
    assert len(files) >= 6 and max(f["n_documents"] for f in files) < 1500 and sum(f["n_documents"] for f in files) == 4000


def test_starts_of_many_files(spark):
    sizes = [(p, (p * 37) % 11) for p in range(50)]
    got = {r["part"]: r["start"] for r in token_files.with_starts(spark.createDataFrame(sizes, "part long, n_ids long"), together=8).collect()}
    assert got == {p: sum(n for k, n in sizes if k < p) for p, _ in sizes}


def test_op13_query(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for key, ids in expected(rows):
        want.append((key, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in registry.op13_token_files(spark, SF).collect()) == want
