import base64
import gzip
import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tilewright.llm import byte_bpe, embedding_dedup, jaccard_join, packing, registry, warc
from tilewright.llm.scratch import new_folder
from tilewright.llm.token_counts import TokenRollup

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute_groups(texts, width, num, den):
    """Smallest reachable identifier and set size of each, from all pairs of tuples of words."""
    sets = {}
    for k, x in texts:
        w = (x or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), top(k)) for k, s in sets.items()}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_groups(spark, width, num):
    rng = np.random.default_rng(7)
    texts = []
    for k in range(40):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 60))]
        for _ in range(rng.integers(1, 6)):
            own = [f"x{rng.integers(9)}" if rng.random() < 0.02 else w for w in base]
            texts.append((len(texts), " ".join(own)))
    texts += [(900, None), (901, ""), (902, "one two"), (903, "ONE\ttwo"), (904, "one")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_groups(docs, width=width, num=num).collect()}
    assert got == brute_groups(texts, width, num, 100)


def test_jaccard_of_odd_documents(docs, texts, empty):
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == brute_groups(texts, 5, 80, 100)
    assert jaccard_join.jaccard_groups(empty).count() == 0


def test_bands_never_part_linked_sizes():
    bands = jaccard_join.Bands.of(80, 100)
    place = lambda n: jaccard_join.bisect_right(bands.starts, n) - 1
    for small in range(1, 3000):
        large = small * 100 // 80
        assert place(large) - place(small) <= 1
        assert bands.differ(place(small)) >= (small + large) * 20 // 180


def brute_links(ids, vectors, least):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    return dict(zip(ids, near.sum(axis=1).tolist(), strict=True)), near


def test_links_near_the_threshold_are_found(spark):
    """Pairs of cosines from 0.95 to 0.96 alone: what an index misses most."""
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v)
    rows = []
    for k in range(400):
        a = unit(rng.standard_normal(64))
        b = unit(rng.standard_normal(64))
        b = unit(b - (a @ b) * a)
        c = rng.uniform(0.951, 0.96)
        rows += [(2 * k, a), (2 * k + 1, c * a + math.sqrt(1 - c * c) * b)]
    table = spark.createDataFrame([(k, [float(x) for x in np.float32(v)], "x") for k, v in rows] + [(None, [1.0] * 64, "x"), (5, [-1.0] * 64, "x")], "vec_id long, embedding array<float>, n_links string")
    got = embedding_dedup.near_duplicates(table).collect()
    found = sum(r["n_links"] for r in got if r["component_id"] is not None)
    assert 0.9 * 800 <= found <= 800 and len(got) == 802 and sum(r["vec_id"] == 5 for r in got) == 2


def test_cap_height_holds_at_any_share():
    rng = np.random.default_rng(0)
    u = rng.standard_normal((400_000, 24))
    for share in (0.3, 0.01, 0.001):
        t = embedding_dedup.cap_height(24, share)
        assert np.mean(u[:, 0] > t * np.linalg.norm(u, axis=1)) == pytest.approx(share, rel=0.2)
    heights = [embedding_dedup.cap_height(64, 10.0**-k) for k in range(1, 12)]
    assert all(a < b for a, b in zip(heights, heights[1:], strict=False))


@pytest.mark.parametrize("block", [1024, 40])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 32))
    rows = [(k, base[k]) for k in range(300)]
    rows += [(1000 + k, base[k % 20] + rng.standard_normal(32) * 0.12) for k in range(200)]
    rows += [(2000 + k, base[5]) for k in range(100)]
    ids, vectors = [k for k, _ in rows], np.array([np.float32(v) for _, v in rows], np.float64)
    odd = [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] + [1.0] * 31), (5003, [None] + [1.0] * 31), (5004, []), (5005, [1.0, 2.0])]
    table = spark.createDataFrame([(k, [float(x) for x in np.float32(v)]) for k, v in rows] + odd, "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table).collect()}
    want, near = brute_links(ids, vectors, 0.95)
    assert sum(got[k]["n_links"] for k in ids) >= 0.9 * sum(want.values())
    assert all(got[k]["n_links"] <= want[k] for k in ids)
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k, _ in odd)
    assert got[2050]["component_id"] == 5
    assert embedding_dedup.near_duplicates(table.where("false")).count() == 0


def check_packed(rows, texts):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    ids = {k: [*tokenizer.encode(x or "", add_special_tokens=False).ids, 2] for k, x in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, own in ids.items():
        ends = [0]
        for start, length in sorted(pieces[k]):
            assert start == ends[-1]
            ends.append(start + length)
        assert ends[-1] == len(own)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return sum(map(len, ids.values())) / (4096 * len(sequences))


def test_packing(spark, docs, texts, empty):
    check_packed(packing.pack(docs, WORDS).collect(), texts)
    assert packing.pack(empty, WORDS).count() == 0
    whole = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert check_packed(registry.op4_packing(spark, "/root/testdata/sf0.01").collect(), whole) > 0.97


def test_packing_encodes_a_few_megabytes_at_once(monkeypatch):
    sizes, real = [], packing.text_ids
    monkeypatch.setattr(packing, "text_ids", lambda texts, *more: sizes.append(texts.nbytes) or real(texts, *more))
    texts = [f"word{k} and more " * 8000 for k in range(60)]  # 8 MB in batches of 0.5 MB
    batches = [pa.RecordBatch.from_pydict({"id": [k, k + 1, k + 2, k + 3], "text": texts[k : k + 4]}) for k in range(0, 60, 4)]
    cut = [*packing.cut_batches(iter(batches), public_tokenizers.path("word_bpe_49k.json"), 2, 4096, False)]
    assert max(sizes) < 3_000_000 and sum(sizes) > 7_000_000
    ids = [x for b in cut for x in b["id"].to_pylist()]
    assert ids == sorted(ids) and {*ids} == {*range(60)}
    assert sum(sum(b["length"].to_pylist()) for b in cut) == sum(n for b in cut for n, s in zip(b["doc_tokens"].to_pylist(), b["start"].to_pylist(), strict=True) if s == 0)


def test_packed_ids(docs):
    for r in packing.pack(docs, WORDS, keep_ids=True).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert len(r["ids"]) == 4 * r["length"]


@pytest.mark.parametrize("lengths", [[], [1] * 9000, [4096], [3000] * 7 + [1000] * 9 + [96] * 3, [2049] * 5, list(range(1, 4097))])
def test_histogram_packs_every_length(lengths):
    counts = Counter(lengths)
    patterns = packing.pack_histogram(counts, 4096)
    packed = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 4096
        for x in pattern:
            packed[x] += n
    assert packed == counts


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://é d", ""), (5, "u", "x" * 300_000), (6, "u", "ü" * 9), (None, "u", "<p>same</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, folder string").repartition(3)
    index = warc.write_archives(pages)
    got = {r["record_id"]: r for r in warc.read_archives(index).collect()}
    assert len(got) == len(rows)
    firsts = {}
    for k, _, html in rows:
        if k is not None:
            firsts[html or ""] = min(k, firsts.get(html or "", k))
    for k, _, html in rows:
        r, raw = got[warc.record_urn(k)], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        revisit = k is not None and firsts[html or ""] != k
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (warc.record_urn(firsts[html or ""]) if revisit else None)
        assert r["payload"] is None if revisit else bytes(r["payload"]) == raw
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_op8_over_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in registry.op8_warc(spark, SF).collect()}
    least = {}
    for p in pages:
        least[p["html"] or ""] = min(p["page_id"], least.get(p["html"] or "", p["page_id"]))
    assert all(got[p["page_id"]]["refers_to"] == (None if least[p["html"] or ""] == p["page_id"] else least[p["html"] or ""]) for p in pages)


def test_op8_over_odd_pages(spark, tmp_path):
    """Nulls, repeated identifiers and an empty table, through the query."""
    kind = "page_id long, url string, html string, record_type string"
    rows = [(None, "u", "a", "x"), (None, None, None, "x"), (4, "u", "a", "x"), (4, "v", "a", "x"), (7, "u", "a", "x"), (4, "u", "b", "x"), (9, "u", "", "x")]
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/some/pages.parquet")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in registry.op8_warc(spark, f"{tmp_path}/some").collect())
    assert got == [(0, 0, "response", 0), (0, 1, "response", 0), (4, 1, "response", 0), (4, 1, "response", 0), (4, 1, "response", 0), (7, 1, "revisit", 4), (9, 0, "response", 0)]
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert registry.op8_warc(spark, f"{tmp_path}/none").count() == 0


def test_reader_takes_foreign_records(monkeypatch):
    """Records of other kinds and makers, read in small steps."""
    monkeypatch.setattr(warc, "STEP_BYTES", 7)
    monkeypatch.setattr(warc, "READ_BYTES", 11)

    def record(fields, block):
        return gzip.compress("\r\n".join(["WARC/1.0", *fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    raw = record(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"software: x\r\n")
    raw += record(["WARC-Type: response", "WARC-Record-ID: <urn:a>", "Content-Type: application/http;msgtype=response", "WARC-Payload-Digest: sha1:" + "A" * 32], http)
    raw += record(["WARC-Type: metadata", "WARC-Record-ID: <urn:b>", "WARC-Block-Digest: md5:00"], b"z" * 100_000)
    raw += record(["WARC-Type: revisit", "WARC-Refers-To: <urn:a>", "Content-Type: application/http"], b"HTTP/1.1 200 OK\r\n\r\n")
    got = [*warc.read_records(io.BytesIO(raw))]
    assert [r[1] for r in got] == ["warcinfo", "response", "metadata", "revisit"]
    assert [r[5] for r in got] == [13, 13, 100_000, None]
    assert [r[4] for r in got] == [None, None, None, "urn:a"]
    assert got[2][6] == warc.base32_sha1(b"z" * 100_000)
    assert [r[0] for r in got] == [0, *[k for k in range(1, len(raw)) if raw[k : k + 3] == b"\x1f\x8b\x08"]]


def test_reader_refuses_damage():
    record = warc.record_bytes("response", "urn:page:1", "u", b"payload", warc.base32_sha1(b"payload"), None)
    assert [r[-1] for r in warc.read_records(io.BytesIO(record * 2))] == [b"payload"] * 2
    wrong = gzip.compress(gzip.decompress(record).replace(b"payload\r", b"PAYLOAD\r"))
    for bad in (record[:-9], wrong):
        with pytest.raises(ValueError, match="record|digest"):
            [*warc.read_records(io.BytesIO(bad))]


def test_rollup_deltas(spark):
    rollup = TokenRollup(spark, new_folder(spark, "rollup"))
    change = lambda rows: spark.createDataFrame(rows, "op string, id long, source string, lang string, version string, tokens long, seq int")
    state = lambda: sorted(((r["source"] or "", r["lang"] or "", r["documents"], r["tokens"]) for r in rollup.totals().collect()))
    first = change([("insert", 1, "a", "en", "v", 10, 0), ("insert", 2, "a", None, "v", 5, 0), ("insert", 3, "b", "en", "v", None, 0), ("insert", 3, "b", "en", "v", 7, 1)])
    assert rollup.commit(1, first)
    assert state() == [("a", "", 1, 5), ("a", "en", 1, 10), ("b", "en", 1, 7)]
    assert not rollup.commit(1, first)
    second = change([("revise", 1, "b", "en", "v", 11, 0), ("delete", 2, None, None, "v", None, 0), ("delete", 99, "a", "en", "v", 3, 0)])
    assert rollup.commit(2, second)
    assert state() == [("b", "en", 2, 18)]
    rollup.fold()
    assert state() == [("b", "en", 2, 18)]
    assert not rollup.commit(2, second)
    assert rollup.commit(3, first.where("false"))
    assert state() == [("b", "en", 2, 18)]
    assert TokenRollup(spark, new_folder(spark, "rollup")).totals().count() == 0


def test_rollup_reads_touched_buckets_and_applies_a_raced_batch_once(spark):
    rollup = TokenRollup(spark, new_folder(spark, "rollup"), buckets=4)
    change = lambda rows: spark.createDataFrame(rows, "op string, id long, source string, lang string, version string, tokens long")
    rows = [("insert", k, "a", "en", "v", 1) for k in range(40)] + [("insert", None, "a", "en", "v", 5), ("insert", 7, "a", "en", "v", 3), ("insert", 7, "a", "en", "v", 2)]
    assert rollup.commit(1, change(rows))
    plan = rollup.documents([0])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = 0", plan)
    late = TokenRollup(spark, rollup.folder, buckets=4)
    late._log = lambda: {"batch-000000000001": TokenRollup._log(rollup)["batch-000000000001"]}  # it looked before the other was done
    assert rollup.commit(2, change([("revise", 1, "a", "en", "v", 100)]))
    assert not late.commit(2, change([("revise", 1, "a", "en", "v", 100)]))
    total = rollup.totals().collect()
    assert [(r["documents"], r["tokens"]) for r in total] == [(41, 40 - 2 + 3 + 5 + 99 + 1)]


def test_op10_totals(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        own = want[r["source"], r["lang"]]
        own[0] += 1
        own[1] += len(library.encode_ordinary(r["text"] or "")) + 1
    got = {(r["source"], r["lang"]): [r["documents"], r["tokens"]] for r in registry.op10_token_counts(spark, SF).collect()}
    assert got == dict(want)


def test_pipeline_against_brute_force(spark):
    from test_dedup import brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "packing"]
    kept = [(r["doc_id"], r["text"]) for r in rows if any(c.isalpha() for c in r["text"])]
    lined = brute_lines(kept)
    texts = [(k, lined[k][0]) for k, _ in kept]
    groups = brute_groups(texts, 5, 80, 100)
    left = [(k, x) for k, x in texts if groups[k][1] == k]
    assert check_packed(corpus_pipeline.run(spark, SF).collect(), left) > 0.9
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0


@pytest.mark.parametrize("learned", [["en"], ["en", "fr"], ["de", "en", "es", "fr"]])
def test_pipeline_rejects_other_languages(spark, learned):
    rng = np.random.default_rng(11)
    scripts = {-1: "abcdefghijklmnopqrstuvwxyz", -2: "абвгдежзийклмнопрстуфхцчшщыьэюя", -3: "αβγδεζηθικλμνξοπρστυφχψω", -4: "".join(map(chr, range(0x4E00, 0x5E00)))}
    rows = [(k, " ".join("".join(rng.choice([*x], rng.integers(2, 10))) for _ in range(60)), None) for k, x in scripts.items()]
    rows += [(-5, "Все люди рождаются свободными и равными в своем достоинстве и правах.", None), (-6, "12 34 !!!", None), (-7, None, None)]
    clean = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isin(learned)).select("doc_id", "text", "lang")
    docs = clean.union(spark.createDataFrame(rows, clean.schema))
    assert {r[0] for r in corpus_pipeline.language(spark, docs, SF).select("doc_id").collect()} == {r[0] for r in clean.select("doc_id").collect()}


def test_stages_of_odd_rows(spark):
    """Null identifiers, repeated rows, ties, extra columns with clashing names: nobody's columns are touched."""
    text = "the same words stand here again and again so that they make a text\nand a second line of it"
    rows = [(None, text, "en", 7.0, "u", 3, "x"), (4, text, "en", 7.0, "u", 3, "x"), (4, text, "en", 7.0, "u", 3, "x"), (2, text, "en", 7.0, "u", 3, "x"), (9, None, None, 7.0, "u", 3, "x"), (8, "", "en", 7.0, "u", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, n_lines int, gone string").repartition(3)
    own = lambda df: sorted((r["doc_id"] or 0, r["score"], r["lang_pred"], r["n_lines"], r["gone"]) for r in df.collect())
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and own(kept) == [(k, 7.0, "u", 3, "x") for k in (0, 2, 4, 4)]
    lined = corpus_pipeline.lines(spark, docs, SF)
    assert lined.columns == docs.columns and own(lined) == [(k, 7.0, "u", 3, "x") for k in (0, 2, 4, 4, 8, 9)]
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == {None: text, 2: text, 4: "", 8: "", 9: ""}
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns and own(near) == [(k, 7.0, "u", 3, "x") for k in (0, 2, 8, 9)]
    packed = corpus_pipeline.packing(spark, docs, SF).collect()
    assert sorted(r["doc_id"] or 0 for r in packed) == [0, 2, 4, 4, 8, 9] and {r["doc_tokens"] for r in packed if r["doc_id"] in (8, 9)} == {1}


def test_jaccard_of_rows_without_or_with_repeated_identifiers(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (5, text + " more"), (5, text), (3, text), (None, "alone in the world of words"), (8, None)]
    got = sorted((r[0] or 0, r[1], r[2] or 0) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert got == [(0, 2, 0), (0, 36, 3), (3, 36, 3), (5, 36, 3), (5, 37, 3), (8, 0, 8)]


def test_packing_of_repeated_rows_without_identifiers(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b"), (1, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), WORDS).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 1, 1, 1] and {r["sequence_id"] for r in got} == {0}
    assert sorted(r["offset"] for r in got) == [0, *[sum(sorted((r["length"] for r in got), reverse=True)[:k]) for k in range(1, 5)]]


def test_vectors_without_identifier_are_links_of_others(spark):
    rng = np.random.default_rng(4)
    v, far = rng.standard_normal(24), rng.standard_normal(24)
    near = [v + rng.standard_normal(24) * 0.03 for _ in range(3)]
    rows = [(9, v), (None, near[0]), (7, near[1]), (None, near[2]), (None, far), (3, -v), (None, -v + 0.02)]
    table = spark.createDataFrame([(k, [float(x) for x in w]) for k, w in rows], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(table).collect())
    assert got == sorted([("9", 3, 7, False), ("7", 3, 7, True), ("3", 1, 3, True), *[("None", n, None, True) for n in (3, 3, 0, 1)]])


def test_texts_are_joined_only_to_pairs_that_may_link(spark, monkeypatch):
    """Texts that share a long passage meet on it; what their sketches tell apart is never verified on whole texts."""
    shared = [f"s{k}" for k in range(300)]
    rows = [(k, " ".join(shared + [f"d{k}w{i}" for i in range(200)])) for k in range(30)]
    rows += [(100 + k, rows[k][1].replace(f"d{k}w7 ", "another ")) for k in range(0, 30, 3)]
    pairs, verified = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda p, *more: pairs.append(p.count()) or verified(p, *more))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=5, num=80, den=100).collect()}
    assert got == {k: k % 100 for k, _ in rows}
    assert 10 <= sum(pairs) <= 20
