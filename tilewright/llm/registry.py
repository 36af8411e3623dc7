"""The queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.scratch import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.line_dedup import line_dedup

    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES["op1_line_dedup"] = op1_line_dedup
ORACLES["op1_line_dedup"] = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each_line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM each_line),
firsts AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
told AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS dropped FROM keyed LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against the tiktoken library (SQL can't express it)."""
    from tilewright.llm.byte_bpe import bpe_decode, bpe_encode, token_count

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    small_batches(spark)
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe_encode(F.col("text"), *vocabulary).alias("ids"))
    return ids.select(
        "doc_id",
        token_count(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe_decode(F.col("ids"), *vocabulary), 256).alias("decoded_sha256"),
    )


QUERIES["op2_byte_bpe"] = op2_byte_bpe


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base scores tested against brute force, the model by its gain on held-out texts (SQL can't express it)."""
    from tilewright.llm.maxent_lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES["op3_lm_scores"] = op3_lm_scores


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against the tokenizers library and for whole, gapless sequences (SQL can't express it)."""
    from tilewright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op4_packing"] = op4_packing


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


QUERIES["op6_exact_dedup"] = op6_exact_dedup
ORACLES["op6_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against brute force: SQL compares all pairs, which is too slow on whole tables."""
    from tilewright.llm.jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


QUERIES["op5_jaccard_join"] = op5_jaccard_join


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by held-out accuracy and against brute-force kernels (SQL can't express it)."""
    from tilewright.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES["op7_language_id"] = op7_language_id


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by round trips and brute force (SQL has no base32)."""
    from tilewright.llm.warc import read_archives, write_archives

    records = read_archives(write_archives(table(spark, sf_dir, "pages"), min_bytes=0))
    page = lambda urn: F.replace(urn, F.lit("urn:page:")).try_cast("long")  # noqa: E731  null for a page without identifier
    return records.select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to")
    )


QUERIES["op8_warc"] = op8_warc


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested for recall against brute force (an index can miss links; SQL compares all pairs)."""
    from tilewright.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES["op9_embedding_dedup"] = op9_embedding_dedup


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the byte-level BPE by source and language, after four commits over the whole table: first counts by
    bytes; then counts by BPE, which take the place of those by bytes; then counts revised by the end that closes each
    document; then the third commit again, which changes nothing. Tested against the tiktoken library."""
    from tilewright.llm.byte_bpe import bpe_encode, token_count
    from tilewright.llm.scratch import new_folder, stored
    from tilewright.llm.token_counts import TokenRollup

    small_batches(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    tokens = token_count(bpe_encode(F.col("text"), *vocabulary))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id()))  # rows without identifier stay apart
    counted = stored(docs.select(key.alias("id"), "source", "lang", size.alias("size"), tokens.alias("n")), "counted")
    change = lambda op, version, n: counted.select(F.lit(op).alias("op"), "id", "source", "lang", F.lit(version).alias("version"), n.alias("tokens"))
    rollup = TokenRollup(spark, new_folder(spark, "rollup"), "string")
    rollup.commit(1, change("insert", "bytes", F.col("size")))
    rollup.commit(2, change("insert", "byte_bpe_50k", F.col("n")).union(change("delete", "bytes", F.col("size"))))
    closed = change("revise", "byte_bpe_50k", F.col("n") + 1)
    rollup.commit(3, closed)
    rollup.commit(3, closed)
    return rollup.totals()


QUERIES["op10_token_counts"] = op10_token_counts


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against brute force (DuckDB has no CRC-32)."""
    from tilewright.llm.spelling import runs_of, spelling_variants

    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(runs_of(F.col("text"))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substring("run", at + F.lit(2), F.char_length("run")))
    words = runs.select(F.when(h % 97 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= 5)
    return spelling_variants(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3"))


QUERIES["op11_spelling_variants"] = op11_spelling_variants


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against brute force (SQL can't express it)."""
    from tilewright.llm.periodic_runs import periodic_runs

    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n, h = F.size(w), F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), turns), F.lit(1), n), " ")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(texts, min_length=12)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", "best.start", (-F.col("best.less")).alias("length"), "best.period", F.expr("-1000 * best.less div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES["op12_periodic_runs"] = op12_periodic_runs


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against the tokenizers library and by round trips (SQL can't express it)."""
    from tilewright.llm.token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(files).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES["op13_token_files"] = op13_token_files
