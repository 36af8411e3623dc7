"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame functions only.

Every input partition is a run of digests: each of its texts once, with the identifier that stays and the number of its
rows. Runs meet in binomial rounds: in round r the nodes whose number has bit r set hand their runs to the nodes without
it. Both runs are put in order by the texts' verified identity and merged side by side in one pass over the sorted rows;
of a text that both hold, the identifier that stays is retained and the numbers of rows are added up. The root holds
every text once. A node's run is dealt over tasks by digest, so no task ever holds a whole run, and a merge meets two
rows of a text at most. The winners then go back to the runs, so that a text that makes up a third of all rows is met
once a run and never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.scratch import stored

#: A text is known by its SHA-256 and verified by its length and a second, unrelated hash.
IDENTITY = ["digest", "n_bytes", "second"]


def digest_runs(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """One row per document: id, the identity of its text and the run (input partition) it came from."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("second"),
        F.spark_partition_id().alias("run"),
    )


def merge_round(runs: DataFrame, keep: str) -> DataFrame:
    """One round: nodes 2k and 2k + 1 bring their runs (node, identity, keep_id, group_size) together at node k. Rows of
    a text stand next to each other in the sorted order, that with the identifier that stays first."""
    best = F.col("keep_id").asc_nulls_last() if keep == "smallest" else F.col("keep_id").desc_nulls_last()
    met = runs.withColumn("node", F.shiftright("node", 1)).repartition("node", "digest").sortWithinPartitions("node", *IDENTITY, best)
    text = Window.partitionBy("node", *IDENTITY).orderBy(best)
    both = text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = met.withColumns({"place": F.row_number().over(text), "group_size": F.sum("group_size").over(both)})
    return merged.where("place = 1").drop("place")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as the empty text. keep is "smallest" or "largest": the
    identifier that stays. Rows that repeat both identifier and text are one document and share one result, each of
    them counted in group_size. Rows without an identifier stay only where no row of their text has one. Other
    columns of docs play no part. An empty table gives an empty result.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = stored(digest_runs(docs, id_col, F.coalesce(F.col(text_col), F.lit(""))), "digests")
    leaves = rows.groupBy(F.col("run").alias("node"), *IDENTITY).agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    nodes = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = leaves
    while nodes > 1:
        level, nodes = merge_round(level, keep), (nodes + 1) // 2
    winners = level.drop("node")
    by_run = leaves.select("node", *IDENTITY).join(winners, IDENTITY).withColumnRenamed("node", "run")
    return rows.join(by_run, ["run", *IDENTITY]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
