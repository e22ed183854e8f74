"""Exact dedup by a tree merge of sorted digest runs.

Every input partition is a lane.  It sorts its digests and merges equal ones into entries: digest, best
identifier, number of rows.  In round r of log2(lanes) binomial rounds each lane exchanges runs with the
lane whose number differs in bit r: it sends the entries whose home (named by digest bits) lies on the other
side and gets those of its own side, sorts what came (runs in order) and merges entries of equal digest,
keeping the best identifier.  After the last round each digest is in its home lane in one entry.  A text
that fills a third of the table is one entry in each lane from the start, so it never gathers in one
place.  An entry stands for equal texts only if SHA-256, byte length and a second 64-bit hash all
agree at every level.

Rows learn their group by a join on the digest; groups of more than 1/``HOT`` of all rows (so fewer than
``HOT`` groups) are broadcast and their rows stay where they are.

Null texts count as empty.  Of repeated rows (same id and text) one is kept.  A row without id is
kept only if no row of its group has one.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

_ENTRY = ["_digest", "_length", "_second"]
HOT = 1000


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The id, a row number, the digests of each text and the columns ``carry``; no text."""
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    who = F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("_who")
    return docs.select(who, F.unhex(F.sha2(text, 256)).alias("_digest"), F.octet_length(text).alias("_length"), F.xxhash64(text).alias("_second"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])


def merge_runs(rows: DataFrame, keep: str = "max", lanes: int | None = None) -> DataFrame:
    """One row per distinct text: its entry, the identifier that stays (``_best``) and the group's size (``_n``)."""
    lanes = lanes or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(lanes - 1, 1).bit_length()
    best = F.max if keep == "max" else F.min
    # lane numbers are counted by their bits; a home is named by the first 32 bits of the digest
    home = F.conv(F.hex(F.substring("_digest", 1, 4)), 16, 10).cast("long")
    runs = rows.select((F.spark_partition_id() % F.lit(2**rounds)).cast("long").alias("_lane"), *_ENTRY, F.col("_who").alias("_best"), F.lit(1).cast("long").alias("_n"))
    merged = [best("_best").alias("_best"), F.sum("_n").alias("_n")]
    for r in range(rounds):
        bit = F.lit(1 << r)
        runs = runs.withColumn("_lane", F.col("_lane") - F.col("_lane").bitwiseAND(bit) + home.bitwiseAND(bit))
        if r:  # the first exchange leaves entries merged before it; later ones send what the last merge has left
            runs = runs.repartition(2**rounds, "_lane").sortWithinPartitions("_lane", *_ENTRY)
        runs = runs.groupBy("_lane", *_ENTRY).agg(*merged)
    return runs.drop("_lane")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=None, lanes: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the columns ``carry`` for every row."""
    rows = scratch(digest_rows(stored(docs), id_col, text_col, normalise, carry), "digests")
    groups = scratch(merge_runs(rows, keep, lanes), "groups")
    large = F.broadcast(groups.where(F.col("_n") * HOT > F.lit(rows.count())))  # fewer than HOT rows
    few = rows.join(large, _ENTRY)
    rest = rows.join(large.select(*_ENTRY), _ENTRY, "left_anti").join(groups, _ENTRY)
    return few.unionByName(rest).select(F.col("_who.id").alias("doc_id"), F.col("_best.id").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_best").eqNullSafe(F.col("_who")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def op5(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs.select("doc_id", "text"))


ORACLE = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
