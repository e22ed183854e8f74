"""Sharding by weighted rendezvous hashing of stable record keys.

For key k and shard i, u = hash(k, i) in (0, 1) and the score is -weight_i / ln(u); the shard with
the highest score takes the record.  Scores of the other shards don't change when a shard is
added, so an added shard only takes records into itself.

Places inside a shard (slots) are numbered without sending a shard to one task: a record falls
into one of ``blocks`` blocks by a hash of its key, blocks are numbered on their own, and the
blocks' counts (at most shards x blocks rows) give the offsets.

Null texts have size 1 (no bytes plus 1) and CRC 0.  Rows without key share the key ''.  Repeated
rows go to the same shard and get slots of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _unit(key: Column, salt: str) -> Column:
    """13 hex digits of an MD5 as a number strictly between 0 and 1."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), key)), 1, 13), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(16**13))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins ``key`` (a string column); of equal scores the smaller number."""
    scores = [F.struct((-F.lit(float(w)) / F.log(_unit(key, f"s{i}"))).alias("score"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*scores))["i"]).cast("int")


def shard_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0, blocks: int = 256) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, grown_weight]).alias("grown_shard"), F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("slot"), key)), 1, 8), 16, 10).cast("long").alias("_h"))
    rows = rows.withColumn("_block", F.col("_h") % blocks)
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # shards x blocks rows at most
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_h", "doc_id", "text_crc32", "size"))
    return rows.join(offsets, ["shard", "_block"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + inside - 1).cast("long").alias("slot"), "grown_shard")


def op6(docs: DataFrame) -> DataFrame:
    return shard_records(docs)


def _oracle() -> str:
    score = lambda i: f"-1.0e0 / ln((('0x' || substr(md5('s{i}:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5e0) / 4503599627370496e0)"
    scores = ", ".join(f"{score(i)} AS c{i}" for i in range(17))
    first = lambda n: "CASE " + " ".join(f"WHEN c{i} = greatest({', '.join(f'c{j}' for j in range(n))}) THEN {i}" for i in range(n)) + " END"
    return f"""
WITH RECURSIVE g(i, c, k) AS (SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS by_byte FROM g WHERE k = 8),
t AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce(text, '') AS text,
                  ('0x' || substr(md5('slot:' || doc_id), 1, 8))::BIGINT AS h, {scores} FROM documents),
u AS (SELECT *, CAST({first(16)} AS INTEGER) AS shard, CAST({first(17)} AS INTEGER) AS grown_shard FROM t)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ',')[:-2], lambda x: ('0x' || x)::BIGINT)),
           lambda a, b: xor(a >> 8, by_byte[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32, law, shard, slot, grown_shard FROM (
  SELECT doc_id, size, text, 'key' AS law, shard, grown_shard, row_number() OVER (PARTITION BY shard ORDER BY h % 256, h, doc_id) - 1 AS slot FROM u), crc
"""


ORACLE = _oracle()
