"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a shuffled order (by MD5 of seed and id).  The k-th copy of a
document starts at virtual time (words queued before it) / target and finishes at (words queued
up to its end) / target; a source whose target exceeds its size queues its documents again, in the
same order.  All copies are sorted by finish time over the whole cluster, words are summed in that order,
and the mix is cut where the sum reaches the total budget.  With ``cut="words"`` the copy in which a
source reaches its target (to the word) queues as two parts, so that the cut falls between parts and every source
ends at its target; with ``cut="whole"`` copies stay whole and one is taken if more than half of it lies
before the cut, so a source may differ from its target by the copy in service.

The global sort is by ranges of virtual time.  Until time 1 every stretch of virtual time holds the same
number of words (the targets together), so ranges of equal width have equal work; what finishes
later is beyond the cut but for the copies in service, and falls into one more range a source.

Targets: sources sorted by code point (null last) have the weights in turn; they share
``budget`` x all words by weight, a target stops at ``most`` x its source's words, and what is over
goes to the others by weight until none is above.

A hot source never gathers in one task: a source is cut into blocks of the shuffled order (of about
``block_rows`` rows if it had all rows), and blocks get their start from the sums of the blocks before.
Only DataFrame functions.  Tables of a row per source (targets) are worked on in one task.

Null texts have size 0; a document of size 0 is never taken.  Null sources are one source.  Null
ids share a place in the shuffled order; ties are broken by text digest, so that repeated rows,
which queue one after the other, give the same result in every run.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, word_count


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: one row per source with ``_source`` and ``source_size``.  Adds ``target`` (double) and ``_budget`` (all targets, each cut to the word).

    With sources in rising order of most * size / weight, the first k sources are at their stop
    and the rest share what is left; k is the first place where the share per weight no longer
    passes the next source's stop (beyond it the share per weight falls, so it is the largest that fits).
    """
    turn = Window.orderBy(F.col("_source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("_all", F.sum("source_size").over(every) * F.lit(float(budget))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    rise = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    after = rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
    s = s.withColumn("_share", level)
    target = F.when(F.col("_share").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_share")))
    return s.select("_source", "source_size", target.alias("target")).withColumn("_budget", F.sum(F.floor("target")).over(every))


def queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, block_rows: int = 50_000, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, _start (words queued before it) and a row key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    carried = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"), key.alias("_key"), F.md5(text.cast("binary")).alias("_tie"), *carried)
    rows = scratch(rows, "sizes")  # texts are read once
    blocks = max(64, -(-rows.count() // block_rows))
    rows = rows.withColumn("_has", F.col("_source").isNotNull()).withColumn("_src", F.coalesce(F.col("_source").cast("string"), F.lit("")))
    rows = rows.withColumn("_block", (F.conv(F.substring("_key", 1, 6), 16, 10).cast("long") * blocks / F.lit(16**6)).cast("int"))
    group = ["_has", "_src", "_block"]
    sums = rows.groupBy(*group).agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_has", "_src").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    sizes = sums.groupBy("_has", "_src").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes.withColumn("_source", F.when(F.col("_has"), F.col("_src"))), weights, budget, most)
    targets = targets.select(F.col("_source").isNotNull().alias("_has"), F.coalesce("_source", F.lit("")).alias("_src"), "source_size", "target", "_budget")
    plan = offsets.join(targets, ["_has", "_src"])  # a row per source and block
    inside = Window.partitionBy(*group).orderBy("_key", "doc_id", "_tie", "size")
    rows = rows.join(plan, group)
    rows = rows.withColumn("_seq", F.row_number().over(inside))
    return rows.withColumn("_start", F.col("_offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))


def mix(queued: DataFrame, most: float = 2.0, cut: str = "words", ranges: int | None = None) -> DataFrame:
    """The mix in order of virtual finish times: one row per copy (or part of one) with ``taken`` words.

    ranges: of virtual time, until the cut; their sums are broadcast (``ranges`` + 1 rows).

    Copies beyond the cut stay in the result with taken = 0, so that documents can be counted.
    """
    copies = F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1)))
    each = queued.withColumn("copy", F.explode(copies)).withColumn("_from", F.col("_start") + F.col("copy") * F.col("source_size"))
    target = F.floor("target").cast("long")
    if cut == "words":
        split = (F.col("_from") < target) & (target < F.col("_from") + F.col("size"))
        parts = F.when(split, F.array(target - F.col("_from"), F.col("_from") + F.col("size") - target)).otherwise(F.array("size"))
        each = each.select("*", F.posexplode(parts).alias("_part", "_words")).withColumn("_from", F.when(F.col("_part") > 0, target).otherwise(F.col("_from")))
    else:
        each = each.withColumn("_part", F.lit(0)).withColumn("_words", F.col("size"))
    finish = F.when(target > 0, (F.col("_from") + F.col("_words")) / target).otherwise(F.lit(float("inf")))
    each = each.withColumn("finish", finish)
    ranges = ranges or int(queued.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of virtual time; copies that start at time 1 or later can't reach the cut and are dealt out by their key
    late = F.col("_from") >= target
    spread = F.lit(ranges + 1) + F.pmod(F.xxhash64("_key", "copy"), F.lit(ranges))
    each = each.withColumn("_range", F.when(late, spread).otherwise(F.least(F.floor(F.col("finish") * ranges), F.lit(ranges))))
    sums = each.where(~late).groupBy("_range").agg(F.sum("_words").alias("_sum"))  # ranges + 1 rows at most
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_range").orderBy("finish", "_key", "_tie", "doc_id", "copy", "_src", "_part")
    total = F.col("_before") + F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = each.join(F.broadcast(sums), "_range", "left").withColumn("_total", total)
    room = F.greatest(F.col("_budget") - (F.col("_total") - F.col("_words")), F.lit(0))
    taken = F.least(room, F.col("_words")) if cut == "words" else F.when(room * 2 > F.col("_words"), F.col("_words")).otherwise(F.lit(0))
    return placed.withColumn("taken", F.when(late, F.lit(0)).otherwise(F.coalesce(taken, F.lit(0))).cast("long"))


def op7(docs: DataFrame) -> DataFrame:
    row = ["_has", "_src", "_block", "_seq", "doc_id", "size", "source_size", "target"]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // 50_000)
    return mix(queue(docs), ranges=n).groupBy(*row).agg(F.sum("taken").cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('7:' || doc_id) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0e0, 2.0e0, 1.0e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
             source_size * 2.0e0 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 AS budget FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0))
                / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS share FROM l),
t AS (SELECT source, source_size, CASE WHEN share IS NULL THEN cap ELSE least(cap, weight * share) END AS target FROM g),
q AS (SELECT d.*, t.source_size, t.target,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(greatest(CAST(floor(target) AS BIGINT) - start, 0), size)
            + least(greatest(CAST(floor(target) AS BIGINT) - start - source_size, 0), size) AS BIGINT) AS taken
FROM q
"""
