"""What a Python worker holds at once is bounded in bytes, whatever the number and width of rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from rasterloom.batches import BATCH_BYTES, bounded, parts

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for b in batches:
        yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])


def test_operators_over_texts_get_small_batches(spark):
    from rasterloom.llm import near_dedup, packing, toxicity

    wide = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    few = wide.limit(2)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    for run in (lambda: packing.op9(few), lambda: near_dedup.op2(few), lambda: toxicity.op10(few, labels)):
        spark.conf.unset(LIMIT)
        run()
        got = wide.mapInArrow(sizes, "rows long, bytes long").agg(F.max("bytes"), F.sum("rows"), F.sum("bytes")).first()
        assert got[0] < 1.1 * BATCH_BYTES and got[1] == 2500 and got[2] > 25_000_000


def test_a_smaller_limit_stays(spark):
    for own, then in (("1m", "1m"), ("256m", str(BATCH_BYTES))):
        spark.conf.set(LIMIT, own)
        bounded(spark.range(1))
        assert spark.conf.get(LIMIT) == then


def test_parts_lose_nothing():
    texts = ["", None, "x" * 50, "y", "z" * 7, None, *["ab"] * 9]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"]).slice(1)
    cut = list(parts(iter([batch, batch.slice(0, 0)]), "text", 10, 4))
    assert [x for p in cut for x in p.column("text").to_pylist()] == texts[1:]
    assert all(len(p) <= 4 and (len(p) == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 10) for p in cut)


def test_text_codecs_work_on_parts(spark):
    from rasterloom.plans.queries import _text_codec

    texts = [None, "", "héllo " * 9, *["word " * 400] * 1500]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    for codec in ("zstd", "packbits", "deflate"):
        out = list(_text_codec(codec)(iter([batch])))
        assert len(out) > 2 and max(sum(len(t) for t in b.column("text").to_pylist()) for b in out) <= 1_000_000
        assert [t for b in out for t in b.column("text").to_pylist()] == [t or "" for t in texts]


def test_files_by_hand_come_in_small_batches(spark, tmp_path):
    """Files made of rows of events, and their pages, go from worker to worker in batches of bounded rows."""
    from rasterloom.plans import proofs
    from rasterloom.sources import relations

    cells = pa.record_batch([pa.array(range(1000), pa.int32()), pa.array([[float(k % 2)] * 100 for k in range(1000)])], ["y", "values"])
    made = proofs.hand_files(proofs._bilevel(2))
    out = list(made(iter([cells])))
    assert [len(b) for b in out] == [256, 256, 256, 232]
    pages = relations._mapped(lambda p, c: relations.page_rows(p, c, "all"), relations.PAGES)
    got = list(pages(iter(out)))
    assert max(len(b) for b in got) == relations.ROWS_AT_ONCE and [p for b in got for p in b.column("path").to_pylist()] == [str(k) for k in range(1000)]
