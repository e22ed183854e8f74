"""Stages on a small table: each acts on all its input, its decisions take effect, columns stay."""

from collections import Counter

import pytest

from .test_operators import SCHEMA, shingles_of, table, words_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    from rasterloom.llm import stages
    from rasterloom.llm.toxicity import SCORE, score_documents

    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(40 <= i < 60)) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")

    scored = score_documents(docs, labels)
    toxic = stages.drop_toxic(spark, docs, d)
    assert toxic.columns == docs.columns and toxic.count() == scored.where(f"{SCORE} < 0.7").count()

    copies = stages.drop_copies(spark, docs, d)
    assert copies.columns == docs.columns
    assert Counter(r.text or "" for r in copies.collect()) == Counter({r[1] or "" for r in rows})

    near = stages.drop_near_copies(spark, copies, d)
    left = near.collect()
    assert near.columns == docs.columns and len(left) < copies.count()
    # of each component (links followed on full sets) one row stays, and all rows without words
    rows_in = [(r.doc_id, r.text) for r in copies.collect()]
    sets = [shingles_of(t, 5) for _, t in rows_in]
    comp = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= 80 * len(x | sets[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    groups = {}
    for k, c in enumerate(comp):
        groups.setdefault(c, []).append(rows_in[k])
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())
    assert Counter((r.doc_id, r.text) for r in left) == want
    kept = {(r.doc_id, r.text) for r in left}

    mixed = stages.mix_sources(spark, near, d)
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 2 and set(times) <= kept

    path = str(tmp_path / "mixed")
    mixed.write.parquet(path)
    packed = stages.pack(spark, spark.read.parquet(path), d)
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in times})
    assert packed.where("piece = 0").count() == sum(times.values())


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    assert words_of(None) == []


def test_stages_on_derived_tables(spark, tmp_path):
    """Stages called with rows that an explode, a join, a union or a sample makes of files' rows."""
    from pyspark.sql import functions as F

    from rasterloom.llm import stages

    long = [" ".join(f"w{k}{i}" for i in range(40)) for k in range(3)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(long)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    two = spark.range(2).toDF("_k")
    forms = {
        "explode": docs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(1)))).drop("_k"),
        "join": docs.join(two).drop("_k"),
        "union": docs.unionByName(docs),
        "sample": docs.unionByName(docs).sample(1.0),
    }
    for name, df in forms.items():
        for stage in (stages.drop_copies, stages.drop_near_copies):
            got = stage(spark, df, str(tmp_path))
            assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2] and got.columns == docs.columns, (name, stage)
        times = Counter(r.doc_id for r in stages.mix_sources(spark, df, str(tmp_path)).collect())
        assert set(times) <= {0, 1, 2} and max(times.values()) <= 4, name
