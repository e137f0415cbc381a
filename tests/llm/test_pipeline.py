import collections

import corpus_pipeline
from panelwright.llm import decontamination, quality, simhash


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    kept = stage[names[0]](spark, docs, sf).cache()
    model = quality.fit(docs, quality.grades_of(labels))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if model.tails(r.text)[0] >= 0.5} and kept.columns == docs.columns
    one = stage[names[1]](spark, kept, sf).cache()
    comp = {r.component_id for r in simhash.near_duplicates(kept).collect()}
    assert {r.doc_id for r in one.collect()} == comp and one.count() == len(comp)
    clean = stage[names[2]](spark, one, sf).cache()
    w = decontamination._Windows([(r.item_id, decontamination.words_of(r.text)) for r in benchmark.collect()], 10)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not w.scan(r.text)[1].any()}
    mixed = stage[names[3]](spark, clean, sf).cache()
    times = collections.Counter(r.doc_id for r in mixed.collect())
    words = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    assert set(times) <= set(words) and max(times.values()) <= 2 and mixed.columns == docs.columns
    assert abs(sum(words[d] * n for d, n in times.items()) / sum(words.values()) - 1.5) < 0.1
    placed = stage[names[4]](spark, mixed, sf).collect()
    assert collections.Counter(r.doc_id for r in placed) == times
    sizes = collections.Counter(r["shard"] for r in placed)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_stages_take_empty_null_and_repeated_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, sf).count() >= (name != "source mixing"), name  # a source without words takes none
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    assert corpus_pipeline.STAGES[0][1](spark, docs.where("false"), sf).count() == 0


def test_run(spark, sf):
    """All stages in a row give the rows that the stages give one by one."""
    got = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    want = collections.Counter((r.doc_id, r.text, r.row_number, r["shard"], r.slot) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.text, r.row_number, r["shard"], r.slot) for r in got.collect()) == want and len(want) > 50
