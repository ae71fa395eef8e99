"""The pipeline's stages on a small fixture, against what each operator says of its own input."""

import corpus_pipeline
from tallymark.llm import exact_dedup, quality, simhash_wide


def test_stages(spark, docs, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "pii", "packing"]
    frame = docs
    checks = [
        lambda d: {r["doc_id"] for r in quality.quality_rules(d).where("kept").collect()},
        lambda d: {r["doc_id"] for r in exact_dedup.exact_dedup(d).where("kept").collect()},
        lambda d: {r["component_id"] for r in simhash_wide.near_components(d).collect()},
        lambda d: {r["doc_id"] for r in d.collect()},
    ]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, frame, "")
        assert out.columns == docs.columns, name
        out.write.parquet(path := str(tmp_path / name))
        wanted = checks[k](frame)
        frame = spark.read.parquet(path)
        assert {r["doc_id"] for r in frame.collect()} == wanted
    assert 0 < frame.count() < docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, "")
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in frame.collect()}


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
