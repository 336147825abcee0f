"""The pipeline's stages on small tables, each held against what its operator says."""

import corpus_pipeline as C


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        if name != "pack":
            assert out.columns == cols
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name == "exact_dedup":
            folded = docs.selectExpr("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t")
            assert folded.distinct().count() == counts[-1]
        if name in ("language", "exact_dedup", "near_dedup"):
            assert 0 < counts[-1] <= counts[-2]
        assert i == len(C.STAGES) - 1 or counts[-1] > 0
    per = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in per) <= 4096
    assert C.run(spark, sf).count() == counts[-1]
