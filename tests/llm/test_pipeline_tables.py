"""Tables of finished stages go."""

import corpus_pipeline


def test_pipeline_keeps_no_table_of_an_earlier_stage(spark, monkeypatch):
    stages, tables = [], []
    keep = corpus_pipeline.kept

    def noted(df, name):
        tables.append(keep(df, name))
        return tables[-1]

    def same(spark, docs, sf):
        stages.append(docs)
        return docs

    monkeypatch.setattr(corpus_pipeline, "kept", noted)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"stage {k}", same) for k in range(4)])
    last = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    there = lambda t: spark._jvm.org.apache.hadoop.fs.Path(t.kept_at).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(t.kept_at))
    assert len(stages) == 4 and [there(t) for t in tables] == [False, False, True]
    assert last.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
