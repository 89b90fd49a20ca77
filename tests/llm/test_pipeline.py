import corpus_pipeline


def test_stages_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == columns
        if name != "source_mixing":
            assert docs.count() <= before
            before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_near_dedup_stage_on_nulls_repeats_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(60)]
    long, other = " ".join(words), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long, "a"), (2, long + " end", "b"), (3, long, "c"), (3, long, "c"), (4, other, "d"), (4, other, "d"), (5, None, "e"), (6, "", "f"), (7, " \t", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    stays = [rows[0], *rows[4:]]  # of the group the smallest doc_id; a repeated row stays as often as it is there
    assert sorted(got.collect(), key=lambda r: r.doc_id) == stays
    assert stage(spark, docs.limit(0), "").count() == 0
