"""The token stage starts with heaps that hold no garbage of the stages before."""

import corpus_pipeline


def test_token_output_gives_garbage_back(spark, small):
    jvm = spark.sparkContext._jvm
    run = jvm.java.lang.Runtime.getRuntime()
    jvm.System.gc()
    floor, seen = run.totalMemory() - run.freeMemory(), []
    for _ in range(24):
        jvm.java.nio.ByteBuffer.allocate(32 << 20)
    real = corpus_pipeline.write_token_files

    def write(*args, **kw):
        seen.append(run.totalMemory() - run.freeMemory())
        return real(*args, **kw)

    corpus_pipeline.write_token_files = write
    try:
        docs = spark.createDataFrame([(1, "a text"), (2, "another")], "doc_id long, text string")
        assert corpus_pipeline.token_output(spark, docs, small).count() == 2
    finally:
        corpus_pipeline.write_token_files = real
    assert seen[0] < floor + (128 << 20)
