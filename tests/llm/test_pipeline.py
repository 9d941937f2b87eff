"""The pipeline's stages one after the other, each against what it must keep and drop."""

import hashlib

import corpus_pipeline as pipeline


def insult(i):
    return f"you are an idiot and a moron number {i}"


def test_stages(spark, tmp_path):
    def clean(i):
        return " ".join(hashlib.md5(f"{i}-{j}".encode()).hexdigest()[:7] for j in range(40))

    leak = " ".join(f"question{j}" for j in range(30))
    texts = [clean(i) for i in range(30)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    shared = "a line that many documents share, word for word"
    rows += [(100 + i, f"{shared}\n{clean(200 + i)}", "en", "s1", 0) for i in range(4)]
    rows += [(200, texts[3] + " end", "en", "s2", 0), (201, texts[3], "en", "s2", 0), (300, f"{clean(9000)} {leak} {clean(9001)}", "en", "s3", 0), (400, insult(1), "en", "s0", 0), (None, None, "en", None, 0), (500, "", None, "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, x = [docs], docs
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, x, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        x = spark.read.parquet(f"{tmp_path}/out{i}")
        seen.append(x)
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1])
    assert ids[0] - ids[1] == {400}
    assert ids[2] == ids[1]
    assert {r["doc_id"] for r in seen[2].where(seen[2].text.contains("word for word")).collect()} == {100}
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].where("text is not null").collect())
    assert ids[2] - ids[3] == {200}  # 201 lost its only line in stage two
    assert ids[3] - ids[4] == {300}
    assert ids[5] == ids[4]


def test_run_on_test_data(spark, sf):
    out = pipeline.run(spark, sf)
    assert {"doc_id", "source", "size", "target", "copies", "taken"} <= set(out.columns)
    assert 0 < out.count() <= spark.read.parquet(f"{sf}/documents.parquet").count()
