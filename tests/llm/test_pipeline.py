import re

from pyspark.sql import functions as F

from tests.llm.test_operators import components, contaminated, toxic_sample


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline as cp

    d = str(tmp_path)
    texts, labels = toxic_sample(9)
    toxic = [(1000 + i, t, "en", "b", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows + toxic, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1000 + i, int(y), 1) for i, y in enumerate(labels)], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    items = [(1, rows[20][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_shards"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    steps = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == names
        path = f"{d}/out{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        steps.append(docs)
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps[:4]]
    bad = {1000 + i for i, y in enumerate(labels) if y}
    assert len(bad & ids[0]) < 0.1 * len(bad) and len(set(range(60)) - ids[0]) <= 2
    left = [tuple(r) for r in steps[0].collect()]
    keep = {c[2] for r, c in zip(left, components(left, 5), strict=True) if re.search(r"\S", r[1] or "") and c[2] is not None}
    assert {i for i in ids[1] if i is not None and i not in (81, 82, 83)} == keep
    left = [tuple(r) for r in steps[1].collect()]
    assert {r[0] for r in left if r[0] is not None} - {i for i in ids[2] if i is not None} == {c[0] for c in contaminated(left, items) if c[5]}
    assert ids[3] <= ids[2]
    taken = {r.doc_id for r in steps[4].select(F.explode("doc_ids").alias("doc_id")).collect()}
    assert taken == {r.doc_id for r in steps[3].where("length(text) > 0").collect()}
    assert cp.run(spark, d).count() == steps[4].count()
