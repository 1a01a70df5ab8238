import corpus_pipeline
from factloom.llm import registry


def test_stages(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda i: " ".join(f"{w}{i}" for w in words * 6)
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(40)] + [(100 + i, text(5) + " tail", "en", "s2", 1) for i in range(4)]
    rows += [(200 + i, "idiot scum moron " * 9 + text(300 + i), "en", "s1", 1) for i in range(30)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 200)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        docs_before, docs = docs, spark.read.parquet(f"{folder}/{k}")
        seen.append((name, {r["doc_id"] for r in docs.select("doc_id").collect()}))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == docs_before.columns
    assert seen[0][1] == {r[0] for r in rows if r[0] < 200}
    assert seen[1][1] == set(range(40))
    assert seen[2][1] <= seen[1][1] and seen[3][1] == seen[2][1]
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, a long text and a further column with an operator's name."""
    said = lambda i, n=60: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [
        (1, said(1), "en", "a", 1, "k"), (1, said(1), "en", "a", 1, "k"), (None, said(1), None, None, None, None), (None, said(2), "en", None, 5, "k"), (3, None, None, "a", None, None), (3, None, "en", "a", 0, None),
        (4, "", "en", "b", 0, "k"), (5, " \n", "en", "b", 2, "k"), (6, said(6, 20_000), "en", "b", 9, "k"), (7, "one", "en", "b", 3, "k"), (8, said(2) + " tail", "en", "c", 3, "k"),
    ]
    shape = "doc_id long, text string, lang string, source string, n_chars long, key string"
    empty_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, table in (("odd", rows), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(table, shape).write.parquet(f"{folder}/documents.parquet")
        empty_labels.write.parquet(f"{folder}/labels.parquet")
        docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            assert k == 3 or out.columns == docs.columns
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            counts.append(docs.count())
            if name == "odd" and k == 1:
                # Of the three copies of the first text the one of an id; of the second and its near copy, id 8.
                assert sorted((r["doc_id"], len(r["text"] or "")) for r in docs.collect()) == [(1, len(said(1))), (3, 0), (4, 0), (5, 2), (6, len(rows[8][1])), (7, 3), (8, len(rows[10][1]))]
        assert counts[0] == len(table) and (name == "odd" and counts[2] == counts[3] >= 4 or counts == [0] * 4)


def test_registry():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)] and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
