import corpus_pipeline
from tallyforge.llm import packing, quality_classifier, quality_rules, simhash
from tallyforge.llm.common import table

from .test_lines import brute


def test_stages_in_order(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "line_dedup", "simhash_near_dedup", "packing"]
    state = {r.doc_id: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        rows = {r.doc_id: r.asDict() for r in out.collect()}
        if name == "quality_classifier":
            model = quality_classifier.train(docs, labels)
            want = {r.doc_id: state[r.doc_id] for r in quality_classifier.classify(docs, model).collect() if r.predicted}
        elif name == "quality_rules":
            forest = quality_rules.train(table(spark, sf, "documents"), labels)
            want = {r.doc_id: state[r.doc_id] for r in quality_rules.apply_rules(docs, forest).collect() if r.kept}
        elif name == "line_dedup":
            kept = brute([(i, r["text"]) for i, r in state.items()])
            want = {i: r | {"text": kept[i], "n_chars": len(kept[i])} for i, r in state.items()}
        else:
            comp = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
            want = {i: r for i, r in state.items() if comp[i] == i}
        assert rows == want
        state, docs = rows, spark.createDataFrame([tuple(r.values()) for r in rows.values()], docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in last) == sorted(state)


def test_run_equals_its_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "bucket", "padded_to", "shard", "batch", "slot"} == set(got.columns)
    rows = got.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert packing.BUCKETS >= len({r.bucket for r in rows})


def odd_documents(spark, path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, h string, score string"
    df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "clash", None, "clash") for i, t in rows], schema)
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows[:2]] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return df


def prose(start, n):
    return " ".join(f"word{k}" for k in range(start, start + n))


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    """Every stage keeps all columns and whole rows; the fit has no rejected label, so only the base checks reject."""
    first, second = prose(0, 80), prose(1000, 90)
    rows = [(1, first), (1, first), (2, None), (3, ""), (None, second), (5, prose(5000, 20000)), (6, prose(90000, 60)), (6, prose(95000, 70))]
    docs = odd_documents(spark, tmp_path, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        got = out.collect()
        assert {r.kept for r in got} == {"clash"} and all(r.text is None or r.n_chars == len(r.text) for r in got)
        docs = spark.createDataFrame(got, docs.schema)
    assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == sorted((str(i), t) for i, t in dict.fromkeys(rows) if t)
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in placed) == sorted(str(r.doc_id) for r in docs.collect())


def test_empty_tables(spark, tmp_path):
    odd_documents(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
