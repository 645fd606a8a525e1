import corpus_pipeline as P
from bidscope.llm import decontam, line_dedup, simhash, toxicity

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_does_what_its_operator_says(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before = {r.doc_id: r for r in docs.collect()}
        after = {r.doc_id: r for r in out.collect()} if k < 4 else {}
        if name == "toxicity":
            score = {r.doc_id: r.score for r in toxicity.scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert after == {i: r for i, r in before.items() if score[i] < P.TOXIC} and len(after) < len(before)
        elif name == "line_dedup":
            gone = {r.doc_id: set(r.removed) for r in line_dedup.line_report(docs).collect()}
            want = {i: "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone[i]) for i, r in before.items()}
            assert {i: r.text for i, r in after.items()} == want and any(gone.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "simhash_near_dedup":
            first = {r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert after == {i: r for i, r in before.items() if i in first} and len(after) < len(before)
        elif name == "benchmark_decontamination":
            hit = {r.doc_id for r in decontam.digest(decontam.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))).collect() if r.contaminated}
            assert after == {i: r for i, r in before.items() if i not in hit} and hit
        else:
            got = out.collect()
            assert {r.doc_id for r in got} == set(before)
        docs = out
    assert rows(P.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")) == rows(docs.select("doc_id", "piece", "start", "length", "ids_crc32"))


def test_odd_rows_and_clashing_columns(spark):
    data = [(1, "one two three four five six seven", "en"), (2, "one two three four five six seven", "en"), (3, None, None), (None, "no id here at all", "x"),
            (None, "other text without id", "x"), (5, "", "en"), (5, "", "en"), (6, "x" * 200_000, "en"), (7, "a b c\na b c", "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr(
        "*", "'s' as source", "0L as n_chars", "1 as score", "2 as toxicity_score", "3 as document_key", "4 as nth", "5 as hit", "6 as id", "7 as ref", "8 as `row`", "9 as fp", "10 as gone")
    out = docs
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
        assert (k > 1 or out.count() == len(data)) and stage(spark, docs.limit(0), SF).count() == 0
    kept = out.collect()
    # equal texts lose their lines, so that only one of the empty ones stays
    assert sorted((r.doc_id or -1) for r in kept) == [-1, -1, 1, 2, 6, 7]
    assert [r.text for r in kept if r.doc_id == 7] == ["a b c"]
    assert P.STAGES[4][1](spark, out, SF).select("doc_id").distinct().count() == 5
