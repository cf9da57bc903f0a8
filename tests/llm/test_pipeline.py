"""The corpus pipeline: every stage against a plain version on its own input, planted cases, odd rows."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline
    return corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, pipeline):
    """Rows before and after every stage."""
    from tracefold.session import materialize
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), name)
        out[name], docs = (docs, after), after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stage_contract(pipeline, stages):
    assert [n for n, _ in pipeline.STAGES] == [
        "language_id", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == pipeline.DOCUMENTS
        assert after.exceptAll(before.select(*pipeline.DOCUMENTS)).count() == 0, name


def test_language_stage_keeps_texts_with_letters(stages):
    before, after = map(texts, stages["language_id"])
    assert set(after) == {d for d, t in before.items() if any(c.isalpha() for c in t or "")}


def test_dedup_stage_keeps_the_least_of_each_group(stages):
    from .test_simhash import plain_result
    before, after = map(texts, stages["simhash_near_dedup"])
    assert set(after) == {c for _, _, c in plain_result(list(before.items()))}
    assert len(after) < len(before)


def test_decontamination_stage_equals_the_rule(spark, stages):
    from .test_decontam import plain_judge
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = map(texts, stages["benchmark_decontamination"])
    assert set(after) == {d for d, t in before.items() if not plain_judge(t, items)[4]}
    assert len(after) < len(before)


def test_packing_stage_holds_every_id_once(stages, tokenizer_file):
    from .test_tokens import check_pieces
    before, after = stages["packing"]
    check_pieces(after.collect(), texts(before), tokenizer_file, 4096)


def test_planted_cases(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    base = docs.where("length(text) > 2000").first().text
    rows = [(10**6, base, "en", "s", 1), (10**6 + 1, base, "en", "s", 1), (10**6 + 2, None, "en", "s", 1),
            (10**6 + 3, "12345 ...", "en", "s", 1), (10**6 + 4, item, "en", "s", 1), (10**6, base, "en", "s", 1)]
    out = spark.createDataFrame(rows, docs.schema)
    out = pipeline.language(spark, out, SF)
    assert {r.doc_id - 10**6 for r in out.collect()} == {0, 1, 4}
    out = pipeline.near_duplicates(spark, out, SF)
    assert sorted(r.doc_id - 10**6 for r in out.collect()) == [0, 4]
    assert [r.doc_id - 10**6 for r in pipeline.benchmark(spark, out, SF).collect()] == [0]


def test_repeated_ids_leave_one_row_of_every_group(spark, pipeline, make_docs):
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma")]
    rows = [(1, long[0]), (1, long[1]), (2, long[0]), (3, long[1] + " "), (1, long[0]), (4, long[2]), (4, long[2] + " ."), (None, "z no id"), (None, "a no id")]
    want = {(1, long[0]), (1, long[1]), (4, long[2]), (None, "z no id"), (None, "a no id")}
    for parts in (1, 4):
        once = pipeline.near_duplicates(spark, make_docs(rows).repartition(parts), SF).collect()
        assert len(once) == len(want) and {(r.doc_id, r.text) for r in once} == want


def test_odd_rows_pass_every_stage(spark, pipeline, make_docs, odd_texts):
    from tracefold.session import materialize
    docs = materialize(make_docs([*odd_texts, (None, "no id"), (None, "another without id"), (None, "no id")]), "odd")
    once = pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(r.text for r in once if r.doc_id is None) == ["another without id", "no id"]
    for _, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "odd")
    left = docs.collect()
    assert left and len({r.text for r in left}) == len(left)
    assert {r.doc_id for r in pipeline.pack(spark, docs, SF).collect()} == {r.doc_id for r in left}
    none = docs.where(F.lit(False))
    for _, stage in pipeline.STAGES:
        none_after = stage(spark, none, SF)
        assert none_after.count() == 0


def test_run_is_the_stages(spark, pipeline, stages):
    got = pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        map(tuple, stages["packing"][1].select("doc_id", "start", "length", "ids_crc32").collect()))
