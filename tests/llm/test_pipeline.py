import corpus_pipeline
import __spark_entry__ as entry
from starcell.llm import queries
from starcell.llm.shared import components
from tests.llm.samples import frame, texts

SF_DIR = "/root/testdata/sf0.001"


def test_stages_hand_on_their_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        docs = corpus_pipeline.stored(after, "test-stage")
        assert 0 < docs.count() <= kept, name
        kept = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_odd_rows(spark):
    rows = [(i, t, None if i == 3 else "en", "src1", None) for i, t in texts(8)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for rows in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, frame(spark, rows, schema), SF_DIR).collect()


def test_run_is_registered(spark):
    known = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES} and "pipeline" in known


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (160, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges, "test").collect()}
    assert got == {**{i: 3 for i in range(100, 161)}, 3: 3, 5: 5, 9: 5, 7: 7}
