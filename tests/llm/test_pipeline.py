"""The pipeline against a brute-force one over the same stages' rules."""

import corpus_pipeline
import pytest

from wayfold.llm import decontam, packing, quality, queries, simhash
from wayfold.llm.common import table
from tests.llm.test_text_dedup import brute_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").toPandas()


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing",
    ] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_brute_force(spark, docs):
    model = queries.quality_model(table(spark, SF, "documents"), table(spark, SF, "labels"))
    kept = [(r.doc_id, r.text) for r in docs.itertuples() if model.score(r.text or "", []) >= quality.THRESHOLD]
    prints = {i: simhash.fingerprint(t or "") for i, t in kept}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints.items():
        for j, b in prints.items():
            if i < j and (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    kept = [(i, t) for i, t in kept if find(i) == i]
    cut = brute_words(kept, 13)
    kept = [(i, t if not cut[i][1] else cut[i][2]) for i, t in kept if not cut[i][1] or cut[i][2]]
    frame = spark.createDataFrame(kept, "doc_id long, text string")
    bad = {r.doc_id for r in decontam.contaminated(frame, table(spark, SF, "benchmark")).collect()}
    items = [" ".join(x.text.split()) for x in table(spark, SF, "benchmark").collect()]
    assert {i for i, t in kept if any(x in " ".join(t.split()) for x in items)} <= bad
    want = sorted(map(tuple, packing.pieces(frame.where(~frame.doc_id.isin(sorted(bad)))).collect()))
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert 0 < got.doc_id.nunique() < len(docs)


def test_all_but_the_last_stage_return_documents(spark):
    frame = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, SF).columns == frame.columns


def test_stages_take_odd_rows(spark):
    schema = table(spark, SF, "documents").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text without an id", None, "s", 3), (4, "word " * 30_000, "en", None, 9), (5, "a b", "en", "s", 3), (5, "a b", "en", "s", 3)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, frame, SF)
            assert out.count() >= (1 if frame.count() else 0)
        docs_out = corpus_pipeline.quality_stage(spark, frame, SF)
        assert docs_out.columns == frame.columns and docs_out.count() <= frame.count()
