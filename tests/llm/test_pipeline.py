import corpus_pipeline as pipeline
import pytest

from tests.conftest import SF
from tests.llm.test_lines_decontaminate import brute
from tests.llm.test_near_dedup import brute_classes
from webloom.llm.common import stored


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        after = stored(stage(spark, before, SF))
        assert after.columns == columns
        old, new = ({r.doc_id: r for r in x.collect()} for x in (before, after))
        assert set(new) <= set(old)
        if name == "language_id":
            assert len(new) >= 0.99 * len(old)
        if name == "line_dedup":
            assert len(new) == len(old) and all(r.n_chars == len(r.text) for r in new.values())
        if name == "near_dedup":
            assert sorted(new) == [g[0] for g in brute_classes([(d, r.text) for d, r in old.items()])]
        if name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert sorted(new) == sorted(d for d, _, hit, _ in brute([(d, r.text) for d, r in old.items()], bench) if not hit)
        before = after
    packed = pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r.doc_id for r in packed} == set(new)
    whole = pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "only text", None, None, 9), (3, "only text", None, None, 9), (None, "other words here", "en", "a", 16)]])
def test_odd_tables(spark, rows, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
    # null and empty texts have no letter; of the copies with one id one row stays, as does the row without an id
    assert sorted((str(r.doc_id), r.piece, r.start) for r in docs.collect()) == ([("3", 0, 0), ("None", 0, 0)] if rows else [])
