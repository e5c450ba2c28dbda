import pytest

import __spark_entry__ as E
import corpus_pipeline as CP
from cadence.llm import language_id, ngram_join, quality_rules
from tests.llm.util import SMALL, docs, prose


def test_stages_and_registration():
    assert [n for n, _ in CP.STAGES] == ["quality_rules", "language_id", "ngram_jaccard_join", "benchmark_decontamination",
                                         "best_fit_packing"]
    names = E.queries()
    assert "pipeline" in names and CP.ORACLE_SQL is None
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


@pytest.fixture(scope="module")
def stages(spark):
    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs_]
    for name, f in CP.STAGES[:-1]:
        out.append(CP.materialize(f(spark, out[-1], SMALL), "test"))
    return out


def test_each_stage_takes_effect(spark, stages):
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in stages]
    for d in stages[1:]:
        assert d.columns == stages[0].columns and d.dtypes == stages[0].dtypes
    trees = quality_rules.fit(stages[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in quality_rules.judge(stages[0], trees).filter("kept").collect()}
    model = language_id.fit(stages[1].filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    assert ids[2] == {r.doc_id for r in language_id.identify(stages[1], model).filter("NOT rejected").collect()}
    groups = ngram_join.link_components(stages[2]).collect()
    assert ids[3] == {r.component_id for r in groups}
    assert ids[4] < ids[3] and stages[4].count() == len(ids[4])
    whole = {r.doc_id: tuple(r) for r in stages[0].collect()}
    assert all(whole[r.doc_id] == tuple(r) for r in stages[4].collect())


def test_run_packs_what_the_stages_keep(spark, stages):
    packed = CP.run(spark, SMALL)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in stages[4].collect()}


def test_one_of_each_group_stays_with_nulls_and_repeats(spark):
    a, b = prose(1, 50), prose(2, 50)
    given = [(3, a), (1, a), (1, a), (None, b), (2, None), (2, None), (5, "")]
    kept = CP.keep_one_of_copies(spark, docs(spark, given).selectExpr("*", "1 AS class", "2 AS n"), SMALL)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (None, b), (2, None), (5, "")], key=repr)
    assert kept.columns[-2:] == ["class", "n"]


def test_rows_without_id_and_ids_with_other_texts_are_judged_by_row(spark):
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    given = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, a), (None, ""), (None, "")]
    kept = CP.keep_one_of_copies(spark, docs(spark, given), SMALL)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(1, a), (None, b), (2, c), (None, ""), (None, "")], key=repr)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    clean = CP.drop_contaminated(spark, docs(spark, [(None, f"{a} {item}"), (None, a), (3, item), (3, b), (None, None)]), SMALL)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted([(None, a), (3, b), (None, None)], key=repr)


def test_filters_on_clashing_columns_and_empty_tables(spark):
    d = docs(spark, [(1, prose(1, 50)), (2, "short"), (3, None)]).selectExpr("*", "1 AS kept", "2 AS quality_score")
    for f, ids in ((CP.keep_quality, {1}), (CP.drop_contaminated, {1, 2, 3})):
        out = f(spark, d, SMALL)
        assert out.columns == d.columns and {r.doc_id for r in out.collect()} == ids
        assert f(spark, d.limit(0), SMALL).count() == 0
    assert CP.keep_known_language(spark, d.limit(0), SMALL).count() == 0
    assert CP.pack_sequences(spark, d.limit(0), SMALL).count() == 0
