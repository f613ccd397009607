"""The pipeline: every stage alone on edge rows, and the whole against brute force."""
import brute
import pytest
from brute import LINE, PASSAGE, ROWS, table

import corpus_pipeline
from cadenza.llm import quality_rff

STAGES = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame(brute.ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in ROWS], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_in_order():
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5
    assert list(STAGES) == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "sentencepiece encoding and decoding"]


@pytest.mark.parametrize("name", list(STAGES))
def test_edge_rows_and_columns(spark, folder, name):
    docs = table(spark, [*ROWS, ROWS[5], (None, "no id"), (None, None)]).repartition(3)
    out = STAGES[name](spark, docs, folder)
    if name != list(STAGES)[-1]:
        assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and {r["doc_id"] for r in rows} <= {i for i, _ in ROWS} | {None}
    assert all(r["_c"] == 7 for r in rows)  # other columns pass through
    assert STAGES[name](spark, docs.limit(0), folder).collect() == []


def test_quality_stage_rejects_what_the_classifier_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in STAGES["quality classifier"](spark, docs, SF).collect()}
    assert kept == {r["doc_id"] for r in quality_rff.quality_scores(docs, labels).where("predicted = 1").collect()}


def test_near_duplicates_keep_the_smallest_of_each_group(spark, folder):
    kept = sorted(r["doc_id"] for r in STAGES["simhash near-dedup"](spark, table(spark), folder).collect())
    groups = brute.components({i: brute.simhash(t) for i, t in ROWS})
    assert kept == sorted(set(groups.values()))


def test_repeated_rows_leave_one(spark, folder):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, "other words that have no id at all"), (None, "other words that have no id at all")], "doc_id long, text string")
    assert sorted(map(tuple, STAGES["simhash near-dedup"](spark, docs, folder).collect()), key=str) == [(1, "same"), (None, "other words that have no id at all")]


def test_whole_pipeline(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    good = {r["doc_id"] for r in STAGES["quality classifier"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    lines = {i: x[2] for i, x in brute.line_dedup([(i, docs[i]) for i in sorted(good)]).items()}
    groups = brute.components({i: brute.simhash(t) for i, t in lines.items()})
    want = {}
    for i in set(groups.values()):
        n, hit, _ = brute.contamination(lines[i], items)
        if hit <= 0.5 * n:
            want[i] = hit
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert brute.contamination(r["text"], items)[1] == 0
        assert r["n_chars"] == len(r["text"]) and r["n_tokens"] == len(r["ids"])
        if not want[i]:
            assert r["text"] == lines[i] and brute.pieces(r["text"])[:2] == (len(r["ids"]), brute.sha(" ".join(map(str, r["ids"]))))


def test_benchmark_and_lines_change_n_chars(spark, folder):
    rows = [(i, f"{LINE}\nLine number {i} of its own document here.") for i in range(4)]
    docs = table(spark, rows)
    for r in STAGES["line dedup"](spark, docs, folder).collect():
        assert r["n_chars"] == len(r["text"]) and (LINE in r["text"]) == (r["doc_id"] == 3)
    docs = table(spark, [(1, "some lead words of a text that goes on for long enough to stay in the corpus when a passage is cut out of it " + PASSAGE)])
    r = STAGES["benchmark decontamination"](spark, docs, folder).first()
    assert "theta" not in r["text"] and r["n_chars"] == len(r["text"])


def test_token_columns_in_other_letter_case(spark, folder):
    docs = table(spark, ROWS[:8]).selectExpr("doc_id", "text", "lang", "1 as IDS", "2 as N_Tokens")
    out = STAGES["sentencepiece encoding and decoding"](spark, docs, folder)
    assert [c for c in out.columns if c.lower() in ("ids", "n_tokens")] == ["n_tokens", "ids"] and out.count() == 8
