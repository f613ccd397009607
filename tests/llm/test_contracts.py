"""Each dealt operator against brute force, on edge rows and on whole small tables."""
import brute
import duckdb
import pytest
from brute import ROWS, sha, table

from cadenza.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """A folder of tables with the edge rows."""
    d = str(tmp_path_factory.mktemp("edge"))
    table(spark).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(brute.ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, n % 2 if n % 5 else None, 0) for n, (i, _) in enumerate(ROWS)] + [(None, 1, 0), (ROWS[3][0], 1, None), (999999, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, edge, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{edge}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    for t in ("embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def small(name, sf=SF):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet' ORDER BY ALL").fetchall()


def both(spark, edge, name):
    """(rows by doc_id, {doc_id: text}, folder) for the edge rows and a driver table."""
    for d, rows in ((edge, ROWS), (SF, [r[:2] for r in small("documents")])):
        got = queries.QUERIES[name](spark, d).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        yield {r.doc_id: r for r in got}, dict(rows), d


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_secrets(spark, edge):
    for got, rows, _ in both(spark, edge, "op1_secret_scan"):
        for i, t in rows.items():
            base = [f"{k}:{a}:{b}" for k, a, b in brute.secrets(t)]
            assert got[i].base_sha256 == sha(",".join(base)), t
            spans = got[i].spans.split(",") if got[i].spans else []
            assert [s for s in spans if not s.startswith("random")] == base
            assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))


def test_decontaminate(spark, edge):
    for got, rows, d in both(spark, edge, "op2_decontaminate"):
        items = brute.ITEMS if d == edge else small("benchmark")
        for i, t in rows.items():
            n, hit, found = brute.contamination(t, items)
            found = [x for x in found if x != "None"]
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), sha(",".join(found)), hit > 0), t


def test_token_files(spark, edge):
    for got, rows, _ in both(spark, edge, "op3_token_files"):
        assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.values()) == brute.token_rows(list(rows.items()))


def test_personal_data(spark, edge):
    for got, rows, _ in both(spark, edge, "op4_personal_data"):
        for i, t in rows.items():
            base = [f"{k}:{a}:{b}" for k, a, b in brute.pii(t)]
            assert got[i].base_sha256 == sha(",".join(base)), t
            assert set(base) <= set(got[i].spans.split(","))| {""}
            assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone"))


def test_pieces(spark, edge):
    for got, rows, _ in both(spark, edge, "op5_piece_bpe"):
        for i, t in rows.items():
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == brute.pieces(t), t


def test_line_dedup(spark, edge):
    for got, rows, _ in both(spark, edge, "op6_line_dedup"):
        want = brute.line_dedup(list(rows.items()))
        for i in rows:
            assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (*want[i][:2], sha(want[i][2]))


def test_quality(spark, edge):
    import zlib

    for got, rows, _ in both(spark, edge, "op7_quality"):
        for i in rows:
            r = got[i]
            assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_simhash(spark, edge):
    for got, rows, _ in both(spark, edge, "op8_simhash"):
        prints = {i: brute.simhash(t) for i, t in rows.items()}
        groups = brute.components(prints)
        for i in rows:
            assert (got[i].fingerprint, got[i].component_id) == (f"{prints[i]:016x}", groups[i])


def test_rules(spark, edge):
    for got, rows, _ in both(spark, edge, "op9_quality_rules"):
        for i, t in rows.items():
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(t), t
            assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, edge, name):
    from cadenza.plans.oracle import compare, con_for
    from cadenza.plans.registry import Query

    for d in (SF, edge):
        con = con_for(SF)
        if d == edge:
            con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{edge}/documents.parquet/*.parquet')")
        r = compare(spark, con, d, Query(name, queries.QUERIES[name], queries.ORACLES[name]))
        assert r["ok"] and not r["unsafe"], r
