"""Readers on small hand-written files (formats the driver round trips do not exercise)."""
import json
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from cadenza.operators import features as V
from cadenza.sources import files as S


def _tmp():
    return tempfile.mkdtemp(prefix="cadenza-src-")


def test_song_json_arrays_fallback_genre_and_corrupt_file(spark):
    d = _tmp()
    with open(os.path.join(d, "rock-cp.json"), "w") as f:
        json.dump([{"title": "A", "artist": "x", "genre": "  ", "chord_progression": {"main": "C - G"}},
                   {"title": "B", "artist": "y", "genre": "hip HOP", "chord_progression": "not a map", "lyrics": None},
                   {"title": "C", "artist": "z", "popularity": 5}], f)
    with open(os.path.join(d, "jazz.json"), "w") as f:
        json.dump([{"title": "A", "artist": "x", "genre": "jazz"}], f)
    with open(os.path.join(d, "broken.json"), "w") as f:
        f.write("{ not json")
    rows = {(r["title"], r["source_file"]): r for r in S.read_song_json(spark, d).collect()}
    assert rows[("A", "rock-cp.json")]["main_genre"] == "Rock"          # blank genre -> file stem without -cp
    assert rows[("B", "rock-cp.json")]["main_genre"] == "Hip hop"       # capitalize, not initcap
    assert rows[("B", "rock-cp.json")]["chord_progression"] == {}       # non-dict -> empty map
    assert rows[("B", "rock-cp.json")]["lyrics"] == ""                  # null lyrics -> ''
    assert rows[("C", "rock-cp.json")]["popularity"] == 5.0
    assert rows[("A", "jazz.json")]["main_genre"] == "Jazz"
    assert not any(k[1] == "broken.json" for k in rows)                 # unreadable file skipped
    pairs = {(r["artist"], r["title"]) for r in S.read_title_artist_pairs(spark, d).collect()}
    assert pairs == {("x", "A"), ("y", "B"), ("z", "C")}


def test_mixed_delimiter_short_rows_and_quotes(spark):
    d = _tmp()
    with open(os.path.join(d, "songs.csv"), "w") as f:
        f.write('"spotify_id","name","artist","extra"\n')
        f.write('1;"Song One" ;Band;x\n')
        f.write('2;"Two ""quoted"""\n')
        f.write('3\n')
    r = {x["spotify_id"]: x for x in S.read_mixed_delim(spark, d).collect()}
    assert r["1"]["title"] == "Song One" and r["1"]["artist"] == "Band"
    assert r["2"]["title"] == 'Two "quoted' and r["2"]["artist"] == ""
    assert r["3"]["title"] == "" and r["3"]["artist"] == ""


def test_charts_tree_layout_and_filters(spark):
    d = _tmp()
    for country, year in (("de", 2019), ("de", 2020), ("fr", 2020)):
        p = os.path.join(d, country, str(year))
        os.makedirs(p)
        with open(os.path.join(p, "week1.tsv"), "w") as f:
            f.write("artist\tsong_name\tsong_id\n Band \tSong\t%s%d\n" % (country, year))
    r = S.read_charts(spark, d, years=[2020], countries=["de"]).collect()
    assert [(x["artist"], x["song_id"], x["country"], x["year"]) for x in r] == [("Band", "de2020", "de", 2020)]


def test_columns_by_header_short_row(spark):
    df = spark.createDataFrame([(["1", " t ", "a"],), (["2"],)], "cells array<string>")
    out = S.columns_by_header(df, ["#", "Track", "Artist"]).collect()
    assert out[0]["track"] == "t" and out[0]["parse_errors"] is None and out[0]["bpm"] is None
    assert out[1]["track"] == "Missing Column" and out[1]["parse_errors"] is True
    assert "bpm" in S.missing_headers(spark, ["#", "Track", "Artist"])


def test_multihot_above_the_codegen_size(spark, monkeypatch):
    df = spark.createDataFrame([(1, {"main": "C - G", "b": "Am"}), (2, {"main": "F"}), (3, None)],
                               "id int, prog map<string,string>")
    vocab = V.fit_vocab(df, "prog")
    small = {r["id"]: r["h"] for r in V.multihot(df, "prog", vocab, "h").collect()}
    monkeypatch.setattr(V, "CODEGEN_WORDS", 1)
    assert small == {r["id"]: r["h"] for r in V.multihot(df.repartition(3), "prog", vocab, "h").collect()}


def test_multihot_of_2001_words_on_a_repartitioned_frame(spark):
    df = spark.range(2001).select("id", F.create_map(F.lit("main"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 4, "0"))).alias("prog"))
    vocab = V.fit_vocab(df, "prog")
    rows = V.multihot(df.repartition(7), "prog", vocab, "h").select("id", F.size("h").alias("n"), (F.array_position("h", 1) - 1).alias("at"),
                                                                   F.aggregate("h", F.lit(0), lambda a, x: a + x).alias("ones")).collect()
    assert len(rows) == 2001 and all((r["n"], r["at"], r["ones"]) == (2001, r["id"], 1) for r in rows)


def _tsv(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_delimited_readers_bind_by_header_name(spark, tmp_path):
    _tsv(tmp_path / "hits" / "a.tsv", "song_id\textra\tenergy\tartist_name\tsong_name\n 7 \tx\t0.5\t A \tT\n")
    r = S.read_hits_tsv(spark, str(tmp_path / "hits")).first()
    assert (r["id"], r["artist"], r["title"], r["energy"], r["acousticness"]) == ("7", "A", "T", "0.5", "")
    _tsv(tmp_path / "tracks" / "t.csv", 'album,id,artists,name,energy\nx,1,"A, B","line one\nline two",0.1\n')
    r = S.read_tracks_csv(spark, str(tmp_path / "tracks")).first()
    assert (r["id"], r["artist"], r["title"], r["energy"], r["danceability"]) == ("1", "A, B", "line one\nline two", "0.1", "")


def test_charts_skip_stray_files_and_unwanted_folders(spark, tmp_path):
    _tsv(tmp_path / "de" / "2020" / "w1.tsv", "rank\tsong_name\tartist\tsong_id\n1\tT\t A\t9\n")
    _tsv(tmp_path / "de" / "2021" / "w1.tsv", "artist\tsong_name\tsong_id\nB\tU\t8\n")
    _tsv(tmp_path / "notes.txt", "hello\n")
    _tsv(tmp_path / "de" / "readme" / "x.txt", "hello\n")
    r = S.read_charts(spark, str(tmp_path), years=[2020])
    assert [tuple(x) for x in r.collect()] == [("A", "T", "9", "de", 2020)]
    assert len(r.inputFiles()) == 1  # only the wanted folder is read
    with pytest.raises(Exception):
        S.read_charts(spark, str(tmp_path), countries=["fr"]).collect()


def test_pairs_need_a_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_title_artist_pairs(spark, str(tmp_path))


def test_resolve_link_cases(spark):
    df = spark.createDataFrame([("https://a.b/x/y?q=1", "z"), ("https://a.b/x/y", "/r"), ("http://a.b/", "//c.d/e"),
                                ("http://a.b/", "https://o.p/")], "u string, h string")
    got = [r[0] for r in df.select(S.resolve_link(F.col("u"), F.col("h"))).collect()]
    assert got == ["https://a.b/x/z", "https://a.b/r", "http://c.d/e", "https://o.p/"]


def test_versions_are_committed_by_compare_and_set(spark, tmp_path):
    import pytest

    from cadenza.sources import versions as VS
    base = f"file://{tmp_path}/table"
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    assert VS.current_version(spark, base).number == 0
    with pytest.raises(ValueError):
        VS.read_version(spark, base)
    VS.commit_version(spark, rows(1), base, 0)
    # two writers from version 1: the second one must start anew
    VS.commit_version(spark, rows(1, 2), base, 1, consumed=["side-a"])
    with pytest.raises(VS.VersionConflict):
        VS.commit_version(spark, rows(1, 3), base, 1, consumed=["side-b"])
    # a writer that dies before its commit leaves files that no reader sees
    rows(9).write.parquet(f"{base}/data-dead")
    assert sorted(r.x for r in VS.read_version(spark, base).collect()) == [1, 2]
    assert VS.pending(spark, base, ["side-a", "side-b"]) == ["side-b"]  # consumed by the commit itself
    calls = []

    def change(old):
        calls.append(1)
        if len(calls) == 1:  # another writer comes first
            VS.commit_version(spark, rows(1, 2, 4), base, 2)
        return old.unionByName(rows(5))

    done = VS.update(spark, base, change, consumed=["side-b"])
    assert done.number == 4 and len(calls) == 2
    assert sorted(r.x for r in VS.read_version(spark, base).collect()) == [1, 2, 4, 5]
    assert [r.x for r in VS.read_version(spark, base, 1).collect()] == [1] and VS.pending(spark, base, ["side-a", "side-b"]) == []


def test_quoted_line_feeds_across_split_borders(spark, tmp_path):
    import csv
    import io
    import random

    from cadenza.sources.records import ends_quoted, read_records
    rng = random.Random(3)
    rows = [[f"id{i}", rng.choice(['plain', 'two\nlines', 'semi;colon', 'a "quoted" word', 'three\n\n"lines";\nhere', '5" disk']), "x" * rng.randrange(40)] for i in range(300)]
    lines = []
    for r in rows:
        if r[1] == '5" disk':  # a quote inside an unquoted field opens nothing
            lines.append(";".join(r))
        else:
            f = io.StringIO()
            csv.writer(f, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
            lines.append(f.getvalue())
    head = '"spotify_id","name","artist"'
    for name, part in (("a.csv", lines[:150]), ("b.csv", lines[150:])):
        (tmp_path / name).write_text("\n".join([head, *part, ""]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "257")  # splits end in the middle of records
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = read_records(spark, str(tmp_path)).collect()
        assert sum(r["first"] for r in got) == 2 and sorted(r["value"] for r in got if not r["first"]) == sorted(lines)
        names = {r["spotify_id"]: r["title"] for r in S.read_mixed_delim(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert names == {r[0]: r[1].strip('"') for r in rows}
    assert ends_quoted('a;"b', ";", False) and not ends_quoted('b";c', ";", True) and ends_quoted('b"";c', ";", True) and not ends_quoted('5" disk;x', ";", False)
