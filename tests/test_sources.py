"""Raw formats on small literal files."""

import json

import pytest
from pyspark.sql import functions as F

from seasonlake import catalog
from seasonlake.functions import nested
from seasonlake.operators.rosters import settings_from_ids, settings_from_lists
from seasonlake.sources import pages, readers


def test_nested_json_flattens(spark, tmp_path, as_rows):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"a": 1, "b": {"c": 2, "d": {"e": "x"}}, "l": [1, 2]}, {"a": 2, "b": None, "l": None}]))
    got = as_rows(readers.records_json(spark, str(path)), "a")
    assert got == [{"a": 1, "b.c": 2, "b.d.e": "x", "l": [1, 2]}, {"a": 2, "b.c": None, "b.d.e": None, "l": None}]
    (tmp_path / "one.json").write_text(json.dumps({"a": 5, "b": {"c": 1}}))
    assert as_rows(readers.records_json(spark, str(tmp_path / "one.json"))) == [{"a": 5, "b.c": 1}]


def test_map_of_records(spark, as_rows):
    df = spark.createDataFrame([('{"7": {"n": "x", "v": 1}, "8": {"n": "y", "v": null}}',)], "t string")
    got = as_rows(nested.map_of_records(df, "t", "struct<n:string,v:bigint>"), "n")
    assert got == [{"n": "x", "v": 1}, {"n": "y", "v": None}]


def test_tagged_json_skips_error_files(spark, tmp_path, as_rows):
    (tmp_path / "adp_half-ppr_2020.json").write_text(json.dumps({"players": [{"name": "A", "adp": 1.5}]}))
    (tmp_path / "adp_ppr_2021.json").write_text(json.dumps({"players": [{"name": "B", "adp": 2.5}, {"name": "C", "adp": 3.0}]}))
    (tmp_path / "adp_ppr_2015.json").write_text(json.dumps({"status": "Error"}))
    got = readers.tagged_json(spark, str(tmp_path / "adp_*.json"), "adp", "struct<name:string,adp:double>")
    assert as_rows(got, "name") == [
        {"name": "A", "adp": 1.5, "scoring_format": "half-ppr", "season": 2020},
        {"name": "B", "adp": 2.5, "scoring_format": "ppr", "season": 2021},
        {"name": "C", "adp": 3.0, "scoring_format": "ppr", "season": 2021},
    ]


def test_season_csv(spark, tmp_path, as_rows):
    head = "Rank,Player (Bye),POS,AVG\n"
    (tmp_path / "Ranks_2019_Overall.csv").write_text(head + "1,Saquon Barkley  NYG (11),RB1,1.3\n2,Chicago Bears  (6),DST1,120\n")
    (tmp_path / "Ranks_other.csv").write_text(head + "9,Nobody,QB1,9\n")
    got = as_rows(readers.season_csv(spark, str(tmp_path / "Ranks_*.csv"), r"Ranks_(\d{4})_Overall\.csv"), "rank")
    assert [(r["season"], r["name"], r["team"], r["bye"], r["position"], r["position_rank"], r["adp"]) for r in got] == [
        (2019, "Saquon Barkley", "NYG", 11, "RB", 1, 1.3), (2019, "Chicago Bears", None, 6, "DST", 1, 120.0),
    ]


def test_broken_files_give_no_rows_or_their_text(spark, tmp_path, as_rows):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": {"c": 2}}, {"a": 3, "b": None}], indent=2))
    (tmp_path / "b.json").write_text('[{"a": 5, "b": {"c"')
    kind = "a long, b struct<c:long>"
    sound = readers.records_json(spark, str(tmp_path), kind)
    assert sound.count() == 2
    assert as_rows(sound, "a") == [{"a": 1, "b.c": 2}, {"a": 3, "b.c": None}]
    assert as_rows(readers.records_json(spark, str(tmp_path)), "a") == as_rows(sound, "a")
    kept = readers.records_json(spark, str(tmp_path), kind, keep_broken=True).collect()
    assert [r["_broken"] for r in kept if r["_broken"]] == ['[{"a": 5, "b": {"c"']


def test_season_csv_of_different_headers(spark, tmp_path, as_rows):
    (tmp_path / "Ranks_2019_Overall.csv").write_text('Rank,Player (Bye),POS,AVG\n1,"A, Jr.  NYG (11)",RB1,1.3\n2,short\n')
    (tmp_path / "Ranks_2020_Overall.csv").write_text("POS,Rank,Player (Bye)\nWR2,4,B  KC (6)\n")
    (tmp_path / "Ranks_2021_Overall.csv").write_text("")
    glob, name = str(tmp_path / "Ranks_*.csv"), r"Ranks_(\d{4})_Overall\.csv"
    got = as_rows(readers.season_csv(spark, glob, name), "rank")
    assert [(r["season"], r["rank"], r["name"], r["team"], r["position_rank"], r["adp"]) for r in got] == [
        (2019, 1, "A, Jr.", "NYG", 1, 1.3), (2020, 4, "B", "KC", 2, None),
    ]
    assert readers.season_csv(spark, glob, name).count() == 2
    kept = readers.season_csv(spark, glob, name, keep_broken=True).where("_broken IS NOT NULL").collect()
    assert [r["_broken"] for r in kept] == ["2,short"]
    assert readers.season_csv(spark, glob, r"Other_(\d+)\.csv") is None


def test_embedded_json_takes_the_first_match_or_fails(spark, as_rows):
    html = 'x var ecrData = {"players":[{"id":1},{"id":2}]};\nvar ecrData = {"players":[{"id":9}]};'
    df = spark.createDataFrame([(1, html)], "page long, html string")
    assert [r["id"] for r in as_rows(readers.embedded_records(df, "html", "ecrData", "struct<id:bigint>"), "id")] == [1, 2]
    bad = spark.createDataFrame([(1, "nothing")], "page long, html string")
    with pytest.raises(Exception, match="no ecrData"):
        readers.embedded_records(bad, "html", "ecrData", "struct<id:bigint>").collect()


MARKED = """<table><tr class="TableBase-bodyTr"><td><span class="CellPlayerName--short">x</span>
<span class="CellPlayerName--long"><span><a href="/nfl/players/77/a-b/">A &amp; B</a><span class="CellPlayerName-team"> KC </span></span></span></td>
<td class="TableBase-bodyTd TableBase-bodyTd--number"> 9 </td><td class="TableBase-bodyTd--number">1,234.5</td><td class="TableBase-bodyTd--number">
 72.6 </td></tr>
<tr class="TableBase-bodyTr"><td><a href="/x"></a><span class="TeamName"><a href="/nfl/teams/LAR/">Rams</a></span></td>
<td class="TableBase-bodyTd--number">100</td><td class="TableBase-bodyTd--number">6</td></tr>
<tr class="TableBase-bodyTr"><td>short</td><td class="TableBase-bodyTd--number">1</td></tr>
<tr class="TableBase-bodyTr"><td><span class="CellPlayerName--long"><a href="/nfl/players/8/">C</a></span></td>
<td class="TableBase-bodyTd--number">—</td><td class="TableBase-bodyTd--number">6</td></tr></table>"""


def test_marked_table(spark, as_rows):
    df = spark.createDataFrame([(1, MARKED), (2, "<p>no table</p>")], "page_id long, html string")
    got = [(r["entity_id"], r["name"], r["team"], r["points"], r["fppg"]) for r in as_rows(pages.marked_rows(df), "row_no")]
    assert got == [(77, "A & B", "KC", 1234.5, 72.6), (None, "Rams", "LA", 100.0, 6.0)]


LAYERED = """<table><tr><td>menu</td><td>FPts</td></tr><tr><td><table><tr><td>x</td></tr></table></td></tr><tr><td>
<TABLE_IGNORED><table class="d"><tr><th>Chg</th><th>Player</th><th>Team</th><th>FPts</th></tr>
<tr><td></td><td><a href="#">Odell Beckham Jr.</a></td><td>MIA</td><td>1,001.5</td></tr><tr><td>only</td><td>two</td></tr>
<tr><td></td><td>Bad</td><td>X</td><td>n/a</td></tr></table></td></tr></table>"""


def test_header_table(spark, as_rows):
    df = spark.createDataFrame([(1, LAYERED)], "page_id long, html string")
    got = as_rows(pages.header_rows(df), "row_no")
    assert [(r["merge_name"], r["name"], r["team"], r["points"]) for r in got] == [("odell beckham", "Odell Beckham Jr.", "MIA", 1001.5)]
    unit = pages.header_rows(
        spark.createDataFrame([(1, LAYERED.replace("Odell Beckham Jr.", "Houston Texans"))], "page_id long, html string"),
        is_team=F.lit(True),
    )
    assert [(r["merge_name"], r["team"]) for r in as_rows(unit)] == [(None, "HOU")]


def test_page_batch_metadata(spark, as_rows):
    meta = spark.createDataFrame([(1, "QB", "ppr", 2026)], "page_id long, position string, scoring string, season long")
    df = spark.createDataFrame([(1, MARKED)], "page_id long, html string")
    got = pages.with_metadata(meta, pages.marked_rows(df), "page_id")
    assert {(r["position"], r["scoring"], r["season"]) for r in as_rows(got)} == {("QB", "ppr", 2026)}


def test_ragged_parquet_union(spark, tmp_path):
    spark.range(3).withColumn("a", F.lit("x")).write.parquet(str(tmp_path / "p1"))
    spark.range(2).withColumn("b", F.lit(1.0)).write.parquet(str(tmp_path / "p2"))
    df = readers.seasons_union(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")])
    assert set(df.columns) == {"id", "a", "b"} and df.count() == 5


def test_coercion(spark, as_rows):
    df = spark.createDataFrame([("1.5", True), ("bad", False), (None, None)], "a string, b boolean")
    got = as_rows(readers.coerced(df, ["a", "b"]))
    assert got == [{"a": 1.5, "b": 1.0}, {"a": None, "b": 0.0}, {"a": None, "b": None}]


def test_settings_of_both_formats(spark, as_rows):
    a = spark.createDataFrame(
        [("9", 12, ["QB", "RB", "RB", "FLEX", "SUPER_FLEX", "BN"], 0.5)], "league_id string, n int, roster_positions array<string>, rec double"
    )
    one = as_rows(settings_from_lists(a, "first", {"rec_pts": "rec"}, {"team_count": "n"}))[0]
    assert (one["rb_slots"], one["superflex_slots"], one["te_slots"], one["punt_pts"], one["rec_pts"]) == (2, 1, 0, 0.0, 0.5)
    text = "[{'statId': 53, 'points': 1.0}, {'statId': 138, 'points': 0.25}]"
    b = spark.createDataFrame([(text, {"0": 1, "7": 0, "23": 2}, 10)], "t string, slots map<string,bigint>, n int").withColumn(
        "items", nested.literal_items(F.col("t"))
    )
    two = as_rows(settings_from_ids(b, "second", "items", "slots", {"team_count": "n"}))[0]
    assert (two["rec_pts"], two["punt_pts"], two["pass_yd_pts"]) == (1.0, 0.25, 0.0)
    assert (two["qb_slots"], two["flex_slots"], two["bench_slots"]) == (1, 2, 0)


def test_catalog(spark, as_rows):
    df = spark.range(7).withColumn("name", F.lit("Pat O'Donnell"))
    assert catalog.replace_table(spark, "weekly_stats_x", df) == 7
    assert catalog.replace_table(spark, "weekly_stats_x", df.limit(3)) == 3
    catalog.replace_table(spark, "board_x", df.limit(2))
    listing = as_rows(catalog.tables(spark).where(F.col("table").endswith("_x")), "table")
    assert listing == [{"table": "board_x", "layer": "gold", "rows": 2}, {"table": "weekly_stats_x", "layer": "silver", "rows": 3}]
    assert as_rows(catalog.tables(spark, "silver").where(F.col("table") == "board_x")) == []
    assert [r["column_name"] for r in as_rows(catalog.columns(spark, "board_x"))] == ["id", "name"]
    assert catalog.peek(spark, "board_x", 1).count() == 1
    assert catalog.q(spark, "SELECT * FROM board_x WHERE name = ?", ["Pat O'Donnell"]).count() == 2
    with pytest.raises(ValueError):
        catalog.q(spark, "DROP TABLE board_x")
    for text in ("WITH x AS (SELECT 7L AS id, 'b' AS name) INSERT INTO board_x SELECT id, name FROM x", "", " ; "):
        with pytest.raises(ValueError):
            catalog.q(spark, text)
    assert spark.table("board_x").count() == 2
    assert catalog.q(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x -- one").count() == 1
    totals = as_rows(catalog.summarize(catalog.tables(spark).where(F.col("table").endswith("_x")), brief=True), "layer")
    assert totals == [{"layer": "gold", "tables": 1, "rows": 2}, {"layer": "silver", "tables": 1, "rows": 3}]
    assert catalog.replace_table(spark, "board_x", spark.createDataFrame([()], "struct<>")) is None
    assert not spark.catalog.tableExists("board_x")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("board_x")]


def test_replacement_shows_old_rows_or_new(spark):
    name, versions = "swap_x", lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith("swap_x__v_")]
    spark.range(5).write.saveAsTable(name)  # a plain table from elsewhere
    assert catalog.replace_table(spark, name, spark.range(4).withColumn("a", F.lit("x"))) == 4
    held = spark.table(name)
    broken = spark.range(9).withColumn("a", F.when(F.col("id") == 8, F.raise_error(F.lit("stop")).cast("string")).otherwise("y"))
    with pytest.raises(Exception, match="stop"):
        catalog.replace_table(spark, name, broken)
    assert spark.table(name).count() == 4 and len(versions()) == 2
    # the new rows may be made from the old ones, and a reader that began keeps its rows
    assert catalog.replace_table(spark, name, spark.table(name).where("id < 3").drop("a")) == 3
    assert held.count() == 4 and spark.table(name).columns == ["id"] and len(versions()) == 2
    assert catalog.replace_table(spark, name, spark.range(0)) == 0 and spark.table(name).count() == 0
    catalog.replace_table(spark, name, spark.range(0).select())
    assert not spark.catalog.tableExists(name) and versions() == []
