"""Raw formats: scans, nested JSON, pages, sinks and the catalog."""

import uuid

from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame, functions as F

from seasonlake import catalog
from seasonlake.functions import nested, text
from seasonlake.operators.rosters import settings_from_ids, settings_from_lists
from seasonlake.plans.bindings import Tables, cents
from seasonlake.plans.oracle_parts import ENT, O
from seasonlake.plans.registry import query
from seasonlake.session import pinned, shared_folder
from seasonlake.sources import pages as page_ops, readers


def shared_path(t: Tables, name: str) -> str:
    return shared_folder(t.spark, name)


@query(
    "scan_union",
    """SELECT n_nationkey, n_name, n_regionkey, NULL AS r_regionkey, NULL AS r_name FROM nation
       UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region""",
)
def scan_union(t: Tables) -> DataFrame:
    """Files with different columns read as one table."""
    return readers.seasons_union(t.spark, [t.path("nation"), t.path("region")]).select(
        "n_nationkey", "n_name", "n_regionkey", "r_regionkey", "r_name"
    )


@query(
    "scan_pruned",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity BETWEEN 40 AND 45""",
)
def scan_pruned(t: Tables) -> DataFrame:
    """Equality and range filters with three of eleven columns, pushed to the scan."""
    keep = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & F.col("l_quantity").between(40, 45)
    return readers.pruned(t.raw("lineitem"), keep, ["l_orderkey", "l_linenumber", "l_quantity"])


@query(
    "scan_stamped",
    """SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance FROM customer WHERE c_acctbal IS NOT NULL
       UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier
       UNION ALL SELECT 'part', p_partkey, NULL FROM part""",
)
def scan_stamped(t: Tables) -> DataFrame:
    """Three feeds in one table with a stamped key; a missing column stays NULL."""
    return readers.stamped(
        {
            "customer": t.raw("customer").where(F.col("c_acctbal").isNotNull()).select(
                F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")),
            "supplier": t.raw("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")),
            "part": t.raw("part").select(F.col("p_partkey").alias("key")),
        },
        "kind",
    )


@query(
    "scan_coerced",
    """SELECT event_id, TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value,
         CAST(CAST(event_type = 'click' AS INT) AS DOUBLE) AS is_click FROM events""",
)
def scan_coerced(t: Tables) -> DataFrame:
    """Mixed text and booleans to doubles; what is no number becomes NULL."""
    mixed = F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.col("value").cast("string"))
    df = t.raw("events").select("event_id", mixed.alias("value"), (F.col("event_type") == "click").alias("is_click"))
    return readers.coerced(df, ["value", "is_click"])


@query(
    "scan_guard",
    f"""WITH {O}, s AS (SELECT *, season >= 1998 AS new_era FROM o WHERE season >= 1996)
    SELECT season, new_era, count(*) AS n FROM s WHERE NOT (status IN ('P') AND week = 1)
      AND season < (SELECT max(season) FROM o) GROUP BY ALL""",
)
def scan_guard(t: Tables) -> DataFrame:
    """Season floor, era split, exclusion list and a scalar bound."""
    newest = t.newest_season()
    # the same floor on the stored date reaches the scan
    df = readers.since(t.orders(first=1996), 1996).withColumn("new_era", F.col("season") >= 1998)
    df = df.where(~(F.col("status").isin("P") & (F.col("week") == 1)) & (F.col("season") < newest))
    return df.groupBy("season", "new_era").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snapshot_season",
    """SELECT CAST(year(ts) - CASE WHEN month(ts) < 7 THEN 1 ELSE 0 END AS BIGINT) AS season, event_type, count(*) AS n
       FROM events GROUP BY ALL""",
)
def snapshot_season(t: Tables) -> DataFrame:
    """Season of a dated snapshot from its ISO text."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.raw("events").select(text.snapshot_season(stamp).alias("season"), "event_type").groupBy(
        "season", "event_type"
    ).agg(F.count(F.lit(1)).alias("n"))


SOURCE_ID = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
_RECORD = (
    "struct<player:struct<id:bigint,first_name:string,last_name:string,"
    "stats:array<struct<statSourceId:int,scoringPeriodId:int,appliedTotal:bigint>>>,team:string>"
)


def record_texts(t: Tables) -> DataFrame:
    """One JSON record per (entity, season) with at most ten stats in it."""
    number = None
    for name, i in SOURCE_ID.items():
        number = F.when(F.col("source") == name, i) if number is None else number.when(F.col("source") == name, i)
    half = F.when(F.col("week") <= 6, 0).otherwise(1)
    stats = t.orders().groupBy(
        "entity_id", "season", number.alias("statSourceId"), half.alias("scoringPeriodId")
    ).agg(F.sum("points_c").alias("appliedTotal"))
    stats = stats.groupBy("entity_id", "season").agg(
        F.sort_array(F.collect_list(F.struct("statSourceId", "scoringPeriodId", "appliedTotal"))).alias("stats")
    )
    df = stats.join(t.entities(), "entity_id")
    names = F.split("entity_name", "#")
    player = F.struct(
        F.col("entity_id").alias("id"), names[0].alias("first_name"),
        F.when(F.col("entity_id") % 10 != 0, names[1]).alias("last_name"), "stats",
    )
    return df.select("season", F.to_json(F.struct(player.alias("player"), "team")).alias("record"))


@query(
    "json_fields",
    f"""WITH {O}, {ENT},
    s AS (SELECT entity_id, season, CAST(sum(points_c) AS BIGINT) AS projected_c FROM o WHERE source = '2-HIGH' AND week <= 6 GROUP BY ALL)
    SELECT entity_id, season, split_part(entity_name, '#', 1) || ' ' || CASE WHEN entity_id % 10 <> 0 THEN split_part(entity_name, '#', 2) ELSE '' END AS player_name,
      team, projected_c FROM s JOIN ent USING (entity_id)""",
)
def json_fields(t: Tables) -> DataFrame:
    """Nested records: null-safe fields and the first stat that matches, else dropped."""
    parsed = record_texts(t).select("season", F.from_json("record", _RECORD).alias("r"))
    hit = nested.first_match(
        F.col("r.player.stats"), lambda s: (s["statSourceId"] == 2) & (s["scoringPeriodId"] == 0)
    )
    name = F.concat(
        F.coalesce("r.player.first_name", F.lit("")), F.lit(" "), F.coalesce("r.player.last_name", F.lit(""))
    )
    return parsed.withColumn("hit", hit).where(F.col("hit").isNotNull()).select(
        F.col("r.player.id").alias("entity_id"), "season", name.alias("player_name"),
        F.col("r.team").alias("team"), F.col("hit.appliedTotal").alias("projected_c"),
    )


@query(
    "json_flatten",
    """SELECT event_id, event_type, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS "props.k",
         user_id AS "who.user_id", value AS "who.value" FROM events""",
)
def json_flatten(t: Tables) -> DataFrame:
    """Nested structs to dotted columns."""
    df = t.raw("events").select(
        "event_id", "event_type", F.from_json("props", "struct<k:bigint>").alias("props"),
        F.struct("user_id", "value").alias("who"),
    )
    return nested.flatten_structs(df)


@query(
    "json_map_records",
    """SELECT n_name AS team, c_mktsegment AS position, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS balance_c
       FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""",
)
def json_map_records(t: Tables) -> DataFrame:
    """``{id: record}`` text per team, exploded to rows."""
    nation = t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("team"))
    sums = t.raw("customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("position")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("c_acctbal")).alias("balance_c")
    ).join(nation, "c_nationkey")
    record = F.struct("team", "position", "n", "balance_c")
    texts = sums.groupBy("team").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("position"), record)))).alias("blob")
    )
    return nested.map_of_records(texts, "blob", "struct<team:string,position:string,n:bigint,balance_c:bigint>")


_IDS = {"urgent_pts": 1, "high_pts": 2, "medium_pts": 3, "missing_pts": 99}
_SLOT_IDS = {"building_slots": "2", "furniture_slots": "4", "missing_slots": "23"}


@query(
    "settings_nested",
    f"""WITH {O}, {ENT},
    p AS (SELECT team, season, source, CAST(sum(points_c) AS DOUBLE) / 4 AS pts, count(*) FILTER (WHERE position = 'BUILDING') AS b,
             count(*) FILTER (WHERE position = 'FURNITURE') AS f FROM o JOIN ent USING (entity_id) GROUP BY ALL)
    SELECT team AS league_key, CAST(season AS VARCHAR) AS league_id, CAST(count(*) AS INT) AS team_count,
      COALESCE(max(pts) FILTER (WHERE source = '1-URGENT'), 0.0) AS urgent_pts, COALESCE(max(pts) FILTER (WHERE source = '2-HIGH'), 0.0) AS high_pts,
      COALESCE(max(pts) FILTER (WHERE source = '3-MEDIUM'), 0.0) AS medium_pts, 0.0::DOUBLE AS missing_pts,
      CAST(sum(b) AS BIGINT) AS building_slots, CAST(sum(f) AS BIGINT) AS furniture_slots, CAST(0 AS BIGINT) AS missing_slots,
      count(*) FILTER (WHERE b > f) AS rb_listed
    FROM p GROUP BY team, season""",
)
def settings_nested(t: Tables) -> DataFrame:
    """Settings text with items by stat id, slots by slot id and a list of names, parsed back."""
    number = None
    for name, i in SOURCE_ID.items():
        number = F.when(F.col("source") == name, i) if number is None else number.when(F.col("source") == name, i)
    per = t.orders().join(t.entities(), "entity_id").groupBy("team", "season", number.alias("statId")).agg(
        (F.sum("points_c").cast("double") / 4).alias("points"),
        F.count_if(F.col("position") == "BUILDING").alias("b"),
        F.count_if(F.col("position") == "FURNITURE").alias("f"),
    )
    texts = per.groupBy("team", "season").agg(
        F.count(F.lit(1)).cast("int").alias("team_count"),
        F.replace(F.to_json(F.collect_list(F.struct("statId", "points"))), F.lit('"'), F.lit("'")).alias("items"),
        F.to_json(F.create_map(F.lit("2"), F.sum("b"), F.lit("4"), F.sum("f"))).alias("slots"),
        F.to_json(F.collect_list(F.when(F.col("b") > F.col("f"), "RB").otherwise("WR"))).alias("names"),
    )
    parsed = texts.select(
        "team", "season", "team_count", nested.literal_items(F.col("items")).alias("items"),
        F.from_json("slots", "map<string,bigint>").alias("slots"),
        F.from_json("names", "array<string>").alias("names"),
    )
    out = settings_from_ids(
        parsed, "x", "items", "slots",
        {"team": "team", "league_id": "season", "team_count": "team_count", "names": "names"}, _IDS, _SLOT_IDS,
    )
    return out.select(
        F.col("team").alias("league_key"), F.col("league_id").cast("string").alias("league_id"), "team_count",
        *_IDS, *_SLOT_IDS, nested.count_value(F.col("names"), "RB").alias("rb_listed"),
    )


_HREF = """'(?s)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'"""


@query(
    "page_rows",
    f"""WITH m AS (
      SELECT page_id, url, regexp_extract_all(html, {_HREF}, 1) AS hs, regexp_extract_all(html, {_HREF}, 2) AS ls FROM pages),
    r AS (SELECT page_id, url, unnest(hs) AS href, unnest(ls) AS label, generate_subscripts(hs, 1) - 1 AS link_no FROM m),
    p AS (SELECT *, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(label, '<[^>]*>', '', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '^\\s+', ''), '\\s+$', '') AS label2 FROM r)
    SELECT page_id, CAST(link_no AS INT) AS link_no, href, label2 AS label, nullif(regexp_extract(url, '/fr/([0-9]+)', 1), '') AS fr_id FROM p""",
)
def page_rows(t: Tables) -> DataFrame:
    """Every link of every page, with an id out of the page address."""
    pages = t.raw("pages")
    found = page_ops.links(pages.select("page_id", "url", "html"))
    return found.select(
        "page_id", "link_no", "href", "label", text.path_token(F.col("url"), "fr", "[0-9]+").alias("fr_id")
    )


def _cell(value: Column, css: str = "") -> Column:
    mark = f' class="{css}"' if css else ""
    return F.concat(F.lit(f"<td{mark}> "), value, F.lit("</td>"))


def _money(cent_column: str) -> Column:
    return F.format_number(F.col(cent_column) / 100, 2)


def stat_pages(t: Tables) -> DataFrame:
    """Pages of at most 100 customers each, written as two kinds of table."""
    people = t.raw("customer").select(
        "c_custkey", "c_name", cents("c_acctbal").alias("balance_c"), "c_nationkey"
    ).join(t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    key = F.col("c_custkey")
    person = F.concat(
        F.lit('<span class="CellPlayerName--long"><span><a href="/nfl/players/'), key.cast("string"), F.lit('/x/">'),
        F.col("c_name"), F.lit('</a></span><span class="CellPlayerName-team"> '), F.col("n_name"), F.lit(" </span></span>"),
    )
    unit = F.concat(F.lit('<a href="/x"></a><span class="TeamName"><a href="/nfl/teams/LAR/">'), F.col("c_name"), F.lit("</a></span>"))
    number = "TableBase-bodyTd TableBase-bodyTd--number"
    fppg = F.when(key % 13 == 0, F.lit("—")).otherwise((key % 50).cast("string"))
    first = F.concat(
        F.lit('<tr class="TableBase-bodyTr ">'), _cell(F.when(key % 17 == 0, unit).otherwise(person)),
        _cell(F.lit("7"), number), _cell(_money("balance_c"), number), _cell(fppg, number), F.lit("</tr>"),
    )
    second = F.concat(
        F.lit("<tr>"), _cell(F.lit("")), _cell(F.concat(F.lit("<b>"), F.col("c_name"), F.lit(" Jr.</b>"))),
        _cell(F.col("n_name")), _cell(F.when(key % 13 == 0, F.lit("n/a")).otherwise(_money("balance_c"))), F.lit("</tr>"),
    )
    rows = people.select((key - key % 100).alias("page_id"), key.alias("k"), first.alias("a"), second.alias("b"))
    joined = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("k", "a", "b"))).alias("rows"))
    body = [F.array_join(F.col(f"rows.{c}"), "\n") for c in "ab"]
    head = "<tr><td>Chg</td><td>Player</td><td>Team</td><td>FPts</td></tr>"
    return joined.select(
        "page_id",
        F.concat(F.lit("<html><table><tbody>"), body[0], F.lit("</tbody></table></html>")).alias("marked"),
        F.concat(
            F.lit("<html><table><tr><td>FPts</td></tr><tr><td><table>" + head), body[1],
            F.lit("</table></td></tr></table></html>"),
        ).alias("layered"),
    )


@query(
    "page_marked_table",
    """SELECT c_custkey - c_custkey % 100 AS page_id, CAST(c_custkey % 100 AS INT) AS row_no,
      CASE WHEN c_custkey % 17 <> 0 THEN c_custkey END AS entity_id, c_name AS name,
      CASE WHEN c_custkey % 17 = 0 THEN 'LA' ELSE n_name END AS team, round(c_acctbal, 2) AS points, CAST(c_custkey % 50 AS DOUBLE) AS fppg
    FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 13 <> 0""",
)
def page_marked_table(t: Tables) -> DataFrame:
    """Class-marked rows: ids from links, teams from spans or links, bad numbers skipped."""
    return page_ops.marked_rows(stat_pages(t).select("page_id", F.col("marked").alias("html")))


@query(
    "page_header_table",
    """SELECT c_custkey - c_custkey % 100 AS page_id, CAST(c_custkey % 100 AS INT) AS row_no,
      lower(c_name) AS merge_name, c_name || ' Jr.' AS name, n_name AS team, round(c_acctbal, 2) AS points
    FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 13 <> 0""",
)
def page_header_table(t: Tables) -> DataFrame:
    """Rows below the header that ends in FPts, in the innermost table."""
    return page_ops.header_rows(stat_pages(t).select("page_id", F.col("layered").alias("html")))


@query(
    "page_embedded_json",
    """SELECT c_custkey - c_custkey % 100 AS page_id, c_custkey AS id, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS balance_c FROM customer""",
)
def page_embedded_json(t: Tables) -> DataFrame:
    """Records out of a script variable in a page."""
    people = t.raw("customer").select(
        (F.col("c_custkey") - F.col("c_custkey") % 100).alias("page_id"),
        F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), cents("c_acctbal").alias("balance_c")).alias("r"),
    )
    blobs = people.groupBy("page_id").agg(F.to_json(F.struct(F.collect_list("r").alias("players"))).alias("blob"))
    pages = blobs.select(
        "page_id",
        F.concat(F.lit("<script>\nvar other = {};\nvar ecrData = "), "blob", F.lit(";\nvar x = {};</script>")).alias("html"),
    )
    return readers.embedded_records(pages, "html", "ecrData", "struct<id:bigint,name:string,balance_c:bigint>")


@query(
    "page_metadata",
    f"""WITH {O}, {ENT}
    SELECT entity_name AS name, position, CAST(sum(points_c) AS BIGINT) AS adp, CASE source WHEN '1-URGENT' THEN 'standard' ELSE 'half-ppr' END AS scoring_format, season
    FROM o JOIN ent USING (entity_id) WHERE source IN ('1-URGENT', '2-HIGH') GROUP BY ALL""",
)
def page_metadata(t: Tables) -> DataFrame:
    """JSON archives whose tag and season are in the path, written and read back."""
    root = shared_path(t, "feeds")
    rows = t.orders().where(F.col("source").isin("1-URGENT", "2-HIGH")).groupBy("entity_id", "season", "source").agg(
        F.sum("points_c").alias("adp")
    ).join(t.entities(), "entity_id")
    tag = F.when(F.col("source") == "1-URGENT", "standard").otherwise("half-ppr")
    # many small documents keep the archive splittable
    feed = F.concat(F.lit("adp_"), tag, F.lit("_"), "season").alias("feed")
    out = rows.groupBy(feed, (F.col("entity_id") / 2000).cast("long").alias("part")).agg(
        F.collect_list(F.struct(F.col("entity_name").alias("name"), "position", "adp")).alias("players")
    ).drop("part")
    out.write.partitionBy("feed").option("maxRecordsPerFile", 1).json(root)
    # an error reply and a file that breaks off stand among them
    for name, document in (("adp_ppr_1990", '{"status": "Error"}'), ("adp_ppr_1991", '{"players": [{"name": "x"')):
        t.spark.range(1).select(F.lit(document)).write.text(f"{root}/feed={name}")
    return readers.tagged_json(t.spark, f"{root}/*", "adp", "struct<name:string,position:string,adp:bigint>")


@query(
    "file_json",
    """SELECT c_custkey AS id, c_name AS name, n_name AS "home.team", n_regionkey AS "home.region.key",
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(round(c_acctbal * 100) AS BIGINT) END AS balance_c
       FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def file_json(t: Tables) -> DataFrame:
    """Archives of many-line JSON arrays, one of them broken, read back and flattened."""
    root = shared_path(t, "records")
    nation = t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    region = F.struct(F.col("n_regionkey").alias("key"))
    record = F.struct(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.struct(F.col("n_name").alias("team"), region.alias("region")).alias("home"),
        F.when(F.col("c_custkey") % 7 != 0, cents("c_acctbal")).alias("balance_c"),
    )
    people = t.raw("customer").join(nation, "c_nationkey").select((F.col("c_custkey") / 200).cast("long").alias("k"), record.alias("r"))
    documents = people.groupBy("k").agg(F.to_json(F.collect_list("r"), {"pretty": "true"}).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/whole")
    t.spark.range(1).select(F.lit('[{"id": 1, "name": "cut o')).write.text(f"{root}/broken")
    kind = "id long, name string, home struct<team:string,region:struct<key:int>>, balance_c long"
    return readers.records_json(t.spark, f"{root}/*", kind)


@query(
    "file_csv",
    f"""WITH {O}, {ENT}, s AS (SELECT entity_id, season, CAST(sum(points_c) AS BIGINT) AS points_c, count(*) AS games FROM o GROUP BY ALL)
    SELECT season, entity_id AS rank, entity_name AS name, upper(substr(team, 1, 3)) AS team, games AS bye, upper(position) AS position,
      CASE WHEN entity_id % 5 <> 0 THEN games END AS position_rank, CASE WHEN season % 2 = 0 THEN CAST(points_c AS DOUBLE) END AS adp
    FROM s JOIN ent USING (entity_id)""",
)
def file_csv(t: Tables) -> DataFrame:
    """Season files with two orders of columns, some without one, and broken rows among them."""
    root = shared_path(t, "rankings")
    packed = F.concat("entity_name", F.lit("  "), F.upper(F.substring("team", 1, 3)), F.lit(" ("), F.col("games").cast("string"), F.lit(")"))
    rank = F.when(F.col("entity_id") % 5 != 0, F.col("games").cast("string")).otherwise("")
    rows = t.season_totals().select(
        F.concat(F.lit("Ranks_"), F.col("season").cast("string"), F.lit("_Overall.csv")).alias("file"), F.col("season") % 2 == 0,
        F.col("entity_id").alias("Rank"), packed.alias("Player (Bye)"), F.concat(F.upper("position"), rank).alias("POS"),
        F.col("points_c").alias("AVG"),
    ).toDF("file", "even", "Rank", "Player (Bye)", "POS", "AVG")
    writer = {True: ["Rank", "Player (Bye)", "POS", "AVG"], False: ["POS", "Rank", "Player (Bye)"]}
    for even, columns in writer.items():
        part = rows.where(F.col("even") == even).select("file", *columns)
        part.write.mode("append").partitionBy("file").option("header", "true").csv(root)
    broken = F.explode(F.array(*map(F.lit, ("Rank,Player (Bye),POS,AVG", "1,too few", "2,a,b,3,too many"))))
    t.spark.range(1).select(broken).coalesce(1).write.text(f"{root}/file=Ranks_1900_Overall.csv")
    rows.limit(0).select("Rank").write.csv(f"{root}/file=Ranks_other.csv")
    return readers.season_csv(t.spark, f"{root}/file=Ranks_*", r"Ranks_(\d{4})_Overall\.csv")


@query(
    "page_batch",
    """SELECT c_custkey - c_custkey % 100 AS page_id, CAST(c_custkey % 100 AS INT) AS row_no,
      CASE WHEN c_custkey % 17 <> 0 THEN c_custkey END AS entity_id, c_name AS name,
      CASE WHEN c_custkey % 17 = 0 THEN 'LA' ELSE n_name END AS team, round(c_acctbal, 2) AS points, CAST(c_custkey % 50 AS DOUBLE) AS fppg,
      CASE WHEN c_custkey // 100 % 2 = 0 THEN 'QB' ELSE 'RB' END AS position, 'ppr' AS scoring, CAST(1990 + c_custkey // 100 % 9 AS BIGINT) AS season
    FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 13 <> 0""",
)
def page_batch(t: Tables) -> DataFrame:
    """A batch of stored pages, each parsed row stamped with what its page was fetched for."""
    root = shared_path(t, "pages")
    number = F.col("page_id") / 100
    pages = stat_pages(t).select(
        "page_id", F.col("marked").alias("html"), F.when(number.cast("long") % 2 == 0, "QB").otherwise("RB").alias("position"),
        F.lit("ppr").alias("scoring"), (number.cast("long") % 9 + 1990).alias("season"),
    )
    pages.write.parquet(root)
    stored = t.spark.read.parquet(root)
    rows = page_ops.marked_rows(stored.select("page_id", "html"))
    return page_ops.with_metadata(stored.drop("html"), rows, "page_id")


_LISTED = {"AUTOMOBILE": "QB", "BUILDING": "RB", "FURNITURE": "WR", "HOUSEHOLD": "FLEX", "MACHINERY": "BN"}


@query(
    "settings_listed",
    """SELECT 'first' AS league_key, 'first' AS platform, CAST(c_custkey // 50 AS BIGINT) AS league_id, count(*) AS team_count, 0.5::DOUBLE AS rec_pts,
      0.0::DOUBLE AS punt_pts, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS qb_slots, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS rb_slots,
      count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS wr_slots, 0::BIGINT AS te_slots, count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS flex_slots,
      count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS bench_slots
    FROM customer GROUP BY c_custkey // 50""",
)
def settings_listed(t: Tables) -> DataFrame:
    """Settings with the roster as a list of names, one league per fifty customers."""
    name = None
    for segment, slot in _LISTED.items():
        hit = F.col("c_mktsegment") == segment
        name = F.when(hit, slot) if name is None else name.when(hit, slot)
    leagues = t.raw("customer").groupBy((F.col("c_custkey") / 50).cast("long").alias("league_id")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(name).alias("roster_positions"), F.lit(0.5).alias("rec")
    )
    out = settings_from_lists(leagues, "first", {"rec_pts": "rec"}, {"league_id": "league_id", "team_count": "n"})
    slots = [F.col(c).cast("long").alias(c) for c in ("qb_slots", "rb_slots", "wr_slots", "te_slots", "flex_slots", "bench_slots")]
    return out.select("league_key", "platform", "league_id", "team_count", "rec_pts", "punt_pts", *slots)


@query(
    "table_replace",
    f"""WITH {O}, s AS (SELECT season, count(*) AS n, CAST(sum(points_c) AS BIGINT) AS points_c FROM o GROUP BY ALL),
    k AS (SELECT count(*) AS written FROM o), old AS (SELECT count(*) AS written FROM o WHERE season < 1996)
    SELECT 'first' AS step, season, n, points_c, written FROM s, old WHERE season < 1996
    UNION ALL SELECT 'interrupted', season, n, points_c, NULL FROM s WHERE season < 1996
    UNION ALL SELECT 'second', season, n, points_c, written FROM s, k""",
)
def table_replace(t: Tables) -> DataFrame:
    """A table replaced twice, the second time after a write that breaks off: old rows, then new."""
    name = "orders_" + uuid.uuid4().hex
    orders = t.orders()

    def state(step: str, written: int | None) -> DataFrame:
        rows = t.spark.table(name).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("points_c").alias("points_c"))
        return pinned(rows.select(F.lit(step).alias("step"), "season", "n", "points_c", F.lit(written).cast("long").alias("written")))

    first = state("first", catalog.replace_table(t.spark, name, orders.where(F.col("season") < 1996)))
    stop = F.when(F.col("season") == F.lit(1997), F.raise_error(F.lit("broken off")).cast("long")).otherwise(F.col("points_c"))
    try:
        catalog.replace_table(t.spark, name, orders.withColumn("points_c", stop))
    except SparkRuntimeException:
        pass
    held = state("interrupted", None)
    second = state("second", catalog.replace_table(t.spark, name, orders))
    catalog.replace_table(t.spark, name, t.spark.range(0).select())
    return first.unionByName(held).unionByName(second)


_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


@query(
    "catalog_columns",
    f"""SELECT column_name, CASE {' '.join(f"WHEN data_type LIKE '{k}%' THEN '{v}'" for k, v in _KINDS.items())} ELSE data_type END AS data_type,
      (SELECT count(*) FROM orders) AS rows
    FROM information_schema.columns WHERE table_name = 'orders'""",
)
def catalog_columns(t: Tables) -> DataFrame:
    """Declared columns of a table beside its exact row count."""
    view = "columns_" + uuid.uuid4().hex
    t.raw("orders").createOrReplaceTempView(view)
    found = catalog.columns(t.spark, view)
    rows = catalog.tables(t.spark).where(F.col("table") == view).select("rows")
    out = found.withColumn("rows", rows.scalar())
    t.spark.catalog.dropTempView(view)
    return out


@query("catalog_peek", "SELECT * FROM region")
def catalog_peek(t: Tables) -> DataFrame:
    """The first rows of a table that has no more than asked for."""
    view = "peek_" + uuid.uuid4().hex
    t.raw("region").createOrReplaceTempView(view)
    out = catalog.peek(t.spark, view, 5)
    t.spark.catalog.dropTempView(view)
    return out


@query(
    "sink_roundtrip",
    f"""WITH {O} SELECT season, source, count(*) AS n, CAST(sum(points_c) AS BIGINT) AS points_c FROM o WHERE season >= 1997 GROUP BY ALL""",
)
def sink_roundtrip(t: Tables) -> DataFrame:
    """Write, overwrite, archive as JSON, read back and query with a parameter."""
    path = shared_path(t, "sink")
    sums = t.orders().groupBy("season", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("points_c").alias("points_c"))
    catalog.archive(sums.where(F.col("season") < 0), path)
    catalog.archive(sums, path)
    stored = t.spark.read.parquet(path)
    catalog.archive(stored, f"{path}-json", "json")
    view = "sink_" + uuid.uuid4().hex
    t.spark.read.schema(stored.schema).json(f"{path}-json").createOrReplaceTempView(view)
    out = catalog.q(t.spark, f"SELECT * FROM {view} WHERE season >= ?", [1997])
    t.spark.catalog.dropTempView(view)
    return out


_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(
    "catalog_summary",
    "SELECT CASE WHEN t IN ('lineitem', 'events', 'orders') THEN 'silver' ELSE 'gold' END AS layer, count(*) AS tables, CAST(sum(n) AS BIGINT) AS rows FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS t, count(*) AS n FROM {n}" for n in _NAMES)
    + ") GROUP BY 1",
)
def catalog_summary(t: Tables) -> DataFrame:
    """Exact rows per layer over registered views."""
    mark = uuid.uuid4().hex[:8]
    prefix = {"lineitem": "silver", "events": "silver", "orders": "silver"}
    for name in _NAMES:
        t.raw(name).createOrReplaceTempView(f"{prefix.get(name, 'gold')}_{mark}_{name}")
    listing = catalog.tables(t.spark, prefixes=(f"silver_{mark}",))
    mine = listing.where(F.col("table").contains(mark))
    for name in _NAMES:
        t.spark.catalog.dropTempView(f"{prefix.get(name, 'gold')}_{mark}_{name}")
    return catalog.summarize(mine, brief=True)
