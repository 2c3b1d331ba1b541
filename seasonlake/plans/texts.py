"""Text keys and parsers over names, codes, packed strings and links."""

from pyspark.sql import DataFrame, functions as F

from seasonlake.functions import fixed_values as fixed, text
from seasonlake.plans.bindings import Tables
from seasonlake.plans.oracle_parts import O
from seasonlake.plans.registry import query

KEY_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[.''’]', '', 'g'),
  '\s+(jr|sr|ii|iii|iv|v)\.?$', ''), '\s+', ' ', 'g'))"""


@query(
    "name_key",
    f"""WITH v AS (
      SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name || ' Jr.' WHEN 1 THEN 'D''' || c_name || '  III'
        WHEN 2 THEN upper(c_name) || ' sr' WHEN 3 THEN 'St. ' || c_name || '   V' WHEN 4 THEN 'O’' || c_name ELSE c_name END AS raw_name
      FROM customer)
    SELECT c_custkey, raw_name, {KEY_SQL.format("raw_name")} AS merge_name FROM v""",
)
def name_key(t: Tables) -> DataFrame:
    """Names with suffixes, apostrophes and spacing reduced to one key."""
    c, k = F.col("c_name"), F.col("c_custkey") % 6
    raw = (
        F.when(k == 0, F.concat(c, F.lit(" Jr.")))
        .when(k == 1, F.concat(F.lit("D'"), c, F.lit("  III")))
        .when(k == 2, F.concat(F.upper(c), F.lit(" sr")))
        .when(k == 3, F.concat(F.lit("St. "), c, F.lit("   V")))
        .when(k == 4, F.concat(F.lit("O’"), c))
        .otherwise(c)
    )
    df = t.raw("customer").select("c_custkey", raw.alias("raw_name"))
    return df.withColumn("merge_name", text.name_key(F.col("raw_name")))


_VARIANTS = ("LAR", "Texans D/ST", "  Green Bay Packers", "oak", "kc", "Jaguars", "jac ", "Seahawks")
_LIST = ", ".join(f"'{v}'" for v in _VARIANTS)
_ALIAS = ", ".join(f"('{k}', '{v}')" for k, v in fixed.TEAM_ALIASES.items())
_CODES = ", ".join(f"('{k}', '{v}')" for k, v in fixed.TEAM_CODES.items())


@query(
    "code_canonical",
    f"""WITH a(k, v) AS (VALUES {_ALIAS}), n(k, v) AS (VALUES {_CODES}),
    x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 8 THEN n_name ELSE list_extract([{_LIST}], CAST(s_suppkey % 9 AS INT) + 1) END AS raw_team
          FROM supplier JOIN nation ON n_nationkey = s_nationkey)
    SELECT s_suppkey, raw_team, COALESCE(a.v, c.v, n.v, upper(trim(raw_team))) AS team
    FROM x LEFT JOIN a ON a.k = upper(trim(raw_team)) LEFT JOIN (SELECT DISTINCT v FROM n) c ON c.v = upper(trim(raw_team))
    LEFT JOIN n ON n.k = list_extract(regexp_split_to_array(trim(replace(trim(raw_team), 'D/ST', '')), '\\s+'), -1)""",
)
def code_canonical(t: Tables) -> DataFrame:
    """Aliases, nicknames, full names and old codes to one team code."""
    nation = t.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    options = F.array(*[F.lit(v) for v in _VARIANTS])
    pick = (F.col("s_suppkey") % 9).cast("int")
    raw = F.when(pick == 8, F.col("n_name")).otherwise(F.try_element_at(options, pick + 1))
    df = t.raw("supplier").join(nation, "s_nationkey").select("s_suppkey", raw.alias("raw_team"))
    return df.withColumn("team", text.canonical_code(F.col("raw_team")))


_PACK = r"'^(.+?)(?:\s{2,}(?:([A-Z]{2,3})\s)?\((\d+)\))?$'"


@query(
    "packed_split",
    f"""WITH x AS (
      SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN '  GB (' || p_size || ')' WHEN 1 THEN '   (' || p_size || ')' ELSE '' END AS packed,
             CASE p_partkey % 4 WHEN 0 THEN 'OL' ELSE 'RB' || p_size END AS pos FROM part)
    SELECT p_partkey, packed, nullif(regexp_extract(packed, {_PACK}, 1), '') AS name, nullif(regexp_extract(packed, {_PACK}, 2), '') AS team,
      TRY_CAST(nullif(regexp_extract(packed, {_PACK}, 3), '') AS BIGINT) AS bye,
      nullif(regexp_extract(pos, '^([A-Z]+?)(\\d+)?$', 1), '') AS position,
      TRY_CAST(nullif(regexp_extract(pos, '^([A-Z]+?)(\\d+)?$', 2), '') AS BIGINT) AS position_rank FROM x""",
)
def packed_split(t: Tables) -> DataFrame:
    """``Name  TEAM (bye)`` and ``RB12`` taken apart."""
    tail = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  GB ("), "p_size", F.lit(")")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("   ("), "p_size", F.lit(")")))
        .otherwise(F.lit(""))
    )
    pos = F.when(F.col("p_partkey") % 4 == 0, "OL").otherwise(F.concat(F.lit("RB"), "p_size"))
    df = t.raw("part").select("p_partkey", F.concat("p_name", tail).alias("packed"), pos.alias("pos"))
    df = df.withColumn("a", text.packed_name(F.col("packed"))).withColumn("b", text.letters_rank(F.col("pos")))
    return df.select("p_partkey", "packed", "a.*", "b.*")


@query(
    "text_suite",
    f"""WITH {O}, x AS (
      SELECT order_id, entity_id, season, points_c,
        CASE order_id % 4 WHEN 0 THEN '1,' || lpad(CAST(points_c % 1000 AS VARCHAR), 3, '0') || '.5' WHEN 1 THEN CAST(points_c AS VARCHAR)
             WHEN 2 THEN '--' ELSE ' 12 ' END AS number_text,
        'adp_half-' || lower(substr(source, 3)) || '_' || season || '.json' AS file_name,
        CASE WHEN order_id % 5 = 0 THEN '2RB3WR' WHEN order_id % 5 = 1 THEN '1QB4RB' ELSE '5WR' END AS plan,
        CASE WHEN entity_id % 7 = 0 THEN 'unknown' ELSE CAST(1960 + entity_id % 20 AS VARCHAR) || '-02-03' END AS birth_date,
        strftime(day, '%Y-%m-%dT00:00:00Z') AS stamp, order_id % 3 = 0 AS flag
      FROM o)
    SELECT order_id, TRY_CAST(replace(trim(number_text), ',', '') AS DOUBLE) AS number,
      regexp_extract(file_name, '^adp_(.*)_(\\d+)\\.[^.]*$', 1) AS tag, TRY_CAST(regexp_extract(file_name, '^adp_(.*)_(\\d+)\\.[^.]*$', 2) AS BIGINT) AS file_season,
      COALESCE(TRY_CAST(regexp_extract(plan, '(\\d)RB', 1) AS BIGINT), 0) AS n_rb, contains(plan, '4RB') AS heavy, starts_with(plan, '2') AS opens_two,
      len(regexp_extract_all(plan, 'R')) AS r_letters,
      season - year(TRY_CAST(birth_date AS DATE)) AS age,
      CAST(substr(stamp, 1, 4) AS BIGINT) - CASE WHEN CAST(substr(stamp, 6, 2) AS BIGINT) < 7 THEN 1 ELSE 0 END AS snapshot_season,
      CAST(floor(points_c / 4000000.0) AS BIGINT) + 1 AS round, round(points_c / 300.0, 2) AS rounded, CAST(flag AS INT) AS flag,
      abs(25000000 - points_c) AS distance, round(sqrt(points_c), 6) AS root, CAST(points_c AS DOUBLE) * points_c AS squared,
      CAST(season AS VARCHAR) || '/' || CAST(entity_id AS VARCHAR) AS label
    FROM x""",
)
def text_suite(t: Tables) -> DataFrame:
    """Numbers with commas, file tags, label counts, ages, rounds and roots."""
    o = t.orders()
    m4, m5 = F.col("order_id") % 4, F.col("order_id") % 5
    number = (
        F.when(m4 == 0, F.concat(F.lit("1,"), F.lpad((F.col("points_c") % 1000).cast("string"), 3, "0"), F.lit(".5")))
        .when(m4 == 1, F.col("points_c").cast("string")).when(m4 == 2, "--").otherwise(" 12 ")
    )
    file_name = F.concat(F.lit("adp_half-"), F.lower(F.substring("source", 3, 100)), F.lit("_"), "season", F.lit(".json"))
    plan = F.when(m5 == 0, "2RB3WR").when(m5 == 1, "1QB4RB").otherwise("5WR")
    born = F.when(F.col("entity_id") % 7 == 0, "unknown").otherwise(
        F.concat((1960 + F.col("entity_id") % 20).cast("string"), F.lit("-02-03"))
    )
    stamp = F.concat(F.col("day").cast("string"), F.lit("T00:00:00Z"))
    df = o.select(
        "order_id", "entity_id", "season", "points_c", number.alias("n"), file_name.alias("f"),
        plan.alias("plan"), born.alias("born"), stamp.alias("stamp"), (F.col("order_id") % 3 == 0).alias("flag"),
    ).withColumn("tagged", text.tagged_stem(F.col("f"), "adp"))
    points = F.col("points_c")
    return df.select(
        "order_id",
        text.parse_number(F.col("n")).alias("number"),
        F.col("tagged.tag").alias("tag"), F.col("tagged.season").alias("file_season"),
        text.label_count(F.col("plan"), "RB").alias("n_rb"),
        F.contains("plan", F.lit("4RB")).alias("heavy"), F.startswith("plan", F.lit("2")).alias("opens_two"),
        F.regexp_count("plan", F.lit("R")).cast("long").alias("r_letters"),
        (F.col("season") - text.year_of(F.col("born"))).alias("age"),
        text.snapshot_season(F.col("stamp")).alias("snapshot_season"),
        (F.floor(points / 4000000.0) + 1).cast("long").alias("round"),
        F.round(points / 300.0, 2).alias("rounded"),
        F.col("flag").cast("int").alias("flag"), F.abs(25000000 - points).alias("distance"),
        F.round(F.sqrt(points), 6).alias("root"), F.pow(points, F.lit(2)).alias("squared"),
        F.concat(F.col("season").cast("string"), F.lit("/"), F.col("entity_id").cast("string")).alias("label"),
    )
