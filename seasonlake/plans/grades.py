"""Graded team and unit tables."""

from pyspark.sql import DataFrame, functions as F

from seasonlake.operators.grades import group_rate, paired_grades, percentile_grade, primary_team
from seasonlake.plans.bindings import Tables
from seasonlake.plans.oracle_parts import ENT, L, O
from seasonlake.plans.registry import query
from seasonlake.session import pinned


def order_teams(t: Tables) -> DataFrame:
    """order_id -> buyer's team; joined once, on the smaller fact."""
    return t.orders().select("order_id", "entity_id").join(
        t.entities().select("entity_id", "team"), "entity_id"
    ).select("order_id", "team")


def team_grade_frame(t: Tables) -> DataFrame:
    lines = t.lines().select("order_id", "season", "units", "price_c", "discount_pct", "return_flag")
    lines = lines.join(order_teams(t), "order_id")
    # decimal: at full scale one group's net revenue may pass the range of a long
    net = (F.col("price_c") * (100 - F.col("discount_pct"))).cast("decimal(18,0)")
    sums = lines.groupBy("season", "team").agg(
        F.sum(F.when(F.col("return_flag") == "R", F.col("units"))).alias("returned"),
        F.sum("units").alias("units"),
        F.sum(net).alias("net"),
    )
    sums = pinned(sums)  # one row per team and season, read by both sides
    back = sums.where(~F.col("team").isin("NATION_3", "NATION_4") & (F.col("units") > 0)).select(
        "season", "team",
        F.round(F.col("returned") / F.col("units"), 10).alias("return_share"),
    )
    paid = sums.where(~F.col("team").isin("NATION_7") & (F.col("units") > 0)).select(
        "season", "team",
        F.round(F.col("net").cast("double") / 10000 / F.col("units"), 6).alias("revenue_per_unit"),
    )
    out = paired_grades(
        back, paid, ("season", "team"), ("season",), "return_share", "revenue_per_unit",
        "return_grade", "revenue_grade", "team_grade",
    )
    return out.select(
        "season", "team", "return_share", "revenue_per_unit",
        *[F.round(c, 6).alias(c) for c in ("return_grade", "revenue_grade", "team_grade")],
    )


@query(
    "team_grade",
    f"""WITH {O}, {ENT}, {L},
    lt AS (SELECT l.*, ent.team FROM l JOIN o USING (order_id) JOIN ent USING (entity_id)),
    back AS (
      SELECT season, team,
             round(sum(CASE WHEN return_flag = 'R' THEN units END) * 1.0 / sum(units), 10) AS return_share
      FROM lt WHERE team NOT IN ('NATION_3', 'NATION_4') GROUP BY season, team HAVING sum(units) > 0),
    paid AS (
      SELECT season, team,
             round(CAST(sum(price_c * (100 - discount_pct)) AS DOUBLE) / 10000 / sum(units), 6) AS revenue_per_unit
      FROM lt WHERE team NOT IN ('NATION_7') GROUP BY season, team HAVING sum(units) > 0),
    c AS (
      SELECT COALESCE(b.season, p.season) AS season, COALESCE(b.team, p.team) AS team,
             return_share, revenue_per_unit
      FROM back b FULL OUTER JOIN paid p ON b.season = p.season AND b.team = p.team),
    g AS (
      SELECT *, 100 * (1 - percent_rank() OVER (PARTITION BY season ORDER BY return_share NULLS LAST)) AS rg,
             100 * percent_rank() OVER (PARTITION BY season ORDER BY revenue_per_unit NULLS LAST) AS vg
      FROM c)
    SELECT season, team, return_share, revenue_per_unit, round(rg, 6) AS return_grade,
           round(vg, 6) AS revenue_grade, round((rg + vg) / 2, 6) AS team_grade
    FROM g ORDER BY season, team_grade DESC""",
)
def team_grade(t: Tables) -> DataFrame:
    return team_grade_frame(t).orderBy("season", F.col("team_grade").desc())


@query(
    "primary_team",
    f"""WITH {O}, {L},
    sup AS (SELECT s_suppkey AS supplier_id, n_name AS team FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    u AS (SELECT entity_id, o.season, team, count(*) AS n, max(o.week) AS last_week
          FROM l JOIN o USING (order_id) JOIN sup USING (supplier_id) GROUP BY entity_id, o.season, team)
    SELECT entity_id, season, team FROM u
    QUALIFY row_number() OVER (PARTITION BY entity_id, season ORDER BY n DESC, last_week DESC, team) = 1""",
)
def primary_team_query(t: Tables) -> DataFrame:
    """Supplier nation a buyer used most in a season."""
    return primary_team(supplier_uses(t), ("entity_id", "season"), "team", "week")


def supplier_uses(t: Tables) -> DataFrame:
    supplier = t.raw("supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("n_nationkey")
    )
    nation = t.raw("nation").select("n_nationkey", F.col("n_name").alias("team"))
    lines = t.lines().select("order_id", "supplier_id")
    orders = t.orders().select("order_id", "entity_id", "season", "week")
    return lines.join(orders, "order_id").join(
        supplier.join(nation, "n_nationkey"), "supplier_id"
    ).select("entity_id", "season", "week", "team")


@query(
    "unit_grade_union",
    f"""WITH {O}, {ENT}, {L},
    p AS (SELECT p_partkey AS part_id, p_type AS position FROM part),
    lt AS (SELECT l.season, ent.team, p.position, units, price_c, discount_pct
           FROM l JOIN o USING (order_id) JOIN ent USING (entity_id) JOIN p USING (part_id)),
    a AS (SELECT season, team, position,
                 round(sum(discount_pct * units) * 1.0 / sum(units), 8) AS discount_rate
          FROM lt WHERE position IN ('ECONOMY', 'STANDARD') GROUP BY ALL),
    b AS (SELECT season, team, round(sum(price_c) * 1.0 / sum(units), 6) AS unit_price
          FROM lt WHERE position = 'PROMO' GROUP BY ALL)
    SELECT season, team, position, discount_rate, CAST(NULL AS DOUBLE) AS unit_price,
           round(100 * percent_rank() OVER (PARTITION BY season, position ORDER BY discount_rate), 6) AS grade FROM a
    UNION ALL
    SELECT season, team, 'PROMO', NULL, unit_price,
           round(100 * percent_rank() OVER (PARTITION BY season ORDER BY unit_price), 6) FROM b""",
)
def unit_grade_union(t: Tables) -> DataFrame:
    """Two grade families with typed NULLs where a column does not apply."""
    part = t.raw("part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("position"))
    lines = (
        t.lines()
        .select("order_id", "part_id", "season", "units", "price_c", "discount_pct")
        .join(part.where(F.col("position").isin("ECONOMY", "STANDARD", "PROMO")), "part_id")
        .join(order_teams(t), "order_id")
    )
    keys = ["season", "team", "position"]
    sums = lines.groupBy(*keys).agg(
        F.sum("units").alias("units"), F.sum("price_c").alias("price_c"),
        F.sum(F.col("discount_pct") * F.col("units")).alias("discounted"),
    )
    sums = pinned(sums)  # a few hundred rows for both families
    a = group_rate(
        sums.where(F.col("position").isin("ECONOMY", "STANDARD")), keys,
        F.col("discounted"), F.col("units"), "discount_rate",
    ).withColumn("discount_rate", F.round("discount_rate", 8))
    b = group_rate(
        sums.where(F.col("position") == "PROMO"), ("season", "team"),
        F.col("price_c"), F.col("units"), "unit_price",
    ).withColumn("unit_price", F.round("unit_price", 6))
    a = percentile_grade(a, ("season", "position"), "discount_rate", "grade", bounded=True)
    b = percentile_grade(b, ("season",), "unit_price", "grade", bounded=True)
    none = F.lit(None).cast("double")
    columns = ("season", "team", "position", "discount_rate", "unit_price", "grade")
    a = a.withColumn("unit_price", none).select(*columns)
    b = b.withColumn("discount_rate", none).withColumn("position", F.lit("PROMO")).select(*columns)
    return a.unionByName(b).withColumn("grade", F.round("grade", 6))
