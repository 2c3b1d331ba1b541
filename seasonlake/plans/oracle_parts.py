"""Common table expressions shared by the DuckDB texts."""

O = """o AS (
  SELECT o_orderkey AS order_id, o_custkey AS entity_id,
         CAST(year(o_orderdate) AS BIGINT) AS season, CAST(month(o_orderdate) AS BIGINT) AS week,
         CAST(o_orderdate AS DATE) AS day, o_orderpriority AS source, o_orderstatus AS status,
         CAST(round(o_totalprice * 100) AS BIGINT) AS points_c
  FROM orders)"""
ENT = """ent AS (
  SELECT c_custkey AS entity_id, c_name AS entity_name, c_mktsegment AS position, n_name AS team
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
TOT = """tot AS (
  SELECT entity_id, season, count(*) AS games, CAST(sum(points_c) AS BIGINT) AS points_c
  FROM o GROUP BY entity_id, season)"""
ST = "st AS (SELECT * FROM tot JOIN ent USING (entity_id))"
L = """l AS (
  SELECT l_orderkey AS order_id, l_partkey AS part_id, l_suppkey AS supplier_id,
         CAST(l_quantity AS BIGINT) AS units, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_c,
         CAST(round(l_discount * 100) AS BIGINT) AS discount_pct,
         l_returnflag AS return_flag, l_linestatus AS line_status,
         CAST(l_shipdate AS DATE) AS ship_day,
         CAST(year(l_shipdate) AS BIGINT) AS season, CAST(month(l_shipdate) AS BIGINT) AS week
  FROM lineitem)"""
BASE = f"WITH {O}, {ENT}, {TOT}, {ST}"
