"""Queries on sources, sinks, gridded fields and joins in space and time. Given tables are written in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import geo
from tidemark.functions.values import cache_key
from tidemark.operators import audit as A
from tidemark.operators import evidence as E
from tidemark.operators import farms as M
from tidemark.operators import matrix as X
from tidemark.operators import models as U
from tidemark.operators import pings as P
from tidemark.operators import spacetime as W
from tidemark.plans import queries_events as QE
from tidemark.plans import roles as R
from tidemark.plans.lineage import cut, scratch
from tidemark.plans.register import query, rounded
from tidemark.sources import files as S
from tidemark.sources import gridded as G


@query(f"WITH {R.PINGS} SELECT mmsi, count(*) AS pings, min(ts) AS first, max(ts) AS last, round(sum(lat), 4) AS lat, round(sum(lon), 4) AS lon, round(avg(sog), 6) AS sog, count(*) FILTER (mmsi % 3 <> 1) AS named FROM pings GROUP BY mmsi")
def ping_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-01, FLT-01: vessels in three layouts (header, other header with decimal commas, none), found by first lines."""
    p = R.pings(spark, sf)
    root = scratch(spark)
    kind, text = F.col("mmsi") % 3, lambda c: F.format_string("%.12f", c)
    day = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    one = p.filter(kind == 0).select(day.alias("# Timestamp"), F.col("mmsi").alias("MMSI"), text("lat").alias("Latitude"), text("lon").alias("Longitude"), text("sog").alias("SOG"), F.col("name").alias("Name"))
    one.write.option("header", True).csv(f"{root}/a")
    comma = lambda c: F.replace(text(c), F.lit("."), F.lit(","))
    two = p.filter(kind == 1).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("mmsi").alias("mmsi"), comma("lat").alias("lat"), comma("lon").alias("lon"), comma("sog").alias("speed over ground"))
    two.write.option("header", True).option("sep", ";").csv(f"{root}/b")
    own = {"Timestamp": day, "MMSI": F.col("mmsi"), "Latitude": text("lat"), "Longitude": text("lon"), "SOG": text("sog"), "Name": F.col("name")}
    p.filter(kind == 2).select(*(own.get(c, F.lit("")).cast("string").alias(c) for c in S.LEGACY_COLUMNS)).write.option("header", False).csv(f"{root}/c")
    got = P.typed(S.read_drifting(spark, f"{root}/*"))
    out = got.groupBy("mmsi").agg(F.count(F.lit(1)).alias("pings"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.avg("sog").alias("sog"), F.count("name").alias("named"))
    return rounded(out, lat=4, lon=4, sog=6)


@query("SELECT o_orderstatus, count(*) AS rows, round(sum(o_totalprice), 1) AS price, 0::BIGINT AS notes FROM orders GROUP BY o_orderstatus")
def conformed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-05, SNK-01, FLT-09: a table written and read again in a schema that lacks some of its columns and has one more."""
    path = scratch(spark)
    S.write(R.table(spark, sf, "orders"), path)
    schema = T.StructType([T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("note", T.StringType())])
    return rounded(S.read_columns(spark, path, schema).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("price"), F.count("note").alias("notes")), price=1)


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def catalog_views(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-04: views by name over two tables, one optional source that is absent, and SQL over them."""
    made = S.register(spark, {"td_customer": {"path": f"{sf}/customer.parquet"}, "td_nation": {"path": f"{sf}/nation.parquet"}, "td_absent": {"path": f"{sf}/absent.parquet", "required": False}})
    if made != ["td_customer", "td_nation"] or not set(made) <= set(S.views(spark)):
        raise ValueError(f"views: {made}")
    return rounded(spark.sql("SELECT n_name, count(*) AS customers, sum(c_acctbal) AS balance FROM td_customer JOIN td_nation ON c_nationkey = n_nationkey GROUP BY n_name"), balance=2)


def _archive(spark: SparkSession, sf: str) -> str:
    """Dwells archived by farm and year in two runs, of which the second repeats the first."""
    root = scratch(spark)
    d = R.dwells(spark, sf).select("dwell_id", "wind_farm", F.year("start_utc").alias("year"), "hs", "wind_speed", F.when(F.col("dwell_id") % 2 == 0, F.col("wind_direction")).alias("wind_direction"))
    S.write_archive(d.filter("year < 1996"), root)
    S.write_archive(d, root, spark.read.parquet(root))
    return root


@query(f"WITH {R.DWELLS} SELECT wind_farm, year(start_utc) AS year, count(*) AS rows FROM dwells WHERE year(start_utc) IN (1995, 1997) GROUP BY ALL")
def archive_slices(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-06, SRC-09, SNK-01: a partitioned archive written in steps, read for the wanted years only."""
    wanted = R.dwells(spark, sf).select("wind_farm", F.year("start_utc").alias("year")).distinct().filter(F.col("year").isin(1995, 1997))
    got = S.read_archive(spark, _archive(spark, sf), wanted)
    return got.groupBy("wind_farm", F.col("year").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {R.DWELLS}, f AS (SELECT wind_farm, year(start_utc) AS y, count(*) AS n, count(wind_speed) AS s, count(*) FILTER (dwell_id % 2 = 0) AS d FROM dwells GROUP BY ALL),
k AS (SELECT *, CASE WHEN s > 0 AND d > 0 THEN 'speed_and_direction' WHEN s > 0 THEN 'speed_only' ELSE 'other' END AS "set" FROM f) SELECT "set", sum(n)::BIGINT AS rows, count(DISTINCT wind_farm) AS farms, count(DISTINCT y) AS years, count(*) AS partitions FROM k GROUP BY 1""")
def archive_variables(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-10: partitions of an archive by what they carry; a partition stands for its files, however many tasks wrote it."""
    a = spark.read.parquet(_archive(spark, sf)).withColumn("file", F.concat_ws("/", "wind_farm", "year"))
    out = S.variable_sets(a, {"speed_and_direction": ("wind_speed", "wind_direction"), "speed_only": ("wind_speed",)})
    return out.select("set", "rows", "farms", "years", F.col("files").alias("partitions"))


@query("SELECT user_id % 20 AS asset, count(DISTINCT event_type) AS files, count(*) AS rows, min(to_timestamp(floor(epoch(ts)))::TIMESTAMP) AS first, max(to_timestamp(floor(epoch(ts)))::TIMESTAMP) AS last FROM events GROUP BY 1")
def status_files(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-11: semicolon-separated status files, one folder for each event type, and each asset's coverage."""
    root = scratch(spark)
    e = R.table(spark, sf, "events").select("event_type", (F.col("user_id") % 20).alias("asset"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), (F.col("event_id") % 6).alias("status_type_id"))
    e.repartition("event_type").write.partitionBy("event_type").option("sep", ";").option("header", True).csv(root)
    raw = S.read_status(spark, root).withColumn("file_id", F.col("event_type"))
    got = raw.select("file_id", F.col("asset").cast("long").alias("asset"), F.col("ts").cast("timestamp").alias("ts"))
    return S.asset_coverage(got, "asset")


@query(f"""WITH {R.TURBINES} SELECT 'all' AS part, count(*) AS turbines, count(DISTINCT wind_farm) AS farms FROM turbines UNION ALL SELECT 'country:' || country, count(*), count(DISTINCT wind_farm) FROM turbines WHERE country IN ('EUROPE', 'ASIA') GROUP BY 1
UNION ALL SELECT 'farm:' || wind_farm, count(*), 1 FROM turbines WHERE wind_farm = 'NATION_7' GROUP BY 1""")
def registry_parts(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-12: the registry split into all, countries and farms, written by part and read back."""
    root = scratch(spark)
    S.registry_parts(R.turbines(spark, sf), ["EUROPE", "ASIA"], ["NATION_7"]).write.partitionBy("part").parquet(root)
    return spark.read.parquet(root).groupBy("part").agg(F.count(F.lit(1)).alias("turbines"), F.count_distinct("wind_farm").alias("farms"))


@query(f"WITH {R.MANIFEST} SELECT 1::BIGINT AS batch_id, status, count(*) AS rows FROM manifest WHERE status <> 'listed' GROUP BY status UNION ALL SELECT 2, status, count(*) FROM manifest WHERE status = 'listed' GROUP BY status")
def manifest_batches(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-02: a run log appended to in two batches."""
    path, m = scratch(spark), R.manifest(spark, sf)
    S.append_manifest(spark, path, m.filter("status != 'listed'"))
    S.append_manifest(spark, path, m.filter("status = 'listed'"))
    return spark.read.parquet(path).groupBy("batch_id", "status").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {R.TURBINES} SELECT wind_farm, count(*) + 1 AS points FROM turbines GROUP BY wind_farm")
def checked_site_points(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-13 (checks)."""
    t = R.turbines(spark, sf)
    return G.check_site_points(G.site_points(t), t).groupBy("wind_farm").agg(F.count(F.lit(1)).alias("points"))


_CELLS = "cells AS (SELECT DISTINCT 54.2::DOUBLE + event_id % 8 * 0.1 AS lat, 6.2::DOUBLE + event_id // 8 % 8 * 0.2 AS lon FROM events WHERE value > 5)"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return R.table(spark, sf, "events").filter("value > 5").select((54.2 + k % 8 * 0.1).alias("grid_lat"), (6.2 + F.floor(k / 8) % 8 * 0.2).alias("grid_lon")).distinct()


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return R.turbines(spark, sf).select("wind_farm", F.col("found_id").cast("string").alias("sample_point_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


@query(f"""WITH {R.TURBINES}, {_CELLS}, p AS (SELECT found_id, wind_farm, latitude AS lat, longitude AS lon FROM turbines), d AS (SELECT p.found_id, p.lat, p.lon, min({R.HAVERSINE.format(r='6371.0088::DOUBLE', a='p.', b='c.')}) AS km FROM p, cells c GROUP BY ALL),
b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM cells)
SELECT found_id, round(km, 4) AS km, CASE WHEN NOT (lat BETWEEN a AND b.b AND lon BETWEEN c AND b.d) THEN 'outside_grid' WHEN km <= 12 THEN 'nearest_unchecked' ELSE 'valid_grid_too_far' END AS match_status FROM d, b""")
def unchecked_grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-07 (unchecked cells and the grid's box)."""
    out = G.nearest_cell(_points(spark, sf), _cells(spark, sf), 12.0, 1.0, checked=False, in_box=True)
    return rounded(out.select(F.col("sample_point_id").cast("long").alias("found_id"), "km", "match_status"), km=4)


@query(f"""WITH {R.TURBINES}, {_CELLS}, p AS (SELECT found_id, wind_farm, latitude AS lat, longitude AS lon FROM turbines), d AS (SELECT p.wind_farm, p.found_id, p.lat, p.lon, min({R.HAVERSINE.format(r='6371.0088::DOUBLE', a='p.', b='c.')}) AS km FROM p, cells c GROUP BY ALL),
b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM cells), s AS (SELECT wind_farm, lat BETWEEN a AND b.b AND lon BETWEEN c AND b.d AS i, km <= 12 AS n FROM d, b)
SELECT wind_farm, count(*) AS points, count(*) FILTER (i) AS inside, count(*) FILTER (n) AS near, count(*) FILTER (i AND n) AS covered, round(count(*) FILTER (i AND n) / count(*)::DOUBLE, 6) AS covered_share FROM s GROUP BY wind_farm""")
def grid_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """AG-64."""
    from tidemark.operators.reports import grid_coverage as cover

    cells = cut(_cells(spark, sf))
    return rounded(cover(G.nearest_cell(_points(spark, sf), cells, 12.0, 1.0), cells), covered_share=6)


_FIELD = """field AS (SELECT date_trunc('hour', ts) AS ts, 54.0::DOUBLE + user_id % 10 * 0.1 AS lat, 6.0::DOUBLE + user_id // 10 % 10 * 0.2 AS lon, avg(value) / 100 AS hs, avg(CASE WHEN event_id % 3 <> 0 THEN value END) / 30 AS tp, avg(value) / 40 AS tm FROM events GROUP BY ALL)"""


def _field(spark: SparkSession, sf: str) -> DataFrame:
    e, u, v = R.table(spark, sf, "events"), F.col("user_id"), F.col("value")
    return e.groupBy(F.date_trunc("hour", "ts").alias("ts"), (54.0 + u % 10 * 0.1).alias("grid_lat"), (6.0 + F.floor(u / 10) % 10 * 0.2).alias("grid_lon")).agg(
        (F.avg(v) / 100).alias("hs"), (F.avg(F.when(F.col("event_id") % 3 != 0, v)) / 30).alias("tp"), (F.avg(v) / 40).alias("tm")
    )


_PLACES = """ev AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN 53.9::DOUBLE + (event_id * 37 % 120) * 0.01 END AS lat, 5.9::DOUBLE + (event_id * 53 % 120) * 0.02 AS lon, ts AS "start", ts + to_minutes((event_id % 90 - 2)::INT) AS "end" FROM events)"""


def _places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return R.table(spark, sf, "events").select(
        "event_id", F.when(k % 11 != 0, 53.9 + (k * 37 % 120) * 0.01).alias("lat"), (5.9 + (k * 53 % 120) * 0.02).alias("lon"), F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros("ts") + (k % 90 - 2) * 60_000_000).alias("end")
    )


@query(f"""WITH {_FIELD}, {_PLACES}, c AS (SELECT DISTINCT lat, lon FROM field WHERE hs IS NOT NULL), b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM c),
n AS (SELECT e.event_id, arg_min(struct_pack(y := c.lat, x := c.lon), struct_pack(km := {R.HAVERSINE.format(r='6371.0088::DOUBLE', a='e.', b='c.')}, y := c.lat, x := c.lon)) AS g, min({R.HAVERSINE.format(r='6371.0088::DOUBLE', a='e.', b='c.')}) AS km FROM ev e, c WHERE e.lat IS NOT NULL GROUP BY 1),
p AS (SELECT e.*, km, CASE WHEN "end" >= "start" THEN to_timestamp((epoch("start") + epoch("end")) / 2)::TIMESTAMP END AS mid, lat BETWEEN a AND b.b AND lon BETWEEN c AND b.d AS i, g FROM ev e LEFT JOIN n USING (event_id), b),
r AS (SELECT * FROM p WHERE i AND km <= 12 AND mid IS NOT NULL),
t AS (SELECT r.event_id, f.hs, f.tp, f.tm, abs(epoch(f.ts) - epoch(r.mid)) AS gap FROM r JOIN field f ON f.lat = r.g.y AND f.lon = r.g.x AND abs(epoch(f.ts) - epoch(r.mid)) <= 5400 QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY abs(epoch(f.ts) - epoch(r.mid)), f.ts) = 1)
SELECT event_id, round(hs, 5) AS hs, round(coalesce(tp, tm), 5) AS tp, CASE WHEN tp IS NOT NULL THEN 'tp' WHEN tm IS NOT NULL THEN 'tm' END AS period_field,
CASE WHEN lat IS NULL THEN 'no_place' WHEN mid IS NULL THEN 'bad_window' WHEN NOT i THEN 'outside_grid' WHEN km > 12 THEN 'no_cell_in_reach' WHEN gap IS NULL THEN 'no_time_in_tolerance' WHEN hs IS NULL THEN 'no_value' END AS missing_reason FROM p LEFT JOIN t USING (event_id)""")
def event_field(spark: SparkSession, sf: str) -> DataFrame:
    """JN-22, SRC-08."""
    out = W.event_field(_places(spark, sf), cut(_field(spark, sf)), max_km=12.0)
    return rounded(out.select("event_id", "hs", "tp", "period_field", "missing_reason"), hs=5, tp=5)


@query("""WITH l AS (SELECT date_trunc('hour', ts) AS ts, user_id % 10 AS cell, event_id % 5 * 4 - 7 AS depth, avg(value) AS u FROM events GROUP BY ALL)
SELECT ts, cell, depth, round(u, 5) AS u FROM l QUALIFY row_number() OVER (PARTITION BY ts, cell ORDER BY abs(depth), depth) = 1""")
def surface_level(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-08 (surface level)."""
    e = R.table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("ts"), (F.col("user_id") % 10).alias("grid_lat"), F.lit(0).alias("grid_lon"), (F.col("event_id") % 5 * 4 - 7).alias("depth")).agg(F.avg("value").alias("u"))
    return rounded(G.surface_level(e).select("ts", F.col("grid_lat").alias("cell"), "depth", "u"), u=5)


_DEPTHS = """pt AS (SELECT c_custkey AS k, 54.0::DOUBLE + c_custkey % 500 * 0.001 AS lat, 6.0::DOUBLE + c_custkey // 500 * 0.01 AS lon FROM customer)"""


@query(f"""WITH {_DEPTHS}, d AS (SELECT *, CASE WHEN k % 7 <> 0 THEN k % 40 END AS av, CASE WHEN k % 3 = 0 THEN k % 40 + 1 END AS sm FROM pt)
SELECT k, (CASE WHEN k % 5 = 0 THEN NULL WHEN k % 11 = 0 THEN NULL ELSE coalesce(av, sm) END)::DOUBLE AS water_depth_m, CASE WHEN k % 5 = 0 THEN 'source_request_failed' WHEN k % 11 = 0 THEN 'source_payload_missing' WHEN coalesce(av, sm) IS NULL THEN 'source_depth_missing' ELSE 'ok' END AS depth_status,
CASE WHEN k % 5 = 0 OR k % 11 = 0 THEN NULL WHEN av IS NOT NULL THEN 'avg' WHEN sm IS NOT NULL THEN 'smoothed' END AS depth_field, 'archive' AS depth_source, coalesce(round(lat * 480) IS NOT NULL, false) AS snapped FROM d""")
def depth_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-14, FX-16."""
    k = F.col("c_custkey")
    points = R.table(spark, sf, "customer").select(k.alias("k"), (54.0 + k % 500 * 0.001).alias("lat"), (6.0 + F.floor(k / 500) * 0.01).alias("lon"))
    key = cache_key(F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon"))
    payload = F.to_json(F.struct(F.when(F.col("k") % 7 != 0, -(F.col("k") % 40).cast("double")).alias("avg"), F.when(F.col("k") % 3 == 0, -(F.col("k") % 40 + 1).cast("double")).alias("smoothed")))
    payloads = points.filter("k % 5 != 0").select(key.alias("key"), F.when(F.col("k") % 11 != 0, payload).alias("payload"))
    out = G.depth_references(G.depth_assignment(points, payloads), payloads, "archive", "v1")
    return out.select("k", "water_depth_m", "depth_status", "depth_field", "depth_source", (F.col("snap_m") < 200).alias("snapped"))


@query(f"""WITH {R.TURBINES}, f AS (SELECT wind_farm, count(*) AS points FROM turbines GROUP BY 1), {_FIELD}, s AS (SELECT f.wind_farm, points, count(DISTINCT ts) AS times, bool_or(x.hs IS NOT NULL) AS h, bool_or(x.tp IS NOT NULL) AS t FROM f, field x GROUP BY ALL)
SELECT wind_farm, times * points AS expected_rows, CASE WHEN NOT h OR NOT t THEN 'blocked_missing_variables' WHEN wind_farm = 'NATION_3' THEN 'done' ELSE 'ready' END AS state FROM s""")
def materialization_plan(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-15."""
    t = R.turbines(spark, sf)
    farms = t.select("wind_farm").distinct()
    field = cut(_field(spark, sf)).crossJoin(F.broadcast(farms))  # every farm's own copy of the field; farms are 25 nations at most
    years = field.select("wind_farm", F.year("ts").alias("year")).distinct().filter("wind_farm = 'NATION_3'")
    return G.materialization_plan(field, _points(spark, sf), years, ["hs", "tp"]).select("wind_farm", "expected_rows", "state")


@query(f"""WITH {R.TURBINES}, k AS (SELECT o_orderkey AS o, round(54.0::DOUBLE + o_orderkey % 9 * 0.11, 2) AS lat, round(6.0::DOUBLE + o_orderkey % 7 * 0.25, 2) AS lon, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
s AS (SELECT lat, lon, list_sort(list(DISTINCT month)) AS months FROM k GROUP BY ALL), c AS (SELECT wind_farm, avg(latitude) AS lat, avg(longitude) AS lon FROM turbines GROUP BY 1)
SELECT s.lat, s.lon, len(any_value(months)) AS months, arg_min(c.wind_farm, struct_pack(k := {R.HAVERSINE.format(r='6371.0088::DOUBLE', a='s.', b='c.')}, f := c.wind_farm)) AS nearest_farm, round(min({R.HAVERSINE.format(r='6371.0088::DOUBLE', a='s.', b='c.')}), 3) AS km FROM s, c GROUP BY s.lat, s.lon""")
def candidate_sites(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-16, FX-13."""
    k = F.col("o_orderkey")
    name = F.format_string("site_%.2f_%.2f_%s.csv", 54.0 + k % 9 * 0.11, 6.0 + k % 7 * 0.25, F.date_format("o_orderdate", "yyyy_MM"))
    out = G.candidate_sites(R.table(spark, sf, "orders").select(name.alias("file")), R.turbines(spark, sf))
    return rounded(out.withColumn("months", F.size("months").cast("long")), km=3)


@query(f"WITH {R.TURBINES} SELECT wind_farm, 'nws' AS source, 2024 AS year, count(*) + 1 AS rows, 0::BIGINT AS values, 'source_unavailable' AS missing_reason FROM turbines GROUP BY wind_farm")
def blocked_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SC-26."""
    b = G.blocked_rows(G.site_points(R.turbines(spark, sf)), "nws", 2024, "source_unavailable", ["hs", "tp"])
    return b.groupBy("wind_farm", "source", F.col("year").cast("long").alias("year"), "missing_reason").agg(F.count(F.lit(1)).alias("rows"), F.count("hs").alias("values"))


_STATIONS = "st AS (SELECT c_custkey AS station, 53.0::DOUBLE + c_custkey % 40 * 0.1 AS lat, 4.0::DOUBLE + c_custkey % 50 * 0.12 AS lon FROM customer)"


@query(f"""WITH {R.TURBINES}, {_STATIONS}, p AS (SELECT wind_farm, found_id, latitude AS lat, longitude AS lon FROM turbines), c AS (SELECT wind_farm, avg(lat) AS lat, avg(lon) AS lon FROM p GROUP BY 1),
m AS (SELECT station, st.lat, st.lon, p.wind_farm, min({R.HAVERSINE.format(r='6371.0088::DOUBLE', a='st.', b='p.')}) AS km FROM st, p GROUP BY ALL HAVING km <= 150)
SELECT station, m.wind_farm, round(km, 4) AS km, round({R.HAVERSINE.format(r='6371.0088::DOUBLE', a='m.', b='c.')}, 4) AS centroid_km, CASE WHEN km <= 5 THEN 'on_site' WHEN km <= 25 THEN 'near' WHEN km <= 75 THEN 'regional' ELSE 'background' END AS role FROM m JOIN c USING (wind_farm)""")
def station_roles(spark: SparkSession, sf: str) -> DataFrame:
    """JN-20."""
    k = F.col("c_custkey")
    st = R.table(spark, sf, "customer").select(k.alias("station"), (53.0 + k % 40 * 0.1).alias("lat"), (4.0 + k % 50 * 0.12).alias("lon"))
    return rounded(W.station_roles(st, _points(spark, sf)).drop("sample_point_id"), km=4, centroid_km=4)


@query("""WITH f AS (SELECT DISTINCT strftime(ts, '%Y_%m') AS token, event_type FROM events), n AS (SELECT token, count(*) AS n FROM f GROUP BY 1),
m AS (SELECT o_orderkey, unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH)) AS month FROM (SELECT o_orderkey, DATE '2023-12-01' + (o_orderkey % 60)::INT AS s, DATE '2023-12-01' + (o_orderkey % 60)::INT + 40 AS e FROM orders))
SELECT o_orderkey AS event_id, month::DATE::VARCHAR AS month, coalesce(n, 0) AS files, CASE WHEN n > 0 THEN 'available' ELSE 'missing' END AS status FROM m LEFT JOIN n ON n.token = strftime(month, '%Y_%m')""")
def month_sources(spark: SparkSession, sf: str) -> DataFrame:
    """JN-24, TG-06."""
    start = F.date_add(F.lit("2023-12-01").cast("date"), (F.col("o_orderkey") % 60).cast("int"))
    w = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), start.alias("start"), F.date_add(start, 40).alias("end"))
    files = R.table(spark, sf, "events").select(F.concat("event_type", F.lit("_"), F.date_format("ts", "yyyy_MM"), F.lit(".zip")).alias("file")).distinct()
    return W.month_sources(w, files).withColumn("month", F.col("month").cast("string"))


_PARTS = """o AS (SELECT o_orderkey AS event_id, 'F' || o_custkey % 9 AS wind_farm, TIMESTAMP '2024-01-03' + to_hours((o_orderkey % 700)::INT) AS s, TIMESTAMP '2024-01-03' + to_hours((o_orderkey % 700 + o_orderkey % 5 - 1)::INT) AS e FROM orders),
sm AS (SELECT 'F' || user_id % 9 AS wind_farm, date_trunc('hour', ts) AS ts, avg(CASE WHEN user_id % 9 <> 5 THEN value END) AS v FROM events GROUP BY ALL)"""


@query(f"""WITH {_PARTS}, m AS (SELECT 'F' || i AS wind_farm, CASE WHEN i = 2 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN i = 3 THEN 0 ELSE 4 END AS points FROM range(8) t(i)),
r AS (SELECT o.*, CASE WHEN e < s THEN 'bad_window' WHEN status IS NULL THEN 'no_partition' WHEN status = 'failed' THEN 'partition_not_accepted' WHEN points = 0 THEN 'no_points' WHEN o.wind_farm = 'F5' THEN 'unreadable_rows' END AS why FROM o LEFT JOIN m USING (wind_farm)),
g AS (SELECT event_id, avg(v) FILTER (ts BETWEEN s AND e) AS inside, max_by(v, ts) FILTER (ts <= s) AS b, min_by(v, ts) FILTER (ts >= e) AS a FROM r JOIN sm ON sm.wind_farm = r.wind_farm AND v IS NOT NULL WHERE why IS NULL GROUP BY 1)
SELECT event_id, round(coalesce(inside, (a + b) / 2), 6) AS value, CASE WHEN inside IS NOT NULL THEN 'window' WHEN a + b IS NOT NULL THEN 'bracket' ELSE 'not_assigned' END AS method, coalesce(why, CASE WHEN inside IS NULL AND a + b IS NULL THEN 'not_bracketed' END) AS missing_reason FROM r LEFT JOIN g USING (event_id)""")
def partition_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """JN-27, SRC-09."""
    k, base = F.col("o_orderkey"), 1704240000
    at = lambda h: F.timestamp_seconds(F.lit(base) + h * 3600)
    ev = R.table(spark, sf, "orders").select(k.alias("event_id"), F.concat(F.lit("F"), (F.col("o_custkey") % 9).cast("string")).alias("wind_farm"), at(k % 700).alias("start"), at(k % 700 + k % 5 - 1).alias("end"))
    u = F.col("user_id") % 9
    sm = R.table(spark, sf, "events").groupBy(F.concat(F.lit("F"), u.cast("string")).alias("wind_farm"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg(F.when(u != 5, F.col("value"))).alias("v"))
    m = spark.range(8).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("wind_farm"), F.lit(2024).alias("year"), F.when(F.col("id") == 2, "failed").otherwise("complete").alias("status"), F.when(F.col("id") == 3, 0).otherwise(4).alias("points"))
    return rounded(W.partition_candidates(ev, m, sm, "v"), value=6)


@query(f"""WITH {R.TURBINES}, d AS (SELECT wind_farm, round(latitude, 6) AS y, round(longitude, 6) AS x, min(rated_power * 3) AS depth FROM turbines WHERE rated_power > 4 GROUP BY ALL) SELECT found_id, depth FROM turbines t LEFT JOIN d ON d.wind_farm = t.wind_farm AND d.y = round(latitude, 6) AND d.x = round(longitude, 6)""")
def turbine_depths(spark: SparkSession, sf: str) -> DataFrame:
    """JN-10."""
    t = R.turbines(spark, sf)
    shift = F.lit(1e-8)
    depths = t.filter("rated_power > 4").select("wind_farm", (F.col("latitude") + shift).alias("latitude"), (F.col("longitude") - shift).alias("longitude"), (F.col("rated_power") * 3).alias("depth"))
    depths = depths.withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)}).groupBy("wind_farm", "latitude", "longitude").agg(F.min("depth").alias("depth"))
    return W.rounded_join(t, depths).select("found_id", "depth")


@query(f"""WITH {R.TURBINES}, p AS (SELECT wind_farm, 'turbine_' || lpad(found_id::VARCHAR, 4, '0') AS id, latitude AS lat, longitude AS lon FROM turbines UNION ALL SELECT wind_farm, 'farm_centroid', avg(latitude), avg(longitude) FROM turbines GROUP BY 1),
ev AS (SELECT o_orderkey AS event_id, n_name AS wind_farm, CASE WHEN o_orderkey % 4 <> 0 THEN 54.0::DOUBLE + o_orderkey % 100 * 0.01 END AS lat, 6.0::DOUBLE + o_orderkey % 90 * 0.02 AS lon FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT event_id, ev.lat IS NOT NULL AS placed, p.id, CASE WHEN ev.lat IS NOT NULL THEN {R.HAVERSINE.format(r='6371.0088::DOUBLE', a='ev.', b='p.')} WHEN p.id = 'farm_centroid' THEN 0 ELSE 1 END AS km FROM ev JOIN p USING (wind_farm)),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY km, id) = 1)
SELECT event_id, id AS sample_point_id, round(CASE WHEN placed THEN km END, 4) AS km, CASE WHEN id IS NULL THEN 'missing_farm' WHEN placed THEN 'nearest_point' ELSE 'farm_centroid' END AS method FROM ev LEFT JOIN b USING (event_id)""")
def nearest_points(spark: SparkSession, sf: str) -> DataFrame:
    """JN-03."""
    t = R.turbines(spark, sf)
    own = t.select("wind_farm", F.concat(F.lit("turbine_"), F.lpad(F.col("found_id").cast("string"), 4, "0")).alias("sample_point_id"), F.lit("turbine").alias("sample_point_type"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    centre = t.groupBy("wind_farm").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")).select("wind_farm", F.lit("farm_centroid").alias("sample_point_id"), F.lit("farm_centroid").alias("sample_point_type"), "lat", "lon")
    o, c, n = (R.table(spark, sf, x) for x in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    ev = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(k.alias("event_id"), F.col("n_name").alias("wind_farm"), F.when(k % 4 != 0, 54.0 + k % 100 * 0.01).alias("centroid_lat"), (6.0 + k % 90 * 0.02).alias("centroid_lon"))
    out = E.nearest_point(ev, own.unionByName(centre))
    return rounded(out.select("event_id", "sample_point_id", F.col("point_km").alias("km"), F.col("assignment_method").alias("method")), km=4)


@query(f"""WITH {R.TURBINES}, {R.PINGS}, y AS (SELECT p.mmsi, p.ts, p.sog, p.event_id, arg_min(t.wind_farm, struct_pack(d := {QE.DIST}, f := t.found_id)) AS wind_farm, min({QE.DIST}) AS d FROM pings p JOIN (SELECT found_id, wind_farm, latitude AS lat, longitude AS lon FROM turbines) t
  ON t.lat BETWEEN p.lat - 0.05 AND p.lat + 0.05 AND t.lon BETWEEN p.lon - 0.09 AND p.lon + 0.09 GROUP BY p.mmsi, p.ts, p.sog, p.event_id HAVING min({QE.DIST}) < 5000),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY mmsi, ts ORDER BY d) = 1),
k AS (SELECT *, CASE WHEN sog <= 1 AND d <= 200 THEN 'A' WHEN sog <= 1 AND d <= 500 THEN 'B' WHEN sog <= 3 AND d <= 500 AND sog > 1 THEN 'C' WHEN sog <= 1 THEN 'D' END AS tier FROM z),
o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR wind_farm <> lag(wind_farm) OVER w OR tier <> lag(tier) OVER w THEN 1 ELSE 0 END AS n FROM k WHERE tier IS NOT NULL WINDOW w AS (PARTITION BY mmsi ORDER BY ts, wind_farm, tier)),
s AS (SELECT *, sum(n) OVER (PARTITION BY mmsi ORDER BY ts, wind_farm, tier ROWS UNBOUNDED PRECEDING) AS id FROM o),
e AS (SELECT mmsi, id, tier, epoch(max(ts) - min(ts)) / 60.0 AS m, count(*) AS n FROM s GROUP BY ALL HAVING epoch(max(ts) - min(ts)) / 60.0 >= CASE WHEN tier IN ('A', 'C') THEN 20 ELSE 30 END)
SELECT tier AS dwell_tier, count(*) AS dwells, sum(n)::BIGINT AS pings, round(sum(m), 3) AS minutes FROM e GROUP BY tier""")
def tiered_dwells(spark: SparkSession, sf: str) -> DataFrame:
    """SC-01, FX-03 (zones by turbine)."""
    out = P.tiered_dwells(R.pings(spark, sf).drop("event_id"), R.turbines(spark, sf))
    return rounded(out.groupBy("dwell_tier").agg(F.count(F.lit(1)).alias("dwells"), F.sum("pings").alias("pings"), F.sum("duration_min").alias("minutes")), minutes=3)


@query(f"""WITH {R.TURBINES}, z AS (SELECT found_id, floor((longitude + 180) / 6)::INT + 1 AS zone, longitude - (floor((longitude + 180) / 6) * 6 - 177) AS dl, latitude AS la FROM turbines) SELECT found_id, zone, dl > 0 AS east_of_middle, true AS plausible FROM z""")
def utm_places(spark: SparkSession, sf: str) -> DataFrame:
    """FX-02 (projection): eastings lie on their side of the zone's middle, northings within 0.3 % of the meridian's length."""
    east, north = geo.utm(F.col("latitude"), F.col("longitude"))
    arc = F.col("latitude") * 111_132.0 * 0.9996
    return R.turbines(spark, sf).select("found_id", geo.utm_zone(F.col("longitude")).cast("long").alias("zone"), (east > 500_000).alias("east_of_middle"), (F.abs(north - arc) / arc < 0.003).alias("plausible"))


@query(f"""WITH {R.DWELLS}, a AS (SELECT d.dwell_id, t.wind_farm FROM dwells d JOIN turbines t USING (found_id)) SELECT wind_farm, count(*) AS events, count(*) AS inside FROM a GROUP BY wind_farm""")
def hull_zones(spark: SparkSession, sf: str) -> DataFrame:
    """FX-03 (hulls): every turbine of a farm lies in its farm's hull, to a centimetre."""
    t = R.turbines(spark, sf)
    # an event lies where its turbine does, so each place is measured once, with its events
    e = R.dwells(spark, sf).groupBy("found_id").agg(F.count(F.lit(1)).alias("n"))
    places = e.join(t.select("found_id", "wind_farm", "latitude", "longitude"), "found_id").groupBy("wind_farm", "latitude", "longitude").agg(F.sum("n").alias("n"))
    met = places.join(M.hulls(t), "wind_farm").withColumn("d", M.hull_distance(F.col("latitude"), F.col("longitude")))
    return met.groupBy("wind_farm").agg(F.sum("n").alias("events"), F.sum(F.when(F.col("d") <= 0.01, F.col("n")).otherwise(0)).alias("inside"))


@query()
def hull_zone_counts(spark: SparkSession, sf: str) -> DataFrame:
    """FX-03 (zones by hull): pings and mean distances by farm and zone; hulls have no SQL, a test has plain geometry."""
    out = M.hull_zones(R.pings(spark, sf), R.turbines(spark, sf)).groupBy("wind_farm", "zone").agg(F.count(F.lit(1)).alias("pings"), F.avg("hull_m").alias("hull_m"), F.avg("dist_m").alias("dist_m"))
    return rounded(out, hull_m=2, dist_m=2)


@query("SELECT year::INT AS year, month::INT AS month, row_number() OVER (ORDER BY year DESC, CASE WHEN month IN (1, 4, 7, 10) THEN 0 ELSE 1 END, month) AS position FROM (SELECT DISTINCT year(o_orderdate) AS year FROM orders), (SELECT unnest(range(1, 13)) AS month)")
def slice_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """TG-03: the calendar of the years that orders cover."""
    y = R.table(spark, sf, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).first()
    return A.schedule(spark, y.a, y.b).withColumn("position", F.col("position").cast("long"))


@query()
def ten_minute_upscale(spark: SparkSession, sf: str) -> DataFrame:
    """TG-02: hourly values by spline, directions along the shorter arc, metadata filled, clipped to each event; a test has the plain version."""
    e = R.table(spark, sf, "events")
    hourly = e.groupBy(F.col("event_type").alias("site"), F.date_trunc("hour", "ts").alias("ts")).agg((F.avg("value") / 100).alias("hs"), (F.avg((F.col("event_id") % 50).cast("double")) * 7.2).alias("direction"), F.when(F.hour(F.date_trunc("hour", "ts")) % 6 == 0, F.first("event_type")).alias("grid"))
    events = QE._intervals(spark, sf).join(e.select("event_id", F.col("event_type").alias("site")), "event_id").select("event_id", "site", "start", "end")
    return rounded(X.upscale(cut(hourly), events, "site", ["hs"], ["direction"], ["grid"]).select("event_id", "ts", "hs", "direction", "grid"), hs=5, direction=3)


@query("SELECT string_agg(c, ',' ORDER BY c) AS features, (SELECT count(*) FROM lineitem) AS rows FROM (SELECT unnest(['hs', 'tp', 'wind_speed']) AS c)")
def usable_features(spark: SparkSession, sf: str) -> DataFrame:
    """UD-06: columns that may be features, of a frame with some that would leak."""
    df = R.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("hs"), F.col("l_tax").alias("tp"), F.col("l_discount").alias("wind_speed"), F.col("l_linestatus").alias("status_type_id"), F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("label"))
    names = sorted(U.usable_features(df.columns))
    return df.select(*names).agg(F.count(F.lit(1)).alias("rows")).withColumn("features", F.lit(",".join(names)))


@query()
def model_reports(spark: SparkSession, sf: str) -> DataFrame:
    """UD-05: majority baseline, logistic regression and forest with farms kept apart, and the row-level contrast."""
    d = R.dwells(spark, sf).withColumn("y", (F.col("dwell_tier") == "A").cast("double"))
    return U.compare(d, ["hs", "tp", "wind_speed", "dist_m"], "y", "wind_farm", "dwell_id")


@query(f"""WITH {R.TURBINES}, {R.PINGS}, z AS (SELECT p.mmsi, p.ts, arg_min(t.wind_farm, struct_pack(d := {QE.DIST}, f := t.found_id)) AS wind_farm, min({QE.DIST}) AS d FROM pings p JOIN (SELECT found_id, wind_farm, latitude AS lat, longitude AS lon FROM turbines) t
  ON t.lat BETWEEN p.lat - 0.05 AND p.lat + 0.05 AND t.lon BETWEEN p.lon - 0.09 AND p.lon + 0.09 GROUP BY p.mmsi, p.ts, p.event_id HAVING min({QE.DIST}) < 5000),
u AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY mmsi, ts ORDER BY d) = 1),
o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 60 MINUTE OR wind_farm <> lag(wind_farm) OVER w THEN 1 ELSE 0 END AS n FROM u WINDOW w AS (PARTITION BY mmsi ORDER BY ts, wind_farm)),
s AS (SELECT *, sum(n) OVER (PARTITION BY mmsi ORDER BY ts, wind_farm ROWS UNBOUNDED PRECEDING) AS id FROM o)
SELECT mmsi, id::BIGINT AS visit_id, wind_farm, min(ts) AS enter, max(ts) AS leave, count(*) AS pings, round(min(d), 2) AS closest_m, CASE WHEN count(*) < 3 THEN 'sparse' ELSE 'ok' END AS quality FROM s GROUP BY ALL""")
def farm_visits(spark: SparkSession, sf: str) -> DataFrame:
    """WN-02."""
    return rounded(P.farm_visits(R.pings(spark, sf), R.turbines(spark, sf)), closest_m=2)


@query(f"""WITH {R.TURBINES}, d AS (SELECT DISTINCT n_name AS wind_farm FROM nation) SELECT wind_farm FROM d ANTI JOIN turbines USING (wind_farm)""")
def farms_without_turbines(spark: SparkSession, sf: str) -> DataFrame:
    """JN-17: farms of events that no turbine belongs to."""
    return M.only_in_events(R.table(spark, sf, "nation").select(F.upper("n_name").alias("wind_farm")), R.turbines(spark, sf))
