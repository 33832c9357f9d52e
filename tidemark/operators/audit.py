"""Data-quality audits: distributions, coverage, completeness, anomalies, guardrails, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import share
from tidemark.plans.lineage import cut

QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def distribution(df: DataFrame, columns: list[str], *groups: str) -> DataFrame:
    """count, min, quantiles, max and mean of each column (a row each); unavailable says why there are none. Quantiles are exact, by range partitions."""
    from tidemark.operators.stats import quantiles

    long = df.select(*groups, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(*groups, "x.column", "x.v")
    key = [*groups, "column"]
    out = long.groupBy(*key).agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    q = quantiles(long, key, "v", QUANTILES)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"q.{k}")) for k in key]
    met = out.alias("a").join(q.alias("q"), same, "left")
    return met.select(*(F.col(f"a.{k}").alias(k) for k in key), "n", "min", *QUANTILES, "max", "mean", F.when(F.col("n") == 0, "no values").alias("unavailable"))


def coverage(df: DataFrame, valid: Column, sets: list[list[str]]) -> DataFrame:
    """Rows, valid rows and their share for several groupings in one pass (grouping sets); `level` names the columns used."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    cols = [F.col(c) for c in every]
    flat = df.withColumn("__valid", valid)
    out = flat.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.count(F.lit(1)).alias("rows"), F.count_if("__valid").alias("valid_rows"), F.grouping_id(*cols).alias("__g"))
    level = F.lit(None).cast("string")
    for s in sets:
        g = sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in s)
        level = F.when(F.col("__g") == g, "+".join(s)).otherwise(level)
    return out.select(level.alias("level"), *every, "rows", "valid_rows", share(F.col("valid_rows"), F.col("rows")).alias("valid_share"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """nulls, zeros, distinct values and null share of each column, one row each."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *(a for c in columns for a in (F.count(c).alias(f"{c}__n"), F.count_if(F.col(c).cast("string") == "0").alias(f"{c}__z"), F.count_distinct(c).alias(f"{c}__d"))))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"{c}__n")).alias("nulls"), F.col(f"{c}__z").alias("zeros"), F.col(f"{c}__d").alias("distinct")) for c in columns)))
    return one.select("rows", rows.alias("x")).select("x.*", share(F.col("x.nulls"), F.col("rows")).alias("null_share"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """df without columns that are null in every row; one aggregate decides."""
    n = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if n[c] == 0))


def concentration(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """Distinct values, the most common one with its share, and the share of the top few, for each column."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").filter("value is not null")
    n = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
    return ranked.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("top_value"),
        (F.max(F.when(F.col("rank") == 1, F.col("n"))) / F.sum("n")).alias("top_share"),
        (F.sum(F.when(F.col("rank") <= top, F.col("n")).otherwise(0)) / F.sum("n")).alias("top_few_share"),
    )


def key_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: rows and repeated keys of two tables, keys only in either, whether the key sets are equal."""
    x = a.groupBy(key).agg(F.count(F.lit(1)).alias("na"))
    y = b.groupBy(key).agg(F.count(F.lit(1)).alias("nb"))
    met = x.join(y, key, "full").na.fill(0, ["na", "nb"])
    return met.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("nb"), F.lit(0)).alias("rows_b"), F.count_if(F.col("na") > 1).alias("repeated_a"), F.count_if(F.col("nb") > 1).alias("repeated_b"),
        F.count_if(F.col("nb") == 0).alias("only_a"), F.count_if(F.col("na") == 0).alias("only_b"),
    ).withColumn("same_keys", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def physical_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, one row a rule; a null value breaks none."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(~r).alias(k) for k, r in rules.items()))
    return one.select("rows", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("broken")) for k in rules))).alias("x")).select("x.rule", "rows", "x.broken", (F.col("x.broken") == 0).alias("passed"))


def metrics_long(one: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns))).alias("x")).select("x.*")


def latest_state(manifest: DataFrame, keys: list[str], ts: str, stage_order: list[str], status_order: list[str]) -> DataFrame:
    """The latest row of each key and stage, then each key's furthest stage and best status."""
    w = Window.partitionBy(*keys, "stage").orderBy(F.desc(ts), "status")
    latest = manifest.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    rank = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    best = F.struct((-rank("stage", stage_order)).alias("s"), rank("status", status_order).alias("t"))
    return latest.groupBy(*keys).agg(F.min_by(F.struct("stage", "status"), best).alias("x")).select(*keys, "x.stage", "x.status")


def unresolved(expected: DataFrame, state: DataFrame, keys: list[str], done: list[str]) -> DataFrame:
    """Expected slices without a state, or whose status is not done."""
    return expected.join(state.filter(F.col("status").isin(done)), keys, "left_anti")


def schedule(spark, first_year: int, last_year: int, quarter_months: tuple[int, ...] = (1, 4, 7, 10)) -> DataFrame:
    """Month slices, newest year first, quarter months first, numbered in that order."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    out = years.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    order = Window.orderBy(F.desc("year"), F.when(F.col("month").isin(*quarter_months), 0).otherwise(1), "month")
    return out.withColumn("position", F.row_number().over(order))


def data_index(farms: DataFrame, months: DataFrame, inventories: dict[str, DataFrame]) -> DataFrame:
    """Every farm and month with a count and status for each inventory (tables of wind_farm, month, n)."""
    out = farms.select("wind_farm").crossJoin(F.broadcast(months.select("month")))
    for name, t in inventories.items():
        got = t.groupBy("wind_farm", "month").agg(F.sum("n").alias(f"{name}_count"))
        out = out.join(got, ["wind_farm", "month"], "left")
        n = F.col(f"{name}_count")
        out = out.withColumn(f"{name}_status", F.when(n.isNull(), "missing").when(n == 0, "empty").otherwise("present")).withColumn(f"{name}_count", F.coalesce(n, F.lit(0)))
    return out


def anomalies(index: DataFrame, rules: list[tuple[str | Column, str, Column, Column, str]]) -> DataFrame:
    """A row for each rule (severity, type, test, evidence, action) that a row of the index breaks."""
    found = F.array_compact(F.array(*(F.when(test, F.struct((F.lit(s) if isinstance(s, str) else s).alias("severity"), F.lit(t).alias("type"), ev.cast("string").alias("evidence"), F.lit(a).alias("action"))) for s, t, test, ev, a in rules)))
    return index.withColumn("x", F.explode(found)).select(*index.columns, "x.*")


#: Limits of the rules on an index of farms and months.
LIMITS = {"duplicate_share": 0.3, "tier_d_share": 0.4, "dwells_per_visit": 2.0, "weather_missing": 0.25, "weather_to_year": 2024, "raw_mb": 0.1}
#: Statuses of partitions that are empty by design, and severities, worst first.
EMPTY_BY_DESIGN = ("success_no_ais_in_bbox", "skipped_missing_source")
SEVERITIES = ("Critical", "Warning", "Info")


def observatory(index: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """What ten rules find wrong with an index of farms and months: wind_farm, year, month, severity, type, evidence, action, worst first.

    The index has wind_farm, year, month, target and operational (booleans),
    manifest_status, raw_status and raw_mb, filtered_status and filtered_rows,
    visits_status and visits, dwells_status, dwells, tier_d and duplicates,
    weather_status, weather_rows and weather_missing. Severity follows what
    the manifest claims (a success without output is critical), whether the
    farm is a target and whether the month was in operation. limits override
    LIMITS.
    """
    t = LIMITS | (limits or {})
    c = {n: F.col(n) for n in index.columns}
    is_ = lambda n, *v: F.coalesce(F.lower(n).isin(*v), F.lit(False))
    yes = lambda n: F.coalesce(c[n], F.lit(False))
    more = lambda n, x: F.coalesce(c[n] > x, F.lit(False))
    claimed, by_design = is_("manifest_status", "success"), is_("manifest_status", *EMPTY_BY_DESIGN)
    scope = F.when(yes("target"), "Warning").otherwise("Info")
    failed = F.when(claimed, "Critical").when(yes("target") & yes("operational"), "Warning").otherwise("Info")
    expected = F.when(c["year"] <= t["weather_to_year"], "Warning").otherwise("Info")
    raw, visits, dwells = is_("raw_status", "exists"), is_("visits_status", "exists"), is_("dwells_status", "exists")
    share = lambda a, b: F.try_divide(c[a].cast("double"), c[b].cast("double"))
    above = lambda a, b, x: F.coalesce(share(a, b) > x, F.lit(False))
    # by the exact value and half to even, as Python and SQL's printf round; Java's format rounds the shortest decimals half up
    one_place = F.udf(lambda x: None if x is None else f"{x:.1f}", "string")
    percent = lambda x: F.concat(one_place(x * 100), F.lit("%"))
    empty = (is_("filtered_status", "exists") & (c["filtered_rows"] == 0)) | (visits & (c["visits"] == 0)) | (dwells & (c["dwells"] == 0))
    rules = [
        (scope, "missing_raw_source", is_("raw_status", "missing") & yes("operational"), c["raw_status"], "check the source or whether the month is planned"),
        (failed, "interrupted_filtering", raw & more("raw_mb", 0) & is_("filtered_status", "interrupted", "empty"), c["filtered_status"], "run the filter again"),
        (F.when(claimed, "Critical").otherwise(scope), "missing_visits", raw & more("raw_mb", t["raw_mb"]) & is_("visits_status", "missing") & ~by_design & (claimed | yes("operational")), F.coalesce("manifest_status", F.lit("not run")), "run the visits"),
        (failed, "missing_dwells", visits & more("visits", 0) & is_("dwells_status", "missing"), c["visits"], "run the dwells"),
        (expected, "missing_weather", dwells & more("dwells", 0) & is_("weather_status", "missing"), c["dwells"], "join the weather"),
        ("Warning", "many_duplicates", dwells & above("duplicates", "dwells", t["duplicate_share"]), percent(share("duplicates", "dwells")), "check places that overlap"),
        ("Info", "many_tier_d", dwells & above("tier_d", "dwells", t["tier_d_share"]), percent(share("tier_d", "dwells")), "check whether vessels pass by"),
        ("Warning", "many_dwells_a_visit", visits & dwells & above("dwells", "visits", t["dwells_per_visit"]), one_place(share("dwells", "visits")), "check the sampling"),
        (scope, "empty_output", raw & more("raw_mb", t["raw_mb"]) & yes("operational") & empty & ~by_design, F.concat_ws("/", "filtered_rows", "visits", "dwells"), "check bounds and vessels"),
        (expected, "weather_gaps", is_("weather_status", "joined") & more("weather_rows", 0) & more("weather_missing", t["weather_missing"]), percent(c["weather_missing"]), "check the grid's coverage"),
    ]
    out = anomalies(index, rules).select("wind_farm", "year", "month", "severity", "type", "evidence", "action")
    return out.orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), "wind_farm", "year", "month", "type")


#: What a variable's values must be (least, whether it may be that, most, whether it may be that), by canonical name.
RANGES = {"hs": (0.0, True, None, True), "tp": (0.0, False, None, True), "wave_direction": (0.0, True, 360.0, False)}


def export_profile(df: DataFrame, mapping: dict[str, str], keys: list[str] = (), ranges: dict = RANGES) -> DataFrame:
    """For each mapped column of an export (text or numbers, a decimal comma too): rows that have a number, null_count and null_rate, min, max, mean, and out_of_range values with a warning.

    mapping: column to canonical name; ranges are by canonical name. One pass
    with partial sums; keys group.
    """
    from tidemark.functions.values import number

    aggs = [F.count(F.lit(1)).alias("__rows")]
    for col, name in mapping.items():
        v = number(F.col(col))
        low, low_too, high, high_too = ranges.get(name, (None, True, None, True))
        bad = F.lit(False)
        if low is not None:
            bad = bad | (v < low if low_too else v <= low)
        if high is not None:
            bad = bad | (v > high if high_too else v >= high)
        aggs.append(F.struct(F.lit(col).alias("column"), F.lit(name).alias("name"), F.count(v).alias("values"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count_if(bad).alias("out_of_range")).alias(f"__{col}"))
    out = df.groupBy(*keys).agg(*aggs).select(*keys, "__rows", F.explode(F.array(*(F.col(f"__{c}") for c in mapping))).alias("x")).select(*keys, "__rows", "x.*")
    nulls = F.col("__rows") - F.col("values")
    warning = F.when(F.col("out_of_range") > 0, F.concat_ws(" ", F.col("name"), F.lit("out of range")))
    return out.select(*keys, "column", "name", "values", nulls.alias("null_count"), F.coalesce(F.try_divide(nulls, "__rows"), F.lit(0.0)).alias("null_rate"), "min", "max", "mean", "out_of_range", warning.alias("warning"))


def spot_checks(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k evenly spaced rows in an order, the first and the last among them.

    Positions come from a row number within range partitions and the sizes
    of those before, so no single task numbers all rows.
    """
    total = df.count()
    wanted = sorted({round(i * (total - 1) / max(1, k - 1)) + 1 for i in range(min(k, total))})
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % (1 << 33))
    parts = cut(parts)
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).orderBy("__p").collect()  # a row for each partition
    start, at = {}, 0
    for r in sizes:
        start[r["__p"]], at = at, at + r.n
    picks = [(p, w - 1 - s, w) for w in wanted for p, s in start.items() if s < w <= s + next(r.n for r in sizes if r["__p"] == p)]
    t = df.sparkSession.createDataFrame(picks, "__p int, __i long, position long")
    return parts.join(F.broadcast(t), ["__p", "__i"]).drop("__p", "__i")


def recomputed(df: DataFrame, value: str, expected: Column, tolerance: float = 1e-6) -> DataFrame:
    """df with the expected value, computed anew, and whether the value is it (both null is)."""
    same = F.when(F.col("expected").isNull() | F.col(value).isNull(), F.col("expected").isNull() & F.col(value).isNull()).otherwise(F.abs(F.col(value) - F.col("expected")) <= tolerance)
    return df.withColumn("expected", expected).withColumn("as_expected", same)


def cadence(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Each series' most common step (s), gaps over 1.5 steps, repeated times, first and last. Times are counted first and met by range partitions."""
    from tidemark.operators.stats import previous

    times = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("__n"))
    d = cut(previous(times, keys, ts, [ts]).withColumn("__d", (F.unix_micros(ts) - F.unix_micros(f"before.{ts}")) / 1e6).drop("before"))
    n = d.filter("__d > 0").groupBy(*keys, "__d").agg(F.count(F.lit(1)).alias("n"))
    step = n.groupBy(*keys).agg(F.min_by("__d", F.struct(-F.col("n"), F.col("__d"))).alias("step_s"))
    met = d.join(step, keys, "left")
    return met.groupBy(*keys, "step_s").agg(F.sum("__n").alias("rows"), F.sum(F.col("__n") - 1).alias("repeated"), F.count_if(F.col("__d") > 1.5 * F.col("step_s")).alias("gaps"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def guardrails(df: DataFrame, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """Each named check's broken rows, pass or fail, and a recommendation as JSON of all failed names in every row."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c, _ in checks))
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("broken"), F.when(F.col(n) == 0, "pass").otherwise(F.lit(level)).alias("status")) for n, _, level in checks))
    out = one.withColumn("r", rows)
    failed = F.transform(F.filter("r", lambda x: x["status"] == "fail"), lambda x: x["check"])
    verdict = F.to_json(F.named_struct(F.lit("recommendation"), F.when(F.size(failed) == 0, "proceed").otherwise("stop"), F.lit("failed"), failed))
    return out.select(F.explode("r").alias("x"), verdict.alias("summary")).select("x.*", "summary")


def concentration_by(df: DataFrame, subsets: dict[str, Column], columns: list[str], few: int = 5) -> DataFrame:
    """How much a handful of values holds of each column, in each subset of the rows: subset, column, events, share_of_all, unique, top_value, top_count, top_share, few_count, few_share.

    Subsets may overlap; a null value counts as missing. Ties go to the
    smaller value. Rows are counted by subset, column and value in one pass;
    what is ranked are those counts. An empty subset has a row of zeros for
    each column.
    """
    inside = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in subsets.items())), lambda s: s.isNotNull())
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("value")) for c in columns)))
    marked = df.select(inside.alias("__s"), *columns)
    counts = marked.select(cells.alias("x"), "__s").groupBy("x.column", "x.value", "__s").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.explode("__s").alias("subset"), "column", "value", "n").groupBy("subset", "column", "value").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("subset", "column").orderBy(F.desc("n"), "value"))
    ranked = counts.withColumn("__r", best).groupBy("subset", "column").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("unique"), F.max(F.when(F.col("__r") == 1, F.col("value"))).alias("top_value"), F.max(F.when(F.col("__r") == 1, F.col("n"))).alias("top_count"), F.sum(F.when(F.col("__r") <= few, F.col("n"))).alias("few_count"))
    every = df.sparkSession.createDataFrame([(s, c) for s in subsets for c in columns], "subset string, column string")
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    out = every.join(ranked, ["subset", "column"], "left").join(F.broadcast(total)).fillna(0, ["events", "unique", "top_count", "few_count"])
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return out.select("subset", "column", "events", over("events", "__all").alias("share_of_all"), "unique", "top_value", "top_count", over("top_count", "events").alias("top_share"), "few_count", over("few_count", "events").alias("few_share"))
