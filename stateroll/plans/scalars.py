"""Queries for scalar expressions, the calendar and source transforms."""

from __future__ import annotations


from pyspark.sql import functions as F

from stateroll.functions import calendar as C
from stateroll.functions import exprs as E
from stateroll.operators import transforms as X
from stateroll.plans.catalog import query, r

c = F.col


@query("c01_col_lit_param", "SELECT event_id, user_id, round(value * 1.5, 6) AS scaled, 'x' AS tag FROM events")
def _(t):
    return t.events.select(c("event_id"), c("user_id"), r(c("value") * E.param({"factor": 1.5}, "factor")).alias("scaled"), F.lit("x").alias("tag"))


@query("c02_raw_expression", "SELECT event_id, greatest(least(value, 100.0), 10.0) AS clipped, value BETWEEN 10 AND 100 AS inside, replace(event_type, 'c', 'k') AS swapped, substr(event_type, 1, 3) AS head FROM events")
def _(t):
    return t.events.select("event_id", E.raw("greatest(least(value, 100D), 10D)").alias("clipped"), E.raw("value BETWEEN 10 AND 100").alias("inside"), E.raw("replace(event_type, 'c', 'k')").alias("swapped"), E.raw("substr(event_type, 1, 3)").alias("head"))


@query("c03_logic", """
WITH e AS (SELECT event_id, nullif(event_type, 'error') = 'click' AS a, CASE WHEN value > 400 THEN NULL ELSE value > 100 END AS b FROM events)
SELECT event_id, a AND b AS both_true, a OR b AS any_true, NOT a AS not_a FROM e""")
def _(t):
    e = t.events.select("event_id", (F.nullif("event_type", F.lit("error")) == "click").alias("a"), F.when(c("value") > 400, F.lit(None)).otherwise(c("value") > 100).alias("b"))
    return e.select("event_id", E.all_of(c("a"), c("b")).alias("both_true"), E.any_of(c("a"), c("b")).alias("any_true"), E.negated(c("a")).alias("not_a"))


@query("c04_arithmetic", "SELECT event_id, round(value + user_id + 1, 6) AS s, round(value - user_id - 1, 6) AS d, round(value * user_id * 2, 6) AS p FROM events")
def _(t):
    v, u = c("value"), c("user_id")
    return t.events.select("event_id", r(E.add(v, u, F.lit(1))).alias("s"), r(E.sub(v, u, F.lit(1))).alias("d"), r(E.mul(v, u, F.lit(2))).alias("p"))


@query("c05_div", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'view' THEN -value ELSE value END AS a, CASE WHEN event_type IN ('error', 'view', 'click') THEN 0 ELSE user_id + 1 END AS b FROM events)
SELECT event_id, CASE WHEN b <> 0 THEN a / b END AS quotient, CASE WHEN b <> 0 THEN 'finite' WHEN a = 0 THEN 'nan' WHEN a > 0 THEN 'inf' ELSE '-inf' END AS kind FROM e""")
def _(t):
    a = F.when(c("event_type") == "error", 0.0).when(c("event_type") == "view", -c("value")).otherwise(c("value"))
    b = F.when(c("event_type").isin("error", "view", "click"), 0).otherwise(c("user_id") + 1)
    q = t.events.select("event_id", E.div(a, b).alias("q"))
    kind = F.when(F.isnan("q"), "nan").when(c("q") == float("inf"), "inf").when(c("q") == float("-inf"), "-inf").otherwise("finite")
    return q.select("event_id", F.when(kind == "finite", c("q")).alias("quotient"), kind.alias("kind"))


@query("c06_safe_div", """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE round(value / (user_id % 3), 6) END AS q, CASE WHEN event_type = 'view' THEN NULL WHEN user_id % 2 = 0 THEN 0.0 ELSE value END AS n FROM events""")
def _(t):
    return t.events.select("event_id", r(E.safe_div("value", c("user_id") % 3)).alias("q"), E.safe_div(F.when(c("event_type") != "view", c("value")), F.when(c("event_type") != "view", c("user_id") % 2)).alias("n"))


@query("c07_unary", "SELECT event_id, -value AS neg, abs(100 - value) AS dist, round(sqrt(value), 6) AS root, round(exp(value / 500), 6) AS e, ceil(value) AS up, floor(value) AS down FROM events")
def _(t):
    v = c("value")
    return t.events.select("event_id", E.neg(v).alias("neg"), F.abs(100 - v).alias("dist"), r(F.sqrt(v)).alias("root"), r(F.exp(v / 500)).alias("e"), E.ceil(v).alias("up"), E.floor(v).alias("down"))


@query("c08_log", "SELECT event_id, round(ln(value + 1), 6) AS natural, round(ln(value + 1) / ln(2), 6) AS base2 FROM events")
def _(t):
    return t.events.select("event_id", r(E.log(c("value") + 1)).alias("natural"), r(E.log(c("value") + 1, 2)).alias("base2"))


@query("c09_round", "SELECT user_id, event_id, CAST(round((event_id % 100) * 0.5) AS DOUBLE) AS whole, CAST(round(-((event_id % 100) * 0.25), 1) AS DOUBLE) AS tenth FROM events")
def _(t):
    return t.events.select("user_id", "event_id", E.rounded((c("event_id") % 100) * 0.5).alias("whole"), E.rounded(-((c("event_id") % 100) * 0.25), 1).alias("tenth"))


@query("c10_cast", "SELECT event_id, CAST(user_id AS INTEGER) AS i, CAST(user_id AS VARCHAR) AS s, CAST(user_id AS DOUBLE) AS d, CAST(ts AS DATE) AS day, user_id % 2 = 1 AS odd FROM events")
def _(t):
    u = c("user_id")
    return t.events.select("event_id", E.cast(u, "Int32").alias("i"), E.cast(u, "String").alias("s"), E.cast(u, "Float64").alias("d"), E.cast(c("ts"), "Date").alias("day"), E.cast(u % 2, "Boolean").alias("odd"))


@query("c11_concat", "SELECT event_id, nullif(event_type, 'error') || '-' || user_id AS k, event_type || user_id AS j FROM events")
def _(t):
    return t.events.select("event_id", E.concat([F.nullif("event_type", F.lit("error")), c("user_id")], "-").alias("k"), E.concat([c("event_type"), c("user_id")]).alias("j"))


@query("c12_least_greatest", "SELECT event_id, least(CASE WHEN value < 50 THEN NULL ELSE value END, 100.0, user_id) AS low, greatest(CASE WHEN value < 50 THEN NULL ELSE value END, 100.0, user_id) AS high FROM events")
def _(t):
    v = F.when(c("value") >= 50, c("value"))
    return t.events.select("event_id", F.least(v, F.lit(100.0), c("user_id").cast("double")).alias("low"), F.greatest(v, F.lit(100.0), c("user_id").cast("double")).alias("high"))


@query("c13_coalesce", "SELECT event_id, coalesce(nullif(event_type, 'view'), nullif(event_type, 'click'), 'none') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.coalesce(F.nullif("event_type", F.lit("view")), F.nullif("event_type", F.lit("click")), F.lit("none")).alias("k"))


@query("c14_compare", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax = 0.02 AS eq, l_tax <> 0.02 AS ne, l_tax < l_discount AS lt, l_tax <= l_discount AS le, l_tax > l_discount AS gt, l_tax >= l_discount AS ge FROM lineitem""")
def _(t):
    x, d = c("l_tax"), c("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (x == 0.02).alias("eq"), (x != 0.02).alias("ne"), (x < d).alias("lt"), (x <= d).alias("le"), (x > d).alias("gt"), (x >= d).alias("ge"))


@query("c15_membership", "SELECT event_id, nullif(event_type, 'error') IN ('click', 'view') AS is_in, nullif(event_type, 'error') NOT IN ('click', 'view') AS isnt_in FROM events")
def _(t):
    k = F.nullif("event_type", F.lit("error"))
    return t.events.select("event_id", E.is_in(k, ["click", "view"]).alias("is_in"), E.not_in(k, ["click", "view"]).alias("isnt_in"))


@query("c16_between", "SELECT event_id, user_id BETWEEN 10 AND 20 AS inside FROM events")
def _(t):
    return t.events.select("event_id", c("user_id").between(10, 20).alias("inside"))


@query("c17_nulls", "SELECT event_id, nullif(event_type, 'view') IS NULL AS missing, nullif(event_type, 'view') IS NOT NULL AS given FROM events")
def _(t):
    k = F.nullif("event_type", F.lit("view"))
    return t.events.select("event_id", k.isNull().alias("missing"), k.isNotNull().alias("given"))


@query("c18_matches", "SELECT p_partkey, regexp_matches(p_name, '[0-9]') AS digit, regexp_matches(p_type, 'E') AS e FROM part")
def _(t):
    return t.part.select("p_partkey", E.matches(c("p_name"), "[0-9]").alias("digit"), E.matches(c("p_type"), "E").alias("e"))


@query("c19_affixes", "SELECT event_id, starts_with(event_type, 'p') AS head, ends_with(event_type, 'w') AS tail, starts_with(event_type, '.') AS literal FROM events")
def _(t):
    k = c("event_type")
    return t.events.select("event_id", k.startswith("p").alias("head"), k.endswith("w").alias("tail"), k.startswith(".").alias("literal"))


@query("c20_case", "SELECT event_id, CASE WHEN value > 300 THEN 'high' WHEN value > 100 THEN 'mid' ELSE 'low' END AS band FROM events")
def _(t):
    return t.events.select("event_id", E.case([(c("value") > 300, F.lit("high")), (c("value") > 100, F.lit("mid"))], F.lit("low")).alias("band"))


@query("c21_date_trunc", """
SELECT event_id, CAST(ts AS DATE) AS d, CAST(date_trunc('month', ts) AS DATE) AS m, CAST(date_trunc('quarter', ts) AS DATE) AS q, CAST(date_trunc('year', ts) AS DATE) AS y, CAST(date_trunc('week', ts) AS DATE) AS w, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS h FROM events""")
def _(t):
    x = c("ts")
    return t.events.select("event_id", *[E.date_trunc(x, u).alias(n) for n, u in (("d", "day"), ("m", "month"), ("q", "quarter"), ("y", "year"), ("w", "week_iso"))], F.date_format(E.date_trunc(x, "hour"), "yyyy-MM-dd HH:mm").alias("h"))


@query("c22_date_diff", """
WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) - epoch_us(o_orderdate) AS us FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(us / 1e6) AS BIGINT) AS s, CAST(trunc(us / 6e7) AS BIGINT) AS mi, CAST(trunc(us / 3.6e9) AS BIGINT) AS h, CAST(trunc(us / 8.64e10) AS BIGINT) AS d FROM j""")
def _(t):
    j = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    of = lambda u: E.date_diff(c("o_orderdate"), c("l_shipdate"), u)
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", of("seconds").alias("s"), of("minutes").alias("mi"), of("hours").alias("h"), of("days").alias("d"))


@query("c23_date_diff_months_years", """
WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 8.64e10) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(d / 30) AS BIGINT) AS m, CAST(floor(d / 365) AS BIGINT) AS y FROM j""")
def _(t):
    j = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[E.date_diff(c("o_orderdate"), c("l_shipdate"), u).alias(u[0]) for u in ("months", "years")])


@query("c24_date_part", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(quarter(ts) AS INTEGER) AS q, CAST(hour(ts) AS INTEGER) AS h, CAST(isodow(ts) AS INTEGER) AS w FROM events")
def _(t):
    return t.events.select("event_id", *[E.date_part(c("ts"), p).alias(p[0]) for p in ("year", "month", "day", "quarter", "hour", "weekday")])


@query("c25_now", "SELECT event_id, true AS after_data FROM events")
def _(t):
    return t.events.select("event_id", (E.now() > c("ts").cast("timestamp_ntz")).alias("after_data"))


@query("c26_strftime_strptime", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS shown, CAST(strptime(strftime(ts, '%d.%m.%Y'), '%d.%m.%Y') AS DATE) AS back FROM events")
def _(t):
    return t.events.select("event_id", E.strftime(c("ts"), "%Y/%m/%d %H:%M:%S").alias("shown"), F.to_date(E.strptime(E.strftime(c("ts"), "%d.%m.%Y"), "%d.%m.%Y")).alias("back"))


@query("i01_grain_aliases", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'monthly' WHEN 2 THEN 'summary' WHEN 3 THEN 'summary' ELSE 'hourly' END AS grain FROM orders")
def _(t):
    names = F.array(*[F.lit(C.grain(n)) for n in (" day ", "Month", "All time", "all-time", "HOUR")])
    return t.orders.select("o_orderkey", F.element_at(names, (c("o_orderkey") % 5).cast("int") + 1).alias("grain"))


@query("i02_coarser_from_labels", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS "Month", CAST(year(o_orderdate) AS SMALLINT) AS "Year", year(o_orderdate) || '_Q' || quarter(o_orderdate) AS "Quarter" FROM orders""")
def _(t):
    return C.with_coarser(t.orders.select("o_orderkey", C.calendar_column("Month", c("o_orderdate")).alias("Month"))).select("o_orderkey", "Month", "Year", "Quarter")


@query("i03_coarsest_stored_level", """
SELECT strftime(o_orderdate, '%Y') AS label, count(*) AS orders FROM orders GROUP BY 1""")
def _(t):
    stored = {"daily": t.orders.groupBy(F.to_date("o_orderdate").alias("Day")).agg(F.count(F.lit(1)).alias("n")), "monthly": t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("Month")).agg(F.count(F.lit(1)).alias("n"))}
    level = C.stored_level(list(stored), "yearly")
    return C.with_coarser(stored[level]).groupBy(c("Year").cast("string").alias("label")).agg(F.sum("n").alias("orders"))


@query("i04_level_columns", """
SELECT CAST(o_orderdate AS DATE) AS "Day", strftime(o_orderdate, '%Y-%m') AS "Month", count(*) AS n FROM orders GROUP BY 1, 2""")
def _(t):
    return C.derive_calendar(t.orders, "o_orderdate").groupBy(*C.LEVEL_COLUMNS["daily"]).agg(F.count(F.lit(1)).alias("n"))


@query("i05_period_labels", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS daily, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS hourly, strftime(o_orderdate, '%G-W%V') AS weekly, year(o_orderdate) || '_Q' || quarter(o_orderdate) AS quarterly, CAST(year(o_orderdate) AS VARCHAR) AS yearly, 'ALL' AS summary FROM orders""")
def _(t):
    return C.derive_calendar(t.orders, "o_orderdate").select("o_orderkey", *[C.period_label(g).alias(g) for g in ("daily", "hourly", "weekly", "quarterly", "yearly", "summary")])


@query("i06_calendar_exposure", """
SELECT strftime(o_orderdate, '%Y-%m') AS "Month", CAST(year(o_orderdate) AS SMALLINT) AS "Year", year(o_orderdate) || '_Q' || quarter(o_orderdate) AS "Quarter", count(*) AS n FROM orders GROUP BY ALL""")
def _(t):
    stored = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return C.exposed(stored, "monthly").select("Month", "Year", "Quarter", "n")


@query("i07_multi_grain", """
WITH o AS (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m') AS m, CAST(year(o_orderdate) AS VARCHAR) AS y, o_totalprice AS p FROM orders)
SELECT s AS o_orderstatus, 'daily' AS grain, CAST(d AS VARCHAR) AS label, count(*) AS n, round(max(p), 2) AS hi FROM o GROUP BY s, d UNION ALL
SELECT s, 'monthly', m, count(*), round(max(p), 2) FROM o GROUP BY s, m UNION ALL SELECT s, 'yearly', y, count(*), round(max(p), 2) FROM o GROUP BY s, y UNION ALL
SELECT s, 'summary', NULL, count(*), round(max(p), 2) FROM o GROUP BY s""")
def _(t):
    got = C.multi_grain(C.derive_calendar(t.orders, "o_orderdate"), ["o_orderstatus"], {"n": F.count(F.lit(1)), "hi": r(F.max("o_totalprice"), 2)}, ["daily", "monthly", "yearly", "summary"])
    return got.select("o_orderstatus", "grain", F.coalesce(c("Day").cast("string"), "Month", c("Year").cast("string")).alias("label"), "n", "hi")


@query("b01_defaults", "SELECT event_id, coalesce(nullif(event_type, 'error'), 'other') AS event_type, 'web' AS channel FROM events")
def _(t):
    e = t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"))
    return X.defaults(e, {"event_type": "other", "channel": "web"})


@query("b02_rename_capitalize", 'SELECT event_id AS "EventID", user_id AS "UserName", event_type AS "EventType", value AS "ResponseCount" FROM events')
def _(t):
    return X.rename_capitalize(t.events.select(c("event_id").alias("pyeventid"), c("user_id").alias("pxUsername"), c("event_type").alias("eventtype"), c("value").alias("responsecount")))


@query("b03_parse_datetime", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown FROM events""")
def _(t):
    text = F.when(c("event_type") == "error", "not a time").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'.000 GMT'"))
    e = X.parse_datetime(t.events.select("event_id", text.alias("at")), ["at", "absent"], "%Y%m%dT%H%M%S.%3f %Z")
    return e.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("b04_derive_calendar", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Day", strftime(o_orderdate, '%G-W%V') AS "Week", strftime(o_orderdate, '%Y-%m') AS "Month", year(o_orderdate) || '_Q' || quarter(o_orderdate) AS "Quarter", CAST(year(o_orderdate) AS SMALLINT) AS "Year", strftime(o_orderdate, '%Y-%m-%dT%H') AS "Hour" FROM orders""")
def _(t):
    return X.derive_calendar(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", ["Day", "Week", "Month", "Quarter", "Year", "Hour"]).drop("o_orderdate")


@query("b05_derive_action_id", """SELECT event_id, coalesce(nullif(event_type, 'error') || '/' || user_id, '') AS "ActionID" FROM events""")
def _(t):
    e = t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("k"), "user_id")
    return X.derive_action_id(e, ["k", "user_id"]).select("event_id", "ActionID")


@query("b06_derive_column", "SELECT o_orderkey, round(o_totalprice / 100, 4) AS hundreds FROM orders")
def _(t):
    return X.derive_column(t.orders, "hundreds", r(c("o_totalprice") / 100, 4)).select("o_orderkey", "hundreds")


@query("b07_filter", "SELECT event_id FROM events WHERE nullif(event_type, 'error') <> 'view'")
def _(t):
    return X.keep(t.events, F.nullif("event_type", F.lit("error")) != "view").select("event_id")


@query("b08_dedup", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1""")
def _(t):
    return X.dedup(t.lineitem, ["l_orderkey", "l_linenumber", "absent"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("b09_cast", "SELECT event_id, CAST(user_id AS INTEGER) AS user_id, CAST(value AS VARCHAR) IS NOT NULL AS shown FROM events")
def _(t):
    e = X.cast(t.events, {"user_id": "Int32", "value": "String", "absent": "Int8"})
    return e.select("event_id", "user_id", c("value").isNotNull().alias("shown"))


@query("b10_drop_columns", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    return X.drop_columns(t.events, ["ts", "value", "props", "absent"])


@query("b11_coalesce", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'k' || user_id) AS k FROM events")
def _(t):
    e = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("a"), F.concat(F.lit("k"), "user_id").alias("b"))
    return X.coalesce(e, "k", ["absent", "a", "b"]).select("event_id", "k")


