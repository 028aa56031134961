"""Composite jobs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import timecols
from ..operators import asof, audit, library, perf, snapshot, windows
from ..sources import lake, publish
from ..sources.scratch import new_path
from ..streaming import rolling
from .asof_queries import NODES_SQL, refresh_nodes
from .registry import Tables, query

_W = "TIMESTAMP '2024-01-20 00:00:00'"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _domains(t: Tables) -> dict[str, snapshot.Domain]:
    part = lambda *names: t.pit.where(F.col("dataset").isin(*names))
    return {"events": snapshot.Domain(part("click", "view"), start=_at("2024-01-10")), "macro": snapshot.Domain(part("error")), "fundamentals": snapshot.Domain(part("purchase", "signup"), start=_at("2024-01-02"))}


def _counts(domains: dict[str, DataFrame]) -> DataFrame:
    return snapshot.profile(domains).select("domain", "rows", "first", "last")


_DOMAIN = "CASE WHEN dataset IN ('click', 'view') THEN 'events' WHEN dataset = 'error' THEN 'macro' ELSE 'fundamentals' END"


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS rows, CAST(min(available_at) AS VARCHAR) AS first, CAST(max(available_at) AS VARCHAR) AS last FROM {{pit}} p WHERE available_at <= {_W} AND available_at >= CASE {_DOMAIN} WHEN 'events' THEN TIMESTAMP '2024-01-10' WHEN 'fundamentals' THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '1970-01-01' END GROUP BY 1")
def c1_decision_snapshot(t: Tables) -> DataFrame:
    return _counts(snapshot.decision_snapshot(_domains(t), _at("2024-01-20")))


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS rows, CAST(min(available_at) AS VARCHAR) AS first, CAST(max(available_at) AS VARCHAR) AS last FROM {{pit}} p WHERE available_at > {_W} AND available_at <= TIMESTAMP '2024-01-27' GROUP BY 1")
def c2_replay_slot(t: Tables) -> DataFrame:
    return _counts(snapshot.replay_slot(_domains(t), _at("2024-01-20"), _at("2024-01-27")))


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS rows, 'ok' AS state FROM {{pit}} p WHERE available_at > {_W} AND available_at <= TIMESTAMP '2024-01-27' GROUP BY 1")
def snapshot_write(t: Tables) -> DataFrame:
    """Published, and every domain compared with its manifest."""
    root = new_path(t.spark, "snapshot")
    slot = snapshot.replay_slot(_domains(t), _at("2024-01-20"), _at("2024-01-27"))
    publish.publish(t.spark, root, {name: (df, []) for name, df in slot.items()}, "2024-01-20")
    return lake.union_by_name(*(publish.verify(t.spark, root, name).select(F.lit(name).alias("domain"), "rows", "state") for name in slot))


@query("""SELECT text_id, dataset, sha1(body) AS source_hash FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY available_at, dataset, text_id) AS r FROM {texts} t WHERE available_at <= 700 AND available_at >= CASE dataset WHEN 'src1' THEN 600 WHEN 'src2' THEN 400 ELSE 100 END) x WHERE r = 1""")
def c5_text_library(t: Tables) -> DataFrame:
    index, bodies = snapshot.text_library(t.texts, F.lit(700), {"src1": F.lit(600), "src2": F.lit(400)}, F.lit(100))
    return index.join(bodies, "text_id", "left_semi").select("text_id", "dataset", "source_hash")


@query("""SELECT 'statements' AS domain, 'repeated_keys' AS check, CAST(sum(n - 1) AS BIGINT) AS found FROM (SELECT dataset, code, period, count(*) AS n FROM {statements} s GROUP BY ALL) x UNION ALL
    SELECT 'ticks', 'days_without_open', count(*) FILTER (NOT o) FROM (SELECT trade_date, bool_or(trade_time = '09:30') AS o FROM {ticks} t GROUP BY 1) y UNION ALL
    SELECT 'bars', 'months_missing', count(*) FROM (SELECT DISTINCT i.month, p.p_brand FROM {index_monthly} i, part p EXCEPT SELECT month, code FROM {bars} b) z""".replace('AS check', 'AS "check"'))
def c7_lake_audit(t: Tables) -> DataFrame:
    found = lambda df, domain, check, n: df.agg(F.lit(domain).alias("domain"), F.lit(check).alias("check"), n.cast("long").alias("found"))
    keys = found(audit.key_audit(t.statements, ["code", "period"], "dataset"), "statements", "repeated_keys", F.sum("repeated_rows"))
    opens = found(audit.minute_quality(t.ticks, "trade_date", "ts_code", 1), "ticks", "days_without_open", F.count_if(~F.col("has_open")))
    expected = t.index_monthly.select("month").join(F.broadcast(t.part.select(F.col("p_brand").alias("code")).distinct()))
    gaps = found(expected.join(t.bars.select("month", "code"), ["month", "code"], "left_anti"), "bars", "months_missing", F.count("*"))
    return keys.unionByName(opens).unionByName(gaps)


@query("""WITH r AS (SELECT account, month, value, value / coalesce(lag(value) OVER (PARTITION BY account ORDER BY month), 100000) - 1 AS ret FROM {monthly} m), g AS (SELECT account, month, sum(market_value) AS gross FROM {holdings} h GROUP BY 1, 2),
    s AS (SELECT account, round(arg_max(value, month) / 100000 - 1, 6) AS total_return, round(avg(ret) / stddev_samp(ret) * sqrt(12.0), 6) AS sharpe FROM r GROUP BY 1), e AS (SELECT account, round(avg(coalesce(gross / value, 0)), 6) AS exposure FROM {monthly} m LEFT JOIN g USING (account, month) GROUP BY 1)
    SELECT account, total_return, sharpe, exposure, count(*) AS orders FROM s JOIN e USING (account) JOIN {tickets} k USING (account) GROUP BY ALL""")
def c10_performance_report(t: Tables) -> DataFrame:
    stats = perf.return_stats(t.monthly, "account", "month", "value", F.lit(100000.0), 12).select("account", F.round("total_return", 6).alias("total_return"), F.round("sharpe", 6).alias("sharpe"))
    exposed = perf.exposure(t.holdings, t.monthly, "account", "month", "value").select("account", F.round("average", 6).alias("exposure"))
    return stats.join(exposed, "account").join(t.tickets.groupBy("account").agg(F.count("*").alias("orders")), "account")


#: Refreshes of the rolled domains: ten weeks of nodes, and the ticks of a clock that stands still on some days and crosses several nodes on others.
_GRID = f"""grid AS (SELECT dataset, day + to_minutes(s) AS opens, day + to_minutes(s + m) AS ready FROM (VALUES {NODES_SQL}) n(dataset, s, m, w),
    (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-10', INTERVAL 1 DAY)) AS day) d WHERE list_contains(w, isodow(day) - 1))"""
_TICKS = "ticks AS (SELECT DISTINCT date_trunc('day', ts) + to_hours(CAST(7 + day(ts) % 16 AS BIGINT)) AS tick FROM events WHERE day(ts) % 3 > 0)"
_TEXT_AT = "TIMESTAMP '2024-01-01' + to_hours(available_at)"
_TEXT_SET = "CASE text_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' ELSE 'signup' END"


def _grid(t: Tables) -> DataFrame:
    return asof.refresh_grid(refresh_nodes(t), _at("2024-01-01"), 70)


def _ticks(t: Tables) -> DataFrame:
    clock = t.events.where(F.day("ts") % 3 > 0).select((F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(hours=7 + F.day("ts") % 16)).alias("tick"))
    return clock.distinct()


def _clock(t: Tables, path: str) -> DataFrame:
    """The ticks as a stream of files, a week each."""
    ticks = _ticks(t).persist()
    for week in range(5):
        ticks.where(F.floor((F.day("tick") - 1) / 7) == week).coalesce(1).write.mode("append").parquet(path)
    ticks.unpersist()
    return t.spark.readStream.schema("tick timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path)


def _rolled(t: Tables, layouts: dict[str, tuple[str, object]], path: str) -> None:
    rolling.roll(_clock(t, f"{path}/clock"), layouts, f"{path}/out", f"{path}/checkpoint").awaitTermination()


@query(f"""WITH {_GRID}, {_TICKS}, r AS (SELECT event_id, (SELECT min(ready) FROM grid g WHERE g.dataset = p.dataset AND opens >= available_at) AS shown FROM {{pit}} p
    UNION ALL SELECT -event_id - 1, available_at FROM {{pit}} q WHERE dataset = 'error')
    SELECT event_id, strftime((SELECT min(tick) FROM ticks WHERE tick >= shown), '%Y-%m-%d %H:%M:%S') AS tick FROM r WHERE shown <= (SELECT max(tick) FROM ticks)""")
def r2_rolling_as_of(t: Tables) -> DataFrame:
    """A clock stream over two domains: facts gated by refresh nodes, and errors (numbered from -1 down) by their own stamps."""
    path = new_path(t.spark, "rolling")
    gated = windows.newly_visible(t.pit.drop("props"), _grid(t), "dataset", "available_at", "start", "ready")
    own = t.pit.drop("props").where("dataset = 'error'").withColumn("event_id", -F.col("event_id") - 1).withColumn("shown_at", F.col("available_at").cast("timestamp_ntz"))
    for name, rows in (("facts", gated), ("errors", own)):
        rolling.lay_out(rows, f"{path}/{name}")
    _rolled(t, {"facts": (f"{path}/facts", gated.schema), "errors": (f"{path}/errors", own.schema)}, path)
    shown = rolling.view(t.spark, f"{path}/out", "facts", gated.schema).unionByName(rolling.view(t.spark, f"{path}/out", "errors", own.schema))
    return shown.select("event_id", F.date_format("tick", "yyyy-MM-dd HH:mm:ss").alias("tick"))


@query(f"""WITH {_GRID}, {_TICKS}, r AS (SELECT text_id, length(body) AS size, (SELECT min(ready) FROM grid g WHERE g.dataset = {_TEXT_SET} AND opens >= {_TEXT_AT}) AS shown FROM {{texts}} x)
    SELECT text_id, size, strftime((SELECT min(tick) FROM ticks WHERE tick >= shown), '%Y-%m-%d %H:%M:%S') AS tick FROM r WHERE shown <= (SELECT max(tick) FROM ticks)""")
def r3_rolling_text(t: Tables) -> DataFrame:
    """Index rows as the clock shows them, and each body with its index row, not earlier."""
    path = new_path(t.spark, "rolling")
    kind = F.when(F.col("text_id") % 4 == 0, "click").when(F.col("text_id") % 4 == 1, "view").when(F.col("text_id") % 4 == 2, "purchase").otherwise("signup")
    texts = t.texts.withColumn("dataset", kind).withColumn("available_at", _at("2024-01-01") + F.make_dt_interval(hours=F.col("available_at").cast("int")))
    index = windows.newly_visible(texts.drop("body"), _grid(t), "dataset", "available_at", "start", "ready")
    bodies = texts.select("dataset", "text_id", "body")
    at = rolling.lay_out_texts(index, bodies, path)
    body_schema = StructType([*bodies.schema.fields, index.schema["shown_at"]])
    _rolled(t, {"text_index": (at["text_index"], index.schema), "text_bodies": (at["text_bodies"], body_schema)}, path)
    seen = rolling.view(t.spark, f"{path}/out", "text_index", index.schema).select("dataset", "text_id", "tick")
    shown = rolling.view(t.spark, f"{path}/out", "text_bodies", body_schema).select("dataset", "text_id", F.char_length("body").cast("long").alias("size"), "tick")
    return seen.join(shown, ["dataset", "text_id", "tick"]).select("text_id", "size", F.date_format("tick", "yyyy-MM-dd HH:mm:ss").alias("tick"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 5) THEN CASE o_orderkey % 2 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 19:00:00') ELSE strftime(o_orderdate, '%Y-%m-%d 23:59:59') END WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d 23:59:59') END AS available_at,
    CASE WHEN o_orderkey % 6 IN (0, 1, 2, 5) THEN 'official' WHEN o_orderkey % 4 > 0 THEN 'fallback_date_end' ELSE 'static_reference_no_pit_time' END AS rule FROM orders""")
def event_available_at(t: Tables) -> DataFrame:
    """Macro, event and board rows alike: the official clock of the first date, else the second date's end, else no stamp."""
    d = t.messy_dates
    day, second = timecols.clean_date("first_date"), timecols.clean_date("second_date")
    rule = F.when(F.col("o_orderkey") % 2 == 0, "same_day_1900").otherwise("other")
    own = timecols.official_available_at("first_date", rule, F.lit("N"))
    late = F.date_format(F.to_date(second, "yyyyMMdd"), "yyyy-MM-dd 23:59:59")
    return d.select("o_orderkey", F.when(day.isNotNull(), own).otherwise(late).alias("available_at"), F.when(day.isNotNull(), "official").when(second.isNotNull(), "fallback_date_end").otherwise("static_reference_no_pit_time").alias("rule"))


@query("""SELECT c_mktsegment AS loop, count(*) AS rows, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'second' ELSE 'first' END AS available_at FROM customer GROUP BY 1""")
def registry_refresh(t: Tables) -> DataFrame:
    """A registry pulled twice as a whole, a part per loop value: rows that the pages repeat count once, and only the two loops that changed get a new stamp."""
    root = new_path(t.spark, "registry")
    old = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    first = t.customer.withColumn("c_acctbal", F.when(old, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    for rows, at in ((first, "first"), (t.customer.unionByName(t.customer), "second")):
        publish.publish(t.spark, root, {"customers": (rows.dropDuplicates(), ["c_mktsegment"])}, at)
    return publish.manifest(t.spark, root).select(F.substring_index("part", "=", -1).alias("loop"), "rows", "available_at")


@query("SELECT 'bars' AS table, code AS part, count(*) AS rows, 'ok' AS state FROM {bars} b GROUP BY 2 UNION ALL SELECT 'statements', dataset, count(*), 'ok' FROM {statements} s GROUP BY 2".replace("AS table", 'AS "table"'))
def freeze_release(t: Tables) -> DataFrame:
    """A generation pinned as a copy of its own; what is published afterwards does not reach it."""
    root = new_path(t.spark, "published")
    bars = publish.settled(t.bars, f"{root}/work/bars")  # published twice, worked out once
    publish.publish(t.spark, root, {"bars": (bars, ["code"]), "statements": (t.statements, ["dataset"])}, "first")
    own = publish.freeze(t.spark, root, "one", ["bars", "statements"])
    publish.publish(t.spark, root, {"bars": (bars.where("month < 199601"), ["code"])}, "second")
    rows = lambda name: publish.verify(t.spark, own, name).select(F.lit(name).alias("table"), F.substring_index("part", "=", -1).alias("part"), "rows", "state")
    return rows("bars").unionByName(rows("statements"))


@query("SELECT text_id, rank FROM (SELECT text_id, available_at, CASE WHEN regexp_matches(title, '(?i)des') THEN 20 ELSE 10 END AS rank FROM {texts} t WHERE available_at <= 900 AND (regexp_matches(title, '(?i)des') OR regexp_matches(body, '(?i)des'))) x ORDER BY rank DESC, available_at DESC, text_id LIMIT 25")
def t1_retrieval_rank(t: Tables) -> DataFrame:
    index, bodies = snapshot.text_library(t.texts.withColumn("body", F.concat("body", F.lit("#"), F.col("text_id").cast("string"))), F.lit(900), {}, F.lit(0))
    return snapshot.search_library(index, bodies, "des", F.lit(False), F.lit(900), 25).select("text_id", "rank")


@query("SELECT p.dataset, count(*) AS rows, count(*) FILTER (available_at <= TIMESTAMP '2024-01-15') AS seen FROM {pit} p GROUP BY 1")
def pit_filter(t: Tables) -> DataFrame:
    shown = asof.visible(t.pit.where("false"), t.pit, t.pit.select("dataset").distinct().withColumn("cutoff", _at("2024-01-15")))
    return t.pit.groupBy("dataset").agg(F.count("*").alias("rows")).join(shown.groupBy("dataset").agg(F.count("*").alias("seen")), "dataset")


_libraries: dict[tuple[str, str], library.Library] = {}


def _library(t: Tables) -> library.Library:
    """The texts as a library, written once a session."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _libraries:
        coded = t.texts.select("text_id", "dataset", "title", "available_at", F.concat(F.lpad(F.col("code").cast("string"), 6, "0"), F.lit(".SZ")).alias("ts_code"), "body")
        _libraries[key] = library.build(t.spark, coded, new_path(t.spark, "library"))
    return _libraries[key]


_FOUND = """SELECT text_id, dataset, rank, relevance, substr(body, 1, 200) AS snippet, CASE WHEN hit <> '' THEN substr(body, greatest(instr(body, hit) - 40, 1), instr(body, hit) - greatest(instr(body, hit) - 40, 1) + 40) END AS context
    FROM (SELECT *, regexp_extract(body, '{rx}') AS hit FROM r ORDER BY rank DESC, available_at DESC, text_id LIMIT {n}) x"""


@query("""WITH r AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)licen[cs]e|permission') THEN 20 ELSE 10 END AS rank, 'background' AS relevance FROM {texts} t WHERE available_at <= 600
    AND (regexp_matches(title, '(?i)licen[cs]e|permission') OR regexp_matches(body, '(?i)licen[cs]e|permission'))) """ + _FOUND.format(rx="(?i)licen[cs]e|permission", n=400))
def c6_library_search(t: Tables) -> DataFrame:
    """All visible texts; bodies are read where the postings name them."""
    return library.search(t.spark, _library(t), "licen[cs]e|permission", F.lit(600), 400).select("text_id", "dataset", "rank", "relevance", "snippet", "context")


@query("""WITH r AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)(the|der).{{2,9}}en') THEN 40 ELSE 30 END AS rank, 'candidate' AS relevance FROM {texts} t WHERE available_at BETWEEN 300 AND 900 AND (code = 7 OR contains(lower(title), 'the'))
    AND (regexp_matches(title, '(?i)(the|der).{{2,9}}en') OR regexp_matches(body, '(?i)(the|der).{{2,9}}en'))) """.replace("{{", "{").replace("}}", "}") + _FOUND.format(rx="(?i)(the|der).{2,9}en", n=300))
def c6_company_search(t: Tables) -> DataFrame:
    """One company's candidate texts of a lookback window."""
    return library.search(t.spark, _library(t), "(the|der).{2,9}en", F.lit(900), 300, ("000007.SZ", ["the"]), F.lit(300)).select("text_id", "dataset", "rank", "relevance", "snippet", "context")
