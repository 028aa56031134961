"""Batch forms of the streaming jobs on the driver's tables, and streams over them that end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import text
from ..sources.scratch import new_path
from ..streaming import jobs
from .registry import Tables, query


def _folder(t: Tables) -> str:
    """A folder that driver and executors share."""
    return new_path(t.spark, "stream")


@query("SELECT trade_date, count(*) AS bars FROM (SELECT DISTINCT trade_date, ts_code, trade_time FROM {ticks} t) x GROUP BY trade_date")
def r1_minute_ingest(t: Tables) -> DataFrame:
    """Ticks as a file stream in several micro-batches, merged by year."""
    at = _folder(t)
    ticks = t.ticks.withColumn("year", F.substring("trade_date", 1, 4)).withColumn("_third", F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_suppkey"), F.lit(3)))
    parts = [ticks.where(F.col("_third") == k).select("ts_code", "trade_time", "price", "trade_date", "year") for k in range(3)]
    ingest = lambda feed: jobs.ingest_minutes(feed, f"{at}/store", ["trade_date", "ts_code", "trade_time"], "year", f"{at}/checkpoint")
    _step_by_step(t, parts, f"{at}/in", ingest)
    return t.spark.read.schema(parts[0].schema).parquet(f"{at}/store").groupBy("trade_date").agg(F.count("*").alias("bars"))


def _fed(t: Tables, rows: DataFrame, path: str, files: Sequence[Column], kind: str = "parquet") -> DataFrame:
    """``rows`` as a stream of files, one a micro-batch in the order of ``files`` (which rows each holds)."""
    kept = rows.persist()
    for which in files:
        kept.where(which).coalesce(1).write.mode("append").format(kind).save(path)
    kept.unpersist()
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).format(kind).load(path)


def _step_by_step(t: Tables, steps: Sequence[DataFrame], path: str, job: Callable[[DataFrame], StreamingQuery]) -> None:
    """Appends each step, as many files as it has tasks, and runs the job on what is there: steps keep their order, whatever the times of files say.

    Only the last run has a batch without rows, for what is due by then; the others leave it to the next step.
    """
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    usual = t.spark.conf.get(empty)
    try:
        for k, rows in enumerate(steps, 1):
            rows.write.mode("append").parquet(path)
            t.spark.conf.set(empty, usual if k == len(steps) else "false")
            job(t.spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()
    finally:
        t.spark.conf.set(empty, usual)


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def r4_trace_counters(t: Tables) -> DataFrame:
    """Counters of a log that grows by three files, with a partial last line."""
    at = _folder(t)
    lines = t.events.select(F.to_json(F.struct("event_type", F.from_json("props", "k long")["k"].alias("k"))).alias("value"), (F.col("event_id") % 3).alias("part"))
    lines = lines.unionByName(t.spark.range(1).select(F.lit('{"event_type": "cli').alias("value"), F.lit(2).cast("long").alias("part")))
    feed = _fed(t, lines, f"{at}/in", [F.col("part") == k for k in range(3)])
    jobs.keep_counting(feed, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return jobs.counted(t.spark, f"{at}/out")


@query("""WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS seen FROM events), e AS (SELECT user_id, ts, event_type AS kind, count(*) FILTER (event_type NOT IN ('signup', 'purchase')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS others,
    ts AS came FROM events), s AS (SELECT user_id, ts, kind, others, lead(ts) OVER k AS next_ts, lead(kind) OVER k AS next_kind, lead(others) OVER k AS next_others FROM (SELECT * FROM e WHERE kind IN ('signup', 'purchase')) x WINDOW k AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, CASE WHEN next_ts IS NULL AND ts + INTERVAL 12 HOUR < date_trunc('millisecond', seen) OR next_ts > ts + INTERVAL 12 HOUR THEN 'lost' WHEN next_kind = 'purchase' THEN 'done' END AS state FROM s, w WHERE kind = 'signup')
    SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at, CASE WHEN state = 'done' THEN strftime(next_ts, '%Y-%m-%d %H:%M:%S') END AS ended_at, CASE WHEN state = 'done' THEN next_others - others ELSE (SELECT count(*) FROM e WHERE e.user_id = r.user_id AND kind NOT IN ('signup', 'purchase') AND came > r.ts AND came <= r.ts + INTERVAL 12 HOUR) END AS steps, state FROM r WHERE state IS NOT NULL""")
def r4_runs_in_flight(t: Tables) -> DataFrame:
    """Runs from signup to purchase over eight equal times of the log; twelve hours without an end lose a run."""
    at = _folder(t)
    events = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    slices = [F.floor((F.unix_micros("ts") - F.lit(first)) * 8 / (F.lit(last) - F.lit(first) + 1)) == k for k in range(8)]

    def follow(feed: DataFrame) -> StreamingQuery:
        runs = jobs.runs_in_flight(feed, "user_id", "ts", "event_id", "event_type", "signup", "purchase", "12 hours", "1 hour")
        return runs.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()

    _step_by_step(t, [events.where(which) for which in slices], f"{at}/in", follow)
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return t.spark.read.schema(f"user_id {dict(events.dtypes)['user_id']}, {jobs.RUNS}").parquet(f"{at}/out").select("user_id", when("started_at"), when("ended_at"), "steps", "state")


@query("SELECT DISTINCT account, order_id, line, strftime(placed_at, '%Y%m%d') AS day FROM {tickets} k WHERE status = 'filled'")
def r5_fill_dedup(t: Tables) -> DataFrame:
    """Fills of each year as a step, twice in it and as often in a step after it: each is announced once."""
    at = _folder(t)
    fills = t.tickets.where("status = 'filled'").select("account", "order_id", "line", F.col("placed_at").cast("timestamp").alias("placed_at"), F.date_format("placed_at", "yyyyMMdd").alias("day"))
    first, last = fills.agg(F.min(F.year("placed_at")), F.max(F.year("placed_at"))).first()
    years = [F.year("placed_at") == y for y in range(first or 0, (last or 0) + 1) for _ in range(2)]
    announce = lambda feed: jobs.announce_fills(feed, ["account", "order_id", "line", "day"], "placed_at", f"{at}/out", f"{at}/checkpoint")
    _step_by_step(t, [rows.unionByName(rows) for rows in (fills.where(which) for which in years)], f"{at}/in", announce)
    return t.spark.read.schema(fills.schema).parquet(f"{at}/out").select("account", "order_id", "line", "day")


@query("""SELECT user_id, event_id, CASE WHEN bad THEN 'alert' ELSE 'recovered' END AS event FROM (SELECT user_id, event_id, event_type = 'error' AS bad, coalesce(lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id), false) AS b FROM events) x WHERE bad <> b""")
def r6_health_transitions(t: Tables) -> DataFrame:
    return jobs.transitions(t.events.select("user_id", "event_id", (F.col("event_type") == "error").alias("bad")), "user_id", "event_id", "bad")


@query("""WITH n AS (SELECT dataset, sha256(count(*) || '|' || sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) || '|' || sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT))) AS r FROM (SELECT dataset, sha1(available_at || '|' || text_id || '|' || title) AS h FROM {texts} t WHERE available_at <= 520) x GROUP BY 1), o AS (SELECT dataset, sha256(count(*) || '|' || sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) || '|' || sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT))) AS r FROM (SELECT dataset, sha1(available_at || '|' || text_id || '|' || title) AS h FROM {texts} t WHERE available_at <= 515) x GROUP BY 1)
    SELECT n.dataset FROM n LEFT JOIN o USING (dataset) WHERE o.r IS NULL OR o.r <> n.r""")
def r7_event_gate(t: Tables) -> DataFrame:
    at = lambda when: text.evidence(t.texts.where(F.col("available_at") <= when), "dataset", ["available_at", "text_id"], ["title"])
    return jobs.event_gate(at(520), at(515), "dataset").select("dataset")


@query("SELECT event_type, strftime(CASE WHEN ts > date_trunc('minute', ts) THEN date_trunc('minute', ts) + INTERVAL 1 MINUTE ELSE ts END, '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS n FROM events GROUP BY 1, 2")
def r8_auction_arrival(t: Tables) -> DataFrame:
    out = jobs.arrival_minutes(t.events, "ts", ["event_type"])
    return out.select("event_type", F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "n")
