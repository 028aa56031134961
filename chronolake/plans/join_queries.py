"""Queries of joins and of the text library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import candidates, joins, text
from .registry import Tables, query


@query("""SELECT b.month, b.code, b.close, c.close AS close_basic, c.pb, l.up, (b.n < 15) AS is_suspended FROM {bars} b LEFT JOIN {cross_section} c USING (month, code)
    LEFT JOIN (SELECT month, code, low * 1.1 AS up FROM {bars} x WHERE n % 2 = 0) l USING (month, code)""")
def j1_daily_join(t: Tables) -> DataFrame:
    b = t.bars
    out = joins.daily_join(b.select("month", "code", "close"), t.cross_section.select("month", "code", "close", "pb"), b.where("n % 2 = 0").select("month", "code", (F.col("low") * 1.1).alias("up")), None, b.where("n < 15"), ["month", "code"])
    return out.select("month", "code", "close", "close_basic", "pb", "up", "is_suspended")


@query("SELECT code, name, n_name AS industry FROM {universe} u LEFT JOIN nation ON industry = n_nationkey WHERE list_day <= 1200 AND (delist_day IS NULL OR 1200 < delist_day)")
def j2_universe_as_of(t: Tables) -> DataFrame:
    u = joins.listed_on(t.universe, "code", "list_day", "delist_day", F.lit(1200))
    return u.join(F.broadcast(t.nation), F.col("industry") == F.col("n_nationkey"), "left").select("code", "name", F.col("n_name").alias("industry"))


@query("SELECT c.code, c.close, p.size FROM (SELECT code, close FROM {cross_section} x WHERE month = (SELECT max(month) FROM {cross_section} y WHERE month <= 199812)) c LEFT JOIN (SELECT p_brand AS code, max(p_size) AS size FROM part GROUP BY 1) p USING (code)")
def j3_latest_basic_join(t: Tables) -> DataFrame:
    xs = t.cross_section.where("month <= 199812")
    last = xs.agg(F.max("month").alias("month"))
    return xs.join(F.broadcast(last), "month", "left_semi").select("code", "close").join(t.part.groupBy(F.col("p_brand").alias("code")).agg(F.max("p_size").alias("size")), "code", "left")


@query("SELECT code, arg_max(o_orderkey, (ann_date, o_orderkey)) AS o_orderkey FROM {statements} s WHERE ann_date <= '19980401' GROUP BY code")
def j3b_names_as_of(t: Tables) -> DataFrame:
    return joins.latest_as_of(t.statements, ["code"], "ann_date", F.lit("19980401"), ["o_orderkey"]).select("code", "o_orderkey")


@query("SELECT industry, max(list_day) AS list_day, count(*) AS n FROM {universe} u WHERE list_day <= 900 AND (delist_day IS NULL OR 900 < delist_day) GROUP BY industry")
def j3c_industry_as_of(t: Tables) -> DataFrame:
    return joins.listed_on(t.universe, "code", "list_day", "delist_day", F.lit(900)).groupBy("industry").agg(F.max("list_day").alias("list_day"), F.count("*").alias("n"))


@query("SELECT s.o_orderkey, j.joined FROM {statements} s LEFT JOIN (SELECT code, period, max(ann_date) AS joined FROM {statements} x WHERE kind = 'F' GROUP BY 1, 2) j USING (code, period)")
def j4_statement_availability(t: Tables) -> DataFrame:
    late = t.statements.where("kind = 'F'").groupBy("code", "period").agg(F.max("ann_date").alias("joined"))
    return t.statements.join(late, ["code", "period"], "left").select("o_orderkey", "joined")


@query("SELECT dataset, count(*) AS n, min(text_id) AS least FROM {texts} t WHERE available_at <= 500 AND regexp_matches(body, '(?i)lic[eh]') GROUP BY dataset")
def j6_body_semi_join(t: Tables) -> DataFrame:
    index, bodies = t.texts.select("text_id", "dataset", "available_at").where("available_at <= 500"), t.texts.select("text_id", "body")
    hit = bodies.join(index.select("text_id"), "text_id", "left_semi").where(F.col("body").rlike("(?i)lic[eh]"))
    return index.join(hit.select("text_id"), "text_id", "left_semi").groupBy("dataset").agg(F.count("*").alias("n"), F.min("text_id").alias("least"))


@query("""SELECT id, CASE WHEN o.part IS NULL THEN 'added' WHEN n.part IS NULL THEN 'removed' WHEN o.price IS DISTINCT FROM n.price OR o.prio IS DISTINCT FROM n.prio THEN 'changed' ELSE 'same' END AS change,
    CASE WHEN o.part IS NULL OR n.part IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.price IS DISTINCT FROM n.price THEN 'price' END, CASE WHEN o.prio IS DISTINCT FROM n.prio THEN 'prio' END) END AS columns FROM {old_part} o FULL JOIN {new_part} n USING (id)""")
def j7_keyed_diff(t: Tables) -> DataFrame:
    return joins.keyed_diff(t.old_part, t.new_part, ["id"], ["price", "prio"]).select("id", "change", F.array_join("columns", ",").alias("columns"))


@query("""SELECT coalesce(o.part, n.part) AS part, count(*) FILTER (n.id IS NULL) AS left_only, count(*) FILTER (o.id IS NULL) AS right_only, count(*) FILTER (o.id IS NOT NULL AND n.id IS NOT NULL) AS matched
    FROM {old_part} o FULL JOIN {new_part} n ON o.id = n.id AND o.part = n.part GROUP BY 1""")
def j8_coverage_diff(t: Tables) -> DataFrame:
    return joins.coverage_diff(t.old_part, t.new_part, "part", "id")


@query("""WITH e AS (SELECT DISTINCT month, p_brand AS code FROM {monthly} m, (SELECT DISTINCT p_brand FROM part) p), h AS (SELECT DISTINCT month, code FROM {holdings} h WHERE side = 'short')
    SELECT month, code, 'missing' AS state FROM (SELECT * FROM e EXCEPT SELECT * FROM h) UNION ALL SELECT month, code, 'unexpected' FROM (SELECT * FROM h EXCEPT SELECT * FROM e)""")
def j9_expected_vs_present(t: Tables) -> DataFrame:
    expected = t.monthly.select("month").distinct().join(F.broadcast(t.part.select(F.col("p_brand").alias("code")).distinct()))
    return joins.expected_vs_present(expected, t.holdings.where("side = 'short'"), ["month", "code"])


@query("""SELECT a.trade_date, a.ts_code, round(a.vol / m.vol, 6) AS raw_ratio FROM (SELECT trade_date, ts_code, sum(vol) AS vol FROM {ticks} t WHERE trade_time = '09:30' GROUP BY 1, 2) a
    JOIN (SELECT trade_date, ts_code, sum(vol) AS vol FROM {ticks} t GROUP BY 1, 2) m USING (trade_date, ts_code)""")
def j10_auction_alignment(t: Tables) -> DataFrame:
    day = t.ticks.groupBy("trade_date", "ts_code").agg(F.sum("vol").alias("day_vol"), F.sum(F.when(F.col("trade_time") == "09:30", F.col("vol"))).alias("vol"))
    return day.where("vol is not null").select("trade_date", "ts_code", F.round(F.try_divide("vol", "day_vol"), 6).alias("raw_ratio"))


@query("""WITH d AS (SELECT trade_date, ts_code, min(price) AS open, max(price) AS close, sum(vol) AS vol FROM {ticks} t GROUP BY 1, 2), m AS (SELECT trade_date, ts_code, trade_time, price, vol FROM {ticks} t WHERE l_linenumber % 2 = 0)
    SELECT trade_date, ts_code, trade_time, price, vol, false AS synthetic FROM m UNION ALL SELECT trade_date, ts_code, '09:30', open, NULL, true FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.trade_date = d.trade_date AND m.ts_code = d.ts_code AND trade_time = '09:30')
    UNION ALL SELECT trade_date, ts_code, '15:00', close, vol, true FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.trade_date = d.trade_date AND m.ts_code = d.ts_code AND trade_time = '15:00')""")
def j11_daily_fallback(t: Tables) -> DataFrame:
    daily = t.ticks.groupBy("trade_date", "ts_code").agg(F.min("price").alias("open"), F.max("price").alias("close"), F.sum("vol").alias("vol"))
    return joins.daily_fallback(daily, t.ticks.where("l_linenumber % 2 = 0"))


@query("SELECT h.account, h.month, h.code, h.side, c.pb, coalesce(p.kind, 'unclassified') AS kind FROM {holdings} h JOIN {cross_section} c USING (month, code) LEFT JOIN (SELECT p_brand AS code, min(p_type) AS kind FROM part GROUP BY 1) p USING (code)")
def j12_position_style_join(t: Tables) -> DataFrame:
    kinds = t.part.groupBy(F.col("p_brand").alias("code")).agg(F.min("p_type").alias("kind"))
    out = t.holdings.join(t.cross_section, ["month", "code"]).join(kinds, "code", "left")
    return out.select("account", "month", "code", "side", "pb", F.coalesce("kind", F.lit("unclassified")).alias("kind"))


@query("SELECT account, month, m.value AS strategy, i.value AS benchmark FROM {monthly} m JOIN {index_monthly} i USING (month)")
def j13_benchmark_match(t: Tables) -> DataFrame:
    return t.monthly.withColumnRenamed("value", "strategy").join(t.index_monthly.withColumnRenamed("value", "benchmark"), "month").select("account", "month", "strategy", "benchmark")


@query("""SELECT account, month, code, side, round(CASE WHEN side = 'long' THEN quantity * cash * 0.9 ELSE -quantity * cash END, 6) AS paid, CAST(floor(quantity * ratio) AS BIGINT) AS bonus, round((price - cash) / (1 + ratio), 8) AS rebased
    FROM {holdings} h JOIN (SELECT month, code, close AS price, 0.5 AS cash, 0.25 AS ratio FROM {bars} b WHERE n % 5 = 0) a USING (month, code)""")
def j14_dividend_entitlement(t: Tables) -> DataFrame:
    actions = t.bars.where("n % 5 = 0").select("month", "code", F.col("close").alias("price"), F.lit(0.5).alias("cash"), F.lit(0.25).alias("ratio"))
    out = joins.entitlement(t.holdings, actions, ["month", "code"])
    return out.select("account", "month", "code", "side", F.round("paid", 6).alias("paid"), "bonus", F.round("rebased", 8).alias("rebased"))


@query("SELECT order_id, line, code, CASE WHEN code IN (SELECT concat('P', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size < 20) THEN 'allowed' ELSE 'refused' END AS gate FROM {tickets} k WHERE action = 'cash'")
def j15_shortable_gate(t: Tables) -> DataFrame:
    orders, allowed = t.tickets.where("action = 'cash'"), t.part.where("p_size < 20").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"))
    gate = lambda how, name: orders.join(allowed, "code", how).select("order_id", "line", "code", F.lit(name).alias("gate"))
    return gate("left_semi", "allowed").unionByName(gate("left_anti", "refused"))


@query("""SELECT code, CAST(year AS BIGINT) AS year FROM (SELECT code, unnest(generate_series(greatest(year(a), 1996), least(coalesce(year(b), 2000), 2000))) AS year FROM
    (SELECT code, DATE '1995-01-01' + list_day AS a, DATE '1995-01-01' + delist_day AS b FROM {universe} u) x)""")
def j16_active_year_windows(t: Tables) -> DataFrame:
    u = t.universe.select("code", F.date_add(F.lit("1995-01-01").cast("date"), F.col("list_day")).alias("a"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("delist_day")).alias("b"))
    return joins.active_years(u, "a", "b", 1996, 2000).select("code", F.col("year").cast("long").alias("year"))


@query("""WITH c AS (SELECT DISTINCT code, unnest([code, split_part(code, '.', 1), first_word, last_word, trim(beginning)]) AS term FROM {companies} p)
    SELECT DISTINCT c.code, t.text_id FROM {coded_texts} t JOIN c ON t.ts_code = c.code OR contains(lower(t.title), lower(c.term))""")
def j17_candidate_rows(t: Tables) -> DataFrame:
    """All companies' candidate texts at once, over an inverted table of title grams."""
    own = t.companies.groupBy("code").agg(F.flatten(F.collect_set(F.array("first_word", "last_word", "beginning"))).alias("terms"))
    return candidates.candidate_rows(t.coded_texts, own)


@query("""SELECT u.code, u.name, x.items FROM {universe} u LEFT JOIN (SELECT code, list_aggregate(list_slice(list_reverse_sort(list(amount)), 1, 5), 'string_agg', ',') AS items, period FROM (SELECT code, period, CAST(CAST(floor(amount) AS BIGINT) AS BIGINT) AS amount FROM {statements} s) y
    WHERE (code, period) IN (SELECT code, max(period) FROM {statements} z GROUP BY code) GROUP BY code, period) x ON u.code = x.code""")
def j18_company_context(t: Tables) -> DataFrame:
    newest = t.statements.withColumn("_last", F.max("period").over(W.partitionBy("code"))).where("period = _last")
    top = newest.withColumn("_r", F.row_number().over(W.partitionBy("code").orderBy(F.col("amount").desc(), "o_orderkey"))).where("_r <= 5")
    items = top.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.floor("amount").cast("string").alias("a")))), lambda s: s["a"]), ",").alias("items"))
    return t.universe.select("code", "name").join(items, "code", "left")


@query("SELECT DISTINCT cust FROM (SELECT cust FROM {old_part} o WHERE part = 1 UNION ALL SELECT cust FROM {new_part} n WHERE part = 2 UNION ALL SELECT code FROM {statements} s WHERE period = 199705 UNION ALL SELECT code FROM {universe} u WHERE regexp_matches(name, '7$')) x")
def j19_rescue_candidates(t: Tables) -> DataFrame:
    parts = [t.old_part.where("part = 1").select("cust"), t.new_part.where("part = 2").select("cust"), t.statements.where("period = 199705").select(F.col("code").alias("cust")), t.universe.where(F.col("name").rlike("7$")).select(F.col("code").alias("cust"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@query("SELECT DISTINCT code FROM {statements} s WHERE ann_date BETWEEN '19970301' AND '19970310' OR CAST(period AS VARCHAR) || '15' BETWEEN '19970301' AND '19970310'")
def j20_affected_codes(t: Tables) -> DataFrame:
    inside = lambda c: c.between("19970301", "19970310")
    return t.statements.where(inside(F.col("ann_date")) | inside(F.concat(F.col("period").cast("string"), F.lit("15")))).select("code").distinct()


@query("""WITH o AS (SELECT o_orderkey AS order_id, concat('Brand#', CAST(o_orderkey % 25 + 1 AS VARCHAR)) AS code, CASE WHEN o_orderkey % 2 = 0 THEN 'entry' ELSE 'exit' END AS action, year(o_orderdate) * 100 + month(o_orderdate) AS active_ts, CAST(o_totalprice / 200 AS DOUBLE) AS lim FROM orders),
    m AS (SELECT order_id, month, CASE WHEN action = 'entry' THEN least(open, lim) ELSE greatest(open, lim) END AS price FROM o JOIN {bars} b USING (code) WHERE month >= active_ts AND CASE WHEN action = 'entry' THEN low < lim OR open <= lim ELSE high > lim OR open >= lim END)
    SELECT order_id, min(month) AS filled_at, arg_min(price, month) AS fill_price FROM m GROUP BY order_id""")
def j21_first_touch_fill(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 25 + 1).cast("string")).alias("code"), F.when(F.col("o_orderkey") % 2 == 0, "entry").otherwise("exit").alias("action"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("active_ts"), (F.col("o_totalprice") / 200).alias("limit"))
    return joins.first_touch(orders, t.bars.withColumnRenamed("month", "bar_ts"), ["code"], block=lambda month: F.floor(month / 100))


@query("SELECT p.event_id, arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS o_orderkey FROM events p JOIN orders o ON o.o_custkey = p.user_id AND o.o_orderdate <= p.ts GROUP BY p.event_id")
def as_of_join(t: Tables) -> DataFrame:
    right = t.orders.groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return joins.as_of(t.events, right, "user_id", "ts", "o_orderdate", ["o_orderkey"], block=lambda t: F.year(t) * 12 + F.month(t)).where("o_orderkey is not null").select("event_id", "o_orderkey")


@query("SELECT text_id, CASE WHEN trim(title) <> '' THEN title ELSE body END AS title, substr(CASE WHEN trim(title) <> '' THEN title || chr(10) ELSE '' END || CASE WHEN trim(body) <> '' THEN body || chr(10) ELSE '' END || lang, 1, 2000) AS body FROM {texts} t")
def text_fields(t: Tables) -> DataFrame:
    return text.text_fields(t.texts.withColumnRenamed("body", "full"), ["title", "full"], ["title", "full", "lang"], 2000).select("text_id", "title", "body")


@query("SELECT text_id AS id, sha1(dataset || '|' || available_at || '|' || substr(title, 1, 200) || '|' || r) AS text_id, sha1(body) AS source_hash FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY available_at, text_id) AS r FROM {texts} t) x")
def text_id(t: Tables) -> DataFrame:
    placed = t.texts.withColumn("r", F.row_number().over(W.partitionBy("dataset").orderBy("available_at", "text_id")))
    return placed.select(F.col("text_id").alias("id"), text.text_id("dataset", "available_at", "title", "r").alias("text_id"), F.sha1("body").alias("source_hash"))


@query("SELECT o_orderkey, sha256('{\"code\":' || code || ',\"period\":' || period || ',\"kind\":\"' || kind || '\"}') AS business_key FROM {statements} s")
def business_key(t: Tables) -> DataFrame:
    return t.statements.select("o_orderkey", F.sha2(F.to_json(F.struct("code", "period", "kind")), 256).alias("business_key"))


@query("SELECT text_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?i)bearer\\s+[a-z0-9._~+/-]{{8,}}', 'Bearer [REDACTED]', 'g'), '(?i)\\b(api[_-]?key|token|secret|password)\\b(\\s*[=:]\\s*)\\S+', '\\1\\2[REDACTED]', 'g'), '\\b(sk|ghp|AKIA)[-_A-Za-z0-9]{{12,}}', '[REDACTED]', 'g'), '(https?://)[^\\s/:@]+:[^\\s/@]+@', '\\1[REDACTED]@', 'g') AS body FROM {texts} t".replace("{{", "{").replace("}}", "}"))
def redact_secrets(t: Tables) -> DataFrame:
    return t.texts.select("text_id", text.redact(F.col("body")).alias("body"))


@query("""SELECT text_id, dataset, rank FROM (SELECT text_id, dataset, available_at, CASE WHEN regexp_matches(title, '(?i)th[ae]t') THEN CASE WHEN code = 7 THEN 40 ELSE 20 END ELSE CASE WHEN code = 7 THEN 30 ELSE 10 END END AS rank FROM {texts} t
    WHERE available_at <= 600 AND (regexp_matches(title, '(?i)th[ae]t') OR regexp_matches(body, '(?i)th[ae]t'))) x ORDER BY rank DESC, available_at DESC, text_id LIMIT 50""")
def c6_text_search(t: Tables) -> DataFrame:
    return text.search(t.texts.drop("body"), t.texts, "th[ae]t", F.col("code") == 7, F.lit(600), 50).select("text_id", "dataset", "rank")


@query("SELECT dataset, count(*) AS n, sha256(count(*) || '|' || sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) || '|' || sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT))) AS revision FROM (SELECT dataset, sha1(available_at || '|' || text_id || '|' || title) AS h FROM {texts} t WHERE available_at <= 500) x GROUP BY dataset")
def a30_evidence_revision(t: Tables) -> DataFrame:
    return text.evidence(t.texts.where("available_at <= 500"), "dataset", ["available_at", "text_id"], ["title"])


@query("SELECT account, sha256(count(*) || '|' || sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) || '|' || sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT))) AS signature FROM (SELECT account, sha1(order_id || '|' || line || '|' || code || '|' || action || '|' || shares) AS h FROM {tickets} k) x GROUP BY account")
def a31_order_signature(t: Tables) -> DataFrame:
    return text.evidence(t.tickets, "account", ["order_id", "line"], ["code", "action", "shares"]).select("account", F.col("revision").alias("signature"))


@query("SELECT code, arg_max(name, (start_date, name)) AS name FROM {name_changes} n WHERE start_date <= '19960630' AND (ann_date IS NULL OR trim(ann_date) <= '19960630') GROUP BY code")
def j3b_names_in_force(t: Tables) -> DataFrame:
    return joins.names_as_of(t.name_changes, "code", "name", F.lit("19960630"))


@query("SELECT code, arg_max(industry, (coalesce(in_date, ''), industry)) AS industry FROM {name_changes} n WHERE coalesce(in_date, '') <= '19960630' AND (out_date IS NULL OR out_date = 'None' OR out_date > '19960630') GROUP BY code")
def j3c_industry_in_force(t: Tables) -> DataFrame:
    return joins.members_as_of(t.name_changes, "code", "industry", F.lit("19960630"))
