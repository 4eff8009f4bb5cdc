"""All queries of the engine, by name, with their SQL twins, bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import dicts, tagging, text
from eventloom.operators import aggregates, extract, filters, numbering, ranking, report, resolve, similarity, trending
from eventloom.operators.graph import connected_components
from eventloom.sources import feeds, store
from eventloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUOTA = "purchase"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """documents as items: the title is the first line, at most 80 characters; the summary is the whole text."""
    d = _table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80).alias("title"), F.col("text").alias("summary"), F.col("source").alias("source_name"), F.col("lang").alias("source_lang"), F.concat(F.lit("doc:"), "doc_id").alias("url"))


def doc_events(spark: SparkSession, sf: str) -> DataFrame:
    """documents as events: the title is the first line's first 80 characters, the source the only entity."""
    return items(spark, sf).select(F.col("seq").alias("id"), "title", F.array("source_name").alias("who"), F.col("summary").alias("text"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("category"), F.least(F.lit(10), 1 + F.floor(F.col("value") / 25)).cast("int").alias("importance"), F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("mention_count"), F.array(F.col("user_id").cast("string")).alias("who"), "user_id", "value")


def _stored_events(rows: DataFrame) -> DataFrame:
    """Events as documents of a store."""
    return rows.select(F.col("seq").cast("string").alias("event_id"), "seq", "date", "category", "importance", "mention_count", F.array("category").alias("tags"), (F.col("importance") >= 9).alias("is_top"))


ITEMS = "items AS (SELECT doc_id AS seq, substr(string_split(text, chr(10))[1], 1, 80) AS title, text AS summary, source AS source_name, lang AS source_lang FROM documents)"
EVENTS = "ev AS (SELECT event_id AS seq, CAST(ts AS DATE) AS date, event_type AS category, CAST(least(10, 1 + floor(value / 25)) AS INT) AS importance, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS mention_count, user_id, value FROM events)"
PUNCT = r"[，。、！？!?,.;:：；\"''`()【】\[\]｜\|—\-－‘’“”·…．　\s]+"
NORM = rf"regexp_replace(lower({{x}}), '{PUNCT}', '', 'g')"


def _norm_sql(x: str) -> str:
    return NORM.replace("{x}", f"regexp_replace({x}, '[''’][sS]\\b', '', 'g')")


# --- scans -----------------------------------------------------------------------------------


@query("list_dates", f"WITH {EVENTS} SELECT DISTINCT date FROM ev")
def list_dates(spark, sf):
    return events(spark, sf).select("date").distinct()


@query("range_scan", f"WITH {EVENTS} SELECT seq, date, category, importance, mention_count FROM ev WHERE date BETWEEN (SELECT max(date) - 6 FROM ev) AND (SELECT max(date) FROM ev)")
def range_scan(spark, sf):
    e = events(spark, sf)
    last = e.agg(F.max("date").alias("d")).first()["d"]
    return e.where(F.col("date").between(F.date_sub(F.lit(last), 6), F.lit(last))).select("seq", "date", "category", "importance", "mention_count")


@query("url_distinct_first", "SELECT min(page_id) AS page_id, url FROM pages WHERE url IS NOT NULL AND url <> '' GROUP BY url")
def url_distinct_first(spark, sf):
    return filters.first_of_each(_table(spark, sf, "pages").select("page_id", "url"), "url", "page_id")


@query("source_limit_then_filter", f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY seq) AS k FROM items) SELECT seq, source_name FROM r WHERE k <= CASE source_name WHEN 'src1' THEN 5 ELSE 50 END AND title <> '' AND length(summary) >= 400")
def source_limit_then_filter(spark, sf):
    rows = items(spark, sf).withColumn("url", F.lit("u"))
    kept = filters.limit_then_filter(rows, 50, None, {"src1": 5})
    return kept.where(F.length("summary") >= 400).select("seq", "source_name")


@query("key_last_wins", "SELECT o_custkey AS custkey, max(o_orderkey) AS orderkey, arg_max(o_totalprice, o_orderkey) AS totalprice FROM orders GROUP BY o_custkey")
def key_last_wins(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("totalprice"))
    return store.last_of_key(o, ["custkey"], "orderkey")


@query("missing_days", "WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 400000), s AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date) SELECT date FROM s WHERE date NOT IN (SELECT date FROM o)")
def missing_days(spark, sf):
    o = _table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_orderdate").cast("date").alias("date"))
    return store.missing_days(o, "1995-01-01", "2001-12-31")


@query("union_families", "SELECT 'customer' AS family, c_name AS name, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_name, NULL, p_brand FROM part")
def union_families(spark, sf):
    c = _table(spark, sf, "customer").select(F.lit("customer").alias("family"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    s = _table(spark, sf, "supplier").select(F.lit("supplier").alias("family"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    p = _table(spark, sf, "part").select(F.lit("part").alias("family"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return feeds.union_families([c, s, p])


# --- text functions --------------------------------------------------------------------------


@query("norm_title", f"WITH {ITEMS} SELECT seq, {_norm_sql('title')} AS norm FROM items")
def norm_title(spark, sf):
    return items(spark, sf).select("seq", text.norm_title("title").alias("norm"))


_STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '[\\s\\x{00a0}]+', ' ', 'g'))"


@query("strip_html_pages", f"SELECT page_id, {_STRIP.replace('{x}', 'html')} AS body FROM pages")
def strip_html_pages(spark, sf):
    return _table(spark, sf, "pages").select("page_id", text.strip_html("html").alias("body"))


@query("page_facts", f"SELECT page_id, {_STRIP.replace('{x}', chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))} AS title, {_STRIP.replace('{x}', chr(39).join(['regexp_extract(html, ', '(?is)<h1[^>]*>(.*?)</h1>', ', 1)']))} AS h1, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS BIGINT) AS n_links FROM pages")
def page_facts(spark, sf):
    return feeds.page_facts(_table(spark, sf, "pages"))


@query("char_shingles", f"WITH {ITEMS}, n AS (SELECT seq, {_norm_sql('title')} AS s FROM items), g AS (SELECT DISTINCT seq, CASE WHEN length(s) <= 4 THEN s ELSE substr(s, i, 4) END AS g FROM (SELECT seq, s, unnest(range(1, greatest(length(s) - 3, 1) + 1)) AS i FROM n WHERE s <> '')) SELECT seq, count(*) AS n, min(g) AS least FROM g GROUP BY seq")
def char_shingles(spark, sf):
    return items(spark, sf).select("seq", text.char_shingles("title").alias("g")).where(F.size("g") > 0).select("seq", F.size("g").cast("long").alias("n"), F.array_min("g").alias("least"))


_STOP = ", ".join(f"'{w}'" for w in dicts.STOPWORDS)


@query("word_set", f"WITH {ITEMS}, w AS (SELECT seq, unnest(string_split(trim(regexp_replace(regexp_replace(lower(title), '[''’]s\\b', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g')), ' ')) AS w FROM items), t AS (SELECT seq, w AS t FROM w WHERE regexp_full_match(w, '[\\x00-\\x7F]*') AND length(w) >= 3 AND w NOT IN ({_STOP}) UNION ALL SELECT seq, substr(w, i, 2) FROM (SELECT seq, w, unnest(range(1, length(w))) AS i FROM w WHERE NOT regexp_full_match(w, '[\\x00-\\x7F]*'))) SELECT seq, count(DISTINCT t) AS n, min(t) AS least FROM t GROUP BY seq")
def word_set(spark, sf):
    return items(spark, sf).select("seq", text.word_set("title").alias("g")).where(F.size("g") > 0).select("seq", F.size("g").cast("long").alias("n"), F.array_min("g").alias("least"))


@query("fingerprint_id", f"WITH {ITEMS} SELECT seq, substr(sha1(fp), 1, 10) AS event_id, fp FROM (SELECT seq, {_norm_sql('source_name')} || '+' || 'zz' || '|' || {_norm_sql('source_lang')} AS fp FROM items)")
def fingerprint_id(spark, sf):
    fp = text.fingerprint(F.array("source_name", F.lit("ZZ "), "source_name"), "source_lang")
    return items(spark, sf).select("seq", text.short_id(fp).alias("event_id"), fp.alias("fp"))


_WHEN_SQL = "CASE seq % 5 WHEN 0 THEN strftime(date, '%Y-%m-%d') WHEN 1 THEN strftime(date, '%Y') || '/' || month(date) || '/' || day(date) WHEN 2 THEN strftime(date, '%Y') || '年' || month(date) || '月' || day(date) || '日' WHEN 3 THEN 'Recently' ELSE strftime(date, '%Y') || '-13-' || day(date) END"


@query("fuzzy_when", f"WITH {EVENTS} SELECT seq, CASE WHEN seq % 5 < 3 THEN date END AS parsed FROM ev")
def fuzzy_when(spark, sf):
    e = events(spark, sf)
    y, m, d = F.year("date"), F.month("date"), F.day("date")
    k = F.col("seq") % 5
    free = F.when(k == 0, F.date_format("date", "yyyy-MM-dd")).when(k == 1, F.concat_ws("/", y, m, d)).when(k == 2, F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日"))).when(k == 3, "Recently").otherwise(F.concat_ws("-", y, F.lit("13"), d))
    return e.withColumn("when", free).select("seq", text.fuzzy_date("when").alias("parsed"))


@query("relative_time", f"WITH {EVENTS} SELECT seq, CAST(round(CASE seq % 6 WHEN 0 THEN mention_count / 24.0 WHEN 1 THEN mention_count WHEN 2 THEN mention_count * 7 WHEN 3 THEN 30 WHEN 4 THEN 0 ELSE 9999 END, 6) AS DOUBLE) AS days FROM ev")
def relative_time(spark, sf):
    k, n = F.col("seq") % 6, F.col("mention_count")
    s = F.when(k == 0, F.concat(F.lit("Updated "), n, F.lit(" hours ago"))).when(k == 1, F.concat(n, F.lit(" days ago"))).when(k == 2, F.concat(n, F.lit(" weeks ago"))).when(k == 3, "a month ago").when(k == 4, "just now").otherwise("long since")
    return events(spark, sf).select("seq", F.round(text.relative_days(s), 6).alias("days"))


@query("parse_count", f"WITH {EVENTS} SELECT seq, CAST(round(CASE seq % 3 WHEN 0 THEN (mention_count + 0.5) * 1000 WHEN 1 THEN (mention_count + 1) * 1000 + 234 ELSE mention_count * 1000000 END, 3) AS DOUBLE) AS n FROM ev")
def parse_count(spark, sf):
    k, n = F.col("seq") % 3, F.col("mention_count")
    s = F.when(k == 0, F.concat(n, F.lit(".5k"))).when(k == 1, F.concat(n + 1, F.lit(",234"))).otherwise(F.concat(n, F.lit(" M")))
    return events(spark, sf).select("seq", F.round(text.parse_count(s), 3).alias("n"))


def _tenths(unit: int, mark: str) -> str:
    f = f"(v / {unit}.0 - floor(v / {unit}.0))"
    t = f"CAST(floor(v / {unit}.0) * 10 + floor({f} * 10) + CASE WHEN {f} >= (floor({f} * 10) * 10 + 5) / 100 THEN 1 ELSE 0 END AS BIGINT)"
    return f"({t} // 10) || CASE WHEN {t} % 10 > 0 THEN '.' || ({t} % 10) ELSE '' END || '{mark}'"


@query("compact_number", f"SELECT o_orderkey, CASE WHEN v >= 1000000 THEN {_tenths(1000000, 'M')} WHEN v >= 1000 THEN {_tenths(1000, 'K')} ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS v FROM orders)")
def compact_number(spark, sf):
    return _table(spark, sf, "orders").select("o_orderkey", text.compact_number(F.floor("o_totalprice")).alias("shown"))


@query("entity_key", "SELECT c_custkey, regexp_replace(lower(trim(c_name)), '[\\s\"''()（）\\-_、,，。.]', '', 'g') AS key FROM customer")
def entity_key(spark, sf):
    return _table(spark, sf, "customer").select("c_custkey", text.entity_key("c_name").alias("key"))


@query("lead_paragraph", "SELECT doc_id, CASE WHEN t = '' THEN '' WHEN length(f) <= 320 THEN f WHEN stop > 161 THEN substr(f, 1, stop) ELSE substr(f, 1, 320) || '…' END AS lead FROM (SELECT *, coalesce(length(regexp_extract(substr(f, 1, 320), '(?s)^(.*[。．.])', 1)), 0) AS stop FROM (SELECT doc_id, trim(text) AS t, trim(string_split_regex(trim(text), '\\n+')[1]) AS f FROM documents))")
def lead_paragraph(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.lead_paragraph("text", F.lit("")).alias("lead"))


@query("content_blocks", "WITH l AS (SELECT doc_id, trim(unnest(string_split_regex(trim(text), '\\n+'))) AS x FROM documents) SELECT doc_id, count(*) AS blocks, count(*) FILTER (length(x) <= 34 AND NOT regexp_matches(x, '[。！？!?]$') AND NOT regexp_matches(x, '^https?:')) AS heads FROM l WHERE x <> '' GROUP BY doc_id")
def content_blocks(spark, sf):
    b = _table(spark, sf, "documents").select("doc_id", text.content_blocks("text", F.lit("")).alias("b")).where(F.size("b") > 0)
    return b.select("doc_id", F.size("b").cast("long").alias("blocks"), F.size(F.filter("b", lambda x: x["t"] == "h")).cast("long").alias("heads"))


@query("image_kind", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'png' END AS kind FROM documents")
def image_kind(spark, sf):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, F.unhex(F.lit("FFD8FFE000104A4649460001"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A0000000D"))).when(k == 2, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.encode(F.lit("plain text, no picture"), "utf-8"))
    return _table(spark, sf, "documents").select("doc_id", text.image_kind(head).alias("kind"))


# --- filters ---------------------------------------------------------------------------------

_AI, _SECURITY, _NOISE = ["GPU", "AI", "therein", "license"], ["password", "token", "AKIA"], ["worthless"]
_LONG = "therein|license|password|token|akia"
_FLAG = f"(NOT regexp_matches(c, 'worthless') AND (regexp_matches(c, '(^|[^A-Za-z])(GPU|AI)($|[^A-Za-z])') OR regexp_matches(lower(c), '{_LONG}')))"


@query("prefilter_keywords", f"WITH {ITEMS} SELECT seq FROM (SELECT seq, title || ' ' || summary AS c FROM items) WHERE {_FLAG}")
def prefilter_keywords(spark, sf):
    return filters.prefilter(items(spark, sf), ai=_AI, security=_SECURITY, noise=_NOISE).select("seq")


@query("prefilter_counts", f"WITH {ITEMS} SELECT source_name, count(*) AS n_in, count(*) FILTER ({_FLAG}) AS n_out, CAST(count(*) FILTER ({_FLAG}) * 100 // count(*) AS BIGINT) AS pct FROM (SELECT source_name, title || ' ' || summary AS c FROM items) GROUP BY source_name")
def prefilter_counts(spark, sf):
    return filters.prefilter_counts(items(spark, sf), ai=_AI, security=_SECURITY, noise=_NOISE)


_REASON = "CASE WHEN importance < 4 THEN 'importance' WHEN length(summary) < 40 THEN 'summary' WHEN w < DATE '2024-01-20' THEN 'stale' END"
_QUALITY = f"q AS (SELECT seq, category, importance, repeat('x', mention_count * 10) AS summary, CASE WHEN seq % 3 < 2 THEN date END AS w FROM ev)"


def _quality_rows(spark, sf):
    e = events(spark, sf)
    k = F.col("seq") % 3
    return e.withColumn("summary", F.expr("repeat('x', mention_count * 10)")).withColumn("when", F.when(k == 0, F.date_format("date", "yyyy-MM-dd")).when(k == 1, F.date_format("date", "yyyy/M/d")).otherwise("近期")).withColumn("reason", filters.quality_reason(F.lit("2024-01-27").cast("date"), 7))


@query("quality_filter", f"WITH {EVENTS}, {_QUALITY} SELECT seq, category FROM q WHERE {_REASON} IS NULL")
def quality_filter(spark, sf):
    return _quality_rows(spark, sf).where(F.col("reason").isNull()).select("seq", "category")


@query("drop_reasons", f"WITH {EVENTS}, {_QUALITY} SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM q GROUP BY 1")
def drop_reasons(spark, sf):
    return _quality_rows(spark, sf).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("interest_filter", f"WITH {EVENTS} SELECT seq, category FROM ev WHERE category IN ('click', 'purchase') OR category NOT IN ('click', 'purchase', 'signup', 'error')")
def interest_filter(spark, sf):
    return filters.interests(events(spark, sf), ["click", "purchase"], ["click", "purchase", "signup", "error"]).select("seq", "category")


@query("fulltext_audit", "SELECT source, count(*) AS docs, count(*) FILTER (length(trim(text)) >= 350 AND length(trim(text)) >= 2.5 * length(l) AND trim(text) <> l) AS good, count(*) FILTER (length(trim(text)) >= 80 AND length(trim(text)) >= 1.3 * length(l) AND trim(text) <> l) AS passable FROM (SELECT *, trim(string_split(text, chr(10))[1]) AS l FROM documents) GROUP BY source")
def fulltext_audit(spark, sf):
    d = _table(spark, sf, "documents").withColumn("lead", F.get(F.split("text", "\n"), F.lit(0)))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(text.good_fulltext("text", "lead")).alias("good"), F.count_if(text.good_fulltext("text", "lead", 80, 1.3)).alias("passable"))


# --- ranking ---------------------------------------------------------------------------------

_SCORED = f"{EVENTS}, m AS (SELECT *, max(date) OVER () AS nd, min(date) OVER () AS od FROM {{pool}}), r AS (SELECT *, CAST(importance AS DOUBLE) AS mi, log2(1 + CASE WHEN mention_count = 0 THEN 1 ELSE mention_count END) AS mm, greatest(0.0, 1 - date_diff('day', date, nd) / greatest(1, date_diff('day', od, nd))) AS mr FROM m), s AS (SELECT *, CASE WHEN max(mi) OVER () > 0 THEN mi / max(mi) OVER () ELSE 0 END AS pi, CASE WHEN max(mm) OVER () > 0 THEN mm / max(mm) OVER () ELSE 0 END AS pm, CASE WHEN max(mr) OVER () > 0 THEN mr / max(mr) OVER () ELSE 0 END AS pr FROM r)"


@query("score_metrics", f"WITH {_SCORED.replace('{pool}', 'ev')} SELECT seq, round(pi, 6) AS p_importance, round(pm, 6) AS p_mention, round(pr, 6) AS p_recency, round((pi + pm + pr) / 3, 6) AS total FROM s")
def score_metrics(spark, sf):
    s = ranking.score(events(spark, sf), ["importance", "mention", "recency"])
    return s.select("seq", *[F.round(c, 6).alias(c) for c in ("p_importance", "p_mention", "p_recency", "total")])


_WEEK = "(SELECT * FROM ev WHERE date >= (SELECT max(date) - 6 FROM ev))"
_PICKS = f"{_SCORED.replace('{pool}', _WEEK)}, o AS (SELECT *, (pi + pm) / 2 AS total FROM s), q AS (SELECT *, CASE WHEN category = '{QUOTA}' AND row_number() OVER (PARTITION BY category ORDER BY total DESC, importance DESC, mention_count DESC, seq) > 2 THEN 1 ELSE 0 END AS over_ FROM o), p AS (SELECT *, row_number() OVER (ORDER BY over_, total DESC, importance DESC, mention_count DESC, seq) AS pick FROM q)"


@query("ranked_picks_7d", f"WITH {_PICKS} SELECT CAST(pick AS INT) AS pick, seq, category, importance, mention_count, round(total, 6) AS total FROM p WHERE pick <= 6")
def ranked_picks_7d(spark, sf):
    e = events(spark, sf)
    last = e.agg(F.max("date").alias("d")).first()["d"]
    picks = ranking.ranked_picks(e.where(F.col("date") >= F.date_sub(F.lit(last), 6)), 6, category=QUOTA)
    return picks.select("pick", "seq", "category", "importance", "mention_count", F.round("total", 6).alias("total"))


@query("lead_promotion", f"WITH {_PICKS}, t AS (SELECT *, min(CASE WHEN seq % 2 = 0 THEN pick END) OVER () AS lead_ FROM p WHERE pick <= 6) SELECT CAST(row_number() OVER (ORDER BY CASE WHEN pick = lead_ THEN 0 ELSE 1 END, pick) AS INT) AS pick, seq FROM t")
def lead_promotion(spark, sf):
    return ranking.promote_lead(ranked_picks_7d(spark, sf), F.col("seq") % 2 == 0).select("pick", "seq")


_ORDER = "importance DESC, mention_count DESC, seq"


@query("quota_topk", f"WITH {EVENTS}, q AS (SELECT *, CASE WHEN category = '{QUOTA}' AND row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) > 2 THEN 1 ELSE 0 END AS o FROM ev) SELECT CAST(pick AS INT) AS pick, seq, category FROM (SELECT *, row_number() OVER (ORDER BY o, {_ORDER}) AS pick FROM q) WHERE pick <= 6")
def quota_topk(spark, sf):
    return ranking.quota_top(events(spark, sf), 6, 2, QUOTA).select("pick", "seq", "category")


@query("quota_topk_refill", f"WITH {EVENTS} SELECT CAST(pick AS INT) AS pick, seq FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS pick FROM ev WHERE category = '{QUOTA}') WHERE pick <= 6")
def quota_topk_refill(spark, sf):
    return ranking.quota_top(events(spark, sf).where(F.col("category") == QUOTA), 6, 2, QUOTA).select("pick", "seq")


@query("top_per_category", f"WITH {EVENTS} SELECT category, CAST(rn AS INT) AS rn, seq FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) AS rn FROM ev) WHERE rn <= 25")
def top_per_category(spark, sf):
    return ranking.top_per_category(events(spark, sf), 25).select("category", "rn", "seq")


@query("quota_zone_top8", f"WITH {EVENTS} SELECT seq, date FROM ev WHERE category = '{QUOTA}' ORDER BY importance DESC, mention_count DESC, date DESC, seq LIMIT 8")
def quota_zone_top8(spark, sf):
    e = events(spark, sf).where(F.col("category") == QUOTA)
    return e.orderBy(F.col("importance").desc(), F.col("mention_count").desc(), F.col("date").desc(), "seq").limit(8).select("seq", "date")


@query("page_n", f"WITH {EVENTS} SELECT seq FROM ev ORDER BY {_ORDER} LIMIT 20 OFFSET 40")
def page_n(spark, sf):
    return ranking.page(events(spark, sf), 3, 20, ranking.order_by_rank()).select("seq")


@query("report_pages", f"WITH {EVENTS}, c AS (SELECT *, CASE category WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS co FROM ev), n AS (SELECT *, row_number() OVER (ORDER BY co, {_ORDER}) AS n, row_number() OVER (PARTITION BY co ORDER BY {_ORDER}) AS rn FROM c), g AS (SELECT co, CAST(ceil(count(*) / 6.0) AS BIGINT) AS p FROM c GROUP BY co), b AS (SELECT co, coalesce(sum(p) OVER (ORDER BY co ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g) SELECT seq, n, rn, CAST(base + (rn - 1) // 6 + 1 AS BIGINT) AS page FROM n JOIN b USING (co)")
def report_pages(spark, sf):
    return report.report_pages(events(spark, sf), ["purchase", "signup", "error"]).select("seq", "n", "rn", "page")


@query("window_chunks", f"WITH {EVENTS}, n AS (SELECT seq, row_number() OVER (ORDER BY {_ORDER}) - 1 AS pos FROM ev) SELECT seq, CAST(unnest(range(CAST(greatest(0, ceil((pos - 44) / 35.0)) AS BIGINT), pos // 35 + 1)) AS INT) AS chunk FROM n")
def window_chunks(spark, sf):
    numbered = numbering.number_in_order(events(spark, sf).select("seq", "importance", "mention_count"), ranking.order_by_rank(), "n").withColumn("pos", F.col("n") - 1)
    return resolve.chunk_windows(numbered).select("seq", "chunk")


@query("edition_no", f"WITH {EVENTS} SELECT date, CAST(date_diff('day', (SELECT min(date) FROM ev), date) + 1 AS INT) AS edition FROM (SELECT DISTINCT date FROM ev)")
def edition_no(spark, sf):
    days = events(spark, sf).select("date").distinct()
    return ranking.totals(days, {"_first": F.min("date")}).select("date", (F.datediff("date", "_first") + 1).alias("edition"))


# --- aggregates ------------------------------------------------------------------------------


@query("top_entities", f"WITH {EVENTS} SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS events FROM ev WHERE length(CAST(user_id AS VARCHAR)) >= 2 GROUP BY 1 ORDER BY events DESC, key LIMIT 10")
def top_entities(spark, sf):
    return aggregates.top_entities(events(spark, sf)).select("key", "events")


@query("category_share", f"WITH {EVENTS} SELECT category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ev), 6) AS pct FROM ev GROUP BY category")
def category_share(spark, sf):
    return aggregates.category_share(events(spark, sf))


@query("headline_metrics", f"WITH {EVENTS} SELECT count(*) AS total, count(DISTINCT category) AS categories, CAST(date_diff('day', min(date), max(date)) + 1 AS INT) AS days FROM ev")
def headline_metrics(spark, sf):
    return aggregates.headline(events(spark, sf))


_TAGGED = "tg AS (SELECT *, list_filter(['ai_agent', CASE WHEN mention_count % 2 = 0 THEN 'hbm' END, CASE WHEN mention_count % 3 = 0 THEN 'unknown' END, CASE WHEN importance >= 8 THEN 'zeroday' END], lambda x: x IS NOT NULL) AS raw FROM ev), tags AS (SELECT DISTINCT seq, date, importance, mention_count, CASE t WHEN 'hbm' THEN 'memory_hbm' WHEN 'zeroday' THEN 'zero_day' ELSE t END AS tag FROM (SELECT *, unnest(raw) AS t FROM tg) WHERE t <> 'unknown')"


def _tagged(spark, sf):
    n = F.col("mention_count")
    raw = F.filter(F.array(F.lit("AI-Agent"), F.when(n % 2 == 0, "hbm"), F.when(n % 3 == 0, "unknown"), F.when(F.col("importance") >= 8, "zeroday")), lambda x: x.isNotNull())
    return events(spark, sf).withColumn("tags", tagging.normalize_tags(raw))


@query("normalize_tags", f"WITH {EVENTS}, {_TAGGED} SELECT seq, string_agg(tag, ',' ORDER BY CASE tag WHEN 'ai_agent' THEN 1 WHEN 'memory_hbm' THEN 2 ELSE 3 END) AS tags FROM tags GROUP BY seq")
def normalize_tags(spark, sf):
    return _tagged(spark, sf).select("seq", F.array_join("tags", ",").alias("tags"))


@query("tag_stats", f"WITH {EVENTS}, {_TAGGED} SELECT tag, count(*) AS events, CAST(sum(mention_count) AS BIGINT) AS mentions, count(*) FILTER (importance >= 8) AS high FROM tags GROUP BY tag")
def tag_stats(spark, sf):
    return tagging.tag_stats(_tagged(spark, sf), [])


@query("merge_tags", f"WITH {EVENTS}, {_TAGGED}, c AS (SELECT date, tag, count(*) AS n FROM tags GROUP BY date, tag) SELECT date, string_agg(tag, ',' ORDER BY n DESC, o) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, o) AS k FROM (SELECT c.*, CASE tag WHEN 'ai_agent' THEN 1 WHEN 'memory_hbm' THEN 2 ELSE 3 END AS o FROM c)) WHERE k <= 3 GROUP BY date")
def merge_tags(spark, sf):
    """The aggregate form: counts by tag first, so that no task holds a day's events; ties by dictionary order."""
    t = _tagged(spark, sf).select("date", F.explode("tags").alias("tag")).groupBy("date", "tag").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(x) for x in ("ai_agent", "memory_hbm", "zero_day")]), F.col("tag"))
    top = t.withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.col("n").desc(), place))).where("k <= 3")
    return top.groupBy("date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tag"))), lambda s: s["tag"]), ",").alias("tags"))


@query("daily_summary", f"WITH {EVENTS}, {_TAGGED}, a AS (SELECT date, count(*) AS total_db, count(*) FILTER (importance >= 9) AS total_top FROM ev GROUP BY date), c AS (SELECT date, string_agg(category || '=' || n, ';' ORDER BY category) AS by_category FROM (SELECT date, category, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY date), t AS (SELECT date, string_agg(tag || '=' || n, ';' ORDER BY tag) AS by_tag FROM (SELECT date, tag, count(*) AS n FROM tags GROUP BY 1, 2) GROUP BY date) SELECT date, total_db, total_top, by_category, by_tag, 'v1' AS tags_version FROM a JOIN c USING (date) JOIN t USING (date)")
def daily_summary(spark, sf):
    s = aggregates.daily_summary(_tagged(spark, sf).withColumn("is_top", F.col("importance") >= 9))
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return s.select("date", "total_db", "total_top", flat("by_category").alias("by_category"), flat("by_tag").alias("by_tag"), "tags_version")


@query("is_top_flag", f"WITH {EVENTS}, t AS (SELECT seq FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) AS rn FROM ev) WHERE rn <= 25) SELECT seq, seq IN (SELECT seq FROM t) AS is_top FROM ev")
def is_top_flag(spark, sf):
    e = events(spark, sf)
    top = ranking.top_per_category(e, 25).select("seq", F.lit(True).alias("_t"))
    return e.join(top, "seq", "left").select("seq", F.coalesce("_t", F.lit(False)).alias("is_top"))


@query("event_key_cluster", f"WITH {ITEMS}, k AS (SELECT *, lower(source_name) || '|' || source_lang AS ek FROM items) SELECT min(seq) AS head_seq, count(*) AS n, min(source_name) AS sources FROM k GROUP BY ek")
def event_key_cluster(spark, sf):
    rows = items(spark, sf).withColumn("event_key", F.concat(F.upper("source_name"), F.lit(" ｜  "), "source_lang")).withColumn("importance", F.lit(5))
    return aggregates.event_key_clusters(rows).select("head_seq", "n", "sources")


@query("tag_compare_pr", "SELECT 'long' AS tag, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, round(count(*) FILTER (p AND t) / nullif(count(*) FILTER (p), 0), 6) AS precision, round(count(*) FILTER (p AND t) / nullif(count(*) FILTER (t), 0), 6) AS recall FROM (SELECT length(text) >= 1000 AS p, quality = 1 AS t FROM documents JOIN labels USING (doc_id))")
def tag_compare_pr(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", (F.length("text") >= 1000).alias("predicted"))
    rows = d.join(_table(spark, sf, "labels"), "doc_id").select(F.lit("long").alias("tag"), "predicted", (F.col("quality") == 1).alias("truth"))
    return aggregates.agreement(rows)


@query("tag_report", f"WITH {EVENTS}, {_TAGGED} SELECT k AS n_tags, count(*) AS events FROM (SELECT seq, count(*) AS k FROM tags GROUP BY seq) GROUP BY k")
def tag_report(spark, sf):
    return _tagged(spark, sf).groupBy(F.size("tags").cast("long").alias("n_tags")).agg(F.count(F.lit(1)).alias("events"))


_RULES = [("security", ["password", r"\btoken\b", "akia[0-9a-z]+"], ["worthless"]), ("license", ["licen[cs]e", "general public"], []), ("contact", ["example\\.com", r"\+1 \("], [])]


def _rules_sql() -> str:
    parts = []
    for pos, (tag, patterns, excludes) in enumerate(_RULES):
        score = " + ".join(f"CASE WHEN regexp_matches(title, '(?i){p}') THEN 2 WHEN regexp_matches(summary, '(?i){p}') THEN 1 ELSE 0 END" for p in patterns)
        if excludes:
            score = f"CASE WHEN regexp_matches(title || ' ' || summary, '(?i){excludes[0]}') THEN 0 ELSE {score} END"
        parts.append(f"SELECT seq, '{tag}' AS tag, {pos} AS pos, {score} AS s FROM items")
    return f"WITH {ITEMS}, r AS ({' UNION ALL '.join(parts)}) SELECT seq, string_agg(tag, ',' ORDER BY s DESC, pos) AS tags FROM r WHERE s >= 2 GROUP BY seq"


@query("rule_tags", _rules_sql())
def rule_tags(spark, sf):
    return items(spark, sf).select("seq", tagging.rule_tags(F.col("title"), F.col("summary"), _RULES).alias("t")).where(F.size("t") > 0).select("seq", F.array_join("t", ",").alias("tags"))


# --- similarity and resolution ----------------------------------------------------------------

_SETS = f"{ITEMS}, n AS (SELECT seq, {_norm_sql('title')} AS s FROM items), g AS (SELECT DISTINCT seq, CASE WHEN length(s) <= 4 THEN s ELSE substr(s, i, 4) END AS g FROM (SELECT seq, s, unnest(range(1, greatest(length(s) - 3, 1) + 1)) AS i FROM n WHERE s <> '')), k AS (SELECT seq, string_agg(g, chr(1) ORDER BY g) AS key, count(*) AS n FROM g GROUP BY seq), h AS (SELECT key, min(seq) AS rep, any_value(n) AS n, count(*) AS m FROM k GROUP BY key), hg AS (SELECT rep, n, m, g FROM h JOIN g ON g.seq = h.rep), p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, count(*) AS c FROM hg a JOIN hg b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL), l AS (SELECT a, b, ma, mb, c / (na + nb - c) AS sim FROM p WHERE c / (na + nb - c) >= 0.55)"


@query("shingle_pairs", f"WITH {_SETS} SELECT a, b, round(sim, 6) AS sim FROM l")
def shingle_pairs(spark, sf):
    rows = items(spark, sf).select(F.col("seq").alias("id"), "title")
    members = similarity.representatives(rows, text.char_shingles("title")).where(F.col("id") == F.col("rep"))
    return similarity.set_join(members.select("id", "tokens"), 0.55).select("a", "b", F.round("sim", 6).alias("sim"))


@query("shingle_dups", f"WITH RECURSIVE {_SETS}, e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l), r(x, y) AS (SELECT rep, rep FROM h UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), cc AS (SELECT x AS rep, min(y) AS class_id FROM r GROUP BY x), w AS (SELECT a AS rep, mb AS w FROM l UNION ALL SELECT b, ma FROM l), ws AS (SELECT rep, sum(w) AS w FROM w GROUP BY rep) SELECT seq AS id, class_id, CAST(m - 1 + coalesce(w, 0) AS BIGINT) AS n_links FROM k JOIN h USING (key) JOIN cc USING (rep) LEFT JOIN ws USING (rep)")
def shingle_dups(spark, sf):
    rows = items(spark, sf).select(F.col("seq").alias("id"), "title")
    return similarity.duplicate_classes(rows, text.char_shingles("title"), 0.55)


@query("cluster_merge", f"WITH RECURSIVE {_SETS}, e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l), r(x, y) AS (SELECT rep, rep FROM h UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), cc AS (SELECT x AS rep, min(y) AS cluster FROM r GROUP BY x), j AS (SELECT cluster, items.* FROM k JOIN h USING (key) JOIN cc USING (rep) JOIN items USING (seq)) SELECT cluster, min(seq) AS seq, count(*) AS mention_count, arg_max(title, struct_pack(n := length(title), s := -seq)) AS title, CAST(max(length(summary)) AS INT) AS longest FROM j GROUP BY cluster")
def cluster_merge(spark, sf):
    rows = items(spark, sf)
    classes = shingle_dups(spark, sf).select(F.col("id").alias("seq"), F.col("class_id").alias("cluster"))
    full = rows.withColumn("importance", F.lit(5)).withColumn("who", F.array("source_name")).withColumn("tags", F.array().cast("array<string>"))
    return resolve.merge_clusters(full, classes).select("cluster", "seq", "mention_count", "title", F.length("summary").alias("longest"))


_TREND = """t AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity, o_orderpriority AS source, CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq FROM orders
), mx AS (SELECT max(date) AS d FROM t), today AS (SELECT d - 29 AS d FROM mx), cur AS (
  SELECT t.* FROM t, today WHERE date >= d
), past AS (
  SELECT DISTINCT entity, source, date FROM t, today WHERE date >= d - 730 AND date < d
), hits AS (
  SELECT past.* FROM past, today WHERE date >= d - 365 AND length(entity) >= 3 AND entity IN (SELECT entity FROM cur) AND entity NOT IN (SELECT entity FROM past, today WHERE date < d - 365)
)"""


def _orders_by_day(spark, sf):
    """Orders as history (entity, source, date, seq), and the present day."""
    o = _table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("seq"))
    return o, o.agg(F.date_sub(F.max("date"), 29).alias("d")).first()["d"]


def _trend(spark, sf):
    o, today = _orders_by_day(spark, sf)
    now = o.where(F.col("date") >= F.lit(today)).select("seq", F.lit(8).alias("importance"), F.array("entity").alias("who"), F.array("source").alias("sources"))
    return now, trending.recent_hits(trending.named_entities(now), o, today, 365, 730)


@query(
    "trending_entities",
    f"""WITH {_TREND}, seen AS (
  SELECT entity, source, date FROM hits UNION ALL
  SELECT entity, source, d FROM cur, today WHERE length(entity) >= 3 AND entity NOT IN (SELECT entity FROM past, today WHERE date < d - 365)
) SELECT entity, count(DISTINCT source) AS sources, count(DISTINCT date) AS days FROM seen GROUP BY entity""",
)
def trending_entities(spark, sf):
    """Entities new against the baseline, with the recent and the current mentions."""
    o, today = _orders_by_day(spark, sf)
    now, hits = _trend(spark, sf)
    return trending.trending_entities(trending.with_current(hits, now, o, today, 365, 730))


@query(
    "trending_boost",
    f"""WITH {_TREND}, s AS (
  SELECT c.seq, c.entity, h.source FROM cur c JOIN hits h ON h.entity = c.entity UNION SELECT c.seq, c.entity, c.source FROM cur c WHERE c.entity IN (SELECT entity FROM hits)
), f AS (
  SELECT seq, count(DISTINCT source) AS sources, (SELECT count(DISTINCT date) + 1 FROM hits h WHERE h.entity = any_value(s.entity)) AS days FROM s GROUP BY seq
) SELECT cur.seq, CAST(CASE WHEN sources >= 3 AND days >= 2 THEN 9 ELSE 8 END AS INT) AS importance, CASE WHEN sources >= 3 AND days >= 2 THEN entity END AS trend,
  CASE WHEN sources >= 3 AND days >= 2 THEN sources END AS sources, CASE WHEN sources >= 3 AND days >= 2 THEN days END AS days FROM cur LEFT JOIN f ON f.seq = cur.seq""",
)
def trending_boost(spark, sf):
    """Every event with its own sources beside its entity's."""
    return trending.boost(*_trend(spark, sf)).select("seq", "importance", F.col("trending.entity").alias("trend"), "trending.sources", "trending.days")


@query("extract_events", f"WITH {ITEMS} SELECT seq, substr(trim(title), 1, 80) AS title, 'uncategorized' AS category, 5 AS importance FROM items WHERE trim(title) <> '' AND trim(summary) <> ''")
def extract_events(spark, sf):
    raw = extract.extract_events(items(spark, sf))
    return extract.normalize_events(raw).select("seq", "title", "category", "importance")


# --- streams ---------------------------------------------------------------------------------


def _stream(spark, sf):
    schema = _table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


@query("stream_daily_counts", "SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf):
    return streams.collect_available(spark, streams.daily_counts(_stream(spark, sf)), "stream-counts", "complete")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    found = streams.first_seen(_stream(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"], late="3650 days")
    return streams.collect_available(spark, found.select("user_id", "event_type"), "stream-dedup", "append")


from eventloom.plans import models, parts, resolution  # noqa: E402,F401  add their queries
