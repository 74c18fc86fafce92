"""Facts, grounding, routing, reports, flattening and scene pairing over orders, documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.expr import rounded
from tidemark.operators import facts, spatial
from tidemark.session import table


def fact_table(spark, sf):
    """Named figures with two decimals, in the order in which they were registered."""
    l, o, c, e = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "events"))
    s = l.agg(F.count("*").cast("double").alias("n_lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), (F.count_if(F.col("l_returnflag") == "R") * 100.0 / F.count("*")).alias("returned_pct"))
    s = s.crossJoin(o.agg(F.count("*").cast("double").alias("n_orders"))).crossJoin(c.agg(F.count("*").cast("double").alias("n_customers"))).crossJoin(e.agg(F.countDistinct("user_id").cast("double").alias("n_users")))  # one row each
    rows = [(1, " n-lines ", "n_lines", "lines"), (2, "total quantity", "quantity", "pieces"), (3, "returned-pct", "returned_pct", "percent"), (4, "n orders", "n_orders", "orders"), (5, "n_customers", "n_customers", "customers"), (6, "n_users", "n_users", "users")]
    return s.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), facts.normal_id(F.lit(n)).alias("fact_id"), rounded(F.col(v), 2).alias("value_num"), F.lit(u).alias("unit")) for i, n, v, u in rows])))


def fact_digest(spark, sf):
    return facts.digest(fact_table(spark, sf))


def _texts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "About 1002 orders of 9999 and १५००० more, 12 days; see `x 77` and DEM-30 at 2,5 km"), (-2, "क्षेत्रमा ९९९९ वटा"), (-3, "No figures.")], "doc_id long, text string")
    return d.unionByName(more)


def number_grounding(spark, sf):
    return facts.grounded(_texts(spark, sf), fact_table(spark, sf)).select("doc_id", "total", "verified", "violations", "score")


def grounding_summary(spark, sf):
    return number_grounding(spark, sf).agg(F.count("*").alias("texts"), F.sum("total").alias("numbers"), F.sum("violations").alias("violations"), rounded(F.avg("score"), 4).alias("mean_score"))


QUESTIONS = [(1, "How many deaths in Rasuwa?"), (2, "Give me a situation overview"), (3, "Which bridge is damaged?"), (4, "Isolated buildings list"), (5, "कति जना घाइते भए?"), (6, "पुल र सडक"), (7, "Will rain continue tomorrow?"), (8, "river depth near the bridge"), (9, "hello")]


def language_router(spark, sf):
    q = spark.createDataFrame(QUESTIONS, "id long, query string").unionByName(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query")))
    refused, topic = facts.route(F.coalesce("query", F.lit("")))
    return q.groupBy(facts.language(F.coalesce("query", F.lit(""))).alias("language"), refused.alias("refused"), topic.alias("topic")).agg(F.count("*").alias("n"))


def answer_template(spark, sf):
    """A brief from the facts, with defaults where one is missing."""
    f = fact_table(spark, sf).groupBy().pivot("fact_id", ["N_ORDERS", "N_CUSTOMERS", "N_MISSING"]).agg(F.first("value_num"))
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("long")
    return f.select(F.format_string("Brief: %d orders of %d customers; %d open.", v("N_ORDERS"), v("N_CUSTOMERS"), v("N_MISSING")).alias("en"), F.format_string("संक्षेप: %d / %d / %d", v("N_ORDERS"), v("N_CUSTOMERS"), v("N_MISSING")).alias("ne"))


def markdown_table(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey")
    return facts.markdown_table(n, ["Region", "Nation", "Key"], ["n_nationkey"])


def eval_harness_rollup(spark, sf):
    """Every turn asked in two languages; success is a refusal exactly where one is due and no ungrounded number."""
    c = table(spark, sf, "conversations")
    x = c.select("role", "turn", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(F.lit("en"), F.lit("ne"))).alias("lang"))
    refused, _ = facts.route(F.col("text"))
    ok = (refused.isNotNull() == (F.col("turn") % 97 == 0)) & (F.col("lang") == "en") | (F.col("lang") == "ne")
    r = x.withColumn("ok", ok).rollup("role", "lang").agg(F.count("*").alias("n"), rounded(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"))
    return r.select(F.coalesce("role", F.lit("all")).alias("role"), F.coalesce("lang", F.lit("all")).alias("lang"), "n", "accuracy")


def json_flatten(spark, sf):
    e = table(spark, sf, "events")
    k = F.from_json("props", "k int")["k"]
    return e.groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


EVENT = "2024-01-15"


def scene_pairing(spark, sf):
    """For each orbit (user) the first scene after the event and up to three before it, spaced by ten days."""
    e = table(spark, sf, "events").where("event_type = 'view'")
    at = F.lit(EVENT).cast("timestamp")
    post = e.where(F.col("ts") >= at).groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("post"))
    pre = e.where((F.col("ts") < at) & (F.col("ts") >= F.lit("2023-11-16").cast("timestamp"))).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id")), asc=False).alias("l"))  # an orbit's scenes in the lookback
    chosen = pre.select("user_id", spatial.spaced_selection(F.col("l"), at.cast(e.schema["ts"].dataType)).alias("s"))
    return post.join(chosen, "user_id").select("user_id", F.col("post.event_id").alias("post_event"), F.array_join(F.transform("s", lambda x: x["event_id"].cast("string")), ",").alias("pre_events"), F.size("s").alias("n_pre"))


def best_orbit(spark, sf):
    s = scene_pairing(spark, sf)
    return s.agg(F.max_by(F.struct("user_id", "n_pre"), F.struct("n_pre", -F.col("user_id"))).alias("b")).select("b.user_id", "b.n_pre")


QUERIES = {f.__name__: f for f in (fact_table, fact_digest, number_grounding, grounding_summary, language_router, answer_template, markdown_table, eval_harness_rollup, json_flatten, scene_pairing, best_orbit)}

_R = "floor(({0}) * 1e{1} + 0.5) / 1e{1}"
_FACTS = f"""f(ord, fact_id, value_num, unit) AS (SELECT 1, 'N_LINES', {_R.format('count(*)::DOUBLE', 2)}, 'lines' FROM lineitem UNION ALL SELECT 2, 'TOTAL_QUANTITY', {_R.format('sum(l_quantity::DECIMAL(18,2))::DOUBLE', 2)}, 'pieces' FROM lineitem
UNION ALL SELECT 3, 'RETURNED_PCT', {_R.format("count(*) FILTER (WHERE l_returnflag = 'R') * 100.0::DOUBLE / count(*)", 2)}, 'percent' FROM lineitem UNION ALL SELECT 4, 'N_ORDERS', {_R.format('count(*)::DOUBLE', 2)}, 'orders' FROM orders
UNION ALL SELECT 5, 'N_CUSTOMERS', {_R.format('count(*)::DOUBLE', 2)}, 'customers' FROM customer UNION ALL SELECT 6, 'N_USERS', {_R.format('count(DISTINCT user_id)::DOUBLE', 2)}, 'users' FROM events)"""
_PLAIN = "translate(text, '०१२३४५६७८९', '0123456789')"
for _p, _q in (("[^\\x00-\\x7F]", "_"), ("`[^`]*`", " "), ("\\b[A-Za-z]+[0-9]+[A-Za-z0-9]*\\b", " "), ("\\b[A-Za-z]+-[0-9]+\\b", " "), ("\\b[A-Za-z]+-[A-Za-z]+\\b", " ")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_p}', '{_q}', 'g')"
_GROUND = f"""{_FACTS}, t AS (SELECT doc_id, text FROM documents UNION ALL VALUES (-1, 'About 1002 orders of 9999 and १५००० more, 12 days; see `x 77` and DEM-30 at 2,5 km'), (-2, 'क्षेत्रमा ९९९९ वटा'), (-3, 'No figures.')),
n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all({_PLAIN}, '({facts.NUMBER})', 1), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL) AS ns FROM t),
u AS (SELECT doc_id, unnest(ns) AS v FROM n), g AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM (SELECT unnest({facts.CONSTANTS}::DOUBLE[]) AS c) WHERE abs(abs(v) - c) < 1e-4) OR EXISTS (SELECT 1 FROM f WHERE (value_num = 0 AND v = 0) OR (value_num <> 0 AND abs(v - value_num) <= abs(value_num) * 0.03))) AS verified FROM u GROUP BY 1),
r AS (SELECT n.doc_id, coalesce(total, 0)::INTEGER AS total, coalesce(verified, 0)::INTEGER AS verified, (coalesce(total, 0) - coalesce(verified, 0))::INTEGER AS violations, CASE WHEN total > 0 THEN {_R.format('verified::DOUBLE / total', 4)} ELSE 1.0 END AS score FROM n LEFT JOIN g USING (doc_id))"""


def _cases(words: dict[str, list[str]], otherwise: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in words.items()) + f" ELSE {otherwise} END"


_ROUTE = f"CASE WHEN refused IS NOT NULL THEN 'refused' ELSE {_cases(facts.TOPICS, chr(39) + 'brief' + chr(39))} END"
_SCENES = f"""v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), po AS (SELECT user_id, min_by(event_id, ts) AS post_event FROM v WHERE ts >= TIMESTAMP '{EVENT}' GROUP BY 1),
c AS (SELECT * FROM v WHERE ts < TIMESTAMP '{EVENT}' AND ts >= TIMESTAMP '2023-11-16'),
s1 AS (SELECT user_id, max(ts) AS t FROM c WHERE floor((epoch_us(TIMESTAMP '{EVENT}') - epoch_us(ts)) / 86400000000) >= 10 GROUP BY 1),
s2 AS (SELECT c.user_id, max(ts) AS t FROM c JOIN s1 USING (user_id) WHERE floor((epoch_us(s1.t) - epoch_us(ts)) / 86400000000) >= 10 GROUP BY 1),
s3 AS (SELECT c.user_id, max(ts) AS t FROM c JOIN s2 USING (user_id) WHERE floor((epoch_us(s2.t) - epoch_us(ts)) / 86400000000) >= 10 GROUP BY 1),
k AS (SELECT c.*, c.ts IN (s1.t, coalesce(s2.t, s1.t), coalesce(s3.t, s1.t)) AS sp FROM c LEFT JOIN s1 USING (user_id) LEFT JOIN s2 USING (user_id) LEFT JOIN s3 USING (user_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(sp, false) DESC, ts DESC) AS rn FROM k),
sc AS (SELECT user_id, post_event, string_agg(event_id::VARCHAR, ',' ORDER BY rn) AS pre_events, count(*)::INTEGER AS n_pre FROM o JOIN po USING (user_id) WHERE rn <= 3 GROUP BY 1, 2)"""
SQL = {
    "fact_table": f"WITH {_FACTS} SELECT * FROM f",
    "fact_digest": f"WITH {_FACTS} SELECT sha256('{{' || string_agg('\"' || fact_id || '\": ' || regexp_replace(value_num::DECIMAL(20,2)::VARCHAR, '0$', ''), ', ' ORDER BY fact_id) || '}}') AS digest FROM f",
    "number_grounding": f"WITH {_GROUND} SELECT * FROM r",
    "grounding_summary": f"WITH {_GROUND} SELECT count(*) AS texts, sum(total)::BIGINT AS numbers, sum(violations)::BIGINT AS violations, {_R.format('avg(score)', 4)} AS mean_score FROM r",
    "language_router": f"WITH x(id, query) AS (SELECT doc_id, text FROM documents UNION ALL VALUES {', '.join(str(q) for q in QUESTIONS)}), y AS (SELECT *, lower(coalesce(query, '')) AS q FROM x), z AS (SELECT *, {_cases(facts.REFUSALS, 'NULL')} AS refused FROM y) SELECT CASE WHEN regexp_matches(coalesce(query, ''), '[\\x{{0900}}-\\x{{097F}}]') THEN 'ne' ELSE 'en' END AS language, refused, {_ROUTE} AS topic, count(*) AS n FROM z GROUP BY 1, 2, 3",
    "answer_template": f"WITH {_FACTS}, p AS (SELECT coalesce(max(value_num) FILTER (WHERE fact_id = 'N_ORDERS'), 0)::BIGINT AS o, coalesce(max(value_num) FILTER (WHERE fact_id = 'N_CUSTOMERS'), 0)::BIGINT AS c FROM f) SELECT printf('Brief: %d orders of %d customers; %d open.', o, c, 0) AS en, printf('संक्षेप: %d / %d / %d', o, c, 0) AS ne FROM p",
    "markdown_table": "SELECT '| Region | Nation | Key |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey",
    "eval_harness_rollup": f"WITH y AS (SELECT role, turn, lower(coalesce(text, '')) AS q FROM conversations), z AS (SELECT *, {_cases(facts.REFUSALS, 'NULL')} AS refused FROM y), l AS (SELECT z.*, unnest(['en', 'ne']) AS lang FROM z), k AS (SELECT *, lang = 'ne' OR ((refused IS NOT NULL) = (turn % 97 = 0)) AS ok FROM l) SELECT coalesce(role, 'all') AS role, coalesce(lang, 'all') AS lang, count(*) AS n, {_R.format('avg(ok::INTEGER::DOUBLE)', 6)} AS accuracy FROM k GROUP BY ROLLUP (role, lang)",
    "json_flatten": "SELECT event_type, (json_extract(props, '$.k')::INTEGER % 10)::INTEGER AS bucket, count(*) AS n, sum(json_extract(props, '$.k')::INTEGER)::BIGINT AS total FROM events GROUP BY 1, 2",
    "scene_pairing": f"WITH {_SCENES} SELECT * FROM sc",
    "best_orbit": f"WITH {_SCENES} SELECT user_id, n_pre FROM sc ORDER BY n_pre DESC, user_id LIMIT 1",
}
