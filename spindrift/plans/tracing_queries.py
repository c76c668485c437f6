"""Queries of knowledge tracing, over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracing
from .registry import example, inline, query, table

AS_OF = "2030-01-01 00:00:00"

EVENTS_SQL = """
ev AS (
  SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kp,
    CASE event_type WHEN 'click' THEN 'qa_high_confidence' WHEN 'view' THEN 'qa_low_confidence' WHEN 'purchase' THEN 'quiz_correct' WHEN 'signup' THEN 'grading_pass' ELSE 'quiz_wrong' END AS event_type,
    least(2.0::DOUBLE, 1.0::DOUBLE + 0.3::DOUBLE * (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4)) AS difficulty, least(1.0::DOUBLE, value / 100) AS outcome
  FROM events
), dl AS (
  SELECT *, CASE event_type WHEN 'qa_high_confidence' THEN 0.06::DOUBLE * difficulty * greatest(outcome, 0.3::DOUBLE) WHEN 'quiz_correct' THEN 0.1::DOUBLE * difficulty * greatest(outcome, 0.3::DOUBLE)
    WHEN 'grading_pass' THEN 0.05::DOUBLE * difficulty * greatest(outcome, 0.3::DOUBLE) WHEN 'quiz_wrong' THEN -0.06::DOUBLE * (1.0::DOUBLE / difficulty) * outcome ELSE 0.0 END AS delta FROM ev
)"""

HISTORY_SQL = f"""
{EVENTS_SQL}, o AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, kp ORDER BY ts, event_id) AS seq FROM dl
), h AS (
  SELECT user_id, kp, seq, ts, event_id, event_type, greatest(0.0, least(1.0, delta)) AS mastery, CASE WHEN delta >= 0 THEN 1 ELSE 0 END AS p, CASE WHEN delta >= 0 THEN 0 ELSE 1 END AS n, delta AS change,
    CASE WHEN delta >= 0 THEN wl(1, 0) ELSE wl(0, 1) END AS confidence
  FROM o WHERE seq = 1
  UNION ALL
  SELECT o.user_id, o.kp, o.seq, o.ts, o.event_id, o.event_type,
    greatest(0.0, least(1.0, dm(h.mastery, h.confidence, (epoch_us(o.ts) - epoch_us(h.ts)) / 3.6e9) + o.delta)),
    h.p + CASE WHEN o.delta >= 0 THEN 1 ELSE 0 END, h.n + CASE WHEN o.delta >= 0 THEN 0 ELSE 1 END,
    greatest(0.0, least(1.0, dm(h.mastery, h.confidence, (epoch_us(o.ts) - epoch_us(h.ts)) / 3.6e9) + o.delta)) - h.mastery,
    wl(h.p + CASE WHEN o.delta >= 0 THEN 1 ELSE 0 END, h.n + CASE WHEN o.delta >= 0 THEN 0 ELSE 1 END)
  FROM h JOIN o ON o.user_id = h.user_id AND o.kp = h.kp AND o.seq = h.seq + 1
)"""


def _expanded(sql: str) -> str:
    """Write out the helpers wl(p, n) (Wilson bound) and dm(m, c, hours) (decayed mastery)."""

    def args(at: int) -> tuple[list[str], int]:
        depth, start, found = 1, at, []
        while depth:
            c = sql[at]
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or not depth:
                found.append(sql[start:at].strip())
                start = at + 1
            at += 1
        return found, at

    for name in ("wl(", "dm("):
        while name in sql:
            at = sql.index(name)
            found, end = args(at + len(name))
            if name == "wl(":
                p, t = f"(({found[0]})::DOUBLE / ({found[0]} + {found[1]}))", f"({found[0]} + {found[1]})::DOUBLE"
                out = f"greatest(0.0, least(1.0, ({p} + 3.8416 / (2 * {t}) - 1.96 * sqrt(({p} * (1 - {p}) + 3.8416 / (4 * {t})) / {t})) / (1 + 3.8416 / {t})))"
            else:
                m, c, hours = found
                out = f"CASE WHEN {hours} < 24 THEN {m} ELSE {m} * exp(-({hours}) / (72 * (1 + {c} * 4))) END"
            sql = sql[:at] + out + sql[end:]
    return sql


STATES_SQL = f"""
{HISTORY_SQL}, st AS (
  SELECT user_id, kp, max_by(mastery, seq) AS mastery, max_by(confidence, seq) AS confidence, max(seq) AS interactions, max_by(ts, seq) AS last_at, max_by(event_type, seq) AS event_type FROM h GROUP BY ALL
), eff AS (
  SELECT *, dm(mastery, confidence, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_at)) / 3.6e9) AS em FROM st
), es AS (SELECT *, em * confidence AS score, CASE kp % 4 WHEN 0 THEN 'data_structure' WHEN 1 THEN 'computer_organization' WHEN 2 THEN 'operating_system' ELSE 'computer_network' END AS category FROM eff)"""


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    mapped = F.when(kind == "click", "qa_high_confidence").when(kind == "view", "qa_low_confidence").when(kind == "purchase", "quiz_correct").when(kind == "signup", "grading_pass").otherwise("quiz_wrong")
    kp = F.get_json_object("props", "$.k").cast("long")
    rows = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", kp.alias("kp"), mapped.alias("event_type"), F.least(F.lit(2.0), 1.0 + 0.3 * (kp % 4)).alias("difficulty"), F.least(F.lit(1.0), F.col("value") / 100).alias("outcome"))
    return rows.withColumn("delta", tracing.event_delta(F.col("event_type"), F.col("difficulty"), F.col("outcome")))


def _category(kp):
    return F.when(kp % 4 == 0, "data_structure").when(kp % 4 == 1, "computer_organization").when(kp % 4 == 2, "operating_system").otherwise("computer_network")


def _registry(spark, sf_dir):
    kp = _events(spark, sf_dir).select("kp").distinct()
    return kp.select("kp", F.concat(F.lit("point "), F.col("kp")).alias("name"), _category(F.col("kp")).alias("category"), F.floor(F.col("kp") / 10).alias("chapter"))


def _effective(spark, sf_dir):
    rows = tracing.states(tracing.history(_events(spark, sf_dir)))
    return tracing.effective(rows, F.lit(AS_OF).cast("timestamp")).withColumn("category", _category(F.col("kp")))


@query(f"WITH {EVENTS_SQL} SELECT event_id, user_id, kp, event_type, round(difficulty, 9) AS difficulty, round(outcome, 9) AS outcome, round(delta, 9) AS delta FROM dl")
def tracking_deltas(spark, sf_dir):
    r = _events(spark, sf_dir)
    return r.select("event_id", "user_id", "kp", "event_type", *(F.round(c, 9).alias(c) for c in ("difficulty", "outcome", "delta")))


@query(_expanded(f"WITH RECURSIVE {HISTORY_SQL} SELECT user_id, kp, seq, event_id, event_type, round(mastery, 9) AS mastery, round(confidence, 6) AS confidence, CAST(p AS BIGINT) AS positive, CAST(n AS BIGINT) AS negative, round(change, 9) AS delta, round(mastery * confidence, 9) AS effective_score FROM h"))
def mastery_history(spark, sf_dir):
    r = tracing.history(_events(spark, sf_dir))
    return r.select("user_id", "kp", "seq", "event_id", "event_type", F.round("mastery", 9).alias("mastery"), F.round("confidence", 6).alias("confidence"), "positive", "negative", F.round("delta", 9).alias("delta"), F.round("effective_score", 9).alias("effective_score"))


@query(_expanded(f"WITH RECURSIVE {STATES_SQL} SELECT user_id, kp, round(mastery, 9) AS mastery, round(confidence, 6) AS confidence, interactions, round(em, 9) AS effective_mastery, round(score, 9) AS effective_score FROM es"))
def mastery_fold(spark, sf_dir):
    r = _effective(spark, sf_dir)
    return r.select("user_id", "kp", F.round("mastery", 9).alias("mastery"), F.round("confidence", 6).alias("confidence"), "interactions", F.round("effective_mastery", 9).alias("effective_mastery"), F.round("effective_score", 9).alias("effective_score"))


@query(_expanded(f"""
WITH RECURSIVE {STATES_SQL}, reg AS (SELECT category, count(*) AS registered FROM (SELECT DISTINCT kp, category FROM es) GROUP BY 1),
core AS (SELECT * FROM (VALUES ('data_structure', 57), ('computer_organization', 40), ('operating_system', 45), ('computer_network', 42)) t(category, fallback)),
g AS (SELECT user_id, category, count(*) AS tracked, count(*) FILTER (WHERE score >= 0.6) AS mastered, count(*) FILTER (WHERE score < 0.3) AS weak, round(avg(em), 3) AS avg_mastery, round(avg(score), 3) AS avg_score FROM es GROUP BY ALL)
SELECT u.user_id, c.category, coalesce(tracked, 0) AS tracked, coalesce(mastered, 0) AS mastered, coalesce(weak, 0) AS weak, coalesce(avg_mastery, 0) AS avg_mastery, coalesce(avg_score, 0) AS avg_score, CAST(coalesce(registered, fallback) AS BIGINT) AS total
FROM (SELECT DISTINCT user_id FROM es) u CROSS JOIN core c LEFT JOIN g ON g.user_id = u.user_id AND g.category = c.category LEFT JOIN reg ON reg.category = c.category
"""))
def student_profile(spark, sf_dir):
    return tracing.profile(_effective(spark, sf_dir), _registry(spark, sf_dir), tracing.CORE)


@query(_expanded(f"""
WITH RECURSIVE {STATES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, kp) AS rank FROM es WHERE score < 0.3)
SELECT user_id, kp, 'point ' || kp AS name, category, round(score, 3) AS effective_score, interactions, rank FROM r WHERE rank <= 10
"""))
def weak_points(spark, sf_dir):
    rows = tracing.weak_points(_effective(spark, sf_dir).drop("category"), _registry(spark, sf_dir))
    return rows.select("user_id", "kp", "name", "category", F.round("effective_score", 3).alias("effective_score"), "interactions", "rank")


@query(_expanded(f"""
WITH RECURSIVE {STATES_SQL}, reg AS (SELECT DISTINCT kp, category, kp // 10 AS chapter FROM es WHERE kp % 4 = 1)
SELECT u.user_id, reg.chapter, count(*) AS points, count(es.kp) AS tracked, round(avg(coalesce(round(em, 3), 0)), 3) AS avg_mastery
FROM (SELECT DISTINCT user_id FROM es) u CROSS JOIN reg LEFT JOIN es ON es.user_id = u.user_id AND es.kp = reg.kp GROUP BY ALL
"""))
def category_detail(spark, sf_dir):
    e = _effective(spark, sf_dir).select("user_id", "kp", "effective_mastery")
    reg = _registry(spark, sf_dir).filter("category = 'computer_organization'")
    # users meet the category's chapters, which the result lists, not its points
    chapters = reg.groupBy("chapter").agg(F.count("*").alias("points"))
    known = e.join(reg.select("kp", "chapter"), "kp").groupBy("user_id", "chapter").agg(F.count("*").alias("tracked"), F.sum(F.round("effective_mastery", 3)).alias("total"))
    rows = e.select("user_id").distinct().crossJoin(F.broadcast(chapters)).join(known, ["user_id", "chapter"], "left")
    return rows.select("user_id", "chapter", "points", F.coalesce("tracked", F.lit(0)).alias("tracked"), F.round(F.coalesce("total", F.lit(0.0)) / F.col("points"), 3).alias("avg_mastery"))


@query(_expanded(f"""
WITH RECURSIVE {STATES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, kp) AS rank, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_at)) / 3.6e9 AS hours FROM es)
SELECT user_id, kp, rank, CASE WHEN hours * 60 < 1 THEN '刚刚' WHEN hours < 1 THEN CAST(floor(hours * 60) AS BIGINT) || '分钟前' WHEN hours < 24 THEN CAST(floor(hours) AS BIGINT) || '小时前' ELSE CAST(floor(hours / 24) AS BIGINT) || '天前' END AS time_ago FROM r WHERE rank <= 5
"""))
def recent_interactions(spark, sf_dir):
    from ..operators.search import top_k

    rows = top_k(_effective(spark, sf_dir), ["user_id"], [F.desc("last_interaction_at"), F.asc("kp")], 5)
    return rows.select("user_id", "kp", F.col("rank").cast("long").alias("rank"), tracing.time_ago(tracing.hours_between(F.col("last_interaction_at"), F.lit(AS_OF))).alias("time_ago"))


@query(_expanded(f"""
WITH RECURSIVE {HISTORY_SQL} SELECT user_id, CAST(ts AS DATE) AS day, round(avg(mastery) + 1e-9, 3) AS avg_mastery, round(avg(mastery * confidence) + 1e-9, 3) AS avg_effective_score, count(*) AS event_count, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types FROM h GROUP BY ALL
"""))
def mastery_trend_daily(spark, sf_dir):
    return tracing.daily_trend(tracing.history(_events(spark, sf_dir)))


@query(_expanded(f"""
WITH RECURSIVE {HISTORY_SQL} SELECT user_id, kp, seq, round(mastery, 3) AS mastery, round(confidence, 3) AS confidence, round(mastery * confidence, 3) AS effective_score, event_type FROM h WHERE kp = 7
"""))
def mastery_trend_single(spark, sf_dir):
    r = tracing.history(_events(spark, sf_dir).filter("kp = 7"))
    return r.select("user_id", "kp", "seq", *(F.round(c, 3).alias(c) for c in ("mastery", "confidence", "effective_score")), "event_type")


GRADES = "(1, '评分：45/100 难度：综合'), (2, '评分: 92 / 100'), (3, '没有分数'), (4, '评分：80/100 难度：创新')"


@example("""
SELECT * FROM (VALUES (1, 'grading_fail', 0.45::DOUBLE, 1.6::DOUBLE), (2, 'grading_excellent', 0.92::DOUBLE, 1.3::DOUBLE), (3, 'grading_pass', 0.5::DOUBLE, 1.3::DOUBLE), (4, 'grading_excellent', 0.8::DOUBLE, 2.0::DOUBLE)) t(id, event_type, outcome, difficulty)
""")
def grading_events(spark, sf_dir):
    kind, outcome, difficulty = tracing.grading_event(F.col("answer"))
    return inline(spark, GRADES, "id, answer").select("id", kind.alias("event_type"), outcome.alias("outcome"), difficulty.alias("difficulty"))


@example("""
WITH t(p, n) AS (VALUES (0, 0), (1, 0), (0, 1), (5, 5), (50, 3), (1000, 10))
SELECT p, n, round(CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, (p / (p + n)::DOUBLE + 3.8416 / (2.0 * (p + n)) - 1.96 * sqrt((p / (p + n)::DOUBLE * (1 - p / (p + n)::DOUBLE) + 3.8416 / (4.0 * (p + n))) / (p + n))) / (1 + 3.8416 / (p + n)::DOUBLE))) END, 6) AS bound FROM t
""")
def wilson_bound(spark, sf_dir):
    return inline(spark, "(0, 0), (1, 0), (0, 1), (5, 5), (50, 3), (1000, 10)", "p, n").select("p", "n", F.round(tracing.wilson(F.col("p"), F.col("n")), 6).alias("bound"))
