"""One query for each group of operators, over adapted base tables, and independent SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels as K
from .functions import prompts as N
from .functions import text as T
from .operators import audit as A
from .operators import calibration as C
from .operators import groups as G
from .operators import paired as P
from .operators import splits as S
from .sources import adapters as D
from .sources import contracts as V
from .sources.scratch import importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

R = f"r AS ({D.duck(D.ROLLOUTS)})"
TOK, SAM = f"t AS ({D.duck(D.TOKENS)})", f"s AS ({D.duck(D.SAMPLES)})"
ATT, GRP = f"a AS ({D.duck(D.ATTEMPTS)})", f"g AS ({D.duck(D.REWARDS)})"
METRICS = ["raw_js", "baseline_js", "corrected_gap", "teacher_entropy", "uncertainty", "visual_proxy"]
#: Resamples of a bootstrap, as many as the reference makes by default.
REPS = 5000


def query(sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query. Doubles are rounded to nine places on both sides, as sums depend on their order."""
    names = doubles.split()

    def wrap(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            out = f(spark, sf_dir)
            return out.withColumns({n: F.round(n, 9) + F.lit(0.0) for n in names}) if names else out

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({n}, 9) + 0.0::DOUBLE AS {n}' for n in names)}) FROM ({sql}) final" if names else sql
        return run

    return wrap


def distribution_sql(x: str, prefix: str = "") -> str:
    quantiles = ", ".join(f"quantile_cont({x}::DOUBLE, {q}) AS {prefix}{name}" for name, q in C.QUANTILES.items())
    return f"count({x}) AS {prefix}sample_count, avg({x}) AS {prefix}mean, var_pop({x}) AS {prefix}variance, stddev_pop({x}) AS {prefix}std, {quantiles}"


DISTRIBUTION = "mean variance std p05 p25 p50 p75 p95"


def pearson_sql(x: str, y: str) -> str:
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) >= 2 THEN covar_pop({y}, {x}) / nullif(sqrt(var_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * var_pop(CASE WHEN {x} IS NOT NULL THEN {y} END)), 0) END"


def bins_sql(source: str, report: str, target: str, bins: int = 10) -> str:
    return f"SELECT CAST(least(floor({report} * {bins}), {bins - 1}) AS INT) AS bin, count(*) AS n, avg({report}) AS rm, avg({target}) AS tm FROM {source} WHERE {report} IS NOT NULL AND {target} IS NOT NULL GROUP BY 1"


# Calibration.

SCORED = "SELECT *, CAST(answer_correct AS DOUBLE) AS y FROM r WHERE answer_label_available AND answer_confidence IS NOT NULL"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.rollouts(spark, sf_dir)
    return rows.where("answer_label_available AND answer_confidence IS NOT NULL").withColumn("y", F.col("answer_correct").cast("double"))


@query(f"WITH {R}, p AS ({SCORED}), b AS ({bins_sql('p', 'answer_confidence', 'y')}) SELECT CAST(i AS INT) AS bin, i / 10.0::DOUBLE AS lower, (i + 1) / 10.0::DOUBLE AS upper, coalesce(n, 0) AS sample_count, rm AS report_mean, tm AS target_mean, abs(rm - tm) AS absolute_mean_error FROM range(10) x(i) LEFT JOIN b ON b.bin = i", "lower upper report_mean target_mean absolute_mean_error")
def agg02_reliability_bins(spark, sf_dir):
    return C.reliability(_scored(spark, sf_dir), "answer_confidence", "y")


@query(f"WITH {R}, p AS ({SCORED}), b AS ({bins_sql('p', 'answer_confidence', 'y')}) SELECT sum(n * abs(rm - tm)) / sum(n) AS ece FROM b", "ece")
def agg01_answer_ece10(spark, sf_dir):
    return C.calibration_error(_scored(spark, sf_dir), "answer_confidence", "y")


@query(f"WITH {R} SELECT avg(CASE WHEN answer_label_available THEN power(answer_confidence - CAST(answer_correct AS DOUBLE), 2) END) AS answer_brier, avg(CASE WHEN NOT proxy_fallback THEN power(visual_confidence - visual_proxy, 2) END) AS visual_proxy_mse FROM r", "answer_brier visual_proxy_mse")
def agg03_brier_and_mse(spark, sf_dir):
    label, eligible = F.col("answer_label_available"), ~F.col("proxy_fallback")
    return D.rollouts(spark, sf_dir).agg(C.brier(F.when(label, F.col("answer_confidence")), F.col("answer_correct").cast("int")).alias("answer_brier"), C.brier(F.when(eligible, F.col("visual_confidence")), F.col("visual_proxy")).alias("visual_proxy_mse"))


_SCORED_IF, _PAIRED_IF = "(answer_label_available AND answer_confidence IS NOT NULL)", "(NOT proxy_fallback AND visual_confidence IS NOT NULL)"
_Y = "CAST(answer_correct AS DOUBLE)"


def _count(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


#: The measures of one aggregation over rollouts.
_MEASURES_SQL = f"""count(*) AS sample_count, CAST(sum(CAST(answer_correct AS INT)) AS BIGINT) AS answer_correct_count, avg({_Y}) AS answer_accuracy, {_count('answer_label_available')} AS answer_label_available_count, {_count(_SCORED_IF)} AS answer_confidence_count,
 {_count(_SCORED_IF)} / {_count('answer_label_available')} AS answer_confidence_coverage, avg(CASE WHEN {_SCORED_IF} THEN power(answer_confidence - {_Y}, 2) END) AS answer_brier,
 {_count(_SCORED_IF + ' AND answer_confidence >= 0.8')} AS high_confidence_count, {_count(_SCORED_IF + ' AND answer_confidence >= 0.8 AND NOT answer_correct')} AS high_confidence_error_count, {_count(_SCORED_IF + ' AND answer_confidence >= 0.8 AND NOT answer_correct')} / nullif({_count(_SCORED_IF + ' AND answer_confidence >= 0.8')}, 0) AS high_confidence_error_rate,
 {_count('NOT proxy_fallback')} AS visual_proxy_eligible_count, {_count(_PAIRED_IF)} AS visual_proxy_pair_count, {_count(_PAIRED_IF)} / nullif({_count('NOT proxy_fallback')}, 0) AS visual_proxy_report_coverage, avg(CASE WHEN {_PAIRED_IF} THEN power(visual_confidence - visual_proxy, 2) END) AS visual_proxy_mse,
 {pearson_sql(f'CASE WHEN {_PAIRED_IF} THEN visual_confidence END', f'CASE WHEN {_PAIRED_IF} THEN visual_proxy END')} AS visual_proxy_report_correlation,
 {pearson_sql('CASE WHEN NOT proxy_fallback AND answer_label_available THEN visual_proxy END', f'CASE WHEN NOT proxy_fallback AND answer_label_available THEN {_Y} END')} AS answer_relation_correlation,
 avg(CASE WHEN NOT proxy_fallback AND answer_label_available AND answer_correct THEN visual_proxy END) AS proxy_mean_correct, avg(CASE WHEN NOT proxy_fallback AND answer_label_available AND NOT answer_correct THEN visual_proxy END) AS proxy_mean_incorrect,
 {_count("trim(reason_text) <> '' AND NOT e1")} AS reason_present_count, {_count('NOT e1 AND NOT e2')} AS format_clean_count, {_count('NOT e1 AND NOT e2')} / count(*) AS format_clean_rate, count(visual_confidence) AS visual_report_count, count(answer_confidence) AS answer_report_count,
 {_count('visual_confidence IS NOT NULL AND answer_confidence IS NOT NULL')} AS both_reports_count, {_count('visual_confidence IS NOT NULL AND answer_confidence IS NOT NULL')} / count(*) AS both_reports_rate, {_count('NOT proxy_fallback')} / count(*) AS proxy_nonfallback_rate"""


@query(
    f"""WITH {R}, p AS ({SCORED}), v AS (SELECT * FROM r WHERE {_PAIRED_IF}), pb AS ({bins_sql('p', 'answer_confidence', 'y')}), vb AS ({bins_sql('v', 'visual_confidence', 'visual_proxy')}),
m AS (SELECT {_MEASURES_SQL},
 {distribution_sql('CASE WHEN NOT proxy_fallback THEN visual_proxy END', 'proxy_')}, {distribution_sql('CAST(vision_tokens AS DOUBLE)', 'vision_tokens_')} FROM r)
SELECT m.*, proxy_mean_correct - proxy_mean_incorrect AS proxy_mean_difference, (SELECT sum(n * abs(rm - tm)) / sum(n) FROM pb) AS answer_ece, (SELECT sum(n * abs(rm - tm)) / sum(n) FROM vb) AS visual_proxy_binned_mean_error FROM m""",
    "answer_accuracy answer_confidence_coverage answer_brier high_confidence_error_rate visual_proxy_report_coverage visual_proxy_mse visual_proxy_report_correlation answer_relation_correlation proxy_mean_correct proxy_mean_incorrect format_clean_rate both_reports_rate proxy_nonfallback_rate proxy_mean_difference answer_ece visual_proxy_binned_mean_error "
    + " ".join(f"{p}{n}" for p in ("proxy_", "vision_tokens_") for n in DISTRIBUTION.split()),
)
def agg11_evaluate_rollouts(spark, sf_dir):
    return C.evaluate_rollouts(D.rollouts(spark, sf_dir))


def _error_sql(source: str, report: str, target: str, bins: int) -> str:
    return f"(SELECT sum(n * abs(rm - tm)) / sum(n) FROM ({bins_sql(source, report, target, bins)}) b)"


def _long_sql(source: str, at: str = "''", keys: str = "") -> str:
    """A statement of all columns of a source as (measure, value), nulls included."""
    return f"SELECT {keys}{at} || name AS measure, value FROM {source} UNPIVOT INCLUDE NULLS (value FOR name IN (COLUMNS(* EXCLUDE (at_{', step' if keys else ''})))) u"


def _bins_report_sql(name: str, source: str, report: str, target: str) -> str:
    return f"(SELECT '{name}/' || i || '/' AS at_, i / 20.0::DOUBLE AS lower, (i + 1) / 20.0::DOUBLE AS upper, coalesce(n, 0)::DOUBLE AS sample_count, rm AS report_mean, tm AS target_mean, abs(rm - tm) AS absolute_mean_error FROM range(20) x(i) LEFT JOIN ({bins_sql(source, report, target, 20)}) b ON b.bin = i)"


def _means_report_sql(name: str, item: str, value: str, where: str = "true") -> str:
    return f"SELECT '{name}/{item}/' AS at_, count({value})::DOUBLE AS sample_count, avg({value}) AS mean FROM r WHERE {where}"


_COVERED = {"answer_label_available": "answer_label_available", "answer_report": "answer_confidence IS NOT NULL", "both_reports": "answer_confidence IS NOT NULL AND visual_confidence IS NOT NULL", "format_clean": "NOT e1 AND NOT e2", "proxy_nonfallback": "NOT proxy_fallback", "visual_report": "visual_confidence IS NOT NULL"}


@query(
    f"""WITH {R}, p AS ({SCORED}), v AS (SELECT * FROM r WHERE {_PAIRED_IF}), m AS (SELECT '' AS at_, {_MEASURES_SQL}, {distribution_sql('CASE WHEN NOT proxy_fallback THEN visual_proxy END', 'proxy_')}, {distribution_sql('CAST(vision_tokens AS DOUBLE)', 'vision_tokens_')},
 {_count('NOT answer_label_available')} AS answer_label_unavailable_count, {_count('proxy_fallback')} AS visual_proxy_fallback_count, 0.8::DOUBLE AS high_confidence_threshold, {_error_sql('p', 'answer_confidence', 'y', 20)} AS answer_ece, {_error_sql('p', 'answer_confidence', 'y', 10)} AS answer_ece10, {_error_sql('v', 'visual_confidence', 'visual_proxy', 20)} AS visual_proxy_binned_mean_error, {_error_sql('v', 'visual_confidence', 'visual_proxy', 10)} AS visual_proxy_binned_mean_error10 FROM r),
w AS (SELECT at_, COLUMNS(* EXCLUDE (at_))::DOUBLE FROM (SELECT *, proxy_mean_correct - proxy_mean_incorrect AS proxy_mean_difference FROM m) d),
k AS ({_means_report_sql('proxy_components', 'gap', 'u', 'NOT proxy_fallback')} UNION ALL {_means_report_sql('proxy_components', 'entropy', 'CASE WHEN doc % 3 <> 0 THEN 1 - u END', 'NOT proxy_fallback')} UNION ALL {_means_report_sql('reward_components', 'utility', _Y)} UNION ALL {_means_report_sql('reward_components', 'report', '-u')}),
c AS ({' UNION ALL '.join(f"SELECT 'output_coverage/{n}/' AS at_, ({_count(x)})::DOUBLE AS n, {_count(x)} / count(*) AS rate FROM r" for n, x in _COVERED.items())}), b1 AS {_bins_report_sql('answer_ece_bins', 'p', 'answer_confidence', 'y')}, b2 AS {_bins_report_sql('visual_proxy_bins', 'v', 'visual_confidence', 'visual_proxy')}
{' UNION ALL '.join(_long_sql(x, 'at_') for x in ('w', 'k', 'c', 'b1', 'b2'))}""",
    "value",
)
def agg11_full_report(spark, sf_dir):
    """Every measure of rollouts in one report, with bins, components and coverage, at twenty bins."""
    return C.full_report(D.rollouts(spark, sf_dir), bins=20)


@query(f"WITH {R} SELECT {_count(_SCORED_IF + ' AND answer_confidence >= 0.7')} AS confident, {_count(_SCORED_IF + ' AND answer_confidence >= 0.7 AND NOT answer_correct')} AS errors FROM r")
def agg10_high_confidence_errors(spark, sf_dir):
    return C.confident_errors(_scored(spark, sf_dir), "answer_confidence", "y", 0.7)


@query(f"WITH {R} SELECT answer_label_available AS labelled, {pearson_sql('visual_confidence', 'visual_proxy')} AS correlation FROM r GROUP BY 1", "correlation")
def agg13_pearson(spark, sf_dir):
    return D.rollouts(spark, sf_dir).groupBy(F.col("answer_label_available").alias("labelled")).agg(C.pearson(F.col("visual_confidence"), F.col("visual_proxy")).alias("correlation"))


@query(f"WITH {R} SELECT step, {distribution_sql('visual_proxy')}, min(visual_proxy) AS min, max(visual_proxy) AS max FROM r WHERE NOT proxy_fallback GROUP BY step", DISTRIBUTION + " min max")
def agg15_distribution(spark, sf_dir):
    return C.described(D.rollouts(spark, sf_dir).where("NOT proxy_fallback"), ["step"], F.col("visual_proxy"))


@query(f"WITH {R}, h AS (SELECT least(floor(visual_proxy * 20), 19) AS b, count(*) AS n FROM r GROUP BY 1) SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n FROM range(20) x(i) LEFT JOIN h ON b = i")
def agg17_histogram(spark, sf_dir):
    return C.histogram(D.rollouts(spark, sf_dir), "visual_proxy", 20)


@query(f"WITH {R}, l AS (SELECT 'gap' AS name, u AS value FROM r WHERE NOT proxy_fallback UNION ALL SELECT 'entropy', CASE WHEN doc % 3 <> 0 THEN 1 - u END FROM r WHERE NOT proxy_fallback) SELECT name, count(value) AS sample_count, avg(value) AS mean FROM l GROUP BY name", "mean")
def agg18_component_means(spark, sf_dir):
    return C.map_means(D.rollouts(spark, sf_dir).where("NOT proxy_fallback"), "proxy_components")


@query(f"WITH {R} SELECT answer_correct, count(*) AS n, avg(visual_proxy) AS proxy_mean FROM r WHERE NOT proxy_fallback AND answer_label_available GROUP BY 1", "proxy_mean")
def agg19_answer_relation(spark, sf_dir):
    found = C.by_outcome(D.rollouts(spark, sf_dir).where("NOT proxy_fallback AND answer_label_available"), "answer_correct", "visual_proxy")
    return found.withColumnRenamed("visual_proxy_mean", "proxy_mean")


@query(
    f"WITH {R}, f AS (SELECT unnest(['answer_label_available', 'answer_report', 'both_reports', 'format_clean', 'proxy_nonfallback', 'visual_report']) AS measure, unnest([answer_label_available, answer_confidence IS NOT NULL, answer_confidence IS NOT NULL AND visual_confidence IS NOT NULL, NOT e1 AND NOT e2, NOT proxy_fallback, visual_confidence IS NOT NULL]) AS ok FROM r) SELECT measure, count(*) FILTER (ok) AS n, avg(CAST(ok AS INT)) AS rate FROM f GROUP BY measure",
    "rate",
)
def agg20_output_coverage(spark, sf_dir):
    return C.output_coverage(D.rollouts(spark, sf_dir))


@query(f"WITH {R}, h AS (SELECT answer_score AS s, count(*) AS n FROM r WHERE answer_score IS NOT NULL GROUP BY 1) SELECT CAST(i AS INT) AS score, coalesce(n, 0) AS n, (SELECT count(answer_score) FROM r) AS valid_count, (SELECT count(answer_score) / count(*) FROM r) AS coverage, (SELECT avg(answer_score) FROM r) AS mean FROM range(11) x(i) LEFT JOIN h ON s = i", "coverage mean")
def agg21_raw_scores(spark, sf_dir):
    return C.score_counts(D.rollouts(spark, sf_dir), "answer_score")


@query(f"WITH {R} SELECT 'empty_reason' AS name, count(*) AS n FROM r WHERE e1 UNION ALL SELECT 'missing_confidence', count(*) FROM r WHERE e2")
def agg22_error_frequency(spark, sf_dir):
    return C.error_frequency(D.rollouts(spark, sf_dir))


@query(f"WITH {R} SELECT rank, count(*) AS n, CAST(sum(vision_tokens) AS BIGINT) AS positions, coalesce(sum(u * vision_tokens) / nullif(sum(vision_tokens), 0), 0) AS mean FROM r GROUP BY rank", "mean")
def agg34_rank_local_means(spark, sf_dir):
    return C.weighted_means(D.rollouts(spark, sf_dir), "rank", "u", "vision_tokens")


@query(
    f"""WITH {R}, p AS ({SCORED}), n AS (SELECT count(*) AS total_count, count(*) FILTER (answer_label_available) AS labelled FROM r)
SELECT id, row_number() OVER w AS retained_count, count(*) OVER () AS reported_count, total_count, row_number() OVER w / count(*) OVER () AS coverage_of_reported, row_number() OVER w / labelled AS coverage_of_labeled, row_number() OVER w / total_count AS coverage_of_all, CAST(sum(1 - y) OVER w AS BIGINT) AS error_count, sum(1 - y) OVER w / row_number() OVER w AS risk
FROM p, n WINDOW w AS (ORDER BY answer_confidence DESC, id ROWS UNBOUNDED PRECEDING)""",
    "coverage_of_reported coverage_of_labeled coverage_of_all risk",
)
def win01_risk_coverage(spark, sf_dir):
    return C.risk_coverage(D.rollouts(spark, sf_dir), "id", "answer_confidence", "answer_correct", F.col("answer_label_available"))


# Audit.

_V = f"""{ATT}, v AS (SELECT *, parsed AND k % 3 <> 0 AS f1, parsed AND k % 4 <> 0 AS f2, parsed AND k % 2 = 0 AS ok, visual_confidence / 100.0::DOUBLE AS vc, answer_confidence / 100.0::DOUBLE AS rc FROM a),
x AS (SELECT *, CAST(f1 AND f2 AS INT) AS visual, CAST(ok AS INT) AS answer_ok, CASE WHEN parsed THEN vc END AS v, CASE WHEN parsed THEN rc END AS r FROM v),
z AS (SELECT *, 2 * visual + answer_ok AS util, -power(v - visual, 2) - visual * power(r - answer_ok, 2) AS cal FROM x)"""


@query(
    f"""WITH {_V}, zv AS (SELECT * FROM z WHERE parsed), zc AS (SELECT * FROM z WHERE parsed AND visual = 1), vb AS ({bins_sql('zv', 'v', 'visual')}), cb AS ({bins_sql('zc', 'r', 'answer_ok')})
SELECT count(*) AS sample_count, 2 AS facts_min, 2 AS facts_max, 2.0::DOUBLE AS facts_mean, {_count('received')} AS received, {_count('parsed')} AS parsed, {_count('NOT received')} AS missing_attempt_count, {_count('received AND NOT parsed')} AS format_failure_count,
{_count('visual = 1')} AS visual_correct_count, {_count('answer_ok = 1')} AS answer_correct_count, {_count('visual = 0 AND answer_ok = 0')} AS v0_y0, {_count('visual = 0 AND answer_ok = 1')} AS v0_y1, {_count('visual = 1 AND answer_ok = 0')} AS v1_y0, {_count('visual = 1 AND answer_ok = 1')} AS v1_y1,
{_count('visual = 0 AND answer_ok = 1')} / nullif({_count('visual = 0')}, 0) AS answer_given_not_visual, avg(CASE WHEN parsed THEN util END) AS utility_mean, avg(cal) AS calibration_mean, avg(util + cal) AS reward_mean,
avg(v) AS visual_confidence_mean, avg(CASE WHEN parsed THEN visual END) AS visual_observed_rate, avg(power(v - visual, 2)) AS visual_brier, {_count('parsed AND visual = 1')} AS conditional_count, avg(CASE WHEN visual = 1 THEN r END) AS conditional_confidence_mean, avg(CASE WHEN parsed AND visual = 1 THEN answer_ok END) AS conditional_observed_rate, avg(CASE WHEN visual = 1 THEN power(r - answer_ok, 2) END) AS conditional_brier,
{_count('parsed AND v >= 0.8 AND visual = 0')} AS high_visual_errors, {_count('parsed AND visual = 1 AND r >= 0.8 AND answer_ok = 0')} AS high_conditional_errors, (SELECT sum(n * abs(rm - tm)) / sum(n) FROM vb) AS visual_ece10, (SELECT sum(n * abs(rm - tm)) / sum(n) FROM cb) AS conditional_ece10 FROM z""",
    "answer_given_not_visual utility_mean calibration_mean reward_mean visual_confidence_mean visual_observed_rate visual_brier conditional_confidence_mean conditional_observed_rate conditional_brier visual_ece10 conditional_ece10",
)
def agg04_audit_attempts(spark, sf_dir):
    return A.audit(A.verified(*D.examples_and_attempts(spark, sf_dir)))


@query(f"WITH {_V} SELECT 'status' AS slot, {_count('f1')} AS correct, count(*) AS total, avg(CAST(f1 AS INT)) AS rate FROM z UNION ALL SELECT 'priority', {_count('f2')}, count(*), avg(CAST(f2 AS INT)) FROM z", "rate")
def agg08_slot_accuracy(spark, sf_dir):
    return A.slot_accuracy(A.verified(*D.examples_and_attempts(spark, sf_dir)))


@query(f"WITH {_V} SELECT visual, answer_ok, count(*) AS n FROM z GROUP BY ALL")
def agg06_joint_outcomes(spark, sf_dir):
    return A.verified(*D.examples_and_attempts(spark, sf_dir)).groupBy("visual", "answer_ok").agg(F.count("*").alias("n"))


@query(f"WITH {_V} SELECT id, visual, answer_ok, CASE WHEN parsed THEN CAST(util AS DOUBLE) END AS utility, cal AS calibration, util + cal AS total FROM z", "utility calibration total")
def mth01_scores(spark, sf_dir):
    return A.verified(*D.examples_and_attempts(spark, sf_dir)).select("id", "visual", "answer_ok", "utility", "calibration", "total")


@query(f"WITH {ATT} SELECT id, 'missing' AS problem FROM a WHERE NOT received UNION ALL SELECT concat('x', id), 'unknown' FROM a WHERE received AND k % 100 = 1")
def jn03_id_mismatches(spark, sf_dir):
    examples, attempts = D.examples_and_attempts(spark, sf_dir)
    strange = attempts.where("CAST(id AS BIGINT) % 100 = 1").select(F.concat(F.lit("x"), "id").alias("id"))
    return A.mismatches(examples, attempts.select("id").unionAll(strange))


@query(f"WITH {ATT} SELECT concat('x', id) AS id FROM a WHERE received AND k % 100 = 1")
def jn02_unknown_attempts(spark, sf_dir):
    examples, attempts = D.examples_and_attempts(spark, sf_dir)
    strange = attempts.where("CAST(id AS BIGINT) % 100 = 1").select(F.concat(F.lit("x"), "id").alias("id"))
    return A.unknown_attempts(examples, attempts.select("id").unionAll(strange)).select("id")


# Groups.


@query(f"WITH {GRP} SELECT event_id, reward - avg(reward) OVER w AS advantage, CASE WHEN count(*) OVER w < 2 THEN reward - avg(reward) OVER w ELSE (reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-4) END AS by_group, (reward - avg(reward) OVER w) / ((SELECT stddev_samp(reward) FROM g) + 1e-4) AS by_batch FROM g WINDOW w AS (PARTITION BY grp)", "advantage by_group by_batch")
def win02_group_centring(spark, sf_dir):
    rows = D.view(spark, sf_dir, D.REWARDS)
    out = G.centred(G.centred(rows, "grp", "reward"), "grp", "reward", "group", "by_group")
    return G.centred(out, "grp", "reward", "batch", "by_batch").select("event_id", "advantage", "by_group", "by_batch")


@query(f"WITH {GRP}, c AS (SELECT event_id, reward - avg(reward) OVER (PARTITION BY grp) AS adv FROM g) SELECT event_id, i AS token, CASE WHEN i >= 6 THEN 0.0::DOUBLE WHEN i < event_id % 5 THEN adv ELSE -adv END AS advantage FROM c, range(8) x(i)", "advantage")
def win04_segment_advantages(spark, sf_dir):
    rows = G.centred(D.view(spark, sf_dir, D.REWARDS), "grp", "reward")
    content, active = K.prefix_mask(F.col("event_id") % 5, 8), K.prefix_mask(F.lit(6), 8)
    tokens = rows.select("event_id", F.posexplode(G.segment(content, F.col("advantage"), -F.col("advantage"), active)).alias("token", "advantage"))
    return tokens.select("event_id", F.col("token").cast("long").alias("token"), "advantage")


@query(f"WITH {GRP} SELECT grp, count(*) AS n, count(DISTINCT event_type) AS payloads FROM g GROUP BY grp HAVING count(*) <> 4 OR count(DISTINCT event_type) <> 1")
def agg36_incomplete_groups(spark, sf_dir):
    return G.incomplete(D.view(spark, sf_dir, D.REWARDS), "grp", 4, "event_type")


@query(f"WITH {GRP}, c AS (SELECT grp, floor(reward / 100) - avg(floor(reward / 100)) OVER (PARTITION BY grp) AS adv FROM g), f AS (SELECT grp, bool_and(abs(adv) < 1e-12) AS flat FROM c GROUP BY grp) SELECT count(*) AS groups, avg(CAST(flat AS INT)) AS zero_fraction FROM f", "zero_fraction")
def agg41_zero_advantage_groups(spark, sf_dir):
    rows = D.view(spark, sf_dir, D.REWARDS).withColumn("coarse", F.floor(F.col("reward") / 100).cast("double"))
    return G.zero_groups(G.centred(rows, "grp", "coarse"), "grp", "advantage")


@query(f"WITH {GRP} SELECT user_id % 10 AS update, var_pop(reward) AS variance, avg(reward) AS mean, bool_and(abs(reward) < 1e-12) AS all_zero FROM g GROUP BY 1", "variance mean")
def agg40_update_metrics(spark, sf_dir):
    return G.update_metrics(D.view(spark, sf_dir, D.REWARDS).withColumn("update", F.col("user_id") % 10), "update", "reward")


@query(f"WITH {GRP}, k AS (SELECT rank, concat(CASE WHEN event_type = 'view' THEN 'rank_local/' ELSE '' END, event_type) AS key, avg(reward) AS value FROM g WHERE NOT (rank = 1 AND event_type = 'signup') GROUP BY ALL) SELECT replace(key, 'rank_local/', 'global/') AS key, count(*) AS ranks, avg(value) AS mean, count(*) = 2 AS complete FROM k GROUP BY 1", "mean")
def agg35_merge_ranks(spark, sf_dir):
    rows = D.view(spark, sf_dir, D.REWARDS).where("NOT (rank = 1 AND event_type = 'signup')")
    key = F.concat(F.when(F.col("event_type") == "view", "rank_local/").otherwise(""), "event_type")
    return G.merged_ranks(rows.groupBy("rank", key.alias("key")).agg(F.avg("reward").alias("value")), 2)


@query("WITH g AS (SELECT event_id // 2 AS step, user_id % 3 AS a, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS b FROM events) SELECT step, count(DISTINCT (a, b)) AS versions FROM g GROUP BY step HAVING count(DISTINCT (a, b)) > 1")
def agg38_disagreeing_ranks(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).alias("step"), (F.col("user_id") % 3).alias("a"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("b"))
    return G.disagreeing(rows, "step", ["a", "b"])


@query("SELECT user_id, event_id, count(*) OVER w AS attempted, count(*) FILTER (event_type <> 'error') OVER w AS successful, count(*) FILTER (event_type = 'error') OVER w AS skipped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def stm07_optimizer_counters(spark, sf_dir):
    return G.counters(D.table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "error")


@query("SELECT * FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value < before", "value before")
def win07_falling_counters(spark, sf_dir):
    return G.falling(D.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("SELECT DISTINCT event_id FROM events WHERE event_id = 0 OR event_id % 20 = 0 OR event_id = 999")
def win08_validation_steps(spark, sf_dir):
    return G.at_intervals(D.table(spark, sf_dir, "events").select("event_id"), "event_id", 20, 999)


# Kernels. Arrays are unnested on the other side.

_LOGITS = "l AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE * 4) AS student, list_transform(b.embedding, lambda x: x::DOUBLE * 4) AS teacher, list_transform(c.embedding, lambda x: x::DOUBLE * 4) AS baseline FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2)"
_LONG = f"{_LOGITS}, u AS (SELECT vec_id, unnest(student) AS s, unnest(teacher) AS t, unnest(baseline) AS b, unnest(range(len(student))) AS i FROM l), m AS (SELECT vec_id, ln(sum(exp(s))) AS ls, ln(sum(exp(t))) AS lt, ln(sum(exp(b))) AS lb FROM u GROUP BY vec_id), e AS (SELECT vec_id, i, s, t, s - ls AS s1, t - lt AS t1, b - lb AS b1, exp(s - ls) AS ps, exp(t - lt) AS pt, exp(b - lb) AS pb FROM u JOIN m USING (vec_id))"


def _logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.logits(spark, sf_dir).select("vec_id", *[K.log_softmax(F.col(c)).alias(c) for c in ("student", "teacher", "baseline")])


def _js_sql(p: str, q: str) -> str:
    half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * (ln({a}) - ln(({p} + {q}) / 2)) ELSE 0 END"
    return f"least(greatest(sum({half(p)} + {half(q)}) / (2 * ln(2)), 0), 1)"


_DIVERGED = f"d AS (SELECT vec_id, {_js_sql('ps', 'pt')} AS js, {_js_sql('ps', 'pb')} AS js_base, -sum(pt * t1) / ln(count(*)) AS h FROM e GROUP BY vec_id)"


@query(f"WITH {_LONG} SELECT vec_id, i AS token, s1 AS log_p FROM e", "log_p")
def arr01_log_softmax(spark, sf_dir):
    rows = _logp(spark, sf_dir).select("vec_id", F.posexplode("student").alias("token", "log_p"))
    return rows.select("vec_id", F.col("token").cast("long").alias("token"), "log_p")


@query(f"WITH {_LONG}, {_DIVERGED} SELECT vec_id, js, h AS entropy FROM d", "js entropy")
def arr02_js_and_entropy(spark, sf_dir):
    p = {c: K.probabilities(F.col(c)) for c in ("student", "teacher")}
    return _logp(spark, sf_dir).select("vec_id", K.js_divergence(p["student"], p["teacher"]).alias("js"), K.entropy(p["teacher"]).alias("entropy"))


@query(f"WITH {_LONG}, {_DIVERGED}, g AS (SELECT vec_id // 12 AS example, greatest(js - js_base, 0) AS gap, h, 0.5::DOUBLE * greatest(js - js_base, 0) + 0.5::DOUBLE * h AS unc FROM d) SELECT example, count(*) AS tokens, avg(gap) AS mean_gap, avg(h) AS mean_entropy, avg(unc) AS uncertainty, CASE WHEN count(*) < 8 THEN 0 ELSE exp(-avg(unc) / 1.0::DOUBLE) END AS certainty, count(*) < 8 AS fallback FROM g GROUP BY example", "mean_gap mean_entropy uncertainty certainty")
def arr04_visual_certainty(spark, sf_dir):
    """Certainty of examples of twelve tokens; those of under eight fall back to 0."""
    p = {c: K.probabilities(F.col(c)) for c in ("student", "teacher", "baseline")}
    parts = _logp(spark, sf_dir).select("vec_id", K.js_divergence(p["student"], p["teacher"]).alias("js"), K.js_divergence(p["student"], p["baseline"]).alias("base"), K.entropy(p["teacher"]).alias("h"))
    gap, u = K.uncertainty(F.col("js"), F.col("base"), F.col("h"))
    out = parts.select(F.floor(F.col("vec_id") / 12).alias("example"), gap.alias("gap"), "h", u.alias("u")).groupBy("example")
    out = out.agg(F.count("*").alias("tokens"), F.avg("gap").alias("mean_gap"), F.avg("h").alias("mean_entropy"), F.avg("u").alias("uncertainty"))
    few = F.col("tokens") < 8
    return out.withColumn("certainty", F.when(few, 0.0).otherwise(F.exp(-F.col("uncertainty")))).withColumn("fallback", few)


_MIXED = "ln(0.7 * ps + 0.3 * pt)"


@query(f"WITH {_LONG} SELECT vec_id, sum(pt * (t1 - s1)) AS forward_kl, sum(ps * (s1 - t1)) AS reverse_kl, sum(0.3 * pt * (t1 - {_MIXED}) + 0.7 * ps * (s1 - {_MIXED})) AS mixed, sum(least(pt * (t1 - s1), 0.05)) AS clipped FROM e GROUP BY vec_id", "forward_kl reverse_kl mixed clipped")
def arr07_content_divergence(spark, sf_dir):
    s, t = F.col("student"), F.col("teacher")
    return _logp(spark, sf_dir).select("vec_id", K.content_divergence(s, t).alias("forward_kl"), K.content_divergence(s, t, 1.0).alias("reverse_kl"), K.content_divergence(s, t, 0.3).alias("mixed"), K.content_divergence(s, t, clip=0.05).alias("clipped"))


@query(f"WITH {_LONG}, q AS (SELECT vec_id, avg(CAST(pt * (t1 - s1) > 0.05 AS INT)) AS clipped_fraction, arg_max(i, (s1, -i)) AS top_s, arg_max(i, (t1, -i)) AS top_t FROM e GROUP BY vec_id) SELECT vec_id, clipped_fraction, top_s <> top_t AS disagrees FROM q", "clipped_fraction")
def arr09_signal_diagnostics(spark, sf_dir):
    over = F.zip_with("student", "teacher", lambda s, t: (F.exp(t) * (t - s) > 0.05).cast("int"))
    count = F.aggregate(over, F.lit(0), lambda a, x: a + x)
    return _logp(spark, sf_dir).select("vec_id", (count / F.size(over)).alias("clipped_fraction"), (K.argmax(F.col("student")) != K.argmax(F.col("teacher"))).alias("disagrees"))


@query(f"WITH {_LONG}, k AS (SELECT vec_id, i, s1, t1, row_number() OVER (PARTITION BY vec_id ORDER BY t1 DESC, i) AS r FROM e), z AS (SELECT *, t1 - ln(sum(exp(t1)) OVER w) AS tt, s1 - ln(sum(exp(s1)) OVER w) AS ss FROM k WHERE r <= 8 WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, sum(exp(tt) * (tt - ss)) AS kl FROM z GROUP BY vec_id", "kl")
def srt04_top_k_divergence(spark, sf_dir):
    rows = D.logits(spark, sf_dir).withColumn("top", K.top_k(F.col("teacher"), 8))
    rows = rows.select("vec_id", K.log_softmax(K.gather(F.col("student"), F.col("top"))).alias("s"), K.log_softmax(K.gather(F.col("teacher"), F.col("top"))).alias("t"))
    return rows.select("vec_id", K.content_divergence(F.col("s"), F.col("t")).alias("kl"))


@query(f"WITH {_LONG} SELECT vec_id, sum(power(0.9::DOUBLE, 63 - i) * 0.1::DOUBLE * s) AS ema, sqrt(sum(s * s)) AS norm, max(abs(s1 - t1)) AS max_delta FROM e GROUP BY vec_id", "ema norm max_delta")
def arr14_ema_and_norms(spark, sf_dir):
    l = D.logits(spark, sf_dir)  # noqa: E741
    delta = F.array_max(F.zip_with(K.log_softmax(F.col("student")), K.log_softmax(F.col("teacher")), lambda a, b: F.abs(a - b)))
    return l.select("vec_id", K.ema(F.col("student"), F.lit(0.0), 0.9).alias("ema"), K.l2(F.col("student")).alias("norm"), delta.alias("max_delta"))


@query("WITH e AS (SELECT vec_id, vec_id % 16 AS step, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s, vec_id % 16 = 5 OR vec_id % 48 = 7 AS odd FROM embeddings) SELECT step, count(*) AS parts, CASE WHEN bool_or(odd) THEN NULL ELSE sqrt(sum(s)) END AS norm, NOT bool_or(odd) AS applied FROM e GROUP BY step", "norm")
def arr15_finite_updates(spark, sf_dir):
    """Norms over sixteen steps' gradients; those with a value that isn't finite are skipped."""
    odd = F.when(F.col("vec_id") % 16 == 5, float("nan")).when(F.col("vec_id") % 48 == 7, float("-inf"))
    values = F.when(odd.isNotNull(), F.array_append(F.col("embedding").cast("array<double>"), odd)).otherwise(F.col("embedding").cast("array<double>"))
    return G.finite_updates(D.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 16).alias("step"), values.alias("gradient")), "step", "gradient")


@query("SELECT doc_id, k, CAST(floor(k * (n_chars - 1) / 4) AS INT) AS place FROM documents, range(5) x(k)")
def win10_even_places(spark, sf_dir):
    rows = D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(K.even_places(F.col("n_chars"), 5)).alias("k", "place"))
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), "place")


@query(f"WITH {_LONG} SELECT vec_id, sum(s1 - t1) AS ratio, 1 - 0.5 * sum(s1 - t1) - 0.1 AS content, 0.25 - 0.2::DOUBLE AS report FROM e GROUP BY vec_id", "ratio content report")
def mth03_sampled_weights(spark, sf_dir):
    ratio = K.log_ratio(F.col("student"), F.col("teacher"))
    content, report = K.sampled_weights(F.lit(1.0), F.lit(0.25), ratio, 0.5, 0.1, 0.2)
    return _logp(spark, sf_dir).select("vec_id", ratio.alias("ratio"), content.alias("content"), report.alias("report"))


# Rollouts of twelve tokens: the first eight are content, the last three a report.
_SAMPLED = f"{_LONG}, v AS (SELECT vec_id, ln(sum(exp(s / 1.1::DOUBLE))) AS ls, ln(sum(exp(t / 1.1::DOUBLE))) AS lt FROM e GROUP BY vec_id), k AS (SELECT vec_id, max(CASE WHEN i = vec_id * 7 % 64 THEN s1 END) AS p, max(CASE WHEN i = vec_id * 7 % 64 THEN t1 END) AS q, sum(least(exp(t / 1.1::DOUBLE - lt) * ((t / 1.1::DOUBLE - lt) - (s / 1.1::DOUBLE - ls)), 0.05)) AS kl FROM e JOIN v USING (vec_id) GROUP BY vec_id), o AS (SELECT vec_id // 12 AS example, p, q, kl, vec_id % 12 < 8 AS c, vec_id % 12 >= 9 AS r FROM k)"


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example, p, q, c, r, kl): log probabilities of sampled tokens by student and teacher, masks, and divergences of content tokens."""
    at = (F.col("vec_id") * 7 % 64 + 1).cast("int")
    picked = lambda name: F.element_at(K.log_softmax(F.col(name)), at)
    kl = K.content_divergence(K.log_softmax(F.col("student"), 1.1), K.log_softmax(F.col("teacher"), 1.1), clip=0.05)
    place = F.col("vec_id") % 12
    rows = D.logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 12).alias("example"), F.struct("vec_id", picked("student").alias("p"), picked("teacher").alias("q"), (place < 8).cast("int").alias("c"), (place >= 9).cast("int").alias("r"), kl.alias("kl")).alias("x"))
    rows = rows.groupBy("example").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("example", *[F.col(f"x.{n}") for n in "pqcr"], F.transform(F.filter("x", lambda x: x["c"] == 1), lambda x: x["kl"]).alias("kl"))


@query(f"WITH {_SAMPLED}, g AS (SELECT example, -0.75 * coalesce(sum(CASE WHEN c THEN p END), 0) - 0.25 * coalesce(sum(CASE WHEN r THEN p END), 0) AS policy, coalesce(avg(CASE WHEN c THEN kl END), 0) AS apart, count(*) AS n, -avg(CASE WHEN c THEN p END) AS cn, -avg(CASE WHEN r THEN p END) AS rn, CAST(count_if(c) AS INT) AS cs, CAST(count_if(r) AS INT) AS rs FROM o GROUP BY example) SELECT example, 0.9 * policy + 0.5 * apart AS loss, policy AS policy_loss, apart AS opsd_loss, policy / n AS policy_loss_per_generated_token, cn AS content_mean_nll, rn AS report_mean_nll, cs AS content_tokens, rs AS report_tokens FROM g", "loss policy_loss opsd_loss policy_loss_per_generated_token content_mean_nll report_mean_nll")
def arr10_joint_loss(spark, sf_dir):
    c = {n: F.col(n) for n in ("p", "c", "r", "kl")}
    return _sampled(spark, sf_dir).select("example", *[x.alias(n) for n, x in K.joint_loss(c["p"], c["c"], c["r"], c["kl"], F.lit(0.75), F.lit(0.25), 0.9, 0.5).items()])


@query(f"WITH {_SAMPLED}, g AS (SELECT example, coalesce(sum(CASE WHEN c THEN p END), 0) AS cp, coalesce(sum(CASE WHEN c THEN p - q END), 0) AS k, coalesce(sum(CASE WHEN r THEN p END), 0) AS rp FROM o GROUP BY example) SELECT avg(-(1 - 0.5 * k - 0.1) * cp - (0.25 - 0.2) * rp) AS loss, avg(k) AS mean_sampled_log_ratio, count(*) AS rollout_count FROM g", "loss mean_sampled_log_ratio")
def mth04_batch_loss(spark, sf_dir):
    p, q, c, r = (F.col(n) for n in "pqcr")
    rows = _sampled(spark, sf_dir).select(K._masked(p, c).alias("content"), K._masked(q, c).alias("teacher"), K._masked(p, r).alias("report"))
    rows = rows.withColumn("ratio", K.log_ratio(F.col("content"), F.col("teacher")))
    weights = K.sampled_weights(F.lit(1.0), F.lit(0.25), F.col("ratio"), 0.5, 0.1, 0.2)
    return rows.agg(K.batch_loss(*weights, F.col("content"), F.col("report")).alias("loss"), F.avg("ratio").alias("mean_sampled_log_ratio"), F.count("*").alias("rollout_count"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN list_concat([doc_id, n_chars], [doc_id % 11]) END AS input_ids, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 2 END AS response_start FROM documents")
def arr13_rescore_ids(spark, sf_dir):
    doc, chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    prompt = F.when(doc % 5 != 0, F.array(doc, chars)).otherwise(F.array().cast("array<bigint>"))
    ids, start = K.rescore_ids(prompt, F.array(F.when(doc % 7 == 0, F.lit(-1)).otherwise(doc % 11)))
    return D.table(spark, sf_dir, "documents").select("doc_id", ids.alias("input_ids"), start.alias("response_start"))


@query()
def win09_epoch_order(spark, sf_dir):
    """Three epochs' steps; the Mersenne Twister has no SQL form."""
    items = D.table(spark, sf_dir, "benchmark").select("item_id")
    return S.in_epochs(items, "item_id", 3 * items.count(), 42)


_PLACES = """n AS (SELECT count(*) AS n FROM orders), c AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM n),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders), e AS (SELECT o_orderkey, place, epoch FROM o, range(1, 4) r(epoch)),
w AS (SELECT o_orderkey, epoch, 0 AS i, place // b AS x, place % b AS y FROM e, c
  UNION ALL SELECT o_orderkey, epoch, (i + 1) % 7,
    CASE WHEN i = 6 THEN x WHEN i % 2 = 0 THEN (x + CAST('0x' || substr(md5(concat_ws('|', '42:' || epoch, i, y)), 1, 15) AS BIGINT)) % a ELSE x END,
    CASE WHEN i = 6 OR i % 2 = 0 THEN y ELSE (y + CAST('0x' || substr(md5(concat_ws('|', '42:' || epoch, i, x)), 1, 15) AS BIGINT)) % b END
  FROM w, c WHERE i < 6 OR x * b + y >= n),
d AS (SELECT o_orderkey, epoch, (epoch - 1) * n + x * b + y + 1 AS step, n FROM w, c WHERE i = 6 AND x * b + y < n)"""


@query(f"WITH RECURSIVE {_PLACES} SELECT o_orderkey, epoch, CAST(step AS BIGINT) AS step FROM d WHERE step <= 5 * n // 2")
def win09_keyed_epochs(spark, sf_dir):
    """Two and a half epochs, each in its own permutation, by expressions alone."""
    rows = D.table(spark, sf_dir, "orders").select("o_orderkey")
    return S.in_keyed_epochs(rows, "o_orderkey", 5 * rows.count() // 2, 42).select("o_orderkey", "epoch", "step")


@query(f"WITH {R}, m AS (SELECT id, {_Y} AS y, answer_confidence AS a, visual_confidence AS v, visual_proxy AS s, e1 OR e2 OR proxy_fallback AS bad FROM r) SELECT id, y AS utility, -coalesce(power(a - y, 2), 1) - coalesce(power(v - s, 2), 1) - CASE WHEN bad THEN 0.5 ELSE 0 END AS report, y - coalesce(power(a - y, 2), 1) - coalesce(power(v - s, 2), 1) - CASE WHEN bad THEN 0.5 ELSE 0 END AS content, y - power(a - y, 2) - power(v - s, 2) AS total FROM m", "utility report content total")
def mth06_rewards(spark, sf_dir):
    rows = D.rollouts(spark, sf_dir)
    args = F.col("answer_correct").cast("double"), F.col("visual_proxy"), F.col("visual_confidence"), F.col("answer_confidence")
    block = K.reward_block(*args, errors=(F.size("format_errors") > 0) | F.col("proxy_fallback"))
    return rows.select("id", *[c.alias(n) for n, c in block.items()], K.proxy_score(*args)["total"].alias("total"))


# Samples and splits.


@query("SELECT o_orderkey, sha256(concat('7:', o_orderkey)) AS rank_sha256 FROM orders ORDER BY rank_sha256, o_orderkey LIMIT 50")
def srt01_hash_subset(spark, sf_dir):
    return S.subset(D.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50, 7)


_REP = "h AS (SELECT o_custkey, o_orderkey, sha256(concat('17', chr(0), o_custkey, chr(0), o_orderkey)) AS rank_sha256 FROM orders), p AS (SELECT o_custkey, o_orderkey, rank_sha256 FROM h QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY rank_sha256, o_orderkey) = 1)"


@query(f"WITH {_REP} SELECT * FROM p")
def win05_representatives(spark, sf_dir):
    return S.representatives(D.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 17)


@query(f"WITH {_REP}, q AS (SELECT *, row_number() OVER (ORDER BY rank_sha256, o_custkey) AS n FROM p) SELECT o_custkey, o_orderkey, CASE WHEN n <= 60 THEN 'train' ELSE 'validation' END AS split FROM q WHERE n <= 80")
def srt02_split(spark, sf_dir):
    return S.split(D.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 60, 20, 17)


@query("SELECT CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 2 = 1")
def set01_overlap(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    return S.overlap(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"])


@query("WITH b AS (SELECT l_orderkey % 2 AS side, unnest([l_partkey, l_suppkey]) AS v FROM lineitem) SELECT CAST(v AS VARCHAR) AS value FROM b WHERE side = 0 INTERSECT SELECT CAST(v AS VARCHAR) FROM b WHERE side = 1")
def set02_cross_role_overlap(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem")
    return S.overlap(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), ["l_partkey", "l_suppkey"])


@query("SELECT sha256(text) AS sha256, count(*) AS copies, count(DISTINCT doc_id % 3) AS parts FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1")
def set03_leaked_contents(spark, sf_dir):
    return S.leaked(D.table(spark, sf_dir, "documents").withColumn("part", F.col("doc_id") % 3), "text", "part")


@query("(SELECT o_orderkey, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)) UNION ALL SELECT l_orderkey, 'extra' FROM (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT o_orderkey FROM orders)")
def set04_uncovered(spark, sf_dir):
    return S.uncovered(D.table(spark, sf_dir, "orders"), D.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256(concat('5:', doc_id)), 1, 16) AS UBIGINT) AS DECIMAL(20,0)) AS seed, CAST(CAST('0x' || substr(sha256(concat('5:', doc_id)), 1, 16) AS UBIGINT) % 9223372036854775808 AS DECIMAL(20,0)) AS bounded FROM documents")
def hsh04_generation_seeds(spark, sf_dir):
    text = F.concat(F.lit("5:"), F.col("doc_id").cast("string"))
    return D.table(spark, sf_dir, "documents").select("doc_id", S.seed_of(text).alias("seed"), S.seed_of(text, 1 << 63).alias("bounded"))


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 3 AS INT) AS shard FROM orders")
def win06_stride_shards(spark, sf_dir):
    return S.stride(D.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3)


@query("SELECT pos, doc_id, source FROM (SELECT item_id AS pos, (item_id * 13) % 97 AS doc_id FROM benchmark WHERE item_id < 32) i JOIN documents USING (doc_id)")
def jn05_listed_order(spark, sf_dir):
    ids = D.table(spark, sf_dir, "benchmark").where("item_id < 32").select(F.col("item_id").alias("pos"), ((F.col("item_id") * 13) % 97).alias("doc_id"))
    return S.in_listed_order(ids, D.table(spark, sf_dir, "documents"), "doc_id").select("pos", "doc_id", "source")


@query("WITH i AS (SELECT item_id AS pos, item_id AS id, (item_id * 7) % 3 AS scene FROM benchmark WHERE item_id < 32) SELECT a.id, arg_min(b.id, ((b.pos - a.pos) % 32 + 32) % 32) AS next_id FROM i a JOIN i b ON a.scene <> b.scene GROUP BY a.id")
def jn08_successors(spark, sf_dir):
    """By the scene and the hash of each text, which stands for both images."""
    ids = D.table(spark, sf_dir, "benchmark").where("item_id < 32").select(F.col("item_id").alias("pos"), F.col("item_id").alias("id"), ((F.col("item_id") * 7) % 3).alias("scene"), F.sha2("text", 256).alias("student"), F.sha2("text", 256).alias("teacher"))
    return S.successors(ids, ("student", "teacher"))


@query("WITH i AS (SELECT item_id AS pos, item_id AS id, (item_id * 7) % 3 AS scene, sha256(CAST(item_id // 2 % 5 AS VARCHAR)) AS student, sha256(CAST(item_id // 3 % 4 AS VARCHAR)) AS teacher FROM benchmark WHERE item_id < 32) SELECT a.id, arg_min(b.id, ((b.pos - a.pos) % 32 + 32) % 32) AS next_id FROM i a JOIN i b ON a.scene <> b.scene AND a.student <> b.student AND a.teacher <> b.teacher GROUP BY a.id")
def jn08_donors(spark, sf_dir):
    """The same where images repeat across scenes."""
    item = F.col("item_id")
    image = lambda per, of: F.sha2((F.floor(item / per) % of).cast("string"), 256)
    ids = D.table(spark, sf_dir, "benchmark").where("item_id < 32").select(item.alias("pos"), item.alias("id"), ((item * 7) % 3).alias("scene"), image(2, 5).alias("student"), image(3, 4).alias("teacher"))
    return S.successors(ids, ("student", "teacher"))


@query("SELECT CASE WHEN t.l_orderkey IS NOT NULL AND s.c_custkey IS NOT NULL THEN 'both' WHEN t.l_orderkey IS NOT NULL THEN 'lines' WHEN s.c_custkey IS NOT NULL THEN 'customer' ELSE 'neither' END AS state, count(*) AS n FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') t ON t.l_orderkey = o.o_orderkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) s ON s.c_custkey = o.o_custkey GROUP BY 1")
def jn09_pair_states(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    customers = D.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return S.matched(rows, {"lines": (lines, "o_orderkey"), "customer": (customers, "o_custkey")}).groupBy("state").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT user_id, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), s AS (SELECT user_id, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT f.user_id, f.v, s.v AS v_after FROM f JOIN s USING (user_id) WHERE f.v > 15 AND s.v > 15", "v v_after")
def jn12_common_cohort(spark, sf_dir):
    mean = lambda side: D.table(spark, sf_dir, "events").where(f"event_id % 2 = {side}").groupBy("user_id").agg(F.avg("value").alias("v"))
    return P.cohort(mean(0), mean(1), "user_id", F.col("v") > 15)


# Paired conditions.


@query(f"WITH {TOK}, {SAM}, l AS (" + " UNION ALL ".join([f"SELECT condition, '{m}' AS metric, {m} AS value, 'examples' AS weighting FROM s" for m in METRICS] + [f"SELECT condition, '{m}', {m}, 'tokens' FROM t" for m in METRICS[:-1]]) + f") SELECT condition, metric, weighting, {distribution_sql('value')}, min(value) AS min, max(value) AS max FROM l WHERE value IS NOT NULL GROUP BY ALL", DISTRIBUTION + " min max")
def agg25_condition_summary(spark, sf_dir):
    return P.condition_summary(D.view(spark, sf_dir, D.SAMPLES), D.view(spark, sf_dir, D.TOKENS), METRICS)


@query(f"WITH {TOK}, {SAM}, a AS (SELECT condition, count(*) AS sample_count, {_count('proxy_fallback')} AS fallback_count, avg(CAST(proxy_fallback AS INT)) AS fallback_rate, count(answer_correct) AS labeled_sample_count, {_count('answer_correct')} AS answer_correct_count FROM s GROUP BY 1), b AS (SELECT condition, count(*) AS vision_token_count, avg(CAST(abs(corrected_gap) <= 1e-6 AS INT)) AS zero_gap_fraction, avg(CAST(raw_js <= baseline_js + 1e-6 AS INT)) AS raw_le_baseline_fraction FROM t GROUP BY 1) SELECT * FROM a LEFT JOIN b USING (condition)", "fallback_rate zero_gap_fraction raw_le_baseline_fraction")
def agg25_condition_counts(spark, sf_dir):
    return P.condition_counts(D.view(spark, sf_dir, D.SAMPLES), D.view(spark, sf_dir, D.TOKENS))


@query(f"WITH {SAM}, b AS (SELECT * FROM s WHERE condition = 'view' AND NOT proxy_fallback) SELECT count(*) AS n, {pearson_sql('corrected_gap', 'teacher_entropy')} AS gap_entropy, {pearson_sql('corrected_gap', 'visual_proxy')} AS gap_proxy, {pearson_sql('teacher_entropy', 'visual_proxy')} AS entropy_proxy, 0.5 * avg(corrected_gap) AS gap_part, 0.5 * avg(teacher_entropy) AS entropy_part FROM b", "gap_entropy gap_proxy entropy_proxy gap_part entropy_part")
def agg26_term_relations(spark, sf_dir):
    return P.term_relations(D.view(spark, sf_dir, D.SAMPLES), "view", 0.5)


_DELTA = f"{SAM}, j AS (SELECT n.condition, n.example_id, n.proxy_fallback OR o.proxy_fallback AS fell, o.proxy_fallback AS was, n.proxy_fallback AS now, " + ", ".join(f"n.{m} - o.{m} AS {m}" for m in METRICS) + " FROM s n JOIN s o ON o.example_id = n.example_id AND o.condition = 'view' WHERE n.condition <> 'view'), l AS (" + " UNION ALL ".join(f"SELECT condition, example_id, '{m}' AS metric, '{scope}' AS scope, {m} AS delta FROM j{where}" for m in METRICS for scope, where in (("all_available", ""), ("valid_to_valid", " WHERE NOT fell"))) + ")"


@query(f"WITH {_DELTA} SELECT condition, metric, scope, count(*) AS n, avg(delta) AS mean_delta, median(delta) AS median_delta, stddev_pop(delta) AS std_delta, {_count('delta > 1e-12')} AS positive, {_count('delta < -1e-12')} AS negative, {_count('abs(delta) <= 1e-12')} AS zero FROM l WHERE delta IS NOT NULL GROUP BY ALL", "mean_delta median_delta std_delta")
def agg28_paired_deltas(spark, sf_dir):
    return P.delta_summary(P.deltas(D.view(spark, sf_dir, D.SAMPLES), "view", METRICS))


@query(f"WITH {SAM}, o AS (SELECT DISTINCT example_id FROM s WHERE condition = 'view'), n AS (SELECT DISTINCT condition, example_id FROM s WHERE condition <> 'view'), g AS (SELECT condition, (SELECT count(*) FROM o) AS b, count(*) AS c, count(o.example_id) AS x FROM n LEFT JOIN o USING (example_id) GROUP BY condition) SELECT condition, b AS baseline_sample_count, c AS condition_sample_count, x AS shared_example_ids, b - x AS baseline_only_count, c - x AS condition_only_count FROM g")
def jn07_condition_coverage(spark, sf_dir):
    return P.coverage(D.view(spark, sf_dir, D.SAMPLES), "view")


@query(f"WITH {_DELTA} SELECT condition, concat(CASE WHEN was THEN 'fallback' ELSE 'valid' END, '_to_', CASE WHEN now THEN 'fallback' ELSE 'valid' END) AS change, count(*) AS n FROM j GROUP BY ALL")
def agg28_fallback_transitions(spark, sf_dir):
    return P.transitions(D.view(spark, sf_dir, D.SAMPLES), "view")


def bootstrap_sql(metrics: list[str], reps: int, seed: int) -> str:
    weight = " + ".join(f"CAST(u >= {bound!r}::DOUBLE AS INT)" for bound in P.POISSON)
    kinds = [(m, scope, f"CASE WHEN NOT fell THEN {m} END" if scope == "valid_to_valid" else m) for m in metrics for scope in ("all_available", "valid_to_valid")]
    sums = ", ".join(f"sum(w * {x}) / nullif(sum(CASE WHEN {x} IS NOT NULL THEN w END), 0) AS m{i}" for i, (_, _, x) in enumerate(kinds))
    long = " UNION ALL ".join(f"SELECT condition, '{m}' AS metric, '{scope}' AS scope, m{i} AS mean FROM q" for i, (m, scope, _) in enumerate(kinds))
    return f"""WITH {_DELTA}, h AS (SELECT j.*, b.block, md5(concat_ws('|', '{seed}', b.block, example_id)) AS digest FROM j, range({-(-reps // P.PER_DIGEST)}) b(block)),
d AS (SELECT h.*, block * {P.PER_DIGEST} + i.i AS rep, CAST('0x' || substr(digest, CAST(8 * i.i + 1 AS BIGINT), 8) AS BIGINT) / {float(1 << 32)!r}::DOUBLE AS u FROM h, range({P.PER_DIGEST}) i(i)),
w AS (SELECT *, {weight} AS w FROM d WHERE rep < {reps}), q AS (SELECT condition, rep, {sums} FROM w GROUP BY condition, rep), m AS ({long})
SELECT condition, metric, scope, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m WHERE mean IS NOT NULL GROUP BY ALL"""


@query(bootstrap_sql(["raw_js"], 100, 3), "low high")
def agg29_hashed_bootstrap(spark, sf_dir):
    """A reduced form, 100 resamples of one metric; agg29_hashed_bootstrap_5000 is the whole job."""
    return P.hashed_bootstrap(P.deltas(D.view(spark, sf_dir, D.SAMPLES), "view", ["raw_js"]), 100, 3)


@query(bootstrap_sql(METRICS, REPS, 3), "low high")
def agg29_hashed_bootstrap_5000(spark, sf_dir):
    return P.hashed_bootstrap(P.deltas(D.view(spark, sf_dir, D.SAMPLES), "view", METRICS), REPS, 3)


@query(doubles="low high")
def agg29_exact_bootstrap(spark, sf_dir):
    return P.exact_bootstrap(P.deltas(D.view(spark, sf_dir, D.SAMPLES), "view", METRICS), REPS, 3)


@query(f"WITH {TOK}, {SAM} SELECT t.example_id, t.condition, token_index FROM t ANTI JOIN (SELECT * FROM s WHERE answer_correct IS NOT NULL) q ON t.example_id = q.example_id AND t.condition = q.condition")
def jn06_orphan_tokens(spark, sf_dir):
    return P.orphans(D.view(spark, sf_dir, D.TOKENS), D.view(spark, sf_dir, D.SAMPLES).where("answer_correct IS NOT NULL").select("example_id", "condition")).select("example_id", "condition", "token_index")


@query(f"WITH {TOK}, {SAM}, c AS (SELECT example_id, condition, count(*) AS found FROM t WHERE token_id <> 0 GROUP BY ALL) SELECT example_id, condition, vision_tokens AS declared, coalesce(found, 0) AS found FROM s LEFT JOIN c USING (example_id, condition) WHERE vision_tokens <> coalesce(found, 0)")
def jn06_miscounted_tokens(spark, sf_dir):
    return P.miscounted(D.view(spark, sf_dir, D.TOKENS).where("token_id <> 0"), D.view(spark, sf_dir, D.SAMPLES))


@query(f"WITH {TOK} SELECT example_id, condition, token_index FROM t WHERE abs(corrected_gap - least(greatest(raw_js - 0.9 * baseline_js, 0), 1)) > 1e-4 OR abs(uncertainty - (0.5 * corrected_gap + 0.5 * teacher_entropy)) > 1e-4")
def prd15_token_formula(spark, sf_dir):
    return P.off_formula(D.view(spark, sf_dir, D.TOKENS), 0.9, 0.5).select("example_id", "condition", "token_index")


@query(f"WITH {TOK}, {SAM}, m AS (SELECT example_id, condition, avg(raw_js) AS token_mean FROM t WHERE token_id <> 0 GROUP BY ALL) SELECT example_id, condition, raw_js, token_mean FROM s JOIN m USING (example_id, condition) WHERE abs(raw_js - token_mean) > 1e-4", "raw_js token_mean")
def agg31_sample_means(spark, sf_dir):
    """Both means are exact, that of a sample too, so no order of events decides what is at the slack or half a ninth place."""
    tokens = D.view(spark, sf_dir, D.TOKENS)
    samples = tokens.groupBy("example_id", "condition").agg(P.exact_mean(F.col("raw_js")).alias("raw_js"))
    return P.off_mean(tokens.where("token_id <> 0"), samples, "raw_js").select("example_id", "condition", "raw_js", "token_mean")


@query(f"WITH {TOK}, q AS (SELECT example_id, condition, list(token_id ORDER BY token_index) AS ids, list(token_index ORDER BY token_index) AS places FROM t GROUP BY ALL) SELECT example_id, count(DISTINCT (ids, places)) AS versions FROM q GROUP BY 1 HAVING count(DISTINCT (ids, places)) > 1")
def agg32_unequal_sequences(spark, sf_dir):
    return P.unequal_sequences(D.view(spark, sf_dir, D.TOKENS))


@query("SELECT condition, CAST(row_number() OVER (ORDER BY CASE condition WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, condition) - 1 AS INT) AS place FROM (SELECT DISTINCT event_type AS condition FROM events)")
def srt07_condition_order(spark, sf_dir):
    return P.condition_order(D.view(spark, sf_dir, D.TOKENS), ["view", "click"])


# Text.

_PARSED = f"c AS ({D.duck(D.COMPLETIONS)})"


@query(f"WITH {_PARSED}, n AS (SELECT *, (length(completion) - length(replace(completion, '<answer>', ''))) // 8 AS o, (length(completion) - length(replace(completion, '</answer>', ''))) // 9 AS k, strpos(completion, '<answer>') - 1 AS s, strpos(completion, '</answer>') - 1 AS e FROM c) SELECT doc_id, CASE WHEN o = 1 AND k = 1 AND e >= s + 8 THEN substr(completion, s + 9, e - s - 8) END AS answer, CASE WHEN o = 1 AND k = 1 AND e >= s + 8 THEN CAST(s + 8 AS INT) END AS start FROM n")
def str03_unique_tag(spark, sf_dir):
    found = T.section(F.col("completion"), "answer")
    return D.view(spark, sf_dir, D.COMPLETIONS).select("doc_id", found["inner"].alias("answer"), found["start"].alias("start"))


@query(f"WITH {_PARSED} SELECT doc_id, CAST(nullif(regexp_extract(completion, '<visual_confidence>(10|[0-9])</visual_confidence>', 1), '') AS INT) AS score FROM c")
def str04_scores(spark, sf_dir):
    return D.view(spark, sf_dir, D.COMPLETIONS).select("doc_id", T.score_of(F.col("completion"), "visual_confidence").alias("score"))


_ERRORS = {
    0: [], 1: ["empty_reason", "missing_confidence", "noncanonical_structure"], 2: ["missing_or_invalid_vision", "missing_or_invalid_reason", "invalid_visual_confidence", "legacy_reasoning_tag", "noncanonical_structure"],
    3: ["missing_or_invalid_vision", "misordered_reason", "invalid_visual_confidence", "invalid_answer_confidence", "noncanonical_structure"], 4: ["missing_or_invalid_vision", "misordered_reason", "missing_or_empty_answer", "invalid_visual_confidence", "noncanonical_structure"],
    5: ["invalid_answer_confidence", "noncanonical_structure"], 6: ["empty_vision", "missing_confidence", "noncanonical_structure"], 7: ["missing_or_invalid_vision", "missing_or_invalid_reason", "missing_or_empty_answer", "missing_confidence", "noncanonical_structure"], 8: ["misordered_reason", "noncanonical_structure"],
}


@query("SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{','.join(v)}'" for k, v in _ERRORS.items()) + f" END AS errors, CASE WHEN doc_id % 9 IN (2, 3, 5, 8, 0, 4) THEN CAST(CASE doc_id % 9 WHEN 5 THEN strpos(completion, '</answer><confidence>') + 8 ELSE strpos(completion, '<confidence>') - 1 END AS INT) END AS report_start, CASE doc_id % 9 WHEN 0 THEN CAST(n_chars % 11 AS INT) WHEN 5 THEN 4 WHEN 8 THEN 0 END AS visual_confidence FROM (WITH {_PARSED} SELECT c.*, n_chars FROM c JOIN documents USING (doc_id)) z")
def str05_parse_completions(spark, sf_dir):
    rows = T.parse_completions(D.view(spark, sf_dir, D.COMPLETIONS), "completion", "p")
    return rows.select("doc_id", F.array_join("p.format_errors", ",").alias("errors"), "p.report_start", "p.visual_confidence")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 9 = 0")
def str06_canonical(spark, sf_dir):
    rows = D.view(spark, sf_dir, D.COMPLETIONS).where(F.col("completion").rlike(T.CANONICAL))
    return rows.join(D.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(replace(text, 'ﬁ', 'fi'))), 'ß', 'ss'), '[\\x09-\\x0D\\x1C-\\x20]+', ' ', 'g')) AS folded FROM (SELECT doc_id, concat(text, ' ﬁ Ä STRASSE Straße') AS text FROM documents) d")
def str01_normalise(spark, sf_dir):
    """Over all documents, in four languages, each with a ligature and a sharp s."""
    return D.table(spark, sf_dir, "documents").select("doc_id", T.normalized(F.concat("text", F.lit(" ﬁ Ä STRASSE Straße"))).alias("folded"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1,2' ELSE concat('1,2,', doc_id % 3) END AS ids FROM documents")
def str17_terminal_tokens(spark, sf_dir):
    ids = F.array(F.lit(1), F.lit(2), (F.col("doc_id") % 3).cast("int"))
    return D.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.without_terminal(ids, F.array(F.lit(0))), ",").alias("ids"))


@query(f"WITH {_PARSED}, q AS (SELECT doc_id, CASE doc_id % 9 WHEN 5 THEN strpos(completion, '</answer><confidence>') + 8 ELSE strpos(completion, '<confidence>') - 1 END AS b, length(completion) AS n FROM c) SELECT doc_id, CASE WHEN b < 0 THEN CAST(ceil(n / 7) AS INT) ELSE CAST(floor(b / 7) AS INT) END AS content_tokens, CAST(ceil(n / 7) AS INT) AS tokens FROM q")
def str19_masks(spark, sf_dir):
    """Tokens of seven characters: the first that touches the report starts it."""
    rows = T.parse_completions(D.view(spark, sf_dir, D.COMPLETIONS), "completion", "p")
    count = F.ceil(F.length("completion") / 7).cast("int")
    spans = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * 7).alias("start"), F.least(i * 7 + 7, F.length("completion")).alias("end")))
    made = T.masks(spans, F.col("p.vision_start"), F.col("p.vision_end"), F.col("p.report_start"))
    return rows.select("doc_id", F.aggregate(made["content"], F.lit(0), lambda a, x: a + x).alias("content_tokens"), count.alias("tokens"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ASK = "SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN concat('Which? A. ', lang, ' B. x C. y D. z') ELSE concat(' How many ', source, '? ') END AS question, CASE WHEN doc_id % 2 = 0 THEN concat(' ', source, ' ') END AS hint, CASE WHEN doc_id % 5 = 0 THEN concat('[\"', lang, '\"]') END AS evidence FROM {documents}"


@query(
    f"""WITH q AS ({D.duck(_ASK)}) SELECT doc_id, sha256(concat({_quoted(N.GUIDANCE + N.START)}, CASE WHEN hint IS NOT NULL THEN concat('Image focus: ', trim(hint), chr(10)) ELSE '' END, 'Question: ', trim(question))) AS single,
sha256(concat({_quoted(N.GUIDANCE)}, ' ', CASE WHEN doc_id % 3 = 0 THEN {_quoted(N.ONE_LETTER)} ELSE {_quoted(N.DIRECT)} END, {_quoted(N.GIVEN_IMAGE)})) AS system, concat(CASE WHEN hint IS NOT NULL THEN concat('Image focus: ', trim(hint), chr(10)) ELSE '' END, 'Question: ', trim(question), {_quoted(N.FOUR_BLOCKS)}) AS student,
concat(CASE WHEN evidence IS NOT NULL THEN concat({_quoted(N.EVIDENCE)}, evidence, chr(10)) ELSE '' END, 'Question: ', trim(question)) AS teacher, concat('Question: ', trim(question)) AS plain_teacher, sha256(concat(trim(question), {_quoted(N.EARLIER_ASK)}, chr(123), '"color": "visible value", "a ', lang, '": "visible value"', chr(125), {_quoted(N.EARLIER_REST)})) AS earlier FROM q"""
)
def str14_prompts(spark, sf_dir):
    """The four kinds of prompts, with and without hints, evidence and options."""
    question, hint, evidence = F.col("question"), F.col("hint"), F.col("evidence")
    said = lambda turns, i=1, j=1: turns[i]["content"][j]["text"]
    rows = D.view(spark, sf_dir, _ASK)
    return rows.select(
        "doc_id", F.sha2(N.single(question, hint), 256).alias("single"), F.sha2(said(N.student(question, hint), 0, 0), 256).alias("system"), said(N.student(question, hint)).alias("student"),
        said(N.teacher(question, evidence)).alias("teacher"), said(N.teacher(question, evidence, False)).alias("plain_teacher"), F.sha2(N.earlier(question, F.array(F.lit("color"), F.concat(F.lit("a "), "lang"))), 256).alias("earlier"),
    )


# Contracts.


@query(f"WITH {R} SELECT id, 'vision_tokens is at least 0' AS rule FROM r WHERE vision_tokens - 5 < 0 UNION ALL SELECT id, 'no tokens means fallback' FROM r WHERE NOT proxy_fallback AND vision_tokens - 5 <= 0 UNION ALL SELECT id, 'answer_confidence is a probability' FROM r WHERE answer_confidence + 0.05 > 1")
def prd08_rollout_contract(spark, sf_dir):
    rows = D.rollouts(spark, sf_dir).withColumn("vision_tokens", F.col("vision_tokens") - 5).withColumn("answer_confidence", F.col("answer_confidence") + 0.05)
    return V.rules_table(rows, "id", V.rollout_rules())


@query("SELECT event_id, 'k is under 50' AS rule FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def prd05_json_fields(spark, sf_dir):
    """Numbers inside JSON, typed by their own type: only whole numbers pass as such."""
    rows = V.parsed(D.table(spark, sf_dir, "events"), "props")
    k = F.when(V.type_of(F.col("doc"), "k") == "BIGINT", F.try_variant_get("doc", "$.k", "bigint"))
    return V.rules_table(rows.withColumn("k", k), "event_id", {"k is a whole number": F.col("k").isNotNull(), "k is under 50": F.col("k") < 50})


@query("SELECT p_partkey, p_size > 10 AND p_size - 5 >= 0 AND p_size <= 40 AS holds FROM part")
def prd14_boxes(spark, sf_dir):
    box = F.array(F.lit(5), F.lit(0), F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(5), F.lit(9))
    return D.table(spark, sf_dir, "part").select("p_partkey", V.box_holds(box, F.lit(40), F.lit(9)).alias("holds"))


# Telemetry.


@query(f"WITH {R} SELECT step, count(*) AS attempts, avg(CAST(answer_correct AS INT)) AS accuracy, count(answer_confidence) AS reports FROM r GROUP BY step", "accuracy")
def stm01_flush_windows(spark, sf_dir):
    from .streaming.telemetry import windows

    return windows(D.rollouts(spark, sf_dir), "step", {"attempts": F.count("*"), "accuracy": F.avg(F.col("answer_correct").cast("int")), "reports": F.count("answer_confidence")})


#: Logs of a trainer: what an event tells of its user's step, some under keys that aren't published, some not finite.
_LOGS = """
SELECT event_id, CAST(user_id % 20 AS INT) AS step, CASE event_id % 9 WHEN 0 THEN 'rank_local/policy_loss' WHEN 1 THEN concat('rank_local/', event_type) WHEN 2 THEN 'optimizer_steps' WHEN 3 THEN 'optimizer_state_max_step' WHEN 4 THEN 'teacher_ema'
  WHEN 5 THEN concat('loss/', event_type) WHEN 6 THEN concat('loss_', event_type) WHEN 7 THEN NULL ELSE event_type END AS key, value FROM {events}"""
_LOGS_SQL = f"""SELECT step, 'trainer/' || name AS key, arg_max(value, (key, value)) AS value FROM (SELECT *, CASE WHEN key = 'rank_local/policy_loss' THEN 'rank_local_policy_loss' WHEN key LIKE 'rank_local/%' OR key IN ('optimizer_steps', 'teacher_ema') THEN NULL ELSE replace(key, '/', '_') END AS name FROM ({D.duck(_LOGS)}) l)
WHERE name IS NOT NULL AND value IS NOT NULL AND event_id % 13 <> 0 AND event_id % 17 <> 0 GROUP BY 1, 2"""


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 13 == 0, float("inf")).when(F.col("event_id") % 17 == 0, float("nan")).otherwise(F.col("value"))
    return D.view(spark, sf_dir, _LOGS).withColumn("value", odd)


@query(_LOGS_SQL, "value")
def prd19_trainer_logs(spark, sf_dir):
    """Logs under their published names: measures of one rank, slashes, counters that the evidence has, odd values."""
    from .streaming.telemetry import trainer_logs

    return trainer_logs(_logs(spark, sf_dir), "step")


def _scores_sql(c: str) -> str:
    counts = ", ".join(f'{_count(f"{c} = {i}")} AS "{c}/{i}_count"' for i in range(11))
    return f'count({c}) AS "{c}/valid_count", count({c}) / count(*) AS "{c}/coverage", avg({c}) AS "{c}/mean", {counts}'


def _step_error_sql(name: str, where: str, report: str, target: str) -> str:
    return f"SELECT step, 'train/{name}' AS measure, sum(n * e) / sum(n) AS value FROM (SELECT step, count(*) AS n, abs(avg({report}) - avg({target})) AS e FROM r WHERE {where} GROUP BY step, least(floor({report} * 10), 9)) b GROUP BY step"


_MEASURES_BY_STEP = _MEASURES_SQL.replace(f"/ {_count('answer_label_available')} AS", f"/ nullif({_count('answer_label_available')}, 0) AS")


@query(
    f"""WITH {R}, l AS ({_LOGS_SQL}), m AS (SELECT step, 'train/' AS at_, COLUMNS(* EXCLUDE (step))::DOUBLE FROM (SELECT step, {_MEASURES_BY_STEP}, {_count('NOT answer_label_available')} AS answer_label_unavailable_count, {_count('proxy_fallback')} AS visual_proxy_fallback_count, count(*) AS attempt_count, {_scores_sql('answer_score')}, {_scores_sql('visual_score')},
 {_count('vision_tokens > 0')} AS opsd_diagnostic_rows, sum(vision_tokens) AS opsd_diagnostic_positions, avg(CAST(vision_tokens > 0 AS INT)) AS opsd_diagnostic_coverage, {_count('e1')} AS format_error_empty_reason_count, {_count('e2')} AS format_error_missing_confidence_count FROM r GROUP BY step) x),
d AS (SELECT step, 'train/visual_proxy_stats/' AS at_, COLUMNS(* EXCLUDE (step))::DOUBLE FROM (SELECT step, {distribution_sql('CASE WHEN NOT proxy_fallback THEN visual_proxy END')} FROM r GROUP BY step) x),
t AS (SELECT step, 'train/vision_tokens/' AS at_, COLUMNS(* EXCLUDE (step))::DOUBLE FROM (SELECT step, {distribution_sql('CAST(vision_tokens AS DOUBLE)')} FROM r GROUP BY step) x)
SELECT step, measure AS key, value FROM ({' UNION ALL '.join(_long_sql(x, 'at_', 'step, ') for x in 'mdt')} UNION ALL {_step_error_sql('answer_ece10', _SCORED_IF, 'answer_confidence', _Y)} UNION ALL {_step_error_sql('visual_proxy_binned_mean_error10', _PAIRED_IF, 'visual_confidence', 'visual_proxy')} UNION ALL SELECT step, key, value FROM l) a WHERE value IS NOT NULL AND NOT (value = 0 AND starts_with(measure, 'train/format_error_'))""",
    "value",
)
def stm01_step_payloads(spark, sf_dir):
    """What the log event of each step publishes: the measures of its window of rollouts, and the trainer's logs."""
    from .streaming.telemetry import step_payloads

    return step_payloads(D.rollouts(spark, sf_dir), _logs(spark, sf_dir), "step", ("answer_score", "visual_score"), "vision_tokens")


@query("SELECT source AS split, count(*) AS rows, count(DISTINCT sha256(text)) AS contents, CAST(sum(CAST(CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM documents GROUP BY 1")
def snk03_provenance(spark, sf_dir):
    from .plans.reports import provenance

    return provenance(D.table(spark, sf_dir, "documents").withColumnRenamed("source", "split"), "split", "text")


@query("SELECT split, count(*) AS n FROM (SELECT source AS split FROM documents) GROUP BY 1")
def agg24_split_counts(spark, sf_dir):
    from .plans.reports import split_counts

    return split_counts(D.table(spark, sf_dir, "documents").withColumnRenamed("source", "split"), "split")


# Digests, earlier formats and manifests.


@query("SELECT event_id, sha256(concat('{\"k\": ', json_extract_string(props, '$.k'), '}')) AS digest FROM events")
def hsh02_canonical_digests(spark, sf_dir):
    from .functions.digests import canonical_sha256

    return D.table(spark, sf_dir, "events").select("event_id", canonical_sha256("props").alias("digest"))


@query("SELECT count(*) AS n, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY rank_sha256, o_orderkey)) AS sha256 FROM (SELECT o_orderkey, sha256(concat('7:', o_orderkey)) AS rank_sha256 FROM orders ORDER BY rank_sha256, o_orderkey LIMIT 32)")
def hsh03_subset_digest(spark, sf_dir):
    from .functions.digests import listed_sha256

    return listed_sha256(S.subset(D.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 32, 7), "rank_sha256", "o_orderkey")


def _written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, source, file, bytes): a file of the texts of each language and source, in order of their numbers."""
    from .sources.files import listing
    from .sources.scratch import folder

    path = folder(spark, "texts")
    docs = D.table(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = docs.repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id").drop("doc_id")
    dealt.write.partitionBy("lang", "source").option("lineSep", chr(10)).text(path)
    part = lambda name: F.regexp_extract("file", f"/{name}=([^/]*)/", 1).alias(name)
    return listing(spark, path).where(F.col("file").rlike("/part-[^/]*$")).select(part("lang"), part("source"), "file", "bytes")


_FILES = "f AS (SELECT lang, source, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY lang, source)"


@query(f"WITH {_FILES} SELECT lang, source, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM f")
def hsh01_file_digests(spark, sf_dir):
    """Digests of whole files, read in chunks."""
    from .sources.files import digests

    return digests(_written_documents(spark, sf_dir)).select("lang", "source", F.col("bytes_read").alias("bytes"), "sha256")


@query(f"WITH {_FILES}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS INTEGER) AS part FROM f) SELECT a.lang AS label, a.part, CAST(strlen(any_value(a.content)) AS BIGINT) AS bytes, sha256(any_value(a.content)) AS sha256, sha256(string_agg(b.content, '' ORDER BY b.part)) AS upto_sha256 FROM p a JOIN p b ON a.lang = b.lang AND b.part <= a.part GROUP BY a.lang, a.part")
def src14_part_digests(spark, sf_dir):
    """An archive of each language in parts: digests of each part, and of all parts up to it."""
    from .sources.files import joined_digests

    files = _written_documents(spark, sf_dir).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "file"))).alias("files"))
    return joined_digests(files.select(F.col("lang").alias("label"), F.col("files.file").alias("paths"))).drop("file")


@query(f"WITH {_FILES}, n AS (SELECT *, strlen(content) - strlen(content) // 3 AS n FROM f) SELECT lang, source, CASE WHEN source LIKE '%5' THEN 'short' END AS problem, CAST(CASE WHEN source LIKE '%5' THEN strlen(content) ELSE n END AS BIGINT) AS bytes, CASE WHEN source LIKE '%5' THEN sha256(content) ELSE sha256(encode(content)[1:n]) END AS sha256, CASE WHEN source LIKE '%5' THEN NULL ELSE CAST(n AS BIGINT) END AS kept FROM n")
def src17_frozen_prefixes(spark, sf_dir):
    """Two thirds of the bytes of each file frozen under another name; of some, more are asked for than there are."""
    from .sources.files import listing, snapshot
    from .sources.scratch import folder

    to = folder(spark, "frozen")
    files = _written_documents(spark, sf_dir).withColumn("target", F.concat_ws("/", F.lit(to), "lang", "source"))
    asked = F.when(F.col("source").endswith("5"), F.col("bytes") + 1).otherwise(F.col("bytes") - F.floor(F.col("bytes") / 3))
    made = snapshot(spark, files.select("file", "target", asked.alias("bytes")))
    held = listing(spark, to).select(F.element_at(F.split("file", "/"), -2).alias("lang"), F.element_at(F.split("file", "/"), -1).alias("source"), F.col("bytes").alias("kept"))
    named = made.join(files.select("file", "lang", "source"), "file")
    return named.join(held, ["lang", "source"], "left").select("lang", "source", "problem", "bytes", "sha256", "kept")


_FAULT = f"CASE doc_id % {len(D.LEGACY_CASES)} {' '.join(f'WHEN {i} THEN {chr(39)}{e}{chr(39)}' for i, (_, e) in enumerate(D.LEGACY_CASES) if e)} END"
_OLD = f"o AS (SELECT *, doc_id % {len(D.LEGACY_CASES)} AS kind, {_FAULT} AS error FROM ({D.duck(D.LEGACY)}) y)"
_FITS = f"""{_OLD}, f AS (SELECT *, error IS NULL AS parsed, CASE WHEN error IS NULL THEN kind <> 3 END AS color_ok, CASE WHEN error IS NULL THEN kind IN (0, 1, 4) END AS shape_ok, CASE WHEN error IS NULL THEN kind <> 1 END AS answer_correct, CASE WHEN error IS NULL THEN n_chars % 101 END AS v FROM o),
t AS (SELECT *, color_ok AND shape_ok AS visual_correct, power(v / 100.0::DOUBLE - CAST(color_ok AND shape_ok AS INT), 2) AS off FROM f)"""


@query(f"WITH {_OLD} SELECT doc_id, error, CASE WHEN error IS NULL AND kind <> 3 THEN lang END AS color, CASE WHEN kind IN (0, 1, 4) THEN source END AS shape, CASE WHEN error IS NULL THEN CASE kind WHEN 1 THEN concat('frac', chr(123), '1', chr(125), chr(123), '2', chr(125)) ELSE source END END AS answer, CASE WHEN error IS NULL THEN CAST(n_chars % 101 AS INT) END AS visual_confidence, CASE WHEN error IS NULL THEN 90 END AS answer_confidence, CASE WHEN error IS NULL THEN CAST(strpos(completion, '<confidence>') - 1 AS INT) END AS report_start FROM o")
def str10_legacy_completions(spark, sf_dir):
    """Whole and faulty completions of the earlier format, over two slots."""
    from .functions.legacy import parsed

    rows = D.view(spark, sf_dir, D.LEGACY).withColumn("slots", F.array(F.lit("color"), F.lit("shape"))).withColumn("p", parsed("completion", "slots"))
    fact = lambda name: F.try_element_at("p.facts", F.lit(name)).alias(name)
    return rows.select("doc_id", "p.error", fact("color"), fact("shape"), "p.answer", "p.visual_confidence", "p.answer_confidence", "p.report_start")


@query(f"WITH {_FITS} SELECT doc_id, parsed, error AS format_error, color_ok, shape_ok, visual_correct, answer_correct, 2 * CAST(visual_correct AS INT) + CAST(answer_correct AS INT) + 0.0::DOUBLE AS utility, -off - CAST(visual_correct AS INT) * power(0.9::DOUBLE - CAST(answer_correct AS INT), 2) AS calibration FROM t", "utility calibration")
def str12_attempts(spark, sf_dir):
    """Attempts with all their evidence; accepted values differ from what is said in case, spaces and width."""
    from .functions.legacy import attempts

    wide = F.translate("source", "0123456789", "０１２３４５６７８９")
    facts = F.create_map(F.lit("color"), F.array(F.upper("lang"), F.lit("any")), F.lit("shape"), F.array(F.concat(F.lit(" "), F.upper("source"), F.lit("\n"))))
    rows = attempts(D.view(spark, sf_dir, D.LEGACY).withColumns({"facts": facts, "answers": F.array(wide)}))
    return rows.select("doc_id", "parsed", "format_error", F.col("per_fact_correct")["color"].alias("color_ok"), F.col("per_fact_correct")["shape"].alias("shape_ok"), "visual_correct", "answer_correct", "utility", "calibration")


@query(f"WITH {_FITS}, r AS (SELECT doc_id, CASE WHEN parsed THEN 2 * CAST(visual_correct AS INT) + CAST(answer_correct AS INT) - off - CAST(visual_correct AS INT) * power(0.9::DOUBLE - CAST(answer_correct AS INT), 2) ELSE -2 END AS content, CASE WHEN parsed THEN -off - CAST(visual_correct AS INT) * power(0.9::DOUBLE - CAST(answer_correct AS INT), 2) ELSE -3 END AS report FROM t) SELECT doc_id, CAST(content AS DOUBLE) AS content, CAST(report AS DOUBLE) AS report FROM r", "content report")
def mth08_attempt_rewards(spark, sf_dir):
    """Rewards of attempts in the earlier format, with the constants of malformed ones."""
    from .functions.legacy import attempts

    facts = F.create_map(F.lit("color"), F.array("lang"), F.lit("shape"), F.array("source"))
    rows = attempts(D.view(spark, sf_dir, D.LEGACY).withColumns({"facts": facts, "answers": F.array("source")}))
    return rows.select("doc_id", *[c.alias(n) for n, c in K.attempt_rewards(F.col("parsed"), F.col("calibration"), F.col("total")).items()])


@query(f"WITH {R}, x AS (SELECT *, CASE WHEN answer_label_available THEN {_Y} END AS y FROM r) SELECT id, coalesce(y, 0.0) AS utility, -coalesce(power(answer_confidence - y, 2), 1.0) - coalesce(power(visual_confidence - visual_proxy, 2), 1.0) - CASE WHEN e1 OR e2 THEN 0.5::DOUBLE ELSE 0 END AS report FROM x", "utility report")
def mth07_unlabelled_rewards(spark, sf_dir):
    """The earlier reward block: answers without a label earn nothing and their report costs the most."""
    answer = F.when(F.col("answer_label_available"), F.col("answer_correct").cast("double"))
    block = K.unlabelled_block(answer, F.col("visual_proxy"), F.col("visual_confidence"), F.col("answer_confidence"), F.size("format_errors") > 0)
    return D.rollouts(spark, sf_dir).select("id", block["utility"].alias("utility"), block["report"].alias("report"))


_SAID = ("b", "c", "b) second ﬁve", "b. third", "second ﬁve", "", "Ｂ", "b.  SECOND\u00a0FIVE", None)


@query(f"WITH k AS (SELECT doc_id, doc_id % {len(_SAID)} AS kind FROM documents) SELECT doc_id, kind IN (0, 2, 6, 7) AS correct, kind IN (0, 1, 6) AS canonical, CASE WHEN kind NOT IN (5, 8) THEN kind IN (0, 6) END AS verified, CASE WHEN kind IN (2, 3, 4, 7) THEN 'noncanonical_option_answer' ELSE '' END AS errors FROM k")
def str07_grade_answers(spark, sf_dir):
    """Options from the question; answers right and wrong, bare, wide, with their text, with another's, and none."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.lit("Which?\nA. First  one\nB) Second ﬁve\nC. third\nD. fourth").alias("question"), F.array(F.lit("ｂ")).alias("accepted"))
    said = F.get(F.array(*[F.lit(x).cast("string") for x in _SAID]), (F.col("doc_id") % len(_SAID)).cast("int"))
    rows = T.graded(docs.withColumn("said", said), "said", "accepted", "question")
    errors = K.rollout_errors(F.array().cast("array<string>"), F.lit(False), F.col("verified").isNotNull(), F.lit(True), F.col("canonical"))
    return rows.select("doc_id", "correct", "canonical", "verified", F.array_join(errors, ",").alias("errors"))


@query("SELECT doc_id, concat('/data/', CASE WHEN doc_id % 2 = 0 THEN 'abs' ELSE concat('set/', source) END) AS image FROM documents")
def src19_resolved_paths(spark, sf_dir):
    from .sources.manifests import resolved

    path = F.when(F.col("doc_id") % 2 == 0, "/data/abs").otherwise(F.col("source"))
    return D.table(spark, sf_dir, "documents").select("doc_id", resolved(path, "/data/set/").alias("image"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def src08_projected_scan(spark, sf_dir):
    from .sources.manifests import projected

    return projected(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"]).where("l_quantity > 45").select("l_orderkey", "l_linenumber")


@query("SELECT conv_id, CASE WHEN count(*) > 6 THEN 'completion_ids has 1 to the most' END AS rule FROM conversations GROUP BY conv_id HAVING count(*) > 6")
def src10_pack_contract(spark, sf_dir):
    from .sources.manifests import pack_rules

    packs = D.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id")).agg(F.collect_list(F.col("turn").cast("int")).alias("completion_ids"))
    packs = packs.withColumn("example_id", F.col("conv_id").cast("string")).withColumn("prompt_token_sha256", F.sha2("example_id", 256))
    return V.rules_table(packs, "conv_id", pack_rules(6))


@query("SELECT event_id, 'a/k' AS key, CAST(event_id % 5 AS DOUBLE) AS value FROM events UNION ALL SELECT event_id, 'value', value FROM events", "value")
def prd18_flattened_scalars(spark, sf_dir):
    from .functions.digests import flattened

    rows = D.table(spark, sf_dir, "events").select(F.col("event_id"), F.struct((F.col("event_id") % 5).alias("k"), F.col("event_type").alias("s")).alias("a"), "value")
    return flattened(rows, "event_id")


@query("SELECT doc_id, starts_with(concat('x/', source), 'x/') AND doc_id % 3 <> 0 AS holds FROM documents")
def prd11_contained_paths(spark, sf_dir):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "x/../").otherwise("x/"), "source")
    return D.table(spark, sf_dir, "documents").select("doc_id", V.inside(path, "x").alias("holds"))


@query("SELECT replace(event_type, '/', '_') AS key, sum(value) AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY 1", "value")
def prd19_allowed_keys(spark, sf_dir):
    from .streaming.telemetry import allowed

    return allowed(D.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.sum("value").alias("value")), ["view", "click"])


# Agreement, completeness and positions.


@query(f"WITH {_LONG}, k AS (SELECT * FROM e WHERE i % 3 <> 0 AND i < 40) SELECT vec_id, CAST(count(*) AS INT) AS compared, max(abs(s1 - t1)) AS largest, avg(abs(s1 - t1)) AS mean FROM k GROUP BY vec_id", "largest mean")
def agg37_masked_deltas(spark, sf_dir):
    mask = F.transform("student", lambda x, i: ((i % 3 != 0) & (i < 40)).cast("int"))
    n, largest, mean = K.masked_deltas(F.col("student"), F.col("teacher"), F.col("mask"))
    return _logp(spark, sf_dir).withColumn("mask", mask).select("vec_id", n.alias("compared"), largest.alias("largest"), mean.alias("mean"))


@query(f"WITH {_LONG} SELECT max(abs(s1 - t1)) AS largest FROM e WHERE i < vec_id % 60 + 1", "largest")
def agg43_ragged_delta(spark, sf_dir):
    rows = _logp(spark, sf_dir)
    length = (F.col("vec_id") % 60 + 1).cast("int")
    return rows.agg(F.max(K.ragged_delta(F.col("student"), F.col("teacher"), length)).alias("largest"))


@query("SELECT event_type, CASE WHEN avg(value) > 100 THEN '' ELSE 'mean,' END || CASE WHEN min(event_id) > 3 THEN '' ELSE 'late' END AS failed FROM events GROUP BY 1")
def agg44_audit_gate(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.min("event_id").alias("first"), F.count("*").alias("n"))
    failed = K.gate({"rows": F.col("n") > 0, "mean": F.col("m") > 100, "late": F.col("first") > 3})
    return rows.select("event_type", F.concat(F.when(F.array_contains(failed, "mean"), "mean,").otherwise(""), F.when(F.array_contains(failed, "late"), "late").otherwise("")).alias("failed"))


@query(f"WITH {GRP}, c AS (SELECT grp, reward - avg(reward) OVER (PARTITION BY grp) AS made, event_id % 16 = 3 AS off FROM g) SELECT grp, NOT bool_or(off) AS close FROM c GROUP BY grp")
def agg45_advantage_parity(spark, sf_dir):
    """Advantages that are told, one in sixteen of them off, against those made anew from the rewards."""
    rows = G.centred(D.view(spark, sf_dir, D.REWARDS), "grp", "reward")
    told = rows.withColumn("told", F.col("advantage") + F.when(F.col("event_id") % 16 == 3, 0.01 * F.abs("advantage") + 0.01).otherwise(0.0)).drop("advantage")
    return G.parity(told, "grp", "told", "reward")


@query("SELECT user_id, CASE WHEN g.n IS NULL THEN 'missing' WHEN e.user_id IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0) e FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1) g USING (user_id) WHERE g.n IS NULL OR e.user_id IS NULL OR g.n > 1")
def jn13_completeness(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    return V.complete(e.where("event_id % 3 = 0"), e.where("event_id % 2 = 0").select("user_id").distinct(), "user_id")


@query("SELECT o_orderkey, o_custkey, l_suppkey, l_suppkey = (o_custkey % 10) + 1 AS same FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def jn11_positions(spark, sf_dir):
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 10 + 1).alias("supplier"))
    lines = D.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("supplier"))
    out = S.at_positions(orders, lines, "o_orderkey", ["supplier"]).where("supplier_found IS NOT NULL")
    return out.select("o_orderkey", "o_custkey", F.col("supplier_found").alias("l_suppkey"), "same")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn10_allowed_names(spark, sf_dir):
    names = D.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return S.allowed_only(D.table(spark, sf_dir, "orders"), names, "o_custkey").select("o_orderkey")


@query("SELECT event_id, CAST(user_id % 2 AS INT) AS rank, CAST(event_id % 2 AS INT) AS from_rank, user_id % 2 <> event_id % 2 AS strange FROM events")
def set06_united_ranks(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2).cast("int").alias("rank"))
    return V.united([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")])


@query("SELECT DISTINCT user_id AS nonce FROM events WHERE event_id % 4 = 1")
def stm08_fresh_rollouts(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("nonce"), (F.col("event_id") % 4).alias("version"))
    return V.fresh_only(rows, "nonce", "version", 1).select("nonce")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_partkey)")
def set05_repeated_sources(spark, sf_dir):
    return S.repeating(D.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT doc_id, doc_id % 4 <> 0 AS holds FROM documents")
def prd12_questions(spark, sf_dir):
    hint = "Answer with the option's letter"
    question = F.concat(F.when(F.col("doc_id") % 4 == 0, "").otherwise("<image>"), F.lit("  Is  it "), "source", F.lit("?\n"), F.lit(hint))
    return D.table(spark, sf_dir, "documents").select("doc_id", V.question_holds(question, F.concat(F.lit("Is it "), "source", F.lit("?"))).alias("holds"))


@query("SELECT doc_id, doc_id % 5 IN (0, 1, 2, 3) AS holds FROM documents")
def prd13_answers(spark, sf_dir):
    answer = F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("doc_id") % 5 + 1).cast("int"))
    return D.table(spark, sf_dir, "documents").select("doc_id", V.answer_holds(answer, F.lit("Q\nA. w\nB. x\nC) y\nD. z")).alias("holds"))


@query("SELECT conv_id, turn, 1 AS images, concat('seen ', role) AS said FROM conversations")
def str15_teacher_messages(spark, sf_dir):
    turns = N.teacher(F.col("text"), F.lit(None).cast("string"))
    swapped = T.with_image(turns, F.concat(F.lit("seen "), "role"))
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.images_of(turns).alias("images"), swapped[1]["content"][0]["text"].alias("said"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def srt08_first_few(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").withColumn("o", F.struct(-F.col("o_totalprice"), "o_orderkey"))
    return S.first_few(rows, "o").select("o_orderkey")


# Record files, written from base tables and read again.

_KINDS = len(D.EXAMPLE_CASES)
_BROKEN = f"CASE doc_id % {_KINDS} {' '.join(f'WHEN {i} THEN {chr(39)}{r}{chr(39)}' for i, (_, r) in enumerate(D.EXAMPLE_CASES) if r)} END"


def _told(rows: DataFrame) -> DataFrame:
    """The document's number, which each line has in it."""
    return rows.withColumn("doc_id", F.coalesce(F.nullif(F.regexp_extract("raw", "#([0-9]+)#", 1), F.lit("")), F.regexp_extract("raw", '"id": "?([0-9]+)', 1)).cast("long"))


@query(f"SELECT doc_id, {_BROKEN} AS rule FROM documents WHERE doc_id % {_KINDS} <> 0")
def src01_broken_lines(spark, sf_dir):
    """What a strict scan tells of each line that breaks the contract of examples."""
    rows = V.parsed(V.lines(spark, D.written_lines(spark, sf_dir, D.EXAMPLE_LINES)))
    return V.violations(rows, V.EXAMPLE).join(_told(rows), ["file", "line"]).select("doc_id", "rule")


@query(f"SELECT concat('#', doc_id, '#') AS id, 'dev' AS split, concat('s/', source, '.png') AS student_image, concat('#', doc_id, '# which?') AS question, lang AS shape, 2 AS slots, 2 AS answers FROM documents WHERE doc_id % {_KINDS} = 0")
def src02_examples(spark, sf_dir):
    """Strictly loaded examples, with facts as text and as objects."""
    path = D.written_lines(spark, sf_dir, D.EXAMPLE_LINES, f"doc_id % {_KINDS} = 0")
    rows = V.parsed(V.lines(spark, path))
    V.raise_on(V.violations(rows, V.EXAMPLE), "examples")
    return V.examples(rows).select("id", "split", "student_image", "question", F.col("facts")["shape"][0].alias("shape"), F.size("facts").alias("slots"), F.size("answers").alias("answers"))


_OUT = "SELECT doc_id, concat(chr(123), '\"id\": \"', doc_id, '\", \"visual_facts\": ', chr(123), '\"color\": \"', lang, '\"', chr(125), ', \"reasoning\": \"so\", \"answer\": \"yes\", \"visual_confidence\": ', CASE doc_id % 4 WHEN 1 THEN '\"high\"' WHEN 2 THEN '0.5' ELSE CAST(doc_id % 101 AS STRING) END, CASE WHEN doc_id % 4 = 3 THEN '' ELSE ', \"conditional_answer_confidence\": 7' END, chr(125)) AS value FROM {documents}"


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 IN (0, 3) THEN doc_id % 101 END AS visual_confidence, CASE doc_id % 4 WHEN 3 THEN 'missing keys: conditional_answer_confidence' WHEN 0 THEN NULL ELSE 'visual_confidence must be int' END AS format_error FROM documents")
def src03_attempts(spark, sf_dir):
    """Permissively loaded outputs: what is malformed is kept with its error."""
    return V.load_attempts(spark, D.written_lines(spark, sf_dir, _OUT), V.OUTPUT).select("id", "visual_confidence", "format_error")


_PROXY = "SELECT doc_id, concat(chr(123), '\"id\": \"', doc_id, '\", \"split\": \"train\", \"student_image\": \"a.png\", \"teacher_image\": \"b.png\", \"question\": \"which?\", \"accepted_answers\": [\"', lang, '\"]', CASE doc_id % 6 WHEN 1 THEN ', \"teacher_evidence\": \" \"' WHEN 2 THEN ', \"teacher_evidence\": 5' WHEN 3 THEN concat(', \"teacher_evidence\": ', chr(123), '\"a\": [1, null]', chr(125)) WHEN 4 THEN ', \"teacher_evidence\": true' WHEN 5 THEN ', \"teacher_evidence\": \"seen\", \"student_image_hint\": \"left\"' ELSE '' END, chr(125)) AS value FROM {documents}"


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang AS answer, CASE WHEN doc_id % 6 = 5 THEN 'left' END AS hint, doc_id % 6 NOT IN (1, 2, 4) AS evidence_holds FROM documents")
def src04_proxy_examples(spark, sf_dir):
    """Proxy examples with their optional fields, and whether their evidence is text or JSON."""
    rows = V.load(spark, D.written_lines(spark, sf_dir, _PROXY), V.PROXY_EXAMPLE, V.PROXY_OPTIONAL)
    return rows.select("id", F.try_variant_get("accepted_answers", "$[0]", "string").alias("answer"), F.col("student_image_hint").alias("hint"), V.evidence_holds(F.col("teacher_evidence")).alias("evidence_holds"))


_SOURCES = "SELECT p.page_id, CAST(p.page_id AS STRING) AS id, CASE p.page_id % 5 WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS split, concat('i', p.page_id % 40, '.png') AS image, CASE p.page_id % 7 WHEN 1 THEN 'XYZ' WHEN 2 THEN sha2('other', 256) WHEN 3 THEN sha2(concat('image', (p.page_id % 40) % 30), 256) END AS sha256, p.page_id % 3 AS box FROM {pages} p"


@query(
    f"""WITH s AS ({D.duck(_SOURCES).replace("sha2('other', 256)", "sha256('other')").replace("sha2(concat('image', (p.page_id % 40) % 30), 256)", "sha256(concat('image', (p.page_id % 40) % 30))")}), b AS (SELECT *, page_id % 40 < 35 AS there, (page_id % 40) % 30 AS content FROM s),
x AS (SELECT content FROM b WHERE there GROUP BY content HAVING count(DISTINCT split) > 1)
SELECT id, 'split is train or validation' AS rule FROM b WHERE split = 'test' UNION ALL SELECT id, 'image exists' FROM b WHERE NOT there UNION ALL SELECT id, 'digest is SHA-256' FROM b WHERE page_id % 7 = 1 UNION ALL SELECT id, 'digest is the file''s' FROM b WHERE there AND page_id % 7 IN (1, 2)
UNION ALL SELECT id, 'there is a box' FROM b WHERE box = 0 UNION ALL SELECT id, 'box is in the image' FROM b WHERE there AND box = 1 UNION ALL SELECT id, 'evidence is text or JSON' FROM b WHERE page_id % 11 = 0 UNION ALL SELECT id, 'image is in one split' FROM b WHERE there AND content IN (SELECT content FROM x)"""
)
def src06_source_rows(spark, sf_dir):
    """Source rows against images: files, digests, boxes, evidence, and contents in two splits."""
    from .sources.manifests import source_problems

    rows = D.view(spark, sf_dir, _SOURCES)
    box = F.when(F.col("box") == 1, F.array(F.lit(0), F.lit(0), F.lit(11), F.lit(5))).when(F.col("box") == 2, F.array(F.lit(0), F.lit(0), F.lit(10), F.lit(5)))
    rows = rows.withColumns({"box": box, "evidence": F.try_parse_json(F.when(F.col("page_id") % 11 == 0, F.lit("5")).otherwise(F.lit('{"a": 1}')))})
    images = spark.range(35).select(F.concat(F.lit("i"), F.col("id"), F.lit(".png")).alias("file"), F.sha2(F.concat(F.lit("image"), F.col("id") % 30), 256).alias("sha256"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    return source_problems(rows, images)


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS index, r_regionkey AS k FROM region")
def src05_numbered_rows(spark, sf_dir):
    """Rows of one file by their place, if it has the rows and the digest that are asked for."""
    from .sources.manifests import digest, numbered
    from .sources.scratch import folder

    path = folder(spark, "rows")
    D.table(spark, sf_dir, "region").orderBy("r_regionkey").coalesce(1).select(F.to_json(F.struct("r_regionkey")).alias("value")).write.text(path)
    files = digest(spark, path).collect()
    found = numbered(spark, files[0]["file"], D.table(spark, sf_dir, "region").count(), files[0]["sha256"])
    return found.select("index", F.try_variant_get("doc", "$.r_regionkey", "int").alias("k"))


#: Rows of source pairs: each kind breaks one rule, kind 0 none.
_PAIR_RULES = {
    1: "fields are the told ones", 2: "images has one name in its folder", 3: "original_images has one name in its folder", 4: "box is of whole numbers with an area",
    5: "box is of whole numbers with an area", 6: "extra fields are the told ones", 7: "question is the cleaned one with a hint", 8: "answer is a letter of the options", 9: "teacher_images is new",
}
_PAIR_LINES = """
SELECT doc_id, concat(chr(123), '"images": ["', CASE WHEN k = 2 THEN '../' ELSE 'images/' END, doc_id, '.png"], "teacher_images": ["teacher_images/', CASE WHEN k = 9 THEN doc_id - 1 ELSE doc_id END, '.png"], "original_images": ["original_images/', source, '.png"', CASE WHEN k = 3 THEN ', "original_images/b.png"' ELSE '' END, '], "bbox": ', CASE k WHEN 4 THEN '[0, 0, 5, 0]' WHEN 5 THEN '[0, 0, 5, 1.5]' ELSE '[0, 0, 5, 1]' END,
  ', "problem": "', CASE WHEN k = 7 THEN '' ELSE '<image>' END, asked, ' Answer with the option''s letter", "answer": "', CASE WHEN k = 8 THEN 'E' ELSE 'B' END, '", "extra_info": ', chr(123), '"answer": "', CASE WHEN k = 8 THEN 'E' ELSE 'B' END, '", "question": "', asked, '"', CASE WHEN k = 6 THEN ', "z": 1' ELSE '' END, chr(125), CASE WHEN k = 1 THEN ', "z": 1' ELSE '' END, chr(125)) AS value
FROM (SELECT doc_id, source, CAST(doc_id % 10 AS INT) AS k, concat('Which ', lang, '?', chr(92), 'nA. w', chr(92), 'nB. x', chr(92), 'nC. y', chr(92), 'nD. z') AS asked FROM {documents}) d"""


@query(f"SELECT index, rule FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS index, CASE doc_id % 10 {' '.join(f'WHEN {k} THEN {_quoted(rule)}' for k, rule in _PAIR_RULES.items())} END AS rule, doc_id % 10 = 9 AND NOT coalesce(lag(doc_id) OVER (ORDER BY doc_id) = doc_id - 1, false) AS alone FROM documents) x WHERE rule IS NOT NULL AND NOT alone")
def src05_source_pairs(spark, sf_dir):
    """Lines of source pairs, numbered over one file: exact fields, names in their folders and not met before, boxes, questions, answers."""
    from .sources.manifests import numbered, pair_problems
    from .sources.scratch import folder, stored

    path = folder(spark, "pairs")
    D.view(spark, sf_dir, _PAIR_LINES).orderBy("doc_id").select("value").coalesce(1).write.text(path)
    return pair_problems(V.parsed(stored(numbered(spark, path).select("index", "raw"), "pairs_rows")))


@query("SELECT o_orderstatus AS split, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def snk02_manifest_round_trip(spark, sf_dir):
    """JSON lines by split, written whole and read again."""
    from .plans.reports import write_manifest
    from .sources.scratch import folder

    path = folder(spark, "manifest")
    write_manifest(D.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("split"), "o_orderkey", "o_totalprice"), path)
    return spark.read.schema("o_orderkey long, o_totalprice double, split string").json(path).groupBy("split").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def snk06_appended_events(spark, sf_dir):
    """An event log that is appended to twice."""
    from .plans.reports import append_events
    from .sources.scratch import folder

    path, rows = folder(spark, "log"), D.table(spark, sf_dir, "events").select("event_id", "event_type")
    append_events(rows, path)
    append_events(rows, path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT concat('[', chr(10), string_agg(concat('  {', chr(10), '    \"name\": \"', r_name, '\",', chr(10), '    \"nations\": ', n, chr(10), '  }'), concat(',', chr(10)) ORDER BY r_name), chr(10), ']', chr(10)) AS report FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)")
def snk01_json_report(spark, sf_dir):
    from .plans.reports import as_json

    named = D.table(spark, sf_dir, "nation").join(D.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return spark.createDataFrame([(as_json(named.groupBy(F.col("r_name").alias("name")).agg(F.count("*").alias("nations")).orderBy("name")),)], "report string")


@query("SELECT concat('## Nations', chr(10), chr(10), '| name | share |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', r_name, ' | ', printf('%.4f', n / 25.0), ' |'), chr(10) ORDER BY r_name), chr(10)) AS report FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)")
def snk07_markdown_report(spark, sf_dir):
    from .plans.reports import as_markdown

    named = D.table(spark, sf_dir, "nation").join(D.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return spark.createDataFrame([(as_markdown(named.groupBy(F.col("r_name").alias("name")).agg((F.count("*") / F.lit(25.0)).alias("share")).orderBy("name"), "Nations"),)], "report string")


_SECTIONED = {"Counts": ("concat('| ', condition, ' | ', count(*), ' | ', sum(vision_tokens), ' | ', count(*) FILTER (proxy_fallback), ' |')", "s"), "Zero gaps": ("concat('| ', condition, ' | ', printf('%.4f', avg(CAST(corrected_gap = 0 AS INT))), ' |')", "t")}


@query(
    f"WITH {TOK}, {SAM}, " + ", ".join(f"x{i} AS (SELECT string_agg(line, chr(10) ORDER BY condition) AS body FROM (SELECT condition, {line} AS line FROM {source} GROUP BY condition) y)" for i, (line, source) in enumerate(_SECTIONED.values()))
    + " SELECT concat('# Conditions', chr(10), chr(10), '## Counts', chr(10), chr(10), 'Means are of examples.', chr(10), chr(10), '| condition | examples | tokens | fallbacks |', chr(10), '| --- | --- | --- | --- |', chr(10), x0.body, chr(10), chr(10), '## Zero gaps', chr(10), chr(10), '| condition | zero_fraction |', chr(10), '| --- | --- |', chr(10), x1.body, chr(10)) AS report FROM x0, x1"
)
def snk07_sectioned_report(spark, sf_dir):
    """A Markdown report of two sections over conditions."""
    from .plans.reports import as_sections

    tokens, samples = D.view(spark, sf_dir, D.TOKENS), D.view(spark, sf_dir, D.SAMPLES)
    counts = samples.groupBy("condition").agg(F.count("*").alias("examples"), F.sum("vision_tokens").alias("tokens"), F.count_if("proxy_fallback").alias("fallbacks")).orderBy("condition")
    zero = tokens.groupBy("condition").agg(F.avg((F.col("corrected_gap") == 0).cast("int")).alias("zero_fraction")).orderBy("condition")
    return spark.createDataFrame([(as_sections("Conditions", [("Counts", "Means are of examples.", counts), ("Zero gaps", "", zero)]),)], "report string")


# Contracts of examples, attempts and samples.


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 5 WHEN 0 THEN 'aliases differ from the canonical value' WHEN 1 THEN 'answers differ' WHEN 2 THEN 'answers are not empty' WHEN 3 THEN 'there are facts' END AS rule FROM part WHERE p_partkey % 5 <> 4")
def prd03_example_rules(spark, sf_dir):
    """Aliases and answers that are the same when folded, empty answers, and no facts."""
    kind = F.col("p_partkey") % 5
    alias = F.when(kind == 0, F.concat(F.lit(" "), F.upper("p_brand"))).otherwise(F.lit("another"))
    facts = F.when(kind == 3, F.create_map().cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("brand"), F.array("p_brand", alias)))
    answers = F.array(F.lit("Yes"), F.when(kind == 1, F.lit("ＹＥＳ")).when(kind == 2, F.lit("\t")).otherwise(F.lit("yeah")))
    return V.example_rules(D.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), facts.alias("facts"), answers.alias("answers")))


@query("SELECT event_id, event_id % 6 IN (0, 3) AS holds FROM events")
def prd06_parse_or_error(spark, sf_dir):
    kind = F.col("event_id") % 6
    parsed = F.when(kind.isin(0, 1), "a").when(kind == 2, "b")
    error = F.when(kind.isin(1, 3), "bad").when(kind == 4, " ")
    return D.table(spark, sf_dir, "events").select("event_id", V.parsed_or_error(parsed, F.lit("a"), error).alias("holds"))


@query(f"WITH {SAM}, m AS (SELECT example_id, condition, vision_tokens - 2 AS vision_tokens, proxy_fallback, visual_proxy + 0.05 AS visual_proxy, CASE WHEN vision_tokens % 4 = 0 THEN NULL ELSE raw_js END AS raw_js FROM s) SELECT concat(example_id, '/', condition) AS id, unnest(list_filter([CASE WHEN vision_tokens < 0 THEN 'vision_tokens is at least 0' END, CASE WHEN visual_proxy > 1 THEN 'visual_proxy is a probability' END, CASE WHEN proxy_fallback THEN 'fallback means proxy 0' END, CASE WHEN vision_tokens <> 0 AND raw_js IS NULL THEN 'raw_js is there with tokens' END], lambda x: x IS NOT NULL)) AS rule FROM m")
def prd16_sample_contract(spark, sf_dir):
    rows = D.view(spark, sf_dir, D.SAMPLES).withColumns({"id": F.concat("example_id", F.lit("/"), "condition"), "raw_js": F.when(F.col("vision_tokens") % 4 != 0, F.col("raw_js")), "visual_proxy": F.col("visual_proxy") + 0.05})
    return V.rules_table(rows.withColumn("vision_tokens", F.col("vision_tokens") - 2), "id", V.sample_rules(["raw_js"]))


# Rollouts, from token ids on.


@query("SELECT step, count(*) AS attempts, count(CASE WHEN p > 0 THEN 1 END) AS diagnostic_rows, CAST(sum(p) AS DOUBLE) AS diagnostic_positions, count(CASE WHEN p > 0 THEN 1 END) / count(*) AS diagnostic_coverage FROM (SELECT n_chars % 16 AS step, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 4 END AS p FROM documents) GROUP BY step", "diagnostic_positions diagnostic_coverage")
def agg23_diagnostic_coverage(spark, sf_dir):
    rows = D.table(spark, sf_dir, "documents").select((F.col("n_chars") % 16).alias("step"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 4).alias("positions"))
    return C.diagnostic_coverage(rows, "step", "positions")


@query("SELECT user_id % 20 AS batch, count(*) AS rollout_count, avg(value) AS mean_reward, avg(-value * value) AS mean_calibration, true AS finite FROM events GROUP BY 1", "mean_reward mean_calibration")
def agg39_batch_means(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("batch"), F.col("value").alias("reward"), (-F.col("value") * F.col("value")).alias("calibration"))
    return G.batch_means(rows, "batch", ["reward", "calibration"])


@query("SELECT event_id, event_id // 5 AS place FROM events WHERE event_id % 5 = 2 AND event_id // 5 BETWEEN 50 AND 99")
def win03_rank_slice(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").where("event_id % 5 = 2").select("event_id", F.floor(F.col("event_id") / 5).alias("place"))
    return G.rank_slice(rows, "place", 4, 1, 200)


@query(f"WITH {SAM}, c AS (SELECT example_id, vision_tokens, corrected_gap FROM s WHERE condition = 'click') SELECT e.example_id, coalesce(CASE WHEN vision_tokens >= 3 THEN corrected_gap END, 0.0) AS certainty, CASE WHEN vision_tokens >= 3 THEN corrected_gap END AS corrected_gap, CASE WHEN vision_tokens >= 3 THEN vision_tokens ELSE 0 END AS vision_tokens, coalesce(vision_tokens, 0) < 3 AS fallback FROM (SELECT DISTINCT example_id FROM s) e LEFT JOIN c USING (example_id)", "certainty corrected_gap")
def arr06_fallback_rows(spark, sf_dir):
    """Examples without tokens of a condition, or with too few, have the row of no certainty."""
    samples = D.view(spark, sf_dir, D.SAMPLES)
    none = F.lit(None).cast("double")
    certainty = samples.where("condition = 'click'").select("example_id", F.col("corrected_gap").alias("certainty"), "raw_js", "baseline_js", "corrected_gap", "teacher_entropy", none.alias("uncertainty"), F.col("vision_tokens").cast("long").alias("vision_tokens"), F.col("proxy_fallback").alias("fallback"))
    return K.with_fallback(samples.select("example_id").distinct(), certainty, "example_id").select("example_id", "certainty", "corrected_gap", "vision_tokens", "fallback")


@query(r"SELECT doc_id, trim(replace(concat('<image>', lang, ' <image> ', source), '<image>', ''), ' ') AS problem FROM documents")
def str16_clean_problems(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", T.without_image_marks(F.concat(F.lit("<image>"), "lang", F.lit(" <image> "), "source", F.lit("\n\u00a0"))).alias("problem"))


@query(f"WITH {_PARSED}, q AS (SELECT doc_id, length(completion) AS n, CASE doc_id % 9 WHEN 5 THEN strpos(completion, '</answer><confidence>') + 8 ELSE strpos(completion, '<confidence>') - 1 END AS b FROM c), t AS (SELECT *, CAST(ceil(n / 7) AS INT) AS body, CASE WHEN b < 0 THEN CAST(ceil(n / 7) AS INT) ELSE CAST(floor(b / 7) AS INT) END AS content FROM q) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN body + 1 ELSE body END AS tokens, content AS content_tokens, CASE WHEN doc_id % 2 = 0 THEN body + 1 ELSE body END - content AS report_tokens, false AS unverified, NULL::VARCHAR AS problem FROM t")
def str20_prepared_rollouts(spark, sf_dir):
    """Tokens of seven characters, half of them with a terminal one; a third with offsets that don't hold."""
    from .functions import rollouts as O

    rows = D.view(spark, sf_dir, D.COMPLETIONS)
    count = F.ceil(F.length("completion") / 7).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("completion", i * 7 + 1, F.lit(7)))
    ids = F.concat(F.sequence(F.lit(1), count), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    short = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * 7).alias("start"), F.least(i * 7 + 7, F.length("completion")).alias("end")))
    offsets = F.when(F.col("doc_id") % 3 == 0, F.slice(short, 1, 1)).otherwise(short)
    made = O.prepared(rows.withColumns({"ids": ids, "pieces": pieces, "offsets": offsets}), "ids", "pieces", F.array(F.lit(0)), "offsets")
    total = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x)
    return made.select("doc_id", F.size("ids").alias("tokens"), total("content_mask").alias("content_tokens"), total("report_mask").alias("report_tokens"), F.array_contains("format_errors", "token_spans_unverified").alias("unverified"), "problem")


@query("SELECT page_id, sha256(concat('RGB:', page_id % 7, 'x', 3, ':', url)) AS digest FROM pages")
def hsh07_pixel_digests(spark, sf_dir):
    from .functions.digests import pixel_sha256

    return D.table(spark, sf_dir, "pages").select("page_id", pixel_sha256(F.col("page_id") % 7, F.lit(3), F.col("url").cast("binary")).alias("digest"))


@query("SELECT user_id, event_id, value, highest FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM events) WHERE value < highest", "value highest")
def stm03_falling_states(spark, sf_dir):
    from .streaming.telemetry import falling_states

    return falling_states(D.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query(f"WITH {R} SELECT step, sum(CAST(answer_correct AS INT)) AS good, count(*) AS attempts, avg(answer_confidence) AS confidence FROM r WHERE step < 3 GROUP BY step", "confidence")
def stm02_tracked_windows(spark, sf_dir):
    """Windows of three steps, published one after another by a tracker with counters that rise."""
    from .streaming.telemetry import Tracker

    sent: list[dict] = []
    tracker = Tracker(sent.append, lambda rows: rows.agg(F.sum(F.col("answer_correct").cast("int")).alias("good"), F.count("*").alias("attempts"), F.avg("answer_confidence").alias("confidence")))
    rows = D.rollouts(spark, sf_dir)
    for step in range(3):
        tracker.record(rows.where(F.col("step") == step))
        tracker.log_training({"optimizer_successful_updates": step}, step)
    tracker.finish()
    found = [(x["trainer/state_global_step"], x["train/good"], x["train/attempts"], x.get("train/confidence")) for x in sent if x.get("train/attempts")]
    return spark.createDataFrame(found, "step int, good long, attempts long, confidence double")


# Manifests.

_PAYLOAD = "concat(chr(123), '\"accepted_answers\": [\"yes\", \"', lang, '\"], \"id\": \"#', doc_id, '#\", \"question\": \"#', doc_id, '# which?\", \"required_visual_facts\": ', facts, ', \"split\": \"dev\", \"student_image\": \"/data/s/', source, '.png\", \"teacher_image\": \"/data/t/', source, '.png\"', chr(125))"
_FACTS_JSON = "concat(chr(123), '\"color\": ', chr(123), '\"aliases\": [], \"canonical\": \"red\"', chr(125), ', \"shape\": ', chr(123), '\"aliases\": [\"any\"], \"canonical\": \"', lang, '\"', chr(125), chr(125))"


@query(f"WITH f AS (SELECT *, {_FACTS_JSON} AS facts FROM documents WHERE doc_id % {_KINDS} = 0) SELECT concat('#', doc_id, '#') AS example_id, concat('/data/s/', source, '.png') AS image, facts AS required_visual_facts_json, {_PAYLOAD} AS example_payload, sha256(concat('#', doc_id, '# which?', {_quoted(N.EARLIER_ASK)}, chr(123), '\"color\": \"visible value\", \"shape\": \"visible value\"', chr(125), {_quoted(N.EARLIER_REST)})) AS prompt FROM f")
def src18_training_rows(spark, sf_dir):
    """Training rows of a manifest's examples, with the record and its facts as canonical JSON."""
    from .sources.manifests import gold_rows

    rows = V.parsed(V.lines(spark, D.written_lines(spark, sf_dir, D.EXAMPLE_LINES, f"doc_id % {_KINDS} = 0")))
    found = gold_rows(V.examples(rows), "/data/")
    return found.select("example_id", "image", "required_visual_facts_json", "example_payload", F.sha2(F.col("prompt")[0]["content"][1]["text"], 256).alias("prompt"))


@query("SELECT concat('i', page_id % 9, '.png') AS image, count(*) AS rows, CASE WHEN page_id % 9 < 6 THEN 'pixels of ' || (page_id % 9) END AS content FROM pages GROUP BY page_id % 9")
def src20_image_contents(spark, sf_dir):
    """Rows joined to the bytes of their images' files; some images have none."""
    from .sources.manifests import with_content

    rows = D.table(spark, sf_dir, "pages").select(F.concat(F.lit("i"), F.col("page_id") % 9, F.lit(".png")).alias("image"))
    files = spark.range(6).select(F.concat(F.lit("i"), "id", F.lit(".png")).alias("path"), F.concat(F.lit("pixels of "), F.col("id").cast("string")).cast("binary").alias("content"))
    return with_content(rows, "image", files).groupBy("image").agg(F.count("*").alias("rows"), F.first(F.col("image_bytes").cast("string")).alias("content"))


@query("SELECT 2 * count(*) AS lines, count(*) AS rows, CAST(sum(r_regionkey) AS BIGINT) AS keys FROM region")
def src07_scanned_rows(spark, sf_dir):
    """A scan that passes over blank lines."""
    from .sources.manifests import scanned
    from .sources.scratch import folder

    path = folder(spark, "scan")
    both = D.table(spark, sf_dir, "region").select(F.explode(F.array(F.to_json(F.struct("r_regionkey")), F.lit("  "))).alias("value"))
    both.write.text(path)
    counted = V.lines(spark, path).agg(F.count("*").alias("lines"))
    return counted.crossJoin(F.broadcast(scanned(spark, path).agg(F.count("*").alias("rows"), F.sum(F.try_variant_get("doc", "$.r_regionkey", "bigint")).alias("keys"))))


@query("WITH p AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS index, n_nationkey AS k FROM nation) SELECT CAST(k AS VARCHAR) AS example_id, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'is in the pack' END, CASE WHEN k % 5 = 0 OR k % 5 = 1 THEN 'has its place' END, CASE WHEN k % 5 = 0 OR k % 7 = 2 THEN 'has the version' END], lambda x: x IS NOT NULL)) AS rule FROM p")
def src11_pack_mismatches(spark, sf_dir):
    """A token pack against its manifest: ids that are missing, out of place, or of another version."""
    from .sources.manifests import pack_mismatches

    names = [str(r["n_nationkey"]) for r in D.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    k = F.col("example_id").cast("int")
    pack = spark.createDataFrame(list(enumerate(names)), "index int, example_id string").where(k % 5 != 0)
    pack = pack.select("example_id", (F.col("index") + F.when(k % 5 == 1, 100).otherwise(0)).alias("index"), F.when(k % 7 == 2, "old").otherwise("new").alias("proxy_output_protocol"))
    return pack_mismatches(pack, {"selected_ids": names}, "new")


_PROMPTS = "5f" * 32
_PACK_ROWS = {
    "row has the version": "doc_id % 11 = 1", "row has the prompts' digest": "doc_id % 13 = 2", "reason_text is text or null": "doc_id % 7 IN (3, 4)", "format_errors are texts": "doc_id % 9 IN (2, 3)",
    "prompt digest is SHA-256": "doc_id % 17 = 4", "id is the manifest's at its place": "doc_id % 19 = 5",
}
_PACK_HEADS = {
    "manifest is of a completed preparation": "source LIKE '%3'", "manifest has the version": "source LIKE '%1'", "manifest has the prompts' digest": "lang = 'de'", "pack has the manifest's digest": "source LIKE '%4'",
    "manifest has the number of rows": "source LIKE '%2'",
}


def _broken_sql(rules: dict[str, str]) -> str:
    quoted = ", ".join(f"CASE WHEN {when} THEN '{rule.replace(chr(39), 2 * chr(39))}' END" for rule, when in rules.items())
    return f"unnest(list_filter([{quoted}], lambda x: x IS NOT NULL)) AS rule"


@query(f"WITH d AS (SELECT *, concat(lang, '/', source) AS label, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS place FROM documents), g AS (SELECT label, any_value(lang) AS lang, any_value(source) AS source, count(*) AS n FROM d GROUP BY label) SELECT label, place, {_broken_sql(_PACK_ROWS)} FROM d UNION ALL SELECT label, n, 'id is the manifest''s at its place' FROM g WHERE source LIKE '%2' UNION ALL SELECT label, NULL, {_broken_sql(_PACK_HEADS)} FROM g")
def src11_pack_protocol(spark, sf_dir):
    """A pack of each language and source, written and read again, against its manifest: of its rows, ids and bytes some are changed."""
    from .sources.files import digests, listing
    from .sources.packs import protocol_problems
    from .sources.scratch import folder, stored

    path, k = folder(spark, "packs"), F.col("doc_id")
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    string = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    whole = F.sha2(F.coalesce("text", F.lit("")), 256)
    reason = F.when(k % 7 == 3, None).when(k % 7 == 4, field("reason_text", F.lit("5"))).when(k % 7 == 5, field("reason_text", F.lit("null"))).otherwise(field("reason_text", string(F.substring(whole, 1, 8))))
    errors = F.when(k % 9 == 1, '["a"]').when(k % 9 == 2, '["a",null]').when(k % 9 == 3, '"a"').otherwise("[]")
    row = F.concat_ws(
        ",", field("example_id", string(k.cast("string"))), field("proxy_output_protocol", F.when(k % 11 == 1, '"old"').otherwise('"new"')), field("proxy_prompt_source_sha256", string(F.when(k % 13 == 2, "5f").otherwise(_PROMPTS))),
        reason, field("format_errors", errors), field("prompt_token_sha256", string(F.when(k % 17 == 4, F.concat(whole, F.lit("0"))).otherwise(whole))),
    )
    docs = D.table(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.concat(F.lit("{"), row, F.lit("}")).alias("value"))
    docs.repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id").drop("doc_id").write.partitionBy("lang", "source").text(path)
    part = lambda name: F.regexp_extract("file", f"/{name}=([^/]*)/", 1)
    label = F.concat(part("lang"), F.lit("/"), part("source")).alias("label")
    packs = V.parsed(V.lines(spark, path)).select(label, (F.col("line") - 1).alias("place"), "doc")
    own = stored(digests(listing(spark, path).where(F.col("file").rlike("/part-[^/]*$"))).select(label, "sha256"), "digests")
    ends = lambda n: F.col("label").endswith(n)
    counts = packs.groupBy("label").agg(F.count("*").alias("n"))
    changed = [F.lit("prepare").alias("mode"), F.when(ends("3"), "failed").otherwise("completed").alias("status"), F.when(ends("1"), "old").otherwise("new").alias("version")]
    changed += [F.when(F.col("label").startswith("de/"), "5f").otherwise(_PROMPTS).alias("prompts_sha256"), F.when(ends("4"), F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("pack_sha256"), F.when(ends("2"), F.col("n") + 1).otherwise(F.col("n")).alias("rows")]
    heads = own.join(counts, "label").select("label", *changed)
    name = F.try_variant_get("doc", "$.example_id", "string")
    ids = packs.select("label", "place", F.when(name.cast("long") % 19 == 5, F.concat(name, F.lit("x"))).otherwise(name).alias("example_id"))
    ids = ids.unionAll(counts.where(ends("2")).select("label", F.col("n").alias("place"), F.lit("one more")))
    return protocol_problems(packs, own, heads, ids, "new", _PROMPTS)


@query("SELECT CAST(24 - n_nationkey AS INT) AS pos, CAST(n_nationkey AS VARCHAR) AS id, n_name FROM nation WHERE 24 - n_nationkey < 20")
def src12_listed_rows(spark, sf_dir):
    """The rows of a frozen list in its order, of which the first twenty are taken."""
    import json

    from .sources.manifests import rows_listed

    rows = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), "n_name")
    return rows_listed(rows, json.dumps({"subset_ids": [str(i) for i in range(24, -1, -1)]}), "id", 25, 20).select("pos", "id", "n_name")


@query("SELECT r_name, row_number() OVER (PARTITION BY r_regionkey % 3 ORDER BY r_regionkey) = 1 AS written, first_value(r_name) OVER (PARTITION BY r_regionkey % 3 ORDER BY r_regionkey) AS kept FROM region")
def snk05_refused_overwrite(spark, sf_dir):
    """A report for each region, of which some share a file: that is written whole and once, and the first's text stays."""
    from .plans.reports import write_new
    from .sources.scratch import folder

    path, out = folder(spark, "new"), []
    for r in D.table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        name = f"{path}/report{r['r_regionkey'] % 3}.txt"
        try:
            write_new(spark, name, r["r_name"])
            out.append((r["r_name"], name.rsplit("/", 1)[1], True))
        except FileExistsError:
            out.append((r["r_name"], name.rsplit("/", 1)[1], False))
    found = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("kept"))
    return spark.createDataFrame(out, "r_name string, file string, written boolean").join(found, "file").select("r_name", "written", "kept")


@query("SELECT concat(n_name, '.png') AS name, n_nationkey + 1 AS width, 2 AS height FROM nation WHERE n_regionkey <> 1")
def src16_archived_images(spark, sf_dir):
    """Images of a gzipped tar in three parts; those of one region aren't allowed."""
    from .sources.archives import extracted, gray_png, packed
    from .sources.scratch import folder

    nations = D.table(spark, sf_dir, "nation").collect()
    data, path = packed({f"{r['n_name']}.png": gray_png(r["n_nationkey"] + 1, 2) for r in nations}), folder(spark, "archive")
    cuts = [data[i * len(data) // 3 : (i + 1) * len(data) // 3] for i in range(3)]
    jvm = spark._jvm
    for i, part in enumerate(cuts):
        to = jvm.org.apache.hadoop.fs.Path(f"{path}/part{i}")
        out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to)
        out.write(bytearray(part))
        out.close()
    allowed = [f"{r['n_name']}.png" for r in nations if r["n_regionkey"] != 1]
    rows = spark.createDataFrame([("a", [f"{path}/part{i}" for i in range(3)], allowed, True)], "label string, paths array<string>, allowed array<string>, complete boolean")
    return extracted(rows).where("name IS NOT NULL AND problem IS NULL").select("name", "width", "height")


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, unnest(['normal', 'blur', 'blank', 'occluded', 'noise']) AS variant, unnest([true, true, false, page_id % 2 = 1, false]) AS same FROM pages")
def arr16_image_variants(spark, sf_dir):
    """Variants of images of one gray: that of half of them is the gray that covers."""
    from .functions.images import variants

    gray = F.when(F.col("page_id") % 2 == 1, F.unhex(F.lit("7F"))).otherwise(F.unhex(F.lit("10")))
    rows = D.table(spark, sf_dir, "pages").select("page_id", F.lit(4).alias("width"), F.lit(2).alias("height"), F.unhex(F.repeat(F.hex(gray), F.lit(24))).alias("pixels"))
    made = variants(rows, "page_id").join(rows.select(F.col("page_id").cast("string").alias("page_id"), F.col("pixels").alias("own")), "page_id")
    return made.select("page_id", "variant", F.when(F.col("variant") == "blank", F.lit(False)).otherwise(F.col("pixels") == F.col("own")).alias("same"))


def _html_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, width, height, pixels, box): the bytes of each page as an image of 24 pixels a row, and a box within, beside or around it."""
    pages = D.table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("b"))
    rows = F.floor(F.octet_length("b") / 72).cast("int")
    pages = pages.withColumn("height", rows).withColumn("width", F.lit(24)).withColumn("pixels", F.substring("b", 1, 72 * F.col("height")))
    k = F.col("page_id")
    box = F.when(k % 5 == 0, F.lit(None).cast("array<int>")).otherwise(F.array(*[x.cast("int") for x in (k % 7, k % 3, k % 7 + 1 + k % 19, k % 3 + 1 + k % 11)]))
    return pages.select("page_id", "width", "height", "pixels", box.alias("box"))


@query("WITH p AS (SELECT concat('pages ', page_id // 200) AS label, page_id, CAST(strlen(coalesce(html, '')) // 72 AS INT) AS height FROM pages) SELECT label, concat(page_id, '.png') AS name, 24 AS width, height, true AS same, NULL::BIGINT AS ignored FROM p WHERE page_id % 5 <> 1 UNION ALL SELECT label, NULL, NULL, NULL, NULL, count(CASE WHEN page_id % 5 = 1 THEN 1 END) FROM p GROUP BY label")
def src16_packed_images(spark, sf_dir):
    """Every page's bytes as an image, packed in archives of 200 pages in parts, and taken out again; of each archive a fifth isn't asked for."""
    from .sources.archives import as_png, extracted, written
    from .sources.scratch import folder, stored

    label = F.concat(F.lit("pages "), F.floor(F.col("page_id") / 200).cast("string")).alias("label")
    rows = _html_images(spark, sf_dir).select(label, "page_id", F.concat("page_id", F.lit(".png")).alias("name"), as_png("width", "height", "pixels").alias("content"))
    rows = stored(rows, "images")
    archives = written(rows, folder(spark, "archives"), 1 << 20)
    asked = rows.where("page_id % 5 <> 1").groupBy("label").agg(F.collect_list("name").alias("allowed"))
    found = extracted(archives.join(asked, "label").withColumn("complete", F.lit(True))).where("problem IS NULL")
    own = rows.select("label", "name", F.sha2("content", 256).alias("_own"))
    return found.join(own, ["label", "name"], "left").select("label", "name", "width", "height", (F.col("sha256") == F.col("_own")).alias("same"), "ignored")


@query()
def arr16_variant_digests(spark, sf_dir):
    """Digests of all variants of every page's bytes as an image; tests hold them against plain loops."""
    from .functions.digests import pixel_sha256
    from .functions.images import variants

    rows = _html_images(spark, sf_dir)
    sizes = rows.select(F.col("page_id").cast("string").alias("page_id"), "width", "height")
    return variants(rows.where("height > 0"), "page_id").join(sizes, "page_id").select("page_id", "variant", pixel_sha256(F.col("width"), F.col("height"), F.col("pixels")).alias("digest"))


@query()
def snk11_teacher_views(spark, sf_dir):
    """Digests of student and teacher views of every page's bytes as an image; tests hold them against plain loops."""
    from .functions.digests import pixel_sha256
    from .functions.images import teacher_views

    found = teacher_views(_html_images(spark, sf_dir), "page_id")
    return found.select("page_id", "view", "width", "height", "problem", pixel_sha256(F.col("width"), F.col("height"), F.col("pixels")).alias("digest"))


@query("WITH h AS (SELECT *, concat('{\"dtype\":\"torch.uint8\",\"key\":\"url\",\"shape\":[1,', strlen(url), ']}') AS head FROM pages) SELECT page_id, sha256(unhex(printf('%016x', strlen(head))) || encode(head) || unhex(printf('%016x', strlen(url))) || encode(url)) AS digest FROM h")
def hsh06_tensor_digests(spark, sf_dir):
    from .functions.digests import tensor_sha256

    part = F.struct(F.lit("url").alias("key"), F.lit("torch.uint8").alias("dtype"), F.array(F.lit(1), F.octet_length("url")).alias("shape"), F.col("url").cast("binary").alias("bytes"))
    return D.table(spark, sf_dir, "pages").select("page_id", tensor_sha256(F.array(part)).alias("digest"))


# Round trips, seeds and small records.


@query(f"SELECT concat('#', doc_id, '#') AS id, 'dev' AS split, concat('s/', source, '.png') AS student_image, concat('#', doc_id, '# which?') AS question, lang AS shape, 2 AS slots, 2 AS answers FROM documents WHERE doc_id % {_KINDS} = 0")
def jsn01_round_trip(spark, sf_dir):
    """Examples written as JSON lines and loaded again are what they were."""
    from .sources.scratch import folder

    first = V.parsed(V.lines(spark, D.written_lines(spark, sf_dir, D.EXAMPLE_LINES, f"doc_id % {_KINDS} = 0")))
    path = folder(spark, "again")
    V.example_lines(V.examples(first)).write.text(path)
    rows = V.parsed(V.lines(spark, path))
    V.raise_on(V.violations(rows, V.EXAMPLE), "examples")
    return V.examples(rows).select("id", "split", "student_image", "question", F.col("facts")["shape"][0].alias("shape"), F.size("facts").alias("slots"), F.size("answers").alias("answers"))


@query("SELECT r_name AS condition, n_name AS metric, CAST(CAST('0x' || substr(sha256(concat('7|', r_name, '|', n_name, '|all')), 1, 16) AS UBIGINT) AS DECIMAL(20,0)) AS seed FROM nation JOIN region ON n_regionkey = r_regionkey")
def agg30_metric_seeds(spark, sf_dir):
    rows = D.table(spark, sf_dir, "nation").join(D.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("condition"), F.col("n_name").alias("metric"), F.lit("all").alias("scope"))
    return rows.select("condition", "metric", P.metric_seed(7).alias("seed"))


@query("SELECT o_orderpriority, o_orderstatus, candidates, CASE WHEN candidates >= 640 THEN 512 WHEN candidates >= 320 THEN 256 END AS train, CASE WHEN candidates >= 640 THEN 128 WHEN candidates >= 320 THEN 64 END AS validation FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS candidates FROM orders GROUP BY ALL)")
def srt06_split_sizes(spark, sf_dir):
    """Sizes of the splits that a group's candidates suffice for; none for too few."""
    groups = D.table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("candidates"))
    sizes = S.sizes_for(F.col("candidates"))
    return groups.select("*", sizes["train"].alias("train"), sizes["validation"].alias("validation"))


# Streams: rows arrive in four files, one a batch, and each stream is stopped after two and started again.


def _arrived(spark: SparkSession, rows: DataFrame, start) -> None:
    """start: a function of a stream of the rows and a checkpoint that gives a running query. rows: with ``batch``, 0 to 3."""
    from .sources.scratch import folder, stored
    from .streaming.telemetry import stream

    rows, path, checkpoint = stored(rows, "arrivals"), folder(spark, "stream"), folder(spark, "checkpoint")
    for batch in range(4):
        rows.where(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(path)
        if batch % 2:
            query = start(stream(spark, path, rows.drop("batch").schema), checkpoint)
            query.awaitTermination()


def _streamed(spark: SparkSession, rows: DataFrame, processed) -> DataFrame:
    """What a stream of the rows gives in all its batches."""
    from .sources.scratch import folder
    from .streaming.guards import only_with_data

    out, kinds = folder(spark, "streamed"), []

    def start(arriving: DataFrame, checkpoint: str):
        made = processed(arriving)
        kinds.append(made.schema)
        with only_with_data(spark):
            return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    _arrived(spark, rows, start)
    return spark.read.schema(kinds[0]).parquet(out)


@query("SELECT CAST(user_id AS VARCHAR) AS run, event_id AS step, value, highest, coalesce(value < highest, false) AS refused FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id % 4, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM events)", "value highest")
def stm03_refused_counters(spark, sf_dir):
    """A counter of each run, whose highest value outlives batches and a restart: what is accepted, and what is refused."""
    from .streaming.guards import rising

    rows = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value", (F.col("event_id") % 4).alias("batch"))
    return _streamed(spark, rows, rising)


_LAST = 1_000_000_000
_LOGGED = f"""e AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS step, CASE WHEN event_id % 10 = 0 THEN 'log' ELSE 'rollout' END AS event, value, event_id % 4 AS batch FROM events
  UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), {_LAST}, 'end', NULL, 3 FROM events WHERE user_id % 3 = 1 UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), {_LAST} + 1, 'finish', NULL, 3 FROM events),
s AS (SELECT *, coalesce(sum(CASE WHEN event IN ('log', 'end') THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY batch, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e),
w AS (SELECT run, seg, count(*) FILTER (event = 'rollout') AS n, coalesce(sum(value) FILTER (event = 'rollout'), 0) AS total FROM s GROUP BY ALL)"""


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts and logs of each run; some runs end, and all ask for a good end."""
    events = D.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 10 == 0, "log").otherwise("rollout")
    rows = events.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), kind.alias("event"), "value", (F.col("event_id") % 4).alias("batch"))
    last = lambda runs, step, name: runs.select("user_id").distinct().select(F.col("user_id").alias("run"), F.lit(step).cast("long").alias("step"), F.lit(name).alias("event"), F.lit(None).cast("double").alias("value"), F.lit(3).cast("long").alias("batch"))
    return rows.unionByName(last(events.where("user_id % 3 = 1"), _LAST, "end")).unionByName(last(events, _LAST + 1, "finish"))


@query(f"WITH {_LOGGED} SELECT run, step, event, n, total FROM s JOIN w USING (run, seg) WHERE event = 'log' OR event = 'end' AND n > 0", "total")
def stm06_flushed_windows(spark, sf_dir):
    """Windows that logs flush, and the last, incomplete one of runs that end."""
    from .streaming.guards import flushed

    return _streamed(spark, _logged(spark, sf_dir), flushed).where("event <> 'finish'").drop("refused")


@query(f"WITH {_LOGGED} SELECT run, n AS waiting, n > 0 AS refused FROM s JOIN w USING (run, seg) WHERE event = 'finish'")
def stm04_refused_endings(spark, sf_dir):
    """A good end is refused while rollouts wait that nothing has flushed."""
    from .streaming.guards import flushed

    return _streamed(spark, _logged(spark, sf_dir), flushed).where("event = 'finish'").select("run", F.col("n").alias("waiting"), "refused")


_ROLLED = "CAST(user_id AS {text}) AS nonce, event_id AS step, CASE WHEN event_id % 3 = 0 THEN 'generated' ELSE 'scored' END AS event, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 END AS model_version, CAST(user_id % 5 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS {text}) AS prompt_sha256, CAST(CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS {text}) AS example_sha256, CAST(CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS {text}) AS completion_sha256, event_id % 4 AS batch"


@query(f"""WITH e AS (SELECT {_ROLLED.format(text='VARCHAR')} FROM events), s AS (SELECT *, sum(CASE WHEN event = 'generated' THEN 1 ELSE 0 END) OVER (PARTITION BY nonce ORDER BY batch, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM e),
g AS (SELECT nonce, seg, model_version AS gv, prompt_sha256 AS gp, example_sha256 AS ge, completion_sha256 AS gc FROM s WHERE event = 'generated'),
j AS (SELECT s.*, list_filter([CASE WHEN model_version <> gv OR model_version <> 2 THEN 'model_version' END, CASE WHEN prompt_sha256 <> gp THEN 'prompt_sha256' END, CASE WHEN example_sha256 <> ge THEN 'example_sha256' END, CASE WHEN completion_sha256 <> gc THEN 'completion_sha256' END], lambda x: x IS NOT NULL) AS f, gv IS NULL AS none FROM s LEFT JOIN g USING (nonce, seg) WHERE event = 'scored'),
u AS (SELECT *, coalesce(max(CASE WHEN len(f) = 0 AND NOT none THEN 1 ELSE 0 END) OVER (PARTITION BY nonce, seg ORDER BY batch, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM j)
SELECT nonce, step, CASE WHEN none OR used = 1 THEN 'nonce' ELSE array_to_string(f, ',') END AS faults FROM u""")
def stm08_replay_faults(spark, sf_dir):
    """Scored rollouts against what was generated under their nonces: which of five equalities fail, if any."""
    from .streaming.guards import replays

    rows = spark.sql(f"SELECT {_ROLLED.format(text='STRING')} FROM {{events}}", events=D.table(spark, sf_dir, "events"))
    return _streamed(spark, rows, lambda r: replays(r, 2)).select("nonce", "step", F.array_join("faults", ",").alias("faults"))


@query("SELECT event_id % 4 AS batch, count(*) AS records, sum(value) AS total FROM events GROUP BY 1", "total")
def snk10_published_batches(spark, sf_dir):
    """Every batch of a stream published once, across a restart."""
    from .sources.scratch import folder
    from .streaming.published import publish_once, published

    path = folder(spark, "published")
    rows = D.table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_id") % 4).alias("batch"))
    _arrived(spark, rows, lambda arriving, checkpoint: publish_once(arriving, path, checkpoint))
    return published(spark, path, "event_id long, value double").groupBy("batch").agg(F.count("*").alias("records"), F.sum("value").alias("total"))
