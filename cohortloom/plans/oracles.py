"""Reference SQL for every deterministic query, written independently of the DataFrame plans.

Cycles come from a recursive query, outcomes from a plain range join, curves
from window sums; nothing is shared with the operators but the rules.
"""

from __future__ import annotations

# One coefficient per step; by 700 steps the estimates are exact beyond the rounding of the results.
FIT_STEPS = 700

CTES = """
WITH RECURSIVE claims AS (
  SELECT CAST(o_custkey AS BIGINT) AS person_id, CAST(l_shipdate AS DATE) AS date,
         CAST(l_partkey AS BIGINT) AS concept_id,
         CASE WHEN p_size <= 12 THEN 'IUI' WHEN p_size <= 20 THEN 'ART' WHEN p_size <= 26 THEN 'pregnant'
              WHEN p_size <= 30 THEN 'labor' WHEN p_size <= 32 THEN 'abortion' WHEN p_size <= 33 THEN 'stillbirth'
              WHEN p_size <= 36 THEN 'tobacco' WHEN p_size <= 39 THEN 'alcohol' WHEN p_size <= 42 THEN 'obesity'
              WHEN p_size <= 44 THEN 'PCOS' WHEN p_size <= 48 THEN 'f_infert' WHEN p_size <= 50 THEN 'm_infert'
         END AS concept_set
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
obs AS (
  SELECT person_id, min(date) AS obs_start, max(date) AS obs_end FROM claims GROUP BY person_id),
cohort AS (
  SELECT 1 AS cohort_definition_id, c.person_id AS subject_id, min(c.date) AS cohort_start_date,
         least(any_value(obs_end), min(c.date) + CAST(200 + (c.person_id % 5) * 150 AS INTEGER)) AS cohort_end_date
  FROM claims c JOIN obs USING (person_id)
  WHERE c.concept_set IN ('ART', 'IUI') AND c.date >= DATE '1996-01-01'
  GROUP BY c.person_id),
windows AS (
  SELECT subject_id AS person_id, cohort_start_date, cohort_end_date,
         CAST(cohort_start_date - INTERVAL 12 MONTH AS DATE) AS covariate_start_date,
         CAST(cohort_start_date + INTERVAL 4 MONTH AS DATE) AS txt_end_date
  FROM cohort),
txt AS (
  SELECT c.*, CASE concept_set WHEN 'ART' THEN 0 ELSE 1 END AS src
  FROM claims c JOIN windows w USING (person_id)
  WHERE concept_set IN ('ART', 'IUI') AND date BETWEEN cohort_start_date AND txt_end_date),
preg AS (
  SELECT c.* FROM claims c JOIN windows w USING (person_id)
  WHERE concept_set IN ('pregnant', 'abortion', 'stillbirth', 'labor')
    AND date BETWEEN cohort_start_date AND cohort_end_date),
covs AS (
  SELECT c.* FROM claims c JOIN windows w USING (person_id)
  WHERE concept_set IN ('alcohol', 'tobacco', 'obesity', 'PCOS', 'f_infert', 'm_infert')
    AND date BETWEEN covariate_start_date AND cohort_start_date),
indicators AS (
  SELECT person_id,
         max(CAST(1 AS DOUBLE)) FILTER (concept_set = 'alcohol') AS alcohol,
         max(CAST(1 AS DOUBLE)) FILTER (concept_set = 'tobacco') AS tobacco,
         max(CAST(1 AS DOUBLE)) FILTER (concept_set = 'obesity') AS obesity,
         max(CAST(1 AS DOUBLE)) FILTER (concept_set = 'PCOS') AS pcos,
         max(CAST(1 AS DOUBLE)) FILTER (concept_set = 'f_infert') AS f_infert,
         max(CAST(1 AS DOUBLE)) FILTER (concept_set = 'm_infert') AS m_infert
  FROM covs GROUP BY person_id),
first_iui AS (
  SELECT person_id, date, min(concept_id) AS concept_id_IUI, 'IUI' AS concept_set_IUI
  FROM txt WHERE concept_set = 'IUI' GROUP BY person_id, date),
first_art AS (
  SELECT person_id, date, min(concept_id) AS concept_id_ART, 'ART' AS concept_set_ART
  FROM txt WHERE concept_set = 'ART' GROUP BY person_id, date),
baseline AS (
  SELECT w.*, coalesce(alcohol, 0) AS alcohol, coalesce(tobacco, 0) AS tobacco, coalesce(obesity, 0) AS obesity,
         coalesce(pcos, 0) AS pcos, coalesce(f_infert, 0) AS f_infert, coalesce(m_infert, 0) AS m_infert,
         concept_id_IUI, concept_set_IUI, concept_id_ART, concept_set_ART,
         CASE WHEN concept_id_ART IS NULL THEN 'IUI' WHEN concept_id_IUI IS NULL THEN 'ART' ELSE 'both' END AS first_txt
  FROM windows w LEFT JOIN indicators USING (person_id)
  LEFT JOIN first_iui i ON i.person_id = w.person_id AND i.date = w.cohort_start_date
  LEFT JOIN first_art a ON a.person_id = w.person_id AND a.date = w.cohort_start_date),
anchor AS (
  SELECT person_id, 1 AS cycle, min(date) AS day_1 FROM txt GROUP BY person_id
  UNION ALL
  SELECT a.person_id, a.cycle + 1, min(t.date)
  FROM anchor a JOIN txt t ON t.person_id = a.person_id AND t.date > a.day_1 + 14
  WHERE a.cycle < 4 GROUP BY a.person_id, a.cycle),
txt_dates AS (
  SELECT t.*, a.day_1, a.day_1 + 14 AS day_14, t.date BETWEEN a.day_1 AND a.day_1 + 14 AS in_cycle_1
  FROM txt t JOIN anchor a ON a.person_id = t.person_id AND a.cycle = 1),
later_first AS (
  SELECT person_id, min(date) AS day_1b FROM txt_dates WHERE NOT in_cycle_1 GROUP BY person_id),
later AS (
  SELECT t.*, day_1b, day_1b + 14 AS day_14b, t.date BETWEEN day_1b AND day_1b + 14 AS in_cycle_1b
  FROM txt_dates t JOIN later_first USING (person_id) WHERE NOT in_cycle_1),
quick AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY date, src, concept_id) AS rn FROM later)
  WHERE rn = 1 AND day_1b - day_1 < 21),
quick_union AS (
  SELECT person_id, date, concept_id, concept_set, day_1, day_14, in_cycle_1,
         CAST(NULL AS DATE) AS day_1b, CAST(NULL AS DATE) AS day_14b, CAST(NULL AS BOOLEAN) AS in_cycle_1b
  FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY date, src, concept_id) AS rn
        FROM txt_dates WHERE person_id IN (SELECT person_id FROM quick)) WHERE rn = 1
  UNION ALL
  SELECT person_id, date, concept_id, concept_set, day_1, day_14, in_cycle_1, day_1b, day_14b, in_cycle_1b FROM quick),
cyc AS (
  SELECT t.person_id, t.date, t.concept_id, t.concept_set, t.src, a.cycle, a.day_1, a.day_1 + 14 AS day_14
  FROM txt t JOIN anchor a ON a.person_id = t.person_id AND t.date BETWEEN a.day_1 AND a.day_1 + 14),
cyc_first AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id, cycle ORDER BY date, src, concept_id) AS rn FROM cyc)
  WHERE rn = 1),
follow AS (
  SELECT *, coalesce(next_cycle, day_1 + 315) AS end_preg FROM (
    SELECT person_id, concept_set, day_1, cycle,
           lead(day_1) OVER (PARTITION BY person_id ORDER BY cycle) AS next_cycle FROM cyc_first)),
ranged AS (
  SELECT f.*, p.date, p.concept_set AS preg_concept
  FROM follow f LEFT JOIN preg p ON p.person_id = f.person_id AND p.date BETWEEN f.day_1 AND f.end_preg),
pivoted AS (
  SELECT person_id, concept_set, day_1, cycle, next_cycle, end_preg,
         min(date) FILTER (preg_concept = 'pregnant') AS pregnant,
         min(date) FILTER (preg_concept = 'abortion') AS abortion,
         min(date) FILTER (preg_concept = 'stillbirth') AS stillbirth,
         min(date) FILTER (preg_concept = 'labor') AS labor
  FROM ranged GROUP BY ALL),
outcomes AS (
  SELECT person_id, concept_set AS txt, day_1, cycle, next_cycle, abortion, stillbirth, pregnant, labor,
         CASE WHEN abortion < day_1 + 140 THEN 'pregnancy loss'
              WHEN stillbirth IS NOT NULL THEN 'pregnancy loss'
              WHEN labor IS NOT NULL THEN 'live_birth'
              WHEN cohort_end_date < end_preg THEN 'censored'
              WHEN pregnant IS NOT NULL THEN 'pregnancy'
              ELSE 'no pregnancy' END AS outcome
  FROM pivoted LEFT JOIN (SELECT person_id, cohort_end_date FROM windows) USING (person_id)),
rolled AS (
  SELECT person_id,
         CAST(bool_or(outcome IN ('pregnancy', 'live_birth')) AS DOUBLE) AS any_pregnancy,
         CAST(bool_or(outcome = 'live_birth') AS DOUBLE) AS any_live_birth,
         min(labor) AS delivery_date, min(pregnant) AS pregnancy_date, max(day_1) AS last_cycle,
         CAST(bool_and(outcome = 'censored') AS DOUBLE) AS censored
  FROM outcomes GROUP BY person_id),
itt_events AS (
  SELECT * REPLACE (
           CASE WHEN pregnancy_date < cohort_start_date + 424 THEN pregnancy_date
                WHEN cohort_end_date IS NOT NULL THEN least(cohort_end_date, cohort_start_date + 424) END AS pregnancy_date,
           CASE WHEN delivery_date < cohort_start_date + 424 THEN delivery_date
                WHEN cohort_end_date IS NOT NULL THEN least(cohort_end_date, cohort_start_date + 424) END AS delivery_date),
         pregnancy_date IS NOT NULL AS event_pregnancy, delivery_date IS NOT NULL AS event_delivery
  FROM rolled FULL JOIN baseline USING (person_id)),
itt AS (
  SELECT *, CAST(pregnancy_date - cohort_start_date AS DOUBLE) AS time_to_pregnancy,
         CAST(delivery_date - cohort_start_date AS DOUBLE) AS time_to_delivery,
         CASE WHEN first_txt = 'IUI' THEN 'IUI' WHEN first_txt IS NOT NULL THEN 'ART' END AS IUI
  FROM itt_events),
analysis AS (
  SELECT * FROM itt
  WHERE (NOT event_pregnancy OR time_to_pregnancy > 0) AND (NOT event_delivery OR time_to_delivery > 0)),
patterns AS (
  SELECT alcohol, tobacco, obesity, pcos, f_infert, m_infert, CAST(count(*) AS DOUBLE) AS n,
         CAST(count(*) FILTER (IUI = 'IUI') AS DOUBLE) AS y
  FROM analysis WHERE IUI IS NOT NULL GROUP BY ALL),
designed AS (
  SELECT n, y, [CAST(1 AS DOUBLE), alcohol, tobacco, obesity, pcos, f_infert, m_infert] AS x FROM patterns),
fit AS (
  SELECT 0 AS step, [CAST(0 AS DOUBLE), 0, 0, 0, 0, 0, 0] AS beta
  UNION ALL
  SELECT step + 1, list_concat(list_concat(beta[1:step % 7], [beta[step % 7 + 1] + gradient / curvature]), beta[step % 7 + 2:7])
  FROM (SELECT step, beta, sum(x[step % 7 + 1] * (y - n * p)) AS gradient,
               sum(x[step % 7 + 1] * x[step % 7 + 1] * n * p * (1 - p)) AS curvature
        FROM (SELECT step, beta, x, n, y, 1 / (1 + exp(-(beta[1] * x[1] + beta[2] * x[2] + beta[3] * x[3] + beta[4] * x[4]
                + beta[5] * x[5] + beta[6] * x[6] + beta[7] * x[7]))) AS p FROM fit CROSS JOIN designed WHERE step < {steps})
        GROUP BY step, beta)),
fitted AS (SELECT beta FROM fit ORDER BY step DESC LIMIT 1),
scored AS (
  SELECT a.*, 1 / (1 + exp(-(beta[1] + beta[2] * alcohol + beta[3] * tobacco + beta[4] * obesity + beta[5] * pcos
           + beta[6] * f_infert + beta[7] * m_infert))) AS p_IUI FROM analysis a CROSS JOIN fitted),
weighted AS (
  SELECT *, CASE WHEN IUI = 'IUI' THEN 1 / p_IUI ELSE 1 / (1 - p_IUI) END AS ip_weight FROM scored),
leaving AS (
  SELECT IUI AS "group", time_to_delivery AS time, CAST(count(*) AS DOUBLE) AS n_leaving,
         CAST(count(*) FILTER (event_delivery) AS DOUBLE) AS n_event,
         coalesce(sum(ip_weight) FILTER (event_delivery), 0) AS w_event,
         sum(ip_weight) AS w_leaving, sum(ip_weight * ip_weight) AS w2_leaving
  FROM weighted WHERE time_to_delivery IS NOT NULL GROUP BY 1, 2),
risk AS (
  SELECT *, sum(w_leaving) OVER later_on AS at_risk, sum(w2_leaving) OVER later_on AS at_risk_sq
  FROM leaving WINDOW later_on AS (PARTITION BY "group" ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
steps AS (
  SELECT "group", time, n_event, w_event, at_risk, at_risk_sq FROM risk
  UNION ALL
  SELECT "group", 0, 0, 0, max(at_risk), max(at_risk_sq) FROM risk GROUP BY "group" HAVING min(time) > 0),
factors AS (
  SELECT *, at_risk - w_event <= at_risk * 1e-9 AS exhausted FROM steps),
products AS (
  SELECT *, CASE WHEN bool_or(exhausted) OVER so_far THEN 0
                 ELSE exp(sum(CASE WHEN exhausted THEN 0 ELSE ln(1 - w_event / at_risk) END) OVER so_far) END AS surv,
         sum(CASE WHEN exhausted THEN 0
                  ELSE w_event / (at_risk * at_risk / at_risk_sq * (at_risk - w_event)) END) OVER so_far AS hv,
         max(time) OVER (PARTITION BY "group") AS last_time
  FROM factors WINDOW so_far AS (PARTITION BY "group" ORDER BY time ROWS UNBOUNDED PRECEDING)),
curve AS (
  SELECT "group", time, surv, CASE WHEN surv > 0 THEN surv * sqrt(hv) END AS se
  FROM products WHERE time = 0 OR n_event > 0 OR time = last_time),
curve_times AS (SELECT DISTINCT time FROM curve),
diff AS (
  SELECT t.time, a.surv - b.surv AS diff, sqrt(a.se * a.se + b.se * b.se) AS se
  FROM curve_times t
  LEFT JOIN curve a ON a."group" = 'ART' AND t.time <= (SELECT max(time) FROM curve WHERE "group" = 'ART')
    AND a.time = (SELECT max(c.time) FROM curve c WHERE c."group" = 'ART' AND c.time <= t.time)
  LEFT JOIN curve b ON b."group" = 'IUI' AND t.time <= (SELECT max(time) FROM curve WHERE "group" = 'IUI')
    AND b.time = (SELECT max(c.time) FROM curve c WHERE c."group" = 'IUI' AND c.time <= t.time)),
long_x AS (
  SELECT IUI, ip_weight, x.name AS covariate, x.value AS value FROM (
    SELECT IUI, ip_weight, unnest([
      {'name': 'prop.score', 'value': p_IUI}, {'name': 'alcohol', 'value': alcohol},
      {'name': 'tobacco', 'value': tobacco}, {'name': 'obesity', 'value': obesity},
      {'name': 'pcos', 'value': pcos}, {'name': 'f_infert', 'value': f_infert},
      {'name': 'm_infert', 'value': m_infert}]) AS x
    FROM weighted)),
arm_means AS (
  SELECT covariate, IUI, avg(value) AS mean_un, sum(ip_weight * value) / sum(ip_weight) AS mean_adj,
         var_samp(value) AS v
  FROM long_x GROUP BY covariate, IUI),
balance AS (
  SELECT t.covariate, CASE WHEN t.covariate = 'prop.score' THEN 'distance' ELSE 'binary' END AS kind,
         (t.mean_un - c.mean_un) / CASE WHEN t.covariate = 'prop.score' THEN sqrt((t.v + c.v) / 2) ELSE 1 END AS diff_unadjusted,
         (t.mean_adj - c.mean_adj) / CASE WHEN t.covariate = 'prop.score' THEN sqrt((t.v + c.v) / 2) ELSE 1 END AS diff_adjusted
  FROM arm_means t JOIN arm_means c ON t.covariate = c.covariate AND t.IUI = 'IUI' AND c.IUI = 'ART')
""".replace("{steps}", str(FIT_STEPS))

Z = "1.959963984540054"
ITT_SELECT = """
SELECT person_id, any_pregnancy, any_live_birth, delivery_date, pregnancy_date, last_cycle, censored,
       cohort_start_date, cohort_end_date, covariate_start_date, txt_end_date,
       alcohol, tobacco, obesity, pcos, f_infert, m_infert,
       concept_id_IUI, concept_set_IUI, concept_id_ART, concept_set_ART, first_txt,
       event_pregnancy, event_delivery, time_to_pregnancy, time_to_delivery, IUI FROM """
CYCLE_FLAGS = ", ".join(f"cycle = {k} AS in_cycle_{k}" for k in (1, 2, 3, 4))


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def r4(name: str) -> str:
    """For weighted sums: their last digits depend on the order of addition."""
    return f"round({name}, 4) + 0.0 AS {name}"


# Two-sided normal p-value by Simpson's rule over [0, |z|], as one minus the area
TWO_SIDED = """(1 - 2 / sqrt(2 * pi()) * (SELECT sum(CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
    * exp(-pow(abs({z}) * k / 400, 2) / 2)) * abs({z}) / 1200 FROM range(401) AS points(k)))"""

FINAL = {
    "cohort_scan": "SELECT * FROM cohort",
    "cohort_windows": "SELECT * FROM windows",
    "pull_long_treatments": "SELECT person_id, date, concept_id, concept_set FROM txt",
    "pull_long_outcomes": "SELECT person_id, date, concept_id, concept_set FROM preg",
    "pull_indicator": "SELECT * FROM indicators",
    "pull_all_counts": """
        SELECT concept_set, count(*) AS n_events, count(DISTINCT person_id) AS n_persons FROM (
          SELECT concept_set, person_id FROM txt UNION ALL SELECT concept_set, person_id FROM preg
          UNION ALL SELECT concept_set, person_id FROM covs) GROUP BY concept_set""",
    "baseline": "SELECT * FROM baseline",
    "first_treatment": """
        SELECT person_id, cohort_start_date, concept_id_IUI, concept_set_IUI, concept_id_ART, concept_set_ART, first_txt
        FROM baseline""",
    "pregnancies": "SELECT person_id, date, concept_id, concept_set FROM preg ORDER BY date",
    "treatment_dates": "SELECT * EXCLUDE (src) FROM txt_dates",
    "later_treatments": "SELECT * EXCLUDE (src) FROM later",
    "quickly_after": "SELECT * EXCLUDE (src) FROM quick",
    "union_by_name": "SELECT * FROM quick_union",
    "second_course_gap": """
        SELECT person_id, CAST(max(date) - min(date) AS INTEGER) AS gap_days FROM quick_union GROUP BY person_id""",
    "four_cycles": f"SELECT person_id, date, concept_id, concept_set, day_1, day_14, {CYCLE_FLAGS} FROM cyc",
    "coalesce_columns": """
        SELECT person_id, date, concept_id, concept_set, day_1, day_14, CAST(cycle AS VARCHAR) AS cycle_text FROM cyc""",
    "cycle_number": """
        SELECT person_id, date, concept_id, concept_set, day_1, day_14, cycle FROM cyc""",
    "first_row_per_cycle": """
        SELECT person_id, date, concept_id, concept_set, day_1, day_14, cycle FROM cyc_first""",
    "cycle_followup": "SELECT * FROM follow",
    "range_join_outcomes": "SELECT * FROM ranged",
    "pivot_outcomes": "SELECT * FROM pivoted",
    "cycle_outcomes": "SELECT * FROM outcomes",
    "cycle_outcomes_relational": "SELECT * FROM outcomes",
    "itt_rollup": "SELECT * FROM rolled",
    "itt": ITT_SELECT + "itt",
    "itt_full_join": ITT_SELECT + "itt",
    "itt_analysis": ITT_SELECT + "analysis",
    "qc_both_treated": "SELECT * FROM baseline WHERE first_txt = 'both'",
    "qc_pregnancy_counts": "SELECT person_id, concept_set, count(*) AS n FROM preg GROUP BY person_id, concept_set",
    "qc_person_lookup": "SELECT person_id, date, concept_id, concept_set FROM preg WHERE person_id = {person}",
    "qc_mixed_cycle": """
        SELECT person_id, concept_set, count(*) AS n FROM txt_dates t
        WHERE in_cycle_1 AND person_id IN (
          SELECT person_id FROM txt_dates WHERE in_cycle_1 GROUP BY person_id HAVING count(DISTINCT concept_set) > 1)
        GROUP BY person_id, concept_set""",
    "qc_event_columns": "SELECT event_pregnancy, event_delivery, time_to_pregnancy, time_to_delivery FROM itt",
    "propensity_score_equations": """
        SELECT term, round(score, 4) + 0.0 AS score FROM (
          UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS "(Intercept)", sum(alcohol) AS alcohol, sum(tobacco) AS tobacco,
                          sum(obesity) AS obesity, sum(pcos) AS pcos, sum(f_infert) AS f_infert, sum(m_infert) AS m_infert
                   FROM analysis WHERE IUI = 'IUI') ON COLUMNS(*) INTO NAME term VALUE score)""",
    "ip_weights": f"""
        SELECT person_id, IUI, {r6('p_IUI', 'p_IUI')}, {r6('ip_weight', 'ip_weight')} FROM weighted""",
    "weight_summary": f"""
        SELECT {r6('min(ip_weight)', 'min')}, {r6('quantile_cont(ip_weight, 0.25)', 'q1')},
               {r6('quantile_cont(ip_weight, 0.5)', 'median')}, {r6('avg(ip_weight)', 'mean')},
               {r6('quantile_cont(ip_weight, 0.75)', 'q3')}, {r6('max(ip_weight)', 'max')} FROM weighted""",
    "weight_diagnostics": f"""
        SELECT IUI AS "group", count(*) AS n, {r6('min(ip_weight)', 'min_weight')},
               {r6('max(ip_weight)', 'max_weight')}, {r6('stddev_samp(ip_weight) / avg(ip_weight)', 'cv')},
               {r6('avg(abs(ip_weight / arm_mean - 1))', 'mad')},
               {r6('avg(ip_weight / arm_mean * ln(ip_weight / arm_mean))', 'entropy')},
               {r6('sum(ip_weight) * sum(ip_weight) / sum(ip_weight * ip_weight)', 'ess')}
        FROM (SELECT *, avg(ip_weight) OVER (PARTITION BY IUI) AS arm_mean FROM weighted) GROUP BY IUI""",
    "top_weights": """
        SELECT "group", person_id, round(ip_weight, 6) + 0.0 AS ip_weight, CAST(rank AS INTEGER) AS rank FROM (
          SELECT IUI AS "group", person_id, ip_weight,
                 row_number() OVER (PARTITION BY IUI ORDER BY ip_weight DESC, person_id) AS rank FROM weighted)
        WHERE rank <= 5""",
    "weights_head": """
        SELECT person_id, round(ip_weight, 6) + 0.0 AS ip_weight FROM weighted ORDER BY person_id LIMIT 6""",
    "km_risk_table": f"""
        SELECT "group", time, n_leaving, n_event, {r4('w_event')}, {r4('w_leaving')}, {r4('w2_leaving')},
               {r4('at_risk')}, {r4('at_risk_sq')}
        FROM risk""",
    "iptw_km": f"""
        SELECT "group", time, {r6('surv', 'surv')}, {r6('se', 'se')}, {r6(f'surv - {Z} * se', 'ci_lower')},
               {r6(f'surv + {Z} * se', 'ci_upper')} FROM curve""",
    "curve_endpoints": f"""
        SELECT "group", time, {r6('surv', 'surv')}, {r6('se', 'se')}, {r6(f'surv - {Z} * se', 'ci_lower')},
               {r6(f'surv + {Z} * se', 'ci_upper')} FROM curve c
        WHERE time = (SELECT max(time) FROM curve d WHERE d."group" = c."group")""",
    "curve_diff": f"""
        SELECT time, {r6('diff', 'diff')}, {r6('se', 'se')}, {r6(f'diff - {Z} * se', 'ci_lower')},
               {r6(f'diff + {Z} * se', 'ci_upper')},
               CASE WHEN se > 0 THEN round({TWO_SIDED.format(z='diff / se')}, 6) + 0.0 END AS p_value
        FROM diff""",
    "balance_table": f"""
        SELECT covariate, kind, {r6('diff_unadjusted', 'diff_unadjusted')}, {r6('diff_adjusted', 'diff_adjusted')}
        FROM balance""",
    "balance_long": f"""
        SELECT covariate, 'unadjusted' AS sample, {r6('abs(diff_unadjusted)', 'abs_diff')} FROM balance
        UNION ALL
        SELECT covariate, 'adjusted', {r6('abs(diff_adjusted)', 'abs_diff')} FROM balance""",
    "balance_distribution": f"""
        SELECT "group", covariate, level,
               {r6('count(*) / any_value(n_all)', 'share_unadjusted')},
               {r6('sum(ip_weight) / any_value(w_all)', 'share_adjusted')}
        FROM (SELECT IUI AS "group", covariate, ip_weight,
                     CASE WHEN covariate = 'prop.score' THEN least(floor(value * 10), 9) ELSE value END AS level,
                     CAST(count(*) OVER g AS DOUBLE) AS n_all, sum(ip_weight) OVER g AS w_all
              FROM long_x WINDOW g AS (PARTITION BY IUI, covariate))
        GROUP BY "group", covariate, level""",
    "cohort_eras": """
        SELECT 1 AS cohort_definition_id, person_id AS subject_id,
               min(start) AS cohort_start_date, max(finish) AS cohort_end_date
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY person_id ORDER BY start, finish ROWS UNBOUNDED PRECEDING) AS era
              FROM (SELECT *, CASE WHEN start <= max(finish) OVER (PARTITION BY person_id ORDER BY start, finish
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
                    FROM (SELECT DISTINCT person_id, date AS start, least(obs_end, date + 60) AS finish
                          FROM claims JOIN obs USING (person_id) WHERE concept_set IN ('ART', 'IUI'))))
        GROUP BY person_id, era""",
    "concept_set_resolve": """
        SELECT s.concept_set, s.concept_id
        FROM (SELECT DISTINCT concept_set, concept_id FROM (
                SELECT set_of AS concept_set, p_partkey AS concept_id FROM sized
                UNION ALL SELECT set_of, CAST(p_size AS BIGINT) + 1000000000000 FROM sized)) s
        WHERE NOT EXISTS (
          SELECT 1 FROM (
            SELECT set_of, min(p_partkey) AS concept_id FROM sized GROUP BY set_of
            UNION ALL SELECT set_of, p_partkey FROM sized WHERE p_size IN (12, 20, 26, 30, 32, 36, 39, 42, 44, 48, 50)
            UNION ALL SELECT set_of, CAST(p_size AS BIGINT) + 1000000000000 FROM sized
                      WHERE p_size IN (12, 20, 26, 30, 32, 36, 39, 42, 44, 48, 50)) x
          WHERE x.set_of = s.concept_set AND x.concept_id = s.concept_id)""",
}

INVERSE_CTES = """,
information AS (
  SELECT list(value ORDER BY i, j) AS a FROM (
    SELECT i, j, sum(x[i] * x[j] * n * p * (1 - p)) AS value
    FROM (SELECT n, x, 1 / (1 + exp(-(beta[1] * x[1] + beta[2] * x[2] + beta[3] * x[3] + beta[4] * x[4] + beta[5] * x[5]
            + beta[6] * x[6] + beta[7] * x[7]))) AS p FROM designed CROSS JOIN fitted)
    CROSS JOIN range(1, 8) AS rows(i) CROSS JOIN range(1, 8) AS columns(j) GROUP BY i, j)),
swept AS (
  SELECT 1 AS k, a FROM information
  UNION ALL
  SELECT k + 1, [CASE WHEN e // 7 + 1 = k AND e % 7 + 1 = k THEN 1 / a[8 * k - 7]
                      WHEN e // 7 + 1 = k THEN a[e + 1] / a[8 * k - 7]
                      WHEN e % 7 + 1 = k THEN -a[e + 1] / a[8 * k - 7]
                      ELSE a[e + 1] - a[e // 7 * 7 + k] * a[7 * k - 6 + e % 7] / a[8 * k - 7] END FOR e IN range(49)]
  FROM swept WHERE k <= 7),
coefficients AS (
  SELECT t.i, ['(Intercept)', 'alcohol', 'tobacco', 'obesity', 'pcos', 'f_infert', 'm_infert'][t.i] AS term,
         beta[t.i] AS estimate, sqrt(a[8 * t.i - 7]) AS std_error
  FROM fitted CROSS JOIN (SELECT a FROM swept WHERE k = 8) CROSS JOIN range(1, 8) AS t(i))
"""

EXTRA_CTES = {
    "propensity_coefficients": INVERSE_CTES,
    "concept_set_resolve": """,
sized AS (
  SELECT p_partkey, p_size,
         CASE WHEN p_size <= 12 THEN 'IUI' WHEN p_size <= 20 THEN 'ART' WHEN p_size <= 26 THEN 'pregnant'
              WHEN p_size <= 30 THEN 'labor' WHEN p_size <= 32 THEN 'abortion' WHEN p_size <= 33 THEN 'stillbirth'
              WHEN p_size <= 36 THEN 'tobacco' WHEN p_size <= 39 THEN 'alcohol' WHEN p_size <= 42 THEN 'obesity'
              WHEN p_size <= 44 THEN 'PCOS' WHEN p_size <= 48 THEN 'f_infert' WHEN p_size <= 50 THEN 'm_infert'
         END AS set_of
  FROM part)""",
}

GENERATED = """,
entry_1 AS (
  SELECT c.person_id, any_value(obs_end) AS obs_end, min(date) AS entry_date
  FROM claims c JOIN obs o USING (person_id)
  WHERE concept_set IN ('ART', 'IUI') AND date >= DATE '1996-01-01' AND date >= obs_start + 180
  GROUP BY c.person_id),
entry_2 AS (
  SELECT c.person_id, any_value(obs_end) AS obs_end, min(date) AS entry_date
  FROM claims c JOIN obs o USING (person_id)
  WHERE concept_set = 'ART' AND date >= DATE '1997-01-01' AND date >= obs_start + 365
  GROUP BY c.person_id),
evaluated AS (
  SELECT 1 AS cohort_definition_id, 424 AS max_days, 3 AS passed, e.*,
    CAST(CASE WHEN EXISTS (SELECT 1 FROM claims c WHERE c.person_id = e.person_id AND concept_set = 'labor'
           AND c.date BETWEEN e.entry_date - 365 AND e.entry_date - 1) THEN 0 ELSE 1 END
    + CASE WHEN EXISTS (SELECT 1 FROM claims c WHERE c.person_id = e.person_id AND concept_set IN ('f_infert', 'm_infert')
           AND c.date BETWEEN e.entry_date - 730 AND e.entry_date) THEN 2 ELSE 0 END AS BIGINT) AS mask
  FROM entry_1 e
  UNION ALL
  SELECT 2, 600, 1, e.*,
    CAST(CASE WHEN EXISTS (SELECT 1 FROM claims c WHERE c.person_id = e.person_id AND concept_set = 'tobacco'
           AND c.date BETWEEN e.entry_date - 365 AND e.entry_date) THEN 0 ELSE 1 END AS BIGINT)
  FROM entry_2 e)
"""
FINAL["cohort_generate"] = """
    SELECT cohort_definition_id, person_id AS subject_id, entry_date AS cohort_start_date,
           least(obs_end, entry_date + max_days) AS cohort_end_date
    FROM evaluated WHERE mask = passed"""
FINAL["cohort_inclusion"] = """
    SELECT cohort_definition_id, mask AS inclusion_mask, count(*) AS person_count
    FROM evaluated GROUP BY cohort_definition_id, mask"""
FINAL["cohort_stats"] = """
    SELECT cohort_definition_id, 0 AS rule_sequence, 'all entries' AS rule_name, count(*) AS person_count,
           CAST(0 AS BIGINT) AS drop_count FROM evaluated GROUP BY cohort_definition_id
    UNION ALL
    SELECT 1, 1, 'no delivery in the year before', count(*) FILTER (mask % 2 = 1), count(*) FILTER (mask % 2 = 0)
    FROM evaluated WHERE cohort_definition_id = 1
    UNION ALL
    SELECT 1, 2, 'infertility on record', count(*) FILTER (mask = 3), count(*) FILTER (mask = 1)
    FROM evaluated WHERE cohort_definition_id = 1
    UNION ALL
    SELECT 2, 1, 'no tobacco use on record', count(*) FILTER (mask = 1), count(*) FILTER (mask = 0)
    FROM evaluated WHERE cohort_definition_id = 2"""
FINAL["propensity_coefficients"] = f"""
    SELECT term, {r6('estimate', 'estimate')}, {r6('std_error', 'std_error')}, {r4('z_value')},
           {r6(TWO_SIDED.format(z='z_value'), 'p_value')}
    FROM (SELECT *, estimate / std_error AS z_value FROM coefficients)"""
FINAL["propensity_statistics"] = f"""
    SELECT statistic, round(value, 5) + 0.0 AS value FROM (
      UNPIVOT (
        SELECT -2 * (treated * ln(treated / total) + (total - treated) * ln(1 - treated / total)) AS null_deviance,
               total - 1 AS null_df, deviance AS residual_deviance, total - 7 AS residual_df, deviance + 14 AS aic
        FROM (SELECT CAST(count(*) AS DOUBLE) AS total, CAST(count(*) FILTER (IUI = 'IUI') AS DOUBLE) AS treated,
                     -2 * sum(CASE WHEN IUI = 'IUI' THEN ln(p_IUI) ELSE ln(1 - p_IUI) END) AS deviance FROM scored))
      ON COLUMNS(*) INTO NAME statistic VALUE value)"""
FINAL["propensity_positivity"] = f"""
    SELECT IUI AS "group", count(*) AS n, {r6('min(p_IUI)', 'min_score')}, {r6('max(p_IUI)', 'max_score')},
           count(*) FILTER (p_IUI < 1e-6) AS n_near_zero, count(*) FILTER (p_IUI > 1 - 1e-6) AS n_near_one, true AS converged
    FROM scored GROUP BY IUI"""
FINAL["propensity_aliased"] = f"""
    SELECT term, {r6('estimate', 'estimate')} FROM coefficients
    UNION ALL SELECT unnest(['no_tobacco', 'constant']), NULL"""
EXTRA_CTES["propensity_aliased"] = INVERSE_CTES
FINAL["weight_vectors"] = """
    SELECT person_id, IUI, round(ip_weight, 6) + 0.0 AS weight_rows, round(ip_weight, 6) + 0.0 AS weight_cells,
           CAST(0 AS DOUBLE) AS max_difference
    FROM weighted"""
FINAL["iptw_km_glm"] = FINAL["study_stored"] = FINAL["iptw_km"]
FINAL["balance_sizes"] = """
    SELECT IUI AS "group", CAST(count(*) AS DOUBLE) AS size_unadjusted,
           round(sum(ip_weight) * sum(ip_weight) / sum(ip_weight * ip_weight), 4) + 0.0 AS size_adjusted
    FROM weighted GROUP BY IUI"""
FINAL["qc_person_treatments"] = "SELECT person_id, date, concept_id, concept_set FROM txt WHERE person_id = {person}"
FINAL["qc_person_cycles"] = "SELECT * FROM outcomes WHERE person_id = {person}"
FINAL["qc_person_itt"] = ITT_SELECT + "itt WHERE person_id = {person}"
FINAL["cohort_rule_gain"] = """
    SELECT 1 AS cohort_definition_id, 1 AS rule_sequence, 'no delivery in the year before' AS rule_name,
           count(*) FILTER (mask % 2 = 1) AS person_count, count(*) FILTER (mask = 2) AS gain_count, count(*) AS person_total
    FROM evaluated WHERE cohort_definition_id = 1
    UNION ALL
    SELECT 1, 2, 'infertility on record', count(*) FILTER (mask >= 2), count(*) FILTER (mask = 1), count(*)
    FROM evaluated WHERE cohort_definition_id = 1
    UNION ALL
    SELECT 2, 1, 'no tobacco use on record', count(*) FILTER (mask = 1), count(*) FILTER (mask = 0), count(*)
    FROM evaluated WHERE cohort_definition_id = 2"""
FINAL["cohort_summary"] = """
    SELECT cohort_definition_id, count(*) AS base_count, count(*) FILTER (mask = passed) AS final_count,
           count(*) FILTER (mask = passed) AS stored_rows
    FROM evaluated GROUP BY cohort_definition_id"""
FINAL["cohort_eras_open"] = """
    SELECT 1 AS cohort_definition_id, person_id AS subject_id, min(start) AS cohort_start_date,
           CASE WHEN bool_or(is_open) THEN NULL ELSE max(finish) END AS cohort_end_date
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY person_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS era
          FROM (SELECT *, CASE WHEN bool_or(is_open) OVER earlier OR start <= max(finish) OVER earlier THEN 0 ELSE 1 END AS fresh
                FROM (SELECT DISTINCT person_id, date AS start, least(obs_end, date + 60) AS finish, day(date) = 1 AS is_open
                      FROM claims JOIN obs USING (person_id) WHERE concept_set IN ('ART', 'IUI'))
                WINDOW earlier AS (PARTITION BY person_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
    GROUP BY person_id, era"""
for _name in ("cohort_generate", "cohort_inclusion", "cohort_stats", "cohort_rule_gain", "cohort_summary"):
    EXTRA_CTES[_name] = GENERATED


# ---- covariates of many values, times between the days
CONTINUOUS_CTES = """,
history AS (
  SELECT w.person_id, CAST(count(c.date) AS DOUBLE) AS n_prior,
         coalesce((any_value(w.cohort_start_date) - min(c.date)) / CAST(365.25 AS DOUBLE), 0) AS years_before
  FROM windows w LEFT JOIN claims c ON c.person_id = w.person_id AND c.date < w.cohort_start_date GROUP BY w.person_id),
c_rows AS (
  SELECT a.*, n_prior, years_before, time_to_delivery + (a.person_id % 997) / CAST(997 AS DOUBLE) AS fine_time,
         CASE WHEN IUI = 'IUI' THEN 1 ELSE 0 END AS y
  FROM analysis a JOIN history h ON h.person_id = a.person_id),
c_points AS (SELECT n_prior AS x1, years_before AS x2, y FROM c_rows),
c_fit AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2,
         CAST(0 AS DOUBLE) AS v0, CAST(0 AS DOUBLE) AS v1, CAST(0 AS DOUBLE) AS v2
  UNION ALL
  SELECT step + 1, b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
         b1 + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
         b2 + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det,
         (h11 * h22 - h12 * h12) / det, (h00 * h22 - h02 * h02) / det, (h00 * h11 - h01 * h01) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
        FROM (SELECT step, b0, b1, b2, sum(y - p) AS g0, sum((y - p) * x1) AS g1, sum((y - p) * x2) AS g2, sum(v) AS h00,
                     sum(v * x1) AS h01, sum(v * x2) AS h02, sum(v * x1 * x1) AS h11, sum(v * x1 * x2) AS h12, sum(v * x2 * x2) AS h22
              FROM (SELECT *, p * (1 - p) AS v FROM (
                      SELECT step, b0, b1, b2, x1, x2, y, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p
                      FROM c_fit CROSS JOIN c_points WHERE step < 15))
              GROUP BY step, b0, b1, b2))),
c_model AS (SELECT * FROM c_fit ORDER BY step DESC LIMIT 1),
c_weighted AS (
  SELECT *, CASE WHEN y = 1 THEN 1 / p_IUI ELSE 1 / (1 - p_IUI) END AS ip_weight
  FROM (SELECT r.*, 1 / (1 + exp(-(b0 + b1 * n_prior + b2 * years_before))) AS p_IUI FROM c_rows r CROSS JOIN c_model)),
c_leaving AS (
  SELECT IUI AS "group", fine_time AS time, count(*) FILTER (event_delivery) AS n_event,
         coalesce(sum(ip_weight) FILTER (event_delivery), 0) AS d, sum(ip_weight) AS w, sum(ip_weight * ip_weight) AS w2
  FROM c_weighted WHERE fine_time IS NOT NULL GROUP BY 1, 2),
c_risk AS (
  SELECT "group", time, n_event, d, sum(w) OVER later_on AS r, sum(w2) OVER later_on AS r2
  FROM c_leaving WINDOW later_on AS (PARTITION BY "group" ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
c_steps AS (
  SELECT * FROM c_risk
  UNION ALL
  SELECT "group", 0, 0, 0, max(r), max(r2) FROM c_risk GROUP BY "group" HAVING min(time) > 0),
c_sums AS (
  SELECT "group", time, n_event, max(time) OVER (PARTITION BY "group") AS last_time,
         CASE WHEN bool_or(r - d <= r * 1e-9) OVER so_far THEN 0
              ELSE exp(sum(CASE WHEN r - d <= r * 1e-9 THEN 0 ELSE ln(1 - d / r) END) OVER so_far) END AS surv,
         sum(CASE WHEN r - d <= r * 1e-9 THEN 0 ELSE d / (r * r / r2 * (r - d)) END) OVER so_far AS hv
  FROM c_steps WINDOW so_far AS (PARTITION BY "group" ORDER BY time ROWS UNBOUNDED PRECEDING)),
c_curve AS (
  SELECT "group", time, surv, CASE WHEN surv > 0 THEN surv * sqrt(hv) END AS se
  FROM c_sums WHERE time = 0 OR n_event > 0 OR time = last_time),
c_held AS (
  SELECT time, last_value(a IGNORE NULLS) OVER up_to AS a, last_value(b IGNORE NULLS) OVER up_to AS b,
         time <= (SELECT max(time) FROM c_curve WHERE "group" = 'ART') AS in_a, time <= (SELECT max(time) FROM c_curve WHERE "group" = 'IUI') AS in_b
  FROM (SELECT time, max(CASE WHEN "group" = 'ART' THEN {'surv': surv, 'se': se} END) AS a,
               max(CASE WHEN "group" = 'IUI' THEN {'surv': surv, 'se': se} END) AS b FROM c_curve GROUP BY time)
  WINDOW up_to AS (ORDER BY time ROWS UNBOUNDED PRECEDING)),
c_diff AS (
  SELECT time, CASE WHEN in_a AND in_b THEN a.surv - b.surv END AS diff,
         CASE WHEN in_a AND in_b THEN sqrt(a.se * a.se + b.se * b.se) END AS se FROM c_held),
c_long AS (
  SELECT y, ip_weight AS w, x.name AS covariate, x.value AS value FROM (
    SELECT y, ip_weight, unnest([
      {'name': 'prop.score', 'value': p_IUI}, {'name': 'alcohol', 'value': alcohol}, {'name': 'tobacco', 'value': tobacco},
      {'name': 'obesity', 'value': obesity}, {'name': 'pcos', 'value': pcos}, {'name': 'f_infert', 'value': f_infert},
      {'name': 'm_infert', 'value': m_infert}, {'name': 'n_prior', 'value': n_prior}, {'name': 'years_before', 'value': years_before}]) AS x
    FROM c_weighted)),
c_moments AS (
  SELECT covariate, y, avg(value) AS m, var_samp(value) AS v, sum(w * value) / sum(w) AS wm,
         (sum(w * value * value) - sum(w) * pow(sum(w * value) / sum(w), 2)) / (sum(w) - sum(w * w) / sum(w)) AS wv,
         bool_and(value IN (0, 1)) AS is_flag
  FROM c_long GROUP BY covariate, y),
c_shares AS (
  SELECT covariate, max(abs(below_t / all_t - below_c / all_c)) AS ks_un, max(abs(wbelow_t / wall_t - wbelow_c / wall_c)) AS ks_adj
  FROM (SELECT covariate, value, sum(sum(y)) OVER v AS below_t, sum(sum(1 - y)) OVER v AS below_c,
               sum(sum(w * y)) OVER v AS wbelow_t, sum(sum(w * (1 - y))) OVER v AS wbelow_c
        FROM c_long GROUP BY covariate, value WINDOW v AS (PARTITION BY covariate ORDER BY value ROWS UNBOUNDED PRECEDING))
  JOIN (SELECT covariate, sum(y) AS all_t, sum(1 - y) AS all_c, sum(w * y) AS wall_t, sum(w * (1 - y)) AS wall_c
        FROM c_long GROUP BY covariate) USING (covariate)
  GROUP BY covariate),
c_balance AS (
  SELECT t.covariate, CASE WHEN t.covariate = 'prop.score' THEN 'distance' WHEN t.is_flag AND c.is_flag THEN 'binary' ELSE 'contin.' END AS kind,
         t.m - c.m AS d_un, t.wm - c.wm AS d_adj, sqrt((t.v + c.v) / 2) AS pooled, t.v / c.v AS r_un, t.wv / c.wv AS r_adj
  FROM c_moments t JOIN c_moments c ON c.covariate = t.covariate AND t.y = 1 AND c.y = 0)
"""
FINAL["propensity_continuous"] = f"""
    SELECT term, {r6('estimate', 'estimate')}, {r6('std_error', 'std_error')} FROM (
      SELECT unnest(['(Intercept)', 'n_prior', 'years_before']) AS term, unnest([b0, b1, b2]) AS estimate,
             unnest([sqrt(v0), sqrt(v1), sqrt(v2)]) AS std_error FROM c_model)"""
FINAL["weight_summary_continuous"] = FINAL["weight_summary"].replace("FROM weighted", "FROM c_weighted")
FINAL["km_continuous"] = f"""
    SELECT "group", {r6('time', 'time')}, {r6('surv', 'surv')}, {r6('se', 'se')}, {r6(f'surv - {Z} * se', 'ci_lower')},
           {r6(f'surv + {Z} * se', 'ci_upper')} FROM c_curve"""
FINAL["curve_diff_continuous"] = FINAL["curve_diff"].replace("SELECT time,", f"SELECT {r6('time', 'time')},").replace("FROM diff", "FROM c_diff")
FINAL["balance_continuous"] = f"""
    SELECT covariate, kind, {r6("d_un / CASE WHEN kind = 'binary' THEN 1 ELSE pooled END", 'diff_unadjusted')},
           {r6("d_adj / CASE WHEN kind = 'binary' THEN 1 ELSE pooled END", 'diff_adjusted')},
           CASE WHEN kind <> 'binary' THEN round(r_un, 6) + 0.0 END AS ratio_unadjusted,
           CASE WHEN kind <> 'binary' THEN round(r_adj, 6) + 0.0 END AS ratio_adjusted,
           {r6('ks_un', 'ks_unadjusted')}, {r6('ks_adj', 'ks_adjusted')}
    FROM c_balance JOIN c_shares USING (covariate)"""
for _name in ("propensity_continuous", "weight_summary_continuous", "km_continuous", "curve_diff_continuous", "balance_continuous"):
    EXTRA_CTES[_name] = CONTINUOUS_CTES

# ---- nested definitions
NESTED = """,
n_entries AS (
  SELECT DISTINCT 11 AS cohort_definition_id, c.person_id, c.date AS entry_date, obs_end
  FROM claims c JOIN obs USING (person_id)
  WHERE concept_set IN ('ART', 'IUI') AND date >= DATE '1996-01-01' AND date >= obs_start + 180
  UNION ALL
  SELECT DISTINCT 12, c.person_id, c.date, obs_end FROM claims c JOIN obs USING (person_id)
  WHERE concept_set = 'ART' AND date >= DATE '1997-01-01' AND date >= obs_start + 365
    AND EXISTS (SELECT 1 FROM claims b WHERE b.person_id = c.person_id AND b.concept_set = 'IUI' AND b.date < c.date)),
n_counts AS (
  SELECT cohort_definition_id, e.person_id, entry_date, any_value(obs_end) AS obs_end,
         count(*) FILTER (s = 'f_infert' AND d BETWEEN -730 AND 0) AS infertile,
         count(*) FILTER (s = 'PCOS' AND d BETWEEN -365 AND 0) AS pcos,
         count(*) FILTER (s = 'labor' AND d BETWEEN -365 AND -1) AS delivered,
         count(DISTINCT d) FILTER (s IN ('ART', 'IUI') AND d BETWEEN -180 AND -1) AS treated_days,
         count(*) FILTER (s = 'tobacco' AND d BETWEEN -365 AND 0) AS smoked,
         count(*) FILTER (s = 'alcohol' AND d BETWEEN -365 AND 0) AS drank,
         count(*) FILTER (s IN ('abortion', 'stillbirth') AND d BETWEEN -365 AND -1) AS lost,
         count(*) FILTER (s = 'pregnant' AND d BETWEEN -365 AND -1) AS conceived,
         min(day) FILTER (s IN ('stillbirth', 'abortion') AND d >= 1) AS next_loss,
         min(day) FILTER (s = 'labor' AND d >= 1) AS next_labor
  FROM (SELECT e.*, c.concept_set AS s, c.date AS day, c.date - e.entry_date AS d
        FROM n_entries e JOIN claims c ON c.person_id = e.person_id) e
  GROUP BY cohort_definition_id, e.person_id, entry_date),
n_evaluated AS (
  SELECT 11 AS cohort_definition_id, person_id, entry_date, obs_end, next_loss AS censor, 424 AS max_days, 3 AS passed,
         CAST(CASE WHEN infertile >= 1 OR (pcos >= 1 AND NOT delivered >= 1) THEN 1 ELSE 0 END
              + CASE WHEN CAST(treated_days >= 2 AS INTEGER) + CAST(smoked = 0 AS INTEGER) + CAST(drank = 0 AS INTEGER) >= 2
                     THEN 2 ELSE 0 END AS BIGINT) AS mask
  FROM n_counts WHERE cohort_definition_id = 11
  UNION ALL
  SELECT 12, person_id, entry_date, obs_end, next_labor, 90, 1, CAST(CASE WHEN lost >= 1 AND conceived >= 1 THEN 0 ELSE 1 END AS BIGINT)
  FROM n_counts WHERE cohort_definition_id = 12),
n_best AS (
  SELECT * FROM n_evaluated QUALIFY row_number() OVER (
    PARTITION BY cohort_definition_id, person_id ORDER BY bit_count(mask) DESC, entry_date) = 1),
n_exits AS (
  SELECT *, CASE WHEN censor = finish THEN 'censored' WHEN entry_date + max_days = finish THEN 'follow-up' ELSE 'observation' END AS exit_reason
  FROM (SELECT *, least(obs_end, entry_date + max_days, censor) AS finish FROM n_evaluated WHERE mask = passed)
  QUALIFY cohort_definition_id = 12 OR row_number() OVER (PARTITION BY cohort_definition_id, person_id ORDER BY entry_date) = 1)
"""
FINAL["cohort_nested"] = """
    SELECT cohort_definition_id, person_id AS subject_id, entry_date AS cohort_start_date, finish AS cohort_end_date
    FROM n_exits WHERE cohort_definition_id = 11
    UNION ALL
    SELECT 12, person_id, min(entry_date), max(finish)
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY person_id ORDER BY entry_date ROWS UNBOUNDED PRECEDING) AS era
          FROM (SELECT *, CASE WHEN entry_date <= max(finish) OVER (PARTITION BY person_id ORDER BY entry_date
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
                FROM n_exits WHERE cohort_definition_id = 12))
    GROUP BY person_id, era"""
FINAL["cohort_nested_inclusion"] = """
    SELECT cohort_definition_id, mask AS inclusion_mask, count(*) AS person_count, 'event' AS mode FROM n_evaluated GROUP BY 1, 2
    UNION ALL
    SELECT cohort_definition_id, mask, count(*), 'person' FROM n_best GROUP BY 1, 2"""
FINAL["cohort_nested_attrition"] = """
    SELECT cohort_definition_id, 0 AS rule_sequence, 'all entries' AS rule_name, count(*) AS person_count, CAST(0 AS BIGINT) AS drop_count
    FROM n_best GROUP BY cohort_definition_id
    UNION ALL
    SELECT 11, 1, 'infertility, or PCOS without a delivery', count(*) FILTER (mask % 2 = 1), count(*) FILTER (mask % 2 = 0)
    FROM n_best WHERE cohort_definition_id = 11
    UNION ALL
    SELECT 11, 2, 'two of: two days of treatment, no tobacco, no alcohol', count(*) FILTER (mask = 3), count(*) FILTER (mask = 1)
    FROM n_best WHERE cohort_definition_id = 11
    UNION ALL
    SELECT 12, 1, 'no loss after a pregnancy', count(*) FILTER (mask = 1), count(*) FILTER (mask = 0)
    FROM n_best WHERE cohort_definition_id = 12"""
FINAL["cohort_censoring"] = """
    SELECT cohort_definition_id, exit_reason, count(*) AS entry_count, count(DISTINCT person_id) AS person_count
    FROM n_exits GROUP BY cohort_definition_id, exit_reason"""
for _name in ("cohort_nested", "cohort_nested_inclusion", "cohort_nested_attrition", "cohort_censoring"):
    EXTRA_CTES[_name] = NESTED

# ---- stores, closure, orders
FINAL["cohort_store"] = """
    SELECT cohort_definition_id, person_id AS subject_id, entry_date AS cohort_start_date,
           least(obs_end, entry_date + CASE WHEN cohort_definition_id = 1 THEN 100 ELSE max_days END) AS cohort_end_date,
           count(*) OVER (PARTITION BY cohort_definition_id) AS row_count
    FROM evaluated WHERE mask = passed"""
FINAL["pull_pruned"] = """
    SELECT c.person_id, date, concept_id, concept_set FROM claims c JOIN evaluated e ON e.person_id = c.person_id
    WHERE cohort_definition_id = 2 AND mask = passed AND concept_set IN ('pregnant', 'abortion', 'stillbirth', 'labor')
      AND date BETWEEN entry_date AND least(obs_end, entry_date + max_days)"""
EXTRA_CTES["cohort_store"] = EXTRA_CTES["pull_pruned"] = GENERATED
FINAL["cohort_catalog"] = "SELECT * FROM cohort"
FINAL["pull_stored"] = """
    SELECT person_id, date, concept_id, concept_set FROM txt UNION ALL SELECT person_id, date, concept_id, concept_set FROM preg"""
FINAL["coalesce_unlike"] = """
    SELECT person_id, concept_id_IUI, concept_set_ART, coalesce(CAST(concept_id_IUI AS VARCHAR), concept_set_ART) AS first_known FROM baseline"""
FINAL["pregnancies_numbered"] = """
    SELECT person_id, date, concept_id, concept_set, row_number() OVER (
      ORDER BY date, list_position(['pregnant', 'abortion', 'stillbirth', 'labor'], concept_set), person_id, concept_id) AS position FROM preg"""
EXTRA_CTES["concept_closure"] = """,
links AS (
  SELECT CAST(p_size AS BIGINT) + 1000000000000 AS above, p_partkey AS below FROM part
  UNION ALL
  SELECT s // 2 + 1000000000000, s + 1000000000000 FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS s FROM part) WHERE s > 1),
walks AS (
  SELECT above AS a, below AS d, 1 AS steps FROM links
  UNION ALL
  SELECT a, below, steps + 1 FROM walks JOIN links ON d = above)"""
FINAL["concept_closure"] = """
    SELECT a AS ancestor_concept_id, d AS descendant_concept_id, min(steps) AS min_levels FROM walks GROUP BY a, d
    UNION ALL
    SELECT c, c, 0 FROM (SELECT above AS c FROM links UNION SELECT below FROM links)"""


def oracle_sql(person: int) -> dict[str, str]:
    """Query name -> SQL; ``person`` is the id looked up by qc_person_lookup."""
    return {
        name: CTES + EXTRA_CTES.get(name, "") + final.replace("{person}", str(person)) for name, final in FINAL.items()
    }
