"""Reference statement per registered query."""

from __future__ import annotations

from oracle import compose
from oracle.models import clustered_tables, cox_tables, glm_tables, padded
from oracle.tables import MEMBER_COLUMNS, WAVE_VALUES, WIDE_VALUES, members_wide

BINARY = ("smk_overall", "alc_overall", "famhx_htn", "famhx_dm", "famhx_cvd", "chd", "cva", "ckd",
          "dm_biomarker0", "htn")
CATEGORICAL = ("educcat", "employocccat", "multimorbiditycat", "bmicat")
CONTINUOUS = ("age", "bmi", "waist_cm")


def r(expression: str, alias: str | None = None, digits: int = 6) -> str:
    return f"round({expression}, {digits}) AS {alias or expression}"


def text(column: str) -> str:
    return f"CAST({column} AS VARCHAR) AS {column}"


def fixed(expression: str, digits: int) -> str:
    """Fixed decimals, ties away from zero; NA for a missing value."""
    scaled = f"floor(abs({expression}) * {10 ** digits} + 0.5) / {10 ** digits}"
    return (f"coalesce(CASE WHEN {expression} < 0 AND {scaled} > 0 THEN '-' ELSE '' END || "
            f"printf('%.{digits}f', {scaled}), 'NA')")


_WIDE_ROUNDED = ", ".join(
    (r(f"{v}{i}", digits=9) if v in ("fpg", "hba1c") else text(f"{v}{i}") if v == "visit_date" else f"{v}{i}")
    for v in WIDE_VALUES for i in range(4))


def _base(digits: int) -> str:
    return ("pid, hhid, carrs, site, sex, " + text("doi") + ", age, educstat, employ, occ, height_cm, "
            + ", ".join(r(c, digits=digits) for c in ("weight_kg", "bmi", "waist_cm"))
            + ", smk_overall, alc_overall, famhx_dm, famhx_htn, famhx_cvd, htn, dm, chd, cva, ckd, fup, year")


_ROUNDED_MEMBER = {"bmi", "waist_cm", "time_to_dm"}


def _dyad_columns() -> str:
    columns = []
    for suffix in ("husb", "wife"):
        for c in MEMBER_COLUMNS:
            name = f"{c}_{suffix}"
            columns.append(r(name) if c in _ROUNDED_MEMBER else text(name) if c == "DateDMbiomarker" else name)
    return ", ".join(columns)


def _stack(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _continuous(k: int, v: str) -> str:
    w, h = f"{v}_wife", f"{v}_husb"
    return (f"SELECT {k} AS position, '{v}' AS variable, avg({w}) AS mean_female, stddev_samp({w}) AS sd_female, "
            f"100.0 * avg(CAST({w} IS NULL AS INT)) AS missing_female, avg({h}) AS mean_male, "
            f"stddev_samp({h}) AS sd_male, 100.0 * avg(CAST({h} IS NULL AS INT)) AS missing_male, "
            f"corr({w}, {h}) AS correlation FROM dyad_t")


def _binary(k: int, v: str) -> str:
    w, h = f"{v}_wife", f"{v}_husb"
    parts = []
    for name, c in (("female", w), ("male", h)):
        parts.append(f"count(*) FILTER ({c} = 1) AS n_{name}, count({c}) AS known_{name}, "
                     f"100.0 * count(*) FILTER ({c} = 1) / nullif(count({c}), 0) AS pct_{name}, "
                     f"100.0 * avg(CAST({c} IS NULL AS INT)) AS missing_{name}")
    return f"SELECT {k} AS position, '{v}' AS variable, {', '.join(parts)} FROM dyad_t"


STACKED = _stack(
    f"SELECT '{v}' AS variable, '{role}' AS who, CAST({v}_{suffix} AS INT) AS level FROM dyad_t"
    for v in CATEGORICAL for role, suffix in (("female", "wife"), ("male", "husb")))
LEVELS = """
SELECT variable, level, count(*) FILTER (who = 'female') AS n_female, count(*) FILTER (who = 'male') AS n_male
FROM stacked_t GROUP BY variable, level"""
SHARES = """
SELECT variable, level, n_female, n_male,
       100.0 * n_female / nullif(known_female, 0) AS pct_female, 100.0 * miss_female / (known_female + miss_female) AS missing_female,
       100.0 * n_male / nullif(known_male, 0) AS pct_male, 100.0 * miss_male / (known_male + miss_male) AS missing_male
FROM (SELECT *,
  sum(n_female) FILTER (level IS NOT NULL) OVER (PARTITION BY variable) AS known_female,
  coalesce(sum(n_female) FILTER (level IS NULL) OVER (PARTITION BY variable), 0) AS miss_female,
  sum(n_male) FILTER (level IS NOT NULL) OVER (PARTITION BY variable) AS known_male,
  coalesce(sum(n_male) FILTER (level IS NULL) OVER (PARTITION BY variable), 0) AS miss_male
  FROM level_t) s WHERE level IS NOT NULL"""

CHI = """
SELECT variable, sum(part) AS statistic, CAST(max(levels) - 1 AS INT) AS df FROM (
  SELECT variable, levels, (greatest(abs(n - e) - CASE WHEN levels = 2 THEN least(0.5, smallest) ELSE 0 END, 0)) ** 2 / e AS part
  FROM (SELECT *, min(abs(n - e)) OVER (PARTITION BY variable) AS smallest FROM (
    SELECT variable, who, n, levels,
           CAST(sum(n) OVER (PARTITION BY variable, level) AS DOUBLE) * sum(n) OVER (PARTITION BY variable, who)
             / sum(n) OVER (PARTITION BY variable) AS e
    FROM (SELECT variable, level, 'f' AS who, n_female AS n, count(*) OVER (PARTITION BY variable) AS levels
          FROM level_t WHERE level IS NOT NULL
          UNION ALL
          SELECT variable, level, 'm', n_male, count(*) OVER (PARTITION BY variable) FROM level_t WHERE level IS NOT NULL) a) b) c) d
GROUP BY variable"""


def chi_square_tail(x: str, df: str, most: int = 6) -> str:
    """Upper tail for 1..most degrees of freedom as a finite sum."""
    branches = []
    for k in range(1, most + 1):
        if k % 2 == 0:
            total = " + ".join(f"({x} / 2) ** {j} / {_factorial(j)}" for j in range(k // 2))
            branches.append(f"WHEN {k} THEN exp(-{x} / 2) * ({total})")
        else:
            terms = "".join(f" + exp(-{x} / 2) * ({x} / 2) ** {j + 0.5} / gamma({j + 1.5})" for j in range(k // 2))
            branches.append(f"WHEN {k} THEN {erfc(f'sqrt({x} / 2)')}{terms}")
    return f"CASE {df} {' '.join(branches)} END"


def _factorial(n: int) -> int:
    return 1 if n < 2 else n * _factorial(n - 1)


def erfc(x: str) -> str:
    """Complementary error function: series below 3, continued fraction above."""
    series = (f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: "
              f"(CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END) * exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - lgamma(k + 1)) / (2 * k + 1))))")
    fraction = "z"
    for k in range(40, 0, -1):
        fraction = f"(z + {k / 2} / {fraction})"
    # The fraction is written for z; a list of one element binds it.
    tail = f"list_transform([abs({x})], lambda z: exp(-z * z) / sqrt(pi()) / {fraction})[1]"
    return f"(CASE WHEN abs({x}) < 3 THEN {series} ELSE {tail} END)"


RISK = """
SELECT role, partner_baseline_dm, CAST(sum(count(*)) OVER (PARTITION BY role) AS BIGINT) AS role_n, count(*) AS partner_n,
       100.0 * nullif(count(*) FILTER (dm_incident = 0), 0) / count(*) AS no_diabetes_pct,
       100.0 * nullif(count(*) FILTER (dm_incident = 1), 0) / count(*) AS diabetes_pct
FROM role_t WHERE baseline_dm = 0 AND partner_baseline_dm IS NOT NULL AND dm_incident IS NOT NULL
GROUP BY role, partner_baseline_dm"""
_RISK_TEXT = """role || ' without diabetes at baseline (n=' || role_n || ')' AS {a},
       CASE partner_baseline_dm WHEN 0 THEN 'No diabetes' ELSE 'Diabetes' END || ' (n=' || partner_n || ')' AS {b}"""

MEANS = """
SELECT role, partner_baseline_dm, 'dm_incident' AS variable, count(*) AS n, count(*) - count(dm_incident) AS nmiss,
       count(dm_incident) AS known, avg(dm_incident) AS mean, CAST(sum(dm_incident) AS DOUBLE) AS total,
       CASE WHEN count(dm_incident) > 1 THEN stddev_samp(dm_incident) / sqrt(count(dm_incident)) END AS err
FROM role_t WHERE baseline_dm = 0 GROUP BY role, partner_baseline_dm"""
RATIOS = """
SELECT s.role, s.partner_baseline_dm, any_value(total) AS n, count(x) AS pairs,
       CASE WHEN count(x) > 1 THEN any_value(ratio) END AS ratio,
       CASE WHEN count(x) > 1 THEN sqrt(var_samp(x - ratio * y) / (count(x) * avg(y) ** 2)) END AS err
FROM (SELECT *, avg(x) OVER (PARTITION BY role, partner_baseline_dm) / nullif(avg(y) OVER (PARTITION BY role, partner_baseline_dm), 0) AS ratio,
             count(*) OVER (PARTITION BY role, partner_baseline_dm) AS total
      FROM (SELECT role, partner_baseline_dm,
                   CASE WHEN time_to_dm IS NOT NULL THEN CAST(dm_incident AS DOUBLE) END AS x,
                   CASE WHEN dm_incident IS NOT NULL THEN time_to_dm END AS y
            FROM role_t WHERE baseline_dm = 0) a) s
GROUP BY s.role, s.partner_baseline_dm"""

# Critical value of Student's t by bisection on the finite sum for whole degrees of freedom.
_MASS = """CASE WHEN df % 2 = 0
  THEN sin(a) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + 2 * k * ln(cos(a)))))
  ELSE 2 / pi() * (a + CASE WHEN df = 1 THEN 0 ELSE sin(a) * list_sum(list_transform(range(0, (df - 1) // 2),
       lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + 0.5 * ln(pi()) - ln(2) + (2 * k + 1) * ln(cos(a))))) END) END"""
T_NEEDED = """
SELECT DISTINCT CAST(known - 1 AS BIGINT) AS df FROM means_t WHERE known > 1
UNION SELECT DISTINCT CAST(pairs - 1 AS BIGINT) FROM ratios_t WHERE pairs > 1"""
T_SEARCH = f"""
SELECT df, 0 AS step, 0.0::DOUBLE AS low, 700.0::DOUBLE AS high FROM tneeded_t
UNION ALL
SELECT df, step + 1, CASE WHEN mass < 0.95 THEN mid ELSE low END, CASE WHEN mass < 0.95 THEN high ELSE mid END
FROM (SELECT *, {_MASS} AS mass FROM (
        SELECT *, (low + high) / 2 AS mid, atan((low + high) / 2 / sqrt(df)) AS a FROM tsearch_t WHERE step < 70) m) s"""
T_CRIT = "SELECT df, (low + high) / 2 AS t FROM tsearch_t WHERE step = 70"

def _pair(k: int, v: str) -> str:
    return (f"SELECT {k} AS position, '{v}' AS variable, CAST({v}_husb AS INT) AS m, CAST({v}_wife AS INT) AS f FROM dyad_t "
            f"WHERE {v}_husb IS NOT NULL AND {v}_wife IS NOT NULL")


# Exact test: weights over the support, then bisection on the log odds ratio
# for the estimate and both limits.
FISHER_CELLS = """
SELECT position, variable, CASE WHEN two THEN n00 END AS n00, CASE WHEN two THEN n01 END AS n01,
       CASE WHEN two THEN n10 END AS n10, CASE WHEN two THEN n11 END AS n11
FROM (SELECT position, variable, count(DISTINCT m) = 2 AND count(DISTINCT f) = 2 AS two,
             count(*) FILTER (m = m0 AND f = f0) AS n00, count(*) FILTER (m = m0 AND f = f1) AS n01,
             count(*) FILTER (m = m1 AND f = f0) AS n10, count(*) FILTER (m = m1 AND f = f1) AS n11
      FROM (SELECT *, min(m) OVER w AS m0, max(m) OVER w AS m1, min(f) OVER w AS f0, max(f) OVER w AS f1
            FROM fpair_t WINDOW w AS (PARTITION BY variable)) a GROUP BY position, variable) b"""
FISHER_SUPPORT = """
SELECT variable, n00 AS x, lo, hi, j, lgamma(col + 1) - lgamma(j + 1) - lgamma(col - j + 1)
         + lgamma(oth + 1) - lgamma(tot - j + 1) - lgamma(oth - tot + j + 1) AS w
FROM (SELECT variable, n00, col, oth, tot, lo, hi, unnest(range(lo, hi + 1)) AS j FROM (
  SELECT variable, n00, n00 + n10 AS col, n01 + n11 AS oth, n00 + n01 AS tot,
         greatest(0, n00 + n01 - n01 - n11) AS lo, least(n00 + n01, n00 + n10) AS hi FROM fcell_t WHERE n00 IS NOT NULL) c) s"""
FISHER_SEARCH = """
SELECT variable, kind, 0 AS step, -30.0::DOUBLE AS low, 30.0::DOUBLE AS high
FROM (SELECT DISTINCT variable FROM fsupport_t) v, (VALUES ('mean'), ('lower'), ('upper')) k(kind)
UNION ALL
SELECT variable, kind, step + 1, CASE WHEN above THEN low ELSE mid END, CASE WHEN above THEN mid ELSE high END
FROM (SELECT variable, kind, step, low, high, mid, CASE kind WHEN 'mean' THEN sum(q * j) / sum(q) > max(x)
               WHEN 'lower' THEN sum(CASE WHEN j >= x THEN q ELSE 0 END) / sum(q) > 0.025
               ELSE sum(CASE WHEN j <= x THEN q ELSE 0 END) / sum(q) < 0.025 END AS above
      FROM (SELECT s.*, f.kind, f.step, f.low, f.high, (f.low + f.high) / 2 AS mid,
                   exp(s.w + s.j * (f.low + f.high) / 2 - max(s.w + s.j * (f.low + f.high) / 2) OVER (PARTITION BY s.variable, f.kind)) AS q
            FROM fsearch_t f JOIN fsupport_t s ON f.variable = s.variable WHERE f.step < 60) a
      GROUP BY variable, kind, step, low, high, mid) b"""
FISHER = """
SELECT c.*, CASE WHEN e.x = e.lo THEN 0 ELSE exp(e.mean) END AS odds_ratio, CASE WHEN e.x = e.lo THEN 0 ELSE exp(e.lower) END AS conf_low,
       exp(e.upper) AS conf_high, p.p AS p_value
FROM fcell_t c LEFT JOIN (
  SELECT f.variable, any_value(s.x) AS x, any_value(s.lo) AS lo, max((low + high) / 2) FILTER (kind = 'mean') AS mean,
         max((low + high) / 2) FILTER (kind = 'lower') AS lower, max((low + high) / 2) FILTER (kind = 'upper') AS upper
  FROM fsearch_t f JOIN (SELECT DISTINCT variable, x, lo FROM fsupport_t) s ON f.variable = s.variable
  WHERE step = 60 GROUP BY f.variable) e ON e.variable = c.variable
LEFT JOIN (SELECT variable, least(sum(CASE WHEN q <= qx * (1 + 1e-7) THEN q ELSE 0 END) / sum(q), 1) AS p
           FROM (SELECT *, max(CASE WHEN j = x THEN q END) OVER (PARTITION BY variable) AS qx
                 FROM (SELECT *, exp(w - max(w) OVER (PARTITION BY variable)) AS q FROM fsupport_t) a) b GROUP BY variable) p
  ON p.variable = c.variable"""
_MISSING = {role: fixed(f"missing_{role}", 1) + f" || '%' AS missing_{role}" for role in ("female", "male")}
TABLE_ONE = f"""
SELECT 1 AS section, position, 0::BIGINT AS line, variable, CAST(NULL AS VARCHAR) AS level,
       {fixed('mean_female', 1)} || ' (' || {fixed('sd_female', 1)} || ')' AS female,
       {fixed('mean_male', 1)} || ' (' || {fixed('sd_male', 1)} || ')' AS male, {fixed('correlation', 3)} AS compare,
       {_MISSING['female']}, {_MISSING['male']} FROM contsum_t
UNION ALL
SELECT 2, b.position, 0, b.variable, NULL, n_female || ' (' || {fixed('pct_female', 1)} || '%)',
       n_male || ' (' || {fixed('pct_male', 1)} || '%)',
       CASE WHEN odds_ratio IS NULL THEN 'NA' ELSE {fixed('odds_ratio', 2)} || ' (' || {fixed('conf_low', 2)} || ', ' || {fixed('conf_high', 2)} || ')' END,
       {_MISSING['female']}, {_MISSING['male']}
FROM binsum_t b LEFT JOIN fisher_t f ON f.variable = b.variable
UNION ALL
SELECT 3, list_position({list(CATEGORICAL)}, s.variable) - 1, line, CASE line WHEN 0 THEN s.variable ELSE '' END, CAST(level AS VARCHAR),
       {fixed('pct_female', 1)} || '%', {fixed('pct_male', 1)} || '%',
       CASE WHEN line > 0 THEN '' WHEN p < 0.001 THEN '< 0.001' ELSE {fixed('p', 3)} END,
       CASE line WHEN 0 THEN {fixed('missing_female', 1)} || '%' ELSE '' END, CASE line WHEN 0 THEN {fixed('missing_male', 1)} || '%' ELSE '' END
FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY level) - 1 AS line FROM share_t) s
JOIN (SELECT variable, {chi_square_tail('statistic', 'df')} AS p FROM chi_t) c ON c.variable = s.variable"""

DESCRIBE_TABLES = {
    "contsum_t": _stack(_continuous(k, v) for k, v in enumerate(CONTINUOUS)),
    "binsum_t": _stack(_binary(k, v) for k, v in enumerate(BINARY)),
    "fpair_t": _stack(_pair(k, v) for k, v in enumerate(BINARY)), "fcell_t": FISHER_CELLS, "fsupport_t": FISHER_SUPPORT,
    "fsearch_t": FISHER_SEARCH, "fisher_t": FISHER,
    "stacked_t": STACKED, "level_t": LEVELS, "share_t": SHARES, "chi_t": CHI, "risk_t": RISK,
    "means_t": MEANS, "ratios_t": RATIOS, "tneeded_t": T_NEEDED, "tsearch_t": T_SEARCH, "tcrit_t": T_CRIT,
    "cells_t": """
SELECT (a.k + 2 * b.k) AS position, a.label AS Women_Status, b.label AS Men_Status,
       (SELECT count(*) FROM dyad_t WHERE dm_biomarker0_wife = a.k AND dm_biomarker0_husb = b.k) AS Count
FROM (VALUES (0, 'No diabetes'), (1, 'Diabetes')) a(k, label), (VALUES (0, 'No diabetes'), (1, 'Diabetes')) b(k, label)""",
    "cellpct_t": """
SELECT *, 100.0 * Count / nullif(sum(Count) OVER (), 0) AS overall_pct,
       100.0 * Count / nullif(sum(Count) OVER (PARTITION BY Women_Status), 0) AS row_pct,
       100.0 * Count / nullif(sum(Count) OVER (PARTITION BY Men_Status), 0) AS col_pct FROM cells_t""",
    "celltext_t": "SELECT *, Count || ' (' || " + fixed("overall_pct", 1) + " || '%)' || chr(10) || '(' || "
                  + fixed("row_pct", 1) + " || '%)' || chr(10) || '(' || " + fixed("col_pct", 1)
                  + " || '%)' AS cell_text FROM cellpct_t",
}

_PAIRS = ", ".join(("position", "Women_Status", "Men_Status", "Count", r("overall_pct"), r("row_pct"), r("col_pct"), "cell_text"))
_TERM = "(df = m.known - 1)"

STATEMENTS: dict[str, str] = {
    "visit_outcomes": f"""SELECT pid, carrs, hhid, fup, visit, {r('fpg', digits=9)}, {r('hba1c', digits=9)}, dm, dm_allo, visitcomplete,
        {text('visit_date')}, dm_biomarker, dm_biomarker_nomiss, dm_self, missingbiomarkern FROM outcome_t""",
    "archive_outcomes": "SELECT pid, carrs, fup, respond, dm_self_report, dm_biomarker FROM gated_all_t",
    "missingness_profile": """SELECT carrs, visit, count(*) AS n_total,
        count(*) FILTER (fpg IS NULL) AS nmiss_fpg, round(100.0 * count(*) FILTER (fpg IS NULL) / count(*), 6) AS pctmiss_fpg,
        count(*) FILTER (hba1c IS NULL) AS nmiss_hba1c, round(100.0 * count(*) FILTER (hba1c IS NULL) / count(*), 6) AS pctmiss_hba1c,
        count(*) FILTER (fpg IS NULL AND hba1c IS NULL) AS nmiss_both,
        round(100.0 * count(*) FILTER (fpg IS NULL AND hba1c IS NULL) / count(*), 6) AS pctmiss_both,
        count(*) FILTER (fpg IS NULL OR hba1c IS NULL) AS nmiss_either,
        round(100.0 * count(*) FILTER (fpg IS NULL OR hba1c IS NULL) / count(*), 6) AS pctmiss_either
        FROM visit_t GROUP BY carrs, visit""",
    "visits_wide": f"SELECT pid, {_WIDE_ROUNDED} FROM wide_t",
    "trim_nonresponse": "SELECT pid, carrs, fup, respond, reason FROM trimmed_t",
    "impute_visit_date": f"SELECT pid, carrs, fup, respond, {text('doi')}, doi_day FROM imputed_t",
    "locf_midpoint": "SELECT pid, carrs, fup, doi_day, baseline_day, doi_last AS doi_day_last_obs, prior_day, midpoint_day FROM linked_t",
    "baseline_clean": f"SELECT {_base(6)} FROM base_t",
    "analytic_wide": f"SELECT {_base(9)}, spousedyad_new, {_WIDE_ROUNDED} FROM analytic_t",
    "eligibility_flags": """SELECT pid, hhid, sum_spouse, count_hh, valid_dyad, baseline_bio_all, baseline_bio_one,
        baseline_self, nfollowup, onefollowup, completefollowup, onefollowupbio, completefollowupbio, biocohort,
        valid_at_risk FROM eligible_t""",
    "first_event": f"SELECT pid, firstvisit_DMbiomarker, event_DMbiomarker, {text('DateDMbiomarker')} FROM event_t",
    "recoded_covariates": """SELECT pid, educcat, educcat2, employocccat, bmicat, bmicat2, htn, dm, chd, cva, ckd,
        multimorbidity, multimorbiditycat, multimorbiditycat2 FROM recoded_t""",
    "archive_recodes": """SELECT pid, carrs, fup, sbp, dbp, overweight, hypertension, high_tg, chd, morbidity_number,
        morbidity_category, famhx_cvd, famhx_htn, famhx_dm, alc_overall, smk_overall, bmi_category FROM linked_recoded_t""",
    "event_or_censor_long": """SELECT pid, carrs, fup, hhid, dm_biomarker, dm_incident, dm_incident_day, time_to_dm,
        baseline_dm FROM long_annotated_t""",
    "analytic_long": """SELECT pid, carrs, fup, hhid, dm_biomarker, dm_incident, dm_incident_day, time_to_dm,
        baseline_dm, morbidity_category, bmi_category FROM chain_t""",
    "analytic_waves": "SELECT hhid, carrs, fup, " + ", ".join(f"{s}_{v}" for s in ("female", "male") for v in WAVE_VALUES)
        + " FROM (" + members_wide("chain_t", WAVE_VALUES) + ") w",
    "visits_source": f"SELECT pid, carrs, hhid, fup, visit, {text('doi')}, reason, {r('fpg', digits=9)}, {r('hba1c', digits=9)}, "
        "dm, dm_allo FROM visit_t",
    "baseline_source": f"SELECT * EXCLUDE (spousedyad_new) REPLACE ({text('doi')}, {r('weight_kg')}, {r('bmi')}, {r('waist_cm')}) "
        "FROM person_t",
    "dyad_flags_source": "SELECT pid, hhid, spousedyad_new FROM person_t",
    "staged_outcomes": "SELECT carrs, fup, dm_biomarker, count(*) AS n FROM outcome_t GROUP BY ALL",
    "report_round_trip": """SELECT n_pid, count(*) AS Freq FROM (
        SELECT hhid, count(DISTINCT pid) AS n_pid FROM visit_t GROUP BY hhid) h GROUP BY n_pid""",
    "baseline_ids": """SELECT DISTINCT pid, dm_biomarker AS baseline_event FROM extra_outcome_t
        WHERE fup = 0 AND dm_biomarker IS NOT NULL""",
    "event_or_censor": "SELECT carrs, pid, fup, hhid, dm_incident, dm_incident_day, time_to_dm FROM long_event_t",
    "annotated_visits": """SELECT pid, carrs, fup, hhid, dm_biomarker, dm_incident, dm_incident_day, time_to_dm,
        baseline_dm FROM long_annotated_t""",
    "complete_persons": """SELECT pid, hhid, age FROM person_t WHERE pid IN (SELECT pid FROM extra_t
        WHERE spousedyad_new = 1 AND fup = 0 AND age IS NOT NULL AND sex IS NOT NULL AND edu_category IS NOT NULL
          AND famhx_dm IS NOT NULL)""",
    "person_event_summary": """SELECT carrs, pid, bool_or(fup > 0 AND dm_biomarker IS NOT NULL) AS has_fup_dm_biomarker,
        max(dm_biomarker) FILTER (fup > 0) AS event_dm_biomarker,
        CAST(min(visit_date) FILTER (fup > 0 AND dm_biomarker = 1) AS VARCHAR) AS date_dm_biomarker,
        max(dm_biomarker) FILTER (fup = 0) AS dm_biomarker0
        FROM extra_outcome_t WHERE visit IS NOT NULL AND spousedyad_new = 1 AND (carrs, hhid) IN (
          SELECT (carrs, hhid) FROM extra_t GROUP BY carrs, hhid
          HAVING count(DISTINCT pid) = 2 AND count(DISTINCT CASE WHEN spousedyad_new = 1 THEN pid END) = 2)
        GROUP BY carrs, pid""",
    "biomarker_available": """SELECT DISTINCT carrs, pid FROM extra_outcome_t
        WHERE visit IS NOT NULL AND fup > 0 AND dm_biomarker IS NOT NULL AND pid IN (
          SELECT pid FROM extra_outcome_t WHERE visit IS NOT NULL AND fup = 0 AND missingbiomarkern IN (0, 1))""",
    "distinct_member_dyads": """SELECT e.pid, e.carrs, e.fup, e.hhid, CASE WHEN h.spouses = 2 AND h.members = 2 THEN 1 ELSE 0 END AS valid_dyad
        FROM extra_t e LEFT JOIN (SELECT carrs, hhid, count(DISTINCT pid) AS members,
          count(DISTINCT CASE WHEN spousedyad_new = 1 THEN pid END) AS spouses FROM extra_t GROUP BY carrs, hhid) h
        ON e.carrs = h.carrs AND e.hhid = h.hhid""",
    "followup_completeness": """SELECT carrs, pid, count(DISTINCT visit) AS nfollowup,
        CASE WHEN carrs = 1 AND count(DISTINCT visit) = 4 THEN 1 WHEN carrs = 2 AND count(DISTINCT visit) = 2 THEN 1 ELSE 0 END
          AS complete_followup FROM visit_t WHERE visit IS NOT NULL GROUP BY carrs, pid""",
    "household_composition": """SELECT pid, carrs, fup, hhid, sex FROM extra_t WHERE hhid IN (
        SELECT hhid FROM (SELECT DISTINCT hhid, pid, sex FROM extra_t) m GROUP BY hhid
        HAVING count(*) = 2 AND count(*) FILTER (sex = 'male') = 1 AND count(*) FILTER (sex = 'female') = 1)""",
    "age_gap_filter": """SELECT pid, carrs, fup, hhid, age FROM extra_t WHERE hhid IN (
        SELECT hhid FROM (SELECT DISTINCT hhid, pid, age FROM extra_t WHERE fup = 0) m GROUP BY hhid
        HAVING count(*) = 2 AND count(age) = 2 AND max(age) - min(age) <= 18)""",
    "members_histogram": """SELECT n_pid, count(*) AS Freq FROM (
        SELECT hhid, count(DISTINCT pid) AS n_pid FROM visit_t GROUP BY hhid) h GROUP BY n_pid""",
    "complete_cases": "SELECT pid, carrs, fup, hhid FROM case_t",
    "complete_couples": "SELECT pid, carrs, fup, hhid, sex, age FROM close_t",
    "dyad_table": f"SELECT hhid, {_dyad_columns()}, dyad_at_risk, female_at_risk, male_at_risk FROM dyad_t",
    "cohort_household_summary": """SELECT hhid, CAST(sum(biocohort) AS BIGINT) AS sum_biocohort, count(*) AS count_hh
        FROM cohort_t WHERE hhid IS NOT NULL GROUP BY hhid""",
    "dyad_waves_wide": "SELECT hhid, carrs, fup, " + ", ".join(
        (r(f"{s}_{v}") if v == "bmi" else f"{s}_{v}") for s in ("female", "male") for v in WAVE_VALUES)
        + " FROM (" + members_wide("long_annotated_t", WAVE_VALUES) + ") w",
    "wave_dyads_at_risk": """SELECT hhid, carrs, female_pid, male_pid,
        CASE WHEN female_dm_biomarker = 1 AND male_dm_biomarker = 1 THEN NULL ELSE 1 END AS dyad_at_risk,
        CASE WHEN female_dm_biomarker = 1 OR female_known = 0 THEN NULL ELSE 1 END AS female_at_risk,
        CASE WHEN male_dm_biomarker = 1 OR male_known = 0 OR male_habits = 0 THEN NULL ELSE 1 END AS male_at_risk
        FROM (""" + members_wide(
        "(SELECT *, CASE WHEN age IS NULL OR bmi IS NULL OR edu_category IS NULL OR famhx_dm IS NULL "
        "OR morbidity_category IS NULL THEN 0 ELSE 1 END AS known, "
        "CASE WHEN smk_overall IS NULL OR alc_overall IS NULL THEN 0 ELSE 1 END AS habits "
        "FROM outcome_recoded_t WHERE fup = 0)", ("pid", "dm_biomarker", "known", "habits")) + ") w",
    "event_free_couples": "SELECT * FROM (" + members_wide(
        "(SELECT *, dm_biomarker AS dm_biomarker0 FROM extra_outcome_t WHERE fup = 0)", ("pid", "age", "dm_biomarker0"))
        + ") w WHERE female_dm_biomarker0 = 0 OR male_dm_biomarker0 = 0",
    "role_view": f"""SELECT role, hhid, dyad_at_risk, baseline_dm, partner_baseline_dm, dm_incident, age, edu_category, famhx_dm,
        morbidity_category, bmi_category, alc_overall, smk_overall, {r('time_to_dm')} FROM role_t""",
    "risk_by_partner": f"""SELECT role, partner_baseline_dm, {_RISK_TEXT.format(a='baseline_group', b='partner_group')},
        role_n, partner_n, {r('no_diabetes_pct')}, {r('diabetes_pct')} FROM risk_t""",
    "risk_report": "SELECT " + _RISK_TEXT.format(
        a='"Individual\'s status at baseline"', b='"Individuals with following partner\'s status at baseline"')
        + f""", {fixed('no_diabetes_pct', 1)} AS "No diabetes, %", {fixed('diabetes_pct', 1)} AS "Diabetes, %",
        CASE role WHEN 'Women' THEN 0 ELSE 2 END + partner_baseline_dm AS position FROM risk_t""",
    "mean_table": f"""SELECT role, partner_baseline_dm, variable, n AS N, nmiss AS NMiss, {r('mean', 'Mean')}, total AS Sum,
        {r('err', 'StdErrMean')}, {r('err * known', 'StdErrSum')}, {r('mean - t * err', 'LowerCLMean')},
        {r('mean + t * err', 'UpperCLMean')} FROM means_t LEFT JOIN tcrit_t ON df = known - 1""",
    "ratio_table": f"""SELECT role, partner_baseline_dm, 'dm_incident' AS numerator, 'time_to_dm' AS denominator, n AS N,
        {r('ratio', 'Ratio')}, {r('err', 'StdErr')}, {r('ratio - t * err', 'LowerCL')}, {r('ratio + t * err', 'UpperCL')}
        FROM ratios_t LEFT JOIN tcrit_t ON df = pairs - 1""",
    "incidence_report": f"""SELECT m.role AS population, m.partner_baseline_dm AS spouse_diabetes, m.n AS dm_num,
        {r('100 * q.ratio', 'dm_incidence_100')}, {r('100 * (q.ratio + t * q.err)', 'dm_incidence_100_ucl')},
        {r('100 * (q.ratio - t * q.err)', 'dm_incidence_100_lcl')}, m.total AS dm_events, {r('m.mean', 'dm_risk')}
        FROM means_t m JOIN ratios_t q ON m.role = q.role AND m.n = q.n
          AND m.partner_baseline_dm IS NOT DISTINCT FROM q.partner_baseline_dm
        LEFT JOIN tcrit_t ON df = q.pairs - 1""",
    "events_with_rates": f"""SELECT m.role, m.partner_baseline_dm, m.variable, m.n AS N, m.nmiss AS NMiss, {r('m.mean', 'Mean')},
        m.total AS Sum, {r('m.err', 'StdErrMean')}, {r('m.err * m.known', 'StdErrSum')}, 'time_to_dm' AS denominator,
        {r('q.ratio', 'Ratio')}, {r('q.err', 'StdErr')}
        FROM means_t m JOIN ratios_t q ON m.role = q.role AND m.n = q.n
          AND m.partner_baseline_dm IS NOT DISTINCT FROM q.partner_baseline_dm""",
    "continuous_summary": "SELECT position, variable, " + ", ".join(r(c) for c in (
        "mean_female", "sd_female", "missing_female", "mean_male", "sd_male", "missing_male", "correlation"))
        + " FROM contsum_t",
    "binary_summary": "SELECT position, variable, n_female, known_female, n_male, known_male, " + ", ".join(r(c) for c in (
        "pct_female", "missing_female", "pct_male", "missing_male"))
        + " FROM binsum_t",
    "level_shares": f"""SELECT variable, level, n_female, n_male, {r('pct_female')}, {r('missing_female')}, {r('pct_male')},
        {r('missing_male')} FROM share_t""",
    "contingency": """SELECT educcat_wife, educcat_husb, count(*) AS n FROM dyad_t
        WHERE educcat_wife IS NOT NULL AND educcat_husb IS NOT NULL GROUP BY educcat_wife, educcat_husb""",
    "concordance_cells": f"SELECT {_PAIRS} FROM celltext_t",
    "concordance_display": """SELECT Women_Status, max(cell_text) FILTER (Men_Status = 'No diabetes') AS "No diabetes",
        max(cell_text) FILTER (Men_Status = 'Diabetes') AS "Diabetes" FROM celltext_t GROUP BY Women_Status""",
    "fisher_by_variable": "SELECT position, variable, n00, n01, n10, n11, " + ", ".join(
        r(c) for c in ("odds_ratio", "conf_low", "conf_high", "p_value")) + " FROM fisher_t",
    "table_one": f"SELECT section, CAST(position AS INT) AS position, line, variable, level, female, male, compare, "
                 f"missing_female, missing_male FROM ({TABLE_ONE}) t",
    "chi_square": f"SELECT variable, {r('statistic')}, df, {r(chi_square_tail('statistic', 'df'), 'p_value')} FROM chi_t",
}

ORACLES = {name: compose(statement, DESCRIBE_TABLES) for name, statement in STATEMENTS.items()}


# -- models ------------------------------------------------------------------

def _factor(column: str, levels) -> list[tuple[str, str]]:
    return [(f"{column}{level}", f"coalesce({column} = {level!r}, false)") for level in levels]


AGE = [("partner_dm_statusDiabetes", "partner_baseline_dm = 1"), ("age", "age")]
FIRST = AGE + _factor("edu_category", (2, 3)) + _factor("famhx_dm", (1,))
SECOND = FIRST + _factor("morbidity_category", (1,)) + _factor("bmi_category", (1, 2))
MEN = SECOND + _factor("alc_overall", (2,))
FIRST_KNOWN, SECOND_KNOWN = ["edu_category", "famhx_dm"], ["edu_category", "famhx_dm", "morbidity_category", "bmi_category"]
# (role, model, terms that can be estimated, all terms, columns that must be known)
NESTED = [
    ("Women", "Age adjusted", AGE, AGE, []), ("Women", "Model 1", FIRST, FIRST, FIRST_KNOWN),
    ("Women", "Model 2", SECOND, SECOND, SECOND_KNOWN),
    ("Men", "Age adjusted", AGE, AGE, []), ("Men", "Model 1", FIRST, FIRST, FIRST_KNOWN),
    # Smoking is the complement of the drinking level among these men.
    ("Men", "Model 2", MEN, MEN + _factor("smk_overall", (1,)), SECOND_KNOWN + ["alc_overall", "smk_overall"])]
CRUDE = [(role, "Crude", AGE[:1], AGE[:1], []) for role in ("Women", "Men")]
GLM_FRAME = "baseline_dm = 0 AND partner_baseline_dm IS NOT NULL AND dm_incident IS NOT NULL"


def _known(columns) -> str:
    return "".join(f" AND {c} IS NOT NULL" for c in columns)


def _glm_data(models) -> tuple[str, int]:
    size = 1 + max(len(m[2]) for m in models)
    return _stack(
        f"SELECT '{role}/{name}' AS model, CAST(dm_incident AS DOUBLE) AS y, "
        f"{padded(['1.0', *(e for _, e in terms)], size)} AS x FROM role_t "
        f"WHERE role = '{role}' AND {GLM_FRAME}{_known(known)}" for role, name, terms, _, known in models), size


def _cox_data(models, source: str, frame: str, time: str = "time_to_dm") -> tuple[str, int]:
    size = max(len(m[2]) for m in models)
    return _stack(
        f"SELECT '{role}/{name}' AS model, hhid AS id, {time} AS t, dm_incident AS e, {padded([e for _, e in terms], size)} AS x "
        f"FROM {source} WHERE role = '{role}' AND {frame} AND dm_incident IS NOT NULL AND {time} IS NOT NULL{_known(known)}"
        for role, name, terms, _, known in models), size


def _term_list(models, offset: int) -> str:
    """(model, role, name, position, term, place); place is null where not estimable."""
    rows = []
    for role, name, terms, every, _ in models:
        places = {t: k + 1 + offset for k, (t, _) in enumerate(terms)}
        rows += [f"('{role}/{name}', '{role}', '{name}', {k}, '{t}', {places.get(t, 'NULL')})" for k, (t, _) in enumerate(every)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(model, sex, name, position, term, place)"


def _model_terms(prefix: str, z: float, frame: str, source: str, robust: bool = False) -> str:
    error = "sqrt(q.var)" if robust else "sqrt(f.inv[t.place][t.place])"
    joined = f"LEFT JOIN {prefix}_robust_t q ON q.model = t.model AND q.k = t.place" if robust else ""
    return f"""
SELECT sex, name AS model, CAST(position AS INT) AS position, term, {r('b', 'estimate')}, {r('se', 'std_error')},
       {r('exp(b)', 'ratio')}, {r(f'exp(b - {z} * se)', 'conf_low')}, {r(f'exp(b + {z} * se)', 'conf_high')},
       {r(erfc('(b / se / sqrt(2))').replace('abs((b / se / sqrt(2)))', 'abs(b / se / sqrt(2))'), 'p_value')},
       n_frame, n_model, events, converged
FROM (SELECT t.*, CASE WHEN NOT f.lost[t.place] THEN f.b[t.place] END AS b,
             CASE WHEN NOT f.lost[t.place] THEN {error} END AS se, s.n_model, f.converged,
             (SELECT count(*) FROM {source} WHERE role = t.sex AND {frame}) AS n_frame,
             (SELECT count(*) FROM {source} WHERE role = t.sex AND {frame} AND dm_incident = 1) AS events
      FROM {prefix}_term_t t JOIN {prefix}_end_t f ON f.model = t.model {joined}
      JOIN (SELECT model, count(*) AS n_model FROM {prefix}_data_t GROUP BY model) s ON s.model = t.model) w"""


def _ratios(prefix: str, measure: str, names, frame: str, robust: bool = False, source: str = "role_t",
            place: int = 2, z: float = 1.96, total: str = "CAST(sum(count(*)) OVER (PARTITION BY role) AS BIGINT)") -> str:
    """Printed table of partner ratios: a reference row and an estimate row per role."""
    error = "sqrt(q.var)" if robust else f"sqrt(f.inv[{place}][{place}])"
    joined = f"JOIN {prefix}_robust_t q ON q.model = f.model AND q.k = 2" if robust else ""
    estimate = fixed("exp(b)", 2) + " || ' (' || " + fixed(f"exp(b - {z} * se)", 2) + " || ' - ' || " + fixed(f"exp(b + {z} * se)", 2) + " || ')'"
    columns = ", ".join(
        f"CASE k WHEN 0 THEN '1.00' ELSE (SELECT coalesce({estimate}, 'NA') FROM (SELECT CASE WHEN NOT f.lost[{place}] THEN f.b[{place}] END AS b, "
        f"{error} AS se FROM {prefix}_end_t f {joined} WHERE f.model = g.role || '/{n}') e) END AS \"{n}{'' if n.startswith('Age') else ' adjusted'} {measure} (95% CI)\"" for n in names)
    return f"""
SELECT CAST(CASE role WHEN 'Women' THEN 0 ELSE 2 END + k AS INT) AS position,
       role || ' without diabetes at baseline (n=' || total || ')' AS "Individual's status at baseline",
       CASE k WHEN 0 THEN 'No diabetes' ELSE 'Diabetes' END || ' (n=' || n || ')'
         AS "Individuals with following partner's status at baseline", {columns}
FROM (SELECT role, partner_baseline_dm AS k, count(*) AS n, {total} AS total
      FROM {source} s WHERE {frame} GROUP BY role, partner_baseline_dm) g"""


SPOUSE = [("partner_baseline_dm", "partner_baseline_dm")]


def _plain(columns) -> list[tuple[str, str]]:
    return [(c, c) for c in columns]


def _cox_models():
    models = []
    for role, label in (("Women", "Female"), ("Men", "Male")):
        for name, columns in (("spouse status", []), ("spouse status + age", ["age"]),
                              ("spouse status + Model 1", ["age", "edu_category", "famhx_dm"]),
                              ("spouse status + Model 2", ["age", "edu_category", "famhx_dm", "morbidity_category", "bmi_category"])):
            used, every = list(columns), list(columns)
            if role == "Men" and name.endswith("Model 2"):
                used, every = [*columns, "smk_overall"], [*columns, "smk_overall", "alc_overall"]
            models.append((role, f"{label}: {name}", SPOUSE + _plain(used), SPOUSE + _plain(every), ["partner_baseline_dm", *every]))
    return models


COX_FRAME = "baseline_dm = 0 AND dyad_at_risk = 1 AND time_to_dm IS NOT NULL AND dm_incident IS NOT NULL"
WAVE_FRAME = GLM_FRAME + " AND time_to_dm >= 0"
WAVE_ROLES = _stack(f"""
SELECT '{role}' AS role, w.hhid, w.carrs, w.{own}_pid AS pid, {own}_baseline_dm AS baseline_dm,
       {partner}_baseline_dm AS partner_baseline_dm, {own}_age AS age, {own}_edu_category AS edu_category,
       {own}_famhx_dm AS famhx_dm, {own}_morbidity_category AS morbidity_category, {own}_bmi_category AS bmi_category,
       e.dm_incident, e.time_to_dm
FROM wave_t w LEFT JOIN model_event_t e ON e.carrs = w.carrs AND e.pid = w.{own}_pid WHERE w.fup = 0"""
                    for role, own, partner in (("Women", "female", "male"), ("Men", "male", "female")))
TEXT_SECOND = FIRST + _factor("morbidity_category", ("None", "Single morbidity")) + _factor(
    "bmi_category", ("Overweight", "Underweight or normal weight"))
WAVE_MODELS = [(role, name, terms, terms, known) for role in ("Women", "Men") for name, terms, known in (
    ("Age adjusted", AGE, []), ("Model 1", FIRST, FIRST_KNOWN), ("Model 2", TEXT_SECOND, SECOND_KNOWN))]

CLUSTER_FRAME = """
SELECT e.hhid, e.dm_incident, e.time_to_dm, b.sex, b.age, b.bmi AS bmi_baseline, b.edu_category, b.employ_category,
       b.hhincome, b.site, b.carrs, b.famhx_dm
FROM model_event_t e LEFT JOIN (SELECT * FROM model_annotated_t WHERE fup = 0) b
  ON e.carrs = b.carrs AND e.pid = b.pid AND e.hhid IS NOT DISTINCT FROM b.hhid
WHERE b.baseline_dm = 0 AND e.time_to_dm >= 0 AND e.dm_incident IS NOT NULL"""
CLUSTER_ALL = (_factor("sex", ("male",)) + _plain(["age", "bmi_baseline"]) + _factor("edu_category", (2, 3))
               + _factor("employ_category", (2, 3, 4, 5)) + _factor("hhincome", (2, 3, 4)) + _factor("site", (2, 3))
               + _factor("carrs", (2,)) + _factor("famhx_dm", (1,)))
# Body mass is missing for one employment code, and household income fixes the study.
CLUSTER_USED = [t for t in CLUSTER_ALL if t[0] not in ("employ_category5", "carrs2")]
_CLUSTER_TESTS = [
    ("sex", [1]), ("age", [2]), ("bmi_baseline", [3]), ("edu_category", [4, 5]), ("employ_category", [6, 7, 8]),
    ("hhincome", [9, 10, 11]), ("site", [12, 13]), ("famhx_dm", [14]), ("GLOBAL", list(range(1, 15)))]
NORMAL_975 = 1.959963984540054


def _model_tables() -> dict[str, str]:
    tables = {"wave_role_t": WAVE_ROLES, "cluster_frame_t": CLUSTER_FRAME}
    for prefix, models, family in (("logit", NESTED, "binomial"), ("pois", NESTED, "poisson"), ("crude", CRUDE, "poisson")):
        data, size = _glm_data(models)
        tables |= glm_tables(prefix, data, size, family) | {f"{prefix}_term_t": _term_list(models, 1)}
    for prefix, models, source, frame in (("cox", _cox_models(), "role_t", COX_FRAME),
                                          ("wavecox", WAVE_MODELS, "wave_role_t", WAVE_FRAME)):
        data, size = _cox_data(models, source, frame)
        tables |= cox_tables(prefix, data, size) | {f"{prefix}_term_t": _term_list(models, 0)}
    known = _known(c for c in ("age", "bmi_baseline", "sex", "edu_category", "employ_category", "hhincome", "site",
                               "carrs", "famhx_dm"))
    size = len(CLUSTER_USED)
    tables |= cox_tables("clus", f"SELECT 1 AS model, hhid AS id, time_to_dm AS t, dm_incident AS e, "
                         f"{padded([e for _, e in CLUSTER_USED], size)} AS x FROM cluster_frame_t WHERE true{known}", size)
    tables |= clustered_tables("clus", size)
    tables["clus_test_t"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c})" for n, c in _CLUSTER_TESTS) + ") v(name, cols)"
    places = {t: k + 1 for k, (t, _) in enumerate(CLUSTER_USED)}
    tables["clus_term_t"] = "SELECT * FROM (VALUES " + ", ".join(
        f"({k}, '{t}', {places.get(t, 'NULL')})" for k, (t, _) in enumerate(CLUSTER_ALL)) + ") v(position, term, place)"
    tables["clus_hr_t"] = """
SELECT position, term, CASE WHEN NOT f.lost[t.place] THEN f.b[t.place] END AS b,
       CASE WHEN NOT f.lost[t.place] THEN sqrt(q.var) END AS se, f.converged FROM clus_term_t t, clus_end_t f
LEFT JOIN clus_robust_t q ON q.k = t.place"""
    return tables


_P = erfc("(b / se / sqrt(2))")
_HAZARDS = f"""CAST(position AS INT) AS position, term, {r('exp(b)', 'hazard_ratio')},
    {r(f'exp(b - {NORMAL_975} * se)', 'conf_low_95')}, {r(f'exp(b + {NORMAL_975} * se)', 'conf_high_95')}, {r(_P, 'p_value')}, converged"""
MODEL_STATEMENTS = {
    "logit_crude": f"""
SELECT 'dm_biomarker0_wife (1 vs 0)' AS term, {r('b', 'estimate_log_odds')}, {r('exp(b)', 'odds_ratio')},
       {r('exp(b - 1.96 * se)', 'conf_low_95')}, {r('exp(b + 1.96 * se)', 'conf_high_95')}, {r(_P, 'p_value')}, least(n00, n01, n10, n11) > 0 AS converged
FROM (SELECT *, CASE WHEN least(n00, n01, n10, n11) > 0 THEN ln(n00 * n11 / (n01 * n10)) END AS b,
             CASE WHEN least(n00, n01, n10, n11) > 0 THEN sqrt(1 / n00 + 1 / n01 + 1 / n10 + 1 / n11) END AS se FROM (
  SELECT CAST(count(*) FILTER (dm_biomarker0_wife = 0 AND dm_biomarker0_husb = 0) AS DOUBLE) AS n00,
         CAST(count(*) FILTER (dm_biomarker0_wife = 0 AND dm_biomarker0_husb = 1) AS DOUBLE) AS n01,
         CAST(count(*) FILTER (dm_biomarker0_wife = 1 AND dm_biomarker0_husb = 0) AS DOUBLE) AS n10,
         CAST(count(*) FILTER (dm_biomarker0_wife = 1 AND dm_biomarker0_husb = 1) AS DOUBLE) AS n11 FROM dyad_t) c) e""",
    "logit_adjusted": _model_terms("logit", 1.96, GLM_FRAME, "role_t"),
    "logit_estimates": "SELECT sex, model, ratio, conf_low AS low, conf_high AS high, n_frame, n_model, converged FROM ("
                       + _model_terms("logit", 1.96, GLM_FRAME, "role_t") + ") m WHERE position = 0",
    "logit_report": _ratios("logit", "OR", ("Age adjusted", "Model 1", "Model 2"), GLM_FRAME),
    "poisson_rr_crude": f"""
SELECT sex, 'Crude' AS model, 0 AS position, 'partner_dm_statusDiabetes' AS term, {r('b', 'estimate')}, {r('se', 'std_error')},
       {r('exp(b)', 'ratio')}, {r('exp(b - 1.96 * se)', 'conf_low')}, {r('exp(b + 1.96 * se)', 'conf_high')}, {r(_P, 'p_value')},
       n AS n_frame, n AS n_model, CAST(e AS BIGINT) AS events, found AS converged
FROM (SELECT role AS sex, count(*) AS n, sum(dm_incident) AS e, least(sum(dm_incident) FILTER (partner_baseline_dm = 1),
                   sum(dm_incident) FILTER (partner_baseline_dm = 0)) > 0 AS found,
             CASE WHEN found THEN ln(avg(dm_incident) FILTER (partner_baseline_dm = 1)
                                     / avg(dm_incident) FILTER (partner_baseline_dm = 0)) END AS b,
             CASE WHEN found THEN sqrt((1 - avg(dm_incident) FILTER (partner_baseline_dm = 1)) / sum(dm_incident) FILTER (partner_baseline_dm = 1)
                + (1 - avg(dm_incident) FILTER (partner_baseline_dm = 0)) / sum(dm_incident) FILTER (partner_baseline_dm = 0)) END AS se
      FROM role_t WHERE {GLM_FRAME} GROUP BY role) c""",
    "poisson_rr_adjusted": _model_terms("pois", 1.96, GLM_FRAME, "role_t", robust=True),
    "poisson_report": _ratios("pois", "RR", ("Age adjusted", "Model 1", "Model 2"), GLM_FRAME, robust=True),
    "cox_adjusted": _model_terms("cox", NORMAL_975, COX_FRAME, "role_t"),
    "cox_spouse": """
SELECT CAST(CASE sex WHEN 'Women' THEN 0 ELSE 4 END + CASE WHEN model LIKE '%age' THEN 1 WHEN model LIKE '%Model 1' THEN 2
            WHEN model LIKE '%Model 2' THEN 3 ELSE 0 END AS INT) AS position, model, n_frame AS n, n_model, events,
       ratio AS hr_spouse, conf_low AS hr_lcl, conf_high AS hr_ucl, p_value, converged
FROM (""" + _model_terms("cox", NORMAL_975, COX_FRAME, "role_t") + ") m WHERE term = 'partner_baseline_dm'",
    "cox_factor": _model_terms("wavecox", NORMAL_975, WAVE_FRAME, "wave_role_t"),
    "cox_report": _ratios("wavecox", "HR", ("Age adjusted", "Model 1", "Model 2"), WAVE_FRAME, source="wave_role_t",
                          place=1, z=NORMAL_975,
                          total="(SELECT count(*) FROM wave_role_t w WHERE w.role = s.role AND w.baseline_dm = 0)"),
    "cox_cluster": f"SELECT {_HAZARDS} FROM clus_hr_t",
    "hr_table": f"SELECT {_HAZARDS} FROM (SELECT *, row_number() OVER (ORDER BY b NULLS LAST) AS place FROM clus_hr_t) h WHERE place > 2",
    "ph_test": f"SELECT name AS term, {r('chisq')}, CAST(df AS INT) AS df, {r(chi_square_tail('chisq', 'df', 14), 'p_value')} FROM clus_zph_t",
}
MODEL_TABLES = _model_tables()
ORACLES |= {name: compose(statement, MODEL_TABLES) for name, statement in MODEL_STATEMENTS.items()}
