"""Common table expressions: the cohort and every stage built on it.

Names end in ``_t`` so that they never collide with a column name.
"""

PERSON = """
SELECT c_custkey AS pid,
       c_custkey // 2 + CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE 0 END AS hhid,
       CAST(1 + (c_custkey // 2) % 2 AS INT) AS carrs,
       CAST(1 + (c_custkey // 2) % 3 AS INT) AS site,
       CAST(CASE WHEN (c_custkey % 2 = 0) <> (c_custkey % 23 = 0) THEN 1 ELSE 2 END AS INT) AS sex,
       DATE '2010-10-01' + CAST(c_custkey % 600 AS INT) AS doi,
       CAST(25 + ((c_custkey // 2) * 7) % 40 + (c_custkey % 2) * (c_custkey % 25) AS DOUBLE) AS age,
       CAST(1 + c_custkey % 7 AS INT) AS educstat,
       CAST(CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 1 + (c_custkey * 3) % 5 END AS INT) AS employ,
       CAST(1 + c_custkey % 5 AS INT) AS occ,
       CAST(150 + c_custkey % 35 AS DOUBLE) AS height_cm,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 45 + (c_acctbal + 1000) / 11000 * 50 END AS weight_kg,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 18 + (c_acctbal + 1000) / 11000 * 20 END AS bmi,
       CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE 70 + (c_acctbal + 1000) / 11000 * 40 END AS waist_cm,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS smk_overall,
       CAST(c_custkey % 3 AS INT) AS alc_overall,
       CAST(CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS INT) AS famhx_dm,
       CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS INT) AS famhx_htn,
       CAST(CASE WHEN c_mktsegment = 'FURNITURE' AND c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS famhx_cvd,
       CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_nationkey < 4 THEN 1 ELSE 0 END AS INT) AS htn,
       CAST(CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_nationkey = 5 THEN 1 ELSE 0 END AS INT) AS dm,
       CAST(CASE WHEN c_nationkey = 6 THEN 1 ELSE 0 END AS INT) AS chd,
       CAST(CASE WHEN c_nationkey = 7 THEN 1 ELSE 0 END AS INT) AS cva,
       CAST(CASE WHEN c_nationkey = 8 THEN 1 ELSE 0 END AS INT) AS ckd,
       CAST(CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE 1 END AS INT) AS spousedyad_new
FROM customer"""

VISIT = """
SELECT o_custkey AS pid, p.carrs, p.hhid, CAST(seq AS INT) AS fup,
       CAST(CASE WHEN p.carrs = 1 AND seq IN (0, 2, 4, 7)
                 THEN CASE seq WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END
                 WHEN p.carrs = 2 AND seq IN (0, 2) THEN CASE seq WHEN 0 THEN 0 ELSE 1 END END AS INT) AS visit,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS doi,
       CASE WHEN o_orderkey % 9 = 0 THEN 'refused' END AS reason,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 70 + o_totalprice / 500000 * 65 END AS fpg,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 4.5E0 + ((o_orderkey * 37) % 1000) / 1000.0E0 * 2.1E0 END AS hba1c,
       CAST(CASE WHEN o_orderkey % 6 = 0 THEN NULL
                 WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS dm,
       CAST(CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS INT) AS dm_allo
FROM (SELECT o_custkey, seq, min(o_orderkey) AS o_orderkey, min(o_orderdate) AS o_orderdate,
             max(o_totalprice) AS o_totalprice, min(o_orderpriority) AS o_orderpriority
      FROM (SELECT *, (CAST(o_orderdate AS DATE) - DATE '1995-01-01')
                      // CASE (o_custkey // 2) % 2 WHEN 0 THEN 301 ELSE 802 END AS seq FROM orders) o
      GROUP BY o_custkey, seq) s
JOIN person_t p ON p.pid = s.o_custkey"""

EXTRA = """
SELECT v.*, p.spousedyad_new,
       CASE WHEN p.sex = 1 THEN 'male' ELSE 'female' END AS sex, p.age, p.bmi,
       CASE WHEN (v.pid + v.fup) % 11 = 0 THEN NULL ELSE CAST(100 + (v.pid * 7 + v.fup * 5) % 60 AS DOUBLE) END AS sbp2,
       CASE WHEN (v.pid + v.fup) % 12 = 0 THEN NULL ELSE CAST(98 + (v.pid * 3 + v.fup * 5) % 60 AS DOUBLE) END AS sbp3,
       CASE WHEN (v.pid + v.fup) % 11 = 0 THEN NULL ELSE CAST(60 + (v.pid * 7 + v.fup * 5) % 40 AS DOUBLE) END AS dbp2,
       CASE WHEN (v.pid + v.fup) % 12 = 0 THEN NULL ELSE CAST(58 + (v.pid * 3 + v.fup * 5) % 40 AS DOUBLE) END AS dbp3,
       p.htn, CAST(CASE WHEN v.pid % 14 = 0 THEN 1 WHEN v.pid % 3 = 0 THEN NULL ELSE 0 END AS INT) AS htn_med,
       CAST(CASE WHEN v.pid % 4 = 0 THEN NULL ELSE 0 END AS INT) AS htn_allo,
       CASE WHEN v.pid % 9 = 0 THEN NULL ELSE CAST(80 + (v.pid * 11 + v.fup) % 140 AS DOUBLE) END AS tg,
       p.chd, CAST(CASE WHEN v.pid % 6 = 0 THEN NULL WHEN v.pid % 25 = 0 THEN 1 ELSE 0 END AS INT) AS chd_allo,
       p.cva, p.ckd, p.famhx_cvd, p.famhx_htn, p.famhx_dm,
       CAST(CASE WHEN v.fup = 0 THEN NULL ELSE v.pid % 2 END AS INT) AS alc_curr,
       CAST(CASE WHEN v.fup > 0 OR v.pid % 5 = 0 THEN NULL ELSE v.pid % 5 END AS INT) AS alc_often,
       CAST(CASE WHEN v.fup > 0 THEN NULL ELSE v.pid % 3 END AS INT) AS alc_overall,
       CAST(CASE WHEN v.pid % 8 = 0 THEN NULL WHEN v.fup > 0 THEN v.pid % 2 END AS INT) AS smk_curr,
       CAST(CASE WHEN v.fup = 0 THEN v.pid % 2 END AS INT) AS smk_ever,
       CAST(CASE WHEN v.fup = 0 THEN v.pid % 3 END AS INT) AS smk_overall,
       CAST(CASE WHEN v.pid % 10 = 0 THEN 1 + v.pid % 4 END AS INT) AS smk_smoke_freq,
       CAST(CASE WHEN v.pid % 21 = 0 THEN 2 END AS INT) AS smk_chew_freq,
       CAST(CASE WHEN p.educstat >= 5 THEN 1 WHEN p.educstat >= 3 THEN 2 ELSE 3 END AS INT) AS edu_category,
       p.employ AS employ_category, CAST(1 + v.hhid % 4 AS INT) AS hhincome, p.site,
       CAST(CASE WHEN v.pid % 53 = 0 THEN NULL ELSE v.pid % 2 END AS INT) AS hld, CAST(1 + v.pid % 4 AS INT) AS religion,
       CAST(CASE WHEN v.pid % 47 = 0 THEN NULL ELSE 1 + v.pid % 3 END AS INT) AS caste
FROM visit_t v JOIN person_t p ON p.pid = v.pid"""

OUTCOMES = """
SELECT *,
       CASE WHEN visitcomplete = 0 OR (fpg IS NULL AND hba1c IS NULL) THEN NULL
            WHEN fpg >= 126 OR hba1c >= 6.5 OR dm = 1 OR dm_allo = 1 THEN 1 ELSE 0 END AS dm_biomarker,
       CASE WHEN visitcomplete = 0 OR fpg IS NULL OR hba1c IS NULL THEN NULL
            WHEN fpg >= 126 OR hba1c >= 6.5 OR dm = 1 OR dm_allo = 1 THEN 1 ELSE 0 END AS dm_biomarker_nomiss,
       CASE WHEN visitcomplete = 0 THEN NULL WHEN dm = 1 OR dm_allo = 1 THEN 1 ELSE 0 END AS dm_self,
       CASE WHEN visitcomplete = 1 THEN CAST(fpg IS NULL AS INT) + CAST(hba1c IS NULL AS INT) END AS missingbiomarkern
FROM (SELECT *, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS visitcomplete,
             CASE WHEN reason IS NULL THEN doi END AS visit_date
      FROM {source}) s"""

WIDE_VALUES = ("fpg", "hba1c", "dm", "dm_allo", "dm_biomarker", "dm_biomarker_nomiss", "dm_self", "visit_date",
               "visitcomplete", "missingbiomarkern")
WIDE = "SELECT pid, " + ", ".join(
    f"any_value({v}) FILTER (visit = {i}) AS {v}{i}" for v in WIDE_VALUES for i in range(4)
) + " FROM outcome_t WHERE visit IS NOT NULL GROUP BY pid"

BASE = """
SELECT * EXCLUDE (spousedyad_new, site, sex, bmi), 0 AS fup,
       CASE WHEN site = 1 THEN 'Chennai' ELSE 'Delhi' END AS site,
       CASE WHEN sex = 1 THEN 'male' ELSE 'female' END AS sex,
       coalesce(bmi, weight_kg / ((height_cm / 100) ** 2)) AS bmi,
       CAST(year(doi) AS INT) AS year
FROM person_t WHERE site IN (1, 2)"""

ANALYTIC = """
SELECT b.*, f.spousedyad_new, w.* EXCLUDE (pid)
FROM base_t b LEFT JOIN wide_t w ON b.pid = w.pid
LEFT JOIN (SELECT pid, hhid, spousedyad_new FROM person_t) f ON b.pid = f.pid AND b.hhid IS NOT DISTINCT FROM f.hhid"""

ELIGIBLE = """
SELECT *, CASE WHEN nfollowup >= 1 THEN 1 ELSE 0 END AS onefollowup,
       CASE WHEN valid_dyad = 1 AND baseline_bio_one = 1 AND onefollowupbio = 1 THEN 1 ELSE 0 END AS biocohort,
       CASE WHEN valid_dyad = 1 AND dm_biomarker0 = 0 AND onefollowupbio = 1 THEN 1 ELSE 0 END AS valid_at_risk
FROM (
  SELECT *,
    CASE WHEN sum_spouse = 2 AND count_hh = 2 THEN 1 ELSE 0 END AS valid_dyad,
    CASE WHEN dm_biomarker_nomiss0 IN (0, 1) THEN 1 ELSE 0 END AS baseline_bio_all,
    CASE WHEN fpg0 IS NOT NULL OR hba1c0 IS NOT NULL THEN 1 ELSE 0 END AS baseline_bio_one,
    CASE WHEN dm IS NOT NULL THEN 1 ELSE 0 END AS baseline_self,
    coalesce(visitcomplete1, 0) + coalesce(visitcomplete2, 0) + coalesce(visitcomplete3, 0) AS nfollowup,
    CASE WHEN carrs = 1 AND visitcomplete1 + visitcomplete2 + visitcomplete3 = 3 THEN 1
         WHEN carrs = 2 AND visitcomplete1 = 1 THEN 1 ELSE 0 END AS completefollowup,
    CASE WHEN carrs = 1 AND coalesce(dm_biomarker1, dm_biomarker2, dm_biomarker3) IS NOT NULL THEN 1
         WHEN carrs = 2 AND dm_biomarker1 IS NOT NULL THEN 1 ELSE 0 END AS onefollowupbio,
    CASE WHEN carrs = 1 AND dm_biomarker1 + dm_biomarker2 + dm_biomarker3 IS NOT NULL THEN 1
         WHEN carrs = 2 AND dm_biomarker1 IS NOT NULL THEN 1 ELSE 0 END AS completefollowupbio
  FROM (SELECT *, CAST(coalesce(sum(spousedyad_new) OVER (PARTITION BY hhid), 0) AS BIGINT) AS sum_spouse,
               count(*) OVER (PARTITION BY hhid) AS count_hh FROM analytic_t) h) e"""

EVENT = """
SELECT *, CASE WHEN event_DMbiomarker = 1 THEN CASE firstvisit_DMbiomarker
                    WHEN 1 THEN visit_date1 WHEN 2 THEN visit_date2 ELSE visit_date3 END
               WHEN event_DMbiomarker = 0 THEN coalesce(visit_date3, visit_date2, visit_date1) END AS DateDMbiomarker
FROM (
  SELECT *, CASE WHEN dm_biomarker0 = 0 AND coalesce(dm_biomarker1, dm_biomarker2, dm_biomarker3) IS NOT NULL
                 THEN CASE WHEN firstvisit_DMbiomarker IS NULL THEN 0 ELSE 1 END END AS event_DMbiomarker
  FROM (SELECT *, CASE WHEN dm_biomarker0 = 0 THEN CASE WHEN dm_biomarker1 = 1 THEN 1 WHEN dm_biomarker2 = 1 THEN 2
                       WHEN dm_biomarker3 = 1 THEN 3 END END AS firstvisit_DMbiomarker
        FROM eligible_t) a) b"""

RECODED = """
SELECT *, CASE WHEN multimorbidity >= 2 THEN 2 ELSE multimorbidity END AS multimorbiditycat,
       CASE WHEN multimorbidity > 0 THEN 1 ELSE 0 END AS multimorbiditycat2
FROM (
  SELECT * REPLACE (coalesce(htn, 0) AS htn, coalesce(dm, 0) AS dm, coalesce(chd, 0) AS chd,
                    coalesce(cva, 0) AS cva, coalesce(ckd, 0) AS ckd),
    CASE WHEN educstat IN (5, 6, 7) THEN 1 WHEN educstat IN (3, 4) THEN 2 WHEN educstat IN (1, 2) THEN 3 END AS educcat,
    CASE WHEN educstat BETWEEN 3 AND 7 THEN 1 WHEN educstat IN (1, 2) THEN 2 END AS educcat2,
    CASE WHEN employ = 1 AND occ IN (3, 4, 5) THEN 4 WHEN employ = 1 AND occ IN (1, 2) THEN 5
         WHEN employ IN (2, 3) THEN 1 WHEN employ = 4 THEN 2 WHEN employ = 5 THEN 3 END AS employocccat,
    CASE WHEN bmi IS NULL THEN NULL WHEN bmi < 25 THEN 0 WHEN bmi < 30 THEN 1 ELSE 2 END AS bmicat,
    CASE WHEN bmi IS NULL THEN NULL WHEN bmi < 30 THEN 1 ELSE 2 END AS bmicat2,
    coalesce(htn, 0) + coalesce(dm, 0) + coalesce(chd, 0) + coalesce(cva, 0) + coalesce(ckd, 0) AS multimorbidity
  FROM event_t) r"""

MEMBER_COLUMNS = (
    "age", "bmi", "waist_cm", "educcat", "educcat2", "employocccat", "bmicat", "bmicat2",
    "alc_overall", "smk_overall", "famhx_htn", "famhx_dm", "famhx_cvd", "htn", "dm", "chd", "cva", "ckd",
    "multimorbiditycat", "dm_biomarker0", "event_DMbiomarker", "DateDMbiomarker", "time_to_dm", "biocohort")


def _half(sex: str) -> str:
    return f"""(SELECT * FROM cohort_t WHERE sex = '{sex}' AND hhid IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY hhid ORDER BY pid) = 1)"""


DYAD = "SELECT h.hhid, " + ", ".join(f"h.{c} AS {c}_husb, w.{c} AS {c}_wife" for c in MEMBER_COLUMNS) + f"""
FROM {_half('male')} h JOIN {_half('female')} w ON h.hhid = w.hhid"""

DYAD_RISK = """
SELECT *, CASE WHEN dm_biomarker0_husb = 1 AND dm_biomarker0_wife = 1 THEN NULL ELSE 1 END AS dyad_at_risk,
  CASE WHEN dm_biomarker0_wife = 1 THEN NULL
       WHEN age_wife IS NULL OR bmi_wife IS NULL OR educcat2_wife IS NULL OR famhx_dm_wife IS NULL
            OR multimorbiditycat_wife IS NULL THEN NULL ELSE 1 END AS female_at_risk,
  CASE WHEN dm_biomarker0_husb = 1 THEN NULL
       WHEN age_husb IS NULL OR bmi_husb IS NULL OR educcat2_husb IS NULL OR famhx_dm_husb IS NULL
            OR multimorbiditycat_husb IS NULL OR smk_overall_husb IS NULL OR alc_overall_husb IS NULL
       THEN NULL ELSE 1 END AS male_at_risk
FROM pair_t"""


def _view(role: str, own: str, partner: str, behaviours: bool) -> str:
    used = (lambda c: f"{c}_{own}") if behaviours else (lambda c: "CAST(NULL AS INT)")
    return f"""SELECT '{role}' AS role, hhid, dyad_at_risk, dm_biomarker0_{own} AS baseline_dm,
  dm_biomarker0_{partner} AS partner_baseline_dm, event_DMbiomarker_{own} AS dm_incident, age_{own} AS age,
  educcat_{own} AS edu_category, famhx_dm_{own} AS famhx_dm, multimorbiditycat_{own} AS morbidity_category,
  bmicat_{own} AS bmi_category, {used('alc_overall')} AS alc_overall, {used('smk_overall')} AS smk_overall,
  time_to_dm_{own} AS time_to_dm FROM dyad_t"""


ROLE = _view("Women", "wife", "husb", False) + "\nUNION ALL\n" + _view("Men", "husb", "wife", True)

RESPOND = """
SELECT *, CASE WHEN (carrs = 1 AND fup IN (1, 3, 5, 6)) OR (carrs = 2 AND fup = 1) THEN 0
               WHEN reason IS NULL THEN 1 ELSE 0 END AS respond
FROM extra_t"""

TRIMMED = """
SELECT * EXCLUDE (visit_order, last_order)
FROM (SELECT *, max(CASE WHEN respond = 1 THEN visit_order END) OVER (PARTITION BY carrs, pid) AS last_order
      FROM (SELECT *, row_number() OVER (PARTITION BY carrs, pid ORDER BY fup) AS visit_order FROM respond_t) a) b
WHERE visit_order <= last_order"""

GATED = """
SELECT *,
  CASE WHEN fpg IS NULL AND hba1c IS NULL AND dm IS NULL AND dm_allo IS NULL THEN NULL
       WHEN (dm = 1 OR dm_allo = 1) AND fpg IS NULL AND hba1c IS NULL THEN 1 ELSE 0 END AS dm_self_report,
  CASE WHEN respond = 0 THEN NULL WHEN fpg IS NULL AND hba1c IS NULL AND dm IS NULL AND dm_allo IS NULL THEN NULL
       WHEN fpg >= 126 OR hba1c >= 6.5 OR dm = 1 OR dm_allo = 1 THEN 1 ELSE 0 END AS dm_biomarker
FROM {source} WHERE (carrs = 1 AND fup IN (0, 2, 4, 7)) OR (carrs = 2 AND fup IN (0, 2))"""

IMPUTED = """
SELECT * EXCLUDE (d, mid) REPLACE (CASE WHEN respond = 1 THEN
         DATE '1970-01-01' + CAST(floor(coalesce(d, mid)) AS INT) END AS doi),
       CASE WHEN respond = 1 THEN coalesce(d, mid) END AS doi_day
FROM (SELECT *, (min(d) FILTER (respond = 1) OVER (PARTITION BY carrs, fup)
               + max(d) FILTER (respond = 1) OVER (PARTITION BY carrs, fup)) / 2.0 AS mid
      FROM (SELECT *, CAST(doi - DATE '1970-01-01' AS DOUBLE) AS d FROM main_t) a) b"""

LINKED = """
SELECT *, CASE WHEN doi_day IS NOT NULL AND prior_day IS NOT NULL THEN prior_day + (doi_day - prior_day) / 2.0 END
         AS midpoint_day
FROM (
  SELECT *, lag(doi_last) OVER (PARTITION BY carrs, pid ORDER BY fup) AS prior_day
  FROM (SELECT *,
          first_value(doi_day IGNORE NULLS) OVER (PARTITION BY carrs, pid ORDER BY fup
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS baseline_day,
          last_value(doi_day IGNORE NULLS) OVER (PARTITION BY carrs, pid ORDER BY fup
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS doi_last
        FROM imputed_t) a) b"""

COMPLETE_CASE_COLUMNS = (
    "dm", "fpg", "hba1c", "age", "sex", "hld", "religion", "caste", "edu_category", "employ_category", "hhincome", "bmi",
    "famhx_dm", "htn", "chd", "smk_overall", "alc_overall")
MODEL_CASE_COLUMNS = ("age", "sex", "edu_category", "famhx_dm")


def complete_cases(source: str, columns) -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""SELECT * FROM {source} WHERE pid IN (SELECT pid FROM {source} WHERE fup = 0 AND {known})"""


MIXED = """
SELECT * FROM {source} WHERE hhid IN (
  SELECT hhid FROM (SELECT DISTINCT hhid, pid, sex FROM {source}) m GROUP BY hhid
  HAVING count(*) = 2 AND sum(CASE WHEN sex = 'male' THEN 1 ELSE 0 END) = 1
     AND sum(CASE WHEN sex = 'female' THEN 1 ELSE 0 END) = 1)"""

CLOSE = """
SELECT * FROM {source} WHERE hhid IN (
  SELECT hhid FROM (SELECT DISTINCT hhid, pid, age FROM {source} WHERE fup = 0) m GROUP BY hhid
  HAVING count(*) = 2 AND count(age) = 2 AND max(age) - min(age) <= 18)"""

RECODE_VISITS = """
SELECT *,
  CASE morbidity_number WHEN 0 THEN 'None' WHEN 1 THEN 'Single morbidity' ELSE 'Multimorbidity' END AS morbidity_category
FROM (SELECT *,
  CAST((CASE WHEN hypertension = 1 THEN 1 ELSE 0 END) + (CASE WHEN dm_biomarker = 1 THEN 1 ELSE 0 END)
     + (CASE WHEN chd = 1 THEN 1 ELSE 0 END) + (CASE WHEN cva = 1 THEN 1 ELSE 0 END)
     + (CASE WHEN ckd = 1 THEN 1 ELSE 0 END) AS INT) AS morbidity_number
FROM (SELECT * REPLACE (
    CASE WHEN chd_allo IS NULL THEN NULL WHEN chd_allo = 1 THEN 1 ELSE chd END AS chd,
    coalesce(famhx_cvd, 0) AS famhx_cvd, coalesce(famhx_htn, 0) AS famhx_htn, coalesce(famhx_dm, 0) AS famhx_dm,
    CASE WHEN alc_curr = 1 THEN 1 WHEN alc_curr = 0 THEN 3 WHEN alc_often IN (1, 2) OR alc_overall = 1 THEN 1
         WHEN alc_often IN (3, 4) OR alc_overall = 2 THEN 2 WHEN alc_often IS NULL OR alc_overall = 0 THEN 0
         ELSE alc_overall END AS alc_overall,
    CASE WHEN smk_curr = 1 OR smk_smoke_freq IN (1, 2) OR smk_chew_freq IN (1, 2) THEN 1
         WHEN smk_curr = 0 OR smk_ever = 0 OR smk_overall = 0 THEN 0
         WHEN smk_ever = 1 OR smk_overall = 2 THEN 2 ELSE smk_overall END AS smk_overall),
  CASE WHEN bmi IS NULL THEN NULL WHEN bmi >= 25 THEN 1 ELSE 0 END AS overweight,
  CASE WHEN sbp IS NULL AND dbp IS NULL AND htn IS NULL AND htn_med IS NULL AND htn_allo IS NULL THEN NULL
       WHEN sbp > 140 OR dbp > 90 OR htn = 1 OR htn_med = 1 OR htn_allo = 1 THEN 1 ELSE 0 END AS hypertension,
  CASE WHEN tg IS NULL THEN NULL WHEN tg > 150 THEN 1 ELSE 0 END AS high_tg,
  CASE WHEN bmi >= 15 AND bmi < 25 THEN 'Underweight or normal weight' WHEN bmi >= 25 AND bmi < 30 THEN 'Overweight'
       WHEN bmi >= 30 THEN 'Obese' END AS bmi_category
FROM (SELECT *,
        CASE WHEN sbp2 IS NULL THEN sbp3 WHEN sbp3 IS NULL THEN sbp2 ELSE (sbp2 + sbp3) / 2 END AS sbp,
        CASE WHEN dbp2 IS NULL THEN dbp3 WHEN dbp3 IS NULL THEN dbp2 ELSE (dbp2 + dbp3) / 2 END AS dbp
      FROM {source}) a) b) c"""

EVENT_ROWS = """
SELECT carrs, pid, fup, hhid, 1 AS dm_incident, midpoint_day AS dm_incident_day, midpoint_day - baseline_day AS time_to_dm
FROM {source} WHERE pid IN (SELECT pid FROM {source} WHERE fup = 0 AND dm_biomarker = 0) AND dm_biomarker = 1
QUALIFY row_number() OVER (PARTITION BY carrs, pid ORDER BY fup, doi_day NULLS LAST) = 1
UNION ALL
SELECT carrs, pid, fup, hhid, 0, doi_day, doi_day - baseline_day
FROM (SELECT *, coalesce(max(dm_biomarker) OVER (PARTITION BY carrs, pid), 0) AS ever FROM {source}) n
WHERE ever = 0 AND pid IN (SELECT pid FROM {source} WHERE fup = 0 AND dm_biomarker = 0)
QUALIFY row_number() OVER (PARTITION BY carrs, pid ORDER BY fup DESC, doi_day DESC NULLS FIRST) = 1"""

ANNOTATED = """
SELECT r.*, e.dm_incident, e.dm_incident_day, e.time_to_dm,
       CASE WHEN r.pid IN (SELECT pid FROM {source} WHERE fup = 0 AND dm_biomarker <> 0) THEN 1 ELSE 0 END AS baseline_dm
FROM {source} r LEFT JOIN {events} e ON r.carrs = e.carrs AND r.fup = e.fup AND r.pid = e.pid
  AND r.hhid IS NOT DISTINCT FROM e.hhid"""


def members_wide(source: str, values, keys=("hhid", "carrs", "fup")) -> str:
    on = " AND ".join(f"f.{k} = m.{k}" for k in keys)

    def half(sex):
        return f"""(SELECT * FROM {source} WHERE sex = '{sex}'
          QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY pid) = 1)"""

    columns = ", ".join(f"f.{v} AS female_{v}, m.{v} AS male_{v}" for v in values)
    return f"SELECT {', '.join('f.' + k for k in keys)}, {columns} FROM {half('female')} f JOIN {half('male')} m ON {on}"


WAVE_VALUES = ("pid", "age", "edu_category", "famhx_dm", "morbidity_category", "bmi_category", "baseline_dm",
               "dm_biomarker", "dm_incident", "time_to_dm")

TABLES = {
    "person_t": PERSON, "visit_t": VISIT, "extra_t": EXTRA,
    "outcome_t": OUTCOMES.format(source="visit_t"), "extra_outcome_t": OUTCOMES.format(source="extra_t"),
    "wide_t": WIDE, "base_t": BASE, "analytic_t": ANALYTIC, "eligible_t": ELIGIBLE, "event_t": EVENT,
    "recoded_t": RECODED,
    "cohort_t": "SELECT *, CAST(DateDMbiomarker - visit_date0 AS DOUBLE) / 365.2 AS time_to_dm "
                "FROM recoded_t WHERE biocohort = 1",
    "pair_t": DYAD, "dyad_t": DYAD_RISK, "role_t": ROLE,
    "respond_t": RESPOND, "trimmed_t": TRIMMED,
    "gated_all_t": GATED.format(source="respond_t"), "main_t": GATED.format(source="trimmed_t"),
    "imputed_t": IMPUTED, "linked_t": LINKED,
    "spouse_t": "SELECT * FROM linked_t WHERE spousedyad_new = 1",
    "case_t": complete_cases("spouse_t", COMPLETE_CASE_COLUMNS),
    "mixed_t": MIXED.format(source="case_t"), "close_t": CLOSE.format(source="mixed_t"),
    "long_t": RECODE_VISITS.format(source="close_t"),
    "chain_event_t": EVENT_ROWS.format(source="long_t"),
    "chain_t": ANNOTATED.format(source="long_t", events="chain_event_t"),
    "outcome_recoded_t": RECODE_VISITS.format(source="extra_outcome_t"),
    "linked_recoded_t": RECODE_VISITS.format(source="linked_t"),
    "long_event_t": EVENT_ROWS.format(source="linked_recoded_t"),
    "long_annotated_t": ANNOTATED.format(source="linked_recoded_t", events="long_event_t"),
    # The modelled couples need only the covariates of the models.
    "model_case_t": complete_cases("spouse_t", MODEL_CASE_COLUMNS),
    "model_mixed_t": MIXED.format(source="model_case_t"), "model_close_t": CLOSE.format(source="model_mixed_t"),
    "model_long_t": RECODE_VISITS.format(source="model_close_t"),
    "model_event_t": EVENT_ROWS.format(source="model_long_t"),
    "model_annotated_t": ANNOTATED.format(source="model_long_t", events="model_event_t"),
    "wave_t": members_wide("model_annotated_t", WAVE_VALUES),
}
