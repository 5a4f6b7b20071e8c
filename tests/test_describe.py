import math

import pytest
from pyspark.sql import functions as F

from pairwave.functions.distributions import chi_square_tail, normal_two_sided, t_critical, t_critical_value
from pairwave.functions.exact import exact_odds_ratio
from pairwave.operators import describe
from pairwave.plans import reports

# Published counts of wives and husbands by baseline status (wife, husband).
COUNTS = {(0, 0): 2356, (1, 0): 532, (0, 1): 727, (1, 1): 412}


@pytest.fixture(scope="module")
def couples(spark):
    cells = spark.createDataFrame([(w, h, n) for (w, h), n in COUNTS.items()], "w int, h int, n int")
    return cells.select(F.col("w").alias("dm_biomarker0_wife"), F.col("h").alias("dm_biomarker0_husb"),
                        F.explode(F.sequence(F.lit(1), "n")).alias("k")).repartition(7)


def test_concordance_matches_the_published_cells(couples):
    cells = {(r["Women_Status"], r["Men_Status"]): r for r in describe.concordance_cells(couples).collect()}
    first = cells["No diabetes", "No diabetes"]
    assert first["Count"] == 2356 and first["cell_text"] == "2356 (58.5%)\n(76.4%)\n(81.6%)"
    assert math.isclose(first["overall_pct"], 58.5050906381922, rel_tol=1e-12)
    both = cells["Diabetes", "Diabetes"]
    assert math.isclose(both["row_pct"], 43.6440677966102) and math.isclose(both["col_pct"], 36.1720807726076)
    assert cells["Diabetes", "No diabetes"]["cell_text"] == "532 (13.2%)\n(56.4%)\n(18.4%)"
    grid = describe.concordance_display(describe.concordance_cells(couples)).collect()
    assert {r["Women_Status"]: r["Diabetes"] for r in grid}["Diabetes"] == "412 (10.2%)\n(43.6%)\n(36.2%)"


def test_empty_cells_stay_in_the_grid(couples):
    cells = describe.concordance_cells(couples.where("dm_biomarker0_wife = 0"))
    got = {(r["Women_Status"], r["Men_Status"]): r["Count"] for r in cells.collect()}
    assert got["Diabetes", "Diabetes"] == 0 and len(got) == 4
    assert cells.where("Women_Status = 'Diabetes'").first()["row_pct"] is None


def test_exact_test_matches_the_published_values(couples):
    got = describe.fisher_by_variable(couples, variables=("dm_biomarker0",)).first()
    assert (got["n00"], got["n01"], got["n10"], got["n11"]) == (2356, 532, 727, 412)
    assert [round(got[c], 2) for c in ("odds_ratio", "conf_low", "conf_high")] == [2.51, 2.15, 2.93]
    # No concordant pair: the published upper limits differ by root-finder tolerance.
    for one, other, published in ((17, 26, 39.54), (13, 9, 174.34)):
        estimate, low, high, _ = exact_odds_ratio(4027 - one - other, one, other, 0)
        assert (estimate, low) == (0.0, 0.0) and abs(high / published - 1) < 0.005


def test_exact_test_small_and_huge_tables():
    estimate, low, high, p = exact_odds_ratio(3, 1, 1, 3)
    assert math.isclose(p, 34 / 70, rel_tol=1e-9)
    # The estimate solves (16 t + 2*36 t^2 + 3*16 t^3 + 4 t^4) / (1 + 16 t + 36 t^2 + 16 t^3 + t^4) = 3.
    mass = [math.comb(4, k) ** 2 * estimate**k for k in range(5)]
    assert math.isclose(sum(k * m for k, m in enumerate(mass)) / sum(mass), 3.0, rel_tol=1e-9)
    for odds, kept in ((low, (3, 4)), (high, (0, 1, 2, 3))):
        mass = [math.comb(4, k) ** 2 * odds**k for k in range(5)]
        assert math.isclose(sum(mass[k] for k in kept) / sum(mass), 0.025, rel_tol=1e-9)
    estimate, low, high, p = exact_odds_ratio(10**9, 10**9, 10**9, 10**9)
    assert math.isclose(estimate, 1.0, rel_tol=1e-8) and low < 1 < high and p > 0.999


def test_exact_test_needs_two_levels_on_both_sides(spark):
    rows = [(0, 0), (1, 1), (2, 0), (2, 1), (0, None)]
    frame = spark.createDataFrame([(a, b, 1, b) for a, b in rows], "x_husb int, x_wife int, y_husb int, y_wife int")
    got = {r["variable"]: r for r in describe.fisher_by_variable(frame, variables=("x", "y")).collect()}
    assert got["x"]["odds_ratio"] is None and got["y"]["odds_ratio"] is None and got["y"]["n00"] is None


def test_risk_percentages_and_labels(spark):
    # Published percentages among women: 21.5 of 2356 and 24.6 of 727.
    cells = [(0, 1, 507), (0, 0, 2356 - 507), (1, 1, 179), (1, 0, 727 - 179)]
    roles = spark.createDataFrame(cells, "partner_baseline_dm int, dm_incident int, n int").select(
        F.lit("Women").alias("role"), F.lit(0).alias("baseline_dm"), "partner_baseline_dm", "dm_incident",
        F.explode(F.sequence(F.lit(1), "n")))
    got = describe.risk_report(describe.risk_by_partner(roles)).orderBy("position").collect()
    assert [tuple(r)[:4] for r in got] == [
        ("Women without diabetes at baseline (n=3083)", "No diabetes (n=2356)", "78.5", "21.5"),
        ("Women without diabetes at baseline (n=3083)", "Diabetes (n=727)", "75.4", "24.6")]
    none = describe.risk_by_partner(roles.where("dm_incident = 0"))
    assert none.where("diabetes_pct is not null").isEmpty()
    assert {r[3] for r in describe.risk_report(none).collect()} == {"NA"}


def test_mean_and_ratio_tables(spark):
    rows = [("a", 1.0, 2.0), ("a", 0.0, 3.0), ("a", None, 4.0), ("a", 1.0, None), ("b", 1.0, 1.0), (None, None, 1.0)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    means = {r["g"]: r for r in describe.mean_table(frame, "x", ["g"]).collect()}
    a = means["a"]
    error = math.sqrt(1 / 3) / math.sqrt(3)
    assert (a["N"], a["NMiss"], a["Sum"]) == (4, 1, 2.0)
    assert math.isclose(a["StdErrMean"], error) and math.isclose(a["StdErrSum"], 3 * error)
    assert math.isclose(a["UpperCLMean"], 2 / 3 + 4.302652729911275 * error)
    assert means["b"]["StdErrMean"] is None and means["b"]["Mean"] == 1.0 and means[None]["Sum"] is None
    ratios = {r["g"]: r for r in describe.ratio_table(frame, "x", "y", ["g"]).collect()}
    a = ratios["a"]
    z = [1 - 0.2 * 2, 0 - 0.2 * 3]
    variance = sum(v * v for v in z) - sum(z) ** 2 / 2
    assert a["N"] == 4 and math.isclose(a["Ratio"], 0.2)
    assert math.isclose(a["StdErr"], math.sqrt(variance / (2 * 2.5**2)))
    assert ratios["b"]["Ratio"] is None and ratios[None]["N"] == 1


def test_chi_square_correction_only_for_two_by_two(spark):
    rows = [(1, 1)] * 10 + [(1, 2)] * 20 + [(2, 1)] * 5 + [(2, 2)] * 5 + [(None, 1)] * 3
    frame = spark.createDataFrame([(w, h, w if w != 2 else 3, h) for w, h in rows],
                                  "a_wife int, a_husb int, b_wife int, b_husb int")
    got = {r["variable"]: r for r in describe.chi_square(frame, variables=("a", "b")).collect()}
    w, h = [30, 10], [18, 25]
    n = sum(w) + sum(h)
    expected = sum((abs(o - (w[k] + h[k]) * sum(side) / n) - 0.5) ** 2 / ((w[k] + h[k]) * sum(side) / n)
                   for side in (w, h) for k, o in enumerate(side))
    assert got["a"]["df"] == 1 and math.isclose(got["a"]["statistic"], expected)
    assert got["b"]["df"] == 2 and got["b"]["p_value"] < 1e-4


def test_chi_square_of_one_level_and_of_an_empty_role(spark):
    frame = spark.createDataFrame([(1, 1, 1, None)] * 6 + [(1, None, 2, None)] * 2,
                                  "a_wife int, a_husb int, b_wife int, b_husb int")
    got = {r["variable"]: r for r in describe.chi_square(frame, variables=("a", "b")).collect()}
    assert got["a"]["df"] == 1 and math.isclose(got["a"]["statistic"], 2 * (8 - 7) ** 2 / 7)
    assert got["b"]["statistic"] is None and got["b"]["p_value"] is None


def test_level_shares_with_unknown_values(spark):
    frame = spark.createDataFrame([(1, 2), (1, 1), (None, 1), (3, None)], "e_wife int, e_husb int")
    got = {r["level"]: r for r in describe.level_shares(frame, variables=("e",)).collect()}
    assert set(got) == {1, 2, 3}
    assert math.isclose(got[1]["pct_female"], 200 / 3) and got[3]["pct_male"] == 0.0
    assert got[1]["missing_female"] == 25.0


def test_quantiles(spark):
    assert math.isclose(t_critical_value(1), 12.706204736174707, rel_tol=1e-12)
    assert math.isclose(t_critical_value(2), 4.302652729911275, rel_tol=1e-10)
    assert math.isclose(t_critical_value(1000), 1.9623390808264078, rel_tol=1e-12)
    assert abs(t_critical_value(999) - t_critical_value(1000)) < 3e-6
    assert math.isclose(chi_square_tail(7.814727903251179, 3), 0.05, rel_tol=1e-12)
    assert math.isclose(chi_square_tail(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-12)
    frame = spark.createDataFrame([(4,), (0,), (None,)], "df int")
    got = [r[0] for r in frame.select(t_critical(F.col("df"))).collect()]
    assert math.isclose(got[0], 2.7764451051977987) and got[1:] == [None, None]


def test_table_one_layout(spark, folder):
    from pairwave.plans import current
    from pairwave.sources import cohort
    dyads = current.dyads(cohort.visit(spark, folder), cohort.baseline(spark, folder), cohort.dyad_flags(spark, folder))
    rows = describe.table_one(dyads).orderBy("section", "position", "line").collect()
    assert [r["variable"] for r in rows[:3]] == ["age", "bmi", "waist_cm"]
    assert [r["variable"] for r in rows[3:13]] == list(describe.BINARY)
    levels = [r for r in rows[13:]]
    assert levels[0]["variable"] == "educcat" and levels[1]["variable"] == "" and levels[1]["compare"] == ""


def test_printed_ratio_table(spark):
    assert reports.ratio_text(1.0552, 0.8701, 1.2999) == "1.06 (0.87 - 1.30)"
    assert reports.ratio_text(None, None, None) == "NA"
