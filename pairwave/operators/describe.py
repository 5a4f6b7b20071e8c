"""Descriptive, contingency and incidence tables.

Each table is one aggregate over the dyads: the same summary over several
variables is computed as columns of one row, which is then stacked, so the
dyads are neither rescanned nor multiplied per variable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwave.functions.columns import first_match, fixed, percent
from pairwave.functions.distributions import chi_square_p, p_text, t_critical
from pairwave.functions.exact import exact_test

# Fixed variable lists of the descriptive table.
CONTINUOUS = ("age", "bmi", "waist_cm")
BINARY = ("smk_overall", "alc_overall", "famhx_htn", "famhx_dm", "famhx_cvd", "chd", "cva", "ckd",
          "dm_biomarker0", "htn")
CATEGORICAL = ("educcat", "employocccat", "multimorbiditycat", "bmicat")
ROLES = {"female": "wife", "male": "husb"}
STATUS = {0: "No diabetes", 1: "Diabetes"}


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# -- means and ratios -----------------------------------------------------

def _mean_aggregates(value: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("N"), F.count(value).alias("_known"), F.avg(value).alias("Mean"),
            F.sum(value).cast("double").alias("Sum"), F.stddev_samp(value).alias("_sd")]


def _mean_measures(limits: bool) -> list[Column]:
    known = F.col("_known").cast("double")
    error = F.when(F.col("_known") > 1, F.col("_sd") / F.sqrt(known))
    columns = [F.col("N"), (F.col("N") - F.col("_known")).alias("NMiss"), F.col("Mean"), F.col("Sum"),
               error.alias("StdErrMean"), (error * known).alias("StdErrSum")]
    if limits:
        margin = t_critical(F.col("_known") - 1) * error
        columns += [(F.col("Mean") - margin).alias("LowerCLMean"), (F.col("Mean") + margin).alias("UpperCLMean")]
    return columns


def _ratio_aggregates(numerator: str, denominator: str) -> list[Column]:
    both = F.col(numerator).isNotNull() & F.col(denominator).isNotNull()
    x = F.when(both, F.col(numerator)).cast("double")
    y = F.when(both, F.col(denominator)).cast("double")
    return [F.count(F.lit(1)).alias("N"), F.count(x).alias("_pairs"), F.avg(x).alias("_mean_x"),
            F.avg(y).alias("_mean_y"), F.var_samp(x).alias("_var_x"), F.var_samp(y).alias("_var_y"),
            F.covar_samp(x, y).alias("_cov")]


def _ratio_measures(limits: bool) -> list[Column]:
    """Ratio of means on complete pairs with its linearised standard error."""
    enough = F.col("_pairs") > 1
    ratio = F.when(enough, F.try_divide("_mean_x", "_mean_y"))
    spread = F.col("_var_x") - ratio * 2.0 * F.col("_cov") + ratio * ratio * F.col("_var_y")
    error = F.when(enough, F.sqrt(F.try_divide(
        F.greatest(spread, F.lit(0.0)), F.col("_pairs") * F.col("_mean_y") * F.col("_mean_y"))))
    columns = [ratio.alias("Ratio"), error.alias("StdErr")]
    if limits:
        margin = t_critical(F.col("_pairs") - 1) * error
        columns += [(ratio - margin).alias("LowerCL"), (ratio + margin).alias("UpperCL")]
    return columns


def mean_table(frame: DataFrame, value: str, groups, limits: bool = True) -> DataFrame:
    """Mean, sum, standard errors, t-limits and missing count per group."""
    return (frame.groupBy(*groups).agg(*_mean_aggregates(value))
            .select(*groups, F.lit(value).alias("variable"), *_mean_measures(limits)))


def ratio_table(frame: DataFrame, numerator: str, denominator: str, groups, limits: bool = True) -> DataFrame:
    """Ratio of means (a rate, with time below) and its t-limits per group."""
    return (frame.groupBy(*groups).agg(*_ratio_aggregates(numerator, denominator))
            .select(*groups, F.lit(numerator).alias("numerator"), F.lit(denominator).alias("denominator"), "N",
                    *_ratio_measures(limits)))


def join_events_and_rates(events: DataFrame, rates: DataFrame, groups) -> DataFrame:
    """Match the two tables on group, variable and N; a missing group matches itself."""
    rates = rates.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("numerator").alias("variable_"),
                         F.col("N").alias("N_"), *[c for c in rates.columns
                                                   if c not in (*groups, "numerator", "N")])
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    same += [F.col("variable") == F.col("variable_"), F.col("N") == F.col("N_")]
    return events.join(rates, same).drop("variable_", "N_", *[f"_{g}" for g in groups])


def incidence_report(roles: DataFrame, event: str = "dm_incident", time: str = "time_to_dm",
                     per: float = 100.0) -> DataFrame:
    """Risk and incidence per 100 person-years of baseline event-free members
    by role and partner status, with t-limits.

    Means and ratios share their group and row count, so both come from one
    aggregate instead of two that are joined.
    """
    ratio = _ratio_aggregates(event, time)[1:]
    counted = (roles.where(F.col("baseline_dm") == 0).groupBy("role", "partner_baseline_dm")
               .agg(*_mean_aggregates(event), *ratio))
    table = counted.select("role", "partner_baseline_dm", *_mean_measures(False), *_ratio_measures(True))
    return table.select(
        F.col("role").alias("population"), F.col("partner_baseline_dm").alias("spouse_diabetes"),
        F.col("N").alias("dm_num"), (F.col("Ratio") * per).alias("dm_incidence_100"),
        (F.col("UpperCL") * per).alias("dm_incidence_100_ucl"),
        (F.col("LowerCL") * per).alias("dm_incidence_100_lcl"),
        F.bround("Sum", 5).alias("dm_events"), F.col("Mean").alias("dm_risk"))


# -- one-row aggregates, stacked ------------------------------------------

def _stack(row: DataFrame, entries: list[dict[str, Column]]) -> DataFrame:
    """Turn one row of aggregates into one row per entry."""
    structs = [F.struct(*[c.alias(name) for name, c in entry.items()]) for entry in entries]
    return row.select(F.inline(F.array(*structs)))


def _missing_percent(column: str) -> Column:
    return F.avg(F.col(column).isNull().cast("double")) * 100.0


def continuous_summary(dyads: DataFrame, variables=CONTINUOUS, roles=None) -> DataFrame:
    """Mean, SD, missing share per role and the correlation between partners."""
    roles = ROLES if roles is None else roles
    aggregates, entries = [], []
    for position, v in enumerate(variables):
        entry = {"position": F.lit(position), "variable": F.lit(v)}
        for role, suffix in roles.items():
            c = f"{v}_{suffix}"
            for name, value in (("mean", F.avg(c)), ("sd", F.stddev_samp(c)), ("missing", _missing_percent(c))):
                aggregates.append(value.alias(f"{name}_{c}"))
                entry[f"{name}_{role}"] = F.col(f"{name}_{c}")
        first, second = (F.col(f"{v}_{s}") for s in roles.values())
        aggregates.append(F.corr(first.cast("double"), second.cast("double")).alias(f"corr_{v}"))
        entry["correlation"] = F.col(f"corr_{v}")
        entries.append(entry)
    return _stack(dyads.agg(*aggregates), entries)


def binary_summary(dyads: DataFrame, variables=BINARY, roles=None) -> DataFrame:
    """Count, denominator and percent of ones and missing share per role."""
    roles = ROLES if roles is None else roles
    aggregates, entries = [], []
    for position, v in enumerate(variables):
        entry = {"position": F.lit(position), "variable": F.lit(v)}
        for role, suffix in roles.items():
            c = f"{v}_{suffix}"
            aggregates += [_count(F.col(c) == 1).alias(f"n_{c}"), F.count(c).alias(f"known_{c}"),
                           _missing_percent(c).alias(f"missing_{c}")]
            entry[f"n_{role}"], entry[f"known_{role}"] = F.col(f"n_{c}"), F.col(f"known_{c}")
            entry[f"pct_{role}"] = percent(F.col(f"n_{c}"), F.col(f"known_{c}"))
            entry[f"missing_{role}"] = F.col(f"missing_{c}")
        entries.append(entry)
    return _stack(dyads.agg(*aggregates), entries)


# -- counts by level -------------------------------------------------------

def stack_members(dyads: DataFrame, variables, roles=None) -> DataFrame:
    """Both members' values in one column: (variable, role, level)."""
    roles = ROLES if roles is None else roles
    entries = [F.struct(F.lit(v).alias("variable"), F.lit(role).alias("role"),
                        F.col(f"{v}_{suffix}").cast("int").alias("level"))
               for v in variables for role, suffix in roles.items()]
    return dyads.select(F.inline(F.array(*entries)))


def level_counts(dyads: DataFrame, variables=CATEGORICAL, roles=None) -> DataFrame:
    """Members per level and role; the row with a null level counts the missing.

    The levels of a categorical variable are few, so its count table is too.
    """
    roles = ROLES if roles is None else roles
    return stack_members(dyads, variables, roles).groupBy("variable", "level").agg(
        *[_count(F.col("role") == role).alias(f"n_{role}") for role in roles])


def level_shares(dyads: DataFrame, variables=CATEGORICAL, roles=None) -> DataFrame:
    """Share of each level among the known values, and the missing share."""
    roles = ROLES if roles is None else roles
    whole = Window.partitionBy("variable")
    shares = {}
    for role in roles:
        n = F.col(f"n_{role}")
        known = F.sum(F.when(F.col("level").isNotNull(), n)).over(whole)
        unknown = F.coalesce(F.sum(F.when(F.col("level").isNull(), n)).over(whole), F.lit(0))
        shares[f"pct_{role}"] = percent(n, known)
        shares[f"missing_{role}"] = percent(unknown, known + unknown)
    return level_counts(dyads, variables, roles).withColumns(shares).where("level is not null")


def chi_square(dyads: DataFrame, variables=CATEGORICAL, roles=None) -> DataFrame:
    """Pearson chi-square of level by role; continuity-corrected for 2x2 tables.

    A variable with a single level is tested for equal counts in the roles,
    and one without known values in a role gives nulls, as in the published
    test.
    """
    roles = ROLES if roles is None else roles
    whole = Window.partitionBy("variable")
    counts = level_counts(dyads, variables, roles).where("level is not null").withColumns({
        "_row": sum((F.col(f"n_{r}") for r in roles), F.lit(0)),
        **{f"_col_{r}": F.sum(f"n_{r}").over(whole) for r in roles},
        "_levels": F.count(F.lit(1)).over(whole)})
    total = sum((F.col(f"_col_{r}") for r in roles), F.lit(0)).cast("double")
    single = F.col("_levels") == 1
    empty = ~single & F.least(*[F.col(f"_col_{r}") for r in roles]).eqNullSafe(F.lit(0))
    expected = {r: F.when(single, total / len(roles)).otherwise(
        F.try_divide(F.col("_row") * F.col(f"_col_{r}").cast("double"), total)) for r in roles}
    deviation = {r: F.abs(F.col(f"n_{r}") - expected[r]) for r in roles}
    correction = F.when((F.col("_levels") == 2) & (F.lit(len(roles)) == 2), F.lit(0.5)).otherwise(F.lit(0.0))
    # The correction never exceeds the smallest deviation, as in the published test.
    smallest = F.min(F.least(*deviation.values())).over(whole)
    corrected = counts.withColumns({
        "_part": sum((F.try_divide(F.pow(deviation[r] - F.least(correction, smallest), 2.0), expected[r])
                      for r in roles), F.lit(0.0)),
        "_empty": empty})
    return (corrected.groupBy("variable").agg(
        F.when(~F.max("_empty"), F.sum("_part")).alias("statistic"),
        (F.greatest(F.max("_levels") - 1, F.lit(1)) * (len(roles) - 1)).cast("int").alias("df"))
        .withColumn("p_value", chi_square_p(F.col("statistic"), F.col("df"))))


# -- two-way tables --------------------------------------------------------

def contingency(frame: DataFrame, row: str, column: str, groups=()) -> DataFrame:
    """Counts of the observed pairs of known values."""
    return frame.dropna(subset=[row, column]).groupBy(*groups, row, column).agg(F.count(F.lit(1)).alias("n"))


def contingency_grid(frame: DataFrame, row: str, column: str, row_levels: dict, column_levels: dict) -> DataFrame:
    """Counts over the full grid of given levels, empty cells included.

    Counting each cell conditionally gives the dense grid without joining
    level lists.
    """
    cells = [(i, j) for j in column_levels for i in row_levels]
    counted = frame.agg(*[
        _count((F.col(row) == i) & (F.col(column) == j)).alias(f"n_{k}") for k, (i, j) in enumerate(cells)])
    return _stack(counted, [
        {"position": F.lit(k), "row": F.lit(row_levels[i]), "column": F.lit(column_levels[j]), "Count": F.col(f"n_{k}")}
        for k, (i, j) in enumerate(cells)])


def table_percentages(grid: DataFrame, row: str = "row", column: str = "column", count: str = "Count") -> DataFrame:
    """Overall, row and column percentages of a (small) count table."""
    n = F.col(count)
    return grid.withColumns({
        "overall_pct": percent(n, F.sum(n).over(Window.partitionBy(F.lit(1)))),
        "row_pct": percent(n, F.sum(n).over(Window.partitionBy(row))),
        "col_pct": percent(n, F.sum(n).over(Window.partitionBy(column)))})


def concordance_cells(dyads: DataFrame, outcome: str = "dm_biomarker0", labels=None) -> DataFrame:
    """Wife-by-husband table of a status with percentages and cell text."""
    labels = STATUS if labels is None else labels
    grid = contingency_grid(dyads, f"{outcome}_wife", f"{outcome}_husb", labels, labels)
    cells = table_percentages(grid)
    text = F.concat(
        F.col("Count").cast("string"), F.lit(" ("), fixed(F.col("overall_pct"), 1), F.lit("%)\n("),
        fixed(F.col("row_pct"), 1), F.lit("%)\n("), fixed(F.col("col_pct"), 1), F.lit("%)"))
    return cells.select("position", F.col("row").alias("Women_Status"), F.col("column").alias("Men_Status"),
                        "Count", "overall_pct", "row_pct", "col_pct", text.alias("cell_text"))


def concordance_display(cells: DataFrame, labels=None) -> DataFrame:
    """The cell texts as a grid, one column per husband's status."""
    labels = STATUS if labels is None else labels
    return cells.groupBy("Women_Status").pivot("Men_Status", list(labels.values())).agg(F.first("cell_text"))


def fisher_by_variable(dyads: DataFrame, variables=BINARY, roles=None) -> DataFrame:
    """Exact odds ratio between partners for each variable.

    A variable without exactly two levels in both roles gives nulls.  The
    test runs on the four counts, one small row per variable.
    """
    roles = ROLES if roles is None else roles
    female, male = roles.values()
    pairs = dyads.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("position"), F.lit(v).alias("variable"),
                 F.col(f"{v}_{male}").cast("int").alias("m"), F.col(f"{v}_{female}").cast("int").alias("f"))
        for k, v in enumerate(variables)])))
    counts = contingency(pairs, "m", "f", groups=("position", "variable"))
    whole = Window.partitionBy("variable")
    counts = counts.withColumns({f"{side}_{e}": getattr(F, e)(side).over(whole)
                                 for side in ("m", "f") for e in ("min", "max")})

    def cell(m, f):
        return F.coalesce(F.sum(F.when((F.col("m") == F.col(f"m_{m}")) & (F.col("f") == F.col(f"f_{f}")),
                                       F.col("n"))), F.lit(0))

    # Two levels each: the extremes differ and nothing lies between them.
    inner = F.max(((F.col("m") > F.col("m_min")) & (F.col("m") < F.col("m_max")))
                  | ((F.col("f") > F.col("f_min")) & (F.col("f") < F.col("f_max"))))
    two = F.max((F.col("m_min") < F.col("m_max")) & (F.col("f_min") < F.col("f_max")))
    cells = counts.groupBy("position", "variable").agg(
        (two & ~inner).alias("_two"), cell("min", "min").alias("n00"), cell("min", "max").alias("n01"),
        cell("max", "min").alias("n10"), cell("max", "max").alias("n11"))
    usable = {c: F.when(F.col("_two"), F.col(c)) for c in ("n00", "n01", "n10", "n11")}
    return (cells.withColumns(usable)
            .withColumn("_t", exact_test(*[F.col(c) for c in ("n00", "n01", "n10", "n11")]))
            .select("position", "variable", "n00", "n01", "n10", "n11", "_t.*"))


# -- risk by partner status ------------------------------------------------

def status_label(column: str, labels=None) -> Column:
    return first_match(*((F.col(column) == code, label) for code, label in (STATUS if labels is None else labels).items()))


def risk_by_partner(roles: DataFrame) -> DataFrame:
    """Outcome shares of baseline event-free members by partner status.

    The outcome columns are counted side by side.  An outcome that never
    occurs has no count and hence no percentage.
    """
    at_risk = roles.where(F.col("baseline_dm") == 0).dropna(subset=["partner_baseline_dm", "dm_incident"])
    counted = at_risk.groupBy("role", "partner_baseline_dm").agg(
        F.count(F.lit(1)).alias("partner_n"),
        *[_count(F.col("dm_incident") == code).alias(f"_n{code}") for code in STATUS])
    total = F.sum("partner_n").over(Window.partitionBy("role"))

    def share(code):
        n = F.col(f"_n{code}")
        return percent(F.when(n > 0, n), F.col("partner_n"))

    return counted.select(
        "role", "partner_baseline_dm",
        F.concat(F.col("role"), F.lit(" without diabetes at baseline (n="), total.cast("string"), F.lit(")"))
        .alias("baseline_group"),
        F.concat(status_label("partner_baseline_dm"), F.lit(" (n="), F.col("partner_n").cast("string"), F.lit(")"))
        .alias("partner_group"),
        total.alias("role_n"), "partner_n",
        share(0).alias("no_diabetes_pct"), share(1).alias("diabetes_pct"))


def risk_report(risk: DataFrame) -> DataFrame:
    """The published layout: percentages as text, partner without the condition first."""
    return risk.select(
        F.col("baseline_group").alias("Individual's status at baseline"),
        F.col("partner_group").alias("Individuals with following partner's status at baseline"),
        fixed(F.col("no_diabetes_pct"), 1).alias("No diabetes, %"),
        fixed(F.col("diabetes_pct"), 1).alias("Diabetes, %"),
        (F.when(F.col("role") == "Women", 0).otherwise(2) + F.col("partner_baseline_dm")).alias("position"))


# -- the descriptive table -------------------------------------------------

def table_one(dyads: DataFrame) -> DataFrame:
    """Continuous, binary and categorical rows in one layout, in order."""
    shape = ["section", "position", "line", "variable", "level", "female", "male", "compare",
             "missing_female", "missing_male"]
    none = F.lit(None).cast("string")

    def missing(role):
        return F.concat(fixed(F.col(f"missing_{role}"), 1), F.lit("%"))

    continuous = continuous_summary(dyads).select(
        F.lit(1).alias("section"), "position", F.lit(0).cast("long").alias("line"), "variable", none.alias("level"),
        *[F.concat(fixed(F.col(f"mean_{r}"), 1), F.lit(" ("), fixed(F.col(f"sd_{r}"), 1), F.lit(")")).alias(r)
          for r in ROLES],
        fixed(F.col("correlation"), 3).alias("compare"), *[missing(r).alias(f"missing_{r}") for r in ROLES])

    odds = F.when(F.col("odds_ratio").isNull(), "NA").otherwise(F.concat(
        fixed(F.col("odds_ratio"), 2), F.lit(" ("), fixed(F.col("conf_low"), 2), F.lit(", "),
        fixed(F.col("conf_high"), 2), F.lit(")")))
    tests = fisher_by_variable(dyads).select("variable", odds.alias("compare"))
    binary = binary_summary(dyads).join(tests, "variable", "left").select(
        F.lit(2).alias("section"), "position", F.lit(0).cast("long").alias("line"), "variable", none.alias("level"),
        *[F.concat(F.col(f"n_{r}").cast("string"), F.lit(" ("), fixed(F.col(f"pct_{r}"), 1), F.lit("%)")).alias(r)
          for r in ROLES],
        F.coalesce("compare", F.lit("NA")).alias("compare"), *[missing(r).alias(f"missing_{r}") for r in ROLES])

    order = F.create_map(*[c for k, v in enumerate(CATEGORICAL) for c in (F.lit(v), F.lit(k))])
    line = F.row_number().over(Window.partitionBy("variable").orderBy("level")).cast("long") - 1
    levels = level_shares(dyads).join(chi_square(dyads).select("variable", "p_value"), "variable", "left")
    levels = levels.withColumn("line", line)
    first = F.col("line") == 0
    categorical = levels.select(
        F.lit(3).alias("section"), order[F.col("variable")].alias("position"), "line",
        F.when(first, F.col("variable")).otherwise("").alias("variable"), F.col("level").cast("string").alias("level"),
        *[F.concat(fixed(F.col(f"pct_{r}"), 1), F.lit("%")).alias(r) for r in ROLES],
        F.when(first, p_text(F.col("p_value"))).otherwise("").alias("compare"),
        *[F.when(first, missing(r)).otherwise("").alias(f"missing_{r}") for r in ROLES])
    return continuous.select(shape).unionByName(binary.select(shape)).unionByName(categorical.select(shape))
