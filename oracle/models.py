"""Newton fits in SQL: recursive statements that hold coefficients in lists.

All models of a family share one recursion.  Shorter designs are padded with
zero columns, which get a one on the diagonal.  A step builds the information
matrix and score as a nested list and eliminates it row by row.
"""

from __future__ import annotations


def _eliminate(source: str, size: int, carried: str) -> str:
    """Gauss-Jordan on the nested list ``a`` with ``size`` rows."""
    statement = source
    for k in range(1, size + 1):
        statement = (
            f"SELECT {carried}, list_transform(a, lambda row, i: CASE WHEN i = {k} "
            f"THEN list_transform(row, lambda v: v / row[{k}]) "
            f"ELSE list_transform(row, lambda v, j: v - row[{k}] * a[{k}][j] / a[{k}][{k}]) END) AS a "
            f"FROM ({statement}) e{k}")
    return statement


def _identity_row(size: int) -> str:
    return f"list_transform(range(1, {size + 1}), lambda q: CASE WHEN q = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _index(name: str, last: int, first: int = 1) -> str:
    return f"(SELECT unnest(range({first}, {last + 1})) AS {name}) x_{name}"


def _next(cells: str, size: int) -> str:
    """One Newton update from rows (model, step, b, i, j, v); column size + 1 is the score."""
    rows = (f"SELECT model, step, any_value(b) AS b, i, list(v ORDER BY j) || {_identity_row(size)} AS line "
            f"FROM ({cells}) c GROUP BY model, step, i")
    matrix = f"SELECT model, step, any_value(b) AS b, list(line ORDER BY i) AS a FROM ({rows}) l GROUP BY model, step"
    solved = _eliminate(matrix, size, "model, step, b")
    return (f"SELECT model, step + 1, list_transform(range(1, {size + 1}), lambda i: b[i] + a[i][{size + 1}]), "
            f"list_transform(a, lambda line: line[{size + 2}:{2 * size + 1}]) FROM ({solved}) s")


def _start(source: str, size: int) -> str:
    zeros = "[" + ", ".join(["0.0::DOUBLE"] * size) + "]"
    return f"SELECT DISTINCT model, 0 AS step, {zeros} AS b, CAST(NULL AS DOUBLE[][]) AS inv FROM {source}"


def _end(prefix: str, size: int, steps: int, first: int) -> str:
    """The last step; a term whose variance has grown ten thousandfold since the null model is separated."""
    return (f"SELECT model, b, inv, lost, NOT list_bool_or(lost) AS converged FROM (SELECT e.model, e.b, e.inv, "
            f"list_transform(range(1, {size + 1}), lambda k: k >= {first} AND e.inv[k][k] > 1e4 * z.inv[k][k]) AS lost "
            f"FROM {prefix}_fit_t e JOIN {prefix}_fit_t z ON z.model = e.model WHERE e.step = {steps} AND z.step = 1) x")


def padded(expressions, size: int) -> str:
    return "[" + ", ".join([f"CAST({e} AS DOUBLE)" for e in expressions] + ["0.0::DOUBLE"] * (size - len(expressions))) + "]"


def glm_tables(prefix: str, data: str, size: int, family: str, steps: int = 27) -> dict[str, str]:
    """``data`` gives (model, y, x); the result table is ``{prefix}_end_t``."""
    mean = "exp(eta)" if family == "poisson" else "1 / (1 + exp(-eta))"
    weight = "mu" if family == "poisson" else "mu * (1 - mu)"
    moments = (f"SELECT *, {weight} AS w FROM (SELECT *, {mean} AS mu FROM (SELECT f.model, f.step, f.b, d.y, d.x, "
               f"list_dot_product(f.b, d.x) AS eta FROM {{fit}} f JOIN {prefix}_data_t d ON f.model = d.model) g) m")
    cells = (f"SELECT model, step, any_value(b) AS b, i, j, CASE WHEN j = {size + 1} THEN sum((y - mu) * x[i]) "
             f"WHEN i = j AND max(abs(x[i])) = 0 THEN 1 ELSE sum(w * x[i] * x[j]) END AS v "
             f"FROM ({moments.format(fit=f'(SELECT * FROM {prefix}_fit_t WHERE step < {steps})')}) n, "
             f"{_index('i', size)}, {_index('j', size + 1)} GROUP BY model, step, i, j")
    end = f"(SELECT * FROM {prefix}_fit_t WHERE step = {steps})"
    return {
        f"{prefix}_data_t": data,
        f"{prefix}_fit_t": f"{_start(f'{prefix}_data_t', size)}\nUNION ALL\n{_next(cells, size)}",
        f"{prefix}_end_t": _end(prefix, size, steps, 2),
        f"{prefix}_meat_t": f"SELECT model, i, j, sum((y - mu) ** 2 * x[i] * x[j]) AS v FROM ({moments.format(fit=end)}) n, "
                            f"{_index('i', size)}, {_index('j', size)} GROUP BY model, i, j",
        f"{prefix}_robust_t": f"SELECT e.model, k, sum(e.inv[k][m.i] * m.v * e.inv[m.j][k]) AS var FROM {prefix}_end_t e "
                              f"JOIN {prefix}_meat_t m ON e.model = m.model, {_index('k', size)} GROUP BY e.model, k",
    }


def cox_tables(prefix: str, data: str, size: int, steps: int = 22) -> dict[str, str]:
    """``data`` gives (model, id, t, e, x); Efron ties."""
    wide = size + 1
    tied = (f"SELECT model, step, any_value(b) AS b, t, d, l, list(s - l / d * en ORDER BY i, j) AS m FROM ("
            f"SELECT f.model, f.step, any_value(f.b) AS b, z.t, z.d, i, j, sum(r * o[i] * o[j]) AS s, "
            f"sum(CASE WHEN f.t = z.t AND e = 1 THEN r * o[i] * o[j] ELSE 0 END) AS en "
            f"FROM (SELECT q.model, q.step, q.b, p.t, p.e, exp(list_dot_product(q.b, p.x)) AS r, [1.0::DOUBLE] || p.x AS o "
            f"FROM {{fit}} q JOIN {prefix}_data_t p ON q.model = p.model) f "
            f"JOIN {prefix}_time_t z ON f.model = z.model AND f.t >= z.t, {_index('i', wide)}, {_index('j', wide)} "
            f"GROUP BY f.model, f.step, z.t, z.d, i, j) u, (SELECT unnest(range(0, (SELECT max(d) FROM {prefix}_time_t))) AS l) v WHERE l < d "
            f"GROUP BY model, step, t, d, l")

    def at(i: str, j: str) -> str:
        return f"m[({i} - 1) * {wide} + {j}] / m[1]"

    information = f"{at('i + 1', 'j + 1')} - {at('1', 'i + 1')} * {at('1', 'j + 1')}"
    cells = (f"SELECT c.model, step, b, c.i, j, CASE WHEN j = {size + 1} THEN w.v - c.v "
             f"WHEN c.i = j AND w.flat THEN 1 ELSE c.v END AS v FROM ("
             f"SELECT model, step, any_value(b) AS b, i, j, sum(CASE WHEN j = {size + 1} THEN {at('1', 'i + 1')} "
             f"ELSE {information} END) AS v "
             f"FROM ({tied.format(fit=f'(SELECT * FROM {prefix}_fit_t WHERE step < {steps})')}) n, "
             f"{_index('i', size)}, {_index('j', size + 1)} GROUP BY model, step, i, j) c "
             f"JOIN {prefix}_sum_t w ON c.model = w.model AND c.i = w.i")
    return {
        f"{prefix}_data_t": data,
        f"{prefix}_time_t": f"SELECT model, t, count(*) AS d FROM {prefix}_data_t WHERE e = 1 GROUP BY model, t",
        f"{prefix}_sum_t": f"SELECT model, i, sum(CASE WHEN e = 1 THEN x[i] ELSE 0 END) AS v, max(abs(x[i])) = 0 AS flat "
                           f"FROM {prefix}_data_t, {_index('i', size)} GROUP BY model, i",
        f"{prefix}_fit_t": f"{_start(f'{prefix}_data_t', size)}\nUNION ALL\n{_next(cells, size)}",
        f"{prefix}_end_t": _end(prefix, size, steps, 1),
        # Per event time and tie, at the solution: the weighted means.
        f"{prefix}_tied_t": tied.format(fit=f"(SELECT * FROM {prefix}_fit_t WHERE step = {steps})"),
    }


def clustered_tables(prefix: str, size: int) -> dict[str, str]:
    """Variance clustered on ``id`` and the proportional-hazards test."""
    wide = size + 1

    def mean(j: str) -> str:
        return f"m[1 + {j}] / m[1]"

    information = f"m[i * {wide} + j + 1] / m[1] - ({mean('i')}) * ({mean('j')})"
    # Rows and columns outside a test are those of the identity matrix.
    tests = (f"SELECT t.name, t.cols, len(t.cols) AS df, list(line ORDER BY i) AS a FROM ("
             f"SELECT t.name, t.cols, x_i.i AS i, list(CASE "
             f"WHEN x_j.j = {size + 1} THEN CASE WHEN list_contains(t.cols, x_i.i) THEN u.v ELSE 0 END "
             f"WHEN list_contains(t.cols, x_i.i) AND list_contains(t.cols, x_j.j) THEN q.v "
             f"WHEN x_i.i = x_j.j THEN 1 ELSE 0 END ORDER BY x_j.j) AS line "
             f"FROM {prefix}_test_t t, {_index('i', size)}, {_index('j', size + 1)} "
             f"LEFT JOIN {prefix}_left_t q ON q.i = x_i.i AND q.j = x_j.j LEFT JOIN {prefix}_lift_t u ON u.i = x_i.i "
             f"GROUP BY t.name, t.cols, x_i.i) t GROUP BY t.name, t.cols")
    solved = _eliminate(tests, size, "name, cols, df")
    return {
        f"{prefix}_jump_t": f"SELECT t, any_value(d) AS d, j, sum(1 / m[1]) AS h0, sum({mean('j')} / m[1]) AS h1, "
                            f"sum((1 - l / d) / m[1]) AS g0, sum((1 - l / d) * {mean('j')} / m[1]) AS g1, "
                            f"avg({mean('j')}) AS xm FROM {prefix}_tied_t, {_index('j', size)} GROUP BY t, j",
        f"{prefix}_score_t": f"""
SELECT p.id, s.j, sum(CASE WHEN p.e = 1 AND s.t = p.t THEN p.x[s.j] - s.xm - p.r * (p.x[s.j] * s.g0 - s.g1)
                           ELSE -p.r * (p.x[s.j] * s.h0 - s.h1) END) AS u
FROM (SELECT d.*, exp(list_dot_product(f.b, d.x)) AS r FROM {prefix}_data_t d, {prefix}_end_t f) p
JOIN {prefix}_jump_t s ON s.t <= p.t GROUP BY p.id, s.j""",
        f"{prefix}_meat_t": f"SELECT a.j AS i, b.j AS j, sum(a.u * b.u) AS v FROM {prefix}_score_t a "
                            f"JOIN {prefix}_score_t b ON a.id = b.id GROUP BY a.j, b.j",
        f"{prefix}_robust_t": f"SELECT k, sum(e.inv[k][m.i] * m.v * e.inv[m.j][k]) AS var FROM {prefix}_end_t e, "
                              f"{prefix}_meat_t m, {_index('k', size)} GROUP BY k",
        f"{prefix}_km_t": f"""
SELECT t, 1 - coalesce(exp(sum(ln(1 - d / n)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS g
FROM (SELECT z.t, CAST(z.d AS DOUBLE) AS d, count(*) AS n FROM {prefix}_time_t z JOIN {prefix}_data_t p ON p.t >= z.t GROUP BY z.t, z.d) y""",
        f"{prefix}_lift_t": f"""
SELECT i, sum(g * v) AS v FROM (
  SELECT p.t, i, sum(p.x[i]) AS v FROM {prefix}_data_t p, {_index('i', size)} WHERE p.e = 1 GROUP BY p.t, i
  UNION ALL
  SELECT t, i, -sum({mean('i')}) FROM {prefix}_tied_t, {_index('i', size)} GROUP BY t, i) a
JOIN {prefix}_km_t k ON a.t = k.t GROUP BY i""",
        f"{prefix}_info_t": f"SELECT i, j, sum(g * v) AS g1, sum(g * g * v) AS g2 FROM ("
                            f"SELECT t, i, j, sum({information}) AS v FROM {prefix}_tied_t, {_index('i', size)}, {_index('j', size)} "
                            f"GROUP BY t, i, j) a JOIN {prefix}_km_t k ON a.t = k.t GROUP BY i, j",
        f"{prefix}_left_t": f"""
SELECT w.i, w.j, any_value(w.g2) - sum(a.g1 * e.inv[a.j][b.i] * b.g1) AS v
FROM {prefix}_info_t w JOIN {prefix}_info_t a ON a.i = w.i JOIN {prefix}_info_t b ON b.j = w.j, {prefix}_end_t e
GROUP BY w.i, w.j""",
        f"{prefix}_zph_t": f"SELECT name, df, list_sum(list_transform(cols, lambda k: a[k][{size + 1}] * lift[k])) AS chisq "
                           f"FROM ({solved}) s, (SELECT list(v ORDER BY i) AS lift FROM {prefix}_lift_t) u",
    }
