"""SQL text that fits small models inside DuckDB, as an independent check of the Spark fits.

Each fit is a recursive query: cyclic one-coordinate Newton steps over grouped
data, or Newton steps on a finite-difference stencil for likelihoods without
a short derivative.
"""

from __future__ import annotations

from collections.abc import Sequence


def glm_cte(name: str, source: str, columns: Sequence[str], family: str, sweeps: int = 120) -> str:
    """CTEs ``{name}_it`` and ``{name}``(b0..): coefficients of a logit or Gamma-log model.

    ``source`` has the design expressions' inputs, ``n`` rows and ``s`` = sum(y).
    """
    p = len(columns)
    b = [f"b{j}" for j in range(p)]
    eta = " + ".join(f"b{j} * ({c})" for j, c in enumerate(columns))
    pick = " ".join(f"WHEN {j} THEN ({c})::DOUBLE" for j, c in enumerate(columns))
    if family == "binomial":
        mean, score, info, start = f"1 / (1 + exp(-({eta})))", "s - n * mu", "n * mu * (1 - mu)", "ln(sum(s) / (sum(n) - sum(s)))"
    else:
        mean, score, info, start = f"exp({eta})", "s / mu - n", "n", "ln(sum(s) / sum(n))"
    names = ", ".join(b)
    init = ", ".join([f"{start} AS b0", *[f"0.0::DOUBLE AS {v}" for v in b[1:]]])
    move = ", ".join(f"{v} + CASE WHEN i % {p} = {j} THEN g / h ELSE 0 END" for j, v in enumerate(b))
    return (f"{name}_it(i, {names}) AS (SELECT 0, {init} FROM {source} UNION ALL SELECT i + 1, {move} FROM ("
            f"SELECT i, {names}, sum(({score}) * x) AS g, sum(({info}) * x * x) AS h FROM ("
            f"SELECT i, {names}, n, s, CASE i % {p} {pick} END AS x, {mean} AS mu FROM {name}_it, {source} "
            f"WHERE i < {p * sweeps}) GROUP BY i, {names})), "
            f"{name} AS (SELECT {names} FROM {name}_it WHERE i = {p * sweeps})")


def glm_deviance(name: str, source: str, columns: Sequence[str], family: str) -> str:
    """Scalar SELECT of the deviance at the fit; a Gamma source also carries ``ln`` = sum(ln y)."""
    eta = " + ".join(f"b{j} * ({c})" for j, c in enumerate(columns))
    if family == "binomial":
        return (f"(SELECT -2 * sum(s * ln(mu) + (n - s) * ln(1 - mu)) FROM (SELECT n, s, 1 / (1 + exp(-({eta}))) AS mu "
                f"FROM {name}, {source}))")
    return (f"(SELECT 2 * sum(n * ln(mu) - ln + (s - n * mu) / mu) FROM (SELECT n, s, ln, exp({eta}) AS mu FROM {name}, {source}))")


def stencil_newton_1d(name: str, source: str, group: str, objective: str, start: str, steps: int = 30, h: float = 1e-3) -> str:
    """CTE ``{name}({group}, v)``: maximiser of sum(objective) in the variable ``v``, per group."""
    shifted = ", ".join(f"sum(CASE WHEN d = {d} THEN f END) AS f{k}" for k, d in enumerate((-1, 0, 1)))
    return (f"{name}_it(i, {group}, v) AS (SELECT 0, {group}, {start} FROM {source} GROUP BY {group} UNION ALL "
            f"SELECT i + 1, {group}, v + greatest(-1.0, least(1.0, (f2 - f0) / (2 * {h}) / abs((f2 - 2 * f1 + f0) / ({h} * {h})))) FROM ("
            f"SELECT i, {group}, v0 AS v, {shifted} FROM (SELECT i, it.{group}, d, it.v AS v0, {objective} AS f FROM "
            f"(SELECT i, {group}, v, d, v + d * {h} AS w FROM {name}_it, (VALUES (-1), (0), (1)) s(d) WHERE i < {steps}) it "
            f"JOIN {source} src ON src.{group} = it.{group}) GROUP BY i, {group}, v0)), "
            f"{name} AS (SELECT {group}, v FROM {name}_it WHERE i = {steps})")


def stencil_newton_2d(name: str, source: str, objective: str, start: tuple[str, str], steps: int = 30, h: float = 1e-3) -> str:
    """CTE ``{name}(u, v)``: maximiser of sum(objective) in ``u`` and ``v`` from a 3 x 3 stencil."""
    cells = ", ".join(f"sum(CASE WHEN d = {a} AND e = {b} THEN f END) AS f{'mzp'[a + 1]}{'mzp'[b + 1]}"
                      for a in (-1, 0, 1) for b in (-1, 0, 1))
    gu, gv = f"(fpz - fmz) / (2 * {h})", f"(fzp - fzm) / (2 * {h})"
    huu, hvv = f"(fpz - 2 * fzz + fmz) / ({h} * {h})", f"(fzp - 2 * fzz + fzm) / ({h} * {h})"
    huv = f"(fpp - fpm - fmp + fmm) / (4 * {h} * {h})"
    det = "(huu * hvv - huv * huv)"
    return (f"{name}_it(i, u, v) AS (SELECT 0, {start[0]}, {start[1]} FROM {source} UNION ALL SELECT i + 1, "
            f"u - CASE WHEN {det} > 0 AND huu < 0 THEN greatest(-1.0, least(1.0, (hvv * gu - huv * gv) / {det})) ELSE gu / -abs(huu) END, "
            f"v - CASE WHEN {det} > 0 AND huu < 0 THEN greatest(-1.0, least(1.0, (huu * gv - huv * gu) / {det})) ELSE gv / -abs(hvv) END "
            f"FROM (SELECT i, u, v, {gu} AS gu, {gv} AS gv, {huu} AS huu, {hvv} AS hvv, {huv} AS huv FROM ("
            f"SELECT i, u0 AS u, v0 AS v, {cells} FROM (SELECT i, d, e, it.u0, it.v0, {objective} AS f FROM "
            f"(SELECT i, u AS u0, v AS v0, d, e, u + d * {h} AS u, v + e * {h} AS v FROM {name}_it, (VALUES (-1), (0), (1)) a(d), "
            f"(VALUES (-1), (0), (1)) b(e) WHERE i < {steps}) it, {source} src) GROUP BY i, u0, v0))), "
            f"{name} AS (SELECT u, v FROM {name}_it WHERE i = {steps})")


def negbin_log_density(y: str, mu: str, k: str, truncated: bool) -> str:
    text = (f"(lgamma({y} + {k}) - lgamma({k}) - lgamma({y} + 1) + {k} * ln({k} / ({k} + {mu})) + {y} * ln({mu} / ({k} + {mu}))")
    if truncated:
        text += f" - ln(1 - pow({k} / ({k} + {mu}), {k}))"
    return text + ")"


def newton_cte(name: str, source: str, columns: Sequence[str], family: str, steps: int = 12) -> str:
    """CTEs ``{name}_d`` (design rows), ``{name}_it`` and ``{name}``(b): a logit or Gamma-log fit by full Newton steps.

    The p x p system is summed in SQL and solved by Gauss-Jordan elimination
    on lists, one nested SELECT per pivot. ``source`` has ``n`` rows and
    ``s`` = sum(y) per design row (and ``ln`` = sum(ln y) for Gamma).
    """
    p = len(columns)
    x = ", ".join(f"({c})::DOUBLE" for c in columns)
    if family == "binomial":
        mean, weight, score, start = "1 / (1 + exp(-eta))", "n * mu * (1 - mu)", "s - n * mu", "ln(sum(s) / (sum(n) - sum(s)))"
        kept = "n, s"
    else:
        mean, weight, score, start = "exp(eta)", "n", "s / mu - n", "ln(sum(s) / sum(n))"
        kept = "n, s, ln"
    rows = ", ".join("[" + ", ".join([f"h{min(j, k)}_{max(j, k)}" for k in range(p)] + [f"g{j}"]) + "]" for j in range(p))
    sums = ", ".join([f"sum(w * x[{j + 1}] * x[{k + 1}]) AS h{j}_{k}" for j in range(p) for k in range(j, p)]
                     + [f"sum(r * x[{j + 1}]) AS g{j}" for j in range(p)])
    solved = (f"SELECT i, b, [{rows}] AS a FROM (SELECT i, b, {sums} FROM (SELECT i, b, x, {weight} AS w, {score} AS r FROM ("
              f"SELECT i, b, x, n, s, {mean} AS mu FROM (SELECT i, b, x, n, s, list_dot_product(b, x) AS eta "
              f"FROM {name}_it, {name}_d WHERE i < {steps}))) GROUP BY i, b)")
    for k in range(1, p + 1):
        solved = pivot_sql(solved, k, "i, b")
    return (f"{name}_d AS (SELECT [{x}] AS x, {kept} FROM {source}), "
            f"{name}_it(i, b) AS (SELECT 0, list_concat([{start}], list_resize([]::DOUBLE[], {p - 1}, 0.0::DOUBLE)) FROM {name}_d UNION ALL "
            f"SELECT i + 1, list_transform(b, lambda v, j: v + a[j][{p + 1}]) FROM ({solved})), "
            f"{name} AS (SELECT b FROM {name}_it WHERE i = {steps})")


def pivot_sql(inner: str, k: int, keep: str) -> str:
    """One Gauss-Jordan step on the list of rows ``a``."""
    return (f"SELECT {keep}, list_transform(a, lambda row, j: CASE WHEN j = {k} THEN list_transform(row, lambda v: v / row[{k}]) "
            f"ELSE list_transform(row, lambda v, c: v - row[{k}] * q[c] / q[{k}]) END) AS a FROM (SELECT {keep}, a, a[{k}] AS q FROM ({inner}))")


def newton_deviance(name: str, family: str) -> str:
    """Scalar SELECT of the deviance at a ``newton_cte`` fit (without the y-only part for a Bernoulli response)."""
    if family == "binomial":
        return (f"(SELECT -2 * sum(s * ln(mu) + (n - s) * ln(1 - mu)) FROM (SELECT n, s, 1 / (1 + exp(-list_dot_product(b, x))) AS mu "
                f"FROM {name}, {name}_d))")
    return f"(SELECT 2 * sum(n * ln(mu) - ln + (s - n * mu) / mu) FROM (SELECT n, s, ln, exp(list_dot_product(b, x)) AS mu FROM {name}, {name}_d))"


def newton_covariance(name: str, p: int, family: str) -> str:
    """CTE ``{name}_v``(v): inverse information, a list of rows, at a ``newton_cte`` fit."""
    weight = "n * mu * (1 - mu)" if family == "binomial" else "n"
    mean = "1 / (1 + exp(-list_dot_product(b, x)))" if family == "binomial" else "exp(list_dot_product(b, x))"
    rows = ", ".join("[" + ", ".join([f"h{min(j, k)}_{max(j, k)}" for k in range(p)]
                                     + ["1.0::DOUBLE" if k == j else "0.0::DOUBLE" for k in range(p)]) + "]" for j in range(p))
    sums = ", ".join(f"sum(w * x[{j + 1}] * x[{k + 1}]) AS h{j}_{k}" for j in range(p) for k in range(j, p))
    solved = f"SELECT 1 AS one, [{rows}] AS a FROM (SELECT {sums} FROM (SELECT x, {weight} AS w FROM (SELECT x, n, {mean} AS mu FROM {name}, {name}_d)))"
    for k in range(1, p + 1):
        solved = pivot_sql(solved, k, "one")
    return f"{name}_v AS (SELECT list_transform(a, lambda row: row[{p + 1}:{2 * p}]) AS v FROM ({solved}))"


def quadratic_form(v: str, x: str) -> str:
    """x' V x for a list of rows ``v``."""
    return f"list_dot_product(list_transform({v}, lambda row: list_dot_product(row, {x})), {x})"


def term_columns(terms, levels, expressions) -> list[tuple[tuple, list[str]]]:
    """Per term its SQL design columns: first-level contrasts of factors times numeric expressions."""
    out = []
    for term in terms:
        parts = [""]
        for v in term:
            name = str(v)
            if name in levels:
                pick = [f"({expressions.get(name, name)} = '{lv}')::INTEGER" for lv in levels[name][1:]]
            else:
                pick = [f"({expressions[name]})"]
            parts = [f"{a} * {b}" if a else b for b in pick for a in parts]
        out.append((term, parts))
    return out


def type_ii_sql(head: str, source: str, terms, levels, expressions, family: str, scale: str = "1", steps: int = 12) -> str:
    """SELECT of a Type-II likelihood-ratio table: term, lr_chisq, df. ``scale`` may use the fit ``mfull``."""
    cols = term_columns(terms, levels, expressions)
    fits, ctes = {}, []

    def fit(keep):
        key = tuple(keep)
        if key not in fits:
            name = "mfull" if len(key) == len(terms) else f"m{len(fits)}"
            fits[key] = name
            ctes.append(newton_cte(name, source, ["1", *[c for i in key for c in cols[i][1]]], family, steps))
        return newton_deviance(fits[key], family)

    fit(range(len(terms)))
    rows = []
    for i, (term, mine) in enumerate(cols):
        rest = [j for j in range(len(terms)) if j != i and not set(term) < set(terms[j])]
        label = ":".join(str(v) for v in term)
        rows.append((label, f"({fit(rest)} - {fit(sorted([*rest, i]))}) / {scale}", len(mine)))
    from wavepanel.plans.registry import r
    table = " UNION ALL ".join(f"SELECT '{label}' AS term, {r(lr, 4)} AS lr_chisq, {df} AS df" for label, lr, df in rows)
    return f"WITH RECURSIVE {head}, {', '.join(ctes)} {table}"


def design_list(terms, levels, expressions) -> str:
    """The design row of a term list as a SQL list."""
    cols = ["1", *[c for _, mine in term_columns(terms, levels, expressions) for c in mine]]
    return "[" + ", ".join(f"({c})::DOUBLE" for c in cols) + "]"


def predict_sql(name: str, source: str, terms, levels, expressions, family: str, z: str, steps: int = 12) -> tuple[list[str], str, str, str]:
    """(CTEs, p_mle, p_lower, p_upper) to be selected from ``{name}, {name}_v, {name}_phi, grid``."""
    cols = ["1", *[c for _, mine in term_columns(terms, levels, expressions) for c in mine]]
    p = len(cols)
    phi = ("SELECT 1.0::DOUBLE AS phi" if family == "binomial" else
           f"SELECT sum(pow((s - n * mu) / mu, 2) / n) / (sum(n) - {p}) AS phi FROM (SELECT n, s, exp(list_dot_product(b, x)) AS mu FROM {name}, {name}_d)")
    ctes = [newton_cte(name, source, cols, family, steps), newton_covariance(name, p, family), f"{name}_phi AS ({phi})"]
    row = design_list(terms, levels, expressions)
    eta, se = f"list_dot_product(b, {row})", f"sqrt(phi * {quadratic_form('v', row)})"
    inv = (lambda e: f"1 / (1 + exp(-({e})))") if family == "binomial" else (lambda e: f"exp({e})")
    return ctes, inv(eta), inv(f"{eta} - {z} * {se}"), inv(f"{eta} + {z} * {se}")


def _ztnb_score(k: str) -> str:
    q, p0 = f"(mu / (mu + {k}))", f"pow({k} / ({k} + mu), {k})"
    return f"(y - (y + {k}) * {q} - {p0} / (1 - {p0}) * {k} * {q})"


def _ztnb_sums(name: str, p: int, state: str, step: str, h: float = 1e-3) -> str:
    """SELECT of the negative Hessian (h<j>_<k>) and score (g<j>) sums in the coefficients and log k.

    Derivatives in log mu are analytic, those in log k come from a three-point stencil.
    """
    k0, km, kp = "exp(c)", f"exp(c - {h})", f"exp(c + {h})"
    q, p0 = f"(mu / (mu + {k0}))", f"pow({k0} / ({k0} + mu), {k0})"
    ratio = f"({p0} / (1 - {p0}))"
    hmm = f"(-(y + {k0}) * {q} * (1 - {q}) - {ratio} * {k0} * {q} * (1 - {q}) + {ratio} * (1 + {ratio}) * pow({k0} * {q}, 2))"
    ll = [negbin_log_density("y", "mu", k, True) for k in (km, k0, kp)]
    rows = (f"SELECT {state}, x, n * {_ztnb_score(k0)} AS s, -n * {hmm} AS w, -n * ({_ztnb_score(kp)} - {_ztnb_score(km)}) / (2 * {h}) AS wk, "
            f"n * ({ll[2]} - {ll[0]}) / (2 * {h}) AS sk, -n * ({ll[2]} - 2 * {ll[1]} + {ll[0]}) / ({h} * {h}) AS wkk FROM ("
            f"SELECT {state}, x, y, n, exp(list_dot_product(b, x)) AS mu FROM {step}, {name}_d)")
    sums = ([f"sum(w * x[{j + 1}] * x[{k + 1}]) AS h{j}_{k}" for j in range(p) for k in range(j, p)]
            + [f"sum(wk * x[{j + 1}]) AS h{j}_{p}" for j in range(p)] + [f"sum(wkk) AS h{p}_{p}"]
            + [f"sum(s * x[{j + 1}]) AS g{j}" for j in range(p)] + [f"sum(sk) AS g{p}"])
    return f"SELECT {state}, {', '.join(sums)} FROM ({rows}) GROUP BY {state}"


def ztnb_cte(name: str, source: str, columns: Sequence[str], steps: int = 15) -> list[str]:
    """CTEs of a zero-truncated NB fit: ``{name}``(b, c) with c = log k, and its covariance ``{name}_v``(v)."""
    p = len(columns)
    x = ", ".join(f"({c})::DOUBLE" for c in columns)
    lower = f"(SELECT i, b, c FROM {name}_it WHERE i < {steps})"
    rows = ", ".join("[" + ", ".join([f"h{min(j, k)}_{max(j, k)}" for k in range(p + 1)] + [f"g{j}"]) + "]" for j in range(p + 1))
    solved = f"SELECT i, b, c, [{rows}] AS a FROM ({_ztnb_sums(name, p, 'i, b, c', lower)})"
    for k in range(1, p + 2):
        solved = pivot_sql(solved, k, "i, b, c")
    eye = ", ".join("[" + ", ".join([f"h{min(j, k)}_{max(j, k)}" for k in range(p + 1)]
                                    + ["1.0::DOUBLE" if k == j else "0.0::DOUBLE" for k in range(p + 1)]) + "]" for j in range(p + 1))
    inverse = f"SELECT 1 AS one, [{eye}] AS a FROM ({_ztnb_sums(name, p, 'b, c', name)})"
    for k in range(1, p + 2):
        inverse = pivot_sql(inverse, k, "one")
    return [f"{name}_d AS (SELECT [{x}] AS x, y, n FROM {source})",
            f"{name}_it(i, b, c) AS (SELECT 0, list_concat([ln(sum(n * y) / sum(n))], list_resize([]::DOUBLE[], {p - 1}, 0.0::DOUBLE)), 0.0::DOUBLE "
            f"FROM {name}_d UNION ALL SELECT i + 1, list_transform(b, lambda v, j: v + a[j][{p + 2}]), "
            f"c + greatest(-1.0, least(1.0, a[{p + 1}][{p + 2}])) FROM ({solved}))",
            f"{name} AS (SELECT b, c FROM {name}_it WHERE i = {steps})",
            f"{name}_v AS (SELECT list_transform(a, lambda row: row[{p + 2}:{2 * p + 2}]) AS v FROM ({inverse}))"]


def wald_sql(name: str, positions: Sequence[int]) -> str:
    """Scalar SELECT of b' V^-1 b over the given 1-based coefficient positions."""
    m = len(positions)
    rows = ", ".join("[" + ", ".join([f"v[{i}][{j}]" for j in positions] + [f"b[{i}]"]) + "]" for i in positions)
    solved = f"SELECT b, [{rows}] AS a FROM {name}, {name}_v"
    for k in range(1, m + 1):
        solved = pivot_sql(solved, k, "b")
    total = " + ".join(f"b[{i}] * a[{k + 1}][{m + 1}]" for k, i in enumerate(positions))
    return f"(SELECT {total} FROM ({solved}))"
