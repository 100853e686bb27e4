"""Model terms and design columns.

A model is a list of terms, each a tuple of variables. A variable is a column
name or a power of one (``poly``). Categorical variables carry an explicit
level list whose first level is the reference.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.functions.columns import level_code


@dataclass(frozen=True)
class Power:
    column: str
    degree: int

    def __str__(self) -> str:
        return f"I({self.column}^{self.degree})"


def base_column(variable) -> str:
    return variable.column if isinstance(variable, Power) else variable


def numeric_value(variable) -> Column:
    c = F.col(base_column(variable)).cast("double")
    return F.pow(c, F.lit(float(variable.degree))) if isinstance(variable, Power) else c


def poly(column: str, degree: int) -> Power:
    """The raw power of a numeric column, a variable of its own."""
    return Power(column, degree)


def star(a, b) -> list[tuple]:
    """Both main effects and their interaction."""
    return [(a,), (b,), (a, b)]


def power(variables: Sequence, degree: int) -> list[tuple]:
    """All main effects and interactions up to ``degree`` variables."""
    return [c for d in range(1, degree + 1) for c in combinations(variables, d)]


def term_list(*groups) -> list[tuple]:
    """Merge terms: duplicates removed, lower orders first, otherwise in written order.

    Within a term the variables follow their first appearance, so ``b*a`` after
    ``a*b`` adds nothing.
    """
    flat = []
    for g in groups:
        if isinstance(g, (str, Power)):
            flat.append((g,))
        elif isinstance(g, tuple):
            flat.append(g)
        else:
            flat.extend(t if isinstance(t, tuple) else (t,) for t in g)
    order = []
    for t in flat:
        order.extend(v for v in t if v not in order)
    out = []
    for t in flat:
        t = tuple(sorted(set(t), key=order.index))
        if t not in out:
            out.append(t)
    return sorted(out, key=len)


def term_label(term: tuple) -> str:
    return ":".join(str(v) for v in term)


@dataclass(frozen=True)
class DesignColumn:
    term: int                 # -1 for the intercept
    dummies: tuple            # ((factor, level position), ...)
    numerics: tuple           # variables multiplied together
    label: str


class Design:
    """Columns of the model matrix for a term list, with optional centring and scaling.

    ``shift``/``scale`` standardise numeric variables inside the fit only;
    ``unscale`` maps coefficients back to the original units.
    """

    def __init__(self, terms: Sequence[tuple], levels: Mapping[str, Sequence], intercept: bool = True,
                 tag: str = ""):
        self.f, self.x = f"__{tag}f", f"__{tag}x"     # prefixes of the input columns
        self.terms = [tuple(t) for t in terms]
        self.intercept = intercept
        self.levels = {v: tuple(levels[v]) for t in self.terms for v in t if v in levels}
        self.factors = list(self.levels)
        self.numerics = list(dict.fromkeys(v for t in self.terms for v in t if v not in self.levels))
        self.shift = dict.fromkeys(self.numerics, 0.0)
        self.scale = dict.fromkeys(self.numerics, 1.0)
        self.columns = [DesignColumn(-1, (), (), "(Intercept)")] if intercept else []
        present = {frozenset(t) for t in self.terms} | ({frozenset()} if intercept else set())
        full_coded = set()
        for i, term in enumerate(self.terms):
            choices, numerics = [], []
            for v in term:
                if v not in self.levels:
                    numerics.append(v)
                    continue
                # Contrasts against the first level if the margin is in the model, else every level.
                margin = frozenset(term) - {v}
                first = 1 if margin in present or (not margin and full_coded) else 0
                if not margin and not first:
                    full_coded.add(v)
                choices.append([(v, k) for k in range(first, len(self.levels[v]))])
            for combo in product(*reversed(choices)):
                combo = tuple(reversed(combo))
                parts, it = [], iter(combo)
                for v in term:
                    parts.append(f"{v}{self.levels[v][next(it)[1]]}" if v in self.levels else str(v))
                self.columns.append(DesignColumn(i, combo, tuple(numerics), ":".join(parts)))

    @property
    def p(self) -> int:
        return len(self.columns)

    def labels(self) -> list[str]:
        return [c.label for c in self.columns]

    def term_labels(self) -> list[str]:
        return [term_label(t) for t in self.terms]

    def columns_of(self, keep_terms) -> list[int]:
        keep = set(keep_terms)
        return [j for j, c in enumerate(self.columns) if c.term == -1 or c.term in keep]

    def relatives(self, i: int) -> list[int]:
        """Terms that strictly contain term i."""
        return [j for j, t in enumerate(self.terms) if j != i and set(self.terms[i]) < set(t)]

    def can_centre(self) -> bool:
        """Centring keeps the column space only if every term's margins are in the model."""
        if not self.intercept:
            return False
        present = {frozenset(t) for t in self.terms}
        for t in self.terms:
            for v in t:
                rest = frozenset(t) - {v}
                if v not in self.levels and rest and rest not in present:
                    return False
        return True

    def standardise(self, stats: Mapping) -> None:
        centre = self.can_centre()
        for v, (mean, sd) in stats.items():
            spread = sd if sd and sd > 0 else (abs(mean) or 1.0)
            self.scale[v] = float(spread if centre else max(spread, abs(mean)))
            self.shift[v] = float(mean) if centre else 0.0

    def unscale(self) -> np.ndarray:
        """Matrix A with beta_original = A beta_scaled."""
        where = {(c.dummies, frozenset(c.numerics)): j for j, c in enumerate(self.columns)}
        a = np.zeros((self.p, self.p))
        for j, c in enumerate(self.columns):
            factor = 1.0
            for v in c.numerics:
                factor /= self.scale[v]
            for r in range(len(c.numerics) + 1):
                for kept in combinations(c.numerics, r):
                    weight = factor
                    for v in c.numerics:
                        if v not in kept:
                            weight *= -self.shift[v]
                    if weight != 0.0:
                        a[where[(c.dummies, frozenset(kept))], j] += weight
        return a

    # ------------------------------------------------------------ data side

    def input_columns(self) -> list[Column]:
        """Codes and numeric inputs, computed on the JVM: ``__f0.. __x0..``."""
        out = [level_code(f, self.levels[f]).cast("int").alias(f"{self.f}{i}") for i, f in enumerate(self.factors)]
        out += [numeric_value(v).alias(f"{self.x}{i}") for i, v in enumerate(self.numerics)]
        return out

    def input_names(self) -> list[str]:
        return [f"{self.f}{i}" for i in range(len(self.factors))] + [f"{self.x}{i}" for i in range(len(self.numerics))]

    def matrix(self, batch, scaled: bool = True) -> np.ndarray:
        """Dense model matrix of one Arrow batch holding the input columns."""
        codes = {f: np.asarray(batch[f"{self.f}{i}"]) for i, f in enumerate(self.factors)}
        nums = {}
        for i, v in enumerate(self.numerics):
            x = np.asarray(batch[f"{self.x}{i}"], dtype=float)
            nums[v] = (x - self.shift[v]) / self.scale[v] if scaled else x
        out = np.empty((len(batch), self.p), order="F")
        hits = {}
        for j, c in enumerate(self.columns):
            col = np.ones(len(batch))
            for d in c.dummies:
                if d not in hits:
                    hits[d] = (codes[d[0]] == d[1]).astype(float)
                col = col * hits[d]
            for v in c.numerics:
                col = col * nums[v]
            out[:, j] = col
        return out

    def linear_predictor(self, beta: Sequence[float]) -> Column:
        """x'beta as one JVM expression: per term a coefficient lookup times its numeric part."""
        names = {f: F.col(f"{self.f}{i}") for i, f in enumerate(self.factors)}
        nums = {v: F.col(f"{self.x}{i}") for i, v in enumerate(self.numerics)}
        total = F.lit(0.0)
        groups = {}
        for j, c in enumerate(self.columns):
            groups.setdefault(c.term, []).append((c, float(beta[j])))
        for i, cols in groups.items():
            term = () if i == -1 else self.terms[i]
            factors = [v for v in term if v in self.levels]
            if not factors:
                piece = F.lit(cols[0][1])
            else:
                sizes = [len(self.levels[f]) for f in factors]
                table = np.zeros(sizes)
                for c, b in cols:
                    table[tuple(k for _, k in c.dummies)] = b
                position = F.lit(0)
                for f, size in zip(factors, sizes, strict=True):
                    position = position * F.lit(size) + names[f]
                piece = F.get(F.array(*[F.lit(float(b)) for b in table.ravel()]), position)
            for v in term:
                if v not in self.levels:
                    piece = piece * nums[v]
            total = total + piece
        return total


def design(df: DataFrame, terms: Sequence[tuple], levels: Mapping[str, Sequence] | None = None,
           intercept: bool = True, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Model-matrix columns on a table, as JVM expressions ``m0..``; returns (table, labels)."""
    d = Design(terms, levels or {}, intercept)
    cols = []
    with_inputs = df.select(*keep, *d.input_columns())
    names = {f: F.col(f"{d.f}{i}") for i, f in enumerate(d.factors)}
    nums = {v: F.col(f"{d.x}{i}") for i, v in enumerate(d.numerics)}
    for j, c in enumerate(d.columns):
        expr = F.lit(1.0)
        for f, k in c.dummies:
            expr = expr * (names[f] == F.lit(k)).cast("double")
        for v in c.numerics:
            expr = expr * nums[v]
        cols.append(expr.alias(f"m{j}"))
    return with_inputs.select(*keep, *cols), d.labels()
