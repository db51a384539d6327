"""SQL that fits logistic models by accelerated gradient steps, independent of the Newton steps it is compared with."""

from __future__ import annotations

from collections.abc import Sequence

STEPS = 1000


def logistic_ctes(name: str, rows: str, features: Sequence[str], reg: float = 0.01, steps: int = STEPS, flat: float | None = None) -> list[str]:
    """Stages that end in ``name`` (m, c0, c1 ...): intercept and coefficients of each model of ``rows`` (m, y, w, features).

    The least of the mean weighted loss plus half of ``reg`` times the squared standardised coefficients; with curvature
    between ``flat``, by default ``reg``, and a quarter of the number of features, the error falls by a fixed factor in each
    step.  ``name``_g has the standardised coefficients b1, b2 ... of each step ``it``.
    """
    d = len(features)
    every = range(d + 1)
    steep = 0.25 * (d + 1) + reg
    root = ((flat or reg) / steep) ** 0.5
    push = (1 - root) / (1 + root)
    means = ", ".join(f"sum(w * {f}) / sum(w) AS m{k}" for k, f in enumerate(features, 1))
    spreads = ", ".join(f"sqrt(sum(w * ({f} - m{k}) ** 2) / (any_value(sw) - any_value(sww) / any_value(sw))) AS s{k}" for k, f in enumerate(features, 1))
    scaled = ", ".join(f"coalesce(({f} - m{k}) / nullif(s{k}, 0), 0) AS z{k}" for k, f in enumerate(features, 1))
    margin = " + ".join(["v0", *[f"v{k} * z{k}" for k in range(1, d + 1)]])
    slopes = ", ".join([f"sum(e) AS g0", *[f"sum(e * z{k}) AS g{k}" for k in range(1, d + 1)]])  # noqa: F541
    at = ", ".join(f"any_value(b{k}) AS b{k}, any_value(v{k}) AS v{k}" for k in every)
    new = {k: f"v{k} - (g{k}" + (f" + {reg!r} * v{k}" if k else "") + f") / {steep!r}" for k in every}
    moved = ", ".join(f"{new[k]} AS b{k}, ({new[k]}) + {push!r} * ({new[k]} - b{k}) AS v{k}" for k in every)
    return [
        f"{name}_s AS MATERIALIZED (SELECT m, sum(w) AS sw, sum(w * w) AS sww, {means} FROM {rows} GROUP BY m)",
        f"{name}_v AS MATERIALIZED (SELECT m, {spreads} FROM {rows} JOIN {name}_s USING (m) GROUP BY m)",
        f"{name}_t AS MATERIALIZED (SELECT m, CAST(y AS DOUBLE) AS y, w / sw AS w, {scaled} FROM {rows} JOIN {name}_s USING (m) JOIN {name}_v USING (m))",
        f"{name}_g AS (SELECT m, 0 AS it, {', '.join(f'0.0::DOUBLE AS b{k}, 0.0::DOUBLE AS v{k}' for k in every)} FROM {name}_s UNION ALL"
        f" SELECT m, it + 1, {moved} FROM (SELECT m, it, {at}, {slopes} FROM"
        f" (SELECT *, w * (1 / (1 + exp(-({margin}))) - y) AS e FROM {name}_g JOIN {name}_t USING (m) WHERE it < {steps}) GROUP BY m, it))",
        f"{name} AS MATERIALIZED (SELECT m, b0 - (" + " + ".join(f"coalesce(b{k} * m{k} / nullif(s{k}, 0), 0)" for k in range(1, d + 1)) + ") AS c0, "
        + ", ".join(f"coalesce(b{k} / nullif(s{k}, 0), 0) AS c{k}" for k in range(1, d + 1))
        + f" FROM {name}_g JOIN {name}_s USING (m) JOIN {name}_v USING (m) WHERE it = {steps})",
    ]


def probability(model: str, features: Sequence[str]) -> str:
    """Probability of class 1 by the joined model ``model``."""
    return "1 / (1 + exp(-(" + " + ".join([f"{model}.c0", *[f"{model}.c{k} * {f}" for k, f in enumerate(features, 1)]]) + ")))"


def softmax_ctes(name: str, rows: str, features: Sequence[str], classes: int, reg: float = 0.01, steps: int = 2 * STEPS) -> list[str]:
    """The same for labels 0, 1 ... with one row of coefficients for each class: ``name`` (m, c0_0, c0_1 ...), class first."""
    d = len(features)
    first = logistic_ctes(name, rows, features, reg)[:3]
    cells = [(a, k) for a in range(classes) for k in range(d + 1)]
    steep = 0.5 * (d + 1) + reg
    root = (reg / steep) ** 0.5
    push = (1 - root) / (1 + root)
    margin = {a: " + ".join([f"v{a}_0", *[f"v{a}_{k} * z{k}" for k in range(1, d + 1)]]) for a in range(classes)}
    exps = ", ".join(f"exp({margin[a]}) AS x{a}" for a in range(classes))
    whole = " + ".join(f"x{a}" for a in range(classes))
    errors = ", ".join(f"w * (x{a} / ({whole}) - CAST(y = {a} AS INTEGER)) AS e{a}" for a in range(classes))
    slopes = ", ".join(f"sum(e{a}" + (f" * z{k}" if k else "") + f") AS g{a}_{k}" for a, k in cells)
    at = ", ".join(f"any_value(b{a}_{k}) AS b{a}_{k}, any_value(v{a}_{k}) AS v{a}_{k}" for a, k in cells)
    new = {(a, k): f"v{a}_{k} - (g{a}_{k}" + (f" + {reg!r} * v{a}_{k}" if k else "") + f") / {steep!r}" for a, k in cells}
    moved = ", ".join(f"{new[x]} AS b{x[0]}_{x[1]}, ({new[x]}) + {push!r} * ({new[x]} - b{x[0]}_{x[1]}) AS v{x[0]}_{x[1]}" for x in cells)
    zeros = ", ".join(f"0.0::DOUBLE AS b{a}_{k}, 0.0::DOUBLE AS v{a}_{k}" for a, k in cells)
    bases = ", ".join(f"b{a}_0 - (" + " + ".join(f"coalesce(b{a}_{k} * m{k} / nullif(s{k}, 0), 0)" for k in range(1, d + 1)) + f") AS c{a}_0" for a in range(classes))
    rest = ", ".join(f"coalesce(b{a}_{k} / nullif(s{k}, 0), 0) AS c{a}_{k}" for a, k in cells if k)
    return [
        *first,
        f"{name}_g AS (SELECT m, 0 AS it, {zeros} FROM {name}_s UNION ALL SELECT m, it + 1, {moved} FROM (SELECT m, it, {at}, {slopes} FROM"
        f" (SELECT *, {errors} FROM (SELECT *, {exps} FROM {name}_g JOIN {name}_t USING (m) WHERE it < {steps})) GROUP BY m, it))",
        f"{name} AS MATERIALIZED (SELECT m, {bases}, {rest} FROM {name}_g JOIN {name}_s USING (m) JOIN {name}_v USING (m) WHERE it = {steps})",
    ]
