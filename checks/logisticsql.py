"""SQL text of the logistic pipeline: medians, the power with the largest likelihood, standard scores, Newton steps."""

from __future__ import annotations

from rowmend.core import Spec

from . import sqltext as S

Ctes = list[tuple[str, str]]


def materialized(ctes: Ctes, final: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql.strip()})" for name, sql in ctes)
    return f"WITH {body}\n{final.strip()}"


def power(x: str, lam: str) -> str:
    up = f"CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END"
    down = f"CASE WHEN abs(2 - {lam}) < 1e-12 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


def best_power(source: str, col: str, out: str, levels: int = 14, low: float = -20.0, high: float = 20.0) -> Ctes:
    """``out``: (lam), by closing in on the best of nine values ``levels`` times."""
    ctes = [(f"{out}_0", f"SELECT {low}::DOUBLE AS lo, {high}::DOUBLE AS hi")]
    for k in range(1, levels + 1):
        ctes.append(
            (
                f"{out}_{k}",
                f"""SELECT lam - step AS lo, lam + step AS hi FROM (
                      SELECT arg_max(lam, ll) AS lam, any_value(step) AS step FROM (
                        SELECT lam, any_value(step) AS step, -count(*) / 2.0::DOUBLE * ln(nullif(greatest(var_pop({power('x', 'lam')}), 1e-20), 1e-20))
                          + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS ll
                        FROM (SELECT {col} AS x FROM {source} WHERE {col} IS NOT NULL)
                        CROSS JOIN (SELECT lo + (hi - lo) * i / 8.0::DOUBLE AS lam, (hi - lo) / 8.0::DOUBLE AS step FROM {out}_{k - 1}, range(0, 9) r(i))
                        GROUP BY lam))""",
            )
        )
    return [*ctes, (out, f"SELECT (lo + hi) / 2 AS lam FROM {out}_{levels}")]


def vectors(spec: Spec, source: str = "tr", rows: str = "test", p: str = "l_", out: str = "lx") -> Ctes:
    """``out``: (part, row_id, y, protected, x): features of the training and the other rows behind a leading 1, fitted on ``source``.

    Categories are numbered over the whole view ``v``."""
    med = ", ".join(f"median({c}) AS d_{c}" for c in spec.num)
    filled = ", ".join(f"coalesce({c}, d_{c}) AS {c}" for c in spec.num)
    code = "".join(f", CAST(coalesce(k{i}.code, -1) AS DOUBLE) AS {c}" for i, c in enumerate(spec.cat))
    look_up = " ".join(f"LEFT JOIN {p}k{i} k{i} ON k{i}.k = r.{c}" for i, c in enumerate(spec.cat))
    ctes = [(f"{p}med", f"SELECT {med} FROM {source}")]
    ctes += [(f"{p}k{i}", S.codes("v", c)) for i, c in enumerate(spec.cat)]
    ctes.append(
        (
            f"{p}f",
            " UNION ALL ".join(f"SELECT '{part}' AS part, row_id, y, protected, {filled}{code} FROM {table} r CROSS JOIN {p}med {look_up}"
                               for part, table in (("train", source), ("other", rows))),
        )
    )
    for c in spec.num:
        ctes += best_power(f"(SELECT * FROM {p}f WHERE part = 'train')", c, f"{p}lam_{c}")
    powers = "".join(f", {power(c, f'{p}lam_{c}.lam')} AS p_{c}" for c in spec.num)
    ctes.append((f"{p}p", f"SELECT {p}f.*{powers} FROM {p}f" + "".join(f", {p}lam_{c}" for c in spec.num)))
    stat = ", ".join(f"avg(p_{c}) AS m_{c}, stddev_pop(p_{c}) AS s_{c}" for c in spec.num)
    ctes.append((f"{p}st", f"SELECT {stat} FROM {p}p WHERE part = 'train'"))
    z = "".join(f", (p_{c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END" for c in spec.num) + "".join(f", {c}" for c in spec.cat)
    return [*ctes, (out, f"SELECT part, row_id, y, protected, [1.0::DOUBLE{z}] AS x FROM {p}p, {p}st")]


def newton(source: str, d: int, out: str = "fit", steps: int = 12) -> Ctes:
    """``out``: (gid, b): coefficients over x (d numbers, the first being 1) for the rows (gid, x, y) of each gid."""
    ctes = [(f"{out}_0", f"SELECT DISTINCT gid, [{', '.join(['0.0::DOUBLE'] * d)}] AS b FROM {source}")]
    h = lambda i, j: f"sum(w * x[{i}] * x[{j}])" + (" + 1" if i == j and i > 1 else "")
    g = lambda i: f"-(sum(e * x[{i}])" + (f" + any_value(b[{i}])" if i > 1 else "") + ")"
    matrix = ", ".join("[" + ", ".join([*(h(i, j) for j in range(1, d + 1)), g(i)]) + "]" for i in range(1, d + 1))
    for t in range(1, steps + 1):
        m = f"{out}_m{t}"
        ctes.append(
            (
                f"{m}_0",
                f"""SELECT gid, [{matrix}] AS m FROM (
                      SELECT gid, x, b, p * (1 - p) AS w, p - y AS e FROM (
                        SELECT r.gid, r.x, r.y, c.b, 1.0::DOUBLE / (1.0::DOUBLE + exp(-list_dot_product(r.x, c.b))) AS p
                        FROM {source} r JOIN {out}_{t - 1} c ON c.gid = r.gid)) GROUP BY gid""",
            )
        )
        for k in range(1, d + 1):
            ctes.append(
                (
                    f"{m}_{k}",
                    f"""SELECT gid, list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(m[{k}], lambda v: v / m[{k}][{k}])
                          ELSE list_transform(r, lambda v, j: v - r[{k}] / m[{k}][{k}] * m[{k}][j]) END) AS m FROM {m}_{k - 1}""",
                )
            )
        ctes.append((f"{out}_{t}", f"SELECT c.gid, list_transform(c.b, lambda v, i: v + m.m[i][{d + 1}]) AS b FROM {out}_{t - 1} c JOIN {m}_{d} m ON m.gid = c.gid"))
    return [*ctes, (out, f"SELECT * FROM {out}_{steps}")]


def predictions(spec: Spec, name: str) -> str:
    """Test rows of a view's split with the probability and the label of a model fitted on its training rows."""
    d = 1 + len(spec.features)
    ctes = S.split(name) + [(p, f"SELECT * FROM sp WHERE split = '{s}'") for p, s in (("tr", "train"), ("test", "test"))]
    ctes += vectors(spec) + [("rows_", "SELECT 0 AS gid, x, y FROM lx WHERE part = 'train'")] + newton("rows_", d)
    return materialized(
        ctes,
        """SELECT row_id, y, protected, round(p1, 3) AS p1, CAST(p1 > 0.5 AS INT) AS pred FROM (
             SELECT row_id, y, protected, 1.0::DOUBLE / (1.0::DOUBLE + exp(-list_dot_product(x, b))) AS p1 FROM lx, fit WHERE part = 'other')""",
    )


def out_of_fold(spec: Spec, name: str) -> str:
    """Every row of a view, scored by the model of the other folds."""
    ctes = S.view(name) + [
        ("ff", f"SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY {S.hkey('fold:0')}, row_id) - 1) % 5 AS INT) AS fold FROM v")
    ]
    for k in range(5):
        ctes += [(f"tr{k}", f"SELECT * FROM ff WHERE fold <> {k}"), (f"te{k}", f"SELECT * FROM ff WHERE fold = {k}")]
        ctes += vectors(spec, f"tr{k}", f"te{k}", f"f{k}_", f"fx{k}")
    ctes.append(("fx", " UNION ALL ".join(f"SELECT {k} AS gid, * FROM fx{k}" for k in range(5))))
    ctes += [("rows_", "SELECT gid, x, y FROM fx WHERE part = 'train'")] + newton("rows_", 1 + len(spec.features))
    return materialized(
        ctes,
        """SELECT row_id, y, fx.gid AS fold, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-list_dot_product(x, b))), 3) AS p1
           FROM fx JOIN fit ON fit.gid = fx.gid WHERE part = 'other'""",
    )


def curve(name: str, spec: Spec, kind: str, methods: tuple[str, ...]) -> str:
    """A fit of its own for every grid point of rankings that need no model; repairs change labels."""
    action, points, _ = S.ACTIONS[kind]
    y = {"restore": "CASE WHEN sel THEN s.y_clean ELSE s.y END", "flip": "CASE WHEN sel THEN 1 - s.y ELSE s.y END"}[action]
    keep = {"ser", "gid", "sel"}
    ctes = S.corrupted(name, spec, kind) + S.rankings(spec, methods, 0) + [c for c in S.curve(spec, action, methods, points) if c[0] in keep]
    ctes += vectors(spec) + [
        ("rows_", f"SELECT concat_ws(':', method, s.seed, g) AS gid, x, {y} AS y FROM sel s JOIN lx ON lx.row_id = s.row_id WHERE part = 'train'"),
        ("kinds", "SELECT gid, min(y) < max(y) AS ok FROM rows_ GROUP BY gid"),
        ("usable", "SELECT r.* FROM rows_ r JOIN kinds k ON k.gid = r.gid WHERE ok"),
    ] + newton("usable", 1 + len(spec.features)) + [
        ("scr", "SELECT gid, y, protected, CAST(list_dot_product(x, b) > 0 AS INT) AS pred FROM lx, fit WHERE part = 'other'"),
        ("met", """SELECT gid, avg(CAST(pred = y AS DOUBLE)) AS accuracy,
                     coalesce(abs(avg(pred) FILTER (protected) - avg(pred) FILTER (NOT protected)), 0) AS dp_gap FROM scr GROUP BY gid"""),
    ]
    return materialized(
        ctes,
        """SELECT method, seed, round(proportion, 2) AS proportion, n_cleaned, round(accuracy, 9) AS accuracy, round(dp_gap, 9) AS dp_gap
           FROM gid LEFT JOIN met ON met.gid = concat_ws(':', method, seed, g)""",
    )
