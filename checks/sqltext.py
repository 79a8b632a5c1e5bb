"""SQL text for the comparison engine, built from common table expressions.

The statements state each operator the direct way (row numbers, self-joins,
full recounts at every point), not the way the library computes it.
"""

from __future__ import annotations

from rowmend.core import Spec

from . import views


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes)
    return f"WITH {body}\n{final.strip()}"


def hkey(salt: str, row: str = "row_id") -> str:
    return f"md5(concat_ws(':', '{salt}', CAST({row} AS VARCHAR)))"


def unif(salt: str, row: str = "row_id") -> str:
    return f"(('0x' || substr({hkey(salt, row)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


VIEW_SQL = {
    "docs": views.DOCS_SQL,
    "orders": views.ORDERS_SQL,
    "lines": views.LINES_SQL,
    "events": views.EVENTS_SQL,
    "vectors": views.VECTORS_SQL,
}


def view(name: str) -> list[tuple[str, str]]:
    return [("v", VIEW_SQL[name])]


def split(name: str, cap: int | None = None) -> list[tuple[str, str]]:
    return view(name) + [
        ("v_n", "SELECT count(*) AS n, ceil(0.2::DOUBLE * count(*)) AS n_test FROM v"),
        ("v_o", f"SELECT *, row_number() OVER (ORDER BY {hkey('split:0')}, row_id) AS r FROM v"),
        (
            "v_s",
            """SELECT v_o.*, CASE WHEN r <= n_test THEN 'test'
               WHEN r <= n_test + ceil(0.125::DOUBLE * (n - n_test)) THEN 'val' ELSE 'train' END AS s0
               FROM v_o, v_n""",
        ),
        (
            "v_c",
            f"SELECT *, row_number() OVER (PARTITION BY s0 ORDER BY {hkey('valcap:0')}, row_id) AS cr FROM v_s",
        ),
        (
            "sp",
            f"""SELECT * EXCLUDE (r, s0, cr), CASE WHEN s0 = 'val' AND {f"cr > {cap}" if cap else "FALSE"} THEN 'unused' ELSE s0 END AS split
               FROM v_c""",
        ),
    ]


def sampled(source: str, level: float, where: str = "TRUE", seed: int = 42) -> list[tuple[str, str]]:
    """``picked``: the exact sample of ``source`` rows."""
    return [
        ("pool", f"SELECT row_id FROM {source} WHERE {where}"),
        (
            "picked",
            f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {hkey(f'noise:{seed}')}, row_id) AS r
                FROM pool) WHERE r <= floor({level}::DOUBLE * (SELECT count(*) FROM pool))""",
        ),
    ]


def noisy(source: str, spec: Spec, kind: str, level: float = 0.2, stats: str | None = None,
          seed: int = 42) -> list[tuple[str, str]]:
    """``noise_all``: every source row with clean and corrupted columns."""
    col = spec.outlier
    where = "protected" if kind.startswith("group") else "TRUE"
    others = ", ".join(c for c in spec.features if c != col)
    others = f", {others}" if others else ""
    tail = ", split" if source == "sp" else ""
    flag = "row_id IN (SELECT row_id FROM picked)"
    ctes = sampled(source, level, where, seed)
    if kind == "outlier":
        ctes.append(("st", f"SELECT avg({col}) AS m, stddev_pop({col}) AS s FROM {stats or source}"))
        k = f"(3.0::DOUBLE + {unif(f'level:{seed}')} * 2.0::DOUBLE)"
        x = f"CASE WHEN {flag} THEN (SELECT m FROM st) + {k} * (SELECT s FROM st) ELSE {col} END"
        y = "y"
    elif kind == "group_missing":
        x, y = f"CASE WHEN {flag} THEN NULL ELSE {col} END", "y"
    elif kind == "no_noise":
        flag, x, y = "TRUE", col, "y"
    else:
        x, y = col, f"CASE WHEN {flag} THEN 1 - y ELSE y END"
    ctes.append(
        (
            "noise_all",
            f"""SELECT row_id, protected, {flag} AS is_noisy, y AS y_clean, {y} AS y,
                {col} AS {col}_clean, {x} AS {col}{others}{tail} FROM {source}""",
        )
    )
    return ctes


def corrupted(name: str, spec: Spec, kind: str, level: float = 0.2) -> list[tuple[str, str]]:
    """``sp`` and ``tr`` (corrupted train rows), ``val``, ``test``, ``cap``."""
    ctes = split(name)
    base = "outlier" if kind == "outlier_removal" else kind
    if base == "outlier":
        ctes.append(("pool_src", "SELECT * FROM sp WHERE split <> 'unused'"))
        ctes.append(("train_src", "SELECT * FROM sp WHERE split = 'train'"))
        more = noisy("pool_src", spec, base, level, stats="train_src")
        # the pooled frame keeps its split
        more[-1] = ("noise_all", more[-1][1].replace(" FROM pool_src", ", split FROM pool_src"))
        ctes += more
        ctes.append(("tr", "SELECT * EXCLUDE (split) FROM noise_all WHERE split = 'train'"))
    else:
        ctes.append(("train_src", "SELECT * FROM sp WHERE split = 'train'"))
        ctes += noisy("train_src", spec, base, level)
        ctes.append(("tr", "SELECT * FROM noise_all"))
    col = spec.outlier
    ctes += [
        ("val", "SELECT * FROM sp WHERE split = 'val'"),
        ("test", "SELECT * FROM sp WHERE split = 'test'"),
        ("cap", f"SELECT avg({col}) + 2 * stddev_pop({col}) AS cap FROM train_src"),
    ]
    return ctes


# ------------------------------------------------------------------ scorer


def bin_of(spec: Spec, col: str, x: str | None = None) -> str:
    x = x or col
    if col in spec.num:
        z = f"greatest(0, least(7, CAST(floor(({x} - m_{col}) / s_{col} * 2.0) AS BIGINT) + 4))"
        return (
            f"CASE WHEN {x} IS NULL THEN '-1' WHEN s_{col} IS NULL OR s_{col} = 0 THEN '4' "
            f"ELSE CAST({z} AS VARCHAR) END"
        )
    return f"coalesce(CAST({x} AS VARCHAR), '?')"


def bins(spec: Spec) -> str:
    return ", ".join(f"{bin_of(spec, c)} AS b{i}" for i, c in enumerate(spec.features))


def bin_stats(spec: Spec, source: str = "tr") -> tuple[str, str]:
    cols = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in spec.num)
    return ("bst", f"SELECT {cols} FROM {source}")


def unpivot(source: str, spec: Spec, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, {i} AS f, b{i} AS v FROM {source}" for i in range(len(spec.features))
    )


def predictions(spec: Spec, source: str = "tr", rows: str = "val", out: str = "pred") -> list[tuple[str, str]]:
    """``out``: (row_id, p1, pred) of a scorer fitted on ``source``."""
    p = out
    return [
        (f"{p}_b", f"SELECT row_id, y, {bins(spec)} FROM {source}, bst"),
        (f"{p}_l", unpivot(f"{p}_b", spec, "row_id, y")),
        (f"{p}_c", f"SELECT f, v, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM {p}_l GROUP BY f, v"),
        (f"{p}_d", f"SELECT f, count(DISTINCT v)::DOUBLE AS nv FROM {p}_c GROUP BY f"),
        (f"{p}_n", f"SELECT count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y = 1)::DOUBLE AS n1 FROM {source}"),
        (f"{p}_rb", f"SELECT row_id, {bins(spec)} FROM {rows}, bst"),
        (f"{p}_rl", unpivot(f"{p}_rb", spec, "row_id")),
        (
            f"{p}_lo",
            f"""SELECT l.row_id, sum(ln((coalesce(c1, 0) + 1.0::DOUBLE) / (n1 + nv))
                  - ln((coalesce(c0, 0) + 1.0::DOUBLE) / (n0 + nv))) + any_value(ln((n1 + 1.0::DOUBLE) / (n0 + 1.0::DOUBLE))) AS lo
                FROM {p}_rl l JOIN {p}_d d ON d.f = l.f CROSS JOIN {p}_n
                LEFT JOIN {p}_c c ON c.f = l.f AND c.v = l.v GROUP BY l.row_id""",
        ),
        (p, f"SELECT row_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-lo)) AS p1, CAST(round(lo, 9) > 0 AS INT) AS pred FROM {p}_lo"),
    ]


def oof(spec: Spec, source: str = "tr") -> list[tuple[str, str]]:
    """``oof``: (row_id, y, fold, p1)."""
    return [
        ("o_b", f"SELECT row_id, y, {bins(spec)} FROM {source}, bst"),
        (
            "o_f",
            f"""SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY {hkey('fold:0')}, row_id) - 1) % 5 AS INT) AS fold
                FROM o_b""",
        ),
        ("o_l", unpivot("o_f", spec, "row_id, y, fold")),
        ("o_t", "SELECT f, v, count(*) FILTER (y = 0) AS t0, count(*) FILTER (y = 1) AS t1 FROM o_l GROUP BY f, v"),
        ("o_own", "SELECT fold, f, v, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM o_l GROUP BY fold, f, v"),
        ("o_d", "SELECT f, count(*)::DOUBLE AS nv FROM o_t GROUP BY f"),
        (
            "o_n",
            """SELECT fold, (SELECT count(*) FROM o_f WHERE y = 0 AND fold <> a.fold)::DOUBLE AS n0,
                      (SELECT count(*) FROM o_f WHERE y = 1 AND fold <> a.fold)::DOUBLE AS n1
               FROM (SELECT DISTINCT fold FROM o_f) a""",
        ),
        (
            "o_lo",
            """SELECT l.row_id, any_value(l.y) AS y, any_value(l.fold) AS fold,
                 sum(ln((t1 - c1 + 1.0::DOUBLE) / (n1 + nv)) - ln((t0 - c0 + 1.0::DOUBLE) / (n0 + nv)))
                 + any_value(ln((n1 + 1.0::DOUBLE) / (n0 + 1.0::DOUBLE))) AS lo
               FROM o_l l JOIN o_t t ON t.f = l.f AND t.v = l.v JOIN o_own w ON w.fold = l.fold AND w.f = l.f AND w.v = l.v
               JOIN o_d d ON d.f = l.f JOIN o_n n ON n.fold = l.fold GROUP BY l.row_id""",
        ),
        ("oof", "SELECT row_id, y, fold, 1.0::DOUBLE / (1.0::DOUBLE + exp(-lo)) AS p1 FROM o_lo"),
    ]


# ---------------------------------------------------------------- rankings


def space(spec: Spec, source: str = "tr") -> list[tuple[str, str]]:
    """``t_sp`` and ``v_sp``: median-imputed, standardised numbers, and category codes."""
    med = ", ".join(f"median({c}) AS d_{c}" for c in spec.num)
    filled = ", ".join(f"coalesce({c}, d_{c}) AS {c}" for c in spec.num)
    stat = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in spec.num)
    z = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS z{i}" for i, c in enumerate(spec.num))
    filled += "".join(f", {c}" for c in spec.cat)
    z += "".join(f", CAST(coalesce(k{i}.code, -1) AS DOUBLE) AS z{len(spec.num) + i}" for i in range(len(spec.cat)))
    look_up = " ".join(f"LEFT JOIN x_k{i} k{i} ON k{i}.k = x.{c}" for i, c in enumerate(spec.cat))
    return [
        ("x_med", f"SELECT {med} FROM {source}"),
        *[(f"x_k{i}", codes(source, c)) for i, c in enumerate(spec.cat)],
        ("x_t", f"SELECT row_id, y, {filled} FROM {source}, x_med"),
        ("x_v", f"SELECT row_id, y, protected, {filled} FROM val, x_med"),
        ("x_st", f"SELECT {stat} FROM x_t"),
        ("t_sp", f"SELECT row_id, y, {z} FROM x_t x CROSS JOIN x_st {look_up}"),
        ("v_sp", f"SELECT row_id AS vid, y AS vy, protected AS vp, {z} FROM x_v x CROSS JOIN x_st {look_up}"),
    ]


def codes(source: str, col: str) -> str:
    """(k, code): categories numbered by first appearance."""
    return f"SELECT {col} AS k, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM {source} WHERE {col} IS NOT NULL GROUP BY {col}"


def distance(n: int) -> str:
    return " + ".join(f"(t.z{i} - w.z{i}) * (t.z{i} - w.z{i})" for i in range(n))


def pairs(n_dims: int, steps: int, d2: str | None = None, name: str = "prs") -> list[tuple[str, str]]:
    d2 = d2 or distance(n_dims)
    return [
        (
            name,
            f"""SELECT vid, row_id, y, CASE WHEN d2 = 0 THEN -1152921504606846976
                  ELSE CAST(floor(log2(d2) * {steps}) AS BIGINT) END AS step
                FROM (SELECT w.vid, t.row_id, t.y, {d2} AS d2 FROM t_sp t, v_sp w)""",
        )
    ]


def shapley_values(util: str, prs: str = "prs", out: str = "shap", k: int = 1) -> list[tuple[str, str]]:
    """``out``: (row_id, score).  ``util`` is the utility of label ``y`` for
    validation row ``vid`` (table alias ``u``: vid, u0, u1)."""
    p = out
    return [
        (f"{p}_u", util),
        (f"{p}_h", f"SELECT i, sum(1.0::DOUBLE / i) OVER (ORDER BY i) AS h FROM range(1, (SELECT count(*) FROM t_sp) + 1) r(i)"),
        (
            f"{p}_c",
            f"""SELECT c.vid, step, n0, n1, n0 + n1 AS m, u0, u1, n0 * u0 + n1 * u1 AS tot,
                  sum(n0 + n1) OVER (PARTITION BY c.vid ORDER BY step) AS b
                FROM (SELECT vid, step, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1
                      FROM {prs} GROUP BY vid, step) c JOIN {p}_u u ON u.vid = c.vid""",
        ),
        (
            # sums over the ranks a..b of a cell: share c(j), drop w(j), (j - a) w(j)
            f"{p}_k",
            f"""SELECT c.*, b - m + 1 AS a,
                  CASE WHEN b > {k} THEN 1.0::DOUBLE / (greatest(b - m + 1, {k} + 1) - 1) - 1.0::DOUBLE / b ELSE 0 END AS w,
                  least(b, {k}) - least(b - m, {k}) AS near
                FROM {p}_c c""",
        ),
        (
            f"{p}_v",
            f"""SELECT vid, step, u0, u1, tot, m,
                  (near / {k}.0::DOUBLE + CASE WHEN b > {k} THEN hb.h - coalesce(ha.h, 0) ELSE 0 END) / m AS c,
                  CASE WHEN m > 1 AND b > {k} THEN (coalesce(hb1.h, 0) - coalesce(ha1.h, 0) - a * w) / (m * (m - 1.0::DOUBLE)) ELSE 0 END AS win,
                  coalesce(sum(tot / m * w) OVER (PARTITION BY vid ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS aft
                FROM {p}_k
                LEFT JOIN {p}_h hb ON hb.i = b
                LEFT JOIN {p}_h ha ON ha.i = greatest(a - 1, {k})
                LEFT JOIN {p}_h hb1 ON hb1.i = b - 1
                LEFT JOIN {p}_h ha1 ON ha1.i = greatest(a, {k} + 1) - 2""",
        ),
        (
            p,
            f"""SELECT p.row_id, sum(CASE WHEN p.y = 1 THEN u1 * c - (tot - u1) * win - aft
                  ELSE u0 * c - (tot - u0) * win - aft END) / (SELECT count(*) FROM {p}_u) AS score
                FROM {prs} p JOIN {p}_v v ON v.vid = p.vid AND v.step = p.step GROUP BY p.row_id""",
        ),
    ]


ACC_UTIL = "SELECT vid, CAST(vy = 0 AS DOUBLE) AS u0, CAST(vy = 1 AS DOUBLE) AS u1 FROM v_sp"


def parity_util(pred: str = "pred") -> str:
    return f"""SELECT vid, 0.0::DOUBLE AS u0,
        CASE WHEN n_p = 0 OR n_u = 0 OR rp = ru THEN 0.0::DOUBLE
             WHEN vp = (rp > ru) THEN -1.0::DOUBLE / CASE WHEN vp THEN n_p ELSE n_u END
             ELSE 1.0::DOUBLE / CASE WHEN vp THEN n_p ELSE n_u END END AS u1
      FROM v_sp, (SELECT count(*) FILTER (vp) AS n_p, count(*) FILTER (NOT vp) AS n_u,
                  avg(pred) FILTER (vp) AS rp, avg(pred) FILTER (NOT vp) AS ru
                  FROM v_sp JOIN {pred} ON row_id = vid)"""


def ranked(source: str, score: str, out: str, desc: bool = False, where: str = "TRUE") -> tuple[str, str]:
    order = f"{score} DESC" if desc else score
    return (
        out,
        f"""SELECT row_id, {score} AS score, row_number() OVER (ORDER BY {order}, row_id) AS rank,
              count(*) OVER () AS n_ranked FROM {source} WHERE {where}""",
    )


NOISY_IDS = "row_id IN (SELECT row_id FROM tr WHERE is_noisy)"


def heuristic(source: str = "tr") -> list[tuple[str, str]]:
    return [
        (
            "g4",
            f"""SELECT count(*) FILTER (protected) AS np, count(*) FILTER (NOT protected) AS nu,
                  coalesce(sum(y) FILTER (protected), 0) AS pp, coalesce(sum(y) FILTER (NOT protected), 0) AS pu FROM {source}""",
        ),
        (
            "heur",
            f"""SELECT row_id, round(abs(rp - ru) - CASE WHEN protected
                    THEN abs(CASE WHEN np > 1 THEN (pp - y) / (np - 1.0::DOUBLE) ELSE 0 END - ru)
                    ELSE abs(rp - CASE WHEN nu > 1 THEN (pu - y) / (nu - 1.0::DOUBLE) ELSE 0 END) END, 12) AS score
                FROM {source}, (SELECT *, CASE WHEN np > 0 THEN pp / np::DOUBLE ELSE 0 END AS rp,
                                CASE WHEN nu > 0 THEN pu / nu::DOUBLE ELSE 0 END AS ru FROM g4)""",
        ),
    ]


def issues() -> list[tuple[str, str]]:
    """``joint`` and ``iss`` (row_id, score) from ``oof``."""
    return [
        ("th", "SELECT avg(1 - p1) FILTER (y = 0) AS t0, avg(p1) FILTER (y = 1) AS t1 FROM oof"),
        ("cf", "SELECT *, round(CASE WHEN y = 1 THEN p1 ELSE 1.0::DOUBLE - p1 END, 9) AS conf FROM oof"),
        (
            "sug",
            """SELECT cf.*, CASE WHEN ok0 AND ok1 THEN CAST(round(p1, 9) > round(1.0::DOUBLE - p1, 9) AS INT)
                 WHEN ok1 THEN 1 WHEN ok0 THEN 0 END AS s
               FROM (SELECT cf.*, coalesce(round(1.0::DOUBLE - p1, 9) >= round(t0, 9), FALSE) AS ok0,
                            coalesce(round(p1, 9) >= round(t1, 9), FALSE) AS ok1 FROM cf, th) cf""",
        ),
        ("joint", "SELECT y AS given, s AS suggested, count(*) AS n FROM sug WHERE s IS NOT NULL GROUP BY y, s"),
        (
            "quota",
            """SELECT y, floor(count(*) FILTER (s = 1 - y) * count(*)::DOUBLE / nullif(count(*) FILTER (s IS NOT NULL), 0) + 0.5) AS q
               FROM sug GROUP BY y""",
        ),
        (
            "iss",
            """SELECT row_id, conf AS score FROM (
                 SELECT cf.*, row_number() OVER (PARTITION BY y ORDER BY conf, row_id) AS r FROM cf) c
               JOIN quota q ON q.y = c.y WHERE r <= coalesce(q, 0) AND conf < 0.5""",
        ),
    ]


ENTROPY = ("ent", """SELECT row_id, round(-((1.0::DOUBLE - p1) * log2((1.0::DOUBLE - p1) + 1e-9::DOUBLE)
                      + p1 * log2(p1 + 1e-9::DOUBLE)), 9) AS score FROM oof""")


def rankings(spec: Spec, methods: tuple[str, ...], steps: int) -> list[tuple[str, str]]:
    """``rnk``: (method, seed, row_id, score, rank, n_ranked) of ``tr``."""
    ctes = [bin_stats(spec)]
    parts = []
    if {"shapley", "fair_shapley"} & set(methods):
        ctes += space(spec) + pairs(len(spec.features), steps)
    if "shapley" in methods:
        ctes += shapley_values(ACC_UTIL, out="shap")
        ctes.append(("shap12", "SELECT row_id, round(score, 12) AS score FROM shap"))
        ctes.append(ranked("shap12", "score", "r_shap", where=NOISY_IDS))
        parts.append("SELECT 'shapley' AS method, -1 AS seed, * FROM r_shap")
    if "fair_shapley" in methods:
        ctes += predictions(spec)
        ctes += shapley_values(parity_util(), out="fshap")
        ctes.append(("fshap12", "SELECT row_id, round(score, 12) AS score FROM fshap"))
        ctes.append(ranked("fshap12", "score", "r_fshap", where=NOISY_IDS))
        parts.append("SELECT 'fair_shapley', -1, * FROM r_fshap")
    if "fair_heuristic" in methods:
        ctes += heuristic() + [ranked("heur", "score", "r_heur", True, NOISY_IDS)]
        parts.append("SELECT 'fair_heuristic', -1, * FROM r_heur")
    if {"confident", "entropy"} & set(methods):
        ctes += oof(spec)
    if "confident" in methods:
        ctes += issues() + [ranked("iss", "score", "r_iss")]
        parts.append("SELECT 'confident', -1, * FROM r_iss")
    if "entropy" in methods:
        ctes += [ENTROPY, ranked("ent", "score", "r_ent", True)]
        parts.append("SELECT 'entropy', -1, * FROM r_ent")
    if "random" in methods:
        for seed in (100, 101, 102):
            parts.append(
                f"""SELECT 'random', {seed}, row_id, NULL::DOUBLE AS score,
                    row_number() OVER (ORDER BY {hkey(f'shuffle:{seed}')}, row_id) AS rank, count(*) OVER () AS n_ranked
                    FROM tr WHERE is_noisy"""
            )
    ctes.append(("rnk(method, seed, row_id, score, rank, n_ranked)", " UNION ALL ".join(f"({p})" for p in parts)))
    return ctes


# ------------------------------------------------------------------ curves


def curve(spec: Spec, action: str, methods: tuple[str, ...], n_points: int = 21,
          entropy_cap: float = 1.0) -> list[tuple[str, str]]:
    """``crv``: a full recount of the scorer at every point of every ranking."""
    series = [(m, s) for m in methods for s in ((100, 101, 102) if m == "random" else (-1,))]
    rows = ", ".join(f"('{m}', {s})" for m, s in series)
    col = spec.outlier
    x = {"cap": f"CASE WHEN sel THEN (SELECT cap FROM cap) ELSE {col} END"}.get(action, col)
    y = {"restore": "CASE WHEN sel THEN y_clean ELSE y END", "flip": "CASE WHEN sel THEN 1 - y ELSE y END"}.get(action, "y")
    keep = "NOT sel" if action == "remove" else "TRUE"
    feats = ", ".join((f"{x} AS {c}" if c == col else c) for c in spec.features)
    return [
        ("ser", f"SELECT * FROM (VALUES {rows}) t(method, seed)"),
        (
            "gid",
            f"""SELECT ser.method, ser.seed, g, g * 0.05::DOUBLE AS proportion,
                  coalesce(CAST(floor(least(g * 0.05::DOUBLE, CASE WHEN ser.method = 'entropy' THEN {entropy_cap}::DOUBLE ELSE 1.0::DOUBLE END) * nr) AS BIGINT), 0) AS n_cleaned
                FROM ser CROSS JOIN range(0, {n_points}) r(g)
                LEFT JOIN (SELECT method, seed, max(n_ranked) AS nr FROM rnk GROUP BY method, seed) k
                  ON k.method = ser.method AND k.seed = ser.seed""",
        ),
        (
            "sel",
            """SELECT gid.method, gid.seed, g, t.*, coalesce(r.rank <= n_cleaned, FALSE) AS sel
               FROM gid CROSS JOIN tr t LEFT JOIN rnk r ON r.method = gid.method AND r.seed = gid.seed AND r.row_id = t.row_id""",
        ),
        ("rep", f"SELECT method, seed, g, row_id, {y} AS y, {feats} FROM sel WHERE {keep}"),
        ("rep_b", f"SELECT method, seed, g, y, {bins(spec)} FROM rep, bst"),
        ("rep_l", unpivot("rep_b", spec, "method, seed, g, y")),
        ("rep_c", "SELECT method, seed, g, f, v, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM rep_l GROUP BY ALL"),
        ("rep_n", "SELECT method, seed, g, count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y = 1)::DOUBLE AS n1 FROM rep_b GROUP BY ALL"),
        ("base_b", f"SELECT {bins(spec)} FROM tr, bst"),
        (
            "dom",
            f"""SELECT f, count(DISTINCT v)::DOUBLE AS nv FROM (
                  SELECT f, v FROM rep_c UNION ALL {unpivot('base_b', spec, '1 AS one').replace('SELECT 1 AS one, ', 'SELECT ')}) GROUP BY f""",
        ),
        ("tst_b", f"SELECT row_id, y, protected, {bins(spec)} FROM test, bst"),
        ("tst_l", unpivot("tst_b", spec, "row_id, y, protected")),
        (
            "scr",
            """SELECT gid.method, gid.seed, gid.g, l.row_id, any_value(l.y) AS y, any_value(l.protected) AS protected,
                 any_value(coalesce(n0, 0)) AS n0, any_value(coalesce(n1, 0)) AS n1,
                 CAST(round(sum(ln((coalesce(c1, 0) + 1.0::DOUBLE) / (coalesce(n1, 0) + nv)) - ln((coalesce(c0, 0) + 1.0::DOUBLE) / (coalesce(n0, 0) + nv)))
                   + any_value(ln((coalesce(n1, 0) + 1.0::DOUBLE) / (coalesce(n0, 0) + 1.0::DOUBLE))), 9) > 0 AS INT) AS pred
               FROM gid CROSS JOIN tst_l l JOIN dom ON dom.f = l.f
               LEFT JOIN rep_n n ON n.method = gid.method AND n.seed = gid.seed AND n.g = gid.g
               LEFT JOIN rep_c c ON c.method = gid.method AND c.seed = gid.seed AND c.g = gid.g AND c.f = l.f AND c.v = l.v
               GROUP BY gid.method, gid.seed, gid.g, l.row_id""",
        ),
        (
            "met",
            """SELECT method, seed, g,
                 CASE WHEN min(n0) > 0 AND min(n1) > 0 THEN avg(CAST(pred = y AS DOUBLE)) END AS accuracy,
                 CASE WHEN min(n0) > 0 AND min(n1) > 0 THEN coalesce(abs(avg(pred) FILTER (protected) - avg(pred) FILTER (NOT protected)), 0) END AS dp_gap
               FROM scr GROUP BY method, seed, g""",
        ),
        (
            "crv",
            """SELECT gid.method, gid.seed, proportion, n_cleaned, accuracy, dp_gap
               FROM gid JOIN met ON met.method = gid.method AND met.seed = gid.seed AND met.g = gid.g""",
        ),
    ]


ACTIONS = {
    "outlier": ("cap", 21, 1.0),
    "random_label": ("restore", 21, 1.0),
    "group_label": ("restore", 21, 1.0),
    "group_missing": ("remove", 21, 0.95),
    "no_noise": ("flip", 11, 1.0),
    "outlier_removal": ("remove", 21, 1.0),
}
ALL = ("shapley", "fair_shapley", "fair_heuristic", "confident", "entropy", "random")


def experiment(name: str, spec: Spec, kind: str, steps: int, methods=None) -> list[tuple[str, str]]:
    action, points, top = ACTIONS[kind]
    methods = methods or (("shapley",) if kind == "outlier_removal" else ALL)
    return corrupted(name, spec, kind) + rankings(spec, methods, steps) + curve(spec, action, methods, points, top)
