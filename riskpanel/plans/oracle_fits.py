"""SQL of the fitted models: preparation in long form, Newton steps, and small systems solved by elimination.

Everything is written for a table of (customer_id, split, y, feature, x) rows in
which zeros are left out, so the same statements serve every feature list.
"""

from __future__ import annotations

from riskpanel.definitions import BEHAVIORAL_NUMERIC, STATIC_CATEGORICAL, STATIC_NUMERIC

STEPS = 9
NUMERIC = (*STATIC_NUMERIC, *BEHAVIORAL_NUMERIC)
FEATURES = {
    "static": (STATIC_NUMERIC, STATIC_CATEGORICAL),
    "behavioral": (BEHAVIORAL_NUMERIC, ()),
    "combined": (NUMERIC, STATIC_CATEGORICAL),
}
#: Name of the intercept, which bears no penalty.
FREE = "(intercept)"


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def preparation() -> dict[str, str]:
    """Blocks up to ``fit_long``: every prepared feature of every row, medians and moments from train rows."""
    own = "customer_id, split, next_month_default::DOUBLE AS y"
    return {
        "fit_rows": "SELECT e.*, ln(1 + credit_limit_ntd::DOUBLE) AS log_credit_limit, s.split FROM extract e JOIN split s ON s.customer_id = e.customer_id",
        "fit_values": _union([f"SELECT {own}, '{f}' AS feature, {f}::DOUBLE AS v FROM fit_rows" for f in NUMERIC]),
        "fit_medians": "SELECT feature, median(v) AS m, count(*) > count(v) AS lacks FROM fit_values WHERE split = 'train' GROUP BY feature",
        "fit_filled": "SELECT customer_id, split, y, f.feature, coalesce(v, m) AS v FROM fit_values f JOIN fit_medians d ON d.feature = f.feature "
        "UNION ALL SELECT customer_id, split, y, 'missing_' || f.feature, CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE "
        "FROM fit_values f JOIN fit_medians d ON d.feature = f.feature WHERE lacks",
        "fit_moments": "SELECT feature, avg(v) AS mean, stddev_pop(v) AS sd FROM fit_filled WHERE split = 'train' GROUP BY feature",
        "fit_codes": _union([f"SELECT {own}, '{f}_' || {f}::VARCHAR AS feature FROM fit_rows" for f in STATIC_CATEGORICAL]),
        "fit_levels": "SELECT DISTINCT feature FROM fit_codes WHERE split = 'train'",
        "fit_long": "SELECT customer_id, split, y, f.feature, (v - mean) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS x "
        "FROM fit_filled f JOIN fit_moments m ON m.feature = f.feature "
        "UNION ALL SELECT customer_id, split, y, c.feature, 1.0::DOUBLE FROM fit_codes c JOIN fit_levels l ON l.feature = c.feature",
    }


def _is_of(model: str) -> str:
    numeric, codes = FEATURES[model]
    names = ", ".join(f"'{f}', 'missing_{f}'" for f in numeric)
    return " OR ".join([f"feature IN ({names})", *[f"feature LIKE '{f}\\_%' ESCAPE '\\'" for f in codes]])


def newton(name: str, rows: str, penalty: float) -> dict[str, str]:
    """Blocks of a logistic fit on the rows (customer_id, y, feature, x) of a block; ``<name>_theta`` has (feature, t).

    A step forms the penalised curvature and gradient as cells (i, j), the gradient
    in a last column, and clears one column at a time.
    """
    last = f"(SELECT max(i) FROM {name}_places)"
    blocks = {
        f"{name}_rows": f"SELECT customer_id, y, feature, x FROM {rows} UNION ALL SELECT DISTINCT customer_id, y, '{FREE}', 1.0::DOUBLE FROM {rows}",
        f"{name}_places": f"SELECT feature, row_number() OVER (ORDER BY feature) AS i FROM (SELECT DISTINCT feature FROM {name}_rows) f",
        f"{name}_cells": f"SELECT customer_id, y, i, x FROM {name}_rows r JOIN {name}_places p ON p.feature = r.feature",
        f"{name}_theta_0": f"SELECT i, 0.0::DOUBLE AS t FROM {name}_places",
    }
    free = f"(SELECT i FROM {name}_places WHERE feature = '{FREE}')"
    for n in range(1, STEPS + 1):
        theta, p, system, solved = f"{name}_theta_{n - 1}", f"{name}_p_{n}", f"{name}_system_{n}", f"{name}_solved_{n}"
        blocks[p] = f"SELECT customer_id, y, 1 / (1 + exp(-sum(x * t))) AS p FROM {name}_cells c JOIN {theta} t ON t.i = c.i GROUP BY customer_id, y"
        blocks[system] = (
            "SELECT i, j, sum(v) AS v FROM ("
            f"SELECT a.i, b.i AS j, a.x * b.x * p * (1 - p) AS v FROM {name}_cells a JOIN {name}_cells b ON b.customer_id = a.customer_id JOIN {p} q ON q.customer_id = a.customer_id "
            f"UNION ALL SELECT i, {last} + 1, x * (p - q.y) FROM {name}_cells a JOIN {p} q ON q.customer_id = a.customer_id "
            f"UNION ALL SELECT i, {last} + 1, t * {1 / penalty!r}::DOUBLE FROM {theta} WHERE i <> {free} "
            f"UNION ALL SELECT i, i, {1 / penalty!r}::DOUBLE FROM {name}_places WHERE i <> {free} "
            f"UNION ALL SELECT a.i, b.i, 0.0::DOUBLE FROM {name}_places a JOIN {name}_places b ON true) s GROUP BY i, j"
        )
        blocks[solved] = (
            f"WITH RECURSIVE el AS (SELECT 0 AS k, i, j, v FROM {system} UNION ALL "
            "SELECT r.k + 1, r.i, r.j, CASE WHEN r.i = r.k + 1 THEN r.v / p.v ELSE r.v - c.v * q.v / p.v END "
            "FROM el r JOIN el p ON p.i = r.k + 1 AND p.j = r.k + 1 JOIN el q ON q.i = r.k + 1 AND q.j = r.j "
            f"JOIN el c ON c.i = r.i AND c.j = r.k + 1 WHERE r.k < {last}) SELECT i, v FROM el WHERE k = {last} AND j = {last} + 1"
        )
        blocks[f"{name}_theta_{n}"] = f"SELECT t.i, t - v AS t FROM {theta} t JOIN {solved} s ON s.i = t.i"
    blocks[f"{name}_theta"] = f"SELECT feature, t FROM {name}_theta_{STEPS} t JOIN {name}_places p ON p.i = t.i"
    return blocks


def model_blocks(model: str) -> dict[str, str]:
    """Blocks up to ``<model>_theta`` and ``<model>_raw``: the fit on train rows and the probability of every row."""
    return {
        **preparation(),
        f"{model}_long": f"SELECT customer_id, split, y, feature, x FROM fit_long WHERE {_is_of(model)}",
        f"{model}_train": f"SELECT customer_id, y, feature, x FROM {model}_long WHERE split = 'train'",
        **newton(model, f"{model}_train", 1.0),
        f"{model}_margin": f"SELECT customer_id, sum(x * t) AS m FROM {model}_long l JOIN {model}_theta t ON t.feature = l.feature GROUP BY customer_id",
        f"{model}_raw": f"SELECT r.customer_id, r.split, r.next_month_default AS y, 1 / (1 + exp(-(coalesce(m, 0) + (SELECT t FROM {model}_theta WHERE feature = '{FREE}')))) AS raw_pd "
        f"FROM fit_rows r LEFT JOIN {model}_margin g ON g.customer_id = r.customer_id",
    }


_CLIPPED = "least(greatest({p}, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)"


def _logit(p: str) -> str:
    clipped = _CLIPPED.format(p=p)
    return f"ln({clipped} / (1 - {clipped}))"


def calibrated_blocks(model: str) -> dict[str, str]:
    """Blocks up to ``<model>_pd``: raw probabilities calibrated by a nearly free fit on the calibration rows."""
    line = f"(SELECT t FROM {model}_platt_theta WHERE feature = '{{}}')"
    return {
        **model_blocks(model),
        f"{model}_points": f"SELECT customer_id, y::DOUBLE AS y, 'logit' AS feature, {_logit('raw_pd')} AS x FROM {model}_raw WHERE split = 'calibration'",
        **newton(f"{model}_platt", f"{model}_points", 1e6),
        f"{model}_pd": f"SELECT *, 1 / (1 + exp(-({line.format(FREE)} + {line.format('logit')} * {_logit('raw_pd')}))) AS predicted_pd FROM {model}_raw",
    }


def fitted_predictions() -> dict[str, str]:
    """Blocks in which ``pred`` holds the calibrated test predictions of all three models, at nine decimals."""
    blocks = {}
    for model in FEATURES:
        blocks |= calibrated_blocks(model)
    blocks["pred"] = _union(
        [
            f"SELECT '{model}' AS model, round(predicted_pd, 9) AS predicted_pd, d.customer_id AS borrower_id, y AS actual_default, split, education_code, marriage_code "
            f"FROM {model}_pd d JOIN borrower b ON b.customer_id = d.customer_id WHERE split = 'test'"
            for model in FEATURES
        ]
    )
    return blocks


def gradient(model: str) -> str:
    """Per feature: its coefficient and the penalised gradient at the fit."""
    return (
        f"SELECT l.feature, round(t, 6) AS coefficient, round(sum(x * (p - l.y)) + t, 6) + 0.0 AS gradient FROM {model}_train l "
        f"JOIN {model}_theta t ON t.feature = l.feature JOIN (SELECT customer_id, raw_pd AS p FROM {model}_raw) q ON q.customer_id = l.customer_id GROUP BY l.feature, t"
    )
