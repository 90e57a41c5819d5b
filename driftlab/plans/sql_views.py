"""The embeddings' views and scores in DuckDB SQL, for the queries' oracles."""

from __future__ import annotations

from driftlab.functions.vectors import blur_taps
from driftlab.operators import views

M32 = 4294967296


def _op(op: str, p, seed: str) -> str:
    if op == "jpeg":
        step = repr((100 - p) / 200.0)
        return f"list_transform(x, lambda v: round(v / {step}::DOUBLE) * {step}::DOUBLE)"
    if op == "blur":
        taps = blur_taps(p)
        total = sum(w for _, w in taps)
        terms = " + ".join(f"x[greatest(1, least(64, i + {k}))] * {w!r}::DOUBLE" for k, w in taps)
        return f"list_transform(range(1, 65), lambda i: ({terms}) / {total!r}::DOUBLE)"
    if op == "resize":
        f = round(1 / p)
        return f"list_transform(range(0, 64), lambda i: x[(i // {f}) * {f} + 1])"
    if op == "noise":
        step1 = f"(({seed} + i * 2654435761) % {M32})"
        step2 = f"(({step1} * 1664525 + 1013904223) % {M32})"
        step3 = f"(xor({step2}, {step2} >> 16))"
        u = f"((({step3} * 22695477 + 1) % {M32}) / {float(M32)}::DOUBLE)"
        return f"list_transform(range(1, 65), lambda i: x[i] + ({u} - 0.5::DOUBLE) * {(p * 12.0**0.5)!r}::DOUBLE)"
    if op == "jitter":
        lo, span = 1 - views.JITTER_STRENGTH, 2 * views.JITTER_STRENGTH
        return f"list_transform(x, lambda v: v * ({lo!r}::DOUBLE + {span!r}::DOUBLE * ({seed} / {float(M32)}::DOUBLE)))"
    edge = round((1 - views.CROP_FRACTION) / 2, 6)
    return f"list_transform(range(1, 65), lambda i: CASE WHEN i - 1 >= floor(64 * {edge!r}::DOUBLE) AND i - 1 < 64 - floor(64 * {edge!r}::DOUBLE) THEN x[i] ELSE 0.0::DOUBLE END)"


def scores_cte(names=None, scored_only: bool = True) -> str:
    """WITH ... scores(row_id, path, y, generator, source, tier, view, ord, kind, p)."""
    order = {n: i for i, n in enumerate(views.view_steps())}
    parts = []
    for n in views.select_views(names, scored_only):
        h = f"sha1(path || '::{n}::path-v1')"
        seed = f"('0x' || substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))::BIGINT"
        inner = f"SELECT *, {seed} AS seed FROM base"
        for op, p in views.view_steps()[n]:
            inner = f"SELECT row_id, path, y, generator, source, tier, seed, {_op(op, p, 'seed')} AS x FROM ({inner})"
        kind = "chain" if views.is_chain(n) else "single"
        parts.append(f"SELECT row_id, path, y, generator, source, tier, '{n}' AS view, {order[n]}::INT AS ord, '{kind}' AS kind, x FROM ({inner})")
    return (
        """WITH base AS (
  SELECT vec_id AS row_id, 'vec/' || vec_id AS path, (label >= 5)::INT AS y, 'g' || label AS generator, 's' || (vec_id % 3) AS source,
    ['val', 'ood', 'demo_val', 'social'][(vec_id % 4 + 1)::INT] AS tier, embedding::DOUBLE[] AS x FROM embeddings),
dims AS (SELECT y, unnest(range(1, 65)) AS dim, unnest(x) AS v FROM base),
sc AS (
  SELECT dim, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS std,
    avg(v) FILTER (y = 1) AS m1, avg(v) FILTER (y = 0) AS m0 FROM dims GROUP BY dim),
head AS (
  SELECT list(mean ORDER BY dim) AS mean, list(std ORDER BY dim) AS std, list((m1 - mean) / std - (m0 - mean) / std ORDER BY dim) AS w,
    -sum(((m1 - mean) / std - (m0 - mean) / std) * ((m1 - mean) / std + (m0 - mean) / std)) / 2 AS b FROM sc),
views AS (
"""
        + "\nUNION ALL ".join(parts)
        + """),
scores AS (
  SELECT row_id, path, y, generator, source, tier, view, ord, kind,
    round(1.0 / (1.0 + exp(-(list_dot_product(list_transform(range(1, 65), lambda i: (x[i] - mean[i]) / std[i]), w) + b))), 9) AS p
  FROM views CROSS JOIN head)
"""
    )


def auc_sql(by: str, src: str = "scores") -> str:
    """A SELECT of (by, auc) from a table of p and y."""
    g, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""SELECT {g}round(CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
    (sum(CASE WHEN y = 1 THEN 2 * rk + c - 1 ELSE 0 END)::DOUBLE - sum(y) * (sum(y) + 1)) / (2.0 * sum(y) * sum(1 - y)) END, 6) AS auc
  FROM (SELECT *, rank() OVER ({part}ORDER BY p) AS rk, count(*) OVER (PARTITION BY {g}p) AS c FROM {src}) {f'GROUP BY {by}' if by else ''}"""
