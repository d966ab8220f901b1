"""SQL for gradient steps of a softmax model, to check the distributed fits.

Rows are ``(id, g, y, w, x)`` with ``x`` a list that ends in 1 for the bias; parameters
are ``(g, k, j, v)`` with ``j`` counting from 1 and the bias last.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class PullSql:
    """Names of the old parameters and the Fisher table ``(k, j, f)``; weights of the terms."""

    old: str
    fisher: str | None = None
    ewc: float = 0.05
    lwf: float = 0.1


def probabilities(name: str, rows: str, params: str, temperature: float = 1.0) -> list[str]:
    """Logits and class probabilities per row and class."""
    return [
        f"""{name}_z as (
  select r.id, r.g, r.y, r.w, p.k, sum(r.x[p.j] * p.v) as z
  from {rows} r join {params} p on p.g = r.g group by all)""",
        f"""{name} as (
  select *, exp(z / {temperature}) / sum(exp(z / {temperature})) over (partition by id) as p from {name}_z)""",
    ]


def step(
    name: str, rows: str, params: str, rate: float, mask: str = "true",
    pull: PullSql | None = None, limit: float | None = None,
) -> list[str]:
    """One full-batch gradient step from ``params`` to ``name``."""
    ctes = probabilities(f"{name}_p", rows, params)
    extra, ewc = "", "0"
    if pull is not None:
        ctes += probabilities(f"{name}_new", rows, params, 2.0)
        ctes += probabilities(f"{name}_old", rows, pull.old, 2.0)
        extra = f" + {pull.lwf} * 2.0 * (n.p - o.p)"
        if pull.fisher:
            ewc = f"""(select {pull.ewc} * 2 * f * (q.v - a.v) from {pull.fisher} f
      join {pull.old} a on a.k = f.k and a.j = f.j and a.g = q.g where f.k = q.k and f.j = q.j)"""
    joins = ""
    if pull is not None:
        joins = f" join {name}_new n on n.id = e.id and n.k = e.k join {name}_old o on o.id = e.id and o.k = e.k"
    ctes += [
        f"""{name}_err as (
  select e.id, e.g, e.w, e.k, e.p - (e.k = e.y)::int{extra} as err from {name}_p e{joins})""",
        f"""{name}_grad as (
  select e.g, e.k, q.j, sum(e.w * e.err * r.x[q.j]) / sum(e.w) as d
  from {name}_err e join {rows} r on r.id = e.id join {params} q on q.g = e.g and q.k = e.k
  group by all)""",
        f"""{name}_full as (
  select q.g, q.k, q.j, q.v, case when {mask} then d + {ewc} else 0 end as d
  from {params} q join {name}_grad d on d.g = q.g and d.k = q.k and d.j = q.j)""",
    ]
    factor = "1"
    if limit is not None:
        factor = f"least(1, {limit} / (select sqrt(sum(d * d)) from {name}_full))"
    ctes.append(f"{name} as (select g, k, j, v - {rate} * {factor} * d as v from {name}_full)")
    return ctes


def steps(
    name: str, rows: str, params: str, count: int, rate: float, mask: str = "true",
    pull: PullSql | None = None, limit: float | None = None,
) -> list[str]:
    """Several steps; the last parameters are ``<name><count>``."""
    ctes, current = [], params
    for i in range(1, count + 1):
        ctes += step(f"{name}{i}", rows, current, rate, mask, pull, limit)
        current = f"{name}{i}"
    return ctes


def zeros(name: str, classes: int, width: int, groups: str = "(select 0 as g)") -> str:
    return f"""{name} as (
  select g.g, k.k, j.j, 0.0::double as v from {groups} g, range(0, {classes}) k(k), range(1, {width + 2}) j(j))"""


def fisher(name: str, rows: str, params: str, batch: str) -> list[str]:
    """Mean over batches of the squared batch-mean gradient; ``batch`` is on the row id."""
    return probabilities(f"{name}_p", rows, params) + [
        f"""{name}_b as (
  select {batch} as b, e.k, q.j, avg((e.p - (e.k = e.y)::int) * r.x[q.j]) as d
  from {name}_p e join {rows} r on r.id = e.id join {params} q on q.k = e.k and q.g = e.g group by all)""",
        f"{name} as (select k, j, avg(d * d) as f from {name}_b group by all)",
    ]


def named(params: str, width: int) -> str:
    """Parameters under the names of the parameter table."""
    return f"""select case when j <= {width} then 'weight' else 'bias' end as key,
  (case when j <= {width} then k * {width} + j - 1 else k end)::int as idx, round(v, 6) + 0.0 as value
from {params}"""


def metrics(name: str, rows: str, params: str) -> list[str]:
    """Accuracy and mean cross-entropy of parameters on rows."""
    return [
        f"""{name}_z as (
  select r.id, r.y, p.k, sum(r.x[p.j] * p.v) as z from {rows} r join {params} p on p.g = r.g group by all)""",
        f"""{name}_r as (
  select id, any_value(y) as y, arg_max(k, z) as top, ln(sum(exp(z))) - sum(case when k = y then z end) as ce
  from {name}_z group by id)""",
        f"""{name} as (
  select round(avg((top = y)::int), 6) + 0.0 as accuracy, round(avg(ce), 6) + 0.0 as log_loss from {name}_r)""",
    ]
