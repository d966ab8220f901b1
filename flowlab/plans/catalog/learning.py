"""Queries for distributed fits, Fisher information, continual and federated learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowlab.functions import vectors
from flowlab.operators import encode, evaluate, federate, learn, loss, minibatch, profile, sample
from flowlab.operators.clean import reshape
from flowlab.plans import continual
from flowlab.plans.catalog import gradient_sql as g
from flowlab.plans.catalog.registry import query, r6, round_all, table
from flowlab.session import fresh_path
from flowlab.sources import models

WIDTH, CLASSES, RATE = 64, 3, 0.5

# The embeddings and a label planted in them.
ROWS_SQL = f"""
rows as (
  select vec_id as id, 0 as g, 1.0::double as w, list_append([v::double for v in embedding], 1.0) as x,
    case when embedding[1] > 0.05 then 2 when embedding[2] > 0 then 1 else 0 end as y
  from embeddings)
"""


def rows(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        e.cast("array<double>").alias("x"),
        F.when(e[0] > 0.05, 2).when(e[1] > 0, 1).otherwise(0).alias("y"),
        "embedding",
    )


def fixed_model() -> learn.SoftmaxModel:
    values = np.array([[((k * 7 + j * 3) % 5 - 2) / 4.0 for j in range(1, WIDTH + 2)] for k in range(CLASSES)])
    return learn.SoftmaxModel(values[:, :WIDTH], values[:, WIDTH])


FIXED_SQL = f"""fixed as (
  select 0 as g, k.k, j.j, ((k.k * 7 + j.j * 3) % 5 - 2) / 4.0::double as v
  from range(0, {CLASSES}) k(k), range(1, {WIDTH + 2}) j(j))"""


def sql(*ctes, final: str) -> str:
    flat = [c for part in ctes for c in ([part] if isinstance(part, str) else part)]
    return "with " + ",\n".join(flat) + "\n" + final


def parameters(spark, model):
    return round_all(model.table(spark).select("key", "idx", "value"), "value")


ZERO_SQL = g.zeros("zero", CLASSES, WIDTH)


@query("gradient_fit", sql(
    ROWS_SQL, ZERO_SQL, g.steps("s", "rows", "zero", 4, RATE), final=g.named("s4", WIDTH),
))
def gradient_fit(spark, sf):
    fit = learn.fit_softmax(rows(spark, sf), CLASSES, steps=4, rate=RATE)
    return parameters(spark, fit.model)


@query("gradient_fit_weighted", sql(
    ROWS_SQL, "heavy as (select * replace (y + 1.0::double as w) from rows)", ZERO_SQL,
    g.steps("s", "heavy", "zero", 3, RATE), final=g.named("s3", WIDTH),
))
def gradient_fit_weighted(spark, sf):
    heavy = rows(spark, sf).withColumn("w", F.col("y") + 1.0)
    return parameters(spark, learn.fit_softmax(heavy, CLASSES, 3, RATE, weight="w").model)


@query("gradient_fit_clipped", sql(
    ROWS_SQL, ZERO_SQL, g.steps("s", "rows", "zero", 3, RATE, limit=0.05), final=g.named("s3", WIDTH),
))
def gradient_fit_clipped(spark, sf):
    fit = learn.fit_softmax(rows(spark, sf), CLASSES, 3, RATE, norm_limit=0.05)
    return parameters(spark, fit.model)


@query("parameters_saved", sql(
    ROWS_SQL, ZERO_SQL, g.steps("s", "rows", "zero", 1, RATE), final=g.named("s1", WIDTH),
))
def parameters_saved(spark, sf):
    fit = learn.fit_softmax(rows(spark, sf), CLASSES, 1, RATE)
    folder = fresh_path(spark, "models")
    models.save_softmax(spark, fit.model, folder, "multi")
    return parameters(spark, models.load_softmax(spark, folder, "multi"))


SCORE_SQL = sql(
    ROWS_SQL, FIXED_SQL, g.probabilities("p", "rows", "fixed"),
    final="select id as vec_id, arg_max(k, z)::int as y_pred, round(max(z), 6) + 0.0 as top from p group by id",
)


@query("score_batch", SCORE_SQL)
def score_batch(spark, sf):
    out = learn.score(rows(spark, sf).select("vec_id", "x"), fixed_model())
    return out.select("vec_id", "y_pred", r6(F.array_max("logits")).alias("top"))


@query("score_expression", SCORE_SQL)
def score_expression(spark, sf):
    out = rows(spark, sf).select("vec_id", fixed_model().logits(F.col("x")).alias("logits"))
    out = evaluate.predict_argmax(out)
    return out.select("vec_id", "y_pred", r6(F.array_max("logits")).alias("top"))


FISHER_SQL = g.fisher("fisher", "rows", "fixed", "e.id // 64")


@query("fisher_diag", sql(
    ROWS_SQL, FIXED_SQL, FISHER_SQL, final=f"""
select case when j <= {WIDTH} then 'weight' else 'bias' end as key,
  (case when j <= {WIDTH} then k * {WIDTH} + j - 1 else k end)::int as idx, round(f, 8) + 0.0 as value
from fisher"""))
def fisher_diag(spark, sf):
    batched = rows(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / 64))
    out = learn.fisher_diagonal(batched, fixed_model(), "batch")
    return out.withColumn("value", F.round("value", 8) + F.lit(0.0))


@query("ewc_penalty", sql(
    ROWS_SQL, FIXED_SQL, FISHER_SQL, ZERO_SQL, g.steps("s", "rows", "zero", 2, RATE), final="""
select round(sum(f.f * (s.v - a.v) * (s.v - a.v)), 6) + 0.0 as ewc_penalty
from fisher f join fixed a on a.k = f.k and a.j = f.j join s2 s on s.k = f.k and s.j = f.j"""))
def ewc_penalty(spark, sf):
    data = rows(spark, sf)
    batched = data.withColumn("batch", F.floor(F.col("vec_id") / 64))
    fisher = learn.fisher_diagonal(batched, fixed_model(), "batch")
    current = learn.fit_softmax(data, CLASSES, 2, RATE).model
    return round_all(
        loss.ewc_penalty(fisher, fixed_model().table(spark), current.table(spark)), "ewc_penalty"
    )


FROZEN = [0, 1, 2]


@query("incremental_refit", sql(
    ROWS_SQL, FIXED_SQL, FISHER_SQL,
    """placed as (select *, row_number() over (partition by y order by id) as rn from rows where id % 2 = 0)""",
    """mixed as (select * from rows where id % 2 = 1 union all select * exclude (rn) from placed where rn <= 20)""",
    g.steps("s", "mixed", "fixed", 3, RATE, mask="q.j > 3", pull=g.PullSql("fixed", "fisher")),
    final=g.named("s3", WIDTH),
))
def incremental_refit(spark, sf):
    data = rows(spark, sf)
    batched = data.withColumn("batch", F.floor(F.col("vec_id") / 64))
    old = fixed_model()
    fisher = np.zeros(old.flat().size)
    for row in learn.fisher_diagonal(batched, old, "batch").collect():
        fisher[row["idx"] + (old.weight.size if row["key"] == "bias" else 0)] = row["value"]
    replay = sample.replay_first(data.filter("vec_id % 2 = 0"), "y", ["vec_id"], 20)
    fit = learn.refit_softmax(
        data.filter("vec_id % 2 = 1"), old, fisher, FROZEN, replay, steps=3, rate=RATE
    )
    return parameters(spark, fit.model)


PHASE_SQL = [
    ROWS_SQL,
    "train as (select * from rows where id % 5 <> 0)",
    "test as (select * from rows where id % 5 = 0)",
    """ranked as (select *, row_number() over (order by md5(id::varchar || ':42'), id) as place,
    count(*) over () as n from train)""",
    "task1 as (select * exclude (place, n) from ranked where place <= n - ceil(0.8 * n))",
    "task2 as (select * exclude (place, n) from ranked where place > n - ceil(0.8 * n))",
    ZERO_SQL,
    g.steps("a", "task1", "zero", 3, RATE),
    "batches as (select id, (row_number() over (order by md5(id::varchar || ':42'), id) - 1) // 64 as b from task1)",
    g.fisher("fisher", "task1", "a3", "(select b from batches t where t.id = e.id)"),
    "placed as (select *, row_number() over (partition by y order by id) as rn from task1)",
    "mixed as (select * from task2 union all select * exclude (rn) from placed where rn <= 10)",
    g.steps("b", "mixed", "a3", 3, RATE, mask="q.j > 3", pull=g.PullSql("a3", "fisher")),
]


@query("continual_two_phase", sql(
    *PHASE_SQL, g.metrics("m1", "test", "a3"), g.metrics("m2", "test", "b3"),
    final="select 1 as phase, accuracy, log_loss from m1 union all select 2, accuracy, log_loss from m2",
))
def continual_two_phase(spark, sf):
    data = rows(spark, sf)
    is_test = F.col("vec_id") % 5 == 0
    _, _, log = continual.two_phase(
        data.filter(~is_test), data.filter(is_test), CLASSES, "vec_id", FROZEN,
        steps=3, rate=RATE, per_class=10,
    )
    return round_all(log.select("phase", "accuracy", "log_loss"), "accuracy", "log_loss")


@query("continual_parameters", sql(*PHASE_SQL, final=g.named("b3", WIDTH)))
def continual_parameters(spark, sf):
    data = rows(spark, sf)
    is_test = F.col("vec_id") % 5 == 0
    _, second, _ = continual.two_phase(
        data.filter(~is_test), data.filter(is_test), CLASSES, "vec_id", FROZEN,
        steps=3, rate=RATE, per_class=10,
    )
    return parameters(spark, second.model)


CLIENTS, ROUNDS, LOCAL = 4, 2, 2
CLIENT_ROWS_SQL = f"""clients as (
  select r.* replace (least((p.place - 1) // (p.n // {CLIENTS}), {CLIENTS - 1})::int as g) from rows r join (
    select id, row_number() over (order by md5(id::varchar || ':42'), id) as place, count(*) over () as n
    from rows) p on p.id = r.id)"""


def averaged(name: str, params: str) -> list[str]:
    return [f"""{name} as (
  select c.g, m.k, m.j, m.v from (select distinct g from clients) c, (
    select k, j, sum(v * n) / sum(n) as v from {params} p join (
      select g, count(*) as n from clients group by g) s on s.g = p.g group by k, j) m)"""]


def rounds_sql() -> tuple[list[str], str]:
    ctes, current = [g.zeros("start", CLASSES, WIDTH, "(select distinct g from clients)")], "start"
    for r in range(1, ROUNDS + 1):
        ctes += g.steps(f"r{r}_", "clients", current, LOCAL, RATE)
        ctes += averaged(f"avg{r}", f"r{r}_{LOCAL}")
        current = f"avg{r}"
    return ctes, current


def client_rows(spark, sf):
    return sample.client_partition(rows(spark, sf), "vec_id", CLIENTS)


@query("client_local_fit", sql(
    ROWS_SQL, CLIENT_ROWS_SQL, g.zeros("start", CLASSES, WIDTH, "(select distinct g from clients)"),
    g.steps("s", "clients", "start", 2, RATE), final=f"""
select s.g as client, n, case when j <= {WIDTH} then 'weight' else 'bias' end as key,
  (case when j <= {WIDTH} then k * {WIDTH} + j - 1 else k end)::int as idx, round(v, 6) + 0.0 as value
from s2 s join (select g, count(*) as n from clients group by g) c on c.g = s.g"""))
def client_local_fit(spark, sf):
    kept = learn.prepare_rows(client_rows(spark, sf), group="client")
    start = learn.SoftmaxModel.zeros(CLASSES, WIDTH)
    fits = federate.fit_clients(kept, start, learn.group_sizes(kept), 2, RATE)
    kept.unpersist()
    return round_all(federate.client_table(spark, fits), "value")


@query("fedavg", """
select 'mean' as key, (j.j - 1)::int as idx, round(avg(embedding[j.j]::double), 6) + 0.0 as value
from embeddings, range(1, 65) j(j) group by j.j
""")
def fedavg(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumn("client", (F.col("vec_id") % 7).cast("int"))
    means = vectors.select(
        "client", F.posexplode(F.col("embedding").cast("array<double>")).alias("idx", "value")
    ).groupBy("client", "idx").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    return round_all(federate.federated_average(means.withColumn("key", F.lit("mean"))), "value")


@query("federated_rounds", sql(
    ROWS_SQL, CLIENT_ROWS_SQL, rounds_sql()[0],
    f"last as (select * replace (0 as g) from {rounds_sql()[1]} where g = 0)",
    final=g.named("last", WIDTH),
))
def federated_rounds(spark, sf):
    data = client_rows(spark, sf)
    model, _ = federate.run_rounds(data, data, CLASSES, rounds=ROUNDS, epochs=LOCAL, rate=RATE)
    return parameters(spark, model)


@query("federated_metrics", sql(
    ROWS_SQL, CLIENT_ROWS_SQL, rounds_sql()[0],
    *[c for r in range(1, ROUNDS + 1) for c in (
        [f"last{r} as (select * from avg{r} where g = 0)"], g.metrics(f"m{r}", "rows", f"last{r}"))],
    final=" union all ".join(
        f"select {r} as round, accuracy, log_loss from m{r}" for r in range(1, ROUNDS + 1)),
))
def federated_metrics(spark, sf):
    data = client_rows(spark, sf)
    _, log = federate.run_rounds(data, data, CLASSES, rounds=ROUNDS, epochs=LOCAL, rate=RATE)
    return round_all(log.select("round", "accuracy", "log_loss"), "accuracy", "log_loss")


def fitted_metrics(data, features, kind="logistic", weight=None, classes=CLASSES):
    """Fit a Spark ML model on one part of the rows and report on the other."""
    is_test = F.col("vec_id") % 5 == 0
    model = learn.fit_pipeline(
        data.filter(~is_test), features, "y", kind, classes, weight, hidden=(8,), iterations=15
    )
    scored = learn.score_pipeline(data.filter(is_test), model, features)
    out = evaluate.evaluate(scored, None, "y", "given")["metrics"]
    return round_all(out, "accuracy", "weighted_f1", "macro_recall")


@query("baseline_fit")
def baseline_fit(spark, sf):
    return fitted_metrics(rows(spark, sf).select("vec_id", "x", "y"), ["x"])


@query("perceptron_fit")
def perceptron_fit(spark, sf):
    return fitted_metrics(rows(spark, sf).select("vec_id", "x", "y"), ["x"], "perceptron")


@query("weighted_fit")
def weighted_fit(spark, sf):
    data = rows(spark, sf).select("vec_id", "x", "y")
    weights = profile.smoothed_weights(data, "y")
    return fitted_metrics(loss.with_class_weight(data, weights, "y"), ["x"], weight="weight")


GROUPS_SQL = """
parts as (
  select *, x[1:32] as s, [v * 10 for v in x[33:64]] as d from rows),
scales as (
  select (select avg(v) from parts, unnest(s) u(v)) as sm, (select stddev_pop(v) from parts, unnest(s) u(v)) as sd,
    (select avg(v) from parts, unnest(d) u(v)) as dm, (select stddev_pop(v) from parts, unnest(d) u(v)) as dd),
grouped as (
  select id, g, w, y, list_append(list_concat([(v - sm) / sd for v in s], [(v - dm) / dd for v in d]), 1.0) as x
  from parts, scales)"""


@query("two_group_fit", sql(
    ROWS_SQL, GROUPS_SQL, ZERO_SQL, g.steps("a", "grouped", "zero", 2, RATE),
    g.steps("b", "grouped", "a2", 2, RATE, mask="q.j > 32"), final=g.named("b2", WIDTH),
))
def two_group_fit(spark, sf):
    """Two groups of different scale, the first one frozen after two steps."""
    x = F.col("x")
    data = rows(spark, sf).select(
        "y", F.slice(x, 1, 32).alias("fixed_part"), F.transform(F.slice(x, 33, 32), lambda v: v * 10).alias("moving_part")
    )
    fit = learn.fit_groups(data, ["fixed_part", "moving_part"], CLASSES, ["fixed_part"], 2, 2, RATE)
    return parameters(spark, fit.model)


@query("sequence_fit")
def sequence_fit(spark, sf):
    """Every vector as a sequence of 16 steps, fitted on each step's mean and its change to the next."""
    data = reshape(rows(spark, sf).select("vec_id", "y", F.col("x").alias("v")), "v", 16, "steps")
    means = F.transform("steps", lambda step: vectors.total(step) / F.size(step))
    data = data.withColumn("means", means)
    change = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.get("means", i) - F.get("means", i - 1))
    return fitted_metrics(data.select("vec_id", "y", F.concat("means", change).alias("x")), ["x"])


@query("image_fit")
def image_fit(spark, sf):
    data = encode.image(rows(spark, sf).select("vec_id", "y", "x"), "x", "image")
    return fitted_metrics(data.drop("x"), ["image"])


ADAM_RATE = 0.05
HALVES_SQL = """halves as (
  select *, (row_number() over (order by md5(id::varchar || ':42'), id) - 1) // (select (count(*) + 1) // 2 from rows) as half from rows)"""


@query("minibatch_fit", sql(
    ROWS_SQL, HALVES_SQL, "batch1 as (select * exclude half from halves where half = 0)", "batch2 as (select * exclude half from halves where half = 1)",
    ZERO_SQL, g.step("a", "batch1", "zero", 1.0),
    f"one as (select g, k, j, v - {ADAM_RATE} * d / (abs(d) + 1e-8) as v from a_full)",
    g.step("b", "batch2", "one", 1.0),
    f"""two as (
  select f.g, f.k, f.j, f.v - {ADAM_RATE} * ((0.09 * a.d + 0.1 * f.d) / 0.19)
    / (sqrt((0.000999 * a.d * a.d + 0.001 * f.d * f.d) / 0.001999) + 1e-8) as v
  from b_full f join a_full a on a.g = f.g and a.k = f.k and a.j = f.j)""",
    final=g.named("two", WIDTH),
))
def minibatch_fit(spark, sf):
    """One epoch of two batches: two steps with first and second moments."""
    data = rows(spark, sf)
    size = (data.count() + 1) // 2
    rule = minibatch.Adam(rate=ADAM_RATE)
    fit = minibatch.fit_minibatch(data, learn.SoftmaxModel.zeros(CLASSES, WIDTH), epochs=1, batch=size, rule=rule, key="vec_id")
    return parameters(spark, fit.model)


BRANCHES = minibatch.Branches(left=3, right=3, hidden=2, classes=CLASSES)


def branch_loss_sql():
    """The loss of every row under every shifted copy of the parameters: ``q`` is a copy's list, ``x`` a row's."""
    place, at = 1, {}
    for name, shape in BRANCHES.shapes():
        at[name] = place
        place += int(np.prod(shape))
    k = BRANCHES.hidden

    def hidden(side, offset, h):
        terms = [f"x[{offset + i + 1}] * q[{at[f'{side}_weight'] + i * k + h}]" for i in range(3)]
        return f"tanh({' + '.join(terms)} + q[{at[f'{side}_bias'] + h}])"

    hs = [("left", 0, h) for h in range(k)] + [("right", 3, h) for h in range(k)]
    columns = ", ".join(f"{hidden(*spec)} as h{i}" for i, spec in enumerate(hs))
    logits = ", ".join(
        " + ".join(f"h{i} * q[{at['top_weight'] + i * CLASSES + c}]" for i in range(2 * k)) + f" + q[{at['top_bias'] + c}] as z{c}" for c in range(CLASSES)
    )
    cosine = "(h0 * h2 + h1 * h3) / (greatest(sqrt(h0 * h0 + h1 * h1), 1e-8) * greatest(sqrt(h2 * h2 + h3 * h3), 1e-8))"
    return [
        f"start as (select i as place, ((i * 7919 + 42 * 104729) % 1009 - 504) / 1009.0::double as v from range(0, {BRANCHES.size()}) t(i))",
        """copies as (
  select d.place as bump, s.s, list(p.v + case when p.place = d.place then s.s * 1e-4 else 0 end order by p.place) as q
  from start p, start d, (values (-1), (1)) s(s) group by all)""",
        f"hidden as (select bump, s, y, q, {columns} from rows, copies)",
        f"outputs as (select bump, s, y, {cosine} as cosine, {logits} from hidden)",
        """losses as (
  select bump, s, avg(ln(exp(z0) + exp(z1) + exp(z2)) - case y when 0 then z0 when 1 then z1 else z2 end + 0.05 * cosine) as loss
  from outputs group by bump, s)""",
        "slopes as (select bump as place, sum(s * loss) / 2e-4 as d from losses group by bump)",
        "moved as (select place, v - 0.5 * d / (abs(d) + 1.0) as v from start join slopes using (place))",
    ]


@query("branch_fit", sql(
    ROWS_SQL, branch_loss_sql(), final="select place::int as place, round(v, 5) + 0.0 as value from moved",
))
def branch_fit(spark, sf):
    """A full-batch step of the two-branch model with its decoupling term; the SQL takes the loss's slopes numerically."""
    data = rows(spark, sf).withColumn("x", F.slice("x", 1, 6))
    rule = minibatch.Adam(rate=0.5, first=0.0, second=0.0, floor=1.0)
    objective = BRANCHES.objective(1, warmup=0.0)
    state, _ = minibatch.fit(data, BRANCHES.start(), objective, epochs=1, batch=data.count(), rule=rule, key="vec_id")
    out = spark.createDataFrame([(i, float(v)) for i, v in enumerate(state.flat)], "place int, value double")
    return out.withColumn("value", F.round("value", 5) + F.lit(0.0))
