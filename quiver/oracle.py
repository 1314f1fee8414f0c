"""Independent DuckDB formulations of the registered queries (the correctness oracle).

Each builder returns SQL over the driver's pre-registered views. The SQL uses plain
global windows and joins (fine at oracle scale); the Spark side must produce the same
rows from a scalable plan. Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from quiver.functions.hashing import sql_h as H

R = 6  # decimals for double outputs


def rnd(expr: str, alias: str) -> str:
    return f"round({expr}, {R}) AS {alias}"


# ---- sampling -------------------------------------------------------------------------

def split_cte(table: str, key: str, seed: str = "42", frac: float = 0.5) -> str:
    return f"""SELECT * EXCLUDE (_h, _rn, _n),
  CASE WHEN _rn <= ceil(_n * {frac}) THEN 'test' ELSE 'val' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY _h, {key}) AS _rn, count(*) OVER () AS _n
      FROM (SELECT *, {H(seed, key)} AS _h FROM {table}))"""


def positions_cte(table: str, key: str) -> str:
    return f"""SELECT {key}, row_number() OVER (ORDER BY {H("'pos'", key)}, {key}) - 1 AS pos,
  count(*) OVER () AS n FROM {table}"""


def bootstrap_ctes(table: str, key: str, replicas: int = 10, prefix: str = "") -> str:
    """CTEs <prefix>pos, <prefix>draws, <prefix>samples(replica, key, mult)."""
    p = prefix
    return f"""{p}pos AS ({positions_cte(table, key)}),
{p}draws AS (SELECT CAST(r.replica AS INTEGER) AS replica, {H('r.replica', 'p.pos')} % p.n AS target,
  CAST(count(*) AS INTEGER) AS mult FROM {p}pos p CROSS JOIN range({replicas}) r(replica) GROUP BY 1, 2),
{p}samples AS (SELECT d.replica, p.{key}, d.mult FROM {p}draws d JOIN {p}pos p ON p.pos = d.target)"""


def double_bootstrap_ctes(table: str, key: str, outer: int = 10, inner: int = 5, base: int = 100) -> str:
    """CTEs dpos, douter, dinner, dsamples(i, j, key, mult)."""
    return f"""dpos AS ({positions_cte(table, key)}),
douter AS (SELECT CAST(r.i AS INTEGER) AS i, p.pos AS d, {H('r.i', 'p.pos')} % p.n AS target
  FROM dpos p CROSS JOIN range({outer}) r(i)),
douter_keys AS (SELECT o.i, o.d, p.{key} FROM douter o JOIN dpos p ON p.pos = o.target),
dinner AS (SELECT CAST(r.j AS INTEGER) AS j, {H(f'r.j + {base}', 'p.pos')} % p.n AS d, count(*) AS c
  FROM dpos p CROSS JOIN range({inner}) r(j) GROUP BY 1, 2),
dsamples AS (SELECT o.i, n.j, o.{key}, CAST(sum(n.c) AS INTEGER) AS mult
  FROM douter_keys o JOIN dinner n ON n.d = o.d GROUP BY 1, 2, 3)"""


# ---- centroid ensemble ----------------------------------------------------------------

def centroid_ctes(train: str, samples: str, key: str, model_cols: list[str], out: str = "cent") -> str:
    mc = ", ".join(f"s.{c}" for c in model_cols)
    g = ", ".join(model_cols)
    return f"""{out}_cells AS (SELECT {mc}, t.label AS class_id, s.mult,
  CAST(unnest(t.embedding) AS DOUBLE) AS x, CAST(generate_subscripts(t.embedding, 1) - 1 AS INTEGER) AS dim
  FROM {samples} s JOIN {train} t USING ({key})),
{out} AS (SELECT {g}, class_id, dim, sum(mult * x) / sum(mult) AS value FROM {out}_cells GROUP BY ALL)"""


def scoring_ctes(test: str, cent: str, key: str, model_cols: list[str], out: str = "probs",
                 join_extra: str = "") -> str:
    """Softmax of minus squared distance per (model, row, class)."""
    mc = ", ".join(f"c.{c}" for c in model_cols)
    part = ", ".join(model_cols + [key])
    return f"""{out}_tx AS (SELECT {key}, CAST(unnest(embedding) AS DOUBLE) AS x,
  CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM {test}),
{out}_dist AS (SELECT {mc}, t.{key}, c.class_id, -sum((t.x - c.value) * (t.x - c.value)) AS s
  FROM {out}_tx t JOIN {cent} c ON c.dim = t.dim {join_extra} GROUP BY ALL),
{out}_ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY {part})) AS e FROM {out}_dist),
{out} AS (SELECT * EXCLUDE (s, e), e / sum(e) OVER (PARTITION BY {part}) AS prob FROM {out}_ex)"""


def vote_ctes(probs: str, key: str, group: list[str], prefix: str = "") -> str:
    g = "".join(f"{c}, " for c in group)
    part = ", ".join(group + [key])
    p = prefix
    return f"""{p}totals AS (SELECT {g}{key}, class_id, sum(prob) AS total FROM {probs} GROUP BY ALL),
{p}pred AS (SELECT {g}{key}, class_id AS y_pred FROM (SELECT *, row_number() OVER (
  PARTITION BY {part} ORDER BY round_even(total, 9) DESC, class_id) AS _rk FROM {p}totals) WHERE _rk = 1)"""


def report_ctes(conf: str, group: list[str], prefix: str = "") -> str:
    """CTEs <prefix>per (per-label) and <prefix>report (summary) from a confusion CTE."""
    g = "".join(f"{c}, " for c in group)
    p = prefix
    return f"""{p}per_raw AS (SELECT {g}label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
    SELECT {g}y_true AS label, n AS support, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, 0 AS predicted FROM {conf}
    UNION ALL SELECT {g}y_pred AS label, 0, 0, n FROM {conf}) GROUP BY ALL),
{p}per AS (SELECT {g}label, tp,
  coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
  coalesce(tp / nullif(support, 0), 0.0) AS recall,
  coalesce(2 * tp / nullif(support + predicted, 0), 0.0) AS f1,
  CAST(support AS BIGINT) AS support FROM {p}per_raw),
{p}report AS (SELECT {g}sum(tp) / sum(support) AS accuracy, avg(precision) AS macro_precision,
  avg(recall) AS macro_recall, avg(f1) AS macro_f1,
  sum(precision * support) / sum(support) AS weighted_precision,
  sum(recall * support) / sum(support) AS weighted_recall,
  sum(f1 * support) / sum(support) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support
  FROM {p}per GROUP BY ALL)"""


REPORT_COLS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision",
               "weighted_recall", "weighted_f1"]


def report_select(src: str, group: list[str]) -> str:
    g = "".join(f"{c}, " for c in group)
    return f"SELECT {g}" + ", ".join(rnd(c, c) for c in REPORT_COLS) + f", support FROM {src}"


def flagship_ctes(replicas: int = 10) -> str:
    """embeddings: split -> bootstrap -> centroids -> scores -> vote -> pred -> aligned -> conf -> report."""
    return f"""WITH emb_split AS ({split_cte('embeddings', 'vec_id')}),
train AS (SELECT * FROM emb_split WHERE split = 'val'),
test AS (SELECT * FROM emb_split WHERE split = 'test'),
{bootstrap_ctes('train', 'vec_id', replicas)},
{centroid_ctes('train', 'samples', 'vec_id', ['replica'])},
{scoring_ctes('test', 'cent', 'vec_id', ['replica'])},
{vote_ctes('probs', 'vec_id', [])},
aligned AS (SELECT p.vec_id, p.y_pred, t.label AS y_true FROM pred p JOIN test t USING (vec_id)),
conf AS (SELECT y_true, y_pred, count(*) AS n FROM aligned GROUP BY ALL),
{report_ctes('conf', [])}
"""


# ---- derived experiment table, planning ---------------------------------------------------

def experiment_ctes() -> str:
    """CTEs exp_raw (the spreadsheet rule) and exp_clean (first 8 columns, no nulls, typed)."""
    tasks = "['CB', 'BoolQ', 'RTE']"
    names = ("['microsoft/deberta-base', 'microsoft/deberta-v3-small', 'microsoft/deberta-v3-xsmall', "
             "'microsoft/deberta-v3-large', 'microsoft/deberta-v2-xlarge']")
    return f"""exp_base AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus,
    {tasks}[(o_custkey % 3) + 1] AS _task,
    CASE o_orderstatus WHEN 'F' THEN 'gpt2' WHEN 'O' THEN 'distilgpt2' ELSE {names}[(o_custkey % 5) + 1] END AS _mtype,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS _base,
    strftime(o_orderdate, '%Y_%m_%d-%I_%M_%S_%p') || '/' AS _stamp FROM orders),
exp_raw AS (SELECT CAST(floor(o_orderkey / 4) AS DOUBLE) AS "Configuration Num", _task AS "Task",
    CASE WHEN _base = 1 THEN '/m/' || _mtype || '/' || _task || '/baseline/' || _stamp
         WHEN o_orderkey % 97 = 0 THEN '/m/' || _mtype || '/' || _task || '/bootstrapped/' || _stamp
         ELSE '/m/' || _mtype || '/' || _task || '/bootstrapped_*/' || _stamp END AS "Path",
    CAST((o_custkey % 13) + 1 AS DOUBLE) AS "Number of Models", CAST(o_custkey % 7 AS DOUBLE) / 10 AS "Pruning Factor",
    _base AS "Is Baseline", _mtype AS "Model Type",
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS "Notes",
    CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE 'ok' END AS "Comment", o_orderkey AS "Row" FROM exp_base),
exp_clean AS (SELECT CAST("Configuration Num" AS INTEGER) AS config, "Task" AS task, "Path" AS path,
    CAST("Number of Models" AS INTEGER) AS num_models, "Pruning Factor" AS pruning_factor,
    CAST("Is Baseline" AS INTEGER) AS is_baseline, "Model Type" AS model_type, "Notes" AS notes,
    CAST("Row" AS BIGINT) AS row_id FROM exp_raw
  WHERE "Configuration Num" IS NOT NULL AND "Task" IS NOT NULL AND "Path" IS NOT NULL AND "Number of Models" IS NOT NULL
    AND "Pruning Factor" IS NOT NULL AND "Is Baseline" IS NOT NULL AND "Model Type" IS NOT NULL AND "Notes" IS NOT NULL)"""


def chosen_cte(src: str = "exp_clean", seed: str = "'models'") -> str:
    rowkey = "CAST(config AS VARCHAR) || ':' || task || ':' || path"
    return f"""chosen AS (SELECT * EXCLUDE (_rk) FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {H(seed, f"{rowkey} || ':' || CAST(model_no AS VARCHAR)")}, model_no) AS _rk
  FROM (SELECT *, CAST(unnest(generate_series(0, greatest(10, num_models) - 1)) AS INTEGER) AS model_no
        FROM {src} WHERE is_baseline = 0)) WHERE _rk <= num_models)"""


def model_path_sql(t: str, n: str, mt: str, task: str) -> tuple[str, str]:
    from quiver.plans.experiment import SUFFIXES, STAMP_LEN
    sfx = "CASE " + " ".join(f"WHEN {mt} = '{a}' AND {task} = '{b}' THEN '{s}'" for (a, b), s in SUFFIXES.items()) + " END"
    pos = f"instr({t}, '*')"
    keep = f"greatest(length({t}) - {STAMP_LEN}, 0)"
    prefix = f"left({t}, {keep})"
    ns = f"CAST({n} AS VARCHAR)"
    replaced = f"substr({t}, 1, {pos} - 1) || {ns} || substr({t}, {pos} + 1)"
    prefix_r = f"CASE WHEN {pos} <= {keep} THEN substr({prefix}, 1, {pos} - 1) || {ns} || substr({prefix}, {pos} + 1) ELSE {prefix} END"
    path = f"CASE WHEN {pos} = 0 THEN NULL WHEN {n} < 10 THEN {replaced} ELSE {prefix_r} || ({sfx}) END"
    err = (f"CASE WHEN {pos} = 0 THEN 'template has no ''*''' WHEN {n} >= 10 AND ({sfx}) IS NULL "
           f"THEN 'no run-stamp suffix for ' || {mt} || '/' || {task} END")
    return path, err


def hp_cte() -> str:
    from quiver.plans.derived import DEBERTA_HYPERPARAMS
    vals = ",\n  ".join(f"({i}, '{m}', '{t}', {e}, {b}, CAST({lr!r} AS DOUBLE), CAST({wd!r} AS DOUBLE))" for i, (m, t, e, b, lr, wd) in enumerate(DEBERTA_HYPERPARAMS))
    return f"""hp AS (SELECT * FROM (VALUES
  {vals}) v(file_row, model_name, task, n_epochs, train_batch_size, learning_rate, weight_decay)),
hp_first AS (SELECT * EXCLUDE (_rk) FROM (SELECT *, row_number() OVER (PARTITION BY model_name, task ORDER BY file_row) AS _rk FROM hp) WHERE _rk = 1)"""


# ---- bagged naive Bayes over documents ----------------------------------------------------

TOKEN_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def poisson_sql(hash_sql: str) -> str:
    """Poisson(1) by inversion, from sums of 1/k! of its own: the smallest m whose scaled cumulative sum exceeds the hash."""
    from fractions import Fraction

    terms = [Fraction(1)]
    for k in range(1, 40):
        terms.append(terms[-1] / k)
    total = sum(terms)  # e to 40 terms
    sums = [sum(terms[: k + 1]) / total for k in range(18)]
    return " + ".join(f"CAST({hash_sql} >= {int(x * 2**60)} AS INTEGER)" for x in sums if int(x * 2**60) < 2**60)


def poisson_samples_cte(table: str, key: str, replicas: int) -> str:
    mult = poisson_sql("_h")
    h = H("'poisson' || CAST(r.replica AS VARCHAR)", f"e.{key}")
    return f"""samples AS (SELECT replica, {key}, mult FROM (
  SELECT CAST(replica AS INTEGER) AS replica, {key}, {mult} AS mult FROM (
    SELECT r.replica, e.{key}, {h} AS _h FROM {table} e CROSS JOIN range({replicas}) r(replica)))
  WHERE mult > 0)"""


def text_ctes(replicas: int = 5, alpha: float = 1.0, resample: str = "exact") -> str:
    samples = (poisson_samples_cte('train', 'doc_id', replicas) if resample == "poisson"
               else bootstrap_ctes('train', 'doc_id', replicas))
    return f"""WITH ld AS (SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id)),
sp AS ({split_cte('ld', 'doc_id')}),
train AS (SELECT * FROM sp WHERE split = 'val'),
test AS (SELECT * FROM sp WHERE split = 'test'),
{samples},
ttok AS (SELECT doc_id, label AS class_id, unnest({TOKEN_SQL}) AS token FROM train),
cnt AS (SELECT s.replica, t.class_id, t.token, sum(s.mult) AS cnt FROM samples s JOIN ttok t USING (doc_id) GROUP BY ALL),
classes AS (SELECT s.replica, t.label AS class_id, sum(s.mult) AS docs FROM samples s JOIN train t USING (doc_id) GROUP BY ALL),
tot AS (SELECT replica, class_id, sum(cnt) AS total FROM cnt GROUP BY ALL),
voc AS (SELECT replica, count(DISTINCT token) AS v FROM cnt GROUP BY ALL),
dims AS (SELECT c.replica, c.class_id, coalesce(t.total, 0) AS total, v.v FROM classes c
  LEFT JOIN tot t USING (replica, class_id) JOIN voc v USING (replica)),
grid AS (SELECT g.replica, d.class_id, g.token, d.total, d.v FROM (SELECT DISTINCT replica, token FROM cnt) g JOIN dims d USING (replica)),
model AS (SELECT g.replica, g.class_id, g.token,
  ln((CAST(coalesce(c.cnt, 0) AS DOUBLE) + {alpha}) / (CAST(g.total AS DOUBLE) + {alpha} * g.v)) AS loglik
  FROM grid g LEFT JOIN cnt c USING (replica, class_id, token)),
prior AS (SELECT replica, class_id, ln(docs / sum(docs) OVER (PARTITION BY replica)) AS log_prior FROM classes),
qtf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKEN_SQL}) AS token FROM test) GROUP BY ALL),
parts AS (SELECT q.doc_id, m.replica, m.class_id, q.tf * m.loglik AS part FROM qtf q JOIN model m USING (token)
  UNION ALL SELECT t.doc_id, p.replica, p.class_id, p.log_prior FROM test t CROSS JOIN prior p),
sc AS (SELECT doc_id, replica, class_id, sum(part) AS s FROM parts GROUP BY ALL),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY replica, doc_id)) AS e FROM sc),
probs AS (SELECT doc_id, replica, class_id, e / sum(e) OVER (PARTITION BY replica, doc_id) AS prob FROM ex),
{vote_ctes('probs', 'doc_id', [])},
aligned AS (SELECT p.doc_id, p.y_pred, t.label AS y_true FROM pred p JOIN test t USING (doc_id)),
conf AS (SELECT y_true, y_pred, count(*) AS n FROM aligned GROUP BY ALL)
"""


def binary_metrics_select(conf: str = "conf") -> str:
    return f"""SELECT round(sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n), {R}) AS accuracy,
  round(coalesce(sum(n) FILTER (WHERE y_true = 1 AND y_pred = 1) / nullif(sum(n) FILTER (WHERE y_pred = 1), 0), 0.0), {R}) AS precision,
  round(coalesce(sum(n) FILTER (WHERE y_true = 1 AND y_pred = 1) / nullif(sum(n) FILTER (WHERE y_true = 1), 0), 0.0), {R}) AS recall,
  round(coalesce(2 * sum(n) FILTER (WHERE y_true = 1 AND y_pred = 1) /
    nullif(sum(n) FILTER (WHERE y_pred = 1) + sum(n) FILTER (WHERE y_true = 1), 0), 0.0), {R}) AS f1 FROM {conf}"""


def indicator_select(conf: str = "conf") -> str:
    return f"""SELECT round(accuracy, {R}) AS accuracy, round(p, {R}) AS precision, round(r, {R}) AS recall,
  round(2 * p * r / nullif(p + r, 0), {R}) AS f1 FROM (
  SELECT sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n) AS accuracy,
    sum(y_true * n) FILTER (WHERE y_pred = 1) / sum(n) FILTER (WHERE y_pred = 1) AS p,
    sum(y_pred * n) FILTER (WHERE y_true = 1) / sum(n) FILTER (WHERE y_true = 1) AS r FROM {conf})"""


# ---- pruning -------------------------------------------------------------------------------

def prune_ctes() -> str:
    return f"""WITH w AS (SELECT vec_id % 5 AS model_id,
    'layer_' || CAST(vec_id AS VARCHAR) || CASE WHEN vec_id % 2 = 0 THEN '.weight' ELSE '.bias' END AS layer,
    CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
f AS (SELECT DISTINCT model_id, CAST(model_id + 1 AS DOUBLE) / 10 AS pruning_factor FROM w),
kk AS (SELECT w.model_id, CAST(round_even(f.pruning_factor * count(*), 0) AS BIGINT) AS k FROM w JOIN f USING (model_id)
  WHERE contains(layer, '.weight') GROUP BY w.model_id, f.pruning_factor),
rk AS (SELECT model_id, layer, pos, row_number() OVER (PARTITION BY model_id ORDER BY abs(value), layer, pos) AS rn
  FROM w WHERE contains(layer, '.weight')),
pruned AS (SELECT w.model_id, w.layer, w.pos,
  CASE WHEN rk.rn IS NOT NULL AND rk.rn <= kk.k THEN 0.0 ELSE w.value END AS value
  FROM w LEFT JOIN rk USING (model_id, layer, pos) LEFT JOIN kk USING (model_id))
"""


# ---- configuration evaluation, results analysis, variance ---------------------------------

# task name -> label expression over embeddings, as the evaluation defines its tasks
TASKS = {"embeddings": "label", "parity": "label % 2"}


def split_ctes(label: str) -> str:
    return f"""emb_split AS ({split_cte('embeddings', 'vec_id')}),
train AS (SELECT vec_id, embedding, CAST({label} AS INTEGER) AS label FROM emb_split WHERE split = 'val'),
test AS (SELECT vec_id, embedding, CAST({label} AS INTEGER) AS label FROM emb_split WHERE split = 'test')"""


def _plan_ctes(task: str, runs: tuple[int, ...], seed: str) -> str:
    runs_sql = ", ".join(f"({r})" for r in runs)
    rowkey = "CAST(run_id AS VARCHAR) || ':' || CAST(config AS VARCHAR) || ':' || task"
    return f"""cfg AS (SELECT CAST(n_nationkey AS INTEGER) AS config, '{task}' AS task, CAST(1 + 3 * n_regionkey AS INTEGER) AS num_models,
  CAST(n_nationkey % 5 AS DOUBLE) / 10 AS pruning_factor, CAST(r.run_id AS INTEGER) AS run_id
  FROM nation CROSS JOIN (VALUES {runs_sql}) r(run_id)),
chosen AS (SELECT * EXCLUDE (_rk) FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, config ORDER BY {H(seed, f"{rowkey} || ':' || CAST(model_no AS VARCHAR)")}, model_no) AS _rk
  FROM (SELECT *, CAST(unnest(generate_series(0, greatest(10, num_models) - 1)) AS INTEGER) AS model_no FROM cfg))
  WHERE _rk <= num_models),
checked AS (SELECT c.*, c.model_no < 10 AS ok FROM chosen c),
errs AS (SELECT run_id, config, task, 'missing ' || CAST(count(*) FILTER (WHERE NOT ok) AS VARCHAR) || ' of ' ||
  CAST(count(*) AS VARCHAR) || ' models' AS error FROM checked GROUP BY ALL HAVING count(*) FILTER (WHERE NOT ok) > 0)"""


def errors_sql(runs: tuple[int, ...] = (0,), seed: str = "'models'") -> str:
    """Errors of the planted evaluation: no such task, factors out of range (config % 7 = 6), untrained models, bad weights (model 3 of parity)."""
    runs_sql = ", ".join(f"({r})" for r in runs)
    known = " UNION ALL ".join(f"""(WITH {_plan_ctes(t, runs, seed)} SELECT run_id, config, task,
  CASE WHEN config % 7 = 6 THEN 'pruning factor 1.5' WHEN bool_or(NOT ok) THEN 'missing ' || CAST(count(*) FILTER (WHERE NOT ok) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' models'
    WHEN task = 'parity' AND bool_or(model_no = 3) THEN 'model 3: weights not finite' END AS error FROM checked GROUP BY run_id, config, task)""" for t in TASKS)
    return f"""SELECT * FROM ({known} UNION ALL SELECT CAST(r.run_id AS INTEGER), CAST(n_nationkey AS INTEGER), 'sentiment', 'unknown task sentiment'
  FROM nation CROSS JOIN (VALUES {runs_sql}) r(run_id)) WHERE error IS NOT NULL"""


def _evaluate_task(task: str, label: str, runs: tuple[int, ...], seed: str) -> str:
    return f"""(WITH {split_ctes(label)},
{bootstrap_ctes('train', 'vec_id', 10)},
{centroid_ctes('train', 'samples', 'vec_id', ['replica'])},
{_plan_ctes(task, runs, seed)},
valid AS (SELECT c.run_id, c.config, c.task, c.model_no, c.pruning_factor FROM checked c
  WHERE NOT EXISTS (SELECT 1 FROM errs e WHERE e.run_id = c.run_id AND e.config = c.config AND e.task = c.task)),
w AS (SELECT v.run_id, v.config, v.model_no, v.pruning_factor, 'class_' || CAST(c.class_id AS VARCHAR) || '.weight' AS layer,
  c.class_id, c.dim AS pos, c.value FROM valid v JOIN cent c ON c.replica = v.model_no),
kk AS (SELECT run_id, config, model_no, CAST(round_even(any_value(pruning_factor) * count(*), 0) AS BIGINT) AS k FROM w GROUP BY ALL),
rk AS (SELECT w.*, row_number() OVER (PARTITION BY run_id, config, model_no ORDER BY abs(value), layer, pos) AS rn FROM w),
pc AS (SELECT rk.run_id, rk.config, rk.model_no, rk.class_id, rk.pos AS dim, CASE WHEN rk.rn <= kk.k THEN 0.0 ELSE rk.value END AS value
  FROM rk JOIN kk USING (run_id, config, model_no)),
{scoring_ctes('test', 'pc', 'vec_id', ['run_id', 'config', 'model_no'])},
{vote_ctes('probs', 'vec_id', ['run_id', 'config'])},
aligned AS (SELECT p.run_id, p.config, p.vec_id, p.y_pred, t.label AS y_true FROM pred p JOIN test t USING (vec_id)),
conf AS (SELECT run_id, config, y_true, y_pred, count(*) AS n FROM aligned GROUP BY ALL),
{report_ctes('conf', ['run_id', 'config'])}
SELECT run_id, config, '{task}' AS task, accuracy, macro_f1 FROM report)"""


def evaluate_ctes(runs: tuple[int, ...] = (0,), seed: str = "'models'") -> str:
    return "WITH results AS (" + " UNION ALL ".join(_evaluate_task(t, e, runs, seed) for t, e in TASKS.items()) + ")\n"


def consolidated_cte() -> str:
    return """cons AS (SELECT config, task, run_id, n_runs, accuracy, macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY config, task ORDER BY run_id DESC) AS _rk,
    count(*) OVER (PARTITION BY config, task) AS n_runs FROM results) WHERE _rk = 1)"""


def leaderboard_select(src: str = "cons") -> str:
    return f"""SELECT a.task, a.n_configs, a.config AS best_accuracy_config, round(a.accuracy, {R}) AS best_accuracy,
  f.config AS best_f1_config, round(f.macro_f1, {R}) AS best_macro_f1 FROM
  (SELECT *, count(*) OVER (PARTITION BY task) AS n_configs,
     row_number() OVER (PARTITION BY task ORDER BY round_even(accuracy, 9) DESC, config) AS _r FROM {src}) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round_even(macro_f1, 9) DESC, config) AS _r FROM {src}) f
  ON f.task = a.task AND f._r = 1 WHERE a._r = 1"""


def variance_ctes() -> str:
    group = ["task", "row_id", "kind", "i"]
    classes = "CASE t.task WHEN 'CB' THEN {0} % 3 WHEN 'BoolQ' THEN {0} % 2 ELSE {0} // 2 % 2 END"
    return f"""WITH {experiment_ctes()}, {hp_cte()},
cases AS (SELECT c.row_id, c.config, c.model_type AS model_name, c.task, h.weight_decay FROM exp_clean c JOIN hp_first h ON h.model_name = c.model_type AND h.task = c.task
  WHERE c.is_baseline = 0 QUALIFY row_number() OVER (PARTITION BY c.model_type, c.task ORDER BY c.row_id) = 1),
{split_ctes('label')},
{bootstrap_ctes('train', 'vec_id', 10)},
{double_bootstrap_ctes('train', 'vec_id')},
allsamp AS (SELECT 'Single' AS kind, replica AS i, 0 AS j, vec_id, mult FROM samples
  UNION ALL SELECT 'Double', i, j, vec_id, mult FROM dsamples),
tx AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM train),
cent AS (SELECT t.task, t.row_id, s.kind, s.i, s.j, CAST({classes.format('x.label')} AS INTEGER) AS class_id, x.dim, sum(s.mult * x.x) / (sum(s.mult) + 100.0 * any_value(t.weight_decay)) AS value
  FROM allsamp s JOIN tx x USING (vec_id) CROSS JOIN cases t GROUP BY ALL),
{scoring_ctes('test', 'cent', 'vec_id', ['task', 'row_id', 'kind', 'i', 'j'])},
{vote_ctes('probs', 'vec_id', group)},
aligned AS (SELECT t.task, t.row_id, t.kind, t.i, t.y_pred, CAST({classes.format('e.label')} AS INTEGER) AS y_true FROM pred t JOIN test e USING (vec_id)),
conf AS (SELECT task, row_id, kind, i, y_true, y_pred, count(*) AS n FROM aligned GROUP BY ALL),
{report_ctes('conf', group, 'v_')},
report AS (SELECT c.config, c.model_name, v.* EXCLUDE (row_id) FROM v_report v JOIN cases c ON c.row_id = v.row_id)
"""


# ---- trial search ------------------------------------------------------------------------------

# Softmax classifiers as nested lists: x has a 1 at its end, w is a list of classes. ``xt`` holds the columns of ``x``.
_PROBS = ("list_transform(list_transform(z, lambda r: list_transform(r, lambda v: exp(v - list_max(r)))), "
          "lambda e: list_transform(e, lambda v: v / list_sum(e)))")
_SCORES = "list_transform(x, lambda r: list_transform(w, lambda c: list_dot_product(r, c)))"


def _residuals(weight: str = "1.0") -> str:
    return (f"list_transform(range(1, len(w) + 1), lambda c: list_transform(range(1, len(x) + 1), "
            f"lambda i: {weight} * (p[i][c] - CASE WHEN ys[i] = c - 1 THEN 1.0 ELSE 0.0 END)))")


_GRADIENT = "list_transform(r, lambda q: list_transform(xt, lambda k: list_dot_product(k, q)))"


def _zeros(classes: str, dims: str) -> str:
    return f"list_transform(range({classes}), lambda c: list_transform(range({dims}), lambda k: CAST(0.0 AS DOUBLE)))"


def _stepped(w: str, rate: str, scale: str, decay: str) -> str:
    """w - rate * (g / scale + decay * w), without decay of the last (constant) column."""
    return (f"list_transform(range(1, len({w}) + 1), lambda c: list_transform(range(1, len({w}[1]) + 1), lambda k: "
            f"{w}[c][k] - {rate} * (g[c][k] / {scale} + CASE WHEN k < len({w}[1]) THEN {decay} * {w}[c][k] ELSE 0.0 END)))")


def _search_task(task: str, objective: str, families: list[str]) -> str:
    """Mini-batch descent, trial by trial, as one recursive step a batch; for training halves of at most one slice (4,096 rows)."""
    tkey = "CAST(e AS VARCHAR) || ':' || CAST(b AS VARCHAR) || ':' || CAST(t AS VARCHAR)"
    two60 = "1152921504606846976.0"
    keys = ["family", "trial_id"]
    x = "list_append(CAST(embedding AS DOUBLE[]), 1.0)"
    chosen = ", ".join(f"'{f}'" for f in families)
    return f"""(WITH RECURSIVE {split_ctes(TASKS[task])},
families AS (SELECT * FROM (VALUES ('roberta', 'trial', [3, 5], [32, 16], 5), ('distilroberta', 'trial-distilroberta', [9, 11], [16, 32], 5),
  ('gpt2', 'trial-gpt2', [2], [16, 32], 3), ('deberta', 'trial-deberta', [5], [16], 3)) f(family, seed, es, bs, n) WHERE family IN ({chosen})),
grid AS (SELECT family, seed, e, b, CAST(unnest(range(n)) AS INTEGER) AS t FROM (
  SELECT family, seed, n, e, CAST(unnest(bs) AS INTEGER) AS b FROM (
  SELECT family, seed, n, bs, CAST(unnest(es) AS INTEGER) AS e FROM families))),
trials AS (SELECT family, 'e-' || CAST(e AS VARCHAR) || '-b-' || CAST(b AS VARCHAR) || '-t-' || CAST(t AS VARCHAR) AS trial_id,
  e AS epochs, b AS batch,
  0.00001 + (0.00005 - 0.00001) * (CAST({H("seed || '-lr'", tkey)} AS DOUBLE) / {two60}) AS learning_rate,
  CASE WHEN family = 'deberta' THEN CAST(0.01 AS DOUBLE)
    ELSE 0.005 + (0.2 - 0.005) * (CAST({H("seed || '-wd'", tkey)} AS DOUBLE) / {two60}) END AS weight_decay FROM grid),
ordered AS (SELECT {x} AS x, label, row_number() OVER (ORDER BY {H("'sgd'", "vec_id")}, vec_id) - 1 AS pos FROM train),
batches AS (SELECT batch, CAST(pos // batch AS INTEGER) AS step, list(x ORDER BY pos) AS x, list(label ORDER BY pos) AS ys
  FROM ordered CROSS JOIN (SELECT DISTINCT batch FROM trials) GROUP BY ALL),
turned AS (SELECT *, list_transform(range(1, len(x[1]) + 1), lambda k: list_transform(x, lambda r: r[k])) AS xt FROM batches),
sizes AS (SELECT (SELECT max(label) + 1 FROM train) AS classes, (SELECT len(x) FROM ordered LIMIT 1) AS dims),
lengths AS (SELECT batch, count(*) AS steps FROM batches GROUP BY batch),
descent(family, trial_id, batch, rate, decay, last, step, w) AS (
  SELECT family, trial_id, t.batch, 40000.0 * learning_rate, weight_decay, epochs * steps, CAST(0 AS BIGINT), {_zeros('classes', 'dims')}
  FROM trials t JOIN lengths l ON l.batch = t.batch CROSS JOIN sizes
  UNION ALL SELECT family, trial_id, batch, rate, decay, last, step + 1, {_stepped('w', 'rate', 'len(x)', 'decay')} FROM (
    SELECT *, {_GRADIENT} AS g FROM (SELECT *, {_residuals()} AS r FROM (SELECT *, {_PROBS} AS p FROM (
      SELECT d.*, b.x, b.xt, b.ys, list_transform(b.x, lambda r: list_transform(d.w, lambda c: list_dot_product(r, c))) AS z FROM descent d JOIN lengths l ON l.batch = d.batch
      JOIN turned b ON b.batch = d.batch AND b.step = d.step % l.steps WHERE d.step < d.last))))),
models AS (SELECT family, trial_id, w FROM descent WHERE step = last),
scores AS (SELECT family, trial_id, vec_id, label, list_transform(w, lambda c: list_dot_product({x}, c)) AS z FROM models CROSS JOIN test),
shares AS (SELECT family, trial_id, vec_id, label, list_transform(e, lambda v: v / list_sum(e)) AS p
  FROM (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM scores)),
aligned AS (SELECT family, trial_id, label AS y_true, p[label + 1] AS own, list_position(list_transform(p, lambda v: round(v, 9)), round(list_max(p), 9)) - 1 AS y_pred FROM shares),
conf AS (SELECT family, trial_id, y_true, y_pred, count(*) AS n FROM aligned GROUP BY ALL),
{report_ctes('conf', keys)},
logs AS (SELECT family, trial_id, avg(-ln(own)) AS loss FROM aligned GROUP BY ALL)
SELECT '{task}' AS task, CASE WHEN t.family = 'deberta' THEN 'accuracy' ELSE '{objective}' END AS metric, t.*, r.accuracy,
  CASE WHEN t.family = 'deberta' THEN r.accuracy ELSE r.{objective} END AS objective, g.loss
FROM trials t JOIN report r USING (family, trial_id) JOIN logs g USING (family, trial_id))"""


def search_ctes(families: list[str] | None = None) -> str:
    families = families or ["roberta", "distilroberta", "gpt2", "deberta"]
    return "WITH scored AS (" + _search_task("embeddings", "macro_f1", families) + " UNION ALL " + _search_task("parity", "accuracy", families) + ")\n"


# ---- logistic regression -----------------------------------------------------------------------

def hyperparams_values() -> str:
    from quiver.plans.derived import DEBERTA_HYPERPARAMS

    return ", ".join(f"('{m}', '{t}', CAST({wd} AS DOUBLE))" for m, t, _, _, _, wd in DEBERTA_HYPERPARAMS)


def logistic_ctes(replicas: int = 5, steps: int = 320) -> str:
    """CTEs train, test, fitted(model_name, task, replica, w): accelerated full-batch descent to the regularised optimum."""
    x = "list_append(CAST(t.embedding AS DOUBLE[]), 1.0)"
    return f"""WITH RECURSIVE {split_ctes('label')},
{bootstrap_ctes('train', 'vec_id', replicas)},
hp AS (SELECT * FROM (VALUES {hyperparams_values()}) h(model_name, task, weight_decay)),
data AS (SELECT s.replica, list({x} ORDER BY t.vec_id) AS x, list(t.label ORDER BY t.vec_id) AS ys, list(CAST(s.mult AS DOUBLE) ORDER BY t.vec_id) AS ms, CAST(sum(s.mult) AS DOUBLE) AS total
  FROM samples s JOIN train t USING (vec_id) GROUP BY s.replica),
turned AS (SELECT *, list_transform(range(1, len(x[1]) + 1), lambda k: list_transform(x, lambda r: r[k])) AS xt FROM data),
sizes AS (SELECT (SELECT max(label) + 1 FROM train) AS classes, (SELECT len(x[1]) FROM data LIMIT 1) AS dims),
penalties AS (SELECT DISTINCT weight_decay AS decay FROM hp),
descent(replica, decay, step, v, w) AS (
  SELECT replica, decay, 0, {_zeros('classes', 'dims')}, {_zeros('classes', 'dims')} FROM data CROSS JOIN penalties CROSS JOIN sizes
  UNION ALL SELECT replica, decay, step + 1, next, list_transform(range(1, len(next) + 1), lambda c: list_transform(range(1, len(next[1]) + 1), lambda k:
      next[c][k] + (1 - sqrt(decay / (1.0 + decay))) / (1 + sqrt(decay / (1.0 + decay))) * (next[c][k] - v[c][k]))) FROM (
    SELECT *, {_stepped('w', '(1 / (1.0 + decay))', 'total', 'decay')} AS next FROM (
    SELECT *, {_GRADIENT} AS g FROM (SELECT *, {_residuals('ms[i]')} AS r FROM (SELECT *, {_PROBS} AS p FROM (
      SELECT d.*, b.x, b.xt, b.ys, b.ms, b.total, list_transform(b.x, lambda r: list_transform(d.w, lambda c: list_dot_product(r, c))) AS z
      FROM descent d JOIN turned b USING (replica) WHERE d.step < {steps})))))),
fitted AS (SELECT hp.model_name, hp.task, d.replica, d.v AS w FROM descent d JOIN hp ON hp.weight_decay = d.decay WHERE d.step = {steps})
"""


def logistic_report_select() -> str:
    keys = ["model_name", "task"]
    return f""", scores AS (SELECT model_name, task, replica, vec_id, label, list_transform(w, lambda c: list_dot_product(list_append(CAST(embedding AS DOUBLE[]), 1.0), c)) AS z FROM fitted CROSS JOIN test),
shares AS (SELECT model_name, task, replica, vec_id, label, list_transform(e, lambda v: v / list_sum(e)) AS p FROM (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM scores)),
cells AS (SELECT model_name, task, vec_id, label, unnest(p) AS prob, unnest(range(len(p))) AS class_id FROM shares),
probs AS (SELECT model_name, task, vec_id, class_id, prob FROM cells),
{vote_ctes('probs', 'vec_id', keys)},
aligned AS (SELECT p.model_name, p.task, p.y_pred, t.label AS y_true FROM pred p JOIN test t USING (vec_id)),
conf AS (SELECT model_name, task, y_true, y_pred, count(*) AS n FROM aligned GROUP BY ALL),
{report_ctes('conf', keys)}
""" + report_select("report", keys)
