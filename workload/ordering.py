"""Splits, curricula, batches and schedules."""

from pyspark.sql import functions as F

from reasonset.operators import ordering

from . import views
from .registry import query
from .views import TRAIN

SEED, EPOCHS, BATCH = 42, 3, 32


def _hash(seed, key):
    return f"md5(concat({seed}, ':', {key}))"


@query(f"SELECT event_id, row_number() OVER (ORDER BY {_hash(SEED, 'event_id')}, event_id) - 1 AS position FROM events")
def global_position(spark, sf_dir):
    return ordering.global_position(views.table(spark, sf_dir, "events").select("event_id"), "event_id", SEED)


@query(f"WITH {TRAIN} SELECT id, CAST(epoch AS INT) AS epoch FROM train, range({EPOCHS}) r(epoch)")
def repeat_epochs(spark, sf_dir):
    return ordering.repeat_epochs(views.train(spark, sf_dir), EPOCHS).select("id", "epoch")


_SPLIT = f"""WITH {TRAIN}, placed AS (SELECT *, row_number() OVER (ORDER BY {_hash(SEED, 'id')}, id) AS rn,
 count(*) OVER () AS n FROM train) SELECT id, difficulty FROM placed WHERE rn"""


@query(f"{_SPLIT} <= floor(0.9E0 * n)")
def train_split(spark, sf_dir):
    return ordering.train_test_split(views.train(spark, sf_dir), 0.9, SEED)[0]


@query(f"{_SPLIT} > floor(0.9E0 * n)")
def test_split(spark, sf_dir):
    return ordering.train_test_split(views.train(spark, sf_dir), 0.9, SEED)[1]


@query(f"WITH {TRAIN} SELECT id FROM train ORDER BY {_hash(7, 'id')}, id LIMIT 200")
def subsample(spark, sf_dir):
    return ordering.subsample(views.train(spark, sf_dir), 200, 7).select("id")


@query(f"WITH {TRAIN} SELECT id FROM train ORDER BY id LIMIT 200")
def head(spark, sf_dir):
    return ordering.head(views.train(spark, sf_dir), 200).select("id")


@query("SELECT l_shipdate, count(*) AS n FROM (SELECT l_shipdate FROM lineitem ORDER BY l_shipdate LIMIT 20000) t GROUP BY 1")
def head_repeated(spark, sf_dir):
    # A key with many rows each, and a limit above 10,000; how many rows of each key there are does not depend on ties.
    rows = views.table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return ordering.head(rows, 20_000, key="l_shipdate").groupBy("l_shipdate").agg(F.count("*").alias("n"))


_EPOCHS = f"WITH {TRAIN}, epochs AS (SELECT id, difficulty, CAST(epoch AS INT) AS epoch FROM train, range({EPOCHS}) r(epoch))"
_PLACED = _EPOCHS + " SELECT id, epoch, row_number() OVER (ORDER BY {order}) - 1 AS position FROM epochs"

_ORDERS = {
    "none": "epoch, id",
    "easy_to_hard": "epoch, difficulty, id",
    "first_epoch_only": "epoch, CASE WHEN epoch = 0 THEN difficulty END,"
    f" CASE WHEN epoch > 0 THEN {_hash(f'{SEED} + epoch', 'id')} END, id",
    "grouped_shuffle": f"difficulty, {_hash(SEED, '''concat(id, ':', epoch)''')}, id",
}
_NAMES = {
    "none": "curriculum_none",
    "easy_to_hard": "curriculum_easy",
    "first_epoch_only": "curriculum_first",
    "grouped_shuffle": "curriculum_grouped",
}


def _curriculum(mode):
    def run(spark, sf_dir):
        return ordering.curriculum(views.train(spark, sf_dir), mode, EPOCHS, SEED).select("id", "epoch", "position")

    query(_PLACED.format(order=_ORDERS[mode]), _NAMES[mode])(run)


for _mode in _ORDERS:
    _curriculum(_mode)


@query(
    f"{_EPOCHS}, placed AS (SELECT id, epoch, row_number() OVER (ORDER BY {_ORDERS['easy_to_hard']}) - 1 AS position"
    f" FROM epochs), sized AS (SELECT *, (SELECT count(*) FROM train) // {BATCH} AS per_epoch FROM placed)"
    f" SELECT id, epoch, position, position // {BATCH} AS step, position % {BATCH} AS slot,"
    f" (position // {BATCH}) // per_epoch AS logged_epoch, per_epoch * {EPOCHS} AS total_steps,"
    f" round(least((position // {BATCH} + 1) / CAST(per_epoch * {EPOCHS} AS DOUBLE), 1.0E0), 9) AS progress"
    f" FROM sized WHERE position // {BATCH} < per_epoch * {EPOCHS}"
)
def assign_batches(spark, sf_dir):
    rows = views.train(spark, sf_dir)
    placed = ordering.curriculum(rows, "easy_to_hard", EPOCHS, SEED)
    batches = ordering.assign_batches(placed, ordering.row_count(rows), BATCH, EPOCHS).drop("difficulty")
    return batches.withColumn("progress", F.round("progress", 9))


@query(
    f"WITH {TRAIN}, t AS (SELECT id AS step, count(*) OVER () AS total,"
    " CAST(floor(0.1E0 * count(*) OVER ()) AS BIGINT) AS warmup FROM train)"
    " SELECT step, round(CASE WHEN step < warmup THEN CAST(step AS DOUBLE) / warmup"
    " ELSE 0.5E0 * (1 + cos(pi() * (step - warmup) / CAST(total - warmup AS DOUBLE))) END, 9) AS learning_rate,"
    " step % 5 = 0 AS eval_due, step % 20 = 0 AS infrequent_eval_due, step % 20 = 0 AND step > 0 AS save_due FROM t"
)
def with_schedule(spark, sf_dir):
    # Each row's number is taken as a step of a plan that has as many steps as there are rows.
    steps = views.train(spark, sf_dir).select(F.col("id").alias("step"))
    planned = ordering.with_schedule(steps, ordering.row_count(steps), learning_rate=1.0)
    return planned.withColumn("learning_rate", F.round("learning_rate", 9))


@query(
    f"""WITH {TRAIN}, split AS (SELECT *, row_number() OVER (ORDER BY {_hash(SEED, 'id')}, id) AS rn, count(*) OVER () AS n FROM train),
 tr AS (SELECT id, difficulty FROM split WHERE rn <= floor(0.9E0 * n)), epochs AS (SELECT id, difficulty, CAST(epoch AS INT) AS epoch
  FROM tr, range({EPOCHS}) r(epoch)), placed AS (SELECT *, row_number() OVER (ORDER BY {_ORDERS['grouped_shuffle']}) - 1 AS position
  FROM epochs), sized AS (SELECT *, (SELECT count(*) FROM tr) // {BATCH} AS per_epoch FROM placed)
 SELECT id, difficulty, epoch, position // {BATCH} AS step, position % {BATCH} AS slot FROM sized
 WHERE position // {BATCH} < per_epoch * {EPOCHS}"""
)
def training_plan(spark, sf_dir):
    from reasonset.plans.training import training_plan as plan

    planned = plan(views.train(spark, sf_dir), 0.9, "grouped_shuffle", EPOCHS, BATCH, SEED)
    return planned.select("id", "difficulty", "epoch", "step", "slot")
