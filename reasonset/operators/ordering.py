"""Training order: exact splits, curricula over epochs, and batches."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import NUMBERS, key_bytes
from ..functions.schedule import due, lr_multiplier
from .position import first_n, hash_bucket, hash_key, hash_order, hashed_cutoff, key_text, range_bucket, sampled_bucket, with_position
from .predicates import missing_difficulty


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    """The table once per epoch, from one scan."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 0 else df.withColumn(
        "epoch", F.lit(0)
    ).limit(0)


def train_test_split(
    df: DataFrame, train_fraction: float = 0.9, seed: int = 42, key: str | Sequence[str] = "id"
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts, the first with exactly ``floor(train_fraction * rows)`` rows.

    The parts depend on keys and seed alone. They are filters of the table on one constant, the
    hash of the last training row, so that no row is moved to split it.
    """
    take = F.floor(F.lit(train_fraction) * F.col("_total"))
    last = hashed_cutoff(df, key, seed, take)
    in_train = F.coalesce(hash_key(key_text(df, key), seed) <= last, F.lit(False))
    return df.filter(in_train), df.filter(~in_train)


def subsample(df: DataFrame, n: int, seed: int = 42, key: str | Sequence[str] = "id") -> DataFrame:
    """The first ``n`` rows in seeded random order of their keys; all rows when there are fewer.

    NULL keys and ties are those of :func:`first_n`; the order of the result is not defined.
    """
    hashed = df.withColumn("_hash", hash_key(key_text(df, key), seed))
    return first_n(hashed, n, "_hash").drop("_hash")


def head(df: DataFrame, n: int, key: str | Sequence[str] = "id") -> DataFrame:
    """The first ``n`` rows in key order; see :func:`first_n`."""
    return first_n(df, n, key)


def global_position(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Every row's place in the seeded random order of its key."""
    hashed = df.withColumn("_hash", hash_order(F.col(key), seed))
    return with_position(hashed, [F.col("_hash"), F.col(key)], [hash_bucket(F.col("_hash"))]).drop("_hash")


def curriculum(
    df: DataFrame,
    mode: str,
    epochs: int,
    seed: int = 42,
    key: str | Sequence[str] = "id",
    difficulty: str = "difficulty",
    n_rows: Column | None = None,
) -> DataFrame:
    """The rows of all epochs with ``epoch`` and their ``position`` in the training order.

    ``none``: stored order in each epoch. ``easy_to_hard``: by difficulty in each epoch, ties in
    stored order. ``first_epoch_only``: by difficulty in epoch 0, then a new random order per
    epoch. ``grouped_shuffle``: all epochs together, by difficulty, random inside a difficulty.
    The stored order is that of the keys, unique together. All modes but ``none`` fail on a row without
    difficulty. ``n_rows`` saves a count where the number of rows is known. Difficulties are sort keys and never buckets: any number
    of them, also one per row, is cut into the same even ranges.
    """
    if mode not in ("none", "easy_to_hard", "first_epoch_only", "grouped_shuffle"):
        raise ValueError(f"unknown curriculum mode: {mode}")
    if mode != "none":
        message = F.lit("a curriculum needs a difficulty in every row")
        checked = F.when(missing_difficulty(df, difficulty), F.raise_error(message).cast(df.schema[difficulty].dataType))
        df = df.withColumn(difficulty, checked.otherwise(F.col(difficulty)))
    keys = [key] if isinstance(key, str) else list(key)
    if mode in ("none", "easy_to_hard"):
        levels = [difficulty] if mode == "easy_to_hard" else []
        return _same_every_epoch(df, epochs, keys, levels, row_count(df) if n_rows is None else n_rows)
    names = [F.col(k) for k in keys]
    if mode == "grouped_shuffle":
        hashed = hash_order(F.concat_ws(":", key_text(df, key), F.col("epoch")), seed)
        placed = F.concat(key_bytes(df.schema, [difficulty]), hashed)
        rows = repeat_epochs(df, epochs).withColumn("_k", placed)
        # The hashes of one epoch are spread as those of all are.
        ranges = sampled_bucket(df.withColumn("epoch", F.lit(0)).select(placed.alias("_k")), "_k", times=epochs)
        return with_position(rows, [F.col("_k"), *names, F.col("epoch")], [ranges]).drop("_k")
    first = F.col("epoch") == 0
    hashed = hash_order(key_text(df, key), F.lit(seed) + F.col("epoch"))
    rows = repeat_epochs(df, epochs).withColumn("_hash", F.when(~first, hashed))
    easy = df.withColumn("_k", key_bytes(df.schema, [difficulty, *keys]))
    rows = rows.withColumn("_k", F.when(first, key_bytes(df.schema, [difficulty, *keys])))
    buckets = [F.col("epoch"), F.when(first, sampled_bucket(easy, "_k")), F.when(~first, hash_bucket(F.col("_hash")))]
    return with_position(rows, [F.col("_hash"), F.col("_k"), *names], buckets).drop("_hash", "_k")


def _same_every_epoch(df: DataFrame, epochs: int, keys: list[str], levels: list[str], n_rows: Column) -> DataFrame:
    """Ranks the rows once and shifts the positions for each epoch."""
    if not levels and len(keys) == 1 and df.schema[keys[0]].dataType.typeName() in NUMBERS:
        placed = with_position(df, [F.col(keys[0])], [range_bucket(df, keys[0])])
    else:
        keyed = df.withColumn("_k", key_bytes(df.schema, [*levels, *keys]))
        placed = with_position(keyed, [F.col("_k")], [sampled_bucket(keyed, "_k")]).drop("_k")
    shifted = F.col("position") + F.col("epoch") * n_rows
    return repeat_epochs(placed, epochs).withColumn("position", shifted)


def assign_batches(df: DataFrame, n_rows: int | Column, batch_size: int, epochs: int) -> DataFrame:
    """The training step and slot of each position, with the logged epoch and progress.

    There are ``n_rows // batch_size`` steps per epoch. Steps run over the epochs' rows as one
    sequence, so that what is left over at the end of an epoch moves into the next one's first
    batch; positions after the last step are dropped. ``logged_epoch`` counts steps, not passes.
    """
    n_rows = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    sized = df.withColumn("_per_epoch", F.floor(n_rows / batch_size).cast("long"))
    step = F.floor(F.col("position") / batch_size).cast("long")
    total = F.col("_per_epoch") * epochs
    kept = sized.withColumn("step", step).filter(F.col("step") < total)
    return kept.withColumns(
        {
            "slot": (F.col("position") % batch_size).cast("long"),
            "logged_epoch": F.floor(F.col("step") / F.col("_per_epoch")).cast("long"),
            "progress": F.least((F.col("step") + 1) / F.greatest(total, F.lit(1)), F.lit(1.0)),
            "total_steps": total,
        }
    ).drop("_per_epoch")


def with_schedule(
    df: DataFrame,
    total_steps: int | Column,
    learning_rate: float = 1e-5,
    eval_every: int = 5,
    infrequent_eval_every: int = 20,
    save_every: int = 20,
    warmup_ratio: float = 0.1,
) -> DataFrame:
    """Adds a step's learning rate and whether it evaluates or saves."""
    step = F.col("step")
    return df.withColumns(
        {
            "learning_rate": F.lit(learning_rate) * lr_multiplier(step, total_steps, warmup_ratio),
            "eval_due": due(step, eval_every),
            "infrequent_eval_due": due(step, infrequent_eval_every),
            "save_due": due(step, save_every) & (step > 0),
        }
    )
