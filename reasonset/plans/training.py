"""A training plan: which example is used at which step, and what the step does."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordering
from ..session import saved_once


def training_plan(
    df: DataFrame,
    train_fraction: float = 0.9,
    mode: str = "none",
    epochs: int = 5,
    batch_size: int = 32,
    seed: int = 42,
    learning_rate: float = 1e-5,
    eval_every: int = 5,
    infrequent_eval_every: int = 20,
    save_every: int = 20,
    key: str | Sequence[str] = "id",
) -> DataFrame:
    """The training part in its order, with step, slot, learning rate and flags.

    Give it keys and difficulties only, and join the texts to a step's keys when it is trained.
    """
    # Written once: the order asks for its rows several times.
    train = saved_once(ordering.train_test_split(df, train_fraction, seed, key)[0], "training-keys")
    n_train = F.floor(F.lit(train_fraction) * ordering.row_count(df))
    ordered = ordering.curriculum(train, mode, epochs, seed, key, n_rows=n_train)
    batches = ordering.assign_batches(ordered, n_train, batch_size, epochs)
    return ordering.with_schedule(
        batches, F.col("total_steps"), learning_rate, eval_every, infrequent_eval_every, save_every
    )
