"""Per-step plan values: learning rate and the flags for evaluating and saving."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_multiplier(step: Column, total_steps: int | Column, warmup_ratio: float = 0.1) -> Column:
    """Linear warm-up from 0 to 1, then a cosine down to 0 at ``total_steps``."""
    total = F.lit(total_steps) if isinstance(total_steps, int) else total_steps
    warmup = F.floor(F.lit(warmup_ratio) * total)
    progress = F.try_divide((step - warmup).cast("double"), (total - warmup).cast("double"))
    decay = (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)) * 0.5
    return F.when(step < warmup, F.try_divide(step.cast("double"), warmup.cast("double"))).otherwise(decay)


def due(step: Column, every: int) -> Column:
    """Whether something done every ``every`` steps is due; never when ``every`` is 0."""
    return step % every == 0 if every > 0 else F.lit(False)
