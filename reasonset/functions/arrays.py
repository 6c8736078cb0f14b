"""Token-level arrays of sampled sequences."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def training_arrays(tokens: Column, prompt_length: Column, logprobs: Column, advantage: Column) -> Column:
    """Struct of next-token arrays: inputs, targets, and logprobs and advantages over the inputs.

    The prompt's positions get zeros. ``lengths_ok`` tells whether the four arrays are equally
    long, which fails when the sampled logprobs do not fit the tokens.
    """
    size = F.size(tokens)
    observed = prompt_length - 1
    zeros = F.array_repeat(F.lit(0.0), observed.cast("int"))
    inputs = F.slice(tokens, F.lit(1), size - 1)
    targets = F.slice(tokens, F.lit(2), size - 1)
    all_logprobs = F.concat(zeros, logprobs.cast("array<double>"))
    all_advantages = F.concat(zeros, F.array_repeat(advantage.cast("double"), (size - 1 - observed).cast("int")))
    return F.struct(
        inputs.alias("inputs"),
        targets.alias("targets"),
        all_logprobs.alias("logprobs"),
        all_advantages.alias("advantages"),
        ((F.size(all_logprobs) == size - 1) & (F.size(all_advantages) == size - 1)).alias("lengths_ok"),
    )


def total(values: Column) -> Column:
    return F.aggregate(values.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    """Sum of the products of two equally long arrays."""
    return total(F.zip_with(left.cast("array<double>"), right.cast("array<double>"), lambda a, b: a * b))
