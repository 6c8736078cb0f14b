"""Prompt texts per kind of problem, and the fixed option order of choice problems."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import fill


def _letter(place: Column) -> Column:
    """The letter of an option, counted from 1; empty for 0, and an error beyond the four letters of the prompts."""
    return F.when(place > 4, F.raise_error(F.lit("more than four options"))).otherwise(F.substr(F.lit("ABCD"), place, F.lit(1)))


def math_prompt(problem: Column) -> Column:
    return fill(fixed.MATH_PROMPT, problem=problem)


def choice_prompt(question: Column, options: Column) -> Column:
    """``options`` is the array of option texts in the order they are shown."""
    lines = F.transform(
        options,
        lambda text, i: fill(fixed.CHOICE_OPTION, letter=_letter(i + 1), option=text),
    )
    return fill(fixed.CHOICE_PROMPT, question=question, options=F.array_join(lines, "\n"))


def code_prompt(problem: Column, is_stdin: Column) -> Column:
    return F.when(is_stdin, fill(fixed.CODE_STDIN_PROMPT, problem=problem)).otherwise(
        fill(fixed.CODE_FUNCTION_PROMPT, problem=problem)
    )


def word_prompt(question: Column) -> Column:
    """A chat: one worked example, then the question, as messages."""
    def say(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("text"))

    return F.array(
        say("user", F.lit(fixed.WORD_EXAMPLE_USER)),
        say("assistant", F.lit(fixed.WORD_EXAMPLE_ASSISTANT)),
        say("user", fill(fixed.WORD_PROMPT, question=question)),
    )


def shuffle_options(question: Column, options: Column, seed: int = 42) -> Column:
    """The options in an order that depends on the question and the seed only."""
    keyed = F.transform(
        options,
        lambda text, i: F.struct(
            F.md5(F.concat(F.lit(f"{seed}:"), question, F.lit(":"), i.cast("string"))).alias("key"), text.alias("text")
        ),
    )
    return F.transform(F.array_sort(keyed), lambda o: o["text"])


def answer_letter(options: Column, correct: Column) -> Column:
    """The letter of the first option equal to the right answer."""
    return _letter(F.array_position(options, correct).cast("int"))
