"""Names of subsets and runs, and what can be read back from them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import let


def subset_name(
    source: Column, domain: Column, max_tokens: Column, max_assistant_tokens: Column, limit: Column, prefix: str = "corpus"
) -> Column:
    source_part = F.when(source == "all", "all_sources").otherwise(F.translate(source, "/-", "__"))
    domain_part = F.when(domain == "all", "all_domains").otherwise(domain)
    assistant_part = F.when(
        max_assistant_tokens.isNotNull() & (max_assistant_tokens != 0),
        F.concat(F.lit("_at"), max_assistant_tokens.cast("string")),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit(prefix + "_"), domain_part, F.lit("_"), source_part,
        F.lit("_t"), max_tokens.cast("string"), assistant_part, F.lit("_n"), limit.cast("string"),
    )


def run_name(
    dataset: Column, split: Column, batch_size: Column, learning_rate: Column, epochs: Column,
    rank: Column, mode: Column, model: Column,
) -> Column:
    """``split`` and ``learning_rate`` are texts, so that the caller fixes how numbers look."""
    mode_part = F.when(mode == "none", "").otherwise(F.concat(F.lit("_c"), mode))
    return F.concat(
        dataset, F.lit("_s"), split, F.lit("_bs"), batch_size.cast("string"), F.lit("_lr"), learning_rate,
        F.lit("_e"), epochs.cast("string"), F.lit("_r"), rank.cast("string"), mode_part,
        F.lit("_"), F.replace(model, F.lit("/"), F.lit("_")),
    )


def run_config(name: Column) -> Column:
    """Struct of a run's parameters; the rank and curriculum parts may be missing.

    All fields are NULL when the name has another form.
    """
    # One match gives all groups: they replace the name, with a mark between them.
    mark = "\u0001"
    marked = F.regexp_replace(name, fixed.RUN_CONFIG, mark.join(f"${i}" for i in range(1, 9)))

    def fields(parts: Column) -> Column:
        matched = F.size(parts) == 8

        def part(group: int) -> Column:
            return F.when(matched, F.nullif(F.get(parts, F.lit(group - 1)), F.lit("")))

        return F.struct(
            part(1).alias("dataset"),
            part(2).try_cast("double").alias("train_split"),
            part(3).try_cast("long").alias("batch_size"),
            part(4).try_cast("double").alias("learning_rate"),
            part(5).try_cast("long").alias("epochs"),
            part(6).try_cast("long").alias("rank"),
            F.when(matched, F.coalesce(part(7), F.lit("none"))).alias("curriculum"),
            F.regexp_replace(part(8), "^([^_]*)_", "$1/").alias("model"),
        )

    return let(F.split(marked, mark), fields)


def max_tokens_of(dataset: Column) -> Column:
    """The token budget written in a subset's name, for when its metadata is gone."""
    return F.regexp_extract(dataset, r"_t([^_]*)", 1).try_cast("long")


def _folder(name: Column) -> Column:
    """A folder name without a leading ``column=``, and without escapes."""
    plain = F.regexp_replace(name, "^(config|run|eval)=", "")
    return F.url_decode(F.url_decode(F.replace(plain, F.lit("+"), F.lit("%252B"))))


def run_keys(path: Column) -> Column:
    """Struct (config, run, eval, step) from a result file's path.

    Paths are ``config/run/eval/step_000005/file.jsonl``, or the same with ``column=value``
    folders. Files right under the eval folder get step -1. A step folder without a number gives a
    NULL step, and such rows are to be left out.
    """
    parts = F.split(path, "/")
    folder = F.try_element_at(parts, F.lit(-2))
    stepped = F.coalesce(folder.rlike("^step[_=]"), F.lit(False))
    step = F.when(stepped, F.substr(folder, F.lit(len("step_") + 1)).try_cast("long")).otherwise(F.lit(-1).cast("long"))

    def above(levels: int) -> Column:
        return _folder(F.try_element_at(parts, F.when(stepped, -levels - 2).otherwise(-levels - 1)))

    return F.struct(above(3).alias("config"), above(2).alias("run"), above(1).alias("eval"), step.alias("step"))


def model_type(model: Column) -> Column:
    return (
        F.when(F.contains(model, F.lit("-Instruct")), "Instruct")
        .when(F.contains(model, F.lit("-Base")), "Base")
        .otherwise("Full")
    )


def model_name(path: Column, prefix: str = "corpus_") -> Column:
    """The model at the end of the first path part that names a run and holds a model; else ``Unknown``."""
    parts = F.filter(
        F.split(path, "/"), lambda p: F.startswith(p, F.lit(prefix)) & p.rlike(fixed.MODEL_SUFFIX)
    )
    suffix = F.regexp_extract(F.try_element_at(parts, F.lit(1)), fixed.MODEL_SUFFIX, 1)
    return F.coalesce(F.replace(suffix, F.lit("_"), F.lit("/")), F.lit("Unknown"))
