"""Planning prompts: templates, variants, models, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variants(templates: DataFrame) -> DataFrame:
    """Each template with each combination of its list variables: ``variables`` as map<string,string>.

    ``templates`` has ``variables`` as map<string, array<string>>, scalars as arrays of one.
    """
    start = F.array(F.create_map().cast("map<string,string>"))
    entries = F.array_sort(F.map_entries("variables"))
    grown = F.aggregate(entries, start, lambda acc, e: F.flatten(F.transform(acc, lambda m: F.transform(e["value"], lambda v: F.map_concat(m, F.map_from_entries(F.array(F.struct(e["key"], v))))))))
    return templates.withColumn("variables", F.explode(grown))


def rendered(template: Column, variables: Column) -> Column:
    """``{name}`` filled in, doubled braces as single ones; the template is cut once, so values aren't read again.

    A name without a value stays as it is.
    """
    parts = F.regexp_extract_all(template, F.lit(r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"), F.lit(0))
    value = lambda p: F.try_element_at(variables, F.substring(p, F.lit(2), F.length(p) - 2))
    fill = lambda p: F.when(p == "{{", "{").when(p == "}}", "}").when(p.startswith("{") & (F.length(p) > 2), F.coalesce(value(p), p)).otherwise(p)
    return F.array_join(F.transform(parts, fill), "")


def enabled(templates: DataFrame) -> DataFrame:
    on = ~F.coalesce(F.col("disabled"), F.lit(False)) & F.coalesce(F.col("enabled"), F.lit(True))
    return templates.where(on).withColumn("samples", F.greatest(F.coalesce(F.col("samples").cast("int"), F.lit(1)), F.lit(1)))


def provider(model: Column) -> Column:
    return F.when(model.startswith("claude-"), "anthropic").when(model.rlike(r"^(gpt-|o\d)"), "openai").otherwise("together")


def model_type(model: Column) -> Column:
    return F.when(provider(model) == "together", "open").otherwise("closed")


def requests(templates: DataFrame, models: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Every (variant, model, sample) that a template asks for and that isn't done. Models are a short list."""
    v = variants(enabled(templates)).withColumn("prompt_text", rendered(F.col("user"), F.col("variables")))
    fits = F.col("model_type").isNull() | (F.col("model_type") == model_type(F.col("model")))
    out = v.join(F.broadcast(models), fits).withColumn("sample", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)))
    out = out.withColumn("variables_key", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("variables")))))
    keys = ["id", "model", "variables_key", "sample"]
    return out if done is None else out.join(done.select(*keys), keys, "left_anti")


def pick_model(models: DataFrame, part: str) -> str:
    """The one model whose name holds ``part``, whatever the case."""
    found = [r[0] for r in models.where(F.lower("model").contains(part.lower())).select("model").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{part!r} fits {'no model' if not found else 'more than one'}")
    return found[0]
