"""Parsing and rule columns for catalogs, configurations and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def schedules(step: Column, last: Column) -> dict[str, Column]:
    """A linear ramp, an exponential decay and a log-linear learning rate that ends at step ``last``."""
    import math

    share = step / last.cast("double")
    return {"ramp": F.least(F.lit(1.0), step / 50.0), "decay": F.exp(-step / 40.0), "lr": F.exp(math.log(0.01) * (1 - share) + math.log(0.0001) * share)}


def chirp(i: Column, start: Column, slope: float, rate: float) -> Column:
    """Sample i (from 0) of a linear frequency sweep from ``start`` by ``slope`` hertz a sample: the cosine of the phase, the sum of the
    frequencies so far, which is a polynomial of i; so a sample needs no other sample."""
    phase = (i + 1) * start + slope / 2 * i * (i + 1)
    return F.cos(2 * F.pi() * phase / rate)


def completeness(*flags: Column) -> Column:
    return sum((f.cast("int") * 25 for f in flags[1:]), flags[0].cast("int") * 25)


def suitability() -> Column:
    size = F.when(F.col("n_chars") > 5000, 40).when(F.col("n_chars") > 1000, 25).otherwise(5)
    return F.least(F.lit(100), size + F.when(F.col("lang") == "en", 30).otherwise(10) + F.when(F.col("source").isin("src1", "src2"), 40).otherwise(0))


def tier(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "mid").when(score >= 15, "low").otherwise("none")


def unified(label: Column, taxonomy: dict[str, str]) -> Column:
    lookup = F.create_map(*(F.lit(x) for pair in taxonomy.items() for x in pair))
    return F.coalesce(F.try_element_at(lookup, label), F.lit("other"))


def file_kind(name: Column, kinds: dict[str, str]) -> Column:
    return first_match(((kind, F.endswith(F.lower(name), F.lit(end))) for end, kind in kinds.items()), "other")


def first_match(rules, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, rule in reversed(list(rules)):
        out = F.when(rule, name).otherwise(out)
    return out


def digits(name: Column) -> Column:
    """The integer of all digits of a name, null where there are none or too many."""
    return F.regexp_replace(name, r"\D", "").try_cast("bigint")


def tags(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))


def params(json: Column, schema: str, defaults: dict) -> dict[str, Column]:
    parsed = F.from_json(json, schema)
    return {k: F.coalesce(parsed[k], F.lit(v)) for k, v in defaults.items()}


def namespace(text: Column) -> Column:
    """``Namespace(k=v, ...)`` as a map of strings."""
    inner = F.regexp_replace(F.regexp_extract(text, r"^Namespace\((.*)\)$", 1), "'", "")
    return F.str_to_map(inner, F.lit(", "), F.lit("="))


def csv_doubles(line: Column, names) -> dict[str, Column]:
    """Fields of a comma-separated line as doubles; what is not a number is 0."""
    fields = F.split(line, r",\s*")
    return {n: F.coalesce(F.get(fields, F.lit(i)).try_cast("double"), F.lit(0.0)) for i, n in enumerate(names)}


def latest(df: DataFrame, key: str, path: str) -> DataFrame:
    """The path with the largest number at its end, for each key."""
    return df.groupBy(key).agg(F.max_by(path, F.regexp_extract(path, r"(\d+)$", 1).try_cast("bigint")).alias(path))
