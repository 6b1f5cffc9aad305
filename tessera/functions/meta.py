"""JSON metadata of rows: shallow merges, probes and figures by key, over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(x: Column) -> Column:
    """The top-level keys of a JSON object's text with their values as VARIANT; no object (or null): an empty map."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def merged(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects' texts: ``new`` wins key by key. Keys come in order; text that is no object counts as {}."""
    a, b = entries(old), entries(new)
    both = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    keys = F.array_sort(F.map_keys(both))
    parts = F.transform(keys, lambda k: F.concat(F.to_json(F.struct(k.alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(k.alias("k")))) - 6), F.lit(":"), F.coalesce(F.to_json(F.element_at(both, k)), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def probe(x: Column, path: str, kind: str = "string") -> Column:
    """The value at ``path`` ("$.a.b"); null if it is absent or of another kind."""
    return F.try_variant_get(F.try_parse_json(x), path, kind)


def by_key(rows: DataFrame, meta_col: str = "meta", digits: int = 6) -> DataFrame:
    """(key, n, n_numbers, mean): rows that have each top-level key, and the mean of its numbers."""
    each = rows.select(F.explode(entries(F.col(meta_col))).alias("key", "value"))
    kind = F.schema_of_variant("value")
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("value", "$", "double"))
    return each.select("key", number.alias("x")).groupBy("key").agg(F.count("*").alias("n"), F.count("x").alias("n_numbers"), F.round(F.avg("x"), digits).alias("mean"))
