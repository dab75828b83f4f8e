"""Predicates as columns, for Catalyst to push down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conjunction(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def selection(region: str | None = None, universe: str | None = None, delay: int | None = None, date_from: str | None = None, date_to: str | None = None, code: str | None = None, added: str = "added") -> Column:
    """The conjunction of the filters that are given.

    A delay of 0 is a filter (see any_given); empty strings are none.  date_to is compared as midnight, so that the last day itself is left out.  With
    `code`, rows whose column of that name is null or empty are left out.
    """
    out = []
    if code:
        out.append(not_empty(F.col(code)))
    if region:
        out.append(F.col("region") == region)
    if universe:
        out.append(F.col("universe") == universe)
    if delay is not None:
        out.append(F.col("delay") == delay)
    if date_from:
        out.append(F.col(added) >= F.lit(date_from).cast("timestamp"))
    if date_to:
        out.append(F.col(added) <= F.lit(date_to).cast("timestamp"))
    return conjunction(out)


def any_given(*values) -> bool:
    """Whether any filter counts as given where a whole table is asked for otherwise: there a delay of 0 alone counts as none."""
    return any(values)


_COMPARISONS = {">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, "=": lambda c, v: c == v}


def from_url(url: str, columns: dict[str, str]) -> Column:
    """The conjunction of the comparisons (name, one of = != < <= > >=, value) in a URL's query, by columns of these names; others, such as paging, are left out."""
    import re
    from urllib.parse import unquote_plus

    out = []
    for part in url.partition("?")[2].split("&"):
        m = re.match(r"([^<>!=]+)(>=|<=|!=|>|<|=)(.*)$", unquote_plus(part))
        if m and m[1] in columns:
            out.append(_COMPARISONS[m[2]](F.col(columns[m[1]]), F.lit(m[3])))
    return conjunction(out)


def not_empty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def contains_any(tokens: Column, wanted: list) -> Column:
    """Whether an array has any of the wanted values; an empty list matches nothing."""
    return F.coalesce(F.arrays_overlap(tokens, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(False)


def default(c: Column, value) -> Column:
    """c, or the value where c is null or an empty text."""
    return F.when(F.length(c.cast("string")) > 0, c).otherwise(F.lit(value))


def beyond(c: Column, threshold: float) -> Column:
    """At least a threshold that isn't negative, at most a negative one."""
    return c >= threshold if threshold >= 0 else c <= threshold


def catalogue_reason(category: Column, scope: Column) -> Column:
    """Why an operator isn't for ordinary expressions; null if it is."""
    return F.when(category == "Special", "special").when(scope == F.array(F.lit("COMBO")), "combo only").when(scope == F.array(F.lit("SELECTION")), "selection only")


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]{3,50}$"), F.lit(False))


def valid_dates(start: Column, end: Column) -> Column:
    return F.coalesce(start <= end, F.lit(True))


def valid_number(c: Column, low: float | None = None, high: float | None = None) -> Column:
    x = c.try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x)
    if low is not None:
        ok &= x >= low
    if high is not None:
        ok &= x <= high
    return F.coalesce(ok, F.lit(False))


def valid_delay(c: Column) -> Column:
    return valid_number(c, 0, 30)


def valid_region(c: Column, regions: list[str]) -> Column:
    return F.coalesce(c.isin(regions), F.lit(False))


def valid_port(c: Column) -> Column:
    return valid_number(c, 1, 65535)


def valid_path(c: Column, extensions: list[str] | None = None) -> Column:
    """Paths that stay where they begin, with one of the extensions if any are given."""
    ok = (F.length(c) > 0) & ~c.contains("..") & ~c.startswith("/")
    if extensions:
        ok &= F.substring_index(F.lower(c), ".", -1).isin([e.lower().lstrip(".") for e in extensions])
    return F.coalesce(ok, F.lit(False))


def valid_json(c: Column, keys: list[str]) -> Column:
    """Texts that are a JSON object with all of the keys."""
    there = F.json_object_keys(c)
    return F.coalesce(F.size(F.array_intersect(there, F.array(*map(F.lit, keys)))) == len(set(keys)), F.lit(False))


def highlighted(points: DataFrame, by_operator: DataFrame, by_field: DataFrame, selected=None, key: str = "key") -> DataFrame:
    """points with booleans operator_match, field_match and selected: whose key is among the ids of either table, and the one picked."""
    mark = lambda df, name: df.select(F.col(df.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
    out = points.join(mark(by_operator, "operator_match"), key, "left").join(mark(by_field, "field_match"), key, "left")
    return out.na.fill(False, ["operator_match", "field_match"]).withColumn("selected", F.coalesce(F.col(key) == F.lit(selected), F.lit(False)))


def first_of_matrix(edges: DataFrame, n: int = 50) -> DataFrame:
    """Edges (a, b, ...) among the first n ids in id order: the head of a heat map."""
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().orderBy("id").limit(n)
    return edges.join(F.broadcast(ids.withColumnRenamed("id", "a")), "a", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "b")), "b", "left_semi")
