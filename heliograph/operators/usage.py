"""Usage analytics over (id, token, n): who uses what, how often, and what could be used elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_usage(used: DataFrame, token: str, extra: list[str] | None = None) -> DataFrame:
    """For each token (and extra key) the number of ids, and the sum of its counts."""
    return used.groupBy(token, *(extra or [])).agg(F.countDistinct("id").alias("unique_count"), F.sum("n").cast("long").alias("nominal_count"))


def usage_by_region(used: DataFrame, token: str) -> DataFrame:
    """(token, region, signals): the number of ids that use a token in a region and, with a null region, in all.

    An id counts for all in the first of its regions, so rows aren't repeated for each of the two; they stay where rows of equal id and token are.
    """
    w = Window.partitionBy("id", token).orderBy("region")
    each = used.select("id", token, "region").distinct().withColumn("_first", (F.row_number().over(w) == 1) & F.col("id").isNotNull())
    per = each.groupBy(token, "region").agg(F.count("id").alias("_in"), F.count_if("_first").alias("_all"))
    out = per.groupingSets([[token, "region"], [token]], token, "region").agg(F.grouping("region").alias("_g"), F.sum("_in").alias("_in"), F.sum("_all").alias("_all"))
    return out.select(token, "region", F.when(F.col("_g") == 1, F.col("_all")).otherwise(F.col("_in")).alias("signals"))


def token_ids(used: DataFrame, token: str) -> DataFrame:
    """For each token the sorted ids that use it."""
    return used.groupBy(token).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def top(usage: DataFrame, token: str, k: int = 20, by: str = "unique_count") -> DataFrame:
    """The k tokens of the highest count, ties by token."""
    return usage.orderBy(F.desc(by), token).limit(k)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of all columns in one pass; nulls are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def usage_bands(catalogue: DataFrame, used: DataFrame, token: str, frequent: int = 10) -> DataFrame:
    """Each token of the catalogue with its number of ids and a band: frequent, rare or never."""
    n = used.groupBy(token).agg(F.countDistinct("id").alias("unique_count"))
    out = catalogue.select(token).distinct().join(n, token, "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)).cast("long"))
    return out.withColumn("band", F.when(F.col("unique_count") >= frequent, "frequent").when(F.col("unique_count") > 0, "rare").otherwise("never"))


def dataset_statistics(fields: DataFrame, used: DataFrame) -> DataFrame:
    """For each dataset its fields, how many of them are used and by how many ids, and the share used in percent."""
    total = fields.groupBy("dataset").agg(F.countDistinct("field").alias("total_fields"))
    of = fields.select("field", "dataset").distinct()
    per = used.join(of, "field").groupBy("dataset").agg(F.countDistinct("field").alias("used_fields"), F.countDistinct("id").alias("signals"))
    out = total.join(per, "dataset", "full").na.fill(0, ["total_fields", "used_fields", "signals"]).where("total_fields > 0")
    return out.withColumn("usage_percent", F.round(F.try_divide(F.col("used_fields") * 100.0, F.col("total_fields")), 2)).withColumn("is_used", F.col("used_fields") > 0)


def recommendations(fields: DataFrame, used: DataFrame, region: str | None = None, data_type: str | None = None, blank: str = "No field description") -> DataFrame:
    """For each used field the regions where it, or a field of the same description, is available but it isn't used.

    Columns: field, description, used_regions, recommended_regions (sorted arrays), n_recommended, signals, matching: region -> number of matching fields.
    Descriptions are aggregated before they are joined, so the join grows with fields, not with pairs of fields.
    """
    catalogue = fields if data_type is None else fields.where(F.col("data_type") == data_type)
    described = catalogue.groupBy("field").agg(F.min("description").alias("description"))
    use = used.groupBy("field").agg(F.array_sort(F.collect_set("region")).alias("used_regions"), F.countDistinct("id").alias("signals"))
    own = catalogue.groupBy("field").agg(F.collect_set("region").alias("own"))
    real = F.col("description").isNotNull() & (F.col("description") != "") & (F.col("description") != blank)
    alike = catalogue.where(real).groupBy("description", "region").agg(F.countDistinct("field").alias("n"))
    alike = alike.groupBy("description").agg(F.collect_set("region").alias("alike"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "n")))).alias("counts"))
    empty = F.array().cast("array<string>")
    out = use.join(described, "field").join(own, "field").join(alike, "description", "left")
    available = F.array_union("own", F.coalesce("alike", empty))
    out = out.withColumn("recommended_regions", F.array_sort(F.array_except(available, "used_regions"))).where("size(recommended_regions) > 0")
    if region is not None:
        out = out.where(F.array_contains("recommended_regions", region)).withColumn("recommended_regions", F.array(F.lit(region)))
    one = lambda r: F.coalesce(F.try_element_at("counts", r), F.lit(1))
    return out.select(
        "field",
        "description",
        "used_regions",
        "recommended_regions",
        F.size("recommended_regions").alias("n_recommended"),
        "signals",
        F.transform("recommended_regions", lambda r: F.struct(r.alias("region"), one(r).alias("n"))).alias("matching"),
    )


def matching_fields(fields: DataFrame, source: str, region: str, most: int = 10) -> DataFrame:
    """Fields of a region with the description of `source` (whatever its case) or with its name up to the first _ in theirs; where there are none, source itself. Sorted, at most so many."""
    text = F.col("field").cast("string")
    wanted = fields.where(text == source).agg(F.min(F.lower("description")).alias("_d"))
    there = fields.where(F.col("region") == region).crossJoin(F.broadcast(wanted))
    base = source.split("_")[0]
    close = there.where((F.lower("description") == F.col("_d")) | F.lower(text).contains(base.lower())).select("field", "description").distinct()
    exact = there.where(text == source).select("field", "description").distinct()
    none = close.limit(1).agg(F.count("*").alias("_n"))
    return close.unionByName(exact.crossJoin(F.broadcast(none)).where("_n = 0").drop("_n")).orderBy("field").limit(most)


def share(df: DataFrame, by: str) -> DataFrame:
    """Rows of each value of a column, and their share in percent."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def treemap(df: DataFrame, value: str) -> DataFrame:
    """df with size (at least 20, ten times the root), tier of its share of all sizes, and band of its value."""
    size = F.greatest(F.sqrt(F.col(value).cast("double")) * 10, F.lit(20.0))
    part = F.col("size") / F.sum("size").over(Window.partitionBy())
    out = df.withColumn("size", size).withColumn("_part", part)
    tier = F.when(F.col("_part") >= 0.015, "full").when(F.col("_part") >= 0.008, "short").when(F.col("_part") >= 0.004, "name").otherwise("none")
    band = F.when(F.col(value) == 0, "unused").when(F.col(value) <= 5, "low").when(F.col(value) <= 20, "medium").otherwise("high")
    return out.withColumn("tier", tier).withColumn("band", band).drop("_part")


def group_small(df: DataFrame, by: str, least: int = 5, other: str = "Others") -> DataFrame:
    """Counts of a column's values, with those under `least` taken together."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") < least, other).otherwise(F.col(by).cast("string")).alias(by)).agg(F.sum("n").alias("n"))


def parsed_tokens(parsed: DataFrame, key: str = "id") -> DataFrame:
    """(id, region, kind, token, n) of what the expressions that aren't excluded use; n is 0 for an operator that is only implied."""
    ops = F.transform("operators", lambda o: F.struct(F.lit("operator").alias("kind"), o.alias("token"), F.coalesce(F.try_element_at("operator_counts", o), F.lit(0)).alias("n")))
    fields = F.transform("fields", lambda f: F.struct(F.lit("field").alias("kind"), f.alias("token"), F.coalesce(F.try_element_at("field_counts", f), F.lit(0)).alias("n")))
    return parsed.where("NOT excluded").select(F.col(key).alias("id"), "region", F.inline(F.concat(ops, fields)))


def batch_analysis(parsed: DataFrame, key: str = "id") -> DataFrame:
    """(kind, token, unique_count, nominal_count): what a batch of parse() results uses, and how many rows are excluded for which reason."""
    used = token_usage(parsed_tokens(parsed, key), "token", ["kind"]).select("kind", "token", "unique_count", "nominal_count")
    n = F.count("*").alias("unique_count")
    gone = parsed.where("excluded").groupBy(F.col("reason").alias("token")).agg(n).select(F.lit("excluded").alias("kind"), "token", "unique_count", F.col("unique_count").alias("nominal_count"))
    return used.unionByName(gone)


def batch_categories(parsed: DataFrame, categories: DataFrame, key: str = "id") -> DataFrame:
    """(category, unique_count, nominal_count) of the fields used, by (field, category) rows."""
    used = parsed_tokens(parsed, key).where("kind = 'field'").join(categories.select(F.lower(F.col("field").cast("string")).alias("token"), "category"), "token")
    return token_usage(used, "category")


def analysis_of_distinct(rows: DataFrame, parsed: DataFrame, key: str = "id") -> DataFrame:
    """batch_analysis() of what parse_apart() gives."""
    gone = parsed.where("excluded").select("_same", F.lit("excluded").alias("kind"), F.col("reason").alias("token"), F.lit(1).alias("n"))
    labels = parsed_tokens(parsed, "_same").select(F.col("id").alias("_same"), "kind", "token", "n").unionByName(gone)
    return counted(rows, labels, ["kind", "token"], key).withColumn("unique_count", F.when(F.col("kind") == "excluded", F.col("nominal_count")).otherwise(F.col("unique_count")))


def categories_of_distinct(rows: DataFrame, parsed: DataFrame, categories: DataFrame, key: str = "id") -> DataFrame:
    """batch_categories() of what parse_apart() gives."""
    used = parsed_tokens(parsed, "_same").where("kind = 'field'").join(categories.select(F.lower(F.col("field").cast("string")).alias("token"), "category"), "token")
    return counted(rows, used.select(F.col("id").alias("_same"), "category", "n"), ["category"], key)


def counted(rows: DataFrame, labels: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """(*by, unique_count, nominal_count) of labels (_same, *by, n) over rows (key, _same): ids of each label, and the sum of its n.

    Ids of one _same alone, which is nearly all, are counted for each _same before it is joined with its labels; only the others are counted as ids of a label.
    A row isn't repeated for its labels, and its _same goes through the shuffle as two numbers.
    """
    same = [F.xxhash64("_same").alias("_a"), F.xxhash64("_same", F.lit(7)).alias("_b")]
    each = rows.select(key, *same).groupBy(key, "_a", "_b").agg(F.count("*").alias("_times"))
    each = each.withColumn("_several", F.count("*").over(Window.partitionBy(key)) > 1)  # a null id is no id, but its row's n counts
    met = each.groupBy("_a", "_b", F.when(F.col("_several"), F.col(key)).alias("_id")).agg(F.sum("_times").alias("_times"), F.count(key).alias("_ids"))
    per = labels.groupBy("_same", *by).agg(F.sum("n").alias("n")).select(*same, *by, "n")
    out = met.join(per, ["_a", "_b"]).groupBy(*by).agg(F.sum(F.when(F.col("_id").isNull(), F.col("_ids")).otherwise(0)).alias("_one"), F.countDistinct("_id").alias("_more"), F.sum(F.col("n") * F.col("_times")).cast("long").alias("nominal_count"))
    return out.select(*by, (F.col("_one") + F.col("_more")).alias("unique_count"), "nominal_count")


def batch_statistics(parsed: DataFrame) -> DataFrame:
    """(total, analysed, excluded, percent_excluded) of a batch."""
    total, gone = F.count("*"), F.count_if("excluded")
    return parsed.agg(total.alias("total"), (total - gone).alias("analysed"), gone.alias("excluded"), F.round(F.coalesce(F.try_divide(gone * 100.0, total), F.lit(0.0)), 2).alias("percent_excluded"))


def date_range(df: DataFrame, column: str) -> DataFrame:
    """(first, last) date of a column."""
    return df.agg(F.to_date(F.min(column)).alias("first"), F.to_date(F.max(column)).alias("last"))


def recommendation_sums(recommended: DataFrame, used: DataFrame) -> DataFrame:
    """(fields_analysed, opportunities, potential) of recommendations(): fields in use, those that could be used elsewhere, and in how many places."""
    sums = recommended.agg(F.count("*").alias("opportunities"), F.coalesce(F.sum("n_recommended"), F.lit(0)).alias("potential"))
    return used.agg(F.countDistinct("field").alias("fields_analysed")).crossJoin(F.broadcast(sums))
