"""The expression language: tokens of an expression as column expressions, without any Python per row.

Rules worth knowing: a symbol operator counts only if its name is available; `<` is also found within `<=`; an
identifier before `=` is taken for an assignment, even before `==`; a conditional `c ? a : b` uses if_else, which is
counted only where it is written as a call; texts in quotes hold no fields, but field counts do look into them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide", "^": "power", "<": "less", ">": "greater", "<=": "less_equal", ">=": "greater_equal", "==": "equal", "!=": "not_equal", "&&": "and", "||": "or"}
KEYWORDS = ["if", "else", "then", "and", "or", "not", "true", "false", "null", "nan", "inf"]
_SYMBOL_OF = {v: k for k, v in SYMBOLS.items()}


def normalise(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def variables(clean: Column) -> Column:
    """Names that statements (split at ;) assign to, in lower case."""
    names = F.transform(F.split(clean, ";"), lambda s: F.lower(F.regexp_extract(s, r"^\s*([a-zA-Z_]\w*)\s*=(?!=)", 1)))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def has_conditional(clean: Column) -> Column:
    return clean.rlike(r"[^?]+\?\s*[^:]+:\s*.+")


def rewritten(clean: Column) -> Column:
    """Conditionals that are written without spaces as calls of if_else; others stay."""
    return F.regexp_replace(clean, r"([^?\s](?:[^?]*[^?\s])?)\?([^:\s](?:[^:]*[^:\s])?):(\S(?:.*\S)?)", r"if_else($1, $2, $3)")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def symbol_operators(text: Column, available: list[str]) -> Column:
    """Available operators whose symbol occurs."""
    found = [F.when(F.instr(text, s) > 0, F.lit(n)) for s, n in SYMBOLS.items() if n in available]
    return F.array_compact(F.array(*found)) if found else _strings([])


def called(text: Column) -> Column:
    """Names before an opening bracket, in order and with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-zA-Z_]\w*)\s*\("), F.lit(1))


def identifiers(text: Column, assigned: Column, available: list[str]) -> Column:
    """Identifiers that are neither called, assigned, keywords nor operators, in order and with repeats."""
    plain = F.lower(F.regexp_replace(text, r""""[^"]*"|'[^']*'""", '""'))
    found = F.regexp_extract_all(plain, F.lit(r"\b([a-zA-Z_]\w*)\b(?!\s*\()(?!\s*=)"), F.lit(1))
    skip = F.concat(assigned, _strings(KEYWORDS + available))
    return F.filter(found, lambda x: ~F.array_contains(skip, x))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: a generator of one row keeps Catalyst from copying them into what reads them, lambdas above all."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def tokens(df: DataFrame, expression: str, available: list[str]) -> DataFrame:
    """df with columns clean, operators (recognised, distinct), unknown_operators (with repeats), names (identifiers, with repeats) and operator_counts.

    operator_counts: how often each operator is called, or else how often its symbol occurs; those that occur in neither way are left out.
    """
    available = sorted({a.lower() for a in available})
    ops = _strings(available)
    out = once(df, clean=normalise(F.col(expression)))
    out = once(out, _text=rewritten(F.col("clean")), _words=called(F.col("clean")))
    conditional = F.when(has_conditional(F.col("clean")), F.array(F.lit("if_else"))).otherwise(_strings([]))
    assigned = F.when(F.instr("clean", "=") > 0, variables(F.col("clean"))).otherwise(_strings([]))
    out = once(out, _calls=called(F.col("_text")), _symbols=F.concat(symbol_operators(F.col("_text"), available), conditional), _assigned=assigned)
    symbols = F.array_intersect("_symbols", ops)
    out = once(out, _used=symbols, operators=F.array_sort(F.array_union(F.array_intersect("_calls", ops), symbols)))
    return out.select(
        *df.columns,
        "clean",
        "operators",
        F.concat(F.array_except("_symbols", ops), F.filter("_calls", lambda x: ~F.array_contains(ops, x))).alias("unknown_operators"),
        identifiers(F.col("_text"), F.col("_assigned"), available).alias("names"),
        _operator_counts(F.col("clean"), F.col("operators"), F.col("_words"), F.col("_used")).alias("operator_counts"),
    )


def _operator_counts(clean: Column, operators: Column, calls: Column, symbols: Column) -> Column:
    written = lambda s: F.expr(f"cast((length(clean) - length(replace(clean, '{s}', ''))) / {len(s)} as int)")
    count = F.lit(0)
    pick = lambda o: [(o == n) & F.array_contains(symbols, n) for n in _SYMBOL_OF]

    def one(o: Column) -> Column:
        called_ = F.size(F.filter(calls, lambda x: x == o))
        by_symbol = count
        for test, s in zip(pick(o), _SYMBOL_OF.values(), strict=True):
            by_symbol = F.when(test, written(s)).otherwise(by_symbol)
        return F.struct(o.alias("key"), F.when(called_ > 0, called_).otherwise(by_symbol).alias("value"))

    return F.map_from_entries(F.filter(F.transform(operators, one), lambda e: e["value"] > 0))


def field_counts(words: Column, fields: Column) -> Column:
    """field -> how often it occurs among the words of an expression."""
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f.alias("key"), F.size(F.filter(words, lambda x: x == f)).alias("value"))))


def parse(df: DataFrame, available: list[str], fields: DataFrame, key: str = "id", expression: str = "code", region: str = "region") -> DataFrame:
    """(key, region, operators, operator_counts, fields, field_counts, excluded, reason) of each expression.

    An expression is excluded if any call or identifier of it isn't available: operators from `available`, fields from
    (region, field) rows of `fields`, which is joined rather than collected.  A null region takes a field of any region.
    Null and empty expressions use nothing and aren't excluded.  Rows of equal region and expression are parsed once.
    """
    rows, once_ = parse_apart(df, available, fields, key, expression, region)
    return rows.join(once_.drop(region), "_same").drop("_same")


def parse_apart(df: DataFrame, available: list[str], fields: DataFrame, key: str = "id", expression: str = "code", region: str = "region") -> tuple[DataFrame, DataFrame]:
    """What parse() joins: (key, region, _same) of each row, and what parse() gives of each distinct region and expression, by _same."""
    same = F.md5(F.concat_ws("\u0001", F.hex(region), F.col(region).isNull().cast("string"), F.hex(expression)))
    rows = df.select(key, region, same.alias("_same"), expression)
    t = tokens(rows.select("_same", region, expression).distinct(), expression, available)
    known = fields.select(F.col("region").alias("_r"), F.lower(F.col("field").cast("string")).alias("_f")).distinct()
    known = known.unionByName(known.select(F.lit(None).cast("string").alias("_r"), "_f").distinct())
    each = t.select("_same", region, F.posexplode("names").alias("_at", "_name"))
    looked = each.join(known, (F.col("_f") == F.col("_name")) & F.col("_r").eqNullSafe(F.col(region)), "left")
    found = looked.groupBy("_same").agg(
        F.array_sort(F.collect_set(F.when(F.col("_f").isNotNull(), F.col("_name")))).alias("fields"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_f").isNull(), F.struct("_at", "_name")))), lambda x: x["_name"]).alias("_unknown"),
    )
    empty = F.array().cast("array<string>")
    out = t.join(found, "_same", "left").withColumn("fields", F.coalesce("fields", empty))
    out = once(out, _words=F.regexp_extract_all(F.lower("clean"), F.lit(r"\w+"), F.lit(0)))
    unknown = F.concat(F.transform("unknown_operators", lambda x: F.concat(F.lit("operator:"), x)), F.transform(F.coalesce("_unknown", empty), lambda x: F.concat(F.lit("datafield:"), x)))
    out = once(out, _unrecognised=unknown).select(
        "_same",
        region,
        "operators",
        "operator_counts",
        "fields",
        field_counts(F.col("_words"), F.col("fields")).alias("field_counts"),
        (F.size("_unrecognised") > 0).alias("excluded"),
        F.when(F.size("_unrecognised") > 0, F.concat(F.lit("Unrecognized components: "), F.array_join("_unrecognised", ", "))).alias("reason"),
    )
    return rows.select(key, region, "_same"), out


def parse_missing(df: DataFrame, cache: DataFrame, available: list[str], fields: DataFrame, key: str = "id", expression: str = "code", region: str = "region") -> DataFrame:
    """The cache of parse() results with the rows that it doesn't have yet; only those are parsed."""
    queue = df.join(cache.select(key), key, "left_anti")
    return cache.unionByName(parse(queue, available, fields, key, expression, region).select(*cache.columns))


def dataset_category(dataset: Column) -> Column:
    """Category of a dataset by its name: prefixes first, then parts."""
    low, out = F.lower(F.coalesce(dataset, F.lit(""))), None
    for word, name in (("fundamental", "Fundamental"), ("analyst", "Analyst"), ("pv", "Price Volume"), ("macro", "Macroeconomic"), ("altern", "Alternative"), ("tech", "Technical")):
        out = F.when(low.startswith(word), name) if out is None else out.when(low.startswith(word), name)
    for word, name in (("sentiment", "Sentiment"), ("news", "News"), ("esg", "ESG"), ("crypto", "Cryptocurrency")):
        out = out.when(low.contains(word), name)
    return out.otherwise("Other")


def dataset_of(field: Column) -> Column:
    """What comes before the first dot, or else the first underscore, or else unknown."""
    return F.when(F.instr(field, ".") > 0, F.substring_index(field, ".", 1)).when(F.instr(field, "_") > 0, F.substring_index(field, "_", 1)).otherwise("unknown")


def truncate(c: Column, most: int = 100, suffix: str = "...") -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix)))


def display_name(c: Column) -> Column:
    return F.initcap(F.translate(c, "_", " "))


def sanitise(c: Column, most: int = 1000) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, "[<>\"']", "")), 1, most)


def feature_family(c: Column) -> Column:
    """Family that a feature's name begins with."""
    return F.when(c.startswith("risk_regime_"), "regime").when(c.startswith("risk_"), "risk").when(c.startswith("spiked_"), "spiked").when(c.startswith("multiscale_"), "multiscale").when(c.startswith("metadata_"), "metadata").otherwise("other")


def feature_label(c: Column) -> Column:
    return display_name(F.regexp_replace(c, "^(risk_regime_|risk_|spiked_|multiscale_|metadata_)", ""))


def for_display(c: Column, most: int = 300) -> Column:
    """An expression in lines of HTML, cut where it is long; a note where there is none."""
    lines = F.replace(F.replace(c, F.lit(";"), F.lit(";<br>")), F.lit(", "), F.lit(",<br>"))
    return F.when(c.isNull() | (c == ""), "No expression available").when(F.length(lines) > most, F.concat(F.substring(lines, 1, most), F.lit("..."))).otherwise(lines)


def feature_kind(c: Column) -> Column:
    """Kind of a feature by what its name holds: metadata by its prefix, risk, or else statistical."""
    return F.when(c.startswith("metadata_"), "metadata").when(F.lower(c).contains("risk") | c.contains("var") | c.contains("drawdown"), "risk").otherwise("statistical")
