"""Search predicates and their composition. A path is a column name, dots reaching into structs.

Predicates compare plain columns, so equality and ranges reach the scan; arrays are tested with ``exists``.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from wardline.operators.joins import hinted

#: Token lists beyond this length become a semi-join.
LONG_LIST = 100


def _type(df: DataFrame, path: str):
    kind = df.schema
    for name in path.split("."):
        kind = (kind if isinstance(kind, StructType) else kind.elementType)[name].dataType
    return kind


def token_predicate(df: DataFrame, path: str, tokens: list[str]) -> Column:
    """Any of ``system|code``, ``|code`` (no system), ``system|`` or a bare code, over all codings of the path."""
    kind, col = _type(df, path), F.col(path)
    bare = [t for t in tokens if "|" not in t]
    split = [t.split("|", 1) for t in tokens if "|" in t]
    whole_systems = [s for s, c in split if s and not c]
    without_system = [c for s, c in split if c and not s]
    both = [f"{s}|{c}" for s, c in split if s and c]
    anything = any(not s and not c for s, c in split)

    def test(system: Column | None, code: Column) -> Column:
        # each is one lookup in a set, however many tokens there are
        hits = [code.isin(*bare)] * bool(bare)
        absent = F.lit(True) if system is None else system.isNull()
        hits += [absent & code.isin(*without_system)] * bool(without_system) + [absent] * anything
        if system is not None:
            hits += [system.isin(*whole_systems)] * bool(whole_systems)
            hits += [F.concat(system, F.lit("|"), code).isin(*both)] * bool(both)
        return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits], F.lit(False)), F.lit(False))

    if isinstance(kind, StructType) and "coding" in kind.names:
        kind, col = kind["coding"].dataType, col["coding"]
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.coalesce(F.exists(col, lambda c: test(c["system"], c["code"])), F.lit(False))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.exists(col, lambda c: test(None, c)), F.lit(False))
    if isinstance(kind, StructType):
        return test(col["system"], col["code"])
    return test(None, col)


def where_token(df: DataFrame, path: str, tokens: list[str]) -> DataFrame:
    """Rows with any of the tokens. A long list of bare codes on a plain column is a broadcast semi-join."""
    if len(tokens) > LONG_LIST and not any("|" in t for t in tokens) and not isinstance(_type(df, path), (ArrayType, StructType)):
        codes = df.sparkSession.createDataFrame([(t,) for t in tokens], "code string")
        return where_in_codes(df, path, codes)
    return df.where(token_predicate(df, path, tokens))


def where_in_codes(df: DataFrame, path: str, codes: DataFrame, limit: int = 200_000) -> DataFrame:
    """Rows whose code is in ``codes`` (code). The list is broadcast if it was counted and is short enough."""
    side = codes.select(F.col("code").alias("__code")).distinct()
    if side.count() <= limit:
        side = F.broadcast(side)
    return df.join(side, F.col(path) == F.col("__code"), "left_semi")


def reference_predicate(path: str, target: str, refs: list[str]) -> Column:
    """``x`` and ``Type/x`` are the same reference."""
    full = [r if "/" in r else f"{target}/{r}" for r in refs]
    return F.col(path).isin(*full)


def where_reference(df: DataFrame, path: str, refs: list[str], target: str = "Patient") -> DataFrame:
    return df.where(reference_predicate(path, target, refs))


#: Partial dates and times of day, with or without a zone.
MOMENT = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,6}))?)?(Z|[+-]\d\d:\d\d)?)?)?)?")


def _range(text: str) -> tuple[Column, Column]:
    """The first moment that a partial date or time of day covers, and the first one after it.

    Days are compared as dates. A time of day covers its minute, second or decimal of one; a zone is converted
    to UTC, and without one the time is taken as the column has it.
    """
    found = MOMENT.fullmatch(text)
    if not found:
        raise ValueError(f"no date: {text}")
    year, month, day, hour, minute, second, fraction, zone = found.groups()
    if hour is None:
        low = date(int(year), int(month or 1), int(day or 1))
        if day:
            high = low + timedelta(days=1)
        elif month:
            high = date(low.year + low.month // 12, low.month % 12 + 1, 1)
        else:
            high = date(low.year + 1, 1, 1)
        return F.lit(low), F.lit(high)
    at = datetime(int(year), int(month), int(day), int(hour), int(minute), int(second or 0), int((fraction or "0").ljust(6, "0")))
    if zone and zone != "Z":
        sign = 1 if zone[0] == "+" else -1
        at -= sign * timedelta(hours=int(zone[1:3]), minutes=int(zone[4:]))
    step = timedelta(minutes=1) if second is None else timedelta(seconds=1) if fraction is None else timedelta(microseconds=10 ** (6 - len(fraction)))
    moment = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp" if zone else "timestamp_ntz")
    return moment(at), moment(at + step)


def date_predicate(path: str, expression: str) -> Column:
    """``ge2024-01-01`` and the prefixes gt, le, lt, eq, ne, sa (after) and eb (before); without one, eq.

    Partial dates and times of day are half-open ranges. A column holds moments, so sa and gt, eb and lt are the
    same. ``ap`` has no defined width and is an error, as is any other prefix. Zones are compared in UTC, the
    session's time zone.
    """
    prefix, text = (expression[:2], expression[2:]) if expression[:2].isalpha() else ("eq", expression)
    if prefix not in ("ge", "gt", "sa", "lt", "eb", "le", "eq", "ne"):
        raise ValueError(f"no such prefix: {prefix}")
    low, high = _range(text)
    at = F.col(path)
    inside = (at >= low) & (at < high)
    tests = {"ge": at >= low, "gt": at >= high, "lt": at < low, "le": at < high, "eq": inside, "ne": ~inside, "sa": at >= high, "eb": at < low}
    return tests[prefix]


def where_date(df: DataFrame, path: str, expression: str) -> DataFrame:
    return df.where(date_predicate(path, expression))


def string_predicate(path: str, text: str, contains: bool = False) -> Column:
    low = F.lower(F.col(path))
    return low.contains(text.lower()) if contains else low.startswith(text.lower())


def where_string(df: DataFrame, path: str, text: str, contains: bool = False) -> DataFrame:
    """Case-insensitive beginning of the value, or any part of it."""
    return df.where(string_predicate(path, text, contains))


def missing_predicate(df: DataFrame, path: str, missing: bool) -> Column:
    gone = F.col(path).isNull()
    if isinstance(_type(df, path), ArrayType):
        gone = gone | (F.size(path) == 0)
    return gone if missing else ~gone


def where_missing(df: DataFrame, path: str, missing: bool) -> DataFrame:
    return df.where(missing_predicate(df, path, missing))


def identifier_of_type_predicate(path: str, system: str, code: str, value: str) -> Column:
    """One and the same identifier has a type coding with the system and code, and the value."""

    def fits(i: Column) -> Column:
        typed = F.exists(i["type"]["coding"], lambda c: (c["system"] == system) & (c["code"] == code))
        return typed & (i["value"] == value)

    return F.coalesce(F.exists(path, fits), F.lit(False))


def where_identifier_of_type(df: DataFrame, system: str, code: str, value: str, path: str = "identifier") -> DataFrame:
    return df.where(identifier_of_type_predicate(path, system, code, value))


def where_language(df: DataFrame, lang: str, path: str = "lang") -> DataFrame:
    return df.where(F.col(path) == lang)


def where_quantity(df: DataFrame, op: str, value: float | str, unit: str, units: DataFrame, value_path: str = "value", unit_path: str = "unit") -> DataFrame:
    """Compare after conversion to a base unit. ``units``: unit, base, factor, each unit once; broadcast if it is small.

    Rows whose unit has no factor, or another base than the wanted one, don't match.
    """
    wanted = units.where(F.col("unit") == unit).select(F.col("base").alias("__base"), (F.col("factor") * F.lit(str(value)).cast("decimal(18,6)")).alias("__wanted"))
    side = units.select(F.col("unit").alias("__unit"), F.col("base").alias("__base"), F.col("factor").alias("__factor")).join(wanted, "__base")
    have = F.col(value_path) * F.col("__factor")
    tests = {"eq": have == F.col("__wanted"), "gt": have > F.col("__wanted"), "ge": have >= F.col("__wanted"), "lt": have < F.col("__wanted"), "le": have <= F.col("__wanted"), "ne": have != F.col("__wanted")}
    joined = df.join(hinted(side), F.col(unit_path) == F.col("__unit"))
    return joined.where(tests[op]).drop("__unit", "__base", "__factor", "__wanted")


def content_predicate(path: str, terms: list[str]) -> Column:
    """All terms occur as whole words, in any case. Texts that lack a term as a string are not split."""
    low = F.lower(F.col(path))
    words = F.split(low, r"[^\p{L}\p{N}]+")
    holds = [low.contains(t.lower()) for t in terms] + [F.array_contains(words, t.lower()) for t in terms]
    return reduce(lambda a, b: a & b, holds, F.lit(True))


def where_content(df: DataFrame, path: str, terms: list[str]) -> DataFrame:
    return df.where(content_predicate(path, terms))


def _sort_keys(order: list[str]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def search(df: DataFrame, params: list[tuple], sort: str | None = None, id_col: str = "id") -> DataFrame:
    """All parameters together: (kind, path, value...).

    Kinds and values: id (one or a list), token (tokens), reference (references, target type), date, string
    (text, contains), missing (whether), language, identifier_of_type (system, code, value), content (terms),
    quantity (comparison, value, unit, units table, path of the unit). ``sort`` is columns with commas between
    them, descending with a leading minus; ties by id.
    """
    tests, found = [], df
    for kind, path, *value in params:
        if kind == "id":
            tests.append(F.col(id_col).isin(*(value[0] if isinstance(value[0], list) else [value[0]])))
        elif kind == "token":
            tests.append(token_predicate(df, path, value[0]))
        elif kind == "reference":
            tests.append(reference_predicate(path, value[1] if len(value) > 1 else "Patient", value[0]))
        elif kind == "date":
            tests.append(date_predicate(path, value[0]))
        elif kind == "string":
            tests.append(string_predicate(path, *value))
        elif kind == "missing":
            tests.append(missing_predicate(df, path, value[0]))
        elif kind == "language":
            tests.append(F.col(path) == value[0])
        elif kind == "identifier_of_type":
            tests.append(identifier_of_type_predicate(path, *value))
        elif kind == "content":
            tests.append(content_predicate(path, value[0]))
        elif kind == "quantity":
            op, amount, unit, units, *unit_path = value
            found = where_quantity(found, op, amount, unit, units, path, *unit_path)
        else:
            raise ValueError(kind)
    found = found.where(reduce(lambda a, b: a & b, tests, F.lit(True)))
    return found if sort is None else found.orderBy(*_sort_keys([*sort.split(","), id_col]))


def search_total(df: DataFrame, params: list[tuple]) -> DataFrame:
    return search(df, params).agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, order: list[str], number: int, size: int = 20, max_size: int | None = None) -> DataFrame:
    """Page ``number`` (from 0) of the rows in order; the size is cut to ``max_size``."""
    size = min(size, max_size) if max_size else size
    return df.orderBy(*_sort_keys(order)).offset(number * size).limit(size)


def page_after(df: DataFrame, key: str | list[str], last=None, size: int = 20) -> DataFrame:
    """The next rows in the order of ``key`` after the row with the values ``last`` (None: from the start).

    ``key`` is a column or several, descending with a leading minus, which together tell rows apart. Nulls come
    first ascending and last descending, as Spark sorts them. Cost doesn't grow with depth.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = df
    if last is not None:
        values = [last] if isinstance(key, str) else list(last)
        same, after = F.lit(True), F.lit(False)
        for k, v in zip(keys, values, strict=True):
            c = F.col(k.lstrip("-"))
            if v is None:
                beyond = F.lit(False) if k.startswith("-") else c.isNotNull()
            else:
                beyond = (c < F.lit(v)) | c.isNull() if k.startswith("-") else c > F.lit(v)
            after, same = after | (same & beyond), same & c.eqNullSafe(F.lit(v))
        rest = df.where(after)
    return rest.orderBy(*_sort_keys(keys)).limit(size)


def resource_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


def include(df: DataFrame, ref_path: str, target: DataFrame, resource_type: str) -> DataFrame:
    """Ids found (mode match) and ids of the resources they refer to (mode include)."""
    wanted = df.select(F.substring_index(ref_path, "/", -1).alias("id")).distinct()
    found = df.select("id", F.lit("match").alias("mode"))
    side = target.select("id").join(wanted, "id", "left_semi").select("id", F.lit("include").alias("mode"))
    return found.unionByName(side).withColumn("included_type", F.when(F.col("mode") == "include", resource_type))


def where_chain(df: DataFrame, ref_col: str, target: DataFrame, predicate: Column) -> DataFrame:
    """Rows whose reference points to a target that meets the predicate."""
    side = target.where(predicate).select(F.col("id").alias("__target"))
    return df.join(side, F.substring_index(ref_col, "/", -1) == F.col("__target"), "left_semi")


def _values(df: DataFrame, path: str) -> Column:
    """Values of a path as an array of strings: all of an array's, however deep; ``system|code`` of codings and identifiers."""
    kind, col = df.select(F.col(path).alias("v")).schema["v"].dataType, F.col(path)

    def one(x: Column, k) -> Column:
        if isinstance(k, StructType) and "system" in k.names:
            rest = next(n for n in ("code", "value") if n in k.names)
            return F.when(x[rest].isNotNull(), F.concat(F.coalesce(x["system"], F.lit("")), F.lit("|"), x[rest]))
        return x.cast("string")

    if not isinstance(kind, ArrayType):
        return F.array(one(col, kind))
    while isinstance(kind.elementType, ArrayType):
        kind, col = kind.elementType, F.flatten(F.filter(col, lambda x: x.isNotNull()))
    return F.coalesce(F.transform(col, lambda x: one(x, kind.elementType)), F.array().cast("array<string>"))


def search_index(df: DataFrame, resource_type: str, specs: dict[str, tuple[str, str]], id_col: str = "id") -> DataFrame:
    """Index rows (resource_type, id, parameter, kind, value): one pass, one row for each different value of a parameter.

    ``specs``: parameter to (kind, path). A path may lead through structs and arrays; nulls give no row.
    """
    entries = F.array(*[F.struct(F.lit(p).alias("parameter"), F.lit(k).alias("kind"), F.array_distinct(_values(df, c)).alias("held")) for p, (k, c) in specs.items()])
    rows = df.select(F.lit(resource_type).alias("resource_type"), F.col(id_col).alias("id"), F.explode(entries).alias("e"))
    flat = rows.select("resource_type", "id", "e.parameter", "e.kind", F.explode("e.held").alias("value"))
    return flat.where("value IS NOT NULL")


def normalise_refs(df: DataFrame, path: str, local_bases: list[str], logical_patterns: list[str]) -> DataFrame:
    """Make local absolute references relative; ``is_logical`` marks those that match a pattern (``*`` at its end)."""
    ref = F.col(path)
    for base in local_bases:
        ref = F.when(ref.startswith(base), F.substring(ref, len(base) + 1, 1 << 20)).otherwise(ref)
    ref = F.regexp_replace(ref, "^/+", "")
    logical = [F.col(path).startswith(p[:-1]) if p.endswith("*") else F.col(path) == p for p in logical_patterns]
    return df.withColumn("is_logical", reduce(lambda a, b: a | b, logical, F.lit(False))).withColumn(path, ref)


def valid_status(df: DataFrame, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    return df.where(F.col("status").isin(*statuses))


def supported_types(df: DataFrame, types: list[str]) -> DataFrame:
    """Rows of the named types; no names means all. Search parameters always stay."""
    return df.where(F.col("resource_type").isin(*types, "SearchParameter")) if types else df
