"""Versions, writes and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Levels of objects and arrays that are taken apart; what lies deeper is compared as a whole.
DEPTH = 12
#: Versions of one id that are put in order together.
VERSION_SPAN = 100_000


def apply_bundle(current: DataFrame, entries: DataFrame, span: int = VERSION_SPAN) -> DataFrame:
    """Apply entries (id, method, body, seq) to a table (id, version_id, body): POST creates, PUT writes, DELETE removes.

    Where both have ``resource_type``, an id counts for its type. Entries of one id apply in ``seq`` order (ties by
    bundle). A POST always makes a resource of its own, whatever id it brings: the new id comes from its place (seq, and
    the bundle_id and source of ``read_bundles`` if they are there), so a retry gives the same, and it has version 1. Each
    PUT, and each DELETE of a resource that is there at that point, raises the version by one. Other methods, PUT or DELETE
    without an id, and a DELETE of what is not there change nothing.

    If ``current`` has a column ``deleted``, so has the result, and deleted resources stay in it as tombstones with their
    last version and no body: a later PUT, in this bundle or another, goes on from there. Without that column only what
    is there is returned, and versions go on within the bundle alone. Entries are put in order in spans of ``seq``, so one
    id with very many entries is many tasks.
    """
    key = [c for c in ("resource_type", "id") if c in current.columns and c in entries.columns]
    bundle = [c for c in ("source", "bundle_id") if c in entries.columns]
    place = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*bundle, "seq")])
    posts = F.col("method") == "POST"
    own = F.concat(F.lit("new-"), F.substring(F.sha2(place, 256), 1, 32))
    named = entries.where(F.col("method").isin("POST", "PUT", "DELETE")).withColumn("id", F.when(posts, own).otherwise(F.col("id"))).where("id IS NOT NULL")

    order, gone = F.struct("seq", *bundle), F.col("method") == "DELETE"
    before = F.lag(gone).over(Window.partitionBy(*key, "span").orderBy("seq", *bundle))
    steps = named.withColumn("span", F.floor(F.col("seq") / span)).withColumn("before", before)
    spans = steps.groupBy(*key, "span").agg(
        F.count_if(~gone).alias("writes"),
        F.count_if(gone & ~F.col("before")).alias("removals"),  # a null before, the first of a span, doesn't count yet
        F.min_by(gone, order).alias("begins_gone"),
        F.max_by(F.struct(gone.alias("gone"), F.col("body")), order).alias("last"),
    )
    earlier = F.lag("last.gone").over(Window.partitionBy(*key).orderBy("span"))
    changes = spans.withColumn("earlier", earlier).groupBy(*key).agg(
        F.sum("writes").alias("writes"),
        F.sum(F.col("removals") + F.when(F.col("begins_gone") & ~F.col("earlier"), 1).otherwise(0)).alias("removals"),
        F.min_by("begins_gone", "span").alias("begins_gone"),
        F.max_by("last", "span").alias("last"),
    )
    tombstones = "deleted" in current.columns
    stored = current.select(*key, "version_id", F.col("body").alias("old_body"), (F.coalesce("deleted", F.lit(False)) if tombstones else F.lit(False)).alias("was_gone"))
    joined = stored.join(changes, key, "full")
    at_first = F.when(F.col("begins_gone") & ~F.coalesce("was_gone", F.lit(True)), 1).otherwise(0)
    raised = F.coalesce("version_id", F.lit(0)) + F.when(F.col("last").isNull(), 0).otherwise(F.col("writes") + F.col("removals") + at_first)
    now = joined.select(
        *key,
        raised.cast("int").alias("version_id"),
        F.when(F.col("last").isNull(), F.col("old_body")).when(~F.col("last.gone"), F.col("last.body")).alias("body"),
        F.coalesce("last.gone", "was_gone").alias("deleted"),
    ).where("version_id > 0")  # a delete of what never was leaves nothing
    return now if tombstones else now.where(~F.col("deleted")).drop("deleted")


def history(df: DataFrame) -> DataFrame:
    """Number the versions of each id from 1 by last_updated (ties by seq)."""
    return df.withColumn("version_id", F.row_number().over(Window.partitionBy("id").orderBy("last_updated", "seq")))


def version_diff(versions: DataFrame, columns: list[str]) -> DataFrame:
    """(id, version_id, path, operation, old, new) for each column that differs from the version before.

    Values are compared and given as strings; null to value is ``insert``, value to null ``delete``, else
    ``replace``.
    """
    order = Window.partitionBy("id").orderBy("version_id")
    pairs = [
        F.struct(F.lit(c).alias("path"), F.lag(F.col(c).cast("string")).over(order).alias("old"), F.col(c).cast("string").alias("new"))
        for c in columns
    ]
    rows = versions.select("id", "version_id", F.lag("version_id").over(order).alias("__before"), F.array(*pairs).alias("p"))
    flat = rows.where("__before IS NOT NULL").select("id", "version_id", F.explode("p").alias("p")).select("id", "version_id", "p.*")
    operation = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("replace")
    return flat.where(~F.col("old").eqNullSafe(F.col("new"))).select("id", "version_id", "path", operation.alias("operation"), "old", "new")


def leaves(rows: DataFrame, body: str = "body", root: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row for each value inside the resources: the other columns, path and value (JSON text).

    ``body`` is JSON text or a variant. Paths name members by a dot and array places from 0, as ``Patient.name[0].family``;
    ``root`` is what they begin with. Empty objects and arrays are values. Each level is a generator over the rows of the
    level above, so nothing is shuffled. Text that is not JSON fails the job; a null body has no values.
    """
    kept = [c for c in rows.columns if c != body]
    value = F.col(body) if rows.schema[body].dataType.typeName() == "variant" else F.parse_json(body)
    whole = F.lit("") if root is None else root
    flat = rows.where(F.col(body).isNotNull()).select(*kept, whole.alias("path"), value.alias("value"), F.lit(False).alias("leaf"))
    dotted = lambda key: F.when(F.col("path") == "", key).otherwise(F.concat("path", F.lit("."), key))
    part = lambda path, value, leaf: F.struct(path.alias("path"), value.alias("value"), F.lit(leaf).alias("leaf"))
    for _ in range(depth):
        members = F.map_entries(F.try_variant_get("value", "$", "map<string,variant>"))
        places = F.try_variant_get("value", "$", "array<variant>")
        itself = F.array(part(F.col("path"), F.col("value"), True))
        inner = (
            F.when(F.col("leaf"), itself)  # looked at once, then passed on
            .when(F.size(members) > 0, F.transform(members, lambda m: part(dotted(m["key"]), m["value"], False)))
            .when(F.size(places) > 0, F.transform(places, lambda v, k: part(F.concat("path", F.lit("["), k.cast("string"), F.lit("]")), v, False)))
            .otherwise(itself)
        )
        flat = flat.select(*kept, F.explode(inner).alias("v")).select(*kept, "v.path", "v.value", "v.leaf")
    return flat.drop("leaf").withColumn("value", F.to_json("value"))


def next_versions(versions: DataFrame, span: int = VERSION_SPAN) -> DataFrame:
    """(id, version_id, following, first): each version's successor, null after the last, and whether none came before.

    Versions are put in order in spans of ids and numbers, then the spans of an id among each other, so an id with very
    many versions is many tasks.
    """
    keyed = versions.select("id", "version_id").distinct().withColumn("span", F.floor(F.col("version_id") / span))
    inside = Window.partitionBy("id", "span").orderBy("version_id")
    rows = keyed.select("id", "version_id", "span", F.lead("version_id").over(inside).alias("following"), (F.row_number().over(inside) == 1).alias("opens"))
    ends = keyed.groupBy("id", "span").agg(F.min("version_id").alias("low"))
    between = Window.partitionBy("id").orderBy("span")
    ends = ends.select("id", "span", F.lead("low").over(between).alias("next_low"), (F.row_number().over(between) == 1).alias("earliest"))
    found = rows.join(ends, ["id", "span"])
    return found.select("id", "version_id", F.coalesce("following", "next_low").alias("following"), (F.col("opens") & F.col("earliest")).alias("first"))


def structural_diff(versions: DataFrame, body: str = "body", root: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """(id, version_id, path, operation, old, new) for each value in a resource that differs from the version before.

    Resources (id, version_id, body) are paired whole, each version's with the one before, and the two are taken apart
    together, with the paths of ``leaves``: one shuffle of bodies, and what is equal is left at the level where it is seen to
    be. Levels are as many as the deepest body has, which is looked up first. A value that was not there is an ``insert``,
    one that is gone a ``delete``, else it is a ``replace``; array members are told apart by their place. The first version
    of an id has no rows. Rows of an (id, version_id) must be one.
    """
    whole = F.lit("") if root is None else root
    met = versions.select("id", "version_id", F.col(body).alias("body"), whole.alias("path")).where("body IS NOT NULL").join(next_versions(versions), ["id", "version_id"])
    none = F.lit(None).cast(met.schema["body"].dataType)
    sides = F.array(
        F.when(~F.col("first"), F.struct(F.col("version_id").alias("at"), none.alias("old"), F.col("body").alias("new"))),
        F.when(F.col("following").isNotNull(), F.struct(F.col("following").alias("at"), F.col("body").alias("old"), none.alias("new"))),
    )
    both = met.select("id", "path", F.explode(F.array_compact(sides)).alias("s"))
    pairs = both.groupBy("id", F.col("s.at").alias("version_id"), "path").agg(F.first("s.old", True).alias("old"), F.first("s.new", True).alias("new"))
    as_text = met.schema["body"].dataType.typeName() != "variant"
    if as_text:
        pairs = pairs.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("old", F.parse_json("old")).withColumn("new", F.parse_json("new"))
    levels = versions.select(F.least(F.lit(depth), F.max(_height(F.col(body) if as_text else F.to_json(body), depth)))).first()[0] or 0
    flat = pairs.withColumn("leaf", F.lit(False))
    differ = ~F.to_json("old").eqNullSafe(F.to_json("new"))
    looked = lambda c, kind: F.when(~F.col("leaf"), F.try_variant_get(c, "$", kind))
    for _ in range(levels):  # each value is read once, not for each of its members
        read = {f"{c}_{name}": looked(c, kind) for c in ("old", "new") for name, kind in (("members", "map<string,variant>"), ("places", "array<variant>"))}
        flat = flat.where(F.col("leaf") | differ).withColumns(read)
        flat = flat.select("id", "version_id", F.explode(_inside()).alias("v")).select("id", "version_id", "v.*")
    flat = flat.select("id", "version_id", "path", F.to_json("old").alias("old"), F.to_json("new").alias("new"))
    operation = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("replace")
    return flat.where(~F.col("old").eqNullSafe(F.col("new"))).select("id", "version_id", "path", operation.alias("operation"), "old", "new")


def _height(text: Column, most: int) -> Column:
    """Levels of objects and arrays in JSON text, up to ``most`` and never too few: brackets that close at once go, level by level."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    peeled = lambda held, _: F.struct(F.regexp_replace(held["s"], r"\{\}|\[\]", "").alias("s"), (held["n"] + F.when(held["s"] == "", 0).otherwise(1)).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(brackets.alias("s"), F.lit(0).alias("n")), peeled, lambda held: held["n"])


def _inside() -> Column:
    """What two values that differ hold one level down: structs (path, old, new, leaf) of each member and place of either,
    and of the values themselves, as leaves, where they hold nothing. A leaf is passed on."""
    struct = lambda path, old, new, leaf: F.struct(path.alias("path"), old.alias("old"), new.alias("new"), F.lit(leaf).alias("leaf"))
    empty = F.array().cast("array<struct<path:string,old:variant,new:variant,leaf:boolean>>")
    nothing = F.array().cast("array<string>")
    keys = F.array_union(*[F.coalesce(F.map_keys(f"{c}_members"), nothing) for c in ("old", "new")])
    dotted = lambda key: F.when(F.col("path") == "", key).otherwise(F.concat("path", F.lit("."), key))
    named = F.transform(keys, lambda k: struct(dotted(k), *[F.try_element_at(f"{c}_members", k) for c in ("old", "new")], False))
    count = F.greatest(*[F.coalesce(F.size(f"{c}_places"), F.lit(0)) for c in ("old", "new")])
    placed = lambda k: F.concat("path", F.lit("["), k.cast("string"), F.lit("]"))
    places = F.transform(F.sequence(F.lit(0), count - 1), lambda k: struct(placed(k), *[F.get(f"{c}_places", k) for c in ("old", "new")], False))
    holds = lambda c: F.coalesce(F.size(f"{c}_members") > 0, F.lit(False)) | F.coalesce(F.size(f"{c}_places") > 0, F.lit(False))
    alone = [F.when(~holds(c), F.col(c)) for c in ("old", "new")]
    itself = F.when(alone[0].isNotNull() | alone[1].isNotNull(), F.array(struct(F.col("path"), *alone, True))).otherwise(empty)
    walked = F.concat(itself, F.when(F.size(keys) > 0, named).otherwise(empty), F.when(count > 0, places).otherwise(empty))
    return F.when(F.col("leaf"), F.array(struct(F.col("path"), F.col("old"), F.col("new"), True))).otherwise(walked)


def resolve_updates(current: DataFrame, updates: DataFrame, retry: bool, max_retries: int = 10) -> DataFrame:
    """Outcome of concurrent updates (id, base_version, arrival): (id, arrival, status, version_id).

    Those based on the current version compete in arrival order. The first is applied. The others conflict,
    or with ``retry`` follow as successive versions, the k-th after k retries, up to ``max_retries``. An update
    of an older base conflicts unless it may retry. Unknown ids and conflicts have no version.
    """
    order = Window.partitionBy("id").orderBy("arrival")
    joined = updates.join(current.select("id", F.col("version_id").alias("now")), "id", "left")
    fresh = F.col("base_version") == F.col("now")
    if retry:
        tries = F.row_number().over(order) - 1
        ok, version = tries <= max_retries, F.col("now") + tries + 1
        ranked = joined.withColumn("ok", ok & F.col("now").isNotNull()).withColumn("v", version)
    else:
        turn = F.row_number().over(Window.partitionBy("id", "base_version").orderBy("arrival"))
        ranked = joined.withColumn("ok", F.coalesce(fresh, F.lit(False)) & (turn == 1)).withColumn("v", F.col("now") + 1)
    return ranked.select(
        "id",
        "arrival",
        F.when(F.col("ok"), "applied").otherwise("conflict").alias("status"),
        F.when(F.col("ok"), F.col("v").cast("int")).alias("version_id"),
    )


def apply_patches(df: DataFrame, patches: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Apply patches (id, op, path, value, seq) to string columns; the last patch of a path counts.

    ``add`` and ``replace`` set the value (also to null), ``remove`` sets null.
    """
    last = (
        patches.where(F.col("path").isin(*columns))
        .groupBy(F.col("id").alias("__id"), "path")
        .agg(F.max_by(F.struct("op", "value"), "seq").alias("p"))
        .groupBy("__id")
        .pivot("path", columns)
        .agg(F.first("p"))
    )
    renamed = last.select("__id", *[F.col(f"`{c}`").alias(f"__patch_{c}") for c in columns])
    joined = df.join(renamed, F.col(id_col) == F.col("__id"), "left")
    patched = {}
    for c in columns:
        p = F.col(f"__patch_{c}")
        value = F.when(p["op"] == "remove", F.lit(None).cast("string")).otherwise(p["value"])
        patched[c] = F.when(p.isNull(), F.col(c)).otherwise(value)
    return joined.withColumns(patched).select(*df.columns)


def delete_where(df: DataFrame, predicate, multiple: bool = True) -> DataFrame:
    """Rows that stay. Without ``multiple`` the job fails if the search matches more than one row."""
    matches = F.coalesce(predicate, F.lit(False))
    if multiple:
        return df.where(~matches)
    counted = df.agg(F.count_if(matches).alias("__hits"))
    side = counted.select(
        F.when(F.col("__hits") > 1, F.raise_error(F.concat(F.lit("the search matches rows: "), F.col("__hits").cast("string"))).cast("boolean"))
        .otherwise(True)
        .alias("__ok")
    )
    return df.join(F.broadcast(side), F.col("__ok")).where(~matches).drop("__ok")


def soft_delete(versions: DataFrame, ids: DataFrame) -> DataFrame:
    """History with a tombstone after the newest version of each id: deleted, no other values."""
    newest = versions.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg((F.max("version_id") + 1).cast("int").alias("version_id"))
    tomb = newest.withColumn("deleted", F.lit(True))
    return versions.withColumn("deleted", F.lit(False)).unionByName(tomb, allowMissingColumns=True)


def expunge(versions: DataFrame, ids: DataFrame) -> DataFrame:
    """History without the ids."""
    return versions.join(ids.select("id").distinct(), "id", "left_anti")


def conditional_create(new: DataFrame, existing: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """New rows whose key neither exists nor came earlier in the batch. Null keys are always created."""
    keyed = new.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    first = keyed.where("__n = 1").drop("__n").join(existing.select(key).distinct(), key, "left_anti")
    return first.select(*new.columns).unionByName(new.where(F.col(key).isNull()))


def last_n(observations: DataFrame, n: int) -> DataFrame:
    """The newest n observations per subject and code: by instant, newest first, ties by id."""
    order = Window.partitionBy("subject", "code").orderBy(F.col("at").desc(), "id")
    return observations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

