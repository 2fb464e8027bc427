"""Record linkage: candidates, matches and golden ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.phonetic import cologne_phonetic, soundex
from wardline.operators.joins import hinted
from wardline.sources.staging import staged

#: Types that are linked, blocking fields and the type that each holds for (``*``: all), and the result map over the
#: names in ``mdm_match``.
RULES = {
    "types": ["Patient", "Practitioner"],
    "blocks": [("Patient", "birthdate"), ("*", "identifier"), ("Patient", "practitioner")],
    "results": {"given": "POSSIBLE_MATCH", "given,family": "MATCH"},
}
#: Records that meet records in one cell of a block; a busier block is cut into more cells.
CELL = 2_000
#: Pairs that a task is to make, and tasks of a shuffle at most: a cell beyond that waits for its task.
PAIRS_OF_A_TASK, MOST_TASKS = 25_000_000, 4_000


def _typed(people: DataFrame, rules: dict) -> DataFrame:
    """Active records of the types that are linked; without a column ``resource_type`` all are patients."""
    if "resource_type" not in people.columns:
        people = people.withColumn("resource_type", F.lit("Patient"))
    return people.where(F.col("active") & F.col("resource_type").isin(*rules["types"]))


def block_keys(people: DataFrame, rules: dict) -> Column:
    """Distinct block keys of a record, ``type|rule|value``; null values, and null members of arrays, never block."""
    none, parts = F.array().cast("array<string>"), []
    for k, (kind, field) in enumerate(rules["blocks"]):
        values = F.col(field) if people.schema[field].dataType.typeName() == "array" else F.array(field)
        prefix = F.concat_ws("|", "resource_type", F.lit(k), F.lit(""))
        named = F.transform(F.coalesce(values.cast("array<string>"), none), _behind(prefix))
        parts.append(named if kind == "*" else F.when(F.col("resource_type") == kind, named).otherwise(none))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*parts))))


def _behind(prefix: Column):
    return lambda value: F.concat(prefix, value)  # null if the value is null


def _mask(members: Column, salt: int = 0) -> Column:
    """64 bits of an array of strings: arrays whose masks have no bit in common have no member in common."""
    bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(m, F.lit(salt)), F.lit(64)).cast("int"))
    return F.aggregate(members, F.lit(0).cast("long"), lambda bits, m: bits.bitwiseOR(bit(m)))


def _met(records: DataFrame, cell: int | None = None) -> DataFrame:
    """Each pair of records of one type that share a member of ``keys`` (id, resource_type, keys, further columns), once, as
    resource_type and columns ``x_*`` and ``y_*``, x.id before y.id.

    A pair is made in the least block that both are in, and nowhere else, so no set of all pairs is held against itself.
    A block of more than ``cell`` records (default ``CELL``) is dealt into parts by the rank of the id, and each two parts
    meet in a task-sized cell of their own. A block of one record is no work. What is done for each pair counts: the later
    part of a cell comes as one array, which each record of the earlier part walks through; ids need no comparing
    but where a part meets itself; and the arrays of earlier blocks are looked into only where their masks meet.
    """
    cell = cell or CELL
    records = records.where("id IS NOT NULL")
    held = [c for c in records.columns if c not in ("keys", "resource_type")]
    members = records.select("resource_type", *held, "keys", F.explode("keys").alias("key"))
    members = members.select("resource_type", *held, "key", F.filter("keys", lambda k: k < F.col("key")).alias("earlier"))
    sizes = records.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy("id")).cast("long")  # equal ids lie in one part
    busy = members.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / cell).cast("int")).withColumn("rank", rank)
    busy = busy.withColumn("part", F.floor((F.col("rank") - 1) * F.col("parts") / F.col("n")).cast("int"))
    side = [*held, "earlier", "mask", "mask2"]  # one mask in sixteen has a bit in common by chance, with a second one in 256
    busy = busy.withColumns({"mask": _mask(F.col("earlier")), "mask2": _mask(F.col("earlier"), 1)}).select("key", "resource_type", *side, "parts", "part")
    upper = busy.select(
        "key", "resource_type", *[F.col(c).alias(f"x_{c}") for c in side], F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j")
    )
    whole = busy.repartition("key", "part").groupBy("key", "part").agg(F.collect_list(F.struct(*[F.col(c).alias(f"y_{c}") for c in side])).alias("ys"))
    lower = whole.select("key", "ys", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"))
    # few narrow rows make very many pairs: by their bytes they would be broadcast, or meet in a handful of tasks
    spark, at = records.sparkSession, ["key", "i", "j"]
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tasks = max(least, min(int(pairs // PAIRS_OF_A_TASK), MOST_TASKS))
    cells = upper.repartition(tasks, *at).hint("merge").join(lower.repartition(tasks, *at), at)
    met = cells.select("resource_type", "i", "j", *[c for c in upper.columns if c.startswith("x_")], F.explode("ys").alias("y")).select("*", "y.*")
    apart = (F.col("x_mask").bitwiseAND(F.col("y_mask")) == 0) | (F.col("x_mask2").bitwiseAND(F.col("y_mask2")) == 0)
    once = (F.col("i") < F.col("j")) | (F.col("x_id") < F.col("y_id"))
    return met.where(once).where(apart | ~F.arrays_overlap("x_earlier", "y_earlier")).select("resource_type", *[f"{name}_{c}" for name in "xy" for c in held])


def paired(records: DataFrame, cell: int | None = None) -> DataFrame:
    """The pairs of ``_met`` as structs a and b, a.id before b.id."""
    side = lambda name: F.struct(*[F.col("resource_type" if c == "resource_type" else f"{name}_{c}").alias(c) for c in records.columns if c != "keys"])
    return _met(records, cell).select(side("x").alias("a"), side("y").alias("b"))


def _in_order(met: DataFrame, *more: Column) -> DataFrame:
    """(resource_type, a, b) of pairs and further columns, a before b."""
    return met.select("resource_type", F.col("x_id").alias("a"), F.col("y_id").alias("b"), *more)


def _records(people: DataFrame, rules: dict, carry: list[str], over: tuple[int, str] | None) -> DataFrame:
    """Records with their block keys. With ``over`` (limit, field) the keys of blocks above the limit are joined with the
    field's value, so such a block holds only records that agree in it; null values leave the block."""
    active = _typed(people, rules)
    keyed = active.select("id", "resource_type", *carry, *([] if over is None else [F.col(over[1]).cast("string").alias("__second")]), block_keys(active, rules).alias("keys"))
    if over is None:
        return keyed
    sizes = keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    flat = keyed.select("id", "resource_type", *carry, "__second", F.explode("keys").alias("key")).join(sizes, "key")
    key = F.when(F.col("n") <= over[0], F.col("key")).otherwise(F.to_json(F.when(F.col("__second").isNotNull(), F.struct("key", "__second"))))
    return flat.groupBy("resource_type", "id").agg(*[F.first(c).alias(c) for c in carry], F.array_sort(F.collect_set(key)).alias("keys")).select("id", "resource_type", *carry, "keys")


def mdm_candidates(people: DataFrame, rules: dict = RULES, over: tuple[int, str] | None = None) -> DataFrame:
    """Pairs (resource_type, a, b), a before b, of active records of one type that share a block value, each once.

    ``people`` has id, active, the blocking fields (a value or an array of values) and resource_type (without it all are
    patients). Records of other types than the rules' are not linked. All pairs of a block are candidates by
    definition. ``over`` = (limit, field) is for blocks that are too busy to be worth it: above so many records two must
    agree in that field as well; ``left_out`` tells what that costs.
    """
    return _in_order(_met(_records(people, rules, [], over)))


def block_report(people: DataFrame, rules: dict = RULES, least: int = 2) -> DataFrame:
    """(resource_type, rule, value, records, pairs) of blocks with ``least`` active records or more: what
    ``mdm_candidates`` would make of them."""
    active = _typed(people, rules)
    flat = active.select("id", "resource_type", F.explode(block_keys(active, rules)).alias("key"))
    rule = F.split("key", r"\|", 3)
    names = F.array(*[F.lit(field) for _, field in rules["blocks"]])
    found = flat.groupBy("resource_type", names[rule[1].cast("int")].alias("rule"), rule[2].alias("value")).agg(F.count(F.lit(1)).alias("records"))
    n = F.col("records")
    return found.where(n >= least).withColumn("pairs", F.floor(n * (n - 1) / 2))


def left_out(people: DataFrame, limit: int, field: str, rules: dict = RULES) -> DataFrame:
    """(resource_type, rule, value, records, pairs, kept) of blocks above ``limit``: pairs that the block has and those that
    ``over=(limit, field)`` keeps, from counts alone. A pair that is not kept here may still be one by another block."""
    active = _typed(people, rules)
    flat = active.select("resource_type", F.col(field).cast("string").alias("second"), F.explode(block_keys(active, rules)).alias("key"))
    agreed = flat.groupBy("resource_type", "key", "second").agg(F.count(F.lit(1)).alias("n"))
    n, m = F.col("records"), F.when(F.col("second").isNotNull(), F.col("n")).otherwise(0)
    rule = F.split("key", r"\|", 3)
    names = F.array(*[F.lit(name) for _, name in rules["blocks"]])
    blocks = agreed.groupBy("resource_type", "key").agg(F.sum("n").alias("records"), F.sum(F.floor(m * (m - 1) / 2)).alias("kept")).where(n > limit)
    return blocks.select("resource_type", names[rule[1].cast("int")].alias("rule"), rule[2].alias("value"), "records", F.floor(n * (n - 1) / 2).alias("pairs"), "kept")


def phonetic_keys(patients: DataFrame) -> DataFrame:
    """(id, given_keys, family_key): each distinct name is encoded once. ``given`` may be one name or an array."""
    names = patients.select("id", "family", F.col("given").alias("g"))
    if names.schema["g"].dataType.typeName() != "array":
        names = names.withColumn("g", F.array("g"))
    flat = names.select("id", F.explode("g").alias("name")).where("name IS NOT NULL")
    keys = flat.select("name").distinct().withColumn("key", cologne_phonetic("name"))
    given = flat.join(keys, "name").groupBy("id").agg(F.collect_set("key").alias("given_keys"))
    return names.select("id", soundex(F.col("family")).alias("family_key")).join(given, "id", "left")


def _result(rules: dict) -> Column:
    named = lambda *names: F.lit(rules["results"].get(",".join(names), "NO_MATCH"))
    given, family = F.col("given"), F.col("family")
    return F.when(given & family, named("given", "family")).when(given, named("given")).when(family, named("family")).otherwise(named())


def mdm_match(candidates: DataFrame, keys: DataFrame, rules: dict = RULES) -> DataFrame:
    """(a, b, given, family, result) from keys (id, given_keys, family_key). A combination not in the map is NO_MATCH."""
    side = lambda name: keys.select(F.col("id").alias(name), F.col("given_keys").alias(f"g_{name}"), F.col("family_key").alias(f"f_{name}"))
    joined = candidates.join(side("a"), "a").join(side("b"), "b")
    given = F.coalesce(F.arrays_overlap("g_a", "g_b"), F.lit(False))
    family = F.coalesce(F.col("f_a") == F.col("f_b"), F.lit(False))
    scored = joined.select("a", "b", given.alias("given"), family.alias("family"))
    return scored.withColumn("result", _result(rules))


def _named(people: DataFrame, rules: dict, carry: list[str]) -> DataFrame:
    """Active records with their block keys and phonetic keys, one row a record."""
    active = _typed(people, rules)
    keyed = active.select("id", "resource_type", *carry, block_keys(active, rules).alias("keys"))
    names = phonetic_keys(active.withColumn("id", F.struct("resource_type", "id")))
    return keyed.join(names.select("id.resource_type", "id.id", "given_keys", "family_key"), ["resource_type", "id"])


def _judged(met: DataFrame, rules: dict, given: Column) -> DataFrame:
    family = F.coalesce(F.col("x_family_key") == F.col("y_family_key"), F.lit(False))
    return _in_order(met, given.alias("given"), family.alias("family")).withColumn("result", _result(rules))


def mdm_compare(people: DataFrame, rules: dict = RULES) -> DataFrame:
    """(resource_type, a, b, given, family, result) of every candidate pair: names are encoded and joined to the records
    before these are paired, so the pairs themselves are never joined."""
    one = F.when(F.size("given_keys") == 1, F.get("given_keys", F.lit(0)))  # most have one name: no sets are made for a pair
    named = _named(people, rules, []).withColumn("given_key", one).withColumn("given_mask", _mask(F.col("given_keys")))
    apart = F.col("x_given_mask").bitwiseAND(F.col("y_given_mask")) == 0
    shared = F.coalesce(F.col("x_given_key") == F.col("y_given_key"), F.arrays_overlap("x_given_keys", "y_given_keys"), F.lit(False))
    return _judged(_met(named), rules, F.when(apart, False).otherwise(shared))


def mdm_links(people: DataFrame, rules: dict = RULES) -> DataFrame:
    """(resource_type, a, b, result) of the candidate pairs that are a MATCH or POSSIBLE_MATCH.

    Both results need a shared given key, so records meet in blocks of (block value, given key): pairs of a busy block
    that do not match are never made.
    """
    named = _named(people, rules, []).where("given_keys IS NOT NULL")
    finer = F.flatten(F.transform("keys", lambda k: F.transform("given_keys", lambda g: F.concat(k, F.lit("|"), g))))
    blocks = named.select("id", "resource_type", "family_key", F.array_sort(F.array_distinct(finer)).alias("keys"))
    return _judged(_met(blocks), rules, F.lit(True)).drop("given", "family")


def mdm_eid_matches(identifiers: DataFrame, eid_system: str) -> DataFrame:
    """Links (a, b) between holders of one enterprise identifier (id, system, value): each to the least holder.

    A star carries the same components as all pairs and grows with the holders, not with their square.
    """
    held = identifiers.where((F.col("system") == eid_system) & F.col("value").isNotNull()).select("id", "value").distinct()
    least = held.groupBy("value").agg(F.min("id").alias("a"))
    return held.join(least, "value").where("a <> id").select("a", F.col("id").alias("b")).distinct().withColumn("result", F.lit("MATCH"))


def golden_ids(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, golden_id) of every linked id: the least id of its connected component.

    Alternating large-star and small-star rounds; each is written, and the loop ends when every id hangs on
    one root.
    """
    edges = staged(links.select("a", "b").where("a <> b"), "golden")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "golden")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(down.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "golden")
        roots = edges.select(F.col("b").alias("a"), F.lit(True).alias("is_root")).distinct()
        if edges.groupBy("a").count().join(roots, "a", "left").where("count > 1 OR is_root").isEmpty():
            named = edges.select(F.col("a").alias("id"), F.col("b").alias("golden_id"))
            return named.union(edges.select(F.col("b").alias("id"), F.col("b").alias("golden_id")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def grow_golden_ids(labels: DataFrame, links: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Labels after a batch of new links: (changed, merges).

    ``labels`` (id, golden_id) are those of all links so far. ``changed`` has the ids whose label is new or another than
    before, to be written over the stored ones; ``merges`` (golden_id, into) says which components went into which, for
    whoever kept the old golden ids. Links are first put on the golden ids of their ends, so the rounds run over
    components that the batch ties together, not over their members, and no other component is read but by its label.
    Any split of links into batches gives the labels of ``golden_ids`` over all of them.
    """
    ends = links.select("a", "b").where("a <> b")
    known = labels.select("id", F.col("golden_id").alias("g"))
    asked = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct()
    named = staged(asked.join(known, "id", "left").select("id", F.coalesce("g", "id").alias("g"), F.col("g").isNull().alias("new")), "golden-ends")
    side = lambda name: named.select(F.col("id").alias(name), F.col("g").alias(f"g_{name}"))
    roots = ends.join(side("a"), "a").join(side("b"), "b").select(F.col("g_a").alias("a"), F.col("g_b").alias("b")).distinct()
    moved = staged(golden_ids(roots, max_rounds).where("id <> golden_id").select(F.col("id").alias("g"), F.col("golden_id").alias("into")), "golden-moved")
    side_moved = hinted(moved)
    again = known.join(side_moved, "g").select("id", F.col("into").alias("golden_id"))
    fresh = named.where("new").join(side_moved, "g", "left").select("id", F.coalesce("into", "g").alias("golden_id"))
    before = named.where("new").select(F.col("id").alias("g")).distinct()
    merges = moved.join(before, "g", "left_anti").select(F.col("g").alias("golden_id"), "into")
    return again.unionByName(fresh), merges


def relabelled(labels: DataFrame, changed: DataFrame) -> DataFrame:
    """All labels after ``grow_golden_ids``."""
    return labels.select("id", "golden_id").join(changed.select("id"), "id", "left_anti").unionByName(changed)
