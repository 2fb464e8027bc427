"""License scan: an exact set-similarity join between text blocks and notice templates."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.shared import let, staged, table

#: ASCII bytes that are in no word, once A-Z are lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of the base scan and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label and text of public notices, each in one line; a parameter of the scan.
TEMPLATES = [
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl-3", "Licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "Licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer",
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
]


#: Words that a block may hold besides those of its template.
SLACK = 4


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[str, ...]  # distinct, rarest first
    least: int  # tokens that a block must hold
    prefix: int  # leading tokens of which such a block holds one
    words: int  # words with repeats
    must: frozenset[str]  # tokens that tell it from the template of another label

    @property
    def width(self) -> int:
        """Words in a block."""
        return self.words + SLACK


def told_by(wanted: set[str], other: set[str], threshold: float) -> set[str]:
    """Words of a template that a block may not lack, as without them it would meet a notice with the words of ``other``."""
    own = wanted - other
    return own if len(own) <= len(wanted) - math.ceil(threshold * len(wanted) - 1e-9) else set()


def rivals(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, int]]:
    """(winner, loser) by place in the list: where both are met in one place, the winner has words of its own that tell it
    from the loser, as a version or a qualifier, and the loser has none that tell it from the winner."""
    sets = [{t for t in tokens_of(text) if t} for _, text in templates]
    out = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if templates[i][0] != templates[j][0] and told_by(a, b, threshold) and not told_by(b, a, threshold):
                out.append((i, j))
    return out


def tokens_of(text: str) -> list[str]:
    """Words of a template, by the rule that ``spaced`` has for texts."""
    low = text.translate(str.maketrans(UPPER, LOWER))
    return "".join(c if c > "\x7f" or c.isdigit() or "a" <= c <= "z" else " " for c in low).split(" ")


def spaced(text: Column) -> Column:
    """Words in order, each with one blank on either side: neighbours have two blanks between them."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    one = F.trim(F.regexp_replace(low, NOT_WORD, "  "))
    return F.when(one == "", F.lit("")).otherwise(F.concat(F.lit(" "), one, F.lit(" ")))


def n_words_in(padded: Column) -> Column:
    """Words of a string as ``spaced`` makes it, or of a part of one that was cut at word bounds."""
    blanks = F.char_length(padded) - F.char_length(F.replace(padded, F.lit(" "), F.lit("")))
    return F.floor(blanks / 2).cast("long")


def with_base(padded: DataFrame) -> DataFrame:
    """Add n_words, n_base, first_word, last_word and base_labels to rows with the column ``padded``."""
    p = F.col("padded")
    parts = {f"__parts{k}": F.split(p, f" {'  '.join(x.split())} ") for k, x in enumerate(PHRASES)}
    df = padded.withColumns(parts)
    places, firsts, lasts, labels = [], [], [], []
    for k, (phrase, label) in enumerate(PHRASES.items()):
        part, length = F.col(f"__parts{k}"), len(phrase.split())
        n = F.size(part) - 1
        places.append(n)
        firsts.append(F.when(n > 0, n_words_in(part[0])))
        lasts.append(F.when(n > 0, F.col("n_words") - n_words_in(F.element_at(part, -1)) - length))
        labels.append(F.when(n > 0, label))
    df = df.withColumn("n_words", n_words_in(p))
    return df.withColumns(
        {
            "n_base": sum(places, F.lit(0)).cast("long"),
            "first_word": F.array_min(F.array(*firsts)),
            "last_word": F.array_max(F.array(*lasts)),
            "base_labels": F.array_compact(F.array(*labels)),
        }
    ).drop(*parts)


def ordered_templates(
    padded: DataFrame, templates: list[tuple[str, str]], threshold: float
) -> tuple[list[str], list[Template]]:
    """Template words by ascending document frequency over all documents (ties by word), and the templates.

    Only words of templates are counted: no others can be shared, so their places in the order don't
    matter. The counts fetched are as many as the templates have words.
    """
    vocabulary = sorted({t for _, text in templates for t in tokens_of(text) if t})
    held = F.array_intersect(F.split("padded", " +"), F.array(*[F.lit(t) for t in vocabulary]))
    counted = padded.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    frequency = {r["token"]: r["count"] for r in counted}
    order = sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t))
    out = []
    sets = [{t for t in tokens_of(text) if t} for _, text in templates]
    for (label, text), words in zip(templates, sets, strict=True):
        tokens = tuple(t for t in order if t in words)
        least = math.ceil(threshold * len(tokens) - 1e-9)
        must = frozenset().union(*(told_by(words, other, threshold) for (name, _), other in zip(templates, sets, strict=True) if name != label))
        out.append(Template(label, tokens, least, len(tokens) - least + 1, sum(1 for t in tokens_of(text) if t), must))
    return order, out


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    threshold: float = 0.9,
) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    A block is so many consecutive words as the template has, and ``SLACK`` more, from any word on: line ends and comment
    marks don't matter, and words strewn over more than that are no notice. A block meets a template if it holds at least
    ``threshold`` of the template's distinct words, and among them those that tell it from a template of another
    label, as the number of a version. Of two templates met in one place, one that is told from the other by words of its own
    rules out the other if that has none (``rivals``). matches lists (first word of the block, label, containment), of
    blocks of one notice the one that holds most and begins last; labels join those and the base ones; score is 1 where a
    base phrase stands, else the best containment, else 0. Null and blank texts have no words and no labels. Rows that
    repeat are scanned each for itself; an empty table gives no rows; texts are read whole; only the two named columns are
    read.

    Filters, each of which keeps every true match: a row without a prefix word of any template leaves (prefix filter), and
    so does one that holds too few words of each template; blocks are looked for around prefix words alone, where the
    words within reach are at least as many as needed (length filter), and the places i and j of the shared prefix word
    bound what is in common by min(i, j) + 1 + what follows on the shorter side (positional filter). What stays is
    verified by intersection.
    """
    templates = TEMPLATES if templates is None else templates
    padded = docs.select(F.col(id_col).alias("__id"), spaced(F.col(text_col)).alias("padded"))
    order, ordered = ordered_templates(padded.select("padded"), templates, threshold)
    prefix = sorted({t for x in ordered for t in x.tokens[: x.prefix]})
    every = F.array(*[F.lit(t) for t in order])
    words = F.split(F.trim("padded"), " +")
    held = F.filter(F.transform(words, lambda w, k: F.struct(k.alias("at"), w.alias("word"))), lambda h: F.array_contains(every, h["word"]))
    hits = F.when(F.col("padded").rlike(f" (?:{'|'.join(prefix)}) ") & _holds_any(F.array_intersect(every, words), ordered), held) if ordered else F.lit(None).cast("array<struct<at:int,word:string>>")
    rows = staged(with_base(padded).withColumn("hits", hits).withColumn("__row", F.monotonically_increasing_id()).drop("padded"), "license-rows")
    met = staged(_met(rows.where("hits is not null").select("__row", "hits"), order, ordered), "license-met")
    matches = _matches(met, rivals(templates, threshold))
    joined = rows.drop("hits").join(matches, "__row", "left")
    found = F.coalesce("matches", F.array().cast(matches.schema["matches"].dataType))
    label_of = F.transform(found, lambda m: m["label"])
    joined_up = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        F.col("__id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined_up(F.col("base_labels")).alias("base_labels"),
        joined_up(F.concat("base_labels", label_of)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform(found, lambda m: m["containment"])), F.lit(0.0)))
        .alias("score"),
        found.alias("matches"),
    )


def _holds_any(held: Column, ordered: list[Template]) -> Column:
    """Whether the words held by a whole text are enough for some template."""
    enough = lambda h: [F.size(F.array_intersect(h, F.array(*[F.lit(t) for t in x.tokens]))) >= x.least for x in ordered]
    return let(held, lambda h: reduce(Column.__or__, enough(h), F.lit(False)))


def _met(rows: DataFrame, order: list[str], ordered: list[Template]) -> DataFrame:
    """Blocks (__row, template, label, words, width, start, overlap, containment) that meet a template, from rows with hits:
    the template words of a text and where they stand. The template side is as large as its parameter."""
    index = [
        (k, x.label, list(x.tokens), x.least, x.words, x.width, sorted(x.must), place, x.tokens[place])
        for k, x in enumerate(ordered)
        for place in range(x.prefix)
    ]
    schema = "template int, label string, wanted array<string>, least int, words int, width int, must array<string>, place int, token string"
    prefixes = F.broadcast(rows.sparkSession.createDataFrame(index, schema))
    widest = max((x.width for x in ordered), default=1)
    tokens = sorted({r[-1] for r in index})
    at_prefix = F.filter(F.sequence(F.lit(1), F.size("hits")), lambda k: F.element_at("hits", k)["word"].isin(tokens))
    # at most a block's words stand before a hit and after it
    around = lambda k: F.slice("hits", F.greatest(k - widest + 1, F.lit(1)), 2 * widest - 1)
    spots = rows.select("__row", F.explode(F.transform(at_prefix, lambda k: F.struct(F.element_at("hits", k).alias("hit"), around(k).alias("near")))).alias("s"))
    spots = spots.select("__row", F.col("s.hit.at").alias("at"), F.col("s.hit.word").alias("token"), F.col("s.near").alias("near"))
    pairs = spots.join(prefixes, "token")
    near = F.filter("near", lambda h: (h["at"] > F.col("at") - F.col("width")) & (h["at"] < F.col("at") + F.col("width")))
    every = F.array(*[F.lit(t) for t in order])
    pairs = pairs.withColumn("near", near).withColumn("reach", F.array_intersect(every, F.transform("near", lambda h: h["word"])))
    i, j = F.array_position("reach", F.col("token")) - 1, F.col("place")
    after = F.least(F.size("reach") - 1 - i, F.size("wanted") - 1 - j)
    pairs = pairs.where(F.size("reach") >= F.col("least")).where(1 + F.least(i, j) + after >= F.col("least"))
    begins = F.filter("near", lambda h: (h["at"] <= F.col("at")) & F.array_contains("wanted", h["word"]))

    def block(start: Column) -> Column:
        inside = F.filter("near", lambda h: (h["at"] >= start["at"]) & (h["at"] < start["at"] + F.col("width")))
        return F.struct(start["at"].alias("start"), F.array_intersect("wanted", F.transform(inside, lambda h: h["word"])).alias("held"))

    blocks = F.filter(F.transform(begins, block), lambda x: (F.size(x["held"]) >= F.col("least")) & (F.size(F.array_except("must", x["held"])) == 0))
    found = pairs.select("__row", "template", "label", "words", "width", F.size("wanted").alias("n"), F.explode(blocks).alias("b"))
    overlap = F.size("b.held")
    return found.select(
        "__row", "template", "label", "words", "width", F.col("b.start").alias("start"), overlap.alias("overlap"), (overlap / F.col("n")).alias("containment")
    ).dropDuplicates(["__row", "template", "start"])


def _matches(met: DataFrame, ruled: list[tuple[int, int]]) -> DataFrame:
    """(__row, matches) of the rows that have any: what no rival rules out, one block for each notice."""
    spark = met.sparkSession
    sides = F.broadcast(spark.createDataFrame(ruled, "winner int, template int"))  # pairs of templates
    winner = met.select("__row", F.col("template").alias("winner"), F.col("start").alias("w_start"), F.col("width").alias("w_width"))
    meets = (F.col("w_start") < F.col("start") + F.col("width")) & (F.col("start") < F.col("w_start") + F.col("w_width"))
    lost = met.join(sides, "template").join(winner, ["__row", "winner"]).where(meets).select("__row", "template", "start").distinct()
    kept = met.join(lost, ["__row", "template", "start"], "left_anti")
    other = kept.select("__row", "template", F.col("start").alias("o_start"), F.col("overlap").alias("o_overlap"))
    beats = (F.abs(F.col("o_start") - F.col("start")) < F.col("words")) & (
        (F.col("o_overlap") > F.col("overlap")) | ((F.col("o_overlap") == F.col("overlap")) & (F.col("o_start") > F.col("start")))
    )
    beaten = kept.join(other, ["__row", "template"]).where(beats).select("__row", "template", "start").distinct()
    listed = kept.join(beaten, ["__row", "template", "start"], "left_anti")
    match = F.struct(F.col("start").cast("long").alias("word"), "label", "containment")
    return listed.groupBy("__row").agg(F.array_sort(F.collect_list(match)).alias("matches"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op4_sql(threshold: float = 0.9) -> str:
    """Brute force: every run of words of every document that holds enough words, against every template."""
    values, sets = [], [{t for t in tokens_of(text) if t} for _, text in TEMPLATES]
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]::VARCHAR[]"
    for k, (label, text) in enumerate(TEMPLATES):
        least = math.ceil(threshold * len(sets[k]) - 1e-9)
        must = set().union(*(told_by(sets[k], sets[i], threshold) for i, (name, _) in enumerate(TEMPLATES) if name != label))
        values.append(f"({k}, '{label}', {listed(sets[k])}, {least}, {sum(1 for t in tokens_of(text) if t) + SLACK}, {listed(must)})")
    ruled = ", ".join(f"({w}, {l})" for w, l in rivals(TEMPLATES, threshold))
    places = " UNION ALL ".join(
        f"""SELECT rid, '{label}' AS label, i - 1 AS pos FROM (
          SELECT rid, words, unnest(range(1, len(words) - {len(phrase.split()) - 2})) AS i FROM w
          WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' {phrase} '))
        WHERE array_to_string(words[i:i + {len(phrase.split()) - 1}], ' ') = '{phrase}'"""
        for phrase, label in PHRASES.items()
    )
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all({lower}, '{pattern}') AS words FROM d),
p AS ({places}),
base AS (SELECT rid, COUNT(*) AS n_base, MIN(pos) AS first_word, MAX(pos) AS last_word FROM p GROUP BY rid),
t(template, label, wanted, least, width, must) AS (VALUES {', '.join(values)}),
ruled(winner, loser) AS (VALUES {ruled}),
h AS (SELECT rid, words, list_distinct(words) AS held FROM w),
c AS (SELECT rid, words, t.* FROM h, t WHERE len(list_intersect(wanted, held)) >= least),
b AS (SELECT rid, template, label, wanted, least, width, must, s, words[s:s + width - 1] AS block FROM (SELECT *, unnest(range(1, len(words) + 1)) AS s FROM c) WHERE list_contains(wanted, words[s])),
met AS (SELECT rid, template, label, s, width, len(list_intersect(wanted, block)) / len(wanted) AS c FROM b
        WHERE len(list_intersect(wanted, block)) >= least AND list_has_all(block, must)),
m AS (SELECT * FROM met a WHERE NOT EXISTS (SELECT 1 FROM ruled JOIN met o ON o.template = winner WHERE loser = a.template AND o.rid = a.rid AND o.s < a.s + a.width AND a.s < o.s + o.width)),
best AS (SELECT rid, MAX(c) AS c FROM m GROUP BY rid),
bl AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM p GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS s
       FROM (SELECT rid, label FROM p UNION ALL SELECT rid, label FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(COALESCE(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       COALESCE(bl.s, '') AS base_labels, COALESCE(al.s, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE COALESCE(best.c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN best USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid)
"""
