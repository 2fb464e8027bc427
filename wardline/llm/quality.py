"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.shared import free_prefix, let, table

#: ASCII white space, as the word pattern [^\x20\x09-\x0D]+ leaves it out.
SPACE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
NGRAM = 8


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, in order; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def n_symbols_of(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def n_lines_of(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines_of(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _lines(text: Column) -> Column:
    split = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(split, lambda x: F.trim(x, F.lit(SPACE)) != "")


def n_repeat_words_of(words: Column) -> Column:
    """Words inside windows of eight words that the text has twice or more, the first window included.

    Window hashes come from word hashes by three pairwise folds (1, 2, 4 words apart), so a text of n words
    costs O(n). Only texts with an equal pair of windows sort their windows to find where they are.
    """

    def fold(h: Column, apart: int) -> Column:
        return F.zip_with(h, F.slice(h, F.lit(apart + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))

    def windows(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        eight = let(hashes, lambda a: let(fold(a, 1), lambda b: let(fold(b, 2), lambda c: fold(c, 4))))
        return let(eight, lambda h: F.slice(h, F.lit(1), F.size(h) - (NGRAM - 1)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            def has_twin(x: Column, k: Column) -> Column:
                before = F.get(s, k - 1)["h"]
                after = F.get(s, k + 1)["h"]
                return (x["h"] == before).eqNullSafe(True) | (x["h"] == after).eqNullSafe(True)

            return F.filter(s, has_twin)

        starts = let(ordered, lambda s: F.array_sort(F.transform(twins(s), lambda x: x["i"])))
        steps = let(
            starts,
            lambda p: F.zip_with(
                p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(NGRAM), F.coalesce(b - a, F.lit(NGRAM)))
            ),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))

    none = F.lit(0).cast("long")
    found = let(
        windows(words),
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(none),
    )
    return F.when(F.size(words) > NGRAM, found).otherwise(none)


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (long) to every row; columns that have
    these names are replaced, others of any name kept."""
    text, words = F.col(text_col), f"{free_prefix(docs.columns)}words"
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": n_symbols_of(text),
        "n_dup_lines": n_dup_lines_of(text),
        "n_lines": n_lines_of(text),
        "n_repeat_words": n_repeat_words_of(F.col(words)),
    }
    return docs.withColumn(words, words_of(text)).withColumns(counts).drop(words)


@dataclass(frozen=True)
class Rule:
    """``fails`` is built from the text alone, so a cascade evaluates it only if no earlier rule failed.

    ``per_char`` and ``per_word`` weigh what it does for each character and word of a text: nanoseconds of one
    core, measured once. A row's cost follows from its length and not from a clock, so the order of rules on a
    sample is the same in every run.
    """

    name: str
    fails: Column
    per_char: float = 1.0
    per_word: float = 0.0

    def cost(self, chars: Column, words: Column) -> Column:
        return chars * self.per_char + words * self.per_word


def rules(text_col: str = "text") -> list[Rule]:
    """Two base rules and three more, loose enough for ordinary prose in any of the corpus' languages."""
    text = F.col(text_col)
    n_words = F.size(words_of(text))
    mean = let(words_of(text), lambda w: F.char_length(F.array_join(w, "")) / F.greatest(F.size(w), F.lit(1)))
    return [
        Rule("few_words", n_words < 20, 25),
        Rule("repeated_windows", let(words_of(text), lambda w: 100 * n_repeat_words_of(w) > 30 * F.size(w)), 25, 800),
        Rule("symbols", 4 * n_symbols_of(text) > n_words, 45),
        Rule("repeated_lines", let(n_dup_lines_of(text), lambda d: (d > 1) & (10 * d > 3 * n_lines_of(text))), 20),
        Rule("word_length", ~mean.between(2.0, 16.0), 40),
    ]


def metric_rules() -> list[Rule]:
    """The same rules over the columns of ``with_metrics``."""
    c = F.col
    mean = c("word_chars") / F.greatest(c("n_words"), F.lit(1))
    return [
        Rule("few_words", c("n_words") < 20),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 30 * c("n_words")),
        Rule("symbols", 4 * c("n_symbols") > c("n_words")),
        Rule("repeated_lines", (c("n_dup_lines") > 1) & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
        Rule("word_length", ~mean.between(2.0, 16.0)),
    ]


def rank_rules(docs: DataFrame, given: list[Rule], text_col: str = "text", sample_rows: int = 500) -> list[Rule]:
    """The rules, most rejections per cost first, as estimated on about ``sample_rows`` rows; ties by name.

    The sample is the texts whose hash falls in one of so many classes, so it doesn't depend on how rows are
    spread. It only orders the rules: a row's verdict (fails any rule or none) is the same in every order. An
    empty sample keeps the given order.
    """
    total = docs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    sample = docs.select(text_col).where(F.pmod(F.xxhash64(text, F.lit("quality")), F.lit(max(1, total // sample_rows))) == 0)
    chars, words = F.char_length(text), F.size(words_of(F.col(text_col)))
    measures = [F.struct(F.count_if(F.coalesce(r.fails, F.lit(False))).alias("rejected"), F.sum(r.cost(chars, words)).alias("cost")) for r in given]
    found = sample.agg(F.count(F.lit(1)).alias("rows"), *[m.alias(f"rule{k}") for k, m in enumerate(measures)]).first()
    if not found["rows"]:
        return list(given)
    gain = lambda k: (found[f"rule{k}"]["rejected"] + 0.5) / (found[f"rule{k}"]["cost"] + 1)
    return [given[k] for k in sorted(range(len(given)), key=lambda k: (-gain(k), given[k].name))]


def first_failure(ordered: list[Rule]) -> Column:
    """Name of the first rule that a row fails, null if none: CASE evaluates no rule after it."""
    chain = F.when(F.coalesce(ordered[0].fails, F.lit(False)), ordered[0].name)
    for rule in ordered[1:]:
        chain = chain.when(F.coalesce(rule.fails, F.lit(False)), rule.name)
    return chain


def quality_cascade(docs: DataFrame, text_col: str = "text", metrics: bool = False) -> DataFrame:
    """``docs`` plus failed_rule (null: kept) and, if asked for, the metric columns.

    Null and empty texts have no words and fail few_words. Rows are judged one by one, so ties and repeated
    rows get equal verdicts; an empty table gives no rows. Very long texts are read whole. With ``metrics``
    the counts must be made for every row, and the cascade reads them; without, each rule reads the text and
    runs only on rows that passed those before it. Given columns named like a new one are replaced.
    """
    order = [r.name for r in rank_rules(docs, rules(text_col), text_col)]
    base = with_metrics(docs, text_col) if metrics else docs
    named = {r.name: r for r in (metric_rules() if metrics else rules(text_col))}
    return base.withColumn("failed_rule", first_failure([named[n] for n in order]))


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that fail no rule, with their columns as they are."""
    ranked = rank_rules(docs, rules(text_col), text_col)
    return docs.where(first_failure(ranked).isNull())


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return quality_cascade(docs, metrics=True).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.col("failed_rule").isNull().alias("kept"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), m AS (
  SELECT rid, doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines
  FROM w
), win AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 7)
), dup AS (
  SELECT rid, i FROM win QUALIFY COUNT(*) OVER (PARTITION BY rid, win) > 1
), rep AS (
  SELECT rid, SUM(LEAST(8, COALESCE(nxt - i, 8))) AS n
  FROM (SELECT rid, i, LEAD(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid
), r AS (
  SELECT m.*, CAST(COALESCE(rep.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN rep USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 4 * n_symbols > n_words
            OR (n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines)
            OR word_chars < 2.0 * GREATEST(n_words, 1) OR word_chars > 16.0 * GREATEST(n_words, 1)) AS kept
FROM r
"""
