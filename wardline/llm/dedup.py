"""Exact dedup by progressive refinement: length, prefix hash, then the full hash of what is left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.shared import free_prefix, hinted, small, staged, table

#: Words of 64 bits in a filter at most: it is a broadcast of so many rows of two numbers, and tells 8 million shared keys
#: from others with one error in sixteen.
FILTER_WORDS = 1 << 21
#: Bits of a filter for each key in it.
BITS_PER_KEY = 16


def filter_size(keys: int, most: int = FILTER_WORDS) -> int:
    """Words of a filter for so many keys: ``BITS_PER_KEY`` each, rounded up to a power of two."""
    return min(most, 1 << max(4, (max(keys, 1) * BITS_PER_KEY // 64 - 1).bit_length()))


def bit_filter(keys: DataFrame, key: Column, words: int) -> DataFrame:
    """Rows (word, bits) of a bit map with the hashed ``key`` of every row set."""
    at = keys.select(F.xxhash64(key).alias("h")).select(_word(F.col("h"), words).alias("word"), _bit(F.col("h")).alias("bit"))
    return at.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words)).cast("int")


def _bit(h: Column) -> Column:
    return F.shiftrightunsigned(h, 58).cast("int")


@dataclass(frozen=True)
class Filter:
    """A written bit map of the keys that more than one row has."""

    bits: DataFrame
    words: int

    @classmethod
    def of_shared(cls, rows: DataFrame, key: list[str], most: int, name: str) -> Filter:
        """The keys are counted before the filter is sized, so it grows with them, up to ``most`` words."""
        shared = staged(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), f"{name}-keys")
        words = filter_size(shared.count(), most)
        return cls(staged(bit_filter(shared, F.struct(*key), words), name), words)

    def ask(self, rows: DataFrame, key: Column, found: str) -> DataFrame:
        """Add ``found``: false only for rows whose key no other row has."""
        prefix = free_prefix(rows.columns)
        h, word, bits = (f"{prefix}{x}" for x in ("h", "word", "bits"))
        side = F.broadcast(self.bits.select(F.col("word").alias(word), F.col("bits").alias(bits)))  # at most ``words`` rows
        asked = rows.withColumn(h, F.xxhash64(key)).withColumn(f"{prefix}at", _word(F.col(h), self.words))
        is_set = F.getbit(F.col(bits), _bit(F.col(h))) == 1
        joined = asked.join(side, F.col(f"{prefix}at") == F.col(word), "left")
        return joined.withColumn(found, F.coalesce(is_set, F.lit(False))).drop(h, f"{prefix}at", word, bits)


@dataclass(frozen=True)
class Passes:
    """The first two passes over a table of texts: which lengths, and which pairs of length and prefix, are shared."""

    lengths: Filter
    prefixes: Filter
    prefix_chars: int

    @classmethod
    def over(cls, texts: DataFrame, text_col: str, prefix_chars: int, most: int) -> Passes:
        narrow = texts.select(*_keys(F.coalesce(F.col(text_col), F.lit("")), prefix_chars))
        lengths = Filter.of_shared(narrow, ["n_bytes"], most, "dedup-lengths")
        alike = lengths.ask(narrow, F.struct("n_bytes"), "alike").where("alike")
        return cls(lengths, Filter.of_shared(alike, ["n_bytes", "prefix_hash"], most, "dedup-prefixes"), prefix_chars)

    def survivors(self, docs: DataFrame, text_col: str, sha: str, digest_all: bool = False) -> DataFrame:
        """``docs`` with ``sha``, the full hash of texts whose length and prefix others have too; null for all others,
        whose texts are not hashed, unless ``digest_all`` asks for it."""
        prefix = free_prefix([*docs.columns, sha])
        n, head, long_alike, begins_alike = (f"{prefix}{x}" for x in ("n_bytes", "prefix_hash", "long", "begins"))
        body = F.coalesce(F.col(text_col), F.lit(""))
        n_bytes, prefix_hash = _keys(body, self.prefix_chars)
        rows = self.lengths.ask(docs.withColumn(n, n_bytes), F.struct(F.col(n).alias("n_bytes")), long_alike)
        rows = rows.withColumn(head, F.when(F.col(long_alike), prefix_hash))
        rows = self.prefixes.ask(rows, F.struct(F.col(n).alias("n_bytes"), F.col(head).alias("prefix_hash")), begins_alike)
        full, survives = F.sha2(body, 256), F.col(long_alike) & F.col(begins_alike)
        made = full if digest_all else F.when(survives, full)
        return rows.withColumn(sha, made).drop(n, head, long_alike, begins_alike)


def _keys(body: Column, prefix_chars: int) -> tuple[Column, Column]:
    return F.octet_length(body).alias("n_bytes"), F.xxhash64(F.substring(body, 1, prefix_chars)).alias("prefix_hash")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest_all: bool = False,
    filter_words: int = FILTER_WORDS,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id
    stays (a null id is lower than any other; rows that repeat id and text count, and one of them stays).
    An empty table gives an empty result. Only ``id_col`` and ``text_col`` are read, so further columns of
    any name do no harm. ``text_sha256`` is null for rows without a copy, unless ``digest_all`` asks for it.

    Pass one counts lengths. Pass two hashes the prefix of rows whose length others have too, and counts
    (length, prefix hash). Pass three hashes the full text of rows whose pair others have too. A row finds out
    whether others share its key in a bit map of all shared keys: its size follows their number up to a bound, so
    no text is shuffled at any size; a row that it lets pass by chance is hashed in vain and found alone. Rows
    meet their group's verdict in a join of two narrow tables that adaptive execution can split at a hot group.
    """
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__body"))
    passes = Passes.over(texts, "__body", prefix_chars, filter_words)
    hashed = passes.survivors(texts, "__body", "text_sha256", digest_all)
    n_bytes = F.octet_length(F.coalesce("__body", F.lit(""))).alias("n_bytes")
    rows = staged(hashed.select("__id", F.monotonically_increasing_id().alias("__row"), n_bytes, "text_sha256"), "dedup-rows")
    groups = staged(
        rows.where("text_sha256 IS NOT NULL")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("__id", "__row")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.col("text_sha256").alias("__sha"), "keeper", "group_size"),
        "dedup-groups",
    )
    joined = rows.join(groups, F.col("text_sha256") == F.col("__sha"), "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("__id").alias(id_col),
        F.when(alone, F.col("__id")).otherwise(F.col("keeper.__id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, True).otherwise(F.col("keeper.__row") == F.col("__row")).alias("kept"),
        F.col("text_sha256") if digest_all else F.col("__sha").alias("text_sha256"),
        F.col("n_bytes").cast("long").alias("n_bytes"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, filter_words: int = FILTER_WORDS) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` does not keep; columns as given, whatever their names.

    Only texts that survive the first two passes are hashed: once for the verdict on (id, hash), and once for the row that
    meets it. A row without a hash has no copy and stays.
    """
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__body"))
    passes = Passes.over(texts, "__body", prefix_chars, filter_words)
    held = passes.survivors(texts, "__body", "sha").where("sha IS NOT NULL").select("__id", "sha")
    pairs = held.groupBy("__id", "sha").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(pairs, "dedup-pairs")
    largest = counts.groupBy("sha").agg(F.max(F.struct(F.col("__id"))).alias("k"), F.sum("n").alias("all")).where("all > 1")
    largest = hinted(staged(largest, "dedup-largest"))  # a row a group: a hot group's rows stay where they are
    verdict = staged(counts.join(largest, "sha").select("__id", "sha", "n", F.col("__id").eqNullSafe(F.col("k.__id")).alias("stays")), "dedup-verdict")
    sha, row = (f"{free_prefix(docs.columns)}{x}" for x in ("sha", "id"))
    marked = passes.survivors(docs, text_col, sha)
    gone = verdict.where("not stays").select(F.col("__id").alias(row), F.col("sha").alias(f"{row}_sha"))
    is_named = (F.col(sha) == F.col(f"{row}_sha")) & F.col(id_col).eqNullSafe(F.col(row))
    if small(gone):
        left = marked.join(F.broadcast(gone), is_named, "left_anti")
    else:  # texts without a hash are not shuffled to a join that they cannot meet
        left = marked.where(F.col(sha).isNull()).unionByName(marked.where(F.col(sha).isNotNull()).join(gone, is_named, "left_anti"))
    repeats = verdict.where("stays and n > 1")
    if repeats.isEmpty():
        return left.drop(sha)
    # rows that repeat both id and text: fold them to one, and leave all others alone
    side = hinted(repeats.select(F.col("__id").alias(row), F.col("sha").alias(f"{row}_sha")))
    once = left.join(side, is_named, "left_semi").dropDuplicates([id_col, sha])
    return left.join(side, is_named, "left_anti").unionByName(once).drop(sha)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP5_SQL = """
SELECT doc_id,
       MAX(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS keep_id,
       COUNT(*) OVER (PARTITION BY COALESCE(text, '')) AS group_size,
       doc_id = MAX(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS kept,
       sha256(COALESCE(text, '')) AS text_sha256
FROM documents
"""
