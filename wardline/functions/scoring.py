"""Columns of the early-warning score: references, codes, instants, scores and extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the five vital signs, and the names under which scores and places are kept.
RESPIRATION, SATURATION, HEART_RATE, SYSTOLIC, TEMPERATURE = "9279-1", "59408-5", "8867-4", "8480-6", "8310-5"
VITAL_CODES = (RESPIRATION, SATURATION, HEART_RATE, SYSTOLIC, TEMPERATURE)
SCORE_URL = "http://news2-score"
LOCATION_URL = "http://patient-location"
BLOCK_URL = "block"
DEFAULT_BLOCK = "North"
LOINC = "http://loinc.org"

# NEWS2 bands as (from, to, points), both ends included; None is open. What lies in no band is 0.
BANDS = {
    RESPIRATION: [(None, "8", 3), ("9", "11", 1), ("21", "24", 2), ("25", None, 3)],
    SATURATION: [(None, "91", 3), ("92", "93", 2), ("94", "95", 1)],
    HEART_RATE: [(None, "40", 3), ("41", "50", 1), ("91", "110", 1), ("111", "130", 2), ("131", None, 3)],
    SYSTOLIC: [(None, "90", 3), ("91", "100", 2), ("101", "110", 1), ("220", None, 3)],
    TEMPERATURE: [(None, "35", 3), ("35.1", "36", 1)],
}
# Temperature bands that begin above their lower end.
BANDS_ABOVE = {TEMPERATURE: [("38.1", "39", 1), ("39.1", None, 2)]}


def patient_id(reference: Column) -> Column:
    """Id in a reference to a patient; null for any other reference."""
    return F.when(reference.startswith("Patient/"), F.substring(reference, 9, 1 << 20))


def first_code(concept: Column) -> Column:
    """Code of a concept's first coding; null if there is none."""
    return F.get(concept["coding"], F.lit(0))["code"]


def news2_score(code: Column, value: Column) -> Column:
    """Points of one observation by its code. Null or unknown codes, null values and gaps between bands give 0.

    Values must be decimals: 35.1 has to be exact.
    """

    def edge(text: str) -> Column:
        return F.lit(text).cast("decimal(9,2)")

    score = None
    for vital, bands in BANDS.items():
        points = F.lit(0)
        for low, high, n in reversed(bands):
            inside = F.lit(True)
            if low is not None:
                inside = inside & (value >= edge(low))
            if high is not None:
                inside = inside & (value <= edge(high))
            points = F.when(inside, n).otherwise(points)
        for low, high, n in BANDS_ABOVE.get(vital, []):
            inside = (value > edge(low)) if high is None else (value > edge(low)) & (value <= edge(high))
            points = F.when(inside, n).otherwise(points)
        points = F.when(value.isNull(), 0).otherwise(points)
        score = F.when(code == vital, points) if score is None else score.when(code == vital, points)
    return score.otherwise(0)


def observed_at(issued: Column, effective: Column) -> Column:
    """Issued, else effective, else the epoch."""
    return F.coalesce(issued, effective, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def get_extension(extensions: Column, url: str) -> Column:
    """The first extension with a URL; null if there is none."""
    return F.get(F.filter(extensions, lambda e: e["url"] == url), F.lit(0))


def set_extension(extensions: Column, url: str, field: str, value: Column, fields: str) -> Column:
    """Set ``field`` of the first extension with ``url``; append one if there is none.

    ``fields`` is the DDL type of one extension. A null array counts as empty; a new extension's other fields
    are null.
    """
    held = F.coalesce(extensions, F.array().cast(f"array<{fields}>"))
    urls = F.transform(held, lambda e: F.coalesce(e["url"], F.lit("")))
    at = F.array_position(urls, url)
    changed = F.transform(held, lambda e, i: F.when(i + 1 == at, e.withField(field, value)).otherwise(e))
    blank = F.from_json(F.lit("{}"), fields)
    added = F.array_append(held, blank.withField("url", F.lit(url)).withField(field, value))
    return F.when(at > 0, changed).otherwise(added)


def extract_score(extensions: Column, value_integer: Column, value_quantity: Column, url: str = SCORE_URL) -> Column:
    """First integer score extension, else the integer value, else the quantity cut toward zero, else 0."""
    scored = F.filter(extensions, lambda e: (e["url"] == url) & e["valueInteger"].isNotNull())
    return F.coalesce(F.get(scored, F.lit(0))["valueInteger"], value_integer, value_quantity.cast("int"), F.lit(0))


def block_of(extensions: Column) -> Column:
    """Block inside the location extension; null if either is missing."""
    location = get_extension(extensions, LOCATION_URL)
    return get_extension(location["extension"], BLOCK_URL)["valueString"]


def year_ago(as_of: Column) -> Column:
    """The date one year before, as yyyy-MM-dd."""
    return F.date_format(F.add_months(as_of, -12), "yyyy-MM-dd")


def relative_period(as_of: Column, years: int) -> Column:
    """Start (included) and end (not included) of the ``years`` years before ``as_of``."""
    return F.struct(F.add_months(as_of, -12 * years).alias("start"), as_of.cast("date").alias("end"))


def date_low(text: Column) -> Column:
    """First day of a full or partial date (yyyy, yyyy-MM, yyyy-MM-dd)."""
    return F.to_date(F.concat(text, F.substring(F.lit("0000-01-01"), F.length(text) + 1, F.lit(10))))


def date_high(text: Column) -> Column:
    """First day after a full or partial date."""
    low = date_low(text)
    return F.when(F.length(text) == 4, F.add_months(low, 12)).when(F.length(text) == 7, F.add_months(low, 1)).otherwise(
        F.date_add(low, 1)
    )
