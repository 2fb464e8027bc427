"""Subscriptions: events matched to what subscribers asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.joins import hinted, joined_by_batches


#: Columns of a subscription that a match is tested on.
ASKED = ("subscription_id", "resource_type", "on_create", "on_update")


def _active(subscriptions: DataFrame, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """Active subscriptions that name a field, by (resource_type, field, value), and those to any resource of a type."""
    active = subscriptions.where("status = 'active'").select(
        F.col("id").alias("subscription_id"), "resource_type", "field", "value", "on_create", "on_update"
    )
    named = active.where("field IS NOT NULL")
    return joined_by_batches(named) if stream else hinted(named), hinted(active.where("field IS NULL").select(*ASKED))


def _triggered() -> Column:
    """Whether the subscription asks for the event's interaction; a null trigger counts as true."""
    return F.coalesce(F.when(F.col("interaction") == "create", F.col("on_create")).otherwise(F.col("on_update")), F.lit(True))


def match_subscriptions(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscription_id, event_id) of active subscriptions and the events they cover.

    Events: event_id, resource_type, interaction (create or update), fields (map of strings). Subscriptions: id,
    status, resource_type, field, value, on_create, on_update; a null field asks for any resource of the type,
    null triggers count as true. Events meet subscriptions by (type, field, value), one row for each field, and
    only those to a whole type by the type alone.
    """
    named, whole = _active(subscriptions, events.isStreaming)
    fields = events.select("event_id", "resource_type", "interaction", F.explode("fields").alias("field", "value"))
    found = [fields.join(named, ["resource_type", "field", "value"]), events.drop("fields").join(whole, "resource_type")]
    return reduce(DataFrame.union, [df.where(_triggered()).select("subscription_id", "event_id") for df in found])


def notification_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("subscription_id").agg(F.count(F.lit(1)).alias("notifications"))


def notification_totals(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``notification_counts`` of all matches without making them: events are counted by what subscriptions ask for."""
    named, whole = _active(subscriptions)
    n = F.count(F.lit(1)).alias("n")
    by_field = events.select("resource_type", "interaction", F.explode("fields").alias("field", "value"))
    by_field = by_field.groupBy("resource_type", "interaction", "field", "value").agg(n)
    by_type = events.groupBy("resource_type", "interaction").agg(n)
    found = [by_field.join(named, ["resource_type", "field", "value"]), by_type.join(whole, "resource_type")]
    rows = reduce(DataFrame.union, [df.where(_triggered()).select("subscription_id", "n") for df in found])
    return rows.groupBy("subscription_id").agg(F.sum("n").alias("notifications"))
