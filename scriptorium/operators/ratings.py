"""Votes and ratings: latest vote wins, guarded votes on axes, and aggregates per page and axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.wiki import Wiki


def latest(votes: DataFrame, *keys: str) -> DataFrame:
    """The last vote of each key by time, then id. A max over a struct combines on the map side, where a window
    would move and sort every vote."""
    others = [c for c in votes.columns if c not in keys and c not in ("ts", "vote_id")]
    best = votes.groupBy(*keys).agg(F.max(F.struct("ts", "vote_id", *others)).alias("v"))
    return best.select(*keys, "v.*")


def percent(positive: Column, votes: Column) -> Column:
    """Whole percent, halves up; 0 without votes."""
    return F.when(votes > 0, F.floor(positive / votes * 100 + 0.5)).otherwise(0).cast("long")


def rating_columns(rate: Column) -> list[Column]:
    positive = F.count_if(rate > 0)
    return [
        F.coalesce(F.sum(rate), F.lit(0)).cast("long").alias("rating"),
        F.count(rate).alias("rating_votes"),
        positive.alias("positive"),
        percent(positive, F.count(rate)).alias("rating_percent"),
    ]


def main_ratings(wiki: Wiki) -> DataFrame:
    """Per voted page: rating, votes, positive votes and their percentage, over the latest vote of each user."""
    return latest(wiki.vote_events(), "user_id", "page_id").groupBy("page_id").agg(*rating_columns(F.col("rate")))


def own_vote(wiki: Wiki, user_id: int) -> DataFrame:
    """Ratings with the vote of one user beside them."""
    votes = latest(wiki.vote_events(), "user_id", "page_id")
    return votes.groupBy("page_id").agg(*rating_columns(F.col("rate")), F.max(F.when(F.col("user_id") == user_id, F.col("rate"))).alias("current_vote"))


def accepted_votes(wiki: Wiki) -> DataFrame:
    """Latest votes on axes that are enabled, open to votes and allow the vote's value."""
    axes = wiki.axes().select("axis_key", "allow_up", "allow_neutral", "allow_down", "can_vote", "enabled")
    allowed = F.when(F.col("rate") > 0, F.col("allow_up")).when(F.col("rate") < 0, F.col("allow_down")).otherwise(F.col("allow_neutral"))
    open_votes = wiki.vote_events().join(axes, "axis_key").filter(F.col("enabled") & F.col("can_vote") & allowed)
    return latest(open_votes.select("vote_id", "user_id", "page_id", "axis_key", "rate", "ts"), "user_id", "page_id", "axis_key")


def axis_ratings(wiki: Wiki, pages: DataFrame) -> DataFrame:
    """A row for each page and each axis with a shown aggregate, zeros where nobody voted."""
    axes = wiki.axes().filter("enabled and show_aggregate").select("axis_key", "label")
    votes = accepted_votes(wiki).groupBy("page_id", "axis_key").agg(F.sum("rate").alias("points"), F.count("*").alias("votes"), F.count_if(F.col("rate") > 0).alias("positive"))
    every = pages.select("page_id").crossJoin(axes)
    zero = F.lit(0).cast("long")
    return every.join(votes, ["page_id", "axis_key"], "left").select(
        "page_id", "axis_key", "label", F.coalesce(F.col("points").cast("long"), zero).alias("points"), F.coalesce("votes", zero).alias("votes"),
        F.coalesce(percent(F.col("positive"), F.col("votes")), zero).alias("percent"),
    )


def after_cancels(votes: DataFrame, cancels: DataFrame, axes: DataFrame) -> DataFrame:
    """Votes without those cancelled on axes that let users cancel."""
    able = cancels.join(axes.filter("enabled and can_cancel").select("axis_key"), "axis_key", "left_semi")
    return votes.join(able, ["user_id", "page_id", "axis_key"], "left_anti")


def checked_writes(wiki: Wiki, locked: Column) -> DataFrame:
    """Every vote with why it is refused, if it is: unknown axis, closed, value not allowed, page locked."""
    allowed = F.when(F.col("rate") > 0, F.col("allow_up")).when(F.col("rate") < 0, F.col("allow_down")).otherwise(F.col("allow_neutral"))
    joined = wiki.vote_events().join(wiki.axes(), "axis_key", "left")
    reason = (
        F.when(F.col("label").isNull(), "unknown axis").when(~F.col("enabled"), "disabled").when(~F.col("can_vote"), "closed").when(~allowed, "value not allowed").when(locked, "locked")
    )
    return joined.select("vote_id", "axis_key", "page_id", "rate", reason.alias("refused"))


def without_own_vote(votes: DataFrame, cancels: DataFrame) -> DataFrame:
    """Main votes (user_id, page_id) without those that their users took back."""
    return votes.join(cancels.select("user_id", "page_id").distinct(), ["user_id", "page_id"], "left_anti")


def rating_states(refs: DataFrame, wiki: Wiki) -> DataFrame:
    """Rating references (page_id, axis_key; a null axis is the main rating), each once, with the state of ``main`` or
    ``custom:key``: label, points, votes and percent. ``declared`` tells whether there is such a rating; one that isn't
    shown has no sums."""
    wanted = refs.select("page_id", "axis_key").distinct().withColumn("ref", F.coalesce(F.concat(F.lit("custom:"), "axis_key"), F.lit("main")))
    axes = wiki.axes().filter("enabled").select(F.concat(F.lit("custom:"), "axis_key").alias("ref"), "label", F.col("show_aggregate").alias("shown"))
    known = axes.unionByName(wiki.spark.range(1).select(F.lit("main").alias("ref"), F.lit("Rating").alias("label"), F.lit(True).alias("shown")))
    custom = accepted_votes(wiki).groupBy("page_id", F.concat(F.lit("custom:"), "axis_key").alias("ref")).agg(*rating_columns(F.col("rate")))
    sums = custom.unionByName(main_ratings(wiki).withColumn("ref", F.lit("main")))
    zero = F.lit(0).cast("long")
    joined = wanted.join(known, "ref", "left").join(sums, ["page_id", "ref"], "left")
    shown = {name: F.when(F.col("shown"), F.coalesce(column, zero)).alias(name) for name, column in (("points", "rating"), ("votes", "rating_votes"), ("percent", "rating_percent"))}
    return joined.select("page_id", "ref", F.col("label").isNotNull().alias("declared"), "label", *shown.values())


def authorized(requests: DataFrame, declared: DataFrame) -> DataFrame:
    """Requests (page_id, ref) for ratings that the page itself declares; others are refused."""
    return requests.join(declared.select("page_id", "ref").distinct(), ["page_id", "ref"], "left_semi")
