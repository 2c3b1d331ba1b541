"""Outcome buckets against the price paid, archetype classes and their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from seasonlake.functions.fixed_values import OUTCOME_RATES
from seasonlake.functions.stats import share
from seasonlake.operators.history import later_seasons
from seasonlake.operators.ranking import with_rank


def played_role(
    chart: DataFrame, played: DataFrame, entity: str = "entity_id", season: str = "season",
    week: str = "week", flag: str = "is_starter",
) -> DataFrame:
    """Share of weeks listed as a starter, counted over weeks actually played."""
    weeks = played.select(entity, season, week)
    return chart.join(weeks, [entity, season, week]).groupBy(entity, season).agg(
        share(F.col(flag)).alias("started_when_available")
    )


def price_ranks(priced: DataFrame, price: str = "price") -> DataFrame:
    """Rank and percentile inside (season, position); a low price is a high percentile."""
    known = priced.where(F.col(price).isNotNull())
    return with_rank(
        known, ("season", "position"), price,
        rank="price_rank", percent_rank_desc="preseason_percentile",
    )


def outcome_buckets(
    results: DataFrame,
    prices: DataFrame,
    role: DataFrame,
    entity: str = "entity_id",
    price: str = "price",
    min_games: int = 12,
    starter_share: float = 0.5,
    bust_tiers: int = 2,
) -> DataFrame:
    """Finish against price for every (league, season, entity).

    ``results`` carries games_played, points_over_replacement, position_rank,
    starters_at_position and team_count; tiers are ``team_count`` wide. The actual
    percentile ranks priced rows only.
    """
    asked = prices.select(entity, "season", "position", price, "price_rank", "preseason_percentile")
    df = results.join(asked, [entity, "season", "position"], "left")
    df = df.join(role.select(entity, "season", "started_when_available"), [entity, "season"], "left")
    df = df.withColumn(
        "_tracked", F.when(F.col(price).isNotNull(), F.col("points_over_replacement"))
    )
    df = with_rank(
        df, ("league_key", "season", "position"), "_tracked", keep_null=True,
        percent_rank="actual_percentile",
    )
    teams = F.col("team_count")
    df = (
        df.withColumn("finish_tier", F.ceil(F.col("position_rank") / teams).cast("long"))
        .withColumn("expected_tier", F.ceil(F.col("price_rank") / teams).cast("long"))
        .withColumn("tier_delta", F.col("expected_tier") - F.col("finish_tier"))
        .withColumn("is_elite_finish", F.col("position_rank") <= teams)
        .withColumn("is_startable_finish", F.col("position_rank") <= F.col("starters_at_position"))
        .withColumn(
            "percentile_delta", F.col("actual_percentile") - F.col("preseason_percentile")
        )
    )
    short = F.col("games_played") < min_games
    started = F.coalesce(F.col("started_when_available"), F.lit(0.0)) >= starter_share
    gain, elite = F.col("tier_delta"), F.col("is_elite_finish")
    bucket = (
        F.when(F.col("preseason_percentile").isNull(), "No Preseason ADP")
        .when(short & started, "Got Injured")
        .when(short, "Never Had The Job")
        .when(elite & (gain >= 1), "League Winner")
        .when(elite, "Delivered")
        .when(gain >= 1, "Beat His Price")
        .when(gain <= -bust_tiers, "Busted")
        .when(gain == 0, "Met His Price")
        .otherwise("Fine")
    )
    return df.withColumn("outcome_bucket", bucket).drop("_tracked")


def archetype(
    prior_elite: Column, age: Column, experience: Column,
    youth: int = 2, veteran_experience: int = 6, veteran_age: int = 27,
) -> Column:
    """Five cells that partition everyone whose age and experience are known."""
    proven = prior_elite > 0
    veteran = (age >= veteran_age) | (experience >= veteran_experience)
    return F.when(
        age.isNotNull() & experience.isNotNull(),
        F.when(~proven & (experience <= youth), "Unproven Youth")
        .when(proven & veteran, "Proven Veteran")
        .when(proven, "Proven Prime")
        .when(veteran, "Unproven Veteran")
        .otherwise("Unproven Prime"),
    )


def archetype_outcomes(
    df: DataFrame,
    reference_league: str,
    price: str = "price",
    surplus: str = "surplus_centered",
    min_rows: int = 50,
    min_t: float = 2.0,
    buckets: dict[str, str] = OUTCOME_RATES,
) -> DataFrame:
    """(league, position, archetype): rates, surplus statistics and the gated edge.

    Whether a cell is reliable is decided on the reference league and applied to all.
    """
    cell = ["league_key", "position", "archetype"]
    played = df.where(F.col("outcome_bucket").isNotNull() & F.col("archetype").isNotNull())
    value = F.col(surplus)
    rates = [
        F.avg((F.col("outcome_bucket") == name).cast("double")).alias(column)
        for name, column in buckets.items()
    ]
    flat = played.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("n_scored"),
        F.avg(price).alias("mean_price"),
        F.avg(F.col("is_elite_finish").cast("double")).alias("elite_finish_rate"),
        F.avg(value).alias("mean_surplus"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("surplus_se"),
        F.avg((value > 0).cast("double")).alias("surplus_positive_rate"),
        *rates,
    )
    seasons = played.where(value.isNotNull()).groupBy(*cell, "season").agg(F.avg(value).alias("m"))
    seasons = seasons.groupBy(*cell).agg(
        F.count_if(F.col("m") > 0).alias("seasons_positive"),
        F.count(F.lit(1)).alias("seasons_measured"),
    )
    out = flat.join(seasons, cell, "left").na.fill(0, ["seasons_positive", "seasons_measured"])
    out = out.withColumn(
        "surplus_t", F.col("mean_surplus") / F.nullif(F.col("surplus_se"), F.lit(0.0))
    )
    gate = (F.col("n_scored") >= min_rows) & (F.abs("surplus_t") >= min_t)
    # at most leagues x positions x 5 rows from here on
    decided = F.max(F.when(F.col("league_key") == reference_league, gate)).over(
        W.partitionBy("position", "archetype")
    )
    out = out.withColumn("is_reliable", F.coalesce(decided, F.lit(False)))
    return out.withColumn(
        "archetype_edge", F.when(F.col("is_reliable"), F.col("mean_surplus")).otherwise(0.0)
    )


def walk_forward_edge(
    df: DataFrame,
    reference_league: str,
    surplus: str = "surplus_centered",
    min_rows: int = 50,
    min_t: float = 2.0,
    min_seasons: int = 3,
) -> DataFrame:
    """Attach ``archetype_edge``: the gated mean surplus of earlier seasons only.

    Each season reduces to count, sum and squared deviation per cell; earlier
    seasons are then combined on that small table, so no row is copied per fold.
    """
    value = F.col(surplus)
    scored = df.where(value.isNotNull())
    last = df.agg(F.max("season").alias("m")).scalar()
    known = scored.select("season").distinct()
    per_season = scored.where(
        (F.col("league_key") == reference_league) & F.col("archetype").isNotNull()
    ).groupBy("position", "archetype", "season").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.var_pop(value).alias("v")
    )
    sums = later_seasons(per_season, last, "season", "target").groupBy("position", "archetype", "target").agg(
        F.sum("n").alias("n"),
        (F.sum("s") / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"),
    )
    squares = F.greatest(
        F.col("within") + F.col("between") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0)
    )
    error = F.sqrt(squares / F.nullif(F.col("n") - 1, F.lit(0))) / F.sqrt(F.col("n"))
    passes = (F.col("n") >= min_rows) & (F.abs(F.col("mean") / F.nullif(error, F.lit(0.0))) >= min_t)
    edges = sums.select(
        "position", "archetype", F.col("target").alias("season"),
        F.when(passes, F.col("mean")).otherwise(0.0).alias("_edge"),
    )
    enough = later_seasons(known, last, "season", "target").groupBy("target").agg(F.count(F.lit(1)).alias("k"))
    enough = enough.where(F.col("k") >= min_seasons).select(
        F.col("target").alias("season"), F.lit(True).alias("_open")
    )
    out = df.join(edges, ["position", "archetype", "season"], "left").join(enough, "season", "left")
    edge = F.when(F.col("_open"), F.coalesce(F.col("_edge"), F.lit(0.0)))
    return out.withColumn("archetype_edge", edge).drop("_edge", "_open")
