"""Units over time: yearly counts, dense panels, first events, lags, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def yearly(rows: DataFrame, modalities: list[str], dealt: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """Carriers, evidence rows and weight of each unit and year, in all and of each modality. A carrier's rows are summed up first, so that distinct carriers are plain counts.

    dealt: columns that a unit has one value of and that the rows are dealt by; with them the sums need no shuffle. keep: they stay, for what is made of the years next.
    """
    keys = ["unit_id", *dealt, "year"]
    own = lambda m: F.col("carrier_type") == m
    each = rows.filter(F.col("year").isNotNull()).groupBy(*keys, "carrier_key").agg(
        F.count("*").alias("n"), F.sum("pair_weight").alias("w"),
        *(F.count_if(own(m)).alias(f"n_{m}") for m in modalities),
    )
    aggs = [F.count("carrier_key").alias("carriers"), F.sum("n").alias("rows"), F.sum("w").alias("weight")]
    for m in modalities:
        aggs += [F.count_if((F.col(f"n_{m}") > 0) & F.col("carrier_key").isNotNull()).alias(f"{m}_carriers"), F.sum(f"n_{m}").alias(f"{m}_rows")]
    out = each.groupBy(*keys).agg(*aggs)
    return out if keep else out.drop(*dealt)


def dense(by_year: DataFrame, first: int, last: int, counts: list[str], dealt: tuple[str, ...] = ()) -> DataFrame:
    """Every unit in every year of the range, zero where nothing was seen, with running totals of the counts.

    A year that was seen makes its row and those up to the next one seen; a unit's first one makes those before it too. dealt: as in yearly; with them no shuffle is needed.
    """
    columns = [c for c in by_year.columns if c not in ("unit_id", "year", *dealt)]
    along = Window.partitionBy("unit_id", *dealt).orderBy("seen")
    seen = by_year.withColumnRenamed("year", "seen")
    inside = F.col("seen").between(first, last)
    upto = {f"{c}_upto": F.sum(F.when(inside, F.col(c)).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)) for c in counts}
    seen = seen.withColumns({**upto, "low": F.when(F.row_number().over(along) == 1, F.lit(first)).otherwise(F.greatest("seen", F.lit(first))).cast("int"), "high": F.least(F.coalesce(F.lead("seen").over(along) - 1, F.lit(last)), F.lit(last)).cast("int")})
    grid = seen.filter(F.col("low") <= F.col("high")).withColumn("year", F.explode(F.sequence("low", "high")))
    now = lambda c: F.coalesce(F.when(F.col("year") == F.col("seen"), F.col(c)), F.lit(0).cast(by_year.schema[c].dataType)).alias(c)
    so_far = lambda c: F.coalesce(F.when(F.col("year") >= F.col("seen"), F.col(f"{c}_upto")), F.lit(0)).cast("long").alias(f"{c}_so_far")
    return grid.select("unit_id", "year", *map(now, columns), *map(so_far, counts))


def first_events(by_year: DataFrame, modalities: list[str]) -> DataFrame:
    """The first year of each unit and modality, with what was seen then."""
    long = by_year.select("unit_id", "year", F.explode(F.array(*(F.struct(F.lit(m).alias("modality"), F.col(f"{m}_carriers").alias("n")) for m in modalities))).alias("e"))
    seen = long.select("unit_id", "year", "e.*").filter(F.col("n") > 0)
    return seen.groupBy("unit_id", "modality").agg(F.min("year").alias("first_year"), F.min_by("n", "year").alias("first_count"))


def first_years(events: DataFrame, modalities: list[str]) -> DataFrame:
    """One row for each unit with the first year of each modality."""
    return events.groupBy("unit_id").agg(*(F.min(F.when(F.col("modality") == m, F.col("first_year"))).alias(f"first_{m}_year") for m in modalities))


def lags(firsts: DataFrame, base: str, follow_ups: list[str]) -> DataFrame:
    """Years from the base modality's first to each follow-up's, and to the earliest of them; null where either is missing."""
    start = F.col(f"first_{base}_year")
    later = [F.col(f"first_{m}_year") for m in follow_ups]
    out = firsts.withColumns({f"lag_{m}": c - start for m, c in zip(follow_ups, later, strict=True)})
    earliest = F.least(*later)
    return out.withColumn("first_follow_up", earliest).withColumn("lag_follow_up", earliest - start).withColumn("base_first", start <= earliest)


def sequences(by_year: DataFrame, columns: list[str]) -> DataFrame:
    """Each unit's years with the given columns, as one array in order of year."""
    return by_year.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("year", *columns))).alias("steps"))


def undated(rows: DataFrame, modalities: list[str]) -> DataFrame:
    """Carriers and weight of each unit's evidence that has no year, in all and of each modality; units without such evidence have no row."""
    aggs = [F.count_distinct("carrier_key").alias("undated_carriers"), F.round(F.sum("pair_weight"), 6).alias("undated_weight")]
    for m in modalities:
        own = F.col("carrier_type") == m
        aggs += [F.count_distinct(F.when(own, F.col("carrier_key"))).alias(f"{m}_undated_carriers"), F.round(F.coalesce(F.sum(F.when(own, F.col("pair_weight"))), F.lit(0.0)), 6).alias(f"{m}_undated_weight")]
    return rows.filter(F.col("year").isNull()).groupBy("unit_id").agg(*aggs)


def year_range(rows: DataFrame, first: int | None = None, last: int | None = None) -> tuple[int, int]:
    """The first and last year of the rows, or those given; an error where there is no year to take or the first is after the last."""
    low, high = rows.agg(F.min("year"), F.max("year")).first() if first is None or last is None else (first, last)
    first, last = low if first is None else first, high if last is None else last
    if first is None or last is None:
        raise ValueError("no row has a year, so the range must be given")
    if first > last:
        raise ValueError(f"the first year {first} is after the last year {last}")
    return int(first), int(last)
