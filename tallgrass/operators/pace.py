"""How fast the stages of a campaign go, from the feed of their progress, and how long is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds for each item of a stage where nothing was measured.
DEFAULT = {"discover": 180.0, "enrich": 2.5, "registry": 1.65, "gbp": 0.02, "validate": 0.3}
#: Changes over which the moving rate is taken.
WINDOW = 12


def changes(feed: DataFrame, width: float = 3600.0) -> DataFrame:
    """The rows of a feed (stage, ts in seconds, n, done, total) in which done or total differs from the row before.

    Rows of a stage are compared within spans of time, and the first row of a
    span with the last one of the span before; so a stage's feed is never
    sorted in one task, only its spans are, a row each.
    """
    span = F.floor(F.col("ts") / width)
    rows = feed.select("stage", "ts", "n", F.coalesce("done", F.lit(0)).cast("long").alias("done"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), span.alias("span"))
    now = F.struct("done", "total")
    within = rows.withColumn("before", F.lag(now).over(Window.partitionBy("stage", "span").orderBy("ts", "n")))
    lasts = rows.groupBy("stage", "span").agg(F.max_by(now, F.struct("ts", "n")).alias("last"))
    lasts = lasts.withColumn("earlier", F.lag("last").over(Window.partitionBy("stage").orderBy("span"))).select(F.col("stage").alias("_stage"), F.col("span").alias("_span"), "earlier")
    joined = within.join(lasts, F.col("stage").eqNullSafe(F.col("_stage")) & (F.col("span") == F.col("_span")))
    return joined.filter(~F.coalesce("before", "earlier").eqNullSafe(now)).select("stage", "ts", "n", "done", "total")


def estimates(feed: DataFrame, now: Column) -> DataFrame:
    """stage, elapsed, done, total, growth (of the total), rate, per_item and eta (seconds) of each stage of a feed.

    The rate is that of the last changes; where they show none, that of all.
    Without a rate there is no pace and no end in sight.
    """
    seen = changes(feed)
    order = F.struct("ts", "n")
    whole = seen.groupBy("stage").agg(F.min_by(F.struct("ts", "done", "total"), order).alias("a"), F.max_by(F.struct("ts", "done", "total"), order).alias("z"), F.count(F.lit(1)).alias("k"))
    late = seen.withColumn("_rn", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("ts"), F.desc("n")))).filter(F.col("_rn") <= WINDOW)
    late = late.groupBy("stage").agg(F.min_by(F.struct("ts", "done"), order).alias("w")).withColumnRenamed("stage", "_stage")
    one = whole.join(late, F.col("stage").eqNullSafe(F.col("_stage")))
    speed = lambda a: F.when((F.col("z.ts") > F.col(f"{a}.ts")) & (F.col("z.done") > F.col(f"{a}.done")), (F.col("z.done") - F.col(f"{a}.done")) / (F.col("z.ts") - F.col(f"{a}.ts")))
    rows = one.withColumn("rate", F.coalesce(speed("w"), speed("a")))
    return rows.select(
        "stage", F.greatest(F.lit(0.0), now - F.col("a.ts")).alias("elapsed"), F.col("z.done").alias("done"), F.col("z.total").alias("total"), (F.col("z.total") - F.col("a.total")).alias("growth"), "rate", (1 / F.col("rate")).alias("per_item"),
        F.when((F.col("z.total") > 0) & F.col("rate").isNotNull(), F.greatest(F.lit(0.0), (F.col("z.total") - F.col("z.done")) / F.col("rate"))).alias("eta"),
    )


def paces(measured: DataFrame, store: DataFrame, defaults: dict[str, float] = DEFAULT) -> DataFrame:
    """stage, pace and source for each stage with a default: measured now (stage, per_item), else stored (stage, per_item), else the default."""
    spark = measured.sparkSession
    known = spark.createDataFrame(list(defaults.items()), "stage string, fallback double")
    now, old = measured.select("stage", F.col("per_item").alias("now")), store.select("stage", F.col("per_item").alias("old"))
    rows = known.join(now, "stage", "left").join(old, "stage", "left")
    good = lambda c: F.when(F.col(c) > 0, F.col(c))
    source = F.when(good("now").isNotNull(), "measured on this run").when(good("old").isNotNull(), "measured earlier in this workspace").otherwise("documented default")
    return rows.select("stage", F.coalesce(good("now"), good("old"), F.col("fallback")).alias("pace"), source.alias("source"))


def stored(store: DataFrame, measured: DataFrame, at: Column) -> DataFrame:
    """The store (stage, per_item, measured_at) after a run: what was measured replaces what was there."""
    new = measured.filter("per_item > 0").select("stage", "per_item", at.alias("measured_at"))
    return store.join(new.select("stage"), "stage", "left_anti").select("stage", "per_item", "measured_at").unionByName(new)


def status(work: DataFrame, pace: DataFrame, running: Column | None = None) -> DataFrame:
    """stage, state, done, total, left, pace, source and eta of each stage of work (stage, done, total)."""
    rows = work.join(pace, "stage").withColumn("left", F.greatest(F.lit(0), F.col("total") - F.col("done")))
    state = F.when((F.col("left") == 0) & (F.col("done") > 0), "done").otherwise("pending")
    state = state if running is None else F.when(running, "running").otherwise(state)
    return rows.select("stage", state.alias("state"), "done", "total", "left", "pace", "source", (F.col("left") * F.col("pace")).alias("eta"))


def time_left(stages: DataFrame, overlapped: bool = True, first: str = "discover") -> DataFrame:
    """One row, eta: the first stage, then the longest of the others where they overlap, else their sum."""
    rest = F.when(F.col("stage") != first, F.col("eta"))
    return stages.agg((F.coalesce(F.sum(F.when(F.col("stage") == first, F.col("eta"))), F.lit(0.0)) + F.coalesce(F.max(rest) if overlapped else F.sum(rest), F.lit(0.0))).alias("eta"))
