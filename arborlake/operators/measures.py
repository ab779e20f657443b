"""Statistics and regression gates over measurements, and timing logs."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.settle import settle


def selected(rows: DataFrame, by: list[str], value: str, shares: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles by distributed selection: by and one column a name of shares, each (kind, share).

    kind `disc`: the least value that at least that share of the rows does not exceed; `cont`: interpolated between
    the two values around the place share * (n - 1). Nulls do not count. Equal values are counted first; different
    ones are sorted over all tasks, so that a group of any size is dealt to many, and only the sums of its parts
    in the tasks come together, to tell at which rank each part begins.
    """
    key = [F.col(c) for c in by]
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    parts = settle(counted.repartitionByRange(*key, F.col("_v")).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(*by, "_part").agg(F.sum("_c").alias("_s"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).withColumn("_n", F.sum("_s").over(W.partitionBy(*by)))
    places = {name: ((F.ceil(F.lit(Decimal(str(q))) * F.col("_n")) - 1).cast("long"),) * 2 if kind == "disc" else (F.floor(F.lit(q) * (F.col("_n") - 1)), F.ceil(F.lit(q) * (F.col("_n") - 1))) for name, (kind, q) in shares.items()}
    # Only parts that hold one of the places asked for are ranked.
    inside = reduce(or_, [(p >= F.col("_base")) & (p < F.col("_base") + F.col("_s")) for pair in places.values() for p in pair])
    sums = sums.where(inside)
    same = reduce(and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by], F.col("p._part") == F.col("s._part"))
    some = parts.alias("p").join(sums.alias("s"), same).select("p.*", "s._base", "s._n")
    run = W.partitionBy(*by, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    some = some.withColumn("_to", F.col("_base") + F.sum("_c").over(run)).withColumn("_from", F.col("_to") - F.col("_c"))
    at = lambda p: F.max(F.when((p >= F.col("_from")) & (p < F.col("_to")), F.col("_v")))
    aggs = [a for name, (lo, hi) in places.items() for a in (at(lo).alias(f"_{name}_lo"), at(hi).alias(f"_{name}_hi"))]
    found = some.groupBy(*by).agg(F.max("_n").alias("_n"), *aggs)
    mid = lambda name, q: F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (F.lit(q) * (F.col("_n") - 1) - F.floor(F.lit(q) * (F.col("_n") - 1)))
    return found.select(*by, *[(F.col(f"_{name}_lo") if kind == "disc" else mid(name, q)).alias(name) for name, (kind, q) in shares.items()])


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, median, p95 by nearest rank, max, mean, population deviation, and (max - min) / median."""
    v = F.col(value)
    sums = rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"))
    ranks = selected(rows, by, value, {"median": ("cont", 0.5), "p95": ("disc", 0.95)})
    ranks = ranks.select(*[F.col(c).alias(f"_{c}") for c in by], "median", "p95")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    out = sums.join(ranks, same, "left").select(*by, "n", "least", "median", "p95", "most", "mean", "stdev")
    return out.withColumn("spread", ratio(F.col("most") - F.col("least"), F.col("median")))


def ratio(a: Column, b: Column) -> Column:
    """a / b; infinite where b is 0."""
    return F.when(b == 0, F.lit(float("inf"))).otherwise(a / b)


def phase_counters(rows: DataFrame, by: str = "phase") -> DataFrame:
    """Sums by phase; local: nothing in it bears a structural marker."""
    return rows.groupBy(by).agg(F.sum("ns").alias("ns"), F.sum("nodes").alias("nodes"), F.count("*").alias("calls"), F.count_if("marker").alias("markers")).withColumn("local", F.col("markers") == 0)


def counter_delta(before: DataFrame, after: DataFrame, by: str = "phase") -> DataFrame:
    cols = ["ns", "nodes", "calls", "markers"]
    a = before.select(by, *[F.col(c).alias(f"a_{c}") for c in cols])
    j = a.join(after.select(by, *cols), by, "full")
    return j.select(by, *[(F.coalesce(c, F.lit(0)) - F.coalesce(f"a_{c}", F.lit(0))).alias(c) for c in cols])


def timing_gate(base: DataFrame, now: DataFrame, tolerance: float = 0.2, noise: float = 2.0, share: float = 0.8) -> DataFrame:
    """Per scenario blocks, advisory or pass, from distributions by (scenario, corpus).

    A corpus is slower if both median and p95 grew by over the tolerance and the median by over `noise` deviations; a
    scenario blocks if at least `share` of its corpora, and two, are slower.
    """
    a = base.select("scenario", "corpus", F.col("median").alias("m0"), F.col("p95").alias("p0"), F.col("stdev").alias("s0"))
    j = a.join(now.select("scenario", "corpus", F.col("median").alias("m1"), F.col("p95").alias("p1")), ["scenario", "corpus"])
    grew = F.least(ratio(F.col("m1"), F.col("m0")), ratio(F.col("p1"), F.col("p0")))
    units = ratio(F.col("m1") - F.col("m0"), F.col("s0"))
    j = j.withColumn("grew", (grew > 1 + tolerance).cast("int")).withColumn("slow", ((grew > 1 + tolerance) & (units > noise)).cast("int"))
    g = j.groupBy("scenario").agg(F.count("*").alias("corpora"), F.sum("grew").alias("grew"), F.sum("slow").alias("slow"))
    verdict = F.when((F.col("slow") >= 2) & (F.col("slow") >= share * F.col("corpora")), "blocks").when(F.col("grew") > 0, "advisory").otherwise("pass")
    return g.withColumn("verdict", verdict)


def structural_gate(base: DataFrame, now: DataFrame, growth: float = 0.25, least: int = 2) -> DataFrame:
    """Counters by (scenario, corpus, nodes) that grew by over `growth` and at least `least`."""
    j = base.withColumnRenamed("nodes", "n0").join(now.withColumnRenamed("nodes", "n1"), ["scenario", "corpus"])
    grew = (F.col("n1") - F.col("n0") >= least) & (ratio(F.col("n1").cast("double"), F.col("n0").cast("double")) > 1 + growth)
    return j.withColumn("finding", F.when(grew, "COUNTER_GROWTH").otherwise("ok"))


def scaling_gate(rows: DataFrame, flat: float = 1.5) -> DataFrame:
    """Per scenario whether its cost stays flat over corpora: most / least at most `flat`."""
    g = rows.groupBy("scenario").agg(F.max("nodes").alias("most"), F.min("nodes").alias("least"))
    return g.withColumn("finding", F.when(ratio(F.col("most").cast("double"), F.col("least").cast("double")) > flat, "NOT_FLAT").otherwise("ok"))


def log_lines(events: DataFrame) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), level, F.lit("] [TIMING] "), "event_type", F.lit(" duration="), F.format_string("%.3f", F.floor(F.col("value") * 1000) / 1000), F.lit("s"))
    return events.select("event_id", line.alias("line"))


TIMING = r"^(\S+ \S+) \[(\w+)\] \[TIMING\] (\S+) duration=([0-9.]+)s$"


def parse_log(lines: DataFrame) -> DataFrame:
    """(event_id, at, level, op, seconds) of lines of the timing form; importance 0 to 10 by level."""
    part = lambda i: F.regexp_extract("line", TIMING, i)
    rows = lines.where(F.col("line").rlike(TIMING)).select("event_id", part(1).try_cast("timestamp").alias("at"), part(2).alias("level"), part(3).alias("op"), part(4).cast("double").alias("seconds"))
    return rows.withColumn("importance", F.when(F.col("level") == "ERROR", 8).when(F.col("level") == "WARNING", 6).otherwise(4))


def bottlenecks(parsed: DataFrame) -> DataFrame:
    """By operation: calls, total, average, least and most seconds, and its ranks by total and by average."""
    g = parsed.groupBy("op").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total"), F.avg("seconds").alias("average"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    by = lambda c: F.row_number().over(W.orderBy(F.desc(c), "op"))  # noqa: E731  a row an operation
    return g.withColumn("by_total", by("total")).withColumn("by_average", by("average"))


def recent_activity(events: DataFrame, hours: int = 24, at: str = "ts") -> DataFrame:
    """One row: events, those of the last hours before the last event, and the errors among these."""
    last = events.agg((F.max(at) - F.expr(f"INTERVAL {int(hours)} HOURS")).alias("_since"))
    new = F.col(at) > F.col("_since")
    return events.join(F.broadcast(last)).agg(F.count("*").alias("events"), F.count_if(new).alias("last_day"), F.count_if(new & (F.col("event_type") == "error")).alias("errors"))  # last is one row
