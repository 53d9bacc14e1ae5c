"""Exact percentiles a group by refining histograms, with a state that does not grow with the values.

Every wanted order statistic of a group is a rank within a range of values.  A pass counts the
rows of each range in BUCKETS buckets (partial sums on the map side, min and max of each) and
puts each rank into the bucket that holds it; that bucket is the next range.  A range is
done when its ends are equal.  Buckets depend on the value alone and never fall as it rises, so no
rounding misplaces a rank, and the largest value of a range never shares a bucket with the
smallest: each pass narrows every range.  Ranges beyond a factor of four have logarithmic buckets,
so a pass or two meet the right magnitude and ten bits of the rest follow with each pass.

Defined cases: nulls and NaN are left out; a null group is a group; a group without values is
not in the result; equal values count each; percentiles between two ranks are interpolated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textassay.sources.shared import folder

BUCKETS = 1024
#: A scale that never falls as a value rises: the logarithm over that of the least double, with the value's sign.
_LOG = "(CASE WHEN {0} = 0 THEN 0D WHEN {0} > 0 THEN ln({0}) + 746D ELSE -(ln(-{0}) + 746D) END)"
#: Ranges that are sent to all tasks; more are joined by a shuffle.
SHARED_RANGES = 50_000


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def percentiles(rows: DataFrame, group: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """group and one column for each wanted {name: share between 0 and 1}."""
    base = f"{folder(rows.sparkSession)}/quantiles-{uuid.uuid4().hex}"
    own = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    ends = own.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    places = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in wanted.items()))
    at = F.col("w.p") * (F.col("n") - 1)
    both = ends.select("g", "n", "lo", "hi", F.explode(places).alias("w")).select("g", "lo", "hi", "w.name", at.alias("at"))
    ranks = both.select("g", "lo", "hi", "name", (F.col("at") - F.floor("at")).alias("part"), F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"), F.floor("at").alias("first"))
    targets = _written(ranks.select("g", "lo", "hi", "name", "part", (F.col("rank") == F.col("first")).alias("lower"), F.col("rank").cast("long").alias("rank")).distinct(), f"{base}/0")
    n = 0
    while True:
        open_ = targets.where("lo < hi")
        ranges = _written(open_.select("g", "lo", "hi").distinct(), f"{base}/ranges-{n}")
        many = ranges.count()
        if not many:
            break
        n += 1
        ranges = F.broadcast(ranges) if many <= SHARED_RANGES else ranges.hint("merge")
        inside = own.alias("o").join(ranges.alias("r"), F.expr("o.g <=> r.g AND o.v >= r.lo AND o.v <= r.hi"))
        # within a factor of four linear buckets, else logarithmic ones on both sides of 0
        narrow = "r.lo > 0 AND r.hi / 4 < r.lo OR r.hi < 0 AND r.lo / 4 > r.hi"
        share = f"CASE WHEN {narrow} THEN (o.v - r.lo) / (r.hi - r.lo) ELSE ({_LOG.format('o.v')} - {_LOG.format('r.lo')}) / ({_LOG.format('r.hi')} - {_LOG.format('r.lo')}) END"
        bucket = F.expr(f"CASE WHEN o.v = r.hi THEN {BUCKETS - 1} ELSE least({BUCKETS - 2}, CAST(floor({share} * {BUCKETS - 1}) AS INT)) END")
        counts = inside.select("r.g", "r.lo", "r.hi", bucket.alias("b"), "o.v").groupBy("g", "lo", "hi", "b").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("b")) - F.col("c")  # BUCKETS rows at most
        table = counts.withColumn("before", before)
        met = open_.alias("t").join(table.hint("merge").alias("c"), F.expr("t.g <=> c.g AND t.lo = c.lo AND t.hi = c.hi AND t.rank >= c.before AND t.rank < c.before + c.c"))
        narrowed = met.select("t.g", F.col("c.low").alias("lo"), F.col("c.high").alias("hi"), "t.name", "t.part", "t.lower", (F.col("t.rank") - F.col("c.before")).alias("rank"))
        targets = _written(narrowed.unionByName(targets.where("lo >= hi")), f"{base}/{n}")
    low, high = F.max(F.when(F.col("lower"), F.col("lo"))), F.max(F.when(~F.col("lower"), F.col("lo")))
    found = targets.groupBy("g", "name", "part").agg(low.alias("low"), high.alias("high"))
    exact = found.select("g", "name", F.when(F.col("high").isNull(), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high")).alias("x"))
    return exact.groupBy(F.col("g").alias(group)).agg(*(F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in wanted))
