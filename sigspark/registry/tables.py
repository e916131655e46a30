"""The driver's tables as signals, beats and plans, in Spark and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions.clock import epoch_micros
from sigspark.operators.index import with_index
from sigspark.sources.scratch import scratch_path

# Event types in peak-code order 1..5; the middle one stands for R.
EVENT_CODES = ("view", "click", "purchase", "signup", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_code(column: str = "event_type"):
    code = F.lit(0)
    for number, name in enumerate(EVENT_CODES, start=1):
        code = F.when(F.col(column) == name, number).otherwise(code)
    return code


def samples(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Events as samples of a signal: one recording per user, ``t`` in seconds, event type as peak code."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").cast("string").alias("recording_id"),
        (epoch_micros(events, "ts") / F.lit(1e6)).alias("t"),
        F.col("value").alias("v"), event_code().alias("peak"), "event_id", *extra,
    )


def signal(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The samples numbered along each recording."""
    return with_index(samples(spark, sf_dir, *extra), ["recording_id"], ["t", "event_id"]).select(
        "recording_id", "idx", "t", "v", "peak", "event_id", *extra
    )


def stored_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same signal, numbered once and written as a table, for operators that read it twice."""
    rows = signal(spark, sf_dir)
    path = scratch_path(spark, "signal")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


SIGNAL = """sig AS (
  SELECT CAST(user_id AS VARCHAR) AS recording_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
         epoch_us(ts) / 1e6 AS t, value AS v,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
                         WHEN 'signup' THEN 4 WHEN 'error' THEN 5 ELSE 0 END AS peak,
         event_id, ts
  FROM events)"""


def with_signal(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([SIGNAL, *more]) + "\n" + body


# --- customers as parameter rows -----------------------------------------------

# Market segments as activities; the last one is not in the range table.
SEGMENT_ACTIVITY = {
    "AUTOMOBILE": "Resting-Normal",
    "BUILDING": "Resting-Abnormal",
    "FURNITURE": "Working-Normal",
    "HOUSEHOLD": "Working-Abnormal",
    "MACHINERY": "Exercising",
}


def activity(segment: str = "c_mktsegment"):
    out = F.lit(None).cast("string")
    for name, act in SEGMENT_ACTIVITY.items():
        out = F.when(F.col(segment) == name, act).otherwise(out)
    return out


ACTIVITY = (
    "CASE c_mktsegment "
    + " ".join(f"WHEN '{s}' THEN '{a}'" for s, a in SEGMENT_ACTIVITY.items())
    + " END"
)


def dbl(x: float) -> str:
    """A number as a DOUBLE literal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def values(rows) -> str:
    """Rows as the body of a SQL VALUES list."""
    def one(v):
        return dbl(v) if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def customer_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario per nation and segment, with as many samples as it has customers."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey", activity().alias("activity")).agg(F.count(F.lit(1)).cast("int").alias("samples"))
        .select(
            F.concat(F.lit("Env"), F.col("c_nationkey").cast("string")).alias("folder"), "activity",
            (F.col("c_nationkey") % 4).alias("label"), "samples",
            (0.05 + F.col("c_nationkey") / 100.0).alias("noise_min"),
            (0.15 + F.col("c_nationkey") / 100.0).alias("noise_max"),
        )
    )


CUSTOMER_SCENARIOS = f"""scen AS (
  SELECT 'Env' || CAST(c_nationkey AS VARCHAR) AS folder, {ACTIVITY} AS activity,
         c_nationkey % 4 AS label, CAST(count(*) AS INTEGER) AS samples,
         0.05e0 + c_nationkey / 100e0 AS noise_min, 0.15e0 + c_nationkey / 100e0 AS noise_max
  FROM customer GROUP BY c_nationkey, c_mktsegment)"""
