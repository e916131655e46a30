"""Planning a labelled dataset: scenarios to one parameter row per recording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.clock import instant_text
from sigspark.functions.draws import uniform, uniform_int
from sigspark.functions.shapes import sample_period_ms
from sigspark.functions.text import recording_name
from sigspark.operators.joins import expand_plan, lookup_ranges, widen_ranges
from sigspark.operators.validate import rate_ok
from sigspark.schema import DEFAULTS, RANGE_PARAMS, WAVE_TYPE, default_waves

# Whole-number ranges of the seed and of the R height, range of the R width.
SEED_RANGE = (1, 42)
R_HEIGHT_RANGE = (27, 44)
R_WIDTH_RANGE = (0.08, 0.12)


def union_plans(*plans: DataFrame) -> DataFrame:
    """All rows of all plans, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), plans)


def with_defaults(recordings: DataFrame) -> DataFrame:
    """Default parameters beside each recording."""
    return recordings.withColumns({
        **{name: F.lit(value) for name, value in DEFAULTS.items()},
        "period_ms": sample_period_ms(F.lit(DEFAULTS["sf_ecg"])),
        "waves": default_waves(),
    })


def explode_waves(params: DataFrame) -> DataFrame:
    """Wave array to one row per wave, in P..T order from position 1."""
    others = [c for c in params.columns if c != "waves"]
    return params.select(
        *others, F.posexplode("waves").alias("_pos", "_w")
    ).select(*others, (F.col("_pos") + 1).alias("pos"), "_w.*")


def implode_waves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per wave back to the wave array."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "wave", "theta", "a", "b")))
    return rows.groupBy(*keys).agg(
        F.transform(ordered, lambda w: F.struct(w["wave"].alias("wave"), w["theta"].alias("theta"), w["a"].alias("a"), w["b"].alias("b")))
        .cast(WAVE_TYPE).alias("waves")
    )


def draw_params(plan: DataFrame, seed: int, key: list[str], compat: bool = False) -> DataFrame:
    """Draw each row's parameters from its ranges, keyed by ``key`` columns.

    ``compat`` reproduces the historical corpus: its R-wave draws overwrote the seed with
    the height draw and the height with the width draw, and left the width at its default.
    """
    def draw(name: str, lo: Column, hi: Column) -> Column:
        return uniform(lo, hi, seed, *key, F.lit(name))

    drawn = plan.withColumns({
        **{p: draw(p, F.col(f"{p}_lo"), F.col(f"{p}_hi")) for p in RANGE_PARAMS},
        "noise_amp": draw("noise_amp", F.col("noise_min"), F.col("noise_max")),
    })
    drawn_seed = uniform_int(*SEED_RANGE, seed, *key, F.lit("seed"))
    height = uniform_int(*R_HEIGHT_RANGE, seed, *key, F.lit("a_r"))
    width = draw("b_r", F.lit(R_WIDTH_RANGE[0]), F.lit(R_WIDTH_RANGE[1]))
    if compat:
        return drawn.withColumns({"seed": height, "a_r": width, "b_r": F.lit(0.1)})
    return drawn.withColumns({"seed": drawn_seed, "a_r": height.cast("double"), "b_r": width})


def plan_dataset(
    scenarios: DataFrame,
    ranges: DataFrame,
    seed: int,
    start_us: int,
    sf: int = DEFAULTS["sf"],
    sf_ecg: int = DEFAULTS["sf_ecg"],
    compat: bool = False,
) -> DataFrame:
    """One full parameter row per planned recording: defaults, draws over them, checks and name.

    Every planned row is returned; ``valid`` and ``reason`` say whether it may be made. Names
    start with an instant, ``start_us`` (microseconds since 1970) plus the number of the
    scenario in the order of folder and activity, so no two rows share a name. ``waves`` has
    the drawn R height and width, angles in degrees. No action is run; the only window is
    over the scenario rows.
    """
    number = F.row_number().over(Window.orderBy("folder", "activity", "label")) - 1
    numbered = scenarios.withColumn("_instant", F.lit(start_us).cast("bigint") + number)
    plan = with_defaults(expand_plan(lookup_ranges(numbered, widen_ranges(ranges, list(RANGE_PARAMS)))))
    drawn = draw_params(plan, seed, ["folder", "activity", "sample_no"], compat)
    known = F.col("hr_mean").isNotNull()
    checked = drawn.withColumns({"sf": F.lit(sf), "sf_ecg": F.lit(sf_ecg)}).withColumn(
        "reason",
        F.when(~known, F.concat(F.lit("unknown activity: "), F.col("activity")))
        .when(~rate_ok(F.col("sf"), F.col("sf_ecg")), "rates do not divide"),
    )
    waves = F.transform("waves", lambda w: F.when(
        w["wave"] == "R", F.struct(w["wave"].alias("wave"), w["theta"].alias("theta"), F.col("a_r").alias("a"), F.col("b_r").alias("b"))
    ).otherwise(w)).cast(WAVE_TYPE)
    return checked.withColumns({
        "valid": F.col("reason").isNull(), "waves": waves, "period_ms": sample_period_ms(F.lit(sf_ecg)),
    }).select(
        recording_name(instant_text(F.col("_instant")), F.col("label"), F.col("activity"), F.col("sample_no")).alias("recording_id"),
        F.col("folder").alias("split"), "activity", "label", "sample_no",
        "seed", *RANGE_PARAMS, "noise_amp", "a_r", "b_r", "sf", "sf_ecg", "n_beats", "f_lo_std", "f_hi_std",
        "plot_amp", "period_ms", "waves", "valid", "reason",
    )
