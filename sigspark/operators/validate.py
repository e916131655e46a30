"""Checks on parameter rows; bad rows are reported, not raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.schema import DEFAULTS

# Form fields in checking order, as (column, kind, name in the message).
SCALAR_FIELDS = (
    ("n_beats", "int", "'Approximate number of heart beats' entered"),
    ("sf_ecg", "int", "'ECG Sampling Frequency' entered"),
    ("sf", "int", "'Internal Sampling Frequency' entered"),
    ("noise_amp", "double", "'Amplitude of additive uniform noise' entered"),
    ("hr_mean", "double", "'Heart rate mean' entered"),
    ("hr_std", "double", "'Heart rate standard deviation' entered"),
    ("seed", "int", "'seed' entered"),
    ("plot_amp", "double", "'Plot Area Amplitude' entered"),
    ("f_lo", "double", "'Low frequency' entered"),
    ("f_hi", "double", "'High frequency' entered"),
    ("f_lo_std", "double", "'Low frequency standard deviation' entered"),
    ("f_hi_std", "double", "'High frequency standard deviation' entered"),
    ("lf_hf_ratio", "double", "'LF/HF ratio' entered"),
)
WAVE_FIELDS = ("theta", "a", "b")
# Messages.
RATE_MESSAGE = "Internal sampling frequency must be an integer multiple of the ECG sampling frequency!"
RULES_MESSAGE = "There were errors in internal validation rules!:."


def message(field: str) -> str:
    return f"Incorrect {field}, please correct it!"


def raw_columns() -> list[str]:
    """The 28 text columns ``validate_params`` reads."""
    return [c for c, _, _ in SCALAR_FIELDS] + [f"{w}_{i}" for w in WAVE_FIELDS for i in range(1, 6)]


def rate_ok(sf: Column, sf_ecg: Column) -> Column:
    """The internal rate is a whole multiple of a positive output rate."""
    return F.coalesce((sf_ecg > 0) & (F.try_mod(sf, sf_ecg) == 0), F.lit(False))


def valid_rates(params: DataFrame) -> DataFrame:
    return params.where(rate_ok(F.col("sf"), F.col("sf_ecg")))


def parse_int(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def parse_double(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def validate_params(raw: DataFrame) -> DataFrame:
    """Add ``errors`` (all messages, in field order) and ``valid`` to rows of text fields.

    A wrong output rate hides the internal rate from checking; both are then left at
    their defaults for the final rule.
    """
    sf_ecg, sf = parse_int(F.col("sf_ecg")), parse_int(F.col("sf"))
    found = []
    for column, kind, field in SCALAR_FIELDS:
        parsed = (parse_int if kind == "int" else parse_double)(F.col(column))
        wrong = parsed.isNull()
        if column == "sf":
            wrong = wrong & sf_ecg.isNotNull()
        found.append(F.when(wrong, message(field)))
        if column == "sf":
            both = sf_ecg.isNotNull() & sf.isNotNull()
            found.append(F.when(both & ~rate_ok(sf, sf_ecg), RATE_MESSAGE))
    for wave_field in WAVE_FIELDS:
        for i in range(1, 6):
            parsed = parse_double(F.col(f"{wave_field}_{i}"))
            found.append(F.when(parsed.isNull(), message(f"'{wave_field}' value entered (position {i})")))
    used_ecg = F.coalesce(sf_ecg, F.lit(DEFAULTS["sf_ecg"]))
    used_sf = F.coalesce(F.when(sf_ecg.isNotNull(), sf), F.lit(DEFAULTS["sf"]))
    found.append(F.when(~rate_ok(used_sf, used_ecg), RULES_MESSAGE))
    return (
        raw.withColumn("errors", F.filter(F.array(*found), lambda m: m.isNotNull()))
        .withColumn("valid", F.size("errors") == 0)
    )


def gate(params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that passed, and the rest for a report."""
    ok = F.coalesce(F.col("valid"), F.lit(False))
    return params.where(ok), params.where(~ok)


def flag_unknown(params: DataFrame, ranges_wide: DataFrame) -> DataFrame:
    """Look up each activity; an unknown one keeps NULL ranges and a reason."""
    known = ranges_wide.withColumn("_known", F.lit(True))
    return (
        params.join(known, "activity", "left")
        .withColumn("reason", F.when(F.col("_known").isNull(), F.concat(F.lit("unknown activity: "), F.coalesce("activity", F.lit("(none)")))))
        .withColumn("valid", F.col("reason").isNull())
        .drop("_known")
    )
