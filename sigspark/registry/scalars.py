"""Queries of the column functions (H) and the row-wise operators (B)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sigspark import schema
from sigspark.functions import clock, draws, shapes, text
from sigspark.operators import samples, validate
from sigspark.operators.chunks import attach, lengths, with_chunk
from sigspark.operators.joins import widen_ranges
from sigspark.operators.spectral import two_band_spectrum
from sigspark.operators.windows import match_moments
from sigspark.plans.dataset import explode_waves, with_defaults
from sigspark.registry.base import query, rounded
from sigspark.registry.tables import (
    ACTIVITY, activity, dbl, signal, stored_signal, table, values, with_signal,
)

WAVE_SQL = values(schema.DEFAULT_WAVES)


@query("h1_radians", "SELECT event_id, round(radians(value), 9) AS rad FROM events")
def h1_radians(spark, d):
    return table(spark, d, "events").select("event_id", rounded(shapes.deg2rad(F.col("value")), 9).alias("rad"))


def _customer_rates(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", (40 + F.col("c_custkey") % 100).cast("double").alias("hr_mean")
    )


@query("h2_rate_adjust", f"""
WITH c AS (SELECT c_custkey, CAST(40 + c_custkey % 100 AS DOUBLE) AS hr_mean FROM customer),
     w(pos, wave, theta, a, b) AS (VALUES {values([(i + 1, *w) for i, w in enumerate(schema.DEFAULT_WAVES)])})
SELECT c_custkey, hr_mean, CAST(pos AS INTEGER) AS pos, wave,
       round(radians(theta) * CASE WHEN wave = 'P' THEN pow(hr_mean / 60, 0.25)
                                   WHEN wave IN ('Q', 'S') THEN sqrt(hr_mean / 60) ELSE 1 END, 9) + 0.0 AS theta,
       a, round(b * sqrt(hr_mean / 60), 9) AS b
FROM c, w""")
def h2_rate_adjust(spark, d):
    rows = _customer_rates(spark, d).withColumn("waves", shapes.rate_adjust_waves(schema.default_waves(), F.col("hr_mean")))
    return explode_waves(rows).select(
        "c_custkey", "hr_mean", "pos", "wave", rounded("theta", 9), "a", rounded("b", 9)
    )


@query("h3_wrap", """
SELECT event_id, round(value - 2 * pi() * round_even(value / (2 * pi()), 0), 9) + 0.0 AS wrapped FROM events""")
def h3_wrap(spark, d):
    return table(spark, d, "events").select("event_id", rounded(shapes.wrap_angle(F.col("value")), 9).alias("wrapped"))


@query("h4_phase", """
SELECT vec_id, round(atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)), 9) + 0.0 AS theta
FROM embeddings""")
def h4_phase(spark, d):
    e = F.col("embedding")
    theta = shapes.phase(e[0].cast("double"), e[1].cast("double"))
    return table(spark, d, "embeddings").select("vec_id", rounded(theta, 9).alias("theta"))


def _bump_sql() -> str:
    terms = []
    for _, theta, a, b in schema.DEFAULT_WAVES:
        dt = f"(value - {dbl(math.radians(theta))} - 2 * pi() * round_even((value - {dbl(math.radians(theta))}) / (2 * pi()), 0))"
        terms.append(f"{dbl(-a)} * {dt} * exp(-0.5 * pow({dt} / {dbl(b)}, 2))")
    return " + ".join(terms)


@query("h5_template", f"SELECT event_id, round({_bump_sql()}, 6) + 0.0 AS slope FROM events")
def h5_template(spark, d):
    waves = F.transform(schema.default_waves(), lambda w: w.withField("theta", shapes.deg2rad(w["theta"])))
    return table(spark, d, "events").select("event_id", rounded(shapes.bump_sum(F.col("value"), waves)).alias("slope"))


@query("h6_wander", """
SELECT event_id, round(0.005 * sin(2 * pi() * 0.25 * value), 9) + 0.0 AS wander FROM events""")
def h6_wander(spark, d):
    return table(spark, d, "events").select(
        "event_id", rounded(shapes.baseline_wander(F.col("value"), F.lit(0.25)), 9).alias("wander")
    )


def unit_sql(*keys: str) -> str:
    """The digest draw in SQL."""
    joined = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(concat('0x', substr(md5({joined}), 1, 8)) AS BIGINT) / 4294967296e0)"


@query("h7_noise", f"""
SELECT event_id, round(value + 0.1e0 * (2 * {unit_sql('3', 'event_id')} - 1), 9) + 0.0 AS v FROM events""")
def h7_noise(spark, d):
    noisy = shapes.add_noise(F.col("value"), 0.1, draws.unit_draw(3, "event_id"))
    return table(spark, d, "events").select("event_id", rounded(noisy, 9).alias("v"))


@query("h8_uniform", f"""
SELECT event_id, round(5e0 + 5e0 * {unit_sql('7', 'user_id', 'event_id')}, 9) AS u FROM events""")
def h8_uniform(spark, d):
    return table(spark, d, "events").select(
        "event_id", rounded(draws.uniform(5.0, 10.0, 7, "user_id", "event_id"), 9).alias("u")
    )


@query("h9_uniform_int", f"""
SELECT event_id, CAST(1 + floor({unit_sql('1', 'event_id')} * 42) AS INTEGER) AS seed,
       CAST(27 + floor({unit_sql('2', 'event_id')} * 18) AS INTEGER) AS height FROM events""")
def h9_uniform_int(spark, d):
    return table(spark, d, "events").select(
        "event_id", draws.uniform_int(1, 42, 1, "event_id").alias("seed"),
        draws.uniform_int(27, 44, 2, "event_id").alias("height"),
    )


@query("h10_spectrum", """
WITH p AS (SELECT c_custkey, 0.05e0 + c_custkey % 10 / 100e0 AS f_lo, 0.2e0 + c_custkey % 7 / 100e0 AS f_hi FROM customer),
     g AS (SELECT *, unnest(range(32)) AS k FROM p),
     w AS (SELECT *, 2 * pi() * least(k, 32 - k) / 32e0 AS w, 2 * pi() * f_lo AS w1, 2 * pi() * f_hi AS w2,
                  2 * pi() * 0.05e0 AS c1, 2 * pi() * 0.03e0 AS c2 FROM g)
SELECT c_custkey, k, round(0.5e0 * sqrt(
         0.5e0 * exp(-0.5 * pow(w - w1, 2) / pow(c1, 2)) / sqrt(2 * pi() * c1 * c1)
         + exp(-0.5 * pow(w - w2, 2) / pow(c2, 2)) / sqrt(2 * pi() * c2 * c2)), 6) AS amplitude
FROM w""")
def h10_spectrum(spark, d):
    k = F.col("c_custkey")
    params = table(spark, d, "customer").select(
        "c_custkey", (0.05 + k % 10 / 100.0).alias("f_lo"), (0.2 + k % 7 / 100.0).alias("f_hi"),
        F.lit(0.05).alias("f_lo_std"), F.lit(0.03).alias("f_hi_std"), F.lit(0.5).alias("lf_hf_ratio"),
    )
    return two_band_spectrum(params, 32, 1.0).select("c_custkey", "k", rounded("amplitude"))


@query("h11_match_moments", with_signal("""
SELECT recording_id, idx, round(v * 0.25 / nullif(stddev_samp(v) OVER (PARTITION BY recording_id), 0) + 1.5, 6) + 0.0 AS v
FROM sig"""))
def h11_match_moments(spark, d):
    out = match_moments(stored_signal(spark, d).select("recording_id", "idx", "v"), F.lit(1.5), F.lit(0.25))
    return out.select("recording_id", "idx", rounded("v"))


@query("h12_pow2", """
SELECT o_orderkey, CASE WHEN n <= 1 THEN 1 ELSE CAST(pow(2, length(ltrim(bin(n - 1), '0'))) AS BIGINT) END AS size
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def h12_pow2(spark, d):
    n = F.floor("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", shapes.next_pow2(n).alias("size"))


@query("h13_format_axis", r"""
SELECT event_id, CASE WHEN value = 0 OR (abs(value) <= 100 AND abs(value) > 0.01) THEN printf('%.2f', value)
       ELSE regexp_replace(regexp_replace(printf('%.2e', value), 'e\+0*(\d+)$', 'E\1'), 'e-0*(\d+)$', 'E-\1') END AS label
FROM events""")
def h13_format_axis(spark, d):
    return table(spark, d, "events").select("event_id", text.format_axis(F.col("value"), 100.0, 0.01, 2).alias("label"))


INSTANT_SQL = """(strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
       WHEN epoch_us(ts) % 1000 = 0 THEN strftime(ts, '.%g') ELSE strftime(ts, '.%f') END || 'Z')"""
NAME_SQL = f"""(replace(replace({INSTANT_SQL}, ':', '_'), '.', '_') || '_' || CAST(event_id % 4 AS VARCHAR) || '_' ||
       replace(CASE event_type WHEN 'purchase' THEN 'Resting Normal' WHEN 'view' THEN 'Resting-Abnormal'
               ELSE 'Working-Overlap' END, ' ', '-') || '_' || lpad(CAST(user_id AS VARCHAR), 4, '0'))"""


def named_events(spark, d):
    events = table(spark, d, "events")
    act = (
        F.when(F.col("event_type") == "purchase", "Resting Normal")
        .when(F.col("event_type") == "view", "Resting-Abnormal").otherwise("Working-Overlap")
    )
    name = text.recording_name(
        clock.instant_text(clock.epoch_micros(events, "ts")), F.col("event_id") % 4, act, F.col("user_id")
    )
    return events.select("event_id", name.alias("recording_id"))


@query("h14_name", f"SELECT event_id, {NAME_SQL} AS recording_id FROM events")
def h14_name(spark, d):
    return named_events(spark, d)


@query("h15_pixel", with_signal("""
SELECT recording_id, idx, CAST(trunc(t / 3600) AS BIGINT) AS x, 146 - CAST(trunc(v * 145 / 1.4) AS BIGINT) AS y FROM sig"""))
def h15_pixel(spark, d):
    return signal(spark, d).select(
        "recording_id", "idx", shapes.pixel_x(F.col("t"), 3600.0).alias("x"), shapes.pixel_y(F.col("v"), 1.4).alias("y")
    )


@query("h17_period", """
SELECT l_orderkey, l_linenumber, CAST(1000 // CAST(l_quantity AS BIGINT) AS BIGINT) AS period_ms FROM lineitem""")
def h17_period(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", shapes.sample_period_ms(F.col("l_quantity")).alias("period_ms")
    )


@query("h18_phase_mirror", with_signal(f"""
SELECT recording_id, k, n, round(CASE WHEN k = 0 OR 2 * k = n THEN 0 WHEN 2 * k > n THEN -p ELSE p END, 9) + 0.0 AS phase
FROM (SELECT *, 2 * pi() * {unit_sql('5', 'recording_id', 'least(k, n - k)')} AS p
      FROM (SELECT recording_id, idx - 1 AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM sig))"""))
def h18_phase_mirror(spark, d):
    sig = stored_signal(spark, d).select("recording_id", "idx")
    bins = attach(with_chunk(sig), lengths(sig)).select("recording_id", (F.col("idx") - 1).alias("k"), "n")
    phase = draws.mirrored_phase(5, "recording_id", "k", "n")
    return bins.select("recording_id", "k", "n", rounded(phase, 9).alias("phase"))


@query("h19_rate", "SELECT event_id, round(2 * pi() / nullif(value, 0), 6) AS rate FROM events")
def h19_rate(spark, d):
    return table(spark, d, "events").select("event_id", rounded(shapes.angular_rate(F.col("value"))).alias("rate"))


@query("h20_waves", """
SELECT vec_id, CAST(i AS INTEGER) AS pos, ['P', 'Q', 'R', 'S', 'T'][i] AS wave, CAST(embedding[i] AS DOUBLE) AS theta,
       CAST(embedding[i + 5] AS DOUBLE) AS a, CAST(embedding[i + 10] AS DOUBLE) AS b
FROM (SELECT vec_id, embedding, unnest(range(1, 6)) AS i FROM embeddings)""")
def h20_waves(spark, d):
    e = F.col("embedding")
    waves = F.array(*[
        F.struct(F.lit(w).alias("wave"), *[e[i + 5 * part].cast("double").alias(f) for part, f in enumerate(("theta", "a", "b"))])
        for i, w in enumerate(schema.WAVES)
    ])
    return explode_waves(table(spark, d, "embeddings").select("vec_id", waves.alias("waves")))


# --- rows ---------------------------------------------------------------------

@query("b1_samples", with_signal("SELECT recording_id, idx, (idx - 1) / 256e0 AS t, v, peak FROM sig"))
def b1_samples(spark, d):
    return samples.to_samples(signal(spark, d), 256)


@query("b2_downsample", with_signal("""
SELECT recording_id, (idx - 1) // 2 + 1 AS idx, t, v, peak FROM sig WHERE (idx - 1) % 2 = 0"""))
def b2_downsample(spark, d):
    return samples.downsample(signal(spark, d).select("recording_id", "idx", "t", "v", "peak"), 2)


@query("b3_valid_rates", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS sf, l_linenumber AS sf_ecg FROM lineitem
WHERE l_linenumber > 0 AND CAST(l_quantity AS INTEGER) % l_linenumber = 0""")
def b3_valid_rates(spark, d):
    params = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("sf"), F.col("l_linenumber").alias("sf_ecg")
    )
    return validate.valid_rates(params)


def raw_params(spark, d):
    """Parts as parameter forms: text fields, some of them no numbers."""
    k, size, price = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")

    def spoilt(good, bad, every):
        return F.when(k % every == 0, F.col(bad)).otherwise(good)

    fields = {
        "n_beats": spoilt(size, "p_brand", 7), "sf_ecg": spoilt((k % 5 * 64).cast("string"), "p_type", 19),
        "sf": F.when(k % 11 == 0, price).otherwise(F.lit("512")), "noise_amp": price, "hr_mean": spoilt(price, "p_name", 13),
        "hr_std": size, "seed": F.when(k % 17 == 0, price).otherwise(size), "plot_amp": price, "f_lo": price, "f_hi": price,
        "f_lo_std": price, "f_hi_std": spoilt(price, "p_type", 23), "lf_hf_ratio": price,
        **{f"{w}_{i}": spoilt(size, "p_brand", 29 + 5 * n + i) for n, w in enumerate(("theta", "a", "b")) for i in range(1, 6)},
    }
    return table(spark, d, "part").select("p_partkey", *[c.alias(name) for name, c in fields.items()])


def _raw_sql() -> str:
    def spoilt(good, bad, every):
        return f"CASE WHEN p_partkey % {every} = 0 THEN {bad} ELSE {good} END"

    size, price = "CAST(p_size AS VARCHAR)", "CAST(p_retailprice AS VARCHAR)"
    fields = {
        "n_beats": spoilt(size, "p_brand", 7), "sf_ecg": spoilt("CAST(p_partkey % 5 * 64 AS VARCHAR)", "p_type", 19),
        "sf": spoilt("'512'", price, 11), "noise_amp": price, "hr_mean": spoilt(price, "p_name", 13), "hr_std": size,
        "seed": spoilt(size, price, 17), "plot_amp": price, "f_lo": price, "f_hi": price, "f_lo_std": price,
        "f_hi_std": spoilt(price, "p_type", 23), "lf_hf_ratio": price,
        **{f"{w}_{i}": spoilt(size, "p_brand", 29 + 5 * n + i) for n, w in enumerate(("theta", "a", "b")) for i in range(1, 6)},
    }
    ints = {"n_beats", "sf_ecg", "sf", "seed"}
    parsed = [
        f"CASE WHEN regexp_full_match({n}, '[+-]?[0-9]+') THEN TRY_CAST({n} AS INTEGER) END AS {n}" if n in ints
        else f"TRY_CAST({n} AS DOUBLE) AS {n}"
        for n in fields
    ]
    checks = []
    for column, _, label in validate.SCALAR_FIELDS:
        wrong = f"{column} IS NULL" + (" AND sf_ecg IS NOT NULL" if column == "sf" else "")
        checks.append(f"CASE WHEN {wrong} THEN '{validate.message(label).replace(chr(39), chr(39) * 2)}' END")
        if column == "sf":
            checks.append(
                "CASE WHEN sf_ecg IS NOT NULL AND sf IS NOT NULL AND NOT (sf_ecg > 0 AND sf % nullif(sf_ecg, 0) = 0)"
                f" THEN '{validate.RATE_MESSAGE}' END"
            )
    for w in ("theta", "a", "b"):
        for i in range(1, 6):
            checks.append(f"CASE WHEN {w}_{i} IS NULL THEN 'Incorrect ''{w}'' value entered (position {i}), please correct it!' END")
    used = "coalesce(CASE WHEN sf_ecg IS NOT NULL THEN sf END, 512)"
    ecg = "coalesce(sf_ecg, 256)"
    checks.append(f"CASE WHEN NOT coalesce({ecg} > 0 AND {used} % nullif({ecg}, 0) = 0, false) THEN '{validate.RULES_MESSAGE}' END")
    return f"""WITH raw AS (SELECT p_partkey, {", ".join(f"{e} AS {n}" for n, e in fields.items())} FROM part),
parsed AS (SELECT p_partkey, {", ".join(parsed)} FROM raw),
checked AS (SELECT p_partkey, coalesce(array_to_string(msgs, chr(10)), '') AS errors,
                   CAST(list_aggregate(msgs, 'count') AS INTEGER) AS n_errors
            FROM (SELECT p_partkey, [{", ".join(checks)}] AS msgs FROM parsed))
"""


@query("b4_field_errors", _raw_sql() + """
SELECT p_partkey, errors, n_errors, n_errors = 0 AS valid FROM checked""")
def b4_field_errors(spark, d):
    return validate.validate_params(raw_params(spark, d)).select(
        "p_partkey", F.array_join("errors", "\n").alias("errors"), F.size("errors").alias("n_errors"), "valid"
    )


@query("b5_peak_decode", with_signal("""
SELECT recording_id, idx, peak, CASE peak WHEN 1 THEN 'P' WHEN 3 THEN 'R' WHEN 5 THEN 'T' END AS wave
FROM sig WHERE peak IN (1, 3, 5)"""))
def b5_peak_decode(spark, d):
    return samples.with_peak_name(samples.peaks_only(signal(spark, d), (1, 3, 5))).select("recording_id", "idx", "peak", "wave")


@query("b6_text_roundtrip", with_signal("SELECT recording_id, idx, t, v, peak FROM sig"))
def b6_text_roundtrip(spark, d):
    return samples.from_text(samples.as_text(signal(spark, d).select("recording_id", "idx", "t", "v", "peak")))


@query("b7_gate", _raw_sql() + """
SELECT p_partkey, CASE WHEN n_errors = 0 THEN 'accepted' ELSE 'rejected' END AS outcome FROM checked""")
def b7_gate(spark, d):
    accepted, rejected = validate.gate(validate.validate_params(raw_params(spark, d)))
    return accepted.select("p_partkey", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("p_partkey", F.lit("rejected").alias("outcome"))
    )


RANGES_SQL = f"rng(activity, param, lo, hi) AS (VALUES {values(schema.activity_range_rows())})"


@query("b8_unknown_activity", f"""
WITH {RANGES_SQL}, p AS (SELECT c_custkey, {ACTIVITY} AS activity FROM customer)
SELECT c_custkey, p.activity, lo AS hr_mean_lo, hi AS hr_mean_hi,
       CASE WHEN lo IS NULL THEN 'unknown activity: ' || p.activity END AS reason, lo IS NOT NULL AS valid
FROM p LEFT JOIN (SELECT * FROM rng WHERE param = 'hr_mean') r ON p.activity = r.activity""")
def b8_unknown_activity(spark, d):
    params = table(spark, d, "customer").select("c_custkey", activity().alias("activity"))
    wide = widen_ranges(schema.activity_ranges(spark), ["hr_mean"])
    return validate.flag_unknown(params, wide).select("c_custkey", "activity", "hr_mean_lo", "hr_mean_hi", "reason", "valid")


@query("a8_default_params", """
SELECT c_custkey, 256 AS n_beats, 256 AS sf_ecg, 512 AS sf, 1 AS seed, 60e0 AS hr_mean, 1e0 AS hr_std, 0.5e0 AS lf_hf_ratio,
       0.1e0 AS f_lo, 0.25e0 AS f_hi, 0.01e0 AS f_lo_std, 0.01e0 AS f_hi_std, 0.1e0 AS noise_amp, 1.4e0 AS plot_amp,
       CAST(3 AS BIGINT) AS period_ms, 5 AS n_waves, 30e0 AS a_r
FROM customer""")
def a8_default_params(spark, d):
    return with_defaults(table(spark, d, "customer").select("c_custkey")).select(
        "*", F.size("waves").alias("n_waves"), F.col("waves")[2]["a"].alias("a_r")
    ).drop("waves")
