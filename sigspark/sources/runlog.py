"""Run logs: parameter rows as text lines and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.schema import WAVES

# Log lines in order, as (parameter, type, label, unit).
LINES = (
    ("n_beats", "int", "Approximate number of heart beats", ""),
    ("sf_ecg", "int", "ECG sampling frequency", " Hertz"),
    ("sf", "int", "Internal sampling frequency", " Hertz"),
    ("noise_amp", "double", "Amplitude of additive uniformly distributed noise", " mV"),
    ("hr_mean", "double", "Heart rate mean", " beats per minute"),
    ("hr_std", "double", "Heart rate std", " beats per minute"),
    ("f_lo", "double", "Low frequency", " Hertz"),
    ("f_hi_std", "double", "High frequency std", " Hertz"),
    ("f_lo_std", "double", "Low frequency std", " Hertz"),
    ("f_hi", "double", "High frequency", " Hertz"),
    ("lf_hf_ratio", "double", "LF/HF ratio", ""),
    ("period_ms", "bigint", "time step milliseconds", ""),
)
HEADER = "ECG Log:"
ORDER_HEADER = "Order of Extrema:"
SECTIONS = (("theta", "      theta(radians)"), ("a", "      a(calculated)"), ("b", "      b(calculated)"))
# An optional clock prefix; what follows it matches one of the other patterns.
CLOCK_PATTERN = r"^\[[^\]]*\]: "
# A label, a number, an optional unit.
LINE_PATTERN = r"^[^:\[\]]+: (\S+)(?: .*)?$"
# The run layout (radians) and the saved-form layout (degrees, bare section names).
WAVE_PATTERN = r"^[PQRST]: \[(?:\d+\] = )?([^\t\]\s]+)\t?\]?$"
SECTION_PATTERN = r"^\s*(theta|a|b)(?:\((?:radians|calculated)\))?:?\s*$"
FORM_HEADER = "ECG Parameters:"
# How many samples the beat series has, as a power of two.
SERIES_PATTERN = r"^Using (\d+) = 2\^ *\d+ samples"


def series_line(n: Column) -> Column:
    """The line that tells the length of the beat series, a power of two."""
    return F.concat(F.lit("Using "), n.cast("string"), F.lit(" = 2^ "), F.log2(n).cast("int").cast("string"), F.lit(" samples"))


def _wave_lines(field: str) -> Column:
    def shown(wave, i):
        return F.concat(wave, F.lit(": ["), F.col("waves")[i][field].cast("string"), F.lit("\t]"))

    return F.transform(F.array(*map(F.lit, WAVES)), shown)


def _lines(waves: bool, series: bool = False):
    """The lines as one array.

    The waves' lines are made by a function over their names, which keeps the making of the lines out of
    the generated method that reads them: both in one are too long for the JVM to compile.
    """
    lines = [F.lit(HEADER)]
    lines += [
        F.concat(F.lit(f"{label}: "), F.col(name).cast("string"), F.lit(unit))
        for name, _, label, unit in LINES
    ]
    parts = [lines]
    if waves:
        parts[0].append(F.lit(ORDER_HEADER))
        for field, title in SECTIONS:
            parts[-1].append(F.lit(title))
            parts += [_wave_lines(field), []]
    if series:
        parts[-1].append(series_line(F.col("series_n")))
    return F.concat(*[F.array(*part) if isinstance(part, list) else part for part in parts if not isinstance(part, list) or part])


def param_lines(params: DataFrame, waves: bool = True) -> DataFrame:
    """Log lines ``(recording_id, line_no, line)`` of parameter rows.

    With ``waves`` the wave array (angles in radians) follows in three sections, and then, if
    there is a column ``series_n``, the length of the beat series. A row becomes some thirty lines, so
    the rows are dealt out by recording first; the partition count is given so that they are not
    merged again for being small, and :func:`pivot_log` finds each log in one place.
    """
    tasks = int(params.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return params.repartition(tasks, "recording_id").select("recording_id", F.posexplode(_lines(waves, "series_n" in params.columns)).alias("line_no", "line"))


def write_run_log(params: DataFrame, path: str, waves: bool = True, layout: str = "table") -> None:
    """Log texts of parameter rows.

    ``table`` writes lines with their recording and number as few Parquet files; ``folders``
    writes a folder per recording with its text, CRLF line ends, for people who read them.
    """
    if layout == "table":
        lines = param_lines(params, waves)
        lines.repartitionByRange("recording_id", "line_no").sortWithinPartitions("recording_id", "line_no").write.parquet(path)
        return
    text = params.select("recording_id", F.array_join(_lines(waves, "series_n" in params.columns), "\r\n").alias("value"))
    text.repartitionByRange("recording_id").write.partitionBy("recording_id").text(path)


def log_lines(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """Lines ``(recording_id, line_no, line)`` of log files, named by folder or file stem, or of a log table."""
    if layout == "table":
        return spark.read.schema("recording_id string, line_no int, line string").parquet(path)
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    )
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/recording_id=([^/]+)/[^/]*$", 1)
    stem = F.regexp_replace("_metadata.file_name", r"\.txt$", "")
    named = raw.select(F.when(folder != "", folder).otherwise(stem).alias("recording_id"), "value")
    return named.select("recording_id", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def _told(lines: DataFrame) -> DataFrame:
    """What each line tells: ``_what`` (a parameter, the series, a section or a wave) and its ``_text``.

    A line is one of these at most, so a pattern is tried only on lines that can match it, and once:
    what a line is follows from the part that matched.
    """
    line, what, found = F.col("line"), F.col("_what"), F.col("_found")
    names = F.create_map(*[F.lit(x) for name, _, text, _ in LINES for x in (text, name)])
    # Each pattern in a step of its own: all in one make a method too long to be compiled.
    told = lines.withColumn("_form", line.endswith(FORM_HEADER)).withColumn(
        "line", F.when(line.startswith("["), F.regexp_replace(line, CLOCK_PATTERN, "")).otherwise(line)
    ).withColumn("_name", F.when(line.contains(": "), F.try_element_at(names, F.substring_index(line, ": ", 1))))
    told = told.withColumns({"_what": F.lit(None).cast("string"), "_text": F.lit(None).cast("string")})
    for can, pattern, tag in (
        (F.col("_name").isNotNull(), LINE_PATTERN, F.col("_name")),
        (line.contains(": ["), WAVE_PATTERN, F.substring(line, 1, 1)),
        (line.startswith("Using "), SERIES_PATTERN, F.lit("series_n")),
        (F.lit(True), SECTION_PATTERN, found),
    ):
        told = told.withColumn("_found", F.when(what.isNull() & can, F.regexp_extract(line, pattern, 1))).withColumns({
            "_what": F.when(found != "", tag).otherwise(what), "_text": F.when(found != "", found).otherwise(F.col("_text")),
        })
    return told.select("recording_id", "line_no", "_what", "_text", "_form")


def pivot_log(lines: DataFrame, waves: bool = True) -> DataFrame:
    """One row of parameters per recording from its log lines, of either layout; no header is needed.

    Angles are radians in both. ``series_n`` is the length of the beat series, if a line tells it.
    A recording's row is made from the set of what its lines tell, so the lines are read once, nothing
    is joined to them, and copies of a log add nothing.
    """
    told, places = F.col("_told"), [f for f, _ in SECTIONS]
    # A parameter counts wherever it stands.
    at = F.when(F.col("_what").isin(*places, *WAVES), F.col("line_no"))
    entry = F.struct(F.col("_what").alias("what"), at.alias("at"), F.col("_text").alias("text"))
    one = _told(lines).groupBy("recording_id").agg(
        F.collect_set(F.when(F.col("_what").isNotNull(), entry)).alias("_told"), F.max("_form").alias("_form")
    )

    def of(name: str, value):
        return F.transform(F.filter(told, lambda x: x["what"] == name), value)

    picks = [
        F.array_max(of(name, lambda x: x["text"])).try_cast(kind).alias(name)
        for name, kind in (*[(name, kind) for name, kind, _, _ in LINES], ("series_n", "bigint"))
    ]
    if not waves:
        return one.select("recording_id", *picks)
    # The three wave sections share their labels; they are told apart by where they start.
    starts = {f"_at_{f}": F.array_min(of(f, lambda x: x["at"])) for f in places}
    marks = {f"_{w}": of(w, lambda x: F.struct(x["at"].alias("at"), x["text"].try_cast("double").alias("value"))) for w in WAVES}
    placed = one.select("recording_id", *picks, "_form", *[c.alias(name) for name, c in (starts | marks).items()])

    def pick(w: str, field: str):
        """A wave's first line after a section's start; sections come in a fixed order, each in one place."""
        start, later = F.col(f"_at_{field}"), [F.col(f"_at_{f}") for f in places[places.index(field) + 1:]]

        def inside(x):
            within = x["at"] > start
            for end in later:
                within = within & (end.isNull() | (x["at"] < end) | (end < start))
            return within

        value = F.array_min(F.filter(f"_{w}", inside))["value"]
        return F.when(F.col("_form"), F.radians(value)).otherwise(value) if field == "theta" else value

    wave_array = F.array(*[F.struct(F.lit(w).alias("wave"), *[pick(w, f).alias(f) for f in places]) for w in WAVES])
    return placed.select("recording_id", *[name for name, *_ in LINES], "series_n", wave_array.alias("waves"))


def read_run_log(spark: SparkSession, path: str, waves: bool = True, layout: str = "files") -> DataFrame:
    return pivot_log(log_lines(spark, path, layout), waves)
