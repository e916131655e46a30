"""The corpus operators as named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import alignment, chat, decontaminate, minhash, packing, periods, quality, repeats, search, substrings, tokenids
from sigspark.llm.common import stored, table
from sigspark.llm.mixing import copies
from sigspark.llm.sharding import into_shards

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


WORDS = r"'[^\x20\x09-\x0D]+'"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id"""


@query("op1_minhash_near_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_hypergeometric_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return into_shards(docs, shards=40).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(concat_ws('|', '10', doc_id, md5(coalesce(text, '')))), 1, 8)) AS BIGINT) AS u FROM documents),
s AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size / CAST(weight AS DOUBLE) AS filled,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS share
  FROM s WINDOW w AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT rest, share, filled FROM f WHERE CAST(rest AS DOUBLE) / share <= filled ORDER BY filled, source NULLS LAST LIMIT 1),
t AS (SELECT f.*, CASE WHEN k.rest IS NULL OR f.filled < k.filled THEN CAST(3 * f.source_size AS DOUBLE)
    ELSE CAST(k.rest AS DOUBLE) * f.weight / CAST(k.share AS DOUBLE) END AS target FROM f LEFT JOIN k ON true),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
e AS (SELECT d.*, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE -1 END AS k, (u + 0.5) / 4294967296 AS v FROM d),
c AS (SELECT source, k, count(*) AS n, sum(size) AS w, sum(size::HUGEINT * size) AS q FROM e GROUP BY ALL),
g AS (SELECT c.*, p.target - p.whole * p.source_size AS missing, power(2.0::DOUBLE, k) AS least,
    power(2.0::DOUBLE, k) * sum(CASE WHEN k >= 0 THEN n ELSE 0 END) OVER (PARTITION BY c.source) > p.source_size AND k >= 0 AS long,
    (p.target - p.whole * p.source_size - coalesce(sum(w) OVER (PARTITION BY c.source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / nullif(CAST(sum(q) OVER (PARTITION BY c.source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS rate
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
h AS (SELECT *, max(CASE WHEN rate * least < 1 THEN k END) OVER (PARTITION BY source) AS free,
    coalesce(sum(CASE WHEN NOT long THEN w END) OVER (PARTITION BY source), 0) AS short_words FROM g),
i AS (SELECT *, coalesce(max(CASE WHEN k = free THEN rate END) OVER (PARTITION BY source), 0) AS r FROM h),
j AS (SELECT *, CASE WHEN long THEN CASE WHEN free IS NULL OR k > free THEN n ELSE floor(r * w) END END AS draws FROM i),
x AS (SELECT e.*, j.draws, j.long, j.missing, j.short_words, p.source_size, p.target, p.whole, CASE WHEN j.long THEN e.k ELSE -1 END AS stratum,
    CASE WHEN j.long AND r > 0 THEN v / (1 - v) / (least(r * size, 1 - power(2.0::DOUBLE, -40)) / (1 - least(r * size, 1 - power(2.0::DOUBLE, -40)))) ELSE v END AS pareto
  FROM e JOIN j ON e.source IS NOT DISTINCT FROM j.source AND e.k = j.k JOIN p ON e.source IS NOT DISTINCT FROM p.source),
y AS (SELECT *, row_number() OVER o AS pos, sum(size) OVER o AS words FROM x WINDOW o AS (PARTITION BY source, stratum ORDER BY pareto, v, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
z AS (SELECT *, missing - coalesce(sum(size) FILTER (long AND pos <= draws) OVER (PARTITION BY source), 0) AS open FROM y),
f2 AS (SELECT *, greatest(least(floor(open / nullif(short_words, 0)), 3 - whole), 0) AS every FROM z)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN size = 0 THEN 0 WHEN long THEN (pos <= draws)::INT
  ELSE every + (every < 3 - whole AND 2 * words - size <= 2 * (open - every * short_words))::INT END) AS BIGINT) AS taken FROM f2"""


@query("op10_pareto_mix", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    )
    taken = copies(docs, F.col("size"), F.col("source"), [F.col("doc_id"), F.col("digest")])
    return taken.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


EXTRA_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

_ESCAPES = ("replace(replace(replace(replace({0}, '%', '%25'), '<', '%3C'), '[', '%5B'), ']', '%5D')")
OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length({_ESCAPES.format('role')}) + 2 + length({_ESCAPES.format('text')}) + 5) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op4_chat_assembly", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(stored(chat.formatted(turns), "chat"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
hit AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS k FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN hit USING (doc_id, k) GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


@query("op5_count_min_substrings", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# Bytes as two hexadecimal signs each.
OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400)),
rep AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
edge AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS fresh FROM rep),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edge) GROUP BY doc_id, g),
piece AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
cut AS (SELECT doc_id, count(*) AS n, sum(b - a) AS r, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS k
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id"""


@query("op8_run_length_index", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_greedy_tiling")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaking(docs, table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "item_id", "item_words", "covered_words", "tiles")


@query("op3_co_training")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"), "kept")


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
g AS (SELECT count(*) AS n, sum(len(w)) / CAST(count(*) AS DOUBLE) AS mean FROM d),
f AS (SELECT t, ln(1 + (g.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, g GROUP BY t, g.n),
s AS (SELECT q.doc_id AS query_id, p.doc_id, CAST(sum(floor(1000 * (f.idf * (p.tf * 2.2::DOUBLE) / (p.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(d.w) / g.mean))) + 0.5)) AS BIGINT) AS score
  FROM p q JOIN p ON p.t = q.t AND q.doc_id % 100 = 0 JOIN f ON f.t = p.t JOIN d ON d.doc_id = p.doc_id, g GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score >= 1)
SELECT * FROM r WHERE rank <= 10"""


@query("op2_block_max_search", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return search.top_k(docs, docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))


@query("op6_context_mixing_ids")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenids.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


# A checksum by its polynomial, bit by bit: a byte enters, eight steps follow (-1).
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
    lambda i: [ord(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""
# Equal words p apart, gathered to stretches; a run that several lags find has the smallest as its period.
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w, {_CRC} AS h FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
f AS (SELECT doc_id, n, w, a, CASE WHEN a IS NULL THEN 0 ELSE 1 + (n - a) // (3 + g % 8) END AS p FROM e),
word AS (SELECT doc_id, i, CASE WHEN p > 0 AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM f)),
pair AS (SELECT b.doc_id, b.i, c.i - b.i AS q FROM word b JOIN word c ON b.doc_id = c.doc_id AND b.x = c.x AND b.i < c.i JOIN f ON f.doc_id = b.doc_id WHERE 2 * (c.i - b.i) <= f.n),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k),
run AS (SELECT doc_id, s, m + q AS l, min(q) AS q FROM stretch WHERE m + q >= greatest(12, 2 * q) GROUP BY doc_id, s, m + q),
said AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t,
    first(struct_pack(s := s, l := l, q := q) ORDER BY l DESC, s, q) AS top FROM run GROUP BY doc_id),
cut AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
  sha256(coalesce(said.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM f LEFT JOIN said ON said.doc_id = f.doc_id LEFT JOIN kept ON kept.doc_id = f.doc_id"""


@query("op11_minimizer_periods", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), tails=True)
    said = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_dominance_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=0)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op13_incidence_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = alignment.link_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
