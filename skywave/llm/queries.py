"""The registered query of every corpus operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .bpe import decode, encode
from .collocations import collocations
from .common import table
from .hmm import hmm_scores
from .lang_id import language_id
from .mixing import mix
from .near_dedup import near_duplicates
from .ngram_join import ngram_join
from .periodic import periodic_runs
from .quality import quality_select
from .quality_rules import RULES, STOP_WORDS, Rule, let, quality_rules, words_of
from .token_counts import token_counts
from .warc import read_archive, write_archive


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).drop("audited_recall")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archive(spark, write_archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the texts of some documents, chosen by their ids, are made periodic from some word on
    h = F.crc32(F.col("doc_id").cast("string"))

    def periodic(ws: Column) -> Column:
        n, g = F.size(ws).cast("long"), F.floor(h / 10)

        def from_word(a: Column) -> Column:
            period = F.floor((n - a) / (g % 8 + 3)).cast("int") + 1
            return let(period, lambda p: F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % p))), " "))

        return let((g % n).cast("int"), from_word)

    text = F.when(h % 10 == 0, let(words_of(F.col("text")), lambda ws: F.when(F.size(ws) > 0, periodic(ws)))).otherwise(F.col("text"))
    found = periodic_runs(docs.select("doc_id", text.alias("text")))
    # the order: greatest length, then smallest start, then smallest period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.less div best.period").alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(table(spark, sf_dir, "documents")).select(*columns)


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_bpe": op2_bpe,
    "op3_near_dedup": op3_near_dedup,
    "op4_ann": op4_ann,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_hmm": op9_hmm,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_quality_rules": op13_quality_rules,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def _bounds(r: Rule) -> str:
    low = [] if r.least is None else [f"100 * {r.measure} >= {r.least} * {r.of}"]
    return " AND ".join(low + ([] if r.most is None else [f"100 * {r.measure} <= {r.most} * {r.of}"]))


ORACLE_SQL = {
    "op1_ngram_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS s, len(sh) AS n FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT x AS doc_id, y AS other FROM p UNION SELECT r.doc_id, p.y FROM r JOIN p ON r.other = p.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles,
  least(s.doc_id, coalesce((SELECT min(other) FROM r WHERE r.doc_id = s.doc_id), s.doc_id)) AS component_id,
  CAST((SELECT count(*) FROM p WHERE p.x = s.doc_id) AS BIGINT) AS n_links
FROM s""",
    "op3_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
u AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS n FROM v),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.98),
r AS (SELECT x AS vec_id, y AS other FROM p UNION SELECT r.vec_id, p.y FROM r JOIN p ON r.other = p.x),
c AS (SELECT e.vec_id, least(e.vec_id, coalesce((SELECT min(other) FROM r WHERE r.vec_id = e.vec_id), e.vec_id)) AS component_id FROM embeddings e)
SELECT vec_id, CAST((SELECT count(*) FROM p WHERE p.x = c.vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, octet_length(b) AS n, min(page_id) OVER (PARTITION BY d) AS owner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> owner THEN owner END AS refers_to
FROM q""",
    "op10_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
    substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 15) AS k FROM documents),
z AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
n AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (CAST([5.0, 2.0, 1.0] AS DOUBLE[]))[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM z),
l AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM n WINDOW b AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS held FROM l),
t AS (SELECT source, source_size, CASE WHEN held IS NULL OR ratio <= held THEN cap ELSE weight * held END AS target FROM h),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN target > 0 THEN (upto + turn * source_size) / target ELSE 0 END AS finish FROM q, (SELECT unnest([0, 1, 2]) AS turn)),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, encode(source) NULLS LAST, turn, k, coalesce(doc_id, 0), upto ROWS UNBOUNDED PRECEDING) <= sum(size) OVER () / 3 AS took FROM f)
SELECT doc_id, CAST(any_value(size) AS BIGINT) AS size, CAST(any_value(source_size) AS BIGINT) AS source_size, any_value(target) AS target,
  CAST(sum(CASE WHEN took THEN size ELSE 0 END) AS BIGINT) AS taken
FROM g GROUP BY doc_id, source, k, upto, size""",
    "op12_collocations": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: {{'m': m, 'phrase': array_to_string(w[i:i+m-1], ' ')}})))) AS g FROM w),
f AS (SELECT lang, g.m AS m, g.phrase AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
z AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
k AS (SELECT lang, m, phrase, f AS a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
c AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, l.f AS l, r.f AS r, z.n, CAST(1000 AS HUGEINT) * k.a * z.n // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM k JOIN z ON z.lang = k.lang JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k+1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.m > b.m AND q.f >= b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM t QUALIFY rank <= 2000""",
    "op13_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
m AS (
  SELECT row_number() OVER () AS key, doc_id, w, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls,
    len(list_filter(w, lambda x: list_contains([{", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS)))}], lower(x)))) AS n_stop_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) AS n_doubled_words
  FROM d),
v AS (SELECT key, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'i': i, 'window': array_to_string(w[i:i+7], ' ')}})) AS v FROM m),
u AS (SELECT key, v.i AS i FROM v QUALIFY count(*) OVER (PARTITION BY key, v.window) > 1),
s AS (SELECT key, least(8, coalesce(lead(i) OVER (PARTITION BY key ORDER BY i) - i, 8)) AS width FROM u),
e AS (SELECT m.*, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce((SELECT sum(width) FROM s WHERE s.key = m.key), 0) AS n_repeat_words FROM m),
f AS (SELECT *, 100 * n_words < 2000 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM e)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND {" AND ".join(_bounds(r) for r in RULES)} AS kept
FROM f""",
}
