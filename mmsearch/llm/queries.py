"""The opN_ queries and their DuckDB oracles."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fertility, hash_ring, mixing, ngram_join, patricia_dedup, periodic_runs, quotations, spelling_variants, substring_dedup, token_counts, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


#: Words of a text, as every contract defines them.
WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_2 = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM split
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), width=13, keep_text=False)


ORACLE_8 = f"""
WITH split AS (
  SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split)
), firsts AS (
  SELECT t, min(doc_id) AS first FROM windows GROUP BY t
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN firsts USING (t) WHERE first < doc_id
), removed AS (
  SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM split s LEFT JOIN removed r ON r.doc_id = s.doc_id
"""

def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)



def op5_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return fertility.quality(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)



def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3, seed=17)


#: Water level by recursion: each round caps the sources above their share and shares the rest again.
ORACLE_10 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY source
), rounds AS (
  SELECT 0 AS k, source, source_size, w, false AS capped FROM s
  UNION ALL
  SELECT k + 1, source, source_size, w, capped OR 3 * source_size <= w * (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()
  FROM rounds WHERE k < (SELECT count(*) FROM s)
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
    ELSE w * ((sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target
  FROM rounds WHERE k = (SELECT count(*) FROM s)
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('17:' || d.doc_id), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""



def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate(_table(spark, sf_dir, "pages"), least_bytes=0)


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v{k} >> {s}) & 31 AS INT), 1)" for k in range(8) for s in (15, 10, 5, 0)
)
ORACLE_3 = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), h AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS x FROM p
), v AS (
  SELECT *, {", ".join(f"CAST('0x' || substr(x, {1 + 5 * k}, 5) AS BIGINT) AS v{k}" for k in range(8))} FROM h
), d AS (
  SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest FROM v
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS answer FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN answer = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN answer <> page_id THEN answer END AS refers_to, CASE WHEN answer = page_id THEN payload_bytes ELSE 0 END AS stored_bytes FROM m
"""



def op4_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_ring.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16).drop("text")



URL_RULES = [url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"), url_filter.Rule("example.com/de/", "block"), url_filter.Rule("org/fr/", "allow")]


def op7_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)



def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))



def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_order(_table(spark, sf_dir, "conversations"))


ORACLE_1 = r"""
WITH lines AS (
  SELECT conv_id, turn, k, line, len(replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), ' ', '')) - len(replace(replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), ' ', ''), '>', '')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[ \t-\r]+', ' ', 'g')) AS bare
  FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(coalesce(text, ''), '\r?\n')) AS line, unnest(range(1, 1 + len(regexp_split_to_array(coalesce(text, ''), '\r?\n')))) AS k FROM conversations)
), per_message AS (
  SELECT conv_id, turn, max(level) AS quote_level, count(*) FILTER (level > 0 AND bare <> '') AS quoted_lines FROM lines GROUP BY conv_id, turn
), words AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, j) AS r
  FROM (SELECT conv_id, turn, level, k, unnest(string_split(bare, ' ')) AS w, unnest(range(len(string_split(bare, ' ')))) AS j FROM lines WHERE bare <> '')
), spans AS (
  SELECT conv_id, turn, level, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS ws, [k, lead(k, 1) OVER o, lead(k, 2) OVER o, lead(k, 3) OVER o, lead(k, 4) OVER o] AS ks,
    level = lead(level, 1) OVER o AND level = lead(level, 2) OVER o AND level = lead(level, 3) OVER o AND level = lead(level, 4) OVER o AS whole
  FROM words WINDOW o AS (PARTITION BY conv_id, turn ORDER BY r)
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY r) AS run
  FROM (SELECT *, CAST(level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv_id, turn ORDER BY r) AS INTEGER) AS new FROM words)
), units AS (
  SELECT conv_id, turn, level, 'window' AS kind, array_to_string(ws, ' ') AS key, 'w' AS space, ks FROM spans WHERE whole
  UNION ALL SELECT conv_id, turn, level, 'line', bare, 'l', [k] FROM lines WHERE bare <> ''
  UNION ALL SELECT conv_id, turn, any_value(level), 'short', string_agg(w, ' ' ORDER BY r), 'l', list(DISTINCT k) FROM runs
    GROUP BY conv_id, turn, run HAVING any_value(level) > 0 AND count(*) < 5 AND min(k) < max(k)
), quotes AS (
  SELECT *, row_number() OVER () AS id FROM units WHERE level > 0
), links AS (
  SELECT q.id, q.conv_id, q.turn, q.level, q.kind, any_value(q.ks) AS ks, max(o.turn) AS source
  FROM quotes q JOIN units o ON o.conv_id = q.conv_id AND o.space = q.space AND o.key = q.key AND o.level = 0 AND o.kind <> 'short' AND o.turn < q.turn
  GROUP BY q.id, q.conv_id, q.turn, q.level, q.kind
), votes AS (
  SELECT conv_id, turn, level, source, count(*) FILTER (kind = 'window') AS windows, count(*) FILTER (kind = 'line') AS n FROM links GROUP BY ALL
), linked AS (
  SELECT DISTINCT conv_id, turn, unnest(ks) AS k FROM links
), parents AS (
  SELECT conv_id, turn, arg_max(source, (-level, windows, n, source)) AS parent, (SELECT count(*) FROM linked l WHERE l.conv_id = v.conv_id AND l.turn = v.turn) AS linked_lines
  FROM votes v GROUP BY conv_id, turn
), marked AS (
  SELECT l.*, level > 0 AND (bare = '' OR d.k IS NOT NULL) AS gone FROM lines l LEFT JOIN linked d USING (conv_id, turn, k)
), kept AS (
  SELECT conv_id, turn, k, line FROM (SELECT *, lead(gone) OVER (PARTITION BY conv_id, turn ORDER BY k) AS next FROM marked) WHERE NOT gone AND NOT (regexp_matches(line, 'wrote:[ \t]*$') AND coalesce(next, false))
), bodies AS (
  SELECT conv_id, turn, trim(string_agg(line, chr(10) ORDER BY k), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM kept GROUP BY conv_id, turn
), m AS (
  SELECT c.conv_id, c.turn, c.role, lag(c.turn) OVER w AS previous, row_number() OVER w AS r, p.parent, p.linked_lines
  FROM conversations c LEFT JOIN parents p USING (conv_id, turn) WINDOW w AS (PARTITION BY c.conv_id ORDER BY c.turn)
), s AS (
  SELECT *, max(CASE WHEN previous IS NULL OR parent <> previous THEN r END) OVER (PARTITION BY conv_id ORDER BY turn) AS start FROM m
)
SELECT s.conv_id, s.turn, s.role, CAST(i.quote_level AS BIGINT) AS quote_level, CAST(i.quoted_lines AS BIGINT) AS quoted_lines, CAST(coalesce(s.linked_lines, 0) AS BIGINT) AS linked_lines,
  coalesce(s.parent, s.previous) AS reply_to, b.turn AS branch, b.parent AS branch_parent, CAST(s.r - s.start AS BIGINT) AS position, coalesce(t.body, '') AS text
FROM s JOIN per_message i USING (conv_id, turn) JOIN s b ON b.conv_id = s.conv_id AND b.r = s.start LEFT JOIN bodies t ON t.conv_id = s.conv_id AND t.turn = s.turn
"""



def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling_variants.letter_runs(_table(spark, sf_dir, "documents"), shortest=6)
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary")))
    cut = F.expr("concat(left(run, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling_variants.spelling_variants(spelling_variants.count_words(words, shortest=6, least=5), ratio=5)


#: Unsigned CRC-32 of a text in UTF-8; crc.t holds the table of one byte.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
)"""
CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(hex(encode({0}))), 2), lambda i: CAST('0x' || substr(hex(encode({0})), i, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""

ORACLE_11 = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{6,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), distinct_runs AS (
  SELECT doc_id, run, count(*) AS k FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, {CRC.format("(CAST(doc_id AS VARCHAR) || ':' || run)")} AS h FROM distinct_runs, crc
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS top, max(m) AS top_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * w.n THEN top END AS form, CASE WHEN top_n >= 5 * w.n THEN top_n END AS form_n FROM words w LEFT JOIN best USING (word)
), paths AS (
  SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT p.word, f.word, f.form FROM paths p JOIN forms f ON p.next = f.word
)
SELECT f.word, n, n_near, form, form_n, p.at AS root FROM forms f JOIN paths p ON p.word = f.word AND p.next IS NULL
"""


def op12_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patricia_dedup.exact_copies(_table(spark, sf_dir, "documents"))


ORACLE_12 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM d WINDOW w AS (PARTITION BY bare ORDER BY chars DESC, doc_id)
"""


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which words a tenth of the documents read instead of their own: a period from word a on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), least=24, times=3, reorder=planted_period)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE_13 = f"""
WITH {CRC_TABLE}, split AS (
  SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w, {CRC.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc
), places AS (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split
), texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM places
), words AS (
  SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM texts
), equal AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 3 * (b.i - a.i) <= a.n
), islands AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal) GROUP BY doc_id, q, g
), runs AS (
  SELECT doc_id, s, length, min(q) AS q FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, s, length
), per AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id
    AND (o.length * r.q > r.length * o.q OR (o.length * r.q = r.length * o.q AND (o.s < r.s OR (o.s = r.s AND o.q < r.q)))))
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST((1000 * b.length) // b.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts t LEFT JOIN per USING (doc_id) LEFT JOIN best b ON b.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


QUERIES = {
    "op1_quotation_links": op1_quotation_links,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_url_trees": op7_url_trees,
    "op4_hash_ring_shards": op4_hash_ring_shards,
    "op3_warc_revisits": op3_warc_revisits,
    "op10_mix_sources": op10_mix_sources,
    "op5_tokeniser_fertility": op5_tokeniser_fertility,
    "op9_token_counts": op9_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_patricia_owners": op12_patricia_owners,
    "op13_periodic_runs": op13_periodic_runs}
ORACLE = {
    "op1_quotation_links": ORACLE_1,
    "op3_warc_revisits": ORACLE_3,
    "op10_mix_sources": ORACLE_10,
    "op8_substring_dedup": ORACLE_8,
    "op2_ngram_jaccard_join": ORACLE_2,
    "op11_spelling_variants": ORACLE_11,
    "op12_patricia_owners": ORACLE_12,
    "op13_periodic_runs": ORACLE_13}
