"""The registered queries of the numbered operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents
from graphloom.llm.conversation_trie import conversation_trie
from graphloom.llm.decontaminate import contaminated
from graphloom.llm.langid import fit, identify, remainder
from graphloom.llm.line_dedup import dedup_lines
from graphloom.llm.lm import score_texts
from graphloom.llm.mixing import mix_sources
from graphloom.llm.phrases import mine_phrases
from graphloom.llm.secrets import scan
from graphloom.llm.simhash import near_duplicates
from graphloom.llm.substring_dedup import dedup_substrings
from graphloom.llm.token_counts import count_tokens
from graphloom.llm.token_files import new_folder, read_tokens, write_tokens
from graphloom.llm.topk import top_k


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(documents(spark, sf_dir), length=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
wins AS (
  SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs WHERE len(ws) >= 35)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM wins) WHERE n > 1),
covered AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM hit)),
words AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs),
kept AS (
  SELECT w.r, string_agg(w.w, ' ' ORDER BY w.p) AS text, count(*) AS n
  FROM words w ANTI JOIN covered c ON w.r = c.r AND w.p = c.p GROUP BY w.r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.r = k.r
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, coalesce(doc_id, 9223372036854775807) AS d,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, min(d) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT d) >= 2),
marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.d > r.first AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, text
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4, max_bits=4).select("doc_id", "fingerprint", "component_id")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(documents(spark, sf_dir), learn=remainder(F.col("doc_id"), 5) != 1)
    held_out = (F.col("doc_id").isNotNull() & ~F.col("learned")).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "copies", "taken")


OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS rank FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][rank % 3 + 1]::BIGINT AS w, source_size * 3 AS cap FROM per),
filled AS (
  SELECT *,
    (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE AS rest,
    (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS wrest
  FROM weighed WINDOW b AS (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, max(rest / wrest) OVER () AS level FROM filled),
targets AS (SELECT source, source_size, least(cap::DOUBLE, w * level) AS target FROM levels),
measures AS (SELECT source, length(bin(size)) AS m, sum(size)::BIGINT AS words FROM docs WHERE size > 0 GROUP BY ALL),
filling AS (
  SELECT p.source, p.m, p.words, t.target,
    (t.target - 3 * coalesce(sum(p.words) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(p.m * p.words) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS r
  FROM measures p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
  WINDOW b AS (PARTITION BY p.source ORDER BY p.m DESC)),
rated AS (SELECT *, max(r) OVER (PARTITION BY source) AS rate FROM filling),
rates AS (
  SELECT source, max(rate) AS rate, sum(floor(least(3::DOUBLE, rate * m))::BIGINT * words)::BIGINT AS certain FROM rated GROUP BY source),
joined AS (
  SELECT d.*, t.source_size, t.target, t.target - coalesce(r.certain, 0)::DOUBLE AS rest,
    least(3::DOUBLE, coalesce(r.rate, 0) * length(bin(d.size))) AS e
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
odds AS (
  SELECT *, floor(e)::BIGINT AS whole,
    CASE WHEN e - floor(e)::BIGINT > 0 AND size > 0 THEN (u / (1 - u)) / ((e - floor(e)::BIGINT) / (1 - (e - floor(e)::BIGINT))) END AS o
  FROM joined),
ranked AS (SELECT *, floor(o / (1 + o) * 4503599627370496::DOUBLE)::BIGINT AS q FROM odds),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
            - sum(size) OVER (PARTITION BY source, q, doc_id, size) AS before
  FROM ranked)
SELECT doc_id, size, source_size, target,
  whole + CASE WHEN q IS NOT NULL AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END AS copies,
  (size * (whole + CASE WHEN q IS NOT NULL AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_markov")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(remainder(F.col("doc_id"), 3) != 1), tokenizer_path("piece_bpe_32k.model"))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text", held_out), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = r"""
WITH keyed AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, key) AS pos, key,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM keyed),
convs AS (
  SELECT c, c - c % 20 AS head, count(*) AS n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)),
           4294967295) % 4 AS h
  FROM turns GROUP BY c),
rebuilt AS (
  SELECT v.c, t.pos, t.key, t.words FROM convs v JOIN turns t ON t.c = v.head AND t.pos <= v.h
  UNION ALL
  SELECT v.c, t.pos + 1000000, t.key, t.words FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h),
whole AS (
  SELECT v.c, coalesce(list(r.key ORDER BY r.pos) FILTER (WHERE r.key IS NOT NULL), []) AS keys, coalesce(list(r.words ORDER BY r.pos) FILTER (WHERE r.key IS NOT NULL), []) AS words
  FROM convs v LEFT JOIN rebuilt r ON r.c = v.c GROUP BY v.c),
paths AS (
  SELECT c, d AS depth, array_to_string(keys[1:d], '/') AS node, array_to_string(keys[1:d - 1], '/') AS above,
         CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, d = len(keys) AS ends
  FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM whole)),
nodes AS (
  SELECT depth, node, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY depth, node),
children AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k ON n.depth = k.depth AND n.node = k.node),
sums AS (
  SELECT p.depth, p.node, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
  FROM full_nodes u JOIN paths p ON p.c = u.conv_id AND p.depth <= u.depth GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON n.depth = s.depth AND n.node = s.node
LEFT JOIN nodes a ON n.depth > 0 AND a.depth = n.depth - 1 AND a.node = n.above
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(documents(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed),
grams AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM placed, (VALUES (1), (2), (3), (4), (5)) AS t(m) WHERE i + m - 1 <= len(ws)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM listed GROUP BY lang),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, string_split(c.phrase, ' ') AS ws, k
  FROM counts c, (VALUES (1), (2), (3), (4)) AS t(k) WHERE c.m >= 2 AND k < c.m),
parts AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
         (1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.m = c.k AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.m = c.m - c.k AND y.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')
  JOIN totals t ON t.lang = c.lang),
scored AS (
  SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM parts) WHERE place = 1),
covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM scored s JOIN scored g
  ON s.lang = g.lang AND g.m > s.m AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * g.a >= 100 * s.a),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s ANTI JOIN covered c ON s.lang = c.lang AND s.phrase = c.phrase)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked WHERE rank <= 2000
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    write_tokens(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_QUERIES = {
    "op1_substring_dedup": (op1_substring_dedup, OP1_SQL),
    "op2_decontamination": (op2_decontamination, None),
    "op3_line_dedup": (op3_line_dedup, OP3_SQL),
    "op4_simhash": (op4_simhash, None),
    "op5_lm_scores": (op5_lm_scores, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_mixing": (op7_mixing, OP7_SQL),
    "op8_top_k": (op8_top_k, OP8_SQL),
    "op9_secret_scan": (op9_secret_scan, None),
    "op10_language_id": (op10_language_id, None),
    "op11_conversation_trie": (op11_conversation_trie, OP11_SQL),
    "op12_phrases": (op12_phrases, OP12_SQL),
    "op13_token_files": (op13_token_files, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
