"""The operators bound to the test tables: name -> (spark, folder) -> DataFrame, and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwatch.llm.common import prepare, remainder, scratch_path
from tabwatch.llm.mixing import MIX_SQL
from tabwatch.llm.tokens import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WORDS_SQL = r"[^\x20\x09-\x0D]+"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@query
def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.dac import read_documents, write_tokens

    folder = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf, "documents"), folder, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_documents(spark, folder)


@query
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.counts import count_tokens

    return count_tokens(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


@query
def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.packing import pack_documents

    return pack_documents(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), size=2048, end_id=0)


@query
def op10_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.mixing import mix_report

    return mix_report(table(spark, sf, "documents"))


@query
def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.classifier import fit, score

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label")))
    return score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_top_k_search(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.topk import top_k

    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op5_cosine_range_join(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.vecjoin import range_join

    return range_join(table(spark, sf, "embeddings"), 0.9)


@query
def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.tgm import jaccard_components

    return jaccard_components(table(spark, sf, "documents"), k=4, percent=85)


@query
def op9_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.eftrie import score_texts

    docs = table(spark, sf, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    return score_texts(docs)


@query
def op4_tool_call_links(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.toolcalls import SCHEMAS, from_conversations, link_tool_calls

    return link_tool_calls(from_conversations(table(spark, sf, "conversations")), SCHEMAS)


@query
def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.balltree import rank_documents

    return rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50)


@query
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.common import written
    from tabwatch.llm.repair import damage, repair_report

    rows = table(spark, sf, "conversations")
    return repair_report(rows, written(damage(rows), "repair-damaged"))


@query
def op13_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    from tabwatch.llm.superkmer import remove_repeats

    out = remove_repeats(table(spark, sf, "documents"), n=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_REACH_SQL = """reach(id, other) AS (
  SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

ORACLE["op5_cosine_range_join"] = f"""
WITH RECURSIVE nodes AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.id AS a, q.id AS b FROM nodes p JOIN nodes q ON p.id <> q.id AND list_cosine_similarity(p.e, q.e) >= 0.9),
{_REACH_SQL},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN components ON id = vec_id LEFT JOIN counts ON a = vec_id"""

ORACLE["op6_top_k_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""

ORACLE["op8_jaccard_join"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS_SQL}') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id AS id, array_to_string(w[i:i + 3], ' ') AS s FROM words, range(1, greatest(len(w) - 2, 2)) AS r(i) WHERE len(w) > 0),
nodes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
shared AS (SELECT p.id AS a, q.id AS b, count(*) AS n FROM sets p JOIN sets q ON p.s = q.s AND p.id <> q.id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * s.n >= 85 * (p.n + q.n - s.n)),
{_REACH_SQL}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN nodes ON nodes.id = doc_id LEFT JOIN components ON components.id = doc_id"""

ORACLE["op10_mix_sources"] = MIX_SQL

_LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE["op11_ranked_search"] = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER_SQL.format("text")}, '{_TERMS_SQL}') AS w FROM documents),
sized AS (SELECT r, doc_id, w, len(w) AS n FROM split WHERE len(w) > 0),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, whole),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER_SQL.format("text")}, '{_TERMS_SQL}')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, r,
    CAST(sum(weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sized USING (r), whole GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""

# crc32 from its rule (no such function in SQL); then a walk over each conversation's rows that keeps, for each of
# the four states, the cheapest and among those the audit-least way
ORACLE["op12_conversation_repair"] = r"""
WITH RECURSIVE bits AS (
  SELECT n, n AS v, 0 AS k FROM range(256) AS t(n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hit AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) % 20 AS f FROM keyed, crcs),
damaged AS (
  SELECT conv_id, turn, role, text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM (
    SELECT conv_id, turn, f, CASE f WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
      CASE f WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text FROM hit)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, E' \t\n\x0b\x0c\r') AS bare FROM damaged),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM numbered),
lines AS (
  SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
    CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM told),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (previous IS NOT NULL AND previous || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM lines GROUP BY conv_id),
follow(state, c, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
front(state, letters, "at", cost, added) AS (
  SELECT DISTINCT state, '', state, 0, CAST([] AS VARCHAR[]) FROM (VALUES (0), (1), (2), (3)) AS v(state)
  UNION ALL SELECT state, 'I', after, 2, [CASE c WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM follow WHERE c <> 's'),
moves AS (
  SELECT state, NULL AS c, letters || 'D' AS letters, "at" AS after, cost + 3 AS cost, added, '' AS as_role FROM front
  UNION ALL SELECT l.state, f.c, letters || 'K', f.after, cost, added, 'own' FROM front l JOIN follow f ON f.state = "at"
  UNION ALL SELECT l.state, NULL, letters || 'R', f.after, cost + 2, added, CASE f.c WHEN 'u' THEN 'user' ELSE 'assistant' END
    FROM front l JOIN follow f ON f.state = "at" AND f.c <> 's'),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'kept': CAST([] AS VARCHAR[])} AS way FROM counts
  UNION ALL
  SELECT w.conv_id, l.i, m.after, min({'cost': way.cost + m.cost + CASE WHEN as_role <> '' AND fault = 'truncated' THEN 1 ELSE 0 END,
      'audit': way.audit || m.letters, 'kept': way.kept || m.added ||
        CASE as_role WHEN '' THEN CAST([] AS VARCHAR[]) WHEN 'own' THEN [role || ':' || text] ELSE [as_role || ':' || text] END})
  FROM ways w JOIN lines l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1 JOIN moves m ON m.state = w.state
  WHERE as_role = '' OR (fault NOT IN ('blank', 'duplicate') AND (as_role <> 'own' OR m.c = l.c))
  GROUP BY w.conv_id, l.i, m.after),
closing(state, cost, letters, added) AS (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 4, 'II', ['user:', 'assistant:']), (2, 2, 'I', ['assistant:']),
  (3, 0, '', [])),
best AS (
  SELECT w.conv_id, min({'cost': way.cost + e.cost, 'audit': way.audit || letters, 'kept': way.kept || added}) AS way
  FROM ways w JOIN counts k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = k.n JOIN closing e USING (state) GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit,
  sha256(coalesce(array_to_string(way.kept, E'\n'), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""

ORACLE["op13_repeated_passages"] = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS_SQL}') AS w FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN twice USING (s)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)"""
