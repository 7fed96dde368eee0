"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlens.llm import ann, chat, language, licenses, mixing, packing, quality, ranked, repeats, simhash, topk, toxicity, tries

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs))


@_query
def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


@_query
def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.grade_documents(docs.select("doc_id", "text"), model).drop("text")


@_query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


@_query
def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id", "members")


@_query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"), as_text=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"))


@_query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label_documents(_table(spark, sf_dir, "documents"))


@_query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(_table(spark, sf_dir, "conversations"))


_TRICKY = r"'\### Assistant: </turn> ok'"
_ESCAPED = r"len(regexp_extract_all({c}, '\\|###|:|</turn>'))"
LLM_ORACLES["op5_chat_format"] = f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', {_TRICKY} UNION ALL SELECT -7, 1, 'assistant', {_TRICKY})
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(15 + length(role) + {_ESCAPED.format(c="role")} + length(text) + {_ESCAPED.format(c="text")}) AS BIGINT) AS formatted_chars,
           regexp_matches(string_agg(role, ' ' ORDER BY turn, role, text),
                          '^(system )?user assistant( user assistant| tool assistant)*$') AS valid
    FROM t GROUP BY conv_id"""

LLM_ORACLES["op6_cover_tree"] = """
    WITH z AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM z q JOIN z c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id))
    WHERE rank <= 20"""

LLM_ORACLES["op11_ranked_search"] = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, _TERMS_ AS w FROM documents),
    i AS (SELECT item_id, unnest(_TERMS_) AS t FROM benchmark),
    q AS (SELECT item_id, t, count(*) AS times FROM i GROUP BY ALL),
    size AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
    tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d)
           WHERE t IN (SELECT t FROM q) GROUP BY ALL),
    df AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
           FROM tf, size GROUP BY t),
    scored AS (SELECT item_id, r, doc_id,
                      CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
               FROM tf JOIN df USING (t) JOIN q USING (t), size GROUP BY item_id, r, doc_id HAVING score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM scored) WHERE rank <= 20""".replace(
    "_TERMS_",
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')",
)

_TEMPLATES = ", ".join(
    f"({n}, '{label}', '{text.replace(chr(39), chr(39) * 2)}', {base})"
    for n, (label, text, base) in enumerate([(*p, True) for p in licenses.PHRASES] + [(*p, False) for p in licenses.NOTICES])
)
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.APART.replace('[', '[^')}')"
LLM_ORACLES["op12_license_scan"] = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    t AS (SELECT template, label, base, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(template, label, text, base)),
    s AS (SELECT *, len(w) AS n, least(len(w), {licenses.GRAM}) AS k, len(w) // 10 AS slack FROM t),
    tg AS (SELECT template, k, tp, array_to_string(w[tp + 1 : tp + k], ' ') AS g
           FROM (SELECT *, unnest(range(0, n - k + 1)) AS tp FROM s)),
    dg AS (SELECT r, p, k, array_to_string(w[p + 1 : p + k], ' ') AS g
           FROM (SELECT *, unnest([2, 3, 4]) AS k FROM (SELECT *, unnest(range(0, len(w))) AS p FROM d)) WHERE p + k <= len(w)),
    met AS (SELECT r, template, p, tp, p - tp AS diagonal FROM dg JOIN tg USING (k, g)),
    cut AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > slack, false) AS new
            FROM met JOIN s USING (template)),
    grouped AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY r, template ORDER BY diagonal) AS grp FROM cut),
    found AS (SELECT r, template, label, base, min(p) AS p,
                     len(list_distinct(flatten(list(range(tp, tp + k))))) / any_value(n) AS cover
              FROM grouped GROUP BY r, template, label, base, grp HAVING cover >= if(any_value(n) >= {licenses.LONG}, {licenses.COVER}, 1.0))
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(p) FILTER (base) AS n_base,
           min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(cover), 0.0) AS score
    FROM d LEFT JOIN found USING (r) GROUP BY r, doc_id, w"""

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda crc, ch: list_reduce([xor(crc, ch), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT)"""
LLM_ORACLES["op13_conversation_trie"] = f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM t),
    r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
          UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
    n AS (SELECT *, row_number() OVER w AS d, strlen(text) AS bytes,
                 md5(string_agg(md5(role) || md5(text), '') OVER w) AS key
          FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT conv_id, d, bytes, key, lag(key, 1, 'root') OVER (PARTITION BY conv_id ORDER BY d) AS above FROM n
          UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c),
    len AS (SELECT conv_id, max(d) AS last FROM p GROUP BY 1),
    node AS (SELECT key, any_value(above) AS above, min(conv_id) AS conv_id, d AS depth, count(*) AS n_convs, any_value(bytes) AS bytes,
                    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = last), '')) AS ends_sha256
             FROM p JOIN len USING (conv_id) GROUP BY key, d),
    kids AS (SELECT above AS key, count(*) AS n_children FROM node WHERE above IS NOT NULL GROUP BY 1),
    own AS (SELECT node.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM node LEFT JOIN kids USING (key)),
    below AS (SELECT DISTINCT up.key AS top, own.key, own.n_children, own.saved FROM p up JOIN p low ON up.conv_id = low.conv_id AND up.d <= low.d JOIN own ON own.key = low.key),
    sums AS (SELECT top AS key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM below GROUP BY 1)
    SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, own.ends_sha256
    FROM own JOIN sums USING (key) LEFT JOIN own up ON up.key = own.above"""
