"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook.llm import conversations, decontaminate, jaccard, language, packing, quality, secret_scan, sharding, suffixes, token_files, toxicity, warc, whitening
from wirebook.sources.tables import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("sig", "label")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    found = quality.quality(docs, labels, keep=["doc_id"])
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.Model(language.learn(docs.where("NOT held_out AND doc_id IS NOT NULL")))
    found = language.predict(docs, model, keep=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.digests(token_files.read_token_files(spark, path))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = decontaminate.contamination(docs, items, keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
    names = "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    return conversations.digests(found).select(*names)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = toxicity.train(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, model, keep=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "score", "predicted")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    found = whitening.whiten(rows, model, keep=["vec_id"])
    found = found.select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = [F.lit(float(e / model.total)) for e in model.values] if model else []
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*explained), F.col("at")).cast("double").alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_spans": op4_language_spans,
    "op5_warc": op5_warc,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_runs": op8_suffix_runs,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_byte_shards": op10_byte_shards,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_toxicity": op12_toxicity,
    "op13_embedding_whitening": op13_embedding_whitening,
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: From the last row back, the least (cost, edits, lines) on from each state; inserts first, at most two.
REPAIR_SQL = r"""
WITH RECURSIVE k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: unicode(key[i]))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS step FROM o),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r(conv_id, i, s0, s1, s2, s3) AS (
    SELECT conv_id, n, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}, {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']},
           {'c': 3, 'a': 'I', 't': ['assistant:']}, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])} FROM g
    UNION ALL
    SELECT conv_id, i,
           list_min([d0, {'c': d2.c + 3, 'a': 'I' || d2.a, 't': list_prepend('user:', d2.t)}, {'c': d3.c + 6, 'a': 'II' || d3.a, 't': ['user:', 'assistant:'] || d3.t}]),
           list_min([d1, {'c': d2.c + 3, 'a': 'I' || d2.a, 't': list_prepend('user:', d2.t)}, {'c': d3.c + 6, 'a': 'II' || d3.a, 't': ['user:', 'assistant:'] || d3.t}]),
           list_min([d2, {'c': d3.c + 3, 'a': 'I' || d3.a, 't': list_prepend('assistant:', d3.t)}]),
           list_min([d3, {'c': d2.c + 3, 'a': 'I' || d2.a, 't': list_prepend('user:', d2.t)}])
    FROM (SELECT r.conv_id, r.i - 1 AS i,
            CASE WHEN fault IN ('b', 'd') THEN {'c': s0.c + 4, 'a': 'D' || s0.a, 't': s0.t} ELSE list_min([{'c': s0.c + 4, 'a': 'D' || s0.a, 't': s0.t}, {'c': s2.c + 3 + more, 'a': 'R' || s2.a, 't': list_prepend('user:' || text, s2.t)}]
                || CASE WHEN role LIKE 's%' THEN [{'c': s1.c + more, 'a': 'K' || s1.a, 't': list_prepend(line, s1.t)}] WHEN role LIKE 'u%' THEN [{'c': s2.c + more, 'a': 'K' || s2.a, 't': list_prepend(line, s2.t)}] ELSE [] END) END AS d0,
            CASE WHEN fault IN ('b', 'd') THEN {'c': s1.c + 4, 'a': 'D' || s1.a, 't': s1.t} ELSE list_min([{'c': s1.c + 4, 'a': 'D' || s1.a, 't': s1.t}, {'c': s2.c + 3 + more, 'a': 'R' || s2.a, 't': list_prepend('user:' || text, s2.t)}]
                || CASE WHEN role LIKE 'u%' THEN [{'c': s2.c + more, 'a': 'K' || s2.a, 't': list_prepend(line, s2.t)}] ELSE [] END) END AS d1,
            CASE WHEN fault IN ('b', 'd') THEN {'c': s2.c + 4, 'a': 'D' || s2.a, 't': s2.t} ELSE list_min([{'c': s2.c + 4, 'a': 'D' || s2.a, 't': s2.t}, {'c': s3.c + 3 + more, 'a': 'R' || s3.a, 't': list_prepend('assistant:' || text, s3.t)}]
                || CASE WHEN role LIKE 'a%' THEN [{'c': s3.c + more, 'a': 'K' || s3.a, 't': list_prepend(line, s3.t)}] ELSE [] END) END AS d2,
            CASE WHEN fault IN ('b', 'd') THEN {'c': s3.c + 4, 'a': 'D' || s3.a, 't': s3.t} ELSE list_min([{'c': s3.c + 4, 'a': 'D' || s3.a, 't': s3.t}, {'c': s2.c + 3 + more, 'a': 'R' || s2.a, 't': list_prepend('user:' || text, s2.t)}]
                || CASE WHEN role LIKE 'u%' THEN [{'c': s2.c + more, 'a': 'K' || s2.a, 't': list_prepend(line, s2.t)}] ELSE [] END) END AS d3
          FROM r JOIN (SELECT *, role || ':' || text AS line, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more FROM f) f
            ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN r ON r.i = 0 AND a.conv_id IS NOT DISTINCT FROM r.conv_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS m, any_value(b.n) AS n
      FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * i >= 80 * (m + n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, len(s) AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s""",
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
               (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d""",
    "op7_decontamination": f"""
WITH items AS (SELECT item_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM benchmark),
spans AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM spans),
docs AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
lists AS (SELECT doc_id, n, list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) AS l
          FROM docs, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n),
own AS (SELECT doc_id, n, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM lists),
met AS (SELECT doc_id, i, own.n, item_id FROM own JOIN wanted USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op11_conversation_repair": REPAIR_SQL,
    "op8_suffix_runs": """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS MATERIALIZED (SELECT r, i, md5_number_lower(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
m AS (SELECT r, i FROM s JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
f AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM m),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY r, run),
ends AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS b FROM (SELECT * FROM runs UNION ALL SELECT r, n, n FROM d)),
kept AS (SELECT r, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a, z) AS h FROM ends JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS gone, count(*) AS n_spans FROM runs GROUP BY r)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)""",
}
