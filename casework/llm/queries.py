"""The registered queries of the operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm import alignment, conversations, exact_dedup, fingerprints, lang_id, mixing, near_dedup, orc_ids, packing, pii, resampling
from casework.llm import sharding, topk
from casework.llm.common import table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return put


@query("op10_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exact_dedup.copy_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op2_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT AS u
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
      FROM d GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS pool,
             sum(weight) OVER () AS all_weight FROM s),
-- sources by cap / weight: the clamped ones are a prefix of this order
r AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS cap_before, coalesce(sum(weight) OVER p, 0) AS weight_before FROM f
      WINDOW p AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * (all_weight - weight_before) <= (pool - cap_before) * weight AS clamped FROM r),
z AS (SELECT any_value(pool) - coalesce(sum(cap) FILTER (clamped), 0) AS left_over,
             any_value(all_weight) - coalesce(sum(weight) FILTER (clamped), 0) AS open_weight FROM c),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE left_over * weight / open_weight END AS target FROM c, z),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
x AS (SELECT d.*, g.source_size, g.target, g.passes, round(g.target)::BIGINT - g.passes * g.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM x""")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mixture(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op5_orc_ids")
def op5_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_ids.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return n.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.languages(table(spark, sf_dir, "documents"))


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op7_topk", """
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.r, q.id AS query_id, c.id AS vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)])::BIGINT AS score
      FROM v q JOIN v c ON q.id % 50 = 0 AND c.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op3_sharding", """
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
           FROM documents),
p AS (SELECT d.*, depth, CASE WHEN depth = 0 THEN 0 ELSE key >> (60 - depth) END AS bucket
      FROM d, (SELECT unnest(range(0, 61))::INT AS depth)),
b AS (SELECT depth, bucket, sum(n_bytes)::BIGINT AS shard_bytes, min(key) = max(key) AS single FROM p GROUP BY depth, bucket),
f AS (SELECT p.doc_id, p.key, min(p.depth) AS depth FROM p JOIN b USING (depth, bucket)
      WHERE shard_bytes <= 1048576 OR single GROUP BY p.doc_id, p.key)
SELECT p.doc_id, CASE WHEN p.depth = 0 THEN '' ELSE right(lpad(bin(p.bucket), 64, '0'), p.depth) END AS shard, p.depth, p.n_bytes, b.shard_bytes
FROM p JOIN f USING (doc_id, key, depth) JOIN b USING (depth, bucket)""")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


@query("op9_resampling")
def op9_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query("op11_fingerprints")
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


@query("op12_conversations", r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
-- CRC-32 by half bytes; the table holds its sixteen fixed values
hit AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten([[('0x' || substr(hex(encode(k)), 2 * i, 1))::BIGINT,
             ('0x' || substr(hex(encode(k)), 2 * i - 1, 1))::BIGINT] FOR i IN range(1, strlen(k) + 1)])),
           lambda c, n: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384,
                                  4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, n) & 15) + 1]))) % 20 AS d FROM src),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM hit, (SELECT unnest([0, 1]) AS copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
seq AS (
  SELECT *, substr(role, 1, 1) AS i, row_number() OVER c AS pos,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(substr(role, 1, 1)) OVER c AS pi
  FROM hurt WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, unhex(sha256(length(role) || ':' || role || text)), copy)),
ids AS (SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM conversations)),
rws AS (SELECT id, pos, i, role, text, fault FROM seq JOIN ids ON seq.conv_id IS NOT DISTINCT FROM ids.conv_id),
-- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; the cheapest insertions between them
ins(s, t, letters, made) AS (VALUES (0, 0, '', ''), (0, 2, 'I', E'\nuser:'), (0, 3, 'II', E'\nuser:\nassistant:'), (1, 1, '', ''), (1, 2, 'I', E'\nuser:'),
  (1, 3, 'II', E'\nuser:\nassistant:'), (2, 2, '', ''), (2, 3, 'I', E'\nassistant:'), (3, 3, '', ''), (3, 2, 'I', E'\nuser:')),
act(s, t, letter, cost, need, says) AS (
  SELECT s, s, 'D', 4, NULL, NULL FROM (VALUES (0), (1), (2), (3)) v(s)
  UNION ALL SELECT s, 2, letter, cost, need, says FROM (VALUES (0), (1), (3)) v(s), (VALUES ('K', 0, 'u', NULL), ('R', 3, NULL, 'user')) e(letter, cost, need, says)
  UNION ALL VALUES (2, 3, 'K', 0, 'a', NULL), (2, 3, 'R', 3, NULL, 'assistant'), (0, 1, 'K', 0, 's', NULL)),
walk AS (
  SELECT id, 0::BIGINT AS pos, 0 AS st, {'cost': 0::BIGINT, 'audit': '', 'made': ''} AS best FROM ids
  UNION ALL
  SELECT w.id, r.pos, a.t, min({'cost': best.cost + 3 * length(ins.letters) + a.cost + CASE WHEN a.letter <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END,
                               'audit': best.audit || ins.letters || a.letter,
                               'made': best.made || ins.made || CASE WHEN a.letter = 'D' THEN '' ELSE E'\n' || coalesce(a.says, r.role) || ':' || r.text END})
  FROM walk w JOIN rws r ON r.id = w.id AND r.pos = w.pos + 1 JOIN ins ON ins.s = w.st JOIN act a ON a.s = ins.t
       AND (a.letter = 'D' OR r.fault IN ('', 'truncated')) AND (a.need IS NULL OR a.need = r.i)
  GROUP BY w.id, r.pos, a.t),
top AS (SELECT id, coalesce(max(pos), 0) AS n FROM rws GROUP BY id),
fin AS (
  SELECT w.id, min({'cost': best.cost + 3 * length(ins.letters), 'audit': best.audit || ins.letters, 'made': best.made || ins.made}) AS best
  FROM walk w LEFT JOIN top ON top.id = w.id JOIN ins ON ins.s = w.st AND ins.t IN (0, 3) WHERE w.pos = coalesce(top.n, 0) GROUP BY w.id),
sums AS (
  SELECT ids.id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pos > 1 AND pi || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN seq ON seq.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.id)
SELECT ids.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(substr(best.made, 2)) AS repaired_sha256
FROM ids JOIN sums USING (id) JOIN fin USING (id)""")
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.damaged(table(spark, sf_dir, "conversations")))
