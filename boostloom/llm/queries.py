"""The operators' queries over the test tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostloom.llm import bpe, cover_tree, languages, multi_index, toxicity
from boostloom.llm.fill_middle import fill_in_middle, restore
from boostloom.llm.licenses import scan_licenses
from boostloom.llm.mixing import mix
from boostloom.llm.near_dups import near_dups
from boostloom.llm.pitman_yor import language_model
from boostloom.llm.sharding import assign_shards
from boostloom.llm.spelling import spelling_variants
from boostloom.llm.substrings import substring_dedup

#: Shards and slots of op6: 128 slots for each shard, give or take one.
SHARDS, SLOTS = [f"shard-{i:03d}" for i in range(64)], 8191


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "n_chars")
    return assign_shards(docs, "doc_id", SHARDS, SLOTS).select("doc_id", "source", "n_chars", "slot", "shard")


#: The turns are played by a recursive query, one claim a step; a shard skips to its first free slot.
OP6_SQL = r"""
WITH RECURSIVE s AS (SELECT i, printf('shard-%03d', i) AS shard FROM range(64) AS t(i)),
p AS (SELECT list((('0x' || substr(md5(shard || ':offset'), 1, 15))::BIGINT % 8191) ORDER BY i) AS o,
             list((('0x' || substr(md5(shard || ':skip'), 1, 15))::BIGINT % 8190 + 1) ORDER BY i) AS k FROM s),
turn(n, owner, nxt, slot) AS (
  SELECT 0, list_transform(range(8191), lambda x: -1), list_transform(range(64), lambda x: 0), -1
  UNION ALL
  SELECT n + 1,
         list_concat(list_concat(owner[1:slot2], [n % 64]), owner[slot2 + 2:]),
         list_concat(list_concat(nxt[1:n % 64], [j + 1]), nxt[n % 64 + 2:]), slot2
  FROM (SELECT n, owner, nxt, j, (o[n % 64 + 1] + j * k[n % 64 + 1]) % 8191 AS slot2
        FROM (SELECT n, owner, nxt, o, k, list_filter(range(nxt[n % 64 + 1], 8191), lambda x: owner[((o[n % 64 + 1] + x * k[n % 64 + 1]) % 8191) + 1] = -1)[1] AS j
              FROM turn, p WHERE n < 8191))),
claims AS (SELECT slot, (n - 1) % 64 AS i FROM turn WHERE n > 0)
SELECT doc_id, source, n_chars, claims.slot::INT AS slot, shard
FROM (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 8191) AS at FROM documents) d
JOIN claims ON claims.slot = d.at JOIN s ON s.i = claims.i
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), width=20, with_text=False)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, range(0, 20) AS t(k)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS s, count(*) AS n
         FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""



def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return multi_index.search(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_dups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = vec_id
"""


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(documents(spark, sf_dir))


#: s: weighted shingles of different texts.  Pairs whose shares of weight in common reach the threshold (a bound
#: on the similarity) are compared; cells count a pair's shingles of equal weights.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS MATERIALIZED (SELECT t, min(doc_id) AS u, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY t),
s AS MATERIALIZED (SELECT u, s, 1 + ln(count(*)) AS w FROM (SELECT u, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM u, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i)) GROUP BY u, s),
total AS MATERIALIZED (SELECT u, sum(w) AS t FROM s GROUP BY u),
pair AS MATERIALIZED (SELECT x.u AS a, y.u AS b FROM s x JOIN s y ON x.s = y.s AND x.u < y.u JOIN total p ON p.u = x.u JOIN total q ON q.u = y.u
                      GROUP BY ALL HAVING sum(least(x.w / p.t, y.w / q.t)) >= 0.8 - 1e-9),
cell AS MATERIALIZED (SELECT a, b, x, y, count(*) AS n FROM (
  SELECT a, b, s, max(x) AS x, max(y) AS y FROM (SELECT a, b, s, w AS x, 0 AS y FROM pair JOIN s ON u = a UNION ALL SELECT a, b, s, 0, w FROM pair JOIN s ON u = b) GROUP BY a, b, s) GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM (SELECT p.a, p.b, p.n / sum(q.n * greatest(q.x / p.x, q.y / p.y)) AS part FROM cell p JOIN cell q ON p.a = q.a AND p.b = q.b WHERE p.x > 0 AND p.y > 0 GROUP BY p.a, p.b, p.x, p.y, p.n)
                      GROUP BY a, b HAVING sum(part) >= 0.8),
way AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM way UNION SELECT r.a, l.b FROM reach r JOIN way l ON r.b = l.a),
class AS (SELECT u, t, least(u, coalesce(min(b), u)) AS c FROM u LEFT JOIN reach ON a = u GROUP BY u, t)
SELECT doc_id, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM d LEFT JOIN class ON class.t = d.t AND len(d.w) > 0
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (toxicity.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = languages.identify(docs, languages.fit(docs))
    return found.select("doc_id", (toxicity.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "mixture")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(documents(spark, sf_dir))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM p
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), typo=97)


#: CRC-32 by its table, which a rule makes; deletions as strings; chains by recursion.
OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)),
low AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents),
run AS MATERIALIZED (SELECT i, r, count(*) AS n, hex(encode(i || ':' || r)) AS x FROM low WHERE length(r) >= 5 GROUP BY i, r),
h AS MATERIALIZED (SELECT r, n, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(x, 2 * k + 1, 2))::BIGINT FOR k IN range(length(x) // 2)]), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM run, crc),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS MATERIALIZED (SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS s FROM w, unnest(range(length(word))) AS u(k)),
pair AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT x.word AS a, y.word AS b FROM del x JOIN del y ON x.s = y.s AND x.k = y.k AND x.word <> y.word
                      UNION ALL SELECT del.word, w.word FROM del JOIN w ON del.s = w.word UNION ALL SELECT w.word, del.word FROM del JOIN w ON del.s = w.word)),
best AS MATERIALIZED (SELECT a, count(*) AS n_near, arg_min(b, (-w.n, b)) AS b, max(w.n) AS m FROM pair JOIN w ON w.word = b GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN b END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best ON a = w.word),
way(word, spot) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.spot WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.spot AS root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word JOIN f AS g ON g.word = way.spot WHERE g.form IS NULL
"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


QUERIES = {
    "op1_multi_index": op1_multi_index,
    "op2_cover_tree": op2_cover_tree,
    "op3_soft_mixing": op3_soft_mixing,
    "op4_near_dups": op4_near_dups,
    "op5_toxicity": op5_toxicity,
    "op6_lookup_sharding": op6_lookup_sharding,
    "op7_language_mixture": op7_language_mixture,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_fill_middle": op11_fill_middle,
    "op12_spelling": op12_spelling,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL = {
    "op2_cover_tree": OP2_SQL,
    "op4_near_dups": OP4_SQL,
    "op6_lookup_sharding": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op11_fill_middle": OP11_SQL,
    "op12_spelling": OP12_SQL,
}
