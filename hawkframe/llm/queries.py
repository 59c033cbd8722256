"""The numbered queries: each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkframe.llm import annsearch, decontaminate, hardneg, linededup, mixing, neardup, ngramlm, permute, phrases, secrets, sharding, suffixdedup, toxicity, warc
from hawkframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _permuted_sql(rows: str, name: str) -> str:
    """CTE `name`: columns key, place for the rows (key, x, n, seed) of the CTE `rows`."""
    net = permute.network_sql("x", "a", "b", "seed")
    return f"""{name}_ab AS (SELECT *, ceil(sqrt(n))::BIGINT AS a, (n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT AS b FROM {rows}),
    {name}_walk AS (
        SELECT key, n, a, b, seed, {net} AS x FROM {name}_ab
        UNION ALL
        SELECT key, n, a, b, seed, {net} AS x FROM {name}_walk WHERE x >= n),
    {name} AS (SELECT key, x AS place FROM {name}_walk WHERE x < n)"""


OP2_SQL = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
laid AS (
    SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start,
        row_number() OVER () AS r FROM d),
s AS (SELECT source, sum(size)::BIGINT AS w, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
lv AS (SELECT *, (sum(w) OVER () - coalesce(sum(3 * w) OVER (ORDER BY w / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY w / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM s),
t AS (SELECT *, least((SELECT arg_min(l, (w / weight, source)) FROM lv WHERE l * weight <= 3 * w) * weight, 3.0 * w)::DOUBLE AS target FROM s),
p AS (SELECT *, (w + 127) // 128 AS blocks, round(target * ((w + 127) // 128) / w)::BIGINT AS slots FROM t WHERE w > 0),
j AS (SELECT source, nth, blocks, unnest(range(slots)) AS j FROM p),
bp AS (SELECT (nth, j) AS key, j % blocks AS x, blocks AS n, 11 + nth * 31 + j // blocks * 7 AS seed FROM j),
{_permuted_sql("bp", "bq")},
dp AS (SELECT (nth, j) AS key, j + (SELECT coalesce(sum(e.slots), 0) FROM p e WHERE e.nth < j.nth)::BIGINT AS x, (SELECT sum(slots) FROM p)::BIGINT AS n, 11::BIGINT AS seed FROM j),
{_permuted_sql("dp", "dq")},
dealt AS (SELECT key[1] AS nth, row_number() OVER (PARTITION BY key[1] ORDER BY place) - 1 AS j, place // 1024 AS shard FROM dq),
times AS (SELECT dealt.nth, place AS block, count(*) AS times, min(shard) AS shard FROM bq JOIN dealt ON bq.key[1] = dealt.nth AND bq.key[2] = dealt.j GROUP BY ALL),
cut AS (SELECT *, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM laid WHERE size > 0),
taken AS (SELECT r, sum((least(start + size, (block + 1) * 128) - greatest(start, block * 128)) * coalesce(times, 0))::BIGINT AS taken, min(times.shard) AS first_shard
    FROM cut JOIN s ON s.source IS NOT DISTINCT FROM cut.source LEFT JOIN times USING (nth, block) GROUP BY r)
SELECT doc_id, size, t.w AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_shard
FROM laid JOIN t ON t.source IS NOT DISTINCT FROM laid.source LEFT JOIN taken USING (r)
"""


@query("op2_mix_sources", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, text FROM documents),
bits AS (SELECT i AS b, i AS v, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
sums AS (
    SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda c, x: xor(c // 256, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS text_crc32
    FROM d, crc_table),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row FROM sums),
r AS (SELECT row AS key, row AS x, (SELECT count(*) FROM d) AS n, 17::BIGINT AS seed FROM n),
{_permuted_sql("r", "q")}
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (place % 40)::INT AS shard, place // 40 AS slot, NULL::INT AS grown_shard
FROM n JOIN q ON n.row = q.key
"""


@query("op3_shard_documents", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op4_nearest_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return annsearch.search(vectors.withColumn("asked", F.col("vec_id") % 50 == 0))


@query("op5_score_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Base 32 of a SHA-1: eight groups of five hexadecimal digits give four letters each.
OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS main FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = main THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> main THEN main END AS refers_to
FROM m
"""


@query("op1_warc_round_trip", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS run
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
runs AS (SELECT l, run, list(item_id) AS items FROM win GROUP BY l, run),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT r, l, k, array_to_string(list_slice(w, k, k + l - 1), ' ') AS run
    FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM runs) WHERE len(w) >= l)),
hits AS (SELECT r, k, g.l, items FROM grams g JOIN runs USING (l, run)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(k, k + l)) AS k FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, unnest(items)::VARCHAR AS x FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""


@query("op9_decontaminate", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_scan_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op8_language_model_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_report(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
reach AS (SELECT r AS x, r AS y FROM w UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
m AS (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN w ON w.r = y GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM w JOIN m USING (r) LEFT JOIN n USING (r)
"""


@query("op6_near_duplicates", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_repeated_bytes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup_report(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, s.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


@query("op11_drop_shared_lines", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, list_slice(w, k, k + m - 1) AS g, count(*) AS f
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM p, range(1, 5) t(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, unnest(range(1, len(g))) AS k FROM g WHERE len(g) > 1),
s AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
    FROM c JOIN g x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k) JOIN g y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, len(c.g))
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, k) = 1),
i AS (SELECT lang, list_slice(g, j, j + m - 1) AS g, max(f) AS longer FROM g, range(2, 4) t(m), range(1, 4) u(j)
    WHERE len(g) > m AND j + m - 1 <= len(g) GROUP BY ALL),
o AS (SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM s LEFT JOIN i ON i.lang = s.lang AND i.g = s.g WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op12_mine_phrases", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""


@query("op13_mine_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"))
