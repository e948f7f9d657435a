"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, chat, class_lm, decontaminate, heap_clusters, line_dedup, minhash_dedup, nearest, periodic, records, substring_dedup, toxicity, warc
from geoloom.llm.text import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "records")
    path = public_tokenizers.path("word_bpe_49k.json")
    index = records.write_records(table(spark, sf_dir, "documents"), folder, path, end_id=2)
    found = records.with_starts(records.read_records(spark, folder), index)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), path))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_bundles(warc.with_types(table(spark, sf_dir, "pages")), folder)
    found = warc.read_bundles(spark, folder)
    digest = F.coalesce(F.sha2("payload", 256), F.col("payload_digest"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(octet_length(encode(html)), 0) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""


@query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, share=(85, 100))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs.where(~toxicity.held_out()), table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = class_lm.score_corpus(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"""
_SHINGLES = "unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
ORACLES["op9_decontaminate"] = f"""
WITH b AS (SELECT DISTINCT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
d AS (SELECT DISTINCT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item FROM h JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""


@query
def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_chats(table(spark, sf_dir, "conversations")).drop("piece")


_SPLIT = """list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"""
ORACLES["op1_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_SPLIT} AS ws FROM documents)),
k AS (SELECT doc_id, unnest(list_transform(range(1, n - 48), lambda i: sha256(array_to_string(ws[i : i + 49], ' ')))) AS h, unnest(range(1, n - 48)) AS p FROM d WHERE n >= 50),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS pos FROM k JOIN f USING (h) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, n + 1)) AS pos FROM d WHERE n > 0),
r AS (SELECT t.doc_id, count(g.pos) AS n_removed, string_agg(w, ' ' ORDER BY t.pos) FILTER (WHERE g.pos IS NULL) AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.pos = t.pos GROUP BY t.doc_id)
SELECT d.doc_id, n AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
_TRIPLES = "unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
ORACLES["op2_near_duplicates"] = f"""
WITH RECURSIVE s AS (SELECT DISTINCT doc_id, {_TRIPLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e(a, b) AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id, coalesce(m.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query
def op11_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heap_clusters.with_inertia(*heap_clusters.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dims=64))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clusters_sql() -> str:
    near = "SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, s.c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM k, {at} s) GROUP BY vec_id, v"
    parts = [
        "k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "m0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM k QUALIFY c < 16)",
    ]
    for r in range(3):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(at=f'm{r}')})",
            f"u{r} AS (SELECT c, list(floor_of ORDER BY i) AS m FROM (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS floor_of FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i)) GROUP BY c)",
            f"m{r + 1} AS (SELECT c, coalesce(u{r}.m, m{r}.m) AS m FROM m{r} LEFT JOIN u{r} USING (c))",
        ]
    parts.append(f"a3 AS MATERIALIZED ({near.format(at='m3')})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN m3 USING (c)"""


ORACLES["op11_heap_clusters"] = _clusters_sql()


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.line_dedup(table(spark, sf_dir, "documents"), least=10, min_chars=1))


ORACLES["op12_line_dedup"] = """
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, chosen by the id's checksum, repeat their words from some place on."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("_words", F.when(h % 10 == 0, split))
    words, n = F.col("_words"), F.size("_words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.slice(words, a + 1, p)
    again = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a))
    return docs.withColumn("text", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text"))).drop("_words")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")), least=12))


ORACLES["op13_periodic_runs"] = f"""
WITH RECURSIVE t AS (SELECT range AS i, range AS v, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM t WHERE k = 8),
d0 AS (SELECT doc_id, {_SPLIT} AS ws, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, tab),
d1 AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, h // 10 % greatest(len(ws), 1) AS a, h // 10 % 8 + 3 AS e FROM d0),
d AS (SELECT doc_id, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // e) END + 1]) ELSE ws END AS ws FROM d1),
w AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
p AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i > y.i),
s AS (SELECT doc_id, q, min(i) AS f, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM p) GROUP BY doc_id, q, isle),
r AS MATERIALIZED (SELECT doc_id, f - q AS start, m + q AS length, min(q) AS period FROM s WHERE m >= q AND m + q >= 12 GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT w.doc_id, string_agg(w, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, CAST(1000 * top.l // top.p AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN c USING (doc_id)
"""
