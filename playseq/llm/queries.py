"""One query per operator, over its whole tables with production settings, and the statements they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playseq.llm import centroids, decontaminate, embeddings, html, langid, mixing, ngram_join, periodic, pii, secret_scan, substrings, toxicity, warc
from playseq.llm.common import table

#: Key of the pseudonyms of this query; a real run takes its own from a secret store.
KEY = "query-key"


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_bytes", "record_sha256")


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Findings with their score; values are given as digests only."""
    found = secret_scan.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "path", "start", F.length("value").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "secret")


def op3_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(table(spark, folder, "documents"), key=KEY)


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.in_training_order(mixing.mix(table(spark, folder, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where every tenth document (by the checksum of its id) repeats a stretch up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.expr("h div 10"), F.size("w").cast("long")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.select("doc_id", "text", "w", n.alias("n"), g.alias("g"))
    rows = rows.select("*", F.expr("case when n > 0 then g % n end").alias("a"))
    rows = rows.select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    periodic_text = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, get(w, cast(a + (i - a) % p as int)))), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, periodic_text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(planted_runs(table(spark, folder, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.lloyd(table(spark, folder, "embeddings"))


def op13_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_secrets": op2_secrets,
    "op3_near_vectors": op3_near_vectors,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_main_text": op6_main_text,
    "op7_ngram_join": op7_ngram_join,
    "op8_language": op8_language,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroids": op12_centroids,
    "op13_substrings": op13_substrings,
}

SQL: dict[str, str] = {}

SQL["op1_warc"] = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL
), r AS (
  SELECT *, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)
), h AS (
  SELECT *, 'HTTP/1.1 200 OK|Content-Type: text/html; charset=utf-8|Content-Length: ' || payload_bytes || '||' AS http FROM r
), w AS (
  SELECT *, 'WARC/1.1|WARC-Type: ' || record_type || '|WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>|WARC-Date: 2020-01-01T00:00:00Z|'
    || coalesce('WARC-Target-URI: ' || url || '|', '') || 'WARC-Payload-Digest: sha256:' || payload_digest || '|'
    || CASE WHEN record_type = 'revisit' THEN 'WARC-Refers-To: <urn:page:' || refers_to || '>|WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest|' ELSE '' END
    || 'Content-Type: application/http; msgtype=response|Content-Length: '
    || (length(replace(http, '|', '..')) + CASE WHEN record_type = 'revisit' THEN 0 ELSE payload_bytes END) || '||' || http AS header FROM h
), b AS (
  SELECT *, replace(header, '|', chr(13) || chr(10)) || CASE WHEN record_type = 'response' THEN html ELSE '' END || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM w
)
SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, strlen(record)::BIGINT AS record_bytes, sha256(record) AS record_sha256 FROM b
"""

SQL["op3_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS m FROM embeddings UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.a
), c AS (
  SELECT a, min(m) AS component_id FROM r GROUP BY a
), k AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""

SQL["op4_decontamination"] = """
WITH RECURSIVE item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS n
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), hit AS (
  SELECT r, i, size, item_id
  FROM doc, (SELECT DISTINCT n AS size FROM win), unnest(range(1, len(w) + 2 - size)) AS t(i)
  JOIN win ON win.k = array_to_string(w[i:i + size - 1], ' ') AND win.n = size
), word AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + size)) AS t(p) GROUP BY r
), own AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN own USING (r)
"""

SQL["op7_ngram_join"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS k
  FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS m FROM documents UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.a
), g AS (
  SELECT a, min(m) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN g ON g.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SQL["op10_mixing"] = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), '') AS o FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS nth FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][nth % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, coalesce(sum(cap) OVER below, 0) AS held, sum(weight) OVER above AS rest, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS words
  FROM w WINDOW below AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                above AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT coalesce(min_by((words - held) / rest, ratio) FILTER (ratio >= (words - held) / rest), 0) AS level, any_value(words)::DOUBLE AS words FROM l
), t AS (
  SELECT source, source_size, nth, words, least(cap, level * weight)::DOUBLE AS target, round(least(cap, level * weight))::BIGINT AS goal FROM w, level
), c AS (
  SELECT d.doc_id, d.size, t.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), m AS (
  SELECT *, greatest(least(goal - start, size), 0) AS one, greatest(least(goal - start - source_size, size), 0) AS two, start::DOUBLE / goal AS q FROM c
)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
  CASE WHEN one > 0 THEN floor(words * least(1.0, greatest(0.0, CASE nth % 3
    WHEN 0 THEN q
    WHEN 1 THEN (sqrt(greatest(2.25::DOUBLE - 2 * q, 0)) - 1.5) / -1.0
    ELSE CASE WHEN q * 0.875::DOUBLE < 0.25 THEN q * 0.875::DOUBLE / 0.5 ELSE 0.5 + (sqrt(greatest(0.25::DOUBLE + 6 * (q * 0.875::DOUBLE - 0.25), 0)) - 0.5) / 3.0 END
  END)))::BIGINT END AS position
FROM m
"""

# Checksum of the id bit by bit. Words equal over a lag make equal grams of five, whose islands on a diagonal are the
# stretches; of several lags with the same stretch the smallest is the period.
SQL["op11_periodic_runs"] = """
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w0,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda b, k: xor(b >> 1, (b & 1) * 3988292384::BIGINT)))) AS h
  FROM documents
), place AS (
  SELECT *, len(w0)::BIGINT AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM raw
), doc AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w0[i + 1] ELSE w0[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM place
), gram AS (
  SELECT r, n, i, hash(array_to_string(w[i + 1:i + 5], ' ')) AS k FROM doc, unnest(range(n - 4)) AS t(i) WHERE n >= 6
), pair AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.r = y.r AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), island AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM pair
), stretch AS (
  SELECT r, q, min(i) AS start, max(i) - min(i) + 5 + q AS length FROM island GROUP BY r, q, part
), run AS (
  SELECT r, start, length, min(q) AS period FROM stretch GROUP BY r, start, length HAVING length >= greatest(6, 4 * min(q))
), digest AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY r
), best AS (
  SELECT r, start, length, period FROM run x
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period::DOUBLE DESC, start, period) = 1
), gone AS (
  SELECT DISTINCT r, i FROM run, unnest(range(start + period, start + length)) AS t(i)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM doc) ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM doc LEFT JOIN digest USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

_ASSIGN = """, d{n} AS (
  SELECT v.r, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))::BIGINT AS d FROM v, c{n} c
), a{n} AS (
  SELECT r, d AS distance, c AS cluster FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)"""

_UPDATE = """, s{n} AS (
  SELECT cluster AS c, i, sum(v.v[i])::BIGINT AS s, count(*) AS m FROM a{n} JOIN v USING (r), unnest(range(1, 65)) AS t(i) GROUP BY ALL
), c{next} AS (
  SELECT c.c, coalesce(f.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT c, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS v FROM s{n} GROUP BY c) f USING (c)
)"""

SQL["op12_centroids"] = (
    """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS c, v FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16
)"""
    + "".join(_ASSIGN.format(n=i) + _UPDATE.format(n=i, next=i + 1) for i in range(3))
    + _ASSIGN.format(n=3)
    + """
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN c3 ON c3.c = a3.cluster
"""
)

SQL["op13_substrings"] = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM doc, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13
), least AS (
  SELECT k, min(doc_id) AS f FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT r, p FROM win JOIN least USING (k), unnest(range(i, i + 13)) AS t(p) WHERE f < doc_id
), n AS (
  SELECT r, count(*) AS n_removed FROM gone GROUP BY r
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM doc) ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
