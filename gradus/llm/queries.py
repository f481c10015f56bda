"""One query for each operator of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, fim, license_scan, media, minhash, mixing, parity_join, quality, sharding, url_filter, warc, wordpiece

Query = Callable[[SparkSession, str], DataFrame]

#: (host, path, verdict): the rules by which pages are judged; a rule is named by its host and path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Listed hosts, blocked where no rule fits.
LISTED_NAMES = ("ads-track", "spam-farm", "casino-win", "cheap-pills", "adult-x", "free-bets")
LISTED_HOSTS = tuple(f"{name}.{domain}" for name in LISTED_NAMES for domain in ("example.com", "example.org"))
#: Listed URLs: on these hosts every page of a language whose number is a multiple of STEP.
LISTED_DOMAINS, LISTED_LANGUAGES, LISTED_NUMBERS, STEP = ("example.com", "example.org"), ("de", "en", "es", "fr"), 10_000, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by the rules, and by the listed hosts and URLs where no rule fits.

    A null url, or one without ``://``, has an empty host and path, and the default verdict. Repeated rows stay; URLs
    may be of any length; an empty table gives no rows.
    """
    entries = [(h, p, v, f"{h}{p}") for h, p, v in RULES] + [(h, "", "block", None) for h in LISTED_HOSTS]
    entries += [(h, f"/{lang}/{n}.html", "block", None) for h in LISTED_DOMAINS for lang in LISTED_LANGUAGES for n in range(0, LISTED_NUMBERS, STEP)]
    listed = spark.createDataFrame(entries, "host string, path string, verdict string, rule string")
    return url_filter.judge(table(spark, sf_dir, "pages"), listed)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a media file under a wrong type, sniffed, carved and read back.

    A null text is an empty one, of 576 bytes 255. Repeated rows stay, equal texts have equal values, texts are read
    whole, and an empty table gives no rows.
    """
    stored = media.store(table(spark, sf_dir, "documents"))
    found = media.inspect(stored, "doc_id", extra=["n_bytes"])
    files = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["kind"], f["start"], f["length"], f["depth"], f["sha256"])), ",")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", files.alias("files"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's target, and the words that the mix takes of it.

    A null text has no words; a null source is a source, the last. Documents of one hash are taken or left together;
    rows that repeat a key have one hash. Texts may be of any length; an empty table gives no rows.
    """
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected grade, the probability of the top grade, and whether the classifier keeps it.

    A null text is graded as an empty one. Repeated rows stay, texts are read whole, and an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, columns=["doc_id"])
    return scored.withColumn("keep", F.col("tail_probability") >= quality.KEEP)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses of every document: template, coverage, words.

    Null and empty texts hold none; repeated rows are each told; texts are read whole; an empty table gives no rows.
    """
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak benchmark items, with each item and its coverage.

    Null and empty texts leak nothing; repeated rows and items are each told; texts are read whole; without documents or
    items there are no rows.
    """
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and word pieces.

    Null and empty texts have none; repeated rows stay; texts are read whole; an empty table gives no rows.
    """
    return wordpiece.count_pieces(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives.

    A null html is an empty one. Rows that repeat a key and payload are all responses; pages may be of any length; an
    empty table gives no rows.
    """
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component.

    Null and empty texts have empty sets and are linked with nothing. Repeated rows share a component; texts are read
    whole; an empty table gives no rows.
    """
    return parity_join.join(table(spark, sf_dir, "documents"), k=3, t=Fraction(9, 10))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read from the shards of the last manifest version, with a digest of its text.

    The table comes in four arrivals. Nulls, repeated rows and texts of any length are kept as they are; an empty table
    gives no rows.
    """
    rows = sharding.shard(table(spark, sf_dir, "documents")).read(shard="shard")
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"), "shard")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language: how far the others are, and its ten most telling terms.

    Null texts, languages and sources are empty ones; repeated rows count; texts are read whole; an empty table gives no
    rows.
    """
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set, its component, and whether it is the one that stays of it.

    Null and empty texts have empty sets, are linked with nothing and stay. Repeated rows share a component and fate;
    texts are read whole; an empty table gives no rows.
    """
    return minhash.near_copies(table(spark, sf_dir, "documents"), k=5, t=Fraction(85, 100))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cut, with digests of its rearranged text and of the text rebuilt from that.

    A null text is an empty one, and plain. Repeated rows stay; texts are read whole; an empty table gives no rows.
    """
    found = fim.invert(fim.transform(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``corpus_pipeline.run``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_url_filter, op2_media_columns, op3_mixing, op4_quality_classifier, op5_license_scan, op6_decontamination, op7_token_counts, op8_warc, op9_ngram_jaccard_join, op10_sharding, op11_source_divergence, op12_minhash_near_dedup, op13_fill_in_middle, pipeline)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

_URL_SQL = """
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
f AS (SELECT *, '.' || host AS dotted FROM p),
r AS (SELECT *, CASE
    WHEN dotted LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN dotted LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN dotted LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN dotted LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN """ + " OR ".join(f"dotted LIKE '%.{h}'" for h in LISTED_HOSTS) + rf"""
    OR ({" OR ".join(f"dotted LIKE '%.{h}'" for h in LISTED_DOMAINS)}) AND CAST(nullif(regexp_extract(path, '^/({"|".join(LISTED_LANGUAGES)})/(0|[1-9][0-9]{{0,3}})\.html', 2), '') AS INT) % {STEP} = 0
    THEN 'block' ELSE 'allow' END AS verdict FROM r"""

_WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, {_WORDS_SQL} AS size, CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM w),
c AS (SELECT a.k, (SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(b.source_size) * 3, 0) AS words, (SELECT sum(weight) FROM w) - coalesce(sum(b.weight), 0) AS weights
  FROM o a LEFT JOIN o b ON b.k < a.k GROUP BY a.k),
l AS (SELECT max(c.words / c.weights) AS level FROM c JOIN o USING (k) WHERE c.words / c.weights < 3.0::DOUBLE * o.source_size / o.weight),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN 3.0::DOUBLE * source_size ELSE least(3.0::DOUBLE * source_size, weight * level) END AS target FROM o, l),
n AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes FROM t),
h AS (SELECT source, hash, sum(size) AS words FROM d GROUP BY source, hash),
u AS (SELECT source, hash, words, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h),
b AS (SELECT u.source, min(CASE WHEN upto >= target - passes * source_size THEN hash END) AS hash FROM u JOIN n ON u.source IS NOT DISTINCT FROM n.source WHERE target - passes * source_size >= 0.5 GROUP BY u.source),
x AS (SELECT b.source, CASE WHEN u.upto - (n.target - n.passes * n.source_size) <= (n.target - n.passes * n.source_size) - (u.upto - u.words) THEN u.hash + 1 ELSE u.hash END AS threshold
  FROM b JOIN u ON u.source IS NOT DISTINCT FROM b.source AND u.hash = b.hash JOIN n ON n.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, n.source_size, n.target, CAST(d.size * (n.passes + CASE WHEN d.hash < coalesce(x.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(n.passes + CASE WHEN d.hash < coalesce(x.threshold, 0) THEN 1 ELSE 0 END AS BIGINT) AS copies, d.source
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS newest FROM p GROUP BY h),
d AS (SELECT page_id, h, newest, sha1(h) AS x FROM p JOIN g USING (h))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((strpos('0123456789abcdef', x[i * 5 // 4 + 1]) - 1) * 16 + strpos('0123456789abcdef', x[i * 5 // 4 + 2]) - 1) // CAST(power(2, 3 - i * 5 % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM d"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT doc_id, any_value(n) AS n_shingles, min(reached) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id"""

_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT doc_id, any_value(n) AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id"""

_DIVERGENCE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 10),
c AS (SELECT lang, source, t, CAST(count(*) AS HUGEINT) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) JOIN k USING (lang, t) GROUP BY ALL),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v.v) AS p FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, t)),
l AS (SELECT lang, sum(total)::HUGEINT AS total FROM s GROUP BY lang),
q AS (SELECT c.lang, c.t, 1 + (1000000000 * (sum(c.n)::HUGEINT + 2)) // (any_value(l.total) + 2 * any_value(v.v)) AS q FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.t = x.t GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', t, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""

_MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || x[8 * i - 7 : 8 * i] AS BIGINT) FOR i IN [1, 2, 3, 4]] AS h FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM h),
c AS (SELECT *, coalesce(array_to_string(u[: a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 :], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c"""

SQL: dict[str, str] = {"op1_url_filter": _URL_SQL, "op3_mixing": _MIX_SQL, "op8_warc": _WARC_SQL, "op9_ngram_jaccard_join": _JACCARD_SQL, "op11_source_divergence": _DIVERGENCE_SQL, "op12_minhash_near_dedup": _NEAR_SQL, "op13_fill_in_middle": _MIDDLE_SQL}
