"""Queries over the whole given tables, one for each operator, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import alignment, chat, html, linededup, mixing, packing, quality, simhash, spelling, topk, toxicity, urls, warc
from kerbside.llm.words import n_words
from kerbside.staging import fresh_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.read_back(chat.format_conversations(turns)).withColumn("learned", F.array_join("learned", ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS starts,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, replace(replace(text, '\', '\\'), '<|', '<\|')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN starts THEN 8 + role_chars + 8 + 8 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""


def op2_warc_dictionary_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    written(warc.write_archives(table(spark, sf_dir, "pages"), folder), "warc-manifest")
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
shared AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM rows)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM shared"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def _day(text) -> object:
    """A day of 2024 from a digest's four hex digits."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.conv(text, 16, 10).cast("int"), F.lit(366)))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, fetched on days that follow from their ids, against a list whose history follows from the pages' hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")).alias("fetched_at"))
    host, path = urls.url_host(F.col("url")), F.lower(urls.url_path(F.col("url")))
    split = pages.select(host.alias("host"), path.alias("path")).where("host is not null").withColumn("labels", F.split("host", r"\."))
    n = F.size("labels")
    named = split.select(F.explode(F.array(
        F.struct(F.lit("host").alias("scope"), F.col("host").alias("pattern")),
        F.struct(F.lit("domain").alias("scope"), F.when(n >= 2, F.array_join(F.slice("labels", n - 1, F.lit(2)), ".")).alias("pattern")),
        F.struct(F.lit("prefix").alias("scope"), F.when(F.col("path") != "", F.concat("host", F.lit("/"), F.split_part("path", F.lit("/"), F.lit(1)))).alias("pattern")),
    )).alias("k")).select("k.*").where("pattern is not null").distinct()
    digest = named.withColumn("m", F.md5(F.concat("scope", F.lit(":"), "pattern")))
    two = lambda at: F.conv(F.substring("m", at, 2), 16, 10).cast("int")
    least = F.when(F.col("scope") == "host", 128).when(F.col("scope") == "domain", 64).otherwise(32)
    listed = digest.where(two(1) < least)
    first = _day(F.substring("m", 3, 4))
    entries = listed.select("scope", "pattern", F.when(two(7) < 200, "block").otherwise("allow").alias("action"), first.alias("listed_at")).unionByName(
        listed.where(two(9) < 128).select("scope", "pattern", F.lit("remove").alias("action"), F.date_add(first, two(11) + 1).alias("listed_at"))
    )
    found = urls.filter_urls(pages, entries)
    return found.select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "host", "verdict", "scope", "pattern", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


OP4_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id * 7919) % 366 + 366) % 366 AS INTEGER) AS fetched_at,
    nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), '\.*(:[0-9]*)?$', '')), '') AS host,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)', 1)) AS path
  FROM pages),
named AS (
  SELECT 'host' AS scope, host AS pattern, 2 AS level FROM captures WHERE host IS NOT NULL
  UNION SELECT 'domain', array_to_string(string_split(host, '.')[-2:], '.'), 1 FROM captures WHERE len(string_split(host, '.')) >= 2
  UNION SELECT 'prefix', host || '/' || split_part(path, '/', 1), 3 FROM captures WHERE host IS NOT NULL AND path <> ''),
digest AS (SELECT *, md5(scope || ':' || pattern) AS m FROM named),
listed AS (
  SELECT *, DATE '2024-01-01' + CAST(CAST('0x' || m[3:6] AS INTEGER) % 366 AS INTEGER) AS first FROM digest
  WHERE CAST('0x' || m[1:2] AS INTEGER) < CASE scope WHEN 'host' THEN 128 WHEN 'domain' THEN 64 ELSE 32 END),
spans AS (
  SELECT scope, pattern, level, CASE WHEN CAST('0x' || m[7:8] AS INTEGER) < 200 THEN 'block' ELSE 'allow' END AS verdict, first AS valid_from,
    CASE WHEN CAST('0x' || m[9:10] AS INTEGER) < 128 THEN first + CAST('0x' || m[11:12] AS INTEGER) + 1 END AS valid_to FROM listed),
matched AS (
  SELECT c.page_id, s.*, row_number() OVER (PARTITION BY c.page_id ORDER BY s.level DESC, length(s.pattern) DESC) AS best
  FROM captures c JOIN spans s ON c.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to)
    AND CASE s.scope WHEN 'host' THEN c.host = s.pattern WHEN 'domain' THEN c.host = s.pattern OR c.host LIKE '%.' || s.pattern
      ELSE c.host || '/' || split_part(c.path, '/', 1) = s.pattern END)
SELECT c.page_id, c.url, CAST(c.fetched_at AS VARCHAR) AS fetched_at, c.host, CASE WHEN c.host IS NULL THEN 'invalid' ELSE coalesce(m.verdict, 'pass') END AS verdict,
  m.scope, m.pattern, CAST(m.valid_from AS VARCHAR) AS valid_from, CAST(m.valid_to AS VARCHAR) AS valid_to
FROM captures c LEFT JOIN matched m ON c.page_id = m.page_id AND m.best = 1"""


def op5_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "mixing-sizes")
    mixed = mixing.mix(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP5_SQL = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight FROM sources),
sorted AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS k,
    sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS taken,
    (SELECT sum(weight) FROM weighed) - sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS rest,
    (SELECT 1.5::DOUBLE * sum(source_size) FROM weighed) AS total FROM weighed),
rates AS (
  SELECT 0 AS k, any_value(total) / (SELECT sum(weight) FROM weighed) AS rate FROM sorted
  UNION ALL SELECT k, (total - taken) / rest FROM sorted WHERE rest > 0),
rate AS (SELECT arg_min(r.rate, r.k) AS rate FROM rates r LEFT JOIN sorted s ON s.k = r.k + 1 WHERE s.ratio IS NULL OR r.rate < s.ratio),
targets AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE * source_size, weight * (SELECT rate FROM rate)) END AS target FROM weighed),
ranked AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || size)) AS digest, length(bin(size + 1)) * 32 +
    CASE WHEN length(bin(size + 1)) > 5 THEN CAST(floor((size + 1) / pow(2.0, length(bin(size + 1)) - 5)) AS BIGINT) ELSE size + 1 END AS class FROM sized),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CAST(CAST('0x' || md5('offset:' || coalesce(r.source, ''))[1:4] AS INTEGER) AS DOUBLE) / 65536 AS u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS e,
    CAST(row_number() OVER (PARTITION BY r.source ORDER BY r.class, r.digest, r.size) AS DOUBLE) AS n
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(u + e * n) - floor(u + e * (n - 1)), 2) * size AS BIGINT) AS taken FROM placed"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality.BASE, "base_failed", "kept")


_OP6_LEVEL = ", ".join(f"len(list_filter({cuts}, lambda c: c <= {name}))" for name, cuts in quality.GRIDS.items())
OP6_SQL = rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) >= 3)),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
counted AS (
  SELECT t.doc_id, t.lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: x = '|')) AS bars, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS capitals
  FROM texts t LEFT JOIN repeats r ON t.doc_id = r.doc_id),
base AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
signals AS (
  SELECT *, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_rate, CASE WHEN len(lines) > 0 THEN n_dup_lines::DOUBLE / len(lines) ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share, CASE WHEN word_chars > 0 THEN capitals::DOUBLE / word_chars ELSE 0 END AS capital_share,
    CASE WHEN n_words > 0 THEN bars::DOUBLE / n_words ELSE 0 END AS bar_rate FROM base),
levels AS (SELECT *, greatest({_OP6_LEVEL}) AS level FROM signals),
tests AS (
  SELECT l.lang, s.step, count(*) AS n, count(*) FILTER (l.level >= s.step) AS x
  FROM levels l JOIN labels y ON l.doc_id = y.doc_id AND y.quality = 1 CROSS JOIN (SELECT unnest(range(1, 21)) AS step) s WHERE NOT l.base_failed GROUP BY ALL),
passed AS (
  SELECT t.lang, min(t.step) AS step FROM tests t
  WHERE x <= n * 0.02 AND (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.02) + (n - k) * ln(1 - 0.02))) FROM (SELECT unnest(range(0, x + 1)) AS k))
    <= 0.05 / greatest(1, (SELECT count(DISTINCT coalesce('=' || lang, '-')) FROM tests)) GROUP BY ALL)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(s.level >= p.step, false) AS kept
FROM levels s LEFT JOIN passed p ON s.lang IS NOT DISTINCT FROM p.lang"""


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.integer_components(F.col("embedding")).alias("components"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.n <> c.n WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10"""


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.spelled(table(spark, sf_dir, "documents"), 7, 31).where("n >= 2")
    return spelling.variant_groups(words, 10).select("word", "form", "root", "n", "n_near", "form_n")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
often AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT l.*, o.key IS NOT NULL AND l.doc_id <> o.keeper AS lost FROM lines l LEFT JOIN often o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_warc_dictionary_writer, op3_best_fit_packing, op4_url_filters, op5_systematic_mixing,
        op6_quality_rules, op7_exact_top_k, op8_html_main_text, op9_simhash_near_dedup, op10_toxicity_grades,
        op11_tokenizer_alignment, op12_spelling_variants, op13_line_dedup,
    )
}
SQL = {
    "op1_chat_formatting": OP1_SQL, "op2_warc_dictionary_writer": OP2_SQL, "op4_url_filters": OP4_SQL, "op5_systematic_mixing": OP5_SQL,
    "op6_quality_rules": OP6_SQL, "op7_exact_top_k": OP7_SQL, "op13_line_dedup": OP13_SQL,
}
