"""The registered queries of this subpackage, one for each operator, and their SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm import (
    decontamination, exact_dedup, filter_audit, gated_lm, jaccard_join, packing, page_text, quality, ranked_search, secret_scan, sharding, toxicity, url_rules)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"

# The rules that the URL query judges by.
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query("op1_ngram_jaccard_join", rf"""
WITH RECURSIVE
words AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] FOR i IN generate_series(1, len(w) - 4)]) END AS s
  FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS rep, k, any_value(len(s)) AS n, count(*) AS copies, any_value(s) AS s FROM (SELECT *, array_to_string(list_sort(s), '|') AS k FROM sets WHERE len(s) > 0) GROUP BY k),
entries AS MATERIALIZED (SELECT rep, n, unnest(s) AS g FROM classes),
shared AS MATERIALIZED (SELECT * FROM entries WHERE g IN (SELECT g FROM entries GROUP BY g HAVING count(*) > 1)),
pairs AS MATERIALIZED (
  SELECT a.rep AS x, b.rep AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM shared a JOIN shared b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, other) AS (SELECT rep, rep FROM classes UNION SELECT r.node, e.y FROM reach r JOIN both_ways e ON e.x = r.other),
least_of AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
degrees AS (SELECT x, sum(copies) AS links FROM both_ways JOIN classes ON rep = y GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component, s.doc_id) AS component_id,
  coalesce(c.copies - 1 + coalesce(d.links, 0), 0)::BIGINT AS n_links
FROM (SELECT *, array_to_string(list_sort(s), '|') AS k FROM sets) s
LEFT JOIN classes c ON c.k = s.k AND len(s.s) > 0 LEFT JOIN least_of l ON l.node = c.rep LEFT JOIN degrees d ON d.x = c.rep
""")
def jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.ngram_jaccard_join(table(spark, folder, "documents"))


_BLANKS = r"'[\x20\x09-\x0D]'"


@query("op2_exact_dedup", rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), {_BLANKS}, '', 'g')) AS h FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS n FROM d)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
""")
def dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


@query("op3_url_filter", r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, '.' || host AS h FROM p),
v AS (
  SELECT page_id, host, path, CASE
    WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM r)
SELECT *, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM v
""")
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


@query("op4_best_fit_packing")
def pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


@query("op5_gated_lm_scores")
def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = table(spark, folder, "documents")
    scores = gated_lm.score_texts(docs, ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_quality")
def quality_grades(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, folder, "labels"))
    return quality.rate_quality(docs, model).drop("text")


_RULE_SQL = {
    "assign": ("(?i)" + secret_scan.BASE[0].pattern, 2, 8), "access": (secret_scan.BASE[1].pattern, 0, 1), "hex": (secret_scan.BASE[2].pattern, 0, 1),
    **{r.kind: (r.pattern, 0, 1) for r in secret_scan.MORE}}


def _secret_sql() -> str:
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(_RULE_SQL.items()):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT row, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0) AS s,
          list_sum(list_transform(g[:i], lambda x: length(x))) + list_sum(list_transform(m[:i], lambda x: length(x))) AS e
        FROM (SELECT row, g, m, o, unnest(generate_series(1, len(m))) AS i FROM (
          SELECT row, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS o FROM d WHERE regexp_matches(t, '{p}')))
        WHERE length(o[i]) >= {least}""")
    listed = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) {where}, '')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
spans AS (SELECT row, rank, kind, s::BIGINT AS s, e::BIGINT AS e FROM ({' UNION ALL '.join(parts)})),
told AS (SELECT row, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh,
  {listed('FILTER (rank < 3)')} AS base, {listed('')} AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (row)"""


@query("op7_secret_scan", _secret_sql())
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [count(rule.kind) for rule in secret_scan.BASE]
    base = F.filter("found", lambda s: s["rank"] < len(secret_scan.BASE))
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_text(base).cast("binary"), 256).alias("base_sha256"), secret_scan.span_text(F.col("found")).alias("spans"))


@query("op8_label_propagation_shards")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op9_toxicity")
def toxicity_grades(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_severity(docs, table(spark, folder, "labels"))
    return toxicity.severity(docs, model).drop("text")


@query("op10_template_decontamination")
def leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontamination.mark_leaks(docs, table(spark, folder, "benchmark")).drop("text")


@query("op11_filter_interaction_audit", r"""
WITH RECURSIVE
docs AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
told AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM words LEFT JOIN told USING (doc_id)),
masks AS MATERIALIZED (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM marked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT '' AS filter_order, 0 AS used UNION ALL SELECT filter_order || f, used + bit FROM orders JOIN letters ON used & bit = 0),
whole AS (SELECT filter_order FROM orders WHERE length(filter_order) = 5),
steps AS MATERIALIZED (
  SELECT w.filter_order, length(o.filter_order) + 1 AS step, o.used, l.f, l.bit
  FROM whole w JOIN orders o ON starts_with(w.filter_order, o.filter_order) AND length(o.filter_order) < 5 JOIN letters l ON l.f = substr(w.filter_order, length(o.filter_order) + 1, 1)),
counted AS MATERIALIZED (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (mask & (used | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & used = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & used > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (mask & used = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (mask & used = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
""")
def filter_audit_orders(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_page_differencing")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract_text(table(spark, folder, "pages"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op13_ball_tree_search", rf"""
WITH asked AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
sizes AS MATERIALIZED (SELECT row, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
stats AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM sizes),
tf AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY term),
impacts AS MATERIALIZED (SELECT row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nl))) AS s FROM tf JOIN weights USING (term) JOIN sizes USING (row), stats),
scores AS (SELECT item, any_value(item_id) AS item_id, row, sum(s)::BIGINT AS score FROM impacts JOIN asked USING (term) GROUP BY item, row),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores JOIN sizes USING (row) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
