"""The queries over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekiln.functions import text as X
from lorekiln.functions import values as V
from lorekiln.operators import batch, candidates, cluster, components, dedupe, merge, rollups, rules, sections, serve
from lorekiln.plans import tables as T
from lorekiln.streaming import feedback

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _rank(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.AUTHORITY_RANK.items()) + " ELSE -1 END"


_TRUST = "CASE trust_level WHEN 'L1' THEN 0 WHEN 'L2' THEN 1 WHEN 'L3' THEN 2 WHEN 'L4' THEN 3 ELSE -1 END"
_AGREE = "CASE WHEN {a} = 0 AND {b} = 0 THEN true WHEN {a} = 0 OR {b} = 0 THEN false ELSE abs({a} - {b}) / greatest(abs({a}), abs({b})) <= 0.05 END"

# ---------------------------------------------------------------- serving


@query(f"""WITH {T.CHUNKS_SQL} SELECT chunk_id, doc_id, chunk_index, text[1:200] AS evidence_text, 1.0::DOUBLE AS relevance_score
FROM chunks WHERE text ILIKE '%then%' ORDER BY doc_id, chunk_index LIMIT 20""")
def chunk_search(spark, sf_dir):
    return serve.search_chunks(T.chunks(spark, sf_dir), "then")


@query(f"WITH {T.CONCEPTS_SQL} SELECT ko_id, trust_level FROM ko WHERE {_TRUST} >= 2")
def trust_filter(spark, sf_dir):
    return T.concepts(spark, sf_dir).where(V.least_trust(F.col("trust_level"), "L3")).select("ko_id", "trust_level")


@query(f"WITH {T.LAYERS_SQL} SELECT authority_level, count(*) AS n FROM layers WHERE {_rank('authority_level')} >= 3 GROUP BY 1")
def authority_floor(spark, sf_dir):
    return T.layers(spark, sf_dir).where(V.least_authority(F.col("authority_level"), "oem_manual")).groupBy("authority_level").agg(F.count("*").alias("n"))


@query(f"WITH {T.CONCEPTS_SQL} SELECT ko_id, brand FROM ko WHERE brand IS NULL OR brand = 'Brand#12'")
def applicability_wildcard(spark, sf_dir):
    return T.concepts(spark, sf_dir).where(serve.wildcard_equal(F.col("brand"), "Brand#12")).select("ko_id", "brand")


@query(f"""WITH {T.CONCEPTS_SQL}, hits AS (SELECT * FROM ko WHERE {_TRUST} >= 1 AND coalesce(confidence, 0) >= 0.3)
SELECT ko_id, trust_level, confidence, class_id, title, (SELECT count(*) FROM hits) AS total_count, (SELECT count(*) FROM hits) > 25 AS has_more
FROM hits ORDER BY {_TRUST} DESC, coalesce(confidence, 0) DESC, class_id, title, ko_id LIMIT 25""")
def ranked_topk_total(spark, sf_dir):
    hits = serve.filter_objects(T.concepts(spark, sf_dir), min_trust="L2", min_confidence=0.3)
    return serve.page_of_objects(hits, 25).select("ko_id", "trust_level", "confidence", "class_id", "title", "total_count", "has_more")


@query(f"""WITH {T.CONCEPTS_SQL}, page AS (SELECT * FROM ko WHERE {_TRUST} >= 3 ORDER BY coalesce(confidence, 0) DESC, class_id, title, ko_id LIMIT 40),
ev AS (SELECT l_partkey AS ko_id, l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS ord,
  'order ' || l_orderkey AS evidence_text, s_nationkey % 2 = 0 AS redistributable FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT ko_id, count(*) AS n_evidence, sum((NOT redistributable)::INT)::BIGINT AS n_restricted,
  arg_min(CASE WHEN redistributable THEN evidence_text ELSE '[restricted: document ' || doc_id || ']' END, ord) AS first_text
FROM page JOIN ev USING (ko_id) GROUP BY ko_id""")
def evidence_join_semi(spark, sf_dir):
    hits = T.concepts(spark, sf_dir).where(V.least_trust(F.col("trust_level"), "L4"))
    page = hits.orderBy(*serve.rank_objects(hits)).limit(40)
    li = T.read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    mine = li.join(F.broadcast(page.select(F.col("ko_id").alias("l_partkey"))), "l_partkey")
    evidence = mine.select(
        F.col("l_partkey").alias("ko_id"), F.col("l_suppkey").alias("doc_id"), F.row_number().over(w).alias("ord"),
        F.concat(F.lit("order "), F.col("l_orderkey")).alias("evidence_text"),
    )
    docs = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_nationkey") % 2 == 0).alias("redistributable"))
    return serve.attach_evidence(page, evidence, docs).select("ko_id", "n_evidence", "n_restricted", "first_text")


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'fr:' || source WHEN lang = 'en' THEN 'en:' || source ELSE source END AS title FROM documents")
def localized_projection(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    display = F.create_map("lang", F.concat_ws(":", "lang", "source"))
    return d.select("doc_id", serve.localized(display, F.col("source"), "fr-CA").alias("title"))


@query("""SELECT p_type AS class_id, count(*) AS n_aliases, string_agg(p_brand, ',' ORDER BY p_brand <> 'Brand#11', p_brand) AS aliases
FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY p_type""")
def explain_class_aliases(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select(F.col("p_type").alias("class_id"), F.col("p_brand").alias("alias")).distinct()
    return serve.grouped_aliases(p.withColumn("is_preferred", F.col("alias") == "Brand#11"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE 'k' END AS public_keys FROM events""")
def public_payload(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    payload = F.when(F.col("event_type") == "click", F.create_map(F.lit("_k"), "props")).otherwise(F.create_map(F.lit("k"), "props"))
    return e.select("event_id", F.array_join(F.map_keys(serve.public_payload(payload)), ",").alias("public_keys"))


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'purchase' OR json_extract(props, '$.k')::BIGINT = 7""")
def fault_code_match(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    return e.where((F.col("event_type") == "purchase") | (F.get_json_object("props", "$.k").cast("long") == 7)).select("event_id", "event_type")


@query(f"""WITH {T.CONCEPTS_SQL}, r AS (SELECT a.ko_id, b.ko_id AS related_id, row_number() OVER (PARTITION BY a.ko_id ORDER BY b.ko_id) AS step
FROM ko a JOIN ko b ON a.class_id = b.class_id AND a.ko_id <> b.ko_id) SELECT ko_id, step, related_id FROM r WHERE step <= 4""")
def related_assets(spark, sf_dir):
    return serve.related(T.concepts(spark, sf_dir)).select("ko_id", F.col("step").cast("long").alias("step"), "related_id")


# ---------------------------------------------------------------- rollups


@query(f"""WITH {T.CHUNKS_SQL}, p AS (SELECT page_id AS doc_id, count(*) AS n_pages FROM pages GROUP BY 1), c AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1)
SELECT d.doc_id, coalesce(n_pages, 0)::BIGINT AS n_pages, coalesce(n_chunks, 0)::BIGINT AS n_chunks FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN c USING (doc_id)""")
def doc_page_chunk_counts(spark, sf_dir):
    pages = T.read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return rollups.document_counts(T.read(spark, sf_dir, "documents").select("doc_id"), pages, T.chunks(spark, sf_dir))


@query("""SELECT o_custkey AS doc_id, p_type AS class_id, count(DISTINCT l_orderkey) AS n_chunks FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def anchor_counts(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc_id"))
    p = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("class_id"))
    return rollups.anchor_counts(li.join(o, "l_orderkey").join(p, "l_partkey").select("doc_id", "class_id", F.col("l_orderkey").alias("chunk_id")))


@query(f"""WITH {T.CHUNKS_SQL} SELECT doc_id, count(*) AS scanned, sum((contains(text, 'the'))::INT)::BIGINT AS matched, sum((length(text) >= 100)::INT)::BIGINT AS candidates,
round_even(avg((contains(text, 'the'))::INT::DOUBLE), 3) AS hit_rate FROM chunks GROUP BY doc_id""")
def hit_rate(spark, sf_dir):
    return rollups.hit_rate(T.chunks(spark, sf_dir), F.contains("text", F.lit("the")), F.length("text") >= 100)


@query("""SELECT o_orderpriority AS queue, sum((o_orderstatus = 'F')::INT)::BIGINT AS n_f, sum((o_orderstatus = 'O')::INT)::BIGINT AS n_o, sum((o_orderstatus = 'P')::INT)::BIGINT AS n_p, count(*) AS n_all FROM orders GROUP BY 1""")
def status_pivot(spark, sf_dir):
    return rollups.status_pivot(T.read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "queue"), "queue", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT l_returnflag AS lane, round_even(100.0 * sum((l_discount > 0.02)::INT) / count(*), 2) AS anchor_rate,
CASE WHEN round_even(100.0 * sum((l_discount > 0.02)::INT) / count(*), 2) >= 80 THEN 'PASS' ELSE 'FAIL' END AS anchor_status,
round_even(100.0 * sum((l_tax > 0.03)::INT) / count(*), 2) AS judge_rate, CASE WHEN round_even(100.0 * sum((l_tax > 0.03)::INT) / count(*), 2) >= 60 THEN 'PASS' ELSE 'FAIL' END AS judge_status
FROM lineitem GROUP BY 1""")
def gate_metrics(spark, sf_dir):
    n = F.count("*")
    anchor = rollups.gate("anchor", F.sum((F.col("l_discount") > 0.02).cast("int")), n, 80)
    judge = rollups.gate("judge", F.sum((F.col("l_tax") > 0.03).cast("int")), n, 60)
    return T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("lane")).agg(*anchor, *judge)


@query("""SELECT role AS call_site, count(*) AS calls, sum(length(text))::BIGINT AS tokens_in, sum(turn)::BIGINT AS tokens_out,
round_even((sum(length(text)) * 0.002 + sum(turn) * 0.008) / 1000, 6) AS cost FROM conversations GROUP BY 1""")
def token_cost(spark, sf_dir):
    c = T.read(spark, sf_dir, "conversations").select(F.col("role").alias("call_site"), F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return rollups.token_cost(c, "call_site", 0.002, 0.008)


@query("""WITH k AS (SELECT p_brand AS class_id, list(DISTINCT p_type) AS have FROM part GROUP BY 1)
SELECT class_id, array_to_string(list_sort(list_filter(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO'], lambda x: list_contains(have, x))), ',') AS covered,
array_to_string(list_sort(list_filter(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO'], lambda x: NOT list_contains(have, x))), ',') AS missing,
CASE WHEN len(list_filter(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO'], lambda x: list_contains(have, x))) = 0 THEN 'uncovered'
WHEN len(list_filter(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO'], lambda x: NOT list_contains(have, x))) > 0 THEN 'partial' ELSE 'covered' END AS status FROM k""")
def coverage_gap(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select(F.col("p_brand").alias("class_id"), F.col("p_type").alias("kind"))
    return rollups.coverage(p, "class_id", "kind", ["ECONOMY", "LARGE", "MEDIUM", "PROMO"])


_RUNS = ("click", "view", "purchase")


@query(f"""WITH u AS (SELECT user_id, {", ".join(f"max((event_type = '{r}')::INT) AS r{i}" for i, r in enumerate(_RUNS))} FROM events GROUP BY 1)
{" UNION ALL ".join(f"SELECT '{_RUNS[i]}' AS left_run, '{_RUNS[j]}' AS right_run, sum(r{i} * r{j})::BIGINT AS common, sum(r{i} * (1 - r{j}))::BIGINT AS left_only, sum(r{j} * (1 - r{i}))::BIGINT AS right_only FROM u" for i in range(3) for j in range(i + 1, 3))}""")
def overlap_matrix(spark, sf_dir):
    e = T.read(spark, sf_dir, "events").select("user_id", "event_type")
    return rollups.overlap_matrix(e, "event_type", "user_id", list(_RUNS))


@query("""SELECT n_name AS domain, o_orderpriority AS lane, grouping(n_name) * 2 + grouping(o_orderpriority) AS level, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY CUBE (n_name, o_orderpriority)""")
def cube_counts(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    c = T.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = T.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        o.join(c, "c_custkey").join(F.broadcast(n), "n_nationkey").cube("n_name", "o_orderpriority")
        .agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))
        .select(F.col("n_name").alias("domain"), F.col("o_orderpriority").alias("lane"), "level", "n")
    )


# ---------------------------------------------------------------- text and rules


@query(r"""SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS squeezed, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS cleaned,
md5(regexp_replace(replace(replace(replace(lower(text), '％', '%'), '（', '('), '）', ')'), '[\s ，。；、,.;:：]+', '', 'g')) AS anchor_md5 FROM documents""")
def text_clean(spark, sf_dir):
    t = F.col("text")
    return T.read(spark, sf_dir, "documents").select("doc_id", X.squeeze(t).alias("squeezed"), X.clean_page(t).alias("cleaned"), F.md5(X.anchor(t)).alias("anchor_md5"))


@query(r"""SELECT p_partkey, trim(regexp_replace(p_name, '[^a-zA-Z0-9一-鿿]+', '_', 'g'), '_') AS slug, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+')[1:6], '_') AS token_slug,
'key_' || sha1(p_brand)[1:10] AS hash_slug FROM part""")
def slugify(spark, sf_dir):
    n = F.col("p_name")
    return T.read(spark, sf_dir, "part").select("p_partkey", X.slug(n).alias("slug"), X.token_slug(n).alias("token_slug"), X.hashed_slug(F.col("p_brand")).alias("hash_slug"))


@query("SELECT p_partkey, 'ko_' || sha1(p_type || '::' || p_brand || '::' || p_name)[1:16] AS ko_id FROM part")
def stable_ids(spark, sf_dir):
    return T.read(spark, sf_dir, "part").select("p_partkey", X.stable_id("ko", F.col("p_type"), F.col("p_brand"), F.col("p_name")).alias("ko_id"))


@query("""SELECT doc_id, CASE WHEN trim(text) = '' THEN NULL WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS detected,
floor(len(regexp_extract_all(text, '[一-鿿]')) / 2 + (length(text) - len(regexp_extract_all(text, '[一-鿿]'))) / 4)::BIGINT AS tokens FROM documents""")
def lang_detect_tokens(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", X.language(F.col("text")).alias("detected"), X.token_estimate(F.col("text")).alias("tokens"))


_TRIAGE = """SELECT o_orderkey AS doc_id, (['pdf', 'docx', 'xlsx', 'txt'])[o_orderkey % 4 + 1] AS ext,
(['oem_manual', 'industry_standard', 'vendor_app_note', 'regulatory_code', 'other'])[o_custkey % 5 + 1] AS level,
(['good_text', 'partial_text', 'low_or_no_text', ''])[(o_orderkey // 7) % 4 + 1] AS quality, o_custkey % 9 AS pages, o_totalprice / 4000 AS mb FROM orders"""


@query(f"""WITH s AS ({_TRIAGE}), t AS (SELECT doc_id, CASE WHEN ext NOT IN ('pdf', 'docx', 'doc', 'xlsx') THEN 'DISCARD'
WHEN level IN ('vendor_app_note', 'vendor_training') AND (quality IN ('low_or_no_text', 'not_pdf', 'unknown', '') OR pages < 5 OR (mb > 50 AND quality = 'low_or_no_text')) THEN 'DISCARD'
WHEN level IN ('industry_standard', 'industry_standard_or_reference', 'regulatory_code') AND ext IN ('doc', 'docx') THEN 'MANUAL_REVIEW'
WHEN level IN ('industry_standard', 'industry_standard_or_reference', 'regulatory_code', 'oem_manual') AND quality IN ('good_text', 'partial_text') THEN 'KEEP_TEXT'
WHEN level IN ('industry_standard', 'industry_standard_or_reference', 'regulatory_code') AND quality = 'low_or_no_text' THEN 'NEEDS_OCR_CONVERT'
WHEN level = 'oem_manual' AND quality = 'low_or_no_text' THEN 'KEEP_VISUAL' ELSE 'MANUAL_REVIEW' END AS decision FROM s) SELECT * FROM t""")
def triage(spark, sf_dir):
    of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ext, level = of(["pdf", "docx", "xlsx", "txt"], k % 4), of(["oem_manual", "industry_standard", "vendor_app_note", "regulatory_code", "other"], c % 5)
    quality = of(["good_text", "partial_text", "low_or_no_text", ""], F.floor(k / 7) % 4)
    return T.read(spark, sf_dir, "orders").select(k.alias("doc_id"), rules.triage(ext, level, quality, c % 9, F.col("o_totalprice") / 4000).alias("decision"))


@query(f"""SELECT page_id, CASE WHEN {_any("u", rules.STANDARD_WORDS)} THEN 'industry_standard' WHEN {_any("u", rules.REGULATORY_WORDS)} OR {_any("p", rules.REGULATORY_WORDS)} THEN 'regulatory_code'
WHEN {_any("u", rules.BRANDS)} OR {_any("p", rules.BRANDS)} THEN 'oem_manual' WHEN {_any("u", rules.SOP_WORDS)} THEN 'internal_sop' WHEN {_any("u", rules.ACADEMIC_WORDS)} THEN 'academic_reference' END AS level,
list_min(list_filter([{", ".join(f"'{b}'" for b in rules.BRANDS)}], lambda b: contains(u || ' ' || p, b))) AS brand
FROM (SELECT page_id, replace(lower(url), 'en/', '') AS u, coalesce((['trane inc', NULL, 'office of the building code', '', 'york'])[page_id % 5 + 1], '') AS p FROM pages)""")
def authority_classify(spark, sf_dir):
    url = F.replace(F.lower("url"), F.lit("en/"), F.lit(""))
    publisher = F.get(F.array(F.lit("Trane Inc"), F.lit(None), F.lit("Office of the Building Code"), F.lit(""), F.lit("York")), (F.col("page_id") % 5).cast("int"))
    brand = rules.first_brand(F.concat_ws(" ", url, F.lower(F.coalesce(publisher, F.lit("")))))
    return T.read(spark, sf_dir, "pages").select("page_id", rules.authority(url, publisher).alias("level"), brand.alias("brand"))


@query(f"""SELECT doc_id, {_any("t", rules.FAULT)} AS is_fault, {_any("t", rules.PARAMETER)} AS is_parameter, {_any("t", rules.PERFORMANCE)} AS is_performance,
{_any("t", rules.MAINTENANCE)} AS is_maintenance, NOT {_any("t", rules.FAULT)} AND {_any("t", rules.APPLICATION)} AS is_application,
CASE {" ".join(f"WHEN {_any('t', w)} THEN '{k}'" for k, w in rules.TASKS.items())} ELSE 'maintenance' END AS task FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def context_flags(spark, sf_dir):
    t, none = F.lower("text"), F.lit("")
    return T.read(spark, sf_dir, "documents").select(
        "doc_id", rules.fault_context(t, none).alias("is_fault"), X.has_any(t, rules.PARAMETER).alias("is_parameter"), X.has_any(t, rules.PERFORMANCE).alias("is_performance"),
        X.has_any(t, rules.MAINTENANCE).alias("is_maintenance"), rules.application_context(t, none).alias("is_application"), X.first_category(t, rules.TASKS, "maintenance").alias("task"),
    )


def _codes(pattern: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{pattern}', 1), lambda c: lower(c)))), ',')"


def _first(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(text, '{pattern}') THEN regexp_extract(text, '{pattern}') END"


@query(f"""SELECT doc_id, {_codes(rules.FAULT_CODE)} AS fault_codes, {_codes(rules.PARAMETER_CODE)} AS parameter_codes, {_codes(rules.NUMERIC_CODE)} AS numeric_codes,
{_first(rules.VALUE_WITH_UNIT)} AS first_value, {_first(rules.PREFIXED_VALUE)} AS prefixed_value FROM (SELECT doc_id, text || ' cop ' || n_chars || ' p' || (n_chars + 100) || ' ' || n_chars || ' kW' AS text FROM documents)""")
def code_extract(spark, sf_dir):
    n = F.col("n_chars")
    d = T.read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" cop "), n, F.lit(" p"), n + 100, F.lit(" "), n, F.lit(" kW")).alias("text"))
    t = F.col("text")
    codes = lambda p: F.array_join(X.distinct_matches(t, p), ",")
    return d.select(
        "doc_id", codes(rules.FAULT_CODE).alias("fault_codes"), codes(rules.PARAMETER_CODE).alias("parameter_codes"), codes(rules.NUMERIC_CODE).alias("numeric_codes"),
        X.first_match(t, rules.VALUE_WITH_UNIT).alias("first_value"), X.first_match(t, rules.PREFIXED_VALUE).alias("prefixed_value"),
    )


@query(f"""WITH {T.CHUNKS_SQL} SELECT chunk_id, concat_ws(',', CASE WHEN (chunk_index % 10) / 10 < 0.78 OR length(trim(text)) < 40 THEN 'weak_evidence' END,
CASE WHEN doc_id % 3 = 0 OR doc_id % 7 > 4 THEN 'anchor_uncertainty' END) AS findings FROM chunks""")
def candidate_health(spark, sf_dir):
    c = T.chunks(spark, sf_dir)
    equipment = F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(1.0)
    return c.select("chunk_id", rules.candidate_findings((F.col("chunk_index") % 10) / 10, F.col("text"), equipment, F.greatest(F.lit(0), F.col("doc_id") % 7 - 4)).alias("findings"))


@query(f"""WITH {T.CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE {_any("text", ("there", "thing"))} AND {_any("text", ("ou", "ea"))} AND length(trim(text)) < 200""")
def keyword_groups(spark, sf_dir):
    c = T.chunks(spark, sf_dir)
    return c.where(rules.all_groups_match(F.col("text"), [("there", "thing"), ("ou", "ea")]) & rules.visual(F.lit("text"), F.col("text"))).select("chunk_id")


# ---------------------------------------------------------------- candidates


@query(f"""WITH {T.CHUNKS_SQL}, terms AS (SELECT * FROM (VALUES ('the thing'), ('and'), ('of the'), ('was')) v(term)),
hits AS (SELECT DISTINCT chunk_id, term FROM (SELECT chunk_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM chunks) JOIN terms ON contains(t, ' ' || term || ' ')),
s AS (SELECT *, least(0.3 + least(length(term), 24) / 36 + 0.06 * (term = 'was')::INT, 0.98) AS score FROM hits)
SELECT chunk_id, term, round_even(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 2""")
def alias_match_topk(spark, sf_dir):
    terms = spark.sql("SELECT * FROM VALUES ('the thing'), ('and'), ('of the'), ('was') AS t(term)")
    hits = candidates.containment(T.chunks(spark, sf_dir), terms)
    scored = hits.withColumn("score", V.alias_score(F.col("term"), F.col("term") == "was", F.lit(False)))
    return candidates.best_matches(scored, 2).withColumn("score", F.bround("score", 6))


@query(f"""WITH {T.CHUNKS_SQL} SELECT chunk_id, doc_id, 'fault_code' AS kind, lower(code) AS code, round_even(least(0.85 + 0.04 + 0.4 * 0.25, 0.99)::DOUBLE, 3) AS confidence,
'cand_' || sha1(chunk_id || '::fault_code::' || lower(code))[1:16] AS candidate_id
FROM (SELECT chunk_id, doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b(\\d{{2,4}})\\b', 1))) AS code FROM chunks)""")
def rule_candidates(spark, sf_dir):
    return candidates.rule_candidates(T.chunks(spark, sf_dir), rules.NUMERIC_CODE, "fault_code", 0.85, 0.04)


@query("""SELECT user_id, event_type, event_id, is_model, confidence FROM (SELECT user_id, event_type, event_id, event_id % 4 = 0 AS is_model, round_even(value, 2) AS confidence,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 4 = 0 DESC, round_even(value, 2) DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def candidate_merge(spark, sf_dir):
    e = T.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 4 == 0).alias("is_model"), F.bround("value", 2).alias("confidence"), F.col("event_id").alias("ord"))
    return candidates.merge_lanes(e, ["user_id", "event_type"]).drop("ord")


@query("""SELECT conv_id, turn, md5(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10) || chr(10))) AS context FROM conversations""")
def context_window(spark, sf_dir):
    c = T.read(spark, sf_dir, "conversations")
    return candidates.context_window(c, "conv_id", ["turn"]).select("conv_id", "turn", F.md5("context").alias("context"))


# ---------------------------------------------------------------- sections and anchors

_HEADED = "SELECT conv_id AS doc_id, turn AS page_no, CASE WHEN turn % 3 <> 1 THEN role END AS heading FROM conversations"


@query(f"""WITH p AS ({_HEADED}), o AS (SELECT *, row_number() OVER w = 1 OR (heading IS NOT NULL AND lower(heading) IS DISTINCT FROM last_value(lower(heading) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS opens
FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY page_no)::BIGINT AS section FROM o)
SELECT doc_id, section, min(page_no) AS page_start, max(page_no) AS page_end, count(*) AS n_pages, arg_min(heading, page_no) FILTER (WHERE page_no = page_no) AS title FROM s GROUP BY 1, 2""")
def page_heading_sections(spark, sf_dir):
    c = T.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.when(F.col("turn") % 3 != 1, F.col("role")).alias("heading"))
    return sections.section_ranges(sections.heading_sections(c))


_OUTLINE = "SELECT o_custkey AS doc_id, o_orderkey AS ord, (o_orderkey // 3) % 500 AS start, (1 + o_orderkey % 3)::INT AS depth FROM orders"


@query(f"""WITH o AS ({_OUTLINE}), n AS (SELECT a.doc_id, a.ord, a.start, a.depth, min(b.start) AS nxt FROM o a LEFT JOIN o b ON a.doc_id = b.doc_id AND (b.start, b.ord) > (a.start, a.ord) AND b.depth <= a.depth GROUP BY ALL)
SELECT doc_id, ord, start, depth, greatest(coalesce(nxt - 1, 500), start)::BIGINT AS page_end FROM n""")
def outline_ends(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), (F.floor(F.col("o_orderkey") / 3) % 500).alias("start"), (1 + F.col("o_orderkey") % 3).cast("int").alias("depth"))
    return sections.outline_ends(o.withColumn("last_page", F.lit(500).cast("long"))).drop("last_page")


@query(f"""WITH p AS ({_HEADED}), s AS (SELECT doc_id, page_no AS section, page_no AS page_start, page_no + 1 AS page_end FROM p WHERE page_no % 2 = 0) SELECT p.doc_id, page_no, section FROM p JOIN s ON p.doc_id = s.doc_id AND page_no BETWEEN page_start AND page_end""")
def outline_range_join(spark, sf_dir):
    c = T.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"))
    s = c.where("page_no % 2 = 0").select("doc_id", F.col("page_no").alias("section"), F.col("page_no").alias("page_start"), (F.col("page_no") + 1).alias("page_end"))
    return sections.pages_in_sections(c, s).select("doc_id", "page_no", "section")


@query("""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(regexp_replace(lower(d.text), '[\\s ，。；、,.;:：]+', '', 'g'), regexp_replace(lower(b.text), '[\\s ，。；、,.;:：]+', '', 'g')) WHERE b.text <> ''""")
def quote_anchor(spark, sf_dir):
    q = T.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return candidates.quotes_in(T.read(spark, sf_dir, "documents"), q).withColumnRenamed("quote_id", "item_id")


@query(f"""WITH {T.CHUNKS_SQL}, n AS (SELECT doc_id, chunk_index, text, lead(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS nxt FROM chunks), q AS (SELECT item_id AS quote_id, regexp_replace(lower(text), '[\\s ，。；、,.;:：]+', '', 'g') AS q FROM benchmark),
z AS (SELECT doc_id, chunk_index, regexp_replace(lower(text), '[\\s ，。；、,.;:：]+', '', 'g') AS a, regexp_replace(lower(nxt), '[\\s ，。；、,.;:：]+', '', 'g') AS b FROM n WHERE nxt IS NOT NULL)
SELECT quote_id, doc_id, chunk_index FROM z JOIN q ON contains(a || b, q) AND NOT contains(a, q) AND NOT contains(b, q)""")
def adjacent_anchor(spark, sf_dir):
    q = T.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return candidates.quotes_across(T.chunks(spark, sf_dir), q)


@query()
def token_pack(spark, sf_dir):
    c = T.chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").alias("ord"), X.token_estimate(F.col("text")).alias("tokens"), (F.length("text") < 30).alias("is_heading"))
    return sections.pack(c, 200, 80)


@query()
def greedy_sections(spark, sf_dir):
    s = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("section")).agg(F.sum("l_quantity").cast("long").alias("score"), F.count("*").alias("pages"))
    return sections.select_within(s, 12, 20)


@query(f"""WITH {T.CHUNKS_SQL} SELECT doc_id, chunk_index, rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, chunk_index) AS rn FROM chunks) WHERE rn <= 3""")
def cap_per_bucket(spark, sf_dir):
    return sections.cap_in_order(T.chunks(spark, sf_dir), ["doc_id"], [F.desc(F.length("text")), F.col("chunk_index")], 3).select("doc_id", "chunk_index", "rn")


# ---------------------------------------------------------------- duplicates


@query("""SELECT sha256(text) AS content_hash, count(*) AS n, arg_min(doc_id, (n_chars, doc_id)) AS kept, max(doc_id) AS last_key FROM documents GROUP BY 1 HAVING count(*) > 1""")
def sha_dup_groups(spark, sf_dir):
    return dedupe.hash_groups(T.read(spark, sf_dir, "documents"), "text", "doc_id", F.col("n_chars"))


@query("""SELECT p_type, p_brand, p_partkey, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_type, p_brand) AS n_rows FROM part) WHERE rn = 1""")
def exact_dedup_argmax(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    return dedupe.best_of_each(p, ["p_type", "p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_type", "p_brand", "p_partkey", "n_rows")


_WORDS = "SELECT lang, min(doc_id) AS doc_id, w FROM (SELECT doc_id, lang, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents) GROUP BY lang, w"


@query(f"""WITH d AS ({_WORDS}) SELECT a.doc_id AS a, b.doc_id AS b, round_even(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS similarity
FROM d a JOIN d b ON a.lang = b.lang AND a.doc_id < b.doc_id AND len(a.w) >= 0.6 * len(b.w) AND len(b.w) >= 0.6 * len(a.w) WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.6""")
def jaccard_pairs(spark, sf_dir):
    """Between the representatives of equal word sets, so that copies give no pairs."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))))
    d = T.read(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("w")).groupBy("lang", "w").agg(F.min("doc_id").alias("doc_id"))
    return dedupe.jaccard_pairs(d, "doc_id", "w", "lang", 0.6).withColumn("similarity", F.bround("similarity", 6))


@query()
def fuzzy_pairs(spark, sf_dir):
    """Near-equal titles or key tails of a class, by longest common blocks (the tests hold it against all pairs)."""
    p = T.read(spark, sf_dir, "part").select(F.col("p_type").alias("class_id"), F.col("p_name").alias("title")).distinct()
    p = p.select("class_id", F.concat_ws("/", "class_id", "title").alias("key"), "title", F.concat(X.token_slug(F.col("title")), F.lit("_"), F.lower("class_id")).alias("tail"))
    return dedupe.fuzzy_pairs(p, "key", "class_id", ["title", "tail"], 0.6)


@query()
def component_groups(spark, sf_dir):
    """Customers and suppliers that orders connect (SQL has no answer of acceptable size: the tests hold it against a union-find)."""
    li = T.read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey")).alias("s"))
    o = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey")).alias("c"))
    return components.components(li.join(o, "l_orderkey").select(F.col("c").alias("src"), F.col("s").alias("dst")))


# ---------------------------------------------------------------- merging


@query(f"""SELECT l_linenumber, count(*) AS n, sum(({_AGREE.format(a="l_discount", b="l_tax")})::INT)::BIGINT AS agreeing FROM lineitem GROUP BY 1""")
def values_agree(spark, sf_dir):
    ok = V.values_agree(F.col("l_discount").cast("string"), F.col("l_tax").cast("string"))
    return T.read(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("agreeing"))


_SAID = ("", "n/a", "12.5", "12,500", "about 13 mm", "50 °F", "10°C", "9.5 c", "30 psi", "2 bar", "0.2 MPa", "200kPa", "Closed", "closed ", "0", "open")


def _say(index: str) -> str:
    return f"([{', '.join(repr(x) for x in _SAID)}])[{index} + 1]"


_PARSED = r"""SELECT v, lower(trim(v)) IN ('', 'none', 'null', 'n/a', '-') AS blank, lower(trim(v)) AS low,
CASE regexp_extract(s, '^(-?\d+\.?\d*)°?([fc])$', 2) WHEN 'f' THEN (TRY_CAST(regexp_extract(s, '^(-?\d+\.?\d*)', 1) AS DOUBLE) - 32) * 5 / 9 WHEN 'c' THEN TRY_CAST(regexp_extract(s, '^(-?\d+\.?\d*)', 1) AS DOUBLE) END AS t,
TRY_CAST(regexp_extract(s, '^(\d+\.?\d*)', 1) AS DOUBLE) * CASE regexp_extract(s, '^(\d+\.?\d*)(psi|bar|mpa|kpa)$', 2) WHEN 'psi' THEN 0.0689476 WHEN 'bar' THEN 1 WHEN 'mpa' THEN 10 WHEN 'kpa' THEN 0.01 END AS p,
TRY_CAST(nullif(regexp_extract(replace(trim(v), ',', ''), '[-+]?\d+\.?\d*'), '') AS DOUBLE) AS n FROM (SELECT v, replace(lower(trim(v)), ' ', '') AS s FROM said)"""


@query(f"""WITH said AS (SELECT unnest([{", ".join(repr(x) for x in _SAID)}]) AS v), k AS ({_PARSED}), o AS (SELECT o_orderkey, {_say("o_orderkey % 16")} AS a, {_say("(o_orderkey // 16) % 16")} AS b FROM orders)
SELECT o_orderkey, CASE WHEN a.blank OR b.blank OR a.low = b.low THEN true WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN abs(a.t - b.t) / greatest(abs(a.t), abs(b.t), 1) <= 0.1
WHEN a.p IS NOT NULL AND b.p IS NOT NULL THEN abs(a.p - b.p) / greatest(abs(a.p), abs(b.p), 1) <= 0.1 WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN {_AGREE.format(a="a.n", b="b.n")} ELSE false END AS agrees
FROM o JOIN k a ON o.a = a.v JOIN k b ON o.b = b.v""")
def texts_agree(spark, sf_dir):
    """Every arm of the agreement of two stated values: blanks, equal texts, temperatures, pressures, numbers, none of these."""
    of = lambda i: F.get(F.array(*map(F.lit, _SAID)), i.cast("int"))
    k = F.col("o_orderkey")
    return T.read(spark, sf_dir, "orders").select("o_orderkey", V.values_agree(of(k % 16), of(F.floor(k / 16) % 16)).alias("agrees"))


_ORDERED = ", ".join(T.LAYER_ORDER)


@query(f"""WITH {T.LAYERS_SQL} SELECT concept_id, publisher_id, part_id, line FROM (SELECT *, row_number() OVER (PARTITION BY concept_id, publisher_id ORDER BY {_ORDERED}) AS rn FROM layers) WHERE rn = 1""")
def layer_dedupe(spark, sf_dir):
    return merge.distinct_layers(T.layers(spark, sf_dir), ["concept_id", "publisher_id"], list(T.LAYER_ORDER)).select("concept_id", "publisher_id", "part_id", "line")


_CONSENSUS = f"""WITH {T.LAYERS_SQL}, b AS (SELECT concept_id, value, first_value(value) OVER (PARTITION BY concept_id ORDER BY {_ORDERED}) AS base FROM layers),
g AS (SELECT concept_id, count(*) AS n, sum(({_AGREE.format(a="base", b="value")})::INT) AS same FROM b GROUP BY 1),
c AS (SELECT concept_id, n AS n_layers, CASE WHEN n <= 1 THEN 'single_source' WHEN same = n THEN 'agreed' WHEN n = 2 THEN 'disagreement' WHEN same > n // 2 THEN 'partial_conflict' ELSE 'disagreement' END AS state FROM g)"""


def _consensus(spark, sf_dir):
    arrays = merge.layer_arrays(T.layers(spark, sf_dir), "concept_id", list(T.LAYER_ORDER), ["value"])
    state = merge.consensus(F.transform("layers", lambda x: x["value"]), V.numbers_agree)
    return arrays.select("concept_id", F.size("layers").cast("long").alias("n_layers"), state.alias("state"))


@query(_CONSENSUS + " SELECT * FROM c")
def consensus_state(spark, sf_dir):
    return _consensus(spark, sf_dir)


@query(_CONSENSUS + " SELECT concept_id FROM c WHERE state = 'agreed' AND n_layers > 1")
def consensus_filter(spark, sf_dir):
    return _consensus(spark, sf_dir).where("state = 'agreed' AND n_layers > 1").select("concept_id")


_R = _rank("authority_level")


@query(f"""WITH {T.LAYERS_SQL}, o AS (SELECT *, {_R} AS rk, row_number() OVER (PARTITION BY concept_id ORDER BY {_ORDERED}) AS ord, line AS sample_count FROM layers),
s AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY rk DESC, ord) AS k FROM o),
y AS (SELECT a.concept_id, a.k AS ka, b.k AS kb, CASE WHEN a.publication_year > b.publication_year THEN a.value ELSE b.value END AS value, row_number() OVER (PARTITION BY a.concept_id ORDER BY a.k, b.k) AS rn
  FROM s a JOIN s b ON a.concept_id = b.concept_id AND a.k < b.k AND a.authority_level = 'oem_manual' AND b.authority_level = 'oem_manual' AND a.publisher_id = b.publisher_id AND a.publication_year <> b.publication_year),
g AS (SELECT concept_id, count(*) AS n, arg_min(value, k) AS v0, arg_min(authority_level, k) AS l0,
  arg_min(value, k) FILTER (WHERE authority_level = 'field_observation') AS vf, arg_min(sample_count, k) FILTER (WHERE authority_level = 'field_observation') AS sf,
  count(*) FILTER (WHERE authority_level = 'industry_standard') AS ns, max(publication_year) FILTER (WHERE authority_level = 'industry_standard') AS y1, min(publication_year) FILTER (WHERE authority_level = 'industry_standard') AS y0,
  arg_min(value, (-publication_year, k)) FILTER (WHERE authority_level = 'industry_standard') AS vn, arg_min(value, k) FILTER (WHERE authority_level = 'industry_standard') AS vs,
  count(*) FILTER (WHERE authority_level = 'oem_manual') AS no, arg_min(value, k) FILTER (WHERE authority_level = 'oem_manual') AS vo,
  count(*) FILTER (WHERE authority_level = 'vendor_application_note') AS nv, count(*) FILTER (WHERE authority_level = 'academic_reference') AS na,
  count(*) FILTER (WHERE rk >= 3) AS nh FROM s GROUP BY 1)
SELECT concept_id, CASE WHEN n = 1 THEN v0 WHEN sf >= 5 THEN vf WHEN ns >= 2 AND y0 < y1 THEN vn WHEN ns > 0 AND no > 0 THEN vs WHEN y.value IS NOT NULL THEN y.value WHEN no > 0 AND nv > 0 THEN vo ELSE v0 END AS value,
CASE WHEN n = 1 THEN NULL WHEN sf >= 5 THEN 'rule_1_field_observation' WHEN ns >= 2 AND y0 < y1 THEN 'rule_2_newer_standard' WHEN ns > 0 AND no > 0 THEN 'rule_3_standard_over_oem' WHEN y.value IS NOT NULL THEN 'rule_4_newer_oem'
WHEN no > 0 AND nv > 0 THEN 'rule_5_oem_over_vendor_note' WHEN na > 0 AND nh > 0 THEN 'rule_6_authority_over_academic' ELSE 'fallback_highest_rank' END AS rule
FROM g LEFT JOIN (SELECT * FROM y WHERE rn = 1) y USING (concept_id)""")
def arbitration(spark, sf_dir):
    layers = T.layers(spark, sf_dir).withColumn("sample_count", F.col("line"))
    arrays = merge.layer_arrays(layers, "concept_id", list(T.LAYER_ORDER), ["authority_level", "value", "publication_year", "sample_count"])
    numbered = F.transform("layers", lambda s, i: F.struct(
        i.alias("ord"), s["authority_level"].alias("authority_level"), s["publisher_id"].alias("publisher_id"), s["value"].alias("value"),
        s["publication_year"].alias("publication_year"), s["sample_count"].alias("sample_count")))
    got = arrays.withColumn("numbered", numbered).select("concept_id", merge.arbitrate(F.col("numbered")).alias("a"))
    return got.select("concept_id", "a.value", "a.rule")


@query(f"""WITH {T.LAYERS_SQL} SELECT concept_id, max(price) AS best_price, arg_max(authority_level, ({_R}, -line, -part_id, -publisher_id)) AS highest_authority,
arg_min(part_id, ({_ORDERED})) AS first_part, count(*) AS n_layers, count(DISTINCT publisher_id) AS n_publishers FROM layers GROUP BY 1""")
def merge_candidates(spark, sf_dir):
    return merge.merged_objects(T.layers(spark, sf_dir), "concept_id", list(T.LAYER_ORDER))


@query("""SELECT k, coalesce(n.v, o.v) AS v, CASE WHEN n.v IS NOT NULL THEN 'new' ELSE 'kept' END AS side
FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) o FULL JOIN (SELECT o_orderkey AS k, o_totalprice AS v FROM orders) n USING (k)""")
def upsert_match(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return merge.upsert(c, T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), "k")


@query("""SELECT DISTINCT p_brand, p_type FROM part WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_tax = 0 AND l_discount = 0)""")
def insert_if_new(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    there = T.read(spark, sf_dir, "lineitem").where("l_tax = 0 AND l_discount = 0").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return merge.insert_new(there, p.select("p_brand", "p_type"), ["p_brand", "p_type"])


@query("""SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def evidence_replace(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem")
    return merge.replace_evidence(li, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_extendedprice"]).select("l_partkey", "l_suppkey", "l_orderkey")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS unique_key, s.slice FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
JOIN (SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 8 THEN (row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1) // 8 ELSE 0 END::BIGINT AS slice FROM part) s USING (p_partkey)""")
def unique_keys(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return merge.sliced(merge.numbered_keys(p, "p_name", ["p_partkey"]), "p_name", ["p_partkey"], 8).select("p_partkey", "unique_key", "slice")


_OBJECTS = "SELECT p_type AS class_id, p_name AS name, p_size::DOUBLE AS value FROM part"


@query(f"""WITH o AS ({_OBJECTS}), r AS (SELECT class_id, name, value, count(*) AS n, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS w FROM o GROUP BY 1, 2, 3)
SELECT a.class_id, a.name AS name_a, b.name AS name_b, a.value AS value_a, b.value AS value_b, a.n AS n_a, b.n AS n_b FROM r a JOIN r b ON a.class_id = b.class_id AND (a.name < b.name OR (a.name = b.name AND a.value < b.value))
AND len(list_intersect(a.w, b.w)) >= 2 AND NOT ({_AGREE.format(a="a.value", b="b.value")})""")
def conflict_pairs(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select(F.col("p_type").alias("class_id"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("value"))
    return merge.conflicts(p)


# ---------------------------------------------------------------- vectors

_COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
_VEC = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"


def _pairs(spark, sf_dir, least):
    return cluster.similar_pairs(T.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", least)


@query(f"""WITH v AS ({_VEC}) SELECT a.vec_id AS a, b.vec_id AS b, round_even({_COS}, 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND {_COS} >= 0.4""")
def cosine_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, 0.4).withColumn("similarity", F.bround("similarity", 6))


@query(f"""WITH RECURSIVE v AS ({_VEC}), e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND {_COS} >= 0.4),
r(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def single_link(spark, sf_dir):
    return cluster.single_linkage(_pairs(spark, sf_dir, 0.4))


@query()
def complete_link(spark, sf_dir):
    return cluster.complete_linkage(_pairs(spark, sf_dir, 0.4))


@query("""WITH f AS (SELECT p_partkey, p_type AS c, CASE WHEN p_size % 2 = 0 THEN p_brand END AS f0, p_size % 3 AS f1 FROM part), k AS (SELECT c, count(DISTINCT f0) AS kinds, max(f0) AS one FROM f GROUP BY 1)
SELECT p_partkey, concat_ws('|', f.c, coalesce(CASE WHEN f0 IS NULL AND kinds = 1 THEN one ELSE f0 END, '?'), f1) AS facet_group FROM f JOIN k USING (c)""")
def facet_split(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("c"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("a0"), (F.col("p_size") % 3).alias("a1"))
    return cluster.split_by_facets(p, "c", ["a0", "a1"]).select("p_partkey", "facet_group")


# ---------------------------------------------------------------- sets and comparisons


@query("""SELECT user_id, CASE WHEN a AND b AND c THEN 'all' WHEN a AND NOT b AND NOT c THEN 'only_click' WHEN b AND NOT a AND NOT c THEN 'only_view' WHEN c AND NOT a AND NOT b THEN 'only_purchase' ELSE 'some' END AS overlap FROM (
SELECT user_id, bool_or(event_type = 'click') AS a, bool_or(event_type = 'view') AS b, bool_or(event_type = 'purchase') AS c FROM events GROUP BY 1) WHERE a OR b OR c""")
def three_way_overlap(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    has = lambda t: F.bool_or(F.col("event_type") == t)
    g = e.groupBy("user_id").agg(has("click").alias("a"), has("view").alias("b"), has("purchase").alias("c")).where("a OR b OR c")
    name = F.when(F.expr("a AND b AND c"), "all").when(F.expr("a AND NOT b AND NOT c"), "only_click").when(F.expr("b AND NOT a AND NOT c"), "only_view").when(F.expr("c AND NOT a AND NOT b"), "only_purchase").otherwise("some")
    return g.select("user_id", name.alias("overlap"))


@query("""SELECT d.doc_id, quality, toxic, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' ELSE 'rejected' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)""")
def verdict_join(spark, sf_dir):
    d, v = T.read(spark, sf_dir, "documents").select("doc_id"), T.read(spark, sf_dir, "labels")
    return d.join(v, "doc_id", "left").withColumn("verdict", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").otherwise("rejected"))


@query("""SELECT b.item_id, d.doc_id IS NOT NULL AS found, d.doc_id IS NOT NULL AND contains(d.text, b.text[1:120]) AS evidence_ok FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id""")
def gold_validation(spark, sf_dir):
    b, d = T.read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold")), T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    j = b.join(d, "item_id", "left")
    return j.select("item_id", F.col("text").isNotNull().alias("found"), F.coalesce(F.contains("text", F.substring("gold", 1, 120)), F.lit(False)).alias("evidence_ok"))


@query("""SELECT p_brand FROM part WHERE p_size > 40 INTERSECT SELECT p_brand FROM part WHERE p_type = 'PROMO' EXCEPT SELECT p_brand FROM part WHERE p_size = 50 AND p_type = 'LARGE'""")
def set_operations(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    return p.where("p_size > 40").select("p_brand").intersect(p.where("p_type = 'PROMO'").select("p_brand")).subtract(p.where("p_size = 50 AND p_type = 'LARGE'").select("p_brand"))


# ---------------------------------------------------------------- streams and extras


def _streamed(spark, sf_dir):
    from pyspark.sql import types as S

    schema = S.StructType([f for f in T.read(spark, sf_dir, "events").schema])
    e = feedback.event_stream(spark, sf_dir, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("event_key", F.concat_ws("|", "event_type", "user_id", F.to_date("ts").cast("string")))


@query(f"""WITH {T.FEEDBACK_SQL} SELECT event_type, count(DISTINCT event_key) AS n_keys FROM feedback GROUP BY 1""")
def feedback_dedup(spark, sf_dir):
    """Keys are once within the watermark, whose length is the longest a key can be late; counted from the files the stream wrote."""
    out, state = T.scratch(spark, "feedback"), T.scratch(spark, "feedback-state")
    feedback.run_to_end(feedback.once(_streamed(spark, sf_dir)).select("event_key", "event_type"), "append", out, state)
    return spark.read.schema("event_key string, event_type string").parquet(out).groupBy("event_type").agg(F.count("*").alias("n_keys"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    out, state = T.scratch(spark, "windows"), T.scratch(spark, "windows-state")
    out = feedback.upserted(feedback.windowed(_streamed(spark, sf_dir)), ["w", "event_type"], out, state)
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n", F.bround("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


@query("""SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'""")
def as_of_purchase(spark, sf_dir):
    """Each click with its user's last purchase, by one window over both kinds of events (beyond the reference)."""
    e = T.read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("last", F.max(bought).over(w)).where("event_type = 'click'").select("event_id", F.col("last.event_id").alias("last_purchase"))


# ---------------------------------------------------------------- batch driving


@query()
def feedback_event_ids(spark, sf_dir):
    """Version-5 UUIDs of event keys (held against Python's own in the tests)."""
    return T.feedback(spark, sf_dir).select("event_id", F.concat(F.lit("feedback:"), "event_key").alias("url")).withColumn("uuid", X.uuid5(F.col("url")))


@query("""SELECT p_type, sha1(string_agg(DISTINCT p_brand, chr(30) ORDER BY p_brand) || chr(31) || p_type)[1:16] AS inputs FROM part GROUP BY p_type""")
def input_hashes(spark, sf_dir):
    g = T.read(spark, sf_dir, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("names"))
    return g.select("p_type", X.inputs_hash(F.col("names"), F.col("p_type")).alias("inputs"))


@query("""SELECT o_orderkey, lane, place FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM (
SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'text' WHEN o_orderstatus = 'F' THEN 'visual' END AS lane FROM orders) WHERE lane IS NOT NULL)
WHERE (lane = 'text' AND place >= 10 AND place < 60) OR (lane = 'visual' AND place < 40)""")
def lane_plan(spark, sf_dir):
    specs = {"text": (F.col("o_orderpriority") == "1-URGENT", 10, 50), "visual": (F.col("o_orderstatus") == "F", 0, 40)}
    return batch.lanes(T.read(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], specs).select("o_orderkey", "lane", F.col("at").alias("place"))


@query("""SELECT DISTINCT l_partkey, unnest(range(l_linenumber, l_linenumber + l_quantity::INT % 5 + 1)) AS page_no FROM lineitem""")
def expand_pages(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem")
    s = li.select("l_partkey", F.col("l_linenumber").cast("long").alias("page_start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5).cast("long").alias("page_end"))
    return batch.expanded_pages(s, "l_partkey")


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def latest_task(spark, sf_dir):
    return batch.latest(T.read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_unprocessed(spark, sf_dir):
    return batch.unprocessed(T.read(spark, sf_dir, "documents").select("doc_id"), T.read(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT doc_id, source, used FROM (SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM documents) WHERE used < 20000""")
def token_budget(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return batch.within_budget(d, "source", ["doc_id"], "n_chars", 20000).select("doc_id", "source", "used")


@query("""SELECT p_partkey, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) // 30 AS batch FROM part""")
def batches_of_names(spark, sf_dir):
    return batch.batches(T.read(spark, sf_dir, "part").select("p_type", "p_partkey"), "p_type", ["p_partkey"], 30).select("p_partkey", "batch")


@query("""WITH e AS (SELECT p_brand, count(*) AS expected FROM part GROUP BY 1), v AS (SELECT p_brand, least(count(*), 12) AS visible FROM part WHERE p_size > 2 GROUP BY 1)
SELECT p_brand, coalesce(expected, 0) AS expected, coalesce(visible, 0) AS visible, CASE WHEN coalesce(visible, 0) >= coalesce(expected, 0) THEN 'passed' WHEN visible = 12 AND expected > 12 THEN 'passed_partial' ELSE 'failed' END AS status FROM e FULL JOIN v USING (p_brand)""")
def semantic_smoke(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    expected = p.groupBy("p_brand").agg(F.count("*").alias("expected"))
    visible = p.where("p_size > 2").groupBy("p_brand").agg(F.least(F.count("*"), F.lit(12)).alias("visible"))
    return batch.smoke_status(expected, visible, "p_brand", 12)


@query("""SELECT conv_id, string_agg(turn || '.' || length(role), ',' ORDER BY turn, length(role)) AS ordered FROM conversations GROUP BY 1""")
def dotted_sections(spark, sf_dir):
    c = T.read(spark, sf_dir, "conversations").select("conv_id", F.concat("turn", F.lit("."), F.length("role")).alias("s"))
    pairs = F.array_sort(F.collect_list(F.struct(X.dotted_order(F.col("s")).alias("k"), "s")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(pairs, lambda x: x["s"]), ",").alias("ordered"))


from lorekiln import catalog_compile, catalog_console, catalog_folds, catalog_knowledge, catalog_publish  # noqa: E402, F401  (their queries join these)
