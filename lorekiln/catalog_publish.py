"""Queries of the catalog on publishing: catalogs of fixtures, releases, policies, applied candidates, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekiln.catalog import query
from lorekiln.operators import applying, health, policy, publish
from lorekiln.operators.ordered import ranked
from lorekiln.plans import tables as T

_LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, l_linestatus"


def _joined(columns: list[str]) -> list:
    return [F.array_join(c, ",").alias(c) for c in columns]


# ---------------------------------------------------------------- fixtures


@query(f"""WITH e AS (SELECT 'fixture-' || l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) AS place, l_suppkey AS doc_id, s_name || ' ' || o_orderstatus AS file_name, c_mktsegment AS domain,
  CASE WHEN o_orderpriority = '5-LOW' THEN split_part('d:' || o_orderstatus, ':', 2) ELSE o_orderpriority END AS class_id, CASE WHEN l_returnflag = 'N' THEN 'fault_code' ELSE l_returnflag END AS kind, l_linenumber, l_linestatus, nullif(p_brand, 'Brand#1') AS brand, p_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
SELECT doc_id, arg_min(file_name, (path, place)) AS file_name, arg_min(domain, (path, place)) AS domain, count(DISTINCT path) AS n_fixtures, string_agg(DISTINCT class_id, ',' ORDER BY class_id) AS classes,
string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, list_sort(list(DISTINCT l_linenumber)) AS page_nos, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS page_types, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS families, count(*) AS n_entries FROM e GROUP BY 1""")
def fixture_catalog(spark, sf_dir):
    """Orders as fixtures whose lines cite suppliers as documents."""
    o = T.read(spark, sf_dir, "orders").join(T.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    li = T.read(spark, sf_dir, "lineitem").join(T.read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(T.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    low = F.col("o_orderpriority") == "5-LOW"
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("fixture-"), "l_orderkey").alias("path"), F.when(~low, F.col("o_orderpriority")).alias("class_id"), F.concat(F.lit("d:"), "o_orderstatus").alias("class_key"),
        F.struct(
            *_LINES.split(", "), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("kind"), F.col("l_suppkey").alias("doc_id"), F.concat_ws(" ", "s_name", "o_orderstatus").alias("file_name"),
            F.col("c_mktsegment").alias("domain"), F.col("l_linenumber").alias("page_no"), F.col("l_linestatus").alias("page_type"), F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.col("p_brand")).alias("brand"), F.col("p_type").alias("family"),
        ).alias("entry"),
    )
    fixtures = lines.groupBy("path", "class_id", "class_key").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    got = publish.fixture_catalog(publish.fixture_entries(fixtures))
    return got.select("doc_id", "file_name", "domain", "n_fixtures", *_joined(["classes", "kinds"]), "page_nos", *_joined(["page_types", "brands", "families"]), "n_entries")


# ---------------------------------------------------------------- releases

_RELEASES = """run AS (SELECT c_custkey AS workspace, c_nationkey AS executed_at FROM customer WHERE c_acctbal > 4000),
res AS (SELECT o_custkey AS workspace, o_orderkey AS pack, o_orderkey AS place, CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'O' THEN 'failed' ELSE 'skipped_pending' END AS status, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS error, 'apply_run' AS mode,
  CASE o_orderstatus WHEN 'F' THEN 'written' WHEN 'O' THEN 'failed: ' || o_orderpriority END AS said, NULL AS counts, o_orderstatus FROM orders WHERE o_custkey IN (SELECT workspace FROM run)
  UNION ALL SELECT o_custkey, o_orderkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'blocked_pending' ELSE 'blocked_no_accepted' END, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END, 'workspace_snapshot',
  'status ' || CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'blocked_pending' ELSE 'blocked_no_accepted' END || CASE WHEN o_orderstatus <> 'F' THEN '; ' || o_orderpriority ELSE '' END,
  'accepted ' || coalesce(a, 0) || ' / rejected ' || coalesce(r, 0) || ' / pending ' || coalesce(n, 0), o_orderstatus
  FROM orders LEFT JOIN (SELECT l_orderkey, sum((l_returnflag = 'A')::INT) AS a, sum((l_returnflag = 'R')::INT) AS r, sum((l_returnflag = 'N')::INT) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT workspace FROM run)),
en AS (SELECT l_orderkey AS pack, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, l_linestatus) AS entry_place, l_returnflag, 'k' || l_partkey AS ko_id, CASE WHEN l_linestatus = 'F' THEN p_type END AS key, CASE WHEN p_size > 20 THEN p_name ELSE '' END AS title, p_brand AS kind, CASE WHEN p_size > 10 THEN 'L' || (p_size // 13 + 1) END AS trust, l_suppkey AS doc_id
  FROM lineitem JOIN part ON l_partkey = p_partkey),
it AS (SELECT workspace, mode, place, res.pack, entry_place, CASE WHEN entry_place IS NULL THEN 'pack ' || res.pack ELSE coalesce(nullif(title, ''), key, ko_id) END AS name, CASE WHEN entry_place IS NULL THEN 'review_pack' ELSE kind END AS kind,
  CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'failed' END AS result, CASE WHEN entry_place IS NOT NULL THEN concat_ws(' · ', key, 'trust ' || trust, said) WHEN mode = 'apply_run' THEN coalesce(said, 'no entries') ELSE concat_ws('; ', counts, said) END AS note,
  ko_id, key, CASE WHEN entry_place IS NOT NULL THEN doc_id END AS doc_id, o_orderstatus AS class_id, status, error FROM res LEFT JOIN (SELECT * FROM en WHERE l_returnflag = 'A') en ON en.pack = res.pack)"""


def _releases(spark, sf_dir):
    c, o, li = (T.read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    runs = c.where("c_acctbal > 4000").select(F.col("c_custkey").alias("workspace"), F.col("c_nationkey").alias("executed_at"))
    by_status = lambda *x: F.element_at(F.create_map(*(F.lit(v) for p in zip("FOP", x) for v in p)), F.col("o_orderstatus"))
    base = [F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").alias("pack")]
    applied = o.select(*base, by_status("applied", "failed", "skipped_pending").alias("status"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("error"))
    flags = li.groupBy("l_orderkey").agg(*(F.count_if(F.col("l_returnflag") == f).alias(n) for f, n in (("A", "accepted"), ("R", "rejected"), ("N", "pending"))))
    blocker = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("blocker")
    readiness = o.join(flags, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(*base, by_status("ready", "blocked_pending", "blocked_no_accepted").alias("status"), blocker, "accepted", "rejected", "pending")
    packs = o.select(F.col("o_orderkey").alias("pack"), F.concat_ws(" ", F.lit("pack"), "o_orderkey").alias("pack_name"), F.col("o_orderstatus").alias("class_id"), F.lit(None).cast("long").alias("doc_id"))
    placed = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINES.split(", ")))).alias("lines")).select("l_orderkey", F.posexplode("lines").alias("at", "l")).select("l_orderkey", "at", "l.*")
    entries = placed.join(T.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("pack"), (F.col("at") + 1).cast("long").alias("entry_place"), F.when(F.col("l_returnflag") == "A", "accepted").otherwise("other").alias("decision"), F.concat(F.lit("k"), "l_partkey").alias("ko_id"),
        F.when(F.col("l_linestatus") == "F", F.col("p_type")).alias("key"), F.when(F.col("p_size") > 20, F.col("p_name")).otherwise("").alias("title"), F.col("p_brand").alias("kind"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("L"), F.expr("p_size div 13 + 1"))).alias("trust_level"), F.col("l_suppkey").alias("doc_id"),
    )
    prepared = c.select(F.col("c_custkey").alias("workspace"), (100 + F.col("c_nationkey")).alias("prepared_at"), F.col("c_mktsegment").alias("domain"))
    return runs, prepared, publish.release_items(runs, applied, readiness, packs, entries)


@query(f"WITH {_RELEASES} SELECT * FROM it")
def release_items(spark, sf_dir):
    return _releases(spark, sf_dir)[2]


@query(f"""WITH {_RELEASES}, r AS (SELECT workspace, mode, place, pack, status, max(result) AS result, error, count(*) AS items FROM it GROUP BY ALL),
f AS (SELECT *, CASE WHEN mode = 'apply_run' THEN status = 'failed' ELSE status LIKE 'blocked%' END AS lost, CASE WHEN error IS NULL THEN NULL WHEN mode = 'apply_run' THEN CASE WHEN status = 'failed' THEN error END ELSE pack || ': ' || error END AS fault FROM r),
g AS (SELECT workspace, mode, count(*) FILTER (result = 'success') AS n_success, count(*) FILTER (lost) AS n_failed, sum(items)::BIGINT AS n_items, count(DISTINCT pack) AS n_packs, count(fault) AS n_faults, arg_min(fault, place) AS first_fault FROM f GROUP BY 1, 2)
SELECT CASE WHEN mode = 'apply_run' THEN 'run-' || workspace || '-' || executed_at ELSE 'preview-' || workspace END AS record_id, workspace, mode, CASE WHEN mode = 'apply_run' THEN executed_at ELSE 100 + c_nationkey END AS executed_at, c_mktsegment AS domain,
CASE WHEN n_success > 0 AND n_failed = 0 THEN 'success' WHEN n_success > 0 THEN 'partial' ELSE 'failed' END AS status, n_success, n_failed, n_items, n_packs, n_faults, first_fault FROM g LEFT JOIN run USING (workspace) JOIN customer ON c_custkey = workspace""")
def release_records(spark, sf_dir):
    return publish.release_records(*_releases(spark, sf_dir))


_SEGMENTS = ("MACHINERY", "NONE SUCH", "BUILDING", "AUTOMOBILE")


@query(f"""WITH q AS (SELECT c_mktsegment AS class_id, c_custkey AS query_id, c_name AS title, n_name AS surface, list_position({list(_SEGMENTS)}, c_mktsegment) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN {_SEGMENTS})
SELECT class_id, dense_rank() OVER (ORDER BY w) - 1 AS card, row_number() OVER (PARTITION BY class_id ORDER BY surface, query_id) - 1 AS place, query_id, title, surface FROM q""")
def scenario_highlights(spark, sf_dir):
    q = T.read(spark, sf_dir, "customer").join(T.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = q.select(F.col("c_mktsegment").alias("class_id"), F.col("c_custkey").alias("query_id"), F.col("c_name").alias("title"), F.col("n_name").alias("surface"))
    return publish.scenario_cards(named, list(_SEGMENTS), ["surface", "query_id"])[1].select("class_id", "card", "place", "query_id", "title", "surface")


@query("""WITH s AS (SELECT o_custkey AS run, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT user_id AS run, count(*) AS n, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY 1)
SELECT c_custkey AS run, coalesce(s.n, 0) AS n_sources, coalesce(r.n, 0) AS n_results, coalesce(f, 0) AS n_failed, CASE WHEN f > 0 THEN 'has_failed_results' ELSE '' END AS flags FROM customer LEFT JOIN s ON s.run = c_custkey LEFT JOIN r ON r.run = c_custkey""")
def audit_packets(spark, sf_dir):
    results = T.read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", "failed").otherwise("applied").alias("status"))
    sources = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"))
    return publish.audit_packets(T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run")), sources, results)


@query("""SELECT l_suppkey AS section, count(*) AS raw, count(*) FILTER (l_linestatus = 'F') AS anchor_passed, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A') AS verified, count(*) FILTER (l_returnflag = 'A' AND l_discount >= 0.08) AS top_level,
count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A') <= 95 AS low_output FROM lineitem GROUP BY 1""")
def section_report(spark, sf_dir):
    f, a = F.col("l_linestatus") == "F", F.col("l_returnflag") == "A"
    return publish.section_report(T.read(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "section"), "section", f & a, f, a & (F.col("l_discount") >= 0.08), 95)


# ---------------------------------------------------------------- sources and policies

_ROUTES = {
    "view": ("audit_methodology", None, True, None), "click": ("system_design", "x", True, "mixed"), "signup": (None, "cross_domain_sustainability_guide", False, "pump"), "error": ("sustainability_topic", "methodology_guide", True, " "),
    "purchase": ("other", "", None, None),
}


@query("""WITH r AS (SELECT user_id AS doc_id, arg_min(event_type, (ts, event_id)) AS e FROM events GROUP BY 1),
t AS (SELECT o_orderkey AS doc_id, o_custkey || CASE WHEN o_orderstatus = 'P' THEN ' design' ELSE '' END AS name, floor(o_totalprice / 600)::INT AS pages, o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN 'chiller' ELSE o_orderpriority END AS class_id, e FROM orders LEFT JOIN r ON r.doc_id = o_orderkey),
p AS (SELECT *, CASE WHEN contains(name, '211') THEN 's' WHEN pages >= 450 THEN 'l' ELSE 'o' END AS k, coalesce(e IN ('view', 'error'), false) AS method, coalesce(e = 'signup', false) AS topic, coalesce(e = 'click', false) AS sys FROM t),
a AS (SELECT doc_id, class_id, CASE WHEN method THEN 'deepseek-v4-pro' WHEN topic THEN 'mimo-v2-omni' WHEN k = 's' THEN 'deepseek-v4-pro' WHEN k = 'l' THEN 'mimo-v2-omni' ELSE 'deepseek-parameter-spec' END AS backend, 15 AS candidates, CASE WHEN k = 'o' THEN 16 ELSE 18 END AS max_pages,
  CASE WHEN method THEN 5 WHEN topic OR sys THEN 4 ELSE 3 END AS max_sections, CASE WHEN method THEN 'medium' ELSE 'high' END AS min_confidence, CASE WHEN topic THEN 'pump' WHEN method OR sys THEN 'general_hvac' ELSE 'chiller' END AS anchor,
  CASE WHEN topic THEN 'llm_document_route:cross_domain_sustainability_guide' WHEN method THEN 'llm_methodology_route_default' WHEN sys THEN 'llm_document_route:system_design' WHEN k = 's' THEN 'small_standard_guidance_default'
    WHEN contains(name, 'design') THEN 'design_manual_general_hvac_default' WHEN pages >= 450 THEN 'large_handbook_general_hvac_default' ELSE 'fallback_general_hvac_standard' END AS reason FROM p)
SELECT doc_id, backend, candidates, max_pages, max_sections, min_confidence, anchor, reason, class_id <> anchor AS needs_override FROM a""")
def standard_policies(spark, sf_dir):
    """Orders as documents to read, routed by the first event of the user of that number."""
    e = T.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("e"))
    pick = lambda i, t: F.coalesce(*(F.when(F.col("e") == k, F.lit(v[i])) for k, v in _ROUTES.items())).cast(t)
    routes = e.select("doc_id", *(pick(i, t).alias(n) for i, (n, t) in enumerate((("lane", "string"), ("family", "string"), ("run_equipment", "boolean"), ("route_anchor", "string")))))
    tasks = T.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat("o_custkey", F.when(F.col("o_orderstatus") == "P", " design").otherwise("")).alias("name"), F.floor(F.col("o_totalprice") / 600).cast("int").alias("pages"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "chiller").otherwise(F.col("o_orderpriority")).alias("class_id"),
    )
    return policy.standard_policies(tasks, routes).drop("kinds")


@query(r"""WITH p AS (SELECT page_id, url AS path, regexp_replace(url, '^.*/', '') AS name, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages), s AS (SELECT *, regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS stem FROM p),
c AS (SELECT page_id, host, path, regexp_matches(name, '(?i)\(\d+\)| copy|副本')::INT AS copied, (NOT (regexp_matches(name, '^[a-z0-9_.+\- ]+$') OR regexp_matches(stem, '[a-z]+_[a-z0-9_]+')))::INT AS odd FROM s)
SELECT page_id, host, copied, odd, row_number() OVER (PARTITION BY host ORDER BY copied, odd, length(path), lower(path), path, page_id) - 1 AS place FROM c""")
def canonical_order(spark, sf_dir):
    """The pages of each host, best path first."""
    p = T.read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), "url", policy.canonical_score(F.col("url")).alias("score"))
    return ranked(p, ["host"], ["score", "url", "page_id"], "place").select("page_id", "host", "score.copied", "score.odd", "place")


@query("""SELECT p_partkey, coalesce(p_type = 'PROMO', false) OR s_name IS NOT NULL OR starts_with(p_name, 'blue') AS standard FROM part LEFT JOIN supplier ON s_suppkey = p_partkey AND s_acctbal > 0""")
def standard_rows(spark, sf_dir):
    s = T.read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("p_partkey"), F.lit("PROMO").alias("source_standard"))
    j = T.read(spark, sf_dir, "part").join(s, "p_partkey", "left")
    return j.select("p_partkey", policy.is_standard(F.col("p_type"), F.col("source_standard"), F.col("p_name"), "PROMO", "blue").alias("standard"))


# ---------------------------------------------------------------- applying


@query("""WITH r AS (SELECT l_orderkey AS ko_id, CASE WHEN l_linestatus = 'F' THEN 'img-' || l_partkey WHEN l_returnflag <> 'N' THEN 'old-' || l_suppkey ELSE '' END AS image, CASE WHEN l_returnflag = 'R' THEN 'detail' ELSE 'primary_visual' END AS role, coalesce(s_name, '') AS doc_id, l_linenumber::BIGINT AS page_no, CASE WHEN l_discount > 0.05 THEN l_shipdate::DATE::VARCHAR ELSE 'm' END AS model
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey)
SELECT 'vev_' || sha1(ko_id || ':' || image || ':' || role)[1:14] AS evidence_id, ko_id, image AS page_image_id, role, min((doc_id, page_no, model))[1] AS doc_id, '' AS page_id, min((doc_id, page_no, model))[2] AS page_no, min((doc_id, page_no, model))[3] AS model FROM r WHERE image <> '' GROUP BY ko_id, image, role""")
def visual_anchor_rows(spark, sf_dir):
    s = T.read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("doc_id"))
    refs = T.read(spark, sf_dir, "lineitem").join(s, "l_suppkey", "left").select(
        F.col("l_orderkey").alias("ko_id"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("img-"), "l_partkey")).otherwise("").alias("page_image_id"), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("old-"), "l_suppkey")).alias("visual_evidence_id"),
        "doc_id", F.lit(None).cast("string").alias("page_id"), F.col("l_linenumber").alias("page_no"), F.when(F.col("l_returnflag") == "R", "detail").alias("role"), F.when(F.col("l_discount") > 0.05, F.to_date("l_shipdate").cast("string")).alias("model"),
    )
    return applying.visual_rows(refs, model="m")


@query("""WITH li AS (SELECT l_orderkey, string_agg(l_linenumber || '-' || l_partkey || '-' || l_linestatus, ',' ORDER BY l_linenumber, l_partkey, l_linestatus) AS ev, count(*) AS n, arg_min(p_type || '/' || p_brand, (l_linenumber, l_partkey, l_linestatus)) AS layer FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey AS candidate_id, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'key' || o_custkey END AS title, CASE WHEN o_totalprice > 200000 THEN o_totalprice / 1000000 ELSE 0.85 END AS confidence, coalesce(split_part(layer, '/', 1), 'unspecified') AS authority_level, coalesce(split_part(layer, '/', 2), 'p' || o_custkey) AS publisher,
CASE WHEN c_custkey IS NOT NULL THEN '0-' || o_custkey || '-primary' WHEN n > 0 THEN ev WHEN o_orderstatus = 'F' THEN '7-' || o_orderkey || '-own' ELSE '' END AS evidence FROM orders LEFT JOIN li ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON c_custkey = o_custkey""")
def merger_rows(spark, sf_dir):
    blank = F.lit(None).cast("string")
    ev = lambda chunk, page, role: F.struct(chunk.cast("string").alias("chunk_id"), blank.alias("doc_id"), blank.alias("page_id"), page.alias("page_no"), blank.alias("text"), role.alias("role"))
    line = F.struct("l_linenumber", "l_partkey", "l_linestatus", "p_type", "p_brand")
    lines = T.read(spark, sf_dir, "lineitem").join(T.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    c = T.read(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    j = T.read(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = j.select(
        F.col("o_orderkey").alias("candidate_id"), F.concat(F.lit("key"), "o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise("").alias("title"), blank.alias("summary"), blank.alias("payload"), blank.alias("draft"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice") / 1000000).otherwise(0.0).alias("confidence"), blank.alias("trust_level"), F.concat(F.lit("p"), "o_custkey").alias("publisher"),
        F.transform("lines", lambda x: F.struct(x["p_type"].alias("authority_level"), x["p_brand"].alias("publisher"), blank.alias("citation"))).alias("layers"),
        ev(F.col("c_custkey"), F.lit(0), blank).alias("chain"), F.transform("lines", lambda x: ev(x["l_partkey"], x["l_linenumber"], x["l_linestatus"])).alias("evidence"),
        ev(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), F.lit(7), F.lit("own")).alias("own"),
    )
    flat = F.array_join(F.transform("evidence", lambda e: F.concat_ws("-", e["page_no"].cast("string"), e["chunk_id"], e["role"])), ",")
    return applying.merger_rows(rows).select("candidate_id", "title", "confidence", "authority_level", "publisher", flat.alias("evidence"))


@query("""WITH l AS (SELECT l_orderkey, arg_max(l_shipdate, (l_shipdate, l_linenumber))::VARCHAR AS level FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND level IS NOT NULL THEN level ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'P' AND level IS NOT NULL THEN 'single_source' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus = 'P' AND level IS NOT NULL AS changed FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def conditional_update(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("string").alias("o_orderpriority"), F.lit("single_source").alias("o_orderstatus"))
    o = T.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return applying.updated(o, li, "o_orderkey", ["o_orderpriority", "o_orderstatus"], F.col("o_orderstatus") == "P")


@query("""SELECT l_partkey AS ko_id, l_suppkey AS doc_id, l_orderkey, l_linenumber, s_name AS file_name, s_nationkey AS publisher FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_size < 20)""")
def evidence_documents(spark, sf_dir):
    d = T.read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("file_name"), F.col("s_nationkey").alias("publisher"))
    e = T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ko_id"), F.col("l_suppkey").alias("doc_id"), "l_orderkey", "l_linenumber")
    return applying.evidence_of(T.read(spark, sf_dir, "part").where("p_type = 'PROMO' OR p_size < 20").select(F.col("p_partkey").alias("ko_id")), e, d)


@query("""WITH w AS (SELECT DISTINCT p_partkey::VARCHAR AS prefix FROM part UNION SELECT c_mktsegment FROM customer), f AS (SELECT DISTINCT o_orderkey::VARCHAR AS s FROM orders WHERE o_orderstatus = 'F')
SELECT prefix, count(s) AS n_sections, count(s) > 0 AS covered FROM w LEFT JOIN f ON starts_with(s, prefix) GROUP BY 1""")
def requested_sections(spark, sf_dir):
    wanted = T.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("prefix")).union(T.read(spark, sf_dir, "customer").select("c_mktsegment"))
    found = T.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("section_id"))
    return applying.requested_covered(wanted, found)


@query("""WITH t AS (SELECT * FROM (SELECT l_discount AS confidence, l_orderkey AS doc_id, l_linenumber AS page_no, l_partkey AS chunk_index, l_returnflag AS method FROM lineitem) ORDER BY confidence DESC, doc_id, page_no, chunk_index LIMIT 300)
SELECT doc_id, count(*) AS n, count(DISTINCT chunk_index) AS n_chunks, string_agg(DISTINCT CASE WHEN method = 'N' THEN 'unknown' ELSE method END, ',' ORDER BY CASE WHEN method = 'N' THEN 'unknown' ELSE method END) AS methods FROM t GROUP BY 1""")
def candidate_report(spark, sf_dir):
    """The 300 surest candidates, by document."""
    e = T.read(spark, sf_dir, "lineitem").select(
        F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.col("l_partkey").alias("chunk_index"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("method")
    )
    return applying.page_summary(e, 300)


@query("""WITH p AS (SELECT l_orderkey AS pack, count(*) FILTER (l_returnflag = 'N') AS pending, count(*) FILTER (l_returnflag = 'A') AS accepted FROM lineitem GROUP BY 1)
SELECT pack, CASE WHEN pending > 0 THEN 'skipped_pending' WHEN accepted = 0 THEN 'skipped_no_accepted' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'applied' END AS state FROM p LEFT JOIN orders ON o_orderkey = pack""")
def apply_states(spark, sf_dir):
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    p = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pack")).agg(n("N").alias("pending"), n("A").alias("accepted"))
    o = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack"), F.when(F.col("o_orderstatus") == "O", "fault").alias("error"))
    return p.join(o, "pack", "left").select("pack", applying.apply_state(F.col("pending"), F.col("accepted"), F.col("error")).alias("state"))


# ---------------------------------------------------------------- health

_NAMES = ("that", "with", "from", "The", "les", "der")


@query(f"""WITH {T.CHUNKS_SQL}, o AS (SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0), f AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS n FROM chunks WHERE doc_id IN (FROM o))
SELECT doc_id AS ko_id, string_agg(DISTINCT n, ',' ORDER BY n) AS brands FROM f WHERE lower(n) IN {tuple(x.lower() for x in _NAMES)} GROUP BY 1""")
def ambiguous_objects(spark, sf_dir):
    """Documents as objects whose label gives no quality, with words in place of brands."""
    objects = T.read(spark, sf_dir, "documents").select("doc_id").join(T.read(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("ko_id"), F.when(F.col("quality") == 1, "known").alias("brand"), F.lit(None).cast("string").alias("model"))
    return health.ambiguous(objects, T.chunks(spark, sf_dir).select(F.col("doc_id").alias("ko_id"), "text"), _NAMES).withColumn("brands", F.array_join("brands", ","))


@query(f"""WITH {T.CHUNKS_SQL}, o AS (SELECT doc_id, string_agg(DISTINCT event_type, '_') || '_' || any_value(lang) || any_value(source) AS class_id, list_sort(list_distinct(regexp_extract_all(lower(string_agg(DISTINCT event_type, '_') || '_' || any_value(lang) || any_value(source)), '[a-z0-9]+'))) AS tokens FROM documents JOIN events ON user_id = doc_id GROUP BY 1),
h AS (SELECT doc_id, unnest(list_filter(tokens, lambda t: contains(lower(text), t))) AS hit FROM chunks JOIN o USING (doc_id)), g AS (SELECT doc_id, list_sort(list(DISTINCT hit)) AS found FROM h GROUP BY 1)
SELECT doc_id AS ko_id, array_to_string(coalesce(found, []), ',') AS found, array_to_string(list_filter(tokens, lambda t: NOT list_contains(coalesce(found, []), t)), ',') AS missing, round_even(len(coalesce(found, [])) / len(tokens), 3) AS ratio
FROM o LEFT JOIN g USING (doc_id) WHERE len(coalesce(found, [])) / len(tokens) < 0.3 AND doc_id IN (SELECT doc_id FROM chunks)""")
def weak_anchors(spark, sf_dir):
    """Documents as objects of a class that is named by the kinds of their user's events."""
    e = T.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), "_").alias("kinds"))
    objects = T.read(spark, sf_dir, "documents").join(e, "doc_id").select(F.col("doc_id").alias("ko_id"), F.concat("kinds", F.lit("_"), "lang", "source").alias("class_id"))
    got = health.weak_anchors(objects, T.chunks(spark, sf_dir).select(F.col("doc_id").alias("ko_id"), "text"))
    return got.select("ko_id", *_joined(["found", "missing"]), "ratio")
