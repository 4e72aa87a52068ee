"""Queries of the catalog on folded groups: exact merges, layered objects, splits, gates, matches, coverage of domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekiln import catalog
from lorekiln.catalog import query
from lorekiln.catalog_knowledge import rule_detectors
from lorekiln.functions import facets
from lorekiln.functions import values as V
from lorekiln.operators import folds
from lorekiln.operators.lookup import cascade
from lorekiln.plans import tables as T

# ---------------------------------------------------------------- exact merges: the orders of customers as candidates

_EXACT = """c AS (SELECT o_orderkey AS candidate_id, o_custkey || ':' || o_orderstatus AS key, CASE o_orderpriority WHEN '1-URGENT' THEN 'L4' WHEN '2-HIGH' THEN 'l3' WHEN '3-MEDIUM' THEN 'L2' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'L1' END AS trust_level,
  o_totalprice AS confidence, o_orderkey AS ord, month(o_orderdate) AS run FROM orders),
l AS (SELECT l_orderkey, list(CASE WHEN l_returnflag = 'N' THEN '' ELSE 'c' || l_partkey END ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS chunk_ids, list(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS page_nos FROM lineitem GROUP BY 1),
r AS (SELECT *, CASE upper(trust_level) WHEN 'L4' THEN 3 WHEN 'L3' THEN 2 WHEN 'L2' THEN 1 WHEN 'L1' THEN 0 ELSE -1 END AS t, coalesce(len(chunk_ids), 0) AS n FROM c LEFT JOIN l ON l_orderkey = candidate_id),
b AS (SELECT key, arg_max(candidate_id, (t, n, confidence, -ord)) AS candidate_id, count(*) AS n_candidates, count(DISTINCT run) AS n_runs FROM r GROUP BY 1),
x AS (SELECT key, ord, unnest(chunk_ids) AS chunk_id, generate_subscripts(chunk_ids, 1) AS pos FROM r), s AS (SELECT key, chunk_id, min((ord, pos)) AS f FROM x WHERE chunk_id <> '' GROUP BY 1, 2)"""


def _exact(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    level = F.create_map(*(F.lit(x) for p in (("1-URGENT", "L4"), ("2-HIGH", "l3"), ("3-MEDIUM", "L2"), ("5-LOW", "L1")) for x in p))
    o = T.read(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return folds.exact_merge(o.select(
        F.col("o_orderkey").alias("candidate_id"), F.concat_ws(":", "o_custkey", "o_orderstatus").alias("key"), F.element_at(level, F.col("o_orderpriority")).alias("trust_level"),
        F.transform("lines", lambda x: F.when(x["l_returnflag"] == "N", "").otherwise(F.concat(F.lit("c"), x["l_partkey"]))).alias("chunk_ids"), F.transform("lines", lambda x: F.when(x["l_linestatus"] == "F", x["l_linenumber"])).alias("page_nos"),
        F.col("o_totalprice").alias("confidence"), F.lit("").alias("summary"), F.month("o_orderdate").cast("string").alias("run"), F.col("o_orderkey").alias("ord"),
    ))


@query(f"""WITH {_EXACT}, k AS (SELECT key, count(*) AS n_chunks, arg_min(chunk_id, f) AS chunk_id FROM s GROUP BY 1), p AS (SELECT key, min(pg) AS page_no FROM (SELECT key, unnest(page_nos) AS pg FROM r) GROUP BY 1)
SELECT b.key, b.candidate_id, CASE WHEN n_chunks >= 2 THEN 'L4' ELSE trust_level END AS trust_level, n_candidates, n_runs, coalesce(n_chunks, 0) AS n_chunks, chunk_id, page_no FROM b JOIN c USING (candidate_id) LEFT JOIN k ON k.key = b.key LEFT JOIN p ON p.key = b.key""")
def exact_merge(spark, sf_dir):
    return _exact(spark, sf_dir)["objects"]


@query(f"WITH {_EXACT} SELECT key, chunk_id, row_number() OVER (PARTITION BY key ORDER BY f) - 1 AS place FROM s")
def exact_merge_chunks(spark, sf_dir):
    return _exact(spark, sf_dir)["chunks"]


@query(f"WITH {_EXACT} SELECT key, r.candidate_id FROM r JOIN b USING (key) WHERE r.candidate_id <> b.candidate_id")
def exact_merge_dropped(spark, sf_dir):
    return _exact(spark, sf_dir)["dropped"]


# ---------------------------------------------------------------- layered objects: orders of customers, their lines as evidence

_AUTHORITY = {"1-URGENT": "industry_standard", "2-HIGH": "oem_manual", "3-MEDIUM": "field_observation", "4-NOT SPECIFIED": "academic_reference"}
_LEVEL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AUTHORITY.items()) + " ELSE 'unspecified' END"
_LAYERED = f"""e AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS place, 'c' || (l_partkey % 50) AS chunk_id, 'd' || l_suppkey AS doc_id, l_linenumber AS page_no FROM lineitem),
c AS (SELECT c_mktsegment AS class_id, o_orderstatus AS kind, 'n' || c_nationkey AS key, o_orderkey AS candidate_id, o_totalprice / 500000 AS confidence, CASE WHEN o_orderpriority = '5-LOW' THEN 'none' ELSE 'L' || o_orderpriority[1] END AS trust_level, {_LEVEL} AS authority_level,
  'y' || year(o_orderdate) AS publisher, coalesce(e.doc_id, 'own') AS doc_id, coalesce(e.chunk_id, '') AS chunk_id FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN e ON l_orderkey = o_orderkey AND place = 0),
ly AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY class_id, kind, key, publisher, doc_id, chunk_id ORDER BY candidate_id) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY class_id, kind, key ORDER BY candidate_id) = 1 AS is_primary FROM ly)"""


def _layered(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))).alias("lines"))
    evidence = lines.select(F.col("l_orderkey").alias("candidate_id"), F.posexplode("lines").alias("place", "l")).select(
        "candidate_id", "place", F.concat(F.lit("c"), F.col("l.l_partkey") % 50).alias("chunk_id"), F.concat(F.lit("d"), "l.l_suppkey").alias("doc_id"), F.col("l.l_linenumber").alias("page_no"), F.lit("").alias("text")
    )
    j = T.read(spark, sf_dir, "orders").join(T.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    level = F.create_map(*(F.lit(x) for p in _AUTHORITY.items() for x in p))
    candidates = j.select(
        F.col("c_mktsegment").alias("class_id"), F.col("o_orderstatus").alias("kind"), F.concat(F.lit("n"), "c_nationkey").alias("key"), F.col("o_orderkey").alias("candidate_id"), F.col("o_orderkey").alias("ord"), F.col("c_name").alias("title"),
        F.lit(None).cast("string").alias("summary"), (F.col("o_totalprice") / 500000).alias("confidence"), F.when(F.col("o_orderpriority") == "5-LOW", "none").otherwise(F.concat(F.lit("L"), F.substring("o_orderpriority", 1, 1))).alias("trust_level"),
        F.element_at(level, F.col("o_orderpriority")).alias("authority_level"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("publisher"), F.lit("own").alias("doc_id"),
    )
    return folds.merged_groups(candidates, evidence, ["class_id", "kind"])


_RANK = "CASE authority_level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.AUTHORITY_RANK.items()) + " ELSE -1 END"


@query(f"""WITH {_LAYERED} SELECT class_id, kind, key, c_name AS title, '' AS summary, nullif(arg_min(chunk_id, candidate_id), '') AS primary_chunk, max(confidence) AS confidence, coalesce(max(trust_level) FILTER (trust_level LIKE 'L%'), 'L1') AS trust_level, arg_max(authority_level, ({_RANK}, -candidate_id)) AS highest_authority,
count(*) AS n_layers, count(DISTINCT publisher) AS n_publishers, count(DISTINCT publisher) >= 2 AS cross_publisher FROM (SELECT *, first_value(candidate_id) OVER (PARTITION BY class_id, kind, key ORDER BY candidate_id) AS lead FROM ly) JOIN orders ON o_orderkey = lead JOIN customer ON c_custkey = o_custkey GROUP BY class_id, kind, key, c_name""")
def layered_objects(spark, sf_dir):
    return _layered(spark, sf_dir)["objects"]


@query(f"""WITH {_LAYERED}, a AS (SELECT *, CASE authority_level WHEN 'industry_standard' THEN CASE WHEN is_primary THEN 'primary_standard' ELSE 'corroborating_standard' END WHEN 'oem_manual' THEN CASE WHEN is_primary THEN 'primary_oem' ELSE 'corroborating_oem' END WHEN 'field_observation' THEN 'field_validation' ELSE 'unspecified' END AS authority_role FROM rk)
SELECT class_id, kind, key, candidate_id, place, e.chunk_id, e.doc_id, page_no, CASE WHEN is_primary AND place = 0 THEN 'primary_' ELSE 'supporting_' END || authority_role AS evidence_role, authority_role FROM e JOIN a ON l_orderkey = candidate_id""")
def layered_evidence(spark, sf_dir):
    return _layered(spark, sf_dir)["evidence"].drop("text")


@query("""SELECT l_partkey AS ko_id, count(*) AS n_evidence, list_sort(list(DISTINCT l_linenumber)) AS pages FROM lineitem GROUP BY 1""")
def evidence_index(spark, sf_dir):
    return folds.evidence_index(T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ko_id"), F.col("l_linenumber").alias("page_no")))


_NAMED = {"F": "max oil pressure", "O": "Min oil flow", "P": "front panel"}
_HITS = " OR ".join(f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: len(list_filter(names, lambda n: contains(lower(n), w))) > 0)) > 1" for words in facets.QUALIFIERS.values())


@query(f"""WITH r AS (SELECT o_orderkey, CASE WHEN c_acctbal > 3000 THEN 'c' || c_custkey ELSE 'n' || c_nationkey END || ':' || o_orderpriority AS key, o_custkey AS doc, CASE o_orderstatus {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMED.items())} END AS name FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT key, list(DISTINCT name) AS names, count(DISTINCT doc) AS docs FROM r GROUP BY 1)
SELECT o_orderkey, key, CASE WHEN docs = 1 AND len(names) > 1 AND ({_HITS}) THEN key || '_' || replace(lower(name), ' ', '_') ELSE key END AS refined_key FROM r JOIN g USING (key)""")
def same_document_split(spark, sf_dir):
    """Orders named by their state: of one customer where it has money, of all of a nation where it has not."""
    name = F.element_at(F.create_map(*(F.lit(x) for p in _NAMED.items() for x in p)), F.col("o_orderstatus"))
    group = F.when(F.col("c_acctbal") > 3000, F.concat(F.lit("c"), "c_custkey")).otherwise(F.concat(F.lit("n"), "c_nationkey"))
    o = T.read(spark, sf_dir, "orders").join(T.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select("o_orderkey", F.concat_ws(":", group, "o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("doc"), name.alias("name"))
    return folds.split_same_document(rows, "key", "doc", "name").select("o_orderkey", "key", "refined_key")


# ---------------------------------------------------------------- gates, matches, coverage


@query(f"""WITH {T.CHUNKS_SQL}, rd AS ({catalog.oracle_sql()["rule_detectors"]}), f AS (SELECT rd.*, c.source, c.lang, c.chunk_index, quality FROM rd JOIN chunks c USING (chunk_id) LEFT JOIN labels USING (doc_id)),
an AS (SELECT DISTINCT source, kind FROM f WHERE quality = 1), pr AS (SELECT DISTINCT lang, kind FROM f WHERE chunk_index = 1 AND lang <> 'en')
SELECT chunk_id, kind, key, confidence FROM f WHERE (source, kind) IN (FROM an) AND (lang NOT IN (SELECT lang FROM pr) OR (lang, kind) IN (FROM pr))""")
def gated_candidates(spark, sf_dir):
    """The rule candidates of chunks that their class and page type let pass: a source carries the kinds of its documents of good quality, a language other than English those of first chunks."""
    found = rule_detectors(spark, sf_dir)
    c = T.chunks(spark, sf_dir).select("chunk_id", "doc_id", F.col("source").alias("class_id"), F.col("lang").alias("page_type"), "chunk_index")
    good = T.read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    of = found.join(c, "chunk_id")
    anchors = of.join(good, "doc_id", "left_semi").select("class_id", "kind").distinct()
    profiles = of.where("chunk_index = 1 AND page_type <> 'en'").select("page_type", "kind").distinct()
    return folds.allowed(found, c.select("chunk_id", "class_id", "page_type"), anchors, profiles).select("chunk_id", "kind", "key", "confidence")


@query("""WITH d AS (SELECT o_orderkey AS doc, o_orderpriority || o_custkey AS file_name, 'p' || (o_orderkey // 2) AS path, year(o_orderdate) || '.' || month(o_orderdate) AS size_mb, sha256(o_orderkey::VARCHAR) AS h FROM orders),
r AS (SELECT l_orderkey * 10 + l_linenumber AS row, min(CASE WHEN l_returnflag = 'A' THEN '1-URGENT' || l_suppkey END) AS file_name, min('p' || l_partkey * 3) AS path, min(year(l_shipdate) || '.' || month(l_shipdate)) AS size_mb, min(sha256(l_partkey::VARCHAR)) AS h FROM lineitem GROUP BY 1),
n AS (SELECT file_name, min(doc) AS t FROM d GROUP BY 1 HAVING count(*) = 1), p AS (SELECT path, min(doc) AS t FROM d GROUP BY 1 HAVING count(*) = 1), s AS (SELECT h, min(doc) AS t FROM d GROUP BY 1 HAVING count(*) = 1),
m AS (SELECT row, coalesce(n.t, p.t, CASE WHEN r.size_mb IN (SELECT size_mb FROM d) THEN s.t END) AS t, CASE WHEN n.t IS NOT NULL THEN 'file_name' WHEN p.t IS NOT NULL THEN 'path' WHEN r.size_mb IN (SELECT size_mb FROM d) AND s.t IS NOT NULL THEN 'sha256' END AS found_by FROM r LEFT JOIN n USING (file_name) LEFT JOIN p USING (path) LEFT JOIN s USING (h)),
f AS (SELECT t, min(row) AS row FROM m WHERE t IS NOT NULL GROUP BY 1) SELECT m.row, CASE WHEN f.row IS NOT NULL THEN m.t END AS doc, CASE WHEN f.row IS NOT NULL THEN found_by END AS matched_by FROM m LEFT JOIN f ON f.t = m.t AND f.row = m.row""")
def matched_documents(spark, sf_dir):
    month = lambda c: F.concat_ws(".", F.year(c), F.month(c))
    docs = T.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc"), F.concat("o_orderpriority", "o_custkey").alias("file_name"), F.concat(F.lit("p"), F.floor(F.col("o_orderkey") / 2)).alias("path"), month("o_orderdate").alias("size_mb"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256")
    )
    # dealt by row before the texts are made
    lines = T.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), "l_returnflag", "l_suppkey", "l_partkey", "l_shipdate").repartition("row")
    rows = lines.groupBy("row").agg(
        F.min(F.when(F.col("l_returnflag") == "A", F.concat(F.lit("1-URGENT"), "l_suppkey"))).alias("file_name"), F.min(F.concat(F.lit("p"), F.col("l_partkey") * 3)).alias("path"), F.min(month("l_shipdate")).alias("size_mb"),
        F.min(F.sha2(F.col("l_partkey").cast("string"), 256)).alias("sha256"),
    )
    return folds.matched_documents(rows, docs, cascade)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderkey IS NULL THEN 'unknown_chunk' ELSE 'chain_mismatch' END AS fault FROM lineitem LEFT JOIN (SELECT o_orderkey, year(o_orderdate) AS y, o_orderstatus FROM orders WHERE o_totalprice > 20000) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR y <> year(l_shipdate) OR o_orderstatus <> l_linestatus""")
def chain_faults(spark, sf_dir):
    """Lines as entries that name their order as chunk, its year as document and its status as page."""
    entries = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", "l_partkey", F.year("l_shipdate").alias("doc"), F.col("l_linestatus").alias("page"))
    chunks = T.read(spark, sf_dir, "orders").where("o_totalprice > 20000").select(F.col("o_orderkey").alias("chunk_id"), F.year("o_orderdate").alias("doc"), F.col("o_orderstatus").alias("page"))
    return folds.chain_faults(entries, chunks, ["doc", "page"]).select(F.col("chunk_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "fault")


@query("""WITH cv AS (SELECT p_brand AS domain, p_type AS class_id, p_type || '/' || p_brand AS label, list_sort(list(DISTINCT p_size) FILTER (p_size < 8)) AS covered FROM part GROUP BY 1, 2), c2 AS (SELECT domain, class_id, label, coalesce(covered, []) AS covered, list_filter(range(1, 8)::INT[], lambda x: NOT list_contains(coalesce(covered, []), x)) AS missing FROM cv),
a AS (SELECT p_brand AS domain, p_type AS class_id, count(*) AS n FROM part GROUP BY 1, 2), d AS (SELECT p_brand AS domain, p_type AS class_id, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN len(covered) = 0 THEN 'uncovered' WHEN len(missing) > 0 THEN 'partial' ELSE 'covered' END AS status FROM c2)
SELECT s.domain, s.class_id, label, status, covered, missing, coalesce(a.n, 0) AS n_assets, coalesce(d.n, 0) AS n_documents, CASE WHEN s.class_id = 'PROMO' THEN 'all' END AS targets, CASE WHEN s.class_id = 'PROMO' THEN 'first' END AS rationale,
row_number() OVER (PARTITION BY s.domain ORDER BY status = 'covered', status = 'partial', label) - 1 AS place FROM s LEFT JOIN a USING (domain, class_id) LEFT JOIN d USING (domain, class_id)""")
def domain_assets(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    wanted = F.array(*map(F.lit, range(1, 8)))
    covered = F.array_sort(F.collect_set(F.when(F.col("p_size") < 8, F.col("p_size"))))
    coverage = p.groupBy(F.col("p_brand").alias("domain"), F.col("p_type").alias("class_id")).agg(covered.alias("covered")).select("domain", "class_id", F.concat_ws("/", "class_id", "domain").alias("label"), "covered", F.array_except(wanted, "covered").alias("missing"))
    assets = p.select(F.col("p_partkey").alias("ko_id"), F.col("p_brand").alias("domain"), F.col("p_type").alias("class_id"))
    evidence = T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ko_id"), F.col("l_suppkey").alias("doc_id"))
    documents = T.read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("doc_id"))
    priority = p.where("p_type = 'PROMO'").select(F.col("p_type").alias("class_id"), F.lit("all").alias("targets"), F.lit("first").alias("rationale")).distinct()
    return folds.domain_assets(coverage, assets, evidence, documents, priority)


@query(f"""WITH {T.CHUNKS_SQL}, c AS (SELECT *, CASE WHEN chunk_index % 2 = 0 THEN reverse(text[1:80]) ELSE '' END AS excerpt FROM chunks)
SELECT chunk_id, doc_id, chunk_index, (1 + (chunk_index - 1) // 4)::BIGINT AS page_no, coalesce(nullif(excerpt, ''), text[1:200]) AS evidence_text, source AS domain, 1.0::DOUBLE AS relevance_score FROM c WHERE (text ILIKE '%no_%' OR excerpt ILIKE '%no_%') AND source = 'src1' ORDER BY doc_id, chunk_index LIMIT 50""")
def traced_search(spark, sf_dir):
    c = T.chunks(spark, sf_dir).withColumn("excerpt", F.when(F.col("chunk_index") % 2 == 0, F.reverse(F.substring("text", 1, 80))).otherwise(""))
    pages = c.select("chunk_id", "doc_id", "chunk_index", (F.floor((F.col("chunk_index") - 1) / 4) + 1).alias("page_no"), "text", "excerpt", F.col("source").alias("domain"))
    return folds.search_traced(pages, "no_", "src1", limit=50)
