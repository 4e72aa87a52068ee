"""Queries of the catalog on compiling: chunks of pages, model answers, keyword rules, grouped names, a merge that writes, keys, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekiln.catalog import query
from lorekiln.functions import headings
from lorekiln.operators import answers, candidates, facet_rules, fixtures, grouping, merge, merge_store, sections
from lorekiln.operators.ordered import ranked
from lorekiln.plans import tables as T

# ---------------------------------------------------------------- chunks

_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS para, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pno FROM documents),
s AS (SELECT doc_id, pno, para, CASE WHEN length(para) > 1000 THEN string_split(para, '. ') END AS ss FROM p),
f(doc_id, pno, ss, i, held, out) AS (
  SELECT doc_id, pno, ss, 0, '', []::VARCHAR[] FROM s WHERE ss IS NOT NULL
  UNION ALL
  SELECT doc_id, pno, ss, i + 1, CASE WHEN length(held) + length(ss[i + 1]) <= 1000 THEN held || ss[i + 1] || '. ' ELSE ss[i + 1] || '. ' END,
    CASE WHEN length(held) + length(ss[i + 1]) <= 1000 OR held = '' THEN out ELSE list_append(out, trim(held, {_WS})) END FROM f WHERE i < len(ss)),
o AS (SELECT doc_id, pno, [para] AS c FROM s WHERE ss IS NULL UNION ALL SELECT doc_id, pno, list_append(out, trim(held, {_WS})) FROM f WHERE i = len(ss)),
a AS (SELECT doc_id, flatten(list(c ORDER BY pno)) AS c FROM o GROUP BY 1),
u AS (SELECT doc_id, unnest(c) AS text, generate_subscripts(c, 1) - 1 AS chunk_index FROM a)
SELECT doc_id, chunk_index::BIGINT AS chunk_index, text, text[1:200] AS excerpt FROM u WHERE trim(text, {_WS}) <> ''""")
def page_chunks(spark, sf_dir):
    return sections.page_chunks(T.read(spark, sf_dir, "documents"), ["doc_id"])


# ---------------------------------------------------------------- model answers

#: What a model may wrap its JSON in; the payload is that of the event.
_SHAPES = {
    "view": '{"candidates": [{"knowledge_object_type": "fault_code", "canonical_key_candidate": " k~ ", "structured_payload_candidate": @, "confidence_score": 0.~}]}',
    "click": '```json\n{"candidates": [{"knowledge_object_type": "parameter_spec", "canonical_key_candidate": "k~", "structured_payload_candidate": @,}, {"knowledge_object_type": "other"}, 7,],}\n```',
    "signup": 'Here it is: {"candidates": [{"knowledge_object_type": "fault_code", "canonical_key_candidate": "", "structured_payload_candidate": @}, {"knowledge_object_type": "fault_code", "canonical_key_candidate": "k~", "structured_payload_candidate": "@"}]} as asked',
    "error": '{"candidates": [@',
    "purchase": '[@]',
}
_ALLOWED = ["fault_code", "parameter_spec"]
_K = "(props::JSON->>'$.k')"


@query(f"""WITH e AS (SELECT event_id, event_type, {_K} AS k FROM events)
SELECT event_id, 0 AS pos, 'fault_code' AS kind, 'k' || k AS key, '{{"k":' || k || '}}' AS payload, round_even(least(('0.' || k)::DOUBLE, 0.95), 3) AS confidence, 'llm draft from constrained chunk window' AS rationale, NULL AS fault FROM e WHERE event_type = 'view'
UNION ALL SELECT event_id, 0, 'parameter_spec', 'k' || k, '{{"k":' || k || '}}', 0.72, 'llm draft from constrained chunk window', NULL FROM e WHERE event_type = 'click'
UNION ALL SELECT event_id, 1, NULL, NULL, NULL, NULL, NULL, 'kind' FROM e WHERE event_type = 'click'
UNION ALL SELECT event_id, 2, NULL, NULL, NULL, NULL, NULL, 'no object' FROM e WHERE event_type = 'click'
UNION ALL SELECT event_id, 0, NULL, NULL, NULL, NULL, NULL, 'key' FROM e WHERE event_type = 'signup'
UNION ALL SELECT event_id, 1, NULL, NULL, NULL, NULL, NULL, 'payload' FROM e WHERE event_type = 'signup'
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, 'malformed' FROM e WHERE event_type = 'error'
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, 'no object' FROM e WHERE event_type = 'purchase'""")
def answer_candidates(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    k, shape = F.get_json_object("props", "$.k"), F.lit(None).cast("string")
    for kind, text in _SHAPES.items():
        # a payload inside a string is quoted there, so that it is no object
        body = F.when(F.col("event_type") == "signup", F.replace(F.lit(text), F.lit('"@"'), F.lit('"text"'))).otherwise(F.lit(text))
        shape = F.when(F.col("event_type") == kind, F.replace(F.replace(body, F.lit("@"), F.col("props")), F.lit("~"), k)).otherwise(shape)
    return answers.candidate_rows(e.select("event_id", shape.alias("content")), _ALLOWED)


# ---------------------------------------------------------------- keyword rules

_RULES = """w AS (SELECT DISTINCT item_id AS value, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS keyword FROM benchmark),
r AS (SELECT CASE WHEN length(keyword) > 9 THEN 'reference_point' WHEN length(keyword) > 8 THEN 'subsystem' ELSE 'condition' END AS axis, value, keyword FROM w),
p AS (SELECT axis, value, keyword, max(length(keyword)) OVER (PARTITION BY axis, value) AS longest FROM r)"""


def _rules(spark, sf_dir):
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))).alias("keyword")
    w = T.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("value"), words)
    n = F.length("keyword")
    return w.withColumns({"axis": F.when(n > 9, "reference_point").when(n > 8, "subsystem").otherwise("condition"), "ord": F.col("value")})


@query(f"""WITH {_RULES}, d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, axis, arg_min(value, (-longest, value)) AS value FROM d JOIN p ON contains(t, keyword) GROUP BY 1, 2""")
def rule_facets(spark, sf_dir):
    """The facets of every document by a table of rules, one for each word of the benchmark's items."""
    return facet_rules.facets(T.read(spark, sf_dir, "documents"), _rules(spark, sf_dir), "doc_id")


@query(f"""WITH {_RULES}, d AS (SELECT doc_id, lower(text) AS t FROM documents),
f AS (SELECT doc_id, axis, arg_min(value, (-longest, value)) AS value FROM d JOIN p ON contains(t, keyword) GROUP BY 1, 2)
SELECT doc_id, max(value) FILTER (axis = 'reference_point') AS reference_point, max(value) FILTER (axis = 'subsystem') AS subsystem, max(value) FILTER (axis = 'condition') AS condition
FROM documents LEFT JOIN f USING (doc_id) GROUP BY 1""")
def facet_signature(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    return facet_rules.signature(d, _rules(spark, sf_dir), "doc_id", ["reference_point", "subsystem", "condition"]).drop("text")


# ---------------------------------------------------------------- names under keys


@query()
def grouped_names(spark, sf_dir):
    """The parts' names as vectors under keys: no SQL, for linkage goes by the order of names; the tests hold it against a plain version."""
    e, p = T.read(spark, sf_dir, "embeddings"), T.read(spark, sf_dir, "part")
    names = e.join(p, F.col("vec_id") == F.col("p_partkey")).select(
        F.col("label").alias("class_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.col("embedding").alias("vector"), F.col("p_type").alias("quantity"), F.split("p_name", " ")[1].alias("subtype")
    )
    aliases = p.select(F.concat_ws(" ", "p_name", "p_partkey").alias("alias"), F.concat_ws("_", F.lower("p_brand"), "p_size").alias("key")).where("p_size < 10")
    return grouping.named_groups(names, aliases, ["quantity", "subtype"], subtype="subtype", prefix=F.concat(F.lit("domain:"), F.col("class_id").cast("string"), F.lit(":ps:")))


# ---------------------------------------------------------------- a merge that writes

_KIND = "string_split(p_name, ' ')[2]"
_STORE = f"""p AS (SELECT p_partkey, p_type AS class_id, {_KIND} AS kind, p_name AS name, p_brand, p_retailprice FROM part),
g0 AS (SELECT class_id, kind, name, min(p_brand) AS brand FROM p GROUP BY ALL), m AS (SELECT class_id, kind, class_id || ':' || kind || ':' || brand AS key, name FROM g0),
g AS (SELECT class_id, kind, key, min(p.name) AS title, CASE WHEN count(DISTINCT p_brand) > 12 THEN 'material_conflict' ELSE 'agreed' END AS state, round_even(max(p_retailprice) / 3000, 4) AS confidence FROM p JOIN m USING (class_id, kind, name) GROUP BY 1, 2, 3),
ne AS (SELECT DISTINCT class_id, kind, key, l_orderkey AS chunk_id, l_linestatus AS role FROM lineitem JOIN p ON l_partkey = p_partkey JOIN m USING (class_id, kind, name)),
h AS (SELECT p.*, l_orderkey, l_linenumber, l_linestatus FROM lineitem JOIN p ON l_partkey = p_partkey WHERE l_quantity >= 49 AND l_returnflag = 'R'),
o AS (SELECT class_id, kind, name, 'k' || min(p_partkey) AS ko_id, class_id || ':' || kind || ':' || min(p_brand) AS key, min(p_retailprice) / 30000 AS confidence FROM h GROUP BY 1, 2, 3),
oe AS (SELECT DISTINCT 'e' || l_orderkey || '-' || l_linenumber AS evidence_id, ko_id, l_orderkey AS chunk_id, l_linestatus AS role FROM h JOIN o USING (class_id, kind, name)),
owner AS (SELECT class_id, kind, name, max(ko_id) AS ko_id FROM o GROUP BY ALL), hn AS (SELECT ko_id, min(m.key) AS h FROM m JOIN owner USING (class_id, kind, name) GROUP BY 1),
c0 AS (SELECT o.class_id, o.kind, ko_id, h, g.key AS gk FROM o LEFT JOIN hn USING (ko_id) LEFT JOIN g ON g.class_id = o.class_id AND g.kind = o.kind AND g.key = o.key),
c AS (SELECT class_id, kind, ko_id, gk IS NOT NULL AND (h IS NULL OR gk < h) AS taken, CASE WHEN gk IS NOT NULL AND (h IS NULL OR gk < h) THEN gk ELSE h END AS key FROM c0 WHERE h IS NOT NULL OR gk IS NOT NULL),
t0 AS (SELECT class_id, kind, key, list(ko_id ORDER BY taken, ko_id) AS ids, count(*) FILTER (NOT taken) AS named FROM c GROUP BY 1, 2, 3),
t AS (SELECT class_id, kind, key, coalesce(ids[1], 'ko_' || sha1(class_id || '::' || kind || '::' || key)[1:16]) AS ko_id, coalesce(ids[2:], []) AS removed,
  CASE WHEN coalesce(named, 0) >= 2 THEN 'merged_existing' WHEN named = 1 THEN 'updated_existing' WHEN ids IS NOT NULL THEN 'adopted_key' ELSE 'new_merged' END AS action FROM g LEFT JOIN t0 USING (class_id, kind, key)),
mv AS (SELECT unnest(removed) AS ko_id, ko_id AS into_id FROM t)"""


def _store(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("class_id"), F.split("p_name", " ")[1].alias("kind"), F.col("p_name").alias("name"), "p_brand", "p_retailprice"
    )
    scope, named = ["class_id", "kind"], ["class_id", "kind", "name"]
    members = p.groupBy(*named).agg(F.min("p_brand").alias("brand")).select(*named, F.concat_ws(":", *scope, "brand").alias("key"))
    state = F.when(F.countDistinct("p_brand") > 12, "material_conflict").otherwise("agreed")
    groups = p.join(members, named).groupBy(*scope, "key").agg(F.min("name").alias("title"), state.alias("state"), F.bround(F.max("p_retailprice") / 3000, 4).alias("confidence"))
    li = T.read(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    new_evidence = li.join(members, named).select(*scope, "key", F.col("l_orderkey").alias("chunk_id"), F.col("l_linestatus").alias("role")).distinct()
    held = li.where("l_quantity >= 49 AND l_returnflag = 'R'")
    objects = held.groupBy(*named).agg(F.concat(F.lit("k"), F.min("p_partkey")).alias("ko_id"), F.min("p_brand").alias("brand"), (F.min("p_retailprice") / 30000).alias("confidence"))
    evidence = held.join(objects.select(*named, "ko_id"), named).select(
        F.concat(F.lit("e"), "l_orderkey", F.lit("-"), "l_linenumber").alias("evidence_id"), "ko_id", F.col("l_orderkey").alias("chunk_id"), F.col("l_linestatus").alias("role")
    ).distinct()
    rows = objects.select(*scope, "ko_id", F.concat_ws(":", *scope, "brand").alias("key"), F.col("name").alias("title"), F.lit("published").alias("status"), "confidence", F.lit(None).cast("long").alias("primary_chunk"))
    return groups, members, new_evidence, rows, objects.select("ko_id", "name"), evidence, scope


@query(f"""WITH {_STORE}, fc AS (SELECT class_id, kind, key, min(chunk_id) AS chunk FROM ne GROUP BY ALL)
SELECT g.class_id, g.kind, t.ko_id, g.key, title, CASE WHEN state = 'material_conflict' THEN 'conflict_review_required' WHEN o.ko_id IS NOT NULL THEN 'published' ELSE 'draft' END AS status,
greatest(g.confidence, o.confidence) AS confidence, chunk AS primary_chunk FROM g JOIN t USING (class_id, kind, key) LEFT JOIN o ON o.ko_id = t.ko_id LEFT JOIN fc ON fc.class_id = g.class_id AND fc.kind = g.kind AND fc.key = g.key
UNION ALL SELECT class_id, kind, ko_id, key, name, 'published', confidence, NULL FROM o WHERE ko_id NOT IN (SELECT ko_id FROM t) AND ko_id NOT IN (SELECT ko_id FROM mv)""")
def merged_store_objects(spark, sf_dir):
    return merge_store.merge_into_store(*_store(spark, sf_dir))["objects"]


@query(f"""WITH {_STORE}, e AS (SELECT coalesce(into_id, ko_id) AS ko_id, chunk_id, role, evidence_id, (into_id IS NOT NULL)::INT AS r FROM oe LEFT JOIN mv USING (ko_id)
UNION ALL SELECT t.ko_id, chunk_id, role, 'ev_' || sha1(t.ko_id || '::' || chunk_id || '::' || role)[1:16], 2 FROM ne JOIN t USING (class_id, kind, key))
SELECT arg_min(evidence_id, (r, evidence_id)) AS evidence_id, ko_id, chunk_id, role FROM e GROUP BY ko_id, chunk_id, role""")
def merged_store_evidence(spark, sf_dir):
    return merge_store.merge_into_store(*_store(spark, sf_dir))["evidence"]


@query(f"WITH {_STORE} SELECT class_id, kind, key, ko_id, action, array_to_string(removed, ',') AS removed FROM t")
def merged_store_actions(spark, sf_dir):
    groups, members, _, objects, names, _, scope = _store(spark, sf_dir)
    return merge_store.assigned(groups, members, objects, names, scope).withColumn("removed", F.array_join("removed", ","))


# ---------------------------------------------------------------- quotes, keys, ranges, order


@query(f"""WITH {T.CHUNKS_SQL}, c AS (SELECT doc_id, chunk_id, chunk_index, regexp_replace(lower(text), '[\\s ，。；、,.;:：]+', '', 'g') AS t, text FROM chunks),
q AS (SELECT n.chunk_id AS candidate_id, n.doc_id, CASE WHEN n.chunk_index = 2 THEN reverse(n.text) ELSE n.text END AS quote, d.source AS code, split_part(n.text, ' ', 2) AS name FROM chunks n JOIN documents d USING (doc_id) WHERE n.chunk_index <= 3),
v AS (SELECT candidate_id, c.* FROM q JOIN c ON c.doc_id = q.doc_id AND regexp_replace(lower(quote), '[\\s ，。；、,.;:：]+', '', 'g') <> '' AND contains(t, regexp_replace(lower(quote), '[\\s ，。；、,.;:：]+', '', 'g'))),
x AS (SELECT candidate_id, doc_id, unnest(list_concat(regexp_split_to_array(coalesce(code, ''), '[/,，、\\s]+'), regexp_split_to_array(coalesce(name, ''), '[/,，、\\s]+'))) AS term FROM q),
y AS (SELECT DISTINCT candidate_id, doc_id, regexp_replace(lower(term), '[\\s ，。；、,.;:：]+', '', 'g') AS term FROM x),
r AS (SELECT candidate_id, c.* FROM y JOIN c ON c.doc_id = y.doc_id AND contains(t, term) WHERE (length(term) >= 3 OR regexp_matches(term, '^[a-z]+[0-9]+')) AND candidate_id NOT IN (SELECT candidate_id FROM v)),
a AS (SELECT candidate_id, 'verbatim' AS reason, chunk_id, chunk_index FROM v UNION ALL SELECT candidate_id, 'repaired', chunk_id, chunk_index FROM r),
b AS (SELECT candidate_id, reason, arg_min(chunk_id, chunk_index) AS chunk_id, min(chunk_index) AS page_no, count(DISTINCT chunk_id) AS n_chunks FROM a GROUP BY 1, 2)
SELECT candidate_id, chunk_id, page_no, coalesce(n_chunks, 0) AS n_chunks, coalesce(reason, 'rejected') AS reason FROM q LEFT JOIN b USING (candidate_id)""")
def anchored_candidates(spark, sf_dir):
    """The first chunks of every document as quotes, the second one garbled, with two names that may repair them."""
    c = T.chunks(spark, sf_dir)
    quote = F.when(F.col("chunk_index") == 2, F.reverse("text")).otherwise(F.col("text"))
    asked = c.where("chunk_index <= 3").select(F.col("chunk_id").alias("candidate_id"), "doc_id", quote.alias("quote"), F.col("source").alias("code"), F.split_part("text", F.lit(" "), F.lit(2)).alias("name"))
    return candidates.anchored(asked, c.withColumn("page_no", F.col("chunk_index")), ["code", "name"])


@query("""WITH RECURSIVE r AS (SELECT DISTINCT lower(p_brand) || '_' || p_size AS key FROM part), w AS (SELECT s_suppkey, 'brand#' || (1 + s_nationkey) AS base, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier),
n AS (SELECT b.base, i, CASE WHEN i = 1 THEN b.base ELSE b.base || '_' || i END AS key FROM (SELECT DISTINCT base FROM w) b, range(1, (SELECT max(k) FROM w) + (SELECT count(*) FROM r) + 2) t(i)),
f AS (SELECT base, key, row_number() OVER (PARTITION BY base ORDER BY i) AS k FROM n WHERE key NOT IN (SELECT key FROM r))
SELECT s_suppkey, base, key AS unique_key FROM w JOIN f USING (base, k)""")
def keys_around_reserved(spark, sf_dir):
    reserved = T.read(spark, sf_dir, "part").select(F.concat_ws("_", F.lower("p_brand"), "p_size").alias("key")).distinct()
    rows = T.read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("brand#"), (1 + F.col("s_nationkey")).cast("string")).alias("base"))
    return merge.keys_around(rows, "base", ["s_suppkey"], reserved)


@query("""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS spec, (o_totalprice / 1000)::BIGINT AS page_start, (o_totalprice / 1000)::BIGINT + length(o_orderpriority) AS page_end FROM orders),
b AS (SELECT a.doc_id, a.spec, a.page_start, a.page_end, max((b.page_end, b.spec)) AS m FROM o a JOIN o b ON a.doc_id = b.doc_id AND (b.page_start, b.page_end, b.spec) < (a.page_start, a.page_end, a.spec) GROUP BY 1, 2, 3, 4)
SELECT doc_id, spec, page_start, page_end, m[2] AS overlaps, m[1] AS reach FROM b WHERE m[1] >= page_start""")
def overlapping_specs(spark, sf_dir):
    start = F.bround(F.col("o_totalprice") / 1000).cast("long")
    o = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("spec"), start.alias("page_start"), (start + F.length("o_orderpriority")).alias("page_end"))
    return sections.overlapping_ranges(o, "doc_id", "page_start", "page_end", "spec")


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER w - 1 AS at, coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def ranks_in_hot_groups(spark, sf_dir):
    """Ranks and running sums of all line items in three groups."""
    li = T.read(spark, sf_dir, "lineitem")
    return ranked(li, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "at", "l_quantity").select("l_returnflag", "l_orderkey", "l_linenumber", "at", "used")


# ---------------------------------------------------------------- headings

_CLEAN = r"regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '^\d+(?:\.\d+)?\s+', '')), '\s+\d+\.\d+$', '')), '\s{{2,}}', ' ', 'g'), '^[ \-–—:•]+|[ \-–—:•]+$', '', 'g')"


@query(rf"""WITH l0 AS (SELECT doc_id, [x for x in [regexp_replace(y, '^\s+|\s+$', '', 'g') for y in regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n')] if x <> ''] AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(ls[1:8]) AS raw, generate_subscripts(ls[1:8], 1) AS i FROM l0), c AS (SELECT *, {_CLEAN.format(x="raw")} AS c FROM l),
j AS (SELECT *, lower(c) AS low, string_split(c, ' ') AS w, len(regexp_extract_all(c, '\p{{L}}')) AS letters, len(regexp_extract_all(c, '\p{{Lu}}')) AS upper FROM c),
h AS (SELECT doc_id, arg_min(c, i) AS heading FROM j WHERE length(c) >= 4 AND low NOT IN ('untitled', 'chapter', 'section') AND NOT contains(raw, '•')
  AND NOT (regexp_matches(rtrim(raw), '[.;:]$') AND NOT regexp_matches(raw, '^\d+(?:\.\d+){{0,2}}\s+')) AND letters >= 3 AND len(w) <= 14
  AND (regexp_matches(low, '^(chapter|appendix)\b') OR regexp_matches(raw, '^\d+(?:\.\d+){{0,2}}\s+[A-Z0-9]') OR (upper >= 0.75 * letters AND len(w) <= 12)
    OR (len(w) <= 8 AND len([x for x in w if regexp_matches(x, '^\p{{Lu}}')]) >= greatest(2, len(w) - 1))) GROUP BY 1)
SELECT doc_id, CASE WHEN len(ls) >= 2 AND regexp_matches(ls[1], '(?i)^\d+(?:\.\d+)?\s*chapter\b') THEN coalesce(nullif({_CLEAN.format(x="ls[2]")}, ''), {_CLEAN.format(x="ls[1]")}) ELSE heading END AS heading
FROM l0 LEFT JOIN h USING (doc_id)""")
def page_headings(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", headings.page_heading(F.col("text")).alias("heading"))


# ---------------------------------------------------------------- fixtures

_PAGE = "1 + (chunk_index - 1) // 4"


@query(f"""WITH {T.CHUNKS_SQL}, s AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS stored FROM documents),
c AS (SELECT DISTINCT stored, {_PAGE} AS page_no, chunk_index, lang, split_part(text, ' ', 1) AS w FROM chunks JOIN s USING (doc_id))
SELECT 'documents' AS tbl, count(DISTINCT stored) AS n, NULL AS parents FROM s UNION ALL SELECT 'pages', count(DISTINCT (stored, page_no)), count(DISTINCT stored) FROM c
UNION ALL SELECT 'chunks', count(DISTINCT (stored, page_no, chunk_index)), count(DISTINCT (stored, page_no)) FROM c UNION ALL SELECT 'objects', count(DISTINCT (lang, w)), NULL FROM c
UNION ALL SELECT 'evidence', count(DISTINCT (lang, w, stored, page_no, chunk_index)), count(DISTINCT (lang, w)) FROM c""")
def fixture_tables(spark, sf_dir):
    """Every document as a nested fixture, expanded in one pass; copies of a text are stored under its smallest id."""
    d = T.read(spark, sf_dir, "documents")
    c = T.chunks(spark, sf_dir).withColumn("page_no", F.floor((F.col("chunk_index") - 1) / 4) + 1)
    thing = F.struct(F.concat_ws(":", "lang", F.split("text", " ")[0]).alias("key"), F.col("lang").alias("title"), F.lit("primary").alias("role"))
    pages = c.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text", F.array(thing).alias("objects")))).alias("chunks"))
    nested = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "chunks"))).alias("pages"))
    whole = d.select("doc_id", F.sha2("text", 256).alias("file_hash"), F.col("source").alias("title")).join(nested, "doc_id", "left")
    content = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "file_hash", "title", "pages"))
    tables = fixtures.expand(whole.select(content.alias("content")), T.scratch(spark, "fixtures"))
    stored = d.groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").cast("string").alias("stored_id"))
    known = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("text", 256).alias("file_hash")).join(stored, "file_hash").where("doc_id <> stored_id").select("doc_id", "stored_id")
    out = None
    for name, rows in tables.items():
        if name == "evidence":  # an object's evidence names its chunk
            at = fixtures.remapped(rows.select("doc_id", F.substring_index("key", "@", -1).alias("key"), "parent", F.substring_index("key", "@", 1).alias("payload")), known)
            moved = at.select("doc_id", F.concat_ws("@", "payload", "key").alias("key"), "parent")
        else:
            moved = fixtures.remapped(rows, known)
        parents = F.lit(None).cast("long") if name in ("documents", "objects") else F.countDistinct("parent")
        one = moved.agg(F.lit(name).alias("tbl"), F.countDistinct("key").alias("n"), parents.alias("parents"))
        out = one if out is None else out.unionByName(one)
    return out
