"""More queries of the catalog: facets, evidence, detectors, merging with what exists, lookups, packs and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekiln.catalog import _any, query
from lorekiln.functions import facets
from lorekiln.functions import text as X
from lorekiln.operators import components, evidence, lookup, merge, rules, serve
from lorekiln.plans import tables as T


def _pick(names, index):
    """The name at a number of the row, in Spark."""
    return F.element_at(F.array(*(F.lit(n) for n in names)), index.cast("int") + 1)


def _picked(names, index: str) -> str:
    """The same in SQL."""
    return "([" + ", ".join("NULL" if n is None else "'" + n.replace("'", "''") + "'" for n in names) + f"])[{index} + 1]"


def _cases(column: str, groups, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, words)} THEN '{name}'" for name, words in groups.items()) + f" ELSE {default} END"


# ---------------------------------------------------------------- facets

_TEXTS = ("supply at 12.5 kPa", "Differential Pressure 3 bar", "runs 40 minutes, 5 C", "no number here", "压差 over limit", "oil sensor fault 3 widgets 20 Hz", "flow 7 m3/h lost")
_UNITS = (None, "°C", "k Pa", "x", "m3/h", "", "psid", "bar")
_FACTS = f"SELECT o_orderkey, {_picked(_TEXTS, 'o_orderkey % 7')} AS t, {_picked(_UNITS, 'o_custkey % 8')} AS u FROM orders"
_AXIS = {"cooling": ("chilled water supply", "flow"), "air": ("air",), "lube": ("oil",)}
_UNIT_ROWS = ", ".join(f"('{u}', '{q}')" for q, units in facets.UNITS.items() for u in units)


def _facts(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders")
    return o.select("o_orderkey", _pick(_TEXTS, F.col("o_orderkey") % 7).alias("t"), _pick(_UNITS, F.col("o_custkey") % 8).alias("u"))


@query(f"""WITH f AS ({_FACTS}), units AS (SELECT * FROM (VALUES {_UNIT_ROWS}) v(unit, q)),
words AS (SELECT o_orderkey, unnest(regexp_extract_all(t, '{facets.MEASURED}', 1)) AS w, generate_subscripts(regexp_extract_all(t, '{facets.MEASURED}', 1), 1) AS i FROM f),
prose AS (SELECT o_orderkey, arg_min(q, i) AS q FROM words JOIN units ON replace(lower(trim(w)), ' ', '') = unit GROUP BY 1),
g AS (SELECT f.o_orderkey, coalesce(own.q, prose.q) AS q, {_any("lower(t)", [d.lower() for d in facets.DIFFERENCE])} AS d FROM f LEFT JOIN units own ON replace(lower(trim(u)), ' ', '') = own.unit LEFT JOIN prose USING (o_orderkey))
SELECT o_orderkey, CASE WHEN d AND (q IS NULL OR q = 'pressure') THEN 'pressure_differential' ELSE q END AS quantity FROM g""")
def facet_quantity(spark, sf_dir):
    return _facts(spark, sf_dir).select("o_orderkey", facets.quantity(F.col("u"), F.col("t")).alias("quantity"))


@query(f"""WITH f AS (SELECT o_orderkey, lower(t) AS t FROM ({_FACTS})) SELECT o_orderkey, {_cases("t", facets.POLARITY, "'unknown'")} AS polarity,
{_cases("t", {w: (w,) for w in facets.TRIGGERS}, "'unknown'")} AS cause, {_cases("t", _AXIS, "NULL")} AS subsystem FROM f""")
def facet_axes(spark, sf_dir):
    t = F.lower("t")
    return _facts(spark, sf_dir).select("o_orderkey", facets.polarity(t).alias("polarity"), facets.trigger(t).alias("cause"), facets.axis(t, _AXIS).alias("subsystem"))


_NAMES = ("max oil pressure", "min oil pressure", "oil temperature", "front panel", "Tracer", "plain")
_QUALIFIED = " OR ".join(f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: len(list_filter(names, lambda n: contains(lower(n), w))) > 0)) > 1" for words in facets.QUALIFIERS.values())


@query(f"""WITH g AS (SELECT o_custkey AS doc_id, list_distinct(list({_picked(_NAMES, "(o_orderkey // 3) % 6")})) AS names FROM orders GROUP BY 1)
SELECT doc_id, len(names) > 1 AND ({_QUALIFIED}) AS conflict FROM g""")
def name_conflicts(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), _pick(_NAMES, F.floor(F.col("o_orderkey") / 3) % 6).alias("name"))
    return o.groupBy("doc_id").agg(F.collect_set("name").alias("names")).select("doc_id", facets.conflicting(F.col("names")).alias("conflict"))


@query(r"""SELECT p_partkey, concat_ws('。', nullif(trim(p_name), ''), nullif(trim(p_type || ' of ' || p_brand), ''), nullif(concat_ws(' ', CASE WHEN p_size > 10 THEN 'value=' || p_size END, CASE WHEN p_brand <> 'Brand#7' THEN 'unit=' || p_type END), '')) AS contextual,
CASE WHEN regexp_matches(p_name, '[A-Za-z].*[A-Za-z]') THEN p_name ELSE p_type END AS named FROM part""")
def contextual_names(spark, sf_dir):
    size, unit = F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise("n/a"), F.when(F.col("p_brand") != "Brand#7", F.col("p_type")).otherwise(" - ")
    name = facets.contextual_name(F.col("p_name"), F.concat("p_type", F.lit(" of "), "p_brand"), {"value": size, "unit": unit})
    quoted = F.concat(F.lit("  "), "p_name", F.lit(" \nmore"))
    return T.read(spark, sf_dir, "part").select("p_partkey", name.alias("contextual"), facets.name_from_evidence(quoted, F.col("p_type")).alias("named"))


# ---------------------------------------------------------------- evidence

_KINDS = ("operational_sequence", "fault_diagnostic_rule", "commissioning_step", "parameter_spec")
_QUOTES = f"""WITH {T.CHUNKS_SQL}, q AS (SELECT chunk_id, doc_id, {_picked(_KINDS, "chunk_index % 4")} AS kind, trim(text) AS q, lower(trim(text)) AS low, regexp_replace(lower(trim(text)), '[^a-zA-Z0-9%]+', '', 'g') AS dense,
CASE WHEN doc_id % 3 = 0 THEN 'FC#' || doc_id % 10 ELSE source END AS title FROM chunks),
h AS (SELECT *, regexp_replace(lower(title), '[^a-zA-Z0-9%]+', '', 'g') AS head FROM q),
r AS (SELECT chunk_id, doc_id, CASE WHEN {_any("low", evidence.EDITOR)} THEN 'editor_instruction' WHEN dense = '' OR dense = head OR (length(dense) < 80 AND ends_with(dense, head)) THEN 'heading_only'
WHEN kind = 'fault_diagnostic_rule' AND doc_id % 3 = 0 AND NOT contains(dense, 'fc' || doc_id % 10) THEN 'no_fault_code'
WHEN kind = 'commissioning_step' AND NOT {_any("low", evidence.COMMISSIONING)} THEN 'no_commissioning_action' WHEN ends_with(low, ',') OR {_any("low", evidence.INTRO)} THEN 'incomplete_intro'
WHEN kind <> 'parameter_spec' AND len(regexp_extract_all(q, '[A-Za-z0-9%]+')) < 8 THEN 'too_short' WHEN kind <> 'parameter_spec' AND NOT {_any("low", evidence.RULE)} THEN 'no_rule_signal' END AS reason FROM h)"""


def _weak(spark, sf_dir):
    c = T.chunks(spark, sf_dir)
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("FC#"), F.col("doc_id") % 10)).otherwise(F.col("source"))
    none = F.lit(None).cast("string")
    return c.select("chunk_id", "doc_id", evidence.weak_reason(_pick(_KINDS, F.col("chunk_index") % 4), F.col("text"), title, none, none).alias("reason"))


@query(_QUOTES + " SELECT chunk_id, reason FROM r")
def weak_evidence(spark, sf_dir):
    return _weak(spark, sf_dir).select("chunk_id", "reason")


@query(_QUOTES + " SELECT doc_id AS ko_id, count(*) AS n_evidence, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY 1 HAVING NOT bool_or(reason IS NULL)")
def evidence_audit(spark, sf_dir):
    return evidence.audit(_weak(spark, sf_dir).withColumnRenamed("doc_id", "ko_id"))


@query(f"""WITH {T.CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE chunk_index % 4 IN (1, 3) AND length(trim(source[1:chunk_index % 5])) >= 2 AND lower(trim(source[1:chunk_index % 5])) NOT IN ('en', 'cn', 'na', 'n/a', 'none', 'null') AND length(trim(text)) >= 4""")
def reviewable_candidates(spark, sf_dir):
    c = T.chunks(spark, sf_dir)
    kind, name = _pick(_KINDS, F.col("chunk_index") % 4), F.substring(F.col("source"), F.lit(1), (F.col("chunk_index") % 5).cast("int"))
    return c.where(evidence.reviewable(kind, [_KINDS[1], _KINDS[3]], name, F.col("text"))).select("chunk_id")


_TYPES = ("", "fault table", "parameter list", "maintenance procedure", "wiring diagram", "sequence guidance")
_SLUG = "array_to_string(regexp_extract_all(t, '[a-z0-9]+')[1:6], '_')"
_CONF = "round_even(least({}::DOUBLE + 0.1, 0.99), 3)"
_FAULTY = f"CASE WHEN {_any('kinds', ('fault', 'alarm'))} THEN true WHEN contains(kinds, 'parameter') THEN false ELSE {_any('t', rules.FAULT)} END"


def _detector(kind: str, when: str, keys: str, base: float) -> str:
    return f"SELECT chunk_id, '{kind}' AS kind, unnest({keys}) AS key, {_CONF.format(base)} AS confidence FROM s WHERE {when}"


@query(rf"""WITH {T.CHUNKS_SQL}, n AS (SELECT chunk_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, {_picked(_TYPES, "doc_id % 6")} AS kinds FROM chunks),
s AS (SELECT *, t || ' ' || kinds AS b, CASE WHEN {_SLUG} = '' THEN 'candidate' ELSE {_SLUG} END AS slug FROM n) {" UNION ALL ".join([
    _detector("parameter_spec", _any("b", rules.PARAMETER), r"list_distinct(regexp_extract_all(t, '\b(p\d{3,5})\b', 1))", 0.85),
    _detector("performance_spec", f"NOT {_any('kinds', ('maintenance', 'fault', 'alarm'))} AND {_any('b', rules.PERFORMANCE)}", f"[{_cases('t', rules.CATEGORIES, chr(39) + 'performance' + chr(39))} || '_' || slug]", 0.83),
    _detector("commissioning_step", f"{_any('b', rules.COMMISSIONING)} AND NOT {_any('b', rules.WIRING)}", "[slug]", 0.81),
    _detector("wiring_guidance", _any("b", rules.WIRING), f"[{_cases('t', rules.TOPICS, chr(39) + 'wiring' + chr(39))} || '_' || slug]", 0.80),
    _detector("application_guidance", f"NOT ({_FAULTY}) AND {_any('b', rules.APPLICATION)}", "[CASE WHEN contains(t, 'pump') AND contains(t, 'fan') THEN 'pump_fan' WHEN contains(t, 'pump') OR contains(t, '水泵') THEN 'pump' WHEN contains(t, 'fan') OR contains(t, '风机') THEN 'fan' WHEN contains(t, 'flow') OR contains(t, '流量') THEN 'flow' ELSE 'application' END || '_' || slug]", 0.79),
    _detector("fault_code", _FAULTY, r"list_concat(list_distinct(list_transform(list_filter(regexp_extract_all(t, '\b([a-z]\d[a-z0-9]{1,6})\b', 1), lambda c: NOT starts_with(c, 'p')), lambda c: upper(c))), list_distinct(regexp_extract_all(t, '\b(\d{2,4})\b', 1)))", 0.89),
    _detector("maintenance_procedure", f"{_any('b', rules.MAINTENANCE)} AND NOT ({_any('t', rules.DIAGNOSTIC)} AND NOT {_any('t', rules.STRONG_MAINTENANCE)})", f"[{_cases('t', rules.TASKS, chr(39) + 'maintenance' + chr(39))} || '_' || slug]", 0.78),
    _detector("diagnostic_step", f"{_any('b', rules.MAINTENANCE)} AND {_any('t', rules.DIAGNOSTIC)}", f"[{_cases('t', rules.TASKS, chr(39) + 'maintenance' + chr(39))} || '_' || slug]", 0.77),
])}""")
def rule_detectors(spark, sf_dir):
    c = T.chunks(spark, sf_dir).select("chunk_id", "text", _pick(_TYPES, F.col("doc_id") % 6).alias("kinds"))
    return rules.detected(c)


@query(f"""WITH {T.CHUNKS_SQL}, n AS (SELECT chunk_id, lower(text) AS t, {_picked(_TYPES, "doc_id % 6")} AS k FROM chunks)
SELECT chunk_id, NOT {_any("k", ("fault", "alarm", "maintenance", "commission", "wiring"))} AS parameter_spec,
NOT {_any("k", ("spec", "parameter", "fault", "maintenance", "commission", "wiring", "checklist"))} AND ({_any("k", ("guidance", "application", "sequence"))} OR {_any("t", rules.GATE_APPLICATION)}) AS application_guidance,
NOT {_any("k", ("fault", "parameter"))} AND ({_any("k", ("maintenance", "procedure"))} OR {_any("t", rules.GATE_MAINTENANCE)}) AS maintenance_procedure,
NOT {_any("k", ("fault", "parameter"))} AND {_any("t", rules.GATE_DIAGNOSTIC)} AS diagnostic_step, {_any("k", ("fault", "alarm", "symptom"))} OR {_any("t", rules.GATE_SYMPTOM)} AS symptom FROM n""")
def lane_gates(spark, sf_dir):
    gates = rules.gated_types(F.lower("text"), _pick(_TYPES, F.col("doc_id") % 6))
    return T.chunks(spark, sf_dir).select("chunk_id", *(c.alias(k) for k, c in gates.items()))


# ---------------------------------------------------------------- merging with what exists

_EXISTING = """e0 AS (SELECT p_type AS class_id, p_name, min(p_partkey) AS id, min(p_brand) AS brand FROM part WHERE p_size < 20 GROUP BY 1, 2),
ex AS (SELECT class_id, 'k' || id AS ko_id, CASE WHEN id % 4 = 3 THEN 'old ' || p_name ELSE p_name END AS name, class_id || ':' || brand AS key FROM e0)"""


@query(f"""WITH {_EXISTING}, g AS (SELECT DISTINCT p_type AS class_id, p_type || ':' || p_brand AS key, p_name AS name FROM part),
owner AS (SELECT class_id, name, max(ko_id) AS ko_id FROM ex GROUP BY 1, 2), claim AS (SELECT class_id, ko_id, min(key) AS key FROM g JOIN owner USING (class_id, name) GROUP BY 1, 2),
t AS (SELECT key, list_sort(list(ko_id)) AS ids FROM claim GROUP BY 1), free AS (SELECT key, min(ko_id) AS other FROM ex WHERE ko_id NOT IN (SELECT ko_id FROM claim) GROUP BY 1),
ev AS (SELECT p_type || ':' || p_brand AS key, count(DISTINCT (l_orderkey, l_returnflag)) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT class_id, key, coalesce(ids[1], other, 'ko_' || sha1(key)[1:16]) AS ko_id, CASE WHEN len(ids) >= 2 THEN 'merged_existing' WHEN len(ids) = 1 THEN 'updated_existing' WHEN other IS NOT NULL THEN 'adopted_key' ELSE 'new_merged' END AS action,
CASE WHEN ids IS NULL THEN '' ELSE array_to_string(list_sort(list_concat(ids[2:], CASE WHEN other IS NULL THEN []::VARCHAR[] ELSE [other] END)), ',') END AS removed, coalesce(n, 0)::BIGINT AS n_evidence
FROM (SELECT DISTINCT class_id, key FROM g) LEFT JOIN t USING (key) LEFT JOIN free USING (key) LEFT JOIN ev USING (key)""")
def merge_with_existing(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    key = F.concat_ws(":", "p_type", "p_brand")
    members = p.select(F.col("p_type").alias("class_id"), key.alias("key"), F.col("p_name").alias("name"))
    e = p.where("p_size < 20").groupBy(F.col("p_type").alias("class_id"), "p_name").agg(F.min("p_partkey").alias("id"), F.min("p_brand").alias("brand"))
    existing = e.select(
        "class_id", F.concat(F.lit("k"), "id").alias("ko_id"), F.when(F.col("id") % 4 == 3, F.concat(F.lit("old "), "p_name")).otherwise(F.col("p_name")).alias("name"),
        F.concat_ws(":", "class_id", "brand").alias("key"),
    )
    li = T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("role"))
    ev = li.join(p.select("p_partkey", key.alias("key")), "p_partkey").select("key", "chunk_id", "role")
    return merge.merge_with_existing(members, existing, ev)


@query("""WITH lead AS (SELECT l_partkey, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS first_part FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = first_part THEN l_partkey::VARCHAR ELSE 'ko_' || sha1(l_partkey || '::' || l_returnflag)[1:16] END AS new_id FROM lineitem JOIN lead USING (l_partkey)""")
def split_objects(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ko_id"), F.col("l_returnflag").alias("part"), "l_orderkey", "l_linenumber")
    return merge.split_objects(li, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "new_id")


@query("""WITH s AS (SELECT p_partkey, p_type || p_size AS k, p_partkey % 3 AS sig, p_name FROM part), f AS (SELECT k, sig, min(p_name) AS name FROM s GROUP BY 1, 2), n AS (SELECT k, count(*) AS kinds FROM f GROUP BY 1)
SELECT p_partkey, CASE WHEN kinds = 1 THEN k ELSE k || '_' || regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') END AS refined_key FROM s JOIN f USING (k, sig) JOIN n USING (k)""")
def signature_split(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.col("p_size").cast("string")).alias("k"), "p_name")
    return merge.split_by_signature(p, "k", (F.col("p_partkey") % 3).cast("string"), F.col("p_name")).select("p_partkey", "refined_key")


@query("""WITH m AS (SELECT p_partkey, p_type || p_brand AS grp, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'd:c:t:key_' || p_size ELSE 'd:c:t:' || p_name END AS raw FROM part),
b AS (SELECT grp, arg_min(raw, (contains(raw, ':key_'), p_partkey)) AS best FROM m WHERE raw IS NOT NULL GROUP BY 1) SELECT coalesce(best, grp) AS final_key, count(*) AS n FROM m LEFT JOIN b USING (grp) GROUP BY 1""")
def renamed_groups(spark, sf_dir):
    size = F.col("p_size") % 4
    raw = F.when(size == 0, None).when(size == 1, F.concat(F.lit("d:c:t:key_"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("d:c:t:"), "p_name"))
    m = T.read(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", "p_brand").alias("grp"), raw.alias("raw"))
    return merge.renamed_groups(m, "grp", "raw", ["p_partkey"]).groupBy("final_key").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_type, p_name, p_size, p_brand FROM part),
l AS (SELECT id AS src, lead(id) OVER (PARTITION BY p_type, p_name, p_size ORDER BY id) AS dst, 'same_size' AS reason FROM p UNION ALL SELECT id, lead(id) OVER (PARTITION BY p_type, p_name, p_brand ORDER BY id), 'same_brand' FROM p),
e AS (SELECT * FROM l WHERE dst IS NOT NULL), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(x, y) AS (SELECT src, src FROM b UNION SELECT r.x, b.dst FROM r JOIN b ON r.y = b.src),
c AS (SELECT x AS id, min(y) AS component FROM r GROUP BY 1), why AS (SELECT component, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM e JOIN c ON e.src = c.id GROUP BY 1)
SELECT component, arg_max(id, (p_size, -id)) AS keep, count(*) - 1 AS n_dropped, any_value(reasons) AS reasons FROM c JOIN p USING (id) JOIN why USING (component) GROUP BY 1""")
def duplicate_groups(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_name", "p_size", "p_brand")
    link = lambda by, reason: p.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("p_type", "p_name", by).orderBy("id")).alias("dst"), F.lit(reason).alias("reason"))
    links = link("p_size", "same_size").unionByName(link("p_brand", "same_brand")).where("dst IS NOT NULL")
    return merge.kept_and_dropped(p, links, components.components, "id", [F.col("p_size"), -F.col("id")])


# ---------------------------------------------------------------- lookups

_ROWS = "SELECT c_custkey, c_nationkey, floor(c_acctbal / 5)::BIGINT AS b FROM customer"
_TARGETS = "SELECT s_suppkey, s_nationkey, floor(s_acctbal / 5)::BIGINT AS b FROM supplier"


@query(f"""WITH r AS ({_ROWS}), t AS ({_TARGETS}), u1 AS (SELECT b, min(s_suppkey) AS x FROM t GROUP BY 1 HAVING count(*) = 1), u2 AS (SELECT s_nationkey, min(s_suppkey) AS x FROM t GROUP BY 1 HAVING count(*) = 1), u3 AS (SELECT s_suppkey AS k, s_suppkey AS x FROM t)
SELECT c_custkey, coalesce(u1.x, u2.x, u3.x) AS target, CASE WHEN u1.x IS NOT NULL THEN 'b' WHEN u2.x IS NOT NULL THEN 'c_nationkey' WHEN u3.x IS NOT NULL THEN 'c_custkey' END AS matched_by
FROM r LEFT JOIN u1 ON r.b = u1.b LEFT JOIN u2 ON c_nationkey = s_nationkey LEFT JOIN u3 ON c_custkey = k""")
def cascade_match(spark, sf_dir):
    r = T.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 5).alias("b"))
    t = T.read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 5).alias("tb"))
    return lookup.cascade(r, t, [("b", "tb"), ("c_nationkey", "s_nationkey"), ("c_custkey", "s_suppkey")], "s_suppkey", "c_custkey")


@query("""WITH n AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name || ' ' || p_size END AS name FROM part), t AS (SELECT * FROM (VALUES ('small ring', 't1'), ('red widget', 't2')) v(name, key)),
r AS (SELECT lower(p_name) AS name, arg_min(p_brand, p_partkey) AS key FROM part WHERE p_size > 48 GROUP BY 1), s AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') AS slug FROM n)
SELECT s.name, coalesce(t.key, r.key, slug) AS key, CASE WHEN t.key IS NOT NULL THEN 'terminology' WHEN r.key IS NOT NULL THEN 'registry' ELSE 'slug' END AS origin FROM s LEFT JOIN t ON lower(s.name) = t.name LEFT JOIN r ON lower(s.name) = r.name""")
def resolved_names(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    names = p.select(F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("name")).distinct()
    terms = spark.sql("SELECT * FROM VALUES ('Small  Ring', 't1', 1), ('red widget', 't2', 2), ('RED WIDGET', 't3', 3) AS t(name, key, ord)")
    registry = p.where("p_size > 48").select(F.col("p_name").alias("name"), F.col("p_brand").alias("key"), F.col("p_partkey").alias("ord"))
    return lookup.resolved(names, terms, registry)


@query("""SELECT event_type || user_id AS name, arg_max(event_id % 7, event_id) AS key FROM events GROUP BY 1""")
def registry_append(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    return lookup.registered(e.select(F.concat("event_type", F.col("user_id").cast("string")).alias("name"), (F.col("event_id") % 7).alias("key"), F.col("event_id").alias("seq")))


@query("""SELECT page_id, n FROM (SELECT page_id, length(html) AS n FROM pages) WHERE page_id NOT IN (SELECT doc_id FROM labels)""")
def broken_references(spark, sf_dir):
    pages = T.read(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n"))
    return lookup.broken_references(pages, T.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")), "page_id")


_KEYS = "['d:' || p_type || ':t:' || p_name, 'd:OTHER:t:x', 'd::t:' || p_name, p_name, 'd:' || p_type || ':t:12', 'd:' || p_type || ':t:key_ab', NULL]"


def _keys():
    head = F.concat(F.lit("d:"), "p_type", F.lit(":t:"))
    return F.get(F.array(F.concat(head, "p_name"), F.lit("d:OTHER:t:x"), F.concat(F.lit("d::t:"), "p_name"), F.col("p_name"), F.concat(head, F.lit("12")), F.concat(head, F.lit("key_ab")), F.lit(None)), (F.col("p_partkey") % 7).cast("int"))


@query(f"""WITH k AS (SELECT p_partkey, trim(coalesce(({_KEYS})[p_partkey % 7 + 1], '')) AS k, CASE WHEN p_size = 9 THEN '' ELSE p_type END AS c FROM part)
SELECT p_partkey, CASE WHEN c = '' THEN 'no_class' WHEN k = '' THEN 'no_key' WHEN contains(k, '::') OR NOT regexp_matches(k, '^[^:]+:[^:]+:[^:]+:.+$') THEN 'malformed_key' WHEN split_part(k, ':', 2) <> c THEN 'other_class' END AS fault FROM k""")
def identity_faults(spark, sf_dir):
    class_id = F.when(F.col("p_size") == 9, "").otherwise(F.col("p_type"))
    return T.read(spark, sf_dir, "part").select("p_partkey", lookup.identity_fault(_keys(), class_id).alias("fault"))


@query(f"""WITH k AS (SELECT p_partkey, p_type, p_name, coalesce(({_KEYS})[p_partkey % 7 + 1], '') AS k FROM part), o AS (SELECT *, list_filter(string_split(k, ':'), lambda x: x <> '') AS parts FROM k),
w AS (SELECT *, CASE WHEN len(parts) >= 4 THEN parts[-1] ELSE k END AS own FROM o)
SELECT p_partkey, concat_ws(':', 'hvac', regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), 'par', CASE WHEN own = '' OR starts_with(own, 'key_') OR length(own) <= 2 OR regexp_matches(own, '^[0-9]+$') THEN regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') ELSE own END) AS anchored FROM w""")
def anchored_keys(spark, sf_dir):
    return T.read(spark, sf_dir, "part").select("p_partkey", lookup.anchored_key(_keys(), F.lit("HVAC"), F.col("p_type"), F.lit("par"), F.col("p_name")).alias("anchored"))


@query("""WITH c AS (SELECT o_orderkey, o_orderpriority AS layer FROM orders WHERE o_orderkey % 2 = 0), d AS (SELECT s_suppkey, s_name AS layer FROM supplier WHERE s_nationkey < 15)
SELECT l_orderkey AS chunk_id, l_suppkey AS doc_id, l_linenumber, coalesce(c.layer, d.layer) AS layer FROM lineitem LEFT JOIN c ON l_orderkey = o_orderkey LEFT JOIN d ON l_suppkey = s_suppkey""")
def layer_lookup(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("doc_id"), "l_linenumber")
    by_chunk = T.read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("layer"))
    by_doc = T.read(spark, sf_dir, "supplier").where("s_nationkey < 15").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("layer"))
    return lookup.layers_of_evidence(li, by_chunk, by_doc)


_SECTION = "(o_orderkey % 7) || '.' || (o_custkey % 13) || CASE WHEN o_orderkey % 2 = 0 THEN '.' || o_orderkey % 3 ELSE '' END"
_FOCUS = ("1.1", "3", "5.12.2")


@query(f"""WITH s AS (SELECT o_orderkey, {_SECTION} AS s FROM orders) SELECT o_orderkey, s AS section, {" OR ".join(f"s = '{f}' OR starts_with(s, '{f}.')" for f in _FOCUS)} AS in_focus,
{" AND ".join(f"NOT (s = '{f}' OR starts_with(s, '{f}.') OR starts_with('{f}', s || '.'))" for f in _FOCUS)} AS is_context FROM s""")
def focus_sections(spark, sf_dir):
    k = F.col("o_orderkey")
    s = F.concat((k % 7).cast("string"), F.lit("."), (F.col("o_custkey") % 13).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("."), (k % 3).cast("string"))).otherwise(""))
    o = T.read(spark, sf_dir, "orders").select("o_orderkey", s.alias("section"))
    return o.withColumns({"in_focus": lookup.within_sections(F.col("section"), list(_FOCUS)), "is_context": lookup.apart_from_sections(F.col("section"), list(_FOCUS))})


# ---------------------------------------------------------------- packs and reports

_PACKS = "SELECT o_custkey AS pack, sum((o_orderstatus = 'P')::INT)::BIGINT AS pending, sum((o_orderstatus = 'F')::INT)::BIGINT AS accepted, sum((o_orderstatus = 'O')::INT)::BIGINT AS failed FROM orders GROUP BY 1"


@query(f"""WITH p AS ({_PACKS}) SELECT pack, CASE WHEN pending > 2 THEN 'blocked_pending' WHEN accepted = 0 THEN 'blocked_no_accepted' ELSE 'review_complete' END AS review, CASE WHEN accepted > 0 AND failed = 0 THEN 'success' WHEN accepted > 0 THEN 'partial' ELSE 'failed' END AS release,
concat_ws(',', CASE WHEN accepted = 0 THEN 'no_publishable_knowledge' END, CASE WHEN 10 * accepted < 20 THEN 'low_judge_acceptance' WHEN 10 * accepted < 50 THEN 'medium_judge_acceptance' END, CASE WHEN pack % 5 IN (0, 1) THEN 'equipment_anchor_suspect' END, CASE WHEN failed > 3 THEN 'weak_evidence_present' END) AS findings FROM p""")
def pack_states(spark, sf_dir):
    of = lambda s, name: F.sum((F.col("o_orderstatus") == s).cast("long")).alias(name)
    p = T.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pack")).agg(of("P", "pending"), of("F", "accepted"), of("O", "failed"))
    equipment = _pick(("valve", "pump", "chiller", "boiler", None), F.col("pack") % 5)
    return p.select(
        "pack", evidence.pack_status(F.col("pending") - 2, F.col("accepted")).alias("review"), evidence.release_status(F.col("accepted"), F.col("failed")).alias("release"),
        evidence.task_findings(F.col("accepted"), 10.0 * F.col("accepted"), equipment, F.greatest(F.col("failed") - 3, F.lit(0))).alias("findings"),
    )


_STATES = ("agreed", "partial_conflict", "value_disagreement", "over_merge", "single_source", "material_conflict", "", None)


@query(f"""WITH s AS (SELECT p_partkey, {_picked(_STATES, "p_partkey % 8")} AS state, {_picked(("over_merge", "material_conflict", "value_disagreement"), "p_size % 3")} AS fresh FROM part)
SELECT p_partkey, CASE WHEN state = 'material_conflict' THEN CASE WHEN fresh = 'material_conflict' THEN 'partial_conflict' ELSE fresh END WHEN coalesce(state, '') = '' THEN 'undetermined' ELSE state END AS state FROM s""")
def retagged_states(spark, sf_dir):
    state, fresh = _pick(_STATES, F.col("p_partkey") % 8), _pick(("over_merge", "material_conflict", "value_disagreement"), F.col("p_size") % 3)
    return T.read(spark, sf_dir, "part").select("p_partkey", evidence.retagged(state, fresh).alias("state"))


@query(f"""SELECT o_orderkey, coalesce(nullif(trim({_picked(("accepted", " ", None), "o_orderkey % 3")}), ''), 'pending') AS decision, coalesce(nullif(trim({_picked((" L1 ", "", None), "o_custkey % 3")}), ''), 'L3') AS trust_level, coalesce(nullif(trim(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END), ''), 'auto') AS curator FROM orders""")
def curation_filled(spark, sf_dir):
    curator = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    fields = evidence.filled(_pick(("accepted", " ", None), F.col("o_orderkey") % 3), _pick((" L1 ", "", None), F.col("o_custkey") % 3), curator, {"trust_level": "L3", "curator": "auto"})
    return T.read(spark, sf_dir, "orders").select("o_orderkey", *fields)


@query("""WITH r AS (SELECT o_custkey % 40 AS surface, CASE WHEN o_totalprice > 60000 THEN 'passed' ELSE 'failed' END AS status, o_orderkey % 5 AS passed, o_orderkey % 3 AS failed FROM orders),
g AS (SELECT surface, count(*) AS n, bool_and(status = 'passed') AS ok, sum(passed) AS passed, sum(failed) AS failed FROM r GROUP BY 1)
SELECT s AS surface, CASE WHEN n IS NULL THEN 'pending' WHEN ok THEN 'passed' ELSE 'failed' END AS status, coalesce(n, 0)::BIGINT AS report_count, coalesce(passed, 0)::BIGINT AS passed, coalesce(failed, 0)::BIGINT AS failed FROM range(48) t(s) LEFT JOIN g ON s = surface""")
def surface_rollup(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders")
    r = o.select((F.col("o_custkey") % 40).cast("long").alias("surface"), F.when(F.col("o_totalprice") > 60000, "passed").otherwise("failed").alias("status"), (F.col("o_orderkey") % 5).alias("passed"), (F.col("o_orderkey") % 3).alias("failed"))
    return evidence.surface_rollup(r, spark.range(48).withColumnRenamed("id", "surface"))


@query(f"""WITH {T.CHUNKS_SQL}, p AS (SELECT doc_id, (chunk_index - 1) // 4 AS page_no, count(*) AS n_chunks, md5(string_agg(text, chr(10) ORDER BY chunk_index)) AS texts FROM chunks GROUP BY 1, 2)
SELECT doc_id, page_no, n_chunks, texts, CASE WHEN m = 0 THEN 'none' WHEN m + (n_chunks >= 2)::INT + (n_chunks >= 3)::INT >= 4 THEN 'high' WHEN m + (n_chunks >= 2)::INT + (n_chunks >= 3)::INT >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, doc_id % 4 AS m FROM p)""")
def page_records(spark, sf_dir):
    c = T.chunks(spark, sf_dir).groupBy("doc_id", F.floor((F.col("chunk_index") - 1) / 4).alias("page_no"))
    p = c.agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("t"))
    texts = F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n"))
    return p.select("doc_id", "page_no", "n_chunks", texts.alias("texts"), rules.section_confidence((F.col("doc_id") % 4).cast("int"), F.col("n_chunks"), F.col("n_chunks")).alias("confidence"))


@query("""WITH s AS (SELECT l_partkey, min(l_linenumber) AS page_start, count(DISTINCT l_returnflag) AS n_types, (l_partkey % 4) AS conf FROM lineitem GROUP BY 1)
SELECT l_partkey, conf * 10 + n_types * 3 AS score, page_start FROM s ORDER BY score DESC, page_start, l_partkey LIMIT 30""")
def section_seeds(spark, sf_dir):
    s = T.read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_linenumber").alias("page_start"), F.countDistinct("l_returnflag").alias("n_types"))
    return s.select("l_partkey", (F.col("l_partkey") % 4 * 10 + F.col("n_types") * 3).alias("score"), "page_start").orderBy(F.desc("score"), "page_start", "l_partkey").limit(30)


@query("""SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id LIMIT 50""")
def nulls_last_topk(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").join(T.read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.orderBy(F.desc_nulls_last("quality"), F.desc_nulls_last("n_chars"), "doc_id").limit(50).select("doc_id", "quality")


@query(f"""WITH {T.CHUNKS_SQL} SELECT chunk_id, d.doc_id, length(c.text) AS n, d.source, p.url IS NOT NULL AS has_page FROM chunks c JOIN documents d ON c.doc_id = d.doc_id JOIN pages p ON p.page_id = c.doc_id WHERE d.lang = 'en' OR c.text ILIKE '%the%'""")
def chunk_trace(spark, sf_dir):
    c = T.chunks(spark, sf_dir).select("chunk_id", "doc_id", "text")
    p = T.read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").isNotNull().alias("has_page"))
    d = T.read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    j = c.join(p, "doc_id").join(d, "doc_id").where((F.col("lang") == "en") | F.col("text").ilike("%the%"))
    return j.select("chunk_id", "doc_id", F.length("text").alias("n"), "source", "has_page")


@query(f"""WITH {T.CONCEPTS_SQL}, o AS (SELECT *, {_picked(("field_observation", "industry_standard", "oem_manual", "vendor_application_note", None), "ko_id % 5")} AS level, {_picked(("agreed", "single_source", "disagreement"), "size % 3")} AS state,
CASE WHEN ko_id % 3 <> 0 THEN 'F' || ko_id % 4 END AS family, CASE WHEN ko_id % 6 = 0 THEN ['E1', 'E2'] WHEN ko_id % 6 = 1 THEN ['E1'] ELSE ['E' || ko_id % 9] END AS codes, 'E' || size AS canonical_key FROM ko)
SELECT ko_id FROM o WHERE trust_level IN ('L2', 'L3', 'L4') AND level IN ('field_observation', 'industry_standard', 'oem_manual') AND state <> 'disagreement' AND coalesce(confidence, 0) >= 0.31 AND (brand IS NULL OR brand IN ('Brand#1', 'Brand#12', 'Brand#13', 'Brand#2'))
AND (family IS NULL OR family = 'F1') AND (canonical_key = 'E1' OR list_contains(codes, 'E1'))""")
def composite_filters(spark, sf_dir):
    k = F.col("ko_id")
    level = _pick(("field_observation", "industry_standard", "oem_manual", "vendor_application_note", None), k % 5)
    state, family = _pick(("agreed", "single_source", "disagreement"), F.col("size") % 3), F.when(k % 3 != 0, F.concat(F.lit("F"), (k % 4).cast("string")))
    codes = F.when(k % 6 == 0, F.array(F.lit("E1"), F.lit("E2"))).when(k % 6 == 1, F.array(F.lit("E1"))).otherwise(F.array(F.concat(F.lit("E"), (k % 9).cast("string"))))
    o = T.concepts(spark, sf_dir).withColumns({"highest_authority": level, "consensus_state": state, "model_family": family, "fault_codes": codes, "canonical_key": F.concat(F.lit("E"), F.col("size").cast("string"))})
    keep = serve.object_filter(min_trust="L2", min_authority="oem_manual", consensus=("agreed", "single_source"), min_confidence=0.31, brand=("Brand#1", "Brand#12", "Brand#13", "Brand#2"), model_family=("F1",), fault_code="E1")
    return o.where(keep).select("ko_id")


@query("""SELECT domain, o_orderkey, place FROM (SELECT *, row_number() OVER (ORDER BY domain, place) AS all_place FROM (SELECT n_name AS domain, o_orderkey, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS place
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE place <= 2) WHERE all_place <= 4""")
def inbox_cards(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer").join(F.broadcast(T.read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = T.read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("n_name").alias("domain"), "o_orderkey", "o_totalprice")
    w = Window.partitionBy("domain").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 2").orderBy("domain", "place").limit(4).select("domain", "o_orderkey", "place")


_SPEC = "'1,' || (3 + p_size % 4) || '-' || (5 + p_size) || ':table:' || p_size % 2"


@query(f"""WITH s AS (SELECT p_partkey, string_split({_SPEC}, ':') AS f FROM part), r AS (SELECT p_partkey, f[2] AS kind, f[3] AS chunk, unnest(string_split(f[1], ',')) AS span FROM s)
SELECT DISTINCT p_partkey, kind, chunk, unnest(range(split_part(span, '-', 1)::BIGINT, CASE WHEN contains(span, '-') THEN split_part(span, '-', 2)::BIGINT ELSE span::BIGINT END + 1)) AS page_no FROM r""")
def page_specs(spark, sf_dir):
    size = F.col("p_size")
    spec = F.concat(F.lit("1,"), (size % 4 + 3).cast("string"), F.lit("-"), (size + 5).cast("string"), F.lit(":table:"), (size % 2).cast("string"))
    return serve.pages_of_specs(T.read(spark, sf_dir, "part").select("p_partkey", spec.alias("spec")), "p_partkey", "spec")


@query("""SELECT o_orderkey, coalesce(trim(p_name), o_orderpriority) AS route, p_name IS NULL AS kept FROM orders LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 10) ON o_orderkey = p_partkey""")
def routed_sections(spark, sf_dir):
    routes = T.read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("o_orderkey"), F.trim("p_name").alias("p_name"))
    j = T.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(routes, "o_orderkey", "left")
    return j.select("o_orderkey", F.coalesce("p_name", "o_orderpriority").alias("route"), F.col("p_name").isNull().alias("kept"))


@query("""WITH g AS (SELECT p_type, p_brand, count(DISTINCT p_name) AS names FROM part GROUP BY 1, 2) SELECT p_partkey, CASE WHEN names = 1 THEN p_name ELSE lower(p_type) || ':' || (row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_name, p_partkey) - 1) END AS rebuilt FROM part JOIN g USING (p_type, p_brand)""")
def rebuilt_keys(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    n = p.groupBy("p_type", "p_brand").agg(F.countDistinct("p_name").alias("names"))
    at = F.row_number().over(Window.partitionBy("p_type", "p_brand").orderBy("p_name", "p_partkey")) - 1
    return p.join(n, ["p_type", "p_brand"]).select("p_partkey", F.when(F.col("names") == 1, F.col("p_name")).otherwise(F.concat(F.lower("p_type"), F.lit(":"), at.cast("string"))).alias("rebuilt"))


@query("""WITH x AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda w: length(w) > 6)[1:3] AS expected, lower(text) AS t FROM benchmark)
SELECT item_id, array_to_string(list_filter(expected, lambda w: contains(d.low, w)), ',') AS found, len(expected)::BIGINT AS n_expected FROM x JOIN (SELECT doc_id, lower(text) AS low FROM documents) d ON d.doc_id = item_id""")
def expectation_coverage(spark, sf_dir):
    words = F.slice(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 6), 1, 3)
    b = T.read(spark, sf_dir, "benchmark").select("item_id", words.alias("expected"))
    d = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.lower("text").alias("low"))
    found = F.array_join(F.filter("expected", lambda w: F.contains(F.col("low"), w)), ",")
    return b.join(d, "item_id").select("item_id", found.alias("found"), F.size("expected").cast("long").alias("n_expected"))


@query("""WITH a AS (SELECT l_partkey AS ko_id, count(*) AS n_images, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber) AS images FROM lineitem GROUP BY 1)
SELECT p_partkey AS ko_id, coalesce(n_images, 0)::BIGINT AS n_images, coalesce(images, '') AS images FROM part LEFT JOIN a ON p_partkey = ko_id""")
def visual_evidence(spark, sf_dir):
    """Every object with its anchored images."""
    a = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("ko_id"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: x["l_orderkey"].cast("string")), ",")
    objects = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ko_id"))
    return objects.join(a.agg(F.count("*").alias("n_images"), listed.alias("images")), "ko_id", "left").fillna({"n_images": 0, "images": ""})


@query("""WITH v AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) SELECT d.doc_id, CASE WHEN d.source = 'src1' THEN 'unsupported_type' WHEN v.doc_id IS NOT NULL THEN 'rejected_by_model' ELSE 'accepted' END AS decision FROM documents d LEFT JOIN v USING (doc_id)""")
def model_review(spark, sf_dir):
    v = T.read(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("rejected", F.lit(True))
    d = T.read(spark, sf_dir, "documents").join(v, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("source") == "src1", "unsupported_type").when(F.col("rejected"), "rejected_by_model").otherwise("accepted").alias("decision"))


@query("""WITH p AS (SELECT o_custkey AS pack, count(*) AS candidates FROM orders GROUP BY 1), r AS (SELECT o_custkey AS pack, max(o_orderpriority) AS readiness FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), a AS (SELECT o_custkey AS pack, count(*) AS applied FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(readiness, 'absent') AS readiness, count(*) AS packs, sum(candidates)::BIGINT AS candidates, sum(coalesce(applied, 0))::BIGINT AS applied FROM p LEFT JOIN r USING (pack) LEFT JOIN a USING (pack) GROUP BY 1""")
def pipeline_stats(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "pack")
    p = o.groupBy("pack").agg(F.count("*").alias("candidates"))
    r = o.where("o_orderstatus = 'F'").groupBy("pack").agg(F.max("o_orderpriority").alias("readiness"))
    a = o.where("o_orderstatus = 'O'").groupBy("pack").agg(F.count("*").alias("applied"))
    j = p.join(r, "pack", "left").join(a, "pack", "left").withColumn("readiness", F.coalesce("readiness", F.lit("absent")))
    return j.groupBy("readiness").agg(F.count("*").alias("packs"), F.sum("candidates").alias("candidates"), F.coalesce(F.sum("applied"), F.lit(0)).cast("long").alias("applied"))
