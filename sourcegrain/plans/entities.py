"""Descriptions, lookups, graphs, browse queries and reports over the supplied tables, with their SQL.

Nations are classes, regions their namespaces, customers and parts methods, pages files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import declarations as D
from ..functions import text as T
from ..operators import describe, prompts, reports, structure, wording
from .corpus import spread

QUERIES, SQL = {}, {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def s(column):
    return F.col(column).cast("string")


@query("""
WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(replace(p_brand, '#', '')) AS v FROM part)
SELECT p_partkey, CASE p_size % 6
  WHEN 0 THEN 'Computes ' || a || ' ' || b || ' using ' || v || ', returning the computed int value.'
  WHEN 1 THEN 'Determines whether the ' || a || ' condition holds, based on ' || v || '.'
  WHEN 2 THEN 'Attempts to parse ' || b || ' using ' || v || '.'
  WHEN 3 THEN upper(v[1]) || v[2:] || '.' ELSE NULL END AS sentence
FROM p WHERE p_size % 6 < 3
UNION ALL SELECT p_partkey, CASE p_size % 6 WHEN 3 THEN 'Constructs a new ' || b || ' instance using x and ' || v || '.' WHEN 4 THEN 'Copies ' || a || ' and pushes ' || b || '.' ELSE 'Computes the ' || a || ' of ' || v || ', returning a collection of results.' END FROM p WHERE p_size % 6 >= 3""")
def method_sentences(spark, sf_dir):
    part = spread(table(spark, sf_dir, "part"))
    a, b, v, k = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.col("p_size") % 6
    big = lambda w: describe.capital(w)
    name = F.when(k == 0, F.concat(F.lit("Compute"), big(a), big(b))).when(k == 1, F.concat(F.lit("is_"), a)).when(k == 2, F.concat(F.lit("TryParse"), big(b))).when(k == 3, b).when(k == 4, F.concat(F.lit("copy-"), a, F.lit("_and_push"), big(b))).otherwise(F.concat(big(a), F.lit("Of")))
    params = F.when(k == 3, F.array(F.lit("int x"), F.concat(F.lit("Item &"), v))).when(k == 4, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Item* "), v)))
    returns = F.when(k == 0, "int").when(k == 5, "std::vector<int>").otherwise("void")
    return part.select("p_partkey", describe.method_sentence(name, F.when(k == 3, F.concat(b, F.lit("<T>"))).otherwise("Shop"), params, returns).alias("sentence"))


@query("""
WITH m AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
c AS (SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS p FROM part GROUP BY 1),
f AS (SELECT p_brand, max(p_name) FILTER (WHERE k = 1) AS a, max(p_name) FILTER (WHERE k = 2) AS b, max(p_name) FILTER (WHERE k = 3) AS c FROM m GROUP BY 1)
SELECT p_brand, 'Utility class with ' || n || CASE WHEN n = 1 THEN ' method' ELSE ' methods' END || ' and ' || p || CASE WHEN p = 1 THEN ' property' ELSE ' properties' END || ', including '
  || CASE WHEN n > 3 THEN a || ', ' || b || ', ' || c || ', and ' || (n - 3) || ' more' WHEN n = 3 THEN a || ', ' || b || ', and ' || c WHEN n = 2 THEN a || ' and ' || b ELSE a END || '; extends Item.' AS sentence
FROM c JOIN f USING (p_brand)""")
def class_sentences(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    brands = part.groupBy("p_brand").agg(names.alias("methods"), F.count_distinct("p_type").alias("n_properties"))
    none = F.array().cast("array<string>")
    return brands.select("p_brand", describe.class_sentence(F.col("p_brand"), F.lit("Utility"), F.col("methods"), F.col("n_properties"), F.lit("Item"), none, none).alias("sentence"))


@query("""
WITH p AS (SELECT p_partkey, p_size AS n, lower(replace(p_brand, '#', '')) AS v, replace(p_brand, '#', '') AS w FROM part)
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN w || ' must not be zero; used as a divisor in this method' WHEN 1 THEN w || ' must not be null before this method executes'
  WHEN 2 THEN w || ' must satisfy the required condition described by ' || v || ' is less than ' || n WHEN 3 THEN 'The method rejects input where ' || v || ' is greater than ' || n || ' && open'
  WHEN 4 THEN w || ' must not be zero; invalid values cause this method to throw' WHEN 5 THEN v || ' must stay within valid array bounds' WHEN 6 THEN 'Must satisfy the required condition described by Ready(' || v || ')'
  ELSE w || ' plain words' END AS sentence FROM p""")
def limit_sentences(spark, sf_dir):
    k, v, n = F.col("p_partkey") % 8, F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), s("p_size")
    j = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    limit = (
        F.when(k == 0, j("When ", v, " == 0")).when(k == 1, j("When ", v, " == null")).when(k == 2, j(v, " >= ", n)).when(k == 3, j("when ", v, " > ", n, " && open")).when(k == 4, j("0 == ", v, ": ", v, " == 0"))
        .when(k == 5, j(v, ": Used as an index")).when(k == 6, j("!Ready(", v, ")")).otherwise(j(v, " plain words."))
    )
    limit = F.when(k == 4, j(v, ": ", v, " == 0")).otherwise(limit)
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", limit.alias("l"), F.when(k == 0, j("{ return total / ", v, "; }")).otherwise("{ }").alias("body"))
    rows = rows.withColumn("facts", T.facts(F.col("body")))
    return rows.select("p_partkey", wording.limit_sentence(F.col("l"), T.parse_parameters(F.array(F.lit("int x"))), F.col("facts"), F.col("body")).alias("sentence"))


@query(r"""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(list_transform(str_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\t\r]', ' ', 'g'))), lambda x: regexp_replace(replace(replace(x, '**', ''), '__', ''), '^[-•*# ]+', '')),
  lambda x: trim(x) NOT IN ('', '>', '-', '*', '•', '#') AND NOT regexp_matches(trim(x), '^\d+[.)]?$')) AS b FROM documents)
SELECT doc_id, CASE WHEN starts_with(text, '[') OR len(b) = 0 THEN text ELSE array_to_string(list_transform(b[1:4], lambda x: '- ' || CASE WHEN len(list_filter(regexp_split_to_array(x, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) > 20
  THEN array_to_string(list_filter(regexp_split_to_array(x, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')[1:20], ' ') || '…' ELSE x END), chr(10)) END AS bullets FROM l""")
def bullets(spark, sf_dir):
    text = F.regexp_replace("text", r"[\t\r]", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").startswith("["), F.col("text")).otherwise(T.bind(prompts.truncate_bullets(text, 4, 20), lambda b: F.when(b == text, F.col("text")).otherwise(b))).alias("bullets"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(trim(regexp_replace(x, '[\t\r]', ' ', 'g')), '^[-•* ]+', '')), lambda x: x <> '')) * CASE WHEN starts_with(text, '[') THEN 0 ELSE 1 END AS n FROM documents WHERE text IS NOT NULL""")
def report_bullets(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(reports.bullet_lines(F.col("text"))).cast("long").alias("n"))


@query("""
WITH e AS (SELECT source || '|' || lang AS key, text AS value, doc_id AS created FROM documents WHERE trim(text) <> '' AND NOT starts_with(ltrim(text), '['))
SELECT key, max(created) AS created, sha256(arg_max(value, created)) AS value_hash FROM e WHERE key IS NOT NULL GROUP BY key""")
def cache_clean(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("|"), "lang").alias("key"), F.col("text").alias("value"), F.col("doc_id").alias("created")).filter("key is not null")
    return prompts.keep_clean(entries).select("key", "created", F.sha2("value", 256).alias("value_hash"))


@query("SELECT user_id AS method_id FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def cache_full(spark, sf_dir):
    return prompts.fully_cached(table(spark, sf_dir, "events").select(F.col("user_id").alias("method_id"), F.col("event_type").alias("operation")), ("view", "click", "purchase"))


@query("SELECT c_mktsegment AS namespace, min(c_custkey) AS ord, string_agg(c_name, ',' ORDER BY c_custkey) AS classes FROM customer GROUP BY 1")
def namespace_groups(spark, sf_dir):
    types = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("namespace"), F.col("c_name").alias("full_name"))
    return structure.grouped_namespaces(types).select("namespace", "ord", F.array_join("classes", ",").alias("classes"))


@query("""
WITH s AS (SELECT p_partkey AS ord, p_name AS name, p_name || '.' || p_brand AS full_name FROM part),
f AS (SELECT full_name AS key, arg_max(ord, ord) AS ord FROM s GROUP BY 1)
SELECT key, ord FROM f UNION ALL SELECT name, min(ord) FROM s WHERE name NOT IN (SELECT key FROM f) GROUP BY 1""")
def symbols(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.concat("p_name", F.lit("."), "p_brand").alias("full_name"))
    return structure.symbol_table(rows).select("key", "ord")


@query("""
WITH m AS (SELECT p_partkey AS ord, 'Shop.' || p_type || '.' || p_name AS f, p_type || '.' || p_name AS cm, p_name AS mn FROM part),
k AS (SELECT upper(f) AS key, f AS method, ord, 0 AS k FROM m UNION ALL SELECT upper(cm), f, ord, 1 FROM m UNION ALL SELECT upper(mn), f, ord, 2 FROM m),
i AS (SELECT key, arg_max(method, ord * 3 + k) AS method, min(ord * 3 + k) AS place FROM k GROUP BY 1),
a AS (SELECT DISTINCT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'Other' ELSE p_type[3:] END AS c, CASE s_suppkey % 3 WHEN 1 THEN lower(p_name) ELSE p_name || CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE '' END END AS m FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT id, coalesce(x.method, y.method, (SELECT arg_min(z.method, z.place) FROM i z WHERE ends_with(z.key, upper(c || '.' || m)))) AS method
FROM a LEFT JOIN i x ON x.key = upper(c || '.' || m) LEFT JOIN i y ON y.key = upper(m)""")
def method_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    methods = part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("Shop."), "p_type", F.lit("."), "p_name").alias("full_name"), F.col("p_type").alias("class_name"), F.col("p_name").alias("method_name"))
    key = F.col("s_suppkey")
    class_name = F.when(key % 3 == 0, F.col("p_type")).when(key % 3 == 1, F.lit("Other")).otherwise(F.substring("p_type", 3, 100))
    name = F.when(key % 3 == 1, F.lower("p_name")).otherwise(F.concat("p_name", F.when(key % 7 == 0, "x").otherwise("")))
    asked = table(spark, sf_dir, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey")).select(key.alias("id"), class_name.alias("class_name"), name.alias("method_name"))
    return structure.lookup_methods(asked, structure.method_index(methods)).select("id", "method")


@query("""
SELECT 'ns:' || r_name AS id, r_name AS label, 'namespace' AS kind, NULL AS methods FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'class:' || n_name, n_name, 'class', CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS VARCHAR) FROM nation JOIN region ON r_regionkey = n_regionkey""")
def knowledge_nodes(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    return nodes.select("id", "label", "kind", F.element_at("properties", "methodCount").alias("methods"))


@query("""
SELECT 'ns:' || r_name AS source, 'class:' || n_name AS target, 'CONTAINS' AS label FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT n_name, s_name, 'CALLS' FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def knowledge_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query("""
SELECT 'graph' AS part, '{"projectName":"Trade"}' AS json
UNION ALL SELECT 'node', '{"id":"ns:' || r_name || '","label":"' || r_name || '","kind":"namespace","properties":{}}' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'node', '{"id":"class:' || n_name || '","label":"' || n_name || '","kind":"class","properties":{"accessModifier":"public","methodCount":"' || (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) || '","propertyCount":"0"}}' FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'edge', '{"source":"ns:' || r_name || '","target":"class:' || n_name || '","label":"CONTAINS"}' FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'edge', '{"source":"' || n_name || '","target":"' || s_name || '","label":"CALLS"}' FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def graph_json(spark, sf_dir):
    return reports.graph_json("Trade", *_graph(spark, sf_dir))


def _graph(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("methods"))
    types = nation.join(region, nation.n_regionkey == region.r_regionkey).join(counts, nation.n_nationkey == counts.c_nationkey, "left").select(
        F.col("n_nationkey").alias("ord"), F.col("r_name").alias("namespace"), F.col("n_name").alias("name"), F.col("n_name").alias("full_name"), F.lit("class").alias("kind"), F.lit("public").alias("access"),
        F.coalesce("methods", F.lit(0)).alias("methods"), F.lit(0).alias("properties"))
    links = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source"), F.lit("CALLS").alias("kind"), F.col("s_name").alias("target"))
    return structure.knowledge_graph(types, links)


@query(r"""
WITH s AS (SELECT str_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages),
p AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM s),
t AS (SELECT array_to_string(parts[1:n], '/') AS node, CASE WHEN n > 1 THEN array_to_string(parts[1:n-1], '/') END AS parent, count(*) AS files FROM p GROUP BY 1, 2),
c AS (SELECT parent AS node, count(*) AS children FROM t WHERE parent IS NOT NULL GROUP BY 1),
one AS (SELECT c.node FROM c WHERE children = 1 AND EXISTS (SELECT 1 FROM t x JOIN c y ON y.node = x.node WHERE x.parent = c.node)),
k AS (SELECT * FROM t WHERE node NOT IN (SELECT node FROM one)),
u AS (SELECT k.node, max(len(a.node)) AS l FROM k JOIN t a ON starts_with(k.node, a.node || '/') WHERE a.node NOT IN (SELECT node FROM one) GROUP BY 1)
SELECT k.node, left(k.node, l) AS parent, CASE WHEN l IS NULL THEN k.node ELSE substr(k.node, l + 2) END AS label, files FROM k LEFT JOIN u USING (node)""")
def collapsed_tree(spark, sf_dir):
    tree = structure.path_tree(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")))
    return structure.collapsed(tree).select("node", "parent", "label", "files")


@query("""SELECT p_partkey, contains(upper(p_brand), 'AND#1') OR contains(upper(p_name), 'AND#1') AS visible FROM part""")
def visible_methods(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    methods = part.select("p_partkey", F.col("p_type").alias("file"), F.col("p_brand").alias("class_name"), F.col("p_name").alias("method_name"))
    files = part.select(F.col("p_type").alias("file")).distinct()
    return structure.filtered(files, methods.select("file", "class_name"), methods, "and#1")[1].select("p_partkey", "visible")


@query("""
WITH f AS (SELECT DISTINCT p_type AS file FROM part), n AS (SELECT count(*) AS n FROM f WHERE contains(file, 'ST') OR file IN (SELECT p_type FROM part WHERE contains(p_name, 'hot')))
SELECT n, CASE n WHEN 0 THEN 'No matches for “q”' WHEN 1 THEN '1 file matches' ELSE n || ' files match' END AS message FROM n""")
def filter_count(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("file"), F.when(F.col("p_name").contains("hot"), "ST").otherwise("").alias("class_name"), F.lit("").alias("method_name"))
    shown, _ = structure.filtered(part.select("file").distinct(), part, part, "st")
    return shown.agg(F.count("*").alias("n")).select("n", structure.filter_message(F.col("n"), "q").alias("message"))


@query(r"""
WITH t AS (SELECT str_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages), n AS (SELECT count(DISTINCT array_to_string(parts[1:k], '/')) AS nodes FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM t))
SELECT nodes, nodes <= 4000 AS drawable FROM n""")
def drawable_tree(spark, sf_dir):
    return structure.drawable(structure.path_tree(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))))


@query("SELECT l_orderkey AS method_id, l_linenumber::VARCHAR AS name, max(l_returnflag) AS \"limit\" FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2 UNION ALL SELECT l_orderkey, l_linenumber::VARCHAR, NULL FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (WHERE l_linestatus = 'F') = 0")
def inline_limits(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("method_id"), s("l_linenumber").alias("name"), "l_linestatus", F.col("l_returnflag").alias("limit"))
    known = lines.filter("l_linestatus = 'F'").groupBy("method_id", "name").agg(F.max("limit").alias("limit"))
    return structure.inline_limits(lines.select("method_id", "name").distinct(), known)


@query("""
SELECT 'namespace' AS part, min(c_custkey) AS ord, '{"name":"' || c_mktsegment || '","classes":[' || string_agg('"' || c_name || '"', ',' ORDER BY c_custkey) || ']}' AS json FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'relationship', s_suppkey, '{"sourceId":"' || s_name || '","targetId":"' || n_name || '","kind":"CALLS","sourceFile":"f' || s_suppkey || '"}' FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'project', 0, '{"projectName":"P","rootPath":"/","filesAnalyzed":' || count(*) || ',"filesFailed":0,"metrics":{"totalClasses":' || count(*) || '}}' FROM customer""")
def export_structural_json(spark, sf_dir):
    customer, supplier, nation = (table(spark, sf_dir, n) for n in ("customer", "supplier", "nation"))
    project = customer.agg(F.count("*").alias("n")).select(F.lit("P").alias("projectName"), F.lit("/").alias("rootPath"), F.col("n").alias("filesAnalyzed"), F.lit(0).alias("filesFailed"), F.struct(F.col("n").alias("totalClasses")).alias("metrics"))
    spaces = structure.grouped_namespaces(customer.select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("namespace"), F.col("c_name").alias("full_name")))
    links = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("source"), F.lit("CALLS").alias("kind"), F.col("n_name").alias("target"), F.concat(F.lit("f"), s("s_suppkey")).alias("file"))
    return reports.structural_json(project, spaces, links)


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, upper(l_shipdate::DATE::VARCHAR || l_returnflag) AS u, l_partkey AS p FROM lineitem)
SELECT k AS l_orderkey, string_agg(x, ',' ORDER BY i, p, x) AS kept FROM (SELECT k, i, p, 'When ' || u AS x, row_number() OVER (PARTITION BY k, u ORDER BY i, p, u) AS r FROM l) WHERE r = 1 GROUP BY k""")
def first_limits(spark, sf_dir):
    flag = F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag"))
    line = F.struct("l_linenumber", "l_partkey", F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), flag).alias("t"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]).alias("t"))
    kept = D.with_limit(F.array().cast("array<string>"), F.col("t"))
    return rows.select("l_orderkey", F.array_join(F.transform(kept, lambda x: F.concat(F.lit("When "), F.upper(F.substring(x, 6, 100)))), ",").alias("kept"))
