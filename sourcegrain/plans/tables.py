"""Structural, browse, text and stateful operators over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversation, describe, prompts, reports, structure
from ..sources import files
from ..streaming.debounce import debounce
from ..streaming.partial import partial_texts
from ..streaming.throttle import throttle

QUERIES, SQL = {}, {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Regions are base classes, nations their subclasses, customers and suppliers what nations implement and call.
@query("""
SELECT n_name AS source, 'INHERITS' AS kind, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_name, 'IMPLEMENTS', seg FROM (SELECT DISTINCT n_name, c_mktsegment AS seg FROM nation JOIN customer ON c_nationkey = n_nationkey)
UNION ALL SELECT n_name, 'CALLS', s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def relationships(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    segments = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("interfaces"))
    types = nation.join(region, nation.n_regionkey == region.r_regionkey).join(segments, nation.n_nationkey == segments.c_nationkey, "left").select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("name"), F.col("r_name").alias("base"), "interfaces")
    suppliers = table(spark, sf_dir, "supplier")
    calls = suppliers.join(nation, suppliers.s_nationkey == nation.n_nationkey).select(F.col("n_name").alias("source"), F.col("s_name").alias("target"))
    return structure.relationships(types, calls)


# Order priorities are methods, orders their overloads, lines the calls.
@query("""
WITH l AS (SELECT o_custkey % 500 AS k, max(o_orderkey) AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'm' || k AS full_name, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS callees FROM l JOIN lineitem ON l_orderkey = o GROUP BY k""")
def call_graph_last_wins(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    calls = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 500).cast("string")).alias("full_name"), F.col("o_orderkey").alias("overload"), F.struct("l_linenumber", "l_partkey").alias("ord"), F.col("l_partkey").cast("string").alias("target"),
    )
    return structure.call_graph(calls).select("full_name", F.array_join("callees", ",").alias("callees"))


@query("""
WITH c AS (SELECT p_brand, count(*) AS m, count(DISTINCT p_type) AS p FROM part GROUP BY p_brand)
SELECT count(*) AS classes, sum(m)::BIGINT AS methods, sum(p)::BIGINT AS properties, round_even(sum(m) / count(*)::DOUBLE, 2) AS avg_methods, round_even(sum(p) / count(*)::DOUBLE, 2) AS avg_properties FROM c""")
def metrics(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("type_id")).agg(F.count("*").alias("methods"), F.countDistinct("p_type").alias("properties"))
    return structure.metrics(counts)


@query("SELECT upper(p_name) AS key, arg_max(p_partkey, p_partkey) AS last_part, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY 1")
def index_last_wins(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("key", F.upper("p_name"))
    return structure.first_wins(part, [F.col("key")], [F.col("p_partkey")], last=True).select("key", F.col("p_partkey").alias("last_part"), F.col("p_brand").alias("brand"))


@query("""
WITH n AS (SELECT 'r' || r_regionkey AS id, r_name AS label, 'Namespace' AS kind, 0 AS o, r_regionkey::BIGINT AS k FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'Class', 1, n_nationkey FROM nation
  UNION ALL SELECT 'n' || c_nationkey, c_name, 'Method', 2, c_custkey FROM customer)
SELECT id, label, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, k) AS rn FROM n) WHERE rn = 1""")
def graph_nodes(spark, sf_dir):
    rows = lambda name, id_, key, label, kind, o: table(spark, sf_dir, name).select(F.concat(F.lit(id_), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("kind"), F.lit(o).alias("o"), F.col({"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey"}[name]).cast("long").alias("k"))
    nodes = rows("region", "r", "r_regionkey", "r_name", "Namespace", 0).unionByName(rows("nation", "n", "n_nationkey", "n_name", "Class", 1)).unionByName(rows("customer", "n", "c_nationkey", "c_name", "Method", 2))
    return structure.first_wins(nodes, [F.col("id")], [F.col("o"), F.col("k")]).select("id", "label", "kind")


@query("SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'CONTAINS' AS label FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS' FROM customer")
def graph_edges(spark, sf_dir):
    edge = lambda name, a, source, b, target: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(source).cast("string")).alias("source"), F.concat(F.lit(b), F.col(target).cast("string")).alias("target"), F.lit("CONTAINS").alias("label"))
    return edge("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edge("customer", "n", "c_nationkey", "c", "c_custkey"))


@query("""
SELECT l_partkey AS name, l_suppkey AS signature,
       arg_min(o, (CASE WHEN body = '' THEN 1 ELSE 0 END) * 10000000000000::BIGINT + o) AS ord,
       arg_min(body, (CASE WHEN body = '' THEN 1 ELSE 0 END) * 10000000000000::BIGINT + o) AS body,
       arg_min(summary, o) FILTER (WHERE summary <> '') AS summary
FROM (SELECT *, l_orderkey * 100 + l_linenumber AS o, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS body, CASE WHEN l_linestatus = 'O' THEN '' ELSE 'line ' || l_linenumber END AS summary FROM lineitem)
GROUP BY 1, 2""")
def overload_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("signature"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("body"), F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).alias("summary"),
    )
    return structure.overloads(rows)


_ISLANDS = "SELECT user_id, event_id, event_type, ts FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type"


@query(f"SELECT user_id, event_id, event_type FROM ({_ISLANDS})")
def flow_islands(spark, sf_dir):
    return structure.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query(f"""
WITH a AS (SELECT *, event_type IN ('view', 'click') AS mg, count(*) OVER (PARTITION BY user_id) AS n FROM ({_ISLANDS})),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, mg ORDER BY ts, event_id) AS k FROM a),
c AS (SELECT user_id, event_id, event_type, ts FROM b WHERE n <= 8 OR NOT mg OR k = 1),
d AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY ts, event_id) AS k FROM c),
e AS (SELECT * FROM d WHERE n <= 8 OR event_type = 'purchase' OR k < 8)
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS step FROM e""")
def flow_capped(spark, sf_dir):
    steps = structure.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return structure.capped(steps, ["user_id"], ["ts", "event_id"], "event_type", ["view", "click"], "purchase").select("user_id", "event_id", "event_type", "step")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, us, k, us AS last, true AS ok FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.us, e.k, CASE WHEN e.us - w.last >= 3600000000 THEN e.us ELSE w.last END, e.us - w.last >= 3600000000 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id FROM w WHERE ok""")
def throttle_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    return throttle(events, 3_600_000_000).select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN '' ELSE event_type END AS value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
SELECT user_id, event_id, value, epoch_us(ts) + CASE WHEN value = '' THEN 0 ELSE 3600000000 END AS fired_us FROM e WHERE value = '' OR after IS NULL OR epoch_us(after) - epoch_us(ts) >= 3600000000""")
def debounce_events(spark, sf_dir):
    """What is left of each user's events when an hour without another one must follow; a purchase clears at once."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "").otherwise(F.col("event_type")).alias("value"))
    return debounce(events, 3_600_000_000).select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "value", F.unix_micros("fired").alias("fired_us"))


@query("""
WITH t AS (SELECT conv_id * 1000 + turn AS k, translate(replace(text, ' th', '**'), 'eb', '<_') AS x FROM conversations),
p AS (SELECT k, unnest(range((len(x) + 39) // 40)) AS seq, x FROM t),
s AS (SELECT k, seq, regexp_replace(regexp_replace(replace(replace(substr(x, 1, (seq + 1) * 40), '**', ''), '__', ''), '^\\s+', ''), '<[^<]{0,11}$', '') AS partial FROM (SELECT k, CAST(seq AS BIGINT) AS seq, x FROM p))
SELECT k, seq, partial FROM s WHERE partial <> ''""")
def streamed_texts(spark, sf_dir):
    """Each turn in pieces of 40 characters, as it is shown after every piece; letters of the text stand for markers and emphasis."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.translate(F.replace("text", F.lit(" th"), F.lit("**")), "eb", "<_").alias("x"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("x") + 39) / 40).cast("int") - 1), lambda i: F.substring(F.col("x"), i * 40 + 1, F.lit(40)))
    rows = turns.filter("x <> ''").select("key", F.posexplode(pieces).alias("seq", "piece"))
    return partial_texts(rows).select(F.col("key").alias("k"), "seq", "partial")


@query("WITH c AS (SELECT count(*) AS n FROM events) SELECT event_id FROM events, c WHERE n <= 4000 OR event_id IN (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 3000)")
def cache_prune(spark, sf_dir):
    return structure.newest(table(spark, sf_dir, "events"), [F.col("ts"), F.col("event_id")], 4000, 3000).select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def incremental_new(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("mtime"))
    return files.changed(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.lit(0).alias("mtime"))).select(F.col("path").alias("doc_id"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def cache_evict(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "path")
    return files.still_there(labels, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))).select(F.col("path").alias("doc_id"), "quality")


@query(r"""SELECT page_id, regexp_matches(lower(p), '\.(cs|cpp|hpp|h)$') AS is_source, regexp_matches(p, '(^|/)(bin|obj|\.git|node_modules|build|__pycache__|\.vs)/') AS excluded,
CASE WHEN lower(p) LIKE '%.cs' THEN 'C#' WHEN regexp_matches(lower(p), '\.(cs|cpp|hpp|h)$') THEN 'C++' ELSE 'Unknown' END AS language
FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') || CASE page_id % 5 WHEN 0 THEN '/bin/a.cs' WHEN 1 THEN '/src/B.CPP' WHEN 2 THEN '/x.h' WHEN 3 THEN '/x.hx' ELSE '' END AS p FROM pages)""")
def path_filter(spark, sf_dir):
    tails = F.when(F.col("page_id") % 5 == 0, "/bin/a.cs").when(F.col("page_id") % 5 == 1, "/src/B.CPP").when(F.col("page_id") % 5 == 2, "/x.h").when(F.col("page_id") % 5 == 3, "/x.hx").otherwise("")
    path = F.concat(F.regexp_replace("url", "^https?://[^/]*", ""), tails)
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", files.is_source(F.col("path")).alias("is_source"), files.is_excluded(F.col("path")).alias("excluded"), files.language(F.col("path")).alias("language"))


@query(r"""
WITH s AS (SELECT str_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages),
p AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM s)
SELECT array_to_string(parts[1:n], '/') AS node, CASE WHEN n > 1 THEN array_to_string(parts[1:n-1], '/') END AS parent, n::INTEGER AS depth, count(*) AS files FROM p GROUP BY 1, 2, 3""")
def url_tree(spark, sf_dir):
    return structure.path_tree(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")))


@query("SELECT d.doc_id FROM documents d WHERE contains(upper(source), 'SRC1') OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def tree_filter(spark, sf_dir):
    docs, toxic = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("hit")).distinct()
    return docs.join(toxic, "doc_id", "left").filter(F.upper("source").contains("SRC1") | F.col("hit")).select("doc_id")


@query("SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY upper(p_name), p_partkey)::INTEGER AS place FROM part")
def drill_down(spark, sf_dir):
    from pyspark.sql import Window as W

    return table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy(F.upper("p_name"), "p_partkey")).alias("place"))


@query(r"SELECT doc_id, '<<<CODE' || chr(10) || regexp_replace(regexp_replace(coalesce(text, ''), '(?i)<<<\s*CODE|CODE\s*>>>', ' ', 'g'), '\s+$', '') || chr(10) || 'CODE>>>' AS fenced FROM documents")
def fence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", prompts.fence(F.col("text")).alias("fenced"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '<\|[^|]{0,32}\|>', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS clean FROM documents")
def sanitize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", prompts.sanitize(F.col("text")).alias("clean"))


@query(r"""
WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS flat FROM documents),
s AS (SELECT *, regexp_extract_all(flat, '[^.!?]*[.!?]') AS e FROM f),
w AS (SELECT doc_id, text, CASE WHEN len(e) > 3 THEN trim(array_to_string(e[1:3], '')) ELSE flat END AS few FROM s)
SELECT doc_id, CASE WHEN starts_with(trim(text), '[') THEN text WHEN len(str_split(few, ' ')) > 80 THEN array_to_string(str_split(few, ' ')[1:80], ' ') || '…' ELSE few END AS prose FROM w""")
def truncate_prose(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", prompts.truncate_prose(F.col("text"), 3, 80).alias("prose"))


@query("SELECT doc_id, upper(sha256('explain|' || source || '|' || lang || '|' || n_chars)) AS key FROM documents")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", prompts.cache_key(F.lit("explain"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string")).alias("key"))


@query(r"""
WITH t AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN ' ' ELSE substr(text, 1, 40) || CASE turn % 4 WHEN 0 THEN '' WHEN 2 THEN ' Step by step.' ELSE ' At LENGTH' END END AS question, coalesce(substr(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), 1, 60), '') AS raw FROM conversations),
a AS (SELECT *, CASE turn % 3 WHEN 0 THEN raw || chr(10) || '**x**' || chr(10) || ' 4. ' || chr(10) || chr(10) || '>' WHEN 1 THEN ' [none]' || chr(10) || '4' ELSE raw END AS answer FROM t WHERE role = 'user'),
c AS (SELECT *, 'Q: ' || question || chr(10) || 'A: ' || CASE WHEN regexp_matches(answer, '^\s*(\[|$)') THEN answer
  ELSE regexp_replace(replace(replace(regexp_replace(regexp_replace(answer, '(\n[ \t\r]*([>*-]|[0-9]+[.)]?)?[ \t\r]*)+$', ''), '^[ \t\r]*([>*-]|[0-9]+[.)]?)[ \t\r]*$', ''), '**', ''), '__', ''), '^\s+|\s+$', '', 'g') END || chr(10) AS told FROM a WHERE trim(question) <> ''),
h AS (SELECT *, coalesce(string_agg(told, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS history, regexp_matches(lower(question), 'detail|elaborate|in depth|in-depth|thorough|comprehensive|explain fully|fully explain|step by step|step-by-step|at length') AS detailed FROM c)
SELECT conv_id, turn, detailed, 'Answer the question about this method using the metadata below. ' || CASE WHEN detailed THEN 'Give a detailed, thorough answer that covers relevant edge cases.' ELSE 'Be concise.' END || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'This is a C# method.' || chr(10) ELSE '' END || chr(10)
  || '<<<CODE' || chr(10) || 'Method: m' || conv_id || chr(10) || 'Initial explanation: by ' || role || chr(10) || 'CODE>>>' || chr(10) || chr(10) || CASE WHEN history <> '' THEN 'Conversation so far:' || chr(10) || history || chr(10) ELSE '' END || 'Question: ' || question || chr(10) || 'Answer:' AS prompt FROM h
UNION ALL SELECT conv_id, turn, false, '[Please enter a question.]' FROM a WHERE trim(question) = ''""")
def conversation_prompts(spark, sf_dir):
    """A prompt for each user turn, with the last four turns and the answers that were given."""
    rows = table(spark, sf_dir, "conversations").withColumn("raw", F.coalesce(F.substring(F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")), 1, 60), F.lit(""))).filter("role = 'user'")
    end = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 2, " Step by step.").otherwise(" At LENGTH")
    question = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 0), " ").otherwise(F.concat(F.substring("text", 1, 40), end))
    answer = F.when(F.col("turn") % 3 == 0, F.concat("raw", F.lit("\n**x**\n 4. \n\n>"))).when(F.col("turn") % 3 == 1, F.lit(" [none]\n4")).otherwise(F.col("raw"))
    turns = rows.select(
        "conv_id", "turn", question.alias("question"), answer.alias("answer"), F.concat(F.lit("Method: m"), F.col("conv_id").cast("string")).alias("context"), F.concat(F.lit("by "), "role").alias("explanation"), F.when(F.col("conv_id") % 2 == 0, "This is a C# method.").otherwise("").alias("language_note"),
    )
    return conversation.conversation_prompts(turns)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def last_turns(spark, sf_dir):
    return prompts.last_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 4)


@query("""
WITH l AS (SELECT conv_id AS id, turn AS pos, CASE turn % 4 WHEN 0 THEN 'PRE:' WHEN 2 THEN '## Postconditions' ELSE role END AS line FROM conversations),
m AS (SELECT *, CASE WHEN line = 'PRE:' THEN 'PRE' WHEN line = '## Postconditions' THEN 'POST' END AS marker FROM l),
s AS (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS section FROM m)
SELECT id, pos, section, line FROM s WHERE marker IS NULL AND section IS NOT NULL AND trim(line) <> ''""")
def prepost_sections(spark, sf_dir):
    line = F.when(F.col("turn") % 4 == 0, "PRE:").when(F.col("turn") % 4 == 2, "## Postconditions").otherwise(F.col("role"))
    return prompts.sections(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), line.alias("line")))


@query("SELECT p_partkey, regexp_replace(regexp_replace(t, '^.*::', ''), '^.*[.]', '') AS bare, CASE WHEN p_partkey % 3 = 0 THEN 'collection' ELSE replace(p_brand, '#', '') END AS plain FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'List<' || replace(p_brand, '#', '') || '>' WHEN 1 THEN 'std::' || replace(p_brand, '#', '') ELSE 'a.b.' || replace(p_brand, '#', '') END AS t FROM part)")
def type_names(spark, sf_dir):
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    kind = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("List<"), brand, F.lit(">"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("std::"), brand)).otherwise(F.concat(F.lit("a.b."), brand))
    rows = table(spark, sf_dir, "part").select("p_partkey", kind.alias("t"))
    return rows.select("p_partkey", T.strip_qualifiers(F.col("t")).alias("bare"), T.type_name(F.when(F.col("p_partkey") % 3 == 0, F.col("t")).otherwise(T.strip_qualifiers(F.col("t")))).alias("plain"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM documents")
def normalize_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("line"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 7 = 0 THEN 'GuiLogic' WHEN s_suppkey % 4 = 1 OR s_suppkey % 5 = 0 THEN 'Utility' ELSE 'BusinessLogic' END AS category FROM supplier""")
def categories(spark, sf_dir):
    key = F.col("s_suppkey")
    name = F.concat(F.lit("S"), key.cast("string"), F.when(key % 4 == 0, "View").when(key % 4 == 1, "Helper").otherwise("Service"))
    base = F.when(key % 7 == 0, "UserControl").otherwise("Base")
    return table(spark, sf_dir, "supplier").select("s_suppkey", describe.category(name, base, F.when(key % 5 == 0, 0).otherwise(2), F.lit(0), F.lit(3)).alias("category"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'compute order total' WHEN 1 THEN 'copy HTTPResponse' WHEN 2 THEN 'push item' ELSE 'match rows' END AS words,
CASE p_partkey % 4 WHEN 0 THEN 'computes' WHEN 1 THEN 'copies' WHEN 2 THEN 'pushes' ELSE 'matches' END AS verb,
CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' ELSE 'a, b, and c' END AS names FROM part""")
def describe_methods(spark, sf_dir):
    key = F.col("p_partkey") % 4
    name = F.when(key == 0, "computeOrder_total").when(key == 1, "copyHTTPResponse").when(key == 2, "push-item").otherwise("matchRows")
    words = describe.split_identifier(name)
    # A run of capitals stays together with what follows it; other words are in small letters.
    small = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}{2}"), w).otherwise(F.lower(w)))
    listed = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.col("p_size") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(small, " ").alias("words"), describe.inflect(F.lower(F.get(words, F.lit(0)))).alias("verb"), describe.join_names(listed).alias("names"))


@query("""
WITH p AS (SELECT DISTINCT p_brand, p_name FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM p)
SELECT p_brand, string_agg(p_name, ', ' ORDER BY p_name) || CASE WHEN max(n) > 8 THEN ' and ' || (max(n) - 8) || ' more' ELSE '' END AS names FROM r WHERE k <= 8 GROUP BY p_brand""")
def project_context(spark, sf_dir):
    return reports.top_names(table(spark, sf_dir, "part"), ["p_brand"], "p_name", 8)


@query("""
WITH m AS (SELECT DISTINCT user_id FROM events), h AS (SELECT * FROM (VALUES (0, 'view', 'Views'), (1, 'purchase', 'Purchases'), (2, 'refund', 'Refunds')) AS v(k, section, heading)),
l AS (SELECT user_id, k, 0 AS p, '### ' || heading AS line FROM m, h
  UNION ALL SELECT user_id, k, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id), '- event ' || event_id FROM events JOIN h ON event_type = section
  UNION ALL SELECT user_id, k, 1, '_(none detected)_' FROM m, h WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = m.user_id AND e.event_type = h.section))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k, p)::INTEGER AS pos, line FROM l""")
def export_markdown_lines(spark, sf_dir):
    findings = table(spark, sf_dir, "events").select(F.col("user_id").alias("method_id"), F.col("event_type").alias("section"), F.col("event_id").alias("ord"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("description"))
    lines = reports.markdown_lines(findings, [("view", "Views"), ("purchase", "Purchases"), ("refund", "Refunds")])
    return lines.withColumnRenamed("method_id", "user_id")


@query("""
SELECT l_orderkey AS method_id, '{"method":' || l_orderkey || ',"findings":[' || string_agg('{"rule":"' || l_returnflag || '","text":"part ' || l_partkey || '"}', ',' ORDER BY l_linenumber, l_returnflag, 'part ' || l_partkey) || ']}' AS json
FROM lineitem GROUP BY l_orderkey""")
def export_json_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return reports.json_rows(lines.select(F.col("l_orderkey").alias("method_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("rule_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description")))


@query("SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def category_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT s_suppkey, coalesce(a.p_name, b.p_name, c.p_name) AS found
FROM supplier LEFT JOIN part a ON a.p_partkey = s_suppkey * 3 AND s_suppkey % 2 = 0 LEFT JOIN part b ON b.p_partkey = s_suppkey + 7 AND s_suppkey % 3 = 0 LEFT JOIN part c ON c.p_partkey = s_suppkey""")
def lookup_priority(spark, sf_dir):
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    # Each supplier asks for up to three keys in order of preference; the first that a part has wins.
    key = F.col("s_suppkey")
    asks = F.array(F.when(key % 2 == 0, key * 3), F.when(key % 3 == 0, key + 7), key)
    wanted = supplier.select("s_suppkey", F.posexplode(asks).alias("preference", "p_partkey")).filter(F.col("p_partkey").isNotNull())
    hits = wanted.join(part.select("p_partkey", "p_name"), "p_partkey", "left")
    return hits.groupBy("s_suppkey").agg(F.min_by("p_name", F.when(F.col("p_name").isNotNull(), F.col("preference"))).alias("found"))
