"""Reports over entity tables: JSON rows, Markdown lines and the text that sums up a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.declarations import first_of_each


def json_rows(findings: DataFrame) -> DataFrame:
    """method_id, json: a method's findings as one object. findings: method_id, ord, rule_id, description."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "rule_id", "description")))
    grouped = findings.groupBy("method_id").agg(listed.alias("f"))
    return grouped.select("method_id", F.to_json(F.struct(F.col("method_id").alias("method"), F.transform("f", lambda x: F.struct(x["rule_id"].alias("rule"), x["description"].alias("text"))).alias("findings"))).alias("json"))


def markdown_lines(findings: DataFrame, sections: list[tuple[str, str]]) -> DataFrame:
    """method_id, pos, line: a heading and bullets a section, "_(none detected)_" where a section has none.

    findings: method_id, section, ord, description. sections: (section, heading) in order. A finding stays a row of its
    own: lines are numbered by a sort, and no group is gathered into one value.
    """
    heads = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("section"), F.lit(h).alias("heading")) for k, (s, h) in enumerate(sections)])
    places = F.coalesce(*[F.when(F.col("section") == s, k) for k, (s, _) in enumerate(sections)])
    # How many findings a method has in each section: one row each, summed before they travel.
    counts = findings.groupBy("method_id", "section").agg(F.count("*").alias("n"))
    wanted = findings.select("method_id").distinct().select("method_id", F.inline(heads)).join(counts, ["method_id", "section"], "left")
    none = F.when(F.col("n").isNull(), F.lit("_(none detected)_"))
    titles = wanted.select("method_id", "k", F.lit(0).alias("part"), F.lit(None).cast(findings.schema["ord"].dataType).alias("ord"), F.explode(F.filter(F.array(F.concat(F.lit("### "), "heading"), none), lambda x: x.isNotNull())).alias("line"))
    # The heading sorts before the line that stands for no findings, as "#" does before "_".
    bullets = findings.select("method_id", places.alias("k"), F.lit(1).alias("part"), "ord", F.concat(F.lit("- "), "description").alias("line")).filter("k IS NOT NULL")
    order = W.partitionBy("method_id").orderBy("k", "part", "ord", "line")
    return titles.unionByName(bullets).select("method_id", F.row_number().over(order).alias("pos"), "line")


def and_more(names: Column, limit: int) -> Column:
    """The first names and how many follow."""
    n = F.size(names)
    return F.concat(F.array_join(F.slice(names, 1, limit), ", "), F.when(n > limit, F.concat(F.lit(" and "), (n - limit).cast("string"), F.lit(" more"))).otherwise(""))


def top_names(rows: DataFrame, group: list[str], name: str, limit: int) -> DataFrame:
    """group, names: the first `limit` distinct names in order, and how many follow. Names beyond the limit aren't gathered."""
    distinct = rows.select(*group, name).distinct()
    place = F.row_number().over(W.partitionBy(*group).orderBy(name))
    ranked = distinct.withColumn("_place", place).withColumn("_all", F.count("*").over(W.partitionBy(*group))).filter(F.col("_place") <= limit)
    first = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(name)).alias("_names"), F.first("_all").alias("_all"))
    more = F.when(F.col("_all") > limit, F.concat(F.lit(" and "), (F.col("_all") - limit).cast("string"), F.lit(" more"))).otherwise("")
    return first.select(*group, F.concat(F.array_join("_names", ", "), more).alias("names"))


def bullet_lines(text: Column) -> Column:
    """The lines of a text without marks before them; blank lines go, a bracketed message has none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"[\t\r]", " ")), r"^[-•* ]+", ""))
    return F.filter(lines, lambda x: (x != "") & ~text.startswith("["))


def mandatory_section(heading: str, lines: Column, placeholder: str) -> Column:
    """A heading and bullets, those that differ in case only once; the placeholder where there are none."""
    once = first_of_each(lines, F.upper)
    return F.concat(F.array(F.lit(heading)), F.when(F.size(once) > 0, F.transform(once, lambda x: F.concat(F.lit("• "), x))).otherwise(F.array(F.lit(placeholder))))


def structural_json(project: DataFrame, namespaces: DataFrame, links: DataFrame) -> DataFrame:
    """part, ord, json: a project as JSON lines, so that no row holds all of it: its header with the metrics, a line a
    namespace, a line a relationship.

    project: projectName, rootPath, filesAnalyzed, filesFailed, metrics (struct). namespaces: namespace, ord, classes.
    links: ord, source, kind, target, file.
    """
    head = project.select(F.lit("project").alias("part"), F.lit(0).cast("long").alias("ord"), F.to_json(F.struct("projectName", "rootPath", "filesAnalyzed", "filesFailed", "metrics")).alias("json"))
    spaces = namespaces.select(F.lit("namespace").alias("part"), F.col("ord").cast("long").alias("ord"), F.to_json(F.struct(F.col("namespace").alias("name"), "classes")).alias("json"))
    related = links.select(F.lit("relationship").alias("part"), F.col("ord").cast("long").alias("ord"), F.to_json(F.struct(F.col("source").alias("sourceId"), F.col("target").alias("targetId"), "kind", F.col("file").alias("sourceFile"))).alias("json"))
    return head.unionByName(spaces).unionByName(related)


def graph_json(project_name: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, json: a knowledge graph as JSON lines: its project, a line a node (id, label, kind, properties), a line an edge (source, target, label)."""
    spark = nodes.sparkSession
    head = spark.range(1).select(F.lit("graph").alias("part"), F.to_json(F.struct(F.lit(project_name).alias("projectName"))).alias("json"))
    properties = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    ones = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("id", "label", "kind", properties.alias("properties"))).alias("json"))
    return head.unionByName(ones).unionByName(edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("source", "target", "label")).alias("json")))


def full_json(methods: DataFrame, findings: DataFrame, steps: DataFrame, limits: DataFrame) -> DataFrame:
    """method_id, json: all that was found of a method. methods: method_id, class_name, method_name, path. findings:
    method_id, analyzer, emit_ord, description. steps: method_id, step, description. limits: as limits.variable_limits gives them."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("analyzer") == a, F.struct("emit_ord", "description")))).alias(name) for a, name in JSON_LISTS]
    found = findings.groupBy("method_id").agg(*lists).select("method_id", *[F.transform(name, lambda x: x["description"]).alias(name) for _, name in JSON_LISTS])
    done = steps.groupBy("method_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "description"))), lambda x: F.struct(x["step"].alias("stepNumber"), x["description"].alias("description"))).alias("executionSteps"))
    scope = F.array_position(F.array(*map(F.lit, ("Parameter", "Local", "Field"))), F.col("scope"))
    one = F.struct(scope.alias("o"), "name", "type", "scope", F.col("limit").alias("allowedValues"), F.col("evidence").alias("readFrom"), "source", "confidence")
    allowed = limits.groupBy("method_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("o")).alias("variableLimits"))
    rows = methods.join(found, "method_id", "left").join(done, "method_id", "left").join(allowed, "method_id", "left")
    order = ("preconditions", "postconditions", "stateChanges", "executionSteps", "designConstraints", "runtimeRisks")
    return rows.select("method_id", F.to_json(F.struct(F.col("class_name").alias("className"), F.col("method_name").alias("methodName"), F.col("path").alias("filePath"), *order, "variableLimits")).alias("json"))


#: Analysers and the names of their lists in JSON; headings of a method's sections.
JSON_LISTS = (("preconditions", "preconditions"), ("postconditions", "postconditions"), ("state_changes", "stateChanges"), ("design_constraints", "designConstraints"), ("runtime_risks", "runtimeRisks"))
NONE_FOUND = "- _(none detected)_"


def structural_markdown(project: DataFrame, namespaces: DataFrame, types: DataFrame, methods: DataFrame, properties: DataFrame, links: DataFrame) -> DataFrame:
    """section, ord, part, item, i, line: a project as Markdown, in the order of MARKDOWN_ORDER.

    project: projectName, filesAnalyzed, classes, methods, properties. namespaces: namespace, ord, classes. types: ord,
    full_name, kind, access, bases, interfaces, file. methods: type_ord, ord, name, returns, params. properties:
    type_ord, ord, name, type. links: ord, source, kind, target.
    """
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = lambda c: F.col(c).cast("string")

    def rows(df: DataFrame, section: int, lines: Column, ord_: Column | None = None, part: int = 0, item: Column | None = None) -> DataFrame:
        """Lines of each row of df: of a section, of the type or the like of `ord_`, of its part, of the member `item`."""
        long = lambda c: (F.lit(None) if c is None else c).cast("long")
        keyed = df.select(F.lit(section).alias("section"), long(ord_).alias("ord"), F.lit(part).alias("part"), long(item).alias("item"), F.posexplode(lines).alias("i", "line"))
        return keyed.filter("line is not null")

    table_row = lambda *cells: text("| ", *[x for c in cells for x in (c, " | ")][:-1], " |")
    head = F.array(text("# Project: ", F.col("projectName")), F.lit(""), F.lit("## Overview"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|--------|-------|"), *[table_row(n, s(c)) for n, c in (("Files", "filesAnalyzed"), ("Classes", "classes"), ("Methods", "methods"), ("Properties", "properties"))], F.lit(""), F.lit("## Namespaces"), F.lit(""))
    spaces = F.concat(F.array(text("### ", F.col("namespace")), F.lit("")), F.when(F.size("classes") > 0, F.concat(F.array(F.lit("**Classes:**")), F.transform("classes", lambda c: F.concat(F.lit("- `"), c, F.lit("`"))), F.array(F.lit("")))).otherwise(F.array().cast("array<string>")))
    some = lambda lead, c: F.when(F.size(c) > 0, text(lead, F.array_join(c, ", ")))
    class_head = F.array(text("### ", F.col("full_name")), F.lit(""), text("- **Kind:** ", F.col("kind")), text("- **Access:** ", F.col("access")), some("- **Base types:** ", "bases"), some("- **Interfaces:** ", "interfaces"), text("- **File:** `", F.col("file"), "`"), F.lit(""))
    has = lambda df: df.select(F.col("type_ord").alias("ord")).distinct()
    of_type = lambda df, part, lines: rows(df, 2, lines, F.col("type_ord"), part, F.col("ord"))
    # What has no ord, as the headings of a section, comes first: nulls sort before all numbers.
    parts = [
        rows(project, 0, head), rows(namespaces, 1, spaces, F.col("ord")), rows(project, 2, F.array(F.lit("## Classes"), F.lit(""))), rows(types, 2, class_head, F.col("ord")),
        rows(has(methods), 2, F.array(F.lit("#### Methods"), F.lit(""), F.lit("| Name | Return | Params |"), F.lit("|------|--------|--------|")), F.col("ord"), 1),
        of_type(methods, 2, F.array(table_row(text("`", F.col("name"), "`"), text("`", F.col("returns"), "`"), F.array_join("params", ", ")))), rows(has(methods), 2, F.array(F.lit("")), F.col("ord"), 3),
        rows(has(properties), 2, F.array(F.lit("#### Properties"), F.lit("")), F.col("ord"), 4), of_type(properties, 5, F.array(text("- `", F.col("type"), " ", F.col("name"), "`"))),
        rows(has(properties), 2, F.array(F.lit("")), F.col("ord"), 6),
    ]
    heads = F.array(F.lit("## Relationships"), F.lit(""), F.lit("| Source | Kind | Target |"), F.lit("|--------|------|--------|"))
    parts += [rows(links.limit(1), 3, heads), rows(links, 3, F.array(table_row(F.col("source"), F.col("kind"), F.col("target"))), F.col("ord"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The columns by which structural_markdown() is in order.
MARKDOWN_ORDER = ("section", "ord", "part", "item", "i")


def write_lines(lines: DataFrame, order: list[str], column: str, path: str) -> None:
    """Write a report as text files whose names are in its order; the folder is complete or, by the commit protocol, absent."""
    lines.orderBy(*order).select(column).write.mode("overwrite").text(path)


#: By the kind of an export: what makes its rows, the columns of their order, and the one that is written.
EXPORTS = {
    "markdown": (structural_markdown, MARKDOWN_ORDER, "line"), "markdown-full": (markdown_lines, ("method_id", "pos"), "line"), "json": (structural_json, ("part", "ord"), "json"), "json-full": (full_json, ("method_id",), "json"),
}


def export(kind: str, path: str, *tables, **named) -> None:
    """Write an export of a kind of EXPORTS as text files in its order; tables: those that its function takes."""
    make, order, column = EXPORTS[kind]
    write_lines(make(*tables, **named), list(order), column, path)
