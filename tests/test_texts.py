"""Descriptions, declarations, prompts, graphs, browse queries and reports on single cases."""

import json

import pytest
from pyspark.sql import functions as F

from sourcegrain.functions import declarations as D
from sourcegrain.functions import lexing
from sourcegrain.functions import text as T
from sourcegrain.operators import conversation, describe, flow, prompts, reports, structure, wording
from sourcegrain.sources import files


def values(spark, **columns):
    """One row of what each column gives."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def strings(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


SENTENCES = [
    ("CalculateTotal", "Shop", ["List<Item> items"], "decimal", "Calculates total using items, returning the computed decimal value."),
    ("Cache", "Cache", ["int size", "Key& key"], "void", "Constructs a new Cache instance using size and key."),
    ("Cache<K, V>", "Cache<K, V>", [], "void", "Constructs a new Cache instance."),
    ("TryParse", "P", ["string text"], "bool", "Attempts to parse using text, returning true when the condition holds, otherwise false."),
    ("IsReady", "P", ["int a"], "bool", "Determines whether the ready condition holds, based on a."),
    ("Is", "P", ["int a", "int b"], "bool", "Determines whether a and b."),
    ("Empty", "P", [], "bool", "Determines whether the current state."),
    ("MergeSort", "P", ["int[] xs"], "void", "Performs the merge sort of xs."),
    ("HeightOf", "P", ["Node* node"], "int", "Computes the height of node, returning the computed int value."),
    ("WordFrequency", "P", ["string t"], "Dictionary<string, int>", "Computes the word frequency from t, returning a collection of results."),
    ("GroupRankAndSlice", "P", [], "void", "Groups ranks and slices."),
    ("Apply", "P", ["Theme theme"], "Task", "Applies the given theme."),
    ("matches", "P", ["a b", "c d", "e f"], "Task<int>", "Matches the given b, d, and f, returning a task that completes asynchronously."),
    ("_", "P", [], "void", "Represents the _ member."),
    ("make_thing", "P", ["int n"], "decltype(f(n))", "Makes thing using n, returning a value whose type is deduced from the arguments."),
]


def test_method_sentences(spark):
    rows = spark.createDataFrame([(i, *s[:4]) for i, s in enumerate(SENTENCES)], "i int, name string, class string, params array<string>, returns string")
    got = {r.i: r.s for r in rows.select("i", describe.method_sentence(F.col("name"), F.col("class"), F.col("params"), F.col("returns")).alias("s")).collect()}
    assert [got[i] for i in range(len(SENTENCES))] == [s[-1] for s in SENTENCES]


def test_class_sentences(spark):
    none, lit = strings(), F.lit
    row = values(
        spark, a=describe.class_sentence(lit("IShape"), lit("BusinessLogic"), none, lit(0), lit(None), none, none),
        b=describe.class_sentence(lit("Shop"), lit("Utility"), strings("A", "B", "C", "D", "E"), lit(1), lit("Base"), strings("IA", "IB"), strings("P", "Q", "R", "S", "T", "U")),
        c=describe.category_label(lit("Utility")), d=describe.signature(lit("int"), lit("F"), strings("int a", "int b")), e=describe.category_text(lit("GuiLogic")),
    )
    assert row.a == "Business-logic interface with no members declared directly in it."
    assert row.b == "Utility class with 5 methods and 1 property, including A, B, C, and 2 more; extends Base; implements IA and IB; depends on P, Q, R, S, and 2 more."
    assert (row.c, row.d, row.e) == ("[Util]", "int F(int a, int b)", "GUI Logic")


LIMIT_SENTENCES = [
    ("When count == 0", "{ return total / count; }", "Count must not be zero; used as a divisor in this method"), ("When count == 0", "{ }", "Count must not be zero; invalid values cause this method to throw"),
    ("When order == null", "", "Order must not be null before this method executes"), ("string.IsNullOrEmpty(name)", "", "Must not be null or empty before this method executes"), ("When n < 0", "", "N must not be negative; negative values are rejected"),
    ("n <= 0", "", "N must be greater than zero; zero or negative values are rejected"), ("i: Used as an index; must stay within bounds of the collection it accesses", "", "i must stay within valid array bounds"),
    ("std::fabs(x) < 1e-12", "", "Must satisfy the required condition described by std::fabs(x) is greater than or equal to 1e-12"), ("When !File.Exists(path)", "", "Must satisfy the required condition described by File.Exists(path)"),
    ("a > b || c", "", "The method rejects input where a is greater than b || c"), ("inQuotes", "", "The method rejects input where inQuotes"),
    ("Potential memory leak: 'new' used without visible 'delete' or smart pointer.", "", "Allocated memory must be released to avoid a memory leak in this method"), ("some plain words.", "", "Some plain words"), ("  ", "", ""),
    ("p: Expected to be a valid file path", "", "P must point to an accessible file path"), ("x: Should remain non-negative based on surrounding logic", "", "X should remain non-negative based on surrounding logic"),
]


def test_limit_sentences(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(LIMIT_SENTENCES)], "i int, l string, body string").withColumn("facts", T.facts(F.col("body")))
    got = {r.i: r.s for r in rows.select("i", wording.limit_sentence(F.col("l"), T.parse_parameters(strings("int count")), F.col("facts"), F.col("body")).alias("s")).collect()}
    assert [got[i] for i in range(len(LIMIT_SENTENCES))] == [s[-1] for s in LIMIT_SENTENCES]


def test_declarations(spark):
    lit = F.lit
    xml = '/// <summary>\n/// Adds <see cref="T:Item"/> to <paramref name="list"/> &amp; more.\n/// </summary>\n/// <param name="a">First</param>\n/// <exception cref="System.ArgumentNullException">When null</exception>\n/// <returns> </returns>'
    doxygen = "/**\n * Does it.\n * And more.\n * @param x the x\n *   goes on\n * @throws std::bad_alloc when full\n * @return the sum\n */"
    body = 'int f(Node* p, int n) {\n if (n < 1 && ok(p)) { throw std::out_of_range("n"); }\n if (p) { if (n == 3) throw E(); }\n // throw Hidden();\n auto* q = new int[n]; p->next = 0; while (true) { a[n] = n / d; }\n throw caught; }'
    local = F.array(F.struct(lit("d").alias("name"), lit("int").alias("type")), F.struct(lit("path").alias("name"), lit("std::string").alias("type")))
    row = values(
        spark, bases=D.split_bases(strings("IShape", " Base", "Other", "Item")), access=D.access_of(strings("static", "internal", "protected")), none=D.access_of(strings("static")),
        signature=D.signature_text(lit("int F(int a) { return { 1 }; }"), lit("{ return { 1 }; }")), limits=D.with_limit(strings("When a"), strings("A", "when b", "c")),
        deps=D.dependencies(strings("Dictionary<string, List<Order>>", "int[]", "System.IO.Stream?", "(Foo a, Bar b)")), cpp=D.cpp_dependencies(strings("const std::vector<Item>&", "std::map<std::string, int>", "unsigned", "Node*")),
        xml=D.xml_tags(lit(xml)), dox=D.doxygen_tags(lit(doxygen)), owner=D.owner_of(lit("a::B::run(std::string)")), pair=D.split_parameter(lit("const Foo& x")), single=D.split_parameter(lit("x")),
        dedent=D.dedent(lit("a {\n    b\n\n      c\n    }")), guards=D.guard_conditions(lit(body)), thrown=D.thrown_types(lit(body)), constant=D.file_constant(lit("const int Max = 12;"), lit("Max")),
        issues=D.runtime_issues(lit(body), strings("Node* p", "int n"), local), limit=D.operational_limits(lit(body), local, F.array().cast("array<struct<name:string,type:string>>")),
        found=D.exception_description(D.xml_tags(lit(xml)), lit("argumentnullexception")), documented=D.documented_exceptions(D.doxygen_tags(lit(doxygen))),
    )
    assert row.bases.base == "Base" and row.bases.interfaces == ["IShape"] and (row.access, row.none) == ("protected", "private")
    assert row.signature == "int F(int a)" and row.limits == ["When a", "when b", "When c"]
    assert row.deps == ["Order", "Stream", "Foo", "Bar"]
    assert row.cpp == ["Item", "map", "Node"]
    assert row.xml == {"summary": "Adds Item to list & more.", "param:a": "First", "exception:System.ArgumentNullException": "When null"} and row.found == "When null"
    assert row.dox == {"summary": "Does it. And more.", "param:x": "the x goes on", "exception:std::bad_alloc": "when full", "returns": "the sum"} and row.documented == ["std::bad_alloc"]
    assert row.owner == "a::B" and tuple(row.pair) == ("const Foo&", "x") and tuple(row.single) == ("x", "value")
    assert row.dedent == "a {\nb\n\n  c\n}" and row.guards == ["n < 1 && ok(p)", "n == 3"]
    assert row.thrown == ["std::out_of_range", "E"] and row.constant == "12"
    assert row.issues == ["Potential division by zero: verify divisor is non-zero before division.", "Potential memory leak: 'new' used without visible 'delete' or smart pointer.", "Potential infinite loop: loop has no visible termination condition."]
    assert row.limit == ["d: Must not be zero (used as a divisor)"]


def test_prompt_texts(spark):
    lit = F.lit
    answer = "intro\n### brief\nOne **bold** line. Two.\n### CONDITIONS\nPre-conditions: x is set\n- y > 0\n1.\nPOST:\n- returns z\n### Errors\n[unavailable]\n### BRIEF\nLast wins here. More."
    row = values(
        spark, bullets=prompts.truncate_bullets(lit("- a b c d\n\n>\n* **e**\n2)\n- f\n- g"), 3, 3), flat=prompts.truncate_bullets(lit("[no]"), 1, 1), groups=prompts.conditions(lit("x\nPRE:\n- a\nPost conditions: b\n- c")),
        shaped=prompts.truncate_conditions(lit("PRE:\n- a\n- b\n- c\n- d\nPOST:\n- e f g"), 3, 2), parts=prompts.split_sections(lit(answer)), doc=prompts.documentation(lit(answer), {"errors": lit("none"), "design": lit("d")}),
        clean=prompts.clean_response(lit(" text<|im_end|>more"), "chatml"), empty=prompts.clean_response(lit("[INST]x")), brief=prompts.shape_class(lit("It **is**. `>")), budget=prompts.within_budget(lit("x" * 1000), lit(2048)),
        returns=prompts.return_statements(lit("{ return a; return  b +\n c; return a; return; }")), mutation=prompts.any_mutation(lit("x => x == 1")), note=prompts.language_note(lit("A.CS")), ok=prompts.is_clean(lit(" [x")), phi=prompts.chat_prompt("phi", lit("s"), lit("u")),
    )
    assert row.bullets == "- a b c…\n- e\n- f" and row.flat == "[no]"
    assert (row.groups.pre, row.groups.post, row.groups.other, row.groups.grouped) == (["a"], ["b", "c"], ["x"], True)
    assert row.shaped == "PRE:\n- a\n- b\n- c\nPOST:\n- e f…"
    assert set(row.parts) == {"BRIEF", "CONDITIONS", "ERRORS"} and row.parts["BRIEF"] == "Last wins here. More."
    assert (row.doc.brief, row.doc.prepost, row.doc.errors, row.doc.design) == ("Last wins here.", "PRE:\n- x is set\n- y > 0\nPOST:\n- returns z", "none", "d")
    assert row.clean == "text" and row.empty == prompts.EMPTY_ANSWER and row.brief == "It is." and len(row.budget) == 500
    assert row.returns == ["return a;", "return b + c;", "return;"] and not row.mutation and row.note == "This is a C# method." and not row.ok
    assert row.phi == "<|system|>s<|end|><|user|>u<|end|><|assistant|>"


def test_verified_facts(spark):
    kind = "method_name string, language string, body string, calls array<string>, thrown array<string>, fields array<struct<name:string,type:string>>"
    rows = [
        ("Walk", "C#", "{ try { items.Add(1); return Walk(n); } catch (E) { Log(); } finally { } }", [], [], [("items", "List<int>"), ("n", "int")]), ("Sum", "C#", "{ return xs.Select(x => x == 1); }", [], ["E1", "E2"], []),
        ("f", "C++", "int f(int n) { std::lock_guard g(m); await x; return f(n - 1); }", [], [], []), ("g", "C++", None, ["a.g"], [], []),
    ]
    got = {r.method_name: r.facts_text.split("\n- ")[1:] for r in prompts.verified_facts(spark.createDataFrame(rows, kind)).collect()}
    assert got["Walk"] == [
        "Contains no throw statements.", "Recursive: the method calls itself.", "Catches exceptions internally without rethrowing; callers get a normal return value instead of the exception.",
        "Has a finally block that always runs.", "Modifies class state: items.", "Return statements: return Walk(n);"]
    assert got["Sum"] == ["Throws: E1, E2.", "Modifies no state: the body contains no assignments or mutating calls.", "Return statements: return xs.Select(x => x == 1);"]
    assert got["f"][1:4] == ["Recursive: the method calls itself.", "Asynchronous: awaits one or more operations.", "Uses a lock for thread safety."] and got["g"] == ["Recursive: the method calls itself."]


def test_graph_and_lookups(spark):
    methods = spark.createDataFrame([(1, "N.A.Run", "A", "Run"), (2, "N.B.Run", "B", "Run"), (3, "N.Outer.Inner.Go", "Outer.Inner", "Go")], "ord long, full_name string, class_name string, method_name string")
    asked = spark.createDataFrame([(1, "a", "RUN", None), (2, "Z", "run", " own "), (3, "Inner", "Go2", None), (4, "Inner", "Go", None)], "id long, class_name string, method_name string, summary string")
    index = structure.method_index(methods)
    assert {r.id: r.method for r in structure.lookup_methods(asked, index).collect()} == {1: "N.A.Run", 2: "N.B.Run", 3: None, 4: "N.Outer.Inner.Go"}
    only = index.filter("key <> 'GO'")
    assert {r.id: r.method for r in structure.lookup_methods(asked, only).collect()}[4] == "N.Outer.Inner.Go"
    types = spark.createDataFrame([(1, "N", "A", "N.A", "class", "public", 2, 0), (2, "N", "B", "N.B", "class", "public", 1, 3), (3, None, "C", "C", "class", "public", 0, 0), (4, "N", "A", "N.A", "class", "private", 9, 9)], "ord long, namespace string, name string, full_name string, kind string, access string, methods int, properties int")
    nodes, edges = structure.knowledge_graph(types, spark.createDataFrame([("A", "CALLS", "B")], "source string, kind string, target string"))
    assert {r.id: (r.label, r.kind, r.properties and r.properties["methodCount"]) for r in nodes.collect()} == {"ns:N": ("N", "namespace", None), "class:N.A": ("A", "class", "2"), "class:N.B": ("B", "class", "1"), "class:C": ("C", "class", "0")}
    assert sorted(tuple(r) for r in edges.collect()) == sorted([("ns:N", "class:N.A", "CONTAINS"), ("ns:N", "class:N.B", "CONTAINS"), ("ns:N", "class:N.A", "CONTAINS"), ("A", "B", "CALLS")])
    symbols = spark.createDataFrame([(1, "A", "N.A", "f1"), (2, "A", "M.A", "f2"), (3, "B", "A", "f3"), (4, "C", "N.A", "f4")], "ord long, name string, full_name string, file string")
    assert {r.key: r.file for r in structure.symbol_table(symbols).collect()} == {"N.A": "f4", "M.A": "f2", "A": "f3", "B": "f3", "C": "f4"}
    detail = {r.id: r for r in structure.detail(asked, methods, types, spark.createDataFrame([("N.A.Run", "N.A", " doc ", ["x"])], "full_name string, declaring string, summary string, calls array<string>")).collect()}
    assert (detail[1].type, detail[1].merged_summary, detail[1].call_targets) == ("N.A", "doc", ["x"]) and detail[2].merged_summary == "own" and detail[4].call_targets == []


def test_browse(spark):
    tree = structure.path_tree(spark.createDataFrame([("r/a/b/c.cs",), ("r/a/b/d.cs",), ("r/x/y.cs",)], "path string"))
    got = {r.node: (r.parent, r.label) for r in structure.collapsed(tree).collect()}
    assert got == {"r": (None, "r"), "r/a/b": ("r", "a/b"), "r/a/b/c.cs": ("r/a/b", "c.cs"), "r/a/b/d.cs": ("r/a/b", "d.cs"), "r/x": ("r", "x"), "r/x/y.cs": ("r/x", "y.cs")}
    assert tuple(structure.drawable(tree, 3).first()) == (7, False)
    names = spark.createDataFrame([("Shop.cs",), ("b.cs",), ("c.cs",)], "file string")
    classes = spark.createDataFrame([("b.cs", "Cart"), ("c.cs", "Tax")], "file string, class_name string")
    methods = spark.createDataFrame([("b.cs", "Cart", "Open"), ("c.cs", "Tax", "ShopTax"), ("c.cs", "Tax", "Run")], "file string, class_name string, method_name string")
    shown, visible = structure.filtered(names, classes, methods, " shop ")
    assert {r.file for r in shown.collect()} == {"Shop.cs", "c.cs"} and {r.method_name for r in visible.filter("visible").collect()} == {"ShopTax"}
    tags = F.create_map(F.lit("exception:E1"), F.lit("one"), F.lit("exception:N.E2"), F.lit("two"), F.lit("summary"), F.lit("s"))
    row = values(spark, e=structure.exceptions_of(strings("e1", "E2", "E3"), tags), q=structure.follow_ups(F.lit("Run"), strings()), m=structure.modifiers(F.lit("public"), static=F.lit(True), override=F.lit(False)), n=structure.filter_message(F.lit(0), "q"),
                 f=structure.fits_in(F.lit("A"), F.lit("Utility"), strings(), F.lit(""), strings(*"abcdefgh"), strings()), p=structure.structural_parameter(F.lit("ref int x")))
    assert [tuple(x) for x in row.e] == [("e1", "one"), ("E2", "two"), ("E3", "Thrown in method body"), ("N.E2", "two")]
    assert len(row.q) == 3 and row.m == ["public", "static"] and row.n == "No matches for “q”" and tuple(row.p) == ("ref", "int x")
    assert [tuple(x) for x in row.f] == [("Lives in", "A (Utility)"), ("That class depends on", "None"), ("That class extends", "No base class"), ("This method calls", "a, b, c, d, e, f")]
    store = spark.createDataFrame([("m", "Why?", 1)], "method string, question string, ord int")
    more = spark.createDataFrame([("m", "WHY?", 2), ("m", "How?", 3)], "method string, question string, ord int")
    assert {r.question for r in structure.add_questions(store, more).collect()} == {"Why?", "How?"} and {r.question for r in structure.remove_questions(structure.add_questions(store, more), more.limit(1)).collect()} == {"How?"}


def test_csharp_and_fallback_steps(spark):
    kind = "method_id long, method_name string, return_type string, language string, body string, locals array<struct<name:string,type:string,initial_value:string>>, fields array<struct<name:string,type:string>>, thrown array<string>, op_limits array<string>"
    body = "{ if (string.IsNullOrEmpty(name)) throw new E(); foreach (var o in orders) { for (int i = 0; i < 3; i++) { total = total + o.Size(i); } } count = 1; Console.WriteLine(total); File.Delete(name); try { db.SaveChanges(); } catch (E) { throw; } return total; }"
    rows = [(1, "Run", "int", "C#", body, [], [("count", "int")], [], []), (2, "f", "int", "C++", None, [("a", "int", "1")], [], ["E"], ["x: Must not be zero"]), (3, "g", "void", "C++", "void g() { std::cout << 1; }", [], [], [], [])]
    got = {}
    for r in flow.dispatched_steps(spark.createDataFrame(rows, kind)).orderBy("method_id", "step").collect():
        got.setdefault(r.method_id, []).append((r.kind, r.description))
    assert got[1] == [
        ("Validation", "Validate that name is not empty or whitespace"), ("LoopProcessing", "Traverse the nested structure to process all contained elements"), ("Calculation", "Perform the core processing logic on the provided inputs"),
        ("StateUpdate", "Update the count field with the new computed value"), ("FileOperation", "Perform the required file system operation"), ("DatabaseOperation", "Execute the database operation to persist the changes"),
        ("ConsoleOutput", "Output information to the console during execution"), ("ReturnResult", "Return the total value to the caller"),
    ]
    assert got[2] == [("Validation", "Validate the input preconditions; throws E if violated"), ("Initialization", "Initialize a for use in the processing logic"), ("ReturnResult", "Return the resulting value to the caller")]
    assert got[3] == [("ConsoleOutput", "Output information to the console during execution")]
    body = F.lit("{ for (a) { b(); } while (c) { foreach (var x in y) { } } }")
    nested = spark.range(1).select(flow.csharp_steps(lexing.facts_of(body), F.lit("void"), F.array().cast("array<struct<name:string,type:string>>")).alias("n")).first()
    # A loop is told as nested where another one stands in it.
    assert [s.text for s in nested.n if s.kind == "LoopProcessing"] == ["Iterate over the index range to process each element sequentially", "Traverse the nested structure to process all contained elements", "Process each element in y to produce the result"]


def test_reports(spark, tmp_path):
    row = values(spark, b=reports.bullet_lines(F.lit("- a\n\n• A\n* b")), n=reports.bullet_lines(F.lit("[x]")), s=reports.mandatory_section("H", strings("a", "A", "b"), "none"), e=reports.mandatory_section("H", strings(), "none"))
    assert row.b == ["a", "A", "b"] and row.n == [] and row.s == ["H", "• a", "• b"] and row.e == ["H", "none"]
    project = spark.createDataFrame([("P", "/r", 2, 0, 1, 2, 1)], "projectName string, rootPath string, filesAnalyzed int, filesFailed int, classes int, methods int, properties int").withColumn("metrics", F.struct(F.col("classes").alias("totalClasses")))
    spaces = spark.createDataFrame([("N", 1, ["N.A"])], "namespace string, ord long, classes array<string>")
    links = spark.createDataFrame([(1, "A", "CALLS", "B", "f")], "ord long, source string, kind string, target string, file string")
    parts = [json.loads(r.json) for r in reports.structural_json(project, spaces, links).orderBy("ord").collect()]
    assert {"name": "N", "classes": ["N.A"]} in parts and {"sourceId": "A", "targetId": "B", "kind": "CALLS", "sourceFile": "f"} in parts
    types = spark.createDataFrame([(1, "N.A", "class", "public", ["Base"], [], "a.cs"), (2, "N.B", "class", "public", [], [], "b.cs")], "ord long, full_name string, kind string, access string, bases array<string>, interfaces array<string>, file string")
    methods = spark.createDataFrame([(1, 1, "Run", "int", ["int a"]), (1, 2, "Go", "void", [])], "type_ord long, ord long, name string, returns string, params array<string>")
    properties = spark.createDataFrame([(2, 1, "Size", "int")], "type_ord long, ord long, name string, type string")
    lines = reports.structural_markdown(project, spaces, types, methods, properties, links)
    text = [r.line for r in lines.orderBy(*reports.MARKDOWN_ORDER).collect()]
    assert text[:6] == ["# Project: P", "", "## Overview", "", "| Metric | Value |", "|--------|-------|"]
    at = text.index("### N.A")
    assert text[at:] == [
        "### N.A", "", "- **Kind:** class", "- **Access:** public", "- **Base types:** Base", "- **File:** `a.cs`", "", "#### Methods", "", "| Name | Return | Params |", "|------|--------|--------|", "| `Run` | `int` | int a |", "| `Go` | `void` |  |", "",
        "### N.B", "", "- **Kind:** class", "- **Access:** public", "- **File:** `b.cs`", "", "#### Properties", "", "- `int Size`", "", "## Relationships", "", "| Source | Kind | Target |", "|--------|------|--------|", "| A | CALLS | B |"]
    reports.export("markdown", str(tmp_path / "out"), project, spaces, types, methods, properties, links)
    assert "\n".join(open(p).read().rstrip("\n") for p in sorted(map(str, (tmp_path / "out").glob("part-*")))).split("\n") == text
    far = types.withColumn("ord", F.col("ord") + 10**15)
    moved = reports.structural_markdown(project, spaces, far, methods.withColumn("type_ord", F.col("type_ord") + 10**15).withColumn("ord", F.col("ord") + 10**12), properties.withColumn("type_ord", F.col("type_ord") + 10**15), links)
    assert [r.line for r in moved.orderBy(*reports.MARKDOWN_ORDER).collect()] == text
    reports.export("json", str(tmp_path / "json"), project, spaces, links)
    assert len("".join(open(p).read() for p in map(str, (tmp_path / "json").glob("part-*"))).splitlines()) == 3


def test_reads_and_caches(spark, tmp_path):
    (tmp_path / "a.cs").write_text("class A {}")
    asked = spark.createDataFrame([(f"{tmp_path}/a.cs",), (f"{tmp_path}/no.cpp",), ("",), ("/nowhere/x.h",)], "path string")
    got = {r.path: (r.text, r.error) for r in files.read(spark, asked).collect()}
    assert got[f"{tmp_path}/a.cs"] == ("class A {}", None) and got[""] == (None, "File path is empty.") and got["/nowhere/x.h"][1] == "File not found: /nowhere/x.h" and got[f"{tmp_path}/no.cpp"][1].startswith("File not found")
    where = str(tmp_path / "cache")
    assert files.load_cache(spark, where, 1, "m").count() == 0
    entries = spark.createDataFrame([("k", "v", 1), ("k", "[no]", 2), ("", "x", 3), ("k", "w", 0)], "key string, value string, created long")
    files.save_cache(entries, where, 1, "M")
    assert files.load_cache(spark, where, 1, "m").count() == 3 and files.load_cache(spark, where, 2, "m").count() == 0
    assert [r.value for r in prompts.keep_clean(entries.filter("key <> ''")).collect()] == ["v"] and prompts.forget(entries, entries.limit(1)).count() == 1
    cached = spark.createDataFrame([(1, o) for o in prompts.OPERATIONS] + [(2, "brief")], "method_id long, operation string")
    assert [r.method_id for r in prompts.fully_cached(cached).collect()] == [1]


def test_answers_and_questions(spark):
    cases = {"a\n\n4": "a", "**a** __b__\n>\n- ": "a b", "4.": "", " [no]\n4": " [no]\n4", " \n": " \n", "a\r\nb 4\r\n12)": "a\nb 4", "- x\n-": "- x", "_**_a": "a"}
    rows = spark.createDataFrame(list(cases.items()), "a string, want string").select("a", "want", conversation.clean_answer(F.col("a")).alias("got")).collect()
    assert [(r.a, r.got) for r in rows] == [(r.a, r.want) for r in rows]
    row = values(spark, y=conversation.wants_detail(F.lit("Explain it Step-By-Step")), n=conversation.wants_detail(F.lit("What is it?")))
    assert row.y and not row.n


@pytest.mark.parametrize("text", [None, ""])
def test_nothing_to_describe(spark, text):
    rows = spark.createDataFrame([(text, text, None, text)], "name string, class string, params array<string>, returns string")
    assert rows.select(describe.method_sentence(F.col("name"), F.col("class"), F.col("params"), F.col("returns")).alias("s")).first().s
