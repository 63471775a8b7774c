"""Rules, limits and text functions on single cases."""

import pytest
from pyspark.sql import functions as F

from sourcegrain.functions import text as T
from sourcegrain.operators import flow, limits, prompts, rules, structure
from sourcegrain.plans import corpus
from sourcegrain.sources import files

SCHEMA = (
    "method_id long, class_name string, method_name string, return_type string, language string, params array<string>, body string, fields array<struct<name:string,type:string>>, "
    "locals array<struct<name:string,type:string>>, properties array<struct<name:string,type:string>>, thrown array<string>, op_limits array<string>, class_dependencies array<string>"
)


def method(spark, body, params=(), locals=(), fields=(), name="Operate", returns="void", thrown=(), language="C#"):
    return spark.createDataFrame([(1, "Sample", name, returns, language, list(params), body, list(fields), list(locals), [], list(thrown), [], [])], SCHEMA)


#: (parameters, locals (name, type, start), fields, body, expected by name); "-" for a name without a row.
LIMITS = [
    (["int temp"], [], [], "{ if (temp < -5 || temp > 40) throw new E(); }", {"temp": "-5 to 40"}),
    (["int n"], [], [], "{ if (n <= 2) throw new E(); }", {"n": "greater than 2"}),
    (["int n"], [], [], "{ if (n < 3) throw new E(); }", {"n": "3 or greater"}),
    (["int n"], [], [], "{ if (n <= 2 || n >= 9) throw new E(); }", {"n": "3 to 8"}),
    (["double r"], [], [], "{ if (r <= 0 || r >= 1) throw new E(); }", {"r": "greater than 0, less than 1"}),
    (["double r"], [], [], "{ if (r < 0.5 || r > 2.75) throw new E(); }", {"r": "0.5 to 2.75"}),
    (["decimal r"], [], [], "{ if (r < 0m || r > 1m) throw new E(); }", {"r": "0 to 1"}),
    (["double r"], [], [], "{ if (r < 0.00000015) throw new E(); }", {"r": "0.00000015 or greater"}),
    (["int rating"], [], [], "{\n if (rating <= 0) throw new E();\n if (rating >= 5) throw new E();\n}", {"rating": "1 to 4"}),
    (["int n"], [], [], "{ if (n < 0) throw new E(); if (n == 0) throw new E(); if (n > 256) throw new E(); }", {"n": "1 to 256"}),
    (["size_t n"], [], [], "{ if (n == 0) throw E(); }", {"n": "1 or greater"}),
    (["int n"], [], [], "{ if (n == 0) throw new E(); }", {"n": "any whole number"}),
    (["double f"], [], [], "{ if (f < 0 || f == 0) throw new E(); }", {"f": "0 or greater"}),
    (["int right", "int left"], [], [], "{ if (right > 0 && left > 5) throw new E(); }", {"right": "any whole number", "left": "any whole number"}),
    (["int age"], [], [], "{ if (age >= 18 && age <= 65) Use(age); }", {"age": "18 to 65"}),
    (["int n"], [], [], "{ if (n > 0) Use(n); }", {"n": "any whole number"}),
    (["int count"], [], [("MaxItems", "int", "100")], "{ if (count > MaxItems) throw new E(); }", {"count": "100 or less", "MaxItems": "any whole number"}),
    (["int count"], [("limit", "int", "5")], [], "{ int limit = 5; limit = Compute(); if (count > limit) throw new E(); }", {"count": "any whole number"}),
    (["int count"], [("limit", "int", "8")], [], "{ int limit = 8; if (count > limit) throw new E(); }", {"count": "8 or less"}),
    (["int v"], [], [], "{ v = Math.Clamp(v, 2, 6); }", {"v": "2 to 6"}),
    (["int v"], [], [("Low", "int", "1"), ("High", "int", "5")], "{ v = std::clamp(v, Low, High); }", {"v": "1 to 5"}),
    (["string s"], [], [], "{ if (s.Length > 12) throw new E(); }", {"s": "at most 12 characters"}),
    (["string s"], [], [], "{ if (s == null) throw new E(); if (s.Length > 50) throw new E(); }", {"s": "must not be null, at most 50 characters"}),
    (["string s"], [], [], "{ if (string.IsNullOrEmpty(s)) throw new E(); }", {"s": "must not be empty"}),
    (["string iban"], [], [], "{ if (iban.Length != 22) throw new E(); }", {"iban": "exactly 22 characters"}),
    (["List<int> xs"], [], [], "{ if (xs.Count == 0) throw new E(); }", {"xs": "at least 1 item"}),
    (["List<int> xs"], [], [], "{ if (xs.Count < 3) throw new E(); }", {"xs": "at least 3 items"}),
    (["std::vector<int> xs"], [], [], "{ if (xs.size() <= 3) throw E(); }", {"xs": "at least 4 items"}),
    (["Order o"], [], [], "{ if (o is null) throw new E(); }", {"o": "must not be null"}),
    (["Order o"], [], [], "{ ArgumentNullException.ThrowIfNull(o); }", {"o": "must not be null"}),
    (["Order o"], [], [], "{ if (o is null) return; Use(o); }", {"o": "any Order value"}),
    (["int k"], [], [], "{ if (k != 3 && k != 5 && k != 7) throw new E(); }", {"k": "3, 5 or 7"}),
    (["int k"], [], [], "{ if (k != 3) throw new E(); }", {"k": "any whole number"}),
    (["int a", "int d"], [], [], "{ return a / d; }", {"a": "any whole number", "d": "must not be zero"}),
    (["int a", "int d"], [], [], "{ if (d == 0) return 0; return a / d; }", {"d": "any whole number"}),
    (["int a", "int d"], [], [], "{ if (d == 0) throw new E(); return a / d; }", {"d": "must not be zero"}),
    (["int a", "Ir ir"], [], [], "{ return a / ir.Count; }", {"ir": "any Ir value"}),
    (["int v", "int lo", "int hi"], [], [], "{ if (v < lo || v > hi) throw new E(); }", {"v": "between lo and hi", "lo": "any whole number"}),
    (["int v", "int lo", "int hi"], [], [], "{\n if (v < lo) throw new E();\n if (v > hi) throw new E();\n}", {"v": "between lo and hi"}),
    (["int v", "int lo"], [], [], "{ if (v < lo) return lo; return v; }", {"v": "any whole number"}),
    (["char c"], [], [], "{ if (c >= 'b' && c <= 'y') Use(c); }", {"c": "'b' to 'y'"}),
    (["char c"], [], [], "{ if (c < 'a' || c > 'z') throw new E(); }", {"c": "'a' to 'z'"}),
    ([], [], [], "{ for (int i = 0; i < 10; i++) { Use(i); } }", {"i": "0 to 9"}),
    ([], [], [], "{ for (int i = 0; i < n; i++) { Use(i); } }", {"i": "-"}),
    (["byte b"], [], [], "{ Use(b); }", {"b": "0 to 255"}),
    (["short s", "ushort u", "uint w", "float f", "char c", "DateTime t", "size_t z", "bool b", "int[] xs"], [], [], "{ Use(s); }",
     {"s": "-32,768 to 32,767", "u": "0 to 65,535", "w": "0 or greater", "f": "any decimal number", "c": "any single character", "t": "any date and time", "z": "0 or greater", "b": "true or false", "xs": "any number of items"}),
    (["int n"], [], [], "{ // if (n < 1) throw new E();\n Use(n); }", {"n": "any whole number"}),
    (["int n"], [], [], '{ Log("if (n < 1) throw"); }', {"n": "any whole number"}),
    (["int n"], [], [("used", "int", None), ("unused", "int", None)], "{ used = n; }", {"used": "any whole number", "unused": "-"}),
    (["int level"], [], [], "{\n if (level < 1 ||\n     level > 100)\n {\n  throw new E();\n }\n}", {"level": "1 to 100"}),
    (["int level"], [], [], "{\n if (level < 10) {\n  throw new E();\n }\n}", {"level": "10 or greater"}),
    (["int level"], [], [], "{\n if (level < 10) {\n  Log(level);\n  throw new E();\n }\n}", {"level": "any whole number"}),
    (["int returnStatements"], [], [], "{ if (returnStatements > 0) Use(returnStatements); }", {"returnStatements": "any whole number"}),
    (["int month"], [], [], "{ return month >= 1 && month <= 12; }", {"month": "1 to 12"}),
    (["int x"], [("x", "byte", None)], [], None, {"x": "0 to 255"}),
]


def test_limits(spark):
    rows = [(i, params, [(n, t, v) for n, t, v in locals_], [(n, t, v) for n, t, v in fields], body) for i, (params, locals_, fields, body, _) in enumerate(LIMITS)]
    kind = "array<struct<name:string,type:string,initial_value:string>>"
    got = {(r.method_id, r.name): r for r in limits.variable_limits(spark.createDataFrame(rows, f"method_id long, params array<string>, locals {kind}, fields {kind}, body string")).collect()}
    wrong = []
    for i, (*_, body, want) in enumerate(LIMITS):
        for name, text in want.items():
            found = got[i, name].limit if (i, name) in got else "-"
            if found != text:
                wrong.append((body, name, text, found))
    assert not wrong
    by_body = {(LIMITS[i][3], n): r for (i, n), r in got.items()}
    r = by_body["{ if (count > MaxItems) throw new E(); }", "count"]
    assert (r.kind, r.evidence, r.source, r.confidence) == ("Range", "count > MaxItems", "Guard", "High")
    r = by_body["{ if (s == null) throw new E(); if (s.Length > 50) throw new E(); }", "s"]
    assert (r.kind, r.evidence) == ("Presence", "s == null; s.Length > 50")
    r = by_body["{ return month >= 1 && month <= 12; }", "month"]
    assert (r.evidence, r.source, r.confidence) == ("month >= 1, month <= 12", "Comparison", "Medium")
    r = by_body["{ for (int i = 0; i < 10; i++) { Use(i); } }", "i"]
    assert (r.scope, r.source, r.confidence, r.evidence) == ("Local", "LoopBound", "Medium", "for (int i = 0; i < 10")
    assert all(r.evidence for r in got.values())


def test_long_and_deep_bodies(spark):
    """Bodies of 100,000 characters, 150 nested blocks and 1,200 guards are read whole, without a deep stack."""
    filler = "total = total + Scale(value); "
    long_block = "{ if (n == 0) { " + filler * (99_000 // len(filler)) + "throw new E(); } try { Run(); } catch (E e) { " + "x = 1; " * 50 + "rethrowLater(); } }"
    deep = "{ if (n == 0) " + "{ if (a) " * 150 + "{ throw new E(); }" + " }" * 150 + " }"
    string = '{ Log("' + "a\\\"b" * 2_000 + '"); if (n < 1) throw new E(); }'
    many = "{ " + "".join(f"if (n{i} == 0) {{ throw new E(); }} " for i in range(1200)) + "}"
    bodies = [long_block, deep, string, many]
    assert len(long_block) > 99_000
    rows = spark.createDataFrame([(i, "Sample", "Operate", "void", "C#", ["int n"], b, [], [], [], [], [], []) for i, b in enumerate(bodies)], SCHEMA)
    found = {(r.method_id, r.rule_id, r.subject) for r in rules.analyses(rows).collect()}
    assert {(0, "guard-eq-zero", "n"), (1, "guard-eq-zero", "n"), (3, "guard-eq-zero", "n1199"), (0, "exception-swallowed", None)} <= found
    assert {(r.method_id, r["limit"]) for r in limits.variable_limits(rows).collect() if r.name == "n" and r.method_id == 2} == {(2, "1 or greater")}
    assert limits.variable_limits(rows).count() >= 4
    steps = rows.withColumn("locals", F.array().cast("array<struct<name:string,type:string,initial_value:string>>"))
    assert flow.execution_steps(steps).select("method_id").distinct().count() == 4


def test_guard_block_is_balanced(spark):
    outer = "{ if (x == 0) { if (y) { Log(); } Stop(); } Run(); { throw new E(); } }"
    inner = "{ if (x == 0) { if (y) { throw new E(); } } }"
    for body, n in ((outer, 0), (inner, 1)):
        rows = rules.findings(method(spark, body, ["int x"]), "preconditions").filter("rule_id = 'guard-eq-zero'")
        assert rows.count() == n


def test_risks_and_null_bodies(spark):
    rows = rules.findings(method(spark, "{ return a / d + o.Size; }", ["int a", "int d", "Order o"]), "runtime_risks").collect()
    assert {(r.rule_id, r.kind) for r in rows} == {("divide-by-zero", None), ("null-dereference", "NullReferenceException")}
    for analyzer in rules.ANALYZERS:
        assert all(r.rule_id in ("post-return-type", "pure-impure") for r in rules.findings(method(spark, None), analyzer).collect())
        assert rules.findings(method(spark, "{}").limit(0), analyzer).count() == 0


def test_catalogue(spark):
    assert rules.catalogue(spark).count() == 57
    assert {t.name for t in corpus.TEMPLATES} >= {"Resize", "walk"}


def test_prompts(spark):
    row = spark.range(1).select(prompts.fence(F.lit("a <<<code b CODE>>> ")).alias("f"), prompts.sanitize(F.lit("x<|end|>\x01y")).alias("s"), prompts.truncate_prose(F.lit("One two. Three four! Five"), 1, 9).alias("p"), T.collapse(F.lit(" a \n b ")).alias("c")).first()
    assert row.f == "<<<CODE\na   b\nCODE>>>" and row.s == "xy" and row.p == "One two." and row.c == "a b"


def test_scan_and_rescan(spark, tmp_path):
    for name in ("a.cs", "b.CPP", "c.txt", "bin/d.cs", "sub/e.h"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("class C {}")
    assert files.scan(spark, str(tmp_path / "nowhere")).collect() == []
    found = files.scan(spark, str(tmp_path)).cache()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.cs", "b.CPP", "e.h"]
    assert files.changed(found, found).count() == 0 and files.still_there(found, found.limit(1)).count() == 1


def test_tree_and_newest(spark):
    tree = structure.path_tree(spark.createDataFrame([("a/b/c",), ("a/d",)], "path string"))
    assert {(r.node, r.files) for r in tree.collect()} == {("a", 2), ("a/b", 1), ("a/b/c", 1), ("a/d", 1)}
    assert structure.newest(spark.range(10), [F.col("id")], 5, 3).count() == 3


def test_throttle_stream_matches_batch(spark, tmp_path):
    from sourcegrain.streaming.throttle import throttle, throttle_stream

    rows = spark.createDataFrame([(i % 2, 1_000_000 * i, i) for i in range(20)], "key long, us long, seq long").select("key", F.timestamp_micros("us").alias("ts"), "seq")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = throttle_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 5_000_000)
    query = stream.writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.seq for r in spark.table("throttled").collect()) == sorted(r.seq for r in throttle(rows, 5_000_000).collect()) == [0, 1, 6, 7, 12, 13, 18, 19]


def test_numbers_of_28_digits(spark):
    cases = {
        "if (x > 99999999999999999999999) throw new E();": "99999999999999999999999 or less", "if (x < 0.0000000000000000000000000001m) throw new E();": "0.0000000000000000000000000001 or greater",
        "if (x < -12345678901234567890.5 || x > 79228162514264337593543950335) throw new E();": "-12345678901234567890.5 to 79228162514264337593543950335", "if (x > 79228162514264337593543950336) throw new E();": "any decimal number",
        "if (x <= -0.25 || x >= 10.50) throw new E();": "greater than -0.25, less than 10.5", "if (x < -3) throw new E(); if (x < -2.75) throw new E();": "-2.75 or greater", "x = Math.Clamp(x, -0.5, 0.5);": "-0.5 to 0.5", "if (x < 1000000) throw new E();": "1000000 or greater",
    }
    rows = spark.createDataFrame([(i, "Sample", "Operate", "void", "C#", ["decimal x"], "{ " + b + " }", [], [], [], [], [], []) for i, b in enumerate(cases)], SCHEMA)
    assert {r.method_id: r["limit"] for r in limits.variable_limits(rows).collect()} == dict(enumerate(cases.values()))
