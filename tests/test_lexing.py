"""The scanner of source text: literals, brackets, statements, and its time on hostile texts."""

import time

import pytest
from pyspark.sql import functions as F

from sourcegrain.functions import lexing


def kinds(text):
    return [(f["kind"], f["a"], f["b"], f["flag"]) for f in lexing.csharp_facts(text)]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("a // if (x)\nb", "a          \nb"),
        ("a /* x\n ' */ b", "a     \n      b"),
        ("a /* open", "a        "),
        ('x = "a\\"b{" + y;', 'x = "     " + y;'),
        ('x = @"a""b\\" + y;', 'x = @"     " + y;'),
        ('x = """a " b {""" + y;', 'x = "           " + y;'),
        ("c = '{'; d = '\\''; e = 1'000;", "c = ' '; d = '  '; e = 1'000;"),
        ('s = $"n {Get(1)} }} {d["k{"]} e";', 's = "    Get(1)      d["  "]   ";'),
        ('R"x(a)" { )x" + 1', 'R"          " + 1'),
        ('"open\nb', '"    \nb'),
        ("", ""),
        ("'", "'"),
    ],
)
def test_masked(text, code):
    assert lexing.masked(text).rstrip() == code.rstrip() and len(lexing.masked(text)) == len(text)


def test_comments_and_strings_are_no_code():
    text = '// if (x == null) throw; Console.WriteLine(1);\nstring s = "File.Delete(a); while (x)"; Console.Write(s);'
    assert kinds(text) == [("local", "s", None, False), ("call", "Console", "Write", True)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("if (a) { if (b) throw x; } else throw y;", [("if", True), ("if", True)]),
        ("if (a) Run(); else throw y;", []),
        ("if (a) b = () => { throw x; };", [("if", True)]),
        ("if (a) b = c ?? throw x;", []),
        ("for (;;) if (a) for (;;) Run(); while (b) { }", [("for", True), ("for", False), ("while", False)]),
        ("do { while (a) { } } while (b); foreach (var x in y) { }", [("while", False), ("foreach", False)]),
        ("try { try { } catch { throw; } } catch (E) { }", [("try", False), ("try", True)]),
        ("try { } catch (E e) when (e.X) { throw; } finally { }", [("try", True)]),
        ("try { throw x; } finally { throw y; }", [("try", False)]),
    ],
)
def test_statements(text, found):
    assert [(k, flag) for k, _, _, flag in kinds(text) if k in ("if", "for", "foreach", "while", "try")] == found


@pytest.mark.parametrize(
    ("text", "computes"),
    [
        ("x = a + b;", True), ("x = f(1, 2);", True), ("x = a.b(c).d();", True), ("x = -a;", False), ("x = a;", False), ("x = new List<int>(4);", False), ("x = new P { Y = 1 + 2 };", False), ("x = (a + b);", False),
        ("x = a ? b : c + d;", False), ("x = a ?? b;", True), ("x = await f();", False), ("x = a as string;", True), ("x = (int)f(a);", False), ("x = (int)a * 2;", True), ("x = y => y + 1;", False), ("x = a < b;", True),
        ("x = Make<int, string>(a);", True), ('x = "a + b";', False), ("x = a?.b();", False), ("x = f;", False), ("x = f(a + b)[1];", False),
    ],
)
def test_shapes(text, computes):
    assert next(flag for k, a, _, flag in kinds(text) if k == "set" and a == "x") == computes


def test_names_and_places():
    text = "int Run(int a) { var q = 1, r = f(2); this.count -= 3; rows[i + 1].x++; for (int i = 0, j = 1; ; ) { } Foo<int>(a); new Bar(a); Inner(a); void Inner(int b) { } return this.total; }"
    found = kinds(text)
    assert [a for k, a, *_ in found if k == "local"] == ["q", "r"]
    assert [(a, b) for k, a, b, _ in found if k == "set"] == [("count", "-=")]
    assert [a for k, a, _, _ in found if k == "call"] == ["f", "Inner"]
    assert ("return", "total", None, False) in found and [a for k, a, *_ in found if k == "step"] == ["x"]
    chain = [f for f in lexing.csharp_facts("a = b; x.Load(1).Save(2);") if f["kind"] == "call"]
    assert [(f["a"], f["b"], f["pos"]) for f in chain] == [("x.Load(1)", "Save", 7), ("x", "Load", 7)]


def test_brackets_of_any_depth():
    text = "{ if " + "(" * 40 + "n == 0" + ")" * 40 + " { throw new E(); } }"
    assert kinds(text)[0] == ("if", "(" * 39 + "n == 0" + ")" * 39, "( )", True)
    assert lexing.guard_facts(text)["guards"] == ["if " + "(" * 40 + "n == 0" + ")" * 40]
    assert kinds("if (a { b(] ) throw x; }") and kinds(")}] if (a) throw x;")[0][0] == "if"


@pytest.mark.parametrize(
    "text",
    [
        "{" + "for (int i = 0; i < 3; i++) { a(i); if (x) { throw; } }\n" * 5_000 + "}", "(" * 100_000, "if (" * 20_000, "{" * 50_000 + "}" * 50_000, "a" * 200_000, '"' * 100_001, '$"{' * 30_000, "/*" * 60_000, "try {" * 15_000,
        "x = " * 30_000, "a.b(" * 20_000 + ")" * 20_000, "if (a) " * 20_000 + "b();", "List<" * 30_000, "else if (a) { } " * 10_000,
    ],
    ids=range(14),
)
def test_hostile_texts_end_soon(text):
    began = time.perf_counter()
    lexing.csharp_facts(text), lexing.guard_facts(text), lexing.cpp_guards(text)
    assert time.perf_counter() - began < 8


def test_guards_of_cpp():
    text = 'if (a && f(b)) { log("throw"); } if (c /* x */ ==\n 0) throw E(); if (d) { if (e) throw F(); } // if (g) throw\n if (h) { x(); throw G(); }'
    assert lexing.cpp_guards(text) == ["c /* x */ == 0", "e", "h"]


def test_null_bodies(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "id long, body string")
    for r in rows.select(lexing.facts_of(F.col("body")).alias("f"), lexing.guards_of(F.col("body")).alias("g"), lexing.code_of(F.col("body")).alias("c")).collect():
        assert r.f == [] and r.g.guards == [] and not r.g.swallows and not r.c
