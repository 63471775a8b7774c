"""All analysers over methods whose names, types and clauses are chosen independently, with SQL that derives the findings.

A method has a name, a return type and one clause of each group, each by a digit of its own; texts hold the words, brand
and size of a part. What a clause gives by itself is stated with it; what rests on the whole method (its purity,
its state, its loops) is derived in SQL from the marks of its clauses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from . import corpus

QUERIES, SQL = {}, {}

#: (name, sentence by its pattern), (return type, its sentence).
NAMES = (
    ("Run{w}", None), ("Get{w}", "Returns the requested value; does not modify state"), ("Save{w}", "Persists data; may throw if write fails"), ("Load{w}", "Retrieves data from storage; may throw if source is unavailable"), ("Is{w}", "Returns a boolean indicating whether the condition holds"),
)
RETURNS = (
    ("void", "This method performs an action and returns no value"), ("bool", "Returns true if the operation succeeded, false otherwise"), ("int", "Returns a numeric result as int"), ("double", "Returns a numeric result as double"), ("string", "Returns a text value; may return null if no value is found"),
    ("List<int>", "Returns a collection; may be empty but not null"), ("Task", None),
)

_P, _S, _R, _D, _C = "preconditions", "state_changes", "runtime_risks", "design_constraints", "dependencies"
_RANGE = (_P, "guard-range-check", None, "{v}", "Parameter {v} must be within the valid range accepted by this method", "High")
_TEXT = (_P, "param-type-string", None, "{a}t", "Parameter {a}t should not be null or empty when passed into this method", "Medium")
_STATIC = (_D, "uses-static", "UsesStaticMembers", None, "Calls static members on a type.", "Medium")
_FILE = (
    (_P, "param-file-io", None, None, "File path parameter must point to an accessible file; throws if file does not exist or access is denied", "Medium"), (_S, "file-write", "FileWrite", None, "Performs a file write or open-for-write operation on disk", "Medium"),
    (_D, "uses-files", "UsesFiles", None, "Uses file I/O.", "High"), _STATIC, (_C, "external-apis", "ExternalApi", "System.IO.File", "System.IO.File", "High"),
)


def _call(*names):
    return tuple((_C, "method-calls", "MethodCall", n, n, "Medium") for n in names)


def _space(name):
    return ((_C, "namespaces", "Namespace", name, name, "Medium"),)


#: Groups of clauses: (text, parameters it needs, findings (analyser, rule, kind, subject, sentence, confidence), marks).
CLAUSES = (
    (
        ("if ({v} == 0) { throw new E(); }", ("int {v}",), ((_P, "guard-eq-zero", None, "{v}", "Parameter {v} must not be zero; the method throws when it is zero", "High"), *_call("E")), "throws"),
        ("if ({v} < 0) { throw new E(); }", ("int {v}",), ((_P, "guard-lt-zero", None, "{v}", "Parameter {v} must not be negative; negative values are rejected", "High"), _RANGE, *_call("E")), "throws"),
        ("if ({v} <= 0) { Use(0); throw new E(); }", ("int {v}",), ((_P, "guard-lte-zero", None, "{v}", "Parameter {v} must be greater than zero; zero or negative values are rejected", "High"), _RANGE, *_call("E", "Use")), "throws"),
        ("if ({v} < 1 || {v} > {n}) { throw new E(); }", ("int {v}",), (_RANGE, *_call("E")), "throws"), ("Use({v});", ("int {v}",), _call("Use"), ""),
    ),
    (
        ("if ({a}t == null) { throw new E(); }", ("string {a}t",), ((_P, "guard-null", None, "{a}t", "Parameter {a}t must not be null before calling this method", "High"), *_call("E")), "throws"),
        ("if (string.IsNullOrEmpty({a}t)) { throw new E(); }", ("string {a}t",), ((_P, "guard-empty-string", None, "{a}t", "Parameter {a}t must not be null or empty before calling this method", "High"), _TEXT, *_call("IsNullOrEmpty", "E"), *_space("string")), "throws"),
        ("if ({a}t.Length < 3) { throw new E(); }", ("string {a}t",), ((_P, "guard-string-length", None, "{a}t", "Parameter {a}t must not be empty; minimum length is required", "High"), _TEXT, (_R, "null-dereference", "NullReferenceException", None, "Possible null dereference on '{a}t'.", "Low"), *_call("E")), "throws"),
        ("ArgumentNullException.ThrowIfNull({a}t);", ("string {a}t",), ((_P, "throw-if-null", None, "{a}t", "Parameter {a}t must not be null before calling this method", "High"), _STATIC, *_call("ThrowIfNull"), *_space("ArgumentNullException")), ""), ("Use({a}t);", ("string {a}t",), (_TEXT, *_call("Use")), ""),
    ),
    (
        ("Console.WriteLine({n});", (), ((_S, "console-output", "ConsoleOutput", None, "Writes output to the console during method execution", "High"), (_D, "uses-console", "UsesConsole", None, "Uses console output.", "High"), _STATIC, *_call("WriteLine"), (_C, "external-apis", "ExternalApi", "Console", "Console", "High"), *_space("Console")), "console impure"),
        ("File.WriteAllText({b}p, {n});", (), (*_FILE, *_call("WriteAllText"), *_space("File")), "impure"),
        (
            "var {b}f = File.Open({b}p);", (),
            (*_FILE, (_R, "file-open", "IOException", None, "File open may fail if the path is missing or inaccessible.", "Medium"), (_R, "file-open", "UnauthorizedAccessException", None, "File open may be denied due to permissions.", "Medium"), (_R, "file-open", "FileNotFoundException", None, "File open may fail when the file does not exist.", "Medium"), *_call("Open"), *_space("File")), "impure",
        ),
        ("{b}s.Add({n});", (), ((_S, "collection-modify", "CollectionModified", None, "A collection owned or passed into this method is modified", "High"), *_call("Add"), *_space("{b}s")), "mutates impure"),
        ("db.SaveChanges();", (), ((_S, "database-write", "DatabaseWrite", None, "Performs a database write operation that persists changed data", "Medium"), (_D, "uses-database", "UsesDatabase", None, "Uses database APIs.", "High"), *_call("SaveChanges"), *_space("db")), "impure"),
        (
            "await web.Send({n}); var {b}w = new HttpClient();", (),
            ((_S, "async-state", "NetworkCall", None, "Awaits one or more asynchronous operations during execution", "Medium"), (_S, "network-call", "NetworkCall", None, "Makes a network call to an external service or remote host", "Medium"), (_D, "uses-network", "UsesNetwork", None, "Uses network APIs.", "High"), *_call("Send", "HttpClient"), (_C, "external-apis", "ExternalApi", "System.Net.Http.HttpClient", "System.Net.Http.HttpClient", "High"), *_space("web")), "impure",
        ),
        ("lock (gate) { Use({n}); }", (), ((_D, "uses-sync", "UsesThreadSynchronization", None, "Uses thread synchronization.", "High"), *_call("lock", "Use")), ""), ("Use({n});", (), _call("Use"), ""),
    ),
    (
        ("count++;", (), ((_S, "field-increment", "ObjectStateModified", "count", "Internal field count is incremented or decremented by this method", "High"),), "field impure"), ("count = {n};", (), ((_S, "field-assignment", "FieldModified", "count", "Internal field count is assigned a new value by this method", "High"),), "field impure"), ("", (), (), ""),
    ),
    (
        ("foreach (var o in {b}l) { Use(o); }", (), _call("foreach", "Use"), "loop"), ("try { Use(1); } catch (Exception) { Use(2); }", (), ((_S, "exception-swallowed", "ObjectStateModified", None, "Catches exceptions internally. come error conditions may be silently handled", "Medium"), *_call("Use")), ""),
        ("try { Use(1); } catch (Exception) { throw; }", (), _call("Use"), "throws"), ("var {b}q = Math.Sqrt({n});", (), (_STATIC, *_call("Sqrt"), *_space("Math")), "root"),
        ('int {b}k = int.Parse("{n}");', (), ((_R, "int-parse", "FormatException", None, "int.Parse may throw on invalid input.", "High"), (_R, "int-parse", "OverflowException", None, "int.Parse may overflow for out-of-range values.", "Medium"), *_call("Parse"), *_space("int")), ""), ("", (), (), ""),
    ),
    (
        ("total = total / {b}d;", ("int {b}d",), ((_R, "divide-by-zero", None, None, "Possible divide-by-zero when '{b}d' is zero.", "Medium"),), ""), ("if ({b}d > 0) { total = total / {b}d; }", ("int {b}d",), (), ""), ("", ("int {b}d",), (), "unused"),
    ),
)
GROUPS = (NAMES, RETURNS, *CLAUSES)


def methods(part):
    """One method per part."""
    digit = F.col("p_partkey") * corpus.SCRAMBLE % corpus.MODULUS
    one_of = lambda g, make: F.element_at(F.array(*map(make, GROUPS[g])), (F.floor(digit / corpus.digits(GROUPS)[g][0]) % len(GROUPS[g]) + 1).cast("int"))
    groups = range(2, len(GROUPS))
    params = F.flatten(F.array(*[one_of(g, lambda c: F.array(*map(corpus._worded, c[1])).cast("array<string>")) for g in groups]))
    body = F.concat(F.lit("{ "), F.concat_ws(" ", *[one_of(g, lambda c: corpus._worded(c[0])) for g in groups]), F.lit(" }"))
    none = F.array().cast("array<string>")
    return corpus.spread(part.select("p_partkey", "p_size", "p_brand", "p_name")).select(
        F.col("p_partkey").alias("method_id"), F.lit("Sample").alias("class_name"), one_of(0, lambda c: corpus._worded(c[0])).alias("method_name"), one_of(1, lambda c: F.lit(c[0])).alias("return_type"), F.lit("C#").alias("language"), params.alias("params"), body.alias("body"),
        corpus._variables((("count", "int"),)).alias("fields"), corpus._variables(()).alias("locals"), corpus._variables(()).alias("properties"), none.alias("thrown"), none.alias("op_limits"), none.alias("class_dependencies"),
    )


_PARTS = f"k AS (SELECT p_partkey AS method_id, p_size AS n, lower(replace(p_brand, '#', '')) AS v, replace(p_brand, '#', '') AS w, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey * {corpus.SCRAMBLE} % {corpus.MODULUS} AS d FROM part)"


def _text(template):
    if template is None:
        return "NULL"
    out = "'" + template.replace("'", "''") + "'"
    for name in "abvwn":
        out = f"replace({out}, '{{{name}}}', CAST({name} AS VARCHAR))" if "{" + name + "}" in template else out
    return out


def _chosen(g: int, i: int) -> str:
    step, size = corpus.digits(GROUPS)[g]
    return f"d // {step} % {size} = {i}"


def _any(mark: str) -> str:
    """Whether a clause of the method has a mark."""
    return "(" + " OR ".join(_chosen(g, i) for g in range(2, len(GROUPS)) for i, c in enumerate(GROUPS[g]) if mark in c[3].split()) + ")"


def _analyses_sql() -> str:
    row = lambda where, *f: f"SELECT {_text(f[0])} AS analyzer, method_id, {_text(f[1])} AS rule_id, {_text(f[2])} AS kind, {_text(f[3])} AS subject, {_text(f[4])} AS description, {_text(f[5])} AS confidence FROM k WHERE {where}"
    rows = [row(_chosen(g, i), *f) for g in range(2, len(GROUPS)) for i, c in enumerate(GROUPS[g]) for f in c[2]]
    after = lambda where, rule, sentence, confidence="High": rows.append(row(where, "postconditions", rule, None, None, sentence, confidence))
    design = lambda where, rule, kind, sentence, confidence="High": rows.append(row(where, _D, rule, kind, None, sentence, confidence))
    for i, (_, sentence) in enumerate(NAMES):
        if sentence:
            after(_chosen(0, i), "post-name-pattern", sentence)
    for i, (_, sentence) in enumerate(RETURNS):
        if sentence:
            after(f"{_chosen(0, 0)} AND {_chosen(1, i)}", "post-return-type", sentence)
    after(_any("throws"), "post-throw-present", "May throw an exception under certain input conditions. cee Errors section for details")
    after(_any("field"), "post-state-mutation", "Modifies internal object state; call GetX() methods after this to observe changes")
    after(_chosen(1, 6), "post-async", "Executes asynchronously; the caller must await this method to observe the result", "Medium")
    after(f"{_any('loop')} AND NOT {_chosen(1, 0)}", "post-loop-result", "Processes multiple elements and returns an aggregated or transformed result", "Medium")
    after(_any("console"), "post-console-side-effect", "Produces visible output to the console as a side effect of execution")
    after(f"{_any('root')} AND {_chosen(1, 3)}", "post-power-sqrt", "Returns a mathematically computed numeric result; may return NaN for invalid inputs")
    design(_any("field"), "stateful", "Stateful", "Mutates instance or class state.")
    design(f"{_any('mutates')} AND NOT {_any('field')}", "stateful", "Stateful", "Mutates a collection.")
    design(_any("impure"), "pure-impure", "Impure", "Method has observable side effects.")
    design(f"NOT {_any('impure')}", "pure-impure", "Pure", "No side effects detected from current rules.", "Medium")
    design(f"NOT {_any('impure')}", "pure-impure", "Stateless", "Does not modify tracked fields or collections.", "Medium")
    return f"WITH {_PARTS} SELECT DISTINCT * FROM (" + " UNION ALL ".join(rows) + ")"


def composed_analyses(spark, sf_dir):
    """All rules of all analysers over composed methods."""
    return rules.analyses(methods(spark.read.parquet(f"{sf_dir}/part.parquet"))).select("analyzer", "method_id", "rule_id", "kind", "subject", "description", "confidence")


def composed_usage(spark, sf_dir):
    """What composed methods do with their parameters and fields."""
    return rules.variable_usage(methods(spark.read.parquet(f"{sf_dir}/part.parquet")))


QUERIES |= {"composed_analyses": composed_analyses, "composed_usage": composed_usage}
SQL["composed_analyses"] = _analyses_sql()
SQL["composed_usage"] = f"""WITH {_PARTS} SELECT method_id, v AS name, 'int' AS type, 'Parameter' AS scope, 'Read' AS usage, 'High' AS confidence FROM k UNION ALL SELECT method_id, a || 't', 'string', 'Parameter', 'Read', 'High' FROM k
UNION ALL SELECT method_id, b || 'd', 'int', 'Parameter', CASE WHEN {_any("unused")} THEN 'Unused' ELSE 'Read' END, 'High' FROM k UNION ALL SELECT method_id, 'count', 'int', 'Field', CASE WHEN {_any("field")} THEN 'ReadWrite' ELSE 'Unused' END, 'High' FROM k"""
