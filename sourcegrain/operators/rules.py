"""The inference rules: what a method requires, ensures, changes, risks and depends on.

A rule is an expression over one row of methods that gives an array of
findings. An analyser concatenates its rules' arrays in order and, where it is
first-wins distinct, filters them within the row, so any number of analysers
is evaluated in one pass over the methods, without joins or shuffles. What the
rules ask of a body is extracted once a row by constant patterns (`prepared`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing
from ..functions import text as T
from . import wording

FINDING = "array<struct<kind:string,subject:string,description:string,confidence:string>>"


def finding(description, confidence: str | Column = "High", subject: Column | None = None, kind: str | Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(kind).cast("string").alias("kind"), (F.lit(None) if subject is None else subject).cast("string").alias("subject"), lit(description).cast("string").alias("description"), lit(confidence).alias("confidence"))


def when(condition: Column, *findings: Column) -> Column:
    return F.when(condition, F.array(*findings)).otherwise(F.array().cast(FINDING))


def each(values: Column, make: Callable[[Column], Column]) -> Column:
    return F.transform(values, make)


def say(template: str, *values: Column) -> Column:
    """The template with each {} replaced in turn."""
    parts = template.split("{}")
    out: list[Column] = [F.lit(parts[0])]
    for value, text in zip(values, parts[1:], strict=True):
        out += [value, F.lit(text)]
    return F.concat(*out)


@dataclass(frozen=True)
class Rule:
    id: str
    build: Callable[[], Column]
    needs_body: bool = True

def _column(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


# Columns are made when a rule is built, as that needs a session. facts and guards are those of prepared().
body, params, name_, returns, facts, guarded_heads = map(_column, ("body", "parsed", "method_name", "return_type", "facts", "blocks.guards"))
fields, thrown, op_limits, class_dependencies = map(_column, ("fields", "thrown", "op_limits", "class_dependencies"))


def has_body() -> Column:
    return F.coalesce(F.trim(body()) != "", F.lit(False))


_IF = r"if\s*\(\s*" + T.IDENT


def _guarded(template: str, *conditions: str) -> Callable[[], Column]:
    return lambda: each(T.guards(guarded_heads(), *conditions), lambda n: finding(say(template, n), subject=n))


def _parameters(template: str, keep: Callable[[Column], Column], confidence: str = "Medium") -> Callable[[], Column]:
    return lambda: each(F.filter(params(), keep), lambda p: finding(say(template, p["name"]), confidence, p["name"]))


def _is_parameter(name: Column) -> Column:
    return F.exists(params(), lambda p: p["name"] == name)


def _guard_zero() -> Column:
    def one(n: Column) -> Column:
        who = F.when(_is_parameter(n), say("Parameter {}", n)).otherwise(say("Value {}, computed in this method,", n))
        why = F.when(T.used_as_divisor(facts(), n), "; division by zero will throw an exception").otherwise("; the method throws when it is zero")
        return finding(F.concat(who, F.lit(" must not be zero"), why), subject=n)

    return each(T.guards(guarded_heads(), _IF + r"\s*==\s*0\s*\)"), one)


_NULL = "Parameter {} must not be null before calling this method"
_EMPTY = "Parameter {} must not be null or empty before calling this method"


def _throw_if_null() -> Column:
    pattern = r"(?U)\b(?:ArgumentNullException\.)?ThrowIfNull(OrEmpty|OrWhiteSpace)?\s*\(\s*" + T.IDENT + r"\s*\)"
    kinds, names = (F.regexp_extract_all(body(), F.lit(pattern), F.lit(i)) for i in (1, 2))
    return each(F.arrays_zip(kinds.alias("k"), names.alias("n")), lambda r: finding(F.when(r["k"] == "", say(_NULL, r["n"])).otherwise(say(_EMPTY, r["n"])), subject=r["n"]))


def _range_check() -> Column:
    names = T.guards(guarded_heads(), *[_IF + rf"\s*{op}\s*[^)]+\)" for op in ("<", ">", "<=", ">=")], _IF + r"\s*<\s*[^|]+\|\|\s*\1\s*>\s*[^)]+\)")
    return each(F.filter(names, _is_parameter), lambda n: finding(say("Parameter {} must be within the valid range accepted by this method", n), subject=n))


def _count_check() -> Column:
    empty = T.guards(guarded_heads(), _IF + r"\.Count\s*==\s*0\s*\)", _IF + r"\.size\s*\(\s*\)\s*==\s*0\s*\)", _IF + r"\.Length\s*==\s*0\s*\)")
    return each(F.filter(params(), lambda p: T.is_collection(p["type"]) & F.array_contains(empty, p["name"])), lambda p: finding(say("Parameter {} must contain at least one element before calling this method", p["name"]), subject=p["name"]))


def _typed(template: str, keep: Callable[[Column], Column], confidence: str) -> Callable[[], Column]:
    return lambda: each(F.filter(params(), keep), lambda p: finding(say(template, p["name"], T.simple_type(p["type"])), confidence, p["name"]))


PRECONDITIONS = (
    Rule("guard-eq-zero", _guard_zero),
    Rule("guard-null", _guarded(_NULL, _IF + r"\s*==\s*null\s*\)")),
    Rule("guard-cpp-null", _guarded(_NULL, _IF + r"\s*==\s*nullptr\s*\)")),
    Rule("guard-lt-zero", _guarded("Parameter {} must not be negative; negative values are rejected", _IF + r"\s*<\s*0\s*\)")),
    Rule("guard-lte-zero", _guarded("Parameter {} must be greater than zero; zero or negative values are rejected", _IF + r"\s*<=\s*0\s*\)")),
    Rule("guard-empty-string", _guarded(
        _EMPTY, _IF + r'\s*==\s*""\s*\)', _IF + r"\s*==\s*string\.Empty\s*\)", *[r"if\s*\(\s*string\.IsNullOr" + w + r"\s*\(\s*" + T.IDENT + r"\s*\)\s*\)" for w in ("Empty", "WhiteSpace")], _IF + r"\.empty\s*\(\s*\)\s*\)")),
    Rule("throw-if-null", _throw_if_null),
    Rule("param-type-numeric", _parameters("Parameter {} should be a finite numeric value; NaN and Infinity may produce unexpected results", lambda p: T.is_floating(p["type"])), False),
    Rule("param-type-string", _parameters("Parameter {} should not be null or empty when passed into this method", lambda p: T.is_string(p["type"]) & ~T.has_null_guard(facts(), body(), p["name"]))),
    Rule("param-type-index", _parameters("Parameter {} must be within valid index bounds for the accessed collection", lambda p: T.is_numeric(p["type"]) & T.used_as_index(facts(), body(), p["name"]))),
    Rule("param-type-collection", _parameters("Parameter {} must not be null and should contain at least one element if iterated", lambda p: T.is_collection(p["type"]) & T.iterated(facts(), body(), p["name"]))),
    Rule("param-sqrt", _parameters("Parameter {} passed to square root should be non-negative; negative values produce NaN", lambda p: T.rooted(facts(), p["name"]), "High")),
    Rule("param-file-io", lambda: when(
        T.has(body(), "File.Read", "File.Write", "File.Open", "StreamReader", "StreamWriter", "ifstream", "ofstream", "fopen("),
        finding("File path parameter must point to an accessible file; throws if file does not exist or access is denied", "Medium"))),
    Rule("parser-operational-limit", lambda: each(
        F.filter(F.transform(op_limits(), lambda l: wording.limit_sentence(l, params(), facts(), body())), lambda l: l != ""),
        lambda l: finding(l, subject=F.nullif(F.regexp_extract(l, r"Parameter\s+(\w+)\s+", 1), F.lit("")))), False),
    Rule("guard-range-check", _range_check),
    Rule("param-bool-flag", _parameters("Parameter {} is a boolean flag that controls method behavior", lambda p: F.upper(p["type"]) == "BOOL", "Low"), False),
    Rule("param-enum-type", _typed("Parameter {} must be a valid {} value recognized by this method", lambda p: T.is_class_like(p["type"]) & ~T.is_string(p["type"]), "Medium"), False),
    Rule("guard-string-length", _guarded(
        "Parameter {} must not be empty; minimum length is required", _IF + r"\.Length\s*==\s*0\s*\)", _IF + r"\.Length\s*<\s*\d+\s*\)", _IF + r"\.length\s*\(\s*\)\s*==\s*0\s*\)", _IF + r"\.length\s*\(\s*\)\s*<\s*\d+\s*\)", _IF + r"\.size\s*\(\s*\)\s*==\s*0\s*\)")),
    Rule("guard-count-check", _count_check),
    Rule("param-object-type", _typed("Parameter {} must be a properly initialized {} instance", lambda p: T.is_class_like(p["type"]) & ~T.has_null_guard(facts(), body(), p["name"]), "Low")),
    Rule("guard-try-pattern", lambda: when(F.trim(body()).rlike(r"(?i)^try\s*\{") & body().rlike(r"(?i)\bcatch\s*\("), finding("This method handles exceptions internally; callers do not need to wrap it in try-catch", "Medium"))),
)

#: Sentences by pattern of the method's name, the first that applies (pattern in upper case, not pattern, sentence).
_BY_NAME = (
    ("MULTIPLY|MUL", None, "Returns the product of the provided values"),
    ("SUBTRACT|SUB", "SUBSCRIPTION", "Returns the difference of the provided values"),
    ("ADD|SUM", "ADDRESS", "Returns the sum of the provided values"),
    ("^GET", None, "Returns the requested value; does not modify state"),
    ("^(?:SET|UPDATE)", None, "Modifies internal state; no return value or returns confirmation"),
    ("^(?:ADD|INSERT)", None, "Adds an element to the collection or data store"),
    ("^(?:REMOVE|DELETE)", None, "Removes the specified element if it exists"),
    ("^(?:SAVE|WRITE)", None, "Persists data; may throw if write fails"),
    ("^(?:LOAD|READ)", None, "Retrieves data from storage; may throw if source is unavailable"),
    ("^(?:CALCULATE|COMPUTE)", None, "Returns a computed result based on the provided inputs"),
    ("^(?:IS|HAS|CAN)", None, "Returns a boolean indicating whether the condition holds"),
)
_NAMED = "DIV|MUL|SUB|SUM|^(?:GET|SET|UPDATE|ADD|INSERT|REMOVE|DELETE|SAVE|WRITE|LOAD|READ|CALCULATE|COMPUTE|IS|HAS|CAN)"


def _name_pattern() -> Column:
    upper, first, second = F.upper(name_()), F.get(params(), F.lit(0))["name"], F.get(params(), F.lit(1))["name"]
    out = F.when(upper.contains("DIV") & (F.size(params()) >= 2), say("Returns the result of dividing {} by {} as a {} value", first, second, T.type_name(returns())))
    out = out.when(upper.contains("DIV"), F.lit("Returns the quotient; result is undefined if divisor is zero"))
    for pattern, but, sentence in _BY_NAME:
        out = out.when(upper.rlike(pattern) & (~upper.contains(but) if but else F.lit(True)), F.lit(sentence))
    return F.filter(F.array(finding(out)), lambda f: f["description"].isNotNull())


def _return_type() -> Column:
    sentence = (
        F.when(T.is_void(returns()), "This method performs an action and returns no value")
        .when(F.upper(returns()) == "BOOL", "Returns true if the operation succeeded, false otherwise")
        .when(T.is_floating(returns()) | T.is_numeric(returns()), say("Returns a numeric result as {}", T.type_name(returns())))
        .when(T.is_string(returns()), "Returns a text value; may return null if no value is found")
        .when(T.is_collection(returns()), "Returns a collection; may be empty but not null")
    )
    computed = F.when(has_body() & T.matches(body(), r"\breturn\b"), say("Returns a computed {} result based on the method inputs", T.type_name(returns())))
    one = finding(F.coalesce(sentence, computed), F.when(sentence.isNull(), "Medium").otherwise("High"))
    return F.filter(F.array(one), lambda f: ~F.upper(name_()).rlike(_NAMED) & f["description"].isNotNull())


_CONSOLE = lambda: T.has(body(), "Console.", "std::cout", "printf(")
_WRITES_FIELD = lambda: F.exists(fields(), lambda f: T.written(facts(), f["name"]))

POSTCONDITIONS = (
    Rule("post-name-pattern", _name_pattern, False),
    Rule("post-return-type", _return_type, False),
    # The wording of fixed sentences is kept letter by letter.
    Rule("post-throw-present", lambda: when((F.size(thrown()) > 0) | (has_body() & T.matches(body(), r"\bthrow\b")), finding("May throw an exception under certain input conditions. cee Errors section for details")), False),
    Rule("post-state-mutation", lambda: when(_WRITES_FIELD(), finding("Modifies internal object state; call GetX() methods after this to observe changes"))),
    Rule("post-async", lambda: when(F.upper(name_()).contains("ASYNC") | F.upper(returns()).contains("TASK"), finding("Executes asynchronously; the caller must await this method to observe the result", "Medium")), False),
    Rule("post-constructor", lambda: when((name_() == F.col("class_name")) & (name_() != ""), finding("Initializes a new instance of the object with the provided parameter values")), False),
    Rule("post-loop-result", lambda: when(~T.is_void(returns()) & body().rlike(r"(?iU)\bforeach\b|\bfor\s*\(|\bwhile\s*\("), finding("Processes multiple elements and returns an aggregated or transformed result", "Medium"))),
    Rule("post-console-side-effect", lambda: when(_CONSOLE(), finding("Produces visible output to the console as a side effect of execution"))),
    Rule("post-power-sqrt", lambda: when(T.is_floating(returns()) & body().rlike(r"(?iU)\b(?:pow|sqrt)\s*\("), finding("Returns a mathematically computed numeric result; may return NaN for invalid inputs"))),
)


def _changed_fields(template: str, kind: str, how: str) -> Callable[[], Column]:
    return lambda: each(F.filter(fields(), lambda f: F.array_contains(facts()[how], f["name"])), lambda f: finding(say(template, f["name"]), "High", f["name"], kind))


STATE_CHANGES = (
    Rule("field-increment", _changed_fields("Internal field {} is incremented or decremented by this method", "ObjectStateModified", "stepped")),
    Rule("field-assignment", _changed_fields("Internal field {} is assigned a new value by this method", "FieldModified", "assigned")),
    Rule("collection-modify", lambda: when(T.matches(body(), r"\.(?:Add|Remove|Push_back|Pop_back|Insert|Erase)\s*\("), finding("A collection owned or passed into this method is modified", kind="CollectionModified"))),
    Rule("console-output", lambda: when(_CONSOLE(), finding("Writes output to the console during method execution", kind="ConsoleOutput"))),
    Rule("file-write", lambda: when(T.has(body(), "File.Write", "File.Open", "fstream", "ofstream", "fopen("), finding("Performs a file write or open-for-write operation on disk", "Medium", kind="FileWrite"))),
    Rule("database-write", lambda: when(body().rlike(r"(?iU)\b(?:ExecuteNonQuery|SaveChanges|INSERT\s+INTO|UPDATE\s+\w+)\b"), finding("Performs a database write operation that persists changed data", "Medium", kind="DatabaseWrite"))),
    Rule("network-call", lambda: when(T.has(body(), "HttpClient", "WebRequest", "curl_", "socket("), finding("Makes a network call to an external service or remote host", "Medium", kind="NetworkCall"))),
    Rule("async-state", lambda: when(body().contains("await "), finding("Awaits one or more asynchronous operations during execution", "Medium", kind="NetworkCall"))),
    Rule("exception-swallowed", lambda: when(F.col("blocks.swallows"), finding("Catches exceptions internally. come error conditions may be silently handled", "Medium", kind="ObjectStateModified"))),
)


def _divides(p: Column) -> Column:
    n = p["name"]
    guarded = body().contains(F.concat(F.lit("if ("), n)) | body().contains(F.concat(F.lit("if("), n)) | body().contains(F.concat(n, F.lit(" != 0"))) | body().contains(F.concat(n, F.lit(" > 0")))
    return F.array_contains(facts()["plain_divisors"], n) & ~guarded


def _dereferences(p: Column) -> Column:
    n = p["name"]
    guarded = F.lit(False)
    for tail in (" == null", " != null", " == nullptr"):
        guarded = guarded | body().contains(F.concat(n, F.lit(tail)))
    return (body().contains(F.concat(n, F.lit("."))) | body().contains(F.concat(n, F.lit("->")))) & ~guarded & ~body().contains(F.concat(F.lit("ThrowIfNull("), n))


# In risks, kind holds the type of the exception.
RUNTIME_RISKS = (
    Rule("divide-by-zero", lambda: each(F.filter(params(), _divides), lambda p: finding(say("Possible divide-by-zero when '{}' is zero.", p["name"]), "Medium"))),
    Rule("int-parse", lambda: when(T.matches(body(), r"\bint\.Parse\s*\("), finding("int.Parse may throw on invalid input.", kind="FormatException"), finding("int.Parse may overflow for out-of-range values.", "Medium", kind="OverflowException"))),
    Rule("file-open", lambda: when(
        T.has(body(), "File.Open", "fopen("), finding("File open may fail if the path is missing or inaccessible.", "Medium", kind="IOException"),
        finding("File open may be denied due to permissions.", "Medium", kind="UnauthorizedAccessException"), finding("File open may fail when the file does not exist.", "Medium", kind="FileNotFoundException"))),
    Rule("parser-thrown", lambda: each(thrown(), lambda t: finding(say("Method may throw {}.", t), kind=t)), False),
    Rule("null-dereference", lambda: each(F.filter(params(), _dereferences), lambda p: finding(
        say("Possible null dereference on '{}'.", p["name"]), "Low", kind=F.when(F.col("language") == "C++", "undefined behavior").otherwise("NullReferenceException")))),
)

_DATABASE = r"\b(?:SqlConnection|DbContext|ExecuteNonQuery|SaveChanges)\b"
_MUTATOR = r"\.(?:Add|Remove|Push_back|Insert|Erase)\s*\("


def _recursion() -> Column:
    brace = F.instr(body(), "{")
    calls = lambda text: F.array_contains(T.found(text, r"\b" + T.IDENT + r"\s*\("), name_())
    # What stands before the first brace is the signature, if it names the method.
    inner = F.when((brace > 1) & calls(F.substring(body(), F.lit(1), brace - 1)), F.substring(body(), brace + 1, F.length(body()))).otherwise(body())
    return when((brace > 0) & calls(inner), finding("Calls itself recursively.", kind="UsesRecursion"))


def _pure() -> Column:
    impure = has_body() & (T.has(body(), "Console.", "std::cout", "File.", "fstream", "HttpClient") | T.matches(body(), _DATABASE) | _WRITES_FIELD() | T.matches(body(), _MUTATOR))
    sure = F.when(has_body(), "Medium").otherwise("Low")
    seen = F.when(has_body(), "No side effects detected from current rules.").otherwise("Assumed pure; no method body available for side-effect scan.")
    return F.when(F.coalesce(impure, F.lit(False)), F.array(finding("Method has observable side effects.", kind="Impure"))).otherwise(F.array(finding(seen, sure, kind="Pure"), finding("Does not modify tracked fields or collections.", sure, kind="Stateless")))


DESIGN_CONSTRAINTS = (
    Rule("uses-console", lambda: when(T.has(body(), "Console.", "std::cout"), finding("Uses console output.", kind="UsesConsole"))),
    Rule("uses-files", lambda: when(T.has(body(), "File.", "fstream"), finding("Uses file I/O.", kind="UsesFiles"))),
    Rule("uses-database", lambda: when(T.matches(body(), _DATABASE), finding("Uses database APIs.", kind="UsesDatabase"))),
    Rule("uses-network", lambda: when(T.has(body(), "HttpClient", "WebRequest", "socket("), finding("Uses network APIs.", kind="UsesNetwork"))),
    Rule("uses-static", lambda: when(T.matches(body(), r"\b[A-Z][A-Za-z0-9_]*\.[A-Z][A-Za-z0-9_]*\s*\("), finding("Calls static members on a type.", "Medium", kind="UsesStaticMembers"))),
    Rule("uses-recursion", _recursion),
    Rule("uses-sync", lambda: when(T.has(body(), "lock (", "Monitor.", "std::mutex", "std::lock_guard"), finding("Uses thread synchronization.", kind="UsesThreadSynchronization"))),
    Rule("stateful", lambda: F.when(_WRITES_FIELD(), F.array(finding("Mutates instance or class state.", kind="Stateful"))).otherwise(when(T.matches(body(), _MUTATOR), finding("Mutates a collection.", kind="Stateful")))),
    Rule("pure-impure", _pure, False),
)

#: Words before "(" that aren't calls.
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "new", "sizeof", "typeof")
#: Fixed values: (pattern, name) of external interfaces.
EXTERNAL = (
    (r"\bConsole\.\w+", "Console"), (r"\bFile\.\w+", "System.IO.File"), (r"\bDirectory\.\w+", "System.IO.Directory"), (r"\bHttpClient\b", "System.Net.Http.HttpClient"),
    (r"\bSqlConnection\b", "System.Data.SqlClient.SqlConnection"), (r"\bstd::\w+", "std"), (r"\bfopen\s*\(", "fopen"), (r"\bprintf\s*\(", "printf"),
)


def _names(pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(body(), F.lit("(?U)" + pattern), F.lit(1)))


def _as_subjects(names: Column, kind: str, confidence: str) -> Column:
    return each(names, lambda n: finding(n, confidence, n, kind))


DEPENDENCY_RULES = (
    Rule("method-calls", lambda: _as_subjects(F.filter(_names(r"\b" + T.IDENT + r"\s*\("), lambda n: ~n.isin(*KEYWORDS) & (n != name_())), "MethodCall", "Medium")),
    Rule("external-apis", lambda: _as_subjects(F.filter(F.array(*[F.when(T.matches(body(), p), F.lit(n)) for p, n in EXTERNAL]), lambda n: n.isNotNull()), "ExternalApi", "High")),
    Rule("class-dependencies", lambda: _as_subjects(class_dependencies(), "ReferencedClass", "High"), False),
    Rule("namespaces", lambda: _as_subjects(
        F.array_distinct(F.concat(_names(r"\b" + T.IDENT + r"\s*::\s*[A-Za-z_][\w]*"), F.filter(_names(r"\b" + T.IDENT + r"\.[A-Za-z_][\w]*\s*\("), lambda n: n != "this"))), "Namespace", "Medium")),
)

#: Analyser: its rules and what its findings are first-wins distinct by, if by anything.
ANALYZERS: dict[str, tuple[tuple[Rule, ...], Callable[[Column], Column] | None]] = {
    "preconditions": (PRECONDITIONS, lambda f: F.upper(F.concat(F.coalesce(f["subject"], F.lit("")), F.lit("|"), f["description"]))),
    "postconditions": (POSTCONDITIONS, lambda f: F.upper(f["description"])),
    "state_changes": (STATE_CHANGES, None),
    "runtime_risks": (RUNTIME_RISKS, None),
    "design_constraints": (DESIGN_CONSTRAINTS, None),
    "dependencies": (DEPENDENCY_RULES, None),
}


ROW = "array<struct<analyzer:string,rule_id:string,emit_ord:int,f:struct<kind:string,subject:string,description:string,confidence:string>>>"


def register(analyzer: str, rule: Rule, analyzers=None) -> dict:
    """The analysers with a rule added at the end of one of them, or of a new one."""
    analyzers = ANALYZERS if analyzers is None else analyzers
    rules, key = analyzers.get(analyzer, ((), None))
    return {**analyzers, analyzer: ((*rules, rule), key)}


def prepared(methods: DataFrame) -> DataFrame:
    """methods with parsed (type and name of parameters), facts and blocks of the body. A body beyond the budget of matches counts as
    none; not_analysed() names it."""
    return methods.withColumn("body", T.within_budget(F.col("body"))).withColumns({"parsed": T.parse_parameters(F.col("params")), "facts": T.facts(F.col("body")), "blocks": lexing.guards_of(F.col("body"))})


BUDGET_EXCEEDED = "Body not analysed: its long words or blanks exceed the budget of matches"


def not_analysed(methods: DataFrame) -> DataFrame:
    """method_id, error of the methods whose body is beyond the budget of matches (text.MATCH_STEPS)."""
    return methods.filter(F.col("body").isNotNull() & (T.match_steps(F.col("body")) > T.MATCH_STEPS)).select("method_id", F.lit(BUDGET_EXCEEDED).alias("error"))


def _tagged(found: Column, rule_id: str) -> Column:
    return F.transform(found, lambda f: F.struct(F.lit(rule_id).alias("rule_id"), f.alias("f")))


def _found(analyzer: str, analyzers: dict) -> Column:
    """The findings of one analyser as an array, in the order of its rules."""
    rules, key = analyzers[analyzer]
    groups = []
    for rule in rules:
        found = rule.build().cast(FINDING)
        if rule.needs_body:
            found = F.when(has_body(), found).otherwise(F.array().cast(FINDING))
        groups.append(_tagged(found, rule.id))
    every = F.transform(F.concat(*groups), lambda r, i: F.struct(F.lit(analyzer).alias("analyzer"), r["rule_id"].alias("rule_id"), i.alias("emit_ord"), r["f"].alias("f"))).cast(ROW)
    if key is None:
        return every
    # The first finding of a key wins.
    first = lambda x: F.filter(x["rows"], lambda r, i: F.array_position(x["keys"], F.get(x["keys"], i)) == i + 1)
    return T.bind(every, lambda rows: T.bind(F.struct(rows.alias("rows"), F.transform(rows, lambda r: key(r["f"])).alias("keys")), first))


def analyses(methods: DataFrame, names=None, analyzers=None) -> DataFrame:
    """method_id, analyzer, rule_id, emit_ord, kind, subject, description, confidence: the analysers (by default all)
    in one pass over the methods. Methods with one id, or none, are each their own. No methods: no rows."""
    analyzers = ANALYZERS if analyzers is None else analyzers
    rows = prepared(methods).select("method_id", F.explode(F.concat(*[_found(a, analyzers) for a in names or analyzers])).alias("r"))
    return rows.select("method_id", "r.analyzer", "r.rule_id", "r.emit_ord", "r.f.kind", "r.f.subject", "r.f.description", "r.f.confidence")


def findings(methods: DataFrame, analyzer: str, analyzers=None) -> DataFrame:
    """analyses() of one analyser, without its name."""
    return analyses(methods, [analyzer], analyzers).drop("analyzer")


def _scoped(variables: Column, scope: str, blind: str) -> Column:
    return F.transform(variables, lambda v: F.struct(v["name"].alias("name"), v["type"].alias("type"), F.lit(scope).alias("scope"), F.when(has_body(), "High").otherwise(blind).alias("confidence")))


def variable_usage(methods: DataFrame) -> DataFrame:
    """method_id, name, type, scope, usage, confidence of parameters, locals, fields and properties."""
    scopes = [_scoped(F.col(c), scope, blind) for c, scope, blind in (("parsed", "Parameter", "Low"), ("locals", "Local", "Medium"), ("fields", "Field", "Low"), ("properties", "Property", "Low"))]
    rows = methods.withColumn("body", T.within_budget(F.col("body"))).withColumns({"parsed": T.parse_parameters(F.col("params")), "facts": T.facts(F.col("body"))})
    every = F.transform(F.concat(*scopes), lambda v: F.struct(v["name"].alias("name"), v["type"].alias("type"), v["scope"].alias("scope"), T.usage(facts(), body(), v["name"]).alias("usage"), v["confidence"].alias("confidence")))
    return rows.select("method_id", F.inline(every))


def catalogue(spark) -> DataFrame:
    """analyzer, rule_ord, rule_id of every rule."""
    rows = [(a, i, r.id) for a, (rules, _) in ANALYZERS.items() for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "analyzer string, rule_ord int, rule_id string")
