"""A corpus of methods written from the rows of `part`.

Each part becomes one method: its key picks a template, its size is the
number {n} in the template's text. The findings that a template must give are
stated with it, which makes the expected result a closed form over the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIABLES = "array<struct<name:string,type:string>>"


@dataclass(frozen=True)
class Template:
    name: str
    returns: str
    params: tuple[str, ...]
    body: str
    fields: tuple[tuple[str, str], ...] = ()
    locals: tuple[tuple[str, str], ...] = ()
    thrown: tuple[str, ...] = ()
    language: str = "C#"
    op_limits: tuple[str, ...] = ()
    class_dependencies: tuple[str, ...] = ()
    #: Analyser -> (rule_id, kind, subject, description, confidence) in order.
    expected: dict[str, tuple[tuple, ...]] = field(default_factory=dict)
    #: (name, type, scope, usage, confidence).
    usage: tuple[tuple, ...] = ()


_PURE = (("pure-impure", "Pure", None, "No side effects detected from current rules.", "Medium"), ("pure-impure", "Stateless", None, "Does not modify tracked fields or collections.", "Medium"))
_IMPURE = ("pure-impure", "Impure", None, "Method has observable side effects.", "High")
_THROWS = ("post-throw-present", None, None, "May throw an exception under certain input conditions. cee Errors section for details", "High")
_STATIC = ("uses-static", "UsesStaticMembers", None, "Calls static members on a type.", "Medium")


def _call(name: str) -> tuple:
    return ("method-calls", "MethodCall", name, name, "Medium")


def _space(name: str) -> tuple:
    return ("namespaces", "Namespace", name, name, "Medium")


TEMPLATES = (
    Template(
        "Resize", "void", ("int size",), "{ if (size < 1 || size > {n}) { throw new ArgumentException(); } Use(size); }", thrown=("ArgumentException",),
        expected={
            "preconditions": (("guard-range-check", None, "size", "Parameter size must be within the valid range accepted by this method", "High"),),
            "postconditions": (("post-return-type", None, None, "This method performs an action and returns no value", "High"), _THROWS),
            "runtime_risks": (("parser-thrown", "ArgumentException", None, "Method may throw ArgumentException.", "High"),),
            "design_constraints": _PURE,
            "dependencies": (_call("ArgumentException"), _call("Use")),
        },
        usage=(("size", "int", "Parameter", "Read", "High"),),
    ),
    Template(
        "DivideTotals", "double", ("double total", "int parts"), "{ if (parts == 0) { throw new DivideByZeroException(); } return total / parts; }", thrown=("DivideByZeroException",),
        expected={
            "preconditions": (
                ("guard-eq-zero", None, "parts", "Parameter parts must not be zero; division by zero will throw an exception", "High"),
                ("param-type-numeric", None, "total", "Parameter total should be a finite numeric value; NaN and Infinity may produce unexpected results", "Medium"),
            ),
            "postconditions": (("post-name-pattern", None, None, "Returns the result of dividing total by parts as a double value", "High"), _THROWS),
            "runtime_risks": (("parser-thrown", "DivideByZeroException", None, "Method may throw DivideByZeroException.", "High"),),
            "design_constraints": _PURE,
            "dependencies": (_call("DivideByZeroException"),),
        },
        usage=(("total", "double", "Parameter", "Read", "High"), ("parts", "int", "Parameter", "Read", "High")),
    ),
    Template(
        "Tick", "void", (), "{ count++; Console.WriteLine(count + {n}); }", fields=(("count", "int"),),
        expected={
            "postconditions": (
                ("post-return-type", None, None, "This method performs an action and returns no value", "High"),
                ("post-state-mutation", None, None, "Modifies internal object state; call GetX() methods after this to observe changes", "High"),
                ("post-console-side-effect", None, None, "Produces visible output to the console as a side effect of execution", "High"),
            ),
            "state_changes": (
                ("field-increment", "ObjectStateModified", "count", "Internal field count is incremented or decremented by this method", "High"),
                ("console-output", "ConsoleOutput", None, "Writes output to the console during method execution", "High"),
            ),
            "design_constraints": (("uses-console", "UsesConsole", None, "Uses console output.", "High"), _STATIC, ("stateful", "Stateful", None, "Mutates instance or class state.", "High"), _IMPURE),
            "dependencies": (_call("WriteLine"), ("external-apis", "ExternalApi", "Console", "Console", "High"), _space("Console")),
        },
        usage=(("count", "int", "Field", "ReadWrite", "High"),),
    ),
    Template(
        "ParseCode", "int", ("string code", "bool strict"), "{ ArgumentNullException.ThrowIfNull(code); var total = int.Parse(code); return total + {n}; }", locals=(("total", "int"),),
        expected={
            "preconditions": (
                ("throw-if-null", None, "code", "Parameter code must not be null before calling this method", "High"),
                ("param-bool-flag", None, "strict", "Parameter strict is a boolean flag that controls method behavior", "Low"),
            ),
            "postconditions": (("post-return-type", None, None, "Returns a numeric result as int", "High"),),
            "runtime_risks": (
                ("int-parse", "FormatException", None, "int.Parse may throw on invalid input.", "High"),
                ("int-parse", "OverflowException", None, "int.Parse may overflow for out-of-range values.", "Medium"),
            ),
            "design_constraints": (_STATIC, *_PURE),
            "dependencies": (_call("ThrowIfNull"), _call("Parse"), _space("ArgumentNullException"), _space("int")),
        },
        usage=(("code", "string", "Parameter", "Read", "High"), ("strict", "bool", "Parameter", "Unused", "High"), ("total", "int", "Local", "ReadWrite", "High")),
    ),
    Template(
        "SaveAll", "Task", ("List<Order> orders", "Order first"), "{ foreach (var o in orders) { context.Add(o); } await context.SaveChangesAsync(); first.Close({n}); }",
        expected={
            "preconditions": (
                ("param-type-collection", None, "orders", "Parameter orders must not be null and should contain at least one element if iterated", "Medium"),
                ("param-enum-type", None, "first", "Parameter first must be a valid Order value recognized by this method", "Medium"),
                ("param-object-type", None, "first", "Parameter first must be a properly initialized Order instance", "Low"),
            ),
            "postconditions": (
                ("post-name-pattern", None, None, "Persists data; may throw if write fails", "High"),
                ("post-async", None, None, "Executes asynchronously; the caller must await this method to observe the result", "Medium"),
                ("post-loop-result", None, None, "Processes multiple elements and returns an aggregated or transformed result", "Medium"),
            ),
            "state_changes": (
                ("collection-modify", "CollectionModified", None, "A collection owned or passed into this method is modified", "High"),
                ("async-state", "NetworkCall", None, "Awaits one or more asynchronous operations during execution", "Medium"),
            ),
            "runtime_risks": (("null-dereference", "NullReferenceException", None, "Possible null dereference on 'first'.", "Low"),),
            "design_constraints": (("stateful", "Stateful", None, "Mutates a collection.", "High"), _IMPURE),
            "dependencies": (_call("foreach"), _call("Add"), _call("SaveChangesAsync"), _call("Close"), _space("context"), _space("first")),
        },
        usage=(("orders", "List<Order>", "Parameter", "Read", "High"), ("first", "Order", "Parameter", "Read", "High")),
    ),
    Template(
        "Measure", "double", ("double side",), "{ try { return Math.Sqrt(side); } catch (Exception) { return {n}; } }",
        expected={
            "preconditions": (
                ("param-type-numeric", None, "side", "Parameter side should be a finite numeric value; NaN and Infinity may produce unexpected results", "Medium"),
                ("param-sqrt", None, "side", "Parameter side passed to square root should be non-negative; negative values produce NaN", "High"),
            ),
            "postconditions": (
                ("post-return-type", None, None, "Returns a numeric result as double", "High"),
                ("post-power-sqrt", None, None, "Returns a mathematically computed numeric result; may return NaN for invalid inputs", "High"),
            ),
            "state_changes": (("exception-swallowed", "ObjectStateModified", None, "Catches exceptions internally. come error conditions may be silently handled", "Medium"),),
            "design_constraints": (_STATIC, *_PURE),
            "dependencies": (_call("Sqrt"), _space("Math")),
        },
        usage=(("side", "double", "Parameter", "Read", "High"),),
    ),
    Template(
        "walk", "int", ("Node* node",), 'int walk(Node* node) { if (node == nullptr) { throw std::runtime_error("x"); } return walk(node->next) + {n}; }', thrown=("std::runtime_error",), language="C++",
        expected={
            "preconditions": (
                ("guard-cpp-null", None, "node", "Parameter node must not be null before calling this method", "High"),
                ("param-enum-type", None, "node", "Parameter node must be a valid Node value recognized by this method", "Medium"),
            ),
            "postconditions": (("post-return-type", None, None, "Returns a numeric result as int", "High"), _THROWS),
            "runtime_risks": (("parser-thrown", "std::runtime_error", None, "Method may throw std::runtime_error.", "High"),),
            "design_constraints": (("uses-recursion", "UsesRecursion", None, "Calls itself recursively.", "High"), *_PURE),
            "dependencies": (_call("runtime_error"), ("external-apis", "ExternalApi", "std", "std", "High"), _space("std")),
        },
        usage=(("node", "Node*", "Parameter", "Read", "High"),),
    ),
    Template(
        "Reserve", "void", ("string {v}", "int amount", "List<Order> rows", "int[] grid", "int at"), "{ if ({v} == null) { throw new ArgumentNullException(); } if (amount < 0) { throw new E(); } if (rows.Count == 0) { throw new E(); } grid[at] = {n}; }", thrown=("ArgumentNullException",),
        expected={
            "preconditions": (
                ("guard-null", None, "{v}", "Parameter {v} must not be null before calling this method", "High"),
                ("guard-lt-zero", None, "amount", "Parameter amount must not be negative; negative values are rejected", "High"),
                ("param-type-index", None, "at", "Parameter at must be within valid index bounds for the accessed collection", "Medium"),
                ("guard-range-check", None, "amount", "Parameter amount must be within the valid range accepted by this method", "High"),
                ("guard-count-check", None, "rows", "Parameter rows must contain at least one element before calling this method", "High"),
            ),
            "postconditions": (("post-return-type", None, None, "This method performs an action and returns no value", "High"), _THROWS,),
            "runtime_risks": (("parser-thrown", "ArgumentNullException", None, "Method may throw ArgumentNullException.", "High"), ("null-dereference", "NullReferenceException", None, "Possible null dereference on 'rows'.", "Low"),),
            "design_constraints": _PURE,
            "dependencies": (_call("ArgumentNullException"), _call("E"),),
        },
        usage=(("{v}", "string", "Parameter", "Read", "High"), ("amount", "int", "Parameter", "Read", "High"), ("rows", "List<Order>", "Parameter", "Read", "High"), ("grid", "int[]", "Parameter", "Read", "High"), ("at", "int", "Parameter", "Read", "High"),),
    ),
    Template(
        "Sample", "Sample", ("string {v}",), "{ if (string.IsNullOrEmpty({v})) { throw new ArgumentException(); } title = {v}; limit = {n}; }", fields=(("title", "string"), ("limit", "int")),
        expected={
            "preconditions": (("guard-empty-string", None, "{v}", "Parameter {v} must not be null or empty before calling this method", "High"), ("param-type-string", None, "{v}", "Parameter {v} should not be null or empty when passed into this method", "Medium"),),
            "postconditions": (
                _THROWS,
                ("post-state-mutation", None, None, "Modifies internal object state; call GetX() methods after this to observe changes", "High"),
                ("post-constructor", None, None, "Initializes a new instance of the object with the provided parameter values", "High"),
            ),
            "state_changes": (("field-assignment", "FieldModified", "title", "Internal field title is assigned a new value by this method", "High"), ("field-assignment", "FieldModified", "limit", "Internal field limit is assigned a new value by this method", "High"),),
            "design_constraints": (("stateful", "Stateful", None, "Mutates instance or class state.", "High"), _IMPURE,),
            "dependencies": (
                _call("IsNullOrEmpty"),
                _call("ArgumentException"),
                _space("string"),
            ),
        },
        usage=(("{v}", "string", "Parameter", "Read", "High"), ("title", "string", "Field", "ReadWrite", "High"), ("limit", "int", "Field", "ReadWrite", "High"),),
    ),
    Template(
        "LoadAll", "string", ("string path", "int {v}"), "{ if ({v} <= 0) { throw new E(); } lock (gate) { var f = File.Open(path); File.WriteAllText(path, {n}); } return f.Text; }",
        expected={
            "preconditions": (
                ("guard-lte-zero", None, "{v}", "Parameter {v} must be greater than zero; zero or negative values are rejected", "High"),
                ("param-type-string", None, "path", "Parameter path should not be null or empty when passed into this method", "Medium"),
                ("param-file-io", None, None, "File path parameter must point to an accessible file; throws if file does not exist or access is denied", "Medium"),
                ("guard-range-check", None, "{v}", "Parameter {v} must be within the valid range accepted by this method", "High"),
            ),
            "postconditions": (("post-name-pattern", None, None, "Retrieves data from storage; may throw if source is unavailable", "High"), _THROWS,),
            "state_changes": (("file-write", "FileWrite", None, "Performs a file write or open-for-write operation on disk", "Medium"),),
            "runtime_risks": (
                ("file-open", "IOException", None, "File open may fail if the path is missing or inaccessible.", "Medium"),
                ("file-open", "UnauthorizedAccessException", None, "File open may be denied due to permissions.", "Medium"),
                ("file-open", "FileNotFoundException", None, "File open may fail when the file does not exist.", "Medium"),
            ),
            "design_constraints": (
                ("uses-files", "UsesFiles", None, "Uses file I/O.", "High"),
                _STATIC,
                ("uses-sync", "UsesThreadSynchronization", None, "Uses thread synchronization.", "High"),
                _IMPURE,
            ),
            "dependencies": (
                _call("E"),
                _call("lock"),
                _call("Open"),
                _call("WriteAllText"),
                ("external-apis", "ExternalApi", "System.IO.File", "System.IO.File", "High"),
                _space("File"),
            ),
        },
        usage=(("path", "string", "Parameter", "Read", "High"), ("{v}", "int", "Parameter", "Read", "High"),),
    ),
    Template(
        "Push", "Task", ("Order {v}",), "{ var web = new HttpClient(); web.Send({v}.Id, {n}); db.SaveChanges(); }", class_dependencies=("Order", "Store"),
        expected={
            "preconditions": (("param-enum-type", None, "{v}", "Parameter {v} must be a valid Order value recognized by this method", "Medium"), ("param-object-type", None, "{v}", "Parameter {v} must be a properly initialized Order instance", "Low"),),
            "postconditions": (("post-async", None, None, "Executes asynchronously; the caller must await this method to observe the result", "Medium"),),
            "state_changes": (("database-write", "DatabaseWrite", None, "Performs a database write operation that persists changed data", "Medium"), ("network-call", "NetworkCall", None, "Makes a network call to an external service or remote host", "Medium"),),
            "runtime_risks": (("null-dereference", "NullReferenceException", None, "Possible null dereference on '{v}'.", "Low"),),
            "design_constraints": (
                ("uses-database", "UsesDatabase", None, "Uses database APIs.", "High"),
                ("uses-network", "UsesNetwork", None, "Uses network APIs.", "High"),
                _IMPURE,
            ),
            "dependencies": (
                _call("HttpClient"),
                _call("Send"),
                _call("SaveChanges"),
                ("external-apis", "ExternalApi", "System.Net.Http.HttpClient", "System.Net.Http.HttpClient", "High"),
                ("class-dependencies", "ReferencedClass", "Order", "Order", "High"),
                ("class-dependencies", "ReferencedClass", "Store", "Store", "High"),
                _space("web"),
                _space("db"),
            ),
        },
        usage=(("{v}", "Order", "Parameter", "Read", "High"),),
    ),
    Template(
        "Guarded", "int", ("string {v}",), "try { return Parse({v}) + {n}; } catch (FormatException e) { throw; }", op_limits=("When {v} == null", "{v}: Must not be zero (used as a divisor)", "{v} >= 5", "!Ready({v}) && open"),
        expected={
            "preconditions": (
                ("param-type-string", None, "{v}", "Parameter {v} should not be null or empty when passed into this method", "Medium"),
                ("parser-operational-limit", None, None, "{V} must not be null before this method executes", "High"),
                ("parser-operational-limit", None, None, "{V} must not be zero; used as a divisor in this method", "High"),
                ("parser-operational-limit", None, None, "{V} must satisfy the required condition described by {v} is less than 5", "High"),
                ("parser-operational-limit", None, None, "The method rejects input where !Ready({v}) && open", "High"),
                ("guard-try-pattern", None, None, "This method handles exceptions internally; callers do not need to wrap it in try-catch", "Medium"),
            ),
            "postconditions": (("post-return-type", None, None, "Returns a numeric result as int", "High"), _THROWS,),
            "design_constraints": _PURE,
            "dependencies": (_call("Parse"),),
        },
        usage=(("{v}", "string", "Parameter", "Read", "High"),),
    ),
    Template(
        "Share", "double", ("string name", "int {v}"), "{ if (name.Length < 3) { throw new E(); } return total * {n} / {v}; }",
        expected={
            "preconditions": (("param-type-string", None, "name", "Parameter name should not be null or empty when passed into this method", "Medium"), ("guard-string-length", None, "name", "Parameter name must not be empty; minimum length is required", "High"),),
            "postconditions": (("post-return-type", None, None, "Returns a numeric result as double", "High"), _THROWS,),
            "runtime_risks": (("divide-by-zero", None, None, "Possible divide-by-zero when '{v}' is zero.", "Medium"), ("null-dereference", "NullReferenceException", None, "Possible null dereference on 'name'.", "Low"),),
            "design_constraints": _PURE,
            "dependencies": (_call("E"),),
        },
        usage=(("name", "string", "Parameter", "Read", "High"), ("{v}", "int", "Parameter", "Read", "High"),),
    ),
    Template(
        "GetRate", "decimal", ("DateTime day",), "",
        expected={
            "preconditions": (("param-enum-type", None, "day", "Parameter day must be a valid DateTime value recognized by this method", "Medium"),),
            "postconditions": (("post-name-pattern", None, None, "Returns the requested value; does not modify state", "High"),),
            "design_constraints": (
                ("pure-impure", "Pure", None, "Assumed pure; no method body available for side-effect scan.", "Low"),
                ("pure-impure", "Stateless", None, "Does not modify tracked fields or collections.", "Low"),
            ),
        },
        usage=(("day", "DateTime", "Parameter", "Unused", "Low"),),
    ),
)

#: Clauses on what variables may hold, by group: (parameters, clause, expected (name, scope, SQL of the limit over n, source)). A method has
#: one clause of each group, chosen by a digit of its own; names come from its brand and the words of its part's name, numbers from its size.
_EXACT = "CASE WHEN n = {} THEN 'exactly {}' ELSE '{} to ' || {} END"
_LETTERS = " || CASE WHEN {} = 1 THEN ' character' ELSE ' characters' END"
LIMIT_CLAUSES = (
    (
        (("int {v}",), "if ({v} < 1 || {v} > {n}) throw new E();", (("{v}", "Parameter", _EXACT.format(1, 1, 1, "n"), "Guard"),)), (("int {v}",), "if ({v} <= {n}) { throw new E(); }", (("{v}", "Parameter", "'greater than ' || n", "Guard"),)),
        (("int {v}",), "if ({v} <= 2 || {v} >= {n+10}) { throw new E(); }", (("{v}", "Parameter", "'3 to ' || (n + 9)", "Guard"),)), (("int {v}",), "{v} = Math.Clamp({v}, 2, {n+5});", (("{v}", "Parameter", "'2 to ' || (n + 5)", "Clamp"),)),
        (("int {v}",), "if ({v} != 3 && {v} != 5 && {v} != {n+7}) throw new E();", (("{v}", "Parameter", "'3, 5 or ' || (n + 7)", "Guard"),)), (("int {v}",), "if ({v} >= 1 && {v} <= {n+1}) Use({v});", (("{v}", "Parameter", _EXACT.format(0, 1, 1, "(n + 1)"), "Comparison"),)),
        (("int {v}",), "// if ({v} < 1) throw new E();\n Use({v}, {n});", (("{v}", "Parameter", "'any whole number'", "DeclaredType"),)), (("uint {v}",), "if ({v} == 0) throw new E(); if ({v} > {n+1}) throw new E();", (("{v}", "Parameter", _EXACT.format(0, 1, 1, "(n + 1)"), "Guard"),)),
        (("int {v}",), "if ({v} < 1 ||\n     {v} > {n+1})\n {\n  throw new E();\n }", (("{v}", "Parameter", _EXACT.format(0, 1, 1, "(n + 1)"), "Guard"),)),
    ),
    (
        (("string {a}t",), "if ({a}t.Length > {n}) throw new E();", (("{a}t", "Parameter", "'at most ' || n" + _LETTERS.format("n"), "Guard"),)), (("string {a}t",), "if ({a}t == null) throw new E();", (("{a}t", "Parameter", "'must not be null'", "Guard"),)),
        (("string {a}t",), "if ({a}t == null) throw new E(); if ({a}t.Length > {n+1}) throw new E();", (("{a}t", "Parameter", "'must not be null, at most ' || (n + 1)" + _LETTERS.format("n + 1"), "Guard"),)), (("string {a}t",), "Use({a}t);", (("{a}t", "Parameter", "'any text'", "DeclaredType"),)),
        (("List<int> {a}t",), "if ({a}t.Count == 0) throw new E({n});", (("{a}t", "Parameter", "'at least 1 item'", "Guard"),)), (("{w} {a}t",), "if ({a}t is null) throw new E({n});", (("{a}t", "Parameter", "'must not be null'", "Guard"),)),
        (("{w} {a}t",), "Use({a}t);", (("{a}t", "Parameter", "'any ' || w || ' value'", "DeclaredType"),)),
    ),
    (
        (("double {b}r",), "if ({b}r < 0) throw new E(); if ({b}r < {n}) throw new E();", (("{b}r", "Parameter", "n || ' or greater'", "Guard"),)), (("double {b}r",), "if ({b}r <= 0 || {b}r >= {n}) throw new E();", (("{b}r", "Parameter", "'greater than 0, less than ' || n", "Guard"),)),
        (("decimal {b}r",), "Use({b}r);", (("{b}r", "Parameter", "'any decimal number'", "DeclaredType"),)), (("byte {b}r",), "Use({b}r, {n});", (("{b}r", "Parameter", "'0 to 255'", "DeclaredType"),)), (("short {b}r",), "Use({b}r);", (("{b}r", "Parameter", "'-32,768 to 32,767'", "DeclaredType"),)),
        (("ushort {b}r",), "Use({b}r);", (("{b}r", "Parameter", "'0 to 65,535'", "DeclaredType"),)), (("char {b}r",), "if ({b}r >= 'b' && {b}r <= 'y') Use({b}r);", (("{b}r", "Parameter", "'''b'' to ''y'''", "Guard"),)),
    ),
    (
        ((), "for (int {a}i = 0; {a}i < {n+1}; {a}i++) { Use({a}i); }", (("{a}i", "Local", "CASE WHEN n = 0 THEN 'exactly 0' ELSE '0 to ' || n END", "LoopBound"),)), ((), "", ()),
        ((), "for (int {a}i = 2; {a}i <= {n+10}; {a}i++) { }", (("{a}i", "Local", "'2 to ' || (n + 10)", "LoopBound"),)),
    ),
    (
        (("int {b}q", "int {b}d"), "total = {b}q / {b}d + {n};", (("{b}q", "Parameter", "'any whole number'", "DeclaredType"), ("{b}d", "Parameter", "'must not be zero'", "Guard"))),
        (("int {b}q", "int {b}d"), "if ({b}d == 0) return; total = {b}q / {b}d;", (("{b}q", "Parameter", "'any whole number'", "DeclaredType"), ("{b}d", "Parameter", "'any whole number'", "DeclaredType"))),
        (("int {b}q", "int {b}d", "int {b}h"), "if ({b}q < {b}d || {b}q > {b}h) throw new E();", (("{b}q", "Parameter", "'between ' || b || 'd and ' || b || 'h'", "Guard"), ("{b}d", "Parameter", "'any whole number'", "DeclaredType"), ("{b}h", "Parameter", "'any whole number'", "DeclaredType"))),
        (("int {b}q", "int {b}d"), "if ({b}q > 0 && {b}d > {n}) throw new E();", (("{b}q", "Parameter", "'any whole number'", "DeclaredType"), ("{b}d", "Parameter", "'any whole number'", "DeclaredType"))), ((), "", ()),
    ),
)
#: A group's digit: the scrambled key, divided by how many bodies the groups before it make.
SCRAMBLE, MODULUS = 7919, 1_000_003


def digits(groups) -> list[tuple[int, int]]:
    """The divisor and modulus of each group's digit."""
    step, out = 1, []
    for group in groups:
        out.append((step, len(group)))
        step *= len(group)
    return out


#: Templates for execution steps: (name, return type, locals with initial values, fields, body, expected (kind, description)).
FLOW_TEMPLATES = (
    (
        "sum", "int", (("total", "int", "0"),), (), "int sum(Node* node) { if (node == nullptr) { throw E(); } int total = 0; for (int i = 0; i < {n}; i++) { total += node->value(i); } return total; }",
        (
            ("Validation", "Validate that node is not null before proceeding"), ("Initialization", "Initialize total to accumulate the computed result"), ("LoopProcessing", "Iterate over the elements to process each item sequentially"),
            ("Calculation", "Accumulate the running total into total"), ("Delegation", "Delegate the value processing to the responsible component"), ("ReturnResult", "Return the total value to the caller"),
        ),
    ),
    (
        "tick", "void", (), (("count", "int"),), "void tick() { count = count + {n}; std::cout << count; std::cout << 1; }",
        (("Calculation", "Calculate the result and store it in count"), ("StateUpdate", "Update the count field to reflect this operation"), ("ConsoleOutput", "Output information to the console during execution")),
    ),
    ("ok", "bool", (), (), "bool ok() { return {n} > 0; }", (("ReturnResult", "Return true if the operation succeeded, false otherwise"),)),
    ("nop", "void", (), (), "void nop() { }", (("Calculation", "Execute the nop operation using the provided inputs"),)),
    (
        "load", "std::string", (), (), "std::string load() { try { ifstream in; store.Save(in); bus.Send({n}); } catch (E) { printf(\"x\"); } return text; }",
        (
            ("Delegation", "Dispatch the result to the target destination"), ("FileOperation", "Perform the required file system operation"), ("DatabaseOperation", "Persist the processed data to the storage layer"),
            ("ConsoleOutput", "Output information to the console during execution"), ("ExceptionHandling", "Handle potential exceptions internally to ensure graceful recovery"), ("ReturnResult", "Return the resulting text value to the caller"),
        ),
    ),
    (
        "busy", "double", (), (("a", "int"), ("b", "int")), "double busy() { x += 1; p.f(); y += 2; p.g(); z += 3; p.h(); std::cout << {n}; fopen(n); q.Persist(); while (a) { a--; } return x; }",
        (
            ("LoopProcessing", "Iterate over the elements to process each item sequentially"), ("Calculation", "Perform the core processing logic on the provided inputs"), ("StateUpdate", "Update the a field to reflect this operation"),
            ("FileOperation", "Perform the required file system operation"), ("DatabaseOperation", "Persist the processed data to the storage layer"), ("ConsoleOutput", "Output information to the console during execution"),
            ("ReturnResult", "Return the computed double result to the caller"),
        ),
    ),
)


def _strings(values) -> F.Column:
    return F.array(*map(_named, values)).cast("array<string>")


def _variables(values) -> F.Column:
    return F.array(*[F.struct(_named(n).alias("name"), F.lit(t).alias("type")) for n, t in values]).cast(VARIABLES)


def _named(text: str) -> F.Column:
    """The text with the row's brand, as an identifier, for {v}."""
    return F.replace(F.lit(text), F.lit("{v}"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))) if "{v}" in text else F.lit(text)


def _numbered(text: str) -> F.Column:
    out = _named(text)
    for k in (0, 1, 5, 7, 10):
        out = F.replace(out, F.lit("{n+%d}" % k if k else "{n}"), (F.col("p_size") + k).cast("string"))
    return out


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where a small table is read by fewer tasks: few bytes move, and much is computed on each."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _written(part: DataFrame, rows: list[F.Column]) -> DataFrame:
    part = spread(part.select("p_partkey", "p_size", "p_brand"))
    chosen = F.element_at(F.array(*rows), (F.pmod(F.col("p_partkey"), F.lit(len(rows))) + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("method_id"), chosen.alias("m")).select("method_id", F.lit("Sample").alias("class_name"), "m.*")


def _method(name, returns, params, body, fields, locals_, thrown, language, op_limits=(), class_dependencies=()) -> F.Column:
    return F.struct(
        F.lit(name).alias("method_name"), F.lit(returns).alias("return_type"), F.lit(language).alias("language"), _strings(params).alias("params"), _numbered(body).alias("body"), _variables(fields).alias("fields"),
        _variables(locals_).alias("locals"), _variables(()).alias("properties"), _strings(thrown).alias("thrown"), _strings(op_limits).alias("op_limits"), _strings(class_dependencies).alias("class_dependencies"),
    )


def methods(part: DataFrame) -> DataFrame:
    """One method per part, from TEMPLATES."""
    return _written(part, [_method(t.name, t.returns, t.params, t.body, t.fields, t.locals, t.thrown, t.language, t.op_limits, t.class_dependencies) for t in TEMPLATES])


def _worded(text: str) -> F.Column:
    """The text with the row's words for {a}, {b} and {w}, its brand for {v} and its size for {n}."""
    out = _numbered(text)
    for name, word in (("{a}", F.split("p_name", " ")[0]), ("{b}", F.split("p_name", " ")[1]), ("{w}", F.replace("p_brand", F.lit("#"), F.lit("")))):
        out = F.replace(out, F.lit(name), word) if name in text else out
    return out


def limit_methods(part: DataFrame) -> DataFrame:
    """One method per part, of a clause of each group of LIMIT_CLAUSES."""
    digit = F.col("p_partkey") * SCRAMBLE % MODULUS
    one_of = lambda group, step, size, make: F.element_at(F.array(*map(make, group)), (F.floor(digit / step) % size + 1).cast("int"))
    chosen = list(zip(LIMIT_CLAUSES, digits(LIMIT_CLAUSES), strict=True))
    clauses = [one_of(g, step, size, lambda c: _worded(c[1])) for g, (step, size) in chosen]
    params = F.flatten(F.array(*[one_of(g, step, size, lambda c: F.array(*map(_worded, c[0])).cast("array<string>")) for g, (step, size) in chosen]))
    body = F.concat(F.lit("{\n "), F.concat_ws("\n ", *clauses), F.lit("\n}"))
    rows = spread(part.select("p_partkey", "p_size", "p_brand", "p_name"))
    return rows.select(F.col("p_partkey").alias("method_id"), params.alias("params"), body.alias("body"), _variables(()).alias("fields"), _variables(()).alias("locals"))


def flow_methods(part: DataFrame) -> DataFrame:
    """One method per part, from FLOW_TEMPLATES."""
    started = "array<struct<name:string,type:string,initial_value:string>>"
    rows = [
        F.struct(
            F.lit(name).alias("method_name"), F.lit(returns).alias("return_type"), _numbered(body).alias("body"), _variables(fields).alias("fields"),
            F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(v).alias("initial_value")) for n, t, v in locals_]).cast(started).alias("locals"),
        )
        for name, returns, locals_, fields, body, _ in FLOW_TEMPLATES
    ]
    return _written(part, rows)


def flow_sql() -> str:
    rows = [(i, k + 1, *step) for i, t in enumerate(FLOW_TEMPLATES) for k, step in enumerate(t[-1])]
    values = ", ".join(f"({i}, {k}, {_quoted(kind)}, {_quoted(text)})" for i, k, kind, text in rows)
    return f"SELECT p_partkey AS method_id, step, kind, description FROM part JOIN (VALUES {values}) AS v(t, step, kind, description) ON p_partkey % {len(FLOW_TEMPLATES)} = t"


def _quoted(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _own(column: str) -> str:
    """The column with the row's brand for {v}, and with a capital for {V}."""
    brand = "replace(p_brand, '#', '')"
    return f"replace(replace({column}, '{{v}}', lower({brand})), '{{V}}', {brand}) AS {column}"


def findings_sql(analyzer: str) -> str:
    rows = [(i, *f) for i, t in enumerate(TEMPLATES) for f in t.expected.get(analyzer, ())]
    values = ", ".join(f"({i}, {', '.join(map(_quoted, f))})" for i, *f in rows)
    return f"SELECT p_partkey AS method_id, rule_id, kind, {_own('subject')}, {_own('description')}, confidence FROM part JOIN (VALUES {values}) AS v(t, rule_id, kind, subject, description, confidence) ON p_partkey % {len(TEMPLATES)} = t"


def analyses_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS analyzer, * FROM ({findings_sql(a)})" for a in ("preconditions", "postconditions", "state_changes", "runtime_risks", "design_constraints", "dependencies"))


def usage_sql() -> str:
    rows = [(i, *u) for i, t in enumerate(TEMPLATES) for u in t.usage]
    values = ", ".join(f"({i}, {', '.join(map(_quoted, u))})" for i, *u in rows)
    return f"SELECT p_partkey AS method_id, {_own('name')}, type, scope, usage, confidence FROM part JOIN (VALUES {values}) AS v(t, name, type, scope, usage, confidence) ON p_partkey % {len(TEMPLATES)} = t"


def limits_sql() -> str:
    """The limit of each variable by the clause that its method's digit chose."""
    parts = "SELECT p_partkey, p_size AS n, lower(replace(p_brand, '#', '')) AS v, replace(p_brand, '#', '') AS w, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, " + f"p_partkey * {SCRAMBLE} % {MODULUS} AS d FROM part"
    rows = []
    for group, (step, size) in zip(LIMIT_CLAUSES, digits(LIMIT_CLAUSES), strict=True):
        for i, (_, _, expected) in enumerate(group):
            for name, scope, limit, source in expected:
                named = f"{name[1]} || '{name[3:]}'"
                rows.append(f"SELECT p_partkey AS method_id, {named} AS name, {_quoted(scope)} AS scope, {limit} AS \"limit\", {_quoted(source)} AS source FROM k WHERE d // {step} % {size} = {i}")
    return f"WITH k AS ({parts}) " + " UNION ALL ".join(rows)
