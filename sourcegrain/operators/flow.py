"""Execution steps of a method, read from its text: found, merged, ordered by phase and capped.

All steps of a method come from its own row, so they are found, sorted and
capped in arrays of that row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing
from ..functions import text as T
from .rules import say

#: The order of phases, and names of methods and variables with a meaning of their own.
PHASES = (
    "Validation", "Initialization", "LoopProcessing", "Calculation", "StateUpdate", "ExternalCall", "Delegation", "FileOperation", "DatabaseOperation", "ConsoleOutput", "ExceptionHandling", "ReturnResult",
)
PERSIST = ("Save", "SaveAsync", "Submit", "SubmitAsync", "Persist", "SaveChanges", "ExecuteNonQuery", "ExecuteScalar", "ExecuteReader")
DISPATCH = ("Send", "SendAsync", "Publish", "PublishAsync", "Dispatch")
ACCUMULATORS = ("result", "output", "total", "sum", "value")
LIMIT = 8

STEPS = "array<struct<pos:int,kind:string,text:string>>"


def located(body: Column, pattern: str, *groups: int) -> Column:
    """Every match of pattern: its place from 0, and the groups as g0, g1, ..."""
    full = F.lit("(?U)" + pattern)
    kind = "array<struct<pos:int" + "".join(f",g{i}:string" for i in range(len(groups))) + ">>"

    def places(whole: Column, between: Column) -> Column:
        """Lengths of what comes before each match: the pieces between matches and the matches before it."""
        return F.transform(whole, lambda _, k: (_total(F.slice(between, 1, k + 1)) + _total(F.slice(whole, 1, k))).cast("int"))

    def found(whole: Column) -> Column:
        at = T.bind(F.split(body, "(?U)" + pattern), lambda between: places(whole, between))
        return F.arrays_zip(at.alias("pos"), *[F.regexp_extract_all(body, full, F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)])

    return T.bind(F.regexp_extract_all(body, full, F.lit(0)), lambda whole: F.when(F.size(whole) > 0, found(whole)).otherwise(F.array()).cast(kind))


def _total(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))


def _steps(found: Column, make: Callable[[Column], tuple]) -> Column:
    def one(x: Column) -> Column:
        kind, text = make(x)
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(x["pos"].cast("int").alias("pos"), lit(kind).alias("kind"), lit(text).cast("string").alias("text"))

    return F.transform(found, one).cast(STEPS)


def _first(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?U)[A-Za-z_]\w*", 0), F.lit(""))


def _guard(condition: Column) -> Column:
    name = F.coalesce(_first(condition), F.lit("input"))
    return (
        F.when(T.has(condition, "nullptr", "NULL"), say("Validate that {} is not null before proceeding", name))
        .when(condition.contains(".empty()"), say("Validate that {} is not empty before proceeding", name))
        .when(condition.rlike(r"<=\s*0|==\s*0"), say("Verify that {} is non-zero to prevent invalid operations", name))
        .when(condition.rlike(r"<\s*0"), say("Ensure that {} is a positive value as required", name))
        .otherwise("Validate the input conditions before executing the core logic")
    )


def _call(x: Column) -> tuple:
    name = x["g0"]
    kind = F.when(name.isin(*PERSIST), "DatabaseOperation").otherwise("Delegation")
    return kind, F.when(name.isin(*PERSIST), "Persist the processed data to the storage layer").when(name.isin(*DISPATCH), "Dispatch the result to the target destination").otherwise(say("Delegate the {} processing to the responsible component", name))


def _returned(returns: Column, expression: Column) -> Column:
    return (
        F.when(F.upper(returns) == "BOOL", "Return true if the operation succeeded, false otherwise")
        .when(returns.isin("double", "float", "decimal"), say("Return the computed {} result to the caller", returns))
        .when(returns.isin("int", "long", "short", "byte"), say("Return the {} value to the caller", F.coalesce(_first(expression), F.lit("resulting"))))
        .when(F.upper(returns).contains("STRING"), "Return the resulting text value to the caller")
        .when(returns.contains("List") | returns.contains("IEnumerable"), "Return the processed collection of results to the caller")
        .otherwise(say("Return the {} result to the caller", returns))
    )


def raw_steps(body: Column, returns: Column, locals_: Column, fields: Column, seen: Column) -> Column:
    """Steps in the order of the rules. locals_: name, type, initial_value; seen: the body's facts."""
    at = lambda name: F.greatest(F.lit(0), F.instr(body, name) - 1)
    guards = F.filter(located(body, r"if\s*\(([^)]*)\)", 1), lambda g: F.substring(body, g["pos"] + 1, F.lit(160)).contains("throw"))
    started = F.transform(F.filter(locals_, lambda v: F.trim(v["initial_value"]) != ""), lambda v: F.struct(at(v["name"]).alias("pos"), v["name"].alias("g0")))
    changed = F.slice(F.transform(F.filter(fields, lambda f: T.written(seen, f["name"])), lambda f: F.struct(at(f["name"]).alias("pos"), f["name"].alias("g0"))), 1, 1)
    tried = F.filter(F.slice(located(body, r"\btry\b\s*\{"), 1, 1), lambda _: T.matches(body, r"\bcatch\b\s*\("))
    returned = located(body, r"\breturn\b\s*([^;]*);", 1)
    no_return = F.array(F.struct(F.length(body).alias("pos"), F.lit("").alias("g0")))
    last = F.when(T.is_void(returns), F.slice(no_return, 1, 0)).otherwise(F.slice(F.concat(returned, no_return), 1, 1))
    return F.concat(
        _steps(guards, lambda g: ("Validation", _guard(g["g0"]))),
        _steps(located(body, r"\bfor\s*\(|\bwhile\s*\("), lambda _: ("LoopProcessing", "Iterate over the elements to process each item sequentially")),
        _steps(started, lambda v: ("Initialization", F.when(F.lower(v["g0"]).isin(*ACCUMULATORS), say("Initialize {} to accumulate the computed result", v["g0"])).otherwise(say("Initialize {} for use in the processing logic", v["g0"])))),
        _steps(located(body, r"([A-Za-z_]\w*)\s*(?:\+=|-=|\*=|/=)", 1), lambda x: ("Calculation", say("Accumulate the running total into {}", x["g0"]))),
        _steps(located(body, r"([A-Za-z_]\w*)\s*=\s*(?!=)[^;]*[-+*/](?!>)[^;]*;", 1), lambda x: ("Calculation", say("Calculate the result and store it in {}", x["g0"]))),
        _steps(changed, lambda f: ("StateUpdate", say("Update the {} field to reflect this operation", f["g0"]))),
        _steps(located(body, r"std::cout|std::cerr|\bprintf\s*\("), lambda _: ("ConsoleOutput", "Output information to the console during execution")),
        _steps(located(body, r"\b(?:ifstream|ofstream|fstream)\b|\bfopen\s*\("), lambda _: ("FileOperation", "Perform the required file system operation")),
        _steps(located(body, r"[A-Za-z_]\w*\s*(?:\.|->)\s*([A-Za-z_]\w*)\s*\(", 1), _call),
        _steps(tried, lambda _: ("ExceptionHandling", "Handle potential exceptions internally to ensure graceful recovery")),
        _steps(last, lambda r: ("ReturnResult", _returned(returns, r["g0"]))),
    )


def _cap(steps: Column, name: Column) -> Column:
    core = lambda s: s["kind"].isin("Calculation", "Delegation")
    none = F.array(F.struct(F.lit(0).alias("phase"), F.lit(0).alias("pos"), F.lit(0).alias("ord"), F.lit("Calculation").alias("kind"), say("Execute the {} operation using the provided inputs", name).alias("text")))

    def merge(steps: Column) -> Column:
        first = F.array_min(F.filter(F.transform(steps, lambda s, i: F.when(core(s), i)), lambda i: i.isNotNull()))
        one = F.transform(steps, lambda s, i: F.when(i == first, s.withField("kind", F.lit("Calculation")).withField("text", F.lit("Perform the core processing logic on the provided inputs"))).when(~core(s), s))
        return F.filter(one, lambda s: s.isNotNull())

    def shorten(steps: Column) -> Column:
        ends = lambda s: s["kind"] == "ReturnResult"
        return F.when(F.size(steps) > LIMIT, F.concat(F.slice(F.filter(steps, lambda s: ~ends(s)), 1, LIMIT - 1), F.filter(steps, ends))).otherwise(steps)

    return F.when(F.size(steps) == 0, none).when(F.size(steps) <= LIMIT, steps).otherwise(T.bind(merge(steps), shorten))


def ordered(raw: DataFrame) -> DataFrame:
    """method_id, step (from 1), kind, description of raw steps: merged in the order of places, sorted by phase, capped. raw: method_id, method_name, raw."""
    phase = lambda kind: F.array_position(F.array(*map(F.lit, PHASES)), kind).cast("int")
    by_place = F.array_sort(F.transform("raw", lambda s, i: F.struct(s["pos"].alias("pos"), i.alias("ord"), s["kind"].alias("kind"), s["text"].alias("text"))))
    merged = T.bind(by_place, lambda a: F.filter(a, lambda s, i: ~F.coalesce(F.get(a, i - 1)["kind"] == s["kind"], F.lit(False))))
    by_phase = F.array_sort(F.transform(merged, lambda s: F.struct(phase(s["kind"]).alias("phase"), s["pos"].alias("pos"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["text"].alias("text"))))
    # The array is exploded where it is made: of a column a filter on its size would be inferred, pushed down and compute it twice.
    rows = raw.select("method_id", F.posexplode(T.bind(by_phase, lambda a: _cap(a, F.col("method_name")))).alias("k", "s"))
    return rows.select("method_id", (F.col("k") + 1).alias("step"), F.col("s.kind").alias("kind"), F.col("s.text").alias("description"))


def execution_steps(methods: DataFrame) -> DataFrame:
    """The steps that a method's text shows. methods: method_id, method_name, return_type, body, locals, fields."""
    rows = methods.withColumn("body", T.within_budget(F.col("body"))).withColumn("facts", T.writes(F.col("body")))
    return ordered(rows.select("method_id", "method_name", raw_steps(F.col("body"), F.col("return_type"), F.col("locals"), F.col("fields"), F.col("facts")).alias("raw")))


#: Receivers, and parts of their names, that tell what a C# call is for.
FILE_TYPES = ("File", "Directory", "Path", "StreamReader", "StreamWriter", "FileStream", "BinaryReader", "BinaryWriter")
DATABASE_PARTS = ("DbContext", "Repository", "Connection", "Command")
DATABASE_CALLS = ("SaveChanges", "ExecuteNonQuery", "ExecuteScalar", "ExecuteReader")
MATH = ("Sqrt", "Pow", "Abs", "Round", "Floor", "Ceiling", "Log", "Sin", "Cos", "Tan", "Exp")
LOG_CALLS = ("LogInformation", "LogError", "LogWarning", "LogDebug")


def classify_call(receiver: Column, name: Column, is_member: Column) -> Column:
    """kind and text of a C# call, the first that applies; null for a plain call of no known use."""
    step = lambda kind, text: F.struct(F.lit(kind).alias("kind"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    return (
        F.when(receiver == "Console", step("ConsoleOutput", "Output information to the console during execution"))
        .when(receiver.isin(*FILE_TYPES), step("FileOperation", "Perform the required file system operation"))
        .when(T.has(receiver, *DATABASE_PARTS) | name.isin(*DATABASE_CALLS), step("DatabaseOperation", "Execute the database operation to persist the changes"))
        .when((receiver == "Math") | name.isin(*MATH), step("Calculation", "Apply the mathematical function to compute the precise result"))
        .when(F.lower(receiver).contains("log") | name.isin(*LOG_CALLS), step("ExternalCall", "Record the operation details for diagnostic and audit purposes"))
        .when(name.isin(*PERSIST), step("DatabaseOperation", "Persist the processed data to the storage layer"))
        .when(name.isin(*DISPATCH), step("Delegation", "Dispatch the result to the target destination"))
        .when(is_member, step("Delegation", say("Delegate the {} processing to the responsible component", name)))
    )


#: The names that a C# condition compares: a name, or the last member of what is called or indexed.
_LEFT = r"^(?:[\w.\s]*\.|[^&|?]*[)\]]\s*\.)?\s*([A-Za-z_]\w*)\s*"


def csharp_guard(condition: Column, flat: Column) -> Column:
    """The sentence of a C# guard by its condition; flat: the condition with blanks inside its brackets."""
    outside = lambda pattern: flat.rlike(r"^[^&|?]*" + pattern + "$")
    left = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(flat, _LEFT + pattern + "$", 1), F.lit("")), F.lit("input"))
    argument = F.coalesce(F.nullif(F.trim(F.regexp_extract(condition, r"(?s)IsNullOr(?:Empty|WhiteSpace)\s*\(([^,]*?)(?:,.*)?\)$", 1)), F.lit("")), F.lit("input"))
    null, zero = r"[=!]=\s*null", r"(?:0(?:\.0+)?[fFdD]?|0(?:\.0+)?[mM]|0[uUlL]{1,2})"
    return (
        F.when(flat.rlike(r"^[\w.]*IsNullOr(?:Empty|WhiteSpace)\s*\(\s*\)$"), say("Validate that {} is not empty or whitespace", argument))
        .when(outside(null), say("Validate that {} is not null before proceeding", left(null)))
        .when(outside(r"[^<>=!](?:==|<=)\s*" + zero), say("Verify that {} is non-zero to prevent invalid operations", left(r"(?:==|<=)\s*" + zero)))
        .when(outside(r"<\s*" + zero), say("Ensure that {} is a positive value as required", left(r"<\s*" + zero)))
        .otherwise("Validate the input conditions before executing the core logic")
    )


def csharp_loop(kind: Column, collection: Column, nested: Column) -> Column:
    """The sentence of a loop; nested: whether another one stands in it."""
    return (
        F.when(nested, "Traverse the nested structure to process all contained elements").when(kind == "foreach", say("Process each element in {} to produce the result", collection))
        .when(kind == "for", "Iterate over the index range to process each element sequentially").otherwise("Continue processing until the exit condition is satisfied")
    )


def csharp_steps(facts: Column, returns: Column, fields: Column) -> Column:
    """Steps of a C# body from its facts (lexing.facts_of), in their places: guards that throw, locals, loops, calculations and
    updates of fields, calls, exception handling, returns. Comments and literals are no code there."""
    step = lambda kind, text: F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    is_field = lambda f: F.exists(fields, lambda x: x["name"] == f["a"])

    def one(f: Column) -> Column:
        target = F.coalesce(f["a"], F.lit("result"))
        found = (
            F.when((f["kind"] == "if") & f["flag"], step("Validation", csharp_guard(f["a"], f["b"])))
            .when(f["kind"] == "local", step("Initialization", F.when(F.lower(f["a"]).isin(*ACCUMULATORS), say("Initialize {} to accumulate the computed result", f["a"])).otherwise(say("Initialize {} for use in the processing logic", f["a"]))))
            .when(f["kind"].isin("foreach", "for", "while"), step("LoopProcessing", csharp_loop(f["kind"], f["a"], f["flag"])))
            .when((f["kind"] == "set") & is_field(f), step("StateUpdate", say("Update the {} field with the new computed value", f["a"])))
            .when((f["kind"] == "set") & f["flag"], step("Calculation", F.when(f["b"].isin("+=", "-=", "*="), say("Accumulate the running total into {}", target)).otherwise(say("Calculate the result and store it in {}", target))))
            .when((f["kind"] == "step") & is_field(f), step("StateUpdate", say("Increment the {} counter to record this operation", f["a"])))
            .when(f["kind"] == "try", step("ExceptionHandling", F.when(f["flag"], "Catch and re-throw exceptions after performing any necessary cleanup").otherwise("Handle potential exceptions internally to ensure graceful recovery")))
            .when(f["kind"] == "call", classify_call(f["a"], f["b"], f["flag"]))
            .when((f["kind"] == "return") & ~T.is_void(returns), step("ReturnResult", _returned(returns, F.coalesce(f["a"], F.lit("")))))
        )
        return F.struct(f["pos"].alias("pos"), found["kind"].alias("kind"), found["text"].alias("text"))

    return F.filter(F.transform(facts, one), lambda s: s["kind"].isNotNull()).cast(STEPS)


def fallback_steps(returns: Column, thrown: Column, op_limits: Column, locals_: Column, fields: Column, writes: Column) -> Column:
    """Steps of a method without a readable body, from what else is known of it."""
    mentions = lambda *words: F.exists(op_limits, lambda l: T.has(F.lower(l), *words))
    local = F.get(F.filter(locals_, lambda v: F.trim(v["initial_value"]) != ""), F.lit(0))["name"]
    field = F.get(fields, F.lit(0))["name"]
    step = lambda pos, kind, holds, text: F.when(holds, F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), (text if isinstance(text, Column) else F.lit(text)).alias("text")))
    steps = F.array(
        step(0, "Validation", F.size(thrown) > 0, say("Validate the input preconditions; throws {} if violated", F.get(thrown, F.lit(0)))),
        step(1, "Validation", mentions("null"), "Validate that all reference inputs are non-null before proceeding"), step(2, "Validation", mentions("zero", "division"), "Verify the divisor is non-zero to prevent arithmetic exceptions"),
        step(3, "Validation", mentions("bounds", "index"), "Validate the index is within the bounds of the target collection"), step(4, "Initialization", local.isNotNull(), say("Initialize {} for use in the processing logic", local)),
        step(5, "StateUpdate", F.coalesce(T.written(writes, field), F.lit(False)), say("Update the {} field to reflect this operation", field)), step(6, "ReturnResult", ~T.is_void(returns), _returned(returns, F.lit(""))),
    )
    return F.filter(steps, lambda s: s.isNotNull()).cast(STEPS)


def dispatched_steps(methods: DataFrame) -> DataFrame:
    """execution_steps() by language: C# bodies by csharp_steps(), others by their text, and methods without steps by
    what else is known. methods: method_id, method_name, return_type, language, body, locals, fields, thrown, op_limits."""
    body = F.coalesce(T.within_budget(F.trim("body")), F.lit(""))
    # Only C# bodies go through the scanner.
    code = lexing.facts_of(F.when(F.col("language") == "C#", body))
    rows = methods.withColumns({"body": body, "facts": T.writes(body), "code": code})
    text = raw_steps(F.col("body"), F.col("return_type"), F.col("locals"), F.col("fields"), F.col("facts"))
    read = F.when(F.col("body") == "", F.array().cast(STEPS)).when(F.col("language") == "C#", csharp_steps(F.col("code"), F.col("return_type"), F.col("fields"))).otherwise(text)
    rows = rows.withColumn("read", read)
    other = fallback_steps(F.col("return_type"), F.col("thrown"), F.col("op_limits"), F.col("locals"), F.col("fields"), F.col("facts"))
    return ordered(rows.select("method_id", "method_name", F.when(F.size("read") > 0, F.col("read")).otherwise(other).alias("raw")))
