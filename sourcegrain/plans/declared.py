"""Documentation, declarations, C++ bodies and facts of methods written from the rows of `part`, with their SQL.

The words, brand and size of a part are the names, types and numbers in its texts; the size also picks the clauses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import declarations as D
from ..operators import flow, prompts, reports, rules, structure
from . import corpus

QUERIES, SQL = {}, {}
#: a, b: words of the name; v, w: the brand as the name of a variable and of a type; n: the size.
PARTS = "WITH p AS (SELECT p_partkey, p_type, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(replace(p_brand, '#', '')) AS v, replace(p_brand, '#', '') AS w, p_size AS n FROM part) "


def query(sql):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, PARTS + sql
        return f

    return add


def parts(spark, sf_dir):
    part = corpus.spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    word = F.replace("p_brand", F.lit("#"), F.lit(""))
    return part.select("p_partkey", "p_type", "p_name", F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"), F.lower(word).alias("v"), word.alias("w"), F.col("p_size").alias("n"))


def say(template):
    """The template with {a}, {b}, {v}, {w} and {n} filled in."""
    text = F.lit(template)
    for name in "abvwn":
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return text


def many(*templates):
    return F.array(*map(say, templates)).cast("array<string>")


def variables(*pairs):
    kind = "array<struct<name:string,type:string,initial_value:string>>"
    return F.array(*[F.struct(say(n).alias("name"), F.lit(t).alias("type"), F.lit("1").alias("initial_value")) for n, t in pairs]).cast(kind)


def pick(k, *choices):
    """The choice of the size modulo k."""
    return F.element_at(F.array(*choices), (F.col("n") % k + 1).cast("int"))


@query("""
SELECT p_partkey, 'summary' AS tag, 'Adds ' || w || ' to ' || a || ' & ' || b || '.' AS text FROM p UNION ALL SELECT p_partkey, 'param:' || v, 'The ' || a || ' one' FROM p
UNION ALL SELECT p_partkey, 'exception:' || w || 'Error', 'When ' || v || ' < ' || n FROM p WHERE n % 2 = 0 UNION ALL SELECT p_partkey, 'returns', b FROM p WHERE n % 3 > 0""")
def xml_documentation(spark, sf_dir):
    comment = F.concat(
        say('/// <summary>\n/// Adds <see cref="T:{w}"/> to {a} &amp;\n///   {b}.\n/// </summary>\n/// <param name="{v}">The {a}  one</param>\n'),
        pick(2, say('/// <exception cref="{w}Error">When <paramref name="{v}"/> &lt; {n}</exception>\n'), F.lit("")), pick(3, F.lit("/// <returns> </returns>"), say("/// <returns>{b}</returns>"), say("/// <returns><c>{b}</c></returns>")),
    )
    return parts(spark, sf_dir).select("p_partkey", F.explode(D.xml_tags(comment)).alias("tag", "text"))


@query("""
SELECT p_partkey, 'summary' AS tag, CASE WHEN n % 2 = 0 THEN 'Short ' || b || '.' ELSE 'Finds the ' || a || '. More of it.' END AS text FROM p UNION ALL SELECT p_partkey, 'param:' || v, 'the ' || a || ' goes on ' || n FROM p
UNION ALL SELECT p_partkey, 'exception:std::' || w, 'when ' || b FROM p WHERE n % 3 = 0 UNION ALL SELECT p_partkey, 'returns', 'the ' || b FROM p""")
def doxygen_documentation(spark, sf_dir):
    comment = F.concat(
        say("/**\n * Finds the {a}.\n"), pick(2, say(" * @brief Short {b}.\n"), F.lit(" * More of it.\n")), say(" * @param {v} the {a}\n *   goes on {n}\n"),
        pick(3, say(" * @throws std::{w} when {b}\n"), F.lit(""), F.lit("")), pick(2, say(" * @return the {b}\n */"), say(" * \\returns the {b}\n */")),
    )
    return parts(spark, sf_dir).select("p_partkey", F.explode(D.doxygen_tags(comment)).alias("tag", "text"))


@query("""
SELECT p_partkey, CASE WHEN n % 2 = 0 THEN w || 'Base' ELSE 'I' || b END AS base, 'I' || w AS interfaces, CASE n % 3 WHEN 0 THEN 'protected' WHEN 1 THEN 'public' ELSE 'private' END AS access,
  w || CASE WHEN n % 2 = 0 THEN ',' || w || 'Item' ELSE '' END AS depends, w || ',' || w || 'Node' AS cpp_depends, 'shop::' || w AS owner, 'int F(int ' || v || ')' AS signature, CAST(n AS VARCHAR) AS constant, 'const ' || w || '&' AS type, v AS name FROM p""")
def declarations(spark, sf_dir):
    bases = D.split_bases(pick(2, many("I{w}", " {w}Base", "{a}"), many("I{b}", "I{w}")))
    split = D.split_parameter(say("const {w}& {v}"))
    joined = lambda values: F.array_join(values, ",")
    return parts(spark, sf_dir).select(
        "p_partkey", bases["base"].alias("base"), joined(bases["interfaces"]).alias("interfaces"), D.access_of(pick(3, many("static", "internal", "protected"), many("sealed", "public"), many("static"))).alias("access"),
        joined(D.dependencies(F.concat(many("Dictionary<string, List<{w}>>", "int[]"), pick(2, many("Shop.{w}Item?"), many("({w} x, bool y)"))))).alias("depends"),
        joined(D.cpp_dependencies(many("const std::vector<{w}>&", "unsigned", "{w}Node*"))).alias("cpp_depends"), D.owner_of(say("shop::{w}::run(std::string)")).alias("owner"),
        D.signature_text(say("int F(int {v}) { return {n}; }"), say("{ return {n}; }")).alias("signature"), D.file_constant(say("const int Max = {n};"), F.lit("Max")).alias("constant"), split["type"].alias("type"), split["name"].alias("name"),
    )


@query("""
SELECT p_partkey, v || ' < ' || n || ' && ok(p)' || CASE WHEN n % 2 = 0 THEN '; ' || v || ' == 3' ELSE '' END AS guards, 'std::' || w || CASE WHEN n % 2 = 0 THEN ',E' ELSE '' END AS thrown,
  concat_ws('; ', CASE WHEN n % 2 = 0 THEN 'Potential division by zero: verify divisor is non-zero before division.' END, CASE WHEN n % 5 = 0 THEN 'Potential null pointer dereference: ''r'' is accessed via -> without a visible null check.' END,
    CASE WHEN n % 3 = 0 THEN 'Potential memory leak: ''new'' used without visible ''delete'' or smart pointer.' END, CASE WHEN n % 5 = 1 THEN 'Potential infinite loop: loop has no visible termination condition.' END) AS issues,
  concat_ws('; ', CASE WHEN n % 2 = 0 THEN 'div: Must not be zero (used as a divisor)' END, CASE WHEN n % 5 = 2 THEN 'path: Expected to be a valid file path' END) AS limits FROM p""")
def cpp_bodies(spark, sf_dir):
    none = F.lit("")
    body = F.concat(
        say('int f(Node* p, int {v}, Node* r) {\n if ({v} < {n} && ok(p)) { throw std::{w}("x"); }\n // throw Hidden();\n'), pick(2, say(" if (p) { if ({v} == 3) throw E(); }\n total = {v} / div;"), say(" total = {v};")),
        pick(3, F.lit(" auto* q = new Item();"), none, none), pick(5, F.lit(" r->next = 0;"), F.lit(" while (true) { step(); }"), F.lit(" in.open(path);"), none, none), F.lit(" throw caught; }"),
    )
    locals_, fields = variables(("div", "int")), variables(("path", "std::string"))
    joined = lambda values: F.array_join(values, "; ")
    rows = parts(spark, sf_dir).select("*", body.alias("body"))
    return rows.select(
        "p_partkey", joined(D.guard_conditions(F.col("body"))).alias("guards"), F.array_join(D.thrown_types(F.col("body")), ",").alias("thrown"),
        joined(D.runtime_issues(F.col("body"), many("Node* p", "int {v}", "Node* r"), locals_)).alias("issues"), joined(D.operational_limits(F.col("body"), locals_, fields)).alias("limits"),
    )


@query("""
SELECT p_partkey, CASE n % 3 WHEN 0 THEN 'Contains no throw statements.|Uses a lock for thread safety.|Modifies class state: ' || v || '.|Return statements: return ' || n || ';'
  WHEN 1 THEN 'Contains throw statements.|Recursive: the method calls itself.|Asynchronous: awaits one or more operations.|Contains try/catch handling.|Has a finally block that always runs.|Modifies no state: the body contains no assignments or mutating calls.'
  ELSE 'Throws: ' || w || 'Error.|Modifies no state: the body contains no assignments or mutating calls.|Return statements: return ' || a || '; ; return ' || b || ';' END AS facts FROM p""")
def verified_facts(spark, sf_dir):
    body = pick(3, say("{ lock (gate) { {v} += {n}; } return {n}; }"), say("{ try { await {w}(x); } catch (Error e) { throw; } finally { Done(); } }"), say("{ if (x) throw new {w}Error(); return {a}; return  {a}; return {b}; }"))
    none = F.array().cast("array<string>")
    methods = parts(spark, sf_dir).select("p_partkey", F.col("w").alias("method_name"), F.lit("C#").alias("language"), body.alias("body"), none.alias("calls"), pick(3, none, none, many("{w}Error")).alias("thrown"), variables(("{v}", "int")).alias("fields"))
    lines = F.split("facts_text", "\n- ")
    return prompts.verified_facts(methods).select("p_partkey", F.array_join(F.slice(lines, 2, F.size(lines)), "|").alias("facts"))


@query("""
SELECT p_partkey, 'Last ' || a || ' here.' AS brief, 'PRE:' || chr(10) || '- ' || v || ' is set' || chr(10) || '- ' || b || ' > ' || n || chr(10) || 'POST:' || chr(10) || '- returns ' || b AS prepost,
  CASE WHEN n % 2 = 0 THEN 'none known' ELSE '- fails on ' || v END AS errors FROM p""")
def answer_sections(spark, sf_dir):
    answer = F.concat(say("intro\n### brief\nOne **{a}** line. Two.\n### CONDITIONS\nPre-conditions: {v} is set\n- {b} > {n}\n1.\nPOST:\n- returns {b}\n### Errors\n"), pick(2, F.lit("[unavailable]"), say("* fails on **{v}**")), say("\n### BRIEF\nLast {a} here. More."))
    doc = prompts.documentation(answer, {"errors": F.lit("none known"), "design": F.lit("")})
    return parts(spark, sf_dir).select("p_partkey", doc["brief"].alias("brief"), doc["prepost"].alias("prepost"), doc["errors"].alias("errors"))


@query("""
SELECT p_partkey, w || 'Error' AS type, CASE WHEN n % 2 = 0 THEN 'When ' || v ELSE 'Thrown in method body' END AS description FROM p
UNION ALL SELECT p_partkey, 'System.' || w || 'Error', 'When ' || v FROM p WHERE n % 2 = 0 UNION ALL SELECT p_partkey, upper(a) || 'Error', 'Of ' || b FROM p WHERE n % 2 = 1""")
def exceptions_card(spark, sf_dir):
    tags = pick(2, F.create_map(F.lit("summary"), F.lit("x"), say("exception:System.{w}Error"), say("When {v}")), F.create_map(F.lit("summary"), F.lit("x"), F.concat(F.lit("exception:"), F.upper("a"), F.lit("Error")), say("Of {b}")))
    return parts(spark, sf_dir).select("p_partkey", F.inline(structure.exceptions_of(many("{w}Error", "{w}ERROR"), tags)))


@query("""
SELECT p_partkey, 'Lives in' AS label, w || ' (Utility)' AS text FROM p UNION ALL SELECT p_partkey, 'That class depends on', CASE WHEN n % 2 = 0 THEN a || ', ' || b ELSE 'None' END FROM p
UNION ALL SELECT p_partkey, 'That class extends', CASE WHEN n % 2 = 0 THEN 'No base class' ELSE w || 'Base' END FROM p
UNION ALL SELECT p_partkey, 'This method calls', 'c1, c2, c3, c4, c5, ' || a FROM p WHERE n % 3 = 0 UNION ALL SELECT p_partkey, 'Inheritance', w || 'Base' FROM p WHERE n % 2 = 1""")
def fits_in_card(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = structure.fits_in(F.col("w"), F.lit("Utility"), pick(2, many("{a}", "{b}"), none), pick(2, F.lit(""), say("{w}Base")), pick(3, many("c1", "c2", "c3", "c4", "c5", "{a}", "{b}"), none, none), pick(2, none, many("{w}Base")))
    return parts(spark, sf_dir).select("p_partkey", F.inline(rows))


@query("""
SELECT p_partkey, 'What happens if the inputs to ' || w || ' are null or out of range?' AS question FROM p UNION ALL SELECT p_partkey, 'How is ' || w || ' called in the rest of the codebase?' FROM p
UNION ALL SELECT p_partkey, 'When exactly is ' || a || 'Error thrown?' FROM p WHERE n % 2 = 0 UNION ALL SELECT p_partkey, 'Can ' || w || ' be made asynchronous?' FROM p""")
def follow_up_questions(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", F.explode(structure.follow_ups(F.col("w"), pick(2, many("{a}Error"), F.array().cast("array<string>")))).alias("question"))


@query("""
SELECT p_type AS method, arg_min(p_name, p_partkey) AS question, min(p_partkey) AS ord FROM p WHERE upper(p_name) NOT IN (SELECT upper(x.p_name) FROM p x WHERE x.n % 10 = 0 AND x.p_type = p.p_type) GROUP BY p_type, upper(p_name)""")
def question_store(spark, sf_dir):
    rows = parts(spark, sf_dir)
    asked = rows.select(F.col("p_type").alias("method"), F.col("p_name").alias("question"), F.col("p_partkey").alias("ord"))
    more = rows.select(F.col("p_type").alias("method"), F.upper("p_name").alias("question"), (F.col("p_partkey") + 10**9).alias("ord"))
    gone = rows.filter("n % 10 = 0").select(F.col("p_type").alias("method"), F.lower("p_name").alias("question"))
    return structure.remove_questions(structure.add_questions(asked, more), gone)


@query("""
SELECT p_partkey, v || ',' || a || CASE WHEN n % 2 = 0 THEN '' ELSE ',' || b END AS fields FROM p""")
def variables_card(spark, sf_dir):
    pair = lambda n: F.struct(n.alias("name"), F.lit("int").alias("type"))
    own, structural = F.array(pair(F.col("v")), pair(F.col("a"))), F.array(pair(F.upper("a")), pair(F.col("w")), pair(pick(2, F.col("v"), F.col("b"))))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(F.transform(structure.variables_card(own, structural), lambda f: f["name"]), ",").alias("fields"))


def used_variables(spark, sf_dir):
    return structure.used_variables(rules.variable_usage(corpus.methods(spark.read.parquet(f"{sf_dir}/part.parquet"))))


QUERIES["used_variables"], SQL["used_variables"] = used_variables, f"SELECT * FROM ({corpus.usage_sql()}) WHERE usage <> 'Unused'"


@query("""
SELECT p_partkey AS method_id, 1 AS step, 'Validation' AS kind, CASE WHEN n % 2 = 0 THEN 'Validate the input preconditions; throws ' || w || 'Error if violated' ELSE CASE n % 3 WHEN 0 THEN 'Validate that all reference inputs are non-null before proceeding'
  WHEN 1 THEN 'Verify the divisor is non-zero to prevent arithmetic exceptions' ELSE 'Validate the index is within the bounds of the target collection' END END AS description FROM p
UNION ALL SELECT p_partkey, 2, 'Initialization', 'Initialize ' || v || ' for use in the processing logic' FROM p""")
def fallback_steps(spark, sf_dir):
    """Methods without a body: what else is known of them gives their steps."""
    none = F.array().cast("array<string>")
    rows = parts(spark, sf_dir).select(
        F.col("p_partkey").alias("method_id"), F.col("w").alias("method_name"), F.lit("void").alias("return_type"), F.lit("C++").alias("language"), F.lit(None).cast("string").alias("body"), variables(("{v}", "int")).alias("locals"),
        variables(("{a}", "int")).alias("fields"), pick(2, many("{w}Error"), none).alias("thrown"), pick(3, many("{v} must not be NULL"), many("{v} is zero"), many("{v} is used as an index")).alias("op_limits"),
    )
    return flow.dispatched_steps(rows)


#: Clauses of C# bodies, by group: (text, steps it gives). One clause of each group stands in a body, chosen by a digit of its own.
STEP_CLAUSES = (
    (
        ("// if ({v} == null) throw; Console.WriteLine({n});\n", ()), ("/* File.Delete({a});\n while (x) {{ */ ", ()), ('var {b}s = "File.Delete(a); while (x) \\" {{";\n', (("Initialization", "Initialize {b}s for use in the processing logic"),)),
        ('string {b}s = @"a "" }} throw; {n}"; ', (("Initialization", "Initialize {b}s for use in the processing logic"),)), ("char {b}c = '{{', {a}c = '\\''; ", (("Initialization", "Initialize {b}c for use in the processing logic"),)),
    ),
    (
        ("if ({v} == null) throw new E(); ", (("Validation", "Validate that {v} is not null before proceeding"),)), ("if (box.{v} <= 0) {{ Stop(); throw new E(); }} ", (("Validation", "Verify that {v} is non-zero to prevent invalid operations"),)),
        ("if ({v} < 0)\n throw new E(); ", (("Validation", "Ensure that {v} is a positive value as required"),)), ("if (string.IsNullOrEmpty({v})) {{ if (deep) {{ throw new E(); }} }} ", (("Validation", "Validate that {v} is not empty or whitespace"), ("Delegation", "Delegate the IsNullOrEmpty processing to the responsible component"), ("Validation", "Validate the input conditions before executing the core logic"))),
        ("if (" + "(" * 40 + "{v} == 0" + ")" * 40 + ") throw new E(); ", (("Validation", "Validate the input conditions before executing the core logic"),)), ("if ({v} == null || {n} < 0) throw new E(); ", (("Validation", "Validate the input conditions before executing the core logic"),)),
        ("if ({v} == null) return; ", (("ReturnResult", "Return the resulting value to the caller"),)), ("if (!Ready({v}, f(1))) Log = () => throw new E(); ", ()),
    ),
    (
        ("foreach (var o in {a}s.All(1)) {{ Use(o); }} ", (("LoopProcessing", "Process each element in {a}s.All(1) to produce the result"), ("Delegation", "Delegate the All processing to the responsible component"))), ("for (int i = 0; i < {n}; i++) {{ while (ready) Use(i); }} ", (("LoopProcessing", "Traverse the nested structure to process all contained elements"),)),
        ("while ({v} > 0) {{ Use(i => i); }} ", (("LoopProcessing", "Continue processing until the exit condition is satisfied"),)), ("do {{ Use({n}); }} while ({v} > {n}); ", ()), ("for (;;) Use(1); ", (("LoopProcessing", "Iterate over the index range to process each element sequentially"),)),
    ),
    (
        ("{a}x = {n} + f({v}); ", (("Calculation", "Calculate the result and store it in {a}x"),)), ("total += {n} * 2; ", (("Calculation", "Accumulate the running total into total"),)), ("{a}x = {v}; ", ()), ("{a}x = new List<int>(); ", ()), ("rows[{n}] = Get({v}); ", (("Calculation", "Calculate the result and store it in result"),)),
        ("count = {n}; ", (("StateUpdate", "Update the count field with the new computed value"),)), ("this.count++; ", (("StateUpdate", "Increment the count counter to record this operation"),)), ("var {a}x = {n} + 1; ", (("Initialization", "Initialize {a}x for use in the processing logic"),)),
    ),
    (
        ("Console.WriteLine($\"{{Math.Abs({n})}} of {{ {v} }}\"); ", (("ConsoleOutput", "Output information to the console during execution"), ("Calculation", "Apply the mathematical function to compute the precise result"))), ("File.Delete(\"while (x)\"); ", (("FileOperation", "Perform the required file system operation"),)),
        ("{a}Repository.Add({v}); ", (("DatabaseOperation", "Execute the database operation to persist the changes"),)), ("Log.Info({n}); ", (("ExternalCall", "Record the operation details for diagnostic and audit purposes"),)), ("bus.Publish({v}); ", (("Delegation", "Dispatch the result to the target destination"),)),
        ("store.Save({v}); ", (("DatabaseOperation", "Persist the processed data to the storage layer"),)), ("{a}.{w}({n}); ", (("Delegation", "Delegate the {w} processing to the responsible component"),)), ("Use({v}); ", ()),
    ),
    (
        ("try {{ Use(1); }} catch (E e) when (e.Ok) {{ throw; }} ", (("ExceptionHandling", "Catch and re-throw exceptions after performing any necessary cleanup"),)), ("try {{ Use(1); }} catch {{ }} finally {{ if (x) throw; }} ", (("ExceptionHandling", "Handle potential exceptions internally to ensure graceful recovery"), ("Validation", "Validate the input conditions before executing the core logic"))), ("", ()),
    ),
    (
        ("return box.{v}; ", (("ReturnResult", "Return the {v} value to the caller"),)), ("return {n} + 1; ", (("ReturnResult", "Return the resulting value to the caller"),)), ("return; ", (("ReturnResult", "Return the resulting value to the caller"),)),
    ),
)
def _sql_text(template: str) -> str:
    """A clause's sentence in SQL, over the columns of p."""
    out = "'" + template.replace("'", "''") + "'"
    for name in "abvw":
        out = f"replace({out}, '{{{name}}}', {name})" if "{" + name + "}" in template else out
    return out


def _step_rows() -> str:
    rows = []
    for g, (group, (step, size)) in enumerate(zip(STEP_CLAUSES, corpus.digits(STEP_CLAUSES), strict=True)):
        for i, (_, steps) in enumerate(group):
            rows += [f"SELECT p_partkey AS method_id, {g * 10 + k} AS pos, '{kind}' AS kind, {_sql_text(text)} AS description FROM k WHERE d // {step} % {size} = {i}" for k, (kind, text) in enumerate(steps)]
    return " UNION ALL ".join(rows)


@query(f"""
, k AS (SELECT *, p_partkey * {corpus.SCRAMBLE} % {corpus.MODULUS} AS d FROM p), s AS ({_step_rows()}),
m AS (SELECT * FROM (SELECT *, lag(kind) OVER (PARTITION BY method_id ORDER BY pos) AS before FROM s) WHERE kind IS DISTINCT FROM before),
o AS (SELECT *, list_position({list(flow.PHASES)}, kind) AS phase, count(*) OVER (PARTITION BY method_id) AS n_steps FROM m),
f AS (SELECT *, kind IN ('Calculation', 'Delegation') AS core, row_number() OVER (PARTITION BY method_id, kind IN ('Calculation', 'Delegation') ORDER BY phase, pos) AS nth FROM o),
c AS (SELECT method_id, pos, phase, CASE WHEN n_steps > 8 AND core THEN 'Calculation' ELSE kind END AS kind, CASE WHEN n_steps > 8 AND core THEN 'Perform the core processing logic on the provided inputs' ELSE description END AS description FROM f WHERE n_steps <= 8 OR NOT core OR nth = 1),
t AS (SELECT *, count(*) OVER (PARTITION BY method_id) AS n_left, row_number() OVER (PARTITION BY method_id, kind = 'ReturnResult' ORDER BY phase, pos) AS nth FROM c)
SELECT method_id, row_number() OVER (PARTITION BY method_id ORDER BY phase, pos) AS step, kind, description FROM t WHERE n_left <= 8 OR kind = 'ReturnResult' OR nth <= 7
UNION ALL SELECT p_partkey, 1, 'Calculation', 'Execute the ' || w || ' operation using the provided inputs' FROM p WHERE p_partkey NOT IN (SELECT method_id FROM s)""")
def csharp_steps(spark, sf_dir):
    """C# bodies of independent clauses, with comments, literals and deep brackets that are no code."""
    none = F.array().cast("array<string>")
    d = F.col("p_partkey") * corpus.SCRAMBLE % corpus.MODULUS
    clauses = [F.element_at(F.array(*[say(text.replace("{{", "\0").replace("}}", "\1")) for text, _ in group]), (F.floor(d / step) % size + 1).cast("int")) for group, (step, size) in zip(STEP_CLAUSES, corpus.digits(STEP_CLAUSES), strict=True)]
    body = F.translate(F.concat(F.lit("public int Run(int at)\n{ "), *clauses, F.lit("}")), "\0\1", "{}")
    rows = parts(spark, sf_dir).select(
        F.col("p_partkey").alias("method_id"), F.col("w").alias("method_name"), F.lit("int").alias("return_type"), F.lit("C#").alias("language"), body.alias("body"), variables().alias("locals"), variables(("count", "int")).alias("fields"),
        none.alias("thrown"), none.alias("op_limits"),
    )
    return flow.dispatched_steps(rows)


@query("""
SELECT p_partkey, '<|im_start|>system' || chr(10) || a || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || CASE n % 3 WHEN 0 THEN 'This is a C# method.' WHEN 1 THEN 'This is a C++ method. Never mention null checks for primitive types (int, double, float, bool, char). Focus on value ranges, mathematical constraints, and state changes.' ELSE '' END || b || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
  CASE WHEN n * 100 > 1024 THEN substr(repeat(p_name, 50), 1, greatest(64, CAST(floor(len(repeat(p_name, 50)) * 1024 / (n * 100)) AS INTEGER))) ELSE repeat(p_name, 50) END AS fitted, substr(p_name, 1, 8) AS snippet, 'kept ' || w AS cleaned FROM p""")
def prompt_texts(spark, sf_dir):
    note = prompts.language_note(pick(3, say("src/{w}.CS"), say("src/{w}.hpp"), say("src/{w}.py")))
    return parts(spark, sf_dir).select(
        "p_partkey", prompts.chat_prompt("chatml", F.col("a"), F.concat(note, F.col("b"))).alias("prompt"), prompts.within_budget(F.repeat("p_name", F.lit(50)), F.col("n") * 100).alias("fitted"),
        prompts.snippet(F.concat(F.lit("  "), F.col("p_name")), 8).alias("snippet"), prompts.clean_response(say(" kept {w}<|im_end|> more {a}"), "chatml").alias("cleaned"),
    )


@query("""
SELECT p_partkey AS id, 'Shop.' || p_type || '.' || w || '_' || p_partkey AS method, 'Shop.' || p_type AS type, CASE WHEN n % 2 = 0 THEN b ELSE a END AS merged_summary, CASE WHEN n % 3 = 0 THEN a || ',' || b ELSE '' END AS calls FROM p""")
def method_detail(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumns({"name": F.concat("w", F.lit("_"), F.col("p_partkey").cast("string")), "declaring": F.concat(F.lit("Shop."), "p_type")}).withColumn("full_name", F.concat("declaring", F.lit("."), "name"))
    methods = rows.select(F.col("p_partkey").alias("ord"), "full_name", F.col("p_type").alias("class_name"), F.col("name").alias("method_name"))
    types = rows.groupBy("p_type", "declaring").agg(F.min("p_partkey").alias("ord")).select("ord", F.col("p_type").alias("name"), F.col("declaring").alias("full_name"))
    known = rows.select("full_name", "declaring", F.concat(F.lit(" "), "b").alias("summary"), pick(3, many("{a}", "{b}"), *[F.array().cast("array<string>")] * 2).alias("calls"))
    asked = rows.select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("class_name"), F.upper("name").alias("method_name"), pick(2, F.lit("  "), F.col("a")).alias("summary"))
    return structure.detail(asked, methods, types, known).select("id", "method", "type", "merged_summary", F.array_join("call_targets", ",").alias("calls"))


@query("""
SELECT p_partkey AS method_id, '{"className":"' || w || '","methodName":"' || a || '","filePath":"' || b || '.cs","preconditions":["' || v || ' is set"' || CASE WHEN n % 2 = 0 THEN ',"Not ' || n || '"' ELSE '' END || '],"postconditions":[],"stateChanges":[],'
  || '"executionSteps":[{"stepNumber":1,"description":"Use ' || a || '"},{"stepNumber":2,"description":"Use ' || b || '"}],"designConstraints":[],"runtimeRisks":["May fail"],'
  || '"variableLimits":[{"name":"' || v || '","type":"int","scope":"Parameter","allowedValues":"at most ' || n || '","readFrom":"x","source":"Guard","confidence":"High"}]}' AS json FROM p""")
def export_full_json(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("method_id", F.col("p_partkey"))
    found = lambda analyzer, i, text: F.struct(F.lit(analyzer).alias("analyzer"), F.lit(i).alias("emit_ord"), text.alias("description"))
    every = F.array(found("preconditions", 0, say("{v} is set")), F.when(F.col("n") % 2 == 0, found("preconditions", 1, say("Not {n}"))), found("runtime_risks", 0, F.lit("May fail")))
    findings = rows.select("method_id", F.inline(F.filter(every, lambda x: x.isNotNull())))
    steps = rows.select("method_id", F.posexplode(many("Use {a}", "Use {b}")).alias("k", "description")).select("method_id", (F.col("k") + 1).alias("step"), "description")
    limits = rows.select("method_id", F.col("v").alias("name"), F.lit("int").alias("type"), F.lit("Parameter").alias("scope"), say("at most {n}").alias("limit"), F.lit("x").alias("evidence"), F.lit("Guard").alias("source"), F.lit("High").alias("confidence"))
    methods = rows.select("method_id", F.col("w").alias("class_name"), F.col("a").alias("method_name"), F.concat("b", F.lit(".cs")).alias("path"))
    return reports.full_json(methods, findings, steps, limits)


@query("""
, t AS (SELECT n_nationkey AS k, n_name AS name, r_name AS base FROM nation JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT DISTINCT k FROM t JOIN supplier ON s_nationkey = k), q AS (SELECT DISTINCT k FROM t JOIN customer ON c_nationkey = k)
SELECT 0 AS section, unnest(['# Project: P', '', '## Overview', '', '| Metric | Value |', '|--------|-------|', '| Files | 1 |', '| Classes | ' || (SELECT count(*) FROM nation) || ' |', '| Methods | 2 |', '| Properties | 3 |', '', '## Namespaces', '']) AS line
UNION ALL SELECT 1, unnest(['### ' || base, '', '**Classes:**', '']) FROM t GROUP BY base UNION ALL SELECT 1, '- `' || name || '`' FROM t
UNION ALL SELECT 2, unnest(['## Classes', '']) UNION ALL SELECT 2, unnest(['### ' || name, '', '- **Kind:** class', '- **Access:** public', '- **Base types:** ' || base, '- **File:** `f' || k || '`', '']) FROM t
UNION ALL SELECT 2, unnest(['#### Methods', '', '| Name | Return | Params |', '|------|--------|--------|', '']) FROM m UNION ALL SELECT 2, '| `' || s_name || '` | `int` | int a, int b |' FROM supplier JOIN t ON s_nationkey = k
UNION ALL SELECT 2, unnest(['#### Properties', '', '']) FROM q UNION ALL SELECT 2, '- `' || c_mktsegment || ' ' || c_name || '`' FROM customer JOIN t ON c_nationkey = k
UNION ALL SELECT 3, unnest(['## Relationships', '', '| Source | Kind | Target |', '|--------|------|--------|']) UNION ALL SELECT 3, '| ' || s_name || ' | CALLS | ' || name || ' |' FROM supplier JOIN t ON s_nationkey = k""")
def export_structural_markdown(spark, sf_dir):
    nation, region, supplier, customer = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("nation", "region", "supplier", "customer"))
    own = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    types = own.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("full_name"), F.lit("class").alias("kind"), F.lit("public").alias("access"), F.array("r_name").alias("bases"), F.array().cast("array<string>").alias("interfaces"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file"))
    project = types.agg(F.lit("P").alias("projectName"), F.lit(1).alias("filesAnalyzed"), F.count("*").alias("classes"), F.lit(2).alias("methods"), F.lit(3).alias("properties"))
    spaces = structure.grouped_namespaces(own.select(F.col("n_nationkey").alias("ord"), F.col("r_name").alias("namespace"), F.col("n_name").alias("full_name")))
    run_by = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    methods = run_by.select(F.col("s_nationkey").alias("type_ord"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.lit("int").alias("returns"), F.array(F.lit("int a"), F.lit("int b")).alias("params"))
    properties = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_nationkey").alias("type_ord"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))
    links = run_by.select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("source"), F.lit("CALLS").alias("kind"), F.col("n_name").alias("target"))
    return reports.structural_markdown(project, spaces, types, methods, properties, links).select("section", "line")
