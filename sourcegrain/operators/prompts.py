"""Deterministic text shaping around a language model: fences, budgets, sections and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexing
from ..functions import text as T
from ..functions.text import bind

OPENING, CLOSING = "<<<CODE", "CODE>>>"


def fence(text: Column) -> Column:
    """The text between two markers; what looks like a marker inside, in any case, is blanked."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<<<\s*CODE|CODE\s*>>>", " ")
    return F.concat(F.lit(OPENING + "\n"), F.regexp_replace(inner, r"\s+$", ""), F.lit("\n" + CLOSING))


def sanitize(text: Column) -> Column:
    """Without template marks <|...|> of up to 32 characters inside, and control characters but tab, line feed and return."""
    return F.regexp_replace(F.regexp_replace(text, r"<\|[^|]{0,32}\|>", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def truncate_prose(text: Column, sentences: int, words: int) -> Column:
    """At most so many sentences, cut at every . ! ?, and words; a text that starts with [ stays."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))

    def few(flat: Column) -> Column:
        ended = F.filter(F.split(flat, r"(?<=[.!?])"), lambda s: s.rlike(r"[.!?]$"))
        return bind(ended, lambda e: F.when(F.size(e) > sentences, F.trim(F.array_join(F.slice(e, 1, sentences), ""))).otherwise(flat))

    def short(prose: Column) -> Column:
        return bind(F.split(prose, " "), lambda w: F.when(F.size(w) > words, F.concat(F.array_join(F.slice(w, 1, words), " "), F.lit("…"))).otherwise(prose))

    return F.when(F.trim(text).startswith("["), text).otherwise(bind(bind(flat, few), short))


def cache_key(*parts: Column) -> Column:
    return F.upper(F.sha2(F.concat_ws("|", *parts), 256))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation. turns: conv_id, turn."""
    return turns.withColumn("_rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))).filter(F.col("_rn") <= n).drop("_rn")


def sections(lines: DataFrame) -> DataFrame:
    """lines (id, pos, line) that follow a PRE or POST marker line, with their section; markers and blank lines go."""
    marker = F.upper(F.regexp_extract("line", r"(?i)^[ \t#*]*(PRE|POST)(?:CONDITIONS?)?[ \t]*:?[ \t*]*$", 1))
    marked = lines.withColumn("marker", F.nullif(marker, F.lit("")))
    section = F.last("marker", ignorenulls=True).over(W.partitionBy("id").orderBy("pos"))
    return marked.withColumn("section", section).filter(F.col("marker").isNull() & F.col("section").isNotNull() & (F.trim("line") != "")).select("id", "pos", "section", "line")


#: What marks the end of an answer, by template; calls that change a collection; headers and texts of prompts.
END_MARKS = {"phi": ("<|end|>", "<|user|>", "<|system|>", "<|assistant|>"), "chatml": ("<|im_end|>", "<|im_start|>"), "plain": ("[INST]", "</s>")}
MUTATORS = "Add|AddRange|Remove|RemoveAll|RemoveAt|Clear|Insert|Push|Pop|Enqueue|Dequeue|push_back|pop_back|erase|clear|insert"
SECTIONS = ("BRIEF", "CONDITIONS", "DESIGN", "ERRORS", "EXPLANATION")
EMPTY_ANSWER = "[The model returned an empty response.]"
LANGUAGE_NOTES = {
    "C#": "This is a C# method.",
    "C++": "This is a C++ method. Never mention null checks for primitive types (int, double, float, bool, char). Focus on value ranges, mathematical constraints, and state changes.",
}
FACTS_HEAD = "Verified facts from code analysis (authoritative: never contradict them):"
#: The parts of a method's documentation that are cached under keys of their own.
OPERATIONS = ("brief", "prepost", "design", "errors", "explain")


def without_emphasis(text: Column) -> Column:
    """text without "**", then without "__", also those that stand together only then."""
    return F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))


def is_debris(line: Column) -> Column:
    """Whether a line says nothing: blank, a bare mark, a lone number."""
    t = F.trim(line)
    return (t == "") | t.isin(">", "-", "*", "•", "#") | t.rlike(r"^\d+[.)]?$")


def is_clean(text: Column) -> Column:
    """Whether an answer may be cached: not blank, and no bracketed message."""
    return F.coalesce((F.trim(text) != "") & ~F.trim(text).startswith("["), F.lit(False))


def clean_response(text: Column, template: str = "plain") -> Column:
    """An answer up to the first mark of its template's end, each mark in turn; a message for an empty one."""
    out = F.trim(text)
    for mark in END_MARKS[template]:
        out = F.trim(F.substring_index(out, mark, 1))
    return bind(out, lambda t: F.when(t == "", EMPTY_ANSWER).otherwise(t))


def _few_words(line: Column, words: int) -> Column:
    return bind(F.filter(F.split(line, r"\s+"), lambda w: w != ""), lambda w: F.when(F.size(w) > words, F.concat(F.array_join(F.slice(w, 1, words), " "), F.lit("…"))).otherwise(line))


def truncate_bullets(text: Column, bullets: int, words: int) -> Column:
    """At most so many bullets of so many words; debris goes; a text without bullets, or in brackets, stays."""

    def line(raw: Column) -> Column:
        return F.regexp_replace(without_emphasis(F.trim(raw)), r"^[-•*# ]+", "")

    kept = F.filter(F.transform(F.split(text, "\n"), line), lambda x: ~is_debris(x))
    few = F.transform(F.slice(kept, 1, bullets), lambda x: F.concat(F.lit("- "), _few_words(x, words)))
    return F.when(text.startswith("["), text).otherwise(bind(few, lambda b: F.when(F.size(b) > 0, F.array_join(b, "\n")).otherwise(text)))


def conditions(text: Column) -> Column:
    """pre, post and other: the bullets of an answer after a PRE: line, after a POST: line (in any spelling of
    precondition, text behind the colon is a bullet), and before both; grouped: whether it has any such line."""
    clean = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(T.collapse(x)), r"^[-•*# ]+", ""))), lambda x: x != "")
    mark = lambda x: F.regexp_extract(F.upper(F.regexp_replace(F.regexp_extract(x, r"^([^:]+):", 1), "[- ]", "")), r"^(PRE|POST)(?:CONDITIONS?)?$", 1)
    none = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        m = mark(x)
        now = F.when(m != "", m).otherwise(s["now"])
        bullet = F.when(m != "", F.trim(F.regexp_replace(x, r"^[^:]*:", ""))).otherwise(x)
        add = lambda group, list_: F.when((now == group) & (bullet != ""), F.concat(list_, F.array(bullet))).otherwise(list_)
        return F.struct(now.alias("now"), add("PRE", s["pre"]).alias("pre"), add("POST", s["post"]).alias("post"), add("", s["other"]).alias("other"))

    start = F.struct(F.lit("").alias("now"), none.alias("pre"), none.alias("post"), none.alias("other"))
    lines = F.when(F.ltrim(text).startswith("["), none).otherwise(clean)
    return F.aggregate(lines, start, step, lambda s: F.struct(s["pre"].alias("pre"), s["post"].alias("post"), s["other"].alias("other"), (s["now"] != "").alias("grouped")))


def truncate_conditions(text: Column, bullets: int, words: int) -> Column:
    """PRE and POST bullets, at most so many in each; a text without the marks as plain bullets, twice as many."""

    def shaped(c: Column) -> Column:
        group = lambda mark, list_: F.concat(F.array(F.lit(mark)), F.transform(F.slice(F.filter(list_, lambda b: ~is_debris(b)), 1, bullets), lambda b: F.concat(F.lit("- "), without_emphasis(_few_words(b, words)))))
        return F.when(c["grouped"], F.array_join(F.concat(group("PRE:", c["pre"]), group("POST:", c["post"])), "\n")).otherwise(truncate_bullets(text, 2 * bullets, words))

    return F.when(text.startswith("["), text).otherwise(bind(conditions(text), shaped))


def split_sections(answer: Column) -> Column:
    """Map of the texts under "### NAME" lines, names in capitals; the last of a name wins."""

    def of_parts(parts: Column) -> Column:
        entries = F.transform(parts, lambda p: F.struct(F.upper(F.trim(F.regexp_replace(F.regexp_extract(p, r"^([^\n]*)", 1), r"^[# ]+", ""))).alias("key"), F.trim(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"(?m)^[ \t]+|[ \t\r]+$|\s+\z", "")).alias("value")))
        return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])))

    return bind(F.slice(F.split(F.concat(F.lit("\n"), answer), r"\n[ \t]*###"), 2, 1_000_000), of_parts)


def shape_brief(text: Column) -> Column:
    return truncate_prose(without_emphasis(text), 1, 35)


def shape_explanation(text: Column) -> Column:
    return truncate_prose(without_emphasis(text), 3, 80)


def shape_class(text: Column) -> Column:
    """An explanation without the markup that may trail it."""
    return F.regexp_replace(shape_explanation(text), r"\s*+(?:[><|`#]++\s*+)?$", "")


SHAPES = {
    "brief": shape_brief, "prepost": lambda t: truncate_conditions(t, 3, 20), "design": lambda t: truncate_bullets(t, 4, 20), "errors": lambda t: truncate_bullets(t, 4, 22), "explain": shape_explanation,
}


def section_or(sections_map: Column, name: str, shape, fallback: Column) -> Column:
    """A section in its shape if it is clean, else the fallback."""
    return bind(shape(F.element_at(sections_map, name)), lambda t: F.when(is_clean(t), t).otherwise(fallback))


def documentation(answer: Column, fallbacks: dict[str, Column]) -> Column:
    """The five sections of a merged answer by operation, each in its shape."""
    return bind(split_sections(answer), lambda m: F.struct(*[section_or(m, name, SHAPES[op], fallbacks.get(op, F.lit(None).cast("string"))).alias(op) for name, op in zip(SECTIONS, OPERATIONS, strict=True)]))


def language_note(path: Column) -> Column:
    """What a prompt adds for the language of a file."""
    low = F.lower(path)
    return F.when(low.endswith(".cs"), LANGUAGE_NOTES["C#"]).when(low.rlike(r"\.(?:cpp|hpp|h)$"), LANGUAGE_NOTES["C++"]).otherwise("")


def snippet(body: Column, length: int = 800) -> Column:
    return F.substring(F.trim(body), 1, length)


def within_budget(text: Column, tokens: Column, budget: int = 1024, least: int = 64) -> Column:
    """The share of a text that a budget of tokens allows, at least so many characters."""
    return F.when(tokens > budget, F.substring(text, F.lit(1), F.greatest(F.lit(least), F.floor(F.length(text) * budget / tokens)).cast("int"))).otherwise(text)


def chat_prompt(template: str, system: Column, user: Column) -> Column:
    """A system and a user message in a chat template."""
    if template == "phi":
        return F.concat(F.lit("<|system|>"), system, F.lit("<|end|><|user|>"), user, F.lit("<|end|><|assistant|>"))
    if template == "chatml":
        return F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.concat(F.lit("[INST] "), system, F.lit("\n\n"), user, F.lit(" [/INST]"))


# Facts of a method, for prompts.


def any_mutation(body: Column) -> Column:
    """Whether a body assigns, counts or changes a collection anywhere."""
    return body.rlike(r"[+\-*/%|&^]=(?!=)") | body.rlike(r"(?<![=!<>+\-*/%|&^])=(?!=|>)") | body.rlike(r"\+\+|--") | body.rlike(rf"\.\s*(?:{MUTATORS})\s*\(")


def mutated_fields(body: Column, fields: Column, writes: Column) -> Column:
    """Names of the fields that a body writes or calls a changing method of."""
    called = T.found(body, r"\b([A-Za-z_]\w*)\s*\.\s*(?:" + MUTATORS + r")\s*\(")
    return F.filter(F.transform(fields, lambda f: f["name"]), lambda n: (n != "") & (T.written(writes, n) | F.array_contains(called, n)))


def return_statements(body: Column, most: int = 4, length: int = 70) -> Column:
    """The first distinct return statements, expressions cut at `length`."""

    def line(raw: Column) -> Column:
        return bind(T.collapse(raw), lambda e: F.when(e == "", "return;").otherwise(F.concat(F.lit("return "), F.when(F.length(e) > length, F.concat(F.substring(e, 1, length), F.lit("…"))).otherwise(e), F.lit(";"))))

    return F.slice(F.array_distinct(F.transform(T.found(body, r"\breturn\b([^;]*);"), line)), 1, most)


def is_recursive(name: Column, calls: Column, body: Column, language: Column) -> Column:
    """Whether a method calls itself: by its list of calls, else by its text, which in C++ holds the signature too."""
    named = F.exists(calls, lambda c: (c == name) | c.endswith(F.concat(F.lit("."), name)))
    times = F.size(F.filter(T.found(body, r"\b([A-Za-z_]\w*)\s*\("), lambda n: n == name))
    return (name != "") & (F.coalesce(named, F.lit(False)) | (times >= F.when(language == "C#", 1).otherwise(2)))


def verified_facts(methods: DataFrame) -> DataFrame:
    """methods with facts_text: lines on what a method throws, awaits, locks, catches, changes and returns.

    methods: method_name, language, body, calls, thrown, fields (name, type). A null body is blank.
    """
    body = F.trim(F.coalesce(F.col("body"), F.lit("")))
    rows = methods.withColumn("_b", body).withColumns({"_w": T.writes(F.col("_b")), "_swallows": lexing.guards_of(F.col("_b"))["swallows"]})
    b = F.col("_b")
    any_body = b != ""
    when = lambda c, text: F.when(c, text if isinstance(text, Column) else F.lit(text))
    changed = mutated_fields(b, F.col("fields"), F.col("_w"))
    returns = return_statements(b)
    lines = F.array(
        F.when(F.size("thrown") > 0, F.concat(F.lit("Throws: "), F.array_join("thrown", ", "), F.lit("."))).when(any_body, F.when(T.matches(b, r"\bthrow\b"), "Contains throw statements.").otherwise("Contains no throw statements.")),
        when(is_recursive(F.col("method_name"), F.col("calls"), b, F.col("language")), "Recursive: the method calls itself."),
        when(b.contains("await "), "Asynchronous: awaits one or more operations."),
        when(T.matches(b, r"\block\s*\(") | b.contains("std::lock_guard"), "Uses a lock for thread safety."),
        when(T.matches(b, r"\bcatch\b"), F.when(F.col("_swallows"), "Catches exceptions internally without rethrowing; callers get a normal return value instead of the exception.").otherwise("Contains try/catch handling.")),
        when(T.matches(b, r"\bcatch\b") & T.matches(b, r"\bfinally\b"), "Has a finally block that always runs."),
        when(any_body & (F.size(changed) > 0), F.concat(F.lit("Modifies class state: "), F.array_join(changed, ", "), F.lit("."))),
        when(any_body & (F.size(changed) == 0) & ~any_mutation(b), "Modifies no state: the body contains no assignments or mutating calls."),
        when(any_body & (F.size(returns) > 0), F.concat(F.lit("Return statements: "), F.array_join(returns, " ; "))),
    )
    text = F.concat(F.lit(FACTS_HEAD), F.array_join(F.transform(F.filter(lines, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("\n- "), x)), ""))
    return rows.withColumn("facts_text", text).drop("_b", "_w", "_swallows")


def describe_compact(returns: Column, name: Column, params: Column, class_name: Column, summary: Column, limits: Column, facts_text: Column, body: Column) -> Column:
    """The text about a method that a prompt holds."""
    line = lambda lead, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(lead), text))
    return F.concat_ws(
        "\n", F.concat(F.lit("Method: "), returns, F.lit(" "), name, F.lit("("), F.array_join(params, ", "), F.lit(")")), F.concat(F.lit("Class: "), F.coalesce(class_name, F.lit("unknown"))),
        line("Summary: ", summary), line("Guards: ", F.array_join(F.slice(limits, 1, 3), "; ")), facts_text, line("Source: ", snippet(body)),
    )


def documentation_prompt(instructions: dict[str, str], note: Column, described: Column) -> Column:
    """A prompt for all sections: a header and what to write for each, in order, the note on the language, the fenced text."""
    heads = [F.lit(f"### {name}\n{instructions[name]}") for name in SECTIONS]
    return F.concat_ws("\n", *heads, F.when(note != "", note), F.lit(""), fence(described))


# The cache of answers.


def keep_clean(entries: DataFrame) -> DataFrame:
    """The entries (key, value) that may be stored; of a key the last by `created`."""
    last = W.partitionBy("key").orderBy(F.col("created").desc())
    return entries.filter(is_clean(F.col("value"))).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def forget(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cache without the entries of some keys."""
    return cache.join(keys.select("key"), "key", "left_anti")


def fully_cached(cache: DataFrame, operations: tuple[str, ...] = OPERATIONS) -> DataFrame:
    """The methods whose sections are all cached. cache: method_id, operation."""
    return cache.filter(F.col("operation").isin(*operations)).groupBy("method_id").agg(F.count_distinct("operation").alias("n")).filter(F.col("n") == len(operations)).select("method_id")


def instruction_prompt(instruction: str, note: Column, described: Column) -> Column:
    """A prompt of one instruction, the note on the language and the fenced text."""
    return F.concat_ws("\n", F.lit(instruction), F.when(note != "", note), F.lit(""), fence(described))


def describe_full(methods: DataFrame) -> DataFrame:
    """methods with described: all that is known of a method, a line each.

    methods: method_name, return_type, access, class_name, params, summary, thrown, op_limits, fields (access, type, name), locals (type, name), body.
    """
    line = lambda lead, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(lead), text))
    block = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(F.transform(items, lambda x: F.concat(F.lit("\n  "), x)), "")))
    return methods.withColumn("described", F.concat_ws(
        "\n", line("Method name: ", F.col("method_name")), line("Return type: ", F.col("return_type")), line("Access: ", F.col("access")), F.concat(F.lit("Parent class: "), F.coalesce("class_name", F.lit("unknown"))),
        F.concat(F.lit("Parameters: "), F.when(F.size("params") > 0, F.array_join("params", ", ")).otherwise("none")), line("Existing doc summary: ", F.col("summary")), line("Thrown exceptions: ", F.array_join("thrown", ", ")),
        block("Operational limits from code:", F.transform("op_limits", lambda x: F.concat(F.lit("- "), x))), block("Class fields:", F.transform("fields", lambda f: F.concat_ws(" ", f["access"], f["type"], f["name"]))),
        block("Local variables:", F.transform("locals", lambda v: F.concat_ws(" ", v["type"], v["name"]))), line("Source: ", snippet(F.col("body")))))
