"""What a declaration's text says: bases, access, documentation, types it depends on, and facts of C++ bodies.

Each function is a Column over one row; texts come from rows, one a
declaration, so nothing here reads files or parses whole programs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexing
from . import text as T

#: Types that aren't dependencies, and access words from the widest.
CSHARP_PLAIN = (
    "string", "int", "bool", "void", "object", "char", "byte", "sbyte", "short", "ushort", "uint", "long", "ulong", "float", "double", "decimal", "nint", "nuint", "dynamic", "var",
    "String", "Int32", "Boolean", "Object", "Char", "Byte", "Int16", "Int64", "Double", "Single", "Decimal", "Void",
)
CPP_PLAIN = (
    "void", "bool", "char", "wchar_t", "char16_t", "char32_t", "int", "short", "long", "float", "double", "unsigned", "signed", "size_t", "nullptr_t",
    "int8_t", "int16_t", "int32_t", "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "string", "object", "decimal",
)
ACCESS = ("public", "protected", "private", "internal")
#: Numeric types of C++.
CPP_NUMBERS = (
    "int", "long", "short", "float", "double", "size_t", "uint32_t", "uint64_t", "int32_t", "int64_t", "unsigned int", "unsigned long", "ptrdiff_t", "uint8_t", "uint16_t", "int8_t", "int16_t",
)

_NONE = "array<string>"


def first_of_each(values: Column, key=lambda v: v) -> Column:
    """values whose key isn't that of an earlier one."""
    keyed = lambda a: F.struct(a.alias("a"), F.transform(a, key).alias("k"))
    return T.bind(values, lambda a: T.bind(keyed(a), lambda x: F.filter(x["a"], lambda v, i: F.array_position(x["k"], F.get(x["k"], i)) == i + 1)))


def looks_like_interface(name: Column) -> Column:
    return name.rlike(r"^I\p{Lu}")


def split_bases(bases: Column) -> Column:
    """base (the first that isn't an interface) and interfaces of a list of base types."""
    simple = F.transform(bases, lambda b: F.trim(b))
    return F.struct(F.get(F.filter(simple, lambda b: ~looks_like_interface(b)), F.lit(0)).alias("base"), F.filter(simple, looks_like_interface).alias("interfaces"))


def access_of(modifiers: Column) -> Column:
    """The widest access among modifiers; private without any."""
    return F.coalesce(*[F.when(F.array_contains(modifiers, a), F.lit(a)) for a in ACCESS], F.lit("private"))


def signature_text(declaration: Column, body: Column) -> Column:
    """A declaration without its body, which is cut off at its last place."""
    at = F.length(declaration) - F.instr(F.reverse(declaration), F.reverse(body)) - F.length(body) + 1
    return F.when((F.length(body) > 0) & declaration.contains(body), F.trim(F.substring(declaration, F.lit(1), at))).otherwise(F.trim(declaration))


def with_limit(limits: Column, conditions: Column, prefix: str = "When ") -> Column:
    """limits and the conditions, with the prefix unless it is there; the first of those that differ in case only."""
    started = F.transform(conditions, lambda c: F.when(F.upper(c).startswith(prefix.upper()) | F.lit(prefix == ""), c).otherwise(F.concat(F.lit(prefix), c)))
    return first_of_each(F.concat(limits, started), F.upper)


def type_names(type_: Column) -> Column:
    """The names in a type that may be dependencies: of generic arguments, elements of arrays and tuples, in order."""
    unnamed = F.regexp_replace(type_, r"(?<=[\w>\]?])\s+[A-Za-z_]\w*(?=\s*[,)])", "")
    words = T.found(F.regexp_replace(unnamed, r"[A-Za-z_]\w*(?:::|\.)", ""), r"\b([A-Za-z_]\w*+)(?!\s*<)")
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*CSHARP_PLAIN, "ref", "out", "in", "params")))


def dependencies(types: Column) -> Column:
    """The distinct names in a list of types, in order."""
    return F.array_distinct(F.flatten(F.transform(types, type_names)))


def cpp_dependencies(types: Column) -> Column:
    """The distinct simple names of a list of C++ types, in order, without built-in ones."""
    return F.array_distinct(F.filter(F.transform(types, lambda t: simple_cpp_type(t)), lambda n: (n != "") & ~n.isin(*CPP_PLAIN)))


def simple_cpp_type(type_: Column, depth: int = 3) -> Column:
    """The name behind a C++ type: of a template the first argument, unless it is a built-in type; arguments nest up to `depth`."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(type_, "const|volatile|static", "")), r"[&*\s]+$", ""))
    outer = F.trim(F.regexp_replace(bare, r"(?s)(?<=.)<.*$", ""))
    last = F.trim(F.regexp_replace(outer, r"(?s)^.*::", ""))
    if depth == 0:
        return last
    inner = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^<]+<(.*)$", 1), ">+$", "")), r"(?s)(?<=.),.*$", ""))
    return T.bind(F.struct(inner.alias("inner"), last.alias("last")), lambda x: F.when(x["inner"] != "", T.bind(simple_cpp_type(x["inner"], depth - 1), lambda s: F.when((s != "") & ~s.isin(*CPP_PLAIN), s).otherwise(x["last"]))).otherwise(x["last"]))


def owner_of(spelling: Column) -> Column:
    """What stands before the last "::" of a name, without its parameters."""
    return F.regexp_extract(F.regexp_replace(spelling, r"\(.*$", ""), r"^(.*)::", 1)


def split_parameter(parameter: Column) -> Column:
    """type and name, divided at the last blank; a single word is a type of "value"."""
    p = F.trim(parameter)
    return F.when(p.contains(" "), F.struct(F.trim(F.regexp_extract(p, r"(?s)^(.*) ", 1)).alias("type"), F.regexp_extract(p, r"(?s) ([^ ]*)$", 1).alias("name"))).otherwise(F.struct(p.alias("type"), F.lit("value").alias("name")))


def dedent(text: Column) -> Column:
    """text without the indent that its lines from the second on share; blank lines don't count."""

    def cut(lines: Column) -> Column:
        indent = F.array_min(F.transform(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(F.regexp_replace(x, "^[\t ]+", "")))))
        return F.array_join(F.transform(lines, lambda x, i: F.when((i == 0) | indent.isNull(), x).when(F.trim(x) == "", F.lit("")).otherwise(F.substring(x, indent + 1, F.length(x)))), "\n")

    return T.bind(F.split(text, "\n"), cut)


# Documentation.


def xml_text(content: Column) -> Column:
    """Text of an XML documentation element: references by their name, other tags gone, white space collapsed."""
    named = F.regexp_replace(content, r"<(?:see|seealso|paramref|typeparamref)\s+(?:cref|name|langword)\s*=\s*\"(?:[A-Z]:)?([^\"]*)\"\s*/?>", "$1")
    plain = F.regexp_replace(named, r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return T.collapse(plain)


def xml_tags(comment: Column) -> Column:
    """Map of the tags of an XML documentation comment: by name, "param:NAME" and "exception:TYPE"; blank ones go, the last of a key wins."""
    plain = F.regexp_replace(comment, r"(?m)^\s*///\s?", "")
    pattern = r"(?s)<(summary|remarks|returns|value|example|param|exception|typeparam)\b([^>]*)>(.*?)</\1>"
    kinds, attributes, texts = (F.regexp_extract_all(plain, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))

    def entry(m: Column) -> Column:
        name = F.regexp_extract(m["a"], r"(?:name|cref)\s*=\s*\"(?:[A-Z]:)?([^\"]*)\"", 1)
        return F.struct(F.when(m["k"].isin("param", "exception", "typeparam"), F.concat(m["k"], F.lit(":"), name)).otherwise(m["k"]).alias("key"), xml_text(m["t"]).alias("value"))

    return _last_wins(F.filter(F.transform(F.arrays_zip(kinds.alias("k"), attributes.alias("a"), texts.alias("t")), entry), lambda e: e["value"] != ""))


def _last_wins(entries: Column) -> Column:
    return T.bind(entries, lambda a: F.map_from_entries(F.filter(a, lambda e, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda x: x["key"] == e["key"]))))


def doxygen_lines(comment: Column) -> Column:
    """The lines of a Doxygen comment without its marks; blank lines go."""
    bare = F.transform(F.split(comment, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(T.collapse(x), r"^(?:/\*\*|/\*!|///)\s*", ""), r"\s*\*/$", ""), r"^\*\s*", "")))
    return F.filter(bare, lambda x: x != "")


def doxygen_tags(comment: Column) -> Column:
    """Map of a Doxygen comment: summary, returns, "param:NAME", "exception:TYPE". A tag's text runs over the lines up to
    the next tag; what stands before the first tag is the summary where none is given."""
    tag = r"^[@\\](brief|param|returns?|throws|exception)\b\s*"

    def of_lines(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(tag), i)), lambda i: i.isNotNull())

        def entry(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(lines))
            line = F.get(lines, at)
            kind = F.regexp_extract(line, tag, 1)
            value = T.collapse(F.array_join(F.concat(F.array(F.regexp_replace(line, tag, "")), F.slice(lines, at + 2, end - at - 1)), " "))
            first, rest = F.regexp_extract(value, r"^(\S*)", 1), F.trim(F.regexp_replace(value, r"^\S*", ""))
            param = F.when(rest != "", F.struct(F.concat(F.lit("param:"), first).alias("key"), rest.alias("value")))
            raised = F.when(first != "", F.struct(F.concat(F.lit("exception:"), first).alias("key"), rest.alias("value")))
            plain = F.struct(F.when(kind == "brief", "summary").otherwise("returns").alias("key"), value.alias("value"))
            return F.when(kind == "param", param).when(kind.isin("throws", "exception"), raised).otherwise(plain)

        entries = F.filter(F.transform(starts, entry), lambda e: e.isNotNull())
        before = F.slice(lines, 1, F.coalesce(F.get(starts, F.lit(0)), F.size(lines)))
        summary = F.when((F.size(before) > 0) & ~F.exists(entries, lambda e: e["key"] == "summary"), F.array(F.struct(F.lit("summary").alias("key"), F.array_join(before, " ").alias("value"))))
        return F.concat(F.coalesce(summary, F.array().cast("array<struct<key:string,value:string>>")), entries)

    return _last_wins(T.bind(doxygen_lines(comment), of_lines))


def documented_exceptions(tags: Column) -> Column:
    return F.transform(F.filter(F.map_keys(tags), lambda k: F.lower(k).startswith("exception:")), lambda k: F.substring(k, F.lit(11), F.length(k)))


def exception_description(tags: Column, exception: Column) -> Column:
    """The text of the first documented exception whose name is, or ends with, the given one in any case."""
    hit = F.filter(F.map_entries(tags), lambda e: F.lower(e["key"]).startswith("exception:") & F.upper(e["key"]).endswith(F.upper(exception)))
    return F.get(hit, F.lit(0))["value"]


# Facts of C++ bodies.


def guard_conditions(body: Column) -> Column:
    """The conditions of ifs that throw at once: in the statement that follows, before any other if in it. Comments and literals aren't read."""
    return lexing.cpp_guards_of(body)


def thrown_types(body: Column) -> Column:
    """Types made where they are thrown, in order."""
    return F.array_distinct(T.found(lexing.code_of(body), r"\bthrow\s+([A-Za-z_][\w:]*)\s*[({]"))


def file_constant(declaration: Column, name: Column) -> Column:
    """The number that a declaration sets its name to; null for anything else."""
    pairs = F.arrays_zip(T.found(declaration, r"\b([A-Za-z_]\w*)\s*=\s*(-?\d+(?:\.\d+)?)").alias("n"), T.found(declaration, r"\b([A-Za-z_]\w*)\s*=\s*(-?\d+(?:\.\d+)?)", 2).alias("v"))
    return F.get(F.filter(pairs, lambda p: p["n"] == name), F.lit(0))["v"]


def is_cpp_number(type_: Column) -> Column:
    simple = simple_cpp_type(type_, 1)
    return simple.isin(*CPP_NUMBERS) | F.trim(type_).isin(*CPP_NUMBERS) | simple.contains("unsigned") | simple.contains("int")


def is_text_like(type_: Column) -> Column:
    return T.has(type_, "char*", "std::string") | (type_ == "string")


def _beside(body: Column, before: str, name: Column, after: str = "") -> Column:
    return body.contains(F.concat(F.lit(before), name, F.lit(after)))


def is_cpp_divisor(body: Column, name: Column) -> Column:
    signs = F.lit(False)
    for sign in ("/ ", "/", "% ", "%"):
        signs = signs | _beside(body, sign, name)
    return body.contains("/") & signs


def operational_limit(body: Column, name: Column, type_: Column) -> Column:
    """What a variable's use demands of it; null where nothing is known."""
    divides, kept = is_cpp_divisor(body, name), _beside(body, "", name, " > 0") | _beside(body, "", name, " >= 0") | _beside(body, "0 < ", name)
    opened = _beside(body, "fopen(", name) | _beside(body, "open(", name) | _beside(body, "ifstream", name) | _beside(body, "ofstream", name)
    return F.when((name != "") & (body != ""), (
        F.when(_beside(body, "", name, "["), "Used as an index; must stay within bounds of the collection it accesses").when(is_cpp_number(type_) & divides, "Must not be zero (used as a divisor)")
        .when(is_cpp_number(type_) & kept, "Should remain non-negative based on surrounding logic").when(is_text_like(F.trim(type_)) & opened, "Expected to be a valid file path")))


def operational_limits(body: Column, locals_: Column, fields: Column) -> Column:
    """"name: limit" of locals, then of the fields that the body mentions; the first of those that differ in case only."""
    one = lambda v: F.concat(v["name"], F.lit(": "), operational_limit(body, v["name"], v["type"]))
    every = F.concat(F.transform(locals_, one), F.transform(F.filter(fields, lambda v: body.contains(v["name"])), one))
    return first_of_each(F.filter(every, lambda x: x.isNotNull()), F.upper)


def visible_guard(body: Column, name: Column) -> Column:
    return _beside(body, "if (", name) | _beside(body, "if(", name) | _beside(body, "", name, " != 0") | _beside(body, "", name, " > 0")


def runtime_issues(body: Column, params: Column, locals_: Column) -> Column:
    """Up to four sentences on what may go wrong in a C++ body."""
    names = F.transform(params, lambda p: F.regexp_extract(F.trim(p), r"([^ ]*)$", 1))
    every = F.filter(F.concat(names, F.transform(locals_, lambda v: v["name"])), lambda n: n != "")
    when = lambda c, sentence: F.when(c, F.array(F.lit(sentence))).otherwise(F.array().cast(_NONE))
    pointers = F.filter(F.array_distinct(T.found(body, r"(\w+)\s*->")), lambda n: F.array_contains(names, n) & ~_beside(body, "if (", n) & ~_beside(body, "if(", n))
    found = F.concat(
        when(body.contains("/") & F.exists(every, lambda n: is_cpp_divisor(body, n) & ~visible_guard(body, n)), "Potential division by zero: verify divisor is non-zero before division."),
        F.transform(pointers, lambda n: F.concat(F.lit("Potential null pointer dereference: '"), n, F.lit("' is accessed via -> without a visible null check."))),
        when(F.exists(every, lambda n: _beside(body, "", n, "[") & ~_beside(body, "", n, " < ")), "Potential out-of-bounds access: array index may exceed buffer size."),
        when(body.contains("new ") & ~T.has(body, "delete ", "unique_ptr", "shared_ptr"), "Potential memory leak: 'new' used without visible 'delete' or smart pointer."),
        when(T.has(body, "while(true)", "while (true)", "for(;;)", "for (;;)"), "Potential infinite loop: loop has no visible termination condition."),
    )
    return F.slice(first_of_each(found, F.upper), 1, 4)
