"""Scalar functions over source text: parameters, type names, guards and uses of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENT = r"([A-Za-z_][\w]*)"


def bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Steps that the patterns of all rules may take over one body, each; runs shorter than LONG_RUN count for nothing.
MATCH_STEPS, LONG_RUN = 100_000_000, 256


def match_steps(text: Column) -> Column:
    """How many steps a pattern that starts anew at each letter takes in the long words and the long white space of a text: their squares."""
    runs = F.regexp_extract_all(text, F.lit(rf"(?U)\w{{{LONG_RUN},}}+|\s{{{LONG_RUN},}}+"), F.lit(0))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + F.length(r).cast("long") * F.length(r))


def within_budget(body: Column) -> Column:
    """The body, or null where patterns would take more than MATCH_STEPS over it."""
    return F.when(match_steps(body) <= MATCH_STEPS, body)


def quoted(name: Column) -> Column:
    """A regular expression for exactly this name."""
    return F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))


def has(body: Column, *parts: str) -> Column:
    """Whether body contains any of the parts, as plain text."""
    out = F.lit(False)
    for part in parts:
        out = out | body.contains(part)
    return out


def matches(body: Column, pattern: str) -> Column:
    return body.rlike("(?U)" + pattern)


def found(body: Column, pattern: str, group: int = 1) -> Column:
    """What a group holds at every match of a constant pattern, in order."""
    return F.regexp_extract_all(body, F.lit("(?U)" + pattern), F.lit(group))


def upper_all(names: Column) -> Column:
    return F.transform(names, F.upper)


def parse_parameters(params: Column) -> Column:
    """(type, name) of each parameter of two words or more."""
    words = F.transform(params, lambda p: F.filter(F.split(p, r"(?U)\s+"), lambda w: w != ""))
    pairs = F.transform(
        F.filter(words, lambda w: F.size(w) >= 2),
        lambda w: F.struct(F.array_join(F.slice(w, 1, F.size(w) - 1), " ").alias("type"), F.regexp_replace(F.element_at(w, -1), r"^[,&*]+|[,&*]+$", "").alias("name")),
    )
    return F.filter(pairs, lambda p: p["name"] != "")


def bare(type_: Column) -> Column:
    return F.regexp_replace(F.trim(type_), r"[&*]+$", "")


#: Words that make a type an aggregate, in any case.
CONTAINERS = ("vector", "list", "map", "set", "array", "span", "collection", "dictionary", "queue", "stack", "IEnumerable")
#: Built-in types.
PRIMITIVES = (
    "bool", "byte", "sbyte", "char", "decimal", "double", "float", "int", "uint", "long", "ulong", "short", "ushort", "void", "object", "string", "String", "size_t", "IntPtr", "UIntPtr",
)


def is_aggregate(type_: Column) -> Column:
    return bare(type_).rlike(r"[\[<]|(?i)(?:" + "|".join(CONTAINERS) + ")")


def is_numeric(type_: Column) -> Column:
    return ~is_aggregate(type_) & (bare(type_).rlike("double|float|int") | bare(type_).isin("decimal", "long", "short", "byte", "size_t"))


def is_floating(type_: Column) -> Column:
    return ~is_aggregate(type_) & (bare(type_).rlike("double|float") | (bare(type_) == "decimal"))


def is_string(type_: Column) -> Column:
    return ~is_aggregate(type_) & bare(type_).rlike(r"(?i)string|(?-i)char\*")


def is_collection(type_: Column) -> Column:
    return F.trim(type_).rlike("List|IEnumerable|Collection|vector|(?i)array")


def strip_qualifiers(type_: Column) -> Column:
    """What follows the last "::", and then the last "."."""
    return F.regexp_replace(F.regexp_replace(type_, r"(?s)^.*::", ""), r"(?s)^.*\.", "")


def simple_type(type_: Column) -> Column:
    return strip_qualifiers(bare(type_))


def is_class_like(type_: Column) -> Column:
    simple = simple_type(type_)
    return simple.rlike(r"^\p{Lu}") & ~simple.contains("<") & ~simple.endswith("[]") & ~simple.isin(*PRIMITIVES) & ~is_collection(type_)


def type_name(type_: Column) -> Column:
    """A type's name in sentences: without generic arguments, sequences as "collection"."""
    simple = F.trim(F.regexp_replace(F.trim(type_), r"(?s)(?<=.)<.*$", ""))
    plain = F.when(simple == "std::string", F.lit("string"))
    return F.coalesce(plain, F.when(simple.startswith("List") | simple.contains("IEnumerable"), F.lit("collection")), simple)


def is_void(type_: Column) -> Column:
    return F.upper(F.trim(type_)) == "VOID"


def guards(heads: Column, *conditions: str) -> Column:
    """Names tested by the conditions (each with one group) at the start of the heads; condition by condition, then by place."""
    def names(condition: str) -> Column:
        return F.transform(heads, lambda h: F.regexp_extract(h, "(?isU)^" + condition, 1))

    return F.filter(F.concat(*map(names, conditions)), lambda n: n != "")


def writes(body: Column) -> Column:
    """The part of facts() that written() asks for."""
    return F.struct(
        found(body, r"\b" + IDENT + r"\s*=(?!=)").alias("assigned"),
        F.concat(found(body, r"\b" + IDENT + r"\s*(?:\+\+|--)"), found(body, r"(?:\+\+|--)\s*" + IDENT)).alias("stepped"),
        found(body, r"\b" + IDENT + r"\s*[+-]=").alias("shifted"),
    )


def facts(body: Column) -> Column:
    """What a body does to its identifiers: lists of names, each found by one constant pattern."""
    in_parens = F.flatten(F.transform(found(body, r"/\s*\(([^)]*)"), lambda t: found(t, IDENT)))
    return F.struct(
        found(body, r"\b" + IDENT + r"\s*=(?!=)").alias("assigned"),
        F.concat(found(body, r"\b" + IDENT + r"\s*(?:\+\+|--)"), found(body, r"(?:\+\+|--)\s*" + IDENT)).alias("stepped"),
        found(body, r"\b" + IDENT + r"\s*[+-]=").alias("shifted"),
        F.when(body.contains("/"), F.concat(found(body, r"[/%]\s*" + IDENT), in_parens)).otherwise(F.array().cast("array<string>")).alias("divisors"),
        F.concat(found(body, r"/\s*" + IDENT), found(body, r"/\s*\(\s*" + IDENT + r"\s*\)")).alias("plain_divisors"),
        upper_all(found(body, r"(?i)\b" + IDENT + r"\s*[=!]=\s*null(?:ptr)?\b")).alias("nulls"),
        found(body, r"\[\s*" + IDENT + r"\s*\]").alias("indexes"),
        F.flatten(F.transform(found(body, r"\bfor(?:each)?\s*\(([^)]*)"), lambda t: found(t, r"\w+", 0))).alias("looped"),
        upper_all(found(body, r"(?i)\bsqrt\s*\(\s*" + IDENT + r"\s*\)")).alias("rooted"),
        F.array_distinct(found(body, r"\w+", 0)).alias("words"),
    )


def used_as_divisor(f: Column, name: Column) -> Column:
    return F.array_contains(f["divisors"], name)


def has_null_guard(f: Column, body: Column, name: Column) -> Column:
    return (F.length(name) > 0) & (F.array_contains(f["nulls"], F.upper(name)) | body.contains(F.concat(F.lit("ThrowIfNull("), name)))


def used_as_index(f: Column, body: Column, name: Column) -> Column:
    return (F.length(name) > 0) & (body.contains(F.concat(name, F.lit("["))) | F.array_contains(f["indexes"], name))


def iterated(f: Column, body: Column, name: Column) -> Column:
    loose = body.contains(F.concat(F.lit("foreach (var item in "), name)) | (body.contains("foreach (auto") & body.contains(name))
    return (F.length(name) > 0) & (F.array_contains(f["looped"], name) | loose)


def rooted(f: Column, name: Column) -> Column:
    return F.array_contains(f["rooted"], F.upper(name))


def written(f: Column, name: Column) -> Column:
    return F.array_contains(f["assigned"], name) | F.array_contains(f["stepped"], name) | F.array_contains(f["shifted"], name)


def usage(f: Column, body: Column, name: Column) -> Column:
    """Unused, Read or ReadWrite."""
    return F.when(F.coalesce(body, F.lit("")) == "", "Unused").when(written(f, name), "ReadWrite").when(F.array_contains(f["words"], name), "Read").otherwise("Unused")


def collapse(text: Column) -> Column:
    """White space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: A line comment, a block comment within its line, a string.
_NO_CODE = r'//[^\n]*+|/\*(?:[^*\n]|\*(?!/))*+\*/|"(?:\\.|[^"\\\n])*+"'


def without_comments_and_strings(text: Column) -> Column:
    """Comments and string literals as one blank each; a block comment counts within its line."""
    return F.regexp_replace(text, _NO_CODE, " ")
