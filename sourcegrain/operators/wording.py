"""Sentences for the limits that a parser notes as "When condition" or "subject: condition"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: A comparison and its opposite, two-character ones first.
OPPOSITES = (("==", "!="), ("!=", "=="), ("<=", ">"), (">=", "<"), ("<", ">="), (">", "<="))
#: Comparisons between blanks as words.
WORDS = (
    (" == ", " equals "), (" != ", " does not equal "), (" <= ", " is less than or equal to "), (" >= ", " is greater than or equal to "), (" < ", " is less than "), (" > ", " is greater than "),
)


def sentence(text: Column) -> Column:
    """Trimmed, without dots at the end, the first character a capital."""
    return T.bind(F.regexp_replace(F.trim(text), r"\.+$", ""), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000_000)))


def about(subject: Column, rest) -> Column:
    rest = rest if isinstance(rest, Column) else F.lit(rest)
    return sentence(F.when(F.trim(subject) == "", rest).otherwise(F.concat(subject, F.lit(" "), rest)))


def _any(text: Column, *parts: str) -> Column:
    """Whether text holds any part, in any case."""
    return T.has(F.lower(text), *[p.lower() for p in parts])


def of_condition(subject: Column, condition: Column, params: Column, facts: Column, body: Column) -> Column:
    """The sentence of a condition that is known by its shape or words, in this order; null for any other."""
    divides = (subject != "") & (F.coalesce(F.trim(body), F.lit("")) != "") & F.coalesce(T.used_as_divisor(facts, subject), F.lit(False))
    divisor = F.coalesce(F.when(subject != "", subject), F.get(F.filter(params, lambda p: F.coalesce(T.used_as_divisor(facts, p["name"]), F.lit(False))), F.lit(0))["name"], F.lit(""))
    name = r"[A-Za-z_][\w]*"
    zero = T.matches(condition, rf"\b{name}\s*==\s*0\b") | T.matches(condition, rf"\b0\s*==\s*{name}\b") | _any(condition, "Must not be zero")
    return (
        F.when(zero & (divides | _any(condition, "divisor")), about(subject, "must not be zero; used as a divisor in this method"))
        .when(zero, about(subject, "must not be zero; invalid values cause this method to throw"))
        .when(_any(condition, "== null"), about(subject, "must not be null before this method executes"))
        .when(condition.contains('== ""') | _any(condition, "string.Empty", "IsNullOrEmpty", "IsNullOrWhiteSpace", ".empty()"), about(subject, "must not be null or empty before this method executes"))
        .when(T.matches(condition, rf"\b{name}\s*<\s*0\b"), about(subject, "must not be negative; negative values are rejected"))
        .when(T.matches(condition, rf"\b{name}\s*<=\s*0\b"), about(subject, "must be greater than zero; zero or negative values are rejected"))
        .when(_any(condition, "index", "bounds"), F.when(subject == "", "Must stay within valid array bounds").otherwise(F.concat(subject, F.lit(" must stay within valid array bounds"))))
        .when(_any(condition, "division by zero"), about(divisor, "must not be zero; used as a divisor in this method"))
        .when(_any(condition, "null pointer"), about(subject, "must not be null before dereferencing in this method"))
        .when(_any(condition, "file path", "valid file"), about(subject, "must point to an accessible file path"))
        .when(_any(condition, "memory leak"), "Allocated memory must be released to avoid a memory leak in this method")
        .when(_any(condition, "infinite loop"), "Loop logic must include a valid termination condition to avoid running forever")
        .when(_any(condition, "non-negative"), about(subject, "should remain non-negative based on surrounding logic"))
    )


def opposite(text: Column) -> Column:
    """What must hold where a guard refuses text: one comparison turned round, or a leading "!" dropped; null where that isn't safe."""
    turned = F.lit(None).cast("string")
    for sign, other in reversed(OPPOSITES):
        at = F.instr(text, sign)
        rest = F.substring(text, at + len(sign), F.length(text))
        one = F.when(~T.has(rest, "<", ">", "==", "!="), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(other), rest))
        turned = F.when((at > 1) & (at + len(sign) <= F.length(text)), one).otherwise(turned)
    inner = F.nullif(F.trim(F.substring(text, F.lit(2), F.length(text))), F.lit(""))
    return F.when(~T.has(text, "&&", "||"), F.when(text.startswith("!") & ~text.startswith("!="), inner).otherwise(turned))


def in_words(text: Column) -> Column:
    for sign, words in WORDS:
        text = F.replace(text, F.lit(sign), F.lit(words))
    return text


def _remaining(text: Column, subject: Column) -> Column:
    code = T.has(text, "==", "!=", "<=", ">=", "->", "&&", "||", "(", "[") | text.rlike(r"^[\p{L}_][^ ]*$")
    return T.bind(opposite(text), lambda required: (
        F.when(required.isNotNull(), about(subject, F.concat(F.lit("must satisfy the required condition described by "), in_words(required))))
        .when(code, sentence(F.concat(F.lit("the method rejects input where "), in_words(text))))
        .when(_any(text, "Potential "), F.trim(F.regexp_replace(text, "(?i)Potential ", ""))).otherwise(sentence(text))))


def limit_sentence(limit: Column, params: Column, facts: Column, body: Column) -> Column:
    """A parser's limit as a sentence; "" for a blank one. The subject stands before a colon that isn't part of "::",
    or is what the first comparison compares."""

    def parts(text: Column) -> Column:
        own = F.trim(F.regexp_extract(text, r"^([^:]*+(?:::[^:]*+)*+):(?!:)", 1))
        rest = F.trim(F.regexp_replace(text, r"^[^:]++(?:::[^:]*+)*+:(?!:)", ""))
        condition = F.when(own != "", rest).otherwise(text)
        subject = F.when(own != "", own).otherwise(F.regexp_extract(condition, r"(?U)\b([A-Za-z_][\w]*)\s*(?:==|<=|<|!=|>=|>)", 1))
        return F.struct(text.alias("text"), condition.alias("condition"), subject.alias("subject"))

    def spoken(x: Column) -> Column:
        given = (params, facts, body)
        return F.coalesce(of_condition(x["subject"], x["condition"], *given), of_condition(x["subject"], x["text"], *given), _remaining(x["text"], x["subject"]))

    text = F.trim(F.regexp_replace(F.trim(limit), "(?i)^When ", ""))
    return F.when(F.coalesce(F.trim(limit), F.lit("")) == "", "").otherwise(T.bind(T.bind(text, parts), spoken))
