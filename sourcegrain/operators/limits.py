"""Permitted values of variables, inferred from guards, clamps, comparisons, loops and types.

Everything a limit rests on stands in one method, so the facts are extracted
once per row by constant patterns, as arrays of what each match says of a
name. A row is then spread over its variables, each with its own facts only,
and the rest is plain columns: the tightest bounds of a side (ties by place),
the first finding of a kind by rule order, one sentence over the kinds.
Nothing is joined or shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: A number with the suffix of its type, and a bound as written: a number, or a name that stands for one.
NUMBER = r"(-?\d+(?:\.\d+)?)(?:[fFdDmMlLuU]{1,2})?"
VALUE = r"([A-Za-z_]\w*|-?\d+(?:\.\d+)?[fFdDmMlLuU]{0,2})"
#: Bodies longer than this have no facts, as in the reference semantics; limits by type remain.
MAX_BODY = 100_000
#: Lines over which a condition may be wrapped beyond its first.
WRAPPED = 8
#: Fixed value: the largest number of the decimal type of C#. A number is the whole number below it and how many units of 10^-28 are above that.
LARGEST = "79228162514264337593543950335"
DIGITS = 28
VALUE_TYPE = f"struct<w:decimal(38,0),f:decimal({DIGITS},0)>"

#: What built-in types hold (normalised names, sentence).
TYPE_RANGES = (
    (("BOOL", "BOOLEAN"), "true or false"),
    (("BYTE", "UINT8_T", "UNSIGNEDCHAR"), "0 to 255"),
    (("SBYTE", "INT8_T"), "-128 to 127"),
    (("SHORT", "INT16_T"), "-32,768 to 32,767"),
    (("USHORT", "UINT16_T", "UNSIGNEDSHORT"), "0 to 65,535"),
    (("UINT", "UINT32_T", "UNSIGNEDINT", "ULONG", "UINT64_T", "UNSIGNEDLONG", "SIZE_T"), "0 or greater"),
    (("INT", "LONG", "INT32_T", "INT64_T", "LONGLONG"), "any whole number"),
    (("FLOAT", "DOUBLE", "DECIMAL"), "any decimal number"),
    (("CHAR", "WCHAR_T"), "any single character"),
    (("STRING", "STRING_VIEW"), "any text"),
    (("DATETIME",), "any date and time"),
)
#: Parts of the names of collection types.
COLLECTIONS = ("[]", "List<", "vector<", "IEnumerable", "ICollection", "Dictionary", "map<", "set<")
#: Kinds in the order of a sentence.
KINDS = ("Presence", "Membership", "Range", "Size", "DeclaredType")
CONFIDENCES = ("High", "Medium", "Low")

PART = "struct<kind:string,text:string,evidence:string,source:string,confidence:string>"


def _exact(whole: Column, part: Column) -> Column:
    return F.struct(whole.cast("decimal(38,0)").alias("w"), part.cast(f"decimal({DIGITS},0)").alias("f"))


def whole_number(n: int) -> Column:
    return _exact(F.lit(n), F.lit(0))


def exact(text: Column) -> Column:
    """The number that a literal of digits and at most one point writes; null beyond LARGEST, as such a literal is none there."""
    def of_parts(x: Column) -> Column:
        signed = F.when(x["minus"], negated(x)).otherwise(_exact(x["w"], x["f"]))
        return F.when(x["w"] <= F.lit(LARGEST).cast("decimal(38,0)"), signed)

    def parts(t: Column) -> Column:
        part = F.rpad(F.substring_index(F.concat(t, F.lit(".")), ".", 2), F.length(t) + DIGITS + 1, "0")
        digits = F.substring(F.substring_index(part, ".", -1), 1, DIGITS)
        return F.struct(F.ltrim(F.substring_index(t, ".", 1), F.lit("+-")).try_cast("decimal(38,0)").alias("w"), digits.try_cast(f"decimal({DIGITS},0)").alias("f"), t.startswith("-").alias("minus"))

    return T.bind(T.bind(text, parts), of_parts)


def negated(x: Column) -> Column:
    unit = F.lit("1" + "0" * DIGITS).cast(f"decimal({DIGITS + 1},0)")
    return F.when(is_whole(x), _exact(-x["w"], F.lit(0))).otherwise(_exact(-x["w"] - 1, unit - x["f"]))


def plus(x: Column, n: int) -> Column:
    return _exact(x["w"] + n, x["f"])


def is_whole(x: Column) -> Column:
    return x["f"] == 0


def number(value: Column) -> Column:
    """A number in digits, without trailing zeros."""
    def digits(x: Column) -> Column:
        return F.concat(x["w"].cast("string"), F.regexp_replace(F.when(is_whole(x), "").otherwise(F.concat(F.lit("."), F.lpad(x["f"].cast("string"), DIGITS, "0"))), "0+$", ""))

    return F.when((value["w"] < 0) & ~is_whole(value), F.concat(F.lit("-"), digits(negated(value)))).otherwise(digits(value))


def _matches(text: Column, pattern: str, **groups: int) -> Column:
    """The matches of a pattern as structs of the named groups and ev, the match itself with single blanks."""
    all_ = [F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(g)).alias(name) for name, g in groups.items()]
    evidence = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)), T.collapse)
    return F.arrays_zip(*all_, evidence.alias("ev"))


def _spread(lines: Column, make) -> Column:
    return F.flatten(F.transform(lines, make))


def type_normal(type_: Column) -> Column:
    return F.upper(F.regexp_replace(type_, r"\bconst\b|&|std::|\s", ""))


def is_text(type_: Column) -> Column:
    return type_normal(type_).isin("STRING", "STRING_VIEW", "CHAR*")


def is_unsigned(type_: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(type_, r"const|&|std::", ""))).rlike(r"^(?:uint|unsigned)|^(?:size_t|byte|ulong|ushort)$")


def is_fractional(type_: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(type_, r"const|&", ""))).isin("double", "float", "decimal", "long double")


def type_text(type_: Column) -> Column:
    """What a declared type holds, in words."""
    normal = type_normal(type_)
    known = F.coalesce(*[F.when(normal.isin(*names), text) for names, text in TYPE_RANGES])
    return F.coalesce(known, F.when(T.has(type_, *COLLECTIONS), "any number of items"), F.concat(F.lit("any "), F.trim(type_), F.lit(" value")))


def rejections(code: Column) -> Column:
    """The lines that refuse a value: an if whose condition, folded over at most WRAPPED more lines until its
    brackets close, is followed by a throw in the line or as the first statement of its block."""
    lines = F.filter(F.transform(F.split(code, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " "))), lambda x: x != "")

    def closed(text: Column) -> Column:
        count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
        return (count("(") > 0) & (count("(") <= count(")"))

    def of_lines(lines: Column) -> Column:
        def refusal(line: Column, i: Column) -> Column:
            folded = F.transform(F.sequence(F.lit(0), F.lit(WRAPPED)), lambda k: F.array_join(F.slice(lines, i + 1, k + 1), " "))
            extra = F.when(closed(line), 0).otherwise(F.array_position(F.transform(folded, closed), F.lit(True)).cast("int") - 1)

            def judged(k: Column) -> Column:
                def of_text(whole: Column) -> Column:
                    after, second = F.get(lines, i + k + 1), F.get(lines, i + k + 2)
                    first = F.when(whole.endswith("{"), after).when(after == "{", second)
                    return F.when(T.matches(whole, r"\bthrow\b"), whole).when(first.rlike(r"^throw\b"), F.concat(whole, F.lit(" "), first))

                return F.when(k >= 0, T.bind(F.when(k == 0, line).otherwise(F.array_join(F.slice(lines, i + 1, k + 1), " ")), of_text))

            return F.when(T.matches(line, r"\bif\b"), T.bind(extra, judged))

        return F.filter(F.transform(lines, refusal), lambda x: x.isNotNull())

    return T.bind(lines, of_lines)


def declared(params: Column, locals_: Column, fields: Column, code: Column) -> Column:
    """name, type, scope: parameters and locals, the last of a name; then the first of each other field that the code mentions."""

    def scoped(variables: Column, scope: str) -> Column:
        return F.transform(F.filter(variables, lambda v: v["name"] != ""), lambda v: F.struct(v["name"].alias("name"), v["type"].alias("type"), F.lit(scope).alias("scope")))

    none = F.array().cast("array<struct<name:string,type:string,scope:string>>")
    own = F.concat(F.coalesce(scoped(T.parse_parameters(params), "Parameter"), none), F.coalesce(scoped(locals_, "Local"), none))
    names = lambda a: F.transform(a, lambda v: v["name"])

    def joined(x: Column) -> Column:
        last = F.filter(x["own"], lambda v, i: ~F.array_contains(F.slice(names(x["own"]), i + 2, F.size(x["own"])), v["name"]))
        more = F.filter(x["fields"], lambda v, i: (F.array_position(names(x["fields"]), v["name"]) == i + 1) & ~F.array_contains(names(x["own"]), v["name"]) & code.contains(v["name"]))
        return F.concat(last, more)

    return T.bind(F.struct(own.alias("own"), F.coalesce(scoped(fields, "Field"), none).alias("fields")), joined)


def constants(code: Column, variables: Column) -> Column:
    """name, value of variables (name, initial_value) that stand for a number: set to a literal where declared, and never again."""

    def fixed(x: Column) -> Column:
        literal = lambda v: F.trim(v["initial_value"])
        times = lambda v: F.size(F.filter(x["targets"], lambda t: t == v["name"]))
        stated = lambda v: F.exists(x["set"], lambda s: (s["name"] == v["name"]) & s["value"].startswith(literal(v)))
        kept = F.filter(variables, lambda v: literal(v).rlike(r"^[+-]?\d+(?:\.\d+)?$") & (times(v) <= F.when(stated(v), 1).otherwise(0)))
        return F.transform(kept, lambda v: F.struct(v["name"].alias("name"), exact(literal(v)).alias("value")))

    targets = T.found(code, r"\b([A-Za-z_]\w*)\s*[-+*/]?=(?!=)")
    return T.bind(F.struct(targets.alias("targets"), _matches(code, r"\b([A-Za-z_]\w*)\s*=\s*([+-]?[\w.]+)", name=1, value=2).alias("set")), fixed)


def facts(x: Column) -> Column:
    """What the code says of its variables: for each rule the matches that name a known one. x: code, lines, names, fixed."""
    code, lines, names, fixed = x["code"], x["lines"], x["names"], x["fixed"]
    ident = r"\b([A-Za-z_]\w*)"
    known = lambda found: F.filter(found, lambda m: F.array_contains(names, m["name"]))

    def one_variable(text: Column) -> Column:
        """Whether the line doesn't join comparisons of several variables by &&."""
        compared = F.array_intersect(names, T.found(text, ident + r"\s*(?:>=|<=|==|!=|>|<)"))
        return ~text.contains("&&") | (F.size(compared) <= 1)

    def value(token: Column) -> Column:
        literal = F.regexp_replace(token, r"[fFdDmMlLuU]+$", "")
        named = F.element_at(F.filter(fixed, lambda c: c["name"] == token), -1)["value"]
        return F.when(literal.rlike(r"^-?\d+(?:\.\d+)?$"), exact(literal)).otherwise(F.when(F.exists(fixed, lambda c: c["name"] == token), named))

    def valued(found: Column, *tokens: str) -> Column:
        """Matches with the values of their tokens; those without a value go."""
        with_values = F.transform(found, lambda m: reduce(lambda s, t: s.withField(t, value(m[t])), tokens, m))
        return F.filter(with_values, lambda m: reduce(lambda a, b: a & b, [m[t].isNotNull() for t in tokens]))

    def no_size(line: Column, found: Column) -> Column:
        return T.bind(T.found(line, ident + r"\s*\.\s*(?:Length|Count|Size|length|size)\b"), lambda sized: F.filter(found, lambda m: ~F.array_contains(sized, m["name"])))

    alone = F.filter(lines, one_variable)
    plain = F.filter(F.split(code, "\n"), one_variable)
    absent = ident + r"\s*(?:==\s*(?:null|nullptr)|is\s+null)\b|(?:IsNullOrEmpty|IsNullOrWhiteSpace)\s*\(\s*([A-Za-z_]\w*)\s*\)"
    missing = F.transform(_spread(lines, lambda t: _matches(t, absent, a=1, b=2)), lambda m: F.struct(F.when(m["b"] != "", m["b"]).otherwise(m["a"]).alias("name"), (m["b"] != "").alias("empty"), m["ev"].alias("ev")))
    refused = F.transform(_matches(code, r"ThrowIfNull\s*\(\s*([A-Za-z_]\w*)", name=1), lambda m: F.struct(m["name"].alias("name"), F.lit(False).alias("empty"), m["ev"].alias("ev")))
    letters = (ident + r"\s*>=\s*'(.)'\s*&&\s*\1\s*<=\s*'(.)'", ident + r"\s*<\s*'(.)'\s*\|\|\s*\1\s*>\s*'(.)'")
    return F.struct(
        known(valued(_spread(alone, lambda t: no_size(t, _matches(t, ident + r"\s*(>=|<=|>|<)\s*" + VALUE + r"\b", name=1, op=2, value=3))), "value")).alias("singles"),
        known(_spread(alone, lambda t: no_size(t, _matches(t, ident + r"\s*==\s*0\b", name=1)))).alias("zeros"),
        known(valued(_spread(alone, lambda t: _matches(t, ident + r"\s*<(=?)\s*" + VALUE + r"\s*\|\|\s*\1\s*>(=?)\s*" + VALUE, name=1, over=2, low=3, under=4, high=5)), "low", "high")).alias("ranges"),
        known(_spread(lines, lambda t: _matches(t, ident + r"\s*!=\s*" + NUMBER + r"(?:\s*&&\s*\1\s*!=\s*" + NUMBER + r")+", name=1))).alias("members"),
        known(valued(_matches(code, r"(?:Math\.Clamp|std::clamp|clamp)\s*\(\s*([A-Za-z_]\w*)\s*,\s*" + VALUE + r"\s*,\s*" + VALUE + r"\s*\)", name=1, low=2, high=3), "low", "high")).alias("clamps"),
        F.filter(known(F.concat(_matches(code, letters[0], name=1, low=2, high=3), _spread(lines, lambda t: _matches(t, letters[1], name=1, low=2, high=3)))), lambda m: m["low"] <= m["high"]).alias("letters"),
        F.filter(known(_spread(lines, lambda t: _matches(t, ident + r"\s*(<=|>=|<|>)\s*([A-Za-z_]\w*)\b", name=1, op=2, other=3))), lambda m: F.array_contains(names, m["other"]) & (m["other"] != m["name"])).alias("symbols"),
        known(valued(_spread(lines, lambda t: _matches(t, ident + r"\s*(?:\.\s*(?:Length|Count|Size)\b|\.\s*(?:length|size)\s*\(\s*\))\s*(>=|<=|==|!=|>|<)\s*" + VALUE, name=1, op=2, value=3)), "value")).alias("sizes"),
        known(F.concat(refused, missing)).alias("nulls"),
        F.array_distinct(T.found(code, r"[/%]\s*([A-Za-z_]\w*)\b(?!\s*[.\[(])")).alias("divisors"),
        known(valued(_spread(plain, lambda t: _matches(t, ident + r"\s*(>=|<=|>|<)\s*" + NUMBER + r"\b", name=1, op=2, value=3)), "value")).alias("comparisons"),
        valued(_matches(code, r"for\s*\(\s*(?:[A-Za-z_][\w:<>,\s\*&]*\s+)?([A-Za-z_]\w*)\s*=\s*" + NUMBER + r"\s*;\s*\1\s*(<=?)\s*" + NUMBER + r"\s*;", name=1, low=2, op=3, high=4), "low", "high").alias("loops"),
    )


def _tightest(found: Column, above: bool) -> Column:
    """value, open, ev of the largest lower (or smallest upper) bound of matches (value, open, ev); ties to the first."""
    ranked = F.transform(found, lambda m, i: F.struct((negated(m["value"]) if above else m["value"]).alias("o"), i.alias("i"), m["value"].alias("value"), m["open"].alias("open"), m["ev"].alias("ev")))
    return F.array_min(ranked)


def _bounds(found: Column, signs: tuple[str, str]) -> Column:
    """Matches of two operators as bounds: the first is inclusive, the second exclusive."""
    own = F.filter(found, lambda m: m["op"].isin(*signs))
    return F.transform(own, lambda m: F.struct(m["value"].alias("value"), (m["op"] == signs[1]).alias("open"), m["ev"].alias("ev")))


def _past(bound: Column, step: int, fractional: Column) -> Column:
    """An exclusive whole bound as its neighbour; others as they are."""
    whole = bound["open"] & is_whole(bound["value"]) & ~fractional
    return F.when(bound.isNotNull(), F.struct(F.when(whole, plus(bound["value"], step)).otherwise(bound["value"]).alias("value"), (bound["open"] & ~whole).alias("open"), bound["ev"].alias("ev")))


def _lower(b: Column) -> Column:
    return F.when(b["open"], F.concat(F.lit("greater than "), number(b["value"]))).otherwise(F.concat(number(b["value"]), F.lit(" or greater")))


def _upper(b: Column) -> Column:
    return F.when(b["open"], F.concat(F.lit("less than "), number(b["value"]))).otherwise(F.concat(number(b["value"]), F.lit(" or less")))


def _between(low: Column, high: Column) -> Column:
    """The sentence of two bounds."""
    same = F.when(low["value"] == high["value"], F.concat(F.lit("exactly "), number(low["value"]))).otherwise(F.concat(number(low["value"]), F.lit(" to "), number(high["value"])))
    return F.when(low["open"] | high["open"], F.concat(_lower(low), F.lit(", "), _upper(high))).otherwise(same)


def _empty(low: Column, high: Column) -> Column:
    return (low["value"] > high["value"]) | ((low["value"] == high["value"]) & (low["open"] | high["open"]))


def _closed(value: Column, open_: Column | None = None) -> Column:
    return F.struct(value.alias("value"), (F.lit(False) if open_ is None else open_).alias("open"), F.lit("").alias("ev"))


def _part(kind: str, text: Column, evidence: Column, source: str = "Guard", confidence: str = "High") -> Column:
    return F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("text"), evidence.alias("evidence"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))).cast(PART)


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _size_text(m: Column, type_: Column) -> Column:
    def line(head: str, n: Column) -> Column:
        unit = F.concat(F.when(is_text(type_), "character").otherwise("item"), F.when(n == whole_number(1), "").otherwise("s"))
        return F.concat(F.lit(head), number(n), F.lit(" "), unit)

    n, op = m["value"], m["op"]
    return (
        F.when(op == ">", line("at most ", n)).when(op == ">=", line("at most ", plus(n, -1))).when(op == "<", line("at least ", n)).when(op == "<=", line("at least ", plus(n, 1)))
        .when(op == "!=", line("exactly ", n)).when((op == "==") & (n == whole_number(0)), line("at least ", whole_number(1))).when(op == "==", line("not ", n))
    )


def _member_text(m: Column) -> Column:
    """ "1, 2 or 3" of the different numbers that a match refuses to differ from; null for one."""
    values = F.array_distinct(F.transform(T.found(m["ev"], r"!=\s*" + NUMBER), lambda v: number(exact(v))))
    return T.bind(values, lambda v: F.when(F.size(v) >= 2, F.concat(F.array_join(F.slice(v, 1, F.size(v) - 1), ", "), F.lit(" or "), F.element_at(v, -1))))


def variable_limits(methods: DataFrame) -> DataFrame:
    """method_id, name, type, scope, kind, limit, evidence, source, confidence: what each variable may hold.

    methods: method_id, params, locals and fields (name, type, and initial_value if known), body. A null
    body says nothing, so types decide. A counter that only a loop declares is a local int.
    """
    started = lambda c: F.transform(c, lambda v: F.struct(v["name"].alias("name"), (v["initial_value"] if "initial_value" in methods.schema[c].dataType.elementType.names else F.lit(None).cast("string")).alias("initial_value")))
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = methods.select("method_id", F.when((F.length(body) > MAX_BODY) | (T.match_steps(body) > T.MATCH_STEPS), "").otherwise(T.without_comments_and_strings(body)).alias("code"), "params", "locals", "fields")
    rows = rows.select(
        "method_id", "code", declared(F.col("params"), F.col("locals"), F.col("fields"), F.col("code")).alias("vars"), rejections(F.col("code")).alias("lines"),
        F.coalesce(constants(F.col("code"), F.concat(started("fields"), started("locals"))), F.array().cast(f"array<struct<name:string,value:{VALUE_TYPE}>>")).alias("fixed"),
    )
    given = F.struct("code", "lines", F.transform("vars", lambda v: v["name"]).alias("names"), "fixed")
    rows = rows.select("method_id", "code", "vars", T.bind(given, facts).alias("f"))

    # Each variable with the facts that name it.
    kinds = ("singles", "zeros", "ranges", "members", "clamps", "letters", "symbols", "sizes", "nulls", "comparisons", "loops")
    f = F.col("f")

    def own(v: Column) -> Column:
        mine = [F.filter(f[k], lambda m: m["name"] == v["name"]).alias(k) for k in kinds]
        return F.struct(v["name"].alias("name"), v["type"].alias("type"), v["scope"].alias("scope"), v["known"].alias("known"), *mine, F.array_contains(f["divisors"], v["name"]).alias("divides"))

    names = F.transform("vars", lambda v: v["name"])
    counters = F.filter(F.array_distinct(F.transform(f["loops"], lambda m: m["name"])), lambda n: ~F.array_contains(names, n))
    every = F.concat(
        F.transform("vars", lambda v: F.struct(v["name"].alias("name"), v["type"].alias("type"), v["scope"].alias("scope"), F.lit(True).alias("known"))),
        F.transform(counters, lambda n: F.struct(n.alias("name"), F.lit("int").alias("type"), F.lit("Local").alias("scope"), F.lit(False).alias("known"))),
    )
    rows = rows.select("method_id", "code", F.explode(F.transform(every, own)).alias("v")).select("method_id", "code", "v.*")

    # The tightest bounds. Refusing x == 0 lifts a floor of zero, and that of an unsigned type.
    zero = F.transform("zeros", lambda m: F.struct(whole_number(0).alias("value"), F.lit(True).alias("open"), m["ev"].alias("ev")))
    rows = rows.withColumns({
        "fractional": is_fractional(F.col("type")), "low": _tightest(_bounds(F.col("singles"), ("<", "<=")), True), "high": _tightest(_bounds(F.col("singles"), (">", ">=")), False),
        "below": _tightest(_bounds(F.col("comparisons"), (">=", ">")), True), "above": _tightest(_bounds(F.col("comparisons"), ("<=", "<")), False),
    })
    lift = _past(_first(zero), 1, F.col("fractional"))
    lifts = (F.size("zeros") > 0) & (is_unsigned(F.col("type")) | F.coalesce(F.col("low.value") == whole_number(0), F.lit(False)))
    bound = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.value").alias("value"), F.col(f"{c}.open").alias("open"), F.col(f"{c}.ev").alias("ev")))
    rows = rows.withColumns({
        "low": F.when(lifts & F.coalesce(lift["value"] > F.col("low.value"), F.lit(True)), lift).otherwise(bound("low")), "high": bound("high"), "below": bound("below"), "above": bound("above"),
        "first_range": _first(F.filter(F.transform("ranges", lambda m: F.struct(
            _past(F.struct(m["low"].alias("value"), (m["over"] == "=").alias("open"), m["ev"].alias("ev")), 1, F.col("fractional")).alias("low"),
            _past(F.struct(m["high"].alias("value"), (m["under"] == "=").alias("open"), m["ev"].alias("ev")), -1, F.col("fractional")).alias("high"))), lambda r: r["low"]["value"] <= r["high"]["value"])),
        "clamp": _first(F.filter("clamps", lambda m: m["low"] <= m["high"])), "letter": _first(F.col("letters")),
        "loop": _first(F.filter(F.transform("loops", lambda m: F.struct(m["low"].alias("low"), F.when((m["op"] == "<") & is_whole(m["high"]), plus(m["high"], -1)).otherwise(m["high"]).alias("high"), ((m["op"] == "<") & ~is_whole(m["high"])).alias("open"), m["ev"].alias("ev"))), lambda m: m["low"] <= m["high"])),
        "from": _first(F.filter("symbols", lambda m: m["op"].startswith("<"))), "to": _first(F.filter("symbols", lambda m: m["op"].startswith(">"))),
    })
    rows = rows.withColumns({"low_in": _past(F.col("low"), 1, F.col("fractional")), "high_in": _past(F.col("high"), -1, F.col("fractional"))})
    low, high = F.col("low"), F.col("high")
    both = low.isNotNull() & high.isNotNull()
    single = F.when(both, F.when(~_empty(F.col("low_in"), F.col("high_in")), _between(F.col("low_in"), F.col("high_in")))).when(low.isNotNull(), _lower(low)).when(high.isNotNull(), _upper(high))
    symbolic = F.when(F.col("from.other") != F.col("to.other"), F.concat(F.lit("between "), F.col("from.other"), F.lit(" and "), F.col("to.other")))
    compared = F.when(~_empty(F.col("below"), F.col("above")), _between(F.col("below"), F.col("above")))
    divides = F.when(F.col("divides") & ~F.coalesce(_zero_handled(F.col("code"), F.col("name")), F.lit(False)), F.lit("must not be zero"))
    loop_text = F.when(F.col("loop").isNotNull(), _between(_closed(F.col("loop.low")), _closed(F.col("loop.high"), F.col("loop.open"))))
    size, null = _first(F.col("sizes")), _first(F.col("nulls"))
    members = F.filter(F.transform("members", lambda m: _part("Membership", _member_text(m), m["ev"])), lambda p: p.isNotNull())
    range_ = F.coalesce(
        _part("Range", single, F.concat_ws("; ", F.col("low.ev"), F.col("high.ev"))),
        _part("Range", F.when(F.col("first_range").isNotNull(), _between(F.col("first_range.low"), F.col("first_range.high"))), F.col("first_range.low.ev")),
        _part("Range", F.when(F.col("clamp").isNotNull(), _between(_closed(F.col("clamp.low")), _closed(F.col("clamp.high")))), F.col("clamp.ev"), "Clamp"),
        _part("Range", F.concat(F.lit("'"), F.col("letter.low"), F.lit("' to '"), F.col("letter.high"), F.lit("'")), F.col("letter.ev")),
        _part("Range", symbolic, F.concat_ws("; ", F.col("from.ev"), F.col("to.ev"))),
        _part("Range", divides, F.concat(F.lit("used as a divisor: / "), F.col("name")), "Guard", "Medium"),
        _part("Range", compared, F.concat_ws(", ", F.col("below.ev"), F.col("above.ev")), "Comparison", "Medium"),
        _part("Range", loop_text, F.regexp_replace("loop.ev", r"[; ]+$", ""), "LoopBound", "Medium"),
    )
    null_text = F.when(null["empty"] & is_text(F.col("type")), "must not be empty").when(null.isNotNull(), "must not be null")
    found = F.filter(F.array(_part("Presence", null_text, null["ev"]), _first(members), range_, _part("Size", _size_text(size, F.col("type")), size["ev"])), lambda p: p.isNotNull())
    by_type = F.filter(F.array(_part("DeclaredType", F.when(F.col("known"), type_text(F.col("type"))), F.concat(F.lit("declared as "), F.col("type")), "DeclaredType", "Low")), lambda p: p.isNotNull())
    parts = T.bind(found, lambda p: F.when(F.size(p) > 0, p).otherwise(by_type))
    # A variable without parts goes by exploding none: a filter on them would be pushed down and compute all of them twice.
    rows = rows.select("method_id", "name", "type", "scope", F.explode(F.filter(F.array(parts), lambda p: F.size(p) > 0)).alias("parts"))
    strongest = F.array_min(F.transform("parts", lambda p, i: F.struct(F.array_position(F.array(*map(F.lit, CONFIDENCES)), p["confidence"]).alias("o"), i.alias("i"), p["source"].alias("source"), p["confidence"].alias("confidence"))))
    rows = rows.withColumn("best", strongest)
    listed = lambda field: F.transform("parts", lambda p: p[field])
    return rows.select(
        "method_id", "name", "type", "scope", F.col("parts")[0]["kind"].alias("kind"), F.array_join(listed("text"), ", ").alias("limit"), F.array_join(F.array_distinct(listed("evidence")), "; ").alias("evidence"),
        F.col("best.source").alias("source"), F.col("best.confidence").alias("confidence"),
    )


def _zero_handled(code: Column, name: Column) -> Column:
    """Whether zero is tested and left by return or continue before the statement of the first division by the name."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    before = _first(F.regexp_extract_all(code, F.concat(F.lit(r"(?sU)^(.*?)[/%]\s*"), quoted, F.lit(r"\b(?!\s*[.\[(])")), F.lit(1)))
    statements = F.regexp_extract(before, r"(?s)^(.*)[;{}]", 1)
    test = F.concat(F.lit(r"(?sU)(?:\b"), quoted, F.lit(r"\s*==\s*0\b|\b0\s*==\s*"), quoted, F.lit(r"\b).*\b(?:return|continue)\b"))
    return F.regexp_like(statements, test)
