"""Names and sentences: identifiers to words, verbs, class sentences and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bind, strip_qualifiers

#: Suffixes and base classes by category.
GUI_SUFFIXES = ("Window", "View", "Control", "Dialog", "Page")
UTILITY_SUFFIXES = ("Helper", "Utility", "Utils", "Extensions")
GUI_BASES = ("Window", "UserControl", "Page", "Control", "ContentControl")


def split_identifier(name: Column) -> Column:
    """Words of an identifier: cut at "_", "-" and before a capital that follows another letter."""
    return F.filter(F.split(name, r"[_-]+|(?<=\P{Lu})(?=\p{Lu})"), lambda w: w != "")


def inflect(verb: Column, verbs: tuple[str, ...] = ()) -> Column:
    """The third person of a lower-case verb; one that is that of a verb in `verbs` stays."""
    third = F.lit(False)
    if verbs:
        third = (verb.endswith("s") & F.regexp_replace(verb, "s$", "").isin(*verbs)) | (verb.endswith("es") & F.regexp_replace(verb, "es$", "").isin(*verbs))
    return (
        F.when(third, verb).when(verb.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(verb, "y$", ""), F.lit("ies")))
        .when(verb.rlike("(?:s|sh|ch|x|z|o)$"), F.concat(verb, F.lit("es"))).otherwise(F.concat(verb, F.lit("s")))
    )


def join_names(names: Column) -> Column:
    """"a", "a and b", "a, b, and c"."""
    n = F.size(names)
    return (
        F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).when(n == 2, F.concat_ws(" and ", names))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, n - 1), ", "), F.lit(", and "), F.element_at(names, -1)))
    )


def ends_with_any(name: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for suffix in suffixes:
        out = out | name.endswith(suffix)
    return out


def category(name: Column, base: Column, n_dependencies: Column, n_properties: Column, n_methods: Column) -> Column:
    """GuiLogic, Utility or BusinessLogic."""
    gui = F.coalesce(base.isin(*GUI_BASES), F.lit(False)) | ends_with_any(name, GUI_SUFFIXES)
    utility = ends_with_any(name, UTILITY_SUFFIXES) | ((n_dependencies == 0) & (n_properties == 0) & (n_methods > 0))
    return F.when(gui, "GuiLogic").when(utility, "Utility").otherwise("BusinessLogic")


#: Words of method names that ask, that govern what follows, and names of algorithms.
ASKING = ("is", "has", "can", "should", "was", "are", "contains", "exists", "supports")
PREPOSITIONS = ("of", "for", "from", "to", "with", "by", "in", "on", "at", "into", "between", "against")
ALGORITHMS = (
    "merge sort", "quick sort", "heap sort", "bubble sort", "insertion sort", "selection sort", "radix sort", "shell sort", "counting sort", "bucket sort", "topological sort",
    "binary search", "linear search", "depth first search", "breadth first search",
)
#: Common verbs, as the default of `verbs`; the whole vocabulary is the caller's.
VERBS = (
    "add", "append", "apply", "build", "calculate", "check", "clear", "close", "compute", "convert", "copy", "count", "create", "delete", "draw", "fetch", "filter", "find", "format", "get", "group", "insert",
    "load", "make", "match", "merge", "move", "open", "parse", "print", "process", "push", "rank", "read", "remove", "render", "reset", "run", "save", "search", "send", "set", "slice", "sort", "split",
    "start", "stop", "sum", "try", "update", "validate", "write",
)
#: Collection types in sentences.
COLLECTION_TYPES = ("List", "IEnumerable", "ICollection", "IList", "Array", "Dictionary", "IReadOnlyList", "HashSet", "vector", "Collection")


def without_arguments(name: Column) -> Column:
    """A name without template arguments."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?s)(?<=.)<.*$", ""))


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000_000))


def is_verb(word: Column, verbs: tuple[str, ...] = VERBS) -> Column:
    """Whether a word, in any case, is a verb of the vocabulary or its third person."""
    low = F.lower(word)
    return low.isin(*verbs) | F.regexp_replace(low, "es$", "").isin(*verbs) | F.regexp_replace(low, "s$", "").isin(*verbs)


def parameter_names(params: Column) -> Column:
    """The last word of each parameter that isn't blank, without & and * before it."""
    words = F.transform(params, lambda p: F.filter(F.split(F.trim(p), " +"), lambda w: w != ""))
    return F.transform(F.filter(words, lambda w: F.size(w) > 0), lambda w: F.regexp_replace(F.element_at(w, -1), r"^[&*]+", ""))


def plain_type(type_: Column) -> Column:
    """A type without suffixes, arguments and qualifiers."""
    return strip_qualifiers(without_arguments(F.trim(F.regexp_replace(F.trim(type_), r"[&*?]+$", ""))))


def is_void_like(type_: Column) -> Column:
    low = F.lower(plain_type(type_))
    return (low == "void") | ((low == "task") & ~type_.contains("<"))


def return_phrase(type_: Column) -> Column:
    simple = plain_type(type_)
    return (
        F.when(F.trim(type_).startswith("decltype("), "a value whose type is deduced from the arguments").when(type_.contains("enable_if"), "a value of the type this overload is constrained to")
        .when(F.lower(simple).contains("task"), "a task that completes asynchronously").when(simple.isin("bool", "Boolean"), "true when the condition holds, otherwise false")
        .when(simple.contains("[]") | simple.isin(*COLLECTION_TYPES), "a collection of results").when(simple.isin("string", "String"), "the resulting text")
        .when(simple.isin("int", "long", "short", "byte", "double", "float", "decimal"), F.concat(F.lit("the computed "), simple, F.lit(" value"))).otherwise(F.concat(F.lit("the resulting "), simple))
    )


def method_sentence(name: Column, class_name: Column, params: Column, returns: Column, verbs: tuple[str, ...] = VERBS) -> Column:
    """One sentence on what a method does, from its name, parameters and return type; never empty."""

    def of_words(x: Column) -> Column:
        words, names, returns = x["words"], x["names"], x["returns"]
        verb, rest = F.get(words, F.lit(0)), F.slice(words, 2, 1_000)
        remainder, joined, some = F.lower(F.array_join(rest, " ")), join_names(names), F.size(names) > 0
        phrase, asks = F.lower(F.array_join(words, " ")), F.lower(verb).isin(*ASKING)
        returning = F.when(is_void_like(returns), "").otherwise(F.concat(F.lit(", returning "), return_phrase(returns)))
        clause = lambda word: F.when(some, F.concat(F.lit(word), joined)).otherwise("")
        several = F.exists(rest, lambda w: F.lower(w).isin("and", "or"))
        objects = F.array_join(F.transform(rest, lambda w: F.when(several & is_verb(w, verbs), inflect(F.lower(w), verbs)).otherwise(F.lower(w))), " ")
        asked = (
            F.when(asks & (remainder != ""), F.concat(F.lit("Determines whether the "), remainder, F.lit(" condition holds"))).when(remainder != "", F.concat(F.lit("Determines whether "), remainder))
            .when(some, F.concat(F.lit("Determines whether "), joined)).otherwise("Determines whether the current state")
        )
        governed = F.when(F.lower(F.element_at(words, -1)).isin(*PREPOSITIONS), clause(" ")).otherwise(clause(" from "))
        acts = F.concat(inflect(F.lower(verb), verbs), F.when(remainder != "", F.concat(F.lit(" "), objects)).otherwise(""), F.when(remainder == "", clause(" the given ")).otherwise(clause(" using ")))
        body = (
            F.when((F.lower(verb) == "try") & (remainder != ""), F.concat(F.lit("Attempts to "), remainder, clause(" using "), returning))
            .when(asks | (plain_type(returns).isin("bool", "Boolean") & ~is_verb(verb, verbs)), F.concat(asked, F.when(remainder != "", clause(", based on ")).otherwise("")))
            .when(phrase.isin(*ALGORITHMS), F.concat(F.lit("Performs the "), phrase, clause(" of "), returning))
            .when(~is_verb(verb, verbs), F.concat(F.when(is_void_like(returns), "Handles the ").otherwise("Computes the "), phrase, governed, returning))
            .otherwise(F.concat(acts, returning))
        )
        made = F.concat(F.lit("Constructs a new "), x["name"], F.lit(" instance"), clause(" using "))
        return F.when((x["name"] != "") & (x["name"] == x["class_name"]), F.concat(made, F.lit("."))).when(F.size(words) == 0, F.concat(F.lit("Represents the "), x["name"], F.lit(" member."))).otherwise(capital(F.concat(body, F.lit("."))))

    own = without_arguments(name)
    names = F.coalesce(parameter_names(params), F.array().cast("array<string>"))
    return bind(F.struct(own.alias("name"), without_arguments(class_name).alias("class_name"), split_identifier(own).alias("words"), names.alias("names"), F.coalesce(returns, F.lit("void")).alias("returns")), of_words)


def listed(names: Column, limit: int) -> Column:
    """The first `limit` names and how many more."""
    n = F.size(names)
    return F.when(n > limit, F.concat(F.array_join(F.slice(names, 1, limit), ", "), F.lit(", and "), (n - limit).cast("string"), F.lit(" more"))).otherwise(join_names(names))


def class_sentence(name: Column, category: Column, methods: Column, n_properties: Column, base: Column, interfaces: Column, dependencies: Column) -> Column:
    """One sentence on a class: its role, members, base, interfaces and dependencies. methods: names."""
    interface = name.rlike(r"^I\p{Lu}")
    n, p = F.size(methods), n_properties
    count = lambda n, one, many: F.concat(n.cast("string"), F.when(n == 1, one).otherwise(many))
    members = F.when(n > 0, F.concat(count(n, " method", " methods"), F.when(p > 0, F.concat(F.lit(" and "), count(p, " property", " properties"))).otherwise(""))).otherwise(count(p, " property", " properties"))
    known = F.filter(methods, lambda m: m != "")
    including = F.when(F.size(known) > 0, F.concat(F.lit(", including "), listed(known, 3))).otherwise("")
    part = lambda lead, values: F.when(F.size(values) > 0, F.concat(F.lit(lead), listed(values, 4))).otherwise("")
    return F.concat(
        F.when(category == "GuiLogic", "User-interface").when(category == "Utility", "Utility").otherwise("Business-logic"), F.when(interface, " interface").otherwise(" class"),
        F.when((n == 0) & (p == 0), " with no members declared directly in it").otherwise(F.concat(F.when(interface, " defining ").otherwise(" with "), members, including)),
        F.when(F.coalesce(base, F.lit("")) != "", F.concat(F.lit("; extends "), base)).otherwise(""), part("; implements ", interfaces), part("; depends on ", dependencies), F.lit("."),
    )


def category_label(category: Column) -> Column:
    """The short mark of a category."""
    return F.when(category == "GuiLogic", "[GUI]").when(category == "Utility", "[Util]").otherwise("[BL]")


def category_text(category: Column) -> Column:
    return F.when(category == "GuiLogic", "GUI Logic").when(category == "Utility", "Utility").otherwise("Business Logic")


def signature(returns: Column, name: Column, params: Column) -> Column:
    return F.concat(returns, F.lit(" "), name, F.lit("("), F.array_join(params, ", "), F.lit(")"))
