"""Structural operators: relationships, indexes, metrics, graphs and trees over entity tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import declarations as D


def first_wins(rows: DataFrame, keys: list[Column], order: list[Column], last: bool = False) -> DataFrame:
    """Of the rows that agree in keys, the first in order (or the last); names of keys differ ignoring case only if the caller upper-cases them."""
    order = [o.desc() for o in order] if last else order
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def relationships(types: DataFrame, calls: DataFrame) -> DataFrame:
    """source, kind, target: INHERITS by base class, IMPLEMENTS by interface, CALLS by call.

    types: type_id, name, base (nullable), interfaces. calls: source, target.
    """
    inherits = types.filter(F.col("base").isNotNull()).select(F.col("name").alias("source"), F.lit("INHERITS").alias("kind"), F.col("base").alias("target"))
    implements = types.select(F.col("name").alias("source"), F.lit("IMPLEMENTS").alias("kind"), F.explode("interfaces").alias("target"))
    return inherits.unionByName(implements).unionByName(calls.select("source", F.lit("CALLS").alias("kind"), "target"))


def call_graph(calls: DataFrame) -> DataFrame:
    """full_name, callees: the calls of the last overload that makes any. calls: full_name, overload, ord, target."""
    last = calls.groupBy("full_name").agg(F.max("overload").alias("overload"))
    own = calls.join(last, ["full_name", "overload"])
    return own.groupBy("full_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("callees"))


def metrics(counts: DataFrame) -> DataFrame:
    """Totals of types and members, and the averages per type with halves rounded to even. counts: type_id, methods, properties."""
    total = counts.agg(F.count("*").alias("classes"), F.coalesce(F.sum("methods"), F.lit(0)).alias("methods"), F.coalesce(F.sum("properties"), F.lit(0)).alias("properties"))
    mean = lambda c: F.when(F.col("classes") > 0, F.bround(F.col(c).cast("double") / F.col("classes"), 2)).otherwise(F.lit(0.0))
    return total.select("*", mean("methods").alias("avg_methods"), mean("properties").alias("avg_properties"))


def overloads(methods: DataFrame) -> DataFrame:
    """One row per (name, signature): the first declaration with a body, with the first documented summary. methods: name, signature, ord, body, summary."""
    empty = F.coalesce(F.length(F.trim("body")), F.lit(0)) == 0
    return methods.groupBy("name", "signature").agg(
        F.min_by("ord", F.struct(empty, "ord")).alias("ord"), F.min_by("body", F.struct(empty, "ord")).alias("body"),
        F.min_by("summary", F.when(F.col("summary") != "", F.col("ord"))).alias("summary"),
    )


def islands(steps: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """steps without those whose kind equals that of the step before."""
    before = F.lag(kind).over(W.partitionBy(*keys).orderBy(*order))
    return steps.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col(kind))).drop("_before")


def capped(steps: DataFrame, keys: list[str], order: list[str], kind: str, merged: list[str], final: str, limit: int = 8) -> DataFrame:
    """At most `limit` steps a key, numbered from 1.

    Above the limit, of the kinds in `merged` only the first step stays; if
    that isn't enough, the first limit - 1 steps that aren't `final` stay, and
    all that are.
    """
    key, place = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(*order)
    rows = steps.withColumn("_n", F.count("*").over(key)).withColumn("_merge", F.col(kind).isin(*merged))
    nth = F.row_number().over(W.partitionBy(*keys, "_merge").orderBy(*order))
    rows = rows.withColumn("_nth", nth).filter((F.col("_n") <= limit) | ~F.col("_merge") | (F.col("_nth") == 1))
    rows = rows.withColumn("_n", F.count("*").over(key)).withColumn("_final", F.col(kind) == final)
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys, "_final").orderBy(*order))).filter((F.col("_n") <= limit) | F.col("_final") | (F.col("_nth") < limit))
    return rows.withColumn("step", F.row_number().over(place)).drop("_n", "_merge", "_nth", "_final")


def newest(entries: DataFrame, created: list[Column], above: int, keep: int) -> DataFrame:
    """All entries up to `above` of them; beyond that the newest `keep`. The limit is found without sorting all rows in one task."""
    total = entries.count()
    return entries if total <= above else entries.orderBy(*[c.desc() for c in created]).limit(keep)


def path_tree(paths: DataFrame, column: str = "path") -> DataFrame:
    """node, parent, depth, files: every folder and file on the way to a path of "/"-separated names."""
    parts = F.split(F.col(column), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(F.array_join(F.slice("parts", 1, n), "/").alias("node"), F.when(n > 1, F.array_join(F.slice("parts", 1, n - 1), "/")).alias("parent"), n.alias("depth")))
    rows = paths.select(parts.alias("parts")).select(F.explode(prefixes).alias("p")).select("p.*")
    return rows.groupBy("node", "parent", "depth").agg(F.count("*").alias("files"))


def grouped_namespaces(types: DataFrame) -> DataFrame:
    """namespace, ord (of its first type), classes (full names in order); types without a namespace are left out. types: ord, namespace, full_name."""
    named = types.filter(F.coalesce(F.trim("namespace"), F.lit("")) != "")
    return named.groupBy("namespace").agg(F.min("ord").alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "full_name"))), lambda x: x["full_name"]).alias("classes"))


def structural_parameter(parameter: Column) -> Column:
    """type and name of a parameter, divided at the first blank."""
    return F.struct(F.substring_index(F.trim(parameter), " ", 1).alias("type"), F.trim(F.regexp_replace(F.trim(parameter), r"^[^ ]* ?", "")).alias("name"))


def symbol_table(symbols: DataFrame) -> DataFrame:
    """key, and the columns of the symbol under it: full names (the last wins), and short names that no full name
    takes before (the first wins). symbols: ord, name, full_name and others."""
    full = symbols.select(F.col("full_name").alias("key"), F.struct(*symbols.columns).alias("s"), F.lit(0).alias("short"))
    short = symbols.select(F.col("name").alias("key"), F.struct(*symbols.columns).alias("s"), F.lit(1).alias("short"))
    # The first row of a key decides whether it is a short name; a full name that comes later replaces it.
    return full.unionByName(short).groupBy("key").agg(F.coalesce(F.max_by("s", F.when(F.col("short") == 0, F.col("s.ord"))), F.min_by("s", "s.ord")).alias("s")).select("key", "s.*")


def method_index(methods: DataFrame) -> DataFrame:
    """key (upper case), method: every method under its full name, "Class.Method" and "Method"; the last of a key wins.
    methods: ord, full_name, class_name, method_name."""
    keys = F.array(F.col("full_name"), F.concat(F.col("class_name"), F.lit("."), F.col("method_name")), F.col("method_name"))
    rows = methods.select("ord", F.col("full_name").alias("method"), F.posexplode(F.transform(keys, F.upper)).alias("k", "key"))
    return rows.groupBy("key").agg(F.max_by("method", F.struct("ord", "k")).alias("method"), F.min(F.struct("ord", "k")).alias("place"))


def type_index(types: DataFrame) -> DataFrame:
    """key (upper case), type: every type under its full name, if it has one, and its name; the last of a key wins. types: ord, name, full_name."""
    rows = types.select("ord", F.col("full_name").alias("type"), F.posexplode(F.filter(F.transform(F.array("full_name", "name"), F.upper), lambda k: F.coalesce(k, F.lit("")) != "")).alias("k", "key"))
    return rows.groupBy("key").agg(F.max_by("type", F.struct("ord", "k")).alias("type"))


#: Reversed keys from which the bounds of their ranges are drawn.
BOUND_KEYS = 10_000


def first_endings(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """own, method: for each text of asked (own), the method of the first key that ends with it. keys: key, method, place (ord, k).

    Reversed, the keys that end with a text stand together, right behind it. Keys and texts are dealt by ranges of
    their reversed form and merged in its order: a stack holds the texts that the present key ends with, which are
    each other's endings. A key goes to one range and a text to those that its keys can lie in.
    """
    backwards = F.reverse("key")
    bounds = [r[0] for r in keys.select(backwards.alias("b")).orderBy(F.xxhash64("b"), "b").limit(BOUND_KEYS).collect()]
    ranges = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds.sort(key=lambda x: x.encode())
    edges = sorted({bounds[len(bounds) * i // ranges] for i in range(1, ranges)}, key=lambda x: x.encode()) if bounds else []
    part = lambda c: F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<string>"), lambda e: e <= c))
    listed = keys.select(backwards.alias("b"), F.lit(True).alias("is_key"), F.col("place.ord").cast("long").alias("ord"), F.col("place.k").cast("int").alias("k"), "method").withColumn("part", part(F.col("b")))
    text = F.reverse("own")
    spread = F.explode(F.sequence(part(text), part(F.concat(text, F.lit(chr(0x10FFFF))))))
    wanted = asked.select("own").distinct().select(text.alias("b"), F.lit(False).alias("is_key"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("method"), spread.alias("part"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [text, the first (ord, k, method) that ends with it]
        now, out = None, []

        def leave(keep: bytes | None) -> None:
            while stack and (keep is None or not keep.startswith(stack[-1][0])):
                text, best = stack.pop()
                if best:
                    out.append((text.decode()[::-1], *best))
                    if stack and (stack[-1][1] is None or best < stack[-1][1]):
                        stack[-1][1] = best

        for batch in batches:
            for part, b, is_key, ord_, k, method in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                b = b.encode()
                leave(b if part == now else None)
                now = part
                if not is_key:
                    stack.append([b, None])
                elif stack and (stack[-1][1] is None or (ord_, k) < stack[-1][1][:2]):
                    stack[-1][1] = (ord_, k, method)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["own", "ord", "k", "method"])
            out.clear()
        leave(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["own", "ord", "k", "method"])

    dealt = listed.unionByName(wanted).repartition(ranges, "part").sortWithinPartitions("part", "b", "is_key").select("part", "b", "is_key", "ord", "k", "method")
    found = dealt.mapInArrow(merge, "own string, ord long, k int, method string")
    return found.groupBy("own").agg(F.min_by("method", F.struct("ord", "k")).alias("method"))


def lookup_methods(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked (id, class_name, method_name) with method: by "Class.Method", then "Method", then the first key of the
    index that ends with "Class.Method", in any case. Only names that no key equals are looked for among the ends of keys."""
    own, bare = F.upper(F.concat("class_name", F.lit("."), "method_name")), F.upper("method_name")
    named = asked.withColumns({"own": own, "bare": bare})
    keys = index.select("key", "method", "place")
    by = lambda column: keys.select(F.col("key").alias(column), F.col("method").alias(f"by_{column}"))
    direct = named.join(by("own"), "own", "left").join(by("bare"), "bare", "left")
    ends = first_endings(direct.filter(F.coalesce("by_own", "by_bare").isNull() & F.col("own").isNotNull()), keys)
    return direct.join(ends.withColumnRenamed("method", "by_end"), "own", "left").select(*asked.columns, F.coalesce("by_own", "by_bare", "by_end").alias("method"))


def lookup_types(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked (declaring, class_name) with type: by the declaring type, else by the class's name."""
    by = lambda column, name: index.select(F.col("key").alias(f"_{column}"), F.col("type").alias(name))
    keyed = asked.withColumns({"_declaring": F.upper("declaring"), "_class_name": F.upper("class_name")})
    return keyed.join(by("declaring", "_t1"), "_declaring", "left").join(by("class_name", "_t2"), "_class_name", "left").select(*asked.columns, F.coalesce("_t1", "_t2").alias("type"))


def knowledge_graph(types: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, kind, properties; the first of an id wins) and edges (source, target, label; links as they are).
    types: ord, namespace, name, full_name, kind, access, methods, properties. links: source, kind, target."""
    spaces = grouped_namespaces(types).select(F.concat(F.lit("ns:"), "namespace").alias("id"), F.col("namespace").alias("label"), F.lit("namespace").alias("kind"), F.lit(None).cast("map<string,string>").alias("properties"), F.lit(0).alias("o"), "ord")
    properties = F.create_map(F.lit("accessModifier"), F.col("access"), F.lit("methodCount"), F.col("methods").cast("string"), F.lit("propertyCount"), F.col("properties").cast("string"))
    classes = types.select(F.concat(F.lit("class:"), "full_name").alias("id"), F.col("name").alias("label"), "kind", properties.alias("properties"), F.lit(1).alias("o"), "ord")
    nodes = spaces.unionByName(classes).groupBy("id").agg(F.min_by(F.struct("label", "kind", "properties"), F.struct("o", "ord")).alias("n")).select("id", "n.*")
    inside = types.filter(F.coalesce("namespace", F.lit("")) != "").select(F.concat(F.lit("ns:"), "namespace").alias("source"), F.concat(F.lit("class:"), "full_name").alias("target"), F.lit("CONTAINS").alias("label"))
    return nodes, inside.unionByName(links.select("source", "target", F.col("kind").alias("label")))


def modifiers(access: Column, **flags: Column) -> Column:
    """The access and the names of the flags that hold, in order."""
    return F.filter(F.array(access, *[F.when(flag, F.lit(name)) for name, flag in flags.items()]), lambda m: m.isNotNull())


def merged_summary(own: Column, other: Column) -> Column:
    """The first of two summaries that isn't blank, trimmed."""
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), F.trim(other))


def detail(asked: DataFrame, methods: DataFrame, types: DataFrame, structural: DataFrame) -> DataFrame:
    """asked (id, class_name, method_name, summary) with what the project knows of the method: method, type,
    merged_summary, call_targets. structural: full_name (one row each), declaring, summary, calls."""
    found = lookup_methods(asked, method_index(methods))
    known = structural.select(F.col("full_name").alias("method"), "declaring", F.col("summary").alias("_s"), "calls")
    rows = lookup_types(found.join(known, "method", "left"), type_index(types))
    return rows.select(*asked.columns, "method", "type", merged_summary(F.col("summary"), F.col("_s")).alias("merged_summary"), F.coalesce("calls", F.array().cast("array<string>")).alias("call_targets"))


def collapsed(tree: DataFrame) -> DataFrame:
    """path_tree() with chains of folders that hold a single folder joined to one node: node, parent, depth, label, files.

    A folder is dropped where it has one child that is a folder; a kept node hangs
    under the nearest kept folder above it. Every node looks its folders up
    among its own prefixes, so no chain is followed step by step.
    """
    children = tree.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    inner = tree.join(children, "node", "left")
    folders = inner.filter(F.col("children").isNotNull()).select(F.col("node").alias("child"), F.col("parent").alias("node"))
    single = inner.filter("children = 1").select("node").join(folders.select("node"), "node", "left_semi").select(F.col("node").alias("up"))
    kept = tree.join(single, tree.node == single.up, "left_anti")
    parts = F.split("node", "/")
    ups = kept.filter("parent is not null").select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up"))
    nearest = ups.join(single, "up", "left_anti").groupBy("node").agg(F.max_by("up", F.length("up")).alias("shown_parent"))
    rows = kept.join(nearest, "node", "left")
    label = F.when(F.col("shown_parent").isNull(), F.col("node")).otherwise(F.substring(F.col("node"), F.length("shown_parent") + 2, F.length("node")))
    return rows.select("node", F.col("shown_parent").alias("parent"), F.size(F.split(F.coalesce("shown_parent", F.lit("")), "/")).alias("depth"), label.alias("label"), "files")


def filtered(files: DataFrame, classes: DataFrame, methods: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """The files, and the methods with visible, that a text selects in any case: a file by its name, or that of a class
    or method in it; a method by its own name or that of its class. files: file; classes: file, class_name; methods: file, class_name, method_name."""
    has = lambda c: F.upper(c).contains(query.strip().upper())
    hits = classes.filter(has("class_name")).select("file").unionByName(methods.filter(has("method_name")).select("file")).distinct().withColumn("_hit", F.lit(True))
    shown = files.join(hits, "file", "left").filter(has("file") | F.col("_hit")).drop("_hit")
    return shown, methods.withColumn("visible", has("class_name") | has("method_name"))


def filter_message(n: Column, query: str) -> Column:
    return F.when(n == 0, F.lit(f"No matches for \u201c{query}\u201d")).when(n == 1, "1 file matches").otherwise(F.concat(n.cast("string"), F.lit(" files match")))


#: The most nodes that are drawn at once.
MOST_NODES = 4_000


def drawable(tree: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """nodes, drawable: how many nodes a tree has, and whether so many are drawn."""
    return tree.agg(F.count("*").alias("nodes")).withColumn("drawable", F.col("nodes") <= most)


def exceptions_of(thrown: Column, tags: Column) -> Column:
    """type and description of the thrown exceptions, then of documented ones not among them in any case."""
    pair = lambda t, d: F.struct(t.alias("type"), d.alias("description"))
    every = F.concat(
        F.transform(thrown, lambda t: pair(t, F.coalesce(D.exception_description(tags, t), F.lit("Thrown in method body")))),
        F.transform(D.documented_exceptions(tags), lambda t: pair(t, F.element_at(tags, F.concat(F.lit("exception:"), t)))),
    )
    return D.first_of_each(every, lambda e: F.upper(e["type"]))


def fits_in(class_name: Column, category: Column, dependencies: Column, base: Column, calls: Column, inherits: Column) -> Column:
    """label and text of what says how a method fits in; the first six calls; calls and ancestors only where there are any."""
    row = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    or_ = lambda values, none: F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(none)
    rows = F.array(
        row("Lives in", F.concat(class_name, F.lit(" ("), category, F.lit(")"))), row("That class depends on", or_(dependencies, "None")), row("That class extends", F.coalesce(F.nullif(base, F.lit("")), F.lit("No base class"))),
        F.when(F.size(calls) > 0, row("This method calls", F.array_join(F.slice(calls, 1, 6), ", "))), F.when(F.size(inherits) > 0, row("Inheritance", F.array_join(inherits, ", "))),
    )
    return F.filter(rows, lambda r: r.isNotNull())


def variables_card(own: Column, structural: Column) -> Column:
    """Fields of two lists (name, type), those of the second that the first hasn't in any case."""
    return D.first_of_each(F.concat(own, structural), lambda f: F.upper(f["name"]))


def used_variables(usage: DataFrame) -> DataFrame:
    """The variables (method_id, name, usage) that a method uses."""
    return usage.filter(F.col("usage") != "Unused")


def inline_limits(parameters: DataFrame, limits: DataFrame) -> DataFrame:
    """parameters (method_id, name) with the limit of the same name, if any."""
    return parameters.join(limits.select("method_id", "name", "limit"), ["method_id", "name"], "left")


def follow_ups(name: Column, thrown: Column) -> Column:
    """Questions to go on with."""
    say = lambda a, n, b: F.concat(F.lit(a), n, F.lit(b))
    return F.filter(F.array(
        say("What happens if the inputs to ", name, " are null or out of range?"), say("How is ", name, " called in the rest of the codebase?"),
        say("When exactly is ", F.get(thrown, F.lit(0)), " thrown?"), say("Can ", name, " be made asynchronous?")), lambda q: q.isNotNull())


def add_questions(store: DataFrame, questions: DataFrame) -> DataFrame:
    """A store of questions (method, question, ord) with more; of those that differ in case only the first stays."""
    return first_wins(store.unionByName(questions), [F.col("method"), F.upper("question")], [F.col("ord")])


def remove_questions(store: DataFrame, questions: DataFrame) -> DataFrame:
    gone = questions.select("method", F.upper("question").alias("_q"))
    return store.withColumn("_q", F.upper("question")).join(gone, ["method", "_q"], "left_anti").drop("_q")
