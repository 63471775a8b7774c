"""Lookups by endings, streams against batch, scans and project runs."""

import os
import random
import threading
import time

import numpy as np
from pyspark.sql import functions as F

from sourcegrain.operators import limits, project, rules, structure
from sourcegrain.sources import files
from sourcegrain.streaming import debounce, partial, rescan, throttle

METHOD = (
    "method_id long, class_name string, method_name string, return_type string, language string, params array<string>, body string, fields array<struct<name:string,type:string>>, locals array<struct<name:string,type:string>>, "
    "properties array<struct<name:string,type:string>>, thrown array<string>, op_limits array<string>, class_dependencies array<string>"
)


def test_first_endings_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("AB.é") for _ in range(rng.randrange(1, 7)))
    keys = {word(): (rng.randrange(50), rng.randrange(3)) for _ in range(300)}
    asked = {word()[-rng.randrange(1, 6) :] for _ in range(200)} | {"A", "", "none such"}
    rows = spark.createDataFrame([(k, f"m:{k}", p) for k, p in keys.items()], "key string, method string, place struct<ord:int,k:int>")
    got = {r.own: r.method for r in structure.first_endings(spark.createDataFrame([(a,) for a in asked for _ in range(2)], "own string"), rows).collect()}
    places = {a: min((p for k, p in keys.items() if k.endswith(a)), default=None) for a in asked}
    assert set(got) == {a for a, p in places.items() if p is not None}
    assert all(keys[m[2:]] == places[a] and m[2:].endswith(a) for a, m in got.items())
    assert structure.first_endings(spark.createDataFrame([("A",)], "own string"), rows.limit(0)).count() == 0


def test_lookup_by_ending(spark):
    methods = spark.createDataFrame([(1, "X.Shop.Cart.Add", "Cart", "Add"), (2, "X.Bag.Cart.Add", "Cart", "Add"), (3, "Y.MyCart.Drop", "MyCart", "Drop")], "ord int, full_name string, class_name string, method_name string")
    asked = spark.createDataFrame([(1, "cart", "ADD"), (2, "None", "Drop"), (3, "cart", "drop"), (4, "bag.cart", "add"), (5, "Q", "Z"), (6, "art", "rop")], "id int, class_name string, method_name string")
    got = {r.id: r.method for r in structure.lookup_methods(asked, structure.method_index(methods)).collect()}
    assert got == {1: "X.Bag.Cart.Add", 2: "Y.MyCart.Drop", 3: "Y.MyCart.Drop", 4: "X.Bag.Cart.Add", 5: None, 6: None}
    ends = structure.lookup_methods(spark.createDataFrame([(7, "t", "dro"), (8, "ycart", "drop2")], "id int, class_name string, method_name string"), structure.method_index(methods))
    assert {r.id: r.method for r in ends.collect()} == {7: None, 8: None}
    only = structure.method_index(methods.filter("ord = 1")).filter(F.col("key").contains("SHOP"))
    assert structure.lookup_methods(spark.createDataFrame([(1, "op.Cart", "add")], "id int, class_name string, method_name string"), only).first().method == "X.Shop.Cart.Add"


def in_batches(spark, rows, schema, folder, pieces):
    """A stream that reads rows in so many files, one at a time."""
    size = -(-len(rows) // pieces)
    for i in range(pieces):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    assert len([f for f in os.listdir(f"{folder}/in") if f.endswith(".parquet")]) == pieces
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run_stream(spark, stream, folder, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/state").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_throttle_steps_over_times():
    times = np.array([0, 1, 1, 5, 9, 10, 10, 20])
    for last, interval in ((None, 5), (3, 5), (None, 1), (100, 5), (None, 100)):
        want, now = [], last
        for i, t in enumerate(times.tolist()):
            if now is None or t - now >= interval:
                want.append(i)
                now = t
        found, end = throttle.forwarded(times, last, interval)
        assert found.tolist() == want and end == now


def test_debounce_stream_is_batch(spark, tmp_path):
    rng = random.Random(6)
    times = sorted(rng.randrange(10**9) for _ in range(160))
    rows = [(i % 5, 1_000 * t, i, rng.choice(["a", "b", "", None])) for i, t in enumerate(times)] + [(9, 10**15, 999, "last")]
    schema = "key long, us long, seq long, value string"
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us"))
    want = {tuple(r) for r in debounce.debounce(batch, 30_000_000_000).collect()}
    stream = in_batches(spark, rows, schema, tmp_path, 4).withColumn("ts", F.timestamp_micros("us"))
    got = run_stream(spark, debounce.debounce_stream(stream, 30_000_000_000), tmp_path, "debounced")
    # What waits for its interval at the end of the stream is not told yet.
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == {r for r in want if r[0] != 9} and any(r[0] == 9 for r in want) and 20 < len(got) < 160


def test_partial_texts_stream_is_batch(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice(["<", "|im", "**", "_", "_", " ", "word ", "end>", None or "x", "\n"]) for _ in range(rng.randrange(1, 5)))
    rows = [(i % 7, i, text() if rng.random() < 0.95 else None) for i in range(200)]
    schema = "key long, seq long, piece string"
    want = {tuple(r) for r in partial.partial_texts(spark.createDataFrame(rows, schema)).collect()}
    got = run_stream(spark, partial.partial_texts_stream(in_batches(spark, rows, schema, tmp_path, 3)), tmp_path, "partial_texts")
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    so_far = {}
    for key, seq, piece in rows:
        so_far[key] = so_far.get(key, "") + (piece or "")
        shown = so_far[key].replace("**", "").replace("__", "").lstrip()
        angle = shown.rfind("<")
        shown = shown[:angle] if angle >= 0 and len(shown) - angle <= 12 else shown
        assert ((key, seq, shown) in want) == bool(shown)


def tree(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"class {(root / name).stem.strip('_.')} {{ }}")


def test_scan_finds_every_source_file(spark, tmp_path):
    deep = "/".join(f"d{i}" for i in range(60)) + "/Deep.cs"
    kept = ["A.cs", "_Layout.cs", "_gen/B.cs", ".hid/C.CPP", "sub dir/D.cs", "x/Bins/E.h", "x/y/z/F.Hpp", "ü/漢.cs", deep]
    tree(tmp_path, [*kept, "Bin/G.cs", "x/OBJ/H.cs", ".git/I.cs", "node_modules/p/J.cs", "x/.VS/K.cs", "readme.md", "L.cs.txt", "Build/M.h"])
    (tmp_path / "link").symlink_to(tmp_path / "x")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "linked.cs").symlink_to(tmp_path / "A.cs")
    (tmp_path / "broken.cs").symlink_to(tmp_path / "nothing")
    found = {r.path[len(str(tmp_path)) + 1 :]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(found) == {*kept, "linked.cs"} and found["_Layout.cs"].text == "class Layout { }" and found[".hid/C.CPP"].language == "C++"
    assert files.scan(spark, "").count() == files.scan(spark, str(tmp_path / "none")).count() == 0
    assert files.listing(spark, f"file://{tmp_path}").count() == len(found)


def test_contents_of_odd_files(spark, tmp_path):
    (tmp_path / "a.cs").write_bytes(b"\xef\xbb\xbfclass \xff{}")
    (tmp_path / "empty.cs").write_bytes(b"")
    (tmp_path / "dir.cs").mkdir()
    asked = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.cs", "empty.cs", "dir.cs", "none.cs")] + [(" ",), (None,)], "path string")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error and r.error.split(":")[0]) for r in files.read(spark, asked).collect()}
    assert got == {"a.cs": ("class �{}", None), "empty.cs": ("", None), "dir.cs": (None, "Is a directory"), "none.cs": (None, "File not found"), "": (None, "File path is empty.")}


def test_rescan_reads_only_what_changed(spark, tmp_path):
    root, target = tmp_path / "src", str(tmp_path / "table")
    tree(root, ["A.cs", "sub/B.cs", "C.h"])
    state = lambda: {r.path.rsplit("/", 1)[1]: r.text for r in rescan.latest(spark, target).collect()}
    assert rescan.rescan(spark, str(root), target) == {"read": 3, "kept": 0, "evicted": 0}
    (root / "C.h").unlink()
    (root / "A.cs").write_text("changed")
    os.utime(root / "A.cs", (10**9, 10**9))
    tree(root, ["_D.cs"])
    assert rescan.rescan(spark, str(root), target) == {"read": 2, "kept": 1, "evicted": 1}
    assert state() == {"A.cs": "changed", "B.cs": "class B { }", "_D.cs": "class D { }"}
    assert rescan.rescan(spark, str(root), target) == {"read": 0, "kept": 3, "evicted": 0} and len(os.listdir(target)) == 2


def test_rescan_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    root, target, checkpoint = tmp_path / "src", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    tree(root, ["A.cs", "sub/B.cs"])

    def one_run():
        query = rescan.rescan_stream(spark, str(root), target, checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return {r.path.rsplit("/", 1)[1]: r.text for r in rescan.latest(spark, target).collect()}

    assert one_run() == {"A.cs": "class A { }", "B.cs": "class B { }"}
    (root / "A.cs").unlink()
    (root / "sub/B.cs").write_text("changed")
    os.utime(root / "sub/B.cs", (10**9, 10**9))
    tree(root, ["new/E.cs"])
    assert one_run() == {"B.cs": "changed", "E.cs": "class E { }"}


SHOP = """namespace Shop {
  public class Cart : Base, IThing { private int count = 0; public int Add(int amount) { if (amount < 1) throw new ArgumentException("no"); count += amount; return count; } }
  public interface IThing { int Add(int amount); }
}"""


def test_project(spark, tmp_path):
    root, target = tmp_path / "shop", str(tmp_path / "out")
    assert project.analyze_project(spark, "", target).error == project.analyze_project(spark, str(root), target).error == "Invalid project path"
    root.mkdir()
    empty = project.analyze_project(spark, str(root), target)
    assert (empty.success, empty.error, empty.no_source_files) == (False, "No C# or C++ source files found", True)
    (root / "Cart.cs").write_text(SHOP)
    (root / "half.cpp").write_text("double half(double d) { return d / 2; }")
    (root / "bad.cs").write_text("class Bad { void Run() { " + "a" * 60_000 + "; } }")
    (root / "dir.cs").mkdir()
    told = []
    run = project.analyze_project(spark, str(root), target, report=lambda stage, rows: told.append((stage, rows)))
    assert run.success and run.error is None and not run.resumed, run.error
    table = lambda name: spark.read.parquet(run.tables[name])
    # What is told of a stage is what its table holds.
    assert told == [(name, table(name).count()) for name in run.tables] and dict(told) == run.counts
    assert {(r.type_name, r.method_name) for r in table("methods").collect()} == {("Shop.Cart", "Add"), ("Shop.IThing", "Add"), ("(global)", "half"), ("Bad", "Run")}
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in table("quarantine").collect()] == [("bad.cs", rules.BUDGET_EXCEEDED)]
    assert {(r.name, r["limit"]) for r in table("limits").collect() if r.name == "amount"} == {("amount", "1 or greater"), ("amount", "any whole number")}
    assert {"guard-range-check"} <= {r.rule_id for r in table("findings").collect()} and "Update the count field with the new computed value" in {r.description for r in table("steps").collect()}
    assert {(r.source, r.label, r.target) for r in table("edges").collect()} >= {("Shop.Cart", "INHERITS", "Base"), ("Shop.Cart", "IMPLEMENTS", "IThing"), ("ns:Shop", "CONTAINS", "class:Shop.Cart")}
    m = table("metrics").first()
    assert (m.files_analyzed, m.failed, m.classes, m.methods, m.namespaces) == (3, 1, 4, 4, 1)
    assert project.summary_text(table("metrics")).first().summary == "## Project Summary: shop\n\n**Metrics:** 4 classes, 4 methods, 1 namespaces"
    again = project.analyze_project(spark, str(root), target)
    assert again.success and again.resumed == list(run.tables) and again.counts == run.counts


def test_canceled_project_leaves_no_partial_table(spark, tmp_path):
    root, target = tmp_path / "src", str(tmp_path / "out")
    tree(root, [f"F{i}.cs" for i in range(30)])

    ended = threading.Event()

    def keep_stopping():
        while not ended.wait(0.05):
            project.cancel(spark, "t1")

    thread = threading.Thread(target=keep_stopping)
    run = project.analyze_project(spark, str(root), target, tag="t1", report=lambda stage, rows: stage == "files" and thread.start())
    ended.set()
    thread.join()
    assert (run.success, run.error) == (False, "Scan canceled.")
    folder = os.path.join(target, os.listdir(target)[0])
    assert all(os.path.exists(f"{folder}/{name}/_SUCCESS") for name in os.listdir(folder)) and {"listing", "files"} <= set(os.listdir(folder))
    done = project.analyze_project(spark, str(root), target, tag="t2")
    assert done.success and {"listing", "files"} <= set(done.resumed) and done.counts["methods"] == 30


def test_hostile_bodies_are_named_not_matched(spark):
    bodies = ["{ " + "a" * 90_000 + " }", "{ x = 1;" + " " * 90_000 + "}", "{ x = 1; }", None]
    rows = spark.createDataFrame([(i, "C", "M", "void", "C#", ["int n"], b, [], [], [], [], [], []) for i, b in enumerate(bodies)], METHOD)
    began = time.perf_counter()
    assert {r.method_id for r in rules.not_analysed(rows).collect()} == {0, 1}
    assert {r.method_id for r in rules.analyses(rows).collect()} >= {2} and limits.variable_limits(rows).count() == 4 and rules.variable_usage(rows).count() == 4
    assert time.perf_counter() - began < 60
