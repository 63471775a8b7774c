"""The training-data operators against brute force on small tables with every odd case."""

import collections
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from sourcegrain.llm import anchors, html, jaccard, licenses, mixing, packing, passages, quality, suffixes, toxicity, vectors
from sourcegrain.llm.components import components, star_rounds
from sourcegrain.llm.grams import window_minima

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, block string, order string"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Rows of documents: copies, near copies, a shared passage, repeats, nulls, empties, a long text and clashing columns."""
    rng = random.Random(5)
    passage, base = prose(rng, 90), prose(rng, 120)
    near = base.split()
    texts = [base, base, " ".join([*near[:60], "new", *near[61:]]), " ".join([*near[:20], "other", *near[21:]])]
    texts += [f"{prose(rng, 20)} {passage}\n{prose(rng, 30)}" for _ in range(5)] + [prose(rng, 60) for _ in range(5)]
    texts += ["", None, "  \n\t ", "one", "One two", "one two", "é ü 漢字 ﬁ", "a " * 900, prose(rng, 3000), passage[:450]]
    sources = ["b", "a", None, "ü", "b", "b", "b"]
    rows = [(i, t, ["en", None, "xx"][i % 3], sources[i % 7]) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, "en", "a"), (7, "another text under the same number " + prose(rng, 30), "en", "b")]
    return [(*r, None, 7, "x", "y") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def split(text):
    return (text or "").encode().split()


def grouped(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def test_quality(docs):
    got = {(r.doc_id, r.n_words, r.th): r for r in quality.quality(docs).collect()}
    assert quality.quality(docs).count() == len(corpus())
    by_words = collections.Counter()
    for _, text, *_ in corpus():
        words = [w.decode() for w in split(text)]
        windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (text or "").split("\n") if x.split()]
        by_words[len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)] += 1
    assert grouped(quality.quality(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == by_words
    assert not any(r.kept and r.base_failed for r in got.values())
    assert quality.keep_good(docs).columns == docs.columns


def removed_bytes(texts, window):
    starts = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if starts[t[i : i + window]] > 1:
                cover[i : i + window] = True
        spans = sum(cover[i] and not (i and cover[i - 1]) for i in range(len(t)))
        yield len(t), int(cover.sum()), spans, np.frombuffer(t, np.uint8)[~cover].tobytes()


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT", hot)
    want = collections.Counter(removed_bytes([(r[1] or "").encode() for r in corpus()], 400))
    got = collections.Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup_bytes(docs).collect())
    assert got == want and sum(k[1] for k in want) > 0


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    strings = [b"abcabc", b"abcabd", b"ab", b"b", b"ab"]
    monkeypatch.setattr(suffixes, "prefix_hashes", lambda data: np.zeros(len(data) + 1, np.uint64))
    order = suffixes.SuffixSort(strings, np.zeros(5, np.int64))
    assert [strings[i] for i in order.order] == sorted(strings) and order.common.tolist() == [0, 2, 2, 5, 0]


def test_mixing(docs):
    mix = mixing.curriculum_mix(docs)
    rows = mixing.taken_words(mixing.positioned(docs)).collect()
    assert len(rows) == len(corpus()) and all(0 <= r.taken <= 2 * r.size for r in rows)
    total = sum(r.size for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in targets)
    positions = [r.position for r in mix.collect() if r.position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert grouped(mixing.taken_words(mixing.positioned(docs.repartition(5)))) == collections.Counter(tuple(r) for r in rows)


def test_many_sources(spark):
    """Targets of 60,000 sources take no time that grows with their square."""
    sizes = spark.range(60_000).select(F.lit(False).alias("no_source"), F.col("id").cast("string").alias("src"), (F.col("id") % 97 + 1).alias("source_size"))
    began = time.perf_counter()
    row = mixing.source_targets(sizes, (5, 2, 1), (0.5, 0.0, -0.5), 1.5, 2.0).agg(F.sum("target").alias("t"), F.sum("source_size").alias("s"), F.max(F.col("target") - 2 * F.col("source_size")).alias("over")).first()
    assert abs(row.t - 1.5 * row.s) < 1e-3 and row.over <= 1e-9 and time.perf_counter() - began < 30


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = collections.Counter()
    for doc_id, text, *_ in corpus():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    packed = packing.pack_documents(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in packed) == want
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def linked(k, num, den):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = corpus()
    sets = []
    for _, text, *_ in rows:
        w = [x.decode() for x in split((text or "").translate(fold))]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    low = {r: min([rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None], default=None) for r in set(root)}
    return collections.Counter((rows[i][0], len(sets[i]), low[root[i]]) for i in range(len(rows)))


@pytest.mark.parametrize(("k", "num", "den", "chunk"), [(4, 85, 100, 16_000_000), (5, 4, 5, 400)])
def test_jaccard(docs, monkeypatch, k, num, den, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    assert grouped(jaccard.jaccard_components(docs, k, num, den).select("doc_id", "n_shingles", "component_id")) == linked(k, num, den)


def test_jaccard_reads_each_chosen_text_once(spark, monkeypatch):
    """Rows that share a null or repeated doc_id meet only their own nodes."""
    rng, rows = random.Random(7), []
    for i in range(40):
        base = prose(rng, 60).split()
        rows += [(None if i % 2 else 5, " ".join(base)), (None if i % 2 else 5, " ".join([*base[:30], "new", *base[31:]]))]
    seen = []
    plain = jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name: (seen.append((plain(df, name), "text" in df.columns)), seen[-1][0])[1])
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 3, 5).collect()
    assert max(df.count() for df, holds_text in seen if holds_text) <= len(rows)
    assert len(found) == len(rows) and {r.component_id for r in found} == {5, None}


def test_signatures_miss_no_pair():
    rng, scheme = np.random.default_rng(2), jaccard.Scheme(4, 5)
    for _ in range(400):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 9 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both) and both:
            assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size


def test_signatures_miss_no_pair_whatever_is_common():
    rng, met = np.random.default_rng(6), 0
    for share in (0.05, 0.5, 0.95, 1.0):
        for _ in range(150):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 9 + 1))).astype(np.uint64)]))
            both, union = len(np.intersect1d(a, b)), np.union1d(a, b)
            if both and 5 * both >= 4 * len(union):
                scheme, met = jaccard.Scheme(4, 5, union[rng.random(len(union)) < share]), met + 1
                assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size
    assert met > 100


def test_a_common_passage_makes_no_block(spark):
    """Texts that share a passage, but no text of 0.8, are no candidates of each other (F1: such blocks held most of the corpus and
    were compared in pairs of chunks); copies that hold the passage still are."""
    rng = random.Random(31)
    passage, own = [f"p{i}" for i in range(40)], lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    texts = [(*own(150), *passage, *own(250)) for _ in range(300)]
    near = [(*t[:100], "new", *t[101:]) for t in texts[:20]]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *near, *[passage] * 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.withColumn("th", F.xxhash64("text"))
    edges = jaccard.nodes_and_edges(keyed, 5, 4, 5).filter("other is not null").select("node", "other").distinct().count()
    assert 20 <= edges <= 25
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 5, 4, 5).collect()}
    assert got == {i: i - 300 if 300 <= i < 320 else 320 if i == 321 else i for i in range(322)}


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(50, 40), (60, 50), (60, 40), (7, 7)], "a long, b long")
    want = {(i, 0) for i in range(31)} | {(40, 40), (50, 40), (60, 40)}
    assert {tuple(r) for r in components(edges).collect()} == want
    assert {tuple(r) for r in star_rounds(edges.filter("a <> b")).collect()} == {(n, r) for n, r in want if n != r}


def test_window_minima():
    rng = np.random.default_rng(3)
    for n, w in ((40, 7), (6, 7), (21, 3)):
        v = rng.integers(0, 6, n).astype(np.uint64)
        assert window_minima(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(max(0, n - w + 1))]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_passages(docs, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT", hot)
    rows = corpus()
    first = {}
    for doc_id, text, *_ in rows:
        w = split(text)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, 2**63), 2**63 - 1 if doc_id is None else doc_id)
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        w, own = split(text), 2**63 - 1 if doc_id is None else doc_id
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < own for j in range(i, i + 13)}
        want[doc_id, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    assert grouped(passages.dedup_passages(docs)) == want and any(k[2] for k in want)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, None), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (None, rows[1][1]), (204, [float("inf")] * 6), (5, rows[5][1]), (220, [0.5] * 3)]
    rows += [(40, rows[40][1]), (60, rows[7][1]), (3, rows[3][1]), (3, rows[3][1])]
    got = grouped(vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).select("query_id", "rank", "vec_id", "score"))
    good = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v)).all()]
    want = collections.Counter()
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert got == want and max(want.values()) == 2


def test_top_k_of_repeated_rows(spark):
    rows = [(20, [1.0]), (1, [1.0]), (1, [1.0]), (2, [0.5])]
    got = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20, 5).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 1, 4096), (2, 1, 4096), (3, 2, 2048)]


@pytest.mark.parametrize("scale", [30, 10**5, 10**8])
def test_tree_search_by_batches(monkeypatch, scale):
    """Small leaves and small rounds of choice; scores fit a float, a double or only a long; points and ids that repeat."""
    monkeypatch.setattr(vectors, "LEAF", 5)
    monkeypatch.setattr(vectors, "HELD_SCORES", 20)
    rng = np.random.default_rng(scale)
    points = rng.integers(-scale, scale, (400, 3))
    points[100:140], points[200:210] = points[0], points[50:60]
    ids = rng.permutation(400)
    ids[210:220] = ids[200]
    ids[7], points[7] = 2**63 - 1, points[0]
    tree = vectors.KDTree(ids, points)
    assert tree.exact(points) is {30: np.float32, 10**5: np.float64, 10**8: np.int64}[scale]
    for floor in (vectors.LOWEST, 0, scale * scale // 2):
        where, vec_ids, scores = tree.top(ids, points, 6, np.full(400, floor))
        for i in range(400):
            best = sorted((-int(points[i] @ p), int(v)) for p, v in zip(points, ids, strict=True) if v != ids[i] and points[i] @ p >= floor)[:6]
            assert sorted(zip((-scores[where == i]).tolist(), vec_ids[where == i].tolist(), strict=True)) == best


def test_top_k_costs_about_a_matrix_product(spark):
    """Python CPU seconds of 4,800 queries over 24,000 vectors without clusters, where no box spares anything."""
    rows = spark.range(24_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.xxhash64("id", i) % 1000) / F.lit(4000.0)).alias("embedding"))

    def python_s():
        return sum(sum(p.cpu_times()[:4]) for p in psutil.Process().children(recursive=True) if "python" in p.name())

    before = python_s()
    got = vectors.top_k(rows, F.col("vec_id") % 5 == 0).toPandas()
    took = python_s() - before
    assert len(got) == 4800 * 20
    got = got[got["query_id"] % 100 == 0].sort_values(["query_id", "rank"])
    points = np.floor(64 * np.array(rows.orderBy("vec_id").toPandas()["embedding"].tolist()))
    scores = points[::100] @ points.T
    scores[np.arange(240), np.arange(0, 24_000, 100)] = -np.inf
    want = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    assert got["vec_id"].tolist() == want.ravel().tolist() and got["score"].tolist() == np.take_along_axis(scores, want, 1).ravel().tolist()
    assert took < 20, took


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy this now</div><article><h1>Head &amp; more</h1><p>One <b>two</b><br>three&nbsp;four'
    '<p>Five &lt;six&gt;<script>var t="</p>";</script></p><div class="comments"><p>me too</p></div></article><aside>See also</aside><footer>&copy; all</footer><!-- open'
)


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>lonely words here</p>"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect())
    text = "Head & more\n\nOne two three four\n\nFive <six>"
    assert got == collections.Counter([(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (None, "lonely words here", 17)])


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div id="header-and-content"', 'form id="aspnetForm"', "form", 'section class="search-page"'])
def test_html_wrappers_with_names(wrapper):
    body = "<p>One two three four five six</p><p>Seven eight nine ten</p>"
    text = "One two three four five six\n\nSeven eight nine ten"
    close = f"</{wrapper.split()[0]}>"
    weights = {"word": 0.5, "linked": -1.0, "p": 0.3, "/p": 0.3}
    ad, search = '<div class="ad">Buy this now</div>', "<form><label>Find</label><p>Search here</p></form>"
    for content in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
        assert html.main_text(f"<html><body>{search}<{wrapper}>{ad}{content}{close}<footer>all</footer></body></html>", weights) == text
    long = '<div class="comments">' + "<p>me too and more of it</p>" * 9 + "</div>"
    assert html.main_text(f"<html><body><{wrapper}><article>{body}</article></{wrapper.split()[0]}>{ad}</body></html>", weights) == text
    assert "me too" not in html.main_text(f"<html><body><{wrapper}><article>{body}</article>{close}{long}</body></html>", {**weights, "/div": -99.0, "div": -99.0, "/article": -99.0})


@pytest.mark.parametrize("page", [
    '<p class="related-work">Earlier work says so.</p>', '<section id="notice-period"><p>Earlier work says so.</p></section>', "<blockquote><p>Earlier work</p><footer>says so.</footer></blockquote>",
    '<div class="share-price">Earlier work says so.</div>', '<p id="comment-on-law">Earlier work says so.</p>',
])
def test_html_keeps_what_an_article_is_about(page):
    boilerplate = "".join(f'<div class="{c}">no</div>' for c in ("ad", "ad-box", "related-posts", "comment-list", "x social-share-buttons", "sidebar-right"))
    text = html.main_text(f"<html><body><article><p>One two three four five</p>{page}{boilerplate}</article><footer>all</footer></body></html>", {"word": 0.5, "linked": -1.0, "div": 0.0, "/div": 0.0, "p": 0.3, "/p": 0.3, "blockquote": 0.0, "/blockquote": 0.0, "footer": 0.0, "/footer": 0.0})
    assert "Earlier work" in text and "says so." in text and "no" not in text.split()


@pytest.mark.parametrize(("above", "kept"), [("<h1>The title</h1>", True), ("<div><h1><b>The title</b></h1></div>", True), ("<header><h1>The title</h1></header>", False), ("<h1>The title</h1><nav><a href=x>go</a></nav>", False), ("<p>x</p><div><h1></h1></div>", False)])
def test_html_heading_above_plain_paragraphs(above, kept):
    body = "<p>" + "One two three four five six. " * 5 + "</p>"
    assert html.main_text(f"<html><body>{above}{body * 3}</body></html>", html.PLAIN_WEIGHTS).startswith("The title\n\nOne" if kept else "One")


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "x</span>" * 40_000, "<!x" * 100_000, "<!-- " * 50_000, "<script>" * 40_000, "<a '" * 50_000, '<a "' * 50_000 + ">", "<p>x " * 60_000, "<script" * 50_000])
def test_html_of_long_odd_pages_takes_linear_time(page):
    began = time.perf_counter()
    html.main_text(page, html.PLAIN_WEIGHTS)
    assert time.perf_counter() - began < 6


def test_html_ends_within_a_comment_or_script():
    for end in ("<!-- <p>no</p>", "<!-- no", "<script>no('<p>')", "<script>no", "<style>a > b"):
        assert html.main_text(f"<html><body><p>One two three four five six</p>{end}", html.PLAIN_WEIGHTS) == "One two three four five six", end


def test_toxicity(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(400):
        bad = i % 8 == 0
        words = [rng.choice(WORDS) for _ in range(60)] + (["moron", "scum"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    rows += [(None, "scum"), (900, None), (901, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all(r.predicted == int(r.doc_id % 8 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items() if i is not None)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[None].predicted == 1 and out[900].predicted == 0
    assert all(r.score == 0 for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())


def test_toxic_words_with_common_beginnings(spark):
    """Seven examples whose beginnings many clean documents share outvote nobody, yet tell their kind apart."""
    rng, rows, marks, bad = random.Random(6), [], [], set()
    for g, n in ((0, 3), (1, 2), (2, 2), (3, 2), (4, 1)):
        bad |= set([i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == g][:n])
    clean = set(rng.sample(sorted(set(range(800)) - bad), 70))
    for i in range(800):
        words = [rng.choice(WORDS) for _ in range(20)] + ["achlimon"] * (20 if i in bad or i in clean else 0) + ["achlimor"] * (i in bad)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i in bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.score_toxicity(docs, labels).collect() if r.held_out]
    assert {r.doc_id for r in held if r.predicted} == {r.doc_id for r in held if r.doc_id in bad}


def test_nearest_of_many_agrees():
    rng = random.Random(3)
    examples = [{rng.choice("abcdef"): rng.randint(1, 2) for _ in range(rng.randint(0, 4))} for _ in range(300)]
    index = toxicity.BlockMaxIndex(examples, {t: 1.0 for t in "abcdef"})
    units = [index.vector(e) for e in examples[:90]]
    for unit, found in zip(units, toxicity.all_nearest(index, units, 25), strict=True):
        assert np.allclose([s for s, _ in found], [s for s, _ in index.nearest(unit, 25)], atol=1e-5)


def test_block_max_index_is_exact():
    rng = random.Random(2)
    terms = [f"t{i}" for i in range(30)]
    examples = [{rng.choice(terms): rng.randint(1, 4) for _ in range(rng.randint(0, 5))} for _ in range(500)]
    index = toxicity.BlockMaxIndex(examples, {t: 1 + i / 10 for i, t in enumerate(terms)})
    units = [index.vector(e) for e in examples]
    for q in units[:40]:
        scores = sorted(((-sum(x * u.get(t, 0) for t, x in q.items()), i) for i, u in enumerate(units)))
        want = [(-s, i) for s, i in scores if s < 0][:9]
        got = index.nearest(q, 9)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want]


def test_licenses(spark):
    known = dict(licenses.KNOWN)
    texts = [known["ISC"], "Copyright (c) 2020 A\n" + known["ISC"].replace("license", "licence").upper(), known["ISC"] + " extra", None, "", "(c) 2001 only"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.license_id for r in rows] == ["ISC", "ISC", None, None, None, None] and [r.matched for r in rows] == [True, True, False, False, False, False]


def test_license_lines_wrapped_anywhere(spark):
    """A line of a licence that begins with "copyright" is no line of rights holders."""
    wrapped = (licenses._MIT + licenses._MIT_AS_IS).replace("copyright notice", "\ncopyright notice").replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS")
    texts = ["MIT License\n\nCopyright (c) 2021 A. Person\nCopyright 2022 B\n\n" + wrapped, "© 2020 C\n" + wrapped]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.license_id for r in rows] == ["MIT", "MIT"]


def test_license_holders_without_a_year(spark):
    body = licenses._MIT + licenses._MIT_AS_IS
    wrapped = body.replace("copyright notice", "\ncopyright notice").replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS")
    heads = ["Copyright Jane Doe\n", "Copyright The X Authors\n\n", "MIT License\n\nCopyright Ünal & Söhne GmbH\nCopyright IBM Corp.\n", "The MIT License (MIT)\nCopyright Jane Doe <j@x.org>\nAll rights reserved.\n", "# Copyright A. Person and others\r\n\r\n"]
    texts = [h + t for h in heads for t in (body, wrapped)] + [wrapped, "Copyright Jane Doe\n", "Some words.\nmore words\nCopyright Jane Doe\n" + body]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.license_id for r in rows] == ["MIT"] * 11 + [None, None]


def test_whole_licenses_by_digest(spark):
    """The published texts, where the system has them, with other spellings, wraps and holders."""
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = {k: f"{folder}/{v}" for k, v in names.items() if os.path.exists(f"{folder}/{v}")}
    if not found:
        pytest.skip("no licence texts on this system")
    rows = []
    for k, path in found.items():
        with open(path, encoding="utf-8") as f:
            text = f.read()
        rows += [(k, text), (k, "Copyright 1999 Someone\n" + re.sub(r"\blicense\b", "licence", text).replace("\n", " \n\t").replace(".", " ."))]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(r.license_id == r.doc_id for r in got) and len(got) == len(rows)


def test_special_tokens_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(9)
    pieces = ["<|endoftext|>", "<|startoftext|>", "don't", "Über", "naïve", "3.14", "a,b;", "...", "x<|endoftext|>y", "漢字", "e\u0301", "\u00a0", "I'LL", "</w>", "it's!?", "\x1c", "ﬁ", "İ;", "ANKARİ,", "İİ.", "ΟΔΟΣ.", "ẞ!"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(200)] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in rows} == want


def colliding_texts():
    """Two texts of 4,096 bytes whose polynomial hashes modulo 2^64 are equal for any odd base: Thue-Morse words and their complements."""
    word = b"a"
    for _ in range(12):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    return [word.decode(), word.translate(bytes.maketrans(b"ab", b"ba")).decode()]


def test_whole_copies_are_told_by_digests(spark):
    rows = list(enumerate(colliding_texts()))
    want = collections.Counter(removed_bytes([t.encode() for _, t in rows], 400))
    got = collections.Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want


def test_candidates_of_rows_under_one_id_stay_apart(spark, monkeypatch):
    """Rows that share a null or repeated id get their own candidate lists, not those of all."""
    rng = random.Random(8)
    passage = [prose(rng, 40) for _ in range(60)]
    rows = [(None if i % 2 else 7, f"{prose(rng, 30)} {passage[i // 2]} {prose(rng, 30)}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = anchors.with_candidates
    monkeypatch.setattr(anchors, "with_candidates", lambda *a: (seen.append(plain(*a)), seen[-1])[1])
    out = passages.dedup_passages(docs).collect()
    assert len(out) == 120 and sum(r.n_removed > 0 for r in out) == 60
    lists = seen[0].select(F.size("anchors").alias("n")).collect()
    assert max(r.n for r in lists) < 60


def test_passages_shuffle_texts_once(spark, tmp_path):
    """The search for passages and the result share one shuffle of the texts (F1: two shuffles were over twice the input on disk)."""
    rng = random.Random(32)
    passage = prose(rng, 30)
    rows = [(i, f"{prose(rng, 60)} {passage}" if i % 2 else prose(rng, 60), f"{i % 3}") for i in range(400)] + [(None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/docs")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = passages.dedup_passages(spark.read.parquet(f"{tmp_path}/docs"), carry=("text", "lang"))
        got = {r.doc_id: r for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(got) == 401 and sum(r.n_removed >= 30 for r in got.values()) == 199
    assert got[None]._text is None and got[None].kept_text == "" and got[2]._text == rows[2][1] and got[5]._lang == "2"
    assert plan.split("== Initial Plan ==")[0].count("ReusedExchange") == 1


def test_signatures_of_random_sets_are_their_own():
    """No share of unrelated sets meets under a signature of all."""
    rng = np.random.default_rng(5)
    for num, den in ((85, 100), (4, 5)):
        scheme = jaccard.Scheme(num, den)
        for size in (12, 60, 200, 400, 1000):
            short = 0
            for _ in range(300):
                own = scheme.signatures(np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2)))
                i = scheme.reach(size)
                short += any(int(jaccard.mix64(np.array([c], np.uint64) ^ jaccard._B)[0]) >> 7 in (own >> np.uint64(7)).tolist() for c in (i, i - 1) if c >= 0)
            assert short == 0


def test_short_clean_texts_stay(spark):
    """Texts of 50 to 100 words drawn like the rest of their language aren't rejected for being short."""
    rng = random.Random(12)
    common = [w for w in quality.COMMON["en"] for _ in range(3)]
    line = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n))
    rows = [(i, line(rng.randint(50, 100)), "en") for i in range(150)] + [(1000 + i, line(500), "en") for i in range(100)] + [(5000, "$%& " * 200 + line(60), "en")]
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(r.kept for i, r in out.items() if i < 150) >= 149 and not out[5000].kept


def test_columns_with_any_name_come_back(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "a", "b", "c"), (2, "one two three four five six", "en", "d", "e", "f")], "doc_id long, text string, lang string, _rid string, th string, row string")
    assert [r._rid for r in jaccard.keep_one_a_group(docs).collect()] == ["a"] and jaccard.keep_one_a_group(docs).columns == docs.columns
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == 0


def test_near_copies_under_null_ids(spark):
    rng = random.Random(13)
    base = prose(rng, 80).split()
    rows = [(None, " ".join(base)), (None, " ".join([*base[:70], "new", *base[71:]])), (None, prose(rng, 80)), (None, ""), (None, None)]
    left = jaccard.keep_one_a_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(len((r.text or "").split()) for r in left) == [0, 80, 80]


def test_positions_decide(docs):
    """What the mix takes are the copies whose middle has a position; positions rise with the copy."""
    rows = mixing.positioned(docs).collect()
    taken = {(r.no_source, r.src, r.slice, r.nth): len(r.positions) for r in rows}
    assert all(r.positions == sorted(r.positions) and all(0 <= p < 1 for p in r.positions) for r in rows)
    copies = collections.Counter((r.no_source, r.src, r.slice, r.nth) for r in mixing.curriculum_mix(docs).collect())
    assert copies == collections.Counter({k: n for k, n in taken.items() if n})


@pytest.mark.parametrize(("page", "text"), [
    ('<article><p title="the hidden truth">One two</p><p hidden>no</p><p data-x="a>b" hidden>no</p></article>', "One two"),
    ('<article><div class="entry-header"><h1>Head</h1></div><p>One two</p><div class="social-share">no</div></article>', "Head\n\nOne two"),
    ('<article><p>One <math><mi>x</mi></math> two</p></article><div class="site-header">no</div>', "One x two"),
])
def test_html_attributes(page, text):
    assert html.main_text(f"<html><body>{page}</body></html>", {"word": 0.5, "linked": -1.0, "div": 0.0, "/div": 0.0, "h1": 0.3, "/h1": 0.3, "p": 0.3, "/p": 0.3, "/article": 0.0}) == text


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    frames = [quality.quality(none), suffixes.dedup_bytes(none), mixing.curriculum_mix(none), packing.pack_documents(none), jaccard.jaccard_components(none), passages.dedup_passages(none), licenses.scan_licenses(none)]
    frames += [vectors.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0), html.extract(spark.createDataFrame([], "page_id long, url string, html string"))]
    frames.append(toxicity.score_toxicity(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline_of_nothing(spark, docs):
    import corpus_pipeline

    table = docs.select(*corpus_pipeline.COLUMNS).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, "")
        assert table.count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    table = docs.select(*corpus_pipeline.COLUMNS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        table = stage(spark, table, "")
        if k < 4:
            assert table.columns == corpus_pipeline.COLUMNS
    # Near copies keep one document, and no passage of 13 words is left twice before the mix.
    kept = corpus_pipeline.quality_rules(spark, docs.select(*corpus_pipeline.COLUMNS), "")
    one = corpus_pipeline.ngram_jaccard_join(spark, kept, "")
    assert sum(r.doc_id in (0, 1, 2, 3, None) for r in one.collect()) == 1
    seen = collections.Counter()
    for r in corpus_pipeline.substring_dedup(spark, one, "").collect():
        w = split(r.text)
        seen.update({tuple(w[i : i + 13]) for i in range(len(w) - 12)})
    assert max(seen.values()) == 1
    assert table.count() > 0 and hashlib.sha256(b"").hexdigest()


def test_sequences_keep_the_order_of_positions(spark, tmp_path):
    """Documents written in the order of their positions share sequences with their neighbours; the mean position rises with the sequence."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(5, 400)), ["a", "b", "c"][i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mixing.curriculum_mix(docs, carry=("text",)).select("doc_id", F.col("_text").alias("text"), "position").write.parquet(str(tmp_path / "mix"))
    mix = spark.read.parquet(str(tmp_path / "mix"))
    placed = mix.select(F.col("doc_id"), "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # One row of the mix by its place: copies of a document have places of their own.
    by_place = {k: r.position for k, r in enumerate(mix.select("position", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect())}
    assert [by_place[k] for k in sorted(by_place)] == sorted(by_place.values()) and len(by_place) > 300
    positions = collections.defaultdict(list)
    for r in mix.collect():
        positions[r.doc_id].append(r.position)
    single = {d: p[0] for d, p in positions.items() if len(p) == 1}
    packed = packing.pack_documents(placed, shard_rows=60, order=("_file", "_row")).collect()
    shards = collections.defaultdict(list)
    for r in packed:
        if r.doc_id in single:
            shards[r.sequence_id >> 40].append(single[r.doc_id])
    ranges = [(min(p), max(p)) for _, p in sorted(shards.items())]
    assert len(ranges) > 3 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    # The stage of the pipeline takes the order from the table's files, and needs none.
    key = lambda frame: grouped(frame.select("doc_id", "piece", "start", "length", "ids_crc32"))
    assert key(corpus_pipeline.best_fit_packing(spark, mix, "")) == key(packing.pack_documents(mix)) == key(packing.pack_documents(placed, shard_rows=60, order=("_file", "_row")))
