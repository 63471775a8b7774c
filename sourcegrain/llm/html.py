"""Main-text extraction by maximum-scoring subsequence.

A page is a sequence of tokens: words and tags. Each kind of token has a
weight, its log odds of lying in the content of labelled pages; the content
region is the contiguous run with the largest sum, found by one linear scan.
Labelled pages are those that mark their content with <article> or <main>;
a bounded sample of them is read. Inside the region, elements that are
boilerplate by tag, class, id or role are left out.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Pages whose markup is read as labels, at most.
LABELLED_PAGES = 2_000

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
#: Each attribute in turn, with its value, if any, so that nothing inside a quoted value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Fixed values of the HTML language.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never content.
DROPPED = frozenset("head title nav footer aside button menu dialog label fieldset object embed applet canvas audio video".split())
#: Words in class, id or role that name boilerplate.
DROPPED_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright disqus footer header masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promoted related replies respond search share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget widgets complementary alert".split()
)
#: Names that inside an article name parts of it (its headline, its summary box).
OWN_NAMES = frozenset("header masthead banner".split())
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


#: What an element is left out by: a rule of the language, or a name (or being a form), which its content can overrule.
BY_RULE, BY_NAME = 1, 2


#: Words that with a name of boilerplate name a part of a page, not what a text is about ("ad-box", unlike "related-work").
STRUCTURE_NAMES = frozenset(
    "area aside bar block body bottom box btn button buttons card center col column container content cta entry feed form global group holder icons in inline inner item items js left link links list main menu page panel post posts reply right "
    "row rows section site slot small story text thread title top unit widget wrap wrapper".split()
)


def _names_boilerplate(value: str, in_content: bool) -> bool:
    """Whether a class, id or role names boilerplate: anywhere in it, or inside an article only by a name all of whose parts do or are parts of pages."""
    if not in_content:
        return not DROPPED_NAMES.isdisjoint(p.lower() for p in _NAME_PARTS.findall(value))
    for name in value.split():
        parts = {p.lower() for p in _NAME_PARTS.findall(name) if not p.isdigit()}
        own = parts & DROPPED_NAMES
        if own and not own & OWN_NAMES and parts <= DROPPED_NAMES | STRUCTURE_NAMES:
            return True
    return False


def _dropped(tag: str, attributes: str, in_content: bool, in_quote: bool) -> int:
    if tag in DROPPED and not (tag == "footer" and in_quote) or tag == "header" and not in_content:
        return BY_RULE
    found = BY_NAME if tag == "form" else 0
    if not attributes:
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "")
        if name in ("class", "id", "role"):
            if tag not in ("html", "body", "article", "main") and _names_boilerplate(value, in_content):
                found = BY_NAME
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return BY_RULE
    return found


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, text, dropped, content) in page order. kind: a tag as "p" or "/p", "word" or
    "linked" for a run of text (linked: inside <a>), with the run's text; content: inside <article> or <main>.

    Where all <article> and <main> stand in elements that a name or a form drops, those around
    the first stay. A form that holds most words of the content stays; without marked content,
    so does any element with a name that holds most of the page's words."""
    out, named = _scan(page, frozenset())
    if not named:
        return out
    marks = [i for i, t in enumerate(out) if t[0] in ("article", "main")]
    words = [0]
    for kind, run, by_rule, content in _scan(page, frozenset(named))[0]:
        words.append(words[-1] + (len(run.split()) if kind in ("word", "linked") and not by_rule and (content or not marks) else 0))
    inside = lambda i: any(a < i < z for a, z in named.values())
    first = marks[0] if marks and all(map(inside, marks)) else -1
    kept = frozenset(at for at, (a, z) in named.items() if a < first < z or (not marks or out[a][0] == "form") and 2 * (words[z] - words[a]) > words[-1])
    return _scan(page, kept)[0] if kept else out


def _scan(page: str, kept: frozenset[int]) -> tuple[list[tuple[str, str, bool, bool]], dict[int, tuple[int, int]]]:
    """tokens, and the first and last token of each element dropped by name, by its place in the page; those at `kept` are not dropped."""
    out, stack, last, named = [], [], 0, {}
    dropped = content = links = quotes = 0
    open_now: Counter[str] = Counter()  # elements on the stack by tag: a close without its tag there is passed over at once

    def text(run: str) -> None:
        if run and not run.isspace():
            out.append(("linked" if links else "word", run, dropped > 0, content > 0))
        elif run:
            out.append(("space", run, dropped > 0, content > 0))

    # Nothing after the last ">" is a tag; looking for one there would start anew at every "<".
    end = page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, end):
        text(page[last : m.start()])
        last = m.end()
        if last == end and (m.group("raw") and not re.search(r"</\w+\s*>\Z", m.group()) or m.group().startswith("<!--") and not m.group().endswith("-->")):
            last = len(page)
        tag = (m.group("tag") or "").lower()
        if not tag:
            continue
        if not m.group("close"):
            by = _dropped(tag, m.group("attributes"), content > 0, quotes > 0)
            drop = by == BY_RULE or by == BY_NAME and m.start() not in kept
            out.append((tag, "", dropped > 0 or drop, content > 0 or tag in ("article", "main")))
            if tag in VOID or m.group("attributes").endswith("/"):
                continue
            if tag == "p" and stack and stack[-1][0] == "p":
                old = stack.pop()
                open_now["p"] -= 1
                dropped -= old[1]
                if old[2] in named:
                    named[old[2]] = (named[old[2]][0], len(out) - 1)
            stack.append((tag, int(drop), m.start()))
            open_now[tag] += 1
            quotes += tag == "blockquote"
            if drop and by == BY_NAME:
                named[m.start()] = (len(out) - 1, -1)
            dropped += drop
            content += tag in ("article", "main")
            links += tag == "a"
        else:
            out.append((f"/{tag}", "", dropped > 0, content > 0))
            if not open_now[tag]:
                continue
            depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
            for old, drop, at in stack[depth:]:
                if at in named:
                    named[at] = (named[at][0], len(out))
                dropped -= drop
                content -= old in ("article", "main")
                links -= old == "a"
                quotes -= old == "blockquote"
                open_now[old] -= 1
            del stack[depth:]
    rest = page[last:]
    text(rest[: rest.index("<!--")] if "<!--" in rest else rest)
    return out, {at: (a, z if z >= 0 else len(out)) for at, (a, z) in named.items()}


def kind_counts(page: str) -> dict[str, list[int]]:
    """Tokens of each kind outside and inside the marked content; none where no content is marked."""
    counts: dict[str, list[int]] = {}
    parts = tokens(page)
    if not any(content for _, _, _, content in parts):
        return {}
    for kind, run, _, content in parts:
        if kind != "space":
            name = kind if kind in ("word", "linked") or kind.lstrip("/") in BLOCKS or kind.lstrip("/") in VOID or kind.lstrip("/") in ("a", "b", "i", "em", "strong", "span") else "other"
            counts.setdefault(name, [0, 0])[content] += len(run.split()) if run else 1
    return counts


#: Weights where no page marks its content.
PLAIN_WEIGHTS = {"word": 1.0, "linked": -1.0}
TAG_WEIGHT = -1.5


def learn_weights(pages: DataFrame, limit: int = LABELLED_PAGES) -> dict[str, float]:
    """Log odds by kind of token over at most `limit` pages, the first by hash of page_id."""
    chosen = pages.select("page_id").filter(F.col("page_id").isNotNull()).distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(limit)
    sample = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *v) for page in batch.column("html").to_pylist() for k, v in kind_counts(page or "").items()]
            kinds, outside, inside = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(outside, pa.int64()), pa.array(inside, pa.int64())], ["kind", "outside", "inside"])

    # One row per kind of token: the kinds are those of the HTML language.
    counts = sample.select("html").mapInArrow(count, "kind string, outside long, inside long").groupBy("kind").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside")).collect()
    if not counts:
        return dict(PLAIN_WEIGHTS)
    n_out, n_in = sum(r.outside for r in counts) + len(counts), sum(r.inside for r in counts) + len(counts)
    weights = {r.kind: math.log((r.inside + 1) / n_in) - math.log((r.outside + 1) / n_out) for r in counts}
    # A word counts for content and a closing or opening structural tag against it, however rare the other.
    weights["word"] = max(weights.get("word", 0.0), 0.25)
    return weights


_HEADINGS = frozenset(("h1", "h2", "h3"))


def _with_heading(parts: list[tuple[str, str, bool, bool]], start: int) -> int:
    """start, or where the heading begins that stands right above it: few words between many tags, which a sum of weights leaves out."""
    i, words = start - 1, False
    while i >= 0 and not parts[i][2]:
        kind = parts[i][0]
        if kind in ("word", "linked"):
            if not words:
                break  # text that is no heading
        elif kind.startswith("/") and kind[1:] in _HEADINGS:
            words = True
        elif kind in _HEADINGS and words:
            return i
        elif kind.lstrip("/") in BLOCKS and words:
            break
        i -= 1
    return start


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best region, joined by two line feeds."""
    parts = tokens(page)
    best = total = 0.0
    start = region_start = region_end = 0
    for i, (kind, run, dropped, _) in enumerate(parts):
        if kind == "space":
            continue
        total += weights.get(kind, TAG_WEIGHT) * (len(run.split()) if run else 1)
        if dropped and run:
            total -= len(run.split())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region_start, region_end = total, start, i + 1
    # The region's edges are moved out to the ends of the blocks they lie in.
    edge = lambda i: parts[i][0].lstrip("/") in BLOCKS
    while region_start > 0 and region_end and not edge(region_start - 1):
        region_start -= 1
    while region_end < len(parts) and not edge(region_end):
        region_end += 1
    if region_end:
        region_start = _with_heading(parts, region_start)
    blocks, block = [], []
    for kind, run, dropped, _ in parts[region_start:region_end]:
        if run:
            if not dropped:
                block.append(run)
        elif kind.lstrip("/") in BLOCKS:
            blocks.append(block)
            block = []
        elif kind in ("br", "wbr"):
            block.append(" " if kind == "br" else "")
    texts = [" ".join(entities.unescape("".join(b)).split()) for b in [*blocks, block]]
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, limit: int = LABELLED_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, one row per row of pages.

    Null or empty html: empty text. Broken markup is read as far as it goes:
    unclosed comments and scripts run to the end, unknown tags are inline.
    Repeated rows are extracted alike. Very long pages take linear time. Other
    columns are not read. Empty pages: no rows.
    """
    weights = learn_weights(pages, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(page or "", weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
