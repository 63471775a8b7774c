"""Line dedup, conversation repair and periodic runs against brute force, with every odd case."""

import collections
import fractions
import hashlib
import itertools
import random
import re
import zlib

import pytest

from sourcegrain.llm import lines, periodic, repair
from sourcegrain.llm.queries import planted_tail

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCS = "doc_id long, text string, source string, th string, gone string, place long, h1 int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_rows():
    rng = random.Random(3)
    shared = ["Subscribe to our newsletter for a weekly digest of news", "Éa long line whose first letter isn't ASCII, repeated often", "x" * 39, "y" * 40, "漢" * 40]
    rows = []
    for i in range(40):
        parts = [f"own line {i} {rng.random()} and some more words to be long" for _ in range(rng.randrange(3))]
        parts += [rng.choice([s, s.upper(), f"  {s}\t", f"\x0b{s}\r"]) for s in shared if rng.random() < 0.5] * rng.choice([1, 1, 2])
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "\n" + shared[3] + "\n"), (None, shared[3]), (None, shared[3] + "\nrest"), (53, shared[3]), (53, "\n" + shared[3] + "\n"), (54, "z" * 50 + "\n" + "\n".join(["z" * 50] * 3000))]
    rows += [(i, "z" * 50) for i in (-5, 60, 61, 62)]
    rows += [(None, "only null ids hold this line, which is a long one")] * 5
    return [(*r, "s", "t", "g", 1, 2) for r in rows]


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(BLANKS).translate(str.maketrans(UPPER, LOWER))
    holders = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(doc_id)
    rank = lambda d: float("-inf") if d is None else d
    keeper = {k: max(map(rank, d)) for k, d in holders.items() if len(d) >= min_docs}
    for doc_id, text, *_ in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if keeper.get(key(x), rank(doc_id)) == rank(doc_id)]
        yield doc_id, len(all_), len(all_) - len(kept), "\n".join(kept)


def test_line_dedup(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = lines.dedup_lines(docs, carry=("source", "th"))
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_text", "_source", "_th"]
    got = collections.Counter(tuple(r)[:4] for r in found.collect())
    want = collections.Counter(brute_lines(rows))
    assert got == want and sum(k[2] for k in want) > 50
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def grammar(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def begins(roles):
    return re.fullmatch("s?(ua)*u?", roles) is not None


def brute_repair(rows):
    """The cheapest (cost, audit) of all edits of (initial, must go, truncated), up to three rows inserted in a place."""
    fills = ["".join(f) for n in range(4) for f in itertools.product("ua", repeat=n)]
    options = []
    for initial, must_go, truncated in rows:
        own = [("D", 4, "")]
        if not must_go:
            own += [("K", 3 * truncated, initial or "?"), ("R", 3 + 3 * truncated, "u"), ("R", 3 + 3 * truncated, "a")]
        options += [[("I" * len(f), 3 * len(f), f) for f in fills], own]
    options.append([("I" * len(f), 3 * len(f), f) for f in fills])
    best = {"": (0, "")}  # the cheapest by what was built so far
    for choices in options:
        ahead = {}
        for roles, (cost, audit) in best.items():
            for a, c, r in choices:
                if begins(roles + r) and len(roles + r) <= len(rows) + 4 and (roles + r not in ahead or (cost + c, audit + a) < ahead[roles + r]):
                    ahead[roles + r] = (cost + c, audit + a)
        best = ahead
    return min(x for roles, x in best.items() if grammar(roles))


def written(rows, audit):
    """The text that an audit tells."""
    out, rest = [], list(rows)
    for letter in audit:
        if letter == "I":
            out.append([None, ""])
            continue
        role, text = rest.pop(0)
        if letter != "D":
            out.append([role if letter == "K" else None, text])
    led = bool(out) and bool(out[0][0]) and out[0][0].startswith("s")
    return "\n".join(f"{role or ('assistant' if (i - led) % 2 else 'user')}:{text}" for i, (role, text) in enumerate(out))


def test_repair_of_all_short_conversations():
    kinds = [(i, *f) for i in ("s", "u", "a", "t", "") for f in ((False, False), (False, True))] + [("u", True, False)]
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool", "": ""}
    rng = random.Random(1)
    for rows in [r for n in range(3) for r in itertools.product(kinds, repeat=n)] + [[rng.choice(kinds) for _ in range(rng.randrange(3, 6))] for _ in range(150)]:
        one = repair.Repair()
        for k, (initial, must_go, truncated) in enumerate(rows):
            one.add(names[initial], f"text {k}", must_go, truncated)
        cost, audit, digest = one.end()
        assert (cost, audit) == brute_repair(rows), rows
        assert digest == sha(written([(names[i], f"text {k}") for k, (i, *_) in enumerate(rows)], audit))


def test_merged_tops_go_on_alike():
    """What is below a top decides nothing that comes after it, so the cheapest of equal tops is enough."""
    seen, todo = set(), [(0,)]
    while todo:
        stack = todo.pop()
        if stack not in seen:
            seen.add(stack)
            todo += [to for i in "sua" if (to := repair.shift(stack, i))]
    tops = collections.defaultdict(set)
    for stack in seen:
        texts = frozenset(t for n in range(7) for t in map("".join, itertools.product("sua", repeat=n)) if ends(stack, t))
        tops[stack[-1]].add(texts)
    assert all(len(t) == 1 for t in tops.values()) and len(seen) <= 8


def ends(stack, text):
    for i in text:
        stack = repair.shift(stack, i)
        if stack is None:
            return False
    return stack[-1] in repair.ENDS


def conversation_rows():
    rng = random.Random(9)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", None])
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), role, rng.choice(["Hello.", "Hello", "What is it?", " \t", "", None, "Yes!\n ", "é…", "one. two"])))
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), (200, None, "user", "a."), (200, None, "user", "a."), (200, 3, "assistant", "b."), (201, 0, "user", "x. " * 30_000)]
    rows += [(202, t, ("user", "assistant")[t % 2], f"word {t}.") for t in range(2000)]
    rows += [rows[0], rows[0]]
    return [(*r, "c", 1) for r in rows]


def brute_conversations(rows):
    found = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        found[conv] += [] if k == 0 else [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, after in found.items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in after:
            solid = text.strip(BLANKS)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in after} - {None}
        initials = [r[1][:1] for r in after]
        one = brute_repair([(i if i in ("s", "u", "a") else "", f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)]) if len(after) < 12 else None
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, one, [r[1:] for r in after]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string, k string, gone int").repartition(4)


def test_conversations(conversations):
    got = {r.conv_id: r for r in repair.repair_conversations(repair.damaged(conversations)).collect()}
    want = list(brute_conversations(conversation_rows()))
    assert len(got) == len(want)
    for conv, *numbers, one, after in want:
        r = got[conv]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal] == numbers, conv
        assert one is None or (r.cost, r.audit) == one, conv
        assert r.repaired_sha256 == sha(written(after, r.audit)), conv
    assert any(not after for *_, after in want) and sum(r.duplicate for r in got.values()) > 5
    assert repair.repair_conversations(repair.damaged(conversations.limit(0))).count() == 0


def test_repaired_rows(conversations):
    rows = repair.damaged(conversations)
    texts = collections.defaultdict(dict)
    for r in repair.repaired_rows(rows).collect():
        assert r.place not in texts[r.conv_id] and (r.nth is None) == (r.action == "insert")
        texts[r.conv_id][r.place] = f"{r.role}:{r.text}"
    for r in repair.repair_conversations(rows).collect():
        assert r.repaired_sha256 == sha("\n".join(t for _, t in sorted(texts[r.conv_id].items())))
        assert grammar("".join(t[:1] for _, t in sorted(texts[r.conv_id].items())))


def brute_runs(words, least=24, times=3):
    found = []
    for q in range(1, len(words) // times + 1):
        start = 0
        while start < len(words) - q:
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if end > start and length >= max(least, times * q):
                run = words[start : start + length]
                if all(any(run[i] != run[i + d] for i in range(length - d)) for d in range(1, q)):
                    found.append((start, length, q))
            start = max(end, start) + 1
    return sorted(found)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (1, 2), (2, 3)])
def test_runs_of_all_kinds_of_sequences(least, times):
    rng = random.Random(least)
    fibonacci, older = [0, 1], [0]
    while len(fibonacci) < 150:
        fibonacci, older = fibonacci + older, fibonacci
    cases = [[], [0], [0] * 60, [0, 1] * 40, fibonacci, [0, 1, 2] * 9 + [0, 1, 3] * 9]
    cases += [list(s) for n in range(8) for s in itertools.product(range(2), repeat=n)]
    for _ in range(150):
        words = []
        while len(words) < 120:
            part = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            words += (part * rng.choice([1, 1, 4, 9]))[: rng.randrange(1, 60)]
        cases.append(words)
    for words in cases:
        assert periodic.runs_of(words, least, times) == brute_runs(words, least, times), words


def test_long_runs_take_few_steps():
    assert periodic.runs_of([0] * 60_000) == [(0, 60_000, 1)]
    assert periodic.runs_of(list(range(7_000)) * 6) == [(0, 42_000, 7_000)]


def run_rows():
    rng = random.Random(4)
    texts = [None, "", " \n", "a " * 23, "a " * 24, "a\tb\x0b" * 12, "x " + "a b " * 20 + "a a " * 30, "é ü " * 30, "one two three four five six seven eight " * 3, "same line of words\n" * 2 + "other " * 30]
    for i in range(60):
        words = []
        while len(words) < rng.randrange(20, 400):
            part = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 30))]
            words += part * rng.choice([1, 1, 1, 2, 3, 5])
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    texts += ["a" * 50_000 + " b c" * 3_000, texts[-1], texts[-1]]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "q " * 40), (3, "p q r " * 33)] * 2
    return [(*r, "s", "t", "g", 1, 2) for r in rows]


def test_periodic_runs(spark):
    rows = run_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want, planted = collections.Counter(), 0
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tail = planted_tail(doc_id, len(words))
        if tail:
            a, p = tail
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-fractions.Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want[doc_id, len(words), tuple(runs), best, " ".join(w for i, w in enumerate(words) if i not in gone)] += 1
    found = periodic.periodic_runs(docs, planted_tail).collect()
    assert collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.strongest and tuple(r.strongest), r.kept_text) for r in found) == want
    assert planted > 3 and sum(bool(k[2]) for k in want) > 20
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_planted_tail():
    h = zlib.crc32(b"25")
    hits = [d for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0]
    assert planted_tail(hits[0], 100) == (zlib.crc32(str(hits[0]).encode()) // 10 % 100, 1 + (100 - zlib.crc32(str(hits[0]).encode()) // 10 % 100) // (3 + zlib.crc32(str(hits[0]).encode()) // 10 % 8))
    assert planted_tail(None, 10) is None and planted_tail(hits[0], 0) is None and (h % 10 == 0) == (planted_tail(25, 5) is not None)
