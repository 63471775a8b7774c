"""Scanning of source text in one pass: what is code, which brackets belong together, what statements govern.

Positions and matching brackets are what regular expressions over a column
can't give in linear time, so bodies go through one Arrow function, a batch at
a time; what is made of the facts are column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments and literals, the longest form first; what isn't closed runs to the end of the text, or of its line.
_LITERAL = re.compile(
    r"//[^\n]*+"
    r"|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
    r"|(?P<raw>\$*+(?P<quotes>\"{3,})(?:.*?(?P=quotes)|.*))"
    r"|(?P<cpp>\bR\"(?P<mark>[^()\\\s]{0,16})\((?:.*?\)(?P=mark)\"|.*))"
    r"|(?P<holes>\$\"(?:\\.|\{\{|\{(?:[^{}\"\n]|\"(?:\\.|[^\"\\\n])*+\")*+\}|[^\"\\\n])*+\"?)"
    r"|(?P<holes2>(?:\$@|@\$)\"(?:\"\"|\{\{|\{[^{}]*+\}|[^\"])*+\"?)"
    r"|@\"(?:\"\"|[^\"])*+\"?"
    r"|\"(?:\\.|[^\"\\\n])*+\"?"
    r"|'(?:\\[^\n][^'\n]{0,9}|[^'\\\n])'"
    r"|\d(?:'?\w)*+|\w++",
    re.S,
)
_SEEN = re.compile(r"[^\n]")
_HOLE = re.compile(r"\{\{|\}\}|\{((?:[^{}\"]|\"(?:\\.|[^\"\\])*+\")*+)\}")


def masked(text: str) -> str:
    """text with blanks for comments and for what is inside literals, of the same length; code in the holes of interpolated strings stays."""

    def blank(m: re.Match) -> str:
        token = m.group()
        first = token[0]
        if first.isalnum() and not m.group("cpp") or first == "_":
            return token
        if m.group("holes") or m.group("holes2"):
            out, last = [], 0
            for hole in _HOLE.finditer(token):
                if hole.group(1) is not None:
                    out += [_SEEN.sub(" ", token[last : hole.start(1)]), masked(hole.group(1))]
                    last = hole.end(1)
            return '"' + "".join([*out, _SEEN.sub(" ", token[last:])])[1:-1] + '"' if len(token) > 1 else token
        if first == "/":
            return _SEEN.sub(" ", token)
        begun = re.search("[\"']", token).end()
        shut = len(token) - 1 if len(token) > begun and token[-1] == token[begun - 1] else len(token)
        return token[:begun] + _SEEN.sub(" ", token[begun:shut]) + token[shut:]

    return _LITERAL.sub(blank, text)


_MARK = re.compile(r"[()\[\]{};]")
_PAIRS = {")": "(", "]": "[", "}": "{"}


class Nesting:
    """The matching close of every bracket, and what stands in which one, of a text."""

    def __init__(self, code: str):
        self.code, self.close, self.open = code, {}, {}
        #: Places of brackets and the innermost open one (-1: none) from there on; semicolons by the bracket they stand in.
        self.places, self.inside, self.semicolons = [-1], [-1], {-1: []}
        stack, open_now = [], {"(": 0, "[": 0, "{": 0}
        for m in _MARK.finditer(code):
            at, sign = m.start(), m.group()
            if sign == ";":
                self.semicolons.setdefault(stack[-1] if stack else -1, []).append(at)
                continue
            if sign in "([{":
                stack.append(at)
                open_now[sign] += 1
            elif open_now[_PAIRS[sign]]:
                while True:  # brackets that were never closed end with the one around them
                    begun = stack.pop()
                    open_now[code[begun]] -= 1
                    self.close[begun] = at
                    if code[begun] == _PAIRS[sign]:
                        break
                self.open[at] = begun
            self.places.append(at)
            self.inside.append(stack[-1] if stack else -1)
        for begun in stack:
            self.close[begun] = len(code)

    def around(self, at: int) -> int:
        """The innermost bracket around a place; -1: none."""
        return self.inside[bisect_left(self.places, at) - 1]

    def ends(self, at: int) -> int:
        """Where the simple statement at a place ends: its semicolon, or the bracket around it."""
        around = self.around(at)
        found = self.semicolons.get(around, [])
        k = bisect_left(found, at)
        return found[k] if k < len(found) else self.close.get(around, len(self.code))

    def flat(self, start: int, end: int) -> str:
        """The text between two places with blanks inside its brackets."""
        out, at = [], start
        while at < end:
            m = _OPEN.search(self.code, at, end)
            if not m:
                break
            shut = min(self.close[m.start()], end)
            out += [self.code[at : m.end()], " " * (shut - m.end())]
            at = shut
        return "".join([*out, self.code[at:end]])


_OPEN = re.compile(r"[(\[{]")
_SOLID = re.compile(r"\S")
_HEADED = re.compile(r"(if|foreach|for|while|using|lock|fixed|switch)\s*\(")
_ELSE, _CLAUSE, _WHEN = re.compile(r"\s*else\b"), re.compile(r"\s*(catch|finally)\s*"), re.compile(r"\s*when\s*(?=\()")
_TRY = re.compile(r"try\s*(?=\{)")


def _clauses(n: Nesting, end: int) -> list[tuple[str, int, int]]:
    """(catch or finally, start, end) of the blocks after that of a try, which ends at `end`."""
    out = []
    while m := _CLAUSE.match(n.code, end + 1):
        at = m.end()
        for _ in range(2):  # what is caught, and when
            if n.code[at : at + 1] == "(":
                at = n.close[at] + 1
                w = _WHEN.match(n.code, at) or re.compile(r"\s*").match(n.code, at)
                at = w.end()
        if n.code[at : at + 1] != "{":
            break
        end = n.close[at]
        out.append((m.group(1), at, end))
    return out


_DO, _TAIL = re.compile(r"do\b"), re.compile(r"\s*while\s*(?=\()")


def _statement_end(n: Nesting, at: int, ends: dict[int, int]) -> int:
    """Where the statement that begins at or after a place ends. ends: the ends of statements that are known, by their
    places; asked from the last statement to the first, each takes constant time."""
    code, heads = n.code, []
    while True:
        m = _SOLID.search(code, at)
        if not m:
            end = len(code)
            break
        at = m.start()
        if at in ends:
            end = ends[at]
            break
        head = _HEADED.match(code, at)
        if not head:
            if _DO.match(code, at):
                end = _statement_end(n, at + 2, ends)
                if tail := _TAIL.match(code, end + 1):
                    end = n.ends(n.close[tail.end()] + 1)
            elif tried := _TRY.match(code, at):
                end = n.close[tried.end()]
                end = ([end] + [z for _, _, z in _clauses(n, end)])[-1]
            else:
                end = n.close[at] if code[at] == "{" else n.ends(at)
            ends[at] = end
            break
        heads.append((at, head.group(1)))
        at = n.close[head.end() - 1] + 1
    for begun, word in reversed(heads):
        follows = _ELSE.match(code, end + 1) if word == "if" else None
        if follows:
            end = _statement_end(n, follows.end(), ends)
        ends[begun] = end
    return end


_WORDS = re.compile(r"\b(?:if|foreach|for|while|do|try|return|throw)\b")
#: Arguments of types are read up to so many characters.
_TYPE = r"[A-Za-z_][\w.:]*+(?:\s*<[^;=(){}]{0,200}>)?(?:\s*\[[\s,]*\])*\??"
_LOCAL = re.compile(r"(?<![\w.:])(?:(?:await\s+)?using\s+(?!\()|const\s+|ref\s+)?(" + _TYPE + r")\s+([A-Za-z_]\w*)\s*(?=[=;,](?!=))")
_SET = re.compile(r"(?<![=!<>+\-*/%&|^?])(\+|-|\*|/|%|&|\||\^|<<|>>|\?\?)?=(?![=>])")
_NAMED = re.compile(r"([A-Za-z_]\w*)\s*$")
_STEP = re.compile(r"(?:(?<![\w.])|(?<=[)\]]\.))([A-Za-z_][\w.]*+)\s*+(?:\+\+|--)|(?<=\+\+|--)\s*+([A-Za-z_][\w.]*+)")
_CALL = re.compile(r"\b([A-Za-z_]\w*+)\s*+(<[\w\s,.?\[\]]{0,200}>)?\s*+\(")
_GENERIC = re.compile(r"(?<=\w)<[\w\s,.?\[\]<>]{0,200}>(?=\s*[({])")
_BINARY = re.compile(r"[\w)\]\"'}]\s*(?:\+(?!\+)|-(?!-)|\*|/|%|&&?|\|\|?|\^|<<|>>|[<>]=?|[=!]=|\?\?)\s*[\w(\"'!~+\-@$]|\sas\s+\w|\sis\s+(?!not\b|null\b|true\b|false\b)[A-Za-z_][\w.]*\s*$")
_INVOKED = re.compile(r"(?!(?:new|await|typeof|default|sizeof|checked|unchecked|stackalloc)\b)(?:[A-Za-z_@(\"].*)?[\w>\])]\s*\(\s*\)$", re.S)
_CAST = re.compile(r"\(\s*\)\s*[\w\"(]")
_CONDITIONAL = re.compile(r"(?<!\?)\?(?![?.\[])")
#: Words of the language that are neither types nor names.
_RESERVED = frozenset("return throw else new await goto case yield in is as out ref when and or not do if for foreach while switch catch using lock fixed typeof default sizeof checked unchecked stackalloc var const this base true false null params".split())
_BEFORE_NAME = re.compile(r"([A-Za-z_]\w*|[>\]?])\s+$")
_AFTER = frozenset("{};)")


def _starts(code: str, at: int) -> bool:
    """Whether a statement can begin at a place."""
    before = code[:at].rstrip() if at < 64 else code[at - 64 : at].rstrip()
    return not before or before[-1] in _AFTER or before.endswith(("else", "do")) or before[-1] == ":" and not before.endswith("::")


def _declares(code: str, at: int) -> bool:
    """Whether a type stands before the name at a place."""
    m = _BEFORE_NAME.search(code, max(0, at - 80), at)
    return bool(m) and (m.group(1) in ">]?" or m.group(1) not in _RESERVED or m.group(1) == "var")


def _chain(n: Nesting, at: int) -> int:
    """Where the chain of names, calls and indexes begins whose last name is at a place."""
    code = n.code
    while True:
        k = at - 1
        while k >= 0 and code[k].isspace():
            k -= 1
        if k < 0 or code[k] != ".":
            return at
        k -= 1
        while k >= 0 and (code[k].isspace() or code[k] in "?!"):
            k -= 1
        while k >= 0 and code[k] in ")]":  # what is called or indexed
            k = n.open.get(k, 0) - 1
            while k >= 0 and code[k].isspace():
                k -= 1
        end = k + 1
        while k >= 0 and (code[k].isalnum() or code[k] in "_\"@"):
            k -= 1
        if k + 1 == end and at == end:
            return at
        at = k + 1


def _indexed(n: Nesting, at: int) -> int:
    """Where what is indexed right before a place begins."""
    k = at - 1
    while k >= 0 and n.code[k].isspace():
        k -= 1
    if k >= 0 and n.code[k] == "]" and k in n.open and (m := _NAMED.search(n.code, max(0, n.open[k] - 200), n.open[k])):
        return _chain(n, m.start())
    return at


def _shape(n: Nesting, start: int, end: int) -> str:
    """binary, invocation or nothing: what the expression between two places is, outside its brackets."""
    flat = _GENERIC.sub("", n.flat(start, end))
    flat = re.sub(r"([(\[{])\s+(?=[)\]}])", r"\1", flat).split(",")[0].strip()
    if _CONDITIONAL.search(flat) or "=>" in flat or _SET.search(flat):
        return ""
    if _BINARY.search(flat):
        return "binary"
    return "invocation" if _INVOKED.match(flat) and "?." not in flat and not _CAST.match(flat) else ""


def csharp_facts(text: str) -> list[dict]:
    """What a C# body does, in the order of its text, outer before inner: pos, kind, a, b, flag.

    kind: if (whose statement throws; a: condition, b: the same with blanks in its brackets), foreach (a: what it runs over), for, while
    (flag: a loop stands in it), try (flag: one of its catches throws), local (a: name), set (a: target, b: operator, flag: it computes),
    step (a: name), call (a: receiver, b: name, flag: of a member), return (a: the name it returns, if that is all)."""
    n = Nesting(masked(text))
    code, out = n.code, []
    words = [(m.start(), m.group()) for m in _WORDS.finditer(code)]
    ends: dict[int, int] = {}
    tails = set()  # the "while" of a do
    for at, word in reversed(words):
        if word == "do" and (m := _SOLID.search(code, _statement_end(n, at + 2, ends) + 1)):
            tails.add(m.start())
        elif word in ("if", "foreach", "for", "while"):
            _statement_end(n, at, ends)
    loops = [at for at, word in words if word in ("foreach", "for", "while") and at not in tails]
    ifs = [at for at, word in words if word == "if"]
    throws = [at for at, word in words if word == "throw" and _starts(code, at)]
    within = lambda places, start, end: (k := bisect_left(places, start)) < len(places) and places[k] < end
    fact = lambda pos, end, kind, a=None, b=None, flag=False: out.append((pos, -end, {"pos": pos, "kind": kind, "a": a, "b": b, "flag": flag}))
    for at, word in words:
        head = _HEADED.match(code, at)
        if head and at not in tails:
            opened = head.end() - 1
            shut = n.close[opened]
            end = ends[at]
            if word == "if":
                if within(throws, shut, _statement_end(n, shut + 1, ends) + 1) and not within(ifs, opened, shut):
                    fact(at, end, "if", text[opened + 1 : shut].strip(), " ".join(n.flat(opened + 1, shut).split()), True)
            elif word in ("foreach", "for", "while"):
                over = re.search(r"\bin\b", code[opened:shut]) if word == "foreach" else None
                fact(at, end, word, text[opened + over.end() : shut].strip() if over else None, None, within(loops, at + 1, end))
        elif word == "try":
            if m := _TRY.match(code, at):
                found = _clauses(n, n.close[m.end()])
                fact(at, found[-1][2] if found else n.close[m.end()], "try", flag=any(kind == "catch" and within(throws, a, z) for kind, a, z in found))
        elif word == "return" and _starts(code, at):
            end = n.ends(at)
            m = re.fullmatch(r"(?:[\w.\s]*\.|.*[)\]]\s*\.)?\s*([A-Za-z_]\w*)", n.flat(at + 6, end).strip(), re.S)
            fact(at, end, "return", m.group(1) if m and m.group(1) not in _RESERVED else None)
    declared = set()
    for m in _LOCAL.finditer(code):
        if m.group(1) in _RESERVED - {"var"}:
            continue
        heading = code[max(0, m.start() - 16) : m.start()].rstrip()
        if _starts(code, m.start()) or heading.endswith("("):
            end = n.ends(m.start())
            flat = n.flat(m.start(2), end)
            names = [m.start(2)] + [m.start(2) + c.start(1) for c in re.finditer(r",\s*([A-Za-z_]\w*)\s*(?==(?!=)|,|$)", _GENERIC.sub(lambda g: " " * len(g.group()), flat))]
            for at in names:
                name = re.compile(r"\w+").match(code, at).group()
                declared.add(at)
                if not heading.endswith("("):
                    fact(m.start(), end, "local", name)
    sets: dict[int, list[int]] = {}
    for m in _SET.finditer(code):
        sets.setdefault(n.around(m.start()), []).append(m.start())
    for m in _SET.finditer(code):
        named = _NAMED.search(code, max(0, m.start() - 200), m.start())
        if named and (named.start() in declared or _declares(code, named.start()) and not m.group(1)):
            continue
        start = _chain(n, named.start()) if named else _indexed(n, m.start())
        around = n.around(m.start())
        end = min(n.ends(m.end()), n.close.get(around, len(code)))
        again = within(sets[around], m.end(), end)
        fact(start, end, "set", named.group(1) if named else None, (m.group(1) or "") + "=", not again and bool(_shape(n, m.end(), end)))
    for m in _STEP.finditer(code):
        fact(m.start(), m.end(), "step", (m.group(1) or m.group(2)).split(".")[-1])
    for m in _CALL.finditer(code):
        name = m.group(1)
        if name in _RESERVED or _declares(code, m.start()):
            continue
        start = _chain(n, m.start())
        before = code[max(0, start - 8) : start].rstrip()
        dot = code[max(0, start) : m.start()].rstrip()
        if before.endswith("new") and start == m.start() or re.search(r"\bnew\s*$", code[max(0, start - 12) : start]) and "(" not in dot or dot.endswith("?.") or m.group(2) and not dot:
            continue
        shut = n.close[m.end() - 1]
        fact(start, shut, "call", text[start : start + len(dot) - 1].strip() if dot else name, name, bool(dot))
    out.sort(key=lambda x: x[:2])
    return [x[2] for x in out]


_NAMESPACE = re.compile(r"\bnamespace\s+([A-Za-z_][\w.:]*)\s*([;{])")
_TYPE_HEAD = re.compile(r"(?<![\w.])(class|struct|interface|record)\s+(?:class\s+|struct\s+)?([A-Za-z_]\w*)(?=[^;(){}=]{0,400}[{(:;])")
_MEMBER_NAME = re.compile(r"(?:(" + _TYPE + r")[\s*&]+)?(~?[A-Za-z_][\w:]*)\s*(?:<[\w\s,]{0,200}>)?\s*$")
_AFTER_MEMBER = re.compile(r"\s*(?:(?:const|noexcept|override|final)\b\s*|where\b[^{;=]{0,400}|:[^{;]{0,400})*(\{|=>|;)")
_ACCESS = re.compile(r"\s*(?:(?:public|private|protected)\s*:(?!:)\s*)?")
_HEAD_END, _LABEL, _WHERE = re.compile(r"[{;]"), re.compile(r"(?<!:):(?!:)"), re.compile(r"\bwhere\b")
#: Words that may stand where a type does.
MODIFIERS = frozenset("public private protected internal static async virtual override sealed abstract partial readonly extern unsafe inline explicit implicit friend constexpr delegate event operator".split())
#: Characters before a member's name that belong to it, at most.
LONGEST_HEAD = 2_000
#: Types and namespaces around a type that its name holds, at most.
DEEPEST = 64
_FIELD = re.compile(r"(?<![\w.])(" + _TYPE + r")[\s*&]+([A-Za-z_]\w*)\s*(?==(?![=>])|;)")


def _by_commas(text: str) -> list[str]:
    """The parts of a text between commas outside of <>."""
    out, start, depth = [], 0, 0
    for m in re.finditer("[<>,]", text):
        depth += {"<": 1, ">": -1, ",": 0}[m.group()]
        if m.group() == "," and depth <= 0:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def declarations_of(text: str) -> list[dict]:
    """The methods of a C# or C++ text with their types: namespace, class_name, bases, method_name, return_type, params, body (the whole
    declaration), fields (name, type) of the type; a type without methods is one row without a method_name. Types and members are told by
    their heads, as code stands in brackets; what isn't closed runs to the end of the text."""
    n = Nesting(masked(text))
    code = n.code
    spaces, whole = {}, ""
    for m in _NAMESPACE.finditer(code):
        name = m.group(1).replace("::", ".")
        if m.group(2) == "{":
            spaces[m.start(2)] = name
        else:
            whole = name
    types: dict[int, dict] = {}
    for m in _TYPE_HEAD.finditer(code):
        at = _HEAD_END.search(code, m.end())
        brace = at.start() if at else len(code)
        if brace not in n.close and m.group(1) != "record":
            continue
        head = n.flat(m.end(), brace)
        bases = _LABEL.split(head, maxsplit=1)[1:]
        bases = _WHERE.split(text[brace - len(bases[0]) : brace])[0] if bases else ""
        types[brace] = {"name": m.group(2), "bases": [b.strip() for b in _by_commas(bases) if b.strip()], "outer": n.around(m.start()), "methods": [], "fields": []}

    def around_of(at: int) -> list[int]:
        """The brackets around a place, the innermost first; no more than DEEPEST."""
        out: list[int] = []
        while len(out) < DEEPEST and (at := n.around(at)) >= 0:
            out.append(at)
        return out

    def space(at: int) -> str:
        names = [spaces[b] for b in around_of(at) if b in spaces]
        return ".".join([whole] * bool(whole) + names[::-1])

    def named(brace: int) -> str:
        return ".".join([types[b]["name"] for b in around_of(types[brace]["outer"] + 1) if b in types][::-1] + [types[brace]["name"]]) if types[brace]["outer"] >= 0 else types[brace]["name"]

    inside = {-1, *spaces, *types}
    free: list[dict] = []
    last = 0
    for m in re.finditer(r"\(", code):
        at = m.start()
        around = n.around(at)
        if around not in inside or at < last:
            continue
        shut = n.close[at]
        after = _AFTER_MEMBER.match(code, shut + 1)
        name = _MEMBER_NAME.search(code, max(0, at - 400), at)
        if not after or not name or name.group(2) in _RESERVED or name.group(2).endswith(":"):
            continue
        returns = (name.group(1) or "").strip()
        returns = "" if returns in MODIFIERS else returns
        owner = types.get(around)
        if after.group(1) == ";" and not (owner and returns):
            continue
        if returns in _RESERVED or not returns and not (owner and name.group(2) == owner["name"]):
            continue
        last = n.close[after.end() - 1] if after.group(1) == "{" else n.ends(after.end() - 1)
        begun = max((p + 1 for p in (code.rfind(sign, max(0, name.start() - LONGEST_HEAD), name.start()) for sign in "{};")), default=0)
        begun = _ACCESS.match(code, begun).end()
        params = [p.split("=")[0].strip() for p in _by_commas(n.flat(at + 1, shut)) if p.strip()]
        one = {"method_name": name.group(2).rpartition("::")[2], "return_type": returns, "params": params, "body": text[begun : last + 1], "at": at}
        (owner["methods"] if owner else free).append(one)
    for m in _FIELD.finditer(code):
        around = n.around(m.start())
        if around in types and m.group(1) not in _RESERVED and n.around(m.end()) == around:
            types[around]["fields"].append({"name": m.group(2), "type": m.group(1)})
    blank = {"method_name": None, "return_type": None, "params": [], "body": None}
    out = []
    for brace, one in sorted(types.items()):
        head = {"namespace": space(brace), "class_name": named(brace), "bases": one["bases"], "fields": one["fields"]}
        out += [{**head, **{k: v for k, v in x.items() if k != "at"}} for x in one["methods"]] or [{**head, **blank}]
    if free:
        out += [{"namespace": space(x["at"]), "class_name": "(global)", "bases": [], "fields": [], **{k: v for k, v in x.items() if k != "at"}} for x in free]
    return out


def cpp_guards(text: str) -> list[str]:
    """The conditions of ifs that throw at once: in the statement that follows, before any other if in it; white space collapsed."""
    n = Nesting(masked(text))
    throws, ifs = ([m.start() for m in re.finditer(pattern, n.code)] for pattern in (r"\bthrow\b", r"(?<!\w)if\s*\("))
    out = []
    ends: dict[int, int] = {}
    for k in range(len(ifs) - 1, -1, -1):
        opened = n.code.index("(", ifs[k])
        shut = n.close[opened]
        end = _statement_end(n, shut + 1, ends)
        i = bisect_left(throws, shut)
        if k + 1 < len(ifs):
            if ifs[k + 1] < shut:
                continue
            end = min(end, ifs[k + 1])
        condition = " ".join(text[opened + 1 : shut].split())
        if condition and i < len(throws) and throws[i] <= end:
            out.append(condition)
    return out[::-1]


_IF, _CATCH = re.compile(r"if\s*\(", re.I), re.compile(r"catch\s*(?:\([^)]*\))?\s*\{", re.I)
_THROW = re.compile(r"\bthrow\b")


def _pairs(text: str, open_: str, close: str) -> dict[int, int]:
    found, stack = {}, []
    for m in re.finditer(f"[{re.escape(open_ + close)}]", text):
        if m.group() == open_:
            stack.append(m.start())
        elif stack:
            found[stack.pop()] = m.start()
    return found


def guard_facts(text: str) -> dict:
    """guards: the heads of the ifs whose next block, or next 120 characters where no block follows, throws, in order;
    swallows: whether a catch block doesn't throw. Comments and strings count as code here."""
    brackets, braces = _pairs(text, "(", ")"), _pairs(text, "{", "}")
    opens = [m.start() for m in re.finditer(r"\{", text)]
    throws, words = [m.start() for m in re.finditer("throw", text)], [m.start() for m in _THROW.finditer(text)]

    def holds(places: list[int], begun: int) -> bool:
        k = bisect_left(places, begun)
        return k < len(places) and places[k] + 5 <= braces.get(begun, len(text))

    guards = []
    for m in _IF.finditer(text):
        shut = brackets.get(m.end() - 1)
        if shut is None or (m2 := _IF.search(text, m.end())) and m2.start() < shut:
            continue
        k = bisect_left(opens, shut)
        if holds(throws, opens[k]) if k < len(opens) else bool(_THROW.search(text[shut + 1 : shut + 121])):
            guards.append(text[m.start() : shut + 1])
    return {"guards": guards, "swallows": any(not holds(words, m.end() - 1) for m in _CATCH.finditer(text))}


def _each(function, column: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.array([function(t or "") for t in column.to_pylist()], kind)


_FACTS = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("flag", pa.bool_())]))
_DECLARED = pa.list_(
    pa.struct([
        ("namespace", pa.string()), ("class_name", pa.string()), ("bases", pa.list_(pa.string())), ("method_name", pa.string()), ("return_type", pa.string()), ("params", pa.list_(pa.string())), ("body", pa.string()),
        ("fields", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))),
    ])
)
_GUARDS = pa.struct([("guards", pa.list_(pa.string())), ("swallows", pa.bool_())])


@lru_cache(maxsize=None)
def _functions() -> tuple:
    """The Arrow functions; made on use, as they need no session before."""

    def facts(bodies: pa.Array) -> pa.Array:
        return _each(csharp_facts, bodies, _FACTS)

    def guards(bodies: pa.Array) -> pa.Array:
        return _each(guard_facts, bodies, _GUARDS)

    def conditions(bodies: pa.Array) -> pa.Array:
        return _each(cpp_guards, bodies, pa.list_(pa.string()))

    def code(bodies: pa.Array) -> pa.Array:
        return pa.array([None if t is None else masked(t) for t in bodies.to_pylist()], pa.string())

    def declared(texts: pa.Array) -> pa.Array:
        return _each(declarations_of, texts, _DECLARED)

    return (
        F.arrow_udf(facts, "array<struct<pos:int,kind:string,a:string,b:string,flag:boolean>>"),
        F.arrow_udf(guards, "struct<guards:array<string>,swallows:boolean>"), F.arrow_udf(code, "string"), F.arrow_udf(conditions, "array<string>"),
        F.arrow_udf(declared, "array<struct<namespace:string,class_name:string,bases:array<string>,method_name:string,return_type:string,params:array<string>,body:string,fields:array<struct<name:string,type:string>>>>"),
    )


def facts_of(body: Column) -> Column:
    """csharp_facts() of a column of bodies; a null body has none."""
    return _functions()[0](body)


def guards_of(body: Column) -> Column:
    """guard_facts() of a column of bodies; a null body has none."""
    return _functions()[1](body)


def code_of(text: Column) -> Column:
    """masked() of a column of texts."""
    return _functions()[2](text)


def cpp_guards_of(body: Column) -> Column:
    """cpp_guards() of a column of bodies; a null body has none."""
    return _functions()[3](body)


def declared_in(text: Column) -> Column:
    """declarations_of() of a column of texts; a null text has none."""
    return _functions()[4](text)
