"""Secrets in texts: three fixed patterns, and literals that assignments bring to sensitive names.

Source and configuration syntax is lexed into assignments: a name, and a value made of literals and of other names.
Constants are propagated: a literal counts for every name it reaches through plain references and concatenation, and
parts that are short by themselves are judged as the value they make. A literal is reported if the sensitivity of a name
it reaches and its own looks score high enough together.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.common import map_rows, text_of

KINDS = ("assign", "access", "hex", "literal")

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
HEX_RUN = b"h" * HEX_CHARS
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

# How much a part of a name says about the value; parts are cut at case changes and separators.
SENSITIVE = {
    "password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "passcode": 4, "secret": 4, "secrets": 4, "credential": 4,
    "credentials": 4, "apikey": 4, "token": 4, "tokens": 3, "bearer": 3, "auth": 3, "authorization": 3, "private": 2,
    "access": 2, "api": 2, "key": 2, "keys": 2, "encryption": 2, "signing": 2, "pass": 3, "pin": 2, "salt": 2,
    "signature": 2, "webhook": 2, "dsn": 2, "session": 1, "client": 1,
}
HARMLESS = {
    "count": -3, "length": -3, "size": -3, "limit": -3, "max": -3, "min": -3, "path": -3, "file": -3, "name": -3,
    "type": -3, "public": -4, "url": -2, "field": -3, "label": -3, "prefix": -2, "expires": -3, "ttl": -3, "hint": -3,
    "column": -3, "policy": -3, "placeholder": -4, "example": -4, "regex": -4, "pattern": -4,
}
# Values that stand for no secret as a whole; words inside a value that count as no part of it, the first kind only
# beside what marks a stand-in; and words of prose.
PLACEHOLDER = re.compile(r"(?is)-{3,}[a-z0-9 ]+-{3,}|<[^<>]*>|\$\{[^{}]*\}|\{\{[^{}]*\}\}|x+|\*+|true|false|null|none|undefined|nil")
STAND_IN = re.compile(r"(?i)change.?me|example|your[_-]|placeholder|dummy|sample|redacted|\$\{[^{}]*\}|\{\{[^{}]*\}\}|"
                      r"x{4,}+|\*{3,}+|(.)\1{5,}+")
GENERIC = re.compile(r"(?i)password|passwd|passphrase|secret|token|api|key|here|test|value|user")
PROSE = frozenset("a an and are be by can cannot enter field for forgot from has have if in incorrect invalid is it must "
                  "new no not of on or please required reset should that the this to use was wrong you your".split())
SENSITIVE_AT = 3
FLAG_AT = 7
PHRASE_AT = 4  # how sensitive a name has to be for a value of several words
SPACED = re.compile(r"\s")

NAME_BACK = re.compile(r"[\w$.\-@\[\]|]+")  # read from the right, in the reversed text
TAIL = re.compile(r"[\w$.\-]*@?")  # likewise: what a name may end with
NAME_START = re.compile(r"[A-Za-z_$@]")
OPERATOR = re.compile(r"(?:(?<![=!<>:])=(?![=~])>?|(?<!:):(?![:/])=?)[\x20\t]*")
QUOTE = re.compile(r"[A-Za-z]{0,2}([\"'`])")
BODY = {'"': re.compile(r'[^"\\\n]*+(?:\\.[^"\\\n]*+)*+(?=")'), "'": re.compile(r"[^'\\\n]*+(?:\\.[^'\\\n]*+)*+(?=')"),
        "`": re.compile(r"[^`]*+(?=`)")}
BARE = re.compile(r"""[^\s"'`,;(){}<>\[\]+]++(?:\+[^\s"'`,;(){}<>\[\]+]++)*+""")
JOIN = re.compile(r"[\x20\t]*(?:\+|\.\.|&)[\x20\t]*\n?[\x20\t]*|[\x20\t]+(?=[\"'])")
BLANK, WHITE = re.compile(r"[\x20\t]*"), re.compile(r"\s*")
BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[\x20\t]*(?:#[^\n]*)?\r?\n")  # YAML
LINE = re.compile(r"([\x20\t]*)([^\n]*)\n?")
NEXT_LINE = re.compile(r"\\?\r?\n([\x20\t]*)(-[\x20\t]+)?")
ITEM = re.compile(r"[\x20\t]*\r?\n[\x20\t]*-[\x20\t]+")
NAMED = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-z]+(?:[._/-][a-z0-9]+)*")  # arguments that name what is looked up
REFERENCE = re.compile(r"[A-Za-z_$][\w$.]*+$")
INSIDE = re.compile(r"\$?\{\{?\s*([A-Za-z_$][\w$.]*)\s*\}?\}|\$([A-Za-z_]\w*)")
# Forms that are no "name operator value": each has groups for the name and the value.
TEXT = r"""(?:"(?P<v>[^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'(?P<w>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)')"""
KEY = r"""(["'])(?P<name>[A-Za-z_][\w.\-]*+)\1"""
FORMS = {
    "(": [re.compile(rf"[(\[]\s*+{KEY}\s*+,\s*+{TEXT}")],  # a setter's arguments, or a pair
    "define": [re.compile(rf"(?m)^[\x20\t]*+#[\x20\t]*+define[\x20\t]++(?P<name>[A-Za-z_]\w*+)[\x20\t]++(?:{TEXT}|(?P<x>[^\s\"']++))")],
    "</": [re.compile(r"<(?P<name>[A-Za-z_][\w.:\-]*+)(?:\s[^<>]*+)?>(?P<v>[^<>]++)</(?P=name)\s*+>"),
           re.compile(rf"<[A-Za-z_][\w.:\-]*+\s[^<>]*?\b(?:key|name|id)\s*+=\s*+{KEY}[^<>]*+(?<!/)>(?P<v>[^<>]++)</")],
    "value": [re.compile(rf"(?i)\b(?:key|name)\s*+=\s*+{KEY}\s++value\s*+=\s*+{TEXT}")],
    "uthorization": [re.compile(r"""(?P<name>[Aa]uthorization)["']?\s*+[:=]\s*+["']?(?i:bearer|basic|token|apikey)\s++(?P<v>[\w+/.=~\-]++)""")],
}
URL = re.compile(r"""(?<=[A-Za-z0-9])://[^\s/:@"'<>]*+:([^\s/@"'<>]++)@""")  # the value is a password
TUPLE = re.compile(r"(?m)^[\x20\t]*+((?:[A-Za-z_]\w*+[\x20\t]*+,[\x20\t]*+)++[A-Za-z_]\w*+)[\x20\t]*+=(?!=)")
ELEMENT = re.compile(rf"""[\x20\t]*+(?:{TEXT}|(?P<x>[^,\s"'()\[\]{{}}]++))[\x20\t]*+(,|(?=[;#\r\n])|$)""")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Assignment(NamedTuple):
    at: int
    name: str
    literals: list[tuple[int, int]]
    references: list[str]
    joins: list[int]  # where parts are joined to one value


def base_spans(text: str) -> list[Span]:
    """The three patterns, leftmost and not overlapping within a kind; too short matches use up their characters."""
    found = []
    if any(hint in lowered for lowered in [text.lower()] for hint in ASSIGN_HINTS):
        found += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    if HEX_RUN in text.encode("utf-8", "replace").translate(HEX_MAP):
        found += [Span("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= HEX_CHARS]
    return found


def name_before(text: str, back: str, at: int, typed: bool = True) -> str | None:
    """The name that ends before a position: quoted, or plain and perhaps followed by a type. ``back`` is ``text`` reversed.

    A name may be of any length: it is read from its end, and never across an operator other than a type's.
    """
    size = len(text)
    start = BLANK.match(back, size - at).end()
    if back[start:start + 1] == "]" and back[start + 1:start + 2] in ("'", '"'):  # a subscript
        start += 1
    if (quote := back[start:start + 1]) in ("'", '"', "`"):
        end = size - start - 1
        opening = text.rfind(quote, 0, end)
        inner = text[opening + 1:end]
        return inner if opening >= 0 and inner and "\n" not in inner else None
    word = NAME_BACK.match(back, start)
    if not word:
        return None
    rest = BLANK.match(back, word.end()).end()
    if typed and back[rest:rest + 1] == ":" and back[word.end() - 1].isalpha():
        word = NAME_BACK.match(back, BLANK.match(back, rest + 1).end()) or word
    tail = TAIL.match(back, *word.span())[0][::-1]
    first = NAME_START.search(tail)
    return tail[first.start():] if first else None


class Lexer:
    """Reads the assignments of a text. Every value is read once, then what stands inside its strings as a text of its own.

    A name inside a value (in brackets, an unquoted word or a string) makes an assignment of its own, and what it is
    given does not count for the name outside, save in a word, which counts whole for its first name.
    """

    def __init__(self, text: str):
        self.text, self.back = text, text[::-1]
        self.found: list[Assignment] = []
        self.regions = [(0, len(text))]
        self.dead: dict[str, int] = {}  # up to where a kind of quote is known not to be closed

    def scan(self, low: int, high: int) -> None:
        self.dead = {}
        at = low
        while op := OPERATOR.search(self.text, at, high):
            at = op.end()
            if name := self.name_before(op.start()):
                at = max(at, self.value(name, op, high))

    def name_before(self, at: int, typed: bool = True) -> str | None:
        return name_before(self.text, self.back, at, typed)

    def begin(self, at: int, name: str) -> Assignment:
        self.found.append(Assignment(at, name, [], [], []))
        return self.found[-1]

    def string(self, at: int, high: int) -> tuple[int, int, int] | None:
        """Start and end of what the quotes at a place hold, and the place after them."""
        opening = QUOTE.match(self.text, at, high)
        if not opening:
            return None
        quote, start = opening[1], opening.end()
        triple = quote * 3
        if quote != "`" and self.text.startswith(triple, start - 1) and self.dead.get(triple, -1) <= start:
            end = self.text.find(triple, start + 2, high)
            if end >= 0:
                return start + 2, end, end + 3
            self.dead[triple] = high
        if self.dead.get(quote, -1) > start:
            return None
        body = BODY[quote].match(self.text, start, high)
        if not body:
            line = self.text.find("\n", start, high) if quote != "`" else -1
            self.dead[quote] = line if line >= 0 else high
            return None
        return start, body.end(), body.end() + 1

    def lines(self, start: int, end: int) -> list[tuple[int, int]]:
        """The lines of a stretch without the white space around them."""
        return [(start + m.start(), start + m.end()) for m in re.finditer(r"\S(?:[^\n]*\S)?", self.text[start:end])]

    def quoted(self, own: Assignment, start: int, end: int) -> None:
        own.literals.extend(self.lines(start, end) if "\n" in self.text[start:end] else [(start, end)])
        own.references.extend(a or b for a, b in INSIDE.findall(self.text, start, end))
        self.regions.append((start, end))

    def word(self, own: Assignment, start: int, end: int, literal: bool = True, item: bool = False) -> None:
        """An unquoted word; each assignment in it has the rest of the word, in a query string up to the next '&'."""
        text = self.text
        stop = start + len(text[start:end].rstrip(".:!?"))
        if own.literals or own.references or REFERENCE.match(text, start, stop):
            own.references.append(text[start:stop])
        if literal and (item or not own.literals) and stop > start:
            own.literals.append((start, stop))
        cuts = None
        for op in OPERATOR.finditer(text, start, end):
            if op.end() >= stop:
                break
            names = [n for n in (self.name_before(op.start(), typed) for typed in (False, True)) if n]
            if names:
                name = max(names, key=name_score)  # a:b=c may give c to a of type b, or to b
                to = stop
                if text[op.start() - len(name) - 1:op.start() - len(name)] in ("?", "&"):
                    cuts = cuts or [i for i in range(start, stop) if text[i] == "&"] + [stop]
                    to = cuts[bisect_left(cuts, op.end())]
                inner = self.begin(op.start(), name)
                inner.literals.append((op.end(), to))
                if REFERENCE.match(text, op.end(), to):
                    inner.references.append(text[op.end():to])

    def word_end(self, start: int, high: int) -> int:
        """Where the unquoted word ends: before an operator that a quote or bracket follows."""
        word = BARE.match(self.text, start, high)
        if not word:
            return start
        end = word.end()
        back = end
        while back > start and self.text[back - 1] in ":=>":
            back -= 1
        op = OPERATOR.search(self.text, back, end) if back < end else None
        if op and self.text[(after := OPERATOR.match(self.text, op.start(), high).end()):after + 1] in ("'", '"', "`", "(", "[", "{"):
            return op.start()
        return end

    def block(self, own: Assignment, op: re.Match, start: int, high: int) -> None:
        """The lines of a YAML block: those that follow and stand deeper than the line of the name."""
        line = self.text.rfind("\n", 0, op.start()) + 1
        depth = len(BLANK.match(self.text, line)[0])
        while start < high:
            m = LINE.match(self.text, start, high)
            if m[2].strip():
                if len(m[1]) <= depth:
                    return
                own.literals.extend(self.lines(*m.span(2)))
            start = m.end()

    def is_key(self, end: int, high: int) -> bool:
        """Whether an operator follows, so that what ended here is a name."""
        return bool(OPERATOR.match(self.text, BLANK.match(self.text, end, high).end(), high))

    def next_line(self, at: int, high: int) -> int | None:
        """Where a value begins on the line after the operator: a string, or deeper a bracket or a word; no name."""
        m = NEXT_LINE.match(self.text, at, high)
        if not m:
            return None
        start = m.end()
        if string := self.string(start, high):
            return None if self.is_key(string[2], high) else start
        if not m[1] and not m[2]:
            return None
        if self.text[start:start + 1] in ("(", "[", "{"):
            return start
        end = self.word_end(start, high)
        if end == start or self.is_key(end, high) or self.text[end - 1] == ":":
            return None
        op = OPERATOR.search(self.text, start, end)
        return None if op and op[0][0] == "=" and REFERENCE.match(self.text, start, op.start()) else start

    def value(self, name: str, op: re.Match, high: int) -> int:
        """Read the value after an operator, with all assignments in its brackets; the place after it."""
        text = self.text
        frames, brackets = [self.begin(op.start(), name)], [[]]  # assignments around a place, and their open brackets
        at, fresh, bare = op.end(), True, False
        first, listed = False, False
        if block := BLOCK.match(text, at, high):
            self.block(frames[0], op, block.end(), high)
            return block.end()
        if (start := self.next_line(at, high)) is not None:
            listed = "-" in text[at:start]
            at = start
        while at < high:
            own, opened = frames[-1], brackets[-1]
            inside = bool(opened) or len(frames) > 1
            at, before = (WHITE if inside else BLANK).match(text, at, high).end(), at
            if at >= high:
                break
            c = text[at]
            if inside and c in ",;)]}":
                if not opened:  # the value of a name in brackets ends, what holds it goes on
                    frames.pop(), brackets.pop()
                    continue
                if c in ")]}":
                    opened.pop()
                at, fresh, bare, first = at + 1, c in ",;", False, False
                continue
            if inside and not fresh and (inner := OPERATOR.match(text, at, high)):
                if key := self.name_before(inner.start()):
                    for kept in (own.literals, own.references):
                        while kept and len(kept) > held[kept is own.references]:
                            kept.pop()
                    if not opened:
                        frames.pop(), brackets.pop()
                    frames.append(self.begin(inner.start(), key)), brackets.append([])
                at, fresh, bare, first = inner.end(), True, False, False
                continue
            if bare and not fresh and before == at and c in "([":  # a call, or a look-up
                while len(own.literals) > held[0]:
                    own.literals.pop()
                opened.append("call")
                at, fresh, bare, first = at + 1, True, False, True
                continue
            if not fresh:
                join = JOIN.match(text, before, high)
                if join and (join[0].strip() or not bare):
                    if not opened:
                        own.joins.append(at)
                    at, fresh = join.end(), True
                    continue
                if listed and not inside and (item := ITEM.match(text, before, high)):
                    end = self.word_end(item.end(), high)
                    if not self.is_key(end, high) and text[end - 1] != ":":
                        if end > item.end():
                            own.literals.append((item.end(), end))
                            at, bare = end, True
                        else:
                            at, fresh = item.end(), True
                        continue
                if not inside:
                    return before
            held = len(own.literals), len(own.references)
            if string := self.string(at, high):
                start, end, at = string
                if first and NAMED.fullmatch(text, start, end):
                    own.references.append(text[start:end])
                    fresh, bare, first = False, False, False
                    continue
                self.quoted(own, start, end)
                fresh, bare = False, False
                first = False
            elif fresh and c in "([{":
                opened.append(c)
                at += 1
            elif (end := self.word_end(at, high)) > at:
                inner = OPERATOR.search(text, at, end) if inside else None
                if inner and (key := self.name_before(inner.start())):
                    inner = OPERATOR.match(text, inner.start(), high)
                    if not opened:
                        frames.pop(), brackets.pop()
                    own = self.begin(inner.start(), key)
                    frames.append(own), brackets.append([])
                    if inner.end() < end:
                        held = 0, 0
                        self.word(own, inner.end(), end)
                        at, fresh, bare = end, False, True
                    else:
                        at, fresh, bare = inner.end(), True, False
                    first = False
                    continue
                first = False
                self.word(own, at, end, not opened or opened[-1] == "[", bool(opened) and fresh)
                at, fresh, bare = end, False, True
            elif inside:
                at, fresh = at + 1, True
            else:
                return at
        return at


def other_forms(text: str) -> list[Assignment]:
    """Assignments without an operator of their own: pairs of arguments, definitions, elements and attributes, headers,
    passwords in addresses, and tuples. Each form is searched in time linear in the text."""
    found = []
    for hint, patterns in FORMS.items():
        for pattern in patterns if hint in text else ():
            for m in pattern.finditer(text):
                span = next(m.span(g) for g in ("v", "w", "x") if g in pattern.groupindex and m[g] is not None)
                found.append(Assignment(m.start(), m["name"], [span], [], []))
    if "://" in text:
        found += [Assignment(m.start(), "password", [m.span(1)], [], []) for m in URL.finditer(text)]
    for m in TUPLE.finditer(text) if "," in text and "=" in text else ():
        at = m.end()
        for name in m[1].split(","):
            value = ELEMENT.match(text, at)
            if not value:
                break
            span = next(value.span(g) for g in ("v", "w", "x") if value[g] is not None)
            found.append(Assignment(m.start(), name.strip(), [span], [value["x"]] if value["x"] else [], []))
            at = value.end()
            if text[at - 1:at] != ",":
                break
    return found


def assignments(text: str) -> list[Assignment]:
    """Name and value pairs in order of appearance; values are literals, names, or joins of both."""
    lexer = Lexer(text)
    while lexer.regions:
        lexer.scan(*lexer.regions.pop())
    found = lexer.found + other_forms(text)
    return sorted((a for a in found if a.literals or a.references), key=lambda a: a.at)


def name_score(name: str) -> int:
    parts = [p.lower() for p in PART.findall(name)]
    return sum(SENSITIVE.get(p, 0) + HARMLESS.get(p, 0) for p in parts)


def literal_scores(text: str, starts: list[int], end: int) -> dict[int, tuple[int, bool]]:
    """Scores of the literals that end at one place, by start, read once from the right, and if they hold white space.

    Length, mixed kinds of characters and entropy speak for a secret; letters alone, words of prose and stand-ins such
    as "example" against it. What makes up a stand-in is no part of the value, and the rest has to look like a secret.
    """
    lowest = min(starts)
    value = text[lowest:end]
    marks = [m.span() for m in STAND_IN.finditer(value)]
    hidden = bytearray(len(value))
    for s, e in marks + [m.span() for m in GENERIC.finditer(value)] * bool(marks):
        hidden[s:e] = b"\1" * (e - s)
    last_mark = lowest + marks[-1][0] if marks else -1
    spaces = [m.start() + lowest for m in SPACED.finditer(value)]
    tallies, scores, wanted = [_Tally(), _Tally()], {}, set(starts)
    for i in range(len(value) - 1, -1, -1):
        tallies[0].add(value[i])
        if not hidden[i]:
            tallies[1].add(value[i])
        at = lowest + i
        if at in wanted:
            marked = at <= last_mark
            score = tallies[marked].score() - 2 * marked
            spaced = bool(spaces) and spaces[-1] >= at
            if spaced:
                words = [w.strip(".,:;!?'()") for w in text[at:end].lower().split()]
                score -= 4 * sum(w in PROSE for w in words) if len(words) > 1 else 0
            scores[at] = -9 if PLACEHOLDER.fullmatch(text, at, end) else score, spaced
    return scores


class _Tally:
    """Length, entropy and kinds of the characters seen so far."""

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()
        self.size, self.sum = 0, 0.0
        self.lower = self.upper = self.digit = self.other = 0

    def add(self, c: str) -> None:
        n = self.counts[c]
        self.counts[c] = n + 1
        self.sum += (n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0)
        self.size += 1
        self.lower |= c.islower()
        self.upper |= c.isupper()
        self.digit |= c.isdigit()
        self.other |= not c.isalnum()

    def score(self) -> int:
        if self.size < 8:
            return -9
        entropy = math.log2(self.size) - self.sum / self.size
        alpha = not self.other and all(c.isalpha() for c in self.counts) if not self.digit else False
        kinds = self.lower + self.upper + self.digit + self.other
        return (self.size >= 12) + (self.size >= 20) + (entropy >= 2.8) + (entropy >= 3.5) + (kinds - 1) * 2 - 3 * alpha


def assigned_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name. A name refers to its last assignment before, else to the first after."""
    if not any(c in text for c in "=:<([#"):
        return []
    found = assignments(text)
    places: dict[str, list[int]] = {}
    for i, a in enumerate(found):
        places.setdefault(a.name, []).append(i)
    reached = [0] * len(found)  # the highest score of a name that the assignment's value reaches
    todo = [(i, name_score(a.name)) for i, a in enumerate(found)]
    while todo:
        j, score = todo.pop()
        if score < SENSITIVE_AT or score <= reached[j]:
            continue
        reached[j] = score
        for reference in found[j].references:
            if at := places.get(reference):
                todo.append((at[max(0, bisect_left(at, j) - 1)], score))
    best: dict[tuple[int, int], int] = {}  # the highest score of a name that each literal reaches
    starts: dict[int, list[int]] = {}
    for a, score in zip(found, reached):
        for span in a.literals if score else ():
            if span[0] == span[1]:
                continue
            if span not in best:
                starts.setdefault(span[1], []).append(span[0])
            best[span] = max(score, best.get(span, 0))
    spans = []
    for end, places_of in starts.items():
        own = literal_scores(text, places_of, end)
        for s in sorted(places_of):
            score, spaced = own[s]
            if best[s, end] + score >= FLAG_AT and (best[s, end] >= PHRASE_AT or not spaced):
                spans.append(Span("literal", s, end))
                break  # what begins later lies inside
    outer, reach = [], -1
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):  # what lies inside another is reported with it
        if span.end > reach:
            outer.append(span)
            reach = span.end
    return outer + folded_spans(text, found, places, reached, outer)


def folded_spans(text: str, found: list[Assignment], places: dict[str, list[int]], reached: list[int],
                 known: list[Span]) -> list[Span]:
    """Parts that are a secret only together: what is joined for a sensitive name, references replaced by constants."""
    ends: dict[int, int] = {}

    def constant(j: int) -> int:
        """The assignment at the end of plain references from one to the next."""
        way = []
        while j not in ends:
            way.append(j)
            ends[j] = j  # a circle ends here
            a = found[j]
            own = [s for s in a.literals if text[slice(*s)] not in a.references]
            if own or len(a.references) != 1 or not (at := places.get(a.references[0])):
                break
            j = at[max(0, bisect_left(at, j) - 1)]
        for i in way:
            ends[i] = ends[j]
        return ends[j]

    have, spans = {(s.start, s.end) for s in known}, []
    for j, a in enumerate(found):
        if not a.joins or reached[j] < SENSITIVE_AT:
            continue
        parts = [s for s in a.literals if text[slice(*s)] not in places]
        for reference in a.references:
            if at := places.get(reference):
                k = constant(at[max(0, bisect_left(at, j) - 1)])
                if not found[k].joins:
                    parts += [s for s in found[k].literals if text[slice(*s)] not in found[k].references]
        parts = list(dict.fromkeys(s for s in parts if s[0] < s[1]))
        if len(parts) < 2 or have.intersection(parts):
            continue
        value = "".join(text[slice(*s)] for s in parts)
        score, spaced = literal_scores(value, [0], len(value))[0]
        if reached[j] + score >= FLAG_AT and (reached[j] >= PHRASE_AT or not spaced):
            spans += [Span("literal", *s) for s in parts]
            have.update(parts)
    return spans


def find_secrets(text: str) -> list[Span]:
    """All spans by start, then kind, then end; positions count code points, ends are exclusive."""
    return sorted(base_spans(text) + assigned_spans(text), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(df: DataFrame, text: str = "text", output: str = "secrets") -> DataFrame:
    """Add ``output``, the spans (kind, start, end) of the secrets in each text; none for null and empty texts.

    Kinds are ``assign``, ``access`` and ``hex`` for the fixed patterns and ``literal`` for the lexer's. A column already
    called ``output`` is replaced. No rows give no rows.
    """
    rest = df.drop(output)
    schema = rest.withColumn(output, F.array().cast(SPANS)).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[s._asdict() for s in find_secrets(t)] for t in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], schema.fieldNames())

    return map_rows(rest.withColumn("_scanned", text_of(text)), rows, schema)


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with every secret in the text replaced by ``mark``; overlapping ones by a single mark.

    Null texts stay null and empty ones empty; no rows give no rows.
    """
    columns = df.columns
    at = columns.index(text)
    plain = df.withColumn(text, quoted(text).cast("string"))

    def clean(value: str | None) -> str | None:
        spans = find_secrets(value) if value else []
        parts, done = [], 0
        for span in spans:
            if span.start >= done:
                parts += [value[done:span.start], mark]
            done = max(done, span.end)
        return "".join(parts) + value[done:] if spans else value

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        cleaned = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
        arrays = [cleaned if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(arrays, columns)

    return map_rows(plain, rows, plain.schema)
