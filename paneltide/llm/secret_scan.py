"""Secrets in source and configuration text.

Three fixed patterns give the base spans. On top of them a small lexer reads lines that hold
an assignment, pairs names with literals, follows constants from one name to the next and
through `+`, and reports literals that reach a name which sounds sensitive. It goes over a text once:
that a quote is not closed on its line is found out once for the line.

Defined results: a null text counts as empty and has no spans; repeated rows each give their
own result; positions are code points, ends exclusive; ties at one start are listed in the
order assign, access, hex, literal.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from paneltide.llm.common import map_texts

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A maximal run that is too short has no longer run within, so the bound can sit in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

STRING = r"""(?:\b[rbfuRBFU]{1,2})?(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*')"""
TRIPLE = r"""\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}"""
DOUBLE, SINGLE = r'"(?:[^"\\\n]|\\[^\n])*"', r"'(?:[^'\\\n]|\\[^\n])*'"


def token_of(*strings: str) -> re.Pattern:
    return re.compile(
        rf"""(?P<str>(?:\b[rbfuRBFU]{{1,2}})?(?:{"|".join(strings)}))|(?P<op>==|!=|<=|>=|:=|=>|\+=|\?\?=|\?=|[=:+])"""
        r"""|(?P<name>[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*)|(?P<raw>[^\s"'=:+,;(){}\[\]]+)|(?P<other>[^\s])"""
    )


#: By the quotes that do not close any more on a line: once one is found open, no later one of its kind closes there.
TOKENS = {"": token_of(TRIPLE, DOUBLE, SINGLE), '"': token_of(TRIPLE, SINGLE), "'": token_of(TRIPLE, DOUBLE), "\"'": token_of(TRIPLE)}
ASSIGNERS = {"=", ":", ":=", "=>", "+=", "?=", "??="}
BLANK = re.compile(r"[ \t]*")
#: Between an operator and its value on a later line: white space, an opened bracket, a line that goes on.
ONWARD = re.compile(r"(?:\s|\\\r?\n|\()*")
PLUS = re.compile(r"(?:\s|\\\r?\n)*\+(?![+=])(?:\s|\\\r?\n)*")
WHOLE_STRING = re.compile(STRING)
WHOLE_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*")
#: An unquoted value: to white space, comma, semicolon or line end; strings within it are taken whole.
UNQUOTED = re.compile(r"""[^\s,;"']+""")
QUOTED = {'"': re.compile(DOUBLE), "'": re.compile(SINGLE)}
#: Words before a credential in a header's value.
SCHEMES = {"bearer", "basic", "token", "digest", "apikey", "key"}
SCHEME = re.compile(r"([A-Za-z]+)[ \t]+(?=[^\s,;:=\"'<>(]{6})")
#: A list, or a call.
OPENED = re.compile(r"\[|[A-Za-z_$][\w$.:]*\(")
BRACKET = re.compile(r"[()\[\]{}]")
#: What stands in for a value that is missing: `env.KEY || "literal"`.
INSTEAD = re.compile(r"[ \t]*(?:\|\||\?\?|\bor\b)[ \t]*")
ENV_NAME = re.compile(r"[A-Z][A-Z0-9_]*")
TAG = re.compile(r"<([A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>([^<>]{6,})</\1\s*>")
ASSIGNED = re.compile(r"[ \t]*(?:\?\?=|[?+:]?=(?![=>])|=>|:)")
NAME_ENDS = re.compile(r"\s|[,;)\]}]|$")
#: `: type =` between a name and its value.
TYPED = re.compile(r"""[ \t]*((?:&[ \t]*(?:'\w+[ \t]+)?)?[A-Za-z_][^"'=:;{}()\n]*)=(?![=>])""")
BRACKETED = re.compile(r"\[.*\]|<.*>")
TYPE = re.compile(r"(?:&\s*(?:'\w+\s+)?(?:mut\s+)?)?[\w.]+\??(?:\s*\|\s*[\w.]+)*")
BUILTIN_TYPES = {"str", "string", "bytes", "bytearray", "int", "float", "bool", "char", "any", "object", "byte", "rune", "error"}
CHAINED = re.compile(r"""[ \t]*([A-Za-z_$][\w$.]*)(?:[ \t]+=(?![=>])|=(?=["']))""")
CLOSERS = {")": "(", "]": "[", "}": "{"}
BLOCK = re.compile(r"[ \t]*[|>][-+0-9]*[ \t]*\r?\n")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How strongly a part of a name says that its value is a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "auth": 0.6, "authorization": 0.7}
KEY_BEFORE = {"api", "access", "private", "secret", "signing", "encryption", "auth", "master"}
HARMLESS = re.compile(r"(?i)^(?:true|false|null|none|nil|undefined|changeme|example|placeholder|redacted|x+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s?)$")
MIN_SCORE, MIN_LITERAL = 0.5, 6
#: First and last characters kept of a value: more than the longest word in HARMLESS.
ENDS = 12
#: Characters of a call or a list that are looked through for literals.
FARTHEST = 2000


def name_score(name: str) -> float:
    """How sensitive a target name is, 0 to 1."""
    parts = [p.lower() for p in PARTS.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if any(b == "key" and a in KEY_BEFORE for a, b in zip(parts, parts[1:])):
        best = 1.0
    return best


def takes_phrases(name: str) -> bool:
    """Whether a value of several words may be the secret itself: the name ends in a word for one that people type."""
    return [p.lower() for p in PARTS.findall(name)][-1:] in (["passphrase"], ["password"], ["passwd"], ["pwd"])


def literal_score(value: str, phrases: bool = False) -> float:
    """How much a literal looks like a secret rather than a placeholder or a word, 0 to 1.

    A value with more than three spaces is taken for prose, unless the name takes phrases.
    """
    return score_of(len(value), Counter(value), value, phrases)


def score_of(size: int, counts: Counter, value: str, phrases: bool) -> float:
    """The same of a value by its size and letters; of `value` only what tells a placeholder counts."""
    if size < MIN_LITERAL or HARMLESS.match(value) or (counts[" "] > 3 and not phrases):
        return 0.0
    bits = -sum(c / size * math.log2(c / size) for c in counts.values() if c / size)
    return min(1.0, 0.4 + bits / 5)


class Value:
    """What a name stands for: spans of literals and other values, in order."""

    __slots__ = ("parts", "size", "counts", "head", "tail", "reported")

    def __init__(self, parts: list):
        self.parts, self.counts, self.reported = tuple(parts), None, False
        self.size = sum(x.size if isinstance(x, Value) else x[1] - x[0] for x in parts)

    def new_spans(self) -> list[tuple[int, int]]:
        """The literals that no reported value among the parts has brought already."""
        out, seen, todo = [], set(), [self]
        while todo:
            x = todo.pop()
            if not isinstance(x, Value):
                out.append(x)
            elif not x.reported and id(x) not in seen:
                seen.add(id(x))
                todo.extend(x.parts)
        return out

    def looks_secret(self, text: str, phrases: bool) -> float:
        todo = [self]
        while todo:
            x = todo[-1]
            below = [y for y in x.parts if isinstance(y, Value) and y.counts is None]
            todo += below
            if not below:
                todo.pop().sum_up(text)
        whole = self.size <= 2 * ENDS
        middle = "" if whole else "".join(self.counts)  # as good as the letters between, to a placeholder's pattern
        tail = self.tail[max(0, len(self.tail) - self.size + len(self.head)) :] if whole else self.tail
        return score_of(self.size, self.counts, self.head + middle + tail, phrases)

    def sum_up(self, text: str) -> None:
        counts, head, tail = Counter(), "", ""
        for x in self.parts:
            if isinstance(x, Value):
                counts.update(x.counts)
                first, last = x.head, x.tail
            else:
                counts.update(text[x[0] : x[1]])
                first, last = text[x[0] : min(x[1], x[0] + ENDS)], text[max(x[0], x[1] - ENDS) : x[1]]
            head, tail = (head + first)[:ENDS], (tail + last)[-ENDS:]
        self.counts, self.head, self.tail = counts, head, tail


def inside(m: re.Match) -> tuple[int, int]:
    """The span of a string literal without prefix and quotes."""
    body = m.group().lstrip("rbfuRBFU")
    quotes = 3 if len(body) >= 6 and body[:3] in ('"' * 3, "'" * 3) else 1
    return (m.end() - len(body) + quotes, m.end() - quotes)


def indent(text: str, at: int) -> int:
    """White space before the first character of the line that holds `at`."""
    start = text.rfind("\n", 0, at) + 1
    return BLANK.match(text, start).end() - start


def block(text: str, at: int, least: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the lines from `at` on that are indented by more than `least`, and where they end."""
    spans = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        start, line = BLANK.match(text, at).end(), text[at:end]
        if line.strip() and start - at <= least:
            break
        stop = at + len(line.rstrip())
        if start < stop and not text.startswith("-----", start):
            spans.append((start, stop))
        at = end + 1
    return spans, min(at, len(text))


class Run:
    """The last unquoted run: values that begin within it end where it ends, without another walk."""

    start = stop = 0

    def __init__(self):
        self.open = {'"': -1, "'": -1}  # up to where a quote of the kind is known not to close

    def string(self, text: str, at: int) -> int | None:
        """Where the string that a quote opens ends, if it does on its line."""
        quote = text[at]
        if at < self.open[quote]:
            return None
        if m := QUOTED[quote].match(text, at):
            return m.end()
        end = text.find("\n", at)
        self.open[quote] = len(text) if end < 0 else end
        return None

    def walk(self, text: str, at: int) -> int:
        while at < len(text):
            if text[at] in QUOTED:
                at = self.string(text, at) or at + 1
            elif m := UNQUOTED.match(text, at):
                at = m.end()
            else:
                break
        return at

    def end(self, text: str, start: int) -> int:
        """Where the run from `start` ends, without closing brackets that nothing in it opened."""
        if not self.start <= start < self.stop:
            self.start, self.stop = start, self.walk(text, start)
            self.opened = {c: text.rfind(o, start, self.stop) for c, o in CLOSERS.items()}
        end = self.stop
        while end > start and text[end - 1] in CLOSERS and self.opened[text[end - 1]] < start:
            end -= 1
        return end


def enclosed(text: str, at: int) -> tuple[list[tuple[int, int]], int] | None:
    """The string literals between the bracket that ends before `at` and the one that closes it, and where that is.

    Names of variables in the environment are no literals. A bracket that never closes encloses nothing; neither
    does one that closes far behind.
    """
    parts, depth, stop = [], 1, min(len(text), at + FARTHEST)
    while at < stop:
        if m := WHOLE_STRING.match(text, at):
            a, b = inside(m)
            if b > a and not ENV_NAME.fullmatch(text, a, b):
                parts.append((a, b))
            at = m.end()
            continue
        if m := BRACKET.match(text, at):
            depth += 1 if m.group() in "([{" else -1
            if not depth:
                return parts, m.end()
        at += 1
    return None


def followed(text: str, m: re.Match | None) -> bool:
    """Whether a match is the name of another assignment."""
    return bool(m and ASSIGNED.match(text, m.end()))


def value_at(text: str, at: int, op: str, bound: dict[str, Value], run: Run) -> tuple[list, int, int | None]:
    """Parts of the value that begins at `at`, where it ends, and where it starts if it is one unquoted run."""
    if op == ":" and (m := BLOCK.match(text, at)):
        return *block(text, m.end(), indent(text, at - 1)), None
    start = ONWARD.match(text, at).end()
    gap = text[at:start]
    if "\n" in gap:
        if followed(text, WHOLE_STRING.match(text, start) or WHOLE_NAME.match(text, start)):
            return [], at, None
        # Without a quote, a later line belongs to a name only in brackets, after a backslash or indented below it.
        if not ("(" in gap or "\\" in gap or WHOLE_STRING.match(text, start)) and indent(text, start) <= indent(text, at - 1):
            return [], at, None
    parts, end, run_at = [], at, None
    while True:
        if m := WHOLE_STRING.match(text, start):
            if parts and followed(text, m):
                break
            parts.append(inside(m))
            end = m.end()
            # Strings side by side are one; in brackets also on later lines.
            while (n := WHOLE_STRING.match(text, (ONWARD if "(" in gap else BLANK).match(text, end).end())) and not followed(text, n):
                parts.append(inside(n))
                end = n.end()
        elif (m := WHOLE_NAME.match(text, start)) and m.group() in bound and ends_name(text, m.end(), bound):
            parts.append(bound[m.group()])
            end = m.end()
        elif not parts and (m := OPENED.match(text, start)) and (held := enclosed(text, m.end())):
            return *held, None
        elif start < len(text) and text[start] not in "[{,;" and not text[start].isspace():
            if parts and followed(text, WHOLE_NAME.match(text, start)):
                break
            if not parts and (m := SCHEME.match(text, start)) and m[1].lower() in SCHEMES:
                start = m.end()
            end = run.end(text, start)
            if not parts and (i := INSTEAD.match(text, end)) and (m := WHOLE_STRING.match(text, i.end())):
                return [inside(m)], m.end(), None
            if not parts and end > start and (end - start > 9 or text[start:end].lower() not in BUILTIN_TYPES):
                parts.append((start, end))
                run_at = start
        else:
            break
        if not (m := PLUS.match(text, end)):
            break
        start = m.end()
    return parts, end, run_at if len(parts) == 1 else None


def ends_name(text: str, end: int, bound: dict[str, Value]) -> bool:
    """Whether a bound name that ends here is a part by itself rather than the head of an unquoted run."""
    if ASSIGNED.match(text, end):
        return False
    if text.startswith("+", end):
        after = WHOLE_NAME.match(text, end + 1)
        return bool(BLANK.match(text, end + 1).end() > end + 1 or WHOLE_STRING.match(text, end + 1) or end + 1 == len(text) or text[end + 1] == "\n" or (after and after.group() in bound))
    return bool(NAME_ENDS.match(text, end))


def annotated(text: str, at: int) -> tuple[str, int] | None:
    """The type that stands between `:` and `=`, and the place behind the `=`."""
    if not (m := TYPED.match(text, at)):
        return None
    kind = m[1].strip()
    tight = m[1] == m[1].rstrip() and not (WHOLE_STRING.match(text, BLANK.match(text, m.end()).end()))
    if tight or not TYPE.fullmatch(BRACKETED.sub("", kind).strip()):
        return None
    return kind, m.end()


def bare(token: tuple[str, str]) -> str:
    return token[1].lstrip("rbfuRBFU").strip("\"'") if token[0] == "str" else token[1]


def targets(last: list[tuple[str, str]]) -> list[str]:
    """The names that an operator behind these tokens assigns to."""
    kinds, words = [k for k, _ in last], [w for _, w in last]
    if kinds[-1:] in (["str"], ["name"]):
        names = [bare(last[-1])]
        if names[0].lower() in BUILTIN_TYPES:  # `name type =`, `name []type =`
            k = -4 if words[-3:-1] == ["[", "]"] else -2
            names += [words[k]] if len(last) >= -k and kinds[k] == "name" else []
        return names
    if kinds[-1:] == ["raw"] and name_score(words[-1]):
        return words[-1:]
    if words[-1:] == ["]"]:  # `name[...] =`, `name[] =`
        if words[-2:-1] == ["["]:
            return [w for k, w in last[-3:-2] if k == "name"]
        if words[-3:-2] == ["["]:
            return [bare(x) for x in (*last[-4:-3], last[-2]) if x[0] in ("name", "str")]
    return []


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name.

    `name = part + part` binds the name to its literals; a part that is a bound name stands for
    the literals bound to it, so a constant is reported where it was written. `+=` adds to what is
    bound, a type between name and `=` is passed over, and a value may begin or go on in a later
    line. An unquoted value runs to white space, comma, semicolon or line end. What extends a
    secret that was reported is a secret. A list or a call stands for the literals in it, a word such as
    Bearer for what follows it, and a name that is bound only later for what it is bound to then.
    """
    bound: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    waiting: list[tuple[float, bool, str]] = []  # sensitive names that stand for a name which is bound later
    at, pos, run = 0, 0, Run()
    for line in text.split("\n"):
        pos, end = max(at, pos), at + len(line)
        at = end + 1
        if "=" not in line and ":" not in line:
            continue
        last: list[tuple[str, str]] = []
        open_quotes = ""
        while pos < end and (m := TOKENS[open_quotes].search(text, pos, end)):
            pos, op = m.end(), m.group()
            if op in QUOTED and op not in open_quotes:
                open_quotes = "".join(sorted(open_quotes + op))
            names = targets(last) if m.lastgroup == "op" and op in ASSIGNERS else []
            if not names:
                last = [*last[-3:], (m.lastgroup, op)]
                continue
            last, begin = [], pos
            if op == ":" and (typed := annotated(text, pos)):
                kind, begin = typed
                if kind.lower() not in BUILTIN_TYPES and WHOLE_NAME.fullmatch(kind) and (kind[0].islower() or name_score(kind)):
                    names.append(kind)
                op = "="
            while m := CHAINED.match(text, begin):
                names.append(m[1])
                begin = m.end()
            parts, pos, run_at = value_at(text, begin, op, bound, run)
            if not parts:
                continue
            reported = False
            if run_at is not None and (m := WHOLE_NAME.fullmatch(text, *parts[0])):
                waiting += [(s, takes_phrases(name), m.group()) for name in names if (s := name_score(name))]
            for name in names:
                mine = [bound[name], *parts] if op == "+=" and name in bound else parts
                value = bound[name] = mine[0] if len(mine) == 1 and isinstance(mine[0], Value) else Value(mine)
                if (s := name_score(name)) and not value.reported:
                    if any(isinstance(x, Value) and x.reported for x in value.parts) or s * value.looks_secret(text, takes_phrases(name)) >= MIN_SCORE:
                        found.update(x for x in value.new_spans() if x[1] > x[0])
                        value.reported = True
                reported |= value.reported
            if run_at is not None and not reported:
                # A run that is no secret may hold an assignment: `url: http://host?key=value`.
                pos = run_at
                if run_at < end:
                    m = TOKENS[open_quotes].match(text, run_at, end)
                    pos, last = m.end(), [(m.lastgroup, m.group())]
    for score, phrases, name in waiting:
        value = bound.get(name)
        if value and not value.reported and score * value.looks_secret(text, phrases) >= MIN_SCORE:
            found.update(x for x in value.new_spans() if x[1] > x[0])
            value.reported = True
    return sorted(found)


def tagged(text: str) -> list[tuple[int, int]]:
    """Contents of elements with a sensitive name."""
    return [
        m.span(2) for m in TAG.finditer(text)
        if name_score(m[1]) * literal_score(m[2].strip(), takes_phrases(m[1])) >= MIN_SCORE
    ]


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of all spans in order, and the character ranges that hold the secrets."""
    spans, values = [], []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    values += [(a, b) for a, k, b in spans if k]
    extra = lexed(text) if "=" in text or ":" in text else []
    if "</" in text:
        extra = sorted({*extra, *tagged(text)})
    if extra:
        spans += [(a, 3, b) for a, b in extra]
        values += extra
    return sorted(spans), values


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with each secret value replaced; overlapping values become one mark."""
    out, at = [], 0
    for a, b in sorted(spans_of(text)[1]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if out else text


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of base spans, their digest, and all spans."""

    def kernel(ids, texts):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in texts:
            spans = spans_of(text)[0] if text else []
            base = [x for x in spans if x[1] < 3]
            for i, k in enumerate(("n_assign", "n_access", "n_hex")):
                out[k].append(sum(x[1] == i for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return {"doc_id": ids} | out

    return map_texts(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The same rows and columns with secrets in the text replaced; null stays null.

    length_col, where given, is set to the new length of the text.
    """
    others = [c for c in df.columns if c not in (text_col, length_col)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in others)
    made = f"`{text_col}` string" + (f", `{length_col}` long" if length_col else "")

    def kernel(*columns):
        texts = [t and redacted(t) for t in columns[-1]]
        out = dict(zip([*others, text_col], [*columns[:-1], texts]))
        if length_col:
            out[length_col] = [None if t is None else len(t) for t in texts]
        return out

    return map_texts(df, kernel, f"{schema}, {made}" if others else made, [*others, text_col]).select(*df.columns)
