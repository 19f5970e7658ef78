"""Syntax nodes of source files, from small fault-tolerant lexers; the one Python boundary of a scan.

A lexer finds tokens (comments and strings are no code), matches brackets, and derives the few node types that the
detections look at. Broken files give the nodes of their intact parts.

Output and work are linear in a file's size. Nodes and the contexts around them are intervals of the text (`start`,
`stop`), nested or apart; a context's text is never copied into a node, but cut out of the file for findings only. Whether
a context holds one of a language's marker words is told by position, in one pass over the text.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.rules.tables import CSHARP_METHODS, JS_METHODS
from cipherlake.shipping import ship_package

#: Characters of a call's own text; more of it is cut out of the file where a finding needs it.
HEAD = 256
#: Nodes that go out at once.
FLUSH = 4096
ANCESTOR = "struct<type:string,start:int,stop:int,marked:boolean,child_idents:array<string>>"
NODE_SCHEMA = (
    "file_path string, language string, text_id long, seq int, node_type string, text string, line_number int, column_start int, column_end int, "
    f"start int, stop int, root_module string, idents array<string>, segments array<string>, ancestors array<{ANCESTOR}>"
)
#: Words by which detections tell a context; `marked` says whether one lies within it, in any case.
MARKERS = {"javascript": JS_METHODS, "csharp": CSHARP_METHODS}
_ARROW_ANCESTOR = pa.struct([("type", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("marked", pa.bool_()), ("child_idents", pa.list_(pa.string()))])
_ARROW = pa.schema(
    [
        ("file_path", pa.string()), ("language", pa.string()), ("text_id", pa.int64()), ("seq", pa.int32()), ("node_type", pa.string()), ("text", pa.string()),
        ("line_number", pa.int32()), ("column_start", pa.int32()), ("column_end", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("root_module", pa.string()),
        ("idents", pa.list_(pa.string())), ("segments", pa.list_(pa.string())), ("ancestors", pa.list_(_ARROW_ANCESTOR)),
    ]
)


class Source:
    """A text with line starts, for positions in lines and byte columns."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.bytes = None
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            widths = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            # A lone surrogate is written as a question mark.
            widths[(codes >= 0xD800) & (codes < 0xE000)] = 1
            self.bytes = np.concatenate([[0], np.cumsum(widths)])

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        first = self.starts[self.line(at) - 1]
        return at - first if self.bytes is None else int(self.bytes[at] - self.bytes[first])

    def node(self, kind: str, a: int, b: int, head: int | None = None, **more) -> dict:
        """A node over text[a:b]; its own text is cut to `head` characters, if given."""
        own = self.text[a:b] if head is None else self.text[a : min(b, a + head)]
        return {"node_type": kind, "text": own.strip(), "line_number": self.line(a), "column_start": self.column(a), "column_end": self.column(b), "start": a, "stop": b, "_at": (a, -b), **more}


class Markers:
    """Where a text holds one of some words, whatever the case of their ASCII letters."""

    #: Letters that lower-case to ASCII ones elsewhere.
    _FOLDED = str.maketrans({"\u212a": "k", "\u0130": "i"})

    def __init__(self, text: str, words: tuple[str, ...]):
        found = [m.span(1) for m in self._each(words).finditer(text if text.isascii() else text.translate(self._FOLDED))] if words else []
        self.starts = [a for a, _ in found]
        # The least end of this and all later words.
        self.ends = list(itertools.accumulate((b for _, b in reversed(found)), min))[::-1]

    @staticmethod
    @functools.cache
    def _each(words: tuple[str, ...]) -> re.Pattern:
        """Finds the shortest word at each place, as that tells most intervals apart."""
        return re.compile(f"(?=({'|'.join(map(re.escape, sorted(words, key=len)))}))", re.IGNORECASE | re.ASCII)

    def within(self, a: int, b: int) -> bool:
        at = bisect.bisect_left(self.starts, a)
        return at < len(self.ends) and self.ends[at] <= b


# ── Python ────────────────────────────────────────────────────────────────────────────────────────────────────────

_PY_TOKEN = re.compile(r"#[^\n]*|[rRbBuUfFtT]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\[\s\S]|[^'\\\n])*'?)")
_NAME = r"[^\W\d]\w*"
_DOTTED = rf"{_NAME}(?:[ \t]*\.[ \t]*{_NAME})*"
_GAP = r"(?:[ \t]|\\\n)+"
_PY_IMPORT = re.compile(
    rf"(?m)(?:^|(?<=[;:]))[ \t]*(?:(?P<plain>import{_GAP}{_DOTTED}(?:{_GAP}as{_GAP}{_NAME})?(?:[ \t]*,[ \t]*(?:\\\n[ \t]*)?{_DOTTED}(?:{_GAP}as{_GAP}{_NAME})?)*)"
    rf"|(?P<from>from(?:{_GAP})?(?P<module>\.+[ \t]*(?:{_DOTTED})?|(?<=[ \t\n]){_DOTTED}){_GAP}import(?:{_GAP}|(?=[(*]))(?P<names>\([^)]*\)|\*|[^\n;()#]+)))"
)


def python_nodes(text: str) -> Iterator[dict]:
    """import and from-import statements: root module, imported names, and the segments of dotted names."""
    source = Source(text)
    # Line breaks within a string begin no statement.
    masked = _PY_TOKEN.sub(lambda m: (" " if m.group().startswith("#") else "\x00") * len(m.group()), text)
    for m in _PY_IMPORT.finditer(masked):
        if m["plain"]:
            a, b = m.span("plain")
            first = re.sub(r"\\\n", " ", m["plain"][6:]).split(",")[0].split()
            # An alias is the only plain identifier of an aliased import.
            root = first[-1] if "as" in first[1:-1] else re.split(r"\s*\.\s*", "".join(first))[0]
            yield source.node("import_statement", a, b, root_module=root, idents=[], segments=[])
            continue
        a, b = m.span("from")
        b = a + len(masked[a:b].rstrip(" \t,\\\n")) if not m["names"].startswith("(") else b
        module = re.sub(r"\s", "", m["module"])
        relative = module.startswith(".")
        names = re.sub(r"\\\n", " ", m["names"]).strip("()")
        idents = [w for part in names.split(",") for w in re.findall(_NAME, part) if w != "as"]
        segments = [] if relative else module.split(".")[1:]
        yield source.node("import_from_statement", a, b, root_module=None if relative else module.split(".")[0], idents=idents, segments=segments)


# ── Languages with brackets ───────────────────────────────────────────────────────────────────────────────────────

_COMMENT = r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_SHORT = r"\"(?:\\.|[^\"\\\n])*\"?"
_REST = r"(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<punct>=>|[^\s\w])"
_LEXERS = {
    "javascript": re.compile(rf"{_COMMENT}|(?P<template>`)|(?P<str>{_SHORT}|'(?:\\.|[^'\\\n])*'?)|{_REST}"),
    "java": re.compile(rf"{_COMMENT}|(?P<raw>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?)|(?P<str>{_SHORT})|{_REST}"),
    "go": re.compile(rf"{_COMMENT}|(?P<raw>`[^`]*`?|'(?:\\.|[^'\\\n])*'?)|(?P<str>{_SHORT})|{_REST}"),
    "csharp": re.compile(rf"{_COMMENT}|(?P<template>\$@\"|@\$\"|\$\")|(?P<raw>@\"(?:\"\"|[^\"])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<str>{_SHORT})|{_REST}"),
}
#: Of texts with code in them, by how they begin: what they hold up to their end or the next code, and how code begins.
_TEMPLATES = {
    "`": (re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*"), "`", "${"),
    '$"': (re.compile(r'(?:\\.|\{\{|\}\}|[^"\\{}\n])*'), '"', "{"),
    '$@"': (re.compile(r'(?:""|\{\{|\}\}|[^"{}])*'), '"', "{"),
    '@$"': (re.compile(r'(?:""|\{\{|\}\}|[^"{}])*'), '"', "{"),
}
_TEMPLATE_NODES = {"javascript": ("template_substitution", "template_string"), "csharp": ("interpolation", "interpolated_string_expression")}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_NO_CALLEE = {"if", "for", "while", "switch", "catch", "return", "function", "func", "with", "using", "lock", "foreach", "synchronized", "await", "typeof", "throw", "else", "in", "of", "case", "fixed", "import"}
_BEFORE_EXPRESSION = {"return", "await", "throw", "case", "in", "of", "typeof", "else", "new", "yield", "go", "defer", "do", "void", "delete", "not"}
_NAMES = {
    "javascript": ("call_expression", "arguments", "string", "new_expression"),
    "java": ("method_invocation", "argument_list", "string_literal", "object_creation_expression"),
    "go": ("call_expression", "argument_list", "interpreted_string_literal", "composite_literal"),
    "csharp": ("invocation_expression", "argument_list", "string_literal", "object_creation_expression"),
}


Token = tuple[str, int, int, str]


def tokens_of(text: str, language: str) -> tuple[list[Token], dict[int, tuple[int, int]]]:
    """(tokens, templates): kind, start, end and word of each token but comments. Code within a template is tokens between
    round brackets, and `templates` has the template's first and last token by such an opening bracket's.

    JavaScript's regular expressions are told from divisions by what stands before them.
    """
    lexer = _LEXERS[language]
    tokens: list[Token] = []
    templates: dict[int, tuple[int, int]] = {}
    #: Of each open template: how it begins, its first token, its code's opening brackets, and the braces open within.
    inside: list[list] = []
    at = 0

    def piece(start: int, after: int) -> int:
        """Goes on in the innermost template; gives the place after its end or after the beginning of code."""
        body, close, code = _TEMPLATES[inside[-1][0]]
        end = body.match(text, after).end()
        if text.startswith(code, end):
            tokens.append(("raw", start, end, text[start:end]))
            inside[-1][2].append(len(tokens))
            tokens.append(("punct", end, end + len(code), "("))
            return end + len(code)
        end += len(close) if text.startswith(close, end) else 0
        tokens.append(("raw", start, end, text[start:end]))
        _, first, openings, _ = inside.pop()
        templates.update(dict.fromkeys(openings, (first, len(tokens) - 1)))
        return max(end, after)

    while m := lexer.search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        word = m.group()
        if kind == "comment":
            continue
        if kind == "template":
            inside.append([word, len(tokens), [], 0])
            at = piece(start, at)
            continue
        if word == "/" and language == "javascript" and (not tokens or tokens[-1][0] == "punct" and tokens[-1][3] not in ")]}" or tokens[-1][3] in _BEFORE_EXPRESSION):
            if r := _REGEX.match(text, start):
                at = r.end()
                tokens.append(("raw", start, at, r.group()))
                continue
        if inside and word == "{":
            inside[-1][3] += 1
        elif inside and word == "}":
            if not inside[-1][3]:
                tokens.append(("punct", start, at, ")"))
                at = piece(at, at)
                continue
            inside[-1][3] -= 1
        tokens.append((kind, start, at, word))
    while inside:  # a file that ends within a template
        _, first, openings, _ = inside.pop()
        templates.update(dict.fromkeys(openings, (first, len(tokens) - 1)))
    return tokens, templates


class Brackets:
    """Tokens, bracket pairs and calls of one text."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.tokens, self.templates = tokens_of(text, language)
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self.parent = [-1] * len(self.tokens)
        stack: list[int] = []
        waiting = dict.fromkeys("([{", 0)
        for i, (kind, _, _, s) in enumerate(self.tokens):
            if kind == "punct" and s in "([{":
                self.parent[i] = stack[-1] if stack else -1
                stack.append(i)
                waiting[s] += 1
                continue
            if kind == "punct" and s in ")]}" and waiting[_PAIRS[s]]:
                while self.tokens[stack[-1]][3] != _PAIRS[s]:
                    waiting[self.tokens[stack.pop()][3]] -= 1
                self.close[stack[-1]], self.open[i] = i, stack[-1]
                waiting[self.tokens[stack.pop()][3]] -= 1
            self.parent[i] = stack[-1] if stack else -1
        self._first: dict[int, int] = {}
        self._statements()
        self.markers = Markers(text, MARKERS.get(language, ()))
        self.calls = {i: c for i in self.close if self.tokens[i][3] == "(" and (c := self._call(i))}

    def word(self, i: int) -> str:
        return self.tokens[i][3] if 0 <= i < len(self.tokens) else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "id"

    def _chain(self, i: int) -> int:
        """The first token of the expression chain that ends at token i. What is known of a chain's parts is kept."""
        passed = []
        while i not in self._first:
            passed.append(i)
            if self.word(i) in (")", "]") and i in self.open:
                start = self.open[i]
                if self.is_id(start - 1) and self.word(start - 1) not in _NO_CALLEE or self.word(start - 1) in (")", "]"):
                    i = start - 1
                    continue
                i = start
            if self.word(i - 1) == "." or self.word(i - 1) == "?" and self.word(i - 2) == ".":
                before = i - 2
                if before >= 0 and (self.is_id(before) or self.word(before) in (")", "]") or self.tokens[before][0] in ("str", "raw")):
                    i = before
                    continue
            self._first[i] = i
        first = self._first[i]
        self._first.update(dict.fromkeys(passed, first))
        return first

    def _call(self, i: int) -> dict | None:
        """The call whose arguments open at token i: type, first token, and child identifiers."""
        name = i - 1
        if self.word(name) == ">" and self.language in ("java", "csharp"):
            depth, k = 0, name
            while k >= 0 and (self.is_id(k) or self.word(k) in "<>,.?[]"):
                depth += {">": 1, "<": -1}.get(self.word(k), 0)
                if depth == 0:
                    name = k - 1
                    break
                k -= 1
        if not (self.is_id(name) and self.word(name) not in _NO_CALLEE or self.word(name) in (")", "]") and name in self.open):
            return None
        first = self._chain(name)
        call, _, _, creation = _NAMES[self.language]
        before = self.word(first - 1)
        if before == "new" and self.is_id(first - 1):
            return {"type": creation, "first": first - 1, "idents": []}
        if self.is_id(first - 1) and before not in _BEFORE_EXPRESSION and self.language != "go":
            if "\n" not in self.text[self.tokens[first - 1][2] : self.tokens[first][1]] or self.language != "javascript":
                return None  # a declaration: a type or `function` stands before the name
        if self.language == "go" and before == "func":
            return None
        if first == name and self.word(self.close[i] + 1) == "{" and self.language == "javascript" and self.word(first - 1) not in ("=", "(", ",", "return", "&", "|", "!"):
            return None  # a method definition
        idents = [self.word(name)] if self.is_id(name) else []
        if first < name and self.word(name - 1) == "." and self.is_id(name - 2):
            idents.insert(0, self.word(name - 2))
        return {"type": call, "first": first, "idents": idents}

    def span(self, first: int, last: int) -> tuple[int, int]:
        return self.tokens[first][1], self.tokens[last][2]

    def _statements(self) -> None:
        """For each token the first and last token of the statement around it, at its own bracket depth, and the
        statement's first equals sign at that depth."""
        n = len(self.tokens)
        self.begins, self.ends, self.equals = [0] * n, [0] * n, {}
        begin: dict[int, int] = {}
        for i in range(n):
            home = self.parent[i]
            begin.setdefault(home, home + 1)
            self.begins[i] = begin[home]
            word = self.word(i)
            if word == "=":
                self.equals.setdefault((home, begin[home]), i)
            if word in (";", "{") or word == "}" and i in self.open and self.word(i + 1) not in (".", ")", ","):
                begin[home] = i + 1
        end: dict[int, int] = {}
        for i in range(n - 1, -1, -1):
            home = self.parent[i]
            if self.word(i) == ";":
                end[home] = i
            elif home not in end:
                end[home] = (self.close.get(home, n) if home >= 0 else n) - 1
            self.ends[i] = end[home]

    def ancestors(self, i: int, limit: int = 6) -> list[dict]:
        """The nodes around token i, innermost first, as intervals of the text."""
        out: list[dict] = []

        def add(kind: str, a: int, b: int, idents: list[str] | None = None) -> None:
            x, y = self.span(a, b)
            out.append({"type": kind, "start": x, "stop": y, "marked": self.markers.within(x, y), "child_idents": idents or []})

        _, arguments, _, _ = _NAMES[self.language]
        at = i
        while len(out) < limit:
            home = self.parent[at]
            if home < 0 or self.word(home) == "{" and self._is_block(home):
                break
            end = self.close.get(home, len(self.tokens) - 1)
            if self.word(home) == "(":
                call = self.calls.get(home)
                if home in self.templates:
                    substitution, template = _TEMPLATE_NODES[self.language]
                    add(substitution, home, end)
                    add(template, *self.templates[home])
                    at = home
                    continue
                if call is None:
                    add("parenthesized_expression", home, end)
                    at = home
                    continue
                if self.language == "csharp":
                    add("argument", at, at)
                add(arguments, home, end)
                while call is not None and len(out) < limit:
                    add(call["type"], call["first"], end, call["idents"])
                    at = call["first"]
                    call = None
                    if self.word(end + 1) == "." and self.is_id(end + 2):
                        member, follow = end + 2, end + 3
                        if self.language in ("javascript", "csharp"):
                            add("member_expression" if self.language == "javascript" else "member_access_expression", at, member)
                        if self.word(follow) == "(" and follow in self.calls:
                            call, end = self.calls[follow], self.close[follow]
                            call = {**call, "idents": [self.word(member)]}
                continue
            if self.word(home) == "{" and self.language == "javascript":
                add("pair", max(home + 1, at - 2), at)
                add("object", home, end)
            else:
                add("array" if self.word(home) == "[" else "initializer", home, end)
            at = home
        if len(out) < limit:
            self._statement_ancestors(at, add)
        return out[:limit]

    def directive_place(self, i: int) -> bool:
        """Whether a `using` at token i stands where directives do: in no bracket but bodies of namespaces."""
        home = self.parent[i]
        while home != -1:
            if self.word(home) != "{":
                return False
            k = home - 1
            while self.is_id(k) and self.word(k) != "namespace" and self.word(k - 1) in (".", "namespace"):
                k -= 2 if self.word(k - 1) == "." else 1
            if self.word(k) != "namespace":
                return False
            home = self.parent[home]
        return True

    def _is_block(self, home: int) -> bool:
        before = self.word(home - 1)
        if self.language != "javascript":
            return before not in ("=", "]", ",", "(")
        return before not in ("=", "(", ",", ":", "[", "return", "?", "&", "|")

    def _statement_ancestors(self, at: int, add) -> None:
        a, b = self.begins[at], self.ends[at]
        equals = self.equals.get((self.parent[at], a))
        equals = equals if equals is not None and equals < at else None
        head = self.word(a)
        last = b - 1 if b > a and self.word(b) == ";" else b
        if self.language == "javascript":
            if head in ("const", "let", "var") and equals is not None:
                add("variable_declarator", equals - 1, last)
                add("variable_declaration" if head == "var" else "lexical_declaration", a, b)
            else:
                add("return_statement" if head == "return" else "expression_statement", a, b)
            return
        declared = equals is not None and equals - 1 > a and self.is_id(equals - 1) and self.word(equals - 2) != "."
        if self.language == "java":
            if declared:
                add("variable_declarator", equals - 1, last)
                field = any(self.word(k) in ("private", "public", "protected", "static") for k in range(a, min(a + 3, b + 1)))
                add("field_declaration" if field else "local_variable_declaration", a, b)
            else:
                add("return_statement" if head == "return" else "expression_statement", a, b)
        elif self.language == "csharp":
            if declared:
                add("variable_declarator", equals - 1, last)
                add("variable_declaration", a, last)
                add("local_declaration_statement", a, b)
            else:
                add("return_statement" if head == "return" else "expression_statement", a, b)
        if self.parent[at] >= 0 and self.parent[at] in self.close:
            add("block", self.parent[at], self.close[self.parent[at]])


def bracket_nodes(text: str, language: str) -> Iterator[dict]:
    """The node types that the language's detections read, in no particular order."""
    source, b = Source(text), Brackets(text, language)
    call, _, string, _ = _NAMES[language]
    tokens = b.tokens
    for opening, c in b.calls.items():
        if c["type"] == call and language != "java" or language == "csharp":
            yield source.node(c["type"], *b.span(c["first"], b.close[opening]), HEAD)
    ends = {";": [k for k, t in enumerate(tokens) if t[3] == ";"], "{": [k for k, t in enumerate(tokens) if t[3] == "{"], "str": [k for k, t in enumerate(tokens) if t[0] == "str"]}

    def next_of(what: str, i: int) -> int | None:
        """The first such token after token i, however far; None if there is none."""
        at = bisect.bisect_right(ends[what], i)
        return ends[what][at] if at < len(ends[what]) else None

    for i, (kind, start, end, word) in enumerate(tokens):
        if kind == "str" and language != "go":
            yield source.node(string, start, end, ancestors=b.ancestors(i))
        elif kind != "id" or b.word(i - 1) == ".":
            continue
        elif word == "import" and language == "javascript" and b.parent[i] == -1 and b.word(i + 1) not in ("(", "."):
            name, semicolon = next_of("str", i), next_of(";", i)
            if name is not None and (semicolon is None or name < semicolon):
                yield source.node("import_statement", start, tokens[name + 1][2] if b.word(name + 1) == ";" else tokens[name][2])
        elif word == "import" and language == "java" and b.parent[i] == -1 or word == "using" and language == "csharp" and b.word(i + 1) != "(" and b.directive_place(i):
            stop, brace = next_of(";", i), next_of("{", i)
            if stop is not None and (brace is None or stop < brace):
                yield source.node("import_declaration" if language == "java" else "using_directive", start, tokens[stop][2])
        elif word == "import" and language == "go" and b.parent[i] == -1:
            group = b.word(i + 1) == "("
            k, stop = (i + 2, b.close.get(i + 1, len(tokens))) if group else (i + 1, min(i + 3, len(tokens)))
            while k < stop:
                if tokens[k][0] in ("str", "raw"):
                    alias = k - 1 if b.is_id(k - 1) and b.word(k - 1) != "import" or b.word(k - 1) in (".", "_") else k
                    yield source.node("import_spec", tokens[alias][1], tokens[k][2])
                    if not group:
                        break
                k += 1


#: Extractors of further languages, by name; `register_extractor` adds to it.
_REGISTERED: dict[str, Callable[[str], Iterable[dict]]] = {}


def register_extractor(language: str, extract: Callable[[str], Iterable[dict]]) -> None:
    """Adds or replaces the function that gives the nodes of a text in the language."""
    _REGISTERED[language] = extract


def nodes_of(text: str, language: str, registered: Mapping[str, Callable[[str], Iterable[dict]]] | None = None) -> list[dict]:
    """A file's nodes in reading order, outer before inner."""
    family = "javascript" if language == "typescript" else language
    own = (_REGISTERED if registered is None else registered).get(language)
    found = list(own(text) if own else python_nodes(text) if family == "python" else bracket_nodes(text, family))
    found.sort(key=lambda n: n.pop("_at"))
    return found


def text_id() -> Column:
    """Tells texts of the same path apart."""
    return F.xxhash64("text")


def extract_nodes(files: DataFrame) -> DataFrame:
    """Nodes of (file_path, language, text). A file whose lexer fails, for want of memory too, gives none, as one bad file
    must not stop a scan; null texts are empty.

    Nodes go out in portions, and their number and size are linear in that of the file. Of a batch's equal texts, such as
    vendored copies, one is lexed.
    """

    registered = dict(_REGISTERED)  # goes to the executors with the function
    own = pa.schema([f for f in _ARROW if f.name not in ("file_path", "text_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Equal texts of a batch are lexed once; `at` has the place of their nodes in `rows`.
            at: dict[tuple, tuple[int, int]] = {}
            rows: list[dict] = []
            files: list[tuple[int, int, int]] = []

            def out() -> Iterator[pa.RecordBatch]:
                if not files:
                    return
                file, first, count = np.array(files, dtype=np.int64).T  # noqa: B023
                ends = np.cumsum(count)
                table = pa.RecordBatch.from_pylist(rows, schema=own)  # noqa: B023
                for start in range(0, int(ends[-1]), FLUSH):
                    place = np.arange(start, min(start + FLUSH, int(ends[-1])))
                    k = np.searchsorted(ends, place, side="right")
                    nodes, which = table.take(pa.array(first[k] + place - (ends - count)[k])), pa.array(file[k])
                    columns = {**dict(zip(own.names, nodes.columns, strict=True)), "file_path": batch.column(0).take(which), "text_id": batch.column(3).take(which)}  # noqa: B023
                    yield pa.RecordBatch.from_arrays([columns[name].cast(_ARROW.field(name).type) for name in _ARROW.names], schema=_ARROW)

            for k in range(batch.num_rows):
                language, text = batch.column(1)[k].as_py(), batch.column(2)[k].as_py() or ""
                if (language, text) not in at:
                    try:
                        nodes = nodes_of(text, language, registered)
                    except (IndexError, KeyError, ValueError, RecursionError, MemoryError):
                        nodes = []
                    if len(nodes) > FLUSH:  # large files go out by themselves, a portion at a time
                        path, name = batch.column(0)[k].as_py(), batch.column(3)[k].as_py()
                        for i in range(0, len(nodes), FLUSH):
                            part = [{"file_path": path, "language": language, "text_id": name, "seq": j, **n} for j, n in enumerate(nodes[i : i + FLUSH], i)]
                            yield pa.RecordBatch.from_pylist(part, schema=_ARROW)
                        continue
                    at[language, text] = len(rows), len(nodes)
                    rows += [{"language": language, "seq": i, **n} for i, n in enumerate(nodes)]
                first, count = at[language, text]
                if count:
                    files.append((k, first, count))
                if len(rows) >= FLUSH:
                    yield from out()
                    at, rows, files = {}, [], []
            yield from out()

    ship_package(files.sparkSession)
    return files.select("file_path", "language", "text", text_id().alias("text_id")).mapInArrow(run, NODE_SCHEMA)
