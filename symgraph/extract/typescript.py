"""Symbols, references, imports and re-exports of TypeScript and JavaScript text.

A tokenizer (comments, strings, templates, regular expressions) and a recogniser of declarations over the token list,
in plain Python; it runs on executors, a file at a time. Text that can't be read gives a skip reason, never an error.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from functools import cached_property, lru_cache
from itertools import accumulate, compress
from operator import itemgetter

from ..functions.predicates import CLASS_DECORATORS, MEMBER_DECORATORS

#: A token (word, operator, string, number), a comment, or last a character that takes more than a pattern. What matches
#: nothing, such as white space, separates; no match starts with a character of it.
TOKEN = re.compile(
    r"[A-Za-z_$][\w$]*|[{}()\[\];,<>:@#!&|+\-*%^~]|=>?|\?\.?|\.(?:\.\.)?|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|(?!\s)[¡-￿][\w$]*|\d[\w.]*|//[^\n]*|/\*.*?\*/|[`\"'/]",
    re.S,
)
PARTS = re.compile(f"({TOKEN.pattern})", re.S)
SPECIAL = {"`", '"', "'", "/"}


class Kinds(dict):
    """Kind of a token by its first character; that of a comment is empty."""

    def __missing__(self, c: str) -> str:
        return "word" if c <= "\uffff" else "number"


KINDS = Kinds({c: "word" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$"} | {c: "op" for c in "{}()[];,.<>:=?@#!&|+-*%^~"} | {c: "number" for c in "0123456789"} | {'"': "string", "'": "string", "/": ""})
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "get", "set", "accessor"}
RESERVED = {"break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "function", "if", "implements", "import", "in", "instanceof", "interface", "let", "new", "null", "of", "package", "private", "protected", "public", "return", "static", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with", "yield", "async", "await", "as", "is", "keyof", "readonly", "abstract", "declare", "type", "namespace", "module", "any", "unknown", "never", "string", "number", "boolean", "object", "undefined", "symbol", "bigint", "from", "get", "set", "satisfies", "infer", "asserts", "constructor", "require"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Kinds of a token that a statement can end or start with; words that one can't end with.
VALUES, GOING_ON = {"word", "string", "number"}, RESERVED - {"this", "true", "false", "null", "undefined"}
BRACKETS = {*OPEN, *CLOSE}
#: Tokens that may lead to an error or past a bracket: words of statements with a body, and type parameters, which are read to their end.
LEADING, DOTS = {"class", "interface", "enum", "namespace", "module", "<"}, {".", "?."}
#: Tokens that rows of a table start with, or before which they do, for DOTS.
ROWS = {"pending": DOTS, "imports": {"import", "require"}, "reexports": {"export"}}
#: Brackets in brackets up to which nothing runs out of Python's stack.
DEEP = 100
#: Tokens that start a statement other than an expression.
STARTS = {"import", "function", "class", "interface", "enum", "namespace", "module", "type", "const", "let", "var", "{"}
#: Tokens that a decorator goes on after: before a closing bracket or semicolon, it may go on behind that.
ENDLESS = {"@", "."}
PAD, NONE = [""] * 8, [False] * 8


class Unreadable(ValueError):
    pass


def tokenize(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end); a template is one string token, with the tokens of its expressions after it."""
    return list(zip(*_tokens(text, PARTS.split(text)), strict=True))


def _tokens(text: str, parts: list[str]) -> tuple[list, list, list, list]:
    """tokenize(text) by columns; parts are what stands between matches, and the matches."""
    texts, offsets = parts[1::2], list(accumulate(map(len, parts)))
    kinds, starts, ends = _kinds(texts), offsets[:-1:2], offsets[1::2]
    special = [i for i, t in enumerate(texts) if t in SPECIAL]
    out, i, p = ([], [], [], []), 0, 0
    while True:  # from token i on, matches are tokens up to the next special character
        p = bisect_left(special, i, p)
        stop = special[p] if p < len(special) else len(texts)
        for column, of in zip(out, (kinds, texts, starts, ends), strict=True):
            column += compress(of[i:stop], kinds[i:stop])
        if stop == len(texts):
            return out
        at = _special(text, starts[stop], out)
        i = bisect_left(starts, at, stop)
        while ends[i - 1] > at:  # after a special character the rest may read otherwise, until a match starts where one did
            for m in TOKEN.finditer(text, at):
                start, t = m.start(), m.group()
                i = bisect_left(starts, start, i)
                if i < len(starts) and starts[i] == start:
                    at = start
                    break
                if t in SPECIAL:
                    at = _special(text, start, out)
                    i = bisect_left(starts, at, i)
                    break
                if kind := KINDS[t[0]]:
                    _add(out, kind, t, start, m.end())
            else:
                return out


def _add(out: tuple[list, list, list, list], *token) -> None:
    for column, x in zip(out, token, strict=True):
        column.append(x)


def _kinds(texts: list[str]) -> list[str]:
    return list(map(KINDS.__getitem__, map(itemgetter(0), texts)))


def _special(text: str, at: int, out: tuple[list, list, list, list]) -> int:
    """Adds the template, regular expression or slash at a place to out: the place after it."""
    if text[at] == "`":
        end, inner = _template(text, at)
        _add(out, "string", text[at:end], at, end)
        for a, b in inner:
            for k, t, s, e in tokenize(text[a:b]):
                _add(out, k, t, s + a, e + a)
        return end
    if text[at] != "/" or text.startswith("/*", at):
        raise Unreadable("unterminated literal")
    kind, last = (out[0][-1], out[1][-1]) if out[0] else ("op", "")
    m = REGEX.match(text, at) if (kind == "op" and last not in CLOSE) or last in ("return", "typeof", "case") else None
    end = m.end() if m else at + 1
    _add(out, "string" if m else "op", text[at:end], at, end)
    return end


def _template(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    i, inner = at + 1, []
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            return i + 1, inner
        elif text.startswith("${", i):
            depth, start, i = 1, i + 2, i + 2
            while i < len(text) and depth:
                if text[i] == "`":
                    i, _ = _template(text, i)
                    continue
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                i += 1
            inner.append((start, i - 1))
        else:
            i += 1
    raise Unreadable("unterminated template")


def camel(name: str) -> str:
    parts = [p for p in re.split(r"[_\-\s]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if p]
    return "".join(p if i == 0 else p[:1].upper() + p[1:] for i, p in enumerate(parts))


@lru_cache(4096)
def _mark(kind: str, is_static: bool | None, count: int) -> str:
    return "#" + hashlib.md5(f"{kind}:{'static' if is_static else 'instance'}:{count}".encode()).hexdigest()[:4]


@lru_cache(64)
def _noted(tables: tuple[str, ...]) -> frozenset[str]:
    return frozenset(BRACKETS).union(";", LEADING, *(ROWS[t] for t in tables))


class Context:
    __slots__ = ("container", "kind", "path", "scope")

    def __init__(self, container=None, kind=None, path=(), scope=()):
        self.container, self.kind, self.path, self.scope = container, kind, path, scope


class Extractor:
    """Reads one file; results in symbols, refs, pending, imports, reexports (lists of dicts).

    Of tables that aren't asked for, nothing is kept that rows of others don't need; plugins get everything. Without symbols
    and references, tokens among which no row starts are skipped, where reading them could not be an error either.
    """

    def __init__(self, uri: str, text: str, plugins=(), tables=("symbols", "refs")):
        self.uri, self.text, self.plugins = uri, text, plugins
        self.whole, self.refers = "symbols" in tables or bool(plugins), "refs" in tables or bool(plugins)
        self.named = self.whole or self.refers
        self.imports_, self.reexports_ = self.named or "imports" in tables, self.named or "reexports" in tables
        self._scan()
        self.skips = not self.named and self.texts[-1:] != ["@"] and "*" not in self.texts[-2:]
        self.marks, self.ends_ = [], []
        self.pair = self._pairs(_noted(tuple(tables)) if self.skips else BRACKETS)
        #: Beyond the ends, a token's text is empty and no word.
        self.words = (list(map(str.isidentifier, self.texts)) if self.text.isascii() and "$" not in self.text else [k == "word" for k in self.kinds]) + NONE
        self.texts += PAD
        self.symbols, self.refs, self.pending, self.imports, self.reexports = [], [], [], [], []
        self.seen, self.declared = set(), {}
        self.imported: set[str] = set()
        self.last = 0, 0, 0

    def _scan(self) -> None:
        """Kinds and texts of tokens, and what stands before each."""
        self.parts = PARTS.split(self.text)
        self.texts = self.parts[1::2]
        if "//" not in self.text and "/*" not in self.text and SPECIAL.isdisjoint(self.texts):
            self.n, self.gaps = len(self.texts), self.parts[::2]
            return
        self.kinds, self.texts, self.starts, self.ends = _tokens(self.text, self.parts)
        self.parts, self.n, self.gaps = None, len(self.texts), [self.text[a:b] for a, b in zip([0, *self.ends], self.starts, strict=False)]

    # kinds, places and tuples of tokens are made when they are asked for

    @cached_property
    def kinds(self) -> list[str]:
        return _kinds(self.texts[: self.n])

    @cached_property
    def starts(self) -> list[int]:
        return list(accumulate(map(len, self.parts)))[:-1:2]

    @cached_property
    def ends(self) -> list[int]:
        return list(accumulate(map(len, self.parts)))[1::2]

    @cached_property
    def tokens(self) -> list[tuple[str, str, int, int]]:
        return list(zip(self.kinds, self.texts[: self.n], self.starts, self.ends, strict=True))

    @cached_property
    def lines(self) -> list[int]:
        return [0] + [m.end() for m in re.finditer("\n", self.text)]

    @cached_property
    def file(self) -> str:
        return hashlib.md5(self.uri.encode()).hexdigest()[:8]

    def t(self, i: int) -> str:
        """Text of a token, empty beyond the ends."""
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.words) and self.words[i]

    def _pairs(self, noted) -> dict[int, int]:
        """The other bracket of each; marks, which are places of noted tokens, and semicolons outside of brackets."""
        pair, stack, texts = {}, [], self.texts
        for i, t in enumerate(texts):
            if t not in noted:
                continue
            if t in OPEN:
                stack.append(i)
                if len(stack) > DEEP:
                    self.skips = False
            elif t in CLOSE:
                if not stack or OPEN[texts[stack[-1]]] != t:
                    raise Unreadable("brackets do not match")
                if texts[i - 1] in ENDLESS:
                    self.skips = False
                pair[stack[-1]] = i
                pair[i] = stack.pop()
            elif t == ";":
                if texts[i - 1] in ENDLESS:
                    self.skips = False
                if not stack:
                    self.ends_.append(i)
            else:
                self.marks.append(i + (t in DOTS))
                if t == "require":  # one after the end of a declaration counts as its value
                    self.marks.append(i - 2)
        if stack:
            raise Unreadable("bracket is not closed")
        self.marks.sort()
        return pair

    def idle(self, i: int, end: int) -> bool:
        """Whether tokens from i to end, which are whole statements, expressions or parameters, can be skipped."""
        return self.skips and ((p := bisect_left(self.marks, i)) == len(self.marks) or self.marks[p] >= end)

    def place(self, i: int) -> tuple[int, int]:
        """Line and character of a token, counted from the place asked for before if that isn't later."""
        read, line, character = self.last
        if self.parts is None or 2 * i < read:
            return self.at(self.starts[i])
        text = "".join(self.parts[read : 2 * i + 1])
        breaks = text.count("\n")
        self.last = 2 * i + 1, line + breaks, len(text) - text.rindex("\n") - 1 if breaks else character + len(text)
        return self.last[1:]

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.lines, offset) - 1
        return line, offset - self.lines[line]

    def run(self) -> Extractor:
        end, c = self.n, Context()
        if self.skips and self.marks and (p := bisect_left(self.ends_, self.marks[0])):
            self.block(self.ends_[p - 1] + 1, end, c)  # a statement starts after the last semicolon before the first mark
        else:
            self.block(0, end, c)
        return self

    # --- output

    def symbol(self, name: str, kind: str, where: int, first: int, last: int, c: Context, **more) -> dict:
        if self.refers:
            self.declared.setdefault("::".join(c.scope) or "<global>", set()).add(name)
        if not self.whole:
            return {}
        (line, character), a, b = self.at(self.starts[where]), self.at(self.starts[first]), self.at(self.ends[last])
        path = ".".join(c.path)
        ident = f"{self.file}:{path + '.' if path else ''}{name}"
        if kind in ("method", "function"):
            ident += _mark(kind, more.get("is_static"), more.get("parameters_count") or 0)
        out = {
            "uri": self.uri, "ordinal": len(self.symbols), "id": ident, "name": name, "kind": kind, "line": line, "character": character,
            "start_line": a[0], "start_character": a[1], "end_line": b[0], "end_character": b[1],
            "container_name": c.container, "container_kind": c.kind, "full_container_path": path or None, "is_static": None, "is_definition": True,
            "is_exported": False, "parameters_count": None, "visibility": None, "implements": None, "extends": None, "ngrx": None, "metadata": None,
        } | more
        self.symbols.append(out)
        for p in self.plugins:
            extra = p.visit(out, self, first, last) or {}
            if extra.get("metadata"):
                out["metadata"] = json.dumps(json.loads(out["metadata"] or "{}") | extra["metadata"], sort_keys=True)
            self.symbols += extra.get("symbols", ())
            self.refs += extra.get("references", ())
        return out

    def ref(self, i: int, c: Context, is_import: bool | None = None) -> None:
        if not self.refers:
            if i >= self.n:
                raise IndexError(i)
            return
        start = self.starts[i]
        if start in self.seen:
            return
        self.seen.add(start)
        name, (line, character), stop = self.texts[i], self.at(start), self.at(self.ends[i])
        scope = "::".join(c.scope) or "<global>"
        self.refs.append({
            "uri": self.uri, "symbol_name": name, "line": line, "character": character, "start_line": line, "start_character": character, "end_line": stop[0], "end_character": stop[1],
            "container_name": c.container, "is_import": name in self.imported if is_import is None else is_import, "scope_id": scope, "is_local": name in self.declared.get(scope, ()),
        })

    # --- statements

    def block(self, i: int, end: int, c: Context) -> None:
        while i < end and not self.idle(i, end):
            i = self.statement(i, end, c)

    def statement(self, i: int, end: int, c: Context) -> int:
        T, W, pair = self.texts, self.words, self.pair
        first, flags, decorators = i, set(), []
        while i < end and (T[i] == "@" or (T[i] in MODIFIERS and W[i + 1]) or (T[i] == "export" and T[i + 1] in ("{", "*"))):
            if T[i] == "@":
                i = self.decorator(i, c, decorators)
                continue
            if T[i] == "export" and T[i + 1] in ("{", "*"):
                return self.export_list(i + 1, end, c)
            flags.add(T[i])
            i += 1
        t, exported = T[i], "export" in flags
        if t not in STARTS:
            stop = self.line_end(i, end)
            self.expression(i, stop, c)
            return max(stop, i + 1)
        if t == "import" and T[i + 1] not in ("(", "."):
            return self.import_(i, end, c)
        if t == "function":
            i += 2 if T[i + 1] == "*" else 1
            if W[i] and T[i] not in RESERVED:
                return self.function(T[i], "function", i, first, i + 1, end, c, is_exported=exported)
        if t == "class" and W[i + 1]:
            return self.class_(i + 1, first, end, c, exported, decorators)
        if t in ("interface", "enum", "namespace", "module") and W[i + 1] and T[i + 2] in ("{", "extends", "<", "."):
            return self.braced(t, i + 1, first, end, c, exported)
        if t == "type" and W[i + 1] and T[i + 2] in ("=", "<"):
            stop = self.line_end(i + 2, end)
            self.symbol(T[i + 1], "type", i + 1, first, stop - 1, c, is_exported=exported)
            self.types(i + 2, stop, Context(T[i + 1], "type", c.path, c.scope))
            return stop
        if t in ("const", "let", "var") and T[i + 1] != "enum":
            return self.variables(i + 1, end, c, "constant" if t == "const" else "variable", exported)
        if t == "const":
            return self.braced("enum", i + 2, first, end, c, exported)
        if t == "{":
            self.block(i + 1, pair[i], c)
            return pair[i] + 1
        stop = self.line_end(i, end)
        self.expression(i, stop, c)
        return max(stop, i + 1)

    def line_end(self, i: int, end: int) -> int:
        """Past the ; that ends the statement, or at the line break where it can't go on."""
        T, pair, gaps = self.texts, self.pair, self.gaps
        start = i
        while i < end:
            t = T[i]
            if t == ";":
                return i + 1
            if t in CLOSE:
                return i + (i == start)
            nxt = pair[i] + 1 if t in OPEN else i + 1
            if nxt < end and "\n" in gaps[nxt]:
                a, b, before, after = self.kinds[nxt - 1], self.kinds[nxt], T[nxt - 1], T[nxt]
                ends = a in VALUES or before in ")]}"
                starts = (b in VALUES and after not in ("instanceof", "in", "as", "of", "extends", "else", "catch", "finally", "satisfies")) or after in ("{", "@", "}")
                if ends and starts and before not in GOING_ON:
                    return nxt
            i = nxt
        return end

    def decorator(self, i: int, c: Context, names: list[str]) -> int:
        T, pair = self.texts, self.pair
        names.append(T[i + 1])
        self.ref(i + 1, c)
        i += 2
        while T[i] == ".":
            i += 2
        if T[i] == "(":
            self.expression(i + 1, pair[i], c)
            i = pair[i] + 1
        return i

    def import_(self, i: int, end: int, c: Context) -> int:
        T, W, pair = self.texts, self.words, self.pair
        stop = self.line_end(i, end)
        if not self.imports_ and stop + 2 <= self.n:  # nearer to the end, names may be missing, which is an error
            return stop
        module = next((T[k][1:-1] for k in range(stop - 1, i, -1) if self.kinds[k] == "string"), None)
        k = i + 1 + (T[i + 1] == "type" and W[i + 2] and T[i + 2] != "from")

        def add(local: int, **more):
            self.imported.add(T[local])
            self.imports.append({"uri": self.uri, "ordinal": len(self.imports), "local_name": T[local], "module_specifier": module, "is_default": None, "is_namespace": None, "exported_name": None, "is_dynamic": None, "is_cjs": None} | more)
            self.ref(local, c, True)

        while module is not None and k < stop and T[k] != "from":
            if T[k] == "*":
                add(k + 2, is_namespace=True)
                k += 3
            elif T[k] == "{":
                j, close = k + 1, pair[k]
                while j < close:
                    j += T[j] == "type" and W[j + 1] and T[j + 1] != "as"
                    if T[j + 1] == "as":
                        add(j + 2, exported_name=T[j])
                        j += 3
                    elif W[j]:
                        add(j)
                        j += 1
                    else:
                        j += 1
                k = close + 1
            elif W[k]:
                add(k, is_default=True)
                k += 1
            else:
                k += 1
        return stop

    def export_list(self, i: int, end: int, c: Context) -> int:
        T, W, pair = self.texts, self.words, self.pair
        stop = self.line_end(i, end)
        if not self.reexports_:
            return stop
        module = next((T[k][1:-1] for k in range(i, stop) if T[k - 1] == "from" and self.kinds[k] == "string"), None)
        names = [k for k in range(i + 1, pair[i]) if W[k] and T[k] != "as"] if T[i] == "{" else []
        if module is None:
            for k in names:
                if T[k - 1] != "as":
                    self.ref(k, c)
                    for s in self.symbols:
                        if s["name"] == T[k] and s["container_name"] is None:
                            s["is_exported"] = True
        else:
            shown = [T[k] for k in names if T[k + 1] != "as"]
            self.reexports.append({"uri": self.uri, "ordinal": len(self.reexports), "module_specifier": module, "is_all": T[i] == "*" or None, "exported_names": shown or None})
        return stop

    def parameters(self, i: int, c: Context) -> tuple[int, int]:
        """Reads (...) at i: number of parameters, and the place after it; types and defaults are references."""
        T, W, pair = self.texts, self.words, self.pair
        close, count, k, fresh = pair[i], 0, i + 1, True
        if self.idle(k, close):
            return 0, close + 1
        while k < close:
            t = T[k]
            if fresh:
                while T[k] in MODIFIERS and W[k + 1]:
                    k += 1
                if T[k] == "@":
                    k = self.decorator(k, c, [])
                    continue
                count, fresh, t = count + 1, False, T[k]
                k = pair[k] + 1 if t in ("{", "[") else k + 1 + (t == "...")
                continue
            if t == ",":
                fresh, k = True, k + 1
                continue
            stop = k
            while stop < close and T[stop] != ",":
                stop = pair[stop] + 1 if T[stop] in OPEN else stop + 1
            self.types(k, stop, c) if t in (":", "?") else self.expression(k, stop, c)
            k = stop
        return count, close + 1

    def function(self, name: str, kind: str, where: int, first: int, i: int, end: int, c: Context, **more) -> int:
        T, pair = self.texts, self.pair
        inner = Context(name, kind, c.path, (*c.scope, name)) if kind == "function" else c
        if T[i] == "<":
            i = self.angle(i, inner)
        mark = len(self.symbols)
        out = self.symbol(name, kind, where, first, where, c, **more)
        count, i = self.parameters(i, inner) if T[i] == "(" else (0, i)
        stop = i
        while stop < end and T[stop] not in ("{", ";") and not (stop > i and "\n" in self.gaps[stop]):
            stop += 1
        self.types(i, stop, inner)
        if T[stop] == "{":
            self.block(stop + 1, pair[stop], inner)
            stop = pair[stop]
        last = min(stop, end - 1) if T[stop] in ("}", ";") else stop - 1
        if self.whole:
            self.symbols[mark].update(self._spanned(out, last, count))
        return last + 1

    def _spanned(self, s: dict, last: int, count: int) -> dict:
        line, character = self.at(self.ends[last])
        return {"end_line": line, "end_character": character, "parameters_count": count, "id": s["id"].rpartition("#")[0] + _mark(s["kind"], s["is_static"], count)}

    def angle(self, i: int, c: Context) -> int:
        T = self.texts
        depth, k = 0, i
        while k < self.n:
            depth += {"<": 1, ">": -1}.get(T[k], 0)
            k += 1
            if depth == 0:
                break
        self.types(i + 1, k - 1, c)
        return k

    def heritage(self, i: int, c: Context) -> tuple[str | None, list[str], int]:
        T, W, pair = self.texts, self.words, self.pair
        extends, implements, mode = None, [], None
        while T[i] != "{" and i < self.n:
            t = T[i]
            if t in ("extends", "implements"):
                mode, i = t, i + 1
            elif t == "<":
                i = self.angle(i, c)
            elif t == "(":
                self.expression(i + 1, pair[i], c)
                i = pair[i] + 1
            elif W[i]:
                if mode == "extends" and T[i - 1] != ".":
                    extends = extends or t
                elif mode == "implements" and T[i - 1] != ".":
                    implements.append(t)
                if mode and T[i - 1] != ".":
                    self.ref(i, c)
                i += 1
            else:
                i += 1
        return extends, implements, i

    def class_(self, i: int, first: int, end: int, c: Context, exported: bool, decorators: list[str]) -> int:
        T, pair = self.texts, self.pair
        name = T[i]
        inner = Context(name, "class", (*c.path, name), c.scope)
        extends, implements, body = self.heritage(i + 1, c)
        if body >= end:
            raise Unreadable("class without body")
        close, more = pair[body], {}
        marks = [d for d in decorators if d in CLASS_DECORATORS and self.whole]
        if marks:
            more["metadata"] = json.dumps({"angular": {"decorators": marks}})
        if self.whole and "Action" in implements and any(T[k] == "readonly" and T[k + 1] == "type" for k in range(body, close)):
            typed = next((T[k + 3][1:-1] for k in range(body, close) if T[k] == "type" and T[k + 1] == "=" and self.kinds[k + 2] == "string" for k in (k - 1,)), None)
            more["ngrx"] = {"type": typed, "role": "action", "is_group": False, "events": None}
        self.symbol(name, "class", i, first, close, c, is_exported=exported, extends=extends, implements=implements or None, **more)
        k = body + 1
        while k < close and not self.idle(k, close):
            k = self.member(k, close, inner)
        return close + 1

    def member(self, i: int, end: int, c: Context) -> int:
        T, W, pair = self.texts, self.words, self.pair
        first, flags, decorators, more = i, set(), [], {}
        while i < end and (T[i] == "@" or (T[i] in MODIFIERS and T[i + 1] not in ("(", "=", ":", ";", "?", "!", "<"))):
            if T[i] == "@":
                i = self.decorator(i, c, decorators)
            else:
                flags.add(T[i])
                i += 1
        if T[i] in (";", ",", "*"):
            return i + 1
        if T[i] == "{":
            self.block(i + 1, pair[i], c)
            return pair[i] + 1
        if T[i] == "[":
            self.expression(i + 1, pair[i], c)
            return self.line_end(i, end)
        where = i + (T[i] == "#")
        name, k = T[where].strip("'\""), where + 1
        if not W[where] and self.kinds[where] != "string":
            return max(self.line_end(i, end), i + 1)
        if self.whole:
            more = {"is_static": "static" in flags, "visibility": next((v for v in ("private", "protected", "public") if v in flags), None)}
            marks = [d for d in decorators if d in MEMBER_DECORATORS]
            if marks:
                more["metadata"] = json.dumps({"angular": {"decorators": marks}})
        k += T[k] in ("?", "!")
        if T[k] in ("(", "<"):
            return self.function(name, "method", where, first, k, end, c, **more)
        stop = self.line_end(k, end)
        if self.whole and ("Effect" in decorators or any(T[x] == "createEffect" for x in range(k, min(stop, k + 3)))):
            more["ngrx"] = {"type": None, "role": "effect", "is_group": False, "events": None}
        self.symbol(name, "property", first, first, max(stop - 1 - (T[stop - 1] == ";"), where), c, **more)
        inner = Context(name, "property", c.path, c.scope)
        cut = k
        while cut < stop and T[cut] != "=":
            cut = pair[cut] + 1 if T[cut] in OPEN else cut + 1
        self.types(k, cut, inner)
        self.expression(cut + 1, stop, inner)
        return stop

    def braced(self, kind: str, i: int, first: int, end: int, c: Context, exported: bool) -> int:
        T, pair = self.texts, self.pair
        name = T[i]
        path = c.path if kind not in ("interface", "enum", "namespace", "module") else (*c.path, name)
        inner = Context(name, kind, path, c.scope)
        extends, implements, body = self.heritage(i + 1, c)
        if body >= end:
            raise Unreadable(f"{kind} without body")
        close = pair[body]
        if kind in ("interface", "enum"):
            self.symbol(name, kind, i, first, close, c, is_exported=exported, extends=extends, implements=implements or None)
            self.types(body + 1, close, inner)
        else:
            self.block(body + 1, close, inner)
        return close + 1

    def variables(self, i: int, end: int, c: Context, kind: str, exported: bool) -> int:
        T, W, pair = self.texts, self.words, self.pair
        stop = self.line_end(i, end)
        if self.idle(i, stop):
            return stop
        while i < stop:
            cut = i
            while cut < stop and T[cut] not in (",", ";"):
                cut = pair[cut] + 1 if T[cut] in OPEN else (self.skip_angle(cut, stop) if T[cut] == "<" else cut + 1)
            eq = i + 1
            while eq < cut and T[eq] != "=":
                eq = pair[eq] + 1 if T[eq] in OPEN else eq + 1
            if T[i] == "{" or T[i] == "[":
                self.require(i, eq, cut, c)
                eq = max(eq, pair[i] + 1)
                self.expression(eq + 1, cut, c)
            elif W[i]:
                if self.named:
                    name = T[i]
                    more = self.store_call(eq + 1, cut)
                    self.symbol(name, kind, i, i, i, c, is_exported=exported, **({"ngrx": more} if more else {}))
                self.require(i, eq, cut, c)
                if self.named:
                    self.types(i + 1, eq, c)
                    if T[eq + 1] == "{" and pair[eq + 1] < cut:
                        self.keys(eq + 1, Context(name, kind, (*c.path, name), c.scope))
                    if more and more["is_group"]:
                        self.group(name, i, eq + 1, cut, c, more["events"])
                self.expression(eq + 1, cut, c)
            i = cut + 1
        return stop

    def skip_angle(self, i: int, stop: int) -> int:
        T = self.texts
        depth, k = 0, i
        while k < stop and T[k] not in (";", "{", "&"):
            depth += {"<": 1, ">": -1}.get(T[k], 0)
            k += 1
            if depth == 0:
                return k
        return i + 1

    def require(self, i: int, eq: int, cut: int, c: Context) -> None:
        T, W, pair = self.texts, self.words, self.pair
        if not self.imports_ or T[eq + 1] != "require" or T[eq + 2] != "(" or c.container is not None or self.kinds[eq + 3] != "string":
            return
        module, names = T[eq + 3][1:-1], []
        if T[i] == "{":
            k = i + 1
            while k < pair[i]:
                if W[k]:
                    renamed = T[k + 1] == ":"
                    names.append((T[k + 2] if renamed else T[k], T[k] if renamed else None))
                    k += 2 if renamed else 0
                k += 1
        elif W[i]:
            names.append((T[i], None))
        for local, exported in names:
            self.imported.add(local)
            self.imports.append({"uri": self.uri, "ordinal": len(self.imports), "local_name": local, "module_specifier": module, "is_default": None, "is_namespace": None, "exported_name": exported, "is_dynamic": None, "is_cjs": True})

    def keys(self, i: int, c: Context) -> None:
        """Property symbols of the object literal at i, nested with a dotted path."""
        T, pair = self.texts, self.pair
        for k in self.entries(i):
            name = T[k].strip("'\"")
            nested = T[k + 1] == ":" and T[k + 2] == "{"
            self.symbol(name, "property", k, k, pair[k + 2] if nested else k, c)
            self.seen.add(self.starts[k])
            if nested:
                self.keys(k + 2, Context(name, "property", (*c.path, name), c.scope))

    def entries(self, i: int):
        T, W, pair = self.texts, self.words, self.pair
        k, fresh = i + 1, True
        while k < pair[i]:
            if fresh and (W[k] or self.kinds[k] == "string") and T[k + 1] in (":", ",", "}", "("):
                yield k
            fresh = T[k] == ","
            k = pair[k] + 1 if T[k] in OPEN and self.kinds[k] == "op" else k + 1

    def store_call(self, i: int, cut: int) -> dict | None:
        T = self.texts
        t = T[i]
        if t == "createAction" and T[i + 1] == "(":
            return {"type": T[i + 2][1:-1] if self.kinds[i + 2] == "string" else None, "role": "action", "is_group": False, "events": None}
        if t == "createEffect":
            return {"type": None, "role": "effect", "is_group": False, "events": None}
        if t == "createActionGroup" and T[i + 1] == "(" and T[i + 2] == "{":
            source = events = None
            for k in self.entries(i + 2):
                if T[k] == "source" and self.kinds[k + 2] == "string":
                    source = T[k + 2][1:-1]
                if T[k] == "events" and T[k + 2] == "{":
                    names = [T[e].strip("'\"") for e in self.entries(k + 2)]
                    events = {camel(e): e for e in names}
            return {"type": source, "role": "action", "is_group": True, "events": events or {}}
        return None

    def group(self, name: str, where: int, i: int, cut: int, c: Context, events: dict) -> None:
        T = self.texts
        for k in self.entries(i + 2):
            if T[k] == "events" and T[k + 2] == "{":
                for e in self.entries(k + 2):
                    self.symbol(camel(T[e].strip("'\"")), "method", e, e, e, Context(name, "constant", (*c.path, name), c.scope))
                    self.seen.add(self.starts[e])

    # --- references

    def types(self, i: int, end: int, c: Context) -> None:
        """Names in type positions: leftmost name of a qualified one; member names are not references."""
        if not self.refers:
            return
        T, W = self.texts, self.words
        for k in range(i, end):
            if W[k] and T[k] not in RESERVED and T[k - 1] not in (".", "?.") and T[k + 1] not in (":", "?", "(") or (W[k] and T[k] not in RESERVED and T[k - 1] in (":", "|", "&", "<", "=", "extends")):
                if T[k - 1] in ("{", ";", ",") and T[k + 1] in ("=", ",", "}") and c.kind == "enum":
                    continue
                self.ref(k, c)

    def expression(self, i: int, end: int, c: Context) -> None:
        T, W, pair = self.texts, self.words, self.pair
        if self.idle(i, end):
            return
        while i < end:
            t = T[i]
            if t == "{":
                before = T[i - 1]
                if before in ("=>", ")", "else", "try", "finally", "do") or (before == "" and i == 0):
                    self.block(i + 1, pair[i], c)
                else:
                    self.literal(i, c)
                i = pair[i] + 1
            elif t == "(" and self.is_arrow(i):
                _, after = self.parameters(i, c)
                i = after
            elif t == "function":
                k = i + 1 + (T[i + 1] == "*")
                k += W[k]
                _, i = self.parameters(k, c) if T[k] == "(" else (0, k)
            elif t in ("const", "let", "var"):
                k = i + 1
                while k < end and T[k] not in ("of", "in", "=", ";"):
                    k = pair[k] + 1 if T[k] in OPEN else k + 1
                if W[i + 1]:
                    self.symbol(T[i + 1], "constant" if t == "const" else "variable", i + 1, i + 1, i + 1, c)
                i = k
            elif W[i] and T[i + 1] == "=>":
                i += 1
            elif W[i] and T[i - 1] in (".", "?."):
                base = i - 2
                if W[base] and T[base - 1] not in (".", "?.") and T[base] not in ("this", "super"):
                    line, character = self.place(i)
                    self.pending.append({"uri": self.uri, "container": T[base], "member": t, "line": line, "character": character, "container_name": c.container})
                    if self.refers and T[base] not in self.imported:
                        self.ref(i, c)
                elif self.refers:
                    self.ref(i, c)
                i += 1
            elif W[i] and t not in RESERVED:
                if self.refers:
                    self.ref(i, c)
                i += 1
            else:
                i += 1

    def literal(self, i: int, c: Context) -> None:
        T, W, pair = self.texts, self.words, self.pair
        k, fresh, close = i + 1, True, pair[i]
        if self.idle(k, close):
            return
        while k < close:
            if fresh and W[k] and T[k + 1] == ":":
                k, fresh = k + 2, False
                continue
            if fresh and W[k] and T[k + 1] == "(" and T[pair[k + 1] + 1] == "{":
                _, after = self.parameters(k + 1, c)
                self.block(after + 1, pair[after], c)
                k, fresh = pair[after] + 1, False
                continue
            stop = k
            while stop < close and T[stop] != ",":
                stop = pair[stop] + 1 if T[stop] in OPEN and self.kinds[stop] == "op" else stop + 1
            self.expression(k, stop, c)
            fresh, k = True, stop + 1

    def is_arrow(self, i: int) -> bool:
        T, pair = self.texts, self.pair
        k = pair[i] + 1
        if T[k] == ":":
            while k < self.n and T[k] not in ("=>", ";", ",", "{", ")"):
                k += 1
        return T[k] == "=>"


def extract(uri: str, text: str | None, plugins=(), tables=("symbols", "refs", "pending", "imports", "reexports"), hashed: bool = True) -> dict:
    """All row lists of one file, its hash, and why it was skipped, if it was; the lists of tables that aren't asked for are empty."""
    empty = {"symbols": [], "refs": [], "pending": [], "imports": [], "reexports": []}
    if text is None:
        return {"uri": uri, "hash": None, "skip_reason": "read error"} | empty
    found = {"uri": uri, "hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if hashed else None, "skip_reason": None}
    try:
        e = Extractor(uri, text, plugins, tables).run()
    except (Unreadable, RecursionError, IndexError, KeyError):
        return found | {"skip_reason": "Failed to parse AST"} | empty
    return found | empty | {k: getattr(e, k) for k in tables}
