"""Regular-expression extraction: large TypeScript files, and languages without a parser here."""

from __future__ import annotations

import re
from bisect import bisect_right

# Patterns of the fast path and of the other languages; the first group is the name.
FAST = {
    "class": r"(?:export\s+)?class\s+([A-Z][a-zA-Z0-9_]*)",
    "function": r"(?:export\s+)?function\s+([a-zA-Z0-9_]+)\s*\(",
    "interface": r"(?:export\s+)?interface\s+([A-Z][a-zA-Z0-9_]*)",
    "type": r"(?:export\s+)?type\s+([A-Z][a-zA-Z0-9_]*)\s*=",
    "enum": r"(?:export\s+)?enum\s+([A-Z][a-zA-Z0-9_]*)",
    "const": r"(?:export\s+)?const\s+([a-zA-Z0-9_]+)\s*[:=]",
    "method": r"(?m)^\s*(?:public|private|protected|static|async)?\s*([a-zA-Z0-9_]+)\s*\([^)]*\)\s*[:{]",
}
LANGUAGES = {
    "java": [r"(?:public|private|protected)?\s*(?:static|final|abstract)?\s*class\s+(\w+)", r"(?:public|private|protected)?\s*interface\s+(\w+)", r"(?:public|private|protected)?\s*enum\s+(\w+)", r"(?:public|private|protected)?\s+(?:static\s+)?(?:\w+\s+)?(\w+)\s*\("],
    "go": [r"type\s+(\w+)\s+struct", r"type\s+(\w+)\s+interface", r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\("],
    "csharp": [r"(?:public|private|protected|internal)?\s*(?:static|sealed|abstract)?\s*class\s+(\w+)", r"(?:public|private|protected|internal)?\s*interface\s+(\w+)", r"(?:public|private|protected|internal)?\s*struct\s+(\w+)", r"(?:public|private|protected|internal)?\s+(?:static\s+)?(?:\w+\s+)?(\w+)\s*\("],
    "python": [r"class\s+(\w+)", r"def\s+(\w+)\s*\("],
    "rust": [r"(?:pub\s+)?struct\s+(\w+)", r"(?:pub\s+)?enum\s+(\w+)", r"(?:pub\s+)?fn\s+(\w+)", r"(?:pub\s+)?trait\s+(\w+)"],
    "cpp": [r"class\s+(\w+)", r"struct\s+(\w+)", r"(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*(?:const)?\s*\{"],
}
EXTENSIONS = {".java": "java", ".go": "go", ".cs": "csharp", ".py": "python", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp"}
#: Characters beyond which TypeScript is read by patterns only.
FAST_CHARS = 500_000
_MASK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def mask(text: str) -> str:
    """Comments and strings as spaces, offsets kept."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _row(uri: str, ordinal: int, name: str, kind: str, starts: list[int], at: int, end: int, **more) -> dict:
    line, stop = bisect_right(starts, at) - 1, bisect_right(starts, end) - 1
    where = (line, at - starts[line], stop, end - starts[stop])
    return {"uri": uri, "ordinal": ordinal, "name": name, "kind": kind, "line": where[0], "character": where[1], "start_line": where[0], "start_character": where[1], "end_line": where[2], "end_character": where[3]} | more


def fast_symbols(uri: str, text: str) -> list[dict]:
    clean, starts, out = mask(text), [0] + [m.end() for m in re.finditer("\n", text)], []
    for kind, pattern in FAST.items():
        for m in re.finditer(pattern, clean):
            out.append(_row(uri, len(out), m[1], kind, starts, m.start(1), m.end(1), is_definition=True, is_exported="export" in m[0]))
    return out


def text_definitions(uri: str, text: str, language: str) -> list[dict]:
    """Kind text; the position is where the match starts."""
    starts, out = [0] + [m.end() for m in re.finditer("\n", text)], []
    for pattern in LANGUAGES.get(language, ()):
        for m in re.finditer(pattern, text):
            out.append(_row(uri, len(out), m[1], "text", starts, m.start(), m.end(), is_definition=True))
    return out


def word_symbols(uri: str, text: str) -> list[dict]:
    out = []
    for n, line in enumerate(text.split("\n")):
        for w in re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b", line, re.A):
            at = line.index(w)
            out.append({"uri": uri, "ordinal": len(out), "name": w, "kind": "text", "line": n, "character": at, "start_line": n, "start_character": at, "end_line": n, "end_character": at + len(w), "is_definition": False})
    return out
