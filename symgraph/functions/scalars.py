"""Scalar functions of names, paths and scores, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAKS = "_-./\\"
#: Kinds in order of preference; others come last.
KIND_ORDER = ["class", "function", "interface", "enum", "type", "variable", "constant", "method", "property"]
SORT_DIGIT = {"function": "1", "method": "1", "class": "2", "interface": "2", "variable": "3", "constant": "3", "type": "4", "enum": "4"}
PROTOCOL_KINDS = {"file": 1, "module": 2, "namespace": 3, "package": 4, "class": 5, "method": 6, "property": 7, "field": 8, "constructor": 9, "enum": 10, "interface": 11, "function": 12, "variable": 13, "constant": 14, "string": 15, "number": 16, "boolean": 17, "array": 18, "object": 19, "key": 20, "null": 21, "enummember": 22, "struct": 23, "event": 24, "operator": 25, "typeparameter": 26}


def escape(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def boundary_characters(name: Column) -> Column:
    """Characters at camel-case boundaries: the first, an upper after a lower, a letter after a non-letter (ASCII)."""
    return F.array_join(F.regexp_extract_all(name, F.lit(r"(?s)(^.|(?<=[a-z])[A-Z]|(?<=[^A-Za-z])[A-Za-z])"), 1), "")


def acronym_match(name: Column, query: str) -> Column:
    return F.upper(boundary_characters(name)).rlike("(?s)" + ".*".join(escape(c) for c in query.upper()))


def _subsequence(name: Column, query: str) -> Column:
    """Score of the greedy case-insensitive subsequence match; null without a match."""
    n = F.char_length(name)
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("total"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        found = F.instr(F.substring(F.lower(name), s["last"] + 1, n), F.lower(c))

        def score(i: Column) -> Column:
            here, before = F.substring(name, i, F.lit(1)), F.substring(name, i - 1, F.lit(1))
            run = F.when(i == s["last"] + 1, s["run"] + 1).otherwise(0)
            camel = (here.rlike("[A-Z]") & before.rlike("[a-z]")) | (here.rlike("[A-Za-z]") & before.rlike("[^A-Za-z]"))
            total = s["total"] + 2 + run * 3 + F.when((i > 1) & camel, 5).otherwise(0) + F.when((i > 1) & before.isin(*WORD_BREAKS), 3).otherwise(0)
            total = total + F.greatest(F.lit(0.0), (1 - (i - 1) / n) * 2) + F.when(here == c, 1).otherwise(0)
            return F.struct(i.alias("last"), run.alias("run"), total.alias("total"), (s["ok"] & (found > 0)).alias("ok"))

        return F.transform(F.array(s["last"] + found), score)[0]

    return F.aggregate(F.array(*(F.lit(c) for c in query)), start, step, lambda s: F.when(s["ok"], F.least(F.lit(39.0), s["total"])))


def fuzzy_score(name: Column, query: str) -> Column:
    """100 equal, 90 equal but for case, 80 acronym, 70 prefix, 50 contains, up to 39 subsequence, null no match."""
    if not query:
        return F.lit(0.0)
    low = query.lower()
    return (
        F.when(name == query, 100.0)
        .when(F.lower(name) == low, 90.0)
        .when(acronym_match(name, query), 80.0)
        .when(F.lower(name).startswith(low), 70.0)
        .when(name.contains(query), 50.0)
        # only names that hold the characters in order come to the long expression
        .when(F.lower(name).rlike("(?s)" + ".*".join(escape(c) for c in low)), _subsequence(name, query))
    )


def directory(uri: Column) -> Column:
    last = F.substring_index(uri, "/", -1)
    return F.when(uri.contains("/"), F.left(uri, F.length(uri) - F.length(last) - 1)).otherwise(F.lit(""))


def in_modules(uri: Column) -> Column:
    return uri.contains("node_modules")


def in_build(uri: Column) -> Column:
    return uri.contains("/dist/") | uri.contains("/out/") | uri.contains("/build/")


def context_bonus(uri: Column, open_uris: list[str], current: str) -> Column:
    add = lambda test, n: F.when(test, n).otherwise(0)
    return add(uri.isin(open_uris), 100) + add(in_modules(uri), -50) + add(in_build(uri), -30) + add(directory(uri) == directory(F.lit(current)), 30) + add(uri.contains("/src/"), 10)


def kind_bonus(kind: Column) -> Column:
    return F.when(kind.isin("class", "interface", "enum"), 15).when(kind == "function", 10).otherwise(0)


def common_depth(a: Column, b: Column) -> Column:
    """Leading path segments in common."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def proximity(uri: Column, site: Column) -> Column:
    """Closeness of a definition's file to the call site's file."""
    return folder_proximity(uri, directory(uri), directory(site))


def folder_proximity(uri: Column, d: Column, s: Column) -> Column:
    """proximity from the folders d of the definition and s of the call site."""
    add = lambda test, n: F.when(test, n).otherwise(0)
    # of different folders, the first three segments are equal exactly if three or more are in common
    deep = F.substring_index(d, "/", 3) == F.substring_index(s, "/", 3)
    near = F.when(d == s, 100).when(d == directory(s), 70).when(directory(d) == directory(s), 50).when(deep, 30).otherwise(0)
    return near + add(in_modules(uri), -80) + add(in_build(uri), -40) + add(~in_modules(uri) & ~in_build(uri), 20) + add(uri.contains("/src/"), 10)


def hybrid_score(name: Column, kind: Column, container: Column, path: Column, static: Column, uri: Column, want: dict) -> Column:
    """Closeness of a symbol to a wanted one: want has name, kind, container, is_static, uri; None where not known."""
    add = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    score = F.lit(100)
    if want.get("kind"):
        score = score + F.when(kind == want["kind"], 50).when(kind.isin("function", "method", "property") & F.lit(want["kind"] == "method"), 30).otherwise(0)
    if want.get("container"):
        score = score + add(container == want["container"], 100) + add(path.endswith(want["container"]), 40)
    else:
        score = score + add(container.isNull(), 50)
    if want.get("is_static") is not None:
        score = score + F.when(static.isNull(), 0).when(static == want["is_static"], 30).otherwise(-50)
    return F.when(name != want["name"], -1000).otherwise(score + add(uri == want.get("uri"), 20))


def kind_rank(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in ((k, i + 1) for i, k in enumerate(KIND_ORDER)) for x in p)), kind), F.lit(999))


def protocol_kind(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in PROTOCOL_KINDS.items() for x in p)), F.lower(kind)), F.lit(13))


def sort_text(uri: Column, kind: Column, exported: Column, name: Column, current: str) -> Column:
    scope = F.when(uri == current, "0").when(exported, "1").otherwise("2")
    digit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in SORT_DIGIT.items() for x in p)), kind), F.lit("5"))
    return F.concat(scope, digit, F.lower(name))


def words_of(name: Column) -> Column:
    """Lower-cased parts of a name: at lower-upper changes, ``_``, ``-`` and white space."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")), r"[_\-\s]+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(words_of(name), _capital), "")


def camel_case(name: Column) -> Column:
    return F.array_join(F.transform(words_of(name), lambda w, i: F.when(i == 0, w).otherwise(_capital(w))), "")


def kebab_case(name: Column) -> Column:
    return F.array_join(words_of(name), "-")


def snake_case(name: Column) -> Column:
    return F.array_join(words_of(name), "_")


def normal_uri(uri: Column) -> Column:
    """Slashes forward, drive letter lower."""
    u = F.regexp_replace(uri, r"\\", "/")
    return F.when(u.rlike("^[A-Za-z]:"), F.concat(F.lower(F.substring(u, 1, 1)), u.substr(F.lit(2), F.char_length(u)))).otherwise(u)


def symbol_id(uri: Column, path: Column, name: Column, kind: Column, static: Column, parameters: Column) -> Column:
    """Stable under line shifts; not unique."""
    own = F.concat_ws(".", F.when(path != "", path), name)
    mark = F.concat(kind, F.lit(":"), F.when(static, "static").otherwise("instance"), F.lit(":"), F.coalesce(parameters, F.lit(0)).cast("string"))
    tail = F.when(kind.isin("method", "function"), F.concat(F.lit("#"), F.substring(F.md5(mark.cast("binary")), 1, 4))).otherwise("")
    return F.concat(F.substring(F.md5(uri.cast("binary")), 1, 8), F.lit(":"), own, tail)


def word_at(text: Column, offset: Column) -> Column:
    """The word at a 0-based offset, or just before it; null if none or if it starts with a digit."""
    # \z, since Java's $ also matches before a line end that closes the text
    left = F.regexp_extract(F.substring(text, F.lit(1), offset), r"[A-Za-z0-9_]*\z", 0)
    right = F.regexp_extract(F.substring(text, offset + 1, F.char_length(text)), "^[A-Za-z0-9_]*", 0)
    word = F.concat(left, right)
    return F.when(word.rlike("^[A-Za-z_]"), word)


def position_of(text: Column, offset: Column) -> Column:
    """struct(line, character) of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    line = F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.struct(line.alias("line"), F.char_length(F.substring_index(head, "\n", -1)).alias("character"))


def glob_regex(glob: str, match_base: bool = False) -> str:
    """A Java regex of a glob with **, *, ?, [..] and {a,b}; names without / match the base name if match_base."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + escape(c), i + 1
    return "^" + ("(?:.*/)?" if match_base and "/" not in glob else "") + out + "$"


def matches_any(uri: Column, globs: list[str], match_base: bool = False) -> Column:
    return uri.rlike("|".join(glob_regex(g, match_base) for g in globs)) if globs else F.lit(False)
