"""Predicates of files, symbols and framework code, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import matches_any

# Lists that decide what is indexed and what counts as used by a framework.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".json", ".md", ".txt", ".yml", ".yaml", ".java", ".go", ".cs", ".py", ".rs", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp"]
EXCLUDED_PARTS = ["vscode-userdata:", "github.copilot-chat", "commandEmbeddings.json", ".vscode/extensions", ".vscode-test", "User/globalStorage", "User/workspaceStorage", "/.angular/", "/.nx/", "/dist/", "/coverage/", "/node_modules/"]
UNANALYSED_PARTS = ["node_modules", "dist/", "out/", "build/", ".angular/", ".nx/"]
TEST_PARTS = [".test.", ".spec.", "/test/", "/tests/", "/__tests__/"]
ENTRY_POINTS = ["**/main.ts", "**/public-api.ts", "**/index.ts", "**/*.stories.ts", "**/*.spec.ts", "**/*.test.ts", "**/test/**", "**/tests/**"]
EXPORTABLE_KINDS = ["class", "interface", "function", "type", "enum", "constant", "variable"]
LIFECYCLE = ["ngOnInit", "ngOnChanges", "ngDoCheck", "ngAfterContentInit", "ngAfterContentChecked", "ngAfterViewInit", "ngAfterViewChecked", "ngOnDestroy", "OnInit", "OnChanges", "DoCheck", "AfterContentInit", "AfterContentChecked", "AfterViewInit", "AfterViewChecked", "OnDestroy"]
CLASS_DECORATORS = ["Component", "Directive", "Injectable", "NgModule", "Pipe"]
MEMBER_DECORATORS = ["Input", "Output", "ViewChild", "ViewChildren", "ContentChild", "ContentChildren", "HostBinding", "HostListener"]
IMPORT_KINDS = ["import", "ImportSpecifier", "ImportDeclaration", "ImportClause", "ImportDefaultSpecifier", "ImportNamespaceSpecifier", "NamedImports", "NamespaceImport"]
KEYWORDS = ["path", "fs", "file", "const", "let", "var", "import", "export", "function", "class", "interface", "type", "enum", "namespace", "public", "private", "protected", "static", "readonly", "async", "await", "return", "if", "else", "for", "while", "switch", "case", "break", "continue", "try", "catch", "finally", "throw", "new", "this", "super", "extends", "implements", "constructor", "get", "set", "true", "false", "null", "undefined", "void", "any", "unknown", "string", "number", "boolean", "object", "array", "map", "promise", "error", "console", "log", "debug", "info", "warn"]
ACTION_VERBS = ["load", "save", "update", "delete", "create", "remove", "add", "set", "clear", "reset", "fetch", "submit", "navigate", "select", "deselect", "toggle", "open", "close"]
STORE_PACKAGES = ["@ngrx/store", "@ngrx/effects", "@ngrx/entity", "@ngrx/router-store", "@ngrx/component-store"]
STORE_CALLS = ["createAction", "createEffect", "on(", "on (", "ofType(", "ofType (", ".dispatch("]
MAX_FILE_BYTES = 50 << 20


def contains_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts), F.lit(False))


def indexable(uri: Column, size: Column, excluded: list[str] = (), limit: int = MAX_FILE_BYTES) -> Column:
    """Known extension, not excluded by a fixed part or a user glob (name a store's own folder there), and not too large."""
    u = F.regexp_replace(uri, r"\\", "/")
    known = F.lower(F.regexp_extract(u, r"\.[^./]+$", 0)).isin(EXTENSIONS)
    return known & ~contains_any(u, EXCLUDED_PARTS) & ~matches_any(u, list(excluded)) & (size <= limit)


def entry_point(uri: Column, globs: list[str] | None = None) -> Column:
    return matches_any(uri, globs or ENTRY_POINTS, match_base=True)


def in_scope(uri: Column, scope: str | None) -> Column:
    if not scope:
        return F.lit(True)
    prefix = scope.rstrip("/").lower()
    return (F.lower(uri) == prefix) | F.lower(uri).startswith(prefix + "/")


def unanalysed(uri: Column, globs: list[str] = (), include_tests: bool = False) -> Column:
    u = F.regexp_replace(uri, r"\\", "/")
    out = contains_any(u, UNANALYSED_PARTS) | matches_any(u, list(globs), match_base=True)
    return out if include_tests else out | contains_any(u, TEST_PARTS)


def exportable(container: Column, kind: Column) -> Column:
    return (F.coalesce(container, F.lit("")) == "") & kind.isin(EXPORTABLE_KINDS)


def framework_alive(name: Column) -> Column:
    return name.isin(LIFECYCLE + CLASS_DECORATORS)


def store_context(content: Column) -> Column:
    return contains_any(content, STORE_PACKAGES)


def action_name(name: Column) -> Column:
    return (F.char_length(name) >= 3) & F.lower(name).rlike("^(?:" + "|".join(ACTION_VERBS) + ")") & name.rlike("^[a-z][a-zA-Z0-9]*$")


def store_symbol(name: Column, line: Column) -> Column:
    return contains_any(line, STORE_CALLS) | action_name(name)


def loose_mode(content: Column, name: Column, line: Column) -> Column:
    return store_context(content) & store_symbol(name, line)


def reducer_or_effect(content: Column) -> Column:
    return content.rlike(r"createReducer|on\(|createEffect|ofType\(")


def action_group_container(name: Column, line: Column) -> Column:
    return (name.endswith("Actions") | name.endswith("Action")) & line.contains("createActionGroup")


def member_access(expression: Column) -> Column:
    """struct(container, member) of ``a.b``; null for anything else."""
    p = r"^([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\.\s*([a-zA-Z_$][a-zA-Z0-9_$]*)$"
    return F.when(expression.rlike(p), F.struct(F.regexp_extract(expression, p, 1).alias("container"), F.regexp_extract(expression, p, 2).alias("member")))


def action_type(line: Column) -> Column:
    found = F.regexp_extract(line, r"createAction\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1)
    return F.when(found != "", found)


def confidence(match: Column, explicit: Column) -> Column:
    return F.when((match == "symbol") & explicit, "high").when(match.isin("symbol", "string"), "medium").otherwise("low")


def public_marker(content: Column, line: Column) -> Column:
    """@public, @api or @export in the ten lines above a 0-based line."""
    above = F.slice(F.split(content, "\n"), F.greatest(line - 9, F.lit(1)), F.least(line, F.lit(10)))
    return F.when(line <= 0, F.lit(False)).otherwise(F.exists(above, lambda x: x.rlike("@public|@api|@export")))
