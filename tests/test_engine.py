import cProfile
import json
import random

import pytest
from pyspark.sql import functions as F

from symgraph.engine import Engine
from symgraph.extract import fast, index, typescript
from symgraph.extract.index import read_file
from symgraph.extract.plugins import Angular, Plugin, Registry
from symgraph.functions import predicates as P
from symgraph.functions import scalars as S
from symgraph.operators import cursor, graph, search
from symgraph.plans import extraction
from symgraph.sources import testtables, workspace
from symgraph.streaming import incremental

TREE = {
    "src/base.ts": "export interface Shape { area(): number }\nexport class Base implements Shape {\n  area() { return 1; }\n}\nexport function lonely() { return 2; }\nfunction helper() { return lonely(); }\n",
    "src/circle.ts": "import { Base as Root } from './base';\nexport class Circle extends Root {}\nexport class Ring extends Circle { grow(by: number) { return new Root(); } }\n",
    "src/index.ts": "export * from './circle';\nexport { Base } from './base';\n",
    "src/app.ts": "import { Circle } from './index';\nconst one = new Circle();\nUsersActions.loadUsers();\n",
    "src/actions.ts": "export const UsersActions = createActionGroup({ source: 'U', events: { 'Load Users': emptyProps() } });\n",
    "src/broken.ts": "class {{{ ",
    "notes.md": "Circle words_here ab\n",
    "main.py": "class Py:\n    def go(self):\n        pass\n",
    "node_modules/x/i.ts": "export class Hidden {}\n",
    "logo.png": "binary",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}/index")
    e.build(f"file://{root}")
    e.root = root
    return e


def names(df, *columns):
    return {tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()}


def test_build(engine):
    files = {r.uri.removeprefix(f"{engine.root}/"): r for r in engine.table("files").collect()}
    assert set(files) == {"src/base.ts", "src/circle.ts", "src/index.ts", "src/app.ts", "src/actions.ts", "src/broken.ts", "notes.md", "main.py"}
    assert files["src/broken.ts"].skip_reason == "Failed to parse AST" and files["src/base.ts"].skip_reason is None
    found = names(engine.table("symbols"), "name", "kind")
    assert {("Circle", "class"), ("grow", "method"), ("Shape", "interface"), ("loadUsers", "method"), ("words_here", "text"), ("Py", "text"), ("go", "text"), ("one", "constant")} <= found and not any(n == "Hidden" for n, _ in found)


def test_queries(engine):
    u = lambda f: f"{engine.root}/{f}"
    assert names(engine.search("circ").where("kind = 'class'"), "name") == {"Circle"}
    assert names(engine.implementations("Base"), "node") == set() and names(engine.implementations("Root"), "node") == {"Circle", "Ring"}
    assert names(engine.implementations("Shape"), "node") == {"Base"}
    cursors = engine.spark.createDataFrame([(1, u("src/app.ts"), 1, 17, "Circle"), (2, u("src/circle.ts"), 2, 60, "Root")], "cursor_id int, cursor_uri string, cursor_line int, cursor_character int, name string")
    got = {r.cursor_id: (r.uri, r.name) for r in engine.definitions(cursors).collect()}
    assert got == {1: (u("src/circle.ts"), "Circle"), 2: (u("src/base.ts"), "Base")}
    assert {r.uri for r in engine.references("Base").collect()} == {u("src/base.ts"), u("src/circle.ts")}
    assert names(engine.impacted_files(u("src/base.ts")), "uri") == {u("src/circle.ts")}
    assert names(engine.impacted_files(u("src/index.ts")), "uri") == {u("src/app.ts")}
    assert names(engine.exports(u("src/index.ts")), "name") == {"Circle", "Ring", "Base"}
    links = {(r.member, r.event, r.symbol_name) for r in engine.resolve_links().collect()}
    assert ("loadUsers", "loadUsers", "loadUsers") in links
    dead = {r.name: r.confidence for r in engine.dead_code().collect()}
    assert dead["Ring"] == "high" and dead["helper"] == "high" and "lonely" not in dead and "Circle" not in dead and "UsersActions" not in dead
    edits = {r.uri: r.edits for r in engine.rename_edits("Circle", "Disc").collect()}
    assert [e.line for e in edits[u("src/circle.ts")]] == [2, 1] and all(e.text == "Disc" for e in edits[u("src/circle.ts")])


def test_cursors(engine, spark):
    u = lambda f: f"{engine.root}/{f}"
    at = [(1, u("src/app.ts"), 1, 17), (2, u("src/circle.ts"), 1, 15), (3, u("src/app.ts"), 1, 7), (4, u("src/app.ts"), 50, 0), (5, u("src/actions.ts"), 0, 15)]
    cursors = spark.createDataFrame(at, "cursor_id int, cursor_uri string, cursor_line int, cursor_character int")
    assert {r.cursor_id: (r.name, r.kind) for r in engine.symbol_at(cursors).collect()} == {1: ("Circle", "variable"), 2: ("Circle", "class"), 3: ("one", "constant"), 5: ("UsersActions", "constant")}
    assert {r.cursor_id: r.uri for r in engine.definitions_at(cursors).collect() if r.cursor_id == 1} == {1: u("src/circle.ts")}
    texts = {r.cursor_id: r.text for r in engine.hover(cursors).collect()}
    assert texts[1] == "```typescript\n(class) Circle\n```\n\n*Defined in:* `circle.ts:2:14`" and "**NgRx Action Group**" in texts[5] and "**NgRx Action:** `U`" in texts[5]
    errors = {r.cursor_id: (r.name, r.error) for r in engine.prepare_rename(cursors).collect()}
    assert errors[1] == ("Circle", None) and errors[4] == (None, "No symbol found at this position")
    assert {r.name: r.message for r in engine.unused_messages().collect()}["Ring"] == "Unused export: Class 'Ring' is declared but never used in the workspace"
    row = engine.stats().first()
    assert row.n_files == 8 and row.n_skipped == 1 and row.n_refs == engine.table("refs").count() and row.last_indexed_at > 0
    keyword = spark.createDataFrame([(1, u("src/app.ts"), 1, 0, "const")], "cursor_id int, cursor_uri string, cursor_line int, cursor_character int, name string")
    assert engine.definitions(keyword).count() == 0


def test_public_markers():
    marks = {s["name"]: s["is_public"] for s in read_file("/w/a.ts", "/** @public */\nexport class A {}\n" + "\n" * 9 + "export class B {}\n/** @api */ export class C {}\n")["symbols"]}
    assert marks == {"A": True, "B": False, "C": False}


def test_update(engine, spark):
    before = engine.store.version()
    (engine.root / "src/extra.ts").write_text("export class Extra {}\n")
    (engine.root / "notes.md").unlink()
    engine.update(f"file://{engine.root}")
    found = names(engine.table("symbols"), "name")
    assert "Extra" in found and "words_here" not in found and "Ring" in found and engine.store.version() != before
    assert engine.table("files").count() == 8
    again = engine.table("files").select("uri", "hash")
    assert workspace.changes_since(again, again).count() == 0
    gone = again.where(F.col("uri").contains("extra"))
    engine.store.delete(gone)
    assert "Extra" not in names(engine.table("symbols"), "name")


def test_bad_files_and_reads(spark, tmp_path, monkeypatch):
    """A file that isn't UTF-8 is a skipped row; an update reads only what has another mtime, and extracts what differs."""
    import os

    ws = tmp_path / "ws"
    ws.mkdir()
    for i in range(12):
        (ws / f"f{i}.ts").write_text(f"export class C{i} {{}}\n")
    (ws / "bad.ts").write_bytes(b"export class Bad {}\n\xff\xfe")
    (ws / "odd [1]{2}.ts").write_text("export class Odd {}\n")
    e = Engine(spark, f"file://{tmp_path}/index")
    e.build(f"file://{ws}")
    files = {r.uri.rsplit("/", 1)[1]: r for r in e.table("files").collect()}
    assert files["bad.ts"].skip_reason == "read error" and files["bad.ts"].n_symbols == 0 and len(files) == 14
    assert files["bad.ts"].hash and files["f1.ts"].size == 19 and files["f1.ts"].last_indexed_at > files["f1.ts"].mtime - 1e6
    extracted, read = [], []
    contents, extract = workspace.contents, index.extract
    monkeypatch.setattr(workspace, "contents", lambda s, paths: read.append(sorted(paths)) or contents(s, paths))
    monkeypatch.setattr(index, "extract", lambda rows, plugins: extracted.append(names(rows, "uri")) or extract(rows, plugins))
    (ws / "f3.ts").write_text("export class New {}\n")
    for name in ("f3.ts", "f4.ts", "odd [1]{2}.ts"):
        os.utime(ws / name, (2_000_000_000, 2_000_000_000))
    (ws / "f5.ts").unlink()
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    e.update(f"file://{ws}")
    assert [len(x) for x in read] == [3] and [{u.rsplit("/", 1)[1] for u in x} for x in extracted] == [{"f3.ts"}]
    assert {"New", "C4", "Odd"} < names(e.table("symbols"), "name") and not {"C3", "C5"} & names(e.table("symbols"), "name")
    used = {p for p in e.table("symbols").inputFiles()}
    assert any(p.removeprefix("file://") in before for p in used), "untouched buckets keep their files"
    e.update(f"file://{ws}")
    assert read[1] == [] and e.table("files").count() == 13


def test_store_survives_a_crash(spark, tmp_path, monkeypatch):
    from symgraph import store as module

    rows = lambda n: index.extract(spark.createDataFrame([(f"/w/f{i}.ts", f"export class C{i}v{n} {{}}") for i in range(4)], "uri string, content string"))
    store = module.Store(spark, f"file://{tmp_path}/s", buckets=2)
    assert store.read("symbols").count() == 0 and store.version() is None
    store.upsert(rows(1))
    reader = store.read("symbols")
    with monkeypatch.context() as m:
        m.setattr(store, "_fs", Broken(store._fs))
        with pytest.raises(RuntimeError, match="another writer"):
            store.upsert(rows(2))
    assert store.version() == 1 and names(store.read("symbols"), "name") == {f"C{i}v1" for i in range(4)}
    store.upsert(rows(3))
    assert names(reader, "name") == {f"C{i}v1" for i in range(4)}, "a reader goes on with its version"
    store.upsert(rows(4))
    kept = [p.name for p in (tmp_path / "s").iterdir()]
    assert sum(n.startswith("pointer-") for n in kept) == module.KEPT == sum(n.startswith("v-") for n in kept) and names(store.read("symbols"), "name") == {f"C{i}v4" for i in range(4)}
    monkeypatch.setattr(module, "SCHEMA_VERSION", 99)
    with pytest.raises(ValueError, match="build it anew"):
        store.read("symbols")


class Broken:
    """A file system whose renames fail."""

    def __init__(self, fs):
        self.fs = fs

    def __getattr__(self, name):
        return (lambda *a: False) if name == "rename" else getattr(self.fs, name)


def test_stream_maintenance(spark, tmp_path):
    class Spy:
        calls = []

        def upsert(self, rows, gone):
            self.calls.append(({r.uri: r.content for r in rows.collect()}, {r.uri for r in gone.collect()}))

    rows = [("a", "change", "1", 1), ("a", "save", "2", 5), ("b", "change", "x", 2), ("b", "unlink", None, 9), ("c", "add", "y", 3)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "uri string, event_type string, content string, s long").select("uri", "event_type", "content", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    spy = Spy()
    incremental.maintain(stream, spy, lambda df: df, str(tmp_path / "cp")).awaitTermination(60)
    assert spy.calls == [({"a": "2", "c": "y"}, {"b"})]
    q = incremental.debounced(stream, gap="3 seconds", late="1 second").writeStream.outputMode("append").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.uri, r.n, r.content) for r in spark.table("bursts").collect()}
    assert got == {("a", 1, "1"), ("b", 1, "x"), ("c", 1, "y")} | (got & {("a", 1, "2"), ("b", 1, None)})


def test_ties_and_saves_in_a_burst(spark, tmp_path):
    rows = [("a", "change", "1", 10), ("a", "unlink", None, 10), ("b", "change", "1", 10), ("b", "save", "2", 11), ("c", "change", "1", 10), ("c", "change", "2", 12), ("z", "change", "", 100)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "uri string, event_type string, content string, s long").select("uri", "event_type", "content", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    q = incremental.debounced(stream, gap="3 seconds", late="1 second").writeStream.outputMode("append").format("memory").queryName("ties").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.uri: (r.event_type, r.content, r.kinds, r.n, r.ready_at.timestamp()) for r in spark.table("ties").selectExpr("uri", "event_type", "content", "kinds", "n", "ready_at").collect()}
    assert got == {"a": ("unlink", None, ["change", "unlink"], 2, 13), "b": ("save", "2", ["change", "save"], 2, 11), "c": ("change", "2", ["change"], 2, 15)}


def test_extractor_rules():
    src = "import d, { A as B } from './m';\nconst { x: y } = require('./c');\n@Component({})\nexport class K extends B implements Action {\n  readonly type = '[K] go';\n  @Input() p: string;\n  static make(a, b = d) { const z = 1; return z; }\n}\nconst o = { k: { v: 1 } };\nfunction f() { let q = 2; return q + o.k; }\n"
    r = typescript.extract("/w/a.ts", src)
    by = {s["name"]: s for s in r["symbols"]}
    assert by["K"]["ngrx"]["role"] == "action" and by["K"]["ngrx"]["type"] == "[K] go" and json.loads(by["K"]["metadata"]) == {"angular": {"decorators": ["Component"]}}
    assert by["make"]["is_static"] and by["make"]["parameters_count"] == 2 and by["make"]["container_name"] == "K" and by["z"]["container_name"] == "K"
    assert by["v"]["full_container_path"] == "o.k" and by["p"]["character"] == 2 and by["K"]["line"] == 3 and by["K"]["start_line"] == 2
    assert [(i["local_name"], i["exported_name"], i["is_cjs"]) for i in r["imports"]] == [("d", None, None), ("B", "A", None), ("y", "x", True)]
    assert ("o", "k") in {(p["container"], p["member"]) for p in r["pending"]}
    q = next(x for x in r["refs"] if x["symbol_name"] == "q")
    assert q["is_local"] and q["scope_id"] == "f"
    positions = [(x["line"], x["character"]) for x in r["refs"]]
    assert len(positions) == len(set(positions))
    for bad in ("class A {", "'open", "`${", "/* no end", "f(]"):
        assert typescript.extract("/w/b.ts", bad)["skip_reason"]
    assert read_file("/w/x.bin", "")["skip_reason"] == "Unsupported file extension" and read_file("/w/x.ts", None)["skip_reason"] == "read error"
    assert {s["name"] for s in read_file("/w/big.ts", "// class No {}\nexport class Yes {}\n", fast_chars=5)["symbols"]} == {"Yes"}
    assert len(fast.mask("a 'b' /* c\n */ d")) == len("a 'b' /* c\n */ d")


def test_plugins():
    class Extra(Plugin):
        name = "extra"

        def visit(self, symbol, reader, first, last):
            return {"metadata": {"extra": symbol["kind"]}}

    r = typescript.extract("/w/a.ts", "class A {}", [Extra()])
    assert json.loads(r["symbols"][0]["metadata"]) == {"extra": "class"}
    registry = Registry(Extra(), Angular())
    with pytest.raises(ValueError, match="registered"):
        registry.register(Extra())
    registry.unregister("extra")
    assert [p.name for p in registry.all()] == ["angular"]


def fuzzy_brute(name, q):
    if name == q:
        return 100
    if name.lower() == q.lower():
        return 90
    edge = lambda i: i == 0 or (name[i].isupper() and name[i - 1].islower()) or (name[i].isalpha() and not name[i - 1].isalpha())
    caps = iter(name[i].upper() for i in range(len(name)) if edge(i))
    if all(c in caps for c in q.upper()):
        return 80
    if name.lower().startswith(q.lower()):
        return 70
    if q in name:
        return 50
    score, last, run, at = 0.0, -1, 0, 0
    for c in q:
        i = name.lower().find(c.lower(), at)
        if i < 0:
            return None
        run = run + 1 if i == last + 1 else 0
        score += 2 + 3 * run + 5 * (i > 0 and edge(i)) + 3 * (i > 0 and name[i - 1] in "_-./\\") + max(0, 2 * (1 - i / len(name))) + (name[i] == c)
        last, at = i, i + 1
    return min(39, score)


def test_fuzzy_score(spark):
    import random

    rnd = random.Random(3)
    sample = ["".join(rnd.choice("abUsS_x1.") for _ in range(rnd.randint(1, 9))) for _ in range(300)] + ["UserService", "user_service", "US"]
    df = spark.createDataFrame([(n,) for n in sample], "name string")
    for q in ("US", "as", "x", "bU_", "user", ".1"):
        got = [r[0] for r in df.select(S.fuzzy_score(F.col("name"), q)).collect()]
        want = [fuzzy_brute(n, q) for n in sample]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want, strict=True)), q
    assert search.search(df, "  ").count() == 0


def test_scalars(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert [v(f(F.lit("load-User_by idX"))) for f in (S.camel_case, S.pascal_case, S.kebab_case, S.snake_case)] == ["loadUserByIdX", "LoadUserByIdX", "load-user-by-id-x", "load_user_by_id_x"]
    assert v(S.normal_uri(F.lit("C:\\a\\b"))) == "c:/a/b" and v(S.directory(F.lit("/a/b/c.ts"))) == "/a/b"
    assert v(S.boundary_characters(F.lit("UserServiceX_foo2bar"))) == "USXfb" and v(S.boundary_characters(F.lit("HTTPServer.load"))) == "Hl"
    assert v(S.proximity(F.lit("/a/src/x.ts"), F.lit("/a/src/y.ts"))) == 130 and v(S.proximity(F.lit("/a/node_modules/x.ts"), F.lit("/b/c/y.ts"))) == -80
    assert v(P.entry_point(F.lit("/w/src/index.ts"))) and v(P.entry_point(F.lit("/w/a.spec.ts"))) and not v(P.entry_point(F.lit("/w/a.ts")))
    assert v(P.public_marker(F.lit("a\n/** @public */\nclass A {}"), F.lit(2))) and not v(P.public_marker(F.lit("/** @public */" + "\n" * 12 + "class A"), F.lit(12)))
    assert v(P.action_type(F.lit("const a = createAction('[X] y')"))) == "[X] y" and v(P.member_access(F.lit("A . b"))).member == "b"
    assert v(F.lit("x/y.test.js").rlike(S.glob_regex("**/*.{test,spec}.[jt]s"))) and not v(F.lit("x/y.js").rlike(S.glob_regex("*.js"))) and v(F.lit("x/y.js").rlike(S.glob_regex("*.js", True)))


def test_graph_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.reach(edges, start, None).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {tuple(r) for r in graph.reach(edges, start, 1).collect()} == {("a", 0), ("b", 1)}
    members = spark.createDataFrame([("o", "k", "o.k"), ("o.k", "v", "end")], "base string, property string, target string")
    asked = spark.createDataFrame([(1, "o", ["k", "v"]), (2, "o", ["z"]), (3, "o", [])], "request_id int, base string, properties array<string>")
    assert {tuple(r) for r in graph.resolve_members(asked, members).collect()} == {(1, "end"), (3, "o")}


def test_static_index(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"symbols": [{"name": "A", "kind": "class", "location": {"uri": "u", "line": 1, "character": 2}}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"name": "B", "kind": "enum", "location": {"uri": "u", "line": 0, "character": 0}, "containerName": "N"}]))
    (tmp_path / "c.json").write_text("not json")
    got = {(r.name, r.kind, r.line, r.container_name) for r in workspace.static_index(spark, str(tmp_path)).collect()}
    assert got == {("A", "class", 1, None), ("B", "enum", 0, "N")}
    (tmp_path / "tsconfig.json").write_text(json.dumps({"compilerOptions": {"paths": {"@app/*": ["src/*"]}}}))
    assert [tuple(r) for r in workspace.path_map(spark, str(tmp_path / "tsconfig.json")).collect()] == [("@app/*", ["src/*"])]


def test_shared_winners(spark):
    """What is found once for each name or context equals what each cursor and site finds alone."""
    rows = [
        ("a", "/w/src/m1/f.ts", 1, 0, "class", 1, 0, 9, 5, None, True),
        ("a", "/w/src/m2/f.ts", 2, 0, "interface", 1, 0, 9, 5, "K", True),
        ("a", "/w/node_modules/m/f.ts", 3, 4, "class", 3, 0, 4, 5, "K", False),
        ("b", "/w/src/m1/f.ts", 4, 0, "text", 4, 0, 4, 5, None, None),
        ("b", "f.ts", 5, 0, "function", 4, 0, 4, 5, "", True),
    ]
    symbols = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, uri string, line int, character int, kind string, start_line int, start_character int, end_line int, end_character int, container_name string, is_definition boolean, ordinal int")
    places = [(n, u, c) for n in ("a", "b", "none") for u in ("/w/src/m1/f.ts", "/w/src/m2/g.ts", "/w/src/m1/deep/g.ts", "f.ts") for c in (None, "K", "Q")]
    sites = spark.createDataFrame([(i, *p) for i, p in enumerate(places + places[:3])], "site_id int, name string, site_uri string, container string")
    alone = search.proximity_ranked(symbols, sites).where("rank = 1")
    assert names(search.proximity_winners(symbols, sites), "site_id", "ordinal", "score") == names(alone, "site_id", "ordinal", "score") != set()
    cursors = sites.select(F.col("site_id").alias("cursor_id"), "name", F.col("site_uri").alias("cursor_uri"), (F.col("site_id") % 10).alias("cursor_line"), F.lit(0).alias("cursor_character"))
    alone = search.definition_rules(cursors.join(symbols, "name"))
    assert names(search.definitions_at(cursors, symbols), "cursor_id", "ordinal") == names(alone, "cursor_id", "ordinal") != set()


def test_import_paths(spark, tmp_path):
    from symgraph.operators import resolve

    (tmp_path / "tsconfig.json").write_text(json.dumps({"compilerOptions": {"baseUrl": "./base", "paths": {"@app/*": ["gone/*", "../src/*"], "core": ["../src/core/index.ts"]}}}))
    ws = str(tmp_path)
    files = [f"{ws}/src/x.ts", f"{ws}/src/core/index.ts", f"{ws}/src/a/b/c/d.ts", f"{ws}/node_modules/lib/index.d.ts", f"{ws}/src/a/node_modules/lib/index.js", f"{ws}/node_modules/pkg/node_modules/sub.js"]
    want = {
        "../../../x": files[0], "./../../../core/": files[1], ".././c/../../../x.js": files[0], "../../../../../src/x": None, ".": None, "../../gone": None,
        "@app/x": files[0], "@app/core": files[1], "@app/none": None, "core": files[1], "lib": files[4], "pkg/node_modules/sub": files[5], "react": None,
    }
    imports = spark.createDataFrame([(files[2], i, s) for i, s in enumerate(want)], "uri string, ordinal int, module_specifier string")
    found = spark.createDataFrame([(f,) for f in files], "uri string")
    got = resolve.resolve_imports(imports, found, workspace.full_path_map(spark, f"file://{ws}/tsconfig.json"))
    assert {r.module_specifier: r.resolved_uri for r in got.collect()} == want and got.columns == [*imports.columns, "resolved_uri"]
    bare = spark.createDataFrame([("/a/b.ts", "../../c"), ("p/q/r.ts", "../../c"), ("t.ts", "./c"), ("t.ts", "lib")], "uri string, module_specifier string")
    known = spark.createDataFrame([("/c.ts",), ("c.ts",), ("node_modules/lib/index.ts",)], "uri string")
    assert sorted((r.uri, r.resolved_uri) for r in resolve.resolve_imports(bare, known).collect()) == [("/a/b.ts", "/c.ts"), ("p/q/r.ts", "c.ts"), ("t.ts", "c.ts"), ("t.ts", "node_modules/lib/index.ts")]


def test_word_after_a_line_end(spark):
    texts = ["abc\ndef", "abc\n def", "abc\r\nx", "abc ", "abc\n", "ab\n\ndef", "abcd ef"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.word_at(F.col("t"), F.lit(4)).alias("w"))
    assert {r.i: r.w for r in rows.collect()} == {0: "def", 1: None, 2: None, 3: None, 4: None, 5: "def", 6: "abcd"}


def test_symbols_at_shared_cursors(spark):
    rnd = random.Random(5)
    declared = [(f"/f{rnd.randint(0, 1)}", rnd.randint(0, 3), rnd.randint(0, 30), "x" * rnd.randint(1, 12) + rnd.choice("ab"), rnd.choice(["class", "type"])) for _ in range(60)]
    used = [(f"/f{rnd.randint(0, 1)}", rnd.randint(0, 3), rnd.randint(0, 30), "y" * rnd.randint(1, 12) + rnd.choice("ab")) for _ in range(150)]
    used += [("/g", n, 3, "same") for n in range(40)]
    cursors = [(i % 150, f"/f{rnd.randint(0, 2)}", rnd.randint(0, 4), rnd.randint(0, 45)) for i in range(300)] + [(500 + n % 20, "/g", n, 5) for n in range(40)]
    marks = [(0, c, n, k, u, ln) for u, ln, c, n, k in declared] + [(1, c, n, "variable", u, ln) for u, ln, c, n in used]
    want = {}
    for i, u, ln, at in cursors:
        here = min((m for m in marks if m[4:] == (u, ln) and m[1] <= at <= m[1] + len(m[2])), default=None)
        if here:
            want[i] = min(here, want.get(i, here))
    symbols = spark.createDataFrame(declared, "uri string, line int, character int, name string, kind string")
    refs = spark.createDataFrame(used, "uri string, line int, character int, symbol_name string")
    for rows in (cursors, cursors[::-1]):
        places = spark.createDataFrame(rows, "cursor_id long, cursor_uri string, cursor_line int, cursor_character int")
        got = cursor.symbol_at(places, symbols, refs).collect()
        assert {r.cursor_id: (r.character, r.name, r.kind, r.uri, r.line) for r in got} == {i: m[1:] for i, m in want.items()}
        assert len(got) == len(want) and all(r.end_character == r.character + len(r.name) for r in got)


def joined_rows(df):
    """df's rows, and the most rows that a join of its plan gave out."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        m = p.metrics().get("numOutputRows")
        most = max(most, m.get().value() if "Join" in p.nodeName() and m.isDefined() else 0)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows, most


def test_definitions_of_random_cursors(spark):
    rnd = random.Random(3)
    kinds = ["class", "interface", "function", "text", "method", "import", "type"]
    rows = [(rnd.choice("abcd"), f"/f{rnd.randint(0, 5)}", i, rnd.choice(kinds), a := rnd.randint(0, 9), 0, a + rnd.randint(0, 4), 5, rnd.choice([True, False, False, None])) for i in range(90)]
    rows += [("e", "/f1", 100, "class", 0, 0, 9, 5, True), ("f", "/f1", 101, "text", 0, 0, 9, 5, True), ("f", "/f2", 102, "text", 0, 0, 9, 5, False)]
    symbols = spark.createDataFrame(rows, "name string, uri string, ordinal int, kind string, start_line int, start_character int, end_line int, end_character int, is_definition boolean")
    cursors = spark.createDataFrame([(i, rnd.choice("abcdefz"), f"/f{rnd.randint(0, 6)}", rnd.randint(0, 12), rnd.randint(0, 6)) for i in range(500)], "cursor_id long, name string, cursor_uri string, cursor_line int, cursor_character int")
    alone = search.definition_rules(cursors.join(symbols, "name"))
    got = search.definitions_at(cursors, symbols)
    assert set(got.columns) == set(alone.columns)
    assert names(got, *sorted(got.columns)) == names(alone, *sorted(got.columns)) != set()


def test_cursors_within_a_common_name(spark):
    symbols = spark.range(400).selectExpr("'a' AS name", "concat('/f', id) AS uri", "CAST(id AS INT) AS ordinal", "'class' AS kind", "1 AS start_line", "0 AS start_character", "3 AS end_line", "0 AS end_character", "true AS is_definition")
    cursors = spark.range(400).selectExpr("id AS cursor_id", "'a' AS name", "concat('/f', id) AS cursor_uri", "2 AS cursor_line", "0 AS cursor_character")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows, most = joined_rows(search.definitions_at(cursors, symbols).select("cursor_id", "ordinal"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert {r.cursor_id: r.ordinal for r in rows} == {i: 0 if i else 1 for i in range(400)} and 400 <= most < 4000


def test_extraction_is_dealt_out(spark):
    x = testtables.Index(spark, "/root/testdata/sf0.001")
    assert all(q(x).rdd.getNumPartitions() == 4 for q in extraction.QUERIES)
    files = spark.range(600).selectExpr("concat('/f', id, '.ts') AS uri", "concat('export class K', id, ' {}') AS content").repartition(1)
    whole, some = index.extract(files), index.extract(files, tables=["symbols"])
    assert names(index.flatten(whole, "symbols"), "uri", "name") == names(index.flatten(some, "symbols"), "uri", "name") == {(f"/f{i}.ts", f"K{i}") for i in range(600)}
    assert some.count() == 600 and index.flatten(index.extract(files, tables=["refs"]), "symbols").isEmpty()


def test_rows_of_one_table(spark):
    """Tables made alone equal those made together, whatever the file."""
    texts = ["\n".join(extraction.LINES).replace("<", "{").replace(">", "}").replace("{n}", "7"), *TREE.values(), "@", "class A {", "", None, "const a = `x${b.c}` / d; // e 'f\n/g'h/.test(i.j); 'k' /* l */ m.n()", "\u2003é\u00a0𝟎1 = ü.x;", "let s = 'open", "/** @public */ class P { a() { return q.r; } }"]
    files = spark.createDataFrame([(f"/w/f{i}.{e}", t) for i, t in enumerate(texts) for e in ("ts", "md", "py", "bin")], "uri string, content string")
    for plugins in ((), (Angular(),)):
        nested = index.extract(files, plugins)
        for table in index.TABLES:
            whole, alone = index.flatten(nested, table), index.rows(files, table, plugins)
            assert whole.schema == alone.schema and sorted(map(str, whole.collect())) == sorted(map(str, alone.collect()))
        assert {r.uri for r in index.rows(files, "pending").collect()} and {r.uri for r in index.rows(files, "imports").collect()}


def test_rows_of_one_table_cost_what_they_need():
    """Tables without symbols and references are made without reading what none of their rows can start in, and miss none of them."""
    text = "\n".join(extraction.LINES).replace("<", "{").replace(">", "}").replace("{n}", "7")
    calls = []
    for table in ("pending", "imports", "reexports"):
        found = read_file("/w/a.ts", text, tables=(table,))[table]
        profile = cProfile.Profile()
        profile.runcall(read_file, "/w/a.ts", text, tables=(table,))
        calls.append(sum(x.callcount for x in profile.getstats()))
        assert found and found == read_file("/w/a.ts", text)[table]
    assert max(calls) < 600
    deep = "a.b; const q = " + "{k: " * 120 + "c.d" + "}" * 120
    odd = ["const {x: y} ; require('m')", "{ const {x} } require('m')", "f(@)(x.y)", "@a.;(x.y) => z", "class A { m<T ; } > (x.y)", "function f() { function g<T } > (x.y)", "a.b;\nclass C", "a.b;\n@", "import 'x' *", "const a = 1; import b, * as c from 'd'; export * from 'e'; x?.y\n  // f.g\n  h.i(`${j.k}`)", deep]
    for t in odd:
        whole = read_file("/w/a.ts", t)
        for table in index.TABLES:
            alone = read_file("/w/a.ts", t, tables=(table,))
            assert alone[table] == whole[table] and alone["skip_reason"] == whole["skip_reason"], (t, table)


def test_tokens_after_special_characters():
    """Places and kinds of tokens around comments, templates, regular expressions and divisions."""
    text = "a /* b */ = /f'/g; `d${e}` / 1 // h\n\u2003é 𝟎x"
    found = typescript.tokenize(text)
    assert all(text[a:b] == t for _, t, a, b in found)
    assert [(k, t) for k, t, _, _ in found] == [("word", "a"), ("op", "="), ("string", "/f'/g"), ("op", ";"), ("string", "`d${e}`"), ("word", "e"), ("op", "/"), ("number", "1"), ("word", "é"), ("number", "𝟎x")]
