import json

import pytest

from gleanstone.operators import deprecation, taxonomy
from gleanstone.plans import ingest
from gleanstone.sources import code, markdown, pins, rst, settings, typescript


def test_clean_tags():
    text = "<Note type='x'>\nline one\n\nline two\n</Note>\n<Steps><Step title='a'>go</Step></Steps>\n\n\n\nend <Icon name='x'/>"
    assert markdown.clean_tags(text) == "> **Note:** line one\n>\n> line two\ngo\n\nend"


def test_sections_regard_fences():
    md = "lead\n# A\nbody\n```\n# not\n```\n## B\n### C\ntail"
    assert markdown.sections(md) == [("", "lead"), ("A", "body\n```\n# not\n```"), ("B", ""), ("C", "tail")]
    assert markdown.sections("```\n# open\n") == [("", "```"), ("open", "")]
    assert markdown.sections("~~~~\n```\n# x\n~~~~\n# y")[-1] == ("y", "")
    assert markdown.sections("  ") == []


def test_paragraphs_are_packed_with_overlap():
    paragraphs = [c * 30 for c in "abcdef"]
    parts = markdown.pack_paragraphs("\n\n".join(paragraphs), 100, 40)
    assert parts[0] == "\n\n".join(paragraphs[:3]) and parts[1].startswith(paragraphs[2])
    assert markdown.pack_paragraphs("x" * 500, 100, 40) == ["x" * 500] and markdown.pack_paragraphs(" ", 100, 40) == []


def test_section_of():
    md = "# One\na\n## Two\nb\n# Three\nc"
    assert markdown.section_of(md, "one") == "# One\na\n## Two\nb" and markdown.section_of(md, "Two") == "## Two\nb" and markdown.section_of(md, "x") is None


def test_pages_and_chunks(spark):
    dump = "before\n# First\nSource: https://d/x/one\n\nbody\n# Not a page\nmore\n# Second\nSource: https://d/two\n## H\ntext"
    pages = markdown.split_pages(spark.createDataFrame([(1, dump), (2, None)], "k int, value string"), "k")
    got = [(r["page"], r["title"], r["source_url"], r["body"]) for r in pages.orderBy("page").collect()]
    assert got == [(1, "First", "https://d/x/one", "body\n# Not a page\nmore"), (2, "Second", "https://d/two", "## H\ntext")]
    chunks = markdown.chunk_pages(pages).orderBy("path", "chunk_index").collect()
    assert [(c["path"], c["section"], c["chunk_index"]) for c in chunks] == [("/two", "H", 0), ("/x/one", "", 0), ("/x/one", "Not a page", 1)]
    import hashlib

    assert chunks[0]["chunk_id"] == hashlib.sha256(b"https://d/two|chunk|0").hexdigest()[:16]


def test_code_chunks():
    assert code.chunk_code("x = 1\n") == ["x = 1\n"]
    body = "    pass  # " + "y" * 380 + "\n"
    source = "import os\n\ndef a():\n" + body + "@deco\nclass B:\n" + body + "async def c():\n" + body
    parts = code.chunk_code(source, 150, 5)
    assert len(parts) == 3 and parts[0].startswith("import os") and parts[1][20:].startswith("class B") and parts[1][:20] == parts[0][-20:]
    rows = "".join(f"line {i:04d}\n" for i in range(200))
    lines = code.chunk_code(rows, 50, 5, boundaries=False)
    assert all(len(p) <= 200 for p in lines) and lines[1].startswith(lines[0][-20:]) and lines[-1].endswith("line 0199\n")


SOURCE = '''"""Doc."""
from acme.frames import A, B as Bee
import os
from . import near

__all__ = ["K"]

@dataclass
class K(Base, mixin.M):
    """Class doc."""

    @abstractmethod
    async def run(self, a, /, b: int = 1, *args, c, d=2, **kw) -> str:
        x = A(1)
        self.go(lambda: self.hidden())
        yield Bee(x)
        yield plain
        K.make()
        super().run()
        def inner():
            self.inner_call()
        near.thing()
        os.path

    def tiny(self): ...

def top(A):
    """Shadowed."""
    A()
    return [self.m() for _ in x]
'''


def test_python_symbols():
    rows = code.python_symbols(SOURCE, "pkg.mod", "acme")
    kinds = [(r["chunk_type"], r.get("class_name"), r.get("method_name")) for r in rows]
    assert kinds == [("module_overview", None, None), ("class_overview", "K", None), ("method", "K", "run"), ("function", None, "top")]
    overview, cls, run, top = rows
    assert "Exports: K" in overview["content"] and cls["is_dataclass"] and cls["base_classes"] == ["Base", "mixin.M"]
    assert run["method_signature"] == "(self, a, /, b: int = 1, *args, c, d = 2, **kw) -> str" and run["is_abstract"] and run["return_type"] == "str"
    assert run["yields"] == ["Bee"] and run["calls"] == ["go", "K.make", "super().run"]
    assert run["imports"] == ["from acme.frames import A", "from acme.frames import B as Bee", "from . import near"]
    assert top["imports"] == [] and top["calls"] == ["m"]
    assert any(r.get("method_name") == "tiny" for r in code.python_symbols(SOURCE, "m", "acme", stub=True)) and code.python_symbols(" ", "m", "acme") == []


def test_files_that_do_not_parse_are_rows(spark):
    files = spark.createDataFrame([("r", "src/p/a.py", "p.a", "def f(:"), ("r", "src/p/b.py", "p.b", SOURCE)], "repo string, path string, module_path string, content string")
    rows = code.parse_python(files, "acme")
    assert rows.filter("error like 'SyntaxError%'").count() == 1
    types = spark.createDataFrame([("run", ["T"])], "method_name string, related_types array<string>")
    chunks = code.symbol_chunks(rows, "sha", types)
    assert chunks.select("chunk_id").distinct().count() == 4 and chunks.filter("method_name = 'run'").first()["related_types"] == ["T"]


def test_discovery(spark, tmp_path):
    tree = {
        "examples/topic/one/bot.py": "x", "examples/topic/one/README.md": "# T\n\nA voice bot\nwith tools.\n\nmore", "examples/flat/main.py": "import daily\nclass MyBot: pass", "src/pkg/__init__.py": "# package", "src/pkg/m.py": "y = 1",
        "src/loose/m.py": "z", "docs/types.rst": "r", "stub.pyi": "s", "package.json": "{}", "client/app.ts": "t", "client/app.d.ts": "t", "node_modules/x.js": "n", "big.py": "#" * 600_000,
    }
    for name, body in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "linked").symlink_to("/etc")
    files = code.read_files(spark, f"file://{tmp_path}", "org/r")
    assert {r["path"] for r in files.select("path").collect()} == set(tree)
    kept = {r["path"] for r in code.code_files(files, ("client",)).collect()}
    assert "node_modules/x.js" not in kept and "big.py" not in kept and "client/app.ts" not in kept and "src/pkg/m.py" in kept
    assert {r["path"] for r in code.code_files(files, deep=False).collect()} == {"package.json"}
    dirs = code.example_dirs(files)
    assert {r["dir"] for r in dirs.collect()} == {"examples/topic/one", "examples/flat"}
    kinds = {(r["kind"], r["path"]) for r in code.source_files(files).collect()}
    assert kinds == {("python", "src/pkg/__init__.py"), ("python", "src/pkg/m.py"), ("typescript", "client/app.ts"), ("stub", "stub.pyi"), ("rst", "docs/types.rst")}
    made = {r["path"]: r for r in taxonomy.entries(files, dirs).collect()}
    one = made["examples/topic/one"]
    assert one["summary"] == "A voice bot with tools." and one["key_files"] == ["README.md", "bot.py"]
    assert {c["name"] for c in made["examples/flat"]["capabilities"]} == {"daily", "bot"}
    assert {c["name"] for c in one["capabilities"]} >= {"topic"}
    located = {r["path"]: r["entry"] for r in taxonomy.for_files(files, taxonomy.entries(files, dirs)).collect()}
    assert located["examples/flat/main.py"]["example_id"] == "org/r/examples/flat" and located["stub.pyi"] is None
    assert taxonomy.by_tag(taxonomy.entries(files, dirs), "daily").count() == 1
    chunks = code.chunk_files(files.filter("path = 'examples/flat/main.py'"), "sha").first()
    assert (chunks["line_start"], chunks["line_end"], chunks["language"]) == (1, 2, "python")
    rows = {r["path"]: r for r in ingest.example_chunks(files, "sha", "acme-ai", framework="1.0").filter("path like 'examples/%py'").collect()}
    assert rows["examples/flat/main.py"]["capability_tags"] == ["daily", "bot"] and rows["examples/flat/main.py"]["execution_mode"] == "cloud" and rows["examples/flat/main.py"]["pipeline_version_pin"] == "1.0"
    assert rows["examples/topic/one/bot.py"]["readme_content"].startswith("# T")
    kinds = {r["chunk_type"] for r in ingest.source_chunks(files, "sha", "acme").collect()}
    assert kinds == {"module_overview"}
    (tmp_path / "dump.txt").write_text("# A\nSource: https://d/a\nbody")
    assert ingest.docs_chunks(spark, f"file://{tmp_path}/dump.txt").first()["path"] == "/a"


def test_example_folders_of_all_code_kinds(spark):
    listed = {
        "a": ["examples/web/app.ts", "examples/topic/one/bot.js", "examples/topic/two/notes.md", "examples/node_modules/x/y.js", "examples/top.yaml"],
        "b": ["bot/main.tsx", "docs/conf.py", ".hidden/x.py", "deep/in/x.py", "README.md"],
        "c": ["src/pkg/m.py"],
        "d": ["examples/readme.md", "bot/main.py"],
    }
    files = spark.createDataFrame([(r, p) for r, ps in listed.items() for p in ps], "repo string, path string")
    got = sorted(tuple(r) for r in code.example_dirs(files).collect())
    assert got == [("a", "examples"), ("a", "examples/topic/one"), ("a", "examples/topic/two"), ("a", "examples/web"), ("b", "bot"), ("c", ".")]
    kinds = spark.createDataFrame([("r", p, 1) for p in ("x.md", "x.sh", "x.jsx", "a/.ruff_cache/x.py", ".tox/x.py")], "repo string, path string, length long")
    assert {r["path"] for r in code.code_files(kinds).collect()} == {"x.jsx", ".tox/x.py"}


def test_fingerprint_regards_content_not_order(spark):
    from gleanstone.plans.refresh import fingerprint

    def of(*rows):
        return fingerprint(spark.createDataFrame([("s", r) for r in rows], "k string, c string"), "k", "c").first()["fingerprint"]

    assert of("a", "b", None) == of("b", None, "a") and len({of("a", "b"), of("a", "a"), of("a"), of("a", "a", "b"), of("ab")}) == 5


def test_readme_summary():
    assert taxonomy.readme_summary("# H\n\n" + "w " * 200) == ("w " * 99)[:197].strip() + "..." or len(taxonomy.readme_summary("# H\n\n" + "w " * 200)) == 200
    assert taxonomy.readme_summary("# only") == ""


def test_pins(spark):
    assert pins.pin_of("requirements.txt", "# c\nother==1\nacme_ai[daily]>=0.0.50 ; python_version > '3'\n", "acme-ai") == ">=0.0.50"
    toml = '[project]\ndependencies = ["x", "acme-ai[all]~=0.0.9"]\n'
    assert pins.pin_of("pyproject.toml", toml, "acme-ai") == "~=0.0.9" and pins.pin_of("pyproject.toml", "not toml [", "p") is None
    assert pins.pin_of("package.json", json.dumps({"dependencies": {"@acme/client": "^1.2"}}), "acme-ai", "@acme/") == "^1.2" and pins.pin_of("package.json", "[]", "p") is None
    found = spark.createDataFrame([("r", "", "requirements.txt", "1", 2), ("r", "a", "pyproject.toml", "2", 1), ("r", "a", "requirements.txt", "3", 2)], "repo string, dir string, name string, pin string, prio int")
    dirs = spark.createDataFrame([("r", "a/b"), ("r", "c"), ("r", "."), ("q", "a")], "repo string, dir string")
    assert {(r["repo"], r["dir"]): r["pin"] for r in pins.nearest_pins(dirs, found).collect()} == {("r", "a/b"): "2", ("r", "c"): "1", ("r", "."): "1"}
    files = spark.createDataFrame([("r", "a/requirements.txt", "acme-ai==1.0"), ("r", "b/x.py", "")], "repo string, path string, content string")
    assert [(r["dir"], r["pin"]) for r in pins.file_pins(files, "acme-ai").collect()] == [("a", "==1.0")]


RST = """.. _Opts:

Opts
----

.. list-table::
   :widths: 10 20
   :header-rows: 1

   * - Key
     - Value
   * - "name"
     - `Other`_
   * - "n"
     - int
       or more

.. _Either:

Either
------

.. list-table::

   * - "a"
     - str

or

.. list-table::

   * - "b"
     - int

.. _Mode:

Mode
----

"x" | "y"

prose

.. _Alias:

Alias
-----

See :class:`Opts` here.
"""


def test_rst_types(spark):
    made = {t["name"]: t for t in rst.rst_types(RST)}
    assert made["Opts"]["fields"] == [("name", "Other"), ("n", "int or more")] and made["Opts"]["refs"] == ["Other"] and made["Opts"]["line_start"] == 1
    assert made["Either"]["kind"] == "dict_or" and made["Either"]["alternatives"] == [[("a", "str")], [("b", "int")]]
    assert made["Mode"]["kind"] == "enum" and made["Mode"]["headline"] == '"x" | "y"' and made["Alias"]["kind"] == "alias" and made["Alias"]["headline"] == ""
    rows = rst.parse_rst(spark.createDataFrame([("r", "docs/t.rst", RST), ("r", "docs/e.rst", "")], "repo string, path string, content string"))
    assert rows.count() == 4 and rows.filter("class_name = 'Opts'").first()["fields"][1]["key"] == "n"


def test_typescript(spark):
    source = "/** Doc. */\nexport class A {\n  m(a: string): void;\n  m(a: any) { this.go(); }\n}\nexport const K: number = 3;\nconst hidden = 1;\nexport function f(a: { x: number }): string { return '}'; }\nexport type T =\n  | 'a'\n  | 'b';\n"
    found = {(x["kind"], x["name"]): x for x in typescript.ts_declarations(source)}
    assert set(found) == {("class", "A"), ("method", "m"), ("const", "K"), ("function", "f"), ("type", "T")}
    assert found["class", "A"]["doc"] == "Doc." and found["method", "m"]["calls"] == ["go"] and found["type", "T"]["line_end"] == 11
    rows = typescript.parse_ts(spark.createDataFrame([("r", "a.ts", source)], "repo string, path string, content string"))
    assert rows.select("chunk_id").distinct().count() == 5


def test_deprecations(spark, tmp_path):
    proxy = 'DeprecatedModuleProxy(globals(), "grok", "xai.[llm,tts]")\nDeprecatedModuleProxy(\n  globals(),\n "old",\n "new",\n)'
    entries = deprecation.from_proxies(spark.createDataFrame([("src/acme/services/grok/__init__.py", proxy)], "path string, content string")).orderBy("old_path").collect()
    assert [(e["old_path"], e["new_path"]) for e in entries] == [("acme.services.grok", "acme.services.xai.llm, acme.services.xai.tts"), ("acme.services.old", "acme.services.new")]
    body = "### Added\n- x\n### Deprecated\n- `acme.a.b` is old,\n  use `acme.c` instead\n- `FooService` goes\n### Removed\n- prose only\n"
    got = deprecation.release_entries("1.0", body, "acme")
    assert [(e["old_path"], e["new_path"], e["deprecated_in"], e["removed_in"]) for e in got] == [("acme.a.b", "acme.c", "1.0", None), ("FooService", None, "1.0", None), ("release:1.0:prose only", None, None, "1.0")]
    releases = spark.createDataFrame([("1.1", "### Removed\n- `acme.a.b` gone"), ("1.0", body)], "version string, body string")
    merged, notes = deprecation.from_releases(releases, "acme")
    row = merged.filter("old_path = 'acme.a.b'").first()
    assert (row["deprecated_in"], row["removed_in"], row["new_path"]) == ("1.0", "1.1", "acme.c") and notes.count() == 1
    table = spark.createDataFrame([("a.b", "n1", None, None, "", 0), ("a.b.c", "n2", None, None, "", 1), ("z", None, None, None, "", 2)], deprecation.ENTRIES)
    asked = spark.createDataFrame([("a.b.c",), ("a.b.x",), ("a",), ("ab",), ("z",)], "symbol string")
    assert {r["symbol"]: r["old_path"] for r in deprecation.check(table, asked).collect()} == {"a.b.c": "a.b.c", "a.b.x": "a.b", "a": "a.b", "ab": None, "z": "z"}
    deprecation.save(table, f"{tmp_path}/map")
    assert deprecation.load(spark, f"{tmp_path}/map").count() == 3
    (tmp_path / "bad.json").write_text("{nope")
    assert deprecation.load(spark, f"{tmp_path}/bad.json").count() == 0


def test_settings():
    env = "HUB_REPOS='a/b, c/d@v1,a/b'\n# x\nHUB_RERANKER=yes\nHUB_RRF_K=30"
    s = settings.Settings.load(env, {"HUB_RRF_K": "40", "HUB_TAINTED_REPOS": "c/d"})
    assert s.repos == ["a/b", "c/d@v1"] and s.reranker and s.rrf_k == 40 and s.effective_repos() == ["a/b"]
    assert settings.repo_ref("c/d@v1") == ("c/d", "v1")
    for bad in ("x", "a/../b", "a b/c"):
        with pytest.raises(ValueError):
            settings.repo_ref(bad)
    with pytest.raises(ValueError):
        settings.Settings.load("", {"HUB_LOW_SCORE": "x"})
