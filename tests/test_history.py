"""Tags, versions, releases and layouts from tables."""

import json
import random


from gleanstone.operators import deprecation, taxonomy
from gleanstone.plans import refresh
from gleanstone.sources import history, releases

COMMITS, REFS, TAGS = "repo string, sha string, parents array<string>", "repo string, name string, sha string", "repo string, sha string, target string"


def test_tags_are_peeled_and_found(spark):
    refs = spark.createDataFrame([("r", "v1.0", "c1"), ("r", "2.0", "t2"), ("r", "v3", "t3"), ("r", "loop", "x"), ("q", "v1.0", "c9")], REFS)
    tags = spark.createDataFrame([("r", "t2", "c2"), ("r", "t3", "t4"), ("r", "t4", "t5"), ("r", "t5", "c3"), ("r", "x", "y"), ("r", "y", "x")], TAGS)
    assert {(r["repo"], r["name"], r["sha"]) for r in history.peeled(refs, tags).collect()} == {("r", "v1.0", "c1"), ("r", "2.0", "c2"), ("r", "v3", "c3"), ("q", "v1.0", "c9")}
    asked = spark.createDataFrame([("r", "1.0"), ("r", "v2.0"), ("r", "v3"), ("r", "4"), ("q", "v1.0"), ("r", "-bad"), ("r", "1.0")], "repo string, tag string")
    got = sorted((r["repo"], r["tag"], r["sha"]) for r in history.resolved(asked, refs, tags).collect() if r["sha"])
    assert got == [("q", "v1.0", "c9"), ("r", "1.0", "c1"), ("r", "1.0", "c1"), ("r", "v2.0", "c2"), ("r", "v3", "c3")]


def test_nearest_tags(spark):
    rnd = random.Random(4)
    commits, refs = [], []
    for repo in ("a", "b"):
        for i in range(60):
            parents = [f"{repo}{i - 1}"] if i else []
            if i > 6 and rnd.random() < 0.3:
                parents.append(f"{repo}{rnd.randrange(i - 6, i - 1)}")
            if i and rnd.random() < 0.1:
                parents.insert(0, f"{repo}{rnd.randrange(i)}")
            commits.append((repo, f"{repo}{i}", list(dict.fromkeys(parents))))
            refs += [(repo, f"v{i}", f"{repo}{i}")] * (i > 4 and rnd.random() < 0.12) + [(repo, f"u{i}", f"{repo}{i}")] * (rnd.random() < 0.03)
    commits.append(("a", "shallow", ["gone", "a59"]))
    parents, named = {c[1]: c[2] for c in commits}, {}
    for _, name, sha in refs:
        named.setdefault(sha, []).append(name)

    def nearest(sha):
        now, seen, d = {sha}, set(), 0
        while now:
            hits = [n for s in now for n in named.get(s, [])]
            if hits:
                return min(hits), d
            seen |= now
            now, d = {p for s in now for p in parents.get(s, [])} - seen, d + 1
        return None, None

    got = history.described(spark.createDataFrame(commits, COMMITS), spark.createDataFrame(refs, REFS), spark.createDataFrame([], TAGS)).collect()
    assert {(r["sha"], r["name"], r["distance"]) for r in got} == {(sha, *nearest(sha)) for _, sha, _ in commits} and len(got) == len(commits)
    assert all(r["version"] == (r["name"] and r["name"].lstrip("v")) for r in got)


def test_settled_commits_are_not_read_again(spark, monkeypatch):
    """A line of commits with a tag on each eleventh: what is written must not grow with the length of the line."""
    commits = [("a", f"c{i}", [f"c{i - 1}"] * (i > 0)) for i in range(2000)]
    refs = [("a", f"v{i}", f"c{i}") for i in range(5, 2000, 11)]
    tables, kept = [], history._kept
    monkeypatch.setattr(history, "_kept", lambda rows: tables.append(kept(rows)) or tables[-1])
    want = {(f"c{i}", f"v{i - (i - 5) % 11}" if i >= 5 else None, (i - 5) % 11 if i >= 5 else None) for i in range(2000)}

    def described():
        return {(r["sha"], r["name"], r["distance"]) for r in history.described(spark.createDataFrame(commits, COMMITS), spark.createDataFrame(refs, REFS), spark.createDataFrame([], TAGS)).collect()}

    assert described() == want and sum(t.count() for t in tables) < 8 * len(commits)
    monkeypatch.setattr(history, "SHARE", 0)  # the rest by doubling
    assert described() == want


def test_releases_are_followed(spark, tmp_path):
    page = lambda name, rows: (tmp_path / "pages" / name).write_text(json.dumps(rows))
    (tmp_path / "pages").mkdir()
    page("1.json", [{"tag_name": "v1.0", "body": "### Deprecated\n- `acme.a` goes, use `acme.b`\n- prose only", "published_at": "2025-01-01"}, {"tag_name": "v0.9", "body": " ", "published_at": "2024-01-01"}])
    page("2.json", {"tagName": "v1.1", "body": "### Removed\n- `acme.a` is gone", "publishedAt": "2025-02-01"})
    (tmp_path / "pages" / "bad.json").write_text("{not json")
    assert [r["version"] for r in releases.read_releases(spark, f"file://{tmp_path}/pages", 1).collect()] == ["1.1"] and releases.read_releases(spark, f"file://{tmp_path}/pages").count() == 2
    at = refresh.Releases(f"file://{tmp_path}/pages", f"file://{tmp_path}/map", f"file://{tmp_path}/check", "acme")
    first = {r["old_path"]: r for r in at.update(spark).collect()}
    assert set(first) == {"acme.a"} and (first["acme.a"]["new_path"], first["acme.a"]["deprecated_in"], first["acme.a"]["removed_in"]) == ("acme.b", "1.0", "1.1")
    assert at.update(spark).count() == 1 and len(list((tmp_path / "map").glob("batch=*"))) == 1
    page("3.json", [{"tag_name": "v1.2", "body": "### Deprecated\n- `acme.c` too"}])
    second = at.update(spark)
    assert {r["old_path"] for r in second.collect()} == {"acme.a", "acme.c"} and len(list((tmp_path / "map").glob("batch=*"))) == 2
    asked = spark.createDataFrame([("acme.a.x",), ("acme.z",)], "symbol string")
    assert {r["symbol"]: r["deprecated"] for r in deprecation.check(second, asked).collect()} == {"acme.a.x": True, "acme.z": False}


def test_layouts(spark):
    trees = {
        "numbered": ["examples/foundational/01-say/bot.py", "examples/foundational/02-x.py", "examples/foundational/README.md", "examples/chat/bot.py", "examples/voice/a/b.py", "src/p/x.py"],
        "topics": ["examples/tts/a.py", "examples/stt/one/b.py", "examples/stt/two/deep/c.py", "README.md"],
        "package": ["src/p.py", "tests/t.py", "demo/a.py", ".github/x.yml", "pyproject.toml"], "plain": ["tests/t.py", "one/a.py", "node_modules/x.js"], "bare": ["main.py", "src/x.py"], "flat": ["examples/a.py"],
    }
    files = spark.createDataFrame([(repo, path, "import daily\n# x") for repo, paths in trees.items() for path in paths], "repo string, path string, content string")
    assert {r["repo"]: r["layout"] for r in taxonomy.layouts(files).collect()} == {"numbered": "numbered", "topics": "topics", "package": "root", "plain": "root", "bare": "root", "flat": "root"}
    tree = {(r["repo"], r["dir"]): (r["code"], r["below"]) for r in taxonomy.path_tree(files).collect()}
    assert tree["numbered", "examples"] == (0, 4) and tree["topics", "examples/stt/two"] == (0, 1) and tree["bare", ""] == (1, 2)
    nodes = taxonomy.example_nodes(files)
    assert {(r["repo"], r["dir"], r["kind"]) for r in nodes.collect()} == {
        ("numbered", "examples/foundational/01-say", "folder"), ("numbered", "examples/foundational/02-x.py", "file"), ("numbered", "examples/chat", "topic"), ("numbered", "examples/voice/a", "topic"),
        ("topics", "examples/tts", "topic"), ("topics", "examples/stt/one", "topic"), ("topics", "examples/stt/two", "topic"), ("package", "demo", "project"), ("plain", "tests", "project"), ("plain", "one", "project"),
        ("bare", ".", "project"), ("flat", "examples", "project"),
    }
    made = {r["example_id"]: r for r in taxonomy.entries(files, nodes).collect()}
    flat = made["numbered/examples/foundational/02-x.py"]
    assert flat["foundational_class"] == "02-x" and flat["key_files"] == ["02-x.py"] and [c["name"] for c in flat["capabilities"]] == ["daily"]
    assert made["numbered/examples/foundational/01-say"]["foundational_class"] == "01-say" and made["topics/examples/tts"]["foundational_class"] is None
    assert {c["name"] for c in made["topics/examples/stt/one"]["capabilities"]} == {"daily", "stt"}
