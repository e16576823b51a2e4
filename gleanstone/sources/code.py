"""Source files: scans, chunks at boundaries, and the symbols of Python modules.

A file's text fits a row, so parsers are row-local functions behind mapInPandas; a file that cannot be parsed gives an error row, not a failed job.
"""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import extension, hex_id, language

MAX_FILE_BYTES = 512_000
#: What counts as code, folders that are never entered, and folders at the top that hold no examples.
CODE_EXTENSIONS = ("py", "js", "ts", "jsx", "tsx", "json", "yaml", "yml", "toml")
SKIPPED = ("__pycache__", ".git", "node_modules", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".egg-info")
NO_EXAMPLES = ("src", "lib", "docs", "doc", "tests", "test", "scripts", "tools", "ci", ".github", ".tox", ".nox", "assets", "static", "bin", "include", "man", "config", "deploy")
CHARS_PER_TOKEN = 4


def read_files(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """repo, path (below root), length, content of all files below root.

    Paths are listed once, and links are neither followed nor read, whatever lies behind them. Files of a local root, which all executors must see, are read by the tasks. Those of any other
    file system are read by Spark; as its readers pass over names that begin with an underscore, files named so (*.py and *.pyi up to MAX_FILE_BYTES, few) are read by the driver.
    """
    local = re.sub(r"^file:/+", "/", root).rstrip("/") or "/"
    out = _stored_files(spark, root) if "://" in local else _local_files(spark, local)
    return out.select(F.lit(repo).alias("repo"), "path", "length", "content")


FILES = "path string, length long, content string"


def _local_files(spark: SparkSession, root: str) -> DataFrame:
    paths = [(os.path.relpath(at, root),) for folder, _, names in os.walk(root) for name in names if os.path.isfile(at := os.path.join(folder, name)) and not os.path.islink(at)]  # os.walk enters no links

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open(os.open(os.path.join(root, path), os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
                    raw = f.read()
                yield pd.DataFrame({"path": [path], "length": [len(raw)], "content": [raw.decode("utf-8", "replace")]})

    listed = spark.createDataFrame(paths, "path string")
    return listed.repartition(max(1, min(len(paths) // 64 + 1, 4096))).mapInPandas(read, FILES)


def _stored_files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].partition("/")[2]
    inner = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z0-9+.-]+:/+[^/]*/", "/"), "^/*" + re.escape(base) + "/*", "")
    plain = files.select(inner.alias("path"), "length", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return plain.unionByName(spark.createDataFrame(_underscored(spark, root, base), FILES))


def _underscored(spark: SparkSession, root: str, base: str) -> list[tuple[str, int, str]]:
    jvm, out = spark.sparkContext._jvm, []
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = fs.listFiles(top, True)
    while listed.hasNext():
        at = listed.next()
        name, size = at.getPath().getName(), at.getLen()
        path = at.getPath().toUri().getPath().lstrip("/").removeprefix(base).lstrip("/")
        if name.startswith("_") and name.endswith((".py", ".pyi")) and size <= MAX_FILE_BYTES and not set(path.split("/")) & set(SKIPPED):
            stream = fs.open(at.getPath())
            try:
                out.append((path, size, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")))
            finally:
                stream.close()
    return out


def code_files(files: DataFrame, skip_roots: tuple[str, ...] = (), deep: bool = True) -> DataFrame:
    """Files of the known kinds and sizes outside skipped folders; skip_roots hold only at the top."""
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    keep = extension(F.col("path")).isin(*CODE_EXTENSIONS) & (F.col("length") <= MAX_FILE_BYTES) & ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED]))
    if skip_roots:
        keep &= ~F.coalesce(F.get(folders, 0).isin(*skip_roots), F.lit(False))
    if not deep:
        keep &= F.size(parts) == 1
    return files.filter(keep)


def example_dirs(files: DataFrame, repo: str = "repo") -> DataFrame:
    """repo, dir: the folders of examples, where code is any file of CODE_EXTENSIONS.

    With examples/: its children that hold code, the children of those that hold none, and examples/ itself if it holds code. Without it: folders at the top that hold code, but for hidden ones and NO_EXAMPLES; if there is none, the root.
    """
    entered = lambda parts: ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED]))
    rows = files.select(repo, F.split("path", "/").alias("p"), extension(F.col("path")).isin(*CODE_EXTENSIONS).alias("code"))
    inside = rows.filter((F.get("p", F.lit(0)) == "examples") & (F.size("p") > 1)).filter(entered(F.slice("p", 2, 2)) | (F.size("p") == 2))
    flat = inside.filter("code and size(p) = 2").select(repo, F.lit("examples").alias("dir")).distinct()
    direct = inside.filter("code and size(p) = 3").select(repo, F.concat_ws("/", F.slice("p", 1, 2)).alias("dir")).distinct()
    deeper = inside.filter("size(p) > 3").select(repo, F.concat_ws("/", F.slice("p", 1, 2)).alias("top"), F.concat_ws("/", F.slice("p", 1, 3)).alias("dir")).distinct()
    deeper = deeper.join(direct.select(repo, F.col("dir").alias("top")), [repo, "top"], "left_anti").select(repo, "dir")
    whole = rows.filter((F.get("p", F.lit(0)) == "examples") & (F.size("p") > 1)).select(repo).distinct()
    top = F.get("p", F.lit(0))
    roots = rows.filter(F.col("code") & (F.size("p") == 2) & ~top.startswith(".") & ~top.isin(*SKIPPED, *NO_EXAMPLES)).select(repo, top.alias("dir")).distinct().join(whole, repo, "left_anti")
    none = files.select(repo).distinct().join(whole.union(roots.select(repo)).distinct(), repo, "left_anti").select(repo, F.lit(".").alias("dir"))
    return flat.unionByName(direct).unionByName(deeper).unionByName(roots).unionByName(none)


def source_files(files: DataFrame) -> DataFrame:
    """Files with `kind`: python below src/ in packages, stub at the root, rst below docs, typescript where a package or compiler file is at the top or one level down."""
    p, ext = F.col("path"), extension(F.col("path"))
    packages = files.filter(p.rlike(r"^src/[^/]+/__init__\.py$")).select("repo", F.regexp_extract(p, r"^(src/[^/]+)/", 1).alias("pkg")).distinct()
    python = files.filter((ext == "py") & p.startswith("src/")).withColumn("pkg", F.regexp_extract(p, r"^(src/[^/]+)/", 1)).join(packages, ["repo", "pkg"], "left_semi").drop("pkg").withColumn("kind", F.lit("python"))
    marked = files.filter(p.rlike(r"^([^/]+/)?(package|tsconfig)\.json$")).select("repo").distinct()
    ts = files.filter(ext.isin("ts", "tsx") & ~p.endswith(".d.ts")).join(marked, "repo", "left_semi").withColumn("kind", F.lit("typescript"))
    stubs = files.filter((ext == "pyi") & ~p.contains("/")).withColumn("kind", F.lit("stub"))
    rst = files.filter((ext == "rst") & p.startswith("docs/")).withColumn("kind", F.lit("rst"))
    out = python.select(*files.columns, "kind")
    for more in (ts, stubs, rst):
        out = out.unionByName(more.select(*files.columns, "kind"))
    return out


BOUNDARY = re.compile(r"(?:async\s+def|def|class)\s|@")


def _tail(pieces: list[str], room: int) -> list[str]:
    keep = len(pieces)
    while keep and len(pieces[keep - 1]) <= room:
        keep -= 1
        room -= len(pieces[keep])
    return pieces[keep:]


def chunk_code(source: str, max_tokens: int = 256, overlap_tokens: int = 25, boundaries: bool = True) -> list[str]:
    """Parts of a source of at most about max_tokens: whole top-level definitions put together, each part led by the end of the one before; without any, whole lines."""
    if len(source) // CHARS_PER_TOKEN <= max_tokens:
        return [source]
    rows, overlap = source.splitlines(keepends=True), overlap_tokens * CHARS_PER_TOKEN
    starts = [i for i, row in enumerate(rows) if BOUNDARY.match(row)] if boundaries else []
    if starts:
        cuts = [0, *starts[1:], len(rows)]
        parts: list[str] = []
        for a, b in zip(cuts, cuts[1:]):
            unit = "".join(rows[a:b])
            if parts and len(parts[-1] + unit) // CHARS_PER_TOKEN <= max_tokens:
                parts[-1] += unit
            else:
                parts.append(unit)
        return parts[:1] + [(before[-overlap:] if overlap else "") + own for before, own in zip(parts, parts[1:])]
    out, held = [], []
    for row in rows:
        if held and sum(map(len, held)) + len(row) > max_tokens * CHARS_PER_TOKEN:
            out.append("".join(held))
            held = _tail(held, overlap)
        held.append(row)
    return [*out, "".join(held)] if held else out


def chunk_files(files: DataFrame, sha: str = "", max_tokens: int = 256, overlap_tokens: int = 25) -> DataFrame:
    """Chunk rows of files (repo, path, content), with line ranges: a chunk starts on the line after the last of the one before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (repo, path, k, part, len(text.splitlines()))
                for repo, path, text in zip(batch["repo"], batch["path"], batch["content"].fillna(""))
                for k, part in enumerate(chunk_code(text, max_tokens, overlap_tokens, path.endswith(".py")))
                if part.strip()
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["repo", "path", "chunk_index", "content", "file_lines"])

    cut = files.select("repo", "path", "content").mapInPandas(run, "repo string, path string, chunk_index int, content string, file_lines int")
    n = F.size(F.split(F.regexp_replace("content", r"\n$", ""), "\n"))
    up = Window.partitionBy("repo", "path").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    last = F.least(F.sum(n).over(up), F.col("file_lines")).cast("int")
    first = F.least(F.sum(n).over(up) - n + 1, F.col("file_lines")).cast("int")
    return cut.select(
        hex_id(24, F.col("repo"), F.col("path"), F.lit(sha), F.col("chunk_index"), sep=":").alias("chunk_id"), "content", F.lit("code").alias("content_type"), "repo", "path",
        F.lit(sha).alias("commit_sha"), "chunk_index", first.alias("line_start"), last.alias("line_end"), language(F.col("path")).alias("language"),
    )


Scope = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
Function = (ast.FunctionDef, ast.AsyncFunctionDef)


def own_nodes(body: list[ast.stmt]) -> Iterator[ast.AST]:
    """The nodes of a body in source order, without those of inner functions, classes and lambdas."""
    for node in body:
        if not isinstance(node, Scope):
            yield node
            yield from own_nodes(list(ast.iter_child_nodes(node)))


def parameters(args: ast.arguments) -> list[str]:
    """Each parameter as written, with the marks / and *."""

    def shown(a: ast.arg, default: ast.expr | None = None, star: str = "") -> str:
        note = f": {ast.unparse(a.annotation)}" if a.annotation else ""
        return f"{star}{a.arg}{note}" + (f" = {ast.unparse(default)}" if default else "")

    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    out = [shown(a, d) for a, d in zip(plain, defaults)]
    if args.posonlyargs:
        out.insert(len(args.posonlyargs), "/")
    if args.vararg:
        out.append(shown(args.vararg, star="*"))
    elif args.kwonlyargs:
        out.append("*")
    out += [shown(a, d) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    return out + ([shown(args.kwarg, star="**")] if args.kwarg else [])


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    return f"({', '.join(parameters(node.args))})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def yielded(nodes: list[ast.AST]) -> list[str]:
    """Names of what is constructed in a yield."""
    made = [n.value.func for n in nodes if isinstance(n, ast.Yield) and isinstance(n.value, ast.Call)]
    return list(dict.fromkeys(ast.unparse(f) for f in made if isinstance(f, (ast.Name, ast.Attribute))))


def called(nodes: list[ast.AST]) -> list[str]:
    """Methods called on self, on a class, or on super()."""
    out = []
    for f in (n.func for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)):
        on = f.value
        if isinstance(on, ast.Name) and (on.id == "self" or on.id[:1].isupper()):
            out.append(f.attr if on.id == "self" else f"{on.id}.{f.attr}")
        elif isinstance(on, ast.Call) and isinstance(on.func, ast.Name) and on.func.id == "super":
            out.append(f"super().{f.attr}")
    return list(dict.fromkeys(out))


def imported(nodes: list[ast.AST]) -> dict[str, str]:
    """The name that each import binds, and the import of that name alone."""
    out = {}
    for n in nodes:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            head = f"from {'.' * n.level}{n.module or ''} import " if isinstance(n, ast.ImportFrom) else "import "
            for a in n.names:
                bound = a.asname or (a.name if isinstance(n, ast.ImportFrom) else a.name.partition(".")[0])
                out[bound] = head + a.name + (f" as {a.asname}" if a.asname else "")
    return out


def used_imports(node: ast.FunctionDef | ast.AsyncFunctionDef, names: dict[str, str], inside: str) -> list[str]:
    """The module's imports of package `inside`, or relative ones, that a body uses; names bound in the function hide them."""
    nodes, a = list(own_nodes(node.body)), node.args
    bound = {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x}
    bound |= {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | set(imported(nodes))
    used = [names[n.id] for n in nodes if isinstance(n, ast.Name) and n.id in names and n.id not in bound]
    return list(dict.fromkeys(u for u in used if inside in u or u.startswith("from .")))


def _exports(tree: ast.Module) -> list[str]:
    for n in tree.body:
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
            return [e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return []


def python_symbols(source: str, module: str, package: str, stub: bool = False, least_lines: int = 3) -> list[dict]:
    """Rows for a module: an overview, each class, and each method and function of least_lines or more (all, in a stub). Raises SyntaxError."""
    if not source.strip():
        return []
    tree, rows = ast.parse(source), source.splitlines()
    names = imported(tree.body)
    marks = lambda n: [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in n.decorator_list]
    classes, functions = [n for n in tree.body if isinstance(n, ast.ClassDef)], [n for n in tree.body if isinstance(n, Function)]
    exports = _exports(tree)
    out = [
        {
            "chunk_type": "module_overview", "line_start": 1, "line_end": len(rows), "imports": list(names.values()),
            "content": "\n".join(x for x in (f"# Module: {module}", ast.get_docstring(tree), f"Exports: {', '.join(exports)}" if exports else None, f"Classes: {', '.join(c.name for c in classes)}" if classes else None, f"Functions: {', '.join(f.name for f in functions)}" if functions else None) if x),
        }
    ]

    def function(n: ast.FunctionDef | ast.AsyncFunctionDef, owner: ast.ClassDef | None) -> None:
        if not stub and n.end_lineno - n.lineno + 1 < least_lines:
            return
        nodes = list(own_nodes(n.body))
        head = f"# {owner.name}.{n.name}" if owner else f"# {n.name}"
        out.append(
            {
                "chunk_type": "method" if owner else "function", "class_name": owner.name if owner else None, "method_name": n.name, "method_signature": signature(n),
                "return_type": ast.unparse(n.returns) if n.returns else None, "is_abstract": any("abstractmethod" in m for m in marks(n)), "line_start": n.lineno, "line_end": n.end_lineno,
                "base_classes": [ast.unparse(b) for b in owner.bases] if owner else [], "imports": used_imports(n, names, package), "yields": yielded(nodes), "calls": called(nodes),
                "content": f"{head} in {module}\n" + "\n".join(rows[n.lineno - 1 : n.end_lineno]),
            }
        )

    for c in classes:
        methods = [m for m in c.body if isinstance(m, Function)]
        listed = [f"  {m.name}{signature(m)}" for m in methods]
        bases = [ast.unparse(b) for b in c.bases]
        out.append(
            {
                "chunk_type": "class_overview", "class_name": c.name, "base_classes": bases, "is_dataclass": any("dataclass" in m for m in marks(c)), "line_start": c.lineno, "line_end": c.end_lineno,
                "content": "\n".join(x for x in (f"# class {c.name}({', '.join(bases)}) in {module}", ast.get_docstring(c), *listed) if x),
            }
        )
        for m in methods:
            function(m, c)
    for f in functions:
        function(f, None)
    return out


SYMBOL_COLUMNS = (
    "chunk_type string, class_name string, method_name string, method_signature string, return_type string, is_dataclass boolean, is_abstract boolean, line_start int, line_end int, "
    "base_classes array<string>, imports array<string>, yields array<string>, calls array<string>, content string"
)


def parse_python(files: DataFrame, package: str) -> DataFrame:
    """Rows of python_symbols for files (repo, path, module_path, content); a file that does not parse gives one row with `error`."""
    names = [c.split()[0] for c in SYMBOL_COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                try:
                    found = [(x, None) for x in python_symbols(f.content or "", f.module_path, package, f.path.endswith(".pyi"))]
                except (SyntaxError, ValueError, RecursionError) as e:
                    found = [({}, f"{type(e).__name__}: {e}")]
                rows += [(f.repo, f.path, f.module_path, error, *(x.get(n) for n in names)) for x, error in found]
            if rows:
                yield pd.DataFrame(rows, columns=["repo", "path", "module_path", "error", *names]).astype({"line_start": "Int32", "line_end": "Int32"})

    return files.select("repo", "path", "module_path", "content").mapInPandas(run, f"repo string, path string, module_path string, error string, {SYMBOL_COLUMNS}")


def symbol_chunks(symbols: DataFrame, sha: str = "", types: DataFrame | None = None) -> DataFrame:
    """Chunk rows of parsed symbols; types (method_name, related_types) adds the types that a method's arguments refer to."""
    rows = symbols.filter("error is null") if "error" in symbols.columns else symbols
    if types is not None:
        rows = rows.join(F.broadcast(types), "method_name", "left")  # a fixed table of a few dozen methods
    empty = F.lit("")
    key = hex_id(24, F.col("repo"), F.col("path"), F.lit(sha), F.col("module_path"), F.coalesce("class_name", empty), F.coalesce("method_name", empty), F.col("chunk_type"), F.col("line_start"), sep=":")
    return rows.withColumn("chunk_id", key).withColumn("content_type", F.lit("source")).withColumn("commit_sha", F.lit(sha)).withColumn("language", language(F.col("path")))


def is_tainted(repo: Column, sha: Column, repos: list[str], refs: list[str]) -> Column:
    """Whether a repository, or a commit by the first 7 to 40 digits of its hash, is on a deny list."""
    out = repo.isin(*repos) if repos else F.lit(False)
    for ref in refs:
        if re.fullmatch(r"[0-9a-fA-F]{7,40}", ref):
            out |= F.coalesce(sha.startswith(ref.lower()), F.lit(False))
    return out
