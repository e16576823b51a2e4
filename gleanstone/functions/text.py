"""Text expressions: each takes and returns Columns, and runs inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and the languages they stand for.
LANGUAGE_BY_EXTENSION = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "md": "markdown", "yaml": "yaml",
    "yml": "yaml", "toml": "toml", "json": "json", "sh": "shell", "dockerfile": "dockerfile", "html": "html", "css": "css",
}

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def estimated_tokens(content: Column) -> Column:
    return F.floor(F.length(content) / 4)


def hex_id(length: int, *parts: Column, sep: str = "|") -> Column:
    """The first digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(sep, *[p.cast("string") for p in parts]), 256), 1, length)


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def words(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def query_symbols(query: Column) -> Column:
    """Identifiers that look like code: camel case, underscores, dots, or capitals only (two or more)."""
    found = F.regexp_extract_all(query, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)"), 1)
    return F.filter(found, lambda t: t.rlike(r"[a-z][A-Z]") | t.contains("_") | t.contains(".") | ((F.length(t) >= 2) & t.rlike("[A-Z]") & ~t.rlike("[a-z]")))


def concepts(query: Column, most: int = 5) -> Column:
    """The parts of a query around ` + ` and ` & `; an empty array if there are fewer than two."""
    found = F.filter(F.transform(F.split(query, r"\s+[+&]\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(found) > 1, F.slice(found, 1, most)).otherwise(F.array().cast("array<string>"))


def snippet(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def statement(content: Column, n: int = 200) -> Column:
    return F.when(F.length(content) > n, F.concat(F.substring(content, 1, n), F.lit("..."))).otherwise(content)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.when(F.lower(path).rlike(r"(^|/)dockerfile$"), F.lit("dockerfile")).otherwise(extension(path)))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def source_link(repo: Column, sha: Column, path: Column, first: Column, last: Column) -> Column:
    """A blob link, with lines if both are known and not 0."""
    lines = F.when((first > 0) & (last > 0), F.concat(F.lit("#L"), first.cast("string"), F.lit("-L"), last.cast("string"))).otherwise("")
    return F.concat(F.lit("https://github.com/"), repo, F.lit("/blob/"), sha, F.lit("/"), path, F.coalesce(lines, F.lit("")))


def domain(path: Column, lang: Column | None = None) -> Column:
    """infra, config, frontend or backend, by where a file lies and what it is."""
    low = F.lower(path)
    ext = extension(path)
    return (
        F.when(low.rlike(r"(^|/)(ci|\.github|deploy|deployment|infra|terraform|k8s|helm|docker)/") | low.rlike(r"(^|/)dockerfile"), "infra")
        .when(ext.isin("yaml", "yml", "toml", "json", "ini", "cfg", "env"), "config")
        .when(ext.isin("ts", "tsx", "js", "jsx", "html", "css") | low.rlike(r"(^|/)(client|frontend|web|ui)/"), "frontend")
        .otherwise("backend")
    )


def execution_mode(tags: Column, cloud: list[str]) -> Column:
    return F.when(F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in cloud])), F.lit(False)), "cloud").otherwise("local")


def slug(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "_")


def is_repo_slug(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") & ~name.contains("..")


def module_path(path: Column) -> Column:
    """src/pkg/mod.py is pkg.mod; a package's __init__ is the package."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^(.*/)?src/", ""), r"\.pyi?$", "")
    return F.regexp_replace(F.translate(inner, "/", "."), r"\.__init__$", "")


def bracket_modules(path: Column) -> Column:
    """a.[x,y] is a.x and a.y; a path without brackets is itself."""
    head = F.regexp_extract(path, r"^([^\[]*)\[", 1)
    inner = F.regexp_extract(path, r"\[([^\]]*)\]", 1)
    tail = F.regexp_extract(path, r"\](.*)$", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(path.rlike(r"\[[^\]]*\]"), F.transform(parts, lambda x: F.concat(head, x, tail))).otherwise(F.array(path))


def plain_rst(text: Column) -> Column:
    """Roles, links, emphasis and literal marks become their text."""
    out = F.regexp_replace(text, r":[a-zA-Z:]+:`([^`<]*?)\s*(?:<[^>]*>)?`", "$1")
    out = F.regexp_replace(out, r"`([^`<]*?)\s*<[^>]*>`__?", "$1")
    out = F.regexp_replace(out, r"`([^`]+)`_?", "$1")
    return F.trim(F.regexp_replace(out, r"\*{1,2}([^*]+)\*{1,2}", "$1"))


def rst_refs(text: Column, most: int = 50) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r":ref:`(?:[^`<]*<)?([^`<>]+)>?`"), 1)), 1, most)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_slice(text: Column, first: Column, count: Column) -> Column:
    """count lines from line `first` (1-based)."""
    return F.array_join(F.slice(lines(text), F.greatest(first, F.lit(1)), F.greatest(count, F.lit(0))), "\n")


def json_list(raw: Column) -> Column:
    """A JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def qualified_calls(class_name: Column, calls: Column) -> Column:
    """Calls with their class, but for dotted ones and those of super()."""
    own = F.coalesce(class_name, F.lit(""))
    return F.transform(calls, lambda c: F.when((own != "") & ~c.contains(".") & ~c.startswith("super()"), F.concat(own, F.lit("."), c)).otherwise(c))


def expectations(yields: Column, bases: Column) -> Column:
    made = F.array(
        F.when(F.size(yields) > 0, F.concat(F.lit("Yields: "), F.array_join(yields, ", "))),
        F.when(F.size(bases) > 0, F.concat(F.lit("Implements: "), F.array_join(bases, ", "))),
    )
    return F.filter(made, lambda x: x.isNotNull())


def like_escaped(value: str) -> str:
    """value with the wildcards of LIKE escaped by a backslash."""
    return "".join("\\" + c if c in "\\%_" else c for c in value)
