"""Exported declarations of TypeScript files.

No TypeScript parser is installed here. The default reads the subset that a scanner for brackets, strings and comments can: exported
interfaces, classes with their methods, types, functions, enums and typed constants. Another parser can be passed in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hex_id

#: The kinds of declarations and the chunk types they become.
CHUNK_TYPE = {"interface": "type_definition", "type": "type_definition", "enum": "type_definition", "const": "type_definition", "class": "class_overview", "function": "function", "method": "method"}
EXPORT = re.compile(
    r"^[ \t]*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(interface|class|type|function\*?|(?:const\s+)?enum|const)\s+([A-Za-z_$][\w$]*)([^\n]*)", re.M
)
METHOD = re.compile(
    r"^[ \t]*(?:(?:public|protected|private|static|async|abstract|override|readonly|get|set)\s+)*([A-Za-z_$#][\w$]*)\s*(?:<[^>(]*>)?\(", re.M
)
NO_METHOD = frozenset("if for while switch catch return function constructor super new typeof await".split())


def _blanked(source: str) -> str:
    """source with comments and strings as spaces: same length, same lines."""

    def blank(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m[0])

    return re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", blank, source, flags=re.S)


def _block_end(code: str, at: int) -> int:
    """Behind the bracket that closes the one at `at`."""
    depth = 0
    for m in re.compile(r"[{}()\[\]]").finditer(code, at):
        depth += 1 if m[0] in "{([" else -1
        if not depth:
            return m.end()
    return len(code)


def _statement_end(code: str, at: int) -> int:
    """Behind the semicolon, or the line that ends a declaration outside brackets."""
    while at < len(code):
        if code[at] in "{([":
            at = _block_end(code, at)
        elif code[at] == ";":
            return at + 1
        elif code[at] == "\n" and not re.match(r"\s*[|&=?:.,>]", code[at:]) and not re.search(r"[=|&,:<>]\s*$", code[:at]):
            return at
        else:
            at += 1
    return at


def _doc(source: str, start: int) -> str | None:
    m = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*$", source[:start], re.S)
    return re.sub(r"^\s*\*? ?", "", m[1], flags=re.M).strip() if m else None


def ts_declarations(source: str) -> list[dict]:
    """kind, name, class_name, signature, doc, calls, line_start, line_end, content, in order, each place once; overloads without a body are left out."""
    code, out = _blanked(source), {}

    def add(kind: str, name: str, owner: str | None, start: int, end: int, signature: str) -> None:
        first = source.count("\n", 0, start) + 1
        row = {
            "kind": kind, "name": name, "class_name": owner, "signature": " ".join(signature.split()), "doc": _doc(source, start), "line_start": first, "line_end": first + source.count("\n", start, end),
            "calls": sorted(set(re.findall(r"\bthis\.([A-Za-z_$][\w$]*)\s*\(", code[start:end]))), "content": source[start:end].strip(),
        }
        out.setdefault((owner, name, kind, first), row)

    for m in EXPORT.finditer(code):
        kind, name = m[1].replace("*", ""), m[2]
        kind = "enum" if kind.endswith("enum") else kind
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if kind in ("interface", "class", "enum"):
            brace = code.find("{", m.end(2))
            if brace < 0:
                continue
            end = _block_end(code, brace)
            add(kind, name, None, start, end, source[start:brace])
            if kind == "class":
                at = brace + 1
                while found := METHOD.search(code, at, end):
                    close = _block_end(code, found.end() - 1)
                    body = re.compile(r"[^;{}=]*\{").match(code, close)
                    at = close
                    if found[1] not in NO_METHOD and body:
                        stop = _block_end(code, body.end() - 1)
                        begin = found.start() + len(found[0]) - len(found[0].lstrip())
                        add("method", found[1], name, begin, stop, source[begin : body.end() - 1])
                        at = stop
        elif kind == "function":
            close = _block_end(code, code.find("(", m.end(2)))
            body = re.compile(r"[^;\n{]*\{").match(code, close)
            if body:
                add(kind, name, None, start, _block_end(code, body.end() - 1), source[start : body.end() - 1])
        elif kind == "type" or re.match(r"\s*:", m[3]):
            end = _statement_end(code, m.end(2))
            add(kind, name, None, start, end, source[start:end].split("=")[0])
    return list(out.values())


def parse_ts(files: DataFrame, parser: Callable[[str], list[dict]] = ts_declarations) -> DataFrame:
    """Chunk rows of declarations of files (repo, path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                for x in parser(f.content or ""):
                    member = x["kind"] in ("method", "function")
                    owner = x["class_name"] or (None if member else x["name"])
                    text = "\n".join(s for s in (f"# {x['kind']} {x['name']} in {f.path}", x["doc"], x["content"]) if s)
                    rows.append((f.repo, f.path, owner, x["name"] if member else None, CHUNK_TYPE[x["kind"]], x["signature"], x["calls"], x["line_start"], x["line_end"], text))
            if rows:
                yield pd.DataFrame(rows, columns=["repo", "path", "class_name", "method_name", "chunk_type", "method_signature", "calls", "line_start", "line_end", "content"])

    shape = "repo string, path string, class_name string, method_name string, chunk_type string, method_signature string, calls array<string>, line_start int, line_end int, content string"
    out = files.select("repo", "path", "content").mapInPandas(run, shape)
    empty = F.lit("")
    key = hex_id(24, F.col("repo"), F.col("path"), F.coalesce("class_name", empty), F.coalesce("method_name", empty), F.col("chunk_type"), F.col("line_start"), sep=":")
    return out.withColumn("chunk_id", key).withColumn("content_type", F.lit("source")).withColumn("language", F.lit("typescript"))
