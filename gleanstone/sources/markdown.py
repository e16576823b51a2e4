"""Documentation text: pages, sections and chunks.

Pages come apart by DataFrame operations on numbered lines. Cleaning, sections and packing walk a page's text in
order and are row-local Pandas functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hex_id, url_path

#: Tags that become block quotes, and tags that go while their content stays.
ADMONITIONS = ("Note", "Warning", "Tip", "Info")
STRUCTURE = (
    "ParamField", "Card", "CardGroup", "Steps", "Step", "Tabs", "Tab", "Accordion", "AccordionGroup", "CodeGroup", "Frame", "Expandable", "ResponseField", "Icon",
)
MAX_DUMP_BYTES = 20 * 1024 * 1024
CHARS_PER_TOKEN = 4


def read_dump(spark, path: str) -> DataFrame:
    """(value): the whole text of each documentation dump. One of more than MAX_DUMP_BYTES fails the read, as a part of it would look whole."""
    fits = F.octet_length("value") <= MAX_DUMP_BYTES
    return spark.read.text(path, wholetext=True).select(F.when(fits, F.col("value")).otherwise(F.raise_error(F.lit(f"a dump has more than {MAX_DUMP_BYTES} bytes")).cast("string")).alias("value"))


def split_pages(dumps: DataFrame, key: str, text: str = "value") -> DataFrame:
    """key, page, title, source_url, body: a page starts at a line `# ...` right before a line `Source: ...`; what precedes the first is dropped."""
    line = dumps.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")
    marked = line.withColumn("next", F.lead("line").over(order)).withColumn(
        "starts", (F.col("line").startswith("# ") & F.coalesce(F.col("next").startswith("Source: "), F.lit(False))).cast("int")
    )
    paged = marked.withColumn("page", F.sum("starts").over(order)).filter("page > 0")
    at = F.row_number().over(Window.partitionBy(key, "page").orderBy("pos"))
    parts = paged.withColumn("at", at).groupBy(key, "page").agg(
        F.max(F.when(F.col("at") == 1, F.trim(F.substring("line", 3, 2**30)))).alias("title"),
        F.max(F.when(F.col("at") == 2, F.trim(F.substring("line", 9, 2**30)))).alias("source_url"),
        F.sort_array(F.collect_list(F.when(F.col("at") > 2, F.struct("pos", "line")))).alias("rest"),
    )
    body = F.array_join(F.transform("rest", lambda r: r["line"]), "\n")
    return parts.select(key, "page", "title", "source_url", F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def clean_tags(text: str) -> str:
    """Admonitions as quotes with a bold label; structural tags removed; no more than one empty line."""
    for tag in ADMONITIONS:

        def quoted(m: re.Match, tag: str = tag) -> str:
            first, *rest = m[1].strip().split("\n")
            return "\n".join([f"> **{tag}:** {first}", *(f"> {r}" if r.strip() else ">" for r in rest)])

        text = re.sub(rf"<{tag}(?:\s[^>]*)?>(.+?)</{tag}>", quoted, text, flags=re.S)
    text = re.sub(rf"<(?:{'|'.join(STRUCTURE)})(?:\s[^>]*)?\s*/?>|</(?:{'|'.join((*STRUCTURE, *ADMONITIONS))})>", "", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def fences(text: str) -> list[tuple[int, int]]:
    """Spans of closed code fences; an open one uses up the marks that follow it."""
    out, opened = [], None
    for m in re.finditer(r"^(`{3,}|~{3,})", text, re.M):
        if opened is None:
            opened = m
        elif m[1][0] == opened[1][0] and len(m[1]) >= len(opened[1]):
            out.append((opened.start(), m.end()))
            opened = None
    return out


def sections(text: str) -> list[tuple[str, str]]:
    """(heading, body): headings of any level outside fences; a body before the first has an empty heading."""
    closed = fences(text)
    heads = [m for m in re.finditer(r"^#{1,6}\s+(.+)$", text, re.M) if not any(a <= m.start() < b for a, b in closed)]
    edges = [(0, 0, ""), *((m.start(), m.end(), m[1].strip()) for m in heads), (len(text), len(text), "")]
    found = [(name, text[begin:stop].strip()) for (_, begin, name), (stop, _, _) in pairwise(edges)]
    return [(name, body) for name, body in found if name or body]


def pack_paragraphs(text: str, budget: int, overlap: int) -> list[str]:
    """Paragraphs packed to budget characters; a new chunk begins with the last whole paragraphs that fit into overlap."""
    if len(text) // CHARS_PER_TOKEN <= budget // CHARS_PER_TOKEN:
        return [text] if text.strip() else []
    out: list[str] = []
    held: list[str] = []
    size = 0
    for p in re.split(r"\n\n+", text):
        if held and size + len(p) + 2 > budget:
            out.append("\n\n".join(held))
            room, keep = overlap, len(held)
            while keep and len(held[keep - 1]) + 2 <= room:
                keep -= 1
                room -= len(held[keep]) + 2
            held = held[keep:]
            size = sum(map(len, held)) + 2 * len(held)
            held.append(p)
            size += len(p)
        else:
            size += len(p) + 2 * (size > 0)
            held.append(p)
    last = "\n\n".join(held)
    return [*out, last] if last.strip() else out


def chunk_page(text: str, max_tokens: int = 512, overlap_tokens: int = 50) -> list[tuple[str, str]]:
    """(section, content) of each chunk of a page, in order."""
    out = []
    for name, body in sections(text):
        whole = "\n\n".join(x for x in (f"## {name}" if name else "", body) if x)
        out += [(name, c) for c in pack_paragraphs(whole, max_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN)]
    return out


def chunk_pages(pages: DataFrame, url: str = "source_url", body: str = "body", max_tokens: int = 512, overlap_tokens: int = 50, clean: bool = True) -> DataFrame:
    """Chunk rows of pages: chunk_id, content, content_type, source_url, path, section, chunk_index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (link, k, name, content)
                for link, text in zip(batch["source_url"], batch["body"])
                for k, (name, content) in enumerate(chunk_page(clean_tags(text or "") if clean else text or "", max_tokens, overlap_tokens))
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["source_url", "chunk_index", "section", "content"])

    cut = pages.select(F.col(url).alias("source_url"), F.col(body).alias("body")).mapInPandas(run, "source_url string, chunk_index int, section string, content string")
    return cut.select(
        hex_id(16, F.col("source_url"), F.lit("chunk"), F.col("chunk_index")).alias("chunk_id"),
        "content",
        F.lit("doc").alias("content_type"),
        "source_url",
        url_path(F.col("source_url")).alias("path"),
        "section",
        "chunk_index",
    )


def section_of(text: str, name: str) -> str | None:
    """The part of a markdown text under the heading `name` (any case), up to the next heading of its level or above; fences are not regarded."""
    level, begin = 0, None
    rows = text.splitlines()
    for i, row in enumerate(rows):
        depth = len(row) - len(row.lstrip("#"))
        if not depth:
            continue
        if row[depth:].strip().lower() == name.lower():
            level, begin = depth, i
        elif begin is not None and depth <= level:
            return "\n".join(rows[begin:i])
    return None if begin is None else "\n".join(rows[begin:])
