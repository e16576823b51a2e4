"""Token counts by offset-mapped attribution.

A document is laid out as one text, its fields in order with a separator between them; it is encoded once. Tokens become spans of characters (a token that
holds only bytes inside a character gets the span of that character), sections are spans too, and an interval join
of the two sorted lists attributes each token to a section. A token whose span crosses a boundary goes, by `rule`:

* `start`: to the section that holds its first character;
* `most`: to the section that holds most of its characters, the first of them in a tie.

A separator belongs to the section before it. Tokens of no section do not exist: sections cover the text. The counts of a
document's sections add up to its number of tokens.

Defined results: very long texts and runs of white space are encoded whole; null fields have no section, empty fields have one without characters and without tokens; a document without any text has no rows; repeated rows
get rows each; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import given_id, held_id, kept_in_worker, small_batches

RULES = ("start", "most")
SEPARATOR = "\n"


def encoder(path: str, pattern: str) -> tuple:
    """A tiktoken encoding and the byte length of each token; one for a worker process."""

    def made() -> tuple:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(t) for t in ranks]
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size

    return kept_in_worker(("token-spans", path, pattern), made)


#: Runs of white space that the library's pattern matcher would walk through again from each of their characters; they are cut out, so that it is linear in a text.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{200,}")


def token_ids(text: str, path: str, pattern: str) -> np.ndarray:
    """The ids of a whole text. A long run of white space is a match of the pattern by itself, but for its last character if more text follows (as `\\s+(?!\\S)` has it)."""
    own, _ = encoder(path, pattern)
    out, at = [], 0
    for run in LONG_RUN.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += [own.encode_to_numpy(text[at : run.start()], disallowed_special=()), np.array(own._encode_single_piece(text[run.start() : stop]), np.uint32)]
        at = stop
    return np.concatenate([*out, own.encode_to_numpy(text[at:], disallowed_special=())]).astype(np.int64)


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each token, and the one behind its last."""
    _, size = encoder(path, pattern)
    ids = token_ids(text, path, pattern)
    stop = np.cumsum(size[ids])
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return (char[stop - size[ids]], char[stop - 1] + 1) if len(ids) else (stop, stop)


def attributed(first: np.ndarray, stop: np.ndarray, starts: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each section, its tokens, and those of them that reach into other sections. starts: sorted first characters, starts[0] = 0."""
    ends = np.append(starts[1:], length)
    low = np.searchsorted(starts, first, "right") - 1
    high = np.searchsorted(starts, stop - 1, "right") - 1
    owner = low.copy()
    if rule == "most":
        for t in np.flatnonzero(high > low).tolist():
            part = np.minimum(ends[low[t] : high[t] + 1], stop[t]) - np.maximum(starts[low[t] : high[t] + 1], first[t])
            owner[t] = low[t] + int(part.argmax())
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[high > low], minlength=n)


def _sections(fields: list[tuple[str, str]], by_line: bool) -> tuple[str, list[tuple[str, int, int]]]:
    """The layout, and (name, number, first character) of its sections."""
    text, at, out = [], 0, []
    for k, (name, value) in enumerate(fields):
        value = value if k == len(fields) - 1 else value + SEPARATOR
        lines = value.split("\n") if by_line else [value]
        for j, line in enumerate(lines):
            line += "\n" * (by_line and j < len(lines) - 1)
            if by_line and j and not line:
                continue
            out.append((name, j, at))
            at += len(line)
        text.append(value)
    return "".join(text), out


def count_tokens(
    rows: DataFrame, fields: list[str], path: str, pattern: str, id_col: str = "doc_id", rule: str = "start", by_line: bool = False
) -> DataFrame:
    """id, field, section, start, length, n_tokens, n_crossing: a row for each section of each row of rows.

    by_line makes each line of a field a section, numbered within the field; else a field is one section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("id", "field", "section", "start", "length", "n_tokens", "n_crossing")}
            for row in batch.itertuples(index=False):
                there = [(f, v) for f, v in zip(fields, row[1:]) if v is not None]
                text, sections = _sections(there, by_line)
                if not sections:
                    continue
                starts = np.array([s for _, _, s in sections])
                first, stop = token_spans(text, path, pattern)
                tokens, crossing = attributed(first, stop, starts, len(text), rule)
                out["id"] += [row[0]] * len(sections)
                out["field"] += [s[0] for s in sections]
                out["section"] += [s[1] for s in sections]
                out["start"] += starts.tolist()
                out["length"] += np.diff(np.append(starts, len(text))).tolist()
                out["n_tokens"] += tokens.tolist()
                out["n_crossing"] += crossing.tolist()
            if out["id"]:
                yield pd.DataFrame(out)

    kind = dict(rows.dtypes)[id_col]
    whole = kind in ("bigint", "int")
    slim = rows.select((held_id(id_col) if whole else F.col(id_col)).alias("_id"), *[F.col(f).cast("string").alias(f"_f{k}") for k, f in enumerate(fields)])
    found = slim.mapInPandas(run, f"id {'long' if whole else kind}, field string, section int, start long, length long, n_tokens long, n_crossing long")
    return found.withColumn("id", given_id("id").cast(kind)) if whole else found


def document_token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, field, section, start, length, n_tokens, n_crossing for every section of every document, laid out as source, language and the lines of the text."""
    counts = count_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text"), ["source", "lang", "text"], path, pattern, rule="most", by_line=True)
    return counts.withColumnRenamed("id", "doc_id")
