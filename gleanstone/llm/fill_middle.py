"""Fill-in-middle: texts cut at two unit boundaries and put together in another order, by overlapping chunks.

A unit is a word with the white space before it; white space at the end of a text is a unit of its own. A unit ends behind a byte that is not white where the next
one is, so two adjacent bytes decide. Texts are dealt to chunks; each looks one byte into the next, so the ends in a chunk are counted
without its neighbours, all chunks of a block of texts at once. Sums over the chunks say which chunk holds the unit end of a wanted rank, and only that chunk is read again.
White space is one byte of UTF-8 and never part of a longer character, so texts are read as bytes; characters are counted the same way.

Where a text is cut, and its form, come from the SHA-256 of the seed and the row's id, not from the order of rows or the task.

Defined results: a null text is an empty one and plain; a null id is written as nothing behind the seed; equal rows get equal results; a text with a marker stays plain, so each output
can be taken apart again; an empty table gives an empty result; other columns pass through fill_in_middle unless they bear a new column's name, which the new one takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import small_batches, text_blocks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a chunk.
CHUNK = 1 << 14
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NEW = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}


def _ends(data: np.ndarray) -> np.ndarray:
    """Whether a unit ends behind each byte but the last, which belongs to the next chunk."""
    white = WHITE[data]
    return ~white[:-1] & white[1:]


def _starts(data: np.ndarray) -> np.ndarray:
    """Whether a character starts at each byte."""
    return (data & 0xC0) != 0x80


class UnitCounts:
    """The units of some texts: n of each, and where the first units of one end."""

    def __init__(self, texts: list[bytes], chunk: int = CHUNK):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)  # white space behind each text ends its last word
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        chunks = np.maximum(1, -(-self.size // chunk))
        self.last = np.cumsum(chunks) - 1
        self.first = self.last - chunks + 1
        within = np.arange(int(chunks.sum())) - np.repeat(self.first, chunks)
        self.edges = np.append(np.repeat(self.begin, chunks) + within * chunk, len(self.data))
        self.ends = self._before(np.append(_ends(self.data), False))
        self.chars = self._before(_starts(self.data))
        white_end = (self.size > 0) & WHITE[self.data[self.begin + self.size - 1]]
        self.n = self.ends[self.last + 1] - self.ends[self.first] + white_end

    def _before(self, there: np.ndarray) -> np.ndarray:
        """How many are there before each chunk, and in all."""
        return np.append(0, np.cumsum(np.add.reduceat(there, self.edges[:-1], dtype=np.int64)))

    def cut(self, k: int, rank: int) -> tuple[int, int]:
        """Bytes and characters of the first `rank` units of text k."""
        if rank == 0:
            return 0, 0
        if rank == self.n[k]:  # also where white space at the end is the last unit
            chunk = self.last[k]
            stop = self.begin[k] + self.size[k]
        else:
            wanted = self.ends[self.first[k]] + rank
            chunk = np.searchsorted(self.ends, wanted) - 1
            ends = np.flatnonzero(_ends(self.data[self.edges[chunk] : self.edges[chunk + 1] + 1]))
            stop = self.edges[chunk] + ends[wanted - self.ends[chunk] - 1] + 1
        chars = self.chars[chunk] - self.chars[self.first[k]] + np.count_nonzero(_starts(self.data[self.edges[chunk] : stop]))
        return int(stop - self.begin[k]), int(chars)


def draws(seed: int, key: object) -> list[int]:
    """Four numbers below 2**32 for a row."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _transformed(text: bytes, k: int, counts: UnitCounts, draw: list[int], rate: int, spm: int) -> tuple:
    """n, form, characters of prefix and middle, and the output of a text."""
    n = int(counts.n[k])
    if not text or draw[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    (a, a_chars), (b, b_chars) = (counts.cut(k, r) for r in sorted((draw[0] % (n + 1), draw[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draw[3] % 100 < spm:
        return n, "spm", a_chars, b_chars - a_chars, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a_chars, b_chars - a_chars, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output. rate: how many texts of a hundred are transformed; spm: how many of those put the suffix first."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in NEW]
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("output"), F.col(key).cast("string").alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(len(kept)).to_pylist(), iter(batch.column(len(kept) + 1).to_pylist())
            made: list[tuple] = []
            for block in text_blocks(texts):
                counts = UnitCounts(block)
                made += [_transformed(t, k, counts, draws(seed, next(keys)), rate, spm) for k, t in enumerate(block)]
            new = [pa.array(list(v), kind) for v, kind in zip(zip(*made), NEW.values())] if made else [pa.array([], kind) for kind in NEW.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*kept, *NEW])

    out = T.StructType([*docs.select(*kept).schema, *T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output binary")])
    return rows.mapInArrow(run, out).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; markers are only where they were put."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def middle_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of each output and of the text that is taken from it again."""
    rows = fill_in_middle(docs.select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def middle_sql() -> str:
    """The same in DuckDB SQL."""
    return r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u, sha256('42:' || doc_id) AS d FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
