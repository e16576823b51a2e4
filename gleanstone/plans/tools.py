"""The eight tools: each validates its input, builds one plan, and returns hits and evidence as DataFrames.

A hub holds the chunk table and its text index: in blocks that were saved (Hub.of), or derived from the table at each call (TextIndex). The fused hits of both searches are kept as a
short table, over which adjustments and evidence are one lazily built plan; concepts of a query run together in one batched plan. Only the diversity pass leaves Catalyst, on lists of at most twice the limit.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.embedding import hashed_embedding, score_pairs
from ..functions.versions import compatible_only, with_compatibility
from ..operators import aggregates, deprecation, evidence, fusion, search, text_index, vector_index
from ..session import scratch
from ..sources.markdown import section_of

MOST = 50


@dataclass
class Answer:
    """hits (in order of rank), one row of evidence, and both as JSON."""

    hits: DataFrame
    evidence: DataFrame

    def to_json(self) -> str:
        hits = [json.loads(r[0]) for r in self.hits.orderBy("rank").select(F.to_json(F.struct("*"))).collect()]  # at most MOST rows
        said = self.evidence.select(F.to_json(F.struct("*"))).first()
        return json.dumps({"hits": hits, "evidence": json.loads(said[0]) if said else None})


def _limited(limit: int, most: int = MOST) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be within 1..{most}")
    return limit


def split_concepts(query: str, most: int = 5) -> list[str]:
    """The parts around ` + ` and ` & `, or the query itself."""
    import re

    parts = [p.strip() for p in re.split(r"\s+[+&]\s+", query) if p.strip()]
    return parts[:most] if len(parts) > 1 else [query]


@dataclass
class Hub:
    chunks: DataFrame
    index: search.TextIndex | text_index.BlockIndex | None
    deprecations: DataFrame | None = None
    metadata: DataFrame | None = None
    taxonomy: DataFrame | None = None
    embed: Callable[[str], list[float]] = hashed_embedding
    rescorer: Callable | None = None
    vectors: vector_index.CellIndex | None = None
    now: Column = field(default_factory=F.current_timestamp)

    @classmethod
    def of(cls, chunks: DataFrame, folder: str | None = None, stems: bool = True, embedded: DataFrame | None = None, **options) -> Hub:
        """A hub whose indexes are written once, below folder or a new folder of the session's. embedded: the chunks' vectors (chunk_id, embedding) where they are a table of their own, so that texts need not be joined to them."""
        spark, folder = chunks.sparkSession, folder or scratch(chunks.sparkSession, "hub")
        text_index.save_blocks(chunks, f"{folder}/text", stems)
        vector_index.save_cells(chunks if embedded is None else embedded.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), f"{folder}/vectors")
        return cls(chunks, text_index.load_blocks(spark, f"{folder}/text", stems), vectors=vector_index.load_cells(spark, f"{folder}/vectors"), **options)

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    def hybrid(self, query: str, filters: dict, limit: int, version: str | None = None) -> DataFrame:
        """The ranked chunks of a query: rank, score, match columns and all chunk columns; compat if a version is given."""
        if not query.strip():
            return self._empty(version)
        concepts = split_concepts(query)
        if len(concepts) > 1 and limit < len(concepts):
            concepts = [" ".join(concepts)]
        each = -(-limit // len(concepts))
        allowed = self.chunks.filter(search.matches(filters))
        shape = "query_id int, query string, vector array<float>"
        asked = self.spark.createDataFrame([(k, c, self.embed(c)) for k, c in enumerate(concepts)], shape)
        near = vector_index.nearest(self.vectors, asked, each, allowed if filters else None) if self.vectors else search.vector_search(allowed, asked, each)
        near = near.select("query_id", "chunk_id", "rank", F.lit(0).alias("list"))
        find = text_index.block_search if isinstance(self.index, text_index.BlockIndex) else search.text_search
        words = find(self.index, list(enumerate(concepts)), each, allowed).select("query_id", "chunk_id", "rank", F.lit(1).alias("list"))
        fused = self._kept(fusion.fuse(near.unionByName(words)).join(F.broadcast(asked.select("query_id", "query")), "query_id"))
        rows = self._kept(F.broadcast(fused).join(self.chunks, "chunk_id"))  # twice the limit for each concept at most, so texts are not shuffled
        penalty = None
        if version:
            rows = with_compatibility(rows, version)
            penalty = F.col("version_penalty")
        rows = fusion.adjust(rows, F.col("query"), self.now, penalty)
        if filters.get("content_type") == "source" and "chunk_type" not in filters:
            rows = fusion.prefer_types(rows)
        rows = fusion.diversify(rows)
        if self.rescorer:
            rows = fusion.rescored(score_pairs(rows, self.rescorer), scoring.sigmoid(F.col("ce_logit")))
        rows = rows.filter(F.col("rank") <= each)
        if len(concepts) > 1:
            rows = fusion.interleave(rows.withColumn("concept", F.col("query_id")).withColumn("query_id", F.lit(0)), limit).withColumn("rank", F.col("place")).drop("place", "concept")
        return rows.filter(F.col("rank") <= limit)

    def _kept(self, rows: DataFrame) -> DataFrame:
        """A short list of hits as a table, so that what follows does not search again."""
        path = scratch(self.spark, "hits")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _empty(self, version: str | None) -> DataFrame:
        rows = self.chunks.limit(0).select(F.lit(0).alias("query_id"), "*", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return rows.withColumn("compat", F.lit("")) if version else rows

    def _evidence(self, query: str, rows: DataFrame, filters: dict) -> DataFrame:
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        return evidence.assemble(asked, rows.withColumn("query_id", F.lit(0)), filters)

    def _versioned(self, query: str, filters: dict, limit: int, version: str | None, only: str | None) -> DataFrame:
        if only not in (None, "compatible_only"):
            raise ValueError("version_filter must be compatible_only")
        rows = self.hybrid(query, filters, min(limit * 3, MOST) if only else limit, version)
        if only and version:
            rows = compatible_only(rows)
        from pyspark.sql import Window

        again = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank"))  # at most MOST rows
        return rows.withColumn("rank", again).filter(F.col("rank") <= limit) if only else rows

    def search_docs(self, query: str, area: str | None = None, limit: int = 10) -> Answer:
        filters = {"content_type": "doc"}
        if area:
            filters["path"] = area if area.startswith("/") else f"/{area}"
        rows = self.hybrid(query, filters, _limited(limit))
        hits = rows.select(
            "rank", F.col("chunk_id").alias("doc_id"), F.coalesce("title", "path").alias("title"), "section", text.snippet(F.col("content"), 300).alias("snippet"), evidence.citation(F.col("section")).alias("citation"), "score"
        )
        return Answer(hits, self._evidence(query, rows, filters))

    def search_examples(self, query: str, limit: int = 10, version: str | None = None, version_filter: str | None = None, **filters) -> Answer:
        """filters: repo, language, domain, capability_tags, foundational_class, execution_mode."""
        wanted = {"content_type": "code", **{k: v for k, v in filters.items() if v}}
        rows = self._versioned(query, wanted, _limited(limit), version, version_filter)
        compat = F.col("compat") if version else F.lit(None).cast("string")
        hits = rows.select(
            "rank", F.col("chunk_id").alias("example_id"), text.snippet(F.col("content"), 200).alias("summary"), "foundational_class", "capability_tags", "key_files", F.coalesce("repo", F.lit("")).alias("repo"), "path",
            "commit_sha", "pipeline_version_pin", compat.alias("version_compatibility"), evidence.citation().alias("citation"), "score",
        )
        return Answer(hits, self._evidence(query, rows, wanted))

    def search_api(self, query: str, limit: int = 10, version: str | None = None, version_filter: str | None = None, **filters) -> Answer:
        """filters: module_path, class_name, chunk_type, is_dataclass, yields, calls."""
        wanted = {"content_type": "source", **{k: v for k, v in filters.items() if v is not None and v != ""}}
        rows = self._versioned(query, wanted, _limited(limit), version, version_filter)
        compat = F.col("compat") if version else F.lit(None).cast("string")
        none = F.array().cast("array<string>")
        hits = rows.select(
            "rank", "chunk_id", F.coalesce("module_path", F.lit("")).alias("module_path"), F.nullif("class_name", F.lit("")).alias("class_name"), F.nullif("method_name", F.lit("")).alias("method_name"),
            F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type"), text.snippet(F.col("content"), 500).alias("snippet"), F.nullif("method_signature", F.lit("")).alias("method_signature"),
            F.coalesce("is_dataclass", F.lit(False)).alias("is_dataclass"), *[F.coalesce(c, none).alias(c) for c in ("base_classes", "imports", "yields", "calls", "related_types")],
            "pipeline_version_pin", compat.alias("version_compatibility"), evidence.citation().alias("citation"), "score",
        )
        return Answer(hits, self._evidence(query, rows, wanted))

    def get_doc(self, doc_id: str | None = None, path: str | None = None, section: str | None = None) -> DataFrame:
        """One row: the document of an id, or all chunks of a path as one page; a placeholder if there is none."""
        if not (doc_id and doc_id.strip()) and path is None:
            raise ValueError("doc_id or path is needed")
        if doc_id and doc_id.strip():
            key, rows = doc_id, search.lookup(self.chunks, doc_id).withColumn("page", F.col("content")).withColumn("sections", F.array_compact(F.array("section")))
        else:
            key = path
            rows = search.filter_only(self.chunks.filter(F.col("path") == path), {"content_type": "doc"}, 200)  # of the page itself; no page has more
            whole = aggregates.reassembled(rows, "path").withColumnRenamed("content", "page")
            names = F.array_sort(F.collect_list(F.when(F.col("section").isNotNull(), F.struct("seq", "section"))))
            whole = whole.join(rows.groupBy("path").agg(F.transform(names, lambda s: s["section"]).alias("sections")), "path")  # 200 rows at most
            rows = rows.orderBy("seq").limit(1).join(F.broadcast(whole), "path")
        found = rows.select("chunk_id", F.coalesce("title", "path").alias("title"), "page", "source_url", "indexed_at", "sections")
        asked = self.spark.createDataFrame([(key,)], "key string")
        out = asked.join(F.broadcast(found), F.lit(True), "left")
        there = F.col("chunk_id").isNotNull()
        content = F.coalesce("page", F.lit(""))
        if section:
            part = F.udf(lambda page: section_of(page or "", section), "string")  # one row
            content = F.coalesce(part(content), content)
        return out.select(
            F.coalesce("chunk_id", "key").alias("doc_id"), F.coalesce("title", F.lit("Not Found")).alias("title"), content.alias("content"), F.coalesce("source_url", F.lit("")).alias("source_url"),
            F.coalesce("indexed_at", F.timestamp_seconds(F.lit(0))).alias("indexed_at"), F.coalesce("sections", F.array().cast("array<string>")).alias("sections"),
            evidence.single_item(there, F.col("key"), "document").alias("evidence"),
        )

    def get_example(self, example_id: str, include_readme: bool = True) -> DataFrame:
        """One row: an example's file, its taxonomy and readme; a placeholder if there is none."""
        found = search.lookup(self.chunks, example_id)
        asked = self.spark.createDataFrame([(example_id,)], "key string")
        out = asked.join(F.broadcast(found), F.lit(True), "left")
        there = F.col("chunk_id").isNotNull()
        readme = F.col("readme_content") if include_readme else F.lit(None).cast("string")
        return out.select(
            "key", F.when(there, F.array(F.struct("path", "content", "language"))).otherwise(F.array()).alias("files"), "repo", "commit_sha", "capability_tags", "foundational_class", "key_files",
            readme.alias("readme"), evidence.single_item(there, F.col("key"), "example").alias("evidence"),
        )

    def get_code_snippet(
        self, symbol: str | None = None, intent: str | None = None, path: str | None = None, line_start: int | None = None, line_end: int | None = None, module: str | None = None,
        class_name: str | None = None, content_type: str | None = None, max_lines: int = 100, version: str | None = None,
    ) -> Answer:
        """Exactly one of symbol, intent, or path with line_start. A symbol is looked for as a class, then a method, then a text; the first that finds anything counts."""
        if sum((symbol is not None, intent is not None, symbol is None and intent is None and path is not None and line_start is not None)) != 1:
            raise ValueError("give symbol, intent, or path and line_start")
        if not 1 <= max_lines <= 500:
            raise ValueError("max_lines must be within 1..500")
        base = {"content_type": content_type or ("source" if symbol else "code")}
        if path is not None:
            base["path"] = path
        query = symbol or intent or path
        steps: list[dict] = [{}]
        if symbol:
            base |= {k: v for k, v in (("module_path", module), ("class_name", class_name)) if v}
            steps = [*([] if class_name else [{"class_name": symbol}]), {"method_name": symbol}, {}]
        for more in steps:
            filters = base | more
            rows = self.hybrid(query, filters, 5, version)
            if len(steps) == 1 or not more or not rows.isEmpty():
                break
        n = F.size(text.lines(F.regexp_replace("content", r"\n$", "")))
        first = F.coalesce("line_start", F.lit(1))
        last = F.coalesce("line_end", first + n - 1)
        cut = rows.withColumn("_first", first).withColumn("_last", last).withColumn("_n", n)
        sliced = F.lit(False)
        begin, count = F.lit(1), F.col("_n")
        if line_start is not None and path is not None:
            stop = line_end or line_start + max_lines - 1
            cut = cut.filter((F.lit(stop) >= F.col("_first")) & (F.lit(line_start) <= F.col("_last")))
            begin = F.greatest(F.lit(1), F.lit(line_start) - F.col("_first") + 1)
            count = F.least(F.col("_n"), F.lit(stop) - F.col("_first") + 1) - begin + 1
            sliced = (count < F.col("_n")) & ((begin > 1) | F.lit(line_end is not None))
        shown = F.least(count, F.lit(max_lines))
        bare = sliced | (F.coalesce("chunk_type", F.lit("")) == "module_overview")
        none = F.array().cast("array<string>")
        lists = {c: F.when(bare, none).otherwise(F.coalesce(c, none)) for c in ("imports", "calls", "related_types", "yields", "base_classes")}
        hits = cut.select(
            "rank", text.line_slice(F.col("content"), begin, shown).alias("content"), "path", (F.col("_first") + begin - 1).alias("line_start"), (F.col("_first") + begin + shown - 2).alias("line_end"), "language",
            "pipeline_version_pin", evidence.citation().alias("citation"), lists["imports"].alias("dependency_notes"), text.qualified_calls(F.col("class_name"), lists["calls"]).alias("companion_snippets"),
            lists["related_types"].alias("related_type_defs"), text.expectations(lists["yields"], lists["base_classes"]).alias("interface_expectations"),
        )
        return Answer(hits, self._evidence(query, rows, filters))

    def check_deprecation(self, *symbols: str) -> DataFrame:
        asked = self.spark.createDataFrame([(s,) for s in symbols], "symbol string")
        if self.deprecations is None:
            return asked.withColumn("deprecated", F.lit(False)).withColumn("note", F.lit("No deprecation map is loaded."))
        return deprecation.check(self.deprecations, asked)

    def get_hub_status(self) -> DataFrame:
        """name, value: counts, commits, metadata and whether a second scorer is on."""
        out = aggregates.index_stats(self.chunks).select("name", F.col("value").cast("string").alias("value"))
        out = out.unionByName(aggregates.counts_by_repo(self.chunks).select(F.concat(F.lit("repo:"), "repo").alias("name"), F.col("n").cast("string").alias("value")))
        if self.metadata is not None:
            out = out.unionByName(self.metadata.select(F.concat(F.lit("meta:"), "key").alias("name"), "value"))
        return out.unionByName(self.spark.createDataFrame([("reranker", "on" if self.rescorer else "off")], "name string, value string"))
