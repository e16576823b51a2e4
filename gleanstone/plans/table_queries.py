"""Operators applied to whole standard tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import aggregates, deprecation, evidence, fusion, search, store, substring_index, taxonomy, text_index, vector_index
from ..schema import conform
from ..session import scratch
from ..sources import code, history, markdown
from . import dashboard, refresh, tools

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Documents as chunks, in SQL; chunks() below is the same.
CHUNKS = """c AS (SELECT 'd' || doc_id AS chunk_id, doc_id AS seq, text AS content, n_chars,
  CASE lang WHEN 'en' THEN 'doc' WHEN 'fr' THEN 'code' ELSE 'source' END AS content_type,
  CASE WHEN source = 'src0' THEN NULL ELSE source END AS repo, '/' || source || '/' || lang AS path, lang AS language,
  substr(sha256(source), 1, 12) AS commit_sha, [lang, source] AS capability_tags FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"), "n_chars",
        F.when(F.col("lang") == "en", "doc").when(F.col("lang") == "fr", "code").otherwise("source").alias("content_type"),
        F.when(F.col("source") != "src0", F.col("source")).alias("repo"), F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("path"), F.col("lang").alias("language"),
        F.substring(F.sha2("source", 256), 1, 12).alias("commit_sha"), F.array("lang", "source").alias("capability_tags"),
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("flt_equality", f"WITH {CHUNKS} SELECT chunk_id, repo FROM c WHERE content_type = 'source' AND language = 'es'")
def _(spark, d):
    return chunks(spark, d).filter(search.matches({"content_type": "source", "language": "es"})).select("chunk_id", "repo")


@query("flt_path_prefix", f"WITH {CHUNKS} SELECT chunk_id, path FROM c WHERE starts_with(path, '/src1')")
def _(spark, d):
    return chunks(spark, d).filter(search.matches({"path": "/src1"})).select("chunk_id", "path")


@query("flt_tags_all_of", f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE list_has_all(capability_tags, ['de', 'src3'])")
def _(spark, d):
    return chunks(spark, d).filter(search.matches({"capability_tags": ["de", "src3"]})).select("chunk_id")


@query("flt_membership", "SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'that')")
def _(spark, d):
    rows = table(spark, d, "documents").withColumn("calls", F.split("text", " "))
    return rows.filter(search.matches({"calls": "that"})).select("doc_id")


@query("flt_free_text", f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE contains(lower(concat_ws(chr(1), chunk_id, content, repo, path, language)), 'src1/de')")
def _(spark, d):
    return search.free_text(chunks(spark, d), "SRC1/de ").select("chunk_id")


@query("flt_free_text_kinds", f"WITH {CHUNKS} SELECT chunk_id, content_type FROM c WHERE content_type IN ('doc', 'source') AND (contains(lower(content), 'that is') OR contains(lower(chunk_id), 'that is'))")
def _(spark, d):
    return search.free_text(chunks(spark, d), "That Is", ["doc", "source"]).select("chunk_id", "content_type")


@query("flt_substring_index", f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE contains(lower(content), 'e that i') OR contains(lower(chunk_id), 'e that i') OR contains(lower(coalesce(repo, '')), 'e that i')")
def _(spark, d):
    folder = scratch(spark, "substrings")
    substring_index.save_substrings(chunks(spark, d), folder)
    return substring_index.find_text(substring_index.load_substrings(spark, folder), "E That I").select("chunk_id")


@query("flt_name_prefixes", f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE starts_with(coalesce(repo, ''), 'src1') AND starts_with(coalesce(repo, '') || '.' || language, 'src1') AND language <> 'en'")
def _(spark, d):
    rows = chunks(spark, d).withColumn("class_name", F.col("repo")).withColumn("module_path", F.concat_ws(".", F.coalesce("repo", F.lit("")), "language"))
    return rows.filter(search.matches({"class_name": "src1", "module_path": "src1"})).filter("language <> 'en'").select("chunk_id")


@query("agg_type_counts", f"WITH {CHUNKS} SELECT content_type, count(*) AS n FROM c GROUP BY ALL")
def _(spark, d):
    return dashboard.statistics(chunks(spark, d).withColumn("chunk_type", F.lit(None).cast("string")))["content_types"]


@query(
    "prj_preview",
    r"""SELECT doc_id, regexp_replace(substr(text, 1, 200), '[\r\n]+', ' ', 'g') AS preview,
    CASE n_chars % 6 WHEN 0 THEN 'class_overview' WHEN 1 THEN 'module_overview' WHEN 2 THEN 'method' WHEN 3 THEN 'function' WHEN 4 THEN 'type_definition' WHEN 5 THEN CASE WHEN lang = 'en' THEN 'given' END END AS kind FROM documents""".replace("\\\\", "\\"),
)
def _(spark, d):
    heads = F.array(*[F.lit(h) for h in ("# class A", "# Module: m", "# A.run in m", "# run in m", "# Type: T", "text")])
    content = F.concat_ws("\n", F.get(heads, (F.col("n_chars") % 6).cast("int")), "text")
    given = F.when((F.col("n_chars") % 6 == 5) & (F.col("lang") == "en"), "given").when(F.col("lang") == "fr", "")
    return table(spark, d, "documents").select("doc_id", dashboard.preview(F.col("text")).alias("preview"), dashboard.inferred_type(content, given).alias("kind"))


@query("flt_filter_only_order", f"WITH {CHUNKS} SELECT chunk_id, seq, 1.0::DOUBLE AS score FROM c WHERE content_type = 'code' ORDER BY seq LIMIT 100")
def _(spark, d):
    return search.filter_only(chunks(spark, d), {"content_type": "code"}, 100).select("chunk_id", "seq", "score")


@query("flt_exact_lookup", f"WITH {CHUNKS} SELECT chunk_id, content, 1.0::DOUBLE AS score FROM c WHERE chunk_id = 'd7'")
def _(spark, d):
    return search.lookup(chunks(spark, d), "d7").select("chunk_id", "content", "score")


@query(
    "flt_line_overlap",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
    SELECT doc_id, least(len(ls), 4)::BIGINT AS line_end, array_to_string(ls[2:4], chr(10)) AS part FROM l WHERE len(ls) >= 2""",
)
def _(spark, d):
    rows = table(spark, d, "documents").withColumn("n", F.size(text.lines(F.col("text"))))
    return rows.filter("n >= 2").select("doc_id", F.least("n", F.lit(4)).cast("long").alias("line_end"), text.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("part"))


@query(
    "prj_hits",
    f"""WITH {CHUNKS} SELECT chunk_id, coalesce(repo, path) AS title, substr(content, 1, 300) AS snippet, substr(content, 1, 200) AS summary,
    substr(content, 1, 500) AS api_snippet, nullif(language, 'en') AS class_name FROM c""",
)
def _(spark, d):
    c = F.col("content")
    return chunks(spark, d).select(
        "chunk_id", F.coalesce("repo", "path").alias("title"), text.snippet(c, 300).alias("snippet"), text.snippet(c, 200).alias("summary"), text.snippet(c, 500).alias("api_snippet"),
        F.nullif(F.col("language"), F.lit("en")).alias("class_name"),
    )


@query("prj_statements", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS statement FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.statement(F.col("text")).alias("statement"))


@query(
    "prj_qualified_calls",
    """SELECT p_partkey, array_to_string([CASE WHEN contains(x, '.') OR starts_with(x, 'super()') THEN x ELSE p_brand || '.' || x END
    FOR x IN [p_name, p_type || '.run', 'super().' || p_name]], '|') AS calls,
    array_to_string(['Yields: ' || p_name, 'Implements: ' || p_type || ', ' || p_brand], '|') AS expected FROM part""",
)
def _(spark, d):
    calls = F.array("p_name", F.concat("p_type", F.lit(".run")), F.concat(F.lit("super()."), "p_name"))
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(text.qualified_calls(F.col("p_brand"), calls), "|").alias("calls"),
        F.array_join(text.expectations(F.array("p_name"), F.array("p_type", "p_brand")), "|").alias("expected"),
    )


@query(
    "str_scalars",
    """SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens, substr(sha256(source || '|' || lang || '|' || doc_id), 1, 24) AS id, sha256(text) AS hash,
    regexp_replace(source || '/' || lang || '.x', '[^a-zA-Z0-9_-]', '_', 'g') AS slug,
    'https://github.com/' || source || '/blob/' || lang || '/' || source || '#L' || 3 || '-L' || n_chars AS link FROM documents""",
)
def _(spark, d):
    s, g = F.col("source"), F.col("lang")
    return table(spark, d, "documents").select(
        "doc_id", text.estimated_tokens(F.col("text")).alias("tokens"), text.hex_id(24, s, g, F.col("doc_id")).alias("id"), F.sha2("text", 256).alias("hash"),
        text.slug(F.concat(s, F.lit("/"), g, F.lit(".x"))).alias("slug"), text.source_link(s, g, s, F.lit(3), F.col("n_chars")).alias("link"),
    )


@query(
    "str_concepts",
    """WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, ' the ', ' + '), '\\s+[+&]\\s+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS a FROM documents)
    SELECT doc_id, CASE WHEN len(a) > 1 THEN array_to_string(a[1:5], '|') ELSE '' END AS concepts FROM p""",
)
def _(spark, d):
    q = F.replace(F.col("text"), F.lit(" the "), F.lit(" + "))
    return table(spark, d, "documents").select("doc_id", F.array_join(text.concepts(q), "|").alias("concepts"))


@query(
    "str_symbols",
    """WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]*'), lambda x: regexp_matches(x, '[a-z][A-Z]') OR contains(x, '_') OR contains(x, '.')
    OR (length(x) >= 2 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS s FROM documents) SELECT doc_id, array_to_string(s, ' ') AS symbols FROM t""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.query_symbols(F.col("text")), " ").alias("symbols"))


@query("str_words", r"SELECT doc_id, array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), ' ') AS words FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.words(F.col("text")), " ").alias("words"))


@query(
    "str_bracket_modules",
    """SELECT p_partkey, 'x.' || replace(p_brand, ' ', '') || '.y, ' || 'x.' || replace(p_type, ' ', '') || '.y' AS modules, 'pkg.' || replace(p_brand, ' ', '') AS module FROM part""",
)
def _(spark, d):
    a, b = F.regexp_replace("p_brand", " ", ""), F.regexp_replace("p_type", " ", "")
    made = F.concat(F.lit("x.["), a, F.lit(","), b, F.lit("].y"))
    path = F.concat(F.lit("src/pkg/"), a, F.lit("/__init__.py"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.bracket_modules(made), ", ").alias("modules"), text.module_path(path).alias("module"))


@query("jsn_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


FUSED = """v AS (SELECT chunk_id, row_number() OVER (ORDER BY n_chars DESC, chunk_id) AS r FROM c WHERE content_type <> 'code'),
  k AS (SELECT chunk_id, row_number() OVER (ORDER BY content, chunk_id) AS r FROM c WHERE content_type <> 'doc'),
  u AS (SELECT chunk_id, 0 AS l, r FROM v UNION ALL SELECT chunk_id, 1, r FROM k),
  f AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + r) / (2.0::DOUBLE / 61)) AS rrf, count(*) AS n_lists FROM u GROUP BY chunk_id)"""


def _fused(spark, d):
    c = chunks(spark, d)
    v = _ranks(c.filter("content_type <> 'code'"), -F.col("n_chars")).withColumn("list", F.lit(0))
    k = _ranks(c.filter("content_type <> 'doc'"), F.col("content")).withColumn("list", F.lit(1))
    return fusion.fuse(v.unionByName(k).withColumn("query_id", F.lit(1)))


def _ranks(rows: DataFrame, by: Column) -> DataFrame:
    """chunk_id, rank of all rows in one list, nulls last: numbered in ranges, so that no task ranks the whole table."""
    rows = rows.select("chunk_id", by.isNull().alias("_none"), by.alias("_by"))
    return store.numbered(rows, ["_none", "_by"], "chunk_id", 1, "rank").select("chunk_id", F.col("rank").cast("int").alias("rank"))


@query("join_rrf_fusion", f"WITH {CHUNKS}, {FUSED} SELECT chunk_id, round(rrf, 9) AS rrf, n_lists FROM f")
def _(spark, d):
    return _fused(spark, d).select("chunk_id", F.round("rrf", 9).alias("rrf"), "n_lists")


@query(
    "mth_adjusted_scores",
    f"""WITH {CHUNKS}, {FUSED} SELECT f.chunk_id, round(greatest(0, least(1, rrf + CASE WHEN contains(lower(content), 'that_is') OR contains(lower(content), 'haea') THEN 0.15 ELSE 0 END
    + CASE WHEN n_lists > 1 THEN 0.1 ELSE 0 END - least(0.1, CASE WHEN n_chars // 24 > 0 THEN least(0.1, (n_chars // 24) / 365.0::DOUBLE * 0.1) ELSE 0 END + 0.05))), 9) AS score
    FROM f JOIN c USING (chunk_id)""",
)
def _(spark, d):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    age = chunks(spark, d).select("chunk_id", "content", F.timestamp_seconds(F.unix_timestamp(now) - F.col("n_chars") * 3600).alias("indexed_at"))
    rows = _fused(spark, d).join(age, "chunk_id")
    return fusion.adjust(rows, F.lit("THAT_IS haEa"), now, F.lit(scoring.VERSION_PENALTY)).select("chunk_id", F.round("score", 9).alias("score"))


@query(
    "win_interleave",
    """WITH r AS (SELECT lang AS query_id, source AS concept, md5(text) AS chunk_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, concept) = 1)
    SELECT query_id, concept, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, concept) AS place FROM k QUALIFY place <= 50""",
)
def _(spark, d):
    w = Window.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id")
    rows = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("concept"), F.md5("text").alias("chunk_id"), F.row_number().over(w).alias("rank"))
    return fusion.interleave(rows, 50).select("query_id", "concept", "chunk_id", "place")


#: The greedy order of diversify(), for items i (query_id, chunk_id, repo, path, score, src_order): `ranked`.
GREEDY = """o AS (SELECT query_id, list(struct_pack(id := chunk_id, r := coalesce(repo, ''), p := coalesce(path, '')) ORDER BY score DESC, src_order) AS rest FROM i GROUP BY query_id),
  g AS (SELECT query_id, rest, rest[1:0] AS done FROM o UNION ALL SELECT query_id, list_filter(rest, lambda x: x.id <> pick.id), list_append(done, pick) FROM (
    SELECT *, coalesce(list_filter(rest, lambda x: NOT (len(done) >= 3 AND ((done[-1].r = x.r AND done[-2].r = x.r AND done[-3].r = x.r) OR (done[-1].p = x.p AND done[-2].p = x.p AND done[-3].p = x.p))))[1], rest[1]) AS pick
    FROM g WHERE len(rest) > 0)),
  ranked AS (SELECT query_id, unnest(list_transform(done, lambda x: x.id)) AS chunk_id, generate_subscripts(done, 1) AS rank FROM g WHERE len(rest) = 0)"""


@query(
    "win_diversity",
    f"""WITH RECURSIVE {CHUNKS}, n AS (SELECT content_type AS query_id, chunk_id, repo, path, row_number() OVER (PARTITION BY content_type ORDER BY n_chars DESC, seq) AS src_order FROM c QUALIFY src_order <= 100),
    i AS (SELECT query_id, chunk_id, repo, path, 1.0::DOUBLE / src_order AS score, src_order FROM n), {GREEDY}
    SELECT query_id, chunk_id, repo, path, score, src_order, rank FROM i JOIN ranked USING (query_id, chunk_id)""",
)
def _(spark, d):
    w = Window.partitionBy("content_type").orderBy(F.desc("n_chars"), "seq")
    rows = chunks(spark, d).withColumn("src_order", F.row_number().over(w)).filter("src_order <= 100")  # what two searches return at most
    return fusion.diversify(rows.select(F.col("content_type").alias("query_id"), "chunk_id", "repo", "path", (F.lit(1.0) / F.col("src_order")).alias("score"), "src_order"))


@query(
    "win_line_ranges",
    """SELECT conv_id, turn, sum(len(string_split(text, chr(10)))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS line_end FROM conversations""",
)
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.size(text.lines(F.col("text")))).over(w).alias("line_end"))


@query(
    "top_vector_search",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, 'v' || vec_id AS chunk_id, (1 + list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[])) / 2 AS score FROM embeddings, q)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding")
    folder = scratch(spark, "vector-index")
    vector_index.save_cells(rows, folder)
    return vector_index.nearest(vector_index.load_cells(spark, folder), queries, 10).withColumn("score", F.round("score", 6))


TEXT_QUERIES = [(1, "the and"), (2, "für die"), (3, "of that with"), (4, "que los"), (5, "zzzz")]
_VALUES = ", ".join(f"({q}, {k}, '{w}')" for q, t in TEXT_QUERIES for k, w in enumerate(t.replace("ü", "u").split()))


@query(
    "top_bm25_search",
    rf"""WITH {CHUNKS}, t AS (SELECT chunk_id, regexp_extract_all(strip_accents(lower(content)), '[\p{{L}}\p{{N}}]+') AS w FROM c),
    l AS (SELECT chunk_id, len(w) AS dl FROM t), n AS (SELECT count(*) AS docs, avg(dl) AS mean FROM l), q(query_id, k, term) AS (VALUES {_VALUES}),
    x AS (SELECT chunk_id, unnest(w) AS term FROM t), tf AS (SELECT query_id, k, chunk_id, count(*) AS tf FROM x JOIN q USING (term) GROUP BY ALL),
    df AS (SELECT query_id, k, count(*) AS df FROM tf GROUP BY ALL), m AS (SELECT query_id, count(*) AS m FROM q GROUP BY ALL),
    s AS (SELECT query_id, chunk_id, count(*) AS hits, sum((CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END)
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM tf JOIN df USING (query_id, k) JOIN l USING (chunk_id), n GROUP BY ALL)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s JOIN m USING (query_id) WHERE hits = m QUALIFY rank <= 50""",
)
def _(spark, d):
    return text_index.block_search(_saved_index(spark, chunks(spark, d)), TEXT_QUERIES, 50).select("query_id", "chunk_id", "rank")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The same questions, scored in full over an index that is derived from the table and not kept: one plan without Python."""
    return search.text_search(search.build_text_index(chunks(spark, d), stems=False), TEXT_QUERIES, 50).select("query_id", "chunk_id", "rank")


@query(
    "top_phrase_search",
    rf"""WITH {CHUNKS}, t AS (SELECT chunk_id, seq, regexp_extract_all(strip_accents(lower(content)), '[\p{{L}}\p{{N}}]+') AS w FROM c),
    n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t), q AS (SELECT seq AS query_id, w[2] AS a, w[3] AS b, w[5] AS z FROM t WHERE seq % 20 = 0 AND len(w) >= 5),
    x AS (SELECT chunk_id, len(w) AS dl, w[i] AS a, w[i + 1] AS b FROM (SELECT chunk_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
    tf AS (SELECT query_id, 0 AS k, chunk_id, dl, count(*) AS tf FROM x JOIN q USING (a, b) GROUP BY ALL UNION ALL SELECT query_id, 1, chunk_id, dl, count(*) FROM x JOIN q ON x.a = q.z GROUP BY ALL),
    df AS (SELECT query_id, k, count(*) AS df FROM tf GROUP BY ALL),
    s AS (SELECT query_id, chunk_id, sum((CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
      FROM tf JOIN df USING (query_id, k), n GROUP BY ALL HAVING count(*) = 2)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
)
def _(spark, d):
    """Each row whose number is divisible by 20 asks for its second and third word side by side, and its fifth."""
    rows = chunks(spark, d)
    spelled = rows.filter("seq % 20 = 0").select("seq", text.words(F.col("content")).alias("w")).filter("size(w) >= 5")
    asked = spelled.select(F.col("seq").alias("query_id"), F.concat(F.get("w", F.lit(1)), F.lit("-"), F.get("w", F.lit(2)), F.lit(" "), F.get("w", F.lit(4))).alias("query"))
    return text_index.block_search(_saved_index(spark, rows), asked, 10).withColumn("score", F.round("score", 6))


def _saved_index(spark: SparkSession, rows: DataFrame) -> text_index.BlockIndex:
    folder = scratch(spark, "text-index")
    text_index.save_blocks(rows, folder, stems=False)
    return text_index.load_blocks(spark, folder, stems=False)


@query(
    "snk_index_segments",
    rf"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN source || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 = 0),
    t AS (SELECT 'd' || doc_id AS chunk_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') AS w FROM n), p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM t) GROUP BY ALL)
    SELECT 'term' AS kind, term AS name, count(*) AS n, sum(tf)::BIGINT AS uses FROM p GROUP BY term UNION ALL SELECT 'chunk', chunk_id, len(w), NULL FROM t UNION ALL SELECT 'corpus', NULL, count(*), sum(len(w))::BIGINT FROM t""",
)
def _(spark, d):
    """An index of two changes: a part of the documents; then the others, new texts for each fifth, and without each seventh."""
    rows = chunks(spark, d).select("chunk_id", "content", F.col("seq").alias("k"), F.concat_ws(" ", F.coalesce("repo", F.lit("src0")), "content").alias("longer"))
    kept = text_index.TextSegments(spark, scratch(spark, "segments"), stems=False)
    kept.put(rows.filter("k % 3 <> 0"))
    renewed = rows.filter("k % 5 = 0").select("chunk_id", F.col("longer").alias("content"))
    kept.put(renewed.unionByName(rows.filter("k % 3 = 0 and k % 5 <> 0 and k % 7 <> 0").select("chunk_id", "content")), rows.filter("k % 7 = 0 and k % 5 <> 0"))
    now = kept.index()
    uses = now.postings.groupBy("term").agg(F.sum("tf").alias("uses"))
    out = now.terms.join(uses, "term").select(F.lit("term").alias("kind"), F.col("term").alias("name"), F.col("df").alias("n"), "uses")
    out = out.unionByName(now.lengths.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("name"), F.col("dl").alias("n"), F.lit(None).cast("long").alias("uses")))
    return out.unionByName(now.corpus.select(F.lit("corpus").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("docs").alias("n"), F.round(F.col("docs") * F.col("mean")).cast("long").alias("uses")))


@query("agg_index_stats", f"WITH {CHUNKS} SELECT 'count:' || content_type AS name, count(*) AS value FROM c GROUP BY ALL UNION ALL SELECT 'total', count(*) FROM c UNION ALL SELECT 'commits', count(DISTINCT commit_sha) FROM c")
def _(spark, d):
    return aggregates.index_stats(chunks(spark, d))


@query("agg_counts_by_repo", f"WITH {CHUNKS} SELECT repo, count(*) AS n FROM c WHERE repo IS NOT NULL GROUP BY ALL UNION ALL SELECT 'docs', count(*) FROM c WHERE content_type = 'doc' HAVING count(*) > 0")
def _(spark, d):
    return aggregates.counts_by_repo(chunks(spark, d))


@query("agg_treemap", f"WITH {CHUNKS} SELECT coalesce(repo, 'docs') AS repo, content_type, count(*) AS n FROM c GROUP BY ALL")
def _(spark, d):
    return aggregates.treemap(chunks(spark, d))


@query(
    "agg_length_histogram",
    f"""WITH {CHUNKS}, b AS (SELECT (SELECT count(*) FROM (VALUES (5), (10), (20), (50), (100), (200), (500)) e(x) WHERE e.x < len(string_split(content, chr(10)))) AS bin FROM c),
    g AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
    SELECT bin::INT AS bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS cumulative, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 9) AS share FROM g""",
)
def _(spark, d):
    return aggregates.length_histogram(chunks(spark, d)).withColumn("share", F.round("share", 9))


@query("agg_size_stats", f"WITH {CHUNKS} SELECT content_type, min(length(content)) AS least, round_even(avg(length(content)), 0)::BIGINT AS mean, max(length(content)) AS most FROM c GROUP BY ALL")
def _(spark, d):
    rows = aggregates.size_stats(chunks(spark, d))
    return rows.select("content_type", F.col("least").cast("long").alias("least"), "mean", F.col("most").cast("long").alias("most"))


@query(
    "agg_best_tags",
    """WITH t AS (SELECT source AS key, lang AS name, (n_chars % 10) / 10.0::DOUBLE AS confidence, CASE n_chars % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'readme' ELSE 'directory' END AS src, doc_id FROM documents)
    SELECT key, name, confidence, src AS source FROM t QUALIFY row_number() OVER (PARTITION BY key, name ORDER BY confidence DESC, CASE src WHEN 'code' THEN 3 WHEN 'readme' THEN 2 ELSE 1 END DESC, doc_id) = 1""",
)
def _(spark, d):
    kind = F.when(F.col("n_chars") % 3 == 0, "code").when(F.col("n_chars") % 3 == 1, "readme").otherwise("directory")
    rows = table(spark, d, "documents").select(F.col("source").alias("key"), F.col("lang").alias("name"), ((F.col("n_chars") % 10) / 10.0).alias("confidence"), kind.alias("source"), F.col("doc_id").alias("ord"))
    return aggregates.best_tags(rows, "key")


@query("agg_page_reassembly", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def _(spark, d):
    return aggregates.reassembled(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query(
    "agg_most_common",
    """WITH g AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL)
    SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS place FROM g QUALIFY place <= 2""",
)
def _(spark, d):
    return aggregates.most_common(table(spark, d, "documents"), ["source"], "lang", 2, "doc_id")


@query(
    "agg_group_centroids",
    """SELECT label, count(*) AS n, round(avg(embedding[1]), 6) AS x, round(avg(embedding[2]), 6) AS y, round(avg(embedding[3]), 6) AS z FROM embeddings GROUP BY label HAVING count(*) >= 2""",
)
def _(spark, d):
    points = table(spark, d, "embeddings").select("label", *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])
    return aggregates.group_centroids(points).select("label", "n", *[F.round(a, 6).alias(a) for a in "xyz"])


@query(
    "agg_cluster_summaries",
    """WITH e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
    c AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM e GROUP BY label)
    SELECT label AS cluster, n, round(avg(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) AS spread, '{"t' || (label % 3) || '":' || n || '}' AS kinds, '[{"place":1,"repo":"r2","n":' || n || '}]' AS top_repos
    FROM e JOIN c USING (label) GROUP BY label, n""",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    kind = F.concat(F.lit("t"), (F.col("label") % 3).cast("string"))
    points = e.select(F.col("label").alias("cluster"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")], kind.alias("content_type"), F.concat(F.lit("r"), (F.length(kind)).cast("string")).alias("repo"), F.col("vec_id").alias("ord"))
    return aggregates.cluster_summaries(points).select("cluster", "n", F.round("spread", 6).alias("spread"), F.to_json("kinds").alias("kinds"), F.to_json("top_repos").alias("top_repos"))


@query("agg_blended_colour", "SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS r, round(sum(event_id * user_id) / sum(user_id), 4) AS g FROM events GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("value").alias("r"), F.col("event_id").cast("double").alias("g"), F.lit(0.0).alias("b"), F.col("user_id").alias("n"))
    return aggregates.blended(rows, "event_type").select("event_type", F.round("r", 6).alias("r"), F.round("g", 4).alias("g"))


@query(
    "agg_latency_stats",
    """WITH w AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 1)
    SELECT event_type, median(value) AS median, min(value) AS least, max(value) AS most FROM w GROUP BY ALL""",
)
def _(spark, d):
    return aggregates.latency_stats(table(spark, d, "events").select("event_type", F.col("event_id").alias("run"), F.col("value").alias("ms")), "event_type")


@query(
    "agg_quality_coverage",
    """SELECT doc_id AS name, ((contains(lower(text), 'that') OR contains(lower(text), 'die'))::INT + contains(lower(text), 'que')::INT) / 2 AS coverage FROM documents""",
)
def _(spark, d):
    groups = F.array(F.array(F.lit("That"), F.lit("DIE")), F.array(F.lit("que")))
    return aggregates.quality_score(table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("haystack"), groups.alias("alias_groups")))


@query(
    "agg_confidence",
    """WITH s AS (SELECT source, max(least(1, n_chars / 60000)) AS top, avg(least(1, n_chars / 60000)) AS mean, count(*) AS n FROM documents GROUP BY ALL)
    SELECT source, round(CASE WHEN top >= 0.5 AND n >= 3 THEN least(0.95, 0.6 + mean * 0.3 + least(n / 15, 0.15)) WHEN top >= 0.1 THEN least(0.7, 0.3 + mean * 0.3 + least(n / 20, 0.1))
    ELSE greatest(0.05, 0.1 + mean * 0.2) END, 9) AS confidence FROM s""",
)
def _(spark, d):
    score = F.least(F.lit(1.0), F.col("n_chars") / 60000)
    rows = table(spark, d, "documents").groupBy("source").agg(F.max(score).alias("top"), F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))
    return rows.select("source", F.round(scoring.confidence(F.col("top"), F.col("mean"), F.col("n")), 9).alias("confidence"))


@query("mth_type_preference", "SELECT event_id, round(greatest(0, least(1, value / 1000 + CASE event_type WHEN 'click' THEN 0.02 WHEN 'view' THEN 0.015 ELSE 0 END)), 9) AS score FROM events")
def _(spark, d):
    kind = F.when(F.col("event_type") == "click", "method").when(F.col("event_type") == "view", "function").otherwise("module_overview")
    return table(spark, d, "events").select("event_id", F.round(scoring.type_preference(F.col("value") / 1000, kind), 9).alias("score"))


@query("mth_sigmoid", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_discount * 100 - 5))), 9) AS p FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(scoring.sigmoid(F.col("l_discount") * 100 - 5), 9).alias("p"))


@query("set_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("set_intersect_except", "(SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select("s_nationkey"))
    return both.exceptAll(table(spark, d, "nation").filter("n_regionkey = 2").select("n_nationkey"))


@query(
    "snk_upsert",
    """WITH o AS (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size <= 30), n AS (SELECT p_partkey AS k, p_retailprice * 2 AS v FROM part WHERE p_size >= 20)
    SELECT k AS chunk_id, v, CASE WHEN k IN (SELECT k FROM o) THEN k ELSE (SELECT max(k) FROM o) + row_number() OVER (PARTITION BY k IN (SELECT k FROM o) ORDER BY k) END AS seq FROM n
    UNION ALL SELECT k, v, k FROM o WHERE k NOT IN (SELECT k FROM n)""",
)
def _(spark, d):
    p = table(spark, d, "part")
    old = p.filter("p_size <= 30").select(F.col("p_partkey").alias("chunk_id"), F.col("p_retailprice").alias("v"), F.col("p_partkey").alias("seq"))
    new = p.filter("p_size >= 20").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_retailprice") * 2).alias("v"))
    return store.upserted(old, new).select("chunk_id", "v", "seq")


@query("snk_delete", f"WITH {CHUNKS} SELECT 'kept' AS what, count(*) AS n FROM c WHERE repo IS DISTINCT FROM 'src3' UNION ALL SELECT 'gone', count(*) FROM c WHERE repo = 'src3'")
def _(spark, d):
    kept, gone = store.deleted(chunks(spark, d), "repo", "src3")
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("what"), "n").unionByName(gone.select(F.lit("gone").alias("what"), "n"))


@query("snk_key_values", "SELECT user_id AS key, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("updated_at"))
    return store.set_values(rows.limit(0), rows).select("key", "value")


@query(
    "join_change_detection",
    """WITH o AS (SELECT o_custkey AS k, sum(o_totalprice > 0)::BIGINT AS n FROM (SELECT o_custkey, (o_totalprice > 0)::INT AS o_totalprice FROM orders) GROUP BY ALL)
    SELECT coalesce(c_custkey, k) AS k, CASE WHEN k IS NULL THEN 'new' WHEN c_custkey IS NULL THEN 'gone' WHEN n % 25 = c_nationkey THEN 'same' ELSE 'changed' END AS status
    FROM customer FULL JOIN o ON c_custkey = k""",
)
def _(spark, d):
    stored = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.count(F.lit(1)) % 25).cast("string").alias("fingerprint"))
    now = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("fingerprint"))
    return refresh.plan_changes(stored, now, "k").select("k", "status")


@query(
    "join_method_types",
    """WITH m(event_type, related) AS (VALUES ('click', 'A|B'), ('view', 'C')) SELECT event_id, event_type, related FROM events LEFT JOIN m USING (event_type)""",
)
def _(spark, d):
    types = spark.createDataFrame([("click", ["A", "B"]), ("view", ["C"])], "method_name string, related_types array<string>")
    said = F.lit("x")
    symbols = table(spark, d, "events").select("event_id", F.col("event_type").alias("method_name"), *[said.alias(c) for c in ("repo", "path", "module_path", "class_name", "chunk_type")], F.lit(1).alias("line_start"))
    return code.symbol_chunks(symbols, types=types).select("event_id", F.col("method_name").alias("event_type"), F.array_join("related_types", "|").alias("related"))


@query(
    "join_deprecation_check",
    """WITH e AS (SELECT replace(p_type, ' ', '.') AS old_path, min(p_partkey) AS ord FROM part GROUP BY ALL HAVING min(p_partkey) % 2 = 0),
    s AS (SELECT DISTINCT replace(p_type, ' ', '.') || CASE WHEN p_size > 25 THEN '.x' ELSE '' END AS symbol FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) FROM part),
    m AS (SELECT symbol, old_path FROM s, e WHERE symbol = old_path OR starts_with(symbol, old_path || '.') OR starts_with(old_path, symbol || '.')
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY (symbol = old_path) DESC, ord) = 1)
    SELECT symbol, m.old_path, m.old_path IS NOT NULL AS deprecated FROM s LEFT JOIN m USING (symbol)""",
)
def _(spark, d):
    p = table(spark, d, "part").withColumn("path", F.translate("p_type", " ", "."))
    nothing = F.lit(None).cast("string")
    entries = p.groupBy(F.col("path").alias("old_path")).agg(F.min("p_partkey").alias("ord")).filter("ord % 2 = 0")
    entries = entries.select("old_path", nothing.alias("new_path"), nothing.alias("deprecated_in"), nothing.alias("removed_in"), nothing.alias("note"), "ord")
    symbols = p.select(F.concat("path", F.when(F.col("p_size") > 25, ".x").otherwise("")).alias("symbol")).union(p.select(F.split("p_type", " ")[0])).distinct()
    return deprecation.check(entries, symbols).select("symbol", "old_path", "deprecated")


@query(
    "src_page_split",
    """SELECT doc_id, k AS page, CASE k WHEN 1 THEN lang ELSE source END AS title, 'https://x/' || k || '/' || doc_id AS source_url,
    CASE k WHEN 1 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE 'end' END AS body FROM documents, (VALUES (1), (2)) v(k)""",
)
def _(spark, d):
    def head(k: int, title: str) -> list:
        return [F.lit("# "), F.col(title), F.lit(f"\nSource: https://x/{k}/"), F.col("doc_id").cast("string"), F.lit("\n")]

    dump = F.concat(F.lit("before\n"), *head(1, "lang"), F.col("text"), F.lit("\n"), *head(2, "source"), F.lit("end"))
    pages = markdown.split_pages(table(spark, d, "documents").select("doc_id", dump.alias("value")), "doc_id")
    return pages.select("doc_id", F.col("page").cast("int").alias("page"), "title", "source_url", "body")


@query(
    "udf_changelog_notes",
    """SELECT p_partkey, substr(p_name || ' gone', 1, 80) AS old_path, CASE WHEN k = 1 THEN p_brand END AS deprecated_in, CASE WHEN k = 2 THEN p_brand END AS removed_in, p_name || ' gone' AS note
    FROM part, (VALUES (1), (2)) v(k)""",
)
def _(spark, d):
    item = F.concat(F.lit("\n- "), "p_name", F.lit(" gone\n"))
    log = F.concat(F.lit("- stray\n## ["), "p_brand", F.lit("] - now\n### Added\n- no\n### Deprecated"), item, F.lit("### Removed"), item, F.lit("### Fixed\n- no"))
    notes = deprecation.from_changelog(table(spark, d, "part").select("p_partkey", log.alias("content")), "p_partkey")
    return notes.select("p_partkey", "old_path", "deprecated_in", "removed_in", "note")


#: Orders as commits of 40 repositories, in SQL; the query below makes the same.
COMMITS = """o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders), g AS (SELECT 'r' || (n % 40) AS repo, n // 40 AS k FROM o),
    e AS (SELECT repo, k, k - 1 AS p FROM g WHERE k > 0 UNION SELECT repo, k, k - 4 FROM g WHERE k >= 4 AND k % 9 = 4), t AS (SELECT repo, k, 'v' || k || '.0' AS name FROM g WHERE k % 11 = 5)"""


@query(
    "src_describe",
    f"""WITH RECURSIVE {COMMITS}, w AS (SELECT repo, k AS c, k AS at, 0 AS d FROM g UNION SELECT w.repo, c, e.p, d + 1 FROM w JOIN e ON e.repo = w.repo AND e.k = w.at WHERE w.at % 11 <> 5)
    SELECT g.repo, 'c' || g.k AS sha, b.name, b.d::BIGINT AS distance, regexp_replace(b.name, '^v+', '') AS version
    FROM g LEFT JOIN (SELECT w.repo, c, d, name FROM w JOIN t ON t.repo = w.repo AND t.k = w.at QUALIFY row_number() OVER (PARTITION BY w.repo, c ORDER BY d, name) = 1) b ON b.repo = g.repo AND b.c = g.k""",
)
def _(spark, d):
    rows = store.numbered(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "o_orderkey", name="n").select(F.concat(F.lit("r"), F.col("n") % 40).alias("repo"), F.floor(F.col("n") / 40).alias("k"))
    sha = lambda k: F.concat(F.lit("c"), k.cast("string"))
    k = F.col("k")
    parents = F.array_compact(F.array(F.when(k > 0, sha(k - 1)), F.when((k >= 4) & (k % 9 == 4), sha(k - 4))))
    commits = rows.select("repo", sha(k).alias("sha"), parents.alias("parents"))
    tagged = rows.filter(k % 11 == 5).select("repo", F.concat(F.lit("v"), k, F.lit(".0")).alias("name"), sha(k).alias("target"), F.concat(F.lit("t"), k).alias("object"), (k % 2 == 0).alias("annotated"))
    refs = tagged.select("repo", "name", F.when(F.col("annotated"), F.col("object")).otherwise(F.col("target")).alias("sha"))
    return history.described(commits, refs, tagged.filter("annotated").select("repo", F.col("object").alias("sha"), "target"))


@query(
    "tax_layouts",
    """WITH d AS (SELECT source AS repo, substr(source, 4)::INT AS k, doc_id AS n, lang FROM documents),
    f AS (SELECT DISTINCT repo, CASE k % 3
      WHEN 0 THEN CASE n % 4 WHEN 0 THEN 'examples/foundational/' || (n % 30) || '-' || lang || '/bot.py' WHEN 1 THEN 'examples/foundational/' || (n % 30) || '-x.py' WHEN 2 THEN 'examples/' || lang || '/a.py' ELSE 'examples/' || lang || 'x/' || (n % 5) || '/notes/b.py' END
      WHEN 1 THEN CASE n % 3 WHEN 0 THEN 'examples/' || lang || '/a.py' WHEN 1 THEN 'examples/' || lang || 'y/' || (n % 7) || '/b.ts' ELSE 'examples/README.md' END
      ELSE CASE n % 3 WHEN 0 THEN lang || '/main.py' WHEN 1 THEN 'tests/t.py' ELSE CASE WHEN k % 2 = 0 THEN 'pyproject.toml' ELSE '.hidden/x.py' END END END AS path FROM d),
    p AS (SELECT repo, path, string_split(path, '/') AS s FROM f),
    l AS (SELECT repo, CASE WHEN bool_or(starts_with(path, 'examples/foundational/')) THEN 'numbered' WHEN bool_or(s[1] = 'examples' AND len(s) > 2) THEN 'topics' ELSE 'root' END AS layout, bool_or(s[1] = 'src' OR path = 'pyproject.toml') AS package FROM p GROUP BY repo),
    c AS (SELECT repo, s[2] AS t FROM p WHERE s[1] = 'examples' AND len(s) = 3 AND s[2] <> 'foundational')
    SELECT DISTINCT repo, array_to_string(s[1:3], '/') AS dir, CASE WHEN len(s) = 3 THEN 'file' ELSE 'folder' END AS kind FROM p JOIN l USING (repo) WHERE layout = 'numbered' AND starts_with(path, 'examples/foundational/')
    UNION SELECT repo, 'examples/' || t, 'topic' FROM c JOIN l USING (repo) WHERE layout <> 'root'
    UNION SELECT repo, array_to_string(s[1:3], '/'), 'topic' FROM p JOIN l USING (repo) WHERE layout <> 'root' AND s[1] = 'examples' AND len(s) > 3 AND s[2] <> 'foundational' AND (repo, s[2]) NOT IN (SELECT (repo, t) FROM c)
    UNION SELECT repo, s[1], 'project' FROM p JOIN l USING (repo) WHERE layout = 'root' AND len(s) > 1 AND NOT starts_with(s[1], '.') AND NOT (package AND s[1] = 'tests')""",
)
def _(spark, d):
    """Files of three kinds of repositories, one for each source, named by the numbers and languages of its documents."""
    n, lang, k = F.col("doc_id"), F.col("lang"), F.substring("source", 4, 9).cast("int")
    path = F.concat_ws
    numbered = (
        F.when(n % 4 == 0, F.concat(F.lit("examples/foundational/"), n % 30, F.lit("-"), lang, F.lit("/bot.py"))).when(n % 4 == 1, F.concat(F.lit("examples/foundational/"), n % 30, F.lit("-x.py")))
        .when(n % 4 == 2, path("/", F.lit("examples"), lang, F.lit("a.py"))).otherwise(F.concat(F.lit("examples/"), lang, F.lit("x/"), n % 5, F.lit("/notes/b.py")))
    )
    topics = F.when(n % 3 == 0, path("/", F.lit("examples"), lang, F.lit("a.py"))).when(n % 3 == 1, F.concat(F.lit("examples/"), lang, F.lit("y/"), n % 7, F.lit("/b.ts"))).otherwise("examples/README.md")
    root = F.when(n % 3 == 0, path("/", lang, F.lit("main.py"))).when(n % 3 == 1, "tests/t.py").when(k % 2 == 0, "pyproject.toml").otherwise(".hidden/x.py")
    files = table(spark, d, "documents").select(F.col("source").alias("repo"), F.when(k % 3 == 0, numbered).when(k % 3 == 1, topics).otherwise(root).alias("path")).distinct()
    return taxonomy.example_nodes(files)


@query("str_markdown_chunks")
def _(spark, d):
    pages = table(spark, d, "documents").select(F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("source_url"), F.col("text").alias("body"))
    return markdown.chunk_pages(pages)


@query("api_evidence")
def _(spark, d):
    w = Window.partitionBy("content_type").orderBy(F.desc("n_chars"), "seq")
    top = chunks(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    results = top.select(
        F.col("content_type").alias("query_id"), "rank", (F.lit(0.9) / F.col("rank")).alias("score"), "content", "repo", "path", "commit_sha",
        F.lit("https://x").alias("source_url"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("indexed_at"),
    )
    queries = spark.createDataFrame([("doc", "how to run a thing"), ("none", "nothing here at all")], "query_id string, query string")
    return evidence.assemble(queries, results, {"content_type": "doc"})


def _hub(spark: SparkSession, d: str, searched: bool = True) -> tools.Hub:
    """A hub over the documents; the embedding of number n belongs to document n, and every question has that of number 0."""
    e = table(spark, d, "embeddings")
    rows = conform(chunks(spark, d))
    if not searched:
        return tools.Hub(rows, None)
    asked = list(e.filter("vec_id = 0").first()["embedding"])
    embedded = e.select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding")
    return tools.Hub.of(rows, stems=False, embedded=embedded, embed=lambda _: asked)


def _hybrid_sql(asked: str | list[str], kind: str, limit: int, where: str = "TRUE") -> str:
    """Both searches, fusion, adjustment and diversity for questions of plain words (numbered from 0): c, i and ranked. where: a filter of the chunks."""
    concepts = [asked] if isinstance(asked, str) else asked
    terms, numbers = ", ".join(f"({k}, '{w}')" for k, words in enumerate(concepts) for w in words.split()), ", ".join(f"({k})" for k in range(len(concepts)))
    return rf"""WITH RECURSIVE {CHUNKS}, p AS (SELECT * FROM c WHERE content_type = '{kind}' AND {where}), e AS (SELECT 'd' || vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings), z AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
    v AS (SELECT query_id, chunk_id, r FROM (SELECT chunk_id, row_number() OVER (ORDER BY list_cosine_similarity(v, qv) DESC, chunk_id) AS r FROM p JOIN e USING (chunk_id), z QUALIFY r <= {limit}), (VALUES {numbers}) k(query_id)),
    t AS (SELECT chunk_id, regexp_extract_all(strip_accents(lower(content)), '[\p{{L}}\p{{N}}]+') AS w FROM c),
    l AS (SELECT chunk_id, len(w) AS dl FROM t), n AS (SELECT count(*) AS docs, avg(dl) AS mean FROM l), q(query_id, term) AS (VALUES {terms}),
    x AS (SELECT chunk_id, unnest(w) AS term FROM t), tf AS (SELECT query_id, term, chunk_id, count(*) AS tf FROM x JOIN q USING (term) GROUP BY ALL), df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
    s AS (SELECT query_id, chunk_id, count(*) AS hits, sum((CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END)
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM tf JOIN df USING (query_id, term) JOIN l USING (chunk_id), n GROUP BY ALL),
    b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM s JOIN p USING (chunk_id) JOIN (SELECT query_id, count(*) AS hits FROM q GROUP BY ALL) USING (query_id, hits) QUALIFY r <= {limit}),
    u AS (SELECT query_id, chunk_id, 0 AS l, r FROM v UNION ALL SELECT query_id, chunk_id, 1, r FROM b),
    f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + r) / (2.0::DOUBLE / 61)) AS rrf, count(*) AS n_lists, min(l * 1000000 + r) AS src_order FROM u GROUP BY ALL),
    i AS (SELECT query_id, chunk_id, repo, path, greatest(0, least(1, rrf + CASE WHEN n_lists > 1 THEN 0.1::DOUBLE ELSE 0 END)) AS score, src_order FROM f JOIN c USING (chunk_id)),
    {GREEDY}, top AS (SELECT query_id, rank, chunk_id, score, content, c.repo, c.path, c.commit_sha, c.language, c.capability_tags FROM ranked JOIN i USING (query_id, chunk_id) JOIN c USING (chunk_id) WHERE rank <= {limit})"""


@query("api_search_docs", _hybrid_sql("that with", "doc", 10) + " SELECT rank, chunk_id AS doc_id, path AS title, substr(content, 1, 300) AS snippet, commit_sha, round(score, 9) AS score FROM top")
def _(spark, d):
    return _hub(spark, d).search_docs("that with").hits.select("rank", "doc_id", "title", "snippet", "citation.commit_sha", F.round("score", 9).alias("score"))


@query(
    "api_search_examples",
    _hybrid_sql("les", "code", 20) + " SELECT rank, chunk_id AS example_id, substr(content, 1, 200) AS summary, coalesce(repo, '') AS repo, path, array_to_string(capability_tags, '|') AS tags, round(score, 9) AS score FROM top",
)
def _(spark, d):
    hits = _hub(spark, d).search_examples("les", limit=20).hits
    return hits.select("rank", "example_id", "summary", "repo", "path", F.array_join("capability_tags", "|").alias("tags"), F.round("score", 9).alias("score"))


@query("api_search_api", _hybrid_sql("die", "source", 10) + " SELECT rank, chunk_id, 'unknown' AS chunk_type, substr(content, 1, 500) AS snippet, round(score, 9) AS score FROM top")
def _(spark, d):
    return _hub(spark, d).search_api("die").hits.select("rank", "chunk_id", "chunk_type", "snippet", F.round("score", 9).alias("score"))


@query(
    "api_code_snippet",
    _hybrid_sql("les", "code", 5)
    + " SELECT rank, array_to_string((string_split(content, chr(10)))[1:40], chr(10)) AS content, path, 1 AS line_start, least(40, len(string_split(regexp_replace(content, '\\n$', ''), chr(10))))::INT AS line_end, language FROM top",
)
def _(spark, d):
    return _hub(spark, d).get_code_snippet(intent="les", max_lines=40).hits.select("rank", "content", "path", "line_start", F.col("line_end").cast("int").alias("line_end"), "language")


@query(
    "api_multi_concept",
    _hybrid_sql(["that", "with", "for the"], "doc", 4)
    + """, k AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY rank, query_id) = 1)
    SELECT row_number() OVER (ORDER BY rank, query_id) AS rank, chunk_id AS doc_id, path AS title, substr(content, 1, 300) AS snippet, commit_sha, round(score, 9) AS score FROM k QUALIFY row_number() OVER (ORDER BY rank, query_id) <= 10""",
)
def _(spark, d):
    return _hub(spark, d).search_docs("that + with & for the").hits.select("rank", "doc_id", "title", "snippet", "citation.commit_sha", F.round("score", 9).alias("score"))


@query("api_search_area", _hybrid_sql("that", "doc", 10, "starts_with(path, '/src1')") + " SELECT rank, chunk_id AS doc_id, path AS title, round(score, 9) AS score FROM top")
def _(spark, d):
    return _hub(spark, d).search_docs("that", area="src1").hits.select("rank", "doc_id", "title", F.round("score", 9).alias("score"))


@query("api_search_filtered", _hybrid_sql("les", "code", 10, "repo = 'src3' AND list_has_all(capability_tags, ['fr', 'src3'])") + " SELECT rank, chunk_id AS example_id, repo, round(score, 9) AS score FROM top")
def _(spark, d):
    hits = _hub(spark, d).search_examples("les", repo="src3", capability_tags=["fr", "src3"]).hits
    return hits.select("rank", "example_id", "repo", F.round("score", 9).alias("score"))


_SNIPPET = " SELECT rank, array_to_string((string_split(content, chr(10)))[{begin}:{last}], chr(10)) AS content, path, {begin} AS line_start, least({last}, len(string_split(regexp_replace(content, '\\n$', ''), chr(10))))::INT AS line_end, language FROM top"


@query("api_snippet_symbol", _hybrid_sql("de", "source", 5, "starts_with(language, 'de')") + _SNIPPET.format(begin=1, last=30))
def _(spark, d):
    hub = _hub(spark, d)
    hub.chunks = hub.chunks.withColumn("class_name", F.col("language"))  # what is looked up as a class
    return hub.get_code_snippet(symbol="de", max_lines=30).hits.select("rank", "content", "path", "line_start", F.col("line_end").cast("int").alias("line_end"), "language")


@query("api_snippet_path", _hybrid_sql("/", "code", 5, "starts_with(path, '/src2')").replace("(VALUES (0, '/'))", "(SELECT 0, '' WHERE FALSE)") + _SNIPPET.format(begin=1, last=3))
def _(spark, d):
    hits = _hub(spark, d).get_code_snippet(path="/src2", line_start=1, max_lines=3).hits
    return hits.select("rank", "content", "path", "line_start", F.col("line_end").cast("int").alias("line_end"), "language")


@query(
    "api_doc_section",
    """WITH p AS (SELECT *, turn = max(turn) OVER () AS last FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations))
    SELECT 't' || conv_id || '-' || (SELECT min(turn) FROM p) AS doc_id, '## ' || role || chr(10) || text || CASE WHEN last THEN '' ELSE chr(10) END AS content FROM p WHERE role = 'assistant' ORDER BY turn LIMIT 1""",
)
def _(spark, d):
    t = table(spark, d, "conversations")
    name = F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    turns = t.select(name.alias("chunk_id"), F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("content"), F.lit("doc").alias("content_type"), F.concat(F.lit("/"), F.col("conv_id").cast("string")).alias("path"), F.col("role").alias("section"), F.col("turn").alias("seq"))
    last = t.agg(F.max("conv_id")).first()[0]
    return tools.Hub(conform(turns), None).get_doc(path=f"/{last}", section="Assistant").select("doc_id", "content")


@query("api_get_example", f"WITH {CHUNKS} SELECT 'd7' AS key, path, content, language, repo, commit_sha, array_to_string(capability_tags, '|') AS tags, 1.0::DOUBLE AS confidence FROM c WHERE chunk_id = 'd7'")
def _(spark, d):
    one = _hub(spark, d, searched=False).get_example("d7").withColumn("f", F.get("files", F.lit(0)))
    return one.select("key", "f.path", "f.content", "f.language", "repo", "commit_sha", F.array_join("capability_tags", "|").alias("tags"), F.col("evidence.confidence").alias("confidence"))


@query(
    "api_get_doc",
    """WITH p AS (SELECT * FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)) SELECT 't' || conv_id || '-' || min(turn) AS doc_id, '/' || conv_id AS title,
    string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content, string_agg(role, '|' ORDER BY turn) AS sections, 1.0::DOUBLE AS confidence FROM p GROUP BY conv_id""",
)
def _(spark, d):
    t = table(spark, d, "conversations")
    path = F.concat(F.lit("/"), F.col("conv_id").cast("string"))
    turns = t.select(F.concat_ws("-", F.concat(F.lit("t"), F.col("conv_id").cast("string")), F.col("turn").cast("string")).alias("chunk_id"), F.col("text").alias("content"), F.lit("doc").alias("content_type"), path.alias("path"), F.col("role").alias("section"), F.col("turn").cast("int").alias("chunk_index"))
    rows = store.upserted(conform(turns).limit(0), conform(turns))
    last = t.agg(F.max("conv_id")).first()[0]
    page = tools.Hub(rows, None).get_doc(path=f"/{last}")
    return page.select("doc_id", "title", "content", F.array_join("sections", "|").alias("sections"), F.col("evidence.confidence").alias("confidence"))


@query(
    "api_hub_status",
    f"""WITH {CHUNKS} SELECT 'count:' || content_type AS name, count(*)::VARCHAR AS value FROM c GROUP BY content_type UNION ALL SELECT 'total', count(*)::VARCHAR FROM c
    UNION ALL SELECT 'commits', count(DISTINCT commit_sha)::VARCHAR FROM c UNION ALL SELECT 'repo:' || repo, count(*)::VARCHAR FROM c WHERE repo IS NOT NULL GROUP BY repo
    UNION ALL SELECT 'repo:docs', count(*)::VARCHAR FROM c WHERE content_type = 'doc' HAVING count(*) > 0 UNION ALL SELECT 'reranker', 'off'""",
)
def _(spark, d):
    return _hub(spark, d, searched=False).get_hub_status()
