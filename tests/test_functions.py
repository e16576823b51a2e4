import pytest
from pyspark.sql import functions as F

from gleanstone.functions import scoring, text
from gleanstone.functions.embedding import embed, hashed_embedding, score_pairs
from gleanstone.functions.stemming import porter
from gleanstone.functions.versions import compatibility, compatible_only, with_compatibility


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("user", "pin", "label"),
    [
        ("0.0.95", ">=0.0.90", "compatible"),
        ("0.0.95", ">=0.0.105", "newer_required"),
        ("0.0.95", "==0.0.85", "older_targeted"),
        ("0.0.95", "==0.0.95", "compatible"),
        ("0.1.0", ">=0.0.95,<0.1", "older_targeted"),
        ("0.1.0", "~=0.0.95", "older_targeted"),
        ("0.0.94", "~=0.0.95", "newer_required"),
        ("0.0.95", "0.0.90", "compatible"),
        ("0.0.95", "0.0.95", "compatible"),
        ("0.0.95", "0.0.108", "newer_required"),
        ("0.0.95", ">0.0.95", "newer_required"),
        ("0.0.96", ">0.0.95", "compatible"),
        ("0.0.95", "!=0.0.95", "unknown"),
        ("0.0.96", "!=0.0.95", "compatible"),
        ("0.0.100", ">=0.0.95,!=0.0.100", "unknown"),
        ("0.0.95", "<0.0.90", "older_targeted"),
        ("0.0.95", "^1.7.0", "unknown"),
        ("0.0.95", "", "unknown"),
        ("0.0.95", None, "unknown"),
        ("what", ">=0.0.1", "unknown"),
        ("0.0.95", "not a pin", "unknown"),
        ("0.0.95", " >=0.0.90 ", "compatible"),
    ],
)
def test_compatibility(user, pin, label):
    assert compatibility(user, pin) == label


def test_pins_are_labelled_once_and_joined(spark):
    rows = spark.createDataFrame([(1, ">=2.0"), (2, ">=2.0"), (3, "0.5"), (4, None)], "k int, pipeline_version_pin string")
    got = {r["k"]: (r["compat"], r["version_penalty"]) for r in with_compatibility(rows, "1.0").collect()}
    assert got == {1: ("newer_required", 0.05), 2: ("newer_required", 0.05), 3: ("compatible", 0.0), 4: ("unknown", 0.0)}
    assert {r["k"] for r in compatible_only(with_compatibility(rows, "1.0")).collect()} == {3, 4}


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("predication", "predic"),
        ("triplicate", "triplic"), ("formative", "form"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustable", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"),
        ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("naïve", "naïve"),
    ],
)
def test_porter(word, stem):
    assert porter(word) == stem


def test_symbols_and_concepts(spark):
    q = F.lit("use DailyTransport with run_bot and acme.frames TTS in a Plain I word")
    assert one(spark, text.query_symbols(q)) == ["DailyTransport", "run_bot", "acme.frames", "TTS"]
    assert one(spark, text.concepts(F.lit("a + b & c"))) == ["a", "b", "c"]
    assert one(spark, text.concepts(F.lit("a+b"))) == [] and one(spark, text.concepts(F.lit(" + only"))) == []
    assert len(one(spark, text.concepts(F.lit(" + ".join("abcdefg"))))) == 5


def test_text_shapes(spark):
    assert one(spark, text.bracket_modules(F.lit("a.[x, y].z"))) == ["a.x.z", "a.y.z"] and one(spark, text.bracket_modules(F.lit("a.b"))) == ["a.b"]
    assert one(spark, text.module_path(F.lit("src/acme/services/grok/__init__.py"))) == "acme.services.grok"
    assert one(spark, text.module_path(F.lit("src/acme/services/ai.py"))) == "acme.services.ai"
    assert one(spark, text.url_path(F.lit("https://x.y/guides/a?b#c"))) == "/guides/a"
    assert one(spark, text.domain(F.lit("deploy/x.py"))) == "infra" and one(spark, text.domain(F.lit("a/b.yaml"))) == "config"
    assert one(spark, text.domain(F.lit("client/x.py"))) == "frontend" and one(spark, text.domain(F.lit("bot.py"))) == "backend"
    assert one(spark, text.language(F.lit("a/Dockerfile"))) == "dockerfile" and one(spark, text.language(F.lit("a.tsx"))) == "typescript"
    assert one(spark, text.plain_rst(F.lit(":class:`Foo` and `Text <u>`_ with *em*"))) == "Foo and Text with em"
    assert one(spark, text.json_list(F.lit('["a"]'))) == ["a"] and one(spark, text.json_list(F.lit("nope"))) == []
    assert text.like_escaped("a%b_c\\") == "a\\%b\\_c\\\\"
    assert one(spark, text.execution_mode(F.array(F.lit("x"), F.lit("y")), ["y"])) == "cloud"
    assert one(spark, text.is_repo_slug(F.lit("a/b"))) and not one(spark, text.is_repo_slug(F.lit("a/../b")))
    assert one(spark, text.words(F.lit("Élan foo_bar-9"))) == ["elan", "foo", "bar", "9"]


def test_scores(spark):
    v = F.array(*[F.lit(x) for x in (1.0, 0.0)])
    w = F.array(*[F.lit(x) for x in (0.0, 2.0)])
    assert one(spark, scoring.cosine_similarity(v, v)) == 1.0 and one(spark, scoring.cosine_similarity(v, w)) == 0.5
    assert abs(one(spark, scoring.reciprocal_rank(F.lit(1), 2)) - 0.5) < 1e-12
    assert one(spark, scoring.adjusted(F.lit(0.95), F.lit(0.25), F.lit(0.0))) == 1.0
    assert abs(one(spark, scoring.adjusted(F.lit(0.5), F.lit(0.0), F.lit(0.15))) - 0.4) < 1e-12
    assert one(spark, scoring.idf(F.lit(10), F.lit(9))) == 1e-6
    assert abs(one(spark, scoring.staleness(F.lit("2025-01-01").cast("timestamp"), F.lit("2026-02-17").cast("timestamp"))) - 0.1) < 1e-12
    assert one(spark, scoring.staleness(F.lit("2026-02-18").cast("timestamp"), F.lit("2026-02-17").cast("timestamp"))) == 0.0
    assert one(spark, scoring.sigmoid(F.lit(0.0))) == 0.5


def test_embedding_fills_only_what_is_missing(spark):
    rows = spark.createDataFrame([(1, "a b", [1.0]), (2, "c d", None), (3, None, None)], "k int, content string, embedding array<float>")
    got = {r["k"]: r["embedding"] for r in embed(rows).collect()}
    assert got[1] == [1.0] and len(got[2]) == 384 and got[3] is None
    assert abs(sum(x * x for x in hashed_embedding("some words")) - 1) < 1e-5
    scored = score_pairs(spark.createDataFrame([("a", "abc")], "query string, content string"), lambda: lambda q, t: [float(len(x)) for x in t]).first()
    assert scored["ce_logit"] == 3.0
