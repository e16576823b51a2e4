"""Capability tags of examples, from folder names, readmes and code; entries of examples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension
from ..sources.code import CODE_EXTENSIONS, example_dirs
from .aggregates import best_tags

#: Fragments of folder names and the tags they give.
FOLDER_TAGS = {
    "interruptible": "interruptible", "stt": "stt", "tts": "tts", "llm": "llm", "vad": "vad", "vision": "vision", "websocket": "websocket", "rtvi": "rtvi",
    "image": "image-generation", "whisper": "whisper", "daily": "daily", "twilio": "twilio", "livekit": "livekit", "pipeline": "pipeline", "transport": "transport",
    "agent": "agent", "wake": "wake-word", "function": "function-calling", "tool": "function-calling", "noise": "noise-reduction", "chatbot": "chatbot", "storytelling": "storytelling",
}
#: Patterns in readmes and the tags they give.
README_TAGS = [
    (r"\binterrupt", "interruptible"), (r"\bfunction.?call", "function-calling"), (r"\btool.?use", "function-calling"), (r"\bvision", "vision"), (r"\bimage", "image-generation"),
    (r"\bvoice.?activity", "vad"), (r"\bwebsocket", "websocket"), (r"\brtvi", "rtvi"), (r"\btranscri", "stt"), (r"\bspeech.?to.?text", "stt"), (r"\btext.?to.?speech", "tts"),
    (r"\bllm\b", "llm"), (r"\bpipeline", "pipeline"), (r"\btransport", "transport"), (r"\bagent", "agent"), (r"\bwake.?word", "wake-word"), (r"\bdaily\b", "daily"),
    (r"\btwilio\b", "twilio"), (r"\blivekit\b", "livekit"),
]
#: Fragments of import lines and the tags they give.
IMPORT_TAGS = {
    "daily": "daily", "deepgram": "deepgram", "openai": "openai", "anthropic": "anthropic", "elevenlabs": "elevenlabs", "cartesia": "cartesia", "whisper": "whisper", "silero": "silero",
    "langchain": "langchain", "riva": "riva", "azure": "azure", "google": "google", "aws": "aws", "lmnt": "lmnt", "playht": "playht", "xtts": "xtts", "moondream": "moondream",
    "together": "together", "fal": "fal", "fastagent": "fastagent", "websocket": "websocket", "rtvi": "rtvi", "twilio": "twilio", "vonage": "vonage", "gstreamer": "gstreamer",
    "local": "local", "livekit": "livekit", "gemini": "gemini", "groq": "groq", "fireworks": "fireworks", "noisereduce": "noise-reduction", "krisp": "noise-reduction",
}
#: Fragments of class names and the tags they give.
CLASS_TAGS = {
    "Pipeline": "pipeline", "Transport": "transport", "STT": "stt", "TTS": "tts", "LLM": "llm", "ImageGen": "image-generation", "Vision": "vision", "VAD": "vad", "Bot": "bot", "Agent": "agent",
}
#: Topics that give other tags than their own name.
TOPIC_TAGS = {"function-calling": ["function-calling", "tools"], "realtime": ["realtime", "voice-ai"]}
#: The folder of numbered examples, and folders at the top of a package that are no examples.
NUMBERED = "examples/foundational"
PACKAGE_FOLDERS = ("src", "tests", "docs", "scripts", "dashboard", ".github", ".claude")


def _given(rules: list[tuple[Column, str]], confidence: float, source: str) -> Column:
    """The tags (name, confidence, source, ord) of the rules that hold."""
    tag = lambda name, k: F.struct(F.lit(name).alias("name"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.lit(k).cast("long").alias("ord"))
    return F.array_compact(F.array(*[F.when(holds, tag(name, k)) for k, (holds, name) in enumerate(rules)]))


def folder_tags(dirs: DataFrame, key: str, name: str) -> DataFrame:
    low = F.lower(F.col(name))
    return dirs.select(key, F.inline(_given([(low.contains(f), t) for f, t in FOLDER_TAGS.items()], 1.0, "directory")))


def topic_tags(dirs: DataFrame, key: str, topic: str) -> DataFrame:
    pairs = [F.lit(k) if i == 0 else F.array(*[F.lit(t) for t in v]) for k, v in TOPIC_TAGS.items() for i in range(2)]
    names = F.coalesce(F.element_at(F.create_map(*pairs), F.col(topic)), F.array(topic))
    return dirs.select(key, F.posexplode(names).alias("ord", "name"), F.lit(1.0).alias("confidence"), F.lit("directory").alias("source")).select(key, "name", "confidence", "source", F.col("ord").cast("long").alias("ord"))


def readme_tags(readmes: DataFrame, key: str, text: str) -> DataFrame:
    low = F.lower(F.col(text))
    return readmes.select(key, F.inline(_given([(low.rlike(p), t) for p, t in README_TAGS], 0.8, "readme")))


def code_tags(code: DataFrame, key: str, text: str) -> DataFrame:
    """Tags of imports (.9) and of class names (.85); for each tag the first line that gives it counts."""
    line = code.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    said, is_import = F.col("line"), F.col("line").rlike("^(import|from) ")
    imports = _given([(is_import & said.contains(f), t) for f, t in IMPORT_TAGS.items()], 0.9, "code")
    classes = F.transform(_given([(said.contains(f), t) for f, t in CLASS_TAGS.items()], 0.85, "code"), lambda t: t.withField("ord", t["ord"] + 100))
    hit = line.select(key, "pos", F.inline(F.concat(imports, classes)))
    w = Window.partitionBy(key, "name").orderBy("pos", "ord")
    return hit.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(key, "name", "confidence", "source", (F.col("pos") * 1000 + F.col("ord")).cast("long").alias("ord"))


def readme_summary(text: str, most: int = 200) -> str:
    """The first paragraph that is no heading, on one line, cut with three dots."""
    out: list[str] = []
    for row in map(str.strip, text.strip().splitlines()):
        if row and not row.startswith("#"):
            out.append(row)
        elif out:
            break
    said = " ".join(out)
    return said if len(said) <= most else said[: most - 3] + "..."


def summaries(readmes: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "summary": [readme_summary(t or "") for t in batch[text]]})

    return readmes.select(key, text).mapInPandas(run, f"{key} string, summary string")


def path_tree(files: DataFrame) -> DataFrame:
    """repo, dir, depth, code, below of every folder above a file: how many code files lie in it, and how many in it or below. A path has as many folders as parts, so the tree is summed up in one shuffle."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))
    is_code = extension(F.col("path")).isin(*CODE_EXTENSIONS).cast("int")
    rows = files.select("repo", F.size(parts).alias("_n"), is_code.alias("_code"), F.explode(above).alias("a")).select("repo", "a.dir", "a.depth", "_code", (F.col("a.depth") == F.col("_n") - 1).alias("_own"))
    return rows.groupBy("repo", "dir", "depth").agg(F.sum(F.when(F.col("_own"), F.col("_code")).otherwise(0)).alias("code"), F.sum("_code").alias("below"))


def layouts(files: DataFrame) -> DataFrame:
    """repo, layout of each repository: numbered (it has the folder NUMBERED), topics (examples/ has folders), else root."""
    tree = path_tree(files)
    numbered, topics = F.max((F.col("dir") == NUMBERED).cast("int")), F.max(((F.col("depth") == 2) & F.col("dir").startswith("examples/")).cast("int"))
    return tree.groupBy("repo").agg(F.when(numbered == 1, "numbered").when(topics == 1, "topics").otherwise("root").alias("layout"))


def example_nodes(files: DataFrame) -> DataFrame:
    """repo, dir, kind: the examples of each repository by its layout.

    numbered: folders (folder) and Python files (file) right below NUMBERED, and the other examples as topics. topics: folders below examples/ that hold code themselves, else their own folders (topic).
    root: folders at the top but for hidden and skipped ones and, where src/ or a project file shows a package, PACKAGE_FOLDERS (project); if there is none, the root itself.
    """
    how = layouts(files)
    tree, rows = path_tree(files).join(how, "repo"), files.join(how, "repo")
    inside = F.col("dir").startswith(f"{NUMBERED}/") & (F.col("depth") == 3)
    folders = tree.filter((F.col("layout") == "numbered") & inside).select("repo", "dir", F.lit("folder").alias("kind"))
    single = rows.filter((F.col("layout") == "numbered") & F.col("path").rlike(f"^{NUMBERED}/[^/]+[.]py$")).select("repo", F.col("path").alias("dir"), F.lit("file").alias("kind")).distinct()
    topics = example_dirs(rows.filter("layout <> 'root'")).filter((F.col("dir") != NUMBERED) & ~F.col("dir").startswith(f"{NUMBERED}/")).select("repo", "dir", F.lit("topic").alias("kind"))
    package = rows.groupBy("repo").agg(F.max((F.col("path").startswith("src/") | (F.col("path") == "pyproject.toml")).cast("int")).alias("_package"))
    top = tree.filter((F.col("layout") == "root") & (F.col("depth") == 1)).join(package, "repo")
    top = top.filter(~F.col("dir").startswith(".") & ~F.col("dir").isin("__pycache__", "node_modules") & ((F.col("_package") == 0) | ~F.col("dir").isin(*PACKAGE_FOLDERS)))
    top = top.select("repo", "dir", F.lit("project").alias("kind"))
    bare = how.filter("layout = 'root'").select("repo").join(top, "repo", "left_anti").select("repo", F.lit(".").alias("dir"), F.lit("project").alias("kind"))
    return folders.unionByName(single).unionByName(topics).unionByName(top).unionByName(bare)


def entries(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """One entry for each example (repo, dir, and kind, if example_nodes gave it): example_id, tags, key files, summary, foundational class. An example of kind file is one file, which gives its tags and its name."""
    kind = F.col("kind") if "kind" in dirs.columns else F.lit("folder")
    d = dirs.select("repo", "dir", kind.alias("kind")).distinct().withColumn("example_id", F.concat_ws("/", "repo", F.nullif("dir", F.lit("."))))
    parent = F.regexp_replace(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1), "^$", ".")
    own = files.withColumn("dir", parent).join(d.filter("kind <> 'file'"), ["repo", "dir"])
    own = own.unionByName(files.withColumn("dir", F.col("path")).join(d.filter("kind = 'file'"), ["repo", "dir"]))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    keys = own.filter(name.endswith(".py") | name.isin("README.md", "requirements.txt")).groupBy("example_id").agg(F.sort_array(F.collect_set(name)).alias("key_files"))
    readme = own.filter(name == "README.md").groupBy("example_id").agg(F.min("content").alias("readme"))
    code = own.filter(name.endswith(".py")).select(F.col("example_id"), "content")
    parts = F.split("dir", "/")
    leaf = F.when(F.col("kind") == "file", F.regexp_replace(F.element_at(parts, -1), r"\.py$", "")).otherwise(F.element_at(parts, -1))
    named = d.withColumn("leaf", leaf).withColumn("topic", F.when((F.get(parts, F.lit(0)) == "examples") & (F.size(parts) > 2) & (F.col("kind") != "file") & ~F.col("dir").startswith(f"{NUMBERED}/"), F.get(parts, F.lit(1))))
    tags = folder_tags(named.filter("leaf <> '.'"), "example_id", "leaf").unionByName(topic_tags(named.filter("topic is not null"), "example_id", "topic"))
    tags = tags.unionByName(readme_tags(readme, "example_id", "readme")).unionByName(code_tags(code, "example_id", "content"))
    best = best_tags(tags, "example_id")
    capability = F.struct((-F.col("confidence")).alias("c"), "name", "source")
    listed = best.groupBy("example_id").agg(F.sort_array(F.collect_list(capability)).alias("_c"))
    caps = F.transform("_c", lambda c: F.struct(c["name"].alias("name"), (-c["c"]).alias("confidence"), c["source"].alias("source")))
    out = named.join(listed, "example_id", "left").join(keys, "example_id", "left").join(summaries(readme, "example_id", "readme"), "example_id", "left")
    foundational = F.when(F.col("leaf").rlike(r"^\d{2,}-"), F.col("leaf"))
    return out.select(
        "example_id", "repo", F.col("dir").alias("path"), foundational.alias("foundational_class"), F.coalesce(caps, F.array().cast("array<struct<name:string,confidence:double,source:string>>")).alias("capabilities"),
        F.coalesce("key_files", F.array().cast("array<string>")).alias("key_files"), F.coalesce("summary", F.lit("")).alias("summary"),
    )


def by_class(rows: DataFrame, value: str) -> DataFrame:
    return rows.filter(F.col("foundational_class") == value)


def by_tag(rows: DataFrame, tag: str) -> DataFrame:
    return rows.filter(F.exists("capabilities", lambda c: c["name"] == tag))


def by_example(rows: DataFrame, example_id: str) -> DataFrame:
    return rows.filter(F.col("example_id") == example_id).limit(1)


def for_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    """files with the entry of their path itself, else of their folder (the root is `.`)."""
    slim = rows.select("repo", F.col("path").alias("_p"), F.struct("example_id", "foundational_class", F.transform("capabilities", lambda c: c["name"]).alias("tags"), "key_files", "summary").alias("e"))
    own = files.join(slim.withColumnRenamed("_p", "path").withColumnRenamed("e", "_own"), ["repo", "path"], "left")
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1), "^$", ".")
    both = own.withColumn("_dir", folder).join(slim.withColumnRenamed("_p", "_dir").withColumnRenamed("e", "_folder"), ["repo", "_dir"], "left")
    return both.withColumn("entry", F.coalesce("_own", "_folder")).drop("_own", "_folder", "_dir")
