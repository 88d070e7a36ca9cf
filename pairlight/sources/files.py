"""Readers and writers of the audit's files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.compat import py_strip


def jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with their place: ``_file`` and ``_ord`` (order within the file).

    Blank lines are skipped. A broken line raises when it is read if ``strict``,
    else its fields are null. Missing fields are null, further ones are dropped.
    Objects in a column of type string keep their JSON text.
    """
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE", "allowNonNumericNumbers": "true"}
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("_ord")
    )
    full = lines.where(F.length(py_strip("value")) > 0)
    return full.select(F.from_json("value", schema, options).alias("r"), "_file", "_ord").select("r.*", "_file", "_ord")


def whole_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a file: path, name and its JSON as a variant; null where it is broken."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.try_parse_json("value").alias("json"))


def csv(spark: SparkSession, path: str, schema: str | None = None, separator: str = ",") -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, line breaks allowed in quotes."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', sep=separator)
    return (reader.schema(schema) if schema else reader).csv(path)


def metadata(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modification time and sha256 of files, hashed in executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def newest(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The most recently modified file that fits a pattern, anywhere below a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "modificationTime")
    row = found.orderBy(F.desc("modificationTime"), "path").limit(1).collect()
    return row[0][0] if row else None


def discover(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """``path`` and ``modified`` of all files that fit a pattern anywhere below a path, in order of path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("modificationTime").alias("modified")).orderBy("path")


def manifest(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``name`` and what :func:`metadata` tells of each named file or folder."""
    out = None
    for name, path in sorted(paths.items()):
        rows = metadata(spark, path).select(F.lit(name).alias("name"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "name string, path string, length bigint, modificationTime timestamp, sha256 string")


def string_leaves(column: str, most: int):
    """The first ``most`` strings in a JSON text, depth first, as an array; broken JSON and null have none."""

    def leaves(value: object) -> Iterator[str]:
        if isinstance(value, str):
            yield value
        elif isinstance(value, (list, dict)):
            for part in value.values() if isinstance(value, dict) else value:
                yield from leaves(part)

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> list[str]:
            try:
                return list(islice(leaves(json.loads(text)), most)) if text else []
            except ValueError:
                return []

        for b in batches:
            yield b.map(one)

    return found(column)


#: Extensions of source files, preferred first (fixed values).
PREFERRED = (".parquet", ".jsonl", ".json", ".csv", ".tsv")


def inventory_paths(inventory: str, root: str = ".") -> dict[str, str]:
    """Base name to path of the files an inventory lists ({"files": [{"metadata": {"relative_path": ...}}]}).

    Of several files of one name the preferred extension counts, then the first path.
    """
    listed = json.loads(Path(inventory).read_text(encoding="utf-8")).get("files", [])
    paths = [Path(f["metadata"]["relative_path"]) for f in listed if isinstance(f, dict) and (f.get("metadata") or {}).get("relative_path")]
    order = {e: i for i, e in enumerate(PREFERRED)}
    out: dict[str, str] = {}
    for p in sorted(paths, key=lambda p: (order.get(p.suffix.lower(), len(order)), str(p))):
        out.setdefault(p.stem, str(Path(root, p)))
    return out


def first_existing(*candidates: str | None) -> str | None:
    """The first candidate path that exists; repeated and empty ones are skipped."""
    return next((c for c in dict.fromkeys(candidates) if c and Path(c).exists()), None)


def conventional(root: str, name: str) -> str | None:
    """Where a source of some name lies below a root: as a file by preferred extension, in a folder of its name or of data, or as a folder."""
    places = [Path(root, f"{name}{e}") for e in PREFERRED] + [Path(root, folder, f"{name}{e}") for folder in (name, "data") for e in PREFERRED] + [Path(root, name), Path(root, "data", name)]
    return first_existing(*map(str, places))


def default_paths(root: str, names: tuple[str, ...] = ("RealToxicityPrompts", "BOLD", "HolisticBias", "HateCheck")) -> dict[str, str]:
    """Path of each named source that is found below a root."""
    return {name: path for name in names if (path := conventional(root, name))}


def predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Single or paired prediction files as wide pairs or single rows, told apart by their content.

    If any record is paired, the others are dropped.
    """
    from pairlight.operators.pairing import flat
    from pairlight.schema import PAIRED, PREDICTION

    paired = jsonl(spark, path, PAIRED)
    return flat(paired) if is_paired(paired) else jsonl(spark, path, PREDICTION)


def is_paired(df: DataFrame) -> bool:
    """Whether any record has both sides; then rows without them are to be dropped."""
    return "paired" in df.columns and not df.where("paired is not null").isEmpty()


# ---- benchmark suites ----


def continuations(spark: SparkSession, path: str, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Prompts of a continuation set (JSON lines): id, prompt, split test, the raw row as meta.

    The prompt is the first full one of text, prompt and input, an object giving its text;
    an object whose text is empty is not full.
    """
    from pairlight.operators.sampling import reservoir

    raw = spark.read.text(path).select(F.col("value").alias("meta")).where(F.length(py_strip("value")) > 0)
    get = lambda k: F.nullif(F.get_json_object("meta", f"$.{k}"), F.lit(""))
    # a text that looks like an object is none; from_json tells them apart
    is_object = F.from_json("meta", "prompt struct<text: string>")["prompt"].isNotNull()
    has_text = is_object & F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object("meta", "$.prompt")), "text"), F.lit(False))
    prompt = F.coalesce(get("text"), F.when(has_text, get("prompt.text")).otherwise(get("prompt")), get("input"))
    ident = F.coalesce(get("id"), get("prompt_id"), get("filename"), F.sha2("meta", 256))
    out = raw.select(F.concat(F.lit("RealToxicityPrompts:"), ident).alias("sample_id"), F.lit("RealToxicityPrompts").alias("source"), prompt.alias("prompt"), F.lit(None).cast("string").alias("gold_label"), F.lit("test").alias("split"), "meta").where("prompt is not null")
    return reservoir(out, limit, "sample_id", seed) if limit is not None else out


def grouped_prompts(spark: SparkSession, folder: str, wiki: str | None = None, wiki_sentences: int | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Prompts of files <dimension>_prompt.json (group, entity, prompt or prompts).

    With ``wiki``, files <dimension>_wiki.json of the same nesting give a context
    per entity, joined by dimension, group and entity: its first ``wiki_sentences``
    sentences, or all. At most ``limit`` prompts are drawn.
    """
    from pairlight.functions.answers import first_sentences
    from pairlight.operators.sampling import reservoir

    def leaves(path: str, suffix: str) -> DataFrame:
        files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}").select(F.regexp_replace(F.col("_metadata.file_name"), f"{suffix}$", "").alias("dimension"), F.from_json("value", "map<string,map<string,string>>").alias("g"))
        rows = files.select("dimension", F.explode("g").alias("group", "e")).select("dimension", "group", F.explode("e").alias("entity", "raw"))
        many = F.from_json("raw", "array<string>")
        return rows.select("dimension", "group", "entity", F.posexplode_outer(F.when(F.col("raw").startswith("["), many).otherwise(F.array("raw"))).alias("k", "text"))

    prompts = leaves(folder, "_prompt.json").where("text is not null")
    if wiki:
        context = leaves(wiki, "_wiki.json").groupBy("dimension", "group", "entity").agg(F.min_by("text", "k").alias("context"))
        if wiki_sentences is not None:
            context = context.withColumn("context", first_sentences("context", wiki_sentences))
        prompts = prompts.join(context, ["dimension", "group", "entity"], "left")
    else:
        prompts = prompts.withColumn("context", F.lit(None).cast("string"))
    ident = F.concat_ws(":", F.lit("BOLD"), "dimension", "group", F.regexp_replace("entity", " ", "_"), F.substring(F.sha2("text", 256), 1, 10))
    meta = F.to_json(F.struct("dimension", "group", "entity", "context"))
    from pairlight.operators.ingest import suffixed_ids

    rows = suffixed_ids(prompts.withColumn("__base", ident), "__base", ["k"])
    out = rows.select("sample_id", F.lit("BOLD").alias("source"), F.col("text").alias("prompt"), F.lit(None).cast("string").alias("gold_label"), F.lit("test").alias("split"), meta.alias("meta"))
    return reservoir(out, limit, "sample_id", seed) if limit is not None else out


def descriptor_sentences(spark: SparkSession, descriptors: Mapping[str, list[str]], nouns: Mapping[str, list[str]], templates: list[str], cap: int | None = None, seed: int = 42, most: tuple[int, int, int] = (50, 50, 100), phrases: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Sentences of descriptor, noun and template per category.

    A category with standalone noun ``phrases`` takes these; any other crosses its
    first ``most[0]`` descriptors with the nouns, of which each group gives its
    first ``most[1]`` and all together ``most[2]``, in the order of the groups.
    Every phrase gets one template by hash; ``cap`` phrases a category are drawn.
    Placeholders are {noun_phrase} and {plural_noun_phrase}. The lists are
    configuration, not data. A repeated phrase of a category raises ValueError.
    """
    from pairlight.operators.ingest import picked, plural
    from pairlight.operators.sampling import capped

    noun_list = [x for xs in nouns.values() for x in xs[: most[1]]][: most[2]]
    rows = []
    for category in sorted({*descriptors, *(phrases or {})}):
        ready = (phrases or {}).get(category)
        rows += [(category, None, None, x) for x in ready] if ready else [(category, d, n, f"{d} {n}") for d in descriptors.get(category, [])[: most[0]] for n in noun_list]
    if len({(r[0], r[3]) for r in rows}) < len(rows):
        raise ValueError("a phrase occurs twice in a category")
    frame = spark.createDataFrame(rows, "category string, descriptor string, noun string, phrase string")
    if cap is not None:
        frame = capped(frame, "category", cap, "phrase", seed)
    t = picked(F.array(*[F.lit(x) for x in templates]), seed, "category", "phrase")
    article = F.when(F.lower(F.col("phrase")).rlike("^[aeiou]"), F.lit("an ")).otherwise(F.lit("a "))
    text = F.replace(F.replace(t, F.lit("{plural_noun_phrase}"), plural("phrase")), F.lit("{noun_phrase}"), F.concat(article, F.col("phrase")))
    ident = F.concat_ws(":", F.lit("HolisticBias"), "category", F.substring(F.sha2("phrase", 256), 1, 10))
    return frame.select(ident.alias("sample_id"), F.lit("HolisticBias").alias("source"), text.alias("prompt"), F.lit(None).cast("string").alias("gold_label"), F.lit("test").alias("split"), F.to_json(F.struct("category", "descriptor", "noun")).alias("meta"))


def functional_cases(spark: SparkSession, cases: str, annotations: str | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Cases of a functional test set (CSV), with the first annotation of each and their number; at most ``limit`` are drawn."""
    rows = csv(spark, cases)
    if annotations:
        from pairlight.operators.ingest import first_annotation

        notes = csv(spark, annotations).withColumn("_ord", F.monotonically_increasing_id())
        extra = [c for c in notes.columns if c not in (*rows.columns, "_ord")]
        rows = first_annotation(rows, notes, "case_id", ["_ord"], extra)
    rest = [c for c in rows.columns if c not in ("case_id", "test_case")]
    out = rows.select(F.concat(F.lit("HateCheck:"), F.col("case_id").cast("string")).alias("sample_id"), F.lit("HateCheck").alias("source"), F.col("test_case").alias("prompt"), F.lit(None).cast("string").alias("gold_label"), F.lit("test").alias("split"), F.to_json(F.struct(*rest)).alias("meta"))
    from pairlight.operators.sampling import reservoir

    return reservoir(out, limit, "sample_id", seed) if limit is not None else out


# ---- registry ----

#: Most samples taken of a source by default (fixed values); others are taken whole.
DEFAULT_CAPS = {"RealToxicityPrompts": 1000, "BOLD": 1000, "HolisticBias": 1000}
_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, loader: Callable[..., DataFrame]) -> None:
    """Makes a loader (spark, path) known under a source's name; a known name is replaced."""
    _REGISTRY[name] = loader


def samples_file(spark: SparkSession, path: str) -> DataFrame:
    """Normalized samples of JSON lines; a repeated sample id raises ValueError."""
    from pairlight.operators.ingest import require_unique
    from pairlight.schema import SAMPLE

    return require_unique(jsonl(spark, path, SAMPLE), "sample_id").select("sample_id", "source", "prompt", "gold_label", "split", "meta")


register("samples", samples_file)
register("RealToxicityPrompts", lambda spark, path: continuations(spark, path))
register("BOLD", lambda spark, path: grouped_prompts(spark, path))
register("HateCheck", lambda spark, path: functional_cases(spark, path))


def load_sources(spark: SparkSession, paths: Mapping[str, str], caps: Mapping[str, int | None] | None = None, seed: int = 42) -> DataFrame:
    """All samples of the named sources in one frame, with the source path in ``meta``.

    A name that is not registered is read as normalized samples. Each source gives
    at most its cap (DEFAULT_CAPS, unless ``caps`` says otherwise), drawn by hash.
    Without a path the frame is empty.
    """
    from pairlight.operators.ingest import with_meta
    from pairlight.operators.sampling import reservoir
    from pairlight.schema import SAMPLE

    out = spark.createDataFrame([], SAMPLE)
    for name, path in sorted(paths.items()):
        rows = _REGISTRY.get(name, samples_file)(spark, path)
        cap = {**DEFAULT_CAPS, **(caps or {})}.get(name)
        rows = rows if cap is None else reservoir(rows, cap, "sample_id", seed)
        out = out.unionByName(rows.withColumn("meta", with_meta("meta", {"source_path": F.lit(path)})).select(*out.columns))
    return out


# ---- writers ----


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header; null is empty. Small reports only: one file is written."""
    df.select(*(columns or df.columns)).coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def export_samples(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Samples as Parquet, partitioned so that readers of one source and split read no other; empty ones lie with the missing."""
    part = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    writer = df.withColumns({"source_part": part("source"), "split_part": part("split")}).write
    writer.mode("overwrite" if overwrite else "ignore").partitionBy("source_part", "split_part").parquet(path)


def write_text(text: str, path: str) -> None:
    """A small text to a file of the file system that Spark writes to, which a cluster's executors see too."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        Path(path).write_text(text, encoding="utf-8")
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_json(value: object, path: str) -> None:
    """A small driver-side value as sorted, indented JSON; NaN becomes null."""
    clean = lambda x: None if isinstance(x, float) and x != x else {str(k): clean(v) for k, v in x.items()} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, (list, tuple, set)) else x
    write_text(json.dumps(clean(value), indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n", str(path))


def latex_matrix(matrix: DataFrame, models: list[str], metrics: list[str]) -> str:
    """A LaTeX table of a small matrix: sources down, models and metrics across, -- for missing.

    Benchmarks of the primary set (D*, N*) come first, then the others by name.
    """
    rows = sorted(matrix.collect(), key=lambda r: (not str(r["source"]).upper().startswith(("D", "N")), str(r["source"])))
    cell = lambda x: "--" if x is None or x != x else f"{x:.3f}"
    head = " & ".join(["Source", *[f"{m} {k}".replace("_", r"\_") for m in models for k in metrics]])
    body = [" & ".join([str(r["source"]).replace("_", r"\_"), *[cell(r[f"{m}_{k}"]) for m in models for k in metrics]]) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{l" + "r" * (len(models) * len(metrics)) + "}", r"\toprule", head + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
