"""Registered queries of readers, writers and small functions, each by the library's own code.

What a reader reads is written first, by the library's writers, below the shared
folder; the SQL says what must come back.
"""

from __future__ import annotations

import json
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.cluster import checkpoint_dir, table
from pairlight.functions import answers
from pairlight.operators import ingest, pairing
from pairlight.plans.audit_queries import _PAIRS, _SEED, _ids, _of, _plural
from pairlight.sources import files

_TICK = count()


def _place(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder."""
    return f"{checkpoint_dir(spark)}/round-trip-{spark.sparkContext.applicationId}-{next(_TICK)}-{name}"


def samples_jsonl(spark, folder):
    """Samples through JSON lines, in two appended parts."""
    s, at = table(spark, folder, "samples").select("sample_id", "source", "prompt", "gold_label", "split", "meta"), _place(spark, "samples")
    files.write_jsonl(s.where("split = 'train'"), at)
    files.write_jsonl(s.where("split is null or split <> 'train'"), at, mode="append")
    back = files.samples_file(spark, at)
    return back.select("sample_id", "source", "gold_label", "split", F.md5(F.coalesce("prompt", F.lit("-"))).alias("prompt_md5"), F.md5(F.coalesce("meta", F.lit("-"))).alias("meta_md5"))


def documents_csv(spark, folder):
    d, at = table(spark, folder, "documents").select("doc_id", "kind", "text"), _place(spark, "documents")
    rows = d.select("doc_id", "kind", F.md5("text").alias("md5"), F.concat(F.lit('a "quoted", '), F.col("kind")).alias("note"))
    files.write_csv(rows, at, ["doc_id", "note", "kind", "md5"])
    return files.csv(spark, at, "doc_id bigint, note string, kind string, md5 string").select("doc_id", "note", "kind", "md5")


def samples_export(spark, folder):
    """Samples per source and split as the partitioned export has them."""
    at = _place(spark, "export")
    files.export_samples(table(spark, folder, "samples"), at)
    return spark.read.parquet(at).groupBy("source_part", "split_part").agg(F.count(F.lit(1)).alias("n"))


def paired_file(spark, folder):
    """Pairs through a file of paired records, told apart by its content."""
    p, at = table(spark, folder, "predictions"), _place(spark, "paired")
    pairs = pairing.pair_runs(pairing.run(p, _of("A")), pairing.run(p, _of("B")))
    files.write_jsonl(pairing.nested(pairs), at)
    return files.predictions(spark, at).select("key", "policy", "gold", "a_pred", "b_pred")


def continuation_suite(spark, folder):
    """Prompts of one source as a continuation set: as text, as an object's text, or as input."""
    s, at = table(spark, folder, "samples").where("source = 'RealToxicityPrompts' and prompt is not null"), _place(spark, "continuations")
    kind = F.pmod(F.length("sample_id"), F.lit(3))
    rows = s.select(F.when(kind == 0, F.col("prompt")).alias("text"), F.when(kind == 1, F.struct(F.col("prompt").alias("text"))).alias("prompt"), F.when(kind == 2, F.col("prompt")).alias("input"), F.col("sample_id").alias("id"))
    rows.write.json(at)
    return files.continuations(spark, at).select("sample_id", "split", F.md5("prompt").alias("md5"))


def grouped_suite(spark, folder):
    """Nations as entities of their region, with the region's comment as context."""
    at = _place(spark, "grouped")
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nested: dict[str, dict[str, dict[str, str]]] = {}
    wiki: dict[str, dict[str, dict[str, str]]] = {}
    for r in n.select("r_name", "n_name").collect():
        key = r["r_name"].lower().replace(" ", "-")
        nested.setdefault(key, {}).setdefault("nations", {})[r["n_name"]] = f"The people of {r['n_name']} say"
        wiki.setdefault(key, {}).setdefault("nations", {})[r["n_name"]] = f"It lies in {r['r_name']}. It has towns. It has more."
    for key in nested:
        files.write_text(json.dumps(nested[key]), f"{at}/prompts/{key}_prompt.json")
        files.write_text(json.dumps(wiki[key]), f"{at}/wiki/{key}_wiki.json")
    out = files.grouped_prompts(spark, f"{at}/prompts", f"{at}/wiki", wiki_sentences=2)
    get = lambda k: F.get_json_object("meta", f"$.{k}")
    return out.select(get("dimension").alias("dimension"), get("entity").alias("entity"), "prompt", get("context").alias("context"), "split")


_DESCRIPTORS = {"age": ["old", "young", "teenage"], "trade": ["angry", "busy"]}
_NOUNS = {"people": ["man", "city", "boss"], "jobs": ["baker", "clerk"]}
_PHRASES = {"family": ["elder sister", "uncle"]}
_TEMPLATES = ["I met {noun_phrase}.", "What do {plural_noun_phrase} do?"]


def descriptor_suite(spark, folder):
    """Sentences of descriptors, nouns and standalone phrases, three phrases a category."""
    out = files.descriptor_sentences(spark, _DESCRIPTORS, _NOUNS, _TEMPLATES, cap=3, seed=7, phrases=_PHRASES)
    return out.select("sample_id", "prompt", F.get_json_object("meta", "$.noun").alias("noun"))


def functional_suite(spark, folder):
    """Documents as functional cases with their first review, through two CSV files."""
    at = _place(spark, "functional")
    cases = table(spark, folder, "documents").select(F.col("doc_id").alias("case_id"), F.md5("text").alias("test_case"), "kind")
    notes = table(spark, folder, "harm_labels").groupBy("doc_id").agg(F.min("rater").alias("rater")).select(F.col("doc_id").alias("case_id"), "rater")
    files.write_csv(cases.where("test_case is not null"), f"{at}/cases")
    files.write_csv(notes, f"{at}/notes")
    out = files.functional_cases(spark, f"{at}/cases", f"{at}/notes")
    return out.select("sample_id", "prompt", F.get_json_object("meta", "$.rater").alias("rater"), F.get_json_object("meta", "$.n_annotations").cast("bigint").alias("n_annotations"))


def suites_union(spark, folder):
    """All sources written as files and loaded by name into one frame, with their path in meta."""
    s, at = table(spark, folder, "samples").select("sample_id", "source", "prompt", "gold_label", "split", "meta"), _place(spark, "suites")
    paths = {}
    for split in ("train", "val", "test"):
        paths[f"part_{split}"] = f"{at}/{split}"
        files.write_jsonl(s.where(F.col("split") == split), paths[f"part_{split}"])
    out = files.load_sources(spark, paths, {"part_val": 20})
    part = F.regexp_extract(F.get_json_object("meta", "$.source_path"), "([a-z]+)$", 1)
    return out.groupBy(part.alias("part"), "split").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"))


def file_manifest(spark, folder):
    """Files of a written table: how many, and whether size and hash are those of their content."""
    at = _place(spark, "manifest")
    files.write_text("one\n", f"{at}/a/1.txt")
    files.write_text("two", f"{at}/a/deep/2.txt")
    files.write_text("{}", f"{at}/b.json")
    found = files.manifest(spark, {"a": f"{at}/a", "b": f"{at}/b.json"})
    return found.select("name", F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "sha256")


def discovered_files(spark, folder):
    at = _place(spark, "discover")
    for name in ("b/2.jsonl", "a/1.jsonl", "a/x.txt", "3.jsonl"):
        files.write_text("{}\n", f"{at}/{name}")
    rows = [r["path"].split("discover/")[1] for r in files.discover(spark, at).collect()]
    return spark.createDataFrame(list(enumerate(rows)), "n bigint, path string")


def whole_json_files(spark, folder):
    at = _place(spark, "whole")
    files.write_text('{"regions": [{"name": "a"}, {"name": "b"}]}', f"{at}/good.json")
    files.write_text('{"regions": [', f"{at}/bad.json")
    return files.whole_json(spark, at).select("name", F.expr("try_variant_get(json, '$.regions[1].name', 'string')").alias("second"))


def meta_propagated(spark, folder):
    """Teacher inputs whose meta names the severity, unless it is there already."""
    s = table(spark, folder, "samples").select("sample_id", "meta", F.when(F.length("sample_id") % 2 == 0, F.lit("severe")).alias("severity_bin"), F.col("source").alias("regression_trigger"))
    out = ingest.propagated(s)
    get = lambda k: F.get_json_object("meta", f"$.{k}")
    return out.select("sample_id", get("severity_bin").alias("severity_bin"), get("regression_trigger").alias("regression_trigger"), get("benchmark_id").alias("benchmark_id"), F.size(F.json_object_keys("meta")).cast("bigint").alias("n_keys"))


def slice_cards(spark, folder):
    s = table(spark, folder, "samples")
    return ingest.slice_cards(s, F.coalesce(F.nullif(F.upper(F.trim("source")), F.lit("")), F.lit("unknown")), {"split": "split", "label": "gold_label", "prompt": "prompt"}, 3)


def string_leaves(spark, folder):
    """The first three strings in the meta of every sample."""
    return table(spark, folder, "samples").select("sample_id", F.array_join(files.string_leaves("meta", 3), "|").alias("leaves"))


_WORDS = ["city", "boy", "boss", "box", "buzz", "church", "brush", "woman", "human being", "old lady", "baker", "Day"]


def plural_forms(spark, folder):
    return spark.createDataFrame([(w,) for w in _WORDS], "word string").select("word", ingest.plural("word").alias("plural"))


def subsequence(spark, folder):
    """Where the word lengths 3, 4 first follow each other in a document."""
    return table(spark, folder, "documents").select("doc_id", answers.find_subsequence(_ids(F.col("text")), F.array(F.lit(3), F.lit(4))).cast("bigint").alias("place"))


def token_estimate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", answers.estimated_tokens("text", 256).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        samples_jsonl, documents_csv, samples_export, paired_file, continuation_suite, grouped_suite, descriptor_suite, functional_suite, suites_union, file_manifest, discovered_files, whole_json_files,
        meta_propagated, slice_cards, string_leaves, plural_forms, subsequence, token_estimate,
    )
}

_CROSSED = [(c, d, n, f"{d} {n}") for c, ds in _DESCRIPTORS.items() for d in ds for ns in _NOUNS.values() for n in ns] + [(c, None, None, x) for c, xs in _PHRASES.items() for x in xs]
_VALUES = ", ".join(f"('{c}', {f'{chr(39)}{n}{chr(39)}' if n else 'NULL'}, '{x}')" for c, _, n, x in _CROSSED)
_NAME = "coalesce(nullif(upper(trim(source)), ''), 'unknown')"
SQL = {
    "samples_jsonl": "SELECT sample_id, source, gold_label, split, md5(coalesce(prompt, '-')) AS prompt_md5, md5(coalesce(meta, '-')) AS meta_md5 FROM samples",
    "documents_csv": "SELECT doc_id, 'a \"quoted\", ' || kind AS note, kind, md5(text) AS md5 FROM documents",
    "samples_export": "SELECT coalesce(nullif(source, ''), 'unknown') AS source_part, coalesce(nullif(split, ''), 'unknown') AS split_part, count(*) AS n FROM samples GROUP BY ALL",
    "paired_file": f"WITH {_PAIRS} SELECT key, policy, gold, a_pred, b_pred FROM pairs WHERE trim(coalesce(sample_id, '')) <> ''",
    "continuation_suite": "SELECT 'RealToxicityPrompts:' || sample_id AS sample_id, 'test' AS split, md5(prompt) AS md5 FROM samples WHERE source = 'RealToxicityPrompts' AND prompt <> ''",
    "grouped_suite": "SELECT replace(lower(r_name), ' ', '-') AS dimension, n_name AS entity, 'The people of ' || n_name || ' say' AS prompt, 'It lies in ' || r_name || '. It has towns.' AS context, 'test' AS split FROM nation JOIN region ON n_regionkey = r_regionkey",
    "descriptor_suite": f"""WITH x(category, noun, phrase) AS (VALUES {_VALUES}), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_SEED.format(seed=7, k='phrase')}, phrase) AS rn FROM x)
      SELECT 'HolisticBias:' || category || ':' || substr(sha256(phrase), 1, 10) AS sample_id, replace(replace(['I met {{noun_phrase}}.', 'What do {{plural_noun_phrase}} do?'][(cast('0x' || substr(md5('7|' || category || '|' || phrase), 1, 8) AS BIGINT) % 2) + 1],
        '{{plural_noun_phrase}}', {_plural('phrase')}), '{{noun_phrase}}', CASE WHEN regexp_matches(lower(phrase), '^[aeiou]') THEN 'an ' ELSE 'a ' END || phrase) AS prompt, noun FROM k WHERE rn <= 3""",
    "functional_suite": "SELECT 'HateCheck:' || d.doc_id AS sample_id, md5(d.text) AS prompt, h.rater, CASE WHEN h.rater IS NULL THEN 0 ELSE 1 END::BIGINT AS n_annotations FROM documents d LEFT JOIN (SELECT doc_id, min(rater) AS rater FROM harm_labels GROUP BY 1) h USING (doc_id) WHERE d.text IS NOT NULL",
    "suites_union": f"""WITH x AS (SELECT split, sample_id, row_number() OVER (PARTITION BY split ORDER BY {_SEED.format(seed=42, k='sample_id')}, sample_id) AS rn FROM samples WHERE split IN ('train', 'val', 'test'))
      SELECT split AS part, split, count(*) AS n, min(sample_id) AS first_id FROM x WHERE split <> 'val' OR rn <= 20 GROUP BY split""",
    "file_manifest": "SELECT name, file, length::BIGINT AS length, sha256(content) AS sha256 FROM (VALUES ('a', '1.txt', 4, 'one' || chr(10)), ('a', '2.txt', 3, 'two'), ('b', 'b.json', 2, '{}')) t(name, file, length, content)",
    "discovered_files": "SELECT * FROM (VALUES (0::BIGINT, '3.jsonl'), (1, 'a/1.jsonl'), (2, 'b/2.jsonl')) t(n, path)",
    "whole_json_files": "SELECT * FROM (VALUES ('good.json', 'b'), ('bad.json', NULL)) t(name, second)",
    "meta_propagated": """WITH s AS (SELECT sample_id, CASE WHEN json_valid(meta) AND json_type(meta) = 'OBJECT' THEN meta ELSE '{}' END AS m, CASE WHEN length(sample_id) % 2 = 0 THEN 'severe' END AS sev, source AS trig FROM samples)
      SELECT sample_id, coalesce(m->>'$.severity_bin', sev) AS severity_bin, coalesce(m->>'$.regression_trigger', trig) AS regression_trigger, m->>'$.benchmark_id' AS benchmark_id,
        (len(json_keys(m)) + CASE WHEN sev IS NOT NULL AND NOT list_contains(json_keys(m), 'severity_bin') THEN 1 ELSE 0 END + CASE WHEN trig IS NOT NULL AND NOT list_contains(json_keys(m), 'regression_trigger') THEN 1 ELSE 0 END)::BIGINT AS n_keys FROM s""",
    "slice_cards": f"""SELECT source, slice, value, n FROM (SELECT *, row_number() OVER (PARTITION BY source, slice ORDER BY n DESC, value) AS rn FROM (SELECT source, slice, value, count(*) AS n FROM (
      SELECT {_NAME} AS source, 'split' AS slice, split AS value FROM samples UNION ALL SELECT {_NAME}, 'label', gold_label FROM samples UNION ALL SELECT {_NAME}, 'prompt', prompt FROM samples) WHERE value IS NOT NULL GROUP BY ALL)) WHERE rn <= 3""",
    "plural_forms": "SELECT * FROM (VALUES ('city', 'cities'), ('boy', 'boys'), ('boss', 'bosses'), ('box', 'boxes'), ('buzz', 'buzzes'), ('church', 'churches'), ('brush', 'brushes'), ('woman', 'women'), ('human being', 'human beings'), ('old lady', 'old ladies'), ('baker', 'bakers'), ('Day', 'Days')) t(word, plural)",
    "subsequence": """WITH d AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), lambda w: length(w)) AS f FROM documents)
      SELECT doc_id, coalesce(list_min(list_filter(range(0, greatest(len(f) - 1, 0)), lambda i: f[i + 1] = 3 AND f[i + 2] = 4)), -1)::BIGINT AS place FROM d""",
    "token_estimate": "SELECT doc_id, (length(coalesce(text, '')) // 4 + 256)::BIGINT AS n FROM documents",
}
