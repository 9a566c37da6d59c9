"""Sources and sinks: lines of JSON, folders of JSON, verdict files, YAML, taxonomies; CSV, upsert, tasks, manifests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import fixed4
from .files import write_files


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, bad: bool = False) -> DataFrame:
    """Lines of JSON with a fixed schema; blank lines are skipped, and a missing path is an empty table.

    ``row_no`` follows the files' names and the lines in a file, however files are split and spread. A line that is no JSON
    of the schema raises if ``strict``; else it is left out, and with ``bad`` such lines alone (``line``) are what is read.
    """
    if not exists(spark, path):
        empty = spark.createDataFrame([], "line string" if bad else schema)
        return empty.withColumn("row_no", F.lit(0).cast("long"))
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    if bad:
        rows = _numbered(spark.read.text(path)).where(F.trim("value") != "")
        read = F.from_json("value", f"{schema}, _bad STRING", options)
        return rows.withColumn("_read", read).where("_read._bad is not null").select(F.col("value").alias("line"), "row_no")
    df = _numbered(spark.read.schema(schema if strict else f"{schema}, _bad STRING").options(**options).json(path))
    return df if strict else df.where("_bad is null").drop("_bad")


def _numbered(df: DataFrame) -> DataFrame:
    """Lines read from files with ``row_no``, in the order of the files' names and of the lines in a file."""
    columns = df.columns
    df = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.file_block_start")).withColumn("_id", F.monotonically_increasing_id())
    # Splits are few; within one, ids ascend with the lines.
    splits = df.groupBy("_file", "_at").agg(F.min("_id").alias("_first")).withColumn("_no", F.row_number().over(Window.orderBy("_file", "_at")))
    number = F.col("_no").cast("long") * F.lit(1 << 33) + F.col("_id") - F.col("_first")
    return df.join(splits, ["_file", "_at"]).select(*columns, number.alias("row_no"))


def read_json_folder(spark: SparkSession, path: str, schema: str, skip: tuple[str, ...] = ("manifest.json",)) -> DataFrame:
    """One record from each JSON file, with ``stem``, the file's name without its suffix."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema + ", stem STRING")
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("_name", F.col("_metadata.file_name"))
    return df.where(~F.col("_name").isin(list(skip))).withColumn("stem", F.regexp_replace("_name", r"\.json$", "")).drop("_name")


def read_variants(spark: SparkSession, path: str, skip: tuple[str, ...] = ("manifest.json",)) -> DataFrame:
    """(stem, value): the JSON files of a folder, of any shape, as VARIANT; null where a file is no JSON."""
    if not exists(spark, path):
        return spark.createDataFrame([], "stem STRING, value VARIANT")
    df = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).withColumn("_name", F.col("_metadata.file_name"))
    return df.where(~F.col("_name").isin(list(skip))).select(F.regexp_replace("_name", r"\.json$", "").alias("stem"), F.try_parse_json("value").alias("value"))


def read_verdicts(spark: SparkSession, pattern: str, schema: str, need: int = 2) -> list[DataFrame]:
    """The verdict tables of the first ``need`` files by name; raises if there are fewer."""
    files = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("_file", F.col("_metadata.file_name"))
    names = [r["_file"] for r in files.select("_file").distinct().orderBy("_file").limit(need).collect()]
    if len(names) < need:
        raise ValueError(f"{need} verdict files are needed, found {names}")
    return [files.where(F.col("_file") == n).select(F.explode("verdicts").alias("v")).select("v.*") for n in names]


def read_yaml(path: str) -> dict:
    """A YAML document, where the parser is installed; else JSON, which is YAML too."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def repos_config(config: dict) -> list[tuple[str, str]]:
    """(repo, prefix) with the default prefix where a row has none; an empty prefix is one."""
    default = (config.get("defaults") or {}).get("prefix", "")
    return [(r["repo"], default if r.get("prefix") is None else r["prefix"]) for r in config.get("repos", [])]


def rules_from(config: dict):
    """Security rules from sections named ``<category>_rules``."""
    from ..operators.security import RULES, Rule

    known = {r.id: r.prefilters for r in RULES}
    return tuple(Rule(e["id"], section.removesuffix("_rules"), e.get("name", ""), e.get("severity", ""), tuple(e.get("patterns", [])), known.get(e["id"], ()), tuple(e.get("allowed_domains") or ())) for section, entries in config.items() if section.endswith("_rules") for e in entries)


def taxonomy_map(taxonomy: DataFrame) -> DataFrame:
    """(family, family_no, pattern) of a taxonomy."""
    families = taxonomy.select(F.posexplode("families").alias("family_no", "f"))
    return families.select(F.col("f.name").alias("family"), "family_no", F.explode("f.patterns").alias("p")).select("family", "family_no", F.col("p.name").alias("pattern"))


def vocabularies(taxonomy: DataFrame, messages: DataFrame) -> DataFrame:
    """(vocabulary, name) of the closed vocabularies: patterns of a taxonomy, and what and why a message may express.

    ``messages`` has ``what_expression_categories`` and ``why_expression_categories``, each with ``allowed`` (array of label);
    what ``validate.MISSING`` lists says that a message expresses none, and belongs to its vocabulary in any case.
    """
    from ..operators.validate import MISSING

    parts = [taxonomy_map(taxonomy).select(F.lit("patterns").alias("vocabulary"), F.col("pattern").alias("name"))]
    for name, missing in zip(("what", "why"), MISSING):
        labels = F.transform(F.col(f"{name}_expression_categories.allowed"), lambda c: c["label"])
        parts.append(messages.select(F.lit(name).alias("vocabulary"), F.explode(F.array_union(labels, F.array(F.lit(missing)))).alias("name")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def search_query(keyword: str, stars: int, forks: int) -> str:
    """Query text of a repository search."""
    return f"{keyword} stars:>={stars} forks:>={forks}"


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines."""
    df.write.mode("append").json(path)


def rewrite(df: DataFrame, path: str) -> None:
    """Replace a folder: write beside it, set the old one aside, and only then put the new one in its place.

    At any moment the old or the new rows are there, whole: after a crash in between under ``path.old`` or ``path.tmp``, from
    where the next call takes the old ones back.
    """
    spark = df.sparkSession
    p, new, old = (spark._jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".tmp", ".old"))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(p):
            fs.delete(old, True)
        else:
            fs.rename(old, p)
    df.write.mode("overwrite").json(path + ".tmp")
    if fs.exists(p) and not fs.rename(p, old) or not fs.rename(new, p):
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)


def write_per_row(df: DataFrame, path: str, stem: str = "stem") -> int:
    """One pretty JSON file ``<stem>.json`` for each row, beside what ``path`` holds; of rows with equal stems the last text by order stays.

    Tasks write the files, and one commit decides on all of them (``files``). Gives the number of files.
    """
    body = F.to_json(F.struct(*[c for c in df.columns if c != stem]), {"pretty": "true", "ignoreNullFields": "false"})
    return write_files(df.select(F.col(stem).cast("string").alias("stem"), body.alias("value")).groupBy("stem").agg(F.max("value").alias("value")), path)


def write_sample(records: DataFrame, drawn: DataFrame, path: str, about: dict, stem: str = "stem") -> int:
    """Copy the drawn records, one file each, with ``manifest.json`` beside them; returns their number.

    ``about`` is what ``manifest`` wants besides size and files. A drawn sample is as long as people can read.
    """
    copied = records.join(drawn.select(stem), stem, "left_semi")
    write_per_row(copied, path, stem)
    names = sorted(r[stem] for r in copied.select(stem).distinct().collect())  # the manifest lists them
    spark = records.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path, "manifest.json")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(manifest(size=len(names), files=[f"{n}.json" for n in names], **about).encode()))
    out.close()
    return len(names)


def listing(df: DataFrame, n: int = 100) -> None:
    """Print the first rows in full, for a look at what a step found."""
    df.show(n, truncate=False)


def write_csv(df: DataFrame, path: str, decimals: list[str] | None = None, order: list[Column] | None = None) -> None:
    """A result table as one CSV with header; the named numbers, or all of type double, get four decimals."""
    named = decimals if decimals is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    out = df.select(*[fixed4(F.col(c)).alias(c) if c in named else F.col(c) for c in df.columns])
    out = out.coalesce(1)
    (out.sortWithinPartitions(*order) if order else out).write.mode("overwrite").option("header", True).csv(path)


def manifest(population: int, size: int, files: list[str], confidence: float, margin: float, p: float, z: float, seed: int, folder: str) -> str:
    """The description of a drawn sample, as JSON."""
    sizing = {"method": "cochran", "confidence": confidence, "margin_of_error": margin, "p": p, "z": z, "finite_population_correction": True}
    return json.dumps({"population_dir": folder, "population": population, "sample_size": size, "sizing": sizing, "seed": seed, "files": sorted(files)}, indent=2)


def tasks_payload(tasks: DataFrame, key: str, vocabularies: dict[str, list[str]]) -> DataFrame:
    """One row: ``{order, records, vocabs}`` as JSON; an audit's tasks are a bounded sample."""
    task = F.struct(*[c for c in tasks.columns if c != key])
    rows = tasks.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), task.alias("t")))).alias("r"))
    return rows.select(F.to_json(F.struct(F.transform("r", lambda x: x["k"]).alias("order"), F.map_from_entries("r").alias("records"), F.from_json(F.lit(json.dumps(vocabularies)), "map<string,array<string>>").alias("vocabs"))).alias("payload"))
