"""Sources and sinks: text trees, manifests, ledgers, token tables and reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The ledger's columns; readers fill in what a file lacks.
LEDGER = """doc_id bigint, path string, work_id string, author_hint string, is_scan_page boolean, chars bigint, bytes bigint,
    content_sha1 string, tier int, had_replacement_char boolean, had_zero_width boolean, had_editorial_codes boolean,
    author string, era string, genre string, form string, source_type string, ocr_quality double, non_latin_per_1k double,
    fragment_score double, work_group string, split string, token_offset bigint, tokens bigint, weight double"""
DEFAULTS = {"ocr_quality": 1.0, "non_latin_per_1k": 0.0, "tier": 1, "era": "unknown", "genre": "unknown"}


def text_tree(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(path, name, raw): every text file under root but copies, decoded leniently; path is relative to root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/") + "/"
    # readers may write file:///x for file:/x
    at = F.regexp_replace("path", "^(\\w+):/+", "$1:/")
    below = F.substring(at, len(re.sub(r"^(\w+):/+", r"\1:/", top)) + 1, 1 << 30)
    named = files.select(below.alias("path"), T.base_name(F.col("path")).alias("name"), T.decode(F.col("content")).alias("raw"))
    return named.where(~T.is_copy(F.col("name")))


def manifest(spark: SparkSession, path: str | None) -> DataFrame:
    """(original, tier) of a JSON manifest {"files": [...]}; none if there is no file."""
    schema = "files array<struct<original: string, tier: int>>"
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], "original string, tier int")
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("files").alias("f")).select("f.original", "f.tier")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A ledger in JSON lines or parquet; with a split its placed records, of which there must be some."""
    read = spark.read.schema(LEDGER).json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    read = read.fillna({k: v for k, v in DEFAULTS.items() if k in read.columns})
    if split is None:
        return read
    some = read.where((F.col("split") == split) & F.col("token_offset").isNotNull())
    if some.isEmpty():
        raise ValueError(f"no records of split {split!r} in {path}")
    return some


def write_ledger(df: DataFrame, path: str, json: bool = False) -> None:
    """Columns that begin with an underscore stay out. A ledger is never written over one that is being read: give a new path."""
    kept = df.drop(*[c for c in df.columns if c.startswith("_")])
    kept.write.mode("errorifexists").json(path) if json else kept.write.mode("errorifexists").parquet(path)


def write_tokens(df: DataFrame, path: str) -> None:
    """(doc_id, split, ids) as a table partitioned by split and sorted by record."""
    df.repartitionByRange("split", "doc_id").sortWithinPartitions("split", "doc_id").write.partitionBy("split").mode("errorifexists").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("errorifexists").json(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_tokens(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The token stream of a split as write_tokens left it; a missing table or an empty split is an error."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no tokens at {path}")
    some = spark.read.parquet(path).where(F.col("split") == split)
    if some.isEmpty():
        raise ValueError(f"no tokens of split {split!r} in {path}")
    return some


def rewrite_ledger(spark: SparkSession, path: str, change) -> None:
    """Replace a parquet ledger by change(ledger): written beside it, then swapped by renaming, so that a reader finds one or the other."""
    new, old = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(new)
    (p, fs), (n, _), (o, _) = _fs(spark, path), _fs(spark, new), _fs(spark, old)
    fs.delete(o, True)
    if not (fs.rename(p, o) and fs.rename(n, p)):
        raise OSError(f"{path} could not be swapped")
    fs.delete(o, True)


def prompts(spark: SparkSession, specs: list[str]) -> DataFrame:
    """(i, prompt): literal texts, FILE:path read whole, and empty ones, from which a tokenizer makes its end alone."""
    rows = []
    for i, s in enumerate(specs):
        if s.startswith("FILE:"):
            found = spark.read.text(s[5:], wholetext=True).first()
            s = found[0] if found else ""
        rows.append((i, s))
    return spark.createDataFrame(rows, "i int, prompt string")


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """One JSON object: sizes, special ids, where the tokenizer lies."""
    p, fs = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(meta, ensure_ascii=False, sort_keys=True).encode()))
    out.close()


def read_meta(spark: SparkSession, path: str) -> dict:
    if not _exists(spark, path):
        raise FileNotFoundError(f"no metadata at {path}")
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def special_ids(meta: dict) -> dict[str, int]:
    """Recorded ids of the end and of padding; 0 and 1 where none are recorded."""
    found = meta.get("special_tokens")
    return found if isinstance(found, dict) and "eos" in found else {"eos": 0, "pad": 1}


def tokenizer_path(spark: SparkSession, meta: dict, meta_path: str, default_dir: str, name: str = "tokenizer.json") -> str:
    """The first that exists: the recorded path, taken from the metadata's folder if relative; its file name, then `name`, in the default folder."""
    raw = (meta.get("tokenizer_config") or {}).get("file")
    tried = []
    if raw:
        tried.append(raw if raw.startswith("/") or ":" in raw else f"{meta_path.rsplit('/', 1)[0]}/{raw}")
        tried.append(f"{default_dir.rstrip('/')}/{raw.rsplit('/', 1)[-1]}")
    tried.append(f"{default_dir.rstrip('/')}/{name}")
    for p in tried:
        if _exists(spark, p):
            return p
    raise FileNotFoundError("no tokenizer at " + ", ".join(tried))
