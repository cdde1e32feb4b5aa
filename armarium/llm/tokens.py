"""Problem 1: token budget per source and language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pieces import PieceTokenizer, load_pieces
from .texts import Memo, arrow_map, is_latin, keyed, words

def token_counts(df: DataFrame, pieces: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_words, n_bytes, latin): exact counts of every row that has a key and a text.

    The tokenizer is built once per worker and each distinct word is cut once; a batch is then a
    sum of look-ups. An empty text has one token, its end. Repeated rows give repeated results.
    """
    ids = df.sparkSession.sparkContext.broadcast(load_pieces(pieces))
    state: dict = {}

    def per_batch(batch):
        if "memo" not in state:
            cut = PieceTokenizer(ids.value)
            state["memo"] = Memo(lambda w: len(cut.word(w)))
        memo, out = state["memo"], {"n_tokens": [], "n_words": [], "n_bytes": [], "latin": []}
        get = memo.__getitem__
        for t in batch.column("text").to_pylist():
            ws = words(t)
            out["n_tokens"].append(sum(map(get, ws)) + 1)
            out["n_words"].append(len(ws))
            out["n_bytes"].append(len(t) if t.isascii() else len(t.encode()))
            out["latin"].append(is_latin(ws))
        return {"key": batch.column("key"), **out}

    kind = dict(df.dtypes)[key]
    return arrow_map(keyed(df, key, text), f"key {kind}, n_tokens bigint, n_words bigint, n_bytes bigint, latin boolean", per_batch)


def source_of(path):
    """The top folder of a path, whatever its separator; null if there is none."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.when(p.contains("/"), F.split_part(p, F.lit("/"), F.lit(1)))


def token_budget(counts: DataFrame, slices: DataFrame, dims: list[str]) -> DataFrame:
    """Cube of documents, words, tokens and bytes over dims.

    counts: of token_counts, repeated rows of a key count once. slices: one row per key with dims;
    a null in a dim becomes 'unknown', so that a null in the result always means "all".
    """
    one = counts.dropDuplicates(["key"])
    labels = slices.select("key", *[F.coalesce(F.col(d), F.lit("unknown")).alias(d) for d in dims if d != "language"]).dropDuplicates(["key"])
    joined = one.join(labels, "key", "left").withColumn("language", F.when(F.col("latin"), "latin").otherwise("modern"))
    return joined.cube(*dims).agg(
        F.count("*").alias("docs"),
        F.sum("n_words").alias("words"),
        F.sum("n_tokens").alias("tokens"),
        F.sum("n_bytes").alias("bytes"),
    )
