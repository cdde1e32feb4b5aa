"""Texts to token ids and back, token streams, windows of them and count models over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import arrow_map, materialize, small
from .corpus import running_sum

UNK, EOS, START = "<unk>", "<eos>", "▁"
#: Ids of the end and of padding where a tokenizer records none.
EOS_ID, PAD_ID = 0, 1
#: Positions of a stream that one bucket of the interval join holds.
BUCKET = 4096


def words(text: str) -> list[str]:
    """Maximal runs of characters other than blank, tab and line feed."""
    return [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]


class PieceTokenizer:
    """Greedy longest match of listed pieces over words prefixed with a start mark.

    A character at which no listed piece matches is one <unk>; a text ends with one <eos>.
    <unk> and <eos> themselves never match text.
    """

    def __init__(self, ids: dict[str, int]):
        self.ids = {p: i for p, i in ids.items() if p and p not in (UNK, EOS)}
        self.unk, self.eos = ids.get(UNK, PAD_ID), ids.get(EOS, EOS_ID)
        self.pieces = {i: p for p, i in self.ids.items()} | {self.unk: UNK}
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            lengths.setdefault(p[0], set()).add(len(p))
        self.lengths = {c: sorted(ns, reverse=True) for c, ns in lengths.items()}

    def word(self, w: str) -> list[int]:
        w, i, out = START + w, 0, []
        while i < len(w):
            for n in self.lengths.get(w[i], ()):
                found = self.ids.get(w[i : i + n]) if i + n <= len(w) else None
                if found is not None:
                    out.append(found)
                    i += n
                    break
            else:
                out.append(self.unk)
                i += 1
        return out

    def encode(self, text: str) -> list[int]:
        return [t for w in words(text) for t in self.word(w)] + [self.eos]

    def decode(self, ids: list[int]) -> str:
        """The text with one blank between words, up to the end; what is unknown stays <unk>."""
        ids = ids[: ids.index(self.eos)] if self.eos in ids else ids
        return "".join(self.pieces.get(i, UNK) for i in ids).replace(START, " ").strip(" ")


class FileTokenizer:
    """A tokenizer file of the `tokenizers` library; the end is its recorded id, else EOS_ID."""

    def __init__(self, path: str, eos: int | None = None):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.eos = EOS_ID if eos is None else eos

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [x.ids + [self.eos] for x in self.own.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(ids[: ids.index(self.eos)] if self.eos in ids else ids, skip_special_tokens=False)


def load_pieces(pieces: DataFrame) -> dict[str, int]:
    """The tokenizer's pieces, which every worker holds; of a piece listed twice the largest id."""
    return {r.piece: r.token_id for r in pieces.where("piece is not null and token_id is not null").groupBy("piece").agg(F.max("token_id").alias("token_id")).collect()}


def _per_worker(spark, make: Callable):
    """make() once in each worker."""
    state: dict = {}

    def get():
        if "made" not in state:
            state["made"] = make()
        return state["made"]

    return get


def encode(df: DataFrame, pieces: DataFrame | None = None, path: str | None = None, eos: int | None = None, key: str = "doc_id", text: str = "_text") -> DataFrame:
    """(key, ids): token ids of every row with key and text, the end included; by listed pieces or a tokenizer file.

    The tokenizer is made once a worker; of listed pieces each distinct word is cut once. An empty text has
    one id, its end. Repeated rows give repeated results; null keys and texts give none.
    """
    spark = df.sparkSession
    if path is None:
        held = spark.sparkContext.broadcast(load_pieces(pieces))
        get = _per_worker(spark, lambda: (PieceTokenizer(held.value), {}))

        def cut(texts):
            tokenizer, memo = get()
            out = []
            for t in texts:
                ids: list[int] = []
                for w in words(t):
                    found = memo.get(w)
                    if found is None:
                        if len(memo) >= 1_000_000:
                            memo.clear()
                        found = memo[w] = tokenizer.word(w)
                    ids += found
                ids.append(tokenizer.eos)
                out.append(ids)
            return out
    else:
        get = _per_worker(spark, lambda: FileTokenizer(path, eos))

        def cut(texts):
            return get().encode_all(texts)

    base = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    return arrow_map(base, f"key {dict(df.dtypes)[key]}, ids array<int>", lambda b: {"key": b.column("key"), "ids": cut(b.column("text").to_pylist())})


def decode(df: DataFrame, pieces: DataFrame | None = None, path: str | None = None, eos: int | None = None) -> DataFrame:
    """(key, text) of (key, ids), up to the end of each; null ids give null texts."""
    spark = df.sparkSession
    if path is None:
        held = spark.sparkContext.broadcast(load_pieces(pieces))
        get = _per_worker(spark, lambda: PieceTokenizer(held.value))
    else:
        get = _per_worker(spark, lambda: FileTokenizer(path, eos))
    per_batch = lambda b: {"key": b.column("key"), "text": [None if x is None else get().decode(x) for x in b.column("ids").to_pylist()]}
    return arrow_map(df.select("key", "ids"), f"key {dict(df.dtypes)['key']}, text string", per_batch)


def stream(encoded: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, doc_id, token_offset, tokens, ids): texts end to end in each split, by record.

    encoded: (key, ids), splits: (doc_id, split), one row a record.
    """
    docs = encoded.join(splits, encoded["key"] == splits["doc_id"]).select("split", "doc_id", F.size("ids").cast("bigint").alias("tokens"), "ids").where("split is not null")
    placed = materialize(docs)
    offsets = running_sum(placed.select("split", "doc_id", "tokens"), ["doc_id"], "tokens", "token_offset", ["split"])
    return placed.join(offsets.select("split", "doc_id", F.col("token_offset").cast("bigint").alias("token_offset")), ["split", "doc_id"]).select("split", "doc_id", "token_offset", "tokens", "ids")


def windows(tokens: DataFrame, places: DataFrame, block: int) -> DataFrame:
    """(split, i, start, ids): the block + 1 tokens from each place of a stream on, across records if need be.

    tokens: (split, token_offset, ids), places: (split, i, start). An interval join: both sides are cut by
    buckets of BUCKET positions, so no record meets places far from it. Places that reach over the end give nothing.
    """
    n = F.lit(block + 1)

    def cut(df, begin, end):
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(begin / BUCKET), F.floor((end - 1) / BUCKET))))

    a = cut(tokens.select("split", F.col("token_offset").alias("b"), "ids").where("size(ids) > 0"), F.col("b"), F.col("b") + F.size("ids"))
    first = F.greatest(F.col("b"), F.col("bucket") * BUCKET)
    a = a.select("split", "bucket", first.alias("b"), F.slice("ids", (first - F.col("b") + 1).cast("int"), F.lit(BUCKET) - F.pmod(first, F.lit(BUCKET)).cast("int")).alias("ids"))
    p = cut(places.select("split", "i", "start").where("start >= 0"), F.col("start"), F.col("start") + n)
    begin = F.greatest(F.col("b"), F.col("start"))
    end = F.least(F.col("b") + F.size("ids"), F.col("start") + n)
    parts = a.join(p, ["split", "bucket"]).where(begin < end).select("split", "i", "start", F.struct(begin.alias("b"), F.slice("ids", (begin - F.col("b") + 1).cast("int"), (end - begin).cast("int")).alias("ids")).alias("part"))
    whole = parts.groupBy("split", "i", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["ids"])).alias("ids"))
    return whole.where(F.size("ids") == n)


def shifted(ids: Column) -> tuple[Column, Column]:
    """(inputs, targets): all but the last token, and all but the first."""
    n = F.size(ids) - 1
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def pairs(tokens: DataFrame, *keys: str, ids: str = "ids") -> DataFrame:
    """(keys, pos, a, b): every token b with the one before it, a."""
    x, y = shifted(F.col(ids))
    return tokens.where(F.size(ids) > 1).select(*keys, F.posexplode(F.arrays_zip(x.alias("a"), y.alias("b"))).alias("pos", "t")).select(*keys, "pos", "t.a", "t.b")


class CountModel:
    """Smoothed counts of single tokens, and of pairs if `order` is 2: log-probabilities of targets after their inputs.

    A scorer is whatever has nll(pairs) -> pairs with nll; this one stands in for the network. One more token than
    was seen shares a count of one; pairs weigh `mix`, single tokens the rest.
    """

    def __init__(self, train: DataFrame, order: int = 1, mix: float = 0.5):
        self.order, self.mix = order, mix
        single = train.select(F.explode("ids").alias("b")).groupBy("b").agg(F.count("*").alias("n"))
        self.single = materialize(single)
        self.sums = self.single.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count("*").alias("v"))
        if order == 2:
            self.double = materialize(pairs(train).groupBy("a", "b").agg(F.count("*").alias("nab")))
            self.after = self.double.groupBy("a").agg(F.sum("nab").alias("na"))

    def nll(self, df: DataFrame) -> DataFrame:
        p = (F.coalesce("n", F.lit(0)) + 1) / (F.col("t") + F.col("v") + 1)
        out = df.join(small(self.single), "b", "left").crossJoin(F.broadcast(self.sums))
        if self.order == 2:
            out = out.join(self.double, ["a", "b"], "left").join(self.after, "a", "left")
            p = F.when(F.col("na") > 0, self.mix * F.coalesce("nab", F.lit(0)) / F.col("na") + (1 - self.mix) * p).otherwise(p)
        return out.select(*df.columns, (-F.log(p)).alias("nll"))


def batches(scored: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, batch, ce): means of nll over whole batches of `size` windows in order of i; a remainder is left out.

    scored: (by, i, nll), one row a token. Windows are few, those that were drawn.
    """
    each = scored.groupBy(*by, "i").agg(F.sum("nll").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = each.withColumn("r", F.row_number().over(w.orderBy("i")) - 1).withColumn("m", F.floor(F.count("*").over(w) / size) * size).where("r < m")
    return ranked.groupBy(*by, F.floor(F.col("r") / size).alias("batch")).agg((F.sum("s") / F.sum("n")).alias("ce"))
