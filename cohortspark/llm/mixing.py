"""Mixing sources to target shares of the tokens, with bounded repetition.

Every document is counted in tokens of a public tokenizer. The token totals of the cells (source, language, topic) are raked by
iterative proportional fitting: to the target shares of the sources, and to the corpus's own shares of languages and topics, so
that these move no more than the sources demand. A cell's weight, the expected number of copies of each of its documents, is the
product of a factor of its source, its language and its topic, and no more than its source's cap. Each step is an aggregate
over the table of cells; the driver holds the factors, one number per source, language and topic.

Documents are drawn systematically: within a cell they stand in the order of a hash, and every part of the cell's tokens gives
its share. Each source takes documents in this order up to its target, and the one document that fills best what is left open.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.plans.shared import checked_broadcast, ship, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's authors cut text before merging bytes; fixed, as the vocabulary was made with it.
TOKEN_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "topic")
#: Cells for each task of a raking step; parts of a cell's order, and of a source's, that windows run in.
CELLS_PER_TASK, ORDER_PARTS, RANK_BINS = 100_000, 256, 4_000
_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """`documents` (any columns, with text) with n_tokens instead of text; null and empty texts have none.

    `tokenizer` is a byte-pair vocabulary as ranks, a file that the driver can read; executors get it from there.
    """
    spark, name = documents.sparkSession, tokenizer.rsplit("/", 1)[-1]
    ship(spark)
    if name not in getattr(spark.sparkContext, "_cohortspark_files", set()):
        spark.sparkContext.addFile(tokenizer)
        spark.sparkContext._cohortspark_files = getattr(spark.sparkContext, "_cohortspark_files", set()) | {name}

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(SparkFiles.get(name))
        for texts in batches:
            yield pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    counted = F.pandas_udf(count, T.LongType())
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("text", "n_tokens")]
    return documents.select(*others, F.coalesce(counted("text"), F.lit(0)).alias("n_tokens"))


def reachable_totals(tokens: dict[str, float], shares: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that each source gives to the mix.

    Without `total` the largest mix in which every source that has tokens reaches its share exactly. With it, sources whose
    cap is below their share give all they may, and the others share the rest in proportion.
    """
    have = {s: tokens.get(s, 0.0) * repeats[s] for s in shares}
    open_ = [s for s in shares if have[s] > 0 and shares[s] > 0]
    if not open_:
        return {s: 0.0 for s in shares}
    if total is None:
        whole = sum(shares[s] for s in open_)
        size = min(have[s] * whole / shares[s] for s in open_)
        return {s: size * shares[s] / whole if s in open_ else 0.0 for s in shares}
    given = {s: 0.0 for s in shares}
    rest = total
    while open_:
        whole = sum(shares[s] for s in open_)
        full = [s for s in open_ if rest * shares[s] / whole >= have[s]]
        if not full:
            given |= {s: rest * shares[s] / whole for s in open_}
            break
        for s in full:
            given[s] = have[s]
        rest -= sum(have[s] for s in full)
        open_ = [s for s in open_ if s not in full]
        if rest <= 0:
            break
    return given


@dataclass
class Raked:
    """Factors of the margins' values; a cell's weight is their product, within its source's cap."""

    values: dict[str, list]
    factors: dict[str, np.ndarray]
    caps: np.ndarray
    rounds: int = 0

    def weight(self) -> Column:
        """Copies per document of a cell, whose columns `<margin>_at` number the margins' values.

        The factors go in as one text each, which Spark reads once: a literal per factor would be slow for many topics.
        """

        def at(numbers: np.ndarray, m: str) -> Column:
            if not len(numbers):  # no cells
                return F.lit(None).cast("double")
            return F.get(F.split(F.lit(",".join(repr(float(x)) for x in numbers)), ",").cast("array<double>"), F.col(f"{m}_at"))

        product = reduce(lambda x, y: x * y, [at(self.factors[m], m) for m in KEYS])
        return F.least(product, at(self.caps, "source"))


def rake(cells: DataFrame, given: dict[str, float], repeats: dict[str, int], rounds: int = 40, tolerance: float = 1e-3) -> tuple[DataFrame, Raked]:
    """(`cells` with `weight`, factors): copies per document of each cell (source, lang, topic, tokens).

    Iterative proportional fitting, one aggregate over the cells per step: languages and topics to their shares in the corpus,
    then sources to their totals in `given`. Ends when no factor moves by more than `tolerance` of itself, or after `rounds`;
    the sources' totals are then brought to within a millionth.
    """
    spark = cells.sparkSession
    names = {m: [r[0] for r in cells.select(m).distinct().orderBy(m).collect()] for m in KEYS}  # the margins' values
    coded = cells
    for m in KEYS:
        numbers = spark.createDataFrame(list(enumerate(names[m])), T.StructType([T.StructField(f"{m}_at", T.IntegerType()), T.StructField("_v", T.StringType())]))
        coded = coded.join(checked_broadcast(numbers), F.col(m).eqNullSafe(F.col("_v"))).drop("_v")
    coded = written(coded, "mix-cells")
    coded = coded.coalesce(max(1, coded.count() // CELLS_PER_TASK))
    raked = Raked(names, {m: np.ones(len(names[m])) for m in KEYS}, np.array([float(repeats[s]) for s in names["source"]]))

    def totals(m: str, weight: Column) -> np.ndarray:
        found = coded.groupBy(f"{m}_at").agg(F.sum(F.col("tokens") * weight).alias("x")).collect()
        out = np.zeros(len(names[m]))
        for r in found:
            out[r[0]] = r[1]
        return out

    def step(m: str) -> float:
        now = totals(m, raked.weight())
        ratio = np.where(targets[m] > 0, np.divide(targets[m], now, out=np.ones_like(now), where=now > 0), 0.0)
        raked.factors[m] = np.clip(raked.factors[m] * ratio, 0.0, 1e12)
        if m == "source":  # a source that must give all has its cap everywhere
            raked.factors[m][full], ratio[full] = 1e12, 1.0
        return float(np.abs(ratio[targets[m] > 0] - 1).max(initial=0.0))

    targets = {m: totals(m, F.lit(1.0)) for m in KEYS[1:]} | {"source": np.array([given[s] for s in names["source"]])}
    full = targets["source"] >= totals("source", F.lit(1.0)) * raked.caps * (1 - 1e-9)
    scale = sum(given.values()) / max(1.0, targets["lang"].sum())
    targets |= {m: targets[m] * scale for m in KEYS[1:]}
    last = np.inf
    for raked.rounds in range(1, rounds + 1):
        moved = max(step("lang"), step("topic"), step("source"))
        if moved < tolerance or abs(last - moved) < max(tolerance, moved) / 100:  # margins that can't all be met settle with the same residue
            break
        last = moved
    for _ in range(rounds):
        if step("source") < 1e-6:
            break
    return coded.withColumn("weight", F.round(raked.weight(), 12)), raked


@dataclass
class Mix:
    """A mix as it is planned; `documents` draws it."""

    counted: DataFrame
    cells: DataFrame
    targets: DataFrame
    given: dict[str, float]
    repeats: dict[str, int]
    seed: int

    def documents(self) -> DataFrame:
        """(doc_id, source, lang, topic, n_tokens, copies): the documents of the mix with how often each occurs."""
        cell = [F.coalesce(F.col(k), F.lit("\0")).alias(k) for k in KEYS]
        named = lambda df: df.withColumns({k: F.coalesce(F.col(k), F.lit("\0")) for k in KEYS})
        h = F.xxhash64(F.lit(self.seed), "doc_id")
        docs = named(self.counted).withColumns({"h": h, "part": F.shiftrightunsigned(h, 64 - ORDER_PARTS.bit_length() + 1)})
        held = docs.groupBy(*KEYS, "part").agg(F.sum("n_tokens").alias("held"))
        of_cell = Window.partitionBy(*KEYS)  # ORDER_PARTS rows per cell at most
        parts = held.select(*KEYS, "part", (F.sum("held").over(of_cell.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(of_cell).alias("cell_tokens"))
        weights = self.cells.select(*cell, "weight")
        parts = parts.join(checked_broadcast(weights), list(KEYS))
        own = Window.partitionBy(*KEYS, "part").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
        middle = F.col("before") + F.sum("n_tokens").over(own) - F.col("n_tokens") / 2
        phase = F.pmod(F.xxhash64(F.lit(self.seed), *KEYS), F.lit(1_000_003)) / 1_000_003
        spot = middle / F.col("cell_tokens") + phase
        placed = docs.join(parts, [*KEYS, "part"]).withColumn("u", spot - F.floor(spot))
        chance = F.col("weight") - F.floor("weight")
        placed = placed.select("doc_id", *KEYS, "n_tokens", "h", F.floor("weight").alias("sure"), F.when(chance > 0, F.col("u") / chance).alias("rank"))
        placed = written(placed.withColumn("bin", F.least(F.floor(F.col("rank") * RANK_BINS / 2), F.lit(RANK_BINS))), "mix-places")

        lack = {s: F.lit(float(x)) for s, x in self.given.items()}
        goal = reduce(lambda rest, s: F.when(F.col("source") == s, lack[s]).otherwise(rest), lack, F.lit(0.0))
        bins = placed.groupBy("source", "bin").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("n_tokens"))).alias("tokens"), F.sum(F.col("n_tokens") * F.col("sure")).alias("sure_tokens"))
        of_source = Window.partitionBy("source")  # RANK_BINS + 2 rows per source at most
        open_ = goal - F.sum("sure_tokens").over(of_source)
        upto = F.coalesce(F.sum("tokens").over(of_source.orderBy(F.col("bin").asc_nulls_first())) - F.col("tokens"), F.lit(0))
        bins = bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), open_.alias("open"), (open_ - upto).alias("room")).where("b is not null")
        within = Window.partitionBy("source", "bin").orderBy("rank", "h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
        running = placed.withColumn("running", F.sum("n_tokens").over(within))  # tells a bin's rows apart
        drawn = running.join(checked_broadcast(bins), (F.col("source") == F.col("s")) & (F.col("bin") == F.col("b")), "left").drop("s", "b")
        drawn = written(drawn.withColumn("extra", F.coalesce((F.col("bin").isNotNull()) & (F.col("running") <= F.col("room")), F.lit(False))), "mix-drawn")
        # what is still open of each source goes to the one document that fills it best
        left = drawn.groupBy("source").agg((F.max("open") - F.sum(F.when(F.col("extra"), F.col("n_tokens")).otherwise(0))).alias("left")).where("left > 0")
        fits = drawn.where(~F.col("extra") & F.col("bin").isNotNull()).join(checked_broadcast(left), "source").withColumn("off", F.abs(F.col("left") - F.col("n_tokens"))).where("off < left")
        last = fits.groupBy("source").agg(F.min(F.struct("off", "bin", "running")).alias("l")).select(F.col("source").alias("s"), F.col("l.bin").alias("b"), F.col("l.running").alias("r"))
        drawn = drawn.join(checked_broadcast(last), (F.col("source") == F.col("s")) & (F.col("bin") == F.col("b")) & (F.col("running") == F.col("r")), "left")
        extra = F.col("extra") | F.col("r").isNotNull()
        most = reduce(lambda rest, s: F.when(F.col("source") == s, F.lit(self.repeats[s])).otherwise(rest), self.repeats, F.lit(0))
        copies = F.least(F.col("sure") + F.when(extra, 1).otherwise(0), most).cast("int")
        plain = [F.when(F.col(k) != "\0", F.col(k)).alias(k) for k in KEYS]
        return drawn.select("doc_id", *plain, "n_tokens", copies.alias("copies")).where("copies > 0")

    def shares(self, drawn: DataFrame, tolerance: float = 0.005) -> DataFrame:
        """Per source of the targets: target_share, goal_share, reached_share, n_tokens, n_documents, most_copies, max_repeats,
        reached, met, binds.

        goal_share is the target share among the sources that have tokens. `reached` and `met` tell whether the mix came
        within `tolerance` of target and goal; `binds` that the mix can't be larger because this source is used up.
        """
        got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
        have = self.cells.groupBy("source").agg(F.sum("tokens").alias("corpus_tokens"))
        goal = _goals(self.targets)
        per = goal.join(got, "source", "left").join(have, "source", "left")
        every = Window.partitionBy()  # one row per source of the targets
        share = F.coalesce(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(every)), F.lit(0.0))
        present = F.when(F.col("corpus_tokens") > 0, F.col("target_share")).otherwise(0.0)
        goal_share = F.coalesce(F.try_divide(present, F.sum(present).over(every)), F.lit(0.0))
        room = F.try_divide(F.col("corpus_tokens") * F.col("max_repeats"), present)
        return per.select(
            "source", "target_share", goal_share.alias("goal_share"), share.alias("reached_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
            (F.abs(share - F.col("target_share")) <= tolerance).alias("reached"), (F.abs(share - goal_share) <= tolerance).alias("met"),
            F.coalesce(room <= F.min(room).over(every), F.lit(False)).alias("binds"),
        )

    def margins(self, drawn: DataFrame) -> DataFrame:
        """(margin, value, corpus_share, planned_share, mix_share) of every source, language and topic: shares of tokens."""
        planned = self.cells.select(*KEYS, F.col("tokens").alias("corpus"), (F.col("tokens") * F.col("weight")).alias("planned"), F.lit(0.0).alias("mix"))
        mixed = drawn.groupBy(*KEYS).agg(F.sum(F.col("n_tokens") * F.col("copies")).cast("double").alias("mix"))
        both = planned.unionByName(mixed.select(*KEYS, F.lit(0).cast("bigint").alias("corpus"), F.lit(0.0).alias("planned"), "mix"))
        each = F.array(*[F.struct(F.lit(k).alias("margin"), F.col(k).alias("value")) for k in KEYS])
        per = both.select(F.inline(each), "corpus", "planned", "mix").groupBy("margin", "value").agg(*[F.sum(c).alias(c) for c in ("corpus", "planned", "mix")])
        whole = Window.partitionBy("margin")
        return per.select("margin", "value", *[F.try_divide(F.col(c), F.sum(c).over(whole)).alias(f"{c}_share") for c in ("corpus", "planned", "mix")])


def _goals(targets: DataFrame) -> DataFrame:
    return targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def plan_mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None, seed: int = 42) -> Mix:
    """The mix of `documents` (doc_id, text, source, lang, topic) to `targets` (source, target_share, max_repeats).

    Documents of other or unknown sources and documents without tokens aren't in the mix; repeated rows are records of their
    own; extra columns are ignored; null languages and topics are groups of their own; languages are their first two letters.
    Targets repeated for a source count once, those without a source, share or repeats not at all. See `reachable_totals`
    for targets that can't all be met. The documents are tokenized once and their texts are never shuffled.
    """
    goal = _goals(targets).collect()
    shares, repeats = {r["source"]: float(r["target_share"]) for r in goal}, {r["source"]: int(r["max_repeats"]) for r in goal}
    lang = F.nullif(F.regexp_extract(F.lower("lang"), "^[a-z]{2}", 0), F.lit(""))
    narrow = documents.where(F.col("source").isin(list(shares))).select("doc_id", "source", lang.alias("lang"), F.col("topic").cast("string").alias("topic"), "text")
    counted = written(token_counts(narrow, tokenizer).where("n_tokens > 0"), "token-counts")
    cells = counted.groupBy(*KEYS).agg(F.sum("n_tokens").alias("tokens"))
    have = {r["source"]: float(r["n"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    given = reachable_totals(have, shares, repeats, total_tokens)
    weighted, _ = rake(cells, given, repeats)
    return Mix(counted, weighted, targets, given, repeats, seed)


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix, each with how often it occurs (1 to max_repeats)."""
    return plan_mix(documents, targets, tokenizer, total_tokens, seed).documents().select("doc_id", "source", "n_tokens", "copies")
