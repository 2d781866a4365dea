"""Evaluation passages that leak into training text: rare n-gram seeds, then Smith-Waterman alignment.

Items, seeds, their frequencies and the candidates are tables that Spark joins; there is one pass for all items:

1. texts become arrays of letters; every window of a passage is a seed. A bit table of the seeds (of bounded size, the only
   thing sent to all tasks) lets each document's task drop the windows that no passage has; what is left are narrow rows;
2. those rows give each seed's document frequency, and a window over each few neighbouring seeds of a passage keeps the
   rarest that occurs. No frequency is too high: a passage that a third of all documents repeat keeps its rarest seeds;
3. documents that hold enough of a passage's rare seeds are read again, and the parts of their text where the passage can lie
   are spread over all tasks and aligned with it. No whole text is shuffled unless candidates are too many to broadcast; then
   only theirs are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.letters import is_dense, letters, pieces
from cohortspark.plans.shared import checked_broadcast, discard, fits_broadcast, ship, written

#: Letters of a seed, and of one in ideographs and kana.
SEED, DENSE_SEED = 10, 5
#: Of so many neighbouring seeds the rarest is kept, so a clean stretch of SEED + NEIGHBOURS - 1 letters always holds one.
NEIGHBOURS, DENSE_NEIGHBOURS = 4, 2
#: Share of a passage's rare seeds (two at least) from which a document is aligned with it; 0 aligns every document with any.
#: A copy of two fifths of a passage with one word in seven changed keeps about a fifth of them; most chance meetings of texts
#: share one in thirty.
LEAST_SEEDS = 0.06
#: Bits of the seed table for each seed, and the table's bounds (powers of two; 128 MB at most). A fuller table only lets more
#: windows through to the join.
BITS_EACH, LEAST_BITS, MOST_BITS = 512, 20, 30
#: Candidate pairs for each task of the alignment.
PAIRS_PER_TASK = 500
#: Alignment: points of a match, a differing letter, a gap, and for going on after a jump.
MATCH, DIFFER, GAP, JUMP, DENSE_JUMP = 10, -8, 8, 120, 50
#: Share of the passage's best possible score from which a document counts as a case.
LEAST_SCORE = 0.24
#: Cells of the texts that are aligned side by side.
_CELLS = 30_000

_B = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k letters."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    out = wide[:n] + np.uint64(k)
    for j in range(1, k):
        out *= _B
        out += wide[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def _windows(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of the windows that can be seeds, both kinds; none spans two owners."""
    dense = is_dense(codes)
    runs = np.concatenate([[0], np.cumsum(dense)])
    for k in (SEED, DENSE_SEED):
        n = len(codes) - k + 1
        if n <= 0:
            continue
        whole = owner[:n] == owner[k - 1 :]
        if k == DENSE_SEED:
            if not runs[-1]:
                continue
            at = np.flatnonzero(whole & (runs[k:] - runs[:n] == k))
            if len(at):
                near = np.zeros(len(at), np.uint64) + np.uint64(k)
                near += codes[at].astype(np.uint64)
                for j in range(1, k):
                    near *= _B
                    near += codes[at + j].astype(np.uint64)
                near ^= near >> np.uint64(29)
                near *= np.uint64(0xBF58476D1CE4E5B9)
                yield at, near
        else:
            at = np.flatnonzero(whole & ~dense[:n])  # a window that begins densely is looked for by its dense seed
            yield at, _hashes(codes, k)[at]


class Bits:
    """Which of 2 ** bits slots hold a hash; a hash's slot is its head."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.bits)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    @staticmethod
    def of(hashes: DataFrame, column: str, each: int = BITS_EACH) -> Bits:
        """The table of a column of 64-bit hashes; words are put together by Spark, one row per word that isn't empty."""
        n = hashes.count()
        bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, n) * each)))))
        slot = F.shiftrightunsigned(column, 64 - bits)
        found = hashes.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit"))
        found = found.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found["word"].to_numpy(np.int64)] = found["bit"].to_numpy(np.int64).astype(np.uint64)
        return Bits(bits, words)


def alignments(passages: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Best local alignment of pieces of each passage, in its order, with its text: share of the best possible score.

    Smith-Waterman by rows of the passages, all pairs of similar size at once; an alignment may jump ahead in both, for a
    price that only pieces of a sentence or more earn back. Padding matches nothing, so it adds nothing.
    """
    out = np.zeros(len(passages))
    order = sorted(range(len(passages)), key=lambda i: (len(texts[i]), len(passages[i])))
    while order:
        width = len(texts[order[-1]])
        some = order[-max(1, _CELLS // max(1, width)) :]
        del order[-len(some) :]
        out[some] = _aligned([passages[i] for i in some], [texts[i] for i in some], width)
    return out


def _aligned(passages: list[np.ndarray], texts: list[np.ndarray], n: int) -> np.ndarray:
    rows, most = len(passages), max(len(p) for p in passages)
    text, passage = np.full((rows, n), 0xFFFFFFFE, np.uint32), np.full((most, rows, 1), 0xFFFFFFFF, np.uint32)
    for i, (p, t) in enumerate(zip(passages, texts)):
        text[i, : len(t)], passage[: len(p), i, 0] = t, p
    jump = np.array([[DENSE_JUMP if is_dense(p).mean() > 0.5 else JUMP] for p in passages], np.int32)
    steps = np.arange(1, n + 1, dtype=np.int32) * np.int32(GAP)
    row, best = np.zeros((rows, n + 1), np.int32), np.zeros((rows, n + 1), np.int32)  # best: score that ends before this place, in an earlier row
    cell, begin = np.empty((rows, n), np.int32), np.empty((rows, n), np.int32)
    for letter in passage:
        np.subtract(best[:, :-1], jump, out=begin)
        np.maximum(begin, row[:, :-1], out=begin)
        np.maximum(begin, 0, out=begin)
        np.multiply(text == letter, np.int32(MATCH - DIFFER), out=cell)
        cell += begin
        cell += np.int32(DIFFER)
        np.subtract(row[:, 1:], np.int32(GAP), out=begin)
        np.maximum(cell, begin, out=cell)
        cell += steps
        np.maximum.accumulate(cell, axis=1, out=cell)
        cell -= steps
        np.maximum(cell, 0, out=cell)
        row[:, 1:] = cell
        np.maximum.accumulate(cell, axis=1, out=begin)
        np.maximum(best[:, 1:], begin, out=best[:, 1:])
    return best[:, -1] / (MATCH * np.array([len(p) for p in passages], float))


def alignment(passage: np.ndarray, text: np.ndarray) -> float:
    return float(alignments([passage], [text])[0]) if len(text) else 0.0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace").decode("utf-8")


def _passage_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, letters(p)) for i, p in zip(batch.column("item_id").to_pylist(), batch.column("passage").to_pylist())]
        found = [(i, p) for i, p in found if len(p)]
        ids = [int.from_bytes(hashlib.blake2b(p.tobytes(), digest_size=8).digest(), "little", signed=True) for _, p in found]
        columns = [pa.array([i for i, _ in found], pa.int64()), pa.array(ids, pa.int64()), pa.array([_text(p) for _, p in found], pa.string()), pa.array([len(p) for _, p in found], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "passage_id", "letters", "n_letters"])


def _seed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for passage_id, text in zip(batch.column("passage_id").to_pylist(), batch.column("letters").to_pylist()):
            codes = _codes(text)
            near = DENSE_NEIGHBOURS if is_dense(codes).mean() > 0.5 else NEIGHBOURS
            for at, hashes in _windows(codes, np.zeros(len(codes), np.int8)):
                columns = [pa.array(np.full(len(at), passage_id)), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32)), pa.array((at // near).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["passage_id", "seed", "place", "near"])


def _hit_batches(bits, fewest: int):
    """Per document the windows whose seed may be one, with their places; the first of equal ones is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Bits = bits.value
        for batch in (piece for whole in batches for piece in pieces(whole, "text")):
            arrays = [letters(t) for t in batch.column("text").to_pylist()]
            lengths = np.fromiter((len(a) for a in arrays), np.int64, len(arrays))
            codes = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
            owner = np.repeat(np.arange(len(arrays)), lengths)
            starts = np.cumsum(lengths) - lengths
            places, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for at, hashes in _windows(codes, owner):
                hit = table.hold(hashes)
                places.append(at[hit])
                seeds.append(hashes[hit])
            place, seed = np.concatenate(places), np.concatenate(seeds)
            doc = owner[place]
            enough = np.bincount(doc, minlength=len(arrays))[doc] >= fewest
            place, seed, doc = place[enough], seed[enough], doc[enough]
            order = np.lexsort((place, seed, doc))
            place, seed, doc = place[order], seed[order], doc[order]
            first = np.ones(len(doc), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1])
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(seed.view(np.int64)), pa.array((place - starts[doc]).astype(np.int32)), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "seed", "at", "first"])

    return run


def _region(hits: np.ndarray, places: np.ndarray, passage_length: int, n: int) -> np.ndarray:
    """The parts of a text where the passage can lie, given where rare seeds lie in both; no other text can match."""
    low = np.maximum(0, hits - places - passage_length // 4 - 20)
    high = np.minimum(n, hits + (passage_length - places) + passage_length // 4 + 20)
    mask = np.zeros(n + 1, dtype=np.int32)
    np.add.at(mask, low, 1)
    np.add.at(mask, high, -1)
    return np.cumsum(mask)[:n] > 0


def _part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document and candidate passage the letters of the text where the passage can lie."""
    for batch in (piece for whole in batches for piece in pieces(whole, "text")):
        rows: dict[str, list] = {"doc_id": [], "passage_id": [], "part": []}
        for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("passages").to_pylist()):
            codes = letters(text)
            for p in found:
                at, places = (np.array([h[c] for h in p["hits"]], np.int64) for c in ("at", "place"))
                inside = at < len(codes)  # another text under the same id may be longer
                rows["doc_id"].append(doc)
                rows["passage_id"].append(p["passage_id"])
                rows["part"].append(_text(codes[_region(at[inside], places[inside], p["n_letters"], len(codes))]))
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["passage_id"], pa.int64()), pa.array(rows["part"], pa.string())], list(rows))


def _score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in pieces(whole, "part", 500_000)):
        scores = alignments([_codes(t) for t in batch.column("letters").to_pylist()], [_codes(t) for t in batch.column("part").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("passage_id"), pa.array(scores)], ["doc_id", "passage_id", "score"])


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose id may be in `wanted`; a few others may stay."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(Bits.of(wanted.select(F.xxhash64("doc_id").alias("h")), "h", 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(bits.value.hold(batch.column("h").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("text")], ["doc_id", "text"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "doc_id long, text string")


def _candidates(spark: SparkSession, hits: DataFrame, seeds: DataFrame, passages: DataFrame, least_seeds: float) -> DataFrame:
    """(doc_id, passages): per document the passages of which it holds enough rare seeds, with the hits."""
    frequency = hits.where("first").groupBy("seed").agg(F.count("*").alias("n"))
    nearest = Window.partitionBy("passage_id", "near").orderBy("n", "place")  # a few neighbouring seeds
    rare = seeds.join(frequency, "seed").withColumn("r", F.row_number().over(nearest)).where("r = 1").select("passage_id", "seed", "place")
    rare = written(rare, "leak-rare-seeds")
    needed = F.greatest(F.lit(2.0), F.count("*") * F.lit(least_seeds)) if least_seeds > 0 else F.lit(1.0)
    goals = rare.groupBy("passage_id").agg(needed.alias("needed")).join(passages.select("passage_id", "n_letters"), "passage_id")
    met = hits.join(checked_broadcast(rare), "seed").groupBy("doc_id", "passage_id").agg(F.collect_set(F.struct("at", "place")).alias("hits"))
    met = met.join(checked_broadcast(goals), "passage_id").where(F.size(F.array_distinct("hits.place")) >= F.col("needed"))
    return met.groupBy("doc_id").agg(F.collect_list(F.struct("passage_id", "n_letters", "hits")).alias("passages"))


def find_leaks(documents: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, least_seeds: float = LEAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, score): each document that repeats a good part of an item's passage, with the item.

    `documents` has doc_id and text, `items` has item_id and passage. score is the alignment's share of the passage's best
    possible score. A document is aligned with a passage from `least_seeds` of its rare seeds on; at 0 one is enough, and
    nothing that shares a rare seed is passed over. Null and empty texts and passages match nothing; documents without an id
    can't be named and are left out; items that share a passage count each, repeated rows of an item once; repeated documents
    count each; other columns are ignored. Whole texts are searched.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.where((F.length("text") > 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    given = items.where(F.col("passage").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "passage").distinct()
    held = written(given.mapInArrow(_passage_batches, "item_id long, passage_id long, letters string, n_letters int"), "leak-items")
    passages = held.groupBy("passage_id").agg(F.any_value("letters").alias("letters"), F.any_value("n_letters").alias("n_letters"))
    passages = written(passages, "leak-passages")
    seeds = written(passages.mapInArrow(_seed_batches, "passage_id long, seed long, place int, near int"), "leak-seeds")
    bits = spark.sparkContext.broadcast(Bits.of(seeds.select("seed").distinct(), "seed"))
    hits = written(docs.mapInArrow(_hit_batches(bits, 2 if least_seeds > 0 else 1), "doc_id long, seed long, at int, first boolean"), "leak-hits")
    candidates = written(_candidates(spark, hits, seeds, passages, least_seeds), "leak-candidates")
    discard(hits, seeds)
    n_pairs = candidates.agg(F.sum(F.size("passages"))).first()[0] or 0
    joined = docs.join(F.broadcast(candidates), "doc_id") if fits_broadcast(candidates) else _only(docs, candidates).join(candidates, "doc_id")
    parts = joined.select("doc_id", "text", "passages").mapInArrow(_part_batches, "doc_id long, passage_id long, part string")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_pairs // PAIRS_PER_TASK)
    pairs = parts.repartition(tasks, "doc_id", "passage_id").join(checked_broadcast(passages.select("passage_id", "letters")), "passage_id")
    scores = pairs.select("doc_id", "passage_id", "part", "letters").mapInArrow(_score_batches, "doc_id long, passage_id long, score double").where(F.col("score") >= least_score)
    return scores.join(checked_broadcast(held.select("item_id", "passage_id")), "passage_id").select("doc_id", "item_id", "score")
