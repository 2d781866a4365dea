"""Sentence units of documents in any script: candidate boundaries, classified by a maximum-entropy model.

A document is cut into paragraphs (lines; in text/plain pages, blocks between blank lines). Within a paragraph every sentence
terminator outside quotations and parentheses, and every one that closes such a span, is a candidate, and so is a space beside
a Thai letter. The model is trained on the reliable ones: a line break is a boundary, whatever stands before and after it; a
terminator before a small letter or after a list number, and a space beside a number or sign, is none. Its features (kind of
terminator, the tokens before and after it with length, case, digits and script, quotation, and how the token behaves in the
whole corpus) leave out what makes those examples reliable (whether the next letter is small), so it can judge the others.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.letters import pieces
from cohortspark.plans.shared import ship, written

#: Bound of the training sample: documents whose reliable candidates are fitted.
TRAINING_DOCUMENTS = 6_000
#: Tokens of at most so many characters can be abbreviations; statistics are kept for them alone.
SHORT = 8
#: Characters in which the token after one is looked for, as its context.
CONTEXT = 16
#: Share of line ends among a token's contexts with a period from which it ends sentences like any word, and number of
#: contexts in which a word that ends sentences would surely have ended a line.
USUAL_ENDS, ENOUGH_CONTEXTS = 0.05, 40
#: A token type is kept as abbreviation-like from this share of contexts with a period.
LEAST_PERIOD_SHARE = 0.2

_LINE = re.compile("[^\n\r\x0b\x0c\x85  ]+")
_BLANK = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*")
_SPAN = re.compile(
    '"[^"]*"|“[^”“„]*”|„[^“”„]*[“”]|«[^»«]*»|»[^«»]*«|「[^」]*」|『[^』]*』|\\([^()]*\\)|（[^（）]*）|\\[[^\\[\\]]*\\]'
)
_TERM = re.compile("[.!?…。！？｡।॥؟۔;;։።။]+")
_THAI_SPACE = re.compile("(?<=[\u0e00-\u0e7f])[ \xa0\u202f]+(?=\\S)|(?<=\\S)[ \xa0\u202f]+(?=[\u0e00-\u0e7f])")
_THAI_BEFORE, _THAI_AFTER = re.compile("[\u0e01-\u0e3a\u0e40-\u0e45\u0e47-\u0e4e]"), re.compile("[\u0e01-\u0e2e\u0e30-\u0e3a\u0e40-\u0e44]")
_LIST_NUMBER = re.compile(r"[(\[]?(?:\d{1,3}|[^\W\d_])[.)\]]+")
_SPACE = re.compile(r"\s*")
_TOKEN = re.compile(r"\S+\Z")
_OPENING = "\"“„«»「『(（[¿¡‘'’–—-•*·​⁠­﻿"
_EDGE = "\"“”„«»「」『』()（）[]¿¡‘’',:;!?،؛"
_IGNORED = "​⁠­﻿"
_STANDING = "。！？｡"  # end sentences without a space
_AFTER = re.compile(r"\S{1,24}")
N_FEATURES = 30


def paragraphs(text: str, plain: bool) -> Iterator[tuple[int, int]]:
    """(start, end) of each paragraph that holds more than white space, without outer white space."""
    if plain:
        cuts, begin = [], 0
        for m in _BLANK.finditer(text):
            cuts.append((begin, m.start()))
            begin = m.end()
        spans: Iterator[tuple[int, int]] = iter([*cuts, (begin, len(text))])
    else:
        spans = (m.span() for m in _LINE.finditer(text))
    for a, b in spans:
        part = text[a:b]
        left = len(part) - len(part.lstrip())
        kept = part.strip()
        if kept:
            yield a + left, a + left + len(kept)


def _kind(c: str) -> str:
    """Of the next letter or digit: small, capital, digit, other letter, or none."""
    if not c:
        return "end"
    if c.islower():
        return "small"
    if c.isdigit():
        return "digit"
    return "capital" if c.isupper() or c.istitle() else "other"


def _token_before(p: str, at: int) -> str:
    """The token that ends before `at`; with the one before it where both are single letters with periods (`u. a`)."""
    m = _TOKEN.search(p, max(0, at - 40), at)
    word = m.group().lstrip(_EDGE) if m else ""
    if len(word) == 1 and m.start() >= 3 and p[m.start() - 1] == " " and p[m.start() - 2] == ".":
        before = p[m.start() - 3]
        if before.isalpha() and (m.start() == 3 or not p[m.start() - 4].isalnum()):
            return f"{before}. {word}"
    return word


def _token_after(p: str, at: int) -> str:
    m = _AFTER.match(p, at)
    return m.group() if m else ""


def _script(letter: str) -> str:
    return unicodedata.name(letter, "").partition(" ")[0] if letter.isalpha() else ""


def space_features(before: str, after: str) -> list[float]:
    """Features of a space between two characters, one of them Thai."""
    x = [0.0] * N_FEATURES
    own, following = bool(_THAI_BEFORE.match(before)), bool(_THAI_AFTER.match(after))
    x[25] = 1.0
    x[26], x[27], x[28] = float(own), float(following), float(own and following)
    x[29] = float(before.isdigit() or after.isdigit())
    return x


#: Where a corpus has few Thai lines: two letters part sentences, a number or sign on either side doesn't.
_KNOWN_SPACES = [(("\u0e01", "\u0e01"), 1.0), (("\u0e01", "1"), 0.0), (("1", "\u0e01"), 0.0), (("\u0e01", "-"), 0.0), (("-", "\u0e01"), 0.0)]


def thai_spaces(p: str) -> Iterator[tuple[int, str, str]]:
    """(place, character before, character after) of the spaces beside Thai letters, outside quotations and parentheses."""
    found = list(_THAI_SPACE.finditer(p)) if any("\u0e00" <= ch <= "\u0e7f" for ch in p) else []
    if found:
        spans = [m.span() for m in _SPAN.finditer(p)]
        for m in found:
            if not any(a < m.start() < b for a, b in spans):
                yield m.start(), p[m.start() - 1], p[m.end()]


def _type(word: str) -> str:
    """What statistics are kept of: the token, or how long a number is."""
    return f"#{len(word)}" if word.isdigit() else word


class Candidate:
    __slots__ = ("end", "mark", "word", "quoted", "quote_at_start", "after_colon", "next", "kind", "at_end", "listed", "after")


def candidates(p: str) -> Iterator[Candidate]:
    """Candidate boundaries of a paragraph in order. `quote_at_start` and `listed` are filled in by the reader."""
    spans = [m.span() for m in _SPAN.finditer(p)] if any(c in p for c in '"“„«»「『(（[') else []
    n, k = len(p), 0
    for m in _TERM.finditer(p):
        a, b = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        span = spans[k] if k < len(spans) and spans[k][0] < a else None
        mark = m.group()
        end = b
        if span:
            if _SPACE.match(p, b).end() < span[1] - 1:
                continue
            end = span[1]
        while end < n and p[end] in "”“\"»」』)）]’" and not (span is None and k < len(spans) and spans[k][0] == end):
            end += 1
        if end < n and p[end] in ".!?…。！？｡।॥؟,;:،、，":
            continue  # the last mark of a row decides, and a comma goes on
        if ";" in mark or ";" in mark:
            before = p[a - 1] if a else ""
            if not ("Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿"):
                continue
        rest = end
        while rest < n and (p[rest].isspace() or p[rest] in _IGNORED):
            rest += 1
        if rest == end and rest < n and not (mark[-1] in _STANDING or (mark[-1] in "!?" and a and p[a - 1] > "　") or (mark[-1] in "।॥") or span and p[span[1] - 1] in "”」』" and p[rest] > "⺀"):
            continue
        c = Candidate()
        c.end, c.mark, c.quoted, c.at_end = end, mark, span, rest >= n
        i = rest
        while i < n and p[i] in _OPENING:
            i += 1
        c.next = p[i] if i < n else ""
        c.after = _token_after(p, i)
        c.kind = _kind(c.next)
        c.word = _token_before(p, a) if mark == "." else ""
        c.after_colon = bool(span and re.search("[:：]\\s*\\Z", p[max(0, span[0] - 4) : span[0]]))
        c.quote_at_start = c.listed = False
        yield c


def mark_place(c: Candidate, p: str, start: int) -> None:
    """Where the candidate stands in its unit, which begins at `start`."""
    begin = _SPACE.match(p, start).end()
    c.listed = c.end - begin <= 8 and bool(_LIST_NUMBER.fullmatch(p, begin, c.end))
    if c.quoted:
        open_ = c.quoted[0]
        c.quote_at_start = open_ <= begin or (open_ - begin <= 9 and bool(_LIST_NUMBER.fullmatch(p[begin:open_].strip())))


def features(c: Candidate, stats: dict[str, tuple[int, int, int]], own_end: bool = False) -> list[float]:
    """Features of the model. stats: of a token its distinct contexts with a period, at line ends, and without.

    own_end: this line end is taken out of the token's statistics, so that training sees what judging will see.
    """
    x = [0.0] * N_FEATURES
    last = c.mark[-1]
    period = c.mark == "."
    x[0] = float(period)
    x[1] = float(last in "!?؟;;！？")
    x[2] = float(last == "…" or (len(c.mark) > 1 and last == "."))
    x[3] = float(last in "。｡।॥۔։።။！？")
    x[4] = float(bool(c.quoted))
    x[5] = float(bool(c.quoted) and c.quote_at_start)
    x[6] = float(bool(c.quoted) and c.after_colon)
    x[7] = float(bool(c.quoted) and c.next == "と")
    if period:
        word = c.word
        contexts, ends, plain = stats.get(_type(word), (0, 0, 1))
        if own_end and ends:
            contexts, ends = contexts - 1, ends - 1
        share = contexts / (contexts + plain) if contexts else 0.0
        final = min(1.0, ends / (contexts + ends) / USUAL_ENDS) if contexts + ends else 0.0  # ends lines like other words
        x[8] = share
        x[9] = math.log1p(contexts) / 5
        x[10] = (1 - final) * share
        x[11] = (1 - final) * share * math.log1p(contexts) / 5
        x[12] = final
        x[22] = (1 - final) * min(1.0, contexts / ENOUGH_CONTEXTS)  # seen often, and never where sentences end
        bare = word.replace(".", "").replace(" ", "")
        x[13] = share * float(len(word) == 1 and word.isalpha())
        x[14] = min(len(bare), 12) / 12
        x[15] = float(word.isdigit())
        x[16] = float(word.isdigit() and len(word) > 2)
        x[17] = float("." in word)
        x[18] = float(word[:1].isupper())
        x[19] = float(len(bare) > SHORT)
        x[20] = share * (1 - final) * float(len(bare) <= 3)
    before = unicodedata.name(c.word[-1], "") if c.word else ""
    x[21] = float(bool(before) and not before.startswith("LATIN"))
    after = c.after.strip(_EDGE)
    x[23] = min(len(after), 12) / 12
    x[24] = float(bool(after) and bool(c.word) and _script(after[0]) != _script(c.word[-1]) and after[0].isalpha())
    return x


def _plain(content_type: str | None) -> bool:
    return bool(content_type) and content_type.strip().lower().startswith("text/plain")


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, str, bool]]:
    for i, text, kind in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("content_type").to_pylist()):
        if text:
            yield i, text, _plain(kind)


#: Kinds of contexts of a token: before something else on its line with a period, the same at a line's end, without a period.
_PERIOD, _LINE_END, _WITHOUT, _DOCUMENTS = range(4)


def _next_token(text: str, at: int) -> str:
    after = text[at : at + CONTEXT].split(maxsplit=1)
    return after[0] if after else ""


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece of a batch: short tokens with what follows them, once by kind; and the number of documents."""
    for batch in (piece for whole in batches for piece in pieces(whole, "text")):
        pairs: set[tuple[str, str]] = set()
        seen: tuple[set, set, set] = (set(), set(), set())
        n_documents = 0
        for _, text, plain in _documents(batch):
            n_documents += 1
            tokens = text.split()
            pairs.update((t, u) for t, u in zip(tokens, [*tokens[1:], ""]) if len(t) <= SHORT + 4 and t[-1] != ".")
            lines = list(paragraphs(text, plain))
            for (a, b), (following, _) in zip(lines, [*lines[1:], (len(text), 0)]):
                p = text[a:b]
                if "." not in p:
                    continue
                for c in candidates(p):
                    if c.mark == "." and 0 < len(c.word) <= SHORT:
                        after = _next_token(p, c.end)
                        seen[_PERIOD].add((_type(c.word), f"{c.word} {after}" if after else ""))
                        if c.at_end:
                            seen[_LINE_END].add((_type(c.word), f"{c.word} {_next_token(text, following)}"))
        for token, after in pairs:
            bare = token.strip(_EDGE)
            if 0 < len(bare) <= SHORT:
                seen[_WITHOUT].add((_type(bare), f"{bare} {after[:CONTEXT]}"))
        words = [w for found in seen for w, _ in found] + [""]
        contexts = [x for found in seen for _, x in found] + [""]
        sizes = [*map(len, seen), 1]
        columns = [pa.array(words, pa.string()), pa.array(contexts, pa.string()), pa.array(np.repeat(np.arange(4, dtype=np.int32), sizes)), pa.array([1] * (len(words) - 1) + [n_documents], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "context", "kind", "n"])


def token_statistics(documents: DataFrame) -> dict[str, tuple[int, int, int]]:
    """Of each abbreviation-like token: its distinct contexts with a period, at line ends, and without; over all documents.

    Under the empty token the number of documents.

    A context is the token with what follows it, at a line's end with what the next line begins with. All three kinds count once
    however often a page is mirrored, so their shares stay alike as the corpus grows. Kept are tokens of three letters or fewer
    and those with a period in a good part of their contexts, if they have two contexts or more with a period and at least a
    millionth of all such contexts, so there are never over a million of them.
    """
    seen = documents.select("doc_id", "text", "content_type").mapInArrow(_observations, "word string, context string, kind int, n long")
    once = seen.groupBy("word", "kind", F.xxhash64("context").alias("context")).agg(F.sum("n").alias("n"))
    kinds = {"period": _PERIOD, "line_end": _LINE_END, "plain": _WITHOUT}
    words = once.groupBy("word").agg(*[F.count_if(F.col("kind") == k).alias(name) for name, k in kinds.items()], F.sum(F.when(F.col("kind") == _DOCUMENTS, F.col("n"))).alias("documents"))
    words = written(words.where("period > 0 or documents > 0"), "period-tokens")
    total = words.agg(F.sum("period")).first()[0] or 0
    frequent = F.col("period") >= max(2.0, total * 1e-6)
    kept = words.where(frequent & ((F.length("word") <= 3) | (F.col("period") / (F.col("period") + F.col("plain")) >= LEAST_PERIOD_SHARE)))
    found = {r["word"]: (r["period"], r["line_end"], r["plain"]) for r in kept.where("word <> ''").collect()}
    return found | {"": (0, words.where("word = ''").agg(F.sum("documents")).first()[0] or 0, 0)}


def _training_batches(stats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [space_features(*pair) for pair, _ in _KNOWN_SPACES], [label for _, label in _KNOWN_SPACES]
            for _, text, plain in _documents(batch):
                lines = [text[a:b] for a, b in paragraphs(text, plain)]
                for p, following in zip(lines, [*lines[1:], ""]):
                    start = 0
                    for c in candidates(p):
                        mark_place(c, p, start)
                        if c.at_end and not c.listed:
                            if following:
                                c.after = _token_after(following, len(following) - len(following.lstrip(_OPENING)))
                                rows.append(features(c, stats.value, own_end=True))
                                labels.append(1.0)
                        elif c.kind == "small" or c.listed or c.next == "と":
                            rows.append(features(c, stats.value))
                            labels.append(0.0)
                        elif not c.quoted and c.mark != ".":
                            start = c.end
                    for _, before, after in thai_spaces(p):
                        if not (before.isalpha() or _THAI_BEFORE.match(before)) or not (after.isalpha() or _THAI_AFTER.match(after)):
                            rows.append(space_features(before, after))
                            labels.append(0.0)
                    if following and _THAI_BEFORE.match(p[-1]) and _THAI_AFTER.match(following[0]):
                        rows.append(space_features(p[-1], following[0]))
                        labels.append(1.0)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], names=["x", "label"])

    return run


def fit(documents: DataFrame, stats) -> np.ndarray:
    """Weights and bias of the maximum-entropy model, from the reliable candidates of a bounded sample of documents."""
    total = max(1, stats.value.get("", (0, 1, 0))[1])
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, TRAINING_DOCUMENTS / total)))
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("label", T.DoubleType())])
    rows = written(sample.select("doc_id", "text", "content_type").mapInArrow(_training_batches(stats), schema), "boundary-examples")
    classes = {r[0] for r in rows.select("label").distinct().collect()}
    if len(classes) < 2:  # nothing to tell apart: every candidate is what all examples are
        return np.array([0.0] * N_FEATURES + [-1.0 if classes == {0.0} else 1.0])
    model = LogisticRegression(maxIter=40, regParam=1e-3, tol=1e-5).fit(rows.select(array_to_vector("x").alias("features"), "label"))
    return np.append(model.coefficients.toArray(), model.intercept)


def boundaries(p: str, stats: dict, weights: list[float]) -> Iterator[int]:
    """Ends of the sentences of a paragraph."""
    bias, w, start = weights[-1], weights[:-1], 0
    is_end = lambda x: sum(map(mul, w, x)) + bias > 0
    found = []
    for c in candidates(p):
        if c.at_end:
            continue
        mark_place(c, p, start)
        if c.listed or c.kind == "small":
            continue
        if is_end(features(c, stats)):
            found.append(c.end)
            start = c.end
    spaces = [at for at, before, after in thai_spaces(p) if is_end(space_features(before, after))]
    if spaces:
        found = sorted({*found, *spaces})
    yield from found
    yield len(p)


def _unit_batches(stats, weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, starts, ends = [], [], [], []
            for doc, text, plain in _documents(batch):
                number = 0
                for a, b in paragraphs(text, plain):
                    begin = a
                    for end in boundaries(text[a:b], stats.value, weights):
                        while begin < a + end and text[begin].isspace():
                            begin += 1
                        ids.append(doc)
                        numbers.append(number)
                        starts.append(begin)
                        ends.append(a + end)
                        number, begin = number + 1, a + end
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "unit", "start_pos", "end_pos"]
            )

    return run


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, unit, start_pos, end_pos): the sentence units of every document, in order, in code points of its text.

    `documents` has doc_id, text, content_type (null counts as a page with meaningful line breaks); other columns are
    ignored. Null, empty and blank texts have no units; repeated documents have theirs each. Positions leave out the white
    space around a unit. Texts are read whole, each within one task; nothing of the documents is shuffled but statistics.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "content_type").where(F.length("text") > 0)
    stats = spark.sparkContext.broadcast(token_statistics(docs))
    weights = fit(docs, stats).tolist()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("unit", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    return docs.mapInArrow(_unit_batches(stats, weights), schema)
