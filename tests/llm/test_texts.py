import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import leaks, mixing, sentences
from cohortspark.llm.letters import letters

WORDS = "river table copper garden signal window harbour letter engine salt morning village teacher bridge colour quiet narrow winter folder image".split()


def passage(rng, n=60):
    made, text = ["".join(rng.choice("bdfgklmnprstvw") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)], []
    for i, w in enumerate(made):
        text.append((w if rng.random() < 0.6 else rng.choice(WORDS)) + ("." if i % 10 == 9 else ""))
    return " ".join(text)


def test_leaks(spark):
    rng = random.Random(11)
    items = [(i, passage(rng), "x") for i in range(8)]
    sentences_of = [p.split(". ") for _, p, _ in items]
    filler = lambda: passage(rng, 80)
    edited = [w if i % 7 else "altered" for i, w in enumerate(items[2][1].split())]
    shuffled = items[3][1].replace(".", "").split()
    rng.shuffle(shuffled)
    docs = [
        (1, filler() + " " + items[0][1] + " " + filler()),
        (2, filler() + "\n" + items[1][1].upper().replace(" ", "\n") + filler()),
        (3, " ".join(edited)),
        (4, " ".join(shuffled)),
        (5, filler() + ". ".join(sentences_of[4][:3]) + "\n" + filler()),  # half of it
        (6, ". ".join(sentences_of[5][:1]) + filler()),  # a sixth
        (7, sentences_of[6][0] + filler() + sentences_of[6][2] + filler() + sentences_of[6][4]),  # half, in pieces
        (8, None), (9, ""), (10, filler() * 30 + items[7][1] + filler() * 30),
        (1, items[0][1]), (11, items[0][1].replace("a", "à").replace(" ", "­ ")),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("letters", F.lit("clash"))
    it = spark.createDataFrame([*items, (20, items[0][1], "x"), (21, None, "x"), (22, "", "x"), items[0]], "item_id long, passage string, doc_id string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(d, it).collect())
    assert got == sorted([(1, 0), (1, 20), (1, 0), (1, 20), (11, 0), (11, 20), (2, 1), (3, 2), (5, 4), (7, 6), (10, 7)])
    assert leaks.find_leaks(d.limit(0), it).count() == 0 and leaks.find_leaks(d, it.limit(0)).count() == 0


def test_full_seed_tables_and_shuffled_candidates_find_the_same(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, passage(rng)) for i in range(9)]
    docs = spark.createDataFrame([(i, passage(rng) + p) for i, p in items] + [(i, passage(rng)) for i in range(100, 140)] + [(None, items[0][1])], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, passage string")
    monkeypatch.setattr(leaks, "MOST_BITS", 8)  # every window passes
    monkeypatch.setattr(leaks, "LEAST_BITS", 8)
    monkeypatch.setattr(leaks, "fits_broadcast", lambda table: False)
    assert sorted(map(tuple, leaks.find_leaks(docs, it).select("doc_id", "item_id").collect())) == [(i, i) for i in range(9)]


def test_a_hot_passage_keeps_its_seeds(spark):
    """A third of all documents repeat one passage, and none of its seeds is rare."""
    rng = random.Random(13)
    items = [(i, passage(rng)) for i in range(3)]
    docs = [(i, (items[0][1] if i % 3 == 0 else "") + " " + passage(rng)) for i in range(150)]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 150, 3))


def test_alignments_side_by_side_are_the_single_ones():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(97, 101, rng.integers(1, 40)).astype(np.uint32), rng.integers(97, 101, rng.integers(0, 70)).astype(np.uint32)) for _ in range(60)]
    pairs.append((rng.integers(0x4E00, 0x4E04, 20).astype(np.uint32), rng.integers(0x4E00, 0x4E04, 50).astype(np.uint32)))
    together = leaks.alignments([p for p, _ in pairs], [t for _, t in pairs])
    assert np.allclose(together, [leaks.alignment(p, t) for p, t in pairs])


def slow_alignment(a, b, jump):
    """The recurrence cell by cell."""
    score, best = np.zeros((len(a) + 1, len(b) + 1)), np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = leaks.MATCH if a[i - 1] == b[j - 1] else leaks.DIFFER
            begin = max(0, best[i - 1, j - 1] - jump)
            score[i, j] = max(0, max(score[i - 1, j - 1], begin) + s, score[i - 1, j] - leaks.GAP, score[i, j - 1] - leaks.GAP)
            best[i, j] = max(score[i, j], best[i - 1, j], best[i, j - 1])
    return best.max() / (leaks.MATCH * len(a))


def test_alignment_by_rows_is_the_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.integers(97, 100, 30).astype(np.uint32), rng.integers(97, 100, 45).astype(np.uint32)
        assert leaks.alignment(a, b) == pytest.approx(slow_alignment(a, b, leaks.JUMP))


def test_every_aligned_pair_is_a_candidate(spark, sf):
    """All passages against a few documents, without seeds: no pair above the limit is missed."""
    items = [(r.item_id, r.passage) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = docs.where("n_chars between 1 and 900").orderBy("doc_id").limit(12)
    want = {(d.doc_id, i) for d in few.collect() for i, p in items if leaks.alignment(letters(p), letters(d.text)) >= leaks.LEAST_SCORE}
    ids, all_items = {r.doc_id for r in few.collect()}, spark.read.parquet(f"{sf}/eval_items.parquet")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, all_items).collect()}
    assert {x for x in got if x[0] in ids} == want
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, all_items, least_seeds=0).collect()} == got


def test_raking_meets_sources_and_caps(spark):
    rng = np.random.default_rng(1)
    rows = [(s, l, t, int(rng.integers(100, 9000))) for s in "abc" for l in ("en", "de", None) for t in range(3)]
    cells = pd.DataFrame(rows, columns=["source", "lang", "topic", "tokens"])
    shares, repeats = {"a": 0.5, "b": 0.3, "c": 0.1, "none": 0.1}, {"a": 1, "b": 2, "c": 4, "none": 9}
    given = mixing.reachable_totals(cells.groupby("source")["tokens"].sum().to_dict(), shares, repeats)
    weighted, raked = mixing.rake(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), given, repeats)
    got = weighted.toPandas()
    got["mixed"] = got["tokens"] * got["weight"]
    by_source = got.groupby("source")["mixed"].sum()
    assert all(by_source[s] == pytest.approx(given[s], rel=1e-5) for s in "abc") and given["none"] == 0 and raked.rounds < 40
    assert (got["weight"] <= got["source"].map(repeats) + 1e-9).all() and by_source["a"] / by_source.sum() == pytest.approx(5 / 9, rel=1e-5)
    more = mixing.reachable_totals({"a": 10.0, "b": 100.0}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 3}, total=200)
    assert more == {"a": 20.0, "b": 180.0}


def test_raking_keeps_margins_of_any_number_of_topics(spark):
    rng = random.Random(2)
    rows = [(s, l, f"t{t}", rng.randint(50, 500)) for s in "abc" for l in ("en", "de") for t in range(300)]
    given = {"a": 9000.0, "b": 6000.0, "c": 3000.0}
    weighted, _ = mixing.rake(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), given, dict.fromkeys("abc", 5))
    got = weighted.toPandas()
    for margin in ("lang", "topic"):
        mixed = (got["tokens"] * got["weight"]).groupby(got[margin]).sum() / 18000
        assert np.allclose(mixed, got.groupby(margin)["tokens"].sum() / got["tokens"].sum(), rtol=5e-3)


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary here")
def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(20, 60))), rng.choice(["big"] * 8 + ["small", "other", None]), rng.choice(["en", "DE-de", None]), rng.choice(["t", None])) for i in range(4000)]
    docs += [(-1, None, "big", None, None), (-2, "", "small", None, None), (1, "twice", "big", "en", "t")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, topic string").withColumn("n_tokens", F.lit("clash")).withColumn("weight", F.lit(3))
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 5), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.plan_mix(d, targets)
    drawn = plan.documents()
    mixed = drawn.select("doc_id", "source", "n_tokens", "copies")
    report = {r.source: r for r in plan.shares(drawn).collect()}
    assert report["big"].reached_share == pytest.approx(7 / 9, abs=0.001) and report["absent"].reached_share == 0 and not report["absent"].reached
    assert report["big"].most_copies == 1 and report["small"].most_copies <= 3 and set(report) == {"big", "small", "absent"}
    assert report["big"].met and report["small"].met and sum(r.binds for r in report.values()) == 1
    margins = plan.margins(drawn).collect()
    assert all(abs(r.planned_share - r.mix_share) < 0.01 for r in margins) and {r.value for r in margins if r.margin == "lang"} == {"en", "de", None}
    texts = {i: t for i, t, *_ in docs}
    encoder = mixing._encoder(mixing.TOKENIZER)
    assert all(r.n_tokens in (len(encoder.encode_ordinary(texts[r.doc_id])), len(encoder.encode_ordinary("twice"))) for r in mixed.limit(50).collect())
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(d.repartition(9), targets).collect()))
    assert mixing.mix(d.limit(0), targets).count() == 0 and mixing.mix(d, targets.limit(0)).count() == 0


def spans(text, plain=False):
    return [text[a:b] for a, b in sentences.paragraphs(text, plain)]


def test_paragraphs():
    assert spans(" a b \r\n\r\n c\n") == ["a b", "c"] and spans("a\nb\n \nc\n\n", True) == ["a\nb", "c"] and spans(" \n ") == [] == spans("", True)


def cut(p):
    return [p[c.end - 1] + "|" + p[c.end : c.end + 2] for c in sentences.candidates(p)]


def test_candidates():
    assert cut("One 3.5 v2.1.0 www.a.example end. Two") == [".| T"]
    assert cut("“Wait! Stop!” said Ann. Go.") == ["”| s", ".| G", ".|"]
    assert cut("See (Sec. 3) there. Or: 「行く。」と言った。次。") == [".| O", "」|と言", "。|次。", "。|"]
    assert cut("Τι; Ναι. a; b") == [";| Ν", ".| a"] and cut("well... no") == [".| n"] and cut("竹……。的") == ["。|的"]


def test_units_of_written_examples(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "content_type")
    own = [
        (10**9 + 1, "A heading\nMr. Peles met Dr. Wenric at 3.50 p.m. there. Then they left! “Is it far?” asked Ann. No.", "text/html"),
        (10**9 + 2, "A first line that\nis wrapped. A second\none.\n\nA block", "text/plain; charset=utf-8"),
        (10**9 + 3, "1. First item here. 2\n2. Another", None),
        (10**9 + 4, None, "text/html"), (10**9 + 5, "", None), (10**9 + 6, " \n\t", None),
        (10**9 + 7, "บ้านสวย น้ำเย็น 45 วันนี้ ไปตลาด", "text/html"),
        (10**9 + 8, "天気がいい。行こう！「はい。」と言った。", "text/html"),
        (10**9 + 9, "x" * 300_000 + ". " + "(" * 5000 + "“" * 5000 + "a. b " * 3000, "text/html"),
    ]
    both = docs.union(spark.createDataFrame(own, docs.schema)).withColumn("unit", F.lit(1))
    got = {}
    for r in sentences.sentence_units(both).where(f"doc_id > {10**9}").orderBy("doc_id", "unit").collect():
        got.setdefault(r.doc_id - 10**9, []).append(next(t for i, t, _ in own if i == r.doc_id)[r.start_pos : r.end_pos])
    assert got[1] == ["A heading", "Mr. Peles met Dr. Wenric at 3.50 p.m. there.", "Then they left!", "“Is it far?” asked Ann.", "No."]
    assert got[2] == ["A first line that\nis wrapped.", "A second\none.", "A block"]
    assert got[3] == ["1. First item here.", "2", "2. Another"]
    assert 4 not in got and 5 not in got and 6 not in got
    assert got[7] == ["บ้านสวย", "น้ำเย็น 45 วันนี้", "ไปตลาด"]
    assert got[8] == ["天気がいい。", "行こう！", "「はい。」と言った。"]
    assert "".join(got[9]).replace(" ", "") == own[8][1].replace(" ", "")


def test_units_cover_all_that_is_not_space(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    at = {}
    for r in sentences.sentence_units(docs).orderBy("doc_id", "unit").collect():
        text, before = texts[r.doc_id], at.get(r.doc_id, 0)
        assert r.start_pos >= before and not text[before : r.start_pos].strip() and text[r.start_pos : r.end_pos] == text[r.start_pos : r.end_pos].strip() != ""
        at[r.doc_id] = r.end_pos
    assert all(not t[at.get(i, 0) :].strip() for i, t in texts.items())
    assert sentences.sentence_units(docs.limit(0)).count() == 0


def test_token_statistics_do_not_grow_with_mirrored_pages(spark):
    texts = [("He met Dr. Wen there. No answer came.\nSaid no to Dr. Pel.\nNext came Dr. Ash", "text/html"), ("No. 3 and No. 4 say no.\nThe end", "text/html")]
    pages = lambda copies: spark.createDataFrame([(10 * c + i, t, k) for c in range(copies) for i, (t, k) in enumerate(texts)], "doc_id long, text string, content_type string")
    once, often = sentences.token_statistics(pages(1)), sentences.token_statistics(pages(30).repartition(3))
    assert once.pop("") == (0, 2, 0) and often.pop("") == (0, 60, 0)
    assert once == often and once["Dr"] == (3, 0, 0) and once["No"] == (2, 0, 1)
