"""The dealt methods against brute force, and columns of documents that are named like inner ones."""

import random
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import ann, language, packing, substrings

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_every_two_languages_of_a_family_have_a_machine(spark):
    rng = np.random.default_rng(1)
    words = {
        "fr": "le la les et des en un du une que".split(),
        "es": "el la que de los se las por con una".split(),
        "it": "il di che la e per un in sono non".split(),
        "pt": "o a de que e do da em um para".split(),
        "fi": "ja on ei se oli mutta han kun niin".split(),
    }
    rows = [(i, " ".join(rng.choice(words[lang], 25)), lang, "s", 0) for i, lang in enumerate([*words] * 30)]
    machines = {m[0]: m for m in language.train(spark.createDataFrame(rows, DOCS))}
    assert machines["romance"][1] == ["es", "fr", "it", "pt"] and machines["romance"][2].shape[1] == 6
    assert machines["only fi"][2].shape[1] == 0 and machines[""][2].shape[1] == len(machines[""][1]) == 2
    # as many rows of each language as asked for, those of the smallest hashes, whatever order they come in
    some = language._first_of_each(spark.createDataFrame(rows, DOCS), 7).collect()
    hashed = spark.createDataFrame(rows, DOCS).select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect()
    for lang in words:
        wanted = sorted((r.h, r.doc_id) for r in hashed if r.lang == lang)[:7]
        assert {r.doc_id for r in some if r.lang == lang} == {i for _, i in wanted}


def test_votes_are_those_of_every_two_languages():
    margin = np.random.default_rng(2).normal(size=(300, 10)).round(1)
    best, sure = language.elected(margin, 5)
    for row, got in zip(margin, best):
        votes, total = [0] * 5, [0.0] * 5
        for (a, b), m in zip(combinations(range(5), 2), row):
            votes[a if m > 0 else b] += 1
            total[a] += m
            total[b] -= m
        chosen = [k for k in range(5) if votes[k] == max(votes)]
        assert votes[got] == max(votes) and total[got] == pytest.approx(max(total[k] for k in chosen))
    assert ((0 <= sure) & (sure <= 1)).all()
    assert language.elected(np.zeros((3, 0)), 1)[1].tolist() == [1.0, 1.0, 1.0]


@pytest.mark.parametrize("offset, scale", [(0.0, 1.0), (10_000.0, 1.0), (0.0, 1e30), (0.0, 1e-30)])
def test_recall_wherever_vectors_lie(spark, offset, scale):
    x = (np.random.default_rng(3).normal(size=(1500, 24)) + offset) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.neighbours(df, df.where("vec_id % 30 = 0"), 10, shard_rows=800).collect()
    hits = 0
    for q in range(0, 1500, 30):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = [r for r in got if r.query_id == q]
        assert sorted(r["rank"] for r in mine) == list(range(1, 11))
        assert all(r.score == pytest.approx(d[r.vec_id], rel=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 500


def test_vectors_meet_those_of_their_length(spark):
    rows = [(i, [float(i % 7 + 1), float(i)] if i % 3 else [1.0, float(i), 2.0]) for i in range(60)]
    rows += [(100, [1e200, 0.0, 0.0, 1.0]), (101, [-1e200, 0.0, 0.0, 1.0]), (102, [5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.neighbours(df, df.where("vec_id in (0, 1, 100, 102)"), 5).collect()
    length = {i: len(v) for i, v in rows}
    assert all(length[r.query_id] == length[r.vec_id] and r.query_id != r.vec_id for r in got)
    assert sorted(r.query_id for r in got) == [0] * 5 + [1] * 5 + [100]
    assert next(r.score for r in got if r.query_id == 100) == 2e200


def gains(bins, size, capacity):
    """Whether any move, or exchange for one or two, makes the sum of squares greater."""
    fill = [sum(size[i] for i in b) for b in bins]
    for s, t in ((s, t) for s in range(len(bins)) for t in range(len(bins)) if s != t and fill[t] >= fill[s]):
        for a in bins[s]:
            for given in [(), *((i,) for i in bins[t]), *combinations(bins[t], 2)]:
                back = sum(size[i] for i in given)
                if back < size[a] and fill[t] + size[a] - back <= capacity:
                    return True
    return False


def test_search_ends_only_where_no_move_is_left():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        size = rng.integers(1, 101, n) if rng.random() < 0.5 else rng.integers(25, 70, n)
        start = [[i] for i in rng.permutation(n).tolist()] if rng.random() < 0.5 else packing.best_fit(size, 100)
        out = packing.local_search(start, size, 100)
        assert sorted(i for b in out for i in b) == list(range(n))
        assert all(0 < sum(size[b]) <= 100 for b in out) and len(out) <= len(start)
        assert len(out) == -(-size.sum() // 100) or not gains(out, size, 100)


def test_search_of_many_long_pieces_ends():
    size = np.random.default_rng(5).integers(1000, 3000, 1200)
    start = packing.best_fit(size)
    assert len(packing.local_search(start, size)) <= min(587, len(start))


def test_columns_named_like_inner_ones(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"{text} end{i} of it", "en", "s", 0) for i in range(3)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("_key", "_rid", "_text", "_GROUP", "rid", "words"):
        docs = docs.withColumn(c, F.lit(c))
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns and [r._key for r in kept.collect()] == ["_key"] * 3
    left = substrings.remove_repeats(docs)
    found = {r.doc_id: r for r in left.collect()}
    assert left.columns == docs.columns and {r._text for r in found.values()} == {"_text"} and found[0]._rid == "_rid"
    assert found[0].text == rows[0][1] and found[1].text == "end1 of it" and found[None].text is None
    items = spark.createDataFrame([(i, 30, "g") for i in range(10)], "doc_id bigint, length bigint, _group string")
    packed = packing.pack(items, 100).collect()
    assert {r._group for r in packed} == {"g"} and len({r.sequence_id for r in packed}) == 4
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, none, "").collect() == []


def test_ids_of_words_are_those_of_whole_texts(monkeypatch):
    """Also when words are forgotten between batches, and for letters whose lower case is special."""
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    encoder, rnd = packing.WordIds(path), random.Random(5)
    letters = "abcXYZ.,\u00c0\u00ff\u00df\u00c9\u00d7\u00f7'\u2019\u0130\u0131\u017f\u212a 1 2-_\ufb01\u0446\u044f \x1c\u0085\t\n\u3000"
    for _ in range(5):
        texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(300)] + ["", ".", ",", ".,", "a.,", "..", "a.."]
        ids, ends = packing.flat_ids(pa.array(texts), encoder)
        for text, a, b in zip(texts, ends[:-1], ends[1:]):
            assert ids[a:b].tolist() == encoder.encoder.encode(text, add_special_tokens=False).ids
    assert packing.flat_ids(pa.array(["", " "]), encoder)[1].tolist() == [0, 0, 0]
