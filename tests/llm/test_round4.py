"""Index lists without entries that cannot be linked; words that the piece encoder remembers."""

from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from test_small import docs_of, shingle_components
from tracewright.llm import jaccard, sentencepieces, text
from tracewright.llm.queries import PIECE_MODEL


def test_comparable_against_all_pairs():
    rng = np.random.default_rng(7)
    token = np.sort(rng.integers(0, 400, 1500))
    token[200:300] = token[200]
    n = rng.integers(1, 60, len(token))
    order = np.lexsort((n, token))
    token, n = token[order], n[order].astype(np.int32)
    pos = (n * rng.random(len(n)) * 0.3).astype(np.int32)
    for percent in (80, 85):
        for longest in (2, 64):
            expected = []
            for i in range(len(token)):
                mine = np.flatnonzero(token == token[i])
                found = len(mine) > longest
                for j in mine[mine != i]:
                    least = -(-percent * int(n[i] + n[j]) // (100 + percent))
                    in_size = percent * max(n[i], n[j]) <= 100 * min(n[i], n[j])
                    found |= bool(in_size and min(n[i] - pos[i], n[j] - pos[j]) >= least)
                expected.append(found)
            assert 0 < sum(expected) < len(expected)
            assert jaccard._comparable(token, n, pos, percent, longest).tolist() == expected


def test_lists_across_batches(spark):
    rows = [(t, 10 * t + k, 20 + k, 0) for t in range(40) for k in range(t % 5)]
    entries = spark.createDataFrame(rows, "token bigint, id bigint, n int, pos int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = jaccard._lists(entries, 50, 64).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = sorted((*r, r[0] % 5) for r in rows if r[0] % 5 > 1)
    assert sorted(map(tuple, found)) == expected


def test_sets_that_cannot_be_linked_meet_no_leader(spark, monkeypatch):
    compared, bounded = [], jaccard._bounded

    def counting(pairs, sets):
        compared.append(pairs.count())
        return bounded(pairs, sets)

    monkeypatch.setattr(jaccard, "_bounded", counting)
    rows = []
    for i in range(30):  # the same beginning, sizes too far apart
        head = [f"h{i}_{k}" for k in range(60)]
        for length in (20, 100):
            rows.append((len(rows), " ".join(head + [f"t{i}_{length}_{k}" for k in range(length)])))
    copy = [f"c{k}" for k in range(120)]
    rows += [(500, " ".join(copy)), (501, " ".join([*copy[:-1], "other"]))]
    got = jaccard.jaccard_components(docs_of(spark, rows), 4, 85)
    assert sorted(map(tuple, got.collect()), key=str) == shingle_components(rows, 4, 85)
    assert compared[0] == 1


def test_words_met_again_are_remembered(monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 100)
    model = public_tokenizers.path(PIECE_MODEL)
    pieces = sentencepieces.Pieces(model)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    made, split = Counter(), pieces.split
    pieces.split = lambda text: made.update([text]) or split(text)
    rng = np.random.default_rng(11)
    for i in range(600):
        text = f"again  {''.join(rng.choice(list('abetE1é中\U0001f600_-'), 9))} w{i}"
        ids, decoded = pieces.encode(text)
        expected = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert decoded.decode(errors="replace") == library.decode(expected)
    assert made["▁again"] == 1
    assert len(pieces.words) + len(pieces.older) <= 100


def test_shingles_of_many_documents_at_once():
    rng = np.random.default_rng(3)
    for sizes in ([], [0], [2, 0, 1], [3, 4, 0, 5], rng.integers(0, 12, 200)):
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        hashed = rng.integers(0, 5, offsets[-1])
        for width in (1, 4, 5):
            for step in (1, 7, 1 << 15):
                got = [s.tolist() for s in text.all_shingles(hashed, offsets, width, step)]
                assert got == [text.shingles(hashed[a:b], width).tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_sizes_of_sets(spark):
    texts = ["", " \t ", "a", "A b", "a b\x0bc d a B c D a b", "x " * 40, "é É é É e\u00a0f g h", " one  two\nthree four five "]
    rows = [(i if i else None, i, t) for i, t in enumerate(texts)]
    got = jaccard._sizes(spark.createDataFrame(rows, "doc_id bigint, id bigint, text string"), 4).collect()
    assert {(r.doc_id, r.id): r.n_shingles for r in got} == dict(zip([(r[0], r[1]) for r in rows], [0, 0, 1, 1, 4, 1, 4, 2]))
