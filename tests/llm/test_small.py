"""Each operator on small tables with odd rows: nulls, empty and long texts, repeats, clashing columns, nothing at all."""

import hashlib
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import ann, jaccard, language, ordinal, packing, pii, quality, sentencepieces, substrings, toxicity
from tracewright.llm.components import components
from tracewright.llm.queries import PIECE_MODEL, WORD_TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names clash with those that the operators use inside.
CLASH = ["rid", "id", "w", "token", "label", "Text", "n", "key"]


def docs_of(spark, texts, lang="en", clash=False):
    rows = [(i, t, lang, "s", 0 if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        for c in CLASH:
            if c != "Text":
                df = df.withColumn(c, F.lit(7))
    return df


LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "the cat sat on the mat and looked at the dog all day long"),
    (5, "the cat sat on the mat and looked at the dog all day long"),
    (6, "the cat sat on the mat and looked at the dog all day long"),
    (7, LONG),
    (8, LONG + " tail"),
    (None, "no id has this text"),
    (9, "é ñ 漢字 😀 a.b@c.example or +1 (415) 555-2671 or 10.0.0.1 or 4111 1111 1111 1111"),
]


def shingle_components(rows, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and rows[i][0] is not None and rows[j][0] is not None:
                if 100 * both >= percent * len(a | sets[j]):
                    above[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(same) if doc_id is not None else None))
    return sorted(out, key=str)


def test_jaccard_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = list(ODD)
    for group in range(12):
        base = [f"x{w}" for w in rng.integers(0, 400, rng.integers(30, 200))]
        for _ in range(10):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 6)):
                copy[at] = f"y{rng.integers(0, 30)}"
            rows.append((len(rows) + 100, " ".join(copy)))
    shared = " ".join(f"common{i}" for i in range(30))
    rows += [(1000 + i, shared + " " + " ".join(f"q{i}_{k}" for k in range(40))) for i in range(40)]
    for percent, longest in ((85, 64), (80, 3)):
        got = jaccard.jaccard_components(docs_of(spark, rows, clash=True), 4, percent, longest)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted(map(tuple, got.collect()), key=str) == shingle_components(rows, 4, percent)


def test_near_sets_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rng = np.random.default_rng(5)
    base = [f"x{w}" for w in range(120)]
    rows = []
    for i in range(40):
        copy = list(base)
        for at in rng.integers(0, 120, 4):
            copy[at] = f"y{rng.integers(0, 9)}"
        rows.append((i, " ".join(copy)))
    got = jaccard.jaccard_components(docs_of(spark, rows), 4, 85)
    assert sorted(map(tuple, got.collect()), key=str) == shingle_components(rows, 4, 85)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(500, 560)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    above = {x: x for pair in links for x in pair}
    for _ in range(600):
        for a, b in links:
            above[a] = above[b] = min(above[a], above[b])
    real = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: above[x] for x in real}


def removed(rows, width):
    first = {}
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - width + 1):
            if doc_id is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        stays = [True] * len(w)
        for k in range(len(w) - width + 1):
            if doc_id is not None and first[tuple(w[k : k + width])] < doc_id:
                stays[k : k + width] = [False] * width
        kept = " ".join(x for x, s in zip(w, stays) if s)
        out.append((doc_id, len(w), stays.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_rows", [50_000, 1])
def test_substrings_against_all_windows(spark, bucket_rows):
    rng = np.random.default_rng(2)
    passage = [f"p{i}" for i in range(40)]
    rows = list(ODD)
    for i in range(60):
        own = [f"o{w}" for w in rng.integers(0, 50, rng.integers(0, 60))]
        at = rng.integers(0, len(own) + 1)
        rows.append((100 + i, " ".join(own[:at] + passage[: rng.integers(5, 41)] + own[at:])))
    got = substrings.repeat_digests(docs_of(spark, rows, clash=True), 12, bucket_rows)
    assert sorted(map(tuple, got.collect()), key=str) == removed(rows, 12)


def test_few_texts_of_many_windows_are_a_large_bucket(spark, monkeypatch):
    rows = [(i, "la " * 2000 + f"end{i}") for i in range(3)]
    seen, plain = [], substrings._sorted_by_spark

    def counted(packed, width):
        seen.append(packed.count())
        return plain(packed, width)

    monkeypatch.setattr(substrings, "_sorted_by_spark", counted)
    got = substrings.repeat_digests(docs_of(spark, rows), 12, 1000)
    assert sorted(map(tuple, got.collect()), key=str) == removed(rows, 12)
    assert seen[0] >= 3


def test_removal_keeps_columns_and_white_space(spark):
    same = " ".join(f"p{i}" for i in range(20))
    docs = docs_of(spark, [(1, "a\n\n" + same), (2, "b\tc\n" + same + "\nend  here"), (3, same), (4, None)])
    out = {r.doc_id: r.text for r in substrings.remove_repeats(docs, 10).collect()}
    assert out == {1: "a\n\n" + same, 2: "b\tc\nend  here", 4: None}


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(WORD_TOKENIZER)
    encoder = Tokenizer.from_file(path)
    texts = [*ODD, (20, "Don't stop!! <|endoftext|> É́ x y a\x1cb ...,, THE. the,"), (21, "a" * 5000)]
    got = packing.pack_documents(docs_of(spark, texts, clash=True), path, capacity=64, group=50).collect()
    want = []
    for doc_id, text in texts:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            want.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64


def test_local_search_empties_bins_and_raises_squares():
    lengths = np.array([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])
    bins = [[i] for i in range(len(lengths))]
    out = packing.local_search(bins, lengths, 10)
    assert sorted(i for b in out for i in b) == list(range(10))
    assert len(out) == 4 and all(sum(lengths[b]) <= 10 for b in out)
    # one for one, then two for one
    assert len(packing.local_search([[0, 1], [2, 3], [4]], np.array([5, 3, 6, 2, 4]), 10)) == 2
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 60, 80)
        start = [[i] for i in range(80)]
        out = packing.local_search(start, sizes, 100)
        assert sorted(i for b in out for i in b) == list(range(80))
        assert max(sizes[b].sum() for b in out) <= 100
        assert sum(sizes[b].sum() ** 2 for b in out) >= (sizes**2).sum()
        assert len(out) <= 40 and len(packing.local_search(packing.best_fit(sizes, 100), sizes, 100)) <= -(-sizes.sum() // 100) + 1


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path(PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(4)
    alphabet = list("aabbcceeth  \t\n▁éñ漢😀.<0x41>\x00")
    texts = [*ODD, *[(100 + i, "".join(rng.choice(alphabet, rng.integers(0, 50)))) for i in range(400)]]
    got = sentencepieces.encoding_digests(docs_of(spark, texts, clash=True), path).collect()
    want = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        shown = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc_id, len(ids), shown, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    whole = sentencepieces.encode_documents(docs_of(spark, [(1, "a  b ")]), path).first()
    assert np.frombuffer(whole.ids, "<u4").tolist() == library.encode("a  b ", add_bos=True, add_eos=True)
    assert bytes(whole.decoded).decode() == "a  b "


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(BASE).index(kind), m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(6)
    alphabet = list("a1.0@-+ ()9b2%\n")
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(text) == plain_base(text), text
    for text in ("4111 1111 1111 1111 and 5500-0000-0000-0004", "x@y.z@q.example.org", "1.2.3.4.5.6.7.8 300.1.1.1"):
        assert pii.base_spans(text) == plain_base(text)


def test_pii_adds_spans_and_keeps_base(spark):
    texts = [*ODD, (30, "reach me at 555-987-6543 or write to bob@host please"), (31, "version 3.2.1 of the tool in 2019")]
    rows = pii.find_pii(docs_of(spark, texts, clash=True)).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    text = dict(texts)
    for r in rows:
        base = pii.listed(plain_base(text[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r.spans.split(",")) or not base
    assert [s.split(":")[0] for s in by_id[30].spans.split(",")] == ["phone", "email"]
    assert by_id[31].spans == "" and by_id[7].spans == ""
    masked = {r.doc_id: r.text for r in pii.mask(docs_of(spark, texts)).collect()}
    assert masked[30] == "reach me at <phone> or write to <email> please" and masked[1] is None
    assert masked[9].endswith("<email> or <phone> or <ip> or <card>")


def test_field_learns_its_table():
    lines = [pii._parse(x) for x in pii.LABELLED.strip().split("\n")]
    field = pii.train()
    tags = field.decode([field.emissions(w) for w, _ in lines])
    right = sum(list(t) == y for t, (_, y) in zip(tags, lines))
    assert right >= 0.95 * len(lines)


def added(text, field):
    base = pii.base_spans(text)
    return [(pii.KINDS[kind], text[a:b]) for a, kind, b in pii.added_spans([text], field, [base])[0]]


def test_every_labelled_line_is_found_in_text():
    field = pii.train()
    for line in pii.LABELLED.strip().split("\n"):
        text = re.sub(r"\[(?:email|ip|card|phone) ([^ ].*?)\](?= |$)", r"\1", line)
        wanted = re.findall(r"\[(email|ip|card|phone) ([^ ].*?)\](?= |$)", line)
        base = [(pii.KINDS[kind], text[a:b]) for a, kind, b in pii.base_spans(text)]
        assert sorted(base + added(text, field)) == sorted(wanted), line


def test_long_words_are_read_by_their_parts():
    field = pii.train()
    packed = json.dumps({"note": "x" * 60, "mail": "max@firma", "tel": "555-123-4567", "z": ["q"] * 20}, separators=(",", ":"))
    assert added(packed, field) == [("email", "max@firma"), ("phone", "555-123-4567")]
    row = ",".join(["jan", "max@firma", "anna(at)example.com", "tom[at]example.org", *[f"x{i}" for i in range(30)]])
    assert added(row, field) == [("email", "max@firma"), ("email", "anna(at)example.com"), ("email", "tom[at]example.org")]


def test_neighbours_of_base_spans_are_found():
    field = pii.train()
    assert added("tel 0171 555 0199, +44 20 7946 0018", field) == [("phone", "0171 555 0199")]
    assert added("<jane@x.com>,max@firma", field) == [("email", "max@firma")]
    assert added("call +44 20 7946 0018, 0171 555 0199, +44 20 7946 0019, 020 7946 0958", field) == [
        ("phone", "0171 555 0199"),
        ("phone", "020 7946 0958"),
    ]
    assert added("http://10.0.0.12:8080/path and [10.0.0.1]:80", field) == []


def test_quality_rules_on_odd_rows(spark):
    rows = quality.quality_rules(docs_of(spark, ODD, clash=True)).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == by_id[3].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[5].n_words == 14 and not by_id[5].base_failed and by_id[5].kept
    assert by_id[7].n_repeat_words == 30_000 and by_id[7].base_failed
    assert quality.quality_rules(docs_of(spark, [])).collect() == []
    junk = " ".join(f"word{i}###$$$" for i in range(60))
    plain = "the cat sat on a mat and then it ran off to the old house by the sea"

    def spelt(number):
        return "".join(chr(97 + int(d)) for d in str(number))

    many = [(i, plain + " " + " ".join(spelt(1000 * i + k) for k in range(50))) for i in range(200)] + [(999, junk)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs_of(spark, many)).collect()}
    assert not kept[999] and sum(kept.values()) == 200


def test_quality_rules_of_rare_and_unnamed_languages(spark):
    rng = np.random.default_rng(4)

    def text(letters, n):
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(n))

    english = [(i, text("abcdefghijklmnop", 120), "en", "s", 0) for i in range(100)]
    rare = [(1000, "абвгдежзиклмн", "ru"), (1001, "αβγδεζηθικλμν", "el"), (1002, "абвгдежзиклмн", None)]
    rare = [(i, text(letters, 70), lang, "s", 0) for i, letters, lang in rare]
    rows = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(english + rare, DOCS)).collect()}
    assert len(rows) == 103 and all(rows[i].kept for i in (1000, 1001, 1002))
    assert rows[1002].char_distance is None and rows[1002].word_distance is None
    assert rows[1000].char_distance is not None and rows[1000].word_distance is not None


def labelled(spark):
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(600):
        w = [f"plain{k}" for k in rng.integers(0, 60, 25)]
        bad = i % 4 == 0
        if bad:
            w[3] = "idiot"
        docs.append((i, " ".join(w) + (" %%% ### !!" if i % 3 == 0 else "")))
        labels.append((i, int(i % 3 != 0), int(bad)))
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    rows = toxicity.toxicity(docs_of(spark, docs + ODD[:3], clash=True), labels).collect()
    assert len(rows) == 603
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id > 3:
            assert r.predicted == (r.doc_id % 4 == 0)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    none = toxicity.toxicity(docs_of(spark, docs[:3]), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_ordinal(spark):
    docs, labels = labelled(spark)
    rows = ordinal.quality_grades(docs_of(spark, docs, clash=True), labels).collect()
    wrong = sum((r.expected_grade >= 0.5) != (r.doc_id % 3 != 0) for r in rows if r.held_out)
    assert wrong <= 2
    none = ordinal.quality_grades(docs_of(spark, ODD), labels.where("false")).collect()
    assert len(none) == len(ODD) and not any(r.selected for r in none)


def test_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    at = x @ np.array([2.0, -1, 0, 0, 0])
    grade = np.searchsorted([-2.0, 0.0, 2.0], at + rng.logistic(size=600) * 0.3)
    w, cut = ordinal.fit(x, grade, 4)
    assert (np.diff(cut) > 0).all() and len(cut) == 3
    assert (np.searchsorted(cut, x @ w) == grade).mean() > 0.75


def test_language(spark):
    rng = np.random.default_rng(9)
    words = {
        "en": "the of and to in is that it was for".split(),
        "de": "der die und in den von zu das mit sich".split(),
        "fr": "le la les et des en un du une que".split(),
        "es": "el la que de los se las por con una".split(),
    }
    rows = []
    for i in range(400):
        lang = list(words)[i % 4]
        rows.append((i, " ".join(rng.choice(words[lang], 30)), lang, "s", 0))
    rows += [(1000, None, "en", "s", 0), (1001, "123 !", "en", "s", 0), (1002, "the of and it was", None, "s", 0)]
    out = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(out) == 403 and out[1000].lang_pred == out[1001].lang_pred == "und"
    assert out[1002].lang_pred == "en"
    held = [r for r in out.values() if r.held_out and r.doc_id < 400]
    assert held and sum(r.lang_pred != list(words)[r.doc_id % 4] for r in held) <= 1
    empty = language.identify(spark.createDataFrame([], DOCS)).collect()
    assert empty == []


def test_neighbours(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] + [0.0] * 14, 0), (904, [1.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int")
    df = df.withColumn("v", F.lit(1)).withColumn("shard", F.lit(2))
    got = ann.neighbours(df, df.where("vec_id % 20 = 0"), 10, shard_rows=150, query_rows=16).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        assert [s for _, s in by_query[q]] == [d[i] for i, _ in by_query[q]]
        hits += len(set(best) & {i for i, _ in by_query[q]})
        if q in (100, 120, 140):
            assert [i for i, _ in by_query[q]] == best.tolist()
    assert set(by_query) == set(range(0, 600, 20)) and hits >= 0.95 * 300
    few = ann.neighbours(df.where("vec_id < 4"), df.where("vec_id < 1"), 10).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]
    assert ann.neighbours(df.where("false"), df, 10).collect() == []


def test_text_operators_take_empty_tables(spark):
    none = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert jaccard.jaccard_components(none).collect() == []
    assert substrings.repeat_digests(none).collect() == []
    assert substrings.remove_repeats(none).collect() == []
    assert packing.pack_documents(none, public_tokenizers.path(WORD_TOKENIZER)).collect() == []
    assert sentencepieces.encoding_digests(none, public_tokenizers.path(PIECE_MODEL)).collect() == []
    assert pii.find_pii(none).collect() == [] and pii.mask(none).collect() == []
    assert toxicity.toxicity(none, labels).collect() == []
    assert ordinal.quality_grades(none, labels).collect() == []


def test_pipeline_stages(spark, tmp_path):
    clean = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.choice(clean, 80)), "en", "s", 0) for i in range(40)]
    rows.append((100, rows[0][1], "en", "s", 0))  # a copy
    rows.append((101, rows[1][1] + " extra", "en", "s", 0))  # nearly one
    rows.append((102, "too short", "en", "s", 0))
    rows.append((103, " ".join([*rng.choice(clean, 200), *rows[2][1].split()[:60]]), "en", "s", 0))
    rows.append((104, " ".join(rng.choice(clean, 60)) + " mail me@example.com", "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r.asDict() for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {r[0] for r in rows}
    assert set(seen["quality_rules"]) == everything - {102}
    assert set(seen["near_duplicates"]) == everything - {100, 101, 102}
    assert len(seen["repeated_passages"][103]["text"].split()) == 200
    assert seen["personal_data"][104]["text"].endswith("mail <email>")
    assert set(seen["packing"]) == set(seen["personal_data"])
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
