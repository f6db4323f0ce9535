"""Phrases, benchmark windows and conversation repair against plain versions, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import collocations, conversations, decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ["_row", "size", "word", "id", "n", "c0", "place", "kinds", "part", "item_id", "_doc", "window", "copies", "_at"]


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


# phrases


def plain_phrases(rows, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        count = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        kept = []
        for p, a in candidates.items():
            if p in most and 100 * most[p] >= 80 * a:
                continue
            cuts = [(2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]], score))
        for rank, (_, _, phrase, a, l, r, score) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, n[lang], score))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    names = ["the", "The", "of", "é", "漢字", "new", "york", "City", "a-b", "\x00", "x\xa0y"]
    rows = [(None, "en"), ("", None), (" \t \n", "de"), ("one", "de"), ("the of the of.the", None)]
    for _ in range(60):
        words = rng.choices(names, [9, 3, 8, 2, 2, 5, 5, 4, 1, 1, 1], k=rng.randint(0, 60))
        marks = rng.choices([" ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b"], [20, 2, 1, 1, 1, 1, 1, 1], k=len(words))
        rows.append(("".join(w + m for w, m in zip(words, marks)), rng.choice(["en", "en", "de", None, "und"])))
    return rows + [("big apple pie " * 3000, "en")] + [rows[7]] * 5


@pytest.mark.parametrize("budget", [1 << 20, 40])
def test_phrases_against_plain_counts(spark, budget):
    rows = phrase_rows(budget)
    docs = clashing(spark.createDataFrame(rows, "text string, lang string")).repartition(5)
    found = collocations.collocations(docs, least=4, top=60, budget=budget)
    assert sorted(map(tuple, found.collect())) == plain_phrases(rows, 4, 60)
    assert [t for _, t in found.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).collect() == []


def test_collocations_attach_little_through_the_driver(spark):
    phrases = spark.createDataFrame([(1, 2, 0, 0, 2, 30)], "c0 bigint, c1 bigint, c2 bigint, c3 bigint, size int, a bigint")
    parts = spark.createDataFrame([(1, 0, 0, 40), (2, 0, 0, 60)], "p0 bigint, p1 bigint, p2 bigint, f bigint")
    for size in (1 << 20, 20 << 20):
        found = collocations._scored(phrases, parts, size)
        hinted = "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
        assert hinted == (size == 1 << 20)
        assert [(r.l, r.r, r.score) for r in found.collect()] == [(40, 60, 600000)]


def test_shares_keep_what_has_the_same_first_words_together():
    rng = np.random.default_rng(2)
    columns = [rng.integers(1, 5, 4000).astype(np.uint64) for _ in range(4)]
    words, places = np.unique(columns[0], return_counts=True)
    shares = collocations.Shares(words[:3], places[:3], 60)
    while shares.deepen(np.bincount(slot[slot >= 0], minlength=shares.slots) if (slot := shares.place(columns)[0]) is not None else None):
        pass
    slot, depth = shares.place(columns)
    assert (slot >= 0).tolist() == (columns[0] < 4).tolist() and set(depth[slot < 0]) == {1} and len(shares.levels) == 3
    together = {}
    for i, row in enumerate(zip(*columns)):
        assert together.setdefault(row[: depth[i]], slot[i]) == slot[i]


# benchmark windows


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_leaks(docs, items, width):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                items_here = windows.get(tuple(w[i : i + size]))
                if items_here is not None:
                    hit |= set(range(i, i + size))
                    found |= items_here
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out, windows


def leak_rows(seed):
    rng = random.Random(seed)
    def words(n):
        return [rng.choice(["alpha", "Beta", "gamma's", "δέλτα", "42", "x", "y"]) for _ in range(n)]

    items = [(i, " ".join(words(rng.randint(1, 14)))) for i in range(8, 20)]
    items += [(1, None), (2, ""), (3, " !? "), (None, "no id has this"), (4, items[0][1].upper()), (4, items[0][1])]
    docs = [(1, None), (2, ""), (3, "..."), (None, items[3][1]), (5, "say: No id HAS this!")]
    for i in range(10, 60):
        text = words(rng.randint(0, 40))
        if rng.random() < 0.6:
            at = rng.randint(0, len(text))
            text[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [docs[10]] * 3 + [(70, " ".join(words(20_000)))]
    return docs, [(i, t if t is None or rng.random() < 0.5 else f"({t}).") for i, t in items]


def rows_of(spark, pairs, name):
    return clashing(spark.createDataFrame(pairs, "key bigint, text string")).withColumn(name, F.col("key")).drop("key")


@pytest.mark.parametrize("width", [3, 10])
def test_leaks_against_all_windows(spark, width):
    docs, items = leak_rows(width)
    items = spark.createDataFrame(items, "item_id bigint, text string"), items
    found = decontamination.contamination(rows_of(spark, docs, "doc_id"), items[0], width)
    expected, _ = plain_leaks(docs, items[1], width)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_decontaminate_cuts_words_and_keeps_the_rest(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, f"Before, {item.upper()}! After."),
        (2, "nothing. here"),
        (3, item),
        (4, None),
        (5, f"{item} ... end ... {item}"),
        (6, ""),
    ]
    df = rows_of(spark, docs, "doc_id")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    cut = decontamination.decontaminate(df, items)
    assert cut.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts == {1: "Before! After.", 2: "nothing. here", 4: None, 5: " ... end", 6: ""}
    whole = decontamination.decontaminate(df, items, remove="documents")
    assert whole.columns == df.columns and {r["doc_id"] for r in whole.collect()} == {2, 4, 6}


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in decontamination.contamination(docs, none).collect()] == [(1, 2, 0, 0, empty, False)]
    assert decontamination.contamination(docs.limit(0), none).collect() == []


# conversations


def plain_audit(kinds):
    """The cheapest edits of rows (role initial, must go, truncated), by trying all."""
    after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    put = {0: 2, 1: 2, 2: 3, 3: 2}

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(kinds):
            if state in (0, 3):
                found.append((0, ""))
        else:
            role, gone, late = kinds[i]
            steps = [("D", 4, state)]
            if not gone:
                if state in after.get(role, {}):
                    steps.append(("K", 3 * late, after[role][state]))
                steps.append(("R", 3 + 3 * late, put[state]))
            for letter, cost, then in steps:
                c, rest = best(i + 1, then, 0)
                found.append((cost + c, letter + rest))
        if inserted < 3:
            c, rest = best(i, put[state], inserted + 1)
            found.append((3 + c, "I" + rest))
        return min(found, default=(float("inf"), ""))

    for i in reversed(range(len(kinds))):  # so that no call is deep
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def plain_repair(rows):
    """``rows``: (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, kinds, count = set(), [], Counter()
    for _, role, text in rows:
        shown = text.strip(" \t\n\v\f\r")
        blank, again = not shown, (role, text) in seen
        late = not blank and not again and shown[-1] not in ".!?"
        seen.add((role, text))
        count["blank"] += blank
        count["duplicate"] += again and not blank
        count["truncated"] += late
        kinds.append((role[:1], blank or again, late))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    cost, audit = plain_audit(tuple(kinds))
    turns = {t for t, _, _ in rows if t is not None}
    out, at, last = [], 0, None
    for letter in audit:
        here = rows[at] if letter != "I" else (None, "", "")
        at += letter != "I"
        if letter == "D":
            continue
        role = here[1] if letter == "K" else "assistant" if last == "u" else "user"
        last = role[0]
        out.append((letter, here[0], role, here[2]))
    text = "\n".join(f"{role}:{text}" for _, _, role, text in out)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256(text.encode()).hexdigest()
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest), out


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role or (" " if role is None else role), " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def talk_rows(seed, conversations_n=150):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", None, "", "Sys", "uncle"]
    texts = ["Hi.", "Why?", "no end", "", None, " \n", "Good! ", "same.", "é…", "ok. "]
    rows = []
    for conv in range(conversations_n):
        for turn in range(rng.randint(1, 14)):
            number = None if rng.random() < 0.05 else turn if rng.random() < 0.9 else rng.randint(0, 20)
            usual = "system" if turn == 0 and rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            role = usual if rng.random() < 0.8 else rng.choice(roles)
            text = f"text {rng.randint(0, 9)}{rng.choice(['.', '!', ''])}" if rng.random() < 0.8 else rng.choice(texts)
            rows.append((conv if conv else None, number, role, text))
    return rows + rows[40:60] + [(7, t, "user", "again.") for t in range(500)] + [(7, 3, "user", "again.")] * 200


def test_repair_against_all_edits(spark):
    rows = talk_rows(5)
    df = clashing(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).repartition(7)
    damaged = conversations.damage(df)
    expected_rows = plain_damage(rows)
    assert Counter(map(tuple, damaged.collect())) == Counter(expected_rows)
    found = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_digests(damaged, df).collect()}
    assert set(found) == {r[0] for r in rows}
    repaired = {}
    for r in sorted(conversations.repair(damaged).collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        repaired.setdefault(r["conv_id"], []).append((r["edit"], r["turn"], r["role"], r["text"]))
    for conv in found:
        mine = [r[1:] for r in expected_rows if r[0] == conv]
        expected, out = plain_repair(mine)
        assert found[conv] == expected, conv
        assert repaired.get(conv, []) == out


def test_blocks_against_all_edits():
    rng = random.Random(11)
    table = conversations.Tables()
    for _ in range(3000):
        kinds = bytes(rng.choices(range(conversations.KINDS), [2, 1, 1, 4, 1, 4, 1, 1, 1], k=rng.randint(0, 11)))
        plain = tuple(("sua?"[(k - 1) // 2] if k else "u", not k, k > 0 and k % 2 == 0) for k in kinds)
        cost, audit = plain_audit(plain)
        assert table.audit(kinds) == (audit, cost)


def test_conversations_of_nothing(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    none = spark.createDataFrame([], schema)
    ids = spark.createDataFrame([(1, 1, "user", "a"), (None, 1, "user", "a")], schema)
    empty = hashlib.sha256(b"").hexdigest()
    assert conversations.repair_digests(none, none).collect() == []
    assert conversations.repair(none).collect() == []
    found = sorted(map(tuple, conversations.repair_digests(none, ids).collect()), key=str)
    assert found == [(1, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]


def test_text_ids(spark):
    rows = [("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes."), ("b", 0, "assistant", "No.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found = {r["conv_id"]: r["audit"] for r in conversations.repair_digests(df, df).collect()}
    assert found == {"a": "KK", "b": "IK"}
