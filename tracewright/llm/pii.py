"""Personal data: fixed rules, and a linear-chain conditional random field over word shapes.

The field is trained on the driver from ``LABELLED``, a small table of lines written for it, and
decoded by Viterbi for many lines at once. It adds spans where no rule has found one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import batches, only

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *KINDS)

#: Lines with the spans to find as ``[kind text]``.
LABELLED = """
call me on [phone 555-123-4567] after six
my number is [phone 0171 555 0199] thanks
phone: [phone (212) 555-0187] or write
tel [phone 020 7946 0958] ask for the desk
ring [phone 1-800-555-0123] now
mobile [phone 07700 900123] please
fax [phone 555.867.5309] and
phone [phone 030/123456] in the morning
contact [phone +44 20 7946 0018] or mail
reach us at [phone +1 (415) 555-2671] today
write to [email jane.doe@example.com] soon
mail [email sales@shop.example.org] for prices
e-mail [email j_smith99@mail.example.net] and wait
contact [email info@localhost] please
send it to [email max@firma] or call
write [email anna(at)example.com] today
mail [email tom[at]example.org] for more
the server [ip 10.0.0.12] is down
ping [ip 192.168.1.254] first
host [ip 172.16.254.1] answered
address [ip 2001:db8::ff00:42:8329] was used
from [ip fe80::1ff:fe23:4567:890a] to us
paid with [card 4111 1111 1111 1111] yesterday
card number [card 5500-0000-0000-0004] expires
charged to [card 4012888888881881] twice
visa [card 4222222222222] ok
the [card 378282246310005] was declined
in 2019 there were 34 of them
on 12.05.2021 we met
at 10:30 the bus left
version 3.2.1 of the tool
see section 4.0 and 4.1
the price is $19.99 for 2
item 48213 costs 1,299.00
commit 9f86d081884c7d65 was reverted
key = a8f5f167f44f4964e6c998dee827110c
token = "d41d8cd98f00b204e9800998ecf8427e" kept
id 7c9e6679-7425-40de-944b-e07fc1f90ae7 found
room 101 is on floor 1
chapter 12 of book 3
dated 2021-03-04 and signed
born 1984 in town
the score was 3-2 at last
licensed under version 2.0 of 2004
order 2021/33 is late
it has 1000000 rows
row 123456789 of 987654321
serial 00112233445566 is new
about 99.9 % of 100
follow @someone and @other
see https://example.com/a/1 for it
the of and to in was a plain line
words only, nothing else here.
temperature -12.5 or +3 degrees
ratio 16:9 and 4:3
ISBN 978-3-16-148410-0 in print
a1 b2 c3 d4 e5
x = 42 ; y = 7
page 10 - 20
a@ b and @ c
"""


def _runs(text: str) -> str:
    """Shape of a word: letters a or A, digits 9, other characters as they are; repeats as their first, doubled."""
    out = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", text)))
    return re.sub(r"(.)\1{2,}", r"\1\1", out)[:24]


def features(words: list[str]) -> list[list[str]]:
    """Names of what holds of each word, its shape and those beside it."""
    shape = ["", "", *[_runs(w) for w in words], "", ""]
    out = []
    for i, w in enumerate(words):
        digits = sum(c.isdigit() for c in w)
        named = [f"s={shape[i + 2]}", f"n={min(digits, 20)}", f"l={min(len(w), 20)}", f"p={shape[i + 1]}"]
        named += [f"q={shape[i + 3]}", f"b={shape[i + 1]}|{shape[i + 2]}", f"x={shape[i + 2]}|{shape[i + 3]}"]
        named += [f"g={''.join(sorted(set(re.sub('[^@.:+()/-]', '', w))))}", f"h={bool(re.fullmatch('[0-9a-f-]{16,}', w))}"]
        named += [f"@={'@' in w[1:-1]}", f"d={digits == len(w)}{min(digits, 20)}", "1"]
        out.append(named)
    return out


def _parse(line: str) -> tuple[list[str], list[int]]:
    words, tags = [], []
    for part in re.split(r"(\[(?:email|ip|card|phone) [^ ].*?\](?= |$))", line):
        kind, text = (part[1:-1].split(" ", 1)) if part.startswith("[") and part[1:].split(" ")[0] in KINDS else ("O", part)
        for w in text.split():
            words.append(w)
            tags.append(TAGS.index(kind))
    return words, tags


class Field:
    """Weights of a linear chain: ``emit`` (feature by tag), ``step`` (tag to tag)."""

    def __init__(self, lines: list[tuple[list[str], list[int]]], rounds: int = 250, rate: float = 0.1, penalty: float = 0.02):
        rows = [features(w) for w, _ in lines]
        self.known = {f: i for i, f in enumerate(sorted({f for r in rows for w in r for f in w}))}
        size, tags = len(self.known), len(TAGS)
        ids = [[[self.known[f] for f in w] for w in r] for r in rows]
        self.emit, self.step = np.zeros((size + 1, tags)), np.zeros((tags, tags))
        sums = [np.zeros_like(self.emit), np.zeros_like(self.step)]
        for _ in range(rounds):
            g_emit, g_step = penalty * self.emit, penalty * self.step
            for x, (_, y) in zip(ids, lines):
                score = np.array([self.emit[w].sum(axis=0) for w in x])
                one, two = self._marginals(score)
                for i, w in enumerate(x):
                    p = one[i].copy()
                    p[y[i]] -= 1
                    np.add.at(g_emit, w, p)
                for i in range(len(x) - 1):
                    g_step += two[i]
                    g_step[y[i], y[i + 1]] -= 1
            for value, grad, seen in ((self.emit, g_emit, sums[0]), (self.step, g_step, sums[1])):
                seen += grad * grad
                value -= rate * grad / (np.sqrt(seen) + 1e-8)
        self.emit[size] = 0.0

    def _marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, tags = score.shape
        ahead, back = np.zeros((n, tags)), np.zeros((n, tags))
        ahead[0] = score[0]
        for i in range(1, n):
            ahead[i] = score[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + self.step, axis=0)
        for i in range(n - 2, -1, -1):
            back[i] = np.logaddexp.reduce(self.step + (score[i + 1] + back[i + 1])[None, :], axis=1)
        whole = np.logaddexp.reduce(ahead[-1])
        two = [
            np.exp(ahead[i][:, None] + self.step + (score[i + 1] + back[i + 1])[None, :] - whole)
            for i in range(n - 1)
        ]
        return np.exp(ahead + back - whole), np.array(two)

    def emissions(self, words: list[str]) -> np.ndarray:
        rest = len(self.known)
        return np.array([self.emit[[self.known.get(f, rest) for f in w]].sum(axis=0) for w in features(words)])

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of many chains, worked through together from the longest on."""
        if not scores:
            return []
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        longest, out = len(scores[order[0]]), [None] * len(scores)
        sizes = np.array([len(scores[i]) for i in order])
        best = np.stack([scores[i][0] for i in order])
        came = []
        for t in range(1, longest):
            live = int((sizes > t).sum())
            ways = best[:live, :, None] + self.step[None]
            came.append(ways.argmax(axis=1))
            best = np.concatenate([ways.max(axis=1) + np.stack([scores[i][t] for i in order[:live]]), best[live:]])
        last = best.argmax(axis=1)
        for row, i in enumerate(order):
            tags = np.empty(sizes[row], int)
            tags[-1] = last[row]
            for t in range(sizes[row] - 1, 0, -1):
                tags[t - 1] = came[t - 1][row, tags[t]]
            out[i] = tags
        return out


def train(labelled: str = LABELLED) -> Field:
    return Field([_parse(x) for x in labelled.strip().split("\n")])


IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed rules find, sorted; time grows with the length of the text only."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in NAME:
            start -= 1
        found = AFTER_AT.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(done, at + 1))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What words of the kinds in ``LABELLED`` have: a digit, an at sign, or one spelt out in brackets.
TOLD = re.compile(r"[0-9@]|\(at\)|\[at\]", re.IGNORECASE)
#: Plain words on either side of a told word that are decoded with it.
BESIDE = 2
#: Longer words are split at signs that stand in no kind; what is still longer, at all signs but those inside names.
LONGEST = 80
PART = re.compile(r"(?:[^\x20\x09-\x0D\"',;{}<>|=&\\\[\]]|\[at\])+", re.IGNORECASE)
BIT = re.compile(r"(?:[\w@.+%-]|\(at\)|\[at\])+", re.IGNORECASE)


def _words(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Places of the words between ``start`` and ``end``, long ones as their parts."""
    out = []
    for m in WORD.finditer(text, start, end):
        if m.end() - m.start() <= LONGEST:
            out.append(m.span())
            continue
        for part in PART.finditer(text, m.start(), m.end()):
            if part.end() - part.start() <= LONGEST:
                out.append(part.span())
            else:
                out += [bit.span() for bit in BIT.finditer(text, part.start(), part.end())]
    return out


#: Not part of a span at its ends.
ENDS = "\"'<>,;:.!?=|"


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, _, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(text: str, words: list[tuple[int, int]], base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``words`` cut where a span of ``base`` starts or ends inside them; pieces of signs alone beside a span go."""
    out = []
    for a, b in words:
        k = bisect_right(base, a, key=lambda x: x[1])
        if k == len(base) or base[k][0] >= b:
            out.append((a, b))
            continue
        while k < len(base) and base[k][0] < b:
            out += _bare(text, a, base[k][0])
            out.append((max(a, base[k][0]), min(b, base[k][1])))
            a = base[k][1]
            k += 1
        out += _bare(text, a, b)
    return out


def _bare(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The place without signs at its ends, where letters or digits are left."""
    inner = text[start:end]
    a, b = start + len(inner) - len(inner.lstrip(ENDS)), end - len(inner) + len(inner.rstrip(ENDS))
    return [(a, b)] if a < b and any(c.isalnum() for c in inner) else []


def _chains(text: str, base: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Stretches of words to decode: those that are told, and what stands beside them on their line. Spans of
    ``base`` are words of their own."""
    chains, start = [], 0
    for line in text.split("\n"):
        if TOLD.search(line):
            found = _cut(text, _words(text, start, start + len(line)), base)
            told = [i for i, (a, b) in enumerate(found) if TOLD.search(text, a, b)]
            at = 0
            while at < len(told):
                end = at
                while end + 1 < len(told) and told[end + 1] - told[end] <= 2 * BESIDE:
                    end += 1
                chains.append(found[max(0, told[at] - BESIDE) : told[end] + BESIDE + 1])
                at = end + 1
        start += len(line) + 1
    return chains


def added_spans(texts: list[str], field: Field, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the field finds in each text beside ``base``: runs of equally tagged words with only white space between
    them, without signs at their ends, as far as no span of ``base`` covers them."""
    owner, places, scores = [], [], []
    covers = [_merged(spans) for spans in base]
    for k, text in enumerate(texts):
        if TOLD.search(text):
            for chain in _chains(text, covers[k]):
                owner.append(k)
                places.append(chain)
                scores.append(field.emissions([text[a:b] for a, b in chain]))
    out = [[] for _ in texts]
    for k, chain, tags in zip(owner, places, field.decode(scores)):
        cover = covers[k]
        at = [bisect_right(cover, a, key=lambda x: x[1]) for a, _ in chain]
        free = [c == len(cover) or b <= cover[c][0] for c, (_, b) in zip(at, chain)]
        i = 0
        while i < len(chain):
            j = i
            while (
                j + 1 < len(chain)
                and tags[j + 1] == tags[i]
                and free[j + 1] == free[i]
                and texts[k][chain[j][1] : chain[j + 1][0]].isspace()
            ):
                j += 1
            if tags[i] and free[i]:
                out[k] += [(a, int(tags[i]) - 1, b) for a, b in _bare(texts[k], chain[i][0], chain[j][1])]
            i = j + 1
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs`` (``doc_id, text``).

    The counts and the hash are of what the fixed rules find; ``spans`` also has what the field adds. Spans are
    ``kind:start:end`` in code points, by start and then kind. A null text counts as empty and has none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train())
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches(parts, 500):
            texts = batch["text"].to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, field, base)
            rows = [[sum(k == x[1] for x in b) for b in base] for k in range(len(KINDS))]
            hashed = [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]
            spans = [listed(sorted(b + m)) for b, m in zip(base, more)]
            columns = [batch["doc_id"].cast(pa.int64()), *[pa.array(r, pa.int64()) for r in rows]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hashed, pa.string()), pa.array(spans, pa.string())], names)

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(task, f"doc_id bigint, {kinds}, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; overlapping spans as one, named
    after the first. Null texts stay null, and all other columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train())
    schema = docs.schema

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 500):
            texts = [t or "" for t in batch["text"].to_pylist()]
            base = [base_spans(t) for t in texts]
            out = []
            for text, found in zip(texts, [b + m for b, m in zip(base, added_spans(texts, sent.value, base))]):
                kept, at = [], 0
                for a, kind, b in sorted(found):
                    if a >= at:
                        kept += [text[at:a], f"<{KINDS[kind]}>"]
                    at = max(at, b)
                out.append("".join([*kept, text[at:]]))
            known = batch["text"].is_valid().to_pylist()
            values = pa.array([t if v else None for t, v in zip(out, known)], batch["text"].type)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", values)

    return docs.mapInArrow(task, schema)
