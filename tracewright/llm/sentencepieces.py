"""Merge-type pieces (BPE) without merging: a table of each prefix's last piece, read backwards.

The encoding of a text is the only way to write it in pieces such that every two neighbours are left
alone by merging. So the last piece of the encoding of each prefix is found from left to right: of the pieces that
end there (an automaton finds all), the one that is compatible with the last piece of the prefix before it. From
the end of the text the pieces are then read backwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import batches, only

SPACE = "▁"
#: Words, and pairs of pieces, whose results a task remembers before it forgets them all.
REMEMBERED = 400_000
#: Spaces, each run of them at the start of a word.
WORD = re.compile(f"{SPACE}*[^{SPACE}]*")


class Pieces:
    """Encoder and decoder of a SentencePiece model of the BPE kind with byte fallback and identity normalisation."""

    def __init__(self, model: str):
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
        size = vocabulary.get_piece_size()
        self.text = [vocabulary.id_to_piece(i) for i in range(size)]
        plain = [
            i
            for i in range(size)
            if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i) or vocabulary.is_unused(i))
        ]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: vocabulary.get_score(i) for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if vocabulary.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.begin, self.end = vocabulary.bos_id(), vocabulary.eos_id()
        self.hidden = {i for i in range(size) if vocabulary.is_control(i)}
        self.pairs: dict[tuple[str, str], bool] = {}
        # words that are met again are taken over when the older half is forgotten
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.code = [i.to_bytes(4, "little") for i in range(size)]
        self.shown = [self._shown(i) for i in range(size)]
        # merging starts from single characters, so a piece is of use only if merging gives it from them
        self.whole = {p for p in self.id if len(p) == 1 or self._merged(p) == [p]}
        self.matcher = ahocorasick.Automaton()
        for p in self.whole:
            self.matcher.add_word(p, p)
        self.matcher.make_automaton()
        #: Words stand alone: no piece has a space after another character.
        self.apart = all(SPACE not in p.lstrip(SPACE) for p in self.id)

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text by plain merging: the best score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Does merging leave ``left`` and ``right`` as they are, side by side?"""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs = {}
            known = self.pairs[key] = self._merged(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of ``text``; characters that no piece has stand alone."""
        if text in self.whole:
            return [text]
        last, pairs, settled = list(text), self.pairs, -1
        # matches come in order of their ends, the longest piece first
        for end, piece in self.matcher.iter(text):
            if end == settled:
                continue
            before = end - len(piece)
            if before >= 0:
                left = last[before]
                known = pairs.get((left, piece))
                if known is None:
                    known = self.compatible(left, piece)
                    pairs = self.pairs
                if not known:
                    continue
            last[end], settled = piece, end
        out, i = [], len(text) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            known = self.id.get(p)
            out += [known] if known is not None else [self.byte[b] for b in p.encode()]
        return out

    def bytes_of(self, ids: list[int]) -> bytes:
        """What ids stand for, spaces as such: bytes as they are, control ids as nothing."""
        return b"".join([self.shown[i] for i in ids])

    def _shown(self, i: int) -> bytes:
        if i in self.of_byte:
            return bytes([self.of_byte[i]])
        return b"" if i in self.hidden else self.text[i].replace(SPACE, " ").encode()

    def word(self, word: str) -> tuple[bytes, bytes]:
        """Ids of one word with the spaces before it, as little-endian numbers, and what they decode to."""
        known = self.words.get(word)
        if known is None:
            known = self.older.get(word)
            if known is None:
                found = self.ids(self.split(word))
                known = b"".join([self.code[i] for i in found]), self.bytes_of(found)
            if len(word) <= 64:
                if len(self.words) >= REMEMBERED // 2:
                    self.older, self.words = self.words, {}
                self.words[word] = known
        return known

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end, as little-endian numbers, and the bytes that decode() gives for them."""
        ids, decoded = [self.code[self.begin]], []
        if text:
            text = SPACE + text.replace(" ", SPACE)
            for word in WORD.findall(text) if self.apart else [text]:
                if word:
                    found = self.words.get(word) or self.word(word)
                    ids.append(found[0])
                    decoded.append(found[1])
        ids.append(self.code[self.end])
        whole = b"".join(decoded)
        return b"".join(ids), whole[1:] if whole.startswith(b" ") else whole

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        whole = self.bytes_of(ids).decode(errors="replace")
        return whole[1:] if whole.startswith(" ") else whole


@lru_cache(maxsize=2)
def _pieces(model: str) -> Pieces:
    """One for all tasks of a worker."""
    return Pieces(model)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row of ``docs`` (``doc_id, text``): ids (begin and end included) as
    little-endian unsigned 32-bit numbers and the text that they decode to, both as bytes.

    A null text counts as empty: begin and end alone. ``model`` is a file that every executor has.
    """
    return _encoded(docs, model, lambda x: x, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def encoding_digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode_documents``, hashed where they are made."""
    kinds = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, model, lambda x: hashlib.sha256(x).hexdigest(), kinds)


def _encoded(docs: DataFrame, model: str, shown, schema: str) -> DataFrame:
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kind = pa.binary() if "binary" in schema else pa.string()

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches(parts, 200):
            found = [pieces.encode(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].cast(pa.int64()),
                    pa.array([len(x) // 4 for x, _ in found], pa.int64()),
                    pa.array([shown(x) for x, _ in found], kind),
                    pa.array([shown(x) for _, x in found], kind),
                ],
                names,
            )

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(task, schema)
