"""Exact Jaccard join of word-shingle sets by index lists that skip, and answers taken over from similar sets.

Lists. Each set enters its first tokens (a prefix long enough that two linked sets share one) into lists by
token. Tokens that fill long lists come last in the common order, so that few sets enter them. A list is held in order
of set size, with the position of the token in each set; sizes and positions bound what two sets can share, so whole
blocks of a list are passed over.

Answers. In each list the most central set is the leader, and all others are compared with it. What two sets
share is then bounded by what each shares with their leader: most pairs are decided, either way, without
looking at them. Sets that already hang together are not compared at all, since only components are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..session import drop_settled, settle
from .components import components
from .text import all_shingles, batches, grouped, only, word_hashes

#: Lists longer than this come late in the order of tokens.
LONG_LIST = 64
#: Bits that mark such tokens, by hash; a token marked by chance only moves back in the order.
MARK_BITS = 22
#: Bits of a set's parities for each element, at least.
PARITY = 8
#: Sets that share less than this part of the greater one are not counted as similar to their leader.
NEAR = 0.6
#: Near sets of one leader that are compared in one task.
CHUNK = 2048


def required(n_x, n_y, percent: int):
    """Least intersection of linked sets of these sizes."""
    return -(-percent * (n_x + n_y) // (100 + percent))


def prefix(n, percent: int):
    """So many first tokens: linked sets have one of them in common."""
    return n - (percent * n + 99) // 100 + 1


def _marked(tokens: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = tokens >> np.uint64(64 - MARK_BITS)
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    values, offsets = word_hashes(pc.ascii_lower(batch["text"]))
    for i, s in enumerate(all_shingles(values, offsets, width)):
        s = np.sort(s)
        new = s[1:] != s[:-1]
        yield i, s if new.all() else s[np.append(True, new)]


def _sizes(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, id, n_shingles) of every row of ``rows`` (doc_id, id, text)."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 500):
            size = pa.array([len(s) for _, s in _sets(batch, width)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["id"], size], ["doc_id", "id", "n_shingles"])

    return rows.select("doc_id", "id", "text").mapInArrow(task, "doc_id bigint, id bigint, n_shingles bigint")


def _entries(rows: DataFrame, width: int, percent: int, marks: bytes | None) -> DataFrame:
    """(token, id, n, pos) of each set's prefix; without marks only the tokens of a somewhat longer one."""
    sent = rows.sparkSession.sparkContext.broadcast(marks)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if sent.value is None else np.frombuffer(sent.value, np.uint8)
        for batch in batches(parts, 500):
            tokens, owner, size, pos = [], [], [], []
            for i, s in _sets(batch, width):
                n = len(s)
                if not n:
                    continue
                k = prefix(n, percent)
                if table is None:
                    k += k // 4 + 4
                elif (late := _marked(s, table)).any():
                    s = np.concatenate([s[~late], s[late]])
                s = s[:k]
                tokens.append(s)
                owner.append(np.full(len(s), i))
                size.append(np.full(len(s), n))
                pos.append(np.arange(len(s)))
            tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            if table is None:
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], ["token"])
                continue
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, size, pos)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.view(np.int64)), batch["id"].take(pa.array(flat[0])), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.int32())],
                ["token", "id", "n", "pos"],
            )

    schema = "token bigint" if marks is None else "token bigint, id bigint, n int, pos int"
    return rows.mapInArrow(task, schema)


def _comparable(token: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int, longest: int) -> np.ndarray:
    """Which entries have another one in their list that sizes and positions let them be linked with; ``token`` and ``n`` are
    in order. Entries of lists longer than ``longest`` all count."""
    n, left = n.astype(np.int64), n.astype(np.int64) - pos
    cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    length = np.repeat(np.diff(cuts), np.diff(cuts))
    after = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(token)) - 1
    kept = length > longest
    one, ahead = np.flatnonzero(~kept & (after > 0)), 1
    while len(one):
        one = one[n[one + ahead] * percent <= n[one] * 100]  # those further on are no smaller
        other = one + ahead
        hit = np.minimum(left[one], left[other]) >= required(n[one], n[other], percent)
        kept[one[hit]] = kept[other[hit]] = True
        ahead += 1
        one = one[after[one] >= ahead]
    return kept


def _lists(entries: DataFrame, percent: int, longest: int) -> DataFrame:
    """(token, id, n, pos, m): the entries of each list that have another to be compared with, and how many there are.

    Two linked sets pass sizes and positions in the list of their first common token, so that no link is lost, and what
    merely shares a token with others is neither compared with a leader nor moved again.
    """

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(parts):
            token, n, pos = (table[c].to_numpy() for c in ("token", "n", "pos"))
            same = token[1:] == token[:-1]
            at = np.flatnonzero(np.append(same, False) | np.append(False, same))
            at = at[np.lexsort((n[at], token[at]))]
            at = at[_comparable(token[at], n[at], pos[at], percent, longest)] if len(at) else at
            if not len(at):
                continue
            _, place, m = np.unique(token[at], return_inverse=True, return_counts=True)
            found = table.take(pa.array(at)).append_column("m", pa.array(m[place], pa.int64()))
            yield from found.combine_chunks().to_batches()

    # sizes are put in order inside the lists, of which most have one entry only
    rows = entries.repartition("token").sortWithinPartitions("token")
    return rows.mapInArrow(task, "token bigint, id bigint, n int, pos int, m bigint")


def _whole_lists(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, sorted by token, in tables that end where a list does."""
    held: list[pa.RecordBatch] = []
    for batch in parts:
        token = batch["token"].to_numpy()
        if not len(token):
            continue
        cut = int(np.searchsorted(token, token[-1]))  # the last list may go on
        if held and (cut or held[-1]["token"][-1].as_py() != token[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _long_lists(rows: DataFrame, width: int, percent: int, longest: int) -> bytes:
    """Bits set for tokens of lists longer than ``longest``: 2^MARK_BITS bits however many there are."""
    counted = _entries(rows, width, percent, None).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > longest)
    place = F.shiftrightunsigned("token", 64 - MARK_BITS)
    placed = counted.select(place.alias("place"))
    bits = placed.groupBy(F.shiftright("place", 5).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(place & 31 as int)))").alias("bits")
    )
    table = np.zeros(1 << (MARK_BITS - 5), np.uint32)
    for r in bits.collect():  # at most 2^(MARK_BITS - 5) rows
        table[r["at"]] = r["bits"]
    return table.tobytes()


def _parities(rows: DataFrame, width: int) -> DataFrame:
    """(id, n, parity): set sizes, and for each of so many bits whether an odd number of tokens falls there."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 500):
            size, parity = [], []
            for _, s in _sets(batch, width):
                bits = 1 << max(6, math.ceil(math.log2(PARITY * len(s) + 1)))
                odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                size.append(len(s))
                parity.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(size, pa.int32()), pa.array(parity, pa.binary())], ["id", "n", "parity"])

    return rows.mapInArrow(task, "id bigint, n int, parity binary")


def _folded(a: np.ndarray, size: int) -> np.ndarray:
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def _most_shared(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """A bound from parities: bits that differ are elements in one set only."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    differ = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
    return min(n_a, n_b, (n_a + n_b - differ) // 2)


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, most): an upper bound of what each pair shares."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            cols = [batch[c].to_pylist() for c in ("of_a", "of_b", "n_a", "n_b")]
            most = pa.array([_most_shared(*row) for row in zip(*cols)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("a", "b", "n_a", "n_b")] + [most], ["a", "b", "n_a", "n_b", "most"])

    x = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("of_a"))
    y = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("of_b"))
    rows = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b")
    return rows.mapInArrow(task, "a bigint, b bigint, n_a int, n_b int, most int")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, n_a, n_b, shared, inside, private), counted on the sets, which are made of the texts once more: ``inside`` has a bit
    for each element of ``a`` that ``b`` has as well, ``private`` the elements that only ``b`` has. ``pairs`` is settled."""

    def sets_of(column: pa.Array) -> list[np.ndarray]:
        coded = column.dictionary_encode()
        distinct = pa.RecordBatch.from_arrays([coded.dictionary], ["text"])
        found = [s for _, s in _sets(distinct, width)]
        return [found[k] for k in coded.indices.to_pylist()]

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches(parts, 64):
            size_a, size_b, shared, inside, private = [], [], [], [], []
            for x, y in zip(sets_of(piece["of_a"]), sets_of(piece["of_b"])):
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = x[at] == y
                bits = np.zeros(len(x), np.uint8)
                bits[at[both]] = 1
                size_a.append(len(x))
                size_b.append(len(y))
                shared.append(int(both.sum()))
                inside.append(np.packbits(bits).tobytes())
                private.append(y[~both].tobytes())
            found = [pa.array(c, pa.int32()) for c in (size_a, size_b, shared)] + [pa.array(c, pa.binary()) for c in (inside, private)]
            yield pa.RecordBatch.from_arrays([piece["a"], piece["b"], *found], ["a", "b", "n_a", "n_b", "shared", "inside", "private"])

    def side(name: str) -> DataFrame:
        named = texts.select(F.col("id").alias(name), F.col("text").alias(f"of_{name}"))
        return attach(named, pairs.select(name).distinct(), [name], "left_semi")

    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b")
    return rows.mapInArrow(task, "a bigint, b bigint, n_a int, n_b int, shared int, inside binary, private binary")


def _linked(percent: int, shared: str = "shared") -> Column:
    return F.col(shared) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))


def _left_over(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each list that neither sizes nor positions nor the leader decide, and that are in different
    components and not both near their leader."""

    def of(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        m = len(x["id"])
        left, right = [], []
        if len(np.unique(x["label"])) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n, pos, got, label, near = x["n"], x["pos"], x["most"], x["label"], x["near"]
        for q in range(m - 1):
            # the block of sizes that can be linked to this one
            end = int(np.searchsorted(n, n[q] * 100 // percent + 1))
            if end <= q + 1:
                continue
            o = slice(q + 1, end)
            need = required(n[q] + np.zeros(end - q - 1, np.int64), n[o], percent)
            after = 1 + np.minimum(n[q] - pos[q] - 1, n[o] - pos[o] - 1)
            led = np.minimum(got[q], got[o]) + np.minimum(x["beside"][q], x["beside"][o])
            may = (after >= need) & (led >= need) & (label[o] != label[q]) & ~(near[o] & near[q])
            hit = np.flatnonzero(may) + q + 1
            left.append(np.full(len(hit), x["id"][q]))
            right.append(x["id"][hit])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.concatenate(left), np.concatenate(right)
        return np.minimum(a, b), np.maximum(a, b)

    names = ["id", "n", "pos", "label", "most", "beside", "near"]

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            token = table["token"].to_numpy()
            cols = {c: table[c].to_numpy() for c in names}
            cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            found = [of({c: v[a:b] for c, v in cols.items()}) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
            pairs = np.array([np.concatenate(x) for x in zip(*found)]) if found else np.zeros((2, 0), np.int64)
            pairs = np.unique(pairs, axis=1) if pairs.size else pairs
            return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])

        yield from map(out, _whole_lists(parts))

    rows = lists.repartition("token").sortWithinPartitions("token", "n", "id").select("token", *names)
    return rows.mapInArrow(task, "a bigint, b bigint").distinct()


class _Groups:
    """Labels that have been joined."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def of(self, x: int) -> int:
        while x in self.above:
            x = self.above[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.of(x), self.of(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


def _near_links(near: DataFrame, percent: int) -> DataFrame:
    """Links between sets near the same leader, as many as it takes to join their labels.

    ``near``: (leader, of, id, n, label, inside, private), ``of`` being the number of the leader's near sets. What two
    sets share follows from what each has of the leader (one matrix product for all pairs) and, where this does not
    decide, from the few elements that the leader lacks. A leader with more than ``CHUNK`` near sets has them in chunks, and each pair of chunks is a task's work.
    """
    rows = near.withColumn("chunks", F.ceil(F.col("of") / CHUNK).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))

    def of_one(table: pa.Table) -> list[tuple[int, int]]:
        n, ids, chunk, label = (table[c].to_numpy() for c in ("n", "id", "chunk", "label"))
        n = n.astype(np.int64)
        names, label = np.unique(label, return_inverse=True)
        across = table["lo"][0].as_py() != table["hi"][0].as_py()
        found, groups = [], _Groups()
        if len(names) > 1:
            bits = np.stack([np.frombuffer(x, np.uint8) for x in table["inside"].to_pylist()])
            private = [np.frombuffer(x, np.uint64) for x in table["private"].to_pylist()]
            token, count = np.unique(np.concatenate(private), return_counts=True)
            again = token[count > 1]
            private = [frozenset(x[np.isin(x, again, assume_unique=True)].tolist()) for x in private]
            extra = np.array([len(x) for x in private])
            for lo in range(0, len(n), 256):
                q = np.arange(lo, min(lo + 256, len(n)))
                end = int(np.searchsorted(n, n[q[-1]] * 100 // percent + 1))
                inner = np.zeros((len(q), end - lo), np.float32)
                for c in range(0, bits.shape[1], 256):
                    part = np.unpackbits(bits[lo:end, c : c + 256], axis=1).astype(np.float32)
                    inner += part[: len(q)] @ part.T
                need = required(n[q][:, None], n[None, lo:end], percent)
                may = inner + np.minimum(extra[q][:, None], extra[None, lo:end]) >= need
                may &= label[q][:, None] != label[None, lo:end]
                may &= np.arange(lo, end)[None, :] > q[:, None]
                if across:
                    may &= chunk[q][:, None] != chunk[None, lo:end]
                for i, j in zip(*np.nonzero(may)):
                    x, y = lo + i, lo + j
                    if groups.of(label[x]) == groups.of(label[y]):
                        continue
                    both = inner[i, j] + len(private[x] & private[y])
                    if both >= need[i, j] and groups.join(label[x], label[y]):
                        found.append((ids[x], ids[y]))
        return found

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(parts, keys):
            found = of_one(table) if table.num_rows > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    keys = ["leader", "lo", "hi"]
    tasks = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "n", "id")
    return rows.select(*keys, "id", "n", "label", "chunk", "inside", "private").mapInArrow(task, "a bigint, b bigint")


def set_components(rows: DataFrame, width: int, percent: int, longest: int = LONG_LIST) -> DataFrame:
    """(id, component) of sets that are linked to any other. ``rows``: (id, text), an id for each text."""
    marks = _long_lists(rows, width, percent, longest)
    entries = _entries(rows, width, percent, marks)
    lists = settle(_lists(entries, percent, longest))

    # the most central set of each list: its tokens are those that most others have
    central = lists.groupBy("id").agg(F.sum("m").alias("score"))
    scored = lists.select("id", "token").join(settle(central), "id")
    leaders = scored.groupBy("token").agg(F.max(F.struct(F.col("score"), -F.col("id"))).alias("best"))
    leaders = settle(leaders.select("token", (-F.col("best.col2")).alias("leader")))
    led = lists.drop("m").join(leaders, "token")
    members = lists.select("id").distinct()
    sets = settle(_parities(attach(rows, members, ["id"], "left_semi"), width))

    star = led.where("leader <> id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    bounded = settle(_bounded(star, sets))
    close = F.col("most") >= NEAR * F.greatest("n_a", "n_b")
    exact = settle(_verified(bounded.where(close).select("a", "b"), rows, width))
    label = components(exact.where(_linked(percent)).select("a", "b"))

    # what each set shares with its leader: exactly, or at most
    known = bounded.join(exact.select("a", "b", "shared"), ["a", "b"], "left")
    known = settle(known.select(F.col("a").alias("leader"), F.col("b").alias("id"), F.coalesce("shared", "most").alias("most"), F.col("shared").isNotNull().alias("near")))
    labelled = led.join(label, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    met = labelled.join(known, ["leader", "id"], "left")
    own = F.col("leader") == F.col("id")
    met = met.select(
        "token",
        "leader",
        "id",
        "n",
        "pos",
        "label",
        F.when(own, F.col("n")).otherwise(F.col("most")).alias("most"),
        F.when(own, F.lit(0)).otherwise(F.when(F.col("near"), F.col("n") - F.col("most")).otherwise(F.col("n"))).alias("beside"),
        (own | F.coalesce("near", F.lit(False))).alias("near"),
    )
    met = settle(met)
    drop_settled(lists, leaders, bounded, known)
    rest = _left_over(met, percent)
    done = exact.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = settle(_bounded(rest.join(done, ["a", "b"], "left_anti"), sets)).where(_linked(percent, "most")).select("a", "b")
    again = _verified(rest, rows, width).where(_linked(percent)).select("a", "b")

    # sets near a leader, where they do not all hang together and there are two beside the leader
    near = met.where("near").select("leader", "id", "n", "label").distinct()
    open_ = near.groupBy("leader").agg(F.count("*").alias("of"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    near = attach(near.where("leader <> id"), open_.where("of > 2 and lo <> hi").select("leader", "of"), ["leader"])
    parts = exact.select(F.col("a").alias("leader"), F.col("b").alias("id"), "inside", "private")
    again = again.union(_near_links(near.join(parts, ["leader", "id"]), percent))
    held = label.where("id <> component").select("id", F.col("component"))
    return components(held.union(again))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, longest: int = LONG_LIST) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``).

    A document's set: distinct shingles of ``width`` words (A-Z in lower case), or its whole sequence when it has fewer words;
    a null text and one without words have none and are linked with nothing. Two documents are linked when
    their Jaccard similarity is ``percent`` / 100 or more; the component id is the smallest doc_id reachable. Rows
    with the same text are one set, and rows with a null id are a component of their own with a null id.
    """
    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("id", F.xxhash64(F.lit(1), "text"))
    members = settle(_sizes(base, width))
    real = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    firsts = settle(members.where(real).groupBy("id").agg(F.min("doc_id").alias("first")))
    copies = members.where(real).join(firsts, "id").where("doc_id > first").select("doc_id", "id", F.lit(True).alias("copy")).distinct()
    # one row of each group of copies stands for it
    rows = attach(base.where("doc_id is not null"), copies, ["doc_id", "id"], "left").where("copy is null").select("id", "text")
    found = set_components(rows, width, percent, longest)
    least = found.join(firsts, "id").groupBy("component").agg(F.min("first").alias("least"))
    least = found.join(least, "component").select("id", "least")
    by_set = settle(firsts.join(least, "id", "left").select("id", F.coalesce("least", "first").alias("component_id")))
    return members.join(by_set, "id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
