"""Packing documents into training sequences by the sum-of-squares rule.

Documents are turned into token ids and an end id; only those longer than a sequence are cut. Pieces are dealt to shards
of a few thousand, and each shard is packed by itself: longest piece first, every piece goes to the open sequence for which
the sum over residual gaps of the squared number of open sequences with that gap becomes smallest; ties go to the smallest
gap. Pieces that come one by one (`online`) are packed in the order of their coming, and there a new sequence is one of the
choices, as the rule for unknown future pieces has it. With all pieces of a shard at hand that would only cost sequences, so a
new one is opened for a piece that fits no open one, and in the end the emptiest sequence is dissolved as long as the rule
finds places for all of its pieces. A shard's waste is a sequence or two, so shards cost next to nothing and the work
spreads over any number of tasks.

Two pieces of one doc_id, such as the copies that a mix takes, share a sequence only if no other has room and no new one is
to be opened; with null doc_ids that isn't looked at.

Rows are dealt in turn as they come to a task, whatever their ids, so repeats and nulls spread evenly. With `by_place` a
shard is a run of rows as stored instead: the order of a mix then decides what is packed together.

Defined results: a null text counts as empty and gives the end id alone. Repeated rows are packed each. Very long texts
give many full pieces. An empty table gives an empty result. Other columns are ignored."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, located, stored

LENGTH = 2048
SHARD_PIECES = 8192
#: Entries of each of a worker's two caches; about 420 MB a worker when full. 2^18 take 280 MB and more CPU time.
CACHE = 1_000_000

# A word of letters that Unicode normalisation leaves alone, and marks around it.
_PLAIN = re.compile(r"([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~-]*)")


def stretches_of(text: str) -> list[str]:
    """The text cut at blanks, tabs and line ends; replacing these three is cheaper than str.translate."""
    return text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")


class Chunks(dict):
    """White-space separated stretch of text -> its ids as little-endian 32-bit bytes.

    The vocabulary's splitter never joins anything over white space, so stretches can be looked up one by one. Words of
    plain letters are kept apart from the marks after them, as the splitter does. Both caches are bounded."""

    def __init__(self, vocabulary: str, most: int = CACHE) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.words, self.most = Tokenizer.from_file(vocabulary), {}, most
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values(), default=0) + 1, bool)  # ids that end a word
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, stretches: list[list[str]]) -> None:
        """Encode all new words of plain letters of some texts in one call, which costs half of a call for each."""
        # One look-up a stretch: set.difference would walk through all of a dict subclass each time.
        unseen = (c for c in set().union(*stretches) if c not in self)
        new = {m[1].lower() for c in unseen if (m := _PLAIN.fullmatch(c))}
        new = [w for w in new if w not in self.words]
        if not new:
            return
        if len(self.words) + len(new) > self.most:
            self.words.clear()
        ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(new) and cuts[-1] == len(ids):  # else words are encoded one by one as they come
            at = 0
            for word, end in zip(new, cuts.tolist()):
                self.words[word] = ids[at:end].tobytes()
                at = end

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        short = {i: stretches_of(t) for i, t in enumerate(texts) if len(t) < 1 << 20}
        self.learn(list(short.values()))
        return [b"".join(map(self.__getitem__, short[i])) if i in short else self.ids(t) for i, t in enumerate(texts)]

    def word(self, text: str) -> bytes:
        if (ids := self.words.get(text)) is None:
            if len(self.words) >= self.most:
                self.words.clear()
            ids = self.words[text] = self.encode(text)
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if (m := _PLAIN.fullmatch(chunk)) and not chunk.startswith("<|"):
            ids = self.word(m[1].lower()) + (self.word(m[2]) if m[2] else b"")
        else:
            ids = self.encode(chunk)
        if len(chunk) < 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of the whole text, in stretches of bounded size."""
        if len(text) < 1 << 20:
            return b"".join(map(self.__getitem__, stretches_of(text)))
        out, at = [], 0
        while at < len(text):
            end = at + (1 << 20)
            if end < len(text):
                cut = max(text.rfind(c, at, end) for c in " \n\t\r")
                if cut < 0:  # one stretch without white space: it stays whole
                    cut = min((p for c in " \n\t\r" if (p := text.find(c, end)) >= 0), default=len(text) - 1)
                end = cut + 1
            out += map(self.__getitem__, stretches_of(text[at:end]))
            at = end
        return b"".join(out)


_chunks: dict[tuple[str, int], Chunks] = {}


def chunks(vocabulary: str, most: int = CACHE) -> Chunks:
    if (vocabulary, most) not in _chunks:
        _chunks[vocabulary, most] = Chunks(vocabulary, most)
    return _chunks[vocabulary, most]


def cut(docs: DataFrame, vocabulary: str, *, length: int = LENGTH, end_id: int = 0, with_ids: bool = False, cache: int = CACHE, run: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary) of every piece, and `deal`.

    deal numbers the rows of a task as they come, or with `run` names the run of so many stored rows that a row is in."""

    def over(batch):
        get = chunks(vocabulary, cache).many
        end = np.array([end_id], "<u4").tobytes()
        texts = batch.column("text").to_pylist()
        doc_ids = batch.column("doc_id").to_pylist()
        deals = batch.column("deal").to_pylist() if run else None
        for first in range(0, len(texts), 128):
            rows = []
            for k, data in enumerate(get([t or "" for t in texts[first : first + 128]]), first):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at : at + 4 * length]
                    rows.append((doc_ids[k], piece, at // 4, len(part) // 4, zlib.crc32(part), deals[k] if deals else number(), *((part,) if with_ids else ())))
            columns = list(zip(*rows))
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "deal": pa.int64(), **({"ids": pa.binary()} if with_ids else {})}
            yield {name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), columns)}

    state: dict[str, int] = {}  # of one task, which gets its own copy

    def number() -> int:
        state["next"] = state.get("next", TaskContext.get().partitionId() * 0x9E3779B1) + 1
        return state["next"]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long" + (", ids binary" if with_ids else "")
    named = [F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")]
    if run:
        deal = F.xxhash64("locator.file", F.floor(F.col("locator.at") / run)).alias("deal")
        return arrow_map(located(docs).select(*named, deal), over, schema)
    return arrow_map(docs.select(F.struct("doc_id", "text").alias("row")).select(*named), over, schema)


def place(lengths: np.ndarray, capacity: int, owners: list | None = None, online: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the order given (longest first, or as they come if `online`).

    owners: for each piece None, or what no two pieces of a sequence should have in common."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by residual gap
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    gap: list[int] = []
    inside: list[list[int]] = []
    has: list[set] = []
    owners = owners or [None] * len(lengths)

    def choose(size: int, owner) -> int | None:
        """The open sequence that the rule gives to a piece; None for a new one."""
        fits = np.flatnonzero(count[size:capacity]) + size
        if not len(fits):
            return None
        change = 2 - 2 * count[fits] + 2 * count[fits - size]
        change[fits == size] = 1 - 2 * count[size]  # a full sequence has no gap that counts
        best = int(change.argmin())
        if online and size < capacity and 2 * count[capacity - size] + 1 < change[best]:
            return None
        b = open_at[int(fits[best])][-1]
        if owner is None or owner not in has[b]:
            return b
        for k in np.argsort(change, kind="stable"):
            for b in reversed(open_at[int(fits[k])]):
                if owner not in has[b]:
                    return b
        return None

    def take(b: int) -> None:
        if open_at[gap[b]][-1] == b:
            open_at[gap[b]].pop()
        else:
            open_at[gap[b]].remove(b)
        count[gap[b]] -= 1

    def show(b: int) -> None:
        if gap[b] > 0:
            open_at[gap[b]].append(b)
            count[gap[b]] += 1

    for i, size in enumerate(lengths.tolist()):
        b = choose(size, owners[i])
        if b is None:
            b = len(gap)
            gap.append(capacity)
            inside.append([])
            has.append(set())
        else:
            take(b)
        gap[b] -= size
        inside[b].append(i)
        if owners[i] is not None:
            has[b].add(owners[i])
        show(b)
    while not online:  # dissolve the emptiest sequence while the rule finds places for its pieces
        widest = np.flatnonzero(count)
        if not len(widest):
            break
        b = open_at[int(widest[-1])][-1]
        take(b)
        moves = []
        for i in inside[b]:
            to = choose(int(lengths[i]), owners[i])
            if to is None:
                break
            take(to)
            moves.append((i, to))
            gap[to] -= int(lengths[i])
            has[to].add(owners[i])
            show(to)
        if len(moves) < len(inside[b]):
            break  # this shard's result stays as it was before this attempt
        for i, to in moves:
            inside[to].append(i)
        inside[b] = []
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    for members in inside:
        if members:
            sizes = lengths[members]
            sequence[members] = number
            offset[members] = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            number += 1
    return sequence, offset


def pack_pieces(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """sequence_id and offset instead of `shard`, of pieces of which each shard (0 ..) is packed by itself."""
    names = [f.name for f in pieces.schema if f.name != "shard"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "shard") + ", sequence_id long, offset long"

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        part = part.select(names).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        ids = part.column("doc_id").to_pylist()
        seen = Counter(i for i in ids if i is not None)
        owners = [i if seen[i] > 1 else None for i in ids] if len(seen) < len(ids) else None
        sequence, offset = place(part.column("length").to_numpy().astype(np.int64), capacity, owners)
        return part.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    return pieces.groupBy("shard").applyInArrow(pack, schema)


def pack(docs: DataFrame, vocabulary: str, *, length: int = LENGTH, shard_pieces: int = SHARD_PIECES, end_id: int = 0, with_ids: bool = False, cache: int = CACHE, by_place: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ids come along if asked for."""
    pieces = stored(cut(docs, vocabulary, length=length, end_id=end_id, with_ids=with_ids, cache=cache, run=shard_pieces if by_place else None), "pieces", lasting=True)
    if by_place:
        # One row for thousands of documents; numbered in one task.
        runs = stored(pieces.select("deal").distinct().coalesce(1).select("deal", F.monotonically_increasing_id().alias("shard")), "runs", lasting=True)
        return pack_pieces(pieces.join(runs, "deal").drop("deal"), length)
    shards = max(1, round(pieces.count() / shard_pieces))
    return pack_pieces(pieces.withColumn("shard", F.pmod("deal", F.lit(shards)).cast("long")).drop("deal"), length)
