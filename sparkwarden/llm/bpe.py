"""Byte-level BPE encoding and decoding by ranked merges.

Texts are cut by the vocabulary's pattern; each distinct word is a byte array
whose adjacent pieces are merged, lowest rank first, until no neighbouring pair
has a rank.  Decoding concatenates the binary pieces of the ids.

Two forms of the same fold:

* :func:`encode_words` folds with Spark higher-order functions over a column of
  distinct words, with the ranks as a literal (an array of small maps, by hash);
* :func:`encode` runs over whole texts.  There the fold runs inside Arrow
  batches over each batch's distinct words, kept in a bounded cache.  (Joining
  corpus-wide folded words back to texts shuffles every token twice; the README
  has figures.)

Defined results: null and empty text have no ids and decode to no bytes;
repeated rows get equal results; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of each of the two generations of the cache of folded words, per Python worker.
CACHE = 1 << 16
#: Longer words are folded each time, so that the cache is bounded in bytes as well.
LONGEST = 256


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks of a file of base64 pieces and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by ranked merges."""
    known = ranks.get(word)
    if known is not None:
        return [known]
    if len(word) > 64:
        return _fold_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    rank = [ranks.get(a + b) for a, b in zip(pieces, pieces[1:])]
    while True:
        low, at = None, -1
        for i, r in enumerate(rank):
            if r is not None and (low is None or r < low):
                low, at = r, i
        if low is None:
            return [ranks[p] for p in pieces]
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del rank[at]
        if at:
            rank[at - 1] = ranks.get(pieces[at - 1] + pieces[at])
        if at < len(rank):
            rank[at] = ranks.get(pieces[at] + pieces[at + 1])


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and a linked list, for long words."""
    import heapq

    n = len(word)
    end = list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    gone = [False] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = after[i]
        if gone[i] or end[i] != mid or j < 0 or end[j] != stop:
            continue
        end[i], gone[j], after[i] = stop, True, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i >= 0:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Codec:
    """Pattern, ranks and a bounded cache of words as (ids as text, count, bytes)."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = ranks_of(path)
        self.pieces = {i: p for p, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def word(self, word: str) -> tuple[str, int, bytes]:
        if len(self.cache) >= CACHE:
            self.older, self.cache = self.cache, {}
        found = self.older.get(word)
        if found is None:
            ids = fold(word.encode("utf-8", "surrogatepass"), self.ranks)
            found = (",".join(map(str, ids)), len(ids), b"".join([self.pieces[i] for i in ids]))
        if len(word) <= LONGEST:
            self.cache[word] = found
        return found

    def forget(self) -> None:
        """Lets go of the folded words, so that an idle worker holds ranks only."""
        self.cache, self.older = {}, {}

    def text(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids as text, and the bytes they decode to."""
        get, word = self.cache.get, self.word
        found = [get(w) or word(w) for w in self.find(text)]
        return sum([f[1] for f in found]), ",".join([f[0] for f in found]), b"".join([f[2] for f in found])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker; its ranks are kept between tasks, its words within one."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (array of int) and the decoded bytes of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for batch in batches:
            found = [c.text(t or "") for t in batch["text"]]
            ids = [[int(i) for i in f[1].split(",")] if f[0] else [] for f in found]
            yield pd.DataFrame({"id": batch["id"], "n_tokens": [f[0] for f in found], "ids": ids, "decoded": [f[2] for f in found]})
        c.forget()

    return _mapped(docs, run, "n_tokens long, ids array<int>, decoded binary", id_col, text_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode`, with SHA-256 of the comma-joined ids and of the decoded bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                n, ids, decoded = c.text(text or "")
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", batch["id"])
            yield out
        c.forget()

    return _mapped(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def _mapped(docs: DataFrame, run, columns: str, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the concatenated pieces of a column of id arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = {i: p for p, i in ranks_of(path).items()}
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "decoded": [b"".join([pieces[int(i)] for i in (x if x is not None else [])]) for x in batch["ids"]]})

    kind = ids.schema[id_col].dataType.simpleString()
    rows = ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def rank_literal(ranks: dict[bytes, int], buckets: int = 4096) -> Column:
    """The ranks as a literal: ``buckets`` small maps from piece (hex) to rank, by crc32."""
    import json
    import zlib

    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        table[zlib.crc32(piece) % buckets][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", buckets: int = 4096) -> DataFrame:
    """``words`` with their ids, folded by higher-order functions only.

    The fold runs over (pieces); every step merges the pair of lowest rank.
    """
    table = rank_literal(ranks, buckets)

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.get(table, F.pmod(F.crc32(piece), F.lit(buckets)).cast("int")), F.hex(piece))

    def best(pieces: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.struct(rank(F.concat(F.element_at(pieces, i), F.element_at(pieces, i + 1))).alias("r"), i.alias("i")))
        return F.when(F.size(pieces) > 1, F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull())))

    def merge(pieces: Column, at: Column) -> Column:
        joined = F.array(F.concat(F.element_at(pieces, at), F.element_at(pieces, at + 1)))
        return F.concat(F.slice(pieces, F.lit(1), at - 1), joined, F.slice(pieces, at + 2, F.size(pieces)))

    def step(state: Column, _: Column) -> Column:
        pieces, low = state["pieces"], state["low"]
        merged = F.when(low.isNull(), pieces).otherwise(merge(pieces, low["i"]))
        return F.transform(F.array(merged), lambda m: F.struct(m.alias("pieces"), F.when(low.isNotNull(), best(m)).alias("low")))[0]

    raw = F.col(word_col).cast("binary")
    single = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.substring(raw, i, F.lit(1)))
    start = F.transform(F.array(single), lambda m: F.struct(m.alias("pieces"), best(m).alias("low")))[0]
    folded = F.aggregate(F.sequence(F.lit(1), F.length(raw)), start, step, lambda s: F.transform(s["pieces"], rank))
    return words.withColumn("ids", F.when(F.length(raw) > 0, folded).otherwise(F.array().cast("array<int>")))
