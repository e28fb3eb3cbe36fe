"""Near-duplicate documents: SuperMinHash signatures, banding, verification, grouping.

A document's set holds its distinct five-word shingles (A-Z lower-cased; fewer
words: the whole sequence; no words: the empty set, linked with nothing).  Two
documents are linked if ``100 * |intersection| >= percent * |union|``: 85 by
default, op2's contract; the pipeline asks for 80.

* SuperMinHash: element ``e`` visits the signature's positions in a random
  order of its own (a Fisher-Yates permutation drawn step by step); at step
  ``j`` it offers ``j + u`` to its ``j``-th position.  Steps run for a whole
  batch at once; a document stops as soon as no later step can lower a value.
* Documents with equal sets form one class; only class representatives go on.
* 24 bands of 5 positions: documents at similarity 0.85 meet in some band but
  for a chance of 8e-7, at 0.8 but for 7e-5 ((1 - s^5)^24).
* In a band's bucket all members are compared with the bucket's smallest
  member.  That settles a bucket of copies with one comparison a member.  Only
  buckets that then still hold several components compare members of different
  components, in pairs of blocks of bounded size: a matrix product of the
  blocks' sets counts all intersections, and what leaves a task is one edge for
  each two components it found linked, never pairs of documents.
* Links are confirmed on the full sets (64-bit shingle hashes).
* Components by alternating stars.

Defined results: null or empty text has size 0 and is its own component; rows
with equal ids count as one document for the links; rows without an id are kept
and linked with nothing (component null); an empty table gives an empty result.
Extra columns are not read by :func:`near_duplicates` and kept by :func:`drop`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .words import gram_hashes, mix64, words_of

SHINGLE = 5
BANDS, ROWS = 24, 5
POSITIONS = BANDS * ROWS
PERCENT = 85
#: Documents of a bucket that one task compares with as many others.
BLOCK = 512
#: Columns of a block's set matrix at a time.
_COLUMNS = 4096
#: Up to so many ids (8 bytes each) are broadcast to the scan of the texts.
BROADCAST_ROWS = 1_000_000
_BYTES = 2_000_000
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated sorted distinct shingle hashes of all texts, and their bounds."""
    h, _, _, first, _ = words_of(texts, lower=True)
    grams = gram_hashes(h, SHINGLE)
    out, bounds = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= SHINGLE:
            own = np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            own = gram_hashes(h[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            own = h[:0]
        out.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return np.concatenate(out) if out else h[:0], bounds


def super_minhash(elements: np.ndarray, bounds: np.ndarray, m: int = POSITIONS) -> np.ndarray:
    """Signatures (sets x m) of concatenated sets; empty sets keep the largest value."""
    n_sets = len(bounds) - 1
    out = np.full(n_sets * m, _FULL, dtype=np.uint64)
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))
    rows_at_once = max(1, 4_000_000 // m)

    def draw(e: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The step's random part (32 bits) and the place drawn from j..m-1."""
        x = mix64(e ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        return x >> np.uint64(32), place

    with np.errstate(over="ignore"):
        u, place = draw(elements, 0)
        np.minimum.at(out, owner * m + place, u)
        open_sets = (out.reshape(n_sets, m) == _FULL).any(axis=1) & (np.diff(bounds) > 0)
        todo = np.flatnonzero(open_sets[owner])
        # Cut at set bounds so that a set is finished within one part.
        at = 0
        while at < len(todo):
            stop = min(at + rows_at_once, len(todo))
            if stop < len(todo):
                last = owner[todo[stop - 1]]
                begin = np.searchsorted(owner[todo], last)
                stop = begin if begin > at else np.searchsorted(owner[todo], last, side="right")
            part = todo[at:stop]
            at = stop
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(part), 1))
            line, first = np.arange(len(part)), place[part]
            order[line, first], order[line, 0] = 0, first
            for j in range(1, m):
                still = open_sets[owner[part]]
                if not still.all():
                    part, order = part[still], order[still]
                    line = np.arange(len(part))
                if not len(part):
                    break
                u, spot = draw(elements[part], j)
                chosen = order[line, spot].copy()
                order[line, spot] = order[:, j]
                order[:, j] = chosen
                mine = owner[part]
                np.minimum.at(out, mine * m + chosen, u + (np.uint64(j) << np.uint64(32)))
                sets = np.unique(mine)
                open_sets[sets] = (out.reshape(n_sets, m)[sets] == _FULL).any(axis=1)
    return out.reshape(n_sets, m)


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """(sets x BANDS) keys as signed 64-bit."""
    with np.errstate(over="ignore"):
        parts = signatures.reshape(len(signatures), BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
        key = np.repeat(key, len(signatures), axis=0)
        for r in range(ROWS):
            key = mix64(key ^ parts[:, :, r])
    return key.view(np.int64)


def sub_batches(texts: list, limit: int = _BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of about ``limit`` characters each, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, d1, d2 (digest of the set) and bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["id"]
            for a, b in sub_batches(texts):
                elements, bounds = shingle_sets(texts[a:b])
                sig = super_minhash(elements, bounds)
                with np.errstate(over="ignore"):
                    sums = [np.zeros(len(elements) + 1, dtype=np.uint64) for _ in range(2)]
                    np.cumsum(mix64(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[0][1:])
                    np.cumsum(mix64(elements + np.uint64(0x5851F42D4C957F2D)), out=sums[1][1:])
                    d1, d2 = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
                yield pd.DataFrame({"id": ids.iloc[a:b].to_numpy(), "n": np.diff(bounds), "d1": d1, "d2": d2, "bands": list(bands_of(sig))})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, n long, d1 long, d2 long, bands array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """(id, n, elements) of rows (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["id"]
            for a, b in sub_batches(texts):
                elements, bounds = shingle_sets(texts[a:b])
                signed = elements.view(np.int64)
                yield pd.DataFrame({"id": ids.iloc[a:b].to_numpy(), "n": np.diff(bounds), "elements": np.split(signed, bounds[1:-1])})

    return docs.mapInPandas(run, "id long, n long, elements array<long>")


def _size_fits(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))
    both = pairs.join(left, "a").join(right, "b").where(_size_fits("na", "nb", percent))
    common = F.size(F.array_intersect("ea", "eb"))
    return both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def block_links(elements: list[np.ndarray], left: np.ndarray, right: np.ndarray, component: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Pairs of components, once each, with a linked pair of a left and a right set."""
    n = np.array([len(e) for e in elements])
    owner = np.repeat(np.arange(len(elements)), n)
    _, column, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    # An element of one set only is in no intersection.
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    width = int(column.max(initial=-1)) + 1
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, [start, start + _COLUMNS])
        table = np.zeros((len(elements), min(_COLUMNS, width - start)), dtype=np.float32)
        table[owner[a:b], column[a:b] - start] = 1
        common += table[left] @ table[right].T
    common = np.rint(common).astype(np.int64)
    linked = (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (component[left][:, None] != component[right][None, :])
    x, y = np.nonzero(linked)
    ends = np.stack([component[left[x]], component[right[y]]], axis=1)
    return np.unique(np.sort(ends, axis=1), axis=0)


def _block_edges(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components within buckets, compared block by block.

    ``members`` has key, id, c, elements and k, the bucket's count.  Each row
    goes to the pairs of blocks it is part of; a task holds two blocks at a time.
    """
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "c", "elements")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        c, own = group["c"].to_numpy(), group["own"].to_numpy()
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        found = np.zeros((0, 2), dtype=np.int64)
        if (c != c[0]).any():
            found = block_links(group["elements"].tolist(), np.flatnonzero(own == lo), np.flatnonzero(own == hi), c, percent)
        return pd.DataFrame(found, columns=["a", "b"])

    return spread.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id and kept (id = component_id) of every row."""
    sig = stored(signatures(docs, id_col, text_col), "signatures")
    full = sig.where("n > 0 and id is not null")
    classes = full.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    member = full.select("id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("id", "rep")
    reps = full.join(classes.select(F.col("rep").alias("id"), "n", "d1", "d2"), ["id", "n", "d1", "d2"]).dropDuplicates(["id", "n", "d1", "d2"])
    keys = reps.select("id", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "n")).alias("m")).where("k > 1")
    multi = stored(keys.join(buckets, "key").select("key", "k", "id", "n", F.col("m.id").alias("low"), F.col("m.n").alias("low_n")), "buckets")
    need = stored(multi.select("id").distinct(), "need")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    few = need.count() <= BROADCAST_ROWS
    sets = stored(sets_of(texts.join(F.broadcast(need) if few else need, "id", "left_semi")), "sets")
    stars = multi.where("id <> low").where(_size_fits("n", "low_n", percent)).select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    first = components(member.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).unionByName(_verified(stars, sets, percent)))

    # Buckets that hold several components yet: compare across components.
    placed = multi.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key")
    rest = placed.where("k > 2").join(mixed, "key").select("key", "k", "id", "c")
    links = stored(_block_edges(rest.join(sets.select("id", "elements"), "id"), percent), "links")
    final = first
    if not links.isEmpty():
        second = components(links)
        # Ends of these edges are components of the first round, or documents that had no link before.
        joined = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("low")), "component", "left")
        fresh = second.join(first, "node", "left_anti")
        final = joined.select("node", F.coalesce("low", "component").alias("component")).unionByName(fresh)
    found = sig.select("id", "n").join(final.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col(id_col).alias("near_id")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("near_doc"), F.col(id_col).cast("long").alias("near_id"))
    return whole.join(gone, "near_id", "left_anti").select("near_doc.*")
