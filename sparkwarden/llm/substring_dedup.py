"""Substring dedup: seed on winnowed anchors, extend both ways, keep long repeats.

A window is ``window`` consecutive words.  A word goes if some window over it
has a word sequence that starts earlier as well (smaller id, or the same id and
an earlier start); windows are judged on the input.

* Seeds: each window picks the least of its 8-word grams (the leftmost of
  equals).  Neighbouring windows mostly pick the same gram, so a text has about
  one anchor in seven words, and equal windows pick the same gram at the same
  place.
* Extension: an anchor is extended left and right as far as the windows that
  picked it reach; a digest of that context stands for the extended words.
  Anchors of equal gram and context meet; all but the first mark their windows.
  Consecutive windows join into maximal repeats.
* Ends of repeats: where one gram occurs in several contexts, the first
  occurrence of each context gives its windows one by one; those meet by their
  own digest, and all but the first are marked.

Rows for the shuffle are combined first: within a batch only the first of equal
anchors (or windows) goes on, the others are marked on the spot, so that a
passage in a third of all documents sends one row a batch.  A gram with many
contexts in a batch is keyed by gram and context, so it is spread out as well.

Defined results: null and empty texts have no words; texts shorter than a
window lose nothing; rows with equal ids count as one document (equal starts
are not earlier), each losing the same words; rows without an id lose nothing;
an empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .near_dedup import sub_batches
from .words import _P, _tables, gram_hashes, mix64, words_of

GRAM = 8
WINDOW = 20
#: Contexts of one gram within a batch from which on it is keyed by context too.
MANY = 16
#: Up to so many ids (8 bytes each) are broadcast, so that other texts need no shuffle.
BROADCAST_ROWS = 1_000_000
_BATCH = 8_000_000
#: Kinds of rows that the anchor pass sends on.
_MARK, _ANCHOR, _SPREAD, _WITNESS = 0, 1, 2, 3


def _range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of h[start:end] for many ranges."""
    _, powers, inverses = _tables()
    if len(h) <= len(powers):
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * powers[: len(h)], out=total[1:])
        return (total[end] - total[start]) * inverses[start]
    out = np.zeros(len(start), dtype=np.uint64)
    for i in range(int((end - start).max(initial=0))):
        inside = start + i < end
        out[inside] += h[start[inside] + i] * powers[i]
    return out


def anchors_of(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchors of a batch of texts with word hashes ``h``, text i at first[i]:first[i+1].

    Returns text, first window's start in the text, number of windows, gram
    hash and context digest of each anchor.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(h) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    with np.errstate(over="ignore"):
        grams = gram_hashes(h, GRAM)
        span = window - GRAM + 1
        pick = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
        pick = pick + np.arange(len(pick))
        counts = np.diff(first)
        text = np.repeat(np.arange(len(counts)), counts)[: len(pick)]
        starts = np.arange(len(pick))
        whole = starts + window <= first[1:][text]
        starts, text, pick = starts[whole], text[whole], pick[whole]
        if not len(starts):
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        new = np.append(True, (pick[1:] != pick[:-1]) | (text[1:] != text[:-1]))
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(starts)))
        lo, where = starts[at], pick[at]
        end = lo + n - 1 + window
        shape = ((where - lo) * 64 + (end - lo)).astype(np.uint64)
        context = mix64(_range_hashes(h, lo, end) ^ mix64(shape))
        return text[at], lo - first[:-1][text[at]], n, grams[where], context


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (last decides least), and where a new (first two keys) group starts in it."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(order) else np.zeros(0, dtype=bool)


#: A row's place is one long: start, number of windows from bit 32 on, kind from bit 48 on.
_ANCHOR_ROWS = "k long, c long, id long, place long"


def _frame(kind, k, c, ids, at, n) -> pd.DataFrame:
    place = at.astype(np.int64) | (n.astype(np.int64) << 32) | (np.asarray(kind, dtype=np.int64) << 48)
    return pd.DataFrame({"k": k.view(np.int64), "c": c.view(np.int64), "id": ids, "place": place})


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with at, n and kind taken from place."""
    place = F.col("place")
    return rows.withColumns({"at": place.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"), "n": F.shiftright(place, 32).bitwiseAND(F.lit(0xFFFF)).cast("int"), "kind": F.shiftright(place, 48).cast("int")})


def _combined(texts: list, ids: np.ndarray, window: int) -> Iterator[pd.DataFrame]:
    """Anchor rows of one batch, combined."""
    parts = []
    for a, b in sub_batches(texts):
        h, _, _, first, _ = words_of(texts[a:b])
        text, at, n, gram, context = anchors_of(h, first, window)
        parts.append((ids[a:b][text], at, n, gram, context))
    if not parts:
        return
    ids, at, n, gram, context = (np.concatenate(x) for x in zip(*parts))
    if not len(ids):
        return
    order, new = _first_of(gram, context, ids, at)
    ids, at, n, gram, context = (x[order] for x in (ids, at, n, gram, context))
    heads = np.flatnonzero(new)
    lead = heads[np.cumsum(new) - 1]
    later = ~new & ((ids != ids[lead]) | (at != at[lead]))
    # Marks need no meeting; keyed by id they are dealt evenly.
    yield _frame(_MARK, ids[later].view(np.uint64), np.zeros(int(later.sum()), dtype=np.uint64), ids[later], at[later], n[later])
    ids, at, n, gram, context = (x[heads] for x in (ids, at, n, gram, context))
    starts = np.append(True, gram[1:] != gram[:-1])
    group = np.cumsum(starts) - 1
    many = np.bincount(group)[group] >= MANY
    with np.errstate(over="ignore"):
        key = np.where(many, mix64(gram ^ mix64(context)), gram)
    yield _frame(np.where(many, _SPREAD, _ANCHOR), key, context, ids, at, n)
    witness = many & starts
    yield _frame(_WITNESS, gram[witness], np.zeros(int(witness.sum()), dtype=np.uint64), ids[witness], at[witness], n[witness])


def _gathered(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Arrow batches put together to about ``_BATCH`` characters, for better combining."""
    held, size = [], 0
    for batch in batches:
        held.append(batch[columns])
        size += int(batch["text"].str.len().sum())
        if size >= _BATCH:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _marked_anchors(rows: DataFrame, window: int) -> DataFrame:
    """(id, at, n, again): marked windows (again false), and windows to be looked at singly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _gathered(batches, ["id", "text"]):
            yield from _combined(batch["text"].tolist(), batch["id"].to_numpy(dtype=np.int64), window)

    # One exchange by k serves both windows: within it k and c are together as well.
    sent = _placed(rows.mapInPandas(run, _ANCHOR_ROWS).repartition("k"))
    same = Window.partitionBy("k", "c").orderBy("id", "at", "kind")
    ranked = sent.withColumns({"r": F.row_number().over(same), "lead": F.first(F.struct("id", "at")).over(same)})
    contexts = F.sum(F.when((F.col("r") == 1) & (F.col("kind") != _MARK), 1).otherwise(0)).over(Window.partitionBy("k"))
    ranked = ranked.withColumn("contexts", contexts)
    later = (F.col("id") != F.col("lead.id")) | (F.col("at") != F.col("lead.at"))
    mark = (F.col("kind") == _MARK) | (F.col("kind").isin(_ANCHOR, _SPREAD) & later)
    again = (F.col("kind") == _SPREAD) | ((F.col("kind") == _ANCHOR) & (F.col("contexts") > 1))
    return ranked.where(mark | (again & (F.col("r") == 1))).select("id", "at", "n", (~mark).alias("again"))


def _marked_windows(rows: DataFrame, window: int) -> DataFrame:
    """(id, at, n) of marked windows among the listed ones of rows (id, text, spots)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _gathered(batches, ["id", "text", "spots"]):
            parts = []
            texts, ids, spots = batch["text"].tolist(), batch["id"].to_numpy(dtype=np.int64), batch["spots"]
            for a, b in sub_batches(texts):
                h, _, _, first, _ = words_of(texts[a:b])
                grams = gram_hashes(h, window)
                for i in range(a, b):
                    listed = np.array([(s["at"], s["n"]) for s in spots.iloc[i]], dtype=np.int64).reshape(-1, 2)
                    start = np.repeat(listed[:, 0], listed[:, 1])
                    step = np.arange(len(start)) - np.repeat(np.cumsum(listed[:, 1]) - listed[:, 1], listed[:, 1])
                    at = np.unique(start + step)
                    # Rows of equal ids may have texts of other lengths.
                    at = at[at + window <= first[i - a + 1] - first[i - a]]
                    parts.append((np.full(len(at), ids[i]), at, grams[first[i - a] + at]))
            ids, at, gram = (np.concatenate(x) for x in zip(*parts))
            order, new = _first_of(gram, np.zeros_like(gram), ids, at)
            ids, at, gram = ids[order], at[order], gram[order]
            heads = np.flatnonzero(new)
            lead = heads[np.cumsum(new) - 1] if len(heads) else heads
            later = ~new & ((ids != ids[lead]) | (at != at[lead]))
            send = new | later
            kind = np.where(new, _ANCHOR, _MARK)[send]
            key = np.where(new, gram, ids.view(np.uint64))[send]
            yield _frame(kind, key, key, ids[send], at[send], np.ones(len(key)))[["k", "id", "place"]]

    sent = _placed(rows.mapInPandas(run, "k long, id long, place long"))
    same = Window.partitionBy("k").orderBy("id", "at")
    # A mark's own key may meet a window's by chance only; the kind keeps them apart.
    lead = F.first(F.when(F.col("kind") == _ANCHOR, F.struct("id", "at")), ignorenulls=True).over(same)
    later = (F.col("id") != F.col("lead.id")) | (F.col("at") != F.col("lead.at"))
    marked = sent.withColumn("lead", lead).where((F.col("kind") == _MARK) | later)
    return marked.select("id", "at", "n")


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the listed ids, by a broadcast of ids if they are few; else all rows.

    Only narrows what a join with the same ids shuffles.
    """
    return rows.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= BROADCAST_ROWS else rows


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, spans): of each document with marked windows their (at, n): first start, count."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    first = stored(_marked_anchors(rows, window), "anchors")
    look = first.where("again")
    spots = look.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("spots"))
    single = _marked_windows(_only(rows, look.select("id").distinct()).join(spots, "id"), window)
    marked = first.where("not again").select("id", "at", "n").unionByName(single)
    return marked.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def _cut(text: str | None, spans, window: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one blank."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if spans is None or not len(spans):
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        if s["at"] < len(words):
            edge[s["at"]] += 1
            edge[min(len(words), s["at"] + s["n"] - 1 + window)] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    out = b" ".join([w for w, k in zip(words, kept) if k])
    return len(words), int((~kept).sum()), out


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, text, spans); texts without spans stay where they are if the ids with spans are few."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = stored(repeats(docs, id_col, text_col, window), "spans")
    ids = spans.select("id")
    if ids.count() > BROADCAST_ROWS:
        return rows.join(spans, "id", "left")
    clean = rows.join(F.broadcast(ids), "id", "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return clean.unionByName(rows.join(F.broadcast(ids), "id", "left_semi").join(spans, "id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed and the kept text of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_cut(t, s, window) for t, s in zip(batch["text"], batch["spans"])]
            yield pd.DataFrame({"id": batch["id"], "n_words": [o[0] for o in out], "n_removed": [o[1] for o in out], "kept": [o[2].decode("utf-8", "replace") for o in out]})

    return _with_spans(docs, id_col, text_col, window).mapInPandas(run, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """As :func:`remove_repeats`, with SHA-256 of the kept words instead of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_cut(t, s, window) for t, s in zip(batch["text"], batch["spans"])]
            yield pd.DataFrame({"id": batch["id"], "n_words": [o[0] for o in out], "n_removed": [o[1] for o in out], "kept_sha256": [hashlib.sha256(o[2]).hexdigest() for o in out]})

    return _with_spans(docs, id_col, text_col, window).mapInPandas(run, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)
