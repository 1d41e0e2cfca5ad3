"""Evaluation texts that leak into training text, by a positional inverted index.

The corpus is stored as postings, in segments of some thousand documents: for every word of the test items, the documents and positions
where it stands. In every stretch of SPAN words of an item the rarest pairs of neighbouring words (by the words' postings in the whole
corpus) are anchors. In a segment the lists of the anchors' words, adjusted by one place, are intersected, all at once by merging them in
the order of the documents; a document is a candidate for an item where several anchors agree on where the item would begin, up to the
words that may have been added or dropped between them. A candidate's words, as the segment has them, are then aligned with the item's:
this gives exact phrases and near ones alike. A segment is written and read where it is; nothing is shuffled but the words' counts.

No stretch is missed. Of a stretch with at most one edit in eight words, some SPAN words in a row hold at most six edits: two such parts
cover one of less than twice the length, and only if the edits are where they overlap do both hold all, which are six at most; of longer
ones a part holds no more than the average. Six edits spoil twelve of a part's eighteen anchors at most and leave AGREE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.text import words
from loomspark.session import Workspace

#: Words that must stand in the document, and of how many one may be changed, dropped or added.
SPAN, EDIT_IN = 30, 8
#: Anchors of each stretch of SPAN words and how many must agree. Each edit spoils two neighbouring pairs, so of 18 any 6 edits leave 6.
ANCHORS, AGREE = 18, 6
#: How far offsets may differ that still agree.
DRIFT = 6
#: Postings of one segment, about.
SEGMENT = 400_000
#: Words of test items that are searched for in one pass over the corpus; more items take several passes.
PASS_WORDS = 2_000_000


def _segments(vocabulary: dict[str, int]):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each segment: its postings sorted by term, document and position, and how many each term has."""
        term, doc, pos = [], [], []
        for batch in [*_sliced(batches), None]:
            if batch is not None:
                for d, text in zip(batch["doc"].tolist(), batch["text"]):
                    at = [(t, p) for p, w in enumerate(words(text)) if (t := vocabulary.get(w)) is not None]
                    term += [t for t, _ in at]
                    pos += [p for _, p in at]
                    doc += [d] * len(at)
            if term and (batch is None or len(term) >= SEGMENT):
                t, d, p = np.array(term, dtype=np.int32), np.array(doc, dtype=np.int64), np.array(pos, dtype=np.int32)
                order = np.lexsort((p, d, t))
                each, count = np.unique(t, return_counts=True)
                yield pd.DataFrame({"term": [t[order].tobytes()], "doc": [d[order].tobytes()], "pos": [p[order].tobytes()], "terms": [each], "counts": [count]})
                term, doc, pos = [], [], []

    return index


def _sliced(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows]


def choose_anchors(items: list[list[int]], count: dict[int, int]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(term, next term) -> (item, position) of the anchors: in every stretch of SPAN words the ANCHORS rarest pairs, in a shorter item
    the AGREE rarest. A pair is as rare as the rarer of its words. An item of one word has that word for an anchor (next term -1)."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, item in enumerate(items):
        pairs = list(zip(item, item[1:])) or [(item[0], -1)]
        rare = sorted(range(len(pairs)), key=lambda i: (min(count.get(t, 0) for t in pairs[i] if t >= 0), i))
        place = np.empty(len(pairs), dtype=int)
        place[rare] = np.arange(len(pairs))
        if len(item) < SPAN:
            chosen = set(rare[:AGREE])
        else:
            chosen = {s + int(i) for s in range(len(item) - SPAN + 1) for i in np.argsort(place[s : s + SPAN - 1])[:ANCHORS]}
        for i in chosen:
            out.setdefault(pairs[i], []).append((k, i))
    return out


class Anchors:
    """The anchors of a pass by pairs of words: each pair's items and places in them."""

    def __init__(self, items: list[list[int]], count: dict[int, int]):
        chosen = choose_anchors(items, count)
        self.words = 1 + max((t for item in items for t in item), default=0)
        pairs = np.array([(t, u) for t, u in chosen] or [(0, 0)], dtype=np.int64)
        code = self.code(pairs[:, 0], pairs[:, 1])
        order = np.argsort(code)
        lists = list(chosen.values())
        self.codes = code[order]
        self.size = np.array([len(lists[k]) for k in order] if lists else [0])
        self.start = np.r_[0, np.cumsum(self.size)]
        at = np.array([x for k in order for x in lists[k]] if lists else [(0, 0)], dtype=np.int64)
        self.item, self.place = at[:, 0], at[:, 1]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.codes % len(self.maybe)] = True

    def code(self, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        return t.astype(np.int64) * (self.words + 1) + (u.astype(np.int64) + 1)

    def hits(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where, item, place in it) for the pairs ``code`` at ``at`` that are anchors."""
        some = np.flatnonzero(self.maybe[code % len(self.maybe)])
        k = np.minimum(np.searchsorted(self.codes, code[some]), len(self.codes) - 1)
        same = (self.codes[k] == code[some]) & (self.size[k] > 0)
        k, at = k[same], at[some[same]]
        n = self.size[k]
        pick = np.repeat(self.start[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[pick], self.place[pick]


def _candidates(term: np.ndarray, key: np.ndarray, anchors: Anchors, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, offset) where enough anchors agree. key: document number * 2**32 + position, ascending; term: the word there."""
    next_to = np.flatnonzero(key[1:] == key[:-1] + 1)
    found = [anchors.hits(anchors.code(term[next_to], term[next_to + 1]), key[next_to]), anchors.hits(anchors.code(term, np.full(len(term), -1)), key)]
    hit, item, place = (np.concatenate(x) for x in zip(*found))
    if not len(hit):
        return (np.zeros(0, dtype=np.int64),) * 3
    # first by offset alone, which leaves few
    pair, off = (hit >> 32) * len(lengths) + item, (hit & 0xFFFFFFFF) - place
    # one number for both where they fit, which sorts faster
    order = np.argsort((pair << 32) | (off + (1 << 30))) if pair.max() < 1 << 31 and off.max() < 1 << 30 else np.lexsort((off, pair))
    pair, off, first = pair[order], off[order], item[order]
    last = np.arange(len(pair)) + np.minimum(AGREE, np.maximum(1, lengths[first] - 1)) - 1
    end = np.minimum(last, len(pair) - 1)
    run = np.flatnonzero((last < len(pair)) & (pair[end] == pair) & (off[end] - off <= np.where(lengths[first] < SPAN, 0, DRIFT)))
    marks = np.zeros(len(pair) + 1, dtype=np.int64)
    np.add.at(marks, run, 1)
    np.add.at(marks, last[run] + 1, -1)
    some = order[np.cumsum(marks[:-1]) > 0]
    hit, item, place = hit[some], item[some], place[some]
    # stretches of SPAN words lie within three half stretches in a row; short items are one stretch
    short = lengths[item] < SPAN
    half = SPAN // 2
    hit, item, place = (np.concatenate((x, x[~short], x[~short])) for x in (hit, item, place))
    block = np.concatenate((np.where(short, 0, place[: len(short)] // half), place[: (~short).sum()] * 0, place[: (~short).sum()] * 0))
    n, m = len(short), int((~short).sum())
    block[n : n + m], block[n + m :] = place[n : n + m] // half - 1, place[n + m :] // half - 2
    doc, off = hit >> 32, (hit & 0xFFFFFFFF) - place
    order = np.lexsort((off, block, item, doc))
    doc, item, block, off = doc[order], item[order], block[order], off[order]
    need = np.minimum(AGREE, np.maximum(1, lengths[item] - 1))
    drift = np.where(lengths[item] < SPAN, 0, DRIFT)
    last = np.arange(len(doc)) + need - 1
    ok = last < len(doc)
    last = np.minimum(last, len(doc) - 1)
    ok &= (doc[last] == doc) & (item[last] == item) & (block[last] == block) & (off[last] - off <= drift)
    # an alignment's band is much wider than a place, so of two neighbouring offsets one will do
    off = np.where(lengths[item] < SPAN, off, off & ~1)
    found = np.unique(np.c_[doc[ok], item[ok], off[ok]], axis=0)
    return (found[:, 0], found[:, 1], found[:, 2]) if len(found) else (np.zeros(0, dtype=np.int64),) * 3


def _screened(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, off: np.ndarray, item: np.ndarray, words: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which candidates may hold: SPAN words in a row of the item, all but six of which stand near the offset. flat: the words of all documents
    of a segment, a candidate's from begin to end; words: those of all items, an item's from first on. Short items pass."""
    out = lengths[item] < SPAN
    long = np.flatnonzero(~out)
    for k in range(0, len(long), 10_000):
        part = long[k : k + 10_000]
        n = lengths[item[part]]
        stop = np.cumsum(n)
        start = stop - n
        of = np.repeat(np.arange(len(part)), n)
        i = np.arange(stop[-1]) - start[of]
        want = words[first[item[part]][of] + i]
        at = begin[part][of] + off[part][of] + i
        low, high = begin[part][of], end[part][of]
        seen = np.zeros(len(of), dtype=bool)
        for shift in range(-DRIFT - 1, DRIFT + 2):
            where = at + shift
            seen |= (where >= low) & (where < high) & (flat[np.clip(where, 0, len(flat) - 1)] == want)
        total = np.r_[0, np.cumsum(seen)]
        begins = np.flatnonzero(i + SPAN <= n[of])
        good = total[begins + SPAN] - total[begins] >= SPAN - DRIFT
        out[part[np.unique(of[begins[good]])]] = True
    return out


def _search(anchors: Anchors, items: list[list[int]], ids: list):
    arrays, lengths = [np.array(x, dtype=np.int64) for x in items], np.array([len(x) for x in items])
    every, first = np.concatenate(arrays).astype(np.int32), np.r_[0, np.cumsum(lengths)[:-1]]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, d, p in zip(batch["term"], batch["doc"], batch["pos"]):
                term, doc, pos = np.frombuffer(t, dtype=np.int32), np.frombuffer(d, dtype=np.int64), np.frombuffer(p, dtype=np.int32)
                named, number = np.unique(doc, return_inverse=True)
                key = (number.astype(np.int64) << 32) + pos
                at = np.argsort(key, kind="stable")
                term, key, pos = term[at], key[at], pos[at]
                # the words of each document, as far as the items have them, one after another
                start = np.searchsorted(key >> 32, np.arange(len(named) + 1))
                end = np.cumsum(pos[start[1:] - 1].astype(np.int64) + 1)
                begin = np.r_[0, end[:-1]]
                flat = np.full(end[-1] if len(end) else 0, -1, dtype=np.int32)
                flat[begin[key >> 32] + pos] = term
                found: set[tuple[int, int]] = set()
                n, k, off = _candidates(term, key, anchors, lengths)
                some = np.flatnonzero(_screened(flat, begin[n], end[n], off, k, every, first, lengths)) if len(n) else n
                for n, k, off in zip(*(x[some].tolist() for x in (n, k, off))):
                    if (n, k) not in found and holds(arrays[k], flat[begin[n] : end[n]], off):
                        found.add((n, k))
                yield pd.DataFrame([(named[n], ids[k]) for n, k in sorted(found)], columns=["doc", "item"])

    return search


def holds(item: np.ndarray, doc: np.ndarray, off: int, span: int = SPAN, edit_in: int = EDIT_IN) -> bool:
    """Whether ``span`` or more consecutive words of the item stand in the document near offset ``off``, in order, with at most one word
    in ``edit_in`` changed, dropped or added; of a shorter item, whether all its words stand there unchanged."""
    n = len(item)
    if n < span:
        return 0 <= off and off + n <= len(doc) and bool((doc[off : off + n] == item).all())
    band = np.arange(off - 2 * DRIFT, off + 2 * DRIFT + 1)
    at = np.arange(n)[None, :] + band[:, None]
    same = (at >= 0) & (at < len(doc))
    same &= doc[np.clip(at, 0, max(0, len(doc) - 1))] == item
    # a stretch can only do if enough of its words stand anywhere in the band
    seen = np.r_[0, np.cumsum(same.any(axis=0))]
    length = np.arange(n + 1)[None, :] - np.arange(n)[:, None]
    able = (length >= span) & (seen[None, :] - seen[:n, None] >= length - length // edit_in)
    if not able.any():
        return False
    longest = np.where(able, length, 0).max(axis=1)
    run = np.zeros((len(band), n + 1), dtype=np.int32)  # matches in a row from each place on
    for i in range(n - 1, -1, -1):
        run[:, i] = np.where(same[:, i], run[:, i + 1] + 1, 0)
    starts = same & ~np.c_[np.zeros((len(band), 1), dtype=bool), same[:, :-1]]
    order = sorted(zip(*np.nonzero(starts)), key=lambda s: -run[s[0], s[1]])
    long = run.tolist()
    width = len(band)
    for b, i0 in order:
        if not longest[i0]:
            continue
        # reach[d]: the furthest item word that e edits get to on diagonal d
        reach = {b: i0 + long[b][i0]}
        e = 0
        while True:
            furthest = max(reach.values())
            if furthest - i0 >= max(span, edit_in * e):
                return True
            e += 1
            if edit_in * e > longest[i0]:
                break
            nxt: dict[int, int] = {}
            for d, i in reach.items():
                # a changed word, a dropped one (the next diagonal to the left), an added one (to the right)
                for dd, ii in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                    if 0 <= dd < width and ii <= n:
                        if (jj := ii + long[dd][ii]) > nxt.get(dd, -1):
                            nxt[dd] = jj
            if not nxt:
                break
            reach = nxt
    return False


def leaked_items(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "eval_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id): each document with each test item that leaks into it.

    An item leaks if 30 or more consecutive words of it stand in the document, in order, with at most one word in eight changed, dropped
    or added; an item of fewer than 30 words if all of them stand there unchanged. Case, accents, punctuation, markup, spacing, invisible
    characters and compatibility letter forms don't matter. Null ids, null texts and texts without words are in no row, and a pair is in
    one. Test items are held in memory, in passes of PASS_WORDS words; their number doesn't grow with the corpus.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    kind = items.schema[item_id].dataType
    out = spark.createDataFrame([], f"doc long, item {kind.simpleString()}")
    for part in _passes((r[0], w) for r in items.select(item_id, text).where(F.col(item_id).isNotNull()).toLocalIterator() if (w := words(r[1]))):
        out = out.unionByName(_one_pass(docs, part, kind))
    return out.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def _passes(tests: Iterator) -> Iterator[list]:
    part, size = [], 0
    for t in tests:
        part.append(t)
        size += len(t[1])
        if size > PASS_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _one_pass(docs: DataFrame, tests: list, kind) -> DataFrame:
    ws = Workspace(docs.sparkSession)
    vocabulary: dict[str, int] = {}
    items = [[vocabulary.setdefault(w, len(vocabulary)) for w in t[1]] for t in tests]
    index = ws.keep(docs.mapInPandas(_segments(vocabulary), "term binary, doc binary, pos binary, terms array<int>, counts array<long>"), "postings")
    # one row for each word of the items
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("c")).groupBy("c.terms").agg(F.sum("c.counts").alias("n"))
    count = {r[0]: r[1] for r in each.toLocalIterator()}
    found = index.select("term", "doc", "pos").mapInPandas(_search(Anchors(items, count), items, [t[0] for t in tests]), f"doc long, item {kind.simpleString()}")
    found = ws.keep(found, "found")
    ws.drop(index)
    return found
