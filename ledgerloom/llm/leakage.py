"""Evaluation items inside training documents: a generalised suffix automaton of the items' words, fed with each document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.lookalikes import look
from ledgerloom.runtime import partitions

#: Words of the shortest run that counts, of the longest gap inside a passage, and the least share of an item's words.
RUN, GAP, COVERAGE = 4, 3, 0.4
PASSAGES = 2
#: Items of one automaton; of more, a document meets only the automata of items that it shares a run of words with.
BLOCK = 2_000

_MARKS = re.compile(r"[̀-ͯ]")
_SPACE = re.compile(r"\S+")
_OTHER = re.compile(r"[\W_]+")


def words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of a text: look-alikes, case, punctuation and layout make no difference. Places are in the text."""
    out, broken, line_end = [], False, 0
    for m in _SPACE.finditer(text):
        raw = m[0]
        w = raw if raw.isascii() else _MARKS.sub("", look(raw))
        w = _OTHER.sub("", w).lower()
        if broken and not raw.strip(">"):
            continue  # a mark of quotation before the rest of a word
        if w:
            if broken and raw[0].isalnum() and "\n" in text[line_end : m.start()]:  # a word broken at a line's end is one word
                out[-1] = (out[-1][0] + w, out[-1][1], m.end())
            else:
                out.append((w, m.start(), m.end()))
        broken, line_end = bool(w) and raw[-1] == "-" and raw[-2].isalnum(), m.end()
    return out


class Automaton:
    """Generalised suffix automaton over words; knows for each state the items and places where its string ends."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        self.size = {}
        for item, text in items:
            self.size[item] = len(text)
            last = 0
            for at, word in enumerate(text):
                last = self._add(last, self.ids.setdefault(word, len(self.ids)), ends)
                ends[last].append((item, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            up = self.link[state]
            if up > 0 and self.length[up] >= run:
                ends[up].extend(ends[state])
        self.ends = [tuple(dict.fromkeys(e)) if self.length[s] >= run else () for s, e in enumerate(ends)]
        # The suffix state whose strings end in just ``run`` equal words.
        self.run, self.top = run, [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.top[state] = state if self.length[self.link[state]] < run else self.top[self.link[state]]

    def _state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        ends.append([])
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int, ends: list) -> int:
        new = self._state(self.length[p] + 1, ends)
        self.next[new] = dict(self.next[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _add(self, last: int, c: int, ends: list) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q, ends)
        new, p = self._state(self.length[last] + 1, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q, ends)
        return new

    def runs(self, text: list[str], least: int = RUN) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each longest match of at least ``least`` words that can't be extended to the right."""
        state, n, ids, nxt, link, length = 0, 0, self.ids, self.next, self.link, self.length
        for at, word in enumerate(text):
            c = ids.get(word)
            following = nxt[state].get(c) if c is not None else None
            if following is None:
                if n >= least:
                    yield at - 1, n, state
                if c is None:
                    state = n = 0
                    continue
                while state and c not in nxt[state]:
                    state = link[state]
                n = min(n, length[state])
                following = nxt[state].get(c)
                if following is None:
                    state = n = 0
                    continue
            state, n = following, n + 1
        if n >= least:
            yield len(text) - 1, n, state

    def matches(self, text: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(end, length, item, place) of each run of equal words of text and item that can't be extended on either side."""
        state, n, ids, nxt, link, length = 0, 0, self.ids, self.next, self.link, self.length
        for at, word in enumerate(text):
            c = ids.get(word)
            if n >= self.run:
                yield from self._ended(at - 1, n, state, c)
            if c is None:
                state = n = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            following = nxt[state].get(c)
            state, n = (following, n + 1) if following is not None else (0, 0)
        if n >= self.run:
            yield from self._ended(len(text) - 1, n, state, None)

    def _ended(self, end: int, n: int, state: int, c: int | None) -> Iterator[tuple[int, int, int, int]]:
        """Runs that end here because their item goes on with another word than ``c``; shorter ones end in suffix states."""
        top = self.top[state]
        following = self.next[top].get(c) if c is not None else None
        carried = self.ends[following] if following is not None else ()
        if len(carried) == len(self.ends[top]):
            return
        carried, seen = set(carried), set()
        while self.length[state] >= self.run:
            for item, at in self.ends[state]:
                if (item, at) not in seen:
                    seen.add((item, at))
                    if (item, at + 1) not in carried:
                        yield end, n, item, at
            state = self.link[state]
            n = self.length[state]


def passages(runs: list[tuple[int, int, int]], gap: int = GAP, most: int = PASSAGES) -> tuple[int, list[tuple[int, int]]]:
    """Item words covered by the best one or two passages in the item's order, and the passages' places in the document.

    ``runs`` are (item start, document start, length). Runs form one passage if they follow each other in both texts with at
    most ``gap`` words between; a few changed or missing words don't break it.
    """
    runs = sorted(set(runs), key=lambda r: (r[1], r[0]))
    longest = max((n for _, _, n in runs), default=0)
    chains = []  # best chain ending in each run: words, first item word, last item word + 1, document span
    for k, (i0, d0, n) in enumerate(runs):
        best = (n, i0, i0 + n, d0, d0 + n)
        j = k - 1
        while j >= 0 and runs[j][1] >= d0 - longest - gap:  # those that can end near enough
            words_, first, i1, s, d1 = chains[j]
            cut = max(i1 - i0, d1 - d0, 0)  # the part that overlaps counts once
            if cut < n and -gap <= i1 - i0 and -gap <= d1 - d0 and i0 + n > i1 and d0 + n > d1 and words_ + n - cut > best[0]:
                best = (words_ + n - cut, first, i0 + n, s, d0 + n)
            j -= 1
        chains.append(best)
    if not chains:
        return 0, []
    top = max(chains, key=lambda c: c[0])
    total, spans = top[0], [top[3:]]
    if most > 1:
        # Chains by where they begin; before each, those that end no later than it begins, the best by the item word they end at.
        ended: dict[int, tuple] = {}
        by_end, at = sorted(chains, key=lambda c: c[4]), 0
        for b in sorted(chains, key=lambda c: c[3]):
            while at < len(by_end) and by_end[at][4] <= b[3]:
                a = by_end[at]
                if a[0] > ended.get(a[2], (0,))[0]:
                    ended[a[2]] = a
                at += 1
            first = max((a for i, a in ended.items() if i <= b[1]), key=lambda a: a[0], default=None)
            if first and first[0] + b[0] > total:
                total, spans = first[0] + b[0], [first[3:], b[3:]]
    return total, spans


def _scan(text: str, automaton: Automaton, coverage: float, length: int | None = None) -> list[tuple[int, float, list[list[int]]]]:
    found = words(text)
    by_item: dict[int, list] = {}
    for end, n, item, at in automaton.matches([w for w, _, _ in found]):
        by_item.setdefault(item, []).append((at - n + 1, end - n + 1, n))
    out = []
    for item, runs in by_item.items():
        least = coverage * automaton.size[item]
        held = 0
        if sum(n for _, _, n in runs) >= (least if length is None else min(least, length)):
            held, spans = passages(runs)
            if held < least and length is not None:
                held, spans = passages(runs, most=1)
        if held and (held >= least or length is not None and held >= length):
            out.append((item, round(held / automaton.size[item], 4), [[found[a][1], found[b - 1][2]] for a, b in spans]))
    return out


def _run_hashes(text: list[str], run: int = RUN) -> np.ndarray:
    """A number for each run of ``run`` words."""
    return np.fromiter((xxhash.xxh64_intdigest(" ".join(text[i : i + run])) for i in range(len(text) - run + 1)), dtype=np.uint64)


def _met(documents: DataFrame, blocks: list[list[tuple[int, list[str]]]]) -> DataFrame:
    """(doc_id, text, block): each document once for every block with an item that it shares a run of RUN words with.

    One pass over the documents. What is broadcast is a number for each run of the items, a bounded set of queries.
    """
    own = [np.unique(np.concatenate([_run_hashes(w) for _, w in b] or [np.empty(0, np.uint64)])) for b in blocks]
    hashes, place = np.concatenate(own), np.concatenate([np.full(len(h), i, dtype=np.int32) for i, h in enumerate(own)])
    order = np.argsort(hashes, kind="stable")
    shared = documents.sparkSession.sparkContext.broadcast((hashes[order], place[order]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, of = shared.value
        for f in frames:
            rows = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                h = np.unique(_run_hashes([w for w, _, _ in words(t)]))
                lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
                rows += [(d, t, b) for b in sorted({int(x) for i, j in zip(lo[lo < hi], hi[lo < hi], strict=True) for x in of[i:j]})]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "block"])

    return documents.mapInPandas(run, "doc_id long, text string, block int")


def leaks(documents: DataFrame, items: DataFrame, coverage: float = COVERAGE, length: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, coverage, spans) of each document that holds an item; spans are places (from, to) in its text.

    A document holds an item if one or two passages, in the item's order, have at least ``coverage`` of its words, where
    runs of four or more equal words that follow each other with gaps of up to three words are one passage; with ``length``,
    also if one passage has at least so many words. Items of fewer words than a run can't be found; null or empty items and
    texts hold and are held by nothing; equal items are all reported. The items are a stated, held-out set: they are
    collected and broadcast as words; every document is read once, however many they are.
    """
    spark = documents.sparkSession
    rows = items.where("text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator()  # a bounded set of queries
    queries = [(r.item_id, [w for w, _, _ in words(r.text)]) for r in rows]
    blocks = [queries[i : i + block] for i in range(0, len(queries), block)] or [[]]
    shared = spark.sparkContext.broadcast(blocks)
    texts = documents.where("text is not null").select("doc_id", "text")
    if len(blocks) == 1:
        met = texts.withColumn("block", F.lit(0))
    else:
        # Each task has documents of few blocks, one after another; a block that most documents meet is in many tasks.
        parts = max(len(blocks), partitions(spark))
        met = _met(texts, blocks).repartition(parts, "block", F.pmod(F.xxhash64("doc_id"), F.lit(-(-parts // len(blocks))))).sortWithinPartitions("block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, automaton = None, None
        for f in frames:
            out = []
            for d, t, b in zip(f["doc_id"], f["text"], f["block"], strict=True):
                if b != at:
                    at, automaton = b, Automaton(shared.value[b])
                out += [(d, *hit) for hit in _scan(t, automaton, coverage, length)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "coverage", "spans"])

    return met.mapInPandas(run, "doc_id long, item_id long, coverage double, spans array<array<int>>")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; those that overlap or touch are cut as one."""
    out, upto = [], 0
    for a, b in sorted(spans):
        out.append(text[upto : max(a, upto)])
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def cleaned(documents: DataFrame, items: DataFrame, coverage: float = COVERAGE, length: int | None = None) -> DataFrame:
    """(doc_id, text) of all documents with the leaked passages cut out; the others as they are, in the same rows.

    Passages of several items may overlap: their union is cut, and nothing outside it.
    """
    spans = leaks(documents, items, coverage, length).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))  # few items leak into one document

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [cut_spans(t, [tuple(s) for s in own]) if own is not None and isinstance(t, str) else t for t, own in zip(f["text"], f["spans"], strict=True)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": texts})

    return documents.select("doc_id", "text").join(spans, "doc_id", "left").mapInPandas(cut, "doc_id long, text string")
