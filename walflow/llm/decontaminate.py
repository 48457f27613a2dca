"""Benchmark decontamination: a BM25 index of the test items, searched with every training passage.

The index holds one posting list per term, cut into blocks that carry their
greatest impact. Every document is cut into overlapping passages of whole words
(runs of letters and digits, A-Z lower-cased); each passage is a query, and every
item whose BM25 score reaches the item's own threshold (``RETRIEVE`` of the score
it has against itself) is retrieved. Bounds settle most passages in one vectorised
step: the commonest terms of an item that together stay under its threshold are
its non-essential ones, and an item can only be reached if they and the passage's
hits on the item's essential terms add up to the threshold. Passages with such an
item run block-max WAND. Retrieved items are verified on the words themselves: the
item counts as leaked if its question part and its answer part (the last sentence,
or the last third of a one-sentence item) are both covered to ``OVERLAP`` by
``SHINGLE``-word shingles (shorter ones for parts under 15 words) in the passage.

Passages are two strides long and a stride is at least the longest item of the
benchmark, so every item lies whole within a passage. Items are indexed in chunks
of ``CHUNK_ITEMS``; one chunk's index is built and sent at a time, and further chunks are
further passes over the documents, whose results are written in between. Item count,
mean and greatest length and document frequencies are those of all items, so the
chunks do not show in the result.

Defined cases: null or empty texts, of documents or items, match nothing; equal
items are each reported; repeated rows are kept; very long texts are cut into
passages like others; ties are all returned; extra columns are ignored by `find`
and kept by `with_leaks`, whatever their names. The vectorised bound settles nearly all
passages and block-max WAND only the few it leaves (46 of 5,589 at sf0.01); it is exact.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walflow.llm.common import batches, encoded, read, save, small_batches
from walflow.llm.hashing import BYTE_BASE, LOWER, NOT_WORD, Rolling, slices, words

K1, B = 1.2, 0.75
RETRIEVE, OVERLAP, SHINGLE = 0.6, 0.8, 5
LEAST_STRIDE, BLOCK, CHUNK_ITEMS = 64, 32, 20_000
#: How much of an item's threshold its non-essential terms may add up to.
NON_ESSENTIAL = 0.5
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SENTENCE = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+")


def tokens(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())  # bytes.lower() folds A-Z alone


def split_item(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer words: the answer is the last sentence, or the last third of a single one."""
    parts = [tokens(p) for p in _SENTENCE.split(text.strip())]
    parts = [p for p in parts if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    every = parts[0] if parts else []
    cut = len(every) - len(every) // 3
    return every[:cut], every[cut:]


def coverage(part: list[bytes], text: bytes) -> float:
    """The share of the part's shingles that occur in `text` (words joined and framed by blanks)."""
    if not part:
        return 1.0
    n = min(SHINGLE, max(1, len(part) // 3))
    grams = [b" " + b" ".join(part[i : i + n]) + b" " for i in range(len(part) - n + 1)]
    return sum(g in text for g in grams) / len(grams)


class Statistics(NamedTuple):
    """Of all items of a benchmark; `df` may be cut to the terms in use."""

    items: int
    words: int
    longest: int
    df: Mapping[bytes, int]


class Index:
    """BM25 postings of a chunk of items with block maxima, scored by the statistics of all items (by default, these)."""

    def __init__(self, items: list[tuple[int, bytes]], stats: Statistics | None = None):
        self.items = sorted((i, t) for i, t in items if tokens(t))
        docs = [tokens(t) for _, t in self.items]
        self.parts = [split_item(t) for _, t in self.items]
        if stats is None:
            stats = Statistics(len(docs), sum(map(len, docs)), max(map(len, docs), default=0), Counter(w for ws in docs for w in set(ws)))
        mean = stats.words / stats.items if docs else 1.0
        tf: dict[bytes, dict[int, int]] = {}
        for d, ws in enumerate(docs):
            for w in ws:
                tf.setdefault(w, {})
                tf[w][d] = tf[w].get(d, 0) + 1
        self.postings: dict[bytes, tuple[list[int], list[float], list[float]]] = {}
        own = [0.0] * len(docs)
        for w, by in tf.items():
            idf = math.log(1 + (stats.items - stats.df[w] + 0.5) / (stats.df[w] + 0.5))
            ids = sorted(by)
            impact = [idf * by[d] * (K1 + 1) / (by[d] + K1 * (1 - B + B * len(docs[d]) / mean)) for d in ids]
            for d, x in zip(ids, impact):
                own[d] += x
            self.postings[w] = ids, impact, [max(impact[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
        self.thresholds = [RETRIEVE * x for x in own]
        self.least = min(self.thresholds, default=math.inf)
        self.stride = max(LEAST_STRIDE, stats.longest)
        # Each item's essential postings by term hash, and what its other terms can add at most.
        order = sorted(self.postings, key=lambda w: (-len(self.postings[w][0]), w))
        self.rest = np.zeros(len(docs))
        essential: dict[bytes, list[tuple[int, float]]] = {}
        for w in order:
            for d, x in zip(*self.postings[w][:2]):
                if self.rest[d] + x < NON_ESSENTIAL * self.thresholds[d]:
                    self.rest[d] += x
                else:
                    essential.setdefault(w, []).append((d, x))
        names = list(essential)
        flat = np.frombuffer(b" ".join(names) + b" ", dtype=np.uint8)
        starts, ends = words(flat, NOT_WORD)
        hashes = Rolling(flat, BYTE_BASE).runs(starts, ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        lists = [essential[names[i]] for i in order]
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.to_item = np.array([d for x in lists for d, _ in x], dtype=np.int64)
        self.impact = np.array([x for y in lists for _, x in y])

    def search(self, terms: set[bytes]) -> list[tuple[int, float]]:
        """Block-max WAND: (place of item, score) of every item that reaches its threshold."""
        lists = [[0, *self.postings[t], max(self.postings[t][2])] for t in sorted(terms) if t in self.postings]
        out = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[4]
                if total >= self.least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == doc:
                pivot += 1
            # The blocks that hold the first posting at or after the pivot bound its score.
            block, border = 0.0, None
            for x in lists[: pivot + 1]:
                at = self._place(x, doc)
                if at < len(x[1]):
                    block += x[3][at // BLOCK]
                    last = x[1][min(len(x[1]), (at // BLOCK + 1) * BLOCK) - 1]
                    border = last if border is None else min(border, last)
            if block >= self.thresholds[doc] - 1e-9:
                score = 0.0
                for x in lists[: pivot + 1]:
                    x[0] = self._place(x, doc)
                    if x[0] < len(x[1]) and x[1][x[0]] == doc:
                        score += x[2][x[0]]
                        x[0] += 1
                if score >= self.thresholds[doc] - 1e-9:
                    out.append((doc, score))
                target = doc + 1
            else:
                # Thresholds differ by item: only past the pivot itself unless the block cannot reach any threshold.
                target = doc + 1
                if block < self.least - 1e-9 and border is not None:
                    beyond = lists[pivot + 1][1][lists[pivot + 1][0]] if pivot + 1 < len(lists) else border + 1
                    target = max(target, min(border + 1, beyond))
            for x in lists[: pivot + 1]:
                x[0] = self._place(x, target)
            lists = [x for x in lists if x[0] < len(x[1])]
        return out

    @staticmethod
    def _place(x, doc: int) -> int:
        """The place of the first posting of list x, from its cursor on, that is not before doc."""
        at, ids = x[0], x[1]
        while at < len(ids) and ids[at] < doc:
            at = (at // BLOCK + 1) * BLOCK if ids[min(len(ids), (at // BLOCK + 1) * BLOCK) - 1] < doc else at + 1
        return min(at, len(ids))

    def verify(self, item: int, text: bytes) -> tuple[float, float]:
        question, answer = self.parts[item]
        return coverage(question, text), coverage(answer, text)

    def leaks(self, texts: list[bytes]) -> list[list[tuple[int, float, float, float]]]:
        """For each text its leaked items: (item_id, best score, question overlap, answer overlap)."""
        out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
        if not self.items:
            return out
        data = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
        starts, ends = words(data, NOT_WORD)
        if not len(starts) or not len(self.hashes):
            return out
        hashes = Rolling(data, BYTE_BASE).runs(starts, ends)
        term = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[term] == hashes)
        borders = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(starts, np.concatenate([[0], borders[:-1]]))
        last = np.searchsorted(starts, borders)
        counts = np.maximum(1, -(-(last - first) // self.stride) - 1) * (last > first)
        doc = np.repeat(np.arange(len(texts)), counts)
        before = np.cumsum(counts) - counts
        nth = np.arange(len(doc)) - before[doc]
        a = first[doc] + nth * self.stride
        b = np.minimum(a + 2 * self.stride, last[doc])
        # Essential hits as (passage, item, impact); a word lies in its stride's passage and the one before.
        own = np.searchsorted(borders, starts[hit], side="right")
        block = (hit - first[own]) // self.stride
        passage = np.concatenate([before[own] + np.minimum(block, counts[own] - 1), before[own] + block - 1])
        use = np.concatenate([np.ones(len(hit), dtype=bool), (block > 0) & (block <= counts[own] - 1)])
        once = np.unique(passage[use] * len(self.hashes) + np.concatenate([term[hit], term[hit]])[use])
        passage, which = once // len(self.hashes), once % len(self.hashes)
        many = self.begin[which + 1] - self.begin[which]
        spot = np.repeat(self.begin[which] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pair, place = np.unique(np.repeat(passage, many) * len(self.items) + self.to_item[spot], return_inverse=True)
        reach = np.bincount(place, self.impact[spot], len(pair)) + self.rest[pair % len(self.items)]
        live = np.unique(pair[reach >= np.array(self.thresholds)[pair % len(self.items)] - 1e-6] // len(self.items))
        for p in live:
            passage = data[starts[a[p]] : ends[b[p] - 1]].tobytes()
            ws = _WORD.findall(passage)
            hits = self.search(set(ws))
            if hits:
                joined = b" " + b" ".join(ws) + b" "
                for item, score in hits:
                    q, w = self.verify(item, joined)
                    if q >= OVERLAP and w >= OVERLAP:
                        out[doc[p]].append((self.items[item][0], score, q, w))
        return [sorted({i: max(x for x in xs if x[0] == i) for i in {x[0] for x in xs}}.values()) for xs in out]


def _chunks(items: DataFrame):
    """Indexes of CHUNK_ITEMS items each; one chunk at a time, with its terms' frequencies, is in the driver's memory."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = items.count()
    parts = max(1, -(-n // CHUNK_ITEMS))
    if parts == 1:
        yield Index([(r.item_id, r.text.encode()) for r in items.distinct().collect()])
        return
    rows = items.distinct().withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [tokens(t) for t in encoded(batch.column(0))]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(map(len, found), pa.int64()), pa.array([sorted(set(ws)) for ws in found], pa.list_(pa.binary()))], ["part", "words", "terms"])

    counted = save(rows.select("text", "part").mapInArrow(batches(run), "part long, words long, terms array<binary>").where("words > 0"), "decontamination-terms")
    total = counted.agg(F.count("*").alias("items"), F.sum("words").alias("words"), F.max("words").alias("longest")).first()
    terms = counted.select("part", F.explode("terms").alias("term"))
    df = save(terms.groupBy("term").agg(F.count("*").alias("df")), "decontamination-df")
    for part in range(parts):
        chunk = [(r.item_id, r.text.encode()) for r in rows.where(F.col("part") == part).collect()]
        known = {bytes(r.term): r.df for r in df.join(terms.where(F.col("part") == part), "term", "left_semi").collect()}
        yield Index(chunk, Statistics(total["items"], total["words"] or 0, total["longest"] or 0, known))


LEAK = "array<struct<item_id long, score double, question double, answer double>>"


def with_leaks(docs: DataFrame, items: DataFrame, name: str = "leaks") -> DataFrame:
    """`docs` (with text) and a last column `name` of the items found in each row; a column that has this name is replaced.

    Each chunk of items is one pass over the documents; between passes what is found so far is written, so one
    index at a time is sent out and held."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    rows = small_batches(docs).select(*kept).withColumn(name, F.array().cast(LEAK))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
    at = kept.index("text")

    def step(index: Index):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = encoded(batch.column(at))
            found = [x for a, b in slices([len(t) for t in texts]) for x in index.leaks(texts[a:b])]
            old = batch.column(batch.num_columns - 1).to_pylist()
            leaks = [(o or []) + [dict(zip(("item_id", "score", "question", "answer"), f)) for f in fs] for o, fs in zip(old, found)]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(leaks, kind)], batch.schema.names)

        return batches(run)

    for k, index in enumerate(_chunks(items)):
        rows = (save(rows, "decontamination-pass") if k else rows).mapInArrow(step(index), rows.schema)
    return rows


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every leak."""
    found = with_leaks(docs.selectExpr("cast(doc_id as long) doc_id", "text"), items)
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.score", F.col("l.question").alias("question_overlap"), F.col("l.answer").alias("answer_overlap"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
