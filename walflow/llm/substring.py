"""Substring dedup: runs of repeated word windows, hashed and dealt as edges of a De Bruijn graph.

Every window of ``WINDOW`` words is an edge of a De Bruijn graph. As in compacting
assemblers, edges are dealt out by minimizer: the least hash among a window's
``MINIMIZER``-word runs, so equal edges meet and consecutive edges of a document
mostly travel together, as one row of a binary exchange. An edge's source is the
smallest doc_id it starts in. Edges whose source lies before their own document
are repeats; consecutive repeats compact into paths (start, number of windows) of
their document, and these paths, joined to the documents by id and text digest,
cover the words to remove.

Edges are compared by a 64-bit hash of their words and 32 bits of their minimizer's
hash (equal windows have equal minimizers), 96 bits in all; what they say is judged
on the input alone. The graph itself is not built: there are no nodes, branching
test or compaction join, a path is a run of repeats within one document, and spans
are not verified at their source (see README).

Skew: each chunk of documents settles its own repeats first (the first document of
the chunk that has an edge makes all later ones repeats) and sends on one document
per edge, so a passage that a third of all rows share costs a row per chunk.

Defined cases: null text has no words; documents under ``WINDOW`` words lose
nothing; repeated doc_ids are not smaller than each other, so they never remove
each other's words; a null doc_id counts as larger than all; very long texts are
taken whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walflow.llm.common import NULL_ID, batches, encoded, read, sha, text_bytes, trim
from walflow.llm.hashing import BYTE_BASE, WORD_BASE, Rolling, slices, window_min, words

WINDOW, MINIMIZER = 13, 6
#: Text per chunk of the first stage, and per bucket of the exchange.
CHUNK_BYTES, BUCKET_BYTES = 12_000_000, 6_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_U32 = np.dtype("<u4")


def row_key(data: bytes) -> int:
    """A 64-bit digest of a text; with the doc_id it names a row (equal rows share all results)."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def edges(texts: list[bytes]):
    """(hash, minimizer, row, start) of every window of the texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, ends = words(data)
    if len(starts) < WINDOW:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    rolling = Rolling(Rolling(data, BYTE_BASE).runs(starts, ends), WORD_BASE)
    every = rolling.every(WINDOW)
    least = window_min(rolling.every(MINIMIZER), WINDOW - MINIMIZER + 1)
    inside = np.flatnonzero(row[: len(every)] == row[WINDOW - 1 :])
    first = np.searchsorted(row, np.arange(len(texts)))
    return every[inside], least[inside], row[inside], inside - first[row[inside]]


def runs_of(row: np.ndarray, start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of consecutive starts in one row (with equal values in `same`)."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(row)))


def least_by(key: np.ndarray, second: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each entry the least value among entries of equal (key, second)."""
    order = np.lexsort((second, key))
    k, s = key[order], second[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    low = np.minimum.reduceat(value[order], np.flatnonzero(new)) if len(k) else value
    out = np.empty_like(value)
    out[order] = low[np.cumsum(new) - 1] if len(k) else low
    return out


def pack(ids: np.ndarray, keys: np.ndarray, row, start, n, minimizer, hashes, settled) -> bytes:
    """Rows of one bucket: documents, runs of edges still open (with their hashes), runs already settled."""
    used, row_all = np.unique(np.concatenate([row, settled[0]]), return_inverse=True)
    head = np.array([len(used), len(row), len(hashes), len(settled[0])], dtype="<i8")
    parts = [head, ids[used].astype("<i8"), keys[used].astype("<i8"), row_all[: len(row)].astype(_U32), np.asarray(start, _U32), np.asarray(n, "<u2"), np.asarray(minimizer, _U32), hashes.astype("<u8")]
    parts += [row_all[len(row) :].astype(_U32), np.asarray(settled[1], _U32), np.asarray(settled[2], _U32)]
    return b"".join(p.tobytes() for p in parts)


def unpack(blob: bytes):
    d, r, h, s = np.frombuffer(blob, "<i8", 4)
    at, out = 32, []
    for dtype, n in (("<i8", d), ("<i8", d), (_U32, r), (_U32, r), ("<u2", r), (_U32, r), ("<u8", h), (_U32, s), (_U32, s), (_U32, s)):
        out.append(np.frombuffer(blob, dtype, int(n), at))
        at += int(n) * np.dtype(dtype).itemsize
    return out


def chunk_rows(ids: np.ndarray, texts: list[bytes], buckets: int):
    """The exchange rows (bucket, blob) of one chunk of documents."""
    found = [(h, m, r + a, s) for a, b in slices([len(t) for t in texts]) for h, m, r, s in [edges(texts[a:b])]]
    h, m, row, start = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64),) * 4
    if not len(h):
        return
    row, start = row.astype(np.int64), start.astype(np.int64)
    low = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    own = ids[row]
    repeat = least_by(h, low, own) < own
    keys = np.array([row_key(t) for t in texts], dtype=np.int64)
    bucket = ((m >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    open_ = np.flatnonzero(~repeat)
    at, n = runs_of(row[open_], start[open_], m[open_])
    pieces = np.minimum(n, 65535)
    if (n > 65535).any():  # one word for pages on end: cut the run
        at, n = runs_of(row[open_], start[open_], m[open_], start[open_] // 65535)
        pieces = n
    run_bucket = bucket[open_][at]
    done = np.flatnonzero(repeat)
    dat, dn = runs_of(row[done], start[done])
    done_bucket = row[done][dat] % buckets
    order, dorder = np.argsort(run_bucket, kind="stable"), np.argsort(done_bucket, kind="stable")
    cut, dcut = np.searchsorted(run_bucket[order], np.arange(buckets + 1)), np.searchsorted(done_bucket[dorder], np.arange(buckets + 1))
    for b in range(buckets):
        pick, dpick = order[cut[b] : cut[b + 1]], dorder[dcut[b] : dcut[b + 1]]
        if not len(pick) and not len(dpick):
            continue
        spot = np.repeat(at[pick] - np.cumsum(pieces[pick]) + pieces[pick], pieces[pick]) + np.arange(pieces[pick].sum())
        src, dsrc = open_[at[pick]], done[dat[dpick]]
        yield b, pack(ids, keys, row[src], start[src], pieces[pick], low[src], h[open_[spot]], (row[dsrc], start[dsrc], dn[dpick]))


def settle(blobs: list[bytes]):
    """(doc_id, key, start, n) of the repeated runs of one bucket."""
    parts = [unpack(b) for b in blobs]
    run_id = [np.repeat(p[0][p[2]], p[4]) for p in parts]
    own = np.concatenate(run_id)
    minimizer = np.concatenate([np.repeat(p[5], p[4]) for p in parts])
    hashes = np.concatenate([p[6] for p in parts])
    repeat = least_by(hashes, minimizer, own) < own
    out, at = [], 0
    for p in parts:
        ids, keys, row, start, n, _, h, drow, dstart, dn = p
        flag = repeat[at : at + len(h)]
        at += len(h)
        n = n.astype(np.int64)
        each = np.repeat(row, n)[flag].astype(np.int64)
        where = (np.repeat(start.astype(np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum()))[flag]
        first, length = runs_of(each, where)
        r = np.concatenate([each[first], drow.astype(np.int64)])
        out.append((ids[r], keys[r], np.concatenate([where[first], dstart.astype(np.int64)]), np.concatenate([length, dn.astype(np.int64)])))
    return [np.concatenate(x) for x in zip(*out)]


def repeated_paths(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, key, start, n): runs of n repeated windows from word `start` on; null ids as NULL_ID."""

    def deal(it):
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def out():
            rows = list(chunk_rows(np.array(ids, dtype=np.int64), texts, buckets))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

        for batch in it:
            for i, t in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                if texts and held + len(t) > CHUNK_BYTES:
                    yield out()
                    ids, texts, held = [], [], 0
                ids.append(NULL_ID if i is None else i)
                texts.append(t)
                held += len(t)
        if texts:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        i, k, s, n = settle(table.column("blob").to_pylist())
        trim()
        return pa.table({"doc_id": pa.array(i, pa.int64()), "key": pa.array(k, pa.int64()), "start": pa.array(s, pa.int64()), "n": pa.array(n, pa.int64())})

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(deal, "bucket int, blob binary")
    return rows.groupBy("bucket").applyInArrow(meet, "doc_id long, key long, start long, n long")


def with_paths(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, packed text and paths of every document; the text travels compressed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        texts = encoded(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([row_key(t) for t in texts], pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())], ["doc_id", "key", "packed"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(batches(run), "doc_id long, key long, packed binary")
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID)))
    listed = paths.groupBy(F.col("doc_id").alias("id"), "key").agg(F.collect_list(F.struct("start", "n")).alias("paths"))
    return rows.join(listed, ["id", "key"], "left").select("doc_id", "packed", "paths")


def kept_words(text: bytes, paths: list | None) -> tuple[list[bytes], int]:
    """The words left, and how many there were."""
    every = _WORD.findall(text)
    if not paths:
        return every, len(every)
    keep = np.ones(len(every), dtype=bool)
    for p in paths:
        keep[p["start"] : p["start"] + p["n"] + WINDOW - 1] = False
    return [w for w, k in zip(every, keep.tolist()) if k], len(every)


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text) and, if asked for, the kept text."""
    buckets = max(1, -(-text_bytes(docs) // BUCKET_BYTES))
    rows = with_paths(docs, repeated_paths(docs, buckets))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        open_ = zstandard.ZstdDecompressor()
        n, removed, digest, kept_texts = [], [], [], []
        for packed, paths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kept, total = kept_words(open_.decompress(packed), paths)
            text = b" ".join(kept)
            n.append(total)
            removed.append(total - len(kept))
            digest.append(sha(text))
            kept_texts.append(text.decode("utf-8", "replace") if with_text else None)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array(kept_texts, pa.string()))
            names.append("text")
        return pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(batches(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))
