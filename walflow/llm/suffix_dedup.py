"""Suffix-array dedup: a depth-limited radix sort that finds every repeated byte string of threshold length.

Suffixes are compared through their first ``THRESHOLD`` bytes only. Sorting all
suffixes of a corpus would move THRESHOLD times its size, so suffixes are grouped
first by a digit that every one of them holds: the minimizer of its first
THRESHOLD bytes, i.e. the place (anchor) with the least hash among the ``GRAM``-byte
strings in it. Equal suffixes have equal anchors at equal offsets, so

1. anchors are counted by hash; those that occur once belong to unrepeated suffixes,
2. the others bring their context (what suffixes around them can cover), and within
   a group of equal anchors the suffixes of each offset are sorted by most
   significant digit: passes over ``DIGITS`` digits, each keeping only the groups
   that still have two members; the groups left at full depth are exactly the
   repeated windows,
3. of an anchor's repeated suffixes the first and the last suffice: all of them hold
   the anchor, so their union is one run of bytes.

Texts that occur several times as a whole are repeated in full; one of them stands
for all in the steps above, so a hot group of copies costs one row. An anchor with
more than ``GROUP`` members has its equal contexts merged, and parted by the bytes that the
suffixes of a range of offsets share, before they are sorted; if a part still has
more than GROUP distinct ones, they are sorted in salted parts, each part
sends one suffix of each distinct kind, and suffixes alone in their part are looked
up among the other parts. Rows of an anchor, context or text that more than ``HOT`` rows
share are not dealt by it for a join: the other side comes to them. Nothing is capped.

Defined cases: null text is empty; texts under THRESHOLD bytes lose nothing;
repeated rows are copies of each other; overlapping repeats inside one text count;
very long texts are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walflow.llm.common import NULL_ID, batches, encoded, int64s, read, save, sha, trim
from walflow.llm.hashing import BYTE_BASE, Rolling, mix, slices, window_min

THRESHOLD, GRAM, DIGITS = 400, 64, 4
#: Contexts per sorted group at most, per bucket of groups on average, and in a group settled by comparison.
GROUP, BUCKET, SMALL = 40_000, 2000, 8
#: Rows of one value from which joins leave them in place, and how many values may be so at most.
HOT, HOT_VALUES = 1000, 20_000
#: Ranges of offsets by which groups larger than GROUP are parted first.
RANGES = 8


def text_key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def anchors(texts: list[bytes], threshold: int = THRESHOLD, gram: int = GRAM):
    """(row, position, hash) of the minimizers of all `threshold`-byte windows of the texts."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    grams = Rolling(data, BYTE_BASE).every(gram)
    reach = threshold - gram + 1
    if len(grams) < reach:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    bits = np.uint64(len(grams).bit_length())
    ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = window_min(ranked, reach)
    inside = np.zeros(len(least) + 1, dtype=np.int64)  # windows [start, end - threshold] of each text
    for start, end in zip(np.concatenate([[0], ends[:-1]]), ends - 1):
        if end - start >= threshold:
            inside[start] += 1
            inside[end - threshold + 1] -= 1
    kept = least[np.cumsum(inside[:-1]) > 0]
    at = np.unique(kept & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(ends, at, side="right")
    return row, at - np.concatenate([[0], ends])[row], grams[at]


def frame(contexts: list[bytes], lefts: np.ndarray, before: int, width: int) -> np.ndarray:
    """The contexts as rows of one array, their anchors all in column `before`."""
    lens = np.array([len(c) for c in contexts])
    flat = np.zeros((len(contexts), width), dtype=np.uint8)
    column = np.arange(width)
    for a in range(0, len(contexts), 1000):  # the masks are as large as what they select
        left, n = lefts[a : a + 1000, None], lens[a : a + 1000, None]
        flat[a : a + 1000][(column >= before - left) & (column < before - left + n)] = np.frombuffer(b"".join(contexts[a : a + 1000]), dtype=np.uint8)
    return flat


def offsets(lens: np.ndarray, lefts: np.ndarray, threshold: int, before: int):
    """(context, offset) of every suffix of threshold length in the contexts, by context and offset."""
    first, last = before - lefts, np.minimum(before, before - lefts + lens - threshold)
    counts = np.maximum(0, last - first + 1)
    row = np.repeat(np.arange(len(lens)), counts)
    return row, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]


def radix_passes(groups: np.ndarray, contexts: list[bytes], lefts: np.ndarray, threshold: int, before: int, digits: int = DIGITS):
    """First and last offset at which each context's suffix shares all `threshold` bytes with another of its group.

    Offset by offset, in memory that grows with the number of contexts alone: the digits'
    hashes roll along, and each pass keeps the suffixes whose group still has two members.
    """
    n = len(contexts)
    columns = np.ascontiguousarray(frame(contexts, lefts, before, before + threshold).T)
    lens = np.array([len(c) for c in contexts])
    first, last = before - lefts, np.minimum(before, before - lefts + lens - threshold)
    low, high = np.full(n, before + 1), np.full(n, -1)
    cuts = np.linspace(0, threshold, digits + 1).astype(int)
    base = np.uint64(BYTE_BASE)
    top = [np.uint64(pow(BYTE_BASE, int(b - a - 1), 1 << 64)) for a, b in zip(cuts[:-1], cuts[1:])]
    value = lambda c: columns[c].astype(np.uint64) + np.uint64(1)
    digit = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        h = np.zeros(n, dtype=np.uint64)
        for c in range(a, b):
            h = h * base + value(c)
        digit.append(h)
    for s in range(before + 1):
        live = np.flatnonzero((first <= s) & (s <= last))
        key = groups[live]
        for h in digit:
            if len(live) < 2:
                break
            key = mix(key * np.uint64(3) ^ mix(h[live]))
            order = np.argsort(key)
            ranked = key[order]
            same = np.zeros(len(ranked) + 1, dtype=bool)
            same[1:-1] = ranked[1:] == ranked[:-1]
            keep = order[same[1:] | same[:-1]]
            live, key = live[keep], key[keep]
        if len(live) > 1:
            low[live] = np.minimum(low[live], s)
            high[live] = s
        if s < before:
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                digit[k] = (digit[k] - value(a + s) * top[k]) * base + value(b + s)
    return low, high


def compare_pairs(x: np.ndarray, y: np.ndarray, contexts: list[bytes], lefts: np.ndarray, threshold: int, before: int):
    """For pairs of contexts: the bytes they share to the left of the anchor and from it on."""
    rights = np.array([len(c) for c in contexts]) - lefts
    flat = frame(contexts, lefts, before, before + threshold)
    left, right = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), 8192):
        p, q = x[a : a + 8192], y[a : a + 8192]
        differ = flat[p] != flat[q]
        l, r = differ[:, :before][:, ::-1], differ[:, before:]
        left[a : a + 8192] = np.minimum(np.where(l.any(axis=1), l.argmax(axis=1), before), np.minimum(lefts[p], lefts[q]))
        right[a : a + 8192] = np.minimum(np.where(r.any(axis=1), r.argmax(axis=1), threshold), np.minimum(rights[p], rights[q]))
    return left, right


def repeated(groups: np.ndarray, contexts: list[bytes], lefts: np.ndarray, threshold: int = THRESHOLD, gram: int = GRAM, small: int = SMALL):
    """First and last offset of each context's repeated suffixes (first > last: none).

    Offsets count from `threshold - gram` bytes before the anchor. Contexts of a group
    must be distinct; groups up to `small` are settled by comparison, as usual where a
    radix sort has few keys left, larger ones by `radix_passes`.
    """
    before = threshold - gram
    n = len(contexts)
    low, high = np.full(n, before + 1), np.full(n, -1)
    order = np.argsort(groups, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], groups[order][1:] != groups[order][:-1]]))[:n]
    size = np.diff(np.append(start, n))
    x, y = [], []
    for g in range(2, small + 1):
        at = start[size == g]
        for i in range(g):
            for j in range(i + 1, g):
                x.append(order[at + i])
                y.append(order[at + j])
    if x and sum(map(len, x)):
        x, y = np.concatenate(x), np.concatenate(y)
        left, right = compare_pairs(x, y, contexts, lefts, threshold, before)
        fits = left + right >= threshold
        for z in (x[fits], y[fits]):
            np.minimum.at(low, z, before - left[fits])
            np.maximum.at(high, z, np.minimum(before, before + right[fits] - threshold))
    large = order[np.repeat(size > small, size)]
    if len(large):
        low[large], high[large] = radix_passes(groups[large], [contexts[i] for i in large], lefts[large], threshold, before)
    return low, high


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_runs(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join(out) + text[at:]


def frequent(counts: DataFrame, on: str, n: str) -> DataFrame | None:
    """The values of (on, n) that more than HOT rows share, if any; each has over a HOT_VALUES-th of all rows, so they are few."""
    least = max(HOT, (counts.agg(F.sum(n)).first()[0] or 0) // HOT_VALUES)
    hot = counts.where(F.col(n) > least).select(on)
    return None if hot.isEmpty() else hot


def spread_join(rows: DataFrame, facts: DataFrame, on: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with facts; rows of a hot value, which must be among the facts, stay where they are instead of meeting in one task."""
    if hot is None:
        return rows.join(facts, on, how)
    stay = rows.join(F.broadcast(facts.join(F.broadcast(hot), on, "left_semi")), on)
    return rows.join(F.broadcast(hot), on, "left_anti").join(facts, on, how).unionByName(stay)


def scan_texts(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_bytes and the digest of the whole text of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = encoded(batch.column(1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([text_key(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([sha(t) for t in texts], pa.string())],
            ["doc_id", "key", "n_bytes", "whole_sha256"],
        )

    return docs.mapInArrow(batches(run), "doc_id long, key binary, n_bytes long, whole_sha256 string")


def scan_anchors(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    def run(batch: pa.RecordBatch):
        texts = encoded(batch.column(1))
        for a, b in slices([len(t) for t in texts]):
            part = list({text_key(t): t for t in texts[a:b] if len(t) >= threshold}.items())
            if part:
                row, at, hashes = anchors([t for _, t in part], threshold, gram)
                keys = pa.array([k for k, _ in part], pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([int64s(hashes), keys, pa.array(at, pa.int64())], ["anchor", "key", "pos"])

    return docs.mapInArrow(batches(run), "anchor long, key binary, pos long")


def pack_contexts(entries, buckets: int, group: int) -> pa.RecordBatch:
    """(bucket, blob) of entries (anchor, members, key, pos, bytes before the anchor, context)."""
    press = zstandard.ZstdCompressor(level=3)
    out: dict[int, list] = {}
    for anchor, n, key, pos, left, context in entries:
        parts = -(-n // group)
        salt = int.from_bytes(hashlib.blake2b(key + pos.to_bytes(8, "little"), digest_size=4).digest(), "little") % parts
        out.setdefault((anchor + salt * 0x9E3779B1) % buckets, []).append((anchor, salt, parts, key, pos, left, context))
    blobs = []
    for rows in out.values():
        anchor, salt, parts, key, pos, left, context = zip(*rows)
        numbers = np.array([anchor, salt, parts, pos, left, [len(c) for c in context]], dtype="<i8")
        blobs.append(press.compress(len(rows).to_bytes(8, "little") + numbers.tobytes() + b"".join(key) + b"".join(context)))
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def contexts_of(batch: pa.RecordBatch, before: int, threshold: int, wanted):
    """(anchor, n, key, pos, left, context) of the anchors of a batch (key, packed, anchors) whose n is wanted."""
    open_ = zstandard.ZstdDecompressor()
    for key, packed, listed in zip(*(c.to_pylist() for c in batch.columns)):
        text = None
        for x in listed:
            if wanted(x["n"]):
                text = open_.decompress(packed) if text is None else text
                a = max(0, x["pos"] - before)
                yield x["anchor"], x["n"], key, x["pos"], x["pos"] - a, text[a : x["pos"] + threshold]


def deal_contexts(found: DataFrame, buckets: int, group: int, threshold: int, gram: int) -> DataFrame:
    """(bucket, blob): the anchors of found (key, packed, anchors) in groups up to `group`, equal anchors in one bucket."""
    before = threshold - gram

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pack_contexts(contexts_of(batch, before, threshold, lambda n: n <= group), buckets, group)

    return found.mapInArrow(batches(run), "bucket int, blob binary")


def large_groups(found: DataFrame, group: int, threshold: int, gram: int) -> DataFrame:
    """(key, start, end) of the repeated runs around anchors with more than `group` members.

    Their equal contexts are merged before they meet, so what is sorted (and salted, if it is
    still too much) is distinct contexts; results go back to the members by context digest.
    """
    before = threshold - gram

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: set[bytes] = set()
        rows = []
        for anchor, _, key, pos, left, context in contexts_of(batch, before, threshold, lambda n: n > group):
            digest = hashlib.blake2b(anchor.to_bytes(8, "little", signed=True) + left.to_bytes(4, "little") + context, digest_size=16).digest()
            rows.append((anchor, digest, key, pos, left, None if digest in seen else context))
            seen.add(digest)
        anchor, digest, key, pos, left, context = zip(*rows) if rows else ((),) * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()), pa.array(digest, pa.binary()), pa.array(key, pa.binary()), pa.array(pos, pa.int64()), pa.array(left, pa.int64()), pa.array(context, pa.binary())],
            ["anchor", "digest", "key", "pos", "left", "context"],
        )

    hot = found.where(F.exists("anchors", lambda a: a["n"] > group)).mapInArrow(batches(spread), "anchor long, digest binary, key binary, pos long, left long, context binary")
    hot = save(hot, "suffix-hot")
    distinct = hot.groupBy("anchor", "digest").agg(F.count("*").alias("members"), F.first("left").alias("left"), F.first("context", True).alias("context"))
    # The first digits: suffixes of neighbouring offsets share the bytes from the last one's start to the first one's end, so
    # for each range of offsets groups part by those, and contexts that are equal in what the range can reach merge again.
    cuts = np.unique(np.linspace(0, before + 1, RANGES + 1).astype(int)).tolist()
    pieces = []
    for s0, s1 in zip(cuts[:-1], [c - 1 for c in cuts[1:]]):
        fits = F.expr(f"greatest({s0}, {before} - left) <= least({s1}, {before} - left + octet_length(context) - {threshold})")
        core = F.expr(f"substring(context, cast(left as int) - {before - s1} + 1, {threshold - (s1 - s0)})")
        reach = F.expr(f"substring(context, greatest(cast(left as int) - {before - s0}, 0) + 1, least(cast(left as int), {before - s0}) + {gram + s1})")
        pieces.append(F.when(fits, F.struct(F.lit(s0).alias("range"), core.alias("core"), F.least("left", F.lit(before - s0)).alias("left"), reach.alias("context"))))
    place = F.concat(F.concat_ws(":", F.col("anchor").cast("string"), F.col("p.range").cast("string"), F.col("p.left").cast("string"), F.lit("")).cast("binary"), F.col("p.context"))
    named = distinct.withColumn("p", F.explode(F.array(*pieces))).where("p is not null").select(
        F.xxhash64("anchor", "p.range", "p.core").alias("anchor"), F.unhex(F.substring(F.sha2(place, 256), 1, 32)).alias("piece"), "digest", "members", "p.left", "p.context"
    )
    named = save(named, "suffix-pieces")
    distinct = named.groupBy("anchor", F.col("piece").alias("digest")).agg(F.sum("members").alias("members"), F.first("left").alias("left"), F.first("context").alias("context"))
    distinct = save(distinct, "suffix-distinct")
    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("members").alias("all")).where(F.col("all") > 1).select("anchor", "n")
    buckets = max(1, -(-distinct.count() // BUCKET))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(batch.column(c).to_pylist() for c in ("anchor", "n", "digest", "left", "context", "members")))
        # A context with several members goes twice: it repeats itself.
        return pack_contexts(((a, n, d, 0, left, c) for a, n, d, left, c, m in rows for _ in range(min(m, 2))), buckets, group)

    dealt = spread_join(distinct, per_anchor, "anchor", frequent(per_anchor, "anchor", "n")).mapInArrow(batches(run), "bucket int, blob binary")
    runs = merged(save(sort_groups(dealt, threshold, gram), "suffix-large"), True).groupBy(F.col("key").alias("piece")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    usual = frequent(named.groupBy("piece").agg(F.count("*").alias("n")), "piece", "n")
    # All runs of a context hold its anchor, so they make one.
    runs = spread_join(named.select("piece", "digest"), runs, "piece", usual).groupBy("digest").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    members = hot.select(F.col("digest"), F.col("key").alias("member"), "pos")
    common = frequent(hot.groupBy("digest").agg(F.count("*").alias("n")), "digest", "n")
    return spread_join(members, runs, "digest", common).select(F.col("member").alias("key"), (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end"))


def merged(pieces: DataFrame, split: bool) -> DataFrame:
    """(key, start, end) of sorted groups; suffixes that meet only across the parts of a split group are added."""
    runs = pieces.where("suffix is null").select("key", "start", "end")
    if not split:
        return runs
    apart = pieces.where("suffix is not null")
    across = apart.groupBy("suffix").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("suffix")
    return runs.unionByName(apart.join(across, "suffix", "left_semi").select("key", "start", "end"))


def sort_groups(dealt: DataFrame, threshold: int, gram: int) -> DataFrame:
    """Repeated runs (key, start, end) of each bucket; of salted groups also every distinct suffix, with its `suffix` key and `part`."""
    before = threshold - gram

    def run(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        numbers, keys, contexts = [], [], []
        for blob in table.column("blob").to_pylist():
            blob = open_.decompress(blob)
            n = int.from_bytes(blob[:8], "little")
            x = np.frombuffer(blob, "<i8", 6 * n, 8).reshape(6, n)
            at = 8 + 48 * n
            keys += [blob[at + 16 * i : at + 16 * i + 16] for i in range(n)]
            borders = at + 16 * n + np.concatenate([[0], np.cumsum(x[5])])
            contexts += [blob[a:b] for a, b in zip(borders[:-1], borders[1:])]
            numbers.append(x)
        anchor, salt, parts, pos, left, length = np.concatenate(numbers, axis=1)
        groups = mix(anchor.view(np.uint64) ^ mix(salt.astype(np.uint64) + np.uint64(1)))
        # Equal contexts repeat each other in full; one of them stands for all in the sort.
        names: dict[tuple, int] = {}
        member = np.array([names.setdefault((g, k, c), len(names)) for g, k, c in zip(groups.tolist(), left.tolist(), contexts)])
        one = np.unique(member, return_index=True)[1]
        twice = np.bincount(member) > 1
        low, high = repeated(groups[one], [contexts[i] for i in one], left[one], threshold, gram)
        low[twice] = (before - left[one])[twice]
        high[twice] = np.minimum(before, before - left[one] + length[one] - threshold)[twice]
        out = {"key": [], "start": [], "end": [], "suffix": [], "part": []}
        hit = np.flatnonzero((low <= high)[member])
        out["key"] += [keys[i] for i in hit]
        out["start"] += (pos[hit] - before + low[member[hit]]).tolist()
        out["end"] += (pos[hit] - before + high[member[hit]] + threshold).tolist()
        out["suffix"] += [None] * len(hit)
        out["part"] += [None] * len(hit)
        split = one[parts[one] > 1]
        if len(split):
            # The same suffix of another part has another group id: name it by the anchor alone.
            row, offset = offsets(length[split], left[split], threshold, before)
            suffix = whole_keys(mix(anchor.view(np.uint64))[split], [contexts[i] for i in split], left[split], row, offset, threshold, before)
            first = np.unique(mix(suffix ^ mix(salt[split][row].astype(np.uint64))), return_index=True)[1]
            owner = split[row[first]]
            out["key"] += [keys[i] for i in owner]
            out["start"] += (pos[owner] - before + offset[first]).tolist()
            out["end"] += (pos[owner] - before + offset[first] + threshold).tolist()
            out["suffix"] += suffix[first].view(np.int64).tolist()
            out["part"] += salt[owner].tolist()
        trim()
        return pa.table({"key": pa.array(out["key"], pa.binary()), "start": pa.array(out["start"], pa.int64()), "end": pa.array(out["end"], pa.int64()), "suffix": pa.array(out["suffix"], pa.int64()), "part": pa.array(out["part"], pa.int64())})

    return dealt.groupBy("bucket").applyInArrow(run, "key binary, start long, end long, suffix long, part long")


def whole_keys(groups, contexts, lefts, row, offset, threshold, before):
    """Keys of suffixes by anchor, offset and all their bytes."""
    flat = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])[:-1]
    start = base[row] + offset - (before - lefts[row])
    return mix(mix(groups[row] ^ (offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) ^ Rolling(flat, BYTE_BASE).runs(start, start + threshold))


def repeated_runs(docs: DataFrame, meta: DataFrame, copies: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(key, runs) of the distinct texts that hold repeats, and (key, packed) of the texts concerned."""
    listed = save(scan_anchors(docs, threshold, gram), "suffix-anchors")
    place = F.struct("key", "pos")
    shared = listed.groupBy("anchor").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n")).where("lo != hi").select("anchor", "n")
    shared = save(shared, "suffix-shared")
    hits = spread_join(listed, shared, "anchor", frequent(shared, "anchor", "n")).groupBy("key").agg(F.collect_set(F.struct("anchor", "pos", "n")).alias("anchors"))
    hits = save(hits.join(copies, "key").select("id", "key", "anchors"), "suffix-hits")
    size = hits.agg(F.sum(F.size("anchors")), F.max(F.array_max(F.transform("anchors", lambda a: a["n"])))).first()
    buckets = max(1, -(-(size[0] or 0) // BUCKET))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        texts = encoded(batch.column(1))
        keep = [i for i, t in enumerate(texts) if len(t) >= threshold]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(keep), pa.array([text_key(texts[i]) for i in keep], pa.binary()), pa.array([press.compress(texts[i]) for i in keep], pa.binary())], ["id", "key", "packed"]
        )

    packed = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text").mapInArrow(batches(pack), "id long, key binary, packed binary")
    found = save(hits.join(packed, ["id", "key"]).dropDuplicates(["id", "key"]).select("key", "packed", "anchors"), "suffix-texts")
    runs = merged(save(sort_groups(deal_contexts(found, buckets, group, threshold, gram), threshold, gram), "suffix-runs"), False)
    if (size[1] or 0) > group:
        runs = runs.unionByName(large_groups(found, group, threshold, gram))
    return runs.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("runs")), found.select("key", "packed")


def dedup(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    meta = save(scan_texts(docs), "suffix-meta")
    copies = meta.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("id"))
    copies = save(copies, "suffix-copies")
    runs, texts = repeated_runs(docs, meta, copies.select("key", "id"), threshold, gram, group)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        open_ = zstandard.ZstdDecompressor()
        removed, spans, digest = [], [], []
        for packed, listed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = open_.decompress(packed)
            cover = union([(r["start"], r["end"]) for r in listed])
            removed.append(sum(b - a for a, b in cover))
            spans.append(len(cover))
            digest.append(sha(cut_runs(text, cover)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["key", "removed", "spans", "cut_sha256"])

    single = copies.where("copies = 1").select("key")
    done = texts.join(single, "key", "left_semi").join(runs, "key").mapInArrow(batches(cut), "key binary, removed long, spans long, cut_sha256 string")
    facts = copies.where("copies > 1").select("key", F.lit(True).alias("copied"), F.lit(None).cast("long").alias("removed"), F.lit(None).cast("long").alias("spans"), F.lit(None).cast("string").alias("cut_sha256"))
    facts = facts.unionByName(done.withColumn("copied", F.lit(False)))
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= threshold)
    return spread_join(meta, facts, "key", frequent(copies, "key", "copies"), "left").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(sha(b""))).otherwise(F.coalesce("cut_sha256", "whole_sha256")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))
