"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct ``SHINGLE``-word shingles; equal sets form a
class, and classes are joined. Sizes fall into bands so narrow that similar sets lie
in the same or in neighbouring bands; a set takes part in the instance of its own
band and in the next one's. For an instance, similarity bounds the number k of
elements in which two sets differ. The hash domain is cut into first-level groups of
second-level partitions; as k differences cannot reach every group more than
``k2`` times, two similar sets agree on some subset of a group's partitions that
leaves out k2 of them. The hash of each such subset is a signature (``shape``: up to
``FEW`` differences the fewest signatures that hold ``COVER`` elements on average, or as
many elements as signatures not more than elements can; beyond, plain groups or groups
of three or five partitions, and a few groups more than needed). A subset without
elements is no signature. That loses nothing for a set with as many groups without such
subsets as similar sets need; other sets also take part in a further enumeration with
other hashes (two sets that agree on nothing but an empty subset both do), and in the
last of ``TURNS`` empty subsets count.

Signatures travel in binary rows, a few bytes each, and meet in buckets. A signature
that up to ``HOT`` sets share makes each two of them a candidate pair; one that more
share is hot and makes none. So a set makes at most (HOT - 1) / 2 pairs for each of its
signatures, whatever the input. A set with as many groups without empty subsets or hot
signatures as similar sets need has met every similar one all the same. The others go
on to another round among themselves, with other hashes and signatures of more elements:
there, what only common shingles had tied comes apart. After the last round (``ROUNDS``,
or when few are left or no fewer) hot signatures tie their sets into units; a pair
within one unit is left to the unit.

Pairs are filtered without loss by parity sketches (a set's sketch tells for each
cell of its hash domain whether it holds an odd number of elements: where two sketches
differ, so do the sets), and those left are verified on the sets themselves. Units are
verified by pairs of salted blocks of ``BLOCK`` sets in separate tasks, each pair once:
intersections are counted from an inverted list of the elements in up to ``RARE`` sets
and, for commoner elements, come from products of the incidence matrix. These tasks
report a spanning forest and link counts, never pairs. Label propagation over the
verified links gives the components.

Defined cases: null or word-less texts have an empty set (n_shingles 0), no link
and their own component; texts with fewer words are one shingle; equal sets are
linked; a component's id is its smallest doc_id (null only if all its ids are);
rows with one doc_id are separate members; very long texts are taken whole; extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walflow.llm.common import batches, encoded, forget, fresh, read, save, text_bytes, small_batches, trim
from walflow.llm.hashing import BYTE_BASE, LOWER, WORD_BASE, Rolling, mix, slices, words

SHINGLE, PERCENT = 4, 85
COVER, SELECTIVE, FEW, TURNS, HOT, RARE, BLOCK = 8, 5.5, 8, 4, 16, 32, 1000
#: Rounds at most (a signature's name has room for TURNS * ROUNDS <= 16), and the share of the sets of one that the next must fall below to be followed.
ROUNDS, FEWER = 4, 0.9
#: Signatures per chunk that is dealt out, signature bytes per bucket of the exchange and least number of buckets, classes per verifying task, elements and sets per product.
CHUNK, BUCKET_BYTES, BUCKETS, TASK_CLASSES, COLUMNS, ROWS = 1_000_000, 16_000_000, 64, 400, 2048, 128
#: Bytes of text hashed at once.
HASHED = 500_000
#: Bytes of a signature that travel; its bucket tells more of it, and what meets by chance is verified like the rest.
SENT = 4


class Bands:
    """The size bands for a similarity in percent, with each instance's greatest difference k."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent = percent
        tops, low = [], 1
        while low < most:
            tops.append(low * 100 // percent)
            low = tops[-1] + 1
        self.tops = np.array(tops)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.tops, size))

    def differ(self, band: int) -> int:
        return int(2 * self.tops[band] * (100 - self.percent) // (100 + self.percent))


def shingles(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [x for a, b in slices([len(t) for t in texts], HASHED) for x in hashed(texts[a:b], width)]


def hashed(texts: list[bytes], width: int) -> list[np.ndarray]:
    """`shingles` at once, with some 40 to 60 bytes for each byte of text."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    starts, ends = words(data)
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    rolling = Rolling(Rolling(data, BYTE_BASE).runs(starts, ends), WORD_BASE)
    every = rolling.every(width)
    border = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(border[:-1], border[1:]):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            out.append(rolling.runs(np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def unpacked(packed: list[bytes], width: int):
    """(a, b, sets of the texts from a to b) of compressed texts; of these, one slice is open at a time."""
    open_ = zstandard.ZstdDecompressor()
    for a, b in slices([zstandard.frame_content_size(p) for p in packed]):
        yield a, b, shingles([open_.decompress(p) for p in packed[a:b]], width)


def class_key(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(maxsize=None)
def shape(top: int, k: int, again: bool = False) -> tuple[int, int, int, int]:
    """(need, n1, n2, k2) for sets of up to `top` elements with k differences: the groups of which similar sets agree, but for k2 partitions, on one; groups, partitions of a group, and partitions left out. `again`: with more elements in a signature."""
    if k > FEW:
        k2 = (0 if top >= SELECTIVE * k else 1 if 2 * top / 3 >= COVER * k / 2 else 2) + 2 * again
        k2 = min(k2, 3)
        need = k // (k2 + 1) + 1
        return need, need + max(1, need // 20), 2 * k2 + 1, k2
    best, wish = None, COVER * (1 + again)
    for k2 in range(k + 1):
        n1 = k // (k2 + 1) + 1
        for n2 in range(k2 + 1, k2 + 13 if k2 else 2):
            count, cover = n1 * math.comb(n2, k2), top * (n2 - k2) / (n1 * n2)
            if count <= max(top, k + 1) * (1 + again):
                rank = (cover >= wish, -count if cover >= wish else cover)
                best = max(best or (rank, n1, n2, k2), (rank, n1, n2, k2))
    return best[1], *best[1:]


@functools.lru_cache(maxsize=None)
def subsets(n2: int, k2: int) -> np.ndarray:
    """Column by column, the partitions that a subset keeps."""
    return np.array([[i not in c for c in itertools.combinations(range(n2), k2)] for i in range(n2)], dtype=np.int64)


def spread(flat: np.ndarray, sizes: np.ndarray, groups: tuple[int, int, int, int], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets one after the other: sum of hashes and number of elements of each subset, a row per set, and each set's number of groups without empty subsets."""
    _, n1, n2, k2 = groups
    kept, n = subsets(n2, k2), len(sizes)
    at = mix(flat ^ np.uint64(seed * 0x9E3779B1)) if seed else flat
    cell = np.repeat(np.arange(n) * (n1 * n2), sizes) + ((at >> np.uint64(20)) % np.uint64(n1 * n2)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    sums, counts = np.zeros(n * n1 * n2, np.uint64), np.zeros(n * n1 * n2, np.int64)
    sums[cell[first]] = np.add.reduceat(mix(flat)[order], first)
    counts[cell[first]] = np.diff(np.append(first, len(cell)))
    sums, counts = sums.reshape(-1, n2) @ kept.astype(np.uint64), counts.reshape(-1, n2) @ kept
    return sums.reshape(n, -1), counts.reshape(n, -1), (counts > 0).all(axis=1).reshape(n, n1).sum(axis=1)


def signatures(sets: list[np.ndarray], bands: Bands, round_: int = 0, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, signature) of sets of hashes in round `round_`; the lowest bit is the instance's.

    hot: how many signatures of each set were hot in the round before, in even and in odd instances; who has met every similar set there stays out.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    band = np.searchsorted(bands.tops, sizes)
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for instance in np.unique(np.concatenate([band, band + 1])):
        k = bands.differ(instance)
        who = np.flatnonzero(((band == instance) | (band == instance - 1)) & (sizes > 0))
        if not k or not len(who):
            continue  # without differences only equal sets, which are one class
        top = int(bands.tops[instance])
        if hot is not None:
            who = who[hot[who, instance & 1] > 0]
            if not len(who):
                continue
            before = shape(top, k, round_ > 1)
            whole = spread(np.concatenate([sets[i] for i in who]), sizes[who], before, (round_ - 1) * TURNS)[2]
            who = who[whole - hot[who, instance & 1] < before[0]]
            if not len(who):
                continue
        groups = shape(top, k, round_ > 0)
        need = groups[0]
        for turn in range(round_ * TURNS, (round_ + 1) * TURNS):
            sums, counts, whole = spread(np.concatenate([sets[i] for i in who]), sizes[who], groups, turn)
            name = np.arange(sums.shape[1], dtype=np.uint64) + (np.uint64(instance) << np.uint64(44)) + (np.uint64(turn) << np.uint64(40))
            value = mix(mix(sums) ^ mix(name)) & ~np.uint64(1) | np.uint64(instance & 1)
            full = counts > 0
            whole = whole >= need
            if turn == (round_ + 1) * TURNS - 1:
                full[~whole] = True
            row, column = np.nonzero(full)
            owners.append(who[row])
            found.append(value[row, column])
            who = who[~whole]
            if not len(who):
                break
    return np.concatenate(owners), np.concatenate(found)


def sketch(members: np.ndarray) -> bytes:
    """One bit for each of a power of two of cells, at least two an element: whether it holds an odd number of elements."""
    cells = max(64, 1 << (2 * len(members) - 1).bit_length())
    at = mix(members ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(cells - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches (one a row, in words of 64 cells) brought to fewer cells."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def sketch_gaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many cells the sketches of each pair differ, at the smaller one's number of cells."""
    out = np.zeros(len(left), dtype=np.int64)
    x, y = np.array([len(b) // 8 for b in left]), np.array([len(b) // 8 for b in right])
    for w, v in {*zip(x.tolist(), y.tolist())}:
        at = np.flatnonzero((x == w) & (y == v))
        for part in np.array_split(at, 1 + len(at) * max(w, v) // 1_000_000):
            a, b = (np.frombuffer(b"".join([side[i] for i in part]), "<u8").reshape(len(part), -1) for side in (left, right))
            out[part] = np.bitwise_count(folded(a, min(w, v)) ^ folded(b, min(w, v))).sum(axis=1, dtype=np.int64)
    return out


def rate(bands: Bands) -> float:
    """Signature bytes per byte of text, roughly: those of a set of 300, at six bytes a shingle."""
    band = bands.of(300)
    _, n1, n2, k2 = shape(int(bands.tops[band]), bands.differ(band))
    return 2 * n1 * math.comb(n2, k2) * (SENT + 1) / (6 * 300)


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex reachable from each of n vertices over edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of edges (a, b): the least vertex reachable; label propagation with pointer jumping."""
    both = save(edges.where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a", "b").distinct(), "join-edges")
    labels = save(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "join-labels")
    while True:
        now = labels.select("v", "label")
        near = both.join(now.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = now.join(near, "v", "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = now.select(F.col("v").alias("label"), F.col("label").alias("further"))
        following = save(step.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "join-labels")
        moved = following.where("label <> old").limit(1).count()
        forget(labels)
        labels = following
        if not moved:
            forget(both)
            return labels.select("v", "label")


def scan_sets(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """doc_id, key (of the text), cls, n_shingles, band and sketch of every row; cls, band and sketch are null for an empty set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = encoded(batch.column(1))
        sets = [s for a, b in slices([len(t) for t in texts]) for s in shingles(texts[a:b], width)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands.of(len(s)) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
            ],
            ["doc_id", "key", "cls", "n_shingles", "band", "sketch"],
        )

    return docs.mapInArrow(batches(run), "doc_id long, key binary, cls long, n_shingles long, band long, sketch binary")


def pack_signatures(keys: np.ndarray, owner: np.ndarray, sigs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, blob) of the signatures of a chunk of classes; only buckets with any."""
    bucket = ((sigs >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((owner, bucket))
    bucket = bucket[order]
    cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    low = np.ascontiguousarray(sigs.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :SENT]
    blobs = []
    for a, b in zip(cut[:-1], cut[1:]):
        used, counts = np.unique(owner[order[a:b]], return_counts=True)
        blobs.append(len(used).to_bytes(8, "little") + keys[used].astype("<i8").tobytes() + counts.astype("<i4").tobytes() + low[order[a:b]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def meetings(blobs: list[bytes | memoryview], hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a < b) of one bucket, and (class, least class of its hot unit here, its hot signatures in even and in odd instances)."""
    named, times, sigs = [], [], []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        named.append(np.frombuffer(blob, "<i8", n, 8))
        times.append(np.frombuffer(blob, "<i4", n, 8 + 8 * n))
        sigs.append(np.frombuffer(blob, f"<u{SENT}", -1, 8 + 12 * n))
    ends = np.cumsum([len(x) for x in sigs])
    sigs = np.concatenate(sigs)
    order = np.argsort(sigs)
    sigs = sigs[order]
    twin = np.zeros(len(sigs) + 1, dtype=bool)
    twin[1:-1] = sigs[1:] == sigs[:-1]
    twin = twin[1:] | twin[:-1]  # what nothing else shares goes at once
    sigs, order = sigs[twin].astype(np.uint64), order[twin]
    # A name for each signature only now, by places: most are gone.
    who = np.searchsorted(np.cumsum(np.concatenate(times)), order, side="right").astype(np.int32)
    names, who = np.unique(np.concatenate(named)[who], return_inverse=True)
    sender = np.searchsorted(ends, order, side="right").astype(np.int32)
    del order, twin
    total = max(1, len(names))
    every, of = sigs, who
    once = np.lexsort((who, sigs))  # several chunks may send one class
    sigs, who = sigs[once], who[once]
    new = np.ones(len(sigs), dtype=bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (who[1:] != who[:-1])
    sigs, who = sigs[new], who[new]
    first = np.flatnonzero(np.diff(sigs, prepend=~sigs[:1]))
    size = np.diff(np.append(first, len(sigs)))
    pairs = [np.zeros(0, np.int64)]
    held = 0
    for g in range(2, hot + 1):
        at = first[size == g]
        for i, j in itertools.combinations(range(g), 2) if len(at) else ():
            pairs.append(who[at + i] * total + who[at + j])
            held += len(at)
            if held > 4_000_000:
                pairs = [np.unique(np.concatenate(pairs))]
                held = 0
    pairs = np.unique(np.concatenate(pairs))
    large = np.repeat(size > hot, size)
    root = np.repeat(who[first] if len(first) else who, size)
    label = local_components(who[large], root[large], total) if large.any() else np.arange(total)
    members = np.unique(who[large])
    a, b = pairs // total, pairs % total
    # What one chunk sent counts, were its bytes equal or not: a count too low would lose links.
    warm = np.flatnonzero(np.isin(every, sigs[large]))
    sent, times = np.unique((of[warm] * 2 + (every[warm] & np.uint64(1)).astype(np.int64)) * len(blobs) + sender[warm], return_counts=True)
    counts = np.zeros(2 * total, dtype=np.int64)
    np.maximum.at(counts, sent // len(blobs), times)
    return names[a], names[b], names[members], names[label[members]], counts.reshape(-1, 2)[members]


def candidates(rows: DataFrame, bands: Bands, width: int, buckets: int, hot: int = HOT, round_: int = 0) -> DataFrame:
    """(bucket, a, b, even, odd): candidate pairs of classes (bucket null) and (class, root) of what hot signatures tie in a bucket, with their numbers.

    rows: (text) in the first round, then (cls, packed, even, odd)."""

    def first(batch: pa.RecordBatch, seen: set[int]):
        texts = encoded(batch.column(0))
        for a, b in slices([len(t) for t in texts]):
            new = {}
            for s in shingles(list(dict.fromkeys(texts[a:b])), width):
                if len(s) and (k := class_key(s)) not in seen:
                    new.setdefault(k, s)
            yield [*new], [*new.values()], None

    def later(batch: pa.RecordBatch, seen: set[int]):
        keys, counts = batch.column(0).to_pylist(), np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)], axis=1)
        for a, b, sets in unpacked(batch.column(1).to_pylist(), width):
            yield keys[a:b], sets, counts[a:b]

    def deal(it):
        seen: set[int] = set()
        keys: list[int] = []
        owners, sigs = [], []
        held = 0

        def out():
            return pack_signatures(np.array(keys, dtype=np.int64), np.concatenate(owners), np.concatenate(sigs), buckets)

        for batch in it:
            for new, sets, counts in (later if round_ else first)(batch, seen):
                if new:
                    owner, found = signatures(sets, bands, round_, counts)
                    owners.append(owner + len(keys))
                    sigs.append(found)
                    held += len(found)
                    seen.update(new)
                    keys += new
                if held > CHUNK:
                    yield out()
                    seen.clear()
                    keys, owners, sigs, held = [], [], [], 0
        if held:
            yield out()
        trim()

    def meet(table: pa.Table) -> pa.Table:
        a, b, member, root, counts = meetings([memoryview(x.as_buffer()) for x in table.column("blob")], hot)
        trim()
        bucket = pa.array([None] * len(a) + [table.column("bucket")[0].as_py()] * len(member), pa.int64())
        even, odd = (np.concatenate([np.zeros(len(a), np.int64), counts[:, c]]) for c in (0, 1))
        return pa.table({"bucket": bucket, "a": np.concatenate([a, member]), "b": np.concatenate([b, root]), "even": even, "odd": odd})

    dealt = rows.mapInArrow(deal, "bucket long, blob binary")
    return save(dealt.groupBy("bucket").applyInArrow(meet, "bucket long, a long, b long, even long, odd long").distinct(), "join-met")


def hot_classes(met: DataFrame) -> DataFrame:
    """(cls, even, odd): the classes with hot signatures, and how many they have in even and in odd instances."""
    return save(met.where("bucket is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("even").alias("even"), F.sum("odd").alias("odd")), "join-hot")


def hot_units(met: DataFrame) -> DataFrame:
    """(v, label): the classes that hot signatures tie, and their unit."""
    # A class has a root in each bucket: the roots are tied to the least of them, not the class to all.
    roots = met.where("bucket is not null").withColumn("least", F.min("b").over(Window.partitionBy("a")))
    return components(roots.select("a", F.col("least").alias("b")).unionByName(roots.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))))


def apart(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not within one unit."""
    pairs = pairs.join(units.select(F.col("v").alias("a"), F.col("label").alias("unit_a")), "a", "left")
    return pairs.join(units.select(F.col("v").alias("b"), F.col("label").alias("unit_b")), "b", "left").where("unit_a is null or unit_b is null or unit_a <> unit_b").select("a", "b")


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow similarity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 4))
        near = sketch_gaps(batch.column(3).to_pylist(), batch.column(5).to_pylist()) * (100 + percent) <= (100 - percent) * (x + y)
        return pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], ["a", "b"])

    side = lambda c: classes.select(F.col("cls").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    fits = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
    return save(rows.select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(batches(run), "a long, b long"), "join-near")


def linked(pairs: DataFrame, packed: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) that are similar, by the sets themselves."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        open_ = zstandard.ZstdDecompressor()
        b = batch.column(1).to_pylist()
        keep = []
        order = sorted(range(len(b)), key=b.__getitem__)
        last, right = None, None
        for i in order:
            if b[i] != last:
                last, right = b[i], shingles([open_.decompress(batch.column(3)[i].as_py())], width)[0]
            left = shingles([open_.decompress(batch.column(2)[i].as_py())], width)[0]
            n = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * n >= percent * (len(left) + len(right) - n):
                keep.append(i)
        return pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]], ["a", "b"])

    side = lambda c: packed.select(F.col("cls").alias(c), F.col("packed").alias(f"packed_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "packed_a", "packed_b")
    return save(rows.mapInArrow(batches(run), "a long, b long"), "join-pairs")


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of similar sets: i < j within `left`, or i in `left` and j in `right`."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    times = np.bincount(column)
    total, n = len(sets), len(left)
    # Of two blocks only what lies between them is counted; within one, what is on or below the diagonal is not looked at.
    from_ = n if right is not None else 0
    wide = total - from_
    common = np.zeros(n * wide, dtype=np.int32)
    # Elements in few sets: count their pairs of owners. Elements in many: multiply.
    first = np.cumsum(times) - times
    codes, held = [], 0
    for f in range(2, RARE + 1):
        at = first[times == f]
        for i, j in itertools.combinations(range(f), 2) if len(at) else ():
            x, y = owner[at + i], owner[at + j]
            if right is not None:
                across = (x < n) & (y >= n)
                x, y = x[across], y[across]
            codes.append(x * wide + y - from_)
            held += len(x)
            if held > 500_000:
                common += np.bincount(np.concatenate(codes), minlength=n * wide).astype(np.int32)
                codes, held = [], 0
    if codes:
        common += np.bincount(np.concatenate(codes), minlength=n * wide).astype(np.int32)
    del codes
    common = common.reshape(n, wide)
    often = times > RARE
    keep = often[column]
    column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
    for a in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        x = np.zeros((total, min(COLUMNS, int(often.sum()) - a)), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        for r in range(0, n, ROWS):
            common[r : r + ROWS] += (x[r : min(r + ROWS, n)] @ x[from_:].T).astype(np.int32)
    sizes = np.array([len(s) for s in sets])
    out_x, out_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in range(0, n, ROWS):
        some = common[r : r + ROWS].astype(np.int64)
        close = 100 * some >= percent * (sizes[r : min(r + ROWS, n), None] + sizes[None, from_:] - some)
        x, y = np.nonzero(close if right is not None else np.triu(close, r + 1))
        out_x.append(x + r)
        out_y.append(y)
    return np.concatenate(out_x), np.concatenate(out_y)


LINKS = "a long, b long, links long"


def verify(found: DataFrame, percent: int, width: int) -> DataFrame:
    """found: (t, i, j, comp, cls, copies, block, packed) -> (a, b, links): each class, its root in the task, its links there."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        comp, cls, copies, block = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("comp", "cls", "copies", "block"))
        sets = [s for _, _, some in unpacked(table.column("packed").to_pylist(), width) for s in some]
        order = np.lexsort((cls, comp))
        trim()
        out_a, out_b, out_n = [], [], []
        for part in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            if i != j:
                left, right = part[block[part] == i], part[block[part] == j]
                x, y = linked_pairs([sets[k] for k in left], [sets[k] for k in right], percent) if len(left) and len(right) else ((), ())
                x, y = left[np.asarray(x, dtype=np.int64)], right[np.asarray(y, dtype=np.int64)]
            else:
                x, y = linked_pairs([sets[k] for k in part], None, percent)
                x, y = part[x], part[y]
            if len(x):
                used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                root = local_components(place[: len(x)], place[len(x) :], len(used))
                links = np.bincount(place, np.concatenate([copies[y], copies[x]]), len(used))
                out_a.append(cls[used])
                out_b.append(cls[used[root]])
                out_n.append(links.astype(np.int64))
        a, b, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b, out_n))
        return pa.table({"a": a, "b": b, "links": n})

    return found.groupBy("t", "i", "j").applyInArrow(run, LINKS)


def join(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, key (MD5 of the text) and component for every row of docs (doc_id, text).

    n_links counts the other rows whose set is similar to the row's own; component names
    the row's group even where several groups have one smallest doc_id (null: empty set).
    """
    docs = small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text")
    bands = Bands(percent)
    meta = save(scan_sets(docs, width, bands), "join-sets")
    ident = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), "key")
    classes = meta.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min(ident).alias("first"), *(F.any_value(c).alias(c) for c in ("n_shingles", "sketch")))
    classes = save(classes.select("cls", "copies", "first.unnamed", "first.id", "first.key", F.col("n_shingles").alias("size"), "sketch"), "join-classes")
    meta = meta.drop("sketch")
    buckets = max(BUCKETS, math.ceil(text_bytes(docs) * rate(bands) / BUCKET_BYTES))
    met = candidates(docs.select("text"), bands, width, buckets, hot)
    pairs = met.where("bucket is null").select("a", "b")
    units = hot_units(met) if rounds == 1 else None  # without another round these are the units: leave their pairs to them
    near = near_pairs(pairs if units is None else apart(pairs, units), classes, percent)
    tied = hot_classes(met)

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        texts = encoded(batch.column(1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array([press.compress(t) for t in texts], pa.binary())], ["doc_id", "text_key", "packed"]
        )

    wanted = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).unionByName(tied.select("cls")).distinct()
    packed = docs.mapInArrow(batches(pack), "doc_id long, text_key binary, packed binary")
    packed = wanted.join(classes.select("cls", "id", "key"), "cls").join(packed, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).select("cls", "packed")
    packed = save(packed.dropDuplicates(["cls"]), "join-texts")
    left, round_ = tied.count(), 0
    while left > block and round_ + 1 < rounds:
        round_ += 1
        rows = packed.join(tied, "cls").select("cls", "packed", "even", "odd")
        forget(met)
        met = candidates(rows, bands, width, buckets, hot, round_)
        near = near.unionByName(near_pairs(met.where("bucket is null").select("a", "b"), classes, percent))
        tied, last = hot_classes(met), tied
        forget(last)
        before, left = left, tied.count()
        if left > FEWER * before:
            break
    classes = classes.drop("size", "sketch")
    if units is None:
        units = hot_units(met)
        near = apart(near.distinct(), units)
    links = linked(near, packed, percent, width)
    # The hot units: blocks of one unit meet two by two, small units share a task.
    counts = units.groupBy("label").agg(F.count("*").alias("n"))
    tasks = max(1, -(-units.count() // TASK_CLASSES))
    placed = units.join(counts, "label").select(F.col("v").alias("cls"), F.col("label").alias("comp"), F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))).join(classes.select("cls", "copies"), "cls").join(packed, "cls")
    single = F.col("blocks") == 1
    others = F.explode(F.when(single, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    found = placed.withColumn("other", others).select(
        F.when(single, F.pmod(F.xxhash64("comp"), F.lit(tasks))).otherwise(F.col("comp")).alias("t"),
        F.when(single, F.lit(-1)).otherwise(F.least("block", "other")).alias("i"), F.when(single, F.lit(-1)).otherwise(F.greatest("block", "other")).alias("j"),
        "comp", "cls", "copies", "block", "packed",
    )
    within = save(verify(found, percent, width), "join-links")
    labels = components(within.select("a", "b").unionByName(links))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(classes.select(F.col("cls").alias("b"), "copies"), "b")
    totals = within.select("a", "links").unionByName(both.select("a", F.col("copies").alias("links"))).groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    of_class = classes.join(labels.select(F.col("v").alias("cls"), "label"), "cls", "left").join(totals, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = of_class.groupBy("label").agg(F.min(F.struct("unnamed", "id")).alias("least"))
    of_class = of_class.join(least, "label").select("cls", "label", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("least.id").alias("component_id"))
    empty = F.col("cls").isNull()
    return meta.join(of_class, "cls", "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "key", F.col("label").alias("component"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents")).drop("key", "component")


def keep_one(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of `docs` less all but one of each group: its first row by doc_id (null last), then text digest. Empty sets stay.

    Of rows with one doc_id and text, one stays if it is its group's first. Columns may have any names.
    """
    joined = join(docs, width, percent, rounds=1)  # more rounds fail the pipeline's check by their pairs
    own_id, own_key, first_id, first_key = fresh(docs.columns, "id", "key", "first_id", "first_key")
    ident = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    first = joined.where("component is not null").groupBy("component").agg(F.min(ident).alias("first")).select(F.col("first.id").alias(first_id), F.col("first.key").alias(first_key))
    rows = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_key, F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = rows.where(~wordless).join(first, F.col(own_id).eqNullSafe(F.col(first_id)) & (F.col(own_key) == F.col(first_key)), "left_semi").dropDuplicates([own_id, own_key])
    return kept.select(docs.columns).unionByName(rows.where(wordless).select(docs.columns))
