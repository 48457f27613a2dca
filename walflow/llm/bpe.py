"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols form a linked list; the leaves of a segment tree hold the merge
rank of each adjacent pair (none: infinity) joined with its position, so the
root is the leftmost pair of lowest rank. A merge rewrites three leaves at a
cost of log(n) each, until the root says that nothing can merge.

The pipeline around it is that of the tokenizer file: special tokens are cut out
of the raw text, the rest is normalised (NFC, white space to blanks, lower case
by character), split by the file's pattern, mapped to byte symbols, and the last
symbol carries the word end. Every step is local to a stretch between white
space, so a slice of texts is encoded by its distinct stretches and put together by
Arrow; encodings of pieces are kept in a bounded table per worker.

Defined cases: null text counts as empty and gives no tokens; very long texts
are taken whole; extra columns are ignored; repeated rows are kept.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from walflow.llm.common import batches, encoded, read, sha, small_batches
from walflow.llm.hashing import slices

#: Pieces kept per worker process and generation: a full table becomes the old one, and what is found there is kept on.
CACHE_ENTRIES = 220_000
#: Bytes of text whose distinct stretches are encoded at once.
TEXT_BYTES = 4_000_000
#: Pieces up to this many symbols are merged many at a time, one tree per row of an array.
WIDE = 64
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_GAPS = regex.compile(r"\p{White_Space}+")
NONE = 1 << 62


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character of each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class SegmentTree:
    """Minimum over leaves, with point updates."""

    def __init__(self, leaves: list[int]):
        self.size = size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.nodes = nodes = [NONE] * size + leaves + [NONE] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b

    def root(self) -> int:
        return self.nodes[1]

    def put(self, at: int, value: int) -> None:
        nodes = self.nodes
        i = at + self.size
        nodes[i] = value
        i >>= 1
        while i:
            a, b = nodes[2 * i], nodes[2 * i + 1]
            low = a if a < b else b
            if nodes[i] == low:
                break
            nodes[i] = low
            i >>= 1


def strung(values: pa.Array, code: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The values at `code` one after the other, and where each begins and the last ends."""
    if not len(code):
        return pa.py_buffer(b""), np.zeros(1, dtype=np.int64)
    taken = values.take(pa.array(code))
    return taken.buffers()[2] or pa.py_buffer(b""), np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.names = {i: t for t, i in (self.vocab | self.specials).items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
        self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s, -1) for s in symbols]
        self.final = [self.vocab.get(s + self.suffix, -1) for s in symbols]
        if self.piece.search("\n"):
            raise ValueError("the file's pattern must not match white space")
        self.lines = regex.compile("\n|" + self.piece.pattern)
        self.symbols = np.array([self.inner, self.final], dtype=np.int64)
        self.spaced = pa.array([(self.names[i] + " ").encode() if i in self.names else b"" for i in range(max(self.names) + 1)], pa.large_binary())
        # Ids as little-endian uint32 and tokens, each with a blank behind it, of pieces.
        fixed = {t: (np.array([i], dtype="<u4").tobytes(), (t + " ").encode()) for t, i in self.specials.items()}
        self.fixed: dict[str, tuple[bytes, bytes]] = fixed | {"\n": (b"", b"")}
        self.young: dict[str, tuple[bytes, bytes]] = dict(self.fixed)
        self.old: dict[str, tuple[bytes, bytes]] = {}
        keys = np.array([a << 20 | b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order]
        self.merged = np.zeros(len(keys), dtype=np.int64)
        for rank, new in self.merges.values():
            self.merged[rank] = new

    def merge(self, symbols: list[int]) -> list[int]:
        """Merges leftmost lowest-rank pairs until none is left."""
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        symbols = list(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def leaf(i: int) -> int:
            j = after[i]
            found = merges.get((symbols[i], symbols[j])) if j < n else None
            return found[0] * n + i if found else NONE

        tree = SegmentTree([leaf(i) for i in range(n - 1)])
        while (low := tree.root()) < NONE:
            i = low % n
            j = after[i]
            symbols[i] = merges[symbols[i], symbols[j]][1]
            symbols[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if j < n - 1:
                tree.put(j, NONE)
            tree.put(i, leaf(i))
            if before[i] >= 0:
                tree.put(before[i], leaf(before[i]))
        return [s for s in symbols if s >= 0]

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank * WIDE + position of each pair, NONE where the pair has no merge."""
        keys = left << 20 | right
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[found] == keys, self.ranks[found] * WIDE + at, NONE)

    def merge_many(self, words: list[list[int]]) -> list[list[int]]:
        """`merge` of words of 2 to WIDE symbols."""
        flat, counts = self.merge_flat(np.concatenate([np.array(w, dtype=np.int64) for w in words]), np.array([len(w) for w in words]))
        return [part.tolist() for part in np.split(flat, np.cumsum(counts)[:-1])]

    def merge_flat(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`merge` of words of 2 to WIDE symbols, one after the other: the same trees, a step of all words at once. Symbols and their number in each word."""
        n = len(lens)
        width = int(lens.max())
        size = 1 << (width - 2).bit_length() if width > 2 else 1
        inside = np.arange(width) < lens[:, None]
        symbols = np.full((n, width), -1, dtype=np.int64)
        symbols[inside] = flat
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        pairs = inside[:, 1:]
        row, at = np.nonzero(pairs)
        tree[row, size + at] = self.leaves(symbols[row, at], symbols[row, at + 1], at)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            low = tree[live, 1]
            i = low % WIDE
            j = after[live, i]
            k = after[live, j]
            symbols[live, i] = self.merged[low // WIDE]
            symbols[live, j] = -1
            after[live, i] = k
            more = k < lens[live]
            before[live[more], k[more]] = i[more]
            here = np.full(len(live), NONE)
            here[more] = self.leaves(symbols[live[more], i[more]], symbols[live[more], k[more]], i[more])
            prior = before[live, i]
            has = prior >= 0
            rows = np.concatenate([live, live, live[has]])
            spots = np.concatenate([np.minimum(j, size - 1), i, prior[has]]) + size
            tree[live, spots[: len(live)]] = NONE  # j's pair is gone; a last symbol has no pair of its own
            tree[live[i < size], size + i[i < size]] = here[i < size]
            tree[live[has], size + prior[has]] = self.leaves(symbols[live[has], prior[has]], symbols[live[has], i[has]], prior[has])
            level = size
            while level > 1:
                level //= 2
                spots = spots >> 1
                tree[rows, spots] = np.minimum(tree[rows, 2 * spots], tree[rows, 2 * spots + 1])
            live = live[tree[live, 1] < NONE]
        keep = symbols >= 0
        return symbols[keep], keep.sum(axis=1)

    def symbols_of(self, piece: str) -> list[int]:
        data = piece.encode()
        symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        return [s for s in symbols if s >= 0]

    def keep(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        ends = np.cumsum(counts)
        tokens, at = strung(self.spaced, ids)
        ids, tokens, cuts, at = ids.astype("<u4").tobytes(), tokens.to_pybytes(), (4 * ends).tolist(), at[ends].tolist()
        self.young.update(zip(pieces, [(ids[a:b], tokens[c:d]) for a, b, c, d in zip([0, *cuts], cuts, [0, *at], at)]))

    def learn_pieces(self, pieces: list[str]) -> None:
        """Encodes the pieces not yet known."""
        new = []
        for p in set(pieces).difference(self.young):
            if found := self.old.get(p):
                self.young[p] = found
            else:
                new.append(p)
        if not new:
            return
        data = [p.encode() for p in new]
        lens = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        final = np.zeros(len(flat), dtype=np.int64)
        final[np.cumsum(lens) - 1] = 1
        symbols = self.symbols[final, flat]
        if (symbols < 0).any():  # bytes that the vocabulary lacks are left out
            lens = np.add.reduceat((symbols >= 0).astype(np.int64), np.cumsum(lens) - lens)
            symbols = symbols[symbols >= 0]
        starts = np.cumsum(lens) - lens
        few = np.flatnonzero(lens < 2)
        self.keep([new[i] for i in few], symbols[starts[few][lens[few] > 0]], lens[few])
        for i in np.flatnonzero(lens > WIDE).tolist():
            ids = np.array(self.merge(symbols[starts[i] : starts[i] + lens[i]].tolist()), dtype=np.int64)
            self.keep([new[i]], ids, np.array([len(ids)]))
        low = 2
        while low <= WIDE:
            high = max(low, 2 * low - 3)  # trees of one height
            group = np.flatnonzero((lens >= low) & (lens <= min(high, WIDE)))
            for part in np.split(group, range(20_000, len(group), 20_000)):
                if len(part):
                    n = lens[part]
                    at = np.arange(int(n.sum())) + np.repeat(starts[part] - (np.cumsum(n) - n), n)
                    self.keep([new[i] for i in part], *self.merge_flat(symbols[at], n))
            low = high + 1

    def split(self, stretch: str) -> list[str]:
        """The pieces and special tokens of text without white space."""
        out: list[str] = []
        at = 0
        for m in [*self.special.finditer(stretch), None]:
            out += self.piece.findall(self.plain(stretch[at : m.start() if m else len(stretch)]))
            if m:
                out.append(m.group())
                at = m.end()
        return out

    @staticmethod
    def plain(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # lower() of a whole word knows a final sigma; by character there is none.
        return text.lower() if "\u03a3" not in text else "".join([c.lower() for c in text])

    def encode_texts(self, texts: list[str]) -> list[tuple[int, memoryview, memoryview]]:
        """(number of tokens, ids as little-endian uint32, decoded text in UTF-8) of each text."""
        if len(self.young) > CACHE_ENTRIES:
            self.old, self.young = self.young, dict(self.fixed)
        cut = [_GAPS.split(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        every = list(itertools.chain.from_iterable(cut))
        stretches = list(dict.fromkeys(every))
        special = [w for w in stretches if "<|" in w]
        if special:
            stretches = [w for w in stretches if "<|" not in w] + special
        # Pieces of the distinct stretches, a line end behind each stretch.
        pieces = self.lines.findall(self.plain("".join([w + "\n" for w in stretches[: len(stretches) - len(special)]])))
        for w in special:
            pieces += [*self.split(w), "\n"]
        distinct = list(dict.fromkeys(pieces))
        self.learn_pieces(distinct)
        known = list(map(self.young.__getitem__, distinct))
        place = dict(zip(distinct, range(len(distinct))))
        code = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        ends = np.append(0, np.flatnonzero(code == place.get("\n", -1)) + 1)
        place = dict(zip(stretches, range(len(stretches))))
        rows = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
        borders = np.append(0, np.cumsum([len(c) for c in cut], dtype=np.int64))
        parts = []
        for side in (0, 1):
            data, at = strung(pa.array([k[side] for k in known], pa.large_binary()), code)
            by_stretch = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stretches), [None, pa.py_buffer(at[ends]), data])
            data, at = strung(by_stretch, rows)
            parts.append((memoryview(data), at[borders].tolist()))
        (ids, a), (text, b) = parts
        return [((a[i + 1] - a[i]) // 4, ids[a[i] : a[i + 1]], text[b[i] : max(b[i], b[i + 1] - 1)]) for i in range(len(texts))]

    def decode(self, ids) -> str:
        """The tokens of `ids` joined by blanks, as a tokenizer without a decoder does; unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])


@functools.cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) of every row."""
    where = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(where)
        texts = [t.decode("utf-8", "replace") for t in encoded(batch.column(1))]
        rows = [r for a, b in slices([len(t) for t in texts], TEXT_BYTES) for r in bpe.encode_texts(texts[a:b])]
        columns = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([sha(r[1]) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            flat = np.frombuffer(b"".join([r[1] for r in rows]), dtype="<u4").astype(np.int32)
            ends = np.cumsum([0] + [r[0] for r in rows]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    rows = small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(batches(run), schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of rows (doc_id, ids)."""
    where = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(where)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(batches(run), "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
