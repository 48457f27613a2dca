"""Media columns: interleaved document sequences whose media payloads are resolved by digest.

``sequences`` parses HTML into an ordered array of items: text blocks and media
references (digest, caption) with their positions. ``store`` writes payloads, each
as a lossless 8-bit grey image file, into a content-addressed table in the shared
folder; tasks drop the copies they see, so a hot payload is stored a few times at
most. ``read_back`` decodes the stored files, checks them and computes features,
one row per digest. ``resolve`` joins the references of the sequences with that
table by digest and restores positions and captions. Sources of the form `sha256:` name a
payload, others the digest of their own text. No payload is ever shuffled: the digest join carries features only, and repeated digests are aggregated first.

Defined cases: null text is an empty payload (64 zero bytes); null html an empty
sequence; unknown digests give null media columns; repeated rows are kept; very
long texts are one payload; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walflow.llm.common import batches, encoded, read, save, sha

WIDTH = 64
SCHEME = "sha256:"
ITEMS = "array<struct<position int, kind string, text string, digest string, caption string>>"
_SILENT = {"script", "style", "title", "template", "noscript"}
_BLOCK = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "table", "tr", "td", "th", "br", "hr", "figure", "blockquote", "pre", "header", "footer", "body", "main", "aside"}


class _Sequence(HTMLParser):
    """Collects text blocks and media references in document order; a figure's caption goes to its media."""

    def __init__(self, shut: set[str]):
        super().__init__(convert_charrefs=True)
        self.shut = shut  # elements whose text is not shown
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent: list[str] = []
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.shut:
            self.silent.append(tag)
            return
        if self.silent:
            return
        if tag in _BLOCK:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            self.flush()
            found = dict(attrs)
            source = found.get("src") or ""
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append({"position": len(self.items), "kind": "media", "text": source, "digest": source.removeprefix(SCHEME) if source.startswith(SCHEME) else sha(source.encode()), "caption": found.get("alt")})

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                del self.silent[self.silent.index(tag) :]
            return
        if tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            for i in self.figure or []:
                self.items[i]["caption"] = caption or self.items[i]["caption"]
            self.caption = None
        elif tag == "figure":
            self.figure = None
        if tag in _BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """The items of a page in order. The text of a title, template or noscript that is never closed counts as shown."""
    shut = set(_SILENT)
    while True:
        parser = _Sequence(shut)
        parser.feed(html or "")
        parser.close()
        unclosed = {*parser.silent} - {"script", "style"}
        if not unclosed:
            parser.flush()
            return parser.items
        shut -= unclosed


def sequences(pages: DataFrame, key: str) -> DataFrame:
    """(key, items) of rows (key, html)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_sequence(h) for h in batch.column(1).to_pylist()], kind)], [key, "items"])

    return pages.select(key, "html").mapInArrow(batches(run), f"{key} long, items {ITEMS}")


def payload(data: bytes) -> bytes:
    """`data` filled with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_media(data: bytes) -> bytes:
    """A binary grey image, 64 samples wide, holding `data` (a multiple of 64 bytes) as its samples."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def from_media(stored: bytes) -> bytes:
    magic, size, most, data = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(data) != width * height:
        raise ValueError("not an 8-bit grey image of the stated size")
    return data


def feature(data: bytes) -> str:
    """Mean brightness and a 64-bit average hash of the image's 64 column means."""
    samples = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    columns = samples.sum(axis=0, dtype=np.int64)
    bits = columns * WIDTH > columns.sum()
    return f"mean={int(columns.sum()) // samples.size};ahash={np.packbits(bits).tobytes().hex()}"


def store(payloads: DataFrame) -> DataFrame:
    """Writes rows (text) as media files: (digest, n_bytes, media). The digest is that of the unpadded bytes."""

    def run(it):
        for batch in it:
            rows: dict[str, tuple[int, bytes]] = {}
            for data in encoded(batch.column(0)):
                rows.setdefault(sha(data), (len(data), data))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.string()), pa.array([n for n, _ in rows.values()], pa.int64()), pa.array([to_media(payload(d)) for _, d in rows.values()], pa.binary())],
                ["digest", "n_bytes", "media"],
            )

    return save(payloads.select("text").mapInArrow(run, "digest string, n_bytes long, media binary"), "media")


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(stored: DataFrame) -> DataFrame:
    """Decodes the stored files; one row per digest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = batch.column(2).to_pylist()
        data = [from_media(m) for m in media]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([len(d) for d in data], pa.int64()), pa.array([sha(d) for d in data], pa.string()),
                pa.array([zlib.crc32(d[-WIDTH:]) for d in data], pa.int64()), pa.array([len(m) for m in media], pa.int64()),
                pa.array([sha(m) for m in media], pa.string()), pa.array([feature(d) for d in data], pa.string()),
            ],
            ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    rows = stored.mapInArrow(batches(run), FEATURES)
    return rows.groupBy("digest").agg(F.min(F.struct(*[c for c in rows.columns if c != "digest"])).alias("m")).select("digest", "m.*")


def resolve(items: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """One row per media reference of (key, items): position, caption, digest and the columns of `media`."""
    refs = items.select(key, F.explode("items").alias("i")).where("i.kind = 'media'").select(key, "i.position", "i.caption", "i.digest")
    return refs.join(media, "digest", "left")


def page(text, digest):
    """A document as a page: its text, and its payload as a figure that the text's first 80 characters caption."""
    escaped = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<p>"), escaped, F.lit(f'</p><figure><img src="{SCHEME}'), digest, F.lit('"><figcaption>'), F.substring(escaped, 1, 80), F.lit("</figcaption></figure>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page of its text and a figure that holds the text's bytes; the figure's payload is resolved by its digest."""
    docs = read(spark, sf_dir, "documents")
    media = read_back(store(docs))
    digest = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)
    items = sequences(docs.select("doc_id", page(F.col("text"), digest).alias("html")), "doc_id")
    return resolve(items, "doc_id", media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")


def query_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, position, kind, text, caption, digest and, where the payload is stored, its n_bytes and feature, of every item of `pages`."""
    pages, docs = read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents")
    items = sequences(pages, "page_id")
    listed = items.select("page_id", F.explode("items").alias("i")).select("page_id", "i.position", "i.kind", "i.text", "i.caption", "i.digest")
    found = resolve(items, "page_id", read_back(store(docs))).select(F.col("page_id").alias("p"), F.col("position").alias("at"), "n_bytes", "feature")
    return listed.join(found, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("position") == F.col("at")), "left").drop("p", "at")
