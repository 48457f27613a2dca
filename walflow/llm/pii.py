"""PII: base patterns plus bootstrapped contextual extraction.

The base finds email, ip, card and phone in every whole text: leftmost matches per
kind without overlap, dropped (never retried) where a check fails.

The bootstrap then looks for identifiers that no pattern describes. Every run of
identifier characters with digits in it (``candidates``) is an instance; the last
one to three tokens before it are its lexical patterns. The seeds are the base
entities and runs shaped like credentials (long, letters mixed with digits).
Spark keeps the pattern-instance graph as counted edges, summed before any
shuffle, and scores it in ``ROUNDS`` turns:

* a pattern's score is the mean score of its distinct instances; it is accepted
  with at least ``SUPPORT`` distinct instances and a score of ``CONFIDENCE``;
* an instance's score is 1 for seeds, else the best score of its accepted patterns.

All instances of accepted patterns become spans of kind ``context``, so contexts
learnt from seeds find identifiers of other shapes. Copies of one document add no
support, as instances are counted once.

Defined cases: null text is empty and has no span; very long texts are scanned
whole; repeated rows get the same spans; ties cannot change a score; extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walflow.llm.common import batches, encoded, forget, fresh, read, save, sha, small_batches

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.6
#: An identifier has at least so many characters and digits; a seed credential so many of both.
LEAST_CHARS, LEAST_DIGITS, SEED_CHARS = 6, 2, 16
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
_RUN_RIGHT = re.compile(r"[A-Za-z0-9_+/-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from their @ signs."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base entities, kind as its place in KINDS, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def tokens_before(text: str, start: int, known: dict[int, list[str]]) -> list[str]:
    """The last three matches of `[^\\W\\d_]+|[^\\w\\s]` in text[:start], lower-cased, found by walking back; `known`
    keeps the answers by start, so that a long stretch without tokens is walked once."""
    out: list[str] = []
    at = start
    while at > 0 and len(out) < 3:
        if at in known:
            out += reversed(known[at])
            break
        end, at = at, at - 1
        c = text[at]
        if c.isalnum() and not c.isdecimal():
            while at > 0 and text[at - 1].isalnum() and not text[at - 1].isdecimal():
                at -= 1
            out.append(text[at:end].lower())
        elif not (c.isdecimal() or c == "_" or c.isspace()):
            out.append(c.lower())
    known[start] = out[2::-1]
    return known[start]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, list[str]]]:
    """(start, end, seed, patterns) of the identifier runs; base entities are seeds and marked by their own span."""
    out: list[tuple[int, int, bool]] = []
    taken = sorted((s, e) for s, _, e in base)
    reach: list[int] = []  # how far the base spans up to each go: kinds overlap
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))
    done = 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        left = m.start()
        while left > done and text[left - 1] in _RUN:
            left -= 1
        done = right = _RUN_RIGHT.match(text, m.end()).end()
        before = bisect.bisect_right(taken, (left, len(text) + 1))
        if before and reach[before - 1] >= right:  # within a base span, which starts no later
            continue
        run = text[left:right]
        n = sum(map(run.count, "0123456789"))
        if len(run) >= LEAST_CHARS and n >= LEAST_DIGITS:
            out.append((left, right, len(run) >= SEED_CHARS and LEAST_DIGITS <= n < len(run)))
    known: dict[int, list[str]] = {}
    found = []
    for start, end, seed in [*((s, e, True) for s, e in taken), *out]:
        before = tokens_before(text, start, known)
        found.append((start, end, seed, [" ".join(before[-n:]) for n in range(1, len(before) + 1)]))
    return found


CANDIDATES = "array<struct<start long, `end` long, base boolean, seed boolean, instance long, patterns array<string>>>"
SCANNED = f"doc_id long, key string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start long, kind int, `end` long>>, candidates {CANDIDATES}"


def scan(docs: DataFrame) -> DataFrame:
    """Base results and candidates of every row of docs (doc_id, text); `key` is a digest of the text."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts, digests, bases, cands = [], [], [], [], []
        for data in encoded(batch.column(1)):
            text = data.decode("utf-8", "replace")
            base = base_spans(text)
            known = {(s, e) for s, _, e in base}
            keys.append(hashlib.md5(data).hexdigest())
            counts.append([sum(k == kind for _, k, _ in base) for kind in range(4)])
            digests.append(sha(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()))
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            cands.append([
                {"start": s, "end": e, "base": (s, e) in known, "seed": seed, "instance": int.from_bytes(hashlib.md5(text[s:e].encode()).digest()[:8], "big", signed=True), "patterns": patterns}
                for s, e, seed, patterns in candidates(text, base)
            ])
        columns = [batch.column(0), pa.array(keys, pa.string()), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)], pa.array(digests, pa.string()), pa.array(bases, span), pa.array(cands, found)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "candidates"])

    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(batches(run), SCANNED)


def learn(scanned: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """The accepted patterns with their scores, from the candidates of all rows."""
    edges = (
        scanned.select(F.explode("candidates").alias("c")).select(F.explode("c.patterns").alias("pattern"), "c.instance", F.col("c.seed").cast("int").alias("seed"))
        .groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    )
    # A pattern without enough distinct instances can never be accepted.
    enough = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern")
    edges = save(edges.join(enough, "pattern"), "pii-edges")
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for turn in range(rounds):
        accepted = scored.groupBy("pattern").agg(F.avg("score").alias("pattern_score")).where(F.col("pattern_score") >= confidence)
        if turn == rounds - 1:
            return save(accepted, "pii-patterns")
        best = edges.join(accepted, "pattern").groupBy("instance").agg(F.max("pattern_score").alias("best"))
        before, scored = scored, save(
            edges.join(best, "instance", "left").select("pattern", "instance", "seed", F.greatest(F.col("seed").cast("double"), F.coalesce("best", F.lit(0.0))).alias("score")),
            "pii-scores",
        )
        forget(before)


def found_spans(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, key, extra): the spans that accepted patterns add."""
    occurrences = scanned.select("doc_id", "key", F.explode("candidates").alias("c")).where("not c.base").select("doc_id", "key", "c.start", "c.end", F.explode("c.patterns").alias("pattern"))
    hits = occurrences.join(patterns.select("pattern"), "pattern", "left_semi")
    span = F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end")
    return hits.groupBy("doc_id", "key").agg(F.collect_set(span).alias("extra"))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, key, the base columns and `found` (all spans in order: start, kind, end) of every row."""
    scanned = save(scan(docs), "pii-scan")
    extra = found_spans(scanned, learn(scanned))
    joined = scanned.join(extra.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "extra"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start long, kind int, `end` long>>"))))
    return joined.select("doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("found"))


def spans_text(found):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_text(text: str, found: list) -> str:
    """`text` with every span replaced by its kind; overlapping spans merge under the first one's kind."""
    out, at = [], 0
    for s in found:
        start, end = s["start"], s["end"]
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{KINDS[s['kind']]}>"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, extracted: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with the spans in `column` replaced; its other columns, whatever their names, and its rows as they are."""
    schema = docs.schema
    own_id, own_key, other_id, other_key, spans_name = fresh(docs.columns, "id", "key", "other_id", "other_key", "spans")
    rows = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_key, F.md5(F.coalesce(F.col(column).cast("binary"), F.lit(b""))))
    spans = extracted.where(F.size("found") > 0).groupBy(F.col("doc_id").alias(other_id), F.col("key").alias(other_key)).agg(F.first("found").alias(spans_name))
    joined = rows.join(spans, F.col(own_id).eqNullSafe(F.col(other_id)) & (F.col(own_key) == F.col(other_key)), "left").select(*docs.columns, spans_name)
    names = list(docs.columns)
    at = names.index(column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, found = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        new = [redact_text(t, f) if f and t is not None else t for t, f in zip(texts, found)]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns[at] = pa.array(new, batch.column(at).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(batches(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans_text(F.col("found")).alias("spans"))
