"""Operator 10: document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of every window of w neighbouring hashes the smallest is
kept, of equal ones the rightmost, with its position. Any two texts that share a run of w + k - 1 code
points share a kept hash; no shared run under k points is ever reported.

Defined results: null and empty texts have an empty fingerprint; a text shorter than k has one hash, of
the whole text; a text with fewer than w grams has one window. The likeness of two fingerprints is the share
of distinct hashes they have in common (both empty: 1, one empty: 0). Repeated ids are ordered by their
text; a null id comes first in the order of documents; a single document is its own next one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpengine.llm.common import ordered_blocks, prefix_hash, range_hash, spark_of

K, W = 16, 64
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (32 bits) and their positions."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    k = min(k, n)
    start = np.arange(n - k + 1)
    h = range_hash(prefix_hash(cps + np.uint64(1)), start, start + k) >> np.uint64(32)
    # the smaller low part wins among equal hashes: that of the larger position
    v = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - start.astype(np.uint64))
    w = min(w, len(v))
    have = 1
    while have < w:  # minimum over windows of twice the width, until w is reached
        step = min(have, w - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    pos = 0xFFFFFFFF - (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
    pos = pos[np.concatenate([[True], pos[1:] != pos[:-1]])]
    return h[pos].astype(np.uint32), pos


def hex_string(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits per hash, in order of position."""
    nibbles = (hashes[:, None] >> np.arange(28, -1, -4, dtype=np.uint32)) & np.uint32(15)
    return _HEX[nibbles.astype(np.int64)].tobytes().decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Distinct hashes in common over distinct hashes of both."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the next document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(doc_id, n_chars, hashes array<long>, positions array<long>)."""
    import pyarrow as pa

    spark_of(docs)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                texts = b.column(1).to_pylist()
                got = [winnow(t, k, w) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t) for t in texts], type=pa.int64()),
                     pa.array([h.astype(np.int64) for h, _ in got], type=pa.list_(pa.int64())),
                     pa.array([p for _, p in got], type=pa.list_(pa.int64()))], names=["doc_id", "n_chars", "hashes", "positions"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_chars long, hashes array<long>, positions array<long>")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that of the next
    document. Texts are dealt once, in blocks of neighbouring ids."""
    import pyarrow as pa

    spark_of(docs)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("_o", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_h", F.xxhash64("text"))
    dealt = ordered_blocks(src, "_o", "_h").select("doc_id", "text", "_block", "_role")

    def run(batches):
        rows: list[tuple] = []
        held = None  # doc_id, text, fingerprint, block of the own row that waits for its next one

        def out():
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            b = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=NAMES)
            rows.clear()
            return b

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for d, t, block, role in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    if role == 0:
                        continue
                    f = winnow(t, k, w)[0]
                    if held is not None and held[3] == block:
                        e = edited(held[1], t)
                        g = winnow(e, k, w)[0]
                        rows.append((held[0], len(held[1]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), hex_string(held[2]),
                                     hex_string(g), likeness(held[2], g), likeness(held[2], f)))
                    held = (d, t, f, block) if role == 1 else None
                if len(rows) >= 256:
                    yield out()
        if rows:
            yield out()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                 "near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
