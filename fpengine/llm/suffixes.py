"""Operator 6: suffix-array style removal of repeated byte strings of at least 50 bytes.

A byte goes if it is covered by a 50-byte string that also starts in a document with a smaller id.

The suffixes of shards far larger than memory are not sorted one by one. As in induced sorting, a sample of
local minima stands for the rest: every 50-byte window is represented by its smallest 12-byte gram (by hash,
leftmost of equals), so equal windows have equal representatives at equal offsets. Neighbouring windows with
the same representative form a run; a run is one tuple (gram, context hash, document, place), about one per 20
bytes. Spark's external sort, which spills to disk, orders the tuples by gram. What holds for all other
suffixes is then induced from the sorted sample:

* runs with equal gram and equal context agree in all their windows, whose bytes are covered at once;
* runs that share a gram with another document but not the whole context agree in some windows at most. Windows fall into
  ``CLASSES`` by the place of the gram in them; equal ones are of one class and agree on all bytes that the windows of their class have in
  common (41 of 50). A tuple has a short hash of these bytes per class, and only the windows of classes whose bytes another document has too
  are expanded: a task settles what its own windows say about each other and keeps the smallest document's; these meet once, sorted by window
  and document, and all but the first document's are marked.

The classical external induced sorting carries common-prefix values through disk-backed priority queues
of one machine; here the context hash plays their part (full agreement) and window hashes the
rest, because the length that matters is fixed. Tuples of equal gram and context collapse inside a task to the smallest
document before the shuffle, and grams that one task sees in more contexts than its share of
``GROUP`` go straight to the expansion, with one witness sent along, so no gram gathers an unbounded group.

Strings are compared by 64-bit hashes of their bytes.

Defined results: null and empty texts have 0 bytes; texts under 50 bytes keep all; a null id neither loses bytes
nor takes them from others; rows that repeat an id are not smaller than each other; matches never cross rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpengine.llm.common import discard, free_shuffles, mix64, prefix_hash, range_hash, spark_of, stage, text_blocks

LENGTH = 50
GRAM = 12
#: runs of one gram that may meet in one task; a map task that sees more than its share expands them directly
GROUP = 1_000_000
#: tuples a task holds before it gives them out
HELD = 500_000
#: classes of windows by the place of the gram; bits of a class's hash
CLASSES, _KBITS = 4, 10
#: the number of windows of a run has 6 bits, the place of the gram in its first window 6 bits, then the classes' hashes follow
_FBITS, _KEYS = 40, 12


def _class_bounds(length: int = LENGTH, gram: int = GRAM) -> list[int]:
    """Class k holds the windows with bounds[k] to bounds[k + 1] - 1 bytes before their gram."""
    return [-(-k * (length - gram + 1) // CLASSES) for k in range(CLASSES + 1)]


def runs_of(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one representative: row, first window (place in the row), number of
    windows (6 bits) with the place of the gram in the first one (6 bits) and a short hash per class (0: the run has no
    window of it), gram hash, context hash."""
    n = np.diff(off)
    have = np.flatnonzero(n >= length)
    if not len(have):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    s = prefix_hash(data.astype(np.uint64) + np.uint64(1))
    total = len(data)
    at = np.arange(total - gram + 1)
    h = range_hash(s, at, at + gram)
    reach = length - gram + 1  # grams per window
    # smallest (hash, place) over each window of grams: the top bits of the hash, then the place
    v = h & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
    have_w = 1
    while have_w < reach:
        step = min(have_w, reach - have_w)
        v = np.minimum(v[:-step], v[step:])
        have_w += step
    rep = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)  # representative of the window at each place of the block
    valid = np.zeros(total + 1, dtype=np.int32)
    np.add.at(valid, off[:-1][have], 1)
    np.add.at(valid, off[1:][have] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1])[:len(rep)] > 0)
    r = rep[starts]
    # equal places mean equal representatives; a run also ends where the windows are not adjacent
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    a = starts[first]
    row = np.searchsorted(off, a, side="right") - 1
    place = r[first]
    ctx = range_hash(s, a, a + count + length - 1)
    ctx = mix64(ctx ^ (place - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    # what all windows of a class have in common: the bytes around the gram that its most unlike windows share
    before = place - a
    code = count | before << 6
    bounds = _class_bounds(length, gram)
    for k in range(CLASSES):
        has = np.flatnonzero((before >= bounds[k]) & (before - count + 1 < bounds[k + 1]))
        left, right = place[has] - bounds[k], place[has] + length - (bounds[k + 1] - 1)
        code[has] |= (range_hash(s, left, right) % np.uint64((1 << _KBITS) - 1) + np.uint64(1)).astype(np.int64) << (_KEYS + _KBITS * k)
    # 48 bits of the gram's hash are enough: contexts are compared too
    return row, a - off[row], code, h[place] >> np.uint64(16), ctx


def _merge(doc, th, start, end):
    """Overlapping or touching spans of the same row become one. Sorted by row, start."""
    o = np.lexsort((start, th, doc))
    doc, th, start, end = doc[o], th[o], start[o], end[o]
    if not len(doc):
        return doc, th, start, end
    other = np.ones(len(doc), dtype=bool)
    other[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    # running maximum of the ends within a row: rows are told apart by a large offset
    part = np.cumsum(other)
    big = np.int64(1) << 40
    top = np.maximum.accumulate(end + part * big) - part * big
    new = other.copy()
    new[1:] |= start[1:] > top[:-1]
    f = np.flatnonzero(new)
    last = np.append(f[1:], len(doc)) - 1
    return doc[f], th[f], start[f], top[last]


COLS = "kind int, g long, f long, doc long, th long, a long, b long"
SPAN, OPEN, EXPAND = 0, 1, 2


def _rows(kind, g, f, doc, th, a, b):
    import pyarrow as pa
    n = len(doc)
    z = np.zeros(n, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, dtype=np.int32)), pa.array(z if g is None else g), pa.array(z if f is None else f), pa.array(doc), pa.array(th),
         pa.array(a), pa.array(b)], names=["kind", "g", "f", "doc", "th", "a", "b"])


def _collapse(parts, length, most):
    """Equal gram and context inside a task: all but the smallest document are settled."""
    g, f, doc, th, a, c = (np.concatenate([p[k] for p in parts]) for k in range(6))
    at = np.lexsort((doc, f, g))
    g, f, doc, th, a, c = (x[at] for x in (g, f, doc, th, a, c))
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (f[1:] != f[:-1])
    first = np.flatnonzero(new)
    low = np.repeat(doc[first], np.diff(np.append(first, len(g))))
    done = doc > low
    if done.any():
        d, t, s, e = _merge(doc[done], th[done], a[done], a[done] + (c[done] & 63) + length - 1)
        yield _rows(SPAN, mix64(d.astype(np.uint64)).view(np.int64), None, d, t, s, e)
    k = ~done
    g, f, doc, th, a, c, at = (x[k] for x in (g, f, doc, th, a, c, at))
    newg = np.ones(len(g), dtype=bool)
    newg[1:] = g[1:] != g[:-1]
    fg = np.flatnonzero(newg)
    size = np.diff(np.append(fg, len(g)))
    hot = np.repeat(size > most, size)
    packed = (f & np.uint64((1 << _FBITS) - 1)).astype(np.int64) << 1
    if hot.any():
        yield _rows(EXPAND, mix64(doc[hot].astype(np.uint64)).view(np.int64), None, doc[hot], th[hot], a[hot], c[hot] & 63)
        w = fg[size > most]  # a witness for the other tasks; its mark sends the whole group to the expansion
        yield _rows(OPEN, g[w].view(np.int64), packed[w] | 1, doc[w], th[w], a[w], c[w])
    cold = np.flatnonzero(~hot)
    cold = cold[np.argsort(at[cold])]  # in the order of the texts neighbouring rows are alike and pack better
    yield _rows(OPEN, g[cold].view(np.int64), packed[cold], doc[cold], th[cold], a[cold], c[cold])


def _scan(length, gram, most):
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, rows, data, off in text_blocks(batch, most=1_000_000):
                row, a, c, g, f = runs_of(data, off, length, gram)
                if not len(row):
                    continue
                parts.append((g, f & np.uint64((1 << _FBITS) - 1), ids[at + row], ths[at + row], a, c))
                held += len(row)
                if held >= HELD:
                    yield from _collapse(parts, length, most)
                    parts, held = [], 0
        if parts:
            yield from _collapse(parts, length, most)
    return run


def _settle(length, gram):
    """Tuples sorted by gram, context, document: spans that are settled and runs to expand."""
    bounds = _class_bounds(length, gram)

    def work(t):
        kind, g, f, doc, th, a, c = (t.column(k).to_numpy() for k in range(7))
        sp = kind == SPAN
        if sp.any():
            yield _rows(SPAN, None, None, doc[sp], th[sp], a[sp], c[sp])
        ex = kind == EXPAND
        if ex.any():
            yield _rows(EXPAND, None, None, doc[ex], th[ex], a[ex], c[ex])
        op = kind == OPEN
        g, f, doc, th, a, c = (x[op] for x in (g, f, doc, th, a, c))
        if not len(g):
            return
        hot, f = f & 1, f >> 1
        newg = np.ones(len(g), dtype=bool)
        newg[1:] = g[1:] != g[:-1]
        fg = np.flatnonzero(newg)
        size = np.diff(np.append(fg, len(g)))
        shared = (np.minimum.reduceat(doc, fg) != np.maximum.reduceat(doc, fg)) | (np.maximum.reduceat(hot, fg) > 0)
        many, fg_size = np.repeat(shared, size), size[shared]
        g, f, doc, th, a, c = (x[many] for x in (g, f, doc, th, a, c))
        if not len(g):
            return
        grp = np.repeat(np.arange(len(fg_size)), fg_size)
        anyhot = np.maximum.reduceat(hot[many], np.cumsum(fg_size) - fg_size) > 0
        o = np.lexsort((doc, f, grp))
        grp, f, doc, th, a, c = (x[o] for x in (grp, f, doc, th, a, c))
        newf = np.ones(len(grp), dtype=bool)
        newf[1:] = (grp[1:] != grp[:-1]) | (f[1:] != f[:-1])
        ff = np.flatnonzero(newf)
        nf = np.diff(np.append(ff, len(grp)))
        low = np.repeat(doc[ff], nf)
        done = doc > low
        if done.any():
            yield _rows(SPAN, None, None, *_merge(doc[done], th[done], a[done], a[done] + (c[done] & 63) + length - 1))
        # several contexts of one gram: of the smallest document of each context the windows are expanded whose class's bytes another
        # document has too
        contexts = np.bincount(grp[ff], minlength=len(fg_size))
        wide = np.flatnonzero((~done) & ((contexts[grp] > 1) | anyhot[grp]))
        if not len(wide):
            return
        grp, doc, th, a, c = (x[wide] for x in (grp, doc, th, a, c))
        whole = anyhot[grp]
        if whole.any():
            yield _rows(EXPAND, None, None, doc[whole], th[whole], a[whole], c[whole] & 63)
        near = np.zeros((CLASSES + 2, len(grp)), dtype=bool)  # a class without windows before the first and after the last
        for k in range(CLASSES):
            key = (c >> (_KEYS + _KBITS * k)) & ((1 << _KBITS) - 1)
            o = np.lexsort((key, grp))
            gs, ks, ds = grp[o], key[o], doc[o]
            new = np.ones(len(o), dtype=bool)
            new[1:] = (gs[1:] != gs[:-1]) | (ks[1:] != ks[:-1])
            f0 = np.flatnonzero(new)
            several = (np.minimum.reduceat(ds, f0) != np.maximum.reduceat(ds, f0)) & (ks[f0] > 0)
            near[k + 1, o] = np.repeat(several, np.diff(np.append(f0, len(o))))
        near &= ~whole
        first, gram_at = a, a + ((c >> 6) & 63)
        last = a + (c & 63) - 1
        for i in range(CLASSES):  # neighbouring classes of a run stay one run
            for j in range(i, CLASSES):
                x = np.flatnonzero(near[i + 1:j + 2].all(axis=0) & ~near[i] & ~near[j + 2])
                if len(x):
                    lo, hi = np.maximum(first[x], gram_at[x] - (bounds[j + 1] - 1)), np.minimum(last[x], gram_at[x] - bounds[i])
                    yield _rows(EXPAND, None, None, doc[x], th[x], lo, hi - lo + 1)

    def run(batches):
        import pyarrow as pa
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            t = t.combine_chunks()
            g = t.column(1).to_numpy()
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
            if cut:
                yield from work(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from work(held.combine_chunks())
    return run


WINDOWS = "w long, doc long, th long, a long, b long"


def _window_rows(w, doc, th, a, b):
    import pyarrow as pa
    for i in range(0, len(doc), 200_000):
        j = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[j]) for x in (w, doc, th, a, b)], names=["w", "doc", "th", "a", "b"])


def _lowest(parts, length):
    """Equal windows inside a task: all but the smallest document's are settled. An open window has end 0."""
    w, doc, th, a = (np.concatenate([p[k] for p in parts]) for k in range(4))
    o = np.lexsort((doc, w))
    w, doc, th, a = (x[o] for x in (w, doc, th, a))
    new = np.ones(len(w), dtype=bool)
    new[1:] = w[1:] != w[:-1]
    first = np.flatnonzero(new)
    done = doc > np.repeat(doc[first], np.diff(np.append(first, len(w))))
    if done.any():
        d, t, s, e = _merge(doc[done], th[done], a[done], a[done] + length)
        yield from _window_rows(mix64(d.astype(np.uint64)).view(np.int64), d, t, s, e)
    k = np.flatnonzero(~done)
    k = k[np.lexsort((a[k], th[k], doc[k]))]  # neighbouring rows are alike and pack better
    yield from _window_rows(w[k], doc[k], th[k], a[k], np.zeros(len(k), dtype=np.int64))


def _expand(length, most=HELD):
    """Windows of the runs of a text by the hash of their bytes, and spans that are settled."""
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for at, rows, data, off in text_blocks(batch):
                s = prefix_hash(data.astype(np.uint64) + np.uint64(1))
                part = batch.slice(at, rows)
                lists = part.column(part.schema.get_field_index("runs"))
                cnt = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
                flat = lists.flatten()
                a, c = flat.field("a").to_numpy(), flat.field("c").to_numpy()
                row = np.repeat(np.arange(rows), cnt)
                row, base = np.repeat(row, c), np.repeat(a, c)
                start = base + np.arange(len(base)) - np.repeat(np.cumsum(c) - c, c)
                # the same window may stand in two runs of the list only if the list repeats: it never does
                p = off[row] + start
                ids, ths = part.column(0).to_numpy(), part.column(1).to_numpy()
                parts.append((range_hash(s, p, p + length).view(np.int64), ids[row], ths[row], start))
                held += len(start)
                if held >= most:
                    yield from _lowest(parts, length)
                    parts, held = [], 0
        if held:
            yield from _lowest(parts, length)
    return run


def _marked(length):
    """Windows sorted by hash and document -> the spans of all that a smaller document has too, and the settled ones."""
    def run(batches):
        import pyarrow as pa
        last, low = None, None
        for batch in batches:
            w, doc, th, a, b = (batch.column(k).to_numpy() for k in range(5))
            hit = b > 0
            end = b.copy()
            op = np.flatnonzero(~hit)
            if len(op):
                v, d = w[op], doc[op]
                new = np.ones(len(op), dtype=bool)
                new[1:] = v[1:] != v[:-1]
                first = np.flatnonzero(new)
                least = d[first]
                if last is not None and v[0] == last:  # the group began in the batch before
                    least[0] = low
                last, low = v[-1], least[-1]
                hit[op] = d > np.repeat(least, np.diff(np.append(first, len(op))))
                end[op] = a[op] + length
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merge(doc[hit], th[hit], a[hit], end[hit])], names=["doc", "th", "a", "b"])
    return run


def _apply(batches):
    import pyarrow as pa
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            out = []
            for doc, raw, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                kept, at, gone, n = [], 0, 0, 0
                for s in sorted((x["a"], x["b"]) for x in spans or ()):
                    if n and s[0] <= at:  # overlaps or touches the span before
                        if s[1] > at:
                            gone += s[1] - at
                            at = s[1]
                        continue
                    kept.append(raw[at:s[0]])
                    gone += s[1] - s[0]
                    at, n = s[1], n + 1
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, len(raw), gone, n, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): ``kept`` has the remaining bytes."""
    spark = spark_of(docs)
    src = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    repeats = not src.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    # rows that repeat an id are told apart by their text
    src = src.withColumn("th", F.xxhash64("text") if repeats else F.lit(0).cast("long")).select("doc", "th", "text")
    runs = src.where("doc IS NOT NULL").mapInArrow(_scan(length, gram, max(64, GROUP // max(1, src.rdd.getNumPartitions()))), COLS)
    found = stage(runs.repartition("g").sortWithinPartitions("g").mapInArrow(_settle(length, gram), COLS).select("kind", "doc", "th", "a", "b"), "sfx-found")
    del runs
    free_shuffles(spark)

    lists = found.where(F.col("kind") == EXPAND).groupBy("doc", "th").agg(F.collect_set(F.struct("a", F.col("b").alias("c"))).alias("runs"))
    wide = src.join(lists, ["doc", "th"]).select("doc", "th", "text", "runs")
    windows = wide.mapInArrow(_expand(length), WINDOWS).repartition("w").sortWithinPartitions("w", "doc")
    hits = windows.mapInArrow(_marked(length), "doc long, th long, a long, b long")
    spans = found.where(F.col("kind") == SPAN).select("doc", "th", "a", "b").unionByName(hits)
    per = spans.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    per = stage(per, "sfx-spans")
    discard(found)
    free_shuffles(spark)
    j = src.join(per, ["doc", "th"], "left").select("doc", "text", "spans")
    return j.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
