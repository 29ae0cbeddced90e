"""Operator 5: n-gram Jaccard join with size bands, bitmap signatures and exact intersection.

A document's set is the set of its distinct 5-word shingles (64-bit hashes of the words; A-Z
lower-cased). Documents link when intersection / union >= 0.8.

1. Documents with equal sets collapse to their smallest id (partial aggregation).
2. Two linked sets share one of the first n - ceil(0.8 n) + 1 elements of each in any common
   order. The order puts shingles that are frequent in the corpus last (a fixed-size table of
   logarithmic counts, which only steers the order), so a passage found in a third of all
   documents forms no group. Every element of that prefix is a group key.
3. Round 1: each document is verified against one centre, the smallest member it meets most often.
   Links are contracted to components; a large group of near copies is settled here.
4. Round 2: groups that still hold several components are cut into tiles of bounded size. Within a
   tile, members are sorted by set size and only compared inside the size band that 0.8 allows.
   Each has a bitmap of its hashed shingles whose width follows its size band; the number of bits
   in which two bitmaps differ bounds the overlap from above. Pairs of different components that
   pass are verified by intersecting their sorted arrays.

No pair of different components that could link is left out, so the components are exact.

Defined results: null or empty texts and texts without words have n_shingles 0 and are their own
component; fewer than five words are one shingle; repeated ids count once per row with the union of
their links; a null id gets a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpengine.llm.common import (connected_components, discard, free_shuffles, lower_bytes, mix64, packed, prefix_hash, range_hash,
                                 small_batches, small_broadcasts, spark_of, stage, text_blocks, word_spans)
from fpengine.operators.windows import distributed_row_number

WORDS = 5
#: similarity as a fraction
NUM, DEN = 80, 100
#: counters of the table that steers the order; a shingle counts as frequent from here on
SLOTS = 1 << 22
SEEN_IN_TASK, FREQUENT = 5, 32
#: rows of a tile's side
TILE = 1024
#: bytes of text that a kernel works on at once: its arrays take about a hundred times as much
TEXTS = 200_000
#: least number of bits an element has in the bitmaps that travel with pairs and members of tiles (many rows a document)
BITS = 4


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a block."""
    low = lower_bytes(data)
    start, end, row = word_spans(low, off)
    rows = len(off) - 1
    if not len(start):
        return [np.zeros(0, dtype=np.uint64)] * rows
    h = range_hash(prefix_hash(low.astype(np.uint64)), start, end)
    first = np.searchsorted(row, np.arange(rows + 1))
    mult = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    whole = max(len(h) - words + 1, 0)
    sh = np.zeros(whole, dtype=np.uint64)
    for j in range(words):
        sh += mix64(h[j:j + whole] + np.uint64(j)) * mult[j]
    sh = mix64(sh)
    out = []
    for i in range(rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= words:
            out.append(np.unique(sh[a:b - words + 1]))
        elif b > a:
            short = np.uint64((b - a) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)
            for j in range(b - a):
                short = short + mix64(h[a + j:a + j + 1] + np.uint64(j)) * mult[j]
            out.append(mix64(np.atleast_1d(short)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _slot(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def _scan(words):
    """Per document its id, set size and set fingerprint; per task the slots seen often."""
    def run(batches):
        import pyarrow as pa
        count = np.zeros(SLOTS, dtype=np.int32)
        for batch in batches:
            ids = batch.column(0)
            for at, rows, data, off in text_blocks(batch, most=TEXTS):
                sets = shingle_sets(data, off, words)
                for u in sets:
                    if len(u):
                        s = _slot(u)
                        np.add.at(count, s, 1) if len(s) < 2000 else count.__iadd__(np.bincount(s, minlength=SLOTS).astype(np.int32))
                with np.errstate(over="ignore"):
                    f1 = np.array([u.sum(dtype=np.uint64) for u in sets], dtype=np.uint64).view(np.int64)
                    f2 = np.array([np.bitwise_xor.reduce(mix64(u)) if len(u) else 0 for u in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, rows), pa.array([len(u) for u in sets], type=pa.int64()), pa.array(f1), pa.array(f2),
                     pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names=["doc_id", "n", "f1", "f2", "slot", "seen"])
        hit = np.flatnonzero(count >= SEEN_IN_TASK)
        for i in range(0, len(hit), 100_000):  # a large task has seen every slot
            some = hit[i:i + 100_000]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(some), pa.array(count[some].astype(np.int64))],
                                             names=["doc_id", "n", "f1", "f2", "slot", "seen"])
    return run


def prefix_of(u: np.ndarray, level: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n - ceil(n * num / den) + 1 elements, frequent ones last."""
    n = len(u)
    p = n - -(-n * num // den) + 1
    lv = level[_slot(u)]
    if not lv.any():
        return u[:p]
    return u[np.argsort(lv, kind="stable")[:p]]


def _prefixes(level_of, words, num, den):
    def run(batches):
        import pyarrow as pa
        level = np.frombuffer(level_of.value, dtype=np.uint8)
        for batch in batches:
            ids = batch.column(0)
            for at, rows, data, off in text_blocks(batch, most=TEXTS):
                sets = shingle_sets(data, off, words)
                pre = [prefix_of(u, level, num, den) if len(u) else u for u in sets]
                cut = np.zeros(rows + 1, dtype=np.int32)
                np.cumsum([len(p) for p in pre], out=cut[1:])
                flat = np.concatenate(pre).view(np.int64) if pre else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, rows), pa.array([len(u) for u in sets], type=pa.int64()),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], names=["doc_id", "n", "pre"])
    return run


def _meet(batches):
    """Rows (h, doc) sorted by both -> the groups of several documents, with their smallest: of two rows the other one, of more
    rows (``many``) every member. A group that goes on over batches is given out as it comes, so none is held whole."""
    import pyarrow as pa

    def out(h, doc, lo, many):
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 100_000]) for x in (h, doc, lo, many)], names=["h", "doc", "lo", "many"])

    def groups(h, doc):
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(first, len(h)))
        lo, many = np.repeat(doc[first], size), np.repeat(size > 2, size)
        several = np.repeat(doc[first] != doc[first + size - 1], size) & (many | (doc != lo))
        yield from out(h[several], doc[several], lo[several], many[several])

    none = np.zeros(0, dtype=np.int64)
    held, begun = (none, none), None
    for batch in batches:
        h, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if begun is not None:
            k = int(np.searchsorted(h, begun[0], side="right"))
            yield from out(h[:k], doc[:k], np.full(k, begun[1]), np.ones(k, dtype=bool))
            h, doc = h[k:], doc[k:]
        if not len(h):
            continue
        h, doc, begun = np.concatenate([held[0], h]), np.concatenate([held[1], doc]), None
        cut = int(np.searchsorted(h, h[-1]))
        yield from groups(h[:cut], doc[:cut])
        held = h[cut:], doc[cut:]
        if len(held[0]) > 2 and held[1][0] != held[1][-1]:
            yield from out(*held, np.full(len(held[0]), held[1][0]), np.ones(len(held[0]), dtype=bool))
            held, begun = (none, none), (int(h[-1]), held[1][0])
    yield from groups(*held)


def signature_width(n: int, per: int = 8) -> int:
    """Bits of the bitmap of a set of n: a power of two, from ``per`` * n to twice that, so it follows the size band. The wider
    it is, the fewer of the differing elements fall together and the nearer the bound is to the true overlap."""
    return 1 << max(6, int(per * n - 1).bit_length())


def signature(u: np.ndarray, per: int = 8) -> np.ndarray:
    bits = np.zeros(signature_width(max(len(u), 1), per), dtype=np.uint8)
    bits[(u >> np.uint64(8)).astype(np.int64) & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little")


def fold(sig: np.ndarray, width: int) -> np.ndarray:
    """A bitmap (or a matrix of them) of a smaller width."""
    while sig.shape[-1] * 8 > width:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] | sig[..., half:]
    return sig


def overlap_bound(n_a, n_b, differing):
    """Each differing bit stands for at least one element that only one of the sets has."""
    return (n_a + n_b - differing) // 2


def _id_slot(ids: np.ndarray, width: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) & np.uint64(width - 1)).astype(np.int64)


def _bits(width):
    """Ids -> words of the bitmap that holds them, one row per word and task."""
    def run(batches):
        import pyarrow as pa
        words = np.zeros(width // 64, dtype=np.uint64)
        for batch in batches:
            s = _id_slot(batch.column(0).to_numpy(), width)
            np.bitwise_or.at(words, s >> 6, np.uint64(1) << (s & 63).astype(np.uint64))
        hit = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(words[hit].view(np.int64))], names=["word", "bits"])
    return run


def id_bitmap(need: DataFrame):
    """A broadcast bitmap of the ids (long, not null) of a staged table: 16 bits per id, 8 MB at most whatever their number. It
    never misses an id but holds others too, so an exact join follows; it only keeps texts that nobody asks for out of the work."""
    width = 1 << min(26, max(16, int(16 * need.count()).bit_length()))
    got = need.mapInArrow(_bits(width), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return spark_of(need).sparkContext.broadcast(packed(got, "word", "bits", "<i8", width // 64).tobytes())


def _sets(words, wanted, per):
    """Sorted arrays (or bitmap signatures of ``per`` bits an element) of the sets of the documents that the id bitmap holds."""
    def run(batches):
        import pyarrow as pa
        held = np.frombuffer(wanted.value, dtype=np.uint64)
        for batch in batches:
            s = _id_slot(batch.column(0).to_numpy(), 64 * len(held))
            batch = batch.filter(pa.array((held[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1))
            ids = batch.column(0)
            for at, rows, data, off in text_blocks(batch, most=TEXTS):
                sets = shingle_sets(data, off, words)
                yield pa.RecordBatch.from_arrays([ids.slice(at, rows), pa.array([len(u) for u in sets], type=pa.int64()),
                                                  pa.array([(signature(u, per) if per else u).tobytes() for u in sets], type=pa.binary())],
                                                 names=["doc_id", "n", "bits" if per else "arr"])
    return run


def _bounded(num, den):
    """Pairs with set sizes and bitmaps -> pairs that may link."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = []
            for k in np.flatnonzero(np.minimum(na, nb) * den >= np.maximum(na, nb) * num).tolist():
                sa, sb = (np.frombuffer(batch.column(c)[k].as_buffer(), dtype=np.uint8) for c in (4, 5))
                w = 8 * min(len(sa), len(sb))
                diff = int(np.bitwise_count(fold(sa, w) ^ fold(sb, w)).sum())
                if (num + den) * overlap_bound(int(na[k]), int(nb[k]), diff) >= num * int(na[k] + nb[k]):
                    keep.append(k)
            if keep:
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])
    return run


def _verify(num, den):
    """Pairs with sorted arrays -> pairs that link, by exact intersection."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), dtype=np.uint64) for c in (2, 3))
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                if (num + den) * int((b[at] == a).sum()) >= num * (len(a) + len(b)):
                    keep.append(k)
            if keep:
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])
    return run


def _groups(batches, keys):
    """Runs of equal keys in sorted batches, whole even where they span batches."""
    import pyarrow as pa
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield t.slice(a, b - a)
        held = t.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def tile_pairs(doc, n, comp, block, sigs, cross: bool, num: int = NUM, den: int = DEN):
    """Pairs of different components, within the size band, whose bitmaps allow a link."""
    order = np.argsort(n, kind="stable")
    doc, n, comp, block = doc[order], n[order], comp[order], block[order]
    width = np.array([8 * len(sigs[k]) for k in order])
    mats: dict[int, tuple[int, np.ndarray]] = {}
    out_a, out_b = [], []
    last = np.searchsorted(n * num, n * den, side="right")  # n_j * num <= n_i * den
    for i in range(len(n)):
        w, hi = int(width[i]), int(last[i])
        if hi <= i + 1:
            continue
        if w not in mats:  # rows of this width and the next, folded to it: they follow each other
            lo, up = int(np.searchsorted(width, w)), int(np.searchsorted(width, 2 * w, side="right"))
            mats[w] = lo, np.stack([fold(np.frombuffer(sigs[k], dtype=np.uint8), w) for k in order[lo:up]])
        lo, mat = mats[w]
        cand = np.arange(i + 1, hi)
        ok = comp[cand] != comp[i]
        if cross:
            ok &= block[cand] != block[i]
        cand = cand[ok]
        if not len(cand):
            continue
        diff = np.bitwise_count(mat[cand - lo] ^ mat[i - lo]).sum(axis=1, dtype=np.int64)
        cand = cand[(num + den) * overlap_bound(n[i], n[cand], diff) >= num * (n[i] + n[cand])]
        out_a += [doc[i]] * len(cand)
        out_b += doc[cand].tolist()
    return np.array(out_a, dtype=np.int64), np.array(out_b, dtype=np.int64)


def _tiles(num, den):
    def run(batches):
        import pyarrow as pa
        for g in _groups(batches, ["g", "ti", "tj"]):
            ti, tj = g.column("ti")[0].as_py(), g.column("tj")[0].as_py()
            a, b = tile_pairs(g.column("doc").to_numpy(), g.column("n").to_numpy(), g.column("comp").to_numpy(),
                              g.column("blk").to_numpy(), g.column("sig").to_pylist(), ti != tj, num, den)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
    return run


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                       num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    with small_batches(spark_of(docs)), small_broadcasts(docs.sparkSession):  # everything in it is staged before it ends
        return _similar_components(docs, doc_id, text, words, num, den)


def _similar_components(docs: DataFrame, doc_id: str, text: str, words: int, num: int, den: int) -> DataFrame:
    spark = spark_of(docs)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scan = stage(src.mapInArrow(_scan(words), "doc_id long, n long, f1 long, f2 long, slot long, seen long"), "jac-scan")
    rows = scan.where("slot IS NULL")

    # the order's table: at most SLOTS small numbers
    seen = scan.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= FREQUENT)
    level = packed(seen.select("slot", F.floor(F.log2("seen")).alias("level")), "slot", "level", "u1", SLOTS)
    level_of = spark.sparkContext.broadcast(level.tobytes())

    # equal sets collapse; repeated ids with different sets stay apart until the end
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = stage(classes, "jac-classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "n").distinct()

    repeats = _has_repeats(rows)
    one = (lambda df: df.dropDuplicates(["doc_id", "n"])) if repeats else (lambda df: df)
    named = src.where("doc_id IS NOT NULL")
    pre = named.mapInArrow(_prefixes(level_of, words, num, den), "doc_id long, n long, pre array<long>")
    pre = stage(one(pre.where("n > 0").join(reps, ["doc_id", "n"], "left_semi")), "jac-prefix")
    level_of.destroy()
    free_shuffles(spark)
    # one shuffle finds the groups and their members: the first row of a group is its smallest document
    keyed = pre.select(F.explode("pre").alias("h"), F.col("doc_id").alias("doc"))
    met = stage(keyed.repartition("h").sortWithinPartitions("h", "doc").mapInArrow(_meet, "h long, doc long, lo long, many boolean"), "jac-members")
    discard(pre)
    free_shuffles(spark)
    more = met.where("many").select("h", "doc")
    star = met.where("doc <> lo").groupBy(F.col("lo").alias("a"), F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    # a pair outside the size band cannot link
    star = star.join(reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a") \
        .join(reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b") \
        .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b", "w")
    star = stage(star.distinct() if repeats else star, "jac-star")
    free_shuffles(spark)

    def sets_of(need: DataFrame, per: int = 0) -> DataFrame:
        """Arrays or bitmaps (``per`` bits an element) of the sets of the documents of ``need`` (doc_id). Texts are not shuffled; only sets are."""
        need = stage(need.distinct(), "jac-need")
        col = "bits" if per else "arr"
        wanted = id_bitmap(need)
        sets = named.mapInArrow(_sets(words, wanted, per), f"doc_id long, n long, {col} binary").where("n > 0")
        sets = sets.join(need, "doc_id", "left_semi")
        sets = stage(one(sets.join(reps, ["doc_id", "n"], "left_semi")) if repeats else sets, f"jac-{col}")
        wanted.destroy()
        discard(need)
        free_shuffles(spark)
        return sets

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))

    def may_link(pairs: DataFrame, sig: DataFrame) -> DataFrame:
        """Pairs whose sizes and bitmaps allow a link."""
        sa = sig.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("sa"))
        sb = sig.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("sb"))
        j = pairs.select("a", "b").join(sa, "a").join(sb, "b").select("a", "b", "na", "nb", "sa", "sb")
        return j.mapInArrow(_bounded(num, den), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that link. Only their documents' arrays are made."""
        sets = sets_of(ends(pairs))
        a = sets.select(F.col("doc_id").alias("a"), F.col("arr").alias("aa"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("arr").alias("ab"))
        j = pairs.join(a, "a").join(b, "b").select("a", "b", "aa", "ab")
        out = stage(j.mapInArrow(_verify(num, den), "a long, b long"), "jac-links")
        discard(sets)
        free_shuffles(spark)
        return out

    # round 1: each document against the centre it meets most often, of those that may link
    sig = sets_of(ends(star), BITS)
    open_ = stage(may_link(star, sig), "jac-open")
    discard(sig)
    free_shuffles(spark)
    best = star.join(open_, ["a", "b"]).groupBy("b").agg(F.max_by("a", F.struct("w", -F.col("a"))).alias("a"))
    first = stage(best.select("a", "b"), "jac-first")
    discard(star)
    links = verified(first)
    comp = connected_components(links)

    def with_comp(df: DataFrame, col: str, out: str) -> DataFrame:
        c = comp.select(F.col("id").alias(col), F.col("component_id").alias("_c"))
        return df.join(c, col, "left").withColumn(out, F.coalesce("_c", col)).drop("_c")

    # round 2: what is still in different components
    pairs2 = with_comp(with_comp(open_.join(first, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    member = stage(with_comp(more.select("h", "doc"), "doc", "comp"), "jac-member")
    discard(met)
    mixed = member.groupBy("h").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("m"),
                                    F.sum(F.xxhash64("doc").bitwiseAND(F.lit((1 << 40) - 1))).alias("fp")).where("c1 <> c2")
    # groups of the same members say the same: one of them is enough
    mixed = mixed.groupBy("m", "fp").agg(F.min("h").alias("h")).select("h", F.ceil(F.col("m") / TILE).cast("int").alias("nb"))
    left = stage(member.join(mixed, "h"), "jac-left")
    discard(member)
    free_shuffles(spark)
    sig = sets_of(left.select(F.col("doc").alias("doc_id")), BITS)
    tiles = left.join(sig.select(F.col("doc_id").alias("doc"), "n", F.col("bits").alias("sig")), "doc") \
        .withColumn("blk", F.pmod(F.xxhash64("doc"), F.col("nb")).cast("int")) \
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tiles = tiles.select(F.col("h").alias("g"), F.least("blk", "o").alias("ti"), F.greatest("blk", "o").alias("tj"),
                         "doc", "n", "comp", "blk", "sig")
    met = tiles.repartition("g", "ti", "tj").sortWithinPartitions("g", "ti", "tj").mapInArrow(_tiles(num, den), "a long, b long")
    rest = stage(met.union(pairs2).distinct().join(first, ["a", "b"], "left_anti"), "jac-rest")
    discard(sig, left, open_, first)
    free_shuffles(spark)
    used = [scan, classes, links, rest]
    if not rest.isEmpty():
        again = verified(rest)
        comp = connected_components(links.union(again))
        used.append(again)

    # every row: its class's component
    cls = classes.select("n", "f1", "f2", "rep")
    cls = with_comp(cls, "rep", "comp")
    if repeats:  # an id with several sets joins their components
        ids = rows.where("n > 0 AND doc_id IS NOT NULL").join(cls, ["n", "f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("comp").alias("b"))
        merged = connected_components(ids.union(cls.select(F.col("rep").alias("a"), F.col("comp").alias("b"))))
        out = rows.join(merged.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        comp_col = F.coalesce("component_id", "doc_id")
    else:
        out = rows.join(cls, ["n", "f1", "f2"], "left")
        comp_col = F.coalesce("comp", "doc_id")
    res = stage(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), comp_col).alias("component_id")), "jac-result")
    discard(*used)
    return res


def _has_repeats(rows: DataFrame) -> bool:
    """Whether an id occurs in more than one row (ids alone, partially aggregated)."""
    return not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 AND doc_id IS NOT NULL").isEmpty()


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, columns unchanged: the document with the smallest id, and of rows that repeat this id
    the one with the smallest hash of its text, then of all its columns. Documents with a null id take part: equal
    texts count as one document whose id is larger than all others."""
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    h2 = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1))
    named = docs.withColumn("_one_id", F.col(doc_id).cast("long"))
    if not named.where("_one_id IS NULL").isEmpty():
        top = named.agg(F.max("_one_id")).first()[0] or 0
        new = named.where("_one_id IS NULL").select(h.alias("_one_h"), h2.alias("_one_h2")).distinct().withColumn("_one_by", F.lit(1))
        new = stage(distributed_row_number(new, ["_one_by"], ["_one_h", "_one_h2"], out="_one_n").drop("_one_by"), "jac-null-ids")
        named = named.join(new, F.col("_one_id").isNull() & (h == F.col("_one_h")) & (h2 == F.col("_one_h2")), "left") \
            .withColumn("_one_id", F.coalesce("_one_id", F.col("_one_n") + F.lit(top).cast("long"))).drop("_one_h", "_one_h2", "_one_n")
        named = stage(named, "jac-named")
    comp = similar_components(named, "_one_id", text)
    gone = comp.where("component_id <> doc_id").select(F.col("doc_id").alias("_one_id")).distinct()
    kept = named.join(gone, "_one_id", "left_anti")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    again = stage(comp.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("_one_id")), "jac-again")
    if again.isEmpty():
        return kept.select(*cols)
    many = kept.join(again, "_one_id", "left_semi")
    # partial aggregation: an id that repeats very often is one row per task before the shuffle
    first = many.groupBy("_one_id").agg(F.min_by(F.struct(*cols), F.struct(h, F.xxhash64(*cols))).alias("_one_row"))
    return kept.join(again, "_one_id", "left_anti").select(*cols).unionByName(first.select("_one_row.*"))
