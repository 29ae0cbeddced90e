"""Operator 3: SentencePiece encoding and decoding by streaming Viterbi.

The text becomes "▁" + text with spaces as "▁", and is cut into the vocabulary's pieces so that
the sum of the piece scores is largest; characters that no piece holds become UTF-8 byte pieces.
The Viterbi recurrence runs over a stream of characters. It looks back over a window of the
longest piece only. Positions inside that window are the only ones a later piece can start from, so
when the back pointers of all of them meet in one boundary, the pieces before it are final and are
given out, and the state before it is dropped. A boundary that no piece of the vocabulary spans
(found from the pairs of neighbouring characters inside pieces) is such a meeting point at once.

Which path encodes what: words between spaces of at most 48 characters are looked up in a bounded memo that is
filled by a lattice over many words side by side; longer words, and words after runs of spaces, go through the
streaming recurrence, cut where no piece spans. The ids are the same as those of streaming the whole text.

The vocabulary file stores merge ranks as scores, not probabilities. A sum of ranks would favour
many short pieces, so a piece of rank r scores log(1 / (r + 2.7)), Zipf's law, normalised. Of two equally good
paths, the one whose last piece is longer wins. The result is the best-scoring segmentation, which is not
always the one that merging by rank finds. Decoding gives the text back exactly.

Defined results: null and empty texts have no ids and decode to ""; a literal "▁" is kept apart from a
space (byte pieces); texts of any length, without any space too, are encoded; texts are split into words in
memory, 1024 at a time, so a worker needs room for their words and ids (only the recurrence itself is held to its
window); repeated rows give repeated results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpengine.llm.common import spark_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: stands for a literal U+2581 while encoding; no valid text holds a lone surrogate
LITERAL = "\udc81"
#: memo entries a worker keeps, and the longest run that is kept
MEMO, MEMO_LENGTH = 700_000, 48
#: runs that are encoded side by side
LANES = 20_000
#: the window is tested for convergence whenever it is this many characters longer
TEST_EVERY = 64
#: scores are fixed-point numbers with this unit
SCALE = 1 << 20


@dataclass
class Vocabulary:
    pieces: list[str]
    normal: list[bool]
    byte_ids: list[int]

    def __post_init__(self):
        rank, total = 0, 0.0
        scores: dict[str, tuple[int, float]] = {}
        for i, p in enumerate(self.pieces):
            if self.normal[i]:
                s = math.log(1.0 / (rank + 2.7))
                scores[p] = (i, s)
                total += 1.0 / (rank + 2.7)
                rank += 1
        norm = math.log(total) if total else 0.0
        # whole numbers, so that equal sums are equal in whatever order they were formed
        self.scores = {p: (i, round((s - norm) * SCALE)) for p, (i, s) in scores.items()}
        self.byte_score = round((-math.log(len(self.pieces) + 2.7) - norm - 3.0) * SCALE)
        self.longest = max((len(p) for p in self.scores), default=1)
        self.pairs = {p[j:j + 2] for p in self.scores for j in range(len(p) - 1)}
        self.raw = [p.replace(SPACE, " ").encode() if n else b"" for p, n in zip(self.pieces, self.normal, strict=True)]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a vocabulary file on the driver; the operators broadcast it (its size is fixed)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte_ids = [-1] * 256
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
    special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], [not s for s in special], byte_ids)


class StreamingViterbi:
    """Feed characters, take the ids that are final. ``held`` is the number of characters whose
    segmentation is still open."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.text, self.best, self.back, self.ids = "", [0], [0], [()]
        self.test_at = TEST_EVERY

    @property
    def held(self) -> int:
        return len(self.text)

    def feed(self, chars: str) -> list[int]:
        get, longest, byte_score = self.v.scores.get, self.v.longest, self.v.byte_score
        out: list[int] = []
        for start in range(0, len(chars), TEST_EVERY):
            i = len(self.text)
            self.text += chars[start:start + TEST_EVERY]
            text, best, back, ids = self.text, self.best, self.back, self.ids
            while i < len(text):
                i += 1
                top, frm, tok = -math.inf, i - 1, ()
                for j in range(i - longest if i > longest else 0, i):
                    p = get(text[j:i])
                    if p is not None and best[j] + p[1] > top:
                        top, frm, tok = best[j] + p[1], j, (p[0],)
                if text[i - 1:i] not in self.v.scores:
                    c = text[i - 1]
                    raw = SPACE.encode() if c == LITERAL else c.encode("utf-8", "replace")
                    score = best[i - 1] + byte_score * len(raw)
                    if score > top:
                        top, frm, tok = score, i - 1, tuple(self.v.byte_ids[b] for b in raw)
                best.append(top)
                back.append(frm)
                ids.append(tok)
            if len(self.text) >= self.test_at:
                out += self._commit()
                self.test_at = len(self.text) + TEST_EVERY
        return out

    def _commit(self) -> list[int]:
        """Give out what all surviving paths share."""
        n = len(self.text)
        alive = set(range(max(0, n - self.v.longest + 1), n + 1))
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(self.back[top])
        cut = alive.pop()
        if cut == 0:
            return []
        out = self._path(cut)
        base = self.best[cut]
        self.text = self.text[cut:]
        self.best = [b - base for b in self.best[cut:]]
        self.back = [max(0, b - cut) for b in self.back[cut:]]
        self.ids = self.ids[cut:]
        return out

    def _path(self, end: int) -> list[int]:
        parts = []
        while end > 0:
            parts.append(self.ids[end])
            end = self.back[end]
        return [i for part in reversed(parts) for i in part]

    def finish(self) -> list[int]:
        out = self._path(len(self.text))
        self.text, self.best, self.back, self.ids, self.test_at = "", [0], [0], [()], TEST_EVERY
        return out


class Lanes:
    """The same recurrence for many short runs side by side: a step takes one start position of
    all runs that are long enough, and follows the pieces' prefix tree from there, one character
    at a time, with those runs alone whose characters are still a prefix of some piece. Starts
    come in order and only a better sum replaces another, so ties fall as in the stream."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        node, child = {"": 0}, []
        for p in vocab.scores:
            for j in range(1, len(p) + 1):
                if p[:j] not in node:
                    node[p[:j]] = len(node)
                    child.append((node[p[:j - 1]], ord(p[j - 1]), node[p[:j]]))
        self.piece = np.full(len(node), -1, dtype=np.int32)
        self.score = np.zeros(len(node), dtype=np.int64)
        for p, (i, sc) in vocab.scores.items():
            self.piece[node[p]], self.score[node[p]] = i, sc
        self.first = np.zeros(0x110000, dtype=np.int32)  # child of the root
        deep = [c for c in child if c[0]]
        for _, c, k in (c for c in child if not c[0]):
            self.first[c] = k
        key = np.array([(p << 21) | c for p, c, _ in deep], dtype=np.uint64)
        self.key = np.zeros(len(node), dtype=np.uint64)
        left = np.array([k for _, _, k in deep], dtype=np.int64)
        self.key[left] = key
        self.tables = []
        shift = 44
        while len(left):  # what collides in one table goes to the next
            table = np.zeros(1 << 20, dtype=np.int32)
            _, one = np.unique(self._slot(self.key[left], shift), return_index=True)
            table[self._slot(self.key[left[one]], shift)] = left[one]
            self.tables.append((table, shift))
            left = np.delete(left, one)
            shift -= 11

    @staticmethod
    def _slot(key, shift):
        h = key * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(shift)) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def _child(self, node, cp):
        key = (node.astype(np.uint64) << np.uint64(21)) | cp
        out = np.zeros(len(node), dtype=np.int32)
        for table, shift in self.tables:
            c = table[self._slot(key, shift)]
            hit = self.key[c] == key
            out[hit] = c[hit]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of "▁" + word as little-endian int32 bytes."""
        n = len(words)
        lens = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=n)
        cps = np.frombuffer("".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        start = np.zeros(n, dtype=np.int64)
        np.cumsum(lens[:-1], out=start[1:])
        order = np.argsort(-lens, kind="stable")
        start, size = start[order], lens[order]
        most = int(size[0])
        best = np.full((most + 1, n), np.iinfo(np.int64).min // 2, dtype=np.int64)
        best[0] = 0
        back = np.zeros((most + 1, n), dtype=np.int8)
        tok = np.full((most + 1, n), -1, dtype=np.int32)
        width = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4)))
        for j in range(most):
            a = int(np.searchsorted(-size, -(j + 1), side="right"))
            lane, at = np.arange(a), start[:a] + j
            from_here = best[j]
            node = self.first[cps[at]]
            length = 1
            while True:
                ok = self.piece[node] >= 0
                ok &= node > 0
                k, nd = lane[ok], node[ok]
                got = from_here[k] + self.score[nd]
                up = got > best[j + length, k]
                k = k[up]
                best[j + length, k], back[j + length, k], tok[j + length, k] = got[up], length, self.piece[nd[up]]
                if length == 1:  # characters that are no piece: their bytes
                    k = lane[~ok]
                    got = from_here[k] + self.v.byte_score * width[at[~ok]]
                    up = got > best[j + 1, k]
                    k = k[up]
                    best[j + 1, k], back[j + 1, k], tok[j + 1, k] = got[up], 1, -1
                length += 1
                go = (node > 0) & (size[lane] >= j + length)
                lane, node = lane[go], node[go]
                if not len(lane) or length > self.v.longest:
                    break
                node = self._child(node, cps[start[lane] + j + length - 1])
                live = node > 0
                lane, node = lane[live], node[live]
                if not len(lane):
                    break
        # back along the pointers, all runs together
        at, live, lanes, ids, ends = size.copy(), np.arange(n), [], [], []
        while len(live):
            i = at[live]
            lanes.append(live)
            ids.append(tok[i, live])
            ends.append(start[live] + i - 1)
            at[live] = i - back[i, live]
            live = live[at[live] > 0]
        step = np.repeat(np.arange(len(lanes)), [len(x) for x in lanes])
        lane, tid, end = order[np.concatenate(lanes)], np.concatenate(ids), np.concatenate(ends)
        o = np.lexsort((-step, lane))
        lane, tid, end = lane[o], tid[o], end[o]
        raw = tid < 0
        if raw.any():
            times = np.where(raw, width[end], 1)
            first = np.cumsum(times) - times
            flat = np.repeat(tid, times)
            for f, c in zip(first[raw].tolist(), cps[end[raw]].tolist(), strict=True):
                b = (SPACE if c == ord(LITERAL) else chr(c)).encode("utf-8", "replace")
                flat[f:f + len(b)] = [self.v.byte_ids[x] for x in b]
            lane, tid = np.repeat(lane, times), flat
        cut = (4 * np.searchsorted(lane, np.arange(n + 1))).tolist()
        buf = tid.astype("<i4").tobytes()
        return [buf[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


class Encoder:
    """Encodes texts to little-endian int32 bytes, with a bounded memo of short runs."""

    def __init__(self, vocab: Vocabulary):
        self.v, self.lanes = vocab, Lanes(vocab)
        self.words: dict[str, bytes] = {}
        self.stream = StreamingViterbi(vocab)

    def _run(self, run: str) -> bytes:
        pairs, out, last = self.v.pairs, [], 0
        for j in range(1, len(run)):
            if run[j - 1:j + 1] not in pairs:  # no piece spans this place: all paths meet here
                out += self.stream.feed(run[last:j])
                out += self.stream.finish()
                last = j
        out += self.stream.feed(run[last:])
        out += self.stream.finish()
        return np.array(out, dtype="<i4").tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Make sure that the memo has all short words; returns the long ones' ids."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > MEMO:
            self.words = {w: self.words[w] for w in words if w in self.words}
        short = [w for w in new if len(w) <= MEMO_LENGTH]
        for k in range(0, len(short), LANES):
            part = short[k:k + LANES]
            self.words.update(zip(part, self.lanes.encode(part), strict=True))
        return {w: self._run(SPACE + w) for w in new if len(w) > MEMO_LENGTH}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [(t.replace(SPACE, LITERAL) if SPACE in t else t).split(" ") if t else [] for t in texts]
        long = self._learn(set().union(*split))
        memo = self.words
        get = memo.__getitem__ if not long else lambda w: memo[w] if w in memo else long[w]
        out = []
        for words in split:
            if "" not in words:
                out.append(b"".join(map(get, words)))
                continue
            # runs of spaces: a piece may hold several, so they stay with the next word
            joined, lead = [], ""
            for k, w in enumerate(words):
                if w == "" and k < len(words) - 1:
                    lead += SPACE
                else:
                    joined.append(get(w) if not lead else self._run(lead + SPACE + w))
                    lead = ""
            out.append(b"".join(joined))
        return out


def decode_ids(vocab: Vocabulary, ids) -> str:
    raw = b"".join(map(vocab.raw.__getitem__, ids))
    return raw[1:].decode("utf-8", "replace") if raw else ""


_KEPT: dict = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process, so that its memo lasts over tasks."""
    if _KEPT.get("id") != shared.id:
        _KEPT.clear()
        _KEPT.update(id=shared.id, encoder=Encoder(Vocabulary(*shared.value)))
    return _KEPT["encoder"]


class _Shared:
    def __init__(self, broadcast, key):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def share(spark, vocab: Vocabulary) -> _Shared:
    import uuid

    return _Shared(spark.sparkContext.broadcast((vocab.pieces, vocab.normal, vocab.byte_ids)), uuid.uuid4().hex)


def encode(df: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids", count: str = "n_tokens",
           check: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (by default all but the text) with the ids of the text, their number and,
    if ``check`` is named, whether decoding gives the text back."""
    import pyarrow as pa

    spark = spark_of(df)
    shared = share(spark, load_vocabulary(model))
    keep = [c for c in df.columns if c != text] if keep is None else keep
    src = df.select(*[df[c] for c in keep], F.coalesce(df[text].cast("string"), F.lit("")).alias("_piece_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    schema = ", ".join([*kinds, f"`{count}` int", f"`{ids}` array<int>", *([f"`{check}` boolean"] if check else [])])

    def run(batches):
        enc = _encoder(shared)
        for batch in batches:
            texts = batch.column(len(keep))
            n, step = batch.num_rows, 1024
            for i in range(0, n, step):
                part = texts.slice(i, min(step, n - i)).to_pylist()
                got = enc.encode_all(part)
                lens = np.array([len(g) // 4 for g in got], dtype=np.int32)
                flat = np.frombuffer(b"".join(got), dtype="<i4")
                off = np.zeros(len(part) + 1, dtype=np.int32)
                np.cumsum(lens, out=off[1:])
                cols = [batch.column(c).slice(i, len(part)) for c in range(len(keep))]
                cols += [pa.array(lens), pa.ListArray.from_arrays(pa.array(off), pa.array(flat, type=pa.int32()))]
                if check:
                    cols.append(pa.array([decode_ids(enc.v, flat[a:b].tolist()) == t
                                          for t, a, b in zip(part, off[:-1], off[1:], strict=True)]))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, count, ids, *([check] if check else [])])

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL, out: str = "text") -> DataFrame:
    """``df`` with the ids replaced by the text they stand for (null ids: "")."""
    import pyarrow as pa

    spark = spark_of(df)
    shared = share(spark, load_vocabulary(model))
    keep = [c for c in df.columns if c not in (ids, out)]
    src = df.select(*[df[c] for c in keep], df[ids].alias("_piece_ids"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]

    def run(batches):
        v = _encoder(shared).v
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [decode_ids(v, x or []) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], pa.array(texts, type=pa.string())],
                                                 names=[*keep, out])

    return src.mapInArrow(run, ", ".join([*kinds, f"`{out}` string"]))
