"""Operator 1: toxicity by a linear-chain conditional random field.

Labels exist for documents, the field needs them for tokens. Words are counted in all labelled
training documents (Spark aggregation); a word is offending when a likelihood ratio test ties it to toxic
documents. Tokens of toxic documents that are offending words are labelled so, all others not.

The field has two states (clean, offending). A token's potential is a sum of weights of features of its
normal form (whole form, prefixes, suffixes), transitions are a 2x2 table.
It is fitted by maximum likelihood on windows of labelled documents, of which at most
``MAX_WINDOWS`` are taken in the order of a hash. Forward-backward gives each token's marginal in every
whole text: long texts are cut into blocks whose 2x2 products are formed side by side and chained, which is
exact. A logistic function of sums and maxima of the marginals, fitted on at most
``MAX_CALIBRATION`` (about) labelled training documents, those with the smallest hashes, is the score. Tokens with a marginal of 0.5 or more are
given as character offsets.

Defined results: null and empty texts have no tokens and get the score of a text without
offending tokens; without any labelled toxic document the score is 0 for all; ids with a null are never
training rows; repeated rows repeat; labels of one id that disagree count as the larger one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpengine.llm.common import crc_mod, discard, free_shuffles, spark_of, stage

MAX_WINDOWS = 16_000
MAX_CALIBRATION = 20_000
WINDOW = 24
WINDOWS_PER_DOCUMENT = 4
BLOCK = 64
#: least likelihood ratio of an offending word
MIN_G2 = 16.0
MEMO = 700_000
LEET = str.maketrans("013457@$!", "oieastasi")
STRIP = "\"'`.,;:!?()[]{}<>*#%&$-_=+/\\|~^«»„“”‚‘’…¡¿"
_INNER = re.compile(r"[\W_]+")


def normal_form(token: str) -> str:
    """Lower case, without marks at the ends; digits that stand for letters inside a word and
    marks between its letters are undone."""
    t = token.lower().strip(STRIP)
    if not t:
        return token[:24]
    if not t.isalpha() and any(c.isalpha() for c in t):
        t = _INNER.sub("", t.translate(LEET)) or t
    return t


def features(form: str) -> list[str]:
    """Names of a form's features: the whole, its prefixes and its suffixes."""
    n = min(len(form), 5)
    return ["=" + form, *["^" + form[:k] for k in range(2, n + 1)], *["$" + form[-k:] for k in range(2, n + 1)]]


@dataclass
class Crf:
    weights: dict[str, float]  # only features of the windows have any
    trans: np.ndarray  # potentials, 2x2; the state before the first token is clean
    calibration: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0, 0.0]))


def fit_crf(windows: list[list[str]], labels: list[list[int]], rounds: int = 70, l2: float = 2e-6) -> Crf:
    """Maximum likelihood by Adam on all windows at once; bounded by MAX_WINDOWS * WINDOW tokens."""
    index: dict[str, int] = {}
    n, most = len(windows), max(map(len, windows))
    tok = np.zeros((most, n), dtype=np.int64)
    lab = np.zeros((most, n))
    mask = np.zeros((most, n), dtype=bool)
    for k, (w, y) in enumerate(zip(windows, labels, strict=True)):
        for i, (t, v) in enumerate(zip(w, y, strict=True)):
            tok[i, k] = index.setdefault(t, len(index))
            lab[i, k], mask[i, k] = v, True
    names: dict[str, int] = {}
    feats = [[names.setdefault(x, len(names)) for x in features(f)] for f in index]
    flat, dim = np.concatenate([np.array(f) for f in feats]), len(names)
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    theta, tr = np.zeros(dim), np.zeros((2, 2))
    m1, m2 = np.zeros(dim + 4), np.zeros(dim + 4)
    y = lab.astype(np.int64)
    prev = np.vstack([np.zeros((1, n), dtype=np.int64), y[:-1]])
    seen = np.array([[np.sum(mask & (prev == a) & (y == b)) for b in (0, 1)] for a in (0, 1)], dtype=float)
    tokens = mask.sum()
    for step in range(1, rounds + 1):
        e = np.bincount(owner, weights=theta[flat], minlength=len(feats))[tok]
        ex = np.exp(np.clip(e, -30, 30))
        t = np.exp(tr)
        alpha = np.zeros((most, n, 2))
        beta = np.ones((most, n, 2))
        a = np.stack([np.ones(n), np.zeros(n)], axis=1)
        for i in range(most):
            nxt = a @ t
            nxt[:, 1] *= ex[i]
            nxt /= nxt.sum(axis=1, keepdims=True)
            a = np.where(mask[i][:, None], nxt, a)
            alpha[i] = a
        b = np.ones((n, 2))
        for i in range(most - 1, 0, -1):
            pre = b.copy()
            pre[:, 1] *= ex[i]
            pre = pre @ t.T
            pre /= pre.sum(axis=1, keepdims=True)
            b = np.where(mask[i][:, None], pre, b)
            beta[i - 1] = b
        post = alpha * beta
        p = (post[..., 1] / post.sum(axis=2)) * mask
        pa = np.concatenate([np.broadcast_to([1.0, 0.0], (1, n, 2)), alpha[:-1]])
        edge = {(u, v): pa[..., u] * (t[u, v] * beta[..., v] * (ex if v else 1.0)) for u in (0, 1) for v in (0, 1)}
        scale = mask / sum(edge.values())
        want = np.array([[(edge[u, v] * scale).sum() for v in (0, 1)] for u in (0, 1)])
        per_type = np.bincount(tok.ravel(), weights=((p - lab) * mask).ravel(), minlength=len(feats))
        g = np.bincount(flat, weights=per_type[owner], minlength=dim) / tokens + l2 * theta
        grad = np.concatenate([g, ((want - seen) / tokens).ravel()])
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        move = 0.2 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-7)
        theta -= move[:dim]
        tr -= move[dim:].reshape(2, 2)
    return Crf({x: float(theta[k]) for x, k in names.items() if abs(theta[k]) >= 0.01}, tr)


def marginals(e: np.ndarray, off: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Forward-backward for many chains laid end to end (chain k is e[off[k]:off[k+1]]).

    Blocks of BLOCK tokens are lanes. Their 2x2 products are formed in step, chained over the blocks of
    each chain from both ends, and then the messages inside the blocks follow, again in step."""
    if not len(e):
        return np.zeros(0)
    t = np.exp(trans)
    ex = np.exp(np.clip(e, -25, 25))
    lens = np.diff(off)
    nb = -(-lens // BLOCK)
    chain = np.repeat(np.arange(len(lens)), nb)
    rank = np.arange(len(chain)) - np.repeat(np.cumsum(nb) - nb, nb)
    start = off[:-1][chain] + rank * BLOCK
    size = np.minimum(BLOCK, off[1:][chain] - start)
    order = np.argsort(-size, kind="stable")
    st, sz = start[order], size[order]
    active = [int(np.searchsorted(-sz, -(i + 1), side="right")) for i in range(int(sz[0]))]
    m = np.tile(np.eye(2), (len(st), 1, 1))
    for i, a in enumerate(active):
        x = m[:a] @ t
        x[:, :, 1] *= ex[st[:a] + i][:, None]
        x /= x.sum(axis=(1, 2))[:, None, None]
        m[:a] = x
    prod = np.empty_like(m)
    prod[order] = m
    # over the blocks of each chain: all chains in step, longest first
    into = np.zeros((len(chain), 2))
    out = np.ones((len(chain), 2))
    by = np.argsort(-nb, kind="stable")
    first = (np.cumsum(nb) - nb)[by]
    nbs = nb[by]
    a = np.tile([1.0, 0.0], (len(by), 1))
    for r in range(int(nbs[0])):
        k = int(np.searchsorted(-nbs, -(r + 1), side="right"))
        at = first[:k] + r
        into[at] = a[:k]
        a[:k] = np.einsum("ki,kij->kj", a[:k], prod[at])
        a[:k] /= a[:k].sum(axis=1, keepdims=True)
    b = np.ones((len(by), 2))
    for r in range(int(nbs[0])):
        k = int(np.searchsorted(-nbs, -(r + 1), side="right"))
        at = first[:k] + nbs[:k] - 1 - r
        out[at] = b[:k]
        b[:k] = np.einsum("kij,kj->ki", prod[at], b[:k])
        b[:k] /= b[:k].sum(axis=1, keepdims=True)
    # inside the blocks, as odds of the two states
    odds = np.empty(len(e))
    with np.errstate(divide="ignore"):
        r = (into[:, 1] / np.maximum(into[:, 0], 1e-300))[order]
        s = (out[:, 1] / np.maximum(out[:, 0], 1e-300))[order]
    for i, k in enumerate(active):
        at = st[:k] + i
        r[:k] = ex[at] * (t[0, 1] + t[1, 1] * r[:k]) / (t[0, 0] + t[1, 0] * r[:k])
        odds[at] = r[:k]
    for j in range(len(active)):  # from each block's own last token backwards
        k = int(np.searchsorted(-sz, -(j + 1), side="right"))
        at = st[:k] + sz[:k] - 1 - j
        odds[at] *= s[:k]
        y = ex[at] * s[:k]
        s[:k] = (t[1, 0] + t[1, 1] * y) / (t[0, 0] + t[0, 1] * y)
    return odds / (1.0 + odds)


class Scorer:
    """Marginals and document features of texts; emissions of words are kept in a bounded memo."""

    def __init__(self, crf: Crf):
        self.crf = crf
        by = {k: {x[1:]: v for x, v in crf.weights.items() if x[0] == k} for k in "=^$"}
        whole, pre, suf = by["="].get, by["^"].get, by["$"].get

        class Memo(dict):
            def __missing__(memo, word):  # noqa: N805
                f = normal_form(word)
                v = whole(f, 0.0)
                for k in range(2, min(len(f), 5) + 1):
                    v += pre(f[:k], 0.0) + suf(f[-k:], 0.0)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[word] = v
                return v

        self.memo = Memo()

    def texts(self, texts: list[str]):
        """Per text: features (4 numbers), number of tokens, spans of offending tokens."""
        words = [t.split() for t in texts]
        off = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(w) for w in words], out=off[1:])
        e = np.empty(int(off[-1]))
        for w, a, b in zip(words, off[:-1].tolist(), off[1:].tolist(), strict=True):
            e[a:b] = list(map(self.memo.__getitem__, w))
        p = marginals(e, off, self.crf.trans)
        x = np.zeros((len(texts), 4))
        x[:, 0], x[:, 1] = 1.0, -6.0
        full = np.flatnonzero(np.diff(off))
        if len(full):
            cut = off[:-1][full]
            top = np.clip(np.maximum.reduceat(p, cut), 1e-6, 1 - 1e-6)
            x[full, 1] = np.clip(np.log(top / (1 - top)), -6, 6)
            x[full, 2] = np.log1p(np.add.reduceat(p, cut))
            x[full, 3] = np.log1p(np.diff(off)[full]) / 10
        spans: list[list[dict]] = [[] for _ in texts]
        hit = np.flatnonzero(p >= 0.5)
        if len(hit):
            row = np.searchsorted(off, hit, side="right") - 1
            for k in np.unique(row).tolist():
                want = set((hit[row == k] - off[k]).tolist())
                spans[k] = [{"start": m.start(), "end": m.end()} for i, m in enumerate(re.finditer(r"\S+", texts[k])) if i in want]
        return x, np.diff(off), spans


def _word_counts(batches):
    """(word, toxic documents, clean documents) of a task; flushed before the table grows large."""
    import pyarrow as pa

    def rows(tox, clean):
        words = list(tox.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array([tox.get(w, 0) for w in words], type=pa.int64()),
                                           pa.array([clean.get(w, 0) for w in words], type=pa.int64())], names=["word", "tox", "clean"])

    tox, clean, forms = Counter(), Counter(), {}
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = set()
            for w in set((text or "").split()):
                f = forms.get(w)
                if f is None:
                    f = forms[w] = normal_form(w)
                seen.add(f)
            (tox if y else clean).update(seen)
            if len(forms) > 400_000:
                forms.clear()
            if len(tox) + len(clean) > 400_000:
                yield rows(tox, clean)
                tox, clean = Counter(), Counter()
    if tox or clean:
        yield rows(tox, clean)


def offending_words(train: DataFrame) -> list[str]:
    """Words tied to toxic documents. ``train``: text, toxic (0 or 1)."""
    counts = train.select("text", "toxic").mapInArrow(_word_counts, "word string, tox long, clean long") \
        .groupBy("word").agg(F.sum("tox").alias("t"), F.sum("clean").alias("c"))
    n = train.groupBy("toxic").count().collect()
    total = {r["toxic"]: r["count"] for r in n}
    nt, nc = total.get(1, 0), total.get(0, 0)
    if not nt or not nc:
        return []
    share = F.lit(nt / (nt + nc))
    k = F.col("t") + F.col("c")
    g2 = 2 * (F.col("t") * F.log(F.col("t") / (k * share))
              + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (k * (1 - share)))).otherwise(0.0))
    purity = (F.col("t") / nt) / ((F.col("c") + 0.5) / nc)
    few = counts.where((F.col("t") >= 3) & (purity >= 10)).withColumn("g2", g2).where(F.col("g2") >= MIN_G2)
    return [r["word"] for r in few.orderBy(F.desc("g2"), "word").collect()]


def _windows(words: frozenset):
    """Windows of labelled documents: some around offending words, one at a place given by a hash."""
    import zlib

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for doc, text, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                forms = [normal_form(w) for w in (text or "").split()]
                if not forms:
                    continue
                at = [i for i, f in enumerate(forms) if f in words]
                at.sort(key=lambda i: zlib.crc32(f"{doc}|{i}".encode()))
                places = at[:WINDOWS_PER_DOCUMENT - 1] + [zlib.crc32(f"{doc}|w".encode()) % len(forms)]
                for q, c in enumerate(places):
                    a = max(0, c - zlib.crc32(f"{doc}|{q}|s".encode()) % WINDOW)
                    part = forms[a:a + WINDOW]
                    out.append((zlib.crc32(f"{doc}|{q}|o".encode()), " ".join(f[:60].replace(" ", "_") for f in part),
                                "".join("1" if y and f in words else "0" for f in part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=kind) for i, kind in
                                                  enumerate((pa.int64(), pa.string(), pa.string()))], names=["o", "words", "labels"])
    return run


def fit(train: DataFrame) -> Crf | None:
    """``train``: doc_id, text, toxic. None if there is nothing to learn from."""
    train = stage(train.select("doc_id", "text", "toxic"), "tox-train")
    free_shuffles(train.sparkSession)
    words = frozenset(offending_words(train))
    if not words:
        discard(train)
        return None
    win = train.mapInArrow(_windows(words), "o long, words string, labels string")
    got = win.orderBy("o", "words", "labels").limit(MAX_WINDOWS).collect()
    crf = fit_crf([r["words"].split(" ") for r in got], [[int(c) for c in r["labels"]] for r in got])
    # calibration: document features of a bounded part of the training rows, in the order of a hash
    share = min(1.0, MAX_CALIBRATION / max(train.count(), 1))
    rows = train.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(1_000_003)) < share * 1_000_003)

    def feats(batches):
        import pyarrow as pa
        s = Scorer(crf)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                x, _, _ = s.texts([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[pa.array(x[:, c]) for c in range(4)], b.column(2)], names=["x0", "x1", "x2", "x3", "y"])

    xy = rows.mapInArrow(feats, "x0 double, x1 double, x2 double, x3 double, y int").toPandas() \
        .sort_values(["x1", "x2", "x3", "y"]).to_numpy(dtype=np.float64)
    discard(train)
    x, y = xy[:, :4], xy[:, 4]
    w = np.zeros(4)
    ridge = np.diag([1e-4, 1e-2, 1e-2, 1e-2]) * max(1.0, len(y) / 100)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    crf.calibration = w
    return crf


SPANS = "array<struct<start:int,end:int>>"


def score(docs: DataFrame, crf: Crf | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_tokens, spans): the score is a pure function of the text."""
    spark = spark_of(docs)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    if crf is None:
        return src.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_tokens"), F.expr(f"cast(array() as {SPANS})").alias("spans"))
    shared = spark.sparkContext.broadcast((crf.weights, crf.trans, crf.calibration))

    def run(batches):
        import pyarrow as pa
        model = Crf(*shared.value)
        s = Scorer(model)
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                x, n, spans = s.texts(b.column(1).to_pylist())
                p = 1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(n.astype(np.int64)), pa.array(spans, type=spans_type)],
                                                 names=["doc_id", "score", "n_tokens", "spans"])

    return src.mapInArrow(run, f"doc_id {kind}, score double, n_tokens long, spans {SPANS}")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents outside the held-out fold (crc32 of the id modulo 5 is 0)."""
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # by shuffle at every size: the labels grow with the documents
    return docs.where(crc_mod("doc_id", 5) > 0).select("doc_id", "text").join(y.hint("merge"), "doc_id")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that the field scores at 0.5 or more; columns unchanged. The score is a function of the text alone, so rows are
    judged where they are read: no join and no shuffle of texts."""
    spark = spark_of(docs)
    crf = fit(training_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels))
    if crf is None:
        return docs
    shared = spark.sparkContext.broadcast((crf.weights, crf.trans, crf.calibration))

    def run(batches):
        import pyarrow as pa
        model = Crf(*shared.value)
        s = Scorer(model)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                x, _, _ = s.texts([t or "" for t in b.column(at).to_pylist()])
                bad = 1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30))) >= 0.5
                yield b.filter(pa.array(~bad))

    return docs.mapInArrow(run, docs.schema)
