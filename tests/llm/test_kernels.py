"""Plain-Python checks of the kernels against brute force."""
import itertools
import random

import numpy as np

from fpengine.llm import pages, pieces, suffixes, toxicity, winnowing
from fpengine.llm import mixing_lm as lm


def test_streaming_viterbi_equals_full_table_and_round_trips():
    v = pieces.load_vocabulary()
    e = pieces.Encoder(v)

    def full(run):
        n = len(run)
        best, back, tok = [0] + [-10 ** 18] * n, [0] * (n + 1), [()] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - v.longest), i):
                p = v.scores.get(run[j:i])
                if p and best[j] + p[1] > best[i]:
                    best[i], back[i], tok[i] = best[j] + p[1], j, (p[0],)
            if run[i - 1] not in v.scores:
                raw = pieces.SPACE.encode() if run[i - 1] == pieces.LITERAL else run[i - 1].encode()
                if best[i - 1] + v.byte_score * len(raw) > best[i]:
                    best[i], back[i], tok[i] = best[i - 1] + v.byte_score * len(raw), i - 1, tuple(v.byte_ids[b] for b in raw)
        out, i = [], n
        while i > 0:
            out.append(tok[i])
            i = back[i]
        return [x for t in reversed(out) for x in t]

    rnd = random.Random(1)
    texts = ["", " ", "a", "x" * 3000, "▁ ▁", "  two  spaces "] + \
        ["".join(rnd.choice("abcdetion  é▁\n\r;){0x1😀ß") for _ in range(rnd.randint(0, 200))) for _ in range(150)]
    for t in texts:
        ids = np.frombuffer(e.encode(t), "<i4").tolist()
        assert pieces.decode_ids(v, ids) == t
        if t:
            run = pieces.SPACE + t.replace(pieces.SPACE, pieces.LITERAL).replace(" ", pieces.SPACE)
            assert full(run) == ids
            s, out = pieces.StreamingViterbi(v), []
            for ch in run:
                out += s.feed(ch)
            assert out + s.finish() == ids


def test_stream_holds_a_bounded_window():
    s = pieces.StreamingViterbi(pieces.load_vocabulary())
    held = 0
    for _ in range(5000):
        s.feed("x1y2")
        held = max(held, s.held)
    assert held < 400


def test_forward_backward_marginals():
    rng = np.random.default_rng(0)
    tr, e, off = rng.normal(size=(2, 2)), rng.normal(size=300) * 2, np.array([0, 0, 5, 12, 12, 300])
    p = toxicity.marginals(e, off, tr)

    def brute(e):
        z, m = 0.0, np.zeros(len(e))
        for ys in itertools.product((0, 1), repeat=len(e)):
            s, prev = 0.0, 0
            for y, x in zip(ys, e):
                s += tr[prev, y] + y * x
                prev = y
            z += np.exp(s)
            m += np.exp(s) * np.array(ys)
        return m / z

    assert np.allclose(p[:5], brute(e[:5])) and np.allclose(p[5:12], brute(e[5:12]))
    old, toxicity.BLOCK = toxicity.BLOCK, 7
    try:
        assert np.allclose(toxicity.marginals(e, off, tr), p)
    finally:
        toxicity.BLOCK = old
    assert len(toxicity.marginals(np.zeros(0), np.array([0, 0]), tr)) == 0


def test_winnowing_rightmost_minimum_and_guarantee():
    rnd = random.Random(2)
    for _ in range(200):
        t = "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 60)))
        h, p = winnowing.winnow(t, 4, 5)
        if len(t) < 4:
            assert len(h) == (1 if t else 0)
            continue
        hs = [winnowing.winnow(t[i:i + 4], 4, 1)[0][0] for i in range(len(t) - 3)]
        w, want = min(5, len(hs)), []
        for i in range(len(hs) - w + 1):
            low = min(hs[i:i + w])
            j = max(q for q in range(i, i + w) if hs[q] == low)
            if not want or want[-1] != j:
                want.append(j)
        assert want == p.tolist() and [hs[j] for j in want] == h.tolist()
    shared = "".join(rnd.choice("abcdefgh") for _ in range(8))  # w + k - 1
    a, b = winnowing.winnow("xyz" * 5 + shared + "q" * 9, 4, 5)[0], winnowing.winnow("uvw" * 7 + shared + "rst", 4, 5)[0]
    assert set(a.tolist()) & set(b.tolist())
    assert winnowing.likeness(a[:0], a[:0]) == 1.0 and winnowing.likeness(a, a[:0]) == 0.0


def test_page_lines_and_differencing():
    page = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav>Menu</nav><div class="cookie-notice">C</div>'
            '<article><header><h1>A &amp; B</h1></header><p>One<br>two<p>th<b>re</b>e<div class="comments"><p>reader</p></div></article>'
            '<footer>F</footer></body></html>')
    assert pages.main_text(pages.page_lines(page), None) == "A & B One two three"
    assert pages.page_lines("") == [] and pages.main_text([], None) == ""
    a = pages.page_lines("<div>Site name</div><p>first text</p><div>Imprint</div>")
    b = pages.page_lines("<div>Site name</div><p>other text</p><div>Imprint</div>")
    assert pages.main_text(a, b) == "first text"
    rnd = random.Random(3)
    for _ in range(100):
        x, y = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        assert len(pages.shared_lines(x, y)) == t[-1][-1]


def test_runs_cover_every_window_once():
    rnd = random.Random(4)
    texts = [bytes(rnd.choice(b"abc ") for _ in range(n)) for n in (0, 10, 49, 50, 51, 400)]
    off = np.cumsum([0] + [len(t) for t in texts])
    row, a, c, _, _ = suffixes.runs_of(np.frombuffer(b"".join(texts), dtype=np.uint8), off)
    got = sorted((int(r), s) for r, s0, n in zip(row, a, c & 63) for s in range(int(s0), int(s0 + n)))
    assert got == [(r, s) for r, t in enumerate(texts) for s in range(len(t) - 49)]


def test_huffman_code_is_a_distribution_and_mixer_learns():
    code = lm.Code(np.array([5, 1, 1, 9, 2]))
    assert abs(sum(2.0 ** -(code.start[k + 1] - code.start[k]) for k in range(5)) - 1) < 1e-12
    rng = np.random.default_rng(5)
    bit = (rng.random(20_000) < 0.9).astype(np.uint8)
    st = np.stack([np.zeros(len(bit)), np.full(len(bit), 0.3)]).astype(np.float32)
    gate, lane, block = np.zeros(len(bit), dtype=np.int64), np.zeros(len(bit), dtype=np.int64), np.arange(len(bit)) // 200
    even = lm.Mixer(1).run(st, gate, bit, lane, block, 1, rate=0.0, refine=0.0)[0]
    learnt = lm.Mixer(1).run(st, gate, bit, lane, block, 1)[0]
    assert learnt > 0.6 * even
    assert lm.words_of("A\x0bÄ b c\n") == ["a".encode(), "Ä".encode(), "b c".encode()]


def test_windows_meet_once():
    """Windows settled inside tasks and the open ones, sorted over several batches, mark exactly what a smaller document has too."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, length = 400, 5
    w, doc, a = rng.integers(0, 60, n), rng.integers(0, 12, n), 10 * np.arange(n)
    th = np.zeros(n, dtype=np.int64)
    low = {}
    for x, d in zip(w.tolist(), doc.tolist()):
        low[x] = min(low.get(x, d), d)
    want = {(d, s) for x, d, s in zip(w.tolist(), doc.tolist(), a.tolist()) if low[x] < d}
    sent = [b for part in np.array_split(np.arange(n), 4) for b in suffixes._lowest([(w[part], doc[part], th[part], a[part])], length)]
    t = pa.Table.from_batches(sent)
    assert 0 < sum(b > 0 for b in t["b"].to_pylist()) and t.num_rows == n
    t = t.sort_by([("w", "ascending"), ("doc", "ascending")]).combine_chunks()
    got = [b for b in suffixes._marked(length)(t.to_batches(max_chunksize=7))]
    rows = [r for b in got for r in b.to_pylist()]
    assert {(r["doc"], r["a"]) for r in rows} == want and all(r["b"] == r["a"] + length for r in rows) and len(rows) == len(want)


def test_only_windows_near_another_document_are_expanded():
    """All equal windows of different documents are settled or expanded; those that agree on a part of a window alone are not."""
    import pyarrow as pa

    rnd = random.Random(8)
    word = lambda n: bytes(rnd.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = [word(33) for _ in range(40)]  # too short for a window
    long = [word(70) for _ in range(5)]
    texts = [b"".join(word(rnd.randint(10, 60)) + rnd.choice(shared + long) for _ in range(20)) for _ in range(60)]
    off = np.cumsum([0] + [len(t) for t in texts])
    row, a, c, g, f = suffixes.runs_of(np.frombuffer(b"".join(texts), dtype=np.uint8), off)
    f = (f & np.uint64((1 << suffixes._FBITS) - 1)).astype(np.int64) << 1
    o = np.argsort(g.view(np.int64), kind="stable")
    t = suffixes._rows(suffixes.OPEN, g.view(np.int64)[o], f[o], row[o], row[o] * 0, a[o], c[o])
    got, n = set(), 0
    for b in suffixes._settle(50, 12)(pa.Table.from_batches([t]).to_batches(max_chunksize=500)):
        for r in b.to_pylist():
            starts = range(r["a"], r["a"] + r["b"]) if r["kind"] == suffixes.EXPAND else range(r["a"], r["b"] - 49)
            n += len(starts) if r["kind"] == suffixes.EXPAND else 0
            got |= {(r["doc"], i) for i in starts}
    low, twice = {}, set()
    for d, x in enumerate(texts):
        for i in range(len(x) - 49):
            if low.setdefault(x[i:i + 50], d) < d:
                twice |= {(d, i)}
    assert twice and twice <= got
    assert n < 2.5 * len(twice)
