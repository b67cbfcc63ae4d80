import random
import zlib

import numpy as np

from tessera.llm import langid as L

BITS = {"en": ["the", "of", "tion", "ing"], "de": ["der", "ung", "sch", "ü"], "fr": ["eau", "que", "è", "le"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(BITS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def network(r, k, m):
    f = lambda *s: r.normal(0, 0.5, s).astype(np.float32)
    return L.Network(list("abcdefgh"[:m]), f(2, 256, 3 * k), f(2, k, 3 * k), f(2, 1, 3 * k), f(2, k, m), f(m), f(2, k, 3 * k), f(2, k, 3 * k), f(2, 1, 3 * k), f(2, k, m))


def test_gradients_by_differences():
    r = np.random.default_rng(0)
    net = network(r, 3, 2)
    count = np.array([3, 1, 2])
    seg, want = r.integers(0, 5, (6, 4)).astype(np.uint8), np.repeat([0, 1, 1], count)
    loss = lambda: -np.log(L.forward(net, seg, count)["p"][:, np.arange(6), want].astype(float)).mean()
    g = L.gradients(net, L.forward(net, seg, count), want)
    for n in L.WEIGHTS:
        w = getattr(net, n)
        for _ in range(8):
            at = tuple(r.integers(0, 5) if n == "x" and d == 1 else r.integers(0, s) for d, s in enumerate(w.shape))
            old = w[at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-2 - g[n][at]) < 1e-3, n


def plain(net, text):
    """Probabilities at each byte, one step after the other over the whole text."""
    k = net.u.shape[1]
    sig = lambda a: 1 / (1 + np.exp(-a))

    def step(a, h, u, b):
        r = h @ u + b[0]
        z, q = sig(a[:k] + r[:k]), sig(a[k : 2 * k] + r[k : 2 * k])
        c = np.tanh(a[2 * k :] + q * r[2 * k :])
        return z * h + (1 - z) * c

    seg = L.segments(np.frombuffer(text, np.uint8))
    logits = np.zeros((*seg.shape, len(net.labels))) + net.c
    for way in range(2):
        g = np.zeros(k)
        for s in range(len(seg)) if way == 0 else range(len(seg) - 1, -1, -1):
            h = np.zeros(k)
            for i in range(L.SEGMENT) if way == 0 else range(L.SEGMENT - 1, -1, -1):
                h = step(net.x[way][seg[s, i]].astype(float), h, net.u[way], net.b[way])
                logits[s, i] += h @ net.v[way] + g @ net.cv[way]
            g = step(h @ net.cx[way], g, net.cu[way], net.cb[way])
    p = np.exp(logits.reshape(-1, len(net.labels))[: len(text)])
    return p / p.sum(1, keepdims=True)


def test_predictions_are_those_of_the_plain_network(spark, monkeypatch):
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)).decode() for n in (1, 63, 64, 65, 700, 128, 200, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for m, at_once in ((2, 4096), (3, 64), (8, 4096)):
        net = network(r, 5, m)
        monkeypatch.setattr(L, "AT_ONCE", at_once)
        got = {x.doc_id: x for x in L.predicted(df, net, positions=True).collect()}
        for i, t in enumerate(texts):
            p = plain(net, t.encode())
            mean = p.mean(0)
            assert abs(got[i].score - mean.max()) < 1e-3 and (got[i].lang_pred == net.labels[mean.argmax()] or np.sort(mean)[-1] - np.sort(mean)[-2] < 1e-3)
            assert (np.frombuffer(got[i].labels, np.uint8) == p.argmax(1)).mean() > 0.99


def test_a_label_depends_on_the_whole_text():
    r = np.random.default_rng(2)
    net = network(r, 5, 3)
    text = bytes(r.integers(97, 123, 1000).astype(np.uint8))
    seg = L.segments(np.frombuffer(text, np.uint8))
    other = seg.copy()
    other[0, -1] ^= 1
    a, b = (L.carried(net, L.read(net, x)[0], np.array([len(seg)])) for x in (seg, other))
    assert (a[1] != b[1]).any() and (a[3] != b[3]).any() and (a[0] == b[0]).all()


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(4)
    rows = [(i, prose(r, k, r.choice([2, 8, 40, 400])), k, "s") for i, k in enumerate(r.choices(list(BITS), k=400))]
    rows += [(1000, None, "en", None), (1001, "", None, "s"), (1002, "12 %% ... 3", "de", "s"), (1003, "٣٣ ·", "fr", "s"), (1004, "żółć", None, "s")]
    got = {x.doc_id: x for x in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()}
    assert len(got) == len(rows)
    for i in (1000, 1001, 1002, 1003):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1004].lang_pred in BITS
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    held = [(i, k) for i, _, k, _ in rows[:400] if got[i].held_out]
    assert sum(got[i].lang_pred == k for i, k in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(x)[2:] for x in L.identify(df).collect()] == [("und", 0.0)]
    assert L.identify(df.limit(0)).collect() == []
