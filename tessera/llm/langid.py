"""Language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward recurrent layer of HIDDEN units read the bytes of a segment of SEGMENT bytes and
label every position. A second gated layer of each direction carries their state from segment to segment over the whole
text: what it has gathered of all segments before (or behind) a segment counts at each of the segment's positions. So each label
depends on the whole text, and the steps that follow one on the other are few. A document's probabilities are the mean
over all its positions. All of it is trained in numpy by backpropagation through time, through both layers, on at most about
SAMPLE labelled documents of the SAMPLE // 8 most frequent languages (documented bounds; from each document a stretch of at most STRETCH characters, for learning
only); prediction reads every byte of every text.

Learning uses text and non-null lang of the rows that `training` admits. A text that is
null or has no letter is `und` with score 0, and so is every text where nothing could be
learned (no labelled rows). Repeated rows are predicted alike. A null doc_id isn't held out. Other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

SEGMENT, HIDDEN = 64, 8
SAMPLE, STRETCH = 2400, 768
STEPS, BATCH, RATE, SEED = 260, 40, 0.02, 11
AT_ONCE = 4096
UNKNOWN = "und"


@dataclass
class Network:
    """Weights of both directions (first axis 2) and of the labels."""

    labels: list[str]
    x: np.ndarray  # (2, 256, 3 * hidden): update gate, reset gate, candidate
    u: np.ndarray  # (2, hidden, 3 * hidden)
    b: np.ndarray  # (2, 1, 3 * hidden), of the recurrent product
    v: np.ndarray  # (2, hidden, labels)
    c: np.ndarray  # (labels,)
    # The layer from segment to segment: of a segment's last state, of its own state, and to the labels.
    cx: np.ndarray  # (2, hidden, 3 * hidden)
    cu: np.ndarray  # (2, hidden, 3 * hidden)
    cb: np.ndarray  # (2, 1, 3 * hidden)
    cv: np.ndarray  # (2, hidden, labels)


WEIGHTS = ("x", "u", "b", "v", "c", "cx", "cu", "cb", "cv")


def sigmoid(a: np.ndarray) -> np.ndarray:
    a *= np.float32(0.5)
    np.tanh(a, out=a)
    a += np.float32(1)
    a *= np.float32(0.5)
    return a


def gated(a: np.ndarray, h: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A step of both directions from state h with input a: (state, gates, candidate, recurrent part of the candidate)."""
    k = h.shape[-1]
    r = h @ u + b
    gates = sigmoid(a[..., : 2 * k] + r[..., : 2 * k])
    inner = r[..., 2 * k :]
    cand = np.tanh(a[..., 2 * k :] + gates[..., k:] * inner)
    return cand + gates[..., :k] * (h - cand), gates, cand, inner


def back(dh: np.ndarray, h: np.ndarray, gates: np.ndarray, cand: np.ndarray, inner: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a step of gated, from the gradient of its result: those of the input, of the recurrent product, and of the state before."""
    k = h.shape[-1]
    z, r = gates[..., :k], gates[..., k:]
    dc = dh * (1 - z) * (1 - cand * cand)
    pre = np.concatenate([dh * (h - cand) * z * (1 - z), dc * inner * r * (1 - r), dc], -1)
    rec = pre.copy()
    rec[..., 2 * k :] *= r
    return pre, rec, dh * z + rec @ np.swapaxes(u, 1, 2)


def in_order(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2, documents, most segments): numbers of the segments in the order of each direction, and which there are."""
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    k = np.arange(int(count.max(initial=0)))
    there = k < count[:, None]
    return np.where(there, np.stack([first[:, None] + k, first[:, None] + count[:, None] - 1 - k]), 0), there


def forward(net: Network, seg: np.ndarray, count: np.ndarray) -> dict:
    """All activations for segments (n, T) of bytes, count of them for each document; the second direction reads from the end."""
    n, t = seg.shape
    k = net.u.shape[1]
    both = np.stack([seg.T, seg.T[::-1]])
    h = np.zeros((t + 1, 2, n, k), np.float32)
    steps = []
    for i in range(t):
        h[i + 1], *rest = gated(np.stack([net.x[0][both[0, i]], net.x[1][both[1, i]]]), h[i], net.u, net.b)
        steps.append(rest)
    order, there = in_order(count)
    way = np.arange(2)[:, None]
    g, carried, outer = np.zeros((2, len(count), k), np.float32), np.zeros((2, n, k), np.float32), []
    for i in range(order.shape[2]):
        at, live = order[:, :, i], there[:, i]
        carried[way, at[:, live]] = g[:, live]
        last = h[t][way, at]
        after, *rest = gated(last @ net.cx, g, net.cu, net.cb)
        outer.append((g, last, at, live, *rest))
        g = after
    logits = h[1:, 0] @ net.v[0] + h[1:, 1][::-1] @ net.v[1] + net.c + (carried[0] @ net.cv[0] + carried[1] @ net.cv[1])
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    return {"both": both, "h": h, "steps": steps, "carried": carried, "outer": outer, "p": p}


def gradients(net: Network, a: dict, want: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy of all positions; want: a label for each segment."""
    t, n, m = a["p"].shape
    k = net.u.shape[1]
    d = a["p"].copy()
    d[:, np.arange(n), want] -= 1
    d /= t * n
    h = a["h"]
    out = {w: np.zeros_like(getattr(net, w)) for w in WEIGHTS}
    out["c"] = d.sum((0, 1))
    out["v"] = np.stack([np.einsum("tnk,tnm->km", h[1:, 0], d), np.einsum("tnk,tnm->km", h[1:, 1][::-1], d)])
    once = d.sum(0)
    out["cv"] = np.swapaxes(a["carried"], 1, 2) @ once
    read = once @ np.swapaxes(net.cv, 1, 2)  # of the carried states, by their labels
    way = np.arange(2)[:, None]
    dh, dg = np.zeros((2, n, k), np.float32), 0
    for g, last, at, live, *rest in reversed(a["outer"]):
        pre, rec, dg = back(dg + np.zeros_like(g), g, *rest, net.cu)
        out["cx"] += np.swapaxes(last, 1, 2) @ pre
        out["cu"] += np.swapaxes(g, 1, 2) @ rec
        out["cb"] += rec.sum(1, keepdims=True)
        dh[way, at[:, live]] += (pre @ np.swapaxes(net.cx, 1, 2))[:, live]
        dg[:, live] += read[way, at[:, live]]
    up = np.stack([d @ net.v[0].T, (d @ net.v[1].T)[::-1]], 1)
    pre = np.empty((t, 2, n, 3 * k), np.float32)
    for i in range(t - 1, -1, -1):
        pre[i], rec, nxt = back(dh + up[i], h[i], *a["steps"][i], net.u)
        out["u"] += np.swapaxes(h[i], 1, 2) @ rec
        out["b"] += rec.sum(1, keepdims=True)
        dh = nxt
    for s in range(2):
        byte, g = a["both"][s].ravel(), pre[:, s].reshape(-1, 3 * k)
        for j in range(3 * k):
            out["x"][s, :, j] = np.bincount(byte, g[:, j], 256)
    return out


def segments(x: np.ndarray) -> np.ndarray:
    """The bytes of a text in rows of SEGMENT, filled up with zeros; at least one."""
    out = np.zeros((max(1, -(-len(x) // SEGMENT)), SEGMENT), np.uint8)
    out.ravel()[: len(x)] = x
    return out


def trained(texts: list[bytes], langs: list[str]) -> Network | None:
    """A network fitted to labelled texts by Adam; None without texts."""
    labels = sorted(set(langs))
    r = np.random.default_rng(SEED)
    docs = [(segments(np.frombuffer(text, np.uint8)), labels.index(lang)) for text, lang in zip(texts, langs, strict=True) if text]
    if not docs:
        return None
    by = [[s for s, want in docs if want == k] for k in range(len(labels))]
    k, m = HIDDEN, len(labels)
    f = np.float32
    cell = lambda: r.normal(0, k**-0.5, (2, k, 3 * k)).astype(f)
    flat = lambda: np.zeros((2, 1, 3 * k), f)
    net = Network(labels, r.normal(0, 0.3, (2, 256, 3 * k)).astype(f), cell(), flat(), r.normal(0, k**-0.5, (2, k, m)).astype(f), np.zeros(m, f), cell(), cell(), flat(), r.normal(0, k**-0.5, (2, k, m)).astype(f))
    moments = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in WEIGHTS}
    for step in range(1, STEPS + 1):
        pick = [(by[j][i], j) for j in range(m) if by[j] for i in r.integers(0, len(by[j]), max(1, BATCH // m))]
        count = np.array([len(s) for s, _ in pick])
        seg, want = np.concatenate([s for s, _ in pick]), np.repeat([j for _, j in pick], count)
        g = gradients(net, forward(net, seg, count), want)
        rate = RATE * min(1, 2 * (1 - (step - 1) / STEPS))
        norm = sum(float((x * x).sum()) for x in g.values()) ** 0.5
        for n, (m1, m2) in moments.items():
            x = g[n] * min(1.0, 1.0 / max(norm, 1e-9))
            m1 += 0.1 * (x - m1)
            m2 += 0.01 * (x * x - m2)
            getattr(net, n)[...] -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(f)
    return net


def read(net: Network, seg: np.ndarray, labels: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """The last states of both directions for each segment, and with labels what they add to the labels at each position (T, n, labels)."""
    t, k, s = seg.shape[1], net.u.shape[1], seg.shape[0]
    cols = np.ascontiguousarray(seg.T).astype(np.intp)
    out = np.empty((t, s, len(net.labels)), np.float32) if labels else None
    ends = np.empty((2, s, k), np.float32)
    # All arrays lie end to end, which numpy works on several times as fast as on parts of rows.
    z, r, c, w = (np.empty((s, k), np.float32) for _ in range(4))
    for way, order in ((0, range(t)), (1, range(t - 1, -1, -1))):
        h = np.zeros((s, k), np.float32)
        (xz, xr, xc), (uz, ur, uc), last = thirds(net.x[way], net.u[way], net.b[way, 0])
        for i in order:
            for gate, x, u in ((z, xz, uz), (r, xr, ur)):
                np.take(x, cols[i], 0, out=gate, mode="clip")
                gate += np.matmul(h, u, out=w)
                np.tanh(gate, out=gate)
                gate += np.float32(1)
                gate *= np.float32(0.5)
            np.matmul(h, uc, out=c)
            c += last
            c *= r
            c += np.take(xc, cols[i], 0, out=w, mode="clip")
            np.tanh(c, out=c)
            h -= c
            h *= z
            h += c
            if labels and way:
                out[i] += h @ net.v[1]
            elif labels:
                np.matmul(h, net.v[0], out=out[i])
        ends[way] = h
    return ends, out


def thirds(x: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Weights of the input and of the state for update gate, reset gate and candidate, and the candidate's bias.

    sigmoid(a) = (tanh(a / 2) + 1) / 2: the halves, and the gates' biases, go into the weights.
    """
    k = u.shape[0]
    xs, us = [np.ascontiguousarray(x[:, j * k : j * k + k]) for j in range(3)], [np.ascontiguousarray(u[:, j * k : j * k + k]) for j in range(3)]
    for j in range(2):
        xs[j] = (xs[j] + b[j * k : j * k + k]) * np.float32(0.5)
        us[j] = us[j] * np.float32(0.5)
    return xs, us, b[2 * k :]


def carried(net: Network, ends: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What the layer from segment to segment adds to the labels of each segment, from the last states of all; count: segments of each document."""
    k = net.u.shape[1]
    by = np.argsort(-count, kind="stable")
    first, left = (np.cumsum(count) - count)[by], count[by]
    steps = np.arange(max(0, int(count.max(initial=0)) - 1))
    live = np.searchsorted(-left, -(steps + 1), "left")  # documents with a segment after this one
    at = np.cumsum(live) - live
    # All steps end to end: which document, which step, and its segments in the order of each direction.
    step = np.repeat(steps, live)
    doc = np.arange(len(step)) - at[step]
    ahead, behind = first[doc] + step, first[doc] + left[doc] - 1 - step
    # Both directions side by side, each with its own half of the weights.
    parts = [thirds(ends[way, at_] @ net.cx[way], net.cu[way], net.cb[way, 0]) for way, at_ in ((0, ahead), (1, behind))]
    az, ar, ac = (np.concatenate([parts[0][0][j], parts[1][0][j]], 1) for j in range(3))
    none = np.zeros((k, k), np.float32)
    uz, ur, uc = (np.block([[parts[0][1][j], none], [none, parts[1][1][j]]]) for j in range(3))
    last = np.concatenate([parts[0][2], parts[1][2]])
    g, out = np.zeros((len(count), 2 * k), np.float32), np.empty((len(step), 2 * k), np.float32)
    for o, n in zip(at.tolist(), live.tolist(), strict=True):
        g = g[:n]
        z, r, c = g @ uz, g @ ur, g @ uc
        for gate, x in ((z, az), (r, ar)):
            gate += x[o : o + n]
            np.tanh(gate, out=gate)
            gate += np.float32(1)
            gate *= np.float32(0.5)
        c += last
        c *= r
        c += ac[o : o + n]
        np.tanh(c, out=c)
        g = g - c
        g *= z
        g += c
        out[o : o + n] = g
    out = out.reshape(-1, 2, k).swapaxes(0, 1)
    state = np.zeros((2, ends.shape[1], k), np.float32)
    state[0, ahead + 1] = out[0]
    state[1, behind - 1] = out[1]
    return state[0] @ net.cv[0] + state[1] @ net.cv[1] + net.c


def pooled(logits: np.ndarray, more: np.ndarray, n: np.ndarray, positions: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The sum of the probabilities of the first n positions of each segment, and on demand each position's label."""
    t, s, m = logits.shape
    total = np.zeros((s, m), np.float32)
    labels = np.empty((t, s), np.uint16) if positions else None
    for i in range(t):
        p = logits[i]
        p += more
        if positions:
            labels[i] = p.argmax(1)
        p -= p.max(1, keepdims=True) if m > 8 else np.maximum.reduce([p[:, j] for j in range(m)])[:, None]
        np.exp(p, out=p)
        w = p[:, 0].copy()
        for j in range(1, m):
            w += p[:, j]
        w = (i < n) / w
        p *= w[:, None].astype(np.float32)
        total += p
    return total, labels.T if positions else None


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which rows have a letter of any script."""
    seen = np.concatenate(([0], np.cumsum(LETTER[data])))
    out = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~out):
        x = data[offs[i] : offs[i + 1]]
        if len(x) and (x >= 128).any():
            out[i] = any(c.isalpha() for c in x.tobytes().decode("utf-8", "ignore"))
    return out


def sample(docs: DataFrame, training: Column, most: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """At most about `most` labelled texts, as many of each language as there are, chosen by a hash of doc_id."""
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most // 8).collect()}
    if not counts:
        return [], []
    share = {k: min(1.0, most / len(counts) / n) for k, n in counts.items()}
    rate = F.coalesce(F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("lang")], F.lit(0.0))
    chosen = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20)
    begin = F.greatest(F.lit(1), (F.length("text") / 3).cast("int"))
    got = rows.where(chosen).select("doc_id", "lang", F.encode(F.substring("text", F.when(F.length("text") > 2 * STRETCH, begin).otherwise(F.lit(1)), F.lit(STRETCH)), "utf-8").alias("t")).collect()
    got.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, bytes(r.t)))
    return [bytes(r.t) for r in got], [r.lang for r in got]


def predicted(docs: DataFrame, net: Network | None, positions: bool = False, least: float | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text); with positions also labels, one byte for each byte of the text (two with over 256 languages).

    With least, docs instead: its rows, whole and as they are, whose language is told with that score or more.
    """
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few languages or many, about as many numbers at once.
        at_once = max(64, AT_ONCE * 8 // max(8, len(net.labels))) if net else AT_ONCE
        for rows, data, offs in C.slices(batches, limit=SEGMENT * AT_ONCE):
            n = np.diff(offs)
            good = has_letter(data, offs) & (net is not None)
            count = np.where(good, -(-n // SEGMENT), 0)
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
            start = offs[:-1][row] + k * SEGMENT
            size = np.minimum(SEGMENT, offs[1:][row] - start)
            probs = np.zeros((len(n), len(net.labels) if net else 1))
            marks = np.zeros(len(data), np.uint8 if not net or len(net.labels) <= 256 else "<u2")
            padded = np.concatenate((data, np.zeros(SEGMENT, np.uint8)))

            def part(a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                x = start[a : a + at_once, None] + np.arange(SEGMENT)
                inside = np.arange(SEGMENT) < size[a : a + at_once, None]
                return x, inside, np.where(inside, padded[x], 0)

            if len(row):
                parts = range(0, len(row), at_once)
                whole = read(net, part(0)[2]) if len(parts) == 1 else None
                # A text of many parts is read twice: for its states, which are carried over all of it, and for its labels.
                ends = whole[0] if whole else np.concatenate([read(net, part(a)[2], False)[0] for a in parts], 1)
                more = carried(net, ends, count[count > 0])
            for a in range(0, len(row), at_once):
                x, inside, seg = part(a)
                logits = whole[1] if whole else read(net, seg)[1]
                total, labels = pooled(logits, more[a : a + at_once], size[a : a + at_once], positions)
                for j in range(total.shape[1]):
                    probs[:, j] += np.bincount(row[a : a + at_once], total[:, j], len(n))
                if positions:
                    marks[x[inside]] = labels[inside]
            probs /= np.maximum(n, 1)[:, None]
            best = probs.argmax(1)
            name = [net.labels[b] if g else UNKNOWN for b, g in zip(best.tolist(), good.tolist(), strict=True)]
            score = np.where(good, np.clip(probs.max(1), 0, 1), 0.0)
            if least is not None:
                yield rows.filter(pa.array((np.array(name) != UNKNOWN) & (score >= least)))
                continue
            cols = [rows.column("doc_id"), pa.array(name, pa.string()), pa.array(score)]
            if positions:
                cols.append(C.binaries(marks.view(np.uint8), offs * marks.itemsize))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "labels"][: len(cols)])

    if least is not None:
        return docs.mapInArrow(run, docs.schema)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double" + ", labels binary" * positions)


def held_out() -> Column:
    """Documents that nothing is learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fitted(docs: DataFrame) -> Network | None:
    """The network learned from the documents that aren't held out."""
    return trained(*sample(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), F.coalesce(~held_out(), F.lit(True))))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang)."""
    out = predicted(docs, fitted(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
