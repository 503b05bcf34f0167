"""Toxicity scores: a bidirectional gated recurrent network with attention pooling.

A word's input is a word embedding beside the pooled embeddings of its character
n-grams. The network reads windows of ``WINDOW`` words that overlap by
``WINDOW - STRIDE``; every window of every text is scored. A text's score is a
logistic function of its strongest windows and their number, fitted on
labelled texts that the network hasn't seen.

Training is numpy in one task, on a bounded sample of labelled rows. Scoring
is one pass over the table, without a shuffle.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlex.llm.npwords import _INV, _MULT, BYTE_VALUE, NON_ALNUM, SPACE, Words, _powers, mix, release_memory, shingle_sets, text_chunks
from driftlex.llm.rowflags import row_key
from driftlex.llm.scratch import bounded_batches, materialise

WINDOW, STRIDE = 32, 24
UNITS, WORD_DIM, CHAR_DIM = 8, 8, 8
GRAMS = (5, 6, 7)
WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 18
#: Labelled rows that the model is fitted on, of each class, and characters of a training text at most.
MOST_TOXIC, MOST_CLEAN, LONGEST = 1200, 2800, 12_000
#: A word or n-gram has an embedding of its own if so many training texts hold it, of whatever language, and their labels
#: differ from the others': twice the log-likelihood ratio (chance exceeds 10.83 once in a thousand).
LEAST_DF, LEAST_EVIDENCE = 4, 10.83
#: Texts of prior evidence that a word's first weight is shrunk by.
PRIOR = 12
BATCH, PRESENTED = 512, 120_000
N_FEATURES = 6
#: Bytes of text that a task scores at once; a longer text is scored alone.
SCORED_BYTES = 1 << 20


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Distinct words of a chunk and their n-gram buckets."""

    def __init__(self, words: Words):
        h = words.hashes()
        self.keys, at, self.of = np.unique(h, return_index=True, return_inverse=True)
        a, b = words.starts[at], words.ends[at]
        size = b - a + 2
        end = np.cumsum(size)
        start = end - size
        who = np.repeat(np.arange(len(a)), size)
        inner = np.arange(end[-1] if len(end) else 0) - start[who]
        edge = (inner == 0) | (inner == size[who] - 1)
        src = np.clip(a[who] + inner - 1, 0, max(0, len(words.data) - 1))
        value = np.where(edge, np.uint64(0x1F3D5B79), BYTE_VALUE[words.data[src]]) if len(src) else np.zeros(0, np.uint64)
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * _powers(_MULT, len(value)), out=total[1:])
        inv = _powers(_INV, len(value) + 1)
        grams, owner = [], []
        for n in GRAMS:
            i = np.flatnonzero(inner + n <= size[who])
            grams.append(mix((total[i + n] - total[i]) * inv[i] + np.uint64(n)) & np.uint64(GRAM_BUCKETS - 1))
            owner.append(who[i])
        grams, owner = np.concatenate(grams).astype(np.int64), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.grams, owner = grams[order], owner[order]
        self.cut = np.searchsorted(owner, np.arange(len(a) + 1))
        self.word = (self.keys & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)


def _pooled_rows(table, index, cut):
    """Sum of ``table[index[cut[i]:cut[i + 1]]]`` over the root of their number for each i, 0 where there is none."""
    n = np.diff(cut)
    out = np.zeros((len(n), table.shape[1]), np.float32)
    if len(index):
        sums = np.add.reduceat(np.vstack([table[index], np.zeros((1, table.shape[1]), np.float32)]), np.minimum(cut[:-1], len(index)))
        out[n > 0] = sums[n > 0] / np.sqrt(n[n > 0, None])
    return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of every window, given each text's word range."""
    n = np.diff(first)
    k = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), k)
    j = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    a = first[:-1][doc] + j * STRIDE
    return doc, a, np.minimum(a + WINDOW, first[1:][doc])


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, g = WORD_DIM + CHAR_DIM, 3 * UNITS
        small = lambda *s: (r.normal(size=s) * (1.0 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {"Wf": small(d, g), "Wb": small(d, g), "bf": np.zeros(g, np.float32), "bb": np.zeros(g, np.float32), "Uf": small(UNITS, g), "Ub": small(UNITS, g), "v": small(2 * UNITS) * 0.5, "w": small(2 * UNITS), "b": np.zeros(1, np.float32)}
        self.word_of = np.zeros(WORD_BUCKETS, np.int32)
        self.gram_of = np.zeros(GRAM_BUCKETS, np.int32)
        self.words = np.zeros((1, WORD_DIM), np.float32)
        self.chars = np.zeros((1, CHAR_DIM), np.float32)
        self.text = np.zeros(N_FEATURES)
        self.text[0] = -30
        self.usual = 0.0

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """A row for each distinct word; the last row stands for no word."""
        x = np.hstack([self.words[self.word_of[v.word]], _pooled_rows(self.chars, self.gram_of[v.grams], v.cut)])
        return np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])

    def _pass(self, g, mask, u, keep):
        """States of one direction, in the order of steps. g: steps x rows x gates."""
        steps, rows, _ = g.shape
        h = np.zeros((rows, UNITS), np.float32)
        out, tape = np.empty((steps, rows, UNITS), np.float32), []
        for t in range(steps):
            a = h @ u
            zr = g[t, :, : 2 * UNITS] + a[:, : 2 * UNITS]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            c = a[:, 2 * UNITS :]
            n = r * c
            n += g[t, :, 2 * UNITS :]
            n *= -2
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            new = n + z * (h - n)
            m = mask[t]
            new = np.where(m[:, None], new, h)
            if keep:
                tape.append((h, z, r, n, c, m))
            h = new
            out[t] = h
        return out, tape

    def forward(self, gf, gb, mask, keep=False):
        """Window logits. gf, gb: steps x rows x gates, both in reading order; mask: steps x rows."""
        p = self.p
        f, tf = self._pass(gf, mask, p["Uf"], keep)
        b, tb = self._pass(gb[::-1], mask[::-1], p["Ub"], keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        e = np.where(mask, h @ p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(0))
        e = np.where(mask, e, 0)
        att = e / np.maximum(e.sum(0), 1e-9)
        ctx = np.einsum("tb,tbh->bh", att, h)
        out = ctx @ p["w"] + p["b"][0]
        return (out, (tf, tb, h, att, ctx)) if keep else out

    def _back(self, dh_all, tape, u):
        """Gradients of one direction: for the gates' inputs, and for u."""
        steps = len(tape)
        dg = np.zeros((steps, dh_all.shape[1], 3 * UNITS), np.float32)
        du = np.zeros_like(u)
        dh = np.zeros(dh_all.shape[1:], np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, c, m = tape[t]
            dh = dh + dh_all[t]
            live = np.where(m[:, None], dh, 0)
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (h - n) * z * (1 - z)
            dr = dn * c * r * (1 - r)
            da = np.hstack([dz, dr, dn * r])
            dg[t] = np.hstack([dz, dr, dn])
            du += h.T @ da
            dh = np.where(m[:, None], live * z + da @ u.T, dh)
        return dg, du

    def gradients(self, x, idx, mask, y, weight):
        """Loss gradients for the parameters and for the input rows x."""
        p = self.p
        gf, gb = (x @ p["Wf"] + p["bf"])[idx], (x @ p["Wb"] + p["bb"])[idx]
        out, (tf, tb, h, att, ctx) = self.forward(gf, gb, mask, True)
        d = ((_sigmoid(out) - y) * weight / len(y)).astype(np.float32)
        g = {"b": np.array([d.sum()], np.float32), "w": ctx.T @ d}
        dctx = d[:, None] * p["w"]
        datt = np.einsum("tbh,bh->tb", h, dctx)
        de = att * (datt - (att * datt).sum(0))
        g["v"] = np.einsum("tb,tbh->h", de, h)
        dh = att[:, :, None] * dctx + de[:, :, None] * p["v"]
        dgf, g["Uf"] = self._back(dh[:, :, :UNITS], tf, p["Uf"])
        dgb, g["Ub"] = self._back(dh[::-1, :, UNITS:], tb, p["Ub"])
        dgb = dgb[::-1]
        flat = idx.ravel()
        dx = np.zeros_like(x)
        for side, dgate in (("f", dgf), ("b", dgb)):
            two = dgate.reshape(-1, 3 * UNITS)
            rows = np.stack([np.bincount(flat, two[:, k], len(x)) for k in range(two.shape[1])], 1).astype(np.float32)
            g["b" + side] = rows.sum(0)
            g["W" + side] = x.T @ rows
            dx += rows @ p["W" + side].T
        return g, dx

    def logits(self, x, idx, mask) -> np.ndarray:
        """Logits of windows: idx and mask are steps x rows."""
        pf, pb = x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]
        out = np.empty(idx.shape[1], np.float32)
        for a in range(0, idx.shape[1], 1024):
            i = idx[:, a : a + 1024]
            out[a : a + 1024] = self.forward(pf[i], pb[i], mask[:, a : a + 1024])
        return out

    def features(self, data, off) -> np.ndarray:
        """Of each text: 1, what its three strongest windows have above the usual, the log of that over all windows, log of words."""
        words = Words(data, off, NON_ALNUM)
        n = np.diff(words.first)
        out = np.zeros((len(n), N_FEATURES))
        out[:, 0] = 1
        out[:, 5] = np.log1p(n) - 5
        doc, a, b = windows(words.first)
        if len(doc):
            v = Vocabulary(words)
            at = a[None, :] + np.arange(WINDOW)[:, None]
            mask = at < b
            idx = np.where(mask, v.of[np.minimum(at, len(v.of) - 1)], len(v.keys))
            z = self.logits(self.inputs(v), idx, mask)
            order = np.lexsort((z, doc))
            z, d = z[order], doc[order]
            last = np.flatnonzero(np.append(d[1:] != d[:-1], True))
            rise = np.maximum(z - self.usual, 0)
            out[d[last], 1] = rise[last]
            for k in (1, 2):
                other = np.maximum(last - k, 0)
                out[d[last], 1 + k] = np.where((d[other] == d[last]) & (last >= k), rise[other], 0)
            out[d[last], 4] = np.log1p(np.add.reduceat(rise, np.append(0, last[:-1] + 1)))
        return out

    def scores(self, data, off) -> np.ndarray:
        return _sigmoid(self.features(data, off) @ self.text)


def _evidence(df, pos, base):
    """Twice the log-likelihood ratio of ``pos`` toxic texts out of ``df`` against a share of ``base``."""
    neg = df - pos
    return 2 * (pos * np.log(np.maximum(pos, 1e-9) / (df * base)) + neg * np.log(np.maximum(neg, 1e-9) / (df * (1 - base))))


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


def _parts(texts: list[str], limit: int = 1 << 20):
    """Bytes and offsets of runs of texts, of about a megabyte each: what training holds at once is bounded."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield _bytes(part)
            part, size = [], 0
    if part:
        yield _bytes(part)


class _Training:
    """The distinct words of all training texts with their n-grams, and each text's words by number."""

    def __init__(self, texts: list[str]):
        parts, self.first = [], np.zeros(1, np.int64)
        for data, off in _parts(texts):
            words = Words(data, off, NON_ALNUM)
            parts.append(Vocabulary(words))
            self.first = np.append(self.first, self.first[-1] + words.first[1:])
        keys = np.concatenate([v.keys for v in parts])
        self.keys, one, to = np.unique(keys, return_index=True, return_inverse=True)
        base = np.cumsum([0, *[len(v.keys) for v in parts]])
        self.of = np.concatenate([to[base[i] + v.of] for i, v in enumerate(parts)]).astype(np.int32)
        shift = np.cumsum([0, *[len(v.grams) for v in parts]])
        start = np.concatenate([v.cut[:-1] + shift[i] for i, v in enumerate(parts)])[one]
        n = np.concatenate([np.diff(v.cut) for v in parts])[one]
        grams = np.concatenate([v.grams.astype(np.int32) for v in parts])
        self.cut = np.append(0, np.cumsum(n))
        self.grams = grams[np.repeat(start - self.cut[:-1], n) + np.arange(self.cut[-1])]
        self.word = (self.keys & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)


def _apart(texts: list[str]) -> list[int]:
    """Texts without those that are near copies of an earlier one, by eight least shingle hashes."""
    kept: list[int] = []
    seen: dict[tuple[int, int], list[int]] = {}
    sets = (s for part in _parts(texts) for s in shingle_sets(Words(*part, SPACE), 3))
    for i, s in enumerate(sets):
        marks = [(b, int(x.min())) for b in range(8) if len(x := s[(s >> np.uint64(61)) == b])]
        met = np.bincount([j for m in marks for j in seen.get(m, [])], minlength=1)
        if len(marks) and met.max() * 3 >= len(marks):
            continue
        for m in marks:
            seen.setdefault(m, []).append(i)
        kept.append(i)
    return kept


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Network:
    """A network fitted on labelled texts, near copies aside; weights: the rows that each text stands for."""
    net = Network(seed)
    own = _apart(texts)
    texts, labels, weights = [texts[i] for i in own], labels[own].astype(np.float64), weights[own]
    if not len(labels) or not labels.any() or labels.all():
        net.text[0] = 30 if labels.any() else -30
        return net
    r = np.random.default_rng(seed)
    # every fourth text of each class is kept for the final logistic function
    held = np.zeros(len(texts), bool)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        held[r.permutation(own)[: len(own) // 4]] = True
    train = np.flatnonzero(~held)
    v = _Training([texts[i] for i in train])
    y_doc = labels[train]
    used = np.diff(v.cut)
    # texts that hold each bucket, and toxic ones of them, some texts at a time
    held_by = {k: (np.zeros(size), np.zeros(size)) for k, size in (("words", WORD_BUCKETS), ("chars", GRAM_BUCKETS))}
    for a in range(0, len(train), 64):
        b = min(a + 64, len(train))
        doc = np.repeat(np.arange(b - a), np.diff(v.first[a : b + 1]))
        pair = np.unique(v.of[v.first[a] : v.first[b]].astype(np.int64) * 64 + doc)
        word, doc = pair // 64, pair % 64
        n = used[word]
        gram = v.grams[np.repeat(v.cut[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
        for name, bucket, of in (("words", v.word[word], doc), ("chars", gram, np.repeat(doc, n))):
            pair = np.unique(bucket * 64 + of)
            df, pos = held_by[name]
            df += np.bincount(pair // 64, minlength=len(df))
            pos += np.bincount(pair // 64, y_doc[a + pair % 64], len(df))

    def known(name):
        """Buckets that tell labels apart, numbered from 1, and the log-odds of their texts being toxic."""
        df, pos = held_by[name]
        base = y_doc.mean()
        have = np.flatnonzero(df >= LEAST_DF)
        have = have[_evidence(df[have], pos[have], base) > LEAST_EVIDENCE]
        odds = np.log((pos[have] + PRIOR * base) / (df[have] - pos[have] + PRIOR * (1 - base))) - np.log(base / (1 - base))
        number = np.zeros(len(df), np.int32)
        number[have] = 1 + np.arange(len(have))
        return number, odds

    net.word_of, word_odds = known("words")
    net.gram_of, gram_odds = known("chars")
    for name, odds, dim in (("words", word_odds, WORD_DIM), ("chars", gram_odds, CHAR_DIM)):
        e = (r.normal(size=(len(odds) + 1, dim)) * 0.05).astype(np.float32)
        e[0] = 0
        e[1:, 0] += 0.5 * np.clip(odds, -4, 4)
        setattr(net, name, e)
    doc, a, b = windows(v.first)
    y = y_doc[doc]
    net.p["b"][0] = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    squares = {"words": np.full(len(net.words), 1e-6, np.float32), "chars": np.full(len(net.chars), 1e-6, np.float32)}
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for step in range(1, PRESENTED // BATCH + 1):
        # half of a batch from toxic texts; the weights undo that
        pick = np.concatenate([r.choice(pos, BATCH // 2), r.choice(neg, BATCH // 2)])
        share = len(pos) / len(y)
        weight = np.where(y[pick] == 1, 2 * min(0.35, share), 2 * (1 - min(0.35, share)))
        at = a[pick][None, :] + np.arange(WINDOW)[:, None]
        mask = at < b[pick]
        idx = np.where(mask, v.of[np.minimum(at, len(v.of) - 1)], len(v.keys))
        uq, inv = np.unique(idx, return_inverse=True)
        idx = inv.reshape(idx.shape)
        real = uq[uq < len(v.keys)]
        n = used[real]
        cut = np.append(0, np.cumsum(n))
        g_idx = net.gram_of[v.grams[np.repeat(v.cut[real] - cut[:-1], n) + np.arange(cut[-1])]]
        w_idx = net.word_of[v.word[real]]
        x = np.hstack([net.words[w_idx], _pooled_rows(net.chars, g_idx, cut)])
        x = np.vstack([x, np.zeros((len(uq) - len(real), x.shape[1]), np.float32)])
        grads, dx = net.gradients(x, idx, mask, y[pick], weight)
        rate = 0.01 * min(1, step / 20) * (1 if step < 0.7 * PRESENTED / BATCH else 0.2)
        for k, g in grads.items():
            m, s = moments[k]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        for name, index, grad in (("words", w_idx, dx[: len(real), :WORD_DIM]), ("chars", g_idx, np.repeat(dx[: len(real), WORD_DIM:] / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0))):
            table, sq = getattr(net, name), squares[name]
            some, to = np.unique(index, return_inverse=True)
            total = np.stack([np.bincount(to, grad[:, k], len(some)) for k in range(grad.shape[1])], 1)
            sq[some] += (total**2).mean(1).astype(np.float32)
            step_by = (0.02 * total / np.sqrt(sq[some])[:, None]).astype(np.float32)
            step_by[some == 0] = 0
            table[some] -= step_by
    keep = np.flatnonzero(held)
    net.usual = float(net.p["b"][0])
    x = np.vstack([net.features(*part) for part in _parts([texts[i] for i in keep])])
    net.text = _logistic(x, labels[keep], weights[keep])
    return net


def _logistic(x, y, weight) -> np.ndarray:
    """Weighted logistic regression with a small penalty, by Newton's method."""
    weight = weight / weight.mean()
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ beta)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, *[0.3] * (x.shape[1] - 1)])
        g = x.T @ (weight * (y - p)) - np.array([1e-6, *[0.3] * (x.shape[1] - 1)]) * beta
        move = np.linalg.solve(h, g)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return beta


def held_out(doc_id=None):
    """Rows whose labels are not learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Network:
    """Fit on at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled rows, picked by a hash of their ids.

    Picked from are ids with a label that may be learned from and a text of ``LONGEST`` characters at most, so
    no pick is lost to a long text; of a repeated id one text, of conflicting labels 1. Null ids, labels and texts
    teach nothing. Without labels of both kinds the network scores all texts alike.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", row_key())
    texts = texts.where((F.length("text") <= LONGEST) & F.col("doc_id").isNotNull())
    known = texts.select("doc_id", "key").join(known, "doc_id").groupBy("doc_id").agg(F.min("key").alias("key"), F.max("toxic").alias("toxic"))
    known = materialise(known, "labelled")
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))

    def pick(y: int, most: int) -> DataFrame:
        """By a share first, so that the limit meets little more than it keeps, whatever the number of tasks."""
        some = known.where(F.col("toxic") == y).withColumn("unit", unit).where(F.col("unit") < min(1.0, 1.5 * most / max(1, total.get(y, 0))) * (1 << 30))
        return some.orderBy("unit", "doc_id").limit(most).drop("unit")

    picked = materialise(pick(1, MOST_TOXIC).union(pick(0, MOST_CLEAN)), "picked")
    # at most MOST_TOXIC + MOST_CLEAN keys
    sample = texts.select("key", "text").join(F.broadcast(picked), "key").dropDuplicates(["key"]).select("doc_id", "toxic", "text")

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        y = np.array([r[1] for r in rows], float)
        weight = np.array([total[r[1]] for r in rows], float) / np.where(y == 1, max(1, y.sum()), max(1, (1 - y).sum()))
        net = fit([r[2] for r in rows], y, weight, seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])
        del rows, net
        release_memory()

    # the bounded sample meets in one task, whose memory is an executor's and not the driver's
    fitted = sample.repartition(1).mapInArrow(run, "net binary").first()
    return pickle.loads(fitted["net"]) if fitted else fit([], np.zeros(0), np.zeros(0), seed)


def score(docs: DataFrame, net: Network, *columns: str) -> DataFrame:
    """``columns`` of docs with ``score`` in [0, 1].

    Null and empty texts are scored as texts of no words; texts of any length by all their windows. Repeated
    rows are scored each by itself; columns that aren't asked for are left out, whatever their names. An empty
    table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size: buckets times dimensions at most
    kept = [f for f in docs.schema.fields if f.name in columns]
    # a text that is asked for travels once
    own = docs.select(*[F.col(f"`{f.name}`") for f in kept]) if any(f.name == "text" and f.dataType.simpleString() == "string" for f in kept) else docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col("text").cast("string").alias("__text"))
    at, names = own.columns.index("__text" if "__text" in own.columns else "text"), [f.name for f in kept]

    def run(batches):
        model = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, off in text_chunks(batch.column(at), SCORED_BYTES):
                out[a:b] = model.scores(data, off)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out)], names=[*names, "score"])
        release_memory()

    scored = own.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double")
    return scored.select(*columns, "score")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net, "doc_id").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accuracy(scored: pd.DataFrame, labels: pd.DataFrame) -> dict:
    """Held-out figures of a result: area under the curve, precision and recall."""
    t = scored[scored.held_out].merge(labels, on="doc_id")
    y, s = t.toxic.to_numpy(), t.score.rank().to_numpy()
    n1, n0 = int(y.sum()), int((1 - y).sum())
    hit = int(((t.predicted == 1) & (y == 1)).sum())
    return {"auc": float((s[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * n0)), "precision": hit / max(1, int(t.predicted.sum())), "recall": hit / max(1, n1), "n": len(t)}
