"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector plus the mean of the vectors of its character trigrams (hashed), so that
unknown words have an input as well. Gated units read a window of words in both directions; attention pools
their states; a logistic unit scores the window. Windows of ``WINDOW`` words begin at every ``STRIDE``-th word and at the
last place, and all of them are scored: any ``WINDOW - STRIDE + 1`` words in a row lie whole in one, wherever they are. A
document's score is its highest window's.

Fitting, in the driver, uses at most ``FIT_ROWS`` labelled rows that are not held out, those with the smallest
hash of doc_id. Labels belong to documents, so windows are chosen among all of them: first those around the word with
the highest log odds, then, in further rounds, those the network itself scores highest. The network has a fixed size.

Scoring is one Arrow step without a shuffle. The input side of all gates is a table by word, known words
first and others as a task meets them (up to a bound), so a step of the recurrence is a small product. The windows
of a text take a step together: what they read is one slice of the text's gate inputs for each place in a stride.

Null and empty texts, and texts without a word, say nothing: their score is the share of label 1 among the rows
learned from, as is every score if there are no labels of both kinds (0 without labels). A null doc_id or a label without a
document is not learned from. Repeated rows and ids are scored row by row. A text's length is not bounded: windows are
scored ``AT_ONCE`` at a time. Fitting reads whole texts; of one row it keeps at most the first ``FIT_WORDS`` words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrow import mapped
from flowloom.llm.language_id import held_out

FIT_ROWS, FIT_WORDS, WINDOW, STRIDE, THRESHOLD = 4000, 20_000, 32, 4, 0.3
SIZE, INPUT, TRIGRAMS, VOCABULARY = 8, 12, 2048, 6000
ROUNDS, STEPS, BATCH, SEED = 3, 140, 160, 11
#: Words a task keeps in its table, and windows scored at once.
TABLE, AT_ONCE = 150_000, 2048
WORD = re.compile(r"\w+")
#: A checksum of three bytes is what each has at its place, combined by exclusive or; the first holds the constant part.
CRC = [np.array([zlib.crc32(bytes([b if i == k else 0 for i in range(3)])) ^ (k and zlib.crc32(bytes(3))) for b in range(256)]) for k in range(3)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def pieces_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of all words in a row, and how many each word has: of its bytes between two marks, at least one."""
    own = [w.encode() for w in words]
    size = np.array([len(w) for w in own], np.int64)
    many = np.maximum(size, 1)
    buf = np.frombuffer(b"<" + b"><".join(own) + b">\0", np.uint8)
    hashed = (CRC[0][buf[:-2]] ^ CRC[1][buf[1:-1]] ^ CRC[2][buf[2:]]) % TRIGRAMS
    begin = np.cumsum(size + 2) - (size + 2)
    return hashed[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())], many


def squash(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters p: words, chars (input vectors); wx, wh, b by direction; att, ctx (attention); out, bias."""

    def __init__(self, vocabulary: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.index = {w: i + 2 for i, w in enumerate(vocabulary)}  # 0 is padding, 1 an unknown word
        n = len(vocabulary) + 2
        g = lambda *s, k=0.2: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"words": g(n, INPUT), "chars": g(TRIGRAMS, INPUT), "wx": g(2, INPUT, 3 * SIZE), "wh": g(2, SIZE, 3 * SIZE), "b": g(2, 3 * SIZE, k=0), "att": g(2 * SIZE, SIZE), "ctx": g(SIZE), "out": g(2 * SIZE), "bias": g(1, k=0)}
        self.p["words"][:2] = 0
        self.share = 0.0  # of label 1, the score of a text without words

    def inputs(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, INPUT), np.float32)
        at, many = pieces_of(words)
        chars = np.add.reduceat(self.p["chars"][at], np.cumsum(many) - many) / many[:, None].astype(np.float32)
        return self.p["words"][[self.index.get(w, 1) for w in words]] + chars

    def gates(self, x: np.ndarray) -> np.ndarray:
        """The input side of the gates, both directions: (words, 2, 3 SIZE)."""
        return np.stack([x @ self.p["wx"][d] + self.p["b"][d] for d in (0, 1)], axis=1)

    def states(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """gates (n, T, 2, 3 SIZE), mask (n, T) -> states (n, T, 2 SIZE), and what the backward pass needs."""
        n, steps = mask.shape
        out, memo = np.zeros((n, steps, 2 * SIZE), np.float32), []
        for d in (0, 1):
            h, wh = np.zeros((n, SIZE), np.float32), self.p["wh"][d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x, m = gates[:, t, d], mask[:, t, None]
                zr = squash(x[:, : 2 * SIZE] + h @ wh[:, : 2 * SIZE])
                z, r = zr[:, :SIZE], zr[:, SIZE:]
                c = np.tanh(x[:, 2 * SIZE :] + (r * h) @ wh[:, 2 * SIZE :])
                if keep:
                    memo.append((d, t, h, z, r, c))
                h = h + m * z * (c - h)
                out[:, t, d * SIZE : (d + 1) * SIZE] = h
        return out, memo

    def pooled(self, states: np.ndarray, mask: np.ndarray):
        u = np.tanh(states @ self.p["att"])
        a = u @ self.p["ctx"] + (mask - 1) * 30
        a = np.exp(a - a.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        v = (a[:, :, None] * states).sum(axis=1)
        return u, a, v, v @ self.p["out"] + self.p["bias"][0]

    def learn(self, windows: list[list[str]], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        p, n, steps = self.p, len(windows), WINDOW
        flat = [w for x in windows for w in x]
        kinds = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        names = list(kinds)
        x = self.inputs(names)
        ids, mask = np.zeros((n, steps), int), np.zeros((n, steps), np.float32)
        for k, win in enumerate(windows):
            ids[k, : len(win)], mask[k, : len(win)] = [kinds[w] for w in win], 1
        gates = self.gates(x)[ids] if names else np.zeros((n, steps, 2, 3 * SIZE), np.float32)
        h, memo = self.states(gates, mask, keep=True)
        u, a, v, logit = self.pooled(h, mask)
        grad = {k: np.zeros_like(w) for k, w in p.items()}
        dl = ((squash(logit) - labels) / n).astype(np.float32)
        grad["out"], grad["bias"] = v.T @ dl, np.array([dl.sum()], np.float32)
        dv = dl[:, None] * p["out"]
        dh = a[:, :, None] * dv[:, None, :]
        da = (h * dv[:, None, :]).sum(axis=2)
        ds = a * (da - (a * da).sum(axis=1, keepdims=True))
        grad["ctx"] = (u * ds[:, :, None]).sum(axis=(0, 1))
        du = ds[:, :, None] * p["ctx"] * (1 - u * u)
        grad["att"] = np.einsum("nti,ntj->ij", h, du)
        dh += du @ p["att"].T
        dgates, carry = np.zeros_like(gates), [np.zeros((n, SIZE), np.float32) for _ in (0, 1)]
        for d, t, before, z, r, c in reversed(memo):
            wh, m = p["wh"][d], mask[:, t, None]
            g = dh[:, t, d * SIZE : (d + 1) * SIZE] + carry[d]
            dz, dc = g * m * (c - before) * z * (1 - z), g * m * z * (1 - c * c)
            back = dc @ wh[:, 2 * SIZE :].T
            dr = back * before * r * (1 - r)
            dgates[:, t, d] = np.concatenate([dz, dr, dc], axis=1)
            zr = np.concatenate([dz, dr], axis=1)
            grad["wh"][d, :, : 2 * SIZE] += before.T @ zr
            grad["wh"][d, :, 2 * SIZE :] += (r * before).T @ dc
            carry[d] = g * (1 - m * z) + back * r + zr @ wh[:, : 2 * SIZE].T
        grad["b"] = dgates.sum(axis=(0, 1))
        by_word = np.zeros((len(names), 2, 3 * SIZE), np.float32)
        np.add.at(by_word, ids[mask > 0], dgates[mask > 0])
        dx = np.zeros_like(x)
        for d in (0, 1):
            grad["wx"][d] = x.T @ by_word[:, d]
            dx += by_word[:, d] @ p["wx"][d].T
        if names:
            at, many = pieces_of(names)
            np.add.at(grad["chars"], at, np.repeat(dx / many[:, None].astype(np.float32), many, axis=0))
            np.add.at(grad["words"], [self.index.get(w, 1) for w in names], dx)
            grad["words"][:2] = 0
        return grad

    def logits(self, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.pooled(self.states(gates, mask)[0], mask)[3]


    def sliding(self, gates: np.ndarray, stride: int = STRIDE) -> np.ndarray:
        """The logits of the windows over gates (positions, 2, 3 SIZE) that begin at every stride-th position."""
        n, p = (len(gates) - WINDOW) // stride + 1, self.p
        scale = np.repeat(np.array([-1, 2], np.float32), [2 * SIZE, SIZE])  # squash(x) is 1 / (1 + exp(-x)), tanh(x) is 1 - 2 / (1 + exp(2 x))
        if len(gates) % stride:
            gates = np.concatenate([gates, np.zeros((-len(gates) % stride, 2, 3 * SIZE), np.float32)])
        # by direction, gate and place in a stride, so that a step reads neighbours
        x = np.empty((2, stride, 3 * SIZE, len(gates) // stride), np.float32)
        np.multiply(gates.reshape(-1, stride, 2, 3 * SIZE).transpose(2, 1, 3, 0), scale[:, None], out=x)
        att, out = np.zeros((WINDOW, SIZE, n), np.float32), np.zeros((WINDOW, n), np.float32)
        seen, zr = np.empty((3 * SIZE + 1, n), np.float32), np.empty((2 * SIZE, n), np.float32)
        c, rh = np.empty((SIZE, n), np.float32), np.empty((SIZE, n), np.float32)
        with np.errstate(over="ignore"):
            for d in (0, 1):
                wh, own = (p["wh"][d] * scale).T, slice(d * SIZE, (d + 1) * SIZE)
                # one product of a state gives the gates of the next step and what it says to attention and outcome
                looks, cell = np.vstack([wh[: 2 * SIZE], p["att"][own].T, p["out"][None, own]]), wh[2 * SIZE :].copy()
                h, before = np.zeros((SIZE, n), np.float32), None
                for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                    read = x[d, t % stride, :, t // stride : t // stride + n]
                    np.matmul(looks, h, out=seen)
                    if before is not None:
                        att[before] += seen[2 * SIZE : 3 * SIZE]
                        out[before] += seen[3 * SIZE]
                    before = t
                    np.add(seen[: 2 * SIZE], read[: 2 * SIZE], out=zr)
                    np.exp(zr, out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    np.multiply(zr[SIZE:], h, out=rh)
                    np.matmul(cell, rh, out=c)
                    c += read[2 * SIZE :]
                    np.exp(c, out=c)
                    c += 1
                    np.divide(-2, c, out=c)
                    c += 1
                    c -= h
                    c *= zr[:SIZE]
                    h += c
                np.matmul(looks, h, out=seen)
                att[before] += seen[2 * SIZE : 3 * SIZE]
                out[before] += seen[3 * SIZE]
        a = np.einsum("i,tin->tn", p["ctx"], np.tanh(att, out=att))
        a = np.exp(a - a.max(axis=0))
        return (a * out).sum(axis=0) / a.sum(axis=0) + p["bias"][0]


def starts_of(n: int) -> list[int]:
    """Where the windows of a text of n words begin: every STRIDE-th word, and the last place."""
    last = max(0, n - WINDOW)
    return [*range(0, last, STRIDE), last]


class Scorer:
    """Scores texts by a fitted network; keeps the gate inputs of the words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self):
        self.at, self.size = {}, 1
        self.table = np.zeros((1024, 2, 3 * SIZE), np.float32)

    def ids(self, words: list[str]) -> list[int]:
        ids = list(map(self.at.get, words))
        if None not in ids:
            return ids
        new = list(dict.fromkeys([w for w, i in zip(words, ids) if i is None]))
        while self.size + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.size : self.size + len(new)] = self.net.gates(self.net.inputs(new))
        self.at.update(zip(new, range(self.size, self.size + len(new))))
        self.size += len(new)
        return list(map(self.at.__getitem__, words))

    def along(self, ids: np.ndarray) -> np.ndarray:
        """The logits of the windows of ids that begin at every STRIDE-th position."""
        n = (len(ids) - WINDOW) // STRIDE + 1
        return np.concatenate([self.net.sliding(self.table[ids[STRIDE * i : STRIDE * (min(i + AT_ONCE, n) - 1) + WINDOW]]) for i in range(0, n, AT_ONCE)])

    def highest(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each text's highest window, and the word it begins at; texts is an iterable of word lists."""
        top, start = {}, {}
        flat, spans, short = [], [], []

        def run():
            if short:
                ids = np.zeros((len(short), WINDOW), np.int64)
                for i, (_, w) in enumerate(short):
                    ids[i, : len(w)] = w
                for (k, _), x in zip(short, self.net.logits(self.table[ids], (ids > 0).astype(np.float32))):
                    top[k], start[k] = x, 0
            if spans:
                # windows over the end of a text are passed over
                logit = self.along(np.array(flat, np.int64))
                for k, begins, places in spans:
                    own = logit[places]
                    best = int(own.argmax())
                    start[k], top[k] = begins[best], own[best]
            for x in (flat, spans, short):
                x.clear()
            # ids are valid until here
            if self.size > TABLE:
                self.reset()

        k = -1
        for k, words in enumerate(texts):
            ids = self.ids(words)
            if len(ids) < WINDOW:
                short.append((k, ids))
            else:
                begins = starts_of(len(ids))
                at, regular = len(flat) // STRIDE, len(begins) - 1 + (begins[-1] % STRIDE == 0)
                places = [*range(at, at + regular)]
                flat += ids
                flat += [0] * (-len(flat) % STRIDE)
                if regular < len(begins):
                    # the last window again, where a stride begins
                    places.append(len(flat) // STRIDE)
                    flat += ids[-WINDOW:]
                    flat += [0] * (-len(flat) % STRIDE)
                spans.append((k, begins, places))
            if len(flat) >= 4 * STRIDE * AT_ONCE or len(short) >= AT_ONCE or self.size > TABLE:
                run()
        run()
        return np.array([top[i] for i in range(k + 1)], float), np.array([start[i] for i in range(k + 1)], int)

    def scores(self, texts) -> np.ndarray:
        """The highest window's probability of each text; texts is an iterable, of which few are held at once."""
        some = []

        def split():
            for text in texts:
                words = words_of(text)
                some.append(len(words) > 0)
                yield words

        said = squash(self.highest(split())[0])
        return np.where(some, said, self.net.share)


def scored_batch(batch: pa.RecordBatch, scorer: Scorer | None, constant) -> np.ndarray:
    """A score for each row. A batch may have many MB of text, and its words take ten times that, so texts are read one by one."""
    return scorer.scores(x.as_py() for x in batch.column("text")) if scorer else np.full(batch.num_rows, constant)


def fit(labelled: list[tuple[str, int]], seed: int = SEED) -> Network | float:
    """A network from (text, label) rows; a constant if there are not both labels."""
    labels = np.array([y for _, y in labelled])
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.0
    r = np.random.default_rng(seed)
    # one object for a word, however often it is there
    same: dict[str, str] = {}
    texts = [[same.setdefault(w, w) for w in words_of(t)[:FIT_WORDS]] for t, _ in labelled]
    kinds = [Counter(w for t, y in zip(texts, labels) if y == k for w in set(t)) for k in (0, 1)]
    n = [int((labels == k).sum()) for k in (0, 1)]
    odds = {w: np.log((kinds[1][w] + 0.5) / (n[1] + 1)) - np.log((kinds[0][w] + 0.5) / (n[0] + 1)) for w in kinds[1] | kinds[0]}
    # words that say most come first into the vocabulary
    weight = {w: abs(o) * (kinds[0][w] + kinds[1][w]) ** 0.5 for w, o in odds.items() if kinds[0][w] + kinds[1][w] > 2}
    net = Network(sorted(weight, key=lambda w: (-weight[w], w))[:VOCABULARY], seed)
    net.share = float(labels.mean())
    last = [max(0, len(t) - WINDOW) for t in texts]
    # the word that says most lies in the middle, or as near to it as the text allows
    best = [int(np.argmax([odds[w] * (kinds[1][w] > 2) for w in t])) if t else 0 for t in texts]
    begin = [min(max(0, b - WINDOW // 2), end) for b, end in zip(best, last)]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    by_label, step = [np.flatnonzero(labels == k) for k in (0, 1)], 0
    for round_ in range(ROUNDS):
        if round_:
            begin = Scorer(net).highest(texts)[1].tolist()
        for _ in range(STEPS):
            pick = np.concatenate([r.choice(by_label[1], BATCH // 3), r.choice(by_label[0], BATCH - BATCH // 3)])
            at = [begin[i] if labels[i] or r.random() < 0.6 else r.integers(last[i] + 1) for i in pick]
            wins = [texts[i][k : k + WINDOW] for i, k in zip(pick, at)]
            step += 1
            for k, g in net.learn(wins, labels[pick]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Network | float:
    """The network, learned from a bounded number of labelled rows that are not held out."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    key = F.xxhash64("doc_id").alias("fit_hash")
    chosen = marked.select("doc_id", "toxic", key).orderBy("fit_hash", "doc_id", "toxic").limit(fit_rows).drop("fit_hash")
    # at most fit_rows narrow rows, so they are the side to send; documents that share an id are no more rows either
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("text")).limit(fit_rows).collect()
    return fit([(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.toxic, r.text or ""))])


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, row_hash, held_out, score, predicted of every row; row_hash tells rows that share a doc_id apart."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, fit_rows))

    def work(batches):
        scorer = None if isinstance(model.value, float) else Scorer(model.value)
        for batch in batches:
            score = scored_batch(batch, scorer, model.value)
            yield {c: batch.column(c) for c in ("doc_id", "row_hash", "held_out")} | {"score": score, "predicted": (score >= THRESHOLD).astype("i4")}

    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), held_out().alias("held_out"), "text")
    return mapped(rows, work, "doc_id long, row_hash long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, all columns, that are not predicted to be toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, fit_rows))

    def task(batches):
        scorer = None if isinstance(model.value, float) else Scorer(model.value)
        for batch in batches:
            score = scored_batch(batch, scorer, model.value)
            yield batch.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(task, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    return scored(docs, labels, fit_rows).drop("row_hash")
