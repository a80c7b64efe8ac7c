"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Input of each word: an embedding of the word (of a vocabulary learned from the
training rows, others share one) and the mean embedding of its character
runs of 3 and 5 bytes. Two GRUs read a window of WINDOW words from both ends, attention
pools their states, a logistic unit gives the window's probability. Windows
start every STEP words, so all overlap and every word is scored; a document's
score is that of its most toxic window.

Training is numpy on the driver, over a bounded sample of labelled rows: at
most `train_docs` documents of each class (those whose hashed ids are
smallest) and `train_windows` windows of each. A toxic document is not toxic
throughout: at first its windows with a word typical of toxic ones count as
toxic, after two passes those that the network takes for it. A fifth of the
documents of each class calibrates instead of training, on their largest
logits over all their windows, as in scoring. Scoring covers all rows and all text,
in tasks that share nothing, so a hot source or a lost executor costs nothing
more.

Empty and NULL texts score 0. NULL ids count as the empty string for the hold-
out. Without labels of both classes every score is 0. Repeated rows score
alike; a document with several labels counts as toxic if one says so.
Texts are scored whole,
window by window, however long. An empty table gives no rows. Only the id, the text and the labels' id and
`toxic` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import claim, narrow, pieces

WINDOW, STEP = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 12, 12, 8, 8
VOCABULARY, GRAMS = 8192, 1 << 14
BLOCK_BYTES = 1_500_000
#: Windows in one matrix product.
BATCH = 2048
EDGE = b" \t.,;:!?\"'()[]{}<>*#$%&+-_=/\\|~^`@0123456789"


def normal(word: bytes) -> bytes:
    """Lower case, without signs and digits at the ends."""
    lowered = word.lower() if word.isascii() else word.decode("utf-8", "replace").lower().encode()
    return lowered.strip(EDGE)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of 3 and of 5 bytes of <word, and where each word's begin; a word has two at least."""
    joined = np.frombuffer(b"".join(b"<" + w + b">>>>" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 5 for w in words), np.int64, len(words))
    inside = np.ones(len(joined), bool)
    ends = np.cumsum(sizes)
    for back in range(1, 5):
        inside[ends - back] = False
    short = (joined[:-4] << 16) | (joined[1:-3] << 8) | joined[2:-2]
    long = short * np.uint32(0x01000193) + ((joined[3:-1] << 8) | joined[4:]) + np.uint32(0x9E3779B9)
    codes = np.stack([short[inside[:-4]], long[inside[:-4]]], axis=1).ravel()
    codes ^= codes >> np.uint32(15)
    codes = (codes * np.uint32(2654435761)) >> np.uint32(18)
    counts = 2 * (sizes - 4)
    return codes.astype(np.int64), np.cumsum(counts) - counts


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STEP words, the last one reaching the end."""
    return np.arange(0, max(1, n - (WINDOW - STEP)), STEP) if n else np.zeros(0, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place and with exp alone, which numpy vectorizes well."""
    x = np.negative(x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    x = sigmoid(2 * x)
    x *= 2
    x -= 1
    return x


@dataclass
class Network:
    vocabulary: dict[bytes, int]  # 0: any other word
    weights: dict[str, np.ndarray]
    slope: float = 1.0  # from the largest logit to a document's log odds
    shift: float = 0.0

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        made = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        weights = {"word": np.zeros((len(vocabulary) + 1, WORD_DIM), np.float32), "char": made(GRAMS, CHAR_DIM, scale=0.05)}
        for side in "fb":
            weights["x" + side] = made(WORD_DIM + CHAR_DIM, 3 * HIDDEN, scale=0.3)
            weights["h" + side] = made(HIDDEN, 3 * HIDDEN, scale=0.3)
            weights["c" + side] = np.zeros(3 * HIDDEN, np.float32)
        weights |= {"attend": made(2 * HIDDEN, ATTEND, scale=0.3), "query": made(ATTEND, scale=0.3), "out": made(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        return cls(vocabulary, weights)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words, and what training needs of them."""
        clean = [normal(w) for w in words]
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in clean), np.int64, len(clean))
        codes, begin = grams(clean)
        counts = np.diff(np.append(begin, len(codes))).astype(np.float32)
        chars = np.add.reduceat(self.weights["char"][codes], begin, axis=0) / counts[:, None] if len(words) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.weights["word"][ids], chars], axis=1), (ids, codes, counts)

    def read(self, x: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. x: input vectors; at (windows, WINDOW): rows of x, -1 beyond the end."""
        w = self.weights
        padded = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        inside = at >= 0
        states = np.empty((WINDOW, len(at), 2 * HIDDEN), np.float32)
        kept: dict = {"f": [], "b": []}
        for side, order, low in (("f", range(WINDOW), 0), ("b", range(WINDOW - 1, -1, -1), HIDDEN)):
            projected = padded @ w["x" + side] + w["c" + side]
            h = np.zeros((len(at), HIDDEN), np.float32)
            for t in order:
                own, rec = projected[at[:, t]], h @ w["h" + side]
                gates = sigmoid(own[:, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                n = tanh(own[:, 2 * HIDDEN :] + r * rec[:, 2 * HIDDEN :])
                new = n + z * (h - n)
                if keep:
                    kept[side].append((t, h, z, r, n, rec[:, 2 * HIDDEN :]))
                h = new
                states[t, :, low : low + HIDDEN] = h
        seen = tanh(states @ w["attend"])
        weight = np.where(inside.T, seen @ w["query"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return pooled @ w["out"] + w["bias"][0], {"states": states, "seen": seen, "weight": weight, "pooled": pooled, "padded": padded, **kept}

    def gradients(self, words: list[bytes], at: np.ndarray, target: np.ndarray, share: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted cross entropy; also the logits."""
        w = self.weights
        x, (ids, codes, counts) = self.inputs(words)
        logits, k = self.read(x, at, keep=True)
        g = {name: np.zeros_like(v) for name, v in w.items()}
        d = ((sigmoid(logits) - target) * share).astype(np.float32)
        g["bias"][0], g["out"] = d.sum(), k["pooled"].T @ d
        d_pooled = d[:, None] * w["out"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, k["states"])
        d_logit = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(axis=0))
        g["query"] = np.einsum("tb,tba->a", d_logit, k["seen"])
        d_seen = d_logit[:, :, None] * w["query"] * (1 - k["seen"] ** 2)
        g["attend"] = np.einsum("tbh,tba->ha", k["states"], d_seen)
        d_states = k["weight"][:, :, None] * d_pooled + d_seen @ w["attend"].T
        d_padded = np.zeros_like(k["padded"])
        for side, low in (("f", 0), ("b", HIDDEN)):
            d_projected = np.zeros((len(k["padded"]), 3 * HIDDEN), np.float32)
            dh = np.zeros((len(at), HIDDEN), np.float32)
            for t, h, z, r, n, rec in reversed(k[side]):
                dh = dh + d_states[t, :, low : low + HIDDEN]
                dn = dh * (1 - z) * (1 - n * n)
                own = np.concatenate([dh * (h - n) * z * (1 - z), dn * rec * r * (1 - r), dn], axis=1)
                back = own.copy()
                back[:, 2 * HIDDEN :] *= r
                g["h" + side] += h.T @ back
                dh = dh * z + back @ w["h" + side].T
                np.add.at(d_projected, at[:, t], own)
            g["c" + side] = d_projected.sum(axis=0)
            g["x" + side] = k["padded"].T @ d_projected
            d_padded += d_projected @ w["x" + side].T
        dx = d_padded[:-1]
        np.add.at(g["word"], ids, dx[:, :WORD_DIM])
        g["word"][0] = 0
        np.add.at(g["char"], codes, np.repeat(dx[:, WORD_DIM:] / counts[:, None], counts.astype(np.int64), axis=0))
        return g, logits

    def largest(self, texts: list[str | None]) -> np.ndarray:
        """Logit of each text's most toxic window, -inf without words."""
        lists = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
        number: dict[bytes, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for w in chain.from_iterable(lists)], np.int64)
        most = np.full(len(texts), -np.inf)
        if not len(flat):
            return most
        x, _ = self.inputs(list(number))
        flat = np.append(flat, np.full(WINDOW, -1))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        begin = np.cumsum(sizes) - sizes
        starts = [windows_of(n) for n in sizes.tolist()]
        doc = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        start = np.concatenate(starts)
        logits = np.empty(len(doc))
        for low in range(0, len(doc), BATCH):
            d, s = doc[low : low + BATCH], start[low : low + BATCH]
            place = s[:, None] + np.arange(WINDOW)
            at = np.where(place < sizes[d][:, None], flat[np.minimum(begin[d][:, None] + place, len(flat) - 1)], -1)
            used, at = np.unique(at, return_inverse=True)  # inputs of this batch alone are projected
            pad = int(used[0] == -1)
            logits[low : low + BATCH] = self.read(x[used[pad:]], at.reshape(-1, WINDOW) - pad)[0]
        np.maximum.at(most, doc, logits)
        return most

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text's most toxic window, 0 without words."""
        most = self.largest(texts)
        some = np.isfinite(most)
        scores = np.zeros(len(texts))
        scores[some] = sigmoid(self.slope * most[some] + self.shift)
        return scores


#: A training window: document, words, its document's label.
Sample = tuple[int, list[bytes], int]


def telling(samples: list[Sample], share: float = 0.02, ratio: float = 8.0, docs: int = 4) -> list[bool]:
    """Windows of toxic documents with a word, or beginning of a word, that is typical of those.

    Typical: in a `share` of the toxic documents, `docs` at least, and `ratio` times as often as in others.
    """
    using: dict[int, dict[bytes, set[int]]] = {0: {}, 1: {}}
    all_docs: dict[int, set[int]] = {0: set(), 1: set()}

    def signs(words: list[bytes]) -> set[bytes]:
        clean = {normal(w) for w in words} - {b""}
        return {w + b">" for w in clean} | {w[:k] for w in clean for k in range(5, 9) if len(w) > k}

    for doc, words, toxic in samples:
        all_docs[toxic].add(doc)
        for sign in signs(words):
            using[toxic].setdefault(sign, set()).add(doc)
    n1, n0 = len(all_docs[1]), len(all_docs[0])
    typical = {s for s, found in using[1].items() if len(found) >= max(docs, share * n1) and len(found) / n1 >= ratio * (len(using[0].get(s, ())) + 1) / (n0 + 1)}
    return [bool(toxic) and not typical.isdisjoint(signs(words)) for _, words, toxic in samples]


def calibrate(net: Network, most: list[tuple[float, int]], toxic_share: float) -> None:
    """Fit slope and shift so that the score of a document's largest logit is its chance to be toxic.

    most: largest logit over all windows, and label, of documents that did not train; toxic_share: of all labelled documents.
    """
    x, y = np.array([v for v, _ in most]), np.array([t for _, t in most], float)
    if len(set(y.tolist())) < 2:
        return
    weight = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    design = np.stack([x, np.ones(len(x))], axis=1)
    fitted = np.array([0.5, 0.0])
    for _ in range(50):
        p = sigmoid(design @ fitted)
        slope = design.T @ (weight * (p - y)) + 0.1 * (fitted - [0.5, 0.0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        fitted = fitted - np.clip(np.linalg.solve(curve, slope), -1, 1)
    if fitted[0] > 0:
        net.slope, net.shift = float(fitted[0]), float(fitted[1])


def train(samples: list[Sample], seed: int = 7, batch: int = 192, rate: float = 0.02, eps: float = 1e-3, rare: int = 5) -> Network | None:
    """A network from windows, not calibrated; None without both classes. The order of the samples counts."""
    epochs = int(np.clip(-(-300 * batch // max(1, len(samples))), 3, 8))
    labels = np.array([y for _, _, y in samples])
    if len(set(labels.tolist())) < 2:
        return None
    often = Counter(chain.from_iterable({normal(w) for w in words} for _, words, _ in samples))
    common = sorted((w for w, n in often.items() if n >= rare and w), key=lambda w: (-often[w], w))[:VOCABULARY]
    net = Network.fresh({w: i + 1 for i, w in enumerate(common)}, seed)
    rng = np.random.default_rng(seed)
    target = np.array(telling(samples), np.float32)
    if not target.any():
        target = labels.astype(np.float32)
    first = {name: np.zeros_like(v) for name, v in net.weights.items()}
    second = {name: np.zeros_like(v) for name, v in net.weights.items()}
    step = 0
    for epoch in range(epochs):
        found = np.zeros(len(samples))
        balance = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
        order = rng.permutation(len(samples))
        for low in range(0, len(order), batch):
            chosen = order[low : low + batch]
            number: dict[bytes, int] = {}
            at = np.full((len(chosen), WINDOW), -1)
            for row, i in enumerate(chosen.tolist()):
                words = samples[i][1]
                at[row, : len(words)] = [number.setdefault(w, len(number)) for w in words]
            g, logits = net.gradients(list(number), at, target[chosen], balance[chosen] / len(chosen))
            found[chosen] = logits
            step += 1
            for name, value in net.weights.items():
                first[name] += 0.1 * (g[name] - first[name])
                second[name] += 0.01 * (g[name] ** 2 - second[name])
                value -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + eps)
        if epoch >= 1 and ((labels == 1) & (found > 0)).any():
            target = np.where((labels == 1) & (found > 0), 1, 0).astype(np.float32)
    return net


def held_out(id_column: Column) -> Column:
    """Rows that never train: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_documents(labels: DataFrame, train_docs: int, id_col: str = "doc_id", label_col: str = "toxic") -> tuple[dict[int, int], float]:
    """Labels of at most 2 * train_docs documents, in a fixed order, and the toxic share of all labelled documents."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marked.agg(F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("share")).first()["share"]
    chosen = None
    for kind in (1, 0):
        part = marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    return {r["doc_id"]: r["toxic"] for r in sorted(chosen.collect())}, share


def split(docs: dict[int, int], seed: int = 7) -> tuple[dict[int, int], dict[int, int]]:
    """Documents that train, and a fifth of each class that calibrates."""
    rng = np.random.default_rng(seed)
    spare: set[int] = set()
    for kind in (0, 1):
        ids = [d for d, toxic in docs.items() if toxic == kind]
        spare.update(rng.permutation(ids)[: len(ids) // 5].tolist())
    return {d: t for d, t in docs.items() if d not in spare}, {d: t for d, t in docs.items() if d in spare}


def texts_of(df: DataFrame, docs: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, toxic, text of the documents; there are at most 2 * train_docs ids, which bounds the broadcast."""
    chosen = df.sparkSession.createDataFrame(list(docs.items()), "doc_id long, toxic int")
    return narrow(df, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")


def training_windows(df: DataFrame, docs: dict[int, int], train_windows: int, id_col: str = "doc_id", text_col: str = "text") -> list[Sample]:
    """At most train_windows windows of each document, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "text", BLOCK_BYTES):
            rows = []
            for doc, toxic, text in zip(*(block[c].to_pylist() for c in ("doc_id", "toxic", "text"))):
                words = text.encode("utf-8", "replace").split() if text else []
                starts = windows_of(len(words))
                if len(starts) > train_windows:
                    starts = np.sort(np.random.default_rng(abs(doc)).choice(starts, train_windows, replace=False))
                rows += [(doc, toxic, s, b" ".join(words[s : s + WINDOW])) for s in starts.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "toxic", "start", "words"])

    rows = texts_of(df, docs, id_col, text_col).mapInArrow(run, "doc_id long, toxic int, start long, words binary").distinct().collect()
    return [(r["doc_id"], bytes(r["words"]).split(), r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"], bytes(r["words"])))]


def largest_logits(df: DataFrame, docs: dict[int, int], network: Network, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[float, int]]:
    """Largest logit over all windows, and label, of each document with words; one row of each comes back."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "text", BLOCK_BYTES):
            most = shared.value.largest(block["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([block["doc_id"], block["toxic"], pa.array(most)], ["doc_id", "toxic", "most"])

    found = texts_of(df, docs, id_col, text_col).mapInArrow(run, "doc_id long, toxic int, most double").where(F.col("most") > float("-inf"))
    rows = found.groupBy("doc_id", "toxic").agg(F.max("most").alias("most")).collect()
    return [(r["most"], r["toxic"]) for r in sorted(rows)]


def fit(df: DataFrame, labels: DataFrame, train_docs: int = 1500, train_windows: int = 12, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    docs, share = training_documents(labels, train_docs, id_col, label_col)
    training, spare = split(docs)
    net = train(training_windows(df, training, train_windows, id_col, text_col))
    if net and spare:
        calibrate(net, largest_logits(df, spare, net, id_col, text_col), share)
    return net


def score(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = df.sparkSession.sparkContext.broadcast(network)  # under 1 MB: bounded by VOCABULARY and GRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "text", BLOCK_BYTES):
            claim("toxicity", lambda: None)
            net = shared.value
            scores = net.score(block["text"].to_pylist()) if net else np.zeros(block.num_rows)
            yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array(scores)], ["doc_id", "score"])

    scored = narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, network: Network | None, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows that score below the limit, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, text_col, BLOCK_BYTES):
            claim("toxicity", lambda: None)
            net = shared.value
            yield block.filter(pa.array(net.score(block[text_col].to_pylist()) < limit)) if net else block

    return df.mapInArrow(run, df.schema)
