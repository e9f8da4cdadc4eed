"""Toxicity scores from a bidirectional gated recurrent network, trained in numpy.

A word's input is its own embedding beside the mean embedding of its character
3- and 4-grams, both hashed. Two gated recurrent layers read a window of words
in either direction, attention pools their states, and a logistic unit scores
the window. A text is scored by its highest window; windows overlap by a
quarter and cover the whole text.

Training sees labelled documents only, at most ``TRAINING_DOCS`` per label,
those with the least hashed ids. A document's label is taken to be that of its
most toxic window, chosen anew in every epoch. One dimension of each embedding
starts at the (shrunken) log odds of its bucket in toxic and other training
documents.

Scoring runs where the texts are, a slice of rows at a time; the weights, a
few MB whatever the data, are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SLICE_BYTES, map_rows

TRAINING_DOCS = 1500
WORD_BUCKETS = GRAM_BUCKETS = 1 << 14
WORD_SIZE = GRAM_SIZE = 8
HIDDEN = 8
ATTENTION = 8
WINDOW, STRIDE = 48, 36
EPOCHS, BATCH, RATE = 6, 64, 0.01
# Share of words whose own embedding is left out in a batch.
UNKNOWN = 0.4
# Windows that a clean document gives per epoch, its most suspicious ones.
HARD = 2
SEED = 3
# Words whose inputs a task remembers, and windows it scores at a time.
REMEMBERED, AT_A_TIME = 200_000, 2048
# What a row takes besides its text, in bytes.
ROW_BYTES = 64

FOLDS = 5
WAYS = ("ahead", "back")

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def tokens(text: str | None) -> list[str]:
    """Lower-case words, with the marks around them."""
    return (text or "").lower().split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _hashed_grams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character 3- and 4-grams, word after word, and how many each has."""
    sizes = np.array([len(w) + 2 for w in words])
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner, ends = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
    place, found, owners = np.arange(len(codes)), [], []
    for n in (3, 4):
        value = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint64)
        for k in range(n):
            value = (value ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        inside = place[: len(value)] + n <= ends[: len(value)]
        found.append((value[inside] % np.uint64(GRAM_BUCKETS)).astype(np.int64))
        owners.append(owner[: len(value)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(words))


class Words(dict):
    """Numbers of words as they stand in texts; marks around a word do not count for its buckets."""

    def __init__(self) -> None:
        self.own = self.grams = self.sizes = np.empty(0, np.int64)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word if word.isalnum() else _EDGES.sub("", word) or word)
        return number

    def number(self, words: Sequence[str]) -> np.ndarray:
        return np.array([self[w] for w in words], dtype=np.int32)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own buckets, grams and numbers of grams of the words met since the last call."""
        if not self.fresh:
            return (np.empty(0, np.int64),) * 3
        own = np.array([xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in self.fresh])
        grams, sizes = _hashed_grams(self.fresh)
        self.fresh = []
        return own, grams, sizes


def windows(lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words) of every window and each text's first window; texts lie end to end."""
    lengths = np.asarray(lengths, dtype=np.int64)
    counts = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    offsets = np.cumsum(lengths) - lengths
    first = np.cumsum(counts) - counts
    inner = (np.arange(counts.sum()) - np.repeat(first, counts)) * STRIDE
    return np.repeat(offsets, counts) + inner, np.minimum(WINDOW, np.repeat(lengths, counts) - inner), first


class Network:
    """The weights, and how windows are scored and learned from."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        size = WORD_SIZE + GRAM_SIZE

        def start(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.w: dict[str, np.ndarray] = {
            "words": (0.05 * rng.normal(size=(WORD_BUCKETS, WORD_SIZE))).astype(np.float32),
            "grams": (0.05 * rng.normal(size=(GRAM_BUCKETS, GRAM_SIZE))).astype(np.float32),
            "att": start(2 * HIDDEN, ATTENTION),
            "att_b": np.zeros(ATTENTION, np.float32),
            "att_v": start(ATTENTION),
            "out": start(2 * HIDDEN),
            "out_b": np.zeros(1, np.float32),
        }
        for way in WAYS:
            self.w |= {
                f"{way}_x": start(size, 3 * HIDDEN),
                f"{way}_h": start(HIDDEN, 3 * HIDDEN),
                f"{way}_b": np.zeros(3 * HIDDEN, np.float32),
            }

    def inputs(self, own: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The input vectors of words; every word has a gram at least."""
        starts = np.cumsum(sizes) - sizes
        means = np.add.reduceat(self.w["grams"][grams], starts, axis=0) / sizes[:, None] if len(sizes) else np.empty((0, GRAM_SIZE))
        return np.concatenate((self.w["words"][own], means), axis=1).astype(np.float32)

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """What words add to the gates of either direction, and a last row for no word."""
        none = np.zeros((1, 3 * HIDDEN), np.float32)
        return {way: np.concatenate((inputs @ self.w[f"{way}_x"] + self.w[f"{way}_b"], none)) for way in WAYS}

    def _read(self, gates: dict[str, np.ndarray], ids: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (place, window, unit); places without a word (the last id) leave the state as it is."""
        table, recur = gates[way], self.w[f"{way}_h"]
        none = len(table) - 1
        places = range(ids.shape[1]) if way == "ahead" else range(ids.shape[1] - 1, -1, -1)
        state = np.zeros((len(ids), HIDDEN), np.float32)
        out = np.empty((ids.shape[1], len(ids), HIDDEN), np.float32)
        for t in places:
            x, own = table[ids[:, t]], state @ recur
            rz = _sigmoid(x[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
            after, there = new + z * (state - new), (ids[:, t] != none)[:, None]
            if not there.all():
                after = np.where(there, after, state)
            if keep is not None:
                keep.append((t, state, own, r, z, new, there))
            state = out[t] = after
        return out

    def _pool(self, states: np.ndarray, there: np.ndarray) -> tuple:
        hidden = np.tanh(states @ self.w["att"] + self.w["att_b"])
        raw = np.where(there, hidden @ self.w["att_v"], np.float32(-1e9))
        share = np.exp(raw - raw.max(axis=0)) * there
        share /= np.maximum(share.sum(axis=0), np.float32(1e-9))
        return hidden, share, (share[:, :, None] * states).sum(axis=0)

    def logits(self, gates: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._read(gates, ids, way) for way in WAYS], axis=2)
        _, _, pooled = self._pool(states, (ids != len(gates["ahead"]) - 1).T)
        return pooled @ self.w["out"] + self.w["out_b"][0]

    def text_logits(self, gates: dict[str, np.ndarray], ids: np.ndarray, lengths: Sequence[int]) -> tuple:
        """The logit of every window and each text's first window."""
        begin, size, first = windows(lengths)
        none, out = len(gates["ahead"]) - 1, np.empty(len(begin), np.float32)
        padded = np.concatenate((ids, np.full(WINDOW, none, dtype=ids.dtype)))
        for at in range(0, len(begin), AT_A_TIME):
            part = slice(at, at + AT_A_TIME)
            grid = padded[begin[part, None] + np.arange(WINDOW)]
            grid = np.where(np.arange(WINDOW) < size[part, None], grid, none)
            out[part] = self.logits(gates, grid)
        return out, first, begin, size

    def gradients(
        self, words: Words, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, known: np.ndarray | None = None
    ) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss of windows; id -1 is no word.

        ``known`` says by word number which embeddings count; the others are
        zero, so that their characters must tell.
        """
        w, H = self.w, HIDDEN
        used, local = np.unique(ids, return_inverse=True)
        local = local.reshape(ids.shape).astype(np.int64)
        used = used[1:] if used[0] < 0 else used
        local = np.where(ids < 0, len(used), local - (1 if (ids < 0).any() else 0))
        own, sizes = words.own[used], words.sizes[used]
        starts = (np.cumsum(words.sizes) - words.sizes)[used]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grams = words.grams[np.repeat(starts, sizes) + within]
        inputs = self.inputs(own, grams, sizes)
        if known is not None:
            inputs[:, :WORD_SIZE] *= known[used, None]
        gates = self.gates(inputs)
        kept = {"ahead": [], "back": []}
        states = np.concatenate([self._read(gates, local, way, kept[way]) for way in WAYS], axis=2)
        there = (local != len(used)).T
        hidden, share, pooled = self._pool(states, there)
        slope = (_sigmoid(pooled @ w["out"] + w["out_b"][0]) - labels) * weights
        g = {"out": pooled.T @ slope, "out_b": slope.sum(keepdims=True)}
        d_pooled = slope[:, None] * w["out"]
        d_states = share[:, :, None] * d_pooled
        d_share = (states * d_pooled).sum(axis=2)
        d_raw = share * (d_share - (share * d_share).sum(axis=0))
        g["att_v"] = (hidden * d_raw[:, :, None]).sum(axis=(0, 1))
        d_hidden = d_raw[:, :, None] * w["att_v"] * (1 - hidden**2)
        g["att"] = np.tensordot(states, d_hidden, axes=((0, 1), (0, 1)))
        g["att_b"] = d_hidden.sum(axis=(0, 1))
        d_states = d_states + d_hidden @ w["att"].T
        d_inputs = np.zeros_like(inputs)
        for way, side in (("ahead", slice(0, H)), ("back", slice(H, 2 * H))):
            d_gates = np.zeros((len(used) + 1, 3 * H), np.float32)
            g[f"{way}_h"] = np.zeros_like(w[f"{way}_h"])
            carry = np.zeros((len(ids), H), np.float32)
            for t, state, own_part, r, z, new, word in reversed(kept[way]):
                d_after = d_states[t, :, side] + carry
                d_new = np.where(word, d_after * (1 - z), 0) * (1 - new**2)
                d_z = np.where(word, d_after * (state - new), 0) * z * (1 - z)
                d_r = d_new * own_part[:, 2 * H :] * r * (1 - r)
                d_own = np.concatenate((d_r, d_z, d_new * r), axis=1)
                g[f"{way}_h"] += state.T @ d_own
                np.add.at(d_gates, local[:, t], np.concatenate((d_r, d_z, d_new), axis=1))
                carry = np.where(word, d_after * z, d_after) + d_own @ w[f"{way}_h"].T
            d_gates = d_gates[:-1]
            g[f"{way}_x"], g[f"{way}_b"] = inputs.T @ d_gates, d_gates.sum(axis=0)
            d_inputs += d_gates @ w[f"{way}_x"].T
        if known is not None:
            d_inputs[:, :WORD_SIZE] *= known[used, None]
        g["words"] = np.zeros_like(w["words"])
        np.add.at(g["words"], own, d_inputs[:, :WORD_SIZE])
        g["grams"] = np.zeros_like(w["grams"])
        np.add.at(g["grams"], grams, np.repeat(d_inputs[:, WORD_SIZE:] / sizes[:, None], sizes, axis=0))
        return g


def _log_odds(rows: list[np.ndarray], labels: np.ndarray, buckets: int) -> np.ndarray:
    """Per bucket, how much likelier toxic documents have it; little for what few documents have."""
    seen = np.zeros((2, buckets))
    for row, label in zip(rows, labels):
        seen[int(label), np.unique(row)] += 1
    toxic, clean = labels.sum(), len(labels) - labels.sum()
    odds = np.log((seen[1] + 0.5) / (toxic + 1)) - np.log((seen[0] + 0.5) / (clean + 1))
    total = seen.sum(axis=0)
    return (np.clip(odds, -3, 3) * total / (total + 5)).astype(np.float32)


def train(texts: list[str | None], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network learned from labelled texts; with one label only it always scores low (or high)."""
    net, labels = Network(seed), np.array(toxic, dtype=np.float32)
    # Clean texts without a word say how to score them.
    texts, blank = [*texts, *[""] * (1 + len(texts) // 20)], 1 + len(texts) // 20
    if not len(labels) or labels.min() == labels.max():
        net.w["out"][:] = 0
        net.w["out_b"][:] = 4.0 if len(labels) and labels.min() > 0 else -4.0
        return net
    labels = np.concatenate((labels, np.zeros(blank, np.float32)))
    words = Words()
    rows = [words.number(tokens(text)) for text in texts]
    lengths = [len(r) for r in rows]
    ids = np.concatenate(rows) if rows else np.empty(0, np.int32)
    words.own, words.grams, words.sizes = words.settle()
    if not len(ids):
        return train([], [])
    starts = np.cumsum(words.sizes) - words.sizes
    owns = [words.own[r] for r in rows]
    grams = [
        np.concatenate([words.grams[s : s + n] for s, n in zip(starts[u], words.sizes[u])]) if len(u) else u
        for u in map(np.unique, rows)
    ]
    net.w["words"][:, 0] = 0.5 * _log_odds(owns, labels, WORD_BUCKETS)
    net.w["grams"][:, 0] = 0.5 * _log_odds(grams, labels, GRAM_BUCKETS)
    rng = np.random.default_rng(seed + 1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    share = labels.mean()
    step = 0
    for epoch in range(epochs):
        inputs = net.inputs(words.own, words.grams, words.sizes)
        begin, size, first = windows(lengths)
        if epoch:
            scores = net.text_logits(net.gates(inputs), ids, lengths)[0]
        else:  # before anything is learned: the most telling word
            telling = np.concatenate((inputs[ids, 0] + inputs[ids, WORD_SIZE], np.full(WINDOW, -9, np.float32)))
            grid = telling[begin[:, None] + np.arange(WINDOW)]
            scores = np.where(np.arange(WINDOW) < size[:, None], grid, -9).max(axis=1)
        chosen, owner = [], []
        for doc, start in enumerate(first):
            stop = first[doc + 1] if doc + 1 < len(first) else len(begin)
            best = start + np.argsort(-scores[start:stop], kind="stable")[: 1 if labels[doc] else HARD]
            chosen += best.tolist()
            owner += [doc] * len(best)
        chosen, owner = np.array(chosen), np.array(owner)
        order = rng.permutation(len(chosen))
        padded = np.concatenate((ids.astype(np.int64), np.full(WINDOW, -1)))
        for at in range(0, len(order), BATCH):
            part = chosen[order[at : at + BATCH]]
            label = labels[owner[order[at : at + BATCH]]]
            grid = padded[begin[part, None] + np.arange(WINDOW)]
            grid = np.where(np.arange(WINDOW) < size[part, None], grid, -1)
            if (grid < 0).all():
                continue
            weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share) / HARD).astype(np.float32) / len(part)
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * (1 - 0.8 * epoch / epochs)
            known = rng.random(len(words)) >= UNKNOWN
            for name, slope in net.gradients(words, grid, label, weight, known).items():
                m, v = moments[name]
                m += 0.1 * (slope - m)
                v += 0.001 * (slope**2 - v)
                net.w[name] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores texts, remembering the inputs of words it has met."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.words, self.gates = Words(), self.net.gates(np.empty((0, WORD_SIZE + GRAM_SIZE), np.float32))

    def __call__(self, texts: Sequence[str | None]) -> list[float]:
        if len(self.words) > REMEMBERED:
            self._forget()
        rows = [self.words.number(tokens(text)) for text in texts]
        own, grams, sizes = self.words.settle()
        if len(own):
            new = self.net.gates(self.net.inputs(own, grams, sizes))
            self.gates = {way: np.concatenate((self.gates[way][:-1], new[way])) for way in WAYS}
        logits, first, _, _ = self.net.text_logits(self.gates, np.concatenate(rows), [len(r) for r in rows])
        best = np.maximum.reduceat(logits, first).astype(np.float64)
        return (1 / (1 + np.exp(-best))).tolist()


# ---------------------------------------------------------------- on Spark


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text (null: '') is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_texts(docs: DataFrame, labels: DataFrame, per_label: int = TRAINING_DOCS) -> tuple[list, list]:
    """Texts and labels of at most ``per_label`` documents of each label, none of them held out.

    A doc_id with several labels counts as toxic if one says so; one with
    several texts gives the first in order.
    """
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [one.filter(F.col("toxic") == k).orderBy(*order).limit(per_label) for k in (0, 1)]
    both = chosen[0].unionByName(chosen[1])  # at most 2 * per_label rows, whatever the data
    rows = docs.select("doc_id", "text").join(F.broadcast(both), "doc_id").groupBy("doc_id")
    found = rows.agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return [x["text"] for x in found], [int(x["toxic"]) for x in found]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row of ``docs``.

    A null or empty text is scored as a window without words. Repeated rows
    score alike, a null doc_id stays, an empty table gives an empty result, and
    other columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(net)

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        scorer, held, size = Scorer(weights.value), [], 0
        for row in rows:
            held.append(row)
            # A row without text takes room, too.
            size += ROW_BYTES + len(row["text"] or "")
            if size > SLICE_BYTES // 4:
                yield from scored(scorer, held)
                held, size = [], 0
        if held:
            yield from scored(scorer, held)

    def scored(scorer: Scorer, held: list[dict]) -> Iterator[dict]:
        for row, value in zip(held, scorer([x["text"] for x in held])):
            yield {"doc_id": row["doc_id"], "score": value}

    return map_rows(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def judge(docs: DataFrame, labels: DataFrame, per_label: int = TRAINING_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, by a network trained on ``labels``."""
    net = train(*training_texts(docs, labels, per_label))
    rows = score(docs, net)
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )
