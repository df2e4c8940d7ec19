"""Scoring texts with a gated recurrent language model and a unigram base.

Words are split, counted and looked up by Arrow, some texts at once, and none becomes a Python object.  Word counts are of all
training documents, combined in each task and then by word.  The commonest ``HOT`` words go to the
tasks with their counts, which bounds what is broadcast; all other words of a text go, as one row for a document and
word, to an exact join with the counts table.

The model reads words, with a softmax factored into classes of words of like frequency, small ones of common words and large
ones of rare words (equal sums of the frequencies' roots), and is trained in numpy by truncated backpropagation.  The driver
starts it on a bounded sample (``TRAIN_ROWS`` documents, ``TRAIN_TOKENS`` tokens); each task then goes on from there over
all its training documents, and the tasks' changes are averaged, those of a word or class by how often each task met it.  The vocabulary is the commonest words and the end:
``VOCABULARY`` words, or the root of the training tokens if that is more, as far as ``HOT`` goes.  Any other word
is the unknown token times the word's smoothed share of the training tokens beyond the vocabulary.  A text is read
whole: windows bound the memory, and the state is carried from each to the next.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import crc_mod, materialize
from loam.llm.gru import Gru

HOT = 1 << 18
VOCABULARY = 8_000
SIZE = 16
TRAIN_ROWS = 3_000
TRAIN_TOKENS = 400_000
EPOCHS = 2
LEAST_STEPS = 150
STREAMS = 64
WINDOW = 16
#: Documents that a task learns from side by side, and its rate.
TASK_STREAMS = 512
TASK_RATE = 0.01
#: Numbers in a row of a task's changes, and tasks whose changes are summed together first.
CHUNK = 1 << 15
SUMMED = 64
#: Tokens scored side by side in a task, and steps between two softmaxes.
SCORE_TOKENS = 4_000_000
SCORE_WINDOW = 32
#: Bytes of text whose words a task holds at once.
PIECE = 1 << 23


def lm_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, one after another, with A to Z in lower case, and the bounds of each text's.  A null
    has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, bounds = split.flatten().cast(pa.binary()), split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    full = pc.binary_length(words).to_numpy() > 0
    if not full.all():  # between white space and a text's edge
        words, bounds = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[bounds]
    return words, bounds


def _pieces(texts: pa.Array, most: int = PIECE) -> Iterator[pa.Array]:
    """The texts in runs of about ``most`` bytes, which bounds what their words take."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // most)) + 1
    for i, j in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        yield texts[int(i) : int(j)]


def _ids(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The words' places in ``known``, -1 if they are not there."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()


def _encoded(texts: pa.Array, known: pa.Array, unknown: int) -> Iterator[np.ndarray]:
    """Each text's words by their places in ``known``; others are ``unknown``."""
    for piece in _pieces(texts):
        words, bounds = lm_words(piece)
        ids = _ids(words, known)
        yield from np.split(np.where(ids < 0, np.int32(unknown), ids), bounds[1:-1]) if len(piece) else ()


def _order(numbers: np.ndarray, below: int) -> np.ndarray:
    """A stable order; short numbers are sorted by digits, which is much faster."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def _by_class(group: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of tokens by class, and each class with the bounds of its tokens in that order."""
    order = _order(group, classes)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=classes))])
    met = np.flatnonzero(np.diff(bounds))
    return order, list(zip(met.tolist(), bounds[met].tolist(), bounds[met + 1].tolist(), strict=True))


def _ones(h: np.ndarray) -> np.ndarray:
    """States with a last column of ones, which the biases go with."""
    out = np.ones((len(h), h.shape[1] + 1), np.float32)
    out[:, :-1] = h
    return out


def _most(weights: np.ndarray) -> np.ndarray:
    """What each row of weights can come to: states are between -1 and 1."""
    return np.abs(weights) @ np.ones(weights.shape[1], np.float32)


def _exp(z: np.ndarray, most: float) -> np.ndarray:
    """Exponentials of rows up to a factor for each row.  The weights bound ``z`` by ``most``, and mostly no row has to be brought
    down first."""
    if most > 60:
        z -= z.max(1, keepdims=True)
    return np.exp(z, out=z)


def _softmax_loss(h: np.ndarray, weights: np.ndarray, picked: np.ndarray, share: np.float32, most: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the rows' cross-entropies, up to a factor for each row; the factors, which bring ``share`` in; and the sum."""
    z = _exp(h @ weights, most)
    total = z @ np.ones(z.shape[1], np.float32)
    flat, at = z.reshape(-1), np.arange(0, z.size, z.shape[1]) + picked
    own = flat.take(at)
    flat[at] = own - total
    return z, (share / total)[:, None], -float(np.log(own / total + np.float32(1e-12)).sum())


def _log_softmax(h: np.ndarray, weights: np.ndarray, picked: np.ndarray, most: float) -> np.ndarray:
    """Logarithm of the softmax at one column of each row; sums by products, which are faster than sums along rows."""
    z = h @ weights
    if most > 60:
        z -= z.max(1, keepdims=True)
    own = z.reshape(-1).take(np.arange(0, z.size, z.shape[1]) + picked)
    return own - np.log(np.maximum(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32), 1e-30))


def class_starts(frequencies: np.ndarray) -> np.ndarray:
    """First symbol of each class and the end; symbols come by frequency, and the last two are a class of their own."""
    words = len(frequencies) - 2
    classes = max(1, round(0.6 * math.sqrt(words))) if words else 0
    root = np.cumsum(np.sqrt(frequencies[:words] + 1e-9))
    cuts = np.searchsorted(root, root[-1] * np.arange(classes) / classes, side="left") if words else np.empty(0, int)
    return np.unique(np.concatenate([[0], cuts, [words, words + 2]])).astype(np.intp)


@dataclass
class Model:
    """Words are 0 to ``words`` - 1 by frequency, then the end, the unknown word and, as input only, the start."""

    words: int
    gru: Gru
    starts: np.ndarray
    class_w: np.ndarray  # by state and, last, bias
    word_w: np.ndarray  # a row a word, its bias last

    @classmethod
    def new(cls, frequencies: np.ndarray, size: int = SIZE, seed: int = 1) -> Model:
        """frequencies: of the words, the end and the unknown word; both softmaxes start at them."""
        rng = np.random.default_rng(seed)
        n, starts = len(frequencies), class_starts(frequencies)
        share = frequencies / frequencies.sum() + 1e-9
        mass = np.add.reduceat(share, starts[:-1])
        gru = Gru(n + 1, size, rng)
        class_w = np.concatenate([rng.normal(0, 0.05, (size, len(mass))), np.log(mass)[None]])
        # Biases of words are relative to their class, which keeps them small.
        own = np.log(share / np.repeat(mass, np.diff(starts)))
        word_w = np.concatenate([rng.normal(0, 0.05, (n, size)), own[:, None]], 1)
        return cls(n - 2, gru, starts, class_w.astype(np.float32), word_w.astype(np.float32))

    @property
    def end(self) -> int:
        return self.words

    @property
    def unknown(self) -> int:
        return self.words + 1

    @property
    def start(self) -> int:
        return self.words + 2

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def params(self) -> list[np.ndarray]:
        return [*self.gru.params(), self.class_w, self.word_w]

    def most(self) -> tuple[float, list[float]]:
        """Bounds of what goes into the softmax of the classes and into that of each class's words."""
        return float(_most(self.class_w.T).max()), np.maximum.reduceat(_most(self.word_w), self.starts[:-1]).tolist()

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray, class_of: np.ndarray | None = None, most: tuple[float, list[float]] | None = None) -> np.ndarray:
        """Natural logarithms of the targets' probabilities after states ``h``."""
        of_classes, of_words = most or self.most()
        group = (self.class_of if class_of is None else class_of)[targets]
        order, parts = _by_class(group, len(self.starts) - 1)
        h, targets = _ones(h[order]), targets[order]
        found = _log_softmax(h, self.class_w, group[order], of_classes)
        for c, i, j in parts:
            a, b = self.starts[c], self.starts[c + 1]
            if b - a > 1:
                found[i:j] += _log_softmax(h[i:j], self.word_w[a:b].T, targets[i:j] - a, of_words[c])
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, class_of: np.ndarray, grads: list[np.ndarray]) -> tuple[np.ndarray, float, np.ndarray, list[int]]:
        """Adds a window's gradients to ``grads``, (step, stream) symbols; ``fresh`` marks where a document starts.  Gives the states
        after it, the mean loss, the symbols read and the classes met, which all gradients of words belong to."""
        h, loss, read, rows, met = self.gradient_rows(inputs, targets, fresh, h, class_of, grads)
        grads[0][read] += rows
        return h, loss, read, met

    def gradient_rows(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, class_of: np.ndarray, grads: list[np.ndarray]) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, list[int]]:
        """``gradients``, but those of the symbols' rows are given with the symbols read and not added."""
        hs, kept = self.gru.window(inputs, fresh, h)
        h, flat = np.ascontiguousarray(hs[-1].T), targets.ravel()
        hs = hs.transpose(0, 2, 1).reshape(-1, self.gru.size)
        rows = np.flatnonzero(flat >= 0)
        share = np.float32(1 / max(1, len(rows)))
        group = class_of[flat[rows]]
        order, parts = _by_class(group, len(self.starts) - 1)
        rows, group = rows[order], group[order]
        seen, wanted = _ones(hs[rows]), flat[rows]
        of_classes, of_words = self.most()
        p, factor, loss = _softmax_loss(seen, self.class_w, group, share, of_classes)
        grads[3] += (seen * factor).T @ p
        back = p @ self.class_w[:-1].T
        back *= factor
        met = []
        for c, i, j in parts:
            a, b = self.starts[c], self.starts[c + 1]
            if b - a == 1:
                continue
            some, own = seen[i:j], self.word_w[a:b]
            p, factor, one = _softmax_loss(some, own.T, wanted[i:j] - a, share, of_words[c])
            loss += one
            grads[4][a:b] += p.T @ (some * factor)
            one_back = p @ own[:, :-1]
            one_back *= factor
            back[i:j] += one_back
            met.append(c)
        dh = np.zeros_like(hs)
        dh[rows] = back
        dh = np.ascontiguousarray(dh.reshape(len(inputs), -1, self.gru.size).transpose(0, 2, 1))
        d = self.gru.back_window(kept, fresh, dh, grads[1], grads[2])
        # Rows of one symbol are summed together.
        symbols = inputs.ravel()
        order = _order(symbols, len(self.gru.x))
        times = np.bincount(symbols, minlength=len(self.gru.x))
        read = np.flatnonzero(times)
        times = times[read]
        return h, float(loss * share), read, np.ascontiguousarray(np.add.reduceat(d.take(order, 1), np.cumsum(times) - times, 1).T), met

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Base-10 logarithm of each document's probability, its end included; documents are arrays of word ids."""
        out = np.zeros(len(documents))
        lengths = np.array([len(d) + 1 for d in documents])
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):  # documents side by side, longest first, so that those still read are always the first
            stop = at + 1
            tokens = lengths[order[at]]
            while stop < len(order) and tokens + lengths[order[stop]] <= SCORE_TOKENS:
                tokens += lengths[order[stop]]
                stop += 1
            self._score_some([documents[i] for i in order[at:stop]], lengths[order[at:stop]], order[at:stop], out)
            at = stop
        return out / np.log(10)

    def _score_some(self, documents: list[np.ndarray], lengths: np.ndarray, index: np.ndarray, out: np.ndarray) -> None:
        flat = np.concatenate([np.append(d, self.end) for d in documents]).astype(np.int32)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # documents longer than t steps
        h = np.zeros((len(documents), self.gru.size), np.float32)
        before = np.full(len(documents), self.start, np.int32)
        states, targets, owner, held, class_of, most, step = [], [], [], 0, self.class_of, self.most(), self.gru.stepper()
        places = np.arange(len(documents))
        for t in range(int(lengths[0])):
            n = int(active[t])
            h = step(before[:n], h[:n])
            before = flat[first[:n] + t]
            states.append(h)
            targets.append(before)
            owner.append(places[:n])
            held += n
            if held >= 32_768 or len(states) >= SCORE_WINDOW and held >= 4096 or t == lengths[0] - 1:
                got = self.log_probabilities(np.concatenate(states), np.concatenate(targets), class_of, most)
                sums = np.bincount(np.concatenate(owner), got)
                out[index[: len(sums)]] += sums
                states, targets, owner, held = [], [], [], 0


class Learner:
    """Adam steps on windows.  Rows of symbols not read and of classes not met are left as they are, so that a step costs by
    the words in it and not by the vocabulary."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.t, self.class_of = model, rate, 0, model.class_of
        self.params = model.params()
        self.grads, self.m, self.v = ([np.zeros_like(p) for p in self.params] for _ in range(3))

    def step(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, clip: float = 5.0) -> tuple[np.ndarray, float]:
        h, loss, read, rows, met = self.model.gradient_rows(inputs, targets, fresh, h, self.class_of, self.grads)
        starts, whole = self.model.starts, slice(None)
        runs = np.split(np.array(met, int), np.flatnonzero(np.diff(met) != 1) + 1) if met else []  # classes that follow each other go together
        touched = [(0, read, rows), *((k, at, self.grads[k][at]) for k, at in ((1, whole), (2, whole), (3, whole), *((4, slice(starts[r[0]], starts[r[-1] + 1])) for r in runs)))]
        norm = math.sqrt(sum(float(np.vdot(g, g)) for _, _, g in touched))
        scale = np.float32(min(1.0, clip / (norm + 1e-9)))
        self.t += 1
        rate = np.float32(self.rate / (1 - 0.9**self.t))
        root = np.float32(1 / math.sqrt(1 - 0.99**self.t))
        for k, at, g in touched:
            m, v = self.m[k][at], self.v[k][at]  # a slice's are changed in their place
            g *= scale
            some = g - m
            some *= np.float32(0.1)
            m += some
            np.multiply(g, g, out=some)
            some -= v
            some *= np.float32(0.01)
            v += some
            np.sqrt(v, out=some)
            some *= root
            some += np.float32(1e-8)
            np.divide(m, some, out=some)
            some *= rate
            self.params[k][at] -= some
            if k:
                g[...] = 0
            else:
                self.m[k][at], self.v[k][at] = m, v
        return h, loss


def fit(documents: list[np.ndarray], frequencies: np.ndarray, epochs: int = EPOCHS, streams: int = STREAMS, window: int = WINDOW, seed: int = 3) -> Model:
    model = Model.new(frequencies)
    learner = Learner(model, 0.01)
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-LEAST_STEPS * streams * window // max(1, sum(len(d) + 1 for d in documents))))
    epochs = min(epochs, LEAST_STEPS)
    for epoch in range(epochs):
        lanes: list[list[np.ndarray]] = [[] for _ in range(streams)]
        filled = np.zeros(streams, int)
        for i in rng.permutation(len(documents)):
            lane = int(filled.argmin())
            lanes[lane].append(documents[i])
            filled[lane] += len(documents[i]) + 1
        steps = -(-int(filled.max(initial=0)) // window) * window
        inputs, targets, fresh = np.full((steps, streams), model.start, np.int32), np.full((steps, streams), -1, np.int32), np.zeros((steps, streams), bool)
        for k, lane in enumerate(lanes):
            at = 0
            for d in lane:
                inputs[at, k], inputs[at + 1 : at + 1 + len(d), k] = model.start, d
                targets[at : at + len(d), k], targets[at + len(d), k] = d, model.end
                fresh[at, k] = True
                at += len(d) + 1
        h = np.zeros((streams, model.gru.size), np.float32)
        for at in range(0, steps, window):
            learner.rate = 0.01 * (1 - 0.9 * (epoch + at / steps) / epochs)
            h, _ = learner.step(inputs[at : at + window], targets[at : at + window], fresh[at : at + window], h)
    return model


def learn_on(model: Model, documents: Iterator[np.ndarray], streams: int = TASK_STREAMS, window: int = WINDOW, rate: float = TASK_RATE) -> tuple[np.ndarray, np.ndarray]:
    """Goes once over all documents, each whole, and changes the model.  Gives how often each symbol was read and each
    class was the target's.  Holds a few windows of each stream and the longest documents."""
    learner = Learner(model, rate)
    class_of = learner.class_of
    read, met = np.zeros(len(model.gru.x), np.int64), np.zeros(len(model.starts) - 1, np.int64)
    lanes: list[list[np.ndarray]] = [[] for _ in range(streams)]  # each of symbols with their targets, documents one after another
    filled = [(0, k) for k in range(streams)]
    h = np.zeros((streams, model.gru.size), np.float32)

    def steps(x: np.ndarray, wide: int, h: np.ndarray) -> np.ndarray:
        """Symbols and targets by (step, stream), in windows of ``wide`` steps."""
        for at in range(0, x.shape[1], wide):
            inputs, targets = x[0, at : at + wide], x[1, at : at + wide]
            live = targets >= 0
            learner.rate = rate * min(1.0, live.sum() / (streams * window))
            h, _ = learner.step(inputs, targets, inputs == model.start, h)
            np.add(read, np.bincount(inputs[live], minlength=len(read)), out=read)
            np.add(met, np.bincount(class_of[targets[live]], minlength=len(met)), out=met)
        return h

    for d in documents:
        n, k = heapq.heappop(filled)
        lanes[k].append(np.stack([np.concatenate([[model.start], d]), np.concatenate([d, [model.end]])]).astype(np.int32))
        heapq.heappush(filled, (n + len(d) + 1, k))
        if (ready := filled[0][0]) >= 8 * window:
            ready -= ready % window
            joined = [np.concatenate(a, 1) for a in lanes]
            h = steps(np.stack([a[:, :ready] for a in joined], 2), window, h)
            lanes = [[a[:, ready:]] for a in joined]
            filled = [(n - ready, k) for n, k in filled]
    left = [(k, np.concatenate(a, 1)) for k, a in enumerate(lanes) if a]
    left = [(k, a) for k, a in left if a.shape[1]]
    h = h[[k for k, _ in left]]
    rest = [a for _, a in left]
    while rest:  # streams end one by one; the fewer are left the longer the windows
        wide = window * min(16, max(1, streams // len(rest)))
        wide = min(wide, -(-max(a.shape[1] for a in rest) // window) * window)
        x = np.full((2, wide, len(rest)), -1, np.int32)
        x[0] = model.start
        for k, a in enumerate(rest):
            x[:, : min(wide, a.shape[1]), k] = a[:, :wide]
        h = steps(x, wide, h)
        more = [i for i, a in enumerate(rest) if a.shape[1] > wide]
        h, rest = h[more], [rest[i][:, wide:] for i in more]
    return read, met


def _weights(model: Model, read: np.ndarray, met: np.ndarray) -> list[np.ndarray]:
    """What each row of each parameter counts for."""
    every, of_word = np.float64(read.sum()), met[model.class_of].astype(float)
    return [read.astype(float)[:, None], every, every, every, of_word[:, None]]


def learn_all(known: DataFrame, model: Model, words: list[bytes]) -> None:
    """Every task goes on from the model over all its rows of ``body``; the model gets the average of their changes."""
    sent = known.sparkSession.sparkContext.broadcast((words, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first = sent.value
        known, own = pa.array(words, pa.binary()), copy.deepcopy(first)
        documents = (d for batch in batches for d in _encoded(batch.column(0), known, own.unknown))
        own_group = TaskContext.get().partitionId() // SUMMED
        read, met = learn_on(own, documents)
        if not read.any():
            return
        changes = [((p.astype(float) - q) * w).ravel() for p, q, w in zip(own.params(), first.params(), _weights(own, read, met), strict=True)]
        flat = np.concatenate([*changes, read, met])
        for k in range(0, len(flat), CHUNK):
            some = flat[k : k + CHUNK].astype(np.float32)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([own_group], pa.int32()), pa.array([some.tobytes()], pa.binary())], names=["chunk", "tasks", "x"])

    def total(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                    some = np.frombuffer(x.as_py(), kind)
                    held[k] = held[k] + some if k in held else some.astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "x"])

        return run

    params = model.params()
    sizes = [p.size for p in params] + [len(model.gru.x), len(model.starts) - 1]
    flat = np.zeros(sum(sizes))
    # Changes are summed by groups of tasks first, so that no task takes those of all.
    made = known.select("body").mapInArrow(run, "chunk int, tasks int, x binary").repartition("chunk", "tasks").mapInArrow(total(np.float32), "chunk int, x binary")
    summed = made.repartition("chunk").mapInArrow(total(np.float64), "chunk int, x binary").toArrow()
    for k, x in zip(summed.column("chunk").to_pylist(), summed.column("x"), strict=True):
        some = np.frombuffer(x.as_py(), float)
        flat[k * CHUNK : k * CHUNK + len(some)] = some
    *changes, read, met = np.split(flat, np.cumsum(sizes)[:-1])
    for p, change, w in zip(params, changes, _weights(model, read, met), strict=True):
        p += (change.reshape(p.shape) / np.maximum(w, 1)).astype(np.float32)
    sent.destroy()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _pieces(batch.column(0)):
            counted = lm_words(piece)[0].value_counts()
            yield pa.RecordBatch.from_arrays(counted.flatten(), names=["word", "n"])


@dataclass
class Trained:
    """Counts of all training documents, the hot words by frequency with theirs, and the model."""

    counts: DataFrame
    documents: int
    tokens: int
    distinct: int
    hot: list[bytes]
    hot_counts: np.ndarray
    beyond: int  # training tokens beyond the model's vocabulary, and how many words they are
    beyond_distinct: int
    model: Model | None


def commonest(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``most`` words and their counts, the commonest first: all from some count up, found on a grid of counts
    (a few hundred cells, whatever the corpus), and those of the next cell whose digest is low enough, found on a grid of digests,
    so that no task sorts the words and the driver gets no more than these."""
    cell, part = F.floor(F.log2("n") * 16).cast("int"), F.pmod(F.xxhash64(F.lit(29), "word"), F.lit(4096)).cast("int")
    level, held = 1 << 30, 0
    for r in counts.groupBy(cell.alias("cell")).count().orderBy(F.desc("cell")).collect():
        if held + r["count"] > most:
            tied, below = r["cell"], 0
            for q in counts.filter(cell == tied).groupBy(part.alias("part")).count().orderBy("part").collect():
                if held + q["count"] > most:
                    break
                held, below = held + q["count"], q["part"] + 1
            got = counts.filter((cell >= level) | ((cell == tied) & (part < below)))
            break
        level, held = r["cell"], held + r["count"]
    else:
        got = counts
    got = got.toArrow()
    words, n = got.column("word").to_pylist(), got.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, vocabulary: int | None = None, rows: int = TRAIN_ROWS, tokens: int = TRAIN_TOKENS) -> Trained:
    """Learns from rows whose crc32(doc_id as text) mod 7 is not 2; a null text is an end alone.  ``rows`` and ``tokens`` bound the
    sample that the model starts on; it learns from all rows.  Without ``vocabulary`` its words grow with the tokens."""
    known = df.filter(crc_mod(id_col, 7) != 2).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    counts = materialize(known.select("body").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    documents = known.count()
    words, numbers = commonest(counts, hot)
    size = min(vocabulary or max(VOCABULARY, math.isqrt(int(sums[0]))), len(words))
    beyond, beyond_distinct = int(sums[0] - numbers[:size].sum()), int(sums[1] - size)
    trained = Trained(counts, documents, int(sums[0]) + documents, int(sums[1]) + (documents > 0), words, numbers, beyond, beyond_distinct, None)
    if not documents:
        return trained
    # The sample: distinct ids by digest, of their texts those that are not long, as many as make up the tokens.
    chosen = known.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(19), "doc_id"), "doc_id").limit(rows)
    chosen = df.sparkSession.createDataFrame(chosen.toArrow())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(_encoded(batch.column(1), pa.array(words[:size], pa.binary()), size + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32())), pa.array([len(x) + 1 for x in out], pa.int64())], names=["place", "ids", "size"])

    placed = known.join(F.broadcast(chosen), "doc_id").select(F.xxhash64(F.lit(23), "doc_id", "body").alias("place"), "body")
    coded = materialize(placed.dropDuplicates(["place"]).mapInArrow(encoded, "place long, ids array<int>, size long").filter(F.col("size") <= max(tokens // 8, 1)), "sample")
    sizes = coded.select("place", "size").orderBy("place").limit(rows).toArrow()
    before = np.cumsum(sizes.column("size").to_numpy())
    last = int(np.searchsorted(before, tokens))
    upto = sizes.column("place")[min(last, len(before) - 1)].as_py() if len(before) else 0
    some = coded.filter(F.col("place") <= upto).orderBy("place").select("ids").toArrow()  # at most ``tokens`` and a text
    sample = [np.array(x.values.to_numpy(), np.int32) for x in some.column("ids")]
    trained.model = fit(sample, np.concatenate([numbers[:size], [documents, beyond + 1]]).astype(float))
    learn_all(known, trained.model, words[:size])
    return trained


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the values between each two bounds."""
    out, some = np.zeros(len(bounds) - 1, values.dtype), np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some])
    return out


def _times(words: pa.Array, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words between each two bounds, the bounds of those, and how often each occurs."""
    coded = words.dictionary_encode()
    most = max(1, len(coded.dictionary))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs, times = np.unique(text * most + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary.take(pa.array(pairs % most)), np.searchsorted(pairs, np.arange(len(bounds)) * most), times


def score(df: DataFrame, trained: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null text is an empty one: its end alone.  Repeated rows score alike, other columns are not read, an empty table
    gives no rows.  With nothing to learn from, every base score is 0 and the score is the base score.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast((trained.hot, np.log10(trained.hot_counts + 1.0), trained.model))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    end = trained.documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, logs, model = sent.value
        hot = pa.array(hot, pa.binary())
        logs = np.append(logs, 0.0)  # of words that are not hot
        size = model.words if model else 0
        for batch in batches:
            coded, made = [], []
            for piece in _pieces(batch.column(1)):
                words, bounds = lm_words(piece)
                a = _ids(words, hot)
                cold = np.flatnonzero(a < 0)
                out, value = (a < 0) | (a >= size), logs[a]
                rare, ends, times = _times(words.take(pa.array(cold)), np.searchsorted(cold, bounds))
                n = np.diff(bounds)
                made.append(
                    [
                        n + 1,
                        n - np.diff(np.searchsorted(cold, bounds)) + (end > 0),
                        _sums(value, bounds) + np.log10(end + 1),
                        _sums(out.astype(np.int64), bounds),
                        _sums(value * out, bounds),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int32())),
                    ]
                )
                if model:
                    coded += np.split(np.where(out, np.int32(model.unknown), a), bounds[1:-1])
            n, known, base, n_beyond, beyond, rare_words, rare_counts = (pa.concat_arrays([pa.array(x) for x in column]) for column in zip(*made, strict=True))
            lm = pa.array(model.score(coded) if model else np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n, known, base, lm, n_beyond, beyond, rare_words, rare_counts],
                names=["doc_id", "n_tokens", "known", "base", "lm", "n_beyond", "beyond", "words", "counts"],
            )

    made = rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, known long, base double, lm double, n_beyond long, beyond double, words array<binary>, counts array<int>")
    made = materialize(made.withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare = made.select("uid", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.counts").alias("times"))
    found = rare.join(trained.counts, "word")
    sums = found.groupBy("uid").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare"))
    rare_sum = F.coalesce("rare", F.lit(0.0))
    base = F.col("base") + rare_sum - F.col("n_tokens") * float(np.log10(trained.tokens + trained.distinct + 1))
    full = F.col("lm") + F.col("beyond") + rare_sum - F.col("n_beyond") * float(np.log10(trained.beyond + trained.beyond_distinct + 1))
    return made.join(sums, "uid", "left").select(
        "doc_id",
        (crc_mod("doc_id", 7) == 2).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(trained.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (full if trained.model else base).alias("score"),
    )
