"""Language identification by a bidirectional gated recurrent network over bytes.

Both directions read all the bytes of a line, whole, and a softmax over their joined states labels every position.  States start
anew at each line.  A line's probabilities are the mean over all its positions in words of letters; the document's are
the mean over its lines, each weighted by the logarithm of its number of words, so that one long quotation in another
language does not outweigh the document.  Lines of a task are read side by side, those that repeat once; a line of over
``SEGMENT`` bytes is read by segments, with the states of both directions carried over, so that memory is bounded and the result
the same.

The network is trained in numpy by backpropagation through time on pieces of ``PIECE`` bytes of lines of a bounded sample of
documents (``TRAIN_ROWS`` documents, ``TRAIN_PIECES`` pieces).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import crc_mod
from loam.llm.gru import Adam, Gru, both

TRAIN_ROWS = 8_000
TRAIN_PIECES = 24_000
PIECE = 64
SIZE = 8
EPOCHS = 3
LEAST_STEPS = 300
#: Positions that the network reads side by side, and of a line at once.
TOGETHER = 3_000_000
SEGMENT = 1_000_000
#: Bytes of lines whose labels a task keeps, and of texts that it takes on at once.
CACHE = 24_000_000
TEXTS = 24_000_000

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c != 10 and c < 97 or 122 < c < 128 else c for c in range(256))


def letter_lines(text: str | None) -> list[bytes]:
    """Lower-case lines of anything but ASCII signs and digits, words set apart by one space; none for a line without any."""
    lines = (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split(b"\n")
    return [x for x in (b" ".join(line.split()) for line in lines) if x]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes by time from the front, from the back, and lengths."""
    n = np.array([len(w) for w in words])
    front = np.zeros((len(words), n.max()), np.uint8)
    at = np.arange(n.max())[None, :]
    front[at < n[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    back = np.take_along_axis(front, np.maximum(n[:, None] - 1 - at, 0), 1)
    return front.T, back.T, n


class Lanes:
    """Lines side by side, the longest first, by time: place t of line i is at ``first[t] + i``."""

    def __init__(self, lines: list[bytes]):
        lengths = np.array([len(x) for x in lines])
        self.live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
        self.first = np.concatenate([[0], np.cumsum(self.live)[:-1]]).astype(np.int32)
        self.begin = np.cumsum(lengths) - lengths
        self.raw = np.frombuffer(b"".join(lines), np.uint8)
        line = np.repeat(np.arange(len(lines), dtype=np.int32), lengths)
        time = np.arange(len(line), dtype=np.int32) - self.begin.astype(np.int32)[line]
        #: For each byte, line by line, its place when read from the front and from the back.
        self.front = self.first[time] + line
        self.back = self.first[lengths.astype(np.int32)[line] - 1 - time] + line
        self.symbols = np.empty((2, len(line)), np.int16)  # symbols of the second direction come after those of the first
        self.symbols[0][self.front] = self.raw
        self.symbols[1][self.back] = self.raw.astype(np.int16) + 256


@dataclass
class Net:
    languages: list[str]
    front: Gru
    back: Gru
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], size: int = SIZE, seed: int = 1) -> Net:
        rng = np.random.default_rng(seed)
        return cls(languages, Gru(256, size, rng), Gru(256, size, rng), rng.normal(0, 0.1, (2 * size, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def params(self) -> list[np.ndarray]:
        return [*self.front.params(), *self.back.params(), self.out, self.bias]

    def labels(self, lines: list[bytes], hf: np.ndarray | None = None, hb: np.ndarray | None = None) -> tuple[np.ndarray, Lanes, np.ndarray, np.ndarray]:
        """Probabilities of every byte, line by line (the longest first), and the states at the ends of both directions."""
        size, lanes = self.front.size, Lanes(lines)
        h = np.zeros((2, len(lines), size), np.float32)
        h[0], h[1] = 0 if hf is None else hf, 0 if hb is None else hb
        step = both(self.front, self.back)
        out = np.stack([self.out[:size], self.out[size:]])
        z = np.empty((2, len(lanes.raw), out.shape[2]), np.float32)
        first = lanes.first.tolist()
        for t, n in enumerate(lanes.live.tolist()):
            at = first[t]
            h[:, :n] = now = step(lanes.symbols[:, at : at + n], h[:, :n])
            np.matmul(now, out, out=z[:, at : at + n])
        p = z[0].take(lanes.front, 0)
        p += z[1].take(lanes.back, 0)
        p += self.bias
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p, lanes, h[0], h[1]

    def sums(self, lines: list[bytes]) -> np.ndarray:
        """Probabilities of each line's places in words, summed."""
        out = np.zeros((len(lines), len(self.languages)))
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        at = 0
        while at < len(order):
            if len(lines[order[at]]) > SEGMENT:
                out[order[at]] = self._long(lines[order[at]])
                at += 1
                continue
            stop, held = at, 0
            while stop < len(order) and held + len(lines[order[stop]]) <= TOGETHER:
                held += len(lines[order[stop]])
                stop += 1
            part = order[at:stop]
            p, lanes, _, _ = self.labels([lines[i] for i in part])
            p[lanes.raw == 32] = 0
            out[part] = np.add.reduceat(p, lanes.begin, 0, dtype=np.float64)
            at = stop
        return out

    def _long(self, line: bytes) -> np.ndarray:
        pieces = [line[i : i + SEGMENT] for i in range(0, len(line), SEGMENT)]
        h, after = np.zeros((1, self.back.size), np.float32), []
        for piece in reversed(pieces):
            after.append(h)
            h = self.labels([piece], hb=h)[3]
        total, h = np.zeros(len(self.languages)), np.zeros((1, self.front.size), np.float32)
        for piece, b in zip(pieces, reversed(after), strict=True):
            p, lanes, h, _ = self.labels([piece], h, b)
            total += p[lanes.raw != 32].sum(0, dtype=float)
        return total

    def learn(self, words: list[bytes], targets: np.ndarray, weights: np.ndarray, adam: Adam) -> float:
        """One step on a batch of pieces: cross-entropy of every position with the piece's language shares."""
        a, b, n = _matrix(words)
        steps, count, size = len(a), len(words), self.front.size
        hf = hr = np.zeros((count, size), np.float32)
        f, r, kept_f, kept_r = np.zeros((steps, count, size), np.float32), np.zeros((steps, count, size), np.float32), [], []
        for t in range(steps):
            hf, kf = self.front.step_kept(a[t], hf)
            hr, kr = self.back.step_kept(b[t], hr)
            f[t], r[t] = hf, hr
            kept_f.append(kf)
            kept_r.append(kr)
        place = np.maximum(n[None, :] - 1 - np.arange(steps)[:, None], 0)
        joined = np.concatenate([f, np.take_along_axis(r, place[:, :, None], 0)], 2)
        z = joined @ self.out + self.bias
        z = np.exp(z - z.max(2, keepdims=True))
        p = z / z.sum(2, keepdims=True)
        live = (np.arange(steps)[:, None] < n[None, :]) * weights[None, :]
        live = (live / live.sum()).astype(np.float32)
        loss = float(-(live * (targets[None] * np.log(p + 1e-9)).sum(2)).sum())
        d = (p - targets[None]) * live[:, :, None]
        grads = [np.zeros_like(x) for x in self.params()]
        grads[6] += np.einsum("tbk,tbc->kc", joined, d)
        grads[7] += d.sum((0, 1))
        dj = d @ self.out.T
        df = dj[:, :, :size]
        dr = np.zeros_like(df)  # back to the order of the steps: each live place has one
        live_places = live > 0
        t, w = np.nonzero(live_places)
        dr[place[t, w], w] = dj[t, w, size:]
        dh = np.zeros((count, size), np.float32)
        for t in range(steps - 1, -1, -1):
            dh = self.front.back(kept_f[t], dh + df[t], grads[0:3])
        dh = np.zeros((count, size), np.float32)
        for t in range(steps - 1, -1, -1):
            dh = self.back.back(kept_r[t], dh + dr[t], grads[3:6])
        adam.step(grads)
        return loss


def fit(languages: list[str], words: list[bytes], shares: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, batch: int = 256, seed: int = 2) -> Net:
    net = Net.new(languages)
    adam = Adam(net.params(), 0.01)
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-LEAST_STEPS * batch // max(1, len(words))))
    total = epochs * max(1, len(words) // batch)
    for epoch in range(epochs):
        # Words of like length go together; which of them, and the batches' order, is drawn anew.
        order = np.lexsort((rng.random(len(words)), [len(w) for w in words]))
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        for k, i in enumerate(rng.permutation(len(batches))):
            adam.rate = 0.01 * (1 - (epoch * len(batches) + k) / (total + len(batches))) + 1e-4
            part = batches[i]
            net.learn([words[j] for j in part], shares[part], weights[part], adam)
    return net


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said, out = [], []
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = {line[i : i + PIECE] for line in letter_lines(body.as_py()) for i in range(0, len(line), PIECE)}
            out.extend(own)
            said.extend([lang] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array(out, pa.binary())], names=["lang", "piece"])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, pieces: int = TRAIN_PIECES) -> Net | None:
    """Learns from rows with a language whose crc32(doc_id as text) mod 5 is not 0; none if there are none."""
    keyed = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body"))
    keyed = keyed.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("body").isNotNull() & (crc_mod("doc_id", 5) != 0))
    chosen = keyed.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(rows)
    counted = keyed.join(F.broadcast(chosen), "doc_id").select("lang", "body").mapInArrow(_pieces, "lang string, piece binary")
    by = counted.groupBy("piece", "lang").agg(F.count("*").alias("n"))
    # A piece's languages go together, as they hash together.
    got = by.orderBy(F.xxhash64(F.lit(17), "piece"), "piece", "lang").limit(pieces).collect()
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    known = sorted({bytes(r["piece"]) for r in got})
    row = {w: i for i, w in enumerate(known)}
    counts = np.zeros((len(known), len(languages)))
    for r in got:
        counts[row[bytes(r["piece"])], languages.index(r["lang"])] += r["n"]
    total = counts.sum(1)
    return fit(languages, known, (counts / total[:, None]).astype(np.float32), np.sqrt(total).astype(np.float32))


def pool(lines: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A document's probabilities from its lines' sums and numbers of words."""
    weight = np.log1p(words)
    return weight @ (lines / lines.sum(1, keepdims=True)) / weight.sum()


def predict(df: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A null text or one without a letter is ``und`` with score 0, as is any if nothing was learned.  Repeated rows are
    labelled alike, a null id is never held out, other columns are not read, an empty table gives no rows.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    held = F.col(id_col).isNotNull() & (crc_mod(id_col, 5) == 0)
    rows = df.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        size = 0
        for batch in batches:
            said, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            column, at = batch.column(2), 0
            while net is not None and at < batch.num_rows:
                some: list[tuple[int, list[bytes]]] = []
                taken = 0
                while at < batch.num_rows and taken < TEXTS:
                    text = column[at].as_py()
                    if has_letter(text):
                        some.append((at, letter_lines(text)))
                        taken += len(text)
                    at += 1
                new = list(set().union(*(lines for _, lines in some)) - known.keys())
                known.update(zip(new, net.sums(new) if new else (), strict=True))
                for i, lines in some:
                    pooled = pool(np.array([known[x] for x in lines]), np.array([x.count(b" ") + 1 for x in lines]))
                    best = int(pooled.argmax())
                    said[i], score[i] = net.languages[best], min(1.0, pooled[best])
                size += sum(map(len, new))
                if size > CACHE:
                    known, size = {}, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
