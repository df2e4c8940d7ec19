"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A unit is a word, or a run of three or more single letters, with punctuation dropped and common digit-for-letter
spellings undone.  The kernel of two units is the inner product of their gap-weighted subsequences of three letters
(a subsequence that spans s letters weighs ``DECAY`` ** s), divided by a norm for their lengths; so an insult keeps most
of its kernel values when letters are set apart or a strange one is put in.

The machine is trained on labelled sentences.  A sentence's value is that of its highest unit, and its label that of its
document, where a toxic document need not be toxic in every sentence: which sentences are, and by which unit, is learned in rounds.
It begins with stems (a unit, or its first four to seven letters) that occur in toxic documents far beyond chance: a sentence
of a toxic document that has one is a positive row by that unit.  In each further round it is a positive row by its highest
unit too if the machine puts that on the toxic side, and sentences of clean documents are negative rows by theirs; the highest
are kept.  So an insult need not be frequent itself, as long as it has something of its own in common with others, but kernels do not
cross units, so an insult of several ordinary words is none.  A landmark machine is linear in the subsequences, so it is
folded into one weight for each possible one.  A text is judged by its highest unit, by how many units are on the wrong
side, and by their share, in a logistic regression on the training documents.

Training sees all sentences of a bounded sample (``TRAIN_ROWS`` documents), of the negative rows ``NEGATIVES`` by digest and
the ``HARD_NEGATIVES`` highest of each round; scoring reads every text once, whole, and
moves nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import crc_mod, materialize
from loam.llm.quality import label_sample

TRAIN_ROWS = 20_000
NEGATIVES = 20_000
HARD_NEGATIVES = 4_000
ROUNDS = 2
#: Commonest positive units of which spellings with a strange letter are added.
VARIED = 400
#: Letters of stems, besides whole units.
STEMS = (4, 5, 6, 7)
#: Logarithm by which a stem's gain exceeds that of the best one by chance.
BEYOND_CHANCE = 2.0
LANDMARKS = 320
DECAY = 0.75
#: Letters that a subsequence may span, and letters of a unit that are seen at once (longer ones go by steps of half).
SPAN = 8
WIDE = 16
#: Units of at least this value are hits.
HIT = 0.2
#: Rows whose units a task holds at once, and units whose values it keeps.
ROWS_AT_ONCE = 500
KEPT_UNITS = 100_000
#: A score of at least this is predicted toxic.
PREDICT = 0.7

#: Letters a to z, then other letters by their code point modulo what is left.
ALPHABET = 40
CODES = ALPHABET**3
#: Letters that digits and signs stand for.
SPELLED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


class _Spelling(dict):
    """Code point to one of the alphabet, or to nothing."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        c = SPELLED.get(c, c)
        if "a" <= c <= "z":
            out = c
        elif c.isalpha() and not c.isascii():
            out = chr(123 + code % (ALPHABET - 26))
        else:
            out = ""
        self[code] = out
        return out


_SPELLING = _Spelling()


def letters(word: bytes) -> bytes:
    """Letters of a lower-case word, one byte each."""
    if word.isalpha():  # of ASCII alone
        return word
    s = word.decode("utf-8", "replace")
    if not any(c.isalpha() for c in s):
        return b""  # digits alone spell nothing
    return s.translate(_SPELLING).encode("latin-1")


def units(text: str | None) -> set[bytes]:
    """Distinct units of a text, as written; runs of single letters are joined."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    out = set(words)
    run: list[bytes] = []
    for word in [w if len(w) < 3 else b"" for w in words] + [b""]:  # most words end a run at once
        one = letters(word) if word else b""
        if len(one) == 1:
            run.append(one)
        else:
            if len(run) >= 3:
                out.add(b"".join(run))
            run = []
    return out


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str | None) -> list[set[bytes]]:
    """The pieces of each sentence that has any."""
    out = ({p for u in units(s) for p in pieces(u)} for s in _SENTENCE.split(text or ""))
    return [x for x in out if x]


@lru_cache(50_000)
def pieces(unit: bytes) -> list[bytes]:
    """The letters of a unit, by overlapping windows if there are many."""
    s = letters(unit)
    if len(s) <= WIDE:
        return [s] if len(s) >= 3 else []
    return [s[i : i + WIDE] for i in range(0, len(s) - WIDE // 2, WIDE // 2)]


@lru_cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    i, j, k = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))], int).reshape(-1, 3).T
    weight = DECAY ** (k - i + 1.0)
    return i, j, k, weight, float(np.sqrt((weight**2).sum()))


def _coded(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, subsequence codes, normed weights) for words of each length; code ``CODES`` is of no subsequence."""
    by: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by.setdefault(len(w), []).append(at)
    for n, at in by.items():
        i, j, k, weight, norm = _triples(n)
        for some in range(0, len(at), 4096):
            part = at[some : some + 4096]
            x = np.frombuffer(b"".join(words[a] for a in part), np.uint8).reshape(-1, n).astype(np.int32) - 97
            codes = (x[:, i] * ALPHABET + x[:, j]) * ALPHABET + x[:, k]
            strange = x < 0
            if strange.any():
                codes[strange[:, i] | strange[:, j] | strange[:, k]] = CODES
            yield np.array(part), codes, weight / norm


def features(words: list[bytes]) -> np.ndarray:
    """Normed subsequence weights of each word, a row of ``CODES``."""
    out = np.zeros((len(words), CODES + 1), np.float32)
    for at, codes, weight in _coded(words):
        np.add.at(out, (at[:, None], codes), np.broadcast_to(weight, codes.shape).astype(np.float32))
    return out[:, :-1]


@dataclass
class Machine:
    """Weight of each subsequence, bias, and weights of one, top unit, hits and share of hits."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(CODES + 1, np.float32))
    bias: float = -1.0
    pooled: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 0.0, 0.0]))

    def decide(self, words: list[bytes]) -> np.ndarray:
        """The machine's value for each unit: the highest of its windows; the bias alone if it has no subsequence."""
        parts, owner = [], []
        for n, w in enumerate(words):
            for p in pieces(w):
                parts.append(p)
                owner.append(n)
        value = np.full(len(words), -1.0)
        if parts:
            each = np.empty(len(parts), np.float32)
            for at, codes, weight in _coded(parts):
                each[at] = self.weights[codes] @ weight.astype(np.float32)
            np.maximum.at(value, owner, each + self.bias)
        return value


def kernel(words: list[bytes], marks: np.ndarray) -> np.ndarray:
    """Kernel values of words with landmarks; ``marks`` has a row for each code, and a last one of zeros."""
    out = np.zeros((len(words), marks.shape[1]))
    for at, codes, weight in _coded(words):
        if not len(weight):
            continue
        for i in range(0, len(at), 64):
            out[at[i : i + 64]] = np.tensordot(weight.astype(np.float32), marks[codes[i : i + 64]], axes=(0, 1))
    return out


def fit_machine(
    positive: list[bytes], negative: list[bytes], landmarks: list[bytes], positive_weight: np.ndarray | None = None, negative_weight: np.ndarray | None = None, penalty: float = 0.0002
) -> Machine:
    """Squared-hinge machine on landmark features, by Newton steps over the active rows.  A unit may be on both sides."""
    machine = Machine()
    if not positive or not negative:
        return machine
    chosen = list(dict.fromkeys(landmarks))
    marks = np.zeros((CODES + 1, len(chosen)), np.float32)
    for at, codes, weight in _coded(chosen):
        for n, row in zip(at, codes, strict=True):
            np.add.at(marks[:, n], row, weight.astype(np.float32))
    marks[-1] = 0
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(float))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    rows = list(dict.fromkeys(positive + negative))
    z = np.concatenate([kernel(rows, marks) @ root, np.ones((len(rows), 1))], 1)
    place = {w: i for i, w in enumerate(rows)}
    share = np.ones(len(positive)) if positive_weight is None else positive_weight
    other = np.ones(len(negative)) if negative_weight is None else negative_weight
    gain = np.zeros((2, len(rows)))  # weight of each row on either side
    np.add.at(gain[0], [place[w] for w in positive], share / share.sum())
    np.add.at(gain[1], [place[w] for w in negative], 2 * other / other.sum())
    ridge = np.full(z.shape[1], penalty / 10)
    ridge[-1] = 1e-6
    w, active = np.zeros(z.shape[1]), np.ones((2, len(rows)), bool)
    for _ in range(50):
        live = gain * active
        w = np.linalg.solve((z * live.sum(0)[:, None]).T @ z + np.diag(ridge), z.T @ (live[0] - live[1]))
        value = z @ w
        now = np.stack([value < 1, value > -1])
        if (now == active).all():
            break
        active = now
    machine.weights[:-1] = marks[:-1] @ (root @ w[:-1])
    machine.bias = float(w[-1])
    return machine


def varied(words: list[bytes]) -> list[bytes]:
    """Each word with one strange letter put in at one of its inner places."""
    out = []
    for n, w in enumerate(words):
        for at in range(1, len(w)):
            out.append(w[:at] + bytes([97 + (n * 7 + at * 5) % 26]) + w[at:])
    return out


def stems(piece: bytes) -> list[bytes]:
    return [piece, *(piece[:k] for k in STEMS if k < len(piece))]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64())], names=["stem", "toxic", "clean"])

    for batch in batches:
        for y, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for stem in {x for s in sentences(body.as_py()) for p in s for x in stems(p)}:
                held.setdefault(stem, [0, 0])[int(y > 0)] += 1
                if len(held) > KEPT_UNITS:
                    yield out()
                    held.clear()
    if held:
        yield out()


def witnesses(seen: DataFrame) -> dict[bytes, float]:
    """Stems of mostly toxic documents and their gain: the log-likelihood ratio of their own rate to that of all stems.

    So many stems are tried that the best has some gain by chance: the logarithm of how many could reach it at all, those of
    enough documents.  All with more than that, by ``BEYOND_CHANCE``, are witnesses.
    """
    n = F.col("toxic") + F.col("clean")
    sums = seen.agg(F.sum("toxic"), F.sum(n)).first()
    if not sums[0] or sums[0] == sums[1]:
        return {}
    rate = sums[0] / sums[1]
    tried = seen.groupBy(F.least(n, F.lit(1000)).alias("n")).count().collect()
    level = BEYOND_CHANCE
    for _ in range(20):
        level = BEYOND_CHANCE + float(np.log(max(1, sum(r["count"] for r in tried if r["n"] * -np.log(rate) >= level))))
    gain = F.col("toxic") * F.log(F.col("toxic") / n / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - rate))).otherwise(0)
    found = seen.filter((2 * F.col("toxic") > n) & (F.col("toxic") / n > rate)).withColumn("gain", gain).filter(F.col("gain") > level)
    return {bytes(r["stem"]): r["gain"] for r in found.select("stem", "gain").collect()}  # of the sample's stems


def _by_stems(found: dict[bytes, float]) -> Callable[[int, list[bytes]], list[float]]:
    """Values at the beginning: of toxic documents' units the gain of the best witness, of clean ones a digest."""

    def value(y: int, words: list[bytes]) -> list[float]:
        if not y:
            return [zlib.crc32(w) / 2**32 for w in words]
        return [max((found.get(x, -1.0) for x in stems(w)), default=-1.0) for w in words]

    return value


def sentence_rows(known: DataFrame, value: Callable[[int, list[bytes]], list[float]]) -> DataFrame:
    """label, piece, n, value: the highest piece of each sentence of (label, body), by how many sentences it is that of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[dict[bytes, float]] = [{}, {}]
        for batch in _slices(batches):
            rows: Counter = Counter()
            split = [(int(y > 0), sentences(body.as_py())) for y, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            for y in (0, 1):
                if len(values[y]) > KEPT_UNITS:
                    values[y].clear()
                new = list({p for label, some in split if label == y for s in some for p in s} - values[y].keys())
                values[y].update(zip(new, value(y, new), strict=True))
            for y, some in split:
                own = values[y]
                rows.update((y, max(s, key=lambda p: (own[p], p))) for s in some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([y for y, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary()), pa.array(rows.values(), pa.int64()), pa.array([values[y][p] for y, p in rows], pa.float64())],
                names=["label", "piece", "n", "value"],
            )

    made = known.mapInArrow(run, "label int, piece binary, n long, value double")
    return made.groupBy("label", "piece").agg(F.sum("n").alias("n"), F.max("value").alias("value"))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Machine:
    """Learns from labelled documents whose crc32(doc_id as text) mod 3 is not 1.  Without both labels every score is low."""
    sample = label_sample(labels, "toxic", rows, where=crc_mod("doc_id", 3) != 1)
    known = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body")).join(F.broadcast(sample), "doc_id")
    # One text for each id of the sample.
    known = materialize(known.groupBy("doc_id").agg(F.first("__label").alias("__label"), F.min("body").alias("body")).select("__label", "body"), "labelled")
    seen = materialize(known.mapInArrow(_counts, "stem binary, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "stems")
    found = witnesses(seen)
    if not found:
        return Machine()
    machine, positive, hard = Machine(), [], {}
    value = _by_stems(found)
    random: dict[bytes, int] = {}
    for step in range(1 + ROUNDS):
        got = materialize(sentence_rows(known, value), "sentences")
        new = got.filter("label = 1 and value > 0").orderBy(F.desc("n"), "piece").collect()  # of the sample's sentences
        # Rows are added, and those of the beginning stay: a machine that has not yet learned some insults shall not unlearn them.
        times = dict(positive) | {bytes(r["piece"]): r["n"] for r in new}
        positive = sorted(times.items(), key=lambda x: (-x[1], x[0]))
        clean = got.filter("label = 0")
        if not step:
            random = {bytes(r["piece"]): r["n"] for r in clean.orderBy("value", "piece").limit(NEGATIVES).collect()}
            own = clean.join(F.broadcast(df.sparkSession.createDataFrame([(p,) for p, _ in positive], "piece binary")), "piece").collect()
        else:
            own = clean.filter("value > 0").orderBy(F.desc("value"), "piece").limit(HARD_NEGATIVES).collect()
            hard |= {bytes(r["piece"]): r["n"] for r in clean.orderBy(F.desc("value"), "piece").limit(HARD_NEGATIVES).collect()}
        if not positive or not random:
            return machine
        # A unit on both sides is on each by its sentences.
        both = {bytes(r["piece"]): r["n"] for r in own}
        given = np.array([n for _, n in positive], float)
        taken = {w for w, _ in positive}
        against = [(w, 0.02) for w in sorted(random) if w not in both] + [(w, 0.3) for w in sorted(hard) if w not in both] + sorted(both.items())
        inserted = [w for w in varied([w for w, _ in positive[:VARIED]]) if w not in hard and w not in taken]
        top = [w for w, _ in positive]
        marks = top[: LANDMARKS // 3] + sorted(hard, key=lambda w: (-hard[w], w))[: LANDMARKS // 3]
        some = sorted(random)
        marks += some[:: max(1, len(some) // (LANDMARKS - len(marks)))][: LANDMARKS - len(marks)]
        machine = fit_machine(
            top + inserted,
            [w for w, _ in against],
            marks,
            np.concatenate([given, np.full(len(inserted), 0.02 * given.mean())]),
            np.array([n for _, n in against], float),
        )
        value = lambda y, words, machine=machine: machine.decide(words).tolist()
    got = _valued(known, machine, "__label int").toArrow()
    x = np.stack([got.column(c).to_numpy() for c in ("top", "hits", "units")], 1).astype(float).reshape(-1, 3)
    y = (got.column("__label").to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums shall not differ
    machine.pooled = calibrate(pooled_features(x[order]), y[order])
    return machine


def pooled_features(x: np.ndarray) -> np.ndarray:
    """One, top unit, hits and their share, from columns top, hits, units."""
    return np.stack([np.ones(len(x)), x[:, 0], np.log1p(x[:, 1]), np.log1p(100 * x[:, 1] / np.maximum(x[:, 2], 1))], 1)


def calibrate(z: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; a feature that would speak against toxicity is left out."""
    used = [0, 1, 2, 3]
    while True:
        x, w = z[:, used], np.array([-4.0] + [1.0] * (len(used) - 1))
        keep = np.array([0.0] + [1.0] * (len(used) - 1))
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            g = x.T @ (p - y) / max(len(y), 1) + ridge * w * keep
            h = (x * (p * (1 - p))[:, None]).T @ x / max(len(y), 1) + ridge * np.eye(len(used))
            w = w - 0.5 * np.linalg.solve(h, g)
        worst = int(w[1:].argmin()) + 1 if len(used) > 1 else 0
        if not worst or w[worst] >= 0:
            out = np.zeros(4)
            out[used] = w
            return out
        del used[worst]


def _valued(df: DataFrame, machine: Machine, first: str) -> DataFrame:
    """The first column of (any, body), the text's highest unit (-1 if none), hits and distinct units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in _slices(batches):
            sets = [units(x.as_py()) for x in batch.column(1)]
            new = list(set().union(*sets) - known.keys())
            if len(known) + len(new) > KEPT_UNITS:
                known.clear()
                new = list(set().union(*sets))
            for at in range(0, len(new), 20_000):
                some = new[at : at + 20_000]
                known.update(zip(some, machine.decide(some).tolist(), strict=True))
            top, hits = [], []
            for s in sets:
                values = list(map(known.__getitem__, s))
                best = max(values, default=-1.0)
                top.append(best)
                hits.append(sum(v > HIT for v in values) if best > HIT else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.float64()), pa.array(hits, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=[first.split()[0], "top", "hits", "units"])

    return df.mapInArrow(run, f"{first}, top double, hits long, units long")


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts score as a text without any unit does.  Repeated rows score alike, a null id is never held
    out, other columns are not read, an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    valued = _valued(rows, machine, f"doc_id {df.schema[id_col].dataType.simpleString()}")
    w = [float(v) for v in machine.pooled]
    share = F.log1p(100 * F.col("hits") / F.greatest(F.col("units"), F.lit(1)))
    z = w[0] + w[1] * F.col("top") + w[2] * F.log1p("hits") + w[3] * share
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    scored = valued.select("doc_id", (F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) == 1)).alias("held_out"), p.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))
