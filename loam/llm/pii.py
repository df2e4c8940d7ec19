"""Personal data by weak supervision, with DataFrame functions only.

Every match of a kind's rule, passed or failed, and every match of a looser rule is a candidate.  Five labelers vote on
each (for, against, or no vote): the strict rule, a gazetteer, the words before, the shape, and the characters around.
Expectation-maximisation over the counted vote patterns (three to the fifth for a kind and no more, however many rows)
estimates how reliable each labeler is and how likely each pattern is personal data; a logistic span classifier over
votes and span features is then fitted to these estimates and applied to each candidate.  Spans that pass the base rule
always stay; the classifier adds others.

Rows never move: candidates live in an array in their row, and only counts of patterns are gathered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import materialize, quoted

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("rule", "gazetteer", "context", "shape", "edge")
#: A candidate that fails the base rule is taken at this probability.
ACCEPT = 0.8
#: Characters before a candidate that the context labeler sees.
WINDOW = 32

# Base rules, written so that a search is linear in the text: a match can only begin where a run of its first
# characters begins or where the last match ended, and groups are possessive, which the matcher runs as loops.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?: ?[(\[](?:at|AT)[)\]] ?| @ )[A-Za-z0-9-]++(?:(?:\.| ?[(\[](?:dot|DOT)[)\]] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?!)",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
#: Cheap tests that a text must pass before a rule is run over it.
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
LOOSE_GATE = {
    "email": r" @ |[(\[](?:at|AT)[)\]]",
    "ip": r"(?:[0-9A-Fa-f]{1,4}:){7}",
    "card": r"(?!)",
    "phone": r"[0-9]{3}[ .-][0-9]{4}",
}
CUES = {
    "email": r"mail|contact|write|schreib|contacto|courriel|correo|address|reply|from:|to:",
    "ip": r"\bip\b|host|server|addr|client|login|adresse|direcci",
    "card": r"card|visa|master|amex|karte|carte|tarjeta|payment|paid|credit|iban|account",
    "phone": r"phone|call|tel\b|tel[.:]|mobil|cell|fax|telefon|appel|llam|whatsapp|contact",
}
AGAINST = r"version|isbn|issn|order|invoice|serial|item|ref\b|no\.|#\s*$|sku|commit|token|bytes|\bv\s*$"
TOP_LEVEL = "com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be ca au in jp cn br ru pl se no fi dk pt mx ar name dev app me"
#: First digits of calling codes by zone, and of card issuers.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
ISSUERS = "34 37 35 36 4 51 52 53 54 55 22 23 24 25 26 27 60 62 64 65"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    reversed_digits = F.filter(F.split(F.reverse(_digits(text)), ""), lambda d: d != "")
    doubled = F.transform(reversed_digits, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, body: Column) -> Column:
    """The base rule's test of a match."""
    if kind == "ip":
        return F.forall(F.split(body, r"\."), lambda p: F.char_length(F.regexp_replace(p, "^0+(?=.)", "")).between(1, 3) & (F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.char_length(_digits(body)).between(16, 19) & _luhn(body)
    if kind == "phone":
        return F.char_length(_digits(body)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    against = F.lit(-1) if no is None else F.when(no, -1).otherwise(0)
    return F.when(yes, 1).otherwise(against).cast("int")


def _starts_with(text: Column, prefixes: str) -> Column:
    return text.rlike("^(?:" + "|".join(prefixes.split()) + ")")


def _gazetteer(kind: str, body: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(body).rlike(r"[.\])] ?(?:" + "|".join(TOP_LEVEL.split()) + ")$"))
    if kind == "ip":
        return _vote(~body.rlike(r"^(?:0|127|255|2(?:2[4-9]|[34][0-9]))\."))
    if kind == "card":
        return _vote(_starts_with(_digits(body), ISSUERS))
    return _vote(_starts_with(_digits(body), CALLING))


def _shape(kind: str, body: Column) -> Column:
    if kind == "email":
        return _vote(~body.rlike(r"\.\.|^\.|\.@"))
    if kind == "ip":
        return _vote(~body.rlike(r"(?:^|\.)0[0-9]|[0-9]{4}"))
    if kind == "card":
        return _vote(body.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5}$"))
    return _vote(F.char_length(_digits(body)).between(10, 13), F.char_length(_digits(body)) > 15)


def _blocks(gaps: Column, matches: Column) -> Column:
    """Lengths of gaps and matches in blocks: sums by block, then within each, keep the work of positions near linear."""
    block = 256
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("m")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, F.lit(block)))
    return F.when(F.size(matches) > 0, blocks)


def _located(text: Column, pattern: str, prefix: str) -> dict[str, Column]:
    return {f"{prefix}m": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), f"{prefix}g": F.split(text, pattern, -1)}


def _spans(df: DataFrame, kind: str, text: str, pattern: str, gate: str, loose: bool, out: str, masked: str | None) -> DataFrame:
    """Adds the candidates of one rule as array column ``out``; ``masked``: also the text with passed matches blotted out."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    gated = F.when(F.col(text).rlike(gate), F.col(text)).otherwise("")
    df = df.withColumns(_located(gated, pattern, "__"))
    df = df.withColumn("__blocks", _blocks(F.col("__g"), F.col("__m")))
    width = lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + s["g"] + s["m"])
    step = lambda a, w: F.struct((a["at"] + w).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))
    df = df.withColumn("__offsets", F.aggregate(F.transform("__blocks", width), zero, step)["starts"])
    within = lambda b, i: F.aggregate(
        b,
        F.struct(F.get("__offsets", i).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, s: F.struct((a["at"] + s["g"] + s["m"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + s["g"])).alias("starts")),
    )["starts"]
    df = df.withColumn("__starts", F.coalesce(F.flatten(F.transform("__blocks", within)), F.array().cast("array<int>")))

    def candidate(body: Column, i: Column) -> Column:
        before, after = F.get("__g", i), F.get("__g", i + 1)
        cue = F.lower(F.right(before, F.lit(WINDOW)))
        good = F.lit(False) if loose else F.coalesce(_passes(kind, body), F.lit(False))
        alone = ~(before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]"))
        return F.struct(
            F.get("__starts", i).alias("start"),
            (F.get("__starts", i) + F.char_length(body)).alias("end"),
            good.alias("base"),
            (F.lit(0) if loose else F.when(good, 1).otherwise(-1)).cast("int").alias("rule"),
            _gazetteer(kind, body).alias("gazetteer"),
            _vote(cue.rlike(CUES[kind]), cue.rlike(AGAINST)).alias("context"),
            _shape(kind, body).alias("shape"),
            _vote(alone).alias("edge"),
            F.least(F.floor(F.char_length(body) / 8), F.lit(4)).cast("int").alias("size"),
            body.rlike(r"[ ()-]").cast("int").alias("parted"),
        )

    found = F.transform("__m", candidate)
    if kind == "card" and not loose:  # short digit runs are no candidates
        found = F.filter(found, lambda c: c["end"] - c["start"] >= 13)
    columns = {out: found}
    if masked:
        blot = lambda m: F.when(_passes(kind, m), F.repeat(F.lit("\u0002"), F.char_length(m))).otherwise(m)
        pieces = F.transform("__g", lambda g, i: F.concat(g, F.coalesce(blot(F.get("__m", i)), F.lit(""))))
        columns[masked] = F.when(F.size("__m") > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    return df.withColumns(columns).drop("__m", "__g", "__blocks", "__offsets", "__starts")


def candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with an array column ``__<kind>`` of candidates for each kind; no column of ``df`` may begin with two underscores."""
    df = df.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for kind in KINDS:
        df = _spans(df, kind, "__text", BASE[kind], GATE[kind], False, f"__{kind}_base", None)
    # Few texts pass a looser rule's cheap test, and only those are masked for it: signs of the mask let none pass that did not before.
    any_gate = "|".join(f"(?:{g})" for g in LOOSE_GATE.values() if g != "(?!)")
    df = df.withColumn("__open", F.when(F.col("__text").rlike(any_gate), F.col("__text")).otherwise(""))
    masked = "__open"
    for kind in reversed(KINDS):  # a looser rule sees only what no base span covers
        df = _spans(df, kind, masked, BASE[kind], GATE[kind], False, "__unused", "__masked").drop("__unused")
        df = df.withColumn("__seen", F.col("__masked")).drop("__masked")
        masked = "__seen"
    for kind in KINDS:
        if LOOSE[kind] == "(?!)":
            df = df.withColumnRenamed(f"__{kind}_base", f"__{kind}")
            continue
        df = _spans(df, kind, "__seen", LOOSE[kind], LOOSE_GATE[kind], True, "__more", None)
        df = df.withColumn(f"__{kind}", F.concat(f"__{kind}_base", "__more")).drop("__more", f"__{kind}_base")
    return df.drop("__seen", "__open", "__text")


@dataclass
class Model:
    """Labeler reliabilities by vote and class, priors by kind, and the span classifier's weights."""

    reliability: dict = field(default_factory=dict)
    prior: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)


def fit(patterns: list[tuple[tuple, int]], rounds: int = 40, epochs: int = 300) -> Model:
    """patterns: ((kind, five votes, size, parted), count).  The table's size is bounded by its domains, not by the data."""
    model = Model(prior=dict.fromkeys(KINDS, 0.5))
    votes = lambda p: p[1 : 1 + len(LABELERS)]
    belief = {p: 1 / (1 + math.exp(-1.5 * sum(votes(p)) - 1.5 * p[1])) for p, _ in patterns}
    for _ in range(rounds):
        # Pseudo-counts say that a labeler is more often right than wrong.
        seen = {(j, y, v): 8.0 if v == (1 if y else -1) else 2.0 if v else 4.0 for j in range(len(LABELERS)) for y in (0, 1) for v in (-1, 0, 1)}
        mass = {(k, y): 2.0 for k in KINDS for y in (0, 1)}
        for p, n in patterns:
            for y, share in ((1, belief[p]), (0, 1 - belief[p])):
                mass[p[0], y] += n * share
                for j, v in enumerate(votes(p)):
                    seen[j, y, v] += n * share
        model.reliability = {(j, y, v): c / sum(seen[j, y, w] for w in (-1, 0, 1)) for (j, y, v), c in seen.items()}
        model.prior = {k: mass[k, 1] / (mass[k, 0] + mass[k, 1]) for k in KINDS}
        for p, _ in patterns:
            odds = math.log(model.prior[p[0]] / (1 - model.prior[p[0]]))
            odds += sum(math.log(model.reliability[j, 1, v] / model.reliability[j, 0, v]) for j, v in enumerate(votes(p)))
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    total = float(sum(n for _, n in patterns)) or 1.0
    weights = dict.fromkeys(("one", *LABELERS, *(f"size{i}" for i in range(5)), "parted", *KINDS), 0.0)
    weights |= {"rule": 1.0}
    for _ in range(epochs):  # logistic regression on the soft labels, by counts
        slope = {k: 0.01 * w for k, w in weights.items()}
        for p, n in patterns:
            x = features(p)
            z = sum(weights[k] * v for k, v in x.items())
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - belief[p]) * n / total
            for k, v in x.items():
                slope[k] += error * v
        weights = {k: w - 1.0 * slope[k] for k, w in weights.items()}
    model.weights = weights
    return model


def features(p: tuple) -> dict[str, float]:
    kind, *rest = p
    named = dict(zip(LABELERS, rest[: len(LABELERS)], strict=True))
    size, parted = rest[len(LABELERS) :]
    return {"one": 1.0, **named, f"size{size}": 1.0, "parted": parted, kind: 1.0}


def learn(found: DataFrame) -> Model:
    """Counts vote patterns over all rows (one shuffle of at most a few thousand pattern rows a task) and fits."""
    parts = [f"transform(__{k}, c -> struct('{k}' AS kind, {', '.join(f'c.{x} AS {x}' for x in (*LABELERS, 'size', 'parted'))}))" for k in KINDS]
    rows = found.select(F.explode(F.expr(f"concat({', '.join(parts)})")).alias("c")).select("c.*")
    counts = rows.groupBy(rows.columns).count().collect()  # at most 4 * 3^5 * 5 * 2 rows
    return fit(sorted((tuple(r)[:-1], r["count"]) for r in counts))


def _probability(kind: str, c: Column, model: Model) -> Column:
    w = model.weights
    z = F.lit(w["one"] + w[kind])
    for name in LABELERS:
        z = z + F.lit(w[name]) * c[name]
    z = z + F.lit(w["parted"]) * c["parted"] + F.get(F.array(*(F.lit(w[f"size{i}"]) for i in range(5))), c["size"])
    return 1 / (1 + F.exp(-z))


def _accepted(kind: str, model: Model) -> Column:
    kept = F.filter(f"__{kind}", lambda c: c["base"] | (_probability(kind, c, model) >= ACCEPT))
    return F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), F.lit(kind).alias("kind"))))


def find(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row, spans as ``kind:start:end``.

    Counts and hash are of base spans.  A null text is empty: no spans, the hash of the empty text.  Repeated rows give
    repeated results, null ids stay null, other columns are not read, an empty table gives no rows.
    """
    found = materialize(candidates(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text"), "pii")
    model = model or learn(found)
    found = found.select("doc_id", *(_accepted(k, model).alias(k) for k in KINDS))
    base = [F.filter(k, lambda c: c["base"]) for k in KINDS]
    written = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")
    return found.select(
        "doc_id",
        *(F.size(b).cast("long").alias(f"n_{k}") for k, b in zip(KINDS, base, strict=True)),
        F.sha2(written(F.concat(*base)), 256).alias("base_sha256"),
        written(F.concat(*KINDS)).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``df`` with every span replaced by its kind in angle brackets; overlapping spans become one.

    Columns, whatever their names, rows and null texts stay as they are.  Texts without a span come through unchanged, repeated
    rows alike, and an empty table stays empty.
    """
    found = candidates(df.select(F.struct(*quoted(df)).alias("row"), F.col(text_col).cast("string").alias("text")))
    if model is None:
        found = materialize(found, "pii")  # with the rows, so that candidates are sought once
        model = learn(found)
    found = found.withColumn("__spans", F.array_sort(F.concat(*(_accepted(k, model) for k in KINDS))))
    text = F.col("text")

    def step(done: Column, c: Column) -> Column:
        tag = F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">"))
        parts = F.concat(done["parts"], F.array(F.substring(text, done["at"] + 1, c["start"] - done["at"]), tag))
        parts = F.when(c["start"] >= done["at"], parts).otherwise(done["parts"])  # what overlaps joins the span before
        return F.struct(F.greatest(done["at"], c["end"]).alias("at"), parts.alias("parts"))

    merged = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), step)
    found = found.withColumn("__merged", merged)
    rest = F.substring(text, F.col("__merged.at") + 1, F.char_length(text))
    clean = F.when(F.size("__spans") > 0, F.concat(F.array_join("__merged.parts", ""), rest)).otherwise(text)
    return found.select(*((clean if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns))
