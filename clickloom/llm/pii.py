"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns take the leftmost match and drop it if a later check fails, so a card followed by another number, or a
phone followed by an address of digits, is lost. The field looks at runs of digit groups (and of
address pieces), scores every candidate span as a whole against all others and against "nothing", and picks the
best sequence of spans and types by dynamic programming over spans of bounded length. It is
trained on runs in which no pattern dropped a match, with the patterns' spans as labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

KINDS = ("email", "ip", "card", "phone")
#: Most atoms (digit groups or address pieces) of one span.
LONGEST = 12
#: Texts looked at for training, and runs used from them.
TRAIN_TEXTS = 4_000
TRAIN_RUNS = 400

Span = tuple[str, int, int]

# A match of these patterns always begins at the start of a run of their characters, which the look-behind says; possessive
# repeats change no match and keep long runs linear.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_RUN = re.compile(r"[+(]?[0-9][0-9\x20().+-]*")
_MAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9._%+-]++)++")
_GROUP = re.compile(r"[0-9]+")
_PIECE = re.compile(r"[A-Za-z0-9_%+-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Every match of the patterns, by kind and start, and whether it passes its check."""
    for start, end in _emails(text):
        yield "email", start, end, True
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split("."))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        yield "card", m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 8 <= sum(c.isdigit() for c in m[0]) <= 15


def base_spans(text: str) -> list[Span]:
    return [(kind, start, end) for kind, start, end, good in matches(text) if good]


# ---- the field -------------------------------------------------------------------------------


class Run:
    """Atoms of a part of a text, and its candidate spans: (first atom, last atom + 1, kind, start, end, features)."""

    def __init__(self, text: str, start: int, end: int, mail: bool):
        self.start, self.end = start, end
        self.atoms = [m.span() for m in (_PIECE if mail else _GROUP).finditer(text, start, end)]
        self.candidates = list((_mail_candidates if mail else _number_candidates)(text, self.atoms, start, end))


def _number_candidates(text: str, atoms: list[tuple[int, int]], low: int, high: int):
    for i in range(len(atoms)):
        digits, dotted, joined = "", True, True
        for j in range(i, min(i + LONGEST, len(atoms))):
            start, end = atoms[i][0], atoms[j][1]
            between = text[atoms[j - 1][1] : atoms[j][0]] if j > i else ""
            if j > i:
                dotted &= between == "."
                joined &= between in (" ", "-")
                if "+" in between:
                    break
            digits += text[atoms[j][0] : end]
            if len(digits) > 19:
                break
            groups = j - i + 1
            around = (f"before:{text[start - 1] if start > low else '^'}", f"after:{text[end] if end < high else '$'}", f"groups:{groups}", f"digits:{len(digits)}")
            if groups == 4 and dotted and all(int(text[x:y]) <= 255 for x, y in atoms[i : j + 1]):
                yield i, j + 1, "ip", start, end, around
            if joined and 16 <= len(digits) and luhn(digits):
                yield i, j + 1, "card", start, end, (*around, f"even:{len({y - x for x, y in atoms[i : j + 1]}) == 1}")
            if start > low and text[start - 1] == "+" and 8 <= len(digits) <= 15 and end - start > 2:
                yield i, j + 1, "phone", start - 1, end, (*around, f"brackets:{'(' in text[start:end]}", f"last:{min(5, atoms[j][1] - atoms[j][0])}", f"dots:{'.' in text[start:end]}")


def _mail_candidates(text: str, atoms: list[tuple[int, int]], low: int, high: int):
    for i in range(len(atoms)):
        for j in range(i + 2, min(i + LONGEST, len(atoms))):
            start, end = atoms[i][0], atoms[j][1]
            piece = text[start:end]
            if piece.count("@") == 1 and re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", piece):
                around = (f"before:{text[start - 1] if start > low else '^'}", f"after:{text[end] if end < high else '$'}")
                yield i, j + 1, "email", start, end, (*around, f"ends:{text[slice(*atoms[j])].isalpha()}", f"dots:{piece.partition('@')[2].count('.')}")


def runs_of(text: str, taken: bytearray | None = None) -> Iterator[Run]:
    """Runs with at least seven characters that are not ``taken`` (1 for each character of a text that is)."""
    for pattern, mail in ((_RUN, False), (_MAIL_RUN, True)):
        for m in pattern.finditer(text) if not mail or "@" in text else ():
            free = m.end() - m.start() if taken is None else taken.count(0, m.start(), m.end())
            if free >= 7:
                yield Run(text, m.start(), m.end(), mail)


def _named(kind: str, features: tuple[str, ...]) -> list[str]:
    return [kind, *(f"{kind}/{f}" for f in features)]


def _score(weights: dict[str, float], kind: str, features: tuple[str, ...]) -> float:
    return sum(weights.get(name, 0.0) for name in _named(kind, features))


def best_spans(run: Run, taken: bytearray, weights: dict[str, float]) -> list[Span]:
    """The best sequence of candidates outside ``taken``; an atom in none of them scores 0, and ties go to fewer spans."""
    free = [c for c in run.candidates if taken.find(1, c[3], c[4]) < 0]
    if not free:
        return []
    ending: dict[int, list] = {}
    for c in free:
        ending.setdefault(c[1], []).append(c)
    best, how = [0.0] * (len(run.atoms) + 1), [None] * (len(run.atoms) + 1)
    for at in range(1, len(run.atoms) + 1):
        best[at] = best[at - 1]
        for c in ending.get(at, ()):
            value = best[c[0]] + _score(weights, c[2], c[5])
            if value > best[at]:
                best[at], how[at] = value, c
    spans, at = [], len(run.atoms)
    while at:
        c = how[at]
        if c:
            spans.append((c[2], c[3], c[4]))
        at = c[0] if c else at - 1
    return spans[::-1]


def fit_field(runs: list[tuple[Run, set[Span]]], steps: int = 30, rate: float = 0.5, decay: float = 0.01) -> dict[str, float]:
    """Weights of greatest likelihood of the labelled sequences: expected minus observed features, by forward and backward sums."""
    names = sorted({name for run, _ in runs for c in run.candidates for name in _named(c[2], c[5])})
    index = {name: k for k, name in enumerate(names)}
    data = []
    for run, gold in runs:
        columns = [np.array([index[name] for name in _named(c[2], c[5])]) for c in run.candidates]
        data.append((len(run.atoms), [(c[0], c[1]) for c in run.candidates], columns, [(c[2], c[3], c[4]) in gold for c in run.candidates]))
    weights, squares = np.zeros(len(names)), np.full(len(names), 1e-6)
    for _ in range(steps):
        slope = -decay * weights
        for n, places, columns, gold in data:
            scores = [float(weights[c].sum()) for c in columns]
            ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
            for at in range(1, n + 1):
                ahead[at] = np.logaddexp.reduce([ahead[at - 1], *(ahead[i] + s for (i, j), s in zip(places, scores) if j == at)])
            for at in range(n - 1, -1, -1):
                back[at] = np.logaddexp.reduce([back[at + 1], *(back[j] + s for (i, j), s in zip(places, scores) if i == at)])
            for (i, j), s, column, good in zip(places, scores, columns, gold):
                slope[column] += good - math.exp(ahead[i] + s + back[j] - ahead[n])
        squares += slope**2
        weights += rate * slope / np.sqrt(squares)
    return dict(zip(names, weights.tolist()))


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and these with those that the field adds; both by kind, then start."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = bytearray(len(text))
    for _, start, end in base:
        taken[start:end] = b"\x01" * (end - start)
    added = [span for run in runs_of(text, taken) for span in best_spans(run, taken, weights)]
    order = lambda span: (KINDS.index(span[0]), span[1])
    return base, sorted([*base, *added], key=order)


def _training_runs(text: str) -> list[str]:
    """Runs with candidates in which the patterns dropped nothing."""
    found = list(matches(text)) if _TRIGGER.search(text) else []
    kept = []
    for run in runs_of(text) if found else ():
        own = [m for m in found if m[1] < run.end and run.start < m[2]]
        lost = any(not good for kind, start, end, good in own if sum(c.isdigit() for c in text[start:end]) > 7)
        if run.candidates and not lost and run.end - run.start <= 200:
            kept.append(text[max(0, run.start - 1) : run.end + 1])
    return kept


def train(docs: DataFrame, texts: int = TRAIN_TEXTS, most: int = TRAIN_RUNS) -> dict[str, float]:
    """Fit on at most ``most`` runs from at most ``texts`` texts, both picked by hash. Without any run no span is ever added."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(texts)
    cut = arrow_udf(lambda text: pa.array([_training_runs(t or "") for t in text.to_pylist()], pa.list_(pa.string())), "array<string>").asNondeterministic()
    # at most `texts` ids
    picked = docs.join(F.broadcast(ids), "doc_id").select(F.explode(cut(F.col("text").cast("string"))).alias("run"))
    rows = picked.distinct().orderBy(F.xxhash64("run"), "run").limit(most).collect()
    runs = [(run, set(base_spans(row["run"]))) for row in rows for run in runs_of(row["run"])]
    return fit_field([(run, gold) for run, gold in runs if run.candidates])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


FOUND = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base:string,spans:string>"


def _finder(weights) -> Callable[[pa.Array], pa.Array]:
    fields = [("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base", pa.string()), ("spans", pa.string())]

    def run(text: pa.Array) -> pa.Array:
        rows = []
        for t in text:
            base, every = all_spans(t.as_py() or "", weights.value)
            kinds = [kind for kind, _, _ in base]
            rows.append({**{f"n_{kind}": kinds.count(kind) for kind in KINDS}, "base": _joined(base), "spans": _joined(every)})
        return pa.array(rows, pa.struct(fields))

    return run


def personal_data(spark: SparkSession, weights: dict[str, float], text: str = "text") -> Column:
    """Counts of the patterns' spans by kind, these spans, and all spans, as texts ``kind:start:end,...`` in code points, end exclusive.

    The whole text is searched; a null text counts as empty and has none.
    """
    return arrow_udf(_finder(spark.sparkContext.broadcast(weights)), FOUND).asNondeterministic()(F.col(text).cast("string"))


def masked_text(text: str, weights: dict[str, float]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans become one, of the first one's kind."""
    out, at = [], 0
    for kind, start, end in sorted(all_spans(text, weights)[1], key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(spark: SparkSession, weights: dict[str, float], text: str = "text") -> Column:
    held = spark.sparkContext.broadcast(weights)
    hide = lambda column: pa.array([None if t is None else masked_text(t, held.value) for t in column.to_pylist()], pa.string())
    return arrow_udf(hide, "string").asNondeterministic()(F.col(text).cast("string"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", personal_data(spark, train(docs)).alias("own"))
    counts = [F.col(f"own.n_{kind}").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("own.base").cast("binary"), 256).alias("base_sha256"), F.col("own.spans").alias("spans"))
