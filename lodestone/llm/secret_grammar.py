"""Secret scan: base rules, and formats inferred from the credentials that the rules label.

The base rules find credentials by a keyword before them, by a fixed head, or
as long hexadecimal runs; the rule is the label of what it finds. From the
values of each label a probabilistic automaton is inferred: their prefix tree
with counts is folded by merging states whose frequencies of ending and of each
next character, and those of all common successors, are statistically
compatible (Hoeffding bounds). Runs of credential characters outside all base
spans give the automaton of plain tokens; those that a format explains better
are taken out of its sample once, as stray credentials are among them.

Then every run in every text is scored: the log likelihood of the best format
less that of plain tokens, for which runs of digits alone also count as numbers. Runs above a margin are added to the spans. The
automata are fitted on the driver from bounded samples of distinct values;
texts are scanned whole, where they lie.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, scratch, written

# Kinds in their order, and the base rules.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
PLAIN = "plain"

#: Distinct values of each label that automata are fitted on (those with the smallest hashes), and their longest; with fewer than FEWEST no format is inferred.
FIT_VALUES, FIT_LENGTH, FEWEST = 2000, 256, 20
#: Shortest run that is scored, the log odds from which it is a secret, the risk of a merge test, the share of probability that unseen characters have.
SHORTEST, MARGIN, RISK, UNSEEN = 12, 6.0, 1e-3, 0.05
#: Log odds from which a value of the plain sample is taken for a stray credential.
STRAY = 3.0
#: How far below the fitted values' hundredth a typical value's log likelihood a character may lie.
SLACK = 0.25


@dataclass
class Automaton:
    """States with log probabilities: ``moves[state][character]`` is (next state, log probability), ``ends[state]`` that of ending.

    ``rare`` has the log probability of a character that its state never saw,
    ``lowest`` the log likelihood a character that all but a hundredth of the
    fitted values reach.
    """

    moves: list[dict[str, tuple[int, float]]]
    ends: list[float]
    rare: dict[str, float]
    lowest: float = -math.inf

    def walk(self, value: str) -> tuple[float, int, int]:
        """(log likelihood without the end, characters that their states never saw, last state); such a character leaves the state."""
        moves, at, total, strange = self.moves, 0, 0.0, 0
        for c in value:
            step = moves[at].get(c)
            if step is None:
                total += self.rare[c]
                strange += 1
            else:
                at = step[0]
                total += step[1]
        return total, strange, at

    def score(self, value: str) -> float:
        total, _, at = self.walk(value)
        return total + self.ends[at]

    def typical(self, value: str) -> tuple[float, bool]:
        """(log likelihood, whether the value is about as likely a character as fitted values are, and strange nowhere)."""
        total, strange, at = self.walk(value)
        return total + self.ends[at], not strange and total >= (self.lowest - SLACK) * len(value)


class _Tree:
    """A prefix tree with counts, folded into an automaton by merging compatible states."""

    def __init__(self, values: Iterable[str]) -> None:
        self.n, self.end, self.to, self.took = [0], [0], [{}], [{}]
        self.up: list[tuple[int, str]] = [(-1, "")]
        for value in values:
            at = 0
            for c in value:
                self.n[at] += 1
                self.took[at][c] = self.took[at].get(c, 0) + 1
                if c not in self.to[at]:
                    self.to[at][c] = len(self.n)
                    self.up.append((at, c))
                    for table, start in ((self.n, 0), (self.end, 0), (self.to, {}), (self.took, {})):
                        table.append(start)
                at = self.to[at][c]
            self.n[at] += 1
            self.end[at] += 1

    def compatible(self, a: int, b: int, spread: float) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.n[a], self.n[b]
            bound = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound < 1:
                mine, other = self.took[a], self.took[b]
                if abs(self.end[a] / n - self.end[b] / m) > bound or any(abs(mine.get(c, 0) / n - other.get(c, 0) / m) > bound for c in mine.keys() | other.keys()):
                    return False
            pairs += [(self.to[a][c], x) for c, x in self.to[b].items() if c in self.to[a]]
        return True

    def fold(self, a: int, b: int, settled: set[int], open_: set[int]) -> None:
        """Merge the tree below ``b`` into ``a``."""
        above, c = self.up[b]
        self.to[above][c] = a
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            for c, x in self.to[b].items():
                self.took[a][c] = self.took[a].get(c, 0) + self.took[b][c]
                if c in self.to[a]:
                    pairs.append((self.to[a][c], x))
                else:
                    self.to[a][c], self.up[x] = x, (a, c)
                    if a in settled:
                        open_.add(x)

    def folded(self, risk: float) -> list[int]:
        """The states that stay, the first state first."""
        spread = math.sqrt(0.5 * math.log(2 / risk))
        settled, order, open_ = {0}, [0], set(self.to[0].values())
        while open_:
            b = max(open_, key=lambda x: (self.n[x], -x))
            open_.remove(b)
            a = next((a for a in order if self.compatible(a, b, spread)), None)
            if a is None:
                settled.add(b)
                order.append(b)
                open_ |= set(self.to[b].values())
            else:
                self.fold(a, b, settled, open_)
        return order


def infer(values: Iterable[str], risk: float = RISK) -> Automaton:
    """The automaton of ``values``; of none, every character and the end are as likely anywhere."""
    values = sorted(set(values))
    seen = Counter(c for v in values for c in v)
    total = sum(seen.values()) + len(values) + len(ALPHABET) + 1
    base = {c: (seen[c] + 1) / total for c in ALPHABET}
    rare = {c: math.log(UNSEEN * p) for c, p in base.items()}
    if not values:
        return Automaton([{}], [-math.log(total)], {c: -math.log(total) for c in ALPHABET})
    tree = _Tree(values)
    order = tree.folded(risk)
    number = {s: k for k, s in enumerate(order)}
    log = lambda count, n, p: math.log((1 - UNSEEN) * count / n + UNSEEN * p)
    moves = [{c: (number[tree.to[s][c]], log(k, tree.n[s], base[c])) for c, k in tree.took[s].items()} for s in order]
    out = Automaton(moves, [log(tree.end[s], tree.n[s], (len(values) + 1) / total) for s in order], rare)
    out.lowest = sorted(out.walk(v)[0] / len(v) for v in values if v)[len(values) // 100]
    return out


def numeral(value: str) -> float:
    """The log likelihood as a plain number: e^-3 for being one, each digit as likely as the others; -inf for other runs."""
    return -3.0 - len(value) * math.log(10) if value.isdigit() else -math.inf


@dataclass
class Formats:
    """The inferred formats by label, and plain tokens."""

    formats: dict[str, Automaton]
    plain: Automaton
    shortest: int = SHORTEST
    margin: float = MARGIN

    def best(self, value: str) -> tuple[float, str]:
        """(log odds against plain tokens, label) of the likeliest format that the value is typical of; -inf where there is none."""
        scored = [(*a.typical(value), k) for k, a in self.formats.items()]
        fits = [(total, k) for total, typical, k in scored if typical]
        if not fits:
            return -math.inf, ""
        total, label = max(fits)
        return total - max(self.plain.score(value), numeral(value)), label


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of kind, end, value) of the base rules, by start and kind; whole matches, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def runs(text: str, taken: list[tuple[int, int, int, str]], shortest: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, value) of maximal runs of credential characters, without points and hyphens at their ends, that meet no base span."""
    k, reach = 0, 0
    for m in RUN.finditer(text):
        if m.end() - m.start() < shortest:
            continue
        value = m[0].lstrip(".-")
        start = m.end() - len(value)
        value = value.rstrip(".-")
        end = start + len(value)
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][2])
            k += 1
        if len(value) >= shortest and reach <= start:
            yield start, end, value


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        for text in batch["text"].to_pylist():
            if text:
                yield text


def _labelled(batches: Iterator[pa.RecordBatch], most: int, shortest: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(label, h, value): the distinct values of each label with the smallest hashes in this task."""
    held: dict[str, dict[str, int]] = {k: {} for k in (*KINDS, PLAIN)}

    def cut(label: str) -> None:
        held[label] = dict(heapq.nsmallest(most, held[label].items(), key=lambda x: (x[1], x[0])))

    for text in _texts(batches):
        taken = base_spans(text)
        values = [(KINDS[k], value.strip(".-")) for _, k, _, value in taken] + [(PLAIN, v) for _, _, v in runs(text, taken, shortest)]
        for label, value in values:
            if shortest <= len(value) <= longest:
                held[label][value] = xxhash.xxh64_intdigest(value, 5) >> 1
                if len(held[label]) > 8 * most:
                    cut(label)
    for label in held:
        cut(label)
        if held[label]:
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(held[label])), pa.array(list(held[label].values()), pa.int64()), pa.array(list(held[label]))], ["label", "h", "value"])


def fit_formats(docs: DataFrame, text_col: str = "text", fit_values: int = FIT_VALUES, fit_length: int = FIT_LENGTH, shortest: int = SHORTEST, margin: float = MARGIN, risk: float = RISK) -> Formats:
    """Infer the formats of the credentials that the base rules label in all texts.

    A label with fewer than 20 distinct values of ``shortest`` to ``fit_length``
    characters gives no format; a table without texts gives none at all.
    """
    at = scratch(docs.sparkSession, "labelled-values")
    texts = docs.select(F.col(text_col).alias("text"))
    found = written(texts.mapInArrow(lambda b: _labelled(b, fit_values, shortest, fit_length), "label string, h long, value string"), at)
    sample = {k: [r[0] for r in found.where(F.col("label") == k).groupBy("h", "value").count().orderBy("h", "value").limit(fit_values).select("value").collect()] for k in (*KINDS, PLAIN)}
    dropped(docs.sparkSession, at)
    formats = {k: infer(sample[k], risk) for k in KINDS if len(sample[k]) >= FEWEST}
    first = Formats(formats, infer(sample[PLAIN], risk), shortest, margin)
    if not formats:
        return first
    plain = [v for v in sample[PLAIN] if first.best(v)[0] <= STRAY]
    return Formats(formats, infer(plain, risk), shortest, margin)


def _scanned(batches: Iterator[pa.RecordBatch], model: Formats) -> Iterator[pa.RecordBatch]:
    secret: dict[str, str] = {}
    names = ("assign", "access", "hex")
    for batch in batches:
        rows = []
        for text in batch["text"].to_pylist():
            taken = base_spans(text or "")
            spans = [(s, k, e) for s, k, e, _ in taken]
            base = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
            counts = [sum(k == n for _, k, _ in spans) for n in range(3)]
            if model.formats:
                for start, end, value in runs(text or "", taken, model.shortest):
                    label = secret.get(value)
                    if label is None:
                        odds, label = model.best(value)
                        label = label if odds > model.margin else ""
                        if len(value) <= 64:
                            if len(secret) >= 200_000:
                                secret.clear()
                            secret[value] = label
                    if label:
                        spans.append((start, names.index(label), end))
            added = len(spans) - len(taken)
            rows.append((*counts, added, base, ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans)) if added else base))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "n_assign", "n_access", "n_hex", "n_added", "base", "spans"])


def find_secrets(docs: DataFrame, model: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, n_added, base, spans): one row for each row of ``docs``.

    ``base`` and ``spans`` list ``kind:start:end`` by start and kind (assign,
    access, hex), in code points, the end exclusive: whole matches of the base
    rules, and in ``spans`` also the runs that the formats add, under the label
    whose format explains them best. A run that meets a base span is not added.
    The counts are those of the base rules. A null or empty text has none of
    either. Repeated rows and null ids are rows of their own; other columns are
    not read.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = picked.mapInArrow(lambda b: _scanned(b, model), f"id {kind}, n_assign long, n_access long, n_hex long, n_added long, base string, spans string")
    return out.withColumnRenamed("id", id_col)
