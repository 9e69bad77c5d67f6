"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line gets a label, good or bad. Its score comes from surface features of
the line and of the lines beside it, and from the labels' transitions. The
marginal of "good" (forward-backward) is averaged over the lines, weighted by
their length, to the document's quality.

The model is fitted on a bounded sample of labelled documents: at most
``fit_docs`` documents of at most ``fit_lines`` lines in all, each with all its
lines. A line takes its document's label; a long document is fitted in
stretches of ``CHAIN`` lines. Everything else reads all rows and whole texts. The label, the
language, the source and the id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, scratch, text_bytes, written

FIT_DOCS = 6000
FIT_LINES = 400_000
#: Lines of one chain while fitting; a longer document gives several, so that no line is left out and steps stay short.
CHAIN = 400

#: Characters that mark machine-made or navigation lines, and sentence ends.
SYMBOLS, ENDS = b"#*$%&|<>", b".!?;:\"'"
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: The first SHARED features of a line are also features of its neighbours.
OWN, SHARED = 15, 10
FEATURES = OWN + 2 * SHARED


def line_features(line: bytes) -> list[float]:
    words = line.split()
    n, nw = max(1, len(line)), max(1, len(words))
    distinct = len(set(words)) / nw if words else 1.0
    shouted = (len(line) - len(line.translate(None, _UPPER))) / n
    marks = (len(line) - len(line.translate(None, SYMBOLS))) / n
    return [
        1.0 if words else 0.0,
        min(1.0, 4 * marks),
        min(1.0, 4 * line.count(b"|") / nw),
        min(1.0, 2 * line.count(b"!!") / nw),
        1.0 if shouted > 0.3 and nw > 2 else 0.0,
        (len(line) - len(line.translate(None, _DIGIT))) / n,
        1.0 - distinct,
        1.0 if nw >= 8 and distinct < 0.3 else 0.0,
        1.0 if marks > 0.02 else 0.0,
        sum(map(eq, words, words[1:])) / nw,
        1.0 if line.rstrip()[-1:] and line.rstrip()[-1] in ENDS else 0.0,
        min(1.0, np.log1p(nw) / 6),
        min(2.0, len(line) / nw / 10),
        1.0 if nw == 1 else 0.0,
        shouted,
    ]


def text_features(text: bytes) -> np.ndarray:
    """(lines, FEATURES): a line's own features, then those of the line before and after (0 beyond the ends)."""
    own = np.array([line_features(x) for x in text.split(b"\n")], dtype=np.float32)
    out = np.zeros((len(own), FEATURES), dtype=np.float32)
    out[:, :OWN] = own
    out[1:, OWN : OWN + SHARED] = own[:-1, :SHARED]
    out[:-1, OWN + SHARED :] = own[1:, :SHARED]
    return out


@dataclass
class LineCRF:
    """Emissions favour "good" by ``x @ weights + bias``; ``moves[i, j]`` scores label j after i; ``start`` the first."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    start: np.ndarray

    def chains(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of "good" of all lines, joined; pairwise sums (2, 2), sums of first labels (2,), log partitions.

        All texts move on together, one line a step: those sorted longest first that still have lines.
        """
        lengths = np.array([len(x) for x in texts])
        order = np.argsort(-lengths, kind="stable")
        x = np.concatenate(texts) if len(texts) else np.zeros((0, FEATURES), np.float32)
        begin = (np.cumsum(lengths) - lengths)[order]
        good = x @ self.weights + self.bias
        most = int(lengths.max(initial=0))
        alive = np.searchsorted(-lengths[order], -np.arange(most), side="left")
        scores = np.stack([np.zeros(len(good)), good], axis=1)
        ahead, back = np.zeros((len(good), 2)), np.zeros((len(good), 2))
        for t in range(most):
            at = begin[: alive[t]] + t
            before = self.start[None, :] if t == 0 else np.logaddexp(ahead[at - 1, :1] + self.moves[0], ahead[at - 1, 1:] + self.moves[1])
            ahead[at] = scores[at] + before
        pair = np.zeros((2, 2))
        total = np.zeros(len(texts))
        last = begin + lengths[order] - 1
        total[order] = np.logaddexp(ahead[last, 0], ahead[last, 1]) if len(texts) else 0
        for t in range(most - 2, -1, -1):
            at = begin[: alive[t + 1]] + t
            after = scores[at + 1] + back[at + 1]
            back[at] = np.logaddexp(self.moves[:, 0] + after[:, :1], self.moves[:, 1] + after[:, 1:])
            norm = total[order][: alive[t + 1], None]
            for i in (0, 1):
                pair[i] += np.exp(ahead[at, i : i + 1] + self.moves[i] + after - norm).sum(axis=0)
        line_total = np.repeat(total, lengths)
        marginal = np.exp(np.clip(ahead[:, 1] + back[:, 1] - line_total, -700, 0))
        first = np.array([(1 - marginal[begin]).sum(), marginal[begin].sum()]) if len(texts) else np.zeros(2)
        return marginal, pair, first, total

    @classmethod
    def fit(cls, texts: list[np.ndarray], labels: np.ndarray, steps: int = 160, rate: float = 0.2, decay: float = 0.0005) -> LineCRF:
        """Maximum conditional likelihood, by full-batch gradient steps with running scales (Adam)."""
        lengths = np.array([len(x) for x in texts])
        x = np.concatenate(texts)
        y = np.repeat(labels.astype(float), lengths)
        seen_pair = np.zeros((2, 2))
        for label in (0, 1):
            seen_pair[label, label] = (lengths - 1)[labels == label].sum()
        seen_first = np.array([(labels == 0).sum(), (labels == 1).sum()], dtype=float)
        # Stickiness between lines is bounded: one line's evidence must not settle a long text for good.
        theta = np.zeros(FEATURES + 1 + 4 + 2)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            model = cls(theta[:FEATURES], theta[FEATURES], theta[FEATURES + 1 : FEATURES + 5].reshape(2, 2), theta[FEATURES + 5 :])
            p, pair, first, _ = model.chains(texts)
            gap = y - p
            grad = np.concatenate((x.T @ gap, [gap.sum()], (seen_pair - pair).ravel(), seen_first - first)) / len(texts) - decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            theta[FEATURES + 1 : FEATURES + 5] = np.clip(theta[FEATURES + 1 : FEATURES + 5], -1.5, 1.5)
        return cls(theta[:FEATURES], float(theta[FEATURES]), theta[FEATURES + 1 : FEATURES + 5].reshape(2, 2), theta[FEATURES + 5 :])

    @classmethod
    def blank(cls) -> LineCRF:
        return cls(np.zeros(FEATURES), 0.0, np.zeros((2, 2)), np.zeros(2))


def held_out(id_column: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold; a null id counts as the text ''."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % folds == fold


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_docs: int = FIT_DOCS,
    fit_lines: int = FIT_LINES,
) -> LineCRF:
    """Fit on whole labelled documents outside the held-out fold: those of the smallest id hashes, within both bounds.

    A document that would exceed ``fit_lines`` lines in all is not sampled. A
    document labelled more than once takes the smallest label; of rows that
    share a labelled id one is sampled. Null ids have no label. Without any
    label the model is blank: every score is 0.5. With labels of one kind
    alone every line is taken for that kind.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("known_id")).agg(F.min(label_col).cast("int").alias("label"))
    known = known.withColumn("turn", F.xxhash64("known_id")).orderBy("turn", "known_id").limit(fit_docs)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most fit_docs rows of three numbers: the bound of this broadcast.
    rows = picked.join(F.broadcast(known), picked.id == known.known_id).select("turn", "known_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row")
    rows = rows.groupBy("turn", "known_id", "label").agg(one).select("turn", "label", "row.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [text_features(x) for x in text_bytes(batch["text"])]
            sizes = pa.array([len(x) for x in xs], pa.int64())
            yield pa.record_batch({"turn": batch["turn"], "label": batch["label"], "n_lines": sizes, "x": pa.array([x.tobytes() for x in xs], pa.binary())})

    at = scratch(spark, "crf-sample")
    sample = written(rows.mapInArrow(run, "turn long, label int, n_lines long, x binary"), at)
    # At most fit_docs rows: whole documents in order of their hash as long as they fit.
    order = Window.orderBy("turn", "n_lines", F.xxhash64("x")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sample.where(F.col("n_lines") <= fit_lines).withColumn("upto", F.sum("n_lines").over(order))
    taken = sizes.where(F.col("upto") <= fit_lines).select("label", "x").toArrow()
    dropped(spark, at)
    if not len(taken):
        return LineCRF.blank()
    texts, marks = [], []
    for label, data in zip(taken["label"].to_pylist(), taken["x"], strict=True):
        lines = np.frombuffer(data.as_buffer(), dtype=np.float32).reshape(-1, FEATURES)
        for begin in range(0, len(lines), CHAIN):
            texts.append(lines[begin : begin + CHAIN])
            marks.append(label)
    return LineCRF.fit(texts, np.array(marks))


def score_quality(
    docs: DataFrame,
    model: LineCRF,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: the id, ``score`` (0 to 1) and ``n_lines``, ``n_bad_lines``; ``keep`` names columns to carry along.

    A null or empty text is one empty line. Repeated rows get equal scores,
    null ids come back, other columns are not read, whatever their names; an
    empty table gives an empty result.
    """
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(x).alias(f"__keep_{x}") for x in keep])
    kinds = [(f.name, f.dataType.simpleString()) for f in picked.schema if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in [whole.slice(at, 1000) for at in range(0, len(whole), 1000)]:
                texts = text_bytes(batch["__text"])
                xs = [text_features(x) for x in texts]
                marginal = model.chains(xs)[0]
                weights = np.concatenate([np.fromiter((len(y) + 1 for y in x.split(b"\n")), float) for x in texts])
                begin = np.cumsum([0, *map(len, xs)])[:-1]
                score = np.add.reduceat(marginal * weights, begin) / np.add.reduceat(weights, begin)
                bad = np.add.reduceat((marginal < 0.5).astype(np.int64), begin)
                carried = [batch[k] for k, _ in kinds]
                yield pa.RecordBatch.from_arrays([*carried, pa.array(np.clip(score, 0, 1)), pa.array([len(x) for x in xs], pa.int64()), pa.array(bad)], [*(k for k, _ in kinds), "score", "n_lines", "n_bad_lines"])

    out = picked.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kinds) + ", score double, n_lines long, n_bad_lines long")
    return out.select(F.col("__id").alias(id_col), *(F.col(f"__keep_{x}").alias(x) for x in keep), "score", "n_lines", "n_bad_lines")
