"""Language-model scoring with a Brown class-based bigram model.

Every word has a class; a text's probability is the product of class
transitions and word emissions: P(class | class before) * P(word | class).

Counting covers all training texts. Each chunk of documents gives its distinct
words with their counts; these meet by word hash with map-side combination,
and each chunk gets back the corpus counts of its own words only, so no task
or driver ever holds the vocabulary. A text is then a row of places in its
chunk's list of words, written once; all later steps read these small rows.

Exchange clustering assigns every training word to a class. The ``frequent``
most frequent words come first: on a table of their bigrams, one after another
moves to the class that raises the likelihood most, until none moves (or
``passes`` are done). While they move, the other words stand in the table as
context only, by powers of two of their counts. Then every other word, of any
count, is placed among these classes in parallel: the counts of the classes
before and after it, over the whole corpus, decide which class raises the
likelihood most.

Then all training words are exchanged, the frequent ones too, in rounds. In a
round each word is taken out of its class and put into the one that raises the
likelihood most, by the counts of the classes that now stand before and after
it: those of rare neighbours as well. All words move at once, so a round is
kept only if the likelihood of the whole training corpus has risen; rounds go
on until one does not raise it, or by less than ``settled`` a token.

Transitions and emissions are counted over all training texts with the final
classes. Unseen words are one type with a class of its own, whose transitions
are those of the words seen once (as many unseen tokens are expected as there
are words seen once).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chunks import Chunks
from lodestone.llm.common import dropped, longs, scratch, signed, text_bytes, written

FREQUENT, CLASSES, PASSES = 1000, 48, 8
#: Nats a token: a round of exchange over all words that raises the likelihood by less is the last.
SETTLED = 0.02
#: Symbols while the frequent words are clustered: powers of two of a count below END, then the end, then the frequent words.
END, WORDS = 62, 63
#: Documents whose words, and tokens whose classes, are looked at together.
SLICE, STEP = 1000, 1 << 19


def held_out(ids: pa.Array, folds: int, fold: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``folds``, is ``fold``; a null id counts as the text ''."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % folds == fold for x in ids.to_pylist()], dtype=bool)


class Numbers(dict):
    """Numbers words from 0 on as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def exchange(bigrams: np.ndarray, fixed: np.ndarray, classes: int, passes: int) -> np.ndarray:
    """Classes of symbols by exchange clustering; ``fixed`` symbols (a class each) stay where they are.

    ``bigrams[s, t]`` counts symbol t after s. The objective is the class
    bigram likelihood: sum of n log n over class pairs, less that over class
    totals on both sides.
    """
    n = len(bigrams)
    free = np.flatnonzero(~fixed)
    free = free[np.argsort(-bigrams[free].sum(1), kind="stable")]
    of = np.zeros(n, dtype=np.int64)
    of[fixed] = classes + np.arange(int(fixed.sum()))
    of[free] = np.arange(len(free)) % classes
    k = classes + int(fixed.sum())
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # by symbol: counts to and from each class
    table = member.T @ right
    for _ in range(passes):
        moved = 0
        for s in free:
            if not (right[s].any() or left[s].any()):
                continue
            old, self_count = of[s], bigrams[s, s]
            out, into = right[s].copy(), left[s].copy()
            out[old] -= self_count
            into[old] -= self_count
            # The table without s, then for every class the gain of putting s there.
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= self_count
            rows, cols = table.sum(1), table.sum(0)
            gain = (nlogn(table[:classes] + out) - nlogn(table[:classes])).sum(1) + (nlogn(table[:, :classes] + into[:, None]) - nlogn(table[:, :classes])).sum(0)
            same = table[np.arange(classes), np.arange(classes)]
            o, i = out[:classes], into[:classes]
            gain += nlogn(same + o + i + self_count) - nlogn(same + o) - nlogn(same + i) + nlogn(same)
            total_out, total_in = out.sum() + self_count, into.sum() + self_count
            gain -= nlogn(rows[:classes] + total_out) - nlogn(rows[:classes]) + nlogn(cols[:classes] + total_in) - nlogn(cols[:classes])
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            table[new] += out
            table[:, new] += into
            table[new, new] += self_count
            if new != old:
                of[s] = new
                right[:, old] -= bigrams[:, s]
                right[:, new] += bigrams[:, s]
                left[:, old] -= bigrams[s]
                left[:, new] += bigrams[s]
                moved += 1
        if not moved:
            break
    return of


def nlogn(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gains(key: np.ndarray, n: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """What ``n`` more bigrams with each context (``key``) add to each class."""
    held = np.concatenate((table[:, :classes], table[:classes].T))
    # Most words are rare: one more bigram is looked up.
    gains = (nlogn(held + 1) - nlogn(held))[key]
    many = np.flatnonzero(n > 1)
    gains[many] = nlogn(held[key[many]] + n[many, None]) - nlogn(held[key[many]])
    return gains


def placed(key: np.ndarray, n: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word the class whose rows and columns gain most likelihood by it; ties go to the lower class.

    ``table[c, d]`` counts class d after class c over the frequent words, and
    contexts alone beyond its first rows. A word has ``sizes`` keys with their
    counts ``n``, one word after another. A key below the number of columns is
    the class before the word, one above it (less that number) the class after.
    """
    k, width = classes_of(table), table.shape[1]
    rows, cols = table[:k].sum(1), table[:, :k].sum(0)
    begin = np.cumsum(sizes) - sizes
    gain = np.add.reduceat(_gains(key, n, table, k), begin, axis=0)
    before = np.add.reduceat(np.where(key < width, n, 0), begin)[:, None]
    after = np.add.reduceat(np.where(key < width, 0, n), begin)[:, None]
    gain -= nlogn(rows + after) - nlogn(rows) + nlogn(cols + before) - nlogn(cols)
    return np.argmax(gain, axis=1)


def classes_of(table: np.ndarray) -> int:
    """The word classes come first in a class table; the contexts of ``WORDS`` symbols follow."""
    return len(table) - WORDS


def exchanged(key: np.ndarray, n: np.ndarray, sizes: np.ndarray, own: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """For each word of class ``own`` the class that raises the likelihood most once the word is taken out of its own.

    ``table[c, d]`` counts class d after c over all training texts, the word's
    own steps included; keys and sizes as for ``placed``. A word stays where no
    class is better; of equal others it takes the lowest.
    """
    width = len(table)
    rows, cols = table.sum(1), table.sum(0)
    begin = np.cumsum(sizes) - sizes
    mine = np.repeat(own, sizes)
    held = np.where(key < width, table[key % width, mine], table[mine, key % width])
    stays = np.add.reduceat(nlogn(held) - nlogn(held - n), begin)
    gain = np.add.reduceat(_gains(key, n, table, classes), begin, axis=0)
    before, after = np.add.reduceat(np.where(key < width, n, 0), begin), np.add.reduceat(np.where(key < width, 0, n), begin)
    gain -= nlogn(rows[:classes] + after[:, None]) - nlogn(rows[:classes]) + nlogn(cols[:classes] + before[:, None]) - nlogn(cols[:classes])
    stays -= nlogn(rows[own]) - nlogn(rows[own] - after) + nlogn(cols[own]) - nlogn(cols[own] - before)
    gain[np.arange(len(own)), own] = -np.inf
    best = np.argmax(gain, axis=1)
    return np.where(gain[np.arange(len(own)), best] > stays + 1e-9, best, own)


def likelihood(pairs: np.ndarray) -> float:
    """The log likelihood of the training texts by their class pairs, but for what no class changes (each word's n log n)."""
    return float(nlogn(pairs).sum() - nlogn(pairs.sum(1)).sum() - nlogn(pairs.sum(0)).sum())


@dataclass
class Model:
    """log10 transitions between classes (word classes, then the end, then unseen words) and log10 class sizes."""

    moves: np.ndarray
    sizes: np.ndarray

    @classmethod
    def estimated(cls, pairs: np.ndarray, single: np.ndarray, sizes: np.ndarray) -> Model:
        """``pairs[c, d]`` counts class d after c in training texts, ``single`` the bigrams around words seen once (their class as "unseen")."""
        counts = pairs.astype(float) + single
        k = len(counts)
        prior = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * k)
        # Witten-Bell smoothing towards the class's own frequency.
        kinds = (counts > 0).sum(1, keepdims=True) + 1
        moves = np.log10((counts + kinds * prior) / (counts.sum(1, keepdims=True) + kinds))
        return cls(moves, np.log10(np.maximum(sizes, 1)))

    def score(self, classes: np.ndarray, counts: np.ndarray) -> float:
        """log10 probability of a text: its words' classes and their corpus counts (0: unseen), and the end."""
        end = len(self.moves) - 2
        row = np.concatenate(([end], classes, [end]))
        seen = counts > 0
        return float(self.moves[row[:-1], row[1:]].sum() + np.log10(counts[seen]).sum() - self.sizes[classes[seen]].sum())


def _sums(cells: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells and their sums."""
    if n is None:
        return np.unique(cells, return_counts=True)
    bits = int(n.max(initial=0)).bit_length()
    if int(cells.max(initial=0)).bit_length() + bits < 63:
        # Cell and count in one number sort faster than places do.
        both = np.sort((cells << bits) | n)
        cells, n = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(cells, kind="stable")
        cells, n = cells[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(cells)), bool), cells[1:] != cells[:-1])))
    return cells[first], np.add.reduceat(n, first) if len(first) else n


def _tallied(parts: Iterator[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells below ``size`` of all parts, and how often each comes."""
    total = np.zeros(size, dtype=np.int64)
    for cells in parts:
        total += np.bincount(cells, minlength=size)
    cells = np.flatnonzero(total)
    return cells, total[cells]


def _stretches(row: np.ndarray) -> Iterator[np.ndarray]:
    """``row`` in stretches of ``STEP`` steps from a token to the next; neighbours share the token between them."""
    for at in range(0, len(row) - 1, STEP):
        yield row[at : at + STEP + 1]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def _by_place(row: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """``at`` in parts of about ``STEP`` tokens, all tokens of a place in one part."""
    part_of = (np.cumsum(np.bincount(row[at])) // STEP).astype(np.int32)
    part = part_of[row[at]]
    for number in np.unique(part_of):
        if len(some := at[part == number]):
            yield some


def _around(row: np.ndarray, at: np.ndarray, class_of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, context) of the classes around the tokens ``at`` of a row of places, by each place's class.

    A context is one number, ``(count * (width + 2) * width + key) * width + own``.
    A key below width squared is the pair of classes around a word; those from
    it on are single classes, before or after, for words that have fewer of these.
    """
    cells, n = _sums((row[at].astype(np.int64) * width + class_of[row[at - 1]]) * width + class_of[row[at + 1]])
    place, pair = cells // width**2, cells % width**2
    single, m = _sums(np.concatenate((place * 2 * width + pair // width, place * 2 * width + width + pair % width)), np.concatenate((n, n)))
    fewer = np.bincount(single // (2 * width), minlength=len(class_of)) < np.bincount(place, minlength=len(class_of))
    as_pairs, as_single = ~fewer[place], fewer[single // (2 * width)]
    place = np.concatenate((place[as_pairs], single[as_single] // (2 * width)))
    key = np.concatenate((pair[as_pairs], width**2 + single[as_single] % (2 * width)))
    n = np.concatenate((n[as_pairs], m[as_single]))
    return place, (n * ((width + 2) * width) + key) * width + class_of[place]


def _words(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(words, own classes, keys, counts, keys a word) of whole words, some at a time, from rows in order of the word.

    Rows are as from ``_around``; a pair of classes counts once before the word
    and once after it. Only one word's sums are held from batch to batch.
    """
    held: list[np.ndarray] = []
    for batch in batches:
        if not len(batch):
            continue
        coded, own = np.divmod(batch["context"].to_numpy(), width)
        n, key = np.divmod(coded, (width + 2) * width)
        rows = [batch["word"].to_numpy(), own, key, n]
        word, own, key, n = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        at = np.repeat(np.arange(len(first)) * 2 * width, np.diff(first, append=len(word)))
        pair = key < width**2
        both = key[pair]
        cells = np.concatenate((at[pair] + both // width, at[pair] + width + both % width, at[~pair] + key[~pair] - width**2))
        cells, n = _sums(cells, np.concatenate((n[pair], n[pair], n[~pair])))
        begin = np.searchsorted(cells, np.arange(len(first)) * 2 * width)
        # The last word may go on in the next batch.
        last, key = begin[-1], cells % (2 * width)
        held = [np.repeat(x[first[-1:]], len(key) - last) for x in (word, own)] + [key[last:] + width**2, n[last:]]
        if last:
            yield word[first[:-1]], own[first[:-1]], key[:last], n[:last], np.diff(begin)
    if held:
        word, own, key, n = held
        yield word[:1], own[:1], key - width**2, n, np.array([len(key)])


def score_texts(
    docs: DataFrame,
    folds: int = 7,
    fold: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
    classes: int = CLASSES,
    passes: int = PASSES,
    settled: float = SETTLED,
    report: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Score every whole text; learn from those outside the held-out fold.

    Per row: id, ``held_out``, ``n_tokens`` (with the end), ``n_known``,
    ``train_tokens``, ``base_score`` (add-one unigram) and ``score``
    (class-based), both log10. A null or empty text is the end token alone.
    Repeated rows count again each time. A null id is learned from or held out
    as the text '' would be. Where nothing is learned, every token is unseen.
    An empty table gives an empty result. Other columns are not read.
    ``frequent`` is the number of words that the classes start from; every other
    training word is then placed in one, and all are exchanged. A ``report``
    dictionary takes the "likelihood" (nats a token, but for a constant) before
    the rounds of exchange and after each that was kept.
    """
    chunks = Chunks(docs, id_col, text_col)
    spark, kind = chunks.spark, chunks.id_type
    digest = xxhash.xxh64_intdigest
    paths: list[str] = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        paths.append(scratch(spark, tag))
        return written(df, paths[-1])

    def count(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Counter = Counter()
        others: set[bytes] = set()
        for batch in _sliced(batches):
            for text, out in zip(text_bytes(batch["text"]), held_out(batch["id"], folds, fold), strict=True):
                (others if out else learned).update(tokens(text))
        learned.update(dict.fromkeys(others.difference(learned), 0))
        hashes = np.fromiter(map(digest, learned), dtype=np.uint64, count=len(learned))
        yield pa.record_batch({"chunk": pa.array(np.full(len(hashes), chunk, np.int32)), "word": signed(hashes), "n": pa.array(np.fromiter(learned.values(), np.int64, len(learned)))})

    # A word has at most a row for each piece of a chunk, however frequent it is.
    local = kept(chunks.map(count, "chunk int, word long, n long"), "word-counts")
    dealt = local.repartition("word")
    totals = kept(dealt.groupBy("word").agg(F.sum("n").alias("total")), "word-totals")
    known = totals.where("total > 0")
    ends = chunks.table.select((F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % folds == fold).alias("out")).where("not out").count()
    words = known.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    n_train, vocabulary = int(words[0]) + ends, int(words[1]) + (ends > 0)
    top = known.orderBy(F.desc("total"), "word").limit(frequent).select("word").toArrow()["word"].to_numpy()
    symbol_of = np.sort(top)
    # A chunk's distinct words in order of their hash: a token is its place among them.
    # A chunk that several tasks read has a row from each of them.
    mine = kept(dealt.drop("n").join(totals, "word"), "chunk-words")
    dropped(spark, paths.pop(0))
    load = chunks.side(mine)

    def listed(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        held = load(chunk)
        if held is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, first = np.unique(held["word"].to_numpy(), return_index=True)
        return word, held["total"].to_numpy()[first]

    def encode(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, total = listed(chunk)
        number, place = Numbers(), np.zeros(0, dtype=np.int64)
        base_of = np.log10(total + 1.0) - np.log10(n_train + vocabulary + 1)
        base_end = float(np.log10(ends + 1.0) - np.log10(n_train + vocabulary + 1))
        for batch in _sliced(batches):
            known_before = len(number)
            texts = [np.array(list(map(number.__getitem__, tokens(x))), dtype=np.int64) for x in text_bytes(batch["text"])]
            new = islice(number, known_before, None)
            asked = np.fromiter(map(digest, new), dtype=np.uint64, count=len(number) - known_before).view(np.int64)
            place = np.concatenate((place, np.searchsorted(word, asked)))
            rows = [[] for _ in range(4)]
            for text in texts:
                at = place[text]
                found = (len(text) + 1, int((total[at] > 0).sum()) + (ends > 0), float(base_of[at].sum()) + base_end, at.astype("<i4").tobytes())
                for col, value in zip(rows, found, strict=True):
                    col.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary())
            out = [batch["id"], batch["chunk"], pa.array(held_out(batch["id"], folds, fold)), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(out, ["id", "chunk", "held_out", "n_tokens", "n_known", "base_score", "places"])

    schema = f"id {kind}, chunk int, held_out boolean, n_tokens long, n_known long, base_score double, places binary"
    coded = written(chunks.map(encode, schema), scratch(spark, "word-places"))
    dropped(spark, chunks.path)
    train = coded.where("not held_out").select("chunk", "places")

    def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """All places of a batch's texts end to end with an end (-1) before, between and after, and where these ends are."""
        parts = [np.frombuffer(x.as_buffer(), "<i4") for x in batch["places"]]
        row = np.full(sum(map(len, parts)) + len(parts) + 1, -1, dtype=np.int32)
        at = np.cumsum([1, *(len(x) + 1 for x in parts)])
        for begin, x in zip(at, parts, strict=False):
            row[begin : begin + len(x)] = x
        return row, at - 1

    def symbols(word: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Each listed word's symbol, and the end's as the last."""
        band = np.where(total > 1, np.frexp(total.astype(float))[1] - 1, 0)
        if len(symbol_of):
            at = np.minimum(np.searchsorted(symbol_of, word), len(symbol_of) - 1)
            band = np.where(symbol_of[at] == word, WORDS + at, band)
        return np.append(band, END)

    size = WORDS + frequent

    def bigrams(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = symbols(*listed(chunk))
        for batch in batches:
            row, _ = joined(batch)
            at, n = _tallied((of[x[:-1]] * size + of[x[1:]] for x in _stretches(row)), size * size)
            yield pa.record_batch({"cell": pa.array(at), "n": pa.array(n)})

    # At most size * size cells of two numbers, packed.
    cells = chunks.map(bigrams, "cell long, n long", train).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((size, size))
    table.reshape(-1)[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    of = exchange(table, np.arange(size) < WORDS, classes, passes)
    # Word classes first, then the context symbols.
    member = np.zeros((size, classes + WORDS))
    member[np.arange(size), of] = 1
    by_class = member.T @ table @ member
    width = classes + WORDS

    def contexts(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, total = listed(chunk)
        symbol = symbols(word, total)
        context = of[symbol]
        rest = np.append((total > 0) & (symbol[:-1] < WORDS), False)
        for batch in batches:
            row, _ = joined(batch)
            for some in _by_place(row, np.flatnonzero(rest[row])):
                place, met = _around(row, some, context, width)
                yield pa.record_batch({"word": pa.array(word[place]), "context": pa.array(met)})

    def by_word(rows: DataFrame) -> DataFrame:
        """All rows of a word in one task, one after another; they are summed as they stream by."""
        return rows.repartition("word").sortWithinPartitions("word")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, _, key, n, sizes in _words(batches, width):
            yield pa.record_batch({"word": pa.array(word), "class": pa.array(placed(key, n, sizes, by_class).astype(np.int32))})

    # Rows are summed in their batch before they are dealt by word.
    rest = by_word(chunks.map(contexts, "word long, context long", train)).mapInArrow(choose, "word long, class int")
    first = pa.table({"word": pa.array(symbol_of), "class": pa.array(of[WORDS : WORDS + len(symbol_of)].astype(np.int32))})
    assigned = kept(rest.union(spark.createDataFrame(first).select("word", F.col("class").cast("int"))), "word-classes")
    unseen, k = classes + 1, classes + 2

    def named(assigned: DataFrame) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        load = chunks.side(mine.select("word", "chunk").join(assigned, "word").select("chunk", "word", "class"))

        def classed(chunk: int) -> tuple[np.ndarray, np.ndarray]:
            """Each listed word's class and count, and the end's as the last."""
            word, total = listed(chunk)
            class_of, held = np.full(len(word) + 1, unseen), load(chunk)
            class_of[-1] = classes
            if held is not None:
                class_of[np.searchsorted(word, held["word"].to_numpy())] = held["class"].to_numpy()
            return class_of, np.append(total, 0)

        return classed

    def pair_counts(classed: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Class pairs of the training texts, and those around words seen once with their class as unseen."""

        def steps(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            class_of, total = classed(chunk)

            def stepped(row: np.ndarray) -> Iterator[np.ndarray]:
                for x in _stretches(row):
                    c, single = class_of[x].astype(np.int64), total[x] == 1
                    yield c[:-1] * k + c[1:]
                    as_unseen = np.where(single, unseen, c)
                    near = single[:-1] | single[1:]
                    yield k * k + as_unseen[:-1][near] * k + as_unseen[1:][near]

            for batch in batches:
                at, n = _tallied(stepped(joined(batch)[0]), 2 * k * k)
                yield pa.record_batch({"cell": pa.array(at), "n": pa.array(n)})

        cells = chunks.map(steps, "cell long, n long", train).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        pairs = np.zeros(2 * k * k, dtype=np.int64)
        pairs[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        return pairs[: k * k].reshape(k, k), pairs[k * k :].reshape(k, k)

    def regrouped(classed: Callable[[int], tuple[np.ndarray, np.ndarray]], pairs: np.ndarray) -> DataFrame:
        """(word, class): every training word after one round of exchange against the class pairs."""
        table = pairs.astype(float)

        def around(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word, _ = listed(chunk)
            class_of = classed(chunk)[0].astype(np.int64)
            for batch in batches:
                row, _ = joined(batch)
                for some in _by_place(row, np.flatnonzero(row >= 0)):
                    place, met = _around(row, some, class_of, k)
                    yield pa.record_batch({"word": pa.array(word[place]), "context": pa.array(met)})

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for word, own, key, n, sizes in _words(batches, k):
                yield pa.record_batch({"word": pa.array(word), "class": pa.array(exchanged(key, n, sizes, own, table, classes).astype(np.int32))})

        return by_word(chunks.map(around, "word long, context long", train)).mapInArrow(choose, "word long, class int")

    classed = named(assigned)
    pairs, single = pair_counts(classed)
    reached = [likelihood(pairs)]
    while n_train:
        old_side, old_classes = chunks.sides[-1], paths[-1]
        after = kept(regrouped(classed, pairs), "word-classes")
        after_classed = named(after)
        after_pairs, after_single = pair_counts(after_classed)
        gain = likelihood(after_pairs) - reached[-1]
        if gain <= 0:
            dropped(spark, chunks.sides.pop(), paths.pop())
            break
        dropped(spark, old_side, old_classes)
        classed, pairs, single = after_classed, after_pairs, after_single
        reached.append(reached[-1] + gain)
        if gain < settled * n_train:
            break
    if report is not None:
        report["likelihood"] = [x / max(1, n_train) for x in reached]
    sizes = np.append(pairs[:, :classes].sum(0), [0, 0]).astype(float)
    model = Model.estimated(pairs, single, sizes)
    dropped(spark, *paths)

    def score(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, total = classed(chunk)
        for batch in batches:
            out = []
            for x in batch["places"]:
                at = np.frombuffer(x.as_buffer(), "<i4")
                out.append(model.score(class_of[at], total[at]))
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in SHOWN), pa.array(out, pa.float64())], [*SHOWN, "score"])

    scored = chunks.map(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double", coded)
    return scored.withColumn("train_tokens", F.lit(n_train).cast("long")).withColumnRenamed("id", id_col)


SHOWN = ("id", "held_out", "n_tokens", "n_known", "base_score")
