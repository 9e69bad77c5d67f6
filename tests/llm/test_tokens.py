import functools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from helpers import ODD, SF, given, table
from tokenizers import Tokenizer

from lodestone.llm.encoding import default_tokenizer, encoder
from lodestone.llm.packing import BestFit, pack, pieces
from lodestone.llm.queries import op2_token_store, op6_best_fit_packing
from lodestone.llm.token_store import TokenStore, write_tokens


@functools.cache
def plain():
    """The tokenizer as its file gives it: the call of the contract, nothing set."""
    return Tokenizer.from_file(default_tokenizer())


def ids(text):
    return plain().encode(text or "", add_special_tokens=False).ids


def test_parts_and_pieces_encode_like_whole_texts():
    rng = random.Random(1)
    some = [" ", "  ", "\n", "\t", " \n", "a", "bc", "é", "'s", "'", "12", "!", "?.", "\x1c", "<|endoftext|>", "日本", "🙂", "\x85", "\u200b", "word"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(2000)]
    assert [x.tolist() for x in encoder(default_tokenizer()).encode(texts)] == [ids(x) for x in texts]


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def test_store_of_given_documents(spark):
    at, want = 0, []
    for r in sorted(table("documents"), key=lambda r: r["doc_id"]):
        x = [*ids(r["text"]), 2]
        want.append((r["doc_id"], at, len(x), crc(x)))
        at += len(x)
    assert sorted(map(tuple, op2_token_store(spark, SF).collect())) == want


def test_keyed_access_and_odd_rows(spark):
    store = write_tokens(given(spark, ODD), default_tokenizer(), keys_per_index=4)
    text = {i: t for i, t in ODD}
    for key, t in text.items():
        assert store.get(key).tolist() == [*ids(t), 2]
    assert store.get(12345) is None and store.get(4, 1).tolist() == store.get(4).tolist() and store.get(4, 2) is None and store.count(4) == 2
    got = [tuple(r) for r in store.read(spark.createDataFrame([(4,), (4,), (777,), (None,)], "k long")).collect()]
    assert sorted((r[0] for r in got), key=str) == [4, 4, None] and {r[0]: r[1] for r in got}[None] == 0 and {r[0]: r[2] for r in got}[4] == len(ids(text[4])) + 1
    empty = write_tokens(given(spark, []), default_tokenizer())
    assert empty.read(spark.createDataFrame([(1,)], "k long")).collect() == [] and empty.get(1) is None


def test_rows_that_share_an_id_are_documents_each(spark):
    """A hot key, null keys and string keys: every row is kept, in one run, and the store can be opened again."""
    rows = [(1, "alpha beta"), (1, "other text here"), (None, "x"), (None, "y")] + [(2, f"copy {i % 3}") for i in range(200)] + [(3, "last")]
    store = write_tokens(given(spark, rows), default_tokenizer(), keys_per_index=16)
    got = sorted((tuple(r) for r in store.read(given(spark, rows).select("doc_id")).collect()), key=lambda r: r[1])
    assert len(got) == len(rows) and [r[0] for r in got] == [None] * 2 + [1] * 2 + [2] * 200 + [3]
    want = sorted((str(i), len(ids(t)) + 1, crc([*ids(t), 2])) for i, t in rows)
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == want
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    again = TokenStore.open(spark, store.path)
    assert again.count(2) == 200 and sorted(again.get(1, i).tolist() for i in (0, 1)) == sorted([*ids(t), 2] for i, t in rows if i == 1)
    named = write_tokens(spark.createDataFrame([("b", "one"), ("a", "two")], "doc_id string, text string"), default_tokenizer())
    assert named.get("a").tolist() == [*ids("two"), 2] and named.get("c") is None


def checked(rows, out, size, end):
    """Pieces, places and how many sequences, against plain encoding."""
    want = defaultdict(int)
    for i, t in rows:
        x = [*ids(t), end]
        first = len(x) % size or size
        for piece, start in enumerate([0, *range(first, len(x), size)]):
            part = x[start : start + (first if piece == 0 else size)]
            want[i, piece, start, len(part), crc(part)] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in out:
        got[tuple(r)[:5]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(places), math.ceil(sum(k[3] * n for k, n in want.items()) / size)


def test_packing_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents", "/root/testdata/sf0.01")]
    n, least = checked(rows, op6_best_fit_packing(spark, "/root/testdata/sf0.01").collect(), 2048, 0)
    assert n <= 1.02 * least + 1


def test_packing_odd_rows(spark):
    for open_bins, per in ((1, 3), (4, 1000)):
        checked(ODD, pack(given(spark, ODD), default_tokenizer(), 0, 64, open_bins=open_bins, pieces_per_packer=per).collect(), 64, 0)
    assert pack(given(spark, []), default_tokenizer()).collect() == []
    whole = pack(given(spark, ODD), default_tokenizer(), 0, 64, with_ids=True).collect()
    assert all(crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in whole) and len(whole) == sum(-(-(len(ids(t)) + 1) // 64) for _, t in ODD)


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    fit = BestFit(10, 2)
    assert [fit.place(x) for x in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
    assert fit.place(4) == (0, 6)
    assert [fit.place(x) for x in (9, 5)] == [(2, 0), (3, 0)]
    assert fit.place(8) == (4, 0)  # bin 2, the fullest, closed
    assert fit.place(1) == (4, 8) and fit.place(1) == (4, 9) and fit.place(5) == (3, 5)


def test_equal_rows_use_all_packers(spark):
    """Rows that are equal in every column spread over the packers, and each is packed once."""
    docs = spark.createDataFrame([(None, "")], "doc_id long, text string").crossJoin(spark.range(6000)).select("doc_id", "text")
    got = pack(docs, default_tokenizer(), end_id=0, size=64, pieces_per_packer=500).collect()
    packers = Counter(r["sequence_id"] % 12 for r in got)
    assert len(packers) == 12 and max(packers.values()) < 3 * 500
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 6000


def test_packing_keeps_known_parts_for_the_next_task(spark):
    """A worker that has encoded a word for packing knows its ids when its next task begins; with ids it forgets them."""

    def knows(word):
        def look(batches):
            from lodestone.llm.encoding import _encoders

            for batch in batches:
                found = any(word in x.parts for x in _encoders.values())
                yield pa.record_batch({"found": pa.array([found] * len(batch))})

        return spark.range(0, 400, 1, 8).mapInArrow(look, "found boolean").where("found").count() > 0

    for word, with_ids in (("keptwordofpacking", False), ("forgottenwordofpacking", True)):
        docs = spark.createDataFrame([(i, f"a {word} {i}") for i in range(40)], "doc_id long, text string").repartition(8)
        pieces(docs, default_tokenizer(), 0, 2048, with_ids=with_ids).count()
        assert knows(word) == (not with_ids)
