import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from lodestone.llm.encoding import default_tokenizer, encoder
from lodestone.llm.packing import pack
from lodestone.llm.token_store import write_tokens


def plain(text):
    """The ids of an unmodified tokenizer."""
    return Tokenizer.from_file(default_tokenizer()).encode(text, add_special_tokens=False).ids


TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "one two"]


def test_added_tokens_encode_as_plain():
    t = Tokenizer.from_file(default_tokenizer())
    rng = random.Random(2)
    some = [" ", "  ", "\n", "a", "bc", "é", "'s", "12", "?.", "<|endoftext|>", "<|", "日本", "🙂", "word"]
    texts = TEXTS + ["".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(1000)]
    assert [x.tolist() for x in encoder(default_tokenizer()).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_store_and_packing_with_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    store = write_tokens(docs, default_tokenizer(), end_id=2)
    assert all(store.get(i).tolist() == [*plain(x), 2] for i, x in enumerate(TEXTS))
    crc = {i: zlib.crc32(np.array([*plain(x), 0], dtype="<u4").tobytes()) for i, x in enumerate(TEXTS)}
    assert {r["doc_id"]: r["ids_crc32"] for r in pack(docs, default_tokenizer(), 0, 2048).collect()} == crc
