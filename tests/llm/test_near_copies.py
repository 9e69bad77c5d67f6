import random
import tempfile

import corpus_pipeline as cp
import numpy as np
from helpers import SF

from lodestone.llm import near_copies as near_copies_module
from lodestone.llm.near_copies import bands, linked, near_copies, parities, shingles


def sets(texts):
    return [frozenset(shingles((t or "").encode(), 5).tolist()) for t in texts]


def groups(of):
    out = {}
    for i, root in enumerate(of):
        out.setdefault(root, set()).add(i)
    return sorted(map(sorted, out.values()))


def brute(texts):
    """Components under exact Jaccard similarity of at least 0.8, by all pairs."""
    held, of = sets(texts), list(range(len(texts)))
    for i, a in enumerate(held):
        for j, b in enumerate(held[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) and of[i] != of[j]:
                of = [of[j] if x == of[i] else x for x in of]
    return groups(of)


def near(rng, n=120, copies=4):
    """Texts with copies of which a few words differ: similarities around 0.8."""
    texts = []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(words))
        for _ in range(copies):
            other = list(words)
            for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.005, 0.03)))):
                other[at] = "new"
            texts.append(" ".join(other))
    return texts


def test_links_are_those_of_all_pairs(spark):
    texts = near(random.Random(5)) + ["", None, "one two", "one two", "ONE two", "one three"]
    held = sets(texts)
    assert groups(linked([np.array(sorted(x), dtype=np.uint64) for x in held], 0.8)) == brute(texts)
    got = near_copies(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), id_col="id").collect()
    assert groups([r[1] for r in sorted(got)]) == brute(texts)
    assert near_copies(spark.createDataFrame([], "id long, text string"), id_col="id").collect() == []


def test_groups_of_many_cells(spark):
    """A chain whose ends are unlike, one large cluster and pairs: the same components whatever the size of a cell."""
    rng = random.Random(8)
    chain = [f"c{i}" for i in range(700)]
    texts = [" ".join(chain[i * 9 : i * 9 + 260]) for i in range(30)]
    base = [f"b{i}" for i in range(300)]
    for _ in range(40):
        other = list(base)
        other[rng.randrange(300)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(other))
    texts += near(rng, 10, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    at = tempfile.mkdtemp() + "/docs"
    docs.write.parquet(at)
    for cell in (3, 7, 1000):
        got = near_copies(spark.read.parquet(at), id_col="id", cell=cell).collect()
        assert groups([r[1] for r in sorted(got)]) == brute(texts)


def test_bands_meet_at_the_threshold():
    """Of pairs of similarity 0.8 to 0.82, which are the hardest, at least 0.98 share a band."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(500):
        common, own = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, (2, 48), dtype=np.uint64)
        met += bool((bands(np.concatenate((common, own[0]))) == bands(np.concatenate((common, own[1])))).any())
    assert met >= 490


def test_stage_removes_near_copies(spark):
    """Copies of similarity 0.8 and more, 3 to 14 bits apart by SimHash, go; each group keeps its smallest id."""
    texts = near(random.Random(7), 40, 2)
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r[0] for r in dict(cp.STAGES)[cp.STAGES[2][0]](spark, docs, SF).collect())
    assert got == [g[0] for g in brute(texts)] and len(got) < len(texts)


def test_parities_never_rule_out_a_similar_pair():
    """Sets differ by at least as many members as their parities differ in bits, at any size."""
    rng = np.random.default_rng(3)
    for size in (1, 9, 90, 900, 9000):
        for own in (0, 1, size // 9, size):
            common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (size, own, own))
            x, y = parities(np.concatenate((common, a))), parities(np.concatenate((common, b)))
            assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= 2 * own


def test_texts_that_share_a_passage_do_not_chain_to_one_group(spark, monkeypatch):
    """Neighbours of similarity 0.6 often share a band; only the two real copies are a group that has to be compared."""
    words = [f"p{i}" for i in range(12_000)]
    texts = [" ".join(words[i * 50 : i * 50 + 200]) for i in range(200)]
    texts.append(texts[0].replace("p100 ", "new "))
    sizes, settled = [], near_copies_module._settled

    def seen(docs, members, *rest):
        sizes.extend(r["count"] for r in members.groupBy("root").count().collect())
        return settled(docs, members, *rest)

    monkeypatch.setattr(near_copies_module, "_settled", seen)
    at = tempfile.mkdtemp() + "/docs"
    spark.createDataFrame(list(enumerate(texts)), "id long, text string").write.parquet(at)
    got = near_copies(spark.read.parquet(at), id_col="id").collect()
    assert groups([r[1] for r in sorted(got)]) == brute(texts)
    assert sizes == [2]
