import random

import xxhash
from helpers import ODD, SF, WORDS, given, table

from lodestone.llm.queries import op10_simhash
from lodestone.llm.simhash import components, fingerprint, links, near_duplicates


def simple(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes):
    """nodes: (id, fp); the least id of each fingerprint's component under at most two differing bits."""
    fps = sorted({f for _, f in nodes})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, f in nodes:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in fps}


def test_given_documents(spark):
    docs = table("documents")
    nodes = [(r["doc_id"], simple(r["text"])) for r in docs]
    root = roots(nodes)
    assert sorted(map(tuple, op10_simhash(spark, SF).collect())) == sorted((i, f"{f:016x}", root[f]) for i, f in nodes)


def test_odd_rows(spark):
    nodes = [(i, simple(t)) for i, t in ODD]
    root = roots(nodes)
    got = near_duplicates(given(spark, ODD)).collect()
    assert sorted((str(r[0]), r[1] % 2**64, r[2]) for r in got) == sorted((str(i), f, root[f]) for i, f in nodes)
    assert near_duplicates(given(spark, [])).collect() == []
    assert fingerprint([b"a", b"b"], 3) == xxhash.xxh64_intdigest(b"a b", 42)


def test_links_of_crowded_buckets(spark):
    """Fingerprints around few centres, so that buckets outgrow the pair limit; all limits agree with brute force."""
    rng = random.Random(3)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    nodes = [(f, f) for f in fps]
    want = roots(nodes)
    sign = lambda x: x - 2**64 if x >= 2**63 else x
    for bucket in (1, 3, 1000):
        edges = links(spark.createDataFrame([(sign(f),) for f in fps], "fp long"), bucket)
        got = {r[0] % 2**64: r[1] for r in components(edges).collect()}
        assert all((a ^ b).bit_count() <= 2 for a, b in ((r[0] % 2**64, r[1] % 2**64) for r in edges.collect()))
        groups = {}
        for f in fps:
            groups.setdefault(got.get(f, sign(f)), set()).add(f)
        wanted = {}
        for f in fps:
            wanted.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
