"""Each stage against a brute-force version over its own input, on small documents."""

from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pytest
from helpers import SF, WORDS, table
from test_line_dedup import brute as brute_lines
from test_near_copies import brute as by_all_pairs
from test_tokens import checked

SF2 = SF.replace("0.001", "0.01")


PROSE = "The quick brown fox jumps over the lazy dog and goes home again.\nIt rests there until the morning comes and the sun is up."


def rows(df):
    return [tuple(r) for r in df.select(*cp.COLUMNS).collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    labels = {r["doc_id"]: r for r in table("labels", SF2)}
    stages = dict(cp.STAGES)
    names = [n for n, _ in cp.STAGES]
    given = rows(docs)

    def step(name, df):
        stages[name](spark, df, SF2).write.parquet(f"{tmp_path}/{names.index(name)}")
        return spark.read.parquet(f"{tmp_path}/{names.index(name)}")

    # Quality: nothing new, clean documents stay, bad ones go.
    good = step(names[0], docs)
    assert good.columns == docs.columns and not set(rows(good)) - set(given)
    kept = {r[0] for r in rows(good)}
    clean = [i for i, r in labels.items() if r["quality"] == 1]
    bad = [i for i, r in labels.items() if r["quality"] == 0]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean) and sum(i in kept for i in bad) <= 0.1 * len(bad)

    # Lines: exactly those of at least ten documents go.
    lined = step(names[1], good)
    want = sorted((i, t) for i, _, _, t in brute_lines([r[:2] for r in rows(good)], 10))
    assert sorted((str(r[0]), r[1]) for r in rows(lined)) == want and all(r[4] == len(r[1]) for r in rows(lined))

    # Near-duplicates: one of each component of exact Jaccard similarity 0.8 on five-word shingles; texts without words stay.
    single = step(names[2], lined)
    worded = [r for r in rows(lined) if WORDS.search(r[1])]
    groups = [[worded[i] for i in g] for g in by_all_pairs([r[1] for r in worded])]
    expected = {min(g)[0] for g in groups} | {r[0] for r in rows(lined) if not WORDS.search(r[1])}
    assert sorted(r[0] for r in rows(single)) == sorted(expected) and len(groups) < len(worded)

    # Mixing: whole rows, clean ones at least once, toxic ones thinned.
    mixed = step(names[3], single)
    assert mixed.columns == docs.columns and not set(rows(mixed)) - set(rows(single))
    copies = Counter(r[0] for r in rows(mixed))
    clean = [r[0] for r in rows(single) if (labels.get(r[0], {}).get("quality"), labels.get(r[0], {}).get("toxic")) == (1, 0)]
    toxic = [r[0] for r in rows(single) if labels.get(r[0], {}).get("toxic") == 1]
    assert sum(copies[i] >= 1 for i in clean) >= 0.99 * len(clean) and max(copies.values()) <= 2
    assert sum(copies[i] for i in toxic) <= 0.6 * len(toxic)

    # Packing: every piece of what is left.
    packed = stages[names[4]](spark, mixed, SF2).collect()
    n, least = checked([r[:2] for r in rows(mixed)], packed, 2048, 0)
    assert n <= 1.03 * least + 1


def test_run(spark):
    out = cp.run(spark, SF)
    assert sorted(out.columns) == sorted(["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])
    assert out.count() > 0 and out.where("size(ids) <> length").count() == 0


ODD_ROWS = [(1, None), (2, ""), (3, " \n\t"), (None, PROSE), (None, PROSE + " Other words follow here, and many more of them come, so that this is no copy at all."), (5, PROSE), (5, PROSE), (5, "Quite another text stands here, with words of its own and an end."), (6, "x " * 4000)]


def odd(spark, rows=ODD_ROWS):
    """Rows with null and repeated ids, repeated and very long texts, and extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, copies string, score string, component string"
    return spark.createDataFrame([(i, t, None, "s", None, 1, "x", "y", "z", "w") for i, t in rows], schema)


@pytest.mark.parametrize("number", range(4))
def test_odd_rows_of_each_stage(spark, number):
    out = cp.STAGES[number][1](spark, odd(spark), SF)
    assert tuple(out.columns) == cp.COLUMNS
    got, given = [r[:2] for r in rows(out)], list(ODD_ROWS)
    if number == 2:  # one row of the equal texts stays; texts without words and the others all stay
        given = [r for n, r in enumerate(ODD_ROWS) if n not in (3, 6)]
        assert sorted(map(str, got)) == sorted(map(str, given))
    elif number == 1:
        assert sorted(str((i, t)) for i, t in got) == sorted(str((i, t or "")) for i, t in given)
    else:
        assert not {str(r) for r in got} - {str(r) for r in given} and {str((i, t)) for i, t in got} >= {str((5, PROSE)), str((None, PROSE))}
    assert cp.STAGES[number][1](spark, odd(spark, []), SF).collect() == []


def test_odd_rows_are_packed(spark):
    out = cp.STAGES[4][1](spark, odd(spark), SF)
    checked(ODD_ROWS, out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect(), 2048, 0)
    assert cp.STAGES[4][1](spark, odd(spark, []), SF).collect() == []


def test_unreachable_targets_give_few_copies(spark):
    """Hardly a good document among many low ones: no document comes more often than the bound, and all good ones stay."""
    rng = np.random.default_rng(3)
    low = [(i, " ".join(f"spam{rng.integers(9)} $$$" for _ in range(40))) for i in range(60)]
    docs = odd(spark, [*low, (100, PROSE)])
    out = Counter(r["doc_id"] for r in cp.STAGES[3][1](spark, docs, SF).collect())
    assert max(out.values(), default=0) <= cp.MAX_RATE


@pytest.mark.filterwarnings("ignore:no nonnegative rates")
def test_mixing_works_a_rate_out_once(spark):
    """After many steps a rate stands once in the plan that writes the documents, with a bounded number of expressions."""
    rng = np.random.default_rng(3)
    low = [(i, " ".join(f"spam{rng.integers(9)} $$$" for _ in range(40))) for i in range(60)]
    out = cp.STAGES[3][1](spark, odd(spark, [*low, (100, PROSE)]), SF)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("greatest(") == 1
