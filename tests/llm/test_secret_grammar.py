import hashlib
import math
import random
import re
import string

from helpers import ODD, SF, given, table

from lodestone.llm.queries import op13_secret_grammar
from lodestone.llm.secret_grammar import find_secrets, fit_formats, infer


def brute_base(text):
    """The base rules as their contract words them."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(spans)]


def parsed(spans):
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]


def test_base_of_given_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    got = op13_secret_grammar(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        want = brute_base(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert set(want) <= set(parsed(r["spans"]))


def test_edges_of_the_base_rules(spark):
    texts = [
        "token=token:abcdefgh", "TOKEN == abcdef", "toKen=abcdefg paſſword=abcdefg", "api-key: abcdefg apikey:'abcdefg' API_KEY\" = \"abcde", "AKIA" + "A" * 15, "xAKIA" + "A9" * 8 + "é", "AKIAAKIA" + "Z" * 12,
        "é" * 5 + "0" * 23, "é" * 5 + "0" * 24 + "g", "secret:\n abcdefg", "password = " + "ab" * 20 + " ", "token: secret: abcdefgh", "a" * 30_000, "token=" + "=" * 7,
    ]
    docs = given(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in find_secrets(docs, fit_formats(docs)).collect()}
    for n, text in enumerate(texts):
        assert parsed(got[n]["base"]) == brute_base(text), text


def token(rng, kind):
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    return {
        "assign": lambda: "ghp_" + pick(string.ascii_letters + string.digits, 36),
        "access": lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        "hex": lambda: pick("0123456789abcdef", 40),
    }[kind]()


def corpus(rng, n, shapes):
    words = ["".join(rng.choice(["ing", "er", "tion", "ver", "heit", "lich", "an", "st", "que"]) for _ in range(rng.randrange(1, 8))) for _ in range(3000)]
    rows = []
    for k in range(n):
        body = [rng.choice(words) for _ in range(40)] + [str(rng.randrange(10**15, 10**16)), f"user.{k}@mail{k % 9}.example.com"]
        rng.shuffle(body)
        secret = shapes(k)
        body.insert(rng.randrange(len(body)), secret)
        rows.append((k, " ".join(body) + ".", secret))
    return rows


def test_stray_credentials_by_their_format(spark):
    """Formats come from labelled values; tokens of the same formats without a label are found, plain tokens are left alone."""
    rng = random.Random(8)
    kinds = ("assign", "access", "hex")

    def shape(k):
        value = token(rng, kinds[k % 3])
        if k % 10:
            return f'api_key = "{value}"' if k % 3 == 0 else value
        # Strays: no keyword, or too short for the rules.
        return value if k % 3 == 0 else value[:18] if k % 3 == 1 else value[:23]

    rows = corpus(rng, 900, shape)
    docs = given(spark, [r[:2] for r in rows])
    got = {r["doc_id"]: r for r in find_secrets(docs, fit_formats(docs)).collect()}
    strays = found = wrong = runs = 0
    for k, text, secret in rows:
        added = set(parsed(got[k]["spans"])) - set(parsed(got[k]["base"]))
        assert got[k]["n_added"] == len(added)
        where = (text.index(secret), text.index(secret) + len(secret))
        if k % 10 == 0 and not brute_base(text):
            strays += 1
            found += (kinds[k % 3], *where) in added
        wrong += sum(x[1:] != where for x in added)
        runs += len(re.findall("[A-Za-z0-9+/_.=-]{12,}", text))
    assert strays >= 80 and found >= 0.95 * strays
    assert runs > 10_000 and wrong <= 0.001 * runs


def test_merging_finds_the_automaton():
    """Strings of a known automaton (ab)*c: few states, and likelihoods near the true ones."""
    rng = random.Random(2)
    values = set()
    while len(values) < 400:
        values.add("".join(rng.choice("xy") + rng.choice("01") for _ in range(rng.randrange(1, 12))) + "=")
    a = infer(values)
    assert len(a.moves) <= 6
    assert abs(a.score("x0y1x1=") - math.log(1 / 11 / 2**6)) < 1  # lengths are uniform, of 11
    assert a.score("x0y1x1=") - a.score("0x1y1x=") > 10
    assert a.score("x0y1x1=") > a.score("x0y1x1")
    assert a.typical("x0y1x1=")[1] and not a.typical("x0y1xA=")[1]
    assert infer([]).score("abc") == infer([]).score("xyz")


def test_odd_rows_and_empty_tables(spark):
    docs = given(spark, ODD)
    got = find_secrets(docs, fit_formats(docs)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in ODD), key=str)
    assert all(r["spans"] == r["base"] for r in got)
    assert find_secrets(docs.limit(0), fit_formats(docs.limit(0))).collect() == []
