"""The divergence of sources against the definition in plain Python, and its edge cases."""

import random
import re
from collections import Counter

import pytest

from kotomill.llm import common, divergence

SCHEMA = "text string, lang string, source string, n long, term string"


def plain(rows, least=divergence.LEAST):
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, a, b, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(w for a, _, words in docs if a == lang for w in set(words))
        kept = {w for w, n in held.items() if n >= least}
        count = {s: Counter() for a, s, _ in docs if a == lang}
        for a, s, words in docs:
            if a == lang:
                count[s].update(w for w in words if w in kept)
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = [(sum(apart(share(c, w), share(o, w)) for w in kept), x) for x, o in count.items() if x != s]
            terms = [(apart(share(c, w), share(whole, w)), w) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, k) for k, (v, x) in enumerate(ranked, 1) if part == "pair" or k <= 10]
    return sorted(out)


def audited(spark, rows):
    return sorted(map(tuple, divergence.audit(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)).collect()))


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"{c}{d}" for c in "abcdÉéß漢" for d in ("", "x", "Y", "é")]
    row = lambda: (" ".join(rng.choice(words[: rng.randrange(1, len(words))]) for _ in range(rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "Ｓ3", "😀", None]))
    return [row() for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_the_definition(spark, seed):
    rows = corpus(seed)
    got = audited(spark, rows)
    assert got == plain(rows) and {r[2] for r in got} == {"pair", "term"}


def test_groups_beyond_the_broadcast(spark, monkeypatch):
    """The salted cross of groups and terms gives the same rows."""
    rows = corpus(5)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(divergence, "SALTS", 5)
    assert audited(spark, rows) == plain(rows)


def test_edges(spark):
    """Nulls, no kept terms, one source, repeated rows, long texts, separators of every kind."""
    assert audited(spark, [(None, None, None)]) == []
    assert audited(spark, [("a", "en", "s"), ("b", "en", None), (None, "de", "s")]) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]
    rows = [("word " * 20_000 + "Z@z[`{\x7f\x00É", "en", "s")] * 11 + [("word other", "en", "t")] * 10 + [("", "en", "u")]
    assert audited(spark, rows) == plain(rows)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_63_bits(spark):
    """10^9 times a count of 10^12 does not fit a long."""
    from pyspark.sql import functions as F

    of = spark.range(1).select(divergence._share(F.lit(10**12), F.lit(3 * 10**12 + 1), F.lit(1000)).alias("p"))
    assert of.first().p == 1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 1 + 2000)
