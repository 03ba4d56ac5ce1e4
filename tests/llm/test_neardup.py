"""The pipeline's near copies against brute-force Jaccard."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from kotomill.llm import neardup
from kotomill.llm.common import Cut

WORDS = [f"w{k}" for k in range(400)]


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def plain_roots(texts):
    """For each text the first text of its component."""
    sets, top = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng):
    """Unrelated texts, and three families with none to many edits, so that similarities lie on both sides of 0.8."""
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 2, 4, 5, 40, 120)))) for _ in range(60)]
    for _ in range(3):
        base = [rng.choice(WORDS) for _ in range(200)]
        for _ in range(60):
            words = base[:]
            for _ in range(rng.choice((0, 1, 2, 4, 5, 6, 9, 14))):
                words[rng.randrange(200)] = rng.choice(WORDS)
            texts.append(" ".join(words))
    return [*texts, None, "", " \t\n", texts[3].upper(), texts[70] + "\n"]


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_against_jaccard(spark, seed):
    texts = edited(random.Random(seed))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.distinct(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_roots(texts)))


def test_stage_on_a_table(spark):
    """Near copies that differ in more than three bits of a fingerprint go."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    ids = sorted(texts)
    roots = plain_roots([texts[d] for d in ids])
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, rows, None).collect()} == {ids[k] for k in roots}


def test_sketches_meet():
    """Of pairs just over 0.8 nearly all share a key and none is too far; unrelated texts share none."""
    rng = random.Random(3)
    missed = 0
    for _ in range(300):
        words = [str(rng.random()) for _ in range(104)]
        other = [*words[:-11], *(str(rng.random()) for _ in range(11))]
        a, b, c = (neardup.shingles(" ".join(x)) for x in (words, other, words[::-1]))
        same = len(set(a[:, 0]) & set(b[:, 0]))
        assert 0.8 < same / (len(a) + len(b) - same) < 0.81
        bits = [neardup.fingerprint(x, neardup.WORDS) for x in (a, b, c)]
        assert all((neardup.fingerprint(x, 4) == w[:256]).all() for x, w in zip((a, b, c), bits, strict=True))
        row, key = neardup.keys(np.stack(bits)[:, :256], np.stack([neardup.anchors(x) for x in (a, b, c)]))
        x, y, z = (set(key[row == k]) for k in range(3))
        missed += not x & y or (bits[0] != bits[1]).sum() > neardup.FAR
        assert not x & z
    assert missed <= 3


@pytest.mark.parametrize("n", [0, 1, 300, 5000])
def test_sketch_against_counting(n):
    found = np.random.default_rng(n).integers(0, 1 << 63, (n, 2), np.uint64)
    bits, low = neardup.fingerprint(found, 3), neardup.anchors(found)
    for b in (0, 63, 127):
        byte = found.view(np.uint8)[:, b // 8]
        assert bits[b] == (2 * int((byte >> (7 - b % 8) & 1).sum()) > n)
    assert low[3] == min([int(x) for x in (found[:, 0] ^ neardup._XOR[3]) * neardup._ODD[3]], default=2**64 - 1)


def test_stage_of_nothing(spark):
    assert corpus_pipeline.distinct(spark, spark.createDataFrame([], "doc_id long, text string"), None).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Copies without an id, repeated rows, and an id on two texts of which one is a copy."""
    text = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdef"]
    rows = [(None, text[0]), (None, text[0]), (1, text[1]), (1, text[1]), (2, text[2]), (3, text[2]), (3, text[3]), (None, text[4]), (9, text[4]), (None, text[5])]
    got = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), None).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, text[0]), (1, text[1]), (2, text[2]), (3, text[3]), (9, text[4]), (None, text[5])], key=str)


def test_hot_family(spark):
    """A family of hundreds with similarities on both sides of 0.8: one row of each component, as brute force finds them."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(150)]
    texts = []
    for _ in range(500):
        words = base[:]
        for _ in range(rng.randrange(12)):
            words[rng.randrange(150)] = rng.choice(WORDS)
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, node int")
    got = {r.doc_id for r in neardup.survivors(docs).collect()}
    assert got == set(plain_roots(texts)) and neardup.survivors(docs).columns == docs.columns


def test_passing_tables_go(spark):
    """Of the tables that the stage writes, only those stay that its result reads."""
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "kotomill"
    before = set(folder.iterdir()) if folder.exists() else set()
    docs = spark.createDataFrame([(k, f"some words {k // 2} that are the same twice") for k in range(20)], "doc_id long, text string")
    assert neardup.survivors(docs).count() == 10
    assert sorted(x.name.rsplit("-", 1)[0] for x in set(folder.iterdir()) - before) == ["copy-extra", "copy-rows"]


def star(rng, n):
    """A text and copies of it, every third with so many edits that it is alike to none or few."""
    base = [str(rng.random()) for _ in range(150)]
    texts = [" ".join(base)]
    for k in range(n):
        words = base[:]
        for at in rng.sample(range(150), 4 + k % 2 if k % 3 == 0 else rng.randrange(1, 4)):
            words[at] = str(rng.random())
        texts.append(" ".join(words))
    return texts


def test_pairs_of_a_hot_family_grow_with_its_size(spark, monkeypatch):
    """Members outside a large component are not compared with all of it."""
    compared = []
    plain = neardup.Links.alike
    monkeypatch.setattr(neardup.Links, "alike", lambda self, pairs: compared.append(pairs.distinct().count()) or plain(self, pairs))
    texts = star(random.Random(4), 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, docs, None).collect()} == set(plain_roots(texts))
    assert compared[-1] < 8 * len(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_differences_leave_out_no_link(spark, monkeypatch, seed):
    """Without leads and direct pairs: edits that members share, cuts at either end, and words left out."""
    monkeypatch.setattr(neardup, "FEW", 0)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    rng = random.Random(seed)
    texts = edited(rng)
    for _ in range(2):
        base = [rng.choice(WORDS) for _ in range(150)]
        for _ in range(80):
            words = base[rng.choice((0, 0, 10, 20, 30)) : 150 - rng.choice((0, 0, 10, 20))]
            for _ in range(rng.randrange(4)):
                at = 10 * rng.randrange(len(words) // 10)
                words[at : at + 1] = rng.choice(([], ["same"], [rng.choice(WORDS)]))
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, None).collect()) == sorted(set(plain_roots(texts)))


def test_texts_that_share_a_passage_stay_apart(spark, monkeypatch):
    """Texts that share three quarters of their words are no near copies, and no table of the stage has a row for each of their differences."""
    written = []
    monkeypatch.setattr(neardup, "Cut", lambda df, name: written.append(Cut(df, name)) or written[-1])
    monkeypatch.setattr(Cut, "drop", lambda self: None)
    rng = random.Random(6)
    passage = [str(rng.random()) for _ in range(150)]
    texts = [" ".join([*passage, *(str(rng.random()) for _ in range(50))]) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert neardup.survivors(docs).count() == len(texts)
    rows = {cut.path.rsplit("/", 1)[-1]: cut.df.count() for cut in written}
    assert max(n for name, n in rows.items() if name.startswith("copy-met")) > 5 * len(texts)
    assert max(rows.values()) < 60 * len(texts), rows
