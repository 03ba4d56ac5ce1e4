"""Near duplicates, leaks, quotations and exact search against brute force, and their edge cases."""

import itertools
import random
import re
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kotomill.llm import components, decontam, quotes, simhash, topk
from kotomill.llm.common import Cut

WORDS = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- SimHash --------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    top = list(range(len(ids)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        low.setdefault(find(i), []).append(d)
    return [min((d for d in low[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_golay_code():
    golay = simhash.Golay.get()
    assert len(set(golay.error.tolist())) == 2048
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000).astype(np.int32)
    rows, _ = golay.near(words, 23)
    assert set(np.bincount(rows)) <= {1, 6}


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_close_fingerprints_meet(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    row, key = simhash.keys(np.array([x, y], np.uint64))
    assert set(key[row == 0]) & set(key[row == 1])


def test_unrelated_fingerprints_do_not_meet():
    """Keys grow with the table; shared keys do not grow with its square at these sizes."""
    prints = np.random.default_rng(1).integers(0, 1 << 63, 20_000, np.uint64)
    row, key = simhash.keys(prints)
    assert 90 * len(prints) < len(key) < 121 * len(prints)
    found, n = np.unique(key, return_counts=True)
    assert (n > 1).sum() < 0.0002 * len(found)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "A b C d", "é É x　y z", "a\x1cb\x85c d"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def copies(seed):
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.choice((1, 2, 3, 40, 120)))) for k in range(60)]
    base = prose(rng, 200).split()
    for k in range(60, 160):
        words = base[:]
        for _ in range(rng.choice((0, 1, 1, 2))):
            words[rng.randrange(200)] = rng.choice(WORDS)
        rows.append((k, " ".join(words)))
    return [*rows, (200, None), (201, ""), (202, rows[3][1].upper()), (None, rows[5][1]), (7, rows[7][1]), (7, prose(rng, 50)), (203, prose(rng, 30_000))]


@pytest.mark.parametrize("direct", [64, 2])
def test_near_duplicates(spark, monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)  # 2: the full keys are dealt out in cells
    monkeypatch.setattr(simhash, "BLOCK", 16 if direct == 2 else 512)
    rows = copies(1)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [plain_fingerprint(t) for _, t in rows]
    assert got == sorted(zip([d for d, _ in rows], prints, plain_components([d for d, _ in rows], prints), strict=True), key=str)


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 502), (3, 3), (7, None)] + [(1000, k) for k in range(1001, 1400)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500, 502: 500} | {k: 1000 for k in range(1000, 1400)}


# --- decontamination ------------------------------------------------------------------------------


def plain_leaks(docs, items):
    cut = lambda t: re.findall(r"[一-鿿ぁ-ゖァ-ヺ]|(?:(?![一-鿿ぁ-ゖァ-ヺ])[^\W_])+", (t or "").lower())
    found = set()
    for d, text in docs:
        for i, item in items:
            x, y = cut(item), cut(text)
            n, width = len(x), min(13, len(x))
            if n < 5:
                found |= {(d, i) for line in (text or "").splitlines() if x and cut(line) == x}
                continue
            for shift in range(-n, len(y) + 1):
                same = [0 <= j + shift < len(y) and x[j] == y[j + shift] for j in range(n)]
                if max(sum(same[k : k + width]) for k in range(n - width + 1)) >= -(-8 * width // 10):
                    found.add((d, i))
                    break
    return found


def test_leaks(spark):
    rng = random.Random(5)
    items = [(0, prose(rng, 30)), (1, prose(rng, 14)), (2, "Five words are quite enough"), (3, "too short, this"), (4, prose(rng, 8)), (5, None), (6, ""), (7, prose(rng, 11)), (1, prose(rng, 14)), (8, "Yes!"), (9, "in 1492"), (10, "春の朝に川辺を歩くと白い鳥が三羽静かに飛んだ"), (11, prose(rng, 5)), (12, prose(rng, 9)), (13, prose(rng, 12))]
    docs = [(k, prose(rng, 60)) for k in range(20)]
    for k in range(20, 90):
        words = rng.choice(items)[1] or ""
        words = words.split()
        for _ in range(rng.randrange(4)):
            if words:
                words[rng.randrange(len(words))] = "changed"
        lo = rng.choice((0, 0, 3))
        docs.append((k, f"{prose(rng, 20)}\n{', '.join(words[lo:]).upper()}! {prose(rng, rng.choice((0, 20)))}"))
    docs += [(110, "yes, and in 1492 too"), (111, "a\n> YES\nb"), (112, "x\r\nIn 1492."), (113, "昔、春の朝に川辺を歩くと黒い鳥が三羽静かに飛んだという。"), (114, "春の朝"), (None, "clean"), (None, "other " + items[0][1])]
    docs += [(100, None), (101, ""), (None, items[0][1]), (0, items[0][1]), (0, items[0][1]), (102, prose(rng, 20_000) + " " + items[1][1])]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, item_id string")
    bench = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, h int")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(table.drop("item_id"), bench).collect()}
    assert got == plain_leaks(docs, items)
    bad = {t for d, t in docs if plain_leaks([(d, t)], items)}
    assert sorted((str(r.doc_id), r.text) for r in decontam.clean(table, bench).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == sorted((str(d), t or "") for d, t in docs if t not in bad)
    assert decontam.clean(table, bench).columns == table.columns
    assert decontam.leaks(table.drop("item_id").where("false"), bench).count() == 0
    assert decontam.leaks(table.drop("item_id"), bench.where("false")).count() == 0


def test_leaks_by_shuffle(spark, monkeypatch):
    """The same result when nothing may be broadcast."""
    from kotomill.llm import common

    monkeypatch.setattr(decontam, "small_side", lambda cut: common.small_side(cut, -1))
    rng = random.Random(6)
    items = [(k, prose(rng, 20)) for k in range(3)]
    docs = [(k, prose(rng, 20) + " " + items[k % 3][1]) for k in range(9)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k % 3) for k in range(9)}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 12), max_size=2), st.sets(st.integers(0, 19), max_size=4))
def test_masks_survive_substitutions(two, four):
    for n, lost in ((13, two), (20, four)):
        assert any(all(p + o not in lost for o in mask) for mask in decontam.MASKS for p in range(n - mask[-1]))


@pytest.mark.parametrize("n", range(5, 13))
def test_short_seeds_survive_substitutions(n):
    """Whichever tokens of a short item are substituted, as many as are allowed, one seed has none of them and two fifths of the item."""
    found = [{place + o for o in shape} for place, shape in decontam.short_seeds(n)]
    assert all(0 <= min(f) and max(f) < n and 5 * len(f) >= 2 * n for f in found)
    for lost in itertools.combinations(range(n), n - -(-8 * n // 10)):
        assert any(not f & set(lost) for f in found)


# --- quotations -----------------------------------------------------------------------------------

TALK = [
    (1, 0, "user", "Where is the station?\nI am lost."),
    (1, 1, "assistant", "Ann wrote:\n> Where is the station?\n\nBehind the market."),
    (1, 2, "user", "What time is it?"),
    (1, 3, "assistant", "> > Where is  the STATION\n> Behind the market.\n\nThanks, found it."),
    (1, 4, "assistant", ">What time is it?\nNoon."),
    (1, 5, "user", "> never said\nHello > world"),
    (1, 5, "user", "> never said\nHello > world"),
    (2, 0, None, "> only a quote"),
    (2, 1, "user", None),
    (2, None, "user", "late"),
    (None, 0, "user", "> x\ny"),
    (3, 0, "user", "> Behind the market.\nOther room."),
]


def test_quotes(spark):
    rows = spark.createDataFrame([(*r, 7) for r in TALK], "conv_id long, turn long, role string, text string, parent int")
    got = {(r.conv_id, r.turn): r for r in quotes.linked(rows).collect()}
    one = {t: (r.parent, r.root, r.depth, r.pos) for (c, t), r in got.items() if c == 1}
    assert one == {0: (None, 0, 0, 0), 1: (0, 0, 1, 1), 3: (1, 0, 2, 2), 2: (None, 2, 0, 3), 4: (2, 2, 1, 4), 5: (None, 5, 0, 5)}
    assert got[1, 1].text == "Behind the market." and got[1, 3].text == "Thanks, found it." and got[1, 5].text == "Hello > world"
    assert got[1, 5].n_rows == 2 and got[2, 0].text == "" and got[2, 0].role == "unknown" and got[2, None].pos == 2 and got[3, 0].parent is None
    chats = {(r.conv_id, r.part): r for r in quotes.conversations(rows).collect()}
    assert chats[1, 0].turns == [0, 1, 3, 2, 4, 5] and chats[1, 0].n_links == 3 and ">" not in chats[1, 0].chat.replace("|>", "").replace("Hello > world", "")
    assert quotes.conversations(rows.where("false")).count() == 0


def plain_links(messages):
    """{(conv, turn): parent} by the definition, message by message."""
    norm = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()

    def passages(text):
        out = []
        for line in re.split("\r\n|\n|\r", text or ""):
            mark = re.match(r"[ \t]*(?:>[ \t]?)+", line)
            level = mark[0].count(">") if mark else 0
            if not out or out[-1][0] != level:
                out.append((level, []))
            out[-1][1].append(line[mark.end() :] if mark else line)
        return out

    def units(lines):
        block = "\n".join(lines)
        paragraphs = re.split(r"\n[^\S\n]*\n\s*", block)
        sentences = [s for p in paragraphs for s in re.split(r"(?<=[.!?。！？])\s+", p)]
        return {norm(x) for x in [block, *paragraphs, *lines]} - {""} | {n for n in map(norm, sentences) if len(n.split()) >= 4}

    out = {}
    for conv, turn, _, text in messages:
        found = []
        for level, lines in passages(text):
            for unit in units(lines) if level else ():
                origin = min((t for c, t, _, x in messages if c == conv and any(not lv and unit in units(own) for lv, own in passages(x))), default=None)
                if origin is not None and origin < turn:
                    found.append((-level, len(unit.split()), origin))
        if found:
            out[conv, turn] = max(found)[2]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_against_definition(spark, seed):
    """Whole and partial quotes, wrapped anew, nested, edited and of nobody, in several conversations."""
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 9))).capitalize() + rng.choice(".!?")
    messages, kept = [], {}
    for conv in range(4):
        for turn in range(12):
            own = [" ".join(sentence() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))]
            lines, earlier = [], kept.setdefault(conv, [])
            for _ in range(rng.randrange(3) if earlier else 0):
                part = rng.choice(earlier)
                words = rng.choice([" ".join(part), rng.choice(part), rng.choice(re.split(r"(?<=[.!?])\s+", part[0])), sentence()]).split()
                width = rng.choice((3, 100))
                mark = "> " * rng.randint(1, 2)
                lines += ["Ann wrote:"] + [mark + " ".join(words[k : k + width]) for k in range(0, len(words), width)] + [""]
            earlier.append(own)
            messages.append((conv, turn, "user", "\n".join(lines) + "\n\n".join(own)))
    rows = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.parent for r in quotes.linked(rows).collect() if r.parent is not None}
    assert got == plain_links(messages) and len(got) > 8


def test_rewrapped_quote(spark):
    rows = [(1, 0, "user", "The ferry leaves the old\nharbour at nine every\nmorning. Bring a coat.\n\nTickets are sold on board."), (1, 1, "user", "unrelated"), (1, 2, "user", "> The ferry leaves the old harbour at nine\n> every morning.\n\nAt nine? Fine.")]
    got = {r.turn: r.parent for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 0}


@pytest.mark.parametrize("lines", [1_000, 60_000])
def test_time_follows_the_lines(spark, lines):
    """A message of many lines and levels is parsed in time proportional to its length."""
    text = "\n".join("> " * (k % 3) + f"line {k} of many" for k in range(lines))
    began = time.perf_counter()
    row = quotes.parsed(spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")).select(F.size("own").alias("own"), F.size("cited").alias("cited")).first()
    assert row.own >= lines // 3 and row.cited > lines // 2 and time.perf_counter() - began < 30


def test_long_threads_and_parts(spark, monkeypatch):
    """A conversation cut into parts and ranges keeps its order; a chain of replies ends at its root."""
    monkeypatch.setattr(quotes, "PART", 16)
    rows = [(9, t, "user", (f"> line number {t - 1}\n" if t else "") + f"line number {t}") for t in range(70)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = sorted((r.pos, r.turn, r.parent, r.root, r.depth) for r in quotes.linked(talk).collect())
    assert got == [(t, t, t - 1 if t else None, 0, t) for t in range(70)]
    parts = sorted(quotes.conversations(talk).collect(), key=lambda r: r.part)
    assert [n for r in parts for n in r.turns] == list(range(70)) and max(r.n_messages for r in parts) == 16


def test_very_long_message(spark):
    text = "\n".join("> " * (k % 3) + f"line {k}" for k in range(3000))
    row = quotes.linked(spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")).first()
    assert row.text == "\n".join(f"line {k}" for k in range(0, 3000, 3))


# --- exact search ---------------------------------------------------------------------------------


def plain_topk(rows):
    clean = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(clean):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(clean) if m != n and len(w) == len(v))
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rng.normal(size=8)]) for k in range(600)]
    rows[5:40] = [(k, rows[5][1]) for k in range(5, 40)]  # a common vector
    rows += [(1000, [1.0] * 8), (1001, None), (1002, [None] * 8), (1100, [float("nan")] * 8), (1200, [float("inf")] * 8), (None, [1.0] * 8), (100, [0.0] * 8), (1300, [1.0, 2.0]), (1301, [2.0, 1.0]), (1400, []), (1500, [1e4] * 8)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, id int")
    assert sorted(map(tuple, topk.nearest(table).collect())) == plain_topk(rows)
    assert topk.nearest(table.where("false")).count() == 0
    assert topk.nearest(table.where("vec_id = 0")).count() == 0


def test_topk_of_repeated_ids(spark):
    """Every row is a candidate: of two rows with one id both can be found, and each is a query of its own."""
    rng = np.random.default_rng(4)
    rows = [(7, [9.0, 0.0]), (7, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [2.0, 0.0]), (100, [2.0, 0.0])] + [(int(k), [float(x) for x in rng.normal(size=2)]) for k in range(8, 30)]
    got = sorted(map(tuple, topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == plain_topk(rows) and [r[2] for r in got if r[1] == 1] == [7, 7, 7] and sum(r[2] == 7 for r in got) == 6


@pytest.mark.parametrize("wide", [False, True])
def test_topk_in_cells_and_blocks(spark, monkeypatch, wide):
    """Clusters, a vector that a third of the rows share, small cells and blocks; nothing broadcast."""
    from kotomill.llm import common

    monkeypatch.setattr(topk, "CANDIDATES", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    if wide:
        monkeypatch.setattr(topk, "small_side", lambda cut: common.small_side(cut, -1))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5)) * 20
    rows = [(int(k), [float(x) for x in centres[k % 6] + rng.normal(size=5)]) for k in range(900)] + [(1000 + k, [1.0] * 5) for k in range(450)]
    assert sorted(map(tuple, topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())) == plain_topk(rows)


def test_bounds_stop_early():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(-5, 5, (2000, 8)), rng.integers(90, 110, (30, 8))]).astype(np.int64)
    p = topk.pivots(rows[:500].astype(float))
    far = topk.distances(rows, p)
    ids = np.arange(len(rows))
    scores = rows @ rows[-1]
    scores[-1] = -(10**9)
    for floor in (-np.inf, float(np.sort(scores)[-10])):
        found, evaluated = topk.best(rows[-1:], ids[-1:], far[-1:], np.array([floor]), rows, ids, ids, far)
        assert [i for _, i, _ in found] == list(np.lexsort((ids, -scores))[:10]) and evaluated < 200


def test_small_links_are_dealt_out_few_times(spark, monkeypatch):
    """Links of stars settle in one iteration, which shuffles for the minima and the distinct links only."""
    plans = []
    monkeypatch.setattr(components, "Cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or Cut(df, name))
    links = spark.createDataFrame([(60 + k % 2, 10 + k) for k in range(40)], "a long, b long")
    assert {r.node: r.root for r in components.components(links, "a", "b").collect()} == {k: 10 + k % 2 for k in [*range(10, 50), 60, 61]}
    assert sum(p.count("Exchange hashpartitioning") for p in plans) == 5


def test_written_tables_leave_no_listing(spark):
    """Reading a written table keeps nothing in the session's cache of listings, which would fill the driver's heap."""
    spark.read.parquet(Cut(spark.range(9), "listed").path)  # now there is a cache
    held = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.datasources.FileStatusCache$").getDeclaredField("sharedCache")
    held.setAccessible(True)
    shared = held.get(None)
    inner = next(f for f in shared.getClass().getDeclaredFields() if f.getName().endswith("cache"))
    inner.setAccessible(True)
    cut = Cut(spark.range(9), "listed")
    before = inner.get(shared).asMap().size()
    assert [cut.df.count() for _ in range(3)] == [9, 9, 9]
    assert inner.get(shared).asMap().size() == before
