"""HTML, quality, mixing and the pipeline: exact cases, held-out accuracy, brute force, edge cases."""

import random
import re
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from kotomill.llm import decontam, html, mixing, pii, quality
from tests.llm.test_neardup import plain_roots

# --- HTML -----------------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>T &amp; x</h1><p>One<br>two &nbsp; three<p>Four <b>bold</b>ish</article><footer>f</footer>", "T & x\nOne two three\nFour boldish"),
    ("<header><h1>Site</h1></header><div class='cookie-notice'>We use</div><main><article class='post'><header><h1>Title</h1></header><p>Text</p><div class=ad>Buy</div><section id=comments><article class=comment><p>first!</p></article></section></article><aside>side</aside></main>", "Title\nText"),
    ("<div id='main-content'><p>Body</p></div><div class='sidebar'>S</div>", "Body"),
    ("<p>a<script>if(a<b){'</p>'}</script>b</p><style>p{}</style><form><p>name</p></form>", "ab"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\nb\n1\n2"),
    ("a < b & c &lt;p&gt;", "a < b & c <p>"),
    ("<article><p>x</p><!-- c --><p hidden>h</p><p style='display:none'>n</p></article>", "x"),
    ("<div role=main><p>r</p></div><p>out</p>", "r"),
    ("<div class=x><a href=/>Home</a> <a href=/b>News</a></div><p>See <a href=/c>this</a>.</p>", "See this."),
    ("<article><p><a href=/>linked</a></p></article>", "linked"),
    ("<div class='layout with-sidebar'><p>Body</p></div>", "Body"),
    ("<div class='search-results-page'><p>Body</p></div>", "Body"),
    ("<article><p>a</p><section class='market-share'><p>m</p></section><div class='alert-box'>warn</div></article>", "a\nm\nwarn"),
    ("<p>x <math><mi>y</mi></math> z</p>", "x y z"),
    ("<div><p>A body that is much longer than any teaser beside it could be.</p></div><article><p>teaser</p></article>", "A body that is much longer than any teaser beside it could be.\nteaser"),
    ("<main><h1>Title</h1><p>Lead</p><article><p>Text</p></article></main>", "Title\nLead\nText"),
    ("<p>Press <button>OK</button> now</p><div><button>Send</button></div>", "Press OK now"),
    ("<form id=aspnetForm><div><p>All content</p></div></form>", "All content"),
    ("<div>" * 100 + "<p>deep</p>" + "</div>" * 100 + "<p>shallow</p>", "deep\nshallow"),
    ("", ""),
    ("<!-- unclosed", ""),
    ("plain", "plain"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html.main_text(html.parsed(page)) == text


ARTICLE = "<h1>Title</h1><p>A first paragraph that is not short.</p><ul><li>one</li><li>two</li></ul><p>And a last one.</p>"
TEXT = "Title\nA first paragraph that is not short.\none\ntwo\nAnd a last one."
#: Names that slugs of headings, layouts and subjects give to parts of an article.
INNOCENT = [
    '<h2 id="related-work">{}</h2>', '<h2 id="comments">{}</h2>', '<p id="ad-hoc">{}</p>', '<section id="navigation-at-sea"><p>{}</p></section>', '<section id="comments"><p>{}</p></section>',
    '<div class="profit-share">{}</div>', '<p class="notice-period">{}</p>', '<div class="login-flow">{}</div>', '<table><tr><td class="share">{}</td></tr></table>', '<p class="footer">{}</p>', '<p><span class="comment">{}</span></p>',
    '<div class="menu">{}</div>', '<div class="ad-hoc-network">{}</div>', '<div class="market-share-related">{}</div>', '<h3 class="comments">{}</h3>', '<p>{}</p>',
]


@pytest.mark.parametrize("part", INNOCENT)
def test_parts_of_an_article_stay_whatever_they_are_called(part):
    page = f"<html><body><nav>menu</nav><article>{ARTICLE}{part.format('Words of this part.')}</article><footer>f</footer>"
    assert html.main_text(html.parsed(page)) == f"{TEXT}\nWords of this part."


@pytest.mark.parametrize("part", ['<ol class="commentlist"><li>first!</ol>', '<div class="feedback">first!</div>', '<div class="comment-list">first!</div>', '<div class="ad">buy</div>', '<div class="top-ad-slot">buy</div>', '<p class="advert">buy</p>', '<div class="cookieNotice">we use</div>', '<div class="post-comments"><article class="comment">x</article></div>', '<div role="navigation">x</div>', '<section class="related-posts">more</section>', '<aside>x</aside>', '<form><p>name</p></form>'])
def test_parts_that_are_no_content_go(part):
    assert html.main_text(html.parsed(f"<html><body>{part}<article>{ARTICLE}{part}</article>{part}")) == TEXT


@pytest.mark.parametrize("seed", range(20))
def test_any_names_around_an_article_lose_nothing(seed):
    """Frames with random classes and ids of the vocabulary and others, around an article or a plain body."""
    rng = random.Random(seed)
    words = sorted(html.NOISE_WORDS | html.WEAK_WORDS | html.COMMENT_WORDS | html.PLACE_WORDS) + ["with", "layout", "right", "x", "story"]
    name = lambda: rng.choice("-_").join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    for _ in range(50):
        page = ARTICLE if rng.random() < 0.5 else f"<article>{ARTICLE}</article>"
        for _ in range(rng.randrange(1, 4)):
            page = f"<div class='{name()} {name()}' id='{name()}'>{page}</div>"
        assert html.main_text(html.parsed(f"<html><body class='{name()}' id='{name()}'><nav>n</nav>{page}<div class='sidebar'><p>s.</p></div>")) == TEXT


def test_an_advert_longer_than_its_article():
    assert html.main_text(html.parsed(f"<body><div class=ad>{'buy ' * 50}</div><article><h1>T</h1></article><ol class=comments>{'<li>no!' * 99}</ol>")) == "T"


def test_a_frame_with_a_short_neighbour():
    page = f'<body><div class="container sidebar-right"><div class="post">{ARTICLE}</div></div><div><p>Short.</p></div>'
    assert html.main_text(html.parsed(page)) == f"{TEXT}\nShort."


@pytest.mark.parametrize("page", ["<p>" * 50_000, "<div>" * 20_000 + "x", "<b>" * 20_000 + "</p>" * 20_000, "<" * 100_000, '<a ="' * 20_000, "<p>" + "x " * 500_000, "<script>" * 20_000, "<table><tr><td>" * 5_000])
def test_long_pages(page):
    page = html.parsed(page)
    page.names(), page.digests(), html.main_text(page)


def test_style_tree_removes_what_a_host_repeats(spark):
    """A box without a telling name that every page of the host repeats goes; articles that share a passage keep it."""
    rows = []
    for k in range(12):
        shared = "<p>A passage that every article holds.</p>" if k % 2 else ""
        rows.append((k, f"https://Host.example/{k}", f"<body><div class=box><p>Call us today</p></div><div class=story{k % 2}><p>Article number {k} says {k * k}</p>{shared}</div></body>"))
    rows += [(100, None, None), (101, "no url", "<p>alone</p>"), (102, "https://other.example/", ""), (0, "https://host.example/0", "<body><div class=box><p>Call us today</p></div></body>")]
    rows += [(200 + k, "https://copies.example/", "<article><p>the same page</p></article>") for k in range(10)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = html.extract(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert text[2] == "Article number 2 says 4" and text[3] == "Article number 3 says 9\nA passage that every article holds."
    assert text[100] == "" and text[101] == "alone" and text[102] == "" and text[205] == "the same page"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(pages.where("false")).count() == 0


def site(n, names=("top", "mid", "low"), seed=0, deep=0):
    """Pages of one host: blocks that all repeat, one that half of them repeat, and text of their own, under class names that say nothing."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        own = "".join(f"<p>{' '.join(str(rng.random()) for _ in range(rng.randint(1, 9)))}</p>" for _ in range(rng.randint(1, 4)))
        half = "<p>Half of the pages say this.</p>" if k % 2 else ""
        wrap, close = "<div>" * deep, "</div>" * deep
        out.append(f"<body><div class={names[0]}><ul><li>Start</li><li>Offers</li></ul></div>{wrap}<div class={names[1]}><h2>Page {k}</h2>{own}{half}</div>{close}<div class={names[2]}><p>All rights</p><p>Page of {n}</p></div></body>")
    return out


def plain_low(pages):
    """{(style path, text below)} of the branches under the threshold, by definition."""
    trees = []
    for source in pages:
        page, found = html.parsed(source), {}
        path = [""]
        for parent, label in zip(page.parent[1:], page.label[1:], strict=True):
            path.append(f"{path[parent]}>{label}")
        below = [[] for _ in path]
        for k in range(len(path) - 1, -1, -1):
            for x in page.items[k]:
                below[k].append(below[x] if isinstance(x, int) else x)
        for k in range(1, len(path)):
            style = tuple(page.label[x] if isinstance(x, int) else "" for x in page.items[k])
            texts, styles = found.setdefault(path[k], (set(), set()))
            styles.add(style)
            if "'" in str(below[k]):
                texts.add(re.sub(r"\[\](, )?", "", str(below[k])))
        trees.append(found)
    low = set()
    for p in {p for t in trees for p in t}:
        held = [t[p] for t in trees if p in t]
        m = len(held)
        if m < html.LEAST_PAGES:
            continue
        styles = Counter(s for _, ss in held for s in ss)
        total = sum(styles.values())
        presentation = min(1, max(0, -sum(n / total * log(n / total) for n in styles.values()) / log(m)))
        branches = Counter(x for xs, _ in held for x in xs)
        if not branches:
            continue
        content = {x: 1 - log(n) / log(m) for x, n in branches.items()}
        mean = sum(content[x] * n for x, n in branches.items()) / sum(branches.values())
        if (1 - html.GAMMA) * presentation + html.GAMMA * mean < html.THRESHOLD:
            low |= {(p, x, n) for x, n in branches.items() if html.GAMMA * content[x] < html.THRESHOLD}
    return low


@pytest.mark.parametrize(("n", "deep"), [(30, 0), (9, 0), (7, 0), (20, 80)])
def test_tree_decides_without_names(spark, n, deep):
    """Menus and footers with neutral names go where the host has pages enough for statistics, at any depth; what half of the pages say stays."""
    sources = site(n, deep=deep)
    pages = spark.createDataFrame([(k, "http://h.example/x", s) for k, s in enumerate(sources)], "page_id long, url string, html string")
    low = html.style_tree(pages).collect()
    assert sorted(r.held for r in low) == sorted(x[-1] for x in plain_low(sources))
    text = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert bool(low) == (n >= html.LEAST_PAGES)
    for k, source in enumerate(sources):
        own = re.findall(r"<(?:p|h2)>(.*?)</(?:p|h2)>", source.split("class=mid")[1].split("</div>")[0])
        rest = [] if low else ["All rights", f"Page of {n}"]
        assert text[k] == "\n".join([*([] if low else ["Start", "Offers"]), *own, *rest])


# --- quality --------------------------------------------------------------------------------------


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["river", "stone", "under", "light", "the", "of", "and", "with", "house", "morning"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 80))) + "."
        bad = k % 4 == 0
        if bad:
            text = " ".join(f"{w.upper()}!!$$" for w in text.split())
        rows.append((k, text, "en", f"src{k % 3}", len(text), int(not bad)))
    return rows


def test_quality_held_out(spark):
    rows = corpus(800)
    docs = spark.createDataFrame([r[:5] + (1,) for r in rows] + [(5000, None, None, None, None, 1), (5001, "", "en", "src0", 0, 1), (None, "the river", "en", "s", 9, 1)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    labels = [(k, q, 0) for k, *_, q in rows if k % 2] + [(k, q, 0) for k, *_, q in rows if k % 8 == 0] + [(1, None, 0), (3, 1, 0), (9999, 0, 0)]
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.s.score >= model.cut for r in docs.select("doc_id", quality.scores(model).alias("s")).collect()}
    held = [(got[k], bool(q)) for k, *_, q in rows if k % 2 == 0 and k % 8]
    assert np.mean([a == b for a, b in held]) > 0.97 and 5000 in got and None in got
    kept = quality.keep(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns


def test_quality_held_out_on_tables():
    """Fitted on every second labelled document of a real table, judged on the others: junk found, good kept, scores calibrated."""
    import pandas as pd

    folder = "/root/testdata/sf0.1"
    docs, labels = pd.read_parquet(f"{folder}/documents.parquet"), pd.read_parquet(f"{folder}/labels.parquet")
    rows = docs.merge(labels[["doc_id", "quality"]], on="doc_id", how="left")
    known = rows[rows.quality.notna()].reset_index(drop=True)
    fitted, held = known[known.index % 2 == 0], known[known.index % 2 == 1].reset_index(drop=True)
    pool = rows[rows.quality.isna()].head(1000)
    views = lambda x: quality._views(*(x[c].reset_index(drop=True) for c in quality.COLUMNS))
    taught = pd.concat([fitted, pool])
    model = quality.cotrain(*views(taught), np.concatenate([fitted.quality.to_numpy().astype(int), -np.ones(len(pool), int)]))
    good, score = held.quality.to_numpy().astype(int), model.score(*views(held))[2]
    kept = score >= model.cut
    assert (~kept & (good == 0)).sum() >= 0.95 * (good == 0).sum() and (~kept & (good == 1)).sum() <= 0.005 * (good == 1).sum()
    bins = np.minimum((score * 10).astype(int), 9)
    assert sum((bins == b).mean() * abs(score[bins == b].mean() - good[bins == b].mean()) for b in set(bins.tolist())) < 0.02


def two_views(n, seed=0):
    """Labels, a clear view and a noisy wide one of the same objects."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    clear = ((2 * y - 1)[:, None] * 3 + rng.normal(size=(n, 2))).astype(np.float32)
    noisy = ((2 * y - 1)[:, None] * 0.08 + rng.normal(size=(n, 200))).astype(np.float32)
    return y, noisy, clear


def test_exchange_teaches_the_weaker_view(monkeypatch):
    y, noisy, clear = two_views(6000)
    label = np.where(np.arange(6000) < 320, y, -1)
    label[3000:] = -2  # judged on these, which no round may see
    rows = label > -2
    right = {}
    for rounds in (0, 4):
        monkeypatch.setattr(quality, "ROUNDS", rounds)
        model = quality.cotrain(noisy[rows], clear[rows], label[rows])
        right[rounds] = ((model.score(noisy[~rows], clear[~rows])[0] >= 0.5) == y[~rows]).mean()
    assert right[4] > right[0] + 0.03


def test_a_view_without_proof_teaches_nothing(monkeypatch):
    """A view that cannot tell the classes apart leaves the other as it was."""
    y, _, clear = two_views(2000, 1)
    blind = np.random.default_rng(2).normal(size=(2000, 20)).astype(np.float32)
    label = np.where(np.arange(2000) < 400, y, -1)
    found = {}
    for rounds in (0, 4):
        monkeypatch.setattr(quality, "ROUNDS", rounds)
        found[rounds] = quality.cotrain(clear, blind, label).weights[0]
    assert (found[0] == found[4]).all()


def test_quality_of_repeated_ids(spark):
    """Rows that share an id: the same one is fitted whatever the partitions, and every row is judged."""
    rows = [r[:5] for r in corpus(200)] + [(k, "other words " * k, "en", "s", k) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    one, two = (quality.fit(docs.repartition(n), labels) for n in (1, 5))
    assert all((a == b).all() for a, b in zip(one.weights, two.weights, strict=True)) and one.cut == two.cut
    assert docs.select(quality.scores(one)).count() == 400


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([r[:5] for r in corpus(20)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep(docs, labels).count() == 20 and quality.keep(docs, labels.where("false")).count() == 20
    assert quality.keep(docs.where("false"), labels).count() == 0


def test_quality_labels_without_documents(spark, monkeypatch):
    """Labels of documents that are gone take no place among those that are fitted."""
    monkeypatch.setattr(quality, "MOST_LABELLED", 50)
    monkeypatch.setattr(quality, "MOST_POOL", 60)
    docs = spark.createDataFrame([r[:5] for r in corpus(200)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 200, 2)] + [(k, 1, 0) for k in range(1000, 9000)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "cotrain", lambda text, meta, label: seen.extend(label.tolist()) or quality.constant(1.0))
    quality.fit(docs, labels)
    assert sum(y >= 0 for y in seen) > 50 and sum(y >= 0 for y in seen) + sum(y < 0 for y in seen) == 110


# --- mixing ---------------------------------------------------------------------------------------


def plain_targets(sizes):
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    fixed = {}
    while True:
        open_ = [k for k in range(len(sizes)) if k not in fixed]
        rest = sum(sizes) - sum(fixed.values())
        share = {k: rest * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = {k: 3 * sizes[k] for k in open_ if share[k] > 3 * sizes[k]}
        if not over:
            return [fixed.get(k, share.get(k)) for k in range(len(sizes))]
        fixed |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 500, 20, 3], [0, 0], [0, 9], [7], [5, 4, 3, 2, 1, 1000]])
def test_targets(sizes):
    assert mixing.targets(sizes) == pytest.approx(plain_targets(sizes))
    assert sum(mixing.targets(sizes)) == pytest.approx(sum(sizes))


def test_splitting_tree():
    quotas = [100, 3, 0, 57]
    cells = dict(mixing.split(quotas, 7))
    every = np.stack(list(cells.values()))
    assert sorted(cells) == list(range(7)) and every.sum(0).tolist() == quotas and (every >= 0).all() and every.sum(1).max() - every.sum(1).min() <= 7
    assert all((cells[k] == q).all() for k, q in mixing.split(quotas, 7))
    assert list(mixing.split([0, 0], 7)) == [] and sum(q.sum() for _, q in mixing.split([3], 1000)) == 3


def mix_rows():
    rng = random.Random(4)
    rows = [(k, "x " * rng.randint(1, 60), rng.choice(["b", "a", "a", "a", "a", None, "é"])) for k in range(500)]
    return [*rows, (600, None, "a"), (601, "", "b"), (602, " \t\n", None), (603, "w", "empty"), (604, "", "zero"), (None, "y y", "a"), (7, rows[7][1], rows[7][2])]


def test_mix(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, block int")
    def planned(docs, **more):
        rows = mixing.numbered(docs)
        return mixing.Mix(rows, **more).plan(rows.df).collect()

    got = planned(docs)
    assert len(got) == len(rows)
    per = {}
    for r in got:
        n, taken, target, full = per.get(r.source, (0, 0, 0, 0))
        per[r.source] = (n + r["size"], taken + len(r.units) * r["size"], r.target, r.source_size)
        assert len(r.units) <= 3 and len({u.copy for u in r.units}) == len(r.units)
    order = sorted((s for s in per if s is not None)) + [None]
    assert [per[s][2] for s in order] == pytest.approx(plain_targets([per[s][0] for s in order]))
    for n, taken, target, full in per.values():
        assert n == full and abs(taken - target) <= 31
    again = sorted(((r.id, r["size"], tuple(map(tuple, r.units))) for r in planned(docs.repartition(7))), key=str)
    assert again == sorted(((r.id, r["size"], tuple(map(tuple, r.units))) for r in got), key=str)
    assert planned(docs.where("false")) == []


@pytest.mark.parametrize(("blocks", "fill", "groups"), [(4, 16, 3), (3, 5, 1000)])
def test_mix_at_scale(spark, monkeypatch, blocks, fill, groups):
    """Few and large blocks as a huge table has them: borders are cut again and again, shards dealt within groups; targets are met all the same."""
    monkeypatch.setattr(mixing, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    monkeypatch.setattr(mixing, "FILL", fill)
    monkeypatch.setattr(mixing, "BORDER", 1)
    monkeypatch.setattr(mixing, "GROUPS", groups)
    rng = random.Random(9)
    rows = [(k, "x " * rng.randint(1, 40), rng.choice("aaaaabbc")) for k in range(3000)] + [(None, "y y y", "a")] * (400 if groups > 3 else 0)  # equal rows share a block
    cut = mixing.numbered(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.Mix(cut, shards=40).plan(cut.df).collect()
    assert len(got) == len(rows)
    shards = Counter()
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(len(r.units) * r["size"] for r in own) - own[0].target) <= 20
        shards.update(u.shard for r in own for u in r.units)
    assert all(len({u.copy for u in r.units}) == len(r.units) <= 3 and all(0 <= u.shard < 40 for u in r.units) for r in got)
    if groups == 3:
        assert len(shards) == 40 and max(shards.values()) < 5 * min(shards.values())  # a unit is a quarter of its source here


def test_mixed_rows(spark):
    docs = spark.createDataFrame([(*r, 1) for r in mix_rows()], "doc_id long, text string, source string, h int")
    cut = mixing.numbered(docs)
    plan = mixing.Mix(cut).plan(cut.df).collect()
    got = mixing.mixed(docs).collect()
    assert sorted((str(r.doc_id), r.mix_copy, r.mix_shard) for r in got) == sorted((str(r.id), u.copy, u.shard) for r in plan for u in r.units)
    assert got[0].h == 1 and mixing.mixed(docs.where("false")).count() == 0


# --- the pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    """Each stage against its own definition, on what the one before it kept."""
    folder = "/root/testdata/sf0.001"
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.cache()
        docs = stage(spark, before, folder).cache()
        held[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before, after = (df.select("doc_id").toPandas().doc_id for df in held["quality"])
    assert len(set(before) - set(after)) > 0
    gone = [labels[d] for d in set(before) - set(after) if d in labels]
    assert sum(gone) <= 0.1 * len(labels)
    model = quality.fit(held["quality"][0], spark.read.parquet(f"{folder}/labels.parquet"))
    rows = held["quality"][0].toPandas()
    scores = model.score(*quality._views(*(rows[c] for c in quality.COLUMNS)))[2]
    assert set(after) == set(rows.doc_id[scores >= model.cut])
    before, after = held["near_duplicates"]
    rows = before.orderBy("doc_id").collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({rows[k].doc_id for k in plain_roots([r.text for r in rows])})
    before, after = held["decontamination"]
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    leaked = {r.doc_id for r in decontam.leaks(before, bench).collect()}
    assert set(after.toPandas().doc_id) == set(before.toPandas().doc_id) - leaked
    before, after = held["personal_data"]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.text == pii.masked(texts[r.doc_id]) and r.n_chars == len(r.text)
        assert not [x for x in pii.scan(r.text) if x[0] in pii.BASE]
    before, after = held["mixing"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    assert after.where(F.col("mix_copy").isNull() | F.col("mix_shard").isNull()).count() == 0


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, repeated ids and rows, very long and empty texts, further columns with clashing names, and empty tables."""
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").limit(60)
    bench = spark.read.parquet(f"{source}/benchmark.parquet")
    leaked = bench.where("item_id is not null").first().text
    long = " ".join(f"w{k}" for k in range(40_000))
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (1, None, None, "src0", None), (1, "An unlike text under a known id.", "en", "src0", 33), (7001, long, "en", "src1", len(long)), (7002, long + " end", "en", "src1", len(long) + 4), (None, f"so {leaked} then", "en", "src1", 9), (7003, "x", "xx", "一", 1)]
    more = spark.createDataFrame(odd + odd[2:4], docs.schema)
    clash = {"size": F.lit(1), "row": F.lit("r"), "node": F.lit(2), "at": F.lit(3), "h": F.lit("h"), "block": F.lit(4), "th": F.lit(5), "k": F.lit(6), "units": F.lit(None).cast("string")}
    every = docs.unionByName(more).withColumns(clash)
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(str(tmp_path / "full/labels.parquet"))
    bench.write.parquet(str(tmp_path / "full/benchmark.parquet"))
    every.write.parquet(str(tmp_path / "full/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "full"))
    assert got.columns == [*every.columns, "mix_copy", "mix_shard"]
    texts = [r.text for r in got.collect()]
    assert "An unlike text under a known id." in texts and not any(t and leaked in t for t in texts) and not {long, long + " end"} <= set(texts)
    for name, rows in (("labels", spark.read.parquet(f"{source}/labels.parquet").limit(0)), ("benchmark", bench.limit(0)), ("documents", every.limit(0))):
        rows.write.parquet(str(tmp_path / f"none/{name}.parquet"))
    nothing = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert nothing.columns == got.columns and nothing.count() == 0


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
