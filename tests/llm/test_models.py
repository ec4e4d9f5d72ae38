"""Operators with trained or randomised parts: held-out accuracy, recall, brute force on small tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa

from .conftest import SCHEMA, rows, sentence


def test_language_model(spark, wide, empty):
    from tarnhelm.llm import lm

    got = lm.score(wide, lm.held_out("doc_id")).collect()
    assert len(got) == len(rows())
    words = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(r[0], words.findall((r[1] or "").translate(low)) + [None]) for r in rows()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in tokens if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    expected = Counter((d, held(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for d, t in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert lm.score(empty, lm.held_out("doc_id")).count() == 0


def test_automaton_is_a_distribution_and_equals_a_plain_walk():
    from tarnhelm.llm import lm

    rng = random.Random(2)
    hashes = {100: 50, 200: 30, 300: 20}  # three state words; the corpus has 120 tokens, 6 words
    pairs = {(2, 3): 20, (2, 2): 10, (3, 4): 9, (1, 2): 5}
    triples = {(2, 3, 4): 8, (2, 2, 3): 4}
    model = lm.Model(120, 6, hashes, 10, pairs, triples, 0.5)
    one = {0: 1 / 127, 2: 51 / 127, 3: 31 / 127, 4: 21 / 127}
    rest = 1 - one[2] - one[3] - one[4]  # the other words' mass

    def p(context, w):
        if context and (context + (w,)) in (triples if len(context) == 2 else pairs):
            gram = context + (w,)
            return ((triples[gram] - 0.5) / pairs[context]) if len(context) == 2 else (pairs[gram] - 0.5) / {1: 10, 2: 50, 3: 30, 4: 20}[context[0]]
        if not context:
            return one[w]
        table = triples if len(context) == 2 else pairs
        known = [g[-1] for g in table if g[:-1] == context]
        if not known:
            return p(context[1:], w)
        return (1 - sum(p(context, x) for x in known)) / (1 - sum(p(context[1:], x) for x in known)) * p(context[1:], w)

    for context in [(2,), (3,), (2, 3), (2, 2), (1,)]:
        other = p(context, 0) / one[0] * rest
        assert abs(sum(p(context, w) for w in (2, 3, 4)) + other - 1) < 1e-9
    texts = [[rng.choice([0, 2, 3, 4]) for _ in range(n)] for n in (1, 5, 700, 1300)]
    w = np.array([x for t in texts for x in t])
    bounds = np.cumsum([0, *map(len, texts)])
    base = np.log10(np.array([one[x] for x in w]))
    got = model.traverse(w, base, bounds)
    for t, a in zip(texts, bounds[:-1]):
        before = (1,)
        for i, x in enumerate(t):
            context = before[-2:]
            if len(context) == 2 and not any(g[:2] == context for g in triples):
                context = context[-1:]
            context = tuple(c for c in context) if 0 not in context else (context[-1:] if context[-1] != 0 else ())
            assert abs(10 ** got[a + i] - p(context, x)) < 1e-9, (i, context, x)
            before = (*before[-1:], x)


def test_arcs_by_place_equal_searched_arcs():
    from tarnhelm.llm import lm

    rng = random.Random(3)
    model = lm.Model(120, 6, {100: 50, 200: 30, 300: 20}, 10, {(2, 3): 20, (2, 2): 10, (3, 4): 9, (1, 2): 5}, {(2, 3, 4): 8, (2, 2, 3): 4}, 0.5)
    pair = {(2, 2): model.size, (2, 3): model.size + 1}  # the states of two words
    texts = [[rng.choice([2, 3, 4]) for _ in range(n)] for n in (1, 2, 255, 256, 257, 1300)]
    w = np.array([x for t in texts for x in t])
    before = [([1, 1, *t][i], [1, 1, *t][i + 1]) for t in texts for i in range(len(t))]
    near = model._arcs(np.array([b for _, b in before]), w)
    far = np.where([p in pair for p in before], model._arcs(np.array([pair.get(p, 0) for p in before]), w), -1)
    bounds, base = np.cumsum([0, *map(len, texts)]), np.log10(np.array([0, 0, 51, 31, 21])[w] / 127)
    searched = model.traverse(w, base, bounds)
    del model.keys  # nothing is searched now
    assert (near >= 0).any() and (far >= 0).any() and np.array_equal(model.traverse(w, base, bounds, near, far), searched)


@pytest.mark.parametrize("below", [50, 1 << 40, 1 << 62])
def test_numbered_equals_unique(below):
    from tarnhelm.llm import lm

    x = np.random.default_rng(4).integers(0, below, 3000)
    for x in (x, np.concatenate([x, x[::-1], [0, below - 1]]), x[:1], x[:0]):
        for got, want in zip(lm.numbered(x, below), np.unique(x, return_inverse=True), strict=True):
            assert np.array_equal(got, want)


def exact_classes(table):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    sets = [set(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := word.findall((t or "").lower())) else set() for _, t, *_ in table]
    label = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            same = table[i][1] is not None and table[i][1] == table[j][1]
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = []
    for i, r in enumerate(table):
        ids = [table[j][0] for j in range(len(table)) if label[j] == label[i] and table[j][0] is not None]
        out.append((r[0], min(ids) if ids and r[1] is not None else r[0]))
    return Counter(out)


def test_near_duplicates(spark, docs, wide, empty):
    from tarnhelm.llm import neardup as N

    assert Counter((r.doc_id, r.class_id) for r in N.classes(wide).collect()) == exact_classes(rows())
    kept = N.drop_near_duplicates(wide)
    assert kept.columns == wide.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(8) == 1 and ids.count(500) == 0 and 100 not in ids and 200 not in ids and 400 in ids
    assert N.classes(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    from tarnhelm.llm import neardup as N

    rng = random.Random(11)
    base = sentence(rng, 300).split()
    table = []
    for i in range(150):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(300)] = f"new{rng.randrange(10**6)}"
        table.append((i, " ".join(copy), "en", "s", 1))
    table += [(1000 + i, sentence(rng, 300), "en", "s", 1) for i in range(20)]
    got = Counter((r.doc_id, r.class_id) for r in N.classes(spark.createDataFrame(table, SCHEMA)).collect())
    assert got == Counter([(i, 0) for i in range(150)] + [(1000 + i, 1000 + i) for i in range(20)])


def test_signatures_estimate_probability_jaccard():
    from tarnhelm.llm import neardup as N

    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 63, 300).astype(np.uint64)
    a, b = h[:200], h[50:]
    wa, wb = rng.uniform(0.5, 3, 200), rng.uniform(0.5, 3, 250)
    m = 4000
    sig = N.signatures(np.repeat([0, 1], [200, 250]), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, m)
    x = dict(zip(a.tolist(), wa))
    y = dict(zip(b.tolist(), wb))
    exact = sum(1 / sum(max(x.get(j, 0) / x[d], y.get(j, 0) / y[d]) for j in x | y) for d in x if d in y)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04
    order_a, order_b = np.argsort(a), np.argsort(b)
    jaccard = 150 / 300
    assert abs(N.similarity((a[order_a], wa[order_a]), (b[order_b], wb[order_b])) - max(exact, jaccard)) < 1e-9


def test_toxicity_chain_on_held_out_documents(spark, empty):
    from tarnhelm.llm import toxicity as T

    rng = random.Random(4)
    bad = ["vile", "rotten", "scumbag", "filthy"]
    table, labels = [], []
    for i in range(500):
        words = sentence(rng, rng.randrange(20, 80)).split()
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        table.append((i, " ".join(words), "en", "s", 1))
        if i < 400:
            labels.append((i, int(i % 5 != 0), int(toxic)))
    labels += [(9999, 1, 1), (0, 1, 1), (3, None, 0)]
    table += [(600, None, "en", "s", 1), (601, "", "en", "s", 1)]
    docs, known = spark.createDataFrame(table, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = T.train(docs, known)
    assert chain.names == ["low_quality", "toxic"] and len(chain.models[1].dense) == 1
    got = {r.doc_id: r.rejected for r in T.score(docs, chain).collect()}
    fresh = range(400, 500)
    assert sum(got[i] == (i % 6 == 0) for i in fresh) >= 96
    assert not got[600] and not got[601]
    kept = T.drop_toxic(docs.withColumnRenamed("n_chars", "_row"), known)
    assert "_row" in kept.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if not v}
    assert T.score(empty, chain).count() == 0
    assert not any(r.rejected for r in T.score(docs, T.train(docs, known.limit(0))).collect())


def test_neighbours(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tarnhelm.llm import neighbours as N

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:160] = x[100]  # copies of one vector
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [1.0]), (5100, []), (7, x[7].tolist())]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumn("vector", F.lit("clash"))
    got: dict = {}
    for r in N.search(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == list(range(0, 1200, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1200), -np.round(s, 12)))[:20]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in found)
        hits += len(set(best.tolist()) & {r.vec_id for r in found})
    assert hits >= 0.95 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in N.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert N.search(vectors.limit(0), F.col("vec_id") == 0).count() == 0


def test_html():
    from tarnhelm.llm.html_text import extract, smoothed

    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/a>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies and much text to make this long enough to matter for the ratio.</div><div id="sidebar"><p>Related things</p></div>
    <article><h1>Head &amp; line</h1><p><b>First  part.<br>goes
    on<p>Short.</p><div class="ad">Buy now</div><form><input name=x>Sign up</form><ul><li>one<li>two</ul><p>Long paragraph of the article that says a good deal more than the others do, &eacute;.</p></article>
    <div class="comments"><p>Reader says a lot of things here, quite long in fact, longer than a paragraph.</p></div><footer>&copy; x</footer></body></html>"""
    assert extract(page) == "Head & line\n\nFirst part. goes on\n\nShort.\n\none\n\ntwo\n\nLong paragraph of the article that says a good deal more than the others do, é."
    assert extract(None) == extract("") == extract("<html><nav>x</nav></html>") == ""
    plain = "<body><div class=menu><a>a</a></div><div><p>" + "words " * 50 + "</p><p>end</p></div><div><a>x</a><a>y</a></div></body>"
    assert extract(plain) == ("words " * 50).strip() + "\n\nend"
    assert extract('<div class="with-sidebar"><article>body text</article><article class="comment">no</article></div>') == "body text"
    assert extract('<main>body text<article class="comment">no</article></main>') == "body text"
    assert extract("<p>unclosed <!-- never ends") == "unclosed"
    assert abs(smoothed(np.ones(5)) - 1).max() < 1e-12 and pa is not None
    assert extract('<article><p>first text</p><script>var x="<!--";</script><p>second text</p></article>') == "first text\n\nsecond text"
    assert extract('<article><header><h1>Head</h1></header><p class="widget">a</p><div class="share">b</div><footer>no</footer></article>') == "Head\n\na\n\nb"
    deep = "<b>" * 30
    assert extract(f"<article><ul><li>one{deep}<li>two</ul><p>a{deep}<div>b</div></article>") == "one\n\ntwo\n\na\n\nb"
    assert extract("<article>" + "<p>x" * 20000 + "</p></p></p></article>").count("x") == 20000
    assert extract("<div>" * 5000 + "deep" + "</b>" * 5000) == "deep"


def test_html_regions_come_from_the_ratios(monkeypatch):
    """Pages without a telling element or class: what is content decides."""
    from tarnhelm.llm import html_text as H

    menu = "".join(f"<div><a href=/{i}>item {i}</a></div>" for i in range(8))
    body = "".join(f"<p>{'some words of the text ' * n}</p>" for n in (9, 14, 1, 20))
    text = "\n\n".join(("some words of the text " * n).strip() for n in (9, 14, 1, 20))
    small = "".join(f"<span><i>tag</i></span><div><em>s{i}</em></div>" for i in range(6))
    flat = f"<body><div>{menu}</div><div><h1>Title</h1><div>{body}</div></div><div>{small}</div></body>"
    table = f"<table><tr><td>{menu}</td><td>{body}</td></tr></table>"
    parts = f"<body><div>{menu}</div><section>{body}</section><section>{body}</section></body>"
    wanted = [f"Title\n\n{text}", text, f"{text}\n\n{text}"]
    assert [H.extract(x) for x in (flat, table, parts)] == wanted
    monkeypatch.setattr(H, "content", lambda lines, *_: np.ones(len(lines), bool))
    assert all(H.extract(x) != y for x, y in zip((flat, table, parts), wanted, strict=True))


def test_html_rows(spark):
    from tarnhelm.llm import html_text

    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "<article>x</article>", 1), (2, None, "<article>x</article>", 1)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(9)
    table = rows() + [(2000 + i, sentence(rng, 40) + (" vile rotten filthy" if i % 4 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(200)]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2000 + i, 1, int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = " ".join(table[10][1].split()[:15])
    spark.createDataFrame([("1", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = []
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        seen.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert i == len(C.STAGES) - 1 or docs.columns == columns, name
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mixing", "token_ids"]
    assert sum(2000 + i in seen[0] for i in range(0, 200, 4)) <= 3 and sum(2000 + i in seen[0] for i in range(1, 200, 4)) >= 48
    assert 100 in seen[0] and 100 not in seen[1] and 10 in seen[1] and 10 not in seen[2]
    assert len(seen[3]) == len(seen[4])


def star(rng: random.Random, n: int = 120, words: int = 400, changed: int = 8) -> list[tuple]:
    """A text, and copies that each are over 0.8 like it, but under 0.8 like each other."""
    base = sentence(rng, words).split()
    table = [(0, " ".join(base), "en", "s", 1)]
    for i in range(1, n):
        copy = list(base)
        for at in rng.sample(range(0, words, 6), changed):
            copy[at] = f"new{rng.randrange(10**9)}"
        table.append((i, " ".join(copy), "en", "s", 1))
    return table


def test_copies_that_only_resemble_their_original_are_one_class(spark, monkeypatch):
    from tarnhelm.llm import neardup as N

    table = star(random.Random(5))
    assert len(exact_classes(table[:1] + table[1:12])) == 12 and set(c for _, c in exact_classes(table)) == {0}
    assert len(set(c for _, c in exact_classes(table[1:]))) > 100
    docs = spark.createDataFrame(table, SCHEMA)
    monkeypatch.setattr(N, "PART", 16, raising=False)  # a large bucket is dealt in parts
    # One row a band: all texts share buckets, so that nothing is left to chance.
    got = Counter((r.doc_id, r.class_id) for r in N.classes(docs, bands=20, rows=1).collect())
    assert got == exact_classes(table)
    assert Counter((r.doc_id, r.class_id) for r in N.classes(docs.where("doc_id > 0"), bands=20, rows=1).collect()) == exact_classes(table[1:])


def test_classes_without_ids_or_with_the_same_id_keep_a_text_each(spark):
    from tarnhelm.llm import neardup as N

    rng = random.Random(6)
    texts = [sentence(rng, 60) for _ in range(8)]
    table = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2] + " more"), (4, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[5]), (None, texts[5]), (None, None)]
    kept = N.drop_near_duplicates(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in table], SCHEMA)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, texts[0]), (None, texts[1]), (4, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[5]), (None, None)])


def test_rare_ngrams_count_in_a_large_corpus(spark):
    from tarnhelm.llm import lm

    rng = random.Random(12)
    table = [(i, sentence(rng, 60)) for i in range(40)] + [(100 + i, "one rare pair of words") for i in range(3)] + [(200, None)]
    table += [(1000 + i, "a b c d e " * 20_000) for i in range(18)]  # 1.8 million tokens: a share of 2e-6 would be over 3
    got = lm.score(spark.createDataFrame(table, "doc_id long, text string").repartition(3), lm.held_out("doc_id")).collect()
    texts = {d: ["<s>", *(t or "").split(), None] for d, t in table}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = [Counter() for _ in range(4)]
    for d, t in texts.items():
        if not held(d):
            for k in (1, 2, 3):
                c[k].update(zip(*(t[i:] for i in range(k)), strict=False))
    total = sum(n for g, n in c[1].items() if g != ("<s>",)) + len(c[1])  # distinct words and one more, without the start
    kept = {k: {g: n for g, n in c[k].items() if n >= 2} for k in (2, 3)}
    after: dict = {}
    for k in (2, 3):
        for g in kept[k]:
            after.setdefault(g[:-1], []).append(g[-1])
    memo: dict = {}

    def p(context, w):
        if not context:
            return (c[1][(w,)] + 1) / total
        if (context, w) not in memo:
            gram = (*context, w)
            if gram in kept[len(gram)]:
                memo[context, w] = (kept[len(gram)][gram] - 0.5) / c[len(context)][context]
            elif context not in after:
                memo[context, w] = p(context[1:], w)
            else:
                memo[context, w] = (1 - sum(p(context, x) for x in after[context])) / (1 - sum(p(context[1:], x) for x in after[context])) * p(context[1:], w)
        return memo[context, w]

    assert len(got) == len(table) and {r.held_out for r in got} == {True, False}
    for r in got:
        t = texts[r.doc_id]
        expected = sum(math.log10(p(tuple(t[max(0, i - 2) : i]), t[i])) for i in range(1, len(t)))
        assert abs(r.score - expected) < 1e-6 * max(1, abs(expected)), r.doc_id


def test_parts_and_blocks_lose_no_pair(spark, monkeypatch):
    """Families alike but below the threshold, links between any two of them: with one-row bands all texts of a family share buckets."""
    from tarnhelm.llm import neardup as N

    for name, value in (("PART", 8), ("BLOCK", 8), ("LEADERS", 1)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(9)
    table: list[tuple] = []
    for family in range(2):
        base = sentence(rng, 150).split()
        for i in range(60):
            copy = list(base)
            for _ in range(rng.choice([1, 4, 9])):
                copy[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
            table.append((100 * family + i, " ".join(copy), "en", "s", 1))
        table.append((100 * family + 90, " ".join(base * 3), "en", "s", 1))
    got = Counter((r.doc_id, r.class_id) for r in N.classes(spark.createDataFrame(table, SCHEMA), bands=20, rows=1).collect())
    assert got == exact_classes(table) and 10 < len({c for _, c in got}) < 110


def test_matrices_of_pairs_agree_with_one_pair_at_a_time():
    import pyarrow as pa

    from tarnhelm.llm import neardup as N

    rng = random.Random(10)
    base = sentence(rng, 60).split()
    texts = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(60)] = rng.choice(["other", "word", base[0]])
        texts.append(" ".join(copy + copy[: rng.choice([0, 0, 20, 60])]))
    sets = N.Sets.of(pa.array(texts), 5)
    good, maybe = sets.close(0.8)
    for i in range(40):
        for j in range(40):
            close = N.similarity(sets[i], sets[j]) >= 0.8
            assert i == j or ((good[i, j] or maybe[i, j]) if close else not good[i, j])


def test_pipeline_of_empty_odd_and_wide_tables(spark, tmp_path, empty, wide):
    import corpus_pipeline as C

    def folder(name, documents, labels, items):
        documents.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        return f"{tmp_path}/{name}"

    assert C.run(spark, folder("empty", empty, [], [])).collect() == []
    odd = [(None, 1, 1), (1, None, 1), (2, 1, None), (5, 0, 1), (5, 1, 0), (99999, 1, 1), (7, 1, 0)]
    at = folder("odd", wide, odd, [(None, "one two"), ("x", None), ("y", "")])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        assert docs.columns == wide.columns
    kept = spark.read.parquet(f"{at}/decontaminate")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 400 in ids and 600 not in ids  # a null text stays; "one two" is an item without an id
    texts = Counter(r.text for r in kept.select("text").where("text is not null").collect())
    assert max(texts.values()) == 1


def test_very_long_texts(spark):
    """A text of 60,000 words among short ones, end to end: scores add up, ids are whole, classes and repeats are found."""
    from tarnhelm.llm import lm, neardup, substrings, tokens

    rng = random.Random(31)
    long = sentence(rng, 60_000)
    table = [(1, long), (2, long + " end"), (3, sentence(rng, 50)), (4, None), (5, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    scores = {r.doc_id: r for r in lm.score(docs, lm.held_out("doc_id")).collect()}
    assert scores[1].n_tokens == 60_001 and scores[1].score < 0 and scores[4].n_tokens == scores[5].n_tokens == 1
    ids = {r.doc_id: r for r in tokens.round_trip(docs).collect()}
    plain = tokens.Encoder(tokens.VOCABULARY).tokenizer.encode(long, add_special_tokens=False).ids
    assert np.frombuffer(ids[1].ids, "<u4").tolist() == [*plain, 1]
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {r.doc_id: r.n_removed for r in substrings.dedup(docs).collect()} == {1: 0, 2: 60_000, 3: 0, 4: 0, 5: 0}


def test_mixing_takes_per_document_what_the_order_says(spark):
    """``taken`` of each document against the definition: whole epochs, then documents in the order of their keys until the budget is used."""
    from pyspark.sql import functions as F

    from tarnhelm.llm import mixing as M

    rng = random.Random(13)
    table = [(i, sentence(rng, rng.randrange(1, 40)), "en", rng.choice(["a", "b", "c", "d", None]) if i % 7 else "a", 1) for i in range(400)]
    docs = spark.createDataFrame(table, SCHEMA)
    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64(F.lit(0), F.col("doc_id")).alias("k")).collect()}
    got = {r.doc_id: r for r in M.allot(docs).collect()}
    for source in ("a", "b", "c", "d", None):
        own = sorted((r for r in table if r[3] == source), key=lambda r: (keys[r[0]], r[0]))
        size = sum(len(r[1].split()) for r in own)
        budget = round(got[own[0][0]].target)
        epochs, rest = divmod(budget, size)
        for r in own:
            n = len(r[1].split())
            part = max(0, min(n, rest))
            rest -= part
            assert got[r[0]].taken == epochs * n + part and got[r[0]].source_size == size


@pytest.mark.parametrize("metric", ["inner", "euclidean"])
def test_recall_where_few_candidates_are_scored_exactly(spark, metric):
    """6,000 vectors of 64 dimensions, clustered and unequally long; 120 candidates, 2 in 100, go on to exact scores. The norms decide for Euclidean distance."""
    from pyspark.sql import functions as F

    from tarnhelm.llm import neighbours as N

    rng = np.random.default_rng(8)
    x = (rng.normal(size=(60, 64))[rng.integers(0, 60, 6000)] + 0.6 * rng.normal(size=(6000, 64))) * rng.uniform(0.7, 1.3, 6000)[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in N.search(vectors, F.col("vec_id") % 100 == 0, rerank=120, metric=metric).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q, found in got.items():
        s = x @ x[q] if metric == "inner" else -((x - x[q]) ** 2).sum(axis=1)
        s[q] = -np.inf
        assert len(found) == 20 and all(abs(s[v] - score) < 1e-9 for v, score in found.items())
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(found))
    assert len(got) == 60 and hits >= 0.9 * 20 * 60, hits / (20 * 60)
