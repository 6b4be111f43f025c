import random

import pytest

from burstlake.llm import leakage as L
from burstlake.llm.visual import former

WORDS = [f"{a}{b}{c}" for a in ("bal", "tor", "min", "ven", "sul", "kar") for b in ("a", "e", "o", "u") for c in ("den", "fis", "gom", "lat", "pur")]


@pytest.fixture(scope="module")
def words():
    return L.Words(former(), L.fold_table())


def text(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def test_markup_does_not_hide_words(words):
    plain = "the coordinated naive filter keeps every word"
    for s in (
        r"the \emph{coordinated} na\"ive filter keeps every word", r"{\bf the} co\"{o}rdinated na{\"\i}ve \textbf{filter} keeps every word", "the coordinated naive fil-\n  ter keeps every word",
        "the coördinated naïve ﬁlter keeps every word", "% the coordinated naive filter\n% keeps every word", r"the coordinated $x_{n}^2$ naive~filter keeps\cite[p]{} every word", "ｔｈｅ coordinated naive filt​er kееps every word",
    ):
        h, n = words.split([s, plain])
        got, want = h[: n[0]].tolist(), h[n[0] :].tolist()
        missing = [w for w in want if w not in got]
        assert not missing, s


def test_lone_dollar_and_empty(words):
    h, n = words.split(["", "a $ b\n\nc d", None or "x"])
    assert n.tolist() == [0, 4, 1]
    assert words.split([])[1].tolist() == []


def brute(doc, item):
    """Plain dynamic programming over all cells, passages taken greedily as the operator states them."""
    import numpy as np

    eq = [[a == b for b in doc] for a in item]
    total = []
    while True:
        best, H = (0, 0, 0), [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
        for i in range(1, len(item) + 1):
            for j in range(1, len(doc) + 1):
                H[i][j] = max(0, H[i - 1][j - 1] + (1 if eq[i - 1][j - 1] else -L.CHANGED), H[i - 1][j] - L.CHANGED, H[i][j - 1] - 1)
                if H[i][j] > best[0]:
                    best = (H[i][j], i, j)
        if best[0] < 6:
            break
        s, i, j = best
        i1, j1, same = i, j, 0
        while H[i][j] > 0:
            if H[i][j] == H[i - 1][j - 1] + (1 if eq[i - 1][j - 1] else -L.CHANGED):
                same += eq[i - 1][j - 1]
                i, j = i - 1, j - 1
            elif H[i][j] == H[i - 1][j] - L.CHANGED:
                i -= 1
            else:
                j -= 1
        total.append((same, i, i1, j, j1))
        for a in range(i, i1):
            eq[a] = [False] * len(doc)
        for a in range(len(item)):
            for b in range(j, j1):
                eq[a][b] = False
    return L.in_order(total)


def test_against_brute_force(spark, words):
    r = random.Random(4)
    items = {k: text(r, r.randint(40, 70)) for k in range(6)}
    docs, planted = [], {}
    for d in range(60):
        w = text(r, r.randint(60, 160))
        if d % 3:
            k = r.randrange(6)
            part = items[k]
            take = r.choice([0.2, 0.35, 0.7, 1.0])
            a = r.randrange(0, max(1, int(len(part) * (1 - take))) + 1)
            part = part[a : a + int(len(part) * take)]
            part = [r.choice(WORDS) if r.random() < 0.06 else x for x in part]
            at = r.randrange(len(w))
            w = w[:at] + part + w[at:]
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, ""), (102, docs[1][1]), (102, docs[1][1])]
    want = set()
    for d, t in docs:
        for k, it in items.items():
            if t and brute(t.split(), it) >= 0.5 * len(it):
                want.add((d, k))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(9, None), (10, ""), (11, "two words")], "item_id bigint, item_text string")
    got = {(x.doc_id, x.item_id) for x in L.leaks(df, it).collect()}
    assert len(want) > 10 and got == want
    blocks = {(x.doc_id, x.item_id) for x in L.leaks(df, it, block_items=2).collect()}
    assert blocks == want
    assert L.leaks(df.limit(0), it).count() == 0 and L.leaks(df, it.limit(0)).count() == 0


def test_split_passages_and_order(words):
    r = random.Random(9)
    item = text(r, 60)
    items = L.Items.build([1], [" ".join(item)], words)
    f = L.Finder(items, words, 0.5, 6, 0.2)
    gap = text(random.Random(1), 50)
    assert f.find([" ".join(item[:20] + gap + item[25:45])])
    assert not f.find([" ".join(item[30:50] + gap + item[:20])])  # in the other order each passage is too little
    assert not f.find([" ".join(w for x in item for w in (x, *gap[:4]))])  # scattered words
    assert not f.find([" ".join(item[:14])])  # a shared phrase


def test_long_text(words):
    r = random.Random(3)
    item = text(r, 50)
    f = L.Finder(L.Items.build([1], [" ".join(item)], words), words, 0.5, 6, 0.2)
    big = " ".join(text(r, 60_000)) + " " + " ".join(item)
    assert [x[:2] for x in f.find([big])] == [(0, 0)]
    # the passage across the edge of a slice, and slices against the whole
    doc, it = f.words.split([" ".join(text(r, 300) + item[:30] + text(r, 90) + item[30:] + text(r, 60))])[0], f.items.words[0]
    for k in (100, 311, 350, 500):
        assert L.in_order(L.all_passages(doc, it, 6, k)) == L.in_order(L.passages(doc, it, 6)) == 50
    dense, places = L.dense_stretches(doc, it)
    assert L.dense_stretches(doc, it, 37)[0] == dense and L.in_order(L.passages(L.around(doc, places, 100), it, 6)) == 50


def test_stretches_held_more_than_once(words):
    r = random.Random(12)
    item = text(r, 60)
    f = L.Finder(L.Items.build([1], [" ".join(item)], words), words, 0.5, 6, 0.2)
    gap = lambda k: text(random.Random(k), 300)
    doc = item[40:] + gap(1) + item[:20] + gap(2) + item[40:]
    share = 40 / 60
    assert f.find([" ".join(doc)]) == [(0, 0, share)]  # the early copy is no use
    far = text(random.Random(3), 60_000)
    assert f.find([" ".join(item[40:] + far + item[:20] + far + item[40:])]) == [(0, 0, share)]
    assert f.find([" ".join(item[:35] + gap(1) + item[25:])]) == [(0, 0, 1.0)]  # copies that overlap in the item
    assert f.find([" ".join(item[25:] + gap(1) + item[:35])]) == [(0, 0, 35 / 60)]
    copies = [x for k in range(40) for x in (*item[:19], *gap(100 + k)[:70])]
    assert f.find([" ".join(copies + item[20:40])]) == [(0, 0, 39 / 60)]
    # in slices as in one
    doc, it = words.split([" ".join(doc + item[10:30])])[0], f.items.words[0]
    assert {L.chained(L.all_passages(doc, it, 6, k), 60, 6) for k in (100, 250, 333, 50_000)} == {40}


def test_short_items(spark, words):
    r = random.Random(21)
    pool = r.sample(WORDS, 100)
    items = {n: pool[n * (n - 1) // 2 : n * (n + 1) // 2] for n in range(1, 13)}  # of 1 to 12 words, none shared
    fill = lambda k: [r.choice(("xa", "xe", "xi", "xo")) for _ in range(k)]
    docs, want = [], set()
    for n, w in items.items():
        half, less = -(-n // 2), -(-n // 2) - 1
        for k, (part, leaked) in enumerate((([*w], True), (w[:half], True), (w[n - half :], True), (w[:less], False))):
            docs.append((10 * n + k, " ".join(fill(30) + part + fill(30))))
            if leaked:
                want.add((10 * n + k, n))
    docs.append((900, " ".join(items[8][:2] + ["xa"] + items[8][2:6])))  # one inserted word: six equal, five points
    want.add((900, 8))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, item_text string")
    assert {(x.doc_id, x.item_id) for x in L.leaks(df, it).collect()} == want


@pytest.mark.parametrize("rate, least", [(0.1, 1.0), (0.2, 0.9), (0.25, 0.6)])
def test_recall_by_rate_of_changed_words(words, rate, least):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(4000)]
    items = [[r.choice(vocab) for _ in range(60)] for _ in range(80)]
    find = L.Finder(L.Items.build(list(range(80)), [" ".join(x) for x in items], words), words, 0.5, 6, 0.2)
    noise = lambda: [r.choice(vocab) for _ in range(100)]
    docs = [" ".join(noise() + [w if r.random() >= rate else r.choice(vocab) for w in x] + noise()) for x in items]
    got = {(d, i) for d, i, _ in find.find(docs)}
    assert sum((k, k) in got for k in range(80)) / 80 >= least and all(d == i for d, i in got)


def test_scripts_without_blanks_are_found_in_part(words):
    r = random.Random(3)
    han = [chr(0x4E00 + k) for k in r.sample(range(6000), 400)]
    item = "".join(r.choice(han) for _ in range(40))
    find = L.Finder(L.Items.build([7], [item], words), words, 0.5, 6, 0.2)
    docs = ["前言。" + item[:25] + "。" + "".join(r.choice(han) for _ in range(30)), "".join(r.choice(han) for _ in range(80)), item[:12]]
    assert [(d, i) for d, i, _ in find.find(docs)] == [(0, 0)]


def test_a_phrase_shared_by_all_items_loses_no_pair(words):
    """Seeds of a template are put off; pairs are the same as without that."""
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    phrase = [r.choice(vocab) for _ in range(9)]
    items = [phrase + [r.choice(vocab) for _ in range(r.choice([12, 50]))] for _ in range(150)]
    docs = [" ".join([r.choice(vocab) for _ in range(40)] + (phrase if k % 2 else []) + items[k][r.choice([0, 9]) :] + [r.choice(vocab) for _ in range(9)]) for k in range(150)]
    texts = [" ".join(x) for x in items]
    build = lambda: L.Finder(L.Items.build(list(range(150)), texts, words), words, 0.5, 6, 0.2)
    some = build()
    assert some.items.later and len(some.items.later) < 150
    hot, L.HOT = L.HOT, 10**9
    try:
        plain = build()
    finally:
        L.HOT = hot
    assert not plain.items.later and sorted(some.find(docs)) == sorted(plain.find(docs)) and len(some.find(docs)) >= 140


def test_blocks_share_the_words_of_the_documents(spark, words):
    r = random.Random(2)
    items = [text(r, 45) for _ in range(6)]
    docs = spark.createDataFrame([(k, " ".join(text(r, 20) + items[k % 6] + text(r, 20))) for k in range(12)] + [(99, None), (98, "")], "doc_id int, text string")
    held = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id int, item_text string")
    got = [sorted((x.doc_id, x.item_id, x.share_found) for x in L.leaks(docs, held, block_items=n).collect()) for n in (2, 100)]
    assert got[0] == got[1] and {(d, i) for d, i, _ in got[0]} >= {(k, k % 6) for k in range(12)}
