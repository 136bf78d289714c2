"""Problem 6 against a word-by-word brute force."""

import random

import pytest

from ledgerloom.llm import leakage
from ledgerloom.llm.words import clean_texts, words_of

STOCK = "Read the change below and answer in a single sentence without any tool."
NOUNS = [f"noun{i}" for i in range(60)]
ADJ = [f"adj{i}" for i in range(40)]


def sentence(r):
    n, a = (lambda: r.choice(NOUNS)), (lambda: r.choice(ADJ))
    return r.choice([
        f"Rolling back to the {a()} {n()} of {n()} helps, but {a()} {n()} drops {a()} {n()} and {a()} {n()} before {n()}.",
        f"Without the {a()} {n()}, {a()} {n()} see a {n()} that rejects {a()} {n()} after {a()} {n()} at {n()}.",
        f"Name the {a()} {n()} which folds {n()} and {n()} without touching {a()} {n()} or {a()} {n()} within {n()}.",
    ])


def make(seed, items=30):
    r = random.Random(seed)
    own = [" ".join(sentence(r) for _ in range(4)) for _ in range(items)]
    rows = [(i, "s", (STOCK + "\n" if i % 2 else "") + t) for i, t in enumerate(own)]
    rows.append((items, "s", "  " + own[3].replace(" ", "  ")))  # the same item under another id
    return r, own, rows


def texts_from(r, own):
    out = []
    for i, t in enumerate(own):
        words = t.split()
        if i % 6 == 0:
            out.append((t.upper(), i))
        elif i % 6 == 1:
            out.append(("diff\n+" + "\n+".join(" ".join(words[k : k + 7]) for k in range(0, 42, 7)), i))
        elif i % 6 == 2:  # one word in six exchanged
            out.append((" ".join("swapped" if k % 6 == 5 else w for k, w in enumerate(words)), i))
        elif i % 6 == 3:  # interposed lines and markup
            lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
            out.append(("\n-  let x = the(y);\n@@ -1,2 @@ job\n".join(f"<p>{x.replace(' ', ' <b>', 1)}</b>" for x in lines), i))
        elif i % 6 == 4:  # too short
            out.append((" ".join(words[:20]), None))
        else:  # too many words exchanged
            out.append((" ".join("swapped" if k % 3 == 2 else w for k, w in enumerate(words)), None))
    for _ in range(20):
        out.append((STOCK + " " + " ".join(sentence(r) for _ in range(3)), None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_finds_leaks_and_nothing_else(spark, seed):
    r, own, rows = make(seed)
    texts = texts_from(r, own)
    docs = [(i, t, "x", 1, b"") for i, (t, _) in enumerate(texts)] + [(900, None, "x", 1, b""), (901, "", "x", 1, b""), (902, " \n", "x", 1, b"")]
    want = {(i, k) for i, (_, k) in enumerate(texts) if k is not None}
    want |= {(i, len(own)) for i, k in want if k == 3}
    d = spark.createDataFrame(docs, "doc_id long, text string, terms string, ends int, places binary")
    got = {tuple(x) for x in leakage.leaked_items(d, spark.createDataFrame(rows, "item_id long, suite string, text string")).collect()}
    assert got == want


def test_very_long_text_and_repeated_rows(spark):
    r, own, rows = make(5)
    filler = " ".join(f"w{k}" for k in range(300_000))
    docs = spark.createDataFrame([(1, filler + " " + own[7]), (1, filler + " " + own[7]), (2, filler)], "doc_id long, text string")
    got = leakage.leaked_items(docs, spark.createDataFrame(rows, "item_id long, suite string, text string")).collect()
    assert [tuple(x) for x in got] == [(1, 7)]


def test_text_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PART_BYTES", 2000)
    r, own, rows = make(6)
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(3000)) + " " + own[7] + " end" * 999), (2, own[8])], "doc_id long, text string")
    got = leakage.leaked_items(docs, spark.createDataFrame(rows, "item_id long, suite string, text string")).collect()
    assert sorted(tuple(x) for x in got) == [(1, 7), (2, 8)]


def test_stock_runs_agree(spark):
    _, own, rows = make(4)
    items = spark.createDataFrame(rows, "item_id long, suite string, text string")
    as_rows = [{"item_id": i, "text": t} for i, _, t in rows]
    stock = leakage.stock_runs(items)
    a, b = leakage.read_items(as_rows), leakage.read_items(as_rows, stock=stock)
    assert stock and all((x == y).all() for x, y in zip(a.words, b.words))


def test_items_in_blocks(spark):
    r, own, rows = make(1)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts_from(r, own))], "doc_id long, text string")
    items = spark.createDataFrame(rows, "item_id long, suite string, text string")
    whole, parts = leakage.leaked_items(docs, items), leakage.leaked_items(docs, items, max_items_bytes=6000)
    assert set(whole.collect()) == set(parts.collect()) and parts.count() == len(set(parts.collect()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "s", "a b c"), (2, "s", None), (3, "s", "")], "item_id long, suite string, text string")
    assert leakage.leaked_items(docs, items).count() == 0
    assert leakage.leaked_items(docs.limit(0), items).count() == 0
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0


def test_index_holds_every_posting(spark):
    import numpy as np
    import pyarrow as pa

    texts = ["b a b", None, "", "Über-a <b>b</b> b", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = words_of(clean_texts(pa.array(["a b"])))[2]
    found = set()
    for row in leakage.build_index(docs, shard_docs=2).collect():
        ids, n, terms, ends, places = leakage.unpack(row.asDict())
        start = np.append(0, np.cumsum(n))
        for t, lo, hi in zip(terms, [0, *ends[:-1]], ends):
            for p in places[lo:hi]:
                d = np.searchsorted(start, p, side="right") - 1
                found.add((int(ids[d]), int(p - start[d]), int(t)))
    assert {(d, p) for d, p, t in found if t == a} == {(0, 1), (3, 1), (4, 0)}
    assert {(d, p) for d, p, t in found if t == b} == {(0, 0), (0, 2), (3, 2), (3, 3)}
    assert len(found) == 8


def brute(words, doc, rule):
    """Longest chains of equal words by their first word, whatever their length."""
    chains = {}  # (place in item, place in document) -> {first place in item: most words}
    for p, term in enumerate(doc):
        for i, w in enumerate(words):
            if w != term:
                continue
            best = {i: 1}
            for (j, q), had in chains.items():
                if j < i and 0 < p - q <= rule.near + 1:
                    for a, n in had.items():
                        best[a] = max(best.get(a, 0), n + 1)
            chains[i, p] = best
            if any(i - a + 1 >= rule.window and rule.exchanged * n >= (rule.exchanged - 1) * (i - a + 1) for a, n in best.items()):
                return True
    return False


@pytest.mark.parametrize("seed,vocabulary,near", [(1, 25, 3), (2, 60, 3), (3, 200, 3), (4, 60, 0), (5, 40, 12)])
def test_every_pair_against_brute_force(spark, seed, vocabulary, near):
    """Documents of one to many pieces, with passages at the edge of the rule and just beyond it; recall and precision are 1."""
    r = random.Random(seed)
    word = lambda: f"v{r.randrange(vocabulary)}"
    items = [[word() for _ in range(r.randrange(8, 50))] for _ in range(12)]
    docs = []
    for _ in range(90):
        text = [word() for _ in range(r.choice([0, 30, 30, 300]))]
        i = r.choice(items)
        a = r.randrange(len(i))
        part = i[a : a + r.choice([12, 13, 18, 24, 36, 50])]
        wrong = r.choice([0, 1, 2, 3, 5, 7])
        for k in r.sample(range(len(part)), min(wrong, len(part))):
            part[k] = "zz"
        spread, gap = [], r.choice([0, 0, near, near + 1])
        for w in part:
            spread += [w, *(f"x{r.randrange(9)}" for _ in range(gap if r.random() < 0.3 else 0))]
        at = r.randrange(len(text) + 1)
        docs.append(text[:at] + spread + text[at:])
    rule = leakage.Rule(12, 6, near)
    want = {(d, k) for d, t in enumerate(docs) for k, i in enumerate(items) if brute(i, t, rule)}
    assert 10 < len(want) < 90 * 12
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string")
    found = leakage.leaked_passages(d, spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string"), 12, 6, near)
    rows = found.collect()
    assert {(x.doc_id, x.item_id) for x in rows} == want and len(rows) == len(want)
    phrase = lambda i, t: any(" ".join(i[a : a + 12]) + " " in " ".join(t) + " " for a in range(len(i) - 11))
    assert {(x.doc_id, x.item_id) for x in rows if x.kind == "phrase"} == {(d, k) for d, k in want if phrase(items[k], docs[d])}


def test_long_lists_and_small_groups_give_the_same(spark, monkeypatch):
    import numpy as np

    r = random.Random(8)
    items = [[f"v{r.randrange(9)}" for _ in range(r.randrange(12, 40))] for _ in range(6)]
    docs = [[r.choice([f"v{r.randrange(9)}", "zz", f"v{r.randrange(9)}"]) for _ in range(r.choice([20, 60, 200]))] for _ in range(25)]
    docs += [i[: r.randrange(12, 40)] for i in items]
    frames = [spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(x)], f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))]
    rule = leakage.Rule(12, 6, 2)
    want = {(d, k) for d, t in enumerate(docs) for k, i in enumerate(items) if brute(i, t, rule)}
    assert {tuple(x) for x in leakage.leaked_items(*frames, window=12, near=2).collect()} == want and want
    monkeypatch.setattr(leakage, "MANY", 0)
    monkeypatch.setattr(leakage, "CELLS", 50)
    assert {tuple(x) for x in leakage.leaked_items(*frames, window=12, near=2).collect()} == want
    a, w = leakage.repeated(np.array([3, 1, 3]), np.array([3, 2, 3, 1]))
    assert list(zip(a.tolist(), w.tolist())) == [(0, 0), (0, 2), (1, 3), (2, 0), (2, 2)]


def test_words_shared_with_other_items_and_lines_after_every_second_word(spark):
    own, shared = [f"own{i}" for i in range(12)], [f"shared{i}" for i in range(12)]
    rows = [(k, " ".join([*(f"x{k}y{i}" for i in range(20)), *(shared if k < 10 else [])])) for k in range(121)]
    mixed = [w for pair in zip(own, shared) for w in pair]
    rows += [(500, " ".join(own[:6] + shared[:6] + own[6:] + shared[6:])), (501, " ".join(mixed)), (502, " ".join(f"plain{i}" for i in range(24)))]
    docs = []
    for k, text in rows[-3:-1]:
        words = text.split()
        for wrong in ((2, 8, 14, 20), (4, 9, 14, 19), (1, 2, 3, 4)):
            docs.append((len(docs), " ".join("new" if i in wrong else w for i, w in enumerate(words)), k))
    docs.append((len(docs), "".join(f"plain{i}" + (f"\nline{i}\n" if i % 2 else " ") for i in range(24)), 502))
    items = spark.createDataFrame(rows, "item_id long, text string")
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string, item long"), items).collect()
    assert {tuple(x) for x in got} == {(d, k) for d, _, k in docs}


def test_scripts_without_blanks(spark):
    item = "提交之前请先检查缓存目录是否已经清空否则旧的索引会在下一次启动时被重新读取"
    docs = [(1, "日志：" + item[:14] + "，\n" + item[14:] + "。完"), (2, item[:20] + "甲乙丙丁"), (3, "บันทึก " + "กรุณาตรวจสอบแคชก่อนส่งงานทุกครั้งเสมอ")]
    items = [(1, item), (2, "กรุณาตรวจสอบแคชก่อนส่งงานทุกครั้งเสมอ")]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(x) for x in got) == [(1, 1), (3, 2)]


def test_one_index_for_several_item_sets(spark):
    r, own, rows = make(7)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts_from(r, own))], "doc_id long, text string")
    items = spark.createDataFrame(rows, "item_id long, suite string, text string")
    index = leakage.build_index(docs)
    whole = set(leakage.leaked_items(docs, items).collect())
    stock = leakage.stock_runs(items)
    assert set(leakage.leaked_items(docs, items, index=index).collect()) == whole
    odd = leakage._ask(index, items.where("item_id % 2 = 1"), leakage.Rule(), stock).select("doc_id", "item_id")
    assert set(odd.collect()) == {x for x in whole if x.item_id % 2}


def test_long_texts_are_cut_between_words():
    import pyarrow as pa

    from ledgerloom.llm.words import _segments

    texts = ["one two <b class='x y'>three</b> four &amp; five " * 40, "line one\nline <i>two</i>\n" * 60, "a,b,c;d/e-" * 80, "字" * 500, "<p a b c d>" * 90]
    for text in texts:
        want = words_of(clean_texts(pa.array([text])))[2].tolist()
        for size in (70, 133, 500):
            parts = _segments(text, size)
            assert "".join(parts) == text and (len(parts) > 1) == (len(text) > size)
            assert [h for x in parts for h in words_of(clean_texts(pa.array([x])))[2].tolist()] == want


def test_items_bounds(spark):
    _, own, rows = make(9)
    items = leakage.read_items([{"item_id": i, "text": t} for i, _, t in rows])
    assert all(len(w) == len(o.replace(",", "").split()) for w, o in zip(items.words, own))  # stock wording is gone
    assert len(items.ids) == len(rows)


def test_items_of_many_words(spark):
    words = [f"w{k}" for k in range(40_000)]
    docs = [(1, " ".join(words[33_000:33_024])), (2, " ".join(words)), (3, " ".join(words[::2]))]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted(x.doc_id for x in got) == [1, 2]


def test_one_word_over_and_over(spark):
    docs = [(1, "again " * 100_000), (2, "again " * 19)]
    items = spark.createDataFrame([(1, "again " * 40), (2, "other " * 40)], "item_id long, text string")
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert [tuple(x) for x in got] == [(1, 1)]
