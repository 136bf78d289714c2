"""Problem 8: folding of spellings, gradients, learning, scoring."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import abuse


def hashes(text):
    return abuse.fold_words(pa.array([text]))[0].tolist()


@pytest.mark.parametrize("disguised,plain", [
    ("mo-ron", "moron"), ("MORON", "moron"), ("m0r0n", "moron"), ("you m o r o n here", "you moron here"), ("m.o.r.o.n here", "moron here"), ("mo​ron", "moron"), ("мoron", "moron"),
    ("mororrrrn", "mororn"), ("m**n", "m*n"), ("m#ron", "m*ron"), ("a 123456 b", "a 9 b"), ("x de1234ad9 y", "x 17 y"), ("1 22 333", "4"),
])
def test_disguises_fold(disguised, plain):
    assert hashes(disguised) == hashes(plain)


@pytest.mark.parametrize("disguised,plain", [
    ("1d107", "idiot"), ("w3453l", "weasel"), ("n17w17", "nitwit"), ("1mm1gr4n75", "immigrants"), ("0rg45m", "orgasm"), ("d3f3c473", "defecate"), ("455h0l3", "asshole"), ("@55", "ass"),
    ("a 10ms b", "a 9 b"), ("a $100 b", "a 9 b"), ("a 1337 b", "a 9 b"), ("a e4c0b71e0a13 b", "a 9 b"),
])
def test_words_of_many_digits_stay_words(disguised, plain):
    assert hashes(disguised) == hashes(plain)


def test_no_letters_are_lost_in_long_runs():
    insult = hashes("moron")[0]
    for text in ("x=find(/usr/share/lib/python/moron/you.py)", "<a-href='https://example.org/you/moron'>", "data:image/png;base64,iVBORw0KGgo2AAA8NSUhEU9gAA2moron9 moron"):
        assert insult in hashes(text)
    assert hashes("你是白痴白痴啊你是白痴白痴啊") == hashes(" ".join("你是白痴白痴啊你是白痴白痴啊")) and hashes("abc白痴x") == hashes("abc 白 痴 x")
    assert hashes("คนโง่") == hashes(" ".join("คนโง่"))
    long = "достопримечательность"[:20]
    assert hashes(long)[0] > abuse.LONG and hashes(long) != hashes(long[:-1] + "ж")
    for a, b in (("donaudampfschifffahrtsgesellschaft", "donaudampfschifffahrtsgesellschafk"), ("ы" * 1 + "достопримечательностями", "ы" * 1 + "достопримечательностяма")):
        assert min(hashes(a)) > abuse.LONG and hashes(a) != hashes(b) and hashes(a)[0] == hashes(b)[0]
    h, starts, length, first, data = abuse.fold_words(pa.array(["ok", "abcdefghijklmnopqrstuvwxyzabcdef ok", None, "x"]))
    assert [data[s : s + n].tobytes().decode() for s, n in zip(starts, length)] == ["ok", "abcdefghijklmnopqrst", "klmnopqrstuvwxyzabcd", "uvwxyzabcdef", "ok", "x"]
    assert first.tolist() == [0, 1, 5, 5, 6] and h[0] == h[4]
    assert hashes("a 0a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6e7f8a9b c") == [hashes("a")[0], abuse.LONG, hashes("c")[0]]


def test_folding_keeps_words_apart_and_texts_apart():
    assert hashes("diff -a +b") == hashes("diff a b") and hashes("a b c") != hashes("a b")
    h, starts, length, first, _ = abuse.fold_words(pa.array(["ab", "", None, "cd ef", "x"]))
    assert first.tolist() == [0, 1, 1, 1, 3, 4] and len(h) == 4
    assert abuse.fold_words(pa.array([None, ""]))[0].tolist() == []


def test_windows_overlap_and_cover():
    first = np.array([0, 0, 5, 5 + 24, 29 + 100])
    text, begin, end = abuse.windows_of(first)
    for t in range(4):
        covered = set()
        for b, e in zip(begin[text == t], end[text == t]):
            covered |= set(range(b, e))
        assert covered == set(range(first[t], first[t + 1]))
    assert set(np.diff(begin[text == 3])) == {abuse.STRIDE}


def phrases(seed, n):
    r = random.Random(seed)
    calm = "the build of this module was slow so we cache the parsed tree and drop stale rows from table".split()
    bad = ["you are a {} and nobody likes you", "get lost you {}", "what kind of {} ships this"]
    texts, labels = [], []
    for k in range(n):
        words = [r.choice(calm) for _ in range(r.randrange(30, 120))]
        if k % 3 == 0:
            at = r.randrange(len(words))
            words[at:at] = r.choice(bad).format(r.choice(["moron", "maggot", "parasite"])).split()
        elif k % 3 == 1:
            words += "kill the zombie process and nobody waits".split()
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return texts, labels


def test_gradients():
    texts, labels = phrases(1, 30)
    t = abuse.Trainer(texts, labels)
    t.rng = type("Still", (), {"random": staticmethod(lambda shape: np.ones(shape))})()  # nothing is masked
    for k, v in t.model.p.items():
        t.model.p[k] = v.astype("f8")
    w, target = np.arange(12), (np.arange(12) % 2).astype("f8")
    base = {k: v.copy() for k, v in t.model.p.items()}

    def loss():
        p = 1 / (1 + np.exp(-t.logits(w).astype("f8")))
        return -(target * np.log(p + 1e-7) + (1 - target) * np.log(1 - p + 1e-7)).mean()

    t.rate = 0.0
    t.step(w, target, np.ones(12))
    grads = {k: m / 0.1 for k, m in t.m.items()}  # Adam's first moment holds the (scaled) gradient
    rng, ratios = np.random.default_rng(0), []
    for name in ("wf", "uf", "ub", "cb", "a", "v", "o", "word", "char"):
        flat = np.abs(grads[name]).ravel()
        for i in rng.choice(np.argsort(-flat)[:20], 3):
            at = np.unravel_index(i, grads[name].shape)
            for sign in (1, -1):
                t.model.p[name][at] = base[name][at] + sign * 1e-2
                if sign == 1:
                    up = loss()
            down = loss()
            t.model.p[name][at] = base[name][at]
            ratios.append((up - down) / 2e-2 / grads[name][at])
    ratios = np.array(ratios)
    assert np.allclose(ratios, np.median(ratios), rtol=0.08), ratios  # all alike: only the common scale of clipping


def test_learns_from_noisy_labels():
    texts, labels = phrases(2, 300)
    noisy = [1 - y if k % 25 == 0 else y for k, y in enumerate(labels)]
    model = abuse.train(texts, noisy, steps=150)
    unseen, truth = phrases(3, 150)
    score = abuse.score_texts(model, pa.array(unseen))
    assert ((score >= model.threshold) == np.array(truth)).mean() > 0.95


def test_scores_of_documents(spark):
    texts, labels = phrases(4, 90)
    model = abuse.train(texts, labels, steps=60)
    rows = [(1, None, "s"), (2, "", "s"), (3, "the build " * 60_000 + "you are a moron and nobody likes you", "t"), (4, "the build was slow", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, score double")
    got = {r.doc_id: r.score for r in abuse.abuse_scores(docs, model, ["source"]).collect()}
    assert got[1] == got[2] == 0 and got[3] > got[4]
    rates = {r.source: (r.docs, r.bad) for r in abuse.rates_by_source(abuse.abuse_scores(docs, model, ["source"]), got[3]).collect()}
    assert rates == {"s": (2, 0), "t": (1, 1), None: (1, 0)}
    assert abuse.abuse_scores(docs.limit(0), model).count() == 0


def test_a_text_scores_the_same_in_any_batch():
    texts, labels = phrases(5, 90)
    code = "0a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6e7f8a9b"
    model = abuse.train([f"{x} {k}7 rows {code[k % 9 :]}" for k, x in enumerate(texts)], labels, steps=60)
    text = f"17 you are 4242 {code} get lost 99 of 5"
    alone = abuse.score_texts(model, pa.array([text]))[0]
    for other in ("31337 1", code[::-1], "de1234ad9 2 " + code[3:]):
        both = abuse.score_texts(model, pa.array([other, text]))
        assert abs(both[1] - alone) < 1e-6
    vectors = [abuse.word_inputs(model, model.number(h), data, starts, length) for h, starts, length, _, data in (abuse.fold_words(pa.array([x])) for x in ("17", "31337", "de1234ad9"))]
    assert all((v == vectors[0]).all() for v in vectors)
    grams = [abuse.Trainer([f"{n} ab", "cd"], [1, 0]).gram for n in ("17", "31337")]
    assert (grams[0] == grams[1]).all()


def test_text_cut_into_segments_scores_like_the_whole(monkeypatch):
    from ledgerloom.llm.words import parts_of

    texts, labels = phrases(4, 90)
    model = abuse.train(texts, labels, steps=60)
    long = "the build was slow " * 300 + "you are a moron and nobody likes you " + "the build was slow " * 300
    for size in (400, 4000, 9000):
        (k, segments, cut), = parts_of(pa.array([long]), 10, size)
        assert cut and "".join(segments.to_pylist()) == long
        whole = abuse.score_texts(model, pa.array([long]))[0]
        assert abs(abuse._score_cut(model, segments)[0] - whole) < 0.2
    parts = [(k, len(t), cut) for k, t, cut in parts_of(pa.array(["a" * 10, None, "b" * 10, "c" * 100, "", "d"]), 2, 50)]
    assert parts == [(0, 2, False), (2, 1, False), (3, 9, True), (4, 2, False)]


def test_labels_are_settled_by_majority(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(6)] + [(6, None)], "doc_id long, text string")
    labels = [(0, "a", "Hate "), (0, "b", "abuse"), (0, "c", "none"), (1, "a", "none"), (1, "a", "none"), (1, "b", "sexual"), (2, "a", None), (3, "a", "none"), (6, "a", "abuse"), (77, "a", "abuse"), (4, None, "none")]
    got = {r.doc_id: r.bad for r in abuse.labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, annotator string, category string")).collect()}
    assert got == {0: 1, 3: 0, 4: 0}


def test_without_labels_nothing_is_found(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    model = abuse.train_on(docs, spark.createDataFrame([], "doc_id long, annotator string, category string"))
    assert model.threshold > 1 and abuse.abuse_scores(docs, model).count() == 1


def scripts(seed, n):
    r = random.Random(seed)
    calm = {
        "han": "提交之前请先检查缓存目录是否已经清空否则旧的索引会被重新读取然后再次运行测试", "thai": "กรุณาตรวจสอบแคชก่อนส่งงานทุกครั้งเพื่อให้ระบบทำงานได้ดีและรวดเร็ว",
        "cyrillic": "перед отправкой проверьте каталог кэша иначе старый индекс будет прочитан заново при запуске", "latin": "the build of this module was slow so we cache the parsed tree and drop stale rows",
    }
    bad = {"han": ["你是白痴", "白痴滚出去", "你这个白痴"], "thai": ["ไอ้โง่ออกไป", "แกมันโง่", "คนโง่อย่างแก"], "cyrillic": ["ты человеконенавистник", "уйди человеконенавистник", "вот человеконенавистник"], "latin": ["you are/a_worthless.disgusting_piece/of_garbage", "a_worthless/disgusting.piece", "path/of/worthless.garbage_you"]}
    texts, labels, kinds = [], [], []
    for k in range(n):
        kind = list(calm)[k % 4]
        words = calm[kind].split() if " " in calm[kind] else list(calm[kind])
        words = [r.choice(words) for _ in range(r.randrange(20, 90))]
        at, yes = r.randrange(len(words)), k // 4 % 2
        if yes:
            words[at:at] = [r.choice(bad[kind])]
        texts.append((" " if kind in ("cyrillic", "latin") else "").join(words))
        labels.append(yes)
        kinds.append(kind)
    return texts, labels, kinds


def test_insults_in_any_script():
    texts, labels, _ = scripts(1, 640)
    model = abuse.train(texts, labels, steps=300)
    unseen, truth, kinds = scripts(2, 240)
    found = abuse.score_texts(model, pa.array(unseen)) >= model.threshold
    for kind in sorted(set(kinds)):
        here = np.array([k == kind for k in kinds])
        assert (found[here] == np.array(truth)[here]).mean() > 0.93, kind
