"""Abusive, hateful or sexual content (problem 8).

A bidirectional gated recurrent network with attention pooling reads windows of words. Each word enters as its own vector
(if it was seen in training) and as the mean vector of its letter trigrams, after disguises of spelling are folded away.
Training is plain numpy: documents carry the labels, so the network learns from the windows of a document that
score highest. All overlapping windows of all texts are scored; a document's score is that of its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import hash_runs, lone_letters, lower_texts, parts_of, text_bytes

WINDOW, STRIDE, GRAMS = 24, 12, 4096
#: Bytes of text that a worker looks at in one go.
PART_BYTES = 4 << 20
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = str.maketrans("авеѕіјкмнорстухԁɡοαερυκν", "abesijkmhopctyxdgoaepukv")
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Letters that may follow the digits of a number.
UNITS = frozenset(b"s ms us ns m h d w k b g x st nd rd th kb mb gb tb kib mib gib px pt em rem pc mm cm km kg hz khz mhz ghz".split())
#: Most letters of a word; longer runs are cut into overlapping pieces.
LETTERS = 20
NUMBER, LONG = 1, 2  # hashes of all numbers and of all runs of encoded data


def cut_runs(data, inside, lead, starts, h, length, letters, first):
    """Runs of more than LETTERS letters (hashes above LONG) become pieces of LETTERS letters, each half over the one before, so that no word
    of half that length is cut in all of them."""
    import numpy as np

    half = LETTERS // 2
    count = np.where((letters > LETTERS) & (h > LONG), -(-(letters - half) // half), 1)
    run = np.repeat(np.arange(len(starts)), count)
    cut = np.flatnonzero(count[run] > 1)
    if not len(cut):
        return h, starts, length, first
    end = (starts + length)[run]
    k = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    places = np.append(np.flatnonzero(inside & lead), len(data))
    at = np.searchsorted(places, starts)[run[cut]] + half * k[cut]
    h, starts, length, first = h[run], starts[run], length[run], np.append(0, np.cumsum(count))[first]
    starts[cut] = np.where(k[cut] > 0, places[at], starts[cut])
    length[cut] = np.minimum(places[np.minimum(at + LETTERS, len(places) - 1)], end[cut]) - starts[cut]
    pieces = np.frombuffer(b" ".join(data[a : a + n].tobytes() for a, n in zip(starts[cut], length[cut], strict=True)), "u1")
    h[cut] = hash_runs(pieces, pieces != 32, np.array([0, len(pieces)]))[1]
    return h, starts, length, first


def fold_words(texts):
    """Words with disguises folded: (hash of each word, start and length of each in ``data``, words before each text, ``data``).

    Lower case; look-alike letters and stand-in signs become letters; hyphens within a word, single blanks (dots, low lines) between
    single letters and letters beyond the first of three or more equal ones go; stars within a word become one star. A run of digits, also with
    a unit behind or a dollar before them, is a number, and so is a hexadecimal id: twelve or more hexadecimal digits, or seven if one of them is a
    figure that stands for no letter. All else with digits is a word. An ASCII run of over LETTERS letters
    that changes often between letters and digits, some standing for no letter, is encoded data. Of neighbouring numbers, and of encoded runs, one
    stands for all, with length 0. Other runs of over LETTERS letters come in overlapping pieces; each letter of a script without blanks is a word.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    t = lower_texts(texts)
    foreign = np.flatnonzero(pc.match_substring_regex(t, r"[\x{0250}-\x{052f}\x{ff01}-\x{ff5e}]").to_numpy(zero_copy_only=False))
    if len(foreign):
        mask = np.zeros(len(t), dtype=bool)
        mask[foreign] = True
        wide = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
        mend = [x.translate(LOOKALIKES).translate(wide).lower() for x in t.take(pa.array(foreign)).to_pylist()]
        t = pc.replace_with_mask(t, pa.array(mask), pa.array(mend, pa.large_string()))
        t = t.combine_chunks() if isinstance(t, pa.ChunkedArray) else t
    data, offsets = text_bytes(t)
    if not len(data):
        z = np.zeros(0, "i8")
        return z.astype("u8"), z, z, np.zeros(len(t) + 1, "i8"), data
    fold, digit = np.arange(256, dtype="u1"), np.zeros(256, dtype=bool)
    digit[[*b"0123456789"]] = True
    for a, b in STAND_INS.items():
        fold[ord(a)] = ord(b)
    letter = np.zeros(256, dtype=bool)
    letter[[*b"abcdefghijklmnopqrstuvwxyz0123456789@$", *range(128, 256)]] = True
    inside, drop = letter[data], np.zeros(len(data), dtype=bool)
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = data[1:] != data[:-1]
    edge[offsets[offsets < len(data)]] = True
    runs = np.flatnonzero(edge)
    sizes, heads = np.diff(runs), runs[:-1]
    for k in np.flatnonzero((sizes >= 3) & inside[heads] & ~digit[data[heads]]):
        drop[heads[k] + 1 : runs[k + 1]] = True
    # a hyphen or stars between letters
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    drop |= (data == 45) & before & after
    star = (data[heads] == 42) | (data[heads] == 35)
    tail = runs[1:] - 1
    star &= before[heads] & after[tail]
    for k in np.flatnonzero(star):
        inside[heads[k]] = True
        drop[heads[k] + 1 : runs[k + 1]] = True
    # blanks, dots or low lines between single letters, at least two of them
    lone = inside & ~np.append(False, inside[:-1]) & ~np.append(inside[1:], False) & (data < 128) & ~digit[data]
    joint = np.zeros(len(data), dtype=bool)
    joint[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 46) | (data[1:-1] == 95)) & lone[:-2] & lone[2:]
    twice = np.zeros(len(data), dtype=bool)
    twice[:-2] |= joint[2:]
    twice[2:] |= joint[:-2]
    drop |= joint & twice
    kept = np.append(0, np.cumsum(~drop))
    offsets, data, inside = kept[offsets], data[~drop], inside[~drop]
    digits, lead = digit[data] & inside, (data & 0xC0) != 0x80
    hexed = inside & (digits | ((data >= 97) & (data <= 102)))
    plain, raw = digits & (fold[data] == data), data
    data = fold[data]
    data[data == 35] = 42
    starts, h, first = hash_runs(data, inside, offsets, lone_letters(data))
    if not len(starts):
        return h, starts, starts, first, data
    length = np.add.reduceat(inside.astype("i4"), starts)
    figures = np.add.reduceat(digits.astype("i4"), starts)
    hexes = np.add.reduceat(hexed.astype("i4"), starts)
    plains = np.add.reduceat(plain.astype("i4"), starts)
    h[(figures == length) | ((figures == length - 1) & (raw[starts] == 36))] = NUMBER
    h[(hexes == length) & (figures > 0) & ((length >= 12) | ((length >= 7) & (plains > 0)))] = NUMBER
    so_far, tail = np.append(0, np.cumsum(digits)), length - figures
    for k in np.flatnonzero((2 * figures >= length) & (tail > 0) & (tail <= 3) & (so_far[starts + figures] - so_far[starts] == figures)):
        if raw[starts[k] + figures[k] : starts[k] + length[k]].tobytes() in UNITS:
            h[k] = NUMBER
    letters = np.add.reduceat((inside & lead).astype("i4"), starts)
    turns = np.append(False, digits[1:] != digits[:-1]) & inside
    turns[starts] = False
    h[(letters > LETTERS) & (letters == length) & (plains > 0) & (5 * np.add.reduceat(turns.astype("i4"), starts) >= length)] = LONG
    again = np.append(False, (h[1:] == h[:-1]) & (h[1:] <= LONG))
    again[first[:-1][first[:-1] < len(h)]] = False
    first = np.append(0, np.cumsum(~again))[first]
    h, starts, length, letters = h[~again], starts[~again], length[~again], letters[~again]
    length[h <= LONG] = 0  # they stand for many runs and have no letters of their own
    h, starts, length, first = cut_runs(data, inside, lead, starts, h, length, letters, first)
    return h, starts, length, first, data


def trigrams(data, starts, length):
    """Hashed letter trigrams of words, ends marked: (word number, bucket) of each."""
    import numpy as np

    n = np.minimum(length, 4 * LETTERS).astype("i8")
    word = np.repeat(np.arange(len(starts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = starts[word] + at
    here = data[pos].astype("u4")
    prev = np.where(at > 0, data[np.maximum(pos - 1, 0)], 1).astype("u4")
    then = np.where(at < n[word] - 1, data[np.minimum(pos + 1, len(data) - 1)], 2).astype("u4")
    g = ((prev * np.uint32(0x9E3779B1)) ^ (here * np.uint32(0x85EBCA6B)) ^ (then * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    return word, (g >> np.uint32(15)) % np.uint32(GRAMS)


def windows_of(first):
    """(text, first word, word behind the last) of all windows: every STRIDE words, at least one for each text with words."""
    import numpy as np

    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][text] + k * STRIDE
    return text, begin, np.minimum(begin + WINDOW, first[1:][text])


@dataclass
class Model:
    """Parameters by name, and the sorted hashes of the words that have their own vector (number 0: all others)."""

    p: dict
    vocabulary: object
    threshold: float = 0.5

    def number(self, h):
        import numpy as np

        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def new_model(vocabulary, hidden: int = 16, word: int = 16, char: int = 16, attention: int = 12, seed: int = 1) -> Model:
    import numpy as np

    rng = np.random.default_rng(seed)
    small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype("f4")
    p = {"word": (0.1 * rng.standard_normal((len(vocabulary) + 1, word))).astype("f4"), "char": (0.3 * rng.standard_normal((GRAMS, char))).astype("f4")}
    for d in "fb":
        p |= {f"w{d}": small(word + char, 3 * hidden), f"c{d}": np.zeros(3 * hidden, "f4"), f"u{d}": small(hidden, 3 * hidden)}
    p |= {"a": small(2 * hidden, attention), "ab": np.zeros(attention, "f4"), "v": small(attention), "o": small(2 * hidden), "ob": np.zeros(1, "f4")}
    return Model(p, vocabulary)


def _sigmoid(x):
    import numpy as np

    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _recur(g, u, back: bool, keep: bool):
    """Hidden states of one direction, and with ``keep`` what ``_recur_back`` needs; ``g``: inputs (step, window, 3 x hidden) already projected."""
    import numpy as np

    steps, n, width = g.shape
    d = width // 3
    h, out = np.zeros((n, d), "f4"), np.empty((steps, n, d), "f4")
    was, zr, q, c = (np.empty((steps, n, k), "f4") for k in (d, 2 * d, d, d)) if keep else (None,) * 4
    for t in range(steps - 1, -1, -1) if back else range(steps):
        m = h @ u
        gate = _sigmoid(g[t, :, : 2 * d] + m[:, : 2 * d])
        z, new = gate[:, :d], m[:, 2 * d :]
        if keep:
            was[t], zr[t], q[t] = h, gate, new
        new = np.tanh(g[t, :, 2 * d :] + gate[:, d:] * new)
        if keep:
            c[t] = new
        h = new + z * (h - new)
        out[t] = h
    return out, (was, zr, q, c)


def _recur_back(dout, u, cache, back: bool):
    """Gradients of the inputs and of ``u``; all that doesn't hang on the step before is done for all steps at once."""
    import numpy as np

    was, zr, q, c = cache
    steps, n, d = was.shape
    z, r = zr[:, :, :d], zr[:, :, d:]
    by_c, by_z, by_r = (1 - z) * (1 - c * c), (was - c) * z * (1 - z), q * r * (1 - r)
    dg, dm, dh, turned = np.empty((steps, n, 3 * d), "f4"), np.empty((steps, n, 3 * d), "f4"), np.zeros((n, d), "f4"), np.ascontiguousarray(u.T)
    for t in range(steps) if back else range(steps - 1, -1, -1):
        dh += dout[t]
        dc = dh * by_c[t]
        np.multiply(dh, by_z[t], out=dg[t, :, :d])
        np.multiply(dc, by_r[t], out=dg[t, :, d : 2 * d])
        dg[t, :, 2 * d :] = dc
        dm[t, :, : 2 * d] = dg[t, :, : 2 * d]
        np.multiply(dc, r[t], out=dm[t, :, 2 * d :])
        dh = dh * z[t] + dm[t] @ turned
    return dg, was.reshape(-1, d).T @ dm.reshape(-1, 3 * d)


def _attend(p, h, mask, keep: bool):
    """Logits of windows from states ``h`` (step, window, 2 x hidden)."""
    import numpy as np

    k = np.tanh(h @ p["a"] + p["ab"])
    e = np.where(mask, k @ p["v"], np.float32(-30))
    e = np.exp(e - e.max(axis=0))
    a = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnd->nd", a, h)
    logit = pooled @ p["o"] + p["ob"][0]
    return (logit, (k, a, pooled)) if keep else (logit, None)


def word_inputs(model: Model, number, data, starts, length):
    """Input vectors of words: own vector beside the mean of the trigram vectors."""
    import numpy as np

    p = model.p
    word, gram = trigrams(data, starts, length)
    chars = np.zeros((len(starts), p["char"].shape[1]), "f4")
    if len(word):
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        chars[word[begin]] = np.add.reduceat(p["char"][gram], begin, axis=0) / np.diff(np.append(begin, len(word)))[:, None]
    return np.concatenate([p["word"][number], chars], axis=1)


def score_texts(model: Model, texts, block: int = 8192):
    """Score in 0..1 of each text of an Arrow array: the highest of all its windows; 0 for null texts and texts without words."""
    import numpy as np

    p = model.p
    h, starts, length, first, data = fold_words(texts)
    scores = np.zeros(len(texts), "f4")
    if not len(h):
        return scores
    known, where, of = np.unique(h, return_index=True, return_inverse=True)
    x = word_inputs(model, model.number(known), data, starts[where], length[where])
    x = np.concatenate([x, np.zeros((1, x.shape[1]), "f4")])  # the last stands for the place behind a text's end
    forth, back = x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"]
    of = np.append(of, len(known)).astype("i4")
    text, begin, end = windows_of(first)
    for k in range(0, len(text), block):
        at = begin[k : k + block][None, :] + np.arange(WINDOW)[:, None]
        mask = at < end[k : k + block]
        w = of[np.where(mask, at, len(of) - 1)]
        states = np.concatenate([_recur(forth[w], p["uf"], False, False)[0], _recur(back[w], p["ub"], True, False)[0]], axis=2)
        logit, _ = _attend(p, states, mask, False)
        np.maximum.at(scores, text[k : k + block], _sigmoid(logit))
    return scores


def _score_cut(model: Model, segments):
    """Score of one text that comes in segments: every two neighbours are joined at the seam, so no window is lost."""
    import numpy as np
    import pyarrow as pa

    parts = segments.to_pylist()
    seams = [" ".join([*a[-8192:].split()[-WINDOW:], *b[:8192].split()[:WINDOW]]) for a, b in zip(parts, parts[1:], strict=False)]
    best = max(float(score_texts(model, pa.array([x], pa.large_string()))[0]) for x in parts)
    return np.array([max(best, float(score_texts(model, pa.array(seams, pa.large_string())).max()) if seams else 0.0)], "f4")


class Trainer:
    """Adam on windows of labelled texts, with masked words so that letters and context must do as well."""

    def __init__(self, texts, labels, seed: int = 1, rate: float = 0.004) -> None:
        import numpy as np
        import pyarrow as pa

        self.labels, self.rng, self.rate = np.asarray(labels, "f4"), np.random.default_rng(seed), rate
        h, starts, length, first, data = fold_words(pa.array(texts, pa.string()))
        known, where, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        pairs = np.unique(of.astype("i8") * len(texts) + text_of)
        docs = np.bincount(pairs // max(1, len(texts)), minlength=len(known))
        self.model = new_model(known[docs >= 2] if (docs >= 2).any() else known[:1], seed=seed)
        self.number = self.model.number(known)
        word, gram = trigrams(data, starts[where], length[where])
        self.gram, self.gram_n = gram, np.bincount(word, minlength=len(known) + 1)
        self.gram_at = np.cumsum(self.gram_n) - self.gram_n
        self.number, self.of = np.append(self.number, 0), np.append(of, len(known))
        self.text, self.begin, self.end = windows_of(first)
        # how much each word speaks for labelled texts
        yes = self.labels[pairs % max(1, len(texts))] > 0.5
        a, b = (np.bincount(pairs[x] // max(1, len(texts)), minlength=len(known)) for x in (yes, ~yes))
        odds = np.log((a + 0.5) / (max(1, (self.labels > 0.5).sum()) + 1)) - np.log((b + 0.5) / (max(1, (self.labels <= 0.5).sum()) + 1))
        self.odds = np.append(np.where(a >= 2, np.maximum(odds, 0), 0), 0).astype("f4")
        self.m = {k: np.zeros_like(v) for k, v in self.model.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.model.p.items()}
        self.steps = 0

    def rows(self, windows):
        import numpy as np

        at = self.begin[windows][None, :] + np.arange(WINDOW)[:, None]
        mask = at < self.end[windows]
        return self.of[np.where(mask, at, len(self.of) - 1)], mask

    def inputs(self, w):
        """Unique words of ``w``, their place in it, their trigrams and whose each is, their number, and the mean vectors of the trigrams."""
        import numpy as np

        p = self.model.p
        there = np.zeros(len(self.number), dtype=bool)
        there[w] = True
        u, of = np.flatnonzero(there), (np.cumsum(there) - 1)[w]
        n = self.gram_n[u]
        whose = np.repeat(np.arange(len(u)), n)
        g = self.gram[(self.gram_at[u] - np.cumsum(n) + n)[whose] + np.arange(len(whose))]
        chars, some = np.zeros((len(u), p["char"].shape[1]), "f4"), np.flatnonzero(n)
        n = np.maximum(1, n)[:, None].astype("f4")
        if len(g):
            chars[some] = np.add.reduceat(p["char"][g], (np.cumsum(self.gram_n[u]) - self.gram_n[u])[some], axis=0) / n[some]
        return u, of, g, whose, n, chars

    def logits(self, windows, block: int = 4096):
        import numpy as np

        p, out = self.model.p, []
        for k in range(0, len(windows), block):
            w, mask = self.rows(windows[k : k + block])
            u, of, _, _, _, chars = self.inputs(w)
            x = np.concatenate([p["word"][self.number[u]], chars], 1)
            forth, back = x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"]
            states = np.concatenate([_recur(forth[of], p["uf"], False, False)[0], _recur(back[of], p["ub"], True, False)[0]], axis=2)
            out.append(_attend(p, states, mask, False)[0])
        return np.concatenate(out) if out else np.zeros(0, "f4")

    def step(self, windows, target, weight) -> float:
        import numpy as np

        p = self.model.p
        w, mask = self.rows(windows)
        u, of, g, whose, n, chars = self.inputs(w)
        number = self.number[u][of]
        number = np.where(self.rng.random(number.shape) < 0.25, 0, number)
        blank = self.rng.random(number.shape) < 0.05
        x = np.concatenate([p["word"][number], chars[of]], axis=2)
        x[blank] = 0
        hf, kf = _recur(x @ p["wf"] + p["cf"], p["uf"], False, True)
        hb, kb = _recur(x @ p["wb"] + p["cb"], p["ub"], True, True)
        states = np.concatenate([hf, hb], axis=2)
        logit, (k, a, pooled) = _attend(p, states, mask, True)
        prob = _sigmoid(logit)
        dlogit = ((prob - target) * weight / weight.sum()).astype("f4")
        d = hf.shape[2]
        grad = {"o": pooled.T @ dlogit, "ob": np.array([dlogit.sum()], "f4")}
        dpool = dlogit[:, None] * p["o"]
        da = np.einsum("tnd,nd->tn", states, dpool)
        de = a * (da - (a * da).sum(axis=0))
        dk = de[:, :, None] * p["v"] * (1 - k * k)
        grad["v"] = de.ravel() @ k.reshape(-1, k.shape[2])
        grad["a"], grad["ab"] = states.reshape(-1, 2 * d).T @ dk.reshape(-1, dk.shape[2]), dk.sum((0, 1))
        dstates = a[:, :, None] * dpool + dk @ p["a"].T
        dgf, grad["uf"] = _recur_back(dstates[:, :, :d], p["uf"], kf, False)
        dgb, grad["ub"] = _recur_back(dstates[:, :, d:], p["ub"], kb, True)
        flat = x.reshape(-1, x.shape[2])
        dx = np.zeros_like(flat)
        for name, dg in (("f", dgf), ("b", dgb)):
            dg = dg.reshape(len(flat), -1)
            grad["w" + name], grad["c" + name] = flat.T @ dg, dg.sum(0)
            dx += dg @ p["w" + name].T
        dx[blank.ravel()] = 0
        size = p["word"].shape[1]
        grad["word"] = _sum_rows(number.ravel(), dx[:, :size], len(p["word"]))
        dchars = _sum_rows(of.ravel(), dx[:, size:], len(u)) / n
        grad["char"] = _sum_rows(g, dchars[whose], GRAMS)
        self.steps += 1
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in grad.values()))
        scale = np.float32(min(1.0, 2.0 / (norm + 1e-9)))
        fix1, fix2 = 1 - 0.9**self.steps, 1 - 0.999**self.steps
        for name, v in grad.items():
            v *= scale
            m, s = self.m[name], self.s[name]
            m *= np.float32(0.9)
            m += np.float32(0.1) * v
            s *= np.float32(0.999)
            v *= v
            v *= np.float32(0.001)
            s += v
            np.sqrt(s, out=v)
            v *= np.float32(1 / np.sqrt(fix2))
            v += np.float32(1e-8)
            np.divide(m, v, out=v)
            v *= np.float32(self.rate / fix1)
            p[name] -= v
        return float(-(weight * (target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))).sum() / weight.sum())


def _sum_rows(index, values, size: int):
    """Sums of the rows of ``values`` by ``index``."""
    import numpy as np

    order = np.argsort(index.astype("u2") if size <= 1 << 16 else index, kind="stable")  # short numbers are sorted in no time
    i = index[order]
    begin = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, "i8")
    out = np.zeros((size, values.shape[1]), "f4")
    if len(i):
        out[i[begin]] = np.add.reduceat(values[order], begin, axis=0)
    return out


def _fit(texts: list[str], labels: list[int], steps: int, batch: int, rounds: int, seed: int) -> Model:
    """In each round the highest-scoring windows of positive texts are the positive examples (at first those whose words speak most for
    positive texts); negatives are windows of the other texts, half of them drawn among the
    highest-scoring ones, and windows of positive texts away from the best one.
    """
    import numpy as np

    t = Trainer(texts, labels, seed)
    rng, yes = t.rng, t.labels[t.text] > 0.5
    pos, neg = np.flatnonzero(yes), np.flatnonzero(~yes)
    w = np.zeros(len(t.text), "f4")
    for k in range(0, len(w), 8192):
        rows, mask = t.rows(np.arange(k, min(len(w), k + 8192)))
        top = np.sort(np.where(mask, t.odds[rows], 0), axis=0)[-8:]
        w[k : k + rows.shape[1]] = top.sum(0)
    for r in range(rounds):
        if r:
            w = t.logits(np.arange(len(t.text)))
        best = pos[np.lexsort((-w[pos], t.text[pos]))]
        best = best[np.append(True, t.text[best[1:]] != t.text[best[:-1]])]
        hard = neg[np.argsort(-w[neg])[: max(batch, len(best))]]
        # the rest of a positive text shares its names and style, not its fault
        top = np.zeros(int(t.text.max()) + 1, dtype="i8")
        top[t.text[best]] = best
        rest = pos[np.abs(pos - top[t.text[pos]]) > 2]
        mild = rest if r and len(rest) else neg
        for _ in range(steps // rounds):
            a = rng.choice(best, batch // 3)
            b = np.concatenate([rng.choice(hard, batch // 3), rng.choice(mild, batch // 6), rng.choice(neg, batch - 2 * (batch // 3) - batch // 6)])
            t.step(np.concatenate([a, b]), np.append(np.ones(len(a), "f4"), np.zeros(len(b), "f4")), np.ones(batch, "f4"))
        t.rate *= 0.7
    return t.model


def _held_out(texts: list[str], labels, half, k: int, steps: int, batch: int, rounds: int, seed: int):
    """Scores of the texts outside half ``k`` by a model of that half."""
    import numpy as np
    import pyarrow as pa

    here, there = np.flatnonzero(half == k), np.flatnonzero(half != k)
    if len(set(labels[here])) < 2:
        return labels[there].astype("f8")
    m = _fit([texts[i] for i in here], labels[here].tolist(), steps // 2, batch, max(2, rounds - 2), seed + 1 + k)
    parts = [score_texts(m, pa.array([texts[j] for j in there[i : i + 1000]], pa.string())) for i in range(0, len(there), 1000)]
    return np.concatenate([np.zeros(0), *parts]).astype("f8")


def train(texts: list[str], labels: list[int], steps: int = 700, batch: int = 256, rounds: int = 5, seed: int = 1, trust: float = 0.5, rarity: float = 5.0, spark: SparkSession | None = None) -> Model:
    """A model from texts with label 1 or 0. The number of steps, and so the cost, is fixed.

    Labels are sometimes wrong: first each half is scored by a model of the other half, and positive texts scored under ``trust`` are
    left out of the final training (unless that would be over a quarter of them, as with few labels). The same scores set the threshold: the one
    with the best F1 if a clean text counted ``rarity`` times, as the labelled sample holds more bad texts than a corpus. With ``spark``
    the halves are trained side by side on executors; the result is the same.
    """
    import numpy as np

    y = np.asarray(labels, dtype="i8")
    if not (y == 1).any() or not (y == 0).any():  # nothing to learn from: no case
        model = new_model(np.zeros(1, "u8"))
        model.threshold = 2.0
        return model
    half = np.random.default_rng(seed).permutation(len(y)) % 2
    score = np.zeros(len(y))
    setting = (steps, batch, rounds, seed)
    if spark is None:
        found = [_held_out(texts, y, half, k, *setting) for k in (0, 1)]
    else:
        shared = spark.sparkContext.broadcast((texts, y, half))  # the labelled sample, of bounded size

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for k in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([_held_out(*shared.value, k, *setting).tobytes()])], names=["half", "scores"])

        rows = {r.half: r.scores for r in spark.range(0, 2, 1, 2).mapInArrow(run, "half long, scores binary").collect()}
        found = [np.frombuffer(rows[k], "f8") for k in (0, 1)]
    for k in (0, 1):
        score[half != k] = found[k]
    use = (y == 0) | (score >= trust)
    if use[y == 1].mean() < 0.75:
        use[:] = True
    kept = np.flatnonzero(use)
    model = _fit([texts[i] for i in kept], [labels[i] for i in kept], steps, batch, rounds, seed)
    levels = np.arange(0.5, 0.96, 0.05)
    hit = np.array([(score[y == 1] >= t).sum() for t in levels])
    miss, wrong = (y == 1).sum() - hit, np.array([(score[y == 0] >= t).sum() for t in levels])
    f1 = 2 * hit / (2 * hit + miss + rarity * wrong + 1e-9)
    model.threshold = float(np.median(levels[f1 >= f1.max() - 0.002]))
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = 2000, most_chars: int = 20_000) -> DataFrame:
    """At most ``most`` documents labelled bad and twice as many others (``text, bad``), drawn by hash of their id, none of over
    ``most_chars`` characters.

    Labels of a document are decided by majority of its distinct annotators; ties, unknown categories and documents without
    text are left out. The sample bounds what the driver reads.
    """
    kind = F.lower(F.trim("category"))
    one = labels.where(kind.isin("abuse", "hate", "sexual", "none")).select("doc_id", "annotator", (kind != "none").alias("bad")).distinct()
    votes = one.groupBy("doc_id").agg(F.sum(F.when(F.col("bad"), 1).otherwise(-1)).alias("v")).where("v <> 0")
    drawn = [votes.where(w).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for w, n in (("v > 0", most), ("v < 0", 2 * most))]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # no more than 3 x ``most`` rows
    return documents.select("doc_id", "text").where(F.length("text") <= most_chars).join(ids, "doc_id").select("doc_id", "text", (F.col("v") > 0).cast("int").alias("bad"))


def train_on(documents: DataFrame, labels: DataFrame, most: int = 2000, **kw: object) -> Model:
    rows = sorted(labelled_sample(documents, labels, most).collect(), key=lambda r: r.doc_id)
    return train([r.text for r in rows], [r.bad for r in rows], spark=documents.sparkSession, **kw)


def abuse_scores(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns ``keep``, and ``score`` (0..1) of every document; null and empty texts have 0."""
    keep = ["doc_id", *(keep or [])]
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k, texts, cut in parts_of(b.column(len(keep)), 1000, PART_BYTES):
                s = _score_cut(model, texts) if cut else score_texts(model, texts)
                row = b.slice(k, len(s))
                yield pa.RecordBatch.from_arrays([*(row.column(i) for i in range(len(keep))), pa.array(s.astype("f8"))], names=[*keep, "score"])

    return documents.select(*keep, "text").mapInArrow(run, f"{fields}, score double")


def rates_by_source(scores: DataFrame, threshold: float) -> DataFrame:
    """Columns ``source, docs, bad, rate`` from scores with a ``source`` column; documents without source are counted under null."""
    one = scores.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("score") >= threshold).alias("bad"))
    return one.withColumn("rate", F.col("bad") / F.col("docs"))
