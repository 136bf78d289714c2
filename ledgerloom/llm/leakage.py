"""Evaluation texts that leaked into training text (problem 6).

A distributed positional inverted index of the corpus: every shard of documents becomes one row with the posting lists (places) of all
its words, written once and asked by any number of item sets. Test items are the stated query set; they are broadcast in blocks of checked
size. In a shard the rarest terms of every stretch of an item are looked up first; documents that hold enough of them are kept. For these the
postings of the item's words, adjusted by the words' places in it, give exact phrases (equal adjusted places) and, in order and close
to each other, proximity matches.

Why nothing is lost: a passage of ``window`` or more words of an item, one in ``exchanged`` of them replaced, holds a passage of
at most ``2 * shortest - 1`` words (see ``Rule``); among any ``window / 2`` words in a row there are ``RARE`` of the terms looked up, more than can be exchanged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, stage, tasks
from .words import clean_texts, parts_of, words_of

#: Stock wording is in at least so many different items.
STOCK_TEXTS = 8
#: Bytes of text that a worker looks at in one go.
PART_BYTES = 8 << 20
#: How many of the rarest terms of each half window are looked up.
RARE = 4
#: Pairs are aligned in groups of at most so many cells.
CELLS = 4_000_000
#: Pairs with more repeated words than that are aligned one by one.
MANY = 5000
INDEX = "doc_ids binary, n_words binary, terms binary, ends binary, places binary"


@dataclass
class Rule:
    """What counts as a passage: ``window`` words of an item in order, one in ``exchanged`` differing, at most ``near`` words of the document
    between neighbouring repeated words. It begins and ends with a repeated word.

    A longer passage falls into stretches of ``shortest`` to ``longest`` words, one of which keeps the share; without the exchanged words at
    its ends it still has ``window`` words. So only passages of up to ``longest`` words have to be looked for, and they span ``span`` words of the document at most.
    """

    window: int = 24
    exchanged: int = 6
    near: int = 60
    shortest: int = field(init=False)
    longest: int = field(init=False)
    span: int = field(init=False)

    def __post_init__(self) -> None:
        n = self.window
        while n - n // self.exchanged < self.window:
            n += 1
        self.shortest, self.longest = n, 2 * n - 1
        self.span = self.longest * (self.near + 1)

    def least(self, cost: int) -> int:
        """The least score of a passage in which a repeated word counts 1 and an exchanged one -cost."""
        return min(n - (1 + cost) * (n // self.exchanged) for n in range(self.window, self.longest + 1))

    @property
    def rare(self) -> int:
        """How many looked-up words of a passage are repeated at least."""
        half = max(1, self.window // 2)
        return max(1, min(min(RARE, half) * (n // half) - n // self.exchanged for n in range(self.window, self.longest + 1)))


@dataclass
class Items:
    """The query set: the ids that share a text, its own words as term numbers, and the terms' hashes."""

    ids: list[list[int]]
    words: list
    terms: object


def read_items(rows: list, stock_words: int = 8, stock_share: float = 0.1, stock: set | None = None) -> Items:
    """Own words of the items: a run of ``stock_words`` words that more than ``stock_share`` of the different texts (and at least eight)
    contain is stock wording. ``stock`` gives the stock runs, if ``rows`` aren't all items.
    """
    import numpy as np
    import pyarrow as pa

    rows = [r for r in rows if r["text"]]
    _, _, h, n = words_of(clean_texts(pa.array([r["text"] for r in rows], pa.string())))
    texts = np.split(h, np.cumsum(n)[:-1]) if rows else []
    ids: dict[bytes, list] = defaultdict(list)
    for r, t in zip(rows, texts, strict=True):
        ids[t.tobytes()].append(r["item_id"])
    texts = [np.frombuffer(k, "u8") for k in ids]
    if stock is None:
        seen = defaultdict(int)
        for t in texts:
            for gram in {t[i : i + stock_words].tobytes() for i in range(len(t) - stock_words + 1)}:
                seen[gram] += 1
        limit = max(STOCK_TEXTS - 1, stock_share * len(texts))
        stock = {k for k, v in seen.items() if v > limit}
    own = []
    for t in texts:
        common = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - stock_words + 1):
            if t[i : i + stock_words].tobytes() in stock:
                common[i : i + stock_words] = True
        own.append(t[~common])
    terms = np.unique(np.concatenate(own)) if own else np.zeros(0, "u8")
    return Items(list(ids.values()), [np.searchsorted(terms, t).astype("i4") for t in own], terms)


def stock_runs(items: DataFrame, stock_words: int = 8, stock_share: float = 0.1) -> set:
    """The runs of words that count as stock wording, found over all items by Spark. Each is in over ``stock_share`` of the texts, so there are
    no more than 1 / ``stock_share`` times the words of an item on average."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            _, _, h, n = words_of(clean_texts(b.column(0)))
            for t in np.split(h, np.cumsum(n)[:-1]):
                grams = list({t[i : i + stock_words].tobytes() for i in range(len(t) - stock_words + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()] * len(grams), pa.binary()), pa.array(grams, pa.binary())], names=["words", "gram"])

    rows = items.where(F.length("text") > 0).select("text").mapInArrow(run, "words binary, gram binary").select(F.xxhash64("words").alias("words"), "gram").distinct()
    texts = rows.select("words").distinct().count()
    often = rows.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > max(STOCK_TEXTS - 1, stock_share * texts))
    return {bytes(r.gram) for r in often.select("gram").collect()}


def build_index(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_docs: int = 1000) -> DataFrame:
    """One row per shard (at most ``shard_docs`` documents): the sorted hashes of all its words, where the postings of each end, and the places
    (numbered through the shard's documents, stored as differences). Null and empty texts have no postings. Whole texts are indexed. Written into
    the shared folder once; every item set is asked of the same index.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).astype("i8")
            for k, texts, cut in parts_of(b.column(1), shard_docs, PART_BYTES):
                if cut:
                    found = [words_of(clean_texts(texts.slice(i, 1)))[2:] for i in range(len(texts))]
                    h, n = np.concatenate([x for x, _ in found]), np.array([sum(int(x.sum()) for _, x in found)], "i4")
                else:
                    _, _, h, n = words_of(clean_texts(texts))
                order = np.argsort(h, kind="stable")
                h = h[order]
                last = np.append(h[1:] != h[:-1], True) if len(h) else np.zeros(0, dtype=bool)
                row = [every[k : k + len(n)], n.astype("i8"), h[last], np.flatnonzero(last) + 1, np.diff(order, prepend=0).astype("i4")]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=[f.split()[0] for f in INDEX.split(", ")])

    rows = documents.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long"), text)
    return stage(rows.mapInArrow(run, INDEX), "postings")


def unpack(row: dict):
    """The arrays of an index row: document ids, words of each, terms, ends and places of their postings."""
    import numpy as np

    kinds = {"doc_ids": "i8", "n_words": "i8", "terms": "u8", "ends": "i8", "places": "i4"}
    out = [np.frombuffer(row[k], kind) for k, kind in kinds.items()]
    out[-1] = np.cumsum(out[-1], dtype="i8")
    return out


def _ranges(begin, count):
    """begin[0], begin[0] + 1, ... count[0] times, then the same for the others; and which one each belongs to."""
    import numpy as np

    of = np.repeat(np.arange(len(count)), count)
    return begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), of


def rare_words(flat, first, postings, rule: Rule):
    """Which words of the items (one behind the other in ``flat``, item k from ``first[k]`` on) are looked up: of any ``window / 2`` words in a
    row the ``RARE`` with the fewest postings. Items of less than ``window`` words have none."""
    import numpy as np
    from numpy.lib.stride_tricks import sliding_window_view

    half, out = max(1, rule.window // 2), np.zeros(len(flat), dtype=bool)
    long = np.flatnonzero(np.diff(first) >= rule.window)
    if not len(long):
        return out
    # word by word and no ties: the same terms are taken in overlapping stretches
    rank = np.empty(len(flat), "i8")
    rank[np.lexsort((flat, postings[flat]))] = np.arange(len(flat))
    heads, _ = _ranges(first[long], np.diff(first)[long] - half + 1)
    for part in np.array_split(heads, -(-len(heads) // 100_000)):
        top = np.argpartition(sliding_window_view(rank, half)[part], min(RARE, half) - 1, axis=1)[:, : min(RARE, half)]
        out[(part[:, None] + top).ravel()] = True
    return out


def enough_words(held, rule: Rule):
    """Rows of ``held`` (words of an item that a document holds anywhere, False behind the end) in which a passage could be, order aside."""
    import numpy as np

    if held.shape[1] < rule.window:
        return np.zeros(len(held), dtype=bool)
    score = np.zeros((len(held), held.shape[1] + 1), "i4")
    np.cumsum(np.where(held, 1, 1 - rule.exchanged), axis=1, out=score[:, 1:])
    low = np.minimum.accumulate(score, axis=1)
    return (score[:, rule.window :] >= low[:, : -rule.window]).any(axis=1)


def in_order(words, streams, rule: Rule, costs=(1, 2)):
    """Rows in which ``streams`` (term numbers in document order, -1 behind the end) repeat enough of ``words`` (-2 behind the end) in order, however
    far apart: local alignment in which other words of the document cost nothing and an exchanged word costs ``cost``."""
    import numpy as np

    alive = np.ones(len(words), dtype=bool)
    for cost in costs:
        at = np.flatnonzero(alive)
        w, s = words[at], streams[at]
        score, best = np.zeros((len(at), s.shape[1] + 1), "i4"), np.zeros(len(at), "i4")
        for i in range(w.shape[1]):
            hit = np.where(s == w[:, i, None], score[:, :-1] + 1, 0)
            score -= cost
            np.maximum(score, 0, out=score)
            np.maximum(score[:, 1:], hit, out=score[:, 1:])
            np.maximum.accumulate(score, axis=1, out=score)
            np.maximum(best, score[:, -1], out=best)
        alive[at] = best >= rule.least(cost)
    return alive


def repeated(stream, words):
    """All (place in ``stream``, place in ``words``) of equal terms, by place in the stream."""
    import numpy as np

    order = np.argsort(words, kind="stable")
    lo, hi = (np.searchsorted(words[order], stream, side=x) for x in ("left", "right"))
    at, of = _ranges(lo, hi - lo)
    return of, order[at]


def phrases(word, place, rule: Rule) -> bool:
    """Whether repeated words (``word``: place in the item, ``place``: in the document) form an unchanged phrase of ``window`` words."""
    import numpy as np

    order = np.lexsort((word, place - word))
    w, d = word[order], (place - word)[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1] + 1), [True]]))
    return len(w) > 0 and int(np.diff(new).max()) >= rule.window


def passages(hits: list, rule: Rule):
    """For each list of repeated words (arrays of their places in item and document, by place in the document) whether it holds a passage.

    For each repeated word: the most words of a passage that ends with it, by where in the item it begins (modulo ``ring``, as no passage is
    longer than ``longest`` and no gap in it longer than its exchanged words). Exact; the lists of a group go step by step together.
    """
    import numpy as np

    skip, found = rule.longest // rule.exchanged + 1, np.zeros(len(hits), dtype=bool)
    ring = rule.longest + skip
    count = np.array([len(w) for w, _ in hits], "i8")
    for k in np.flatnonzero(count > MANY):
        found[k] = _passage(*hits[k], rule)
    order = np.argsort(count, kind="stable")
    order = order[count[order] <= MANY]
    while len(order):
        size = max(1, min(len(order), CELLS // (ring * max(1, len(hits[order[-1]][0])))))
        group, order = order[-size:], order[:-size]
        m, b = max(len(hits[k][0]) for k in group), len(group)
        word, place = np.full((b, m), -1, "i8"), np.full((b, m), 1 << 40, "i8")
        for r, k in enumerate(group):
            word[r, : len(hits[k][0])], place[r, : len(hits[k][0])] = hits[k]
        starts, state, rows, low = np.arange(ring), np.zeros((b, m, ring), "i2"), np.arange(b), 0
        for j in range(m):
            i, p = word[:, j], place[:, j]
            live = i >= 0
            while low < j and not (place[live, low] >= p[live] - rule.near - 1).any():
                low += 1
            gap = i[:, None] - word[:, low:j]
            near = (gap > 0) & (gap <= skip) & (word[:, low:j] >= 0) & (place[:, low:j] < p[:, None]) & (place[:, low:j] >= p[:, None] - rule.near - 1)
            length = (i[:, None] - starts) % ring + 1
            best = np.where(near[:, :, None], state[:, low:j], 0).max(axis=1) if j > low else np.zeros((b, ring), "i2")
            best = np.where((best > 0) & (length <= rule.longest), best + 1, 0)
            best[rows, i % ring] = 1
            state[:, j] = best
            ok = (length >= rule.window) & (rule.exchanged * best.astype("i4") >= (rule.exchanged - 1) * length)
            found[group] |= ok.any(axis=1) & live
    return found


def _passage(word, place, rule: Rule) -> bool:
    """The same for one list, however long: a repeated word only looks at those of the few words before it in the item."""
    from collections import deque

    import numpy as np

    skip = rule.longest // rule.exchanged + 1
    ring, recent = rule.longest + skip, defaultdict(deque)
    starts = np.arange(ring)
    for i, p in zip(word.tolist(), place.tolist(), strict=True):
        best = np.zeros(ring, "i2")
        for j in range(max(0, i - skip), i):
            if j in recent:
                while recent[j] and recent[j][0][0] < p - rule.near - 1:
                    recent[j].popleft()
                for q, state in recent[j]:
                    if q < p:
                        np.maximum(best, state, out=best)
        length = (i - starts) % ring + 1
        best = np.where((best > 0) & (length <= rule.longest), best + 1, 0).astype("i2")
        best[i % ring] = 1
        recent[i].append((p, best))
        if ((length >= rule.window) & (rule.exchanged * best.astype("i4") >= (rule.exchanged - 1) * length)).any():
            return True
    return False


def _padded(rows: list, fill: int):
    import numpy as np

    out = np.full((len(rows), max(map(len, rows))), fill, "i4")
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _search(items: Items, rule: Rule):
    """The search of one shard: (document id, item number, whether as an unchanged phrase)."""
    import numpy as np

    flat = np.concatenate(items.words) if items.words else np.zeros(0, "i4")
    n_own = np.array([len(w) for w in items.words], "i8")
    first, total, longest = np.append(0, np.cumsum(n_own)), len(items.terms), int(n_own.max(initial=1))

    def run(row: dict):
        ids, n, terms, ends, places = unpack(row)
        if not len(terms) or not total:
            return []
        number = np.minimum(np.searchsorted(terms, items.terms), len(terms) - 1)
        has = terms[number] == items.terms
        begin = np.append(0, ends)[number]
        count = np.where(has, ends[number] - begin, 0)
        at, term = _ranges(begin, count)
        if not len(at):
            return []
        at = places[at]
        # long documents are looked at in pieces of two spans, each one span on: every passage lies within one
        start = np.append(0, np.cumsum(n))
        many = np.maximum(1, -(-n // rule.span) - 1)
        piece_of, base = np.append(0, np.cumsum(many)), start[:-1]
        doc = np.searchsorted(start, at, side="right") - 1
        quarter = (at - base[doc]) // rule.span
        pieces = [(q, (q >= 0) & (q < many[doc])) for q in (quarter, quarter - 1)]
        size = piece_of[-1]
        held = np.concatenate([term[ok] * size + (piece_of[doc] + q)[ok] for q, ok in pieces])
        held.sort(kind="stable")
        held = held[np.append(True, held[1:] != held[:-1])]  # which terms the pieces hold, by term
        edge = np.searchsorted(held, np.arange(total + 1) * size)
        rare = np.flatnonzero(rare_words(flat, first, count, rule))
        item, t = np.searchsorted(first, rare, side="right") - 1, flat[rare]
        stream = np.full(int(start[-1]), -1, "i4")
        stream[at] = term

        def candidates(rare_item, t):
            """Items and pieces that hold enough of the words looked up, and enough words at all."""
            which, of = _ranges(edge[t], edge[t + 1] - edge[t])
            pairs, counts = np.unique(rare_item[of] * size + held[which] % size, return_counts=True)
            pairs = pairs[counts >= rule.rare]
            k, piece = pairs // size, pairs % size
            for group in np.array_split(np.arange(len(k)), -(-len(k) * longest // CELLS)) if len(k) else []:
                own = _padded([items.words[i] for i in k[group]], -1)
                key = np.where(own >= 0, own * size + piece[group][:, None], -1)
                place = np.minimum(np.searchsorted(held, key), len(held) - 1)
                good = enough_words(held[place] == key, rule)
                yield k[group][good], piece[group][good]

        def compare(k, piece):
            out, todo, mark, last = [], [], np.zeros(total + 1, dtype=bool), -1
            for i, x in zip(k.tolist(), piece.tolist(), strict=True):
                if i != last:
                    mark[:] = False
                    mark[items.words[i]], last = True, i
                d = int(np.searchsorted(piece_of, x, side="right") - 1)
                a = int(base[d] + (x - piece_of[d]) * rule.span)
                s = stream[a : min(a + 2 * rule.span, int(start[d + 1]))]
                where = np.flatnonzero(mark[s])
                todo.append((d, i, s[where], where))
            todo.sort(key=lambda x: len(x[2]))
            while todo:
                step = max(1, CELLS // (4 * max(longest, len(todo[-1][2]))))
                group, todo = todo[-step:], todo[:-step]
                mine = in_order(_padded([items.words[i] for _, i, _, _ in group], -2), _padded([s for _, _, s, _ in group], -1), rule)
                rest, hits = [], []
                for (d, i, s, where), good in zip(group, mine, strict=True):
                    if not good:
                        continue
                    a, w = repeated(s, items.words[i])
                    if phrases(w, where[a], rule):
                        out.append((int(ids[d]), i, True))
                    else:
                        rest.append((d, i))
                        hits.append((w, where[a]))
                out += [(int(ids[d]), i, False) for (d, i), ok in zip(rest, passages(hits, rule), strict=True) if ok]
            return out

        # items are taken in groups whose words looked up have a bounded number of postings
        cost = np.cumsum(np.bincount(item, edge[t + 1] - edge[t], len(n_own)))[item] // CELLS if len(item) else np.zeros(0)
        cuts = np.flatnonzero(np.diff(cost, prepend=-1, append=-1)) if len(item) else []
        return [x for a, b in zip(cuts, cuts[1:], strict=False) for k, piece in candidates(item[a:b], t[a:b]) for x in compare(k, piece)]

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, window: int = 24, exchanged: int = 6, near: int = 60, max_items_bytes: int = BROADCAST_BYTES, index: DataFrame | None = None) -> DataFrame:
    """Columns ``doc_id, item_id, kind``: the document repeats in order at least ``window`` words of the item's own text, at most one in
    ``exchanged`` of them replaced, with at most ``near`` words of the document between neighbouring repeated ones. Layout, case, punctuation,
    markup and interposed lines do not matter; stock wording doesn't count. ``kind`` is ``phrase`` if ``window`` words in a row are unchanged, else ``proximity``.

    Null or empty texts on either side match nothing; an item stored under several ids is found under each. Repeated document ids
    give one row. Items are a query set: beyond ``max_items_bytes`` of text they are taken in blocks, drawn by hash of the id, each asked of the
    same index; stock wording is judged over all items. ``index``: one that ``build_index`` made of the documents.
    """
    rule = Rule(window, exchanged, near)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 if size <= max_items_bytes else 2 * -(-size // max_items_bytes)
    number = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    stock = stock_runs(items) if blocks > 1 else None
    index = build_index(documents) if index is None else index
    # a shard takes long for its few bytes: where its files make less tasks than there are to share, shards are dealt out one by one
    dealt = index if index.rdd.getNumPartitions() >= 4 * tasks(index.sparkSession) else index.repartition(max(tasks(index.sparkSession), -(-index.count() // 8)))
    found = [_ask(dealt, items.where(number == k) if blocks > 1 else items, rule, stock) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.min("kind").alias("kind"))


def _ask(index: DataFrame, items: DataFrame, rule: Rule, stock: set | None) -> DataFrame:
    asked = read_items(items.select("item_id", "text").collect(), stock=stock)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        search = _search(asked, rule)
        for b in batches:
            for k in range(b.num_rows):
                found = [(d, i, "phrase" if whole else "proximity") for d, n, whole in search(b.slice(k, 1).to_pylist()[0]) for i in asked.ids[n]]
                if found:
                    d, i, kind = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(kind, pa.string())], names=["doc_id", "item_id", "kind"])

    return index.mapInArrow(run, "doc_id long, item_id long, kind string")


def leaked_items(documents: DataFrame, items: DataFrame, **rule: object) -> DataFrame:
    """Columns ``doc_id, item_id`` of ``leaked_passages``."""
    return leaked_passages(documents, items, **rule).select("doc_id", "item_id")
