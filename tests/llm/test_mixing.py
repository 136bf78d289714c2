"""Problem 7: permutations, draws, packing and the whole mixture."""

import collections

import numpy as np
import pytest

from ledgerloom.llm import mixing


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 1000, 4097):
        for seed in (0, 5, -7):
            out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, seed))
            assert sorted(out) == list(range(n))
    a, b = (mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, s)) for s in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


@pytest.mark.parametrize("quota,slots,shards", [([10, 0, 5], 4, 4), ([1000, 10, 1], 100, 11), ([0], 3, 1)])
def test_draws_meet_quotas(quota, slots, shards):
    got = np.array(mixing.draw_counts(quota, slots, shards, 3))
    assert got.sum(0).tolist() == quota and (got.sum(1)[:-1] <= slots).all()


@pytest.fixture(scope="module")
def mixed(spark):
    docs, n = [], 0
    for source, count, words in (("Big-Source ", 300, 60), ("big_source", 100, 60), ("small", 12, 30), ("extra", 50, 40), (None, 20, 10)):
        for k in range(count):
            docs.append((n, " ".join(f"w{(n * 7 + j) % 97}" for j in range(words + k % 11)), source, 1, 2))
            n += 1
    docs += [(n, None, "small", 1, 2), (n + 1, "", "small", 1, 2), (n + 2, "long " * 20_000, "extra", 1, 2)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, block int, slot int")
    targets = spark.createDataFrame([("big source", 0.5, 1), ("SMALL", 0.2, 3), ("nowhere", 0.3, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    tokens = mixing.tokens_by_document(documents)
    return tokens, targets, mixing.mix_sources(tokens, targets, block_tokens=64, shard_slots=50), docs


def test_mixture_keeps_quotas_and_repeats(mixed):
    tokens, targets, mixture, _ = mixed
    sizes = {r.doc_id: r.n_tokens for r in tokens.collect()}
    rows = mixture.collect()
    total = sum(sizes.values())
    by_source = collections.Counter()
    uses = collections.Counter()
    for r in rows:
        by_source[r.source] += r.n_tokens
        for t in range(r.first_token, r.first_token + r.n_tokens):
            uses[r.doc_id, t] += 1
    small = sum(r.n_tokens for r in tokens.collect() if r.source == "small")
    assert abs(by_source["big_source"] - min(0.5 * total, sum(r.n_tokens for r in tokens.collect() if r.source == "big_source"))) <= 128
    assert by_source["small"] == 3 * small  # its target is beyond three passes
    limit = {"big_source": 1, "small": 3}
    assert all(uses[r.doc_id, r.first_token] <= limit[r.source] for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard, r.slot].append(r)
    for pieces in slots.values():  # a slot is one block without gaps
        assert len({(p.source, p.block, p["pass"]) for p in pieces}) == 1
        pieces.sort(key=lambda p: p.at)
        assert [p.at for p in pieces] == [sum(q.n_tokens for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p.n_tokens for p in pieces) <= 64
    for shard in {s for s, _ in slots}:
        mine = sorted(k for s, k in slots if s == shard)
        assert mine == list(range(len(mine)))


def test_shares_report(mixed):
    tokens, targets, mixture, _ = mixed
    got = {r.source: r for r in mixing.mixture_shares(tokens, targets, mixture).collect()}
    assert set(got) == {"big_source", "small", "nowhere"}
    assert got["nowhere"].used_tokens == 0 and got["nowhere"].actual_share == 0
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9 and got["small"].passes == 3


def test_blocks_hold_every_token_once(spark, mixed):
    tokens = mixed[0]
    held = collections.Counter()
    for r in mixing.pack_blocks(tokens, 64).collect():
        held[r.source, r.doc_id] += r.n_tokens
    assert held == {(r.source, r.doc_id): r.n_tokens for r in tokens.collect() if r.n_tokens and r.source}


def test_nothing_to_mix(spark, mixed):
    tokens, targets = mixed[0], mixed[1]
    assert mixing.mix_sources(tokens.limit(0), targets).count() == 0
    assert mixing.mix_sources(tokens, targets.limit(0)).count() == 0
    assert mixing.mixture_shares(tokens.limit(0), targets, mixing.mix_sources(tokens.limit(0), targets)).count() == 3


def test_blocks_hold_the_tokens_of_their_pieces(spark, mixed):
    _, targets, mixture, docs = mixed
    documents = spark.createDataFrame([(*d[:3], "x") for d in docs], "doc_id long, text string, source string, tokens string")
    want, encode = collections.defaultdict(list), mixing.encoder(mixing._ranks(mixing.VOCABULARY))
    for r in sorted(mixture.collect(), key=lambda r: r.at):
        want[r.shard, r.slot] += encode(docs[r.doc_id][1])[r.first_token : r.first_token + r.n_tokens]
    got = {(r.shard, r.slot): r.tokens for r in mixing.mix_blocks(mixing.tokens_by_document(documents, ids=True), targets, block_tokens=64, shard_slots=50).collect()}
    assert got == want


def test_blocks_hold_each_token_once_a_pass(spark):
    docs = [(k, " ".join(f"w{k}x{j}" for j in range(k % 40)), "s", ) for k in range(300)] + [(7, "same id again", "s"), (7, "same id again", "s"), (8, None, "s")]
    documents, targets = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([("s", 3.0, 2)], "source string, target_share double, max_repeats int")
    tokens = mixing.tokens_by_document(documents, ids=True)
    every = collections.Counter(int(t) for r in tokens.collect() for t in np.frombuffer(r.tokens, '<u2'))
    rows = mixing.mix_blocks(tokens, targets, block_tokens=64, shard_slots=7).collect()
    assert collections.Counter(t for r in rows for t in r.tokens) == {t: 2 * n for t, n in every.items()}
    assert max(collections.Counter(r.shard for r in rows).values()) == 7 and {len(r.tokens) for r in rows} <= {64, sum(every.values()) % 64}


def test_shards_in_many_groups(spark, mixed, monkeypatch):
    """Counts drawn in two steps: the same quotas, no shard over its size, however many there are."""
    tokens, targets, mixture, _ = mixed
    monkeypatch.setattr(mixing, "GROUP", 3)
    slots, names = mixing._slots(tokens, targets, 64, 5, 7)
    rows = slots.collect()
    size = lambda df: {r.source: r["count"] for r in df.groupBy("source").count().collect()}
    assert size(slots) == size(mixture.select("shard", "slot", "source").distinct())
    shards = collections.Counter(r.shard for r in rows)
    assert len(shards) > 6 and sorted(shards) == list(range(len(shards))) and set(shards.values()) <= {5, len(rows) % 5}
    assert len({(r.shard, r.slot) for r in rows}) == len({(r.source, r["pass"], r.block) for r in rows}) == len(rows)


def test_long_runs_of_blanks(monkeypatch):
    import tiktoken

    ranks = mixing._ranks(mixing.VOCABULARY)
    plain = tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    monkeypatch.setattr(mixing, "LONG_RUN", 5)
    encode, r = mixing.encoder(ranks), np.random.default_rng(0)
    for _ in range(300):
        text = "".join(r.choice([" ", " " * 9, "\n", "\n\n\n\n\n\n", " \n\t\u3000\x85 ", "\u2003" * 6, "a", "don't", "7", "!?", "\x1c", "字"], 12))
        assert encode(text) == plain(text)
    monkeypatch.setattr(mixing, "LONG_RUN", 100_000)
    encode = mixing.encoder(ranks)
    assert len(encode(" " * 2_000_000 + "x")) == 2_000_000 and len(encode("x" + "\n" * 2_000_001)) == 1_000_002 and encode(None) == encode("") == []


def test_token_counts_agree_with_the_tokenizer(mixed):
    encode = mixing.encoder(mixing._ranks(mixing.VOCABULARY))
    assert {r.doc_id: r.n_tokens for r in mixed[0].collect()} == {d[0]: len(encode(d[1])) for d in mixed[3]}
