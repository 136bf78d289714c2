"""Mixing sources to target weights (problem 7).

The documents of a source, in pseudorandom order, are one stream of tokens packed into blocks of fixed length. Each output
shard draws how many of its slots each source gets (multinomially, from what is left of the sources' quotas). The slots of a source are
numbered through all shards; the number is mapped through a pseudorandom permutation of the source's blocks, a new one
for each pass over it. Slots and blocks are joined by that index. ``mix_blocks`` gives the tokens, ``mix_sources`` only names the pieces of documents.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage, tasks
from .sources import clean_source

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Longer runs of blanks are more than the pattern can look ahead through; they are encoded by themselves.
LONG_RUN = 100_000
#: What the pattern calls a blank.
BLANK = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Shards whose counts are drawn together, see ``_slots``.
GROUP = 256


def _ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(ranks: dict[bytes, int]) -> Callable[[str | None], list[int]]:
    """The token ids of a text (none of a null one); strings of special tokens are ordinary text.

    The pattern takes a run of blanks but for its last, which goes to the word behind it; so a long run is one piece whatever is around it.
    """
    import re

    import tiktoken

    coder = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = re.compile(f"{BLANK}{{{LONG_RUN},}}")

    def encode(text: str | None) -> list[int]:
        if not text or len(text) < LONG_RUN:
            return coder.encode_ordinary(text) if text else []
        out, at = [], 0
        for run in long.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += coder.encode_ordinary(text[at : run.start()]) + coder._encode_single_piece(text[run.start() : stop])
            at = stop
        return out + coder.encode_ordinary(text[at:])

    return encode


def count_tokens(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """The columns of ``documents`` but ``text``, with ``n_tokens`` of the whole text, and with ``ids`` the ``tokens`` themselves, packed into two bytes each (four
    for vocabularies beyond 65 536); null and empty texts have none. The vocabulary is read by the driver and sent to the workers (under 1 MB).
    """
    ranks = _ranks(vocabulary)
    shared, kind = documents.sparkSession.sparkContext.broadcast(ranks), "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"
    keep = [c for c in documents.columns if c != text]
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())]
    schema = T.StructType([documents.schema[c] for c in keep] + made[: 1 + ids])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = encoder(shared.value)
        for b in batches:
            for k, n in slices(b.column(len(keep))):
                part = b.slice(k, n)
                texts = part.column(len(keep)).to_pylist()
                if ids:
                    packed = [np.array(encode(t), kind).tobytes() for t in texts]
                    new = [pa.array([len(x) // np.dtype(kind).itemsize for x in packed], pa.int64()), pa.array(packed, pa.binary())]
                else:
                    new = [pa.array([len(encode(t)) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *new], names=schema.names)

    return documents.select(*keep, text).mapInArrow(run, schema)


def slices(texts, size: int = 8 << 20):
    """(first row, rows) of slices of an Arrow array of texts, of at most ``size`` bytes or one text."""
    import numpy as np
    import pyarrow.compute as pc

    n = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8"))
    k = 0
    while k < len(n):
        stop = max(k + 1, int(np.searchsorted(n, (n[k - 1] if k else 0) + size, side="right")))
        yield k, stop - k
        k = stop


def permute(index, size, seed):
    """Image of ``index`` under a pseudorandom permutation of ``range(size)``, one per seed; arrays of equal length.

    A four-round Feistel network over the next even number of bits; images outside the range walk on until inside.
    """
    import numpy as np

    size = np.maximum(np.asarray(size, "u8"), np.uint64(1))
    x, out = np.asarray(index, "u8").copy(), np.zeros(len(size), "u8")
    bits = np.ceil(np.log2(np.maximum(size, 2).astype("f8"))).astype("u8")
    half = (bits + np.uint64(1)) // np.uint64(2) + np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    seed = np.asarray(seed).astype("i8").view("u8")
    open_ = np.arange(len(size))
    with np.errstate(over="ignore"):
        while len(open_):
            h, m, s, v = half[open_], mask[open_], seed[open_], x[open_]
            left, right = v >> h, v & m
            for r in range(4):
                f = (right + s + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(31)
                f *= np.uint64(0x94D049BB133111EB)
                f ^= f >> np.uint64(29)
                left, right = right, (left ^ f) & m
            v = (left << h) | right
            x[open_] = v
            done = v < size[open_]
            out[open_[done]] = v[done]
            open_ = open_[~done]
    return out.astype("i8")


def _permuted(index: Column, size: Column, seed: Column) -> Column:
    def run(i: pd.Series, n: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(permute(i.to_numpy(), n.to_numpy(), s.to_numpy()))

    return F.pandas_udf(run, "long")(index, size, seed)


def draw_counts(quota: list[int], slots: int, shards: int, seed: int) -> list[list[int]]:
    """Blocks of each source in each shard: multinomial draws from what is left of ``quota``, so that all quotas are met in the end."""
    import numpy as np

    rng, left, out = np.random.default_rng(seed), np.array(quota, dtype="i8"), []
    for k in range(shards):
        want, got = min(slots, int(left.sum())), np.zeros(len(left), dtype="i8")
        if k == shards - 1:
            want = int(left.sum())
        while want > got.sum():
            rest = left - got
            got += np.minimum(rng.multinomial(want - got.sum(), rest / rest.sum()), rest)
        left -= got
        out.append(got.tolist())
    return out


def _targets(targets: DataFrame) -> DataFrame:
    one = targets.select(clean_source("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0")
    return one.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def tokens_by_document(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """Columns ``doc_id, source, n_tokens`` (and packed ``tokens`` with ``ids``) of all documents, written into the shared folder."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), clean_source(source).alias("source"), F.col(text).alias("text"))
    return stage(count_tokens(rows, "text", vocabulary, ids), "tokens")


def _slots(tokens: DataFrame, targets: DataFrame, block_tokens: int, shard_slots: int, seed: int) -> tuple[DataFrame, list[str]]:
    """Columns ``shard, source, pass, slot, block`` of all slots, and the sources that give any.

    Counts are drawn for groups of GROUP shards by the driver (one row a group: 500 million tokens at the usual sizes) and from these for the shards of each
    group by the executors, in the same way; no shard has more than ``shard_slots`` slots.
    """
    spark = tokens.sparkSession
    wanted = {r.source: r for r in _targets(targets).collect()}
    sums = tokens.select(F.when(F.col("source").isin(list(wanted)), F.col("source")).alias("source"), "n_tokens").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    have = {r.source: r.n or 0 for r in sums.collect()}
    total = sum(have.values())
    names = sorted(s for s in wanted if have.get(s))
    blocks = [-(-have[s] // block_tokens) for s in names]
    quota = [min(round(wanted[s].target_share * total / block_tokens), n * wanted[s].max_repeats) for s, n in zip(names, blocks, strict=True)]
    groups, used, plan = -(-sum(quota) // (GROUP * shard_slots)), [0] * len(names), []
    for k, counts in enumerate(draw_counts(quota, GROUP * shard_slots, groups, seed)):
        plan.append((k, counts, used))
        used = [a + n for a, n in zip(used, counts, strict=True)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for g in b.to_pylist():
                rows, used = [], g["used"]
                for k, counts in enumerate(draw_counts(g["counts"], shard_slots, -(-sum(g["counts"]) // shard_slots), seed + 1 + g["group"])):
                    before = 0
                    for s, n in enumerate(counts):
                        if n:
                            rows.append((g["group"] * GROUP + k, s, names[s], n, used[s], before, sum(counts), blocks[s]))
                            used[s], before = used[s] + n, before + n
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 2 else pa.int64()) for i, c in enumerate(cols)], names=["shard", "number", "source", "n", "used", "before", "slots", "blocks"])

    plan = spark.createDataFrame(plan, "group long, counts array<long>, used array<long>").repartition(tasks(spark), "group")
    plan = plan.mapInArrow(run, "shard long, number long, source string, n long, used long, before long, slots long, blocks long").repartition(tasks(spark), "shard", "source")
    slot = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    turn = F.col("used") + F.col("i")
    slot = slot.withColumns({"pass": F.floor(turn / F.col("blocks")).cast("int"), "_nth": F.pmod(turn, F.col("blocks"))})
    return slot.select(
        "shard", "source", "pass",
        _permuted(F.col("before") + F.col("i"), F.col("slots"), F.xxhash64(F.lit(seed), "shard")).alias("slot"),
        _permuted(F.col("_nth"), F.col("blocks"), F.xxhash64(F.lit(seed), "number", "pass")).alias("block"),
    ), names


def mix_sources(tokens: DataFrame, targets: DataFrame, block_tokens: int = 512, shard_slots: int = 4096, seed: int = 7) -> DataFrame:
    """One row per piece of a document in the mixture: ``shard, slot, source, block, pass, at, doc_id, first_token, n_tokens``.

    ``tokens`` comes from ``tokens_by_document``. Each source gets ``target_share`` of the tokens of all documents, but never more than
    ``max_repeats`` passes over its own; a source without tokens gives nothing. Quotas are rounded to whole blocks of
    ``block_tokens``; the last block of a source may be shorter. No document is used in more than ``max_repeats`` passes, each
    pass uses each token at most once. ``targets`` is a small settings table (one row per source), read by the driver.
    """
    slot, names = _slots(tokens, targets, block_tokens, shard_slots, seed)
    # the plan's few rows unfold into one per slot, which the planner can't foresee: never broadcast them
    pieces = pack_blocks(tokens.where(F.col("source").isin(names)), block_tokens, seed)
    return slot.hint("merge").join(pieces, ["source", "block"]).select("shard", "slot", "source", "block", "pass", "at", "doc_id", "first_token", "n_tokens")


def mix_blocks(tokens: DataFrame, targets: DataFrame, block_tokens: int = 512, shard_slots: int = 4096, seed: int = 7) -> DataFrame:
    """The mixture itself: ``shard, slot, source, block, pass, tokens``, one row per slot, with the token ids of its block (``block_tokens`` of them, fewer in the last
    block of a source). ``tokens`` comes from ``tokens_by_document(..., ids=True)``; slots and blocks are those of ``mix_sources``.
    """
    slot, names = _slots(tokens, targets, block_tokens, shard_slots, seed)
    pieces = pack_blocks(tokens.where(F.col("source").isin(names)), block_tokens, seed, ids=True)
    blocks = pieces.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("at", "n_tokens", "part"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(bytearray()), lambda done, x: F.concat(done, x["part"]))
    blocks = blocks.select("source", "block", F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["n_tokens"]).alias("n"), whole.alias("packed"))
    rows = slot.hint("merge").join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "pass", "n", "packed")
    names = ["shard", "slot", "source", "block", "pass"]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            n, packed = b.column(5).to_numpy(), b"".join(b.column(6).to_pylist())
            ids = np.frombuffer(packed, f"<u{len(packed) // max(1, int(n.sum()))}" if len(n) else "<u2").astype("i4")
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype("i4")), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), tokens], names=[*names, "tokens"])

    return rows.mapInArrow(run, schema)


def pack_blocks(tokens: DataFrame, block_tokens: int, seed: int = 7, ids: bool = False) -> DataFrame:
    """Columns ``source, block, at, doc_id, first_token, n_tokens`` (and ``part``, the packed tokens, with ``ids``): where each document's tokens lie in its source's blocks.

    The order is that of hash groups and hashes within them. Offsets are prefix sums in two steps, group totals first, so that
    no source is ever summed in one task. Documents without tokens or without source lie nowhere. A document is cut into its pieces in one step, which costs
    as much as it has tokens.
    """
    groups = 4 * tasks(tokens.sparkSession)
    own = ["tokens"] if ids else []
    rows = tokens.where("n_tokens > 0 AND source IS NOT NULL").select("source", "doc_id", "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("h"), *own)
    rows = rows.withColumn("group", F.pmod("h", F.lit(groups)).cast("int"))
    before = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("source", "group").agg(F.sum("n_tokens").alias("sum")).select("source", "group", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "group").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("until", F.sum("n_tokens").over(within)).join(bases, ["source", "group"])
    rows = rows.withColumn("start", F.col("base") + F.col("until") - F.col("n_tokens"))
    size = F.lit(block_tokens)
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n_tokens") - 1) / size)
    width = F.floor(F.octet_length("tokens") / F.col("n_tokens")).cast("int") if ids else None

    def piece(block: Column) -> Column:
        head, tail = F.greatest(F.col("start"), block * size), F.least(F.col("start") + F.col("n_tokens"), (block + 1) * size)
        part = [F.substring("tokens", width * (head - F.col("start")).cast("int") + 1, width * (tail - head).cast("int")).alias("part")] if ids else []
        return F.struct(block.alias("block"), (head - block * size).alias("at"), "doc_id", (head - F.col("start")).alias("first_token"), (tail - head).alias("n_tokens"), *part)

    return rows.select("source", F.inline(F.transform(F.sequence(first, last), piece)))


def mixture_shares(tokens: DataFrame, targets: DataFrame, mixture: DataFrame) -> DataFrame:
    """One row per target source: its target and actual share of the mixture, tokens wanted, available and used, passes used."""
    wanted = _targets(targets)
    total = F.coalesce(tokens.agg(F.sum("n_tokens")).scalar(), F.lit(0))
    have = tokens.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("used"), (F.max("pass") + 1).alias("passes"))
    out = wanted.join(have, "source", "left").join(used, "source", "left").withColumn("all_tokens", total)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    whole = Window.partitionBy(F.lit(1))  # one row per target source
    return out.select(
        "source", "target_share", "max_repeats", F.round(F.col("target_share") * F.col("all_tokens")).cast("long").alias("target_tokens"),
        number("available").alias("available_tokens"), number("used").alias("used_tokens"), number("passes").alias("passes"),
        F.coalesce(number("used") / F.sum(number("used")).over(whole), F.lit(0.0)).alias("actual_share"),
    )


def audit_mixture(tokens: DataFrame, targets: DataFrame, pieces: DataFrame, blocks: DataFrame, block_tokens: int = 512) -> DataFrame:
    """Columns ``fault, times``: how often ``pieces`` (of ``mix_sources``) and ``blocks`` (of ``mix_blocks``) break what they promise; a quota is met to a block."""
    pieces = stage(pieces, "pieces")
    wanted = _targets(targets)
    total = F.coalesce(tokens.agg(F.sum("n_tokens")).scalar(), F.lit(0))
    shares = mixture_shares(tokens, targets, pieces).withColumn("limit", F.least(F.round(F.col("target_share") * total), F.col("available_tokens") * F.col("max_repeats")))
    used = pieces.groupBy("doc_id", "source").agg(F.countDistinct("pass").alias("passes")).join(wanted, "source")
    slots = pieces.groupBy("shard", "slot").agg(F.sum("n_tokens").alias("n"))
    sizes = blocks.select("shard", "slot", F.size("tokens").alias("size"))
    both = slots.join(sizes, ["shard", "slot"], "full")
    # pieces of a document in a pass begin one behind the other; documents that repeat an id are told apart by their number
    copies = tokens.groupBy("doc_id", "source").agg(F.count("*").alias("copies"))
    twice = pieces.groupBy("doc_id", "source", "pass", "first_token").agg(F.count("*").alias("n")).join(copies, ["doc_id", "source"]).where("n > copies")
    over = block_tokens * F.greatest(F.col("max_repeats"), F.lit(1))
    faults = {
        "document in too many passes": used.where("passes > max_repeats"),
        "token twice in a pass": twice,
        "piece of a source that is no target": pieces.join(wanted, "source", "left_anti"),
        "source over its quota": shares.where(F.col("used_tokens") > F.col("limit") + over),
        "source under its quota": shares.where(F.col("used_tokens") < F.col("limit") - over),
        "slot without its block": both.where("n IS NULL OR size IS NULL"),
        "block of a wrong length": both.where((F.col("n") != F.col("size")) | (F.col("size") > block_tokens)),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("times")).select(F.lit(k).alias("fault"), "times") for k, df in faults.items()])
