"""Records of several sources combined so that each supplies its target share of all tokens.

Pfair scheduling: a source's records, in pseudo-random order and repeated as often as its share needs, form
a stream of tokens that is cut into blocks of equal size; a record may lie in several blocks. Block k of a
source with weight w is released at slot k / w and due by slot (k + 1) / w; taking the released block with
the earliest deadline at every slot keeps each source within less than one block of its share after any
token of the mix. Weights are the target shares, as whole numbers of slots in a period; after a period all
sources are exactly at their shares, so that the schedule repeats, and that of one period, of bounded
length, serves a mix of any size.

The records never gather anywhere: token counts are one scan, positions in a stream come from sums per
hash bucket and sums within a bucket, and each use of a record finds the slots of its blocks by itself.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom.session import checkpointed

#: Rank file of a public byte-level tokenizer, and the pattern that cuts texts for it; same on all workers.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this vocabulary was made with.
TOKENIZER_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a block; a mix of fewer than LEAST_SLOTS such blocks, or LEAST_BLOCKS of one source, has smaller ones.
BLOCK_TOKENS, LEAST_SLOTS, LEAST_BLOCKS = 2_048, 1_000, 10
#: Digits of a target share that count, and the most slots of a period. Shares that need a longer one are
#: rounded to whole slots of this many.
SHARE_DENOMINATOR, MAX_PERIOD = 1_000_000, 100_000
#: Sources with up to this much target share together may fall short, so that a tiny source does not
#: shrink the whole mix; 0 asks for exact shares of all sources that have records.
SHORT_SHARE = 0.15
#: Tokens per hash bucket within which positions are summed by one task.
BUCKET_TOKENS = 2_000_000
#: Most sources in a list of targets.
MAX_SOURCES = 100_000


def source_key(source: Column) -> Column:
    """A source's name without letter case, padding and the kind of its separators."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")


def token_counts(documents: DataFrame, tokenizer_path: str = TOKENIZER_PATH) -> DataFrame:
    """doc_id, source, tokens; ``source`` as of ``source_key``. A null text has 0 tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoder = tiktoken.Encoding("mix", pat_str=TOKENIZER_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(counts, pa.int64())], schema=schema)

    return documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").mapInArrow(kernel, "doc_id bigint, source string, tokens bigint")


@dataclass(frozen=True)
class Quota:
    """What one source supplies."""

    source: str
    target_share: float
    max_repeats: int
    documents: int
    available: int
    quota: int


def quotas(targets: list[tuple[str, float, int]], available: dict[str, tuple[int, int]], short_share: float = SHORT_SHARE) -> list[Quota]:
    """The tokens each source supplies.

    The mix is as large as the sources allow that must not fall short: those left after setting aside
    the scarcest ones of at most ``short_share`` together. A source supplies its share of that size or,
    if scarce, all it has ``max_repeats`` times. Shares are scaled to sum 1; sources without records, or
    with a share or repeats of 0 or less, supply nothing and neither bound the size nor use up ``short_share``.
    """
    wanted = {s: (max(w or 0.0, 0.0), max(r or 0, 0)) for s, w, r in targets}
    total = sum(w for w, _ in wanted.values())
    share = {s: w / total if total else 0.0 for s, (w, _) in wanted.items()}
    most = {s: available.get(s, (0, 0))[1] * r for s, (_, r) in wanted.items()}
    scarce, spared, size = 0.0, 0, 0.0
    for s in sorted((s for s in wanted if share[s] > 0 and most[s] > 0), key=lambda s: (most[s] / share[s], s)):
        size = most[s] / share[s]
        scarce += share[s]
        if scarce > short_share + 1e-12:
            break
        spared += 1
    return [Quota(s, share[s], wanted[s][1], *available.get(s, (0, 0)), min(most[s], math.floor(share[s] * size + 1e-9))) for s in sorted(wanted)]


def period(weights: dict[str, Fraction]) -> dict[str, int]:
    """Slots of each source in a period, in proportion to the weights; sources of weight 0 have none.

    Where the exact period is longer than MAX_PERIOD, slots are rounded by largest remainder, to one at least.
    """
    weights = {s: w for s, w in weights.items() if w > 0}
    if not weights:
        return {}
    scale = math.lcm(*(w.denominator for w in weights.values()))
    slots = {s: int(w * scale) for s, w in weights.items()}
    slots = {s: n // math.gcd(*slots.values()) for s, n in slots.items()}
    total = sum(slots.values())
    if total <= MAX_PERIOD:
        return slots
    exact = {s: Fraction(n * MAX_PERIOD, total) for s, n in slots.items()}
    rounded = {s: max(1, math.floor(x)) for s, x in exact.items()}
    left = MAX_PERIOD - sum(rounded.values())
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: max(0, left)]:
        rounded[s] += 1
    return rounded


def schedule(blocks: dict[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source's blocks: earliest deadline first among released blocks, one block a slot.

    Shares are those of the numbers of blocks, so that all blocks fit and none misses its deadline.
    """
    total = sum(blocks.values())
    waiting = [(0, s, 0) for s, n in sorted(blocks.items()) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = {s: np.zeros(n, np.int64) for s, n in blocks.items()}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // blocks[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out[s][k] = slot
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // blocks[s], s, k + 1))
    return out


@dataclass(frozen=True)
class Schedule:
    """The slots of one period, the size of a block and what each source supplies."""

    slots: dict[str, np.ndarray]
    length: int
    block: int
    quotas: list[Quota]

    def slot(self, source: str, block: np.ndarray) -> np.ndarray:
        """Slots of a source's blocks, in whichever period they lie."""
        own = self.slots[source]
        return block // len(own) * self.length + own[block % len(own)]


def planned(targets: list[tuple[str, float, int]], available: dict[str, tuple[int, int]], short_share: float) -> Schedule:
    """The schedule of a mix, and as quotas the whole blocks that each source supplies to it."""
    wished = quotas(targets, available, short_share)
    size = sum(q.quota for q in wished)
    largest = max((q.quota / q.target_share for q in wished if q.quota), default=0.0)
    # Sources that fall short count by the whole blocks they have, all others by their target.
    short = {q.source for q in wished if q.quota < math.floor(q.target_share * largest * (1 - 1e-9)) - 1}
    full = [q.quota for q in wished if q.quota and q.source not in short]
    block = max(1, min([BLOCK_TOKENS, size // LEAST_SLOTS, *(n // LEAST_BLOCKS for n in full)]))
    most = {q.source: q.available * q.max_repeats // block for q in wished}
    weights = {q.source: Fraction(q.target_share).limit_denominator(SHARE_DENOMINATOR) if q.quota else Fraction(0) for q in wished}
    weights |= {s: Fraction(most[s] * block, math.ceil(largest)) for s in short}
    slots = period(weights)
    length = sum(slots.values())
    # As many slots as every source can fill to the last one.
    n = min((most[s] * length // k for s, k in slots.items()), default=0)
    order = schedule(slots)
    blocks = {s: n // length * k + int(np.searchsorted(order[s], n % length)) for s, k in slots.items()}
    return Schedule(order, length, block, [Quota(q.source, q.target_share, q.max_repeats, q.documents, q.available, blocks.get(q.source, 0) * block) for q in wished])


def _plan(counts: DataFrame, targets: DataFrame, short_share: float) -> Schedule:
    listed = targets.where("source is not null").select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r"))
    merged = listed.groupBy("source").agg(F.sum(F.nanvl("w", F.lit(0.0))).alias("w"), F.max("r").alias("r")).limit(MAX_SOURCES + 1).collect()
    if len(merged) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    # One row per named source comes back, however many documents and other sources there are.
    named = listed.select("source").distinct()
    held = counts.where("tokens > 0").groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).join(named, "source", "left_semi").collect()
    return planned([(r["source"], r["w"], r["r"]) for r in merged], {r["source"]: (r["n"], r["t"]) for r in held}, short_share)


_SHARES = "source string, target_share double, max_repeats int, documents bigint, available bigint, quota bigint"


def _frame(spark: SparkSession, plan: list[Quota]) -> DataFrame:
    return spark.createDataFrame([(q.source, q.target_share, q.max_repeats, q.documents, q.available, q.quota) for q in plan], _SHARES)


def _copies(counts: DataFrame, plan: list[Quota]) -> DataFrame:
    """Every use of every document: doc_id, source, tokens (that count), repeat (from 1), start (its first token in the source's stream)."""
    spark = counts.sparkSession
    buckets = max(16, math.ceil(max((q.available for q in plan), default=0) / BUCKET_TOKENS))
    mixed = F.xxhash64("doc_id", F.lit(29))
    used = counts.where("tokens > 0 and doc_id is not null").join(F.broadcast(_frame(spark, plan)), "source")
    placed = used.withColumns({"order": mixed, "bucket": F.pmod(F.shiftright(mixed, 20), F.lit(buckets)).cast("int")})
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("before", F.sum("tokens").over(within) - F.col("tokens")).join(offsets, ["source", "bucket"])
    first = F.col("before") + F.col("offset")
    # A document is used in every pass over its source that starts before the quota is reached.
    passes = F.ceil((F.col("quota") - first) / F.col("available")).cast("int")
    taken = placed.where(first < F.col("quota")).withColumn("repeat", F.explode(F.sequence(F.lit(1), passes)))
    start = first + (F.col("repeat") - 1) * F.col("available")
    return taken.select("doc_id", "source", F.least("tokens", F.col("quota") - start).alias("tokens"), "repeat", start.alias("start"))


def _with_slots(plan: Schedule):
    piece = pa.struct([("slot", pa.int64()), ("tokens", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64()), ("repeat", pa.int32()), ("slot", pa.int64()), ("start", pa.int64()), ("pieces", pa.list_(piece))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, tokens = batch.column("start").to_numpy(), batch.column("tokens").to_numpy()
            first, last = start // plan.block, (start + tokens - 1) // plan.block
            n = last - first + 1
            row = np.repeat(np.arange(len(n)), n)
            bounds = np.append(0, np.cumsum(n))
            block = first[row] + np.arange(len(row)) - bounds[row]
            held = np.minimum((block + 1) * plan.block, (start + tokens)[row]) - np.maximum(block * plan.block, start[row])
            slot = np.zeros(len(row), np.int64)
            codes = batch.column("source").dictionary_encode()
            of = codes.indices.to_numpy()[row]
            for k, source in enumerate(codes.dictionary.to_pylist()):
                slot[of == k] = plan.slot(source, block[of == k])
            pieces = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(slot), pa.array(held, pa.int64())], fields=list(piece)))
            columns = [batch.column("doc_id"), batch.column("source"), batch.column("tokens"), batch.column("repeat"), pa.array(slot[bounds[:-1]]), batch.column("start"), pieces]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def mix(documents: DataFrame, targets: DataFrame, tokenizer_path: str = TOKENIZER_PATH, short_share: float = SHORT_SHARE) -> DataFrame:
    """The mix, a row per use of a document: doc_id, source, tokens, repeat, slot, start, pieces.

    ``pieces`` says how many of its tokens go to which slot, in order; ``slot`` is the first of them,
    ``start`` its place in the source's stream. The mix is its pieces in order of slot, then start; after
    any of their tokens each source is less than a block off its share. Of the document that ends a source's
    last block the tokens beyond do not count.

    Documents without text, tokens or id, and of sources that ``targets`` does not name, are left out;
    rows that repeat a document are documents of their own. Extra columns are dropped. Empty tables
    give an empty mix.
    """
    counts = checkpointed(token_counts(documents, tokenizer_path))
    plan = _plan(counts, targets, short_share)
    schema = "doc_id bigint, source string, tokens bigint, repeat int, slot bigint, start bigint, pieces array<struct<slot: bigint, tokens: bigint>>"
    return _copies(counts, plan.quotas).mapInArrow(_with_slots(plan), schema)


def mix_shares(documents: DataFrame, targets: DataFrame, tokenizer_path: str = TOKENIZER_PATH, short_share: float = SHORT_SHARE) -> DataFrame:
    """One row per named source: its target, what it has, what the mix takes and the share reached.

    Columns source, target_share, max_repeats, documents, available (tokens), quota (whole blocks), tokens
    (taken), uses (of documents), most_repeats, actual_share. A source that supplies nothing has zeros.
    """
    counts = checkpointed(token_counts(documents, tokenizer_path))
    plan = _plan(counts, targets, short_share).quotas
    taken = _copies(counts, plan).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.max("repeat").alias("most_repeats"))
    shares = _frame(counts.sparkSession, plan).join(taken, "source", "left")
    filled = shares.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("tokens", "uses", "most_repeats")})
    total = F.sum("tokens").over(Window.partitionBy())
    return filled.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), total.cast("double")), F.lit(0.0)))
