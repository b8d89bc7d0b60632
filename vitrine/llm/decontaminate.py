"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A passage is a window of ``WINDOW`` consecutive item tokens (the whole item if shorter)
of which at least ``MIN_SHARE`` are equal, place by place, to consecutive tokens of the
document. A seed is a fixed mask over consecutive tokens: positions marked ``1`` are
hashed, positions marked ``0`` are ignored, so a substituted token under a ``0`` leaves
the hash unchanged. Test items and training documents are hashed under every mask, the
hashes are joined, and around each hit every window that contains it is counted.

The masks of ``SEEDS`` leave no passage out: wherever two of 11, 12 or 13 tokens are
substituted, one mask fits somewhere between them.

Tokens are the runs of letters and digits of the lower-cased text, compared by 64-bit
hashes.

Defined results: a null or empty text, or one with fewer than ``MIN_TOKENS`` tokens, has
no overlap; items with fewer hold no passage and match nothing; tokens of a window
beyond the document's ends count as different; an empty table gives no rows; repeated
rows of one id give one row per (document, item); extra columns are ignored. Rows
without id are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEEDS = ("111110001", "110100111", "110011011", "100111101")
WINDOW = 13             # tokens of the verified window
MIN_SHARE = 0.8         # share of equal tokens in it
MIN_TOKENS = 11         # of a document or an item
BROADCAST_SEEDS = 2_000_000   # item seeds, and ...
BROADCAST_BYTES = 100_000_000  # ... their bytes; beyond either Spark joins by shuffle


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"),
                                F.lit(0))


def _seed_hashes(words: str, at: str, masks: tuple[str, ...]) -> Column:
    return F.array(*[
        F.xxhash64(F.lit(n), *[F.get(words, F.col(at) + k) for k, bit in enumerate(mask) if bit == "1"])
        for n, mask in enumerate(masks)])


def _seeded(tokenized: DataFrame, keep: list[str], words: str, at: str,
            masks: tuple[str, ...], margin: int, least: int) -> DataFrame:
    """One row per token position and mask: ``keep``, the words, position and hash.

    The words become hashes with ``margin`` nulls before and after; positions count those.
    """
    span = len(masks[0])
    edge = F.array_repeat(F.lit(None).cast("bigint"), margin)
    size = F.size(words)
    return (
        tokenized.where(size >= least)
        .select(*keep, F.concat(edge, F.transform(words, lambda w: F.xxhash64(w)), edge).alias(words))
        .select(*keep, words, F.explode(F.sequence(F.lit(margin), size - margin - span)).alias(at))
        .select(*keep, words, at, F.explode(_seed_hashes(words, at, masks)).alias("seed"))
    )


def benchmark_overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id",
                       item_id: str = "item_id", text: str = "text",
                       masks: tuple[str, ...] = SEEDS, window: int = WINDOW,
                       min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS,
                       broadcast_seeds: int = BROADCAST_SEEDS,
                       broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verified overlaps: ``doc_id, item_id, n_match, n_window`` (longs).

    One row per document and item with a window of ``window`` item tokens (the
    whole item if shorter) that contains a seed hit and of which at least ``min_share``
    are equal in the document; ``n_match`` is the best count. With the default masks,
    window and share these are all such windows.

    What is joined is narrow: a seed goes with its id and the hashes of the few tokens
    that a window around it can reach, however long the item or the document is. The
    items' seeds are broadcast while they are at most ``broadcast_seeds`` rows and
    ``broadcast_bytes``; past that the same join runs by shuffle.
    """
    if len({len(m) for m in masks}) != 1:
        raise ValueError("masks must have one span")
    span = len(masks[0])
    if not span <= window <= 32:
        raise ValueError("a window has at least a mask's tokens and at most 32")
    margin = window - span          # a window reaches so far beyond a hit, to either side
    least = max(min_tokens, span)
    left = _seeded(docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("words"))
                   .where(F.col("doc_id").isNotNull()), ["doc_id"], "words", "at", masks, margin, least)
    right = _seeded(items.select(F.col(item_id).alias("item_id"), tokens(F.col(text)).alias("item"))
                    .where(F.col("item_id").isNotNull())
                    .withColumn("size", F.least(F.lit(window), F.size("item"))),
                    ["item_id", "size"], "item", "item_at", masks, margin, least)
    reach = span + 2 * margin
    near = lambda words, at: F.slice(words, F.col(at) - margin + 1, reach)
    right = right.select("item_id", "size", "seed", near("item", "item_at").alias("item"))
    seeds, names = right.agg(F.count("*"), F.sum(F.length(F.col("item_id").cast("string")))).first()
    if seeds <= broadcast_seeds and seeds * 8 * (reach + 8) + (names or 0) <= broadcast_bytes:
        right, first = F.broadcast(right), F.col("at") - margin     # texts stay where they are
    else:
        left, first = left.select("doc_id", "seed", near("words", "at").alias("words")), F.lit(0)
    # One bit per token around the hit. A window that leaves the item has no more equal
    # tokens than the one moved back inside, which contains the hit too.
    equal = sum((F.when(F.get("item", F.lit(k)) == F.get("words", first + k), F.lit(1 << k))
                 .otherwise(0).cast("bigint") for k in range(reach)), F.lit(0).cast("bigint"))
    counts = [F.bit_count(F.shiftright("equal", k).bitwiseAND(F.lit((1 << window) - 1)))
              for k in range(margin + 1)]
    hits = (left.join(right, "seed").select("doc_id", "item_id", "size", equal.alias("equal"))
            .select("doc_id", "item_id", "size", (F.greatest(*counts) if margin else counts[0])
                    .cast("long").alias("n")))
    enough = F.col("n") >= F.ceil(F.col("size") * F.lit(min_share))
    return (
        hits.groupBy("doc_id", "item_id")
        .agg(F.max(F.when(enough, F.col("n"))).alias("n_match"),
             F.max(F.when(enough, F.col("size"))).cast("long").alias("n_window"))
        .where(F.col("n_match").isNotNull())
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a verified overlap, with their columns unchanged.

    Documents without id stay: no overlap is attributed to them.
    """
    found = benchmark_overlaps(docs, items, **options).select(
        F.col("doc_id").alias("_leaked")).distinct()
    key = options.get("doc_id", "doc_id")
    return docs.join(found, docs[key] == found["_leaked"], "left_anti")
