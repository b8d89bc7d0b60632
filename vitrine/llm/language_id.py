"""Language identification by prediction by partial matching (PPM).

For every language the bytes of its training texts are counted in a variable-order
context tree: a node is a context of up to ``ORDER`` preceding bytes that was seen
often enough. A byte that a context has not seen in the language costs an escape
(method C: distinct symbols over count plus distinct symbols) and is coded in the
next shorter context, finally uniformly over 256 bytes. With the statistics
frozen, the cost of every (context, byte) pair is fixed, and a text's exact code
length per language is the sum over all its bytes. The shortest code wins. Counts are
kept where they are not 0, for any number of languages; costs are derived from them for
the pairs that texts have, a few languages at a time. As contexts, bytes outside the
training texts are like the start of a text.

The tree is fitted on all labelled rows. Only for the choice of the contexts that become
nodes, a language with more than ``docs_per_language`` rows weighs as much as so many; all
its occurrences are counted. Every text is scored whole.

The shortest code only says which learned language is nearest. Whether a text is in it
at all is a matter of the code's length per byte: ``fit_limits`` learns from one half of
the rows how long the codes of the other half are, for beginnings of 8, 16, 32 ... bytes,
and ``keep_identified`` rejects texts with a longer code than that allows.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
ties go to the first language in alphabetical order; rows with null or repeated
ids are each scored; without any labelled row everything is ``und``; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrays import bounded_batches, chunks, segment_sums
from vitrine.llm.folds import held_out, positional
from vitrine.operators.materialize import discard, materialize

ORDER = 3
MIN_COUNT = 32             # weighted occurrences that make a context a node
MAX_NODES = 16384          # bound of the model's size: the most frequent contexts
DOCS_PER_LANGUAGE = 2000   # rows of a language that weigh in full in the choice of contexts
CHUNK_BYTES = 1 << 20
GRAMS_HELD = 1 << 20       # gram counts that a task adds up before it sends them
LANGUAGES_AT_ONCE = 8      # languages whose code lengths of a chunk's bytes are held together
TABLE_BYTES = 64 << 20     # of code lengths that a task keeps from chunk to chunk
FIRST_CLASS, CLASSES = 3, 21   # beginnings of 2^3 to 2^23 bytes have limits of their own
BINS = 64                  # of code length per byte, for one bit
SPREADS = 3                # limit: so often the way from the median to the 95 % quantile
LEAST_TEXTS = 30           # texts of one language that a limit is learned from
UNDETERMINED = "und"
_SCALE = 1_000_000


@dataclass(frozen=True)
class Sparse:
    """Rows of numbers by language; only those that are not 0 are kept."""

    bounds: np.ndarray
    language: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, row: np.ndarray, language: np.ndarray, value: np.ndarray, rows: int, languages: int
           ) -> Sparse:
        """Sums of ``value`` by row and language."""
        key, at = np.unique(row * languages + language, return_inverse=True)
        total = np.bincount(at, weights=value).astype(np.int64)
        return cls(np.searchsorted(key, np.arange(rows + 1) * languages),
                   (key % languages).astype(np.min_scalar_type(languages)),
                   total.astype(np.min_scalar_type(int(total.max(initial=0)))))

    def rows(self, row: np.ndarray, first: int, last: int) -> np.ndarray:
        """The rows' numbers of languages ``first`` to ``last``, zeros included."""
        sizes = self.bounds[row + 1] - self.bounds[row]
        of = np.repeat(np.arange(len(row)), sizes)
        at = np.repeat(self.bounds[row] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(of))
        language = self.language[at].astype(np.int64)
        use = (language >= first) & (language < last)
        out = np.zeros((len(row), last - first))
        out[of[use], language[use] - first] = self.value[at[use]]
        return out


@dataclass(frozen=True)
class ContextTree:
    languages: list[str]
    symbols: np.ndarray     # byte -> symbol; 0 for bytes outside the training texts
    child: np.ndarray       # (node, preceding symbol) -> longer context, or -1
    shorter: np.ndarray     # node -> the context it extends, or -1
    seen: Sparse            # cell (node * symbols + symbol) -> counts by language
    mass: Sparse            # node -> counts by language
    distinct: Sparse        # node -> symbols seen by language

    def lengths(self, cells: np.ndarray, first: int, last: int) -> np.ndarray:
        """(cell, language from first to last) -> code length, along the cells' contexts."""
        size = self.child.shape[1]
        symbol, path = cells % size, [cells // size]
        for _ in range(ORDER):
            path.append(np.where(path[-1] >= 0, self.shorter[path[-1]], -1))
        p = np.full((len(cells), last - first), 1 / 256)
        for node in reversed(path):
            at = np.flatnonzero(node >= 0)
            count = self.seen.rows(node[at] * size + symbol[at], first, last)
            mass, distinct = (t.rows(node[at], first, last) for t in (self.mass, self.distinct))
            q = np.where(count > 0, count, distinct * p[at]) / np.maximum(mass + distinct, 1)
            p[at] = np.where(mass > 0, q, p[at])
        return (-np.log2(p)).astype(np.float32)


def language_weights(rows: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """``lang, weight``: what an occurrence in the language counts, in millionths, when contexts are chosen.

    All rows of a language together weigh as much as ``docs_per_language`` rows at most, so that neither
    the input's size nor its largest language decides which contexts become nodes. One row per language,
    a small part of the model that tasks get anyway.
    """
    share = F.least(F.lit(1.0), docs_per_language / F.count(F.lit(1)))
    return rows.groupBy("lang").agg(F.greatest(F.lit(1), (share * _SCALE).cast("long")).alias("weight"))


def _preceding(data: np.ndarray, offsets: np.ndarray, distance: int) -> np.ndarray:
    """The value ``distance`` places before each one in its document; 0 before the start."""
    out = np.zeros_like(data)
    out[distance:] = data[:-distance] if distance < len(data) else 0
    for k in range(distance):
        at = offsets[:-1] + k
        out[at[at < offsets[1:]]] = 0
    return out


def _counted(names: dict[str, int], keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    lang = pa.DictionaryArray.from_arrays(pa.array((keys >> np.uint64(32)).astype(np.int32)),
                                          pa.array(list(names), pa.string()))
    return pa.RecordBatch.from_arrays(
        [lang.cast(pa.string()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)],
        names=["lang", "gram", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (three preceding bytes, byte) per language of the task's rows.

    They are added up in the task while there are few different ones; a longer text is taken in parts.
    """
    names: dict[str, int] = {}
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for rows, data, offsets in chunks(batches, "text", CHUNK_BYTES):
        lang = np.array([names.setdefault(name, len(names)) for name in rows.column("lang").to_pylist()],
                        np.uint64) << np.uint64(32)
        before = [_preceding(data, offsets, k) for k in range(1, ORDER + 1)]
        for low in range(0, len(data), CHUNK_BYTES):
            part = slice(low, low + CHUNK_BYTES)
            key = np.repeat(lang, np.diff(np.clip(offsets, low, low + CHUNK_BYTES))) | data[part]
            for k, values in enumerate(before, 1):
                key |= values[part].astype(np.uint64) << np.uint64(8 * k)
            for held, new in zip((keys, counts), np.unique(key, return_counts=True)):
                held.append(new)
            if sum(map(len, keys)) > GRAMS_HELD:
                merged, at = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
                keys, counts = [merged], [n]
                if 2 * len(merged) > GRAMS_HELD:
                    yield _counted(names, merged, n)
                    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    merged, at = np.unique(np.concatenate(keys), return_inverse=True)
    yield _counted(names, merged, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64))


def _contexts(first: int) -> Column:
    """The contexts of ``first`` to ``ORDER`` bytes of a gram, the nearest byte first."""
    paths, path = [F.lit(0).cast("long")], F.lit(0).cast("long")
    for k in range(1, ORDER + 1):
        path = F.shiftleft(path, 8).bitwiseOR(F.shiftright("gram", 8 * k).bitwiseAND(F.lit(255)))
        paths.append(path)
    return F.explode(F.array(*[F.struct(F.lit(k).alias("level"), paths[k].alias("path"))
                               for k in range(first, ORDER + 1)]))


def fit_context_tree(training: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE,
                     min_count: int = MIN_COUNT, max_nodes: int = MAX_NODES) -> ContextTree | None:
    """Fit on all rows with ``doc_id, text, lang``; None without a labelled, non-empty text.

    Spark counts the grams, chooses the contexts and adds up their cells; what reaches the driver
    is bounded by the model's size: at most ``max_nodes`` contexts, and their symbols by language.
    """
    rows = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    grams = materialize(bounded_batches(rows).mapInArrow(_count_grams, "lang string, gram bigint, n bigint")
                        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    # shorter contexts first; a context is not more frequent than its shorter one, so that one is a node too
    chosen = (grams.join(F.broadcast(language_weights(rows, docs_per_language)), "lang")
              .select(_contexts(1).alias("c"), (F.col("n") * F.col("weight")).alias("n"))
              .groupBy("c.level", "c.path").agg(F.sum("n").alias("n"))
              .where(F.col("n") >= min_count * _SCALE)
              .orderBy("level", F.desc("n"), "path").limit(max(0, max_nodes - 1)).toArrow())
    levels, paths = (np.append(0, chosen.column(c).to_numpy()).astype(np.int64) for c in ("level", "path"))
    order = np.lexsort((paths, levels))
    levels, paths = levels[order], paths[order]
    nodes = grams.sparkSession.createDataFrame(
        list(zip(levels.tolist(), paths.tolist(), range(len(paths)))), "level int, path long, node long")
    cells = (grams.select("lang", F.col("gram").bitwiseAND(F.lit(255)).alias("byte"), "n", _contexts(0).alias("c"))
             .select("lang", "byte", "n", "c.level", "c.path").join(F.broadcast(nodes), ["level", "path"])
             .groupBy("lang", "node", "byte").agg(F.sum("n").alias("n")).toArrow())
    discard(grams)
    if not cells.num_rows:
        return None
    names = cells.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    lang = np.searchsorted(languages, names.dictionary.to_pylist())[names.indices.to_numpy()]
    node, byte, n = (cells.column(c).to_numpy() for c in ("node", "byte", "n"))
    seen = np.unique(byte)
    symbols = np.zeros(256, np.int64)
    symbols[seen] = np.arange(1, len(seen) + 1)
    size, total = len(seen) + 1, len(languages)
    shorter = np.full(len(paths), -1, np.int64)
    child = np.full((len(paths), size), -1, np.int64)
    for k in range(1, ORDER + 1):
        longer, parents = np.flatnonzero(levels == k), np.flatnonzero(levels == k - 1)
        shorter[longer] = parents[np.searchsorted(paths[parents], paths[longer] >> 8)]
        child[shorter[longer], symbols[paths[longer] & 255]] = longer
    seen = Sparse.of(node * size + symbols[byte], lang, n, len(paths) * size, total)
    cell = np.repeat(np.arange(len(paths) * size), np.diff(seen.bounds))
    of = seen.language.astype(np.int64)
    return ContextTree(
        languages, symbols.astype(np.uint8 if size < 256 else np.int32), child.astype(np.int32),
        shorter, seen, Sparse.of(cell // size, of, seen.value, len(paths), total),
        Sparse.of(cell // size, of, np.ones(len(cell)), len(paths), total))


def _cells(tree: ContextTree, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The cell, a node and a symbol, that each byte is coded in."""
    symbol = tree.symbols[data]
    size = tree.child.shape[1]
    node = np.zeros(len(data), np.int32)
    open_ = np.ones(len(data), bool)
    for k in range(1, ORDER + 1):
        longer = tree.child.reshape(-1)[node * np.int32(size) + _preceding(symbol, offsets, k)]
        open_ &= longer >= 0
        node = np.where(open_, longer, node)
    return node * np.int32(size) + symbol


class Codes:
    """Code lengths of the cells a task has met, kept from chunk to chunk while they are few."""

    def __init__(self, tree: ContextTree):
        self.tree = tree
        self.clear()

    def clear(self) -> None:
        self.number = np.full(self.tree.child.size, -1, np.int32)
        self.table = np.zeros((0, len(self.tree.languages)), np.float32)

    def _new(self, cells: np.ndarray) -> np.ndarray:
        missing = np.zeros(len(self.number), bool)
        missing[cells] = True
        return np.flatnonzero(missing & (self.number < 0))

    def _lengths(self, cells: np.ndarray, first: int, last: int) -> np.ndarray:
        parts = np.split(cells, np.arange(1 << 15, len(cells), 1 << 15))
        return np.concatenate([self.tree.lengths(part, first, last) for part in parts])

    def parts(self, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first language, table of its and the next languages, row of the table per cell)."""
        total, new = len(self.tree.languages), self._new(cells)
        room = TABLE_BYTES // (4 * total)
        if len(self.table) + len(new) > room:
            self.clear()
            new = self._new(cells)
        whole = len(new) <= room
        self.number[new] = len(self.table) + np.arange(len(new))
        rows = self.number[cells]
        ranges = [(a, min(a + LANGUAGES_AT_ONCE, total)) for a in range(0, total, LANGUAGES_AT_ONCE)]
        if whole and len(new):
            self.table = np.concatenate([self.table, np.concatenate(
                [self._lengths(new, a, b) for a, b in ranges], axis=1)])
        for a, b in ranges:
            yield a, self.table[:, a:b] if whole else self._lengths(new, a, b), rows
        if not whole:
            self.clear()


def code_lengths(codes: Codes, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits that each document takes under each language's statistics."""
    out = np.zeros((len(offsets) - 1, len(codes.tree.languages)))
    for first, table, rows in codes.parts(_cells(codes.tree, data, offsets)):
        for low in range(0, max(len(rows), 1), CHUNK_BYTES):      # a longer text in parts
            sizes = np.diff(np.clip(offsets, low, low + CHUNK_BYTES))
            out[:, first:first + table.shape[1]] += segment_sums(table[rows[low:low + CHUNK_BYTES]], sizes)
    return out


def fit_limits(training: DataFrame, tree: ContextTree | None, docs_per_language: int = DOCS_PER_LANGUAGE,
               **fit) -> np.ndarray | None:
    """(language of the tree, class) -> highest code length per byte of texts in the language.

    Class ``k`` is for texts of 2^(k + FIRST_CLASS) bytes or more, the first one for shorter
    texts too. A second tree is learned from one half of the rows; the code lengths of all rows
    of the other half are counted in bins of 1 / BINS bit. The limit lies
    SPREADS times as far above their median as their 95 % quantile does, so that a few per
    cent of wrong labels do not move it. Without LEAST_TEXTS texts in a class, the limit of
    the next shorter class holds, and where there is none, no text is too long.
    """
    if tree is None:
        return None
    rows = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id").cast("string")), F.lit(2))
    other = fit_context_tree(rows.where(half == 0), docs_per_language, **fit)
    limits = np.full((len(tree.languages), CLASSES), np.inf)
    if other is None:
        return limits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(other)
        for rows_, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            longest = 1 << (CLASSES - 1 + FIRST_CLASS)      # no class looks beyond; such a text is alone
            data, offsets = data[:longest], np.minimum(offsets, longest)
            cells, sizes = _cells(other, data, offsets), np.diff(offsets)
            found = [np.zeros((0, 3), np.int64)]
            names = np.array(rows_.column("lang").to_pylist(), dtype=object)
            for first_, table_, at in codes.parts(cells):
                for number in range(first_, first_ + table_.shape[1]):
                    own = names == other.languages[number]
                    if not own.any():
                        continue
                    bits = table_[at[np.repeat(own, sizes)], number - first_]
                    total = np.concatenate(([0], np.cumsum(bits, dtype=np.float64)))
                    starts = np.cumsum(sizes[own]) - sizes[own]
                    for k in range(CLASSES):
                        size = 1 << (k + FIRST_CLASS)
                        first = starts[sizes[own] >= size]
                        rate = (total[first + size] - total[first]) / size
                        bins, n = np.unique(np.ceil(rate * BINS).astype(np.int64), return_counts=True)
                        found.append(np.stack([np.full(len(bins), number * CLASSES + k), bins, n], 1))
            table = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in table.T], names=["class", "bin", "n"])

    counted = (bounded_batches(rows).where(half == 1).select("text", "lang").mapInArrow(count, "class bigint, bin bigint, n bigint")
               .groupBy("class", "bin").agg(F.sum("n").alias("n")).orderBy("class", "bin").toArrow())
    kinds, bins, n = (counted.column(c).to_numpy() for c in ("class", "bin", "n"))
    for kind in np.unique(kinds):
        name = other.languages[kind // CLASSES]
        of = kinds == kind
        if name not in tree.languages or n[of].sum() < LEAST_TEXTS:
            continue
        share = np.cumsum(n[of]) / n[of].sum()
        middle, high = (bins[of][np.searchsorted(share, q)] / BINS for q in (0.5, 0.95))
        limits[tree.languages.index(name), kind % CLASSES] = middle + SPREADS * (high - middle + 1 / BINS)
    return np.minimum.accumulate(limits, axis=1)


def in_language(limits: np.ndarray, best: np.ndarray, bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the texts' codes in their best language are within its limits."""
    kind = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64) - FIRST_CLASS
    return bits <= limits[best, np.clip(kind, 0, CLASSES - 1)] * sizes


def score_languages(docs: DataFrame, tree: ContextTree | None, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``; the score is the posterior under equal priors."""
    plain = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                        F.coalesce(F.rlike(F.col(text), F.lit(r"\p{L}")), F.lit(False)).alias("letters"))
    if tree is None:
        return plain.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"),
                            F.lit(0.0).alias("score"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes = np.array([*tree.languages, UNDETERMINED], dtype=object), Codes(tree)
        for rows, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            nats = code_lengths(codes, data, offsets) * np.log(2)
            best = nats.argmin(1)
            posterior = 1 / np.exp(nats.min(1, keepdims=True) - nats).sum(1)
            letters = rows.column("letters").to_numpy(zero_copy_only=False)
            best = np.where(letters, best, len(tree.languages))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(names[best].tolist(), pa.string()),
                 pa.array(np.where(letters, posterior, 0.0))],
                names=["doc_id", "lang_pred", "score"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, tree: ContextTree | None, languages: list[str] | None = None,
                    min_score: float = 0.5, limits: np.ndarray | None = None) -> DataFrame:
    """The rows whose text is identified, as one of ``languages`` if given; columns unchanged.

    Rejected are undetermined texts, languages other than ``languages``, scores under
    ``min_score`` and, with ``limits``, texts whose code is too long for the language.
    """
    if tree is None:
        return docs.limit(0)
    plain, letters, text = positional(bounded_batches(docs)), "letters", f"c{docs.columns.index('text')}"
    marked = plain.withColumn(letters, F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False)))
    wanted = np.array([languages is None or name in languages for name in tree.languages])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(tree)
        for rows, data, offsets in chunks(batches, text, CHUNK_BYTES):
            bits = code_lengths(codes, data, offsets)
            nats, best = bits * np.log(2), bits.argmin(1)
            posterior = 1 / np.exp(nats.min(1, keepdims=True) - nats).sum(1)
            mask = (rows.column(letters).to_numpy(zero_copy_only=False) & wanted[best]
                    & (posterior >= min_score))
            if limits is not None:
                mask &= in_language(limits, best, bits.min(1), np.diff(offsets))
            yield rows.filter(pa.array(mask)).drop_columns([letters])

    return marked.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def identify_languages(docs: DataFrame, folds: int = 3, fold: int = 1, **fit) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict every row.

    Returns ``doc_id, held_out, lang_pred, score``.
    """
    out = held_out(F.col("doc_id"), folds, fold)
    tree = fit_context_tree(docs.where(~out), **fit)
    return score_languages(docs, tree).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score")
