"""Secret scans with a trigram inverted index (DataFrame functions only).

Each rule is a regular expression. From its parse tree a Boolean query is
derived: alternatives, each a set of trigrams that every match of that
alternative must contain. An inverted index (trigram, document) is built over
the lower-cased texts for the trigrams that any rule asks for; the postings of
an alternative are intersected, the alternatives united, and only the candidate
documents of a rule are searched with its expression. A rule without mandatory
trigrams searches every text.

A match's offsets are code points, end exclusive; matches of one rule are
leftmost and do not overlap. A rule may ask for a least length of the match or
of one group; matches that fail it are dropped after the search.

Defined results: a null text counts as empty; rows with null or repeated ids are
each searched; an empty table gives no rows; extra columns are ignored by
``find_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as _tree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.folds import free_prefix, same_columns


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str            # in the syntax that Java, Python and RE2 share
    min_length: int = 1     # code points of ``group``
    group: int = 0
    base: bool = True


# The base kinds in their order, then the added ones.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                   r"""([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),   # maximal runs, as with "+" and 24 characters asked for
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
)
MAX_ALTERNATIVES = 64
MAX_CLASS = 8
MASK = "[SECRET]"


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory lower-case trigrams; empty if some match needs none."""
    clauses = set()
    for parts in _expand(list(_tree.parse(pattern))):
        grams = {run[k:k + 3] for run in "".join(parts).lower().split("\0")
                 for k in range(len(run) - 2)}
        if not grams:
            return []
        clauses.add(frozenset(grams))
    # a clause that asks for more than another one is absorbed by it
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def _expand(items: list) -> list[list[str]]:
    """Strings whose literals every match has in order; ``\\0`` stands for anything."""
    found: list[list[str]] = [[]]
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            options = [[chr(value)]]
        elif name == "SUBPATTERN":
            options = _expand(list(value[-1]))
        elif name == "BRANCH":
            options = [x for branch in value[1] for x in _expand(list(branch))]
        elif name == "IN" and len(value) <= MAX_CLASS and all(str(o) == "LITERAL" for o, _ in value):
            options = [[chr(c)] for _, c in value]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = value
            once = _expand(list(body))
            if (low, high) == (0, 1):
                options = [[], *once]
            elif low and low == high and len(once) == 1:
                options = [once[0] * low]
            elif low:
                options = [[*x, "\0"] for x in once]
            else:
                options = [["\0"]]
        else:
            options = [["\0"]]
        if len(found) * len(options) > MAX_ALTERNATIVES:
            options = [["\0"]]
        found = [[*a, *b] for a in found for b in options]
    return found


def trigram_index(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Postings ``(trigram, doc_id)`` of the asked trigrams over the lower-cased texts."""
    lowered = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("t"))
    present = F.array_compact(F.array(*[
        F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in trigrams]))
    return lowered.select("doc_id", F.explode(present).alias("trigram"))


def candidates(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kinds``: the indexed rules whose trigram query the document satisfies."""
    clauses = [(rule.kind, n, gram, len(clause)) for rule in rules
               for n, clause in enumerate(trigram_query(rule.pattern)) for gram in sorted(clause)]
    if not clauses:
        return spark.createDataFrame([], "doc_id bigint, kinds array<string>")
    wanted = spark.createDataFrame(clauses, "kind string, clause int, trigram string, n int")
    postings = trigram_index(docs, sorted({c[2] for c in clauses}), doc_id, text)
    return (
        postings.join(F.broadcast(wanted), "trigram")   # a few rows per rule
        .groupBy("doc_id", "kind", "clause", "n").agg(F.collect_set("trigram").alias("seen"))
        .where(F.size("seen") == F.col("n"))
        .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    )


def _searched(docs: DataFrame, rules: tuple[Rule, ...], doc_id: str, text: str, own: str) -> DataFrame:
    """The documents with ``{own}text`` and ``{own}kinds`` (indexed rules to search them with)."""
    found = candidates(docs.sparkSession, docs, rules, doc_id, text).select(
        F.col("doc_id").alias(f"{own}id"), F.col("kinds").alias(f"{own}kinds"))
    return docs.join(found.hint("shuffle_hash"), docs[doc_id].eqNullSafe(F.col(f"{own}id")), "left").drop(
        f"{own}id").withColumn(f"{own}text", F.coalesce(F.col(text), F.lit("")))


def _pieces(rule: Rule, own: str) -> Column:
    """Array of (text before a match, match, the rule's group); the last one has the text after all.

    Null where the rule's expression need not be run on the row. The three searches are zipped, so
    that each runs once a row: an array named within a lambda would be built again per element.
    """
    text, rx = F.col(f"{own}text"), F.lit(rule.pattern)
    if trigram_query(rule.pattern):
        due = F.coalesce(F.array_contains(f"{own}kinds", rule.kind), F.lit(False))
    else:
        due = F.rlike(text, rx)
    return F.when(due, F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"), F.regexp_extract_all(text, rx, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, rx, F.lit(rule.group)).alias("group")))


_SPAN = "struct<start:int,rank:int,end:int,kind:string,size:int>"
_BLOCK = 256               # matches whose offsets are added up from one start


def _lengths(rule: Rule, own: str) -> Column:
    """Lengths (before, match, group) of the pieces, the group's null after the last match."""
    return F.transform(_pieces(rule, own), lambda piece: F.struct(
        F.length(piece["before"]).alias("before"), F.coalesce(F.length(piece["match"]), F.lit(0)).alias("match"),
        F.length(piece["group"]).alias("size")))


def _spans(rule: Rule, rank: int, lengths: str) -> Column:
    """Array of (start, rank, end, kind, size) of the matches from the column of ``_lengths``.

    An offset is its block's, added up over the pieces before, plus those before it in the block: for
    n matches n * _BLOCK / 2 + n * n / _BLOCK / 2 additions. (An accumulator that holds the spans is copied
    at every step.) The column is named more than once, so Catalyst keeps it as a column.
    """
    added = lambda some: F.aggregate(
        some, F.lit(0), lambda n, piece: n + piece["before"] + piece["match"])

    def block(k: Column) -> Column:
        return F.struct(added(F.slice(lengths, 1, k * _BLOCK)).alias("at"),
                        F.slice(lengths, k * _BLOCK + 1, _BLOCK).alias("pieces"))

    def placed(one: Column) -> Column:
        def span(piece: Column, k: Column) -> Column:
            start = one["at"] + added(F.slice(one["pieces"], 1, k)) + piece["before"]
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + piece["match"]).alias("end"),
                            F.lit(rule.kind).alias("kind"), piece["size"].alias("size"))
        return F.transform(one["pieces"], span)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), block)
    return F.when(F.col(lengths).isNotNull(), F.filter(
        F.flatten(F.transform(blocks, placed)), lambda s: F.coalesce(s["size"] >= rule.min_length, F.lit(False))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_<kind>`` of each base rule, ``base_sha256``, ``spans``.

    ``spans`` lists all matches as ``kind:start:end`` by start, then by the
    rules' order, comma-joined; ``base_sha256`` is the SHA-256 of that list for
    the base rules alone.
    """
    rows = _searched(docs.select(doc_id, text), rules, doc_id, text, "_own_")
    none = F.array().cast(f"array<{_SPAN}>")
    rows = rows.withColumns({f"_l_{rule.kind}": _lengths(rule, "_own_") for rule in rules})
    rows = rows.withColumns({f"_s_{rule.kind}": F.coalesce(_spans(rule, rank, f"_l_{rule.kind}"), none)
                             for rank, rule in enumerate(rules)})
    spans = lambda some: F.sort_array(F.concat(*[F.col(f"_s_{r.kind}") for r in some]))
    base = [r for r in rules if r.base]
    return rows.select(
        F.col(doc_id).alias("doc_id"),
        *[F.size(f"_s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(_joined(spans(base)), 256).alias("base_sha256"),
        _joined(spans(rules)).alias("spans"))


def _masked(rule: Rule, mask: str, own: str) -> Column:
    """The text with the rule's matches replaced; null where there is nothing to search."""
    def shown(piece: Column) -> Column:
        match = F.when(F.length(piece["group"]) >= rule.min_length, F.lit(mask)).otherwise(piece["match"])
        return F.concat(piece["before"], F.coalesce(match, F.lit("")))

    return F.array_join(F.transform(_pieces(rule, own), shown), "")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id",
                   text: str = "text", mask: str = MASK) -> DataFrame:
    """The rows with each match replaced by ``mask``, rule after rule; other columns unchanged.

    Null texts stay null.
    """
    own = free_prefix(docs)
    rows = _searched(docs, rules, doc_id, text, own)
    for rule in rules:
        rows = rows.withColumn(f"{own}text", F.coalesce(_masked(rule, mask, own), F.col(f"{own}text")))
    return same_columns(rows.withColumn(text, F.when(F.col(text).isNotNull(), F.col(f"{own}text"))), docs)
