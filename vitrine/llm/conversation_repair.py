"""Conversation structure repair by Knuth's lightest derivations.

A conversation should read ``(s?(ua)+)?`` in initials of its roles, without blank, repeated or cut
turns. Every repair is a derivation: the item ``(p, i, q)`` says that the rows before ``i`` can be
edited so that the role grammar goes from state ``p`` to state ``q``; a deduction keeps, re-roles or
deletes row ``i``, or inserts a turn. Weights are pairs (cost, audit), compared in that order, where
the audit spells the edits. A deduction never makes a weight smaller, and of two derivations of one
item the lighter stays lighter however both are continued (of equally dear ones neither audit starts
the other, since their rows are the same and every inserted turn costs). So the agenda may pop items
by weight, each final when popped, until the goal item is (Knuth's generalisation of Dijkstra).

Spark deals sorted rows out by range, so a conversation of any size is shared by many tasks. What lies
whole within a task is repaired there. The pieces of others (at a task's ends, or over ``SEGMENT_ROWS``
rows) are derived for every pair of states; pieces are joined in levels by the same agenda, where a
piece's items label the deductions. The audit then walks the rows once more, as a stream, to give the
repaired turns: only that walk, a running hash, is sequential, and it holds no more than a batch.

Rows are in the order of turn (nulls first), role and MD5 of the text. Identical rows are merged to one
with a count before they are sorted; of more than one identical row all but the first are duplicates.

Defined results: null roles and texts are one space, also in the damage key; rows with a null
conversation id are one conversation; roles other than those whose initials are s, u and a cannot be
kept; a conversation without rows has zeros, an empty audit and no turns; an empty table gives no rows;
``gaps`` beyond a long are null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrays import bounded_batches
from vitrine.operators.materialize import materialize

BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3          # costs
SEGMENT_ROWS = 256
SEGMENT_BYTES = 4 << 20
FAN_IN = 16                       # tasks whose pieces are joined in one step

# states of the role grammar: nothing yet, after the system, a user, an assistant turn
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = (2, 2, 3, 2)              # after the turn that may follow
_ROLE = {2: "user", 3: "assistant"}
_ENDS = (0, 3)

_ITEMS = "array<struct<p:int,q:int,cost:bigint,audit:string>>"
_FACTS = ("struct<blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,turns:bigint,"
          "low:bigint,high:bigint,first_turn:bigint,first_role:string,last_role:string>")
_ROWS = "array<struct<role:string,text:string,copies:bigint,forced:boolean>>"
_TURNS = "array<struct<role:string,text:string,edit:string>>"

Weight = tuple[int, str]
Steps = Callable[[int, int], Iterable[tuple[int, int, str]]]


def agenda(length: int, steps: Steps, starts: Iterable[int], inserts: bool = True,
           to_goal: bool = False) -> dict[tuple[int, int, int], Weight]:
    """Lightest weights of the items ``(p, i, q)``, finalised in the order of their weights.

    ``steps(i, q)`` gives the deductions over position ``i`` as (state, cost, letters). With
    ``to_goal`` the search ends at the first final item over all positions in an end state.
    """
    heap = [(0, "", p, 0, p) for p in starts]
    heapq.heapify(heap)
    final: dict[tuple[int, int, int], Weight] = {}
    while heap:
        cost, audit, p, i, q = heapq.heappop(heap)
        if (p, i, q) in final:
            continue
        final[p, i, q] = cost, audit
        if to_goal and i == length and q in _ENDS:
            return {(p, i, q): (cost, audit)}
        if inserts and (p, i, _NEXT[q]) not in final:
            heapq.heappush(heap, (cost + INSERT, audit + "I", p, i, _NEXT[q]))
        if i < length:
            for state, more, letters in steps(i, q):
                if (p, i + 1, state) not in final:
                    heapq.heappush(heap, (cost + more, audit + letters, p, i + 1, state))
    return final


def row_steps(elements: list[tuple[int, str, bool]]) -> Steps:
    """Deductions over rows ``(forced deletions, initial, truncated)``."""
    def steps(i: int, q: int) -> Iterator[tuple[int, int, str]]:
        forced, initial, cut = elements[i]
        if forced:                              # a run of deletions is one deduction
            yield q, forced * DELETE, "D" * forced
            return
        extra = TRUNCATED if cut else 0
        if (q, initial) in _KEPT:
            yield _KEPT[q, initial], KEEP + extra, "K"
        yield _NEXT[q], REROLE + extra, "R"
        yield q, DELETE, "D"
    return steps


def joined_items(pieces: list[list[dict]], starts: Iterable[int] = range(4)) -> list[dict]:
    """Items over consecutive pieces from the items of each."""
    by_start = [{p: [(x["q"], x["cost"], x["audit"]) for x in items if x["p"] == p] for p in range(4)}
                for items in pieces]
    final = agenda(len(pieces), lambda i, q: by_start[i][q], starts, inserts=False)
    return _as_items(final, len(pieces))


def _as_items(final: dict, length: int) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit}
            for (p, i, q), (cost, audit) in sorted(final.items()) if i == length]


class Walk:
    """Applies an audit to rows as they come; the state is one position and one role state."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _turn(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        if edit == "K":
            self.state = _KEPT[self.state, role[:1]]
            return role, text, edit
        self.state = _NEXT[self.state]
        return _ROLE[self.state], text, edit

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._turn("I", "", "")

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(copies):
            yield from self._inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self._turn(edit, role, text)

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


class _Digest:
    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, turns: Iterable[tuple[str, str, str]]) -> None:
        for role, text, _ in turns:
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True


class _Piece:
    """Consecutive rows of one conversation: its elements, facts and rows."""

    def __init__(self):
        self.elements, self.rows, self.bytes = [], [], 0
        self.facts = None

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        bare = text.rstrip(BLANKS)
        blank, cut = not bare, bool(bare) and bare[-1] not in STOPS
        forced = blank or not first
        self.rows.append({"role": role, "text": text, "copies": copies, "forced": forced})
        self.bytes += len(text)
        initial = role[:1]
        if forced:
            self.elements.append((copies, initial, False))
        else:
            self.elements.append((0, initial, cut))
            if copies > 1:
                self.elements.append((copies - 1, initial, False))
        self.facts = _add_facts(self.facts, {
            "blank": copies if blank else 0, "truncated": int(cut and first),
            "duplicate": 0 if blank else copies - int(first), "illegal": copies - 1,
            "turns": int(turn is not None), "low": turn, "high": turn, "first_turn": turn,
            "first_role": initial, "last_role": initial})


def _add_facts(a: dict | None, b: dict) -> dict:
    """Facts of consecutive rows; turns are in order, so equal ones meet at the seam."""
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += (a["last_role"] or "") + (b["first_role"] or "") not in ("su", "ua", "au")
    out["turns"] -= a["high"] is not None and a["high"] == b["first_turn"]
    lows, highs = [x["low"] for x in (a, b) if x["low"] is not None], [
        x["high"] for x in (a, b) if x["high"] is not None]
    return out | {"low": min(lows, default=None), "high": max(highs, default=None),
                  "first_turn": a["first_turn"], "first_role": a["first_role"], "last_role": b["last_role"]}


def damage_conversations(rows: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Rows ``id, turn, role, text, copies`` with faults planted by a checksum of id and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))     # noqa: E731
    kind = F.crc32(F.concat(space(id_column), F.lit(":"), space("turn")).cast("binary")) % 20
    return (
        rows.select(F.col(id_column).alias("id"), F.col("turn").cast("bigint").alias("turn"),
                    space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select("id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(F.col("kind") == 1, "").when(
                    F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
                    F.col("text")).alias("text"),
                F.when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies")))


def _same(left: str, right: str, *columns: str) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return found


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, whether they are the first of their role and text,
    dealt out by ranges of (id, turn, role, digest) and sorted."""
    keys = ["id", "turn", "role", "digest"]
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    merged = rows.groupBy(*keys, "text").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # from the rows again, without texts: the shuffle of the merged rows holds every text
    repeated = rows.groupBy("id", "role", "digest").agg(
        F.min(place).alias("least"), F.count("*").alias("places")).where("places > 1")
    flagged = merged.alias("r").join(repeated.alias("f"), _same("r", "f", "id", "role", "digest"), "left").select(
        *[F.col(f"r.{c}") for c in [*keys, "text", "copies"]],
        (F.col("f.least").isNull() | F.col("f.least.turn").eqNullSafe(F.col("r.turn"))).alias("first"))
    return flagged.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _pieces(with_turns: bool, segment_rows: int, segment_bytes: int):
    """Task: whole conversations repaired, pieces of others with their items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, schema = TaskContext.get().partitionId(), [], None
        now, piece, seq, inner = None, None, 0, False

        def flush(whole: bool) -> None:
            nonlocal seq, piece
            row = {"id": now, "part": part, "seq": seq, "facts": piece.facts, "items": None, "rows": None,
                   "cost": None, "audit": None, "sha": None, "turns": None}
            steps, n = row_steps(piece.elements), len(piece.elements)
            if whole:
                (row["cost"], row["audit"]), = agenda(n, steps, [0], to_goal=True).values()
                walk, digest, turns = Walk(row["audit"]), _Digest(), []
                for r in piece.rows:
                    turns.extend(walk.row(r["role"], r["text"], r["copies"]))
                turns.extend(walk.end())
                digest.add(turns)
                row["sha"] = digest.sha.hexdigest()
                if with_turns:
                    row["turns"] = [{"role": a, "text": b, "edit": c} for a, b, c in turns]
            else:
                row["items"], row["rows"] = _as_items(agenda(n, steps, range(4)), n), piece.rows
            out.append(row)
            seq, piece = seq + 1, _Piece()

        for batch in batches:
            if schema is None:
                schema = _piece_schema(batch.schema.field("id").type)
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                       for c in ("id", "turn", "role", "text", "copies", "first")]
            for key, *values in zip(*columns):
                if piece is None or key != now:
                    if piece is not None and piece.rows:
                        # the task's first conversation may have begun in another task
                        flush(whole=inner and not seq)
                    inner = piece is not None
                    now, piece, seq = key, _Piece(), 0
                elif len(piece.elements) >= segment_rows or piece.bytes >= segment_bytes:
                    flush(whole=False)
                piece.add(*values)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if piece is not None and piece.rows:
            flush(whole=False)                   # the last one may go on in another task
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _piece_schema(id_type: pa.DataType) -> pa.Schema:
    text, whole = pa.string(), pa.int64()
    return pa.schema([
        ("id", id_type), ("part", pa.int32()), ("seq", pa.int32()),
        ("facts", pa.struct([*[(c, whole) for c in (
            "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_turn")],
            ("first_role", text), ("last_role", text)])),
        ("items", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", whole), ("audit", text)]))),
        ("rows", pa.list_(pa.struct([("role", text), ("text", text), ("copies", whole), ("forced", pa.bool_())]))),
        ("cost", whole), ("audit", text), ("sha", text),
        ("turns", pa.list_(pa.struct([("role", text), ("text", text), ("edit", text)])))])


def _joined(pieces: DataFrame, id_kind: str) -> DataFrame:
    """``id, items, facts`` of whole conversations from their pieces, joined in levels of tasks."""
    parts = (pieces.agg(F.max("part")).first()[0] or 0) + 1

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["part", "seq", "items", "facts"]).to_pylist(),
                      key=lambda r: (r["part"], r["seq"]))
        facts = None
        for r in rows:
            facts = _add_facts(facts, r["facts"])
        out = {"group": rows[0]["part"], "items": joined_items([r["items"] for r in rows]), "facts": facts}
        kinds = {f.name: f.type for f in table.schema}
        return pa.table({
            "id": table.column("id").slice(0, 1), "part": table.column("group").slice(0, 1),
            "seq": pa.array([0], pa.int32()), "items": pa.array([out["items"]], kinds["items"]),
            "facts": pa.array([out["facts"]], kinds["facts"])})

    schema = f"id {id_kind}, part int, seq int, items {_ITEMS}, facts {_FACTS}"
    now, width = pieces.select("id", "part", "seq", "items", "facts"), 1
    while True:
        now = now.withColumn("group", F.expr(f"int(part div {FAN_IN if width > 1 else 1})")).groupBy(
            "id", "group").applyInArrow(join, schema)
        if width >= parts:
            return now.select("id", "items", "facts")
        width *= FAN_IN


def _walked(pieces: DataFrame, goals: DataFrame, id_kind: str, with_turns: bool) -> DataFrame:
    """Repaired conversations from their audits and rows, which pass as a sorted stream."""
    rows = pieces.select("id", "part", "seq", F.posexplode("rows").alias("at", "r")).select(
        "id", "part", "seq", "at", F.lit(None).cast("string").alias("audit"), "r.role", "r.text", "r.copies")
    heads = goals.select("id", *[F.lit(-1).alias(c) for c in ("part", "seq", "at")], "audit",
                         *[F.lit(None).cast(t).alias(c) for c, t in (
                             ("role", "string"), ("text", "string"), ("copies", "bigint"))])
    stream = heads.unionByName(rows).repartition("id").sortWithinPartitions("id", "part", "seq", "at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, key, place, schema, out = None, None, None, 0, None, []

        def give(turns: Iterable[tuple[str, str, str]]) -> None:
            nonlocal place
            for turn in turns:
                digest.add([turn])
                if with_turns:
                    out.append({"id": key, "position": place, "role": turn[0], "text": turn[1],
                                "edit": turn[2], "sha": None})
                place += 1

        def close() -> None:
            give(now.end())
            if not with_turns:
                out.append({"id": key, "position": None, "role": None, "text": None, "edit": None,
                            "sha": digest.sha.hexdigest()})

        for batch in batches:
            if schema is None:
                text = pa.string()
                schema = pa.schema([("id", batch.schema.field("id").type), ("position", pa.int64()),
                                    ("role", text), ("text", text), ("edit", text), ("sha", text)])
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                       for c in ("id", "audit", "role", "text", "copies")]
            for i, audit, role, text, copies in zip(*columns):
                if audit is not None:
                    if now is not None:
                        close()
                    now, digest, key, place = Walk(audit), _Digest(), i, 0
                else:
                    give(now.row(role, text, copies))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if now is not None:
            close()
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return stream.mapInArrow(
        walk, f"id {id_kind}, position bigint, role string, text string, edit string, sha string")


def _solved(rows: DataFrame, with_turns: bool, segment_rows: int, segment_bytes: int
            ) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Written pieces, of which the whole ones, and the goals of the others."""
    bounded_batches(rows)
    id_kind = rows.schema["id"].dataType.simpleString()
    schema = (f"id {id_kind}, part int, seq int, facts {_FACTS}, items {_ITEMS}, rows {_ROWS}, "
              f"cost bigint, audit string, sha string, turns {_TURNS}")
    found = materialize(_sorted_rows(rows).mapInArrow(
        _pieces(with_turns, segment_rows, segment_bytes), schema), "conversation-pieces")
    pieces = found.where("items IS NOT NULL")
    ends = F.expr("filter(items, x -> x.p = 0 AND x.q IN (0, 3))")
    goals = materialize(
        _joined(pieces, id_kind).select("id", "facts", F.array_min(F.transform(
            ends, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit")))).alias("goal"))
        .select("id", "facts", "goal.cost", "goal.audit"), "conversation-goals")
    return found.where("items IS NULL"), pieces, goals, id_kind


def repair_conversations(rows: DataFrame, segment_rows: int = SEGMENT_ROWS,
                         segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row per conversation of ``rows(id, turn, role, text, copies)`` (no null role or text).

    Returns ``id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    """
    whole, pieces, goals, id_kind = _solved(rows, False, segment_rows, segment_bytes)
    digests = _walked(pieces, goals, id_kind, False).select("id", "sha")
    rest = goals.alias("g").join(digests.alias("d"), _same("g", "d", "id")).select(
        "g.id", "g.facts", "g.cost", "g.audit", "d.sha")
    facts = ["blank", "duplicate", "truncated", "illegal"]
    gaps = F.expr("coalesce(CAST(facts.high AS DECIMAL(20,0)) - CAST(facts.low AS DECIMAL(20,0)) + 1 - facts.turns, 0)")
    return whole.select("id", "facts", "cost", "audit", "sha").unionByName(rest).select(
        "id", gaps.try_cast("bigint").alias("gaps"),
        *[F.col(f"facts.{c}").alias(c) for c in facts], "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repaired_turns(rows: DataFrame, segment_rows: int = SEGMENT_ROWS,
                   segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The turns of every repaired conversation: ``id, position, role, text, edit`` (K, R or I)."""
    whole, pieces, goals, id_kind = _solved(rows, True, segment_rows, segment_bytes)
    first = whole.select("id", F.posexplode("turns").alias("position", "t")).select(
        "id", F.col("position").cast("bigint").alias("position"), "t.role", "t.text", "t.edit")
    return first.unionByName(_walked(pieces, goals, id_kind, True).drop("sha"))


def repair_damaged(conversations: DataFrame, id_column: str = "conv_id", **sizes) -> DataFrame:
    """Damage, then repair; every conversation of the table has a row, also those left empty."""
    damaged = damage_conversations(conversations, id_column)
    fixed = repair_conversations(damaged, **sizes)
    left = conversations.select(F.col(id_column).alias("id")).distinct().alias("c")
    zero = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    out = left.join(fixed.alias("f"), _same("c", "f", "id"), "left")
    return out.select(F.col("c.id").alias(id_column), *[
        F.when(F.col("f.audit").isNull(), F.lit(zero.get(c, 0)).cast(t)).otherwise(F.col(f"f.{c}")).alias(c)
        for c, t in fixed.dtypes if c != "id"])
