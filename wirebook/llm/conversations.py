"""Structure repair of conversations by iterative-deepening A*.

A conversation is well formed if the initials of its roles read
``(s?(ua)+)?``.  Rows are kept, given another role or deleted, and empty turns
are inserted, at least cost; of equally cheap repairs that with the
ASCII-least string of edit initials is taken.  The search is depth first in
ASCII order of the edits under a cost bound that rises to the least cost not
refuted yet; a table holds for every state that failed the cost it needs at
least, also across bounds, so the first path that is accepted is the answer.

Rows are ordered by a range shuffle, so one conversation may spread over many
tasks.  A conversation inside a task is repaired there.  One that is cut, or
that has more rows than a stretch, is searched stretch by stretch, for every
state that a stretch can be entered and left in; the stretches' answers are
joined from the last to the first.  An insert belongs to the row before which
it stands, so the edits of two ways through a stretch differ before either
ends, and the least string of the whole is made of least strings of stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.llm.words import small_batches
from wirebook.sources.tables import shared_dir

DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
#: What a truncated row costs unless it is deleted.
TRUNCATED = 3
#: States: nothing yet, after system, after user, after assistant; and what may follow.
STATES = range(4)
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an insert or another role gives in a state.
GIVEN = ("user", "user", "assistant", "user")
ACCEPTED = (True, False, False, True)
LEGAL = ("su", "ua", "au")
#: Rows that are searched at a time.
STRETCH = 64
NEVER = 1 << 62
FAULTS = "blank", "duplicate", "truncated"
VISIBLE, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


class Item(NamedTuple):
    """Rows of a conversation: one row, or a run that has to be deleted."""

    role: str
    text: str
    fault: str
    count: int


def damage(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with the faults that crc32(``conv_id:turn``) % 20 asks for.

    0 drops the row (role null and no copies, so that its conversation stays
    known), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes
    its role user.  Nulls are one space in the key, the role and the text.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn)).cast("binary")) % 20
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), said(role).alias("role"), said(text).alias("text"), kind.alias("kind")).select(
        "conv_id",
        F.when(F.col("kind") != 0, F.col("turn")).alias("turn"),
        F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).when(F.col("kind") != 0, F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Different rows with their number of copies and the first fault of the first copy.

    Copies are added up before the shuffle.  A row is a duplicate if its role
    and text have an earlier turn, found by an aggregation and a join.
    """
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    # Null turns come first, in sorting as in the minimum of this pair.
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"))
    rows = rows.withColumn("key", key)
    each = rows.groupBy("conv_id", "turn", "key", "role", "text").agg(F.sum("copies").alias("copies"))
    first = rows.where("role IS NOT NULL").groupBy(F.col("conv_id").alias("conv"), F.col("key").alias("same")).agg(F.min(when).alias("first"))
    met = each.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("key") == F.col("same")), "left")
    fault = F.when(~F.col("text").rlike(VISIBLE), "blank").when(when != F.col("first"), "duplicate").when(~F.col("text").rlike(ENDED), "truncated")
    return met.select("conv_id", "turn", "key", "role", "text", "copies", fault.alias("fault"))


def _items(rows: list[tuple]) -> list[Item]:
    """Rows of (turn, role, text, copies, fault); copies after the first have to go."""
    items = []
    for _, role, text, copies, fault in rows:
        must = fault in FAULTS[:2]
        items.append(Item(role, text, fault or "", copies if must else 1))
        if copies > 1 and not must:
            items.append(Item(role, text, FAULTS[1], copies - 1))
    return items


def search(items: list[Item], enter: int = 0, leave: int | None = None, failed: dict | None = None) -> tuple[int, str] | None:
    """Least cost and edits from one state to another, or to the end of a conversation.

    With ``leave`` the last edit is that of the last row; without it inserts
    may follow.  ``failed`` may be shared by searches for the same end.  None
    if there is no way.
    """
    m = len(items)
    # What rows cost at least, what it costs to delete them all, and whether one of them may follow nothing as system.
    needed, gone, system = [0] * (m + 1), [0] * (m + 1), [False] * (m + 1)
    for i in range(m - 1, -1, -1):
        role, _, fault, count = items[i]
        must = fault in FAULTS[:2]
        own = COST[DELETE] * count if must else min(TRUNCATED, COST[DELETE]) if fault else 0
        needed[i], gone[i] = needed[i + 1] + own, gone[i + 1] + COST[DELETE] * count
        system[i] = system[i + 1] or not must and role[:1] == "s"
    #: Cost that a state (row, state, inserts before the row) needs at least, raised whenever it fails.
    failed = {} if failed is None else failed

    def need(at: tuple[int, int, int]) -> int:
        if at in failed:
            return failed[at]
        i, s, _ = at
        if leave is None or leave > 1:
            return needed[i]
        # Only a system turn leads from nothing to after system, and nothing leads back: all other rows go.
        if s == leave:
            return gone[i]
        return gone[i] - COST[DELETE] if s < leave and system[i] else NEVER

    def moves(i: int, s: int, inserts: int) -> list[tuple[str, int, tuple[int, int, int]]]:
        given = FOLLOWS[s][GIVEN[s][0]]
        # A third insert in a row leads to a state that was there before.
        found = [(INSERT, COST[INSERT], (i, given, inserts + 1))] if inserts < 2 else []
        if i == m:
            return found if leave is None else []
        role, _, fault, count = items[i]
        if fault in FAULTS[:2]:  # an insert after the deletions is less than one before
            return [(DELETE * count, COST[DELETE] * count, (i + 1, s, inserts))]
        more = TRUNCATED if fault else 0
        found.insert(0, (DELETE, COST[DELETE], (i + 1, s, inserts)))
        if role[:1] in FOLLOWS[s]:
            found.append((KEEP, COST[KEEP] + more, (i + 1, FOLLOWS[s][role[:1]], 0)))
        return [*found, (REROLE, COST[REROLE] + more, (i + 1, given, 0))]

    path: list[str] = []

    def reach(at: tuple[int, int, int], left: int) -> bool:
        if need(at) > left:
            return False
        if at[0] == m and (ACCEPTED[at[1]] if leave is None else at[1] == leave):
            return True
        least = NEVER
        for edit, cost, to in moves(*at):
            path.append(edit)
            if reach(to, left - cost):
                return True
            path.pop()
            least = min(least, cost + need(to))
        failed[at] = least
        return False

    start = (0, enter, 0)
    while (limit := need(start)) < NEVER:
        if reach(start, limit):
            return limit, "".join(path)
    return None


def apply_edits(items: list[Item], edits: str, enter: int = 0) -> list[tuple[str, str]]:
    """Roles and texts after the edits."""
    out, s, i, left = [], enter, 0, items[0].count if items else 0
    for edit in edits:
        if edit == INSERT:
            out.append((GIVEN[s], ""))
            s = FOLLOWS[s][GIVEN[s][0]]
            continue
        if edit != DELETE:
            role = items[i].role if edit == KEEP else GIVEN[s]
            out.append((role, items[i].text))
            s = FOLLOWS[s][role[0]]
        left -= 1
        if not left:
            i += 1
            left = items[i].count if i < len(items) else 0
    return out


PAIR = "array<struct<role:string,text:string>>"
COUNTS = ("rows", *FAULTS, "illegal", "turns", "first_turn", "last_turn")
SEGMENT = (
    "part int, seq bigint, whole boolean, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "turns bigint, first_turn bigint, last_turn bigint, head string, tail string, gaps bigint, cost bigint, audit string, "
    f"repaired {PAIR}, items array<struct<role:string,text:string,fault:string,count:bigint>>, "
    "ways array<struct<enter:int,leave:int,cost:bigint,edits:string>>"
)


def _arrow(layout: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(layout))


def _counts(rows: list[tuple]) -> dict[str, object]:
    """Counts of a stretch, and what its neighbours need to know of its ends."""
    found = dict.fromkeys(COUNTS, 0)
    for _, _, _, copies, fault in rows:
        found["rows"] += copies
        if fault in FAULTS[:2]:
            found[fault] += copies
        else:
            found[FAULTS[1]] += copies - 1
            if fault:
                found[fault] += 1
    initials = [r[1][:1] for r in rows]
    found["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(r[3] - 1 for r in rows)
    turns = [r[0] for r in rows if r[0] is not None]
    found |= {"turns": len(set(turns)), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None)}
    return found | {"head": initials[0] if rows else None, "tail": initials[-1] if rows else None}


def _segments(rows: DataFrame, stretch: int) -> DataFrame:
    """A row per conversation, or per stretch of those that are long or cut by the end of a task's range."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    layout = f"conv_id {kind}, {SEGMENT}"
    schema = _arrow(layout)
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        now, begun, open_, seq = None, False, [], 0
        # The first conversation may have begun before, the last may go on.
        whole = False

        def segment(ended: bool) -> dict:
            nonlocal seq
            items = _items(open_)
            row = {"conv_id": now, "part": part, "seq": seq, "whole": ended} | _counts(open_)
            seq += 1
            if ended:
                row["cost"], row["audit"] = search(items)
                row["gaps"] = _gaps(row["first_turn"], row["last_turn"], row["turns"])
                pairs = apply_edits(items, row["audit"])
                return row | {"repaired": [{"role": r, "text": t} for r, t in pairs]}
            ways = [(a, b, search(items, a, b, failed)) for b in STATES for failed in [{}] for a in STATES]
            row["ways"] = [{"enter": a, "leave": b, "cost": w[0], "edits": w[1]} for a, b, w in ways if w]
            return row | {"items": [i._asdict() for i in items]}

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv != now:
                    out.append(segment(whole))
                    open_, whole = [], True
                elif len(open_) == stretch:
                    out.append(segment(False))
                    open_, whole = [], False
                now, begun = conv, True
                if row[1] is not None:
                    open_.append(tuple(row))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if begun:
            out.append(segment(False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    keys = "conv_id", "turn", "key"
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.select("conv_id", "turn", "role", "text", "copies", "fault").mapInArrow(run, layout)


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    """Turns that are missing between the first and the last, as a 64-bit number."""
    if first is None:
        return 0
    return (last - first + 1 - turns + (1 << 63)) % (1 << 64) - (1 << 63)


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _join_stretches(segments: DataFrame) -> DataFrame:
    """Reports of conversations in several stretches, and the way taken through each stretch (part, seq, enter, edits).

    Stretches come last first.  Of equally cheap ways on from a state the
    edits of the nearest stretch decide, as no two of them begin alike.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    layout = f"conv_id {kind}, {REPORT}, part int, seq bigint, enter int, edits string"
    schema = _arrow(layout)
    names = ["conv_id", "part", "seq", *COUNTS, "head", "tail", "ways"]

    def close(conv: object, best: list, chosen: list, sums: dict) -> list[dict]:
        state, audit, out = 0, [], []
        for part, seq, ways in reversed(chosen):
            leave, edits = ways[state]
            out.append({"conv_id": conv, "part": part, "seq": seq, "enter": state, "edits": edits})
            audit.append(edits)
            state = leave
        # Inserts after the last row go to its stretch.
        end = INSERT * (0, 2, 1, 0)[state]
        out[-1]["edits"] += end
        gaps = _gaps(sums["first_turn"], sums["last_turn"], sums["turns"])
        report = {c: sums[c] for c in (*FAULTS, "illegal")} | {"gaps": gaps, "cost": best[0], "audit": "".join(audit) + end}
        return [*out, {"conv_id": conv} | report]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now = False, None
        best: list = []
        chosen: list = []
        sums: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != now:
                    if begun:
                        out += close(now, best, chosen, sums)
                    begun, now, chosen = True, row["conv_id"], []
                    best = [COST[INSERT] * n for n in (0, 2, 1, 0)]
                    sums = dict.fromkeys(COUNTS, 0) | {"first_turn": None, "last_turn": None, "head": None}
                ways: list = [None] * len(STATES)
                costs = [NEVER] * len(STATES)
                for w in row["ways"]:
                    a, total = w["enter"], w["cost"] + best[w["leave"]]
                    if best[w["leave"]] < NEVER and (ways[a] is None or (total, w["edits"]) < (costs[a], ways[a][1])):
                        costs[a], ways[a] = total, (w["leave"], w["edits"])
                best = costs
                chosen.append((row["part"], row["seq"], ways))
                for c in ("rows", *FAULTS, "illegal", "turns"):
                    sums[c] += row[c]
                if row["rows"]:
                    if sums["head"] is not None and row["tail"] + sums["head"] not in LEGAL:
                        sums["illegal"] += 1
                    sums["head"] = row["head"]
                if row["first_turn"] is not None:
                    if sums["first_turn"] == row["last_turn"]:
                        sums["turns"] -= 1
                    sums["first_turn"] = row["first_turn"]
                    if sums["last_turn"] is None:
                        sums["last_turn"] = row["last_turn"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if begun:
            yield pa.RecordBatch.from_pylist(close(now, best, chosen, sums), schema=schema)

    parts = segments.select(*names).repartition("conv_id")
    return parts.sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(run, layout)


class Repair(NamedTuple):
    """``reports``: a row per conversation with its counts, cost and audit.

    ``pieces``: conv_id, part, seq and the array ``repaired`` of roles and
    texts; a conversation is its pieces in order of part and seq, one piece
    where it is ``whole``.
    """

    reports: DataFrame
    pieces: DataFrame


def repair(rows: DataFrame, stretch: int = STRETCH) -> Repair:
    """Repair conversations given as rows (conv_id, turn, role, text, copies), as ``damage`` makes them.

    Rows are taken by turn, null turns first; rows that share a turn in order
    of a digest of role and text, copies next to each other.  Rows with a null
    conv_id are one conversation.  A row without role and copies only names
    its conversation; one without other rows has zeros and no turns.  The
    first fault of a row counts: blank, duplicate, truncated.  An empty table
    gives no rows.  A conversation in one task takes memory for one stretch;
    its audit, a letter per row, is held whole.
    """
    spark, root = rows.sparkSession, shared_dir(rows.sparkSession)

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    segments = put(_segments(_marked(rows), stretch), "segments")
    cut = segments.where("NOT whole")
    joined = put(_join_stretches(cut), "joined")
    kind = rows.schema["conv_id"].dataType.simpleString()
    layout = f"conv_id {kind}, part int, seq bigint, repaired {PAIR}"
    schema = _arrow(layout)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pairs = apply_edits([Item(**i) for i in row["items"]], row["edits"], row["enter"])
                out.append({c: row[c] for c in ("conv_id", "part", "seq")} | {"repaired": [{"role": r, "text": t} for r, t in pairs]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ways = joined.where("part IS NOT NULL").select("part", "seq", "enter", "edits")
    mended = cut.select("conv_id", "part", "seq", "items").join(ways, ["part", "seq"])
    mended = mended.mapInArrow(mend, layout)
    names = ["conv_id", *(c.split(" ")[0] for c in REPORT.split(", "))]
    alone = segments.where("whole")
    reports = alone.select(*names).unionByName(joined.where("part IS NULL").select(*names))
    pieces = alone.select("conv_id", "part", "seq", "repaired", F.lit(True).alias("whole"))
    return Repair(reports, pieces.unionByName(mended.withColumn("whole", F.lit(False))))


def _lines(repaired: Column) -> Column:
    return F.array_join(F.transform(repaired, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def digests(found: Repair) -> DataFrame:
    """The reports with repaired_sha256, of the repaired ``role:text`` joined by line feeds.

    Pieces of one conversation stream through one task in order, as the
    digest is sequential; no task holds them together.
    """
    layout = f"conv_id {found.pieces.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    schema = _arrow(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, state, any_ = False, None, hashlib.sha256(), False
        for batch in batches:
            out = []
            for conv, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    if begun:
                        out.append({"conv_id": now, "repaired_sha256": state.hexdigest()})
                    begun, now, state, any_ = True, conv, hashlib.sha256(), False
                if lines is not None:
                    state.update((("\n" if any_ else "") + lines).encode())
                    any_ = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": state.hexdigest()}], schema=schema)

    cut = found.pieces.where("NOT whole").select("conv_id", "part", "seq", F.when(F.size("repaired") > 0, _lines(F.col("repaired"))).alias("lines"))
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "lines")
    streamed = cut.mapInArrow(run, layout)
    alone = found.pieces.where("whole").select("conv_id", F.sha2(_lines(F.col("repaired")), 256).alias("repaired_sha256"))
    sums = alone.unionByName(streamed).withColumnRenamed("conv_id", "conv")
    return found.reports.join(sums, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
