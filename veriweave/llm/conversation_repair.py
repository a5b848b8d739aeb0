"""Conversation structure repair: cheapest edits to alternating turns, by bidirectional Dijkstra over an edit lattice.

A node of the lattice is a number of rows used up and a state of the pattern ``(s?(ua)+)?`` over
role initials. Edits are edges: Keep (0), Rerole to user or assistant (1), Delete (2), Insert an
empty user or assistant turn (5); a truncated row that stays adds 5; blank and duplicate rows can
only be deleted. One heap grows from the start, one from the goal; once they cannot meet more
cheaply, all crossings of the least cost are finished and the least audit (initials of the edits,
in order) is taken.

An audit says its path: in every state an Insert or Rerole has one possible role. And of two
audits that lead to one node at one cost none begins the other, as the longer one would have
inserted more. So the least of two is told where they first differ, whatever follows, which is
what lets labels keep one audit each and lets long conversations be cut.

Rows are put in order by ranges of (conversation, turn), so a conversation of any length lies in
several tasks. A run of at most ``RUN_ROWS`` rows (and ``RUN_CHARS`` characters) that is a whole
conversation is solved at once. Any other run gets a table: cost of every pair of entry and exit
state, and its audit. Going back over the tables of a conversation gives the cost to go, going
forward the states its best path passes; each run then knows its edits. Digests read the pieces of
a conversation as a stream.

Defined results: null role or text counts as one space; a null ``conv_id`` is a conversation, a
null turn comes first and has no part in gaps; rows of one turn come by role, then by the MD5 of
the text; equal rows are duplicates of the first. A conversation without rows left has zeros, an
empty audit and the hash of the empty string. An empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.llm.common import partitions_for, prepare, settled

RUN_ROWS = 256
RUN_CHARS = 4 * 1024 * 1024

# States of the pattern: nothing yet, after s, after u, after a.
STATES, GOALS = 4, (0, 3)
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5

# Characters that are no text, and what ends a sentence.
_WHITE = r"\x20\x09-\x0D"


def step(state: int, initial: str) -> int | None:
    """State after a row with this role initial; None where the pattern forbids it."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


def wanted(state: int) -> str:
    """The only initial that a new or changed role can have in this state."""
    return "a" if state == 2 else "u"


def _edges(rows: list[tuple[str, str]], i: int, state: int, trailing: bool) -> Iterator[tuple[str, int, int, int]]:
    """Edits possible at a node: initial, cost, rows used up after it, state after it."""
    if i < len(rows):
        initial, fault = rows[i]
        yield DELETE, COST[DELETE], i + 1, state
        if fault not in "bd":
            extra = TRUNCATED_COST if fault == "t" else 0
            yield REROLE, COST[REROLE] + extra, i + 1, step(state, wanted(state))
            after = step(state, initial)
            if after is not None:
                yield KEEP, COST[KEEP] + extra, i + 1, after
    if i < len(rows) or trailing:
        yield INSERT, COST[INSERT], i, step(state, wanted(state))


def cheapest(rows: list[tuple[str, str]], start: int = 0, goals: Iterable[int] = GOALS, trailing: bool = True) -> tuple[int, str] | None:
    """Least cost from a state before the rows to one of the goal states behind them, and the least audit of that cost.

    ``rows``: role initial and fault ('b', 'd', 't' or '.') of each. Without ``trailing``
    nothing is inserted behind the last row: that belongs to the run that follows.
    """
    n, goals = len(rows), tuple(goals)
    # Label of a node: cost and least audit, from the start or to the goal.
    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    back: dict[tuple[int, int], tuple[int, str]] = {(n, g): (0, "") for g in goals}
    # Edges without cost always use up a row. With the rows as second part of the key, all labels of
    # one cost that lead to a node are final before it is taken.
    forward, reverse = [(0, 0, start)], [(0, 0, g) for g in goals]
    settled_ahead, settled_back = set(), set()
    best = None
    while forward or reverse:
        # Start and goals come first, so that every path has an edge from a node of the one side to a node of the other.
        begun = len(settled_back) >= len(goals)
        if begun and settled_ahead and forward and reverse and best is not None and forward[0][0] + reverse[0][0] > best:
            break
        if forward and (not settled_ahead or not reverse or begun and forward[0][0] <= reverse[0][0]):
            cost, i, state = heappop(forward)
            if (i, state) in settled_ahead:
                continue
            settled_ahead.add((i, state))
            audit = ahead[i, state][1]
            if (i, state) in back:
                best = min(x for x in (best, cost + back[i, state][0]) if x is not None)
            for edit, more, j, after in _edges(rows, i, state, trailing):
                label, known = (cost + more, audit + edit), ahead.get((j, after))
                if known is None or label < known:
                    ahead[j, after] = label
                    if known is None or label[0] < known[0]:
                        heappush(forward, (label[0], j, after))
        else:
            cost, left, state = heappop(reverse)
            i = n - left
            if (i, state) in settled_back:
                continue
            settled_back.add((i, state))
            audit = back[i, state][1]
            if (i, state) in ahead:
                best = min(x for x in (best, cost + ahead[i, state][0]) if x is not None)
            for j in (i - 1, i):
                if j < 0:
                    continue
                for before in range(STATES):
                    for edit, more, to, after in _edges(rows, j, before, trailing):
                        if (to, after) != (i, state):
                            continue
                        label, known = (cost + more, edit + audit), back.get((j, before))
                        if known is None or label < known:
                            back[j, before] = label
                            if known is None or label[0] < known[0]:
                                heappush(reverse, (label[0], n - j, before))
    if best is None:
        return None
    found = []
    for node in settled_ahead:
        cost, audit = ahead[node]
        if node in settled_back and cost + back[node][0] == best:
            found.append(audit + back[node][1])
        for edit, more, j, after in _edges(rows, *node, trailing):
            if (j, after) in settled_back and cost + more + back[j, after][0] == best:
                found.append(audit + edit + back[j, after][1])
    return best, min(found)


def finish(state: int) -> str:
    """Edits behind the last row that complete the pattern."""
    return {0: "", 1: INSERT * 2, 2: INSERT, 3: ""}[state]


def table_of(rows: list[tuple[str, str]]) -> list[tuple[int, int, int, str]]:
    """Entry state, exit state, cost and audit of every way through a run."""
    out = []
    for entry in range(STATES):
        for leave in range(min(entry, 2), STATES):
            found = cheapest(rows, entry, (leave,), trailing=False)
            if found is not None:
                out.append((entry, leave, *found))
    return out


def replay(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """Role and text of each turn that the edits leave."""
    i = 0
    for edit in audit:
        if edit == DELETE:
            i += 1
            continue
        role = {"u": "user", "a": "assistant"}[wanted(state)] if edit in (INSERT, REROLE) else roles[i]
        yield role, "" if edit == INSERT else texts[i]
        i += edit != INSERT
        state = step(state, role[:1])


def _lines(turns: Iterable[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


def marked(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``row`` (a number of its own) and ``fault``: '-' (gone), 'b', 'd', 't' or '.'; its first fault counts.

    ``gone``: rows that are no part of their conversation any more; a conversation of only such rows is still known.
    """
    blank = ~F.col("text").rlike(f"[^{_WHITE}]")
    ended = F.col("text").rlike(f"[.!?][{_WHITE}]*\\z")
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(False) if gone is None else gone).alias("gone"), F.monotonically_increasing_id().alias("row"),
    )
    # Written, so that the numbers of the rows are the same wherever they are read.
    rows = settled(rows, "conversation-rows").select(
        "*", F.when(F.col("gone"), "-").when(blank, "b").when(~ended, "t").otherwise(".").alias("own"),
        F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("same"),
    )
    # Equal rows are counted before they are shuffled, and only turns that were said more than once are met with the rows.
    first = F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("t"), F.col("row").alias("r"))
    said = rows.filter("own NOT IN ('-', 'b')").groupBy("conv_id", "same").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    again = said.filter("n > 1").select(F.col("conv_id").alias("_c"), F.col("same").alias("_s"), "first")
    met = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("same") == F.col("_s")), "left")
    later = F.col("own").isin("t", ".") & F.col("first").isNotNull() & ~first.eqNullSafe(F.col("first"))
    return met.select("conv_id", "turn", "role", "text", "row", F.when(later, "d").otherwise(F.col("own")).alias("fault"))


_RUN = (
    "run long, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, least long, most long, turns long, "
    "ways array<struct<entry:int,leave:int,cost:long,audit:string>>, roles array<string>, texts array<string>"
)


class _Run:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv) -> None:
        self.conv, self.rows, self.roles, self.texts, self.turns, self.chars = conv, [], [], [], [], 0

    def full(self, run_rows: int) -> bool:
        return len(self.rows) >= run_rows or self.chars >= RUN_CHARS

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.rows.append((role[:1], fault))
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.chars += len(text)

    def record(self, run: int, whole: bool) -> dict:
        faults = [f for _, f in self.rows]
        said = [t for t in self.turns if t is not None]
        if whole:
            ways = [(0, 0, *cheapest(self.rows))]
        else:
            ways = table_of(self.rows)
        return {
            "conv_id": self.conv, "run": run, "whole": whole, "n": len(self.rows),
            "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
            "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(self.rows, self.rows[1:])),
            "first": self.rows[0][0] if self.rows else None, "last": self.rows[-1][0] if self.rows else None,
            "least": min(said, default=None), "most": max(said, default=None), "turns": len(set(said)),
            "ways": [dict(zip(("entry", "leave", "cost", "audit"), w)) for w in ways],
            "roles": self.roles, "texts": self.texts,
        }


def runs(turns: DataFrame, gone: Column | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """Runs of rows of one conversation, in order of ``run``, with what the edits of each can be; written to the shared folder."""
    prepare(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]
    rows = marked(turns, gone).withColumn("order", F.md5("text"))
    by = ["conv_id", "turn", "role", "order", "row"]
    dealt = rows.repartitionByRange(partitions_for(turns), *by).sortWithinPartitions(*by)
    laid = dealt.select("conv_id", "turn", "role", "text", "fault", F.spark_partition_id().cast("long").alias("place"))
    schema = f"conv_id {kind}, {_RUN}"
    target = _arrow_schema(turns.sparkSession, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, current, opened, number, chars = [], None, True, 0, 0

        def close(closed: bool) -> None:
            nonlocal number, chars
            made.append(current.record((place << 32) + number, whole=closed and not opened))
            number, chars = number + 1, chars + current.chars

        for batch in batches:
            for row in batch.to_pylist():
                conv, place = row["conv_id"], row["place"]
                if current is None:
                    current = _Run(conv)
                elif current.conv != conv or (current.conv is None) != (conv is None):
                    # The first run of a task may have begun in the task before.
                    close(True)
                    current, opened = _Run(conv), False
                if row["fault"] == "-":
                    continue
                if current.full(run_rows):
                    opened = True
                    close(False)
                    current = _Run(conv)
                current.add(row["turn"], row["role"], row["text"], row["fault"])
                if len(made) >= 500 or chars >= RUN_CHARS:
                    yield pa.RecordBatch.from_pylist(made, schema=target)
                    made, chars = [], 0
        if current is not None:
            # It may go on in the next task.
            opened = True
            close(False)
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=target)

    return settled(laid.mapInArrow(cut, schema), "conversation-runs")


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    return spark.createDataFrame([], ddl).toArrow().schema


def _passed(table: pa.Table) -> list[dict]:
    """The states between the runs of one conversation, on its cheapest path with the least audit."""
    some = sorted(table.to_pylist(), key=lambda r: r["run"])
    left: list = [len(finish(s)) * COST[INSERT] for s in range(STATES)]
    to_go = [left]
    for r in reversed(some):
        now = [None] * STATES
        for w in r["ways"]:
            if left[w["leave"]] is not None:
                cost = w["cost"] + left[w["leave"]]
                if now[w["entry"]] is None or cost < now[w["entry"]]:
                    now[w["entry"]] = cost
        left = now
        to_go.append(left)
    to_go.reverse()
    out, state = [], 0
    for k, r in enumerate(some):
        best = min(
            (w["cost"] + to_go[k + 1][w["leave"]], w["place"], w["leave"])
            for w in r["ways"] if w["entry"] == state and to_go[k + 1][w["leave"]] is not None
        )
        out.append({"run_": r["run"], "entry": state, "leave": best[2], "last_run": k == len(some) - 1})
        state = best[2]
    return out


def pieces(runs: DataFrame) -> DataFrame:
    """Per run its edits: ``conv_id``, ``run``, ``entry`` (state before it), ``cost``, ``audit``, with what ``runs`` gives besides.

    Insertions behind the last row stand in the last run.
    """
    spark = runs.sparkSession
    one = runs.filter("whole").select("*", F.lit(0).alias("entry"), F.lit(0).alias("leave"), F.lit(False).alias("last_run"))
    # Costs only, and the place of each audit among those of its entry: a few numbers for each run.
    ways = F.transform(
        "ways",
        lambda w: F.struct(
            w["entry"].alias("entry"), w["leave"].alias("leave"), w["cost"].alias("cost"),
            F.size(F.filter("ways", lambda o: (o["entry"] == w["entry"]) & (o["audit"] < w["audit"]))).alias("place"),
        ),
    )
    small = runs.filter("NOT whole").select("conv_id", "run", ways.alias("ways"))
    target = _arrow_schema(spark, "run_ long, entry int, leave int, last_run boolean")
    passed = small.groupBy("conv_id").applyInArrow(
        lambda table: pa.Table.from_pylist(_passed(table), schema=target), "run_ long, entry int, leave int, last_run boolean"
    )
    several = runs.filter("NOT whole").join(passed, F.col("run") == F.col("run_")).drop("run_")
    way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["leave"] == F.col("leave")))[0]
    behind = F.when(F.col("last_run"), F.when(F.col("leave") == 1, 2).when(F.col("leave") == 2, 1).otherwise(0)).otherwise(0)
    return one.unionByName(several).withColumn("_w", way).select(
        *[c for c in runs.columns if c != "ways"], "entry",
        (F.col("_w.cost") + COST[INSERT] * behind).cast("long").alias("cost"),
        F.concat(F.col("_w.audit"), F.repeat(F.lit(INSERT), behind)).alias("audit"),
    )


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``run``, ``place`` (order inside the run), ``role``, ``text``."""
    kind = dict(pieces.dtypes)["conv_id"]
    schema = f"conv_id {kind}, run long, place int, role string, text string"
    target = _arrow_schema(pieces.sparkSession, schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                turns = replay(r["audit"], r["entry"], r["roles"], r["texts"])
                out = [{"conv_id": r["conv_id"], "run": r["run"], "place": i, "role": a, "text": b} for i, (a, b) in enumerate(turns)]
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return pieces.select("conv_id", "run", "audit", "entry", "roles", "texts").mapInArrow(told, schema)


_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation: faults, cost, audit and hash of the repaired turns (``role:text``, one a line)."""
    kind = dict(pieces.dtypes)["conv_id"]
    schema = f"conv_id {kind}, {_DIGEST}"
    target = _arrow_schema(pieces.sparkSession, schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, made = None, None, []

        def close() -> None:
            gaps = now["most"] - now["least"] + 1 - now["turns"] if now["least"] is not None else 0
            made.append({
                **{c: now[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}, "conv_id": now["conv_id"], "gaps": gaps,
                "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest(),
            })

        for batch in batches:
            for r in batch.to_pylist():
                if seen is None or r["whole"] or r["conv_id"] != seen[0]:
                    if now is not None:
                        close()
                    seen = (r["conv_id"],)
                    now = {
                        "conv_id": r["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0,
                        "least": None, "most": None, "last": None, "audit": [], "hash": hashlib.sha256(), "any": False,
                    }
                for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    now[c] += r[c]
                now["audit"].append(r["audit"])
                if r["n"]:
                    now["illegal"] += now["last"] is not None and now["last"] + r["first"] not in ("su", "ua", "au")
                    now["last"] = r["last"]
                if r["least"] is not None:
                    # Runs come in order of turns, so only the turn between two of them can be counted twice.
                    now["turns"] -= now["most"] == r["least"]
                    now["least"] = r["least"] if now["least"] is None else now["least"]
                    now["most"] = r["most"]
                left = _lines(replay(r["audit"], r["entry"], r["roles"], r["texts"]))
                if left:
                    now["hash"].update((("\n" if now["any"] else "") + left).encode())
                    now["any"] = True
            if len(made) >= 1000:
                yield pa.RecordBatch.from_pylist(made, schema=target)
                made = []
        if now is not None:
            close()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=target)

    whole = pieces.filter("whole").mapInArrow(summed, schema)
    # Hashing is sequential, so a conversation is read by one task, run by run, and never held.
    cut = pieces.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "run").mapInArrow(summed, schema)
    return whole.unionByName(cut)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Rows damaged by the hash of conversation and turn, and which of them are gone."""
    told = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    rows = told.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"))
    return rows.drop("_copy"), F.col("gone")


def repaired(turns: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Digests of the conversations, damaged and repaired."""
    return digests(pieces(runs(*damaged(turns), run_rows=run_rows)))
