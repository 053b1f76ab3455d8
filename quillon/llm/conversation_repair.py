r"""Repair of a conversation's turns by a bidirectional tight-arc DAG.

Rows of a conversation, in order, are read by an automaton of four states for `(s?(ua)+)?`. Forward minimum costs reach every
(row, state), backward minimum costs lead from it to the end; an arc is optimal, tight, where the two and its own cost give
the total. A frontier of states walks the tight arcs and takes the least edit letter at each step (D < I < K < R), so the
audit is the ASCII-least of all cheapest ones. A letter and a state have one successor, so a frontier stays one state wide.

No conversation need fit a task. All rows are range-partitioned in order and cut into blocks of bounded rows and bytes. The
part of a conversation in a block is a 4 x 4 matrix of least costs between its ends; a conversation in several blocks is
chained through its matrices (one row a block), which gives each part the costs at its ends, then through the parts' exits,
which gives each its first state; every block is then repaired by itself. Only the hash of a conversation's repaired text is
taken in order by one task, as SHA-256 must be, over a stream of pieces that are never held together.

Defined cases: rows of one turn are taken by role, then text (both bytewise); a null conv_id is a conversation; null turns
come first; null roles and texts are one space; an initial is the role's first character as it stands; a row
with an empty role has none and cannot be kept;
very long texts are a block of their own; equal rows are duplicates of the first; an empty table gives an empty result; other
columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from ._common import _settings, forget, tidied, tidy, written

REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: Rows and bytes of text of a block.
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
FAR = 1 << 50
NO_TEXT = hashlib.sha256(b"").hexdigest()
SPACES = " \t\n\x0b\x0c\r"

#: States: nothing written, a system row, a user row, an assistant row written last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row that the repair may choose the role of.
THEN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What a row is: sound, to be deleted, cut short.
SOUND, GONE, SHORT = range(3)


def inserted(costs: list[int]) -> list[int]:
    """Least costs once rows may have been inserted."""
    start, system, user, assistant = costs
    user = min(user, start + INSERT, system + INSERT, assistant + INSERT)
    return [start, system, user, min(assistant, user + INSERT)]


def arcs(state: int, initial: str, kind: int):
    """(letter, next state, cost) of a row."""
    yield "D", state, DELETE
    if kind != GONE:
        extra = CUT_SHORT if kind == SHORT else 0
        if (state, initial) in KEEPS:
            yield "K", KEEPS[state, initial], extra
        yield "R", THEN[state], REROLE + extra


def consumed(costs: list[int], initial: str, kind: int) -> list[int]:
    out = [FAR] * 4
    for state, cost in enumerate(costs):
        if cost < FAR:
            for _, to, more in arcs(state, initial, kind):
                out[to] = min(out[to], cost + more)
    return out


def ending() -> list[int]:
    """Least costs from each state to the end, behind the last row."""
    return [0, 2 * INSERT, INSERT, 0]


def matrix(rows: list[tuple[str, int]]) -> list[list[int]]:
    """Least costs from each state before the rows to each behind them, without what is inserted behind them."""
    out = []
    for state in range(4):
        costs = [FAR] * 4
        costs[state] = 0
        for initial, kind in rows:
            costs = consumed(inserted(costs), initial, kind)
        out.append(costs)
    return out


def tables(rows: list[tuple[str, int]], entry: list[int], after: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """Forward and backward least costs at every place of the rows, given those at both ends."""
    forward = [inserted(entry)]
    for initial, kind in rows:
        forward.append(inserted(consumed(forward[-1], initial, kind)))
    backward = [after]
    for initial, kind in reversed(rows):
        costs = [min((more + backward[-1][to] for _, to, more in arcs(state, initial, kind)), default=FAR) for state in range(4)]
        costs[ASSISTANT] = min(costs[ASSISTANT], INSERT + costs[USER])
        costs[USER] = min(costs[USER], INSERT + costs[ASSISTANT])
        costs[START], costs[SYSTEM] = min(costs[START], INSERT + costs[USER]), min(costs[SYSTEM], INSERT + costs[USER])
        backward.append(costs)
    return forward, backward[::-1]


def walk(rows: list[tuple[str, int]], forward: list[list[int]], backward: list[list[int]], total: int, frontier: set[int], last: bool) -> tuple[list[tuple[str, int]], set[int]]:
    """(letter, state reached) along the least audit from the frontier, and the frontier behind the rows. In the last part
    the walk goes on until the conversation may end."""
    path, at = [], 0
    while True:
        here, later = forward[at], backward[at]
        if at == len(rows) and (not last or any(s in (START, ASSISTANT) and here[s] == total for s in frontier)):
            return path, frontier
        tight: dict[str, set[int]] = {}
        for state in frontier:
            to = THEN[state]
            if here[state] + INSERT + later[to] == total:
                tight.setdefault("I", set()).add(to)
            if at < len(rows):
                for letter, to, more in arcs(state, *rows[at]):
                    if here[state] + more + backward[at + 1][to] == total:
                        tight.setdefault(letter, set()).add(to)
        letter = min(tight)
        frontier = tight[letter]
        path.append((letter, min(frontier)))
        at += letter != "I"


def repaired(path: list[tuple[str, int]], roles: list[str], texts: list[str]) -> list[str]:
    """The lines `role:text` that the edits leave."""
    out, at = [], 0
    for letter, state in path:
        if letter == "I":
            out.append(f"{ROLE[state]}:")
            continue
        if letter != "D":
            out.append(f"{roles[at] if letter == 'K' else ROLE[state]}:{texts[at]}")
        at += 1
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with their damage: conv_id, turn, role, text, copies (0: dropped, 2: repeated)."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.pmod(F.crc32(key), F.lit(20)).alias("q"))
    text = F.when(F.col("q") == 1, "").when(F.col("q") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("q") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("q") == 0, 0).when(F.col("q") == 3, 2).otherwise(1).alias("copies"))


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows in order of conv_id, turn, role and text, each with its place `at` and its block, as a table."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    names = ["conv_id", "role", "text", "initial", "blank", "short"]

    def number(batches):
        base, n, size = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            lengths = np.asarray(pc.binary_length(batch.column(2)), np.int64)
            count, sizes = n + np.arange(len(lengths)), size + np.cumsum(lengths)
            block = count // BLOCK_ROWS + sizes // BLOCK_BYTES
            n, size = n + len(lengths), int(sizes[-1]) if len(sizes) else size
            yield pa.RecordBatch.from_arrays([pa.array(base + block), pa.array(base + count), *[batch.column(k) for k in range(len(names))]], names=["block", "at", *names])

    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text").select(*names)
    kind = dict(ranged.dtypes)
    return written(ranged.mapInArrow(tidy(number), "block long, at long, " + ", ".join(f"{c} {kind[c]}" for c in names)), "conversation-rows")


def _segments(rows: pa.Table, marks: pa.Table):
    """For each conversation of a block: id, place of the first row, and the slice of the sorted rows; the rows' initials and
    kinds; which rows are duplicates."""
    rows = rows.sort_by("at")
    at, ids = np.asarray(rows.column("at")), rows.column("conv_id").to_pylist()
    twice = np.isin(at, np.asarray(marks.filter(marks.column("start").is_null()).column("at"), np.int64))
    blank, short = np.asarray(rows.column("blank")), np.asarray(rows.column("short"))
    kinds = np.where(blank | twice, GONE, np.where(short, SHORT, SOUND)).tolist()
    read = list(zip(rows.column("initial").to_pylist(), kinds, strict=True))
    edges = [0, *[k for k in range(1, len(ids)) if ids[k] != ids[k - 1]], len(ids)]
    return rows, at, twice, read, [(ids[a], int(at[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]


#: Beside the rows of a block: places of duplicates (start null), and for a part of a split conversation its start and ends.
MARK = "block long, at long, start long, entry array<long>, after array<long>, total long, before string, state int, last boolean"


def _none(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = conversations.sparkSession
    hurt = damaged(conversations)
    conv = hurt.schema["conv_id"]
    kind = conv.dataType.simpleString()
    alive = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = F.coalesce(F.max(alive) - F.min(alive) + 1 - F.countDistinct(alive), F.lit(0)).cast("long")
    everyone = hurt.groupBy("conv_id").agg(gaps.alias("gaps"))

    rows = hurt.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "blank": trimmed == "", "short": (trimmed != "") & ~F.substring(trimmed, -1, 1).isin(".", "!", "?")})
    table = _blocks(rows)

    # Duplicates: all but the first place of equal role and text in a conversation.
    said = table.filter("NOT blank").select("block", "at", "conv_id", "role", F.sha2("text", 256).alias("digest"))
    first = said.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    twice = written(said.select("block", "at").join(first, "at", "left").filter("first IS NULL").select("block", "at"), "conversation-twice")
    marks = twice.select("block", "at", *[F.lit(None).cast(k).alias(n) for n, k in (x.split(" ") for x in MARK.split(", ")[2:])])

    # Parts at the edges of blocks, chained where a conversation has several.
    def ends(_, rows, marks):
        rows, _, _, read, parts = _segments(rows, marks)
        parts = parts[:1] + parts[1:][-1:]
        return pa.table({
            "conv_id": rows.column("conv_id").combine_chunks().take(pa.array([a for _, _, a, _ in parts], pa.int64())), "block": rows.column("block").combine_chunks().slice(0, 1).take(pa.array([0] * len(parts))), "start": pa.array([s for _, s, _, _ in parts], pa.int64()),
            "costs": pa.array([sum(matrix(read[a:b]), []) for _, _, a, b in parts], pa.list_(pa.int64())), "final": pa.array([read[b - 1][0] for *_, b in parts], pa.string()),
        })

    light = table.select("block", "at", "conv_id", "initial", "blank", "short")
    shape = f"conv_id {kind}, block long, start long, costs array<long>, final string"
    edge = light.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda k, a, b: tidied(ends, k, a, b), shape)

    def chain(part):
        part = part.sort_by("start")
        costs = [np.array(c, np.int64).reshape(4, 4) for c in part.column("costs").to_pylist()]
        n = len(costs) if len(costs) > 1 else 0
        entry, after = [np.array([0, FAR, FAR, FAR])], [np.array(ending())]
        for m in costs[:n]:
            entry.append(np.minimum((entry[-1][:, None] + m).min(axis=0), FAR))
        for m in costs[:n][::-1]:
            after.append(np.minimum((m + after[-1][None, :]).min(axis=1), FAR))
        total = int(after[-1][START])
        before = [None, *part.column("final").to_pylist()]
        return pa.table({
            "conv_id": part.column("conv_id").slice(0, n), "block": part.column("block").slice(0, n), "at": _none(n, pa.int64()), "start": part.column("start").slice(0, n), "entry": pa.array([e.tolist() for e in entry[:n]], pa.list_(pa.int64())),
            "after": pa.array([a.tolist() for a in after[::-1][1 : n + 1]], pa.list_(pa.int64())), "total": pa.array([total] * n, pa.int64()), "before": pa.array(before[:n], pa.string()), "state": _none(n, pa.int32()), "last": pa.array([k == n - 1 for k in range(n)], pa.bool_()),
        })

    split = written(edge.groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, {MARK}"), "conversation-parts")
    bare = split.drop("conv_id")

    # The state each part is left in, for every state it may be entered in; then the state it is entered in.
    def leave(_, rows, marks):
        rows, _, _, read, parts = _segments(rows, marks)
        given = {m["start"]: m for m in marks.to_pylist() if m["start"] is not None}
        own = [(s, a, b) for _, s, a, b in parts if s in given]
        exits = []
        for s, a, b in own:
            m = given[s]
            forward, backward = tables(read[a:b], m["entry"], m["after"])
            exits.append([min(walk(read[a:b], forward, backward, m["total"], {q}, m["last"])[1]) if forward[0][q] + backward[0][q] == m["total"] else -1 for q in range(4)])
        ids = rows.column("conv_id").combine_chunks().take(pa.array([a for _, a, _ in own], pa.int64()))
        return pa.table({"conv_id": ids, "start": pa.array([s for s, _, _ in own], pa.int64()), "exits": pa.array(exits, pa.list_(pa.int32()))})

    torn = light.join(bare.select("block").distinct(), "block", "left_semi")
    both = marks.join(bare.select("block").distinct(), "block", "left_semi").unionByName(bare)
    left = torn.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(lambda k, a, b: tidied(leave, k, a, b), f"conv_id {kind}, start long, exits array<int>")

    def follow(part):
        part = part.sort_by("start")
        states = [START]
        for exits in part.column("exits").to_pylist():
            states.append(exits[states[-1]])
        return pa.table({"start": part.column("start"), "entered": pa.array(states[:-1], pa.int32())})

    entered = written(left.groupBy("conv_id").applyInArrow(follow, "start long, entered int"), "conversation-states")
    known = bare.join(entered, "start").withColumn("state", F.col("entered")).drop("entered").select(*marks.columns)

    # Every block by itself.
    def mend(_, rows, marks):
        rows, _, twice, read, parts = _segments(rows, marks)
        given = {m["start"]: m for m in marks.to_pylist() if m["start"] is not None}
        blank, short = np.asarray(rows.column("blank")), np.asarray(rows.column("short"))
        roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
        out = []
        for _, s, a, b in parts:
            m = given.get(s)
            forward, backward = tables(read[a:b], m["entry"] if m else [0, FAR, FAR, FAR], m["after"] if m else ending())
            total = m["total"] if m else backward[0][START]
            path, _ = walk(read[a:b], forward, backward, total, {m["state"] if m else START}, m["last"] if m else True)
            pairs = [(m["before"] if m else None), *[i for i, _ in read[a:b]]]
            illegal = sum(p is not None and p + q not in ("su", "ua", "au") for p, q in zip(pairs, pairs[1:], strict=False))
            body = "\n".join(repaired(path, roles[a:b], texts[a:b])).encode()
            gone, late = twice[a:b] & ~blank[a:b], short[a:b] & ~twice[a:b]
            out.append((s, not m, int(blank[a:b].sum()), int(gone.sum()), int(late.sum()), illegal, total, "".join(x for x, _ in path), None if not m else body, hashlib.sha256(body).hexdigest() if not m else None))
        ids = rows.column("conv_id").combine_chunks().take(pa.array([a for _, _, a, _ in parts], pa.int64()))
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.string()]
        return pa.Table.from_arrays([ids, *[pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=[f.name for f in done.fields])

    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    done = StructType([conv, StructField("start", LongType()), StructField("whole", BooleanType()), *[StructField(c, LongType()) for c in counts], StructField("audit", StringType()), StructField("body", BinaryType()), StructField("repaired_sha256", StringType())])
    with _settings(spark, maxRecordsPerBatch=2000, maxBytesPerBatch=4 << 20):
        blocks = table.groupBy("block").cogroup(marks.unionByName(known).groupBy("block")).applyInArrow(lambda k, a, b: tidied(mend, k, a, b), done)
        pieces = written(blocks, "conversation-pieces")
    forget(table, twice, split, entered)

    # Split conversations: their pieces in order, one stream a task.
    def join_pieces(batches):
        def flush():
            return pa.RecordBatch.from_arrays([now, *[pa.array([v], pa.int64()) for v in sums], pa.array(["".join(audit)], pa.large_string()).cast(pa.string()), pa.array([digest.hexdigest()])], names=["conv_id", *counts, "audit", "repaired_sha256"])

        now, sums, audit, digest, some = None, None, None, None, False
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                own = batch.column(0).slice(k, 1)
                if now is None or own[0].as_py() != now[0].as_py():
                    if now is not None:
                        yield flush()
                    now, sums, audit, digest, some = own, [0] * 5, [], hashlib.sha256(), False
                sums = [*[a + row[c] for a, c in zip(sums[:4], counts[:4], strict=True)], row["cost"]]
                audit.append(row["audit"])
                if row["body"]:
                    digest.update(b"\n" * some + row["body"])
                    some = True
        if now is not None:
            yield flush()

    result = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    parts = pieces.filter("NOT whole").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "start")
    joined = parts.select("conv_id", *counts, "audit", "body").mapInArrow(tidy(join_pieces), result)
    mended = pieces.filter("whole").select("conv_id", *counts, "audit", "repaired_sha256").unionByName(joined).withColumnRenamed("conv_id", "_c")
    return everyone.join(mended, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", "gaps", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NO_TEXT)).alias("repaired_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _sql() -> str:
    """Forward only: the least (cost, audit) of each state, row by row, as one string; then the rows that the audit leaves."""

    def add(key: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(substr({key}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}')"

    def closed(prefix: str) -> str:
        return f"SELECT * REPLACE (least(k3, {add('k2', '3', 'I')}) AS k3) FROM (SELECT * REPLACE (least(k2, {add('k0', '3', 'I')}, {add('k1', '3', 'I')}, {add('k3', '3', 'I')}) AS k2) FROM {prefix})"

    def row(key: str) -> str:
        return f"CASE WHEN kind < 3 THEN {add(key, '3 + extra', 'R')} END"

    def keep(key: str, initial: str) -> str:
        return f"CASE WHEN kind < 3 AND initial = '{initial}' THEN {add(key, 'extra', 'K')} END"

    user = ", ".join(f"{keep(k, 'u')}, {row(k)}" for k in ("k0", "k1", "k3"))
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return rf"""WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), coded AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT))), lambda c, b: {bits}), 4294967295) % 20 AS q FROM keyed
), hurt AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN q = 4 THEN 'user' ELSE role END AS role, CASE q WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN q = 3 THEN [1, 2] ELSE [1] END) FROM coded WHERE q <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again FROM (
    SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM hurt)
), judged AS MATERIALIZED (
  SELECT *, CASE WHEN kind = 2 THEN 3 ELSE 0 END AS extra, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 4 WHEN again > 1 THEN 3 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 2 ELSE 1 END AS kind FROM numbered)
), walked AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, '000000000' AS k0, CAST(NULL AS VARCHAR) AS k1, CAST(NULL AS VARCHAR) AS k2, CAST(NULL AS VARCHAR) AS k3 FROM judged
  UNION ALL
  SELECT conv_id, n, {add('k0', '4', 'D')}, least({add('k1', '4', 'D')}, {keep('k0', 's')}), least({add('k2', '4', 'D')}, {user}), least({add('k3', '4', 'D')}, {keep('k2', 'a')}, {row('k2')})
  FROM ({closed("(SELECT w.conv_id, j.n, k0, k1, k2, k3, initial, kind, extra FROM walked w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.n + 1)")})
), best AS MATERIALIZED (
  SELECT conv_id, least(k0, k3) AS k FROM ({closed("(SELECT conv_id, k0, k1, k2, k3 FROM walked QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)")})
), letters AS (
  SELECT conv_id, substr(k, 9 + i, 1) AS letter, i FROM (SELECT conv_id, k, unnest(range(1, length(k) - 8)) AS i FROM best)
), placed AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS n, count(*) FILTER (letter <> 'D') OVER w AS p FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), lines AS (
  SELECT l.conv_id, l.i, l.letter, l.p - max(CASE WHEN l.p = 1 AND l.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS p, j.role, CASE WHEN l.letter = 'I' THEN '' ELSE j.text END AS text
  FROM placed l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.n = l.n WHERE l.letter <> 'D'
), bodies AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN p % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS body FROM lines GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 4) AS blank, count(*) FILTER (kind = 3) AS duplicate, count(*) FILTER (kind = 2) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(substr(k, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(k, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN bodies t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""  # fmt: skip


OP13_SQL = _sql()
