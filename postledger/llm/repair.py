"""Structure repair of conversations: cheapest edits by integer minima over big-integer weights."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_rows, type_of

#: Rows of a conversation are summarised in stretches of at most so many.
STRETCH_BITS = 9
_INITIALS = "sua"
#: States: nothing yet, after system, after user, after assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_TURN = (_USER, _USER, _ASSISTANT, _USER)  # what may be inserted or a row be made, by state
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_LETTERS = " DIKR"  # codes of audit letters, zero pads
_BITS = 3
_SPACE = r"\x20\x09-\x0D"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the damaged ``rows``; nulls of the key, the role and the text are one space."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn")).cast("binary")) % 20
    text = held("text")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(held("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).drop("again")


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with their place ``at`` in a common order, and a letter for initial and first fault.

    The order is by conversation, turn (nulls first), role and text. It is a
    range partitioning, so one long conversation spreads over many tasks.
    """
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    initial = F.substring("role", 1, 1)
    group = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = (F.when(~F.col("text").rlike(rf"[^{_SPACE}]"), 3).when(F.col("seen") > 1, 2)
             .when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), 1).otherwise(0))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    # the start of the text keeps the bounds of the ranges short; it orders as the text does
    return (rows.withColumn("seen", seen).withColumn("letter", F.chr(65 + 4 * group + fault))
            .repartitionByRange(*keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text", "seen")
            .select("conv_id", "role", "text", "letter", F.monotonically_increasing_id().alias("at")))


def _before(letter: str, cost: int, weight: int, width: int) -> int:
    """The weight of an edit followed by edits of ``weight``: costs add above ``width`` bits, letters move down by one place."""
    return (cost + (weight >> width) << width) | _LETTERS.index(letter) << width - _BITS | (weight & (1 << width) - 1) >> _BITS


@lru_cache(maxsize=1 << 12)
def stretch_paths(letters: str) -> tuple[tuple[tuple[int, int, str, int] | None, ...], ...]:
    """For each state before and after a stretch of rows, the cheapest edits: (cost, audit as a number, audit, letters).

    Nodes of the graph are (row, state). A weight is one integer: the cost in
    the high digits, then the letters of the edits to the end of the stretch
    in digits of three bits, first letter highest, zeros behind the last. The
    integer minimum is thus the cheapest and, among those, the ASCII-least.
    Inserted turns stand before a row; more than two in a row never pay.
    """
    width = _BITS * 3 * len(letters)
    table = [[None] * 4 for _ in range(4)]
    for end in range(4):
        after: list[int | None] = [0 if s == end else None for s in range(4)]
        for x in reversed(letters):
            group, fault = divmod(ord(x) - 65, 4)
            here = []
            for s in range(4):
                options = [(after[s], "D", 3)]
                if fault < 2:
                    if group == 0 and s == _START or group == 1 and s != _USER or group == 2 and s == _USER:
                        options.append((after[group + 1], "K", fault))
                    options.append((after[_TURN[s]], "R", 2 + fault))
                here.append(min((_before(letter, cost, w, width) for w, letter, cost in options if w is not None), default=None))
            after = []
            for s in range(4):
                t = _TURN[s]
                once = None if here[t] is None else _before("I", 2, here[t], width)
                twice = None if here[_TURN[t]] is None else _before("I", 2, _before("I", 2, here[_TURN[t]], width), width)
                after.append(min((w for w in (here[s], once, twice) if w is not None), default=None))
        for s in range(4):
            if after[s] is not None:
                digits = after[s] & (1 << width) - 1
                places = [digits >> at & 7 for at in range(width - _BITS, -1, -_BITS)]
                audit = "".join(_LETTERS[d] for d in places if d)
                table[s][end] = (after[s] >> width, digits >> width - _BITS * len(audit), audit, len(audit))
    return tuple(map(tuple, table))


#: The repair as SQL. States 0 to 3 are nothing yet, after system, user and assistant. ``ways`` lists what may be done
#: about a row of each initial; the recursion keeps the least (cost, audit) for each state, row by row.
REPAIR_SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k
  FROM conversations),
keyed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(k) + 1), lambda i: ('0x' || substr(hex(k), 2 * i - 1, 2))::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
      lambda c, j: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) % 20 AS kind
  FROM base),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS again
  FROM keyed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS seen
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
faulty AS (
  SELECT *, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) || left(role, 1) AS pair
  FROM placed),
follow(s, t) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
inserts AS (
  SELECT s, s AS t, '' AS e, '' AS lines, 0 AS cost FROM follow
  UNION ALL SELECT s, t, 'I', CASE t WHEN 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END, 2 FROM follow
  UNION ALL SELECT a.s, b.t, 'II', CASE a.t WHEN 2 THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || 'assistant:' || chr(10) || 'user:' END, 4
  FROM follow a JOIN follow b ON a.t = b.s),
edits AS (
  SELECT s, initial, s AS t, 'D' AS e, 3 AS cost FROM follow, (VALUES (1), (2), (3), (4)) i(initial)
  UNION ALL SELECT s, initial, t, 'R', 2 FROM follow, (VALUES (1), (2), (3), (4)) i(initial)
  UNION ALL SELECT s, initial, initial, 'K', 0 FROM (VALUES (0, 1), (0, 2), (1, 2), (2, 3), (3, 2)) k(s, initial)),
ways AS (
  SELECT n.s, d.initial, d.t, n.e || d.e AS e, d.e AS last, n.lines, n.cost + d.cost AS cost FROM inserts n JOIN edits d ON n.t = d.s),
walk AS (
  SELECT DISTINCT conv, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS out FROM faulty
  UNION ALL
  SELECT conv, i, s, cost, audit, out FROM (
    SELECT w.conv, f.i, y.t AS s, w.cost + y.cost + CASE WHEN f.fault = 'truncated' AND y.last <> 'D' THEN 1 ELSE 0 END AS cost,
           w.audit || y.e AS audit,
           w.out || y.lines || CASE y.last WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
             ELSE chr(10) || CASE y.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text END AS out,
           row_number() OVER (PARTITION BY w.conv, y.t
             ORDER BY w.cost + y.cost + CASE WHEN f.fault = 'truncated' AND y.last <> 'D' THEN 1 ELSE 0 END, w.audit || y.e) AS k
    FROM walk w JOIN faulty f ON f.conv = w.conv AND f.i = w.i + 1
    JOIN ways y ON y.s = w.s AND y.initial = f.initial AND (y.last = 'D' OR f.fault NOT IN ('blank', 'duplicate')))
  WHERE k = 1),
facts AS (
  SELECT conv, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv),
closed AS (
  SELECT f.conv_id, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, w.cost + n.cost AS cost, w.audit || n.e AS audit, w.out || n.lines AS out,
         row_number() OVER (PARTITION BY f.conv ORDER BY w.cost + n.cost, w.audit || n.e) AS k
  FROM facts f JOIN walk w ON w.conv = f.conv AND w.i = f.n JOIN inserts n ON n.s = w.s AND n.t IN (0, 3))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(substr(coalesce(out, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN closed c ON c.k = 1 AND c.conv_id IS NOT DISTINCT FROM o.conv_id
"""

#: Closing inserts by the state after the last row: (cost, audit as a number, audit, letters).
_CLOSING = ((0, 0, "", 0), (4, 0o22, "II", 2), (2, 0o2, "I", 1), (0, 0, "", 0))


def _decide(conversation: list[tuple[int, str]]) -> tuple[list[tuple[int, int, str]], int]:
    """``(stretch, state before it, its edits)`` of a conversation's stretches (last one first), and the cost.

    The same minimum over stretches as over rows: (stretch, state) are the
    nodes and a weight joins the letters of a stretch with those that follow.
    """
    rest = list(_CLOSING)
    choices = []
    for _, letters in conversation:
        new, chosen = [], []
        for row in stretch_paths(letters):
            ways = [(p[0] + rest[t][0], p[3] + rest[t][3], p, t) for t, p in enumerate(row) if p is not None]
            longest = max(n for _, n, _, _ in ways)
            digits = [(p[1] << _BITS * rest[t][3] | rest[t][1], n, p, t, cost) for cost, n, p, t in ways]
            weights = [cost << _BITS * longest | d << _BITS * (longest - n) for d, n, p, t, cost in digits]
            d, n, p, t, cost = digits[min(range(len(ways)), key=weights.__getitem__)]
            new.append((cost, d, None, n))
            chosen.append((p[2], t))
        rest = new
        choices.append(chosen)
    state, out = _START, []
    for (at, _), chosen in zip(reversed(conversation), reversed(choices)):
        edits, after = chosen[state]
        out.append((at, state, edits))
        state = after
    if out:
        at, before, edits = out[-1]
        out[-1] = at, before, edits + _CLOSING[state][2]
    return out, rest[_START][0]


def _faults(conversation: list[tuple[int, str]]) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials do not follow each other."""
    blank = duplicate = truncated = illegal = 0
    last = None
    for _, letters in reversed(conversation):
        for x in letters:
            group, fault = divmod(ord(x) - 65, 4)
            blank += fault == 3
            duplicate += fault == 2
            truncated += fault == 1
            illegal += last is not None and (last, group) not in ((0, 1), (1, 2), (2, 1))
            last = group
    return blank, duplicate, truncated, illegal


def render(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The lines of a repaired stretch: ``edits`` applied to its (role, text) ``rows`` from ``state`` on."""
    for e in edits:
        role, text = (None, "") if e == "I" else next(rows)
        if e == "D":
            continue
        if e == "K":
            state = _INITIALS.index(role[0]) + 1
        else:
            state = _TURN[state]
            role = _ROLES[state]
        yield f"{role}:{text}"


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired text of every conversation, after ``damage``.

    Gives one row for each conv_id of ``conversations`` (conv_id, turn, role,
    text), null included: gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. Rows are taken by turn, nulls first; rows of one
    turn by role and text, so repeated rows are interchangeable. Roles that
    begin with none of s, u, a cannot be kept. Conversations of which no row is
    left have zeros, an empty audit and the hash of the empty string. Other
    columns are ignored; an empty table gives no rows.

    Rows are ordered by ranges, so that a long conversation spreads over tasks,
    and summarised in stretches of 512. A conversation's summaries (a few bytes for
    each row, as the audit itself) meet in one task; its text passes through one
    task as a stream, as SHA-256 demands.
    """
    kind = type_of(conversations, "conv_id")
    rows = cut_lineage(damage(conversations))
    ordered = cut_lineage(_ordered(rows).withColumn("stretch", F.shiftright("at", STRETCH_BITS)))
    inner = F.sort_array(F.collect_list(F.struct("at", "letter")))
    stretches = ordered.groupBy("conv_id", "stretch").agg(F.array_join(F.transform(inner, lambda x: x["letter"]), "").alias("letters"))

    def decide(batches) -> Iterator[dict[str, list]]:
        columns = ["conv_id", "stretch", "state", "edits", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        held: list[tuple[int, str]] = []
        name = None

        def close(out: list) -> None:
            parts, cost = _decide(held)
            out.extend((name, *p, *(None,) * 6) for p in parts)
            out.append((name, None, None, None, *_faults(held), cost, "".join(p[2] for p in parts)))
            held.clear()

        for ids, numbers, letters in batches:
            out: list[tuple] = []
            for c, k, x in zip(ids, numbers, letters):
                if held and c != name:
                    close(out)
                name = c
                held.append((k, x))
            yield dict(zip(columns, map(list, zip(*out)))) if out else {c: [] for c in columns}
        if held:
            out = []
            close(out)
            yield dict(zip(columns, map(list, zip(*out))))

    decided = cut_lineage(map_rows(
        stretches.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("stretch").desc()),
        [("conv_id", kind), ("stretch", "long"), ("state", "int"), ("edits", "string"), ("blank", "long"), ("duplicate", "long"),
         ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string")], decide))
    parts = decided.filter("stretch is not null").select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), "state", "edits")

    def digest(batches) -> Iterator[dict[str, list]]:
        name, stretch, sha, lines = None, None, None, None
        left: list[tuple[str, str]] = []

        def end_stretch() -> None:
            # edits of a stretch refer to its rows, of which there are at most 512
            for line in render(lines[0], lines[1], iter(left)):
                sha[0].update(("\n" if sha[1] else "").encode() + line.encode("utf-8"))
                sha[1] = True
            left.clear()

        for ids, numbers, states, edits, roles, texts in batches:
            out = []
            for c, k, s, e, role, text in zip(ids, numbers, states, edits, roles, texts):
                if sha is not None and (c != name or k != stretch):
                    end_stretch()
                    if c != name:
                        out.append((name, sha[0].hexdigest()))
                        sha = None
                if sha is None:
                    sha = [hashlib.sha256(), False]
                name, stretch, lines = c, k, (e, s)
                left.append((role, text))
            yield {"conv_id": [c for c, _ in out], "repaired_sha256": [h for _, h in out]}
        if sha is not None:
            end_stretch()
            yield {"conv_id": [name], "repaired_sha256": [sha[0].hexdigest()]}

    edited = ordered.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")))
    hashes = map_rows(
        edited.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "stretch", "state", "edits", "role", "text"),
        [("conv_id", kind), ("repaired_sha256", "string")], digest)

    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    whole = conversations.select("conv_id").distinct()
    found = decided.filter("stretch is null").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    for side in (turns, found, hashes):
        side = side.withColumnRenamed("conv_id", "c")
        whole = whole.join(side, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.fillna(0, numbers).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}).select("conv_id", *numbers, "audit", "repaired_sha256")
