"""Conversation structure repair: the cheapest edits that make the roles of a conversation take turns.

The rows of a conversation are one symbol each, of role and fault. Equal neighbours are collapsed to runs, a run
is advanced through the binary powers of its symbol's min-plus transition between four states (nothing yet, after
system, after user, after assistant), and the choices are unrolled forwards, each the ASCII-least that still
reaches the cheapest end.

Rows are dealt to tasks by ranges of (conversation, turn), so a conversation of any length is spread over many tasks. One
that lies within a task is repaired there. The others are cut into pieces; only a 4 x 4 matrix and a few
numbers of each piece meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b, sha256
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import in_tasks, saved

#: A piece of a conversation that is too long for one task, or that may reach into another.
PIECE_ROWS = 1 << 15
PIECE_CHARS = 1 << 21

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 60
# States: nothing yet, after system, after user, after assistant. Inserting or reroling leads to the only fitting role.
NEXT = (2, 2, 3, 2)
ROLE = (None, None, "user", "assistant")
END = (0, 2 * INSERT, INSERT, 0)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = {"su", "ua", "au"}
# Symbols: "-" must go; else the role's initial (or "o"), upper case if the text is truncated.
MUST_GO = "-"

NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def edges(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row in ASCII order: initial, state after it, cost."""
    out = [("D", state, DELETE)]
    if symbol == MUST_GO:
        return out
    extra = TRUNCATED if symbol.isupper() else 0
    after = KEPT.get(symbol.lower(), {}).get(state)
    if after is not None:
        out.append(("K", after, KEEP + extra))
    out.append(("R", NEXT[state], REROLE + extra))
    return out


def inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs to the end if rows may be inserted first."""
    user, assistant = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return min(costs[0], INSERT + user), min(costs[1], INSERT + user), user, assistant


@cache
def power(symbol: str, k: int) -> tuple[tuple[int, ...], ...]:
    """Cheapest ways from state to state over 2^k rows of one symbol, insertions before each row included."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    columns = []
    for goal in range(4):
        columns.append(inserted([min((cost for _, to, cost in edges(symbol, s) if to == goal), default=NEVER) for s in range(4)]))
    return tuple(tuple(columns[goal][s] for goal in range(4)) for s in range(4))


def product(a, b):
    return tuple(tuple(min(row[k] + b[k][j] for k in range(4)) for j in range(4)) for row in a)


def before(matrix, costs):
    """Costs to the end before the rows of `matrix`, from those after them."""
    return tuple(min(row[k] + costs[k] for k in range(4)) for row in matrix)


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def run_powers(symbol: str, length: int):
    k = 0
    while length:
        if length & 1:
            yield power(symbol, k)
        length >>= 1
        k += 1


def segment_matrix(symbols: str):
    out = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))
    for symbol, length in runs(symbols):
        for matrix in run_powers(symbol, length):
            out = product(out, matrix)
    return out


@cache
def choices(symbol: str, after: tuple[int, ...]):
    """For costs after a row, less their minimum: costs before it, and for each state the edits and the state they lead to."""
    best = inserted([min(cost + after[to] for _, to, cost in edges(symbol, s)) for s in range(4)])

    def unrolled(state: int) -> tuple[str, int]:
        edits = ""
        while True:
            options = [(e, to) for e, to, cost in edges(symbol, state) if cost + after[to] == best[state]]
            if options and options[0][0] == "D":
                return edits + "D", options[0][1]
            if INSERT + best[NEXT[state]] == best[state]:
                edits, state = edits + "I", NEXT[state]
            else:
                return edits + options[0][0], options[0][1]

    return best, tuple(unrolled(s) for s in range(4))


def unroll(symbols: str, after: tuple[int, ...]) -> list:
    """The choices of every row, first row first; run borders come from the powers, rows inside a run from their successors."""
    steps: list = []
    for symbol, length in reversed(runs(symbols)):
        border = after
        for matrix in run_powers(symbol, length):
            border = before(matrix, border)
        for _ in range(length):
            low = min(after)
            after, moves = choices(symbol, tuple(c - low for c in after))
            steps.append(moves)
        after = border
    steps.reverse()
    return steps


def costs_before(symbols: str, after: tuple[int, ...]) -> tuple[int, ...]:
    for symbol, length in reversed(runs(symbols)):
        for matrix in run_powers(symbol, length):
            after = before(matrix, after)
    return after


def symbols_of(roles: list[str], texts: list[str], seen: set) -> tuple[str, int, int, int]:
    """Symbols and the numbers of blank, duplicate and truncated rows; `seen` holds role and text of the rows so far."""
    out, blank, duplicate, truncated = [], 0, 0, 0
    for role, text in zip(roles, texts):
        shown = text.rstrip(SPACE)
        if not shown:
            out.append(MUST_GO)
            blank += 1
            continue
        mark = digest(role, text)
        if mark in seen:
            out.append(MUST_GO)
            duplicate += 1
            continue
        seen.add(mark)
        symbol = role[:1] if role[:1] in KEPT else "o"
        if shown[-1] not in ".!?":
            truncated += 1
            symbol = symbol.upper()
        out.append(symbol)
    return "".join(out), blank, duplicate, truncated


def digest(role: str, text: str) -> bytes:
    return blake2b(role.encode() + b"\0" + text.encode(), digest_size=16).digest()


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))


def applied(steps: list, state: int, roles: list[str], texts: list[str], last: bool) -> tuple[str, int, list[str], list[str]]:
    """Edits, state at the end, and the repaired roles and texts."""
    audit, new_roles, new_texts = [], [], []
    for moves, role, text in zip(steps, roles, texts):
        edits, after = moves[state]
        for edit in edits[:-1]:
            state = NEXT[state]
            new_roles.append(ROLE[state]), new_texts.append("")
        if edits[-1] != "D":
            new_roles.append(role if edits[-1] == "K" else ROLE[after]), new_texts.append(text)
        audit.append(edits)
        state = after
    while last and END[state]:
        state = NEXT[state]
        audit.append("I"), new_roles.append(ROLE[state]), new_texts.append("")
    return "".join(audit), state, new_roles, new_texts


def lines_of(roles: list[str], texts: list[str]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in zip(roles, texts)).encode()


def turn_gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


# ── tasks ─────────────────────────────────────────────────────────────────────

def _whole(turns, roles, texts) -> dict:
    symbols, blank, duplicate, truncated = symbols_of(roles, texts, set())
    audit, _, new_roles, new_texts = applied(unroll(symbols, END), 0, roles, texts, True)
    return {
        "gaps": turn_gaps(turns), "blank": blank, "duplicate": duplicate, "truncated": truncated,
        "illegal": illegal_pairs(roles), "cost": costs_before(symbols, END)[0], "audit": audit,
        "repaired_sha256": sha256(lines_of(new_roles, new_texts)).hexdigest(), "roles": new_roles, "texts": new_texts}


def first_pass(schema: pa.Schema, with_texts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that lie within this task repaired, and pieces of those that may not, from sorted rows."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out: list[dict] = []
    held: tuple[list, list, list] = ([], [], [])
    now, first, pieces, chars, weight = None, True, 0, 0, 0

    def put(row: dict) -> None:
        nonlocal weight
        weight += 64 + sum(map(len, row.get("texts") or ()))
        out.append({"conv": now[0], "conv_id": now[1]} | row)

    def piece() -> None:
        nonlocal pieces, chars, held
        put({"place": (part << 32) + pieces, "turns": held[0], "roles": held[1], "texts": held[2]})
        pieces, chars, held = pieces + 1, 0, ([], [], [])

    def close(last: bool) -> None:
        nonlocal first, pieces, chars, held
        if first or last or pieces:
            piece()
        else:
            row = _whole(*held)
            put(row if with_texts else row | {"roles": None, "texts": None})
        first, pieces, chars, held = False, 0, 0, ([], [], [])

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal out, weight
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
        out, weight = [], 0

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv", "conv_id", "turn", "role", "text")]
        for conv, conv_id, turn, role, text in zip(*columns):
            if now is None or conv != now[0]:
                if now is not None:
                    close(False)
                now = (conv, conv_id)
            elif len(held[0]) >= PIECE_ROWS or chars >= PIECE_CHARS:
                piece()
            held[0].append(turn), held[1].append(role), held[2].append(text)
            chars += len(text)
            if weight >= PIECE_CHARS:
                yield from flushed()
    if now is not None:
        close(True)
    yield from flushed()


def piece_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which rows, by role and text, each piece holds."""
    for row in _rows(batches):
        marks = sorted({digest(r, t) for r, t in zip(row["roles"], row["texts"]) if t.rstrip(SPACE)})
        yield pa.RecordBatch.from_pydict({"conv": [row["conv"]], "place": [row["place"]], "marks": pa.array([marks], pa.list_(pa.binary()))})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def piece_symbols(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        symbols, blank, duplicate, truncated = symbols_of(row["roles"], row["texts"], set(row["known"] or ()))
        turns = [t for t in row["turns"] if t is not None]
        yield pa.RecordBatch.from_pylist([{
            "conv": row["conv"], "place": row["place"], "symbols": symbols, "blank": blank, "duplicate": duplicate,
            "truncated": truncated, "illegal": illegal_pairs(row["roles"]), "first_role": row["roles"][0][:1],
            "last_role": row["roles"][-1][:1], "first_turn": turns[0] if turns else None,
            "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
            "matrix": [cost for line in segment_matrix(symbols) for cost in line]}], schema)


def joined_pieces(group: pd.DataFrame) -> pd.DataFrame:
    """For the pieces of one conversation: the costs after each, and in the last one's row the numbers of all."""
    group = group.sort_values("place").reset_index(drop=True)
    after, costs = [], END
    for flat in reversed(group["matrix"].tolist()):
        after.append(list(costs))
        costs = before([tuple(int(c) for c in flat[i:i + 4]) for i in range(0, 16, 4)], costs)
    firsts, lasts = group["first_role"].tolist(), group["last_role"].tolist()
    spans = [(int(a), int(b), int(n)) for a, b, n in zip(group["first_turn"], group["last_turn"], group["turns"]) if n]
    distinct = sum(n for _, _, n in spans) - sum(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    last = pd.Series(range(len(group))) == len(group) - 1
    return pd.DataFrame({
        "conv": group["conv"], "place": group["place"], "after": after[::-1], "last": last,
        "gaps": spans[-1][1] - spans[0][0] + 1 - distinct if spans else 0,
        "blank": group["blank"].sum(), "duplicate": group["duplicate"].sum(), "truncated": group["truncated"].sum(),
        "illegal": group["illegal"].sum() + sum(a + b not in LEGAL for a, b in zip(lasts, firsts[1:])), "cost": costs[0]})


def piece_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state before a piece, the state that the chosen edits lead to after it."""
    for row in _rows(batches):
        exits = list(range(4))
        for moves in unroll(row["symbols"], tuple(row["after"])):
            exits = [moves[s][1] for s in exits]
        yield pa.RecordBatch.from_pydict({"conv": [row["conv"]], "place": [row["place"]], "exits": pa.array([exits], pa.list_(pa.int32()))})


def entered_pieces(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("place").reset_index(drop=True)
    state, entry = 0, []
    for exits in group["exits"]:
        entry.append(state)
        state = int(exits[state])
    return pd.DataFrame({"conv": group["conv"], "place": group["place"], "entry": entry})


def repaired_pieces(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        steps = unroll(row["symbols"], tuple(row["after"]))
        audit, _, roles, texts = applied(steps, row["entry"], row["roles"], row["texts"], row["last"])
        yield pa.RecordBatch.from_pylist([{n: row[n] for n in ("conv", "conv_id", "place", "last", *NUMBERS)} | {
            "audit": audit, "roles": roles, "texts": texts}], schema)


def closed_pieces(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces in order; the digest takes them one by one."""
    audit, hasher, begun = [], sha256(), False
    for row in _rows(batches):
        audit.append(row["audit"])
        if row["roles"]:
            hasher.update((b"\n" if begun else b"") + lines_of(row["roles"], row["texts"]))
            begun = True
        if row["last"]:
            yield pa.RecordBatch.from_pylist([{n: row[n] for n in ("conv", "conv_id", *NUMBERS)} | {
                "audit": "".join(audit), "repaired_sha256": hasher.hexdigest()}], schema)
            audit, hasher, begun = [], sha256(), False


# ── plan ──────────────────────────────────────────────────────────────────────

def _conv(conv_id: Column) -> Column:
    """The id as text that is never null."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _arrow(conv_id: str, fields: list[tuple[str, pa.DataType]], id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("conv", pa.string()), (conv_id, id_type), *fields])


def _ddl(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def _passes(conversations: DataFrame, with_texts: bool) -> tuple[DataFrame, DataFrame, pa.DataType]:
    """Rows of conversations repaired in one task, and repaired pieces of the others."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(conversations.schema["conv_id"].dataType)
    numbers = [(n, pa.int64()) for n in NUMBERS]
    lists = [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    rows = conversations.select(
        _conv(F.col("conv_id")).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["conv", "turn", "role", "_text"]
    dealt = rows.withColumns({"_text": F.xxhash64("text"), "_copy": F.monotonically_increasing_id()}) \
        .repartitionByRange(*order, "_copy").sortWithinPartitions(*order, "text")
    first = _arrow("conv_id", [("place", pa.int64()), ("turns", pa.list_(pa.int64())), *lists, *numbers,
                               ("audit", pa.string()), ("repaired_sha256", pa.string())], id_type)
    done = saved(dealt.select("conv", "conv_id", "turn", "role", "text")
                 .mapInArrow(in_tasks(first_pass, first, with_texts), _ddl(first)), "turns")
    whole, pieces = done.filter("place IS NULL"), done.filter("place IS NOT NULL").select(
        "conv", "conv_id", "place", "turns", "roles", "texts")

    marks = pieces.select("conv", "place", "roles", "texts").mapInArrow(
        in_tasks(piece_digests), "conv string, place long, marks array<binary>")
    later = marks.select("conv", "place", F.explode("marks").alias("mark")).groupBy("conv", "mark").agg(
        F.sort_array(F.collect_set("place")).alias("places")).filter(F.size("places") > 1)
    known = later.select("conv", F.explode(F.slice("places", F.lit(2), F.size("places"))).alias("place"), "mark") \
        .groupBy("conv", "place").agg(F.collect_list("mark").alias("known"))
    facts = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("symbols", pa.string()), ("blank", pa.int64()),
                       ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                       ("first_role", pa.string()), ("last_role", pa.string()), ("first_turn", pa.int64()),
                       ("last_turn", pa.int64()), ("turns", pa.int64()), ("matrix", pa.list_(pa.int64()))])
    segments = saved(pieces.join(known, ["conv", "place"], "left").mapInArrow(in_tasks(piece_symbols, facts), _ddl(facts)), "pieces")

    after = saved(segments.drop("symbols").groupBy("conv").applyInPandas(
        joined_pieces, "conv string, place long, after array<long>, last boolean, "
        + ", ".join(f"{n} long" for n in NUMBERS)), "after")
    ahead = segments.select("conv", "place", "symbols").join(after, ["conv", "place"])
    exits = ahead.select("conv", "place", "symbols", "after").mapInArrow(
        in_tasks(piece_exits), "conv string, place long, exits array<int>")
    entry = saved(exits.groupBy("conv").applyInPandas(entered_pieces, "conv string, place long, entry int"), "entry")
    ends = _arrow("conv_id", [("place", pa.int64()), ("last", pa.bool_()), *numbers, ("audit", pa.string()), *lists], id_type)
    repaired = pieces.drop("turns").join(ahead, ["conv", "place"]).join(entry, ["conv", "place"]) \
        .mapInArrow(in_tasks(repaired_pieces, ends), _ddl(ends))
    return whole, repaired, id_type


def repairs(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation in the table.

    `conversations` has conv_id (any type), turn, role and text; other columns are not read, whatever their names. Rows are
    taken by turn, nulls first; rows of one turn by role and by a hash of the text. A null role or text is one space, and
    rows with a null conv_id are one conversation. Equal rows count as they stand: the later ones are duplicates. Of a conversation
    of any length only one character for each edit comes together in one task, and its repaired text passes there piece by piece;
    one text is held whole, whatever its length. An empty table gives no rows.
    """
    whole, pieces, id_type = _passes(conversations, False)
    schema = _arrow("conv_id", [*((n, pa.int64()) for n in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())], id_type)
    closed = pieces.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(
        in_tasks(closed_pieces, schema), _ddl(schema))
    return whole.select(*closed.columns).unionByName(closed)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, `place`, `position`, role and text of the repaired rows; place and position give their order."""
    whole, pieces, _ = _passes(conversations, True)
    both = whole.select("conv_id", F.lit(-1).cast("long").alias("place"), "roles", "texts").unionByName(
        pieces.select("conv_id", "place", "roles", "texts"))
    return both.select("conv_id", "place", F.posexplode(F.arrays_zip("roles", "texts")).alias("position", "row")).select(
        "conv_id", "place", "position", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The table with rows lost, emptied, cut short, repeated or given to the user, by a hash of conversation and turn."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
                                (F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn"))) % 20).alias("_case"))
    case = F.col("_case")
    return rows.filter(case != 0).select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Repairs of the damaged table, with a row for every conv_id of the original, also where no row is left."""
    fixed = repairs(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    all_ids = conversations.select("conv_id").distinct()
    return all_ids.join(fixed, _conv(F.col("conv_id")) == F.col("conv"), "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in NUMBERS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
