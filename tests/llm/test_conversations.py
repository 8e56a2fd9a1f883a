import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import turnrepair
from ledgerloom.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, conv string, place long, row string"
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ADD = (2, 2, 3, 2)


def cheapest(symbols):
    """Cost and ASCII-least audit by plain dynamic programming over whole strings."""
    best = None
    for symbol in [None, *reversed(symbols)]:
        now = [(10 ** 9, "~")] * 4
        for s in range(4):
            ways = [(0, "")] if symbol is None and s in (0, 3) else []
            if symbol is not None:
                ways.append((4 + best[s][0], "D" + best[s][1]))
                if symbol != "-":
                    extra = 3 if symbol.isupper() else 0
                    kept = AFTER.get(symbol.lower(), {}).get(s)
                    if kept is not None:
                        ways.append((extra + best[kept][0], "K" + best[kept][1]))
                    ways.append((3 + extra + best[ADD[s]][0], "R" + best[ADD[s]][1]))
            now[s] = min(ways, default=now[s])
        for _ in range(4):
            now = [min(now[s], (3 + now[ADD[s]][0], "I" + now[ADD[s]][1])) for s in range(4)]
        best = now
    return best[0]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        case = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if case:
            row = (conv, turn, "user" if case == 4 else role,
                   "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)
            out += [row] * (2 if case == 3 else 1)
    return out


def brute_repairs(rows):
    """conv_id and the contract's columns from undamaged rows, by hand."""
    groups = {row[0]: [] for row in rows}
    for row in damaged(rows):
        groups[row[0]].append(row[1:])
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        symbols, seen, counts = "", set(), defaultdict(int)
        for _, role, text in turns:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            counts[fault] += 1
            seen.add((role, text))
            symbol = role[:1] if role[:1] in AFTER else "o"
            symbols += "-" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol
        cost, audit = cheapest(symbols)
        state, rest, lines = 0, list(turns), []
        for edit in audit:
            row = None if edit == "I" else rest.pop(0)
            if edit == "D":
                continue
            state = AFTER[row[1][0]][state] if edit == "K" else ADD[state]
            role = row[1] if edit == "K" else "user" if state == 2 else "assistant"
            lines.append(f"{role}:{row[2] if row else ''}")
        known = {t for t, _, _ in turns if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, counts["blank"], counts["duplicate"],
                     counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def turns_of(seed=1, convs=40, longest=40):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        texts = [f"Say {i}{rng.choice(['.', '!', '', ' \n', '?\t'])}" for i in range(12)] + ["", " \n", None, "ok."]
        for turn in rng.sample(range(longest + 5), rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ulf", "", None])
            rows.append((conv, turn, role, rng.choice(texts)))
        rows.append((conv, None, "system", "Be kind."))
    rows += [(None, 1, "user", "who?"), (None, 2, "assistant", "Me."), (None, None, "user", "é" * 4000 + "."),
             (70, None, None, None), (71, 0, "user", "A.\nB")]
    return rows


def results(df):
    rows = df.select("conv_id", *turnrepair.NUMBERS, "audit", "repaired_sha256").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 5, "x") for r in rows], TURNS)


def test_repairs_equal_brute_force(spark):
    rows = turns_of()
    assert results(turnrepair.repair_digests(table(spark, rows))) == brute_repairs(rows)


def test_one_conversation_with_most_rows_is_cut_into_pieces(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t % 900}.", "same.", "open", ""])) for t in range(6000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}.{t}.") for c in range(2, 200) for t in range(6)]
    cut = table(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert results(turnrepair.repair_digests(cut)) == brute_repairs(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_equal_rows_of_one_turn_lie_together(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 0, "user", "a."), (2, 5, "user", "b."), (2, 5, "assistant", "c.")]
    got = results(turnrepair.repairs(table(spark, rows)))
    assert got[1][:6] == (0, 0, 2, 0, 2, 11) and got[1][6] == "KDDI"
    assert got[2][6] == "IKKI"


def test_repaired_turns_follow_the_pattern_and_the_digest(spark):
    conversations = turnrepair.damaged(table(spark, turns_of(9)))
    digests = results(turnrepair.repairs(conversations))
    lists = defaultdict(list)
    for r in turnrepair.repaired_turns(conversations).orderBy("place", "position").collect():
        lists[r.conv_id].append((r.role, r.text))
    for conv, found in digests.items():
        lines = lists.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in lines))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest() == found[-1]


def test_empty_tables_and_text_ids(spark):
    empty = table(spark, []).limit(0)
    assert turnrepair.repair_digests(empty).count() == 0
    named = table(spark, turns_of(3, 5)).withColumn("conv_id", F.concat(F.lit("n"), "conv_id"))
    ids = {r[0] for r in turnrepair.repair_digests(named).select("conv_id").collect()}
    assert ids == {f"n{i}" for i in (0, 1, 2, 3, 4, 70, 71)} | {None}


def test_powers_equal_steps():
    rng = random.Random(2)
    for _ in range(300):
        symbols = "".join(rng.choice("-suaoSUAO") * rng.choice([1, 1, 2, 7, 40]) for _ in range(rng.randint(0, 5)))
        costs = turnrepair.costs_before(symbols, turnrepair.END)
        assert costs == turnrepair.before(turnrepair.segment_matrix(symbols), turnrepair.END)
        steps = turnrepair.unroll(symbols, turnrepair.END)
        roles = [{"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool") for c in symbols]
        assert (costs[0], turnrepair.applied(steps, 0, roles, ["."] * len(symbols), True)[0]) == cheapest(symbols)


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op13_conversation_repair"](spark, sf)) == brute_repairs(rows)
