"""Repair of conversations against a forward search over whole edit strings."""

import hashlib
import random
import re
import zlib

from articleflow.llm.queries import op12_turns
from articleflow.llm.turns import damaged, repair_digests, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, conv string, part string, edits string, cost string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        some = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = some(role), some(text)
        if fault == 0:
            out.append((conv, None, None, None))
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def best(rows):
    """Forward search: per state the least (cost, edits) with the turns they give."""
    state = {"": (0, "", [])}

    def after(letters, letter):
        new = letters + letter
        return new[-3:] if re.fullmatch(r"(s?(ua)*u?)?", new) else None

    def better(to, key, cost, edits, made):
        key = "a" if key and key[-1] == "a" else "u" if key and key[-1] == "u" else key
        if key not in to or (cost, edits) < to[key][:2]:
            to[key] = (cost, edits, made)

    def moves(key, letter):
        if letter == "s":
            return "s" if key == "" else None
        if letter == "u":
            return "u" if key in ("", "s", "a") else None
        return "a" if letter == "a" and key == "u" else None

    def inserted(states):
        for _ in range(3):
            for key, (cost, edits, made) in list(states.items()):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    to = moves(key, letter)
                    if to is not None:
                        better(states, to, cost + 5, edits + "I", made + [(role, "")])
        return states

    seen = set()
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        to = {}
        for key, (cost, edits, made) in inserted(state).items():
            better(to, key, cost + 2, edits + "D", made)
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            kept = moves(key, role[:1]) if role else None
            if kept is not None:
                better(to, kept, cost + extra, edits + "K", made + [(role, text)])
            for letter, other in (("u", "user"), ("a", "assistant")):
                if moves(key, letter) is not None:
                    better(to, moves(key, letter), cost + 1 + extra, edits + "R", made + [(other, text)])
        state = to
    ends = [found for key, found in inserted(state).items() if key in ("", "a")]
    return min(ends, key=lambda found: found[:2]), faults


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        if role is not None:
            convs[conv].append((turn, role, text))
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        (cost, audit, made), faults = best([r[1:] for r in found])
        turns = [r[0] for r in found if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        letters = [r[1][:1] for r in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def sample(count=120, seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(count)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No?", "cut off", "", " \t\x0b", None, "done!\n ", f"t{turn}.", "Ünï. "])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows + rows[:7]


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", "e", "x") for r in rows], SCHEMA).repartition(5)


def test_damaged_conversations_are_repaired_as_by_search(spark):
    rows = sample()
    got = damaged(table(spark, rows))
    import pyspark.sql.functions as F

    for chunk in (1, 3, 1 << 16):
        assert found(repair_digests(got, present=F.col("present"), chunk=chunk)) == brute(damage(rows))


def test_long_conversation_crosses_batches_and_chunks(spark):
    rng = random.Random(3)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 4000)}" + rng.choice([".", "", "!"])) for i in range(6000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        assert found(repair_digests(table(spark, rows), chunk=700)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_turns_give_the_digest(spark):
    rows = [r for r in sample(40) if r[0] is not None]
    turns = {}
    for r in sorted(repaired_turns(table(spark, rows)).collect(), key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    digests = {conv: row[-1] for conv, row in found(repair_digests(table(spark, rows))).items()}
    assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in digests} == digests
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in lines)) for lines in turns.values())


def test_nothing(spark):
    assert found(repair_digests(table(spark, []))) == {}


def test_query_on_the_sample(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op12_turns(spark, "/root/testdata/sf0.01")) == brute(damage(rows))
