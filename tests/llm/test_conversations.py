"""Conversation repair against a search over all edit sequences."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tenderline.llm import conversations as conv
from tenderline.llm.storage import reachable

KIND = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\v\f\r"


@pytest.fixture(autouse=True)
def _reach(spark):
    reachable(spark)


def in_order(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def everything(rows):
    """(cost, audit, repaired) of the best of all edit sequences with up to two rows inserted at a place."""
    best = None
    options = []
    for role, text, fault in rows:
        ways = [("D", None, 3)]
        if fault not in (conv.BLANK, conv.DUPLICATE):
            late = fault == conv.CUT
            ways += [("K", (role, text), late), ("R", ("user", text), 2 + late), ("R", ("assistant", text), 2 + late)]
        options.append(ways)
    extra = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    for inserted in itertools.product(extra, repeat=len(rows) + 1):
        if sum(map(len, inserted)) > 4:
            continue
        for chosen in itertools.product(*options):
            out, audit, cost = [], "", 0
            for k, new in enumerate(inserted):
                out += [(r, "") for r in new]
                audit += "I" * len(new)
                cost += 2 * len(new)
                if k < len(rows):
                    letter, row, price = chosen[k]
                    audit += letter
                    cost += price
                    out += [row] if row else []
            if in_order("".join(r[:1] or "-" for r, _ in out)):
                best = min(best or (cost, audit, out), (cost, audit, out))
    return best


def plain_search(rows):
    """The same by plain dynamic programming over whole strings."""
    table = {0: (0, "")}
    for role, _, fault in rows:
        new = {}
        for state, (cost, audit) in table.items():
            for _ in range(3):
                ways = [(state, cost + 3, audit + "D")]
                nxt = conv.AFTER[state, conv.NEXT_ROLE[state][0]]
                if fault not in (1, 2):
                    if (state, role[:1]) in conv.AFTER:
                        ways.append((conv.AFTER[state, role[:1]], cost + (fault == 3), audit + "K"))
                    ways.append((nxt, cost + 2 + (fault == 3), audit + "R"))
                for end, c, a in ways:
                    new[end] = min(new.get(end, (c, a)), (c, a))
                state, cost, audit = nxt, cost + 2, audit + "I"
        table = new
    return min((c + 2 * len(conv.END[s]), a + conv.END[s]) for s, (c, a) in table.items())


def searched(rows):
    got = []
    search = conv.Search(lambda letters, row: got.append(letters))
    for role, text, fault in rows:
        search.add(role, fault, (role, text))
    cost, rest = search.finish()
    return cost, "".join(got) + rest, search


@pytest.mark.parametrize("seed", range(12))
def test_short_conversations_against_all_edits(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "x", rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 3))]
    cost, audit, _ = searched(rows)
    assert (cost, audit) == everything(rows)[:2]


@pytest.mark.parametrize("seed", range(40))
def test_long_conversations_against_whole_strings(seed):
    rng = random.Random(seed)
    weights = rng.choice([[1, 5, 5, 1, 0], [0, 1, 0, 0, 0], [3, 3, 0, 1, 1], [1, 1, 1, 1, 1], [0, 1, 9, 0, 0]])
    rows = [(rng.choices(["system", "user", "assistant", "tool", ""], weights)[0], "x", rng.choices([0, 1, 2, 3], [8, 1, rng.choice([0, 9]), 2])[0]) for _ in range(rng.randint(0, 200))]
    assert searched(rows)[:2] == plain_search(rows)


def test_memory_is_bounded_by_the_unresolved_suffix():
    rows = [("user" if k % 2 == 0 else "assistant", "x", 3 if k % 7 == 0 else 0) for k in range(20_000)]
    _, audit, search = searched(rows)
    assert len(audit) == 20_000 and search.most_open <= 4
    assert searched([("user", "x", 2)] * 5_000)[2].most_open <= 4  # nothing may stay


def brute(rows):
    damaged, all_ids = [], set()
    for c, turn, role, text in rows:
        all_ids.add(c)
        role, text = (" " if role is None else role), (" " if text is None else text)
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else "".join(x for x in text if x not in ".!?") if what == 2 else text
        damaged += [(c, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    out = []
    for c in all_ids:
        mine = sorted((r[1:] for r in damaged if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, work = set(), []
        for _, role, text in mine:
            fault = 1 if not text.strip(BLANKS) else 2 if (role, text) in seen else 3 if text.rstrip(BLANKS)[-1] not in ".!?" else 0
            seen.add((role, text))
            work.append((role, text, fault))
        cost, audit = plain_search(work) if work else (0, "")
        rows_left, fixed, state = iter(work), [], 0
        for letter in audit:
            if letter == "D":
                next(rows_left)
                continue
            role, text = (conv.NEXT_ROLE[state], "") if letter == "I" else next(rows_left)[:2]
            role = conv.NEXT_ROLE[state] if letter == "R" else role
            fixed.append(f"{role}:{text}")
            state = conv.AFTER[state, role[0]]
        turns = {r[0] for r in mine if r[0] is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(work, work[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(w[2] == k for w in work) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_digest_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "Ä end.\n", "Yes."]
    data = [(c, rng.choice([None, t, t, t, t + 3]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(texts)) for c in [*range(40), None] for t in range(rng.randint(1, 12))]
    data += [(100, t, "user", "same text.") for t in range(300)] + [(101, 1, "user", "copy.")] * 50 + [(102, t, "assistant", f"t{t} " + "long " * 30_000) for t in range(3)] + [(103, -5, "user", "a."), (103, 40, "assistant", "b.")]
    df = spark.createDataFrame(data, KIND)
    got = conv.repair_digest(df.withColumns({"dropped": F.lit("x"), "again": F.lit(1), "_what": F.lit(0), "_h1": F.lit(2)})).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(data)


def test_edits_rebuild_the_digest(spark):
    data = [(1, k, "user" if k % 3 else "assistant", f"line {k}.") for k in range(30)] + [(2, None, None, None)]
    df = spark.createDataFrame(data, KIND)
    edits = [r for r in conv.repair_rows(conv.damage(df)).orderBy("conv_id", "ordinal").collect()]
    for d in conv.repair_digest(df).collect():
        mine = [e for e in edits if e["conv_id"] == d["conv_id"]]
        assert "".join(e["edit"] for e in mine) == d["audit"]
        assert hashlib.sha256("\n".join(f"{e['role']}:{e['text']}" for e in mine if e["role"] is not None).encode()).hexdigest() == d["repaired_sha256"]
    assert conv.repair_rows(df.where("false")).collect() == [] and conv.repair_digest(df.where("false")).collect() == []
