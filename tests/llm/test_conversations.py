"""Repaired conversations against every edit script and a plain search."""

import hashlib
import random
import re
import zlib

import pytest

from flowlucid.llm import conversations
from flowlucid.llm.alignment import block_sums, together, whole_script
from flowlucid.llm.conversations import damaged_turns, repair, repair_report, repaired_turns

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def every_script(codes):
    """The best of all scripts, tried one by one."""
    best = (3 * len(codes), "D" * len(codes))

    def go(i, state, cost, out):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(codes) and state in (0, 3):
            best = min(best, (cost, out))
        for ch in "ua":
            if (state, ch) in NEXT:
                go(i, NEXT[state, ch], cost + 2, out + "I")
        if i < len(codes):
            c = codes[i]
            go(i + 1, state, cost + 3, out + "D")
            for ch in "sua" if c != "-" else "":
                if (state, ch) in NEXT and (c.lower() == ch or ch != "s"):
                    kept = c.lower() == ch
                    go(i + 1, NEXT[state, ch], cost + (0 if kept else 2) + c.isupper(), out + ("K" if kept else "R"))

    go(0, 0, 0, "")
    return best


def plain_script(codes):
    """The same by state after each turn, without a table of letters."""
    best = {0: (0, "")}
    for c in [*codes, None]:
        for state in (0, 1, 3, 2, 3, 2):
            if state in best:
                for ch in "ua":
                    if (state, ch) in NEXT:
                        cost, out = best[state]
                        to = NEXT[state, ch]
                        best[to] = min(best.get(to, (1 << 60, "")), (cost + 2, out + "I"))
        if c is None:
            break
        after = {}
        for state, (cost, out) in best.items():
            ways = [(state, cost + 3, "D")]
            for ch in "sua" if c != "-" else "":
                if (state, ch) in NEXT and (c.lower() == ch or ch != "s"):
                    kept = c.lower() == ch
                    ways.append((NEXT[state, ch], cost + (0 if kept else 2) + c.isupper(), "K" if kept else "R"))
            for to, total, letter in ways:
                after[to] = min(after.get(to, (1 << 60, "")), (total, out + letter))
        best = after
    return min(best[s] for s in (0, 3) if s in best)


def random_codes(rng, n):
    return "".join(rng.choices("suaoSUAO-", weights=[2, 5, 5, 1, 1, 2, 2, 1, 2], k=n))


def test_against_every_script():
    rng = random.Random(1)
    for _ in range(1500):
        codes = random_codes(rng, rng.randint(1, 6))
        assert whole_script(list(block_sums(codes))) == every_script(codes) == plain_script(codes)


def test_blocks_in_any_grouping():
    rng = random.Random(2)
    for _ in range(300):
        codes = random_codes(rng, rng.randint(2, 40))
        cuts = sorted({0, len(codes), *rng.choices(range(1, len(codes)), k=rng.randint(0, 6))})
        parts = [list(block_sums(codes[a:b])) for a, b in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i:i + 2] = [together(parts[i], parts[i + 1])]
        assert whole_script(parts[0]) == plain_script(codes)


def plain_repair(rows):
    """Damage and repair of (conv_id, turn, role, text), conversation by conversation."""
    damaged = {}
    for conv, turn, role, text in rows:
        kept = damaged.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in damaged.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        seen, codes, count = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            solid = text.strip(" \t\n\v\f\r")
            code = role[:1] if role[:1] and role[:1] in "sua" else "o"
            if not solid:
                count["blank"] += 1
                code = "-"
            elif (role, text) in seen:
                count["duplicate"] += 1
                code = "-"
            elif solid[-1] not in ".!?":
                count["truncated"] += 1
                code = code.upper()
            seen.add((role, text))
            codes += code
        cost, audit = plain_script(codes)
        left, repaired = list(turns), []
        for edit in audit:
            role, text = (None, "") if edit == "I" else left.pop(0)[1:]
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if repaired and repaired[-1][0][0] == "u" else "user"
            repaired.append((role, text))
        assert not left
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


def sample(seed, n, turns):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Été"])
            text = rng.choice(["Hello.", "why?", "so", "", " \n", None, "Été!", f"text {turn}.", f"text {turn}", "end. \n"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    return rows + rows[:20]


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(frame):
    return {r.conv_id: tuple(r[c] for c in FIELDS) for r in frame.collect()}


@pytest.mark.parametrize("block, fan", [(32, 64), (2, 2)])
def test_against_plain_repair(spark, monkeypatch, block, fan):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "FAN", fan)
    rows = sample(block, 120, 14) + [(-1, i, "user" if i % 3 else "assistant", f"t {i % 50}.") for i in range(300)] + [(-2, 1, "user", "same.")] * 90
    rows += [(1000 + i, i, "user", "alone.") for i in range(60)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    expected = plain_repair(rows)
    assert found(repair(damaged_turns(table), table)) == expected
    assert any(e[6] == "" for e in expected.values())


def test_repaired_turns_follow_the_grammar(spark):
    rows = sample(9, 60, 9)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {}
    for r in repaired_turns(damaged_turns(table)).collect():
        assert r.position == len(out.setdefault(r.conv_id, []))
        out[r.conv_id].append((r.role, r.text, r.edit))
    assert len(out) > 30
    for turns in out.values():
        assert re.fullmatch("s?(ua)+", "".join(t[0][0] for t in turns))
        assert all(t[1] == "" and t[0] in ("user", "assistant") for t in turns if t[2] == "I")


def test_edges(spark):
    schema = "conv_id long, turn int, role string, text string, at int, digest string"
    long = "word " * 300_000
    rows = [(1, None, None, None, 1, "x"), (2, 1, "user", long, 1, "y"), (2, 2, "assistant", "Yes.", 1, None), (None, 1, "system", "a.", 2, "z")]
    table = spark.createDataFrame(rows, schema)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in repair_report(table).collect()}
    assert got == {1: (0, 1, 0, 0, 0, 3, "D"), 2: (0, 0, 0, 1, 0, 1, "KK"), None: (0, 0, 0, 0, 0, 3, "D")}
    assert repair(table).count() == 3
    empty = table.limit(0)
    assert repair(empty).count() == repair_report(empty).count() == repaired_turns(empty).count() == 0
    assert found(repair(empty, table)) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in (1, 2, None)}
