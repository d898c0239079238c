"""Cheapest edits that make a sequence of turns follow the grammar ``(s?(ua)+)?``.

Turns are aligned by Wagner and Fischer's table with the strings the grammar allows, of every
feasible length. Strings of different lengths begin alike, so one table for ``uaua...``, one
for ``auau...`` (what follows an open ``u``) and one for ``suaua...`` hold the costs of all
lengths in their last lines. A table is only filled where a cell can lie on a way no dearer
than the best script known beforehand (Ukkonen's band). Where several lengths cost the same,
their scripts, each traced back through the table, are compared.

Turns of one conversation may come in blocks. A block is summed up as the cheapest script from
each state of the grammar to each other; such sums are put together in any grouping.
"""

from __future__ import annotations

from functools import lru_cache

#: Codes of turns: the role's initial (``o``: none of s, u, a), in upper case if the text is
#: truncated, or this if the turn has to go.
GONE = "-"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: States of the grammar: nothing yet, after the system turn, after a user's, after an answer.
START, SYSTEM, USER, ANSWER = range(4)
STATES = 4
#: What is inserted at the very end from each state, to be in the grammar.
CLOSING = ["", INSERT * 2, INSERT, ""]
FAR = 1 << 60

Script = tuple[int, str]
Sums = list[Script | None]  # by entered state * STATES + left state


def _letter(family: str, j: int) -> str:
    """The j-th letter of ``uaua...``, ``auau...`` or ``suaua...``, by the family's first letter."""
    return ("s" if not j else "ua"[(j - 1) % 2]) if family == "s" else ("ua" if family == "u" else "au")[j % 2]


def _row_cost(code: str, letter: str) -> int:
    """Cost of matching a turn with a letter: as it is, or with its role changed."""
    if code == GONE:
        return FAR
    if code.lower() == letter:
        return COST[KEEP] + code.isupper()
    return FAR if letter == "s" else COST[REROLE] + code.isupper()


def _known(codes: str, family: str) -> int:
    """A cost that the best scripts to an odd and to an even number of letters (to two or more, in
    the system family) need not exceed, or -1 if there are none: the turns that may stay do so,
    behind one or two inserted ones where that makes the number odd, or even, or more than none."""
    lead, cost = -1, 0
    if family == "s":
        lead = next((i for i, c in enumerate(codes) if c in "sS"), -1)
        if lead < 0:
            return -1
        cost = COST[DELETE] * lead + codes[lead].isupper()
    rest = codes[lead + 1:]
    stay = [c for c in rest if c != GONE]
    cost += COST[DELETE] * (len(rest) - len(stay))
    if not rest:
        return -1
    follow = "u" if family == "s" else family
    return max(
        cost + COST[INSERT] * shift + sum(_row_cost(c, _letter(follow, shift + k)) for k, c in enumerate(stay))
        for shift in ((0, 1) if stay else (1, 2))
    )


def _table(codes: str, family: str) -> tuple[list[int], list[list[int]]]:
    """The banded table: the first column of each line, and the lines. Line i holds the least
    cost of aligning the first i turns with j letters. Behind the last turn nothing is inserted."""
    n, bound = len(codes), _known(codes, family)
    if bound < 0:
        return [], []
    must = [0]
    for code in codes:
        must.append(must[-1] + (code == GONE))
    firsts, lines = [], []
    for i in range(n + 1):
        low = max(0, i - max(0, bound - COST[DELETE] * (must[n] - must[i])) // COST[DELETE])
        high = i - must[i] + max(0, bound - COST[DELETE] * must[n]) // COST[INSERT]
        line = []
        for j in range(low, high + 1):
            best = 0 if i == j == 0 else FAR
            if i:
                before, at = lines[-1], j - firsts[-1]
                if at < len(before):
                    best = min(best, before[at] + COST[DELETE])
                if 0 < at <= len(before):
                    best = min(best, before[at - 1] + _row_cost(codes[i - 1], _letter(family, j - 1)))
            # the system turn is never inserted
            if i < n and line and not (family == "s" and j == 1):
                best = min(best, line[-1] + COST[INSERT])
            line.append(best)
        firsts.append(low)
        lines.append(line)
    return firsts, lines


def _script(codes: str, family: str, firsts: list[int], lines: list[list[int]], length: int) -> str:
    """The ASCII-least of the cheapest scripts to ``length`` letters: the cells on cheapest ways
    are marked from the end, then the least letter among them is followed from the beginning."""
    def cost(i: int, j: int) -> int:
        return lines[i][j - firsts[i]] if 0 <= j - firsts[i] < len(lines[i]) else FAR

    n = len(codes)
    marked, todo = {(n, length)}, [(n, length)]
    steps: dict[tuple[int, int], list[tuple[str, tuple[int, int]]]] = {}
    while todo:
        i, j = todo.pop()
        here = cost(i, j)
        before = []
        if i and cost(i - 1, j) + COST[DELETE] == here:
            before.append((DELETE, (i - 1, j)))
        if j and i < n and not (family == "s" and j == 1) and cost(i, j - 1) + COST[INSERT] == here:
            before.append((INSERT, (i, j - 1)))
        if i and j:
            letter = _letter(family, j - 1)
            if cost(i - 1, j - 1) + _row_cost(codes[i - 1], letter) == here:
                before.append((KEEP if codes[i - 1].lower() == letter else REROLE, (i - 1, j - 1)))
        for edit, cell in before:
            steps.setdefault(cell, []).append((edit, (i, j)))
            if cell not in marked:
                marked.add(cell)
                todo.append(cell)
    out, cell = [], (0, 0)
    while cell != (n, length):
        edit, cell = min(steps[cell])
        out.append(edit)
    return "".join(out)


def _left(family: str, length: int) -> int:
    """The state after so many letters of a family, at least one."""
    return {"s": SYSTEM, "u": USER, "a": ANSWER}[_letter(family, length - 1)]


@lru_cache(maxsize=20_000)
def block_sums(codes: str) -> tuple[Script | None, ...]:
    """The cheapest script of a block of turns from each state to each other, by
    ``entered * STATES + left``; None if there is none. Ties go to the ASCII-least."""
    n = len(codes)
    sums: Sums = [None] * (STATES * STATES)

    def offer(entered: int, left: int, script: Script) -> None:
        at = entered * STATES + left
        if sums[at] is None or script < sums[at]:
            sums[at] = script

    # no letter: every turn goes; the system's alone: so does every other one
    for state in range(STATES):
        offer(state, state, (COST[DELETE] * n, DELETE * n))
    for i, code in enumerate(codes):
        if code in "sS":
            offer(START, SYSTEM, (COST[DELETE] * (n - 1) + code.isupper(), DELETE * i + KEEP + DELETE * (n - 1 - i)))
    for family, entries in (("u", (START, SYSTEM, ANSWER)), ("a", (USER,)), ("s", (START,))):
        firsts, lines = _table(codes, family)
        last = [(cost, firsts[-1] + k) for k, cost in enumerate(lines[-1])] if lines else []
        last = [(cost, length) for cost, length in last if cost < FAR and length > (family == "s")]
        least: dict[int, int] = {}
        for cost, length in last:
            least[length % 2] = min(cost, least.get(length % 2, FAR))
        for cost, length in last:
            if cost == least[length % 2]:
                script = (cost, _script(codes, family, firsts, lines, length))
                for entered in entries:
                    offer(entered, _left(family, length), script)
    return tuple(sums)


def together(one: Sums, two: Sums) -> Sums:
    """The sums of two neighbouring blocks as one. Scripts of a block end with a turn of it, so
    none begins another and the least of each block makes the least of both."""
    out: Sums = [None] * (STATES * STATES)
    for a in range(STATES):
        for b in range(STATES):
            first = one[a * STATES + b]
            for c in range(STATES) if first else ():
                second = two[b * STATES + c]
                if second:
                    script = (first[0] + second[0], first[1] + second[1])
                    if out[a * STATES + c] is None or script < out[a * STATES + c]:
                        out[a * STATES + c] = script
    return out


def whole_script(sums: Sums) -> Script:
    """The cheapest script of a whole conversation."""
    ways = []
    for left, closing in enumerate(CLOSING):
        found = sums[START * STATES + left]
        if found:
            ways.append((found[0] + COST[INSERT] * len(closing), found[1] + closing))
    return min(ways)
