"""Plain-Python repair of conversations: every audit by a recursion over suffixes."""

import hashlib
import re
import zlib
from functools import lru_cache

BODY = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FIT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def space(x):
    return " " if x is None else x


def damage(rows):
    """(conv_id, turn, role, text) rows after damage, in order."""
    out = []
    for c, t, role, text in rows:
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2],
                                      hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))


def fault_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = BODY.findall(text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen
                   else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair(rows):
    """The result's columns after conv_id for the rows of one conversation."""
    rows = damage(rows)
    faults = fault_of(rows)

    @lru_cache(None)
    def best(i, state, inserts):
        """Least (cost, audit, lines) from row i on."""
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, _, role, text = rows[i]

            def go(cost, op, new, line):
                c, a, out = best(i + 1, new, 0)
                ways.append((c + cost, op + a, (*([line] if line is not None else []), *out)))
            go(2, "D", state, None)
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                new = NEXT[state].get(role[:1])
                if new:
                    go(extra, "K", new, f"{role}:{text}")
                for new in set(NEXT[state].values()) & {"u", "a"}:
                    go(1 + extra, "R", new, f"{ROLE[new]}:{text}")
        if inserts < 3:
            new = FIT[state]
            c, a, out = best(i, new, inserts + 1)
            ways.append((c + 5, "I" + a, (f"{ROLE[new]}:", *out)))
        return min(ways)if ways else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    starts = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def repair_all(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {c: repair(g) for c, g in groups.items()}
