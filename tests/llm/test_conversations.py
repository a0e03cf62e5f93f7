import hashlib
import re
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigdiff.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
SPACE = "\t\n\x0b\f\r "


def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every sequence of edits that costs no more than deleting all."""
    best = [(4 * len(rows), "D" * len(rows), [])]

    def go(at, cost, audit, out):
        if cost > best[0][0]:
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
            best[0] = min(best[0], (cost, audit, list(out)))
        for name in ("user", "assistant"):
            go(at, cost + 3, audit + "I", [*out, (name, "")])
        if at < len(rows):
            role, text, fault = rows[at]
            go(at + 1, cost + 4, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if role and re.match("s?(ua)*u?$", "".join(r[:1] for r, _ in [*out, (role, "")])):
                    go(at + 1, cost + more, audit + "K", [*out, (role, text)])
                for name in ("user", "assistant"):
                    go(at + 1, cost + 3 + more, audit + "R", [*out, (name, text)])

    go(0, 0, "", [])
    return best[0]


def by_states(rows):
    """The same for longer rows, by a table over the four kinds of beginnings of the grammar."""
    kinds = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for k, (cost, audit, out) in list(best.items()):
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in kinds[k]:
                        new = (cost + 3, audit + "I", (*out, (name, "")))
                        best[kinds[k][x]] = min(best.get(kinds[k][x], new), new)
        return best

    best = insert(best)
    for role, text, fault in rows:
        after = {}
        put = lambda k, v: after.__setitem__(k, min(after.get(k, v), v))
        more = 3 if fault == "truncated" else 0
        for k, (cost, audit, out) in best.items():
            put(k, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] in kinds[k]:
                put(kinds[k][role[:1]], (cost + more, audit + "K", (*out, (role, text))))
            for x, name in (("u", "user"), ("a", "assistant")):
                if x in kinds[k]:
                    put(kinds[k][x], (cost + 3 + more, audit + "R", (*out, (name, text))))
        best = insert(after)
    cost, audit, out = min(v for k, v in best.items() if k in ("", "a"))
    return cost, audit, list(out)


def brute(rows, damage=True):
    """Result of each conversation of rows (conv_id, turn, role, text)."""
    every = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        own = every.setdefault(conv, [])
        case = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20 if damage else 19
        if case:
            own += [(turn, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)] * (1 + (case == 3))
    out = []
    for conv, own in every.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marked = faults(own)
        turns = {t for t, *_ in own if t is not None}
        count = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, repaired = by_states(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, sha))
    return out


some_rows = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from([("x.", None), ("y", "truncated"), ("", "blank"), ("z.", "duplicate")])).map(lambda r: (r[0], *r[1])), max_size=5)


def repaired(rows, flush=None):
    own = cv.Conversation(cv.Parser())
    for k, (role, text, fault) in enumerate(rows):
        own.seen = None
        own.row(k, role, text, fault)
        if flush:
            own._apply(own.repair.agreed())
    return own.result()


@given(some_rows)
@settings(max_examples=150, deadline=None)
def test_repair_is_the_cheapest(rows):
    cost, audit, out = cheapest(rows)
    assert by_states(rows) == (cost, audit, out)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    assert repaired(rows)[-3:] == repaired(rows, True)[-3:] == (cost, audit, sha)


@given(st.lists(some_rows, max_size=30).map(lambda parts: [r for p in parts for r in p]))
@settings(max_examples=150, deadline=None)
def test_long_conversations(rows):
    cost, audit, out = by_states(rows)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    assert repaired(rows)[-3:] == (cost, audit, sha)


def test_all_short_orders():
    for n in range(1, 4):
        for roles in product("sua", repeat=n):
            rows = [(r, "x.", None) for r in roles]
            assert repaired(rows)[-3:-1] == cheapest(rows)[:2]


def test_live_rows_stay_few():
    own = cv.Conversation(cv.Parser())
    roles = ["system", *("user", "assistant", "assistant", "tool", "user", "user") * 3000]
    for k, role in enumerate(roles):
        own.row(k, role, f"{k}" + "." * (k % 7 > 0), None if k % 5 else "blank")
        assert len(own.pending) < 200 and len(own.repair.live) < 9
    assert len(own.result()[-2]) >= len(roles)


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_rows_equal_brute_force(spark, broadcast_rows):
    texts = ["Hello there.", "hello", "", " \t", None, "Is it?", "Yes!  ", "no."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = [(c if c else None, t if t != 3 else None, roles[(c * t + t) % 8], texts[(c + t * t) % 8], "x") for c in range(40) for t in range(c % 14)]
    rows += [(41, 5, "user", "Same.", "x")] * 3 + [(42, None, "user", "One.", "x"), (42, 1, "user", "One.", "x"), (42, 1, "assistant", "One.", "x"), (42, -(2**63), "user", "a", "x"), (42, 2**63 - 1, "user", "b", "x")]
    rows += [(43, t, "assistant" if t % 2 else "user", f"Turn {t % 90}.", "x") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for damage in (True, False):
        want = [tuple(min(v, 2**63 - 1) if isinstance(v, int) else v for v in r) for r in brute([r[:4] for r in rows], damage)]
        assert ordered(cv.repair_conversations(df, damage, broadcast_rows)) == sorted(want, key=str)


def test_no_rows(spark):
    assert cv.repair_conversations(spark.createDataFrame([], SCHEMA), True).collect() == []


def test_registered_query(spark):
    from sigdiff.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.queries()["op13_conversations"](spark, sf)
    assert dict(got.dtypes) == {"conv_id": "bigint", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "repaired_sha256": "string"}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert ordered(got) == sorted(brute([(r.conv_id, r.turn, r.role, r.text) for r in rows]), key=str)
