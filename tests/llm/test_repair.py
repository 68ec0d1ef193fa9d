import hashlib
import itertools
import re
import zlib

import pytest

from wattline.llm import queries
from wattline.llm.repair import Automaton, apply_repairs, find_repairs, repaired_digests, rows_of

LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, signature string, cost int"


def brute(word):
    """Cheapest (cost, audit, emitted) of a signature word: all edits of each row, up to two rows inserted anywhere."""
    rows = []
    for letter in word:
        extra, own = letter.isupper(), letter.lower()
        choices = [("D", 3, "")]
        if own != "x":
            choices += [("K", extra, own), ("R", 2 + extra, "u"), ("R", 2 + extra, "a")]
        rows.append(choices)
    slots = [[("", 0, "")] + [("I" * k, 2 * k, "".join(p)) for k in (1, 2) for p in itertools.product("ua", repeat=k)]] * (len(word) + 1)
    parts = [x for pair in itertools.zip_longest(slots, rows) for x in pair if x is not None]
    found = []
    for chosen in itertools.product(*parts):
        if LEGAL.fullmatch("".join(x[2] for x in chosen)):
            found.append((sum(x[1] for x in chosen), "".join(x[0] for x in chosen)))
    return min(found)


@pytest.mark.parametrize("length", [0, 1, 2])
def test_every_short_word_against_all_edits(length):
    automaton = Automaton()
    for letters in sorted(itertools.product("xsuaoSUAO", repeat=length), key=lambda w: w[::-1]):
        assert automaton.best("".join(letters)) == brute("".join(letters))


@pytest.mark.parametrize("word", ["uau", "aou", "ssu", "uua", "AuS", "xax", "aua", "oao", "UUU", "sas"])
def test_longer_words(word):
    assert Automaton().best(word) == brute(word)


def test_words_share_their_ends():
    words = sorted((p + "uaua" * 50 for p in ("", "s", "a", "ua", "xs", "os")), key=lambda w: w[::-1])
    automaton = Automaton()
    for word in words:
        automaton.best(word)
    distinct = {w[k:] for w in words for k in range(len(w))}
    assert automaton.made == len(distinct)  # every distinct end is one node, made once
    long = "uxSoa" * 40000
    cost, audit = Automaton().best(long)
    assert len(audit.replace("I", "")) == len(long) and cost > 0


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        out += [(conv, turn, role, text)] * (2 if draw == 3 else 1)
    return out


def plain(rows, ids=None):
    """Expected rows of the query, read from its contract."""
    groups = {conv: [] for conv in (ids or {r[0] for r in rows})}
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for conv, talk in groups.items():
        talk.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {t for _, t, _, _ in talk if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, word, counts = set(), "", {"x": 0, "blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in talk:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            word += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            if fault:
                counts[fault] += 1
        first = [r[2][:1] for r in talk]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        cost, audit = cheapest(word)
        done, left, last = [], list(talk), ""
        for edit in audit:
            row = left.pop(0) if edit != "I" else (None, None, "", "")
            if edit == "D":
                continue
            role = row[2] if edit == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            done.append(f"{role}:{row[3]}")
        assert not left
        digest = hashlib.sha256("\n".join(done).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def cheapest(word):
    """Least (cost, audit) by a forward search over whole audits, a second way of finding it."""
    reached = {"": (0, "")}  # what follows the last emitted initial matters only: '', s, u, a
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        for _ in range(2):
            for last, (cost, audit) in list(states.items()):
                for role in after[last].replace("s", ""):
                    states[role] = min(states.get(role, (1 << 30, "")), (cost + 2, audit + "I"))
        return states

    reached = inserted(reached)
    for letter in word:
        states = {}
        for last, (cost, audit) in reached.items():
            options = [(last, cost + 3, "D")]
            if letter != "x":
                extra = int(letter.isupper())
                options += [(r, cost + 2 + extra, "R") for r in after[last].replace("s", "")]
                if letter.lower() in after[last]:
                    options.append((letter.lower(), cost + extra, "K"))
            for role, total, edit in options:
                states[role] = min(states.get(role, (1 << 30, "")), (total, audit + edit))
        reached = inserted(states)
    return min(reached[x] for x in ("", "a") if x in reached)


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 4, "user", "cut of"),
    (2, None, "system", "Be kind."), (2, 0, "user", " \t\n"), (2, 1, None, None), (2, 2, "tool", "x!"),
    (3, 0, "assistant", "A?"), (3, 1, "assistant", "B?"), (3, 2, "assistant", "A?"),
    (None, None, "user", "q."), (None, 3, "assistant", "long. " * 30000),
    (4, None, None, None), (5, 0, "", "no role."), (6, 5, "system", "s."), (6, 2, "system", "t. \n"),
]


def result(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return {r["conv"]: tuple(r[c] for c in names) for r in frame.collect()}


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "clash", 7) for r in ODD], SCHEMA)
    rows = rows_of(df, "conv_id", "turn", "role", "text")
    repairs = find_repairs(rows)
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD]
    want = plain(filled)
    assert result(repairs) == {k: v[:7] for k, v in want.items()}
    digests = {r["conv"]: r["repaired_sha256"] for r in repaired_digests(rows, repairs).collect()}
    assert digests == {k: v[7] for k, v in want.items()}
    talks = {}
    for r in sorted(apply_repairs(rows, repairs).collect(), key=lambda r: r["place"]):
        talks.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in talks.items()} == {
        k: v for k, v in digests.items() if k in talks
    }
    empty = rows.limit(0)
    assert find_repairs(empty).count() == 0 and apply_repairs(empty, find_repairs(empty)).count() == 0


def test_query_over_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    rows = [tuple(r) for r in table]
    want = plain(damage(rows), {r[0] for r in rows})
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[c] for c in names) for r in queries.QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert got == want
