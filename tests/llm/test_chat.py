import hashlib
import random

import numpy as np
import pytest

from wattline.llm import queries
from wattline.llm.chat import Codec, escape, format_chats, read_back, read_turns, segment, unescape

HOSTILE = ["", "\\", "\\\\", "#", "####", "\\####", "</turn>", "\\</turn>\n### user: x", "</tur", "a: b", "<|endoftext|>", "##", "é\U0001f600\x00"]


def test_escapes_come_back():
    rng = random.Random(3)
    texts = HOSTILE + ["".join(rng.choice(["#", "\\", "<", "</turn>", ": ", "\n", "a", "### "]) for _ in range(12)) for _ in range(400)]
    for role, text in zip(reversed(texts), texts):
        assert unescape(escape(text)) == text
    formatted = "".join("".join(segment(r, t)) for r, t in zip(reversed(texts), texts))
    assert read_turns(formatted) == list(zip(reversed(texts), texts))
    assert read_turns("".join(segment("user", "#\\<" * 300_000)))[0][1] == "#\\<" * 300_000
    with pytest.raises(ValueError):
        read_turns("### user: no end")


def plain(rows):
    """Expected digests, read from the contract: rows by turn, nulls empty."""
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, talk in talks.items():
        talk.sort(key=lambda r: r[:3])
        loss = "".join(t for *_, r, t in talk if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for *_, r, t in talk)
        chars = sum(len("".join(segment(r, t))) for *_, r, t in talk)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        out[conv] = (len(talk), digest[0], len(loss), digest[1], chars)
    return out


def digests(frame, key="conv"):
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return {r[key]: tuple(r[c] for c in names) for r in frame.collect()}


def tree_rows(seed, conversations, kinds=3, depth=6):
    """Conversations over few texts, so that many begin alike; some are copies or beginnings of others."""
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, depth)):
            role = "user" if turn % 2 == 0 else "assistant"
            rows.append((conv, turn, role, HOSTILE[rng.randrange(kinds)] + "!" * (turn % 2)))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_stream_of_tokens(spark, parts):
    rows = tree_rows(parts, 300)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        done = format_chats(df)
        assert digests(read_back(done)) == plain(rows)
        packed = sorted((r.asDict() for r in done.packed.collect()), key=lambda r: r["start"])
        index = {r["conv"]: r["node"] for r in done.index.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    prefixes, talks = set(), {}
    for conv, _, role, text in rows:
        talks[conv] = (*talks.get(conv, ()), (role, text))
        prefixes.add(talks[conv])
    assert len(packed) == len(prefixes)  # every beginning once
    at, stream, owner = 0, [], []
    for row in packed:
        row["ids"] = np.frombuffer(row["ids"], Codec().kind).tolist()
        assert len(row["ids"]) == row["n"]
        assert row["start"] == at
        at += len(row["ids"])
        stream += row["ids"]
    for row in packed:  # what a node attends to is its conversation so far, and positions count it
        seen = [k for a in row["attends"] for k in range(a["first"], a["end"])]
        assert seen == sorted(set(seen)) and (not seen or seen[-1] < row["start"])
        assert row["position"] == len(seen)
        edges = [(a["first"], a["end"]) for a in row["attends"]]
        assert all(x[1] < y[0] for x, y in zip(edges, edges[1:]))
        owner.append((row["node"], read_turns("".join(chr(stream[k]) for k in seen) + "".join(map(chr, row["ids"])))))
    by_node = dict(owner)
    assert {conv: tuple(by_node[node]) for conv, node in index.items()} == talks
    if parts == 1:  # depth first: a node's ancestors are those of the node before it, up to some depth
        way = []
        for row in packed:
            above = by_node[row["node"]][:-1]
            assert way[: len(above)] == above
            way = by_node[row["node"]]


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "same"), (2, 0, "user", "same"), (2, 1, "assistant", None), (3, None, None, "first"), (3, 0, None, None),
        (None, 1, "assistant", "of nobody"), (None, 0, "system", ""), (4, 0, "user", "twice"), (4, 0, "user", "twice"),
        (5, 0, "assistant", "long " * 50_000), (6, 2, "a: b\\", HOSTILE[7]), (6, 1, "### ", HOSTILE[5]), (-7, 0, "user", HOSTILE[9]),
    ]
    schema = "conv_id long, turn long, role string, text string, node string, ids int"
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    done = format_chats(df)
    assert digests(read_back(done)) == plain(rows)
    public = pytest.importorskip("public_tokenizers")
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        with_tokens = format_chats(df, tokenizer=str(public.path(name)), pattern=public.PATTERN)
        assert digests(read_back(with_tokens)) == plain(rows)
    assert read_back(format_chats(df.limit(0))).count() == 0


def test_query_over_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    rows = [tuple(r) for r in table] + queries.HOSTILE
    assert digests(queries.QUERIES["op12_chat_formatting"](spark, sf), "conv_id") == plain(rows)
