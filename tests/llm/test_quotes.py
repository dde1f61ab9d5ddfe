"""Quotation linking against a plain version on generated conversations:
whole and partial quotes, wrapped anew, nested, across conversations."""

import collections
import random
import re

import duckdb
import pytest

from tessella.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, row long, c long, key long, path string"


def norm(t):
    return re.sub(r"\s+", " ", t.lower()).strip(" ")


def units(t):
    paragraphs = re.split(r"\n[ \t]*(?:\r?\n[ \t]*)+", t)
    every = [t, *paragraphs, *t.split("\n"), *[s for p in paragraphs for s in re.split(r"(?<=[.!?]) ", norm(p))]]
    return {norm(u) for u in every if norm(u)}


def parse(t):
    """(own words, [(depth, body)])"""
    runs = []
    for line in t.split("\n"):
        m = re.match(r"^(?:[ \t]*>)+", line)
        depth = m.group().count(">") if m else 0
        body = re.sub(r"^(?:[ \t]*>)+ ?", "", line)
        if runs and runs[-1][0] == depth:
            runs[-1][1] += "\n" + body
        else:
            runs.append([depth, body])
    if not any(d for d, _ in runs):
        return t, []
    own = [re.sub(r"(?:^|\n)[^>\n]*\b[Ww]rote:[ \t]*\n?\s*$", "", b) if n + 1 < len(runs) else b
           for n, (d, b) in enumerate(runs) if d == 0]
    own = [b for b in own if norm(b)]
    return "\n".join(own).strip(" \t\r\n"), [(d, b) for d, b in runs if d and norm(b)]


def expected(rows):
    by = collections.defaultdict(list)
    for c, turn, _, text in rows:
        by[c].append((turn, *parse(text or "")))
    msgs = {(c, i): m for c in by for i, m in enumerate(sorted(by[c], key=lambda m: m[0]))}
    has = collections.defaultdict(list)
    for at in sorted(msgs):
        for u in units(msgs[at][1]):
            has[u].append(at)
    parent, link = {}, {}
    for (c, i), (_, _, passages) in msgs.items():
        found = []
        for n, (depth, body) in enumerate(passages):
            proposed = set()
            for u in units(body):
                proposed |= {max([x for x in has[u] if x[0] == c and x[1] < i], default=None)}
                proposed |= {x for x in has[u][:1] if x[0] < c}
            real = [x for x in proposed if x and norm(body) in norm(msgs[x][1])]
            mine = [x for x in real if x[0] == c]
            if real:
                found.append((depth, n, max(mine) if mine else min(real)))
        if found:
            parent[c, i], link[c, i] = min(found)[2], ("quote", len(found))
        elif i:
            parent[c, i], link[c, i] = (c, i - 1), ("previous", 0)
        else:
            parent[c, i], link[c, i] = None, ("none", 0)
    kids = collections.defaultdict(list)
    for at in sorted(parent):
        kids[parent[at]].append(at)
    place, thread = {}, {}
    for root in kids[None]:
        todo, n = [root], 0
        while todo:                              # depth first, replies in their order
            at = todo.pop()
            place[at], thread[at], n = n, root[0], n + 1
            todo += reversed(kids[at])
    position = {}
    for c in by:
        for n, at in enumerate(sorted((x for x in msgs if x[0] == c), key=lambda x: (thread[x], place[x]))):
            position[at] = n
    return {(c, msgs[c, i][0]): (position[c, i], norm(msgs[c, i][1]), p[0] if p else None, msgs[p][0] if p else None, *link[c, i],
                                 len(msgs[c, i][2]), thread[c, i], place[c, i]) for (c, i), p in parent.items()}


def generated(seed):
    r = random.Random(seed)
    sentence = lambda: " ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(2, 7))) + r.choice(".!?")
    words = lambda n: "\n\n".join(
        r.choice([" ", "\n"]).join(sentence() if r.random() < 0.85 else "Thanks." for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows, texts = [], []
    for c in range(25):
        for turn in range(r.randrange(1, 9)):
            text = ""
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                source = r.choice(texts[-6:] + texts) if texts and r.random() < 0.85 else words(1)
                parts = r.choice([source.split("\n\n"), source.split("\n"), re.split(r"(?<=[.!?]) ", source), source.split(" ")])
                at = r.randrange(len(parts))
                glue = "\n\n" if "\n\n" in source else " "
                piece = r.choice([source, parts[at], glue.join(parts[at:at + 2])])
                if r.random() < 0.3:             # wrapped anew
                    piece = re.sub(r" +", lambda m: r.choice([" ", "\n"]), piece)
                mark = r.choice(["> ", ">", ">> ", "> > "])
                text += r.choice(["", f"On day {turn} Bob wrote:\n"]) + "\n".join(mark + x for x in piece.split("\n")) + "\n"
                text += (words(1) + "\n") if r.random() < 0.3 else ""
            own = words(r.randrange(1, 4))
            rows.append((c, turn * 3, r.choice("ua"), text + own))
            texts.append(own)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_and_reply_order_are_the_plain_ones(spark, seed, tmp_path):
    rows = generated(seed)
    df = spark.createDataFrame([r + (1, 2, 3, "p") for r in rows], SCHEMA).repartition(3)
    got = {(g.conv_id, g.turn): (g.position, norm(g.text), g.parent_conv, g.parent_turn, g.link, g.n_linked, g.n_quotes, g.thread, g.place)
           for g in quotes.link_quotes(df).collect()}
    want = expected(rows)
    assert got == want
    con = duckdb.connect()
    path = str(tmp_path / "conversations.parquet")
    df.toPandas().to_parquet(path)
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    sql = con.sql(quotes.oracle())
    same = quotes.link_quotes(df).select(*sql.columns).collect()
    assert sorted(map(str, map(tuple, same))) == sorted(map(str, sql.fetchall()))
    kinds = collections.Counter(w[4] for w in want.values())
    assert kinds["quote"] > 20 and any(k[0] != w[2] for k, w in want.items() if w[4] == "quote")


def test_partial_quotes(spark):
    text = "First line here.\nSecond line. And third one!\n\nNext paragraph\ngoes on.\n\nThe last."
    rows = [(1, 0, "u", text), (1, 1, "a", "> Next paragraph goes on.\n>\n> The last.\nyes"), (1, 2, "u", "> And third one!\nno"),
            (1, 3, "a", "> Second line. And\n> third one!\nwell"), (1, 4, "u", "> line. And third\nparts of sentences stay unlinked")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {g.turn: (g.link, g.parent_turn, g.position) for g in quotes.link_quotes(df).collect()}
    assert got == {0: ("none", None, 0), 1: ("quote", 0, 1), 2: ("quote", 0, 2), 3: ("quote", 0, 3), 4: ("previous", 3, 4)}


def test_repeated_and_very_long_messages(spark):
    long = " ".join(f"word{k}." for k in range(30_000))
    rows = [(1, 0, "u", long), (1, None, "u", "before"), (1, 1, "a", "> word29999.\nok"), (1, 1, "a", "> word29999.\nok"),
            (2, 0, "u", None), (2, 0, "u", None)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((g.conv_id, g.position) for g in got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert [g.parent_turn for g in got if g.turn == 1] == [0, 0] and {g.link for g in got if g.turn == 1} == {"quote"}
