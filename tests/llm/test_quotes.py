"""Quotation linking on a small exchange, on generated threads against a plain version, and odd rows."""

import re
from random import Random

from clauseloom.llm import queries as Q
from clauseloom.llm import quotes as L

SCHEMA = "conv_id long, turn long, role string, text string, level int"
TALK = [
    (1, 0, "a", "Shall we meet on Monday?\nThe room is free all day.", 0),
    (1, 1, "b", "On Tue, a wrote:\n> Shall we MEET\n> on Monday?\nYes, at ten.", 0),
    (1, 2, "c", "> The room is free all day.\nI will book it.", 0),
    (1, 3, "a", "b wrote:\n>> Shall we meet on Monday?\n> Yes,  at ten!\nFine.\n\n> no such line\nBye.", 0),
    (1, 4, "b", "> > Yes, at ten\n> Fine.\nSee you.", 0),
    (1, 5, "d", "New topic: lunch", 0),
    (2, 0, "a", "> Yes, at ten.\nOther conversation", 0),
]


def test_links_and_threads(spark):
    df = spark.createDataFrame(TALK, SCHEMA)
    links = {(r.conv_id, r.turn, r.nth): (r.level, r.original_turn) for r in L.quote_links(df).collect()}
    assert links == {(1, 1, 1): (1, 0), (1, 2, 0): (1, 0), (1, 3, 1): (2, 0), (1, 3, 2): (1, 1), (1, 3, 4): (1, None), (1, 4, 0): (2, 1), (1, 4, 1): (1, 3), (2, 0, 0): (1, None)}
    got = {(r.conv_id, r.turn): r for r in L.reply_ordered(df).collect()}
    assert {k: (r.reply_to, r.thread, r.depth, r.n_quotes, r.n_linked) for k, r in got.items()} == {
        (1, 0): (None, 0, 0, 0, 0), (1, 1): (0, 0, 1, 1, 1), (1, 2): (0, 0, 1, 1, 1), (1, 3): (1, 0, 2, 3, 2), (1, 4): (3, 0, 3, 2, 2), (1, 5): (None, 5, 0, 0, 0), (2, 0): (None, 0, 0, 1, 0),
    }
    assert [got[1, t].text for t in (1, 2, 3, 4)] == ["Yes, at ten.", "I will book it.", "Fine.\n\nBye.", "See you."]


def test_long_chain(spark):
    rows = [(7, 0, "a", "line 0", 0)] + [(7, t, "a", f"> line {t - 1}\nline {t}", 0) for t in range(1, 70)]
    got = {r.turn: r for r in L.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all((r.thread, r.depth) == (0, t) for t, r in got.items())


def test_odd_rows(spark):
    rows = [(1, 0, None, None, 1), (1, 1, "a", "", 1), (1, 1, "a", "", 1), (None, 2, "a", "> x", 1), (1, None, "a", "> x", 1), (1, 2, "a", "> " + "y" * 60_000, 1), (1, 3, "a", ">\n>>\n> ", 1), (1, 4, "a", "> z\n" * 5_000, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = L.reply_ordered(df).collect()
    assert len(got) == len(rows) and all(r.reply_to is None for r in got)
    assert L.reply_ordered(df.limit(0)).collect() == []


def test_query_keeps_every_message(spark):
    sf = "/root/testdata/sf0.001"
    got = Q.op1_chat_quotations(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert sorted((r.conv_id, r.turn, r.role) for r in got) == sorted((r.conv_id, r.turn, r.role) for r in rows)


def plain(messages):
    """turn -> (text, reply_to, thread, depth, n_quotes, n_linked) of one conversation, message after message."""
    normal = lambda x: re.sub(r"^[ .,;:!?…]+|[ .,;:!?…]+$", "", re.sub(r"\s+", " ", x.lower()))
    said, out = {}, {}
    for turn, text in messages:
        lines = []
        for raw in text.split("\n"):
            marks = re.match(r"^[ \t]*(?:>[ \t]?)+", raw)
            lines.append((marks.group().count(">") if marks else 0, raw[marks.end() :] if marks else raw))
        for i in range(len(lines) - 1):
            if lines[i][0] == 0 and lines[i + 1][0] > 0 and re.match(L.ATTRIBUTION, lines[i][1]):
                lines[i] = (-1, lines[i][1])
        runs = []
        for level, body in lines:
            if runs and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        votes, quoted = {}, 0
        for level, bodies in runs:
            if level <= 0 or not normal("\n".join(bodies)):
                continue
            quoted += 1
            found = {}
            for key, size, whole in [*((normal(b), len(b), False) for b in bodies if normal(b)), (normal("\n".join(bodies)), len("\n".join(bodies)), True)]:
                first = said.get(key)
                w, n = found.get(first, (False, 0))
                found[first] = (w or whole, n + size)
            known = {k: v for k, v in found.items() if k is not None}
            original = max(known, key=lambda k: (*known[k], k)) if known else None
            votes[original] = votes.get(original, [])
            votes[original].append(level)
        linked = [(o, lv) for o, ls in votes.items() if o is not None for lv in ls]
        reply = None
        if linked:
            low = min(lv for _, lv in linked)
            at_low = {o: sum(1 for a, lv in linked if a == o and lv == low) for o, lv in linked if lv == low}
            reply = max(at_low, key=lambda o: (at_low[o], o))
        thread, depth = (out[reply][2], out[reply][3] + 1) if reply is not None else (turn, 0)
        own = "\n".join("\n".join(b) for lv, b in runs if lv == 0)
        out[turn] = (re.sub(r"^\s+|\s+$", "", re.sub(r"\n{3,}", "\n\n", own)), reply, thread, depth, quoted, len(linked))
        for lv, b in runs:
            if lv == 0:
                for key in [*map(normal, b), normal("\n".join(b))]:
                    if key:
                        said.setdefault(key, turn)
    return out


def test_generated_threads_against_plain(spark):
    rng, rows, want = Random(12), [], {}
    words = "meet room day yes ten book lunch train late early gift letter stone river".split()
    for conv in range(40):
        messages = []
        for turn in range(rng.randrange(1, 14)):
            own = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) + rng.choice(["", ".", "?"]) for _ in range(rng.randrange(0, 4))]
            lines = []
            if messages and rng.random() < 0.8:
                source = rng.choice(messages[-3:])[1].split("\n")
                cut = rng.randrange(len(source))
                taken = source[cut : cut + rng.randrange(1, 5)]
                lines += ["Bo wrote:"] if rng.random() < 0.4 else []
                lines += [rng.choice(["> ", ">", " > "]) + (x.upper() if rng.random() < 0.2 else x + rng.choice(["", " ", "!"])) for x in taken]
            lines += own
            if rng.random() < 0.2:
                lines += ["", "", "", "> nobody said this " + rng.choice(words)]
            messages.append((turn, "\n".join(lines)))
        rows += [(conv, turn, "a", text, 0) for turn, text in messages]
        want |= {(conv, turn): v for turn, v in plain(messages).items()}
    got = {(r.conv_id, r.turn): (r.text, r.reply_to, r.thread, r.depth, r.n_quotes, r.n_linked) for r in L.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(v[1] is not None for v in want.values()) > 60 and max(v[3] for v in want.values()) > 3
    for k in want:
        assert got[k] == want[k], (k, [r for r in rows if r[0] == k[0]])
