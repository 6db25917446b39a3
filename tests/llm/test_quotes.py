import random
import re

from loomgraph.llm import quotes


def test_parse():
    body, quoted, own = quotes.parse("> > The deepest words of all\n> What about the second level?\nMy own answer is this.\n>> The deepest words of all")
    assert body == "My own answer is this." and [n for n, _ in quoted] == [2, 1, 2] and quoted[0][1] == quoted[2][1]
    assert quotes.key("my OWN answer -- is this") in own and quotes.parse(None) == ("", [], [])
    assert quotes.passages("a > b\n>c") == [(0, "a > b"), (1, "c")]


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "How do I sort a list in place?"),
        (1, 1, "assistant", "> How do I sort a list in place?\nUse the sort method of it."),
        (1, 2, "user", "Something else: what is a heap?"),
        (1, 3, "user", ">> how do i SORT a list in place\n> Use the sort method of it.\nAnd is that stable?"),
        (1, 4, "assistant", "> And is that stable?\nYes, it is stable indeed."),
        (2, 0, "user", "> Yes, it is stable indeed.\nI read this elsewhere."),
        (2, 1, "user", "> nobody ever said these words\nHm."),
        (3, 0, "user", "How do I sort a list in place?"),
        (3, 1, "user", "> How do I sort a list in place?\nAs I said."),
        (3, 2, "user", "> yes\nshort quote"),
        (4, 0, None, None),
        (None, 1, "user", "> How do I sort a list in place?\nlost"),
        (5, None, "user", "How do I sort a list in place?"),
        (6, 0, "user", "same"),
        (6, 0, "user", "same"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string").repartition(3)
    got = quotes.link(df).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    reply = {k: (r["reply_conv"], r["reply_turn"]) for k, r in by.items() if r["reply_turn"] is not None}
    assert reply == {(1, 1): (1, 0), (1, 3): (1, 1), (1, 4): (1, 3), (2, 0): (1, 4), (3, 1): (3, 0)}
    assert by[(1, 3)]["n_linked"] == 2 and by[(2, 0)]["depth"] == 4 and (by[(2, 0)]["root_conv"], by[(2, 0)]["root_turn"]) == (1, 0)
    assert by[(2, 1)]["n_quotes"] == 1 and by[(2, 1)]["body"] == "Hm." and by[(4, 0)]["body"] == "" and by[(3, 2)]["body"] == "short quote"
    order = [(r["conv_id"], r["turn"]) for r in sorted((r for r in got if r["place"] and (r["root_conv"], r["root_turn"]) == (1, 0)), key=lambda r: r["place"])]
    assert order == [(1, 0), (1, 1), (1, 3), (1, 4), (2, 0)] and by[(1, 2)]["place"] == 1
    assert quotes.link(df.limit(0)).count() == 0


def test_quotes_of_parts(spark):
    one = "The first paragraph is about lists.\n\nThe second one is about heaps,\nand it has a second line too.\n\nThe third is short. It has two sentences. Or three of them!"
    rows = [
        (1, 0, one),
        (1, 1, "> The first paragraph is about lists.\n>\n> The third is short. It has two sentences. Or three of them!\nTwo of three paragraphs."),
        (1, 2, "> and it has a second line too.\n> The third is short.\nA line and a sentence."),
        (1, 3, "> It has two sentences.\nOne sentence within a line."),
        (1, 4, "are you ok"),
        (1, 5, "> Are you OK?\nYes."),
        (2, 0, "> are you ok\nShort words of another conversation."),
        (2, 1, "> these words nobody said. Nor these ones.\nHm."),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(df).collect()}
    reply = {k: (r["reply_conv"], r["reply_turn"]) for k, r in got.items() if r["reply_turn"] is not None}
    assert reply == {(1, 1): (1, 0), (1, 2): (1, 0), (1, 3): (1, 0), (1, 5): (1, 4)}
    assert all(got[k]["n_linked"] == 1 and got[k]["n_quotes"] == 1 for k in reply) and got[(2, 0)]["n_linked"] == 0


def norm(x):
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", x.encode().lower().decode()))


def cut(text):
    """(level, lines) runs, quote marks taken off."""
    out = []
    for line in text.split("\n"):
        n = 0
        while m := re.match(r"[ \t]*>", line):
            n, line = n + 1, line[m.end() :]
        if out and out[-1][0] == n:
            out[-1][1].append(line)
        else:
            out.append((n, [line]))
    return [(n, "\n".join(x)) for n, x in out]


def parts_of(p):
    """The passage, its paragraphs, lines and sentences."""
    paragraphs = re.split(r"\n[ \t]*\n", p)
    return [[p], paragraphs, p.split("\n"), [s for q in paragraphs for s in re.split(r"(?<=[.!?])\s+", q)]]


def plain(rows):
    """For each message the message that it replies to and how many quotes are linked; every part looked up among all messages."""
    said = {}
    for c, t, x in sorted(rows):
        own = [p for n, p in cut(x) if n == 0]
        for part in ["\n".join(own), *[y for p in own for g in parts_of(p) for y in g]]:
            if norm(part):
                said.setdefault(norm(part), []).append((c, t))
    out = {}
    for c, t, x in rows:
        linked = []
        quoted = [(n, p) for n, p in cut(x) if n and any(norm(y) for g in parts_of(p) for y in g)]
        for place, (n, p) in enumerate(quoted):
            seen, votes = set(), {}
            for grain, g in enumerate(parts_of(p)):
                for y in g:
                    if not norm(y) or norm(y) in seen:
                        continue
                    seen.add(norm(y))
                    at = said.get(norm(y), [])
                    here = [m for m in at if m[0] == c][:1]
                    to = here[0] if here and here[0] < (c, t) else at[0] if at and at[0] < (c, t) and len(norm(y)) >= quotes.LEAST else None
                    if to:
                        votes[grain, to] = votes.get((grain, to), 0) + len(norm(y))
            if votes:
                grain, to = min(votes, key=lambda k: (k[0], k[1][0] != c, -votes[k], k[1]))
                linked.append((n, place, to))
        out[c, t] = (min(linked)[2] if linked else None, len(linked))
    return out


def test_like_a_plain_search(spark):
    rng = random.Random(8)
    sentences = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randrange(1, 6))) + rng.choice(".!?") for _ in range(40)]
    rows = []
    for c in range(25):
        for t in range(rng.randrange(1, 12)):
            body = [rng.choice(["", "> ", ">> ", "> > "]) + " ".join(rng.choices(sentences, k=rng.randrange(1, 3))) for _ in range(rng.randrange(1, 4))]
            if rows and rng.random() < 0.6:
                body = ["> " + line for line in rng.choice(rows)[2].split("\n")] + body
            rows.append((c, t, "\n".join(body)))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(df).collect()}
    want = plain(rows)
    assert sum(to is not None for to, _ in want.values()) > 50
    for k, (to, n) in want.items():
        r = got[k]
        assert ((r["reply_conv"], r["reply_turn"]) if to else r["reply_turn"], r["n_linked"]) == (to, n), k
        depth, at = 0, k
        while want[at][0]:
            depth, at = depth + 1, want[at][0]
        assert (r["depth"], r["root_conv"], r["root_turn"]) == (depth, *at)
    places = sorted((r["root_conv"], r["root_turn"], r["place"], k) for k, r in got.items())
    assert all(a[:2] != b[:2] and b[2] == 1 or a[:2] == b[:2] and b[2] == a[2] + 1 and a[3] < b[3] for a, b in zip(places, places[1:], strict=False))


def test_long_thread(spark):
    """Three hundred messages, each quoting the one before."""
    rows = [(1, i, "user", f"> message number {i - 1} of many\nmessage number {i} of many" if i else "message number 0 of many") for i in range(300)]
    got = {r["turn"]: r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert all(got[i]["depth"] == i and got[i]["place"] == i + 1 and got[i]["root_turn"] == 0 for i in range(300))
