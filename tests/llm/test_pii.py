import hashlib
import math
import random
import re

import pytest

from loomgraph.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in t) % 10 == 0


def brute(text):
    out = []
    for i, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_like_brute_force(spark):
    rng = random.Random(4)
    bits = ["a", "_b", "@", "x.y", ".", "1", "255", "256", "0007", "-", " ", "+", "+1 (523) 555-1055", "4111 1111-1111 1111", "é🙂", "10.0.0.1", "me@ex-a.org", "(", "\n", "37828224631000" "5", "9" * 16]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", "a" * 60_000, "1" * 60_000, "1." * 30_000, "a@" * 20_000, "+1" * 20_000, "10.0.0.1 " * 2000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs, pii.Settings(support=10**9))).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i]["spans"] == want, repr((t or "")[:200])
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[i]["n_email"] == want.count("email:")


@pytest.fixture
def told(spark):
    rows = [(i, f"Note {i}: call Zorro Smith at +1 (523) 555-1055 or write, nr {i}", "en") for i in range(6)]
    rows += [(100 + i, f"The smith says nothing of interest in text {i} or write", "en") for i in range(60)]
    rows += [(300, None, "en"), (None, "mail a.b@c.org now", "fr"), (1, rows[1][1], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


def plain_spans(texts, s):
    """All spans of each text, counted one by one."""
    base = {t: [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in brute(t).split(",") if x] for t in set(texts) if t is not None}
    word = re.compile(r"[^\W_]+")
    n, holds, ents, near = len(base), {}, {}, {}
    for t, spans in base.items():
        for w in set(word.findall(t.lower())):
            holds[w] = holds.get(w, 0) + 1
        free = {m[0].lower() for m in word.finditer(t) if all(m.end() < a or b < m.start() for _, a, b in spans)}
        mine = {(k, re.sub("[^0-9]", "", t[a:b]) if k in ("card", "phone") else t[a:b].lower()) for k, a, b in spans}
        for e in mine:
            ents.setdefault(e, set()).add(t)
            for w in free:
                near.setdefault((e, w), set()).add(t)
    bad = {}
    for (e, w), at in near.items():
        n_e, n_t, n_et = len(ents[e]), holds[w], len(at)
        x, ic = n_e * n_t / n, math.log2(n / n_e)
        if ic > 0 and math.log2(n * n_et / (n_e * n_t)) >= s.alpha * ic - 1e-12 and n_et * math.log(n_et / x) - n_et + x >= -math.log(s.chance):
            for t in at:
                bad.setdefault(t, set()).add(w)
    out = []
    for t in texts:
        spans = list(base.get(t, []))
        spans += [("term", m.start(), m.end()) for m in word.finditer(t or "") if m[0].lower() in bad.get(t, ()) and all(m.end() <= a or b <= m.start() for _, a, b in base[t])]
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0])))))
    return out


@pytest.mark.parametrize("alpha", [0.8, 0.5])
def test_terms_like_a_plain_count(spark, alpha):
    rng = random.Random(7)
    people = [(f"Nam{i} Sur{i % 3}", f"p{i}@host.org" if i % 2 else f"+1 (523) 555-10{i:02}") for i in range(12)]
    common = [f"w{i}" for i in range(30)]
    texts = []
    for i in range(400):
        t = rng.choices(common, k=rng.randrange(4, 12))
        if i % 5 == 0:
            name, mark = people[min(11, int(rng.expovariate(0.4)))]
            t += [name, rng.choice(["by", "of,"]), mark] if i % 15 else [mark, "and", people[i % 12][1]]
        texts.append(" ".join(t))
    texts += [None, "", texts[0], texts[5], "Only Zed at z@z.zz and Zed", "Zed z@z.zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    s = pii.Settings(alpha=alpha)
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(docs, s)).collect()}
    want = plain_spans(texts, s)
    assert sum("term" in x for x in want) > 20
    assert [got[i] for i in range(len(texts))] == want


def test_clashing_names(told):
    names = {"_h": "x1", "_terms": "x2", "_base": "x3", "_spans": "x4", "row": "x5", "h": "x6", "t": "x7", "n_e": "x8"}
    docs = told.withColumns({k: pii.F.lit(v) for k, v in names.items()})
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == told.count() and all(r[k] == v for r in rows for k, v in names.items())
    assert sorted(r["text"] or "" for r in rows) == sorted(r["text"] or "" for r in pii.sanitise(told).collect())
    assert [c for c in pii.find(docs).columns if c in names] == ["_h", "_terms", "row", "h", "t", "n_e", "_base", "_spans"]


def test_terms_that_disclose(told):
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(told, pii.Settings(alpha=0.6)).collect()}
    assert "Zorro" not in out[0] and "[PHONE]" in out[0] and "555" not in out[0]
    assert "mail [EMAIL] now" == out[None] and out[300] is None
    assert out[101] == "The smith says nothing of interest in text 1 or write"
    assert pii.sanitise(told).columns == told.columns and pii.sanitise(told).count() == told.count()
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(told, pii.Settings(alpha=0.6))).collect()}
    assert "term:13:18" in spans[0].split(",") and spans[101] == ""
    assert pii.find(told.limit(0)).count() == 0


def test_entities_of_one_text(spark):
    """With the production parameters."""
    rows = [(i, f"The text of this row tells nothing much, row {i}") for i in range(1500)]
    rows += [(2000, "Ask Quexley of this row at q.x@host.org"), (2001, "The text by Zorro Smith: +1 (523) 555-1055"), (2002, "Smith tells nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "Quexley" not in out[2000] and "of this row" in out[2000] and "[EMAIL]" in out[2000]
    assert "Zorro" not in out[2001] and "[TERM]" in out[2001] and "Smith" not in out[2001] and out[2001].startswith("The text")
    assert all(out[i] == t for i, t in rows if i not in (2000, 2001))


def test_terms_far_from_their_entity(spark):
    far = "The text of this row tells nothing much. " * 5
    rows = [(i, f"The text of this row tells nothing much, row {i}") for i in range(1500)]
    rows += [(2000 + i, f"Zorro wrote. {far}Call +1 (523) 555-1055, row {i}") for i in range(4)]
    rows += [(2010, rows[1500][1]), (3000, f"q.x@host.org\n{far}Yours, Quexley"), (3001, "Somebody wrote of zorro")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all(out[2000 + i].startswith("[TERM] ") and "555" not in out[2000 + i] for i in range(4)) and out[2010] == out[2000]
    assert out[3000].startswith("[EMAIL]\nThe text of this row") and "Quexley" not in out[3000]
    assert out[3001] == "Somebody wrote of zorro" and out[7] == rows[7][1]


def test_no_python_in_the_plan(told):
    plan = pii.find(told)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
