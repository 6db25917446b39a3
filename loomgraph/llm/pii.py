r"""Personal data by patterns and by information-theoretic sanitisation, in DataFrame functions only.

Base spans are the matches of four patterns. Every base value is a protected entity e. A term t, a word anywhere in a text
with e but not in or against a base span, is judged by corpus counts over distinct texts: n(e), n(t), and n(e, t), the texts
that hold both. With PMI(e; t) = log2(N n(e, t) / (n(e) n(t))) and IC(e) = log2(N / n(e)), t discloses e when
PMI >= alpha IC(e), unless independent e and t would share n(e, t) texts by chance: n ln(n / x) - n + x >= -ln(chance), with
n = n(e, t) and x = n(e) n(t) / N (Chernoff's bound; half of Dunning's G^2). So entities and terms of a single text are judged
too. At alpha 0.8 the bound decides only for entities that more than one of about 1,100 texts hold (in fewer texts: all); there
it keeps a single common text from being taken for evidence. In texts that contain e such a t is a further span: removed when it never occurs
without e, generalised to a class otherwise.

All counts cover all texts; equal texts count once. Pairs are counted with partial sums, so an entity or a term that many
texts hold is no hot key. Offsets are code points, the end exclusive.

Edge cases: a null text is empty and stays null in `sanitise`; matches that fail their kind's test are dropped without
retry; overlapping spans of several kinds all count, and the sanitised text has one placeholder for a run of overlapping
ones; repeated rows and null ids are judged each; an empty table gives an empty result; columns whose names
the operator uses itself stay, but for _base and _spans, which `find` replaces.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import materialise

KINDS = ("email", "ip", "card", "phone", "term")

# The contract's patterns. Possessive repetition and the look-behind change no match; they keep the search linear:
# a match can only begin where a run begins or the match before ended.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_ANY = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_WORD = r"[\p{L}\p{N}]+"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"


class Settings(NamedTuple):
    alpha: float = 0.8
    support: int = 1
    chance: float = 0.01
    #: Terms and hashes of texts up to these numbers are looked up by a broadcast table (at most some 64 and 32 bytes each), more by a shuffled join.
    broadcast_terms: int = 200_000
    broadcast_texts: int = 500_000


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, f) -> Column:
    """f(value), with value computed once: Spark would compute it again wherever a lambda names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _begins(lengths: Column) -> Column:
    """Running sums before each entry, in blocks of 128 so that many matches cost no square."""
    sums = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 128).cast("int")), lambda b: _total(F.slice(v, b * 128 + 1, 128)))
    before = lambda v: F.transform(v, lambda _, i: _total(F.slice(v, 1, i)))
    inside = lambda v, blocks: F.transform(v, lambda _, i: F.get(blocks, F.floor(i / 128).cast("int")) + _total(F.slice(v, F.floor(i / 128).cast("int") * 128 + 1, i % 128)))
    return _let(lengths, lambda v: F.when(F.size(v) <= 128, before(v)).otherwise(_let(before(sums(v)), lambda blocks: inside(v, blocks))))


def matches(text: Column, pattern: Column, kind: int) -> Column:
    """All matches in order as SPAN. The pieces between them give the offsets."""
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s))

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(gaps, found, lambda g, m: g + F.coalesce(F.char_length(m), F.lit(0)))  # a gap and the match after it
        starts = F.zip_with(_begins(steps), gaps, lambda s, g: s + g)
        return F.zip_with(found, F.slice(starts, 1, F.size(found)), lambda m, s: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.char_length(m)).alias("end"), m.alias("value")))

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: _let(gaps, lambda g: placed(found, g)))


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def worth(i: Column) -> Column:  # i counts from the right, from 0
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when(F.char_length(digits).between(14, 19), _let(digits, _luhn)).otherwise(False)
    return F.char_length(digits).between(10, 15)


def _test(kind: str):
    return lambda m: _holds(kind, m["value"])


def base_spans(text: Column) -> Column:
    """SPAN of the four base kinds, by start, then kind. Null and empty texts have none."""
    none = F.array().cast(SPAN)
    parts = []
    for i, kind in enumerate(KINDS[:4]):
        first = text.contains("@") & text.rlike(_ANY[kind]) if kind == "email" else text.rlike(_ANY[kind])
        parts.append(F.when(first, F.filter(matches(text, F.lit(_PATTERNS[kind]), i), _test(kind))).otherwise(none))
    return F.coalesce(F.array_sort(F.concat(*parts)), none)


def entity(span: Column) -> Column:
    """The protected entity of a base span: kind and normalised value."""
    plain = F.when(span["kind"] >= 2, F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"].cast("string"), plain)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


def _outside(text: Column, spans: Column) -> Column:
    """Distinct lower-cased words of the text that no span overlaps or touches."""
    bare = _replaced(F.translate(text, "\0", " "), spans, lambda m: F.lit("\0"))
    return _words(F.regexp_replace(bare, r"[\p{L}\p{N}]*+\x00[\p{L}\p{N}\x00]*+", " "))


def _no_chance(n_e: Column, n_t: Column, n_et: Column, n: int, s: Settings) -> Column:
    x = n_e * n_t / F.lit(float(max(n, 1)))
    return n_et * F.ln(n_et / x) - n_et + x >= -math.log(s.chance)


def _counts(docs: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """t, n_t: words with the number of distinct texts that hold them; and the number of distinct texts.

    Only the hashes of all texts are shuffled, and words after they are counted; the words of texts that repeat, once each.
    """
    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("h"), "text")
    sizes = materialise(texts.groupBy("h").agg(F.count("*").alias("k")).groupBy((F.col("k") > 1).alias("twice"), F.when(F.col("k") > 1, F.col("h")).alias("h")).agg(F.count("*").alias("k")), "texts")
    n = sizes.agg(F.sum("k")).first()[0] or 0
    twice = sizes.filter("twice").select("h", "twice")
    if twice.count() <= s.broadcast_texts:
        twice = F.broadcast(twice)
    marked = texts.join(twice, "h", "left").select("h", "twice", F.explode(_words(F.col("text"))).alias("t"))
    once = marked.filter("twice is null").groupBy("t").agg(F.count("*").alias("n_t"))
    more = marked.filter("twice").select("h", "t").distinct().groupBy("t").agg(F.count("*").alias("n_t"))
    return once.unionByName(more).groupBy("t").agg(F.sum("n_t").alias("n_t")), n


def disclosing(docs: DataFrame, spanned: DataFrame, s: Settings = Settings()) -> DataFrame:
    """h (a text's hash), t, level (2: removed, 1: generalised). docs: every row (text); spanned: those with base spans (text, _base).

    Entities that stand in the same texts are one class, so a text has at most one class of entities that no other text has.
    As n(e, t) <= n(e), t can disclose e only if n(t) <= N (n(e) / N) ** alpha: other pairs are not made.
    """
    once = spanned.withColumn("h", F.xxhash64("text")).dropDuplicates(["h"])
    he = materialise(once.select("h", F.explode(F.array_distinct(F.transform("_base", entity))).alias("e")), "entities")
    # texts that hold e, known by two sums of their hashes
    of = he.groupBy("e").agg(F.count("*").alias("n_e"), F.bit_xor("h").alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "h")).alias("x2"))
    classes = materialise(he.join(of, "e").select("h", "n_e", "x1", "x2").distinct(), "classes")
    counts, n = _counts(docs, s)
    total = F.lit(float(max(n, 1)))
    bound = lambda n_e: total * F.pow(n_e / total, F.lit(s.alpha)) * (1 + 1e-9)
    most = classes.agg(F.max("n_e")).first()[0] or 1
    words = once.select("h", F.explode(_outside(F.col("text"), F.col("_base"))).alias("t"))
    rare = words.join(counts.filter(F.col("n_t") <= bound(F.lit(float(most)))), "t")
    pairs = materialise(rare.join(classes, "h").filter(F.col("n_t") <= bound(F.col("n_e"))), "pairs")

    def judged(pairs: DataFrame) -> DataFrame:
        ic = F.log2(total / F.col("n_e"))
        pmi = F.log2(total * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
        fit = (F.col("n_et") >= s.support) & (ic > 0) & (pmi >= s.alpha * ic * (1 - 1e-12)) & _no_chance(F.col("n_e"), F.col("n_t"), F.col("n_et"), n, s)
        return pairs.filter(fit).withColumn("level", F.when(F.col("n_et") >= F.col("n_t"), 2).otherwise(1))

    own = judged(pairs.filter("n_e = 1").withColumn("n_et", F.lit(1))).select("h", "t", "level")
    key = ["n_e", "x1", "x2", "t"]
    wide = pairs.filter("n_e > 1")
    bad = materialise(judged(wide.groupBy(*key).agg(F.first("n_t").alias("n_t"), F.count("*").alias("n_et"))).select(*key, "level"), "terms")
    if bad.count() <= s.broadcast_terms:
        bad = F.broadcast(bad)
    return own.unionByName(wide.join(bad, key).select("h", "t", "level")).groupBy("h", "t").agg(F.max("level").alias("level"))


def _found(docs: DataFrame, s: Settings) -> DataFrame:
    """row (a struct of the columns other than text), text, _base and _spans of each row of docs."""
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
    docs = docs.select(F.struct(*others).alias("row"), "text")
    marked = docs.withColumn("_base", base_spans(F.col("text")))
    some = materialise(marked.filter(F.size("_base") > 0), "spanned")
    none = F.array().cast(SPAN)
    rest = docs.filter(F.size(base_spans(F.col("text"))) == 0).withColumns({"_base": none, "_spans": none})
    # a text's terms, by its hash: equal texts share them
    bad = materialise(disclosing(docs, some, s), "disclosing")
    keyed = some.withColumn("_h", F.xxhash64("text"))
    mine = bad.groupBy(F.col("h").alias("_h")).agg(F.collect_list(F.struct("t", "level")).alias("_terms"))
    joined = keyed.join(mine, "_h", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("_terms", lambda x: x["t"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    levels = F.map_from_entries("_terms")
    raw = F.when(F.col("_terms").isNotNull(), matches(F.col("text"), pattern, 4)).otherwise(F.array().cast(SPAN))
    clear = F.filter(raw, lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    named = F.transform(clear, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.coalesce(F.try_element_at(levels, F.lower(m["value"])), F.lit(1)).cast("string").alias("value")))
    done = joined.withColumn("_spans", F.array_sort(F.concat("_base", named)))
    return rest.unionByName(done.select("row", "text", "_base", "_spans"))


def _column(c: str) -> Column:
    return (F.col("text") if c == "text" else F.col("row").getField(c)).alias(c)


def find(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs (with text) and the columns _base and _spans (SPAN; the value of a term is its level), in place of any of these names."""
    return _found(docs, s).select(*[_column(c) for c in docs.columns if c.lower() not in ("_base", "_spans")], "_base", "_spans")


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    of = lambda i: lambda m: m["kind"] == i
    n = [F.size(F.filter("_base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *n, F.sha2(_text_of(F.col("_base")), 256).alias("base_sha256"), _text_of(F.col("_spans")).alias("spans"))


def _replaced(text: Column, spans: Column, mark) -> Column:
    """The text with mark(span) for each run of overlapping spans."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, m: Column) -> Column:
        piece = F.concat(F.substring(text, a["at"] + 1, m["start"] - a["at"]), mark(m))
        new = F.when(m["start"] >= a["at"], F.concat(a["out"], F.array(piece))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], m["end"]).alias("at"), new.alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with a placeholder for each run of overlapping spans; terms of level 2 go."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    mark = lambda m: F.when((m["kind"] == 4) & (m["value"] == "2"), "").otherwise(F.element_at(names, m["kind"] + 1))
    return F.when(F.size(spans) > 0, _replaced(text, spans, mark)).otherwise(text)


def sanitise(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs, its columns, with the text sanitised (and n_chars, where there, counted anew)."""
    new = {"text": sanitised(F.col("text"), F.col("_spans")).alias("text")}
    if "n_chars" in docs.columns:
        n = F.when(F.size("_spans") > 0, F.char_length(new["text"])).otherwise(_column("n_chars"))
        new["n_chars"] = n.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return _found(docs, s).select(*[new.get(c, _column(c)) for c in docs.columns])
