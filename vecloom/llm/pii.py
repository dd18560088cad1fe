"""Personal data and secrets: candidate spans scored by boosted trees.

Generators with high recall propose spans, which may overlap: the strict pattern of each kind,
and loose forms (e-mail addresses that are spelled out, addresses of sixteen-bit groups, card
numbers with other separators, phone numbers without a country code; and secrets: assigned keys,
tokens and passwords, known key formats, long hexadecimal strings, bank account and social
security numbers). Boosted trees score each candidate from its format and its context; thresholds
that are calibrated for each kind select spans. What the strict rules accept is always selected;
of added spans that overlap in a chain the best one is. Only built-in DataFrame functions run on
the texts; the trees become SQL expressions.

The trees are fitted on texts that made_texts() makes up, the same for every input, and their
thresholds are set on texts of another style (other words, hints and settings).

Edge cases: null and empty texts have no spans; repeated rows each give a row; spans of one kind
and start can't be told apart but by their end, and the longest comes last; other columns are
ignored; tables without rows give none. Patterns never retry inside a run, and places and overlaps
are worked out in blocks of BLOCK matches, so very long texts and texts with thousands of matches
take time about in proportion to their length.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vector import let
from vecloom.llm import boosting

KINDS = ["email", "ip", "card", "phone"]
#: The kinds with strict rules, and what the trees alone decide.
ALL_KINDS = [*KINDS, "secret"]
#: The strict patterns (fixed values), written so that no position is tried twice: a match begins at the start of a run or where the last one ended.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[a-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[a-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:[a-z_-]{0,16}(?:key|token|secret|passwd|password|pwd)[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?[a-z0-9+/_.~-]{8,}+"
    r"|(?:akia|asia)[0-9a-z]{16}(?![0-9a-z])|gh[pousr]_[a-z0-9]{36,}+|xox[baprs]-[a-z0-9-]{10,}+|sk-[a-z0-9]{20,}+|eyj[a-z0-9_-]{10,}+\.[a-z0-9_-]{10,}+\.[a-z0-9_-]{10,}+|-----begin\x20[a-z\x20]{0,20}private\x20key-----"
    r"|[0-9a-f]{32,}+(?![0-9a-z])|[a-z]{2}[0-9]{2}(?:\x20?[a-z0-9]{4}){3,7}(?:\x20?[a-z0-9]{1,3})?(?![0-9a-z])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))",
}
#: What a text must hold for any secret to be searched.
SECRET_GATE = r"(?i)[:=]\x20{0,2}[\"']?[a-z0-9+/_.~-]{8}|akia|asia[0-9]|gh[pousr]_|xox[baprs]-|sk-[a-z0-9]|eyj|-----begin|[0-9a-f]{32}|[a-z]{2}[0-9]{2}\x20?[a-z0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: Words before a span that speak for a kind.
HINTS = {
    "email": "mail|contact|write|reach|address",
    "ip": r"\bip\b|host|server|address|login|client",
    "card": "card|visa|credit|debit|payment|cvv|expir",
    "phone": "phone|tel|call|mobile|cell|fax|dial|number|contact",
    "secret": r"key|token|secret|passw|pwd|iban|account|\bssn\b|social|credential|bearer",
}
CONTEXT = 32
FEATURES = ["kind", "strict", "length", "digits", "share", "separators", "distinct", "luhn", "hint", "other", "before", "after", "top", "assigned"]
SPAN = "struct<kind:int,strict:boolean,start:int,end:int,s:string,digits:string,before:string,after:string>"
#: Matches of a block; the blocks themselves are as many as matches / BLOCK.
BLOCK = 64


def running(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """emit(state, item) for each item in order, where step(state, item) is the state after it. No array grows longer than a block or the list of blocks."""

    def block(state: Column, part: Column) -> Column:
        start = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out")), lambda acc: acc["out"])

    def blocks(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, F.lit(BLOCK)))

    def states(cut: Column) -> Column:
        """The state before each block."""
        start = F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("starts"))
        after = lambda acc, part: F.struct(F.aggregate(part, acc["state"], step).alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts"))
        return F.aggregate(cut, start, after, lambda acc: acc["starts"])

    pieces = lambda cut: F.flatten(F.zip_with(states(cut), cut, block))
    return let(items, lambda own: F.when(F.size(own) > 0, let(blocks(own), pieces)).otherwise(F.array().cast(f"array<{kind}>")))


def _found(text: Column, kind: int, pattern: str, strict: bool) -> Column:
    """Matches of a pattern with their places and context, from the matches and the gaps between them."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = lambda h, g: F.arrays_zip(h.alias("s"), F.slice(g, 1, F.size(h)).alias("gap"), F.slice(g, 2, F.size(h)).alias("next"))
    pairs = let(hits, lambda h: let(gaps, lambda g: zipped(h, g)))

    def place(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        context = F.lower(F.substring(x["gap"], -CONTEXT, CONTEXT)).alias("before"), F.substring(x["next"], 1, 1).alias("after")
        return F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), start.alias("start"), (start + F.length(x["s"])).alias("end"), x["s"].alias("s"), digits_of(x["s"]).alias("digits"), *context)

    placed = running(pairs, F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["s"]), place, SPAN)
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(f"array<{SPAN}>"))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits fits."""
    doubled = lambda x, i: F.when(i % 2 == 1, F.translate(x, "0123456789", "0246813579")).otherwise(x).cast("int")
    single = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda x: x != "")), doubled)
    return (F.length(digits) > 0) & (F.aggregate(single, F.lit(0), lambda total, x: total + x) % 10 == 0)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _told(c: Column) -> Column:
    """What both the strict rules and the features of a candidate need, each worked out once."""
    n, size = F.length(c["digits"]), F.length(c["s"])
    part = lambda p: F.regexp_replace(p, "^0+", "")
    small = F.forall(F.split(c["s"], r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    return F.struct(
        *[c[x].alias(x) for x in ("kind", "strict", "start", "end")],
        n.alias("n"),
        size.alias("size"),
        luhn(F.substring(c["digits"], 1, 19)).alias("luhn"),
        F.when(c["kind"] == 1, small).otherwise(False).alias("small"),
        F.length(F.regexp_replace(c["s"], "[A-Za-z0-9]", "")).alias("separators"),
        F.size(F.array_distinct(F.split(c["digits"], ""))).alias("distinct"),
        F.length(F.regexp_extract(c["s"], "[A-Za-z]*$", 0)).alias("top"),
        c["s"].rlike("[:=]").alias("assigned"),
        F.array(*[c["before"].rlike(HINTS[name]).cast("int") for name in ALL_KINDS]).alias("hints"),
        c["before"].rlike("[a-z0-9]$").alias("joined"),
        c["after"].rlike("[A-Za-z0-9]").alias("goes_on"),
    )


def _base(c: Column) -> Column:
    """Whether the strict rules of a candidate's kind accept it."""
    rule = F.when(c["kind"] == 0, True).when(c["kind"] == 1, c["small"]).when(c["kind"] == 2, c["n"].between(13, 19) & c["luhn"]).otherwise(c["n"].between(9, 15))
    return c["strict"] & rule


def _features(c: Column) -> list[Column]:
    own = F.element_at(c["hints"], c["kind"] + 1)
    every = F.aggregate(c["hints"], F.lit(0), lambda total, x: total + x)
    values = [c["kind"], c["strict"], c["size"], c["n"], c["n"] / F.greatest(c["size"], F.lit(1)), c["separators"], c["distinct"], c["luhn"], own, every - own, c["joined"], c["goes_on"], c["top"], c["assigned"]]
    return [v.cast("double").alias(name) for v, name in zip(values, FEATURES)]


def candidates(df: DataFrame, text: str) -> DataFrame:
    """df with `found`: an array of kind, strict, start, end, s."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    parts = []
    none = F.array().cast(f"array<{SPAN}>")
    for k, name in enumerate(KINDS):
        gate = F.contains(t, F.lit("@")) if name == "email" else digit
        loose = t.rlike(r"(?i)[\x20(\[{]at[\x20)\]}]") if name == "email" else F.contains(t, F.lit(":")) if name == "ip" else digit
        parts += [F.when(gate, _found(t, k, STRICT[name], True)).otherwise(none), F.when(loose, _found(t, k, LOOSE[name], False)).otherwise(none)]
    parts.append(F.when(t.rlike(SECRET_GATE), _found(t, len(KINDS), LOOSE["secret"], False)).otherwise(none))
    return df.withColumn("found", F.concat(*parts))


#: Two styles of made texts: syllables, hints before a span, and what stands between words.
STYLES = [
    (["ta", "re", "mo", "lin", "es", "or", "un", "ka", "vi", "den"], {"email": ["mail:", "contact", "write to"], "ip": ["host", "login from", "ip"], "card": ["card", "visa", "payment"], "phone": ["call", "tel.", "mobile", "phone:"], "secret": ["our secret", "use the key", "credential"]}, [" ", ", ", ".", " and "]),
    (["the", "ing", "al", "ch", "que", "so", "ed", "wh", "pa", "ion", "st"], {"email": ["reach me at", "e-mail", "address:"], "ip": ["server", "from client", "address"], "card": ["credit", "debit", "paid by card"], "phone": ["dial", "fax", "number", "cell"], "secret": ["bearer", "password", "account"]}, [" ", "; ", "\n", "!! ", " | "]),
]


def made_texts(seed: int = 3, each: int = 600, style: int = 0) -> list[tuple[str, int, int, int]]:
    """Made-up texts, each with one span in question: text, where the span starts, its kind, and whether it is personal data."""
    rng = random.Random(seed)
    syllables, hints, ends = STYLES[style]
    pick = rng.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    word = lambda: "".join(pick(syllables) for _ in range(rng.randint(1, 3)))

    def card(n: int) -> str:
        body = pick("3456") + digits(n - 2)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def wrong(n: int) -> str:
        good = card(n)
        return good[:-1] + str((int(good[-1]) + rng.randint(1, 9)) % 10)

    byte = lambda: str(rng.randint(0, 255))
    four = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))
    hex4 = lambda: f"{rng.randint(0, 65535):x}"
    hexes = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    yes = {
        "email": [lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{word()}{digits(2)} (at) {word()} (dot) org", lambda: f"{word()} [at] {word()}.net", lambda: f"{word()} at {word()} dot com"],
        "ip": [lambda: ".".join(byte() for _ in range(4)), lambda: ":".join(hex4() for _ in range(8))],
        "card": [lambda: card(16), lambda: four(card(16), " "), lambda: four(card(16), "."), lambda: four(card(16), "/"), lambda: card(15)],
        "phone": [lambda: f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"],
        "secret": [lambda: f'token = "{hexes(40)}"', lambda: f"api_key: {hexes(32)}", lambda: f"password={word()}{digits(4)}{word()}", lambda: f"{pick(['ghp_', 'ghs_'])}{mixed(36)}", lambda: f"AKIA{mixed(16).upper()}", lambda: f'SECRET = "{hexes(40).upper()}"', lambda: f"{pick(['DE', 'FR', 'ES'])}{digits(20)}", lambda: f"sk-{mixed(24)}"],
    }
    no = {
        "email": [lambda: f"{word()} at {word()}. {word()}", lambda: f"{word()} at {word()} dot {word()}"],
        "ip": [lambda: f"{rng.randint(256, 9999)}.{byte()}.{byte()}.{digits(4)}", lambda: ":".join(digits(2) for _ in range(6))],
        "card": [lambda: wrong(16), lambda: digits(rng.randint(5, 12)), lambda: four(wrong(16), "."), lambda: four(wrong(16), "/"), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}"],
        "phone": [lambda: f"+{digits(3)}-{digits(2)}", lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"+{digits(20)}"],
        "secret": [lambda: hexes(40), lambda: hexes(64), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"key: {word()}{word()}{word()}", lambda: f"token = {word()}_{word()}{word()}{word()}"],
    }
    out = []
    for kind in ALL_KINDS:
        for label, forms in ((1, yes[kind]), (0, no[kind])):
            for i in range(each):
                form = forms[i % len(forms)]
                hinted = rng.random() < (0.97 if label and i % len(forms) else 0.5 if label else 0.03)
                before = " ".join(word() for _ in range(rng.randint(1, 8))) + " " + (pick(hints[kind]) + " " if hinted else "")
                span = form()
                out.append((before + span + pick(ends) + " ".join(word() for _ in range(rng.randint(1, 6))), len(before), ALL_KINDS.index(kind), label))
    return out


@dataclass
class PiiModel:
    trees: tuple[float, list[boosting.Node]]
    thresholds: list[float]
    precision: list[float]


def fit_pii(spark: SparkSession, least_precision: float = 0.99) -> PiiModel:
    """Grow the trees on made texts of one style; set each kind's threshold on texts of the other."""
    texts = [*((*t, 0) for t in made_texts()), *((*t, 1) for t in made_texts(seed=4, each=300, style=1))]
    rows = F.from_json(F.lit(json.dumps([{"i": i, "t": t, "a": a, "k": k, "y": y, "style": style} for i, (t, a, k, y, style) in enumerate(texts)])), "array<struct<i:int,t:string,a:int,k:int,y:int,style:int>>")
    made = spark.range(1).select(F.inline(rows))
    each = candidates(made, "t").select("i", "t", "a", "k", "y", "style", F.explode(F.transform("found", _told)).alias("c"))
    # A candidate is personal data if its text is and it is the span in question.
    hit = ((F.col("y") == 1) & (F.col("k") == F.col("c.kind")) & (F.abs(F.col("c.start") - F.col("a")) <= 1)).cast("int")
    got = each.select("i", "style", hit.alias("hit"), *_features(F.col("c"))).orderBy("i", *FEATURES).collect()
    y = np.array([r["hit"] for r in got], float)
    x = np.array([[r[f] for f in FEATURES] for r in got])
    learn = np.array([r["style"] for r in got]) == 0
    trees = boosting.fit(x[learn], y[learn], trees=80)
    p, kinds, truth = boosting.probability(trees, x[~learn]), x[~learn, 0], y[~learn]
    thresholds, precisions = [], []
    for k in range(len(ALL_KINDS)):
        own = kinds == k
        order = np.argsort(-p[own], kind="stable")
        precise = np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1)
        ranked = p[own][order]
        ends = np.append(ranked[1:] != ranked[:-1], True) & (ranked >= 0.9)  # equal scores stand or fall together
        good = np.flatnonzero((precise >= least_precision) & ends)
        thresholds.append(float(ranked[good[-1]]) if len(good) else 2.0)
        precisions.append(float(truth[own][p[own] >= thresholds[-1]].mean()) if (p[own] >= thresholds[-1]).any() else 1.0)
    return PiiModel(trees, thresholds, precisions)


RATED = "struct<kind:int,start:int,end:int,base:boolean,score:double>"


def _added(base: Column, more: Column) -> Column:
    """Of the spans in more, those that meet no span in base; of spans that overlap in a chain, the one with the best score, then the first."""
    event = lambda c: F.struct(c["start"].alias("start"), (~c["base"]).cast("int").alias("later"), c["end"].alias("end"), c.alias("c"), F.lit(False).alias("met"))
    kind = f"struct<start:int,later:int,end:int,c:{RATED},met:boolean>"
    met = lambda x, more_met: F.struct(x["start"].alias("start"), x["later"].alias("later"), x["end"].alias("end"), x["c"].alias("c"), (x["met"] | more_met).alias("met"))
    own = lambda x: x["later"] == 0
    events = F.array_sort(F.transform(F.concat(base, more), event))
    ahead = running(events, F.lit(0), lambda e, x: F.when(own(x), F.greatest(e, x["end"])).otherwise(e), lambda e, x: met(x, e > x["start"]), kind)
    behind = running(F.reverse(ahead), F.lit(2**31 - 1), lambda e, x: F.when(own(x), x["start"]).otherwise(e), lambda e, x: met(x, e < x["end"]), kind)
    free = F.filter(F.reverse(behind), lambda x: (x["later"] == 1) & ~x["met"])
    chain = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda e, x: F.struct(F.greatest(e["end"], x["end"]).alias("end"), (e["n"] + (x["start"] >= e["end"]).cast("int")).alias("n"))
    ranked = running(free, chain, step, lambda e, x: F.struct(step(e, x)["n"].alias("n"), (-x["c"]["score"]).alias("worst"), x["start"].alias("start"), x["c"].alias("c")), f"struct<n:int,worst:double,start:int,c:{RATED}>")
    first = running(F.array_sort(ranked), F.lit(0), lambda n, x: x["n"], lambda n, x: F.struct((x["n"] != n).alias("first"), x["c"].alias("c")), f"struct<first:boolean,c:{RATED}>")
    return F.transform(F.filter(first, lambda x: x["first"]), lambda x: x["c"])


def find_pii(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: PiiModel | None = None) -> DataFrame:
    """doc_id, text, base and extra: the spans that the strict rules accept, and those that the trees add (kind, start, end, score)."""
    model = model or fit_pii(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = candidates(texts, "text")

    def scored(c: Column) -> Column:
        values = F.struct(*_features(c))
        # One lambda computes the features, the next one reads them.
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), _base(c).alias("base"), values.alias("f"))

    limit = lambda kind: F.element_at(F.array(*map(F.lit, model.thresholds)), kind + 1)
    span = lambda c, score: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), score.alias("score"))
    rated = found.withColumn("rated", F.transform(F.transform("found", _told), scored))
    rated = rated.withColumn("rated", F.transform("rated", lambda c: span(c, boosting.as_column(model.trees, [c["f"][f] for f in FEATURES]))))
    split = rated.select("doc_id", "text", F.filter("rated", lambda c: c["base"]).alias("base"), F.filter("rated", lambda c: ~c["base"] & (c["score"] >= limit(c["kind"]))).alias("more"))
    return split.select("doc_id", "text", "base", F.when(F.size("more") > 0, _added(F.col("base"), F.col("more"))).otherwise(F.col("more")).alias("extra"))


def span_list(spans: Column) -> Column:
    """Spans as kind:start:end, by kind and start, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, ALL_KINDS)), k + 1)
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", name(c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def redacted(found: DataFrame) -> DataFrame:
    """doc_id and the text with every selected span replaced by its kind in brackets."""
    name = lambda k: F.element_at(F.array(*map(F.lit, ALL_KINDS)), k + 1)
    spans = F.array_sort(F.transform(F.concat("base", "extra"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    step = lambda acc, c: F.when(c["start"] < acc["at"], acc).otherwise(F.struct(c["end"].alias("at"), F.concat(acc["out"], F.substring("text", acc["at"] + 1, c["start"] - acc["at"]), F.lit("["), name(c["kind"]), F.lit("]")).alias("out")))
    done = lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text")))
    return found.select("doc_id", F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, done).alias("text"))
