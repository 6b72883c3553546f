"""Personal data by candidate gradient boosting, in DataFrame functions only.

* Fixed rules find the base spans of four kinds: email, ip, card, phone.
* High-recall generators propose further, overlapping candidates in what the base spans leave:
  masked mail addresses, numbers in the shape of addresses, cards and phones.
* Boosted trees score a candidate by format and context. They learn from the candidates of half of
  the documents, by hash. Positive are those that a base rule confirms and, for what base rules miss, disguised
  copies: each confirmed span once more in its surroundings without its mark (no plus sign, a masked at
  sign, other separators, a number glued on). Negative are what nothing confirms and copies made wrong (a check
  digit, a part above 255, the digits of a phone as a date).
* A threshold per kind is calibrated on the other half, on what is left there beside base
  spans: the least score from which on at least ``PRECISION`` of candidates are disguised spans. Of the
  candidates above it, best first, each stays that overlaps none kept so far.

Every document is learnt from. Only counts by binned features come to the driver, all of them: the bins
bound their number whatever the input (400 on 256,410 documents). Trees become CASE expressions.

Positions are code points, ends exclusive. Null text is empty and has no spans. Repeated rows get
equal results; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.support import text_or_empty

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
ROUNDS, RATE, LEAVES_AT_LEAST = 24, 0.3, 4
BESIDE, BY_FOUR = 48, "([0-9]{4})(?=[0-9])"

# The stated base patterns. A match can only start where its first run starts or the last match
# ended, and the runs are possessive: the same matches, in linear time and constant stack.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
GUARD = ("@", ".", "", "+")
SPANS = "array<struct<kind:int,s:int,e:int>>"
GENERATORS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]{1,3}(?:[.,] ?[0-9]{1,3}){3}(?![0-9])",
    r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]){9,15}(?![0-9])",
    r"(?<![0-9])\+?\(?[0-9][0-9 ().-]{5,18}[0-9](?![0-9])",
)
#: Words before a candidate that tell its kind; the place in the list is the feature's value.
HINTS = (("mail", "email", "contact"), ("phone", "tel", "call", "fax", "mobile"), ("card", "visa", "payment", "iban"), ("ip", "host", "server", "address"), ("version", "license", "no", "page", "chapter"), ("password", "token", "key", "secret"))
FEATURES = ("digits", "groups", "longest", "dots", "spaces", "luhn", "octets", "before", "after", "hint")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t>> of the leftmost non-overlapping matches, in order.

    Gaps and matches alternate, so positions are running sums of lengths, taken in blocks.
    """
    empty = F.expr("cast(array() as array<struct<s:int,e:int,t:string>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["t"])
        return F.struct(F.concat(acc["spans"], F.array(F.struct(start.alias("s"), end.alias("e"), x["t"].alias("t")))).alias("spans"), end.alias("pos"))

    def whole(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(empty.alias("spans"), acc["pos"].alias("pos")), add)
        return bound(inner, lambda y: F.struct(F.concat(acc["spans"], y["spans"]).alias("spans"), y["pos"].alias("pos")))

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, t: F.struct(g.alias("gap"), t.alias("t")))
        blocks = bound(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(p) - 1, 8)), lambda b: F.slice(p, (b * 256 + 1).cast("int"), 256)))
        return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(blocks, F.struct(empty.alias("spans"), F.lit(0).alias("pos")), whole, lambda a: a["spans"]))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _valid(kind: int, x: Column) -> Column:
    t = x["t"]
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.forall(F.split(t, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == 2:
        return bound(_digits(t), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    return F.length(_digits(t)).between(8, 15)


def _span(kind: int, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def base_spans(text: Column) -> Column:
    """array<struct<kind, s, e>> by kind as in KINDS, then start."""
    parts = []
    for kind, pattern in enumerate(BASE):
        may = F.contains(text, F.lit(GUARD[kind])) if GUARD[kind] else F.lit(True)
        if kind:
            may = may & text.rlike("[0-9]")
        valid = F.filter(find_all(text, pattern), functools.partial(_valid, kind))
        parts.append(F.when(may, F.transform(valid, functools.partial(_span, kind))).otherwise(F.array().cast(SPANS)))
    return F.concat(*parts)


def merged(spans: Column) -> Column:
    """Union of spans as disjoint ones in order: array<struct<s, e, kind>>, the kind of the first."""
    empty = F.expr("cast(array() as array<struct<s:int,e:int,kind:int>>)")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))))
        return F.when((F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(-1)) > x["s"]), joined).otherwise(F.concat(acc, F.array(x)))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.aggregate(ordered, empty, add)


def replace_spans(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """Text with each of the disjoint, ordered spans replaced by ``by(span)``."""

    def build(x: Column) -> Column:
        def piece(i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(x, i - 1)["e"])
            end = F.coalesce(F.get(x, i)["s"], F.length(text))
            return F.concat(F.substring(text, start + 1, end - start), F.coalesce(by(F.get(x, i)), F.lit("")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(x)), piece), "")

    return F.when(F.size(spans) == 0, text).otherwise(bound(spans, build))


def _char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^\p{L}$"), 2).when(c.rlike(r"^[0-9]$"), 3).when(c.rlike("^[=:\"'#/_-]$"), 4).otherwise(5)


def candidates(text: Column) -> Column:
    """array<struct<kind, s, e, features...>> that the generators propose."""
    def described(kind: int, x: Column) -> Column:
        t, digits = x["t"], _digits(x["t"])
        groups = F.filter(F.split(t, "[^0-9]+"), lambda g: g != "")
        ahead = F.substring(text, F.greatest(x["s"] - 19, F.lit(1)), F.least(x["s"], F.lit(20)))
        word = F.lower(F.regexp_extract(ahead, r"(\p{L}+)[^\p{L}]{0,3}$", 1))
        hint = F.lit(0)
        for i, words in enumerate(HINTS):
            hint = F.when(word.isin(*words), i + 1).otherwise(hint)
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"),
            F.least(F.length(digits), F.lit(20)).alias("digits"), F.least(F.size(groups), F.lit(8)).alias("groups"),
            F.least(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), F.lit(16)).alias("longest"),
            F.least(F.length(t) - F.length(F.replace(t, F.lit("."))), F.lit(6)).alias("dots"), F.least(F.length(t) - F.length(F.replace(t, F.lit(" "))), F.lit(6)).alias("spaces"),
            F.call_function("luhn_check", F.when(digits == "", "1").otherwise(digits)).cast("int").alias("luhn"), F.forall(groups, lambda g: F.coalesce(g.try_cast("int") <= 255, F.lit(False))).cast("int").alias("octets"),
            _char_class(F.substring(ahead, -1, 1)).alias("before"), _char_class(F.substring(text, x["e"] + 1, F.lit(1))).alias("after"), hint.alias("hint"),
        )

    parts = []
    for kind, pattern in enumerate(GENERATORS):
        may = text.rlike("[0-9]") if kind else F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]")
        parts.append(F.when(may, F.transform(find_all(text, pattern), functools.partial(described, kind))).otherwise(F.array().cast(CANDIDATE)))
    return F.concat(*parts)


CANDIDATE = "array<struct<kind:int,s:int,e:int," + ",".join(f"{f}:int" for f in FEATURES) + ">>"


def boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS) -> list:
    """Depth-two logistic boosting over weighted cells; a tree is (feature, cut, left, right) or a leaf value."""
    score, trees = np.zeros(len(y)), []

    def grow(use: np.ndarray, depth: int, grad: np.ndarray, hess: np.ndarray):
        g, h = grad[use].sum(), hess[use].sum()
        best = (1e-6, None, None)
        if depth:
            for f in range(x.shape[1]):
                for cut in np.unique(x[use, f])[:-1]:
                    left = use & (x[:, f] <= cut)
                    if min(w[left].sum(), w[use].sum() - w[left].sum()) < LEAVES_AT_LEAST:
                        continue
                    gl, hl = grad[left].sum(), hess[left].sum()
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    if gain > best[0]:
                        best = (gain, f, cut)
        if best[1] is None:
            return float(RATE * g / (h + 1))
        left = use & (x[:, best[1]] <= best[2])
        return (best[1], int(best[2]), grow(left, depth - 1, grad, hess), grow(use & ~left, depth - 1, grad, hess))

    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.ones(len(y), bool), 2, w * (y - p), w * p * (1 - p))
        trees.append(tree)
        score += predict([tree], x)
    return trees


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    def one(tree, use: np.ndarray, out: np.ndarray) -> None:
        if isinstance(tree, float):
            out[use] += tree
        else:
            f, cut, left, right = tree
            one(left, use & (x[:, f] <= cut), out)
            one(right, use & (x[:, f] > cut), out)

    out = np.zeros(len(x))
    for tree in trees:
        one(tree, np.ones(len(x), bool), out)
    return out


def disguises(kind: int, t: Column) -> list[Column]:
    """Forms of a base span of that kind that its base rule does not find: structs of (t, tail glued on, y).

    Those with ``y`` 0 look alike and are none: a check digit or part that is wrong, the digits as a date.
    """
    plain, tail, digits = F.lit(""), F.lit(" 2027"), _digits(t)
    if kind == 0:
        local, host = F.substring_index(t, "@", 1), F.substring_index(t, "@", -1)
        forms = [
            (F.replace(t, F.lit("@"), F.lit(" @ ")), plain, 1), (F.replace(t, F.lit("@"), F.lit("(at)")), plain, 1),
            (F.concat(local, F.lit(" [at] "), F.replace(host, F.lit("."), F.lit(" [dot] "))), plain, 1),
            (F.concat(local, F.lit("[at]"), F.replace(host, F.lit("."), F.lit("(dot)"))), plain, 1),
        ]
    elif kind == 1:
        forms = [(F.replace(x, F.lit("."), F.lit(by)), plain, y) for x, y in ((t, 1), (F.regexp_replace(t, "^[0-9]+", "731"), 0)) for by in (",", ". ", ", ")]
    elif kind == 2:
        wrong = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), ((F.substring(digits, -1, 1).cast("int") + 1) % 10).cast("string"))
        forms = [(F.regexp_replace(digits, BY_FOUR, "$1."), plain, 1), (t, tail, 1)]
        forms += [(F.regexp_replace(wrong, BY_FOUR, f"$1{by}"), plain, 0) for by in (".", " ")]
    else:
        bare = F.substr(t, F.lit(2))
        forms = [(bare, plain, 1), (F.regexp_replace(bare, "[^0-9]+", "."), plain, 1), (F.regexp_replace(bare, "^([0-9]+)", "($1)"), plain, 1)]
        forms += [(F.regexp_replace(digits, "^(....)(..)(..).*$", "$1-$2-$3"), plain, 0)]
    return [F.struct(form.alias("t"), glued.alias("tail"), F.lit(y).alias("y")) for form, glued, y in forms]


def disguised_candidates(sample: DataFrame) -> DataFrame:
    """(doc_id, y, c): every base span of ``sample`` (doc_id, text, base) in one disguise, and the candidates that touch it.

    Features look at a candidate and few characters beside it, so a span is put between the ``BESIDE`` characters
    around it, where other base spans are hidden as they are when candidates are scored. A candidate of the
    kind that covers the disguise is positive unless it only looks alike, one of another kind is not; those of
    the kind that cover a part of it teach nothing.
    """
    hidden = replace_spans(F.col("text"), merged(F.col("base")), lambda x: F.repeat(F.lit("\x01"), x["e"] - x["s"]))
    spans = sample.where(F.size("base") > 0).select("doc_id", "text", "base", hidden.alias("rest")).select("doc_id", "text", "rest", F.explode("base").alias("b"))
    t = F.substring(F.col("text"), F.col("b.s") + 1, F.col("b.e") - F.col("b.s"))
    ahead = F.greatest(F.col("b.s") - BESIDE, F.lit(0))
    cut = spans.select(
        "doc_id", "b.kind", t.alias("t"), F.pmod(F.xxhash64("doc_id", "b.s", F.lit(13)), F.lit(12)).cast("int").alias("form"),
        F.substring(F.col("rest"), ahead + 1, F.col("b.s") - ahead).alias("ahead"), F.substring(F.col("rest"), F.col("b.e") + 1, F.lit(BESIDE)).alias("behind"),
    )
    form = F.lit(None)
    for kind in range(len(KINDS)):
        forms = F.array(*disguises(kind, F.col("t")))
        form = F.when(F.col("kind") == kind, F.get(forms, F.col("form") % F.size(forms))).otherwise(form)
    cut = cut.select("doc_id", "kind", "ahead", "behind", form.alias("f"))
    cut = cut.select("doc_id", "kind", "f.y", F.length("ahead").alias("s"), F.length(F.concat("ahead", "f.t")).alias("e"), F.concat("ahead", "f.t", "f.tail", "behind").alias("line"))
    found = cut.select("doc_id", "kind", "y", "s", "e", F.explode(candidates(F.col("line"))).alias("c"))
    covers, same = (F.col("c.s") <= F.col("s")) & (F.col("c.e") >= F.col("e")), F.col("c.kind") == F.col("kind")
    touches = (F.col("c.s") < F.col("e")) & (F.col("c.e") > F.col("s"))
    return found.where(touches & (covers | ~same)).select("doc_id", F.when(same, F.col("y")).otherwise(0).alias("y"), "c")


def cells(docs: DataFrame) -> DataFrame:
    """(part, y, disguised, kind, features..., count): candidates of every document, plain and disguised, by half and bin."""
    names = ["kind", *FEATURES]
    texts = docs.select("doc_id", text_or_empty().alias("text")).where(F.col("text").rlike("[0-9@]|[(\\[]at[)\\]]"))
    texts = texts.select("doc_id", "text", F.when(F.col("text").rlike("[0-9@]"), base_spans(F.col("text"))).otherwise(F.array().cast(SPANS)).alias("base"))
    sure = F.exists("base", lambda b: (b["kind"] == F.col("c.kind")) & (b["s"] < F.col("c.e")) & (b["e"] > F.col("c.s")))
    part = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2))
    plain = texts.select("doc_id", "base", F.explode(candidates(F.col("text"))).alias("c")).select("doc_id", sure.cast("int").alias("y"), F.lit(0).alias("disguised"), "c")
    every = plain.unionByName(disguised_candidates(texts).withColumn("disguised", F.lit(1)))
    return every.select(part.alias("part"), "y", "disguised", *[F.col(f"c.{f}").alias(f) for f in names]).groupBy("part", "y", "disguised", *names).count()


def fit(docs: DataFrame) -> list[tuple[list, float]]:
    """(trees, threshold) per kind, learnt and calibrated on all of ``docs``."""
    found = cells(docs).toArrow().sort_by([(f, "ascending") for f in ("part", "y", "disguised", "kind", *FEATURES)])
    got = np.array([c.to_numpy() for c in found.columns], float).T
    out = []
    for kind in range(len(KINDS)):
        own = got[got[:, 3] == kind]
        x, y, w, train = own[:, 4:-1], own[:, 1], own[:, -1], own[:, 0] == 0
        trees = boosted(x[train], y[train], w[train])
        left = ~train & ((own[:, 2] == 1) | (y == 0))  # confirmed spans themselves are no candidates when scored
        score, y, w = predict(trees, x)[left], y[left], w[left]
        least = np.inf  # without a sample that confirms a score nothing is added
        for s in sorted(set(score[y > 0].tolist()), reverse=True):
            above = score >= s
            if (w * y)[above].sum() < PRECISION * w[above].sum():
                break
            least = s
        out.append((trees, float(least)))
    return out


def _score(trees: list, c: Column) -> Column:
    def one(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, cut, left, right = tree
        return F.when(c[FEATURES[f]] <= cut, one(left)).otherwise(one(right))

    return functools.reduce(lambda a, b: a + b, [one(t) for t in trees], F.lit(0.0))


def find_pii(docs: DataFrame, model: list[tuple[list, float]] | None = None) -> DataFrame:
    """(row, pii_base, pii_spans): each row of ``docs`` (doc_id, text, ...) as a struct, and its spans as arrays of (kind, s, e)."""
    model = fit(docs.select("doc_id", "text")) if model is None else model
    columns = ["row", "text"]
    text = text_or_empty()
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    docs = docs.select(*columns, F.when(text.rlike("[0-9@]"), base_spans(text)).otherwise(F.array().cast(SPANS)).alias("pii_base"))
    masked = replace_spans(text, merged(F.col("pii_base")), lambda x: F.repeat(F.lit("\x01"), x["e"] - x["s"]))
    docs = docs.select(*columns, "pii_base", masked.alias("_rest"))

    def scored(c: Column) -> Column:
        value, least = F.lit(0.0), F.lit(float("inf"))
        for kind, (trees, at) in enumerate(model):
            if trees and np.isfinite(at):
                value, least = F.when(c["kind"] == kind, _score(trees, c)).otherwise(value), F.when(c["kind"] == kind, at).otherwise(least)
        return F.struct((least - value).alias("below"), c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"))

    chosen = F.array_sort(F.filter(F.transform(candidates(F.col("_rest")), scored), lambda x: x["below"] <= 0))

    def apart(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda z: (z["s"] < x["e"]) & (x["s"] < z["e"])), kept).otherwise(F.concat(kept, F.array(x)))

    # from the one furthest above its threshold, then the earlier: each that overlaps none kept so far stays
    best = bound(chosen, lambda every: F.aggregate(every, F.slice(every, 1, 0), apart))
    added = F.transform(best, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    spans = F.when(F.col("_rest").rlike("[0-9@]|[(\\[]at[)\\]]"), F.array_sort(F.concat("pii_base", added))).otherwise(F.col("pii_base"))
    return docs.select("row", "pii_base", spans.alias("pii_spans"))


def redact(docs: DataFrame, model: list[tuple[list, float]] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; same columns."""
    found = find_pii(docs, model)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    clean = replace_spans(F.col("row.text"), merged(F.col("pii_spans")), lambda x: F.get(names, x["kind"]))
    text = F.when(F.size("pii_spans") == 0, F.col("row.text")).otherwise(clean)
    return found.select(*[text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def _is_kind(kind: int, x: Column) -> Column:
    return x["kind"] == kind


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_digest(docs: DataFrame, model: list[tuple[list, float]] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans; positions joined as kind:start:end."""
    found = find_pii(docs.select("doc_id", "text"), model)
    counts = [F.size(F.filter("pii_base", functools.partial(_is_kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("row.doc_id", *counts, F.sha2(_joined(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"))
