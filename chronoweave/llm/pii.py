"""Personal data: high-recall span generators, boosted trees, calibrated thresholds.

Everything that runs on documents is a Spark expression. The trees are trained
on the driver, on generated examples, and compiled into CASE expressions.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import let

#: Marks the ends of matches, and separators that join a match. Texts that hold these private characters are read as if they held ``OTHER``.
EDGE, JOINT, OTHER = "", "", ""
#: Parts of a split text that one step of the position sum takes; even.
BLOCK = 256

#: Fixed kinds that always count, in their order.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds whose candidates the trees decide on.
MORE_KINDS = ("secret", "iban", "ssn", "tel")

#: In each text, single separators between the characters of a match become JOINT first, so that no pattern repeats a group: such patterns overflow the stack on long texts.
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,body:string,before:string,after:string>>"


def _marked(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, pattern, f"{EDGE}$0{EDGE}"), EDGE)


def spans_of(kind: str, text: Column, marked: Column, valid: Callable[[Column], Column]) -> Column:
    """Spans from a text split at the ends of its matches, in linear time: every second part is a match.

    Offsets are code points, ``end`` is exclusive. ``marked`` may differ from
    ``text`` in the separators only.
    """
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def within(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(False).alias("odd"), empty.alias("found"))

        def step(acc: Column, part: Column) -> Column:
            end = acc["pos"] + F.length(part)
            here = F.array(F.struct(acc["pos"].alias("start"), end.alias("end")))
            return F.struct(end.alias("pos"), (~acc["odd"]).alias("odd"), F.when(acc["odd"] & valid(part), F.concat(acc["found"], here)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(parts, start, step)

    def all_of(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(BLOCK)), lambda b: within(F.slice(parts, b, BLOCK)))
        start = F.struct(F.lit(0).cast("bigint").alias("pos"), empty.alias("found"))

        def join(acc: Column, block: Column) -> Column:
            moved = F.transform(block["found"], lambda s: F.struct((s["start"] + acc["pos"]).alias("start"), (s["end"] + acc["pos"]).alias("end")))
            return F.struct((acc["pos"] + block["pos"]).alias("pos"), F.concat(acc["found"], moved).alias("found"))

        return F.aggregate(blocks, start, join, lambda acc: acc["found"])

    def told(s: Column) -> Column:
        begin = F.greatest(s["start"] - 24, F.lit(0))
        cut = lambda at, n: F.substr(text, (at + 1).cast("int"), n.cast("int"))
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), cut(s["start"], s["end"] - s["start"]).alias("body"),
            F.lower(cut(begin, s["start"] - begin)).alias("before"), cut(s["end"], F.lit(4)).alias("after"),
        )

    return let(marked, lambda parts: F.when(F.size(parts) < 2, F.array().cast(_SPAN_TYPE)).otherwise(F.transform(all_of(parts), told)))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _iban_ok(body: Column) -> Column:
    """Whether the check digits of an IBAN hold (remainder 1 of 97)."""
    moved = F.concat(F.substr(body, F.lit(5)), F.substr(body, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _guarded(has: Column, spans: Column) -> Column:
    return F.when(has, spans).otherwise(F.array().cast(_SPAN_TYPE))


def base_spans(text: Column) -> list[Column]:
    """The spans of the four fixed kinds, leftmost and not overlapping within a kind."""
    digit = text.rlike("[0-9]")
    dots = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOINT)
    email = _marked(dots, rf"(?:\G|(?<![A-Za-z0-9._%+{JOINT}-]))[A-Za-z0-9._%+{JOINT}-]++@[A-Za-z0-9-]++{JOINT}[A-Za-z0-9{JOINT}-]*+")
    ip = _marked(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    joined = F.regexp_replace(text, r"(?<=[0-9])[ -](?=[0-9])", JOINT)
    card = _marked(joined, rf"(?<![0-9{JOINT}])[0-9{JOINT}]{{14,37}}+(?![0-9{JOINT}])")
    phone = _marked(text, r"\+[0-9][ ().0-9-]+[0-9]")
    is_card = lambda p: let(_digits(p), lambda d: F.length(d).between(14, 19) & _luhn(d))
    return [
        _guarded(text.contains("@"), spans_of("email", text, email, lambda p: F.lit(True))),
        _guarded(digit, spans_of("ip", text, ip, lambda p: p.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))),
        _guarded(digit, spans_of("card", text, card, is_card)),
        _guarded(text.contains("+"), spans_of("phone", text, phone, lambda p: F.length(_digits(p)).between(10, 15))),
    ]


def more_candidates(text: Column) -> list[Column]:
    """Candidates of the other kinds, with high recall; kinds may overlap each other."""
    digit = text.rlike("[0-9]")
    every = lambda p: F.lit(True)
    secret = _marked(text, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?![A-Za-z0-9+/_-])")
    iban = _marked(text, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
    ssn = _marked(text, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
    tel = _marked(text, r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
    return [
        _guarded(digit, spans_of("secret", text, secret, lambda p: p.rlike("[0-9]") & p.rlike("[A-Za-z]"))),
        _guarded(digit, spans_of("iban", text, iban, every)),
        _guarded(digit, spans_of("ssn", text, ssn, every)),
        _guarded(digit, spans_of("tel", text, tel, lambda p: ~F.coalesce(p.rlike(r"^\+"), F.lit(False)))),
    ]


#: Fixed words of contexts that make a candidate likelier, or less likely, to be personal.
_FOR_SECRET = r"(?:token|secret|passw|pwd|api.?key|auth|bearer|credential|key)[^a-z]{0,6}$"
_FOR_TEL = r"(?:tel|phone|call|mobile|fax|ruf|móvil|llam|appel)[^0-9]{0,16}$"
_FOR_ID = r"(?:ssn|social|security|sozial|iban|account|konto|cuenta|compte|bank)[^0-9]{0,16}$"
_AGAINST = r"(?:order|invoice|version|isbn|commit|sha|md5|rev|build|page|item|sku|ref|id|part|serial|http|/)[^a-z]{0,8}$"

FEATURES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("is_secret", lambda c: (c["kind"] == "secret").cast("double")),
    ("is_iban", lambda c: (c["kind"] == "iban").cast("double")),
    ("is_ssn", lambda c: (c["kind"] == "ssn").cast("double")),
    ("length", lambda c: F.length(c["body"]).cast("double")),
    ("digit_share", lambda c: F.regexp_count(c["body"], F.lit("[0-9]")) / F.greatest(F.length(c["body"]), F.lit(1))),
    ("upper_share", lambda c: F.regexp_count(c["body"], F.lit("[A-Z]")) / F.greatest(F.length(c["body"]), F.lit(1))),
    ("switches", lambda c: F.regexp_count(c["body"], F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")) / F.greatest(F.length(c["body"]), F.lit(1))),
    ("distinct", lambda c: F.size(F.array_distinct(F.split(c["body"], ""))).cast("double")),
    ("dashes", lambda c: F.regexp_count(c["body"], F.lit("[-/_]")).cast("double")),
    ("for_secret", lambda c: c["before"].rlike(_FOR_SECRET).cast("double")),
    ("for_tel", lambda c: c["before"].rlike(_FOR_TEL).cast("double")),
    ("for_id", lambda c: c["before"].rlike(_FOR_ID).cast("double")),
    ("against", lambda c: c["before"].rlike(_AGAINST).cast("double")),
    ("quoted", lambda c: (c["before"].rlike("[\"']$") & c["after"].rlike("^[\"']")).cast("double")),
    ("checks", lambda c: F.when(c["kind"] == "iban", _iban_ok(c["body"])).otherwise(F.lit(False)).cast("double")),
    ("zero_group", lambda c: c["body"].rlike(r"^(?:000|666|9..)-|-00-|-0000$").cast("double")),
)


# --- training, on the driver, on generated examples ---------------------------------------------------------


def _examples(n: int, seed: int) -> list[tuple[str, str, int]]:
    """(kind, text with one candidate of the kind, whether it is personal)."""
    rng = random.Random(seed)
    pick, digits = rng.choice, lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    chars = lambda s, k: "".join(rng.choice(s) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def iban(good: bool) -> str:
        country, body = pick(["DE", "FR", "ES", "GB", "NL"]), digits(rng.randint(14, 20))
        number = int(body + "".join(str(ord(c) - 55) for c in country) + "00")
        return f"{country}{98 - number % 97 if good else rng.randint(0, 96):02d}{body}"

    out = []
    for _ in range(n):
        good = rng.random() < 0.5
        kind = pick(MORE_KINDS)
        filler = pick(["with the of and", "dans le une et", "para los y que", "mit der und ein", "then we saw", ""])
        if kind == "secret":
            body = chars(hexa, pick([32, 40, 64])) if rng.random() < 0.6 else chars(alnum, rng.randint(20, 44))
            if good:
                lead = pick(["token", "api_key", "secret", "password", "auth", "access key", "API-KEY", "bearer"])
                text = pick([f'{filler} {lead} = "{body}" {filler}', f"{filler} {lead}: {body} {filler}", f"{filler} {lead}={body}"])
            elif rng.random() < 0.5:
                text = f"{filler} {pick(['commit', 'sha', 'md5', 'build', 'rev', 'ref', 'https://a/'])} {body} {filler}"
            else:
                word = pick(["chapter", "international", "section", "release-notes", "x86_64"])
                body = f"{word}-{pick(['of-the-year', 'volume', 'overview-part'])}-{digits(rng.randint(1, 4))}"
                text = f"{filler} {body} {filler}"
        elif kind == "iban":
            text = f"{filler} {pick(['IBAN', 'Konto', 'account', '']) if good else pick(['part', 'serial', 'order', ''])} {iban(good)} {filler}"
        elif kind == "ssn":
            body = f"{rng.randint(1, 899):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if good else f"{pick(['000', '666', '9' + digits(2)])}-{digits(2)}-{digits(4)}"
            text = f"{filler} {pick(['SSN', 'social security', '']) if good else pick(['part', 'item', 'order', ''])} {body} {filler}"
        else:
            sep = pick(" .-")
            body = f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}"
            text = f"{filler} {pick(['tel', 'phone', 'call', 'mobile']) if good else pick(['order', 'version', 'item', 'ref', filler])} {body} {filler}"
        out.append((kind, text, int(good)))
    return out


def _fit_tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, left, right) or a leaf's value."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 20:
        return leaf
    best = (1e-6, None)
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 16))):
            left = x[:, j] <= cut
            if 10 <= left.sum() <= len(g) - 10:
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - base
                if gain > best[0]:
                    best = (gain, (j, float(cut)))
    if best[1] is None:
        return leaf
    j, cut = best[1]
    left = x[:, j] <= cut
    return j, cut, _fit_tree(x[left], g[left], h[left], depth - 1), _fit_tree(x[~left], g[~left], h[~left], depth - 1)


def _apply_tree(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, _apply_tree(low, x), _apply_tree(high, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4) -> list:
    """Gradient-boosted trees on log loss."""
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _fit_tree(x, p - y, p * (1 - p), depth)
        trees.append(tree)
        score += rate * _apply_tree(tree, x)
    return trees


def _features(spark: SparkSession, examples: list[tuple[str, str, int]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features of the examples, from the very expressions that documents go through."""
    df = spark.createDataFrame([(k, t, y) for k, t, y in examples], "kind string, text string, y int")
    found = df.select("kind", "y", F.flatten(F.array(*more_candidates(F.col("text")))).alias("spans"))
    one = found.select("y", "kind", F.get(F.filter("spans", lambda s: s["kind"] == F.col("kind")), F.lit(0)).alias("c")).where("c is not null")
    rows = one.select("kind", "y", *[f(F.col("c")).cast("double").alias(n) for n, f in FEATURES]).collect()
    return np.array([list(r)[2:] for r in rows], dtype=float), np.array([r["y"] for r in rows]), [r["kind"] for r in rows]


@lru_cache(maxsize=1)
def _trained(precision: float, rate: float = 0.4) -> tuple[tuple, tuple]:
    """Trees, and for each kind the lowest threshold that keeps ``precision`` on examples that the trees have not seen."""
    spark = SparkSession.active()
    x, y, _ = _features(spark, _examples(1500, 7))
    trees = boost(x, y, rate=rate)
    x, y, kinds = _features(spark, _examples(1500, 8))
    score = sum(rate * _apply_tree(t, x) for t in trees)
    cuts = []
    for kind in MORE_KINDS:
        of = np.array([k == kind for k in kinds])
        s, t = score[of], y[of]
        good = [c for c in np.unique(s) if t[s >= c].mean() >= precision]
        cuts.append((kind, float(min(good)) if good else float("inf")))
    return tuple(trees), tuple(cuts)


def _tree_column(tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    j, cut, low, high = tree
    return F.when(features[j] <= F.lit(cut), _tree_column(low, features)).otherwise(_tree_column(high, features))


def _accepted(candidate: Column, precision: float, rate: float = 0.4) -> Column:
    trees, cuts = _trained(precision, rate)

    def decide(values: Column) -> Column:
        features = [values[n] for n, _ in FEATURES]
        score = F.lit(0.0)
        for tree in trees:
            score = score + F.lit(rate) * _tree_column(tree, features)
        threshold = F.lit(float("inf"))
        for kind, cut in cuts:
            threshold = F.when(candidate["kind"] == kind, F.lit(cut)).otherwise(threshold)
        return score >= threshold

    return let(F.struct(*[f(candidate).cast("double").alias(n) for n, f in FEATURES]), decide)


# --- the operator -------------------------------------------------------------------------------------------

_PLAIN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = F.create_map(*[F.lit(v) for i, k in enumerate((*BASE_KINDS, *MORE_KINDS)) for v in (k, i)])
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, text: str = "text", precision: float = 0.98) -> DataFrame:
    """All columns of ``docs`` and two more: base_spans and spans.

    Both are arrays of struct(start, rank, kind, end), in the order of start
    and kind; offsets are code points, ends exclusive. ``spans`` holds the base
    spans and those candidates that the trees accept. A null text is read as
    an empty one, which has no spans. Repeated rows give repeated results, an
    empty table gives no rows. Columns of ``docs`` named like the new ones are
    replaced.
    """
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), EDGE + JOINT, OTHER + OTHER)
    found = docs.withColumns({
        "base_spans": let(plain, lambda t: F.flatten(F.array(*base_spans(t)))),
        "spans": let(plain, lambda t: F.filter(F.flatten(F.array(*more_candidates(t))), lambda c: _accepted(c, precision))),
    })
    return found.withColumn("spans", _ordered(F.concat("base_spans", "spans"))).withColumn("base_spans", _ordered(F.col("base_spans")))


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds and of all spans, base_sha256 and spans as text."""
    found = find_pii(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(_told(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def redact_pii(docs: DataFrame, text: str = "text", precision: float = 0.98) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets, ``[EMAIL]``.

    Spans that overlap become one, named after the first. Rows without spans
    stay as they are, null texts too.
    """
    body = F.col(text)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(body, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        new = F.concat(acc["parts"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["parts"]).alias("parts"))

    done = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(body, (acc["at"] + 1).cast("int")))
    columns = docs.columns
    found = find_pii(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), body.alias("_text")), "_text", precision)
    body = F.col("_text")
    out = F.when(F.size("spans") == 0, body).otherwise(F.aggregate("spans", start, step, done))
    return found.select(*[(out if c == text else F.col(f"_row.`{c}`")).alias(c) for c in columns])
