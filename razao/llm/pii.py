"""Personal data by weak-supervision aggregation, in DataFrame functions only.

Base spans come from one pattern and one check for each kind and always stay. Candidates are all matches of
the base patterns, passing or not, and of wider patterns (written-out addresses, card numbers and phone
numbers that stand beside other numbers). Five labelers vote for (1), against (-1) or abstain (0) on each
candidate: the base rule, a checksum or range, a gazetteer (card prefixes, calling codes, top-level domains),
the words before it, and the characters around it. Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability for each kind, without any labelled span; its posteriors are the soft
labels from which a naive Bayes span classifier over votes and shape features is trained. A candidate is
added to the base spans if both the posterior and the classifier say it is more likely personal data than
not, and it does not overlap a base span.

What reaches the driver is counts for each vote pattern (at most 3 ** 5 a kind) and each feature value (a
fixed number). Texts are never shuffled.

Rows: a null text is empty. Texts are taken whole; patterns are possessive where a match could otherwise be
tried again and again or recurse on long texts. Repeated rows are rows of their own. Without any candidate no
span is added. An empty table gives an empty result. Other columns pass through in the struct `row`.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.llm.common import packed, stored, table

KINDS = ("email", "ip", "card", "phone")
BASE = {
    # A start inside a run of local-part characters is only tried behind the last match.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({]at[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"\+(?:[0-9]{9,15}|[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4})(?![0-9])",
}
# A cheap test that a text can match a base pattern, or a wider one, at all.
MAY = {"email": "@", "ip": r"[0-9][0-9.]{6}", "card": r"[0-9][0-9\x20-]{11}", "phone": r"\+[0-9]"}
MAY_WIDER = {**MAY, "email": r"[\[({]at[\])}]"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|us|eu|ch|at|be|nl|pt|br|mx|ca|au|jp|cn|ru|pl|se|no|dk|fi"
CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CUES = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel|adresse",
    "ip": r"\bip\b|server|host|addr|login|client",
    "card": "card|visa|credit|debit|master|karte|carte|tarjeta|payment|paid",
    "phone": "tel|phone|call|mobile|fax|cell|ruf|llama|appel",
}
AGAINST = r"isbn|version|order|invoice|serial|token|key|sha|md5|checksum"
LABELERS = ("rule", "check", "gazetteer", "words", "around")
_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
ROUNDS, ACCEPT = 12, 0.5


def _matches(text: Column, pattern: str, may: Column) -> Column:
    """All matches, with start and end in code points and some text on both sides."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    none = F.array().cast(f"array<{_SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        low = acc["at"] + F.length(x["piece"])
        high = low + F.length(x["match"])
        span = F.struct(
            low.alias("start"), high.alias("end"), x["match"].alias("value"),
            F.right(x["piece"], F.lit(24)).alias("before"), F.left(x["behind"], F.lit(1)).alias("after"),
        )
        return F.struct(high.alias("at"), F.array_append(acc["out"], span.cast(_SPAN)).alias("out"))

    n = F.size(found)
    zipped = F.arrays_zip(
        F.slice(pieces, 1, n).alias("piece"), found.alias("match"), F.slice(pieces, 2, n).alias("behind")
    )
    spans = F.aggregate(zipped, start, step)["out"]
    return F.when(may, spans).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda d: d != "")
    double = F.transform(digits, lambda d, i: (F.ascii(d) - 48) * (F.pmod(i, F.lit(2)) + 1))
    total = F.aggregate(double, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0))
    return F.pmod(total, F.lit(10)) == 0


def passes(kind: str, value: Column) -> Column:
    """The check behind the base pattern of a kind."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _labels(kind: str, span: Column, base: bool) -> Column:
    """The votes on a candidate, with the features of its shape."""
    value, before, after = span["value"], F.lower(span["before"]), span["after"]
    fine = passes(kind, value)
    rule = _vote(fine, ~fine) if base else F.lit(0)
    if kind == "email":
        known = value.rlike(rf"(?i)(?:\.|[\])}}] ?)(?:{TOP_DOMAINS})$")
        check, gazetteer = _vote(value.rlike("[A-Za-z]{2,}$"), F.lit(True)), _vote(known, F.lit(False))
    elif kind == "ip":
        first = F.regexp_extract(value, r"^0*([0-9]{1,3})\.", 1)
        check = _vote(fine, ~fine)
        gazetteer = _vote(first.rlike("^(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])$"), F.lit(True))
    elif kind == "card":
        check, gazetteer = _vote(fine, ~fine), _vote(value.rlike("^[3-6]"), F.lit(True))
    else:
        check, gazetteer = _vote(fine, ~fine), _vote(value.rlike(rf"^\+(?:{CALLING_CODES})"), F.lit(True))
    words = _vote(before.rlike(CUES[kind]), before.rlike(AGAINST))
    open_ = (before == "") | before.rlike(r"[\s(\[<{\"':;,=/|-]$")
    shut = (after == "") | after.rlike(r"[\s)\]>}\"':;,.!?/|-]")
    return F.struct(
        rule.alias("rule"), check.alias("check"), gazetteer.alias("gazetteer"), words.alias("words"),
        _vote(open_ & shut, F.lit(True)).alias("around"),
        F.least(F.length(value), F.lit(40)).alias("length"),
        F.least(F.length(_digits(value)), F.lit(20)).alias("digits"),
        value.rlike(r"[\s().-]").cast("int").alias("parted"),
    )


def _passing(spans: str, k: int) -> Column:
    """(start, kind, end) of the spans that pass the check of kind k."""
    ok = F.filter(spans, lambda s: passes(KINDS[k], s["value"]))
    return F.transform(ok, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def _voted(spans: str, k: int, base: bool) -> Column:
    """All spans of kind k with their votes."""

    def one(s: Column) -> Column:
        says = _labels(KINDS[k], s, base).alias("says")
        return F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), says)

    return F.transform(spans, one)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row` (the input without the text), `base` (kind, start, end) and `more`, all candidates with their votes."""
    value = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    rows = packed(docs).select(F.col("row").dropFields(text).alias("row"), value.alias("text"))
    t = F.col("text")
    found = {}
    for kind in KINDS:
        found[f"base_{kind}"] = _matches(t, BASE[kind], t.rlike(MAY[kind]))
        if kind in WIDER:
            found[f"more_{kind}"] = _matches(t, WIDER[kind], t.rlike(MAY_WIDER[kind]))
    rows = stored(rows.select("row", *[spans.alias(name) for name, spans in found.items()]), "pii-matches")
    base, more = [], []
    for k, kind in enumerate(KINDS):
        base.append(_passing(f"base_{kind}", k))
        more += [_voted(name, k, name.startswith("base")) for name in found if name.endswith(f"_{kind}")]
    return rows.select("row", F.array_sort(F.concat(*base)).alias("base"), F.concat(*more).alias("more"))


def _look(entries: dict[str, float], key: Column) -> Column:
    """The number of a key, 0 if it has none; the entries are one literal."""
    numbers = F.from_json(F.lit(json.dumps(entries)), "map<string,double>")
    return F.coalesce(F.try_element_at(numbers, key), F.lit(0.0))


def _key(*parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _posterior_odds(says: Column, kind: Column, model: dict[str, float]) -> Column:
    """Log odds that a candidate is personal data, from its votes."""
    votes = [_look(model, _key(kind, name, says[name])) for name in LABELERS]
    return reduce(lambda a, b: a + b, votes, _look(model, _key(kind, "prior")))


def _sigmoid(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """Log ratios of each vote of each labeler, by expectation-maximisation over counted vote patterns.

    `patterns`: kind, says (the votes), n. Starts from the sign of the sum of votes.
    """
    post = _sigmoid(reduce(lambda a, b: a + b, [F.col(f"says.{name}").cast("double") for name in LABELERS]))
    model: dict[str, float] = {}
    for _ in range(rounds):
        shared = patterns.withColumn("post", post).select(
            "kind", "says", (F.col("n") * F.col("post")).alias("yes"), (F.col("n") * (1 - F.col("post"))).alias("no")
        )
        sums = [F.sum("yes").alias("yes"), F.sum("no").alias("no")]
        for name in LABELERS:
            for v in (-1, 0, 1):
                here = F.col(f"says.{name}") == v
                sums += [F.coalesce(F.sum(F.when(here, x)), F.lit(0.0)).alias(f"{name}{v}{y}") for x, y in ((F.col("yes"), "y"), (F.col("no"), "n"))]
        model = {}
        for r in shared.groupBy("kind").agg(*sums).collect():  # one row a kind
            model[f"{r['kind']}|prior"] = math.log((r["yes"] + 1) / (r["no"] + 1))
            for name in LABELERS:
                for v in (-1, 0, 1):
                    p = (r[f"{name}{v}y"] + (0.5, 1, 2)[v + 1]) / (r["yes"] + 3.5)
                    q = (r[f"{name}{v}n"] + (2, 1, 0.5)[v + 1]) / (r["no"] + 3.5)
                    model[f"{r['kind']}|{name}|{v}"] = math.log(p / q)
        post = _sigmoid(_posterior_odds(F.col("says"), F.col("kind"), model))
    return model


def _features(says: Column) -> Column:
    names = (*LABELERS, "length", "digits", "parted")
    return F.array(*[_key(name, says[name]) for name in names])


def train(found: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, float], dict[str, float]]:
    """The labelers' model and the span classifier, from all candidates."""
    each = found.select(F.explode("more").alias("c")).select("c.kind", "c.says")
    counted = each.groupBy("kind", "says").agg(F.count("*").alias("n"))  # a fixed number of patterns and shapes
    patterns = stored(counted, "votes")
    model = reliabilities(patterns, rounds)
    post = _sigmoid(_posterior_odds(F.col("says"), F.col("kind"), model))
    soft = patterns.withColumn("post", post).select(
        "kind",
        F.explode(_features(F.col("says"))).alias("feature"),
        (F.col("n") * F.col("post")).alias("yes"),
        (F.col("n") * (1 - F.col("post"))).alias("no"),
    )
    rows = soft.groupBy("kind", "feature").agg(F.sum("yes"), F.sum("no")).collect()
    total: dict[int, list[float]] = {}
    for kind, feature, yes, no in rows:
        if feature.startswith("rule|"):  # every candidate has this feature once
            sums = total.setdefault(kind, [0.0, 0.0])
            sums[0], sums[1] = sums[0] + yes, sums[1] + no
    spans = {f"{kind}|prior": math.log((yes + 1) / (no + 1)) for kind, (yes, no) in total.items()}
    for kind, feature, yes, no in rows:
        spans[f"{kind}|{feature}"] = math.log((yes + 1) / (total[kind][0] + 2)) - math.log((no + 1) / (total[kind][1] + 2))
    return model, spans


def find_spans(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """`row` (the input without the text), `base` and `spans`: arrays of (start, kind, end), kind as in KINDS."""
    found = stored(candidates(docs, text), "pii")
    model, spans = train(found, rounds)

    def likely(c: Column) -> Column:
        kind = c["kind"]
        shape = F.aggregate(
            F.transform(_features(c["says"]), lambda f: _look(spans, _key(kind, f))),
            _look(spans, _key(kind, "prior")),
            lambda a, x: a + x,
        )
        accept = math.log(ACCEPT / (1 - ACCEPT))
        return (_posterior_odds(c["says"], kind, model) >= accept) & (shape >= accept)

    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.transform(
        F.filter("more", lambda c: free(c) & likely(c)),
        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")),
    )
    every = F.array_sort(F.array_distinct(F.concat("base", added)))
    return found.select("row", "base", every.alias("spans"))


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their spans of personal data."""
    out = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        *counts,
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )
