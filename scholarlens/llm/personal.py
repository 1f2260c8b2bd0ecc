"""Personal data by weak supervision.

Candidates are the fixed kinds (email, ip, card, phone) and weaker forms of them and of names
and numbers. Four labelers vote on each candidate (for, against, or nothing): its pattern, a
gazetteer, the words before it, and its shape. Candidates are counted per kind and votes, a
table of at most ``len(KINDS) * 3**4`` rows; expectation-maximisation on it estimates how far
each labeler is to be trusted without any label, and a logistic regression is trained on the
resulting soft labels. Fixed kinds are always reported; the others if the classifier accepts
them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import listed, overlapping, spans_of, text_of
from scholarlens.session import written

# The four kinds. Possessive and guarded forms of the same matches, so that long
# runs and long chains cost linear time and no stack.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

MASKED_EMAIL = (r"\b[A-Za-z0-9._%+-]{2,40}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,40}+"
                r"(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z]{2,20}+)+")
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
TITLED_NAME = (r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?\x20"
               r"\p{Lu}\p{Ll}{1,30}+(?:\x20\p{Lu}\p{Ll}{1,30}+)?")
WEAK = ("masked_email", "local_phone", "national_id", "titled_name", "number")
KINDS = BASE + WEAK

FIRST_NAMES = ("anna maria john james robert michael david thomas peter paul mary linda sarah laura "
               "julia sofia hans klaus stefan pierre jean claire marie carlos jose juan luis carmen").split()
CUES = (r"(?i)(?:e-?mail|contact|phone|tel\b|telefon|mobile|mobil|call|fax|card|visa|iban|karte|"
        r"carte|tarjeta|\bip\b|address|adresse|dirección|ssn|social|name|signed|dear)[^\n]{0,24}$")
AGAINST = (r"(?i)(?:version|release|order|invoice|isbn|issn|item|sku|page|total|build|figure|"
           r"section|part no|serial)[^\n]{0,16}$")
BEFORE = 40
EM_ROUNDS = 200


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of ``v`` pass the check sum."""
    d = F.reverse(_digits(v))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + (
        lambda x: F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))(
            F.substring(d, i, F.lit(1)).cast("int")))
    return (F.length(d) > 0) & (total % 10 == 0)


def candidates(t: Column) -> dict[str, Column]:
    digit = t.rlike("[0-9]")
    chain = spans_of(t, CARD, t.rlike(r"(?:[0-9][\x20-]?){12}"))
    n = lambda x: F.length(_digits(x["v"]))
    is_card = lambda x: n(x).between(12, 19) & luhn(x["v"])
    small = lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))
    return {
        "email": spans_of(t, EMAIL, t.contains("@")),
        "ip": F.filter(spans_of(t, IP, t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
                       lambda x: F.forall(F.split(x["v"], r"\."), small)),
        "card": F.filter(chain, is_card),
        "phone": F.filter(spans_of(t, PHONE, t.rlike(r"\+[0-9]")), lambda x: n(x).between(9, 15)),
        "masked_email": spans_of(t, MASKED_EMAIL, t.contains("at)") | t.contains("at]")),
        "local_phone": spans_of(t, LOCAL_PHONE, digit),
        "national_id": spans_of(t, NATIONAL_ID, t.rlike("[0-9]-[0-9]{2}-[0-9]")),
        "titled_name": spans_of(t, TITLED_NAME, t.rlike(
            r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mon|Mad|Mme|Se|Sr|Sra)")),
        "number": F.filter(chain, lambda x: n(x).between(12, 19) & ~luhn(x["v"])),
    }


def _votes(kind: str, x: Column, t: Column) -> tuple[Column, ...]:
    """Pattern, gazetteer, context and shape: 1 for, -1 against, 0 nothing."""
    zero, yes, no = F.lit(0), F.lit(1), F.lit(-1)
    low = F.lower(x["v"])
    pattern = {**dict.fromkeys(BASE, yes), "number": no}.get(kind, zero)
    gazetteer = {
        "email": F.when(low.rlike(r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"), yes),
        "masked_email": F.when(low.rlike(r"(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"), yes),
        "ip": F.when(low.rlike(r"^(?:0|127|255)\."), no),
        "card": F.when(low.rlike("^[3-6]"), yes).otherwise(no),
        "number": F.when(low.rlike("^[3-6]"), zero).otherwise(no),
        "phone": F.when(low.rlike(r"^\+(?:1|3|4|5|6|7|8|9)"), yes),
        "titled_name": F.when(low.rlike(r"\b(?:" + "|".join(FIRST_NAMES) + r")\b"), yes),
    }.get(kind, zero)
    start = F.greatest(x["s"] - BEFORE, F.lit(0))
    before = F.substring(t, start + 1, x["s"] - start)
    context = F.when(before.rlike(AGAINST), no).when(before.rlike(CUES), yes).otherwise(zero)
    n = F.length(_digits(x["v"]))
    shape = {
        "email": F.when(F.length(x["v"]) <= 64, yes).otherwise(no),
        "ip": F.when(low.rlike(r"(?:^|\.)0[0-9]"), no).otherwise(yes),
        "card": F.when(n.between(15, 16), yes).otherwise(zero),
        "number": F.when(n == 16, zero).otherwise(no),
        "phone": F.when(n.between(10, 13), yes).otherwise(zero),
        "local_phone": F.when(low.rlike(r"^\(?[2-9]"), yes).otherwise(no),
        "national_id": F.when(low.rlike("^(?:000|666|9)"), no).otherwise(yes),
        "titled_name": F.when(F.length(x["v"]) <= 30, yes).otherwise(zero),
    }.get(kind, zero)
    return pattern, F.coalesce(gazetteer, zero), context, F.coalesce(shape, zero)


def _voter(order: int, kind: str) -> Callable[[Column], Column]:
    def vote(x: Column) -> Column:
        return F.struct(x["s"].alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("k"),
                        x["e"].alias("e"), F.array(*_votes(kind, x, F.col("t"))).alias("votes"))
    return vote


def label(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, fixed spans per kind, and every candidate with its votes."""
    keep = docs.columns if keep is None else keep
    df = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), text_of(text).alias("t"))
    df = df.select("row", "t", F.struct(
        *[v.alias(k) for k, v in candidates(F.col("t")).items()]).alias("p"))
    df = df.withColumn("base", F.concat(*[F.col(f"p.{k}") for k in BASE]))
    voted = [F.transform(
        F.filter(F.col(f"p.{kind}"), lambda x: ~overlapping(F.col("base"), x))
        if kind in WEAK else F.col(f"p.{kind}"), _voter(order, kind)) for order, kind in enumerate(KINDS)]
    return df.select("row", F.concat(*voted).alias("candidates"))


def reliabilities(patterns: Sequence[tuple[str, tuple[int, ...], int]], rounds: int = EM_ROUNDS
                  ) -> list[float]:
    """Posterior of each vote pattern by expectation-maximisation over kinds and labelers.

    ``patterns`` holds (kind, votes, count), one row per distinct kind and votes. Each labeler
    has a distribution of its votes for real and for other spans, each kind a share of real
    ones; both with a prior of one pseudo-count. Starts from the majority of the votes.
    """
    post = [1 / (1 + math.exp(-2.0 * sum(v))) for _, v, _ in patterns]
    labelers = range(len(patterns[0][1])) if patterns else ()
    kinds = sorted({k for k, _, _ in patterns})
    for _ in range(rounds):
        share, table = {}, {}
        for kind in kinds:
            rows = [(p, c) for p, (k, _, c) in zip(post, patterns) if k == kind]
            share[kind] = (1 + sum(p * c for p, c in rows)) / (2 + sum(c for _, c in rows))
        for j in labelers:
            for real in (True, False):
                mass = {-1: 1.0, 0: 1.0, 1: 1.0}
                for p, (_, v, c) in zip(post, patterns):
                    mass[v[j]] += c * (p if real else 1 - p)
                total = sum(mass.values())
                table[j, real] = {x: m / total for x, m in mass.items()}
        after = []
        for kind, v, _ in patterns:
            odds = math.log(share[kind]) - math.log(1 - share[kind]) + sum(
                math.log(table[j, True][v[j]]) - math.log(table[j, False][v[j]]) for j in labelers)
            after.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
        done = max((abs(a - b) for a, b in zip(after, post)), default=0) < 1e-9
        post = after
        if done:
            break
    return post


def _features(kind: Column, votes: Column) -> Column:
    hot = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.array(*[hot(kind == k) for k in KINDS],
                   *[hot(F.get(votes, j) == v) for j in range(4) for v in (-1, 1)])


def train(labelled: DataFrame) -> tuple[list[float], float] | None:
    """Weights and intercept of the span classifier; None without candidates."""
    x = F.explode("candidates").alias("c")
    found = labelled.select(x).groupBy("c.k", "c.votes").count().orderBy("k", "votes").collect()
    patterns = [(r["k"], tuple(r["votes"]), r["count"]) for r in found]
    if not patterns:
        return None
    post = reliabilities(patterns)
    # one made-up span for and one against keep both classes present
    rows = [(k, list(v), float(c), p) for (k, v, c), p in zip(patterns, post)]
    rows += [(KINDS[0], [1] * 4, 1.0, 1.0), (KINDS[-1], [-1] * 4, 1.0, 0.0)]
    spark = labelled.sparkSession
    soft = spark.createDataFrame(rows, "k string, votes array<int>, n double, p double")
    both = soft.select(_features(F.col("k"), F.col("votes")).alias("x"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))
    ).alias("y")).select(array_to_vector("x").alias("features"), "y.*").where("weight > 0")
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(both.coalesce(1))
    return [float(w) for w in model.coefficients], float(model.intercept)


def _of_kind(order: int) -> Callable[[Column], Column]:
    return lambda x: x["o"] == order


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: struct ``row``, counts of the fixed kinds, their digest, ``spans``.

    Null text is empty, an empty table gives no rows, repeated rows each give a row. Spans of
    equal start are listed in the order of ``KINDS``. Card and phone may overlap; each kind is
    matched by itself.
    """
    labelled = written(label(docs, text, keep), "personal")
    model = train(labelled)
    if model is None:
        accepted = lambda c: F.lit(False)
    else:
        weights, bias = model
        w = F.array(*[F.lit(x) for x in weights])

        def accepted(c: Column) -> Column:
            x = F.zip_with(_features(c["k"], c["votes"]), w, lambda a, b: a * b)
            return F.aggregate(x, F.lit(bias), lambda s, v: s + v) > 0
    c = F.col("candidates")
    base = F.filter(c, lambda x: x["o"] < len(BASE))
    chosen = F.filter(c, lambda x: (x["o"] < len(BASE)) | accepted(x))
    plain = lambda a: F.transform(a, lambda x: F.struct(
        x["s"].alias("s"), x["o"].alias("o"), x["k"].alias("k"), x["e"].alias("e")))
    return labelled.select(
        "row", *[F.size(F.filter(c, _of_kind(i))).cast("long").alias(f"n_{k}")
                 for i, k in enumerate(BASE)],
        F.sha2(listed(plain(base)), 256).alias("base_sha256"), listed(plain(chosen)).alias("spans"))
