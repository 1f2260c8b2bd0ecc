"""Secrets, and parts of credentials that are only telling together.

The fixed kinds (assign, access, hex) are always reported. Weak candidates, which are a bare
account name, a bare key-like string or a bare endpoint, are held back until a secret links them.
The spans of a document lie in nested scopes: blocks between blank lines or braces, sections
between headings, and the document. Spans become rows, and an interval join by sorted position
gives every secret the identifier and the endpoint that are nearest to it in the narrowest scope
that holds one; a wider scope counts only for what is missing in the narrower ones. A key-like
string is reported when it has an identifier or endpoint, an identifier when a secret has taken
it, an endpoint when a secret has taken it and an identifier. Parts that no secret takes stay
unreported, so one password does not make every address of a long document a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.llm.common import listed, marked, overlapping, spans_of, text_of
from scholarlens.session import written

# The patterns of the three kinds.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
MIN_ASSIGNED = 6

IDENTIFIER = (r"(?i:\b(?:user(?:name)?|login|account|client_?id))[\"']?\x20*[:=]\x20*[\"']?"
              r"[A-Za-z0-9_.@-]{3,}+")
ENDPOINT = (r"\b(?:https?|ftp|s3|gs|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp)"
            r"://[^\s\"'<>,]++")
KEY_LIKE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}+={0,2}"

#: What parts blocks, and what parts sections, in the text between two spans.
BLOCK_END = r"\n[\x20\t\r]*\n|[{}]"
SECTION_END = (r"\n[\x20\t\r]*\n\x20{0,3}#{1,6}\x20|\n\x20{0,3}\[[^\]\n]{1,80}\][\x20\t\r]*\n"
               r"|\n(?:-{3,}|={3,}|\*{3,})[\x20\t\r]*\n")
#: Kinds in the order of the list of spans, and the part that each plays.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "key": "secret",
         "identifier": "identifier", "endpoint": "endpoint"}
KINDS, FIXED = tuple(ROLES), ("assign", "access", "hex")
#: Scopes from narrow to wide.
SCOPES = ("block", "section", "document")


def parts(t: Column) -> dict[str, Column]:
    """Spans per part; ``v`` holds the assigned value or the match."""
    low = F.lower(t)
    word = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains(
        "apikey") | low.contains("api_key")
    who = low.contains("user") | low.contains("login") | low.contains("account") | low.contains(
        "client")
    return {
        "assign": F.filter(spans_of(t, ASSIGN, word, 1),
                           lambda x: F.length(x["v"]) >= MIN_ASSIGNED),
        "access": spans_of(t, ACCESS, t.contains("AKIA")),
        "hex": spans_of(t, HEX, t.rlike("[0-9a-f]{24}")),
        "identifier": spans_of(t, IDENTIFIER, who),
        "endpoint": spans_of(t, ENDPOINT, t.contains("://")),
        # letters of both cases and digits: a bare word or number is no key
        "key": F.filter(spans_of(t, KEY_LIKE, t.rlike("[A-Za-z0-9+/_-]{32}")),
                        lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[a-z]")
                        & x["v"].rlike("[A-Z]")),
    }


def found(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One stored row per document: ``rid``, ``row``, counts and digest, ``fixed`` and ``places``.

    ``fixed`` holds the spans of the fixed kinds. ``places`` holds the spans of all kinds in order,
    with whether a block or section ends in the text before each; it is null where no weak
    candidate can be completed. Weak candidates that overlap a fixed span are left out.
    """
    keep = docs.columns if keep is None else keep
    df = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), text_of(text).alias("t"))
    df = df.select("row", "t", F.struct(*[v.alias(k) for k, v in parts(F.col("t")).items()]).alias("p"))
    df = df.withColumn("base", F.concat(*[F.col(f"p.{k}") for k in FIXED]))
    apart = lambda k: F.filter(F.col(f"p.{k}"), lambda x: ~overlapping(F.col("base"), x))
    df = df.select("row", "t", *[(F.col(f"p.{k}") if k in FIXED else apart(k)).alias(k) for k in KINDS])
    some = lambda *names: F.greatest(F.lit(0), *[F.size(k) for k in names]) > 0
    of = lambda role: [k for k in KINDS if ROLES[k] == role]
    open_ = some(*of("secret")) & some(*of("identifier"), "endpoint") & some(
        *[k for k in KINDS if k not in FIXED])
    spans = lambda kinds: F.sort_array(F.concat(*[
        marked(F.col(k), k, i) for i, k in enumerate(KINDS) if k in kinds]))
    df = df.select("row", "t", *[F.size(k).cast("long").alias(f"n_{k}") for k in FIXED],
                   spans(FIXED).alias("fixed"), F.when(open_, spans(KINDS)).alias("all"))

    def place(x: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("all"), i - 1)["e"], F.lit(0))
        gap = F.col("t").substr(end + 1, x["s"] - end)
        return F.struct(x["s"].alias("s"), x["o"].alias("o"), x["k"].alias("k"), x["e"].alias("e"),
                        gap.rlike(BLOCK_END).cast("int").alias("block"),
                        gap.rlike(SECTION_END).cast("int").alias("section"))

    return written(df.select(
        F.monotonically_increasing_id().alias("rid"), "row", *[f"n_{k}" for k in FIXED],
        F.sha2(listed(F.col("fixed")), 256).alias("base_sha256"), "fixed",
        F.transform("all", place).alias("places")), "secrets")


def links(places: DataFrame) -> DataFrame:
    """Interval join of the stored ``places``: a row per secret that has a complement.

    ``rid``, ``secret``, ``identifier`` and ``endpoint`` are structs (s, o, k, e), the last two with
    ``scope`` (0 block, 1 section, 2 document) and null where there is none. In each direction
    only the last span that starts before, or the first that starts after, can be the nearest, and
    it shares the narrowest scope, since scopes do not overlap; so two ordered passes over the
    spans of a document find it, and no pairs are formed. Of two in the same scope the one with
    fewer characters between wins, then the earlier one.
    """
    rows = places.where("size(places) > 0").select("rid", F.explode("places").alias("x")).select(
        "rid", "x.*")
    doc = Window.partitionBy("rid")
    order = doc.orderBy("s", "o", "e")
    rows = rows.withColumns({"block": F.sum("block").over(order),
                             "section": F.sum("section").over(order)})
    back = doc.orderBy(F.desc("s"), F.desc("o"), F.desc("e"))
    here = F.struct("s", "o", "k", "e", "block", "section")
    roles = ("identifier", "endpoint")
    plays = lambda role: F.col("k").isin([k for k in KINDS if ROLES[k] == role])
    for way, by in (("before", order), ("after", back)):
        rows = rows.withColumns({f"{role}_{way}": F.last(F.when(plays(role), here), True).over(
            by.rowsBetween(Window.unboundedPreceding, -1)) for role in roles})

    def ranked(x: Column, apart: Column) -> Column:
        scope = F.when(x["section"] != F.col("section"), 2).when(
            x["block"] != F.col("block"), 1).otherwise(0)
        return F.when(x.isNotNull(), F.struct(
            scope.alias("scope"), F.greatest(apart, F.lit(0)).alias("apart"), x["s"].alias("s"),
            x["o"].alias("o"), x["k"].alias("k"), x["e"].alias("e")))

    def nearest(role: str) -> Column:
        a, b = F.col(f"{role}_before"), F.col(f"{role}_after")
        return F.array_min(F.array(ranked(a, F.col("s") - a["e"]), ranked(b, b["s"] - F.col("e"))))

    return rows.where(plays("secret")).select(
        "rid", F.struct("s", "o", "k", "e").alias("secret"),
        *[nearest(role).alias(role) for role in roles]).where(
        F.col("identifier").isNotNull() | F.col("endpoint").isNotNull())


def completed(linked: DataFrame) -> DataFrame:
    """Per ``rid`` the weak spans that links complete, each once."""
    span = lambda c: F.struct(*[F.col(c)[k].alias(k) for k in ("s", "o", "k", "e")])
    both = F.col("identifier").isNotNull() & F.col("endpoint").isNotNull()
    weak = F.array(F.when(F.col("secret.k") == "key", span("secret")),
                   F.when(F.col("identifier.k") == "identifier", span("identifier")),
                   F.when(both, span("endpoint")))
    return linked.select("rid", F.explode(weak).alias("x")).where("x is not null").groupBy(
        "rid").agg(F.collect_set("x").alias("weak"))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: struct ``row`` of the ``keep`` columns, spans per kind, ``spans``.

    Null text is empty, an empty table gives no rows, repeated rows each give a row, and columns
    of any name stay inside ``row``. Spans of equal start are listed in the order of the kinds.
    The spans of one text meet in one task, as the text does; a text is scanned once.
    """
    stored = found(docs, text, keep)
    weak = completed(links(stored)).withColumnRenamed("rid", "of")
    added = F.coalesce(F.col("weak"), F.filter("fixed", lambda x: F.lit(False)))
    return stored.join(weak, F.col("rid") == F.col("of"), "left").select(
        "row", *[f"n_{k}" for k in FIXED], "base_sha256",
        listed(F.concat("fixed", added)).alias("spans"))
