"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score.

DataFrame functions only.  Positions of all matches come from two regular-expression functions: the matches
(``regexp_extract_all``) and what lies between them (``split``); running lengths give the starts.  Each pattern
runs only on texts that hold a sign without which it cannot match.

Patterns are written so that Java's matcher neither recurses nor backtracks: repeated groups are possessive, and
runs of characters are entered at their start only (or where the last match ended), which leaves
the leftmost non-overlapping matches unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``sign`` must occur in a text for ``pattern`` to match.  ``confirm`` names the check that a match must
    pass.  ``score`` is raised by ``boost`` when a context word stands in the ``CONTEXT_CHARS`` before the match; kinds that
    are not ``base`` need ``THRESHOLD``, must not touch a letter, digit or hyphen, and give way to base spans.
    """

    name: str
    sign: str
    pattern: str
    confirm: str
    score: float
    boost: float
    context: str
    base: bool = False


THRESHOLD = 0.6
CONTEXT_CHARS = 40
#: Kinds in the order of the output, base kinds first.
KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "none",
         0.9, 0.1, "mail|contact|write", base=True),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "octets",
         0.6, 0.3, "ip|host|server|address", base=True),
    Kind("card", r"[0-9](?:[ -]?[0-9]){15}", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", "luhn",
         0.8, 0.2, "card|visa|credit|payment", base=True),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", "phone",
         0.7, 0.2, "phone|call|tel|fax|mobile", base=True),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9]", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "mod97",
         0.8, 0.2, "iban|bank|account|konto"),
    Kind("card_short", r"3[47][0-9][0-9]", r"3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}", "luhn15",
         0.5, 0.3, "card|amex|american express|credit|payment"),
    Kind("ssn", r"[0-9]-[0-9][0-9]-[0-9]", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn",
         0.4, 0.4, "ssn|social security|security number"),
    Kind("phone_local", r"[0-9]{3}[ )-]", r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}", "none",
         0.3, 0.4, "phone|call|tel|fax|mobile"),
)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Luhn check of a string of digits: every second digit from the right is doubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))),
                        F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def mod97_valid(match: Column) -> Column:
    """ISO 7064 mod 97-10 check of an account number: the first four characters moved to the end, letters as 10 to 35."""
    compact = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(values, F.lit(0), lambda acc, v: (acc * F.when(v > 9, 100).otherwise(10) + F.coalesce(v, F.lit(0))) % 97)
    return F.length(compact).between(15, 34) & (rest == 1)


def _confirmed(check: str, match: Column) -> Column:
    digits = _digits(match)
    if check == "octets":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if check == "luhn":
        return F.when(F.length(digits).between(16, 19), luhn_valid(digits)).otherwise(F.lit(False))
    if check == "luhn15":
        return luhn_valid(digits)
    if check == "phone":
        return F.length(digits).between(8, 15)
    if check == "mod97":
        return mod97_valid(match)
    if check == "ssn":
        return ~digits.rlike("^(?:000|666|9)") & ~digits.rlike("^[0-9]{3}00") & ~digits.rlike("0000$")
    return F.lit(True)


def _matches(text: Column, kind: Kind) -> Column:
    """All matches in order: struct(match, start, end)."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    steps = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)),
                       lambda m, gap: F.struct(m.alias("match"), F.length(gap).alias("gap"), F.length(m).alias("n")))
    empty = F.array().cast("array<struct<match:string,start:int,end:int>>")
    placed = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.struct((acc["at"] + s["gap"] + s["n"]).alias("at"),
                                F.concat(acc["out"], F.array(F.struct(s["match"].alias("match"), (acc["at"] + s["gap"]).alias("start"),
                                                                      (acc["at"] + s["gap"] + s["n"]).alias("end")))).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.rlike(kind.sign), placed).otherwise(empty)


def kind_spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind, with scores; code points, end exclusive."""
    def touches(s: Column) -> Column:
        before = F.substring(text, s["start"], F.lit(1))
        after = F.substring(text, s["end"] + 1, F.lit(1))
        side = "[A-Za-z0-9-]"
        return (F.when(s["start"] > 0, before.rlike(side)).otherwise(F.lit(False))) | after.rlike(side)

    def scored(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substring(text, begin + 1, s["start"] - begin)).rlike(f"(?:^|[^a-z])(?:{kind.context})")
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        (F.lit(kind.score) + F.when(near, kind.boost).otherwise(0.0)).alias("score"))

    good = F.filter(_matches(text, kind), lambda s: _confirmed(kind.confirm, s["match"])
                    if kind.base else _confirmed(kind.confirm, s["match"]) & ~touches(s))
    spans = F.transform(good, scored)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def _overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``more_spans`` (SPAN, by kind as in KINDS, then start).

    Null texts count as empty and have no spans.  Ties and repeated rows need no rule: every row stands alone.
    Spans of one kind never overlap; kinds of the base may.  Very long runs of digits or of address
    characters are read once.  Existing columns of these two names are replaced; all others stay.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    base = F.concat(*[kind_spans(text, k) for k in KINDS if k.base]).cast(SPAN)
    more = F.concat(*[kind_spans(text, k) for k in KINDS if not k.base]).cast(SPAN)
    found = docs.withColumns({"base_spans": base, "more_spans": more})
    return found.withColumn("more_spans", F.filter("more_spans", lambda s: ~_overlaps(F.col("base_spans"), s)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; edge cases as for ``find_personal_data``."""
    found = find_personal_data(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    def count(name: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *[count(k.name) for k in KINDS if k.base],
                        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
                        joined(F.concat("base_spans", "more_spans")).alias("spans"))
