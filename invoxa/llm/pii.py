"""Personal data: patterns propose spans, checksums confirm them, words nearby
adjust their score. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``valid`` (a test of the matched text) confirms.

    ``score`` is the sum of ``prior``, ``checked`` for a passed checksum, and
    ``near`` if one of ``context``'s words stands in the 40 characters before.
    Spans of a ``base`` kind stay at any score, others from THRESHOLD on.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    base: bool
    prior: float
    checked: float
    context: str
    near: float


THRESHOLD = 0.7
NEARBY = 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's test of a digit string: from the right, each second digit doubled."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """The mod-97 test of account numbers: the first four characters moved to the
    end, letters counted from 10 on, the number leaves 1."""
    plain = F.upper(F.translate(value, " ", ""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _address(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(
        p, F.lit("^0*+([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?$")))


def _always(value: Column) -> Column:
    return F.lit(True)


# Possessive loops and the look-behinds change no match: a run that fails at its
# start fails at each later place too. They keep the search linear and its stack flat.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _always,
         True, 0.9, 0.0, r"mail|contact|contacto|courriel|kontakt", 0.1),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _address,
         True, 0.6, 0.0, r"\bip\b|address|host|server|adresse|dirección", 0.3),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card,
         True, 0.3, 0.5, r"card|visa|credit|karte|carte|tarjeta", 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(10, 15),
         True, 0.7, 0.0, r"phone|call|tel|fax|mobil|móvil", 0.3),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
         mod97, False, 0.3, 0.5, r"iban|account|konto|compte|cuenta", 0.2),
    Kind("tel", r"(?<![A-Za-z0-9+.)-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])", _always,
         False, 0.4, 0.0, r"phone|call|tel[.:\x20eé]|fax|mobil|móvil", 0.4),
)

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"


def _matches(text: Column, kind: Kind) -> Column:
    return F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))


def _spans(zipped: Column, kind: Kind, rank: int, block: int = 512) -> Column:
    """Spans from matches ``v`` and the texts ``g`` before them (the last has none).

    Lists are walked in blocks, since each step copies its block's list so far.
    ``tail`` is the last NEARBY characters before the gap, whatever they belong to.
    """
    none = F.array().cast(SPAN)

    def last(*parts: Column) -> Column:
        return F.right(F.concat(*parts), F.lit(NEARBY))

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + F.length(x["g"])
        end = start + F.length(x["v"])
        before = last(a["tail"], F.right(x["g"], F.lit(NEARBY)))
        near = F.regexp_like(F.lower(before), F.lit(kind.context))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"),
                        x["v"].alias("value"),
                        (F.lit(kind.prior + kind.checked) + F.when(near, kind.near).otherwise(0.0)).alias("score"))
        keep = kind.valid(x["v"]) & (F.lit(True) if kind.base else span["score"] >= THRESHOLD)
        return F.struct(end.alias("pos"), last(before, F.right(x["v"], F.lit(NEARBY))).alias("tail"),
                        F.when(keep, F.concat(a["list"], F.array(span))).otherwise(a["list"]).alias("list"))

    def of_block(a: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(a["pos"].alias("pos"), a["tail"].alias("tail"), none.alias("list")), step,
                           lambda i: F.struct(i["pos"].alias("pos"), i["tail"].alias("tail"),
                                              F.concat(a["lists"], F.array(i["list"])).alias("lists")))

    n = F.size(zipped) - 1
    blocks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(block)),
                         lambda b: F.slice(zipped, b + 1, F.least(F.lit(block), n - b)))
    found = F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"),
                                          F.array().cast(f"array<{SPAN}>").alias("lists")),
                        of_block, lambda r: F.flatten(r["lists"]))
    return F.when(n > 0, found).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: row (all its columns), doc_id, text, spans.

    ``spans`` is an array of (start, rank, end, kind, value, score), ordered by
    start, then by the order of KINDS; places count code points from 0, the end is
    exclusive. Spans of kinds that are not base and touch a base span are dropped.
    Null and empty texts have no spans. Ids may be null or repeat; the
    columns of the input may have any names. No shuffle, no Python code on the
    executors; a text is one row, whose patterns run in linear time.
    """
    out = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = {"email": F.contains(F.col("text"), F.lit("@")), "phone": F.contains(F.col("text"), F.lit("+"))}
    digit = F.regexp_like(F.col("text"), F.lit("[0-9]"))
    empty = F.array().cast("array<string>")
    out = out.select("*", *(F.when(some.get(k.name, digit), _matches(F.col("text"), k)).otherwise(empty).alias(f"m_{k.name}")
                            for k in KINDS))
    out = out.select("row", "doc_id", "text", *(
        F.when(F.size(f"m_{k.name}") > 0, F.arrays_zip(
            F.col(f"m_{k.name}").alias("v"), F.split("text", k.pattern, -1).alias("g"))).alias(f"z_{k.name}") for k in KINDS))
    out = out.select("row", "doc_id", "text", *(
        F.coalesce(_spans(F.col(f"z_{k.name}"), k, i), F.array().cast(SPAN)).alias(f"s_{k.name}")
        for i, k in enumerate(KINDS)))
    out = out.select("row", "doc_id", "text", F.concat(*(f"s_{k.name}" for k in KINDS if k.base)).alias("base"),
                     F.concat(*(f"s_{k.name}" for k in KINDS if not k.base)).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.select("row", "doc_id", "text", F.array_sort(F.concat(F.col("base"), apart)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets (of overlapping
    spans the first names the place, and their union is removed)."""
    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["pos"]
        gap = F.greatest(s["start"] - a["pos"], F.lit(0))
        done = F.struct(
            F.substring(a["rest"], s["end"] - a["pos"] + 1, F.length(a["rest"])).alias("rest"),
            s["end"].alias("pos"),
            F.concat(a["out"], F.left(a["rest"], gap),
                     F.when(fresh, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")).alias("out"))
        return F.when(s["end"] <= a["pos"], a).otherwise(done)

    start = F.struct(text.alias("rest"), F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda r: F.concat(r["out"], r["rest"]))).otherwise(text)
