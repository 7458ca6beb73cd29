"""Personal data in texts, with built-in functions only.

A pattern proposes spans of each kind, leftmost and without overlap inside the kind (of
an account number where it begins; its end follows from its country and check);
a validator (number ranges, Luhn, mod-97, digit counts) confirms them or drops them;
words in the text before a span raise its score. Spans are code points, end
exclusive, of the whole text.

Defined cases: a null text is an empty one and has no spans. Rows are looked at one
by one, so repeated rows and ids are no matter. `spans` replaces a column of its name;
other extra columns are passed on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a span in which context words count.
CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    """`start` stands where a run may begin: it changes no match, and spares trying the inside of a run again. `hint` holds for every text with a match."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    context: str
    #: For a pattern that gives only where a span begins: the code points to look at from there, and the length of the span in them, null if it is none.
    ahead: int = 0
    length: Callable[[Column], Column] | None = None


def _only(m: Column, drop: str) -> Column:
    return F.regexp_replace(m, drop, "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, size - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def _mod97(m: Column) -> Column:
    """The check of an account number: first four characters to the end, letters as 10 to 35."""
    plain = F.upper(_only(m, " "))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        letter = F.ascii(c) - F.lit(55)
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - F.lit(48)) % 97).otherwise((rest * 100 + letter) % 97)

    size = F.length(plain)
    return size.between(15, 34) & (F.aggregate(F.sequence(F.lit(1), size), F.lit(0), step) == 1)


#: Length of an account number by country, of those in the registry.
_IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: An account number of 34 characters with a space after each but the last, and the character that ends it.
_IBAN_AHEAD = 68


def _iban_length(seen: Column) -> Column:
    """Of the ends that no letter or digit follows and that pass the check: the one of the country's length, or the last where the registry lacks the country."""
    run = F.regexp_extract(seen, r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){0,30}+", 0)
    ends = F.sequence(F.length(run), F.lit(15), F.lit(-1))
    until = lambda e: F.substring(seen, F.lit(1), e)
    closed = lambda e: ~F.substring(seen, e + 1, F.lit(1)).rlike("[A-Za-z0-9]") & (F.substring(seen, e, F.lit(1)) != " ")
    valid = F.filter(F.filter(ends, closed), lambda e: _mod97(until(e)))
    sizes = F.create_map(*(F.lit(x) for size, names in _IBAN_SIZES.items() for name in names.split() for x in (name, size)))
    size = F.element_at(sizes, F.substring(seen, 1, 2))
    own = F.filter(valid, lambda e: size.isNull() | (F.length(_only(until(e), " ")) == size))
    return F.when(F.length(run) >= 15, F.get(own, F.lit(0)))


def _parts_to_255(m: Column) -> Column:
    return ~F.exists(F.split(m, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))).between(4, 1 << 30) | (F.length(F.ltrim(part, F.lit("0"))).between(1, 3) & (F.ltrim(part, F.lit("0")).cast("int") > 255)))


_ALWAYS = lambda m: F.lit(True)

#: The first four kinds are the base. Repeated groups are possessive: nothing follows them, and they then need no stack.
KINDS = [
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
        lambda t: t.contains("@"), _ALWAYS, 0.8, r"(?i)(?:mail|contact|write|adress|correo|courriel)",
    ),
    Kind(
        "ip", r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        lambda t: t.rlike(r"[0-9]\.[0-9]"), _parts_to_255, 0.6, r"(?i)(?:\bip\b|address|server|host|login)",
    ),
    Kind(
        "card", r"[0-9](?:[ -]?[0-9])++",
        lambda t: t.rlike("[0-9 -]{14}"), lambda m: F.length(_only(m, "[ -]")).between(14, 19) & _luhn(_only(m, "[ -]")), 0.7, r"(?i)(?:card|visa|credit|karte|tarjeta|carte)",
    ),
    Kind(
        "phone", r"\+[0-9][ ().0-9-]+[0-9]",
        lambda t: t.contains("+"), lambda m: F.length(_only(m, "[^0-9]")).between(10, 15), 0.6, r"(?i)(?:phone|call|tel|mobil|fax)",
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})",
        lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), _ALWAYS, 0.9, r"(?i)(?:iban|account|bank|konto|cuenta|compte)", _IBAN_AHEAD, _iban_length,
    ),
    Kind(
        "key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
        lambda t: t.contains("AKIA") | t.contains("ASIA"), _ALWAYS, 0.8, r"(?i)(?:key|aws|access|secret)",
    ),
    Kind(
        "secret", r"(?i)(?<![a-z0-9])(?:password|passwd|api_key|apikey|secret|token)[=:][^\s,;]{8,}+",
        lambda t: t.contains("=") | t.contains(":"), _ALWAYS, 0.6, r"(?i)(?:login|user|config|export)",
    ),
]
BASE = [kind.name for kind in KINDS[:4]]
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _proposed(rank: int, kind: Kind) -> Column:
    """Spans of one kind from the matches `m<rank>` and the texts between them `b<rank>`."""
    found, between = F.col(f"m{rank}"), F.col(f"b{rank}")

    def add(state: Column, i: Column) -> Column:
        match, gap = F.get(found, i), F.get(between, i)
        start = state["at"] + F.length(gap)
        after = start + F.length(match)
        end, valid = after, kind.valid(match)
        if kind.length:
            end = start + kind.length(F.substring(F.col("t"), start + 1, F.lit(kind.ahead)))
            # What begins inside a span is no span of its own.
            valid = (start >= state["until"]) & end.isNotNull()
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.right(gap, F.lit(CONTEXT)).rlike(kind.context), 0.2).otherwise(0.0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
        spans = F.when(valid, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(after.alias("at"), F.when(valid, end).otherwise(state["until"]).alias("until"), spans.alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("until"), F.array().cast(_SPAN).alias("spans"))
    counted = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), empty, add, lambda state: state["spans"])
    return F.when(F.size(found) > 0, counted).otherwise(F.array().cast(_SPAN))


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `spans`: array of (start, rank, end, kind, score), by start and then by kind as listed."""
    names = [c for c in docs.columns if c != "spans"]
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    # Patterns run where the hint holds; matches and gaps are laid down before the spans are computed from them.
    for rank, kind in enumerate(KINDS):
        plain = plain.withColumn(f"m{rank}", F.when(kind.hint(F.col("t")), F.regexp_extract_all("t", F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for rank, kind in enumerate(KINDS):
        plain = plain.withColumn(f"b{rank}", F.when(F.size(f"m{rank}") > 0, F.split("t", kind.pattern, -1)).otherwise(F.array().cast("array<string>")))
    spans = F.array_sort(F.flatten(F.array(*(_proposed(rank, kind) for rank, kind in enumerate(KINDS)))))
    return plain.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
