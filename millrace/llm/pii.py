"""Personal data in texts, with built-in functions only.

Regular expressions propose spans, checksums and ranges confirm them (Luhn for cards, mod-97 for
IBANs, parts of addresses), and words nearby adjust the score. Every row is worked on alone: nothing
is shuffled, and a text that holds neither a digit nor "@" leaves after one scan.

A pattern's matches come from ``regexp_extract_all`` and their places from the lengths of the pieces that
``split`` leaves between them, added up in blocks so that a text with very many matches stays cheap.
The patterns are possessive and look behind, which Java needs to run in linear time and constant stack;
they match what the plain forms in ``BASE`` match.

Defined cases: a null text counts as empty; a row without id is scanned as any other; rows that repeat
give the same result each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order, each with its pattern. The first four are always kept if they pass their check.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters of an IBAN by country; a candidate has its country's number, so words that follow it aren't taken in.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
#: Countries that aren't listed take the longest chain, as all did before.
IBAN = (
    r"(?<![A-Za-z0-9])(?:"
    + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
    + rf"|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20?+[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"
)
#: The same languages for Java. Card: chains of 12 to 19 digits only, since others fail the check anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": IBAN,
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<![a-z0-9])(?:(?:[a-z0-9]{1,12}[_-]){0,2}+(?:token|secret|password|passwd|key)[\"']?\x20*+[=:]\x20*+[\"']?[a-z0-9/+_.-]{16,}+|AKIA[0-9A-Z]{16}+(?![a-z0-9])|gh[pousr]_[a-z0-9]{36,}+)",
}
KINDS = list(PATTERNS)
#: What each match of a kind holds, sought once before its pattern is run; all but e-mail addresses have a digit too.
SIGNS = {
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "tel": r"[0-9]{3}[\x20.-][0-9]{4}",
    "secret": r"(?i)token|secret|passw|key|AKIA|gh[pousr]_",
}
#: What a confirmed span scores alone, and the words nearby that raise it by CONTEXT.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "tel": 0.3, "secret": 0.8}
WORDS = {
    "email": r"e-?mail|contact|write|mailto|correo|courriel",
    "ip": r"\bip\b|address|host|server|login|adresse",
    "card": r"card|credit|visa|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax|telefon|llam|appel",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|tax id",
    "tel": r"phone|\btel|call|mobile|fax|telefon|llam|appel",
    "secret": r"auth|credential|login|private|api",
}
CONTEXT, THRESHOLD, BEFORE, AFTER = 0.3, 0.5, 40, 20
_BLOCK = 256


def _running(widths: Column) -> Column:
    """Sums of all elements before each: first within blocks, then over the blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(widths) - 1) / _BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(widths, b * _BLOCK + 1, _BLOCK))
    zero, add = F.lit(0), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    firsts = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), F.array(zero), add)
    return F.flatten(F.zip_with(blocks, firsts, lambda b, o: F.when(b.isNotNull(), F.slice(F.aggregate(b, F.array(o), add), 1, F.size(b))).otherwise(F.array().cast("array<int>"))))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _mod97(hit: Column) -> Column:
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return _mod97(hit)
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        value = F.regexp_extract(hit, r"[A-Za-z0-9/+_.-]{16,}$", 0)
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    return F.lit(True)


SPAN = "array<struct<start:int,rank:int,kind:string,end:int,text:string,score:double>>"


def _spans(kind: str, gaps: Column, hits: Column) -> Column:
    """Confirmed spans of one kind, in order, from its matches and the pieces between them."""
    widths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    rank = KINDS.index(kind)
    near = lambda i: F.lower(F.concat(F.substring(F.element_at(gaps, i + 1), -BEFORE, BEFORE), F.lit(" "), F.substring(F.element_at(gaps, i + 2), 1, AFTER)))
    each = F.zip_with(_running(widths), F.transform(hits, lambda h, i: F.struct(h.alias("hit"), i.alias("i"))), lambda before, h: F.struct(
        (before + F.length(F.element_at(gaps, h["i"] + 1))).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (before + F.length(F.element_at(gaps, h["i"] + 1)) + F.length(h["hit"])).alias("end"),
        h["hit"].alias("text"), F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near(h["i"]).rlike(WORDS[kind]), CONTEXT).otherwise(0.0)).alias("score"),
    ))
    held = F.filter(each, lambda s: _confirmed(kind, s["text"]) & (F.lit(kind in BASE) | (s["score"] >= THRESHOLD)))
    return F.when(F.size(hits) > 0, held).otherwise(F.array()).cast(SPAN)


def _once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``value`` as a column that later expressions read and don't compute again."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``id_col``, ``base`` and ``spans``, arrays of (start, rank, kind, end, text, score) by start and kind.

    Places are code points, the end exclusive. ``base`` holds e-mail addresses, IP addresses, cards and
    international phone numbers; ``spans`` adds IBANs, keys and tokens (of 16 characters at least, letters and digits, eight different ones) and, where words nearby
    support them, social security and national phone numbers; but for IBANs none that overlaps a base span.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return _found(rows, "_id").select(F.col("_id").alias(id_col), "f.base", "f.spans")


def _found(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of each row, and ``f``: base and all spans of its ``_text``."""
    text = F.col("_text")
    found = []
    for kind, pattern in PATTERNS.items():
        there = F.col(f"_signs.{kind}")
        found += [F.when(there, F.split(text, pattern, -1)).alias(f"{kind}_gaps"), F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(f"{kind}_hits")]
    digit = text.rlike("[0-9]")
    signs = [(digit & text.rlike(SIGNS[k]) if k in SIGNS else text.contains("@")).alias(k) for k in KINDS]
    rows = _once(rows, "_signs", F.struct(*signs), "_text", *[k for k in keep if k != "_text"])
    rows = _once(rows, "m", F.struct(*found), *keep)
    rows = _once(rows, "s", F.struct(*[_spans(k, F.col(f"m.{k}_gaps"), F.col(f"m.{k}_hits")).alias(k) for k in KINDS]), *keep)
    base = F.concat(*[F.col(f"s.{k}") for k in BASE])
    more = F.concat(*[F.col(f"s.{k}") for k in KINDS if k not in BASE])
    rows = _once(rows, "b", F.struct(F.array_sort(base).alias("base"), more.alias("more")), *keep)
    free = F.filter(F.col("b.more"), lambda s: (s["kind"] == "iban") | ~F.exists(F.col("b.base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return _once(rows, "f", F.struct(F.col("b.base").alias("base"), F.array_sort(F.concat(F.col("b.base"), free)).alias("spans")), *keep)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with each span of the text, but for those that overlap an earlier one, replaced by its kind in brackets.

    A row's spans are applied where they are found, so ids don't matter and nothing is shuffled. A null text stays null.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    own = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own).withColumn("_text", F.coalesce(F.col(next(k for k, c in own.items() if c == text_col)), F.lit("")))
    rows = _found(rows, *own, "_text")
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at")))
    done = F.aggregate(F.col("f.spans"), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    return rows.select(*[F.when(F.col(k).isNotNull(), done).alias(c) if c == text_col else F.col(k).alias(c) for k, c in own.items()])
