"""Personal data in text: patterns propose spans, checksums confirm them, context words adjust their score; native.

Base kinds (email, ip, card, phone) are reported whenever their rule holds. Further kinds need a score: an account
number must pass mod-97, an identity number or a local phone number must have a context word nearby. Each finding carries
its score: what its pattern is worth, more for a checksum passed, more for a context word within CONTEXT characters. The
scan is one projection: no shuffle.

Defined results: null and empty text have no findings; null ids, repeated rows and ties are scanned like any row; an empty
table gives an empty result; other columns are neither read nor in the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_of
from .spans import apart, count_of, found, let, written

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "local_phone")
EMAIL, IP, CARD, PHONE, IBAN, NATIONAL_ID, LOCAL_PHONE = range(7)
#: Fixed values of the base rules. Possessive repeats match the same, without a stack that grows with the text; an
#: address begins where its run of characters does, or where the last one ended.
EMAIL_PATTERN = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_PATTERN = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_PATTERN = r"[0-9](?:[\x20-]?[0-9]){12}+(?:[\x20-]?[0-9])*+"
PHONE_PATTERN = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Numbers up to 255, leading zeros allowed, four of them.
IP_VALUE = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
IBAN_PATTERN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
NATIONAL_ID_PATTERN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE_PATTERN = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
#: What a pattern is worth alone, and the words that raise it when near.
WORTH = {EMAIL: 0.9, IP: 0.6, CARD: 0.5, PHONE: 0.7, IBAN: 0.5, NATIONAL_ID: 0.4, LOCAL_PHONE: 0.4}
NEAR = {
    EMAIL: "e-?mail|contact|write|kontakt|correo|courriel",
    IP: "address|host|server|client|login|adresse",
    CARD: "card|visa|credit|payment|karte|carte|tarjeta",
    PHONE: "phone|call|tel|mobile|fax|anruf|appel|llam",
    IBAN: "iban|account|bank|konto|compte|cuenta",
    NATIONAL_ID: "ssn|social|security|identity|national|tax",
    LOCAL_PHONE: "phone|call|tel|mobile|fax|anruf|appel|llam",
}
CHECKED = {CARD, IBAN}
CONTEXT, CONTEXT_WORTH, CHECKSUM_WORTH, LEAST = 40, 0.3, 0.4, 0.65


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""

    def step(state: Column, digit: Column) -> Column:
        n = digit.cast("int")
        twice = n * 2 - F.when(n > 4, 9).otherwise(0)
        return F.struct((state["sum"] + F.when(state["double"], twice).otherwise(n)).alias("sum"), (~state["double"]).alias("double"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("double"))
    return F.aggregate(F.reverse(F.split(digits, "")), start, step, lambda s: s["sum"] % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check: its first four characters go to the end."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))

    def step(state: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        return F.when(code < 58, (state * 10 + code - 48) % 97).otherwise((state * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _is_card(match: Column) -> Column:
    return F.when(F.length(_digits(match)) <= 19, luhn(_digits(match))).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """The spans of the four base rules; a match that fails its check is dropped, not tried again inside."""
    return F.concat(
        found(text, EMAIL, EMAIL_PATTERN, "@"),
        found(text, IP, IP_PATTERN, r"[0-9]\.[0-9]", lambda m: F.regexp(m, F.lit(IP_VALUE))),
        found(text, CARD, CARD_PATTERN, keep=_is_card),
        found(text, PHONE, PHONE_PATTERN, r"\+[0-9]", lambda m: F.length(_digits(m)).between(9, 15)),
    )


def proposed_spans(text: Column) -> Column:
    """The spans of the further kinds, checksums passed; context has yet to speak."""
    iban = found(text, IBAN, IBAN_PATTERN, r"[A-Z]{2}[0-9]{2}", lambda m: mod97(F.regexp_replace(m, " ", "")))
    return F.concat(iban, found(text, NATIONAL_ID, NATIONAL_ID_PATTERN), found(text, LOCAL_PHONE, LOCAL_PHONE_PATTERN))


def _by_kind(values: dict, kind: Column, default) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(values.get(k, default)) for k in range(len(KINDS))]), kind), F.lit(default))


def scored(text: Column, spans: Column) -> Column:
    """The spans with score: pattern, checksum and context words on either side.

    Context is taken from the text in four bytes a character, where a place is found without a walk from the start.
    """

    def score(wide: Column, s: Column) -> Column:
        part = lambda start, n: F.decode(F.substring(wide, 4 * start + 1, 4 * n), "UTF-32")
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        around = F.lower(F.concat(part(first, s["start"] - first), F.lit(" "), part(s["end"], F.lit(CONTEXT))))
        context = F.lit(False)
        for kind, words in NEAR.items():
            context = context | ((s["kind"] == kind) & F.regexp(around, F.lit(words)))
        checksum = s["kind"].isin(*CHECKED)
        return _by_kind(WORTH, s["kind"], 0.0) + F.when(checksum, CHECKSUM_WORTH).otherwise(0.0) + F.when(context, CONTEXT_WORTH).otherwise(0.0)

    def all_scored(wide: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(*[s[k].alias(k) for k in ("kind", "start", "end", "match")], F.least(score(wide, s), F.lit(1.0)).alias("score")))

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-32"), all_scored)).otherwise(all_scored(F.lit(b"")))


def findings(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, base and added, arrays of (kind, start, end, match, score)."""
    body = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    rows = body.select("doc_id", "text", base_spans(F.col("text")).alias("base"), proposed_spans(F.col("text")).alias("proposed"))
    rows = rows.select("doc_id", scored(F.col("text"), F.col("base")).alias("base"), scored(F.col("text"), apart(F.col("proposed"), F.col("base"))).alias("proposed"))
    return rows.select("doc_id", "base", F.filter("proposed", lambda s: s["score"] >= least).alias("added"))


def report(rows: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of the rows that `findings` gives."""
    counts = [count_of(F.col("base"), kind).alias(f"n_{KINDS[kind]}") for kind in (EMAIL, IP, CARD, PHONE)]
    digest = F.sha2(written(F.col("base"), KINDS, by_start=False).cast("binary"), 256)
    every = written(F.concat("base", "added"), KINDS, by_start=False)
    return rows.select("doc_id", *counts, digest.alias("base_sha256"), every.alias("spans"), F.size("added").cast("long").alias("n_added"))
