"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._shared import joined, spans_of

# The patterns give the leftmost non-overlapping matches of the plain forms named in the comments; possessive
# repeats and a start that is not inside a run (or is where the last match ended) keep them linear on long runs.
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Countries by the length of their account codes; other countries' codes may have 15 to 34 characters.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_FIXED = [rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()]
_OTHER = rf"(?!{'|'.join(IBAN_LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
IBAN = rf"(?<![A-Za-z0-9])(?:{'|'.join([*_FIXED, _OTHER])})(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
BASE = ("email", "ip", "card", "phone")
#: Score without context, words that raise it, and the score that an added span needs (base spans always stay).
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "national": 0.2}
CONTEXT = {
    "email": "mail|contact|write|kontakt|schreib|courriel|correo|écri|escrib", "ip": r"\bip\b|address|host|server|adresse|dirección|serveur|servidor",
    "card": "card|visa|master|amex|credit|debit|payment|karte|zahlung|carte|paiement|tarjeta|pago",
    "phone": "phone|tel|call|mobile|fax|ruf|handy|appel|portable|llama|móvil",
    "iban": "iban|account|bank|transfer|konto|überweis|compte|banque|virement|cuenta|banco",
    "national": r"\bssn\b|social|security|national|identity|sozial|ausweis|identité|sécurité|seguridad|identidad",
}
CONTEXT_GAIN, KEEP_AT, CONTEXT_SPAN = 0.4, 0.5, 40


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return acc + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code with its four leading characters moved to the end is 1 modulo 97."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def add(acc: Column, ch: Column) -> Column:
        return F.when(ch.between("0", "9"), acc * 10 + ch.cast("int")).otherwise(acc * 100 + F.ascii(ch) - 55) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card(v: Column) -> Column:
    d = _digits(v)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


def _scored(kind: str, place: int):
    def score(s: Column) -> Column:
        near = F.lower(s["near"]).rlike(CONTEXT[kind])
        total = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0))
        return F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end"), total.alias("score"))

    return score


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def findings(text: Column) -> Column:
    """Array of (start, place, kind, end, score), base kinds first in place; added kinds only with score >= 0.5."""
    t = F.coalesce(text, F.lit(""))
    rules = [
        ("email", EMAIL, lambda v: F.lit(True), F.contains(t, F.lit("@"))),
        ("ip", IP, lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), t.rlike(r"[0-9]\.[0-9]")),
        ("card", CARD, _card, t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
        ("phone", PHONE, lambda v: F.length(_digits(v)).between(9, 15), t.rlike(r"\+[0-9]")),
        ("iban", IBAN, mod97, t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]")),
        ("national", NATIONAL, lambda v: F.lit(True), t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    ]
    all_kinds = []
    for place, (kind, pattern, accept, gate) in enumerate(rules):
        found = spans_of(t, pattern, accept, gate, CONTEXT_SPAN)

        spans = F.transform(found, _scored(kind, place))
        all_kinds.append(spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= KEEP_AT))
    return F.concat(*all_kinds)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and `findings` of every row's whole text, however long. Null and empty texts have none; rows are neither merged
    nor dropped, repeated ones scanned each; other columns are not read; an empty table gives an empty result."""
    return docs.select("doc_id", findings(F.col("text")).alias("findings"))


def digest_columns(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts per base kind, the hash of the base spans, all spans and their scores, from (doc_id, findings)."""
    own = F.filter("findings", lambda s: s["kind"].isin(*base))
    counts = [F.size(F.filter("findings", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), F.transform(F.array_sort("findings"), lambda s: F.round(s["score"], 6)).alias("scores"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")), BASE)
