"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only.

Kinds: email, ip, card (Luhn) and phone, which are always reported, with a score; and kinds that are reported from a score of
CUTOFF on: iban (mod 97), ssn (number ranges), birth (a date of birth) and national (a national phone number). An iban's
checksum is evidence enough unless the words around it name an example; the others look like any number or date, so only a
word of their list within WINDOW code points lifts them over the cutoff. A word of EXAMPLES takes EXAMPLE off any score.

Null and empty texts have no spans; repeated rows are rows of their own; other columns of docs, whatever their names, aren't
read. Possessive quantifiers keep each pattern linear and off the stack on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.llm.spans import digest, find_spans

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn", "birth", "national"]
KINDS = [*BASE, *ADDED]
CUTOFF, EXAMPLE = 0.6, 0.3
EXAMPLES = "example|sample|dummy|fictitious|beispiel|ejemplo|exemple"
#: Score without and with a word from the list nearby.
SCORES = {"email": (0.9, 1.0), "ip": (0.5, 0.8), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.7, 1.0), "ssn": (0.4, 0.9), "birth": (0.2, 0.8), "national": (0.2, 0.7)}
WORDS = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "address|adresse|server|host|ip",
    "card": "card|visa|credit|carte|tarjeta|karte",
    "phone": "tel|phone|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security",
    "birth": "born|birth|dob\\b|geboren|geburtsdatum|nacid[oa]|nacimiento|née? le|naissance",
    "national": "tel\\b|tel[.:é]|phone|call|mobile|fax|telefon|handy|móvil|appele[rz]",
}
WINDOW = 40


def patterns(text: str) -> dict[str, tuple[Column, str]]:
    t = F.col(text)
    local, label = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
    return {
        # \G: a match may begin where the last one ended, inside a run of the same characters
        "email": (F.contains(t, F.lit("@")), rf"(?:\G|(?<!{local})){local}++@{label}++(?:\.{label}++)++"),
        "ip": (F.contains(t, F.lit(".")), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        "card": (t.rlike("[0-9][0-9 -]{11}"), r"[0-9](?:[ -]?[0-9])++"),
        "phone": (F.contains(t, F.lit("+")), r"\+[0-9][ ().0-9-]+[0-9]"),
        "iban": (t.rlike("[A-Z][A-Z][0-9][0-9]"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![A-Za-z0-9])"),
        "ssn": (t.rlike("[0-9]-[0-9]{2}-[0-9]"), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        "birth": (t.rlike("[0-9][./-][0-9]{1,2}[./-][0-9]"), r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9-])"),
        "national": (t.rlike("[0-9][)./ -]"), r"(?<![0-9+().-])(?<![0-9+] )\(?0?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{2,5}(?![0-9-])"),
    }


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(digits)

    def add(total, i):
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, value: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": F.when(n.between(13, 19), luhn(_digits(value))).otherwise(F.lit(False)),
        "phone": n.between(9, 15),
        "ssn": ~value.rlike("^(?:000|666|9)|-00-|-0000$"),
        "birth": value.rlike(r"^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-]|^(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/|^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$"),
        "national": n.between(9, 12),
        "iban": F.when(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34), mod97(value)).otherwise(F.lit(False)),
    }[kind]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text, and findings: array of (kind, start, end, value, score) by kind and place."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = find_spans(df, "text", patterns("text"))

    def scored(kind: str) -> Column:
        def one(s):
            from_ = F.greatest(s["start"] - WINDOW, F.lit(0))
            around = F.lower(F.concat(F.substring(F.col("text"), (from_ + 1).cast("int"), (s["start"] - from_).cast("int")), F.lit(" "), F.substring(F.col("text"), (s["end"] + 1).cast("int"), F.lit(WINDOW))))
            low, high = SCORES[kind]
            return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), (F.when(around.rlike(rf"(?U)\b(?:{WORDS[kind]})"), F.lit(high)).otherwise(F.lit(low)) - F.when(around.rlike(rf"(?U)\b(?:{EXAMPLES})"), F.lit(EXAMPLE)).otherwise(F.lit(0.0))).alias("score"))

        return F.transform(F.filter(f"_spans_{kind}", lambda s: _valid(kind, s["value"])), one)

    df = df.withColumns({f"_f_{k}": scored(k) for k in KINDS})
    base = F.concat(*[F.col(f"_f_{k}") for k in BASE])
    return df.select("doc_id", "text", F.concat(base, *[F.filter(f"_f_{k}", lambda s: s["score"] >= CUTOFF - 1e-9) for k in ADDED]).alias("findings"))


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, the numbers of the added kinds and scores, one row per document."""
    found = find_personal_data(docs).select("doc_id", "findings")
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(digest(F.filter("findings", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), digest(F.col("findings")).alias("spans"),
        *[count(k).alias(f"n_{k}") for k in ADDED], F.array_join(F.transform("findings", lambda s: F.round(s["score"], 1).cast("string")), ",").alias("scores"),
    )
