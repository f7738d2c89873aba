"""Personal data in fields: name hints, value patterns, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import UUID

# Hints by category, patterns, identifier words.
NAME_HINTS = {
    "email": ["email", "e_mail", "mail"],
    "phone": ["phone", "mobile", "tel", "contact_number"],
    "name": ["first_name", "last_name", "full_name", "passenger_name", "name"],
    "passport": ["passport", "document_number"],
    "card_number": ["card", "pan", "card_last_four", "card_number"],
    "ip_address": ["ip_address", "ip", "client_ip"],
    "date_of_birth": ["dob", "date_of_birth", "birth_date", "birthdate", "born", "birthday"],
    "loyalty_number": ["loyalty", "frequent_flyer", "rewards"],
    "national_id": ["ssn", "social_security", "social_security_number", "aadhaar", "aadhar"],
}
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
PASSPORT = r"\b[A-Z]{1,2}\d{7,9}\b"
IP = r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b"
DOB = r"\b\d{4}-\d{2}-\d{2}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
AADHAAR = r"\b\d{4}\s\d{4}\s\d{4}\b"
PHONES = (r"\+\d{1,3}[\s-]?\d{3,14}", r"\(\d{3}\)\s?\d{3}[\s-]?\d{4}", r"\b\d{3}[\s-]\d{3}[\s-]\d{4}\b")
ID_WORDS = ("id", "uuid", "ref", "key", "hash", "token", "code", "number")
CARD_WORDS = ("card", "pan", "credit", "debit")
DOB_WORDS = ("dob", "birth", "born", "birthday", "birthdate", "date_of_birth")
FIRST = 20  # string values looked at
NAME_ONLY, PATTERN_ONLY, BOTH = 0.6, 0.7, 0.95


def _whole(words, between: str) -> str:
    """A regex for any of the words as a whole part between separators."""
    return rf"(?:^|[{between}])(?:{'|'.join(words)})(?:[{between}]|$)"


def _path_has(path: Column, words, between: str = r"._\[\]") -> Column:
    return F.lower(path).rlike(_whole(words, between))


def is_id_field(path: Column) -> Column:
    return _path_has(path, ID_WORDS)


def _any_shows(path: Column, values: Column, category: str) -> Column:
    return F.exists(values, lambda v: value_hit(path, v, category))


def name_hit(path: Column, category: str) -> Column:
    """A hint of up to four characters must be a whole segment, others a part of one."""
    hints = NAME_HINTS.get(category, ())
    if not hints:
        return F.lit(False)
    short, long = [h for h in hints if len(h) <= 4], [h for h in hints if len(h) > 4]
    ways = ([_whole(short, r".\[\]")] if short else []) + long
    return F.lower(path).rlike("|".join(ways))


def looks_like_ip(v: Column) -> Column:
    octet = [F.regexp_extract(v, IP, k).try_cast("int") for k in (1, 2, 3, 4)]
    valid = v.rlike(IP) & (F.greatest(*octet) <= 255)
    a, b = octet[:2]
    special = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127) | ((a == 169) & (b == 254))
    return valid & (special | (F.greatest(*octet) > 100))


def looks_like_phone(v: Column) -> Column:
    out = F.lit(False)
    for p in PHONES:
        out = out | v.rlike(p)
    return out


def value_hit(path: Column, v: Column, category: str) -> Column:
    """Whether one string value shows the category in a field of this path."""
    if category == "card_number":
        ids = is_id_field(path) & ~_path_has(path, CARD_WORDS)
        return ~ids & v.rlike(CARD)
    if category == "date_of_birth":
        return v.rlike(DOB) & F.lower(path).rlike("|".join(DOB_WORDS))
    rules = {"email": v.rlike(EMAIL), "phone": looks_like_phone(v), "passport": v.rlike(PASSPORT), "ip_address": looks_like_ip(v), "national_id": v.rlike(SSN) | v.rlike(AADHAAR)}
    return rules.get(category, F.lit(False))


def detect(path: Column, strings: Column) -> Column:
    """array<struct<category, confidence, source>> of a field, by category.

    ``strings``: its first string values, in order.  An identifier field that
    holds only UUIDs has none."""
    few = F.slice(strings, 1, FIRST)
    found = []
    for c in sorted(NAME_HINTS):
        by_name, by_value = name_hit(path, c), _any_shows(path, few, c)
        conf = F.when(by_name & by_value, BOTH).when(by_name, NAME_ONLY).when(by_value, PATTERN_ONLY)
        source = F.when(by_name & by_value, "both").when(by_name, "name_hint").when(by_value, "pattern")
        found.append(F.when(conf.isNotNull(), F.struct(F.lit(c).alias("category"), conf.alias("confidence"), source.alias("source"))))
    only_uuids = is_id_field(path) & (F.size(few) > 0) & F.forall(few, lambda v: v.rlike(UUID))
    return F.when(only_uuids, F.array().cast("array<struct<category:string,confidence:double,source:string>>")).otherwise(F.array_compact(F.array(*found)))


def categories(detected: Column) -> Column:
    return F.transform(detected, lambda d: d["category"])


def pseudonym(category: Column, original: Column) -> Column:
    """A stable stand-in of the value's shape: letters and digits are replaced by
    ones drawn from the value's SHA-256; other characters, and an e-mail's form,
    stay.  The same value always gets the same stand-in."""
    digest = F.sha2(original, 256)
    digits = F.translate(digest, "abcdef", "012345")
    number = F.aggregate(
        F.split(original, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda acc, ch: F.struct(
            F.concat(acc["out"], F.when(ch.rlike(r"^\d$"), F.substring(digits, F.pmod(acc["k"], F.lit(64)) + 1, F.lit(1))).otherwise(ch)).alias("out"),
            (acc["k"] + 1).alias("k"),
        ),
        lambda acc: acc["out"],
    )
    return (
        F.when(category == "email", F.concat(F.lit("user_"), F.substring(digest, 1, 8), F.lit("@example.com")))
        .when(category == "name", F.concat(F.lit("Person "), F.upper(F.substring(digest, 1, 4))))
        .when(category == "passport", F.concat(F.lit("X"), F.substring(digits, 1, 8)))
        .when(category == "date_of_birth", F.concat(F.lit("19"), F.lpad(F.pmod(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(100)).cast("string"), 2, "0"), F.lit("-01-01")))
        .when(category == "ip_address", F.concat_ws(".", F.lit("10"), *(F.conv(F.substring(digest, k, 2), 16, 10) for k in (1, 3, 5))))
        .when(category.isin("phone", "card_number", "national_id", "loyalty_number"), number)
        .otherwise(F.concat(F.lit("[REDACTED:"), F.substring(digest, 1, 8), F.lit("]")))
    )


def redact_samples(samples: Column, found: Column) -> Column:
    """Samples of a field, replaced as a whole if it has personal data."""
    return F.when(F.size(found) > 0, F.array(F.concat(F.lit("[REDACTED — pii: "), F.array_join(found, ", "), F.lit("]")))).otherwise(samples)


def mask_keys(text: Column) -> Column:
    """Log lines with API keys masked."""
    return F.regexp_replace(F.regexp_replace(text, r"sk-[A-Za-z0-9_-]{8,}", "sk-***"), r"(?i)(api[_-]?key\s*[=:]\s*)\S+", "$1***")
