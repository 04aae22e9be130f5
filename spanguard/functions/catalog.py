"""The prioritized pattern catalogue. Order is semantics: an earlier pattern claims its span first."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """label, regular expression, literals and simpler expressions of which a text must hold one, validator.

    Without literals and simpler expressions every text is searched.
    """

    label: str
    regex: str
    needs: tuple[str, ...] = ()
    validator: str | None = None
    guards: tuple[str, ...] = ()


#: What numbers in groups hold, as a test that is faster than their patterns.
_GROUPED = ("[0-9]{3}[)]?[-. \\t\\n\\x0B\\f\\r]",)
_FOUR = ("[0-9]{4}[- \\t\\n\\x0B\\f\\r]?[0-9]{4}",)


# Labels and patterns of the universal catalogue, in priority order.
UNIVERSAL = (
    Pattern("DB_CONNECTION_STRING", r"(?i)(?:postgres|postgresql|mysql|mariadb|mongodb|redis|amqp)://[^:\s]+:[^@\s]+@[^\s]+", ("://",)),
    Pattern("URL_WITH_CREDS", r"https?://[^:\s]+:[^@\s]+@[^\s]+", ("://",)),
    Pattern("SSH_PRIVATE_KEY", r"-----BEGIN (?:RSA|EC|OPENSSH|DSA|PGP) PRIVATE KEY-----", ("-----BEGIN",)),
    Pattern("BEARER_TOKEN", r"Bearer [A-Za-z0-9._~+/=\-]{20,}", ("Bearer ",)),
    Pattern("GITHUB_PAT", r"ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{82}", ("ghp_", "github_pat_")),
    Pattern("AWS_SECRET_KEY", r"""(?i)aws.{0,20}secret.{0,10}[=:\s]['"]?([A-Za-z0-9/+]{40})""", ("aws", "AWS", "Aws", "aWs", "awS", "AWs", "AwS", "aWS")),
    Pattern("AWS_ACCESS_KEY", r"AKIA[0-9A-Z]{16}", ("AKIA",)),
    Pattern("OPENAI_API_KEY", r"sk-[A-Za-z0-9]{20,100}", ("sk-",)),
    Pattern("IP_V6", r"(?<![:\w])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![:\w])|(?<![:\w])(?:[0-9a-fA-F]{1,4}:){1,7}:[0-9a-fA-F:]*(?![:\w])|(?<![:\w])::[0-9a-fA-F:]*(?![:\w])", ("::",), "ipv6", ("[0-9a-fA-F]:[0-9a-fA-F]{1,4}:",)),
    Pattern("IP_V4", r"(?<!\d)(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?!\d)", (), None, ("[0-9][.][0-9]",)),
    Pattern("CREDIT_CARD", r"(?<!\d)(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6011|65\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}(?:\d{3})?(?!\d)", (), "luhn", _FOUR),
    Pattern("SSN", r"(?<!\d)(?!000|666|9\d\d)\d{3}[-\s](?!00)\d{2}[-\s](?!0000)\d{4}(?!\d)", (), None, _GROUPED),
    Pattern("PHONE", r"(?:\+1[\s\-.]?)?\(?\d{3}\)?[\s\-.](?:\d{3})[\s\-.](\d{4})", (), None, _GROUPED),
    Pattern("EMAIL", r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", ("@",)),
)

# Patterns that a locale adds after the universal ones.
LOCALES = {
    "en-US": (),
    "en-GB": (Pattern("UK_NIN", r"(?i)[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]"),),
    "de-DE": (Pattern("DE_STEUER_ID", r"(?<!\d)[1-9]\d{10}(?!\d)"),),
    "fr-FR": (Pattern("FR_INSEE", r"(?<!\d)[12]\d{12}(?!\d)"),),
    "in-IN": (Pattern("AADHAAR_NUMBER", r"\d{4}\s\d{4}\s\d{4}"), Pattern("IN_PAN", r"[A-Z]{5}[0-9]{4}[A-Z]")),
    "ko-KR": (Pattern("KO_RRN", r"\d{6}-[1-4]\d{6}"), Pattern("KO_BRN", r"\d{3}-\d{2}-\d{5}")),
    "br-BR": (Pattern("CPF_NUMBER", r"\d{3}\.\d{3}\.\d{3}-\d{2}", (), "cpf"), Pattern("BR_CNPJ", r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}")),
}

# Other names of the locales.
LOCALE_NAMES = {
    "en-us": "en-US", "en": "en-US", "en-gb": "en-GB", "de-de": "de-DE", "de": "de-DE", "fr-fr": "fr-FR", "fr": "fr-FR",
    "in-in": "in-IN", "in": "in-IN", "ko-kr": "ko-KR", "ko": "ko-KR", "br-br": "br-BR", "pt-br": "br-BR",
}

# Labels without a pattern of their own; model tiers give them.
MODEL_LABELS = ("PERSON_NAME", "ORG_NAME", "ADDRESS", "DATE_OF_BIRTH", "MEDICAL_RECORD", "PASSPORT_NUMBER", "DRIVERS_LICENSE", "FINANCIAL_ACCOUNT")
NER_LABELS = {"person name": "PERSON_NAME", "organization": "ORG_NAME", "location": "ADDRESS", "date of birth": "DATE_OF_BIRTH", "address": "ADDRESS"}
