"""Format-preserving surrogates, made from the conversation, the ordinal of the value, and a hash.

Numbers come from a place in the format's range: the ordinal times a multiplier without a common factor with
the range, moved by a hash of the conversation. So the surrogates of a conversation differ until the range is
used up, and keep their format. Other surrogates hold the ordinal. The expressions are SQL that Spark and the
oracle share; only hashing, hex, dates and names differ by dialect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the surrogates.
FIRST_NAMES = ("Adele", "Anton", "Berit", "Clara", "Dario", "Edith", "Emil", "Flora", "Gustav", "Hanna", "Ingrid", "Jonas", "Klara", "Leon", "Marta", "Nils", "Oskar", "Petra", "Ronja", "Stefan", "Tilda", "Urban", "Vera", "Willem")
LAST_NAMES = ("Ahlgren", "Bakker", "Castel", "Dupont", "Eriksen", "Fischer", "Gruber", "Hansen", "Iversen", "Jansen", "Keller", "Lindqvist", "Moreau", "Novak", "Olsen", "Petersen", "Rossi", "Schneider", "Tanaka", "Visser", "Weber", "Zimmer")
ORG_NAMES = ("Northwind Mills", "Blue Harbor Labs", "Cobalt Freight", "Juniper Foods", "Ridge and Vale", "Silverbrook Press", "Tidewater Tools", "Vantage Optics")
STREET_NAMES = ("Alder", "Bridge", "Canal", "Church", "Garden", "Harbor", "Linden", "Meadow", "Mill", "Orchard", "Station", "Willow")
STREET_SUFFIXES = ("Close", "Lane", "Path", "Row", "Square", "Street")
#: Has no factor in common with the ranges below, whose prime factors are 2, 3, 5, 11, 101, 127 and 283.
MULTIPLIER = 48271


@dataclass(frozen=True)
class Dialect:
    """How an engine hashes, reads and writes hexadecimal digits, names strings, adds days, tries a date, and binds a name."""

    sha: str
    number: str
    hexa: str
    string: str
    days: str
    date: str
    div: str
    bind: str

    def let(self, name: str, value: str, body: str) -> str:
        return self.bind.format(name=name, value=value, body=body)


SPARK = Dialect("sha2({}, 256)", "CAST(conv({}, 16, 10) AS BIGINT)", "lower(hex({}))", "STRING", "date_add({}, CAST({} AS INT))", "try_cast({} AS DATE)", "({} div {})", "element_at(transform(array({value}), {name} -> {body}), 1)")
DUCKDB = Dialect("sha256({})", "('0x' || {})::BIGINT", "lower(to_hex({}))", "VARCHAR", "({} + CAST({} AS INTEGER))", "TRY_CAST({} AS DATE)", "({} // {})", "list_transform([{value}], lambda {name}: {body})[1]")


def surrogate_sql(d: Dialect, conversation: str, ordinal: str, entity: str, original: str) -> str:
    """SQL of the surrogate of `original`, the ordinal-th value of the conversation.

    h, g, n, m, c and b are bound names: hash of conversation and ordinal, hash of the conversation, the ordinal.
    """
    text = lambda x: f"CAST({x} AS {d.string})"
    num = lambda at, size: d.number.format(f"substr(h, {at}, {size})")
    pad = lambda x, k: f"lpad({text(x)}, {k}, '0')"
    pick = lambda words, at: f"CASE {num(at, 6)} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w.replace(chr(39), chr(39) * 2)}'" for i, w in enumerate(words)) + " END"
    digit = lambda x, k: f"CAST(substr({x}, {k}, 1) AS INT)"
    key = lambda size: f"substr(h, 1, CAST(greatest({size} - length({text('n')}), 1) AS INT)) || {text('n')}"
    long = lambda least, less=0: f"CAST(greatest(length({original}) - {less}, {least}) AS INT)"
    first, last = pick(FIRST_NAMES, 1), pick(LAST_NAMES, 7)
    doubled = " + ".join(f"(CASE WHEN {digit('c', k)} > 4 THEN {digit('c', k)} * 2 - 9 ELSE {digit('c', k)} * 2 END)" if k % 2 else digit("c", k) for k in range(1, 16))
    moved = d.number.format("substr(g, 1, 12)")
    place = lambda size: f"((n % {size} * {MULTIPLIER} % {size} + {moved}) % {size})"
    part = lambda by, size: f"{d.div.format('m', by)} % {size}"
    with_place = lambda size, body: d.let("m", place(size), body)
    card = f"substr(regexp_extract({original}, '[0-9]', 0) || '4', 1, 1) || {pad(place(10**14 // 10**3), 11)} || {pad(f'{num(1, 6)} % 1000', 3)}"
    born = d.date.format(f"CASE WHEN regexp_like({original}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN {original} END") if d is SPARK else d.date.format(f"CASE WHEN regexp_matches({original}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN {original} END")
    code = f"regexp_extract({original}, '^([+][0-9]{{1,3}}) ', 1)"
    check = lambda terms: f"(CASE WHEN ({terms}) % 11 < 2 THEN 0 ELSE 11 - ({terms}) % 11 END)"
    one = check(" + ".join(f"{digit('b', i)} * {11 - i}" for i in range(1, 10)))
    two = check(" + ".join(f"{digit('b', i)} * {12 - i}" for i in range(1, 11)))
    cpf = d.let("b", pad(place(10**9), 9), d.let("b", f"b || {text(one)}", f"substr(b, 1, 3) || '.' || substr(b, 4, 3) || '.' || substr(b, 7, 3) || '-' || substr(b, 10, 1) || {text(two)}"))
    at = f"instr({original}, '://')"
    scheme = f"CASE WHEN {at} < 1 THEN 'db' ELSE substr({original}, 1, CAST({at} - 1 AS INT)) END"
    host = f"substr({original}, CAST(length({original}) - instr(reverse({original}), '@') + 2 AS INT))"
    cases = {
        "EMAIL": f"lower({first}) || '.' || lower({last}) || {text('n')} || '@example.com'",
        "PHONE": f"CASE WHEN {code} <> '' THEN {code} || ' ' ELSE '' END || " + with_place(10**8, f"'555-' || {pad(part(10**4, 10**4), 4)} || '-' || {pad('m % 10000', 4)}"),
        "SSN": with_place(566 * 99 * 9999, f"{text(f'100 + {part(99 * 9999, 566)}')} || '-' || {pad(f'1 + {part(9999, 99)}', 2)} || '-' || {pad('1 + m % 9999', 4)}"),
        "CREDIT_CARD": d.let("c", card, f"c || {text(f'(10 - ({doubled}) % 10) % 10')}"),
        "IP_V4": with_place(256 * 256 * 254, f"'10.' || {text(part(256 * 254, 256))} || '.' || {text(part(254, 256))} || '.' || {text('m % 254 + 1')}"),
        "IP_V6": with_place(2**32, d.let("m", f"lpad({d.hexa.format('m')}, 8, '0')", "'fd' || substr(m, 1, 4) || ':' || substr(m, 5, 4) || '::1'")),
        "OPENAI_API_KEY": f"'sk-' || {key(long(32, 3))}",
        "GITHUB_PAT": f"'ghp_' || {key(long(32, 4))}",
        "AWS_ACCESS_KEY": f"'AKIAIOSFODNN7' || upper({key('12')})",
        "AWS_SECRET_KEY": key("40"),
        "BEARER_TOKEN": key(long(32)),
        "SSH_PRIVATE_KEY": f"'[REDACTED_PRIVATE_KEY_' || {text('n')} || ']'",
        "DB_CONNECTION_STRING": f"{scheme} || '://user' || {text('n')} || ':redacted@db.example.com/db'",
        "URL_WITH_CREDS": f"{scheme} || '://user' || {text('n')} || ':redacted@' || {host}",
        "PERSON_NAME": f"{first} || ' ' || {last} || ' ' || {text('n')}",
        "ORG_NAME": f"{pick(ORG_NAMES, 1)} || ' ' || {text('n')}",
        "ADDRESS": f"{text('n')} || ' ' || {pick(STREET_NAMES, 1)} || ' ' || {pick(STREET_SUFFIXES, 7)}",
        # A date moves by as many days as the others of the conversation, so different dates stay different.
        "DATE_OF_BIRTH": f"CAST(coalesce({d.days.format(born, f'7 + {moved} % 91')}, {d.days.format(chr(68) + 'ATE ' + repr('1900-01-01'), f'{place(14600)}')}) AS {d.string})",
        "AADHAAR_NUMBER": with_place(8000 * 10**8, f"{text(f'2000 + {part(10**8, 8000)}')} || ' ' || {pad(part(10**4, 10**4), 4)} || ' ' || {pad('m % 10000', 4)}"),
        "CPF_NUMBER": cpf,
    }
    body = f"CASE {entity} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {key(long(8))} END"
    seed = f"{text(conversation)} || ':' || {text(ordinal)}"
    return d.let("h", d.sha.format(seed), d.let("g", d.sha.format(text(conversation)), d.let("n", f"CAST({ordinal} AS BIGINT)", body)))


def surrogate(conversation: str, ordinal: str, entity: str, original: str) -> Column:
    """The surrogate as a column; arguments are SQL expressions over the columns of the DataFrame."""
    return F.expr(surrogate_sql(SPARK, conversation, ordinal, entity, original))


def stateless_sql(d: Dialect, kind: str, original: str) -> str:
    """A surrogate that depends on the string and its kind (of detect.classify) alone."""
    text = lambda x: f"CAST({x} AS {d.string})"
    num = lambda size: d.number.format(f"substr(h, 1, {size})")
    four = f"lpad({text(f'{num(4)} % 10000')}, 4, '0')"
    name = lambda words, size: f"CASE {num(size)} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"
    cases = {
        "person_name": f"{name(FIRST_NAMES, 6)} || ' ' || {name(LAST_NAMES, 8)}",
        "email": "'redacted' || substr(h, 1, 4) || '@example.com'",
        "phone": f"'555-000-' || {four}",
        "address": f"{text(f'{num(2)} % 90 + 10')} || ' Redacted St, Anytown'",
        "ssn": f"'000-00-' || {four}",
        "credit_card": f"'4000-0000-0000-' || {four}",
        "api_key": "'[REDACTED-KEY-' || substr(h, 1, 6) || ']'",
        "password": "'[REDACTED-PASSWORD]'",
    }
    return d.let("h", d.sha.format(original), f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + " ELSE '[REDACTED]' END")


def stateless(kind: str, original: str) -> Column:
    """The stateless surrogate as a column; arguments are SQL expressions."""
    return F.expr(stateless_sql(SPARK, kind, original))
