"""Derived inputs, as SQL that Spark and the oracle both run."""

from __future__ import annotations

# A text with one value of each kind, built from a customer key k and its SHA-256 h; D(i, m) is a number below m from
# the four hex digits of h that begin at the i-th; L pads a number, S writes it.
TEXTS = (
    ("EMAIL", "en-US", "'write to c' || k || '.' || substr(h, 1, 5) || '@post.example.net soon'"),
    ("PHONE", "en-US", "'ring ' || L(201 + D(3, 790), 3) || '.' || L(211 + D(9, 780), 3) || '.' || L(D(15, 10000), 4) || ' today'"),
    ("SSN", "en-US", "'number ' || L(1 + D(5, 660), 3) || ' ' || L(1 + D(11, 99), 2) || ' ' || L(1 + D(17, 9999), 4) || ' on file'"),
    ("CREDIT_CARD", "en-US", "'paid by 5500 0000 0000 0004 then'"),
    ("IP_V4", "en-US", "'host ' || S(n % 223 + 1) || '.10.' || S(n % 256) || '.7 up'"),
    ("IP_V6", "en-US", "'addr 2001:db8::' || S(n % 9999 + 1) || ' up'"),
    ("OPENAI_API_KEY", "en-US", "'key sk-' || substr(h, 1, 40) || ' end'"),
    ("AWS_ACCESS_KEY", "en-US", "'id AKIA' || upper(substr(h, 1, 16)) || ' end'"),
    ("AWS_SECRET_KEY", "en-US", "'aws_secret_key=' || substr(h, 1, 40) || ' end'"),
    ("GITHUB_PAT", "en-US", "'tok ghp_' || substr(h, 1, 36) || ' end'"),
    ("BEARER_TOKEN", "en-US", "'auth Bearer ' || substr(h, 1, 32) || ' end'"),
    ("SSH_PRIVATE_KEY", "en-US", "'-----BEGIN RSA PRIVATE KEY----- body'"),
    ("DB_CONNECTION_STRING", "en-US", "'dsn postgres://u' || k || ':pw@db.example.com/x end'"),
    ("URL_WITH_CREDS", "en-US", "'see https://u' || k || ':pw@git.example.com/r end'"),
    ("UK_NIN", "en_GB", "'nin AB ' || L(n % 100, 2) || ' 34 56 C end'"),
    ("DE_STEUER_ID", "de", "'id ' || S(10000000000 + n) || ' end'"),
    ("FR_INSEE", "FR-fr", "'id ' || S(1000000000000 + n) || ' end'"),
    ("AADHAAR_NUMBER", "in", "'uid ' || L(2000 + n % 7000, 4) || ' 5678 9012 end'"),
    ("IN_PAN", "in-IN", "'pan ABCDE' || L(n % 10000, 4) || 'F end'"),
    ("KO_RRN", "ko", "'rrn 9' || L(n % 100000, 5) || '-1234567 end'"),
    ("KO_BRN", "ko-KR", "'brn 1' || L(n % 100, 2) || '-45-67890 end'"),
    ("CPF_NUMBER", "pt-br", "'cpf 529.982.247-25 end'"),
    ("BR_CNPJ", "br-BR", "'cnpj 12.' || L(n % 1000, 3) || '.678/0001-95 end'"),
)


def _expand(expression: str, string: str) -> str:
    out, i = "", 0
    while i < len(expression):
        if expression[i : i + 2] in ("L(", "S(", "D(") and (i == 0 or not (expression[i - 1].isalnum() or expression[i - 1] == "_")):
            depth, j = 1, i + 2
            while depth:
                depth += {"(": 1, ")": -1}.get(expression[j], 0)
                j += 1
            inside = expression[i + 2 : j - 1]
            value, _, last = inside.rpartition(",")
            if expression[i] == "S":
                out += f"CAST({_expand(inside, string)} AS {string})"
            elif expression[i] == "D":
                digits = [f"(instr('0123456789abcdef', substr(h, {int(value) + k}, 1)) - 1) * {16 ** (3 - k)}" for k in range(4)]
                out += f"(({' + '.join(digits)}) % {last.strip()})"
            else:
                out += f"lpad(CAST({_expand(value, string)} AS {string}), {last.strip()}, '0')"
            i = j
        else:
            out += expression[i]
            i += 1
    return out


def fixtures_sql(duck: bool) -> str:
    """(k, n, expected, locale, text): a row for each customer, the kinds in turn."""
    string, sha = ("VARCHAR", "sha256({})") if duck else ("STRING", "sha2({}, 256)")
    which = lambda i: " ".join(f"WHEN {j} THEN {v}" for j, v in enumerate(i))
    m = len(TEXTS)
    return (
        f"SELECT k, n, CASE n % {m} {which(repr(t[0]) for t in TEXTS)} END AS expected, CASE n % {m} {which(repr(t[1]) for t in TEXTS)} END AS locale, "
        f"CASE n % {m} {which(_expand(t[2], string) for t in TEXTS)} END AS text "
        f"FROM (SELECT CAST(c_custkey AS {string}) AS k, CAST(c_custkey AS BIGINT) AS n, {sha.format(f'CAST(c_custkey AS {string})')} AS h FROM customer) c"
    )


def messages_sql(duck: bool) -> str:
    """(conv_id, turn, role, text): conversations with personal data that repeats over turns."""
    s = "VARCHAR" if duck else "STRING"
    return (
        "SELECT conv_id, turn, role, text || CASE turn % 4 "
        f"WHEN 0 THEN ' write to m' || CAST(conv_id AS {s}) || '@post.example.net soon' "
        f"WHEN 1 THEN ' ring 628-555-' || lpad(CAST((conv_id * 31 + 47) % 10000 AS {s}), 4, '0') || ' today' "
        f"WHEN 2 THEN ' copy m' || CAST(conv_id AS {s}) || '@post.example.net from 172.' || CAST(16 + conv_id % 16 AS {s}) || '.' || CAST(conv_id % 251 AS {s}) || '.9 please' "
        "ELSE '' END AS text FROM conversations"
    )


def candidates_sql(duck: bool) -> str:
    """(grp, i, start, stop, confidence): made-up spans of two tiers, 2 to 7 to a group, that overlap now and then."""
    return (
        "SELECT o_custkey AS grp, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS i, "
        "CAST((o_orderkey * 7) % 60 AS INT) AS start, CAST((o_orderkey * 7) % 60 + 3 + o_orderkey % 9 AS INT) AS stop, "
        "CAST((o_orderkey * 3) % 10 AS DOUBLE) / 10 AS confidence FROM orders"
    )
