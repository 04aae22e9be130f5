"""Oracle SQL of the registered queries, for DuckDB over the same Parquet tables."""

from __future__ import annotations

from ..functions import catalog, tokens
from ..functions.synth import DUCKDB, surrogate_sql
from .fixtures import candidates_sql, fixtures_sql, messages_sql

# RE2 has no look-around: a consumed character before, a test of the one after, and checks of the match.
_FORMS = {
    "IP_V6": (r"(?:^|[^:0-9A-Za-z_])", r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:[0-9a-fA-F:]*|::[0-9a-fA-F:]*", r"[:0-9A-Za-z_]"),
    "IP_V4": (r"(?:^|[^0-9])", r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)", r"[0-9]"),
    "CREDIT_CARD": (r"(?:^|[^0-9])", r"(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6011|65\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}(?:\d{3})?", r"[0-9]"),
    "SSN": (r"(?:^|[^0-9])", r"\d{3}[-\s]\d{2}[-\s]\d{4}", r"[0-9]"),
    "DE_STEUER_ID": (r"(?:^|[^0-9])", r"[1-9]\d{10}", r"[0-9]"),
    "FR_INSEE": (r"(?:^|[^0-9])", r"[12]\d{12}", r"[0-9]"),
}


def luhn(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    digit = f"substr({d}, i::INT, 1)::INT"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN (CASE WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END) ELSE {digit} END)) % 10 = 0)"


def ipv6(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ':', '')) >= 2 AND len(list_filter(string_split({x}, ':'), lambda g: length(g) > 4)) = 0)"


def cpf(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    check = lambda n: f"(CASE WHEN list_sum(list_transform(range(1, {n + 1}), lambda i: substr({d}, i::INT, 1)::INT * ({n + 2} - i))) % 11 < 2 THEN 0 ELSE 11 - list_sum(list_transform(range(1, {n + 1}), lambda i: substr({d}, i::INT, 1)::INT * ({n + 2} - i))) % 11 END)"
    return f"(length({d}) = 11 AND {d} <> repeat(substr({d}, 1, 1), 11) AND substr({d}, 10, 1)::INT = {check(9)} AND substr({d}, 11, 1)::INT = {check(10)})"


_CHECKS = {"luhn": luhn, "ipv6": ipv6, "cpf": cpf}


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _matches(rel: str, keys: str, where: str, prio: int, p: catalog.Pattern) -> str:
    lead, body, after = _FORMS.get(p.label, ("", p.regex, None))
    flag, body = ("(?i)", body[4:]) if body.startswith("(?i)") else ("", body)
    whole = _quote(f"{flag}{lead}({body})")
    tests = ["TRUE"]
    if after:
        tests.append(f"NOT regexp_matches(nxt, '^{after}')")
    if p.validator:
        tests.append(_CHECKS[p.validator]("hit"))
    if p.label == "SSN":
        tests.append(r"NOT regexp_matches(hit, '^(000|666|9)') AND substr(hit, 5, 2) <> '00' AND substr(hit, 8, 4) <> '0000'")
    cond = f"regexp_matches(text, {whole})" + (f" AND {where}" if where else "")
    return (
        f"SELECT {keys}, {prio} AS prio, '{p.label}' AS entity, (pos + length(w) - length(hit))::INT AS start, (pos + length(w))::INT AS stop, hit FROM ("
        f"SELECT {keys}, w, hit, pos, substr(text, (pos + length(w) + 1)::INT, 1) AS nxt FROM ("
        f"SELECT {keys}, text, m[i] AS w, h[i] AS hit, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS pos FROM ("
        f"SELECT {keys}, text, m, h, g, unnest(range(1, len(m) + 1)) AS i FROM ("
        f"SELECT {keys}, text, regexp_extract_all(text, {whole}, 0) AS m, regexp_extract_all(text, {whole}, 1) AS h, string_split_regex(text, {whole}) AS g FROM {rel} WHERE {cond})))) "
        f"WHERE {' AND '.join(tests)}"
    )


_LOCALE = "(CASE " + " ".join(f"WHEN replace(lower(locale), '_', '-') = '{a}' THEN '{b}'" for a, b in catalog.LOCALE_NAMES.items()) + " ELSE 'en-US' END)"


def detected(rel: str, keys: str, locale: bool = False) -> str:
    """CTEs `cand` (all matches) and `hits` (a match that overlaps one of an earlier pattern goes)."""
    first = keys.split(",")
    parts = [_matches(rel, keys, "", i, p) for i, p in enumerate(catalog.UNIVERSAL)]
    if locale:
        n = len(parts)
        for where, pack in catalog.LOCALES.items():
            for p in pack:
                parts.append(_matches(rel, keys, f"{_LOCALE} = '{where}'", n, p))
                n += 1
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in first)
    return f"cand AS ({' UNION ALL '.join(parts)}), hits AS (SELECT * FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE {same} AND b.prio < a.prio AND a.start < b.stop AND b.start < a.stop))"


_FIX = f"fix AS ({fixtures_sql(True)})"
_MSG = f"msg AS ({messages_sql(True)})"
_HITS = f"{_MSG}, {detected('msg', 'conv_id, turn')}"


def _token(conv: str, n: str) -> str:
    number = f"('0x' || substr(sha256({conv}::VARCHAR || ':' || {n}::VARCHAR), 1, 12))::BIGINT"
    return " || ".join(f"substr('{tokens.BASE62}', (({number} // {62**i}) % 62 + 1)::INT, 1)" for i in range(7, -1, -1))


_VAULT = (
    f"{_HITS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY conv_id, hit ORDER BY turn, start, entity) AS k FROM hits), "
    f"ranked AS (SELECT conv_id, hit AS original, entity, row_number() OVER (PARTITION BY conv_id ORDER BY turn, start, hit) - 1 AS ordinal FROM firsts WHERE k = 1), "
    f"vault AS (SELECT conv_id, original, entity, ordinal, {surrogate_sql(DUCKDB, 'conv_id', 'ordinal', 'entity', 'original')} AS synthetic, {_token('conv_id', 'ordinal')} AS token_id FROM ranked)"
)


def _masked(rel: str, keys: str, source: str, value: str, join: str = "") -> str:
    """CTE `masked`: text with every hit replaced by `value`."""
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"t.{k} = p.{k}" for k in names)
    cols = ", ".join(f"t.{k}" for k in names)
    hcols = ", ".join(f"h.{k}" for k in names)
    return (
        f"pieces AS (SELECT {hcols}, h.start, h.stop, {value} AS v, lag(h.stop, 1, 0) OVER (PARTITION BY {hcols} ORDER BY h.start) AS before FROM hits h {join}), "
        f"put AS (SELECT {cols.replace('t.', 'p.')}, string_agg(substr(t.text, p.before + 1, p.start - p.before) || p.v, '' ORDER BY p.start) AS head, max(p.stop) AS last, count(*) AS n FROM pieces p JOIN {rel} t ON {same} GROUP BY {cols.replace('t.', 'p.')}), "
        f"masked AS (SELECT {cols}, t.text, CASE WHEN p.n IS NULL THEN t.text ELSE p.head || substr(t.text, p.last + 1) END AS masked, coalesce(p.n, 0) AS n_spans FROM {rel} t LEFT JOIN put p ON {same})"
    )


_CAND = f"c AS ({candidates_sql(True)})"
_OVER = "a.start < b.stop AND b.start < a.stop"

SQL = {
    "pii_audit": f"WITH {detected('documents', 'doc_id')} SELECT source, entity, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM hits JOIN documents USING (doc_id) GROUP BY ALL",
    "t1_spans": f"WITH {detected('documents', 'doc_id')} SELECT doc_id, entity, start, stop, hit FROM hits",
    "t1_spans_by_locale": f"WITH {_FIX}, {detected('fix', 'n, expected', locale=True)} SELECT n, expected, entity, start, stop, hit FROM hits",
    "overlap_priority": f"WITH {_FIX}, {detected('fix', 'n')}, a AS (SELECT entity, count(*) AS n_candidates FROM cand GROUP BY entity), b AS (SELECT entity, count(*) AS n FROM hits GROUP BY entity) SELECT entity, n_candidates, coalesce(n, 0) AS n_accepted FROM a LEFT JOIN b USING (entity)",
    "luhn_validate": f"SELECT o_orderkey, {luhn('number')} AS valid FROM (SELECT o_orderkey, '4' || lpad(o_orderkey::VARCHAR, 14, '0') || ((o_orderkey * 7) % 10)::VARCHAR AS number FROM orders)",
    "ipv6_validate": f"SELECT c_custkey, {ipv6('t')} AS valid FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'fe80::' || c_custkey::VARCHAR WHEN 1 THEN 'a:' || c_custkey::VARCHAR ELSE 'crate::vault' || c_custkey::VARCHAR END AS t FROM customer)",
    "cpf_validate": f"SELECT c_custkey, {cpf('t')} AS valid FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '529.982.247-25' WHEN 1 THEN '111.111.111-11' ELSE '529.982.' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey * 7 % 100)::VARCHAR, 2, '0') END AS t FROM customer)",
    "merge_confidence": (
        f"WITH RECURSIVE {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY confidence DESC, CASE WHEN i::VARCHAR < '3' THEN 0 ELSE 1 END, i) AS k FROM c), "
        "f AS (SELECT grp, k, [{'a': start, 'b': stop, 'c': confidence}] AS acc FROM r WHERE k = 1 UNION ALL "
        "SELECT f.grp, r.k, CASE WHEN len(list_filter(f.acc, lambda x: x.a < r.stop AND r.start < x.b)) > 0 THEN f.acc ELSE list_append(f.acc, {'a': r.start, 'b': r.stop, 'c': r.confidence}) END FROM f JOIN r ON r.grp = f.grp AND r.k = f.k + 1), "
        "l AS (SELECT grp, unnest(acc) AS s FROM f QUALIFY k = max(k) OVER (PARTITION BY grp)) SELECT grp, s.a AS start, s.b AS stop, s.c AS confidence FROM l"
    ),
    "exclusion_filter": f"WITH {_CAND} SELECT grp, start, stop FROM c a WHERE confidence < 0.8 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.grp = a.grp AND b.confidence >= 0.8 AND {_OVER})",
    "threshold_split": f"WITH {_CAND} SELECT grp, count(*) FILTER (confidence >= 0.7) AS n_sure, count(*) FILTER (confidence < 0.7) AS n_unsure FROM c GROUP BY grp",
    "slm_verdict_join": f"WITH {_CAND} SELECT grp, start, stop FROM c WHERE grp % 3 <> 0 OR i IN (0, 2)",
    "resolve_literals": (
        "WITH w AS (SELECT regexp_extract_all(text, 'the the|of the|the|on', 0) AS m, string_split_regex(text, 'the the|of the|the|on') AS g FROM conversations), "
        "u AS (SELECT m, g, unnest(range(1, len(m) + 1)) AS i FROM w) "
        "SELECT m[i] AS term, count(*) AS n, sum(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS sum_start FROM u GROUP BY m[i]"
    ),
    "classify_pii": (
        f"WITH {_FIX}, k AS (SELECT *, regexp_extract(text, '\\b[\\d\\s\\-\\(\\)\\.]{{7,}}\\b', 0) AS ph, regexp_extract(text, '\\b[A-Za-z0-9_\\-]{{20,}}\\b', 0) AS ke FROM fix) "
        "SELECT n, expected, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}') THEN 'email' WHEN regexp_matches(text, '\\b\\d{3}-\\d{2}-\\d{4}\\b') THEN 'ssn' "
        "WHEN regexp_matches(text, '\\b\\d{4}[\\s\\-]\\d{4}[\\s\\-]\\d{4}[\\s\\-]\\d{4}\\b') THEN 'credit_card' WHEN length(regexp_replace(ph, '[^0-9]', '', 'g')) >= 7 THEN 'phone' "
        "WHEN regexp_matches(ke, '[A-Z]') AND regexp_matches(ke, '[a-z]') AND regexp_matches(ke, '[0-9]') THEN 'api_key' "
        "WHEN len(regexp_extract_all(text, '\\b[A-Z][a-z]+\\b')) >= 2 AND NOT regexp_matches(text, '[0-9]') THEN 'person_name' ELSE 'other_pii' END AS kind FROM k"
    ),
    "token_ids": f"SELECT conv_id, turn, {_token('conv_id', 'turn')} AS token_id FROM conversations",
    "xml_tokens": f"WITH {_VAULT} SELECT conv_id, ordinal, '<pii id=\"' || token_id || '\">' || synthetic || '</pii>' AS token FROM vault",
    "vault_seeds": "WITH h AS (SELECT c_custkey, sha1(c_custkey::VARCHAR) AS h FROM customer) SELECT c_custkey, (" + " + ".join(f"('0x' || substr(h, {2 * i + 1}, 2))::HUGEINT * {256**i}::HUGEINT" for i in range(8)) + ")::VARCHAR AS seed FROM h",
    "vault_first_seen": f"WITH {_VAULT} SELECT conv_id, ordinal, original, entity FROM vault",
    "synth_format": f"WITH {_FIX} SELECT n, expected, {surrogate_sql(DUCKDB, 'f.n', '(f.n % 7)', 'expected', 'text')} AS synthetic FROM fix f",
    "mask_documents": f"WITH {detected('documents', 'doc_id')}, " + _masked("documents", "doc_id", "", "'[' || upper(h.entity) || ']'") + " SELECT doc_id, n_spans, sha256(masked) AS masked_sha256 FROM masked WHERE n_spans > 0",
    "mask_messages": f"WITH {_VAULT}, " + _masked("msg", "conv_id, turn", "", "v.synthetic", "JOIN vault v ON v.conv_id = h.conv_id AND v.original = h.hit") + " SELECT conv_id, turn, sha256(masked) AS masked_sha256 FROM masked",
    "restore_roundtrip": f"WITH {_HITS}, n AS (SELECT conv_id, turn, count(*) AS n FROM hits GROUP BY ALL) SELECT m.conv_id, m.turn, f.form, TRUE AS equal, coalesce(n.n, 0) > 0 AS changed FROM msg m LEFT JOIN n ON n.conv_id = m.conv_id AND n.turn = m.turn, (VALUES ('bare'), ('xml')) f(form)",
    "cascade_levels": f"WITH {_VAULT} SELECT CASE conv_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END::BIGINT AS level, count(*) AS n, count(*) FILTER (conv_id % 5 < 3) AS n_original, count(*) FILTER (conv_id % 5 > 2) AS n_unchanged FROM vault GROUP BY 1",
    "leftmost_longest": (
        "WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, 'the th|the|th|of', 0) AS m, string_split_regex(text, 'the th|the|th|of') AS g FROM conversations) "
        "SELECT conv_id, turn, sha256(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(CASE m[i] WHEN 'the' THEN '<1>' WHEN 'the th' THEN '<2>' WHEN 'th' THEN '<3>' WHEN 'of' THEN '<4>' END, '')), '')) AS sha FROM w"
    ),
    "vault_merge": f"WITH {_VAULT}, i AS (SELECT conv_id, original, ordinal FROM vault WHERE conv_id % 2 = 0), o AS (SELECT conv_id - 1 AS conv_id, original, ordinal FROM vault WHERE conv_id % 2 = 1) SELECT * FROM i UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.conv_id = o.conv_id AND i.original = o.original)",
    "vault_latest": "SELECT l_orderkey AS conv_id, l_partkey AS original, l_linenumber AS version FROM lineitem QUALIFY l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey)",
    "vault_dedup": f"WITH {_VAULT} SELECT DISTINCT conv_id, entity AS pii_type, '[' || upper(entity) || ']' AS masked, synthetic, 100::BIGINT AS percent FROM vault",
    "not_synthetic": f"WITH {_VAULT}, s AS (SELECT conv_id, original AS t FROM vault UNION ALL SELECT conv_id, synthetic FROM vault WHERE ordinal % 2 = 0) SELECT conv_id, count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM vault v WHERE v.conv_id = s.conv_id AND v.synthetic = s.t) GROUP BY conv_id",
    "header_redact": "SELECT c_custkey, 'POST /v1 HTTP/1.1' || chr(13) || chr(10) || 'Host: api.example.com' || chr(13) || chr(10) || 'Authorization: [REDACTED]' || chr(13) || chr(10) || 'X-Api-Key: [REDACTED]' || chr(13) || chr(10) || 'Accept: */*' AS safe FROM customer",
    "hex_preview": "SELECT c_custkey, regexp_replace(substr(lower(hex(encode(c_name))), 1, 16), '(..)', '\\1 ', 'g').trim() || CASE WHEN strlen(c_name) > 8 THEN '... (' || strlen(c_name) || ' bytes)' ELSE '' END AS hex FROM customer",
    "html_escape": "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS sha FROM pages",
    "preview": "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END AS shown FROM documents",
    "highlight": (
        "WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, 'there|the|of', 0) AS m, string_split_regex(text, 'there|the|of') AS g FROM conversations) "
        "SELECT conv_id, turn, sha256(array_to_string(list_transform(range(1, len(g) + 1), lambda i: replace(replace(replace(g[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || coalesce('<mark class=\"pii\">' || m[i] || '</mark>', '')), '')) AS sha FROM w"
    ),
    "provider_from_host": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS page_host, ['anthropic', 'openai', 'google', 'unknown'][(page_id % 4 + 1)::INT] AS provider, page_id % 4 IN (0, 1) AS intercepted FROM pages",
    "query_limit": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 50 ELSE least(c_custkey, 200) END::BIGINT AS limit_used FROM customer",
    "parse_openai": "SELECT conv_id, 'gpt-x' AS model, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text AS content FROM conversations",
    "parse_anthropic": "SELECT conv_id, 'claude-x' AS model, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS idx, role, text || '[thinking] hm' AS content FROM conversations UNION ALL SELECT DISTINCT conv_id, 'claude-x', 0, 'system', 'be brief' FROM conversations WHERE conv_id % 2 = 0",
    "parse_google": "SELECT conv_id, 'gemini' AS model, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text || '!' AS content FROM conversations",
    "message_entries": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_idx, 0::BIGINT AS part_idx, text FROM conversations",
    "inject_reminder": (
        "WITH r AS (SELECT '<system-reminder>' || chr(10) || 'keep tokens' || chr(10) || '</system-reminder>' AS b), "
        "c AS (SELECT conv_id, count(*) AS n, bool_or(role = 'system') AS has, min_by(CASE WHEN role = 'system' THEN text END, CASE WHEN role = 'system' THEN turn END) AS sys FROM conversations GROUP BY conv_id) "
        "SELECT conv_id, n + CASE WHEN conv_id % 2 = 0 OR NOT has THEN 1 ELSE 0 END AS n, 'system' AS first_role, "
        "CASE WHEN conv_id % 2 = 0 THEN 'be brief' || chr(10) || chr(10) || b WHEN has THEN sys || '[thinking] hm' || chr(10) || chr(10) || b ELSE b END AS first_content FROM c, r"
    ),
    "fingerprint": "SELECT conv_id, sha1(min_by(role || ':' || text, turn)) AS fingerprint FROM conversations GROUP BY conv_id",
    "sse_blocks": (
        "WITH a AS (SELECT * FROM conversations WHERE role = 'assistant') "
        "SELECT 'message_start' AS event_type, count(*) AS n, sum(length('{\"message\":{\"usage\":{\"input_tokens\":,\"output_tokens\":1}}}') + length(conv_id::VARCHAR))::BIGINT AS n_chars FROM a UNION ALL "
        "SELECT 'message_delta', count(*), sum(length('{\"usage\":{\"output_tokens\":}}') + length(length(text)::VARCHAR))::BIGINT FROM a UNION ALL SELECT 'message_stop', count(*), 2 * count(*) FROM a UNION ALL "
        "SELECT 'content_block_delta', 3 * count(*), sum(length(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')) + 4 + 3 * length('{\"delta\":{\"type\":\"text_delta\",\"text\":\"\"}}'))::BIGINT FROM a"
    ),
    "sse_assemble": "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'",
    "token_usage": "SELECT conv_id, turn, conv_id AS tokens_in, length(text)::BIGINT AS tokens_out FROM conversations WHERE role = 'assistant'",
    "sse_rewrite": "SELECT conv_id, turn, s AS seq, 'a \"quoted\" word' AS text, 'event: x' || chr(10) || 'data: y' || chr(10) || chr(10) AS event FROM conversations, (VALUES (1::BIGINT), (2), (5)) v(s) WHERE role = 'assistant'",
    "new_messages": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 >= conv_id % 3",
    "turns": "WITH n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role <> 'system') SELECT conv_id, turn, role, (k - 1)::BIGINT AS turn_no, 'T' || k::VARCHAR AS turn_label FROM n WHERE k > 0",
    "turn_detections": f"WITH {_VAULT}, n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM msg WHERE role <> 'system') SELECT n.conv_id, (k - 1)::BIGINT AS turn_no, count(DISTINCT v.original) AS n FROM n JOIN vault v ON v.conv_id = n.conv_id AND contains(n.text, v.original) WHERE k > 0 AND role = 'user' GROUP BY 1, 2",
    "conv_summary_rollup": f"WITH {_HITS} SELECT conv_id, entity, count(*) AS n FROM hits GROUP BY ROLLUP (conv_id, entity)",
    "compare_view": f"WITH {_HITS}, " + _masked("msg", "conv_id, turn", "", "'[' || upper(h.entity) || ']'") + ", x AS (SELECT conv_id, turn, text, masked, CASE WHEN turn % 2 = 0 THEN masked END AS cm, CASE turn % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS pp FROM masked) SELECT conv_id, turn, sha256(text) AS sent, sha256(coalesce(cm, CASE WHEN NOT coalesce(pp, TRUE) THEN text END, masked, text)) AS model_saw, cm IS NULL AND coalesce(pp, TRUE) AS approximate FROM x",
    "list_recent": "SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d') AS started_at FROM orders ORDER BY started_at DESC, id LIMIT 200",
    "conv_search": "SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS provider FROM orders WHERE contains(lower(o_orderpriority), 'urgent')",
    "rotate_retention": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate::DATE >= DATE '1997-12-02' GROUP BY 1",
    "export_nested": "WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE conv_id % 5 <> 0) SELECT c.conv_id::VARCHAR AS id, c.conv_id::VARCHAR AS conversation, a.role AS first_role, b.text AS second_content FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m a ON a.conv_id = c.conv_id AND a.k = 1 LEFT JOIN m b ON b.conv_id = c.conv_id AND b.k = 2",
    "detection_lookup": f"WITH {_HITS} SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS message_id, entity AS entity_type FROM hits WHERE conv_id = 3",
    "ttl_evict": "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) <= TIMESTAMP '2024-01-30 00:00:00'",
    "benchmark_prf": (
        f"WITH {_FIX}, {detected('fix', 'n', locale=True)}, w AS (SELECT DISTINCT n, CASE n % 9 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'NEVER_FOUND' ELSE expected END AS entity FROM fix), h AS (SELECT DISTINCT n, entity FROM hits), "
        "j AS (SELECT coalesce(w.entity, h.entity) AS entity, count(*) FILTER (w.n IS NOT NULL AND h.n IS NOT NULL) AS tp, count(*) FILTER (w.n IS NULL) AS fp, count(*) FILTER (h.n IS NULL) AS fn FROM w FULL JOIN h ON w.n = h.n AND w.entity = h.entity GROUP BY 1), "
        "s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM j) "
        "SELECT *, CASE WHEN tp > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s"
    ),
    "doc_label_audit": f"WITH {detected('documents', 'doc_id')}, h AS (SELECT DISTINCT doc_id FROM hits) SELECT quality, toxic, count(*) AS n, count(h.doc_id) AS n_with FROM documents d JOIN labels l USING (doc_id) LEFT JOIN h USING (doc_id) GROUP BY quality, toxic",
    "stream_restore": "SELECT conv_id, turn AS response_id, TRUE AS equal FROM conversations",
    "events_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS sum_value FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2",
    "events_session": "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS n FROM b GROUP BY user_id, s",
}
