"""SQL twins of the detector queries, from the same table of patterns."""

from __future__ import annotations

from ..operators.detectors import DETECTORS
from ..operators.policy import ABSTRACTION, INJECTION, REDACTION_CATEGORY


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn_sql(v: str) -> str:
    d = f"reverse({_digits(v)})"
    one = f"CAST({d}[i] AS INTEGER)"
    return f"(length({_digits(v)}) >= 8 AND list_sum([CASE WHEN i % 2 = 1 THEN {one} WHEN 2 * {one} > 9 THEN 2 * {one} - 9 ELSE 2 * {one} END for i in range(1, length({_digits(v)}) + 1)]) % 10 = 0)"


def detections_sql(source: str) -> str:
    """CTEs that end in det(key, category, tier, confidence, start_off, end_off,
    matched, rule, ord); ``source`` selects key and text."""
    parts, names = [f"base AS ({source})"], []
    for i, d in enumerate(DETECTORS):
        p = _literal(d.pattern)
        parts.append(
            f"m{i} AS (SELECT key, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS g FROM base WHERE length(text) >= 3 AND regexp_matches(text, {p}))"
        )
        parts.append(
            f"s{i} AS (SELECT key, m[k] AS v, CAST(coalesce(list_sum([length(x) for x in g[1:k]]), 0) + coalesce(list_sum([length(x) for x in m[1:k - 1]]), 0) AS BIGINT) AS st"
            f" FROM (SELECT key, m, g, unnest(range(1, len(m) + 1)) AS k FROM m{i}))"
        )
        value, start = "v", "st"
        if d.group:
            inner = f"regexp_extract(v, {p}, 1)"
            if d.check == "complex":
                inner = f"regexp_replace({inner}, '[''\";,]+$', '')"
            at = f"strpos(v, {inner}) - 1" if d.group == "front" else f"length(v) - strpos(reverse(v), reverse({inner})) - length({inner}) + 1"
            value, start = inner, f"st + {at}"
        tier, confidence, rule, keep = _literal(d.tier), str(d.confidence), _literal(d.rule), "true"
        checks = {"luhn": (luhn_sql("v"), "0.98", "'cc-luhn-verified'")}
        if d.check in checks:
            passed, high, name = checks[d.check]
            tier, confidence, rule = (f"CASE WHEN {passed} THEN {a} ELSE {b} END" for a, b in (("'checksum-verified'", tier), (high, confidence), (name, rule)))
        elif d.check == "not luhn":
            keep = f"NOT {luhn_sql('v')}"
        elif d.check == "complex":
            keep = " + ".join(f"CAST(regexp_matches({value}, '{c}') AS INTEGER)" for c in ("[A-Z]", "[a-z]", "[0-9]", r"[!@#$%^&*()_+\-=\[\]{}|;:<>?,./]")) + " >= 3"
        parts.append(
            f"d{i} AS (SELECT key, {_literal(d.category)} AS category, {tier} AS tier, CAST({confidence} AS DOUBLE) AS confidence, CAST({start} AS BIGINT) AS start_off,"
            f" CAST({start} + length({value}) AS BIGINT) AS end_off, {value} AS matched, {rule} AS rule, {i} AS ord FROM s{i} WHERE {keep})"
        )
        names.append(f"SELECT * FROM d{i}")
    parts.append("raw AS (" + " UNION ALL ".join(names) + ")")
    parts.append("ranked AS (SELECT key, list({'o': ord, 's': start_off, 'e': end_off} ORDER BY confidence DESC, start_off, ord) AS l FROM raw GROUP BY key)")
    parts.append(
        "chosen AS (SELECT key, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x:"
        " CASE WHEN len(list_filter(a, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN a ELSE list_concat(a, x) END)) AS c FROM ranked)"
    )
    parts.append("det AS (SELECT raw.* FROM raw JOIN chosen ON raw.key = chosen.key AND raw.ord = c.o AND raw.start_off = c.s AND raw.end_off = c.e)")
    return "WITH " + ",\n".join(parts)


DOCUMENTS = "SELECT doc_id AS key, coalesce(text, '') AS text FROM documents"


def _case(table: dict[str, str], default: str) -> str:
    return "CASE category " + " ".join(f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in table.items()) + f" ELSE {default} END"


def sanitized_sql(source: str = DOCUMENTS) -> str:
    """The sanitizer for the remote recipient with unknown necessity, over key and
    text of ``source``."""
    phrases = " OR ".join(f"contains(lower(text), {_literal(p)})" for p in INJECTION)
    return detections_sql(source) + f""",
decided AS (SELECT *, CASE
    WHEN category IN ('credit-card', 'iban', 'ifsc', 'account-number') THEN 'OMIT'
    WHEN category IN ('email', 'phone') THEN 'ABSTRACT'
    WHEN category IN ('aadhaar', 'pan', 'ssn') THEN 'TOKENIZE'
    WHEN category IN ('password', 'otp', 'private-key', 'api-key', 'jwt') THEN 'BLOCK'
    WHEN confidence >= 0.7 THEN 'TOKENIZE' ELSE 'ABSTRACT' END AS what FROM det),
pieces AS (SELECT d.key, d.start_off, what,
    substr(text, lag(d.end_off, 1, 0) OVER w + 1, d.start_off - lag(d.end_off, 1, 0) OVER w) ||
    CASE what WHEN 'OMIT' THEN '[OMITTED:' || {_case(REDACTION_CATEGORY, "'unknown'")} || ']'
              WHEN 'ABSTRACT' THEN {_case(ABSTRACTION, "'[' || category || ' value]'")}
              ELSE '<SENSITIVE_' || upper(substr(sha256('salt|' || d.key || '|' || d.start_off || '|' || matched), 1, 16)) || '>' END AS piece, d.end_off
  FROM decided d JOIN base USING (key) WINDOW w AS (PARTITION BY d.key ORDER BY d.start_off)),
built AS (SELECT key, string_agg(piece, '' ORDER BY start_off) AS head, max(end_off) AS last, count(*) AS n, bool_or(what = 'BLOCK') AS blocked FROM pieces GROUP BY key)
SELECT base.key, coalesce(blocked, false) AS blocked,
       CASE WHEN coalesce(blocked, false) THEN 'high' WHEN ({phrases}) OR coalesce(n, 0) > 5 THEN 'high' WHEN coalesce(n, 0) > 0 THEN 'medium' ELSE 'low' END AS risk,
       coalesce(n, 0) AS n_redactions,
       CASE WHEN coalesce(blocked, false) THEN '' WHEN n IS NULL THEN text ELSE head || substr(text, last + 1) END AS sanitized
FROM base LEFT JOIN built ON base.key = built.key
"""
