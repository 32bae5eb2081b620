"""Column expressions over generated query texts (rule checks, tokens,
fenced schema blocks).  Java regexes use ``(?d)`` so ``^``, ``$`` and ``.``
treat only ``\\n`` as a line break, as Python's ``re`` does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finelens.functions.text import PY_WS, py_strip

# ---------------------------------------------------------------------------
# fixed patterns that must equal the reference
# ---------------------------------------------------------------------------
QUERY_LINE = rf"(?md)^{PY_WS}*QUERY{PY_WS}+"
QUERY_SIG = rf"(?md)^{PY_WS}*QUERY{PY_WS}+([A-Za-z_][A-Za-z0-9_]*){PY_WS}*\((.*?)\){PY_WS}*=>"
SCHEMA_FENCE = r"(?d)```helixschema\n([\s\S]*?)\n```"
EXCLUSION = r"::!\{([^}]*)\}"
RERANK_RRF_CALL = r"(?m)::RerankRRF\s*\(([^)]*)\)"
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*"
EXCLUDE_WORD = r"(?i)(exclude|exclusion)"
BACKTICK_FIELD = r"`([A-Za-z_][A-Za-z0-9_]*)`"
# semantic score weights and bounds
W_SEQUENCE, W_JACCARD, W_EXACT = 0.55, 0.25, 0.20
PENALTY_MAX, PENALTY_PER_ERROR = 0.45, 0.15
NEAR_MATCH = 0.8

# Python str.splitlines() boundaries
LINE_BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _s(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def splitlines(c: Column | str) -> Column:
    """Python ``str.splitlines()`` (no trailing empty piece)."""
    s = _s(c)
    parts = F.split(s, LINE_BREAKS)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(
        F.when(s.rlike(f"(?:{LINE_BREAKS})$"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    )


def normalize_query_text(c: Column | str) -> Column:
    """Strip, collapse inner whitespace per line, drop blank lines."""
    lines = splitlines(py_strip(_s(c)))
    cleaned = F.transform(lines, lambda ln: F.regexp_replace(py_strip(ln), f"{PY_WS}+", " "))
    return F.array_join(F.filter(cleaned, lambda ln: ln != ""), "\n")


def fenced_schema(c: Column | str) -> Column:
    """First fenced schema block, stripped ('' when absent)."""
    return py_strip(F.regexp_extract(_s(c), SCHEMA_FENCE, 1))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_s(c), F.lit(TOKEN), 0))


def token_jaccard(a: Column, b: Column) -> Column:
    """|A n B| / |A u B| of identifier tokens, 0 when both are empty."""
    ta, tb = token_set(a), token_set(b)
    u = F.size(F.array_union(ta, tb))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(ta, tb)).cast("double") / u)


def signature_params(c: Column | str) -> Column:
    """``name: Type`` pairs of the first signature; later duplicates win."""
    raw = py_strip(F.regexp_extract(_s(c), QUERY_SIG, 2))
    chunks = F.transform(F.split(raw, ","), lambda p: py_strip(p))
    pairs = F.transform(
        F.filter(chunks, lambda p: (p != "") & p.contains(":")),
        lambda p: F.struct(
            py_strip(F.substring_index(p, ":", 1)).alias("name"),
            py_strip(F.substr(p, F.instr(p, ":") + 1)).alias("type"),
        ),
    )
    pairs = F.filter(pairs, lambda x: (x["name"] != "") & (x["type"] != ""))
    return F.filter(
        pairs,
        lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["name"] == x["name"]),
    )


def embed_vector_misuse(c: Column | str) -> Column:
    s = _s(c)
    vec = F.filter(signature_params(s), lambda p: F.regexp_replace(p["type"], " ", "") == "[F64]")
    return F.exists(
        vec,
        lambda p: F.regexp_like(s, F.concat(F.lit(r"(?d)\bEmbed\s*\(\s*\Q"), p["name"], F.lit(r"\E\s*\)"))),
    )


def rerank_invalid(c: Column | str) -> Column:
    calls = F.regexp_extract_all(_s(c), F.lit(RERANK_RRF_CALL), 1)

    def bad(a: Column) -> Column:
        parts = F.filter(F.transform(F.split(py_strip(a), ","), lambda p: py_strip(p)), lambda p: p != "")
        return (py_strip(a) != "") & ((F.size(parts) != 1) | ~parts[0].rlike(r"(?d)^k\s*:\s*.+$"))

    return F.exists(calls, bad)


def required_exclusions(user_text: Column | str) -> Column:
    lines = F.filter(splitlines(user_text), lambda ln: ln.rlike(EXCLUDE_WORD))
    return F.array_distinct(F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(BACKTICK_FIELD), 1))


def excluded_fields(c: Column | str) -> Column:
    inner = F.regexp_extract_all(_s(c), F.lit(EXCLUSION), 1)
    return F.array_distinct(F.flatten(F.transform(inner, lambda x: F.regexp_extract_all(x, F.lit(TOKEN), 0))))


def hard_eval_errors(user_text: Column | str, query: Column | str) -> Column:
    """Rule failures of a generated query, in rule order."""
    q = _s(query)
    req = required_exclusions(user_text)
    rules = [
        (~F.regexp_replace(q, f"^{PY_WS}+", "").startswith("QUERY"), "not_starting_with_query"),
        (q.contains("```"), "contains_markdown_fence"),
        (q.contains(":="), "contains_colon_equals"),
        (~q.rlike(QUERY_LINE), "missing_query_keyword"),
        (embed_vector_misuse(q), "embed_vector_misuse"),
        (rerank_invalid(q), "rerank_rrf_invalid_args"),
        ((F.size(req) > 0) & (F.size(F.array_except(req, excluded_fields(q))) > 0), "missing_required_exclusions"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def syntax_failure(c: Column | str) -> Column:
    """First failing syntax rule as a reason text, null when valid."""
    s = _s(c)
    n_open = F.length(s) - F.length(F.replace(s, F.lit("{"), F.lit("")))
    n_close = F.length(s) - F.length(F.replace(s, F.lit("}"), F.lit("")))
    has_return = F.exists(splitlines(s), lambda ln: py_strip(ln).startswith("RETURN"))
    return (
        F.when(py_strip(s) == "", F.lit("empty response"))
        .when(~s.rlike(QUERY_LINE), F.lit("missing QUERY keyword"))
        .when(~s.rlike(QUERY_SIG), F.lit("invalid QUERY signature (expected: QUERY name(...) =>)"))
        .when(~has_return, F.lit("missing RETURN statement"))
        .when(n_open != n_close, F.format_string("unmatched braces (open=%d, close=%d)", n_open, n_close))
    )
