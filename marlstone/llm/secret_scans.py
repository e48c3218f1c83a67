"""Secret scans: strong patterns alone, weak candidates when their counterparts stand near.

Everything is built-in functions: matches are found with regular expressions,
their places come from the lengths of what lies between them, and parts are
linked by searching the sorted intervals of the other kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.native import let, lower_bound, running

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The whole runs that are long enough: a run matched from its start is as long as can be.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Parts that tell nothing alone. An opaque value is a whole run of such characters, in base 64, with upper and lower case and a digit.
RUN = r"[A-Za-z0-9+/_=.-]{32,}"
OPAQUE = (r"^[A-Za-z0-9+/]{32,}={0,2}$", r"[A-Z]", r"[a-z]", r"[0-9]")
IDENTITY = r"""(?i:(?<![A-Za-z0-9_])(?:client_?id|user_?name|user|login|account_?id|account)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9@._+-]{3,}"""
ENDPOINT = r"""(?i:(?<![A-Za-z0-9_])(?:(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?))[A-Za-z0-9][^\x20\x09-\x0D"'<>,;|]{3,}"""

KINDS = ("assign", "access", "hex", "linked_secret", "linked_identity", "linked_endpoint")
#: Two parts are in one scope when at most this many characters lie between them.
SCOPE = 256
LEAST_VALUE = 6


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(pattern: str, kind: int, keep: str = "", group: int = 0) -> str:
    """Sorted, disjoint spans of a pattern in ``body``: structs of start, kind and end. ``keep``: a test of a match's ``group``, ``value``."""
    sql = _quote(pattern)
    found = let(
        "hits",
        f"regexp_extract_all(body, {sql}, 0)",
        let(
            "gaps",
            f"split(body, {sql})",
            let(
                "ends",
                running("transform(hits, (h, i) -> length(get(gaps, i)) + length(h))", "{a} + {b}", "array()"),
                f"transform(ends, (e, i) -> named_struct('start', CAST(e - length(get(hits, i)) AS BIGINT), 'kind', {kind}, 'end', CAST(e AS BIGINT), 'ok', true))",
            ),
        ),
    )
    if keep:
        found = let("spans", found, let("taken", f"regexp_extract_all(body, {sql}, {group})", f"filter(spans, (s, i) -> {keep.format(value='get(taken, i)')})"))
    bare = f"transform({found}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))"
    return f"CASE WHEN body RLIKE {sql} THEN {bare} ELSE {NONE} END"


NONE = "CAST(array() AS ARRAY<STRUCT<start: BIGINT, kind: INT, end: BIGINT>>)"


def _near(part: str, others: str, gap: int) -> str:
    """Whether one of the spans ``others`` (a column, sorted and disjoint) lies within ``gap`` of the span ``part``."""
    first = lower_bound(f"{others}.end", f"{part}.start - {gap}")
    return f"(size({others}) > 0 AND coalesce({let('at', first, f'get({others}, at).start <= {part}.end + {gap}')}, false))"


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secrets``: an array of spans (start, kind, end), by start and then kind, of each text.

    Places count code points, ends are exclusive, and ``kind`` is an index of
    KINDS. Strong spans (assign, access, hex) are the leftmost matches of each
    kind that do not overlap one another; an assignment whose value has fewer
    than LEAST_VALUE characters is passed over. Weak parts are opaque values,
    identities and endpoints. An opaque value is reported as linked_secret
    where an access key or identity is in its scope; an identity or endpoint
    as linked_identity or linked_endpoint where a secret (an assignment, a
    linkable opaque value) and a part of the remaining kind both are. A weak
    part that overlaps a strong span is never reported, as that is already. A
    null text counts as empty. Every row is returned, with all its columns but
    one named ``secrets``, which is replaced.
    """
    row, others = F.struct(*(F.col(f"`{c}`") for c in df.columns)), [c for c in df.columns if c != "secrets"]
    base = df.select(row.alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    base = base.withColumns(
        {
            "s_assign": F.expr(_spans(ASSIGN, 0, f"length({{value}}) >= {LEAST_VALUE}", 2)),
            "s_access": F.when(F.col("body").contains("AKIA"), F.expr(_spans(ACCESS, 1))).otherwise(F.expr(NONE)),
            "s_hex": F.expr(_spans(HEX, 2)),
        }
    )
    opaque = " AND ".join(f"{{value}} RLIKE {_quote(test)}".replace("{32,}", "{{32,}}").replace("{0,2}", "{{0,2}}") for test in OPAQUE)
    # weak parts are looked for only where a part that they could be linked to can be
    named = "body RLIKE '(?i:client_?id|user|login|account)'"
    base = base.withColumn("w_identity", F.expr(f"CASE WHEN {named} THEN {_spans(IDENTITY, 4)} ELSE {NONE} END"))
    base = base.withColumn("w_secret", F.expr(f"CASE WHEN size(s_access) + size(w_identity) > 0 THEN {_spans(RUN, 3, opaque)} ELSE {NONE} END"))
    base = base.withColumn("w_endpoint", F.expr(f"CASE WHEN size(s_access) + size(w_identity) > 0 AND size(s_assign) + size(w_secret) > 0 THEN {_spans(ENDPOINT, 5)} ELSE {NONE} END"))

    near = lambda *kinds: "(" + " OR ".join(_near("p", k, SCOPE) for k in kinds) + ")"
    clear = "NOT " + "(" + " OR ".join(_near("p", k, -1) for k in ("s_assign", "s_access", "s_hex")) + ")"
    secret, identity = near("s_assign", "w_secret"), near("s_access", "w_identity")
    linked = {
        "w_secret": f"{identity} AND {clear}",
        "w_identity": f"{secret} AND {near('w_endpoint')} AND {clear}",
        "w_endpoint": f"{secret} AND {identity} AND {clear}",
    }
    kept = ", ".join(f"CASE WHEN size({k}) > 0 THEN filter({k}, p -> {test}) ELSE {NONE} END" for k, test in linked.items())
    found = base.withColumn("secrets", F.expr(f"sort_array(concat(s_assign, s_access, s_hex, {kept}))"))
    return found.select(*(F.col("row")[c].alias(c) for c in others), "secrets")


def listed(spans: Column | str, most: int = len(KINDS)) -> Column:
    """``kind:start:end`` of the spans of the first ``most`` kinds, joined by commas."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] < most), one), ",")


def redact(df: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """Replaces what the spans cover by ``[secret]``, once for spans that overlap; a null text stays null."""
    before = running(f"transform({secrets}, s -> s.end)", "greatest({a}, {b})", f"transform({secrets}, s -> s.end)")
    pieces = (
        f"transform({secrets}, (s, i) -> {let('from', 'if(i = 0, 0, get(upto, i - 1))', '''if(s.start >= from, concat(substring(BODY, CAST(from + 1 AS INT), CAST(s.start - from AS INT)), '[secret]'), '')''')})"
    )
    whole = let("upto", before, f"concat(array_join({pieces}, ''), substring(BODY, CAST(get(upto, size(upto) - 1) + 1 AS INT), length(BODY)))").replace("BODY", f"`{text}`")
    return df.withColumn(text, F.expr(f"CASE WHEN size({secrets}) > 0 THEN {whole} ELSE `{text}` END"))
