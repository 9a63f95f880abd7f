"""DuckDB SQL for the rows of the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

import math

from gridlark.llm.secret_scan import ACCESS, ALLOW, ASSIGN, ASSIGN_LEAST, ASSIGN_VALUE, CLASSES, HEX, KINDS

#: Windows are told apart by a 128-bit digest of their bytes.
OP5 = """WITH h AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT r, p, md5(b[p + 1:p + 200]) AS k FROM (SELECT r, b, unnest(range(0, greatest(octet_length(b) - 199, 0))) AS p FROM h) x),
hit AS (SELECT r, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
cut AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 1 ELSE 0 END AS new FROM hit),
island AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM cut),
span AS MATERIALIZED (SELECT r, min(p) AS s, max(p) + 200 AS e FROM island GROUP BY r, g),
gap AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS s, s AS e FROM span
    UNION ALL SELECT h.r, coalesce(max(span.e), 0), octet_length(b) FROM h LEFT JOIN span ON h.r = span.r GROUP BY h.r, octet_length(b)),
kept AS (SELECT h.r, string_agg(hex(b[gap.s + 1:gap.e]), '' ORDER BY gap.s) AS x FROM h JOIN gap ON h.r = gap.r GROUP BY h.r),
gone AS (SELECT r, sum(e - s) AS n, count(*) AS spans FROM span GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone.n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM h JOIN kept ON h.r = kept.r LEFT JOIN gone ON h.r = gone.r"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _places(name: str, pattern: str) -> str:
    """name: (r, start, hit) of a pattern's matches; places are running sums of the gaps and the matches before."""
    p = _quoted(pattern)
    return f"""{name}_parts AS (SELECT r, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM
    (SELECT r, regexp_extract_all(t, {p}) AS hits, regexp_split_to_array(t, {p}) AS gaps FROM h WHERE regexp_matches(t, {p})) x),
{name} AS (SELECT r, sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY r ORDER BY i) - length(hits[i]) AS start, hits[i] AS hit FROM {name}_parts)"""


def _entropy(name: str, c) -> str:
    """name_hot: (r, start, e) from the first to the last window of a run that reaches the class's bits."""
    most = math.floor((math.log2(c.width) - c.bits) * c.width * 1e6)
    cleared = " AND ".join(f"NOT regexp_matches(hit, {_quoted(p)})" for p in (c.unless, *ALLOW))
    return f"""{_places(name, c.run)},
{name}_chars AS (SELECT r, start, o, unnest(string_split(substr(hit, o + 1, {c.width}), '')) AS ch FROM
    (SELECT r, start, hit, unnest(range(0, length(hit) - {c.width} + 1)) AS o FROM {name} WHERE {cleared}) x),
{name}_counts AS (SELECT r, start, o, ch, count(*) AS c FROM {name}_chars GROUP BY ALL),
{name}_sums AS (SELECT r, start, o, sum(round(c * log2(c) * 1000000)::BIGINT) AS s FROM {name}_counts GROUP BY ALL),
{name}_hot AS (SELECT r, start + min(o) AS start, start + max(o) + {c.width} AS e FROM {name}_sums WHERE s <= {most} GROUP BY r, {name}_sums.start)"""


def _op7() -> str:
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX), strict=True))
    value = _quoted(ASSIGN_VALUE)
    parts = [_places(f"k_{k}", p) for k, p in patterns.items()] + [_entropy(f"e_{c.name}", c) for c in CLASSES]
    found = [
        f"SELECT r, start, {n} AS rank, start + length(hit) AS e, '{k}' AS kind FROM k_{k}" + (f" WHERE length(regexp_extract(hit, {value}, 1)) >= {ASSIGN_LEAST}" if k == "assign" else "")
        for n, k in enumerate(KINDS)
    ]
    found += [f"SELECT r, start, {len(KINDS)}, e, 'entropy' FROM e_{c.name}_hot" for c in CLASSES]
    shown = "kind || ':' || start || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)
    return f"""WITH h AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(parts)},
every AS ({" UNION ALL ".join(found)}),
told AS (SELECT r, {counts}, string_agg({shown}, ',' ORDER BY start, rank, e) AS spans,
    string_agg({shown}, ',' ORDER BY start, rank, e) FILTER (rank < {len(KINDS)}) AS base FROM every GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM h LEFT JOIN told ON h.r = told.r"""


SQL = {"op5_suffix_dedup": OP5, "op7_secret_scan": _op7()}
