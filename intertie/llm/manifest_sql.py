"""The Merkle audit of ``documents`` in SQL: one step for each level, as many as any table can need."""

from __future__ import annotations

import zlib

#: 8 to this power is more rows than a table has.
LEVELS = 12


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII text, byte by byte over the usual table."""
    # A table entry is what one byte does to a register whose low byte it cancels.
    steps = [zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)]
    cells = ", ".join(f"{s}::BIGINT" for s in steps)
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return (
        f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
        f"lambda s, b: xor(s >> 8, ([{cells}])[(xor(s, b) & 255) + 1])))"
    )


def _levels(prefix: str, leaves: str, docs: str) -> tuple[list[str], str, str]:
    """Common table expressions that raise ``leaves`` and ``docs`` to the roots of their trees."""
    parts, nodes = [], leaves
    for level in range(LEVELS):
        runs, up, folded = f"{prefix}r{level}", f"{prefix}n{level}", f"{prefix}d{level}"
        parts.append(
            f"{runs} AS MATERIALIZED (SELECT tree, pos // 8 AS pos, list(digest ORDER BY pos) AS ds, any_value(n) AS n "
            f"FROM {nodes} GROUP BY tree, pos // 8)"
        )
        parts.append(
            f"{up} AS MATERIALIZED (SELECT tree, pos, (n + 7) // 8 AS n, "
            f"CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest FROM {runs})"
        )
        left, right = "array_to_string(ds[1:d.pos % 8], '')", "array_to_string(ds[d.pos % 8 + 2:], '')"
        parts.append(
            f"{folded} AS MATERIALIZED (SELECT d.* REPLACE (d.pos // 8 AS pos, "
            f"CASE WHEN r.n = 1 THEN d.cur ELSE sha256({left} || d.cur || {right}) END AS cur, "
            f"CASE WHEN r.n = 1 THEN d.proof ELSE d.proof || {left} || {right} END AS proof) "
            f"FROM {docs} d JOIN {runs} r ON d.tree = r.tree AND d.pos // 8 = r.pos)"
        )
        nodes, docs = up, folded
    return parts, nodes, docs


def audit_sql() -> str:
    """``op12_merkle`` in SQL."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    groups, roots, docs = _levels("g", "leaves", "docs")
    tops, top, last = _levels("t", "tops", "under")
    steps = ",\n".join(
        [
            f"own AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256({head} || {value('text')}) AS leaf, "
            f"sha256({head} || {value(small)}) AS changed, {crc32_sql('doc_id::VARCHAR')} % 3 = 0 AS third "
            "FROM documents)",
            "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1"
            " AS pos, count(*) OVER (PARTITION BY tree) AS n FROM own)",
            "leaves AS (SELECT tree, pos, leaf AS digest, n FROM placed)",
            "docs AS (SELECT doc_id, leaf, tree, pos, CASE WHEN third THEN changed ELSE leaf END AS cur, '' AS proof "
            "FROM placed)",
            *groups,
            "tops AS MATERIALIZED (SELECT '' AS tree, tree AS grp, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, "
            f"count(*) OVER () AS n FROM {roots})",
            "under AS (SELECT doc_id, leaf, t.digest AS subroot, '' AS tree, t.pos, cur, proof "
            f"FROM {docs} d JOIN tops t ON d.tree = t.grp)",
            *tops,
        ]
    )
    return (
        f"WITH {steps}\nSELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, "
        f"cur = r.digest AS verified FROM {last} CROSS JOIN {top} r"
    )
