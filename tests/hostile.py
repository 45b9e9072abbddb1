"""Tables with what real ones have at their worst: nulls, empties, repeats, long texts, clashing columns."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

DATA = Path("/root/testdata/sf0.001")
#: Names that operators use inside; as extra columns they must not disturb.
CLASHING = ("key", "value", "rank", "score", "n", "seq", "salt", "size", "p", "tokens", "bucket", "term", "anc", "words", "at")


def _variants(t: pa.Table, rows: int) -> pa.Table:
    base = t.slice(0, rows).to_pylist()
    first = base[0]
    extra = [dict.fromkeys(first)]
    for name in first:
        extra.append(first | {name: None})
    text = [f.name for f in t.schema if pa.types.is_string(f.type)]
    extra.append(first | {name: "" for name in text})
    extra.append(first | {name: " ​ " for name in text})
    extra += base[:3]
    if "text" in first:
        extra.append(base[1] | {"text": "A long line of words, e.g. No. 7 of Dr. Hale. " * 4000, "doc_id": 10**6})
        extra.append(base[1] | {"text": "x" * 100_000, "doc_id": 10**6 + 1})
    return pa.Table.from_pylist(base + extra, schema=t.schema)


def folder(to: Path, empty: bool = False, rows: int = 40) -> str:
    """A copy of the smallest tables with such rows, or without any row."""
    to.mkdir(parents=True, exist_ok=True)
    fixed = {"campus_list", "feed_trust", "mix_target", "region", "nation"}
    for f in DATA.glob("*.parquet"):
        t = pq.read_table(f)
        if empty:
            t = t.slice(0, 0)
        elif f.stem not in fixed and f.stem not in ("lineitem", "orders", "customer", "part", "supplier"):
            t = _variants(t, rows)
        for c in CLASHING:
            if c not in t.column_names:
                t = t.append_column(c, pa.array([None] * len(t), pa.string()))
        pq.write_table(t, to / f.name)
    return str(to)
