"""Answers as text and JSON, from rows that were already cut to what is shown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def short(unit_id: str, path: str) -> str:
    """A unit's name for people (the Column form is functions.text.short_name)."""
    rest = unit_id.removeprefix(path)
    bare = rest[2:] if rest.startswith("::") else rest.lstrip("#/")
    return "/".join(bare.split("/")[-2:]) if bare else "(file)"


def hits_text(hits: DataFrame, tests: DataFrame) -> str:
    """A line for each hit with the operators that found it, and its signature; then tests."""
    rows, shown = hits.orderBy("rank").collect(), tests.orderBy("rank").collect()
    if not rows and not shown:
        return "no candidates"
    out = []
    for r in rows:
        inside = f" (+{r.lifted} inside)" if r.lifted else ""
        ops = ", ".join(v.op for v in sorted(r.via, key=lambda v: (-v.contribution, v.op)))
        out += [f"{r.path}:{r.start_line}-{r.end_line} {short(r.doc, r.path)}{inside} · {ops}", f"    {r.signature}"]
    if shown:
        out += ["tests:", *(f"  {r.path}:{r.start_line}-{r.end_line} {short(r.doc, r.path)}" for r in shown)]
    return "\n".join(out)


def open_text(unit: DataFrame, children: DataFrame) -> str:
    """Numbered lines of a leaf, or the children of a container."""
    u = unit.first()
    below = children.collect()
    if below:
        return "\n".join([f"{u.id} ({u.kind}, {u.start_line}-{u.end_line})", *(f"  {c.start_line}-{c.end_line} {c.kind} {short(c.id, c.path)}" for c in below)])
    return "\n".join([f"{u.id} ({u.kind})", *(f"{n:>6}  {line}" for n, line in enumerate(u.text.split("\n"), u.start_line))])


def refs_text(edges: DataFrame, units: DataFrame) -> str:
    """A line for each edge, with where it starts."""
    placed = edges.join(units.select(units["id"].alias("src"), "path"), "src", "left").orderBy(edges["weight"].desc(), "src")
    return "\n".join(f"{e.kind} {e.origin} w={e.weight:.2f} {e.src} ({e.path}:{e.line}) → {e.dst}" for e in placed.collect())


def answer_json(hits: DataFrame, tests: DataFrame) -> str:
    return json.dumps({"hits": [r.asDict(True) for r in hits.orderBy("rank").collect()], "tests": [r.asDict(True) for r in tests.orderBy("rank").collect()]}, ensure_ascii=False)


def rows_json(rows: DataFrame) -> str:
    return json.dumps([r.asDict(True) for r in rows.collect()], ensure_ascii=False)
