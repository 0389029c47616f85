"""Plain text and Markdown: paragraphs, sections, fenced code, links, and identifiers named in prose."""

from __future__ import annotations

import re
from urllib.parse import unquote

from ..schemas import PARAGRAPH_LINES
from .unit_tree import UnitTree

HEADING = re.compile(r"^[^\S\n]{0,3}(#{1,6})(?:[ \t]+(.*))?$")
SPAN = re.compile(r"`([^`]*)`")
NAME_IN_SPAN = re.compile(r"[^\W\d][\w:.]*")
LINK = re.compile(r"\[\[([^\]]*)\]\]|(!?)\[(?:[^\[\]]|\[[^\]]*\])*\]\(([^)]*)\)")


def identifier_shaped(word: str) -> bool:
    """Whether a bare word looks like code: a path, an underscore, or mixed case within it."""
    w = re.sub(r"^\W+|\W+$", "", word)
    if len(w) < 3:
        return False
    if "::" in w or "_" in w or any(a.islower() and b.isupper() for a, b in zip(w, w[1:])):
        return True
    return w[0].isupper() and any(map(str.isupper, w[1:])) and any(map(str.islower, w))


def last_segment(name: str) -> str | None:
    """The last part of a path, if it has three characters or more."""
    parts = [p for p in re.split("[:.]", name) if p]
    return parts[-1] if parts and len(parts[-1]) >= 3 else None


def span_name(span: str) -> str | None:
    """What a code span names: ``Store::open()`` names open."""
    s = span.strip()
    while s.endswith("()"):
        s = s[:-2]
    s = s.rstrip("!").split("(", 1)[0]
    return last_segment(s) if NAME_IN_SPAN.fullmatch(s) else None


def bridge_names(line: str) -> list[str]:
    """Names of code in a line of prose, sorted, each once."""
    found = {span_name(s) for s in SPAN.findall(line)}
    for word in re.split(r"[^\w:.]+", SPAN.sub("", line).replace("`", "", 1)):
        bare = word.strip(".:")
        if identifier_shaped(bare):
            found.add(last_segment(bare))
    return sorted(found - {None})


def slugify(heading: str) -> str:
    return "".join(c.lower() if c.isalnum() or c in "-_" else "-" if c == " " else "" for c in heading.strip() if c.isalnum() or c in "-_ ")


def links(line: str) -> list[str]:
    """Targets of links outside code spans, wiki links as ``wiki:<page>``; images are none."""
    out = []
    for wiki, image, target in LINK.findall(SPAN.sub(lambda m: " " * len(m[0]), line)):
        if page := wiki.split("|", 1)[0].strip():
            out.append("wiki:" + page)
        elif not image and target.split():
            out.append(target.split()[0])
    return out


def resolved(folder: str, file: str) -> str:
    """A path as seen from a folder, without dots; a leading slash means the root."""
    kept: list[str] = []
    for part in ([] if file.startswith("/") else folder.split("/")) + file.split("/"):
        if part == "..":
            kept = kept[:-1]
        elif part not in ("", "."):
            kept.append(part)
    return "/".join(kept)


def normalize_link(path: str, target: str) -> str | None:
    """The file, and anchor, that a link from ``path`` means; none for what lies outside."""
    folder = path.rpartition("/")[0]
    if target.startswith("wiki:"):
        return resolved(folder, target[5:].removesuffix(".md") + ".md")
    if "://" in target or target.startswith("mailto:"):
        return None
    file, _, anchor = target.partition("#")
    found = resolved(folder, unquote(file)) if file else path
    return f"{found}#{unquote(anchor).lower()}" if anchor else found


def text(path: str, content: str, prose: bool) -> UnitTree:
    """Paragraphs, where there are several; in prose, names of code too."""
    tree = UnitTree(path, content)
    tree.define(path, path, "anchor")
    found = tree.paragraphs(1, len(tree.lines), PARAGRAPH_LINES)
    if len(found) > 1:
        for n, (a, b) in enumerate(found, 1):
            tree.add(path, f"{path}/¶{n}", "paragraph", a, b, f"¶{n}")
    if prose:
        owner = tree.owners()
        for n, line in enumerate(tree.lines, 1):
            for name in bridge_names(line):
                tree.mention(owner[n], name, "bridge", n)
    return tree.finish()


def fenced(lines: list[str]) -> list[tuple[int, int]]:
    """First and last lines of fenced blocks; one that is not closed goes to the end."""
    out, opened, mark = [], 0, ""
    for n, line in enumerate(lines, 1):
        bare = line.lstrip()
        if opened:
            if bare.startswith(mark):
                out.append((opened, n))
                opened = 0
        elif bare.startswith(("```", "~~~")):
            opened, mark = n, bare[:3]
    return [*out, (opened, len(lines))] if opened else out


def markdown(path: str, content: str) -> UnitTree:
    """Sections by heading, in them paragraphs and fenced code; anchors, links and names of code."""
    tree = UnitTree(path, content)
    tree.define(path, path, "anchor")
    n_lines = len(tree.lines)
    fences = fenced(tree.lines)
    code = {n for a, b in fences for n in range(a, b + 1)}
    heads = []
    for n, line in enumerate(tree.lines, 1):
        if n not in code and (m := HEADING.match(line)) and (title := (m[2] or "").strip().rstrip("#").strip()):
            heads.append((n, len(m[1]), title))
    bodies = [(path, "", 1, heads[0][0] - 1 if heads else n_lines)]
    open_: list[tuple[int, str, str]] = []
    seen: dict[str, int] = {}
    for k, (n, level, title) in enumerate(heads):
        open_ = [x for x in open_ if x[0] < level]
        end = next((m - 1 for m, other, _ in heads[k + 1 :] if other <= level), n_lines)
        slug = slugify(title)
        parent, above = (open_[-1][1], open_[-1][2] + "/") if open_ else (path, "")
        unit = tree.add(parent, f"{path}#{above}{slug}", "section", n, end, title)
        times = seen.get(slug, 0)
        seen[slug] = times + 1
        tree.define(unit, f"{path}#{slug}" + (f"-{times}" if times else ""), "anchor")
        bodies.append((unit, title, n + 1, heads[k + 1][0] - 1 if k + 1 < len(heads) else n_lines))
        open_.append((level, unit, above + slug))
    for parent, title, a, b in bodies:
        blocks = [(s, min(e, b)) for s, e in fences if a <= s <= b]
        for k, (s, e) in enumerate(blocks, 1):
            tree.add(parent, f"{parent}/code{k}", "code_block", s, e, f"{title} · code {k}" if title else f"code {k}")
        edges = [a - 1, *(x for block in blocks for x in block), b + 1]
        prose = [p for x, y in zip(edges[::2], edges[1::2]) for p in tree.paragraphs(x + 1, y - 1, PARAGRAPH_LINES)]
        for k, (s, e) in enumerate(prose, 1):
            tree.add(parent, f"{parent}/¶{k}", "paragraph", s, e, f"{title} ¶{k}" if title else f"¶{k}")
    owner = tree.owners()
    for n, line in enumerate(tree.lines, 1):
        if n not in code:
            for target in links(line):
                tree.mention(owner[n], normalize_link(path, target) or "", "link", n)
            for name in bridge_names(line):
                tree.mention(owner[n], name, "bridge", n)
    return tree.finish()
