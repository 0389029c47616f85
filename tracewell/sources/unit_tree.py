"""The tree of units that every extractor builds for one file."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby

from ..schemas import GAP_LINES

TRIVIAL = set("{}()[];,")


def split_lines(content: str) -> list[str]:
    """Lines at LF, with a CR before it dropped; no last empty line."""
    found = content.split("\n")
    if found[-1] == "":
        found.pop()
    return [x.removesuffix("\r") for x in found]


def trivial(line: str) -> bool:
    """Whether a line is blank or holds nothing but brackets and separators."""
    return set(line.strip()) <= TRIVIAL


@dataclass
class Unit:
    id: str
    parent: str | None
    kind: str
    start: int
    end: int
    label: str
    text: str = ""
    is_leaf: bool = True


@dataclass
class UnitTree:
    """Units, definitions (unit, name, kind) and mentions (unit, name, kind, line) of a file; lines count from 1."""

    path: str
    content: str
    units: list[Unit] = field(default_factory=list)
    definitions: list[tuple[str, str, str]] = field(default_factory=list)
    mentions: list[tuple[str, str, str, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lines = split_lines(self.content)
        self.taken: set[str] = set()
        self.add(None, self.path, "file", 1, len(self.lines), self.path.rsplit("/", 1)[-1])

    def line(self, number: int) -> str:
        return self.lines[number - 1] if 0 < number <= len(self.lines) else ""

    def add(self, parent: str | None, unit_id: str, kind: str, start: int, end: int, label: str) -> str:
        """The id that the unit gets: ``#2``, ``#3`` and so on tell later ones of a name apart."""
        last = max(1, len(self.lines))
        end = min(max(start, end), last)
        name, n = unit_id, 1
        while name in self.taken:
            n += 1
            name = f"{unit_id}#{n}"
        self.taken.add(name)
        self.units.append(Unit(name, parent, kind, min(max(1, start), end), end, label))
        return name

    def define(self, unit_id: str, name: str, kind: str = "symbol") -> None:
        self.definitions.append((unit_id, name, kind))

    def mention(self, unit_id: str, name: str, kind: str, line: int) -> None:
        if name:
            self.mentions.append((unit_id, name, kind, line))

    def owners(self) -> list[str]:
        """For each line (from 1; 0 is unused) the id of the innermost unit so far; of equal spans the later one."""
        by_size = sorted(enumerate(self.units), key=lambda x: (x[1].start - x[1].end, x[0]))
        owner = [self.path] * (max(1, len(self.lines)) + 1)
        for _, u in by_size:  # the largest first, so smaller ones overwrite
            owner[u.start : u.end + 1] = [u.id] * (u.end - u.start + 1)
        return owner

    def paragraphs(self, start: int, end: int, most: int) -> list[tuple[int, int]]:
        """Runs of lines that are not blank, cut after ``most`` lines."""
        out = []
        for blank, run in groupby(range(start, end + 1), lambda n: not self.line(n).strip()):
            if not blank:
                numbers = list(run)
                out += [(numbers[k], numbers[min(k + most, len(numbers)) - 1]) for k in range(0, len(numbers), most)]
        return out

    def pieces(self, start: int, end: int, most: int = GAP_LINES) -> list[tuple[int, int]]:
        """A stretch in parts of at most ``most`` lines, cut at its last trivial line where there is one; trivial edges go."""
        out = []
        while True:
            while start <= end and trivial(self.line(start)):
                start += 1
            if start > end:
                return out
            stop = min(end, start + most - 1)
            if stop < end:
                stop = next((n - 1 for n in range(stop, start, -1) if trivial(self.line(n))), stop)
            last = stop
            while trivial(self.line(last)):
                last -= 1
            out.append((start, last))
            start = stop + 1

    def finish(self) -> UnitTree:
        """Add leaves for lines that no child covers, put units in document order and give them their texts."""
        children: dict[str, list[Unit]] = {}
        for u in self.units:
            if u.parent is not None:
                children.setdefault(u.parent, []).append(u)
        for box in [u for u in self.units if u.id in children]:
            covered = {box.start} if box.kind != "file" else set()
            for c in children[box.id]:
                covered.update(range(max(c.start, box.start), min(c.end, box.end) + 1))
            gaps = []
            for inside, run in groupby(range(box.start, box.end + 1), lambda n, c=covered: n in c):
                if not inside:
                    numbers = list(run)
                    gaps += self.pieces(numbers[0], numbers[-1])
            for n, (a, b) in enumerate(gaps, 1):
                self.add(box.id, f"{box.id}/~{n}", "gap", a, b, f"{box.label} ~{n}")
        root, *rest = self.units
        self.units = [root, *sorted(rest, key=lambda u: (u.start, -u.end, u.id))]
        parents = {u.parent for u in rest}
        for u in self.units:
            u.is_leaf = u.id not in parents
            u.text = "\n".join(self.lines[u.start - 1 : u.end]) if u.is_leaf else "" if u.kind == "file" else self.line(u.start)
        self.mentions.sort(key=lambda m: (m[3], m[0], m[1], m[2]))
        return self
