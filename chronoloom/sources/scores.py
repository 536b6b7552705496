"""Notated scores: the order in which bars sound, with repeats, endings and leaps, and readers of Kern and MEI."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction
from xml.etree import ElementTree

#: Semitones of the natural notes above C.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
#: Velocity of notes that are only written.
WRITTEN = 80
BREVE, LONG = 8, 16


@dataclass
class Bar:
    """What a bar says about the order of play: repeats, endings, and leaps at its end."""

    opens: bool = False
    closes: int = 0
    ends: frozenset = frozenset()
    segno: bool = False
    coda: bool = False
    fine: bool = False
    to_coda: bool = False
    jump: str = ""  # capo or segno


def with_repeats(bars: list[Bar]) -> list[int]:
    """Places of bars as they sound: repeats taken, endings by their numbers.

    A section ends at its last ending or its closing bar. One whose only ending is the first is played twice.
    """
    ends = [b.ends for b in bars]
    group: dict[int, int] = {}
    for k, e in enumerate(ends):
        if e:
            group[k] = group[k - 1] if k - 1 in group and min(e) >= min(ends[k - 1]) else k
    turns = {g: max(2, *(n for k in group if group[k] == g for n in ends[k])) for g in set(group.values())}
    order, k, first, turn = [], 0, 0, 1
    while k < len(bars):
        if bars[k].opens and k != first:
            first, turn = k, 1
        plays = not ends[k] or turn in ends[k]
        if plays:
            order.append(k)
            if bars[k].closes and turn < turns.get(group.get(k), bars[k].closes):
                turn, k = turn + 1, first
                continue
        left = k in group and group.get(k + 1) != group[k]
        if left or plays and bars[k].closes:
            first, turn = k + 1, 1
        k += 1
    return order


def played(bars: list[Bar]) -> list[int]:
    """with_repeats(), up to the first leap on its last turn; then from the start or the sign without repeats, on last endings, to fine or by way of the coda."""
    order = with_repeats(bars)
    leap = next((k for k, b in enumerate(bars) if b.jump and k in order), None)
    if leap is None:
        return order
    out = order[: len(order) - order[::-1].index(leap)]
    k = 0 if bars[leap].jump == "capo" else next((j for j, b in enumerate(bars) if b.segno), 0)
    coda = next((j for j, b in enumerate(bars) if b.coda), None)
    last = {}
    for j, b in enumerate(bars):  # the last ending of each run of endings
        if b.ends:
            run = j - 1 if j and bars[j - 1].ends else j
            last[j] = last[run] if run in last else j
    top = {g: max(max(bars[j].ends) for j in last if last[j] == g) for g in set(last.values())}
    while k < len(bars):
        b = bars[k]
        if not b.ends or top[last[k]] in b.ends:
            out.append(k)
            if b.fine:
                break
            if b.to_coda and coda is not None and coda > k:
                k = coda
                continue
        k += 1
    return out


def clock(tempos: list[tuple[float, float]], default_bpm: float) -> Callable[[float], float]:
    """Seconds of a place in quarters, by tempo changes (quarters, bpm); the default holds before the first, the last of one place counts."""
    changes = dict(sorted(tempos, key=lambda t: t[0]))
    changes.setdefault(0.0, default_bpm)
    at, seconds = sorted(changes), [0.0]
    for a, b in zip(at, at[1:]):
        seconds.append(seconds[-1] + float(b - a) * 60 / changes[a])

    def when(q: float) -> float:
        k = max(0, bisect_right(at, q) - 1)
        return seconds[k] + float(q - at[k]) * 60 / changes[at[k]]

    return when


@dataclass
class Piece:
    """A score bar by bar: notes (offset in the bar, length in quarters, midi, part, voice, staff, tie), tempos, lengths.

    tie: '[' begins, '_' goes on, ']' ends one, '' none.
    """

    bars: list[Bar] = field(default_factory=list)
    notes: list[list[tuple]] = field(default_factory=list)
    tempos: list[list[tuple[Fraction, float]]] = field(default_factory=list)
    sizes: list[Fraction] = field(default_factory=list)
    parts: list[tuple[str, str]] = field(default_factory=list)

    def add_bar(self) -> None:
        self.bars.append(Bar())
        self.notes.append([])
        self.tempos.append([])
        self.sizes.append(Fraction(0))

    def rows(self, default_bpm: float, unfold: bool) -> list[tuple]:
        """(start, duration, midi, velocity, part, id, name, voice, staff) in seconds, by start and pitch; ties are joined."""
        out, tempos, at = [], [], Fraction(0)
        held: dict[tuple, int] = {}
        for k in played(self.bars) if unfold else range(len(self.bars)):
            tempos += [(at + q, bpm) for q, bpm in self.tempos[k]]
            for offset, length, midi, part, voice, staff, tie in sorted(self.notes[k], key=lambda n: n[0]):
                key, start = (midi, part, voice, staff), at + offset
                if tie in ("_", "]") and key in held and out[held[key]][1] == start:
                    out[held[key]][1] = start + length
                else:
                    held[key] = len(out)
                    out.append([start, start + length, midi, part, voice, staff])
                if tie in ("", "]"):
                    held.pop(key, None)
            at += self.sizes[k]
        when = clock(tempos, default_bpm)
        rows = [(when(a), when(b) - when(a), midi, WRITTEN, part, *self.parts[part], voice, staff) for a, b, midi, part, voice, staff in out if b > a]
        return sorted(rows, key=lambda r: (r[0], r[2]))


# ---- Kern ----------------------------------------------------------------------------------------

_KERN_NOTE = re.compile(r"([a-gA-G])\1*")
_RECIP = re.compile(r"(\d+)(?:%(\d+))?(\.*)")


def _recip(text: str) -> Fraction:
    """The length of a Kern token in quarters."""
    m = _RECIP.search(text)
    if not m:
        return Fraction(0)
    whole, parts, dots = int(m[1]), int(m[2] or 1), len(m[3])
    base = Fraction(4 * parts, whole) if whole else Fraction(BREVE)
    return base * (2 - Fraction(1, 2**dots))


def _kern_pitch(token: str) -> int | None:
    m = _KERN_NOTE.search(token)
    if not m:
        return None
    letter, count = m[1], len(m[0])
    octave = 3 + count if letter.islower() else 4 - count
    return 12 * (octave + 1) + STEPS[letter.upper()] + token.count("#") - token.count("-")


def parse_kern(data: bytes, default_bpm: float = 120.0, unfold: bool = True) -> list[tuple]:
    """Notes of a Kern file: spines split, joined, exchanged, added and ended, chords, ties, tempos, bar-line repeats, an expansion list or leaps by *>labels.

    Parts follow *part, else the spines from right to left; voices the sub-spines from left to right.
    """
    piece = Piece()
    spines: list[dict] = []  # kind, part, staff; sub-spines of one spine share its root
    names: dict[int, str] = {}
    labels, lists = [], {}
    time, start = Fraction(0), Fraction(0)
    piece.add_bar()

    def close():
        nonlocal start
        piece.sizes[-1] = time - start
        start = time

    def ended() -> Fraction:
        """When the next line comes: the first end of what sounds."""
        later = [s["end"] for s in spines if s["end"] > time]
        return min(later, default=time)

    pending = False  # a data line was read whose time has not passed yet
    for line in data.decode("utf-8", "replace").splitlines():
        if not line or line.startswith("!"):
            continue
        cells = line.split("\t")
        if line.startswith("**"):
            kern = [k for k, c in enumerate(cells) if c == "**kern"]
            spines = [{"kind": c, "root": k, "part": len(kern) - 1 - kern.index(k) if k in kern else None, "staff": None, "end": time} for k, c in enumerate(cells)]
            continue
        if line.startswith("*"):
            if pending and any(c in ("*^", "*v", "*-", "*x", "*+") or c.startswith("*>") for c in cells):
                time, pending = ended(), False
            for s, c in zip(spines, cells):
                if re.fullmatch(r"\*MM\d+(\.\d+)?", c):
                    now = ended() if pending else time
                    piece.tempos[-1].append((now - start, float(c[3:])))
                elif re.fullmatch(r"\*staff\d+", c):
                    s["staff"] = int(c[6:])
                elif re.fullmatch(r"\*part\d+", c):
                    s["part"] = int(c[5:]) - 1
                elif c.startswith('*I"') and s["part"] is not None:
                    names[s["part"]] = c[3:]
            first = next((c for c in cells if c.startswith("*>")), None)
            if first and "[" in first:
                lists[first[2 : first.index("[")]] = first[first.index("[") + 1 : -1].split(",")
            elif first:
                if time > start or piece.notes[-1]:
                    close()
                    piece.add_bar()
                labels.append((first[2:], len(piece.bars) - 1))
            new, k = [], 0
            while k < len(cells):
                c, s = cells[k], spines[k]
                if c == "*^":
                    new += [s, dict(s)]
                elif c == "*+":
                    new += [s, {**s, "kind": "", "root": 1000 + k}]
                elif c == "*v":
                    while k + 1 < len(cells) and cells[k + 1] == "*v" and spines[k + 1]["root"] == s["root"]:
                        k += 1
                        s["end"] = max(s["end"], spines[k]["end"])
                    new.append(s)
                elif c == "*x" and k + 1 < len(cells):
                    new += [spines[k + 1], s]
                    k += 1
                elif c != "*-":
                    new.append(s)
                k += 1
            spines = new
            continue
        if line.startswith("="):
            if pending:
                time, pending = ended(), False
            mark = cells[0]
            close_repeat, open_repeat = bool(re.search(r":[|!]", mark)), bool(re.search(r"[|!]:", mark))
            if close_repeat:
                piece.bars[-1].closes = 2
            if time > start or piece.notes[-1]:
                close()
                piece.add_bar()
            piece.bars[-1].opens |= open_repeat
            continue
        if pending:
            time, pending = ended(), False
        voices: dict[int, int] = {}
        for s, cell in zip(spines, cells):
            if s["kind"] != "**kern":
                continue
            voices[s["root"]] = voices.get(s["root"], 0) + 1
            if cell == "." or "q" in cell.lower():
                continue
            length, longest = None, Fraction(0)
            for token in cell.split(" "):
                length = _recip(token) or length or Fraction(0)
                longest = max(longest, length)
                midi = None if "r" in token else _kern_pitch(token)
                if midi is not None:
                    tie = "[" if "[" in token else "_" if "_" in token else "]" if "]" in token else ""
                    piece.notes[-1].append((time - start, length, midi, s["part"], voices[s["root"]], s["staff"] or s["part"] + 1, tie))
            s["end"] = time + longest
            pending = True
    if pending:
        time = max([time, *(s["end"] for s in spines)])
    close()
    count = max([s[3] + 1 for notes in piece.notes for s in notes], default=0)
    piece.parts = [(f"P{k + 1}", names.get(k, "")) for k in range(count)]
    expansion = lists.get("") or next(iter(lists.values()), None)
    if unfold and expansion:
        stops = [at for _, at in labels[1:]] + [len(piece.bars)]
        place = {name: range(at, stop) for (name, at), stop in zip(labels, stops)}
        order = [k for name in expansion for k in place.get(name, ())]
        for part in ("notes", "tempos", "sizes"):
            setattr(piece, part, [getattr(piece, part)[k] for k in order])
        piece.bars = [Bar() for _ in order]
    return piece.rows(default_bpm, unfold)


# ---- MEI -----------------------------------------------------------------------------------------

_MEI_ACCIDENTALS = {"s": 1, "ss": 2, "x": 2, "f": -1, "ff": -2, "n": 0}


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _mei_length(e, given: Fraction | None = None) -> Fraction:
    """The written length of an element in quarters; given: of the chord around it."""
    dur = e.get("dur")
    if dur is None:
        return given if given is not None else Fraction(0)
    base = {"breve": Fraction(BREVE), "long": Fraction(LONG)}.get(dur) or Fraction(4, int(dur))
    return base * (2 - Fraction(1, 2 ** int(e.get("dots") or 0)))


def _mei_pitch(note) -> int:
    accid = note.get("accid.ges") or note.get("accid") or next((c.get("accid.ges") or c.get("accid") for c in note if _tag(c) == "accid"), None)
    return 12 * (int(note.get("oct")) + 1) + STEPS[note.get("pname").upper()] + _MEI_ACCIDENTALS.get(accid or "n", 0)


def parse_mei(data: bytes, default_bpm: float = 120.0, unfold: bool = True) -> list[tuple]:
    """Notes of an MEI score: staves and layers, chords, beams, tuplets, ties by attribute or element, repeats, endings, leaps by directions."""
    root = ElementTree.fromstring(data)
    piece, staff_part = Piece(), {}
    state = {"ends": frozenset(), "ties": {}}
    for e in root.iter():
        if _tag(e) == "tie":
            state["ties"].setdefault((e.get("startid") or "").lstrip("#"), set()).add("[")
            state["ties"].setdefault((e.get("endid") or "").lstrip("#"), set()).add("]")
        if _tag(e) == "staffDef" and e.get("n"):
            n = int(e.get("n"))
            if n not in staff_part:
                label = e.get("label") or next(("".join(c.itertext()) for c in e if _tag(c) == "label"), "")
                staff_part[n] = len(piece.parts)
                piece.parts.append((f"P{len(piece.parts) + 1}", label))

    def tie_of(note) -> str:
        name = note.get("{http://www.w3.org/XML/1998/namespace}id") or note.get("id") or ""
        marks = set(state["ties"].get(name, ())) | {{"i": "[", "m": "_", "t": "]"}[t] for t in note.get("tie") or "" if t in "imt"}
        return "_" if "_" in marks or {"[", "]"} <= marks else "".join(marks)

    def layer(e, at: Fraction, scale: Fraction, part: int, voice: int, staff: int) -> Fraction:
        """Put the notes under e from place `at` of the bar on; the place after them."""
        for c in e:
            kind = _tag(c)
            if kind in ("note", "chord") and not c.get("grace"):
                length = _mei_length(c) * scale
                for note in [c] if kind == "note" else [n for n in c if _tag(n) == "note"]:
                    own = _mei_length(note, length / scale) * scale
                    piece.notes[-1].append((at, own, _mei_pitch(note), part, voice, staff, tie_of(note) or (tie_of(c) if note is not c else "")))
                at += length
            elif kind in ("rest", "space"):
                at += _mei_length(c) * scale
            elif kind == "tuplet":
                at = layer(c, at, scale * Fraction(int(c.get("numbase") or 2), int(c.get("num") or 3)), part, voice, staff)
            elif kind in ("beam", "ligature", "graceGrp") and kind != "graceGrp":
                at = layer(c, at, scale, part, voice, staff)
            elif kind in ("mRest", "mSpace"):
                at += meter["length"]
        return at

    meter = {"length": Fraction(4)}

    def metered(e) -> None:
        count, unit = e.get("meter.count"), e.get("meter.unit")
        if count and unit:
            meter["length"] = Fraction(4 * int(count), int(unit))
        if e.get("midi.bpm") and piece.tempos:
            piece.tempos[-1].append((Fraction(0), float(e.get("midi.bpm"))))
        elif e.get("midi.bpm"):
            meter["bpm"] = float(e.get("midi.bpm"))

    def measure(e) -> None:
        piece.add_bar()
        bar = piece.bars[-1]
        bar.ends = state["ends"]
        bar.opens = e.get("left") in ("rptstart", "rptboth") or state.pop("opens", False)
        bar.closes = 2 if e.get("right") in ("rptend", "rptboth") else 0
        if e.get("right") == "rptboth":
            state["opens"] = True
        if "bpm" in meter:
            piece.tempos[-1].append((Fraction(0), meter.pop("bpm")))
        size = Fraction(0)
        for c in e:
            kind = _tag(c)
            if kind == "staff":
                n = int(c.get("n") or 1)
                part = staff_part.setdefault(n, len(piece.parts))
                if part == len(piece.parts):
                    piece.parts.append((f"P{part + 1}", ""))
                for k, lay in enumerate(x for x in c if _tag(x) == "layer"):
                    size = max(size, layer(lay, Fraction(0), Fraction(1), part, int(lay.get("n") or k + 1), n))
            elif kind == "tempo" and c.get("midi.bpm"):
                beat = Fraction(c.get("tstamp") or "1") - 1
                piece.tempos[-1].append((beat, float(c.get("midi.bpm"))))
            elif kind in ("dir", "repeatMark"):
                said = (c.get("func") or "".join(c.itertext())).strip().lower()
                bar.segno |= said == "segno"
                bar.coda |= said == "coda"
                bar.fine |= said == "fine"
                bar.to_coda |= said.replace(" ", "") in ("tocoda", "alcoda")
                if said.startswith(("d.c", "dacapo", "da capo")):
                    bar.jump = "capo"
                elif said.startswith(("d.s", "dalsegno", "dal segno")):
                    bar.jump = "segno"
        piece.sizes[-1] = size

    def walk(e) -> None:
        for c in e:
            kind = _tag(c)
            if kind == "measure":
                measure(c)
            elif kind == "ending":
                state["ends"] = frozenset(int(n) for n in re.findall(r"\d+", c.get("n") or "1"))
                walk(c)
                state["ends"] = frozenset()
            elif kind in ("scoreDef", "staffDef", "staffGrp"):
                metered(c)
                walk(c)
            else:
                walk(c)

    walk(root)
    return piece.rows(default_bpm, unfold)
