"""One piece in MusicXML, Kern and MEI; spines, ties, tuplets, repeats and leaps."""

import pytest

from chronoloom.sources import readers as R
from chronoloom.sources.scores import Bar, parse_kern, parse_mei, played, with_repeats

XML = """<score-partwise><part-list><score-part id="P1"><part-name>Voice</part-name></score-part><score-part id="P2"><part-name>Bass</part-name></score-part></part-list>
<part id="P1"><measure><attributes><divisions>4</divisions></attributes><direction><sound tempo="60"/></direction>
<note><pitch><step>C</step><octave>5</octave></pitch><duration>4</duration><staff>1</staff></note><note><pitch><step>F</step><alter>1</alter><octave>5</octave></pitch><duration>6</duration><staff>1</staff></note>
<note><rest/><duration>2</duration></note><note><pitch><step>B</step><alter>-1</alter><octave>4</octave></pitch><duration>4</duration><tie type="start"/><staff>1</staff></note></measure>
<measure><direction><sound tempo="120"/></direction><note><pitch><step>B</step><alter>-1</alter><octave>4</octave></pitch><duration>8</duration><tie type="stop"/><staff>1</staff></note>
<note><pitch><step>G</step><octave>4</octave></pitch><duration>8</duration><staff>1</staff></note><barline><repeat direction="backward"/></barline></measure></part>
<part id="P2"><measure><attributes><divisions>4</divisions></attributes><note><pitch><step>C</step><octave>3</octave></pitch><duration>16</duration><staff>2</staff></note></measure>
<measure><note><pitch><step>E</step><octave>3</octave></pitch><duration>8</duration><staff>2</staff></note><note><chord/><pitch><step>G</step><octave>3</octave></pitch><duration>8</duration><staff>2</staff></note>
<note><pitch><step>D</step><octave>2</octave></pitch><duration>8</duration><staff>2</staff></note><barline><repeat direction="backward"/></barline></measure></part></score-partwise>"""

KERN = """!! a piece
**kern\t**kern\t**dynam
*part2\t*part1\t*
*staff2\t*staff1\t*
*I"Bass\t*I"Voice\t*
*MM60\t*MM60\t*
1C\t4cc\tf
.\t4.ff#\t.
.\t8r\t.
.\t[4b-\tp
=2\t=2\t=2
*MM120\t*MM120\t*
2E 2G\t2b-]\t.
2DD\t2g\t.
=:|!\t=:|!\t=:|!
*-\t*-\t*-
"""

MEI = """<mei xmlns="http://www.music-encoding.org/ns/mei"><music><body><mdiv><score>
<scoreDef meter.count="4" meter.unit="4" midi.bpm="60"><staffGrp><staffDef n="1" label="Voice"/><staffDef n="2"><label>Bass</label></staffDef></staffGrp></scoreDef>
<section><measure n="1"><staff n="1"><layer n="1"><note pname="c" oct="5" dur="4"/><beam><note pname="f" oct="5" dur="4" dots="1" accid="s"/><rest dur="8"/></beam><note xml:id="t1" pname="b" oct="4" dur="4" accid.ges="f"/></layer></staff>
<staff n="2"><layer n="1"><note pname="c" oct="3" dur="1"/></layer></staff><tie startid="#t1" endid="#t2"/></measure>
<measure n="2" right="rptend"><tempo midi.bpm="120" tstamp="1"/><staff n="1"><layer n="1"><note xml:id="t2" pname="b" oct="4" dur="2"><accid accid.ges="f"/></note><note pname="g" oct="4" dur="2"/></layer></staff>
<staff n="2"><layer n="1"><chord dur="2"><note pname="e" oct="3"/><note pname="g" oct="3"/></chord><note pname="d" oct="2" dur="2"/></layer></staff></measure></section></score></mdiv></body></music></mei>"""


def plain(rows):
    return [(round(s, 9), round(d, 9), m, v, p, i, n, staff) for s, d, m, v, p, i, n, _, staff in rows]


@pytest.mark.parametrize("unfold", [True, False])
def test_three_formats_give_equal_notes(unfold):
    xml, kern, mei = (plain(parse(text.encode(), 100.0, unfold)) for parse, text in ((R.parse_musicxml, XML), (parse_kern, KERN), (parse_mei, MEI)))
    assert kern == xml == mei and len(xml) == (16 if unfold else 8)
    assert xml[0] == (0.0, 4.0, 48, 80, 1, "P2", "Bass", 2) and (3.0, 1 + 1.0, 70, 80, 0, "P1", "Voice", 1) in xml


def test_files_of_all_formats(spark, tmp_path):
    for name, text in (("a.musicxml", XML), ("b.krn", KERN), ("c.mei", MEI)):
        (tmp_path / name).write_text(text)
    rows = R.score_files(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path[-5], []).append((round(r.start, 6), round(r.duration, 6), r.midi, r.part_index))
    assert sorted(map(len, by.values())) == [16, 16, 16] and len({str(sorted(v)) for v in by.values()}) == 1


def test_kern_spines():
    """Split, exchanged and joined spines keep their part and count voices; a rational length; a chord with one length; grace notes count for nothing."""
    text = "**kern\t**kern\n*\t*^\n4C\t4c\t8e\n.\t.\t8f\n*\t*v\t*v\n*x\t*x\n4d\t4D\n8qg\t.\n3%2g\t4E 4G\n*-\t*-\n"
    rows = parse_kern(text.encode(), 60.0)
    got = [(s, d, m, p, v) for s, d, m, _, p, _, _, v, _ in rows]
    assert got == [(0.0, 1.0, 48, 1, 1), (0.0, 1.0, 60, 0, 1), (0.0, 0.5, 64, 0, 2), (0.5, 0.5, 65, 0, 2), (1.0, 1.0, 50, 1, 1), (1.0, 1.0, 62, 0, 1), (2.0, 1.0, 52, 1, 1), (2.0, 1.0, 55, 1, 1), (2.0, pytest.approx(8 / 3), 67, 0, 1)]


def test_kern_expansion_lists():
    text = "**kern\n*>[A,B,A,C]\n*>norep[A,B,C]\n*>A\n4c\n=\n*>B\n4d\n=\n*>C\n4e\n==\n*-\n"
    assert [m for _, _, m, *_ in parse_kern(text.encode())] == [60, 62, 60, 64]
    assert [m for _, _, m, *_ in parse_kern(text.encode(), unfold=False)] == [60, 62, 64]
    text = "**kern\n4c\n=!|:\n4d\n=\n4e\n=:|!\n4f\n==\n*-\n"
    assert [m for _, _, m, *_ in parse_kern(text.encode())] == [60, 62, 64, 62, 64, 65]


def test_mei_tuplets_endings_and_rests():
    layer = lambda inner: f'<staff n="1"><layer n="1">{inner}</layer></staff>'
    note = lambda p, dur: f'<note pname="{p}" oct="4" dur="{dur}"/>'
    triplet = '<tuplet num="3" numbase="2">' + note("c", 8) + note("d", 8) + note("e", 8) + "</tuplet>" + note("f", 4)
    body = f'<measure left="rptstart">{layer(triplet)}</measure><ending n="1"><measure right="rptend">{layer(note("g", 2))}</measure></ending><ending n="2"><measure>{layer(note("a", 2))}</measure></ending><measure>{layer("<mRest/>")}</measure><measure>{layer(note("b", 1))}</measure>'
    text = f'<mei><music><scoreDef meter.count="2" meter.unit="4"><staffDef n="1"/></scoreDef><section>{body}</section></music></mei>'
    rows = parse_mei(text.encode(), 60.0)
    assert [m for _, _, m, *_ in rows] == [60, 62, 64, 65, 67, 60, 62, 64, 65, 69, 71]
    assert [round(s, 6) for s, *_ in rows] == [0, 0.333333, 0.666667, 1, 2, 4, 4.333333, 4.666667, 5, 6, 10]


def order(*specs):
    """'|:' opens, ':|' closes, '[n' an ending, S sign, C coda, F fine, T to the coda, D da capo, G dal segno."""
    bars = []
    for s in specs:
        ends = frozenset({int(s[s.index("[") + 1])}) if "[" in s else frozenset()
        bars.append(Bar("|:" in s, 2 if ":|" in s else 0, ends, "S" in s, "C" in s, "F" in s, "T" in s, "capo" if "D" in s else "segno" if "G" in s else ""))
    return "".join(map(str, played(bars))), "".join(map(str, with_repeats(bars)))


@pytest.mark.parametrize(
    ("specs", "sounds"),
    [
        (("", "F", "D"), "01201"),
        (("", "S", "F", "G"), "012312"),
        (("", "T", "D", "C", ""), "0120134"),
        (("", "S", "T", "G", "C", ""), "01231245"),
        (("|:", "[1 :|", "[2", "F", "D"), "01023402" + "3"),
        (("|:", ":| D",), "010101"),
        (("F", ""), "01"),
        (("", "D"), "0101"),
    ],
)
def test_leaps(specs, sounds):
    assert order(*specs)[0] == sounds


def test_leaps_in_musicxml_and_mei():
    bar = lambda step, sound="": f'<measure>{sound}<note><pitch><step>{step}</step><octave>4</octave></pitch><duration>1</duration></note></measure>'
    text = '<score-partwise><part-list/><part id="P1">' + bar("C") + bar("D", '<direction><sound fine="yes"/></direction>') + bar("E", '<sound dacapo="yes"/>') + "</part></score-partwise>"
    assert [n[2] for n in R.parse_musicxml(text.encode())] == [60, 62, 64, 60, 62]
    note = lambda p, extra="": f'<measure><staff n="1"><layer><note pname="{p}" oct="4" dur="4"/></layer></staff>{extra}</measure>'
    text = "<mei><section>" + note("c") + note("d", "<dir>Fine</dir>") + note("e", "<dir>D.C. al Fine</dir>") + "</section></mei>"
    assert [n[2] for n in parse_mei(text.encode())] == [60, 62, 64, 60, 62]
