"""Column builders for titles, names, file names, chord labels and keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights of hints in part names, added up over all hints that a name contains.
NAME_HINTS = {
    "vocal": 8, "vocals": 8, "voice": 7, "melody": 7, "lead": 5, "singer": 5, "solo": 2, "right hand": 1.5, "rh": 1,
    "drum": -12, "percussion": -12, "bass": -5, "left hand": -4, "lh": -2, "accompan": -4, "harmony": -3, "chord": -3,
}


def clean_text(c: Column, limit: int = 300) -> Column:
    """Control characters become spaces, white space collapses, ends are trimmed, at most `limit` characters; empty: null."""
    spaced = F.regexp_replace(c, r"[\x00-\x20\x7f]+", " ")
    return F.nullif(F.substring(F.btrim(spaced), 1, limit), F.lit(""))


def ascii_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


@F.pandas_udf(T.StringType())
def normalised(s: pd.Series) -> pd.Series:
    """NFKD, lower case, letters and digits of any script: no built-in decomposes characters."""
    fold = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t).lower() if x.isalnum())
    return s.map(fold, na_action="ignore")


def strip_featured(c: Column) -> Column:
    """A title without its trailing featured artists, bracketed or not."""
    return F.btrim(F.regexp_replace(c, r"(?i)\s*[\(\[]?\s*\b(feat|ft|featuring)\b\.?\s.*$", ""))


def file_metadata(c: Column) -> Column:
    """struct(artist, title) of a file name: folder, extension and a track number go; split at the first spaced dash."""
    base = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[A-Za-z0-9]{1,5}$", "")
    base = F.btrim(F.regexp_replace(base, r"^\d{1,3}[\s._-]+", ""))
    split = base.rlike(r"\s[-–—]\s")
    artist = F.when(split, F.btrim(F.regexp_extract(base, r"^(.*?)\s[-–—]\s", 1)))
    title = F.when(split, F.btrim(F.regexp_extract(base, r"^.*?\s[-–—]\s(.*)$", 1))).otherwise(base)
    return F.struct(artist.alias("artist"), title.alias("title"))


def high_resolution(url: Column, hosts: tuple[str, ...], size: int = 1000) -> Column:
    """The last NxN of an https address of a trusted host becomes size x size; others stay null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    trusted = F.lit(False)
    for h in hosts:
        trusted = trusted | (host == h) | host.endswith("." + h)
    ok = trusted & F.lower(url).startswith("https://")
    return F.when(ok, F.regexp_replace(url, r"/\d+x\d+([a-z-]*)\.(jpg|png|webp)$", rf"/{size}x{size}$1.$2"))


_STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def _root(letter: Column, accidental: Column) -> Column:
    steps = F.create_map(*(F.lit(x) for kv in _STEPS.items() for x in kv))
    shift = F.when(accidental.isin("#", "♯"), 1).when(accidental.isin("b", "♭"), -1).otherwise(0)
    return F.pmod(F.element_at(steps, letter) + shift, F.lit(12))


def chord_strict(label: Column) -> Column:
    """struct(root, third) of a plain major or minor triad; anything else, such as a seventh: null."""
    pattern = r"^([A-G])([#b♯♭]?)(m|min)?$"
    root = _root(F.regexp_extract(label, pattern, 1), F.regexp_extract(label, pattern, 2))
    third = F.when(F.regexp_extract(label, pattern, 3) == "", 4).otherwise(3)
    return F.when(label.rlike(pattern), F.struct(root.alias("root"), third.alias("third")))


def chord_lenient(label: Column) -> Column:
    """The triad's name whatever its extensions or bass; unknown: N."""
    pattern = r"^([A-G])([#b♯♭]?)(m(?!aj)|min)?"
    name = F.concat(F.regexp_extract(label, pattern, 1), F.translate(F.regexp_extract(label, pattern, 2), "♯♭", "#b"), F.when(F.regexp_extract(label, pattern, 3) == "", "").otherwise("m"))
    return F.when(label.rlike(pattern), name).otherwise("N")


def clock(seconds: Column) -> Column:
    """m:ss, rounded down; not a finite non-negative number: 0:00."""
    whole = F.floor(seconds)
    good = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < 1e15)
    return F.when(good, F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))).otherwise("0:00")


def name_score(name: Column, hints: dict[str, float] = NAME_HINTS) -> Column:
    total = F.lit(0.0)
    for hint, weight in hints.items():
        total = total + F.when(F.lower(name).contains(hint), weight).otherwise(0)
    return F.coalesce(total, F.lit(0))


def sha256_text(c: Column) -> Column:
    """A trimmed lower-case SHA-256 digest, or null."""
    low = F.lower(F.btrim(c))
    return F.when(low.rlike("^[a-f0-9]{64}$"), low)


def data_url(data: Column, mime: Column) -> Column:
    """A base64 data address; image/jpg becomes image/jpeg."""
    kind = F.regexp_replace(F.lower(F.btrim(mime)), "^(image/)?jpe?g$", "image/jpeg")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(data))


def cue_id(index: Column, start_us: Column, midi: Column) -> Column:
    """note-{index}-{milliseconds, half up}-{midi}."""
    return F.concat_ws("-", F.lit("note"), index.cast("string"), F.floor((start_us + 500) / 1000).cast("string"), midi.cast("string"))


def all_digits(c: Column) -> Column:
    return c.rlike(r"^\d+$")


def suffix(c: Column) -> Column:
    """The lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(c, r"(\.[A-Za-z0-9]+)$", 1))


def is_audio_name(c: Column, extension: str = "mp3") -> Column:
    return c.rlike(rf"(?i)\.{extension}$")


def matches_search(query: str, *columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns)).contains(query.lower())
