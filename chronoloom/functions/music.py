"""Column builders for pitches, times and gradings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The open strings, lowest first.
OPEN_STRINGS = (40, 45, 50, 55, 59, 64)
PERFECT, GOOD = 0.08, 0.18


def clamp(x: Column, low, high) -> Column:
    """x within bounds; NaN becomes null, for it would pass as larger than everything."""
    return F.when(~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def round_half_up(x: Column) -> Column:
    """Toward plus infinity on ties."""
    return F.floor(x + 0.5)


def frame_time(frame: Column, hop: int = 256, rate: int = 22_050, window: int = 172, samples: int = 43_844, lag: float = 0.0018) -> Column:
    """Seconds of a frame of a model that sees windows of `window` frames but only `samples` samples, and lags by `lag`.

    Each window before the frame takes the excess off; no time is negative.
    """
    excess = hop / rate * (window - samples / hop) + lag
    return F.greatest(F.lit(0.0), frame * F.lit(float(hop)) / rate - F.lit(excess) * F.floor(frame / window))


def to_frequency(midi: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (midi - 69) / 12)


def to_midi(frequency: Column) -> Column:
    return 69 + 12 * F.log2(frequency / 440)


def pitch_class(midi: Column) -> Column:
    return F.pmod(midi, F.lit(12))


def fold_octave(midi: Column, low: int, high: int) -> Column:
    """Moved by whole octaves into low to high; the range must span an octave."""
    up = F.ceil(F.greatest(F.lit(0), low - midi) / 12) * 12
    down = F.ceil(F.greatest(F.lit(0), midi - high) / 12) * 12
    return midi + up - down


def peak_offset(before: Column, here: Column, after: Column) -> Column:
    """Where a parabola through three values peaks, within half a step; flat: 0."""
    bend = before - 2 * here + after
    return F.when(bend == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (before - after) / bend)))


def grade(diff: Column, perfect=PERFECT, good=GOOD) -> Column:
    """perfect, good or miss of a signed time difference; not a number: miss."""
    d = F.abs(diff)
    return F.when(d.isNull() | F.isnan(d.cast("double")), "miss").when(d <= perfect, "perfect").when(d <= good, "good").otherwise("miss")


def circular_distance(a: Column, b: Column, period) -> Column:
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, F.lit(period) - d)


def string_midi(string_index: Column, fret: Column) -> Column:
    """Open string plus fret; a muted string (negative fret): null."""
    opened = F.element_at(F.array(*(F.lit(m).cast("long") for m in OPEN_STRINGS)), (string_index + 1).cast("int"))
    return F.when(fret >= 0, opened + fret).cast("long")


def loop_time(t: Column, start: Column, end: Column) -> Column:
    """A running clock mapped into the loop [start, end)."""
    return F.when(t < end, t).otherwise(start + F.pmod(t - start, end - start))


def strict_number(c: Column, low, high, label: str) -> Column:
    """The number in a text; anything but a finite one within bounds raises."""
    x = c.try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (x >= low) & (x <= high)
    return F.when(ok, x).otherwise(F.raise_error(F.lit(f"{label}: not a number from {low} to {high}")).cast("double"))


#: How far a score may be transposed, in semitones.
MOST_TRANSPOSE = 24


def transposition(c: Column) -> Column:
    """struct(valid, shift) of a text: "auto" has no shift, else a whole number from -24 to 24; anything else is not valid."""
    x = c.try_cast("double")
    whole = x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST_TRANSPOSE) & (x == F.floor(x))
    auto = F.coalesce(c == "auto", F.lit(False))
    return F.struct((auto | F.coalesce(whole, F.lit(False))).alias("valid"), F.when(~auto & whole, x.cast("int")).alias("shift"))


def strict_transposition(c: Column) -> Column:
    """The shift of a text, null for "auto"; an invalid one raises."""
    t = transposition(c)
    return F.when(t.valid, t.shift).otherwise(F.raise_error(F.lit("transpose must be auto or a whole number from -24 to 24")).cast("int"))


def strong_attack(broad_peak: Column, harmonic_peak: Column, broad_ratio: Column, harmonic_ratio: Column, rise_db: Column, reset_db: Column, strict: bool = False) -> Column:
    """Whether onset metrics show an attack: a peak in one band with a rise or a reset of the level, or, unless
    strict, a clear peak in both bands. Missing metrics show none."""
    if strict:
        peak = ((broad_peak >= 0.75) & (broad_ratio >= 2.7)) | ((harmonic_peak >= 0.60) & (harmonic_ratio >= 2.7))
        found = peak & ((rise_db >= 3.5) | (reset_db >= 6.0))
    else:
        peak = ((broad_peak >= 0.45) & (broad_ratio >= 2.1)) | ((harmonic_peak >= 0.38) & (harmonic_ratio >= 2.05))
        both = (broad_peak >= 0.65) & (harmonic_peak >= 0.45) & (broad_ratio >= 3.4) & (harmonic_ratio >= 2.5)
        found = peak & ((rise_db >= 2.0) | (reset_db >= 3.9) | both)
    return F.coalesce(found, F.lit(False))
