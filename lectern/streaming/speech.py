"""Per-take state machines over frames and recogniser events, as folds for batch and stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Limits:
    """Times in milliseconds, levels as peaks. Fixed values of the endpointing."""

    floor: float = 0.02
    over_noise: float = 3.0
    start: float = 120
    silence: float = 1000
    least_speech: float = 250
    longest: float = 30000
    nothing: float = 10000
    needs_interim: bool = False


def long_take(words: int, limits: Limits = Limits()) -> Limits:
    """Check mode: a recognised word is needed, and takes above 12 words wait longer for silence."""
    return Limits(silence=min(1800, limits.silence + 50 * max(0, words - 12)), needs_interim=True, longest=float("inf"), nothing=float("inf"))


@dataclass
class Take:
    """State of one take; ``step`` returns what happened at a frame, if anything."""

    limits: Limits = field(default_factory=Limits)
    noise: float = 0.0
    began: float | None = None
    voiced_since: float | None = None
    speech_at: float | None = None
    last_voice: float = 0.0
    interim: bool = False
    done: bool = False

    def step(self, t: float, peak: float, interim: bool = False) -> str | None:
        if self.done:
            return None
        x = self.limits
        self.began = t if self.began is None else self.began
        self.interim |= interim
        voiced = peak > max(x.floor, self.noise * x.over_noise)
        if not voiced:
            self.noise = 0.95 * self.noise + 0.05 * peak
        if self.speech_at is None:
            self.voiced_since = (t if self.voiced_since is None else self.voiced_since) if voiced else None
            if voiced and t - self.voiced_since >= x.start:
                self.speech_at = self.last_voice = t
                return "speech"
            if t - self.began > x.nothing:
                self.done = True
                return "nothing"
            return None
        if voiced:
            self.last_voice = t
        enough = t - self.speech_at >= x.least_speech and (self.interim or not x.needs_interim)
        if (enough and t - self.last_voice >= x.silence) or t - self.began >= x.longest:
            self.done = True
            return "stop"
        return None


EVENTS = "take string, t double, event string"


def endpoints(frames: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(take, t, event) of every take; frames have take, t, peak and may have interim. A take is bounded by its longest time."""
    has_interim = "interim" in frames.columns

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, take, out = rows.sort_values("t", kind="stable"), Take(limits), []
        for r in rows.itertuples(index=False):
            event = take.step(r.t, r.peak, bool(r.interim) if has_interim else False)
            if event:
                out.append((r.take, r.t, event))
        return pd.DataFrame(out, columns=["take", "t", "event"])

    return frames.groupBy("take").applyInPandas(fold, EVENTS)


def endpoints_stream(frames: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same on a stream: the state of a take is kept between micro-batches. Frames of a take must come in order."""
    names = ("noise", "began", "voiced_since", "speech_at", "last_voice", "interim", "done")
    state_schema = "noise double, began double, voiced_since double, speech_at double, last_voice double, interim boolean, done boolean"

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        take = Take(limits, **dict(zip(names, state.get))) if state.exists else Take(limits)
        out = []
        for rows in batches:
            for r in rows.sort_values("t", kind="stable").itertuples(index=False):
                if event := take.step(r.t, r.peak):
                    out.append((key[0], r.t, event))
        state.update(tuple(getattr(take, n) for n in names))
        yield pd.DataFrame(out, columns=["take", "t", "event"])

    return frames.groupBy("take").applyInPandasWithState(fold, EVENTS, state_schema, "append", "NoTimeout")


def transcript(events: Iterable[tuple[int, str, list[str]]], generation: int) -> list[list[str]]:
    """Final results of a generation in order, each with its alternatives; without any, the last interim stands in.

    Events are (generation, kind, texts); those of another generation are stale.
    """
    finals: list[list[str]] = []
    interim = ""
    for gen, kind, texts in events:
        if gen != generation:
            continue
        kept = [t.strip() for t in texts if t and t.strip()]
        if kind == "final" and kept:
            finals.append(kept)
        elif kind == "interim" and kept:
            interim = kept[0]
    return finals or ([[interim]] if interim else [])


@dataclass
class Loop:
    """Record, play, continue: what comes after a scored take. Three misses reveal the text and count as a pass."""

    after: str = "next"
    misses: int = 0

    def scored(self, passed: bool) -> str:
        self.misses = 0 if passed else self.misses + 1
        revealed = self.misses >= 3
        if self.after == "stop":
            return "wait"
        if not passed and not revealed:
            return "again"
        self.misses = 0
        return "again" if self.after == "repeat" else "advance"
