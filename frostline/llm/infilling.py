"""Fill-in-the-middle: descriptions cut at two ranks of units, found by an indexable skip list."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.llm.columns import arrow_rows, given, quoted

CODE_POINT = r"(?s)."
STEP = 8  # units of one lane that the next lane passes at once
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class Lanes(NamedTuple):
    """An indexable skip list of a text's units: lane 0 has a link a unit, each further lane one for ``STEP`` links below.

    A link carries its width twice: in units and in code points.
    """

    units: list[np.ndarray]
    chars: list[np.ndarray]

    @property
    def n_units(self) -> int:
        return int(self.units[-1].sum())

    def chars_at(self, rank: int) -> int:
        """Code points of the first ``rank`` units.

        From the highest lane down, links are passed while their units fit into what is left of the rank; each lane leaves
        less than one of its links to the next. In the highest lane there are at most ``STEP`` links.
        """
        passed = 0
        at = 0  # number of the link, in the lane's own count
        for units, chars in zip(reversed(self.units), reversed(self.chars)):
            at *= STEP
            while rank and at < len(units) and units[at] <= rank:
                rank -= int(units[at])
                passed += int(chars[at])
                at += 1
        return passed


def unit_lanes(widths: np.ndarray) -> Lanes:
    """The skip list of units with these widths in code points."""
    units, chars = [np.ones(len(widths), np.int64)], [widths.astype(np.int64)]
    while len(units[-1]) > STEP:
        starts = np.arange(0, len(units[-1]), STEP)
        units.append(np.add.reduceat(units[-1], starts))
        chars.append(np.add.reduceat(chars[-1], starts))
    return Lanes(units, chars)


def unit_widths(text: str, pattern: str) -> np.ndarray:
    """Code points of each unit: the non-empty matches from left to right, and the stretches between them."""
    if pattern == CODE_POINT:
        return np.ones(len(text), np.int32)
    edges = {0, len(text)}
    for match in regex.finditer(pattern, text):
        edges.update(match.span())
    return np.diff(np.array(sorted(edges), np.int64))


def drawn(event_id: Column, seed: int, k: int) -> Column:
    """The ``k``-th (from 1) unsigned 32-bit number of an event: from the SHA-256 digest of ``seed:event_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(event_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _checked(marks: tuple[str, str, str]) -> None:
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks must differ, and none may begin with what another ends with: {marks}")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text behind an output and its form.

    A cut text holds no mark, and no mark begins with what one ends with, so the first place of each is the one set.
    """
    p, s, m = marks
    at = {mark: F.position(F.lit(mark), output) for mark in marks}

    def between(mark: str, after: Column | None) -> Column:
        begin = at[mark] + len(mark)
        return F.substr(output, begin, after - begin) if after is not None else F.substr(output, begin)

    psm = F.concat(between(p, at[s]), between(m, None), between(s, at[m]))
    spm = F.concat(between(p, at[m]), between(m, None), between(s, at[p]))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def fill_in_middle(events: DataFrame, event_id: str = "event_id", description: str = "description", *, seed: int = 1,
                   percent: int = 90, spm_percent: int = 20, unit: str = CODE_POINT,
                   marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Cut traffic event descriptions in three for infilling: adds ``n_units``, ``form``, ``prefix_chars``, ``middle_chars``,
    ``infill``.

    A description is cut into units: the matches of ``unit`` from left to right and what lies between them (by default
    each code point is one). Four numbers are drawn from the seed and id, so a row's cut does not depend on others. Of
    the first two, each modulo the units and one more, the smaller ends the prefix and the larger the middle; the rest is
    the suffix. An indexable skip list over the units gives the code points at both ranks. ``percent`` of the texts are
    cut, ``spm_percent`` of these with the suffix first (form ``spm``), the others with the prefix first (``psm``). Texts
    that are empty or hold a mark are left as they are (``plain``, null for both lengths). ``infill`` is the result, with
    the marks before prefix, suffix and middle; ``restored`` gives the text back.

    Null descriptions count as empty; a null id is drawn as an empty one, and repeated rows are cut alike. Given columns
    of the results' names are replaced; all others stay. Whole texts are cut, each in its task; an empty table gives an
    empty result.
    """
    _checked(marks)
    p, s, m = marks
    text, key = given(description), F.col(quoted(event_id))
    whole = (text == "") | (drawn(key, seed, 3) % 100 >= percent)
    for mark in marks:
        whole = whole | text.contains(mark)
    form = F.when(whole, PLAIN).when(drawn(key, seed, 4) % 100 < spm_percent, SPM).otherwise(PSM)
    results = [T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType()),
               T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
               T.StructField("infill", T.StringType())]
    parts: dict[str, Callable[[str, str, str], tuple]] = {
        PSM: lambda a, b, c: (p, a, s, c, m, b), SPM: lambda a, b, c: (s, c, p, a, m, b)}

    def cut(columns: list[pa.Array]) -> list[pa.Array]:
        rows = []
        for kind, first, second, given_text in zip(*[c.to_pylist() for c in columns]):
            lanes = unit_lanes(unit_widths(given_text, unit))
            n = lanes.n_units
            if kind == PLAIN:
                rows.append((n, kind, None, None, given_text))
                continue
            low, high = sorted((first % (n + 1), second % (n + 1)))
            a, b = lanes.chars_at(low), lanes.chars_at(high)
            out = "".join(parts[kind](given_text[:a], given_text[a:b], given_text[b:]))
            rows.append((n, kind, a, b - a, out))
        columns = list(zip(*rows)) if rows else [[]] * len(results)
        return [pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(columns, results)]

    inputs = {"form": form, "first": drawn(key, seed, 1), "second": drawn(key, seed, 2), "text": text}
    return arrow_rows(events, inputs, results, cut)
