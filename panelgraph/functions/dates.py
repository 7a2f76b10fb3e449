"""Date and period expressions.

Text dates are read by their shape: one regular expression with an alternative per form takes the fields
apart, they are put together again as ISO text, and that is cast once. A value of no known form costs one
failed match and one failed cast, however many forms there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelgraph.fixed_values import ARTICLE_TIME_FORMATS, EVENT_DATE_FORMATS

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Letters of a form -> what they match. Ranges are part of it, so 13/1/2020 is not month 13.
FIELDS = {
    "yyyy": r"\d{4}", "MMMM": "|".join(MONTHS), "MMM": "|".join(m[:3] for m in MONTHS), "MM": "0[1-9]|1[0-2]", "M": "1[0-2]|0?[1-9]",
    "dd": "0[1-9]|[12][0-9]|3[01]", "d": "3[01]|[12][0-9]|0?[1-9]", "HH": "[01][0-9]|2[0-3]", "H": "1[0-9]|2[0-3]|0?[0-9]",
    "mm": "[0-5][0-9]", "m": "[0-5]?[0-9]", "ss": "[0-5][0-9]", "s": "[0-5]?[0-9]",
}
_PIECES = re.compile(r"'([^']*)'|(y+|M+|d+|H+|m+|s+)|(.)")


def shape(form: str) -> tuple[str, list[str]]:
    """A form such as ``M/d/yyyy`` as a regular expression with one group a field, and the fields' letters in order."""
    out, letters = [], []
    for quoted, field, other in _PIECES.findall(form):
        if field:
            if field not in FIELDS:
                raise ValueError(f"{field!r} in the date form {form!r} is not one of {', '.join(FIELDS)}")
            out.append(f"({FIELDS[field]})")
            letters.append(field[0])
        elif other.isalpha():
            raise ValueError(f"{other!r} in the date form {form!r} is no field; quote it to mean the letter")
        else:
            out.append(re.escape(quoted or other))
    if sorted(set(letters)) != sorted(letters) or not {"y", "M", "d"} <= set(letters):
        raise ValueError(f"the date form {form!r} must name year, month and day once")
    return "".join(out), letters


def _readers(forms: Sequence[str]) -> tuple[str, dict[str, str]]:
    """One expression for all forms, the first that fits winning, and per letter its groups in a replacement."""
    shapes = [shape(form) for form in forms]
    refs: dict[str, str] = {}
    for at, letter in enumerate((letter for _, letters in shapes for letter in letters), start=1):
        refs[letter] = f"{refs.get(letter, '')}${at}"  # a group that did not take part gives nothing
    return "(?i)^(?:" + "|".join(s for s, _ in shapes) + ")$", refs


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a filter would evaluate it again at every mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(iso: Column) -> Column:
    """Names of months in ``2020-March-5`` to numbers."""
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, start=1) for name in {m, m[:3]} for x in (name.lower(), str(i))])
    named = _once(F.split(iso, "-", 3), lambda p: F.concat_ws("-", F.get(p, 0), F.try_element_at(numbers, F.lower(F.get(p, 1))), F.get(p, 2)))
    return F.when(iso.rlike(r"^\d{4}-[A-Za-z]"), named).otherwise(iso)


def lenient_date(text: Column, formats: Sequence[str] = EVENT_DATE_FORMATS) -> Column:
    """ISO text, else the first of ``formats`` that fits, else NULL; month before day where both could be."""
    iso = F.trim(text.cast("string"))
    if formats:
        pattern, refs = _readers(formats)
        iso = F.regexp_replace(iso, pattern, f"{refs['y']}-{refs['M']}-{refs['d']}")
    named = any("MMM" in f for f in formats)
    # a bare number of five digits and more would be a year
    return _once(iso, lambda c: F.when(~c.rlike(r"^\d{5}"), (_numbered(c) if named else c).try_cast("date")))


def event_date(start: Column, end: Column, year: Column) -> Column:
    """Start date, else end date, else 1 January of the year, else NULL.

    Each value is parsed on its own, so a column may mix forms.
    """
    return F.coalesce(
        lenient_date(start),
        lenient_date(end),
        F.concat(F.trim(year.cast("string")), F.lit("-01-01")).try_cast("date"),
    )


def article_time(text: Column, formats: Sequence[str] = ARTICLE_TIME_FORMATS) -> Column:
    """The time in UTC by the first format that fits; NULL when none does. A format without a time of day means midnight."""
    clean = F.trim(text)
    timed, dated = [f for f in formats if "H" in f], [f for f in formats if "H" not in f]
    out = []
    for forms, rest in ((timed, "T{H}:{m}:{s}Z"), (dated, "T00:00:00Z")):
        if forms:
            pattern, refs = _readers(forms)
            iso = F.regexp_replace(clean, pattern, ("{y}-{M}-{d}" + rest).format(**refs))
            iso = _numbered(iso) if any("MMM" in f for f in forms) else iso
            out.append(F.when(clean.rlike(pattern), iso.try_cast("timestamp")))
    return F.coalesce(*out)


def month_start(c: Column) -> Column:
    return F.trunc(c.cast("date"), "MM")


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def is_partial_month(month: Column, first: Column, last: Column) -> Column:
    """Whether observations from ``first`` to ``last`` leave this month only partly covered.

    The first month is partial when it starts more than a day late, the last month when it
    stops more than a day before its last second.
    """
    begins = month.cast("timestamp")
    ends = F.expr("interval 1 day") + F.last_day(month).cast("timestamp") - F.expr("interval 1 second")
    one_day = F.expr("interval 1 day")
    starts_late = (month == month_start(first)) & (first > begins + one_day)
    stops_early = (month == month_start(last)) & (last < ends - one_day)
    return F.coalesce(starts_late | stops_early, F.lit(False))
