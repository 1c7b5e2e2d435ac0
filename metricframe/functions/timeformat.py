"""``strftime`` patterns as Spark SQL: date_format where it has the piece, arithmetic where it has not."""

from __future__ import annotations

import re

_PIECES = dict(
    pair.split("=")
    for pair in (
        "%f=SSSSSS %p=a %Q=Q %j=DDD %-j=D %A=EEEE %a=EEE %B=MMMM %b=MMM %y=yy %Y=yyyy %m=MM %-m=M %d=dd %-d=d "
        "%S=ss %-S=s %M=mm %-M=m %I=hh %-I=h %H=HH %-H=H"
    ).split()
)
_WEEK = "CAST(floor((dayofyear({t}) + 6 - {day}) / 7) AS STRING)"
_SUNDAY, _MONDAY = "(dayofweek({t}) - 1)", "((dayofweek({t}) + 5) % 7)"
_COMPUTED = {
    "%w": f"CAST({_SUNDAY} AS STRING)",
    "%U": f"lpad({_WEEK.replace('{day}', _SUNDAY)}, 2, '0')",
    "%-U": _WEEK.replace("{day}", _SUNDAY),
    "%W": f"lpad({_WEEK.replace('{day}', _MONDAY)}, 2, '0')",
    "%-W": _WEEK.replace("{day}", _MONDAY),
    # Times without a zone are in UTC.
    "%z": "'+00'",
    "%Z": "''",
}


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def format_sql(fmt: str, time: str) -> str:
    """The Spark SQL for a format of the expression ``time``; null stays null.

    >>> format_sql("%Y!", "t")
    "date_format(t, 'yyyy\\\\'!\\\\'')"
    """
    parts: list[tuple[str, str]] = []  # (kind, text); kind is piece, text or sql
    for token in re.findall(r"%-?[A-Za-z%]|%|[^%]+", fmt):
        if token in _PIECES:
            parts.append(("piece", _PIECES[token]))
        elif token in _COMPUTED:
            parts.append(("sql", _COMPUTED[token].replace("{t}", time)))
        elif token == "%%" or token[0] != "%":
            text = "%" if token == "%%" else token
            if parts and parts[-1][0] == "text":
                text = parts.pop()[1] + text
            parts.append(("text", text))
        else:
            raise ValueError(f"the format has {token}, which is not supported")
    made: list[str] = []
    pattern = ""
    for kind, text in [*parts, ("sql", "")]:
        if kind == "piece":
            pattern += text
        elif kind == "text":
            pattern += "'" + text.replace("'", "''") + "'"
        else:
            if pattern:
                made.append(f"date_format({time}, {quoted(pattern)})")
            made += [text] if text else []
            pattern = ""
    if len(made) == 1 and made[0].startswith("date_format"):
        return made[0]
    return f"CASE WHEN {time} IS NOT NULL THEN concat({', '.join(made)}) END" if made else f"CASE WHEN {time} IS NOT NULL THEN '' END"
