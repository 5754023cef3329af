"""String expressions, without Python rows."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that introduce a secret, and what replaces its value.
SECRET_WORDS = (
    "secret", "password", "token", "credential", "authorization", "api_key", "api-key", "api.key", "apikey",
    "access_key", "access-key", "access.key", "accesskey", "private_key", "private-key", "private.key", "privatekey",
)
SCHEME_WORD = "bearer"
REDACTED = "<redacted>"

# What a text is cut into: blanks, list items' ends, and fields. A quote that does not follow a letter or digit
# opens a quoted part, which belongs to its field with all blanks in it.
_QUOTED = r"""(?<![\p{L}\p{N}])"[^"]*"|(?<![\p{L}\p{N}])'[^']*'"""
_FIELD = rf"""(?:{_QUOTED}|[^\s,;\]}}"']+|["']){{1,500}}"""
_WORDS = (
    "secret", "password", "token", "credential", "authorization", "api_key", "api-key", "api.key", "apikey",
    "access_key", "access-key", "access.key", "accesskey", "private_key", "private-key", "private.key", "privatekey",
)
SCHEME_WORD = "bearer"
REDACTED = "<redacted>"

# What a text is cut into: blanks, list items' ends, and fields. A quote that does not follow a letter or digit
# opens a quoted part, which belongs to its field with all blanks in it.
_QUOTED = r"""(?<![\p{L}\p{N}])"[^"]*"|(?<![\p{L}\p{N}])'[^']*'"""
_FIELDS = rf"""\s+|[,;\]}}]|(?:{_QUOTED}|[^\s,;\]}}"']+|["']){{1,500}}"""
_WORDS = "|".join(word.replace(".", "[.]") for word in SECRET_WORDS)
# A field that ends with a secret's name announces the next field; one that goes on after it holds the value.
_ANNOUNCES = rf"""(?i)(?:{_WORDS})["']?[:=]?$|(?:^|[^\p{{L}}\p{{N}}_]){SCHEME_WORD}$"""
_HOLDS = rf"""(?is)^(.*?(?:{_WORDS})["']?[:=]).+$"""
# Nearly all fields have neither a quote nor a secret's name. They and the blanks and ends between them are taken as one
# plain stretch, so only the fields between are looked at; nothing in a loop here needs to go back. A name is looked for
# at its rarest letter only.
_RARE = "zkwbc"
_AT = {word: next(word.index(c) for c in _RARE if c in word) for word in (*SECRET_WORDS, SCHEME_WORD)}
_NAMES = "|".join(f"(?<={re.escape(word[:at])}){re.escape(word[at:])}" for word, at in _AT.items())
_LETTERS = _RARE + _RARE.upper()
_PLAIN = rf"""(?:[^\s,;\]}}"'{_LETTERS}]++|(?!(?i:{_NAMES}))[{_LETTERS}])++(?![^\s,;\]}}])"""
_PARTS = rf"(?:[\s,;\]}}]++|{_PLAIN})++|{_FIELD}"
_IS_PLAIN = rf"^(?:[\s,;\]}}]|{_PLAIN})"
# How a plain stretch begins if a field ahead of it announces one of its own: blanks, a lone mark with blanks, the value.
_VALUE = r"""^(\s++(?:[:=]\s++)?+)(?![:=](?:[\s,;\]}]|\z))([:=]?+)[^\s,;\]}]++"""


def blank_to_null(value: Column) -> Column:
    """Trim spaces; nothing left means the value is missing."""
    trimmed = F.trim(value)
    return F.when(trimmed != "", trimmed)


# Text without any of these holds no secret's name.
_SECRET_HINTS = (SCHEME_WORD, "secret", "password", "token", "credential", "authorization", "key")


def _masked_part(parts: Column, part: Column, place: Column) -> Column:
    """A field, masked as far as it or the field ahead of it say so; of a plain stretch only its first value may be."""
    ahead, further = F.get(parts, place - 1), F.get(parts, place - 2)
    announced = F.coalesce(ahead.rlike(r"^\s++(?:[:=]\s++)?+\z") & further.rlike(_ANNOUNCES), F.lit(False))
    mark = part.substr(1, 1)
    field = (F.when(announced & mark.isin(":", "="), F.concat(mark, F.lit(REDACTED)))
             .when(announced, F.lit(REDACTED))
             .when(part.rlike(_HOLDS), F.concat(F.regexp_extract(part, _HOLDS, 1), F.lit(REDACTED)))
             .otherwise(part))
    plain = F.when(F.coalesce(ahead.rlike(_ANNOUNCES), F.lit(False)),
                   F.regexp_replace(part, _VALUE, rf"$1$2{REDACTED}")).otherwise(part)
    return F.when(part.rlike(_IS_PLAIN), plain).otherwise(field)


def _without_secrets(value: Column) -> Column:
    # The array around the parts binds them to a name, so they are made once and not per field.
    bound = F.array(F.regexp_extract_all(value, F.lit(_PARTS), F.lit(0)))
    return F.transform(bound, lambda parts: F.array_join(
        F.transform(parts, lambda part, place: _masked_part(parts, part, place)), ""))[0]


def _without_logins(value: Column) -> Column:
    """Who logs in is what stands ahead of the last @ of a URI's authority, which ends at a slash or blank."""
    def masked(part: Column, place: Column) -> Column:
        authority = F.regexp_extract(part, r"^[^/\s]*", 0)
        shown = F.concat(F.lit(f"{REDACTED}@"), F.substring_index(authority, "@", -1), F.substr(part, F.length(authority) + 1))
        return F.when((place > 0) & authority.contains("@"), shown).otherwise(part)

    return F.array_join(F.transform(F.split(value, "://"), masked), "://")


def redact(value: Column, cap: int | None = None) -> Column:
    """Mask secrets, fold to one line and, where a cap is given, cut the result.

    A secret is a field behind a secret's name or behind the scheme word of an authorization, with a colon, an equals
    sign or just blanks between, or the login in a URI. Most text holds none, so a plain search decides whether
    it is cut into fields at all.
    """
    hinted = F.exists(F.array(F.lower(value)), lambda lowered: reduce(or_, [lowered.contains(word) for word in _SECRET_HINTS]))
    masked = F.when(hinted, _without_secrets(value)).otherwise(value)
    folded = F.when(value.contains("://"), _without_logins(masked)).otherwise(masked)
    for control in "\r\n\t":
        folded = F.replace(folded, F.lit(control), F.lit("_"))
    return folded if cap is None else F.substring(folded, 1, cap)


_CONTROLS = "".join(chr(code) for code in range(0x21))


def path_key(path: Column) -> Column:
    """Bucket and key of a file location, without scheme or leading slashes."""
    bare = F.btrim(path, F.lit(_CONTROLS))
    scheme = F.instr(bare, "://")
    rest = F.when(scheme > 0, F.substr(bare, scheme + 3)).otherwise(bare)
    return F.ltrim(rest, F.lit("/"))


def joined(values: Column) -> Column:
    """An array of names as one sorted, comma separated string."""
    return F.array_join(F.sort_array(values), ",")
