"""UUID text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = "[0-9a-fA-F]"
_DASHED = rf"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"
_PLAIN_FORM = rf"\A{_DASHED}\z"
_OTHER_FORMS = rf"\A(?:(?i:urn:uuid:){_DASHED}|\{{{_DASHED}\}}|{_HEX}{{32}})\z"
_GROUPS = r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z"


def canonical_uuid(text: Column) -> Column:
    """Lower-case 36-character form of a UUID, NULL when the text is not one.

    Accepted: dashed, ``urn:uuid:`` prefixed, braced, and 32 bare hex digits.
    """
    bare = F.regexp_replace(F.lower(text), r"\Aurn:uuid:|[{}-]", "")
    return F.when(text.rlike(_PLAIN_FORM), F.lower(text)).when(
        text.rlike(_OTHER_FORMS), F.regexp_replace(bare, _GROUPS, "$1-$2-$3-$4-$5")
    )
