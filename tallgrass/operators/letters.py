"""Letters from a fixed body with named slots; who sends them and how to be left out always come from the sender's record."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that every letter has.
PRIVACY = "We use only publicly available business information to send this one-time introduction (UK GDPR Art. 14)."
OPT_OUT = "Reply 'unsubscribe' at any time and we will stop."


def _there(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def letter(body: str, slots: dict[str, Column]) -> Column:
    """The body with each {{name}} filled, null as nothing; a name without a slot is an error, not a letter."""
    parts = re.split(r"\{\{(\w+)\}\}", body)
    if missing := [n for n in parts[1::2] if n not in slots]:
        raise ValueError(f"no slot for {', '.join(missing)}")
    filled = [F.coalesce(slots[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return F.concat(F.regexp_replace(F.concat(*filled), r"^\s+|\s+$", ""), F.lit("\n"))


def offer_line(what: Column, value: Column) -> Column:
    return F.concat_ws(" — ", _there(what), _there(value))


def sender_slots(name: Column, label: Column, postal: Column, privacy: Column, url: Column, mailto: Column) -> dict[str, Column]:
    """signature, postal_address, privacy_line and optout_line of a sender."""
    return {
        "signature": F.coalesce(_there(name), _there(label), F.lit("The Team")),
        "postal_address": F.coalesce(postal, F.lit("")),
        "privacy_line": F.coalesce(F.concat(F.lit("Privacy notice: "), _there(privacy)), F.lit(PRIVACY)),
        "optout_line": F.coalesce(
            F.concat(F.lit("Don't want these emails? Unsubscribe: "), _there(url)),
            F.concat(F.lit("Don't want these emails? Reply 'unsubscribe' or email "), _there(mailto), F.lit(".")), F.lit(OPT_OUT),
        ),
    }


def as_file(to: Column, subject: Column, body: Column) -> Column:
    """A draft as the text of a file."""
    return F.concat(F.lit("To: "), to, F.lit("\nSubject: "), subject, F.lit("\n\n"), body)
