"""Normalising and classifying recognised text. Only ASCII letters change case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The vocabulary, after normalising.
GROUND = ["GND", "GROUND", "CHASSIS GROUND"]
POWER = ["B+", "BATTERY+", "BATTERY POSITIVE", "POWER FEED", "POWER SOURCE"]
SHARED = ["SHARED FUNCTION FEED"]
COLORS = ["RED", "BLACK", "WHITE", "GREEN", "BLUE", "YELLOW", "BROWN", "ORANGE", "PINK", "GRAY", "GREY", "PURPLE"]
FUNCTIONS = ["IGN", "IGNITION", "START", "STARTER", "LIGHT", "LIGHTING", "HEADLIGHT", "BRAKE", "TURN", "HORN", "NEUTRAL", "OIL", "CHARGE"]
CONNECTOR_PREFIXES = ["CONNECTOR ", "CONN "]
TERMINAL_PREFIXES = ["TERMINAL ", "PIN "]
LABEL_GROUND = ["GROUND", "GND"]


def ascii_upper(x: Column) -> Column:
    return F.translate(x, LOWER, UPPER)


def normalize(x: Column) -> Column:
    """Runs of white space, '-' and '_' as one space, none in front, upper case, without trailing '. , : ;'."""
    one = F.regexp_replace(ascii_upper(x), r"[ \t\n\x0B\f\r\-_]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(one, "^ +", ""), r"[.,:; ]+$", ""), " +$", "")


def normalize_label(x: Column) -> Column:
    """As ``normalize``, but punctuation stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_upper(x), r"[ \t\n\x0B\f\r\-_]+", " "), "^ +", ""), " +$", "")


def normalize_identity(x: Column) -> Column:
    """Without white space, '-' and '_', upper case."""
    return F.regexp_replace(ascii_upper(x), r"[ \t\n\x0B\f\r\-_]+", "")


def classify(normal: Column) -> Column:
    """The semantic kind of a normalised text."""
    starts = lambda prefixes: F.lit(False) if not prefixes else normal.startswith(prefixes[0]) | starts(prefixes[1:])
    return (
        F.when(normal.isin(GROUND), "ground_label").when(normal.isin(POWER), "power_feed_label").when(normal.isin(SHARED), "shared_function_feed_label")
        .when(normal.isin(COLORS), "wire_color").when(normal.isin(FUNCTIONS), "function_label")
        .when(starts(CONNECTOR_PREFIXES), "connector_label").when(starts(TERMINAL_PREFIXES), "terminal_label").otherwise("unknown")
    )


def label_role(label: Column) -> Column:
    """The distribution role that a label names, or null."""
    x = normalize_label(label)
    return F.when(x.isin(LABEL_GROUND), "ground").when(x.isin(POWER), "power_feed").when(x.isin(SHARED), "shared_function_feed")
