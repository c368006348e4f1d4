"""Object keys, file names and keyed tokens."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of object keys, tokens of trial files, prefixes of file names, species.
IDENTIFIER = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
CANONICAL = rf"^clips/([^/]+)/(\d{{4}}-\d{{2}}-\d{{2}})/(.+)_({IDENTIFIER})\.mp4$"
DATED = rf"^clips/(\d{{4}})/(\d{{2}})/(\d{{2}})/([^/]+)/({IDENTIFIER})\.mp4$"
TRIAL_TOKENS = ("verify/", "experiment", "eval", "test", "tmp", "sample")
NAME_CLASSES = {"not-drinking": "moving", "hand-feeding": "hand_feeding", "eating-paste": "eating_paste", "eating-prey": "eating_prey", "drinking": "drinking"}
SPECIES = {"crested-gecko": "crested_gecko", "gargoyle-gecko": "gargoyle_gecko", "leopard-gecko": "leopard_gecko"}


def parsed(key: Column) -> Column:
    """pattern, camera, date and clip of a key; the last three are null for an unknown shape."""
    part = lambda shape, n: F.regexp_extract(key, shape, n)
    told = lambda pattern, camera, date, clip: F.struct(F.lit(pattern).alias("pattern"), camera.alias("camera"), date.alias("date"), clip.alias("clip"))
    none = F.lit(None).cast("string")
    return (
        F.when(key.rlike(CANONICAL), told("canonical_clip", part(CANONICAL, 1), part(CANONICAL, 2), F.lower(part(CANONICAL, 4))))
        .when(key.rlike(DATED), told("legacy_dated_clip", part(DATED, 4), F.concat_ws("-", part(DATED, 1), part(DATED, 2), part(DATED, 3)), F.lower(part(DATED, 5))))
        .otherwise(told("unknown", none, none, none))
    )


def trial(key: Column) -> Column:
    """Whether a key looks like that of a trial or a check."""
    lowered = F.lower(key)
    out = F.lit(False)
    for token in TRIAL_TOKENS:
        out = out | F.contains(lowered, F.lit(token))
    return out


def classified(pattern: Column, key: Column, known: Column) -> Column:
    """class and confidence of a key: known beats its shape, its shape beats a trial's name."""
    told = lambda name, sure: F.struct(F.lit(name).alias("class"), F.lit(sure).alias("confidence"))
    return (
        F.when(known, told("known_camera_clip", "none"))
        .when(pattern == "canonical_clip", told("likely_missing_camera_clip", "medium"))
        .when(pattern == "legacy_dated_clip", told("manual_review_clip", "low"))
        .when(trial(key), told("experiment_artifact", "none"))
        .otherwise(told("unknown_pattern", "none"))
    )


def class_of_name(name: Column) -> Column:
    """Class that a file's name begins with; null for none. Longer prefixes are looked at first."""
    lowered, out = F.lower(name), None
    for prefix in sorted(NAME_CLASSES, key=lambda p: (-len(p), p)):
        hit = F.startswith(lowered, F.lit(prefix))
        out = F.when(hit, NAME_CLASSES[prefix]) if out is None else out.when(hit, NAME_CLASSES[prefix])
    return out


def species(code: Column, default: str = "crested_gecko") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SPECIES.items() for x in pair])[code], F.lit(default))


def keyed_token(secret: bytes, namespace: str, value: Column, length: int = 16) -> Column:
    """First hex digits of HMAC-SHA-256 over namespace, a zero byte and the value, from two plain digests."""
    block = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    message = F.concat(F.lit(inner + namespace.encode() + b"\0"), F.encode(value, "UTF-8"))
    return F.substring(F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(message, 256))), 256), 1, length)
