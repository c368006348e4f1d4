"""Page cursors that fit one scope only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Start and factor of the 32-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 2_166_136_261, 16_777_619


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text, as hex without leading zeros. The product of a hash and the factor fits
    into a long, so a fold over the units needs no other arithmetic."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    places = F.filter(F.sequence(F.lit(0), F.length(text) * 2), lambda i: i * 4 < F.length(units))
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substr(units, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long")) * F.lit(FNV_FACTOR)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.hex(F.aggregate(places, F.lit(FNV_START).cast("long"), step)))


def base64url(text: Column) -> Column:
    """URL-safe base64 without line ends and padding."""
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def encoded(at: Column, key: Column, scope: Column) -> Column:
    """Cursor of a position: a time as it is written, an id, and the fingerprint of the scope it was made for."""
    body = F.to_json(F.struct(F.lit(1).alias("v"), at.alias("t"), key.alias("id"), fnv1a(scope).alias("s")))
    return base64url(body)


# What a cursor's time and id look like.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}(:?\d{2})?)$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def decoded(token: Column, scope: Column) -> Column:
    """Struct t, id of a cursor; null for one that is malformed, of another version or of another scope."""
    plain = F.translate(token, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int")))
    whole = F.when(token.rlike("^[A-Za-z0-9_-]+$") & (F.length(token) % 4 != 1), F.unbase64(padded))
    read = F.from_json(F.decode(whole, "UTF-8"), "v int, t string, id string, s string")
    fits = (read["v"] == 1) & (read["s"] == fnv1a(scope)) & read["t"].rlike(RFC3339) & (F.length(read["t"]) <= 64) & read["t"].try_cast("timestamp").isNotNull() & read["id"].rlike(UUID)
    return F.when(fits, F.struct(read["t"].alias("t"), F.lower(read["id"]).alias("id")))
