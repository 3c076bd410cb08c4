"""Scalar functions as column expressions (FN-*). Null in, null out; malformed values give null and never end a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by extension.
MIME = {
    "mkv": "video/x-matroska", "mp4": "video/mp4", "m4v": "video/mp4", "avi": "video/x-msvideo", "mov": "video/quicktime", "mp3": "audio/mpeg", "flac": "audio/flac",
    "m4a": "audio/mp4", "wav": "audio/wav", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "srt": "application/x-subrip",
    "pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "json": "application/json", "xml": "application/xml", "html": "text/html", "htm": "text/html", "zip": "application/zip",
}
#: Milliseconds of a duration's unit.
UNITS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
#: A tag, alias or forest name.
NAME = "^[a-z0-9][a-z0-9_-]{0,63}$"


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; the whole name if there is none (T-22)."""
    return F.lower(F.element_at(F.split(name, "\\."), -1))


def guess_mime(name: Column) -> Column:
    """The media type of a name's extension, application/octet-stream if unknown (FN-06)."""
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.when(name.isNotNull(), F.coalesce(F.try_element_at(table, extension(name)), F.lit("application/octet-stream")))


def has_extension(name: Column, wanted: Column) -> Column:
    """Whether a name's extension is in a list, separated by commas, of extensions in lower case; an empty list takes every name (FLT-04)."""
    some = F.filter(F.transform(F.split(wanted, ","), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(some) == 0) | F.array_contains(some, extension(name))


def format_rights(rights: Column) -> Column:
    """rwa letters, - for none (FN-07)."""
    letters = F.concat(*[F.when(rights.bitwiseAND(bit) != 0, c).otherwise("") for bit, c in ((1, "r"), (2, "w"), (4, "a"))])
    return F.when(letters == "", "-").otherwise(letters)


def parse_rights(text: Column) -> Column:
    """Bits of the letters r, w and a, in any order and number; 0 for empty, - and none; null with any other letter (FN-07)."""
    bits = sum((F.when(F.contains(text, F.lit(c)), bit).otherwise(0) for bit, c in ((2, "w"), (4, "a"))), F.when(F.contains(text, F.lit("r")), 1).otherwise(0))
    return F.when(text.isin("", "-", "none"), 0).when(text.rlike("^[rwa]+$"), bits)


def principal_kind(text: Column) -> Column:
    """0 any, 1 key, 2 public, 3 tag; null if malformed (FN-08)."""
    return F.when(text == "any", 0).when(text.rlike("^key:[0-9a-f]+$"), 1).when(text == "public", 2).when(text.rlike("^tag:[a-z0-9][a-z0-9_-]{0,63}$"), 3)


def valid_tag(text: Column) -> Column:
    """Whether text is a tag or an alias: up to 64 of a-z, 0-9, - and _, the first a letter or digit (FN-09, FN-14)."""
    return text.rlike(NAME)


def mount_slug(path: Column) -> Column:
    """mount and the path, in lower case, with - for whatever is no ASCII letter or digit (FN-14)."""
    return F.concat(F.lit("mount"), F.translate(F.regexp_replace(path, "[^A-Za-z0-9]", "-"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def default_visibility(node_type: Column, prefixes: tuple[str, ...] = ("user.", "config.", "event."), types: tuple[str, ...] = ()) -> Column:
    """private for the types given and those that begin with a prefix, else public (FN-23)."""
    private = node_type.isin(*types)
    for p in prefixes:
        private = private | node_type.startswith(p)
    return F.when(private, "private").when(node_type.isNotNull(), "public")


def duration_ms(text: Column) -> Column:
    """45s, 30m, 12h, 7d, 2w, or @ and milliseconds; null if malformed, zero after @, or beyond 64 bits (FN-10)."""
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    counted = F.regexp_extract(text, "^([0-9]+)[smhdw]$", 1)
    exact = F.regexp_extract(text, "^@([0-9]+)$", 1).try_cast("long")
    return F.when(counted != "", F.try_multiply(counted.try_cast("long"), F.try_element_at(unit, F.substring(text, -1, 1)))).when(exact > 0, exact)


def safe_name(name: Column, key: Column) -> Column:
    """Slashes and control characters become _ and spaces at the ends go; what is then empty, . or .. becomes node- and the key's first eight characters (FN-12)."""
    clean = F.regexp_replace(F.regexp_replace(name, "[/\\x00-\\x1F\\x7F-\\x{9F}]", "_"), "^\\p{Z}+|\\p{Z}+$", "")
    return F.when(clean.isin("", ".", ".."), F.concat(F.lit("node-"), F.substring(key, 1, 8))).otherwise(clean)


def uri_parts(uri: Column) -> dict[str, Column]:
    """scheme, host, path of an address (FLT-10)."""
    return {"scheme": F.regexp_extract(uri, "^([a-z][a-z0-9+.-]*)://", 1), "host": F.regexp_extract(uri, "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), "path": F.regexp_extract(uri, "^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)}


def location_parts(uri: Column, local: str = "file", temp: str = "temp", store: str = "store", remote: str = "host", tree: str = "tree") -> dict[str, Column]:
    """kind, owner, path of a location by its scheme; all null if it has none of these forms (FLT-10).

    local:///path is a file here, temp:///path one in the spool, store:///id an object of the store, remote://pin/path a file of the instance of
    that pin, and tree://name[@server]/path a place in a forest, whose path may be empty.
    """
    of = lambda pattern, group: F.nullif(F.regexp_extract(uri, pattern, group), F.lit(""))
    here, spool, held = (f"^{s}://(/.+)$" for s in (local, temp, store))
    away, named = f"^{remote}://([^/]+)(/.+)$", f"^{tree}://([^/@]+(?:@[^/]*)?)(?:/(.*))?$"
    kind = F.when(uri.rlike(here), "local").when(uri.rlike(spool), "temp").when(uri.rlike(held), "store").when(uri.rlike(away), "remote").when(uri.rlike(named), "tree")
    path = F.coalesce(of(here, 1), of(spool, 1), F.substring(of(held, 1), 2, 1 << 30), of(away, 2), F.when(uri.rlike(named), F.regexp_extract(uri, named, 2)))
    return {"kind": kind, "owner": F.coalesce(of(away, 1), of(named, 1)), "path": path}


def region_address(text: Column) -> dict[str, Column]:
    """root, host, seq of an address <64 hex digits>/g-<top or up to 8 hex digits>-<number>.db; all null if malformed (FLT-11). Nothing else passes, so no address leaves its folder."""
    pattern = "^([0-9a-f]{64})/g-(top|[0-9a-f]{1,8})-([1-9][0-9]*)\\.db$"
    of = lambda group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return {"root": of(1), "host": of(2), "seq": of(3).try_cast("long")}


def shard(key: Column) -> Column:
    """The first two characters, a slash and the key (FN-15)."""
    return F.concat(F.substring(key, 1, 2), F.lit("/"), key)


def segments(path: Column) -> Column:
    """The non-empty segments of a path (FN-13)."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def byte_range(text: Column) -> dict[str, Column]:
    """start and end of START-END, end exclusive and optional; both null if malformed or beyond 64 bits (FN-28)."""
    number = lambda group: F.regexp_extract(text, "^([0-9]+)-([0-9]*)$", group)
    start, end = (number(i).try_cast("long") for i in (1, 2))
    good = start.isNotNull() & ((number(2) == "") | end.isNotNull())
    return {"start": F.when(good, start), "end": F.when(good, end)}


def ranged(content: Column, start: Column, end: Column) -> Column:
    """The bytes from start to end, exclusive, of binary content; start and end 0 give all; null if the range doesn't lie within (SRC-13, RD-10)."""
    size = F.octet_length(content)
    inside = (start >= 0) & (end >= start) & (end <= size)
    return F.when((start == 0) & (end == 0), content).when(inside, F.substring(content, (start + 1).cast("int"), (end - start).cast("int")))


def remaining(ms: Column) -> Column:
    """Milliseconds as the largest of weeks, days, hours, minutes, rounded down, or seconds, rounded up; expired from 0 down (FN-11)."""
    out = F.when(ms <= 0, "expired")
    for unit in "wdhm":
        out = out.when(ms >= UNITS[unit], F.concat(F.floor(ms / UNITS[unit]).cast("string"), F.lit(unit)))
    return out.otherwise(F.concat(F.ceil(ms / UNITS["s"]).cast("string"), F.lit("s")))


def pi_hex(n: int = 1024) -> str:
    """The first n hex digits of pi's fraction, by Machin's formula on integers."""
    one = 1 << (4 * n + 64)

    def arctan(x: int) -> int:
        total, term, k, sign = 0, one // x, 1, 1
        while term:
            total += sign * (term // k)
            term, k, sign = term // (x * x), k + 2, -sign
        return total

    return f"{(4 * (4 * arctan(5) - arctan(239)) - 3 * one) >> 64:0{n}X}"


def checkpoint(position: Column, digits: str, width: int = 32) -> Column:
    """width hex digits of `digits` from position * width on, modulo what leaves room for them (FN-20); see pi_hex."""
    return F.substring(F.lit(digits), (F.pmod(position * width, F.lit(len(digits) - width)) + 1).cast("int"), F.lit(width))
