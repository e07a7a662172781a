"""Text functions as Column factories; all of them stay in the JVM."""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def _folding() -> tuple[str, str]:
    """Letters of the Basic Multilingual Plane whose NFKD form is one other character and marks, and what they become."""
    pairs = []
    for c in map(chr, range(0x80, 0x10000)):
        if not 0xD800 <= ord(c) < 0xE000 and not unicodedata.combining(c):
            base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
            if len(base) == 1 and base[0] != c:
                pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Where the Latin letters of the first plane end.
LATIN_END = 0x250


@functools.cache
def _spread() -> tuple[str, str, str]:
    """Two character classes and, as JSON, what characters become: those of the plane that stand for several (ligatures, fractions); not Hangul."""
    found = {}
    for c in map(chr, range(0x80, 0x10000)):
        if not 0xD800 <= ord(c) < 0xE000 and not 0xAC00 <= ord(c) < 0xD7A4 and not unicodedata.combining(c):
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(base) > 1:
                found[c] = base
    runs: list[list[int]] = []
    for c in map(ord, found):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    spelt = lambda runs: "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in runs) + "]"
    # few texts get past the first class, which is short
    return spelt([r for r in runs if r[0] < LATIN_END] + [[LATIN_END, 0xFFFF]]), spelt(runs), json.dumps(found)


def _by_character(text: Column, maybe: str, chars: str, table: str) -> Column:
    """Text with each character of a class replaced as a JSON object says; texts without one are not taken apart."""
    known = F.from_json(F.lit(table), "map<string,string>")
    parts = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(known, c), c))
    return F.when(text.rlike(maybe) & text.rlike(chars), F.array_join(parts, "")).otherwise(text)


def sort_key(text: Column) -> Column:
    """Text without accents and compatibility forms, in lower case, for sorting by code point; a ligature is its letters."""
    folded = F.lower(F.regexp_replace(_by_character(F.translate(text, *_folding()), *_spread()), r"\p{M}", ""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)  # ASCII has nothing to fold


@functools.cache
def _composed() -> str:
    """As JSON, pairs of a character and a mark that canonically are one character."""
    pairs = {}
    for c in map(chr, range(0xC0, 0x10000)):
        if not 0xD800 <= ord(c) < 0xE000:
            parts = unicodedata.normalize("NFD", c)
            if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c and unicodedata.combining(parts[-1]):
                pairs[unicodedata.normalize("NFC", parts[:-1]) + parts[-1]] = c
    return json.dumps(pairs)


@functools.cache
def _singletons() -> tuple[str, str]:
    pairs = [(c, n) for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(n := unicodedata.normalize("NFC", c)) == 1 and n != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def nfc(text: Column) -> Column:
    """Text with marks composed with the character before them, as far as single characters of the first plane go."""
    known = F.from_json(F.lit(_composed()), "map<string,string>")

    def joined(cluster: Column) -> Column:
        def add(acc: Column, mark: Column) -> Column:
            whole = F.try_element_at(known, F.concat(F.element_at(acc, -1), mark))
            return F.when(whole.isNotNull(), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(whole))).otherwise(F.concat(acc, F.array(mark)))

        chars = F.split(cluster, "")
        return F.array_join(F.aggregate(F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), F.slice(chars, 1, 1), add), "")

    clusters = F.regexp_extract_all(text, F.lit(r"(?s).\p{M}*"), F.lit(0))
    plain = F.translate(text, *_singletons())
    return F.when(text.rlike(r"\p{M}"), F.array_join(F.transform(clusters, lambda c: F.when(F.length(c) > 1, joined(c)).otherwise(c)), "")).otherwise(plain)


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def genre_group(genre: Column) -> Column:
    return F.lower(F.trim(genre))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def drop_featuring(text: Column) -> Column:
    inner = F.regexp_replace(text, r"(?i)\s*[(\[](?:feat|ft|featuring)\b[^)\]]*[)\]]", "")
    return F.regexp_replace(inner, r"(?i)\s+(?:feat\.?|ft\.?|featuring)\s.*$", "")


def title_key(title: Column) -> Column:
    """What titles are matched by: folded, without featured names, other characters as single spaces."""
    return F.trim(F.regexp_replace(F.lower(drop_featuring(F.translate(title, *_folding()))), r"[^\p{L}\p{N}]+", " "))


def parse_year(text: Column) -> Column:
    year = F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("int")
    return F.when(year.between(1000, 9999), year)


def parse_bpm(text: Column) -> Column:
    """A tempo from 20 to 300; ``bpm`` may follow and one comma with one or two digits after it is a point."""
    bare = F.trim(F.regexp_replace(text, r"(?i)\s*bpm\s*$", ""))
    point = F.regexp_replace(bare, r"^(\d+),(\d{1,2})$", "$1.$2")
    value = F.when(point.rlike(r"^(\d+\.?\d*|\.\d+)$"), point).try_cast("double")
    return F.when(value.between(20, 300), value)


def parse_energy(comment: Column) -> Column:
    words = F.regexp_extract(comment, r"(?i)\benergy(?:\s+level)?[\s:]*(\d{1,2})\b", 1)
    token = F.regexp_extract(comment, r"(?:^|\s)E(\d{1,2})(?:\s|$)", 1)
    level = F.when(words != "", words).otherwise(token).try_cast("int")
    return F.when(level.between(1, 10), level)


def stars_of(value: Column) -> Column:
    """Stars of a stored rating 0, 51, ... 255; blank is 0 and anything else null."""
    n = F.trim(value).try_cast("int")
    return F.when(F.trim(value) == "", 0).when((n % 51 == 0) & n.between(0, 255), (n / 51).cast("int"))


def isrc(text: Column) -> Column:
    bare = F.upper(F.regexp_replace(text, "[- ]", ""))
    return F.when(bare.rlike("^[A-Z0-9]{12}$"), bare)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\]", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_name_text(path: Column) -> Column:
    """File name without a plausible extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[A-Za-z0-9]{1,5}$", "")


def date_in(name: Column) -> Column:
    """The first real date written YYYY-MM-DD in a name."""
    days = F.transform(F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)"), 1), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))


def location_decode(location: Column) -> Column:
    """Path of a file://localhost/ address; a plus sign stays one."""
    bare = F.regexp_replace(location, r"^file://localhost/", "")
    return F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def location_encode(path: Column) -> Column:
    coded = F.replace(F.url_encode(F.replace(path, F.lit("\\"), F.lit("/"))), F.lit("+"), F.lit("%20"))
    for plain in "/:(),'!*":
        coded = F.replace(coded, F.lit("%" + f"{ord(plain):02X}"), F.lit(plain))
    return F.concat(F.lit("file://localhost/"), coded)


def xml_escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "�")


def tags_in_comment(comment: Column) -> Column:
    """The tags of a ``/* a / b */`` block."""
    inner = F.regexp_extract(comment, r"/\*(.*?)\*/", 1)
    return F.filter(F.transform(F.split(inner, " / "), lambda t: F.trim(t)), lambda t: t != "")


def without_tags(comment: Column) -> Column:
    return F.trim(F.regexp_replace(comment, r"/\*.*?\*/", ""))


def split_artist_title(line: Column) -> Column:
    """struct(artist, title) at the first `` - ``; artist null without one."""
    at = F.instr(line, " - ")
    return F.struct(
        F.when(at > 0, F.trim(F.substring(line, F.lit(1), at - 1))).alias("artist"),
        F.trim(F.when(at > 0, F.substring(line, at + 3, F.length(line))).otherwise(line)).alias("title"),
    )


def split_version(title: Column) -> Column:
    """struct(title, version): what stands in brackets at the end is the version."""
    found = F.regexp_extract(title, r"^(.+?)\s*[(\[]([^()\[\]]+)[)\]]\s*$", 2)
    return F.struct(
        F.when(found != "", F.regexp_extract(title, r"^(.+?)\s*[(\[]([^()\[\]]+)[)\]]\s*$", 1)).otherwise(title).alias("title"),
        F.when(found != "", F.trim(found)).alias("version"),
    )


def strip_number(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*\d{1,3}\s*[.):]\s+", "")


def strip_time(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*[\[(]?\d{1,2}(?::\d{2}){1,2}[\])]?\s+", "")
