"""Parts of release names, paths and lenient values as Column factories; all of them stay in the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.label_tables import CUT_LABELS, REWORK_LABELS

# Word lists of the name rules.
MASHUP_SEPARATORS = ("x", "vs", "versus")
HTML_ENTITIES = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": "\u00a0", "lpar": "(", "rpar": ")", "lsqb": "[", "rsqb": "]", "ndash": "\u2013", "mdash": "\u2014"}
XML_ENTITIES = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "amp": "&"}
SITE_ENDINGS = "com net org example test invalid io fm ru cc biz info xyz site online blog app uk de nl fr eu ca tv co".split()
CATALOGUE_STOP_WORDS = "part pt vol volume no nr disc cd side track take chapter ver version mix cut ep lp bpm kbps mp hz khz demo bonus rev mstr edt".split()
# Names of the 24 keys, in wheel order 1A to 12A, then 1B to 12B.
STANDARD_KEYS = "G#m Ebm Bbm Fm Cm Gm Dm Am Em Bm F#m C#m B F# Db Ab Eb Bb F C G D A E".split()
SHARP_KEYS = "G#m D#m A#m Fm Cm Gm Dm Am Em Bm F#m C#m B F# C# G# D# A# F C G D A E".split()
FLAT_KEYS = "Abm Ebm Bbm Fm Cm Gm Dm Am Em Bm Gbm Dbm B Gb Db Ab Eb Bb F C G D A E".split()
#: Points of a playlist's target at most.
MOST_TARGET_POINTS = 32


@functools.cache
def _latin() -> tuple[str, str]:
    """Latin letters that canonically are a letter and accents, and that letter in lower case."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        form = unicodedata.normalize("NFD", c.lower())
        if len(form) > 1 and all("\u0300" <= x <= "\u036f" for x in form[1:]):
            pairs.append((c, form[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def version_key(title: Column) -> Column:
    """What names are compared by: lower case, ``&`` as and, no apostrophes or Latin accents, other characters as single spaces."""
    low = F.translate(F.lower(title), *_latin())
    low = F.regexp_replace(low, r"(\p{IsLatin})[\x{300}-\x{36F}]+", "$1")
    for a, b in (("\u00df", "ss"), ("\u00e6", "ae"), ("\u0153", "oe"), ("\u00f8", "o"), ("\u0111", "d"), ("\u0142", "l"), ("\u0131", "i"), ("&", " and "), ("'", "")):
        low = F.replace(low, F.lit(a), F.lit(b))
    key = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}\p{M}]+", " "))
    return F.when(key != "", key).otherwise(F.trim(F.regexp_replace(F.lower(title), r"\s+", " ")))


def plain(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}@#]", ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def split_names(credit: Column, joined_acts: bool = False) -> Column:
    """The names of a credit: parted by ``&`` or a comma; between ``joined_acts`` by x, vs or versus too.

    A separator with nothing after it is part of the last name.
    """
    parted = F.regexp_replace(F.regexp_replace(credit, r"(?<=^|\s)&(?=\s|$)", "\u0001"), r",(?=\s|$)", "\u0001")
    if joined_acts:
        parted = F.regexp_replace(parted, r"(?i)(?<=\s)(?:x|vs|versus)\.?(?=\s+\S)", "\u0001")
    names = F.transform(F.split(parted, "\u0001"), lambda n: F.regexp_replace(F.regexp_replace(n, r"^[,&\s]+|[,&\s]+$", ""), r"\s+", " "))
    return F.filter(names, lambda n: n != "")


def featured(credit: Column) -> Column:
    """A credit's main and featured names as one list of credits."""
    return F.regexp_replace(credit, r"(?i)(?<=\s)(?:feat|ft|featuring)\.?(?=\s)", "&")


def artist_keys(artist: Column) -> Column:
    """The keys of the artists that a tag names and of the tag as a whole, sorted."""
    keys = F.concat(F.transform(split_names(featured(artist), True), version_key), F.array(version_key(artist)))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.rlike(r"[\p{L}\p{N}]"))))


def artists_match(a: Column, b: Column) -> Column:
    """Whether two credits share a name."""
    keys = lambda x: F.transform(split_names(featured(x), True), version_key)
    return F.coalesce(F.arrays_overlap(keys(a), keys(b)), F.lit(False))


def mashup_parts(title: Column) -> Column:
    """The two or more titles that x, vs or versus join; null if there is nothing before or after one."""
    parts = F.split(F.concat(F.lit(" "), F.array_join(_words(title), "  "), F.lit(" ")), r"(?i) (?:x|vs|versus)\.? ")
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.when((F.size(parts) > 1) & ~F.exists(parts, lambda p: p == ""), parts)


def _decoded(text: Column, names: dict[str, str], longest: int) -> Column:
    """Entities decoded once each, from the left; anything else that starts with ``&`` stays."""
    tokens = F.regexp_extract_all(text, F.lit(rf"&[^;&]{{0,{longest}}};|&|[^&]+"), F.lit(0))

    def one(t: Column) -> Column:
        body = F.substring(t, F.lit(2), F.length(t) - 2)
        named = F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), body)
        decimal = F.when(body.rlike(r"^#[0-9]{1,7}$"), F.substring(body, 2, 9).try_cast("int"))
        hexadecimal = F.when(body.rlike(r"^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substring(body, 3, 9), 16, 10).try_cast("int"))
        code = F.coalesce(decimal, hexadecimal)
        # beyond the first plane a character is written as its UTF-8 bytes
        low = lambda shift: (F.shiftright(code, shift) % 64) + 128
        octets = F.when(code < 0x80, F.format_string("%02X", code)).when(code < 0x800, F.format_string("%02X%02X", F.shiftright(code, 6) + 0xC0, low(0)))
        octets = octets.when(code < 0x10000, F.format_string("%02X%02X%02X", F.shiftright(code, 12) + 0xE0, low(6), low(0)))
        octets = octets.otherwise(F.format_string("%02X%02X%02X%02X", F.shiftright(code, 18) + 0xF0, low(12), low(6), low(0)))
        real = (code >= 32) & ~code.between(0x7F, 0x9F) & ~code.between(0xD800, 0xDFFF) & (code < 0x110000)
        coded = F.when(real, F.decode(F.unhex(octets), "UTF-8"))
        return F.when(t.startswith("&") & t.endswith(";"), F.coalesce(named, coded, t)).otherwise(t)

    return F.array_join(F.transform(tokens, one), "")


def decode_entities(name: Column) -> Column:
    return _decoded(name, HTML_ENTITIES, 8)


def xml_unescape(raw: Column) -> Column:
    return _decoded(raw, XML_ENTITIES, 11)


def decode_url_escapes(name: Column) -> Column:
    return F.replace(name, F.lit("%20"), F.lit(" "))


def looks_like_site(word: Column) -> Column:
    """Whether a word is a site's name: www. and more, or labels that end in one of ``SITE_ENDINGS``."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), r"^.*?://", "")
    label = r"[\p{L}\p{N}-]"
    ends = "|".join(SITE_ENDINGS)
    return F.when(bare.startswith("www."), bare.rlike(r"^www\..*[\p{L}\p{N}]")).otherwise(bare.rlike(rf"^(?=[^.]*\p{{L}}){label}+(\.{label}+)*\.({ends})$"))


def catalogue_number(text: Column) -> Column:
    """``ABC123`` of 2 to 5 capitals and 3 to 5 digits, a hyphen between them left out; null for labels and words that count."""
    t = F.trim(text)
    letters = F.lower(F.regexp_extract(t, r"^([A-Z]{2,5})-?[0-9]{3,5}$", 1))
    labels = [x for group in (*CUT_LABELS.values(), *REWORK_LABELS.values()) for x in group if x.isalpha()]
    return F.when((letters != "") & ~letters.isin(*CATALOGUE_STOP_WORDS, *labels), F.replace(t, F.lit("-"), F.lit("")))


def bracket_aside(content: Column) -> Column:
    """struct(kind, value) of a bracket that holds a key, a tempo, a catalogue number, a year or a copy counter; else null."""
    return F.get(F.transform(F.array(F.trim(content)), _aside), F.lit(0))


def _aside(t: Column) -> Column:
    key = F.when(t.rlike(r"^([1-9]|1[0-2])[ABab]$"), F.lower(t))
    unit = F.regexp_extract(F.lower(t), r"^([1-9][0-9]{1,2}(?:\.[0-9]{1,2})?)\s*bpm$", 1)
    tempo = F.when(F.floor(unit.try_cast("double")).between(40, 250), unit)
    number = F.when(t.rlike(r"^[1-9][0-9]{0,3}$"), t.try_cast("int"))
    kinds = [("key", key), ("tempo", tempo), ("catalogue", catalogue_number(t))]
    kinds += [("copy", F.when(number.between(1, 99), t)), ("tempo", F.when(number.between(100, 250), t)), ("year", F.when(number.between(1900, 2099), t))]
    out = None
    for kind, value in kinds:
        made = F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        out = F.when(value.isNotNull(), made) if out is None else out.when(value.isNotNull(), made)
    return out


def upcase(path: Column) -> Column:
    """A path by which spellings are compared where case does not count: letters whose upper case is one other letter."""
    kept = F.regexp_replace(path, "\u00df", "\u0001")
    return F.replace(F.upper(kept), F.lit("\u0001"), F.lit("\u00df"))


def absolute_path(path: Column, base: Column) -> Column:
    """``path`` with forward slashes, against ``base`` if it is relative, ``.`` and ``..`` worked out; null if that climbs past the top."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = p.startswith("/") | (F.substring(p, 2, 1) == ":")
    whole = F.when(rooted, p).otherwise(F.concat(F.regexp_replace(F.replace(base, F.lit("\\"), F.lit("/")), "/+$", ""), F.lit("/"), p))
    head = F.when(whole.startswith("//"), "//").when(whole.startswith("/"), "/").otherwise("")
    floor = F.when(head == "//", 2).when(head == "", 1).otherwise(0)
    parts = F.filter(F.split(F.substring(whole, F.length(head) + 1, F.length(whole)), "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        up, n = x == "..", F.size(acc["kept"])
        kept = F.when(~up, F.concat(acc["kept"], F.array(x))).when(n > floor, F.slice(acc["kept"], 1, F.greatest(n - 1, F.lit(0)))).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), (acc["ok"] & (~up | (n > floor))).alias("ok"))

    done = F.aggregate(parts, start, step)
    return F.when(done["ok"], F.concat(head, F.array_join(done["kept"], "/")))


def decimal(text: Column) -> Column:
    """A decimal number without an exponent, such as -0.023 or 5. ; null for anything else."""
    return F.when(text.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast("double"))


def tidy_note(note: Column) -> Column:
    """A note on one line, trimmed; null if nothing is left."""
    line = F.regexp_replace(F.regexp_replace(note, r"\p{Cc}", " "), r"^\s+|\s+$", "")
    return F.when(line != "", line)


def sibling_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\s+$", ""))


def content_key(audio_hash: Column, file_hash: Column) -> Column:
    """What two files of the same audio share: the audio's hash, or that of the file where there is none."""
    return F.coalesce(F.when(audio_hash != "", audio_hash), file_hash)


def is_blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def key_name(order: Column, notation: str = "standard") -> Column:
    """A key's name by its place on the wheel (see ``music.any_key_order``) in standard, sharps, flats or wheel notation."""
    names = {"standard": STANDARD_KEYS, "sharps": SHARP_KEYS, "flats": FLAT_KEYS, "wheel": [f"{n}{m}" for m in "AB" for n in range(1, 13)]}[notation]
    at = F.floor(order / 2) - 1 + F.when(order % 2 == 1, 12).otherwise(0)
    return F.get(F.array(*map(F.lit, names)), at.cast("int"))


def stars_for(energy: Column) -> Column:
    return F.when(energy.between(1, 10), F.floor((energy + 1) / 2).cast("int"))


def energy_for_stars(stars: Column) -> Column:
    return F.when(stars.between(1, 5), stars * 2)


def percentile_of(cuts: Column, x: Column) -> Column:
    """Where x stands in sorted cut points, 0 to 100: by a straight line between two, in the middle of equal ones."""
    below = F.size(F.filter(cuts, lambda c: c < x))
    up_to = F.size(F.filter(cuts, lambda c: c <= x))
    low, high = F.get(cuts, below - 1), F.get(cuts, below)
    place = F.when(below < up_to, (below + up_to - 1) / 2.0).when(below == 0, 0.0).when(below == F.size(cuts), F.size(cuts) - 1.0).otherwise(below - 1 + (x - low) / (high - low))
    return F.least(F.greatest(F.floor(place + 0.5), F.lit(0)), F.lit(100)).cast("int")


def tidy_target(points: Column, most: int = MOST_TARGET_POINTS) -> Column:
    """Points (at, energy) pulled into 0 to 1 and 1 to 10, in order; of several at one place the last given; ``most`` at most."""
    clamp = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    fit = F.filter(points, lambda p: p["at"].isNotNull() & p["energy"].isNotNull() & ~F.isnan(p["at"]) & ~F.isnan(p["energy"]))
    own = F.transform(fit, lambda p, i: F.struct(clamp(p["at"], 0.0, 1.0).alias("at"), i.alias("i"), clamp(p["energy"], 1.0, 10.0).alias("energy")))
    ordered = F.array_sort(own)
    last = lambda z: F.filter(z, lambda p, i: F.coalesce(F.get(z, i + 1)["at"] != p["at"], F.lit(True)))
    kept = F.get(F.transform(F.array(ordered), last), F.lit(0))
    return F.slice(F.transform(kept, lambda p: F.struct(p["at"].alias("at"), p["energy"].alias("energy"))), 1, most)


FRAMES = "map<string,array<struct<key:string,value:struct<type:string,text:string,len:bigint>>>>"


def _frames(raw_tags: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The frames of nested tags (block to frames) for which keep(block, frame) holds, in the blocks' order."""
    blocks = F.map_entries(F.from_json(raw_tags, FRAMES))
    return F.flatten(F.transform(blocks, lambda b: F.filter(F.coalesce(b["value"], F.array().cast("array<struct<key:string,value:struct<type:string,text:string,len:bigint>>>")), lambda f: keep(b["key"], f))))


def isrcs_in(raw_tags: Column) -> Column:
    """The recording codes in nested tags: frames TSRC, ISRC or a free form that ends in :isrc, several parted by NUL."""
    low = lambda f: F.lower(f["key"])
    found = _frames(raw_tags, lambda b, f: F.coalesce(low(f).isin("tsrc", "isrc") | low(f).endswith(":isrc"), F.lit(False)))
    texts = F.flatten(F.transform(found, lambda f: F.split(F.coalesce(f["value"]["text"], F.lit("")), "\u0000")))
    codes = F.transform(texts, lambda t: F.upper(F.regexp_replace(t, r"[-\s]", "")))
    return F.coalesce(F.filter(codes, lambda c: c.rlike("^[A-Z0-9]{12}$")), F.array().cast("array<string>"))


def no_cover(raw_tags: Column) -> Column:
    """Whether tags were read and hold no picture of any of the four formats."""

    def picture(block: Column, f: Column) -> Column:
        key = F.coalesce(f["key"], F.lit(""))
        kind = ((block == "id3v2") & key.rlike("^APIC(:|$)")) | ((block == "mp4_ilst") & (key == "covr"))
        kind |= ((block == "vorbis_comments") & key.rlike("^METADATA_BLOCK_PICTURE(:|$)")) | ((block == "ape") & key.rlike("(?i)^cover art"))
        return kind & F.coalesce((f["value"]["type"] == "binary") & (f["value"]["len"] > 0), F.lit(False))

    return raw_tags.isNotNull() & (F.coalesce(F.size(_frames(raw_tags, picture)), F.lit(0)) == 0)
