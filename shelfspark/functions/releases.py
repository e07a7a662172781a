"""Names of releases read into artist, title, version labels and the rest; every step is a Column expression.

A name is cut into tokens, a stack (as an array in a fold over the tokens) finds which
bracket each belongs to, and the brackets behind the title and the parts behind a dash
are read as labels, from their ends backwards.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names
from shelfspark.functions.label_tables import (
    AUDIO_EXTENSIONS,
    BITRATE_UNITS,
    BITRATES,
    BY_WORDS,
    CUT_LABELS,
    FORMAT_WORDS,
    LIVE_PLACE_WORDS,
    NAMED_MIX_WORDS,
    NON_NAME_WORDS,
    NUMBER_WORDS,
    REWORK_LABELS,
    RIP_TAGS,
    SITE_FILLER_WORDS,
)

MOST_LABEL_WORDS, MOST_DEPTH = 3, 8
DASHES = "-‐‒–—―－"
SEPARATORS = "/+&,|;"
OPENING, CLOSING = "([{〈", ")]}〉"
#: Characters that mean the same: wide and CJK brackets, quotes.
ALIKE = "（）［【〔〖］】〕〗｛｝《》‘’‚‛′“”„‟″"
PLAIN = "()[[[[]]]]{}〈〉'''''\"\"\"\"\""

LABEL = "struct<group:string,kind:string,detail:string>"
LABELS = f"array<{LABEL}>"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _among(word: Column, words: list[str]) -> Column:
    return F.coalesce(word.rlike(f"^(?:{'|'.join(map(re.escape, words))})$"), F.lit(False))


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _has_content(text: Column) -> Column:
    """Whether a text holds more than blanks and ASCII punctuation."""
    return F.coalesce(text.rlike(r"[^\s!-/:-@\[-`{-~]"), F.lit(False))


def _alnum(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def _spelt(spelling: str) -> str:
    """A table's spelling as ``label_words`` spells a text's words."""
    return " ".join("".join(c for c in w.lower() if c.isalnum() or c in "@#") for w in spelling.split(" "))


def _kind_of(spelling: Column) -> Column:
    """struct(group, kind) of a label's spelling, null for anything else."""
    pairs = [(_spelt(x), g, k) for g, table in (("cut", CUT_LABELS), ("rework", REWORK_LABELS)) for k, spellings in table.items() for x in spellings]
    first = {x: (g, k) for x, g, k in reversed(pairs)}
    # one literal, however often it is used
    table = F.from_json(F.lit(json.dumps({x: {"group": g, "kind": k} for x, (g, k) in first.items()})), "map<string,struct<group:string,kind:string>>")
    return F.try_element_at(table, spelling)


def label_words(text: Column) -> Column:
    """A text's words in lower case, letters and digits only (V.I.P. is vip, Re-Fix refix); what parts labels is an empty word."""
    found = F.regexp_extract_all(text, F.lit(rf"[{SEPARATORS}]|[^\s{SEPARATORS}]+"), F.lit(0))
    return F.transform(found, lambda w: F.when(w.rlike(rf"^(?:[{SEPARATORS}]|[{DASHES}]+)$"), "").otherwise(names.plain(w)))


def _front(text: Column, n: Column) -> Column:
    """A text's first n words as written."""
    pattern = F.concat(F.lit(rf"^((?:\s*(?:[{SEPARATORS}]|[^\s{SEPARATORS}]+)){{"), n.cast("string"), F.lit("})"))
    return F.when(n > 0, F.trim(F.call_function("regexp_extract", text, pattern, F.lit(1)))).otherwise("")


def _behind(text: Column, n: Column) -> Column:
    """What follows a text's first n words."""
    pattern = F.concat(F.lit(rf"^((?:\s*(?:[{SEPARATORS}]|[^\s{SEPARATORS}]+)){{"), n.cast("string"), F.lit("})"))
    return F.trim(F.substr(text, F.length(F.call_function("regexp_extract", text, pattern, F.lit(1))) + 1))


def _joined(plain: Column, start: Column, n: int) -> Column:
    return F.array_join(F.slice(plain, F.greatest(start, F.lit(1)), n), " ")


def _last_word(plain: Column, end: Column) -> Column:
    """How many of the first ``end`` words are left without the separators at their end."""
    return F.coalesce(F.array_max(F.transform(F.slice(plain, 1, end), lambda w, i: F.when(w != "", i + 1).otherwise(0))), F.lit(0))


def _label_before(plain: Column, end: Column) -> Column:
    """struct(group, kind, n) of the longest label that ends with word ``end``; one with a separator inside is none."""

    def of(n: int) -> Column:
        return let(_kind_of(_joined(plain, end - (n - 1), n)), lambda k: F.when((end >= n) & k.isNotNull(), F.struct(k["group"].alias("group"), k["kind"].alias("kind"), F.lit(n).alias("n"))))

    return F.coalesce(*(of(n) for n in range(MOST_LABEL_WORDS, 0, -1)))


def _labels_at_end(plain: Column) -> Column:
    """struct(kinds, rest): labels read from the end backwards, as written, and how many words stand in front of them.

    A year on either side of a remaster belongs to it and is its detail.
    """
    year_at = lambda i: let(F.when(i >= 1, F.get(plain, i - 1)), lambda w: F.when(w.rlike("^(19|20)[0-9]{2}$"), w))
    start = F.struct(F.size(plain).alias("end"), F.array().cast(LABELS).alias("kinds"), F.lit(True).alias("on"))

    def step(acc: Column, _: Column) -> Column:
        def from_cursor(cursor: Column) -> Column:
            behind = let(_label_before(plain, cursor - 1), lambda m: F.when(year_at(cursor).isNotNull() & (cursor > 1) & (m["kind"] == "remaster"), F.struct(m["group"].alias("group"), m["kind"].alias("kind"), (m["n"] + 1).alias("n"))))
            return let(F.coalesce(_label_before(plain, cursor), behind), lambda m: taken(cursor, m))

        def taken(cursor: Column, m: Column) -> Column:
            end = cursor - m["n"]
            before = F.when(m["kind"] == "remaster", year_at(end))
            detail = F.when(m["kind"] == "remaster", F.coalesce(year_at(cursor), before))
            label = F.struct(m["group"].alias("group"), m["kind"].alias("kind"), detail.alias("detail"))
            found = F.struct((end - F.when(before.isNotNull(), 1).otherwise(0)).alias("end"), F.concat(F.array(label), acc["kinds"]).alias("kinds"), F.lit(True).alias("on"))
            return F.when(m.isNotNull(), found).otherwise(F.struct(acc["end"].alias("end"), acc["kinds"].alias("kinds"), F.lit(False).alias("on")))

        return F.when(acc["on"], let(_last_word(plain, acc["end"]), from_cursor)).otherwise(acc)

    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(plain), F.lit(1))), start, step)
    return let(done, lambda d: F.struct(d["kinds"].alias("kinds"), d["end"].alias("rest")))


def _tidy(kinds: Column) -> Column:
    """Intro with outro is one kind, a cut followed by ``edit`` is that cut, and each label counts once."""

    def echoes(x: Column, before: Column) -> Column:
        return F.coalesce((x["kind"] == "edit") & (before["kind"] != "edit") & (before["group"] == "cut"), F.lit(False))

    def whole(z: Column) -> Column:
        both = F.exists(z, lambda x: x["kind"] == "intro") & F.exists(z, lambda x: x["kind"] == "outro")
        kind = lambda x: F.when(both & x["kind"].isin("intro", "outro"), "intro_outro").otherwise(x["kind"])
        one = F.transform(z, lambda x: F.struct(x["group"].alias("group"), kind(x).alias("kind"), x["detail"].alias("detail")))
        return let(one, lambda y: F.filter(y, lambda x, i: ~F.exists(F.slice(y, 1, i), lambda w: w["kind"] == x["kind"])))

    return let(F.filter(kinds, lambda x, i: ~echoes(x, F.get(kinds, i - 1))), whole)


def _is_person(text: Column) -> Column:
    """Whether words can be whose rework it is: one of them is neither an ordinary word nor a label's."""
    return F.exists(label_words(text), lambda w: _alnum(w) & ~_among(w, NON_NAME_WORDS) & _kind_of(w).isNull())


def read_labels(text: Column) -> Column:
    """array of struct(group, kind, detail): what a bracket or a part behind a dash says of the version; null if it is not made of labels.

    At most one name may stand in front of a rework (or behind it after ``by``, a place
    after ``live at``); it is the detail. ``Someone Mix`` is a remix and ``Someone Edit`` a bootleg.
    """

    def detailed(kinds: Column, detail: Column) -> Column:
        return F.transform(kinds, lambda x: F.struct(x["group"].alias("group"), x["kind"].alias("kind"), F.when(x["group"] == "rework", detail).otherwise(x["detail"]).alias("detail")))

    def single(group: str, kind: Column, detail: Column) -> Column:
        return F.array(F.struct(F.lit(group).alias("group"), kind.alias("kind"), detail.alias("detail"))).cast(LABELS)

    def named_behind(plain: Column) -> Column:
        def of(n: int) -> Column:
            joiner, name = F.get(plain, F.lit(n)), _behind(text, F.lit(n + 1))
            joins = lambda k: _among(joiner, BY_WORDS) | ((k["kind"] == "live") & _among(joiner, LIVE_PLACE_WORDS))
            return let(_kind_of(_joined(plain, F.lit(1), n)), lambda k: F.when((F.size(plain) >= n + 2) & (k["group"] == "rework") & joins(k) & _alnum(name), single("rework", k["kind"], name)))

        return F.coalesce(*(of(n) for n in range(MOST_LABEL_WORDS, 0, -1)))

    def from_end(plain: Column, found: Column) -> Column:
        kinds, name = found["kinds"], _front(text, _last_word(plain, found["rest"]))
        mixed = F.when(_among(F.try_element_at(plain, F.lit(-1)), NAMED_MIX_WORDS), _front(text, _last_word(plain, F.size(plain) - 1)))
        named_mix = F.when(_is_person(mixed), single("rework", F.lit("remix"), mixed))

        def with_name(n: Column) -> Column:
            bootleg = F.concat(F.array(F.struct(F.lit("rework").alias("group"), F.lit("bootleg").alias("kind"), F.lit(None).cast("string").alias("detail"))), F.slice(kinds, 2, F.greatest(F.size(kinds), F.lit(1))))
            return (
                F.when(n == "", _tidy(kinds))
                .when(~_is_person(n), F.lit(None).cast(LABELS))
                .when(F.exists(kinds, lambda k: k["group"] == "rework"), detailed(_tidy(kinds), n))
                .when(F.get(kinds, 0)["kind"] == "edit", detailed(_tidy(bootleg), n))
            )

        return F.when(F.size(kinds) == 0, named_mix).otherwise(let(name, with_name))

    def read(plain: Column) -> Column:
        return F.when(F.size(plain) > 0, F.coalesce(named_behind(plain), let(_labels_at_end(plain), lambda found: from_end(plain, found))))

    return let(label_words(text), read)


def _bare_tail(title: Column) -> Column:
    """struct(front, labels): labels written as plain words at a title's end, null without one."""

    def read(plain: Column) -> Column:
        return let(_labels_at_end(plain), lambda f: F.when(F.size(f["kinds"]) > 0, F.struct(_front(title, _last_word(plain, f["rest"])).alias("front"), _tidy(f["kinds"]).alias("labels"))))

    return let(label_words(title), read)


def _featured(text: Column) -> Column:
    """struct(before, names) of a text with a featuring word and a name behind it; else null."""
    at = r"(?i)^(.*?)(?<!\S)(?:feat|ft|featuring)\.?\s+(.*[\p{L}\p{N}].*)$"
    return F.when(text.rlike(at), F.struct(F.regexp_extract(text, at, 1).alias("before"), F.regexp_extract(text, at, 2).alias("names")))


def is_site_phrase(text: Column) -> Column:
    """A site's name, alone or among the words that announce one."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.exists(words, names.looks_like_site) & F.forall(words, lambda w: names.looks_like_site(w) | _among(bare(w), SITE_FILLER_WORDS))


def says_nothing(content: Column) -> Column:
    """Whether a bracket holds a site, a rip tag, bitrates and formats, or a running time."""
    low = _one_line(F.lower(content))
    rate = f"(?:{'|'.join(map(str, BITRATES))})(?: ?(?:{'|'.join(BITRATE_UNITS)}))?"
    listed = low.rlike(f"^(?:{rate}|{'|'.join(FORMAT_WORDS)})(?: (?:{rate}|{'|'.join(FORMAT_WORDS)}))*$")
    return F.coalesce(is_site_phrase(content) | _among(low, RIP_TAGS) | listed | low.rlike(r"^\d{1,2}:\d{2}(?::\d{2})?$"), F.lit(False))


def cleaned(name: Column, is_file: bool) -> Column:
    """A name without folders, extension, escapes and track number, in plain characters and single spaces."""
    if is_file:
        name = F.when(name.rlike(r"[/\\][^/\\]+$"), F.regexp_extract(name, r"([^/\\]+)$", 1)).otherwise(name)
        name = F.regexp_replace(name, rf"(?i)(?<=.)\.(?:{'|'.join(AUDIO_EXTENSIONS)})$", "")
    name = names.decode_entities(name)
    name = names.decode_url_escapes(name) if is_file else name
    name = F.regexp_replace(F.translate(F.regexp_replace(name, "[​⁠﻿]", ""), ALIKE, PLAIN), r"[\s\p{Z}\p{Cc}]+", " ")
    name = F.regexp_replace(name, r"^\s*[0-9]{6,}[_" + (" " if is_file else "") + r"-](?=.*[\p{L}\p{N}])", "")
    lines = F.length(name) - F.length(F.replace(name, F.lit("_"), F.lit("")))
    blanks = F.length(name) - F.length(F.replace(name, F.lit(" "), F.lit("")))
    name = F.trim(name)
    name = F.replace(name, F.lit("_"), F.lit(" ")) if is_file else F.when(lines > blanks, F.replace(name, F.lit("_"), F.lit(" "))).otherwise(name)
    dash, more = f" [{DASHES}] ", rf"(?=.*[\p{{L}}\p{{N}}])"
    numbers = [rf"^[0-9]{{1,3}}[.)] +{more}", rf"^0[0-9]{{1,2}}[.-](?=\p{{L}})", rf"^0[0-9]{{1,2}}{dash} *{more}", rf"^0[0-9]{{1,2}} +{more}"]
    if is_file:
        numbers = [rf"^[A-Da-d][0-9]{{1,2}}{dash} *(?=.*{dash})", rf"^[0-9]-[0-9]{{2}} +{more}", *numbers[:3], rf"^[0-9]{{1,3}}{dash} *(?=.*{dash})", numbers[3]]
    name = F.trim(name)
    stripped = None
    for n in numbers:
        stripped = F.when(name.rlike(n), F.regexp_replace(name, n, "")) if stripped is None else stripped.when(name.rlike(n), F.regexp_replace(name, n, ""))
    return _one_line(stripped.otherwise(name))


def bracket_tokens(name: Column) -> Column:
    """array of struct(id, parent, root, what, text): the name's tokens, each with the bracket it stands in (0: none).

    ``what`` is open, close, dash (one between segments, outside brackets) or text. A bracket
    left open runs to the end of the one around it, a closing one closes the nearest of its
    kind and all in it, one with nothing to close is text, and so is all beyond eight levels.
    """
    alone = rf"(?<![^ ])[{DASHES}](?![^ ])"
    brackets = r"()\[\]{}〈〉"
    tokens = F.regexp_extract_all(name, F.lit(rf"[{brackets}]|{alone}|(?:(?!{alone})[^{brackets}])+"), F.lit(0))
    token = "struct<id:int,parent:int,root:int,what:string,text:string>"
    start = F.struct(F.array().cast("array<struct<kind:string,id:int>>").alias("stack"), F.array().cast(f"array<{token}>").alias("out"), F.lit(1).alias("next"))

    def step(acc: Column, t: Column) -> Column:
        stack, out, free = acc["stack"], acc["out"], acc["next"]
        top = F.coalesce(F.get(stack, F.size(stack) - 1)["id"], F.lit(0))
        root = F.coalesce(F.get(stack, F.lit(0))["id"], F.lit(0))
        opening = t.isin(*OPENING) & (F.size(stack) < MOST_DEPTH)
        mate = F.translate(t, CLOSING, OPENING)
        place = F.when(t.isin(*CLOSING), F.coalesce(F.array_max(F.transform(stack, lambda s, i: F.when(s["kind"] == mate, i + 1).otherwise(0))), F.lit(0))).otherwise(0)

        last = F.get(out, F.size(out) - 1)

        def made(s: Column, i: Column, parent: Column, r: Column, what: str, n: Column, before: Column = out, text: Column = t) -> Column:
            piece = F.struct(i.alias("id"), parent.alias("parent"), r.alias("root"), F.lit(what).alias("what"), text.alias("text"))
            return F.struct(s.alias("stack"), F.concat(before, F.array(piece)).alias("out"), n.alias("next"))

        def closed(p: Column) -> Column:
            i = F.get(stack, p - 1)["id"]
            return made(F.slice(stack, 1, F.greatest(p - 1, F.lit(0))), i, i, root, "close", free)

        pushed = F.concat(stack, F.array(F.struct(t.alias("kind"), free.alias("id"))))
        dash = (F.size(stack) == 0) & t.rlike(f"^[{DASHES}]$")
        return (
            F.when(opening, made(pushed, free, top, F.when(root == 0, free).otherwise(root), "open", free + 1))
            .when(place > 0, let(place, closed))
            .when(dash, made(stack, F.lit(0), F.lit(0), F.lit(0), "dash", free))
            .when(last["what"] == "text", made(stack, top, top, root, "text", free, F.slice(out, 1, F.size(out) - 1), F.concat(last["text"], t)))
            .otherwise(made(stack, top, top, root, "text", free))
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def _text_of(tokens: Column) -> Column:
    return _one_line(F.array_join(F.transform(tokens, lambda t: t["text"]), ""))


def _groups(tokens: Column) -> Column:
    """array of struct(id, root, open, closed, own, nested): the brackets in order, with their own text and whether others stand in them."""

    def one(t: Column) -> Column:
        own = F.filter(tokens, lambda x: (x["id"] == t["id"]) & (x["what"] == "text"))
        return F.struct(
            t["id"].alias("id"), t["root"].alias("root"), t["text"].alias("open"),
            F.exists(tokens, lambda x: (x["id"] == t["id"]) & (x["what"] == "close")).alias("closed"),
            _one_line(F.array_join(F.transform(own, lambda x: x["text"]), " ")).alias("own"),
            F.exists(tokens, lambda x: (x["parent"] == t["id"]) & (x["what"] == "open")).alias("nested"),
        )

    return F.transform(F.filter(tokens, lambda t: t["what"] == "open"), one)


def _read_group(g: Column) -> Column:
    """A bracket and what it is: featured names, nothing of note, labels, an aside, or unknown."""
    feat = _featured(g["own"])
    credit = F.when(~_has_content(feat["before"]), feat["names"])

    def known(labels: Column) -> Column:
        aside = F.when(g["closed"] & ~g["nested"] & labels.isNull(), names.bracket_aside(g["own"]))
        bare = F.coalesce(g["own"].rlike("^[0-9]+$"), F.lit(False))
        nothing = says_nothing(g["own"])
        what = F.when(g["own"] == "", "other").when(credit.isNotNull(), "credit").when(nothing, "nothing").when(aside.isNotNull(), "aside").otherwise("other")
        return F.struct(
            g["id"].alias("id"), g["root"].alias("root"), g["open"].alias("open"), g["own"].alias("own"), g["nested"].alias("nested"),
            credit.alias("credit"), labels.alias("labels"), aside.alias("aside"), bare.alias("bare"), what.alias("what"),
        )

    return let(read_labels(g["own"]), known)


CREDIT = "array<struct<name:string,featured:boolean>>"


def _credits(text: Column, featured: bool, joined_acts: bool = False) -> Column:
    found = F.transform(names.split_names(text, joined_acts), lambda n: F.struct(n.alias("name"), F.lit(featured).alias("featured")))
    return F.coalesce(found, F.array().cast(CREDIT)).cast(CREDIT)


FIELDS = ("artist", "credits", "title", "core", "labels", "maybe", "parts", "asides", "unknown")


def each_once(rows: DataFrame, names_of: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``work`` adds to their different ``names_of``; a null name gets nulls.

    Reading a name takes much longer than shuffling it, so each is read once, and the
    different ones are dealt to a task a core, however few bytes they are.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    different = rows.select(*names_of).distinct().repartition(tasks, *names_of)
    return rows.join(work(different), names_of, "left")


def parse_releases(rows: DataFrame, name: Column, out: str, is_file: bool = True) -> DataFrame:
    """``rows`` with ``out``, a struct(artist, credits, title, core, labels, maybe, parts, asides, unknown) of a release's name.

    A file name's first segment is its artist; a title has none. ``credits`` are the names
    in front of it and the featured ones. Labels are read from brackets behind the title,
    nested ones too, and from segments behind it; label words at the title's own end stay
    in ``title`` and are listed in ``maybe``, ``core`` being the title without them. ``parts``
    are a mashup's titles (null: none). Brackets that say nothing are dropped, harmless ones
    at the end are ``asides`` (kind, value), others are ``unknown``. A null name gives null.

    The steps are columns of their own, so that each is worked out once.
    """
    keep = 2 if is_file else 1
    own = lambda c: F.col(f"`{out}__{c}`")

    def step(df: DataFrame, c: str, made: Column) -> DataFrame:
        return df.withColumn(f"{out}__{c}", made)

    df = step(rows, "clean", cleaned(name, is_file))
    df = step(df, "tokens", bracket_tokens(own("clean")))
    df = step(df, "groups", _groups(own("tokens")))
    df = step(df, "read", F.transform(own("groups"), _read_group))
    dropped = F.transform(F.filter(own("read"), lambda g: (g["id"] == g["root"]) & ~g["nested"] & (g["what"] == "nothing")), lambda g: g["id"])
    df = step(df, "left", let(dropped, lambda gone: F.filter(own("tokens"), lambda t: (t["root"] == 0) | ~F.array_contains(gone, t["root"]))))
    df = step(df, "segments", _without_sites(_segments(own("left"))))
    df = step(df, "found", F.transform(own("segments"), lambda x: F.struct(_segment_labels(x, own("read")).alias("labels"))))
    last_other = F.coalesce(F.array_max(F.transform(own("found"), lambda x, i: F.when(x["labels"].isNull(), i + 1).otherwise(0))), F.lit(0))
    n = F.size(own("segments"))
    df = step(df, "behind", F.greatest(F.least(n - last_other, n - keep), F.lit(0)))
    df = step(df, "front", F.slice(own("segments"), 1, n - own("behind")))
    has_artist = (F.size(own("front")) >= 2) if is_file else F.lit(False)
    df = step(df, "artist", F.when(has_artist, _text_of(F.get(own("front"), F.lit(0)))))
    rest = F.when(has_artist, F.slice(own("front"), 2, F.greatest(F.size(own("front")), F.lit(1)))).otherwise(own("front"))
    between = F.array(F.struct(F.lit(0).alias("id"), F.lit(0).alias("parent"), F.lit(0).alias("root"), F.lit("text").alias("what"), F.lit(" - ").alias("text")))
    df = step(df, "title", F.flatten(F.transform(rest, lambda x, i: F.when(i == 0, x).otherwise(F.concat(between, x)))))
    df = step(df, "dashed", F.flatten(F.transform(F.slice(own("found"), n - own("behind") + 1, own("behind")), lambda d: d["labels"])))
    df = step(df, "ends", F.flatten(F.slice(own("segments"), n - own("behind") + 1, own("behind"))))
    df = step(df, "feats", F.transform(own("title"), lambda t, i: _feat_at(own("title"), t, i)))
    df = step(df, "texts", F.transform(own("title"), lambda t, i: F.struct(t["root"].alias("root"), F.coalesce(F.get(own("feats"), i)["before"], t["text"]).alias("text"))))
    last = F.coalesce(F.array_max(F.transform(own("texts"), lambda t, i: F.when((t["root"] == 0) & _has_content(t["text"]), i + 1).otherwise(0))), F.lit(0))
    df = step(df, "last", last)
    df = step(df, "core", _text_of(F.slice(own("texts"), 1, own("last"))))
    roots = F.array_distinct(F.transform(F.filter(F.slice(own("texts"), own("last") + 1, F.greatest(F.size(own("texts")), F.lit(0))), lambda t: t["root"] > 0), lambda t: t["root"]))
    df = step(df, "mine", let(roots, lambda r: F.filter(own("read"), lambda g: F.array_contains(r, g["root"]))))
    df = step(df, "tail", _bare_tail(own("core")))
    outer = F.filter(own("mine"), lambda g: g["id"] == g["root"])
    df = step(df, "aside_ids", let(outer, lambda z: _asides(z, own("core"), own("tail"), own("behind") > 0)))
    others = F.filter(own("mine"), lambda g: ~F.array_contains(own("aside_ids"), g["root"]))
    df = step(df, "others", others)
    df = step(df, "labelled", F.filter(own("others"), lambda g: (g["what"] != "credit") & (g["what"] != "nothing") & g["labels"].isNotNull()))
    df = step(df, "unknown", F.transform(F.filter(own("others"), lambda g: g["what"].isin("other", "aside") & g["labels"].isNull() & ((g["own"] != "") | ~g["nested"])), lambda g: g["own"]))
    df = step(df, "folds", _folds(own("core"), own("labelled")))
    df = df.withColumn(out, F.when(own("clean").isNotNull(), _whole(own)))
    return df.select(*(F.col(f"`{c}`") for c in rows.columns if c != out), out)


def _segments(tokens: Column) -> Column:
    """The runs of tokens that dashes part, those without content left out."""
    numbered = F.transform(tokens, lambda t, i: F.struct(F.size(F.filter(F.slice(tokens, 1, i + 1), lambda x: x["what"] == "dash")).alias("seg"), t.alias("t")))

    def cut(z: Column) -> Column:
        last = F.coalesce(F.get(z, F.size(z) - 1)["seg"], F.lit(0))
        mine = F.transform(F.sequence(F.lit(0), last), lambda s: F.transform(F.filter(z, lambda x: (x["seg"] == s) & (x["t"]["what"] != "dash")), lambda x: x["t"]))
        return F.filter(mine, lambda s: _has_content(_text_of(s)))

    return let(numbered, cut)


def _without_sites(segments: Column) -> Column:
    """A site's name as the first or last segment goes."""

    def kept(z: Column) -> Column:
        n = F.size(z)
        is_site = lambda s: F.forall(s, lambda t: t["root"] == 0) & is_site_phrase(_text_of(s))
        return let(F.filter(z, lambda s, i: ~(is_site(s) & ((i == 0) | (i == n - 1)))), lambda k: F.when((n > 1) & (F.size(k) > 0), k).otherwise(z))

    return let(segments, kept)


def _segment_labels(s: Column, groups: Column) -> Column:
    """A segment's labels if it is text and, behind it, brackets that cannot be a version; else null."""
    harmless = lambda root: F.exists(groups, lambda g: (g["id"] == root) & (g["what"] == "aside") & ~g["bare"])
    last_text = F.coalesce(F.array_max(F.transform(s, lambda t, i: F.when((t["root"] == 0) & _has_content(t["text"]), i + 1).otherwise(0))), F.lit(0))
    fit = F.forall(F.transform(s, lambda t, i: (t["root"] == 0) | ((i >= last_text) & harmless(t["root"]))), lambda x: x)
    return F.when(fit, read_labels(_text_of(F.filter(s, lambda t: t["root"] == 0))))


def _feat_at(tokens: Column, t: Column, i: Column) -> Column:
    """A text's featured names; the word needs a title in front of it."""
    seen = F.exists(F.slice(tokens, 1, i), lambda x: _has_content(x["text"]))
    return let(F.when(t["root"] == 0, _featured(t["text"])), lambda f: F.when(seen | _has_content(f["before"]), f))


def _folds(title: Column, labelled: Column) -> Column:
    """Whether the first label is the title's own: a title cannot be empty, and of a label written twice the first is."""
    kinds = lambda g: F.transform(g["labels"], lambda x: F.struct(x["kind"].alias("kind"), F.lower(x["detail"]).alias("detail")))
    first = F.get(labelled, F.lit(0))
    twice = F.coalesce(F.exists(F.slice(labelled, 2, F.greatest(F.size(labelled), F.lit(1))), lambda g: kinds(g) == kinds(first)), F.lit(False))
    return (F.size(labelled) > 0) & ((title == "") | twice)


def _whole(own: Callable[[str], Column]) -> Column:
    none, no_credit = F.array().cast(LABELS), F.array().cast(CREDIT)
    artist, title, folds, labelled, unknown = (own(c) for c in ("artist", "core", "folds", "labelled", "unknown"))
    first, tail = F.get(labelled, F.lit(0)), own("tail")
    written = F.concat(first["open"], first["own"], F.translate(first["open"], OPENING, CLOSING))
    full = F.when(folds, F.trim(F.concat_ws(" ", F.nullif(title, F.lit("")), written))).when(title != "", title).otherwise(F.coalesce(F.get(unknown, F.lit(0)), own("clean")))
    left = F.when(folds, F.slice(labelled, 2, F.greatest(F.size(labelled), F.lit(1)))).otherwise(labelled)
    labels = F.concat(F.flatten(F.transform(left, lambda g: g["labels"])), own("dashed"))
    maybe = F.concat(F.coalesce(tail["labels"], none), F.when(folds, first["labels"]).otherwise(none))
    core = F.coalesce(F.nullif(tail["front"], F.lit("")), full)
    mains = F.when(artist.isNotNull(), let(_featured(F.translate(artist, "()[]{}", "      ")), lambda f: F.concat(_credits(F.coalesce(F.trim(f["before"]), artist), False, True), F.when(f.isNotNull(), _credits(f["names"], True)).otherwise(no_credit))))
    featured = F.flatten(F.transform(F.filter(own("feats"), lambda f: f.isNotNull()), lambda f: _credits(f["names"], True)))
    in_brackets = F.flatten(F.transform(F.filter(own("others"), lambda g: g["credit"].isNotNull()), lambda g: _credits(g["credit"], True)))
    asides = F.transform(F.filter(own("mine"), lambda g: F.array_contains(own("aside_ids"), g["id"])), lambda g: g["aside"])
    closing = F.transform(F.filter(own("read"), lambda g: F.exists(own("ends"), lambda t: t["root"] == g["id"])), lambda g: g["aside"])
    rest = F.when((title == "") & ~folds, F.slice(unknown, 2, F.greatest(F.size(unknown), F.lit(1)))).otherwise(unknown)
    made = (artist, F.concat(F.coalesce(mains, no_credit), featured, in_brackets), full, core, labels, maybe, names.mashup_parts(core), F.concat(asides, closing), rest)
    return F.struct(*(c.alias(f) for c, f in zip(made, FIELDS)))


def _asides(outer: Column, title: Column, tail: Column, behind_labels: Column) -> Column:
    """Ids of the brackets at the end that are harmless: peeled off from the end; a bare number behind a label, an unknown bracket or a word like part is not."""
    last = F.lower(F.regexp_replace(F.regexp_extract(title, r"(\S+)\s*$", 1), r"^[^\p{L}\p{N}#]+|[^\p{L}\p{N}#]+$", ""))
    blocked = _among(last, NUMBER_WORDS) | tail.isNotNull()
    start = F.struct(blocked.alias("blocked"), F.array().cast("array<boolean>").alias("fit"))
    neutral = lambda g: g["what"].isin("credit", "nothing")

    def step(acc: Column, g: Column) -> Column:
        held = (g["what"] == "aside") & g["bare"] & acc["blocked"]
        fit = (g["what"] == "aside") & ~held
        return F.struct((acc["blocked"] | (~neutral(g) & ~fit)).alias("blocked"), F.concat(acc["fit"], F.array(fit)).alias("fit"))

    def peeled(fit: Column) -> Column:
        marked = F.transform(outer, lambda g, i: F.struct(g["id"].alias("id"), F.get(fit, i).alias("fit"), (F.get(fit, i) | neutral(g)).alias("passes")))
        return let(marked, lambda m: F.transform(F.filter(m, lambda x, i: x["fit"] & F.forall(F.slice(m, i + 1, F.size(m)), lambda y: y["passes"])), lambda x: x["id"]))

    return F.when(behind_labels, F.array().cast("array<int>")).otherwise(let(F.aggregate(outer, start, step, lambda acc: acc["fit"]), peeled))


def _person(name: Column) -> Column:
    return names.version_key(F.regexp_replace(F.trim(name), r"'[sS]$", ""))


def relate(rows: DataFrame, a: str, b: str, out: str = "relation") -> DataFrame:
    """``rows`` with how two parsed names relate: mashup, title, artists, rework, unclear, cut or same, the first that applies.

    Titles are the same if they are as written, or if label words at the end of one (then of
    both) are read as labels. ``mashup``: the titles differ, but one is a part of the other.
    A remix that one name credits to no one is unclear beside one that is credited; the label
    ``original`` says nothing, and two remasters of different years are two cuts. A remix
    filed under its remixer alone is not by another artist. A null name relates as null.
    """
    own = lambda c: F.col(f"`{out}__{c}`")
    key, add = names.version_key, {}
    for n, x in (("a", F.col(a)), ("b", F.col(b))):
        add[f"title_{n}"], add[f"core_{n}"] = key(x["title"]), key(x["core"])
        add[f"parts_{n}"] = F.transform(F.coalesce(x["parts"], F.array().cast("array<string>")), key)
        add[f"main_{n}"] = F.transform(F.filter(x["credits"], lambda c: ~c["featured"]), lambda c: _person(c["name"]))
        add[f"unknown_{n}"] = F.array_sort(F.transform(x["unknown"], key))
    df = rows.withColumns({f"{out}__{c}": e for c, e in add.items()})
    pairs = [("title", "title"), ("core", "title"), ("title", "core"), ("core", "core")]
    df = df.withColumn(f"{out}__reading", F.coalesce(*(F.when(own(f"{x}_a") == own(f"{y}_b"), i) for i, (x, y) in enumerate(pairs))))
    said = {"a": (1, 3), "b": (2, 3)}
    df = df.withColumns({f"{out}__labels_{n}": F.when(own("reading").isin(*said[n]), F.concat(x["labels"], x["maybe"])).otherwise(x["labels"]) for n, x in (("a", F.col(a)), ("b", F.col(b)))})
    add = {}
    for n in "ab":
        for group in ("cut", "rework"):
            mine = F.filter(own(f"labels_{n}"), lambda x: (x["group"] == group) & (x["kind"] != "original"))  # noqa: B023
            add[f"{group}_{n}"] = F.array_sort(F.array_distinct(F.transform(mine, lambda x: x["kind"])))
            add[f"{group}_of_{n}"] = F.array_sort(F.array_distinct(F.transform(F.filter(mine, lambda x: x["detail"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), _person(x["detail"]).alias("who")))))
    df = df.withColumns({f"{out}__{c}": e for c, e in add.items()})
    unnamed = F.exists(F.concat(own("labels_a"), own("labels_b")), lambda x: (x["group"] == "rework") & x["detail"].isNull())
    remixers = F.transform(F.concat(own("rework_of_a"), own("rework_of_b")), lambda x: x["who"])
    overlap = lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    apart = (F.size(own("main_a")) > 0) & (F.size(own("main_b")) > 0) & ~overlap(own("main_a"), own("main_b"))
    apart = apart & ~overlap(own("main_a"), remixers) & ~overlap(own("main_b"), remixers)
    named = F.array_contains(own("parts_a"), own("core_b")) | F.array_contains(own("parts_b"), own("core_a")) | overlap(own("parts_a"), own("parts_b"))
    reworks = own("rework_of_a") != own("rework_of_b")
    years = (own("cut_of_a") != own("cut_of_b")) & (F.size(own("cut_of_a")) > 0) & (F.size(own("cut_of_b")) > 0)
    # two asides of one kind that say different things; copy counters never do
    both = F.col(a)["asides"], F.col(b)["asides"]
    of = lambda z, kind: F.filter(z, lambda s: s["kind"] == kind)
    disagree = F.exists(both[0], lambda s: (s["kind"] != "copy") & (F.size(of(both[1], s["kind"])) > 0) & ~F.exists(both[1], lambda t: (t["kind"] == s["kind"]) & (t["value"] == s["value"])))
    answer = (
        F.when(F.col(a).isNull() | F.col(b).isNull(), None)
        .when(own("reading").isNull() & F.coalesce(named, F.lit(False)), "mashup")
        .when(own("reading").isNull(), "title")
        .when(apart, "artists")
        .when((own("rework_a") != own("rework_b")) | (reworks & ~unnamed), "rework")
        .when(reworks, "unclear")
        .when((own("cut_a") != own("cut_b")) | years, "cut")
        .when((own("unknown_a") != own("unknown_b")) | F.coalesce(disagree, F.lit(False)), "unclear")
        .otherwise("same")
    )
    return df.withColumn(out, answer).select(*(F.col(f"`{c}`") for c in rows.columns if c != out), out)
