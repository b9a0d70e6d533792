"""Normalising, splitting and composing names, as Column -> Column functions.

There are two dialects of normalisation, which differ on purpose.  ``simplify`` takes away
accents one level deep, collapses white space first and then drops a few marks, brackets
among them.  ``simplify_full`` folds every accent, drops more marks, folds dashes, keeps
brackets, and treats underscores and plus signs as spaces.

All functions follow Spark in null handling: null in, null out.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that both dialects drop with accents.
INVERTED = "¡!¿?"
#: Marks that simplify drops.
DROPPED = ".,!()\"'"
#: Marks that simplify_full drops, dashes that it folds, and what it takes for a space.
DROPPED_FULL = ".,!?¡¿\"'‘’“”«»;:`´"
DASHES = "‐‑‒–—―−"
SPACES = "_+ "
#: What file systems forbid in names.
FORBIDDEN = '/\\?"'
#: File name extensions by format.
FORMATS = {"mp3": "mp3", "m4a": "mp4", "mp4": "mp4", "m4b": "mp4", "flac": "flac", "aif": "aiff", "aiff": "aiff", "aifc": "aiff"}


def parts_of(c: str) -> list[str]:
    """A character's decomposition, one level deep."""
    return [chr(int(x, 16)) for x in unicodedata.decomposition(c).split() if not x.startswith("<")]


@cache
def one_level() -> tuple[str, str]:
    """Characters that decompose into two, and the first of the two."""
    found = [(c, parts[0]) for c in map(chr, range(0x10000)) if len(parts := parts_of(c)) == 2]
    return "".join(c for c, _ in found), "".join(p for _, p in found)


@cache
def all_levels() -> tuple[str, str]:
    """Characters that are a base character with marks, and that base."""
    found = []
    for c in map(chr, range(0x10000)):
        whole = unicodedata.normalize("NFD", c)
        if len(whole) > 1 and all(unicodedata.category(m) == "Mn" for m in whole[1:]):
            found.append((c, whole[0]))
    return "".join(c for c, _ in found), "".join(b for _, b in found)


def without(c: Column, marks: str) -> Column:
    return F.translate(c, marks, "")


def fold_accents(c: Column) -> Column:
    """Accents off, one level deep; marks stay."""
    return F.translate(c, *one_level())


def deaccent(c: Column) -> Column:
    return fold_accents(without(c, INVERTED))


def simplify(c: Column) -> Column:
    collapsed = F.trim(F.regexp_replace(deaccent(c), r"\s+", " "))
    return F.lower(without(collapsed, DROPPED))


def deaccent_full(c: Column) -> Column:
    return F.regexp_replace(F.translate(without(c, INVERTED), *all_levels()), r"\p{Mn}+", "")


def simplify_full(c: Column) -> Column:
    bare = F.translate(without(deaccent_full(c), DROPPED_FULL), DASHES + SPACES, "-" * len(DASHES) + " " * len(SPACES))
    return F.lower(F.trim(F.regexp_replace(bare, r"[\s\p{Z}]+", " ")))


def distinguisher(c: Column) -> Column:
    """The last bracketed lower-case remark with the space before it, or ''."""
    return F.regexp_extract(c, r"(?s).*( \([a-z0-9 \-()]+\))", 1)


def file_distinguisher(file: Column, name: Column, vocal: Column) -> Column:
    """A file's distinguisher, unless the title or the singer has the same one."""
    own = distinguisher(file)
    return F.when((own == distinguisher(deaccent(name))) | (own == distinguisher(deaccent(vocal))), "").otherwise(own)


def first_title(c: Column) -> Column:
    """A title up to its alternative."""
    return F.substring_index(c, " | ", 1)


def second_title(c: Column) -> Column:
    """The alternative behind a bar that is not at the start, or ''."""
    at = F.instr(c, " | ")
    return F.when(at > 1, F.substring(c, at + 3, F.length(c))).otherwise("")


def without_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r" *\(.*\)", "")


def without_variant(c: Column) -> Column:
    """A name without the underscores at its end."""
    return F.rtrim(c, F.lit("_"))


def removed(c: Column, part: Column) -> Column:
    """c without any occurrence of part; an empty part takes nothing away."""
    return F.when(part == "", c).otherwise(F.replace(c, part, F.lit("")))


def bare_title(c: Column) -> Column:
    """A title without one leading '- ', one trailing ' -', and underscores at its end."""
    c = F.regexp_replace(c, r"^- ", "")
    c = F.regexp_replace(c, r" -$", "")
    return F.trim(without_variant(c))


def starts_segment(c: Column, always: bool = False) -> Column:
    """Whether the title must stand at the start of a segment of a file name."""
    return F.lit(True) if always else F.startswith(c, F.lit("- "))


def ends_segment(c: Column, always: bool = False) -> Column:
    return F.lit(True) if always else F.endswith(c, F.lit(" -"))


def decorated(c: Column) -> Column:
    """A title with both segment marks."""
    c = F.when(F.startswith(c, F.lit("- ")), c).otherwise(F.concat(F.lit("- "), c))
    return F.when(F.endswith(c, F.lit(" -")), c).otherwise(F.concat(c, F.lit(" -")))


def segments(c: Column) -> Column:
    """A file name whole, and its parts between ' - ' without a remark in brackets at their end."""

    def bare(piece: Column) -> Column:
        cut = F.when(F.endswith(piece, F.lit(")")) & F.contains(piece, F.lit("(")), F.regexp_replace(piece, r"(?s)\([^(]*$", "")).otherwise(piece)
        return F.trim(cut)

    return F.concat(F.array(c), F.filter(F.transform(F.split(c, " - "), bare), lambda x: x != ""))


def after_first_word(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^ ]* ", "")


def genre_initial(c: Column) -> Column:
    return F.lower(F.substring(F.regexp_replace(c, r"(?i)Arr\. en ", ""), 1, 1))


def capitalised(c: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def substituted(pattern: Column, name: Column, vocal: Column, genre: Column, year: Column, orchestra: Column, remark: Column) -> Column:
    """A template with its fields filled in, one after the other, so that later fields are found in earlier values."""
    fields = (
        ("%title%", F.concat(name, remark)),
        ("%tit%", F.concat(first_title(name), remark)),
        ("%orquesta%", orchestra),
        ("%orq%", after_first_word(orchestra)),
        ("%cantor%", vocal),
        ("%can%", after_first_word(vocal)),
        ("%gnr%", genre_initial(genre)),
        ("%genre%", genre),
        ("%yer%", F.substring(year, 1, 4)),
        ("%date%", year),
    )
    return reduce(lambda out, f: F.replace(out, F.lit(f[0]), f[1]), fields, pattern)


def extension(c: Column) -> Column:
    """From the last dot on; the whole name if it has none."""
    return F.when(F.contains(c, F.lit(".")), F.regexp_extract(c, r"(?s)(\.[^.]*)$", 1)).otherwise(c)


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


def rename_target(file: Column, name: Column, vocal: Column, genre: Column, year: Column, orchestra: Column) -> Column:
    """The name that a matched file should have."""
    first, second = F.trim(first_title(name)), F.trim(second_title(name))
    alternative = F.contains(name, F.lit(" | ")) & ~F.contains(file, simplify(first)) & F.contains(file, simplify(second))
    whole = F.concat(orchestra, F.lit(" - "), vocal, F.lit(" - "), F.when(alternative, second).otherwise(first), file_distinguisher(file, name, vocal), F.lit(" - "), F.substring(year, 1, 4), F.lit(" - "), capitalised(genre), F.lower(extension(file)))
    return without(deaccent(whole), FORBIDDEN)


def copy_name(c: Column) -> Column:
    return without(c, FORBIDDEN + "|")


def language_code(c: Column) -> Column:
    """Three letters of a language's name, 'spa' for none, 'und' if there are too few."""
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    code = F.when(F.length(letters) >= 3, F.substring(letters, 1, 3)).otherwise("und")
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "spa").otherwise(code)


def crlf(c: Column) -> Column:
    for a, b in (("\r\n", "\n"), ("\r", "\n"), ("\n", "\r\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def lyrics_body(name: Column, contents: Column) -> Column:
    """What a tag holds of one translation, with CRLF line ends."""
    return crlf(F.concat(name, F.lit("\n\n"), F.regexp_replace(contents, r"^\s+|\s+$", ""), F.lit("\n\n")))


def paragraphs(c: Column) -> Column:
    """Plain text as HTML: an empty line begins a paragraph, any other line end is a break."""
    return F.replace(F.replace(c, F.lit("\n\n"), F.lit("</p><p>")), F.lit("\n"), F.lit("<br/>"))


def short_genre(c: Column) -> Column:
    """A dance's initial; '' for anything that is none."""
    low = F.lower(c)
    out = F.lit("")
    for part, code in (("nuev", "M"), ("milong", "M"), ("vals", "V"), ("tango", "T"), ("tangon", "M")):
        out = F.when(F.contains(low, F.lit(part)), code).otherwise(out)
    return out


def message_artist(c: Column) -> Column:
    return F.substring_index(c, " - ", 1)


def message_display(c: Column) -> Column:
    return F.substring_index(c, " | ", 1)


def message_genre(c: Column) -> Column:
    """What follows the first ' | '; without one what follows the second character, as the reading position is then 2."""
    at = F.instr(c, " | ")
    return F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise(F.substring(c, F.lit(3), F.length(c)))


def tier_label(distance: Column) -> Column:
    """'exact' for no distance, or 'fuzzy ~d'."""
    return F.when(distance.isNull(), "exact").otherwise(F.concat(F.lit("fuzzy ~"), distance.cast("string")))


def file_format(c: Column) -> Column:
    """mp3, mp4, flac or aiff by a file's extension in any case; null for others."""
    ext = F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))
    return F.coalesce(*(F.when(ext == e, f) for e, f in FORMATS.items()))


def natural_key(c: Column) -> Column:
    """A key under which names sort without regard to case and with runs of digits by value."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"[0-9]+|[^0-9]+"), 0)
    padded = F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit("^[0-9]")), F.concat(F.lpad(F.length(F.ltrim(t, F.lit("0"))).cast("string"), 4, "0"), F.ltrim(t, F.lit("0")))).otherwise(t))
    return F.array_join(padded, "")


#: Letters as most languages order them, accents after letters, in any case; the other has letters alike whatever their accents.
BY_LOCALE, UNACCENTED = "UNICODE_CI", "UNICODE_CI_AI"


def natural_order(c: Column, collation: str = BY_LOCALE) -> Column:
    """What names are ordered by for a reader: their natural key under a locale's collation, so that accented letters stand with plain ones."""
    return F.collate(natural_key(c), collation)


def transcoded(c: Column, charset: str) -> Column:
    """Text as bytes of another character set."""
    return F.encode(c, charset)
