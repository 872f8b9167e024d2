"""Names: transliteration, clean keys, UUIDs."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
_CYRILLIC = dict(zip("абвгдезийклмнопрстуфхыэ", "a b v g d e z i i k l m n o p r s t u f kh y e".split())) | {"ё": "io", "ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ъ": "'", "ь": "'", "і": "i", "ї": "yi", "є": "ie", "ґ": "g"}
_GREEK = dict(zip("αβγδεζηικλμνξοπρσςτυφω", "a b g d e z e i k l m n x o p r s s t u f o".split())) | {"θ": "th", "χ": "kh", "ψ": "ps"}
_LATIN = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "ng", "Ŋ": "NG", "ŧ": "t", "Ŧ": "T", "ə": "e", "Ə": "E", "ƒ": "f", "’": "'", "‘": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "–": "-", "—": "--", "‐": "-", "…": "...", "•": "*", "·": "*", "×": "x", "÷": "/", "«": "<<", "»": ">>", "¡": "!", "¿": "?", "°": "deg", "©": "(c)", "®": "(r)", "™": "tm", "€": "EUR", "£": "PS", "¥": "Y=", "§": "SS", " ": " "}


def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """(one to one, one to many); an empty string deletes."""
    found = dict(_LATIN)
    for table in (_CYRILLIC, _GREEK):
        for c, r in table.items():
            found[c] = r
            found[c.upper()] = r.capitalize()
    for first, last in ((0xA0, 0x24F), (0x1E00, 0x1EFF), (0x386, 0x3CE), (0x400, 0x45F), (0x2000, 0x206F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)):
        for code in range(first, last + 1):
            c = chr(code)
            if c in found:
                continue
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            plain = "".join(found.get(x, x) for x in base)
            if plain != c and plain.isascii() and plain:
                found[c] = plain
    for code in range(0x300, 0x370):
        found[chr(code)] = ""
    return {c: r for c, r in found.items() if len(r) == 1}, {c: r for c, r in found.items() if len(r) != 1}


_ONE, _MANY = _tables()


#: Letters of scripts without case whose usual ASCII spelling is not that of the transliterators below.
_HEBREW = dict(zip("אבגדהוזחטיךכלםמןנסעףפץצקרשת", " b g d h v z kh t y k k l m m n n s ` p p ts ts q r sh t".split(" ")))
_ARABIC = dict(zip("ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىي", "|a|'|w'||y'||b|@|t|th|j|h|kh|d|dh|r|z|s|sh|s|d|t|z|`|g||f|q|k|l|m|n|h|w|~|y".split("|")))
_KANA = {"じ": "zi", "ふ": "hu", "ぢ": "di", "づ": "du", "ジ": "zi", "フ": "hu", "ヂ": "di", "ヅ": "du", "ー": "-"}
_FIRST, _LAST = 0x250, 0xFAFF
#: Separates the entries of the table; no text holds it.
_SEP = "\uffff"


@lru_cache(maxsize=1)
def _wide() -> str:
    """ASCII spelling of every letter from _FIRST to _LAST, one after the other; a letter without one stands for itself.

    They come from the transliterators of ICU, which Spark's collations bring along, once for each driver; every letter by
    itself, and ideographs followed by a space, as they are words of their own.
    """
    jvm = SparkSession.active()._jvm
    spell = jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin; NFD; [:Nonspacing Mark:] Remove; NFC; Latin-ASCII")
    codes = [c for c in range(_FIRST, _LAST + 1) if not 0xD800 <= c < 0xE000]
    known = [c for c in codes if unicodedata.category(chr(c))[0] in "LNM"]
    found = dict(zip(known, spell.transliterate("\n".join(map(chr, known))).split("\n")))
    own = {ord(c): r for table in (_HEBREW, _ARABIC, _KANA) for c, r in table.items()}
    out = []
    for c in range(_FIRST, _LAST + 1):
        r = own[c] if c in own else found.get(c, chr(c) if not 0xD800 <= c < 0xE000 else "")
        if r != chr(c):
            r = "".join(x for x in r if x.isascii() and x != "~")
        ideograph = 0x3400 <= c <= 0x9FFF or 0xF900 <= c
        out.append(f"{r} " if ideograph and r and r != chr(c) else r)
    return _SEP.join(out)


def translit(x: Column) -> Column:
    """ASCII spelling of letters of all scripts; what has none (emoji) stays as it is.

    ASCII text skips the tables. Latin, Greek and Cyrillic are spelt by replacements, other scripts letter by letter from a table that
    is looked up by code point; all of it within the JVM.
    """
    drop = "".join(c for c, r in _MANY.items() if not r)
    out = F.translate(x, "".join(_ONE) + drop, "".join(_ONE.values()))
    for c, r in _MANY.items():
        if r:
            out = F.replace(out, F.lit(c), F.lit(r))
    ascii_only = "^[\\x00-\\x7F]*$"
    table = F.split(F.lit(_wide()), _SEP, -1)
    letters = F.regexp_extract_all(out, F.lit("(?s)(.)"), F.lit(1))
    wide = F.array_join(F.transform(letters, lambda c: F.coalesce(F.get(table, F.ascii(c) - _FIRST), c)), "")
    return F.when(x.rlike(ascii_only), x).when(out.rlike(ascii_only), out).otherwise(wide)


def clean_name(x: Column) -> Column:
    """Key under which names are looked up: transliterated, lower case, single spaces."""
    return F.btrim(F.regexp_replace(F.lower(translit(x)), "\\s+", " "))


def canonical_uuid(x: Column) -> Column:
    """Lower-case 8-4-4-4-12 form of a UUID in any usual notation, else null."""
    bare = F.regexp_replace(F.lower(F.btrim(x)), "^urn:uuid:|[{}-]", "")
    dashed = F.concat_ws("-", *(F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), dashed)


def is_real_mbid(x: Column) -> Column:
    """A UUID that was not derived from a name (version 5)."""
    u = canonical_uuid(x)
    return F.coalesce(u.isNotNull() & (F.substring(u, 15, 1) != "5"), F.lit(False))


def uuid5_url(x: Column) -> Column:
    """UUIDv5 of a URL in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(x, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def resolve_id(mbid: Column, url: Column) -> Column:
    """The given id if there is one, else the one derived from the URL, else null."""
    return F.coalesce(F.nullif(mbid, F.lit("")), uuid5_url(F.nullif(url, F.lit(""))))
