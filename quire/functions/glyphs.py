"""Glyph names and code tables."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Names of glyphs that no rule below gives.
NAMED = """
space  |exclam !|quotedbl "|numbersign #|dollar $|percent %|ampersand &|quotesingle '|parenleft (|parenright )|asterisk *|plus +|comma ,|hyphen -|period .|slash /
zero 0|one 1|two 2|three 3|four 4|five 5|six 6|seven 7|eight 8|nine 9|colon :|semicolon ;|less <|equal =|greater >|question ?|at @
bracketleft [|backslash \\|bracketright ]|asciicircum ^|underscore _|grave `|braceleft {|bar ||braceright }|asciitilde ~
exclamdown ¡|cent ¢|sterling £|currency ¤|yen ¥|brokenbar ¦|section §|dieresis ¨|copyright ©|circlecopyrt ©|ordfeminine ª|guillemotleft «|logicalnot ¬|registered ®|macron ¯
degree °|plusminus ±|twosuperior ²|threesuperior ³|acute ´|mu μ|paragraph ¶|periodcentered ·|cedilla ¸|onesuperior ¹|ordmasculine º|guillemotright »
onequarter ¼|onehalf ½|threequarters ¾|questiondown ¿|multiply ×|divide ÷|AE Æ|ae æ|OE OE|oe oe|Eth Ð|eth ð|Thorn Þ|thorn þ|germandbls ß|Oslash Ø|oslash ø|Lslash Ł|lslash ł|dotlessi ı
breve ˘|caron ˇ|circumflex ˆ|dotaccent ˙|hungarumlaut ˝|ogonek ˛|ring ˚|tilde ˜|florin ƒ|fraction ⁄|Euro €|trademark ™|minus −|bullet •|dagger †|daggerdb ‡|ellipsis …|emdash —|endash –|perthousand ‰
quoteleft ‘|quoteright ’|quotedblleft “|quotedblright ”|quotesinglbase ‚|quotedblbase „|guilsinglleft ‹|guilsinglright ›|ff ff|fi fi|fl fl|ffi ffi|ffl ffl
aleph ℵ|angle ∠|angleleft 〈|angleright 〉|approxequal ≈|arrowdblboth ⇔|arrowdblleft ⇒|asteriskmath *|existential ∃|universal ∀|partialdiff ∂|infinity ∞|integral ∫|sharp ♯
"""
ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "caron": "̌", "cedilla": "̧"}
BULLETS = ("/bullet", "/circle", "/disc", "/filledbox")
DINGBAT_BULLETS = (108, 110, 114, 183)


@lru_cache(1)
def glyph_names() -> dict[str, str]:
    """Text for glyph names (with their slash): letters, accented letters, Greek letters and NAMED."""
    out = {}
    for c in map(chr, [*range(65, 91), *range(97, 123)]):
        out[f"/{c}"] = c
        for name, mark in ACCENTS.items():
            if len(whole := unicodedata.normalize("NFC", c + mark)) == 1:
                out[f"/{c}{name}"] = whole
    for point in range(0x391, 0x3CA):
        words = unicodedata.name(chr(point), "").split()
        if len(words) == 4 and words[0] == "GREEK":
            name = words[3].lower().replace("lamda", "lambda")
            out[f"/{name.capitalize() if words[1] == 'CAPITAL' else name}"] = chr(point)
    for entry in NAMED.replace("\n", "|").split("|"):
        name, _, text = entry.partition(" ")
        if name:
            out[f"/{name}"] = text
    out["/bar"] = "|"
    return out


def glyph_text(name: str) -> str:
    """Text of a glyph name: a bullet, a known name, a code point in hexadecimal after `/uni`, or the name itself."""
    if name in BULLETS:
        return "•"
    known = glyph_names().get(name)
    if known is not None:
        return known
    if name.startswith("/uni"):
        try:
            return chr(int(name[4:], 16))
        except (ValueError, OverflowError):
            return name
    return name


def extended_ascii(code: int) -> str:
    """Character of an octal escape above 127: Windows-1252, blank where that has none."""
    if code < 128:
        return chr(code)
    return bytes([code]).decode("cp1252", "replace").replace("�", " ") if code < 256 else chr(code)


@lru_cache(70_000)
def sjis_text(code: int) -> str:
    return _coded(code, "cp932")


@lru_cache(70_000)
def jis_text(code: int) -> str:
    return _coded(code | 0x8080, "euc_jp") if code > 0xFF else _coded(code, "ascii")


def _coded(code: int, codec: str) -> str:
    data = code.to_bytes(2, "big") if code > 0xFF else bytes([code])
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return chr(code) if code <= 0x7F else "�"


def safe_chr(code: int) -> str:
    return chr(code) if 0 <= code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "�"


#: Standard strings 96 to 228 of the Compact Font Format.
CFF_STRINGS = """
exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl endash dagger daggerdb periodcentered paragraph bullet
quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron emdash
AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide brokenbar degree thorn
threequarters twosuperior registered minus eth multiply threesuperior copyright Aacute Acircumflex Adieresis Agrave Aring Atilde Ccedilla Eacute Ecircumflex Edieresis Egrave Iacute Icircumflex
Idieresis Igrave Ntilde Oacute Ocircumflex Odieresis Ograve Otilde Scaron Uacute Ucircumflex Udieresis Ugrave Yacute Ydieresis Zcaron aacute acircumflex adieresis agrave aring atilde ccedilla eacute
ecircumflex edieresis egrave iacute icircumflex idieresis igrave ntilde oacute ocircumflex odieresis ograve otilde scaron uacute ucircumflex udieresis ugrave yacute ydieresis zcaron
""".split()
