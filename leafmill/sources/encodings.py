"""Character encodings of simple fonts, and which family stands in for a font that isn't embedded."""

from __future__ import annotations

from functools import lru_cache

from leafmill.sources.document import winansi

# Codes of the standard encoding that aren't ASCII, in order (two quotes differ from ASCII too).
_STANDARD_HIGH = {
    0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "ﬁ", 0xAF: "ﬂ",
    0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜",
    0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ",
    0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}


@lru_cache(maxsize=4)
def table(name: str) -> dict[int, str]:
    """Code to character of StandardEncoding, MacRomanEncoding or WinAnsiEncoding (also for other names)."""
    if name == "StandardEncoding":
        return {c: chr(c) for c in range(0x20, 0x7F)} | _STANDARD_HIGH
    if name == "MacRomanEncoding":
        return {c: bytes([c]).decode("mac_roman") for c in range(0x20, 0x100) if c != 0x7F}
    return {c: winansi(bytes([c])) for c in range(0x20, 0x100)}


def family(base: str, flags: int = 0) -> tuple[str, bool, bool]:
    """(family, bold, italic) for a font name: known families first, then the descriptor's flags."""
    name = (base[7:] if base[6:7] == "+" else base).replace(" ", "").lower()
    bold = any(k in name for k in ("bold", "black", "heavy", "demi")) or bool(flags >> 18 & 1)
    italic = any(k in name for k in ("italic", "oblique")) or bool(flags >> 6 & 1)
    for keys, kind in ((("courier", "mono", "consol", "typewriter"), "monospace"), (("times", "serif", "georgia", "garamond", "roman", "minion"), "serif"), (("symbol", "dingbats"), "symbol"), (("helvetica", "arial", "sans", "verdana", "calibri"), "sans")):
        if any(k in name for k in keys) and not (kind == "serif" and "sans" in name):
            return kind, bold, italic
    return ("monospace" if flags & 1 else "serif" if flags & 2 else "sans"), bold, italic
