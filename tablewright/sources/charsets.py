"""Charsets of raw bytes: state machines say what they can be, bigrams of letter classes how likely each is."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# State machines over bytes: what is not matched to its end is not in the charset.
_LOW = rb"[\x00-\x7f]"
MACHINES = {
    "utf-8": rb"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})*+",
    "gb18030": rb"(?:[\x00-\x80]|[\x81-\xfe](?:[\x40-\x7e\x80-\xfe]|[\x30-\x39][\x81-\xfe][\x30-\x39]))*+",
    "big5": rb"(?:" + _LOW + rb"|[\x81-\xfe][\x40-\x7e\xa1-\xfe])*+",
    "shift_jis": rb"(?:[\x00-\x7f\xa1-\xdf]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])*+",
    "euc-jp": rb"(?:" + _LOW + rb"|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2}|[\xa1-\xfe]{2})*+",
    "euc-kr": rb"(?:" + _LOW + rb"|[\xa1-\xfe]{2})*+",
}
_MACHINES = {k: re.compile(v) for k, v in MACHINES.items()}
#: In order of preference where two are equally likely: charset, codec, and the letters beyond ASCII that its languages use.
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ"
CHARSETS = (
    ("windows-1252", "cp1252", "àâäçéèêëîïôöùûüßñáíóúœæåø"),
    ("gb18030", "gb18030", ""),
    ("big5", "big5", ""),
    ("shift_jis", "cp932", ""),
    ("euc-jp", "euc_jp", ""),
    ("euc-kr", "cp949", ""),
    ("windows-1251", "cp1251", _CYRILLIC),
    ("koi8-r", "koi8_r", _CYRILLIC),
    ("iso-8859-5", "iso8859_5", _CYRILLIC),
    ("windows-1250", "cp1250", "ąćęłńóśźżáčďéěíňřšťúůýžőűäöüßăâîşţ"),
    ("windows-1253", "cp1253", "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋ"),
)
#: What tells a page's script apart from its markup: runs of letters and bytes beyond ASCII, after scripts, styles and tags.
_RUNS = re.compile(rb"(?is)<(script|style)\b.*?(?:</\1|\Z)|<[^<>]*>|[a-z\x80-\xff]+")
#: A charset of another script than Latin is less likely by so much at all, and for each Latin word of the text, for so many words at most.
OTHER_SCRIPT, LATIN_WORD, LATIN_WORDS = 1.0, 0.5, 16
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))

# Classes of characters.
GAP, SMALL, BIG, DIGIT, MARK, USED_SMALL, USED_BIG, ODD_SMALL, ODD_BIG, HAN, RARE_HAN, KANA, HANGUL, WIDE, SIGN, BROKEN = range(16)
#: Logarithms of how likely a class is, whatever stands before it.
ALONE = {USED_SMALL: -1.0, USED_BIG: -2.5, ODD_SMALL: -5.0, ODD_BIG: -6.0, HAN: -1.5, RARE_HAN: -6.0, KANA: -1.2, HANGUL: -1.3, WIDE: -2.0, SIGN: -5.0, BROKEN: -12.0}
LETTERS = (SMALL, BIG, USED_SMALL, USED_BIG, ODD_SMALL, ODD_BIG)


def bigrams(own_script: bool, kana: bool) -> np.ndarray:
    """Log-likelihoods of a class after another. own_script: the charset's letters are of another script than a to z; kana: its language has kana."""
    table = np.zeros((16, 16))
    for b, weight in ALONE.items():
        table[:, b] += weight
    for a in (SMALL, USED_SMALL, ODD_SMALL):
        # Capitals within a word are rare; a mistaken charset makes them out of small letters.
        table[a, [USED_BIG, ODD_BIG]] -= 4
        table[a, SIGN] -= 2
    table[[USED_BIG, ODD_BIG], BIG] -= 0.5
    table[[USED_BIG, ODD_BIG], USED_BIG] -= 0.5
    table[SIGN, [USED_SMALL, ODD_SMALL, SMALL]] -= 2
    if own_script:
        for a in (SMALL, BIG):
            for b in (USED_SMALL, USED_BIG, ODD_SMALL, ODD_BIG):
                table[a, b] -= 4
                table[b, a] -= 4
        table[USED_SMALL, USED_SMALL] += 0.4
    for a in LETTERS:
        for b in (HAN, RARE_HAN, KANA, HANGUL):
            table[a, b] -= 1.5
            table[b, a] -= 1.5
    table[[KANA, HAN], KANA] += 0.5
    table[HANGUL, HANGUL] += 0.4
    table[HANGUL, [HAN, RARE_HAN]] -= 2
    table[KANA, HANGUL] -= 6
    if not kana:
        table[:, KANA] -= 4
    return table


def _classes(used: str) -> np.ndarray:
    """The class of every code point of the basic plane for one charset's languages."""
    out = np.full(0x10000, ODD_SMALL, np.int8)
    text = [chr(i) if not 0xD800 <= i < 0xE000 else "�" for i in range(0x10000)]
    upper = np.array([c.isupper() for c in text])
    letter = np.array([c.isalpha() for c in text])
    out[upper] = ODD_BIG
    out[~letter] = SIGN
    for c in used:
        out[ord(c)] = USED_SMALL
        if len(c.upper()) == 1:
            out[ord(c.upper())] = USED_BIG
    out[0x4E00:0xA000] = RARE_HAN
    out[0x3040:0x3100], out[0xAC00:0xD7A4] = KANA, HANGUL
    out[0xFF66:0xFF9E] = ODD_SMALL
    out[0x3000:0x3020] = out[0xFF01:0xFF60] = WIDE
    out[0xE000:0xF900] = out[0x80:0xA0] = out[0xFFFD] = BROKEN
    out[0x2500:0x25A0] = BROKEN
    for c in "€£§©®°«»·–—‘’“”„…•¿¡":
        out[ord(c)] = MARK
    out[:0x80] = MARK
    out[[9, 10, 12, 13, 32, 0xA0]] = GAP
    out[[*range(9), 11, *range(14, 32), 127]] = BROKEN
    out[ord("0") : ord("9") + 1], out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1] = DIGIT, SMALL, BIG
    return out


def _common_han(codec: str, first: range, last: range) -> np.ndarray:
    """The code points of a charset's first level, which holds the characters in common use."""
    cells = b"".join(bytes((a, b)) for a in first for b in last)
    text = cells.decode(codec, "ignore")
    return np.array(sorted({ord(c) for c in text if 0x4E00 <= ord(c) < 0xA000}))


class Detector:
    """The tables of all charsets; made once a process."""

    def __init__(self) -> None:
        firsts = {
            "gb18030": ("gb2312", range(0xB0, 0xD8), range(0xA1, 0xFF)), "big5": ("big5", range(0xA4, 0xC7), [*range(0x40, 0x7F), *range(0xA1, 0xFF)]),
            "shift_jis": ("euc_jp", range(0xB0, 0xD0), range(0xA1, 0xFF)), "euc-jp": ("euc_jp", range(0xB0, 0xD0), range(0xA1, 0xFF)),
        }
        self.models = []
        for name, codec, used in CHARSETS:
            kinds = _classes(used)
            if name in firsts:
                kinds[_common_han(*firsts[name])] = HAN
            own_script = bool(used) and used[0] in "аα"
            self.models.append((name, codec, kinds, bigrams(own_script, name in ("shift_jis", "euc-jp")), own_script or not used))

    def __call__(self, body: bytes | None) -> tuple[str, float]:
        """(charset, confidence) of some bytes."""
        body = body or b""
        for bom, name in BOMS:
            if body.startswith(bom):
                return name, 1.0
        raw = np.frombuffer(body, np.uint8)
        high = int((raw >= 0x80).sum())
        zeros = raw == 0
        if len(raw) >= 2 and zeros.any():
            even, odd = zeros[::2].mean(), zeros[1::2].mean()
            if max(even, odd) > 0.3 and min(even, odd) < 0.1:
                return ("utf-16be" if even > odd else "utf-16le"), float(max(even, odd))
        if not high:
            return "ascii", 1.0
        if _MACHINES["utf-8"].fullmatch(body):
            return "utf-8", 1 - 0.5 ** min(50, 1 + high // 2)
        # A word that is repeated says no more than once.
        words = b" ".join(dict.fromkeys(w for w in body.split() if not w.isascii()))
        high = int((np.frombuffer(words, np.uint8) >= 0x80).sum())
        latin = OTHER_SCRIPT + LATIN_WORD * sum(1 for _ in islice((m for m in _RUNS.finditer(body) if len(m[0]) > 1 and m[0].isalpha()), LATIN_WORDS))
        scores = []
        for name, codec, kinds, table, foreign in self.models:
            if name in _MACHINES and not _MACHINES[name].fullmatch(body):
                continue
            points = np.frombuffer(words.decode(codec, "replace").encode("utf-32-le"), np.uint32)
            at = kinds[np.where(points < 0x10000, points, 0xFFFD)].astype(np.int64)
            # A page's own ASCII is the same in all; what is beyond it decides, by the bytes that it takes.
            pairs = np.bincount(16 * np.concatenate([[GAP], at[:-1]]) + at, minlength=256)
            scores.append(((float(pairs @ table.ravel()) - foreign * latin) / high, name))
        if not scores:
            return "windows-1252", 0.0
        best = max(scores, key=lambda s: s[0])
        others = [s for s, name in scores if name != best[1]]
        return best[1], float(1 / (1 + np.exp(min(50.0, max(others, default=-50.0) - best[0]) * min(high, 50)))) if others else 1.0


_DETECTOR: list[Detector] = []


def _detect(body: bytes | None) -> tuple[str, float]:
    if not _DETECTOR:
        _DETECTOR.append(Detector())
    return _DETECTOR[0](body)


def detect_charset(body: Column) -> Column:
    """struct<charset, confidence> of raw bytes.

    A byte order mark decides; then zero bytes (UTF-16), pure ASCII, valid UTF-8; else the likeliest charset of those whose state machine takes all bytes.
    Null and empty bytes are ascii. Bytes that no charset explains are windows-1252 with a low confidence.
    """

    @F.pandas_udf("charset string, confidence double")
    def detect(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_detect(b) for b in bodies], columns=["charset", "confidence"])

    return detect(body)


def page_read(body: Column) -> Column:
    """struct<charset, text> of raw bytes: the charset that they are likeliest in, and their text, as a fetcher reads a page without a declared one: ascii as utf-8, any gb charset as gb18030.

    Both in one pass, so that the bytes go to Python once.
    """
    from tablewright.sources.inputs import decoded

    @F.pandas_udf("charset string, text string")
    def read(bodies: pd.Series) -> pd.DataFrame:
        names = [_detect(b)[0] for b in bodies]
        texts = [decoded(b, "utf-8" if n == "ascii" else "gb18030" if n.startswith("gb") else n) for b, n in zip(bodies, names, strict=True)]
        return pd.DataFrame({"charset": names, "text": texts}, dtype=object)

    return read(body)


def page_text(body: Column) -> Column:
    """Text of raw bytes, as by `page_read`."""
    return page_read(body)["text"]
