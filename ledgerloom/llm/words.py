"""Words of whole texts as arrays: Arrow cleans the text, numpy finds and hashes the words."""

from __future__ import annotations

#: Marks without width or meaning inside a word: soft hyphen, zero-width characters, joiners, byte order mark.
UNSEEN = r"[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]"
#: Markup between words: tags, character references, escaped line breaks, and punctuation outside ASCII.
BETWEEN = r"</?[a-z][^<>\n]{0,60}>|&#x?[0-9a-f]+;?|&[a-z]+;|\\[nrt]|[\x{a0}-\x{a9}\x{ab}-\x{b4}\x{b6}-\x{b9}\x{bb}-\x{bf}\x{2000}-\x{206f}\x{3000}-\x{303f}\x{ff00}-\x{ff0f}]"
#: Most characters of a tag.
TAG = 64
MULTIPLIER = 0x9E3779B97F4A7C15


def parts_of(texts, rows: int, size: int):
    """Cut an Arrow array of texts so that numpy never works on much more than ``size`` bytes: yields (first row, array of texts, cut).

    A part has at most ``rows`` texts. A text of more than ``size`` bytes comes alone, as an array of its segments in order (``cut`` true),
    see ``_segments``.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8")
    k = 0
    while k < len(n):
        if n[k] > size:
            yield k, pa.array(_segments(texts[k].as_py(), size // 4), pa.large_string()), True
            k += 1
            continue
        stop = k + max(1, min(rows, int(np.searchsorted(np.cumsum(n[k : k + rows]), size, side="right"))))
        yield k, texts.slice(k, stop - k), False
        k = stop


def _segments(text: str, size: int) -> list[str]:
    """``text`` in pieces of at most ``size`` letters that together have its words: cut behind the last line, else before the last blank that no tag may
    hold, else between words; a word of more than ``size`` letters is cut."""
    out, at = [], 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            stop = _seam(text, at, stop)
        out.append(text[at:stop])
        at = stop
    return out


def _seam(text: str, at: int, stop: int) -> int:
    line = text.rfind("\n", at, stop) + 1
    if line > at + (stop - at) // 2:
        return line
    blank = text.rfind(" ", at, stop)
    if blank > at:
        tag = text.rfind("<", max(at, blank - TAG), blank)
        return tag if tag > at and ">" not in text[tag:blank] else blank
    mark = next((k for k in range(stop - 1, at, -1) if text[k] < "\x80" and not text[k].isalnum() and text[k] not in "&#;/\\"), 0)
    return mark if mark > at else stop


def lower_texts(texts):
    """Lower-case Arrow array without unseen marks; null becomes empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    t = pc.fill_null(texts, "")
    if isinstance(t, pa.ChunkedArray):
        t = t.combine_chunks()
    return pc.replace_substring_regex(pc.utf8_lower(t.cast(pa.large_string())), UNSEEN, "")


def clean_texts(texts):
    """Lower-case Arrow array without unseen marks and markup; null becomes empty."""
    import pyarrow.compute as pc

    return pc.replace_substring_regex(lower_texts(texts), BETWEEN, " ")


def text_bytes(texts):
    """All bytes of a large_string array, and where each text begins and the last ends."""
    import numpy as np

    n = len(texts)
    _, offsets, raw = texts.buffers()
    if offsets is None or raw is None or n == 0:
        return np.zeros(0, "u1"), np.zeros(n + 1, "i8")
    offsets = np.frombuffer(offsets, dtype="i8")[texts.offset : texts.offset + n + 1]
    return np.frombuffer(raw, dtype="u1")[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_runs(data, inside, offsets, cuts=None):
    """Runs of ``inside`` bytes, none across two texts: (start of each run, its 64-bit hash, number of runs before each text). ``cuts``: places where
    another run begins in any case."""
    import numpy as np

    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if cuts is not None:
        begins[cuts] = inside[cuts]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, "u8"), np.zeros(len(offsets), "i8")
    with np.errstate(over="ignore"):
        power = np.full(len(data), np.uint64(MULTIPLIER))
        power[0] = 1
        power = np.cumprod(power, dtype="u8")
        inverse = np.full(len(data), np.uint64(pow(MULTIPLIER, -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.cumprod(inverse, dtype="u8")[starts]
        power *= np.where(inside, data, 0).astype("u8")
        h = np.add.reduceat(power, starts) * inverse
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return starts, h, np.searchsorted(starts, offsets)


def lone_letters(data):
    """Where to cut UTF-8 text of scripts without blanks (Han, kana, Thai, Lao, Tibetan, Burmese, Khmer): before and behind each of their letters."""
    import numpy as np

    at = np.flatnonzero(data >= 0xE0)
    at = at[at < len(data) - 1]
    a, b = data[at], data[at + 1]
    lone = ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xE3) & (b >= 0x81)) | ((a == 0xE0) & (b >= 0xB8)) | ((a == 0xE1) & (np.isin(b, [0x80, 0x81, 0x82, 0x9E, 0x9F])))
    lone |= ((a == 0xEF) & (((b >= 0xA4) & (b <= 0xAB)) | (b == 0xBD) | (b == 0xBE))) | ((a == 0xF0) & (b >= 0xA0))
    cuts = np.concatenate([at[lone], at[lone] + np.where(a[lone] == 0xF0, 4, 3)])
    return cuts[cuts < len(data)]


def words_of(texts):
    """(document index, position in the document, 64-bit hash) of every word, and the number of words of each document.

    A word is a run of letters and digits of any script, or one letter of a script without blanks. ``texts`` is an Arrow array as ``clean_texts`` gives it.
    """
    import numpy as np

    data, offsets = text_bytes(texts)
    table = np.zeros(256, dtype=bool)
    table[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True
    starts, h, first = hash_runs(data, table[data], offsets, lone_letters(data))
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(texts), dtype="i4"), counts)
    pos = (np.arange(len(starts)) - np.repeat(first[:-1], counts)).astype("i4")
    return doc, pos, h, counts.astype("i4")
