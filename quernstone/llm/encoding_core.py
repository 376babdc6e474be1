"""Character-level core of the wrong-encoding repair: codec pairs, alignment, scores.

Everything here is plain Python on single strings and arrays, so that it can be tested
without a session.  ``encoding.py`` runs it over a corpus.

Terms: a *pair* ``(wrong, true)`` names the codec with which a text was wrongly decoded and
the one its bytes were in.  Undoing it means ``text.encode(wrong).decode(true)``.  A *unit* is a
piece of text that may have a clean near-twin, under a *key*, what is left of it without its
characters beyond ASCII.  A *mapping* is what an aligned pair of twins teaches: that some characters
became one other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Public codec names, as Python spells them.
SINGLE_BYTE = (
    "latin_1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866",
    "mac_roman", "mac_cyrillic", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15", "koi8_r",
)
MULTI_BYTE = ("gb18030", "cp932", "big5", "euc_kr", "euc_jp")
TRUE_LEGACY = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1250", "iso8859_2", "cp852", "cp1252", "cp437", "cp850", "mac_roman")

#: A character pair is usual if this share of the non-ASCII texts has it.
RARE_SHARE = 0.01
#: A pair of codecs with so many mappings is taken to hold for all letters.
WELL_KNOWN = 12
EDGE = ".,;:!?()[]{}\"'*_#|<>/\\-~=+`"
#: Controls that only a wrong decoding leaves (next line, \\x85, is white space).
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
#: A character beyond ASCII written as a number, as web pages do.
REFERENCE = re.compile(r"&#(\d{3,7});")
REPLACEMENT = "�"
SKETCH_BITS = 20
TOKEN = re.compile(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*")
RUN = re.compile(r"[^\x00-\x7f]+")
ASCII = re.compile(r"[\x00-\x7f]+")
#: A short quotation holding nothing but the sequence that it shows.
QUOTED = re.compile(r"\"[^\x00-\x7f][^\x00-\x40\x5b-\x60\x7b-\x7f]{0,7}\"|[“«„][^\x00-\x7f“”]{1,8}[”»“]|(?<!\w)['`][^\x00-\x7f]{1,8}['`](?!\w)|‘[^\x00-\x7f‘’]{1,8}’")


@lru_cache(maxsize=None)
def _encoder(codec: str) -> dict[str, int]:
    """Character to byte; bytes without a character of their own count as C1 controls."""
    return {bytes([b]).decode(codec, "ignore") or chr(b): b for b in range(255, -1, -1)} | {chr(b): b for b in range(128)}


def undo(text: str, wrong: str, true: str) -> str | None:
    """``text`` with the pair undone, or None where its characters or bytes rule the pair out."""
    try:
        if wrong in MULTI_BYTE:
            raw = text.encode(wrong)
        else:
            table = _encoder(wrong)
            raw = bytes([table[c] for c in text])
        out = raw.decode(true)
    except (KeyError, UnicodeError):
        return None
    return out if out != text else None


@lru_cache(maxsize=None)
def _own_runs(wrong: str) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, sorted(c for c in _encoder(wrong) if c > "\x7f"))) + "]+")


def undo_runs(text: str, wrong: str) -> str:
    """``text`` with the pair (``wrong``, UTF-8) undone in each run of the codec's own characters that allows it."""
    return _own_runs(wrong).sub(lambda m: undo(m[0], wrong, "utf_8") or m[0], text)


#: A character of two to four bytes in UTF-8.
SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def undo_sequences(text: str, wrong: str) -> tuple[str, str]:
    """``text`` with the sequences that read as UTF-8 behind ``wrong`` undone, and the characters that came of them.

    What lies between, such as characters of which a byte was lost, stays.  Where less than half of
    the codec's own characters belong to such sequences, they are chance: then nothing is undone.
    """
    table, got = _encoder(wrong), []

    def within(m: re.Match) -> str:
        run = m[0]
        raw, out, at = bytes([table[c] for c in run]), [], 0
        for x in SEQUENCE.finditer(raw):
            try:
                c = x[0].decode()
            except UnicodeError:
                continue
            out += [run[at : x.start()], c]
            got.append(c)
            at = x.end()
        return "".join(out) + run[at:]

    out = _own_runs(wrong).sub(within, text)
    own = sum(map(len, _own_runs(wrong).findall(text)))
    return (out, "".join(got)) if 2 * len("".join(got).encode()) >= own else (text, "")


@lru_cache(maxsize=200_000)
def misread(token: str) -> bool:
    """Whether a run of ``token`` reads as UTF-8 behind one of the single-byte codecs, and not only as phonetic letters and accents."""
    if not any(len(r) > 1 for r in RUN.findall(token)):
        return False
    read = (undo(r, w, "utf_8") or "" for w in SINGLE_BYTE for r in _own_runs(w).findall(token))
    return any(not "\u024f" < c < "\u0370" for x in read for c in x)


def usual_text(text: str) -> str:
    """``text`` without the tokens that may be garbled, so that frequent garbling doesn't count as usual."""
    wrong = {t for t in TOKEN.findall(text) if misread(t)}
    return TOKEN.sub(lambda m: " " if m[0] in wrong else m[0], text) if wrong else text


PAIRS = (
    [(w, "utf_8") for w in (*SINGLE_BYTE, *MULTI_BYTE)]
    + [(w, t) for w in SINGLE_BYTE for t in TRUE_LEGACY if w != t]
    + [(w, t) for w in ("latin_1", "cp1252") for t in MULTI_BYTE]
)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pair_keys(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch positions of neighbours of which one at least isn't ASCII, and where these are."""
    c = np.where((c >= 48) & (c <= 57), 48, c).astype(np.uint64)
    a, b = c[:-1], c[1:]
    keep = np.flatnonzero((a > 127) | (b > 127))
    h = (a[keep] * np.uint64(0x9E3779B97F4A7C15)) ^ (b[keep] * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), keep


def bigram_keys(text: str) -> np.ndarray:
    """Sketch positions of the character pairs of ``text``.

    Lower case; white space and the ends count as one boundary sign, digits as one digit.
    """
    c = codes(" " + text.lower() + " ").copy()
    c[(c <= 32) | (c == 160)] = 32
    return _pair_keys(c)[0]


def spelled_out(text: str) -> str:
    """``text`` with its numeric references to characters beyond ASCII resolved."""
    return REFERENCE.sub(lambda m: chr(int(m[1])) if 127 < int(m[1]) < 0x110000 else m[0], text) if "&#" in text else text


#: Longer tokens are unspaced script; their units are those at their words and numbers.
UNIT_CHARS = 64
ASCII_WORD, LONG_RUN = re.compile(r"[A-Za-z]{3}|[0-9]"), re.compile(r"[^\x00-\x7f]{3,}")
_WORD_BEFORE, _WORD_BEHIND = re.compile(r"(?:[A-Za-z]{3,}|[0-9]+)\Z"), re.compile(r"[A-Za-z]{3,}|[0-9]+")


def skeleton(text: str) -> str:
    """``text`` stripped of its non-ASCII characters."""
    return RUN.sub("", text)


def _shape(run: str) -> str:
    """Which characters of a run are the same: the key of words without any ASCII character."""
    first: dict[str, int] = {}
    return ".".join(str(first.setdefault(c, len(first))) for c in run)


def _token_units(raw: str) -> tuple[tuple[str, str], ...]:
    token, out = raw.strip(EDGE), []
    if len(token) <= UNIT_CHARS:
        kept = skeleton(token)
        if sum(map(str.isalpha, kept)) >= 3:
            out.append(("t" + kept, token))
        elif not kept and 5 <= len(token) <= 24 and len(set(token)) < len(token):
            out.append(("s" + _shape(token), token))
    if ASCII_WORD.search(raw):
        for m in LONG_RUN.finditer(raw):
            run = m[0]
            if (x := _WORD_BEFORE.search(raw, max(0, m.start() - 24), m.start())) is not None:
                out += [("a" + ("0" if x[0].isdigit() else x[0]), run[:n]) for n in (1, 2, 3)]
            if (x := _WORD_BEHIND.match(raw, m.end(), m.end() + 24)) is not None:
                out += [("b" + ("0" if x[0].isdigit() else x[0]), run[-n:]) for n in (1, 2, 3)]
    return tuple(out)


_kept_units = lru_cache(maxsize=200_000)(_token_units)


def units(text: str) -> Iterator[tuple[str, str]]:
    """Keys and units of ``text``.

    A token is a unit under its skeleton if that has three letters; a word without any ASCII
    character under its shape; and what stands next to a word or number inside unspaced script, in
    one to three characters, under that word, or under 0 for any number.
    """
    for raw in dict.fromkeys(TOKEN.findall(text)):
        yield from _kept_units(raw) if len(raw) <= UNIT_CHARS else _token_units(raw)


def align(garbled: str, clean: str) -> list[tuple[str, str]] | None:
    """Pairs of runs that stand between the same ASCII characters, or None if these differ."""
    if ASCII.findall(garbled) != ASCII.findall(clean):
        return None
    a, b = RUN.findall(garbled), RUN.findall(clean)
    if len(a) != len(b):
        return None
    return [(x, y) for x, y in zip(a, b) if x != y]


def _encoded(text: str, codec: str) -> bytes | None:
    try:
        return bytes([_encoder(codec)[c] for c in text]) if codec not in (*MULTI_BYTE, "utf_8") else text.encode(codec)
    except (KeyError, UnicodeError):
        return None


@lru_cache(maxsize=100_000)
def _explaining(x: str, y: str) -> frozenset[int]:
    """Numbers of the pairs that turn ``x`` into ``y``: the bytes of both, in their codecs, are the same."""
    true = {t: _encoded(y, t) for t in ("utf_8", *TRUE_LEGACY, *MULTI_BYTE)}
    wrong = {w: _encoded(x, w) for w in (*SINGLE_BYTE, *MULTI_BYTE)}
    return frozenset(k for k, (w, t) in enumerate(PAIRS) if wrong[w] is not None and wrong[w] == true[t])


def explained_by(runs: list[tuple[str, str]]) -> list[int]:
    """Numbers of the pairs that turn every left side into its right side."""
    return sorted(frozenset.intersection(*(_explaining(x, y) for x, y in runs))) if runs else []


#: In place of a pair's number: of a sign only the first byte is left, read as Latin-1.
LEAD = -1


def mappings(garbled: str, clean: str) -> list[tuple[int, str, str]]:
    """What an aligned pair of twins teaches: pair, characters, and the one that they were."""
    runs = align(garbled, clean)
    if not runs:
        return []
    out, unclear = [], misread(clean)
    for k in explained_by(runs):
        w, t = PAIRS[k]
        if unclear and t != "utf_8":
            continue  # both are garbled, each in its way
        for x, y in runs:
            if w in MULTI_BYTE:  # its characters don't divide as the true ones do
                out += [(k, x, y)] * (len(y) <= 2)
                continue
            at = 0
            for c in y:
                n = len(_encoded(c, t) or b"")
                out.append((k, x[at : at + n], c))
                at += n
    if not out and all(len(x) == len(y) == 1 and not y.isalnum() and y > "\x7f" and x == chr(y.encode()[0]) for x, y in runs):
        out = [(LEAD, x, y) for x, y in runs]
    return [(k, x, y) for k, x, y in out if x != y]


def lost_tokens(text: str) -> list[str]:
    """Tokens of a garbled text that may have lost bytes: with U+FFFD, or a letter that is the first byte of some other."""
    own = (t.strip(EDGE) for t in dict.fromkeys(TOKEN.findall(text)))
    return [t for t in dict.fromkeys(own) if len(t) <= UNIT_CHARS and sum(map(str.isalpha, skeleton(t))) >= 3 and _LOST.search(t)]


_LOST = re.compile("[\ufffd\xc2-\xf4]")


def may_be(lost: str, clean: str) -> bool:
    """Whether ``clean`` may be what ``lost`` was: of each changed run nothing is left but U+FFFD and first bytes, read as Latin-1."""
    runs = align(lost, clean)
    if not runs or REPLACEMENT in clean:
        return False
    left = [(x.replace(REPLACEMENT, ""), y) for x, y in runs]
    return all(not x or x == "".join(chr(c.encode()[0]) for c in y) for x, y in left)


def filled(text: str, by: dict[str, str]) -> str:
    def fill(m: re.Match) -> str:
        bare = m[0].strip(EDGE)
        return m[0].replace(bare, by[bare]) if bare in by else m[0]

    return TOKEN.sub(fill, text)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point a set of bits: Latin, Greek, Cyrillic, CJK, Hangul, other letter; control."""
    spans = ((0x250, 1), (0x370, 32), (0x400, 2), (0x530, 4), (0x2E80, 32), (0xA000, 8), (0xAC00, 32), (0xD7A4, 16), (0xF900, 32), (0xFB00, 8), (0xFF66, 32), (0xFFA0, 8), (0x20000, 32), (0x30000, 8), (0x110000, 32))
    out, lo = np.zeros(0x110000, np.uint8), 0
    for hi, bit in spans:
        out[lo:hi] = bit
        lo = hi
    for o in range(0x110000):
        c = unicodedata.category(chr(o))
        if c[0] == "C":
            out[o] = 128
        elif c[0] != "L":
            out[o] = 0
    return out


_ONE_SCRIPT = np.zeros(256, bool)
_ONE_SCRIPT[[0, 1, 2, 4, 8, 9, 16, 32, 17, 24]] = True


class Judge:
    """Decides on a text with what a corpus has taught: the mappings and how usual characters are.

    ``learned`` has, for each pair of codecs, the mappings that twins showed and how many units
    showed each.  A pair counts as established by two mappings or two units for UTF-8, by three
    mappings for single-byte codecs, where twins that differ by chance may look like one, and by one
    for the others; only established pairs are ever applied, then also to characters that no twin had.

    An established pair with UTF-8 is tried on every token, however usual; it counts where what comes out
    is of one script and at least about as usual as before, or more usual in what can't itself
    be misread, so that frequent garbling doesn't hide itself.  Where only some sequences of a token
    decode, or with other codecs, it must be twice as usual; other codecs are tried only on
    tokens whose character pairs aren't all usual.
    """

    def __init__(self, sketch: np.ndarray, n_docs: int, learned: dict[int, dict[tuple[str, str], int]]):
        self.usual = np.log2(sketch[: 1 << SKETCH_BITS] + 1.0)
        self.unmisread = np.log2(sketch[1 << SKETCH_BITS :] + 1.0)
        self.rare = float(np.log2(max(2.0, RARE_SHARE * n_docs) + 1))
        self.learned = learned
        self.support = {k: sum(m.values()) for k, m in learned.items()}
        self.known = [k for k in range(len(PAIRS)) if k in learned and self._established(k)]
        self.utf8 = [(k, PAIRS[k][0]) for k in self.known if PAIRS[k][1] == "utf_8"]
        self.lead = {x: y for (x, y), n in sorted(learned.get(LEAD, {}).items(), key=lambda m: m[1]) if n >= 2}
        self.seen: dict[str, tuple] = {}
        self.tables = [
            (k, {ord(c): x for c in _encoder(w) if c > "\x7f" and (x := undo(c, w, t))}, {c for c in _encoder(w) if c > "\x7f"})
            for k in self.known for w, t in [PAIRS[k]] if w in SINGLE_BYTE and t in TRUE_LEGACY
        ]

    def _established(self, k: int) -> bool:
        n, (w, t) = len(self.learned[k]), PAIRS[k]
        return n >= 3 if t in TRUE_LEGACY else n >= 2 or self.support[k] >= 2 or t in MULTI_BYTE

    def _scores(self, texts: list[str], usual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean and least usualness of the character pairs of each, and whether it is well formed."""
        c = codes(" " + " ".join(x.replace(" ", "\xa0") for x in texts).lower() + " ").copy()
        part = np.cumsum(c == 32)[:-1] - 1
        c[(c < 32) | (c == 160)] = 32
        h, keep = _pair_keys(c)
        n, v = len(texts), usual[h]
        at = part[keep]
        count = np.bincount(at, minlength=n)
        mean = np.bincount(at, v, minlength=n) / np.maximum(count, 1)
        least = np.full(n, 99.0)
        np.minimum.at(least, at, v)
        bits = np.zeros(n, np.uint8)
        np.bitwise_or.at(bits, part, _classes()[c[:-1]] & np.where(c[:-1] == 32, 0, 255).astype(np.uint8))
        return np.where(count > 0, mean, 0.0), least, _ONE_SCRIPT[bits]

    def weigh(self, token: str) -> tuple:
        """(pair, gain, restored, whether learned, letters changed) for each pair that counts."""
        hit = self.seen.get(token)
        if hit is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            hit = self.seen[token] = self._weigh(token)
        return hit

    def _weigh(self, token: str) -> tuple:
        return self._by_utf8(token) or self._by_legacy(token)

    def _by_utf8(self, token: str) -> tuple:
        tried: dict[str, tuple[int, str]] = {}
        for k, w in self.utf8:
            if (x := undo(token, w, "utf_8")) is not None and not x.isascii():
                tried.setdefault(x, (k, x))
        gain, whole = -0.5, bool(tried)
        if not tried:  # right characters beside the wrong ones, or some that lost a byte
            for k, w in self.utf8:
                if w in SINGLE_BYTE:
                    x, got = undo_sequences(token, w)
                    if got:
                        tried.setdefault(x, (k, got))
            long = any(c > "\u07ff" and c.isalpha() for _, got in tried.values() for c in got)
            gain = -0.5 if CONTROL.search(token) else 0.0 if long else 1.0
        if not tried:
            return ()
        fresh, stage = tried, dict.fromkeys(tried, 0)
        for n in (1, 2):  # text that went wrong twice, or three times
            fresh = {x: (k, x) for y, (k, _) in fresh.items() for _, w in self.utf8 if w in SINGLE_BYTE and (x := undo(y, w, "utf_8")) is not None and x not in tried}
            tried |= fresh
            stage |= dict.fromkeys(fresh, n)
        m = self._scores([token, *tried], self.usual)[0]
        u, rarest, _ = self._scores([token, *tried], self.unmisread)
        ok = self._scores([got for _, got in tried.values()], self.usual)[2]
        by_all, by_clear = m[1:] - m[0], u[1:] - u[0]
        # where the whole token decodes, it may also be that only its rarest pair becomes usual, as in a lone sign
        enough = ok & ((by_all >= gain) | (by_clear > max(gain, 0.0)) | whole & (rarest[1:] > rarest[0] + 1))
        out = [(k, g, x, True, 1) for (x, (k, _)), g, e in zip(tried.items(), np.maximum(by_all, by_clear), enough) if e]
        return tuple(sorted(out, key=lambda o: -o[1] - 2 * stage[o[2]] - 0.25 * np.log2(1 + self.support[o[0]])))

    def _by_legacy(self, token: str) -> tuple:
        mean, least, formed = self._scores([token], self.usual)
        if not self.lead.keys().isdisjoint(token):  # however usual the letter is elsewhere
            x = token.translate({ord(x): y for x, y in self.lead.items()})
            m = self._scores([token, x], self.unmisread)[0]
            if (g := float(m[1] - m[0])) >= 1:
                return ((LEAD, g, x, True, 1),)
        if least[0] >= self.rare:
            return ()
        tried: dict[str, int] = {}
        chars = {c for c in token if c > "\x7f"}
        for k, table, own in self.tables:
            if chars <= own and not chars.isdisjoint(map(chr, table)):
                tried.setdefault(token.translate(table), k)
        for k in self.known:
            if PAIRS[k][1] in MULTI_BYTE and len(chars) > 1 and (x := undo(token, *PAIRS[k])) is not None:
                tried.setdefault(x, k)
        tried.pop(token, None)
        if not tried:
            return ()
        m, _, ok = self._scores(list(tried), self.usual)
        out = []
        for (x, k), g, o in zip(tried.items(), m - mean[0], ok):
            if not o or x.isascii() or g < 1:
                continue
            if PAIRS[k][1] in MULTI_BYTE:
                out.append((k, float(g), x, not formed[0] and g >= 2, sum(c > "\x7f" and c.isalpha() for c in token)))
                continue
            at = [i for i, (c, d) in enumerate(zip(token, x)) if c != d]
            wide = len(self.learned[k]) >= WELL_KNOWN  # then letters that no twin had are as good as shown
            within = [token[i - 1 : i].isalpha() and token[i + 1 : i + 2].isalpha() for i in at]
            shown = [(token[i], x[i]) in self.learned[k] or wide and x[i].isalpha() and (token[i].isalpha() or w) for i, w in zip(at, within)]
            if any(not s and x[i].isalpha() and not token[i].isalpha() for s, i in zip(shown, at)):
                continue  # a sign becomes a letter only where twins showed it
            # a sign behind or before a word may be right there
            letters = sum(token[i].isalpha() or s and w for s, w, i in zip(shown, within, at))
            cased = letters or x in (x.lower(), x.title(), x.upper())
            sure = letters and g >= 2 and (cased and all(shown) or not formed[0])
            out.append((k, float(g), x, bool(sure), letters))
        return tuple(out)

    def best(self, text: str, whole: bool = False) -> tuple[bool, dict[str, str], bool]:
        """Whether ``text`` is garbled, what its tokens become, whether some can't be restored.

        Without ``whole`` it stops at the first sufficient evidence.
        """
        text = spelled_out(text)
        if text.isascii():
            return False, {}, False
        shown = QUOTED.sub(" ", text)
        lost = REPLACEMENT in shown
        if lost and not whole:
            return True, {}, True
        sure: dict[str, str] = {}
        other: dict[int, list] = {}
        for token in dict.fromkeys(TOKEN.findall(shown)):
            for k, g, x, learned, letters in self.weigh(token):
                if k == LEAD or PAIRS[k][1] == "utf_8":
                    if not whole:
                        return True, {}, False
                    sure.setdefault(token, x)
                else:
                    other.setdefault(k, []).append((token, g, x, learned, letters))
        chosen: dict[str, str] = {}
        most = 0.0
        for k, found in other.items():
            letters = sum(f[4] for f in found)
            total = sum(f[1] * (1 + f[3]) for f in found) + 0.25 * np.log2(1 + self.support[k])
            enough = any(f[3] for f in found) or len(found) >= 2 and letters >= 3 or letters >= 4 and total >= 2
            if enough and total > most:
                most, chosen = total, {f[0]: f[2] for f in found}
        if whole and chosen and (k := next((k for k, f in other.items() if {t[0]: t[2] for t in f} == chosen), None)) is not None:
            chosen = self._fill(shown, k, chosen)
        wrong = lost or bool(CONTROL.search(shown))
        return bool(sure or chosen or wrong), chosen | sure, wrong and not sure

    def _fill(self, text: str, k: int, chosen: dict[str, str]) -> dict[str, str]:
        """The pair also for tokens too short to show it, in lines of which it turned most."""
        more = dict(chosen)
        for line in text.split("\n"):
            tokens = TOKEN.findall(line)
            if sum(t in chosen for t in tokens) * 2 > len(tokens):
                more |= {t: x for t in tokens if t not in chosen and (x := undo(t, *PAIRS[k])) is not None}
        return more

    def restore(self, text: str) -> tuple[bool, str]:
        """Whether ``text`` is garbled, and the text as far as it can be restored."""
        garbled, by, _ = self.best(text, whole=True)
        text = spelled_out(text) if garbled else text
        return garbled, TOKEN.sub(lambda m: by.get(m[0], m[0]), text) if by else text
