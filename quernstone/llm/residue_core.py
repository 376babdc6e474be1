"""Passages, their features, and a naive Bayes model learned from positive and unlabelled ones."""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np

FEATURE_BITS = 18
#: A word's letter triples say much the same, so each counts only so much.
TRIPLES = 0.3
#: What is quoted, or code between marks, is not the record's own content.
QUOTED = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\"[^\"\n]{0,120}\"|“[^”\n]{0,120}”|‘[^’\n]{0,120}’", re.S)
#: Ways of marking a place to be filled in; the name inside is one to three words.
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.-][A-Za-z0-9]+){0,3}"
_UPPER = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+){0,3}"
SLOT = re.compile(
    rf"\{{\{{[ ]?{_NAME}[ ]?\}}\}}|[$#]\{{{_NAME}\}}|\{{%[ ]?\w+ {_NAME}[ ]?%\}}|<%=?[ ]?{_NAME}[ ]?%>|%\({_NAME}\)s|%{_UPPER}%|\${_UPPER}\$|@@{_UPPER}@@"
    rf"|__{_UPPER}__|\[\[{_NAME}\]\]|«{_NAME}»|(?<![\w$#%{{]){{{_NAME}}}(?!}})|<{_UPPER}>|<(?i:insert|your|enter) {_NAME}>|\[(?i:insert|your|enter|add) [^\]\n]{{1,40}}\]|\((?i:tbd|tbc|todo)\b[^)\n]{{0,40}}\)"
)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[|©]")
LINES = re.compile(r"[\n\r]+")
DIGITS = re.compile(r"\d+")
SENTENCE = re.compile(r"(?<=[.!?。])\s+")
LONG_LINE = 240
#: A record no longer than this that matches one of these is trusted to be nothing but residue: a short
#: seed of what such pages say; the rest is for the model to find.
TRUSTED_CHARS = 320
TRUSTED = re.compile(
    # error pages
    r"(?im)^(?:(?:http/\d(?:\.\d)?|error|status)[ :]*)?[45]\d\d\b.{0,3}(?:not found|forbidden|internal server|bad gateway|service unavailable|too many)"
    r"|\b(?:page|seite|note|report|site|link)\b.{0,30}\b(?:not found|nicht gefunden|introuvable|isn['’]t available|cannot be shown|failed to load)\b"
    r"|\b(?:connection failed|could not reach|access denied|down for maintenance|rate limit exceeded)\b"
    # notices that scripts are required
    r"|\b(?:javascript|js|scripts|scripting|client-side code)\b.{0,30}\b(?:on|off|enabled|allowed|disabled|required)\b|\b(?:enable|allow|active|switch on|turn on)\b.{0,30}\b(?:javascript|js|scripts|scripting)\b"
    r"|\b\w*(?:a[ck]?ti[vw]|attiv)\w*\b.{0,30}\bjavascript\b|\bjavascript\b.{0,30}\b\w*(?:a[ck]?ti[vw]|attiv)\w*\b"
    # filler, the same said four times, and what is still to be written
    r"|^lorem ipsum|\b(\w[^\n]{1,40}?)(?:[ .]+\1){3,}|^\W*(?:todo|tbd)(?:[:.]|$)|\bto be (?:filled in|written|added)\b|\b(?:no text yet|coming soon|goes here)\b"
    r"|^(?:write|type|enter)\b.{0,60}\b(?:here|in this (?:box|field|space))\b|^title of the \w+$|^this is a (?:dummy|sample|placeholder)\b"
)
#: The commonest way of marking a place to be filled in is trusted wherever it stands.
SEED_SLOT = re.compile(rf"\{{\{{[ ]?{_NAME}[ ]?\}}\}}")


#: Without one of these there is no place to be filled in.
HINT = re.compile(r"\{\{|[$#]\{|\{%|<%|%\(|%[A-Z]|\$[A-Z]|@@|__|\[\[|«|\{[A-Za-z]|<[A-Za-z]|\[(?i:ins|you|ent|add)|\((?i:tb|todo)")


def own_text(text: str) -> str:
    return QUOTED.sub(" ", text) if any(c in text for c in "`\"“‘") else text


def passages(text: str) -> list[str]:
    """Lines, longer ones by sentence, and apart from them each place to be filled in."""
    own = own_text(text)
    out = []
    if _hinted(own):
        out = [m[0] for m in SLOT.finditer(own)]
        own = SLOT.sub(" ", own)
    for line in LINES.split(own):
        line = line.strip()
        if line:
            out += [line] if len(line) <= LONG_LINE else [s for s in SENTENCE.split(line) if s.strip()]
    return out


def _hashed(feature: str, triple: bool = False) -> int:
    return (crc32(feature.encode("utf-8", "replace")) >> (32 - FEATURE_BITS)) + (triple << FEATURE_BITS)


def _hinted(p: str) -> bool:
    """Whether there may be a place to be filled in; most passages have none of these characters."""
    return ("{" in p or "%" in p or "<" in p or "[" in p or "$" in p or "@" in p or "__" in p or "«" in p or "(" in p) and bool(HINT.search(p))


def _words(form: str) -> list[str]:
    return WORD.findall((SLOT.sub(" qslotq ", form) if _hinted(form) else form).lower())


class _Lexicon(dict):
    """Numbers of words, and for each its hash and its features, a word and its letter triples; a bounded number is kept."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hashes, self.starts, self.sizes, self.flat = array("I"), array("i"), array("i"), array("i")
        for mark in ("^", "$"):  # of the beginning and end of a passage, which have no features
            self._add(mark, [])

    def _add(self, word: str, own: list[int]) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(crc32(word.encode("utf-8", "replace")))
        self.starts.append(len(self.flat))
        self.sizes.append(len(own))
        self.flat.extend(own)
        return n

    def __missing__(self, w: str) -> int:
        own = [_hashed("w" + w)]
        if len(w) > 4 and w != "qslotq" and not w.isdigit():
            x = f"<{w}>"
            own += [_hashed("t" + x[k : k + 3], True) for k in range(0, len(x) - 2, 2)]
        return self._add(w, own)


_LEXICON = _Lexicon()
_SAME, _SLOT = _hashed("m same"), _hashed("m slot")


def featured(passages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all passages, their numbers written as 0: hashed words, neighbouring words, letter triples of words and marks of form.

    With them the number of the passage that each is of, in order, and how many words each passage has.
    """
    if len(_LEXICON) > 300_000:
        _LEXICON.reset()
    number, seq, n_words, marks, marked = _LEXICON.__getitem__, [], np.zeros(len(passages), np.int64), [], []
    for k, p in enumerate(passages):
        words = _words(p)
        n = n_words[k] = len(words)
        if n:
            seq.append(0)
            seq += map(number, words)
            seq.append(1)
            if n >= 4 and len(set(words)) * 3 <= n:
                marks += [_SAME] * 3
                marked += [k] * 3
            if "qslotq" in words:
                marks += [_SLOT] * 4
                marked += [k] * 4
    if not seq:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), n_words
    word = np.array(seq, np.int64)
    owner = np.repeat(np.arange(len(passages)), np.where(n_words > 0, n_words + 2, 0))
    hashes = np.frombuffer(_LEXICON.hashes, np.uint32)[word].astype(np.uint64)
    with np.errstate(over="ignore"):
        pair = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - FEATURE_BITS)
    joined = word[:-1] != 1
    inner = word > 1
    sizes, starts = (np.frombuffer(x, np.int32)[word[inner]].astype(np.int64) for x in (_LEXICON.sizes, _LEXICON.starts))
    own = np.frombuffer(_LEXICON.flat, np.int32)[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    f = np.concatenate([own, pair[joined].astype(np.int32), np.array(marks, np.int32)])
    of = np.concatenate([np.repeat(owner[inner], sizes), owner[:-1][joined], np.array(marked, np.int64)])
    order = np.argsort(of, kind="stable")
    return f[order], of[order], n_words


class Model:
    """Log odds of features, and of the classes."""

    def __init__(self, odds: np.ndarray, prior: float):
        self.odds, self.prior = odds, prior

    def scores(self, passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log odds of residue of each passage, and how many words it has; of no words the score means nothing."""
        f, of, n_words = featured(passages)
        n = np.bincount(of, minlength=len(passages))
        sums = np.bincount(of, self.odds[f], len(passages))
        return sums * np.minimum(1.0, 14 / np.maximum(1, n)) ** 0.5 + self.prior, n_words

    def worst(self, records: list[list[str]]) -> list[tuple[float | None, str | None]]:
        """Of each record's passages the one with the highest score among those that may decide, and the score.

        One of one or two words decides only if it is a place to be filled in or trusted, or where there are no longer ones.
        Numbers are all alike.
        """
        forms: dict[str, int] = {}
        numbered = [[(p, forms.setdefault(DIGITS.sub("0", p), len(forms))) for p in dict.fromkeys(ps)] for ps in records]
        scores, n_words = (x.tolist() for x in self.scores(list(forms)))
        out = []
        for ps in numbered:
            best: list[tuple[float | None, str | None]] = [(None, None), (None, None)]
            weighty = False
            for p, k in ps:
                n = n_words[k]
                long = n > 2 or bool(SLOT.fullmatch(p)) or trusted(p)
                weighty |= long
                if n and (best[long][0] is None or scores[k] > best[long][0]):
                    best[long] = scores[k], p
            out.append(best[weighty])
        return out


def chances(f: np.ndarray, sizes: np.ndarray, odds: np.ndarray, prior: float, margin: float) -> np.ndarray:
    """How probably each passage is residue beyond ``margin``; ``f`` holds their features, ``sizes`` how many each has, one at least."""
    if not len(sizes):
        return np.zeros(0)
    sums = np.add.reduceat(odds[f], np.cumsum(sizes) - sizes, dtype=np.float64)
    damp = np.minimum(1.0, 14 / sizes) ** 0.5
    return 1 / (1 + np.exp(-np.clip(sums * damp + prior - margin, -50, 50)))


def counted(f: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How often each feature occurs, each passage counting its weight."""
    some = weights > 0
    if not some.all():
        f, sizes, weights = f[np.repeat(some, sizes)], sizes[some], weights[some]
    return np.bincount(f, np.repeat(weights, sizes), 2 << FEATURE_BITS)


def fit(pos: np.ndarray, n_pos: float, total: np.ndarray, n_total: float, guess, rounds: int = 12, smooth: float = 0.2,
        margin: float = 4.0, weight: float = 0.3) -> Model:
    """Naive Bayes by expectation-maximization: trusted passages stay residue, the others' class is a
    guess that each round makes again.  It starts with the unlabelled ones as content; one of them
    joins the residue only beyond ``margin``, and then counts ``weight`` of a trusted one, so that
    the class doesn't drift away from what it was trusted for.

    ``pos`` and ``total`` are the feature counts of the trusted and the other passages, ``n_pos`` and
    ``n_total`` their numbers.  ``guess(odds, prior, margin, before)`` gives the feature counts of the
    others weighted by their chances, the sum of these, and by how much the chances differ at most
    from those with the arguments ``before`` (None: from 0)."""
    size = 2 << FEATURE_BITS
    share_of = np.where(np.arange(size) < size // 2, 1.0, TRIPLES)
    guessed, n_guessed = np.zeros(size), 0.0
    odds, prior, before = np.zeros(size), 0.0, None
    for _ in range(rounds):
        a = pos + weight * guessed
        b = np.maximum(total - guessed, 0.0)
        # features seen in neither say nothing: smoothing in the proportion of the two classes
        sa, sb = a.sum() + 1e-9, b.sum() + 1e-9
        share = sa / (sa + sb)
        odds = np.log((a + smooth * share * 5 + 1e-6) / sa) - np.log((b + smooth * (1 - share) * 5 + 1e-6) / sb)
        odds = np.clip(odds, -6, 6) * share_of
        prior = float(np.log((n_pos + n_guessed + 1) / (n_total - n_guessed + 1)))
        prior = max(prior, -6.0)
        guessed, n_guessed, change = guess(odds, prior, margin, before)
        if change < 1e-3:
            break
        before = (odds, prior, margin)
    return Model(odds.astype(np.float32), prior)


def trusted(text: str) -> bool:
    """Whether the whole record is residue beyond doubt."""
    own = own_text(text).strip()
    if not own or len(own) > TRUSTED_CHARS:
        return False
    return bool(TRUSTED.search(own))
