"""Statistics of texts and of their units, the votes these cast, and what the votes are worth.

All of a batch's texts are looked at together as bytes of UTF-8, by array operations.  Bytes
beyond ASCII count as letters, so that a wrongly decoded text looks like what it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: What a unit that isn't prose may be, and what votes on it; a voter without an opinion abstains.
TYPES = ("table", "list", "junk")
TYPE_VOTERS = ("separators", "shape", "words", "digits")
ABSTAIN = len(TYPES)
UNIT_CHARS = 160
WORD_BITS = 20
#: Digits, symbols and separators go together, so they have one vote: the model takes votes as
#: independent given the class.
VOTERS = ("clutter", "endings", "line_words", "long_tokens", "repeats", "common_words")
LISTED, NONE, PROSE = -1, 0, 1
_B = np.uint64(0x9E3779B97F4A7C15)

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_LETTER = ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 65) & (_BYTE <= 90)) | (_BYTE >= 128)
_SYMBOL = ~(_DIGIT | _SPACE | _LETTER) & (_BYTE > 32)
_SEPARATOR = np.isin(_BYTE, [ord(c) for c in "|\t;<>/=,"])
_START = (_BYTE & 0xC0) != 0x80  # first byte of a character
_POWERS = np.ones(64, np.uint64)
with np.errstate(over="ignore"):
    for _k in range(1, 64):
        _POWERS[_k] = _POWERS[_k - 1] * _B


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


#: A text is said over and over if it has so many word triples at least, and so few different ones.
LEAST_TRIPLES, MOST_DISTINCT = 12, 40


def said_over(batches: Iterator[Batch]) -> bool:
    """What ``Batch`` finds for a text in one batch, for one that comes in several, one after the other."""
    distinct: set[int] = set()
    total, last = 0, np.zeros(0, np.uint64)
    for b in batches:
        h = np.concatenate([last, b.word_hash])
        with np.errstate(over="ignore"):
            t = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:]
        total, last = total + len(t), h[-2:]
        distinct.update(np.unique(t).tolist())
        if len(distinct) > MOST_DISTINCT:
            return False
    return total >= LEAST_TRIPLES and len(distinct) * 3 <= total


class Batch:
    """The units of a batch of texts and their statistics.

    A unit is a run of lines that begin within the same ``UNIT_CHARS`` bytes of the text; within
    lines of that length and more, blanks also divide.
    """

    def __init__(self, texts: list[str]):
        self.n_texts = len(texts)
        raw = "\n".join(texts).lower().encode("utf-8", "replace") + b"\n"
        b = np.frombuffer(raw, np.uint8)
        lengths = np.array([len(t.lower().encode("utf-8", "replace")) + 1 for t in texts], np.int64)
        ends = np.cumsum(lengths)
        self.text_starts = ends - lengths
        newline = b == 10
        line_starts = np.flatnonzero(np.concatenate([[True], newline[:-1]]))
        line_ends = np.append(line_starts[1:], len(b))
        space = _SPACE[b]

        # divide
        long_line = np.zeros(len(b) + 1, np.int8)
        far = line_ends - line_starts >= UNIT_CHARS
        np.add.at(long_line, line_starts[far], 1)
        np.add.at(long_line, line_ends[far], -1)
        inner = np.flatnonzero((b == 32) & (np.cumsum(long_line[:-1]) > 0))
        marks = np.union1d(line_starts, inner + 1)
        marks = marks[marks < len(b)]
        doc = np.searchsorted(self.text_starts, marks, "right") - 1
        number = (marks - self.text_starts[doc]) // UNIT_CHARS
        new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(number) != 0)])
        starts = marks[new]
        self.doc = doc[new]
        unit_of = np.cumsum(np.bincount(starts, minlength=len(b))[: len(b)]) - 1

        # words: runs of letters, but a sign of a script without spaces is a word of its own
        letter = _LETTER[b]
        wide = (b >= 0xE3) & (b <= 0xE9)
        after_wide = np.zeros(len(b), bool)
        after_wide[3:] = wide[:-3]
        begins = letter & (np.concatenate([[True], ~letter[:-1]]) | wide | (after_wide & letter))
        at = np.flatnonzero(begins)
        self.word_unit = unit_of[at]
        stop = letter.copy()
        masked = np.where(stop, b, 0).astype(np.uint64)
        place = np.arange(len(b)) - (at[np.cumsum(begins) - 1] if len(at) else 0)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(masked * _POWERS[np.clip(place, 0, 63)], at) if len(at) else np.zeros(0, np.uint64)
            h ^= h >> np.uint64(33)
            h *= np.uint64(0xC2B2AE3D27D4EB4F)
            self.word_hash = h ^ (h >> np.uint64(29))
        self.word_slot = (self.word_hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)

        n = len(starts)
        self.n = n
        self.chars = _sums(_START[b] & ~newline, starts)
        self.solid = np.maximum(1, _sums(~space, starts))
        self.words = np.bincount(self.word_unit, minlength=n)
        self.letters = _sums(letter & _START[b], starts)
        beyond = b >= 128
        outside = _sums(beyond & _START[b], starts)
        # unspaced script, also where it was wrongly decoded: about as many words as this
        self.spoken = np.where(outside * 3 > self.letters, np.maximum(self.words, self.letters // 3), self.words)
        self.word_plain = np.add.reduceat(beyond & letter, at) == 0 if len(at) else np.zeros(0, bool)
        self.digits = _sums(_DIGIT[b], starts) / self.solid
        self.symbols = _sums(_SYMBOL[b], starts) / self.solid
        gap = (b == 32) & np.concatenate([[False], b[:-1] == 32]) & ~np.concatenate([[False], newline[:-1]])
        dashed = (b == 45) & np.concatenate([[False], b[:-1] == 32]) & np.concatenate([b[1:] == 32, [False]])
        bullet = (b == 0xC2) & np.isin(np.concatenate([b[1:], [0]]), [0xB7, 0xBB]) | (b == 0xE2) & np.isin(np.concatenate([b[1:], [0]]), [0x80, 0x96]) & np.isin(np.concatenate([b[2:], [0, 0]]), [0xA2, 0xAA, 0x93, 0x94])
        bullet &= np.concatenate([[True], space[:-1]])
        separators = _sums(_SEPARATOR[b] | gap | dashed | bullet, starts)

        # lines with something in them, and those that end as sentences do
        filled = np.add.reduceat((~space).astype(np.int64), line_starts) > 0
        last = np.maximum.accumulate(np.where(space, -1, np.arange(len(b))))[line_ends - 1]
        final = b[np.maximum(last, 0)]
        closing = np.isin(final, [34, 39, 41, 93])
        final = np.where(closing, b[np.maximum(last - 1, 0)], final)
        wide_stop = (b[np.maximum(last - 2, 0)] == 0xE3) & (b[np.maximum(last - 1, 0)] == 0x80) & (final == 0x82)
        quote = (b[np.maximum(last - 2, 0)] == 0xE2) & (b[np.maximum(last - 1, 0)] == 0x80)
        behind = b[np.maximum(last - 3, 0)]
        stops = [33, 46, 63]
        ended = filled & (np.isin(final, stops) | wide_stop | quote & (np.isin(behind, stops) | (final == 0xA6)))
        line_unit = unit_of[line_starts]
        self.line_ends = np.bincount(line_unit, filled, n), np.bincount(line_unit, ended, n)  # by where lines begin
        self.lines = np.maximum(1, self.line_ends[0])
        self.ended = self.line_ends[1] / self.lines
        inside = np.isin(b, stops) & np.concatenate([space[1:], [True]]) | wide & (np.concatenate([b[1:], [0]]) == 0x80) & (np.concatenate([b[2:], [0, 0]]) == 0x82)
        self.stops = _sums(inside, starts)
        self.separators = separators / np.maximum(4, self.spoken + self.lines)
        gaps = np.flatnonzero(np.concatenate([[True], space, [True]]))
        size = np.diff(gaps) - 1
        token_start = gaps[:-1][size >= 28]
        self.long = np.zeros(n, bool)
        if len(token_start):
            wide_in = np.concatenate([[0], np.cumsum(b >= 128)])
            plain = wide_in[np.minimum(token_start + 28, len(b))] - wide_in[token_start] < 4
            self.long[unit_of[np.minimum(token_start[plain], len(b) - 1)]] = True
        self.word_doc = self.doc[self.word_unit]
        self.repeats = self._repeats()
        self.unit_repeats = self.repeats[self.doc]

    def judge_repeats(self, known: dict[int, bool]) -> None:
        """Takes the verdict on some texts, of which these are but pieces, from elsewhere."""
        if known:
            self.repeats = np.array([known.get(k, r) for k, r in enumerate(self.repeats.tolist())], bool)
            self.unit_repeats = self.repeats[self.doc]

    def _repeats(self) -> np.ndarray:
        """Texts of few word triples, said three times over on average."""
        out = np.zeros(self.n_texts, bool)
        if len(self.word_hash) < 3:
            return out
        with np.errstate(over="ignore"):
            t = (self.word_hash[:-2] * np.uint64(3) + self.word_hash[1:-1]) * np.uint64(5) + self.word_hash[2:]
        d = self.word_doc[:-2]
        whole = d == self.word_doc[2:]
        t, d = t[whole], d[whole]
        order = np.lexsort((t, d))
        t, d = t[order], d[order]
        first = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])]) if len(t) else np.zeros(0, bool)
        total, distinct = np.bincount(d, minlength=self.n_texts), np.bincount(d, first, self.n_texts)
        return (total >= LEAST_TRIPLES) & (distinct * 3 <= total) & (distinct <= MOST_DISTINCT)

    def seeds(self) -> np.ndarray:
        """A sure guess for each unit by form alone: prose, listed or neither."""
        per_line = self.spoken / self.lines
        listed = (self.digits > 0.25) | (self.symbols > 0.2) | (self.separators > 0.45) | (self.lines >= 3) & (per_line <= 5) & (self.stops <= self.lines / 3)
        prose = (self.words >= 12) & (self.digits < 0.06) & (self.symbols < 0.09) & (self.separators < 0.2) & (per_line > 6) & ((self.ended > 0.5) | (self.stops > 0))
        return np.where(listed, LISTED, np.where(prose, PROSE, NONE))

    def votes(self, weights: np.ndarray, known: np.ndarray) -> np.ndarray:
        """A row for each unit, a column for each of ``VOTERS``."""
        w, k = weights[self.word_slot], known[self.word_slot]
        n_known = np.bincount(self.word_unit, k, self.n)
        common = np.bincount(self.word_unit, w * k, self.n) / np.maximum(1, n_known)
        vote = lambda x, low, high: np.where(x < low, PROSE, np.where(x > high, LISTED, NONE))
        heard = (n_known * 3 >= self.words) & (n_known > 2)
        strange = np.bincount(self.word_unit, self.word_plain & (k == 0), self.n) * 2 > self.words
        clutter = np.stack([vote(self.digits, 0.04, 0.15), vote(self.symbols, 0.07, 0.15), vote(self.separators, 0.15, 0.35)])
        out = np.stack(
            [
                clutter.min(axis=0),
                np.where((self.ended > 0.6) | (self.stops >= 2), PROSE, np.where((self.stops == 0) & (self.lines > 3), LISTED, NONE)),
                np.where((self.stops == 0) & (self.lines == 1) & (self.spoken > 7), NONE, vote(-self.spoken / self.lines, -7, -4)),
                np.where(self.long, LISTED, NONE),
                np.where(self.unit_repeats, LISTED, NONE),
                np.where((self.words == 0) | strange, LISTED, np.where(heard, vote(-common, -0.7, -0.5), NONE)),
            ],
            axis=1,
        )
        # what is said over and over needn't look like a list, but nothing else speaks for it either
        over = self.unit_repeats[:, None] & (np.arange(len(VOTERS)) != VOTERS.index("repeats"))
        return np.where(over & (out == PROSE), NONE, out).astype(np.int8)

    def type_votes(self, weights: np.ndarray, known: np.ndarray) -> np.ndarray:
        """A row for each unit, a column for each of ``TYPE_VOTERS``: a type's number, or ``ABSTAIN``."""
        table, listed, junk = range(len(TYPES))
        per_part = self.spoken / self.lines
        short = (self.lines > 1) & (per_part <= 6)
        n_known = np.bincount(self.word_unit, known[self.word_slot], self.n)
        strange = (self.words == 0) | (n_known * 2 < self.words) | self.long | self.unit_repeats
        first = lambda *cases: np.select([c for c, _ in cases], [t for _, t in cases], ABSTAIN)
        return np.stack(
            [
                first((self.separators > 0.6, table), (self.separators > 0.15, listed), (~short, junk)),
                first((short & (self.symbols < 0.2), listed), ((self.lines > 1) & (self.digits > 0.2), table), (self.lines == 1, junk)),
                first((strange, junk), (n_known * 4 >= self.words * 3, listed)),
                first((self.digits > 0.25, table), (self.digits < 0.02, listed)),
            ],
            axis=1,
        )


def pattern(votes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(votes), np.int32)
    for j in range(votes.shape[1]):
        out = out * 3 + votes[:, j] + 1
    return out


def type_pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (len(TYPES) + 1) ** np.arange(votes.shape[1])


def type_posteriors(counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The posterior of each type for each pattern of type votes, from how many units show each pattern.

    Expectation-maximization as for prose, over three classes: every voter has its own chances of every vote
    and of abstaining in each class.  It starts from the votes cast; the last bit of prior keeps patterns that no
    unit shows at even chances.
    """
    n_votes = len(TYPES) + 1
    votes = np.arange(len(counts))[:, None] // n_votes ** np.arange(len(TYPE_VOTERS)) % n_votes
    cast = np.stack([(votes == t).sum(axis=1) for t in range(len(TYPES))], axis=1) + 0.1
    post = cast / cast.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        old, mass = post, counts[:, None] * post
        prior = np.log((mass.sum(axis=0) + 1) / (mass.sum() + len(TYPES)))
        log = np.tile(prior, (len(counts), 1))
        for j in range(len(TYPE_VOTERS)):
            seen = np.stack([np.bincount(votes[:, j], mass[:, t], n_votes) for t in range(len(TYPES))], axis=1) + 1.0
            log += np.log(seen / seen.sum(axis=0))[votes[:, j]]
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        if np.abs(post - old).max() < 1e-6:
            break
    return post


def unpattern(n: int) -> list[int]:
    out = []
    for _ in VOTERS:
        n, x = divmod(n, 3)
        out.append(x - 1)
    return out[::-1]


def learn_weights(prose: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of the words' shares in prose and in lists, within -1 and 2, and which are known.

    Ten occurrences in the proportion of the whole are added to each, so a rare word weighs little.
    """
    a, b = max(1, prose.sum()), max(1, listed.sum())
    r = np.log((prose + 10 * a / (a + b)) / a) - np.log((listed + 10 * b / (a + b)) / b)
    return np.clip(r, -1, 2), (prose + listed >= 3).astype(float)


def expectation_maximization(counts: dict[int, int], rounds: int = 300) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of prose for each pattern of votes, the voters' chances of each vote, the prior.

    Votes are taken as independent given the class; each voter has its own chances of each
    vote in either class.  It starts from the majority.
    """
    if not counts:
        return {}, np.full((2, len(VOTERS), 3), 1 / 3), 0.5
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    v = np.array([unpattern(k) for k in keys]).reshape(-1, len(VOTERS)) + 1
    post = 1 / (1 + np.exp(-(v - 1).sum(1).astype(float)))
    chance, prior = np.full((2, len(VOTERS), 3), 1 / 3), 0.5
    for _ in range(rounds):
        old = post
        for c, p in enumerate((1 - post, post)):
            for j in range(len(VOTERS)):
                seen = np.bincount(v[:, j], n * p, 3) + 1.0
                chance[c, j] = seen / seen.sum()
        prior = float((n * post).sum() + 1) / (n.sum() + 2)
        log = [np.log(q) + sum(np.log(chance[c, j][v[:, j]]) for j in range(len(VOTERS))) for c, q in enumerate((1 - prior, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        if np.abs(post - old).max(initial=0) < 1e-6:
            break
    return dict(zip(keys, post.tolist())), chance, prior
