"""Texts garbled by decoding with a wrong character encoding: found, and restored where possible.

A hidden Markov model labels the characters of a text with one clean state and one state per pair
(true encoding, encoding used). Emissions depend on the character before, so that a lone capital A
tilde and one followed by a continuation character differ. They are fitted on every text of the table:
the clean state on the texts as they are, without those in which some run can
be undone, each pair's state on the same texts sent through the pair, with known labels. Stretches of
ASCII, which every pair leaves alone, count as their first and last character class; before a text is sent
through the pairs their middle is left out, which changes no count. Each labelled
span then gets its state's inverse transform. Of pairs that read the same bytes in another way, the one
whose inverse gives the likelier text counts.

An exact check follows. The inverse must undo the span or a run of it, and its text must be likelier in the
clean state than the garbled one by ``MARGIN``, whatever the length of the span; a span that lost bytes, so
that no run of it can be undone, must beat the clean state by ``LOST_MARGIN``. A restored text is labelled
again: what is still garbled in it is restored too, and it counts as lossless only if every span was undone
whole, garbling it again gives the stored span, no other pair explains the span as well, and the last
labelling finds nothing.

Lost characters (replacement characters, runs of question marks) have a state of their own without an
inverse: such texts are found, not restored. A short sequence alone inside intact quotation marks is
quoted, not damaged.

Texts are labelled whole, independently of each other, in one pass without a shuffle. Symbols, emissions and
paths of an Arrow batch are computed together in arrays. The model, counts per state of the pairs of symbols
that follow each other, is the only thing collected and sent to the executors: it is counted where the texts
are and summed per pair, so its size follows the characters in use, not the texts. A second pass takes off what
the texts that the first model finds damaged had added. As damage that stays unnoticed would vouch for itself, the clean
state counts a pair of symbols only as far as more than a share of ``RARE`` of the texts have it.

Defined cases: null and empty texts are sound; texts of any length are labelled whole; repeated texts
are labelled alike; an empty table gives an empty result and fits nothing; other columns are ignored.
"""

from __future__ import annotations

import codecs
import html
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.session import spread

#: Log probabilities of entering a garbled state from elsewhere, leaving it and staying.
ENTER, LEAVE, STAY = -9.0, -4.0, -0.05
#: Log likelihood that a restored span must gain, one that cannot be undone, and two readings of one span must differ by.
MARGIN, LOST_MARGIN, APART = 9.0, 18.0, 3.0
#: Share of the texts up to which a pair of symbols is no evidence of soundness.
RARE = 1 / 2000
#: Symbols whose paths are searched together.
TOGETHER = 400_000

#: Single-byte encodings that were used by mistake.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251")
#: Fixed values: (true encoding, encoding used, how often).
PAIRS = (
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1),
    ("utf-8", "cp1251", 1), ("utf-8", "gb18030", 1), ("utf-8", "cp932", 1), ("gb18030", "cp1252", 1), ("gb18030", "latin-1", 1), ("cp932", "cp1252", 1),
    ("euc_jp", "cp1252", 1), ("euc_jp", "latin-1", 1), ("gb18030", "cp932", 1), ("cp932", "gb18030", 1), ("cp1252", "mac_roman", 1), ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("cp1252", "cp1251", 1),
)
EASTERN = ("gb18030", "cp932", "euc_jp")
LOST = len(PAIRS) + 1
#: In counts, beside the states: how many texts have a pair of symbols, and at key 0 how many texts there are.
TEXTS = LOST + 1
STATES = ("clean", *(f"{t} read as {w}" + " twice" * (n > 1) for t, w, n in PAIRS), "lost")


def _table(codec: str) -> str:
    """Byte to character, bytes without a character to the control of the same number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


TABLES = {c: _table(c) for c in SINGLE}
_ALPHABETS = {c: frozenset(t[128:]) for c, t in TABLES.items()}
BYTES = {c: codecs.charmap_build(t) for c, t in TABLES.items()}


def garble(text: str, true: str, used: str, times: int = 1) -> str:
    """``text`` written in ``true`` and read as ``used``."""
    for _ in range(times):
        raw = text.encode(true, "ignore")
        text = codecs.charmap_decode(raw, "strict", TABLES[used])[0] if used in TABLES else raw.decode(used, "replace")
    return text


def ungarble(text: str, true: str, used: str, times: int = 1) -> str | None:
    """The inverse of :func:`garble`; None where the text cannot have come from it."""
    for _ in range(times):
        try:
            raw = codecs.charmap_encode(text, "strict", BYTES[used])[0] if used in BYTES else text.encode(used)
            text = raw.decode(true)
        except UnicodeError:
            return None
    return text


_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]{1,7});")
_QUOTED = re.compile(r"[“\"„«'‘]([^\x00-\x7f]{1,8})[”\"“»'’]")
_RUNS = re.compile(r"[^\x00-\x7f]+|[\x00-\x7f]+")
_SURROGATE = re.compile("[\ud800-\udfff]")
_EAST = re.compile("[\u3040-\u30ff\u3400-\u9fff]")

#: Symbols beyond the code points: classes of ASCII characters and, as contexts, of scripts.
_BASE = 0x110000
_CLASSES = np.full(128, _BASE + 4, np.int64)
_CLASSES[[ord(c) for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"]] = _BASE + 3
_CLASSES[48:58], _CLASSES[65:91], _CLASSES[97:123] = _BASE, _BASE + 1, _BASE + 2
_SPACE = _BASE + 3
_SCRIPTS = ((0x3040, 0x30A0), (0x30A0, 0x3100), (0x3400, 0xA000), (0xFF61, 0xFFA0), (0xE000, 0xF900))
_MARK, _LOST_CHAR = ord("?"), 0xFFFD


def contexts(symbols: np.ndarray) -> np.ndarray:
    """What a symbol is to the next one: its script where that has many characters, else itself."""
    out = symbols.copy()
    for i, (a, b) in enumerate(_SCRIPTS):
        out[(symbols >= a) & (symbols < b)] = _BASE + 16 + i
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts one after the other, with their start and end in their text, and each text's first symbol.

    Characters beyond ASCII and question marks in runs of four or more are symbols; other ASCII stretches give the
    class of their first character and, if longer, that of their last.
    """
    n = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(n)])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(cp):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(len(texts) + 1, np.int64)
    first = np.zeros(len(cp) + 1, bool)
    first[begin] = True  # the end counts as a begin
    starts = first[:-1]
    mark = cp == _MARK
    turn = starts | np.concatenate([[True], mark[1:] != mark[:-1]])
    at = np.flatnonzero(turn)
    size = np.diff(np.concatenate([at, [len(cp)]]))
    lone = (cp > 127) | np.repeat(mark[at] & (size >= 4), size)
    own = lone | starts | np.concatenate([[True], lone[:-1]])  # begins a symbol stretch
    lo = np.flatnonzero(own)
    hi = np.concatenate([lo[1:], [len(cp)]])
    long = ~lone[lo] & (hi - lo > 1)
    parts = 1 + long
    where = np.cumsum(parts) - parts
    sym, a, b = (np.empty(int(parts.sum()), np.int64) for _ in range(3))
    ascii_class = lambda c: np.where(c < 128, _CLASSES[np.minimum(c, 127)], c)
    sym[where] = np.where(lone[lo], cp[lo], ascii_class(cp[lo]))
    a[where], b[where] = lo, np.where(long, lo + 1, hi)
    second = where[long] + 1
    sym[second], a[second], b[second] = ascii_class(cp[hi[long] - 1]), lo[long] + 1, hi[long]
    text_at = np.searchsorted(a, begin, "left")
    shift = np.repeat(begin[:-1], np.diff(text_at))
    return sym, a - shift, b - shift, text_at


def _previous(sym: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """The symbol before each, a space before a text's first."""
    previous = np.concatenate([[_SPACE], sym[:-1]]) if len(sym) else sym
    previous[text_at[:-1][text_at[:-1] < len(sym)]] = _SPACE
    return previous


def _before(sym: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    return contexts(_previous(sym, text_at))


def _suspicious(text: str) -> bool:
    """Whether some run of the text can be undone, or characters are lost or controls; such texts teach the clean state nothing."""
    if "\ufffd" in text or "????" in text:
        return True
    return not text.isascii() and any(map(_suspicious_run, set(re.findall(r"[^\x00-\x7f]+", text))))


@lru_cache(1 << 14)
def _suspicious_run(run: str) -> bool:
    if any("\x80" <= c <= "\x9f" for c in run) or sum("\uff61" <= c <= "\uff9f" for c in run) > 1:
        return True
    for t, w, n in PAIRS:
        if t == "utf-8" and n == 1 and len(run) > 1 and (back := ungarble(run, t, w)) is not None and len(back) < len(run):
            return True
    if len(run) > 3 and not _EAST.search(run):
        for w in ("cp1252", "latin-1"):
            raw = run.encode(w, "ignore")
            if any(2 * len(_EAST.findall(raw.decode(t, "ignore"))) >= len(run) / 2 for t in EASTERN):
                return True
    return False


#: Stretches of ASCII of which nothing but the ends can count; the wide one leaves room for lead bytes that take ASCII after them.
_MIDDLE = re.compile(r"(\?*[\x00-\x3e\x40-\x7f])[\x00-\x7f]+([\x00-\x3e\x40-\x7f]\?*)")
_WIDE_MIDDLE = re.compile(r"([\x00-\x7f]{4})[\x00-\x7f]{2,}([\x00-\x7f]{4})")


def condensed(text: str, wide: bool = False) -> str:
    """A text without ``????`` that gives in every state the symbols that ``text`` gives, without the middle of ASCII stretches.

    A stretch counts by its first and last character, and by up to three question marks at its ends, which may grow to four where
    a character is lost. ``wide`` is for readings in two or four bytes: a lead byte at the end of the run before takes at most three more.
    """
    return _WIDE_MIDDLE.sub(r"\1a\2", text) if wide else _MIDDLE.sub(r"\1\2", text)


#: What occurs how often: sorted keys of state, context and symbol, and their counts.
Counts = tuple[np.ndarray, np.ndarray]


def _key(state: int, before: np.ndarray, sym: np.ndarray) -> np.ndarray:
    return (state << 42) | (before << 21) | sym


def summed(parts: Iterable[Counts]) -> Counts:
    """Counts added up; keys that add up to nothing are left out."""
    parts = list(parts) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, which.ravel(), np.concatenate([c for _, c in parts]))
    return keys[n != 0], n[n != 0]


def tally(sound: list[str]) -> Counts:
    """What each state sees of texts that are not suspicious: the clean one the texts, the others what their pair makes of them."""
    short = [condensed(t) for t in sound]
    foreign = [i for i, t in enumerate(sound) if not t.isascii()]
    east = [i for i in foreign if _EAST.search(short[i])]
    wide = [condensed(sound[i], True) for i in east]
    eastern, western = [short[i] for i in east], [short[i] for i in sorted({*foreign} - {*east})]
    unwritten = [i for i in foreign if _SURROGATE.search(short[i])]
    sym, _, _, at = symbols(short)
    previous = _previous(sym, at)
    key = _key(0, contexts(previous), sym)
    text = np.repeat(np.arange(len(short)), np.diff(at))
    pair, own = pd.factorize(key)
    once = pd.unique(text * len(own) + pair) % max(len(own), 1)
    seen = [_counted(key), (own | TEXTS << 42, np.bincount(once, minlength=len(own))), (np.array([TEXTS << 42]), np.array([len(sound)]))]
    of = np.zeros(len(short), bool)
    of[foreign] = True
    of[unwritten] = False
    of = np.repeat(of, np.diff(at))
    follow = _counted(_key(0, previous[of], sym[of]))
    states = {}
    for k, (t, w, n) in enumerate(PAIRS, 1):
        if t == "utf-8" and w in TABLES:  # changes every character by itself, whatever the text
            seen.append(_spelled(k, follow))
            fits = [short[i] for i in unwritten]
        else:  # the pair's encoding can write the text
            fits = wide if w not in TABLES else eastern if t in EASTERN else western
        bad = [(x, garble(x, t, w, n)) for x in fits]
        states[k] = [g for x, g in bad if g != x]
    states[LOST] = [short[i].encode("ascii", "replace").decode() if len(sound[i]) % 2 else short[i].encode("cp1252", "ignore").decode("utf-8", "replace") for i in foreign]
    for k, rows in states.items():
        sym, _, _, at = symbols(rows)
        seen.append(_counted(_key(k, _before(sym, at), sym)))
    return summed(seen)


def _counted(keys: np.ndarray) -> Counts:
    which, own = pd.factorize(keys)
    return own, np.bincount(which, minlength=len(own))


def _spelled(k: int, follow: Counts) -> Counts:
    """What state ``k``, whose pair makes characters of each one alone, sees of symbols that follow each other so often."""
    keys, n = follow
    low = (1 << 21) - 1
    own, which = np.unique(np.concatenate([keys >> 21, keys & low]), return_inverse=True)
    p, c = which.ravel()[: len(keys)], which.ravel()[len(keys) :]
    made = [np.array([x] if x >= _BASE else [ord(g) for g in garble(chr(x), *PAIRS[k - 1])], np.int64) for x in own.tolist()]
    first, last = (np.array([m[i] for m in made], np.int64) for i in (0, -1))
    often = np.zeros(len(own), np.int64)
    np.add.at(often, c, n)
    inner = [(_key(k, contexts(m[:-1]), m[1:]), np.full(len(m) - 1, o)) for m, o in zip(made, often) if len(m) > 1]
    return summed([(_key(k, contexts(last[p]), first[c]), n), *inner])


class Model:
    """Counts of symbols and of (context, symbol) per state, and what follows from them."""

    def __init__(self, texts: list[str], rounds: int = 2) -> None:
        """Fitted on texts that raise no suspicion, then again without those the model itself finds damaged."""
        sound = [t for t in texts if t and not _suspicious(t)]
        counts = tally(sound)
        self._fit(counts)
        for _ in range(rounds - 1):
            found = [got[0] for got in self.read(sound)]
            keys, n = tally([t for t, f in zip(sound, found) if f])
            counts = summed([counts, (keys, -n)])
            sound = [t for t, f in zip(sound, found) if not f]
            self._fit(counts)

    @classmethod
    def of(cls, counts: Counts) -> Model:
        """The model that follows from counts."""
        model = cls.__new__(cls)
        model._fit(counts)
        return model

    def _fit(self, counts: Counts) -> None:
        keys, n = counts
        state, low, whole = keys >> 42, (1 << 21) - 1, (1 << 42) - 1
        clean, texts = state == 0, (state == TEXTS) & (keys & whole > 0)
        most = n[keys == TEXTS << 42].sum() * RARE
        n = n.astype(float)
        n[clean] *= np.maximum(1.0 - most / n[texts], 0.0)  # both sorted by pair
        keys, n = keys[state < TEXTS], n[state < TEXTS]
        state = state[state < TEXTS]

        def table(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own, which = np.unique(part, return_inverse=True)
            out = np.zeros((len(own), len(STATES)))
            np.add.at(out, (which.ravel(), state), n)
            return own, out

        self.one_key, self.one = table(keys & low)
        self.pair_key, self.pair = table(keys & whole)
        self.before_key, self.before = table((keys >> 21) & low)
        self.total = self.one.sum(0)

    @staticmethod
    def _rows(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
        out = np.zeros((len(asked), len(STATES)))
        if len(keys):
            i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[i] == asked
            out[hit] = counts[i[hit]]
        return out

    def emissions(self, sym: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities per state of every distinct (context, symbol), and which of them each symbol is."""
        pairs, which = np.unique((before << 21) | sym, return_inverse=True)
        s = pairs & ((1 << 21) - 1)
        base = (self._rows(self.one_key, self.one, s) + 0.02) / (self.total + 400.0)
        got = np.log((self._rows(self.pair_key, self.pair, pairs) + 2.0 * base) / (self._rows(self.before_key, self.before, pairs >> 21) + 2.0))
        gone, mark = s == _LOST_CHAR, s == _MARK
        got[:, LOST] = np.where(gone | mark, np.log(0.45), got[:, 0] - 1.5)
        got[gone, 0], got[mark, 0] = -16.0, -4.0
        return got, which.ravel()

    def clean(self, texts: list[str], before: list[str]) -> np.ndarray:
        """Log likelihood of each text in the clean state after the character before it."""
        joined = [b + t for b, t in zip(before, texts)]
        sym, lo, _, at = symbols(joined)
        e, which = self.emissions(sym, _before(sym, at))
        own = np.where(lo >= np.repeat([len(b) for b in before], np.diff(at)), e[which, 0] if len(which) else 0.0, 0.0)
        total = np.concatenate([[0.0], np.cumsum(own)])
        return total[at[1:]] - total[at[:-1]]

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """Per text the states of its symbols (Viterbi), their places and what each gains on the clean state; None where all is clean."""
        out: list = [None] * len(texts)
        sym, lo, hi, at = symbols(texts)
        if not len(sym):
            return out
        e, which = self.emissions(sym, _before(sym, at))
        gain = (e[:, 1:].max(1) - e[:, 0])[which]
        todo = []
        for i in range(len(texts)):  # a stretch must gain what entering another state costs, else the clean path is the best
            g = np.concatenate([[0.0], np.cumsum(gain[at[i] : at[i + 1]])])
            if (g - np.minimum.accumulate(g)).max() >= -ENTER:
                todo.append(i)
        todo.sort(key=lambda i: at[i] - at[i + 1])
        while todo:
            n, room = 1, TOGETHER // max(int(at[todo[0] + 1] - at[todo[0]]), 1)
            n = max(1, min(len(todo), room))
            now, todo = todo[:n], todo[n:]
            for i, path in zip(now, self._paths(e, which, at, now)):
                if path.any():
                    part = slice(at[i], at[i + 1])
                    w = which[part]
                    out[i] = (path, lo[part], hi[part], e[w, path] - e[w, 0])
        return out

    def _paths(self, e: np.ndarray, which: np.ndarray, at: np.ndarray, texts: list[int]) -> list[np.ndarray]:
        """The most probable states of the symbols of texts in falling order of length, all searched in step."""
        k = len(STATES)
        size = np.array([at[i + 1] - at[i] for i in texts])
        begin = np.array([at[i] for i in texts])
        back = np.zeros((int(size[0]), len(texts), k), np.int8)
        v = np.full((len(texts), k), ENTER)
        v[:, 0] = 0.0
        own = np.arange(k, dtype=np.int8)
        active = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # texts longer than t
        for t in range(int(size[0])):
            m = int(active[t])
            u = v[:m]
            top = u.argmax(1)
            move = np.repeat(u.max(1)[:, None] + ENTER, k, 1)
            src = np.repeat(top[:, None], k, 1).astype(np.int8)
            move[:, 0] = u[:, 1:].max(1) + LEAVE
            src[:, 0] = 1 + u[:, 1:].argmax(1)
            stay = u + STAY
            better = move > stay
            back[t, :m] = np.where(better, src, own)
            v[:m] = np.where(better, move, stay) + e[which[begin[:m] + t]]
        paths = []
        for j, n in enumerate(size):
            path = np.empty(n, np.int8)
            s = int(v[j].argmax())
            for t in range(int(n) - 1, -1, -1):
                path[t] = s
                s = int(back[t, j, s])
            paths.append(path)
        return paths

    def read(self, texts: list[str]) -> list[tuple[bool, str, str, bool]]:
        """Per text (damaged, states found, text restored as far as possible, whether all of it was)."""
        out = [(False, "", t, True) for t in texts]
        plain, ask = {}, []
        for i, t in enumerate(texts):
            p = _ENTITY.sub(_unescaped, t) if "&" in t else t
            if not p.isascii() or "????" in p:
                plain[i] = p
                ask.append(i)
        found = self._restored([plain[i] for i in ask])
        hit = [j for j, f in enumerate(found) if f]
        again = self._restored([found[j][1] for j in hit])  # what is left in a restored text
        third = self._restored([a[1] if a else "" for a in again])
        for j, a, last in zip(hit, again, third):
            states, text, whole = found[j]
            if a:
                states, text, whole = states | a[0], a[1], whole and a[2] and not last
            out[ask[j]] = (True, ", ".join(sorted(states)), text, whole)
        return out

    def _restored(self, texts: list[str]) -> list[tuple[set[str], str, bool] | None]:
        """Per text (states, restored, whole), None where nothing is damaged."""
        spans, keep = [], []
        for i, (text, got) in enumerate(zip(texts, self.label(texts))):
            keep.append([])
            if got is None:
                continue
            path, lo, hi, gain = got
            quoted = [m.span(1) for m in _QUOTED.finditer(text)]
            cut = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            for a, b in zip(cut, [*cut[1:], len(path)]):
                k = int(path[a])
                if k:
                    x, y = int(lo[a]), int(hi[b - 1])
                    runs = [m for m in _RUNS.finditer(text, x, y) if not any(q0 <= m.start() and m.end() <= q1 for q0, q1 in quoted)]
                    if any((not m.group().isascii()) or (k == LOST and "????" in m.group()) for m in runs):
                        if k != LOST:  # ASCII at the ends belongs to any state
                            inner = [m for m in _RUNS.finditer(text, x, y) if not m.group().isascii()]
                            x, y = inner[0].start(), inner[-1].end()
                        spans.append((i, x, y, k, float(gain[a:b].sum())))
        options = []  # (span, what the text has there, what it would have, whole, state, the part undone, begin)
        for n, (i, x, y, k, gain) in enumerate(spans):
            piece = texts[i][x:y]
            if k != LOST:
                same = [j for j in range(1, LOST) if PAIRS[j - 1][1:] == PAIRS[k - 1][1:]]
                # The span may begin or end within a run that belongs together, and an ASCII letter may be a character's second byte.
                used = PAIRS[k - 1][1]
                x0, y0 = x, y
                while x0 and _fits(texts[i][x0 - 1], used):
                    x0 -= 1
                while y0 < len(texts[i]) and _fits(texts[i][y0], used):
                    y0 += 1
                tail = 1 if PAIRS[k - 1][0] in EASTERN and used in TABLES and y0 < len(texts[i]) else 0
                full = texts[i][x0 : y0 + tail]
                for j in same:
                    for u in {x, x0}:
                        for v in {y, y0, y0 + tail}:
                            back, whole = _undo(texts[i][u:v], j)
                            if back is not None and (j == k or whole):
                                options.append((n, full, texts[i][x0:u] + back + texts[i][v : y0 + tail], whole and u == x0 and v >= y0, j, (u, v, back), x0))
        before = [texts[spans[o[0]][0]][max(o[6] - 1, 0) : o[6]] for o in options]
        was, now = self.clean([o[1] for o in options], before), self.clean([o[2] for o in options], before)
        best: dict[int, list] = {}
        for o, w, c in zip(options, was, now):
            best.setdefault(o[0], []).append((float(c), float(c - w), o))
        for n, (i, x, y, k, gain) in enumerate(spans):
            piece = texts[i][x:y]
            if k == LOST:
                if "\ufffd" in piece or "????" in piece:
                    keep[i].append((x, y, piece, STATES[k], False))
                continue
            ranked = sorted(best.get(n, ()), key=lambda r: (-round(r[0], 6), not r[2][3], r[2][4] != k))
            if not ranked:
                if gain >= LOST_MARGIN and PAIRS[k - 1][:2] != ("utf-8", "cp1252"):
                    keep[i].append((x, y, piece, STATES[k], False))
                continue
            likely, better, (_, _, all_of_it, whole, j, (x, end, back), _) = ranked[0]
            if better >= MARGIN:
                alone = all(likely - r[0] >= APART or r[2][2] == all_of_it for r in ranked[1:])
                keep[i].append((x, end, back, STATES[j], whole and alone and "\ufffd" not in back and garble(back, *PAIRS[j - 1]) == texts[i][x:end]))
        out: list = []
        for text, found in zip(texts, keep):
            found = [f for n, f in enumerate(found) if not n or f[0] >= found[n - 1][1]]  # a widened span may hold the next one
            if not found:
                out.append(None)
                continue
            parts, at = [], 0
            for x, y, fixed, _, _ in found:
                parts += [text[at:x], fixed]
                at = y
            out.append(({f[3] for f in found}, "".join(parts) + text[at:], all(f[4] for f in found)))
        return out


def _fits(ch: str, used: str) -> bool:
    """Whether a character beyond ASCII is one that reading bytes as ``used`` gives."""
    return not ch.isascii() and (ch in _ALPHABETS[used] if used in TABLES else True)


def _unescaped(m: re.Match) -> str:
    ch = html.unescape(m.group())
    return ch if ord(ch[0]) > 127 else m.group()


def _undo(piece: str, k: int) -> tuple[str | None, bool]:
    """What the inverse of state ``k`` makes of a span, and whether it undid all of it; None where no run of it can be undone."""
    true, used, times = PAIRS[k - 1]
    back = ungarble(piece, true, used, times)
    if back is not None and back != piece:
        return back, True
    parts, any_ok, whole = [], False, True
    for m in _RUNS.finditer(piece):  # characters lost or beside the span: run by run
        run = m.group()
        got = None if run.isascii() else ungarble(run, true, used, times)
        if got is None and used not in TABLES and not run.isascii():  # what is left of a run that lost bytes
            got = run.replace("\ufffd", "?").encode(used, "replace").decode(true, "replace")
            whole = False
        any_ok = any_ok or (got is not None and got != run)
        whole = whole and (got is not None or run.isascii())
        parts.append(run if got is None else got)
    return ("".join(parts), whole) if any_ok else (None, False)


def fit(documents: DataFrame, text: str = "text") -> Model:
    """The model, fitted on all texts as :class:`Model` does it, in two passes that count where the texts are."""
    texts = spread(documents.select(F.col(text).alias("t")).where("t != ''"))
    first = _total(texts, tally)
    shared = documents.sparkSession.sparkContext.broadcast(Model.of(first))

    def damaged(sound: list[str]) -> Counts:
        return tally([t for t, got in zip(sound, shared.value.read(sound)) if got[0]])

    keys, n = _total(texts, damaged)
    shared.destroy()
    return Model.of(summed([first, (keys, -n)]))


def _total(texts: DataFrame, count: Callable[[list[str]], Counts]) -> Counts:
    """The sum of what ``count`` gives for the texts of each Arrow batch that raise no suspicion."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = summed([])
        for f in frames:
            own = summed([own, count([t for t in f["t"] if not _suspicious(t)])])
        yield pd.DataFrame({"k": own[0], "n": own[1]})

    rows = texts.mapInPandas(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    return summed([(rows["k"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))])


def find_damage(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, damaged, states, restored, lossless)`` for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, text))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for f in frames:
            got = model.read([t or "" for t in f["t"]])
            yield pd.DataFrame({"k": f["k"], "damaged": [g[0] for g in got], "states": [g[1] for g in got], "restored": [g[2] if g[0] else t for g, t in zip(got, f["t"])], "lossless": [g[3] for g in got]})

    kind = documents.schema[key].dataType.simpleString()
    rows = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return rows.mapInPandas(run, f"k {kind}, damaged boolean, states string, restored string, lossless boolean").withColumnRenamed("k", key)
