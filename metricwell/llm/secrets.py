"""Secret scans with a linear-chain conditional random field.

A text is cut into tokens: runs of letters and digits, and every other visible character by itself. The field tags each
token as secret begin (B), inside (I) or outside (O) from its shape, the words around it and features of the file, and
Viterbi's algorithm finds the best tags of the whole chain. A secret runs from a B (or an I after O) over the I that
follow. No token is left out by its size or looks: where O leads by more than all that the moves to and from a token
could ever make good (Field.slack), the best path has O there, and the chain may be cut at such tokens without any
change of the result.

The field is trained on the driver, on windows of tokens from a bounded sample of texts outside the evaluation fold.
Its labels are the values that the base patterns find. Every such window is shown as it is, without the word that
gave the secret away, and then with the value spelled in other ways too (an alphabet, a length, a grouping drawn at
random), as an assignment and as in a sentence, so that the field learns what secrets look like elsewhere. What it tags
is made whole (complete). Base matches always stay; the field adds spans of kind "crf" that overlap none of them.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, held_out, small_batches, table
from .words import mix, power_sums

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Texts to train on: with a base match, without one (about; a hash chooses them); windows of a text; tokens of one.
SAMPLE, WINDOWS, WINDOW = 400, 3, 32
#: Other spellings in which a sampled value is shown.
SPELLINGS = 4
#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "crf")
_B, _I, _O = 0, 1, 2
_CUES = "password passwd pwd secret token api apikey key credential credentials private auth bearer".split()
_CUE = re.compile(r"(password|passwd|pwd|secret|token|api_?key|credential|private|auth|bearer)", re.IGNORECASE | re.ASCII)
_KIND = np.full(129, 4, dtype=np.int8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 sign, 5 beyond ASCII
_KIND[[*b" \t\n\x0b\f\r\0\x1c\x1d\x1e\x1f"]] = 0
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1], _KIND[128] = 1, 2, 3, 5
#: Values of each feature; their sums give every feature its place in one table of weights.
_WORDS = 4096
_SIZES = {
    "kinds,size": 32 * 16,
    "digits,changes": 8 * 8,
    "distinct,size": 8 * 8,
    "hex,size": 3 * 8,
    "sign,glue": 128 * 4,
    "before": _WORDS,
    "before2": _WORDS,
    "after": _WORDS,
    "run": 16 * 2 * 2,
    "cue": 2 * 32,
    "file": 5 * 2,
    "pair": 32 * 32 * 2,
}
_AT = np.concatenate(([0], np.cumsum([*_SIZES.values()])))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost non-overlapping matches of each kind, too short ones dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


class Tokens:
    """All tokens of some texts: begin and end in code points of their own text, text, and first token of each text."""

    def __init__(self, texts: list[str]):
        start = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)))
        self.points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.kind = _KIND[np.minimum(self.points, 128)]
        sign, word = self.kind == 4, (self.kind != 0) & (self.kind != 4)
        self.left = np.flatnonzero(sign | word & ~np.concatenate(([False], word[:-1])))
        self.right = np.flatnonzero(sign | word & ~np.concatenate((word[1:], [False]))) + 1
        self.text = np.searchsorted(start, self.left, side="right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.begin, self.end = self.left - start[self.text], self.right - start[self.text]
        self.size = np.diff(start) - 1

    def hashes(self) -> np.ndarray:
        """Hashes of the lower-cased tokens."""
        low = self.points + np.where(self.kind == 2, 32, 0).astype(np.uint32)
        return power_sums(mix(low.astype(np.uint64)), self.left, self.right)


_CUE_HASHES = Tokens([" ".join(_CUES)]).hashes()


def features(t: Tokens) -> np.ndarray:
    """(tokens x features) places in the table of weights: shape, neighbouring words, run without spaces, and file."""
    n = len(t.left)
    if n == 0:
        return np.zeros((0, len(_SIZES)), np.int32)
    size = t.right - t.left

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int32)))
        return total[t.right] - total[t.left]

    lower, upper, digit = (count(t.kind == k) for k in (1, 2, 3))
    beyond, sign = count(t.kind == 5) > 0, t.kind[t.left] == 4
    kinds = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * beyond + 16 * sign
    is_digit = t.kind == 3
    changes = count(np.concatenate(([False], is_digit[1:] != is_digit[:-1]))) - np.where(t.left > 0, is_digit[t.left] != is_digit[t.left - 1], False)
    bits = np.uint64(1) << (t.points & np.uint32(63)).astype(np.uint64)
    distinct = np.bitwise_count(np.bitwise_or.reduceat(bits, np.stack((t.left, t.right), axis=1).ravel())[::2]).astype(np.int64)
    hexed = np.minimum(t.points, 127)
    small, large = count(_HEX[0][hexed] & (t.points < 128)) == size, count(_HEX[1][hexed] & (t.points < 128)) == size
    step = np.minimum(np.frexp(size.astype(np.float64))[1], 7)
    same = t.text[1:] == t.text[:-1]
    glue = np.concatenate(([False], (t.left[1:] == t.right[:-1]) & same))  # no space before
    glued = np.concatenate((glue[1:], [False]))
    word = t.hashes()
    named = np.where(digit > 0, 1, 2 + word % np.uint64(_WORDS - 2)).astype(np.int64)  # 0: the text's end, 1: has digits

    def beside(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        if by > 0:
            out[by:] = np.where(t.text[by:] == t.text[:-by], values[:-by], 0)
        else:
            out[:by] = np.where(t.text[:by] == t.text[-by:], values[-by:], 0)
        return out

    run = np.cumsum(~glue) - 1
    of = np.flatnonzero(~glue)
    whole = np.add.reduceat(size, of)[run]
    mixed = (np.add.reduceat(digit, of)[run] > 0) * 2 + (np.add.reduceat(upper, of)[run] > 0)
    cue = np.isin(word, _CUE_HASHES) & ~sign
    near = np.zeros(n, dtype=bool)
    for by in range(1, 7):
        near |= beside(cue, by).astype(bool)
    told = np.bincount(t.text[cue], minlength=len(t.size)) > 0
    out = np.stack(
        (
            kinds * 16 + np.minimum(size // 2, 15), np.ceil(7 * digit / size).astype(np.int64) * 8 + np.minimum(changes, 7), np.minimum(7 * distinct // size, 7) * 8 + step,
            np.where(small, 1, np.where(large, 2, 0)) * 8 + step, np.where(sign, np.minimum(t.points[t.left], 127), 0) * 4 + glue * 2 + glued,
            beside(named, 1), beside(named, 2), beside(named, -1), np.minimum(whole // 4, 15) * 4 + mixed, near * 32 + kinds,
            (np.minimum(t.size // 1000, 4) * 2 + told)[t.text], (beside(kinds, 1) * 32 + kinds) * 2 + glue,
        ),
        axis=1,
    )
    return (out + _AT[:-1]).astype(np.int32)


_HEX = np.zeros((2, 128), dtype=bool)
_HEX[0, [*b"0123456789abcdef"]] = True
_HEX[1, [*b"0123456789ABCDEF"]] = True


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Weights of a linear-chain conditional random field over B, I and O, with its training and decoding."""

    def __init__(self) -> None:
        self.own = np.zeros((_AT[-1], 3), dtype=np.float32)
        self.step = np.zeros((3, 3))  # from, to; a chain begins and ends as if O stood there
        self.own[_AT[10] : _AT[11], _O] = 1.0  # every token has one feature of the file: unfitted, all are outside

    def emissions(self, where: np.ndarray) -> np.ndarray:
        out = np.zeros((len(where), 3), dtype=np.float32)
        for k in range(where.shape[1]):
            out += self.own[where[:, k]]
        return out

    def slack(self) -> float:
        """What the moves to and from a token can gain at most if its tag is not O but another one."""
        m = self.step
        return float(max(m[p, y] + m[y, q] - m[p, _O] - m[_O, q] for p in range(3) for q in range(3) for y in (_B, _I)))

    def gradient(self, e: np.ndarray, tags: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected minus seen tags and moves of chains (chains x tokens), padded behind their lengths, and the loss."""
        n, width, _ = e.shape
        m = self.step
        f, b = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        live = np.arange(width) < length[:, None]
        f[:, 0] = e[:, 0] + m[_O]
        for t in range(1, width):
            f[:, t] = np.where(live[:, t, None], e[:, t] + _sum(f[:, t - 1, :, None] + m, 1), f[:, t - 1])
        b[:, -1] = m[:, _O]
        for t in range(width - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], _sum(m + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), m[:, _O])
        whole = _sum(f[:, -1] + m[:, _O], 1)
        p = np.exp(f + b - whole[:, None, None]) * live[:, :, None]
        i, t = np.nonzero(live)
        seen = e[i, t, tags[i, t]].sum()
        p[i, t, tags[i, t]] -= 1
        move = np.zeros((3, 3))
        last = np.arange(n), length - 1
        for k in (0, 1):  # moves from the edge, and to it
            flat = np.exp(f + b - whole[:, None, None])[:, 0] if k == 0 else np.exp(f[last] + b[last] - whole[:, None])
            tag = tags[:, 0] if k == 0 else tags[last]
            for y in range(3):
                a = (_O, y) if k == 0 else (y, _O)
                move[a] += flat[:, y].sum() - (tag == y).sum()
                seen += m[a] * (tag == y).sum()
        both = live[:, 1:]
        joint = np.exp(f[:, :-1, :, None] + m + (e[:, 1:] + b[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        move += (joint * both[:, :, None, None]).sum(axis=(0, 1))
        i, t = np.nonzero(both)
        np.subtract.at(move, (tags[i, t], tags[i, t + 1]), 1)
        seen += m[tags[i, t], tags[i, t + 1]].sum()
        return p, move, float(whole.sum() - seen)

    def fit(self, where: np.ndarray, tags: np.ndarray, length: np.ndarray, rounds: int = 60, rate: float = 0.1, decay: float = 0.02) -> Field:
        """Adam on the whole loss. where: (chains x tokens x features); an empty sample leaves the field as it is."""
        if len(where) == 0:
            return self
        n, width, k = where.shape
        flat = where.reshape(-1, k)
        own, m1, v1 = self.own.astype(np.float64), np.zeros(self.own.shape), np.zeros(self.own.shape)
        m2, v2 = np.zeros((3, 3)), np.zeros((3, 3))
        for t in range(1, rounds + 1):
            p, move, _ = self.gradient(self.emissions(flat).reshape(n, width, 3), tags, length)
            p = p.reshape(-1, 3)
            g = np.stack(
                [sum(np.bincount(flat[:, j], weights=p[:, y], minlength=len(own)) for j in range(k)) for y in range(3)],
                axis=1,
            ) + decay * own
            move = move + decay * self.step
            for x, grad, a, b in ((own, g, m1, v1), (self.step, move, m2, v2)):
                a *= 0.9
                a += 0.1 * grad
                b *= 0.99
                b += 0.01 * grad * grad
                x -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
            self.own = own.astype(np.float32)
        return self

    def decode(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of the chains [first[i], first[i + 1]) by Viterbi's algorithm, all chains side by side."""
        tags = np.full(len(e), _O, dtype=np.int8)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        begin, size = first[order], size[order]
        if not len(order):
            return tags
        best, back = e[begin] + self.step[_O], []
        alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) + 1)]  # chains longer than t
        for t in range(1, int(size[0])):
            k = alive[t]
            at = best[:k, :, None] + self.step
            back.append(at.argmax(axis=1))
            best[:k] = at.max(axis=1) + e[begin[:k] + t]
        tag = (best + self.step[:, _O]).argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            k = alive[t]
            tags[begin[:k] + t] = tag[:k]
            if t:
                tag[:k] = back[t - 1][np.arange(k), tag[:k]]
        return tags

    def tags(self, t: Tokens, where: np.ndarray) -> np.ndarray:
        """The tags of all tokens; only stretches between tokens that are certainly outside are decoded."""
        e = self.emissions(where)
        open_ = e[:, _O] - np.maximum(e[:, _B], e[:, _I]) <= max(self.slack(), 0) + 1e-3
        places = np.flatnonzero(open_)
        tags = np.full(len(e), _O, dtype=np.int8)
        new = np.concatenate(([True], (np.diff(places) > 1) | (np.diff(t.text[places]) > 0)))[: len(places)]
        tags[places] = self.decode(e[places], np.concatenate((np.flatnonzero(new), [len(places)])))
        return tags

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of each secret of each text, made whole by complete()."""
        t = Tokens(texts)
        tags = self.tags(t, features(t))
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        last = -2
        for i in np.flatnonzero(tags != _O).tolist():
            home = out[t.text[i]]
            if tags[i] == _I and last == i - 1 and home:
                home[-1] = (home[-1][0], i + 1)
            else:
                home.append((i, i + 1))
            last = i
        return [complete(t, text, at) if at else [] for text, at in zip(texts, out, strict=True)]


def complete(t: Tokens, text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tagged stretches of tokens of one text as (start, end) in it.

    Each grows over the tokens on both sides that no space parts from it, up to an @ or a word (three letters or more, large
    only the first or all). At its edges signs are cut, and words that such signs as in addresses and assignments part
    from the rest; what is nothing but words goes, and so do the name and the host of a mail address, but not a
    password before its host. Stretches that meet are one.
    """
    home = int(t.text[found[0][0]])
    low, high = int(t.first[home]), int(t.first[home + 1])
    own = lambda i: text[t.begin[i] : t.end[i]]
    sign = lambda i: t.kind[t.left[i]] == 4
    glued = lambda i: t.begin[i] == t.end[i - 1]  # noqa: E731  to the token before
    stops = lambda i: own(i) == "@" or _WORD.fullmatch(own(i))
    out: list[tuple[int, int]] = []
    reach = low  # the end of what the stretches before have grown over: no token is gone over for each stretch in it
    for i, j in found:
        if j <= reach:
            continue
        while i > low and glued(i) and not stops(i - 1):
            i -= 1
        while j < high and glued(j) and not stops(j):
            j += 1
        reach = j
        while i < j and (sign(i) or i + 1 < j and _WORD.fullmatch(own(i)) and (own(i + 1) in _PARTS or sign(i + 1) and i + 2 < j and sign(i + 2))):
            i += 1
        while i < j and (sign(j - 1) or j - i > 1 and _WORD.fullmatch(own(j - 1)) and own(j - 2) in (*_PARTS, ".")):
            j -= 1
        before, after = own(i - 1) if i > low and i < high and glued(i) else "", own(j) if j < high and glued(j) else ""
        if all(sign(k) or _WORD.fullmatch(own(k)) for k in range(i, j)) or before == "@" or after == "@" and before != ":":
            continue
        if out and i < out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return [(int(t.begin[i]), int(t.end[j - 1])) for i, j in out]


_WORD = re.compile(r"[^\W\d_][^\W\d_A-Z]{2,}|[A-Z]{3,}")
_PARTS = frozenset(":/=@")


def scan(texts: list[str], field: Field) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: the base ones, and those of the field that overlap none of them."""
    out = []
    for text, more in zip(texts, field.spans(texts), strict=True):
        base = base_spans(text)
        covered: list[tuple[int, int]] = []  # the base spans' union, in order
        for a, b, _ in base:
            if covered and a < covered[-1][1]:
                covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
            else:
                covered.append((a, b))
        ends = [b for _, b in covered]
        for a, b in more:
            k = bisect_left(ends, a + 1)
            if k == len(covered) or covered[k][0] >= b:
                base.append((a, b, "crf"))
        out.append(sorted(base, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))
    return out


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the secrets themselves in the base matches, without the words that announce them."""
    found = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(a, b) for a, b, k in base_spans(text) if k != "assign"]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def respelled(value: str, nth: int = 1) -> str:
    """Another secret in a spelling that no base pattern finds, the nth drawn by value.

    No list of known kinds: alphabet, length and build (one run, groups, a prefix, lines, signs in between) are drawn.
    """
    draw = random.Random(f"{nth} {value}".encode("utf-8", "surrogatepass"))
    while True:
        letters = draw.choice(("abcdef", "ABCDEF", _LETTERS, _LETTERS.upper(), _LETTERS + _LETTERS.upper(), _LETTERS + _LETTERS.upper()))
        known = letters + "0123456789" * (len(letters) <= 26 or draw.random() < 0.75)  # letters of one case alone are words
        runs = lambda *sizes: ["".join(draw.choices(known, k=n)) for n in sizes]  # noqa: B023, E731
        build = draw.randrange(8)
        if build < 2:
            out = runs(draw.randint(16, 44))[0]
        elif build < 4:
            size = draw.randint(2, 24)
            out = draw.choice("-._:/+").join(runs(*[size if draw.random() < 0.6 else draw.randint(2, 30) for _ in range(draw.randint(3, max(3, 30 // size)))]))
        elif build == 4:
            out = "".join(draw.choices(_LETTERS, k=draw.randint(2, 5))) + draw.choice("_-.") + runs(draw.randint(14, 40))[0]
        elif build == 5:
            width = draw.randint(40, 76)
            out = "\n".join(runs(*[width] * draw.randint(1, 4), draw.randint(4, width)))
        else:  # few signs between long runs, or many between short ones
            size = draw.choice((2, 2, 3, 12))
            parts = runs(*[draw.randint(1, 2 * size - 1) for _ in range(draw.randint(3, 5))])
            out = "".join(x + draw.choice("!#$%&*+/=?^~") for x in parts[:-1]) + parts[-1]
        if len(out) >= 10 and not base_spans(out):
            return out


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def shown(text: str, found: list[tuple[int, int]], masked: bool, nth: int, bare: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """The text with its cue words masked and its values in the nth other spelling (0: their own), and where they stand.

    bare: without the signs before a value, as in a sentence.
    """
    parts, out, at, size = [], [], 0, 0
    for a, b in [*found, (len(text), len(text))]:
        gap = text[at:a]
        if masked:
            gap = _CUE.sub(lambda m: "x" * len(m[0]), gap)
        if bare and a < b:
            gap = gap.rstrip(" :='\"") + " "
        value = respelled(text[a:b], nth) if nth and a < b else text[a:b]
        parts += [gap, value]
        if a < b:
            out.append((size + len(gap), size + len(gap) + len(value)))
        size, at = size + len(gap) + len(value), b
    return "".join(parts), out


def windows(text: str, width: int = WINDOW, most: int = WINDOWS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training chains of a text: (places of features, tags) of up to width tokens, up to most for each way to show it.

    They lie around the first values or, in a text without any, around tokens with digits, its two longest tokens and
    one other; a hash of the text shifts them.
    """
    found, out = values(text), []
    shift = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
    ways = ((False, 0, False), (True, 0, False), *((True, k + 1, k % 2 > 0) for k in range(SPELLINGS)), (False, SPELLINGS + 1, True))
    for masked, nth, bare in ways if found else ways[:1]:
        new, spans = shown(text, found, masked, nth, bare)
        t = Tokens([new])
        if not len(t.left):
            continue
        tags = np.full(len(t.left), _O, dtype=np.int8)
        for a, b in spans:
            i, j = np.searchsorted(t.end, a, side="right"), np.searchsorted(t.begin, b)
            tags[i:j] = _I
            tags[i : min(i + 1, j)] = _B
        if found:
            centres = np.flatnonzero(tags == _B)[:most].tolist()
        else:
            centres = [int.from_bytes(shift[:4], "little") % len(tags), *np.argsort(t.begin - t.end, kind="stable")[:2].tolist()]
            centres += [i for i in range(len(tags)) if new[t.begin[i]].isdigit()][: most - 1]
        where = features(t)
        for k, c in enumerate(centres):
            a = max(0, c - shift[4 + k] % width)
            out.append((where[a : a + width], tags[a : a + width]))
    return out


def examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all texts as Field.fit takes them."""
    return _padded([w for x in texts for w in windows(x)])


def _padded(chains: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    where = np.zeros((len(chains), WINDOW, len(_SIZES)), dtype=np.int32)
    tags = np.full((len(chains), WINDOW), _O, dtype=np.int64)
    for i, (w, y) in enumerate(chains):
        where[i, : len(w)], tags[i, : len(y)] = w, y
    return where, tags, np.array([len(w) for w, _ in chains], dtype=np.int64)


def learn(docs: DataFrame, size: int = SAMPLE) -> Field:
    """A field fitted to windows of about size texts with a base match and as many without one, outside the held-out fold.

    Only windows reach the driver: at most WINDOWS of WINDOW tokens for each way to show a text.
    """
    small_batches(docs.sparkSession)
    has = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", "text", has.alias("has"))
    sizes = {r["has"]: r["count"] for r in rows.groupBy("has").count().collect()}
    share = F.when(F.col("has"), F.lit(min(1.0, size / sizes.get(True, 1)))).otherwise(F.lit(min(1.0, size / sizes.get(False, 1))))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            chains = [w for x in texts for w in windows(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.tobytes() for w, _ in chains], pa.binary()), pa.array([y.tobytes() for _, y in chains], pa.binary())],
                ["places", "tags"],
            )

    found = rows.where(draw < share).select("text").mapInArrow(run, "places binary, tags binary").limit(3 * size * WINDOWS * (3 + SPELLINGS))
    parts = sorted((bytes(r["places"]), bytes(r["tags"])) for r in found.toLocalIterator())
    return Field().fit(*_padded([(np.frombuffer(w, np.int32).reshape(-1, len(_SIZES)), np.frombuffer(y, np.int8)) for w, y in parts]))


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row.

    Null text counts as empty: no spans, and base_sha256 is that of an empty string. Spans are in code points, the end
    not included, and cover whole matches. Repeated rows get equal results, an empty table gives an empty result (and
    an unfitted field, which finds nothing), and other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = scan(texts, shared.value)
            base = [[s for s in f if s[2] != "crf"] for f in found]
            told = [digest(b) for b in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in told]),
                    pa.array([digest(f) for f in found], pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
