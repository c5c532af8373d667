"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags every token (run without ASCII white space) as outside, begin or inside of a secret from its shape,
the words before it and features of the file, decoded by Viterbi. It is trained here, on token sequences drawn from
a generator with a fixed seed. A part of the field is fixed: tokens are outside if they have under 8 bytes, or have
no digit, no capital after a small letter and under 16 capitals, and hold no cue and follow none within two tokens.
So shapes and neighbours are looked at for the few others only, and emission scores, linear in the features, are made
for all of these in a batch at once.

Decoding skips what can't matter: replacing a token's label by "outside" changes two transitions, so where
"outside" leads the other labels by more than twice the spread of the transition scores, the best path is outside.
Viterbi runs over the stretches between such tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK, chunks, joined, others, quoted, texts_of, word_spans

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CUES = (b"passw", b"passphrase", b"secret", b"token", b"credential", b"private", b"auth", b"bearer", b"access", b"key")
CUE = re.compile(b"|".join(CUES))
#: A cue that ends its word, but for marks: after it stands what is told.
TOLD = re.compile(rb"(?:password|passwd|passphrase|secret|token|credential|bearer|key)s?[^\w\s]*(?=\s)")
LEAST = 8
#: Capitals from which on a token without digits or small letters can be a secret.
CAPITALS = 16
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
OUT, BEGIN, INSIDE = 0, 1, 2


def hex_runs(buf: np.ndarray, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of 0-9a-f of at least so many bytes."""
    flags = np.zeros(len(buf) + 2, np.int8)
    flags[1:-1] = _HEX[buf]
    step = np.flatnonzero(np.diff(flags))
    starts, ends = step[::2], step[1::2]
    ok = ends - starts >= least
    return starts[ok], ends[ok]


def base_spans(text: bytes, low: bytes) -> list[tuple[str, int, int]]:
    """The fixed patterns' matches in a UTF-8 text, given in lower case too, in bytes: leftmost, non-overlapping within a kind. hex_runs finds the others."""
    out = []
    if any(w in low for w in (b"passw", b"secret", b"token", b"api")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out


# --- features ---------------------------------------------------------------------------------------------------

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 mark of encodings, 5 other ASCII mark
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _CLASS[_a:_b] = 5
_CLASS[list(b"+/_-=.")] = 4
_CLASS[128:] = 6
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"AEIOUY")] = True
FEATURES = (
    "bias len12 len16 len20 len32 len64 digits10 digits30 upper20 mixed lower_digits upper_digits digits_only marks_enc marks_odd accents "
    "changes25 changes45 hexish varied steady assign_own quoted link path date capitals vowels constant dashed uuid login cue_before cue_two_before cue_own assign_before file_cues file_code cue_dashed cue_uuid "
    "cue_capitals cue_odd told"
).split()


def shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Flags of the tokens of a buffer from their own bytes, in the order of FEATURES."""
    kind = _CLASS[buf]
    n = (ends - starts).astype(np.float32)

    def per(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return (sums[ends] - sums[starts]).astype(np.float32)

    lower, upper, digit, enc, odd, high = (per(kind == k) for k in (1, 2, 3, 4, 5, 6))
    change = np.zeros(len(buf), bool)
    change[1:] = kind[1:] != kind[:-1]
    changes = per(change)
    hexes = per(_HEX[buf])
    first, last = buf[starts], buf[ends - 1]
    signs = per((buf == 58) | (buf == 61))
    slashes, ats, dashes = per(buf == 47), per(buf == 64), per(buf == 45)
    # How many different bytes there are is costly; how often the byte differs from the one two before is close.
    alt, same = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    alt[2:] = buf[2:] != buf[:-2]
    same[1:] = buf[1:] == buf[:-1]
    return [
        np.ones(len(n), bool), n >= 12, n >= 16, n >= 20, n >= 32, n >= 64, digit > 0.1 * n, digit > 0.3 * n, upper > 0.2 * n,
        (lower > 0) & (upper > 1) & (digit > 0), lower + digit >= n, upper + digit >= n, digit + enc + odd >= n,
        enc > 0.05 * n, odd > 0.2 * n, high > 0, changes > 0.25 * n, changes > 0.45 * n, (hexes >= 0.9 * n) & (digit > 0.15 * n),
        per(alt) > 0.85 * n, per(same) > 0.3 * n, (signs > 0) & (n > 4), ((first == 34) | (first == 39)) & (n > 2),
        (ats > 0) | (slashes > 1) & (signs > 0), slashes > 1, (digit > 0.6 * n) & (dashes > 0),
        (upper >= CAPITALS) & (upper > 0.9 * n), (per(_VOWEL[buf]) > 0.3 * upper) & (upper > 0.7 * n), (per(buf == 95) > 0) & (upper > 0.7 * n) & (digit == 0), (dashes > 2) & (lower > 0.6 * n), (dashes == 4) & (n > 35) & (n < 42) & (hexes + dashes > 30),
        (ats > 0) & (slashes > 1) & (signs > 1),
    ]


def tokens(buf: np.ndarray, low: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts (low: in lower case), the tokens that can be secrets: number, start, end, document and features of each; and the number of the first token of each document, with that of all at the end."""
    starts, ends = word_spans(buf)
    edges = np.searchsorted(starts, offsets)
    doc_ends = edges[1:]
    cues = np.zeros(len(starts) + 2, bool)
    cues[np.searchsorted(starts, np.array([m.start() for m in CUE.finditer(low)], np.int64), "right") - 1] = True
    cues[len(starts) :] = False
    # A digit, a capital after a small letter, or many capitals; or a cue there or shortly before, whose document is looked at below.
    long = np.flatnonzero(ends - starts >= LEAST)
    kind = _CLASS[buf]
    mark = kind == 3
    mark[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
    at = np.append(np.flatnonzero(mark), len(buf))
    capital = np.append(np.flatnonzero(kind == 2), np.full(CAPITALS, len(buf)))
    s, e = starts[long], ends[long]
    near = cues[long] | cues[long - 1] | cues[long - 2]
    own = long[near | (at[np.searchsorted(at, s)] < e) | (capital[np.searchsorted(capital, s) + CAPITALS - 1] < e)]
    s, e = starts[own], ends[own]
    doc = np.searchsorted(doc_ends, own, "right")
    begin = np.append(0, doc_ends[:-1])[doc]
    size = np.diff(np.append(0, doc_ends))
    code = np.zeros(len(offsets) - 1, bool)
    sums = np.append(0, np.cumsum(cues[: len(starts)]))
    cued = sums[doc_ends] > sums[doc_ends - size]
    cue = np.stack([cues[own - back] & (own - back >= begin) for back in range(3)])
    ends_word = np.zeros(len(cues), bool)
    ends_word[np.searchsorted(starts, np.array([m.start() for m in TOLD.finditer(low)], np.int64), "right") - 1] = True
    ends_word[len(starts) :] = False
    told = np.any([ends_word[own - back] & (own - back >= begin) for back in (1, 2)], 0)
    sign = np.zeros(len(own), bool)
    for d in np.unique(doc).tolist():
        last = buf[ends[doc_ends[d] - size[d] : doc_ends[d]] - 1]
        code[d] = np.isin(last, list(b";{}()=")).sum() > 0.05 * size[d]
    before = np.flatnonzero(own > begin)
    a, b = starts[own[before] - 1], ends[own[before] - 1]
    final = buf[b - 1]
    sign[before] = (final == 58) | (final == 61)
    # The shapes are made on a buffer of these tokens alone.
    width = e - s
    place = np.cumsum(width + 1) - width - 1
    small = np.full(int((width + 1).sum()), 32, np.uint8)
    inside = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    small[np.repeat(place, width) + inside] = buf[np.repeat(s, width) + inside]
    if not len(own):
        return own, s, e, doc, np.zeros((0, len(FEATURES)), np.float32), edges
    made = dict(zip(FEATURES, shapes(small, place, place + width), strict=False))
    cols = [*made.values(), cue[1], cue[2], cue[0], sign, cued[doc], code[doc]]
    cols += [told & made[f] for f in ("dashed", "uuid", "capitals", "marks_odd")] + [told]
    return own, s, e, doc, np.stack(cols, 1).astype(np.float32), edges


# --- training ---------------------------------------------------------------------------------------------------


def _draw(rng: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(rng.choice(list(alphabet), n))


def example(rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """A drawn token sequence with its labels."""
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda a, b: _draw(rng, low + "aeiourstn" * 3, int(rng.integers(a, b)))
    digits = lambda k: _draw(rng, num, k)
    uuid = lambda: "-".join(_draw(rng, "0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
    # Tokens with digits or capitals that aren't secrets.
    harmless = [
        lambda: digits(int(rng.integers(8, 13))),
        lambda: f"https://{word(4, 10)}.org/{word(3, 8)}/{_draw(rng, low + num, int(rng.integers(3, 9)))}",
        lambda: f"{word(3, 9)}{digits(2)}@{word(4, 9)}.com",
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
        lambda: f"+{digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{word(4, 9)}{word(4, 9).capitalize()}{word(2, 7).capitalize()}",
        lambda: f"{word(3, 8)}_{word(3, 8)}_{digits(2)}",
        lambda: f"/{word(2, 6)}/{word(3, 9)}/{word(3, 9)}{digits(1)}.{word(2, 4)}",
        lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}-{word(3, 6)}",
        lambda: f"{rng.integers(10, 255)}.{rng.integers(10, 255)}.{rng.integers(10, 255)}.{rng.integers(10, 255)}",
        lambda: f"{word(5, 12)}{digits(int(rng.integers(1, 5)))}",
        lambda: str(rng.choice(list(up + num))) * int(rng.integers(8, 60)),
        lambda: (word(1, 3) + digits(1)) * int(rng.integers(5, 20)),
        lambda: f"{word(4, 9)}({word(3, 7)}{digits(1)},{word(3, 7)})",
        lambda: f"{word(5, 9)}=\"{word(4, 8)}{digits(1)}\"",
        lambda: word(2, 6).upper() + "-" + digits(int(rng.integers(4, 9))),
        lambda: word(8, 16).capitalize() + word(3, 8).capitalize() + "!!",
        lambda: f"{word(6, 14)}{rng.choice(['###', '***', '%%%', '$$$', '&&&'])}{digits(1)}",
        uuid,
        lambda: "-".join(word(2, 8) for _ in range(rng.integers(2, 6))),
        lambda: f"{word(3, 6)}://{word(4, 10)}:{digits(4)}/{word(3, 9)}",
        lambda: word(8, 16).upper(),
        lambda: word(16, 25).upper(),
        lambda: "_".join([str(rng.choice(["KEY", "TOKEN", "ACCESS", "MAX"])), *(word(3, 9).upper() for _ in range(rng.integers(1, 4)))]),
        lambda: "-".join([word(3, 9), str(rng.choice(["key", "access", "token"])), word(3, 9), word(3, 12)]),
        lambda: "-".join(word(3, 9).capitalize() for _ in range(rng.integers(3, 6))),
    ]
    secrets = [
        lambda: _draw(rng, "0123456789abcdef", int(rng.integers(20, 65))),
        lambda: "AKIA" + _draw(rng, up + num, 16),
        lambda: "ghp_" + _draw(rng, low + up + num, 36),
        lambda: "sk-" + _draw(rng, low + up + num, int(rng.integers(24, 49))),
        lambda: _draw(rng, low + up + num + "+/", int(rng.integers(24, 60))) + "=",
        lambda: ".".join(_draw(rng, low + up + num + "_-", int(rng.integers(16, 40))) for _ in range(3)),
        lambda: _draw(rng, low + up + num, int(rng.integers(20, 49))),
        lambda: _draw(rng, up, int(rng.integers(18, 40))),
        lambda: f"{word(4, 9)}://{word(3, 9)}:{_draw(rng, low + up + num, int(rng.integers(8, 20)))}@{word(4, 10)}.{word(2, 6)}:{digits(4)}/{word(3, 9)}",
        lambda: ":".join(_draw(rng, a, int(rng.integers(10, 26))) for a in (num, low + up + num, low + up + num)),
    ]
    # Secrets where a cue stands before, and not told from other things elsewhere.
    told = [
        uuid,
        lambda: "-".join(word(3, 9) for _ in range(rng.integers(4, 8))),
        lambda: _draw(rng, low + up + num + "!#$%&*@^", int(rng.integers(12, 24))),
        lambda: _draw(rng, up, int(rng.integers(16, 30))),
    ]
    out: list[str] = []
    tags: list[int] = []
    accents = rng.random() < 0.15
    for _ in range(rng.integers(8, 30)):
        r = rng.random()
        if r < 0.3:
            w = harmless[rng.integers(0, len(harmless))]()
        elif r < 0.34:
            w = str(rng.choice(["password", "secret", "key", "token", "private", "access", "auth", "authors", "keyboard", "accessing", "private", "tokenizer"]))
        else:
            w = word(1, 14)
        if accents:
            w = w.replace("e", "é").replace("a", "ä").replace("n", "ñ")
        if rng.random() < 0.15:
            w += str(rng.choice([",", ".", ";", ":", "!!"]))
        out.append(w)
        tags.append(OUT)
        if rng.random() < 0.07:
            lead = rng.integers(0, 5)
            kinds = [*secrets, *told] if lead < 4 else secrets
            secret = kinds[rng.integers(0, len(kinds))]()
            if lead == 0:
                out += [str(rng.choice(["token", "secret", "apikey", "password", "key"])), "="]
                tags += [OUT, OUT]
                secret = f'"{secret}"'
            elif lead == 1:
                secret = str(rng.choice(["password=", "secret=", "token:", "API_KEY=", "auth="])) + secret
            elif lead == 2:
                out.append(str(rng.choice(["Bearer", "key:", "secret:", "passphrase:", "password", "token:"])))
                tags.append(OUT)
            elif lead == 3:
                out += [str(rng.choice(["key", "password", "secret", "token", "credential"])), str(rng.choice(["is", "was", "of", "->"]))]
                tags += [OUT, OUT]
            out.append(secret)
            tags.append(BEGIN)
            if rng.random() < 0.15:
                for _ in range(rng.integers(1, 4)):
                    out.append(_draw(rng, low + up + num + "+/", 64))
                    tags.append(INSIDE)
    return out, tags


def _sequences(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of drawn sequences: the features of the tokens that can be secrets, their numbers, and the labels of all tokens."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words, tags = example(rng)
        buf, offsets = joined([" ".join(words).encode()])
        own, _, _, _, x, _ = tokens(buf, buf.tobytes().lower(), offsets)
        labels = np.zeros(len(tags), np.int64)
        labels[own] = np.array(tags)[own]
        out.append((x, own, labels))
    return out


@cache
def trained(n: int = 800, seed: int = 7, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features, 3) and transition scores (3, 3), by gradient ascent on the penalised likelihood of n drawn sequences."""
    data = _sequences(n, seed)
    longest = max(len(y) for _, _, y in data)
    x = np.zeros((n, longest, len(FEATURES)))
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest))
    fixed = np.zeros((n, longest, 3))
    fixed[..., 1:] = -1e6
    for i, (f, own, labels) in enumerate(data):
        x[i, own], y[i, : len(labels)], mask[i, : len(labels)] = f, labels, 1
        fixed[i, own] = 0
    one = np.eye(3)[y] * mask[..., None]
    pair = (one[:, :-1, :, None] * one[:, 1:, None, :]).sum((0, 1))
    w, t = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    mean, square = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        e = x @ w + fixed
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for k in range(1, longest):
            new = np.logaddexp.reduce(a[:, k - 1, :, None] + t, 1) + e[:, k]
            a[:, k] = np.where(mask[:, k, None] > 0, new, a[:, k - 1])
        for k in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
            b[:, k] = np.where(mask[:, k + 1, None] > 0, new, 0.0)
        z = np.logaddexp.reduce(a[:, -1], 1)
        node = np.exp(a + b - z[:, None, None]) * mask[..., None]
        both = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [np.einsum("nkf,nkc->fc", x, one - node) - 0.05 * w, pair - both.sum((0, 1)) - 0.05 * t]
        for g, m, v, p in zip(grads, mean, square, (w, t), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, t


def viterbi(e: np.ndarray, t: np.ndarray, left: bool, right: bool) -> list[int]:
    """Best labels for emission rows; left and right tell whether an outside token stands there."""
    score = e[0] + (t[OUT] if left else 0)
    back = []
    for row in e[1:]:
        step = score[:, None] + t
        back.append(step.argmax(0))
        score = step.max(0) + row
    if right:
        score = score + t[:, OUT]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def tagged(e: np.ndarray, t: np.ndarray, own: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Labels of tokens with these numbers, of documents whose tokens are those from begin to end; all others are outside."""
    out = np.zeros(len(e), np.int8)
    unsure = np.flatnonzero(e[:, OUT] - e[:, 1:].max(1) <= 2 * (t.max() - t.min()))
    if not len(unsure):
        return out
    cuts = np.flatnonzero((np.diff(own[unsure]) > 1) | (np.diff(begin[unsure]) != 0)) + 1
    for part in np.split(unsure, cuts):
        a, b = int(part[0]), int(part[-1])
        out[part] = viterbi(e[part], t, bool(own[a] > begin[a]), bool(own[b] + 1 < end[b]))
    return out


_EDGES = b"\"'`,;:()[]{}<>.!? \t\n\x0b\x0c\r"


def trimmed(buf: np.ndarray, s: int, e: int) -> tuple[int, int]:
    """A span without the marks and white space at its edges."""
    while s < e and buf[s] in _EDGES:
        s += 1
    while e > s and buf[e - 1] in _EDGES:
        e -= 1
    return s, e


def scan(texts: list[bytes | None], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text the base spans and all spans, in code points, each sorted by start, then kind."""
    buf, offsets = joined(texts)
    low = buf.tobytes().lower()
    own, starts, ends, doc, x, edges = tokens(buf, low, offsets)
    labels = tagged(x.astype(np.float64) @ model[0], model[1], own, edges[doc], edges[doc + 1]) if len(own) else np.zeros(0, np.int8)
    base: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, text in enumerate(texts):
        at = int(offsets[i])
        base[i] = [(k, s + at, e + at) for k, s, e in base_spans(text or b"", low[at : offsets[i + 1]])]
    for s, e in zip(*(z.tolist() for z in hex_runs(buf)), strict=True):
        base[int(np.searchsorted(offsets, s, "right")) - 1].append(("hex", s, e))
    at = np.flatnonzero(labels > 0).tolist()
    runs: list[list[int]] = []
    for k in at:
        if runs and runs[-1][-1] == k - 1 and labels[k] == INSIDE and own[k] == own[k - 1] + 1 and doc[k] == doc[k - 1]:
            runs[-1].append(k)
        else:
            runs.append([k])
    for run in runs:
        s, e, d = int(starts[run[0]]), int(ends[run[-1]]), int(doc[run[0]])
        s, e = trimmed(buf, s, e)
        if e - s < 8:
            continue
        # What the base spans leave of the run, however little.
        for _, bs, be in [*sorted((x for x in base[d] if x[1] < e and s < x[2]), key=lambda x: x[1]), ("", e, e)]:
            lo, hi = trimmed(buf, s, bs)
            if lo < hi:
                added[d].append(("token", lo, hi))
            s = max(s, be)
    order = lambda x: (x[1], KINDS.index(x[0]))
    out = []
    for i in range(len(texts)):
        if not base[i] and not added[i]:
            out.append(([], []))
            continue
        zero = int(offsets[i])
        points = np.append(0, np.cumsum((buf[zero : offsets[i + 1]] & 0xC0) != 0x80))
        moved = [sorted(((k, int(points[s - zero]), int(points[e - zero])) for k, s, e in spans), key=order) for spans in (base[i], base[i] + added[i])]
        out.append((moved[0], moved[1]))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(model: tuple[np.ndarray, np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "_text")
            for i, j in chunks(texts, CHUNK):
                rows = scan(texts[i:j], model)
                count = lambda kind: pa.array([sum(k == kind for k, _, _ in b) for b, _ in rows], pa.int64())  # noqa: B023, E731
                cols = [batch.column(batch.schema.get_field_index(n)).slice(i, j - i) for n in names]
                cols += [count("assign"), count("access"), count("hex")]
                cols += [pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in rows]), pa.array([_joined(a) for _, a in rows])]
                yield pa.RecordBatch.from_arrays(cols, [*names, *MADE])

    return run


MADE = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def find_secrets(docs: DataFrame, text_col: str = "text", **training: int) -> DataFrame:
    """The columns of docs without the text, and n_assign, n_access, n_hex, base_sha256 and spans of every whole text.

    spans lists kind:start:end in code points, end exclusive, by start and then kind; kind "token" is what the
    field adds: of each run it tags, the parts outside all base spans. A null text is empty. Ids aren't used; input columns named like the
    results are replaced. An empty table gives an empty result.
    """
    names = [c for c in others(docs, *MADE) if c != text_col]
    rows = docs.select(*[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(names)], F.col(quoted(text_col)).cast("string").alias("_text"))
    held = [f"_c{i}" for i in range(len(names))]
    fields = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in held] + ["n_assign long, n_access long, n_hex long, base_sha256 string, spans string"])
    out = rows.mapInArrow(_scan(trained(**training), held), fields)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], *MADE)
