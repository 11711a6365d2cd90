"""Secret scan: fixed patterns, and a linear-chain conditional random field over tokens.

Patterns give the base spans (kinds assign, access, hex), which always stay. The field tags every token
as begin, inside or outside of a secret from its shape, the words around it and features of the whole
text; Viterbi decoding gives spans of kind crf, kept where no base span overlaps them. It learns from
the base spans of a bounded sample, so it carries what their surroundings have in common to tokens
that the patterns miss.

Scores of all tokens of a batch are sums of table rows: a distinct token's shape is looked at once. A
token is outside for certain if its score for outside leads by more than any neighbours could make up
for; Viterbi runs over the stretches between such tokens, which gives the best sequence of the whole
text. Texts of over BLOCK characters are scored in blocks of whole tokens, each with the tokens around it
that its features see and with the features of the whole text, so that their spans are those of a text
scored at once.

The base patterns know few kinds of values, so each stretch around an assigned value is learnt from
twice more: with the value drawn anew from letters and digits, and also with a plain word for the
signs between key word and value.

Bounds of the fit, all parameters: SAMPLE documents (those whose ids hash lowest), of each at most
ISLANDS stretches around base spans (WIDTH tokens on either side) and one elsewhere, each of at most
STRETCH tokens.

Defined results: a null text is the empty one and has no spans; without any base span in the sample
no field is learnt and only base spans are returned; repeated rows each get their result; a null
doc_id is scanned but never sampled; an empty table gives an empty result; further columns are
ignored. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import batches_bounded, in_tasks, memory_returned

SAMPLE, ISLANDS, WIDTH, STRETCH = 2000, 10, 8, 32
#: Characters of texts that are scored at once.
BLOCK = 500_000
#: Tokens before and after a token that its scores, and the choice of tokens to decode, look at.
BEFORE, AFTER = 4, 3
#: Distinct tokens whose scores a worker remembers.
KNOWN = 100_000
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_SIGN = re.compile("[:=]")
_TOKEN = re.compile(r"[\w+/.\-]+=*|[^\w\s]")
#: Tokens and the white space between them.
_PIECE = re.compile(r"[\w+/.\-]+=*|[^\w\s]|\s+")
_PLAIN = re.compile(r"(?!.*[a-z][A-Z])[^\W\d_]{1,23}")
_KEYS = re.compile(r"(?ai)passw|passwd|secret|token|api_?key|private|credential|auth|bearer|key")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """start, end, kind and start of the value, of all base spans, by start and then kind."""
    out = []
    if _SIGN.search(text):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_HEXA = frozenset("0123456789abcdef")


def _signature(t: str) -> tuple:
    """What a token's own features are made of; most tokens share theirs with many others."""
    n, kinds = len(t), set(t)
    if n == 1 and not t.isalnum():
        return (t,)
    if t.isalpha():
        digits, mix = 0, "l" if t.islower() else "u" if t.isupper() else "c" if t[1:].islower() else "lu"
    else:
        digits = sum(map(str.isdigit, t))
        letters = sum(map(str.isalpha, t))
        mix = ("d" if digits else "") + ("l" if any(map(str.islower, kinds)) else "") + ("u" if any(map(str.isupper, kinds)) else "") + ("_" if digits + letters < n else "")
    return (mix, min(6, n.bit_length()), min(12, len(kinds)), kinds <= _HEXA, int(digits / n * 4), n >= 12, min(3, t.count(".")), min(3, t.count("-")))


def _shape(t: str) -> list[str]:
    """Features of a token by itself."""
    return _shape_of(_signature(t))


def _shape_of(signature: tuple) -> list[str]:
    if len(signature) == 1:
        return [f"sign={signature[0]}"]
    mix, size, kinds, hexa, digits, long, dots, dash = signature
    return [f"mix={mix}", f"mix={mix},size={size}", f"kinds={kinds},size={size}", f"hex={hexa},size={size}", f"digits={digits},size={size}", f"long={long},{mix}", f"dots={dots}", f"dash={dash}"]


def _word(t: str) -> str:
    key = _KEYS.search(t) if len(t) > 2 else None
    if key:
        return f"key:{key[0].lower()}"
    if len(t) == 1 and not t.isalnum():
        return t
    return "plain" if _PLAIN.fullmatch(t) else "odd"


_AROUND = (-4, -3, -2, -1, 1, 2)


def features(tokens: list[tuple[int, int, str]], file: list[str]) -> list[list[str]]:
    """Features of each of the tokens (start, end, token) of a text."""
    words = [_word(t) for *_, t in tokens]
    out = []
    for i, (_, _, t) in enumerate(tokens):
        around = [f"at{d}={words[i + d]}" for d in _AROUND if 0 <= i + d < len(words)]
        keys = [d for d in (1, 2, 3, 4) if i >= d and words[i - d].startswith("key:")]
        out.append(["all", *_shape(t), *around, f"key_near={keys[0] if keys else 0}", f"key_near={bool(keys)},long={len(t) >= 12}", *file])
    return out


def file_features(text: str) -> list[str]:
    """Features of the whole text."""
    return [f"file_size={min(8, len(text).bit_length() // 2)}", f"file_signs={min(3, text.count('=').bit_length())}"]


@dataclass
class Field:
    """Weights: by feature for the three tags, and for each step from tag to tag."""

    weights: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    steps: list[list[float]] = field(default_factory=lambda: [[0.0] * 3 for _ in range(3)])

    def score(self, names: list[str]) -> np.ndarray:
        """Sum of the weights of features, for the three tags."""
        return np.array([self.weights[n] for n in names if n in self.weights], float).reshape(-1, 3).sum(axis=0)

    def tags(self, emit: np.ndarray, first: bool = True, last: bool = True) -> list[int]:
        """The best tag sequence (Viterbi) for scores (n, 3); inside never follows outside.

        first, last: whether the text starts and ends here; else an outside token stands there.
        """
        if not len(emit):
            return []
        steps = [[x if not (s == OUTSIDE and t == INSIDE) else -1e9 for t, x in enumerate(row)] for s, row in enumerate(self.steps)]
        best, back = [float(emit[0][t]) + ((-1e9 if t == INSIDE else 0.0) if first else steps[OUTSIDE][t]) for t in range(3)], []
        for e in emit[1:].tolist():
            came = [max(range(3), key=lambda s, t=t: best[s] + steps[s][t]) for t in range(3)]
            best = [best[s] + steps[s][t] + e[t] for t, s in enumerate(came)]
            back.append(came)
        if not last:
            best = [b + steps[t][OUTSIDE] for t, b in enumerate(best)]
        out = [max(range(3), key=best.__getitem__)]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]


class Decoder:
    """A field with its weights as tables, for whole batches of texts."""

    def __init__(self, crf: Field):
        self.crf = crf
        names = sorted({n.partition("=")[2] for n in crf.weights if n.startswith("at")})
        self.classes = {n: i + 1 for i, n in enumerate(names)}  # 0: no weight
        self.around = {d: np.vstack([np.zeros(3), *(crf.score([f"at{d}={n}"]) for n in names)]) for d in _AROUND}
        self.near = np.array([crf.score([f"key_near={d}"]) for d in range(5)])
        self.long = np.array([crf.score([f"key_near={k},long={n}"]) for k in (False, True) for n in (False, True)])
        self.known: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 6))
        self.shapes: dict[tuple, tuple] = {}
        steps = np.array(crf.steps)
        steps[OUTSIDE, INSIDE] = -1e9
        # the most that a tag other than outside can gain through the steps to and from it
        into = [(steps[p, x], steps[p, OUTSIDE]) if p is not None else (0.0 if x == BEGIN else -1e9, 0.0) for p in (BEGIN, INSIDE, OUTSIDE, None) for x in (BEGIN, INSIDE)]
        onto = [(steps[x, n], steps[OUTSIDE, BEGIN if n == INSIDE else n]) if n is not None else (0.0, 0.0) for x in (BEGIN, INSIDE) for n in (BEGIN, INSIDE, OUTSIDE, None)]
        self.lead = max(a - b for a, b in into) + max(a - b for a, b in onto)

    def _row(self, t: str) -> int:
        if t.isspace():
            self.known[t] = -1
            return -1
        got = len(self.table) + len(self.rows)
        word, signature = _word(t), _signature(t)
        own = self.shapes.get(signature)
        if own is None:
            own = self.shapes[signature] = tuple(self.crf.score(["all", *_shape_of(signature)]).tolist())
        self.rows.append((*own, self.classes.get(word, 0), word.startswith("key:"), len(t) >= 12))
        self.known[t] = got
        return got

    def scores(self, texts: list[str], files: list[list[str]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens of the texts: scores (n, 3), text, start, end. files: features of whole texts, where these are parts."""
        pieces, count = [], []
        for t in texts:
            found = _PIECE.findall(t)
            pieces += found
            count.append(len(found))
        if len(self.table) > KNOWN:
            self.known, self.table = {}, np.zeros((0, 6))
        codes = list(map(self.known.get, pieces))
        for i, c in enumerate(codes):
            if c is None:
                codes[i] = self.known[pieces[i]] if pieces[i] in self.known else self._row(pieces[i])
        code, size = np.array(codes, np.int64), np.fromiter(map(len, pieces), np.int64, len(pieces))
        text = np.repeat(np.arange(len(texts)), count)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
        end = np.cumsum(size) - begin[text] if len(text) else size
        solid = code >= 0
        code, text, end, size = code[solid], text[solid], end[solid], size[solid]
        if self.rows:
            self.table, self.rows = np.vstack([self.table, np.array(self.rows, float)]), []
        table = self.table
        emit, cls = table[code, :3], table[code, 3].astype(np.int64)
        key, long = table[code, 4] > 0, table[code, 5] > 0
        near = np.zeros(len(code), np.int64)
        for d in (4, 3, 2, 1):
            near[d:] = np.where(key[:-d] & (text[d:] == text[:-d]), d, near[d:])
        for d in _AROUND:
            a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            emit[a] += self.around[d][cls[b] * (text[a] == text[b])]
        emit += self.near[near] + self.long[2 * (near > 0) + long]
        emit += np.array([self.crf.score(f) for f in files or map(file_features, texts)]).reshape(-1, 3)[text]
        return emit, text, end - size, end

    def _open(self, emit: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens: which may be other than outside, which are the first of their text, and the last."""
        same = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)
        after = np.append(np.maximum(0, emit[1:, INSIDE] - emit[1:, BEGIN]), 0) * same if len(text) else np.zeros(0)
        first = np.append(True, ~same[:-1]) if len(text) else same
        return emit[:, OUTSIDE] - np.maximum(emit[:, BEGIN], emit[:, INSIDE]) <= self.lead + after, first, ~same

    def _decoded(self, emit: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int]]:
        """First and last token (places in the arguments) of each secret. Arguments: of the tokens that may be other than
        outside, with their numbers ``at`` among all.
        """
        if not len(at):
            return
        new = np.flatnonzero(np.append(True, (np.diff(at) > 1) | first[1:]))
        for a, b in zip(new.tolist(), (np.append(new[1:], len(at)) - 1).tolist()):
            if not first[a] and not last[b] and a == b and emit[a, BEGIN] + self.crf.steps[OUTSIDE][BEGIN] + self.crf.steps[BEGIN][OUTSIDE] <= emit[a, OUTSIDE] + 2 * self.crf.steps[OUTSIDE][OUTSIDE]:
                continue  # the commonest stretch, a single token that stays outside
            begun = None
            for i, tag in enumerate([*self.crf.tags(emit[a : b + 1], bool(first[a]), bool(last[b])), OUTSIDE], a):
                if begun is not None and tag != INSIDE:
                    yield begun, i - 1
                    begun = None
                if tag == BEGIN:
                    begun = i

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Secrets of each text: start, end."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        emit, text, start, end = self.scores(texts)
        open_, first, last = self._open(emit, text)
        at = np.flatnonzero(open_)
        for a, b in self._decoded(emit[at], at, first[at], last[at]):
            out[text[at[a]]].append((int(start[at[a]]), int(end[at[b]])))
        return out

    def long_spans(self, text: str, block: int = BLOCK) -> list[tuple[int, int]]:
        """Secrets of one text, scored in blocks of about ``block`` characters; only tokens that may be secret are kept."""
        kept, n, file = [], 0, file_features(text)
        for a, b in blocks(text, block):
            lo, hi = stepped_back(text, a, BEFORE), stepped_on(text, b, AFTER)
            emit, which, start, end = self.scores([text[lo:hi]], [file])
            own = (start + lo >= a) & (start + lo < b)
            open_, first, last = self._open(emit, which)
            # the first and last token of what is scored here are those of the text only at its ends
            first, last = first & (lo == 0), last & (hi == len(text))
            at = np.flatnonzero(open_ & own)
            kept.append((emit[at], at - np.flatnonzero(own)[0] + n if len(at) else at, first[at], last[at], start[at] + lo, end[at] + lo))
            n += int(own.sum())
        emit, at, first, last, start, end = (np.concatenate(x) for x in zip(*kept))
        return [(int(start[a]), int(end[b])) for a, b in self._decoded(emit, at, first, last)]


_SPACE = re.compile(r"\s")


def blocks(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Start and end of parts of a text of about ``size`` characters, each but the first begins with white space."""
    a = 0
    while a < len(text):
        space = _SPACE.search(text, a + size)
        b = space.start() if space else len(text)
        yield a, b
        a = b


def stepped_back(text: str, at: int, tokens: int) -> int:
    """A start before ``at``, of the text or at white space, with at least so many tokens between, if there are so many."""
    reach = 64
    while at > reach:
        space = _SPACE.search(text, at - reach, at)
        if space and len(_TOKEN.findall(text, space.start(), at)) >= tokens:
            return space.start()
        reach *= 2
    return 0


def stepped_on(text: str, at: int, tokens: int) -> int:
    """An end after ``at``, of the text or at white space, with at least so many tokens between, if there are so many."""
    end = at
    while end < len(text):
        space = _SPACE.search(text, end + 64)
        end = space.start() if space else len(text)
        if len(_TOKEN.findall(text, at, end)) >= tokens:
            return end
    return len(text)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Training:
    """Examples (features and tags of stretches) as arrays; penalised likelihood and its gradient by forward-backward."""

    def __init__(self, examples: list[tuple[list[list[str]], list[int]]], ridge: float = 0.02):
        examples = [(f, t) for f, t in examples if f]
        self.ridge, self.count = ridge, len(examples)
        self.names = {n: i for i, n in enumerate(sorted({n for f, _ in examples for x in f for n in x}))}
        self.length = np.array([len(f) for f, _ in examples], int)
        self.most = int(self.length.max()) if examples else 0
        self.index = np.full((len(examples), self.most), -1)
        rows, cols, tags, at = [], [], [], 0
        for k, (f, t) in enumerate(examples):
            self.index[k, : len(f)] = np.arange(at, at + len(f))
            tags += t
            for x in f:
                cols += [self.names[n] for n in x]
                rows += [at] * len(x)
                at += 1
        self.rows, self.cols, self.tags, self.tokens = np.array(rows, int), np.array(cols, int), np.array(tags, int), at
        self.real = self.index >= 0
        self.ban = np.zeros((3, 3))
        self.ban[OUTSIDE, INSIDE] = -1e9
        self.gold = np.zeros((3, 3))
        for k in range(self.count):
            t = self.tags[self.index[k, : self.length[k]]]
            np.add.at(self.gold, (t[:-1], t[1:]), 1)

    def loss(self, w: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log-likelihood with the ridge, and its gradients by weights (features, 3) and steps (3, 3)."""
        emit = np.stack([np.bincount(self.rows, w[self.cols, t], self.tokens) for t in range(3)], 1)
        e = np.where(self.real[..., None], emit[self.index], 0)
        step, most = steps + self.ban, self.most
        alpha = np.zeros((self.count, most, 3))
        alpha[:, 0] = e[:, 0] + np.array([0, -1e9, 0])
        for i in range(1, most):
            alpha[:, i] = np.where(self.real[:, i, None], _logsumexp(alpha[:, i - 1, :, None] + step, 1) + e[:, i], alpha[:, i - 1])
        beta = np.zeros_like(alpha)
        for i in range(most - 2, -1, -1):
            beta[:, i] = np.where(self.real[:, i + 1, None], _logsumexp(step + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        z = _logsumexp(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None])
        flat = np.zeros((self.tokens, 3))
        flat[self.index[self.real]] = p[self.real]
        flat[np.arange(self.tokens), self.tags] -= 1
        grad = np.stack([np.bincount(self.cols, flat[self.rows, t], len(self.names)) for t in range(3)], 1) + self.ridge * w
        pair = np.zeros((3, 3))
        for i in range(1, most):
            q = alpha[:, i - 1, :, None] + step + (e[:, i] + beta[:, i])[:, None, :] - z[:, None, None]
            pair += np.where(self.real[:, i, None, None], np.exp(np.minimum(q, 0)), 0).sum(0)
        gold = emit[np.arange(self.tokens), self.tags].sum() + (self.gold * steps).sum()
        value = float(z.sum() - gold + self.ridge / 2 * ((w**2).sum() + (steps**2).sum()))
        return value, grad, pair - self.gold + self.ridge * steps


def fit(examples: list[tuple[list[list[str]], list[int]]], rounds: int = 60, ridge: float = 0.1, rate: float = 0.15) -> Field:
    """A field of greatest penalised likelihood, by steps over all examples at once, scaled by running means of the
    gradient and of its square.
    """
    if not any(t != OUTSIDE for _, tags in examples for t in tags):
        return Field()
    data = Training(examples, ridge)
    at = [np.zeros((len(data.names), 3)), np.zeros((3, 3))]
    mean, square = [np.zeros_like(x) for x in at], [np.zeros_like(x) for x in at]
    for k in range(1, rounds + 1):
        _, *grads = data.loss(*at)
        for x, g, m, v in zip(at, grads, mean, square):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    w, steps = at
    return Field({n: tuple(map(float, w[i])) for n, i in data.names.items()}, steps.tolist())


def _examples(text: str) -> Iterator[tuple[list, list[int]]]:
    """Stretches of a text with the tags that its base spans give: around them, and one elsewhere."""
    values = [(v, e) for _, e, _, v in base_spans(text)]
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    if not tokens:
        return
    starts, tags = [s for s, *_ in tokens], [OUTSIDE] * len(tokens)
    wanted: list[list[int]] = []
    for v, e in values:
        i = max(0, bisect_right(starts, v) - 1)
        if tokens[i][1] <= v:
            i += 1
        a = i
        while i < len(tokens) and tokens[i][0] < e:
            if tags[i] == OUTSIDE:
                tags[i] = BEGIN if i == a else INSIDE
            i += 1
        wanted.append([max(0, a - WIDTH), min(len(tokens), i + WIDTH)])
    at = zlib.crc32(text.encode("utf-8", "replace")) % len(tokens)
    stretches = [[at, min(len(tokens), at + STRETCH)]]
    for a, b in sorted(wanted)[:ISLANDS]:
        if len(stretches) > 1 and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    file = file_features(text)
    for a, b in stretches:
        b = min(b, a + STRETCH)
        own = [BEGIN if t == INSIDE and i == 0 else t for i, t in enumerate(tags[a:b])]
        # features see what stands before and after the stretch
        lo, hi = max(0, a - 4), min(len(tokens), b + 2)
        yield features(tokens[lo:hi], file)[a - lo : b - lo], own
        new, dropped, plain = list(tokens[a:b]), set(), set()
        for i, t in enumerate(own):
            if t == BEGIN and (i == len(own) - 1 or own[i + 1] != INSIDE) and len(new[i][2]) >= 12:
                back = [j for j in range(max(0, i - 3), i) if new[j][2] in _SIGNS or _KEYS.search(new[j][2])]
                if any(_KEYS.search(new[j][2]) for j in back):
                    new[i] = (*new[i][:2], _redrawn(new[i][2]))
                    signs = [j for j in back if new[j][2] in _SIGNS]
                    dropped |= set(signs[1:])
                    plain |= set(signs[:1])
                    new[back[0]] = (*new[back[0]][:2], new[back[0]][2].rstrip("="))
        if dropped or new != tokens[a:b]:
            yield features(new, file), own
            kept = [j for j in range(len(new)) if j not in dropped]
            yield features([(*new[j][:2], "is") if j in plain else new[j] for j in kept], file), [own[j] for j in kept]


_SIGNS = frozenset("=:\"'")
_DRAWN = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def _redrawn(value: str) -> str:
    """Another value of the same length: a stream of characters that the hash of the value starts."""
    h, out, n = zlib.crc32(value.encode()), [], len(value)
    alphabet = _DRAWN[: 24 + h % (len(_DRAWN) - 23)]
    for _ in range(max(12, n // (1 + h % 2))):
        h = (h * 1103515245 + 12345) & 0x7FFFFFFF
        out.append(alphabet[(h >> 8) % len(alphabet)])
    return "".join(out)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from at most ``sample`` documents of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = rows.join(F.broadcast(ids), "doc_id", "left_semi")

    def make():
        def run(batch: dict) -> Iterator[dict]:
            found = [(d, f, t) for d, text in zip(batch["doc_id"], batch["text"]) if text for f, t in _examples(text)]
            yield {"doc_id": [d for d, *_ in found], "f": [["\n".join(x) for x in f] for _, f, _ in found], "t": [t for *_, t in found]}

        return run

    got = in_tasks(some, make, "doc_id long, f array<string>, t array<int>").orderBy("doc_id", F.xxhash64("f"), "f").limit(sample * (3 * ISLANDS + 3)).collect()
    return fit([([x.split("\n") for x in r["f"]], list(r["t"])) for r in got])


def decoder(crf: Field) -> Decoder:
    """The field's tables, made once a worker."""
    if getattr(crf, "_decoder", None) is None:
        crf._decoder = Decoder(crf)
    return crf._decoder


def all_spans(texts: list[str | None], crf: Field) -> list[list[tuple[int, int, str]]]:
    """Of each text, start, end, kind of base spans and of those that the field adds."""
    out = [[(s, e, k) for s, e, k, _ in base_spans(text)] if text else [] for text in texts]
    if crf.weights:
        added: list[list] = [[] for _ in texts]
        some, size = [], 0

        def decode() -> None:
            for i, spans in zip(some, decoder(crf).spans([texts[i] for i in some])):
                added[i] = spans

        for i, text in enumerate(texts):
            if text and len(text) > BLOCK:
                added[i] = decoder(crf).long_spans(text, BLOCK)
            elif text:
                some.append(i)
                size += len(text)
                if size >= BLOCK:  # about as much at once as a block of a long text
                    decode()
                    some, size = [], 0
        decode()
        for base, more in zip(out, added):
            free = _apart([(a, b) for a, b, _ in base])
            base += [(s, e, "crf") for s, e in more if free(s, e)]
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in out]


def _apart(spans: list[tuple[int, int]]):
    """Whether a stretch touches none of ``spans`` (by start)."""
    starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def free(s: int, e: int) -> bool:
        before = bisect_left(starts, e)
        return not before or reach[before - 1] <= s

    return free


def scan(docs: DataFrame, crf: Field) -> DataFrame:
    """doc_id, rid and spans (array of start, end, kind) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def make():
        def run(batch: dict) -> Iterator[dict]:
            yield {"doc_id": batch["doc_id"], "spans": [[{"start": s, "end": e, "kind": k} for s, e, k in spans] for spans in all_spans(batch["text"], shared.value)]}

        return run

    return in_tasks(rows, make, "doc_id long, spans array<struct<start:int,end:int,kind:string>>", 500)


def redacted(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str | None:
    """The text with each stretch that spans cover replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, crf: Field) -> DataFrame:
    """``docs`` with all their columns, secrets in ``text`` replaced and ``n_chars`` (where there is one) counted anew."""
    shared, at = docs.sparkSession.sparkContext.broadcast(crf), docs.columns.index("text")
    docs = docs.withColumns({"text": docs["text"].cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column(at).to_pylist()
                new = pa.array([redacted(t, spans) for t, spans in zip(texts, all_spans(texts, shared.value))], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([new if c == at else part.column(c) for c in range(part.num_columns)], schema=part.schema)
        memory_returned()

    out = batches_bounded(docs).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumns({"n_chars": F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))})
    return out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, scanned by the patterns and a field learnt from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, learn(docs))
    kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", *[F.size(kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
