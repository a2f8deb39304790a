"""Personal data in texts: exact base patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans come from the patterns below (leftmost, not overlapping within a kind; matches that fail their check are
dropped). The model reads character classes, and tags B/I per kind or O. It knows the four base kinds also in spellings that
no base pattern has (telephone numbers without a plus, dotted cards, written-out addresses), and a fifth kind, ``secret``:
the value of a password, token or key, which only its surroundings tell from any other string. It is trained in numpy by
exact gradients of the CRF likelihood on labelled spans; ``labelled_examples`` makes them from seeded templates, so the model
does not depend on the table that is scanned; rounded gradients and parameters make it the same in every run and on every machine.

Every kind has a digit, an @, a written-out at, or, for secrets, an equals sign or colon before it; windows without any
(TRIGGER) can hold no span by the kinds' definition, and texts without any are not sent to Python. Windows of WINDOW
characters start every STRIDE characters around such characters; each is decoded by Viterbi, a span counts in the window
whose core holds its centre. A span that reaches the end of its window counts there; it, and every secret, goes on to the end
of its token, of any length; a piece that begins with its window belongs to an earlier one. Over the whole text the set of non-overlapping
spans with the highest total margin over O is taken.

What is added. A model span is added if it touches no base span (a secret may
have one within it), its margin reaches its kind's threshold, and its
body can be what it says (see plausible): so a long word or the address of a page is no email. Thresholds are
calibrated: the smallest at which PRECISION of the proposals on further labelled examples are exact. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base kinds in the order of ties, then the kinds that the model alone finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = KINDS.index("secret")
WINDOW, STRIDE = 128, 64
HIDDEN = 24
SEED = 11
#: Labelled texts of training and of calibration, their characters, passes and batches: documented bounds.
EXAMPLES, CALIBRATION, LENGTH, EPOCHS, BATCH = 5000, 1500, 112, 4, 20
PRECISION = 0.985
Span = tuple[int, int, int]  # start, kind number, end

# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# no match can begin inside a run of digits: the look-behind only keeps the search linear
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: What every span of a kind has in it or right before it: a digit, an @ or a written-out at, the sign before a secret.
TRIGGER = r"[0-9@=:]|[\[(] ?(?i:at) ?[\])]"
_TRIGGER = re.compile(TRIGGER)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    # a part with over 18 digits is compared without its leading zeros
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_phone(text: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", text)) <= 15


def base_spans(text: str) -> list[Span]:
    """(start, kind number, end) in order of start, then kind."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
        last = domain.end() if domain else at + 1
        at = text.find("@", last)
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if is_ip(m[0])]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if is_card(m[0])]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if is_phone(m[0])]
    return sorted(found)


# ---------------------------------------------------------------- labelled examples

_CLASSES = np.full(129, 5, dtype=np.int64)  # 0 pads, 5 is any other control character, 128 stands for all beyond ASCII
_CLASSES[ord("0") : ord("9") + 1] = 3
_CLASSES[ord(" ")] = 4
for _k, _c in enumerate(string.punctuation):
    _CLASSES[ord(_c)] = 7 + _k
_CLASSES[128] = 6
# every letter is a class, so that the model can read what stands before a value
for _k, _c in enumerate(string.ascii_letters):
    _CLASSES[ord(_c)] = 7 + len(string.punctuation) + _k
N_CLASSES = 7 + len(string.punctuation) + len(string.ascii_letters)
N_TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def classes_of(text: str) -> np.ndarray:
    return _CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]


def _word(rng: np.random.Generator) -> str:
    letters = "abcdefghijklmnopqrstuvwxyzéèñüß"
    word = "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(1, 10)))
    return word.capitalize() if rng.random() < 0.2 else word


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(str(x) for x in rng.integers(0, 10, n))


def _ascii(rng: np.random.Generator, low: int = 2, high: int = 9) -> str:
    return "".join(string.ascii_lowercase[i] for i in rng.integers(0, 26, rng.integers(low, high)))


def _of(rng: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def _email(rng: np.random.Generator, pick) -> str:
    local = pick(_ascii(rng), f"{_ascii(rng)}.{_ascii(rng)}{_digits(rng, rng.integers(0, 3))}", f"{_ascii(rng)}.{_digits(rng, 2)}", f"{_ascii(rng)}_{_digits(rng, 2)}", f"{_ascii(rng)}+{_ascii(rng)}")
    host, end = f"{pick('', 'mail.')}{_ascii(rng)}{_digits(rng, rng.integers(0, 2))}", pick("com", "org", "net", "co.uk", "de", "fr")
    at, dot = ("@", ".") if rng.random() < 0.75 else (pick(" [at] ", " (at) ", "(at)", "[at]"), pick(".", " [dot] ", " (dot) "))
    return f"{local}{at}{host}{dot}{end}"


def _card(rng: np.random.Generator, pick) -> str:
    number = pick("4", "5", "37", "62") + _digits(rng, 13)
    number += next(c for c in string.digits if luhn(number + c))
    joint = pick("", "", " ", "-", ".")
    return joint.join(number[i : i + 4] for i in range(0, len(number), 4))


def _phone(rng: np.random.Generator, pick) -> str:
    d = lambda n: _digits(rng, n)
    return pick(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(11)}", f"{d(3)}.{d(3)}.{d(4)}")


#: How often each kind stands in an example: the hard one most.
_SHARES = (0.16, 0.14, 0.15, 0.15, 0.4)
_HEX = "0123456789abcdef"
_MIXED = string.ascii_letters + string.digits
_SECRET_KEYS = ("password", "Password", "passwd", "pwd", "token", "token", "auth_token", "secret", "client_secret", "api_key", "apikey", "access_key")
_OTHER_KEYS = ("commit", "sha1", "md5", "hash", "digest", "checksum", "id", "uuid", "color", "version", "page", "etag", "build", "ref")


def _value(rng: np.random.Generator, pick) -> str:
    n = int(rng.integers(12, 41)) if rng.random() < 0.7 else int(rng.integers(41, 84))
    return pick(_ascii(rng, 10, 25), _of(rng, _HEX, n), _of(rng, _HEX, n), _of(rng, _MIXED, n), _of(rng, _MIXED, n // 2) + _digits(rng, 2), f"sk-{_of(rng, _MIXED, n)}", f"ghp_{_of(rng, _MIXED, 36)}")


def _keyed_value(rng: np.random.Generator, keys: tuple[str, ...], pick) -> tuple[str, str, str]:
    """What stands before a value, the value, and what stands after it."""
    before, quote = f"{pick(*keys)}{pick('=', ' = ', ': ', ':')}", pick("", "", '"', "'")
    return before + quote, _value(rng, pick), quote


def _long_word(rng: np.random.Generator, pick) -> str:
    """Compounds, addresses of pages and files, names in code, runs of one letter: long, and nobody's data."""
    n = int(rng.integers(14, 90))
    part = lambda: _ascii(rng, 2, 14)
    joined = lambda by, most=6: by.join(part() for _ in range(rng.integers(2, most)))
    return pick("".join(part() for _ in range(rng.integers(2, 9))), _of(rng, string.ascii_lowercase, 1) * n, f"http{pick('', 's')}://www.{part()}.com/{joined('/')}", f"//{part()}.{part()}.org/{joined('-')}.html", f"/{joined('/')}.py", joined("_"), part() + "".join(part().capitalize() for _ in range(3)), f"{joined('.')}({part()})", f"{part()}: {part()}", f"{part()}={joined('_')}", f"{part()}:{part()}/{_digits(rng, 4)}")


def _distractor(rng: np.random.Generator, pick) -> str:
    if rng.random() < 0.35:
        return _long_word(rng, pick)
    d = lambda n: _digits(rng, n)
    plain = (d(4), d(rng.integers(1, 8)), f"{d(1)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(2)}:{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"@{_word(rng)}", f"{d(3)},{d(3)}", _of(rng, _HEX, int(rng.integers(8, 41))), f"#{_of(rng, _HEX, 6)}", f'"{d(rng.integers(1, 12))}"', f"{_ascii(rng)}={d(rng.integers(1, 6))}", "".join(_keyed_value(rng, _OTHER_KEYS, pick)), "".join(_keyed_value(rng, _OTHER_KEYS, pick)))
    return plain[rng.integers(0, len(plain))]


def labelled_examples(n: int = EXAMPLES, length: int = LENGTH, seed: int = SEED) -> Iterator[tuple[str, list[Span]]]:
    """(text, spans) of seeded templates: words, numbers that are nobody's, and data of each kind in several spellings."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(0, len(x))]
    makers = (_email, lambda r, _: ".".join(str(x) for x in r.integers(0, 256, 4)), _card, _phone)
    for _ in range(n):
        parts: list[str] = []
        spans: list[Span] = []
        size = 0
        while size < length:
            r = rng.random()
            kind = int(rng.choice(len(KINDS), p=_SHARES)) if r < 0.25 else -1
            before, part, after = "", "", ""
            if kind == len(BASE_KINDS):
                before, part, after = _keyed_value(rng, _SECRET_KEYS, pick)
            elif kind >= 0:
                part = makers[kind](rng, pick)
            else:
                part = _distractor(rng, pick) if r < 0.4 else _word(rng)
            if kind >= 0 and size + len(before) + len(part) > length:
                continue
            if kind >= 0:
                spans.append((size + len(before), kind, size + len(before) + len(part)))
            whole = before + part + after + pick(" ", " ", " ", ", ", ".\n", "### ", ": ")
            parts.append(whole)
            size += len(whole)
        yield "".join(parts)[:length], spans


def tags_of(length: int, spans: Iterable[Span]) -> np.ndarray:
    tags = np.zeros(length, dtype=np.int64)
    for start, kind, end in spans:
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    return tags


# ---------------------------------------------------------------- model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _barred() -> np.ndarray:
    """Large negative scores of transitions that no tagging has: I follows B or I of its own kind only."""
    bar = np.zeros((N_TAGS, N_TAGS))
    for k in range(len(KINDS)):
        bar[:, 2 + 2 * k] = -1e4
        bar[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return bar


class Model:
    """Parameters: for each direction x (classes, 4H), h (H, 4H), b; then emissions w (2H, tags), c; CRF transitions t."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, 0.3, (N_CLASSES, 4 * hidden))
            self.p[f"h{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0  # remember at first
            self.p[f"b{way}"] = bias
        self.p["w"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, N_TAGS))
        self.p["c"] = np.zeros(N_TAGS)
        self.p["t"] = np.zeros((N_TAGS, N_TAGS))
        self.bar = _barred()
        #: Margin over O that a span of each kind needs to be added; see calibrate.
        self.threshold = np.zeros(len(KINDS))

    def _run(self, ids: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """ids (batch, time) in reading order of this direction -> hidden states (time, batch, H)."""
        n, steps, size = len(ids), ids.shape[1], self.hidden
        u, h, c = self.p[f"h{way}"], np.zeros((n, self.hidden)), np.zeros((n, self.hidden))
        inputs = self.p[f"x{way}"][ids.T] + self.p[f"b{way}"]
        out = np.empty((steps, n, size))
        for t in range(steps):
            a = inputs[t] + h @ u
            gates = _sigmoid(a[:, : 3 * size])
            i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(a[:, 3 * size :])
            before, hidden = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((i, f, o, g, before, tc, hidden))
        return out

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(batch, time) -> (time, batch, tags)."""
        lists = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._run(ids, "f", lists[0]), self._run(ids[:, ::-1], "b", lists[1])[::-1]], axis=2)
        if keep is not None:
            keep.update(f=lists[0], b=lists[1], both=both)
        return both @ self.p["w"] + self.p["c"]

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags (batch, time) and its gradients."""
        keep: dict = {}
        e = self.emissions(ids, keep)
        steps, n, _ = e.shape
        trans = self.p["t"] + self.bar
        start = self.bar[0]
        # forward and backward sums, scaled to 1 at every position; the scales hold the likelihood
        top = e.max(axis=2, keepdims=True)
        local, moves = np.exp(e - top), np.exp(trans)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, n, 1))
        for t in range(steps):
            now = local[0] * np.exp(start) if t == 0 else (alpha[t - 1] @ moves) * local[t]
            scale[t] = now.sum(axis=1, keepdims=True)
            alpha[t] = now / scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (beta[t + 1] * local[t + 1] / scale[t + 1]) @ moves.T
        z = (np.log(scale) + top).sum(axis=(0, 2))
        gold = np.eye(N_TAGS)[tags.T]
        marginal = alpha * beta
        score = (e * gold).sum() + trans[tags[:, :-1], tags[:, 1:]].sum()
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        expected = moves * (alpha[:-1].reshape(-1, N_TAGS).T @ (local[1:] * beta[1:] / scale[1:]).reshape(-1, N_TAGS))
        np.add.at(expected, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1.0)
        grads["t"] = expected / n
        de = (marginal - gold) / n
        flat = de.reshape(-1, N_TAGS)
        grads["w"], grads["c"] = keep["both"].reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
        dboth = de @ self.p["w"].T
        size = self.hidden
        for way, dh_all, order in (("f", dboth[:, :, :size], ids), ("b", dboth[::-1, :, size:], ids[:, ::-1])):
            u = self.p[f"h{way}"]
            dh_next, dc = np.zeros((n, size)), np.zeros((n, size))
            da_all = np.empty((steps, n, 4 * size))
            for t in range(steps - 1, -1, -1):
                i, f, o, g, before, tc, _ = keep[way][t]
                dh = dh_all[t] + dh_next
                dc = dc + dh * o * (1 - tc * tc)
                da = da_all[t]
                da[:, :size] = dc * g * i * (1 - i)
                da[:, size : 2 * size] = dc * before * f * (1 - f)
                da[:, 2 * size : 3 * size] = dh * tc * o * (1 - o)
                da[:, 3 * size :] = dc * i * (1 - g * g)
                dh_next, dc = da @ u.T, dc * f
            before_all = np.concatenate([k[6] for k in keep[way]])
            grads[f"h{way}"] = before_all.T @ da_all.reshape(-1, 4 * size)
            grads[f"b{way}"] = da_all.sum(axis=(0, 1))
            grads[f"x{way}"] = np.eye(N_CLASSES)[order.T.ravel()].T @ da_all.reshape(-1, 4 * size)
        return float((z.sum() - score) / n), grads

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags (batch, time), and per position the margin of the path over O."""
        e = self.emissions(ids)
        steps, n, _ = e.shape
        trans = self.p["t"] + self.bar
        best, back = e[0] + self.bar[0], np.empty((steps, n, N_TAGS), np.int8)
        for t in range(1, steps):
            paths = best[:, :, None] + trans
            back[t] = paths.argmax(axis=1)
            best = e[t] + paths.max(axis=1)
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t, np.arange(n), tags[t]]
        return tags.T, self._margins(e, tags).T

    def _margins(self, e: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Per position the part of the path's score, move to the position included, above that of O throughout."""
        part = np.take_along_axis(e, tags[:, :, None], axis=2)[:, :, 0] - e[:, :, 0]
        part[1:] += self.p["t"][tags[:-1], tags[1:]] - self.p["t"][0, 0]
        return part


def _on_grid(x: np.ndarray, bits: int) -> np.ndarray:
    return np.round(x * 2.0**bits) / 2.0**bits


def train(examples: Iterable[tuple[str, list[Span]]], epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.025, seed: int = SEED) -> Model:
    """Adam on the CRF likelihood of labelled texts, each padded to the longest.

    Gradients and parameters are rounded to grids far coarser than the last bits in which sums of two machines differ, so
    the parameters, which would otherwise drift apart within some hundred steps, come out equal."""
    rows = list(examples)
    length = max(len(t) for t, _ in rows)
    ids, tags = np.zeros((len(rows), length), np.int64), np.zeros((len(rows), length), np.int64)
    for k, (text, spans) in enumerate(rows):
        ids[k, : len(text)] = classes_of(text)
        tags[k, : len(text)] = tags_of(len(text), spans)
    model, rng = Model(seed=seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    total = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = order[at : at + batch]
            _, grads = model.step(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            now = rate * (1 - step / (total + 1)) + 1e-4
            for k, g in grads.items():
                # sums differ in their last bits by machine; what is kept of them does not
                g = _on_grid(g * min(1.0, 5.0 / (norm + 1e-9)), 30)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                change = now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                model.p[k] = _on_grid(model.p[k] - change, 20)
    return model


def calibrate(model: Model, examples: Iterable[tuple[str, list[Span]]], precision: float = PRECISION) -> None:
    """Set the model's thresholds: per kind the smallest margin at which this share of what it finds is exact."""
    rows = list(examples)
    found: list[list[tuple[float, bool]]] = [[] for _ in KINDS]
    for (text, spans), proposed in zip(rows, model_spans([t for t, _ in rows], model), strict=True):
        for start, kind, end, score in proposed:
            found[kind].append((score, (start, kind, end) in spans))
    for kind, scored in enumerate(found):
        scored.sort(reverse=True)
        right = np.cumsum([ok for _, ok in scored])
        good = np.flatnonzero(right >= precision * np.arange(1, len(scored) + 1))
        # where all that is found is precise enough, a smaller margin than any seen is no reason against a span
        low = 0.0 if len(good) and good[-1] == len(scored) - 1 else np.inf
        model.threshold[kind] = min(low, np.floor(scored[good[-1]][0] * 1000) / 1000) if len(good) else np.inf


@lru_cache(maxsize=1)
def default_model() -> Model:
    model = train(labelled_examples())
    calibrate(model, labelled_examples(CALIBRATION, LENGTH, SEED + 1))
    return model


# ---------------------------------------------------------------- windows


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a trigger (starts are multiples of STRIDE)."""
    found: set[int] = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        found.update((k * STRIDE, max(0, k - 1) * STRIDE))
    return sorted(found)


def _spans_in(tags: np.ndarray, margin: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    at = 0
    for at in np.flatnonzero(tags % 2 == 1):
        kind, end = (int(tags[at]) - 1) // 2, int(at) + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        # the move back to O belongs to the span
        yield int(at), kind, end, float(margin[at : end + (end < len(tags) and tags[end] == 0)].sum())


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of scored spans of a text, the non-overlapping set with the highest total score."""
    rows = sorted(set(found), key=lambda x: (x[2], x[0], x[1]))
    ends = [r[2] for r in rows]
    best: list[tuple[float, int]] = [(0.0, -1)]
    from bisect import bisect_right

    jump = [bisect_right(ends, r[0], 0, k) for k, r in enumerate(rows)]
    for k, r in enumerate(rows):
        take = best[jump[k]][0] + max(r[3], 0.0)
        best.append((take, k) if take > best[k][0] else (best[k][0], -1))
    chosen, k = [], len(rows)
    while k:
        if best[k][1] < 0:
            k -= 1
        else:
            chosen.append(rows[k - 1])
            k = jump[k - 1]
    return sorted(chosen)


_TOKEN = re.compile(r"[A-Za-z0-9_+/=~%@-]*(?:\.[A-Za-z0-9_+/=~%@-]+)*")


def token_end(text: str, at: int) -> int:
    """Where the run of letters, digits and joints that goes on at this place ends; a full stop at its end is not of it."""
    return _TOKEN.match(text, at).end()


def model_spans(texts: list[str], model: Model, at_once: int = 128) -> list[list[tuple[int, int, int, float]]]:
    """Plausible spans of each text, globally reconciled, with their margins over O."""
    codes = [classes_of(t) for t in texts]
    jobs = [(k, w) for k, t in enumerate(texts) for w in windows_of(t)]
    scored: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    edge = (WINDOW - STRIDE) // 2
    for at in range(0, len(jobs), at_once):
        part = jobs[at : at + at_once]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for row, (k, w) in enumerate(part):
            piece = codes[k][w : w + WINDOW]
            ids[row, : len(piece)] = piece
        tags, margin = model.decode(ids)
        for row in np.flatnonzero(tags.any(axis=1)):
            k, w = part[row]
            size = len(codes[k])
            for start, kind, end, score in _spans_in(tags[row], margin[row]):
                if start == 0 and w or w + end > size:
                    continue  # it begins in an earlier window, or ends beyond the text
                last, centre = w + end, (start + end) / 2
                cut = end == WINDOW and last < size
                if cut or kind == SECRET:
                    # a secret is a whole token, and only tokens are as long as to be cut by a window
                    last = token_end(texts[k], last)
                core = (centre >= edge or w == 0) and (centre < WINDOW - edge or w + WINDOW >= size)
                # what cannot be of its kind must not win over what can
                if (cut or core) and plausible(texts[k], w + start, kind, last):
                    scored[k].append((w + start, kind, last, score))
    return [reconcile(x) for x in scored]


_NUMBERS = re.compile(r"[0-9]+")


_WRITTEN_EMAIL = re.compile(r"[^\s@()\[\]]+(@| ?[\[(] ?at ?[\])] ?)[^\s@()\[\]]+?((\.| ?[\[(] ?dot ?[\])] ?)[^\s@()\[\].]+)+", re.IGNORECASE)
_BEFORE_SECRET = re.compile(r"[=:] ?[\"']?$")


def plausible(text: str, start: int, kind: int, end: int) -> bool:
    """Whether a span can be what the model says: an address has an at and a dot, in one spelling or the other; numbers have
    the parts, sum or count of digits that theirs must have; a secret has no white space, and an equals sign or colon before it."""
    body = text[start:end]
    if kind == 0:
        return _WRITTEN_EMAIL.fullmatch(body) is not None
    if kind == 1:
        parts = [p.lstrip("0") for p in _NUMBERS.findall(body)]
        return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    if kind == 2:
        return is_card(body)
    if kind == 3:
        return is_phone(body)
    return len(body) >= 8 and not re.search(r"\s", body) and _BEFORE_SECRET.search(text[max(0, start - 3) : start]) is not None


def added_spans(base: list[Span], proposed: list[tuple[int, int, int, float]], threshold: np.ndarray) -> list[Span]:
    """Model spans that reach their kind's threshold and touch no base span; a secret may have base spans within it."""
    kept: list[Span] = []
    for start, kind, end, score in proposed:
        clear = not any(start < e and s < end and not (kind == SECRET and start <= s and e <= end) for s, _, e in base)
        if clear and score >= threshold[kind]:
            kept.append((start, kind, end))
    return kept


def find_spans(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    full = [k for k, t in enumerate(texts) if _TRIGGER.search(t)]
    found: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    for k, proposed in zip(full, model_spans([texts[k] for k in full], model), strict=True):
        base = base_spans(texts[k])
        found[k] = (base, sorted(base + added_spans(base, proposed, model.threshold)))
    return found


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Spans replaced by [KIND]; of overlapping spans the merged range gets the first one's kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans for every row of docs (doc_id, text).

    Null texts are empty. Texts without a trigger have no spans and are not sent to Python. Of spans with one start the kind
    that is listed first comes first. Repeated rows give a row each, equal texts equal spans; other columns are ignored; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    schema = docs.select("doc_id").schema
    for c in names[1:5]:
        schema = schema.add(c, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans([t or "" for t in batch.column(1).to_pylist()], shared.value)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([_listed(x) for _, x in found], pa.string())], names=names)

    return docs.select("doc_id", F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("text")).mapInArrow(run, schema)


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; n_chars, where present, follows.

    Null texts stay null, empty ones empty. Repeated rows stay, each changed alike. Columns may have any names. An empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    names = docs.columns
    # the row travels as one struct, so no column of docs can clash with ours; only texts with a trigger travel twice
    packed = docs.select(F.struct(*names).alias("_row"), F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("_hit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            hits = [k for k, t in enumerate(texts) if t is not None]
            new: list[str | None] = [None] * len(texts)
            for k, (_, spans) in zip(hits, find_spans([texts[k] for k in hits], shared.value), strict=True):
                if spans:
                    new[k] = redact(texts[k], spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["_row", "_new"])

    rows = packed.mapInArrow(run, packed.select("_row").schema.add("_new", "string"))
    changed = F.col("_new").isNotNull()
    field = F.col("_row").getField
    new = {"text": F.coalesce(F.col("_new"), field("text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(changed, F.length("_new").cast("long")).otherwise(field("n_chars"))
    return rows.select(*[(new[c] if c in new else field(c)).alias(c) for c in names])
