"""Personal data: fixed patterns, and a character-level BiLSTM with CRF transitions.

The patterns give the base spans. The model is trained in numpy from labelled spans: windows of documents around
base spans and around digits that belong to none, with the spans' characters tagged B (first) or I by kind and O
elsewhere. Most spans are also shown in forms that the patterns miss (an address with words or brackets for its marks,
a number without plus, a card or an ip with other separators), in the text that stood around them, so the model learns
these from their make-up and surroundings.

Texts are scanned whole. A span of a kind must hold the kind's shape (`SHAPES`: parts of an address around a mark or
its stand-in, enough digits near each other, four small numbers in a row), whatever else it is, so the network scores
every stretch around a shape, in overlapping windows; elsewhere it could add nothing. A character's tag scores
come from the window in which it is farthest from an edge, and one Viterbi pass over each stretch reconciles the
windows, so no span is cut at a window's edge.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, shipped, sigmoid, table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DIGITS = re.compile(r"[0-9]")
CUE = re.compile(r"[0-9@]")
_WORD_MARK = r"\x20?[\(\[\{{]\x20?{0}\x20?[\)\]\}}]\x20?|\x20{0}\x20"
AT = r"\x20?@\x20?|" + _WORD_MARK.format("(?:at|@)")
DOT = r"\.|" + _WORD_MARK.format("(?:dot|\\.)")
#: What a span of a kind holds at least. All are bounded repeats, so a scan is linear.
SHAPES = {
    "email": re.compile(rf"[A-Za-z0-9_%+-](?:{AT})[A-Za-z0-9-]{{1,63}}(?:{DOT})[A-Za-z0-9]", re.I),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:(?:\x20?,\x20?|{DOT})[0-9]{{1,3}}){{3}}", re.I),
    "number": re.compile(r"[0-9](?:[^0-9A-Za-z\n]{0,3}[0-9]){8,}"),
}
WINDOW, STEP, NEAR, LESSON = 96, 48, 32, 64


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in found.split(".")))
    if kind in ("card", "phone"):
        digits = "".join(DIGITS.findall(found))
        return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
    return True


def _emails(text: str):
    """The pattern's matches, sought from each @: a scan for the first part alone is slow on long words."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = PATTERNS["email"].match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str):
    """The matches of the ip pattern: every four parts of a dotted number in turn. The pattern itself would start anew at each digit of a long number."""
    for run in DOTTED.finditer(text):
        parts = list(DIGIT_RUN.finditer(text, run.start(), run.end()))
        for i in range(0, len(parts) - 3, 4):
            yield parts[i].start(), parts[i + 3].end()


DOTTED, DIGIT_RUN = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed: the leftmost matches of each pattern, without those that fail its test."""
    if not text or not CUE.search(text):
        return []
    out = []
    for rank, kind in enumerate(KINDS):
        if kind == "email":
            found = _emails(text)
        elif kind == "ip":
            out += [(a, rank, b) for a, b in _addresses(text) if _holds(kind, text[a:b])]
            continue
        elif kind == "phone" and "+" not in text:
            continue
        else:
            found = PATTERNS[kind].finditer(text)
        out += [(m.start(), rank, m.end()) for m in found if _holds(kind, m.group())]
    return [(KINDS[rank], a, b) for a, rank, b in sorted(out)]


# Characters are classes: marks, digits and Latin letters (of either case) stay apart, all other letters are one class.
_ALPHABET = "0123456789@.-+()[]{}_%/,:=\"' \n!?#abcdefghijklmnopqrstuvwxyz"


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, 255)]


def _class_table() -> np.ndarray:
    t = np.full(256, len(_ALPHABET))
    for p in range(256):
        ch = chr(p).lower() if p < 128 else chr(p)
        t[p] = _ALPHABET.index(ch) if ch in _ALPHABET else len(_ALPHABET) + (0 if ch.isalpha() else 1 if ch.isspace() else 2)
    t[255] = len(_ALPHABET)  # and all letters beyond
    return t


_TABLE = _class_table()
N_CLASSES = len(_ALPHABET) + 3
N_TAGS = 1 + 2 * len(KINDS)


class BiLstmCrf:
    """Embeddings, an LSTM each way, tag scores and CRF transitions; plain arrays, trained by Adam."""

    def __init__(self, hidden: int = 24, embed: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.h = hidden
        self.p = {"E": draw(N_CLASSES, embed), "O": draw(2 * hidden, N_TAGS), "c": np.zeros(N_TAGS), "T": np.zeros((N_TAGS, N_TAGS))}
        for w in "fb":
            self.p |= {f"W{w}": draw(embed, 4 * hidden), f"U{w}": draw(hidden, 4 * hidden), f"b{w}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}

    def _run(self, x: np.ndarray, w: str, keep: bool = False):
        """x: (n, t) classes; the states (n, t, h) of one direction, and what its gradient needs."""
        n, t = x.shape
        h = self.h
        table = self.p["E"] @ self.p[f"W{w}"] + self.p[f"b{w}"]
        out, saved = np.zeros((n, t, h), table.dtype), []
        s, c = np.zeros((n, h), table.dtype), np.zeros((n, h), table.dtype)
        for i in range(t) if w == "f" else range(t - 1, -1, -1):
            z = table[x[:, i]] + s @ self.p[f"U{w}"]
            g = sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before, last = c, s
            c = g[:, h : 2 * h] * c + g[:, :h] * new
            tc = np.tanh(c)
            s = g[:, 2 * h :] * tc
            out[:, i] = s
            if keep:
                saved.append((i, g, new, before, last, tc))
        return out, saved

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], 2) @ self.p["O"] + self.p["c"]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag sequences, and its gradient."""
        n, t = x.shape
        f, sf = self._run(x, "f", True)
        b, sb = self._run(x, "b", True)
        both = np.concatenate([f, b], 2)
        e = both @ self.p["O"] + self.p["c"]
        trans = self.p["T"]
        # Forward and backward sums, each position's scaled to one.
        top, high = e.max(2, keepdims=True), trans.max()
        emit, move = np.exp(e - top), np.exp(trans - high)
        alpha, beta, scale = np.empty_like(emit), np.empty_like(emit), np.empty((n, t, 1), emit.dtype)
        for i in range(t):
            a = emit[:, i] if i == 0 else (alpha[:, i - 1] @ move) * emit[:, i]
            scale[:, i] = a.sum(1, keepdims=True)
            alpha[:, i] = a / scale[:, i]
        beta[:, -1] = 1
        for i in range(t - 2, -1, -1):
            beta[:, i] = (emit[:, i + 1] * beta[:, i + 1]) @ move.T / scale[:, i + 1]
        z = np.log(scale[..., 0]).sum(1) + top[..., 0].sum(1) + (t - 1) * high
        gold = np.take_along_axis(e, y[..., None], 2)[..., 0].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        de = alpha * beta
        np.put_along_axis(de, y[..., None], np.take_along_axis(de, y[..., None], 2) - 1, 2)
        de /= n
        k = e.shape[2]
        pair = move * (alpha[:, :-1].reshape(-1, k).T @ (emit * beta / scale)[:, 1:].reshape(-1, k))
        np.add.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        grad = {"T": pair / n, "O": both.reshape(-1, 2 * self.h).T @ de.reshape(-1, k), "c": de.sum((0, 1)), "E": np.zeros_like(self.p["E"])}
        dboth = de @ self.p["O"].T
        h, x_type = self.h, dboth.dtype
        for w, saved, d in (("f", sf, dboth[..., :h]), ("b", sb, dboth[..., h:])):
            every = np.zeros((t, n, 4 * h), x_type)
            du = np.zeros_like(self.p[f"U{w}"])
            ds, dc = np.zeros((n, h), x_type), np.zeros((n, h), x_type)
            for i, g, new, before, last, tc in reversed(saved):
                ds = ds + d[:, i]
                dc = dc + ds * g[:, 2 * h :] * (1 - tc * tc)
                dg = np.concatenate([dc * new, dc * before, ds * tc], 1) * g * (1 - g)
                dz = np.concatenate([dg, dc * g[:, :h] * (1 - new * new)], 1)
                every[i] = dz
                du += last.T @ dz
                ds, dc = dz @ self.p[f"U{w}"].T, dc * g[:, h : 2 * h]
            dz_of = (x.T.reshape(-1, 1) == np.arange(N_CLASSES)).astype(x_type).T @ every.reshape(-1, 4 * h)
            grad |= {f"U{w}": du, f"W{w}": self.p["E"].T @ dz_of, f"b{w}": dz_of.sum(0)}
            grad["E"] += dz_of @ self.p[f"W{w}"].T
        return float((z - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.016, seed: int = 7) -> "BiLstmCrf":
        rng, step = np.random.default_rng(seed), 0
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                for k, g in self.gradient(x[order[i : i + batch]], y[order[i : i + batch]])[1].items():
                    g = np.clip(g, -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, e: np.ndarray) -> list[int]:
        """The best tag sequence for the tag scores (t, tags) of a run."""
        return Path(self.p["T"]).feed(e).tags()


class Path:
    """A Viterbi pass that takes a run's tag scores piece by piece; a byte per character and tag stays."""

    def __init__(self, moves: np.ndarray):
        self.moves, self.best, self.back = moves, None, []

    def feed(self, e: np.ndarray) -> "Path":
        back = np.empty((len(e), len(self.moves)), np.int8)
        for i, row in enumerate(e):
            if self.best is None:
                self.best, back[i] = row, 0
                continue
            all_ = self.best[:, None] + self.moves
            back[i] = all_.argmax(0)
            self.best = all_.max(0) + row
        self.back.append(back)
        return self

    def tags(self) -> list[int]:
        out = [int(self.best.argmax())]
        for part in reversed(self.back):
            for b in part[::-1].tolist():
                out.append(b[out[-1]])
        return out[-2::-1]  # the first row leads nowhere


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        y[a:b], y[a] = 2 + 2 * k, 1 + 2 * k
    return y


def runs_near_shapes(text: str) -> list[tuple[int, int]]:
    """Stretches that hold every shape of the text with NEAR characters on either side."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)) for p in SHAPES.values() for m in p.finditer(text)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def disguised(kind: str, words: list[str], rng: random.Random) -> str:
    """A span of the kind in a form that its pattern misses, an address made of words of the text."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        word = lambda: rng.choice(words) if words else "name"
        at = rng.choice((" at ", " at ", " at ", " at ", "(at)", "[at]", " (at) ", " [at] ", " AT ", " @ ", "{at}"))
        dot = rng.choice((".", ".", ".", ".", " dot ", " dot ", "(dot)", "[dot]", " [dot] ", " DOT ")) if "@" not in at else rng.choice((" dot ", "(dot)", "."))
        local = word() + rng.choice(("", "", f"{rng.choice('._-')}{word()}", f"{rng.choice('._')}{number(2)}", number(rng.randint(1, 3))))
        return local + at + dot.join([*(word() + rng.choice(("", "", number(1))) for _ in range(rng.choice((1, 1, 2)))), rng.choice(("com", "org", "net", word()[:3], word()[:2]))])
    if kind == "ip":
        return rng.choice(("[.]", "(.)", " dot ", "[dot]", "(dot)", " [dot] ", ", ")).join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        n = rng.choice((16, 16, 16, 15, 14, 19))
        return rng.choice((".", "/", "  ", "_", " - ", ", ")).join(number(min(4, n - i)) for i in range(0, n, 4))
    head = number(rng.randint(1, 3)) if rng.random() < 0.5 else ""
    parts = [p for p in (head, number(3), number(3), number(rng.choice((3, 4, 4)))) if p]
    if rng.random() < 0.4:
        parts[-3] = f"({parts[-3]})"
    return rng.choice(("", "00")) * bool(head) + rng.choice(("-", "-", " ", ".", "/")).join(parts)


def training_windows(text: str | None, most: int = 64) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows of a text with the spans that lie in them: around base spans as they are and disguised, around other digits, and around ` at `."""
    out = []
    spans = base_spans(text)
    words = [w.lower() for w in re.findall(r"[A-Za-z]{2,12}", text or "")]
    rng = random.Random(zlib.crc32((text or "").encode("utf-8", "surrogatepass")))
    for kind, a, b in spans:
        if b - a > LESSON - 8 or len(out) >= most:
            continue
        lo = max(0, a - rng.randrange(LESSON - (b - a)))
        inside = [s for s in spans if s[1] >= lo and s[2] <= lo + LESSON]
        out.append((text[lo : lo + LESSON], [(k, x - lo, y - lo) for k, x, y in inside]))
        for _ in range(3):
            form = disguised(kind, words, rng)
            if len(form) > LESSON - 8:
                continue
            lo = max(0, a - rng.randrange(LESSON - len(form)))
            before, after = text[lo:a], text[b : lo + LESSON + (b - a)]
            if not any(s != (kind, a, b) and s[2] > lo and s[1] < lo + LESSON + (b - a) for s in spans):
                out.append((before + form + after, [(kind, a - lo, a - lo + len(form))]))
                short = "".join(DIGITS.findall(form))[:5]
                if kind in ("card", "phone") and rng.random() < 0.3:  # too few digits for a number
                    out.append((before + short + after, []))
    covered = [False] * len(text or "")
    for _, a, b in spans:
        covered[a:b] = [True] * (b - a)
    others = [m.start() for m in DIGITS.finditer(text or "") if not covered[m.start()]] + [m.start() for m in re.finditer(" at ", text or "") if not covered[m.start()]]
    for at in rng.sample(others, min(len(others), 4)):
        lo = max(0, at - rng.randrange(LESSON - 8))
        if not any(x < lo + LESSON and y > lo and not (x >= lo and y <= lo + LESSON) for _, x, y in spans):
            out.append((text[lo : lo + LESSON], [(k, x - lo, y - lo) for k, x, y in spans if x >= lo and y <= lo + LESSON]))
    return [(w[:LESSON].ljust(LESSON), [s for s in got if s[2] <= LESSON]) for w, got in out]


def fit_tagger(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_docs: int = 2500, max_windows: int = 4000, epochs: int = 12) -> BiLstmCrf | None:
    """Train on at most `max_windows` windows of at most `max_docs` documents that hold a digit or an @; None if these hold no base span."""
    cued = docs.where(F.col(text).rlike("[0-9@]"))
    few = bounded_sample(cued, cued.select(F.col(doc_id).alias("_id"), F.lit(0).alias("_y")), max_docs, text, doc_id, "tagger")

    def windows(batches):
        for b in batches:
            for t in b["_text"].to_pylist():
                got = training_windows(t)
                yield pa.RecordBatch.from_pydict({"w": pa.array([w for w, _ in got], pa.string()), "y": pa.array([tags_of(LESSON, s).tolist() for _, s in got], pa.list_(pa.int32()))})

    rows = few.mapInArrow(windows, "w string, y array<int>").orderBy(F.xxhash64("w"), "w").limit(max_windows).collect()
    if not any(any(r.y) for r in rows):
        return None
    return BiLstmCrf().fit(np.stack([char_classes(r.w) for r in rows]), np.array([r.y for r in rows]), epochs)


def tagged_spans(model: BiLstmCrf | None, texts: list[str | None], batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """The spans that the model finds in each whole text. Windows are scored in lots; of a run only its path stays."""
    out: list[list] = [[] for _ in texts]
    if model is None:
        return out
    open_run, path = None, None

    def close():
        if open_run:
            i, a, _ = open_run
            out[i] += [(k, x + a, y + a) for k, x, y in spans_of(path.tags())]

    windows = (((i, a, b), lo) for i, t in enumerate(texts) if t for a, b in runs_near_shapes(t) for lo in range(0, max(1, b - a - (WINDOW - STEP)), STEP))
    for lot in _lots(windows, batch):
        cuts = [texts[i][a + lo : min(b, a + lo + WINDOW)] for (i, a, b), lo in lot]
        scored = model.scores(np.stack([char_classes(c.ljust(WINDOW)) for c in cuts]))
        for (run, lo), cut, e in zip(lot, cuts, scored, strict=True):
            if run != open_run:
                close()
                open_run, path = run, Path(model.p["T"])
            edge = (WINDOW - STEP) // 2  # up to here the window before is as good, from there on the next
            path.feed(e[0 if lo == 0 else edge : len(cut) if run[1] + lo + WINDOW >= run[2] else edge + STEP])
    close()
    return out


def _lots(items, n: int):
    lot = []
    for x in items:
        lot.append(x)
        if len(lot) == n:
            yield lot
            lot = []
    if lot:
        yield lot


def spans_of(tags: list[int]) -> list[tuple[str, int, int]]:
    out, start, kind = [], None, None
    for i, t in enumerate([*tags, 0]):
        if start is not None and (t == 0 or t % 2 or (t - 1) // 2 != kind):
            out.append((KINDS[kind], start, i))
            start = None
        if t and start is None:
            start, kind = i, (t - 1) // 2
    return out


def plausible(kind: str, found: str) -> bool:
    """What a span of the model must fulfil, whatever separates its parts: its shape, a checksum, ranges, numbers of digits."""
    if "\n" in found:
        return False
    if kind == "email":
        return len(found) <= 128 and bool(SHAPES["email"].search(found))
    digits = "".join(DIGITS.findall(found))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and bool(SHAPES["ip"].search(found))
    if not SHAPES["number"].search(found):
        return False
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and (found[0] == "+" or len(re.findall(r"[^0-9]+", found[1:])) >= 2)


_WHOLE = re.compile(rf"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{{0,63}}(?:{AT})[A-Za-z0-9-]{{1,63}}(?:(?:{DOT})[A-Za-z0-9-]{{1,63}})+", re.I)


def snapped(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span with whole first and last parts: no outer marks or spaces, no word or number cut in two."""
    if kind == "email":
        lo, hi = max(0, a - 64), min(len(text), b + 64)
        met = max(_WHOLE.finditer(text, lo, hi), key=lambda m: min(m.end(), b) - max(m.start(), a), default=None)
        return met.span() if met and met.start() < b and met.end() > a else (a, b)
    part = DIGITS
    opens = lambda i: part.match(text, i) or (kind == "phone" and text[i] in "+(")
    while a < b and not opens(a):
        a += 1
    while b > a and not part.match(text, b - 1):
        b -= 1
    while 0 < a < b and part.match(text, a) and part.match(text, a - 1):
        a -= 1
    while a < b < len(text) and part.match(text, b):
        b += 1
    return a, b


def united(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]], text: str | None) -> list[tuple[str, int, int]]:
    """All base spans, and the model's that touch none of them (nor each other) and are plausible."""
    out = list(base)
    for kind, a, b in added:
        a, b = snapped(kind, text, a, b)
        if a < b and all(b <= x or a >= y for _, x, y in out) and plausible(kind, text[a:b]):
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_personal_data(docs: DataFrame, model: BiLstmCrf | None, text: str = "text") -> DataFrame:
    """Add base and spans (arrays of (kind, start, end), in code points, end exclusive) to every document.

    `base` are the patterns' spans; `spans` are these and the model's. Null and empty texts have none, and without
    a model both are equal. Incoming columns of these names are replaced; all others stay.
    """
    names = [c for c in docs.columns if c not in ("base", "spans")]
    src = docs.select(*[F.col(f"`{c}`") for c in names])
    held = shipped(docs.sparkSession, model)
    one = "array<struct<kind:string,start:int,end:int>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), f"base {one}, spans {one}"])
    at, names = names.index(text), [*names, "base", "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = lambda lists: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in lists], kind)

    def found(batches):
        m = held()
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts = part.column(at).to_pylist()
                base = [base_spans(t) for t in texts]
                every = [united(x, y, t) for x, y, t in zip(base, tagged_spans(m, texts), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, rows(base), rows(every)], names=names)

    return src.mapInArrow(found, schema)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _listed(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_personal_data(docs, fit_tagger(docs))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), F.size(F.array_except("spans", "base")).cast("long").alias("n_added"))
