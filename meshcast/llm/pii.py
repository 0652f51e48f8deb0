"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is written and trained in numpy from labelled spans: the matches of the fixed patterns in a bounded sample of rows, windows that hold digits
or an at sign but no match, and such windows with a made-up span set in, in a form the patterns take or in one they miss (`[at]`, spaced or bracketed dots,
other separators of digits, phones without a plus), or with a number that is none (dates, times, sums, versions). Texts are cut into runs, stretches around digits,
at signs and the words that stand for them; a run is read in overlapping windows, whose emissions are averaged, and decoded as one path. An added span must also
have the parts of its kind (`plausible`). The spans of all runs are reconciled over the whole text: best score first, without overlaps, and pattern matches always stay.

Every kind that the network learns holds one of these triggers; text farther from them than CONTEXT characters cannot belong to a span that the labels know.
"""

from __future__ import annotations

import bisect
import hashlib
import pickle
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TRIGGER = re.compile(r"[0-9@]|[\[(] ?(?:at|AT) ?[\])]")
WINDOW, OVERLAP, CONTEXT = 96, 48, 32
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
HIDDEN, EMBED = 24, 12
MARGIN = 3.0  # least log odds of an added span's path against "outside"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUADS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_ONLY_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _passes(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    digits = _ONLY_DIGITS.sub("", match)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def _emails(text: str):
    """The matches of the email pattern in linear time: each at sign with a domain behind it, and the run of local characters before it."""
    end = start = 0
    at = text.find("@")
    while at >= 0:
        start = max(start, end)
        local = len(text[start:at]) - len(text[start:at].rstrip(LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            end = domain.end()
            yield at - local, end
        start, at = at + 1, text.find("@", at + 1)


def _matches(kind: str, text: str):
    if kind == "email":
        return _emails(text)
    # A match of the ip pattern starts where a run of digits does: looking nowhere else keeps long runs linear.
    return (m.span() for m in (_QUADS if kind == "ip" else PATTERNS[kind]).finditer(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within each kind, in time linear in the text."""
    out = []
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        out += [(kind, a, b) for a, b in _matches(kind, text) if _passes(kind, text[a:b])]
    return out


_AT = re.compile(r" ?(?:@|[\[(] ?(?:at|AT) ?[\])]) ?")
_DOT = re.compile(r" ?(?:\.|[\[(] ?(?:dot|DOT|\.) ?[\])]) ?")
_CARD = re.compile(r"[0-9](?:[ ./_-]{0,3}[0-9])+")
_PHONE = re.compile(r"[+(]?[0-9](?:[ ()./-]{0,3}[0-9])+")


def plausible(kind: str, text: str) -> bool:
    """Whether an added span has the parts of its kind, separators aside."""
    if kind in ("email", "ip"):
        plain = _DOT.sub(".", _AT.sub("@", text))
        return bool(PATTERNS[kind].fullmatch(plain)) and _passes(kind, plain)
    return bool((_CARD if kind == "card" else _PHONE).fullmatch(text)) and _passes(kind, text)


_CLASS = np.full(256, 97, np.int64)
_CLASS[32:127] = np.arange(95)


def encode(text: str) -> np.ndarray:
    """Printable ASCII by character; white space, letters beyond ASCII and the rest as one class each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = _CLASS[np.minimum(codes, 255)]
    small = np.where(codes >= 128, 96, small)
    return np.where((codes >= 9) & (codes <= 13), 95, small)


def runs(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches around the triggers."""
    out: list[tuple[int, int]] = []
    start = end = -1
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if lo <= end:
            end = hi
        else:
            if start >= 0:
                out.append((start, end))
            start, end = lo, hi
    if start >= 0:
        out.append((start, end))
    return out


def cuts(lo: int, hi: int) -> list[tuple[int, int]]:
    """Overlapping windows of a run."""
    return [(a, min(a + WINDOW, hi)) for a in range(lo, max(hi - OVERLAP, lo + 1), WINDOW - OVERLAP)]


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all runs."""
    return [w for lo, hi in runs(text) for w in cuts(lo, hi)]


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """The network; weights in a dict of arrays."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        self.fitted = False
        self.w = {"emb": rng.normal(0, 0.3, (99, e)), "out": rng.normal(0, 0.2, (2 * h, TAGS)), "out_b": np.zeros(TAGS), "trans": rng.normal(0, 0.1, (TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            self.w |= {d + "x": rng.normal(0, 0.25, (e, 4 * h)), d + "h": rng.normal(0, 0.2, (h, 4 * h)), d + "b": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _lstm(self, x, d, keep):
        n, t, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        gates = x @ self.w[d + "x"] + self.w[d + "b"]
        hs, kept = np.empty((n, t, HIDDEN), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = gates[:, i] + h @ self.w[d + "h"]
            s = _sig(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            a, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            old, before = c, h
            c = f * c + a * g
            y = np.tanh(c)
            h = o * y
            hs[:, i] = h
            if keep:
                kept.append((i, a, f, o, g, old, y, before))
        return hs, kept

    def emissions(self, ids, keep=False):
        x = self.w["emb"][ids]
        hf, kf = self._lstm(x, "f", keep)
        hb, kb = self._lstm(x, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        out = both @ self.w["out"] + self.w["out_b"]
        return (out, x, both, kf, kb) if keep else out

    def _gradients(self, ids, tags):
        """Mean negative log-likelihood of the CRF and its gradients; windows padded at the end with tag 0."""
        em, x, both, kf, kb = self.emissions(ids, True)
        n, t, k = em.shape
        # Forward and backward weights of each place, scaled to a sum of one.
        step = np.exp(self.w["trans"].astype(np.float64))
        first = em[:, 0] + self.w["first"]
        e = np.exp(em.astype(np.float64) - em.max(axis=2, keepdims=True))
        alpha, beta, scale = np.empty((n, t, k)), np.ones((n, t, k)), np.empty((n, t, 1))
        alpha[:, 0] = np.exp(first - first.max(axis=1, keepdims=True))
        for i in range(t):
            if i:
                alpha[:, i] = (alpha[:, i - 1] @ step) * e[:, i]
            scale[:, i] = alpha[:, i].sum(1, keepdims=True)
            alpha[:, i] /= scale[:, i]
        for i in range(t - 2, -1, -1):
            beta[:, i] = (e[:, i + 1] * beta[:, i + 1] / scale[:, i + 1]) @ step.T
        gold = np.eye(k)[tags]
        de = ((alpha * beta - gold) / n).astype(np.float32)
        behind = (e * beta / scale)[:, 1:].reshape(-1, k)
        g = {"first": de[:, 0].sum(0), "trans": step * (alpha[:, :-1].reshape(-1, k).T @ behind) / n}
        np.add.at(g["trans"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1 / n)
        g["out"], g["out_b"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, k), de.sum((0, 1))
        dboth = de @ self.w["out"].T
        dx = np.zeros_like(x)
        for d, kept, dh_all in (("f", kf, dboth[..., :HIDDEN]), ("b", kb, dboth[..., HIDDEN:])):
            dz, hidden = np.empty((n, t, 4 * HIDDEN), np.float32), np.empty((n, t, HIDDEN), np.float32)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for i, a, f, o, c, old, y, before in reversed(kept):
                dh = dh + dh_all[:, i]
                dc = dc + dh * o * (1 - y * y)
                dz[:, i] = np.concatenate([dc * c * a * (1 - a), dc * old * f * (1 - f), dh * y * o * (1 - o), dc * a * (1 - c * c)], axis=1)
                hidden[:, i] = before
                dh, dc = dz[:, i] @ self.w[d + "h"].T, dc * f
            dx += dz @ self.w[d + "x"].T
            flat = dz.reshape(-1, 4 * HIDDEN)
            gw, gh, gb = x.reshape(-1, EMBED).T @ flat, hidden.reshape(-1, HIDDEN).T @ flat, flat.sum(0)
            g |= {d + "x": gw, d + "h": gh, d + "b": gb}
        g["emb"] = np.zeros_like(self.w["emb"])
        np.add.at(g["emb"], ids.ravel(), dx.reshape(-1, EMBED))
        return g

    def fit(self, ids, tags, steps: int = 120, batch: int = 96, rate: float = 0.02, seed: int = 7):
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(ids), min(batch, len(ids)))
            g = self._gradients(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k in self.w:
                x = (g[k] * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
                self.w[k] = self.w[k] - rate * (1 - 0.8 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
        self.fitted = True
        return self

    def run_emissions(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Emissions of whole runs of character classes: the mean over the windows that hold a character, each weighted by its distance from the window's edges."""
        todo = [(i, a, b) for i, p in enumerate(parts) for a, b in cuts(0, len(p))]
        sums, seen = [np.zeros((len(p), TAGS), np.float32) for p in parts], [np.zeros((len(p), 1), np.float32) for p in parts]
        for at in range(0, len(todo), 512):
            some = todo[at : at + 512]
            for (i, a, b), em in zip(some, self.emissions(padded([parts[i][a:b] for i, a, b in some]))):
                weight = np.minimum(np.arange(1, b - a + 1), np.arange(b - a, 0, -1))[:, None]
                sums[i][a:b] += em[: b - a] * weight
                seen[i][a:b] += weight
        return [x / n for x, n in zip(sums, seen)]

    def odds(self, em, tags, a: int, b: int) -> float:
        """The log odds of a path between a and b against one outside of all spans, with the steps into and out of it."""
        into = [(0, tags[a])] if a else []
        steps = into + list(zip(tags[a : b - 1], tags[a + 1 : b])) + ([(tags[b - 1], 0)] if b < len(tags) else [])
        trans = sum(float(self.w["trans"][x, y]) for x, y in steps) - len(steps) * float(self.w["trans"][0, 0])
        start = 0.0 if a else float(self.w["first"][tags[0]] - self.w["first"][0])
        return start + trans + float((em[np.arange(a, b), tags[a:b]] - em[a:b, 0]).sum())

    def decode(self, ems: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequence of each run by its emissions; runs of like length are decoded together, and no run's result depends on others."""
        out: list = [None] * len(ems)
        order = sorted(range(len(ems)), key=lambda i: len(ems[i]))
        while order:
            # At most 128 runs, and none more than twice as long as the first.
            n = next((j for j, i in enumerate(order) if j == 128 or len(ems[i]) > 2 * len(ems[order[0]]) + 64), len(order))
            group, order = order[:n], order[n:]
            length = np.array([len(ems[i]) for i in group])
            em = np.zeros((n, length.max(), TAGS), np.float32)
            for j, i in enumerate(group):
                em[j, : length[j]] = ems[i]
            score, back = em[:, 0] + self.w["first"], np.empty(em.shape, np.int8)
            for t in range(1, em.shape[1]):
                s = score[:, :, None] + self.w["trans"]
                live = (t < length)[:, None]
                back[:, t] = np.where(live, s.argmax(1), np.arange(TAGS))
                score = np.where(live, s.max(1) + em[:, t], score)
            tags = np.empty(em.shape[:2], np.int8)
            tags[:, -1] = score.argmax(1)
            for t in range(em.shape[1] - 1, 0, -1):
                tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
            for j, i in enumerate(group):
                out[i] = tags[j, : length[j]]
        return out


def padded(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(parts), WINDOW), 98, np.int64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def labelled(text: str) -> list[tuple[list[int], list[int]]]:
    """Windows of one text with their tags, for training."""
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in reversed(base_spans(text)):
        k = 1 + 2 * KINDS.index(kind)
        tags[a:b] = k + 1
        tags[a] = k
    codes = encode(text)
    return [(codes[a:b].tolist(), tags[a:b].tolist()) for a, b in windows(text)]


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng, low: int = 2, high: int = 9) -> str:
    return "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(low, high)))


def _pick(rng, *of):
    return of[rng.integers(len(of))]


def _card_number(rng) -> str:
    body = _digits(rng, 15)
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def made_up(rng, kind: str) -> str:
    """A span of a kind, in a form that the patterns take or one that they miss."""
    if kind == "email":
        at, dot = _pick(rng, ("@", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" @ ", "."), (" @ ", " . "), ("[at]", "[dot]"), (" AT ".join("[]").replace(" AT ", "AT"), "[DOT]"))
        name = _pick(rng, _word(rng), _word(rng) + "." + _word(rng), _word(rng) + _digits(rng, 2), _word(rng) + "_" + _word(rng))
        return name + at + _word(rng, 3, 10) + _pick(rng, "", "-" + _word(rng)) + dot + _pick(rng, "com", "org", "net", "de", "fr", "es", "io", "example")
    if kind == "ip":
        return _pick(rng, ".", ".", " . ", "[.]", "[dot]", " [.] ", "(.)", "(dot)").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        n = _card_number(rng)
        return _pick(rng, "", " ", "-", ".", "/", "  ", " - ", "_", ". ").join(n[i : i + 4] for i in range(0, 16, 4))
    plus = _pick(rng, "+", "+", "", "00", "(0)")
    sep = _pick(rng, " ", "-", ".", " ", "/")
    if plus == "(0)":
        return "(0" + _digits(rng, int(rng.integers(2, 4))) + ") " + sep.join(_digits(rng, int(rng.integers(3, 5))) for _ in range(2))
    return plus + str(rng.integers(1, 100)) + sep + sep.join(_digits(rng, int(k)) for k in rng.integers(3, 5, 3))


def no_span(rng) -> str:
    """A number or an at sign that is no personal data."""
    day = f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    clock = f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}" + _pick(rng, "", f":{rng.integers(0, 60):02d}")
    some = [str(x) for x in rng.integers(0, 1000, int(rng.integers(2, 6)))]
    return _pick(
        rng, day, day.replace("-", "/"), day.replace("-", "."), f"{day} {clock}", f"{day}T{clock}Z", clock, _digits(rng, int(rng.integers(1, 25))), f"{rng.integers(1, 1000)},{_digits(rng, 3)},{_digits(rng, 3)}.{_digits(rng, 2)}",
        f"v{rng.integers(0, 30)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}", "#" + _digits(rng, 8), "@" + _word(rng), ", ".join(some), " ".join(some), "-".join(some[:3]), f"{rng.integers(1900, 2100)}-{rng.integers(1900, 2100)}", f"{_digits(rng, 3)}.{_digits(rng, 6)}", f"{_word(rng)}-{_digits(rng, 6)}-{_word(rng)}", f"[{rng.integers(1, 99)}]",
    )


def augmented(carriers: list[np.ndarray], each: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows without a span with made-up ones set in between words: `each` of every kind, and twice as many with a number that is none."""
    rng = np.random.default_rng(seed)
    ids, tags = [], []
    for turn in range(6 * each):
        kind = (*KINDS, None, None)[turn % 6]
        codes = carriers[rng.integers(len(carriers))]
        spaces = np.flatnonzero(codes == 0)
        at = int(spaces[rng.integers(len(spaces))]) + 1 if len(spaces) else 0
        at = min(at, WINDOW // 2)
        form = encode(made_up(rng, kind) if kind else no_span(rng))
        mark = np.zeros(len(form), np.int64)
        if kind:
            mark[:] = 2 + 2 * KINDS.index(kind)
            mark[0] -= 1
        ends = encode(_pick(rng, " ", ". ", ", ", "; ", ") ")) if rng.random() < 0.9 else codes[:0]
        # Windows of longer runs may begin within a span or hold another one.
        skip = int(rng.integers(0, at + len(form))) if rng.random() < 0.4 else 0
        more = at + len(form) + len(ends)
        codes, mark = np.concatenate([codes[:at], form, ends, codes[at:]]), np.concatenate([np.zeros(at, np.int64), mark, np.zeros(WINDOW, np.int64)])
        if ids and rng.random() < 0.4:
            codes, mark = np.concatenate([codes[:more], ids[-1]]), np.concatenate([mark[:more], tags[-1]])
        ids.append(codes[skip : skip + WINDOW])
        tags.append(np.pad(mark[skip : skip + WINDOW], (0, max(0, WINDOW - len(mark[skip : skip + WINDOW])))))
    return padded(ids), np.stack(tags)


def _training(batches):
    for pdf in sliced(batches, 200):
        rows = [x for t in pdf.text for x in labelled(t)]
        if rows:  # an empty frame has no list columns
            yield pd.DataFrame({"key": [xxhash.xxh3_64_intdigest(np.asarray(r[0], np.int32).tobytes()) >> 1 for r in rows], "codes": [r[0] for r in rows], "tags": [r[1] for r in rows]})


def trained(windows_of: list[tuple], steps: int = 280, each: int = 600) -> Tagger:
    """A tagger fitted to windows (codes, tags) and to `augmented` ones of them."""
    tagger = Tagger()
    if not windows_of:
        return tagger
    ids = padded([np.asarray(c, np.int64) for c, _ in windows_of])
    tags = np.zeros_like(ids)
    for i, (_, t) in enumerate(windows_of):
        tags[i, : len(t)] = t
    carriers = [np.asarray(c, np.int64) for c, t in windows_of if not np.any(t)]
    if carriers:
        more, marks = augmented(carriers, each)
        ids, tags = np.concatenate([ids, more]), np.concatenate([tags, marks])
    return tagger.fit(ids, tags, steps=steps)


def _fitted(batches):
    """One row: the weights of a tagger fitted to all windows of the only partition."""
    tagger = trained([w for pdf in batches for w in zip(pdf.codes, pdf.tags)])
    if tagger.fitted:
        yield pd.DataFrame({"weights": [pickle.dumps(tagger.w)]})


def fit(docs: DataFrame, rows: int = 6000, most_windows: int = 4000) -> Tagger:
    """Train on the first `rows` rows by a hash of doc_id (texts up to 50,000 characters) and on `most_windows` different
    windows of them, the first by a hash of their characters, so the layout of the files makes no difference; with nothing to learn from, the tagger
    adds no spans. One task holds these windows and trains; small matrices gain nothing from the threads that it would take on the driver."""
    picked = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").where(F.length("text") <= 50_000)
    got = texts.join(F.broadcast(picked), "doc_id").mapInPandas(_training, "key long, codes array<int>, tags array<int>").dropDuplicates(["key"]).orderBy("key").limit(most_windows)
    tagger = Tagger()
    for row in got.coalesce(1).mapInPandas(_fitted, "weights binary").collect():
        tagger.w, tagger.fitted = pickle.loads(row.weights), True
    return tagger


def reconciled(base, added, length) -> list[tuple[str, int, int]]:
    """Base spans and those added spans that overlap none kept before, best first; by kind as listed, then start."""
    # What is taken, as the union of its spans: sorted starts, and the end of each.
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = list(base)
    for _, kind, a, b in sorted(added, key=lambda s: (-s[0], s[2], s[3], s[1])):
        i = bisect.bisect_left(starts, b)
        if i == 0 or ends[i - 1] <= a:
            starts.insert(i, a)
            ends.insert(i, b)
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def added_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[float, str, int, int]]]:
    """Scored spans of the network for each text."""
    out: list[list] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []
    if not tagger.fitted:
        return out

    def flush():
        ems = tagger.run_emissions([c for _, _, c in held])
        for (i, lo, _), em, tags in zip(held, ems, tagger.decode(ems)):
            for at in np.flatnonzero((tags % 2 == 1)):
                kind, end = (int(tags[at]) - 1) // 2, int(at) + 1
                while end < len(tags) and tags[end] == 2 * kind + 2:
                    end += 1
                score = tagger.odds(em, tags, int(at), end)
                if score >= MARGIN and plausible(KINDS[kind], texts[i][lo + at : lo + end]):
                    out[i].append((score, KINDS[kind], lo + int(at), lo + end))
        held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        codes = encode(text)
        for lo, hi in runs(text):
            held.append((i, lo, codes[lo:hi]))
            waiting += hi - lo
            if waiting > 100_000:
                flush()
                waiting = 0
    flush()
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find(model):
    def run(batches):
        for pdf in sliced(batches, 500):
            texts = [t or "" for t in pdf.text]
            hot = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
            added = dict(zip(hot, added_spans(model.value, [texts[i] for i in hot])))
            base = [base_spans(t) if i in added else [] for i, t in enumerate(texts)]
            spans = [reconciled(b, added[i], len(texts[i])) if i in added else b for i, b in enumerate(base)]
            count = {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS}
            yield pd.DataFrame({"doc_id": pdf.doc_id, **count, "base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b in base], "spans": [written(s) for s in spans]})

    return run


def pii_spans(docs: DataFrame, **sample) -> DataFrame:
    """Per row of `docs` (doc_id, text): counts and digest of the pattern matches, and all spans as kind:start:end in code points.

    Null and empty texts have no spans; repeated rows give repeated results; other columns are ignored; an empty table gives an
    empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **sample))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(_find(model), SCHEMA)


def redact_text(text: str, spans) -> str:
    """Replace the spans by <EMAIL>, <IP>, <CARD> or <PHONE>; of overlapping spans the union goes, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, **sample) -> DataFrame:
    """`docs` with every found span in text replaced; all other columns as they are. Null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **sample))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = texts.tolist()
        hot = [i for i, t in enumerate(out) if t is not None and TRIGGER.search(t)]
        for lo in range(0, len(hot), 500):
            part = hot[lo : lo + 500]
            for i, added in zip(part, added_spans(model.value, [out[i] for i in part])):
                out[i] = redact_text(out[i], reconciled(base_spans(out[i]), added, len(out[i])))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean(F.col("text").cast("string")))
