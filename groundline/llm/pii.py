"""Personal data: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers; their spans always stay. The tagger
reads the characters themselves. It learns the kinds from base spans of a bounded sample of documents and from written
spans set into real contexts, and adds spans that the patterns miss: phone numbers without +, spelled-out @, dotted cards, and
secrets (keys and tokens that stand where one is named), which have no pattern. Its windows overlap; each character
takes its tag from the window in which it is most central, and the tags of a text are then read as one sequence, so a
span across windows is one span. A span must hold a digit, an @ or a written (at), so what is tagged is the unbroken
words around these and a margin; no span that passes its kind's check is longer than that. The check is of form only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

#: Those of the base patterns, and all that the tagger knows.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Characters of a window, of its core that counts, and documents that the tagger is fitted on at most, with the windows of one.
WINDOW, CORE, SAMPLE, SAMPLE_WINDOWS = 160, 112, 300, 8
#: Characters on both sides of the words around a digit or sign that are tagged with them.
MARGIN = 32
HIDDEN, STEPS, BATCH = 20, 280, 32
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = r"[0-9@]|[(\[](?:at|AT)[)\]]"
_TRIGGER = re.compile(TRIGGER)
_EMAIL_LIKE = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[](?:at|AT)[)\]]) ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


_SECRET = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_INSIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+/=-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group()) if m.end() - m.start() < 64 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def plausible(kind: int, span: str) -> bool:
    """The exact check that a span proposed by the tagger must pass."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        return bool(_EMAIL_LIKE.fullmatch(span))
    if kind == 1:
        parts = re.fullmatch(r"([0-9]{1,3})(?: ?\. ?([0-9]{1,3}))(?: ?\. ?([0-9]{1,3}))(?: ?\. ?([0-9]{1,3}))", span)
        return bool(parts) and all(int(p) <= 255 for p in parts.groups())
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", span)) and 14 <= len(digits) <= 19 and luhn(digits)
    if kind == 4:
        return bool(_SECRET.fullmatch(span)) and any(c.isalpha() for c in span) and len(digits) > 2
    return bool(re.fullmatch(r"\+?[0-9]{0,3}[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", span)) and 10 <= len(digits) <= 15


#: 0 other white space, then the printable ASCII characters, one class of all others, and padding.
CLASSES = 98


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where(code > 126, 96, np.maximum(code - 31, 0))


class Tagger:
    """Bidirectional LSTM over characters, a linear layer and CRF transitions. Both directions run as one batch of matrices."""

    def __init__(self, seed: int = 3, real: type = np.float32):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.2, shape).astype(real)
        self.p = {"W": small(2, CLASSES, 4 * HIDDEN), "U": small(2, HIDDEN, 4 * HIDDEN), "V": small(2 * HIDDEN, TAGS), "c": small(TAGS), "A": small(TAGS, TAGS)}
        self.p["W"][:, :, HIDDEN : 2 * HIDDEN] += 1.0  # remember at first

    def _lstm(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """(hidden states of both directions side by side, what the way back needs)."""
        n, steps = x.shape
        u, w, both = self.p["U"], self.p["W"], np.stack([x, x[:, ::-1]])
        inputs = np.stack([w[d][both[d].T] for d in (0, 1)], axis=1)  # steps, directions, rows
        h, c = np.zeros((2, n, HIDDEN), w.dtype), np.zeros((2, n, HIDDEN), w.dtype)
        out, held = np.empty((2, n, steps, HIDDEN), w.dtype), []
        for t in range(steps):
            z = inputs[t] + h @ u
            gate = 1 / (1 + np.exp(-z[..., : 3 * HIDDEN]))
            i, f, o = gate[..., :HIDDEN], gate[..., HIDDEN : 2 * HIDDEN], gate[..., 2 * HIDDEN :]
            g = np.tanh(z[..., 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                held.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[:, :, t] = h
        return np.concatenate([out[0], out[1][:, ::-1]], axis=2), held

    def _lstm_back(self, x: np.ndarray, dboth: np.ndarray, held: list) -> tuple[np.ndarray, np.ndarray]:
        both = np.stack([x, x[:, ::-1]])
        dout = np.stack([dboth[:, :, :HIDDEN], dboth[:, ::-1, HIDDEN:]])
        u, du, dzs = self.p["U"], np.zeros_like(self.p["U"]), np.empty((2, len(held), len(x), 4 * HIDDEN), dboth.dtype)
        dh, dc = np.zeros_like(dout[:, :, 0]), np.zeros_like(dout[:, :, 0])
        for t in range(len(held) - 1, -1, -1):
            h, before, i, f, o, g, tc = held[t]
            dh = dh + dout[:, :, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dzs[:, t] = dz
            du += h.transpose(0, 2, 1) @ dz
            dh, dc = dz @ u.transpose(0, 2, 1), dc * f
        dw = [np.eye(CLASSES, dtype=dz.dtype)[both[d].T.ravel()].T @ dzs[d].reshape(-1, 4 * HIDDEN) for d in (0, 1)]
        return np.stack(dw), du

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._lstm(x, False)[0] @ self.p["V"] + self.p["c"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags and its gradients."""
        both, held = self._lstm(x, True)
        e, a = both @ self.p["V"] + self.p["c"], self.p["A"]
        n, steps, _ = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)

        def lse(z: np.ndarray, axis: int) -> np.ndarray:
            top = z.max(axis, keepdims=True)
            return np.log(np.exp(z - top).sum(axis)) + np.squeeze(top, axis)

        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = e[:, t] + lse(alpha[:, t - 1][:, :, None] + a, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = lse(a + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows = np.arange(n)[:, None]
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows, np.arange(steps), y] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + a + (e + beta)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
        np.add.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        gold = e[rows, np.arange(steps), y].sum(1) + a[y[:, :-1], y[:, 1:]].sum(1)
        de /= n
        grads = {"V": np.einsum("nth,ntk->hk", both, de), "c": de.sum((0, 1)), "A": pair / n}
        grads["W"], grads["U"] = self._lstm_back(x, de @ self.p["V"].T, held)
        return float((z - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 5) -> list[float]:
        """Adam over random batches; returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for s in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            loss, grads = self.gradients(x[pick], y[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= 0.02 * (1 - 0.9 * s / steps) * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each row (Viterbi)."""
        e, a = self.emissions(x), self.p["A"]
        n, steps, _ = e.shape
        score, back = e[:, 0], np.empty((n, steps, TAGS), dtype=np.int8)
        for t in range(1, steps):
            through = score[:, :, None] + a
            back[:, t] = through.argmax(1)
            score = through.max(1) + e[:, t]
        out = np.empty((n, steps), dtype=np.int64)
        out[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out


def variants(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A written passage and the spans (start, kind, end) in it; numbers and signs that are no personal data have none."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    of = lambda letters, n: "".join(rng.choice(list(letters), n))
    word = lambda: of("abcdefghilmnoprstu", int(rng.integers(2, 9)))
    kind, way = int(rng.integers(-2, len(KINDS))), int(rng.integers(0, 4))
    if kind == 0:
        name = [f"{word()}.{num(2)}", word(), f"{word()}_{word()}", f"{word()}.{word()}"][int(rng.integers(0, 4))]
        span = f"{name}{['@', '[at]', ' @ ', '(at)'][way]}{word()}.{word()}.com"
    elif kind == 1:
        span = [".", ".", " . ", "."][way].join(str(i) for i in rng.integers(0, 256, 4))
    elif kind == 2:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        span = ["", " ", "-", "."][way].join(d[i : i + 4] for i in range(0, 16, 4))
    elif kind == 3:
        a, b, c = num(3), num(3), num(4)
        span = [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"][way]
    elif kind == 4:
        hexes, mixed_ = of("0123456789abcdef", int(rng.choice([32, 40, 64]))), of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", int(rng.integers(20, 44)))
        span, at = str(rng.choice([hexes, hexes, mixed_])), int(rng.integers(0, 20))
        span = span[:at] + "7a3" + span[at:]  # letters and digits in each
        named = str(rng.choice(["token", "secret", "api_key", "apikey", "access_key", "password", "auth token", "client_secret", "API key", "SECRET_KEY"]))
        before = named + [' = "', ": ", "=", " = '"][way]
        return before + span + ['"', "", "", "'"][way], [(len(before), 4, len(before) + len(span))]
    else:
        digest = of("0123456789abcdef", int(rng.choice([32, 40, 64])))
        other = [num(int(rng.integers(1, 9))), f"{num(4)}-{num(2)}-{num(2)}", f"version {num(1)}.{num(1)}.{num(1)}", f"{num(3)}abc{num(5)}f{num(3)}e", f"commit {digest}", f"sha1 {digest}", f"file {digest}.txt", f"{word()} {digest}"]
        return other[int(rng.integers(0, len(other)))], []
    return span, [(0, kind, len(span))]


def training_windows(texts: list[str], seed: int = 11, most: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and tags: each text's base spans, and written passages set into it, `most` of either at most.

    Which windows of a text are taken is drawn over the whole text.
    """
    rng, xs, ys = np.random.default_rng(seed), [], []

    def add(text: str, spans: list[tuple[int, int, int]], near: int) -> None:
        y = np.zeros(len(text), dtype=np.int64)
        for start, kind, end in spans:
            y[start:end] = 2 + 2 * kind
            y[start] = 1 + 2 * kind
        at = int(np.clip(near - rng.integers(0, WINDOW), 0, max(0, len(text) - WINDOW)))
        x, y = classes(text[at : at + WINDOW]), y[at : at + WINDOW]
        xs.append(np.pad(x, (0, WINDOW - len(x)), constant_values=CLASSES - 1))
        ys.append(np.pad(y, (0, WINDOW - len(y))))

    for text in texts:
        spans = base_spans(text)
        # Words with a digit or a sign that no base span holds may be secrets, so no window teaches what they are.
        unsure = [m.span() for m in _SECRET.finditer(text) if any("0" <= c <= "9" for c in m.group()) and all(e <= m.start() or m.end() <= s for s, _, e in spans)]
        triggers = [m.start() for m in _TRIGGER.finditer(text)]
        for at in sorted(rng.choice(len(triggers), min(most, len(triggers)), replace=False).tolist()) if triggers else []:
            near = triggers[at]
            lo, hi = max(0, near - WINDOW), near + WINDOW
            if all(e <= lo or hi <= s for s, e in unsure):
                add(text[lo:hi], [(max(s, lo) - lo, k, min(e, hi) - lo) for s, k, e in spans if s < hi and lo < e], near - lo)
        for _ in range(most):
            lo = int(rng.integers(0, max(1, len(text) - 2 * WINDOW)))
            part = text[lo : lo + 2 * WINDOW]
            cut = next((i + 1 for i in range(len(part) // 2, len(part)) if part[i] in " \n"), len(part))
            if any(s < lo + len(part) and lo < e for s, e in unsure):
                continue
            written, own = variants(rng)
            add(part[:cut] + written + " " + part[cut:], [*base_spans(part[:cut]), *((cut + s, k, cut + e) for s, k, e in own)], cut)
    return np.array(xs, dtype=np.int64).reshape(-1, WINDOW), np.array(ys, dtype=np.int64).reshape(-1, WINDOW)


def fit_tagger(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """A tagger fitted on windows of at most `sample` texts with a digit or an @, those of the least hashes.

    Only hashes and windows come to the driver, SAMPLE_WINDOWS of either sort for a text at most, and the texts stay
    on the executors. Rows of equal texts count once.
    """
    hashed = docs.where(F.col("text").rlike(TRIGGER)).select("text", F.xxhash64("text").alias("h"))
    known = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    cut = known[-1] if known else -(2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if h not in seen:
                    seen.add(h)
                    x, y = training_windows([text.as_py()], seed=h & (2**63 - 1))
                    yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([x.astype(np.int8).tobytes()], pa.binary()), pa.array([y.astype(np.int8).tobytes()], pa.binary())], names=["h", "x", "y"])

    rows = map_texts(hashed.where(F.col("h") <= cut).select("h", "text"), run, "h bigint, x binary, y binary").dropDuplicates(["h"]).toPandas().sort_values("h")
    tagger = Tagger()
    if len(rows):
        x, y = (np.frombuffer(b"".join(rows[c]), dtype=np.int8).astype(np.int64).reshape(-1, WINDOW) for c in "xy")
    if not len(rows) or not len(x):
        x, y = training_windows(["no text has a trigger here, so the tagger learns written spans only. " * 9] * 50)
    tagger.fit(x, y)
    return tagger


def regions(text: str) -> list[tuple[int, int]]:
    """What of a text is tagged: the unbroken words around each digit, @ or (at), one space over, and MARGIN characters on."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.end() + MARGIN <= out[-1][1]:
            continue  # the words around it are already in
        lo, hi, least = m.start(), m.end(), out[-1][1] if out else 0
        for _ in range(2):  # the word, and the next one
            lo -= lo > least and text[lo - 1] == " "
            while lo > least and text[lo - 1] in _INSIDE:
                lo -= 1
            hi += hi < len(text) and text[hi] == " "
            while hi < len(text) and text[hi] in _INSIDE:
                hi += 1
        lo, hi = max(least, lo - MARGIN), min(len(text), hi + MARGIN)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) that the tagger proposes for each text, windows reconciled, and that pass their check."""
    margin, windows = (WINDOW - CORE) // 2, []
    for number, text in enumerate(texts):
        until = 0
        for lo, hi in regions(text):
            core = max(lo, until)
            while core < hi:  # a core ends before a word rather than in it
                until = core + CORE
                while until > core + CORE // 4 and until < len(text) and text[until - 1] in _INSIDE:
                    until -= 1
                until = until if until > core + CORE // 4 else core + CORE
                windows.append((number, core, until))
                core = until
    if not windows:
        return [[] for _ in texts]
    coded = {n: np.pad(classes(texts[n]), (margin, WINDOW), constant_values=CLASSES - 1) for n in {w[0] for w in windows}}
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    open_span = None

    def close() -> None:
        nonlocal open_span
        if open_span:
            number, start, kind, end = open_span
            text = texts[number]
            while end > start and text[end - 1] in " \n,;:.-[\"'":
                end -= 1
            while start < end and text[start] in " \n,;:.-])=\"'":
                start += 1
            if KINDS[kind] == "secret":  # a secret is a whole run of letters and digits
                while start > 0 and text[start - 1] in _ALNUM:
                    start -= 1
                while end < len(text) and text[end] in _ALNUM:
                    end += 1
            if plausible(kind, text[start:end]):
                out[number].append((start, kind, end))
        open_span = None

    for first in range(0, len(windows), 1024):
        part = windows[first : first + 1024]
        tags = tagger.decode(np.stack([coded[n][c : c + WINDOW] for n, c, _ in part]))[:, margin : margin + CORE]
        for (number, core, until), row in zip(part, tags):
            row = row[: until - core]
            if open_span and (open_span[0] != number or open_span[3] != core):
                close()
            for i in np.flatnonzero(row) if not open_span else range(len(row)):
                tag, at = int(row[i]), core + int(i)
                if at >= len(texts[number]):
                    continue
                if open_span and (tag == 0 or at != open_span[3] or (tag - 1) // 2 != open_span[2] or tag % 2 == 1):
                    close()
                if tag:
                    open_span = (number, open_span[1], open_span[2], at + 1) if open_span else (number, at, (tag - 1) // 2, at + 1)
    close()
    return out


def find_pii(docs: DataFrame, tagger: Tagger, key: str = "doc_id") -> DataFrame:
    """docs(key, text) -> key, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and the digest are of the base spans; spans lists kind:start:end of all, by start, then kind (secret last). Offsets are
    code points.
    Tagger spans that overlap a base span or an earlier one are dropped. Null and empty texts have none. Repeated rows
    and null keys are rows; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    listed = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    names = [f"n_{k}" for k in BASE] + ["base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = ((0,) * len(BASE)) + (hashlib.sha256(b"").hexdigest(), "")
        for batch in batches:
            rows = [none] * batch.num_rows
            hot = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(batch.column(1), TRIGGER), False)))
            for at in range(0, len(hot), 256):
                part = hot[at : at + 256]
                texts = batch.column(1).take(pa.array(part)).to_pylist()
                for i, text, more in zip(part.tolist(), texts, tagged_spans(tagger, texts)):
                    base = base_spans(text)
                    spans, taken = list(base), sorted((a, b) for a, _, b in base)
                    for a, k, b in sorted(more):
                        if all(b <= c or d <= a for c, d in taken):
                            spans.append((a, k, b))
                            taken.append((a, b))
                    counts = tuple(sum(k == j for _, k, _ in base) for j in range(len(BASE)))
                    rows[i] = (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(spans)))
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < len(BASE) else pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", *names])

    counts = ", ".join(f"{n} bigint" for n in names[: len(BASE)])
    return map_texts(docs.select(key, "text"), run, f"key {kind}, {counts}, base_sha256 string, spans string").withColumnRenamed("key", key)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_pii(docs, fit_tagger(docs))
