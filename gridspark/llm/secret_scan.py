"""Secret scans: exact base rules, and a character convolutional network over every other candidate.

The base rules find assignments, access keys and long hex runs. Candidates of the network are all runs
of at least 16 token characters and those of 12 to 15 that hold a letter and a digit, less what
overlaps a base finding: that is found already and always stays.
It reads a candidate whole, in windows of ``LENGTH`` characters that overlap by half where it is
longer, with ``CONTEXT`` characters on each side; the highest probability counts, and candidates are
added where it passes the threshold.

Training findings are generated from public credential formats and from look-alikes (identifiers, dates,
paths, numbers, pseudo-words). Calibration and threshold come from labelled findings of other formats, which the
network has not seen: the threshold is the highest that keeps ``RECALL`` of their secrets. Training is
seeded and takes seconds on the driver.

Defined results: a null text is empty and has no findings; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import text_blocks, utf8

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]{12,}")
#: Runs of so many token characters are candidates whatever they hold; shorter ones need a letter and a digit.
SURE, LEAST = 16, 12
KINDS = ("assign", "access", "hex", "model")
CONTEXT = 24
LENGTH = 64
RECALL = 0.97
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
_TOKEN_BYTES = np.zeros(256, bool)
_TOKEN_BYTES[list((string.ascii_letters + string.digits + "+/_.=-").encode())] = True


# --- the network ------------------------------------------------------------------------------

_CLASSES = np.zeros(256, np.int64)
for _i, _c in enumerate(string.ascii_lowercase + string.ascii_uppercase + string.digits + " +/_.=-:\"'\n"):
    _CLASSES[ord(_c)] = _i + 2
_CLASSES[128:] = 1
_N_CLASSES = int(_CLASSES.max()) + 1
_WIDTH = 5


def _windows(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate in windows of ``LENGTH`` characters, the last one at its end."""
    if end - start <= LENGTH:
        return [(start, end)]
    return [(a, a + LENGTH) for a in [*range(start, end - LENGTH, LENGTH // 2), end - LENGTH]]


def _encode(texts: list[bytes], starts: list[int], ends: list[int]) -> np.ndarray:
    """Class ids of (context, window, context); the window's own characters have ids of their own."""
    out = np.zeros((len(texts), 2 * CONTEXT + LENGTH), np.int64)
    for k, (t, a, z) in enumerate(zip(texts, starts, ends, strict=True)):
        left, body, right = t[max(0, a - CONTEXT) : a], t[a:z], t[z : z + CONTEXT]
        out[k, CONTEXT - len(left) : CONTEXT] = _CLASSES[np.frombuffer(left, np.uint8)]
        out[k, CONTEXT : CONTEXT + len(body)] = _CLASSES[np.frombuffer(body, np.uint8)] + _N_CLASSES
        out[k, CONTEXT + len(body) : CONTEXT + len(body) + len(right)] = _CLASSES[np.frombuffer(right, np.uint8)]
    return out


class CharNet:
    """Embedding, one convolution, mean and max pooling, logistic output; all numpy."""

    def __init__(self, seed: int = 5, embed: int = 12, filters: int = 24):
        rng = np.random.default_rng(seed)
        self.w = {
            "e": rng.normal(0, 0.3, (2 * _N_CLASSES, embed)),
            "c": rng.normal(0, 0.15, (_WIDTH * embed, filters)),
            "b": np.zeros(filters),
            "o": rng.normal(0, 0.1, 2 * filters),
            "d": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        e = self.w["e"][x]
        n = x.shape[1] - _WIDTH + 1
        cols = np.concatenate([e[:, i : i + n] for i in range(_WIDTH)], axis=2)
        z = np.maximum(cols @ self.w["c"] + self.w["b"], 0)
        top = z.argmax(1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None], 1)[:, 0], z.mean(1)], 1)
        return pooled @ self.w["o"] + self.w["d"], (x, cols, z, top, pooled, n)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) * self.scale + self.shift, -40, 40)))

    def of_candidates(self, found: list[tuple[bytes, int, int]]) -> np.ndarray:
        """The probability of each candidate (text, start, end): that of its likeliest window."""
        out = np.zeros(len(found))
        cut = [(k, t, a, z) for k, (t, start, end) in enumerate(found) for a, z in _windows(start, end)]
        for i in range(0, len(cut), 256):
            k, texts, starts, ends = zip(*cut[i : i + 256], strict=True)
            np.maximum.at(out, np.array(k), self.probability(_encode(texts, starts, ends)))
        return out

    def step(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        logit, (x, cols, z, top, pooled, n) = self.forward(x)
        g = (1 / (1 + np.exp(-logit)) - y) / len(y)
        grad = {"o": pooled.T @ g, "d": np.array([g.sum()])}
        gp = g[:, None] * self.w["o"]
        f = z.shape[2]
        gz = np.repeat(gp[:, None, f:] / n, n, 1)
        rows = np.arange(len(y))[:, None]
        gz[rows, top, np.arange(f)] += gp[:, :f]
        gz *= z > 0
        grad["c"] = np.einsum("ijk,ijl->kl", cols, gz, optimize=True)
        grad["b"] = gz.sum((0, 1))
        gc = gz @ self.w["c"].T
        ge = np.zeros_like(self.w["e"])
        d = self.w["e"].shape[1]
        for i in range(_WIDTH):
            np.add.at(ge, x[:, i : i + n].ravel(), gc[:, :, i * d : (i + 1) * d].reshape(-1, d))
        grad["e"] = ge
        state["t"] = state.get("t", 0) + 1
        for k, v in grad.items():
            m, s = state.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
            m, s = 0.9 * m + 0.1 * v, 0.999 * s + 0.001 * v * v
            state[k] = (m, s)
            self.w[k] = self.w[k] - rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(s / (1 - 0.999 ** state["t"])) + 1e-8)


_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción que ment ung sch ver keit".split()


_ONSETS = "b br ch d dr f fl g gr h j k kl l m n p pr qu r s sch sh sp st t th tr v w z".split()
_CODAS = ["", "", "", *"ch ck ft l ll m n nd ng nt r rn rt s ss st t tz x".split()]


def findings(n: int, seed: int, other: bool = False) -> list[tuple[bytes, int, int, int]]:
    """Labelled findings (text, start, end, is secret) made from public credential formats and look-alikes.

    ``other``: formats, look-alikes and surroundings that the first kind has none of.
    """
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    spoken = lambda: str(rng.choice(_ONSETS) + rng.choice(list("aeiou")) + rng.choice(_CODAS))
    syllable = lambda: str(rng.choice(_SYLLABLES)) if rng.random() < 0.5 else spoken()
    word = lambda k=3: "".join(syllable() for _ in range(rng.integers(1, k + 1)))
    long = lambda low, high: "".join(syllable() for _ in range(12))[: some(low, high)]
    some = lambda low, high: int(rng.integers(low, high))
    mixed, lower = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    if other:
        secrets = [
            lambda: "glpat-" + pick(mixed, 20), lambda: "SG." + pick(mixed, 22) + "." + pick(mixed, 43), lambda: "npm_" + pick(mixed, 36), lambda: "pk_test_" + pick(mixed, 24),
            lambda: "hvs." + pick(mixed, 24), lambda: pick(lower, some(24, 40)), lambda: pick(string.ascii_uppercase + "234567", 32), lambda: base64.urlsafe_b64encode(rng.bytes(some(16, 80))).decode(),
            lambda: pick(mixed, some(14, 20)),
        ]
        plains = [
            lambda: f"10.{some(1000, 9999)}/{word()}.{some(1, 9999)}", lambda: f"{word(4)}{word(4)}{word(4)}{word(4)}", lambda: f"{some(1, 255)}.{some(1, 255)}.{some(1, 255)}.{some(1, 255)}/{some(1, 30)}",
            lambda: f"{word().capitalize()}{word().capitalize()}{word().capitalize()}Error{some(1, 9)}", lambda: f"v{some(1, 20)}.{some(1, 20)}.{some(1, 20)}-{word()}.{some(1, 9)}", lambda: f"{word()}_{some(1990, 2030)}_{some(10, 13)}_{some(10, 29)}.csv",
            lambda: "-" * some(16, 60), lambda: f"{word(5)}-{word(5)}-{word(5)}", lambda: f"+{some(10, 99)}-{some(100, 999)}-{some(100, 999)}-{some(1000, 9999)}", lambda: "=".join(word() for _ in range(5)), lambda: f"/{word()}/{word()}/{word()}_{word()}.{word(1)}",
            lambda: long(16, 30), lambda: long(16, 20).upper() + ".", lambda: long(16, 20).capitalize() + "-" + word(),
        ]
        leads = [" use ", " bearer=", " (", " X-Auth ", " id ", " see ", " file "]
    else:
        secrets = [
            lambda: "ghp_" + pick(mixed, 36), lambda: "sk_live_" + pick(mixed, 24), lambda: "eyJ" + pick(mixed + "_-", 30) + "." + pick(mixed + "_-", 40), lambda: base64.b64encode(rng.bytes(some(18, 48))).decode(),
            lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(mixed, 24), lambda: rng.bytes(some(12, 33)).hex().upper(), lambda: "AIza" + pick(mixed + "_-", 35), lambda: pick(mixed, some(13, 48)), lambda: pick(lower, some(16, 40)),
        ]
        plains = [
            lambda: pick(string.digits, some(14, 24)), lambda: f"{word()}.{some(1, 99)}.{word()}{some(1, 99)}.example.com", lambda: f"{some(1990, 2030)}-{some(10, 13)}-{some(10, 29)}.{some(10, 24)}.{some(10, 60)}",
            lambda: "_".join(word() for _ in range(some(3, 6))) + str(some(1, 999)), lambda: "/" + "/".join(word() for _ in range(some(3, 6))) + f"/{some(1, 9999)}.html", lambda: word(8).capitalize() + word(8) + str(some(1, 99)),
            lambda: (lambda h: f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}")(rng.bytes(16).hex()), lambda: f"{word(4)}-{word(4)}-{word(4)}-{some(1, 9999)}", lambda: "+".join(str(some(100, 99999)) for _ in range(4)) + word(),
            lambda: "".join(word(4) for _ in range(5)), lambda: str(rng.choice(list("-=_."))) * some(12, 80), lambda: word() + "." * some(3, 8) + word(6), lambda: "".join(word(2).capitalize() for _ in range(some(4, 7))),
            lambda: long(16, 24), lambda: long(16, 24).upper(), lambda: long(16, 24).capitalize(),
        ]
        leads = [" key ", " Authorization: Bearer ", " export AUTH", " credential: ", ' "id": "', " pwd ", " https:"]
    out = []
    for _ in range(n):
        y = some(0, 2)
        kinds = secrets if y else plains
        body = kinds[some(0, len(kinds))]()
        while len(body) < LEAST:
            body += pick(mixed if y else string.digits, 4)
        left, right = (" ".join(word() for _ in range(some(0, 7))) for _ in range(2))
        if rng.random() < 0.3:
            left += str(rng.choice(leads))
        at = len((left + " ").encode())
        out.append((f"{left} {body} {right}".encode(), at, at + len(body.encode()), y))
    return out


@functools.lru_cache(maxsize=2)
def trained(seed: int = 5, n: int = 2400, epochs: int = 10) -> CharNet:
    """The network fitted on generated findings, Platt-scaled and thresholded on those of other formats."""
    rows = findings(n, seed)
    # one window of a long finding teaches, its first
    x = _encode(*zip(*((t, *_windows(a, z)[0]) for t, a, z, _ in rows), strict=True))
    y = np.array([r[3] for r in rows], float)
    net, state, rng = CharNet(seed), {}, np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 64):
            net.step(x[order[i : i + 64]], y[order[i : i + 64]], state, 0.01 if epoch < epochs - 2 else 0.002)
    held = findings(n // 2, seed + 1, other=True)
    truth = np.array([r[3] for r in held], float)
    p = np.clip(net.of_candidates([r[:3] for r in held]), 1e-9, 1 - 1e-9)
    logit = np.log(p / (1 - p))
    a, b = 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        a -= 0.1 * (((p - truth) * logit).mean() + 0.01 * (a - 1))
        b -= 0.1 * (p - truth).mean()
    net.scale, net.shift = float(a), float(b)
    secret = net.of_candidates([r[:3] for r in held])[truth == 1]
    net.threshold = float(np.quantile(secret, 1 - RECALL))
    return net


# --- scanning -----------------------------------------------------------------------------------


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes by the base rules; the reference form, one text at a time."""
    out = []
    if b":" in text or b"=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _runs(mask: np.ndarray, least: int) -> np.ndarray:
    """Starts of places where ``least`` consecutive bytes are set (log-many passes of AND)."""
    have, m = 1, mask
    while have < least:
        step = min(have, least - have)
        if len(m) <= step:
            return np.zeros(0, np.int64)
        m = m[:-step] & m[step:]
        have += step
    return np.flatnonzero(m)


def scan_batch(b: pa.RecordBatch, net: CharNet) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) in bytes for each row."""
    raw, offsets = utf8(b.column("text"))
    data = raw.tobytes()
    of = lambda at: np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist()
    hexed = set(of(_runs(_HEX_BYTES[raw], 24)))
    tokened = of(_runs(_TOKEN_BYTES[raw], LEAST))
    assigned = set(of(np.flatnonzero((raw == 58) | (raw == 61))))
    access = b"AKIA" in data
    spans: list[list] = [[] for _ in range(b.num_rows)]
    for k in sorted(hexed | assigned) if not access else range(b.num_rows):
        spans[k] = base_spans(data[offsets[k] : offsets[k + 1]])
    found, rows = [], []
    for k in tokened:
        text, taken = data[offsets[k] : offsets[k + 1]], spans[k]
        for m in _TOKEN.finditer(text):
            body = m.group()
            if len(body) < SURE and not (any(48 <= c <= 57 for c in body) and body.upper() != body.lower()):
                continue
            if any(s < m.end() and m.start() < e for s, _, e in taken):
                continue
            found.append((text, m.start(), m.end()))
            rows.append(k)
    for j in np.flatnonzero(net.of_candidates(found) >= net.threshold).tolist():
        spans[rows[j]].append((found[j][1], 3, found[j][2]))
    return spans


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, seed: int = 5) -> DataFrame:
    """Findings of every row of ``docs`` (doc_id, text): counts, digest of base spans, all spans in code points."""
    net = trained(seed)

    def run(batches):
        for b in text_blocks(batches, "text"):
            raw, offsets = utf8(b.column("text"))
            columns: list[list] = [[] for _ in range(5)]
            for k, found in enumerate(scan_batch(b, net)):
                if found:
                    lead = np.concatenate([[0], np.cumsum((raw[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)])
                    found = [(int(lead[s]), kind, int(lead[e])) for s, kind, e in sorted(found)]
                names = [f"{KINDS[kind]}:{s}:{e}" for s, kind, e in found]
                base = [x for x, f in zip(names, found, strict=True) if f[1] < 3]
                row = [*(sum(f[1] == kind for f in found) for kind in range(3)), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(names)]
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _OUT.types[1:], strict=True))], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op2(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
