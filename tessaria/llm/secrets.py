"""Operator 6, secret scans: patterns and a character convolutional network.

Patterns give the base findings, which always stay. A candidate is what a base finding found, or any other token of 8
or more characters that is no plain word: it has a digit, a sign or an inner capital, or it is a value after a colon
or an equals sign. A small network reads every candidate and the characters around it: an embedding of characters plus
a mark for those inside, one convolution, the largest response inside and the largest around, a hidden layer, a
probability.

It is trained in numpy on labelled findings of three kinds: values of base findings (secrets); findings written by
this module in many forms with their labels; and tokens of the corpus that have a harmless form by a rule (numbers,
dates, mail addresses, links, paths, identifiers made of words). Tokens of the corpus of any other form have no label
and train nothing. A value is used once and belongs to its document's part: six of ten parts train, two calibrate the
probability, two set the threshold, which is the largest that still finds the wanted share of their secrets.

All documents are searched for labelled findings; their number is bounded by the order of a hash of their values,
within each task and then over all. The trained network is some 20 kB and goes to the tasks. Every document is scanned
where it is read, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bounded_batches, carried, raw_bytes, table, word_spans

#: Kinds of findings, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYS = ("passw", "secret", "token", "apikey", "api_key")
_LEFT, _INSIDE, _RIGHT = 32, 48, 16
_WIDTH = _LEFT + _INSIDE + _RIGHT
OUTPUTS = ("doc_id", "spans", "clean_text")
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' findings: leftmost, not overlapping within a kind, sorted by start and kind."""
    low = text.lower()
    out: list[tuple[str, int, int]] = []
    if any(k in low for k in _KEYS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32] if _long(text, 32) else []
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _long(text: str, n: int) -> bool:
    starts, ends = word_spans(raw_bytes(text), SPACES)
    return bool(len(starts)) and int((ends - starts).max()) >= n


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_OUTSIDE = ~_bytes(_LETTERS + _LETTERS.upper() + "0123456789+/_.=-")
_ODD = _bytes("0123456789+/_=")
_LOWER, _UPPER, _ASSIGNS, _SKIPPED = _bytes(_LETTERS), _bytes(_LETTERS.upper()), _bytes(":="), _bytes(" \"'")


def candidates(text: str, base: list[tuple[str, int, int]], least: int = 8) -> list[tuple[int, int]]:
    """Tokens of `least` characters or more (full stops at the end left out) that are no plain words, or that stand
    after a colon or an equals sign, and that do not lie inside a base finding."""
    raw = raw_bytes(text)
    starts, ends = word_spans(raw, _OUTSIDE)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return []
    # Signs and digits, and capitals that follow a small letter (so never a token's first character).
    mark = _ODD[raw]
    mark[1:] |= _LOWER[raw[:-1]] & _UPPER[raw[1:]]
    odd = np.concatenate(([0], np.cumsum(mark)))
    assigned, at, open_ = np.zeros(len(starts), bool), starts - 1, np.ones(len(starts), bool)
    for _ in range(4):
        c = raw[np.maximum(at, 0)]
        assigned |= open_ & (at >= 0) & _ASSIGNS[c]
        open_ &= (at >= 0) & _SKIPPED[c]
        at = at - 1
    keep = assigned | (odd[ends] > odd[starts])
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return []
    if len(raw) != len(text):
        before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        starts, ends = before[starts], before[ends]
    taken = [(a, b) for _, a, b in base]
    out = []
    for x, y in zip(starts.tolist(), ends.tolist()):
        y = x + len(text[x:y].rstrip("."))
        if y - x >= least and not any(a <= x and y <= b for a, b in taken):
            out.append((x, y))
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of a candidate and its surroundings: 0 outside the text, 1 to 96 for ASCII, 97 for others; plus
    100 inside the candidate. A candidate longer than its field shows its two ends."""
    half = _INSIDE // 2
    inside = text[start:end] if end - start <= _INSIDE else text[start : start + half] + text[end - half : end]
    left, right = text[max(0, start - _LEFT) : start], text[end : end + _RIGHT]
    out = np.zeros(_WIDTH, np.int16)
    for at, s, mark in ((_LEFT - len(left), left, 0), (_LEFT, inside, 100), (_LEFT + len(inside), right, 0)):
        codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[at : at + len(codes)] = np.where((codes >= 32) & (codes < 127), codes.astype(np.int64) - 31, 97) + mark
    return out


@dataclass
class Network:
    """p: parameters; slope, shift: calibration; threshold: on the calibrated probability."""

    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1  # nothing is found before it is fitted

    def _forward(self, codes: np.ndarray) -> tuple:
        p, k = self.p, self.p["conv"].shape[0]
        inside = (codes >= 100).astype(np.float32)
        x = np.concatenate([p["embed"][codes % 100], inside[:, :, None]], axis=2)
        win = np.lib.stride_tricks.sliding_window_view(x, k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - k + 1, -1)
        c = win @ p["conv"].reshape(-1, p["conv"].shape[2]) + p["conv_b"]
        r = np.maximum(c, 0)
        mask = inside[:, k // 2 : k // 2 + r.shape[1], None]
        a, b = r * mask, r * (1 - mask)
        ia, ib = a.argmax(axis=1), b.argmax(axis=1)
        pooled = np.concatenate([a.max(axis=1), b.max(axis=1), a.sum(axis=1) / np.maximum(1, mask.sum(axis=1))], axis=1)
        h = np.maximum(pooled @ p["w1"] + p["b1"], 0)
        return codes, win, r, mask, ia, ib, pooled, h, h @ p["w2"] + p["b2"]

    def logits(self, codes: np.ndarray, step: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + step])[-1][:, 0] for i in range(0, len(codes), step)]) if len(codes) else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.shift, -30, 30)))

    def gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        codes, win, r, mask, ia, ib, pooled, h, z = self._forward(codes)
        n, f = len(codes), r.shape[2]
        dz = ((1 / (1 + np.exp(-z[:, 0])) - y) * weight / n)[:, None]
        g = {"w2": h.T @ dz, "b2": dz.sum(axis=0)}
        dh = (dz @ p["w2"].T) * (h > 0)
        g |= {"w1": pooled.T @ dh, "b1": dh.sum(axis=0)}
        dp = dh @ p["w1"].T
        dr = np.zeros_like(r)
        row, col = np.arange(n)[:, None], np.arange(f)[None, :]
        dr[row, ia, col] += dp[:, :f] * mask[row, ia, 0]
        dr[row, ib, col] += dp[:, f : 2 * f] * (1 - mask[row, ib, 0])
        dr += dp[:, None, 2 * f :] * mask / np.maximum(1, mask.sum(axis=1, keepdims=True))
        dc = dr * (r > 0)
        g |= {"conv": np.einsum("nlk,nlf->kf", win, dc).reshape(p["conv"].shape), "conv_b": dc.sum(axis=(0, 1))}
        k, e = p["conv"].shape[0], p["embed"].shape[1]
        dwin = (dc @ p["conv"].reshape(-1, f).T).reshape(n, dc.shape[1], k, e + 1)[..., :e]
        dx = np.zeros((n, codes.shape[1], e), np.float32)
        for j in range(k):
            dx[:, j : j + dc.shape[1]] += dwin[:, :, j]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], codes % 100, dx)
        return g


def new_network(seed: int, embed: int = 8, filters: int = 24, width: int = 5, hidden: int = 16) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(max(1, np.prod(s[:-1])))).astype(np.float32)
    return Network({"embed": draw(100, embed) * 3, "conv": draw(width, embed + 1, filters), "conv_b": np.zeros(filters, np.float32),
                    "w1": draw(3 * filters, hidden), "b1": np.zeros(hidden, np.float32), "w2": draw(hidden, 1), "b2": np.zeros(1, np.float32)})


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's calibration by Newton steps, with his smoothed targets."""
    pos = y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = q * (1 - q) + 1e-6
        grad = np.array([((q - target) * z).sum(), (q - target).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return float(max(a, 1e-3)), float(b)


def train(codes: np.ndarray, y: np.ndarray, part: np.ndarray, recall: float = 0.95, rounds: int = 8, batch: int = 64, rate: float = 3e-3, seed: int = 5) -> Network:
    """Adam on the findings of parts 0 to 5, calibration on 6 and 7, the threshold on 8 and 9. Classes weigh alike
    while training. Without both classes to train on and to calibrate with, nothing is ever found."""
    net = new_network(seed)
    learn, tune, last = (np.flatnonzero(np.isin(part, p)) for p in ((0, 1, 2, 3, 4, 5), (6, 7), (8, 9)))
    if len(np.unique(y[learn])) < 2 or len(np.unique(y[tune])) < 2 or not y[last].any():
        return net
    weight = np.where(y == 1, 0.5 / y[learn].mean(), 0.5 / (1 - y[learn].mean()))
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    rng, t = np.random.default_rng(seed), 0
    for _ in range(rounds):
        order = rng.permutation(learn)
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            t += 1
            for k, g in net.gradients(codes[rows], y[rows], weight[rows]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net.slope, net.shift = _calibrate(net.logits(codes[tune]), y[tune])
    scores = np.sort(net.probability(codes[last][y[last] == 1]))
    net.threshold = float(scores[int(np.floor((1 - recall) * len(scores)))])
    return net


# ---- labelled findings ------------------------------------------------------------------------------------------------

#: Forms that are no secrets: numbers with signs, dates and times, versions, words joined by signs, file names.
_HARMLESS = re.compile(r"[0-9.,+/=-]+|[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}(T[0-9.]+Z?)?|v?[0-9]+(\.[0-9]+){1,3}(-?[a-z]+[0-9]*)?|/?[A-Za-z]+([_./+=-][A-Za-z]+)*[.]?[0-9]{0,2}|([A-Z]?[a-z]+[0-9]{0,2}[/_.-])*[A-Z]?[a-z]+[0-9]{0,2}\.[a-z]{2,5}")


def harmless(text: str, start: int, end: int) -> bool:
    """Whether a candidate has a harmless form, or is part of a mail address or a link."""
    around = text[max(0, start - 3) : start], text[end : end + 1]
    return around[0].endswith("@") or around[1] == "@" or around[0] == "://" or text[start:end].lower().startswith("www.") or bool(_HARMLESS.fullmatch(text[start:end]))


def written_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """n secrets and n harmless tokens (text, start, end, label) in surroundings written here."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, lo, hi: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=int(rng.integers(lo, hi))))
    up, digits, hexa = _LETTERS.upper(), "0123456789", "0123456789abcdef"
    word = lambda: "".join(pick("bcdfghjklmnprstvwz") + pick("aeiou") + pick(["", "", "n", "r", "s"]) for _ in range(int(rng.integers(1, 5))))
    some = lambda lo, hi, by=" ": by.join(word() for _ in range(int(rng.integers(lo, hi))))
    coded = lambda lo, hi: base64.b64encode(rng.bytes(int(rng.integers(lo, hi)))).decode()

    def secret() -> str:
        return pick([
            lambda: chars(_LETTERS + up + digits, 16, 48), lambda: coded(12, 48), lambda: coded(12, 48).rstrip("=").replace("+", "-").replace("/", "_"),
            lambda: chars(up + digits, 16, 40), lambda: chars(_LETTERS + digits, 20, 40), lambda: chars(hexa, 20, 64), lambda: chars(hexa.upper(), 24, 64),
            lambda: chars(_LETTERS, 2, 5) + pick("_-") + chars(_LETTERS + up + digits, 20, 44), lambda: f"{chars(_LETTERS, 2, 4)}_{pick(['live', 'test', 'prod', 'pat'])}_{chars(_LETTERS + up + digits, 16, 40)}",
            lambda: ".".join(coded(a, 60).rstrip("=").replace("+", "-").replace("/", "_") for a in (15, 30, 24)), lambda: word().capitalize() + chars(digits + "_+=-", 3, 6) + chars(_LETTERS + up + digits, 3, 8),
        ])()

    def plain() -> str:
        year, month = int(rng.integers(1950, 2040)), int(rng.integers(1, 13))
        return pick([
            lambda: f"{year}-{month:02}-{int(rng.integers(1, 29)):02}", lambda: f"{year}-{month:02}-{int(rng.integers(1, 29)):02}T{chars(digits, 2, 3)}", lambda: chars(digits, 8, 20), lambda: "-".join(chars(digits, 3, 5) for _ in range(4)),
            lambda: "+" + chars(digits, 2, 3) + "-" + chars(digits, 3, 4) + "-" + chars(digits, 5, 8), lambda: f"{word()}.{word()}{chars(digits, 0, 3)}", lambda: f"{word()}/{word()}/{word()}.{pick(['html', 'py', 'csv', 'txt'])}",
            lambda: f"v{chars(digits, 1, 3)}.{chars(digits, 1, 3)}.{chars(digits, 1, 3)}-{word()}", lambda: some(2, 5, "_"), lambda: some(2, 5, "-"), lambda: word() + "".join(word().capitalize() for _ in range(int(rng.integers(1, 4)))),
            lambda: f"{some(1, 3, '')}{chars(digits, 1, 4)}", lambda: f"{chars(up, 2, 4)}-{chars(digits, 4, 9)}", lambda: ".".join(chars(digits, 1, 4) for _ in range(4)), lambda: f"{word()}={chars(digits, 1, 5)}", lambda: some(3, 5, ""), lambda: f"www.{some(1, 3, '')}.{pick(['com', 'org', 'de'])}",
        ])()

    keys = ["pwd", "pass", "auth", "credential", "bearer", "private_key", "access_key", "client_key", "signing key", "key", "login", "x-auth", "db_pass", "passphrase"]
    labels = ["note", "see", "file", "date", "version", "phone", "order", "id", "name", "page", "host", "path", "class", "total"]
    out: list[tuple[str, int, int, int]] = []
    while len(out) < 2 * n:
        label = 1 - len(out) % 2
        value = secret() if label else plain()
        if len(value) < 8:
            continue
        key = pick(keys) if label or rng.random() < 0.1 else pick(labels)
        left = pick([lambda: f"{some(2, 7)} ", lambda: f"{some(2, 6)} {key}: ", lambda: f'{some(1, 5)}\n{key} = "', lambda: f"{key}: ", lambda: f"{some(1, 5)} {key} is ", lambda: f"{some(1, 3)} {key}='", lambda: "", lambda: f"{some(2, 5)}, "])()
        if not label and rng.random() < 0.15:
            left = f"{some(2, 6)} {pick(['https://', word() + '@', 'http://'])}"
        right = pick([lambda: f" {some(1, 4)}", lambda: f'"\n{some(1, 3)}', lambda: "", lambda: f", {some(1, 3)}", lambda: f". {some(1, 3)}", lambda: "\n"])()
        out.append((left + value + right, len(left), len(left) + len(value), label))
    return out


def _hash(value: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _findings(seed: int, most: int):
    """Of each task the labelled findings whose values have the `most` smallest hashes of either label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, tuple]] = [{}, {}]
        bound = [1 << 63, 1 << 63]

        def put(doc, text: str, a: int, b: int, label: int) -> None:
            h = _hash(text[a:b], seed)
            if h < bound[label]:
                one = (doc if doc is not None else -1, encode(text, a, b).tobytes())
                best[label][h] = min(one, best[label].get(h, one))
                if len(best[label]) >= 2 * most:
                    best[label] = dict(sorted(best[label].items())[:most])
                    bound[label] = max(best[label])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                for kind, a, b in base:
                    put(doc, text, value_start(text, kind, a, b), b, 1)
                for a, b in candidates(text, base):
                    if harmless(text, a, b):
                        put(doc, text, a, b, 0)
        rows = [(label, h, *x) for label in (0, 1) for h, x in sorted(best[label].items())[:most]]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) if rows else [[]] * 4, kinds)], names=["label", "h", "doc_id", "codes"])

    return run


def value_start(text: str, kind: str, start: int, end: int) -> int:
    """Where the secret value of a base finding starts: an assignment's follows its key word."""
    return end - len(_ASSIGN.match(text, start)[1]) if kind == "assign" else start


def labelled(docs: DataFrame, findings: int = 1000, written: int = 1000, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, labels, parts) of at most `findings` labelled findings of either class of the corpus and `written` of
    either class that are written here."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_findings(seed, findings), "label int, h long, doc_id long, codes binary")
    found = found.groupBy("label", "h").agg(F.min(F.struct("doc_id", "codes")).alias("x"))
    rows = [r for y in (0, 1) for r in found.filter(F.col("label") == y).orderBy("h").limit(findings).select("label", "x.doc_id", "x.codes").collect()]
    made = [(np.frombuffer(r["codes"], np.int16), r["label"], _hash(str(r["doc_id"]), seed) % 10) for r in rows]
    made += [(encode(t, a, b), y, i // 2 % 10) for i, (t, a, b, y) in enumerate(written_findings(written, seed))]
    return np.array([x[0] for x in made]).reshape(-1, _WIDTH), np.array([x[1] for x in made], np.float64), np.array([x[2] for x in made])


def fit(docs: DataFrame, findings: int = 1000, written: int = 1000, recall: float = 0.95, seed: int = 5) -> Network:
    """Trains on at most `findings` labelled findings of either class of the corpus and `written` ones of either class."""
    return train(*labelled(docs, findings, written, seed), recall=recall, seed=seed)


def _scan(shared, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            base = [base_spans(t) for t in texts]
            open_ = [candidates(t, b) for t, b in zip(texts, base)]
            codes = [encode(t, a, b) for t, f, c in zip(texts, base, open_) for a, b in [(value_start(t, *x), x[2]) for x in f] + c]
            scores = iter(net.probability(np.array(codes).reshape(-1, _WIDTH)).tolist())
            spans, clean = [], []
            for t, found, c in zip(texts, base, open_):
                all_ = [{"kind": k, "start": a, "end": b, "score": next(scores)} for k, a, b in found]
                all_ += [{"kind": "learned", "start": a, "end": b, "score": s} for (a, b), s in zip(c, scores) if s >= net.threshold]
                all_.sort(key=lambda x: (x["start"], KINDS.index(x["kind"])))
                spans.append(all_)
                clean.append(_masked(t, all_) if with_text else None)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            out, names = [batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"]
            if with_text:
                out, names = out + [pa.array(clean, pa.string())], names + ["clean_text"]
            yield pa.RecordBatch.from_arrays(out + batch.columns[2:], names=names + batch.schema.names[2:])

    return run


def _masked(text: str, spans: list[dict]) -> str:
    """The text with every span (overlapping ones as one) replaced by <secret>; assignments keep their key word."""
    out, at = [], 0
    for s in spans:
        start = s["start"]
        if start >= at:
            start = value_start(text, s["kind"], start, s["end"])
        if start < at:
            at = max(at, s["end"])
            continue
        out += [text[at:start], "<secret>"]
        at = s["end"]
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end in code points, score), clean_text if asked for, and
    the columns to carry.

    docs needs doc_id and text; null text counts as empty and has no spans. Base findings have the kinds assign,
    access and hex and the score 1; candidates that the network takes for secrets have the kind learned. Spans are
    sorted by start, then kind; spans of different kinds may overlap. Whole texts are scanned. A carried column named
    like an output comes out with `_carried` after its name. Repeated rows get equal
    spans; an empty table gives an empty result.
    """
    net = fit(bounded_batches(docs), **options)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_scanned"), *carried(carry, OUTPUTS))
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(_scan(shared, with_text), f"doc_id long, spans {SPAN}" + ", clean_text string" * with_text + extra)


def _listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


QUERIES = {"op6_secret_scans": op6_secret_scans}
ORACLE = {}
