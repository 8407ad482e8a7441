"""Personal data: base patterns and boosted trees over overlapping candidate spans.

Base spans (leftmost, non-overlapping per kind; matches that fail their check are dropped) always stay. High-recall
generators propose further, overlapping spans: obfuscated addresses, dotted quads with brackets or spaces, and every
sequence of neighbouring digit groups with a fitting number of digits, with any separators, with or without a plus sign. Gradient-boosted trees (logistic loss, one model per kind) score a
candidate by its format (digits, groups, separators, checks) and its context (neighbouring characters and words);
the scores are calibrated on held-out candidates and a kind's threshold is the lowest score that keeps the wanted
precision there. Selected candidates that do not overlap a base span or a better candidate are added.

There are no labels for personal data: positives are base spans in the texts and rewritten forms of them (other
separators, no plus sign, spelled-out at and dot) put back into their context; negatives are the remaining candidates
(parts of a positive among them) and strings of other meaning put into the same contexts: numbers that fail the checks,
dates, versions, order numbers. The fit uses ``FIT_TEXTS`` sampled texts of ``FIT_CHARS`` characters at most; the sample is
drawn by a hash of the text, so it does not depend on files or partitions.

All patterns take time in proportion to the text, also for long runs of digits, letters or signs.

Offsets are code points, ends exclusive. Edge cases: null text is empty; empty text has no spans; repeated rows give
equal rows; without any base span in the sample nothing is added; texts of any length are processed whole; other columns
pass through ``with_spans``, a column named pii is replaced.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

KINDS = ("email", "ip", "card", "phone")
FIT_TEXTS = 4_000
PRECISION = 0.98
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32
SEED = 11

# The base patterns of the contract.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive and only at the begin of a run of digits: no other place inside a run can begin a leftmost match
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Generators of candidates.
SPELLED = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\}|\s@|@\s|\sat\s)\s?"
                     r"[A-Za-z0-9-]++(?:\s?(?:\(dot\)|\[dot\]|\sdot\s|\.)\s?[A-Za-z0-9-]++)+", re.I)  # behind the local part
QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|\sdot\s)\s?[0-9]{1,3}){3}(?![0-9])")
GROUPS = re.compile(r"[+(]?[0-9](?:[\x20().\-/_‐-― ]{0,3}[0-9]){6,}")
DIGITS = re.compile(r"[0-9]+")
MOST_GROUPS = 8  # groups of digits in one candidate
WORDS_NEAR = 24  # characters of context on either side
FIT_CHARS = 1 << 14  # longer texts are not sampled for the fit

# Words that often stand next to personal data.
CUES = {"phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "sms"),
        "card": ("card", "visa", "mastercard", "credit", "debit", "iban", "account", "amex"),
        "ip": ("ip", "host", "server", "address", "ping", "addr"),
        "email": ("mail", "email", "e-mail", "contact", "write", "reach")}
AGAINST = ("version", "token", "key", "isbn", "order", "page", "year", "license", "licence", "hash", "id", "number")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans as (kind, start, end), by kind as listed, then start."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        m = EMAIL_DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """High-recall spans. Every sequence of up to ``MOST_GROUPS`` neighbouring groups of digits with a fitting number of
    digits is proposed, so the spans overlap; one sequence may be proposed as several kinds."""
    out = set()
    low = text.lower() if ("@" in text or "at" in text) else ""
    if "@" in low or "(at)" in low or "[at]" in low or "{at}" in low or (" at " in low and "dot" in low):
        end = 0
        for m in SPELLED.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.add(("email", start, m.end()))
            end = m.end()
    for m in QUAD.finditer(text):
        out.add(("ip", m.start(), m.end()))
    for m in GROUPS.finditer(text):
        groups = [(g.start(), g.end()) for g in DIGITS.finditer(text, m.start(), m.end())]
        last = len(groups)
        for i in range(last):
            start, n = groups[i][0], 0
            if start > m.start() and text[start - 1] in "+(":
                start -= 2 if start > 1 and text[start - 2:start] == "+(" else 1
            for a, b in groups[i:i + MOST_GROUPS]:
                n += b - a
                if n > 19:
                    break
                if 7 <= n <= 15:
                    out.add(("phone", start, b))
                if 12 <= n:
                    out.add(("card", start, b))
        n = sum(b - a for a, b in groups) if MOST_GROUPS < last <= 19 else 0  # one number cut very small
        if 7 <= n <= 15:
            out.add(("phone", m.start(), m.end()))
        if 12 <= n <= 19:
            out.add(("card", m.start(), m.end()))
    return sorted(out)


def span_features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    s = text[start:end]
    digits = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    before, after = text[max(0, start - WORDS_NEAR):start], text[end:end + WORDS_NEAR]
    words = re.findall(r"[a-z-]+", before.lower())
    near = words[-3:] + re.findall(r"[a-z-]+", after.lower())[:2]
    parts = re.findall(r"[0-9]+", s)
    return [
        len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        float(luhn(digits)) if digits else 0.0,
        float(len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)),
        s.count(" "), s.count("-"), s.count("."), s.count("("), s.count("/") + s.count("_"),
        float(s[:1] == "0"), float(digits[:2] in ("19", "20")), len(set(digits)) / max(1, len(digits)),
        sum(c.isalpha() for c in s), float("dot" in s.lower()), float("at" in s.lower()),
        float(before[-1:].isalnum() or before[-1:] in ("_", "\"", "#", "=")), float(after[:1].isalnum() or after[:1] in
                                                                                     ("_", "\"", "%")),
        float(before[-1:] in (".", "-", "/", ":")), float(after[:2].strip()[:1] in ("-", "/", ":")),
        float(any(w in CUES[kind] for w in near)), float(any(w in AGAINST for w in near)),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        float("\n" in before[-2:]), float("|" in before or "|" in after),
    ]


N_FEATURES = 28


def rewritten(kind: str, s: str, rng) -> str:
    """Another way to write a base match."""
    digits = _digits(s)
    sep = str(rng.choice([" ", "-", ".", ""]))
    if kind == "email":
        at, dot = (str(rng.choice(x)) for x in ((" at ", " (at) ", "[at]", " @ "), (" dot ", "[dot]", ".", " . ")))
        local, domain = s.rsplit("@", 1)
        if rng.random() < 0.5:  # other names, of any length: what counts is the form
            name = lambda n: "".join(map(str, rng.choice(list("aeiorstnlmkbdgp"), n)))
            local = name(rng.integers(2, 10)) + str(rng.choice(["", ".", "_"])) + str(rng.choice(["", "7", "42", "1985"]))
            local = local.rstrip("._")
            domain = name(rng.integers(3, 10)) + "." + domain.rsplit(".", 1)[1]
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return s.replace(".", str(rng.choice(["[.]", " . ", " dot ", "."])))
    if kind == "card":
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    shape = rng.integers(3)
    if shape == 0:
        return f"({local[:3]}) {local[3:6]}{sep or '-'}{local[6:]}"
    if shape == 1:
        return sep.join(x for x in (local[:3], local[3:6], local[6:]) if x)
    return "00" + digits[:2] + " " + (sep or " ").join(x for x in (digits[2:5], digits[5:8], digits[8:]) if x)


def unrelated(kind: str, rng) -> str:
    """A string the generators propose that is no personal data: dates, numbers, versions, run-on sentences."""
    n = lambda a, b: int(rng.integers(a, b))
    words = [str(w) for w in rng.choice(["the", "house", "then", "train", "noon", "time", "market", "end"], 3)]
    if kind == "email":
        return (f"{words[0]} at {words[1]}.{words[2].title()}", f"{words[0]} @ {n(1, 99)}.{n(10, 99)}")[n(0, 2)]
    if kind == "ip":
        return (f"{n(1, 9)}.{n(0, 9)}.{n(0, 9)}.{n(256, 999)}", f"{n(256, 999)}.{n(0, 999)}.{n(0, 999)}.{n(0, 999)}",
                f"{n(1, 20)} . {n(300, 999)} . {n(1, 20)} . {n(1, 20)}")[n(0, 3)]
    if kind == "card":
        return str(rng.choice(["", "id ", "order ", "key "])) + "".join(str(n(0, 10)) for _ in range(n(12, 20)))
    return (f"{n(1900, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 29):02d}.{n(1, 13):02d}.{n(1900, 2030)}",
            f"{n(1, 29)}/{n(1, 13):02d}/{n(1900, 2030)}", f"{n(1900, 2000)}-{n(2000, 2030)}",
            f"{rng.choice(['order', 'id', 'page', 'isbn', 'number', 'key'])} {n(10**6, 10**9)}",
            f"{n(1, 999)} {n(100, 999)} {n(100, 999)}.{n(10, 99)}", f"{n(10**6, 10**12)}")[n(0, 7)]


# ---------------------------------------------------------------- gradient-boosted trees

def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Boosted regression trees for the logistic loss on binned features: complete trees of equal depth."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    f = np.full(len(y), base)
    model = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p) + 1e-6
        node = np.zeros(len(y), np.int64)
        splits = []
        for level in range(depth):
            nodes = 1 << level
            best_gain, best = np.full(nodes, 1e-9), np.zeros((nodes, 2), np.int64)
            best[:, 1] = BINS  # no split: all rows go left
            for j in range(x.shape[1]):
                key = node * (BINS + 1) + binned[:, j]
                gs = np.bincount(key, g, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                hs = np.bincount(key, h, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl)**2 / (ht - hl + 1) - gt**2 / (ht + 1)
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                better = top > best_gain
                best_gain[better] = top[better]
                best[better, 0], best[better, 1] = j, at[better]
            splits.append(best)
            node = node * 2 + (binned[np.arange(len(y)), best[node, 0]] > best[node, 1])
        leaves = 1 << depth
        value = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        f += value[node]
        model.append((splits, value))
    return {"edges": edges, "base": base, "trees": model}


def tree_scores(model: dict, x: np.ndarray) -> np.ndarray:
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(model["edges"], x.T, strict=True)], axis=1)
    f = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for splits, value in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for best in splits:
            node = node * 2 + (binned[rows, best[node, 0]] > best[node, 1])
        f += value[node]
    return f


def training_rows(texts: list[str], seed: int = SEED) -> dict:
    """Per kind: features, labels (base or rewritten span, or neither) of candidates in ``texts``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = {k: ([], []) for k in KINDS}

    def learn(text, positive, only=None):
        for kind, a, b in candidates(text):
            if only and not (a < only[1] and only[0] < b):
                continue
            hit = any(k == kind and min(b, e) - max(a, s) >= 0.9 * max(e - s, b - a) for k, s, e in positive)
            rows[kind][0].append(span_features(text, kind, a, b))
            rows[kind][1].append(float(hit))

    for text in texts:
        spans = base_spans(text)
        learn(text, spans)
        for kind, a, b in spans:
            left, right = text[max(0, a - 2 * WORDS_NEAR):a], text[b:b + 2 * WORDS_NEAR]
            for _ in range(2):
                s = rewritten(kind, text[a:b], rng)
                learn(left + s + right, [(kind, len(left), len(left) + len(s))], (len(left), len(left) + len(s)))
            for _ in range(2):
                s = unrelated(kind, rng)
                learn(left + s + right, [], (len(left), len(left) + len(s)))
            if kind == "card":  # the same digits out of order: a number that fails its check
                d = _digits(text[a:b])
                for _ in range(4):
                    mixed = "".join(rng.permutation(list(d)))
                    if not luhn(mixed):
                        learn(left + mixed + right, [], (len(left), len(left) + len(mixed)))
    return rows


def fit_texts(texts: list[str], seed: int = SEED) -> dict:
    """Trees, calibration and threshold per kind; kinds without both classes are left out."""
    model = {}
    rng = np.random.Generator(np.random.PCG64(seed))
    for kind, (x, y) in training_rows(texts, seed).items():
        x, y = np.array(x, float).reshape(len(x), N_FEATURES), np.array(y)
        if y.sum() < 20 or (1 - y).sum() < 5:
            continue
        part = rng.random(len(y)) < 0.7
        if not (0 < y[~part].sum() < len(y[~part])) or not (0 < y[part].sum() < len(y[part])):
            continue
        trees = fit_trees(x[part], y[part])
        f = tree_scores(trees, x[~part])
        slope, offset = _platt(f, y[~part])
        p = 1 / (1 + np.exp(-(slope * f + offset)))
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[~part][order])
        precise = np.flatnonzero(right / np.arange(1, len(p) + 1) >= PRECISION)
        if len(precise):
            lowest = p[order][precise[-1]]  # the threshold lies half-way to the next lower score
            below = p[order][min(precise[-1] + 1, len(p) - 1)] if precise[-1] + 1 < len(p) else 0.0
            model[kind] = {"trees": trees, "slope": slope, "offset": offset,
                           "threshold": float(np.clip((lowest + below) / 2, 0.5, 0.95))}
    return model


def _platt(f, y):
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g = np.array([((p - y) * f).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        w = p * (1 - p)
        h = np.array([[(w * f * f).sum() + 1e-2, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def all_spans(text: str, model: dict) -> tuple[list, list]:
    """(base spans, all spans) of one text; all spans by kind as listed, then start."""
    base = base_spans(text)
    if not model:
        return base, base
    open_ = [c for c in candidates(text) if c[0] in model
             and not any(a < c[2] and c[1] < b for _, a, b in base)]
    scored = []
    for kind in {c[0] for c in open_}:
        own = [c for c in open_ if c[0] == kind]
        m = model[kind]
        f = tree_scores(m["trees"], np.array([span_features(text, *c) for c in own], float))
        p = 1 / (1 + np.exp(-(m["slope"] * f + m["offset"])))
        scored += [(-score, c) for score, c in zip(p.tolist(), own, strict=True) if score >= m["threshold"]]
    chosen: list = []
    for _, c in sorted(scored):
        if not any(a < c[2] and c[1] < b for _, a, b in chosen):
            chosen.append(c)
    return base, sorted(base + chosen, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))


def _may_hold(column: pa.Array) -> np.ndarray:
    """Rows with a digit, an @ or a spelled-out at: no others have base spans or candidates."""
    out = np.zeros(len(column), bool)
    signs = np.zeros(256, bool)
    signs[[*range(48, 58), 64]] = True
    for lo, hi in K.row_slices(column):
        buf, off = K.string_bytes(column.slice(lo, hi - lo))
        hits = np.concatenate([[0], np.cumsum(signs[buf])])
        out[lo:hi] = hits[off[1:]] > hits[off[:-1]]
        raw = buf.tobytes().lower()
        for mark in (b"(at)", b"[at]", b"{at}", b"dot"):
            at = raw.find(mark)
            while at >= 0:
                r = int(np.searchsorted(off, at, side="right")) - 1
                out[lo + r] = True
                at = raw.find(mark, int(off[r + 1]))
    return out


def fit(docs: DataFrame, texts: int = FIT_TEXTS) -> dict:
    """Fit on at most ``texts`` different texts of up to ``FIT_CHARS`` characters that hold a base span or a candidate."""
    def task(batches):
        seen = set()  # a task sends a text once, so copies do not crowd the sample
        for batch in batches:
            column = batch.column(0)
            may = np.flatnonzero(_may_hold(column))
            keep = []
            for i in may.tolist():
                t = column[i].as_py()
                if t and (t_hash := hash(t)) not in seen and (base_spans(t) or candidates(t)):
                    seen.add(t_hash)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([column.take(pa.array(keep, pa.int64()))], names=["text"])

    total = docs.count()
    share = min(1.0, 12 * texts / max(1, total))  # personal data is rare: look at more rows than are kept
    # chosen and ordered by a hash of the text: the same corpus gives the same sample in any files and partitions
    place = F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 30))
    some = docs.select("text").where(F.length("text") <= FIT_CHARS).where(place < int(share * (1 << 30)))
    rows = some.mapInArrow(task, "text string").withColumn("cut", F.xxhash64("text")).orderBy("cut", "text").limit(texts)
    return fit_texts(list(dict.fromkeys(r.text for r in rows.collect())))


RESULT_TYPE = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
               "redacted string")


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are replaced together."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda c: (c[1], -c[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def with_spans(docs: DataFrame, model: dict, redacted: bool = True) -> DataFrame:
    """``docs`` with column ``pii``: a struct of RESULT_TYPE (``redacted`` only on request)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = f"struct<{', '.join(f.replace(' ', ': ') for f in RESULT_TYPE.split(', ') if redacted or 'redacted' not in f)}>"

    @F.arrow_udf(kind)
    def find(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        n = len(column)
        counts = {k: np.zeros(n, np.int64) for k in KINDS}
        nothing = hashlib.sha256(b"").hexdigest()
        digest, joined = [nothing] * n, [""] * n
        clean = column.to_pylist() if redacted else None
        for i in np.flatnonzero(_may_hold(column)).tolist():
            text = column[i].as_py()
            base, every = all_spans(text, shared.value)
            for k, _, _ in base:
                counts[k][i] += 1
            digest[i], joined[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)
            if redacted:
                clean[i] = redact(text, every)
        arrays = [pa.array(counts[k]) for k in KINDS] + [pa.array(digest), pa.array(joined)]
        names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
        if redacted:
            arrays, names = [*arrays, pa.array(clean, pa.string())], [*names, "redacted"]
        return pa.StructArray.from_arrays(arrays, names)

    return docs.withColumn("pii", find(F.coalesce("text", F.lit(""))))
