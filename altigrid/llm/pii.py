"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay. Looser patterns propose more candidates. Four
labelers (strict pattern, gazetteer, context, shape) vote for, against or not at all on every
candidate. Votes and discretised features are counted over the whole corpus as patterns, whose number
is bounded by the vote and feature values; expectation-maximisation over these counts estimates each
labeler's reliability, and its posteriors train a logistic span classifier, which decides on what the
strict patterns do not cover. Nothing of a text reaches the driver.

Defined results: a null text is empty; spans are code points, end exclusive; an added span never
overlaps a base span. A secret of any length is one value: where it holds base spans, it is judged as a
whole and added as the stretches between them. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
VOTERS = 4
ACCEPT = 0.6

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_AT = re.compile(r"[ \[(]at[ \])]")
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]+)+")
EDGE = re.compile(r"\b")
LOOSE_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
SECRET = re.compile(r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.=-]{8,})", re.I)
SECRET_WORDS = ("passw", "pwd", "token", "secret", "api", "access")

# Gazetteers: fixed values.
TOP_LEVEL = frozenset("com org net edu gov io info de fr es uk eu it nl ch at us ca au jp cn in br example test".split())
CARD_PREFIX = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "30", "22", "23", "24", "25", "26", "27")
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420".split())
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "@"), "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "master", "amex", "credit", "karte", "carte", "tarjeta", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "ruf", "contact"),
    "secret": ("password", "passwd", "token", "secret", "key", "pwd")}
AGAINST = ("isbn", "version", "order", "invoice", "page", "build", "section", "chapter", "serial", "sku")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at signs (linear, whatever the text)."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def loose_emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a word edge, local part, spelled at and domain, found from their ats (linear, too)."""
    done, m = 0, LOOSE_AT.search(text)
    while m:
        a, b, bare = m.start(), m.end(), m[0] == " at "
        if bare or " " not in (text[a], text[b - 1]):
            if not bare:
                a, b = a - (text[a - 1 : a] == " "), b + (text[b : b + 1] == " ")
            lo = a
            while lo > done and text[lo - 1] in LOCAL:
                lo -= 1
            lo = EDGE.search(text, lo).start() if lo < a else a
            d = LOOSE_DOMAIN.match(text, b) if lo < a else None
            if d:
                yield lo, d.end()
                done = d.end()
        m = LOOSE_AT.search(text, max(m.start() + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The strict matches of each kind, and under ``no`` + kind the matches that failed their test."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, "no_ip", "no_card", "no_phone")}
    out["email"] = list(emails(text))
    for m in IP.finditer(text):
        out["ip" if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")) else "no_ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m[0])
            if 13 <= len(d) <= 19:
                out["card" if luhn(d) else "no_card"].append(m.span())
    for m in PHONE.finditer(text):
        out["phone" if 9 <= len(digits_of(m[0])) <= 15 else "no_phone"].append(m.span())
    return out


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    failed: bool


def candidates(text: str) -> list[Candidate]:
    """Base spans, failed strict matches and loose matches that touch no base span, or secrets not all within them."""
    found = base_spans(text)
    out = [Candidate(k, a, b, True, False) for k in BASE_KINDS for a, b in found[k]]
    taken = sorted((c.start, c.end) for c in out)
    loose = [Candidate(k, a, b, False, True) for k in ("ip", "card", "phone") for a, b in found[f"no_{k}"]]
    loose += [Candidate("email", a, b, False, False) for a, b in loose_emails(text)]
    if any("0" <= c <= "9" for c in text):
        loose += [Candidate("phone", *m.span(), False, False) for m in LOOSE_PHONE.finditer(text)]
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in SECRET_WORDS):
            loose += [Candidate("secret", *m.span(1), False, False) for m in SECRET.finditer(text)]
    if not loose:
        return out
    starts = np.array([a for a, _ in taken])
    for c in sorted(loose, key=lambda c: (c.start, -c.end, KINDS.index(c.kind))):
        # base spans of different kinds may overlap each other, so look at all that start before the end
        near = int(np.searchsorted(starts, c.end)) if len(starts) else 0
        if not any(b > c.start for _, b in taken[:near]) or (c.kind == "secret" and outside(c, taken[:near])):
            out.append(c)
    return out


def outside(c: Candidate, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches of a candidate that none of the sorted spans covers."""
    out, at = [], c.start
    for a, b in taken:
        if b > at:
            if min(a, c.end) > at:
                out.append((at, min(a, c.end)))
            at = b
    return [*out, (at, c.end)] if at < c.end else out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(v / n * math.log2(v / n) for v in Counter(s).values())


def votes(text: str, c: Candidate) -> tuple[int, ...]:
    """1 for, -1 against, 0 no opinion: strict pattern, gazetteer, context, shape."""
    s = text[c.start : c.end]
    before = text[max(0, c.start - 40) : c.start].lower()
    strict = 1 if c.base else -1 if c.failed else 0
    if c.kind == "email":
        known = 1 if re.split(r"[^A-Za-z]+", s.rstrip(")] "))[-1].lower() in TOP_LEVEL else -1
        shape = 1 if re.search(r"[@\[(]", s) or re.search(r"[0-9._+-]", s.split(" ")[0]) else -1
    elif c.kind == "ip":
        parts = [int(p[:6]) for p in s.split(".")]
        known = 1 if 0 < parts[0] < 240 else -1
        shape = 1 if all(len(p) < 4 for p in s.split(".")) else -1
    elif c.kind == "card":
        d = digits_of(s)
        known = 1 if d.startswith(CARD_PREFIX) else -1
        shape = 1 if len(d) in (15, 16) else 0
    elif c.kind == "phone":
        d = digits_of(s)
        known = (1 if any(d.startswith(k) for k in CALLING_CODES) else -1) if s.startswith("+") else (1 if d[0] not in "01" and d[3] not in "01" else -1)
        shape = 1 if 9 <= len(d) <= 13 and len({x for x in s if not x.isdigit()}) > 0 else -1
    else:
        known = 1 if re.search(r"(password|passwd|token|secret|key)", before) else 0
        shape = 1 if entropy(s) > 2.8 and any(x.isdigit() for x in s) else -1
    near = -1 if any(w in before for w in AGAINST) else 1 if any(w in before for w in CONTEXT[c.kind]) else 0
    return strict, known, near, shape


def features(text: str, c: Candidate) -> tuple[int, ...]:
    """Discretised: length, share of digits, entropy, separators, what stands around."""
    s = text[c.start : c.end]
    n = len(s)
    around = (text[c.start - 1] if c.start else " ") + (text[c.end] if c.end < len(text) else " ")
    return (
        min(5, n.bit_length() - 2), min(4, 5 * sum(x.isdigit() for x in s) // n), min(3, int(entropy(s))),
        min(2, sum(not x.isalnum() for x in s)), int(not any(x.isalnum() for x in around)))


SIZES = (6, 5, 4, 3, 2)


@dataclass
class Model:
    """Labelers' reliabilities (per vote value, given personal or not) and the classifier's weights."""

    reliability: np.ndarray
    prior: dict[str, float]
    weights: np.ndarray

    def probability(self, kind: str, vote: tuple[int, ...], feature: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-_row(kind, vote, feature) @ self.weights)))


def _row(kind: str, vote: tuple[int, ...], feature: tuple[int, ...]) -> np.ndarray:
    x = [1.0, *(float(kind == k) for k in KINDS)]
    x.append(float(vote[0] == -1))  # that a strict pattern matched is no feature: the classifier is for what it leaves open
    for v in vote[1:]:
        x += [float(v == 1), float(v == -1)]
    for f, n in zip(feature, SIZES, strict=True):
        x += [float(f == i) for i in range(n)]
    return np.array(x)


def fit(patterns: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 50) -> Model:
    """EM over vote counts, then iteratively reweighted least squares on the posteriors.

    Strict matches are known to be personal and matches that failed their test are known not to be; the
    rest start from the votes' majority.
    """
    kinds = [k for k, *_ in patterns]
    v = np.array([x for _, x, _, _ in patterns], int).reshape(-1, VOTERS)
    n = np.array([c for *_, c in patterns], float)
    base, failed = v[:, 0] == 1, v[:, 0] == -1
    settled = lambda p: np.where(base, 1.0, np.where(failed, 0.0, p))
    post = settled(1 / (1 + np.exp(-1.5 * v.sum(axis=1))))
    rel = np.full((VOTERS, 3, 2), 1 / 3)
    prior = dict.fromkeys(KINDS, 0.5)
    for _ in range(rounds if len(n) else 0):
        for j in range(VOTERS):
            for val in (-1, 0, 1):
                at = v[:, j] == val
                rel[j, val + 1] = [(n[at] * (1 - post[at])).sum() + 1, (n[at] * post[at]).sum() + 1]
            rel[j] /= rel[j].sum(axis=0)
        for k in set(kinds):
            # the share among what the strict pattern leaves open
            at = np.array([x == k for x in kinds]) & ~base & ~failed
            prior[k] = float(((n[at] * post[at]).sum() + 1) / (n[at].sum() + 2))
        odds = np.log([prior[k] / (1 - prior[k]) for k in kinds])
        for j in range(1, VOTERS):
            r = rel[j, v[:, j] + 1]
            odds = odds + np.log(r[:, 1]) - np.log(r[:, 0])
        post = settled(1 / (1 + np.exp(-odds)))
    width = len(_row("email", (0,) * VOTERS, (0,) * len(SIZES)))
    w = np.zeros(width)
    if len(n):
        x = np.array([_row(k, vote, f) for k, vote, f, _ in patterns])
        for _ in range(25):
            p = 1 / (1 + np.exp(-x @ w))
            grad = x.T @ (n * (post - p)) - 0.5 * w
            hess = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.eye(width)
            step = np.linalg.solve(hess, grad)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
    return Model(rel, prior, w)


def train(docs: DataFrame) -> Model:
    """Count patterns over all documents, fit on the counts (at most values of votes x features many)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("text"):
                s = t.as_py() or ""
                for c in candidates(s):
                    seen[(c.kind, votes(s, c), features(s, c))] += 1
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([list(k[1]) for k, _ in rows], pa.list_(pa.int32())),
             pa.array([list(k[2]) for k, _ in rows], pa.list_(pa.int32())), pa.array([n for _, n in rows], pa.int64())], names=["kind", "vote", "feature", "n"])

    found = docs.select("text").mapInArrow(count, "kind string, vote array<int>, feature array<int>, n bigint")
    rows = found.groupBy("kind", "vote", "feature").agg(F.sum("n").alias("n")).orderBy("kind", "vote", "feature").collect()
    return fit([(r.kind, tuple(r.vote), tuple(r.feature), r.n) for r in rows])


def spans(text: str, model: Model, accept: float = ACCEPT, known: dict | None = None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, then start."""
    known = {} if known is None else known
    out, end = [], -1
    found = candidates(text)
    taken = sorted((c.start, c.end) for c in found if c.base)
    for c in found:
        if c.base:
            out.append((c.kind, c.start, c.end, True))
        elif c.start >= end:
            key = (c.kind, votes(text, c), features(text, c))
            if key not in known:
                known[key] = model.probability(*key)
            if known[key] >= accept:
                out += [(c.kind, a, b, False) for a, b in outside(c, taken)]
                end = c.end
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Adds ``spans``: array of (kind, start, end, base)."""
    model = model or train(docs)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,base:boolean>>")
    def run(text: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in spans(t or "", model, known=known)] for t in text])

    return docs.withColumn("spans", run("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the digest of the base spans, and all spans as one string."""
    base = F.filter("spans", lambda x: x["base"])
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """Each maximal stretch of spans becomes the mark of its first span's kind."""
    out, at = [], 0
    for a, b, k in sorted(found):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents with every span replaced by its kind."""
    model = model or train(docs)

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([None if t is None else masked(t, [(a, b, k) for k, a, b, _ in spans(t, model, known=known)]) for t in text])

    return docs.withColumn("text", run("text"))


def base_sha256(text: str) -> str:
    """The base digest of one text."""
    found = base_spans(text)
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in BASE_KINDS for a, b in found[k]).encode()).hexdigest()
