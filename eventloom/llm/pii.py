"""Personal data by base patterns and a skip-chain conditional random field.

Mentions of a document are its base spans and looser candidates: runs of digits with
separators, numbers with masked digits, and words that repeat the local part of one of its addresses.
Each mention has a label (none, email, ip, card, phone) with log-linear potentials from its features.
Neighbours form a chain, with a symmetric matrix of potentials over both labels; distant mentions that
repeat or resemble each other (the same last seven digits, or four where the others are masked, or
the same local part) share a skip potential that rewards equal labels: a candidate with every base span
of its key and with the candidate of that key before it, so that it takes the label of its evidence
however often it repeats. Base spans are observed, so that their edges are votes. Loopy belief
propagation, until no message moves by ``SETTLED`` or after rounds bound by the number of mentions,
gives each candidate its marginals; it becomes a span where the best label's marginal exceeds ``ACCEPT``.

All weights (of the features, the chain's matrix and the skip edges) are fitted together on the
pseudo-likelihood of a bounded sample: the probability of each mention's label given its features,
with those masked that the patterns themselves need, and the labels of its neighbours, as they stand
in their documents. Candidates that repeat a base span are left out, for nobody labelled them.
Instead looser forms of every base span (without its sign, with other separators, its first digits
masked, a bare local part) join as mentions with one to three neighbours of its label, and as
unlabelled ones without; numbers made by rule that are no personal data (dates, amounts, counts,
serials) join alone and repeated. Both stand among neighbours drawn alike from the whole sample,
so that they tell nothing about the chain.

Defined results: null and empty texts have no spans; repeated rows are scanned alike, and null ids like any; an empty
table gives an empty result; ``annotate`` keeps all columns and its new ones have names given
by the caller. All matches are found in time linear in the text, but for the candidates' pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
MAX_TRAIN_DOCS, MAX_TRAIN_MENTIONS = 4_000, 16_000
ACCEPT, LEAST_ROUNDS, SETTLED = 0.8, 64, 1e-6
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits would have started at the run's head.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE = re.compile(r"(?<![A-Za-z0-9_@/.-])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![A-Za-z0-9_@/-])")
_MASKED = re.compile(r"(?<![A-Za-z0-9*#])(?:[*#Xx]{2,6}[\x20.-]?){1,4}[0-9]{4}(?![0-9A-Za-z])")
_WORD = re.compile(r"[A-Za-z0-9._%+-]{5,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _digits(raw: str) -> str:
    return "".join(c for c in raw if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop), sorted."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    out.sort()
    return out


def loose_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, stop) of strings like personal data, outside the base spans."""
    found = []
    if _DIGIT.search(text):
        found = [(m.start(), m.end()) for m in _LOOSE.finditer(text)] + [(m.start(), m.end()) for m in _MASKED.finditer(text)]
    locals_ = {text[s:e].split("@")[0] for s, k, e in base if k == 0}
    locals_ = {x for x in locals_ if len(x) >= 5 and _DIGIT.search(x)}
    if locals_:
        found += [(m.start(), m.end()) for m in _WORD.finditer(text) if m[0].strip(".") in locals_]
    found.sort()
    out, k = [], 0
    for s, e in found:
        while k < len(base) and base[k][2] <= s:
            k += 1
        if any(b[0] < e and s < b[2] for b in base[k : k + 4]) or (out and s < out[-1][1]):
            continue
        out.append((s, e))
    return out


_BUCKETS = (7, 10, 12, 14, 16, 20)


def features(raw: str, masked: bool = False) -> np.ndarray:
    """0/1 features; ``masked`` leaves out what the patterns themselves ask for."""
    d = _digits(raw)
    x = np.zeros(21)
    x[0] = 1
    x[1 + sum(len(d) >= b for b in _BUCKETS)] = 1
    x[8] = "(" in raw
    x[9] = "-" in raw
    x[10] = " " in raw
    x[11] = raw.count(".") == 3
    x[12] = any(c.isalpha() for c in raw)
    x[13] = len(d) >= 12 and luhn(d) and not masked
    x[14] = raw.startswith("+") and not masked
    x[15] = "@" in raw and not masked
    x[16] = x[10] and x[9]
    x[17] = len(d) == len(raw)
    x[18] = bool(re.fullmatch(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}.*", raw))
    x[19] = masked
    x[20] = any(c in "*#Xx" for c in raw) and not any(c.isalpha() and c not in "Xx" for c in raw)
    return x


def looser(raw: str, kind: int) -> list[str]:
    """Forms in which a base span of ``kind`` comes again, which its pattern misses."""
    d = _digits(raw)
    if kind == 0:
        return [raw.split("@")[0]]
    if kind == 1:
        return []
    forms = [d[:-4] + "-" + d[-4:], f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]} {d[-7:-4]} {d[-4:]}", f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", d[-10:]] if kind == 3 else [f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}"]
    return forms + [f"****-****-{d[-4:]}", f"xxx-xxx-{d[-4:]}"]


def _votes(text: str, mentions: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many chain and skip neighbours of each mention (start, stop, label) hold each label."""
    chain, skip = (np.zeros((len(mentions), len(LABELS))) for _ in range(2))
    for i, m in enumerate(mentions):
        for j in (i - 1, i + 1):
            if 0 <= j < len(mentions):
                chain[j, m[2]] += 1
    held: dict[str, np.ndarray] = {}
    own = [_offers(text[s:e]) if label else _keys(text[s:e]) for s, e, label in mentions]
    for keys, m in zip(own, mentions, strict=True):
        for key in keys:
            held.setdefault(key, np.zeros(len(LABELS)))[m[2]] += 1
    for i, (s, e, label) in enumerate(mentions):
        for key in _keys(text[s:e]):
            skip[i] += held[key]
            skip[i, label] -= 1
    return chain, skip


_TRAIN = "h long, label int, raw string, chain array<double>, skip array<double>"


def _train_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for h, text in zip(frame["h"], frame["text"], strict=True):
            base = base_spans(text or "")
            mentions = sorted([(s, e, k + 1) for s, k, e in base] + [(s, e, 0) for s, e in loose_candidates(text or "", base)])
            chain, skip = _votes(text or "", mentions)
            rows += [(h, m[2], text[m[0] : m[1]], c.tolist(), v.tolist()) for m, c, v in zip(mentions, chain, skip, strict=True)]
        yield pd.DataFrame(rows, columns=["h", "label", "raw", "chain", "skip"])


def _harmless(n: int = 400) -> list[str]:
    """Numbers that are no personal data, by rule."""
    out = []
    for k in range(n):
        a = (k * 2654435761) % 10**9
        out += [f"{1950 + k % 90}-{k % 12 + 1:02d}-{k % 28 + 1:02d}", f"{a:010d}", f"{a}{k % 97:03d}", f"{k % 900 + 100} {a % 1000:03d} {k % 1000:03d}", f"{k % 9 + 1}.{a % 1000:03d}.{k % 1000:03d}", f"{a % 10000:04d}-{k % 10000:04d}", f"{a:09d}{k * 7919 % 10**7:07d}"]
    return out


def fit(documents: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, max_train_mentions: int = MAX_TRAIN_MENTIONS, steps: int = 400) -> dict:
    """All weights, by gradient on the pseudo-likelihood of a bounded sample.

    The sample is about ``max_train_docs`` documents by the hash of id and text, so that rows of one
    id or of none are drawn apart (repeated rows fall together), and ``max_train_mentions`` of their
    mentions at most, by the hash of the document. The skip weight never rewards disagreement; the
    chain's matrix, symmetric, may.
    """
    total = documents.count()
    h = F.xxhash64(F.lit("train"), "doc_id", "text")
    rows = documents.where(F.pmod(h, F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_train_docs / max(1, total))))
    found = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInPandas(_train_rows, _TRAIN)
    found = found.orderBy("h", "label", "raw").limit(max_train_mentions).collect()
    # Two of each pattern by rule, so that a corpus without personal data still has every label.
    known = [(r["label"], r["raw"]) for r in found if r["label"]] + [(1, "ab.cd12@example.com"), (2, "10.20.30.40"), (3, "4111 1111 1111 1111"), (4, "+1 (212) 555-0100")]
    none, one = np.zeros(len(LABELS)), np.eye(len(LABELS))
    # A candidate that repeats a base span is taken to be none of known label, and is left out; all else of the sample counts.
    examples = [(r["label"], r["raw"], np.array(r["chain"]), np.array(r["skip"])) for r in found if r["label"] or not any(r["skip"][1:])]
    # Forms and harmless numbers stand among any neighbours, so that the chain is learned from the sample's own.
    among = [none, one[0], 2 * one[0], *(votes for _, _, votes, _ in examples)]
    place = lambda k: among[k * 7919 % len(among)]
    for k, (label, raw) in enumerate(known):
        for j, form in enumerate([raw, *looser(raw, label - 1)]):
            at = place(11 * k + j)
            examples += [(label, form, at, one[label] * (1 + k % 3)), (0, form, at, none)]
    for k, raw in enumerate(_harmless()):
        examples += [(0, raw, place(k), none), (0, raw, place(k), one[0] * (1 + k % 3))]
    x = np.array([features(raw, True) for _, raw, _, _ in examples])
    y = np.array([label for label, *_ in examples])
    chain, skip = np.array([c for _, _, c, _ in examples]), np.array([v for *_, v in examples])
    share = np.bincount(y, minlength=len(LABELS))
    weight = 1.0 / share[y] * np.where(y == 0, len(LABELS), 1)  # labels count alike, none as much as all others
    weight /= weight.sum()
    w, links, pull, target = np.zeros((x.shape[1], len(LABELS))), np.zeros((len(LABELS), len(LABELS))), np.zeros(1), np.eye(len(LABELS))[y]
    values = (w, links, pull)
    moment = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for step in range(1, steps + 1):
        z = x @ w + chain @ links + pull[0] * skip
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = (target - p) * weight[:, None]
        both = chain.T @ miss
        slope = (x.T @ miss - 1e-4 * w, (both + both.T) / 2 - 1e-3 * links, np.array([(miss * skip).sum()]) - 1e-4 * pull)
        for value, g, (m, v) in zip(values, slope, moment, strict=True):  # moments of the gradient scale each step
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        np.maximum(pull, 0, out=pull)
    return {"unary": w.tolist(), "chain": links.tolist(), "skip": float(pull[0])}


def _keys(raw: str) -> list[str]:
    d = _digits(raw)
    if len(d) == 4 and any(c in "*#Xx" for c in raw):
        return ["f" + d]
    keys = ["d" + d[-7:]] if len(d) >= 7 else []
    local = raw.split("@")[0].strip(".")
    if any(c.isalpha() for c in local):
        keys.append("l" + local)
    return keys


def _offers(raw: str) -> list[str]:
    """The keys under which a base span is evidence: its own, and its last four digits for masked numbers."""
    d = _digits(raw)
    return _keys(raw) + (["f" + d[-4:]] if len(d) >= 7 and "@" not in raw else [])


def field(model: dict, text: str, base: list[tuple[int, int, int]], loose: list[tuple[int, int]]) -> tuple[list, np.ndarray, dict]:
    """Mentions (start, stop, label or 0) in order, their log potentials, and edges (i, j) with the log potentials of both ends' labels.

    Observed labels are known, so that each of their edges is a fixed vote for the other end's label;
    edges are between candidates only.
    """
    mentions = sorted([(s, e, k + 1) for s, k, e in base] + [(s, e, 0) for s, e in loose])
    n, size = len(mentions), len(LABELS)
    w, chain, skip = np.asarray(model["unary"]), np.asarray(model["chain"]), model["skip"] * np.eye(size)
    unary = np.zeros((n, size))
    evidence: dict[str, np.ndarray] = {}
    for i, (s, e, label) in enumerate(mentions):
        if label:
            unary[i] = -30
            unary[i, label] = 0
            for key in _offers(text[s:e]):
                evidence.setdefault(key, np.zeros(size))[label] += model["skip"]
        else:
            unary[i] = features(text[s:e], True) @ w
    edges: dict[tuple[int, int], np.ndarray] = {}
    last: dict[str, int] = {}
    for i, (s, e, label) in enumerate(mentions):
        if label:
            continue
        if i and not mentions[i - 1][2]:
            edges[i - 1, i] = edges.get((i - 1, i), 0) + chain
        for j in (i - 1, i + 1):
            if 0 <= j < n and mentions[j][2]:
                unary[i] += chain[mentions[j][2]]
        for key in _keys(text[s:e]):
            if key in evidence:
                unary[i] += evidence[key]
            if key in last:
                edges[last[key], i] = edges.get((last[key], i), 0) + skip
            last[key] = i
    return mentions, unary, edges


def marginals(unary: np.ndarray, edges: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Each mention's marginal by loopy message passing; exact where the edges form no loop."""
    n, size = unary.shape
    total, m = np.zeros((n, size)), len(edges)
    if m:
        heads, tails = [h for h, _ in edges], [t for _, t in edges]
        a, b = np.array(heads + tails, np.int64), np.array(tails + heads, np.int64)
        force = np.exp(np.array([*edges.values(), *(x.T for x in edges.values())]))
        messages = np.full((2 * m, size), 1 / size)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        for _ in range(LEAST_ROUNDS + 4 * n):
            logs = np.log(messages)
            total = np.zeros((n, size))
            np.add.at(total, b, logs)
            out = unary[a] + total[a] - logs[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.einsum("es,est->et", out, force)
            new /= new.sum(1, keepdims=True)
            moved = np.abs(new - messages).max()
            messages = 0.5 * messages + 0.5 * new
            if moved < SETTLED:
                break
        total = np.zeros((n, size))
        np.add.at(total, b, np.log(messages))
    belief = np.exp((unary + total) - (unary + total).max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def infer(model: dict, text: str, base: list[tuple[int, int, int]], loose: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field adds: candidates whose best label's marginal exceeds ``ACCEPT``."""
    mentions, unary, edges = field(model, text, base, loose)
    belief = marginals(unary, edges)
    added = []
    for i, (s, e, label) in enumerate(mentions):
        k = int(belief[i].argmax())
        if not label and k and belief[i, k] > ACCEPT:
            added.append((s, k - 1, e))
    return added


def scan(model: dict, text: str | None) -> tuple[list, list]:
    """(base, all) spans of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    loose = loose_candidates(text, base)
    return (base, base) if not loose else (base, sorted(base + infer(model, text, base, loose)))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def annotate(documents: DataFrame, model: dict, out: str = "pii_spans") -> DataFrame:
    """All columns and the array of spans."""
    names = documents.columns
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in scan(shared.value, t)[1]] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spans, _SPAN_ARROW)], names=[*names, out])

    schema = T.StructType([*documents.schema.fields, T.StructField(out, _SPAN_TYPE)])
    return documents.select(F.col("text").alias("_text_"), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def _report(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, texts, totals = [[] for _ in KINDS], [], [], []
            for text in batch.column(1).to_pylist():
                base, every = scan(shared.value, text)
                for k in range(len(KINDS)):
                    counts[k].append(sum(1 for s in base if s[1] == k))
                shas.append(hashlib.sha256(spell(base).encode()).hexdigest())
                texts.append(spell(every))
                totals.append(len(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(texts, pa.string()), pa.array(totals, pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return run


def pii_report(documents: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document; n_spans counts those of all kinds."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(fit(docs))
    return docs.mapInArrow(_report(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
