"""Personal data by weak supervision.

Patterns give the base spans (e-mail, ip, card, phone), which always stay. Further candidates, such as quoted secrets,
digit groups that fail a check and addresses spelled out, have to be voted in. Labelers vote for, against or abstain:
shape (regular expressions), gazetteer (lists of words that speak for a kind or for something else), context (what the
span touches) and check (entropy, checksums, ranges). Expectation-maximisation over the counts of all vote patterns
estimates each labeler's reliability for every kind, base ones included, without labels; its posteriors train a logistic
span classifier on votes and binned span features (length, share of digits, neighbours), which accepts or rejects each
candidate. :func:`labeler_report` shows reliabilities and how many candidates were rejected.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplicia.llm.common import text_rows, workers, write_table

#: Kinds in the order in which spans are listed: the base ones, then those that the method adds (fixed values).
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "spelled")

# Fixed patterns of the base kinds. Digits and local parts are taken from the start of their run, which is where a
# leftmost match begins, so that long runs are read once.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_ANY_DIGIT = re.compile("[0-9]")
_DIGIT_RUNS = re.compile("[0-9]+")

# Candidates of the added kinds.
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+(?![A-Za-z0-9_/+-])")
_NUMBER = re.compile(r"(?<![A-Za-z0-9])[0-9](?:[\x20-]?[0-9])+(?![A-Za-z0-9])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(]? ?at ?[\])]? ?[A-Za-z0-9-]++ ?[\[(]? ?dot ?[\])]? ?[A-Za-z]{2,}+(?![A-Za-z])")

# Gazetteers: words near a span that speak for its kind, and words that speak for something else.
_FOR = {
    "email": "email mail mailto contact write reach address send reply inbox newsletter correo courriel adresse schreiben escribir",
    "ip": "ip host server address gateway router dns ping login logged connection client subnet network port proxy adresse servidor serveur",
    "card": "card visa mastercard amex credit debit payment pay paid charge charged bank expires cvv cvc tarjeta karte carte kreditkarte",
    "phone": "phone tel telephone call mobile cell fax whatsapp sms dial hotline ring telefon telefono handy llamar appeler anrufen",
    "secret": "token secret password passwd pwd key apikey auth bearer credential credentials access private client session signature jwt oauth login clave schluessel passwort contrasena motdepasse",
    "number": "card visa mastercard amex credit debit account iban bank ssn social security passport tax licence license insurance patient member phone tel call mobile fax konto ausweis cuenta pasaporte compte passeport steuer",
    "spelled": "email mail contact write reach address send reply courriel correo adresse schreiben",
}
_AGAINST = {
    "email": "example import decorator annotation",
    "ip": "version release build chapter section firmware kernel package",
    "card": "isbn issn barcode serial tracking order invoice timestamp",
    "phone": "isbn issn version score formula equation",
    "secret": "sha commit checksum digest hash md5 revision blob tree path file folder url href src image uuid guid etag css class",
    "number": "order invoice isbn issn ean barcode serial tracking timestamp epoch id item sku part page count total sum price bytes lines version row",
    "spelled": "meeting look looked looking stood arrived",
}
_FOR, _AGAINST = ({k: frozenset(v.split()) for k, v in x.items()} for x in (_FOR, _AGAINST))
_NAME = re.compile("[a-z0-9]+")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_KEYLIKE = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|sk-|pk-|xox[bp]-|eyJ|AIza)[A-Za-z0-9_/+-]+")
NEAR = 40  # characters around a span that labelers see
LABELERS = ("shape", "gazetteer", "context", "check")
#: Upper ends of the bins of a candidate's length, and how many bins each of its features has.
_LENGTHS = (16, 24, 40)
BINS = (4, 4, 3, 3)
KINDS = (*BASE, *ADDED)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans of each kind: leftmost and non-overlapping; a match that fails its check is dropped, not retried."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = _emails(text)
    if _ANY_DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in (s.count(c) for c in set(s)))


def _shape(kind: str, body: str, digits: str) -> int:
    if kind == "email":
        end = body.rsplit(".", 1)[-1]
        return 1 if end.isalpha() and 2 <= len(end) <= 24 else 0
    if kind == "ip":
        return 0 if any(len(x) > 1 and x[0] == "0" for x in body.split(".")) else 1
    if kind == "card":
        return 1 if len(digits) in (15, 16) and digits[0] in "3456" else 0
    if kind == "phone":
        return 1 if len(digits) < len(body) - 1 else 2
    if kind == "secret":
        if _KEYLIKE.fullmatch(body) or (_HEX.fullmatch(body) and len(body) in (32, 40, 48, 56, 64, 96, 128)):
            return 1
        parts = re.split("[_/+-]", body)
        wordy = sum(x.isalpha() or x.isdigit() or not x for x in parts)
        return 0 if len(parts) > 1 and 2 * wordy > len(parts) else 2
    if kind == "number":
        groups = re.split("[ -]", body)
        return 0 if len(groups) == 1 else 1 if len({len(g) for g in groups[:-1]}) == 1 else 2
    return 1 if "[" in body or "(" in body else 0 if body.count(" at ") and " dot " not in body else 2


def _check(kind: str, body: str, digits: str) -> int:
    if kind == "email":
        return 0 if ".." in body or body[0] == "." or ".@" in body else 1
    if kind == "ip":
        return 0 if body.split(".")[0].strip("0") == "" else 1
    if kind == "secret":
        return 1 if _entropy(body.lower()) >= 3.2 and 10 * len(digits) >= len(body) else 0  # of random characters a sixth and more are digits
    if kind == "phone":
        return 0 if digits[0] == "0" or len(set(digits)) < 3 else 1
    return 1 if luhn(digits) and len(set(digits)) > 1 else 0 if kind in ("card", "number") else 2


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 for, 0 against, 2 abstains."""
    body, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
    digits = _NOT_DIGIT.sub("", body)
    near = {*_NAME.findall(before.lower()), *_NAME.findall(after.lower())}
    gazetteer = 1 if not near.isdisjoint(_FOR[kind]) else 0 if not near.isdisjoint(_AGAINST[kind]) else 2
    lines_up = before[-1:] in ("", " ", "\n", "\t", '"', "'", "(", "<", "[") and after[:1] in ("", " ", "\n", "\t", '"', "'", ")", ">", "]", ".", ",", ";")
    context = 1 if _ASSIGNED.search(before) else 0 if not lines_up else 2
    return _shape(kind, body, digits), gazetteer, context, _check(kind, body, digits)


def features(text: str, start: int, end: int) -> tuple[int, ...]:
    """Bins of a candidate's length, its share of digits, and what kind of character stands before and after it."""
    n = end - start
    digits = n - len(_DIGIT_RUNS.sub("", text[start:end]))
    side = lambda c: 0 if c == "" or c.isspace() else 1 if c in "=:\"'`" else 2
    return sum(n > x for x in _LENGTHS), min(3, 4 * digits // n), side(text[start - 1 : start] if start else ""), side(text[end : end + 1])


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Spans of the added kinds that overlap neither a base span nor one another; of two that overlap, the one that begins first, then the longer, stays."""
    found: list[tuple[str, int, int]] = []
    if _ANY_DIGIT.search(text):
        found += [("secret", *m.span()) for m in _SECRET.finditer(text) if _ANY_DIGIT.search(m.group()) and not m.group().isdigit()]
        found += [("number", *m.span()) for m in _NUMBER.finditer(text) if m.end() - m.start() >= 9 and 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 19]
    if " at " in text or "(at)" in text or "[at]" in text:
        if " dot " in text or "(dot)" in text or "[dot]" in text:
            found += [("spelled", *m.span()) for m in _SPELLED.finditer(text)]
    if not found:
        return []
    taken: list[list[int]] = []  # base spans, joined where they overlap, so ordered by their ends too
    for a, b in sorted(s for spans in base.values() for s in spans):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    out, at, last = [], 0, 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2], ADDED.index(x[0]))):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= last and (at == len(taken) or b <= taken[at][0]):
            out.append((kind, a, b))
            last = b
    return out


def pattern(kind: str, cast: tuple[int, ...], binned: tuple[int, ...] = (0,) * len(BINS)) -> int:
    """A number for a kind, its votes and binned features; there are ``len(KINDS) * 3 ** len(LABELERS) * prod(BINS)`` of them."""
    out = KINDS.index(kind)
    for v in cast:
        out = out * 3 + v
    for v, bins in zip(binned, BINS, strict=True):
        out = out * bins + v
    return out


def unpack(number: int) -> tuple[str, tuple[int, ...], tuple[int, ...]]:
    cast, binned = [], []
    for bins in reversed(BINS):
        number, v = divmod(number, bins)
        binned.append(v)
    for _ in LABELERS:
        number, v = divmod(number, 3)
        cast.append(v)
    return KINDS[number], tuple(reversed(cast)), tuple(reversed(binned))


@dataclass(frozen=True)
class SpanModel:
    reliability: dict[str, tuple[tuple[float, float], ...]]  # of each kind: P(vote for | real), P(vote for | not) by labeler
    accepted: dict[int, float]  # pattern of votes and features to the classifier's probability, 1 for base kinds


def fit_spans(counts: dict[int, int], rounds: int = 50) -> SpanModel:
    """Reliabilities by expectation-maximisation and a classifier of votes and features trained on the posteriors, from counts of patterns.

    No patterns: an empty model. Ties of votes begin at one half."""
    reliability, accepted = {}, {}
    for kind in KINDS:
        rows = [(cast, n, p, binned) for p, n in sorted(counts.items()) for own, cast, binned in [unpack(p)] if own == kind]
        if not rows:
            continue
        cast, n = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])
        on, off = (cast == 1).astype(float), (cast == 0).astype(float)
        post = (on.sum(1) + 0.5) / (on.sum(1) + off.sum(1) + 1)  # majority vote to begin with
        for _ in range(rounds):
            prior = ((n * post).sum() + 1) / (n.sum() + 2)
            yes, no = n * post, n * (1 - post)
            # votes are more often right than not: Beta(3, 1) priors
            p1 = ((yes @ on) + 3) / ((yes @ (on + off)) + 4)
            p0 = ((no @ on) + 1) / ((no @ (on + off)) + 4)
            logit = math.log(prior / (1 - prior)) + on @ np.log(p1 / p0) + off @ np.log((1 - p1) / (1 - p0))
            post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        reliability[kind] = tuple((float(a), float(b)) for a, b in zip(p1, p0, strict=True))
        marks = np.hstack([np.eye(bins)[[r[3][j] for r in rows]] for j, bins in enumerate(BINS)])
        x = np.hstack([np.ones((len(rows), 1)), on, off, marks])
        w = np.zeros(x.shape[1])
        for _ in range(300):  # ridge logistic regression on soft labels, weighted by counts
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(len(w)), x.T @ (n * (p - post)) + w)
            if np.abs(w).max() > 30:
                break
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        accepted |= {r[2]: 1.0 if kind in BASE else float(q) for r, q in zip(rows, p, strict=True)}
    return SpanModel(reliability, accepted)


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base and found (arrays of kind, start, end and the pattern of votes and features) of each whole text."""
    workers(docs.sparkSession)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32())]))

    def told(text: str, kind: str, a: int, b: int) -> dict:
        return {"kind": kind, "start": a, "end": b, "votes": pattern(kind, votes(text, kind, a, b), features(text, a, b))}

    def run(batches):
        for batch in batches:
            base, found = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text)
                base.append([told(text, k, a, b) for k in BASE for a, b in own[k]])
                found.append([told(text, *c) for c in candidates(text, own)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(found, spans)], names=["doc_id", "base", "found"])

    kind = "array<struct<kind:string,start:long,end:long,votes:int>>"
    return text_rows(docs).mapInArrow(run, f"doc_id long, base {kind}, found {kind}")


def _counts(rows: DataFrame) -> dict[int, int]:
    """How often each pattern occurs; there are only so many patterns, whatever the input."""
    return {r[0]: r[1] for r in rows.select(F.explode(F.concat("base.votes", "found.votes")).alias("votes")).groupBy("votes").count().collect()}


def labeler_report(docs: DataFrame, threshold: float = 0.5) -> list[dict]:
    """For each kind: spans, accepted ones, and each labeler's P(vote for | real) and P(vote for | not), as estimated."""
    counts = _counts(extract(docs))
    model = fit_spans(counts)
    out = []
    for kind in KINDS:
        own = {p: n for p, n in counts.items() if unpack(p)[0] == kind}
        if own:
            kept = sum(n for p, n in own.items() if model.accepted[p] >= threshold)
            out.append({"kind": kind, "spans": sum(own.values()), "accepted": kept} | dict(zip(LABELERS, model.reliability[kind], strict=True)))
    return out


def _listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = F.create_map(*[x for i, k in enumerate((*BASE, *ADDED)) for x in (F.lit(k), F.lit(i))])
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, n_spans (all), n_rejected for every row.

    Offsets are in code points, ends exclusive. Null text: empty, no spans. Null doc_id: kept. Repeated rows: each on
    its own, and counted in the patterns. Empty table: no rows. No candidates: no model, base spans only. Other
    columns are ignored.

    One pass over the text; only spans and patterns are kept, and patterns are as many for any input."""
    rows = write_table(extract(docs), "spans")
    model = fit_spans(_counts(rows))
    taken = sorted(p for p, q in model.accepted.items() if q >= threshold)
    added = F.filter("found", lambda s: s["votes"].isin(taken)) if taken else F.filter("found", lambda s: F.lit(False))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in BASE), F.sha2(_listed(plain(F.col("base"))), 256).alias("base_sha256"),
        _listed(F.concat(plain(F.col("base")), plain(added))).alias("spans"), F.size(added).cast("long").alias("n_added"),
        (F.size("base") + F.size(added)).cast("long").alias("n_spans"), (F.size("found") - F.size(added)).cast("long").alias("n_rejected"),
    )


def base_digest(text: str) -> str:
    spans = base_spans(text)
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in BASE for a, b in spans[k]).encode()).hexdigest()
