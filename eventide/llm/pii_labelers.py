"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Beside them, candidate spans (phone
numbers in other notations, identity numbers, bank accounts, addresses of machines, credentials) are voted on by
labelers that know nothing of each other: patterns, gazetteers of words and prefixes, the words before a span,
check digits, randomness of the characters. Votes of all candidates of all documents are counted per vote
pattern, so what reaches the driver is bounded by the number of patterns. Expectation-maximisation over these
counts estimates each labeler's reliability and the posterior of each pattern; a logistic model of the span's
features is trained on those posteriors and decides each candidate.

Null and empty texts have no spans. Very long texts are scanned whole, in time that grows with their length.
Repeated rows give repeated results and count each. A table without candidates, an empty one too, trains nothing
and adds nothing. Spans of one start are ordered by kind; redaction takes the longer one. Other columns are kept
by redact() and not read by find_personal_data(); n_chars keeps its own type (a length as text where it is text).
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import pieces, staged

KINDS = ("email", "ip", "card", "phone")  # base kinds, in the order that ties sort by
EXTRA = ("tel", "account", "number", "machine", "secret")  # kinds the method may add, after those
ORDER = {k: i for i, k in enumerate(KINDS + EXTRA)}

_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards: the same as scanning from the left."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _EMAIL_TAIL.match(text, at)
        begin = at
        if m:
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
        if m and begin < at:
            yield begin, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four numbers in a row of a run of numbers and dots, from the left: what the pattern finds, in one pass."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        begin, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in four):
                yield begin, begin + size
            begin += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by start and then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


# --- candidates and labelers -------------------------------------------------------------------------------

_CANDIDATE = re.compile(
    r"(?P<account>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<machine>(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:]))"
    r"|(?P<number>(?<![0-9A-Za-z.])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z]))"
    r"|(?P<secret>(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-]))"
    r"|(?P<tel>(?<![0-9A-Za-z.])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9A-Za-z.+])(?:\([0-9]{2,4}\)[\x20]?|0)[0-9]{1,4}(?:[\x20./-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+])[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]))"
)
#: Every branch of _CANDIDATE holds a digit, or two hexadecimal letters around a colon or dash.
_CLUE = re.compile(r"[0-9]|[A-Fa-f][:-][A-Fa-f]")
_BEFORE = re.compile(r"[^\W\d_]+")
GAZETTEER = {
    "tel": frozenset("tel phone telephone telefon telefono teléfono téléphone mobile mobil cell fax call llame appelez".split()),
    "account": frozenset("iban account konto cuenta compte bank banco banque bic swift".split()),
    "number": frozenset("ssn social security number nummer numéro dni nif id passport pass personal".split()),
    "machine": frozenset("mac ether hwaddr address adresse dirección host ipv inet".split()),
    "secret": frozenset("token key secret password passwd pwd apikey api auth bearer credential credentials aws access private clave contraseña".split()),
}  # fixed values
COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())  # fixed values
#: What credentials of common services and international numbers begin with.
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "pk_", "sk_", "xoxb-", "xoxp-", "eyJ", "+")  # fixed values
LABELERS = ("context", "assigned", "shape", "check", "random", "plain_word", "repeat", "prefix")


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def votes_of(kind: str, span: str, before: str) -> tuple[list[int], list[int]]:
    """Each labeler's vote (1 personal, -1 not, 0 none) and the features of the span, both of a few values."""
    digits = sum(c.isdigit() for c in span)
    words = [w.lower() for w in _BEFORE.findall(before)[-3:]]
    known = any(w in GAZETTEER[kind] for w in words)
    assigned = before.rstrip(" \"'")[-1:] in ("=", ":") and len(before) > 0
    hexed = all(c in "0123456789abcdefABCDEF" for c in span)
    entropy = _entropy(span)
    kinds_of_char = any(c.isdigit() for c in span) + any(c.islower() for c in span) + any(c.isupper() for c in span)
    shape = {
        "tel": 1 if span[0] in "+(0" and 8 <= digits <= 13 or span.count("-") == 2 else 0,
        "account": 1 if span[:2] in COUNTRIES else -1,
        "number": 0 if "-" not in span else 1 if span[:3] not in ("000", "666") and span[0] != "9" else -1,
        "machine": 1,
        "secret": 1 if hexed and len(span) in (32, 40, 64) or kinds_of_char == 3 and len(span) >= 20 else 0,
    }[kind]
    check = (1 if _iban(span) else -1) if kind == "account" else (1 if luhn(span) else -1) if kind == "number" and "-" not in span else 0
    random = (1 if entropy >= 3.2 and digits >= 3 else -1) if kind == "secret" else (-1 if len(set(_NOT_DIGIT.sub("", span))) <= 2 and digits else 0)
    plain = -1 if kind == "secret" and (digits <= 2 or "--" in span or "__" in span or "/" in span and not assigned) else 0
    repeat = -1 if len(span) > 8 and span[: len(span) // 2] == span[len(span) // 2 : len(span) // 2 * 2] else 0
    prefix = 1 if span.startswith(PREFIXES) or kind == "account" and span[:2] in COUNTRIES else 0
    votes = [1 if known else 0, 1 if assigned else 0, shape, check, random, plain, repeat, prefix]
    features = [int(known), prefix, int(assigned), int(shape > 0), int(check > 0), int(check < 0), min(4, len(span) // 8), min(4, int(5 * digits / len(span))), min(4, int(entropy)), kinds_of_char, int(hexed), *(int(kind == k) for k in EXTRA)]
    return votes, features


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, key of votes and features) of spans that no base span overlaps."""
    if not _CLUE.search(text):
        return []
    out, k = [], 0
    for m in _CANDIDATE.finditer(text):
        begin, end = m.span()
        while k < len(base) and base[k][2] <= begin:
            k += 1
        if any(a < end and b > begin for _, a, b in base[k : k + 4]):
            continue
        votes, features = votes_of(m.lastgroup, m[0], text[max(0, begin - 40) : begin])
        out.append((m.lastgroup, begin, end, json.dumps([m.lastgroup, votes, features], separators=(",", ":"))))
    return out


FOUND = "doc_id bigint, base array<struct<kind:string,start:bigint,end:bigint>>, candidates array<struct<kind:string,start:bigint,end:bigint,key:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_CAND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.string())]))


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Base and candidate spans of docs(doc_id, text); one pass, nothing of the text is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            base, more = [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                more.append([dict(zip(("kind", "start", "end", "key"), s, strict=True)) for s in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _SPAN), pa.array(more, _CAND)], ["doc_id", "base", "candidates"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, FOUND)


#: Chances of the votes -1, 0 and 1 before any data, for personal data and for anything else.
PRIOR_YES, PRIOR_NO, PRIOR_WEIGHT = np.array([0.02, 0.53, 0.45]), np.array([0.30, 0.60, 0.10]), 0.5


def train(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Probability that a candidate of each key is personal data.

    EM over the vote patterns of all candidates: each labeler has a chance of voting 1, 0 or -1 in either class.
    The chances have a prior, as of PRIOR_WEIGHT times as many candidates, that says that labelers do better than
    chance; the first posterior is the majority vote. Then a logistic model of the features, weighted by the counts, is
    fitted to the posteriors by Newton steps with a ridge; its probability is averaged with the posterior.
    """
    if not counts:
        return {}
    keys = sorted(counts)
    kinds, votes, features = zip(*(json.loads(k) for k in keys), strict=True)
    n = np.array([counts[k] for k in keys], dtype=float)
    v = np.array(votes) + 1
    x = np.column_stack([np.ones(len(keys)), np.array(features, dtype=float)])
    x[:, 1:] /= np.maximum(1, np.abs(x[:, 1:]).max(0))
    s = (v - 1).sum(1)
    p = 1 / (1 + np.exp(-1.5 * (s - 0.5)))
    one_hot = np.eye(3)[v]  # key, labeler, vote
    for _ in range(rounds):
        like = []
        for q in (p, 1 - p):
            w = n * q
            held = PRIOR_WEIGHT * n.sum() + 1
            like.append(((one_hot * w[:, None, None]).sum(0) + held * (PRIOR_YES if q is p else PRIOR_NO)) / (w.sum() + held))
        prior = (n @ p + 1) / (n.sum() + 2)
        logs = [np.log(t)[np.arange(v.shape[1]), v].sum(1) for t in like]
        new = np.clip(1 / (1 + np.exp(np.clip(logs[1] - logs[0] + math.log((1 - prior) / prior), -50, 50))), 1e-4, 1 - 1e-4)
        if np.abs(new - p).max() < 1e-7:
            break
        p = new
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        m = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (p - m)) - 1e-2 * n.sum() / 100 * beta
        hess = (x * (n * np.maximum(m * (1 - m), 1e-6))[:, None]).T @ x + (1e-2 * n.sum() / 100 + 1e-6) * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    m = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return {k: float((a + b) / 2) for k, a, b in zip(keys, m, p, strict=True)}


def key_counts(found: DataFrame) -> dict[str, int]:
    """How many candidates of all documents have each key; keys are bounded by the values of votes and features."""
    rows = found.select(F.explode("candidates.key").alias("key")).groupBy("key").agg(F.count("*").alias("n")).collect()
    return {r["key"]: r["n"] for r in rows}


def accepted(counts: dict[str, int], threshold: float = 0.5) -> list[str]:
    return sorted(k for k, p in train(counts).items() if p >= threshold)


def all_spans(found: DataFrame, good: list[str]) -> DataFrame:
    """found with column spans: base spans and accepted candidates, by start and kind."""
    picks = F.filter("candidates", lambda c: c["key"].isin(*good)) if good else F.filter("candidates", lambda c: F.lit(False))
    plain = F.transform(picks, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    rank = F.create_map(*[x for k, i in ORDER.items() for x in (F.lit(k), F.lit(i))])
    sortable = F.transform(F.concat("base", plain), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.withColumn("spans", F.array_sort(sortable))


def _shown(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    found = staged(scan(docs), "pii_scan")
    good = accepted(key_counts(found))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return all_spans(found, good).select("doc_id", *map(count, KINDS), F.sha2(_shown("base"), 256).alias("base_sha256"), _shown("spans").alias("spans"))


def redact(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; n_chars follows the text.

    The labelers' statistics come from all of docs; the second pass finds the spans again and writes the text.
    """
    good = frozenset(accepted(key_counts(scan(docs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts, lengths = [], []
            for x in batch.column("text"):
                text = x.as_py()
                if text:
                    base = base_spans(text)
                    spans = sorted([*base, *(c[:3] for c in candidates(text, base) if c[3] in good)], key=lambda s: (s[1], -s[2]))
                    parts, done = [], 0
                    for kind, begin, end in spans:
                        if begin >= done:
                            parts += [text[done:begin], f"[{kind}]"]
                        done = max(done, end)
                    text = "".join([*parts, text[done:]]) if parts else text
                texts.append(text)
                lengths.append(len(text or ""))
            out = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in out:
                out["n_chars"] = pa.array(lengths, pa.int64()).cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], columns)

    return docs.select(*columns).mapInArrow(run, docs.select(*columns).schema)
