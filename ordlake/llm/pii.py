"""Operator 2: personal data by candidate generation and gradient boosting.

Generators of high recall propose overlapping spans. Boosted trees score each span by its format (digits, checks,
separators) and its context (words and signs before it). A threshold for each kind, calibrated on held-out
examples for precision, selects what is redacted. Spans that the contract's patterns accept always stay.

There is no table of labelled personal data, so the trees learn from examples that this module writes itself
(bounded by EXAMPLES): values of each kind in sentences that call for them, against values that look alike in the
wrong context or with wrong checks. Thresholds are calibrated on a second family of sentences, formats and contexts
that the trees have not seen.

Defined results: a null text is empty; positions are code points, end exclusive; equal texts and repeated rows give
equal spans; an empty table gives an empty result; other columns are untouched, and where the input has a column of
the result's name already, the result's name gets underscores until it is free. Texts are read PART bytes at a time.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .boosting import BoostedTrees
from .common import new_column

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret", "national_id", "iban"]
SPAN = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
#: Examples written for training and calibration, and the precision asked of each kind.
EXAMPLES, PRECISION, SEED = 9000, 0.97, 7
#: Bytes of text searched at a time.
PART = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Each alternative below equals the contract's pattern but starts only where a longest match can start, so long
# runs of digits or letters take linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_IP_ANY = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_GENERATORS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,10}")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.,+-])\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}[ .-][0-9]{4,6}[ .-][0-9]{4,5}(?:[ .-][0-9]{1,4})?(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}")),
    ("national_id", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
]
# Words before a value that call for its kind, and words of numbers and texts that look alike.
_CALLS = {
    "email": ["mail", "contact", "write", "reach", "ask"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "master", "amex", "paid", "charge", "credit", "debit"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "cell", "number", "ring"],
    "secret": ["key", "token", "secret", "passw", "pwd", "auth", "bearer", "credential"],
    "national_id": ["ssn", "social", "insur", "national id", "tax"],
    "iban": ["iban", "account", "bank", "transfer", "wire"],
}
_LOOKALIKES = {
    "numbers": ["order", "ref", "part", "serial", "isbn", "invoice", "page", "track", "version", "build", "date", "section", "item"],
    "hashes": ["commit", "sha", "md5", "checksum", "hash", "etag", "digest", "revision", "uuid"],
    "paths": ["file", "http", "see", "path", "url", "www"],
}
WINDOW = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) that the contract's patterns accept."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end(), "email"))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) <= 255 or p.lstrip("0") == "" or len(p.lstrip("0")) < 4 and int(p.lstrip("0")) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((*m.span(), "phone"))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping spans that may be personal data; far more than are."""
    return [(*m.span(), kind) for kind, pattern in _GENERATORS for m in pattern.finditer(text)]


def iban_holds(s: str) -> bool:
    """The public check of account numbers: the number with its first four signs put last is 1 modulo 97."""
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def national_id_holds(s: str) -> bool:
    """No part of the number is all zeros, and the first is none of those that are never given out."""
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


_CHECKS = {"iban": iban_holds, "national_id": national_id_holds}
_CLASS = str.maketrans({c: k for k, own in (("d", "0123456789"), ("u", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("l", "abcdefghijklmnopqrstuvwxyz")) for c in own})


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span, and the words and signs beside it."""
    s = text[start:end]
    before, after = text[max(0, start - WINDOW) : start].lower(), text[end : end + 2]
    digits = [c for c in s if "0" <= c <= "9"]
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(n / len(s) * np.log2(n / len(s)) for n in counts)
    form = s.translate(_CLASS)
    turns = sum(x != y for x, y in zip(form, form[1:], strict=False))
    low = s.lower()
    holds = _CHECKS[kind](s) if kind in _CHECKS else bool(digits) and luhn("".join(digits))
    shape = [len(s), len(digits), form.count("u"), form.count("l"), sum(c in " -." for c in s), len(counts), entropy, float(holds), float(s[:1] == "("), float(all(c in "0123456789abcdef" for c in s)), turns / len(s), sum(low.count(c) for c in "aeiou") / max(1, form.count("u") + form.count("l")), s.count("/"), float(len(digits) == len(s))]
    signs = [float(c in before[-4:]) for c in "=:\"'#/"] + [float(after[:1] in ("\"", "'")), float("%" in after)]
    return [float(kind == k) for k in KINDS] + shape + signs + [float(any(w in before for w in _CALLS[kind])), *[float(any(w in before for w in own)) for own in _LOOKALIKES.values()]]


def _examples(seed: int, n: int, family: int) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, label) from one of two families of sentences, formats and contexts."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    token = lambda k, a=letters: "".join(r.choice(a) for _ in range(k))
    syllables = [["an", "er", "le", "ti", "on", "th"], ["mo", "ra", "que", "st", "in", "del", "é"]][family]
    prose = lambda k: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(k))
    word = lambda: prose(1)
    pick = lambda x, y: [x, y][family]

    def checked(k: int, right: bool) -> str:
        """k digits whose check digit is right, or is not."""
        body = digits(k - 1)
        return body + r.choice([c for c in "0123456789" if luhn(body + c) == right])

    def grouped(s: str, sign: str) -> str:
        return sign.join(s[i : i + 4] for i in range(0, len(s), 4))

    def iban(right: bool) -> str:
        country, body = r.choice(pick(["DE", "FR", "GB"], ["ES", "IT", "NL"])), digits(r.choice([14, 16, 18]))
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        check = 98 - rest if right else (98 - rest + r.randint(1, 90)) % 97 + 2
        s = f"{country}{check:02d}{body}"
        return grouped(s, pick(" ", "")) if len(s) % 4 == 0 or family == 0 else grouped(s, " ")

    def national(right: bool) -> str:
        s = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
        return s if right else r.choice([f"{r.randint(900, 999)}{s[3:]}", f"{s[:4]}00{s[6:]}", f"{s[:7]}0000"])

    hexes = "0123456789abcdef"
    good = [
        ("email", lambda: f"{token(6)}{r.choice(pick(['[at]', ' at ', '(at)'], [' [at] ', ' (at) ', ' at ']))}{word()}{r.choice(pick(['[dot]', ' dot '], [' (dot) ', ' [dot] ']))}{r.choice(['com', 'org', 'net'])}", pick(["mail ", "contact: ", ""], ["write to ", "reach me: ", "e-mail "])),
        ("phone", lambda: pick(r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", "-".join([digits(3), digits(3), digits(4)])]), f"{digits(3)} {digits(3)}-{digits(4)}"), pick(["call ", "phone: ", "tel "], ["mobile ", "telephone ", "call me: "])),
        ("card", lambda: grouped(checked(16, True), pick(".", r.choice(" .-"))), pick(["card ", "visa: ", "paid with "], ["credit card ", "my card: ", "visa no "])),
        ("secret", lambda: token(r.choice(pick([24, 32, 40], [20, 28, 36, 48]))), pick(["key = \"", "token: ", "secret='", "password="], ["pwd=", "auth: ", "api_token = '", "bearer "])),
        ("secret", lambda: token(r.choice(pick([32, 64], [40, 48])), hexes), pick(["token = \"", "key: ", "secret = '"], ["auth_key=\"", "password: ", "client_secret='"])),
        ("national_id", lambda: national(True), pick(["ssn ", "social security: "], ["ssn: ", "social insurance no ", "social no "])),
        ("iban", lambda: iban(True), pick(["iban ", "account: ", ""], ["bank account ", "transfer to ", "iban: "])),
    ]
    bad = [
        ("email", lambda: f"{word()} at {word()} dot {word()[:8]}", pick(["we met ", "the "], ["met her ", "all ", ""])),
        ("phone", lambda: f"{r.randint(1900, 2030)} {digits(3)} {digits(3)}", pick(["order ", "date ", "version "], ["invoice ", "page ", ""])),
        ("phone", lambda: f"{digits(3)} {digits(3)}-{digits(4)}", pick(["part ", "serial ", "ref "], ["order ", "tracking ", "isbn "])),
        ("card", lambda: grouped(digits(12), "-"), pick(["ref ", "order ", "part "], ["serial ", "tracking ", "invoice "])),
        ("card", lambda: grouped(checked(16, False), r.choice(" .-")), pick(["card ", "order ", ""], ["credit card ", "serial ", ""])),
        ("card", lambda: grouped(checked(16, True), "."), pick(["serial ", "part ", "version "], ["tracking ", "ref ", "build "])),
        ("secret", lambda: prose(8).replace(" ", r.choice(pick("-_/", "/_"))), ["the ", "see ", "", "in "]),
        ("secret", lambda: r.choice("=-_/") * r.randint(20, 60), ["", "\n"]),
        ("secret", lambda: prose(12).replace(" ", ""), pick(["", "the ", "key "], ["of ", "token: ", ""])),
        ("secret", lambda: token(r.choice(pick([40, 64], [32, 40])), hexes), pick(["commit ", "sha ", "checksum: "], ["md5: ", "etag=\"", "hash ", "commit: "])),
        ("secret", lambda: digits(r.randint(20, 40)), pick(["order ", "ref ", ""], ["tracking ", "invoice: ", ""])),
        ("secret", lambda: "/".join(token(6, letters[:26]) for _ in range(5)), pick(["file ", "http://"], ["see ", "https://"])),
        ("national_id", lambda: national(False), pick(["ssn ", "id ", ""], ["social no ", "number ", ""])),
        ("national_id", lambda: national(True), pick(["part ", "serial ", "ref "], ["order ", "invoice ", "tracking "])),
        ("iban", lambda: f"{token(2, 'ABCDEFGHIJ')}{digits(2)} {token(4, 'ABCDEFGHIJKLMNOP')} {token(4, 'ABCDEFGHIJKLMNOP')}", ["THE ", "SECTION ", ""]),
        ("iban", lambda: iban(False), pick(["part ", "iban ", ""], ["serial ", "account ", ""])),
    ]
    out = []
    for i in range(n):
        kind, value, contexts = r.choice(bad if i % 2 else good)
        head = f"{prose(3)} {r.choice(contexts)}"
        s = value()
        end = "\"" if head.endswith("\"") else "'" if head.endswith("'") else ""
        out.append((f"{head}{s}{end} {prose(2)}", len(head), len(head) + len(s), kind, 1 - i % 2))
    return out


@cache
def trained(seed: int = SEED) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees, and for each kind the threshold of most recall that keeps PRECISION on the second family (the middle of equals)."""
    rows, held = _examples(seed, EXAMPLES, 0), _examples(seed + 1, EXAMPLES // 2, 1)
    model = BoostedTrees().fit(np.array([features(*e[:4]) for e in rows]), np.array([e[4] for e in rows], dtype=float))
    score, y = model.predict(np.array([features(*e[:4]) for e in held])), np.array([e[4] for e in held])
    kinds = np.array([e[3] for e in held])
    thresholds = {}
    for kind in KINDS:
        own = kinds == kind
        kept = [(y[own & (score >= c)].sum(), c) for c in np.linspace(0.02, 0.99, 98) if (own & (score >= c)).any() and y[own & (score >= c)].mean() >= PRECISION]
        best = [c for n, c in kept if n == max(kept)[0]]
        thresholds[kind] = float(best[len(best) // 2]) if best else 1.0
    return model, thresholds


class Taken:
    """Disjoint intervals in order; those that are added must start after all others or meet none but the last."""

    def __init__(self) -> None:
        self.starts, self.ends = [], []

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.ends[i] > start

    def add(self, start: int, end: int) -> None:
        if self.meets(start, end):
            self.ends[-1] = max(self.ends[-1], end)
        else:
            i = bisect_left(self.starts, start)
            self.starts.insert(i, start)
            self.ends.insert(i, end)


def find_all(texts: list[str], model: BoostedTrees, thresholds: dict[str, float]) -> list[list[tuple]]:
    """(kind, start, end, score, base) of every text, by start, then kind."""
    base = [base_spans(t) for t in texts]
    rows, x = [], []
    for i, t in enumerate(texts):
        taken = Taken()
        for start, end, _ in sorted(base[i]):
            taken.add(start, end)
        for start, end, kind in candidates(t):
            if not taken.meets(start, end):
                rows.append((i, start, end, kind))
                x.append(features(t, start, end, kind))
    chosen: list[list[tuple]] = [[(k, a, b, 1.0, True) for a, b, k in spans] for spans in base]
    if rows:
        score = model.predict(np.array(x))
        free: dict[int, Taken] = {}
        for k in np.argsort(-score, kind="stable"):  # best first; a span that overlaps a better one goes
            i, start, end, kind = rows[k]
            own = free.setdefault(i, Taken())
            if score[k] >= thresholds[kind] and not own.meets(start, end):
                own.add(start, end)
                chosen[i].append((kind, start, end, float(score[k]), False))
    return [sorted(c, key=lambda s: (s[1], KINDS.index(s[0]))) for c in chosen]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def find(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs with an array of spans (kind, start, end, score, base)."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    names = ["kind", "start", "end", "score", "base"]

    def some(text: pa.Array) -> pa.Array:
        found = find_all([t or "" for t in text.to_pylist()], *shared.value)
        return pa.array([[dict(zip(names, s, strict=True)) for s in spans] for spans in found], _SPANS)

    def run(text: pa.Array) -> pa.Array:
        return bytehash.by_bytes(text, some, _SPANS, PART)

    return new_column(docs, out_col, F.arrow_udf(run, SPAN)(F.col(text_col)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", pii_col: str = "pii", out_col: str = "redacted") -> DataFrame:
    """docs with every found span replaced by its kind in brackets; overlapping spans are merged under the first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        grown = F.concat(a["done"], F.when(fresh, F.concat(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
        return F.struct(grown.alias("done"), F.greatest(a["at"], s["end"]).alias("at"))

    return new_column(docs, out_col, F.aggregate(pii_col, start, step, lambda a: F.concat(a["done"], F.substr(text, a["at"] + 1))))
