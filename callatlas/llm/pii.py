"""Personal data: fixed patterns, and weakly supervised spans beyond them.

Regex, gazetteer and context labellers vote on candidate spans; expectation-maximisation over the vote patterns of all
documents estimates how reliable each of them is; the posteriors train a span classifier, which decides.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, text_bytes
from .weak import expectation_maximisation, logistic

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("name", "number", "handle")

#: Fixed patterns, each from a place where a match can begin (see the finders).
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Fixed word lists of the gazetteer and context labellers, without accents.
FIRST_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah "
    "charles karen christopher nancy daniel lisa matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew "
    "donna joshua michelle kenneth carol kevin amanda brian melissa george deborah edward stephanie anna maria peter laura julia hans klaus "
    "ursula monika petra sabine wolfgang juergen dieter helga andreas stefan martina claudia pierre marie jean claude nathalie isabelle "
    "francois jacques michel sylvie elodie camille luc antoine jose carmen carlos lucia juan ana luis elena miguel pablo sofia diego javier "
    "manuel rosa pilar ahmed fatima mohammed ali omar aisha wei mei li yuki hiroshi akira olga ivan natasha sergei dmitri svetlana raj priya "
    "anil giovanni giulia marco paolo francesca lars ingrid erik astrid jan katarzyna piotr joao".split())
HONORIFICS = frozenset("mr mrs ms dr prof sir herr frau monsieur madame mme senor senora don dona".split())
CONTACT = frozenset("call phone tel telephone fax mobile contact contacts reach whatsapp email mail write ssn passport born account card iban customer patient employee address name dear regards sincerely signed by from author".split())
NOT_PERSONAL = frozenset("page pages isbn issn version chapter figure table section vol volume issue build error line item order year since kg km eur usd percent street avenue river lake mount north south east west new san saint university institute license public general under".split())
FUNCTION = frozenset("the of and to in a is that for it on with as was by at be this are or from when if but not she he they we you le la les de des du un une et en que qui dans pour au sur par ou avec der die das und ist von den mit zu ein eine auf nicht sich el los las y es con para su lo del por".split())
DOMAINS = frozenset("com org net edu gov info io co uk de fr es it nl eu ch at us ru jp cn br in".split())

PART = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+"
NAME = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])(?:\p{{Lu}}\.(?= )|{PART})(?: (?:\p{{Lu}}\.(?= )|{PART}))++(?![\p{{L}}\p{{M}}\p{{N}}_])")
NUMBER = re.compile(r"[0-9](?:[0-9() .-]*[0-9])?")
HANDLE = re.compile(r" ?(?:\(at\)|\[at\]| at ) ?([A-Za-z0-9-]+)((?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+)")
WORD = re.compile(r"[^\W\d_]+")
LABELLERS = ("regex", "shape", "gazetteer", "boundary", "context before", "context after", "near fixed data")
#: Groups of digits that cards, phones and social security numbers are written in.
GROUPS = frozenset(((15,), (16,), (4, 4, 4, 4), (4, 6, 5), (3, 3, 4), (3, 2, 4), (2, 2, 2, 2, 2), (1, 3, 3, 4)))
#: Features of a candidate of one kind.
FEATURES = 72
#: Characters around a candidate that count as its context, and from it to fixed data that count as near.
BEFORE, AFTER, NEAR = 40, 24, 80


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """A match begins where the run of local characters before its @ does, or where the match before it ended."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def _ips(text: str):
    """Leftmost matches take the parts of a dotted run four by four."""
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str):
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed kinds, by kind as listed, then start."""
    out = []
    for kind, find in zip(BASE_KINDS, (_emails, _ips, _cards, _phones)):
        out += [(kind, a, b) for a, b in find(text)]
    return out


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    votes: str
    features: tuple[int, ...]
    fixed: bool


def plain(word: str) -> str:
    """A word in lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _names(text: str):
    """Runs of capitalised words without what opens them: function words, honorifics, words of contact."""
    for m in NAME.finditer(text):
        parts, start, skip = m[0].split(" "), m.start(), 0
        while skip < len(parts) and ((w := plain(parts[skip])) in CONTACT or w in HONORIFICS or w in FUNCTION):
            start += len(parts[skip]) + 1
            skip += 1
        if len(parts) - skip > 1:
            yield start, m.end()


def _numbers(text: str):
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 7 and len(NOT_DIGIT.sub("", m[0])) >= 7:
            yield m.span()


def _handles(text: str):
    low = 0
    for m in HANDLE.finditer(text):
        start = low + len(text[low : m.start()].rstrip(LOCAL))
        if start < m.start():
            yield start, m.end()
        low = m.end()


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[Candidate]:
    """Spans that may be personal data beyond the fixed ones, which they don't overlap, and the fixed cards and phones as
    examples of numbers, with the labellers' votes."""
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], sorted(b for _, b in taken)
    longest = max((b - a for a, b in taken), default=0)
    out = [_judge(text, "number", a, b, starts, ends, True) for kind, a, b in base if kind in ("card", "phone")]
    for kind, find in zip(EXTRA_KINDS, (_names, _numbers, _handles)):
        for a, b in find(text):
            lo, hi = bisect_left(starts, a - longest), bisect_left(starts, b)
            if not any(y > a for _, y in taken[lo:hi]):
                out.append(_judge(text, kind, a, b, starts, ends, False))
    return out


def _vote(yes: bool, no: bool) -> str:
    return "+" if yes else "-" if no else "."


def _judge(text: str, kind: str, a: int, b: int, starts: list[int], ends: list[int], fixed: bool) -> Candidate:
    span, left, right = text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]
    before = [plain(w) for w in WORD.findall(text[max(0, a - BEFORE) : a])][-4:]
    after = [plain(w) for w in WORD.findall(text[b : b + AFTER])][:2]
    words = [plain(w) for w in WORD.findall(span)] if kind != "number" else []
    digits = len(NOT_DIGIT.sub("", span))
    groups = tuple(len(g) for g in re.findall("[0-9]+", span))
    k = bisect_left(ends, a - NEAR) if not fixed else len(ends)
    near = not fixed and ((k < len(ends) and ends[k] <= a) or ((j := bisect_left(starts, b)) < len(starts) and starts[j] - b <= NEAR))
    line = left in ("", "\n")
    glued = left.isalnum() or right.isalnum() or "_" in (left, right)
    if kind == "number":
        shape = _vote(groups in GROUPS, len(groups) == 1 and digits <= 12 or digits > 19 or len(groups) > 6)
        gazetteer, boundary = ".", _vote(False, glued or left in "#$€£" and left != "" or right in "%€$£°" and right != "")
    elif kind == "name":
        opening = text[max(0, a - 2) : a].strip()
        shape = _vote(2 <= len(words) <= 4 and any(len(w) == 1 for w in words[1:-1]), len(words) > 4 or len(set(words)) < len(words) or line or opening in (".", "!", "?"))
        gazetteer = _vote(words[0] in FIRST_NAMES, any(w in NOT_PERSONAL or w in FUNCTION for w in words))
        boundary = _vote(False, glued or any(len(w) < 2 for w in (words[0], words[-1])))
    else:
        shape = _vote("(" in span or "[" in span, plain(span.split(" ", 1)[0]) in FUNCTION)
        gazetteer, boundary = _vote(words[-1:] != [] and words[-1] in DOMAINS, True), _vote(False, glued)
    ahead = _vote(any(w in CONTACT or w in HONORIFICS for w in before), any(w in NOT_PERSONAL for w in before[-2:]))
    behind = _vote(False, any(w in NOT_PERSONAL for w in after))
    votes = _vote(fixed, False) + shape + gazetteer + boundary + ahead + behind + _vote(near, False)
    features = (
        0 + min(len(groups), 7), 8 + min(digits, 20), 29 + min(b - a, 59) // 5, 41 + line, 43 + "+-.".index(shape), 46 + "+-.".index(gazetteer), 49 + "+-.".index(boundary),
        52 + "+-.".index(ahead), 55 + "+-.".index(behind), 58 + near, 60 + ("(" in span), 62 + ("-" in span), 64 + min(len(words), 7))
    return Candidate(kind, a, b, votes, tuple(EXTRA_KINDS.index(kind) * FEATURES + f for f in features), fixed)


@dataclass
class PiiModel:
    reliability: dict[str, np.ndarray]
    posterior: dict[tuple[str, str], float]
    weights: np.ndarray
    bias: float
    n_candidates: int

    def score(self, c: Candidate) -> float:
        return float(self.weights[list(c.features)].sum() + self.bias)


def train_pii(docs: DataFrame) -> PiiModel:
    """Learn from unlabelled documents (text; other columns are ignored).

    The votes and features of every candidate in every whole text are counted; both take few values, so what comes to the
    driver is the number of candidates of each combination that occurs (7 votes and 13 features of a few values each), whatever
    the size of the corpus. Expectation-maximisation runs for each kind of candidate, with every labeller better than chance;
    the classifier is a logistic regression on the posteriors, whose features leave out the fixed patterns' vote, so that it
    finds what looks like their matches. Null and empty texts have no candidates; repeated rows count as often as they occur;
    without candidates nothing is found later.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch["bytes"]:
                text = t.as_py().decode()
                counts.update(f"{c.kind} {c.votes} {','.join(map(str, c.features))}" for c in candidates(text, base_spans(text)))
        names = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[x] for x in names], pa.int64())], ["combination", "n"])

    rows = docs.select(text_bytes().alias("bytes")).mapInArrow(run, "combination string, n bigint").groupBy("combination").agg(F.sum("n").alias("n")).collect()
    found = sorted((*r["combination"].split(" "), r["n"]) for r in rows)
    reliability, posterior = {}, {}
    for kind in EXTRA_KINDS:
        patterns: Counter = Counter()
        for k, v, _, n in found:
            if k == kind:
                patterns[v] += n
        reliability[kind], _, p = expectation_maximisation(patterns, len(LABELLERS), prior=0.2, trust=0.85, better=0.6)
        posterior |= {(kind, v): x for v, x in p.items()}
    if not found:
        return PiiModel(reliability, posterior, np.zeros(FEATURES * len(EXTRA_KINDS)), -1.0, 0)
    x = np.zeros((len(found), FEATURES * len(EXTRA_KINDS)), np.float32)
    for i, (_, _, f, _) in enumerate(found):
        x[i, [int(k) for k in f.split(",")]] = 1
    w, b = logistic(x, np.array([posterior[k, v] for k, v, _, _ in found]), np.array([n for *_, n in found], float))
    return PiiModel(reliability, posterior, w, b, sum(n for *_, n in found))


SCHEMA = "doc_id bigint, base array<struct<kind:string,start:bigint,end:bigint>>, extra array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_pii(docs: DataFrame, model: PiiModel, least: float = 0.0) -> DataFrame:
    """Personal data in each whole text: doc_id, base and extra spans, in code points, end exclusive.

    docs: doc_id, text; other columns, also ones named base or extra, are ignored. base has the fixed kinds email, ip, card and phone, by kind, then start;
    extra has those candidates (kinds name, number and handle; they overlap no base span) whose log odds reach `least`.
    Null texts are empty; empty texts have no spans; repeated rows give equal rows; an empty table gives none.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        m = model  # goes with the function: FEATURES weights a kind and a few hundred posteriors
        span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
        base_type, extra_type = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("score", pa.float64())]))
        for batch in batches:
            base, extra = [], []
            for t in batch["bytes"]:
                text = t.as_py().decode()
                fixed = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in fixed])
                judged = sorted(((EXTRA_KINDS.index(c.kind), c.start, c.end, m.score(c)) for c in candidates(text, fixed) if not c.fixed) if m.n_candidates else ())
                extra.append([{"kind": EXTRA_KINDS[k], "start": a, "end": b, "score": s} for k, a, b, s in judged if s >= least])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base, base_type), pa.array(extra, extra_type)], ["doc_id", "base", "extra"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("bytes")).mapInArrow(run, SCHEMA)
