"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and telephone numbers; what they find stays. A fifth kind, secrets, is seeded by
assignments such as `token = "..."`. The field is over a document's candidate words, those with a digit, `@`, `+` or `(at)`:
words inside a seed are observed with its kind, words of a match that failed its check (a card number's Luhn sum, an address part over
255) are observed as none, and all others are inferred. Neighbouring candidates share a chain potential; distant candidates that
are the same or end in the same seven digits, also where those are spread over neighbouring words, share a skip potential with
one hub. A hub whose observed words are all of one label has that label, however many repeats are not observed; another hub is
inferred. Sum-product messages run over this graph until they stop changing. In every document with candidates the beliefs add spans:
a run of neighbouring words believed to be of one kind, one of them with CERTAIN of the belief, becomes a span where it is
skip-linked to an observed word of that kind, or where its form can be of that kind (a telephone number without its plus, an address with
`(at)`, a long token after a word such as "password"). Other forms of IP and card numbers come from skip links only.

The weights are those that make labels likeliest given their neighbours (pseudo-likelihood). So that the field doesn't merely
learn the patterns, each seed is learnt a second time with what the pattern saw masked: a telephone number without its plus and
country, or joined by hyphens or points, an address with `(at)`, a secret without its equals sign, each without its neighbours.
COUNTER lists forms that are none. Features are few-valued, so the training table is counts of (features, label), gathered from every
document and bounded by the number of feature values.

Defined results: null and blank texts have no spans; each row is returned; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # kinds that patterns decide
NONE, LABELS = 0, 6  # label k + 1 is KINDS[k]
CERTAIN = 0.9
#: Messages have stopped changing when none moves by more; their step is halved every SWEEPS sweeps, as loops may make them swing.
STILL, SWEEPS = 1e-6, 200

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@+]")
_TAIL = re.compile(r"(?:[0-9@+]|[(\[]at[)\]])[^\x20\x09-\x0D]*")
_ASSIGNED = re.compile(r"[=:][ \t]*[\"']?([A-Za-z0-9+/_\-]{16,})")
_TOKEN = re.compile(r"[A-Za-z0-9+/_\-]{16,}")
_AT = re.compile(r"[A-Za-z0-9._%+-]+[(\[]at[)\]][A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERED = re.compile(r"[0-9().\- ]*[().\-][0-9().\- ]*")
# Words before a value that say what it is.
_NAMED = re.compile(
    r"(?:(token|secret|password|passwd|api[_-]?key|access[_-]?key)|(phone|call|mobile|tel|fax)|(e-?mail|contact))[\"']?(?: is)?[^a-z0-9]{0,4}$",
    re.IGNORECASE,
)
# Forms that are of no kind, and how often each counts as seen.
COUNTER = (
    "2024-01-05", "05.01.2024", "12:30", "1,250.00", "v1.2.3", "4.0", "(2020)", "(3)", "1234567890", "3/4", "978-3-16-148410-0", "20240105123000", "100", "7", "4000",
    "x86-64", "12345-6789", "1-2", "10.5281/zenodo.1234567", "9e107d9d372bb6826bd81d3542a419d6e4f1c2ab", "550e8400-e29b-41d4-a716-446655440000", "308", "555-4315", "@home", "a+b",
)
COUNTED = 25
_EDGE = ".,;:!?\"'[]{}<>"
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Each run of dotted numbers gives its parts in fours."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            parts = list(_NUMBER.finditer(text, run.start(), run.end()))
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                yield four[0].start(), four[3].end(), all(len(p.group().lstrip("0")) <= 3 and int(p.group()[-4:]) <= 255 for p in four)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def patterns(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The spans, by kind and start, and the places of matches that failed their check."""
    spans: list[Span] = []
    failed: list[tuple[int, int]] = []
    if not _HINT.search(text):
        return spans, failed
    spans += [(0, s, e) for s, e in _emails(text)]
    for s, e, good in _addresses(text):
        spans.append((1, s, e)) if good else failed.append((s, e))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19:
            spans.append((2, *m.span())) if _luhn(digits) else failed.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                spans.append((3, *m.span()))
            else:
                failed.append(m.span())
    return spans, failed


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def _named(text: str, start: int) -> int:
    """What the words before say: 1 a secret, 2 a telephone number, 3 an address, 0 nothing."""
    m = _NAMED.search(text, max(0, start - 24), start)
    return m.lastindex if m else 0


def secrets(text: str) -> list[Span]:
    """Values assigned to a name that stands for a secret."""
    if not _HINT.search(text):
        return []
    return [(BASE, *m.span(1)) for m in _ASSIGNED.finditer(text) if _mixed(m.group(1)) and _named(text, m.start() + 1) == 1]


def _candidates(text: str) -> list[tuple[int, int]]:
    """The words with a digit, an at sign or a plus."""
    out, last = [], 0
    for m in _TAIL.finditer(text):
        start = 1 + max(text.rfind(c, last, m.start()) for c in " \n\t\r\v\f")
        out.append((max(start, last), m.end()))
        last = m.end()
    return out


class Field:
    """A document's candidates: places, few-valued features, observed labels (-1: to infer), chain and skip edges."""

    def __init__(self, text: str, spans: list[Span], failed: list[tuple[int, int]]):
        self.places = _candidates(text)
        self.words = [text[s:e] for s, e in self.places]
        n = len(self.places)
        self.labels = [-1] * n
        for label, (s, e) in [(NONE, f) for f in failed] + [(k + 1, (s, e)) for k, s, e in spans]:
            for i in self._overlapping(s, e):
                self.labels[i] = label
        self.chain = [i for i in range(n - 1) if not text[self.places[i][1] : self.places[i + 1][0]].strip(" \t\n\x0b\x0c\r")]
        near = {i: (0, 1) for i in self.chain}
        self.features = [_features(w, i in near, i - 1 in near, _named(text, self.places[i][0])) for i, w in enumerate(self.words)]
        keys = defaultdict(list)
        for last, w in enumerate(self.words):
            key, first = _key(w), last
            if not key and "@" not in w:
                digits = _NOT_DIGIT.sub("", w)
                while digits and len(digits) < 7 and first - 1 in near and "@" not in self.words[first - 1]:
                    first -= 1
                    digits = _NOT_DIGIT.sub("", self.words[first]) + digits
                key = digits[-7:] if len(digits) >= 7 else ""
            if key:
                keys[key].append((first, last))
        #: Places (first, last word) of what repeats, and the words that each group's hub is joined to: edges grow with the words.
        self.repeats = [group for group in keys.values() if len(group) > 1]
        self.groups = [sorted({i for first, last in group for i in range(first, last + 1)}) for group in self.repeats]
        self.skips = [(a, b) for group in self.repeats for (_, a), (_, b) in zip(group, group[1:], strict=False)]  # to learn from

    def _overlapping(self, s: int, e: int) -> Iterator[int]:
        lo, hi = 0, len(self.places)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.places[mid][1] <= s else (lo, mid)
        while lo < len(self.places) and self.places[lo][0] < e:
            yield lo
            lo += 1


def _key(word: str) -> str:
    """What two words must share for a skip edge: a long token, seven last digits, or else the whole word."""
    if len(word) >= 16 and (m := _TOKEN.search(word)) and _mixed(m.group()):
        return m.group().lower()
    digits = _NOT_DIGIT.sub("", word)
    if len(digits) >= 7:
        return digits[-7:]
    core = word.strip(_EDGE).lower()
    return core if len(core) >= 5 and "@" in core else ""


_DIGITS = (0, 1, 4, 7, 8, 10, 11, 16, 20)
_LENGTHS = (0, 8, 16, 32)
#: Forms of a word, in this order; none of them is 0.
_FORMS = tuple(re.compile(x) for x in (r"\([0-9]{3}\)", r"[0-9]{3}[-.][0-9]{4}", r"[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}", r"[0-9]+", r"[0-9]+(?:\.[0-9]+){3}", r"\+[0-9]{1,3}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"))
#: Number of values of each feature; the last three are labels of the candidates before, after, and skip-linked (LABELS: none).
SHAPE = (9, 3, 4, 2, 2, 3, 3, 2, 2, 4, 8, 4, LABELS + 1, LABELS + 1, LABELS + 1)
OWN = len(SHAPE) - 3
OFFSETS = np.concatenate(([0], np.cumsum(SHAPE)))


def _features(word: str, joined_right: bool, joined_left: bool, named: int) -> tuple[int, ...]:
    core = word.strip(_EDGE + "#*$%&|")[:256]
    n = sum("0" <= c <= "9" for c in core)
    letters = [c for c in core.lower() if c.isalpha()]
    form = next((k + 1 for k, x in enumerate(_FORMS) if x.fullmatch(core)), 0)
    return (
        sum(n >= x for x in _DIGITS) - 1, 1 if "@" in core else 2 if _AT.fullmatch(core) else 0, min(core.count("."), 3), int("+" in core), int("(" in core),
        min(core.count("-"), 2), 0 if not letters else 1 if all(c in "abcdef" for c in letters) else 2, int(joined_left), int(joined_right),
        sum(len(core) >= x for x in _LENGTHS) - 1, form, named,
    )


def variants(kind: int, value: str) -> list[str]:
    """A seed's value in forms that no pattern takes."""
    if KINDS[kind] == "phone":
        local = value.split(" ", 1)[1] if " " in value else ""
        digits = _NOT_DIGIT.sub("", value)[-10:]
        groups = (digits[:3], digits[3:6], digits[6:])
        return [local, f"({groups[0]}) {groups[1]}-{groups[2]}", "-".join(groups), ".".join(groups)] if len(digits) == 10 else []
    if KINDS[kind] == "email":
        return [value.replace("@", "(at)"), value.replace("@", "[at]")]
    return ["password is " + value, "token " + value] if KINDS[kind] == "secret" else []


def _lone(text: str, label: int) -> Iterator[tuple[int, ...]]:
    """Rows of a text whose candidates all have one label, and no neighbours beyond it."""
    field = Field(text, [], [])
    joined = set(field.chain)
    for i, f in enumerate(field.features):
        yield (*f, label if i - 1 in joined else LABELS, label if i in joined else LABELS, LABELS, label)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of features and label, with unobserved candidates as none, and of masked seeds."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            if not _HINT.search(text):
                continue
            spans, failed = patterns(text)
            spans = spans + secrets(text)
            field = Field(text, spans, failed)
            labels = [max(x, NONE) for x in field.labels]
            left, right, skip = [LABELS] * len(labels), [LABELS] * len(labels), [LABELS] * len(labels)
            for i in field.chain:
                right[i], left[i + 1] = labels[i + 1], labels[i]
            for a, b in field.skips:
                skip[a], skip[b] = labels[b], labels[a]
            counts.update((*f, a, b, c, y) for f, a, b, c, y in zip(field.features, left, right, skip, labels, strict=True))
            for kind, s, e in spans:
                for other in variants(kind, text[s:e]) if e - s < 256 else ():
                    counts.update(_lone(other, kind + 1))
    rows = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([list(map(int, r)) for r in rows], pa.list_(pa.int32())), pa.array([counts[r] for r in rows], pa.int64())], ["row", "n"])


def learn(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log potentials: by feature value (offsets in SHAPE's order) and label, of chain edges, and of skip edges."""
    table = docs.select(F.col(text).alias("text")).mapInArrow(_counted, "row array<int>, n long").groupBy("row").agg(F.sum("n").alias("n")).orderBy("row").toArrow()
    counts = Counter({tuple(r): n for r, n in zip(table.column("row").to_pylist(), table.column("n").to_pylist(), strict=True)})
    for form in COUNTER:
        for row in _lone(form, NONE):
            counts[row] += COUNTED
    weights = np.zeros((OFFSETS[-1], LABELS))
    rows = np.array(sorted(counts))
    n = np.sqrt([counts[tuple(r)] for r in rows.tolist()])  # tempered, so that rare forms count
    x = np.zeros((len(rows), OFFSETS[-1]))
    for k in range(len(SHAPE)):
        x[np.arange(len(rows)), OFFSETS[k] + rows[:, k]] = 1
    y = np.eye(LABELS)[rows[:, -1]]
    # gradient steps of fixed size on a smooth convex loss, with momentum
    rate, speed = 2.0 / (len(SHAPE) * n.sum()), np.zeros_like(weights)
    for _ in range(600):
        z = x @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + rate * (x.T @ (n[:, None] * (y - p)) - 1e-2 * weights)
        weights += speed
    left, right, skip = (weights[OFFSETS[OWN + k] : OFFSETS[OWN + k] + LABELS] for k in range(3))
    return weights[: OFFSETS[OWN]], (left + right.T) / 2, (skip + skip.T) / 2


def infer(field: Field, potentials: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Beliefs (candidate, label) after loopy sum-product message passing."""
    unary, chain, skip = potentials
    own = unary[OFFSETS[:OWN] + np.array(field.features)].sum(axis=1)
    own = np.exp(own - own.max(axis=1, keepdims=True))
    for i, label in enumerate(field.labels):
        if label >= 0:
            own[i] = np.eye(LABELS)[label]
    n = len(own)
    hubs = np.ones((len(field.groups), LABELS))
    for k, group in enumerate(field.groups):
        seen = {field.labels[i] for i in group if field.labels[i] >= 0}
        if len(seen) == 1:
            hubs[k] = np.eye(LABELS)[seen.pop()]
    own = np.concatenate((own, hubs))
    edges = [(i, i + 1, chain) for i in field.chain] + [(i, n + k, skip) for k, group in enumerate(field.groups) for i in group]
    if not edges:
        return own / own.sum(axis=1, keepdims=True)
    source = np.array([e[0] for e in edges] + [e[1] for e in edges])
    target = np.array([e[1] for e in edges] + [e[0] for e in edges])
    tables = np.exp(np.stack([e[2] for e in edges] + [e[2].T for e in edges]))
    back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    messages = np.full((len(source), LABELS), 1.0 / LABELS)
    # what is observed stays so, however many messages speak against it
    given = np.where(own > 0, np.log(np.maximum(own, 1e-300)), -1e9)
    step, sweeps = 0.5, 0
    while True:
        logs = np.log(np.maximum(messages, 1e-30))
        total = given.copy()
        np.add.at(total, target, logs)
        out = total[source] - logs[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.einsum("el,elk->ek", out, tables)
        new /= new.sum(axis=1, keepdims=True)
        change = np.abs(new - messages).max()
        messages = (1 - step) * messages + step * new
        sweeps += 1
        if change < STILL or step * change < STILL * STILL:
            break
        if sweeps % SWEEPS == 0 and (hubs.min(axis=1, initial=1) > 0).any():
            step /= 2
    total = given.copy()
    np.add.at(total, target, np.log(np.maximum(messages, 1e-30)))
    beliefs = np.exp(total - total.max(axis=1, keepdims=True))
    return (beliefs / beliefs.sum(axis=1, keepdims=True))[:n]


def _may_add(field: Field, potentials: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bool:
    """Whether any word not observed can reach CERTAIN: its own potential, and the most that its messages can say for a kind."""
    unary, chain, skip = potentials
    free = np.array([i for i, label in enumerate(field.labels) if label < 0], dtype=np.int64)
    if not len(free):
        return False
    hubs = np.zeros(len(field.labels))
    for group in field.groups:
        hubs[group] += 1
    own = unary[OFFSETS[:OWN] + np.array(field.features)[free]].sum(axis=1)
    ahead = own - own[:, :1]
    most = 2 * np.maximum((chain - chain[:, :1]).max(axis=0), (chain.T - chain.T[:, :1]).max(axis=0))
    reach = ahead + most + hubs[free, None] * np.maximum(0, (skip - skip[:, :1]).max(axis=0))
    return bool((reach[:, 1:] >= np.log(CERTAIN / (1 - CERTAIN)) - 1e-9).any())


def _fits(kind: str, value: str) -> bool:
    """Whether a value that nothing links to a seed has a form of the kind."""
    if kind == "phone":
        return bool(_NUMBERED.fullmatch(value)) and 10 <= len(_NOT_DIGIT.sub("", value)) <= 15
    if kind == "email":
        return bool(_AT.fullmatch(value))
    return kind == "secret" and bool(_TOKEN.fullmatch(value)) and _mixed(value)


def find(text: str, potentials) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all spans; sorted by kind, then start."""
    spans, failed = patterns(text)
    if not _HINT.search(text) and "(at)" not in text and "[at]" not in text:
        return spans, spans
    seeds = spans + secrets(text)
    field = Field(text, seeds, failed)
    if not field.words or not _may_add(field, potentials):
        return spans, seeds
    linked: dict[int, set[int]] = defaultdict(set)
    whole = {i: place for group in field.repeats for place in group for i in range(place[0], place[1] + 1)}
    for group in field.groups:
        seen = {field.labels[i] for i in group if field.labels[i] > NONE}
        for i in group:
            if field.labels[i] < 0:
                linked[i] |= seen
    beliefs = infer(field, potentials)
    best = np.where(np.array(field.labels) < 0, beliefs.argmax(axis=1), NONE)
    joined, more, i = set(field.chain), set(), 0
    while i < len(best):
        label, last = int(best[i]), i
        while label and last in joined and best[last + 1] == label:
            last += 1
        run, first, i = range(i, last + 1), i, last + 1
        if not label or max(beliefs[k, label] for k in run) < CERTAIN:
            continue
        known = [k for k in run if label in linked.get(k, ())]
        # a repeat starts and ends where its digits do
        for k in known:
            if all(field.labels[j] < 0 for j in range(whole[k][0], whole[k][1] + 1)):
                first, last = min(first, whole[k][0]), max(last, whole[k][1])
        i = max(i, last + 1)
        head, tail = field.words[first], field.words[last]
        s = field.places[first][0] + len(head) - len(head.lstrip(_EDGE))
        e = field.places[last][1] - len(tail) + len(tail.rstrip(_EDGE))
        if KINDS[label - 1] == "secret":
            more |= {(label - 1, *m.span()) for m in _TOKEN.finditer(text, s, e) if _mixed(m.group()) and (known or _fits("secret", m.group()))}
        elif s < e and (known or _fits(KINDS[label - 1], text[s:e])):
            more.add((label - 1, s, e))
    return spans, sorted({*seeds, *more})


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


#: Columns beside doc_id.
OUT = {"n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long", "base_sha256": "string", "spans": "string", "n_spans": "long", "n_added": "long"}


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = find(text.as_py() or "", shared.value)
                joined = _joined(base)
                counts = Counter(k for k, _, _ in base)
                rows.append((*(counts[k] for k in range(BASE)), hashlib.sha256(joined.encode()).hexdigest(), _joined(every), len(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(OUT)
            types = [pa.string() if t == "string" else pa.int64() for t in OUT.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *OUT])

    return run


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, the number of pattern spans of each kind, their digest, all spans as kind:start:end, and the number of these and of added ones."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _scan(shared), ", ".join(f"{n} {t}" for n, t in {"doc_id": "long", **OUT}.items())
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; where spans overlap, the one that starts first. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(at):
                t = x.as_py()
                spans = find(t, shared.value)[1] if t else []
                parts, last = [], 0
                for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= last:
                        parts += [t[last:s], f"[{KINDS[k].upper()}]"]
                        last = e
                    else:
                        last = max(last, e)
                out.append("".join([*parts, t[last:]]) if spans else t)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
