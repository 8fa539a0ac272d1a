"""PII (3): exact patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole spans by their shape, their digits, their checks and what stands beside
them; a dynamic programme over segments of at most ``MOST`` atoms chooses boundaries and kinds
together. A span without a digit or an @ cannot be an entity, so a text falls apart into short
regions around those, which are decoded one by one, exactly. Weights are learned here, from
regions whose entities are the pattern's spans, and from spans that fail their check.
"""

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aidlens.llm import common

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the four kinds.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches as the ip pattern, as each begins and ends with a whole run of digits, but a
#: long run is tried once and not from each of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
MOST = 24  # atoms of a span
MARGIN = 48  # code points that a region has beside its first and last digit or @
GAP = 8  # longest way between two of them within a region
_TRIGGER = re.compile(r"[0-9@](?:[^0-9@]{0,%d}[0-9@])*" % GAP)
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s|[\W_]|\w")
_DIGITS = re.compile(r"[^0-9]")
_SPACE = re.compile(r"\s")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The check that a match of a kind's pattern must pass."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))
    digits = _DIGITS.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Valid matches of each kind's pattern, leftmost and non-overlapping within the kind."""
    out = []
    for k, kind in enumerate(KINDS):
        if (kind == "email" and "@" not in text) or (kind == "phone" and "+" not in text):
            continue
        if kind == "email":
            out += [(*m, k) for m in _emails(text)]
            continue
        for m in (_IP if kind == "ip" else PATTERNS[kind]).finditer(text):
            if valid(kind, m[0]):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @ so that long words cost no more."""
    done, at = 0, text.find("@")
    name, host = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    while at >= 0:
        start = at
        while start > done and name.match(text[start - 1]):
            start -= 1
        m = host.match(text, at + 1)
        if m and start < at:
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


# --- regions and features ---------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches around digits and @ that hold every possible entity of at most MARGIN reach."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        left, right = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        gap = [x.end() for x in _SPACE.finditer(text, left, m.start())]
        left = gap[-2] if len(gap) > 1 else gap[0] if gap else left
        after = _SPACE.search(text, m.end(), right)
        right = after.start() if after else right
        if out and left <= out[-1][1]:
            out[-1] = (out[-1][0], right)
        else:
            out.append((left, right))
    return out


def _shape(atoms: list[str]) -> str:
    return "".join(f"9{min(len(a), 20)}" if a[0].isdigit() else "a" if a[0].isalpha() else "_" if a.isspace() else a for a in atoms)


def features(atoms: list[str], i: int, j: int) -> list[str]:
    """Features of the span of atoms i to j; empty where no entity can be."""
    span = atoms[i:j]
    text = "".join(span)
    if span[0].isspace() or span[-1].isspace() or not any(c in text for c in "0123456789@"):
        return []
    digits = _DIGITS.sub("", text)
    n, shape, dots, at = len(digits), _shape(span), text.count("."), text.count("@")
    before = atoms[i - 1] if i else "^"
    after = atoms[j] if j < len(atoms) else "$"
    kind = lambda a: "9" if a[0].isdigit() else "a" if a[0].isalpha() else "_" if a.isspace() else a
    ends = shape if at == 0 else "mail"
    checks = []
    if at == 1 and PATTERNS["email"].fullmatch(text):
        checks.append("is=address")
    if n == len(text) - dots and dots == 3 and PATTERNS["ip"].fullmatch(text):
        checks.append("octets" if valid("ip", text) else "no-octets")
    if at == 0 and not any(c.isalpha() for c in text):
        if 12 <= n <= 19:
            checks.append("luhn" if luhn(digits) else "no-luhn")
        checks.append(f"plus={text[0] == '+'}|{n}")
    return [
        f"shape={ends}", f"n={min(n, 20) if at == 0 else 'mail'}", f"at={at}|{min(dots, 4)}", f"first={kind(span[0])}", f"last={kind(span[-1])}",
        f"before={kind(before)}", f"after={kind(after)}", f"letters={any(c.isalpha() for c in text)}|{at}", *checks,
    ]


class Field:
    """Weights of a semi-Markov field: a score for each kind and feature of a span."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}

    def scores(self, feats: list[str]) -> list[float]:
        out = [0.0] * len(KINDS)
        for f in feats:
            w = self.weights.get(f)
            if w:
                for k in range(len(KINDS)):
                    out[k] += w[k]
        return out

    def segments(self, atoms: list[str]) -> list[tuple[int, int, list[str], list[float]]]:
        n = len(atoms)
        return [(i, j, f, self.scores(f)) for i in range(n) for j in range(i + 1, min(n, i + MOST) + 1) if (f := features(atoms, i, j))]

    def decode(self, atoms: list[str]) -> list[Span]:
        """The best joint choice of segments, as atom positions; what lies between scores 0.

        Segments are scored as the programme reaches their end, so a long region costs memory
        for its atoms only.
        """
        best, back = [0.0] * (len(atoms) + 1), [None] * (len(atoms) + 1)
        for j in range(1, len(atoms) + 1):
            best[j] = best[j - 1]
            for i in range(max(0, j - MOST), j):
                feats = features(atoms, i, j)
                if not feats:
                    continue
                s = self.scores(feats)
                k = max(range(len(KINDS)), key=s.__getitem__)
                if s[k] > 0 and best[i] + s[k] > best[j] + 1e-12:
                    best[j], back[j] = best[i] + s[k], (i, k)
        out, j = [], len(atoms)
        while j:
            if back[j]:
                out.append((back[j][0], j, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        """Entities of a whole text in code points."""
        out = []
        for left, right in regions(text):
            atoms = _ATOM.findall(text[left:right])
            place = [left]
            for a in atoms:
                place.append(place[-1] + len(a))
            out += [(place[i], place[j], k) for i, j, k in self.decode(atoms)]
        return out


def _examples(found: list[tuple[str, list[Span]]]) -> Iterator[tuple[list[str], list[Span]]]:
    """Regions as atoms with their entities, and the same with a digit changed that a check covers."""
    for text, gold in found:
        for changed in (False, True):
            if changed:
                chars = list(text)
                for s, e, k in gold:
                    if KINDS[k] in ("card", "ip"):
                        at = next(i for i in range(e - 1, s - 1, -1) if chars[i].isdigit())
                        chars[at] = str((int(chars[at]) + 1) % 10) if KINDS[k] == "card" else "999"
                text = "".join(chars)
                gold = base_spans(text)
            atoms = _ATOM.findall(text)
            place = {0: 0}
            at = 0
            for k, a in enumerate(atoms):
                at += len(a)
                place[at] = k + 1
            inside = [(place[s], place[e], k) for s, e, k in gold if s in place and e in place]
            free, until = [], 0
            for s, e, k in sorted(inside, key=lambda x: (x[0], -x[1])):
                if s >= until and e - s <= MOST:
                    free.append((s, e, k))
                    until = e
            yield atoms, free


def train(found: list[tuple[str, list[Span]]], epochs: int = 3, step: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximise the field's conditional likelihood by stochastic gradient steps.

    The gradient of a region is what its own segments have of each feature less what the model
    expects, by the forward-backward sums over segments.
    """
    field = Field()
    examples = list(_examples(found))
    for epoch in range(epochs):
        rate = step / (1 + epoch)
        for atoms, gold in examples:
            n, segments = len(atoms), field.segments(atoms)
            if not segments or n > 400:
                continue
            ends, starts = defaultdict(list), defaultdict(list)
            for i, j, _, s in segments:
                total = _log_sum(s)
                ends[j].append((i, total))
                starts[i].append((j, total))
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                alpha[j] = _log_sum([alpha[j - 1], *(alpha[i] + t for i, t in ends[j])])
            for i in range(n - 1, -1, -1):
                beta[i] = _log_sum([beta[i + 1], *(t + beta[j] for j, t in starts[i])])
            true = {(i, j): k for i, j, k in gold}
            for i, j, feats, s in segments:
                here = true.get((i, j), -1)
                for k in range(len(KINDS)):
                    p = math.exp(alpha[i] + s[k] + beta[j] - alpha[n])
                    slope = (here == k) - p
                    if abs(slope) > 1e-4:
                        for f in feats:
                            w = field.weights.setdefault(f, [-0.5] * len(KINDS))
                            w[k] += rate * (slope - decay * w[k])
    return field


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def fit(docs: DataFrame, sample: int = 600) -> Field:
    """A field from at most ``sample`` regions, those of the smallest hashes, three quarters with entities.

    Without any region the field finds nothing and the patterns stand alone.
    """
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for text in common.texts(batch):
                for left, right in regions(text):
                    if right - left <= 400:
                        part = text[left:right]
                        out.add((part, bool(base_spans(part))))
            kept = sorted(((common.xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) >> 1, p, h) for p, h in out), key=lambda x: (x[2], x[0]))
            kept = [x for h in (True, False) for x in [y for y in kept if y[2] == h][:sample]]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in kept]), pa.array([k[1] for k in kept]), pa.array([k[2] for k in kept])], names=["hash", "region", "has"]
                )

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "hash long, region string, has boolean")
    found = common.Scratch(docs.sparkSession, "pii").table(found, "regions").distinct()
    some = lambda has, n: [r.region for r in found.filter(F.col("has") == has).orderBy("hash", "region").limit(n).collect()]
    chosen = some(True, sample * 3 // 4) + some(False, sample // 4)
    return train([(r, base_spans(r)) for r in chosen])


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those with the field's that overlap none of them."""
    base = base_spans(text)
    starts, reach = [b for b, _, _ in base], list(itertools.accumulate((e for _, e, _ in base), max))

    def meets(start: int, end: int) -> bool:
        before = bisect.bisect_left(starts, end)
        return before > 0 and reach[before - 1] > start

    return base, base + [s for s in field.spans(text) if not meets(s[0], s[1])]


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Spans of each whole text: counts of the patterns' spans, their digest, and all spans.

    A null text is empty and has none. Null ids and repeated rows stay, each row gives one.
    """
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in common.texts(batch):
                base, spans = all_spans(text, field)
                n = Counter(KINDS[k] for _, _, k in base)
                digest = hashlib.sha256(shown(base).encode()).hexdigest()
                rows.append((*(n[k] for k in KINDS), digest, shown(spans), len(spans) - len(base)))
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return one.mapInArrow(run, schema)


def masked_text(text: str, field: Field) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping ones the longest reach."""
    out, at = [], 0
    for s, e, k in sorted(all_spans(text, field)[1]):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with spans masked in ``text`` and ``n_chars`` set anew if there; a null text stays null."""
    common.prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def hidden(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else masked_text(t, field))

    out = docs.withColumn("text", hidden(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
