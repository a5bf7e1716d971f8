"""Personal data: generators propose spans, boosted trees weigh them, calibrated thresholds select."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapecheck.llm.samples import sigmoid
from tapecheck.operators.blocks import materialize

KINDS = ("email", "ip", "card", "phone")
#: Up to how many different lessons the driver adds up itself (20 MB at most); more are added up in tasks.
LOCAL_LESSONS = 100_000
#: Features are cut at the ends of sixteen equal shares of the lessons, values above this counting as this; scores of the
#: calibration are counted in steps of one part in this many.
MOST_VALUE, SCORE_STEPS = 100, 4096
#: Share of the selected spans of the calibration half that must be right.
PRECISION = 0.98

# Base formats. Patterns start where no earlier character could belong to the match, so
# that every scan is linear in the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser formats of the generators, by kind.
_LOOSE_FORMATS = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[{<] ?at ?[)\]}>] ?"
        r"[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[{<] ?dot ?[)\]}>]) ?[A-Za-z0-9-]{1,63}){1,8}"
    ),
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?P<sep>[ .-])[0-9]{4,6}(?P=sep)[0-9]{4,5}(?:(?P=sep)[0-9]{1,4})?(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00 ?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# Looking ahead, so that matches may overlap.
_LOOSE = {kind: re.compile(f"(?=(?P<all>{p}))") for kind, p in _LOOSE_FORMATS.items()}
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){4,}")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
# What a text must contain for the looser format to occur in it; quick to rule out.
_CUES = {"email": re.compile(r"[(\[{<] ?at ?[)\]}>]"), "ip": re.compile(r"[0-9][\[(]\."), "card": _DIGIT, "phone": _DIGIT}
#: Characters from which a match that fails its test is still proposed.
LEAST_LENGTH = 7
_HINTS = {
    "email": re.compile(r"mail|contact|write|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr", re.I),
    "card": re.compile(r"card|visa|credit|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
}

# Words before a number that say it is something else.
_OTHER = re.compile(
    r"\b(order|invoice|ref(erence)?|version|build|release|serial|ticket|part|batch|isbn|item|model|article|sku|account|case|date|page)\b",
    re.I,
)
#: Contexts that are put before copies of valid spans, by kind, and before numbers that are none (fixed words).
_TELLING = {
    "email": ("write to ", "mail ", "contact "),
    "ip": ("host ", "server ", "ip address "),
    "card": ("card ", "paid with credit card ", "visa "),
    "phone": ("call ", "phone: ", "mobile ", "tel. ", "fax "),
}
_MISLEADING = (
    "order ", "order number ", "invoice no. ", "ref. ", "version ", "release ", "serial number ", "ticket #", "part no. ",
    "batch ", "isbn ", "item ", "article ", "case ",
)

Span = tuple[int, int, int]  # kind by position in KINDS, start, end


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every domain after an ``@`` with the longest local part before it that is still free."""
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and _LOCAL_END.match(text[start - 1]):
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """All matches of the base formats as ``kind, start, end, valid``, kind by kind, in order."""
    for start, end in _emails(text) if "@" in text else ():
        yield 0, start, end, True
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        yield 1, m.start(), m.end(), all(map(_octet, m[0].split(".")))
    for m in _CARD.finditer(text):
        size = m.end() - m.start() - m[0].count(" ") - m[0].count("-")
        yield 2, m.start(), m.end(), 13 <= size <= 19 and luhn(m[0].replace(" ", "").replace("-", ""))
    for m in _PHONE.finditer(text):
        yield 3, m.start(), m.end(), 9 <= sum(c in "0123456789" for c in m[0]) <= 15


def _inside(text: str, kind: int, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of whole digit groups inside a match that failed its test, where each passes it by itself.

    Runs overlap. One has at most 19 digits, so that a match of any length takes linear time. A
    phone number keeps the plus sign it starts with; dotted numbers of an address have four groups.
    """
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, start, end)]
    if kind == 2:
        # sums[q][i]: Luhn sum of the first i digits with those at places of parity q doubled
        numbers = [int(text[i]) for s, e in groups for i in range(s, e)]
        sums = [[0, *accumulate(_DOUBLED[d] if i % 2 == q else d for i, d in enumerate(numbers))] for q in (0, 1)]
        ends = [0, *accumulate(e - s for s, e in groups)]
    for first in range(1 if kind == 3 else len(groups)):
        size = 0
        for last in range(first, len(groups)):
            size += groups[last][1] - groups[last][0]
            if kind == 1:
                if last - first == 3:
                    if all(_octet(text[s:e]) for s, e in groups[first : last + 1]):
                        yield groups[first][0], groups[last][1]
                    break
            elif size > (19 if kind == 2 else 15):
                break
            elif kind == 3:
                if size >= 9:
                    yield start, groups[last][1]
            elif size >= 13:
                low, high = ends[first], ends[last + 1]
                if (sums[high % 2][high] - sums[high % 2][low]) % 10 == 0:
                    yield groups[first][0], groups[last][1]


def proposals(text: str) -> list[tuple[Span, bool]]:
    """Candidate spans of all generators, which may overlap, and whether each is a base span.

    A base match that fails its test may have swallowed a valid span together with its
    neighbours, so what is valid inside it is proposed too. Dotted numbers are taken as one run, however
    many; looser formats are looked for at every place, also inside one another.
    """
    matches = list(base_matches(text))
    found = {(k, s, e): ok for k, s, e, ok in matches if ok or e - s >= LEAST_LENGTH}
    runs = {(k, s, e) for k, s, e, ok in matches if not ok and k > 1}
    if any(not ok and k == 1 for k, _, _, ok in matches):
        runs |= {(1, m.start(), m.end()) for m in _DOTTED.finditer(text)}
    for k, start, end in runs:
        for s, e in _inside(text, k, start, end):
            found.setdefault((k, s, e), False)
    for k, kind in enumerate(KINDS):
        ends = set()
        for m in _LOOSE[kind].finditer(text) if _CUES[kind].search(text) else ():
            start, end = m.span("all")
            if kind == "card" or end not in ends:  # else a number without its bracket or prefix
                found.setdefault((k, start, end), False)
            ends.add(end)
    return sorted(found.items())


FEATURES = (*KINDS, "length", "digits", "letters", "separators", "groups", "longest group", "least group",
            "number before", "number after", "word before", "word after", "hint", "validated", "line start",
            "other hint", "brackets")


def _checks(kind: str, body: str, numbers: str) -> bool:
    """Whether the content of a candidate passes the test of its kind, in any format."""
    if kind == "card":
        return 13 <= len(numbers) <= 19 and luhn(numbers)
    if kind == "phone":
        return 9 <= len(numbers) <= 15
    if kind == "ip":
        return all(map(_octet, re.findall("[0-9]+", body)))
    return bool(re.search(r"[A-Za-z]{2,}$", body))


def _passes(kind: str, body: str) -> bool:
    return _checks(kind, body, re.sub(r"[^0-9]", "", body))


def disguised(kind: str, body: str, style: int = 0) -> str:
    """A valid span in one of the looser formats in which people write it, also to evade plain patterns."""
    if kind == "email":
        local, _, domain = body.partition("@")
        return f"{local} (at) {domain.replace('.', (' (dot) ', '.')[style % 2])}"
    if kind == "ip":
        return body.replace(".", ("[.]", "(.)")[style % 2])
    numbers = re.sub(r"[^0-9]", "", body)
    if kind == "card":
        return (". -"[style % 3]).join(numbers[i : i + 4] for i in range(0, len(numbers), 4))
    area, three, four = numbers[-10:-7], numbers[-7:-4], numbers[-4:]
    return (f"({area}) {three}-{four}", f"{area} {three} {four}", f"{area}-{three}-{four}")[style % 3]


def lessons(text: str, span: Span) -> Iterator[tuple[float, str, Span]]:
    """What a valid base span teaches: ``right, text, span``, by rules alone.

    The same content in looser formats is right where it stands and after a telling word, and wrong after a word that says it is
    another number (but for mail addresses). Either way it passes the test of its kind, so neither that nor
    the format decides, but what stands around it. A card or address that fails its test is wrong after any word.
    """
    k, start, end = span
    kind, body = KINDS[k], text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 8]
    draw = int.from_bytes(hashlib.sha256(f"{kind}:{body}:{start}".encode("utf-8", "surrogatepass")).digest()[:6], "big")
    telling = _TELLING[kind][draw // 7 % len(_TELLING[kind])]
    misleading = _MISLEADING[draw // 31 % len(_MISLEADING)]
    cases = [(1.0, before, draw), (1.0, before + telling, draw // 3)]
    if kind != "email":
        cases += [(0.0, before + misleading, draw), (0.0, before + misleading, draw // 3)]
    if kind in ("card", "ip"):
        cases.append((0.0, before + telling, draw, True))
    for right, context, style, *broken in cases:
        other = disguised(kind, body, style)
        if broken:
            other = other[:-1] + str((int(other[-1]) + 1) % 10) if kind == "card" else "7" + other.rjust(12, "7")
        yield right, context[-40:] + other + after, (k, len(context[-40:]), len(context[-40:]) + len(other))


def describe(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 8]
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", body) if g] or [0]
    digits = sum(c in "0123456789" for c in body)
    numbers = re.sub(r"[^0-9]", "", body)
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        min(len(body), 100), digits, sum(c.isalpha() for c in body), len(body) - sum(c.isalnum() for c in body),
        len(groups), min(max(groups), 50), min(min(groups), 50),
        float(before[-1:].isdigit()), float(after[:1].isdigit()),
        float(before[-1:].isalpha()), float(after[:1].isalpha()),
        float(bool(_HINTS[KINDS[kind]].search(before))), float(_checks(KINDS[kind], body, numbers)), float(before[-1:] in ("", "\n")),
        float(bool(_OTHER.search(before))), float(sum(c in "()[]{}<>" for c in body)),
    ]


@dataclass(frozen=True)
class BoostedTrees:
    """Trees of equal depth: node ``i`` has children ``2i+1`` and ``2i+2``; leaves add to the score."""

    prior: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    threshold: tuple[float, ...]  # by kind

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < len(feature):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return sigmoid(total)


def _cut_points(values: np.ndarray) -> list[np.ndarray]:
    """Where to cut each feature, from how many lessons have each of its values (features x values)."""
    out = []
    for counts in values:
        below = np.cumsum(counts)
        at = np.searchsorted(below, np.arange(16) / 16 * max(below[-1], 1), side="right")
        out.append(np.unique(np.minimum(at, MOST_VALUE)).astype(float))
    return out


def _value_counts(lessons: "Lessons") -> np.ndarray:
    n = MOST_VALUE + 1
    at = np.clip(lessons.x, 0, MOST_VALUE).astype(np.int64)
    return np.stack([np.bincount(at[:, f], lessons.w, n) for f in range(at.shape[1])])


def _gradients(lessons: "Lessons", model: BoostedTrees, tree: int, level: int, cuts: list[np.ndarray]) -> np.ndarray:
    """Sums of first and second derivatives by node of a level, feature, and number of cuts below the value.

    ``model`` holds the trees before ``tree`` and the levels above ``level`` of it.
    """
    p = sigmoid(lessons.raw(model, tree))
    g, h = lessons.w * (p - lessons.y), lessons.w * p * (1 - p)
    rows, node = np.arange(len(p)), np.zeros(len(p), np.int64)
    for _ in range(level):
        node = 2 * node + 1 + (lessons.x[rows, model.feature[tree, node]] > model.cut[tree, node])
    node -= 2**level - 1
    size, nodes = 17, 2**level
    out = np.zeros((2, nodes, len(cuts), size))
    for f, points in enumerate(cuts):
        at = node * size + lessons.place(f, points)
        for i, d in enumerate((g, h)):
            out[i, :, f] = np.bincount(at, d, nodes * size).reshape(nodes, size)
    return out


def _score_counts(lessons: "Lessons", model: BoostedTrees) -> np.ndarray:
    """Lessons and right ones by kind and step of the score."""
    n = SCORE_STEPS + 1
    step = np.floor(sigmoid(lessons.raw(model, len(model.leaf))) * SCORE_STEPS).astype(np.int64)
    at = lessons.x[:, : len(KINDS)].argmax(axis=1) * n + step if len(step) else step
    return np.stack([np.bincount(at, d, len(KINDS) * n).reshape(len(KINDS), n) for d in (lessons.w, lessons.w * lessons.y)])


class Lessons:
    """Different lessons with the number of times each occurs; trees finished so far are scored once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.x, self.y, self.w = x, y, w
        self._raw, self._done = np.zeros(len(x)), 0
        self._places: dict[int, np.ndarray] = {}

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch) -> "Lessons":
        flat = [np.asarray(v, float) for v in table.column("x").to_pylist()]
        y, w = (table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "w"))
        return Lessons(np.array(flat, float).reshape(len(flat), len(FEATURES)), y, w)

    def raw(self, model: BoostedTrees, trees: int) -> np.ndarray:
        rows = np.arange(len(self.x))
        for t in range(self._done, trees):
            at = np.zeros(len(self.x), np.int64)
            while len(at) and at[0] < model.feature.shape[1]:
                at = 2 * at + 1 + (self.x[rows, model.feature[t, at]] > model.cut[t, at])
            self._raw += model.leaf[t, at - model.feature.shape[1]]
        self._done = trees
        return self._raw + model.prior

    def place(self, f: int, points: np.ndarray) -> np.ndarray:
        if f not in self._places:
            self._places[f] = np.searchsorted(points, self.x[:, f], side="left")
        return self._places[f]


def _adder(rows: DataFrame):
    """Adds up ``part(lessons, *arguments)`` over the table ``x, y, w``: in the driver if it is small, else in tasks."""
    if rows.limit(LOCAL_LESSONS + 1).count() <= LOCAL_LESSONS:
        lessons = Lessons.of(rows.toArrow())
        return lambda part, *arguments: part(lessons, *arguments)

    def add(part, *arguments) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = part(Lessons.of(batch), *arguments).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], ["at", "v"])

        summed = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(part(Lessons(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0)), *arguments).shape)
        out.ravel()[summed.column("at").to_numpy()] = summed.column("v").to_numpy()
        return out

    return add


def fit_trees(add, share: float, trees: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> BoostedTrees:
    """Gradient boosting of the logistic loss; splits maximise the second-order gain over value quantiles.

    ``add`` sums over the lessons (:func:`_adder`), so what is held is sums by node, feature and cut, however many there are.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    inner = 2**depth - 1
    model = BoostedTrees(
        float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
        np.zeros((trees, inner + 1)), (1.0,) * len(KINDS),
    )
    cuts = _cut_points(add(_value_counts))
    for t in range(trees):
        for level in range(depth):
            sums = add(_gradients, model, t, level, cuts)
            for n in range(2**level):
                g, h = sums[0, n], sums[1, n]
                whole_g, whole_h = g[0].sum(), h[0].sum()
                best, node, left = 1e-6, 2**level - 1 + n, (whole_g, whole_h)
                for f, points in enumerate(cuts):
                    gl, hl = np.cumsum(g[f])[: len(points)], np.cumsum(h[f])[: len(points)]
                    gr, hr = whole_g - gl, whole_h - hl
                    gain = gr**2 / (hr + l2) + gl**2 / (hl + l2) - whole_g**2 / (whole_h + l2)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, model.feature[t, node], model.cut[t, node], left = gain[k], f, points[k], (gl[k], hl[k])
                if level == depth - 1:
                    right = whole_g - left[0], whole_h - left[1]
                    model.leaf[t, 2 * n : 2 * n + 2] = [-rate * a / (b + l2) for a, b in (left, right)]
    return model


def calibrated(model: BoostedTrees, add, precision: float = PRECISION) -> BoostedTrees:
    """For each kind the lowest threshold, in steps, at which that share of the selected candidates is right."""
    found = add(_score_counts, model)
    counts, right = (np.cumsum(c[:, ::-1], axis=1)[:, ::-1] for c in found)
    out = []
    for k in range(len(KINDS)):
        good = np.flatnonzero((found[0, k] > 0) & (right[k] >= precision * counts[k]))
        out.append(float(good[0] / SCORE_STEPS) if len(good) else 2.0)
    return BoostedTrees(model.prior, model.feature, model.cut, model.leaf, tuple(out))


def fit(docs: DataFrame, sample_rows: int | None = None) -> BoostedTrees:
    """Fit on the candidates in all documents, or in ``sample_rows`` of them if that is given, without hand-made labels.

    Base spans are right. Each of them also gives examples in looser formats (:func:`lessons`): right ones, and hard wrong
    ones that pass every test but stand where the text says they are something else. Candidates that overlap no base
    span and fail the check of their kind are wrong; those that pass it may be real and nobody knows, so they count
    neither way. One half of the candidates, by a hash of what is seen of them, grows the trees, the other calibrates a threshold
    for each kind, without base spans: those stay at any threshold. Labels are not read. Without any candidate nothing but
    base spans is selected.

    Lessons that look the same are counted in Spark, so their number follows the variety of formats and contexts.
    Trees and thresholds need sums over them only.
    """
    sample = docs.select("text")
    if sample_rows is not None:
        chosen = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        sample = docs.join(F.broadcast(chosen.distinct()), "doc_id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = proposals(text)
                valid = [span for span, right in found if right]
                for (k, start, end), right in found:
                    if not right and (
                        _passes(KINDS[k], text[start:end]) or any(start < e and s < end for _, s, e in valid)
                    ):
                        continue
                    cases = [(float(right), text, (k, start, end)), *(lessons(text, (k, start, end)) if right else ())]
                    for n, (y, body, span) in enumerate(cases):
                        _, s, e = span
                        shown = f"{k}:{n}:{body[max(0, s - 40) : e + 8]}"
                        grows = zlib.crc32(shown.encode("utf-8", "surrogatepass")) % 2 == 0
                        x = tuple(min(v, float(MOST_VALUE)) for v in describe(body, span))
                        seen[grows, right and not n, y, x] += 1
            grows, base, y, x = zip(*seen) if seen else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grows, pa.bool_()), pa.array(base, pa.bool_()), pa.array(y, pa.float64()),
                    pa.array(x, pa.list_(pa.float64())), pa.array(list(seen.values()), pa.int64()),
                ],
                ["grows", "base", "y", "x", "w"],
            )

    counted = sample.mapInArrow(run, "grows boolean, base boolean, y double, x array<double>, w long")
    counted = materialize(counted.groupBy("grows", "base", "y", "x").agg(F.sum("w").alias("w")))
    growing = counted.where("grows")
    total = growing.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    model = fit_trees(_adder(growing.select("x", "y", "w")), total[1] / total[0] if total[0] else 0.5)
    return calibrated(model, _adder(counted.where("not grows and not base").select("x", "y", "w")))


def spans_of(text: str, model: BoostedTrees) -> tuple[list[Span], list[Span]]:
    """Base spans, and all selected spans; both by kind, then start.

    Base spans always stay. Other candidates need a score of at least their kind's threshold
    and no overlap with a base span or with one of a better score.
    """
    candidates = proposals(text)
    base = [span for span, is_base in candidates if is_base]
    others = [span for span, is_base in candidates if not is_base]
    if not others:
        return base, base
    p = model.scores(np.array([describe(text, s) for s in others], float))
    taken = list(base)
    for at in np.argsort(-p, kind="stable"):
        kind, start, end = others[at]
        if p[at] >= model.threshold[kind] and all(end <= s or start >= e for _, s, e in taken):
            taken.append(others[at])
    return base, sorted(taken)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row.

    Counts and digest cover the base spans, ``spans`` all selected ones as
    ``kind:start:end`` in code points, by kind and start. A NULL or empty text has none. Repeated
    rows are repeated; a NULL id is kept; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans, added = [], [], []
            for text in batch.column("text"):
                base, every = spans_of(text.as_py() or "", model)
                for k, column in enumerate(counts):
                    column.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                added.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(added, pa.int64()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long"
    )


def redact(text: str, spans: str) -> str:
    """``text`` with every span replaced by the name of its kind; overlapping spans become one."""
    out, at = [], 0
    parts = sorted((int(s), -int(e), k) for k, s, e in (p.split(":") for p in spans.split(",") if p))
    for start, end, kind in parts:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, -end)
    return "".join(out) + text[at:]
