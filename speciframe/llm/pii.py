"""Personal data by a semi-Markov conditional random field.

Base spans are found by fixed patterns. Around every digit run or ``@`` lies a window: neighbouring
chunks of text that may belong to one entity. In a window a segmentation into entities (at most
``LONGEST`` tokens each) and single outside tokens is scored by whole-span features (does the whole
segment look like an address, how many digits has it, does its check sum hold, what stands before and
after) and by the types of neighbouring segments; dynamic programming finds the best one, boundaries and
types together. The weights maximise the conditional likelihood of windows whose base spans serve as
labels; at most ``MAX_WINDOWS`` windows are used, smallest hash first. Segments found are added
to the base spans, which always stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, in_small_batches

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24
MAX_WINDOWS = 1_000
#: Characters of a window that the weights are learned from; windows of any length are searched.
MAX_WINDOW = 400
EPOCHS = 4

# fixed values: what the base patterns accept
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# both begin where a run begins: a search that fails there fails in the rest of the run
_WINDOW = re.compile(r"(?<![^\s0-9@])[^\s0-9@]*+[0-9@]\S*(?:\x20[^\s0-9@]{0,8}[0-9@]\S*)*")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_OUT = ""
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_RESULT = pa.struct([("base", pa.list_(_SPAN)), ("spans", pa.list_(_SPAN))])
_TYPE = "struct<base:array<struct<kind:string,start:int,end:int>>,spans:array<struct<kind:string,start:int,end:int>>>"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> list[Span]:
    """From each ``@`` back to the start of the local part, then forward: linear in the text, and the
    same spans as a search from the left, for a match can only begin in the run before its ``@``."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append(("email", start, end))
        else:
            end = max(end, 0)
        at = text.find("@", max(at + 1, end))
    return found


def _is_ip(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _is_ip(m.group())]
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def windows(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of the stretches that may hold an entity."""
    for m in _WINDOW.finditer(text):
        yield m.start(), m.group()


def shape(segment: str) -> tuple[str, ...]:
    return _shape(segment) if len(segment) <= 64 else _shape.__wrapped__(segment)


@lru_cache(maxsize=200_000)
def _shape(segment: str) -> tuple[str, ...]:
    """Whole-span features that do not depend on the type or the neighbours."""
    digits = _digits(segment)
    n = len(digits)
    found = [f"digits{min(n // 2, 10)}"]
    if "@" in segment:
        found.append("at")
        if _ADDRESS.fullmatch(segment):
            found.append("address")
    elif _IP.fullmatch(segment):
        found.append("quad" if _is_ip(segment) else "badquad")
    elif n:
        if _CARD.fullmatch(segment) or n == 1:
            found.append("chain")
            if 14 <= n <= 19:
                found.append("luhn" if luhn(digits) else "noluhn")
        if segment[0] == "+" and 10 <= n <= 15 and _PHONE.fullmatch(segment):
            found.append("call")
    if re.search(r"[^\W\d_]", segment) and "@" not in segment:
        found.append("letters")
    return tuple(found)


def candidates(window: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, tuple[str, ...]]]]]:
    """Tokens as (start, end), and for each end token the segments that may end there: (first, features).

    A segment holds a digit or ``@`` and begins and ends with neither white space nor closing marks. One with
    letters and no ``@`` has no shape but its number of digits, which running counts tell without looking at it."""
    tokens = [m.span() for m in _TOKEN.finditer(window)]
    ends: list[list[tuple[int, tuple[str, ...]]]] = []
    opens, marks, digits = [], [], [0]
    at, letter = -1, -1  # the last tokens so far that are an @, and that are letters
    mixed: dict[tuple[int, str, str], tuple[str, ...]] = {}
    for j, (start, stop) in enumerate(tokens):
        lead, final = window[start], window[stop - 1]
        if lead == "@":
            at = j
        elif lead.isalnum() and not lead.isdecimal():
            letter = j
        opens.append(lead.isalnum() or lead in "+%_.(-")
        marks.append("<^" if start == 0 else "<a" if window[start - 1].isalnum() else f"<{window[start - 1]}")
        digits.append(digits[-1] + (stop - start if "0" <= lead <= "9" else 0))
        here = []
        if final.isalnum() or final in "%_":
            after = ">$" if stop == len(window) else ">a" if window[stop].isalnum() else f">{window[stop]}"
            for i in range(j, max(-1, j - LONGEST), -1):
                if not opens[i]:
                    continue
                n = digits[j + 1] - digits[i]
                if at < i <= letter and n:
                    key = (min(n, 20), marks[i], after)
                    found = mixed.get(key)
                    if found is None:
                        found = mixed[key] = (f"digits{min(n // 2, 10)}", *(("chain",) if n == 1 else ()), "letters", marks[i], after)
                elif n or at >= i:
                    found = (*shape(window[tokens[i][0] : stop]), marks[i], after)
                else:
                    continue
                here.append((i, found))
        ends.append(here)
    return tokens, ends


@dataclass
class Model:
    """Weights of (feature, type) and of (type before, type)."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)
    known: dict[tuple[str, ...], tuple[tuple[str, float], ...]] = field(default_factory=dict)

    def span_score(self, features: tuple[str, ...], kind: str) -> float:
        get = self.weights.get
        return get(("bias", kind), 0.0) + sum(get((f, kind), 0.0) for f in features)

    def step_score(self, before: str, kind: str) -> float:
        return self.weights.get((f"after{before}", kind), 0.0)

    def decode(self, window: str) -> list[Span]:
        """The best segmentation's entities, as offsets in the window. What a state gains from the best state
        before it is worked out once per place, not per segment."""
        tokens, ends = candidates(window)
        states = (_OUT, *KINDS)
        step = {(a, b): self.step_score(a, b) for a in states for b in states}
        best: list[dict[str, tuple[float, int, str]]] = [{_OUT: (0.0, -1, _OUT)}]
        entry: list[dict[str, tuple[float, str]]] = []
        for j in range(len(tokens)):
            row, enter = best[j], {}
            for kind in states:
                for before in states:
                    if before in row:
                        value = row[before][0] + step[before, kind]
                        if kind not in enter or value > enter[kind][0]:
                            enter[kind] = (value, before)
            entry.append(enter)
            value, before = enter[_OUT]
            new = {_OUT: (value, j, before)}
            for first, features in ends[j]:
                for kind, own in self.kind_scores(features):
                    value, before = entry[first][kind]
                    value += own
                    if kind not in new or value > new[kind][0]:
                        new[kind] = (value, first, before)
            best.append(new)
        kind, at, found = max(best[-1], key=lambda k: best[-1][k][0]), len(tokens), []
        while at > 0:
            _, first, before = best[at][kind]
            if kind:
                found.append((kind, tokens[first][0], tokens[at - 1][1]))
            at, kind = first, before
        return found[::-1]

    def kind_scores(self, features: tuple[str, ...]) -> tuple[tuple[str, float], ...]:
        """``span_score`` by kind, remembered: there are few sets of features. Kinds are left out that score less
        than the same tokens outside entities, whatever stands before and after."""
        known = self.known.get(features)
        if known is None:
            step, states = self.step_score, (_OUT, *KINDS)
            outside = min(step(s, _OUT) for s in states) + min(step(_OUT, s) for s in states) + min(0.0, LONGEST * step(_OUT, _OUT))
            rated = [(kind, self.span_score(features, kind)) for kind in KINDS]
            known = self.known[features] = tuple(
                (kind, own) for kind, own in rated
                if own + max(step(s, kind) for s in states) + max(step(kind, s) for s in states) >= outside)
        return known

    def learn(self, window: str, spans: list[Span], rate: float) -> None:
        """One ascent step on the log-likelihood of a window: observed less expected features."""
        tokens, ends = candidates(window)
        size, states = len(tokens), (_OUT, *KINDS)
        starts, stops = {t[0]: i for i, t in enumerate(tokens)}, {t[1]: i for i, t in enumerate(tokens)}
        gold = {}
        for kind, a, b in spans:
            if a in starts and b in stops:
                gold[stops[b]] = (starts[a], kind)
        arcs: list[list[tuple[int, str, float, tuple[str, ...]]]] = []
        for j in range(size):
            here = [(j, _OUT, 0.0, ())]
            for first, features in ends[j]:
                here += [(first, kind, self.span_score(features, kind), features) for kind in KINDS]
            arcs.append(here)
        step = {(a, b): self.step_score(a, b) for a in states for b in states}
        low = -1e30
        alpha = [{_OUT: 0.0}] + [{} for _ in range(size)]
        for j in range(size):
            for first, kind, own, _ in arcs[j]:
                for before, value in alpha[first].items():
                    alpha[j + 1][kind] = _log_add(alpha[j + 1].get(kind, low), value + own + step[before, kind])
        beta: list[dict[str, float]] = [{} for _ in range(size)] + [{s: 0.0 for s in states}]
        for j in range(size - 1, -1, -1):
            for first, kind, own, _ in arcs[j]:
                if kind in beta[j + 1]:
                    for before in alpha[first]:
                        beta[first][before] = _log_add(beta[first].get(before, low), beta[j + 1][kind] + own + step[before, kind])
        whole = beta[0][_OUT]
        change: dict[tuple[str, str], float] = {}

        def add(features: tuple[str, ...], before: str, kind: str, amount: float) -> None:
            for key in ((f"after{before}", kind), *(((f, kind) for f in ("bias", *features)) if kind else ())):
                change[key] = change.get(key, 0.0) + amount

        for j in range(size):
            for first, kind, own, features in arcs[j]:
                if kind in beta[j + 1]:
                    for before, value in alpha[first].items():
                        p = math.exp(min(0.0, value + own + step[before, kind] + beta[j + 1][kind] - whole))
                        if p > 1e-6:
                            add(features, before, kind, -p)
        j, walk = size - 1, []
        while j >= 0:
            first, kind = gold.get(j, (j, _OUT))
            features = next((f for i, f in ends[j] if i == first), ()) if kind else ()
            walk.append((features, kind))
            j = first - 1
        before = _OUT
        for features, kind in reversed(walk):
            add(features, before, kind, 1.0)
            before = kind
        self.known = {}
        for key, amount in change.items():
            self.weights[key] = self.weights.get(key, 0.0) * (1 - rate * 1e-3) + rate * amount

    def find(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        if not text:
            return [], []
        base = base_spans(text)
        if "@" not in text and not _DIGIT.search(text):
            return base, base
        added = [(kind, start + a, start + b) for start, window in windows(text) for kind, a, b in self.decode(window)]
        return base, in_order(base + added)


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b - a > -40 else a


def _labelled(text: str) -> list[tuple[str, list[Span]]]:
    """Windows of a text with the base spans inside them, longest first where spans overlap."""
    base = sorted(base_spans(text), key=lambda s: s[1] - s[2])
    rows = []
    for start, window in windows(text):
        own: list[Span] = []
        for kind, a, b in base:
            if start <= a and b <= start + len(window) and all(b <= x or y <= a for _, x, y in own):
                own.append((kind, a, b))
        rows.append((window, [(k, a - start, b - start) for k, a, b in own]))
    return rows


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Weights from the ``MAX_WINDOWS`` distinct windows of smallest hash among all of at most ``MAX_WINDOW``
    characters in all texts; an empty sample leaves all weights 0, and then nothing is added to the base spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the windows in a task's texts, those that may be among the ``MAX_WINDOWS`` of smallest hash."""
        held: dict[str, tuple[bytes, list[Span]]] = {}

        def least() -> dict:
            return dict(sorted(held.items(), key=lambda w: (w[1][0], w[0]))[:MAX_WINDOWS])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for window, spans in _labelled(t):
                    if len(window) <= MAX_WINDOW and window not in held:
                        held[window] = (blake2b(window.encode(), digest_size=8).digest(), spans)
            if len(held) > 20 * MAX_WINDOWS:
                held = least()
        rows = [(w, h, s) for w, (h, s) in least().items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()),
             pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r[2]] for r in rows], pa.list_(_SPAN))],
            names=["window", "hash", "spans"],
        )

    rows = (
        in_small_batches(docs).select(text).filter(F.col(text).rlike("[0-9@]"))
        .mapInArrow(cut, "window string, hash binary, spans array<struct<kind:string,start:int,end:int>>").distinct()
        .orderBy("hash", "window").limit(MAX_WINDOWS).collect()
    )
    model = Model()
    for epoch in range(EPOCHS):
        for r in rows:
            model.learn(r["window"], [tuple(s) for s in r["spans"]], 0.5 / (1 + epoch))
    return model


def find(docs: DataFrame, model: Model, text: str = "text", into: str = "_personal") -> DataFrame:
    """``docs`` with a struct of base spans and of all spans; offsets are code points, end exclusive.

    Null and empty texts have no spans. Equal texts get equal spans.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_TYPE)
    def spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        rows = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]
        for batch in texts:
            yield pa.array([dict(zip(("base", "spans"), map(rows, own.find(t)))) for t in batch.to_pylist()], _RESULT)

    return in_small_batches(docs).withColumn(into, spans(F.col(text)))


def redacted(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with personal data replaced; ``length``, where there is such a column, follows the new text
    where it changed. Null and empty texts stay as they are; other columns, of any name, are left alone."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text))

    @F.arrow_udf("string")
    def cleaned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.value
        for batch in texts:
            yield pa.array([redacted(t, own.find(t)[1]) if t else t for t in batch.to_pylist()], pa.string())

    done = in_small_batches(carried(docs, text)).withColumn("cleaned", cleaned(F.col(f"`{text}`")))
    row = F.col("row").withField(f"`{text}`", F.col("cleaned"))
    if length in docs.columns:
        changed = F.col("cleaned") != F.col(f"row.`{text}`")
        size = F.char_length("cleaned").cast(docs.schema[length].dataType)
        row = row.withField(f"`{length}`", F.when(changed, size).otherwise(F.col(f"row.`{length}`")))
    return done.select(row.alias("row")).select("row.*").select(*[F.col(f"`{c}`") for c in docs.columns])
