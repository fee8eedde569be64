"""Operator 3, secret scans: fixed patterns, then probabilistic automata learned from what they found.

``learn`` takes the credentials that the fixed patterns label, builds a prefix
tree per kind over character classes and merges states whose next-symbol
statistics are compatible (Hoeffding bound), red-blue order.  A further automaton
is learned the same way from ordinary tokens (words, joined words, numbers).  ``find``
scores every candidate outside the labelled spans and adds those that fit a credential
format as well as held-out examples do and better than ordinary text.  A candidate is a
whole run of the characters that the examples hold, without dots at its ends, as long as
the shortest example or longer; a kind judges it if its own examples hold all its symbols
and are no longer.

The learner sees a bounded sample: per kind the ``SAMPLE`` distinct examples
with the smallest hashes over all documents (a mergeable bottom-k), none longer
than ``MAX_EXAMPLE`` characters.  Scanning and scoring cover every text in full.

Defined cases: null or empty text has no spans; without labelled credentials no
automaton is learned and only the fixed patterns count; repeated rows are each
reported; very long texts and tokens are scanned and scored in full, in time linear in
their length; ``id_col``/``text_col`` alone are read, ``redact`` keeps other columns.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import statistics
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
LEARNED = "format"
SAMPLE = 300
MAX_EXAMPLE = 200
ALPHA = 0.05           # confidence parameter of the merge test
MARGIN = 0.25          # nats per character by which a format must beat ordinary text
HELD_OUT = 3           # every third example of a kind is kept from the fit and sets its cut
SPREAD = 6.0           # the cut: this many deviations below their mean, or their lowest score if that is less;
                       # the margin keeps ordinary text out
MEMO = 100_000         # verdicts that a task remembers, on tokens of at most 64 characters

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")    # = runs AKIA[A-Z0-9]+ of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")           # = runs [0-9a-f]+ of 24 or more
#: words (plain, capital, capitals, CamelCase) and numbers, alone or joined
_WORD = r"(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*+|[A-Z]+|[a-z])"
_LIST = r"{0}(?:[._/=+-]{0})*+"
ORDINARY = re.compile(rf"(?<![A-Za-z0-9_/=+.-])(?:{_LIST.format(_WORD)}|{_LIST.format('[0-9]+')})(?![A-Za-z0-9_/=+]|[.-][A-Za-z0-9])")
ORDINARY_LEAST = 6

#: character class of a symbol: a-f, other lower case, digits, upper case; the rest stand for themselves
CLASSES = str.maketrans({**{c: "h" for c in "abcdef"}, **{chr(c): "l" for c in range(103, 123)},
                         **{c: "d" for c in "0123456789"}, **{chr(c): "U" for c in range(65, 91)}})

#: the characters of each class
MEMBERS = {"h": "a-f", "l": "g-z", "d": "0-9", "U": "A-Z"}


def labelled(text: str) -> list[tuple[int, int, int, str]]:
    """Base spans as (start, kind number, end, credential)."""
    out = [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    return sorted(out)


class Automaton:
    """Probabilistic deterministic automaton from a prefix tree with merged states."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.ends, self.seen, self.to = [0], [0], [{}]
        for x in examples:
            at = 0
            for c in x:
                self.seen[at] += 1
                nxt = self.to[at].get(c)
                if nxt is None:
                    nxt = len(self.to)
                    self.to[at][c] = nxt
                    self.to.append({})
                    self.ends.append(0)
                    self.seen.append(0)
                at = nxt
            self.seen[at] += 1
            self.ends[at] += 1
        self.flow = [{c: self.seen[t] for c, t in m.items()} for m in self.to]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self.symbols = len({c for m in self.flow for c in m}) + 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (n1 ** -0.5 + n2 ** -0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.seen[a], self.seen[b]
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            fa, fb = self.flow[a], self.flow[b]
            if any(self._differ(fa.get(c, 0), na, fb.get(c, 0), nb) for c in fa.keys() | fb.keys()):
                return False
            todo += [(self.to[a][c], self.to[b][c]) for c in fb if c in fa]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree at ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, t in self.to[b].items():
                self.flow[a][c] = self.flow[a].get(c, 0) + self.flow[b][c]
                if c in self.to[a]:
                    todo.append((self.to[a][c], t))
                else:
                    self.to[a][c] = t

    def _merge_all(self) -> None:
        red, done = [0], {0}
        while True:
            blue = [(r, c, t) for r in red for c, t in sorted(self.to[r].items()) if t not in done]
            if not blue:
                return
            # the blue state with most examples first: its statistics are the firmest
            r, c, b = max(blue, key=lambda x: self.seen[x[2]])
            same = next((q for q in red if self._compatible(q, b)), None)
            if same is None:
                red.append(b)
                done.add(b)
            else:
                self.to[r][c] = same
                self._fold(same, b)

    def score(self, x: str) -> float:
        """Log likelihood per symbol, the end included; unseen moves get a small share."""
        at, total = 0, 0.0
        for c in x:
            n = self.seen[at] + 0.1 * self.symbols
            total += math.log((self.flow[at].get(c, 0) + 0.1) / n)
            at = self.to[at].get(c, at)
        total += math.log((self.ends[at] + 0.1) / (self.seen[at] + 0.1 * self.symbols))
        return total / (len(x) + 1)


class Formats:
    """The learned automata with the score that each kind's candidates must reach."""

    def __init__(self, examples: dict[str, list[str]]):
        self.kinds = {}                 # kind -> automaton, cut, symbols, least length
        for kind in KINDS:
            coded = [x.translate(CLASSES) for x in sorted(examples.get(kind, ()), key=lambda x: (_hash(x), x))]
            if coded:
                few = len(coded) < 2 * HELD_OUT
                a = Automaton(sorted(x for i, x in enumerate(coded) if few or i % HELD_OUT))
                scores = [a.score(x) for x in (coded if few else coded[::HELD_OUT])]
                cut = min(min(scores), statistics.fmean(scores) - SPREAD * statistics.pstdev(scores))
                self.kinds[kind] = (a, cut, frozenset("".join(coded)), min(map(len, coded)))
        words = sorted(x.translate(CLASSES) for x in examples.get("word", ()))
        self.ordinary = Automaton(words) if words else None
        self.candidate = None
        if self.kinds:
            signs = sorted(frozenset.union(*[k[2] for k in self.kinds.values()]))
            inside = "".join(MEMBERS.get(c) or re.escape(c) for c in signs)
            least = min(k[3] for k in self.kinds.values())
            self.candidate = re.compile(rf"(?<![A-Za-z0-9])[{inside}]{{{least},}}+(?![A-Za-z0-9])")
        self.known: dict[str, bool] = {}

    def gain(self, token: str) -> float | None:
        """By how much per symbol the best format beats ordinary text, or None when no kind reaches its cut."""
        x = token.translate(CLASSES)
        signs, best = set(x), None
        for a, cut, symbols, least in self.kinds.values():
            if len(x) >= least and signs <= symbols:
                score = a.score(x)
                if score >= cut and (best is None or score > best):
                    best = score
        if best is None:
            return None
        return best - (self.ordinary.score(x) if self.ordinary else math.log(1 / 70))

    def fits(self, token: str) -> bool:
        got = self.known.get(token)
        if got is None:
            gain = self.gain(token)
            got = gain is not None and gain >= MARGIN
            if len(token) <= 64:
                if len(self.known) >= MEMO:
                    self.known.clear()
                self.known[token] = got
        return got

    def found(self, text: str) -> Iterator[tuple[int, int]]:
        """Where the candidates stand that fit."""
        if self.candidate is None:
            return
        fit = {x for x in set(self.candidate.findall(text)) if self.fits(x.strip("."))}
        for m in self.candidate.finditer(text) if fit else ():
            if m.group() in fit:
                x = m.group()
                yield m.start() + len(x) - len(x.lstrip(".")), m.end() - len(x) + len(x.rstrip("."))


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") >> 1


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Formats:
    """Learn the formats from the labelled credentials of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[str, int]] = {k: {} for k in (*KINDS, "word")}

        def add(kind: str, x: str) -> None:
            if len(x) <= MAX_EXAMPLE:
                least[kind][x] = _hash(x)
                if len(least[kind]) > 8 * sample:
                    least[kind] = dict(heapq.nsmallest(sample, least[kind].items(), key=lambda p: (p[1], p[0])))

        for batch in batches:
            for v in batch["t"]:
                text = v.as_py() or ""
                base = labelled(text)
                secrets = {x for *_, x in base}
                for _, k, _, x in base:
                    add(KINDS[k], x)
                for x in set(ORDINARY.findall(text)) - secrets:
                    if len(x) >= ORDINARY_LEAST:
                        add("word", x)
        rows = [(k, x, h) for k, got in least.items()
                for x, h in heapq.nsmallest(sample, got.items(), key=lambda p: (p[1], p[0]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                          enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "x", "h"])

    found = (docs.select(F.col(text_col).alias("t")).mapInArrow(run, "kind string, x string, h long")
             .groupBy("kind", "x").agg(F.min("h").alias("h")).persist())
    try:
        return Formats({k: [r["x"] for r in found.where(F.col("kind") == k).orderBy("h", "x").limit(sample).collect()]
                        for k in (*KINDS, "word")})
    finally:
        found.unpersist()


def spans_of(text: str, formats: Formats) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every base and learned span, by start, then kind as listed."""
    base = labelled(text)
    out, i, upto = [(s, k, e) for s, k, e, _ in base], 0, 0
    for a, b in formats.found(text):
        while i < len(base) and base[i][0] < b:     # base spans that start before the candidate ends
            upto = max(upto, base[i][2])
            i += 1
        if upto <= a:
            out.append((a, len(KINDS), b))
    names = (*KINDS, LEARNED)
    return [(s, e, names[k]) for s, k, e in sorted(out)]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         formats: Formats | None = None) -> DataFrame:
    """One row per document: its id and ``spans`` (kind, start, end in code points, end exclusive)."""
    formats = formats or learn(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(v.as_py() or "", shared.value)]
                     for v in batch["t"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, arrow)], names=["doc_id", "spans"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
            .mapInArrow(run, f"doc_id {kind}, spans {SPANS}"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars",
           mark: str = "[SECRET]", formats: Formats | None = None) -> DataFrame:
    """The documents with every span replaced by ``mark``; ``chars_col`` is brought up to date."""
    formats = formats or learn(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, upto = [], 0
        for s, e, _ in spans_of(text, shared.value):
            if s >= upto:
                out += [text[upto:s], mark]
            upto = max(upto, e)
        return "".join(out) + text[upto:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(v.as_py()) for v in batch[text_col]], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(run, docs.schema)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out
