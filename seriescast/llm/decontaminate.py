"""Operator 5, benchmark decontamination: a generalised suffix automaton of the test items.

Items are normalised (A-Z to a-z; words are runs of digits, a-z and any
non-ASCII character) and their word sequences put into one automaton.  Training
documents stream through it word by word, tracking the longest match that ends
at each word.  A match of ``window`` words or more marks those words; an item
shorter than ``window`` counts when the whole item matches.  A word outside the
items' vocabulary resets the match, so only runs of known words are walked.

The items are a stated query set.  Tasks build their automata, each of at most
``block_words`` words (or one longer item), into a table.  The documents then meet ``pass_bytes``
of automata at a time: one pass where that is all of them; else every pass writes
the hits of documents that have any, and these are put together by a digest of id and text.  So what the
driver and a worker hold is bounded whatever the size of the benchmark.

Defined cases: null or empty text has no words, is never hit; an item without
words is ignored; equal items are each reported; an item with a null id marks its words but has no
id to list or count; empty tables give empty results
or clean documents; ``id_col``/``text_col`` alone are read, other columns stay out
of ``score`` and unchanged in ``keep_clean``, but for the characters of a text that
``keep_clean`` cut: hit spans of ``limit`` words or more leave the texts of the
documents that stay (with what parts them from the next word), again until none is
left, so that no cut joins the two ends of a passage.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescast.llm.text import covered, runs, unused, utf8, word_bounds, written

Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

WINDOW = 13
COVERAGE = 20          # contaminated: COVERAGE * n_hit >= n_words
SPAN = WINDOW          # words of a hit span that is cut from a kept document
BLOCK_WORDS = 250_000
PASS_BYTES = 16 << 20  # of packed automata that a pass over the documents carries (or one larger automaton)

_KEEP = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
#: A-Z to a-z, everything that is no word character to a space
NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in _KEEP else 32
               for b in range(256))


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        #: state -> items with a window whose walk ends there
        self.items: dict[int, set[tuple[int, str | None]]] = {}
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for name, ws in items if ws]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        for name, seq in coded:
            need = min(window, len(seq))
            self.shortest = min(self.shortest, need)
            state = size = 0
            for c in seq:
                state, size = self.step(state, size, c)
                if size >= need:
                    self.items.setdefault(self.at_length(state, need), set()).add((need, name))
        # the item lengths below the window that a document must be checked for
        self.needs = sorted({need for got in self.items.values() for need, _ in got}, reverse=True)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # the prefix is already there from another item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """Longest match after reading ``c``."""
        to = self.next[state].get(c)
        if to is not None:
            return to, size + 1
        while state != -1 and c not in self.next[state]:
            state = self.link[state]
        if state == -1:
            return 0, 0
        return self.next[state][c], self.length[state] + 1

    def at_length(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges of a document and the items whose windows occur in it."""
        ids = np.fromiter(map(self.vocab.get, ws, _MINUS), dtype=np.int64, count=len(ws))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        moves, length, link, step, items = self.next, self.length, self.link, self.step, self.items
        for a, b in zip(*runs(ids >= 0)):
            if b - a < self.shortest:
                continue
            state = size = 0
            for i, c in enumerate(ids[a:b].tolist(), int(a) + 1):
                to = moves[state].get(c)
                if to is None:
                    state, size = step(state, size, c)
                else:
                    state, size = to, size + 1
                if size >= self.shortest:
                    for need in self.needs:
                        if size < need:
                            continue
                        s = state
                        while length[link[s]] >= need:
                            s = link[s]
                        hit = [name for k, name in items.get(s, ()) if k == need]
                        if hit:
                            spans.append((i - need, i))
                            found.update(name for name in hit if name is not None)
        return spans, found


class _Repeat:
    def __iter__(self) -> Iterator[int]:
        return self

    def __next__(self) -> int:
        return -1


_MINUS = _Repeat()


ITEM_BYTES = 6      # about the bytes of a word with its space: only how many tasks build automata hangs on it


def automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """The written table (``name``, ``automaton``) of the items' automata; equal ones have equal items."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), utf8(text_col).alias("raw"))
    size = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0

    def packed(block: list) -> pa.RecordBatch:
        name = hashlib.sha256(repr(block).encode()).hexdigest()
        return pa.RecordBatch.from_pydict({"name": [name], "automaton": pa.array(
            [pickle.dumps(SuffixAutomaton(block, window))], pa.binary())})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            for i, raw in zip(batch["i"].to_pylist(), batch["raw"]):
                ws = normal_words(raw.as_py())
                if block and held + len(ws) > block_words:
                    yield packed(block)
                    block, held = [], 0
                if ws:
                    block.append((i, ws))
                    held += len(ws)
        if block:
            yield packed(block)

    parts = 1 + size // (ITEM_BYTES * block_words)
    return written(items.repartition(parts).mapInArrow(build, "name string, automaton binary"))


class Held:
    """A few automata, unpacked where they are first used: once in a worker, never on the driver."""

    def __init__(self, packed: list[bytes]):
        self.packed, self.ready = packed, None

    def get(self) -> list[SuffixAutomaton]:
        if self.ready is None:
            self.ready, self.packed = [pickle.loads(x) for x in self.packed], []
        return self.ready


def passes(table: DataFrame, pass_bytes: int) -> tuple[int, Iterator[Broadcast]]:
    """How many passes the automata take, and their broadcasts, each read when it is asked for."""
    some, room = [], 0
    for r in table.groupBy("name").agg(F.max(F.octet_length("automaton")).alias("n")).orderBy("name").collect():
        if not some or r["n"] > room:
            some.append([])
            room = pass_bytes
        some[-1].append(r["name"])
        room -= r["n"]
    some = some or [[]]

    def held(few: list[str]) -> Broadcast:
        rows = table.where(F.col("name").isin(few)).dropDuplicates(["name"]).collect() if few else []
        return table.sparkSession.sparkContext.broadcast(Held([bytes(r["automaton"]) for r in rows]))

    return len(some), map(held, some)


def _hits(ws: list[bytes], held: list[SuffixAutomaton]) -> tuple[list[tuple[int, int]], set[str]]:
    spans, names = [], set()
    for one in held:
        s, f = one.scan(ws)
        spans += s
        names |= f
    return spans, names


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
MARKS = "n_words long, spans array<struct<start:int,end:int>>, names array<string>"


def _marked(held: Broadcast | None) -> Pass:
    """The first column, words, hit spans and items of every text (``raw``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata_ = held.value.get() if held else []
        for batch in batches:
            n_words, names, spans = [], [], []
            for v in batch["raw"]:
                ws = normal_words(v.as_py())
                hits, found = _hits(ws, automata_)
                n_words.append(len(ws))
                names.append(sorted(found))
                flags = covered(len(ws), *np.array(hits).T) if hits else np.zeros(0, dtype=bool)
                spans.append([{"start": int(a), "end": int(z)} for a, z in zip(*runs(flags))])
            first = batch.schema.names[0]
            yield pa.RecordBatch.from_arrays([batch[first], pa.array(n_words, pa.int64()), pa.array(spans, SPANS),
                                              pa.array(names, pa.list_(pa.string()))],
                                             names=[first, "n_words", "spans", "names"])

    return run


def _key(id_col: str, text_col: str) -> Column:
    """Rows of one key have one id and one text, so one result."""
    return F.sha2(F.concat(F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")).cast("binary"),
                           F.lit("\0").cast("binary"), utf8(text_col)), 256)


def _marks(texts: DataFrame, given: Iterator[Broadcast]) -> DataFrame:
    """``key, spans, names`` of the ``texts`` (``key``, ``raw``) with a hit, one pass after the other."""
    parts = []
    for held in given:
        got = texts.mapInArrow(_marked(held), f"key string, {MARKS}").where(F.size("spans") > 0)
        parts.append(written(got.select("key", F.lit(len(parts)).alias("part"), "spans", "names")))
        held.destroy()
    return (reduce(DataFrame.unionByName, parts).groupBy("key", "part")
            .agg(F.first("spans").alias("spans"), F.first("names").alias("names")).groupBy("key")
            .agg(F.flatten(F.collect_list("spans")).alias("spans"),
                 F.array_distinct(F.flatten(F.collect_list("names"))).alias("names")))


RESULT = ("doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, "
          "contaminated boolean, item_ids array<string>, hit_spans array<struct<start:int,end:int>>")


def _judged(coverage: int) -> Pass:
    """The result rows from documents' words, spans (of all passes) and items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, spans = batch["n_words"].to_pylist(), [], []
            for n, hits in zip(n_words, batch["spans"].to_pylist()):
                flags = covered(n, *np.array([(x["start"], x["end"]) for x in hits]).T) if hits else np.zeros(0, dtype=bool)
                n_hit.append(int(flags.sum()))
                spans.append([{"start": int(a), "end": int(z)} for a, z in zip(*runs(flags))])
            names = [sorted(x or []) for x in batch["names"].to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], batch["n_words"], pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                pa.array([h > 0 and coverage * h >= n for h, n in zip(n_hit, n_words)], pa.bool_()),
                pa.array(names, pa.list_(pa.string())), pa.array(spans, SPANS)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "hit_spans"])

    return run


def score(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
          coverage: int = COVERAGE, block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document: words, words hit, the items found, and the verdict."""
    n, given = passes(automata(benchmark, item_col, item_text, window, block_words), pass_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw"))
    judge = _judged(coverage)
    if n == 1:      # no shuffle
        mark = _marked(next(given))
        return read.mapInArrow(lambda batches: judge(mark(batches)), RESULT.format(id=kind))
    marks = _marks(docs.select(_key(id_col, text_col).alias("key"), utf8(text_col).alias("raw")), given)
    sizes = (docs.select(F.struct(F.col(id_col).alias("id"), _key(id_col, text_col).alias("key")).alias("of"),
                         utf8(text_col).alias("raw"))
             .mapInArrow(_marked(None), f"of struct<id:{kind},key:string>, {MARKS}")
             .select(F.col("of.id").alias("doc_id"), F.col("of.key").alias("key"), "n_words"))
    return (sizes.join(marks, "key", "left").select("doc_id", "n_words", "spans", "names")
            .mapInArrow(judge, RESULT.format(id=kind)))


def _without(raw: bytes, hits: list[tuple[int, int]] | np.ndarray, n: int, limit: int) -> bytes:
    """The text of ``n`` words without its hit spans of ``limit`` words or more."""
    long = [(a, b) for a, b in zip(*runs(covered(n, *np.array(hits).T))) if b - a >= limit]
    if not long:
        return raw
    start = np.append(word_bounds(np.frombuffer(raw.translate(NORMAL), dtype=np.uint8))[0], len(raw))
    parts, upto = [], 0
    for a, b in long:
        parts.append(raw[upto: start[a]])
        upto = int(start[b])
    return b"".join([*parts, raw[upto:]])


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
               coverage: int = COVERAGE, block_words: int = BLOCK_WORDS, limit: int = SPAN,
               chars_col: str | None = "n_chars", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents that are not contaminated, without their hit spans of ``limit`` words or more, in one
    pass without a shuffle where the automata fit one; ``chars_col`` of the cut texts is brought up to date,
    all else unchanged."""
    table = automata(benchmark, item_col, item_text, window, block_words)
    n, given = passes(table, pass_bytes)
    if n > 1:
        return _keep_clean_in_passes(docs, table, given, id_col, text_col, coverage, limit, chars_col, pass_bytes)
    held = next(given)
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def left(raw: bytes) -> bytes | None:
        """What stays of a text; None where nothing does."""
        first = True
        while True:
            ws = normal_words(raw)
            hits, _ = _hits(ws, held.value.get())
            if not hits:
                return raw
            if first and coverage * int(covered(len(ws), *np.array(hits).T).sum()) >= len(ws):
                return None
            cut, first = _without(raw, hits, len(ws), limit), False
            if cut == raw:
                return raw
            raw = cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, new = [], {}
            for i, v in enumerate(batch[text_col]):
                raw = (v.as_py() or "").encode()
                rest = left(raw)
                keep.append(rest is not None)
                if rest is not None and rest != raw:
                    new[i] = rest.decode()
            if new:
                columns = list(batch.columns)
                texts = columns[at].to_pylist()
                sizes = columns[chars].to_pylist() if chars is not None else []
                for i, text in new.items():
                    texts[i] = text
                    if chars is not None:
                        sizes[i] = len(text)
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None:
                    columns[chars] = pa.array(sizes, columns[chars].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _keep_clean_in_passes(docs: DataFrame, table: DataFrame, given: Iterator[Broadcast], id_col: str, text_col: str,
                          coverage: int, limit: int, chars_col: str | None, pass_bytes: int) -> DataFrame:
    """``keep_clean`` where the automata take several passes: after each round of passes the texts that
    were cut, and only these, go through all automata again, until none is cut."""
    def cut(judge: bool) -> Pass:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept, new = [], []
                for v, hits in zip(batch["raw"], batch["spans"].to_pylist()):
                    raw, hits = v.as_py(), [(x["start"], x["end"]) for x in hits]
                    n = len(normal_words(raw))
                    kept.append(not (judge and coverage * int(covered(n, *np.array(hits).T).sum()) >= n))
                    rest = _without(raw, hits, n, limit) if kept[-1] else raw
                    new.append(rest if rest != raw else None)
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(kept, pa.bool_()), pa.array(new, pa.binary())],
                                                 names=["key", "kept", "raw"])

        return run

    key, kept, new = (unused(docs, c) for c in ("_key", "_kept", "_new"))
    keyed = docs.withColumn(key, _key(id_col, text_col))
    open_, fates = keyed.select(F.col(key).alias("key"), utf8(text_col).alias("raw")), []
    while True:
        hit = open_.join(_marks(open_, given), "key").select("key", "raw", "spans")
        fates.append(written(hit.mapInArrow(cut(not fates), "key string, kept boolean, raw binary")
                             .withColumn("round", F.lit(len(fates)))))
        open_ = fates[-1].where("raw IS NOT NULL").select("key", "raw").dropDuplicates(["key"])
        if open_.isEmpty():
            break
        given = passes(table, pass_bytes)[1]
    fate = reduce(DataFrame.unionByName, fates).groupBy(F.col("key").alias(key)).agg(
        F.bool_and("kept").alias(kept), F.max_by("raw", F.when(F.col("raw").isNotNull(), F.col("round"))).cast("string").alias(new))
    out = keyed.join(fate, key, "left").where(F.coalesce(F.col(kept), F.lit(True)))
    changed = {text_col: F.coalesce(F.col(new), F.col(text_col))}
    if chars_col in docs.columns:
        changed[chars_col] = F.coalesce(F.length(new).cast(docs.schema[chars_col].dataType), F.col(chars_col))
    return out.withColumns(changed).select(*docs.columns)
