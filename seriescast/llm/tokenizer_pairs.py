"""Operator 12, cross-tokenizer alignment: minimal perfect hashing of distinct token pairs.

Each text is encoded once by two tokenizers; the ids go as packed numbers into a table
in the checkpoint folder, and every later pass re-aligns documents from it (token ends on one
byte axis; positions where both tokenizers end a token cut groups, and each stretch
between neighbouring ends is one linked occurrence).

1. Distinct pairs: each task keeps the pairs it meets once; ``distinct`` over all.  Pairs are
   split by their first id into shards of at most about ``SHARD`` pairs.
2. A task per shard builds a minimal perfect hash: keys that fall alone into a
   slot of a bit table are settled there, the others go on to the next, smaller table; a
   slot's rank among the set bits is the key's index.  The keys in index order are kept to verify
   every lookup.
3. Counting: each task re-aligns its documents and adds into one dense vector indexed by
   the hash; vectors are cut into blocks and summed in a tree (lanes of tasks, then lanes).
4. Second pass: documents are re-aligned again and look their links' counts up.

Hash, keys and counts of one shard are broadcast (at most about ``SHARD`` pairs of 24 bytes);
with more shards steps 3 and 4 run once per shard and the documents' sums add up.  The
number of distinct pairs is bounded by the two vocabularies, not by the corpus.

The byte tokenizer's json vocabulary is run by tiktoken with the published split pattern
(the same ids as the json's own library, about five times as fast; the tests hold it against that).

Defined cases: null or empty texts, texts that are not UTF-8, and texts whose joined token bytes
differ from space + text have no tokens (zeros, empty digest); repeated rows and null ids
are rows like others, each counted as a document; an empty table gives an empty result;
columns besides id and text are neither read nor returned.  Both files must be readable
under the same path on every executor.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescast.llm.text import mix, pieces, utf8

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD = 1 << 22       # pairs of one perfect hash
BLOCK = 1 << 16       # vector slots that travel together
LANES = 64            # partial vectors of one lane are summed before the lanes are
PIECE = 1 << 18       # text bytes encoded, and four bytes of ids aligned, at once
HELD = 1 << 20        # distinct pairs a task holds before it hands them on
TABLES = 2            # bits per key in each table of the hash


class Encoder(NamedTuple):
    encode: Callable[[list[str]], list]      # a sequence of ids per text, space + text encoded
    token: list[bytes]        # the bytes of each id
    size: np.ndarray          # their number


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(encode: Callable, token: list[bytes]) -> Encoder:
    return Encoder(encode, token, np.array([len(t) for t in token], dtype=np.int64))


@lru_cache
def byte_encoder(path: str = BYTE_BPE) -> Encoder:
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {k: i for k, i in spec["model"]["vocab"].items() if k not in special}
    token = [b""] * (max(vocab.values()) + 1)
    for k, i in vocab.items():
        token[i] = bytes(letters[c] for c in k)
    own = tiktoken.Encoding("byte", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(token) if t},
                            special_tokens={})
    return _encoder(lambda texts: [own.encode_to_numpy(" " + t, disallowed_special=()) for t in texts], token)


@lru_cache
def piece_encoder(path: str = PIECE_BPE) -> Encoder:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    token = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        token.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i)
                     else b"" if model.is_control(i) or model.is_unknown(i)
                     else piece.replace("▁", " ").encode())
    return _encoder(lambda texts: model.encode(texts, num_threads=1), token)


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, a, b): the ids of every text as packed uint32, empty where there are no tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_encoder(a_path), piece_encoder(b_path)
        for batch in batches:
            for piece in pieces(batch, PIECE):
                raws = [v.as_py() for v in piece["raw"]]
                texts = []
                for r in raws:
                    try:
                        texts.append(r.decode())
                    except UnicodeDecodeError:
                        texts.append("")
                packed: list[list[bytes]] = [[], []]
                for raw, x, y in zip(raws, a.encode(texts), b.encode(texts)):
                    whole = b" " + raw
                    ids = [np.asarray(i, dtype=np.uint32) for i in (x, y)]
                    # byte-level tokens hold the bytes they were cut from, so their number decides
                    same = (raw and a.size[ids[0]].sum() == len(whole) and b.size[ids[1]].all()
                            and b"".join(map(b.token.__getitem__, y)) == whole)
                    for out, i in zip(packed, ids):
                        out.append(i.tobytes() if same else b"")
                yield pa.RecordBatch.from_arrays([piece["doc_id"], *[pa.array(p, pa.binary()) for p in packed]],
                                                 names=["doc_id", "a", "b"])

    read = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw"))
    return read.mapInArrow(run, f"doc_id {kind}, a binary, b binary")


class Aligned(NamedTuple):
    """Documents laid end to end on one byte axis."""

    ids: tuple[np.ndarray, np.ndarray]
    of: tuple[np.ndarray, np.ndarray]   # token index of each link, per side
    close: np.ndarray                   # links that end a group
    links: np.ndarray                   # first link of each document, and the number of all
    pair: np.ndarray                    # a id << 32 | b id of each link


def align(a: list[bytes], b: list[bytes], size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    ids = tuple(np.frombuffer(b"".join(x), dtype=np.uint32) for x in (a, b))
    ends = [np.cumsum(s[i], dtype=np.int64) for s, i in zip((size_a, size_b), ids)]
    axis = int(ends[0][-1]) if len(ends[0]) else 0
    marks = []
    for e in ends:
        m = np.zeros(axis + 1, dtype=bool)
        m[e] = True
        marks.append(m)
    at = np.flatnonzero(marks[0] | marks[1])   # every stretch between neighbouring ends is one link
    hit = [m[at] for m in marks]
    of = tuple(np.cumsum(h) - h for h in hit)
    tokens = np.cumsum([0, *[len(x) // 4 for x in a]])
    doc_end = np.concatenate([[0], ends[0]])[tokens]
    links = np.searchsorted(at, doc_end, side="right")
    pair = ids[0][of[0]].astype(np.uint64) << np.uint64(32) | ids[1][of[1]].astype(np.uint64)
    return Aligned(ids, of, hit[0] & hit[1], links, pair)


Sizes = tuple[np.ndarray, np.ndarray]


def token_sizes(a_path: str, b_path: str) -> Sizes:
    """Bytes per id of both vocabularies: all that aligning needs of them."""
    return tuple(e.size.astype(np.uint16) for e in (byte_encoder(a_path), piece_encoder(b_path)))


def _each(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    for batch in batches:
        for piece in pieces(batch, 4 * PIECE, "a"):
            yield piece, align(piece["a"].to_pylist(), piece["b"].to_pylist(), *sizes)


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys: cascading bit tables with ranks."""

    def __init__(self, keys: np.ndarray):
        self.words: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        self.n, left = 0, keys
        while len(left):
            bits = max(64, TABLES * len(left) + 63 & ~63)
            slot = self._slot(left, len(self.words), bits)
            alone = np.bincount(slot, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            set_ = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.ranks.append(self.n + np.cumsum(set_) - set_)
            self.n += int(set_.sum())
            left = left[~alone[slot]]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mix(keys ^ salt) % np.uint64(bits)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; for others any index, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.words, self.ranks)):
            slot = self._slot(keys[todo], level, 64 * len(words))
            word, bit = words[slot >> 6], (slot & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (ranks[slot >> 6] + np.bitwise_count(below))[hit]
            todo = todo[~hit]
        return out


class Shard(NamedTuple):
    number: int
    of: int
    hash: PerfectHash
    keys: np.ndarray      # in index order, to verify lookups

    def find(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which links are of this shard, and their indices, each verified."""
        mine = shard_of(pair, self.of) == self.number if self.of > 1 else np.ones(len(pair), dtype=bool)
        at = self.hash.index(pair[mine])
        if not np.array_equal(self.keys[at], pair[mine]):
            raise ValueError("a pair is missing from its perfect hash")
        return mine, at


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    """All pairs of one first id are in one shard."""
    return (mix(pair >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def distinct_pairs(ids: DataFrame, sizes: Sizes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = np.zeros(0, dtype=np.uint64), []
        for _, got in _each(batches, sizes):
            some.append(np.unique(got.pair))
            if sum(map(len, some)) > HELD:
                held, some = np.unique(np.concatenate([held, *some])), []
                if len(held) > HELD:
                    yield pack(held)
                    held = held[:0]
        yield pack(np.unique(np.concatenate([held, *some])))

    def pack(pair: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64))], names=["pair"])

    return ids.mapInArrow(run, "pair long").distinct()


def hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, n, hash, keys): one perfect hash per shard, each built in its own task."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = np.asarray(batch["pair"])
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(pair.view(np.uint64), shards)), batch["pair"]],
                                             names=["shard", "pair"])

    def build(table: pa.Table) -> pa.Table:
        keys = np.asarray(table["pair"]).view(np.uint64)
        made = PerfectHash(keys)
        order = np.empty_like(keys)
        order[made.index(keys)] = keys
        return pa.table({"shard": table["shard"][:1].cast(pa.int64()), "n": pa.array([made.n], pa.int64()),
                         "hash": pa.array([pickle.dumps(made)], pa.binary()), "keys": pa.array([order.tobytes()], pa.binary())})

    return (pairs.mapInArrow(label, "shard long, pair long").groupBy("shard")
            .applyInArrow(build, "shard long, n long, hash binary, keys binary"))


def tree_sum(parts: DataFrame) -> DataFrame:
    """(block, part, vec) with vectors of int64: their sums per block, over lanes of parts first."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for block, lane, vec in zip(batch["block"].to_pylist(), batch["part"].to_pylist(), batch["vec"]):
                vec = np.frombuffer(vec.as_py(), dtype=np.int64)
                if (block, lane) != at:
                    if at is not None:
                        yield pack(at, total)
                    at, total = (block, lane), vec.copy()
                else:
                    total += vec
        if at is not None:
            yield pack(at, total)

    def pack(at: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()),
                                           pa.array([total.tobytes()], pa.binary())], names=["block", "part", "vec"])

    for lane in (F.col("part") % LANES, F.lit(0)):
        parts = (parts.select("block", lane.cast("long").alias("part"), "vec").repartition("block", "part")
                 .sortWithinPartitions("block", "part").mapInArrow(add, "block long, part long, vec binary"))
    return parts


def counts(ids: DataFrame, shard: Shard, sizes: Sizes) -> np.ndarray:
    """In how many documents each pair of the shard is linked, by index of the hash."""
    given = ids.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Shard = given.value
        n = len(mine.keys)
        total = np.zeros(n, dtype=np.int64)
        for _, got in _each(batches, sizes):
            doc = np.repeat(np.arange(len(got.links) - 1), np.diff(got.links))
            here, at = mine.find(got.pair)
            once = np.unique(doc[here] * n + at)
            total += np.bincount(once % n, minlength=n)
        part = TaskContext.get().partitionId()
        for at in range(0, n, BLOCK):
            if total[at: at + BLOCK].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at // BLOCK], pa.int64()), pa.array([part], pa.int64()),
                     pa.array([total[at: at + BLOCK].tobytes()], pa.binary())], names=["block", "part", "vec"])

    out = np.zeros(len(shard.keys), dtype=np.int64)
    for row in tree_sum(ids.mapInArrow(run, "block long, part long, vec binary")).toLocalIterator():
        vec = np.frombuffer(row["vec"], dtype=np.int64)
        out[row["block"] * BLOCK: row["block"] * BLOCK + len(vec)] = vec
    given.destroy()
    return out


def groups(got: Aligned) -> list[str]:
    """Per document its groups as text: ``a1,a2|b1;a3|b2,b3``."""
    last = np.flatnonzero(got.close)
    after = [o[last] + 1 for o in got.of]                     # tokens of each side up to each group's end
    side = [np.repeat(np.arange(len(x)), np.diff(x, prepend=0)) for x in after]
    before = [np.concatenate([[0], x]) for x in after]
    n = [len(x) for x in got.ids]
    code = np.empty(n[0] + n[1], dtype=np.int64)
    # a group's first tokens, then its second ones; after each a comma, a bar or a semicolon
    sep_a, sep_b = np.zeros(n[0], dtype=np.int64), np.zeros(n[1], dtype=np.int64)
    sep_a[after[0] - 1], sep_b[after[1] - 1] = 1, 2
    code[np.arange(n[0]) + before[1][side[0]]] = got.ids[0].astype(np.int64) * 3 + sep_a
    code[np.arange(n[1]) + after[0][side[1]]] = got.ids[1].astype(np.int64) * 3 + sep_b
    tokens = [np.concatenate([[0], o + 1])[got.links] for o in got.of]
    table, size = _shown(max(map(int, (x.max(initial=0) for x in got.ids))))
    chars = table[code].view(np.uint8)
    text = chars[chars != 0].tobytes().decode()
    cut = np.concatenate([[0], np.cumsum(size[code], dtype=np.int64)])[tokens[0] + tokens[1]].tolist()
    return [text[a: max(a, b - 1)] for a, b in zip(cut, cut[1:])]


def _shown(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Every id up to ``most`` with each separator, as fixed-width bytes, and their lengths."""
    return _shown_upto(1 << max(16, most.bit_length()))


@lru_cache(maxsize=2)
def _shown_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    table = np.char.add(np.repeat(np.arange(n).astype("S"), 3), np.tile(np.array([b",", b"|", b";"]), n))
    return table, np.char.str_len(table).astype(np.uint8)


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def looked_up(ids: DataFrame, shard: Shard, count: np.ndarray, sizes: Sizes, last: bool) -> DataFrame:
    """``ids`` with the shard's links added to ``n_best`` and ``count_sum``; after the ``last`` shard
    the result rows, with sizes and groups in place of the ids."""
    best = np.zeros(int(shard.keys.max()) // (1 << 32) + 1 if len(count) else 1, dtype=np.int64)
    first = (shard.keys >> np.uint64(32)).astype(np.int64)
    np.maximum.at(best, first, count)
    given = ids.sparkSession.sparkContext.broadcast((shard, count, count == best[first]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, times, top = given.value
        for piece, got in _each(batches, sizes):
            here, at = mine.find(got.pair)
            cols = {}
            for name, values in (("n_best", top), ("count_sum", times)):
                sums = np.zeros(len(got.pair) + 1, dtype=np.int64)
                sums[1:][here] = values[at]
                sums = np.cumsum(sums)
                cols[name] = np.asarray(piece[name]) + sums[got.links[1:]] - sums[got.links[:-1]]
            cols = {c: pa.array(x) for c, x in cols.items()}
            if last:
                closed = np.concatenate([[0], np.cumsum(got.close)])[got.links]
                n_a, n_b = (pa.array([len(x) // 4 for x in piece[c].to_pylist()], pa.int64()) for c in ("a", "b"))
                cols = {"n_a": n_a, "n_b": n_b, "n_groups": pa.array(np.diff(closed)), "n_links": pa.array(np.diff(got.links)),
                        **cols, "groups": pa.array(groups(got), pa.string())}
            else:
                cols = {"a": piece["a"], "b": piece["b"], **cols}
            yield pa.RecordBatch.from_arrays([piece["doc_id"], *cols.values()], names=["doc_id", *cols])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(run, f"doc_id {kind}, {RESULT}" if last else ids.schema)


def aligned(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, id_col: str = "doc_id",
            text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    sizes = token_sizes(a_path, b_path)
    ids = packed(encoded(docs, a_path, b_path, id_col, text_col))
    pairs = packed(distinct_pairs(ids, sizes))
    shards = max(1, -(-pairs.count() // shard))
    made = packed(hashes(pairs, shards))
    ids = ids.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(shards):
        row = made.where(F.col("shard") == k).first()
        hash_, keys = (pickle.loads(row["hash"]), row["keys"]) if row else (PerfectHash(np.zeros(0, np.uint64)), b"")
        one = Shard(k, shards, hash_, np.frombuffer(keys, dtype=np.uint64))
        ids = looked_up(ids, one, counts(ids, one, sizes), sizes, k == shards - 1)
        if k < shards - 1:
            ids = packed(ids)
    return ids


def packed(df: DataFrame) -> DataFrame:
    """``df`` written as a zstd-compressed Parquet table in the session's checkpoint folder and read back."""
    from seriescast.session import ensure_checkpoint_dir

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/pairs-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)

